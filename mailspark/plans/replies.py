"""Registered queries of reply threads (E1): messages rendered from ``conversations`` with id headers, parsed and linked.

Ids follow from (conv_id, turn) by rule, so that every case occurs and grows with the
table: a reply names the turn before; most first turns of a hundred conversations form one
chain; a part of every third conversation replies to the first message of all; absent ids,
repeated ids, replies to themselves, circles of two conversations with tails, and header
names and values in several forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import add_sequence_by_key
from ..operators.replies import REPLY_HEADERS, reply_forest, reply_threads
from ..sources.mbox import parse_mbox_text
from ..sources.views import email_columns, read_table


def archives(spark: SparkSession, sf: str) -> DataFrame:
    """One small archive per turn, with id headers."""
    cid, turn = F.col("conv_id"), F.col("turn")
    own = F.when((cid % 17 == 3) & (turn == 1), F.concat(F.lit("c"), cid, F.lit(".t0"))).otherwise(F.concat(F.lit("c"), cid, F.lit(".t"), turn))
    reply = (
        F.when((cid % 19 == 4) & (turn == 2), F.concat(F.lit("gone."), cid))
        .when((turn > 0) & (turn % 2 == 0) & (cid % 3 == 0), F.lit("c0.t0"))
        .when(turn > 0, F.concat(F.lit("c"), cid, F.lit(".t"), turn - 1))
        .when(cid % 100 > 30, F.concat(F.lit("c"), cid - 1, F.lit(".t0")))
        .when(cid % 23 == 5, F.concat(F.lit("c"), cid, F.lit(".t0")))
        .when(cid % 29 == 6, F.concat(F.lit("c"), cid + 1, F.lit(".t0")))
        .when(cid % 29 == 7, F.concat(F.lit("c"), cid - 1, F.lit(".t0")))
        .when(cid % 3 == 0, F.lit("c0.t0"))
        .when(cid % 10 != 1, F.concat(F.lit("c"), cid - 1, F.lit(".t0")))
    )
    name = F.when(turn % 2 == 0, F.lit("Message-ID: <")).otherwise(F.lit("MESSAGE-Id:\t<"))
    ends = F.when(cid % 4 == 1, F.lit("> (see there)\r\n")).otherwise(F.lit(">\n"))
    line = F.when(reply.isNotNull(), F.concat(F.lit("In-Reply-To: <"), reply, ends)).otherwise(F.lit("In-reply-to: \n"))
    text = F.concat(
        F.lit("From x\nFrom: "), F.col("from_addr"), F.lit("\n"), name, own, F.lit(">\n"),
        F.when((cid % 31 == 8) & (turn == 3), F.lit("")).otherwise(line), F.lit("\nMessage-ID: <not.a.header>\n"),
    )
    conv = email_columns(read_table(spark, sf, "conversations"))
    return conv.select("conv_id", "turn", text.alias("archive"))


def _forest(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parse_mbox_text(archives(spark, sf), "archive", ["conv_id", "turn"], REPLY_HEADERS).where("kept")
    emails = add_sequence_by_key(parsed.select("conv_id", "turn", "message_id", "in_reply_to"), ["conv_id", "turn"], "msg_seq")
    return reply_forest(emails)


_LINKS = """
e AS (
  SELECT row_number() OVER (ORDER BY conv_id, turn) AS msg_seq, conv_id AS c, turn AS t FROM conversations),
ids AS (
  SELECT msg_seq, CASE WHEN c % 17 = 3 AND t = 1 THEN 'c' || c || '.t0' ELSE 'c' || c || '.t' || t END AS id,
         CASE WHEN c % 31 = 8 AND t = 3 THEN NULL
              WHEN c % 19 = 4 AND t = 2 THEN 'gone.' || c
              WHEN t > 0 AND t % 2 = 0 AND c % 3 = 0 THEN 'c0.t0'
              WHEN t > 0 THEN 'c' || c || '.t' || (t - 1)
              WHEN c % 100 > 30 THEN 'c' || (c - 1) || '.t0'
              WHEN c % 23 = 5 THEN 'c' || c || '.t0'
              WHEN c % 29 = 6 THEN 'c' || (c + 1) || '.t0'
              WHEN c % 29 = 7 THEN 'c' || (c - 1) || '.t0'
              WHEN c % 3 = 0 THEN 'c0.t0'
              WHEN c % 10 <> 1 THEN 'c' || (c - 1) || '.t0' END AS reply
  FROM e),
firsts AS (SELECT id, min(msg_seq) AS parent FROM ids GROUP BY id),
links AS MATERIALIZED (
  SELECT msg_seq, CASE WHEN f.parent <> msg_seq THEN f.parent END AS parent
  FROM ids LEFT JOIN firsts f ON f.id = ids.reply),
walk(start_seq, cur, path) AS (
  SELECT msg_seq, msg_seq, [msg_seq] FROM links
  UNION ALL
  SELECT w.start_seq, l.parent, list_append(w.path, l.parent)
  FROM walk w JOIN links l ON l.msg_seq = w.cur
  WHERE l.parent IS NOT NULL AND NOT list_contains(w.path, l.parent)),
ends AS (SELECT start_seq, arg_max(path, len(path)) AS path FROM walk GROUP BY start_seq),
roots AS (
  SELECT start_seq, path, CASE WHEN l.parent IS NULL THEN path[-1] ELSE list_min(path[list_position(path, l.parent):]) END AS root
  FROM ends JOIN links l ON l.msg_seq = path[-1]),
forest AS (
  SELECT r.start_seq AS msg_seq, CASE WHEN r.start_seq <> r.root THEN l.parent END AS parent_seq, r.root AS root_seq,
         CAST(list_position(r.path, r.root) - 1 AS BIGINT) AS depth
  FROM roots r JOIN links l ON l.msg_seq = r.start_seq)
"""


def reply_thread_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Every message's parent, root and depth."""
    return _forest(spark, sf)


REPLY_THREAD_MESSAGES_SQL = f"WITH RECURSIVE {_LINKS} SELECT msg_seq, parent_seq, root_seq, depth FROM forest"


def reply_thread_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per reply thread."""
    return reply_threads(_forest(spark, sf))


REPLY_THREAD_SIZES_SQL = f"""WITH RECURSIVE {_LINKS}
SELECT root_seq, count(*) AS n_messages, count(*) FILTER (WHERE depth = 1) AS n_replies_to_root, max(depth) AS max_depth, max(msg_seq) AS last_seq
FROM forest GROUP BY root_seq"""


QUERIES = {"reply_thread_messages": reply_thread_messages, "reply_thread_sizes": reply_thread_sizes}
ORACLE_SQL = {"reply_thread_messages": REPLY_THREAD_MESSAGES_SQL, "reply_thread_sizes": REPLY_THREAD_SIZES_SQL}
