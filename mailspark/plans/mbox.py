"""Registered MBOX-parse queries (P1-P11, S11) on archives rendered from
``conversations``: one small archive per turn, with the awkward cases of the
format mixed in by rule (preamble, CRLF headers, repeated and lower-case
headers, whitespace-only header line, no blank line, ``From `` line inside a
body, ``>From `` escapes, missing final newline, non-ASCII bodies).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.mbox import parse_mbox_text
from ..sources.views import email_columns, read_table
from . import sqlparts as Q


def _s(v: str) -> Column:
    return F.lit(v)


def rendered_archives(spark: SparkSession, sf: str) -> DataFrame:
    e = email_columns(read_table(spark, sf, "conversations"))
    cid, turn = F.col("conv_id"), F.col("turn")
    eol = F.when(turn % 3 == 0, _s("\r\n")).otherwise(_s("\n"))
    pre = F.when(turn % 4 == 1, _s("Archive preamble\n")).otherwise(_s(""))
    sep = F.concat(_s("From "), F.col("from_addr"), _s(" Mon Jan  1 00:00:00 2024\n"))
    hdrs = F.concat(
        _s("From: "), F.col("from_addr"), eol,
        F.when(F.col("subject").isNotNull(), F.concat(_s("Subject: "), F.col("subject"), eol)).otherwise(_s("")),
        F.when(cid % 7 == 0, F.concat(_s("Subject:  Re: "), F.coalesce(F.col("subject"), _s("x")), _s(" "), eol)).otherwise(_s("")),
        F.when(cid % 7 == 1, F.concat(_s("subject: lower ignored"), eol)).otherwise(_s("")),
        F.when(F.col("date").isNotNull(), F.concat(_s("Date:\t"), F.col("date"), eol)).otherwise(_s("")),
        F.when(cid % 11 == 0, F.concat(_s(" "), eol)).otherwise(_s("")),
    )
    body = (
        F.when(turn % 5 == 2, F.concat(F.col("body"), _s("\nFrom the desk of "), F.col("from_addr"), _s("\nSubject: injected\n\ntail line")))
        .when(turn % 5 == 3, F.concat(F.col("body"), _s("\n>From here\n>>From there")))
        .when(cid % 6 == 5, F.concat(F.col("body"), _s("\nContent-Type: application/rtf\n{rich}\n--part\nafter the part")))
        .when(cid % 6 == 4, F.concat(F.col("body"), _s("\nContent-Disposition: attachment; x\nAAAA")))
        .otherwise(F.col("body"))
    )
    final_nl = F.when(turn % 6 == 5, _s("")).otherwise(_s("\n"))
    body_part = F.when(cid % 13 == 0, _s("")).otherwise(F.concat(eol, body, final_nl))
    return e.select("conv_id", "turn", F.concat(pre, sep, hdrs, body_part).alias("archive"))


ARCHIVES_SQL = f"""
emails AS ({Q.EMAIL_VIEW}),
archives AS (
  SELECT conv_id, turn,
    (CASE WHEN turn % 4 = 1 THEN 'Archive preamble' || chr(10) ELSE '' END)
    || 'From ' || from_addr || ' Mon Jan  1 00:00:00 2024' || chr(10)
    || 'From: ' || from_addr || eol
    || CASE WHEN subject IS NOT NULL THEN 'Subject: ' || subject || eol ELSE '' END
    || CASE WHEN conv_id % 7 = 0 THEN 'Subject:  Re: ' || coalesce(subject, 'x') || ' ' || eol ELSE '' END
    || CASE WHEN conv_id % 7 = 1 THEN 'subject: lower ignored' || eol ELSE '' END
    || CASE WHEN date IS NOT NULL THEN 'Date:' || chr(9) || date || eol ELSE '' END
    || CASE WHEN conv_id % 11 = 0 THEN ' ' || eol ELSE '' END
    || CASE WHEN conv_id % 13 = 0 THEN '' ELSE eol
         || CASE WHEN turn % 5 = 2 THEN body || chr(10) || 'From the desk of ' || from_addr || chr(10) || 'Subject: injected'
                                      || chr(10) || chr(10) || 'tail line'
                 WHEN turn % 5 = 3 THEN body || chr(10) || '>From here' || chr(10) || '>>From there'
                 WHEN conv_id % 6 = 5 THEN body || chr(10) || 'Content-Type: application/rtf' || chr(10) || '{{rich}}' || chr(10) || '--part' || chr(10) || 'after the part'
                 WHEN conv_id % 6 = 4 THEN body || chr(10) || 'Content-Disposition: attachment; x' || chr(10) || 'AAAA'
                 ELSE body END
         || CASE WHEN turn % 6 = 5 THEN '' ELSE chr(10) END END AS archive
  FROM (SELECT *, CASE WHEN turn % 3 = 0 THEN chr(13) || chr(10) ELSE chr(10) END AS eol FROM emails)),
parts AS (SELECT conv_id, turn, string_split(archive, chr(10) || 'From ') AS p FROM archives),
recs AS (SELECT conv_id, turn, unnest(p) AS rec, unnest(generate_series(1, len(p))) AS msg_index, len(p) AS n FROM parts),
adj AS (
  SELECT conv_id, turn, msg_index, rec,
         CASE WHEN msg_index = n AND suffix(rec, chr(10)) THEN left(rec, length(rec) - 1) ELSE rec END AS rec2,
         NOT (msg_index = 1 AND NOT starts_with(rec, 'From ')) AS is_message
  FROM recs),
lined AS (
  SELECT *, list_transform(string_split(rec2, chr(10)), lambda l: regexp_replace(l, '\\r\\z', '')) AS lines,
         CAST(len(string_split(rec2, chr(10))) AS BIGINT) AS n_lines
  FROM adj),
restd AS (SELECT *, lines[2:] AS rest FROM lined),
blanked AS (SELECT *, coalesce(list_position(rest, ''), 0) AS blank FROM restd),
split_hb AS (
  SELECT *, CASE WHEN blank = 0 THEN rest ELSE rest[1:blank - 1] END AS hdr,
            CASE WHEN blank = 0 THEN []::VARCHAR[] ELSE rest[blank + 1:] END AS body_lines
  FROM blanked),
fields AS (
  SELECT conv_id, turn, msg_index, is_message, n_lines,
    {Q.trim_ws("substring(list_filter(hdr, lambda l: starts_with(l, 'From:'))[-1], 6)")} AS from_addr,
    {Q.trim_ws("substring(list_filter(hdr, lambda l: starts_with(l, 'Subject:'))[-1], 9)")} AS subject,
    {Q.trim_ws("substring(list_filter(hdr, lambda l: starts_with(l, 'Date:'))[-1], 6)")} AS date,
    {Q.x1("CASE WHEN len(body_lines) = 0 THEN '' ELSE array_to_string(list_transform(body_lines, lambda l: regexp_replace(l, '^>From ', 'From ')), chr(10)) || chr(10) END")} AS body
  FROM split_hb),
parsed AS (
  SELECT *, {Q.f4('body')} AS is_clear, (from_addr IS NOT NULL OR subject IS NOT NULL) AS has_header,
         is_message AND {Q.f4('body')} AND (from_addr IS NOT NULL OR subject IS NOT NULL) AS kept
  FROM fields)
"""


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return parse_mbox_text(rendered_archives(spark, sf), "archive", ["conv_id", "turn"])


def mbox_parse_text(spark: SparkSession, sf: str) -> DataFrame:
    """Kept messages of every archive."""
    return _parsed(spark, sf).filter("kept").select("conv_id", "turn", "msg_index", "from_addr", "subject", "date", "body")


MBOX_PARSE_TEXT_SQL = f"WITH {ARCHIVES_SQL} SELECT conv_id, turn, msg_index, from_addr, subject, date, body FROM parsed WHERE kept"


def mbox_keep_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Why each record is kept or dropped."""
    from ..functions.text import is_clear_text

    p = _parsed(spark, sf)
    return p.select(
        "conv_id",
        "turn",
        "msg_index",
        "is_message",
        is_clear_text("body").alias("is_clear"),
        (F.col("from_addr").isNotNull() | F.col("subject").isNotNull()).alias("has_header"),
        "kept",
    )


MBOX_KEEP_FILTER_SQL = f"WITH {ARCHIVES_SQL} SELECT conv_id, turn, msg_index, is_message, is_clear, has_header, kept FROM parsed"


def load_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per archive group (a conversation), messages kept and lines read."""
    p = _parsed(spark, sf)
    return p.groupBy("conv_id").agg(F.count_if("kept").alias("n_messages"), F.sum("n_lines").alias("n_lines"))


LOAD_REPORT_SQL = f"""WITH {ARCHIVES_SQL}
SELECT conv_id, count(*) FILTER (WHERE kept) AS n_messages, CAST(sum(n_lines) AS BIGINT) AS n_lines FROM parsed GROUP BY conv_id"""


def mbox_odd_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that are no valid UTF-8 are dropped, lines are cut at a NUL; bodies and subjects as hex."""
    turn = F.col("turn")
    raw = lambda h: F.lit(bytes.fromhex(h))
    odd = (
        F.when(turn % 4 == 0, raw("62616420ff2062797465"))  # a byte that never occurs
        .when(turn % 4 == 1, raw("6b6570740068696464656e"))  # a NUL inside
        .when(turn % 4 == 2, raw("c3a9fe6e6f0078"))  # both, after a good character
        .otherwise(raw("656e647320e282"))  # a character that is cut off
    )
    conv = read_table(spark, sf, "conversations")
    text = F.coalesce(F.replace("text", F.lit("From "), F.lit("from ")), F.lit("")).cast("binary")
    archive = F.concat(
        raw("46726f6d20780a46726f6d3a20610a5375626a6563743a20666972737400"), text, raw("0a5375626a6563743a20"), odd, raw("0a0a"),
        text, raw("0a"), odd, raw("0a6c6173740a"),
    )
    rows = conv.select("conv_id", "turn", archive.cast("string").alias("archive"))
    parsed = parse_mbox_text(rows, "archive", ["conv_id", "turn"])
    as_hex = lambda c: F.lower(F.hex(F.col(c).cast("binary"))).alias(f"{c}_hex")
    return parsed.select("conv_id", "turn", "msg_index", "kept", as_hex("subject"), as_hex("body"))


# The rule on hex digits: a line that holds ff or fe, or ends in the cut-off character, goes; the rest ends at the first 00.
MBOX_ODD_BYTES_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, lower(hex(encode(coalesce(replace(text, 'From ', 'from '), '')))) AS t,
         CASE turn % 4 WHEN 0 THEN '62616420ff2062797465' WHEN 1 THEN '6b6570740068696464656e' WHEN 2 THEN 'c3a9fe6e6f0078' ELSE '656e647320e282' END AS odd
  FROM conversations),
b AS (SELECT *, string_split(regexp_replace(t, '(..)', '\1 ', 'g'), '0a ') AS text_lines, regexp_replace(odd, '(..)', '\1 ', 'g') AS o FROM c),
l AS (
  SELECT conv_id, turn, list_concat(text_lines, [o, '6c 61 73 74 ']) AS body_lines, o, text_lines[1] AS first_line FROM b),
ruled AS (
  SELECT conv_id, turn, o, list_transform(
    list_filter(body_lines, lambda x: NOT regexp_matches(x, '(^| )f[ef] ') AND NOT suffix(x, 'e2 82 ')),
    lambda x: regexp_replace(x, '(^| )00 .*$', '\1')) AS kept_lines FROM l)
SELECT conv_id, turn, 1::BIGINT AS msg_index,
       NOT regexp_matches(array_to_string(kept_lines, ''), '(^| )([89a-f]|1[0-9a-f]|0[0-8ef])') AS kept,
       replace(CASE WHEN turn % 4 = 1 THEN '6b 65 70 74 ' ELSE '66 69 72 73 74 ' END, ' ', '') AS subject_hex,
       replace(array_to_string(list_transform(kept_lines, lambda x: x || '0a '), ''), ' ', '') AS body_hex
FROM ruled
"""


QUERIES = {
    "mbox_odd_bytes": mbox_odd_bytes,
    "mbox_parse_text": mbox_parse_text,
    "mbox_keep_filter": mbox_keep_filter,
    "load_report": load_report,
}
ORACLE_SQL = {
    "mbox_odd_bytes": MBOX_ODD_BYTES_SQL,
    "mbox_parse_text": MBOX_PARSE_TEXT_SQL,
    "mbox_keep_filter": MBOX_KEEP_FILTER_SQL,
    "load_report": LOAD_REPORT_SQL,
}
