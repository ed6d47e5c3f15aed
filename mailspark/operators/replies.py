"""Reply threads (E1): messages grouped by Message-ID and In-Reply-To.

* A message's parent is the message with the id that it replies to; of several with
  that id, the first (least ``msg_seq``).  A reply to an absent id, or to itself, is a
  root.  Replies in a circle: the circle's first message is a root.
* Every message gets its root and its depth by pointer doubling: each round joins a
  message with the ancestor it knows, which doubles the known distance, so a chain of a
  million replies takes twenty rounds.  Each round is written to the shared folder.
  Messages are joined, never gathered: a root with a third of all mail is a skewed join,
  which adaptive execution splits.
* A round that completes no message leaves circles and what hangs on them.  Further
  rounds there make all tails run into their circles; each circle's least message, found
  by doubling too, becomes a root, and the rest is completed like any forest.

Defined results: no or empty ids link nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_path
from .numbering import materialize

#: Header names (any case) of the two ids.
REPLY_HEADERS = {"message_id": "Message-ID:", "in_reply_to": "In-Reply-To:"}


def bare_id(value: Column | str) -> Column:
    """The first ``<...>`` of a header without its brackets, else the trimmed value; NULL if that is empty."""
    c = F.col(value) if isinstance(value, str) else value
    inner = F.regexp_extract(c, r"<([^<>]*)>", 1)
    return F.nullif(F.trim(F.when(F.length(inner) > 0, inner).otherwise(F.regexp_replace(c, "[<>]", ""))), F.lit(""))


def reply_links(emails: DataFrame) -> DataFrame:
    """(msg_seq, parent): each message and the one that it replies to (NULL if there is none)."""
    ids = emails.select("msg_seq", bare_id("message_id").alias("id"), bare_id("in_reply_to").alias("reply"))
    first = ids.where("id IS NOT NULL").groupBy("id").agg(F.min("msg_seq").alias("parent"))
    first = materialize(first, "reply-ids")  # beside an aggregate, a skewed join could not be split
    linked = ids.join(first, ids["reply"] == first["id"], "left")
    return linked.select("msg_seq", F.when(F.col("parent") != F.col("msg_seq"), F.col("parent")).alias("parent"))


def _drop(*frames: DataFrame) -> None:
    for f in frames:
        drop_path(f.sparkSession, f._scratch_path)


def _climb(links: DataFrame) -> DataFrame:
    """(msg_seq, top, steps, done): the root and its distance; not done are messages whose path ends in a circle."""
    now = materialize(
        links.select(
            "msg_seq",
            F.coalesce("parent", "msg_seq").alias("top"),
            F.col("parent").isNotNull().cast("long").alias("steps"),
            F.col("parent").isNull().alias("done"),
        ),
        "reply-climb",
    )
    left = now.where("NOT done").count()
    while left:
        above = now.select(F.col("msg_seq").alias("top"), F.col("top").alias("far"), F.col("steps").alias("more"), F.col("done").alias("end"))
        moved = now.where("NOT done").join(above, "top").select("msg_seq", F.col("far").alias("top"), F.col("steps") + F.col("more"), F.col("end"))
        after = materialize(now.where("done").union(moved), "reply-climb")
        _drop(now)
        now, before, left = after, left, after.where("NOT done").count()
        if left == before:
            break
    return now


def _circle_roots(links: DataFrame, open_: DataFrame) -> DataFrame:
    """(msg_seq): the least message of every circle among the messages that are not done."""
    jump = materialize(open_.select("msg_seq", "top"), "reply-jump")
    size = jump.select("top").distinct().count()
    while True:  # once a further jump meets no fewer messages, all that it meets lie on circles
        further = jump.select(F.col("msg_seq").alias("top"), F.col("top").alias("far"))
        after = materialize(jump.join(further, "top").select("msg_seq", F.col("far").alias("top")), "reply-jump")
        _drop(jump)
        jump, before, size = after, size, after.select("top").distinct().count()
        if size == before:
            break
    circles = jump.select(F.col("top").alias("msg_seq")).distinct()
    now = links.join(circles, "msg_seq").select("msg_seq", F.col("parent").alias("far"), F.least("msg_seq", "parent").alias("low"))
    now = materialize(now, "reply-circles")
    _drop(jump)
    while True:
        ahead = now.select(F.col("msg_seq").alias("far"), F.col("far").alias("next"), F.col("low").alias("lower"))
        after = now.join(ahead, "far").select(
            "msg_seq", F.col("next").alias("far"), F.least("low", "lower").alias("low"), (F.col("lower") < F.col("low")).alias("changed")
        )
        after = materialize(after, "reply-circles")
        _drop(now)
        changed = after.where("changed").limit(1).count()
        now = after
        if not changed:
            return after.where("low = msg_seq").select("msg_seq")


def reply_forest(emails: DataFrame) -> DataFrame:
    """(msg_seq, parent_seq, root_seq, depth) of (msg_seq, message_id, in_reply_to); roots have no parent and depth 0."""
    links = materialize(reply_links(emails), "reply-links")
    done = _climb(links)
    if done.where("NOT done").limit(1).count():
        open_ = done.where("NOT done")
        cut = _circle_roots(links, open_).withColumn("cut", F.lit(True))
        rest = links.join(open_.select("msg_seq"), "msg_seq", "left_semi").join(cut, "msg_seq", "left")
        rest = materialize(rest.select("msg_seq", F.when(F.col("cut").isNull(), F.col("parent")).alias("parent")), "reply-rest")
        links = links.join(rest.select("msg_seq"), "msg_seq", "left_anti").union(rest)
        done = done.where("done").union(_climb(rest))
    found = done.select("msg_seq", F.col("top").alias("root_seq"), F.col("steps").alias("depth"))
    return links.withColumnRenamed("parent", "parent_seq").join(found, "msg_seq")


def reply_threads(forest: DataFrame) -> DataFrame:
    """(root_seq, n_messages, n_replies_to_root, max_depth, last_seq) of every reply thread; mergeable aggregates only."""
    return forest.groupBy("root_seq").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(F.col("depth") == 1).alias("n_replies_to_root"),
        F.max("depth").alias("max_depth"),
        F.max("msg_seq").alias("last_seq"),
    )
