"""Reply threads (E1): roots, depths, circles, repeated and absent ids."""

import random

from mailspark.operators.replies import REPLY_HEADERS, bare_id, reply_forest, reply_threads
from mailspark.sources.mbox import load_mbox
from support import eval_col

SCHEMA = "msg_seq long, message_id string, in_reply_to string"


def plain(rows):
    first = {}
    for seq, mid, _ in sorted(rows):
        if mid:
            first.setdefault(mid, seq)
    parent = {seq: first.get(reply) if first.get(reply) != seq else None for seq, _, reply in rows}
    for seq in sorted(parent):  # a circle is cut at its least message, which is met first
        path, at = [], seq
        while at is not None and at not in path:
            path.append(at)
            at = parent[at]
        if at is not None:
            parent[min(path[path.index(at) :])] = None
    out = []
    for seq in parent:
        at, depth = seq, 0
        while parent[at] is not None:
            at, depth = parent[at], depth + 1
        out.append((seq, parent[seq], at, depth))
    return sorted(out)


def forest(spark, rows):
    got = reply_forest(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return sorted(tuple(r) for r in got.select("msg_seq", "parent_seq", "root_seq", "depth").collect())


def test_bare_ids(spark):
    values = ["<a@b>", " <a@b> (x) <c>", "a@b ", "", "  ", "<>", None, "<a", "> x"]
    assert eval_col(spark, values, bare_id) == ["a@b", "a@b", "a@b", None, None, None, None, "a", "x"]


def test_random_replies(spark):
    rng = random.Random(4)
    for n, reach in ((60, 60), (200, 4)):
        rows = []
        for i in range(1, n + 1):
            near = rng.randint(max(1, i - reach), min(n, i + 1))
            reply = rng.choice([f"m{near}", f"m{near}", f"m{near}", None, "absent"])
            rows.append((i, rng.choice([f"m{i}", f"m{i}", f"m{i}", f"m{max(1, i - 1)}", None]), reply))
        assert forest(spark, rows) == plain(rows)


def test_deep_chain_circles_and_a_popular_root(spark):
    chain = [(i, f"m{i}", f"m{i - 1}") for i in range(1, 400)]
    circle = [(1000 + i, f"c{i}", f"c{(i + 1) % 7}") for i in range(7)] + [(1100 + i, f"d{i}", f"d{i - 1}" if i else "c3") for i in range(20)]
    popular = [(2000, "root", None)] + [(2001 + i, None, "root") for i in range(500)]
    other = [(5000, "self", "self"), (5001, "twice", None), (5002, "twice", "root"), (5003, "x", "twice"), (5004, "", ""), (5005, None, "gone")]
    rows = chain + circle + popular + other
    got = forest(spark, rows)
    assert got == plain(rows)
    assert max(r[3] for r in got) == 398 and (1000, None, 1000, 0) in got and (5003, 5001, 5001, 1) in got
    threads = reply_threads(reply_forest(spark.createDataFrame(rows, SCHEMA)))
    assert {r["root_seq"]: r["n_messages"] for r in threads.collect()}[2000] == 502


def test_no_messages(spark):
    assert forest(spark, []) == []


def test_ids_from_archives(spark, tmp_path):
    text = (
        "From a\nFrom: a@x\nMessage-ID: <1@x>\n\nhello\n\nFrom b\nFrom: b@x\nmessage-id:  <2@x>\nIN-REPLY-TO: <1@x> (hello)\n\nhi\n\n"
        "From c\nFrom: c@x\nMessage-ID: <wrong>\nMessage-ID: <3@x>\nIn-Reply-To: <2@x>\n\nMessage-ID: <not a header>\n\nFrom d\nFrom: d@x\n\nnone\n"
    )
    (tmp_path / "a.mbox").write_text(text)
    load = load_mbox(spark, str(tmp_path / "a.mbox"), REPLY_HEADERS)
    assert load.emails.columns == ["file_path", "file_ordinal", "msg_seq", "from_addr", "subject", "date", "message_id", "in_reply_to", "body"]
    rows = sorted(tuple(r) for r in reply_forest(load.emails).select("msg_seq", "parent_seq", "root_seq", "depth").collect())
    assert rows == [(1, None, 1, 0), (2, 1, 1, 1), (3, 2, 1, 2), (4, None, 4, 0)]
    empty = load_mbox(spark, [str(tmp_path / "absent.mbox")], REPLY_HEADERS).emails
    assert reply_forest(empty).count() == 0
