"""Threads (A3-A9, O1, W2, W3) and summaries (R3) on literal mail rows."""


from mailspark.operators import render, threads

SCHEMA = "msg_seq long, from_addr string, subject string, date string, body string"


def _emails(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_first_sentence_skips_empty_bodies(spark):
    e = _emails(spark, [(1, "u@v.example", "Well", "2024-01-01", ""), (2, "w@v.example", "well", "2024-01-02", "The rope is twelve metres long.")])
    t = threads.thread_aggregates(e).first()
    assert t["first_sentence"] == "The rope is twelve metres long" and t["n_messages"] == 2
    assert t["subject"] == "Well"  # subject of the first sorted message, original case


def test_only_short_sentences_and_nil_body(spark):
    e = _emails(spark, [(1, "u@v.example", "Well", "2024-01-01", "Up. On. Now. Go."), (2, "t@t", None, None, None)])
    rows = {r["thread_key"]: r for r in threads.thread_aggregates(e).collect()}
    assert rows["well"]["first_sentence"] == "" and rows["well"]["last_sentence"] == ""
    assert rows[""]["last_sentence"] == "" and rows[""]["subject"] == ""


def test_last_sentence_from_last_message_with_one(spark):
    e = _emails(spark, [
        (1, "a", "S", "2024-01-01", "The cellar door was open."),
        (2, "b", "s", "2024-01-03", "Ah. So."),
        (3, "c", "S", "2024-01-02", "Somebody lit the stove again."),
    ])
    t = threads.thread_aggregates(e).first()
    assert t["first_sentence"] == "The cellar door was open"
    assert t["last_sentence"] == "Somebody lit the stove again"  # msg 2 sorts last but has none
    assert (t["from_first"], t["from_last"], t["date_last"]) == ("a", "b", "2024-01-03")


def test_null_dates_first_ties_by_seq(spark):
    e = _emails(spark, [(1, "a", "X", "2024-01-02", "b"), (2, "b", "x", None, "b"), (3, "c", "X", "2024-01-02", "b"), (4, "d", "X", None, "b")])
    pos = {r["msg_seq"]: r["position"] for r in threads.thread_positions(e).collect()}
    assert pos == {2: 1, 4: 2, 1: 3, 3: 4}


def test_thread_numbers_by_first_message(spark):
    e = _emails(spark, [(1, "a", "B", "d", "x"), (2, "a", "A", "d", "x"), (3, "a", "b", "d", "x"), (4, "a", None, "d", "x")])
    nums = {r["thread_key"]: r["thread_num"] for r in threads.threads(e).collect()}
    assert nums == {"b": 1, "a": 2, "": 3}


def test_summary_text_and_unknowns(spark):
    e = _emails(spark, [(1, None, "Roof repair", None, "Bring the long ladder and two buckets.")])
    s = render.render_summaries(e).first()
    assert s["file_name"] == "summary Roof repair.txt"
    assert s["content"] == (
        "Subject: Roof repair\nThread length: 1 message(s)\nFrom: unknown (unknown)\nTo:   unknown (unknown)\n"
        "Thread began: Bring the long ladder and two buckets\n"
    )


def test_chronological_order_differs_from_string_order(spark):
    e = _emails(spark, [(1, "a", "T", "Mon, 11 Jan 2024 10:00:00 +0000", "x"), (2, "b", "T", "Tue, 6 Jan 2024 10:00:00 +0000", "x")])
    s = {r["msg_seq"]: r["position"] for r in threads.thread_positions(e).collect()}
    c = {r["msg_seq"]: r["position"] for r in threads.thread_positions(e, threads.CHRONOLOGICAL_ORDER).collect()}
    assert s == {1: 1, 2: 2}  # "Mon, 11" < "Tue, 6" as strings
    assert c == {2: 1, 1: 2}  # 6 Jan before 11 Jan


def test_collisions_and_unique_names(spark):
    named = spark.createDataFrame([("a.txt", 1), ("a.txt", 3), ("b.txt", 2)], "file_name string, thread_num long")
    c = {r["file_name"]: (r["n_documents"], r["winner"]) for r in render.filename_collisions(named).collect()}
    assert c == {"a.txt": (2, 3), "b.txt": (1, 2)}
    u = sorted(r["file_name"] for r in render.unique_filenames(named).collect())
    assert u == ["a (1).txt", "a.txt", "b.txt"]


def test_render_pieces_concatenate_in_order(spark):
    e = _emails(spark, [(1, "a", "S", "2024-01-02", "two\n"), (2, "b", "S", "2024-01-01", "one\n")])
    pieces = render.render_thread_pieces(e).orderBy("position").collect()
    text = "".join(p["piece"] for p in pieces)
    assert pieces[0]["file_name"] == "export S.txt"
    assert text.startswith("----- Email #1 -----\nFrom: b\nSubject: S\nDate: 2024-01-01\n\none\n\n\n----- Email #2 -----")


def test_search_extras(spark):
    from mailspark.operators import search

    e = _emails(spark, [
        (1, "Alice@x.org", "Budget Q1", "Mon, 01 Jan 2024 10:00:00 +0000", "numbers attached"),
        (2, "bob@y.com", "Re: budget", "2024-02-10", "see you"),
        (3, None, None, "garbage date", None),
    ])
    assert search.search(e, "from", " ALICE ").count() == 1
    assert search.search_count(e, "subject", "budget").first()[0] == 2
    assert search.regex_search(e, "subject", r"^Re:").count() == 1
    assert e.filter(search.date_between("2024-01-01", "2024-01-31")).count() == 1
    assert e.filter(search.date_between("2024-02-01", None)).count() == 1
    assert e.filter(search.any_of(search.match("from", "bob"), search.match("count", "numbers"))).count() == 2
    assert e.filter(search.all_of(search.match("from", "bob"), search.match("count", "numbers"))).count() == 0
    assert search.total(e).first()[0] == 3
