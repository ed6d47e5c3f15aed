"""Exports to named files (S6-S10, N5) end to end: parse -> files."""

import os

import pytest

from mailspark.sources.exports import export_messages, export_summaries, export_threads
from mailspark.sources.mbox import load_mbox
from mailspark.sources.named_files import ensure_directory, write_named_files



def message(sender, subject, date, *body):
    return "\n".join([f"From {sender} envelope", f"Date: {date}", f"Subject: {subject}", f"From: {sender}", "", *body, ""])


HARBOUR = message("nils@pier.example", "Ferry timetable", "2031-05-02", "Winter sailings begin in the second week. The night boat is gone.", "Bring gloves")
REPLY = message("oda@pier.example", "Re: Ferry timetable", "2031-05-03", "Which quay does the early boat leave from?")
LAMPS = message("pia@light.example", "Lamp oil / order?", "2031-05-04", "Forty barrels have been ordered for the tower.")


@pytest.fixture
def emails(spark, tmp_dir):
    p = os.path.join(tmp_dir, "harbour.mbox")
    with open(p, "w") as f:
        f.write(HARBOUR + REPLY + LAMPS)
    return load_mbox(spark, [p]).emails


def _read(d, name):
    with open(os.path.join(d, name)) as f:
        return f.read()


def test_write_messages(emails, tmp_dir):
    out = os.path.join(tmp_dir, "msgs", "nested")
    stats = export_messages(emails, out)
    assert stats["files"] == 3
    assert sorted(os.listdir(out)) == ["message0001.txt", "message0002.txt", "message0003.txt"]
    assert _read(out, "message0002.txt") == (
        "From: oda@pier.example\nSubject: Re: Ferry timetable\nDate: 2031-05-03\n\nWhich quay does the early boat leave from?\n"
    )


def test_export_threads(emails, tmp_dir):
    out = os.path.join(tmp_dir, "threads")
    stats = export_threads(emails, out)
    assert stats["files"] == 3  # a reply's subject is another thread
    assert sorted(os.listdir(out)) == ["export Ferry timetable.txt", "export Lamp oil _ order_.txt", "export Re_ Ferry timetable.txt"]
    text = _read(out, "export Ferry timetable.txt")
    assert text.startswith("----- Email #1 -----\nFrom: nils@pier.example\n")
    assert text.endswith("The night boat is gone.\nBring gloves\n\n\n")


def test_summaries(emails, tmp_dir):
    out = os.path.join(tmp_dir, "sum")
    export_summaries(emails, out)
    assert _read(out, "summary Ferry timetable.txt") == (
        "Subject: Ferry timetable\nThread length: 1 message(s)\n"
        "From: nils@pier.example (2031-05-02)\nTo:   nils@pier.example (2031-05-02)\n"
        "Thread began: Winter sailings begin in the second week\nThread ended: Bring gloves\n"
    )


def test_big_file_split_across_tasks_and_replace(spark, tmp_dir):
    out = os.path.join(tmp_dir, "big")
    os.makedirs(out)
    with open(os.path.join(out, "keep.txt"), "w") as f:
        f.write("untouched")
    with open(os.path.join(out, "a.txt"), "w") as f:
        f.write("old content")
    rows = [("a.txt", i, f"line {i}\n") for i in range(5000)] + [("b.txt", 0, "b\n")]
    df = spark.createDataFrame(rows, "file_name string, pos long, content string")
    stats = write_named_files(df, out, order_cols=["pos"], num_partitions=8)
    assert stats["files"] == 2 and stats["pieces"] > 2  # the big file was written by several tasks
    assert _read(out, "a.txt") == "".join(f"line {i}\n" for i in range(5000))
    assert _read(out, "keep.txt") == "untouched"
    assert sorted(os.listdir(out)) == ["a.txt", "b.txt", "keep.txt"]


def test_collision_latest_wins(spark, tmp_dir):
    out = os.path.join(tmp_dir, "coll")
    df = spark.createDataFrame([("x.txt", 1, "first"), ("x.txt", 2, "second"), ("y\n.txt", 1, "y")], "file_name string, thread_num long, content string")
    write_named_files(df, out, version_col="thread_num")
    assert _read(out, "x.txt") == "second"
    assert os.path.exists(os.path.join(out, "y\n.txt"))  # only NUL and / cannot be in a name


def test_names_that_differ_in_a_tab_are_two_files(spark, tmp_dir):
    out = os.path.join(tmp_dir, "tab")
    rows = [("a\tb.txt", 2, "tab"), ("a_b.txt", 1, "line"), ("a\x00c.txt", 3, "nul"), ("a_c.txt", 4, "later")]
    df = spark.createDataFrame(rows, "file_name string, thread_num long, content string")
    assert write_named_files(df, out, version_col="thread_num")["files"] == 3
    assert {n: _read(out, n) for n in os.listdir(out)} == {"a\tb.txt": "tab", "a_b.txt": "line", "a_c.txt": "later"}


def test_publishing_twice_does_no_harm(tmp_dir):
    import pandas as pd
    from mailspark.sources import named_files

    for n in ("p0", "p1", "p2"):
        with open(os.path.join(tmp_dir, n), "w") as f:
            f.write(n)
    whole = pd.DataFrame({"file_name": ["one.txt"], "piece": [f"{tmp_dir}/p0"], "n_pieces": [1], "n_rows": [1], "n_bytes": [2]})
    parts = pd.DataFrame(
        {"file_name": ["two.txt"] * 2, "piece": [f"{tmp_dir}/p1", f"{tmp_dir}/p2"], "offset": [0, 2], "n_rows": [1, 1], "n_bytes": [2, 2]}
    )
    os.makedirs(os.path.join(tmp_dir, named_files.PIECES_DIR, "job"))
    two = whole.assign(file_name="two.txt", piece=named_files._temporary(tmp_dir, "job", "two.txt"), n_bytes=4)
    for _ in range(2):  # a retried task runs again after the first attempt
        list(named_files._place_pieces(tmp_dir, "job")(iter([parts.iloc[::-1]])))
    for _ in range(2):
        assert list(named_files._publish_files(tmp_dir)(iter([whole, two])))[0]["file_name"].tolist() == ["one.txt"]
    assert _read(tmp_dir, "one.txt") == "p0" and _read(tmp_dir, "two.txt") == "p1p2"
    named_files._append_pieces(tmp_dir, "job")(parts.iloc[::-1])
    assert _read(tmp_dir, os.path.relpath(two["piece"].iloc[0], tmp_dir)) == "p1p2"
    with pytest.raises(FileNotFoundError):
        list(named_files._publish_files(tmp_dir)(iter([whole.assign(n_bytes=99)])))


def test_ensure_directory_refuses_file(tmp_dir):
    p = os.path.join(tmp_dir, "afile")
    with open(p, "w") as f:
        f.write("x")
    with pytest.raises(NotADirectoryError):
        ensure_directory(p)


def test_export_threads_name_collision_latest_wins(spark, tmp_dir):
    rows = [
        (1, "a", "Plan: a/b?", "2024-01-01", "first thread body\n"),
        (2, "b", "Plan_ a_b_", "2024-01-02", "second thread body\n"),
    ]
    e = spark.createDataFrame(rows, "msg_seq long, from_addr string, subject string, date string, body string")
    out = os.path.join(tmp_dir, "collide")
    stats = export_threads(e, out)
    assert os.listdir(out) == ["export Plan_ a_b_.txt"] and stats["files"] == 1
    assert "second thread body" in _read(out, "export Plan_ a_b_.txt")
    assert "first thread body" not in _read(out, "export Plan_ a_b_.txt")


def test_output_folder_as_file_uri(spark, tmp_dir):
    df = spark.createDataFrame([("m.txt", "hello")], "file_name string, content string")
    for uri in (f"file:{tmp_dir}/u1", f"file://{tmp_dir}/u2"):
        write_named_files(df, uri)
    assert _read(os.path.join(tmp_dir, "u1"), "m.txt") == "hello"
    assert _read(os.path.join(tmp_dir, "u2"), "m.txt") == "hello"


def test_many_files_per_task(spark, tmp_dir, monkeypatch):
    from mailspark.sources import named_files

    monkeypatch.setattr(named_files, "META_BATCH_ROWS", 7)  # force several metadata batches per task
    out = os.path.join(tmp_dir, "many")
    df = spark.createDataFrame([(f"m{i:03d}.txt", f"c{i}") for i in range(60)], "file_name string, content string")
    stats = write_named_files(df, out, num_partitions=2)
    assert stats["files"] == 60 and len(os.listdir(out)) == 60
    assert _read(out, "m042.txt") == "c42"


@pytest.mark.parametrize("form", ["json", "csv"])
def test_table_export_round_trip(spark, tmp_dir, form):
    from mailspark.sources.exports import export_table, read_table_export

    rows = [(1, "a\nb", None), (2, "", 'say "no", \\ twice'), (3, None, " \u00fc\t "), (4, "x\r\ny", "\\N?")]
    df = spark.createDataFrame(rows, "n long, s string, t string")
    out = os.path.join(tmp_dir, form)
    export_table(df, out, form)
    assert sorted(tuple(r) for r in read_table_export(spark, out, df.schema, form).collect()) == rows


def test_a_huge_file_is_put_together_by_many_tasks(spark, tmp_dir, monkeypatch):
    """One file with nearly all bytes: every piece is copied on its own, none holds more than twice the mean."""
    from mailspark.sources import named_files

    sizes = []
    placed = named_files._put_together

    def watch(pieces, names, out_dir, job):
        sizes.extend(r["n_bytes"] for r in pieces.where("file_name = 'big.txt'").collect())
        return placed(pieces, names, out_dir, job)

    monkeypatch.setattr(named_files, "_put_together", watch)
    out = os.path.join(tmp_dir, "huge")
    df = spark.range(60_000).selectExpr("if(id % 100 = 0, concat('s', id, '.txt'), 'big.txt') file_name", "id pos", "concat('line ', id, ' é\n') content")
    stats = write_named_files(df, out, order_cols=["pos"], num_partitions=12)
    want = [f"line {i} é\n" for i in range(60_000) if i % 100]
    assert _read(out, "big.txt") == "".join(want) and stats["files"] == 601
    assert len(sizes) > 6 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    assert stats["bytes"] == sum(os.path.getsize(os.path.join(out, n)) for n in os.listdir(out))


@pytest.mark.parametrize("stage", ["pieces", "placing"])
def test_a_failed_job_publishes_nothing(spark, tmp_dir, monkeypatch, stage):
    from mailspark.sources import named_files

    out = os.path.join(tmp_dir, "fails")
    rows = [(f"f{i % 40}.txt", i, "new ") for i in range(4000)]
    old = spark.createDataFrame([(f"f{i}.txt", "old") for i in range(40)] + [("other.txt", "kept")], "file_name string, content string")
    write_named_files(old, out)
    df = spark.createDataFrame(rows, "file_name string, pos long, content string")
    if stage == "pieces":
        df = df.selectExpr("file_name", "pos", "if(pos = 3999, raise_error('midway'), content) content")
    else:

        def broken(out_uri, job):
            def run(frames):
                for f in frames:
                    raise OSError("midway")
                yield

            return run

        monkeypatch.setattr(named_files, "_place_pieces", broken)
    with pytest.raises(Exception, match="midway"):
        write_named_files(df, out, order_cols=["pos"], num_partitions=7)
    assert {n: _read(out, n) for n in os.listdir(out)} == {**{f"f{i}.txt": "old" for i in range(40)}, "other.txt": "kept"}
