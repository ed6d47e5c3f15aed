"""MBOX file reader (S1-S5, S11, P1-P12) on literal fixtures and a split round trip."""

import os

import pytest

from mailspark.functions.text import strip_non_ascii
from mailspark.sources.mbox import _java_list, load_mbox, resolve_paths
from mailspark.sources.views import email_columns, read_table

from support import SF01



def message(sender, body, subject=None, date=None):
    headers = [f"From {sender} envelope", f"From: {sender}", *([f"Subject: {subject}"] if subject else []), *([f"Date: {date}"] if date else [])]
    return "\n".join([*headers, "", body, ""])


GARDEN = message("ivo@garden.example", "The beans are up.\n", "Seed list", "2030-03-01") + message(
    "june@garden.example", "Mine drowned.", "Re: Seed list", "2030-03-04"
)
WITH_RTF = message("kit@garden.example", "Plan attached.\nContent-Type: application/rtf\n{\\rtf1 beds}\n\n--part\nSee you there.", "Plan")


def _write(d, name, content):
    p = os.path.join(d, name)
    data = content if isinstance(content, bytes) else content.encode("utf-8")
    with open(p, "wb") as f:
        f.write(data)
    return p


def _rows(load):
    return [r.asDict() for r in load.emails.orderBy("msg_seq").collect()]


def test_two_messages(spark, tmp_dir):
    rows = _rows(load_mbox(spark, [_write(tmp_dir, "a.mbox", GARDEN)]))
    assert [(r["msg_seq"], r["from_addr"], r["subject"], r["date"], r["body"]) for r in rows] == [
        (1, "ivo@garden.example", "Seed list", "2030-03-01", "The beans are up.\n\n"),
        (2, "june@garden.example", "Re: Seed list", "2030-03-04", "Mine drowned.\n"),
    ]


def test_rtf_stripped(spark, tmp_dir):
    rows = _rows(load_mbox(spark, [_write(tmp_dir, "r.mbox", WITH_RTF)]))
    assert rows[0]["body"] == "Plan attached.\n\n--part\nSee you there.\n"


def test_empty_and_missing(spark, tmp_dir):
    empty = _write(tmp_dir, "e.mbox", "")
    load = load_mbox(spark, [empty, os.path.join(tmp_dir, "missing.mbox")])
    assert load.emails.count() == 0
    assert load_mbox(spark, [os.path.join(tmp_dir, "nope.mbox")]).emails.count() == 0


def test_malformed_and_binary_dropped(spark, tmp_dir):
    bad = _write(tmp_dir, "m.mbox", "From nowhere\nColour: green\n\nno sender, no subject\n")
    binary = _write(tmp_dir, "b.mbox", "From q\nFrom: q@r.example\nSubject: Bytes\n\n\x06\x07\x0e\n")
    assert load_mbox(spark, [bad, binary]).emails.count() == 0


def test_no_body_and_sender_only(spark, tmp_dir):
    nb = _write(tmp_dir, "nb.mbox", "From x\nFrom: a@b.c\nSubject: Only headers\n\n")
    so = _write(tmp_dir, "so.mbox", "From x\nFrom: a@b.c\n\nonly body\n")
    rows = _rows(load_mbox(spark, [nb, so]))
    assert rows[0]["subject"] == "Only headers" and rows[0]["body"] == ""
    assert rows[1]["subject"] is None and rows[1]["date"] is None and rows[1]["body"] == "only body\n"


def test_hundred_messages_whitespace_kept(spark, tmp_dir):
    content = "".join(
        f"From s{i}@x Mon Jan 01 00:00:00 2024\nFrom: s{i}@x\nSubject: Parcel {i}\n\n   indented {i}\n" for i in range(100)
    )
    load = load_mbox(spark, [_write(tmp_dir, "h.mbox", content)])
    rows = _rows(load)
    assert len(rows) == 100
    assert rows[7]["subject"] == "Parcel 7" and rows[7]["body"] == "   indented 7\n"


def test_format_edge_cases(spark, tmp_dir):
    content = (
        "preamble line\r\n"
        "From one@x Mon\r\n"
        "From: one@x \r\n"
        "subject: lower ignored\r\n"
        "Subject: first\r\n"
        "Subject:\t second \r\n"
        " \r\n"
        "Date: d1\r\n"
        "\r\n"
        ">From escaped\n"
        ">>From twice\n"
        "line with NUL\x00cut here\n"
        "From two@x\n"
        "From: \n"
        "Subject: no blank line at all"
    )
    rows = _rows(load_mbox(spark, [_write(tmp_dir, "edge.mbox", content)]))
    assert len(rows) == 2
    a, b = rows
    assert a["from_addr"] == "one@x" and a["subject"] == "second" and a["date"] == "d1"
    assert a["body"] == "From escaped\n>>From twice\nline with NUL\n"
    assert b["from_addr"] == "" and b["subject"] == "no blank line at all" and b["body"] == ""


def test_invalid_utf8_line_dropped(spark, tmp_dir):
    content = b"From x\nFrom: a@b\nSubject: s\n\ngood line\nbad \xff\xfe line\nlast\n"
    rows = _rows(load_mbox(spark, [_write(tmp_dir, "u.mbox", content)]))
    assert rows[0]["body"] == "good line\nlast\n"


def test_same_file_twice_and_report(spark, tmp_dir):
    p = _write(tmp_dir, "a.mbox", GARDEN)
    load = load_mbox(spark, f" {p} ,{p}")
    rows = _rows(load)
    assert [r["msg_seq"] for r in rows] == [1, 2, 3, 4]
    assert [r["file_ordinal"] for r in rows] == [1, 1, 2, 2]
    rep = {r["file_ordinal"]: (r["n_messages"], r["n_lines"]) for r in load.report.collect()}
    assert rep == {1: (2, 13), 2: (2, 13)}


@pytest.mark.parametrize("split_bytes", [4096, 100000000])
def test_round_trip_over_splits(spark, tmp_dir, split_bytes):
    """Render conversations as mbox files, read them in many splits, compare."""
    conv = read_table(spark, SF01, "conversations")
    src = email_columns(conv).withColumn("body", strip_non_ascii("body")).orderBy("conv_id", "turn").collect()
    parts = {}
    for r in src:
        f = r["conv_id"] % 3
        hdr = f"From: {r['from_addr']}\r\n"
        if r["subject"] is not None:
            hdr += f"Subject: {r['subject']}\r\n"
        if r["date"] is not None:
            hdr += f"Date: {r['date']}\r\n"
        body = "".join((">" + l if l.startswith("From ") else l) + "\n" for l in r["body"].split("\n"))
        parts.setdefault(f, []).append(f"From {r['from_addr']} Mon Jan  1 00:00:00 2024\n{hdr}\r\n{body}")
    paths = [_write(tmp_dir, f"conv{f}.mbox", "Preamble\n" + "".join(parts[f])) for f in sorted(parts)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    try:
        load = load_mbox(spark, paths)
        got = [(r["file_ordinal"], r["from_addr"], r["subject"], r["date"], r["body"]) for r in load.emails.orderBy("msg_seq").collect()]
        n_parts = spark.read.text([f.reads for f in load.files]).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    expected = []
    for f in sorted(parts):
        for r in src:
            if r["conv_id"] % 3 == f:
                body = r["body"] + "\n"
                expected.append((f + 1, r["from_addr"], r["subject"], r["date"], body))
    assert len(got) == len(expected)
    assert got == expected
    if split_bytes == 4096:
        assert n_parts > 3


def test_append_load(spark, tmp_dir):
    from mailspark.sources.mbox import append_emails

    p = _write(tmp_dir, "a.mbox", GARDEN)
    first = load_mbox(spark, [p]).emails
    both = append_emails(first, load_mbox(spark, [p]).emails)
    rows = [(r["msg_seq"], r["from_addr"]) for r in both.orderBy("msg_seq").collect()]
    assert rows == [(i, f"{n}@garden.example") for i, n in enumerate(["ivo", "june"] * 2, 1)]


def test_file_reader_equals_text_column_parser(spark, tmp_dir):
    """The same archives parsed from files (split reader) and from a column agree."""
    from support import SF001

    from mailspark.plans.mbox import rendered_archives
    from mailspark.sources.mbox import parse_mbox_text

    arch = rendered_archives(spark, SF001).orderBy("conv_id", "turn").collect()
    paths = []
    for r in arch[:120]:
        paths.append(_write(tmp_dir, f"a{r['conv_id']:05d}_{r['turn']:03d}.mbox", r["archive"]))
    cols = ["from_addr", "subject", "date", "body"]
    files = load_mbox(spark, paths).emails.orderBy("msg_seq").select(*cols).collect()
    df = spark.createDataFrame([(r["conv_id"], r["turn"], r["archive"]) for r in arch[:120]], "conv_id long, turn long, archive string")
    col = parse_mbox_text(df, "archive", ["conv_id", "turn"]).filter("kept").orderBy("conv_id", "turn", "msg_index").select(*cols).collect()
    assert len(files) == len(col) > 50
    assert [tuple(r) for r in files] == [tuple(r) for r in col]


def test_file_names_needing_uri_encoding(spark, tmp_dir):
    """_metadata.file_path is URI-encoded; no file may be lost on the join."""
    names = ["with space.mbox", "pct%41.mbox", "hash#x.mbox", "plus+sign.mbox", "ünï.mbox"]
    paths = [_write(tmp_dir, n, f"From a\nFrom: x{i}@y\nSubject: s\n\nbody\n") for i, n in enumerate(names)]
    load = load_mbox(spark, paths)
    rows = load.emails.orderBy("msg_seq").collect()
    assert [r["from_addr"] for r in rows] == [f"x{i}@y" for i in range(len(names))]
    assert {r["file_path"].rsplit("/", 1)[-1] for r in rows} == set(names)


def test_line_count_with_bad_bytes(spark, tmp_dir):
    content = b"From x\nFrom: a@b\nSubject: s\n\n\xe0\nnext\nlast\n"
    load = load_mbox(spark, [_write(tmp_dir, "bad.mbox", content)])
    assert load.report.first()["n_lines"] == 7


def test_directory_and_glob_arguments(spark, tmp_dir):
    d = os.path.join(tmp_dir, "arch")
    os.makedirs(os.path.join(d, "sub"))
    _write(d, "b.mbox", "From b\nFrom: b@x\n\nbody b\n")
    _write(os.path.join(d, "sub"), "a.mbox", "From a\nFrom: a@x\n\nbody a\n")
    by_dir = [r["from_addr"] for r in load_mbox(spark, [d]).emails.orderBy("msg_seq").collect()]
    by_glob = [r["from_addr"] for r in load_mbox(spark, [d + "/*.mbox", d + "/sub/*.mbox"]).emails.orderBy("msg_seq").collect()]
    assert by_dir == ["b@x", "a@x"]  # files in path order: .../b.mbox < .../sub/a.mbox
    assert by_glob == ["b@x", "a@x"]


def test_names_are_taken_literally(spark, tmp_dir):
    names = ["[Gmail].mbox", "a[1].mbox", "a1.mbox", "_x.mbox", ".x.mbox", "b*.mbox", "{c}.mbox", "d e%20f.mbox"]
    paths = [_write(tmp_dir, n, message(f"s{i}@x.example", f"in {n}", n)) for i, n in enumerate(names)]
    load = load_mbox(spark, [*paths, paths[1]])
    assert [(r["msg_seq"], r["file_ordinal"], r["subject"], r["body"]) for r in _rows(load)] == [
        (i, i, n, f"in {n}\n") for i, n in enumerate([*names, names[1]], 1)
    ]
    assert [f.path.rsplit("/", 1)[1] for f in load.files] == [*names, names[1]]
    assert len(_rows(load_mbox(spark, [f"{tmp_dir}/?1.mbox"]))) == 1  # a pattern where no file has that name


def test_every_file_has_a_report_line(spark, tmp_dir):
    paths = [_write(tmp_dir, "e.mbox", ""), _write(tmp_dir, "g.mbox", GARDEN), _write(tmp_dir, "n.mbox", "no mail\n")]
    rows = load_mbox(spark, paths).report.orderBy("file_ordinal").collect()
    assert [(r["file_ordinal"], r["n_messages"], r["n_lines"]) for r in rows] == [(1, 0, 0), (2, 2, 13), (3, 0, 1)]


def test_nul_hides_undecodable_bytes(spark, tmp_dir):
    content = b"From x\nFrom: a@b\nSubject: s\n\nkeep this\x00\xff\xfe tail\nbad \xff\x00x\nlast\n"
    assert _rows(load_mbox(spark, [_write(tmp_dir, "n.mbox", content)]))[0]["body"] == "keep this\nlast\n"


def test_appending_to_a_filtered_session(spark, tmp_dir):
    from mailspark.sources.mbox import append_emails

    p = _write(tmp_dir, "a.mbox", GARDEN)
    session = load_mbox(spark, [p]).emails.where("msg_seq = 2")
    assert sorted(r["msg_seq"] for r in append_emails(session, load_mbox(spark, [p]).emails).collect()) == [2, 3, 4]


def test_load_leaves_nothing_behind(spark, tmp_dir):
    import glob

    from mailspark.session import ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/mailspark-mbox*"))
    load = load_mbox(spark, [_write(tmp_dir, "a.mbox", GARDEN)])
    assert load.emails.count() == 2
    load.close()
    assert set(glob.glob(f"{folder}/mailspark-mbox*")) == before


def test_folders_and_globs_list_odd_names(spark, tmp_dir):
    names = ["a b%20.mbox", "é#1.mbox", "x{1}[2].mbox", "sub/deep/c?.mbox", "_hidden.mbox", ".dot.mbox", "plain.txt"]
    for n in names:
        p = os.path.join(tmp_dir, n)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w", encoding="utf-8") as f:
            f.write(f"From a\nFrom: {n}\n\nbody\n")
    load = load_mbox(spark, [tmp_dir])
    senders = [r["from_addr"] for r in load.emails.orderBy("msg_seq").collect()]
    assert sorted(senders) == sorted(n for n in names if not n.startswith(("_", ".")))
    assert [f.path for f in load.files] == sorted(f.path for f in load.files)
    load.close()
    load = load_mbox(spark, f"{tmp_dir}/*.mbox, {tmp_dir}/nothing*, {tmp_dir}/_hidden.mbox")
    assert [r["from_addr"] for r in load.emails.orderBy("msg_seq").collect()] == ["a b%20.mbox", "x{1}[2].mbox", "é#1.mbox", "_hidden.mbox"]
    load.close()


def test_listing_takes_as_many_calls_for_many_files(spark, tmp_dir, monkeypatch):
    client, calls = spark._jvm._gateway_client, []
    plain = client.send_command

    def counted(command, *args, **kwargs):
        if not command.startswith("m\nd\n"):  # the garbage collector's releases come at any time
            calls.append(command)
        return plain(command, *args, **kwargs)

    spent = []
    for n in (3, 300):
        d = os.path.join(tmp_dir, f"n{n}")
        os.makedirs(d)
        for i in range(n):
            with open(os.path.join(d, f"{i:04d}.mbox"), "w") as f:
                f.write("From a\n\nx\n")
        resolve_paths(spark, [d])  # whatever is looked up once
        monkeypatch.setattr(client, "send_command", counted)
        calls.clear()
        files = resolve_paths(spark, [d])
        paths = _java_list(spark, [f.reads for f in files])
        spent.append(len(calls))
        monkeypatch.setattr(client, "send_command", plain)
        assert len(files) == n and list(paths) == [f.reads for f in files]
    assert spent[0] == spent[1]
