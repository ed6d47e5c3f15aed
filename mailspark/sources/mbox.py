"""MBOX source (S1-S5, S11) and the parse stages P1-P12.

Reading
-------
``spark.read.option("lineSep", "\\nFrom ").text(files)`` lets the JVM text reader
split every archive into *records* at each line that starts with ``From ``
(P1), and split big files across tasks at byte offsets.  Each record is one
message candidate: its first line is the rest of the separator line.  Only two
records need their position in the file:

* the first record of a file is a preamble (P2) unless it starts with ``From ``;
* the last record still carries the file's final newline, which the others lost
  to the separator.

The archives are read once: every record is parsed without its position
(``parse_raw``) and written to the shared checkpoint folder with the facts the two
rules need and its scan position ``(file, _metadata.file_block_start,
monotonically_increasing_id())``.  An aggregate with one row per file then finds
each file's first and last record, and ``finalize`` applies the rules, the body
clean-up and the keep test.

Parsing is a pure Catalyst projection over the record (header picks, body
split, clean-up, clear-text test); no Python touches a row.

Numbering (W1/P12)
------------------
``msg_seq`` is the message's 1-based place in the session: file argument order,
then file order.  Kept messages are written once in scan order with a running
number per task; one row per (file, split) turns those into places.  No body is
shuffled or sorted.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import is_clear_text, remove_attachments, trim_ws
from ..operators.numbering import materialize
from ..session import drop_path, scratch_path

log = logging.getLogger(__name__)

# Fixed values of the format.
SEPARATOR = "\nFrom "
SEPARATOR_PREFIX = "From "
HEADER_PREFIXES = {"from_addr": "From:", "subject": "Subject:", "date": "Date:"}
ESCAPED_FROM_RE = r"\A>From "

# Files of one load: the driver lists them, and one row for each is broadcast.
# More raise; load them in several calls (numbers go on with append_emails) or as a stream.
MAX_FILES = 1_000_000
# Offsets (one row per split and file argument) are broadcast up to this exact count, else joined.
MAX_BROADCAST_SPLITS = 1_000_000


# ----------------------------------------------------------------- record parse
def _clean_lines_text(t: Column, odd: Column | None = None) -> Column:
    """P3/P4/P5 on the whole record text with regexes (no line arrays, so the
    parse stays in whole-stage codegen).

    P5 cuts each line at its first NUL; what follows it is never decoded.  P4:
    when the record holds undecodable bytes, ``make_valid_utf8`` turns them into
    U+FFFD and every line that still contains one is removed with its line break
    (a bad last line takes the break before it).  P3 strips one CR before each
    line end.  ``odd`` says which records come from a text whose undecodable bytes
    were made U+FFFD before it was cut (:func:`_decodable`).
    """
    mv = F.regexp_replace(F.make_valid_utf8(t), r"\x00[^\n]*", "")
    # Anchored at line starts and possessive, so each line is scanned once.
    bad_line = r"[^\n\x{FFFD}]*+\x{FFFD}[^\n]*+"
    dropped = F.regexp_replace(
        F.regexp_replace(mv, r"(?<![^\n])" + bad_line + r"\n", ""), r"(?:\n|\A)" + bad_line + r"\z", ""
    )
    valid = F.is_valid_utf8(t)
    if odd is not None:
        valid, dropped = ~odd, F.replace(dropped, F.lit(_STAND_IN), F.lit("\ufffd"))
    text = F.when(valid, F.regexp_replace(t, r"\x00[^\n]*", "")).otherwise(dropped)
    return F.regexp_replace(text, r"\r(?=\n|\z)", "")


#: Stands for a U+FFFD of the text itself while undecodable bytes are marked by that character; no text may hold it.
_STAND_IN = "\uffff"


def _decodable(t: Column) -> Column:
    """The text with undecodable bytes as U+FFFD, and its own U+FFFD kept apart: functions that cut
    a text would lose the difference."""
    return F.when(F.is_valid_utf8(t), t).otherwise(F.make_valid_utf8(F.replace(t, F.lit("\ufffd"), F.lit(_STAND_IN))))


def _n_lines(t: Column) -> Column:
    """Lines of the text (LF count + 1), before any line is dropped."""
    # Newlines = length lost by removing them (character counts are exact for
    # valid UTF-8); a record with undecodable bytes counts its split pieces.
    by_length = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    return F.when(F.is_valid_utf8(t), by_length).otherwise(F.size(F.split(t, "\n", -1))).cast("long")


def _header(block: Column, prefix: str) -> Column:
    """Value of the last header line starting with ``prefix`` (trimmed);
    NULL when there is none.  ``block`` is the header lines, each preceded by LF."""
    key = "\n" + prefix
    last = F.regexp_extract(block, r"(?s).*\n" + prefix + r"([^\n]*)", 1)
    return F.when(F.locate(key, block) > 0, trim_ws(last))


def _header_any_case(block: Column, name: str) -> Column:
    """As :func:`_header`, for a further header whose name is written in any case."""
    last = F.regexp_extract(block, r"(?si).*\n" + re.escape(name) + r"([^\n]*)", 1)
    return F.when(F.locate("\n" + name.lower(), F.lower(block)) > 0, trim_ws(last))


def parse_raw(
    records: DataFrame, rec_col: str, headers: dict[str, str] | None = None, odd_col: str | None = None
) -> DataFrame:
    """P1, P3-P9 on each record without knowing its place in the file; ``headers`` are further
    columns and the header names that they hold (E1).

    Adds from_addr, subject, date, the body before clean-up (``_body_raw``,
    parsed as if the record were not the file's last), ``_has_body``,
    ``_starts_from`` (the record begins with a separator line), ``_ends_nl``
    and ``_n_lines_raw``; :func:`finalize` applies the first/last-record rules.

    All string expressions (codegen), no per-line arrays: the separator line is
    cut at the first LF; with ``s`` = LF + the remaining lines, the first empty
    line is the first LF followed by LF or the end (P7); headers are before it,
    the body lines after it.
    """
    rec = F.col(rec_col)
    df = records.withColumn("_t", _clean_lines_text(rec, F.col(odd_col) if odd_col else None))
    nl = F.locate("\n", F.col("_t"))
    s = F.when(nl > 0, F.concat(F.lit("\n"), F.substr(F.col("_t"), nl + 1))).otherwise(F.lit(""))  # drop separator line
    df = df.withColumn("_s", s)
    df = df.withColumn("_blank", F.regexp_instr(F.col("_s"), F.lit(r"\n(?=\n|\z)")))  # P7, 0 = none
    blank, sc = F.col("_blank"), F.col("_s")
    hdr = F.when(blank == 0, sc).otherwise(F.substr(sc, F.lit(1), blank - 1))
    has_body = (blank > 0) & (blank < F.length(sc))
    unescaped = F.regexp_replace(F.substr(sc, blank + 2), r"(\A|\n)>From ", "$1From ")  # P9
    body = F.when(has_body, F.concat(unescaped, F.lit("\n"))).otherwise(F.lit(""))  # P8
    df = df.withColumn("_hdr", hdr)
    fields = [_header(F.col("_hdr"), p).alias(name) for name, p in HEADER_PREFIXES.items()]
    fields += [_header_any_case(F.col("_hdr"), h).alias(name) for name, h in (headers or {}).items()]
    return df.select(
        *records.columns,
        *fields,
        body.alias("_body_raw"),
        has_body.alias("_has_body"),
        rec.startswith(SEPARATOR_PREFIX).alias("_starts_from"),
        rec.endswith("\n").alias("_ends_nl"),
        _n_lines(rec).alias("_n_lines_raw"),
    )


def finalize(parsed: DataFrame, first: Column, last: Column) -> DataFrame:
    """Apply the rules that depend on a record's place in its file, then P10
    and P11.

    * first record: a preamble unless it starts with a separator (P2);
    * last record: it still holds the file's final newline, which the others
      lost to the separator - so its body (when it has one) loses one trailing
      LF and its line count one line.
    """
    fix = last & F.col("_ends_nl")
    raw = F.col("_body_raw")
    body_raw = F.when(fix & F.col("_has_body"), raw.substr(F.lit(1), F.length(raw) - 1)).otherwise(raw)
    is_message = ~(first & ~F.col("_starts_from"))  # P2
    df = parsed.select(
        "*",
        remove_attachments(body_raw).alias("body"),  # P10
        is_message.alias("is_message"),
        (F.col("_n_lines_raw") - F.when(fix, F.lit(1)).otherwise(F.lit(0))).cast("long").alias("n_lines"),
    )
    kept = F.col("is_message") & is_clear_text("body") & (F.col("from_addr").isNotNull() | F.col("subject").isNotNull())  # P11
    # Optimizer barrier: without it a later ``filter("kept")`` is pushed below
    # this projection and Catalyst substitutes every intermediate column into
    # the condition (the record text would be cleaned dozens of times and the
    # generated code outgrow the JIT limit).  An always-true nondeterministic
    # term keeps filters on the computed columns.
    kept = kept & (F.spark_partition_id() >= 0)
    internal = {"_body_raw", "_has_body", "_starts_from", "_ends_nl", "_n_lines_raw"}
    return df.select(*[c for c in df.columns if c not in internal], kept.alias("kept"))


def parse_records(
    records: DataFrame,
    rec_col: str,
    first_col: str,
    last_col: str,
    headers: dict[str, str] | None = None,
    odd_col: str | None = None,
) -> DataFrame:
    """P1-P11 on records whose first/last flags are known: adds from_addr,
    subject, date, body, is_message (not a preamble), n_lines (S11), kept."""
    parsed = parse_raw(records, rec_col, headers, odd_col)
    out = finalize(parsed, F.col(first_col), F.col(last_col))
    keep = [c for c in records.columns] + ["from_addr", "subject", "date", *(headers or {}), "body", "is_message", "kept", "n_lines"]
    return out.select(*keep)


# ------------------------------------------------------------ text-column form
def parse_mbox_text(df: DataFrame, text_col: str, id_cols: list[str], headers: dict[str, str] | None = None) -> DataFrame:
    """Parse archives held one per row in ``text_col`` (S1 on a column).

    Each archive is split at separators and exploded (bounded by the row's own
    size); ``msg_index`` is the 1-based record number inside the archive.
    """
    text = F.col(text_col)
    odd = F.coalesce(~F.is_valid_utf8(text), F.lit(False)).alias("_odd")
    parts = df.select(*id_cols, odd, F.split(_decodable(text), SEPARATOR, -1).alias("_parts"))
    recs = parts.select(
        *id_cols,
        "_odd",
        F.posexplode("_parts").alias("_pos", "_rec"),
        F.size("_parts").alias("_n"),
    ).select(
        *id_cols,
        "_odd",
        (F.col("_pos") + 1).cast("long").alias("msg_index"),
        "_rec",
        (F.col("_pos") == 0).alias("_first"),
        (F.col("_pos") == F.col("_n") - 1).alias("_last"),
    )
    parsed = parse_records(recs, "_rec", "_first", "_last", headers, "_odd")
    return parsed.drop("_rec", "_first", "_last", "_odd")


# ------------------------------------------------------------------- file form
@dataclass(frozen=True)
class MboxFile:
    """One file of a load."""

    ordinal: int  # 1-based place among the arguments' files
    path: str  # as given or listed
    reads: str  # what the reader opens (a copy, for names that Spark skips)
    uri: str  # ``reads`` as ``_metadata.file_path`` reports it
    size: int


@dataclass
class MboxLoad:
    """Result of :func:`load_mbox`."""

    emails: DataFrame  # kept messages, numbered (schema.EMAILS)
    report: DataFrame  # S11: per file argument, messages kept and lines read
    files: list[MboxFile]
    _scratch: tuple[str, ...] = ()
    n_messages: int = 0  # of all files

    def close(self) -> None:
        """Delete the written messages; ``emails`` cannot be read any more."""
        for path in self._scratch:
            drop_path(self.emails.sparkSession, path)


def resolve_paths(spark: SparkSession, paths) -> list[MboxFile]:
    """Trim each argument, keep the ones that exist (warn otherwise).

    ``paths`` is a list or a comma-separated string.  An argument is first taken
    literally, whatever characters its name holds; only if nothing has that name is
    it a glob.  Directories expand to their files in name order, without hidden ones (names
    that start with ``.`` or ``_``, as Spark's readers leave them out).  A hidden file that
    is named itself is read from a copy.  The same file given twice is kept twice (S3:
    loading an archive again appends duplicates).
    """
    if isinstance(paths, str):
        paths = paths.split(",")
    out: list[MboxFile] = []
    copies: dict[str, tuple[str, str]] = {}
    for raw in paths:
        p = raw.strip(" \t\r\n")
        if not p:
            continue
        found = _listed(spark, p)
        if not found:
            log.warning("File not found: %s", p)
        for path, size, uri in found:
            reads = path
            if path.rsplit("/", 1)[-1].startswith((".", "_")):
                if path not in copies:
                    copies[path] = _visible_copy(spark, path)
                reads, uri = copies[path]
            out.append(MboxFile(len(out) + 1, path, reads, _canonical_uri(uri), size))
            if len(out) > MAX_FILES:
                raise ValueError(f"more than {MAX_FILES} files in one load")
    return out


def _listed(spark: SparkSession, p: str) -> list[tuple[str, int, str]]:
    """(path, size, uri) of the files of one argument, in name order.

    A folder's or glob's files are listed by Spark's file index and come as the rows of one scan that
    opens none of them, so the driver makes the same few calls however many they are.
    """
    hp = spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = hp.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hp):
        status = fs.getFileStatus(hp)
        if not status.isDirectory():
            path = status.getPath()
            return [(path.toString(), int(status.getLen()), path.toUri().toString())]
        pattern = escape_glob(p)
    elif len(fs.globStatus(hp) or []):
        pattern = p
    else:
        return []
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern)
    return sorted((r["path"], r["length"], r["uri"]) for r in files.select("path", "length", F.col("_metadata.file_path").alias("uri")).collect())


def _java_list(spark: SparkSession, values: list[str]):
    """The values as a Java list, handed over in two calls (none of them holds a NUL)."""
    jvm = spark._jvm
    return jvm.java.util.Collections.list(jvm.java.util.StringTokenizer("\0".join(values), "\0"))


def _visible_copy(spark: SparkSession, named: str) -> tuple[str, str]:
    """(path, uri) of a copy under a name that Spark's readers do not skip."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(named)
    copy = jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "visible-mbox"))
    copied = jvm.org.apache.hadoop.fs.FileUtil.copy(path.getFileSystem(conf), path, copy.getFileSystem(conf), copy, False, conf)
    if not copied:
        raise OSError(f"cannot copy {named}")
    copy = copy.getFileSystem(conf).getFileStatus(copy).getPath()
    return copy.toString(), copy.toUri().toString()


def escape_glob(path: str) -> str:
    """The path as a pattern that matches itself only."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


# Listing and scan render an empty authority differently ("file:///x" vs
# "file:/x"); both are otherwise the same percent-encoded java.net.URI text.
_EMPTY_AUTHORITY_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):///"


def _canonical_uri(uri: str) -> str:
    return re.sub(_EMPTY_AUTHORITY_RE, r"\1:/", uri)


def _canonical_uri_col(col: Column) -> Column:
    return F.regexp_replace(col, _EMPTY_AUTHORITY_RE, "$1:/")


def read_raw_records(reader, paths) -> DataFrame:
    """Records with their scan position: (rec, file_uri, block, rid).

    ``reader`` is ``spark.read`` or ``spark.readStream`` (then ``paths`` is a folder).
    """
    src = reader.option("lineSep", SEPARATOR).text(paths)
    return src.select(
        F.col("value").alias("rec"),
        _canonical_uri_col(F.col("_metadata.file_path")).alias("file_uri"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("rid"),
    )


def parsed_records(raw: DataFrame, headers: dict[str, str] | None = None) -> DataFrame:
    """The records, parsed and written once (``raw`` straight from the scan, with its further columns)."""
    return materialize(parse_raw(raw, "rec", headers).drop("rec"), "mbox-records")


def load_records(parsed: DataFrame, files: list[MboxFile], start: int = 0, headers: dict[str, str] | None = None) -> MboxLoad:
    """Finalize and number the records of ``files`` as :func:`parsed_records` wrote them, which go then."""
    spark = parsed.sparkSession
    pos = F.struct("block", "rid")
    bounds = parsed.groupBy("file_uri").agg(F.min(pos).alias("_first"), F.max(pos).alias("_last"))
    # one row per file of the list that the driver holds (MAX_FILES at most): the join moves no record
    flagged = parsed.join(F.broadcast(bounds), "file_uri")
    records = finalize(flagged, F.struct("block", "rid") == F.col("_first"), F.struct("block", "rid") == F.col("_last"))
    fields = ["from_addr", "subject", "date", *(headers or {}), "body"]
    kept = records.filter("kept").select("file_uri", "block", "rid", *fields)
    kept = materialize(kept.withColumn("_mid", F.monotonically_increasing_id()), "mbox-kept")
    part = F.shiftright("_mid", 33)
    segments = kept.groupBy("file_uri", "block", part.alias("_part")).agg(
        F.min("rid").alias("_rid"), F.min("_mid").alias("_lo"), F.count(F.lit(1)).alias("_n")
    )
    lines = {r["file_uri"]: r["n"] for r in records.groupBy("file_uri").agg(F.sum("n_lines").alias("n")).collect()}
    counted = segments.groupBy("file_uri").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_segments")).collect()
    messages, n_segments = ({r["file_uri"]: r[c] for r in counted} for c in ("n", "n_segments"))
    unread = {f.uri for f in files if f.size} ^ set(lines)
    if unread:
        raise OSError(f"files listed and files read differ: {sorted(unread)[:5]}")
    drop_path(spark, parsed._scratch_path)
    report = spark.createDataFrame(
        [(f.ordinal, f.path, messages.get(f.uri, 0), lines.get(f.uri, 0)) for f in files],
        "file_ordinal int, file_path string, n_messages long, n_lines long",
    )
    # two levels: messages of the files before (from the report, a row per file), then of a file's earlier splits
    counts = [messages.get(f.uri, 0) for f in files]
    before = [start + n for n in accumulate(counts, initial=0)][:-1]
    ordinals = spark.createDataFrame(
        [(f.ordinal, f.path, f.uri, n) for f, n in zip(files, before)], "file_ordinal int, file_path string, file_uri string, _before long"
    )
    of_argument = segments.join(F.broadcast(ordinals), "file_uri")
    earlier = Window.partitionBy("file_ordinal").orderBy("block", "_rid").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.col("_before") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_lo") + 1
    offsets = materialize(
        of_argument.select("file_uri", "block", "_part", "file_ordinal", "file_path", shift.alias("_shift")), "mbox-offsets"
    )
    n_offsets = sum(n_segments.get(f.uri, 0) for f in files)
    small = F.broadcast if n_offsets <= MAX_BROADCAST_SPLITS else (lambda df: df)
    numbered = kept.withColumn("_part", part).join(small(offsets), ["file_uri", "block", "_part"])
    emails = numbered.select(
        "file_path", "file_ordinal", (F.col("_shift") + F.col("_mid")).cast("long").alias("msg_seq"), *fields
    )
    return MboxLoad(emails, report, files, (kept._scratch_path, offsets._scratch_path), sum(counts))


def load_mbox(spark: SparkSession, paths, headers: dict[str, str] | None = None) -> MboxLoad:
    """Read MBOX files into numbered emails; ``headers`` are further columns, such as those of reply threads.

    The archives are read once; parsed and kept messages are written to the cluster's
    checkpoint folder (``close`` deletes them), so a lost executor never forces a
    re-parse.  Every listed file that is not empty must have been read, or this raises.
    """
    files = resolve_paths(spark, paths)
    if not files:
        report = spark.createDataFrame([], "file_ordinal int, file_path string, n_messages long, n_lines long")
        none = spark.createDataFrame([], schema.EMAILS)
        return MboxLoad(none.withColumns({h: F.lit(None).cast("string") for h in headers or {}}), report, files)
    raw = read_raw_records(spark.read, _java_list(spark, sorted({escape_glob(f.reads) for f in files})))
    return load_records(parsed_records(raw, headers), files, headers=headers)


def append_emails(session: DataFrame, loaded: DataFrame) -> DataFrame:
    """Add a newly loaded batch of emails after the session's messages
    (UNION ALL, duplicates kept); the new messages are numbered after the highest
    number in the session.  Only that number reaches the driver."""
    last = session.agg(F.max("msg_seq").alias("n")).first()["n"] or 0
    shifted = loaded.withColumn("msg_seq", F.col("msg_seq") + F.lit(last))
    return session.unionByName(shifted)
