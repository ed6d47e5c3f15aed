"""Named text-file sink (S6-S10): one file per document, exact file names.

``df.write.text`` picks ``part-*`` names and adds line separators, so it cannot
produce ``message0001.txt`` or ``export <subject>.txt``.  This sink writes
(file_name, content) rows - or ordered pieces of one file - with two Spark
stages and no data through the driver:

1. rows are range-partitioned on (file name, order) and sorted, so a huge file
   (a thread holding a third of all mail) is cut across many tasks; each task
   streams every run of equal names into a *piece* file (``mapInArrow``, Arrow
   batches, no per-row pickling) and emits one metadata row per piece;
2. names with one piece (nearly all) are published by a rename, many in a task;
   a name whose rows lie in several tasks is put together in a temporary file:
   every piece has its byte offset there (a running sum over the name's pieces, one
   row each), and as many tasks as there are pieces copy theirs to its place, so no
   task ever writes a whole huge file; then the temporary file is renamed.  Stores
   without writes at an offset (HDFS, object stores) append the pieces in one task.

Nothing is published before all pieces are written and put together: a job that fails
until then removes what it wrote and leaves older files as they were.  Publishing can be
repeated: a piece is copied to the same place again, and one that is gone counts as
published if the final file has its size.  So a retried or speculative task does no
harm.  On a file system a rename replaces an older file at once (S10); an object store
copies.

Plain paths are resolved on Spark's default file system, as Spark's own writers do.

Files not produced by the job are never touched (no directory overwrite).
When several documents map to one name, the one with the highest ``version``
wins, as the later write would in the reference (N5).
File-system access uses ``pyarrow.fs`` (local, HDFS, S3 or GCS by URI), so the
target can be any folder every executor can reach.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import materialize
from ..session import drop_path

PIECES_DIR = "_mailspark_pieces"
META_BATCH_ROWS = 10_000  # piece-metadata rows per Arrow batch a writer task yields
# The two characters that no file name can hold.
UNSAFE_NAME_RE = r"[\x00/]"


def _fs(uri: str):
    """(file system, path) for a folder given as a plain path or a URI."""
    from urllib.parse import unquote, urlparse

    from pyarrow import fs as pafs

    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(unquote(urlparse(uri).path))
    if re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*://", uri):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), os.path.abspath(uri)


def safe_name(name: Column) -> Column:
    """File names keep every character the name functions produce but NUL and '/'.
    Applied before winners are chosen (N5), so two names never become one afterwards."""
    return F.regexp_replace(name, UNSAFE_NAME_RE, "_")


def qualified(spark: SparkSession, path: str) -> str:
    """A folder as a URI on Spark's default file system, if the path names no other."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()


def ensure_directory(uri: str) -> str:
    """Create the folder (with parents); fail if a file is in the way."""
    from pyarrow import fs as pafs

    fs, path = _fs(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        raise NotADirectoryError(f"{uri} exists but is not a directory")
    if info.type == pafs.FileType.NotFound:
        fs.create_dir(path, recursive=True)
    return path


def _piece_writer(out_uri: str, job: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        part = ctx.partitionId() if ctx else 0
        attempt = f"{part:06d}-{ctx.attemptNumber() if ctx else 0}-{uuid.uuid4().hex[:8]}"
        fs, root = _fs(out_uri)
        base = f"{root}/{PIECES_DIR}/{job}/{attempt}"
        fs.create_dir(base, recursive=True)
        meta = {"file_name": [], "piece": [], "part": [], "idx": [], "n_rows": [], "n_bytes": []}
        state = {"name": None, "stream": None, "rows": 0, "bytes": 0, "idx": -1}

        def close():
            if state["stream"] is not None:
                state["stream"].close()
                meta["file_name"].append(state["name"])
                meta["piece"].append(f"{base}/{state['idx']:08d}")
                meta["part"].append(part)
                meta["idx"].append(state["idx"])
                meta["n_rows"].append(state["rows"])
                meta["n_bytes"].append(state["bytes"])
                state["stream"] = None

        def flush():
            out = pa.RecordBatch.from_pydict(meta, schema=_PIECE_SCHEMA)
            for v in meta.values():
                v.clear()
            return out

        for batch in batches:
            names = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for name, text in zip(names, texts):
                if name != state["name"] or state["stream"] is None:
                    close()
                    if len(meta["piece"]) >= META_BATCH_ROWS:
                        yield flush()  # one file per message: keep task memory flat
                    state.update(name=name, rows=0, bytes=0, idx=state["idx"] + 1)
                    state["stream"] = fs.open_output_stream(f"{base}/{state['idx']:08d}")
                data = (text or "").encode("utf-8")
                state["stream"].write(data)
                state["rows"] += 1
                state["bytes"] += len(data)
        close()
        yield flush()

    return write


_PIECE_SCHEMA = pa.schema(
    [
        ("file_name", pa.string()),
        ("piece", pa.string()),
        ("part", pa.int32()),
        ("idx", pa.int64()),
        ("n_rows", pa.int64()),
        ("n_bytes", pa.int64()),
    ]
)
_PIECE_DDL = "file_name string, piece string, part int, idx long, n_rows long, n_bytes long"


def _publish(fs, piece: str, final: str, n_bytes: int) -> None:
    """Rename a piece to its final name; an earlier attempt may have done so."""
    from pyarrow import fs as pafs

    if fs.get_file_info(piece).type == pafs.FileType.File:
        try:
            fs.move(piece, final)
            return
        except OSError:  # another attempt may have moved it meanwhile
            if fs.get_file_info(piece).type == pafs.FileType.File:
                raise
    info = fs.get_file_info(final)
    if info.type != pafs.FileType.File or info.size != n_bytes:
        raise FileNotFoundError(f"{piece} is gone and {final} does not hold it")


def _publish_files(out_uri: str):
    """Whole files: renamed, many in a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _fs(out_uri)
        for f in frames:
            for name, piece, size in zip(f["file_name"], f["piece"], f["n_bytes"]):
                _publish(fs, piece, f"{root}/{name}", int(size))
            yield f[["file_name", "n_pieces", "n_rows", "n_bytes"]]

    return run


def _temporary(root: str, job: str, name: str) -> str:
    return f"{root}/{PIECES_DIR}/{job}/{hashlib.md5(name.encode()).hexdigest()}.whole"


def _place_pieces(out_uri: str, job: str):
    """Copy each piece of a file to its offset in the temporary file; may be done again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _fs(out_uri)
        for f in frames:
            for name, piece, offset in zip(f["file_name"], f["piece"], f["offset"]):
                # unbuffered and without truncation: other tasks write other places of the same file
                target = os.open(_temporary(root, job, name), os.O_WRONLY | os.O_CREAT, 0o644)
                try:
                    with fs.open_input_stream(piece) as src:
                        at = int(offset)
                        while chunk := src.read(1 << 22):
                            while chunk:
                                n = os.pwrite(target, chunk, at)
                                at, chunk = at + n, chunk[n:]
                finally:
                    os.close(target)
            yield f[["file_name", "n_rows", "n_bytes"]]

    return run


def _append_pieces(out_uri: str, job: str):
    """The pieces of a file one after another, on a store that cannot write at an offset."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        fs, root = _fs(out_uri)
        f = f.sort_values("offset")
        with fs.open_output_stream(_temporary(root, job, f["file_name"].iloc[0])) as out:
            for piece in f["piece"]:
                with fs.open_input_stream(piece) as src:
                    while chunk := src.read(1 << 22):
                        out.write(chunk)
        return f[["file_name", "n_rows", "n_bytes"]]

    return run


def _put_together(pieces: DataFrame, names: DataFrame, out_dir: str, job: str) -> DataFrame:
    """(file_name, n_pieces, n_rows, n_bytes, piece) of the names that lie in several pieces; piece: the temporary file."""
    spark = pieces.sparkSession
    several = pieces.join(names.where("n_pieces > 1").select("file_name"), "file_name", "left_semi")
    before = Window.partitionBy("file_name").orderBy("part", "idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = several.withColumn("offset", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)))
    placed = placed.select("file_name", "piece", "offset", "n_rows", "n_bytes")
    done = "file_name string, n_rows long, n_bytes long"
    fs, root = _fs(out_dir)
    if fs.type_name == "local":
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        copied = placed.repartition(tasks, "piece").mapInPandas(_place_pieces(out_dir, job), done)
    else:
        copied = placed.groupBy("file_name").applyInPandas(_append_pieces(out_dir, job), done)
    copied = materialize(copied, "placed")  # all pieces are in place before any file is published
    whole = F.concat(F.lit(f"{root}/{PIECES_DIR}/{job}/"), F.md5(F.col("file_name").cast("binary")), F.lit(".whole"))
    return copied.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes")
    ).withColumn("piece", whole)


def latest_versions(df: DataFrame, name_col: str, version_col: str) -> DataFrame:
    """Keep only rows of the highest version of every file name."""
    top = df.groupBy(F.col(name_col).alias("_n")).agg(F.max(version_col).alias("_v"))
    cond = (df[name_col] == top["_n"]) & (df[version_col] == top["_v"])
    return df.join(top, cond, "left_semi")


def write_named_files(
    df: DataFrame,
    out_dir: str,
    name_col: str = "file_name",
    content_col: str = "content",
    order_cols: Sequence[str | Column] = (),
    version_col: str | None = None,
    num_partitions: int | None = None,
) -> dict:
    """Write one file per distinct ``name_col``; its content is the rows'
    ``content_col`` concatenated in ``order_cols`` order.  Returns counts."""
    spark = df.sparkSession
    out_dir = qualified(spark, out_dir)
    ensure_directory(out_dir)
    df = df.withColumn(name_col, safe_name(F.col(name_col)))
    if version_col is not None:
        df = latest_versions(df, name_col, version_col)
    keys = [F.col(name_col), *[F.col(c) if isinstance(c, str) else c for c in order_cols]]
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    rows = ranged.sortWithinPartitions(*keys).select(F.col(name_col).alias("file_name"), F.col(content_col).alias("content"))
    job = uuid.uuid4().hex
    fs, root = _fs(out_dir)
    try:
        # written once: a second run would write other pieces
        pieces = materialize(rows.mapInArrow(_piece_writer(out_dir, job), _PIECE_DDL), "pieces")
        names = pieces.groupBy("file_name").agg(
            F.count(F.lit(1)).alias("n_pieces"), F.first("piece").alias("piece"), F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes")
        )
        whole = names.where("n_pieces = 1").unionByName(_put_together(pieces, names, out_dir, job))
        done = "file_name string, n_pieces long, n_rows long, n_bytes long"
        stats = whole.mapInPandas(_publish_files(out_dir), done).agg(
            F.count(F.lit(1)).alias("files"),
            F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes"),
            F.coalesce(F.sum("n_pieces"), F.lit(0)).alias("pieces"),
        ).first()
        drop_path(spark, pieces._scratch_path)
    finally:  # also after a failure: what was written goes, what was there stays
        fs.create_dir(f"{root}/{PIECES_DIR}/{job}", recursive=True)  # none if there were no rows
        fs.delete_dir(f"{root}/{PIECES_DIR}/{job}")
        _remove_if_empty(fs, f"{root}/{PIECES_DIR}")  # other jobs may still use it
    return stats.asDict()


def _remove_if_empty(fs, path: str) -> None:
    from pyarrow import fs as pafs

    try:
        if not fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            fs.delete_dir(path)
    except OSError:
        pass
