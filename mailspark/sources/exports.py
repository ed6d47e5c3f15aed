"""The three exports of the reference as Spark jobs.

* ``export_messages``  - one ``messageNNNN.txt`` per message (R1);
* ``export_threads``   - one ``export <subject>.txt`` per thread (R2), written
  from ordered per-message pieces, never from a gathered thread string;
* ``export_summaries`` - one ``summary <subject>.txt`` per thread (R3).

Each returns the sink's counts; ``files`` is what the reference reports.

``export_table`` (E3) writes messages or threads as JSON lines or CSV with Spark's own
writers, ``read_table_export`` reads them back; text with line breaks, quotes, NULL and
empty values comes back as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.render import render_messages, render_summaries, render_thread_pieces
from ..operators.threads import STRING_ORDER
from .named_files import write_named_files


def export_messages(emails: DataFrame, out_dir: str) -> dict:
    return write_named_files(render_messages(emails), out_dir)


def export_threads(emails: DataFrame, out_dir: str, order: str = STRING_ORDER) -> dict:
    pieces = render_thread_pieces(emails, order, latest_only=True)
    return write_named_files(pieces, out_dir, content_col="piece", order_cols=["position"])


def export_summaries(emails: DataFrame, out_dir: str, order: str = STRING_ORDER) -> dict:
    return write_named_files(render_summaries(emails, order), out_dir, version_col="thread_num")


# Line breaks and quotes inside values; NULL is \\N, an empty text is "".
_CSV = {"header": "true", "quoteAll": "true", "escape": '"', "nullValue": "\\N", "emptyValue": "", "lineSep": "\n"}
_CSV |= {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def export_table(df: DataFrame, out_dir: str, form: str = "json") -> None:
    """One folder of JSON lines (``json``) or of CSV files (``csv``)."""
    if form == "json":
        df.write.option("ignoreNullFields", "false").json(out_dir)
    elif form == "csv":
        df.write.options(**_CSV).csv(out_dir)
    else:
        raise ValueError(f"unknown form {form!r}")


def read_table_export(spark: SparkSession, out_dir: str, schema: StructType, form: str = "json") -> DataFrame:
    if form == "json":
        return spark.read.schema(schema).json(out_dir)
    return spark.read.schema(schema).options(**_CSV, multiLine="true").csv(out_dir)
