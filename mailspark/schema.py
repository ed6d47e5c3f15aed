"""Fixed schemas of the engine's tables (no inference anywhere)."""

from pyspark.sql import types as T

# One parsed message. file_path / file_ordinal / msg_seq are load bookkeeping;
# the four text fields are the message itself (NULL = header never present).
EMAILS = T.StructType(
    [
        T.StructField("file_path", T.StringType(), True),
        T.StructField("file_ordinal", T.IntegerType(), True),
        T.StructField("msg_seq", T.LongType(), False),
        T.StructField("from_addr", T.StringType(), True),
        T.StructField("subject", T.StringType(), True),
        T.StructField("date", T.StringType(), True),
        T.StructField("body", T.StringType(), True),
    ]
)
