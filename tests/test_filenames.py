"""Literal expectations for N1-N4."""

from support import eval_col

from mailspark.functions import filenames as N


def test_message_filename(spark):
    assert eval_col(spark, [1, 42, 9999, 0, 100000], N.message_filename, "long") == [
        "message0001.txt", "message0042.txt", "message9999.txt", "message0000.txt", "message100000.txt"]


def _export(spark, subject, num):
    df = spark.createDataFrame([(subject, num)], "s string, n long")
    return df.select(N.export_filename("s", "n"), N.summary_filename("s", "n")).first()


def test_export_filename(spark):
    assert _export(spark, "Night shift", 1)[0] == "export Night shift.txt"
    assert _export(spark, "", 5)[0] == "export thread0005.txt"
    assert _export(spark, None, 42)[0] == "export thread0042.txt"
    assert _export(spark, "éé", 7)[0] == "export thread0007.txt"  # strips to nothing
    assert _export(spark, "Night shift", 1)[1] == "summary Night shift.txt"


def test_export_filename_length(spark):
    long_name = _export(spark, "Q" * 10000, 1)[0]
    assert len(long_name) <= 60 and long_name == "export " + "Q" * 48 + ".txt"


def test_sanitize(spark):
    out = eval_col(spark, ["/\\:?%*|\"<>'", "../up/../two", "low_line", "hy-phen"], N.sanitize_for_filename)
    assert out[0] == "_" * 11
    assert "/" not in out[1] and out[1] == ".._up_.._two"
    assert out[2:] == ["low_line", "hy-phen"]
