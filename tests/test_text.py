"""Literal expectations for F4, F5, X1, X2, X4, X6, X6b, X7, X9, X10."""

from support import eval_col
from pyspark.sql import functions as F

from mailspark.functions import text as X
from mailspark.functions.dates import parse_mail_date


def test_strict_clear_text(spark):
    vals = ["Plain words", "", "\t\n\r", "one\ntwo\tthree", "be\x01ll", "naïve", "a\x0cb", "a\x7fb", "a\x07b", None]
    assert eval_col(spark, vals, X.is_clear_text_strict) == [True, True, True, True, False, False, False, False, False, True]


def test_lenient_clear_text_accepts_ff_vt(spark):
    vals = ["Plain words", "a\x0cb", "a\x0bb", "be\x01ll", "naïve", "a\x7fb", None]
    assert eval_col(spark, vals, X.is_clear_text) == [True, True, True, False, False, False, True]


def test_strip_non_ascii(spark):
    vals = ["up ü down", "7 + 8 = 15; (fifteen)!", "tab\tnl\ncr\r", "emoji \U0001F600 cjk 中", None]
    assert eval_col(spark, vals, X.strip_non_ascii) == ["up  down", "7 + 8 = 15; (fifteen)!", "tab\tnl\ncr\r", "emoji  cjk ", None]


def test_trim(spark):
    vals = ["\n\tstone\n", "   \t\n   ", " 　x y \u0085", "none"]
    assert eval_col(spark, vals, X.trim_ws_nl) == ["stone", "", "x y", "none"]


def test_remove_attachments(spark):
    body = (
        "Normal text here.\nContent-Type: application/rtf\n{\\rtf1 some}\n--b1\nMiddle.\n"
        "content-type: APPLICATION/RTF\n{\\rtf1 two}\n--b2\nEnd."
    )
    multi = "Keep this.\nContent-Type: multipart/mixed; boundary=x\n--x\nrest"
    att = "Keep.\nCONTENT-DISPOSITION: attachment; filename=x\nDATA"
    rtf_to_end = "A\nContent-Type: application/rtf\n{\\rtf1 never closed"
    clean = "Just a clean body.\n"
    out = eval_col(spark, [body, multi, att, rtf_to_end, clean], X.remove_attachments)
    assert out[0] == "Normal text here.\n\n--b1\nMiddle.\n\n--b2\nEnd."
    assert "rtf1" not in out[0] and "Normal" in out[0]
    assert out[1] == "Keep this.\n"
    assert out[2] == "Keep.\n"
    assert out[3] == "A\n"
    assert out[4] == clean


def test_first_sentence_text_form(spark):
    vals = ["No. Nine herons stood in the shallow water. Gone.", None, "Up. On. Now. Go.", "   Padded first sentence here!  Next one is long too."]
    assert eval_col(spark, vals, X.first_sentence) == [
        "Nine herons stood in the shallow water", "", "", "Padded first sentence here"]


def test_last_sentence(spark):
    vals = ["The tide turned before noon. So. Ah.", None, "Ah. So.", "First long sentence here? And the last long one!"]
    assert eval_col(spark, vals, X.last_sentence) == ["The tide turned before noon", "", "", "And the last long one"]


def test_first_sentence_thread_form_untrimmed_length(spark):
    # untrimmed length > 8 picks the piece, the result is trimmed and may be short
    vals = ["Hi.        x. Longer sentence.", "Ah. So.", ""]
    assert eval_col(spark, vals, X.first_sentence_thread_form) == ["x", None, None]


def test_contains_ci_rules(spark):
    df = spark.createDataFrame([("Alice@Test.com",), (None,), ("bob@x",)], "f string")
    assert df.filter(X.contains_ci("f", "  ALICE \t")).count() == 1
    assert df.filter(X.contains_ci("f", "   ")).count() == 0  # empty keyword matches nothing
    assert df.filter(X.contains_ci("f", "@")).count() == 2  # NULL never matches


def test_describe_email(spark):
    df = spark.createDataFrame([("a@b", None, "d")], "from_addr string, subject string, date string")
    assert df.select(X.describe_email()).first()[0] == "<Email from:a@b subject:(none) date:d>"


def test_parse_mail_date(spark):
    vals = ["Mon, 01 Jan 2024 00:00:00 -0800", "2 Jan 2024 10:00:00 +0000 (UTC)", "2024-01-05", "garbage", None]
    out = eval_col(spark, vals, lambda c: F.date_format(parse_mail_date(c), "yyyy-MM-dd HH:mm"))
    assert out == ["2024-01-01 08:00", "2024-01-02 10:00", "2024-01-05 00:00", None, None]


def test_sentence_length_boundary(spark):
    # 8 characters is not enough, 9 is; blanks around a piece do not count
    vals = ["12345678. 123456789. x", "  12345678  ! abc", "123456789", "a.  \t 12345678 \n.b"]
    assert eval_col(spark, vals, X.first_sentence) == ["123456789", "", "123456789", ""]
    assert eval_col(spark, vals, X.last_sentence) == ["123456789", "", "123456789", ""]
    # thread form: untrimmed length > 8 decides, result trimmed
    assert eval_col(spark, vals, X.first_sentence_thread_form) == ["123456789", "12345678", "123456789", "12345678"]


def test_contains_unicode_equal(spark):
    df = spark.createDataFrame([("Caf\u00e9 Ol\u00e9",), ("Cafe\u0301 ole\u0301",), ("CAFE",), (None,)], "f string")
    assert df.filter(X.contains_ci("f", "caf\u00e9")).count() == 1  # binary: composed form only
    assert df.filter(X.contains_ci("f", "caf\u00e9", unicode_equal=True)).count() == 2  # both forms
