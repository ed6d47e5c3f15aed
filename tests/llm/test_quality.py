import random
from collections import Counter

import numpy as np
import pytest
from helpers import awkward_docs, empty_docs, rows_of, text_of
from mailspark.llm.quality_classifier import drop_rejected, held_out, score_quality, shape
from mailspark.llm.quality_rules import judge
from pyspark.sql import functions as F


def test_shapes():
    assert [shape(x) for x in (b"Hello,", b"NO!!", b"ab12$$$$", "\u00fcber".encode(), b"...")] == [b"Xx,", b"X!!", b"xd$$$", b"x", b"..."]


def labelled(spark):
    rng = random.Random(2)
    good = [(i, text_of(rng, 40)) for i in range(300)]
    bad = [(i + 300, " ".join(w.upper() + "!!" for w in text_of(rng, 40).split())) for i in range(200)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int")
    return docs, labels


def test_classifier_learns_and_holds_out(spark):
    docs, labels = labelled(spark)
    rows = score_quality(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert 100 < len(held) < 250
    assert np.mean([r["predicted"] == (r["doc_id"] < 300) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_classifier_ignores_held_out_labels_and_ids(spark):
    docs, labels = labelled(spark)
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows_of(score_quality(docs, labels), "doc_id", "score") == rows_of(score_quality(docs, turned), "doc_id", "score")


def test_classifier_on_awkward_rows(spark):
    docs = awkward_docs(spark, extra=True)
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 1), (205, 0, 0)], "doc_id long, quality int, toxic int")
    assert score_quality(docs, labels).count() == docs.count()
    kept = drop_rejected(docs, labels)
    assert kept.columns == docs.columns
    no_labels = labels.where("false")
    assert {r["score"] for r in score_quality(docs, no_labels).collect()} == {0.5}
    assert score_quality(empty_docs(spark), labels).count() == 0


SPACES = " \t\n\x0b\f\r"


def base_counts(text):
    text = text or ""
    w = [x for x in "".join(" " if c in SPACES else c for c in text).split(" ") if x]
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(win)
    covered = {i + k for i, x in enumerate(win) if times[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules_count_like_the_definition(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    texts += ["\n".join(rng.choice(["x y", "", " ", "z#*$%&|<>"]) for _ in range(8)) for _ in range(20)] + ["w " * 9, "w " * 10, None, "\u00e9 \u00e9\x0b\f\r"]
    docs = spark.createDataFrame([(i, t, None, "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    rows = judge(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, texts[r["doc_id"]]
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_rules_follow_each_source(spark):
    rng = random.Random(8)
    plain = [(i, text_of(rng, 50), "en", "plain", 1) for i in range(60)]
    marked = [(100 + i, text_of(rng, 50).replace(" ", " # "), "en", "markup", 1) for i in range(60)]
    odd = (500, text_of(rng, 50).replace(" ", " # "), "en", "plain", 1)
    docs = spark.createDataFrame([*plain, *marked, odd], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["kept"] for r in judge(docs).where("not base_failed").collect()}
    assert not kept[500] and all(v for k, v in kept.items() if k >= 100 and k < 200)  # usual in one source, odd in the other


def test_rules_run_no_python(spark):
    plan = judge(awkward_docs(spark, extra=True))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("docs", [awkward_docs, empty_docs])
def test_rules_on_awkward_rows(spark, docs):
    d = docs(spark)
    assert judge(d).count() == d.count()
