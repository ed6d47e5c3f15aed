"""Quality rules with thresholds that adapt to each language and source.

Everything is DataFrame expressions: no Python runs on the executors.  One pass
over the texts writes a narrow table of counts.  Mergeable KLL quantile sketches of
three ratios are built per (lang, source), partial sketches first, so a source with
a third of all rows costs one small row per task.  The fences read off the sketches
are joined back to the counts:

    upper = q75 + max(SPREADS * (q75 - q25), least)
    lower = q25 - max(SPREADS * (q75 - q25), least)      (mean word length only)

``least`` keeps a group of even documents from rejecting slight deviations.

Defined results: a null or empty text has no words and fails the base rules; null
languages and sources form groups of their own; repeated rows count as often as
they stand there; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, scratch, text_or_empty, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
#: Size of a quantile sketch: exact up to about so many documents of a group.
SKETCH_K = 4096
SPREADS = 3.0
#: ratio -> (least distance of a fence from its quartile, whether a lower fence holds too)
RATIOS = {"mean_word": (2.0, True), "symbols_per_word": (0.1, False), "dup_line_share": (0.5, False)}


def _without(c: Column, characters: str) -> Column:
    for x in characters:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    d = docs.select("doc_id", "lang", "source", text_or_empty().alias("t"))
    d = d.withColumn("w", words(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(_without(x, SPACES)) > 0)
    d = d.select(
        "doc_id",
        "lang",
        "source",
        "w",
        F.size("w").alias("n"),
        F.length(_without(F.col("t"), SPACES)).alias("word_chars"),
        (F.length("t") - F.length(_without(F.col("t"), SYMBOLS))).alias("n_symbols"),
        lines.alias("lines"),
    )
    # one hash of each window of words; hashing an array hashes its elements one after the other
    hashes = F.when(
        F.col("n") >= WINDOW, F.transform(F.sequence(F.lit(1), F.col("n") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))
    )
    d = d.withColumn("n_dup_lines", F.size("lines") - F.size(F.array_distinct("lines"))).withColumn("h", hashes)
    # (hash, place) in order of hash, only where some window comes twice
    ordered = F.when(
        F.size(F.array_distinct("h")) < F.size("h"),
        F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
    )
    d = d.select("doc_id", "lang", "source", "n", "word_chars", "n_symbols", F.size("lines").alias("n_lines"), "n_dup_lines", ordered.alias("o"))
    same = lambda e, i: F.get("o", i)["h"] == e["h"]
    twice = F.filter("o", lambda e, i: F.coalesce(same(e, i - 1), F.lit(False)) | F.coalesce(same(e, i + 1), F.lit(False)))
    d = d.withColumn("p", F.array_sort(F.transform(twice, lambda e: e["i"])))
    # a window covers WINDOW words, up to where the next one starts
    covered = F.aggregate(
        F.transform("p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("p", i + 1) - x, F.lit(WINDOW)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    longs = ("word_chars", "n_symbols", "n_lines", "n_dup_lines")
    return d.select(
        "doc_id",
        "lang",
        "source",
        F.col("n").cast("long").alias("n_words"),
        *[F.col(c).cast("long").alias(c) for c in longs],
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def ratios(c: DataFrame) -> DataFrame:
    some = F.greatest(F.col("n_words"), F.lit(1))
    return (
        c.withColumn("mean_word", F.col("word_chars") / some)
        .withColumn("symbols_per_word", F.col("n_symbols") / some)
        .withColumn("dup_line_share", F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))
    )


def fences(c: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """One row per (lang, source): a sketch of each ratio, and the fences read off it.

    Sketches of later inputs can be merged into the stored ones (``kll_sketch_merge_double``).
    """
    sketched = (
        ratios(c)
        .where("n_words > 0")
        .groupBy("lang", "source")
        .agg(*[F.kll_sketch_agg_double(r, F.lit(k)).alias(f"{r}_sketch") for r in RATIOS])
    )
    out = sketched
    for r, (least, lower) in RATIOS.items():
        q25, q75 = (F.kll_sketch_get_quantile_double(f"{r}_sketch", F.lit(p)) for p in (0.25, 0.75))
        out = out.withColumn(f"{r}_q25", q25).withColumn(f"{r}_q75", q75)
        reach = F.greatest(F.lit(SPREADS) * (F.col(f"{r}_q75") - F.col(f"{r}_q25")), F.lit(least))
        out = out.withColumn(f"{r}_max", F.col(f"{r}_q75") + reach)
        if lower:
            out = out.withColumn(f"{r}_min", F.col(f"{r}_q25") - reach)
    return out


def judge(docs: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """The counts of every document with ``base_failed`` and ``kept``."""
    c = scratch(counts(docs), "rule-counts")  # the texts are read once
    limits = [f"{r}_{end}" for r, (_, lower) in RATIOS.items() for end in (("max", "min") if lower else ("max",))]
    f = fences(c, k).select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *limits)
    joined = ratios(c).join(f, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    fits = F.lit(True)
    for limit in limits:
        r, end = limit.rsplit("_", 1)
        fits = fits & (F.col(r) <= F.col(limit) if end == "max" else F.col(r) >= F.col(limit))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(False)))
