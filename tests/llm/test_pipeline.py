from collections import Counter

import corpus_pipeline
from helpers import awkward_docs, empty_docs
from mailspark.llm.common import scratch

SF = "/root/testdata/sf0.001"


def through(spark, docs):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(scratch(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, good, lines, single, mixed, packed = through(spark, docs)
    assert all(d.columns == docs.columns for d in (good, lines, single, mixed))
    assert good.exceptAll(start).count() == 0 and single.exceptAll(lines).count() == 0
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    clean = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)
    whole = {r["doc_id"]: set(r["text"].split("\n")) for r in good.collect()}
    assert all(set(r["text"].split("\n")) <= whole[r["doc_id"]] for r in lines.collect())
    assert set(r["doc_id"] for r in mixed.collect()) <= set(r["doc_id"] for r in single.collect())
    pieces = Counter(r["doc_id"] for r in packed.where("start = 0").collect())
    assert pieces == Counter(r["doc_id"] for r in mixed.collect())


def test_run_matches_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = through(spark, docs)[-1]
    got = corpus_pipeline.run(spark, SF)
    assert got.agg({"length": "sum"}).first() == want.agg({"length": "sum"}).first()


def test_awkward_and_empty_documents(spark):
    for docs in (awkward_docs(spark, extra=True), empty_docs(spark)):
        assert all(d.columns == docs.columns for d in through(spark, docs)[:-1])
