"""The stages one after the other, each judged on its own input."""

import corpus_pipeline
from conftest import SMALL

from sitefit.llm import jaccard_join, quality_rules


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, SMALL)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        rows = out.collect()
        assert {r["doc_id"] for r in rows} <= before
        docs = spark.createDataFrame(rows, out.schema)
        counts.append(len({r["doc_id"] for r in rows}))
    assert counts[0] > counts[1] > counts[2] == counts[3] > counts[4] == counts[5] > 0.5 * counts[0]


def test_run_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and sum(r["length"] for r in rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())


def test_texts_of_a_repeated_id_are_judged_apart(spark):
    one, two, three = (" ".join(f"{name}{k}" for k in range(80)) for name in ("alpha", "beta", "gamma"))
    bad = "short text"
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(3, one, "en"), (7, one, "en"), (7, two, "en"), (7, two, "en"), (8, two, "de"), (9, three, "en"), (9, bad, "en"), (None, one, "en")], schema)
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in jaccard_join.keep_first(docs).collect())
    assert kept == sorted([(3, one), (7, two), (9, three), (9, bad), (0, one)])
    good = sorted((r["doc_id"] or 0, r["text"]) for r in quality_rules.keep_good(docs, spark.createDataFrame([], "doc_id long, quality int")).collect())
    assert good == sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect() if r["text"] != bad)
