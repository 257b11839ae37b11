"""Each stage against a plain account of its own input, and the whole run."""

import corpus_pipeline as P
from weftgraph.llm import near_dedup, quality, secrets

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_decisions(spark, docs, labels):
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    q = P.quality_stage(spark, docs, SF)
    good = {r["doc_id"] for r in quality.score_quality(docs, labels).where("predicted = 1").collect()}
    assert q.columns == docs.columns and {r["doc_id"] for r in q.collect()} == good
    n = P.near_dedup_stage(spark, docs, SF)
    assert {r["doc_id"] for r in n.collect()} == {r["doc_id"] for r in near_dedup.near_duplicates(docs, 5).where("kept").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    c = {r["doc_id"] for r in P.decontaminate_stage(spark, docs, SF).collect()}
    assert all(not any(i in r["text"] for i in items) for r in docs.collect() if r["doc_id"] in c)
    s = P.secrets_stage(spark, docs, SF)
    assert s.count() == docs.count() and secrets.scan_secrets(s).where("n_access + n_hex + n_assign > 0").count() == 0


def test_run(spark):
    out = P.run(spark, SF)
    assert out.select("doc_id").distinct().count() > 100 and out.where("length > 4096").count() == 0


def test_odd_rows_pass_all_stages(spark, odd, none):
    for df in (odd, none):
        d = df
        for _, stage in P.STAGES[:-1]:
            d = stage(spark, d, SF)
            assert d.columns == df.columns
        P.STAGES[-1][1](spark, d, SF).count()
