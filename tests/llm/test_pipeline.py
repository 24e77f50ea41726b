"""The pipeline's stages against what each must keep and change."""

import corpus_pipeline
from siteglass.llm import decontaminate, ngram_join, pii

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == columns, name
        seen[name] = {r[0] for r in out.select("doc_id").collect()}
        if name == "toxicity":
            clean = {r[0] for r in labels.where("toxic = 0").select("doc_id").collect()}
            assert len(clean - seen[name]) <= 0.05 * len(clean)
        if name == "ngram_join":
            assert ngram_join.join(spark, out).where("n_links > 0").count() == 0
        if name == "decontamination":
            assert decontaminate.report(spark, out, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
        if name == "pii":
            assert not any(pii.base_spans(r[0]) for r in out.select("text").collect())
        docs = out
    assert seen["byte_bpe"] == seen["pii"] <= seen["ngram_join"] <= seen["toxicity"]
