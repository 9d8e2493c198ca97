"""The pipeline, stage by stage, against brute force."""

from collections import Counter

import corpus_pipeline
from tallyframe.llm import decontaminate, mixture, ngram_join, toxicity


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf_dir).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        ids, kept = [r.doc_id for r in before.collect()], [r.doc_id for r in after.collect()]
        if i < 4:
            assert after.columns == docs.columns
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in toxicity.score(before, toxicity.fit(before, labels)).collect()}
            assert sorted(kept) == sorted(d for d in ids if not scores[d])
        elif name == "ngram_jaccard_join":
            assert sorted(kept) == sorted(r.doc_id for r in ngram_join.jaccard_components(before).collect() if r.doc_id == r.component_id)
        elif name == "decontamination":
            assert sorted(kept) == sorted(set(ids) - {r.doc_id for r in decontaminate.contaminated(before, bench).collect()})
        elif name == "mixture":
            assert Counter(kept) == {r.doc_id: r.taken // r.size for r in mixture.taken_words(before).collect() if r.taken}
        else:
            assert Counter(kept) == Counter(ids) and after.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        before = after


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 0 and corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
