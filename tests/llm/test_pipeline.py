"""The corpus pipeline against its stages done by hand."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from sonorant.llm import pieces, queries, quality_rules, simhash

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    after = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, after[-1], SF).write.parquet(str(tmp_path / str(i)))
        after.append(spark.read.parquet(str(tmp_path / str(i))))
        assert after[-1].columns[: len(columns)] == columns
    rules, lines, near, mixed, encoded = (x.collect() for x in after[1:])
    kept = {r.doc_id for r in quality_rules.quality_rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert {r.doc_id for r in rules} == kept
    first = {r.component_id for r in simhash.simhash_components(after[2]).collect()}
    assert sorted(r.doc_id for r in near) == sorted(first) and {r.doc_id for r in lines} <= kept
    assert {r.doc_id for r in mixed} <= first and max(Counter(r.doc_id for r in mixed).values()) <= 3
    model = pieces.Pieces.read(pieces.default_model())
    assert all(model.decode(r.ids) == r.text and r.n_ids == len(r.ids) for r in encoded) and len(encoded) == len(mixed)
    assert all(r.n_chars == len(r.text) for r in lines)
    again = corpus_pipeline.run(spark, SF).select("doc_id", F.xxhash64("ids").alias("h")).collect()
    assert Counter(map(tuple, again)) == Counter((r.doc_id, r.h) for r in after[5].select("doc_id", F.xxhash64("ids").alias("h")).collect())


def test_all_ten_are_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
