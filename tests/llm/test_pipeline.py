"""The pipeline, stage by stage, on the small tables."""

import corpus_pipeline
from pyspark.sql import functions as F

from gapscope.llm import langid, linededup, ngramjoin, packing, quality
from gapscope.llm.queries import PLANS, vocabulary

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_each_stage_is_its_operator(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", None), (9002, "12 34", None, None, 5), (None, None, None, None, None)], docs.schema)
    docs = docs.unionByName(extra)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        if k == 0:
            keep = langid.predict(F.col("text"), langid.learn(docs))
            expected = docs.withColumn("p", keep).where("p.lang_pred <> 'und' and p.score >= 0.1").drop("p")
        elif k == 1:
            expected = docs.withColumn("q", quality.judge(F.col("text"), quality.learn(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")))).where("q.kept").drop("q")
        elif k == 2:
            expected = linededup.dedup(docs).where("n_deleted = 0 or n_deleted < n_lines").withColumn("n_chars", F.expr("if(changed, length(text), n_chars)")).select(docs.columns)
        elif k == 3:
            expected = docs.join(ngramjoin.join(docs, 5, 80).where("component_id = doc_id").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
        else:
            expected = packing.pack(docs, vocabulary())
            assert out.select("doc_id").distinct().count() == docs.count() and rows(out.drop("sequence_id", "offset")) == rows(expected.drop("sequence_id", "offset"))
            continue
        assert rows(out) == rows(expected) and out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() > 50


def test_texts_that_share_a_doc_id_are_documents_of_their_own(spark):
    """Equal rows stay once; an unlike text stays beside them, even where the other one is a copy of a smaller document."""
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (1, "other words here and there"), (2, "something else that is clean too"), (None, "a b c d e f"), (None, None), (3, None), (3, None)]
    out = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER).collect()
    want = [(1, "a b c d e f"), (1, "other words here and there"), (2, "something else that is clean too"), (3, None), (None, None), (None, "a b c d e f")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in out))) == sorted(map(str, want))
    single = spark.createDataFrame([(4, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, single, FOLDER).collect()) == [2, 3]


def test_run_and_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, FOLDER).count() > 50
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0


def test_every_operator_is_registered():
    assert [f"op{n}_" for n in range(1, 14)] == sorted((k.split("_")[0] + "_" for k in PLANS), key=lambda k: int(k[2:-1]))
