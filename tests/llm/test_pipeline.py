import os

import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def test_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = []
    for name, step in corpus_pipeline.STAGES:
        before = docs
        step(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != "bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.dtypes == before.dtypes
    assert kept[0] > kept[1] >= kept[2] == kept[3] == kept[4]
    masked = spark.read.parquet(str(tmp_path / "personal_data"))
    assert masked.where("text rlike '<(EMAIL|IP|CARD|PHONE)>'").count() > 0
    assert masked.where("n_chars <> length(text)").count() == 0


def test_edge_rows(spark, edge_docs, tmp_path):
    docs = edge_docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars", "score")
    for rows in (docs, docs.limit(0)):
        for _, step in corpus_pipeline.STAGES:
            step(spark, rows, FOLDER).count()
    rest = corpus_pipeline.near_duplicate_stage(spark, docs, FOLDER)
    assert sorted(str(r["doc_id"]) for r in rest.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 7, 8, 9, None, None]))


def test_decontamination_by_row(spark):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("text is not null").orderBy("item_id").first()["text"]
    clean = "a plain story of gardens and of the people who live near them"
    rows = [(None, item), (1, item), (2, clean), (2, item), (None, clean), (3, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    rest = corpus_pipeline.decontamination_stage(spark, docs, FOLDER)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in rest.collect()))) == sorted(map(str, [(2, clean), (None, clean), (3, None), (None, None)]))


def test_repeated_ids(spark):
    one, other = ("the quick brown fox jumps over the lazy dog again and again", "a plain story of gardens and of the people who live near them")
    third = "nothing at all like the rest is written down on this page today"
    rows = [(5, one), (5, one), (5, one), (3, other), (4, third), (4, other), (7, ""), (7, ""), (8, None), (8, None), (9, one), (None, one), (None, one)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    rest = corpus_pipeline.near_duplicate_stage(spark, docs, FOLDER)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in rest.collect()))) == sorted(map(str, [
        (5, one), (3, other), (4, third), (7, ""), (8, None), (None, one), (None, one)]))
