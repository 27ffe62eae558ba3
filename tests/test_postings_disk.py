"""Postings are kept compressed while an index is built."""

from pyspark.sql import functions as F

from graphloom.operators import postings


def test_a_build_checkpoints_no_rows(spark, tmp_path, monkeypatch):
    def refuse(df):
        raise AssertionError("rows as they are")

    monkeypatch.setattr(postings, "checkpointed", refuse)
    rows = spark.createDataFrame([(k, "b", f"word{k % 3} all") for k in range(9)] + [(9, None, "")], "chunk_index long, book_id string, text string")
    index = postings.SearchIndex(spark, f"{tmp_path}/index", buckets=2)
    index.build(rows, F.col("text"))
    assert sorted(r.chunk_index for r in index.search("word1").collect()) == [1, 4, 7] and index.totals() == (10, 18)
    old = rows.where("chunk_index = 4")
    index.update(old.withColumn("text", F.lit("other")), old, F.col("text"))
    assert sorted(r.chunk_index for r in index.search("word1").collect()) == [1, 7] and index.totals() == (10, 17)
