"""Small document tables for the tests."""

from __future__ import annotations

EDGE_TEXTS = [None, "", " ", "a", "one two\tthree\n\nfour  five", "x" * 9000, "été naïve ß İ 你好", "same text here\nagain", "same text here\nagain", "\x1c odd\x85white space \x02 end ", "word " * 3000, "<|endoftext|> it's 12.5%"]


def edge_documents(spark, texts=None):
    """Null ids and texts, empty and long texts, repeated rows and columns that clash with operators' own names."""
    texts = EDGE_TEXTS if texts is None else texts
    rows = [(k, t, "en", f"s{k % 2}", len(t or ""), "clash", 7) for k, t in enumerate(texts)]
    rows += [(3, "a", "en", "s1", 1, "clash", 7), (None, "no id", None, None, 5, None, None)] if texts is EDGE_TEXTS else []
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, size long")


def save_documents(df, folder):
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)
