"""Sketches: exact likeness and edited texts by brute force, peeling, retries."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import lookup_sketch as L

from .helpers import edge_documents, save_documents


def jaccard(a, b):
    a, b = set(a.split("\n")), set(b.split("\n"))
    return len(a & b) / len(a | b)


def brute(docs):
    order = lambda d: L._NO_ID if d is None else d
    least = {}
    for d in docs:
        t = d.text or ""
        least[order(d.doc_id)] = min(least.get(order(d.doc_id), t), t)
    ids = sorted(least)
    following = dict(zip(ids, ids[1:] + ids[:1]))
    out = []
    for d in docs:
        t, n = d.text or "", least[following[order(d.doc_id)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        out.append((d.doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(t, edited), 9), round(jaccard(t, n), 9)))
    return sorted(out, key=str)


def check(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    rows = L.op6_lookup_sketch(spark, folder).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows), key=str) == brute(docs)
    by_text, texts = {}, {}
    for d in docs:
        texts.setdefault(d.doc_id, []).append(d.text or "")
    for r in rows:
        if len(texts[r.doc_id]) == 1:
            assert by_text.setdefault(texts[r.doc_id][0], r.fingerprint) == r.fingerprint
    return rows


def test_all(spark, sf_dir):
    rows = check(spark, sf_dir)
    assert len({len(r.fingerprint) for r in rows}) == 1


def test_edges(spark, tmp_path):
    df = edge_documents(spark).where("NOT (doc_id <=> 3 AND source = 's0')")
    check(spark, save_documents(df, tmp_path))


def test_one_document(spark, tmp_path):
    check(spark, save_documents(edge_documents(spark, ["alpha\nbeta"]), tmp_path))


def test_empty(spark, tmp_path):
    assert L.op6_lookup_sketch(spark, save_documents(edge_documents(spark).limit(0), tmp_path)).count() == 0


def test_very_different_long_documents_need_retries(spark, tmp_path):
    texts = ["\n".join(f"line {k} of {d}" for k in range(n)) for d, n in enumerate((3, 40, 700, 2500, 2500))]
    check(spark, save_documents(edge_documents(spark, texts), tmp_path))


@pytest.mark.parametrize("n", [0, 1, 5, 10])
def test_peeling_recovers_the_digests(spark, n):
    rng = random.Random(n)
    shared, only_a, only_b = ([rng.getrandbits(63) for _ in range(k)] for k in (200, n // 2, n - n // 2))
    df = spark.createDataFrame([(shared + only_a, shared + only_b)], "a array<long>, b array<long>")
    got = df.select(F.expr(L.peel(L.subtract(L.sketch("a"), L.sketch("b")))).alias("got")).first().got
    assert (sorted(got["first"]), sorted(got["second"])) == (sorted(only_a), sorted(only_b))


def test_edited_texts_make_no_sketches(spark, monkeypatch):
    from graphloom.llm import queries as Q

    d = "/root/testdata/sf0.001"
    key = lambda df: sorted(map(tuple, df.select("doc_id", "n_chars", "edited_sha256").collect()))
    wanted = key(L.op6_lookup_sketch(spark, d))
    monkeypatch.setattr(L, "sketch", None)
    assert key(Q.edited_texts(spark, d)) == wanted
