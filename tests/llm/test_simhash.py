"""SimHash groups against all pairs compared."""

import random

import numpy as np
import xxhash

from graphloom.llm import simhash
from graphloom.llm.components import components

from .helpers import edge_documents, save_documents


def slow_fingerprint(text, n=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [slow_fingerprint(r.text) for r in rows]
    distinct = sorted(set(fps))
    x, root = np.array(distinct, dtype=np.uint64), {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(x[k + 1 :] ^ x[k]) <= 3):
            root[find(distinct[k + 1 + j])] = find(f)
    low = {}
    for r, f in zip(rows, fps):
        if r.doc_id is not None:
            low[find(f)] = min(low.get(find(f), r.doc_id), r.doc_id)
    return sorted(((r.doc_id, f"{f:016x}", low.get(find(f))) for r, f in zip(rows, fps)), key=str)


def check(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert sorted((tuple(r) for r in simhash.op8_simhash(spark, folder).collect()), key=str) == brute(rows)


def test_all(spark, sf_dir):
    check(spark, sf_dir)


def test_edges(spark, tmp_path):
    check(spark, save_documents(edge_documents(spark), tmp_path))


def test_empty(spark, tmp_path):
    check(spark, save_documents(edge_documents(spark).limit(0), tmp_path))


def test_links_at_every_distance(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) - (1 << 63) for _ in range(60)}
    for f in list(fps):
        for d in (1, 2, 3, 4):
            x = f
            for k in rng.sample(range(64), d):
                x ^= 1 << k if k < 63 else -(1 << 63)
            fps.add(x)
    got = {tuple(r) for r in simhash.linked(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 141)} | {k: 7 for k in [7, *range(200, 260)]}
