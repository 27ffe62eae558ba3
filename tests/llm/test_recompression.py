"""Removed words against every window compared, and what the method promises."""

import hashlib
import random
import re

import numpy as np
import pytest

from graphloom.llm import recompression as r

from .helpers import edge_documents, save_documents


def brute(docs, window=50):
    order = lambda d: (1 << 63) - 1 if d is None else d
    words = [(d.doc_id, re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs]
    least = {}
    for d, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, order(d)), order(d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < order(d):
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = sorted((tuple(x) for x in r.op3_recompression(spark, folder).collect()), key=str)
    assert got == brute(docs)
    return got


def test_all(spark, sf_dir):
    assert sum(x[2] for x in check(spark, sf_dir)) > 1000


def test_edges(spark, tmp_path):
    check(spark, save_documents(edge_documents(spark), tmp_path))


def test_empty(spark, tmp_path):
    assert r.op3_recompression(spark, save_documents(edge_documents(spark).limit(0), tmp_path)).count() == 0


def test_rows_that_share_an_id_or_have_none(spark, tmp_path):
    """Each row loses by its own text what a smaller id has, and nothing to rows of its id; names of other columns do not matter."""
    rng = random.Random(6)
    passage = [f"p{k}" for k in range(80)]
    rows = []
    for k in range(120):
        own = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 40))]
        at = rng.randrange(len(own) + 1)
        rows.append((rng.choice([None, None, 1, 2, 2, 3, k]), " ".join(own[:at] + passage * rng.randrange(0, 3) + own[at:]), *range(9)))
    rows += rows[:10] + [(None, None, *range(9)), (2, "", *range(9))]
    names = ["n", "l", "doc", "spans", "copies", "h", "uid", "row", "n_chars"]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names)).repartition(6)
    assert sum(x[2] for x in check(spark, save_documents(df, tmp_path))) > 1000
    left = r.without_repeats(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert left.columns == df.columns and left.count() > 60


def test_planted_passages(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(300)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 90, 130, 400)] + [["x"] * 120, ["a", "b"] * 70, ["p"] * 30 + ["q"] * 30]
    texts = []
    for k in range(260):
        own = [word() for _ in range(rng.randrange(0, 80))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            first = rng.randrange(0, max(1, len(p) - 49))
            own += p[first : first + rng.randrange(45, 200)] + [word() for _ in range(rng.randrange(0, 30))]
        texts.append(" ".join(own))
    texts += texts[:20]
    check(spark, save_documents(edge_documents(spark, texts).repartition(5), tmp_path))


@pytest.mark.parametrize("seed", range(6))
def test_equal_windows_pick_equal_anchors(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [2, 5, 50, 5000][seed % 4]
    shared = rng.integers(1, vocabulary + 1, 90).astype(np.uint64)
    picked = []
    with np.errstate(over="ignore"):
        for _ in range(12):
            left, right = (rng.integers(1, vocabulary + 1, rng.integers(0, 60)).astype(np.uint64) for _ in range(2))
            h = r.mix64(np.concatenate([left, shared, right, [1 << 40]]).astype(np.uint64))
            valid = np.zeros(len(h), dtype=bool)
            valid[: len(h) - 50] = True
            name, place = r.anchors(h, valid)
            at = np.arange(len(left), len(left) + 41)
            picked.append((name[at].tolist(), (place[at] - len(left)).tolist()))
    assert all(p == picked[0] for p in picked)


def test_rolling_hashes_do_not_depend_on_place():
    x = r.mix64(np.arange(100, dtype=np.uint64))
    a, b = r.Rolling(np.concatenate([x, x[:7], x])), np.array([0, 107])
    h = a.of(b, b + 60)
    assert h[0][0] == h[0][1] and h[1][0] == h[1][1] and h[0][0] != h[1][0]
