"""The pipeline's near-duplicate stage: its first links come from multi-index hashing, and a pair of the rest seldom meets twice."""

import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import simhash

from .helpers import edge_documents
from .test_pipeline import group_count


def captured(monkeypatch, texts, spark):
    """Ids that stay, and the intermediate tables by name."""
    tables, real = {}, simhash.materialize

    def keep(df, name, *args, **options):
        tables.setdefault(name, out := real(df, name, *args, **options))
        return out

    monkeypatch.setattr(simhash, "materialize", keep)
    monkeypatch.setattr(simhash, "drop_shared", lambda *_: None)
    return sorted(r.doc_id for r in simhash.one_of_each_group(edge_documents(spark, texts)).collect()), tables


def changed(words, n, rng):
    own = list(words)
    for k in rng.sample(range(len(own)), n):
        own[k] = f"x{rng.randrange(10**6)}"
    return own


def test_first_links_come_from_multi_index_hashing(spark, monkeypatch):
    rng = random.Random(4)
    texts, calls, real = [], [], simhash.linked
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        texts += [" ".join(base), " ".join(changed(base, 1, rng)), " ".join(changed(base, 8, rng))]
    monkeypatch.setattr(simhash, "linked", lambda *args: calls.append(args) or real(*args))
    kept, tables = captured(monkeypatch, texts, spark)
    assert kept == group_count(texts) == list(range(0, 36, 3))
    uid = {r.uid: r.doc_id for r in tables["profiles-only"].collect()}
    first = {tuple(sorted((uid[r.a], uid[r.b]))) for r in tables["simhash-links"].collect()}
    wanted = {(k, j) for k in range(36) for j in range(k + 1, 36) if k // 3 == j // 3 and (simhash.fingerprint(texts[k], 5) ^ simhash.fingerprint(texts[j], 5)).bit_count() <= 3}
    assert len(calls) == 1 and wanted <= first and len(wanted) >= 6
    links = first | {tuple(sorted((uid[r.a], uid[r.b]))) for name in ("first-links", "more-links") for r in tables[name].collect()}
    assert links > first  # the exact way finds the rest


def test_pairs_across_groups_meet_at_few_keys(spark, monkeypatch):
    """Texts that share three quarters: near enough to meet at many keys, and not near."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(800)]
    texts = [" ".join([*base[:690], *(f"y{rng.randrange(10**6)}" for _ in range(110))]) for _ in range(14)]
    kept, tables = captured(monkeypatch, texts, spark)
    assert kept == group_count(texts) == list(range(14))
    own = tables["more-open-keys"]
    other = own.select(*(F.col(c).alias(f"to_{c}") for c in ("key", "uid", "before")))
    met = own.join(other, (F.col("key") == F.col("to_key")) & (F.col("uid") < F.col("to_uid")))
    new = met.where(~F.arrays_overlap("before", "to_before"))
    pairs = {tuple(r) for r in met.select("uid", "to_uid").collect()}
    assert pairs == {tuple(r) for r in new.select("uid", "to_uid").collect()}
    assert met.count() > 20 * len(pairs) and new.count() <= 2 * len(pairs)
    assert tables["more-like"].count() <= tables["more-pairs"].count()


def test_wide_bitmaps_leave_out_no_near_pair():
    rng = np.random.default_rng(2)
    for n in (1, 5, 256, 257, 1000, 5000, 70_000):
        p = np.unique(rng.integers(0, 1 << 32, n))
        for part in (0.02, 0.2, 0.9):
            q = np.unique(np.concatenate([p[int(part * len(p)) :], rng.integers(0, 1 << 32, int(part * len(p)))]))
            a, b = simhash._bitmap(p), simhash._bitmap(q)
            size = min(len(a), len(b))
            bits = int(np.bitwise_count(simhash._folded(a, size) ^ simhash._folded(b, size)).sum(dtype=np.int64))
            assert bits <= len(np.setxor1d(p, q))
    # sets of 5,000 that share half: 256 bits cannot tell, wide ones can
    p, q = (np.unique(np.concatenate([np.arange(3333) * 77_777, x])) for x in (rng.integers(1 << 30, 1 << 32, 1667), rng.integers(1 << 30, 1 << 32, 1667)))
    allowed = (len(p) + len(q)) / 9
    differ = lambda size: np.bitwise_count(simhash._folded(simhash._bitmap(p), size) ^ simhash._folded(simhash._bitmap(q), size)).sum(dtype=np.int64)
    assert differ(32) <= allowed < differ(len(simhash._bitmap(p)))


