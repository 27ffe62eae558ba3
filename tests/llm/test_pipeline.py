"""The pipeline's stages against brute force, and all of it on a small corpus."""

import importlib
import random
import re

import pytest

from graphloom.llm import langid, simhash

from .helpers import edge_documents, save_documents
from .test_recompression import brute as brute_removals
from .test_tokens import check_packing

pipeline = importlib.import_module("corpus_pipeline")


def shingles(text, n=5):
    w = re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "").strip(" \t\n\x0b\x0c\r"))
    w = [x for x in w if x]
    return {" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and rows of each stage over the whole table."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in pipeline.STAGES:
        after = pipeline.materialize(stage(spark, docs, sf_dir), "test")
        out.append((docs, after))
        docs = after
    return out


def test_columns(stages):
    for before, after in stages[:-1]:
        assert before.columns == after.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language(stages):
    before, after = (x.collect() for x in stages[0])
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert len(gone) <= 0.02 * len(before)
    net = langid.fit(stages[0][0])
    for r in before:
        names, scores = langid._score(net, [r.text])
        assert (r.doc_id in gone) == (names[0] == "und" or scores[0] < langid.LEAST_SCORE)


def test_near_duplicates(stages):
    before, after = (x.collect() for x in stages[1])
    sets, kept = {r.doc_id: shingles(r.text) for r in before}, {r.doc_id for r in after}
    ids, links = sorted(sets), {}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) >= 0.75 * max(len(sets[a]), len(sets[b])):
                s = len(sets[a] & sets[b])
                s /= len(sets[a]) + len(sets[b]) - s
                if s >= 0.8:
                    links.setdefault(a, []).append((s, b))
                    links.setdefault(b, []).append((s, a))
    for d in set(ids) - kept:  # nothing goes that is not near another
        assert d in links and min(b for _, b in links[d]) < d
    pairs = [(a, b) for a in links for _, b in links[a] if a < b]
    assert len(pairs) > 20 and not [p for p in pairs if set(p) <= kept]


def test_repeated_passages(stages):
    before, after = (x.collect() for x in stages[2])
    wanted = {d: (n - gone) for d, n, gone, _ in brute_removals(before)}
    texts = {r.doc_id: r.text for r in before}
    got = {r.doc_id: r for r in after}
    for d, left in wanted.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[d] or "")
        if left == len(words):
            assert got[d].text == texts[d]
        elif left:
            assert len(got[d].text.split(" ")) == left and got[d].n_chars == len(got[d].text)
        else:
            assert d not in got


def test_mixing(stages):
    before, after = (x.collect() for x in stages[3])
    own, counts = {r.doc_id: r for r in before}, {}
    for r in after:
        assert r == own[r.doc_id]
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) <= 3
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for d, r in own.items()}
    assert sum(size[d] * n for d, n in counts.items()) == pytest.approx(sum(size.values()), rel=0.02)


def test_packing(stages):
    check_packing(stages[4][0].collect(), stages[4][1].collect())


def test_near_copies_of_every_kind(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (60, 90, 120, 400, 3000)]
    texts, group = [], []
    for g, words in enumerate(base):
        for k in range(6):
            own = list(words)
            for _ in range(0 if k < 2 else max(1, len(own) // 80)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(own) if k != 1 else " ".join(own).upper())
            group.append(g)
    texts += ["alone", "", "", None, "the very end"]
    kept = sorted(r.doc_id for r in simhash.one_of_each_group(edge_documents(spark, texts)).collect())
    left = {}
    for d in kept:
        if d < len(group):
            left.setdefault(group[d], []).append(d)
    assert all(min(v) == 6 * g for g, v in left.items()) and set(left) == set(range(5))
    assert sum(len(v) for v in left.values()) <= 6 and kept[-5:] == list(range(30, 35))


def test_near_copies_of_one_original(spark):
    """Copies are near their original, and seldom near each other: each star is one group."""
    rng, texts, stars = random.Random(8), [], []
    for n, copies, changed in ((120, 300, 2), (300, 150, 6)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        star = [base]
        for _ in range(copies):
            own = list(base)
            for k in range(rng.randrange(n // changed), n, n // changed):
                own[k] = f"x{rng.randrange(10**6)}"
            star.append(own)
        rng.shuffle(star)
        stars.append((len(texts), len(texts) + len(star)))
        texts += [" ".join(x) for x in star]
    # copies of many lengths
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    stars.append((len(texts), len(texts) + 100))
    texts += [" ".join([*base, *(f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(21)))]) for _ in range(99)] + [" ".join(base)]
    near = len(texts)
    # one long passage in texts that are not near each other
    passage = [f"p{k}" for k in range(50)]
    texts += [" ".join([*passage, *(f"y{rng.randrange(10**6)}" for _ in range(30))]) for _ in range(40)]
    kept = sorted(r.doc_id for r in simhash.one_of_each_group(edge_documents(spark, texts)).collect())
    assert kept == [*(low for low, _ in stars), *range(near, len(texts))]


def group_count(texts):
    """Groups by brute force over all pairs of shingle sets."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k in range(len(texts)):
        for j in range(k):
            shared = len(sets[k] & sets[j])
            if shared and shared >= 0.8 * (len(sets[k]) + len(sets[j]) - shared):
                root[max(find(k), find(j))] = min(find(k), find(j))
    return sorted({find(k) for k in range(len(texts))})


def test_groups_without_an_original(spark):
    """Copies of a text that is not there: some near each other, most not, with many shingles in common."""
    rng, texts = random.Random(9), []
    for n, copies, changed in ((150, 150, 2), (150, 100, 3), (90, 80, 1)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(changed + 1)):
                own[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
            cut = rng.randrange(12)
            texts.append(" ".join(own[cut:] if rng.random() < 0.5 else own[: n - cut]))
    passage = [f"p{k}" for k in range(60)]
    texts += [" ".join([*passage, *(f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(30)))]) for _ in range(150)]
    rng.shuffle(texts)
    kept = sorted(r.doc_id for r in simhash.one_of_each_group(edge_documents(spark, texts)).collect())
    assert kept == group_count(texts)


def test_edges_and_empty(spark, tmp_path):
    """Null ids and texts, repeated rows, and other columns with names that the stages use themselves."""
    names = ["copies", "h", "n", "l", "doc", "spans", "uid", "row", "key", "a", "b", "root", "first", "draw", "turn", "id", "to_id", "to_h", "whole", "c0", "c1", "each", "more", "own", "copy"]
    names += [f"__{x}" for x in ("lang", "score", "id", "h", "key", "own", "each", "more", "copy", "text_hash", "turn", "doc", "row", "spans")]
    docs = edge_documents(spark).selectExpr("*", *(f"{k} AS {n}" for k, n in enumerate(names)))
    before = docs
    for _, stage in pipeline.STAGES[:-1]:
        before = pipeline.materialize(stage(spark, before, str(tmp_path)), "edges")
        assert before.columns == docs.columns
    folder = save_documents(docs, tmp_path / "a")
    assert pipeline.run(spark, folder).count() > 0
    folder = save_documents(docs.limit(0), tmp_path / "b")
    assert pipeline.run(spark, folder).count() == 0
