import hashlib
import random
import zlib

import numpy as np

from graphloom.llm.runs import LEAST, collapse, find_runs, op12_runs, runs_of, stretches, text_runs

from .helpers import edge_documents, save_documents


def brute(w, least=LEAST):
    """Every stretch of every period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)  # the smallest period counts
            i = max(j, i + 1)
    return sorted((s, m, q) for (s, m), q in found.items())


def texts(draw):
    yield from ([], [1], [1] * 11, [1] * 12, [1, 2] * 6, [1, 2, 3] * 4, [1, 2, 3] * 4 + [1], list(range(30)))
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a  # Fibonacci words: as many runs as a text can have, nearly
    yield b
    thue = [0]
    for _ in range(7):
        thue += [1 - x for x in thue]
    yield thue
    for _ in range(150):
        letters, n = draw.choice([1, 2, 3, 5, 40]), draw.randrange(120)
        w = [draw.randrange(letters) for _ in range(n)]
        for _ in range(draw.randrange(3)):
            k, p = draw.randrange(n + 1), draw.randint(1, 9)
            w[k:k] = (w[k : k + p] or [7]) * draw.randint(1, 8)
        yield w


def test_runs_against_all_periods():
    total = 0
    for w in texts(random.Random(3)):
        want = brute(w)
        assert sorted(runs_of(w)) == want and text_runs(w) == sorted(want, key=lambda r: (r[0], r[2]))
        for least in (2, 5):
            assert text_runs(w, least) == sorted(brute(w, least), key=lambda r: (r[0], r[2]))
        total += len(want)
    assert total > 150


def test_stretches_cover_all_runs_and_little_else():
    draw = random.Random(4)
    w = [draw.randrange(10**6) for _ in range(3000)]
    w[1000:1060] = w[1000:1020] * 3
    assert stretches(np.array(w), 6) == [(1000, 1060)]
    assert text_runs(w) == [(1000, 60, 20)]


def test_collapse_keeps_the_first_period():
    w = [9, 8, *[1, 2, 3] * 5, 7]
    assert collapse(w, text_runs(w)) == [9, 8, 1, 2, 3, 7]
    w = [5] * 20 + [6] * 15
    assert collapse(w, text_runs(w)) == [5, 6]


def test_long_texts():
    w = list(range(3000)) * 4 + [5] * 4000
    assert text_runs(w) == [(0, 12000, 3000), (12000, 4000, 1)]


def altered(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def expected(doc_id, text):
    words = altered(doc_id, text)
    found = sorted(brute(words), key=lambda r: (r[0], r[2]))
    s, m, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    gone = {i for s_, m_, q_ in found for i in range(s_ + q_, s_ + m_)}
    kept = b" ".join(x for i, x in enumerate(words) if i not in gone)
    lines = "".join(f"{s_},{m_},{q_}\n" for s_, m_, q_ in found)
    return doc_id, len(found), s, m, q, 1000 * m // q if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_query_on_edges(spark, tmp_path):
    d = save_documents(edge_documents(spark), tmp_path)
    got = sorted(map(tuple, op12_runs(spark, d).collect()), key=repr)
    assert got == sorted((expected(r.doc_id, r.text) for r in edge_documents(spark).collect()), key=repr)


def test_query_against_all_periods(spark, tmp_path):
    draw = random.Random(8)
    rows = []
    for k in range(400):
        words = [f"w{draw.randrange(30)}" for _ in range(draw.randrange(200))]
        if k % 3 == 0:
            words[5:5] = words[5:8] * 7
        rows.append((k, draw.choice([" ", "\n", "\x0b"]).join(words)))
    save_documents(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path)
    got = sorted(map(tuple, op12_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((expected(*r) for r in rows), key=repr)
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k in range(400)) > 20


def test_given_documents_have_the_planted_run(spark, sf_dir):
    """Documents with a planted period have a run to their end whose period divides it or is smaller."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op12_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    seen = 0
    for r in docs:
        words = altered(r.doc_id, r.text)
        h = zlib.crc32(str(r.doc_id).encode())
        a = (h // 10) % len(words) if words else 0
        if h % 10 == 0 and len(words) - a >= 24:
            seen += 1
            assert got[r.doc_id].n_runs >= 1 and got[r.doc_id].length >= len(words) - a
        if len(words) < 400:
            assert tuple(got[r.doc_id]) == expected(r.doc_id, r.text)
    assert seen > 30


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, runs string, n_words string")
    assert find_runs(docs).collect() == []
    row = find_runs(spark.createDataFrame([(1, "a b c " * 5, "x", "y")], docs.schema)).first()
    assert (row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (15, [(0, 15, 3)], "a b c")


