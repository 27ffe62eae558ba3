"""The similarity join of names against all pairs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators.near_names import adopt_canonical, candidates, lowered, near_names, plan, segments
from graphloom.plans.queries import QUERIES


def ratio(a, b):
    return difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()


def variants(rng, count):
    """Names of 1 to 30 characters, each with copies after up to three edits; long, repeating and odd-cased ones."""
    base = ["".join(rng.choice("abcdeFG é") for _ in range(rng.randrange(1, 30))) for _ in range(count)]
    names = list(base)
    for w in base * 3:
        k = list(w)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(k) + 1)
            if rng.random() < 0.5:
                k.insert(at, rng.choice("abxyz"))
            elif k:
                k.pop(min(at, len(k) - 1))
        names.append("".join(k))
    return list(dict.fromkeys(w for w in [*names, *("p" * 250 + w for w in base[:5]), "aaaa", "aaab", "İx", "ix"] if w))


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.92, 1.0])
def test_no_pair_is_lost(spark, threshold):
    names = variants(random.Random(3), 50)
    df = spark.createDataFrame([(w,) for w in names] * 2 + [(None,), ("",)], "name string").withColumn("low", F.lit("clash"))
    got = [(r.name, r.other, r.ratio) for r in near_names(df, df, threshold).collect()]
    want = {(a, b, ratio(a, b)) for a in names for b in names if ratio(a, b) >= threshold}
    assert len(got) == len(set(got)) and set(got) == want


def test_grams_get_shorter_where_names_may_lose_more():
    assert [plan(t)[0] for t in (0.3, 0.5, 0.8, 0.92, 1.0)] == [1, 1, 2, 3, 3]
    for t in (0.8, 0.9, 0.92, 1.0):
        q, least, short = plan(t)
        assert short * t / (2 - t) >= least  # a partner of a name that has no characters has grams


@pytest.mark.parametrize("threshold", [0.8, 0.92, 1.0])
def test_a_segment_is_whole_in_every_near_name(threshold):
    rng = random.Random(4)
    longest, cuts, pieces = segments(threshold)
    met = 0
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, longest + 1)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abc")) if rng.random() < 0.5 else b and b.pop(rng.randrange(len(b)))
        a, b = sorted((a, "".join(b)), key=len)
        if a and len(b) <= longest and max(ratio(a, b), ratio(b, a)) >= threshold:
            met += 1
            of = lambda w, rows: {(k, w[at - 1 : at - 1 + size]) for x, y, k, at, size in rows if (x, y) == (len(a), len(b))}
            assert of(a, cuts) & of(b, pieces), (a, b)
    assert met > 500


def test_few_pairs_are_compared(spark):
    """Names of few syllables share most of their grams: of ten thousand, not one in a thousand pairs is compared."""
    names = spark.read.parquet("/root/testdata/sf0.1/clients.parquet").where("name <> ''").select(lowered("name").alias("low")).distinct().withColumn("n", F.length("low"))
    assert candidates(names, names, 0.92).count() < 5 * names.count()


@pytest.mark.parametrize("bad", [0, -1, 1.1])
def test_thresholds(spark, bad):
    df = spark.createDataFrame([("a",)], "name string")
    with pytest.raises(ValueError):
        near_names(df, df, bad)


def test_empty(spark):
    df = spark.createDataFrame([(None,), ("",)], "name string")
    assert near_names(df, df).count() == 0


def test_registered_query_on_names_of_parts_and_clients(spark, sf_dir):
    for table, column in (("part", "p_name"), ("clients", "name")):
        names = [r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(column).distinct().collect() if r[0]]
        if table == "part":
            df = spark.createDataFrame([(n,) for n in names], "name string")
            got = {(r.name, r.other) for r in near_names(df, df).collect()}
        else:
            got = {(r.name, r.other) for r in QUERIES["f4_near_names"](spark, sf_dir).collect()}
        quick = lambda a, b: difflib.SequenceMatcher(None, a.lower(), b.lower())
        assert got == {(a, b) for a in names for b in names if 2 * min(len(a), len(b)) >= 0.92 * (len(a) + len(b)) and (m := quick(a, b)).real_quick_ratio() >= 0.92 and m.quick_ratio() >= 0.92 and m.ratio() >= 0.92}


def test_canonical_names_come_from_any_chunk(spark):
    rows = [(1, "Graph Neural Network", None), (2, "Graph Neural Networks", "Graph Neural Networks"), (3, "graph neural networkz", "graph neural networkz"), (4, "Spark", None), (5, None, None)]
    df = spark.createDataFrame(rows, "chunk_index long, name string, canonical_name string")
    got = {r.name: r.canonical_name for r in adopt_canonical(df).collect()}
    assert got == {"Graph Neural Network": "Graph Neural Networks", "Graph Neural Networks": "Graph Neural Networks", "graph neural networkz": "graph neural networkz"}
