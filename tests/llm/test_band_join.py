import math
import random
import zlib

import pytest

from graphloom.llm.band_join import Tree, _list, band_join

LINE = "sale_id long, line_no int, item_id long, quantity int, amount double, n_pairs int, shard string"
ITEM = "item_id long, price double, kind int, at string"


def brute(lines, items, first=10, least_gap=50, permille=5):
    """Every pair, made one by one."""
    cents = lambda x: math.floor(100 * x + 0.5) if x is not None and math.isfinite(x) else None
    out = []
    for item, price in {(r[0], cents(r[1])) for r in items}:
        pairs = []
        for sale, no, other, q, amount, *_ in lines:
            a = cents(amount)
            if None in (sale, other, a, item, price) or not q or other == item:
                continue
            u = (2 * a + q) // (2 * q)
            gap = abs(u - price)
            if gap <= least_gap or 1000 * gap <= permille * min(u, price):
                pairs.append((gap, u, sale, no is None, no, other))
        pairs.sort(key=lambda x: (*x[:4], x[4] or 0, x[5]))
        sums = (len(pairs), sum(x[0] for x in pairs), sum(zlib.crc32(f"{x[2]},{'' if x[4] is None else x[4]},{x[5]}".encode()) for x in pairs))
        out += [(item, k, g, u, s, n, o, *sums) for k, (g, u, s, _, n, o) in enumerate(pairs[:first], 1)] or [(item, 0, *[None] * 5, *sums)]
    return sorted(out, key=repr)


def run(spark, lines, items, **options):
    got = band_join(spark.createDataFrame(lines, LINE), spark.createDataFrame(items, ITEM), **options)
    return sorted(map(tuple, got.collect()), key=repr)


def line(sale, no, item, q, amount):
    return sale, no, item, q, amount, 7, "clash"


def test_against_all_pairs(spark):
    draw = random.Random(5)
    items = [(k, round(draw.choice([3, 5, 40, 900, 40_000]) * draw.uniform(0.9, 1.1), 2), 1, "x") for k in range(60)]
    lines = []
    for k in range(1500):
        item, price, *_ = draw.choice(items[:10] if k % 3 else items)
        q = draw.randint(1, 9)
        lines.append(line(draw.randint(0, 300), draw.randint(1, 4), item, q, round(q * price * draw.uniform(0.99, 1.01), 2)))
    lines += [line(5, 1, 7, 1, items[7][1])] * 40  # one item's lines before all others
    want = brute(lines, items)
    assert run(spark, lines, items) == want
    assert sum(r[7] for r in want) > 10_000
    assert run(spark, lines, items, first=2, least_gap=3, permille=40) == brute(lines, items, 2, 3, 40)


def test_edges(spark):
    items = [(1, 1.0, 1, "x"), (1, 1.0, 1, "x"), (1, 2.0, 1, "x"), (2, None, 1, "x"), (None, 1.0, 1, "x"), (3, float("nan"), 1, "x"), (4, float("inf"), 1, "x"), (5, -0.2, 1, "x"), (6, 0.0, 1, "x"), (7, 1e15, 1, "x")]
    lines = [line(1, 1, 2, 1, 1.0), line(1, None, 2, 1, 1.0), line(1, 2, 1, 1, 1.0), line(None, 1, 2, 1, 1.0), line(1, 1, None, 1, 1.0), line(1, 1, 2, None, 1.0), line(1, 1, 2, 1, None)]
    lines += [line(1, 1, 2, 0, 1.0), line(2, 1, 2, -3, 1.0), line(2, 1, 2, 3, -1.0), line(3, 1, 9, 1, float("nan")), line(3, 1, 9, 1, float("-inf")), line(3, 1, 9, 1, 1e300), line(1, 1, 2, 1, 1.0)]
    want = brute(lines, [r for r in items if r[0] != 7])
    assert run(spark, lines, items) == sorted([*want, (7, 0, *[None] * 5, 0, 0, 0)], key=repr)


@pytest.mark.parametrize("lines, items", [(0, 1), (1, 0), (0, 0)])
def test_empty(spark, lines, items):
    got = run(spark, [line(1, 1, 2, 1, 1.0)] * lines, [(1, 1.0, 1, "x")] * items)
    assert got == [(1, 0, *[None] * 5, 0, 0, 0)] * items


def test_bands_over_many_shards(spark):
    """Large prices: whole shards inside a band are nodes of further tiers."""
    draw = random.Random(6)
    items = [(k, round(draw.uniform(990_000, 1_010_000), 2), 1, "x") for k in range(25)]
    lines = [line(k, 1, draw.randrange(25), 1, round(draw.uniform(985_000, 1_015_000), 2)) for k in range(700)]
    assert run(spark, lines, items) == brute(lines, items)


def test_tree_answers_every_interval_without_any_item():
    draw = random.Random(7)
    for size in (1, 2, 3, 5, 8, 13):
        leaves = []
        for at in range(size):
            own = sorted((at, draw.randrange(30), 1, draw.randrange(3)) for _ in range(draw.randrange(1, 12)))
            leaves.append((at, (len(own), at * len(own), 0), own, own))
        whole = [x[2] for x in leaves]
        tree = Tree([(at, sums, _list(up, 2), _list(down, 2)) for at, sums, up, down in leaves], 2)
        for low in range(size + 1):
            for high in range(low, size + 1):
                inside = sum(whole[low:high], [])
                for rise, ordered in ((True, sorted(inside)), (False, sorted(inside, key=lambda e: (-e[0], *e[1:])))):
                    sums, near = tree.merged(low, high, rise)
                    assert sums[0] == len(inside) and len(near) <= 4
                    for without in range(-1, 3):
                        assert [e for e in near if e[3] != without][:2] == [e for e in ordered if e[3] != without][:2]
