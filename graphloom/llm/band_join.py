"""Numeric band join with segment trees over the prices of lines.

An item pairs with every line of another item whose unit price is near its
own.  There are far too many pairs to make, so lines are summed up first: by
unit price ``u`` and item, then by ``u``.  Range shards of ``WIDTH`` positions
each build a segment tree over their distinct ``u``; a node holds how many
lines it has, their sums, and its first lines in either direction of price,
diversified by item: of one item at most ``first`` and of all at most twice
that, so that ``first`` are left whichever item is excluded.  The interval of
a price is cut at the price; each half merges its canonical nodes.  Whole
shards inside a half are one node each of the next tier, whose shards build
trees over the roots below them, so no interval meets more than two partial
shards a tier.  The item's own lines are taken out at the end: from the first
lines by their item, from the sums by the item's own sums.

Every step is keyed by price, shard or item after rows were summed up; a
shard has at most ``WIDTH`` positions and as many prices as lie within its
reach, whatever the number of lines.  Nothing is broadcast, and only the number
of tiers goes to the driver.

Nulls and edge cases: a line null in sale, item, quantity or amount, of
quantity zero, or with an amount that is no finite number below 2**52 cents
pairs with nothing, nor does an item with such a price or without an id (one
row of rank 0); a null line number counts, comes last, and is empty in the
checksum; negative amounts and quantities are exact; repeated lines each count
and take a rank each; items that repeat in id and price are one, an id with
several prices has rows for each; empty tables give an empty result or rows of
rank 0; other columns are ignored.  Sums are longs, as asked for: an item of
more than 2**31 pairs may exceed them and then ends in Spark's overflow error.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import materialize

#: Positions of a shard: prices on the first tier, shards of the tier below on the others.
WIDTH = 64
#: Parts of one price's items.
PARTS = 16
#: Stands for a null line number inside the trees; line numbers are ints.
NO_LINE = (1 << 63) - 1
#: Cents beyond which products of the band's terms would not fit a long.
MOST_CENTS = 1 << 52

LEAF, RISING, FALLING, QUERY, SUMS, FIRST = range(6)
FLAT = "shard long, kind int, at long, a long, b long, c long, d long"


def cents(x: Column) -> Column:
    """floor(100 * x + 0.5), null where it is no finite number of reasonable size."""
    y = F.floor(100 * x.cast("double") + F.lit(0.5))
    known = F.abs(x.cast("double")) < F.lit(MOST_CENTS / 100)
    return F.when(known & ~F.isnan(x.cast("double")), y)


def unit_cents(amount: Column, quantity: Column) -> Column:
    """floor((2a + q) / (2q)) in exact integers; null for q = 0."""
    q, sign = quantity.cast("long"), F.when(quantity < 0, F.lit(-1)).otherwise(F.lit(1))
    top, base = (2 * amount + q) * sign, 2 * q * sign
    whole = F.call_function("div", top - F.pmod(top, base), base)
    return F.when(q != 0, whole)


def _list(entries: list[tuple], first: int) -> list[tuple]:
    """The first of ``entries`` (in order; the item comes last): ``first`` of an item and twice that of all at most."""
    if len(entries) <= first:
        return entries
    taken: dict = {}
    out = []
    for e in entries:
        n = taken.get(e[-1], 0)
        if n < first:
            taken[e[-1]] = n + 1
            out.append(e)
            if len(out) == 2 * first:
                break
    return out


class Tree:
    """Segment tree over the positions of one shard that have lines."""

    def __init__(self, leaves: list[tuple[int, tuple, list, list]], first: int):
        """leaves: (position, (n, sum of u, sum of checksums), rising, falling), by position; rising and falling: the first lines (u, sale, line, item) from low or high prices on."""
        self.first, self.positions, self.size = first, [x[0] for x in leaves], len(leaves)
        self.sums = [(0, 0, 0)] * self.size + [x[1] for x in leaves]
        self.rising = [[]] * self.size + [x[2] for x in leaves]
        self.falling = [[]] * self.size + [x[3] for x in leaves]
        # nodes of a bottom-up tree over any number of leaves; those that wrap around the end are never canonical
        for k in range(self.size - 1, 0, -1):
            self.sums[k] = tuple(map(sum, zip(self.sums[2 * k], self.sums[2 * k + 1])))
            self.rising[k] = _list(self.rising[2 * k] + self.rising[2 * k + 1], first)
            self.falling[k] = _list(self.falling[2 * k + 1] + self.falling[2 * k], first)

    def canonical(self, low: int, high: int) -> list[int]:
        """Nodes that make up the leaves low..high - 1, in order."""
        left, right = [], []
        low, high = low + self.size, high + self.size
        while low < high:
            if low & 1:
                left.append(low)
                low += 1
            if high & 1:
                high -= 1
                right.append(high)
            low, high = low >> 1, high >> 1
        return left + right[::-1]

    def merged(self, low: int, high: int, rising: bool) -> tuple[tuple, list]:
        nodes = self.canonical(low, high)
        if not nodes:
            return (0, 0, 0), []
        lists = (self.rising[k] for k in nodes) if rising else (self.falling[k] for k in reversed(nodes))
        return tuple(map(sum, zip(*(self.sums[k] for k in nodes)))), _list(list(chain.from_iterable(lists)), self.first)


def _answer(rows: pd.DataFrame, first: int) -> pd.DataFrame:
    """One shard: builds its tree, answers its queries, and hands its root on as a leaf of the next tier."""
    shard = int(rows["shard"].iloc[0])
    sums, rising, falling, queries = {}, {}, {}, []
    for kind, at, a, b, c, d in rows[["kind", "at", "a", "b", "c", "d"]].itertuples(index=False, name=None):
        if kind == LEAF:
            sums[at] = (a, b, c)
        elif kind == QUERY:
            queries.append((at, a, b, c))
        else:
            (rising if kind == RISING else falling).setdefault(at, []).append((a, b, c, d))
    leaves = []
    for at in sorted(sums):
        up = sorted(rising.get(at, []))
        down = sorted(falling[at], key=lambda e: (-e[0], *e[1:])) if at in falling else up  # on the first tier a leaf is one price
        leaves.append((at, sums[at], _list(up, first), _list(down, first)))
    out: list[tuple] = []
    if leaves:
        tree = Tree(leaves, first)
        root, up = tree.merged(0, tree.size, True)
        down = tree.merged(0, tree.size, False)[1]
        out.append((LEAF, shard, *root, 0))
        out += [(RISING, shard, *e) for e in up]
        out += [(FALLING, shard, *e) for e in down]
        for p, low, high, rise in queries:
            (n, u, crc), entries = tree.merged(bisect_left(tree.positions, low), bisect_right(tree.positions, high), bool(rise))
            if n:
                out.append((SUMS, p, n, u - n * p if rise else n * p - u, crc, 0))
                out += [(FIRST, p, *e) for e in entries]
    columns = list(zip(*out)) if out else [[]] * 6
    return pd.DataFrame({"shard": [0] * len(out)} | dict(zip(["kind", "at", "a", "b", "c", "d"], columns)))


def _pieces(bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``bands`` (p, low, high, rise: positions of this tier): the pieces in partial shards as rows of FLAT, and what is left for the next tier."""
    shard = lambda c: F.floor(F.col(c) / F.lit(WIDTH)).cast("long")  # noqa: E731  exact: |c| < 2**53
    cut = bands.withColumns({"s": shard("low"), "e": shard("high")})
    start, end = F.col("s") * WIDTH, F.col("e") * WIDTH + WIDTH - 1
    # a shard that a band covers whole is left for the next tier, if it has others beside it
    head = F.when(F.col("s") == F.col("e"), F.array(F.struct(F.col("s").alias("shard"), "low", "high")))
    first = F.when(F.col("low") > start, F.struct(F.col("s").alias("shard"), F.col("low").alias("low"), (start + WIDTH - 1).alias("high")))
    last = F.when(F.col("high") < end, F.struct(F.col("e").alias("shard"), (F.col("e") * WIDTH).alias("low"), F.col("high").alias("high")))
    pieces = cut.select("p", "rise", F.explode(F.coalesce(head, F.array_compact(F.array(first, last)))).alias("x"))
    flat = pieces.select("x.shard", F.lit(QUERY).alias("kind"), F.col("p").alias("at"), F.col("x.low").alias("a"), F.col("x.high").alias("b"), F.col("rise").cast("long").alias("c"), F.lit(0).cast("long").alias("d"))
    rest = cut.where("s < e").select("p", (F.col("s") + (F.col("low") > start).cast("long")).alias("low"), (F.col("e") - (F.col("high") < end).cast("long")).alias("high"), "rise").where("low <= high")
    return flat, rest


def band_join(lines: DataFrame, items: DataFrame, first: int = 10, least_gap: int = 50, permille: int = 5) -> DataFrame:
    """Each item's ``first`` nearest lines of other items and sums over all of them.

    ``lines``: sale_id, line_no, item_id, quantity, amount; ``items``: item_id,
    price.  A pair's gap |u - p| is at most ``least_gap`` cents or at most
    ``permille`` thousandths of the lesser price.  Returns item_id, rank, gap,
    u, sale_id, line_no, line_item_id, n_pairs, gap_sum, lines_crc.
    """
    amount = cents(F.col("amount"))
    own = lines.select(F.col("sale_id").cast("long").alias("sale"), F.col("line_no").cast("long").alias("no"), F.col("item_id").cast("long").alias("item"), unit_cents(amount, F.col("quantity")).alias("u")).where("u IS NOT NULL AND sale IS NOT NULL AND item IS NOT NULL")
    text = F.concat(F.col("sale").cast("string"), F.lit(","), F.coalesce(F.col("no").cast("string"), F.lit("")), F.lit(","), F.col("item").cast("string"))
    # sums and first lines by price and item: few rows leave a task, however many lines a key has
    summed = materialize(own.groupBy("u", "item").agg(F.count("*").alias("n"), F.sum(F.crc32(text.cast("binary"))).alias("crc")), "band-sums")
    order = ["sale", "no", "item"]
    numbered = own.withColumn("no", F.coalesce("no", F.lit(NO_LINE)))
    of_item = numbered.withColumn("r", F.row_number().over(Window.partitionBy("u", "item").orderBy("sale", "no"))).where(F.col("r") <= first)
    # a price that many items have is brought down in parts before its rows meet
    parts = of_item.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(PARTS))).withColumn("r", F.row_number().over(Window.partitionBy("u", "part").orderBy(*order))).where(F.col("r") <= 2 * first)
    firsts = parts.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(*order))).where(F.col("r") <= 2 * first)
    shard = F.floor(F.col("u") / F.lit(WIDTH)).cast("long").alias("shard")
    zero = F.lit(0).cast("long")
    leaves = summed.groupBy("u").agg(F.sum("n").alias("n"), F.sum("crc").alias("crc")).select(shard, F.lit(LEAF).alias("kind"), F.col("u").alias("at"), F.col("n").alias("a"), (F.col("n") * F.col("u")).alias("b"), F.col("crc").alias("c"), zero.alias("d"))
    leaves = leaves.union(firsts.select(shard, F.lit(RISING), "u", "u", "sale", "no", "item"))

    priced = items.select(F.col("item_id").cast("long").alias("item_id"), cents(F.col("price")).alias("p")).distinct()
    p = F.col("p")
    high = F.when(p >= 0, p + F.greatest(F.lit(least_gap), F.call_function("div", p * permille, F.lit(1000)))).otherwise(p + least_gap)
    low = F.when(p >= 0, F.least(p - least_gap, F.call_function("div", p * 1000 + (999 + permille), F.lit(1000 + permille)))).otherwise(p - least_gap)
    priced = materialize(priced.withColumns({"low": low.cast("long"), "high": high.cast("long")}), "band-items")
    prices = priced.where("p IS NOT NULL AND item_id IS NOT NULL").select("p", "low", "high").distinct()
    bands = prices.select("p", F.explode(F.array(F.struct(F.col("low"), F.col("p").alias("high"), F.lit(False).alias("rise")), F.struct((p + 1).alias("low"), F.col("high"), F.lit(True).alias("rise")))).alias("x")).select("p", "x.low", "x.high", "x.rise")

    widest = prices.agg(F.max(F.greatest(F.col("high") - F.col("p"), F.col("p") - F.col("low") + 1))).first()[0] or 0
    answers, tier = [], 0
    while True:
        flat, bands = _pieces(bands)
        met = leaves.union(flat).groupBy("shard").applyInPandas(lambda rows: _answer(rows, first), FLAT)
        met = materialize(met, f"band-tier{tier}")
        answers.append(met.where(F.col("kind") >= SUMS))
        tier += 1
        if WIDTH**tier > widest:  # no band covers a whole shard
            break
        leaves = met.where(F.col("kind") < QUERY).select(F.floor(F.col("at") / F.lit(WIDTH)).cast("long").alias("shard"), "kind", "at", "a", "b", "c", "d")
    found = answers[0]
    for more in answers[1:]:
        found = found.union(more)
    entry = F.struct(F.abs(F.col("a") - F.col("at")).alias("gap"), F.col("a").alias("u"), F.col("b").alias("sale_id"), F.col("c").alias("line_no"), F.col("d").alias("line_item_id"))
    # of one price: two pieces a tier and half at most, each with 2 * first lines
    by_price = found.groupBy(F.col("at").alias("p")).agg(
        F.sum(F.when(F.col("kind") == SUMS, F.col("a"))).alias("n"), F.sum(F.when(F.col("kind") == SUMS, F.col("b"))).alias("gaps"), F.sum(F.when(F.col("kind") == SUMS, F.col("c"))).alias("crc"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == FIRST, entry))).alias("near"),
    )
    by_price = materialize(by_price, "band-prices")  # so that a join with a price of many items can be split
    ids = priced.where("p IS NOT NULL AND item_id IS NOT NULL").select("item_id", "p", "low", "high")
    mine = summed.join(ids.hint("merge"), (F.col("item") == F.col("item_id")) & F.col("u").between(F.col("low"), F.col("high")))
    mine = mine.groupBy("item_id", "p").agg(F.sum("n").alias("own_n"), F.sum(F.abs(F.col("u") - F.col("p")) * F.col("n")).alias("own_gaps"), F.sum("crc").alias("own_crc"))
    both = priced.select("item_id", "p").join(mine.hint("merge"), ["item_id", "p"], "left").join(by_price.hint("merge"), "p", "left")
    less = lambda all_, own: F.when(F.col("item_id").isNotNull(), F.coalesce(F.col(all_), zero) - F.coalesce(F.col(own), zero)).otherwise(zero)
    both = both.select("item_id", less("n", "own_n").alias("n_pairs"), less("gaps", "own_gaps").alias("gap_sum"), less("crc", "own_crc").alias("lines_crc"), F.slice(F.filter("near", lambda e: e["line_item_id"] != F.col("item_id")), 1, first).alias("near"))
    shown = both.select("item_id", "n_pairs", "gap_sum", "lines_crc", F.posexplode_outer("near").alias("k", "e"))
    line_no = F.when(F.col("e.line_no") != NO_LINE, F.col("e.line_no"))
    return shown.select("item_id", F.coalesce(F.col("k") + 1, F.lit(0)).cast("int").alias("rank"), "e.gap", "e.u", "e.sale_id", line_no.alias("line_no"), "e.line_item_id", "n_pairs", "gap_sum", "lines_crc")


def op11_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band_join(spark.read.parquet(f"{sf_dir}/sale_lines.parquet"), spark.read.parquet(f"{sf_dir}/items.parquet"))
