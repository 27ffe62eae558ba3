"""Similarity join of names: pairs whose matching-block ratio reaches a threshold, without comparing all.

The ratio is ``2 * m / (a + b)`` for lengths a and b and m characters in
matching blocks.  The blocks are a common subsequence, so at most ``a - m``
characters of one name and ``b - m`` of the other are outside it.  Each of the
former takes part in at most q of a name's q-grams, each of the latter parts
at most q - 1 of them.  Hence

* lengths differ by a factor of ``threshold / (2 - threshold)`` at most;
* of the grams in an order shared by all names (rarest first), the first
  ``lost + 1`` of both names have one in common, where ``lost`` is the most
  grams that a name may lose to any partner (to the shortest, as a pair may
  lose less the longer the other is, where q is 1 or the threshold is above
  ``2 * (q - 1) / (2 * q - 1)``);
* behind the first gram in common, both must have as many as are still needed.

Names below a length have too few grams of q characters to lose some, so they
are joined by their characters.

Grams of three characters are frequent in short names.  Up to a length, names
are therefore joined by longer pieces: the shorter one is cut into one segment
more than there are characters outside the blocks, so one segment is whole in
the longer name, no further from its place than characters are lost or added
before it.  Segment, number and both lengths are the key.

Of either kind of pair, the characters that occur an odd number of times must
be as alike as the ratio asks for (``bag``, a bit for each of 64 classes of
characters).  Only pairs that meet all these bounds are compared.  No pair is
left out, at any threshold above zero.

Nulls and edge cases: null and empty names pair with none; names that differ
in case only have ratio 1; repeated names count once; the ratio of names of 200
characters and more leaves out their popular characters and the bounds hold
for it too, as they do for either order of the two names (which may have two
ratios: left to right counts).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.scalar import similarity_ratio
from .traverse import checkpointed

#: The longest grams; fewer characters where the threshold lets names lose more.
MOST_GRAM = 3
#: Pieces of a name that may be another's segment, and length: names up to which are joined by segments.
MOST_PIECES, MOST_LENGTH = 256, 64


@F.pandas_udf(T.StringType())
def lowered(values: pd.Series) -> pd.Series:
    """Lower case as the ratio takes it, which decides lengths and grams."""
    return values.str.lower()


def plan(threshold: float) -> tuple[int, int, int]:
    """(q, length from which names have grams of q, length below which they have characters)."""
    loss = (2 - 2 * threshold) / (2 - threshold)
    q = next(q for q in range(MOST_GRAM, 0, -1) if q == 1 or q * loss < 0.75)
    if q == 1:
        return 1, 1, 1
    least = math.ceil(q / (1 - q * loss)) + 1
    # below this a partner may be shorter than ``least``; one more for rounding
    return q, least, math.ceil(least * (2 - threshold) / threshold) + 1


def segments(threshold: float) -> tuple[int, list[tuple], list[tuple]]:
    """Length up to which names are joined by segments; the segments of shorter names and the pieces of longer ones that may be such: (short, long, number, from, size)."""
    longest, cuts, pieces = 0, [], []
    while longest < MOST_LENGTH:
        b, of_b, in_b = longest + 1, [], []
        for a in range(1, b + 1):
            need = math.ceil(threshold * (a + b) / 2 - 1e-9)
            lost, added = a - need, b - need
            if lost < 0:
                continue
            parts = lost + added + 1
            if parts > a:
                return longest, cuts, pieces
            for k in range(parts):
                at, size = a * k // parts, a * (k + 1) // parts - a * k // parts
                of_b.append((a, b, k, at + 1, size))
                in_b += [(a, b, k, x + 1, size) for x in range(max(0, at - lost), min(b - size, at + added) + 1)]
        if len(in_b) > MOST_PIECES:
            break
        longest, cuts, pieces = b, cuts + of_b, pieces + in_b
    return longest, cuts, pieces


def _lost(threshold: float, slack: float = 1e-9):
    """Most grams that a name of length n may lose to any partner."""
    return F.floor(F.col("q") * F.col("n") * (2 - 2 * threshold) / (2 - threshold) + slack)


def _prefixes(names: DataFrame, threshold: float) -> DataFrame:
    """name, low, n, key (gram), place (from 1), of (number of grams): each name's rarest grams."""
    q, least, short = plan(threshold)

    def grams(size: int, rows: DataFrame) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(1), F.col("n") - size + 1), lambda i: F.substring("low", i, F.lit(size)))
        return rows.select("low", "n", F.lit(size).alias("q"), F.array_distinct(cut).alias("grams"))

    cut = grams(q, names.where(F.col("n") >= least))
    if q > 1:
        cut = cut.unionByName(grams(1, names.where(F.col("n") < short)))
    cut = checkpointed(cut)
    held = cut.select("low", "n", "q", F.size("grams").alias("of"), F.explode("grams").alias("gram"))
    often = held.groupBy("q", "gram").agg(F.count("*").alias("often"))
    order = Window.partitionBy("low", "q").orderBy("often", "gram")
    ranked = held.join(often, ["q", "gram"]).withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= _lost(threshold) + 1).select("low", "n", "q", "gram", "place", "of")


def near_names(left: DataFrame, right: DataFrame, threshold: float = 0.92) -> DataFrame:
    """name, other, ratio: each different name of ``left`` with each of ``right`` (column ``name``) that is as near; the name itself is one.

    Names that share a frequent gram are spread by their length, too; where
    one such group is still large, the join is split at run time.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    sides = [checkpointed(x.select("name").where("name <> ''").distinct().withColumn("low", lowered("name")).withColumn("n", F.length("low"))) for x in (left, right)]
    pairs = candidates(*sides, threshold)
    # many are made from few names, so the comparisons are spread
    pairs = pairs.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "low", "other_low")
    near = pairs.withColumn("ratio", similarity_ratio("low", "other_low")).where(F.col("ratio") >= threshold)
    found = near.join(sides[0].select("name", "low"), "low").join(sides[1].select(F.col("name").alias("other"), F.col("low").alias("other_low")), "other_low")
    return found.select("name", "other", "ratio")


def candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """low, other_low: pairs of names (columns low, n) that are compared, each once."""
    marked = [x.select("low", "n", F.lit(k == 0).alias("left"), F.lit(k == 1).alias("right")) for k, x in enumerate((left, right))]
    bag = F.aggregate(F.sequence(F.lit(1), "n"), F.lit(0).cast("long"), lambda x, i: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(F.substring("low", i, F.lit(1))) % 64)))
    both = checkpointed(marked[0].union(marked[1]).groupBy("low", "n").agg(F.max("left").alias("left"), F.max("right").alias("right")).withColumn("bag", bag))
    longest, cuts, pieces = segments(threshold)
    pairs = _by_segments(both, cuts, pieces, threshold)
    if not both.where(F.col("n") > longest).isEmpty():
        # partners of longer names may be short ones
        pairs = pairs.union(_by_grams(both.where(F.col("n") > longest * threshold / (2 - threshold) - 1e-9), longest, threshold))
    return pairs.distinct()


def _may_be_near(threshold: float) -> Column:
    """Whether the characters of two names (n, bag; suffixes _a, _b) allow the ratio."""
    outside = F.col("n_a") + F.col("n_b") - 2 * F.ceil((F.col("n_a") + F.col("n_b")) * threshold / 2 - 1e-9)
    return F.bit_count(F.col("bag_a").bitwiseXOR(F.col("bag_b"))) <= outside


def _by_segments(both: DataFrame, cuts: list[tuple], pieces: list[tuple], threshold: float) -> DataFrame:
    """low (left), other_low (right): candidates among names that are both short enough for segments."""

    def keyed(places: list[tuple], length: str, side: str) -> DataFrame:
        # some thousand rows at most, whatever the names
        where = both.sparkSession.createDataFrame(places, "short int, long int, number int, from int, size int")
        made = both.join(F.broadcast(where), F.col("n") == F.col(length)).withColumn("text", F.substring("low", F.col("from"), F.col("size")))
        return made.select("short", "long", "number", "text", *(F.col(c).alias(f"{c}_{side}") for c in ("low", "n", "bag", "left", "right"))).distinct()

    met = keyed(cuts, "short", "a").join(keyed(pieces, "long", "b"), ["short", "long", "number", "text"])
    met = met.where(_may_be_near(threshold))
    ways = [met.where(F.col(f"left_{x}") & F.col(f"right_{y}")).select(F.col(f"low_{x}").alias("low"), F.col(f"low_{y}").alias("other_low")) for x, y in ("ab", "ba")]
    return ways[0].union(ways[1])


def _by_grams(both: DataFrame, longest: int, threshold: float) -> DataFrame:
    """low (left), other_low (right): candidates of which one is longer than ``longest``."""
    keys = checkpointed(_prefixes(both, threshold))
    # a length's class; partners are in the same or one next to it
    ratio = threshold / (2 - threshold)
    wide = -math.log(ratio) if ratio < 1 else 1.0
    step = F.floor(F.log("n") / wide + 1e-9)
    keys = keys.join(both.select("low", "bag", "left", "right"), "low")
    a = keys.where("left").withColumn("class", F.explode(F.array(step - 1, step, step + 1)))
    b = keys.where("right").withColumn("class", step)
    a, b = (x.select("q", "gram", "class", *(F.col(c).alias(f"{c}_{k}") for c in ("low", "n", "bag", "place", "of"))) for x, k in ((a, "a"), (b, "b")))
    total = F.col("n_a") + F.col("n_b")
    most = F.least(F.col("n_a"), F.col("n_b"))
    need = F.ceil(total * threshold / 2 - 1e-9)  # characters in matching blocks
    after = 1 + F.least(F.col("of_a") - F.col("place_a"), F.col("of_b") - F.col("place_b"))
    lost_a, lost_b = F.col("n_a") - need, F.col("n_b") - need
    kept = F.greatest(F.col("of_a") - F.col("q") * lost_a - (F.col("q") - 1) * lost_b, F.col("of_b") - F.col("q") * lost_b - (F.col("q") - 1) * lost_a)
    longer = F.greatest("n_a", "n_b") > longest
    return a.join(b, ["q", "gram", "class"]).where(longer & (need <= most) & (after >= kept) & _may_be_near(threshold)).select(F.col("low_a").alias("low"), F.col("low_b").alias("other_low"))


def adopt_canonical(entities: DataFrame, threshold: float = 0.92) -> DataFrame:
    """name, canonical_name, ratio: for each name of an entity the canonical name, from whichever chunk, that it is nearest to (of several the least by text)."""
    names = entities.select("name")
    known = entities.select(F.col("canonical_name").alias("name"))
    near = near_names(names, known, threshold)
    best = near.groupBy("name").agg(F.min(F.struct((-F.col("ratio")).alias("far"), F.col("other").alias("canonical_name"))).alias("b"))
    return best.select("name", "b.canonical_name", (-F.col("b.far")).alias("ratio"))
