"""Relations between all members of a group, answered without making the pairs.

``members`` has a row per member: ``node``, ``group`` and any other columns;
two rows of one group with different nodes are one relation either way.  n
members make n * (n - 1) relations, so what can be told of ends, numbers,
components or the least keys is told from the members; where the pairs
themselves are wanted, they are made of those that are asked for, or spread so
that one large group is the work of many tasks.

Nulls and edge cases: rows without a node or a group are no members and must be
left out before; a node may be in several groups, or twice in one (then its
relations are there twice, as a join would have them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Members of a group whose pairs with all others are one part.
SLICE = 2048


def partnered(members: DataFrame) -> DataFrame:
    """Members with at least one other node in their group."""
    several = members.groupBy("group").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("group")
    return members.join(several, "group", "left_semi")


def stars(members: DataFrame) -> DataFrame:
    """(a, b): each partnered node with the least one of its group; the components are those of all pairs."""
    least = members.groupBy("group").agg(F.min("node").alias("a"))
    return members.select("group", F.col("node").alias("b")).join(least, "group").where("a <> b").select("a", "b")


def pair_counts(members: DataFrame) -> DataFrame:
    """(label, other, n): relations by the ``label`` of both ends, from numbers per group alone."""
    own = members.groupBy("group", "node", "label").agg(F.count("*").alias("n"))
    by_group = own.groupBy("group", "label").agg(F.sum("n").alias("n"))

    def times(rows: DataFrame, key: list[str], sign: int) -> DataFrame:
        other = rows.select(*key, F.col("label").alias("other"), F.col("n").alias("m"))
        return rows.join(other, key).groupBy("label", "other").agg((F.sum(F.col("n") * F.col("m")) * sign).alias("n"))

    every = times(by_group, ["group"], 1).unionByName(times(own, ["group", "node"], -1))
    return every.groupBy("label", "other").agg(F.sum("n").alias("n")).where("n > 0")


def pairs(members: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """All relations: the first end's columns with ``src`` for ``node``, and ``dst``. ``near`` (node): first ends that are asked for."""
    first, second = members.withColumnRenamed("node", "src"), members.select("group", F.col("node").alias("dst"))
    if near is None:
        made = _spread(first, second)
    else:
        made = first.join(near.select(F.col("node").alias("src")).distinct(), "src", "left_semi").join(second, "group")
    return made.where("src <> dst").drop("group")


def _spread(first: DataFrame, second: DataFrame) -> DataFrame:
    """Join by group, a large group in parts of its first ends, of which each gets all second ends.

    Sizes of what is made of few columns or repeated are underrated, so it is
    kept from being sent to the driver.
    """
    sizes = first.groupBy("group").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    first = first.join(sizes.hint("merge"), "group").withColumn("slice", F.pmod(F.xxhash64("src"), F.col("slices")).cast("int")).drop("slices")
    second = second.join(sizes.hint("merge"), "group").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    return first.join(second.hint("merge"), ["group", "slice"]).drop("slice")


def simple_pairs(members: DataFrame) -> DataFrame:
    """(a, b) with a < b, once each."""
    return simple_pairs_within(members.select("group", "node", F.lit(0).alias("community"))).select("a", "b")


def simple_pairs_within(members: DataFrame) -> DataFrame:
    """(community, a, b) with a < b, once each, of nodes that share a group and a ``community``. Only pairs of nodes that are both in several groups may repeat, so only these are compared."""
    own = members.select("community", "group", "node").distinct()
    several = own.groupBy("community", "node").agg(F.count("*").alias("groups")).where("groups > 1").select("community", "node", F.lit(True).alias("several"))
    own = own.join(several.hint("merge"), ["community", "node"], "left").withColumn("several", F.coalesce("several", F.lit(False)))

    def made(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.struct("group", "community").alias("group"), "node", "several")
        second = rows.select("group", F.col("node").alias("dst"), F.col("several").alias("other_several"))
        return _spread(rows.withColumnRenamed("node", "src"), second).where("src < dst").select("group.community", F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("several") & F.col("other_several")).alias("again"))

    return made(own).where("NOT again").drop("again").unionByName(made(own.where("several")).drop("again").distinct())


def repeated(members: DataFrame) -> DataFrame:
    """(src, dst) of relations that are there more than once: one of their ends has more than one row."""
    many = members.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    some, every = members.join(many, "node", "left_semi").select("group", "node"), members.select("group", "node")
    out = pairs(some.join(many, "node", "left_semi")).select("src", "dst")  # both ends
    single = every.join(many, "node", "left_anti")
    one_way = _spread(some.select("group", F.col("node").alias("src")), single.select("group", F.col("node").alias("dst"))).select("src", "dst")
    out = out.unionByName(one_way).unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return out.groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1").select("src", "dst")


def least_pairs(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """(src, dst): the ``limit`` least relations by src and dst, their texts ended by a bar, of first ends ``first`` with second ends ``second``.

    Each first end that has a partner has a pair, and pairs go by their first
    end, so no other first ends than the ``limit`` least are joined.
    """
    spans = second.groupBy("group").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    ended = F.concat("node", F.lit("|"))
    top = first.join(spans, "group").where("lo <> node OR hi <> node").select("group", F.col("node").alias("src"), ended.alias("by")).orderBy("by").limit(limit)
    made = F.broadcast(top).join(second.select("group", F.col("node").alias("dst")), "group").where("src <> dst")  # ``limit`` rows
    return made.orderBy("by", "dst").limit(limit).select("src", "dst")
