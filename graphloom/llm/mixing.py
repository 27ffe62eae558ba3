"""Mixing sources to target weights by pivotal dependent rounding.

A source's share of all words is proportional to its weight and stops at
``max_repeats`` times its own words; the excess goes to the others by weight.
The fixed point has a closed form: with sources in the order of cap / weight,
one is at its cap if that ratio is no more than what is left for each unit of
weight.  Every document of a source should then be taken target / size times:
the whole part of that for sure, the fraction with dependent rounding.

The fraction of a document is a mass in words.  Documents are dealt to blocks
of about ``BLOCK``; inside a block one document carries a fraction and meets
the others, largest first: mass moves one way or the other, with chances that
keep every expectation, until one of the two has a whole number.  The words of
the block are kept exactly.  One residual is left to each block, and residuals
are dealt to blocks again: a reduction tree with log_BLOCK(n) levels, in which
no task ever holds more than some blocks, whatever one source's part of the
rows.  The last residual of a source is rounded to the nearer side, so a
source misses its target by at most half of one document.

Draws come from hashes of the documents met, so reruns agree.  All of it is
DataFrame and SQL functions.

Nulls and edge cases: a null or blank text has size 0, and takes 0 words; a
null source is a source of its own, last in order; null ids are allowed;
repeated rows are rounded separately; an empty table gives an empty result.
One row per source is ordered in one task (there are as many as sources).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import WORD_PATTERN, documents, gathered, materialize

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Documents that meet in one step of the tree, on average.
BLOCK = 128
SEED = 20240601


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, share: float = 1.0) -> DataFrame:
    """source, source_size, n, target from rows (source, size)."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    own = own.withColumn("weight", cycle).withColumn("cap", F.col("source_size") * float(max_repeats))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    units = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    own = own.withColumn("full", F.col("cap") * units <= left * F.col("weight")).withColumn("all_words", F.sum("source_size").over(everything) * share)
    rest = F.try_divide(F.col("all_words") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(rest * F.col("weight"), F.col("cap")))
    return own.select("source", "source_size", "n", target.alias("target"))


#: What a document meets in its block: acc.c carries a fraction, x is next. k tells which of the two becomes whole, and how.
_DRAW = f"(shiftrightunsigned(xxhash64({SEED}, acc.c.h, x.h), 11) / 9007199254740992D)"
_TO_C, _TO_X = "least(acc.c.size - acc.c.mass, x.mass)", "least(acc.c.mass, x.size - x.mass)"
_CASE = f"CASE WHEN {_DRAW} * ({_TO_C} + {_TO_X}) < {_TO_X} THEN IF(acc.c.size - acc.c.mass <= x.mass, 0, 1) ELSE IF(acc.c.mass <= x.size - x.mass, 2, 3) END"
_ITEM = "struct<size:bigint,h:bigint,doc_id:bigint,row:bigint,mass:double>"


def _with_mass(item: str, mass: str) -> str:
    return f"named_struct('size', {item}.size, 'h', {item}.h, 'doc_id', {item}.doc_id, 'row', {item}.row, 'mass', {mass})"


def _done(item: str, up: int) -> str:
    return f"array(named_struct('doc_id', {item}.doc_id, 'row', {item}.row, 'size', {item}.size, 'up', {up}))"


_MEET = f"""
aggregate(slice(items, 2, size(items)),
  named_struct('c', items[0], 'done', cast(array() AS array<struct<doc_id:bigint,row:bigint,size:bigint,up:int>>)),
  (acc, x) -> transform(array({_CASE}), k -> CASE
    WHEN k = 0 THEN named_struct('c', {_with_mass('x', 'x.mass - (acc.c.size - acc.c.mass)')}, 'done', concat(acc.done, {_done('acc.c', 1)}))
    WHEN k = 1 THEN named_struct('c', {_with_mass('acc.c', 'acc.c.mass + x.mass')}, 'done', concat(acc.done, {_done('x', 0)}))
    WHEN k = 2 THEN named_struct('c', {_with_mass('x', 'x.mass + acc.c.mass')}, 'done', concat(acc.done, {_done('acc.c', 0)}))
    ELSE named_struct('c', {_with_mass('acc.c', 'acc.c.mass - (x.size - x.mass)')}, 'done', concat(acc.done, {_done('x', 1)})) END)[0])
"""


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, h (a hash of the row), source, size, source_size, target, copies of every row."""
    text = docs[text_col].cast("string")
    sized = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[id_col].cast("long"), text, docs[source_col]).alias("h"), docs[source_col].alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"), F.spark_partition_id().alias("part_id"),
    )
    sized = materialize(sized, "sizes")
    targets = materialize(source_targets(sized, weights, max_repeats, share), "targets")
    rate = F.coalesce(F.least(F.try_divide(F.col("target"), F.col("source_size")), F.lit(float(max_repeats))), F.lit(0.0))
    rated = targets.select(F.col("source").alias("s"), "source_size", "target", "n", F.floor(rate).cast("int").alias("base"), (rate - F.floor(rate)).alias("part"))
    rows = sized.join(rated, sized["source"].eqNullSafe(rated["s"])).drop("s")
    keys = ["source", "source_size", "target", "base"]
    whole = (F.col("part") == 0) | (F.col("size") == 0)
    out = rows.where(whole).select("doc_id", F.col("h").alias("row"), "size", *keys, F.lit(0).alias("up"))
    # equal rows of one task are told apart, so they spread over the blocks; a block gets one of each task at most
    turn = F.row_number().over(Window.partitionBy("h", "part_id").orderBy("h"))
    told = rows.where(~whole).withColumn("draw", F.xxhash64("h", turn))
    active = told.select(*keys, F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("long").alias("blocks"), F.struct("size", F.col("draw").alias("h"), "doc_id", F.col("h").alias("row"), (F.col("part") * F.col("size")).alias("mass")).cast(_ITEM).alias("item"))
    most, level = max((targets.agg(F.max("n")).first()[0] or 0) / BLOCK, 1.0), 0
    while True:
        block = F.pmod(F.xxhash64(F.lit(SEED), F.lit(level), F.col("item.h")), F.col("blocks"))
        met = active.groupBy(*keys, "blocks", block.alias("block")).agg(F.reverse(F.array_sort(F.collect_list("item"))).alias("items")).select(*keys, "blocks", F.expr(_MEET).alias("met"))
        met = materialize(met, f"mix-{level}")
        out = out.union(met.select(*keys, F.explode("met.done").alias("d")).select("d.doc_id", "d.row", "d.size", *keys, "d.up"))
        if most <= 1:
            break
        active = met.select(*keys, F.ceil(F.col("blocks") / BLOCK).alias("blocks"), F.col("met.c").alias("item"))
        most, level = most / BLOCK, level + 1
    last = met.select(*keys, "met.c.*").select("doc_id", "row", "size", *keys, (F.col("mass") * 2 >= F.col("size")).cast("int").alias("up"))
    return out.union(last).select("doc_id", F.col("row").alias("h"), "source", "size", "source_size", "target", (F.col("base") + F.col("up")).alias("copies"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the same columns.

    Rows without words come as often as the whole part of their source's rate;
    a null source is a source of its own; rows equal in id, text and source
    share what the mix takes of them, and what does not divide evenly goes to
    one of them; other columns may have any name; an empty table stays empty.
    """
    counts = mix(docs, **options).groupBy("doc_id", "h").agg(F.sum("copies").alias("all"), F.count("*").alias("rows"))
    counts = materialize(counts.select(F.col("doc_id").alias("to_id"), F.col("h").alias("to_h"), F.expr("cast(all div rows AS int)").alias("each"), F.expr("cast(all % rows AS int)").alias("more")), "copies")
    # other columns, whatever their names, are inside ``row``
    hashed = docs.select(F.struct("*").alias("row"), F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"), docs["source"]).alias("h"), docs["doc_id"].cast("long").alias("id"))
    same = (F.col("h") == F.col("to_h")) & F.col("id").eqNullSafe(F.col("to_id"))
    times = lambda df, n: df.select("row", F.explode(F.expr(f"array_repeat(0, {n})"))).select("row.*")
    out = gathered(times(hashed.join(counts.where("each > 0"), same), "each"), docs)
    more = counts.where("more > 0")  # of repeated rows only
    return out if more.isEmpty() else out.union(times(hashed.join(more, same).dropDuplicates(["to_h", "to_id"]), "more"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return gathered(mix(docs), docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
