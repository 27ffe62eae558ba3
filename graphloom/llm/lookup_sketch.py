"""Invertible Bloom lookup sketches of documents' paragraphs.

A document is the set of its paragraphs' (lines') 64-bit digests.  Its sketch
has three rows of cells; a digest goes to one cell of each row, and a cell
keeps how many it got, the exclusive or of them and that of their checks.
Sketches of equal sets are equal, and subtracting one from another leaves the
digests in which two documents differ: a cell with exactly one of them shows
it, taking it out of its other cells uncovers more, and so on (peeling).

If that fails the sketch was too small.  The retry is larger: digests are
dealt to as many sketches as the two documents' counts call for, each is
subtracted and peeled alone, and those that still fail are split again.  The
differences found give the exact likeness |A and B| / |A or B|.

All of it is DataFrame and SQL functions: arrays of 24 cells inside a row, and
for retries one row per small sketch, so no step holds more than one document.
The neighbour in id order is found from ids alone (ranges, not one task), and
a text is shuffled once, with half of its neighbour's.

Nulls and edge cases: a null text is an empty one, with one empty paragraph; a
null id comes before all others; rows that share an id share their next
document, which is the least row (by text) of the next larger id; a single
document is its own next; repeated rows keep their rows; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import documents, gathered, materialize

#: Cells in one row of a sketch (a power of two), and rows.
CELLS, ROWS = 8, 3
#: Rounds of peeling; all cells that show a digest go at once.
PEELS = 8
#: Digests for each sketch of the first retry, on average, and how far failing ones are split again.
LOAD, SPLIT = 8, 4
_NO_ID = -(1 << 63)

_CHECK = "(xxhash64({k}) & 4294967295L)"
_IN = f"(shiftrightunsigned({{k}}, cast({{i}} div {CELLS} as int) * 20) & {CELLS - 1}) = {{i}} % {CELLS}"


def sketch(keys: str) -> str:
    """SQL of the cells of an array of distinct digests."""
    k = _CHECK.format(k="k")
    return (
        f"transform(sequence(0, {ROWS * CELLS - 1}), i -> transform(array(filter({keys}, k -> {_IN.format(k='k', i='i')})), "
        f"f -> named_struct('n', size(f), 'key', aggregate(f, 0L, (s, k) -> s ^ k), 'chk', aggregate(f, 0L, (s, k) -> s ^ {k})))[0])"
    )


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'key', x.key ^ y.key, 'chk', x.chk ^ y.chk))"


def peel(cells: str) -> str:
    """SQL of (cells left, digests in the first only, digests in the second only) after peeling ``cells``."""
    shown = f"array_distinct(transform(filter(st.cells, c -> abs(c.n) = 1 AND c.chk = {_CHECK.format(k='c.key')}), c -> named_struct('key', c.key, 'sign', c.n)))"
    without = f"transform(cs, (c, i) -> IF({_IN.format(k='p.key', i='i')}, named_struct('n', c.n - p.sign, 'key', c.key ^ p.key, 'chk', c.chk ^ {_CHECK.format(k='p.key')}), c))"
    one = (
        f"transform(array({shown}), shown -> named_struct('cells', aggregate(shown, st.cells, (cs, p) -> {without}), "
        f"'first', concat(st.first, transform(filter(shown, p -> p.sign = 1), p -> p.key)), 'second', concat(st.second, transform(filter(shown, p -> p.sign = -1), p -> p.key))))[0]"
    )
    empty = "cast(array() AS array<bigint>)"
    # over twenty in 24 cells never peel: leave them to a larger sketch
    hopeless = f"aggregate(slice(d, 1, {CELLS}), 0, (s, c) -> s + abs(c.n)) > {20 * CELLS * ROWS // 24}"
    return (
        f"transform(array({cells}), d -> IF({hopeless}, named_struct('cells', d, 'first', {empty}, 'second', {empty}), "
        f"aggregate(sequence(1, {PEELS}), named_struct('cells', d, 'first', {empty}, 'second', {empty}), (st, r) -> {one})))[0]"
    )


def _peeled() -> Column:
    return F.expr("forall(got.cells, c -> c.n = 0 AND c.key = 0 AND c.chk = 0)")


def digests(text: Column) -> Column:
    """Distinct paragraph digests of a text."""
    return F.array_distinct(F.transform(F.split(text, "\n"), lambda p: F.xxhash64(p)))


def fingerprint_text(cells: Column) -> Column:
    """Hexadecimal cells: eight digits of the count (a text has fewer paragraphs than 2**31), sixteen of the digests, eight of the checks."""
    part = lambda c: F.concat(F.lpad(F.hex(c["n"]), 8, "0"), F.lpad(F.hex(c["key"]), 16, "0"), F.lpad(F.hex(c["chk"]), 8, "0"))
    return F.lower(F.array_join(F.transform(cells, part), ""))


def differences(pairs: DataFrame) -> DataFrame:
    """(pair, first_only, second_only): numbers of digests that peeling recovers on one side only. ``pairs``: pair (unique), a, b (arrays of distinct digests), ca, cb (their sketches)."""
    tried = materialize(pairs.select("pair", "a", "b", F.expr(peel(subtract("ca", "cb"))).alias("got")).withColumn("done", _peeled()).select("pair", F.when(~F.col("done"), F.col("a")).alias("a"), F.when(~F.col("done"), F.col("b")).alias("b"), "done", F.size("got.first").alias("first_only"), F.size("got.second").alias("second_only")), "peeled")
    found = tried.where("done").select("pair", "first_only", "second_only")
    # as many sketches as both counts call for
    parts = F.expr(f"shiftleft(1L, cast(ceil(log2(greatest(1, (size(a) + size(b)) / {LOAD}))) as int))")
    keys = F.expr("concat(transform(a, k -> named_struct('k', k, 's', 1)), transform(b, k -> named_struct('k', k, 's', -1)))")
    left = tried.where("NOT done").select("pair", parts.alias("parts"), F.explode(keys).alias("x")).select("pair", F.expr("xxhash64(x.k, 0) & (parts - 1)").alias("part"), "x")
    level = 0
    while True:
        grouped = left.groupBy("pair", "part").agg(F.collect_list("x").alias("xs"))
        side = lambda s: f"transform(filter(xs, x -> x.s = {s}), x -> x.k)"
        got = grouped.select("pair", "part", "xs", F.expr(peel(subtract(sketch(side(1)), sketch(side(-1))))).alias("got")).withColumn("done", _peeled())
        got = materialize(got.select("pair", "part", "done", F.when(~F.col("done"), F.col("xs")).alias("xs"), F.size("got.first").alias("first_only"), F.size("got.second").alias("second_only")), f"peeled-{level}")
        found = found.union(got.where("done").select("pair", "first_only", "second_only"))
        failed = got.where("NOT done")
        if failed.isEmpty():
            return found.groupBy("pair").agg(F.sum("first_only").alias("first_only"), F.sum("second_only").alias("second_only"))
        level += 1
        left = failed.select("pair", "part", F.explode("xs").alias("x")).select("pair", F.expr(f"xxhash64(part, xxhash64(x.k, {level}) & {SPLIT - 1})").alias("part"), "x")


def next_ids(ids: DataFrame) -> tuple[DataFrame, bool]:
    """((key, next_key, want) per distinct key in a ring of ascending keys, whether keys repeat). ``ids``: key, half."""
    ranged = materialize(ids.repartitionByRange("key").select(F.spark_partition_id().alias("range"), "key", "half"), "ranges")
    distinct = ranged.groupBy("range", "key").agg(F.max("half").alias("want"), F.count("*").alias("n"))
    firsts = distinct.groupBy("range").agg(F.min("key").alias("first"), F.max("n").alias("n"))
    in_order = Window.orderBy("range")  # one row a range
    firsts = materialize(firsts.select("range", "n", F.coalesce(F.lead("first").over(in_order), F.min("first").over(Window.partitionBy())).alias("after")), "firsts")
    repeats = bool((firsts.agg(F.max("n")).first()[0] or 0) > 1)
    inside = F.lead("key").over(Window.partitionBy("range").orderBy("key"))
    return distinct.withColumn("inside", inside).join(firsts.select("range", "after"), "range").select("key", F.coalesce("inside", "after").alias("next_key"), "want"), repeats


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: key, n_chars, edited_sha256 and the digests of the text (a), its edited text (e) and the next document (n)."""
    texts = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)).alias("key"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    ring, repeats = next_ids(texts.select("key", F.floor(F.char_length("text") / 2).cast("int").alias("half")))
    ring = materialize(ring, "ring")
    sent = texts.join(ring.select(F.col("key").alias("to"), "next_key", "want"), F.col("key") == F.col("next_key")).select("to", F.expr("substring(text, 1, want)").alias("start"), digests(F.col("text")).alias("n"))
    if repeats:
        sent = sent.groupBy("to").agg(F.min(F.struct("start", "n")).alias("x")).select("to", "x.start", "x.n")
    both = texts.join(sent, F.col("key") == F.col("to"))
    half = "cast(floor(char_length(text) / 2) as int)"
    both = both.withColumn("edited", F.expr(f"concat(substring(text, 1, char_length(text) - {half}), substring(start, 1, {half}))"))
    return both.select("key", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("e"), "n")


def edited_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and edited_sha256 alone."""
    return with_edited(docs).select(F.nullif("key", F.lit(_NO_ID)).alias("doc_id"), "n_chars", "edited_sha256")


def likeness(difference: Column, a: Column, b: Column) -> Column:
    return (F.size(a) + F.size(b) - difference) / (F.size(a) + F.size(b) + difference)


def op6_lookup_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = materialize(with_edited(docs).withColumn("row", F.monotonically_increasing_id()), "digests")
    cells = materialize(rows.select("row", "key", "n_chars", "edited_sha256", "a", "e", "n", F.expr(sketch("a")).alias("ca"), F.expr(sketch("e")).alias("ce")), "sketches")
    pair = lambda k, b, cb: cells.select((F.col("row") * 2 + k).alias("pair"), "a", F.col(b).alias("b"), "ca", cb.alias("cb"))
    found = differences(pair(0, "e", F.col("ce")).union(pair(1, "n", F.expr(sketch("n")))))
    both = found.groupBy(F.floor(F.col("pair") / 2).alias("row")).agg(*(F.sum(F.when(F.col("pair") % 2 == k, F.col("first_only") + F.col("second_only"))).alias(name) for k, name in enumerate(("de", "dn"))))
    out = gathered(cells.join(both, "row"), docs)
    return out.select(
        F.nullif("key", F.lit(_NO_ID)).alias("doc_id"), "n_chars", "edited_sha256", fingerprint_text(F.col("ca")).alias("fingerprint"), fingerprint_text(F.col("ce")).alias("edited_fingerprint"),
        likeness(F.col("de"), F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("dn"), F.col("a"), F.col("n")).alias("near_next"),
    )
