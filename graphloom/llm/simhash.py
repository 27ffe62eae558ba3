"""SimHash near-duplicates with multi-index hashing.

A fingerprint is the bitwise majority of the XXH64 values of a text's word
shingles.  Equal fingerprints fall into one class first, so copies are never
paired.  The classes' fingerprints are split into segments: two that differ in
at most ``distance`` bits differ in at most distance // segments bits of some
segment.  Each fingerprint therefore looks up the small Hamming ball around
each of its segments in that segment's table, and matches are kept if the
complete distance is small enough.  Links join classes to components.

Two segments of 32 bits and balls of radius 1 need 66 lookups a fingerprint
and meet a random other one once in 2**26, so candidates stay few at any size.

Nulls and edge cases: a null, empty or blank text has fingerprint zero and is
linked like any other; a text with fewer words than a shingle gives one
shingle, the whole sequence; a null id takes part but is no component's id
(the id is null if there is no other); repeated rows share a class; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import documents, drop_shared, gathered, materialize, release
from .components import components

SEED = 42
#: Segments of the index; with distance 3, balls of radius 1.
SEGMENTS = 2


def _hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of a text's shingles in order."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.empty(0, dtype=np.uint64)
    shingles = map(b" ".join, zip(*(own[k:] for k in range(words)))) if len(own) > words else [b" ".join(own)]
    hash64 = xxhash.xxh64_intdigest
    return np.fromiter((hash64(x, SEED) for x in shingles), dtype=np.uint64)


def _majority(h: np.ndarray) -> int:
    """Signed 64-bit SimHash: bits that more than half of the hashes have. Hashes are unpacked in slices, so long texts need no 64 bytes for each."""
    big, ones = h.astype(">u8"), np.zeros(64, dtype=np.int64)
    for k in range(0, len(big), 1 << 16):
        ones += np.unpackbits(big[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Signed 64-bit SimHash of one text."""
    h = _hashes(text, words)
    return _majority(h) if len(h) else 0


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (signed 64-bit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, words) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def linked(classes: DataFrame, distance: int = 3, segments: int = SEGMENTS) -> DataFrame:
    """Pairs a < b of fingerprints (column fp, distinct) that differ in at most ``distance`` bits."""
    width, radius = 64 // segments, distance // segments
    if radius > 1:
        raise ValueError("more segments are needed: balls of radius 0 or 1 only")
    # each fingerprint becomes many rows, so the few bytes that they are made from are spread first
    classes = classes.select("fp").repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    mask = (1 << width) - 1

    def table(name: str, ball: bool) -> DataFrame:
        """(segment, key, fp): the fingerprint's own segments, or the balls around them."""
        flips = ["0L", *(f"{1 << k}L" for k in range(width))] if ball and radius else ["0L"]
        one = lambda k: f"transform(array({', '.join(flips)}), x -> struct({k} AS segment, (shiftrightunsigned(fp, {k * width}) & {mask}L) ^ x AS key))"
        return classes.select(F.col("fp").alias(name), F.explode(F.expr(f"concat({', '.join(map(one, range(segments)))})")).alias("s")).select(name, "s.segment", "s.key")

    probes, tables = table("a", True), table("b", False)
    near = (F.col("a") < F.col("b")) & (F.expr("bit_count(a ^ b)") <= distance)
    return probes.join(tables, (probes["segment"] == tables["segment"]) & (probes["key"] == tables["key"]) & near).select("a", "b")


def simhash_groups(docs: DataFrame, words: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id of every row."""
    own = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(linked(classes, distance))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(rooted.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


#: Drawn holders of a key that its other texts meet in the first round, besides the least and the greatest; they change no result.
HOLDERS = 1
#: Holders from which a shingle is common, and common shingles that are put last in every prefix; they change no result.
COMMON, COMMON_KEPT = 16, 50_000
#: Longs of a set's bitmap: each bit tells whether an odd number of its shingles fall there.
BITMAP = 4
#: Bits of the widest bitmap of a set.
WIDEST = 1 << 24
#: Shared keys just before a key's place by which a pair is known to have met already; they change no result.
BEFORE = 4


def _profile(text: str | None, words: int) -> tuple[int, int, np.ndarray]:
    """SimHash, number of distinct shingles, and their hashes (32 bits each), ascending."""
    h = _hashes(text, words)
    if not len(h):
        return 0, 0, np.empty(0, dtype=np.int64)
    least = np.unique(h >> np.uint64(32)).astype(np.int64)
    return _majority(h), len(least), least


def _bitmap(least: np.ndarray) -> np.ndarray:
    """About a bit for each shingle: two sets that differ in d shingles have bitmaps that differ in at most d bits, also when folded."""
    wide = min(max(64 * BITMAP, 1 << max(len(least) - 1, 1).bit_length()), WIDEST)
    bit = ((least.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (wide - 1)
    return np.packbits(np.bincount(bit, minlength=wide).astype(np.uint8) & 1)


def _folded(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set in ``size`` bytes."""
    while len(bitmap) > size:
        bitmap = bitmap[: len(bitmap) // 2] ^ bitmap[len(bitmap) // 2 :]
    return bitmap


def _prefix(least: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles of which two sets share one if they share ``similarity`` of the larger: the first in an order that puts common ones last.

    ``common`` is ascending, and ``rank`` is the place of each in the order.
    """
    if len(common):
        at = np.minimum(np.searchsorted(common, least), len(common) - 1)
        late = common[at] == least
        least = np.concatenate([least[~late], least[late][np.argsort(rank[at[late]], kind="stable")]])
    return least[: len(least) - math.ceil(similarity * len(least) - 1e-9) + 1]


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, h, first) of each distinct row: h is a hash of its text, first says whether it is its group's first.

    Multi-index hashing of the texts' SimHashes, as in ``linked``, finds near
    texts first.  What it may miss comes from a prefix filter over the keys
    whose holders are not in one group by then, which misses no pair: sets
    that are similar enough share one of the first shingles of each.  Of what a
    pair shares, the first such key in order comes before all the rest, so both
    sets have enough shingles from there on; the smaller set has even twice
    the share of its own, and only such rows of a key are looked up.  Sets
    whose bitmaps differ in more bits than similar ones may are no candidates,
    and a pair that shares one of the last keys before has met there.  All
    four are conditions of the join, which leave few pairs to verify.

    There each text meets a few holders of each of its keys.  Then, in keys
    whose holders are still not in one group, every two of different groups
    meet, so each pair is verified or joined by others, and large groups of
    copies are not paired.  Each candidate is verified by wider bitmaps and
    then by the similarity of the whole shingle sets, and verified links are
    joined to groups.

    Null, empty and blank texts have no words and are left alone, each its own
    group; texts of fewer words have one shingle, the whole sequence; null ids
    are last in order and never stand for a group that has others; rows equal
    in id and text are one; other columns are ignored; an empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                fp, n, least = zip(*(_profile(t, words) for t in part.column(2).to_pylist()))
                wide = [_bitmap(x) for x in least]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp, pa.int64()), pa.array(n, pa.int32()), pa.array([x.astype(np.uint32).view(np.int32) for x in least], pa.list_(pa.int32())), pa.array([x.tobytes() for x in wide], pa.binary()), *map(pa.array, np.array([_folded(x, 8 * BITMAP).view(np.int64) for x in wide]).T.copy())], names=["doc_id", "h", "fp", "n", "least", "wide", *bits])

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        values, ends = column.values.to_numpy().view(np.uint32), column.offsets.to_pylist()
        return (values[x:y] for x, y in zip(ends, ends[1:]))

    def unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaves out pairs whose wide bitmaps differ in more bits than similar sets' may."""
        for b in batches:
            good = []
            for p, q, total in zip(b.column(2), b.column(3), b.column(4).to_pylist()):
                p, q = (np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in (p, q))
                size = min(len(p), len(q))
                good.append(int(np.bitwise_count(_folded(p, size) ^ _folded(q, size)).sum(dtype=np.int64)) <= (1 - similarity) / (1 + similarity) * total + 1e-6)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for p, q in zip(sets(b.column(2)), sets(b.column(3))):
                shared = len(np.intersect1d(p, q, True))
                good.append(shared >= similarity * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Those ``pairs`` that are near: first by bitmaps, then by the sets of what is left."""
        side = lambda table, k, *of: table.select(F.col("uid").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in of))
        both = pairs.join(side(firsts, "a", "wide", "n"), "a").join(side(firsts, "b", "wide", "n"), "b")
        left = materialize(both.select("a", "b", "wide_a", "wide_b", (F.col("n_a") + F.col("n_b")).alias("total")).mapInArrow(unlike, "a long, b long"), f"{name}-like")
        release(docs.sparkSession)
        ends = left.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
        own = materialize(firsts.select("uid", "least").join(ends, "uid"), f"{name}-sets", source=docs)
        release(docs.sparkSession)
        links = materialize(left.join(side(own, "a", "least"), "a").join(side(own, "b", "least"), "b").select("a", "b", "least_a", "least_b").mapInArrow(verify, "a long, b long"), f"{name}-links")
        drop_shared(docs.sparkSession, own)
        release(docs.sparkSession)
        return links

    bits = [f"m{k}" for k in range(BITMAP)]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    whole = materialize(gathered(own, docs).mapInArrow(run, f"doc_id long, h long, fp long, n int, least array<int>, wide binary, {', '.join(f'{m} long' for m in bits)}").withColumn("uid", F.xxhash64("doc_id", "h")).withColumn("same", F.xxhash64("fp", "n", "least")), "profiles")
    profiles = materialize(whole.drop("least", "wide", *bits), "profiles-only")
    # texts with one shingle set are one class; its first stands for it
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h", "uid")
    alike = profiles.where("n > 0").groupBy("same", "fp", "n").agg(F.min(order).alias("o"))
    firsts = materialize(whole.where("n > 0").select("uid", "fp", "n", "least", "wide", *bits).join(alike.select(F.col("o.uid").alias("uid")), "uid").dropDuplicates(["uid"]), "first-profiles", source=docs)
    drop_shared(docs.sparkSession, whole)
    release(docs.sparkSession)
    # near texts by multi-index hashing; of texts with one SimHash the first stands for it
    hashed = firsts.groupBy("fp").agg(F.min("uid").alias("to_uid"))
    stands = lambda k: hashed.select(F.col("fp").alias(k), F.col("to_uid").alias(f"uid_{k}"))
    across = linked(hashed).join(stands("a"), "a").join(stands("b"), "b").select(F.greatest("uid_a", "uid_b").alias("a"), F.least("uid_a", "uid_b").alias("b"))
    pairs = materialize(across.union(firsts.join(hashed, "fp").where("uid <> to_uid").select(F.col("uid").alias("a"), F.col("to_uid").alias("b"))), "simhash-pairs")
    release(docs.sparkSession)
    links = verified(pairs, "simhash")
    roots = components(links)
    # the rest by a prefix filter
    size, share = F.size("least"), F.lit(similarity)
    counts = firsts.select(F.explode(F.slice("least", F.lit(1), (size - F.ceil(share * size - 1e-9) + 1).cast("int"))).alias("key")).groupBy("key").count()
    often = counts.where(F.col("count") >= COMMON).orderBy(F.desc("count"), "key").limit(COMMON_KEPT).collect()
    release(docs.sparkSession)
    often = sorted((r.key & 0xFFFFFFFF, -k) for k, r in enumerate(often))
    common, rank = np.array([x for x, _ in often], dtype=np.uint32), np.array([x for _, x in often], dtype=np.int64)
    held = ["uid", "size", "pos", *bits]  # what a holder tells those that meet it; between groups also the keys before

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uids, sizes, places, found = [], [], [], []
            for uid, least in zip(b.column(0).to_pylist(), sets(b.column(1))):
                found.append(_prefix(least, common, rank, similarity))
                n = len(found[-1])
                uids.append(np.full(n, uid, dtype=np.int64))
                sizes.append(np.full(n, len(least), dtype=np.int32))
                places.append(np.arange(n, dtype=np.int32))
            if uids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int32)), *(pa.array(np.concatenate(x)) for x in (uids, sizes, places))], names=["key", *held[:3]])

    keys = firsts.select("uid", "least").mapInArrow(prefixes, "key int, uid long, size int, pos int")
    repeated = keys.groupBy("key").agg(F.min("uid").alias("low"), F.max("uid").alias("high")).where("low < high").select("key")
    shared_keys = materialize(keys.join(repeated, "key"), "shared-keys", source=docs)
    release(docs.sparkSession)
    # few keys are shared: bitmaps and the shared keys before come to those only
    turn = Window.partitionBy("uid").orderBy("pos")
    before = F.array_compact(F.array(*(F.lag("key", k + 1).over(turn) for k in range(BEFORE))))
    keys = materialize(shared_keys.join(firsts.select("uid", *bits), "uid").select("key", *held, before.alias("before")), "held-keys", source=docs)
    drop_shared(docs.sparkSession, shared_keys)
    release(docs.sparkSession)
    total = F.col("size") + F.col("to_size")
    differ = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"to_{m}"))) for m in bits[1:]), F.bit_count(F.col(bits[0]).bitwiseXOR(F.col(f"to_{bits[0]}"))))
    alike_enough = (
        (F.least("size", "to_size") >= share * F.greatest("size", "to_size") - 1e-9)
        & (F.least(F.col("size") - F.col("pos"), F.col("to_size") - F.col("to_pos")) >= similarity / (1 + similarity) * total - 1e-6)
        & (differ <= (1 - similarity) / (1 + similarity) * total + 1e-6)
    )
    pairs_of = lambda met: met.select(F.greatest("uid", "to_uid").alias("a"), F.least("uid", "to_uid").alias("b")).distinct()

    def opened(keys: DataFrame, name: str) -> DataFrame:
        """Rows of keys whose holders are not in one group, with their own group's root and that of the key's largest."""
        rooted = keys.join(roots, keys["uid"] == roots["node"], "left").select("key", *held, "before", F.coalesce("root", "uid").alias("root"))
        largest = rooted.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("largest"), F.count("*").alias("groups")).where("groups > 1")
        rooted = materialize(rooted.join(largest.select("key", "largest"), "key"), name, source=docs)
        drop_shared(docs.sparkSession, keys)
        release(docs.sparkSession)
        return rooted

    # the same holders are drawn for all keys, so copies meet them in many
    keys = opened(keys, "open-keys")
    one = F.struct(*held, "root")
    draws = [F.min_by(one, F.xxhash64("uid", F.lit(k))) for k in range(HOLDERS)]
    holders = keys.groupBy("key").agg(F.array_distinct(F.array(F.min(one), F.max(one), *draws)).alias("to"))
    # two holders of a key meet once, not from each side
    both = F.array_contains(F.col("to.uid"), F.col("uid"))
    other = F.filter("to", lambda x: (x["root"] != F.col("root")) & (~F.col("both") | (F.col("uid") > x["uid"])))
    met = keys.join(holders, "key").withColumn("both", both).select(*held, F.explode(other).alias("to")).select(*held, *(F.col(f"to.{c}").alias(f"to_{c}") for c in held))
    pairs = materialize(pairs_of(met.where(alike_enough)), "first-pairs")
    release(docs.sparkSession)
    links = links.union(verified(pairs, "first"))
    roots = components(links)
    # then all pairs across groups: of each, one is outside the key's largest group, and the smaller has its key early
    rooted = opened(keys.drop("root", "largest"), "more-open-keys")
    early = rooted.where(F.col("size") - F.col("pos") >= 2 * similarity / (1 + similarity) * F.col("size") - 1e-6)
    names = [F.col(c).alias(f"to_{c}") for c in ["key", *held, "before", "root"]]
    smaller = (F.col("to_size") < F.col("size")) | ((F.col("to_size") == F.col("size")) & (F.col("to_uid") < F.col("uid")))
    new = ~F.arrays_overlap("before", "to_before")
    across = lambda left, right: pairs_of(left.join(right.select(*names), (F.col("key") == F.col("to_key")) & (F.col("root") != F.col("to_root")) & smaller & alike_enough & new))
    outside = F.col("root") != F.col("largest")
    pairs = materialize(across(rooted.where(outside), early).union(across(rooted.where(~outside), early.where(outside))).distinct(), "more-pairs")
    release(docs.sparkSession)
    more = verified(pairs, "more")
    if not more.isEmpty():
        roots = components(links.union(more))
    for table in (firsts, rooted, pairs):
        drop_shared(docs.sparkSession, table)
    # the group of every row, by way of its class
    of = alike.select("same", "fp", "n", F.col("o.uid").alias("class")).join(roots, F.col("class") == F.col("node"), "left").select("same", "fp", "n", F.coalesce("root", "class").alias("root"))
    grouped = profiles.join(of, ["same", "fp", "n"], "left").withColumn("root", F.coalesce("root", "uid"))
    least = grouped.groupBy("root").agg(F.min(order).alias("o"))
    return grouped.join(least, "root").groupBy("doc_id", "h").agg(F.max(F.col("uid") == F.col("o.uid")).alias("first"))


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` (with doc_id and text) that are first of their near-duplicate group, each once; rows without words stay, each once."""
    stays = near_duplicates(docs.select("doc_id", "text"), **options).where("first").select(F.col("doc_id").alias("to_id"), F.col("h").alias("to_h"))
    # other columns, whatever their names, are inside ``row``
    hashed = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("doc_id").cast("long").alias("id"))
    kept = hashed.join(stays, (F.col("h") == F.col("to_h")) & F.col("id").eqNullSafe(F.col("to_id")), "left_semi")
    turn = F.row_number().over(Window.partitionBy("h", "id").orderBy("h"))
    return gathered(kept.withColumn("turn", turn).where("turn = 1").select("row.*"), docs)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return gathered(simhash_groups(docs), docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
