"""Content-addressed store of token-id streams.

Every document's id stream (its ids and the end id) is cut into chunks where a
rolling hash of the last ids meets a mask, so equal passages give equal chunks
wherever they stand.  The store has three Parquet datasets:

``chunks``     digest, n (ids) and data (little-endian ids), once per digest
               (rows of another kind hold the recipes as they came);
``recipes``    one row per document in ascending doc_id order: its digests,
               its place and a leaf digest; shard k holds smaller ids than k+1;
``manifests``  per shard: documents, ids, first and last doc_id and the Merkle
               root over the leaves.

Reading back recomputes each stored chunk's digest and checksum, joins the
checksums (not the data) to the recipes and combines them to whole-document
checksums, and recomputes every Merkle root.  Data crosses the network once,
when equal chunks meet.

Nulls and edge cases: a null text is an empty one and gives the end id alone;
null ids sort first; repeated rows keep their own recipes in the order of
their source rows; an empty table gives an empty store; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import PLAIN_FILES, documents, gathered, shared_dir, small_batches
from .tokens import piece_tokenizer

#: Chunks have at least and at most so many ids; between, one cut in so many positions on average.
MIN_IDS, MEAN_IDS, MAX_IDS = 64, 512, 4096
#: Ids that the rolling hash sees; no cut depends on ids before its own stream as MIN_IDS is larger.
ROLL = 8
#: Recipes under one inner node of the Merkle tree.
FANOUT = 1024
#: Digests that a task remembers, so that it sends a chunk once, and bytes that it hands over at a time.
SEEN, HANDED = 200_000, 1 << 22
_CHUNKS = "kind int, digest binary, n int, data binary, doc_id long, n_tokens long"

_POLY = 0xEDB88320


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """Hash of the ROLL ids that end at each position (positions before ROLL see fewer)."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    out = x.copy()
    for k in range(1, ROLL):
        out[k:] += x[:-k] << np.uint64(k)
    return out >> np.uint64(16)


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one stream."""
    n = len(ids)
    if n <= MIN_IDS:
        return [n]
    ends, last = [], 0
    for c in (np.flatnonzero(rolling_hash(ids) % np.uint64(MEAN_IDS) == 0) + 1).tolist():
        while c - last > MAX_IDS:
            last += MAX_IDS
            ends.append(last)
        if c - last >= MIN_IDS and c < n:
            ends.append(c)
            last = c
    while n - last > MAX_IDS:
        last += MAX_IDS
        ends.append(last)
    return [*ends, n]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the crc's, bits reflected."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def _shift_tables(bits: int) -> list[list[np.ndarray]]:
    """Table k: the product with x^(8 * 2^k), byte by byte."""
    power, out = 1 << 23, []  # x^8
    for _ in range(bits):
        out.append([np.array([_times(v << (8 * j), power) for v in range(256)], dtype=np.uint32) for j in range(4)])
        power = _times(power, power)
    return out


_TABLES: list = []


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each checksum adds to that of a stream in which n_bytes follow."""
    if not _TABLES:
        _TABLES.extend(_shift_tables(48))
    out = crc.astype(np.uint32)
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        on = (n_bytes >> k & 1).astype(bool)
        v = out[on]
        out[on] = _TABLES[k][0][v & 255] ^ _TABLES[k][1][v >> 8 & 255] ^ _TABLES[k][2][v >> 16 & 255] ^ _TABLES[k][3][v >> 24]
    return out


@dataclass(frozen=True)
class TokenStore:
    """Where a store lies and how wide its ids are."""

    path: str
    width: int

    def chunks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_CHUNKS).parquet(f"{self.path}/chunks").where("kind = 0").select("digest", "n", "data")

    def recipes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("shard int, rank long, doc_id long, n_tokens long, digests binary, leaf string").parquet(f"{self.path}/recipes")

    def manifests(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("shard int, n_docs long, n_tokens long, first_doc long, last_doc long, root string").parquet(f"{self.path}/manifests")


def _encode(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Chunk rows (kind 0) and recipe rows (kind 1) from one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = piece_tokenizer(tokenizer_path, "word")
        end, row, seen = np.array([end_id], dtype=tok.dtype), TaskContext.get().partitionId() << 33, set()
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            kind, key, n, data, doc, total = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.binary()), pa.array(n, pa.int32()), pa.array(data, pa.binary()), pa.array(doc, pa.int64()), pa.array(total, pa.int64())], names=["kind", "digest", "n", "data", "doc_id", "n_tokens"])

        for b in batches:
            for doc_id, body in zip(b.column(0).to_pylist(), tok.encode(t.as_py() or "" for t in b.column(1))):
                ids, at, own = np.concatenate([body, end]), 0, []
                for e in cut_points(ids):
                    data = ids[at:e].tobytes()
                    own.append(d := digest(data))
                    if d not in seen:  # once per task is enough; the shuffle unites tasks
                        if len(seen) < SEEN:
                            seen.add(d)
                        out.append((0, d, e - at, data, None, None))
                        size += len(data)
                    at = e
                out.append((1, row.to_bytes(8, "big"), None, b"".join(own), doc_id, len(ids)))
                size += 64 + 16 * len(own)
                row += 1
                if size >= HANDED:
                    yield batch()
                    out.clear()
                    size = 0
        if out:
            yield batch()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, _CHUNKS)


def _merkle(recipes: DataFrame) -> DataFrame:
    """shard, counts, bounds and Merkle root from leaves."""
    inner = recipes.withColumn("node", (F.col("rank") / FANOUT).cast("long")).groupBy("shard", "node").agg(
        F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("rank", "leaf"))), lambda x: x["leaf"])), 256).alias("hash"),
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min_by("doc_id", "rank").alias("first_doc"), F.max_by("doc_id", "rank").alias("last_doc"),
    )
    return inner.groupBy("shard").agg(
        F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min_by("first_doc", "node").alias("first_doc"), F.max_by("last_doc", "node").alias("last_doc"),
        F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"])), 256).alias("root"),
    )


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenStore:
    """Encode ``docs`` and write chunks, recipes and manifests below ``path`` (default: a new folder in the shared one)."""
    spark = docs.sparkSession
    store = TokenStore(path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}", piece_tokenizer(tokenizer_path, "word").dtype.itemsize)
    rows = _encode(docs, tokenizer_path, end_id, id_col, text_col)
    # tasks send a chunk once, so equal ones meet and are sorted behind the shuffle only
    with small_batches(spark):
        rows.repartition("kind", "digest").dropDuplicates(["kind", "digest"]).write.options(**PLAIN_FILES).option("compression", "zstd").parquet(f"{store.path}/chunks")
    raw = spark.read.schema(_CHUNKS).parquet(f"{store.path}/chunks").where("kind = 1")
    ordered = raw.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    leaf = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"), F.lit("|").cast("binary"), F.col("n_tokens").cast("string").cast("binary"), F.lit("|").cast("binary"), F.col("data")), 256)
    numbered = ordered.select(F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("m"), "doc_id", "n_tokens", F.col("data").alias("digests"), leaf.alias("leaf"))
    numbered.select("shard", (F.col("m") % (1 << 33)).alias("rank"), "doc_id", "n_tokens", "digests", "leaf").write.options(**PLAIN_FILES).option("compression", "zstd").parquet(f"{store.path}/recipes")
    _merkle(store.recipes(spark)).write.options(**PLAIN_FILES).parquet(f"{store.path}/manifests")
    return store


def read_checksums(spark: SparkSession, store: TokenStore) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the stored bytes alone.

    Raises if a chunk's bytes do not give its digest, a recipe names a chunk
    that is not there or has another length, or a Merkle root differs.
    """
    dtype = np.dtype("<u2" if store.width == 2 else "<u4")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, data, crcs, sizes = b.column(0).to_pylist(), b.column(1).to_pylist(), [], []
            for k, d in zip(keys, data):
                if digest(d) != k:
                    raise ValueError(f"chunk {k.hex()} is damaged")
                ids = np.frombuffer(d, dtype=dtype)
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64())], names=["digest", "crc", "n"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lay every chunk's checksum where its document's needs it."""
        for b in batches:
            crc, after = (np.asarray(b.column(k).to_numpy(zero_copy_only=False)) for k in (3, 4))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array(shifted(crc, after * 4).astype(np.int64), pa.int64())], names=["shard", "rank", "n", "part"])

    chunks = store.chunks(spark).select("digest", "data").mapInArrow(verify, "digest binary, crc long, n long")
    recipes = store.recipes(spark)
    refs = recipes.select("shard", "rank", F.posexplode(F.transform(F.sequence(F.lit(1), F.expr("cast(length(digests) / 16 as int)")), lambda i: F.substring("digests", (i - 1) * 16 + 1, F.lit(16)))).alias("pos", "digest"))
    joined = refs.join(chunks, "digest", "left").withColumn("n", F.coalesce("n", F.raise_error(F.lit("a recipe's chunk is missing")).cast("long")))
    after = Window.partitionBy("shard", "rank").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    parts = joined.select("shard", "rank", "n", "crc", F.coalesce(F.sum("n").over(after), F.lit(0)).alias("after")).mapInArrow(combine, "shard int, rank long, n long, part long")
    whole = parts.groupBy("shard", "rank").agg(F.sum("n").alias("found"), F.expr("bit_xor(part)").alias("ids_crc32"))
    shards = _merkle(recipes).alias("a").join(store.manifests(spark).alias("b"), "shard", "left").select(
        "shard", F.when(F.col("a.root").eqNullSafe(F.col("b.root")), F.col("b.n_tokens")).otherwise(F.raise_error(F.lit("a Merkle root differs")).cast("long")).alias("n"),
    )
    # one row per shard, whose number is that of the shuffle's partitions
    firsts = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    running = Window.partitionBy("shard").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = recipes.select("shard", "rank", "doc_id", "n_tokens", F.coalesce(F.sum("n_tokens").over(running), F.lit(0)).alias("within"))
    size = F.when(F.col("found") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a recipe's length differs")).cast("long"))
    return placed.join(whole, ["shard", "rank"], "left").join(firsts, "shard").select("doc_id", (F.col("first") + F.col("within")).alias("start"), size.alias("n_tokens"), "ids_crc32")


def read_documents(spark: SparkSession, store: TokenStore) -> DataFrame:
    """doc_id and its whole id stream (array of long) in store order: the data itself moves here."""
    refs = store.recipes(spark).select("shard", "rank", "doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.expr("cast(length(digests) / 16 as int)")), lambda i: F.substring("digests", (i - 1) * 16 + 1, F.lit(16)))).alias("pos", "digest"))
    whole = refs.join(store.chunks(spark).select("digest", "data"), "digest").groupBy("shard", "rank").agg(F.first("doc_id").alias("doc_id"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "data"))), lambda x: x["data"]).alias("data"))
    dtype = np.dtype("<u2" if store.width == 2 else "<u4")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.frombuffer(b"".join(x), dtype=dtype).astype(np.int64) for x in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return whole.orderBy("shard", "rank").select("doc_id", "data").mapInArrow(ids, "doc_id long, ids array<long>")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir)
    store = write_store(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return gathered(read_checksums(spark, store), docs)
