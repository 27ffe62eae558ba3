"""Two deterministic projections of the test tables onto the graph model.

Commerce: regions, nations, suppliers, customers and parts are entities, their
keys are relations, orders are chunks that mention the parts they hold.
Corpus: documents are books' texts, cut into chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import schema as S
from ..operators.alike import pairs as alike_pairs, partnered

#: Types of relations that have a row each in the tables, and the one between all parts of a brand and size.
PLAIN, ALIKE = ("requires", "depends_on", "extends", "composes"), "alternative_to"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _key(prefix: str, column: str, kind: str):
    return F.concat(F.lit(f"{prefix}-"), F.col(column).cast("string"), F.lit(f"-{kind}"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity rows of the commerce graph."""
    null_page, null_text, none = F.lit(None).cast("int"), F.lit(None).cast("string"), F.array().cast("array<string>")

    def of(table: str, key: str, name: str, kind: str, description: str, page=null_page, aliases=none) -> DataFrame:
        return read(spark, sf_dir, table).select(_key(table, key, kind).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("type"), F.col(description).alias("description"), page.alias("source_page"), aliases.alias("aliases"), null_text.alias("canonical_name"))

    parts = [
        of("region", "r_regionkey", "r_name", "concept", "r_name"), of("nation", "n_nationkey", "n_name", "component", "n_name"),
        of("supplier", "s_suppkey", "s_name", "agent", "s_name"), of("customer", "c_custkey", "c_name", "framework", "c_mktsegment"),
        of("part", "p_partkey", "p_name", "tool", "p_type", F.col("p_size").cast("int"), F.array("p_brand")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _shaped(df: DataFrame, kind: str, page=None, chunk=None) -> DataFrame:
    null = lambda t: F.lit(None).cast(t)
    return df.select("src", "dst", F.lit(kind).alias("type"), F.concat(F.lit(f"{kind} "), "dst").alias("description"), (null("int") if page is None else page).alias("source_page"), (null("long") if chunk is None else chunk).alias("chunk_index"))


def relations(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """RELATED rows of the commerce graph, one per (src, dst, type); only the tables of ``kinds`` are read."""
    line = read(spark, sf_dir, "lineitem")

    def build(kind: str) -> DataFrame:
        if kind == "requires":
            both = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(line.select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
            pairs = both.groupBy("o_custkey", "l_partkey").agg(F.min("o_orderkey").alias("first"))
            return _shaped(pairs.select(_key("customer", "o_custkey", "framework").alias("src"), _key("part", "l_partkey", "tool").alias("dst"), "first"), kind, chunk=F.col("first"))
        if kind == "depends_on":
            pairs = line.groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("first"))
            return _shaped(pairs.select(_key("part", "l_partkey", "tool").alias("src"), _key("supplier", "l_suppkey", "agent").alias("dst"), "first"), kind, chunk=F.col("first"))
        if kind == "extends":
            s = read(spark, sf_dir, "supplier").select(_key("supplier", "s_suppkey", "agent").alias("src"), _key("nation", "s_nationkey", "component").alias("dst"))
            c = read(spark, sf_dir, "customer").select(_key("customer", "c_custkey", "framework").alias("src"), _key("nation", "c_nationkey", "component").alias("dst"))
            return _shaped(s.union(c), kind)
        if kind == "composes":
            return _shaped(read(spark, sf_dir, "nation").select(_key("nation", "n_nationkey", "component").alias("src"), _key("region", "n_regionkey", "concept").alias("dst")), kind)
        return _shaped(alike_pairs(alike(spark, sf_dir)), ALIKE, page=F.col("source_page"))

    out = None
    for kind in kinds or (*PLAIN, ALIKE):
        out = build(kind) if out is None else out.unionByName(build(kind))
    return out


def alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members (node, group, source_page) of the groups whose pairs are the ``ALIKE`` relations."""
    p = read(spark, sf_dir, "part").where("p_partkey IS NOT NULL AND p_brand IS NOT NULL AND p_size IS NOT NULL")
    return p.select(_key("part", "p_partkey", "tool").alias("node"), F.struct("p_brand", "p_size").alias("group"), F.col("p_size").cast("int").alias("source_page"))


def relation_ends(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = (*PLAIN, ALIKE)) -> DataFrame:
    """(src, dst, type) that has every end of every relation on its side; of ``ALIKE`` ones a row per node, not per pair."""
    plain = tuple(k for k in kinds if k != ALIKE)
    out = relations(spark, sf_dir, plain).select("src", "dst", "type") if plain else None
    if ALIKE in kinds:
        own = partnered(alike(spark, sf_dir)).select("node").distinct().select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(ALIKE).alias("type"))
        out = own if out is None else out.unionByName(own)
    return out


def relations_from(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = (*PLAIN, ALIKE)):
    """Function of (nodes, end): relations whose ``end`` (src or dst) is one of the nodes (column node); pairs of other nodes are not made."""

    def near(nodes: DataFrame, end: str = "src") -> DataFrame:
        nodes, plain = nodes.select("node").distinct(), tuple(k for k in kinds if k != ALIKE)
        out = relations(spark, sf_dir, plain).join(nodes.withColumnRenamed("node", end), end, "left_semi") if plain else None
        if ALIKE in kinds:
            made = alike_pairs(alike(spark, sf_dir), nodes)  # either end: each relation is there both ways
            made = made if end == "src" else made.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "source_page")
            own = _shaped(made, ALIKE, page=F.col("source_page"))
            out = own if out is None else out.unionByName(own)
        return out

    return near


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("o_orderkey") % 500 + 1).cast("int")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_index"), F.col("o_orderpriority").alias("book_id"), F.concat_ws(" ", F.lit("order"), F.col("o_orderkey").cast("string"), "o_orderstatus").alias("text"), start.alias("page_start"), (start + 1).alias("page_end"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    pages = read(spark, sf_dir, "part").select(F.col("p_partkey"), F.col("p_size").cast("int").alias("source_page"))
    both = held.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(pages, F.col("l_partkey") == F.col("p_partkey"))
    return both.select(F.col("o_orderkey").alias("chunk_index"), F.col("o_orderpriority").alias("book_id"), _key("part", "l_partkey", "tool").alias("entity_id"), "source_page")


def split_text(text, size: int = S.CHUNK_SIZE, overlap: int = S.CHUNK_OVERLAP):
    """Array of overlapping slices of ``size`` characters; a text that is not longer is one, an empty one none."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be below the size")
    cut = F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size)))
    return F.when(F.length(text) > size, cut).when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def corpus_chunks(spark: SparkSession, sf_dir: str, size: int = S.CHUNK_SIZE, overlap: int = S.CHUNK_OVERLAP) -> DataFrame:
    """doc_id, book_id, part (0, 1, ...), text of every document's chunks; no shuffle."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("source").alias("book_id"), F.posexplode(split_text(F.col("text"), size, overlap)).alias("part", "text"))


def numbered(parts: DataFrame) -> DataFrame:
    """Running chunk_index in each book, by document and part.

    Only counts per document are ordered; texts stay where they are until one
    join by document.
    """
    per = parts.groupBy("book_id", "doc_id").agg(F.count("*").alias("n"))
    # hot books: number inside blocks of documents first, then add what is before each block
    block = F.floor(F.col("doc_id") / 4096)
    per = per.withColumn("block", block)
    totals = per.groupBy("book_id", "block").agg(F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("book_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("book_id", "block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = per.withColumn("inside", inside).join(totals.select("book_id", "block", before.alias("before")), ["book_id", "block"]).select("book_id", "doc_id", (F.col("inside") + F.col("before")).alias("first"))
    return parts.join(first, ["book_id", "doc_id"]).select((F.col("first") + F.col("part")).alias("chunk_index"), "book_id", "doc_id", "part", "text")
