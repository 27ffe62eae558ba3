"""The commerce graph as tables of the audit: clean, and with planted violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalar import joined_key
from ..operators.audit import Graph, chunk_key
from ..sources import tables as T


def _edges(df: DataFrame, kind: str, a: str, b: str) -> DataFrame:
    null = lambda c, t: F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)
    return df.select(F.lit(kind).alias("type"), F.lit(a).alias("src_label"), "src", F.lit(b).alias("dst_label"), "dst", (F.col("kind") if "kind" in df.columns else F.lit(None).cast("string")).alias("kind"), null("source_page", "int").alias("source_page"), null("chunk_index", "long").alias("chunk_index"))


def of_store(store) -> Graph:
    """A table store's own graph, as it was indexed; ends that are not there are labelled so."""
    book, chapter, chunk, entity = store.read("book"), store.read("chapter"), store.read("chunk"), store.read("entity")
    key = joined_key("book_id", "chapter_number", "title")
    chapters = chapter.groupBy("book_id", F.col("number").alias("chapter_number")).agg(F.min(joined_key("book_id", "number", "title")).alias("chapter_key"))
    section = store.read("section").join(chapters, ["book_id", "chapter_number"], "left").select("chapter_key", key.alias("key"), "title", "level", "page_start")
    label = lambda known, yes: F.when(known.isNotNull(), yes).otherwise("Missing")
    ids = entity.select("id").distinct()
    related = store.read("related").join(ids.select(F.col("id").alias("a")), F.col("src") == F.col("a"), "left").join(ids.select(F.col("id").alias("b")), F.col("dst") == F.col("b"), "left")
    related = related.select(F.lit("RELATED").alias("type"), label(F.col("a"), "Entity").alias("src_label"), "src", label(F.col("b"), "Entity").alias("dst_label"), "dst", F.col("type").alias("kind"), "source_page", "chunk_index")
    mention = store.read("mentions").withColumn("src", chunk_key()).join(chunk.select(chunk_key().alias("a")).distinct(), F.col("src") == F.col("a"), "left").join(ids.select(F.col("id").alias("b")), F.col("entity_id") == F.col("b"), "left")
    mention = mention.select(F.lit("MENTIONS").alias("type"), label(F.col("a"), "Chunk").alias("src_label"), "src", label(F.col("b"), "Entity").alias("dst_label"), F.col("entity_id").alias("dst"), F.lit(None).cast("string").alias("kind"), "source_page", "chunk_index")
    hierarchy = store.read("hierarchy").select("type", "src_label", "src", "dst_label", "dst", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("source_page"), F.lit(None).cast("long").alias("chunk_index"))
    return Graph(book.select("id", "page_count"), chapter.select("book_id", "number", "title", "page_start"), section, chunk.select("chunk_index", "book_id", "page_start", "page_end"), entity.select("id", "name", "type", "source_page"), hierarchy.unionByName(related).unionByName(mention))


def commerce(spark: SparkSession, sf_dir: str) -> Graph:
    """Books are order priorities, chapters their order states, chunks the orders; every tenth chapter start and chunk range runs beyond the book, every seventh chunk has no chapter, and parts of odd size are no entities: violations to find."""
    orders = T.read(spark, sf_dir, "orders")
    book = orders.select(F.col("o_orderpriority").alias("id")).distinct().select("id", F.lit(480).alias("page_count"))
    number = F.ascii("o_orderstatus")
    chapter = orders.groupBy(F.col("o_orderpriority").alias("book_id"), number.cast("int").alias("number"), F.col("o_orderstatus").alias("title")).agg(F.min("o_orderkey").alias("k")).select("book_id", "number", "title", F.when(F.col("title") == "P", F.lit(481)).otherwise(F.lit(1)).alias("page_start"))
    key = F.concat_ws("|", "book_id", F.col("number").cast("string"), "title")
    section = chapter.select(key.alias("chapter_key"), F.concat(key, F.lit("/s")).alias("key"), F.lit("s").alias("title"), F.when(F.col("title") == "F", F.lit(-1)).otherwise(F.lit(2)).alias("level"), F.when(F.col("title") == "O", F.lit(None).cast("int")).otherwise(F.lit(3)).alias("page_start"))
    chunk = T.chunks(spark, sf_dir).select("chunk_index", F.when(F.col("chunk_index") % 11 != 0, F.col("book_id")).alias("book_id"), "page_start", "page_end")
    own = orders.select("o_orderkey", "o_orderpriority", number.cast("int").alias("number"), "o_orderstatus")
    keyed = F.concat_ws("|", "o_orderpriority", F.col("number").cast("string"), "o_orderstatus")
    held = own.where("o_orderkey % 7 <> 0").select(F.when(F.col("o_orderkey") % 2 == 0, keyed).otherwise(F.concat(keyed, F.lit("/s"))).alias("src"), F.concat(F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).otherwise(F.lit("")), F.lit("|"), F.col("o_orderkey").cast("string")).alias("dst"), F.col("o_orderkey"))
    twice = held.where("o_orderkey % 13 = 0").select(F.lit("1-URGENT|79|O").alias("src"), "dst", "o_orderkey")
    entity = T.entities(spark, sf_dir).where("NOT (type = 'tool' AND source_page % 2 = 1)").select("id", "name", "type", "source_page")
    ends = F.when(F.col("dst").startswith("part-") & F.col("gone"), "Missing").otherwise("Entity")
    odd = T.read(spark, sf_dir, "part").where("p_size % 2 = 1").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string"), F.lit("-tool")).alias("odd"))
    def related(*kinds: str) -> DataFrame:
        rows = T.relations(spark, sf_dir, kinds).join(odd, F.col("dst") == F.col("odd"), "left").withColumn("gone", F.col("odd").isNotNull())
        return rows.select(F.lit("RELATED").alias("type"), F.lit("Entity").alias("src_label"), "src", ends.alias("dst_label"), "dst", F.col("type").alias("kind"), "source_page", "chunk_index")
    mention = T.mentions(spark, sf_dir).select(F.when(F.col("chunk_index") % 11 != 0, chunk_key()).alias("src"), F.col("entity_id").alias("dst"), F.when(F.col("source_page") != 7, F.col("source_page")).alias("source_page"))
    edges = _edges(chapter.select(F.col("book_id").alias("src"), key.alias("dst")).where("NOT dst LIKE '%|P'"), "CONTAINS", "Book", "Chapter")
    edges = edges.unionByName(_edges(section.select(F.col("chapter_key").alias("src"), F.col("key").alias("dst")).where("NOT src LIKE '5%'"), "HAS_SECTION", "Chapter", "Section"))
    edges = edges.unionByName(_edges(held.where("src LIKE '%/s'").select("src", "dst"), "HAS_CHUNK", "Section", "Chunk")).unionByName(_edges(held.where("NOT src LIKE '%/s'").select("src", "dst"), "HAS_CHUNK", "Chapter", "Chunk"))
    edges = edges.unionByName(_edges(twice.select("src", "dst"), "HAS_CHUNK", "Entity", "Chunk"))
    plain = edges.unionByName(related(*T.PLAIN)).unionByName(_edges(mention, "MENTIONS", "Chunk", "Entity"))
    members = T.alike(spark, sf_dir)
    members = members.join(odd.select(F.col("odd").alias("node"), F.lit(True).alias("gone")).distinct(), "node", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    return Graph(book, chapter, section, chunk, entity, plain.unionByName(related(T.ALIKE)), plain, members, T.ALIKE)


#: The same graph for the oracle.
SQL = """g_book AS (SELECT DISTINCT o_orderpriority AS id, 480 AS page_count FROM orders),
g_chapter AS (SELECT DISTINCT o_orderpriority AS book_id, ascii(o_orderstatus) AS number, o_orderstatus AS title, CASE WHEN o_orderstatus = 'P' THEN 481 ELSE 1 END AS page_start, o_orderpriority || '|' || ascii(o_orderstatus) || '|' || o_orderstatus AS key FROM orders),
g_section AS (SELECT key AS chapter_key, key || '/s' AS key, CASE WHEN title = 'F' THEN -1 ELSE 2 END AS level, CASE WHEN title = 'O' THEN NULL ELSE 3 END AS page_start FROM g_chapter),
g_chunk AS (SELECT o_orderkey AS chunk_index, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS book_id, CAST(o_orderkey % 500 + 1 AS INTEGER) AS page_start, CAST(o_orderkey % 500 + 2 AS INTEGER) AS page_end, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority ELSE '' END || '|' || o_orderkey AS key FROM orders),
g_held AS (SELECT o_orderpriority || '|' || ascii(o_orderstatus) || '|' || o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '/s' END AS src, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority ELSE '' END || '|' || o_orderkey AS dst, o_orderkey FROM orders WHERE o_orderkey % 7 <> 0),
g_entity AS (SELECT id, name, type, source_page FROM entity WHERE NOT (type = 'tool' AND source_page % 2 = 1)),
g_edges AS (
  SELECT 'CONTAINS' AS type, 'Book' AS src_label, book_id AS src, 'Chapter' AS dst_label, key AS dst, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS INTEGER) AS source_page, CAST(NULL AS BIGINT) AS chunk_index FROM g_chapter WHERE title <> 'P'
  UNION ALL SELECT 'HAS_SECTION', 'Chapter', chapter_key, 'Section', key, NULL, NULL, NULL FROM g_section WHERE chapter_key NOT LIKE '5%'
  UNION ALL SELECT 'HAS_CHUNK', CASE WHEN src LIKE '%/s' THEN 'Section' ELSE 'Chapter' END, src, 'Chunk', dst, NULL, NULL, NULL FROM g_held
  UNION ALL SELECT 'HAS_CHUNK', 'Entity', '1-URGENT|79|O', 'Chunk', dst, NULL, NULL, NULL FROM g_held WHERE o_orderkey % 13 = 0
  UNION ALL SELECT 'RELATED', 'Entity', r.src, CASE WHEN p.p_partkey IS NOT NULL THEN 'Missing' ELSE 'Entity' END, r.dst, r.type, r.source_page, r.chunk_index FROM related r LEFT JOIN part p ON r.dst = 'part-' || p.p_partkey || '-tool' AND p.p_size % 2 = 1
  UNION ALL SELECT 'MENTIONS', 'Chunk', CASE WHEN chunk_index % 11 <> 0 THEN coalesce(book_id, '') || '|' || chunk_index END, 'Entity', entity_id, NULL, CASE WHEN source_page <> 7 THEN source_page END, NULL FROM mentions)"""

_EDGE = "coalesce(src, '') || '|' || coalesce(kind, '') || '|' || coalesce(dst, '')"
_UNMENTIONED = "FROM g_entity n WHERE NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.type = 'MENTIONS' AND e.dst = n.id)"
#: For each rule, the keys of what is wrong.
RULE_SQL = {
    "HIERARCHY_CHAPTER_BOOK_PARENT": "SELECT key FROM g_chapter c WHERE (SELECT count(*) FROM g_edges e WHERE e.type = 'CONTAINS' AND e.src_label = 'Book' AND e.dst = c.key) <> 1",
    "HIERARCHY_SECTION_PARENT": "SELECT key FROM g_section s WHERE NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.type IN ('HAS_SECTION', 'HAS_SUBSECTION') AND e.src_label IN ('Chapter', 'Section') AND e.dst = s.key)",
    "HIERARCHY_CHUNK_PARENT_REQUIRED": "SELECT key FROM g_chunk c WHERE NOT EXISTS (SELECT 1 FROM g_edges e JOIN (SELECT dst AS node FROM g_edges WHERE type = 'CONTAINS' UNION SELECT h.dst FROM g_edges h JOIN g_edges b ON b.type = 'CONTAINS' AND b.dst = h.src WHERE h.type = 'HAS_SECTION') r ON e.src = r.node WHERE e.type = 'HAS_CHUNK' AND e.dst = c.key)",
    "HIERARCHY_CHUNK_MULTIPLE_PARENT": "SELECT dst AS key FROM g_edges WHERE type = 'HAS_CHUNK' GROUP BY dst HAVING count(*) > 1",
    "HIERARCHY_LEVEL_CONTRADICTION": "SELECT key FROM g_section WHERE level < 0",
    "ENDPOINT_RELATED_INVALID": f"SELECT {_EDGE} AS key FROM g_edges WHERE type = 'RELATED' AND (src_label <> 'Entity' OR dst_label <> 'Entity' OR src IS NULL OR dst IS NULL)",
    "ENDPOINT_MENTIONS_INVALID": f"SELECT {_EDGE} AS key FROM g_edges WHERE type = 'MENTIONS' AND (src_label <> 'Chunk' OR dst_label <> 'Entity' OR src IS NULL OR dst IS NULL)",
    "ENDPOINT_HIERARCHY_INVALID": f"SELECT {_EDGE} AS key FROM g_edges WHERE type = 'HAS_CHUNK' AND src_label NOT IN ('Chapter', 'Section')",
    "ENTITY_UNMENTIONED": f"SELECT n.id AS key {_UNMENTIONED}",
    "ENTITY_ISOLATED_RELATED": "SELECT id AS key FROM g_entity n WHERE NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.type = 'RELATED' AND e.src = n.id) AND NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.type = 'RELATED' AND e.dst = n.id)",
    "PROVENANCE_ENTITY_MISSING": f"SELECT n.id AS key {_UNMENTIONED} AND n.source_page IS NULL",
    "PROVENANCE_RELATIONSHIP_MISSING": f"SELECT {_EDGE} AS key FROM g_edges WHERE type = 'RELATED' AND (source_page IS NULL OR chunk_index IS NULL)",
    "PROVENANCE_MENTIONS_MISSING": f"SELECT {_EDGE} AS key FROM g_edges WHERE type = 'MENTIONS' AND source_page IS NULL AND chunk_index IS NULL",
    "PROVENANCE_CHUNK_MISSING": "SELECT key FROM g_chunk WHERE book_id IS NULL",
    "DUPLICATE_ENTITY_LOGICAL": "SELECT name || '|' || type AS key FROM g_entity GROUP BY name, type HAVING count(*) > 1",
    "DUPLICATE_RELATIONSHIP_LOGICAL": "SELECT src || '|' || kind || '|' || dst AS key FROM g_edges WHERE type = 'RELATED' GROUP BY src, kind, dst HAVING count(*) > 1",
    "PAGE_CHUNK_INVALID_RANGE": "SELECT c.key FROM g_chunk c LEFT JOIN g_book b ON c.book_id = b.id WHERE c.page_start < 1 OR c.page_end < c.page_start OR c.page_start > b.page_count OR c.page_end > b.page_count",
    "PAGE_CHAPTER_INVALID_START": "SELECT c.key FROM g_chapter c JOIN g_book b ON c.book_id = b.id WHERE c.page_start IS NULL OR c.page_start < 1 OR c.page_start > b.page_count",
    "PAGE_SECTION_INVALID_START": "SELECT key FROM g_section WHERE page_start IS NULL OR page_start < 1 OR page_start > 480",
}
