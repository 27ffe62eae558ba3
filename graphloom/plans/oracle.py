"""DuckDB SQL of the two graph projections, as common table expressions."""

from __future__ import annotations

ENTITY = """entity AS (
  SELECT 'region-' || r_regionkey || '-concept' AS id, r_name AS name, 'concept' AS type, r_name AS description, CAST(NULL AS INTEGER) AS source_page, CAST(NULL AS VARCHAR) AS alias FROM region
  UNION ALL SELECT 'nation-' || n_nationkey || '-component', n_name, 'component', n_name, NULL, NULL FROM nation
  UNION ALL SELECT 'supplier-' || s_suppkey || '-agent', s_name, 'agent', s_name, NULL, NULL FROM supplier
  UNION ALL SELECT 'customer-' || c_custkey || '-framework', c_name, 'framework', c_mktsegment, NULL, NULL FROM customer
  UNION ALL SELECT 'part-' || p_partkey || '-tool', p_name, 'tool', p_type, p_size, p_brand FROM part)"""

RELATED = """related AS (
  SELECT 'customer-' || o_custkey || '-framework' AS src, 'part-' || l_partkey || '-tool' AS dst, 'requires' AS type, CAST(NULL AS INTEGER) AS source_page, min(o_orderkey) AS chunk_index FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey
  UNION ALL SELECT 'part-' || l_partkey || '-tool', 'supplier-' || l_suppkey || '-agent', 'depends_on', NULL, min(l_orderkey) FROM lineitem GROUP BY l_partkey, l_suppkey
  UNION ALL SELECT 'supplier-' || s_suppkey || '-agent', 'nation-' || s_nationkey || '-component', 'extends', NULL, NULL FROM supplier
  UNION ALL SELECT 'customer-' || c_custkey || '-framework', 'nation-' || c_nationkey || '-component', 'extends', NULL, NULL FROM customer
  UNION ALL SELECT 'nation-' || n_nationkey || '-component', 'region-' || n_regionkey || '-concept', 'composes', NULL, NULL FROM nation
  UNION ALL SELECT 'part-' || a.p_partkey || '-tool', 'part-' || b.p_partkey || '-tool', 'alternative_to', a.p_size, NULL FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey)"""

MENTIONS = """mentions AS (
  SELECT DISTINCT o_orderkey AS chunk_index, o_orderpriority AS book_id, 'part-' || l_partkey || '-tool' AS entity_id, p_size AS source_page
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

FIRST = """first_mention AS (
  SELECT entity_id, book_id, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY book_id, chunk_index) AS n FROM mentions) WHERE n = 1)"""

CHUNK = """chunk AS (
  SELECT o_orderkey AS chunk_index, o_orderpriority AS book_id, 'order ' || o_orderkey || ' ' || o_orderstatus AS text, CAST(o_orderkey % 500 + 1 AS INTEGER) AS page_start, CAST(o_orderkey % 500 + 2 AS INTEGER) AS page_end FROM orders)"""

SPLIT = """part_of AS (
  SELECT doc_id, source AS book_id, text, unnest(range(CAST(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1500 THEN 1 ELSE ceil(length(text) / 1350.0) END AS BIGINT))) AS part FROM documents),
corpus_chunk AS (
  SELECT doc_id, book_id, part, CASE WHEN length(text) > 1500 THEN substr(text, part * 1350 + 1, 1500) ELSE text END AS text FROM part_of)"""


def with_(*tables: str) -> str:
    return "WITH " + ",\n".join(tables) + "\n"


SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
SOURCE = "CASE WHEN f.chunk_index IS NULL THEN NULL WHEN f.book_id IS NULL THEN 'chunk_index=' || f.chunk_index ELSE 'book_id=' || f.book_id || ',chunk_index=' || f.chunk_index END"


def trails(start: str, depth: int, kind: str | None = None) -> str:
    """Trails as SQL: one branch a length."""
    only = f"WHERE type = '{kind}'" if kind else ""
    ctes = [RELATED, f"e AS (SELECT src, dst, type, src || '|' || type || '|' || dst AS edge FROM related {only})", f"t1 AS (SELECT src || '>' || dst AS nodes, type AS kinds, edge AS e1, dst AS last FROM e WHERE src = '{start}')"]
    for k in range(2, depth + 1):
        seen = " AND ".join(f"e.edge <> t.e{j}" for j in range(1, k))
        kept = ", ".join(f"t.e{j}" for j in range(1, k))
        ctes.append(f"t{k} AS (SELECT t.nodes || '>' || e.dst AS nodes, t.kinds || '>' || e.type AS kinds, {kept}, e.edge AS e{k}, e.dst AS last FROM t{k - 1} t JOIN e ON t.last = e.src AND {seen})")
    rows = " UNION ALL ".join(f"SELECT {k} AS length, nodes, kinds FROM t{k}" for k in range(1, depth + 1))
    return with_(*ctes) + rows
