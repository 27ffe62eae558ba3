"""Closed vocabularies, table schemas, limits and errors of the knowledge graph."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import types as T

# The closed vocabularies.
ENTITY_TYPES = ("pattern", "agent", "component", "concept", "tool", "framework", "mcp", "llmops", "risk")
RELATION_TYPES = ("requires", "alternative_to", "composes", "extends", "enables", "depends_on", "contrasts_with", "evolves_to")
NODE_LABELS = ("Book", "Chapter", "Section", "Chunk", "Entity")
EDGE_TYPES = ("CONTAINS", "HAS_SECTION", "HAS_SUBSECTION", "HAS_CHUNK", "MENTIONS", "RELATED")
# Default limits.
MAX_DEPTH, MAX_BATCH, LOOKUP_LIMIT, PAGE_SIZE, SEARCH_LIMIT, TOP_SUMMARIES = 3, 200, 100, 50, 10, 8
CHUNK_SIZE, CHUNK_OVERLAP = 1500, 150


def _struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # noqa: SLF001  pyspark's own parser of DDL text


BOOK = "id string, title string, author string, pdf_path string, page_count int"
CHAPTER = "book_id string, number int, title string, page_start int"
SECTION = "book_id string, chapter_number int, title string, level int, page_start int, parent_section_title string"
CHUNK = "chunk_index long, book_id string, text string, page_start int, page_end int"
ENTITY = "id string, name string, type string, description string, source_page int, aliases array<string>, canonical_name string"
RELATED = "src string, dst string, type string, description string, source_page int, chunk_index long"
MENTIONS = "chunk_index long, book_id string, entity_id string, source_page int"
#: Edges between books, chapters, sections and chunks; ends are natural keys joined by bars.
HIERARCHY = "type string, src_label string, src string, dst_label string, dst string"
SUMMARY = "id string, level int, summary string, entity_ids array<string>, parent_id string"
QUERY_LOG = "ts timestamp, tool_name string, query_type string, query_params string, result_count long, zero_results boolean, entity_not_found boolean, duration_ms double, error string"
#: Natural keys by table.
KEYS = {"book": ["id"], "chapter": ["book_id", "number", "title"], "section": ["book_id", "chapter_number", "title"], "chunk": ["chunk_index", "book_id"], "entity": ["id"], "related": ["src", "dst", "type"], "mentions": ["chunk_index", "book_id", "entity_id"], "hierarchy": ["type", "src", "dst"], "summary": ["id"], "orphan": ["src", "dst", "type"]}
SCHEMAS = {"book": BOOK, "chapter": CHAPTER, "section": SECTION, "chunk": CHUNK, "entity": ENTITY, "related": RELATED, "mentions": MENTIONS, "hierarchy": HIERARCHY, "summary": SUMMARY}
#: Relations that wait for their ends; no part of the graph.
WAITING = {"orphan": f"{RELATED}, missing_endpoint string"}


#: Fixed value: what an identifier may be made of. And where a store may lie.
IDENTIFIER = re.compile(r"[A-Za-z0-9_.-]+")
STORE_SCHEMES = ("", "file", "hdfs", "viewfs", "s3a", "gs", "abfss")


def safe_store(uri: str, schemes: tuple[str, ...] = STORE_SCHEMES) -> str:
    """``uri`` if it is a store's place: a known scheme, plain names, and neither user nor query nor fragment, which may hold secrets."""
    parts = urlsplit(uri)
    if parts.scheme not in schemes or parts.username or parts.password or parts.query or parts.fragment:
        raise ValueError("this is no place for a store")
    names = [x for x in parts.path.split("/") if x]
    if not names or any(x == ".." or not IDENTIFIER.fullmatch(x) for x in names):
        raise ValueError("names in a store's place are made of letters, digits, _, . and -")
    return uri


class GraphError(Exception):
    """Base of the errors below."""


class QueryTimeout(GraphError):
    pass


class BatchSizeExceeded(GraphError):
    pass


class UnsupportedQueryType(GraphError):
    pass


class UnsafeQuery(GraphError):
    pass


class TextQueryTimeout(GraphError):
    pass


class QueryGenerationError(GraphError):
    pass


class CommunityDetectionError(GraphError):
    pass


@dataclass(frozen=True)
class Settings:
    """Tunables and their checks."""

    chunk_size: int = CHUNK_SIZE
    chunk_overlap: int = CHUNK_OVERLAP
    batch_size: int = 5
    orphan_policy: str = "log_orphan"
    canonical_mode: str = "slug"
    canonical_threshold: float = 0.92
    canonical_stoplist: tuple[str, ...] = field(default_factory=tuple)
    text_query_timeout: int = 10
    community_max_calls: int = 150
    summary_chunk_tokens: int = 12_000
    log_retention_days: int = 7

    def __post_init__(self):
        checks = {
            "chunk_overlap must be below chunk_size": 0 <= self.chunk_overlap < self.chunk_size,
            "orphan_policy must be log_orphan or fail_loud": self.orphan_policy in ("log_orphan", "fail_loud"),
            "canonical_mode must be slug or fuzzy": self.canonical_mode in ("slug", "fuzzy"),
            "canonical_threshold must be in [0.5, 1]": 0.5 <= self.canonical_threshold <= 1,
            "text_query_timeout must be in [1, 60]": 1 <= self.text_query_timeout <= 60,
            "summary_chunk_tokens must be in [1000, 60000]": 1000 <= self.summary_chunk_tokens <= 60_000,
            "batch_size must be positive": self.batch_size > 0,
            "log_retention_days must be positive": self.log_retention_days > 0,
        }
        for message, good in checks.items():
            if not good:
                raise ValueError(message)

    @staticmethod
    def from_environment(env: dict[str, str], prefix: str = "GRAPHLOOM_") -> "Settings":
        """Settings from variables such as GRAPHLOOM_CHUNK_SIZE; unknown names and bad values fail at once."""
        given = {}
        for name, kind in Settings.__annotations__.items():
            if (raw := env.get(prefix + name.upper())) is not None:
                given[name] = tuple(x.strip() for x in raw.split(",") if x.strip()) if "tuple" in kind else {"int": int, "float": float}.get(kind, str)(raw)
        return Settings(**given)
