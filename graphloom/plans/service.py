"""Typed queries, their dispatcher and the tools, over any set of graph tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema as S
from ..functions.scalar import clamp
from ..operators import evaluate, lookup, postings, search, textquery, traverse
from ..streaming import query_log


@dataclass(frozen=True)
class EntityQuery:
    name: str
    kind: str | None = None
    limit: int = S.LOOKUP_LIMIT


@dataclass(frozen=True)
class RelationQuery:
    start: str
    depth: int = 1
    kind: str | None = None


@dataclass(frozen=True)
class PathQuery:
    start: str
    end: str
    max_depth: int = S.MAX_DEPTH


@dataclass(frozen=True)
class BatchEntityQuery:
    ids: tuple[str, ...]


@dataclass(frozen=True)
class CommunityQuery:
    question: str
    level: int = 1
    limit: int = S.TOP_SUMMARIES


@dataclass(frozen=True)
class SimilarityQuery:
    """Reserved: always rejected."""

    vector: tuple[float, ...] = ()


@dataclass
class Tables:
    entities: DataFrame
    relations: DataFrame
    mentions: DataFrame
    chunks: DataFrame
    summaries: DataFrame | None = None
    #: Index of the chunks' texts; without it, searches read the texts.
    index: postings.SearchIndex | None = None

    @staticmethod
    def of_store(store) -> Tables:
        """The tables of a store, and its search index if that tells of the chunks as they are."""
        index = postings.SearchIndex(store.spark, f"{store.path}/_chunk_terms")
        fits = index.note() == str(store.version("chunk")[0])
        return Tables(store.read("entity"), store.read("related"), store.read("mentions"), store.read("chunk"), store.read("summary"), index if fits else None)


@dataclass
class Result:
    """Rows by name, and the query's metadata: total, milliseconds, depth as it was clamped, cursor."""

    rows: dict[str, list] = field(default_factory=dict)
    total: int = 0
    query_ms: float = 0.0
    depth: int | None = None
    cursor: str | None = None
    errors: list[str] = field(default_factory=list)


class GraphService:
    """All reads of a graph. ``log``: gets one log entry per call, errors too. Answers are bounded by limits, so they are collected."""

    def __init__(self, tables: Tables, log: Callable[[dict], None] | None = None, clock: Callable[[], float] = time.perf_counter, settings: S.Settings | None = None):
        self.tables, self.log, self.clock, self.settings = tables, log or (lambda _: None), clock, settings or S.Settings()

    def _timed(self, tool: str, kind: str, params: dict, run: Callable[[], Result]) -> Result:
        began = self.clock()
        try:
            out = run()
        except Exception as e:
            self.log(query_log.entry(tool, kind, params, 0, 1000 * (self.clock() - began), f"{type(e).__name__}: {e}"))
            raise
        out.query_ms = 1000 * (self.clock() - began)
        self.log(query_log.entry(tool, kind, params, out.total, out.query_ms, "; ".join(out.errors) or None))
        return out

    @staticmethod
    def _result(depth: int | None = None, **frames: DataFrame) -> Result:
        rows = {k: df.collect() for k, df in frames.items()}
        return Result(rows, sum(map(len, rows.values())), depth=depth)

    def execute(self, q) -> Result:
        """Dispatch a typed query; similarity and community queries have no place here."""
        if isinstance(q, EntityQuery):
            return self.find_entity(q.name, q.kind, q.limit)
        if isinstance(q, RelationQuery):
            return self.traverse_relationships(q.start, q.depth, q.kind)
        if isinstance(q, PathQuery):
            return self.find_path(q.start, q.end, q.max_depth)
        if isinstance(q, BatchEntityQuery):
            return self.find_batch(list(q.ids))
        raise S.UnsupportedQueryType(type(q).__name__)

    def find_entity(self, name: str, kind: str | None = None, limit: int = S.LOOKUP_LIMIT) -> Result:
        t = self.tables
        return self._timed("find_entity", "entity", {"name": name, "type": kind}, lambda: self._result(entities=lookup.find_entity(t.entities, t.mentions, name, kind, limit, search.search_entities)))

    def find_batch(self, ids: list[str]) -> Result:
        return self._timed("find_batch", "batch_entity", {"ids": len(ids)}, lambda: self._result(entities=lookup.find_batch(self.tables.entities, self.tables.mentions, ids)))

    def traverse_relationships(self, start: str, depth: int = 1, kind: str | None = None) -> Result:
        def run() -> Result:
            nodes, edges = traverse.traverse(self.tables.entities, self.tables.relations, start, depth, kind)
            return self._result(clamp(depth, 0, S.MAX_DEPTH), entities=nodes, relations=edges)

        return self._timed("traverse_relationships", "relation", {"start": start, "depth": depth, "type": kind}, run)

    def find_path(self, start: str, end: str, max_depth: int = S.MAX_DEPTH) -> Result:
        return self._timed("find_path", "path", {"start": start, "end": end}, lambda: self._result(clamp(max_depth, 1, S.MAX_DEPTH), paths=traverse.shortest_path(self.tables.relations, start, end, max_depth)))

    def search_chunks(self, text: str, limit: int = S.SEARCH_LIMIT) -> Result:
        return self._timed("search_chunks", "chunks", {"query": text}, lambda: self._result(chunks=self._chunks(text, limit)))

    def _chunks(self, text: str, limit: int) -> DataFrame:
        t = self.tables
        return postings.search_chunks(t.index, t.chunks, text, limit) if t.index else search.search_chunks(t.chunks, text, limit)

    def list_entities(self, after: str | None = None, size: int = S.PAGE_SIZE, kind: str | None = None) -> Result:
        def run() -> Result:
            out = self._result(entities=lookup.page(lookup.of_type(self.tables.entities, kind), after, size))
            out.cursor = lookup.next_cursor(out.rows["entities"], after, "id")
            return out

        return self._timed("list_entities", "page", {"after": after, "size": size}, run)

    def count_entities(self, kind: str | None = None) -> int:
        out = self._timed("count_entities", "count", {"type": kind}, lambda: Result(total=lookup.count_entities(self.tables.entities, kind).first().total))
        return out.total

    def search_rag(self, text: str, limit: int = S.SEARCH_LIMIT, include_relations: bool = True) -> Result:
        def run() -> Result:
            """Each part is run once and collected; what fails is told in ``errors``, not raised."""
            t, out = self.tables, Result()

            def part(name: str, make: Callable[[], DataFrame]) -> None:
                try:
                    out.rows[name] = make().collect()
                except Exception as e:  # noqa: BLE001  each source answers for itself
                    out.errors.append(f"{name}: {type(e).__name__}")

            part("chunks", lambda: self._chunks(text, limit))
            part("entities", lambda: lookup.find_entity(t.entities, t.mentions, text, limit=limit, search=search.search_entities))
            if include_relations and out.rows.get("entities"):
                first = min(out.rows["entities"], key=lambda r: (r.tier, -r.confidence, len(r.name), r.id))
                part("relations", lambda: traverse.traverse(t.entities, t.relations, first.id, 1)[1])
            out.total = sum(map(len, out.rows.values()))
            return out

        return self._timed("search_rag", "rag", {"query": text}, run)

    def query_text(self, spark: SparkSession, question: str, generate: Callable[[str, str, str | None], str], timeout: float | None = None) -> Result:
        """Rows of a generated query, in ``timeout`` seconds or those of the settings."""
        timeout, names = self.settings.text_query_timeout if timeout is None else timeout, []
        for name in ("entities", "relations", "mentions", "chunks"):
            getattr(self.tables, name).createOrReplaceTempView(f"graph_{name}")
            names.append(f"graph_{name}")
        return self._timed("query_text", "text", {"question": question}, lambda: self._result(rows=textquery.ask(spark, question, names, generate, timeout)))

    def ask_global(self, question: str, level: int = 1, limit: int = S.TOP_SUMMARIES, compose=None) -> Result:
        def run() -> Result:
            if self.tables.summaries is None:
                raise S.UnsupportedQueryType("there are no summaries")
            out = evaluate.ask_global(self.tables.summaries, question, level, limit, compose)
            return Result({"answer": [out["answer"]], "citations": out["citations"]}, len(out["citations"]))

        return self._timed("ask_global", "global", {"question": question, "level": level}, run)

    def contexts(self, question: str, most: int = 15) -> list[str]:
        """Texts for a local answer: chunks, then entities' descriptions, at most ``most``."""
        chunks = [r.text for r in self.search_chunks(question).rows["chunks"]]
        entities = [r.description for r in self.find_entity(question).rows["entities"]]
        return (chunks + entities)[:most]


def optimise_layout(tables: Tables, path: str) -> None:
    """Layouts in place of indexes: entities sorted by id and by name, relations by source, and the search indexes."""
    tables.entities.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/entity_by_id")
    tables.entities.repartitionByRange("name").sortWithinPartitions("name").write.mode("overwrite").parquet(f"{path}/entity_by_name")
    tables.relations.repartitionByRange("src", "type").sortWithinPartitions("src", "type").write.mode("overwrite").parquet(f"{path}/related_by_src")
    chunks = postings.SearchIndex(tables.chunks.sparkSession, f"{path}/chunk_terms")
    chunks.build(tables.chunks, F.col("text"))
    postings.SearchIndex(tables.chunks.sparkSession, f"{path}/entity_terms", {"id": "string"}).build(tables.entities, search.entity_text())
