"""From chunks to entities, relations and mentions with a pluggable extractor."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import entity_id, filter_aliases, fuzzy_entity_id, slug
from ..schema import Settings

#: What an extractor returns for one chunk, as a column.
EXTRACTED = "struct<ok:boolean,error_type:string,error_message:string,entities:array<struct<name:string,type:string,description:string,aliases:array<string>,canonical_name:string>>,relations:array<struct<source:string,target:string,type:string,description:string>>>"


def extract(chunks: DataFrame, extractor: Callable[[str], dict]) -> DataFrame:
    """Add ``extracted``. An extractor's error is a value of the row, so one bad chunk stops nothing."""

    def one(text: str | None) -> dict:
        empty = {"ok": False, "error_type": None, "error_message": None, "entities": [], "relations": []}
        try:
            return empty | {"ok": True} | extractor(text or "")
        except Exception as e:  # noqa: BLE001  goes to the dead letters
            return empty | {"error_type": type(e).__name__, "error_message": str(e)}

    @F.pandas_udf(EXTRACTED)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["ok", "error_type", "error_message", "entities", "relations"])

    return chunks.withColumn("extracted", run("text"))


def split_failures(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that worked, dead letters)"""
    bad = extracted.where("NOT extracted.ok").select("chunk_index", F.struct(F.col("page_start").alias("start"), F.col("page_end").alias("end")).alias("page_ref"), "extracted.error_type", "extracted.error_message", F.current_timestamp().alias("timestamp"))
    return extracted.where("extracted.ok"), bad


def entities_of(extracted: DataFrame, stoplist: list[str] | None = None, near: float | None = None) -> DataFrame:
    """One row per entity and chunk with its id (always with the type) and filtered aliases, in order ``pos``. ``near``: similarity to the name from which a canonical name counts (default: always)."""
    made = entity_id if near is None else lambda name, canonical, kind: fuzzy_entity_id(name, canonical, kind, near)
    rows = extracted.select("chunk_index", "book_id", F.col("page_start").alias("source_page"), F.posexplode("extracted.entities").alias("pos", "e"))
    return rows.select("chunk_index", "book_id", "pos", made(F.col("e.name"), F.col("e.canonical_name"), F.col("e.type")).alias("id"), F.col("e.name").alias("name"), F.col("e.type").alias("type"), F.col("e.description").alias("description"), "source_page", filter_aliases(F.coalesce("e.aliases", F.array().cast("array<string>")), stoplist).alias("aliases"), F.col("e.canonical_name").alias("canonical_name"))


def name_map(entities: DataFrame) -> DataFrame:
    """(chunk_index, book_id, key, id): names, aliases and canonical names of a chunk's entities without case; a later entity overrides an earlier."""
    names = F.array_compact(F.concat(F.array("name"), "aliases", F.array("canonical_name")))
    rows = entities.select("chunk_index", "book_id", "pos", "id", F.explode(F.transform(names, lambda n: F.lower(n))).alias("key"))
    return rows.groupBy("chunk_index", "book_id", "key").agg(F.max_by("id", "pos").alias("id"))


def resolve(name: Column, found: Column) -> Column:
    return F.coalesce(found, F.concat(slug(name), F.lit("-concept")))


def relations_of(extracted: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with ids: by the chunk's own names, else the slug of the name as a concept."""
    rows = extracted.select("chunk_index", "book_id", F.col("page_start").alias("source_page"), F.explode("extracted.relations").alias("r")).select("chunk_index", "book_id", "source_page", "r.*")
    known = name_map(entities)
    for end, out in (("source", "src"), ("target", "dst")):
        m = known.select(F.col("chunk_index").alias("c"), F.col("book_id").alias("b"), "key", F.col("id").alias(f"__{out}"))
        rows = rows.join(m, (F.col("chunk_index") == F.col("c")) & F.col("book_id").eqNullSafe(F.col("b")) & (F.lower(end) == F.col("key")), "left").drop("c", "b", "key").withColumn(out, resolve(F.col(end), F.col(f"__{out}"))).drop(f"__{out}")
    return rows.select("src", "dst", "type", "description", "source_page", F.col("chunk_index").cast("long").alias("chunk_index"))


def mentions_of(entities: DataFrame) -> DataFrame:
    return entities.select(F.col("chunk_index").cast("long").alias("chunk_index"), "book_id", F.col("id").alias("entity_id"), "source_page").dropDuplicates(["chunk_index", "book_id", "entity_id"])


def lexicon_extractor(lexicon: dict[str, str], relation: str = "requires") -> Callable[[str], dict]:
    """A deterministic extractor: words of a lexicon (word to type), related in order of appearance."""

    def run(text: str) -> dict:
        found = list(dict.fromkeys(w for w in text.lower().split() if w in lexicon))
        return {
            "entities": [{"name": w, "type": lexicon[w], "description": w, "aliases": [], "canonical_name": None} for w in found],
            "relations": [{"source": a, "target": b, "type": relation, "description": f"{a} {b}"} for a, b in zip(found, found[1:])],
        }

    return run


def upsert_chunks(store, chunks: DataFrame) -> None:
    """Upsert chunks, and bring the store's search index after them.

    The index notes the version of the chunks that it tells of; where a run
    stopped between the two, or there is none, it is built anew.
    """
    from .postings import SearchIndex
    from .traverse import checkpointed

    index, text = SearchIndex(store.spark, f"{store.path}/_chunk_terms"), F.col("text")
    version = lambda: str(store.version("chunk")[0])
    before = version()
    fits = index.note() == before
    chunks = checkpointed(chunks.withColumn("chunk_index", F.col("chunk_index").cast("long")))
    keys = chunks.select(F.col("chunk_index").alias("c"), F.col("book_id").alias("b")).distinct()
    near = lambda: store.read_near("chunk", chunks).join(keys, (F.col("chunk_index") == F.col("c")) & F.col("book_id").eqNullSafe(F.col("b")), "left_semi")
    old = checkpointed(near()) if fits else None
    store.upsert("chunk", chunks)
    if version() == before:
        return
    if fits:
        index.update(near(), old, text, version())
    else:
        index.build(store.read("chunk"), text, version())


def index_chunks(store, chunks: DataFrame, extractor: Callable[[str], dict], dead_letters: str, orphan_letters: str, settings: Settings | None = None) -> dict[str, int]:
    """Chunks, then entities, relations (orphans aside; of equal ones the first by chunk) and mentions, all as upserts; returns counts."""
    from .traverse import checkpointed

    settings = settings or Settings()

    done = checkpointed(extract(chunks, extractor))
    good, bad = split_failures(done)
    bad.write.mode("append").json(dead_letters)
    entities = checkpointed(entities_of(good, list(settings.canonical_stoplist), settings.canonical_threshold if settings.canonical_mode == "fuzzy" else None))
    upsert_chunks(store, chunks)
    order = F.struct(F.coalesce("book_id", F.lit("")), "chunk_index", "pos")
    store.upsert("entity", entities.withColumn("seq", order), order="seq")
    rest = F.struct("chunk_index", "description", "source_page")
    first = relations_of(good, entities).groupBy("src", "dst", "type").agg(F.min(rest).alias("x")).select("src", "dst", "type", "x.description", "x.source_page", "x.chunk_index")
    orphans = store.upsert_relations(first, settings.orphan_policy, orphan_letters)
    store.upsert_mentions(mentions_of(entities))
    return {"chunks": chunks.count(), "failed": bad.count(), "orphans": orphans}
