"""Full text: tokens, inverted index and BM25."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .traverse import checkpointed

K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_terms(text: str) -> list[str]:
    return sorted(set(re.findall(r"[^\W_]+", text.lower())))


def inverted_index(rows: DataFrame, key: list[str], text: Column) -> DataFrame:
    """(key, term, tf, length): the table to write, partitioned or sorted by term, where texts are searched often."""
    own = rows.select(*key, tokens(text).alias("terms")).withColumn("length", F.size("terms"))
    return own.select(*key, "length", F.explode("terms").alias("term")).groupBy(*key, "length", "term").agg(F.count("*").alias("tf"))


def _equals(word: str):
    return lambda t: t == F.lit(word)


def bm25(rows: DataFrame, key: list[str], text: Column, query: str) -> DataFrame:
    """(key, score) of the rows that have any term of the query.

    One pass over the texts: lengths and counts of the query's terms are
    written once, and statistics (documents, mean length, document
    frequencies: one row) and scores are read from there.
    """
    terms = query_terms(query)
    if not terms:
        return rows.select(*key, F.lit(0.0).alias("score")).limit(0)
    own = rows.select(*key, tokens(text).alias("terms"))
    counts = [F.size(F.filter("terms", _equals(w))) for w in terms]
    own = checkpointed(own.select(*key, F.coalesce(F.size("terms"), F.lit(0)).alias("length"), F.array(*counts).alias("tf")))
    stats = own.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.array(*(F.sum((F.col("tf")[k] > 0).cast("long")) for k in range(len(terms)))).alias("df"))
    joined = own.where(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))  # stats has one row

    def part(k: int) -> Column:
        idf = F.log(1 + (F.col("n") - F.col("df")[k] + 0.5) / (F.col("df")[k] + 0.5))
        tf = F.col("tf")[k]
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))

    score = part(0)
    for k in range(1, len(terms)):
        score = score + part(k)
    return joined.select(*key, score.alias("score"))


def search_chunks(chunks: DataFrame, query: str, limit: int = 10, key: tuple[str, ...] = ("chunk_index", "book_id")) -> DataFrame:
    """The best ``limit`` chunks with their texts; only their keys are joined back."""
    best = bm25(chunks, list(key), F.col("text"), query).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), *key).limit(limit)
    return chunks.join(F.broadcast(best), list(key)).orderBy(F.desc("score"), *key)  # best has ``limit`` rows


def entity_text() -> Column:
    """Name, canonical name and aliases: what full-text lookup of entities covers."""
    return F.concat_ws(" ", F.array_distinct(F.concat(F.array_compact(F.array("name", "canonical_name")), F.coalesce("aliases", F.array().cast("array<string>")))))


def search_entities(entities: DataFrame, query: str) -> DataFrame:
    return bm25(entities, ["id"], entity_text(), query)


def search_rag(chunks: DataFrame, entities: DataFrame, mentions: DataFrame, edges: DataFrame, query: str, limit: int = 10, include_relations: bool = True) -> dict:
    """Chunks, entities and the first entity's relations; what fails is told in ``errors``, not raised."""
    from . import lookup, traverse

    out: dict = {"chunks": None, "entities": None, "relations": None, "errors": []}
    for name, make in (("chunks", lambda: search_chunks(chunks, query, limit)), ("entities", lambda: lookup.find_entity(entities, mentions, query, limit=limit, search=search_entities))):
        try:
            out[name] = make()
        except Exception as e:  # noqa: BLE001  each source answers for itself
            out["errors"].append(f"{name}: {type(e).__name__}")
    if include_relations and out["entities"] is not None and (first := out["entities"].orderBy("tier", F.desc("confidence"), F.length("name"), "id").first()):
        out["relations"] = traverse.traverse(entities, edges, first.id, 1)[1]
    out["total"] = sum(out[k].count() for k in ("chunks", "entities", "relations") if out[k] is not None)
    return out
