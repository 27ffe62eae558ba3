"""Entity lookup, batch reads, counts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import provenance
from ..schema import LOOKUP_LIMIT, MAX_BATCH, PAGE_SIZE, BatchSizeExceeded
from .traverse import checkpointed

#: Confidence by tier.
CONFIDENCE = {1: 1.0, 2: 0.8, 3: 0.6, 4: 0.4}


def first_mention(mentions: DataFrame) -> DataFrame:
    """(entity_id, book_id, chunk_index) of the least chunk that mentions an entity: combined before the shuffle."""
    least = F.min(F.struct("book_id", "chunk_index")).alias("m")
    return mentions.groupBy("entity_id").agg(least).select("entity_id", "m.book_id", "m.chunk_index")


def with_provenance(found: DataFrame, mentions: DataFrame) -> DataFrame:
    """Add ``source``. ``found`` is a result of bounded size, so mentions are filtered to it before they are combined."""
    own = mentions.join(found.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    return found.join(first_mention(own), found["id"] == F.col("entity_id"), "left").withColumn("source", provenance(F.col("chunk_index"), F.col("book_id"))).drop("entity_id", "book_id", "chunk_index")


def of_type(entities: DataFrame, kind: str | None) -> DataFrame:
    return entities if kind is None else entities.where(F.col("type") == kind)


def tier(entities: DataFrame, name: str, number: int) -> DataFrame:
    """Matches of one tier: exact, without case, containing (in order of length)."""
    condition = {1: F.col("name") == name, 2: F.lower("name") == name.lower(), 3: F.col("name").contains(name)}[number]
    return entities.where(condition).withColumn("tier", F.lit(number)).withColumn("confidence", F.lit(CONFIDENCE[number]))


def find_entity(entities: DataFrame, mentions: DataFrame, name: str, kind: str | None = None, limit: int = LOOKUP_LIMIT, search=None) -> DataFrame:
    """The first tier that has matches, at most ``limit`` by (score, length of name, id).

    One scan computes each row's best tier; the least tier of all is a
    bounded aggregate.  ``search(entities, name)`` gives (id, score) of full
    text and is asked only if the other tiers are empty; if it fails, nothing
    is found.
    """
    own = of_type(entities, kind)
    best = F.when(F.col("name") == name, 1).when(F.lower("name") == name.lower(), 2).when(F.col("name").contains(name), 3)
    ranked = own.withColumn("tier", best).where("tier IS NOT NULL")
    least = ranked.agg(F.min("tier").alias("least"))  # one row
    found = ranked.join(F.broadcast(least), F.col("tier") == F.col("least")).drop("least")
    confidence = F.element_at(F.create_map(*(F.lit(x) for pair in CONFIDENCE.items() for x in pair)), F.col("tier"))
    found = found.withColumn("confidence", confidence)
    if search is not None and found.isEmpty():
        try:
            scored = search(own, name)
            found = own.join(scored, "id").withColumn("tier", F.lit(4)).withColumn("confidence", F.col("score") * CONFIDENCE[4]).drop("score")
            found.schema  # noqa: B018  analysed here, so that a failure is seen
        except Exception:  # noqa: BLE001  the last tier degrades to an empty answer
            found = found.limit(0)
    top = found.orderBy("tier", F.desc("confidence"), F.length("name"), "id").limit(limit)
    return with_provenance(top, mentions)


def find_batch(entities: DataFrame, mentions: DataFrame, ids: list[str]) -> DataFrame:
    """Entities of up to MAX_BATCH ids with provenance; ids that are missing are absent."""
    if len(ids) > MAX_BATCH:
        raise BatchSizeExceeded(f"{len(ids)} ids; at most {MAX_BATCH}")
    return with_provenance(entities.where(F.col("id").isin(list(dict.fromkeys(ids)))), mentions)


def count_entities(entities: DataFrame, kind: str | None = None) -> DataFrame:
    return of_type(entities, kind).agg(F.count("*").alias("total"))


def with_row_ids(entities: DataFrame, order: str = "id") -> DataFrame:
    """``row_id`` 1, 2, ... in order of a unique column, without one task that orders all rows: ranges are numbered apart and shifted by what is before them.

    The ranges are written once: made anew for each use, they may have other
    bounds, as these are drawn from a sample.
    """
    ranged = entities.repartitionByRange(order).sortWithinPartitions(order).withColumn("__m", F.monotonically_increasing_id())
    ranged = checkpointed(ranged.withColumn("__range", F.shiftright("__m", 33)).withColumn("__in", F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__m"))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    counts = counts.select(F.col("__range").alias("__r"), before.alias("__before"))
    return ranged.join(counts, F.col("__range") == F.col("__r")).withColumn("row_id", F.col("__in") + F.col("__before") + 1).drop("__range", "__in", "__r", "__before")


def page(entities: DataFrame, after: str | None = None, size: int = PAGE_SIZE, order: str = "id") -> DataFrame:
    """The next ``size`` rows after a key: the filter reaches the scan and a top-k replaces a sort."""
    own = entities if after is None else entities.where(F.col(order) > after)
    return own.orderBy(order).limit(size)


def next_cursor(rows: list, after: str | None, order: str = "id") -> str | None:
    return rows[-1][order] if rows else after


def first_of_each(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
