"""Versioned tables with idempotent upserts, orphan handling, snapshots and dead letters.

Parquet has no MERGE.  A table's rows are dealt to buckets by a hash of their
key, each a folder.  A version is a list of these folders in a numbered pointer
file: an upsert reads and writes only the buckets that its keys fall in, and
its pointer names the other folders as they were.  The highest pointer that is
whole counts, so a version that is being read is never touched, and a write
that fails at any step leaves the last one.  A writer makes the pointer after
the one it has read; if another writer was first, it fails and has changed
nothing.

Relations whose ends are not there wait in a table of their own, by key.  An
upsert of entities moves those that have both ends now, so the order in which
entities and relations come does not matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..schema import KEYS, SCHEMAS, WAITING
from .alike import pair_counts
from .traverse import checkpointed


#: Buckets of a new table: enough that one is rewritten by one task, few enough to be listed.
BUCKETS = 32


class ConcurrentWrite(RuntimeError):
    """Another writer was first; read again and repeat."""


class MissingEnds(ValueError):
    """Relations name entities that are not there. ``ids``: all their ids in order; the message has the first hundred and their number."""

    def __init__(self, ids: DataFrame):
        self.ids = ids.orderBy("id")
        first, n = [r.id for r in self.ids.limit(100).collect()], ids.count()
        super().__init__(f"relations with {n} missing ends: {', '.join(first)}{', ...' if n > len(first) else ''}")


def last_of_each(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with one key the last in ``order``, which must not tie."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))).where("__n = 1").drop("__n")


def _same(a: str, b: str, key: list[str]):
    condition = F.lit(True)
    for k in key:
        condition = condition & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return condition


def upserted(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All new rows, and the existing ones whose key (null-safe) is not among them."""
    kept = existing.alias("e").join(new.select(*key).alias("n"), _same("e", "n", key), "left_anti")
    return kept.unionByName(new.select(*existing.columns))


def split_orphans(relations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, orphans with ``missing_endpoint`` source, target or both). ``ids``: id, distinct; they may be many, so they are not sent to the driver."""
    known = ids.select("id").distinct().hint("merge")
    joined = relations.join(known.select(F.col("id").alias("__s")), F.col("src") == F.col("__s"), "left").join(known.select(F.col("id").alias("__d")), F.col("dst") == F.col("__d"), "left")
    missing = F.when(F.col("__s").isNull() & F.col("__d").isNull(), "both").when(F.col("__s").isNull(), "source").when(F.col("__d").isNull(), "target")
    marked = joined.withColumn("missing_endpoint", missing).drop("__s", "__d")
    return marked.where("missing_endpoint IS NULL").drop("missing_endpoint"), marked.where("missing_endpoint IS NOT NULL")


def orphan_counts(relations: DataFrame, members: DataFrame, ids: DataFrame) -> DataFrame:
    """(missing_endpoint, n) of relations and of those between all ``members`` of a group (see ``alike``), which are not made; none: both ends are there."""
    valid, orphans = split_orphans(relations, ids)
    plain = orphans.select("missing_endpoint").union(valid.select(F.lit("none"))).groupBy("missing_endpoint").agg(F.count("*").alias("n"))
    known = ids.select(F.col("id").alias("node"), F.lit(True).alias("known")).distinct()
    counts = pair_counts(members.join(known, "node", "left").withColumn("label", F.coalesce("known", F.lit(False))))
    name = F.when(F.col("label") & F.col("other"), "none").when(F.col("other"), "source").when(F.col("label"), "target").otherwise("both")
    return plain.unionByName(counts.select(name.alias("missing_endpoint"), "n")).groupBy("missing_endpoint").agg(F.sum("n").alias("n"))


def missing_ids(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct ends of relations that are no entity."""
    return relations.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(ids.select("id"), "id", "left_anti")


def merged_mentions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Mentions by key; a page that is there stays, else the new one is taken."""
    key = KEYS["mentions"]
    none = F.lit(None).cast("int")
    both = existing.select(*key, F.col("source_page").alias("old"), none.alias("new")).unionByName(new.select(*key, none.alias("old"), F.col("source_page").alias("new")))
    # least numbers are combined by hash before the shuffle; least structs would have all rows sorted by key, twice
    return both.groupBy(*key).agg(F.coalesce(F.min("old"), F.min("new")).alias("source_page"))


class TableStore:
    """Tables below one folder, which may be in any store that Spark reads. ``buckets``: of tables that are not there yet."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs  # noqa: SLF001

    # -- versions ----------------------------------------------------------
    def _file(self, *parts: str):
        path = self._fs.Path("/".join([self.path, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001

    def _pointers(self, table: str) -> dict[int, str]:
        """Versions by number: the number of buckets, then each bucket and its folder, and a dot if the file is whole."""
        folder, fs = self._file(table, "_versions")
        out = {}
        for f in fs.listStatus(folder) if fs.exists(folder) else []:
            stream = fs.open(f.getPath())
            try:
                lines = []
                while (line := stream.readLine()) is not None:
                    lines.append(line)
                out[int(f.getPath().getName())] = "\n".join(lines)
            finally:
                stream.close()
        return out

    def version(self, table: str) -> tuple[int, str | None]:
        """Number and content of the current version."""
        return max(((n, v) for n, v in self._pointers(table).items() if v.endswith(".")), default=(0, None))

    def _folders(self, table: str, version: tuple[int, str | None]) -> tuple[int, dict[int, str]]:
        """Number of buckets, and the folder of each that has rows."""
        if version[1] is None:
            return self.buckets, {}
        count, *lines = version[1].split("\n")[:-1]
        return int(count), {int(k): folder for k, folder in (x.split(" ", 1) for x in lines)}

    @staticmethod
    def _fields(table: str) -> list[T.StructField]:
        return T._parse_datatype_string((SCHEMAS | WAITING)[table]).fields  # noqa: SLF001  pyspark's own parser of DDL text

    def _aligned(self, table: str, rows: DataFrame, *more: str) -> DataFrame:
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self._fields(table)), *more)

    def _bucket(self, table: str, count: int, key: list[str] | None = None) -> Column:
        """The bucket of a row; nulls count as any other value. ``key``: columns that hold the table's key elsewhere."""
        types = {f.name: f.dataType for f in self._fields(table)}
        return F.pmod(F.xxhash64(*(F.col(c).cast(types[k]) for k, c in zip(KEYS[table], key or KEYS[table]))), F.lit(count)).cast("int")

    # -- reading -----------------------------------------------------------
    def _read(self, table: str, folders: list[str]) -> DataFrame:
        schema = (SCHEMAS | WAITING)[table]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{table}/{f}" for f in folders))

    def read(self, table: str, version: tuple[int, str | None] | None = None) -> DataFrame:
        return self._read(table, list(self._folders(table, version or self.version(table))[1].values()))

    def _touched(self, table: str, rows: DataFrame, count: int, key: list[str] | None = None) -> list[int]:
        """The buckets of some keys: a number for each at most."""
        return sorted(r.b for r in rows.select(self._bucket(table, count, key).alias("b")).distinct().collect())

    def read_near(self, table: str, rows: DataFrame, key: list[str] | None = None, version: tuple[int, str | None] | None = None) -> DataFrame:
        """The buckets that may hold the keys of ``rows``; all other folders are left alone."""
        count, folders = self._folders(table, version or self.version(table))
        return self._read(table, [folders[b] for b in self._touched(table, rows, count, key) if b in folders])

    # -- writing -----------------------------------------------------------
    def _store(self, table: str, rows: DataFrame, count: int) -> dict[int, str]:
        """Write rows by bucket; the new folders."""
        folder, name = f"v-{uuid.uuid4().hex}", "bucket"
        rows.withColumn(name, self._bucket(table, count)).repartition(name).write.partitionBy(name).parquet(f"{self.path}/{table}/{folder}")
        path, fs = self._file(table, folder)
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith(f"{name}=")}

    def write(self, table: str, rows: DataFrame, after: tuple[int, str | None] | None = None) -> None:
        """Make ``rows`` the table. ``after``: the version that they were made from, which must still be the current one."""
        after = after or self.version(table)
        count = self._folders(table, after)[0]
        self._point(table, count, self._store(table, self._aligned(table, rows), count), after)

    def merge(self, table: str, rows: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], after: tuple[int, str | None] | None = None) -> None:
        """Replace the buckets of ``rows`` (the table's columns) by ``combine(their rows, rows)``; all other buckets keep their files."""
        after = after or self.version(table)
        count, folders = self._folders(table, after)
        touched = self._touched(table, rows, count)
        if not touched:
            return
        made = self._store(table, self._aligned(table, combine(self._read(table, [folders[b] for b in touched if b in folders]), rows)), count)
        self._point(table, count, {b: f for b, f in folders.items() if b not in touched} | made, after)

    def _point(self, table: str, count: int, folders: dict[int, str], after: tuple[int, str | None]) -> None:
        known = self._pointers(table)
        if self.version(table) != after:
            raise ConcurrentWrite(f"{table} was written meanwhile")
        pointer, fs = self._file(table, "_versions", f"{max(known, default=0) + 1:012d}")
        try:
            stream = fs.create(pointer, False)  # fails if another writer is first
        except Exception as e:
            raise ConcurrentWrite(f"{table} is being written") from e
        stream.writeBytes("\n".join([str(count), *(f"{b} {f}" for b, f in sorted(folders.items())), "."]))  # the dot says that the list is whole
        stream.close()
        # readers of the last version go on; folders that neither has are gone
        kept = set(folders.values()) | set(self._folders(table, after)[1].values())
        for n in sorted(known):
            if n != after[0]:
                old, _ = self._file(table, "_versions", f"{n:012d}")
                fs.delete(old, False)
                if known[n].endswith("."):
                    for f in set(self._folders(table, (n, known[n]))[1].values()) - kept:
                        fs.delete(self._file(table, f)[0], True)

    def upsert(self, table: str, rows: DataFrame, order: str | None = None) -> None:
        """Rows replace those with their keys; of several rows with one key the last counts, by ``order`` or else as they come."""
        key, at = KEYS[table], self.version(table)
        if not order:
            rows, order = rows.withColumn("__order", F.monotonically_increasing_id()), "__order"
        last = checkpointed(last_of_each(self._aligned(table, rows, order), key, order).drop(order))
        self.merge(table, last, lambda old, new: upserted(old, new, key), at)
        if table == "entity":
            self.replay_orphans(last.select("id"))

    def delete(self, table: str, keys: DataFrame) -> None:
        """Rows with these keys go; only their buckets are written."""
        key, at = KEYS[table], self.version(table)
        count, folders = self._folders(table, at)
        near = [folders[b] for b in self._touched(table, keys, count) if b in folders]
        keys = checkpointed(self._read(table, near).alias("e").join(keys.select(*key).alias("n"), _same("e", "n", key), "left_semi").select(*key)) if near else None
        touched = self._touched(table, keys, count) if near else []  # those that have any of them
        if touched:
            left = self._read(table, [folders[b] for b in touched]).alias("e").join(keys.alias("n"), _same("e", "n", key), "left_anti")
            self._point(table, count, {b: f for b, f in folders.items() if b not in touched} | self._store(table, left, count), at)

    def upsert_relations(self, rows: DataFrame, policy: str = "log_orphan", dead_letters: str | None = None) -> int:
        """Write relations whose ends are entities; returns the number of orphans, which wait for their ends. fail_loud raises before anything is written."""
        rows = checkpointed(self._aligned("related", rows))
        near = self.read_near("entity", rows.select(F.explode(F.array("src", "dst")).alias("id"))).select("id")
        valid, orphans = map(checkpointed, split_orphans(rows, near))
        n = orphans.count()
        if n and policy == "fail_loud":
            raise MissingEnds(checkpointed(missing_ids(orphans, near)))
        if n and dead_letters:
            orphans.select(F.lit("missing_endpoint").alias("reason"), "type", F.col("src").alias("source_entity_id"), F.col("dst").alias("target_entity_id"), "description", "source_page", "chunk_index", "missing_endpoint", F.current_timestamp().alias("timestamp")).write.mode("append").json(dead_letters)
        if n:
            self.upsert("orphan", orphans)
        self.upsert("related", valid)
        self.delete("orphan", valid)  # what waited under the same key is older
        return n

    def replay_orphans(self, ids: DataFrame) -> None:
        """Waiting relations with one of these entities as an end move to the relations once both ends are there.

        They are written before they are taken off the waiting ones, so what a run that stops leaves undone is done by the next.
        """
        waiting = self.read("orphan")
        named = waiting.join(ids.select(F.col("id").alias("src")), "src", "left_semi").union(waiting.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*waiting.columns)).distinct()
        named = checkpointed(named)
        if named.isEmpty():
            return
        valid, still = split_orphans(named.drop("missing_endpoint"), self.read_near("entity", named.select(F.explode(F.array("src", "dst")).alias("id"))).select("id"))
        valid = checkpointed(valid)
        if not valid.isEmpty():
            self.upsert("related", valid)
            self.delete("orphan", valid)
        self.upsert("orphan", still)  # with the end that is missing now

    def upsert_mentions(self, rows: DataFrame) -> None:
        """Mentions of chunks and entities that are there; others match nothing."""
        rows = checkpointed(rows.select("chunk_index", "book_id", "entity_id"))
        chunks = self.read_near("chunk", rows).select("chunk_index", "book_id")
        entities = self.read_near("entity", rows, ["entity_id"]).select(F.col("id").alias("entity_id"), F.col("source_page").alias("page"))
        known = rows.alias("e").join(chunks.alias("n"), _same("e", "n", ["chunk_index", "book_id"]), "left_semi").join(entities, "entity_id")
        self.merge("mentions", checkpointed(self._aligned("mentions", known.withColumnRenamed("page", "source_page"))), merged_mentions)

    def clear(self, tables: tuple[str, ...] = ("mentions", "related", "hierarchy", "summary", "chunk", "section", "chapter", "book", "entity", "orphan")) -> None:
        """Empty tables, edges before nodes."""
        for t in tables:
            self.write(t, self.spark.createDataFrame([], (SCHEMAS | WAITING)[t]))

    def counts(self) -> dict[str, int]:
        return {t: self.read(t).count() for t in SCHEMAS}

    def snapshot(self, folder: str) -> None:
        for t in SCHEMAS:
            self.read(t).write.mode("overwrite").json(f"{folder}/{t}")

    def restore(self, folder: str) -> None:
        """Merge a snapshot by natural keys; relations keep their types."""
        for t in SCHEMAS:
            rows = self.spark.read.schema(SCHEMAS[t]).json(f"{folder}/{t}")
            self.upsert(t, rows)


def verify_counts(before: dict[str, int], after: dict[str, int], expected_chunks: int, tolerance: float = 0.01) -> list[str]:
    """What is wrong with a rebuilt index: chunks off by more than the tolerance (one at least), fewer entities, no mentions."""
    problems = []
    if abs(after["chunk"] - expected_chunks) > max(tolerance * expected_chunks, 1):
        problems.append(f"chunks: {after['chunk']}, expected {expected_chunks}")
    if after["entity"] < before.get("entity", 0):
        problems.append("entities decreased")
    if not after.get("mentions"):
        problems.append("no mentions")
    return problems


def line_count(spark: SparkSession, path: str) -> int:
    """Lines that are not blank; 0 if there is no such file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):  # noqa: SLF001
        return 0
    return spark.read.text(path).where(F.trim("value") != "").count()


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")
