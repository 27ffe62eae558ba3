"""A full-text index that searches read: postings by term, changed in segments.

A segment holds the postings of the rows that came with it, in folders by a
hash of the term, each sorted by term and block.  A block is a group of rows of
like length; for each term and block a small table has the number of rows, the
largest count of the term and the least length, so no row of the block scores
higher than these two would.  Rows that are replaced or deleted become
tombstones of a later segment, which also takes them off the numbers, so
document frequencies are exact without reading postings.

A search reads the folders of its terms only.  Blocks are scored from the
highest bound on; once ``limit`` rows beat every bound that is left, the other
blocks are never read.  Scores equal those of ``search.bm25`` to the last bit.

A segment counts once its marker file is written; of two writers of one number
the second fails.  ``build`` makes a segment that replaces all before it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .search import B, K1, query_terms, tokens
from .traverse import checkpointed, shared_folder

#: Folders of terms; blocks of each length class (one a doubling of the length), and classes.
BUCKETS, SPREAD, CLASSES = 64, 16, 20


def written(df: DataFrame) -> DataFrame:
    """Postings as a compressed table in the folder that all executors share: a checkpoint keeps every row's key and term as they are."""
    path = f"{shared_folder(df.sparkSession)}/posted-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Block:
    """The highest score that a row of a block can have, and rows that it has at least."""

    bound: float
    rows: int


class SearchIndex:
    """Index of rows with ``key`` columns below one folder, which may be in any store that Spark reads.

    Keys may hold nulls; of rows with one key the index expects one.  Rows
    without words are counted and never found; an index without rows finds
    nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: dict[str, str] | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.key = key or {"chunk_index": "long", "book_id": "string"}
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs  # noqa: SLF001

    # -- segments ----------------------------------------------------------
    def _file(self, *parts: str):
        path = self._fs.Path("/".join([self.path, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001

    def segments(self) -> list[int]:
        """Numbers of the segments that count: the last that was built, and those after it."""
        folder, fs = self._file("_segments")
        names = sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []
        first = max((int(n.split("-")[0]) for n in names if n.endswith("-base")), default=0)
        return [n for n in (int(x.split("-")[0]) for x in names) if n >= first]

    def _begin(self) -> int:
        """The next segment's number, which is this writer's from now on: another that wants it fails."""
        folder, fs = self._file("_writing")
        number = 1 + max((int(f.getPath().getName()) for f in fs.listStatus(folder)), default=0) if fs.exists(folder) else 1
        lock, fs = self._file("_writing", f"{number:09d}")
        fs.create(lock, False).close()
        return number

    def _mark(self, number: int, base: bool, note: str) -> None:
        marker, fs = self._file("_segments", f"{number:09d}{'-base' if base else ''}")
        stream = fs.create(marker, False)
        stream.writeBytes(note + "\n")
        stream.close()

    def note(self) -> str | None:
        """What was noted with the last segment: the version of the table that the index tells of."""
        folder, fs = self._file("_segments")
        last = max((f.getPath() for f in fs.listStatus(folder)), key=lambda p: p.getName(), default=None) if fs.exists(folder) else None
        if last is None:
            return None
        stream = fs.open(last)
        try:
            return stream.readLine()
        finally:
            stream.close()

    def _table(self, name: str, schema: str, parts: str) -> DataFrame:
        """A table over the segments that count; folders of terms are columns that filters prune."""
        folders = [f"{self.path}/{name}/seg={n}" for n in self.segments()]
        there = [f for f in folders if self._file(f.removeprefix(self.path + "/"))[1].exists(self._fs.Path(f))]
        if not there:
            return self.spark.createDataFrame([], f"{schema}, {parts}")
        return self.spark.read.option("basePath", f"{self.path}/{name}").schema(f"{schema}, {parts}").parquet(*there)

    def _keys(self) -> str:
        return ", ".join(f"{k} {t}" for k, t in self.key.items())

    def postings(self) -> DataFrame:
        return self._table("postings", f"term string, block int, {self._keys()}, tf int, length int", "seg int, bucket int")

    def blocks(self) -> DataFrame:
        """(term, block, n, max_tf, min_length): n is negative for rows that were taken off."""
        return self._table("blocks", "term string, block int, n long, max_tf int, min_length int", "seg int, bucket int")

    def totals(self) -> tuple[int, int]:
        """Rows and words."""
        t = self._table("totals", "n long, words long", "seg int").agg(F.sum("n"), F.sum("words")).first()
        return t[0] or 0, t[1] or 0

    def tombstones(self) -> DataFrame:
        """Keys whose postings before ``seg`` are gone."""
        return self._table("tombstones", self._keys(), "seg int")

    # -- writing -----------------------------------------------------------
    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _posted(self, rows: DataFrame, text: Column) -> DataFrame:
        """Postings of rows; a row without words has one without a term."""
        own = rows.select(*(F.col(k).cast(t).alias(k) for k, t in self.key.items()), tokens(text).alias("terms"))
        length = F.coalesce(F.size("terms"), F.lit(0))
        # lengths double from class to class
        block = F.least(F.floor(F.log2(length + F.lit(1.0))), F.lit(CLASSES - 1)) * SPREAD + F.pmod(F.xxhash64(*self.key), F.lit(SPREAD))
        own = own.withColumns({"length": F.greatest(length, F.lit(0)), "block": block.cast("int")})
        return own.select(*self.key, "length", "block", F.explode_outer("terms").alias("term")).groupBy(*self.key, "length", "block", "term").agg(F.count("term").cast("int").alias("tf"))

    def _write(self, number: int, name: str, rows: DataFrame, by_term: bool) -> None:
        path = f"{self.path}/{name}/seg={number}"
        if by_term:
            rows = rows.withColumn("bucket", self._bucket(F.col("term")))
            # ranges, so a term that all rows have is more than one file
            rows.repartitionByRange("bucket", "term", "block").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(path)
        else:
            rows.write.parquet(path)

    @staticmethod
    def _summed(postings: DataFrame, sign: int) -> DataFrame:
        return postings.groupBy("term", "block").agg((sign * F.count("*")).alias("n"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"))

    def _segment(self, new: DataFrame, old: DataFrame | None, text: Column, base: bool, note: str) -> int:
        number = self._begin()
        posted = written(self._posted(new, text))
        gone = written(self._posted(old, text)) if old is not None else None
        per_row = lambda p: p.groupBy(*self.key).agg(F.first("length").alias("length"))
        totals = per_row(posted).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words"))
        blocks = self._summed(posted.where("term IS NOT NULL"), 1)
        if gone is not None:
            totals = totals.union(per_row(gone).agg((-F.count("*")).alias("n"), (-F.coalesce(F.sum("length"), F.lit(0))).alias("words")))
            blocks = blocks.union(self._summed(gone.where("term IS NOT NULL"), -1))
            self._write(number, "tombstones", gone.select(*self.key).distinct(), False)
        self._write(number, "postings", posted.where("term IS NOT NULL").select("term", "block", *self.key, "tf", "length"), True)
        self._write(number, "blocks", blocks, True)
        self._write(number, "totals", totals, False)
        self._mark(number, base, note)
        return number

    def build(self, rows: DataFrame, text: Column, note: str = "") -> int:
        """Index ``rows`` anew; also what joins segments that have become many."""
        return self._segment(rows, None, text, True, note)

    def update(self, new: DataFrame, old: DataFrame, text: Column, note: str = "") -> int:
        """Index ``new`` rows and take ``old`` ones off: the earlier versions of rows that are replaced, and rows that are deleted, as they were indexed."""
        return self._segment(new, old, text, False, note)

    # -- reading -----------------------------------------------------------
    def _terms(self, query: str) -> tuple[list[str], list[int]]:
        """The query's terms and their folders."""
        terms = query_terms(query)
        rows = self.spark.createDataFrame([(t,) for t in terms], "term string").select(self._bucket(F.col("term")).alias("b")).collect() if terms else []
        return terms, sorted({r.b for r in rows})

    def _impact(self, idf: float, tf: Column | int, length: Column | int, mean: float):
        return F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))

    def scored(self, terms: list[str], buckets: list[int], idf: dict[str, float], mean: float, blocks: list[int] | None = None) -> DataFrame:
        """(key, score) of the rows of some blocks that have any of the terms."""
        rows = self.postings().where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        if blocks is not None:
            rows = rows.where(F.col("block").isin(blocks))
        dead = self.tombstones().select(*(F.col(k).alias(f"dead_{k}") for k in self.key), F.col("seg").alias("dead_seg"))
        same = F.col("seg") < F.col("dead_seg")
        for k in self.key:
            same = same & F.col(k).eqNullSafe(F.col(f"dead_{k}"))
        rows = rows.join(dead, same, "left_anti")
        one = [F.coalesce(F.max(F.when(F.col("term") == t, self._impact(idf[t], F.col("tf"), F.col("length"), mean))), F.lit(0.0)) for t in terms]
        score = one[0]
        for x in one[1:]:  # in order of the terms, so that sums are the same everywhere
            score = score + x
        return rows.groupBy(*self.key).agg(score.alias("score"))

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """The best ``limit`` (key, score), by score rounded to six digits, then key."""
        nothing = self.spark.createDataFrame([], f"{self._keys()}, score double")
        terms, buckets = self._terms(query)
        n, words = self.totals()
        if not terms or n <= 0 or limit <= 0:
            return nothing
        # at most SPREAD * CLASSES rows a term
        seen = self.blocks().where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).groupBy("term", "block").agg(F.sum("n").alias("n"), F.max("max_tf").alias("tf"), F.min("min_length").alias("length")).where("n > 0").collect()
        df = {t: sum(r.n for r in seen if r.term == t) for t in terms}
        mean = words / n
        # one row: the logarithm is Spark's own, as its last bit may differ from Python's
        logs = self.spark.range(1).select(*(F.log(F.lit(1) + (F.lit(n) - F.lit(df[t]) + 0.5) / (F.lit(df[t]) + 0.5)).alias(f"x{k}") for k, t in enumerate(terms))).first()
        idf = dict(zip(terms, logs))
        bounds: dict[int, Block] = {}
        for r in seen:
            b = bounds.setdefault(r.block, Block(0.0, 0))
            b.bound += max(0.0, idf[r.term]) * r.tf * (K1 + 1) / (r.tf + K1 * (1 - B + B * r.length / mean))
            b.rows = max(b.rows, r.n)  # that many rows at least
        order = sorted(bounds, key=lambda k: -bounds[k].bound)
        best, taken = lambda df: df.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), *self.key).limit(limit), 0
        first = []
        for k in order:
            first.append(k)
            taken += bounds[k].rows
            if taken >= 2 * limit:
                break
        if len(first) == len(order):
            return best(self.scored(terms, buckets, idf, mean))
        scores = [r.score for r in best(self.scored(terms, buckets, idf, mean, first)).collect()]
        if len(scores) < limit:
            return best(self.scored(terms, buckets, idf, mean))
        return best(self.scored(terms, buckets, idf, mean, [k for k in order if bounds[k].bound >= min(scores) - 1e-5]))


def search_chunks(index: SearchIndex, chunks: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The best chunks with their texts: only the keys that were found are looked up."""
    best = checkpointed(index.search(query, limit)).select(*(F.col(k).alias(f"found_{k}") for k in index.key), "score")
    same = None
    for k in index.key:
        one = F.col(k).eqNullSafe(F.col(f"found_{k}"))
        same = one if same is None else same & one
    return chunks.join(F.broadcast(best), same).drop(*(f"found_{k}" for k in index.key)).orderBy(F.desc("score"), *index.key)  # ``limit`` rows
