"""Question ranking, retrieval metrics and deltas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import TOP_SUMMARIES
from .community import rank_summaries
from .search import query_terms, tokens

NO_SUMMARIES = "No community summaries at this level."


def overlap_score(text: Column, question: str) -> Column:
    """0 to 100: part of the question's distinct words that a text has (the default scorer)."""
    asked = F.array_distinct(tokens(F.lit(question)))
    return F.round(F.try_divide(F.lit(100.0) * F.size(F.array_intersect(asked, tokens(text))), F.size(asked)), 4)


def ask_global(summaries: DataFrame, question: str, level: int = 1, limit: int = TOP_SUMMARIES, compose: Callable[[str, list[str]], str] | None = None) -> dict:
    """Map: every summary of a level is scored; reduce: the best ``limit`` are composed and cited."""
    if level not in (0, 1, 2, 3):
        raise ValueError("level must be 0 to 3")
    own = summaries.where(F.col("level") == level).withColumn("ordinal", F.col("id"))
    best = rank_summaries(own, overlap_score(F.col("summary"), question), limit).collect()
    if not best:
        return {"answer": NO_SUMMARIES, "citations": []}
    answer = (compose or (lambda q, parts: "\n".join(parts)))(question, [r.summary for r in best])
    return {"answer": answer, "citations": [r.id for r in best]}


def citations(ids: DataFrame, summaries: DataFrame) -> DataFrame:
    """(pos, id, summary) of cited ids (pos, id) in order; those without a summary are dropped."""
    return ids.join(summaries.select("id", "summary"), "id").select("pos", "id", "summary").orderBy("pos")


def retrieval_metrics(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """(question, precision, recall, f1) from (question, item) on both sides."""
    hits = retrieved.join(relevant, ["question", "item"], "left_semi").groupBy("question").agg(F.count("*").alias("hit"))
    r = relevant.groupBy("question").agg(F.count("*").alias("relevant"))
    g = retrieved.groupBy("question").agg(F.count("*").alias("retrieved"))
    all_ = r.join(g, "question", "full").join(hits, "question", "left").fillna(0)
    p, q = F.coalesce(F.try_divide("hit", "retrieved"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "relevant"), F.lit(0.0))
    return all_.select("question", p.alias("precision"), q.alias("recall"), F.coalesce(F.try_divide(2 * p * q, p + q), F.lit(0.0)).alias("f1"))


def metric_deltas(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, value, baseline, delta): rounded to 4 places, null where either is missing."""
    b = baseline.select("metric", F.col("value").alias("baseline"))
    return current.join(b, "metric", "left").select("metric", "value", "baseline", F.round(F.col("value") - F.col("baseline"), 4).alias("delta"))


def kept_indices(indices: list[int], size: int) -> list[int]:
    """Indices that a model returned: in bounds, each once, in order."""
    return sorted({i for i in indices if 0 <= i < size})


def distinct_questions(questions: list[str], keep: Callable[[list[str]], list[int]] | None = None, similarity: float = 0.8) -> list[str]:
    """A data set's questions (some hundreds) without repeats: those whose places ``keep`` returns, by default those that share less than ``similarity`` of their words with each one kept before."""
    if keep is not None:
        return [questions[k] for k in kept_indices(keep(questions), len(questions))]
    kept: list[tuple[set[str], str]] = []
    for q in questions:
        words = set(query_terms(q))
        if all(len(words & w) < similarity * len(words | w) for w, _ in kept if words | w):
            kept.append((words, q))
    return [q for _, q in kept]


def generated_questions(chunks: DataFrame, generate: Callable[[str], list[dict]]) -> DataFrame:
    """(chunk_index, pos, question, answer) that a pluggable model makes of each chunk; a chunk that fails gives none."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for index, text in zip(pdf["chunk_index"], pdf["text"]):
                try:
                    made = generate(text or "")
                except Exception:  # noqa: BLE001  one bad chunk stops nothing
                    made = []
                rows += [(index, k, x.get("question"), x.get("answer")) for k, x in enumerate(made)]
            yield pd.DataFrame(rows, columns=["chunk_index", "pos", "question", "answer"])

    return chunks.select("chunk_index", "text").mapInPandas(run, "chunk_index long, pos int, question string, answer string").where(F.trim("question") != "")


def write_evaluation(results: DataFrame, current: DataFrame, baseline: DataFrame | None, folder: str) -> None:
    """``results`` as JSON lines and, of (metric, value) rows, one JSON line a metric with its baseline and delta."""
    if baseline is None:
        baseline = current.limit(0)
    results.write.mode("overwrite").json(f"{folder}/results")
    metric_deltas(current, baseline).coalesce(1).sortWithinPartitions("metric").write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/metrics")
