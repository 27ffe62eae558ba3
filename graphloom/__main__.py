"""Command line: index, communities, audit and query over a table store.

    python -m graphloom index --store DIR --documents FILE --lexicon '{"agent": "agent"}'
    python -m graphloom index --store DIR --books FILE_OR_PDFS --lexicon '{"agent": "agent"}'
    python -m graphloom communities --store DIR [--fresh]
    python -m graphloom query --store DIR --type entity --params '{"name": "x"}'
    python -m graphloom audit --store DIR | --tables SF_DIR

Settings come from the environment (GRAPHLOOM_CHUNK_SIZE and so on).
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession, functions as F


def _session() -> SparkSession:
    return SparkSession.builder.appName("graphloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def build_query(kind: str, params: dict):
    from .plans import service as V

    made = {
        "entity": lambda p: V.EntityQuery(p["name"], p.get("type"), p.get("limit", 100)), "relation": lambda p: V.RelationQuery(p["start"], p.get("depth", 1), p.get("type")),
        "path": lambda p: V.PathQuery(p["start"], p["end"], p.get("max_depth", 3)), "batch_entity": lambda p: V.BatchEntityQuery(tuple(p["ids"])),
    }
    return made[kind](params)


def main(argv: list[str] | None = None) -> int:
    """0: done; 2: bad arguments or settings; 3: the query failed; 4: over the budget; audits end by their state."""
    parser = argparse.ArgumentParser(prog="graphloom")
    todo = parser.add_subparsers(dest="command", required=True)
    q = todo.add_parser("query")
    q.add_argument("--store", required=True)
    q.add_argument("--type", required=True, choices=["entity", "relation", "path", "batch_entity"])
    q.add_argument("--params", default="{}")
    i = todo.add_parser("index")
    for name in ("store", "lexicon"):
        i.add_argument(f"--{name}", required=True)
    what = i.add_mutually_exclusive_group(required=True)
    what.add_argument("--documents", help="Parquet with doc_id, source and text")
    what.add_argument("--books", help="Parquet with book_id, title, author, page_count, toc and pages, or PDF files")
    c = todo.add_parser("communities")
    c.add_argument("--store", required=True)
    c.add_argument("--fresh", action="store_true")
    a = todo.add_parser("audit")
    what = a.add_mutually_exclusive_group(required=True)
    what.add_argument("--store")
    what.add_argument("--tables", help="test tables, with planted violations")
    a.add_argument("--samples", type=int, default=20)
    args = parser.parse_args(argv)
    from .schema import Settings, safe_store

    try:
        settings = Settings.from_environment(dict(os.environ))
        if getattr(args, "store", None):
            safe_store(args.store)
    except ValueError as e:
        print(f"bad settings: {e}", file=sys.stderr)
        return 2

    if args.command == "query":
        from .operators.store import TableStore
        from .plans.service import GraphService, Tables
        from .streaming import query_log

        try:
            query = build_query(args.type, json.loads(args.params))
        except (ValueError, KeyError, TypeError) as e:
            print(f"bad parameters: {e}", file=sys.stderr)
            return 2
        try:
            store = TableStore(_session(), args.store)
            log = query_log.to_folder(store.spark, f"{args.store}/_query_log", settings.log_retention_days)
            out = GraphService(Tables.of_store(store), log, settings=settings).execute(query)
        except Exception as e:  # noqa: BLE001  told to the caller by the exit code
            print(f"{type(e).__name__}: {e}", file=sys.stderr)
            return 3
        print(json.dumps({"rows": {k: [r.asDict(True) for r in v] for k, v in out.rows.items()}, "total": out.total, "query_ms": out.query_ms, "depth": out.depth}, default=str))
        return 0
    if args.command == "index":
        from .operators import extract
        from .operators.store import TableStore
        from .sources.tables import numbered, split_text

        spark = _session()
        store, extractor, letters = TableStore(spark, args.store), extract.lexicon_extractor(json.loads(args.lexicon)), (f"{args.store}/_dead_letters", f"{args.store}/_orphans")
        if args.books:
            from .sources import books

            rows = books.read_pdfs(spark, args.books) if args.books.lower().endswith(".pdf") else spark.read.parquet(args.books)
            print(json.dumps(books.index_books(store, rows, extractor, *letters, settings=settings)))
            return 0
        docs = spark.read.parquet(args.documents)
        parts = docs.select("doc_id", F.col("source").alias("book_id"), F.posexplode(split_text(F.col("text"), settings.chunk_size, settings.chunk_overlap)).alias("part", "text"))
        chunks = numbered(parts).select("chunk_index", "book_id", "text", F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"))
        print(json.dumps(extract.index_chunks(store, chunks, extractor, *letters, settings=settings)))
        return 0
    if args.command == "communities":
        from .operators import community
        from .operators.store import TableStore
        from .schema import CommunityDetectionError

        try:
            print(json.dumps(community.run(TableStore(_session(), args.store), first_lines, settings, args.fresh)))
        except CommunityDetectionError as e:
            print(str(e), file=sys.stderr)
            return 4
        return 0
    from .functions.scalar import canonical_json, redact
    from .operators import audit
    from .operators.store import TableStore
    from .plans import graph

    spark = _session()
    g = graph.of_store(TableStore(spark, args.store)) if args.store else graph.commerce(spark, args.tables)
    rows = [r.asDict() for r in audit.report(g, args.samples).collect()]
    state = audit.overall(rows)
    for r in rows:  # what leaves the engine holds no secrets
        r["samples"] = [x["key"] for x in (redact({"key": k}) for k in r.pop("keys") if k) if "key" in x]
    runtime = {"engine": "spark", "version": spark.version, "nodes": {r.label: r.total for r in audit.node_inventory(g).collect()}, "edges": {r.rel_type: r.total for r in audit.edge_inventory(g).collect()}}
    print(canonical_json({"state": state, "findings": sorted(rows, key=lambda r: r["rule_id"]), "runtime": runtime}))
    return audit.EXIT_CODES[state]


def first_lines(text: str, lines: int = 5) -> str:
    """The summary where no model is given: a text's first lines."""
    return "\n".join(text.split("\n")[:lines])


if __name__ == "__main__":
    sys.exit(main())
