"""Editorially structured books: tables of contents to chunks.

A book is one row: book_id, page_count, toc (array of level, title, page) and
pages (array of texts, one a page).  Books are independent, so each is cut in
one call of an Arrow batch function; a corpus of books needs no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from ..schema import CHUNK_OVERLAP, CHUNK_SIZE

#: Words that mark front matter in the title of a first-level entry.
FRONT_MATTER = (
    "foreword", "preface", "contributors", "about", "table of contents", "cover", "join our", "share your", "free benefits", "get in touch", "how to unlock", "conventions",
    "download the example code files", "download the color images", "who this book is for", "what this book covers", "to get the most out of this book", "proven design patterns and practices",
)
#: Titles of numbered chapters: a number, a number with a dot and a title, a number and a word.
CHAPTERS = (r"^\s*(\d+)\s*$", r"^\s*(\d+)\.\s+(.+)$", r"^\s*(\d+)\s+(\w.*)$")
_BARE = re.compile(CHAPTERS[0])
SCHEMA = "book_id string, chunk_index int, chapter_number int, chapter_title string, section string, level int, section_ancestors string, page_start int, page_end int, path array<string>, text string"


@dataclass
class Entry:
    level: int
    title: str
    page: int
    parent: int = -1
    end: int = 0
    leaf: bool = True


def merge_split_titles(toc: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """First-level entries ``1`` and ``Title`` on one page are ``1 Title``."""
    out, skip = [], False
    for k, (level, title, page) in enumerate(toc):
        if skip:
            skip = False
            continue
        after = toc[k + 1] if k + 1 < len(toc) else None
        if level == 1 and _BARE.match(title) and after and after[0] == 1 and after[2] == page and not _BARE.match(after[1]):
            title, skip = f"{title.strip()} {after[1].strip()}", True
        out.append((level, title, page))
    return out


def tree(toc: list[tuple[int, str, int]], page_count: int) -> list[Entry]:
    """Entries with parents (nearest before with a smaller level) and last pages (next sibling's first less one, else the parent's)."""
    entries, open_ = [Entry(*t) for t in toc], []
    siblings: dict[int, int] = {}
    following = [-1] * len(entries)
    for k, e in enumerate(entries):
        while open_ and entries[open_[-1]].level >= e.level:
            open_.pop()
        e.parent = open_[-1] if open_ else -1
        if e.parent >= 0:
            entries[e.parent].leaf = False
        if e.parent in siblings:
            following[siblings[e.parent]] = k
        siblings[e.parent] = k
        open_.append(k)
    for k, e in enumerate(entries):
        e.end = entries[following[k]].page - 1 if following[k] >= 0 else entries[e.parent].end if e.parent >= 0 else page_count
    return entries


def parse_chapter(title: str) -> tuple[int | None, str]:
    """Number and title without it; the number is None where no pattern fits."""
    for m in filter(None, (re.match(p, title) for p in CHAPTERS)):
        return int(m[1]), (m[2] if m.re.groups > 1 else title).strip()
    return None, title


def slices(text: str, size: int, overlap: int) -> list[str]:
    if size <= overlap:
        raise ValueError("overlap must be below the size")
    return [text[k : k + size] for k in range(0, len(text), size - overlap)]


def cut_book(book_id: str, page_count: int, toc: list[tuple[int, str, int]], pages: list[str], size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, keep_empty: bool = False) -> list[tuple]:
    """Rows of SCHEMA: a leaf's pages, sliced if they are long. Without a table of contents, all pages.

    ``section_ancestors`` is for readers; ``path`` has the titles of a chunk's sections apart, whatever characters they hold.
    """
    rows: list[tuple] = []

    def add(chapter, sections, first, last, text):
        titles = [x.title for x in sections]
        own = (titles[-1], sections[-1].level) if sections else (None, None)
        for part in slices(text, size, overlap) if len(text) > size else [text] if text or keep_empty else []:
            rows.append((book_id, len(rows), *chapter, *own, ">".join(titles[:-1]) or None, first, last, titles, part))

    if not toc:
        for part in slices("\n".join(pages), size, overlap):
            rows.append((book_id, len(rows), None, None, None, None, None, 1, page_count, [], part))
        return rows
    toc = merge_split_titles(toc)
    entries = tree(toc, page_count)
    # numbered first-level chapters, up to the first that goes back: found by page
    numbered = [e for e in entries if e.level == 1 and parse_chapter(e.title)[0] is not None]
    starts = [e.page for e in numbered]
    rising = next((k for k in range(1, len(starts)) if starts[k] < starts[k - 1]), None)
    for e in (x for x in entries if x.leaf):
        line, at = [e], e
        while at.parent >= 0:
            at = entries[at.parent]
            line.append(at)
        if any(w in line[-1].title.lower() for w in FRONT_MATTER):
            continue
        chapter = next((parse_chapter(x.title) for x in line if parse_chapter(x.title)[0] is not None), None)
        if chapter is None:
            if rising is None:
                k = bisect_right(starts, e.page) - 1
            else:
                k = next((j for j, p in enumerate(starts) if p > e.page), len(starts)) - 1
            if k < 0:
                continue
            chapter = parse_chapter(numbered[k].title)
        sections = [x for x in reversed(line) if x.level > 1]
        text = "\n".join(pages[max(0, e.page - 1) : max(0, e.end)])
        add(chapter, sections, e.page, e.end, text)
    return rows


def cut_books(books: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of all books."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for b in pdf.itertuples():
                toc = [(t["level"], t["title"], t["page"]) for t in (b.toc if b.toc is not None else [])]
                rows = cut_book(b.book_id, b.page_count, toc, list(b.pages), size, overlap)
                yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("chunk_index", "chapter_number", "level", "page_start", "page_end")})

    return books.select("book_id", "page_count", "toc", "pages").mapInPandas(run, SCHEMA)


def read_pdfs(spark, path: str) -> DataFrame:
    """Books from PDF files by way of PyMuPDF, which is optional."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("reading PDF files needs PyMuPDF") from e

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for f in pdf.itertuples():
                doc = fitz.open(stream=bytes(f.content), filetype="pdf")
                title = (doc.metadata.get("title") or "").strip() or f.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                yield pd.DataFrame([{"book_id": re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-"), "title": title, "author": doc.metadata.get("author") or "", "page_count": doc.page_count, "toc": [{"level": a, "title": b, "page": c} for a, b, c in doc.get_toc()], "pages": [p.get_text() for p in doc]}])

    return spark.read.format("binaryFile").load(path).mapInPandas(run, "book_id string, title string, author string, page_count int, toc array<struct<level:int,title:string,page:int>>, pages array<string>")


def editorial(chunks: DataFrame) -> dict[str, DataFrame]:
    """Chapter, section, chunk and hierarchy tables of cut books; a chunk hangs below its section, else its chapter, else nothing."""
    from pyspark.sql import functions as F

    from ..functions.scalar import joined_key
    from ..operators.audit import chunk_key

    own = chunks.where("chapter_number IS NOT NULL")
    chapter = own.groupBy("book_id", F.col("chapter_number").alias("number"), F.col("chapter_title").alias("title")).agg(F.min("page_start").alias("page_start"))
    line = own.where("section IS NOT NULL").select("book_id", "chapter_number", "chapter_title", "page_start", "level", "path", F.posexplode("path").alias("pos", "title"))
    line = line.withColumn("parent_section_title", F.when(F.col("pos") > 0, F.expr("path[pos - 1]"))).withColumn("level", F.col("level") - F.size("path") + F.col("pos") + 1)
    section = line.groupBy("book_id", "chapter_number", "title").agg(F.min("level").alias("level"), F.min("page_start").alias("page_start"), F.min_by("parent_section_title", "page_start").alias("parent_section_title"))

    key = joined_key
    edge = lambda df, kind, a, src, b, dst: df.select(F.lit(kind).alias("type"), F.lit(a).alias("src_label"), src.alias("src"), F.lit(b).alias("dst_label"), dst.alias("dst"))
    of_chapter, of_section, of_chunk = key("book_id", "chapter_number", "chapter_title"), key("book_id", "chapter_number", "title"), chunk_key()
    edges = [
        edge(chapter, "CONTAINS", "Book", F.col("book_id"), "Chapter", key("book_id", "number", "title")),
        edge(line.where("parent_section_title IS NULL"), "HAS_SECTION", "Chapter", of_chapter, "Section", of_section),
        edge(line.where("parent_section_title IS NOT NULL"), "HAS_SUBSECTION", "Section", key("book_id", "chapter_number", "parent_section_title"), "Section", of_section),
        edge(own.where("section IS NOT NULL"), "HAS_CHUNK", "Section", key("book_id", "chapter_number", "section"), "Chunk", of_chunk),
        edge(own.where("section IS NULL"), "HAS_CHUNK", "Chapter", of_chapter, "Chunk", of_chunk),
    ]
    hierarchy = edges[0]
    for e in edges[1:]:
        hierarchy = hierarchy.unionByName(e)
    return {"chapter": chapter, "section": section, "hierarchy": hierarchy.distinct(), "chunk": chunks.select(F.col("chunk_index").cast("long").alias("chunk_index"), "book_id", "text", "page_start", "page_end")}


def index_books(store, books: DataFrame, extractor, dead_letters: str, orphan_letters: str, settings=None) -> dict[str, int]:
    """Cut books (book_id, title, author, page_count, toc, pages) and write books, chapters, sections, chunks, their hierarchy and what is extracted."""
    from pyspark.sql import functions as F

    from ..operators.extract import index_chunks
    from ..operators.traverse import checkpointed
    from ..schema import Settings

    settings = settings or Settings()
    cut = checkpointed(cut_books(books, settings.chunk_size, settings.chunk_overlap))
    tables = editorial(cut)
    store.upsert("book", books.select(F.col("book_id").alias("id"), "title", "author", F.lit(None).cast("string").alias("pdf_path"), F.col("page_count").cast("int").alias("page_count")))
    for name in ("chapter", "section", "hierarchy"):
        store.upsert(name, tables[name])
    return {"books": books.count()} | index_chunks(store, tables["chunk"], extractor, dead_letters, orphan_letters, settings=settings)
