"""Main text of web pages by wrapper induction.

Each host has a model page (least hash of its id among those with markup).
Every page's tree of block elements is aligned with its host's model by simple
tree matching: two nodes match if their tags do, and their children are
matched in order for the largest number of matching nodes.  Among the host's
different pages whose blocks match one slot of the model, a text that at least
``LEAST_PAGES`` of them and a share of ``TEMPLATE_SHARE`` have is constant: it
belongs to the template, on every page of the host that has it there.  Slots
whose text varies hold content, and so does what deviates in a constant slot.

Boilerplate may vary too (each page its own menu), so elements that say what
they are (menus, headers, footers, sidebars, adverts, notices, forms,
comments, by tag, role, class or id) are left out, and if the page marks its
article or main part, what lies outside that.  Inside such a mark a text must
be constant on more pages (``MARKED_PAGES``, ``MARKED_SHARE``) to be template.
On pages without such a mark, blocks that are mostly links are left out.

Every page takes part in the induction; copies of a page count once.  Counts
are combined before the shuffle, so a host with a third of all pages costs one
row per task and text of a slot; models join their pages by host, broadcast
only if their measured size is below ``BROADCAST_BYTES``, else by a join that
is split where a host is large.

Nulls and edge cases: a null or empty html gives the empty text; pages without
a url share one host; broken markup is closed as browsers do for blocks;
repeated rows are extracted alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialize

#: Different pages that must agree, and their share among those with the slot, before a text is template; and inside a marked article.
LEAST_PAGES, TEMPLATE_SHARE = 3, 0.5
MARKED_PAGES, MARKED_SHARE = 20, 0.9
#: Cells of an alignment that are kept at once, and sizes of matched shapes that a worker remembers; they change no result.
CELLS, SIZES_KEPT = 1 << 22, 200_000
BROADCAST_BYTES = 8 << 20
#: Part of a block's characters in links from which it is a menu, where no article is marked.
LINKS = 0.6

#: Fixed values of HTML: elements whose content is not markup, that have none, that stay inside a line, and that end an open one of their kind.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var img br wbr ruby rt rp nobr picture source".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
BARRIER = frozenset("article aside body div footer form header html main nav section table ul ol dl td th fieldset".split())
#: Elements and words in class, id or role that are no article text.
DROP_TAGS = frozenset("head nav footer aside form script style noscript template button select option textarea iframe object svg canvas dialog menu input title audio video map math".split())
DROP_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer foot sidebar aside ad ads adv advert adverts advertisement advertisements advertising adsense banner promo promotion sponsor sponsored "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist disqus reply replies respond discussion search pagination pager widget widgets toolbar skip hidden copyright colophon disclaimer contentinfo complementary masthead topbar teaser".split()
)
HEADER_WORDS = frozenset("header head".split())

#: A tag without angle brackets inside; what it does not match takes ``_Tags.broken``.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
_PAST_NAME, _MARK, _BRACKET, _LETTER = re.compile(r"[\s/>]"), re.compile("[>\"']"), re.compile("[<>]"), re.compile("/?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Node:
    """An element, or a text block (tag ``#``: text, link characters)."""

    __slots__ = ("tag", "children", "text", "links", "drop", "root", "inside", "shape", "slot", "count")

    def __init__(self, tag: str, drop: bool = False, root: bool = False):
        self.tag, self.drop, self.root, self.inside, self.children, self.text, self.links, self.shape, self.slot, self.count = tag, drop, root, root, [], "", 0, "", -1, 1


def _marks(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element is no article text, marks the article, or is a header.

    In a marked article ids name its sections, and only whole class names and roles tell.
    """
    inside |= tag in ("article", "main")
    drop, root, header = tag in DROP_TAGS, tag in ("article", "main"), tag in ("header", "hgroup")
    if attributes and "=" in attributes or "hidden" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "style":
                drop |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                drop = True
            elif name in ("class", "id", "role"):
                words = {w.lower() for w in _NAME.findall(value)} if not inside else set(value.lower().split()) if name != "id" else set()
                drop |= bool(words & DROP_WORDS)
                header |= bool(words & HEADER_WORDS)
                root |= name == "role" and value.lower() in ("main", "article")
    return drop, root and not drop, header


class _Tags:
    """Tags of a source one after another, in time that grows with its length however broken it is.

    What was looked for in vain, and where the next mark of a kind is, is kept:
    later places in the source ask for it again.
    """

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.quotes = {c: source.rfind(c) for c in "\"'"}
        self.vain: set[int] = set()  # quotes from which no tag ends
        self.ahead: dict[re.Pattern, tuple[int, int]] = {}

    def find(self, pattern: re.Pattern, at: int) -> int:
        """Place of the next match of a pattern of one character, or the end."""
        low, high = self.ahead.get(pattern, (0, -1))
        if not low <= at <= high:
            m = pattern.search(self.source, at)
            high = m.start() if m else len(self.source)
            self.ahead[pattern] = (at, high)
        return high

    def end_of_tag(self, at: int) -> int:
        """Place of the ``>`` that lies in no quotes, or -1; ``at`` lies in none."""
        seen, at = [], self.find(_MARK, at)
        while at < len(self.source) and self.source[at] != ">":
            quote = self.source[at]
            if at in self.vain or at >= self.quotes[quote]:
                seen.append(at)
                break
            seen.append(at)
            m = _MARK.search(self.source, self.source.index(quote, at + 1) + 1)
            at = m.start() if m else len(self.source)
        else:
            if at < len(self.source):
                return at
        self.vain.update(seen)
        return -1

    def next(self, at: int) -> tuple[int, int, bool, str, str]:
        """(start, end, whether it is an end tag, name, attributes) of the next tag or comment (no name); at the end of the source there is none."""
        source, n = self.source, len(self.source)
        while (at := source.find("<", at)) >= 0:
            if m := _TAG.match(source, at):
                return at, m.end(), bool(m[1]), m[2], m[3]
            if got := self.broken(at):
                return at, *got
            at += 1
        return n, n, False, "", ""

    def broken(self, at: int) -> tuple[int, bool, str, str] | None:
        source, n = self.source, len(self.source)
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            return (n if end < 0 else end + 3), False, "", ""
        if source.startswith(("<!", "<?"), at):
            return (source.index(">", at) + 1, False, "", "") if at < self.last else None
        if not _LETTER.match(source, at + 1):
            return None
        ending = source[at + 1] == "/"
        name = at + 1 + ending
        past = self.find(_PAST_NAME, name)
        if at < self.last and (end := self.end_of_tag(past)) >= 0:
            return end + 1, ending, source[name:past], source[past:end]
        # never closed, or by a bracket inside quotes: up to the next one
        end = self.find(_BRACKET, past)
        if end < n and source[end] == "<":
            return None
        return min(end + 1, n), ending, source[name:past], ""


def parse(source: str) -> Node:
    """Tree of block elements and text blocks."""
    top = Node("#root")
    stack: list[Node] = [top]
    opened: Counter[str] = Counter()  # tags in the stack
    words: list[str] = []
    links = 0
    in_link = 0
    ignored = ""  # an inline element without article text, until its end

    def flush() -> None:
        nonlocal words, links
        if words:
            text = " ".join(_html.unescape("".join(words)).split())
            if text:
                block = Node("#")
                block.text, block.links = text, links
                stack[-1].children.append(block)
            words, links = [], 0

    def cut(k: int) -> None:
        opened.subtract(x.tag for x in stack[k:])
        del stack[k:]

    def close(tag: str, barrier: bool = True) -> None:
        nonlocal in_link
        if not opened[tag]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                flush()
                cut(k)
                in_link = 0
                return
            if barrier and stack[k].tag in BARRIER and stack[k].tag != tag:
                return

    at, n, tags = 0, len(source), _Tags(source)
    while at < n:
        end, after, ending, tag, attributes = tags.next(at)
        if end > at and not ignored:
            words.append(source[at:end])
            if in_link:
                links += end - at
        at = after
        if not tag:
            continue
        tag = tag.lower()
        if ending:
            if tag == ignored:
                ignored = ""
            elif tag == "a":
                in_link = 0
            elif tag == "p" and not opened["p"]:
                flush()
            elif tag not in INLINE:
                close(tag, tag not in BARRIER)
            continue
        if tag in RAW:
            # found in ``source`` itself: in lower case other characters may be longer
            stop = re.compile(f"</{tag}", re.ASCII | re.IGNORECASE).search(source, at)
            at = stop.start() if stop else n
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 1
            if not ignored and tag not in VOID and attributes and _marks(tag, attributes, stack[-1].inside)[0]:
                ignored = tag
            continue
        ignored = ""
        flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    cut(k)
                    break
                if stack[k].tag in BARRIER:
                    break
        for own in (x for x in ENDS_OWN.get(tag, ()) if opened[x]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == own:
                    cut(k)
                    break
                if stack[k].tag in BARRIER and stack[k].tag not in ("td", "th"):
                    break
        inside = stack[-1].inside
        drop, root, header = _marks(tag, attributes, inside)
        if header and not drop:
            # an article's own header has its title; a page's has none of its text
            drop = not inside
        node = Node(tag, drop, root)
        node.inside |= inside
        if not attributes.rstrip().endswith("/") or tag in BARRIER:
            stack[-1].children.append(node)
            stack.append(node)
            opened[tag] += 1
    flush()
    _shape(top)
    return top


def _shape(top: Node) -> None:
    """Give every node a text that is equal for equal trees of tags, and its number of nodes (without recursion: markup can be deep)."""
    order, todo = [], [top]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(x.children)
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 4 * len(order)))  # for the alignment, which is as deep as the tree
    for x in reversed(order):
        x.count = 1 + sum(c.count for c in x.children)
        x.shape = x.tag if not x.children else xxhash.xxh64_hexdigest(x.tag + "(" + ",".join(c.shape for c in x.children))


def number_slots(model: Node) -> None:
    """Number the model's text blocks in page order."""
    todo, k = [model], 0
    while todo:
        x = todo.pop()
        if x.tag == "#":
            x.slot, k = k, k + 1
        todo.extend(reversed(x.children))


_SIZES: dict[tuple[str, str], int] = {}


def _size(a: Node, b: Node) -> int:
    """Matching nodes of two trees; it depends on their shapes alone."""
    if a.tag != b.tag:
        return 0
    if a.shape == b.shape:
        return a.count
    if not a.children or not b.children:
        return 1
    key = (a.shape, b.shape)
    got = _SIZES.get(key)
    if got is None:
        x, y, first, last = _middle(a.children, b.children)
        got = 1
        for c in (*a.children[:first], *a.children[len(a.children) - last :]):
            got += c.count
        if x and y:
            got += int(_scores(*_weights(x, y))[-1])
        if len(_SIZES) > SIZES_KEPT:
            _SIZES.clear()
        _SIZES[key] = got
    return got


def _middle(x: list[Node], y: list[Node]) -> tuple[list[Node], list[Node], int, int]:
    """What is left between ends of equal shapes, and the ends' lengths: equal ends match each other in some best alignment."""
    first, least = 0, min(len(x), len(y))
    while first < least and x[first].shape == y[first].shape:
        first += 1
    last = 0
    while last < least - first and x[-1 - last].shape == y[-1 - last].shape:
        last += 1
    return x[first : len(x) - last], y[first : len(y) - last], first, last


def _weights(x: list[Node], y: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matching nodes by kind of shape, and the kinds of both lists."""
    kinds = []
    for of in (x, y):
        known: dict[str, tuple[int, Node]] = {}
        kinds.append(([known.setdefault(c.shape, (len(known), c))[0] for c in of], [c for _, c in known.values()]))
    weight = np.zeros((len(kinds[0][1]), len(kinds[1][1])), dtype=np.int64)
    for i, c in enumerate(kinds[0][1]):
        for j, d in enumerate(kinds[1][1]):
            if c.tag == d.tag:
                weight[i, j] = _size(c, d)
    return weight, np.array(kinds[0][0]), np.array(kinds[1][0])


def _scores(weight: np.ndarray, x: np.ndarray, y: np.ndarray, rows: list | None = None) -> np.ndarray:
    """Best scores of x against the beginnings of y; ``rows`` gets those of each beginning of x."""
    row = np.zeros(len(y) + 1, dtype=np.int64)
    for i in x.tolist():
        if rows is not None:
            rows.append(row)
        after = np.zeros_like(row)
        np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weight[i, y]), out=after[1:])
        row = after
    return row


def _matches(weight: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places of a best alignment: halves of x are aligned apart where the whole table would be large."""
    found, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if b - a > 1 and (b - a) * (d - c) > CELLS:
            half = (a + b) // 2
            at = c + int((_scores(weight, x[a:half], y[c:d]) + _scores(weight, x[half:b][::-1], y[c:d][::-1])[::-1]).argmax())
            todo += [(a, half, c, at), (half, b, at, d)]
            continue
        rows: list[np.ndarray] = []
        rows.append(_scores(weight, x[a:b], y[c:d], rows))
        i, j = b - a, d - c
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((a + i, c + j))
    return found


def align(page: Node, model: Node) -> None:
    """Give the page's text blocks the slots of the model's blocks that they match."""
    todo = [(page, model)]
    while todo:
        a, b = todo.pop()
        if a.tag == "#":
            a.slot = b.slot
            continue
        if a.shape == b.shape:
            todo.extend(zip(a.children, b.children))
            continue
        x, y, first, last = _middle(a.children, b.children)
        todo.extend(zip(a.children[:first], b.children[:first]))
        if last:
            todo.extend(zip(a.children[-last:], b.children[-last:]))
        if x and y:
            todo.extend((x[i], y[j]) for i, j in _matches(*_weights(x, y)))


def blocks(page: Node) -> list[tuple[int, bool, bool, str]]:
    """(slot, whether it may be article text, whether it lies in a marked article, text) of the text blocks in page order."""
    found: list[tuple[Node, bool, bool]] = []
    todo = [(page, False, False)]
    while todo:
        x, drop, inside = todo.pop()
        if x.tag == "#":
            found.append((x, drop, inside))
            continue
        drop, inside = drop or x.drop, inside or x.root
        todo.extend((c, drop, inside) for c in reversed(x.children))
    marked = any(inside and not drop for _, drop, inside in found)
    return [(x.slot, not drop and (inside if marked else x.links < LINKS * len(x.text)), inside, x.text) for x, drop, inside in found]


def _join_by_host(rows: DataFrame, small: DataFrame, bytes_: int) -> DataFrame:
    return rows.join(F.broadcast(small) if bytes_ <= BROADCAST_BYTES else small, "host", "left")


def _aligned(pages: DataFrame) -> DataFrame:
    """page_id, url, host, digest (of all texts that may be kept), blocks. ``pages`` has the model's html too."""
    block = pa.struct([("slot", pa.int32()), ("keep", pa.bool_()), ("marked", pa.bool_()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[str, Node] = {}
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids, urls, hosts, sources, of = (c.to_pylist() for c in part.columns)
                out, digests = [], []
                for host, source, model_source in zip(hosts, sources, of):
                    if host not in models:
                        if len(models) > 500:
                            models.clear()
                        models[host] = parse(model_source or "")
                        number_slots(models[host])
                    page = parse(source or "")
                    align(page, models[host])
                    own = blocks(page)
                    out.append([{"slot": s, "keep": keep, "marked": marked, "text": t} for s, keep, marked, t in own])
                    digests.append(xxhash.xxh64_intdigest("\n".join(t for _, keep, _, t in own if keep).encode("utf-8", "surrogatepass")) - (1 << 63))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(digests, pa.int64()), pa.array(out, pa.list_(block))], names=["page_id", "url", "host", "digest", "blocks"])

    return pages.select("page_id", "url", "host", "html", "model").mapInArrow(run, "page_id long, url string, host string, digest long, blocks array<struct<slot:int,keep:boolean,marked:boolean,text:string>>")


def _template(aligned: DataFrame) -> DataFrame:
    """host, template and marked_template: hashes of slot and text that are constant, outside and inside a marked article."""
    kept = aligned.select("host", "digest", F.explode(F.filter("blocks", lambda b: b["keep"] & (b["slot"] >= 0))).alias("b"))
    # of pages with one digest, one counts
    texts = kept.select("host", "digest", F.col("b.slot").alias("slot"), F.xxhash64("b.slot", "b.text").alias("text")).distinct().groupBy("host", "slot", "text").agg(F.count("*").alias("n"))
    share = F.max("n") / F.sum("n")
    constant = texts.groupBy("host", "slot").agg(F.max("n").alias("n"), share.alias("share"), F.max_by("text", F.struct("n", "text")).alias("text")).where((F.col("n") >= LEAST_PAGES) & (F.col("share") >= TEMPLATE_SHARE))
    strong = (F.col("n") >= MARKED_PAGES) & (F.col("share") >= MARKED_SHARE)
    return constant.groupBy("host").agg(F.collect_list("text").alias("template"), F.collect_list(F.when(strong, F.col("text"))).alias("marked_template"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", induction: bool = True) -> DataFrame:
    """page_id, url and text (blocks joined by an empty line) of every page. ``induction`` is off in comparisons only."""
    host = F.lower(F.regexp_extract(F.coalesce(pages[url_col], F.lit("")), _HOST.pattern, 1))
    own = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), host.alias("host"), pages[html_col].cast("string").alias("html"))
    bare = F.coalesce(F.length("html"), F.lit(0)) == 0
    models = materialize(own.groupBy("host").agg(F.min_by("html", F.struct(bare, F.xxhash64("page_id"), F.xxhash64("html"))).alias("model")), "models")
    size = models.agg(F.sum(F.length("model") + F.length("host") + 50)).first()[0] or 0
    aligned = materialize(_aligned(_join_by_host(own, models, 4 * size)), "blocks")
    template = materialize(_template(aligned) if induction else _template(aligned).limit(0), "template")
    size = template.agg(F.sum(F.size("template") * 16 + F.length("host") + 50)).first()[0] or 0
    joined = _join_by_host(aligned, template, size)
    constant = lambda b: F.array_contains(F.when(b["marked"], F.col("marked_template")).otherwise(F.col("template")), F.xxhash64(b["slot"], b["text"]))
    text = F.array_join(F.transform(F.filter("blocks", lambda b: b["keep"] & ~F.coalesce(constant(b), F.lit(False))), lambda b: b["text"]), "\n\n")
    return joined.select("page_id", "url", text.alias("text"))


def op7_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))
