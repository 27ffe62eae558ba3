"""Main text of pages: planted templates, alignment by brute force, the generated pages, broken markup."""

import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from graphloom.llm import wrappers as w


def save(spark, rows, folder):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    df.write.mode("overwrite").parquet(f"{folder}/pages.parquet")
    return str(folder)


def text_of(source):
    return "\n\n".join(t for _, keep, _, t in w.blocks(w.parse(source)) if keep)


def test_generated_pages(spark, sf_dir):
    """Independent reading of the generator's simple markup: all of the article's paragraphs."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = w.op7_wrappers(spark, sf_dir).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        body = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        parts = [html.unescape(re.sub(r"<[^>]*>", " ", p)) for p in re.split(r"<p>|</p>|<h1>|</h1>", body)]
        assert r.text == "\n\n".join(" ".join(p.split()) for p in parts if p.split())
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_template_is_found_where_nothing_is_marked(spark, tmp_path):
    rng = random.Random(2)
    words = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    rows, wanted = [], {}
    for k in range(60):
        paragraphs = [words(20) for _ in range(rng.randrange(1, 7))]
        wanted[k] = "\n\n".join(paragraphs)
        rows.append((k, f"http://Site{k % 2}.example/{k}", f"<html><body><div><div>Welcome to site {k % 2}</div><div><p>{'</p><p>'.join(paragraphs)}</p></div><div>All rights and lefts</div></div></body></html>"))
    got = {r.page_id: r.text for r in w.op7_wrappers(spark, save(spark, rows, tmp_path)).collect()}
    assert got == wanted


def unmarked(rng, k, site, edge="Welcome"):
    words = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    paragraphs = [words(20) for _ in range(rng.randrange(1, 6))]
    page = f"<html><body><div><div>{edge} to {site}</div><section><p>{'</p><p>'.join(paragraphs)}</p></section><div><p>All rights</p><p>and lefts</p></div></div></body></html>"
    return (k, f"http://{site}/{k}", page), "\n\n".join(paragraphs)


def test_small_hosts_and_a_deviating_page(spark, tmp_path):
    """Hosts of four pages have a template too, and one page that says something else in a slot keeps it, alone."""
    rng, rows, wanted = random.Random(4), [], {}
    for k in range(40):
        row, wanted[k] = unmarked(rng, k, f"s{k // 4}.example")
        rows.append(row)
    for k in range(40, 100):
        row, wanted[k] = unmarked(rng, k, "large.example", "Farewell" if k == 77 else "Welcome")
        rows.append(row)
    wanted[77] = "Farewell to large.example\n\n" + wanted[77]
    rows += [(None, "http://large.example/x", rows[50][2])] * 30
    folder = save(spark, rows, tmp_path)
    got = {r.page_id: r.text for r in w.op7_wrappers(spark, folder).collect() if r.page_id is not None}
    assert got == wanted
    off = {r.page_id: r.text for r in w.main_text(spark.read.parquet(f"{folder}/pages.parquet"), induction=False).collect()}
    assert all("All rights" in off[k] and off[k] != wanted[k] for k in wanted)


def test_copies_of_one_page_are_no_template(spark, tmp_path):
    rows = [(k, "http://copies.example/a", "<body><div><p>The same story everywhere.</p></div></body>") for k in range(80)]
    assert {r.text for r in w.op7_wrappers(spark, save(spark, rows, tmp_path)).collect()} == {"The same story everywhere."}


def test_edges(spark, tmp_path):
    rows = [(1, None, None), (None, "x", ""), (2, "not a url", "plain &lt;text&gt; only"), (3, "http://h/", "<p>a<p>b"), (3, "http://h/", "<p>a<p>b"), (4, "http://h/", "<div>" * 3000 + "deep"), (5, "http://h/", "<p>" + "long " * 100_000 + "</p>"), (6, "http://h/", "<article")]
    got = {(r.page_id, r.text) for r in w.op7_wrappers(spark, save(spark, rows, tmp_path)).collect()}
    assert got == {(1, ""), (None, ""), (2, "plain <text> only"), (3, "a\n\nb"), (4, "deep"), (5, " ".join(["long"] * 100_000)), (6, "")}


def test_empty(spark, tmp_path):
    folder = save(spark, [(1, "a", "b")], tmp_path)
    spark.read.parquet(f"{folder}/pages.parquet").limit(0).write.parquet(f"{folder}/none/pages.parquet")
    assert w.op7_wrappers(spark, f"{folder}/none").count() == 0


@pytest.mark.parametrize("source,text", [
    ("<article><h1>T</h1><p>a <b>b</b>\n c<br>d</p><div class='comments'><p>no</p></div></article><footer>f</footer>", "T\n\na b c d"),
    ("<header><h1>Site</h1></header><main><article><header><h1>Title</h1></header><p>x</p></article><aside>s</aside></main>", "Title\n\nx"),
    ("<nav><ul><li><a href=#>m</a></li></ul></nav><div id=cookie-notice>c</div><p>real</p><form><p>f</p></form>", "real"),
    ("<div><ul><li><a href='/a'>Menu</a></li><li><a href='/b'>Other</a></li></ul><p>Text with a <a href=x>link</a> in it</p></div>", "Text with a link in it"),
    ("<p>1 &lt; 2 &amp;&nbsp;3 &#233;&#x4e2d; &copy; &unknown; a<3</p>", "1 < 2 & 3 é中 © &unknown; a<3"),
    ("<script>var a='</p><p>no';</script><style>p{}</style><p title='a>b'>yes</p><!-- <p>no</p> -->", "yes"),
    ("<article><p>one<p>two<ul><li>x<li>y</ul><table><tr><td>c1<td>c2<tr><td>c3</table></article>", "one\n\ntwo\n\nx\n\ny\n\nc1\n\nc2\n\nc3"),
    ("<article><p>in <span class=ad>buy</span> text</p><div style='display: none'>hid</div><p hidden>h</p></article>", "in text"),
    ("<article><p><b>bold<br><p>next</p></article>", "bold\n\nnext"),
])
def test_markup(source, text):
    assert text_of(source) == text


def slow_size(a, b):
    if a.tag != b.tag:
        return 0
    t = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, c in enumerate(a.children, 1):
        for j, d in enumerate(b.children, 1):
            t[i][j] = max(t[i - 1][j], t[i][j - 1], t[i - 1][j - 1] + slow_size(c, d))
    return 1 + t[-1][-1]


@pytest.mark.parametrize(
    "source, text",
    [
        ("<article><section id='discussion'><h2 id=related-work>R</h2><p>r</p></section><h2 id='search-algorithms'>S</h2><h2 id='ad-hoc-networks'>N</h2></article>", "R\n\nr\n\nS\n\nN"),
        ("<main id=search><p class='social-contract'>s</p><div class='share x'>no</div><div role=navigation>no</div></main>", "s"),
        ("<p>a <a href='/wiki/hidden-markov'>b</a> <a href='/p?id=search'>c</a></p><p title='the hidden layer'>d</p><p data-class='ad'>e</p>", "a b c\n\nd\n\ne"),
        ("<p>a</p><p title='x' hidden>no</p><p CLASS=ad>no</p><div id='search-box'>no</div>", "a"),
    ],
)
def test_words_that_only_look_like_marks(source, text):
    assert "\n\n".join(t for _, keep, _, t in w.blocks(w.parse(source)) if keep) == text


def test_alignment_matches_as_many_nodes_as_simple_tree_matching():
    rng = random.Random(9)

    def tree(depth):
        inner = "".join(tree(depth - 1) for _ in range(rng.randrange(0, 4))) if depth else "t"
        return f"<{(t := rng.choice(['div', 'section', 'blockquote']))}>{inner}</{t}>"

    for _ in range(60):
        model, page = w.parse(tree(3)), w.parse(tree(3))
        w.number_slots(model)
        w.align(page, model)
        texts, todo = [], [page]
        while todo:
            x = todo.pop()
            todo.extend(reversed(x.children))
            if x.tag == "#" and x.slot >= 0:
                texts.append(x.slot)
        assert texts == sorted(texts) and len(set(texts)) == len(texts)  # in order, one to one
        assert (len(texts) > 0) <= (slow_size(page, model) > 1)
        assert w._size(page, model) == slow_size(page, model)


def test_halved_tables_align_as_well(monkeypatch):
    rng = random.Random(3)
    tree = lambda n: w.parse("".join(rng.choice(["<p>a</p>", "<h2>b</h2>", "<div><p>c</p></div>", "<div><p>c</p><ul><li>d</ul></div>", "e<hr>"]) for _ in range(n)))
    for _ in range(20):
        weight, x, y = w._weights(tree(rng.randrange(1, 60)).children, tree(rng.randrange(1, 60)).children)
        monkeypatch.setattr(w, "CELLS", 1 << 22)
        whole = w._matches(weight, x, y)
        monkeypatch.setattr(w, "CELLS", 8)
        parts = w._matches(weight, x, y)
        score = lambda pairs: sum(int(weight[x[i], y[j]]) for i, j in pairs)
        assert score(whole) == score(parts) == w._scores(weight, x, y)[-1]
        assert sorted(j for _, j in parts) == [j for _, j in sorted(parts)] and len(set(parts)) == len({i for i, _ in parts})


def test_wide_and_deep_pages_align_to_the_end():
    rng = random.Random(8)
    rows = lambda n: "".join(rng.choice(["<p>a</p>", "<h2>b</h2>", "<div><p>c</p></div>"]) for _ in range(n))
    page, model = w.parse(rows(4000)), w.parse(rows(4000))
    w.number_slots(model)
    w.align(page, model)
    assert sum(x.slot >= 0 for c in page.children for x in (c.children[0].children or c.children)) > 2000
    deep = lambda text, more: w.parse("<div>" * 400 + more + f"<p>{text}</p>")
    page, model = deep("x", ""), deep("y", "<h2>z</h2>")
    w.number_slots(model)
    w.align(page, model)
    while page.children:
        page = page.children[-1]
    assert page.text == "x" and page.slot == 1


def test_letters_that_are_longer_in_lower_case():
    """Positions behind such letters stay right, so scripts end where they do."""
    for n in (1, 4, 20):
        page = f"<article><p>{'İ' * n} abc</p><script>x = '<p>no</p>'</SCRIPT><p>after</p><style>p {{}}</style><p>last</p></article>"
        assert text_of(page) == "\n\n".join(["İ" * n + " abc", "after", "last"])


#: Tags as one pattern tells them (a name goes on to white space, / or >, as in browsers), in time that grows with the square of broken markup or worse.
SLOW_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)[^<>]*(?:>|$)", re.S)


def test_tags_of_broken_markup():
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<div class=ad>", "<", ">", '"', "'", "<!-- x -->", "<!--", "<!x>", "<a href='q>r'>", '<b x="1<2">', "text ", "<br/>", "<td", "</td", "< p>", "/", "=", "<?pi", "x ", "\t"]
    for _ in range(5000):
        source, at, got = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))), 0, []
        tags = w._Tags(source)
        while at < len(source):
            start, at, ending, name, attributes = tags.next(at)
            if start < len(source):
                got.append((start, at, ending, name, attributes))
        assert got == [(m.start(), m.end(), bool(m[1] or m[4]), m[2] or m[5] or "", m[3] or "") for m in SLOW_TAG.finditer(source)]


@pytest.mark.parametrize("part", ['<a "', "<a \"'", "<p", "<p ", "<!", "<!--", "<x>", "<blockquote>", "<a b='\"<i c=\"'", "</y>", "<p><b>"])
def test_time_grows_with_the_length_of_broken_markup(part):
    for end in ("", ">", "'>"):
        began = time.process_time()
        w.parse(part * 20_000 + end)
        assert time.process_time() - began < 5
