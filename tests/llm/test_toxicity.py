"""Deobfuscation against all paths of the lattice, and held-out accuracy."""

import itertools
import re
import zlib

import pytest

from graphloom.llm import toxicity

from .helpers import edge_documents, save_documents

WORDS = ["stupid", "idiot", "loser", "moron", "nice", "garden", "people", "walking", "house", "letter", "good", "summer", "the", "you", "are"]


@pytest.fixture(scope="module")
def characters():
    return toxicity.CharacterModel(dict(toxicity.trigrams(WORDS * 5)))


@pytest.mark.parametrize("token,word", [("1d10t", "idiot"), ("stup1d", "stupid"), ("s.t.u.p.i.d", "stupid"), ("s t u p i d", "stupid"), ("l0000ser", "loser"), ("iiidiooot", "idiot"), ("m*ron", "moron"), ("$tupid", "stupid"), ("i_d_i_o_t", "idiot"), ("leeetter", "letter"), ("stuupid", "stupid"), ("idio+", "idiot"), ("mor0n!!!", "moron"), ("l0$er.", "loser")])
def test_restores(characters, token, word):
    assert toxicity.decode(token, characters) == [word]


@pytest.mark.parametrize("token", ["1d10t", "s.t0p", "aaab", "m*r0n", "l1ll", "a b1", "gooood"])
def test_viterbi_is_the_cheapest_path(characters, token):
    def cost(path):
        text, total = "##", 0.0
        for c, channel in path:
            total += channel
            if c and not (c == "#" and text[-1] == "#"):
                total += characters.cost(text[-2:] + c)
                text = text + "##" if c == "#" else text + c
        return total + (0 if text[-1] == "#" else characters.cost(text[-2:] + "#"))

    def words(path):
        return [w for w in "".join(c for c, _ in path).split("#") if w]

    best = min(itertools.product(*toxicity.lattice(token)), key=cost)
    got = min((cost(p) for p in itertools.product(*toxicity.lattice(token)) if words(p) == toxicity.decode(token, characters)))
    assert got == pytest.approx(cost(best))


def test_held_out_accuracy(spark):
    rows = toxicity.op10_toxicity(spark, "/root/testdata/sf0.1").collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    caught = [r.predicted for r in held if truth[r.doc_id]]
    clean = [r.predicted for r in held if not truth[r.doc_id]]
    # about a twentieth of the toxic labels lies on texts of filler words alone, which no reading can tell
    assert sum(caught) >= 0.9 * len(caught) and sum(clean) <= 0.01 * len(clean)


def test_hidden_words_are_caught(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    plain = "the onre of and thered by ingan "
    assert model.score(plain) < 0.5
    for hidden in ("1d10t st0pid m0r0n", "s t u p i d   i d i o t l.o.s.e.r", "patheeeetic loooser scuuum", "tr@sh cl0wn $cum"):
        assert model.score(plain + hidden) >= 0.5, hidden
    assert model.score("12.5% on 2024-01-02 at http://a.b/c1 v2.0 aaa bbb") < 0.5


PLAIN = "the onre of and thered by ingan "


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(docs, labels, toxicity.crc_mod("doc_id", 5) != 0)


def test_no_sign_lowers_a_score(model):
    words = sorted((s[1:] for s in model.signs if s[0] == "w" and not model.may_hide(s[1:])), key=lambda w: max(model.signs.get(s, 0) for s in toxicity.signs_of(w)))
    base = [model.score(PLAIN + " ".join(words[:k]) + " x" * (30 - k)) for k in range(10)]
    assert base == sorted(base) and base[0] < base[-1] and model.weights[1] > 0
    swapped = [model.score(PLAIN + w) for w in words]
    assert swapped == sorted(swapped)


def hide(word, how):
    leet = str.maketrans("oieast", "013@$+")
    return {"leet": word.translate(leet), "spaced": " ".join(word), "dots": ".".join(word), "long": "".join(c * 3 for c in word), "double": word[0] + "".join(c * 2 for c in word[1:]), "end": word[:-1] + word[-1].translate(leet) + "!!"}[how]


@pytest.mark.parametrize("how", ["leet", "spaced", "dots", "long", "double", "end"])
def test_planted_obfuscation_across_held_out_rows(spark, model, how):
    """Toxic rows whose words are hidden are caught as before hiding, and missed without the decoder."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    toxic = [r.text for r in docs.join(labels.where("toxic = 1"), "doc_id").where(toxicity.crc_mod("doc_id", 5) == 0).collect()]
    words = {s[1:] for s in model.signs if s[0] == "w" and model.signs[s] > 3}
    pattern = re.compile(r"(?<![^\W_])(" + "|".join(sorted(words)) + r")(?![^\W_])")
    texts = [t.lower() for t in toxic if model.score(t.lower()) >= 0.5 and pattern.search(t.lower())]
    hidden = [pattern.sub(lambda m: f" {hide(m[0], how)} ", t) for t in texts]
    blind = toxicity.Model(model.characters, model.signs, model.weights, decoder=False)
    caught, without = sum(model.score(t) >= 0.5 for t in hidden), sum(blind.score(t) >= 0.5 for t in hidden)
    assert len(texts) > 50 and caught >= 0.95 * len(texts)
    assert how == "end" or without <= 0.2 * len(texts)  # beginnings of words are signs too


def test_clean_rows_gain_nothing_by_decoding(spark, model):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    clean = [r.text for r in docs.join(labels.where("toxic = 0"), "doc_id").where(toxicity.crc_mod("doc_id", 5) == 0).collect()]
    assert sum(model.score(t) >= 0.5 for t in clean) <= 0.01 * len(clean)


def test_skeletons_leave_out_no_sign(spark, model):
    """The score of a text is the same where every token with more than one path is searched."""
    every = toxicity.Model(model.characters, model.signs, model.weights, gate=False)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(150).collect()]
    words = [s[1:] for s in model.signs if s[0] == "w"]
    texts += [PLAIN + " ".join(hide(w, how) for w in words[k::7]) for k in range(7) for how in ("leet", "spaced", "dots", "long", "double", "end")]
    texts += [None, "", "a$$ a55 455 @$$ st*pid sh!t!!! i.d-i_o/t 1|1|1 c10wn", "x" * 5000, "1!" * 2000]
    assert [model.score(t) for t in texts] == [every.score(t) for t in texts]


def test_all_labelled_rows_are_learned_from(spark):
    """The rarest word of many rows is a sign, and each different text counts once, whatever the number of rows."""
    rows = [(k, f"plain words of row number x{'abcdefghij'[k % 10]} {'qwertyuiop'[k // 10 % 10]}{'asdfghjkl'[k // 100 % 9]}{'zxcvbnm'[k // 900]}" + (" nasty" if k % 5 == 0 else "") + (" seldomword" if k in (2500, 4000, 5005, 5500, 6000, 15) else "")) for k in range(6300)]
    docs = spark.createDataFrame([*rows, *rows[:50]], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k, _ in rows], "doc_id long, toxic int")
    seen = toxicity.labelled_texts(docs, labels, toxicity.F.lit(True))
    assert sorted(r.text for r in seen.collect()) == sorted({t for _, t in rows})
    assert {"wnasty", "wseldomword"} <= set(toxicity.fit(docs, labels).signs)


def test_edges_and_no_labels(spark, tmp_path):
    docs = edge_documents(spark)
    folder = save_documents(docs, tmp_path)
    labels = spark.createDataFrame([(3, 0, 0), (7, 1, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    rows = toxicity.op10_toxicity(spark, folder).collect()
    assert len(rows) == docs.count()
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    labels.limit(0).write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    assert {(r.score, r.predicted) for r in toxicity.op10_toxicity(spark, folder).collect()} == {(0.0, 0)}


def test_empty(spark, tmp_path):
    folder = save_documents(edge_documents(spark).limit(0), tmp_path)
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert toxicity.op10_toxicity(spark, folder).count() == 0


def test_texts_are_moved_once_and_counted_as_stated(spark):
    """Texts go through one exchange at every size; signs count texts, trigrams count words."""
    draw = zlib.crc32
    texts = [" ".join(WORDS[draw(f"{k}-{j}".encode()) % len(WORDS)] + ("," if j % 3 == 0 else "") for j in range(12)) for k in range(400)] + ["Stupid stupid garden", "Stupid stupid garden"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(5, texts[5]), (6, texts[7])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int("idiot" in t or "moron" in t)) for k, t in enumerate(texts)], "doc_id long, toxic int")
    plans, write = [], toxicity.materialize

    def seen(df, name, **options):
        if name == "learned-from":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        if name == "sign-counts":
            counts.update({r.sign: (r.bad, r.good) for r in df.collect()})
        return write(df, name, **options)

    counts = {}
    toxicity.materialize = seen
    try:
        model = toxicity.fit(docs, labels)
        rows = [(r.text, r.toxic) for r in toxicity.labelled_texts(docs, labels, toxicity.F.lit(True)).collect()]
    finally:
        toxicity.materialize = write
    assert len(rows) == len({t for t, _ in rows}) and model is not None
    moved = [x for x in plans[0].split("\n") if "Exchange" in x]
    assert "SortMergeJoin [doc_id" in plans[0] and len(moved) >= 2
    want, grams = {}, toxicity.Counter()
    for text, toxic in rows:
        words = toxicity._WORD.findall(text.lower())
        grams.update(toxicity.trigrams(words))
        for s in {s for w in set(words) for s in toxicity.signs_of(w)}:
            bad, good = want.get(s, (0, 0))
            want[s] = (bad + toxic, good + 1 - toxic)
    assert counts == want | {"c" + g: (n, 0) for g, n in grams.items()}
    words = [s[1:] for s in model.signs if s[0] == "w"]
    every = toxicity.Model(model.characters, model.signs, model.weights, gate=False)
    tokens = [f"{a}{w}{b}" for w in [*words, "idiotic", "iddiot", "gooddog", "letter"] for a in ("", '"', "(", "'", "--") for b in ("", ",", ".", "?!", "...", ")", "'s", "-ish")]
    assert words and [model.score(t) for t in tokens] == [every.score(t) for t in tokens]
