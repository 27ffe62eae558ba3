"""Packing and the token store against the tokenizers library itself."""

import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm import packing, token_store
from graphloom.llm.tokens import PieceTokenizer

from .helpers import edge_documents, save_documents


def direct(name, texts, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def check_packing(docs, rows):
    """Every id in one piece, sequences gapless and full or of a power of two."""
    wanted = {}
    for d, ids in zip([r.doc_id for r in docs], direct("byte_bpe_50k.json", [r.text for r in docs], 0)):
        wanted.setdefault(d, []).append(ids)
    for d, lists in wanted.items():
        own = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == d)
        if len(lists) == 1:
            at = 0
            for start, length, c, total in own:
                assert start == at and total == len(lists[0]) and c == crc(lists[0][start : start + length])
                at += length
            assert at == len(lists[0])
        else:
            assert sum(x[1] for x in own) == sum(map(len, lists))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0


def test_packing_edges(spark, tmp_path):
    folder = save_documents(edge_documents(spark).coalesce(2), tmp_path)
    check_packing(spark.read.parquet(f"{folder}/documents.parquet").collect(), packing.op1_packing(spark, folder).collect())


def test_packing_all(spark, sf_dir):
    rows = packing.op1_packing(spark, sf_dir).collect()
    check_packing(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), rows)
    groups = {}
    for r in rows:
        groups.setdefault((r.step_group, r.tier), {}).setdefault(r.sequence_id, []).append(r.length)
    assert len({g for g, _ in groups}) == len(groups)  # one tier in a group
    sums = {}
    for (_, tier), g in groups.items():
        assert len(g) * tier <= packing.STEP_TOKENS and all(tier / 2 < sum(x) <= tier for x in g.values() if sum(x) > 128)
        sums.setdefault(tier, []).append((len(g), sum(n * n for x in g.values() for n in x)))
    for of in sums.values():
        assert max(n for n, _ in of) - min(n for n, _ in of) <= 1
        assert len(of) == 1 or max(c for _, c in of) < 1.5 * min(c for _, c in of)


def test_packing_empty(spark, tmp_path):
    folder = save_documents(edge_documents(spark).limit(0), tmp_path)
    assert packing.op1_packing(spark, folder).count() == 0


def test_packer_cuts_a_piece_to_fill():
    p = packing.Packer(0)
    p.add(1, np.arange(900, dtype="<u2"))
    p.add(2, np.arange(600, dtype="<u2"))
    p.finish()
    rows = p.rows(everything=True)
    assert sorted(sum(r[2] for r in rows if r[5] == s) for s in {r[5] for r in rows}) == [4, 8, 16, 64, 128, 256, 1024]


def test_each_tier_is_packed_and_long_gaps_are_filled():
    """Remainders are routed: windows of every size, opened by their own tier, gaps filled by shorter ones."""
    rng = np.random.default_rng(5)
    p, sizes = packing.Packer(0), [int(n) for n in np.exp(rng.uniform(0, np.log(3000), 6000))]
    for k, n in enumerate(sizes):
        p.add(k, np.arange(n, dtype="<u2"))
        if p.tokens >= 200_000:
            p.drain(100_000)
    p.finish()
    rows = p.rows(everything=True)
    assert sum(r[2] for r in rows) == sum(sizes)
    windows = {}
    for r in rows:
        windows.setdefault((r[5], r[7]), []).append((r[6], r[2]))
    count, shorter = dict.fromkeys(packing.TIERS, 0), dict.fromkeys(packing.TIERS, 0)
    for (_, tier), pieces in windows.items():
        pieces.sort()
        if sum(n for _, n in pieces) == tier:
            count[tier] += 1
            shorter[tier] += len(pieces) > 1 and pieces[0][1] > tier // 2 and all(n <= tier // 2 for _, n in pieces[1:])
    assert all(n > 50 for n in count.values())
    assert all(shorter[t] > 20 for t in packing.TIERS)
    assert sum(count.values()) >= len(windows) - 9


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_ids_of_odd_strings(name, kind):
    """Characters whose lower case or composition has another length, next to marks, digits, contractions and white space."""
    changing = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (len(chr(c).lower()) > 1 or len(chr(c).upper()) > 1 or len(unicodedata.normalize("NFC", chr(c))) > 1)]
    alphabet = [*"aZ7é ß.,;:!?'_-#\n\t ²½ªµ", "'s", "'LL", "\u0307", "\u0301", "\x7f", "\xa0", "\xad", "İ", "Σ", "好", "א", "\x02", "\x1c", "\x85", "<|endoftext|>"]
    rng = random.Random(11)
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 9))) for _ in range(60_000)]
    texts += [f"{a}{c}{b}" for c in changing for a in ("", "a", "É ") for b in (".", "x,", " ", "'s", "1?!")]
    texts += ["".join(rng.choices(changing + alphabet, k=rng.randint(1, 8))) for _ in range(40_000)]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    wanted = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    got = [x.tolist() for x in PieceTokenizer(public_tokenizers.path(name), kind).encode(texts)]
    assert [t for t, a, b in zip(texts, wanted, got) if a != b] == []


def check_store(docs, rows):
    ids = direct("word_bpe_49k.json", [r.text for r in docs], 2)
    start = 0
    wanted = sorted(zip([r.doc_id for r in docs], ids), key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
    got = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [x[0] for x in wanted]
    for r, (_, x) in zip(got, wanted):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(x), crc(x))
        start += len(x)


def test_store_edges(spark, tmp_path):
    folder = save_documents(edge_documents(spark).coalesce(2), tmp_path)
    check_store(spark.read.parquet(f"{folder}/documents.parquet").collect(), token_store.op9_token_store(spark, folder).collect())


def test_store_all(spark, sf_dir):
    check_store(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), token_store.op9_token_store(spark, sf_dir).collect())


def test_store_empty(spark, tmp_path):
    folder = save_documents(edge_documents(spark).limit(0), tmp_path)
    assert token_store.op9_token_store(spark, folder).count() == 0


def test_store_round_trip_and_sharing(spark, tmp_path):
    words = [f"w{k * 7919 % 5000}" for k in range(6000)]
    docs = edge_documents(spark, [" ".join(words), " ".join(words[500:]), " ".join(words)])
    store = token_store.write_store(docs, public_tokenizers.path("word_bpe_49k.json"), 2, path=str(tmp_path / "store"))
    wanted = direct("word_bpe_49k.json", [r.text for r in docs.collect()], 2)
    assert [r.ids for r in token_store.read_documents(spark, store).collect()] == wanted
    assert store.chunks(spark).groupBy("digest").count().where("count > 1").count() == 0
    stored = sum(r.n for r in store.chunks(spark).collect())
    assert stored < 1.2 * len(wanted[0])


def test_store_finds_damage(spark, tmp_path):
    store = token_store.write_store(edge_documents(spark, ["a b c", "d e f"]), public_tokenizers.path("word_bpe_49k.json"), 2, path=str(tmp_path / "store"))
    bad = spark.createDataFrame([(0, bytearray(b"0" * 16), 1, bytearray(b"xx"))], "kind int, digest binary, n int, data binary")
    bad.write.mode("append").parquet(f"{store.path}/chunks")
    with pytest.raises(Exception, match="damaged"):
        token_store.read_checksums(spark, store).collect()


def test_checksums_combine():
    a, b = b"abc" * 100, b"xyz" * 77
    part = token_store.shifted(np.array([zlib.crc32(a), zlib.crc32(b)]), np.array([len(b), 0]))
    assert int(part[0]) ^ int(part[1]) == zlib.crc32(a + b)


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_a_small_cache_changes_no_ids(name, kind):
    path = public_tokenizers.path(name)
    texts = [f"word{k % 37} other{k}, and some more; {k}!" for k in range(200)] * 2
    small, own = PieceTokenizer(path, kind, cache_pieces=5), Tokenizer.from_file(path)
    for text in texts:
        assert next(small.encode([text])).tolist() == own.encode(text, add_special_tokens=False).ids
    assert len(small.cache) < 50
