"""Exact tokenization with a cache of white-space delimited pieces.

Both vocabularies split text before merging, and no pre-token spans a single
space between two other characters.  A text's ids are therefore the
concatenation of its pieces' ids, and a piece's ids can be kept.  A new piece
of Latin-1 characters is split into pre-tokens here, by the vocabulary's own
pattern, and the library's model merges each; other pieces and texts with
unusual white space take the library's whole path.  Ids are always those of
the tokenizers library.

A text must not be null; an empty one has no ids; equal texts have equal ids,
whatever the cache holds; very long texts are handled one at a time.

Special tokens: their strings in a text are ordinary text, as the vocabulary
files' own instructions have it (``encode_special_tokens = True``).
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: Pieces that one Python worker keeps, unless told otherwise: some 170 bytes each.
CACHE_PIECES = 1_000_000
#: Characters of texts that are handled together.
GROUP_CHARS = 1 << 18
#: White space on which Python and the tokenizer's patterns might differ, or that the byte vocabulary attaches to neighbours.
_ODD_BYTE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x02]|[ \n][ \n]|^[ \n]|[ \n]$")
_ODD_WORD = re.compile("[\x1c-\x1f\x85]")
#: Letters and numbers of Latin-1, the pre-token patterns of the two vocabularies over it, and the byte alphabet.
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_BYTE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^ {_L}{_N}]+")
_WORD_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^ {_L}{_N}]+")
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_OPEN: dict[tuple[str, str, int], "PieceTokenizer"] = {}


def _latin(text: str) -> bool:
    """Whether all characters lie below U+0100, where lower case is the same for Python and the tokenizer."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class PieceTokenizer:
    """``kind`` is "byte" (byte-level pieces keep their leading space) or "word" (white space is dropped, case ignored)."""

    def __init__(self, path: str, kind: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.byte, self.cache_pieces = kind == "byte", cache_pieces
        self.code = "H" if self.tokenizer.get_vocab_size() <= 65536 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.merge = self.tokenizer.model.tokenize
        # the byte vocabulary's key of a piece without a space before it begins with \x02
        self.fixed = dict(zip(["\x02", "\n"], self._direct(["", "\n"]))) if self.byte else {}
        self.cache: dict[str, bytes] = dict(self.fixed)

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _token(self, token: str) -> bytes:
        """Ids of one pre-token."""
        key = token if not self.byte else token[1:] if token[0] == " " else "\x02" + token
        got = self.cache.get(key)
        if got is None:
            if token.isascii() and token.isprintable():  # only a space has another letter
                letters = "\u0120" + token[1:] if token[0] == " " else token
            else:
                letters = token.encode().decode("latin-1").translate(_ALPHABET)
            got = self.cache[key] = array(self.code, [t.id for t in self.merge(letters)]).tobytes()
        return got

    def _learn(self, new: list[str]) -> None:
        """Keep the ids of new pieces."""
        other = []
        for p in new:
            if not _latin(p):
                other.append(p)
            elif self.byte:
                self.cache[p] = b"".join(map(self._token, _BYTE_TOKEN.findall(p[1:] if p[0] == "\x02" else " " + p)))
            else:
                self.cache[p] = b"".join(map(self._token, _WORD_TOKEN.findall(p.lower())))
        if other:
            self.cache.update(zip(other, self._direct([p[1:] if p[0] == "\x02" else " " + p for p in other] if self.byte else other)))

    def _split(self, text: str) -> list[str] | None:
        """Pieces of a text, or None if it must take the tokenizer's own path."""
        plain = (text.replace("\n", "") if "\n" in text else text).isprintable()  # quick, and false for all odd white space
        if self.byte:
            if not text:
                return ["\x02"]
            if not plain and _ODD_BYTE.search(text) or "  " in text or text[0] in " \n" or text[-1] in " \n":
                return None
            if "\n" not in text:
                return ("\x02" + text).split(" ")
            if "\n\n" in text or " \n" in text or "\n " in text:
                return None
            return ("\x02" + text.replace("\n", " \n \x02")).split(" ")
        if not plain and _ODD_WORD.search(text):
            return None
        return (text.lower() if _latin(text) else text).split()

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.cache) > self.cache_pieces:  # the first to come are the frequent ones
            self.cache = {p: self.cache[p] for p in list(self.cache)[: self.cache_pieces // 2]} | self.fixed
        get, raw, own = self.cache.get, [], []
        lacking: list[tuple[int, list[int], list[str]]] = []
        for k, text in enumerate(texts):
            pieces = self._split(text)
            if pieces is None:
                own.append(k)
                raw.append(None)
                continue
            ids = list(map(get, pieces))
            if None in ids:
                holes = [j for j, x in enumerate(ids) if x is None]
                lacking.append((k, holes, [pieces[j] for j in holes]))
                raw.append(ids)
            else:
                raw.append(b"".join(ids))
        if lacking:
            self._learn(list(dict.fromkeys(p for _, _, pieces in lacking for p in pieces)))
            for k, holes, pieces in lacking:
                ids = raw[k]
                for j, p in zip(holes, pieces):
                    ids[j] = self.cache[p]
                raw[k] = b"".join(ids)
        if own:
            for k, ids in zip(own, self._direct([texts[k] for k in own])):
                raw[k] = ids
        return [np.frombuffer(x, dtype=self.dtype) for x in raw]

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order; some texts are handled at a time."""
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= GROUP_CHARS:
                yield from self._group(held)
                held, size = [], 0
        if held:
            yield from self._group(held)


def piece_tokenizer(path: str, kind: str, cache_pieces: int = CACHE_PIECES) -> PieceTokenizer:
    """One tokenizer for each Python worker, path, kind and size of its cache."""
    key = path, kind, cache_pieces
    if key not in _OPEN:
        _OPEN[key] = PieceTokenizer(*key)
    return _OPEN[key]
