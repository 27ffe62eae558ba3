"""Hierarchical multi-length packing of documents into token sequences.

A document's ids are cut into as many full windows of the longest context as
they fill; its remainder is routed to the smallest context-size tier that
holds it.  Each tier is packed into windows of its own size, longest tier
first: a window opens with the longest remainder that waits in its tier, and
its gap is filled with the best-fitting remainders of the same and shorter
tiers.  Where all that wait are longer than the gap, one is cut, and what is
left of it is routed again.  At the end of a partition, where too few ids are
left to fill a tier's window, they leave in sequences whose lengths are powers
of two, which need no padding.

Sequences of one tier are dealt to step groups of one token budget and
near-equal attention cost, so all sequences of a training step have one size.

Everything happens inside the scan's own partitions: there is no shuffle, a
task holds only the remainders that wait (``QUEUE_TOKENS`` at most), and a
task that is run again gives the same rows.

Nulls and edge cases: a null text counts as empty and yields one piece with
the end id alone; a null id stays null; repeated rows are packed separately;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, gathered
from .tokens import CACHE_PIECES, piece_tokenizer

#: Context sizes, ascending powers of two; each tier's windows have its size.
TIERS = (128, 256, 512, 1024)
#: Tokens of remainders that wait in a task before windows are closed.
QUEUE_TOKENS = 1 << 21
#: Tokens of a step group, and groups among which a tier's sequences are dealt.
STEP_TOKENS, STEPS = 1 << 16, 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs one partition's documents; ``rows`` gives rows of SCHEMA's columns."""

    def __init__(self, base: int, tiers: tuple[int, ...] = TIERS):
        self.base, self.tiers, self.window = base, tiers, tiers[-1]
        self.waiting: list[list] = [[] for _ in range(self.window)]  # by length; a tier's are those longer than the tier before
        self.lengths = 0  # a bit for each length that waits
        self.tokens = self.sequences = self.groups = 0
        self.ready: dict[int, list] = {t: [] for t in tiers}  # by tier: attention cost, pieces

    def _put(self, piece: tuple) -> None:
        """Route a remainder to its tier."""
        n = piece[2]
        self.waiting[n].append(piece)
        self.lengths |= 1 << n
        self.tokens += n

    def _pop(self, n: int) -> tuple:
        piece = self.waiting[n].pop()
        if not self.waiting[n]:
            self.lengths &= ~(1 << n)
        self.tokens -= n
        return piece

    def _close(self, pieces: list) -> None:
        size = sum(p[2] for p in pieces)
        self.ready[next(t for t in self.tiers if size <= t)].append((sum(p[2] * p[2] for p in pieces), pieces))

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.window:
            self._close([(doc_id, at, self.window, ids[at : at + self.window], n)])
            at += self.window
        if at < n:
            # the remainder alone: the whole document's ids need not wait
            self._put((doc_id, at, n - at, ids[at:].copy(), n))

    def _fill(self, size: int) -> None:
        """Close one sequence of exactly ``size`` tokens from what waits, the longest that fit first."""
        pieces, gap = [], size
        while gap:
            fits = self.lengths & ((1 << (gap + 1)) - 1)
            if fits:
                piece = self._pop(fits.bit_length() - 1)
            else:  # the shortest that waits is longer than the gap: cut it
                doc_id, at, n, ids, total = self._pop((self.lengths & -self.lengths).bit_length() - 1)
                piece = (doc_id, at, gap, ids[:gap], total)
                self._put((doc_id, at + gap, n - gap, ids[gap:], total))
            pieces.append(piece)
            gap -= piece[2]
        self._close(pieces)

    def drain(self, keep: int) -> None:
        """Pack each tier, the longest first, until ``keep`` tokens wait or no window can be filled."""
        below = (0, *self.tiers)
        for low, tier in reversed([*zip(below, self.tiers)]):
            own = (1 << (tier + 1)) - (1 << (low + 1))
            while self.lengths & own and self.tokens >= max(keep, tier):
                self._fill(tier)  # the longest that fits is the tier's own longest

    def finish(self) -> None:
        self.drain(0)
        while self.tokens:
            self._fill(min(self.window, 1 << (self.tokens.bit_length() - 1)))

    def rows(self, everything: bool = False) -> list[tuple]:
        """Rows of the sequences that are ready, dealt to step groups of one tier and near-equal cost."""
        out = []
        for tier, ready in self.ready.items():
            each = max(1, STEP_TOKENS // tier)
            n = len(ready) if everything else len(ready) // (each * STEPS) * each * STEPS
            groups = -(-n // each)
            for k, (_, pieces) in enumerate(sorted(ready[:n], key=lambda x: -x[0])):  # stable
                turn, at = divmod(k, groups)
                group = self.base + self.groups + (at if turn % 2 == 0 else groups - 1 - at)
                offset = 0
                for doc_id, start, length, ids, total in pieces:
                    out.append((doc_id, start, length, zlib.crc32(ids.astype("<u4").tobytes()), total, self.base + self.sequences, offset, tier, group))
                    offset += length
                self.sequences += 1
            self.groups += groups
            del ready[:n]
        return out


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """Pieces of packed sequences, one row each (columns of ``SCHEMA``). ``cache_pieces`` bounds what a worker keeps of the tokenizer's work, and changes no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = piece_tokenizer(tokenizer_path, "byte", cache_pieces)
        end = np.array([end_id], dtype=tok.dtype)
        packer = Packer(TaskContext.get().partitionId() << 33)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [pa.int32() if f.endswith(" int") else pa.int64() for f in SCHEMA.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), tok.encode(t.as_py() or "" for t in b.column(1))):
                packer.add(doc_id, np.concatenate([ids, end]))
                if packer.tokens >= QUEUE_TOKENS:
                    packer.drain(QUEUE_TOKENS // 2)
                if any(len(x) * tier >= STEPS * STEP_TOKENS for tier, x in packer.ready.items()):
                    yield batch(packer.rows())
        packer.finish()
        if rows := packer.rows(everything=True):
            yield batch(rows)

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return gathered(own, own).mapInArrow(run, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
