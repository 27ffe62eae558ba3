"""Progressive JPEG media columns, encoded and decoded in numpy.

``encode_payload`` stores bytes losslessly in the format's own unit, the
quantized DCT coefficient: 192 bytes are one 8x8 block of each of three
components.  A component's first byte is its DC coefficient, sent by
successive approximation only (a first scan of the bits above the byte, then
one raw bit plane a scan); the others are AC coefficients of ten-bit range
whose magnitudes all have eight bits, sent as a spectral-selection scan of the
upper seven and a refinement scan of the lowest.  Every code then has a fixed
length and whole scans are written and read as arrays.

``decode`` reads any progressive JPEG of 8-bit samples with Huffman coding:
each scan (first or refining, DC or AC, interleaved or not, with or without
end-of-band runs and restart markers) accumulates into coefficient arrays,
which are dequantized, inverse-transformed, chroma-upsampled and turned to
full-resolution RGB.  Scans that are not of fixed-length codes take a bitwise
path.

Nulls and edge cases: a null or empty text is 192 spaces; equal texts give
equal media; null ids and repeated rows keep their rows; very long texts give
wider images (up to 12 GB, beyond what a column holds); an empty table gives
an empty result; other columns are ignored.  Of a media column that is null,
the tensor is null.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, materialize

#: Fixed values of the format: the order in which an 8x8 block's coefficients are sent.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
#: Bytes that one block of three components holds.
UNIT = 192
#: Blocks in a row of an image that has more.
ROW_BLOCKS = 256
#: Bytes of media in one batch.
BATCH_BYTES = 16 << 20
_LONGEST_RUN = 32767
_BASIS = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def padded(data: bytes) -> bytes:
    """``data`` with spaces up to a positive multiple of UNIT."""
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _stuffed(bits: np.ndarray) -> bytes:
    """Entropy-coded bytes of an array of bits, padded with ones."""
    if extra := -len(bits) % 8:
        bits = np.concatenate([bits, np.ones(extra, dtype=np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _scan(components: list[int], ss: int, se: int, ah: int, al: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([len(components), *(x for c in components for x in (c + 1, 0)), ss, se, ah << 4 | al])) + data


def _table(kind: int, symbols: list[int], length: int) -> bytes:
    """A Huffman table whose codes all have one length."""
    return _segment(0xC4, bytes([kind << 4, *(len(symbols) if k == length else 0 for k in range(1, 17))]) + bytes(symbols))


def grid(n: int) -> tuple[int, int]:
    """Rows and columns of ``n`` blocks: ROW_BLOCKS wide, wider where the format's 16-bit height would not do."""
    rows = min(-(-n // ROW_BLOCKS), 65535 // 8)
    return rows, -(-n // rows)


def encode_payload(payload: bytes, n_bytes: int) -> bytes:
    """A progressive JPEG that holds ``payload`` (a positive multiple of UNIT) and its unpadded length."""
    n = len(payload) // UNIT
    rows, wide = grid(n)
    x = np.frombuffer(payload, dtype=np.uint8)
    if rows * wide > n:
        x = np.concatenate([x, np.zeros((rows * wide - n) * UNIT, dtype=np.uint8)])
    x, n = x.reshape(-1, 3, 64), rows * wide
    head = [
        b"\xff\xd8", _segment(0xFE, struct.pack(">QQ", len(payload), n_bytes)), _segment(0xDB, bytes([0]) + b"\x01" * 64),
        _segment(0xC2, struct.pack(">BHHB", 8, rows * 8, wide * 8, 3) + b"".join(bytes([c + 1, 0x11, 0]) for c in range(3))),
        _table(0, [0], 1), _scan([0, 1, 2], 0, 0, 0, 8, _stuffed(np.zeros(3 * n, dtype=np.uint8))),
    ]
    planes = np.unpackbits(np.ascontiguousarray(x[:, :, 0]).reshape(-1, 1), axis=1)  # most significant first
    head += [_scan([0, 1, 2], 0, 0, k + 1, k, _stuffed(planes[:, 7 - k])) for k in range(7, -1, -1)]
    head.append(_table(1, [0x07], 1))
    upper, low = x[:, :, 1:] >> 1, (x[:, :, 1:] & 1) ^ (x[:, :, 1:] < 128)
    head += [_scan([c], 1, 63, 0, 1, upper[:, c].tobytes()) for c in range(3)]  # code 0 and seven bits: never 0xFF
    head.append(_table(1, [r << 4 for r in range(15)], 4))
    for c in range(3):
        bits, at = [], 0
        while at < n:
            run = min(n - at, _LONGEST_RUN)
            r = run.bit_length() - 1
            code = format(r, "04b") + (format(run - (1 << r), f"0{r}b") if r else "")
            bits += [np.frombuffer(code.encode(), dtype=np.uint8) - 48, low[at : at + run, c].reshape(-1)]
            at += run
        head.append(_scan([c], 1, 63, 1, 0, _stuffed(np.concatenate(bits))))
    return b"".join(head) + b"\xff\xd9"


class _Bits:
    """Bits of one entropy-coded stretch, for the bitwise path."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.at = bits.tolist(), 0

    def one(self) -> int:
        self.at += 1
        return self.bits[self.at - 1] if self.at <= len(self.bits) else 0

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.one()
        return v

    def symbol(self, codes: dict) -> int:
        v = 0
        for n in range(1, 17):
            v = v << 1 | self.one()
            if (n, v) in codes:
                return codes[n, v]
        raise ValueError("no such Huffman code")

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


@dataclass
class Image:
    """Quantized coefficients of each component, in zigzag order: int32 (block rows, block columns, 64)."""

    height: int = 0
    width: int = 0
    sampling: list[tuple[int, int]] = field(default_factory=list)
    tables: list[int] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    coefficients: list[np.ndarray] = field(default_factory=list)
    comment: bytes = b""

    def blocks(self, c: int) -> tuple[int, int]:
        """Rows and columns of blocks that component c's own scans have."""
        hm, vm = max(h for h, _ in self.sampling), max(v for _, v in self.sampling)
        h, v = self.sampling[c]
        return -(-(-(-self.height * v // vm)) // 8), -(-(-(-self.width * h // hm)) // 8)

    def places(self, parts: list[int]) -> list[tuple[int, np.ndarray]]:
        """For each component of a scan, where its blocks lie (flat) and in which order: (component, MCU x blocks)."""
        if len(parts) == 1:
            rows, cols = self.blocks(parts[0])
            wide = self.coefficients[parts[0]].shape[1]
            return [(parts[0], (np.arange(rows)[:, None] * wide + np.arange(cols)).reshape(-1, 1))]
        out = []
        for c in parts:
            h, v = self.sampling[c]
            tall, wide = self.coefficients[c].shape[:2]
            out.append((c, (np.arange(tall * wide).reshape(tall // v, v, wide // h, h).transpose(0, 2, 1, 3)).reshape(-1, h * v)))
        return out


def _stretches(data: bytes) -> list[np.ndarray]:
    """Bits between restart markers, without stuffing."""
    parts, at = [], 0
    while (k := data.find(b"\xff", at)) >= 0 and k + 1 < len(data):
        if 0xD0 <= data[k + 1] <= 0xD7:
            parts.append(data[:k])
            data, at = data[k + 2 :], 0
        else:
            at = k + 2
    return [np.unpackbits(np.frombuffer(p.replace(b"\xff\x00", b"\xff"), dtype=np.uint8)) for p in [*parts, data]]


def _dc(image: Image, places: list, bits: list[np.ndarray], restart: int, codes: dict, ah: int, al: int) -> None:
    mcus, each = len(places[0][1]), sum(p.shape[1] for _, p in places)
    step = restart or mcus
    for k, own in enumerate(bits):
        first, last = k * step, min(mcus, (k + 1) * step)
        n = (last - first) * each
        if ah:
            flat = own[:n].reshape(-1, each)
            at = 0
            for c, p in places:
                view = image.coefficients[c].reshape(-1, 64)
                view[p[first:last].reshape(-1), 0] |= flat[:, at : at + p.shape[1]].reshape(-1).astype(np.int32) << al
                at += p.shape[1]
        elif all(codes[c].get((1, 0)) == 0 for c, _ in places) and not own[:n].any() and len(own) >= n:
            continue  # every difference is zero
        else:
            read, last_dc = _Bits(own), {c: 0 for c, _ in places}
            for m in range(first, last):
                for c, p in places:
                    view = image.coefficients[c].reshape(-1, 64)
                    for b in p[m]:
                        last_dc[c] += read.signed(read.symbol(codes[c]))
                        view[b, 0] = last_dc[c] << al


def _ac_first(view: np.ndarray, place: np.ndarray, bits: list[np.ndarray], restart: int, codes: dict, ss: int, se: int, al: int) -> None:
    n, band, step = len(place), se - ss + 1, restart or len(place)
    if codes.get((1, 0)) == 0x07 and len(bits) == 1 and len(bits[0]) == 8 * n * band and not bits[0][::8].any():
        raw = np.packbits(bits[0]).reshape(n, band).astype(np.int32)
        view[place, ss : se + 1] = np.where(raw >= 64, raw, raw - 127) << al
        return
    for k, own in enumerate(bits):
        read, run = _Bits(own), 0
        for b in place[k * step : (k + 1) * step]:
            if run:
                run -= 1
                continue
            at = ss
            while at <= se:
                r, s = divmod(read.symbol(codes), 16)
                if s:
                    at += r
                    view[b, at] = read.signed(s) << al if al == 0 else (lambda v: (abs(v) << al) * (1 if v >= 0 else -1))(read.signed(s))
                    at += 1
                elif r == 15:
                    at += 16
                else:
                    run = (1 << r) + read.take(r) - 1
                    break


def _ac_refine(view: np.ndarray, place: np.ndarray, bits: list[np.ndarray], restart: int, codes: dict, ss: int, se: int, al: int) -> None:
    step, unit, band = restart or len(place), 1 << al, se - ss + 1
    for k, own in enumerate(bits):
        blocks, done, at = place[k * step : (k + 1) * step], 0, 0
        full = bool((view[blocks, ss : se + 1] != 0).all())
        while full and done < len(blocks):  # only end-of-band runs and a correction bit for each coefficient
            read = _Bits(own[at : at + 40])
            r, s = divmod(read.symbol(codes), 16)
            if s or r == 15:
                break
            run = (1 << r) + read.take(r)
            at += read.at
            own_blocks = blocks[done : done + run]
            fix = own[at : at + len(own_blocks) * band].reshape(len(own_blocks), band).astype(np.int32)
            old = view[own_blocks, ss : se + 1]
            view[own_blocks, ss : se + 1] = old + np.where(old > 0, fix, -fix) * unit
            at += len(own_blocks) * band
            done += len(own_blocks)
        read, run = _Bits(own[at:]), 0

        def correct(b: int, j: int) -> None:
            if read.one():
                view[b, j] += unit if view[b, j] > 0 else -unit

        for b in blocks[done:]:
            j = ss
            while j <= se and not run:
                r, s = divmod(read.symbol(codes), 16)
                if not s and r < 15:
                    run = (1 << r) + read.take(r)
                    break
                value = (unit if read.one() else -unit) if s else 0
                while j <= se:
                    if view[b, j]:
                        correct(b, j)
                    elif r:
                        r -= 1
                    else:
                        view[b, j] = value
                        j += 1
                        break
                    j += 1
            if run:
                for j in range(j, se + 1):
                    if view[b, j]:
                        correct(b, j)
                run -= 1


def coefficients(data: bytes) -> Image:
    """Accumulate all scans of a progressive JPEG."""
    image, huffman, restart, at = Image(), {}, 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    ids: list[int] = []
    while True:
        marker, size = data[at + 1], 0
        if marker == 0xD9:
            return image
        (size,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                image.quant[body[k] & 15] = np.frombuffer(body, dtype=">u2" if wide else np.uint8, count=64, offset=k + 1).astype(np.int32)
                k += 129 if wide else 65
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                codes, code, s = {}, 0, k + 17
                for n in range(1, 17):
                    for _ in range(body[k + n]):
                        codes[n, code] = body[s]
                        code, s = code + 1, s + 1
                    code <<= 1
                huffman[body[k] >> 4, body[k] & 15], k = codes, s
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            ids = [body[6 + 3 * c] for c in range(n)]
            image.sampling = [(body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15) for c in range(n)]
            image.tables = [body[8 + 3 * c] for c in range(n)]
            if n == 1:
                image.sampling = [(1, 1)]
            hm, vm = max(h for h, _ in image.sampling), max(v for _, v in image.sampling)
            tall, wide = -(-image.height // (8 * vm)), -(-image.width // (8 * hm))
            image.coefficients = [np.zeros((tall * v, wide * h, 64), dtype=np.int32) for h, v in image.sampling]
        elif marker == 0xDA:
            parts = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k]) for k in range(body[0])]
            ss, se, a = body[-3:]
            end = at
            while True:
                end = data.index(b"\xff", end)
                if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            bits, places, at = _stretches(data[at:end]), image.places([c for c, _ in parts]), end
            if ss == 0:
                _dc(image, places, bits, restart, {c: huffman.get((0, t >> 4), {}) for c, t in parts}, a >> 4, a & 15)
            else:
                c, t = parts[0]
                step = _ac_refine if a >> 4 else _ac_first
                step(image.coefficients[c].reshape(-1, 64), places[0][1].reshape(-1), bits, restart, huffman[1, t & 15], ss, se, a & 15)
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("only progressive Huffman JPEGs are read")


def rgb(image: Image) -> np.ndarray:
    """Full-resolution tensor uint8 (height, width, 3)."""
    hm, vm = max(h for h, _ in image.sampling), max(v for _, v in image.sampling)
    planes, basis = [], _BASIS.astype(np.float32)
    for c, x in enumerate(image.coefficients):
        tall, wide = x.shape[:2]
        natural = np.empty((tall * wide, 64), dtype=np.float32)
        natural[:, ZIGZAG] = x.reshape(-1, 64) * image.quant[image.tables[c]]
        # columns of all blocks in one product, then rows
        cols = (natural.reshape(-1, 8) @ basis).reshape(-1, 8, 8)
        pixels = (cols.transpose(0, 2, 1).reshape(-1, 8) @ basis).reshape(tall, wide, 8, 8).transpose(0, 3, 1, 2).reshape(tall * 8, wide * 8)
        h, v = image.sampling[c]
        if (h, v) != (hm, vm):
            pixels = pixels.repeat(vm // v, axis=0).repeat(hm // h, axis=1)
        planes.append(pixels[: image.height, : image.width])
    if len(planes) == 1:
        out = np.stack([planes[0] + 128] * 3, axis=-1)
    else:
        y, cb, cr = planes
        out = np.stack([y + (128 + 1.402 * cr), y + (128 - 0.344136 * cb - 0.714136 * cr), y + (128 + 1.772 * cb)], axis=-1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def decode_payload(data: bytes) -> tuple[bytes, int, Image]:
    """Payload, unpadded length and coefficients of what ``encode_payload`` made."""
    image = coefficients(data)
    size, n_bytes = struct.unpack(">QQ", image.comment)
    x = np.stack([c.reshape(-1, 64) for c in image.coefficients], axis=1)
    x[:, :, 1:] += np.where(x[:, :, 1:] < 0, 255, 0)
    return x.astype(np.uint8).tobytes()[:size], n_bytes, image


def feature(image: Image) -> str:
    """Size and mean colour of the full-resolution tensor."""
    t = rgb(image)
    means = t.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (t.shape[0] * t.shape[1])
    return f"{t.shape[1]}x{t.shape[0]} " + " ".join(f"{m:.2f}" for m in means)


def _batches(rows: Iterator[tuple], types: list, names: list[str], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH_BYTES; ``size``: the column that has the bytes."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += len(row[size] or b"") + 200
        if total > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media (a progressive JPEG that holds the text's bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for doc_id, text in zip(b.column(0), b.column(1)):
                    data = (text.as_py() or "").encode()
                    yield doc_id.as_py(), encode_payload(padded(data), len(data))

        yield from _batches(rows(), [pa.int64(), pa.binary()], ["doc_id", "media"], 1)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


def decode_tensors(media: DataFrame) -> DataFrame:
    """doc_id, height, width and rgb (row-major 8-bit samples) of a media column; any progressive JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for doc_id, data in zip(b.column(0), b.column(1)):
                    if data.as_py() is None:
                        yield doc_id.as_py(), None, None, None
                    else:
                        t = rgb(coefficients(data.as_py()))
                        yield doc_id.as_py(), t.shape[0], t.shape[1], t.tobytes()

        yield from _batches(rows(), [pa.int64(), pa.int32(), pa.int32(), pa.binary()], ["doc_id", "height", "width", "rgb"], 3)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, height int, width int, rgb binary")


READ_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features from stored media (columns of READ_SCHEMA)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [f.split() for f in READ_SCHEMA.split(", ")]
        for b in batches:
            out = []
            for doc_id, data in zip(b.column(0), b.column(1)):
                data = data.as_py()
                payload, n_bytes, image = decode_payload(data)
                out.append((doc_id.as_py(), n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(image)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if f[1] == "string" else pa.int64()) for c, f in zip(zip(*out), fields)], names=[f[0] for f in fields])

    return media.select("doc_id", "media").mapInArrow(run, READ_SCHEMA)


def read_payloads(media: DataFrame) -> DataFrame:
    """The payload that is read back from stored media, without the pixels and their features: doc_id, n_bytes, payload_bytes, payload_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [decode_payload(data.as_py())[:2] for data in b.column(1)]
            numbers = [pa.array(c, pa.int64()) for c in ([n for _, n in read], [len(p) for p, _ in read])]
            yield pa.RecordBatch.from_arrays([b.column(0), *numbers, pa.array([hashlib.sha256(p).hexdigest() for p, _ in read], pa.string())], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return read_media(materialize(encode_media(docs), "media"))
