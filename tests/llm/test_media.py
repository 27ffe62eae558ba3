"""Progressive JPEG: exact round trips, and a bitwise encoder of other scan scripts against the decoder."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from graphloom.llm import media

from .helpers import edge_documents, save_documents


def check(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    rows = media.op5_media(spark, folder).collect()
    wanted, seen = [], {}
    for d in docs:
        data = (d.text or "").encode()
        payload = data + b" " * ((-len(data)) % 192 or (0 if data else 192))
        wanted.append((d.doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows), key=str) == sorted(wanted, key=str)
    for r in rows:
        assert seen.setdefault(r.payload_sha256 + str(r.n_bytes), (r.media_sha256, r.media_bytes, r.feature)) == (r.media_sha256, r.media_bytes, r.feature)
        assert r.media_bytes > r.payload_bytes and r.feature


def test_all(spark, sf_dir):
    check(spark, sf_dir)


def test_edges(spark, tmp_path):
    check(spark, save_documents(edge_documents(spark), tmp_path))


def test_empty(spark, tmp_path):
    assert media.op5_media(spark, save_documents(edge_documents(spark).limit(0), tmp_path)).count() == 0


@pytest.mark.parametrize("blocks", [1, 2, 255, 256, 257, 700])
def test_every_byte_value_and_shape(blocks):
    payload = np.random.default_rng(blocks).integers(0, 256, blocks * 192).astype(np.uint8).tobytes()
    got, n, image = media.decode_payload(media.encode_payload(payload, 5))
    assert got == payload and n == 5
    assert media.rgb(image).shape == (image.height, image.width, 3)


def test_runs_beyond_one_symbol():
    payload = bytes(range(192)) * 40_000
    assert media.decode_payload(media.encode_payload(payload, 1))[0] == payload


class Writer:
    """Plain bit-by-bit progressive scans with 8-bit codes."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def number(self, v):
        s = abs(v).bit_length()
        return s, (v if v > 0 else v + (1 << s) - 1)

    def data(self):
        return media._stuffed(np.array([int(b) for b in self.bits], dtype=np.uint8))


def reference_jpeg(coefs, sampling, height, width):
    """Scans: DC interleaved at Al=1 and refined; AC 1-5 and 6-63 at Al=1 with runs, then refined."""
    symbols = [*range(0, 12)], sorted({r << 4 | s for r in range(16) for s in range(0, 11)})
    out = [b"\xff\xd8", media._segment(0xDB, bytes([0]) + bytes(range(1, 65)))]
    frame = np.array([8, height >> 8, height & 255, width >> 8, width & 255, len(coefs)], dtype=np.uint8).tobytes()
    out.append(media._segment(0xC2, frame + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling))))
    for kind in (0, 1):
        out.append(media._table(kind, symbols[kind], 8))
    code = [{s: k for k, s in enumerate(symbols[kind])} for kind in (0, 1)]
    parts = list(range(len(coefs)))
    image = media.Image(height=height, width=width, sampling=sampling, coefficients=coefs)
    places = image.places(parts)
    for ah, al in ((0, 1), (1, 0)):
        w, last = Writer(), [0] * len(coefs)
        for m in range(len(places[0][1])):
            for c, p in places:
                for b in p[m]:
                    v = int(coefs[c].reshape(-1, 64)[b, 0]) >> al
                    if ah:
                        w.put(v & 1, 1)
                    else:
                        s, raw = w.number(v - last[c])
                        w.put(code[0][s], 8)
                        w.put(raw, s)
                        last[c] = v
        out.append(media._scan(parts, 0, 0, ah, al, w.data()))
    for ah, al in ((0, 1), (1, 0)):
        for ss, se in ((1, 5), (6, 63)):
            for c in parts:
                w, view = Writer(), coefs[c].reshape(-1, 64)
                run, pending = 0, []

                def flush():
                    nonlocal run, pending
                    if run:
                        r = run.bit_length() - 1
                        w.put(code[1][r << 4], 8)
                        w.put(run - (1 << r), r)
                        for x in pending:
                            w.put(x, 1)
                    run, pending = 0, []

                for b in image.places([c])[0][1].reshape(-1):
                    mag = [abs(int(v)) >> al for v in view[b]]
                    zeros, held = 0, []
                    new = [k for k in range(ss, se + 1) if (mag[k] if not ah else mag[k] == 1)]
                    for k in range(ss, (new[-1] if new else ss - 1) + 1):
                        if ah and mag[k] > 1:
                            held.append(mag[k] & 1)
                        elif not mag[k]:
                            zeros += 1
                            if zeros == 16:
                                flush()
                                w.put(code[1][0xF0], 8)
                                for x in held:
                                    w.put(x, 1)
                                zeros, held = 0, []
                        else:
                            flush()
                            if ah:
                                w.put(code[1][zeros << 4 | 1], 8)
                                w.put(int(view[b, k] > 0), 1)
                                for x in held:
                                    w.put(x, 1)
                            else:
                                s, raw = w.number(mag[k] if view[b, k] > 0 else -mag[k])
                                w.put(code[1][zeros << 4 | s], 8)
                                w.put(raw, s)
                            zeros, held = 0, []
                    if not new or new[-1] < se:
                        run += 1
                        pending += held + ([mag[k] & 1 for k in range((new[-1] if new else ss - 1) + 1, se + 1) if ah and mag[k] > 1])
                flush()
                out.append(media._scan([c], ss, se, ah, al, w.data()))
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
def test_other_scan_scripts(sampling):
    rng = random.Random(str(sampling))
    height, width = 37, 45
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    tall, wide = -(-height // (8 * vm)), -(-width // (8 * hm))
    coefs = []
    for h, v in sampling:
        x = np.zeros((tall * v, wide * h, 64), dtype=np.int32)
        x[:, :, 0] = np.random.default_rng(1).integers(-500, 500, x.shape[:2])
        coefs.append(x)
    image = media.Image(height=height, width=width, sampling=sampling, coefficients=coefs)
    for c, x in enumerate(coefs):  # only blocks that a component's own scans have
        for b in image.places([c])[0][1].reshape(-1):
            for _ in range(rng.choice([0, 0, 1, 3, 12, 40])):
                x.reshape(-1, 64)[b, rng.randrange(1, 64)] = rng.choice([1, -1, 2, -2, 3, -3, 5, 17, -200])
    got = media.coefficients(reference_jpeg(coefs, sampling, height, width))
    for a, b in zip(got.coefficients, coefs):
        assert (a == b).all()
    assert media.rgb(got).shape == (height, width, 3)


def test_inverse_transform_and_colour():
    image = media.Image(8, 8, [(1, 1)] * 3, [0] * 3, {0: np.ones(64, dtype=np.int32)}, [np.zeros((1, 1, 64), dtype=np.int32) for _ in range(3)])
    assert (media.rgb(image) == 128).all()
    x = np.random.default_rng(3).integers(-60, 60, (8, 8))
    image.coefficients[0][0, 0] = np.rint(media._BASIS @ x @ media._BASIS.T * 1).astype(int).reshape(-1)[media.ZIGZAG]
    assert np.abs(media.rgb(image)[:, :, 0].astype(int) - 128 - x).max() <= 3
    image.coefficients[0][0, 0] = 0
    image.coefficients[2][0, 0, 0] = 400  # 50 in every pixel of Cr
    assert media.rgb(image)[0, 0].tolist() == [198, 92, 128]


def test_tensors_of_a_media_column(spark):
    """Stored tensors are the full-resolution pixels of each image; null media have none."""
    docs = spark.createDataFrame([(1, "a" * 500), (2, ""), (None, None), (2, "été " * 300)], "doc_id long, text string")
    stored = media.encode_media(docs)
    rows = media.decode_tensors(stored.union(spark.createDataFrame([(9, None)], "doc_id long, media binary"))).collect()
    want = [media.rgb(media.coefficients(bytes(r.media))) for r in stored.collect()]
    assert [(r.height, r.width, bytes(r.rgb)) for r in rows[:-1]] == [(*t.shape[:2], t.tobytes()) for t in want]
    assert rows[-1].asDict() == {"doc_id": 9, "height": None, "width": None, "rgb": None}


def test_very_long_payloads_have_a_grid():
    for n in (1, 255, 256, 257, 8191 * 256, 8191 * 256 + 1, 10**7, 8191 * 8191):
        rows, wide = media.grid(n)
        assert rows * wide >= n and rows * wide - n < rows and rows * 8 <= 65535 and wide * 8 <= 65535


def test_payloads_are_read_back_without_pixels(spark, monkeypatch):
    from graphloom.llm import media as M, queries as Q

    d = "/root/testdata/sf0.001"
    key = lambda df: sorted(map(tuple, df.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256").collect()))
    wanted = key(M.op5_media(spark, d))
    monkeypatch.setattr(M, "feature", None)
    assert key(Q.media_payloads(spark, d)) == wanted
