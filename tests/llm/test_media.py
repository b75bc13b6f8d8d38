import hashlib
import zlib

import numpy as np
import pytest

from querent.llm import jpeg, media


def test_zigzag_starts_as_known():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG.tolist()) == list(range(64))


@pytest.mark.parametrize("blocks", [1, 5, 6, 7, 100])
def test_round_trip(blocks):
    rng = np.random.default_rng(blocks)
    payload = rng.integers(0, 256, blocks * 64, dtype=np.uint8).tobytes()
    data = jpeg.encode(payload)
    coefs, frame = jpeg.decode_coefficients(data)
    assert jpeg.payload_of(coefs, frame) == payload
    rgb = jpeg.rgb_of(coefs, frame)
    assert rgb.shape == (frame["height"], frame["width"], 3) and rgb.dtype == np.uint8
    assert data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9"


def test_many_block_runs():
    payload = bytes(range(256)) * 140_000  # more blocks than one end-of-band run
    coefs, frame = jpeg.decode_coefficients(jpeg.encode(payload))
    assert jpeg.payload_of(coefs, frame) == payload


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [value >> i & 1 for i in range(width - 1, -1, -1)]


def general_image(coef):
    """A one-MCU image with zeros, runs and end-of-band runs, in the general form of the scans."""
    symbols = [*range(0, 256)][:250]
    table = jpeg._table(1, 0, symbols, 8)
    out = [b"\xff\xd8", jpeg._segment(0xDB, bytes([0] + [1] * 64)), jpeg._segment(0xC2, bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), table]
    data = {}
    for step, (high, low) in enumerate(((0, 1), (1, 0))):
        for comp in range(3):
            w = Writer()
            for row in coef[comp]:
                k, run, pending = 1, 0, []
                part = np.sign(row) * (np.abs(row) >> low)
                if step == 0:
                    last = max([i for i in range(1, 64) if part[i]], default=0)
                    while k <= last:
                        v = int(part[k])
                        if v == 0:
                            run += 1
                        else:
                            while run > 15:
                                w.put(symbols.index(0xF0), 8)
                                run -= 16
                            size = abs(v).bit_length()
                            w.put(symbols.index(run << 4 | size), 8)
                            w.put(v if v > 0 else v + (1 << size) - 1, size)
                            run = 0
                        k += 1
                    if last < 63:
                        w.put(symbols.index(0), 8)
                else:
                    old = np.sign(row) * (np.abs(row) >> 1)
                    new = [i for i in range(1, 64) if part[i] and not old[i]]
                    last = max(new, default=0)
                    while k <= last:
                        if old[k]:
                            pending.append(int(abs(row[k])) & 1)
                        elif k in new:
                            w.put(symbols.index(run << 4 | 1), 8)
                            w.put(int(row[k] > 0), 1)
                            for b in pending:
                                w.put(b, 1)
                            run, pending = 0, []
                        else:
                            run += 1
                            if run == 16:
                                w.put(symbols.index(0xF0), 8)
                                for b in pending:
                                    w.put(b, 1)
                                run, pending = 0, []
                        k += 1
                    pending += [int(abs(row[i])) & 1 for i in range(last + 1, 64) if old[i]]
                    w.put(symbols.index(0), 8)
                    for b in pending:
                        w.put(b, 1)
            data[step, comp] = jpeg._scan([(comp + 1, 0, 0)], (1, 63), high, low, jpeg._stuffed(np.array(w.bits, np.uint8)))
    return b"".join([*out, *data.values(), b"\xff\xd9"])


def test_general_scans():
    """Coefficients with zeros and both signs go the decoder's general way."""
    rng = np.random.default_rng(8)
    coef = [np.where(rng.random((n, 64)) < 0.3, rng.integers(-60, 61, (n, 64)), 0) for n in (4, 1, 1)]
    for c in coef:
        c[:, 0] = 0
        c[:, 14:18] = 0
    got, _ = jpeg.decode_coefficients(general_image(coef))
    for a, b in zip(got, coef, strict=True):
        assert (a == b).all()


def test_flat_image_is_flat():
    coefs = [np.zeros((4, 64), np.int64), np.zeros((1, 64), np.int64), np.zeros((1, 64), np.int64)]
    frame = {"rows": 1, "cols": 1, "height": 16, "width": 16, "quant": {0: np.ones(64, np.uint8)}}
    assert (jpeg.rgb_of(coefs, frame) == 128).all()
    coefs[0][:, 0] = 80  # a DC of 80 lifts samples by 10
    assert (jpeg.rgb_of(coefs, frame) == 138).all()


def test_queries_values(docs, rows, empty):
    out = {r.doc_id: r for r in media.digest(media.store(docs)).collect()}
    texts = dict(rows)
    assert set(out) == set(texts)
    for d, r in out.items():
        raw = (texts[d] or "").encode()
        p = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert media.digest(media.store(empty)).count() == 0
    one = media.tensors(media.store(docs.filter("doc_id = 3"))).first()
    assert len(one.rgb) == one.height * one.width * 3 and bytes(one.payload).rstrip(b"\0") == texts[3].encode()


def test_repeated_rows_and_null_ids(spark):
    from querent.llm import media

    rows = [(1, "same", "k"), (1, "same", "k"), (None, "same", "k"), (2, None, None), (2, "", "k"), (3, "x" * 70_000, "k")]
    out = media.digest(media.store(spark.createDataFrame(rows, "doc_id long, text string, media string"))).collect()
    own = {(r.doc_id, r.n_bytes): tuple(r)[1:] for r in out}
    assert len(out) == 6 and len({tuple(r)[1:] for r in out if r.n_bytes == 4}) == 1
    assert len({tuple(r)[1:] for r in out if r.doc_id == 2}) == 1 and own[2, 0][1] == 64 and own[3, 70_000][1] == 70_016
