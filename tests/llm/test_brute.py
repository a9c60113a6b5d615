"""Media and HTML queries against slow versions written another way: one pixel and one tag at a time."""

import io
import re
import struct
from fractions import Fraction
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pytest

from vexel.llm import html, media, queries

SF = "/root/testdata/sf0.001"


# --- images


def slow_netpbm(data):
    kind = int(data[1:2])
    stream = io.BytesIO(data[2:])

    def number():
        digits = b""
        while True:
            c = stream.read(1)
            if c == b"#":
                while c not in b"\r\n":
                    c = stream.read(1)
            elif c.isdigit():
                digits += c
            elif digits:
                return int(digits)
            elif not c:
                raise EOFError

    width, height = number(), number()
    most = 1 if kind in (1, 4) else number()
    depth = 3 if kind in (3, 6) else 1
    out = np.zeros((height, width, depth), np.uint8)
    for i in range(height):
        if kind == 4:
            bits = "".join(f"{b:08b}" for b in stream.read((width + 7) // 8))
        for j in range(width):
            for c in range(depth):
                if kind == 1:
                    b = b" "
                    while b not in (b"0", b"1"):
                        b = stream.read(1)
                    v = 1 - int(b)
                elif kind == 4:
                    v = 1 - int(bits[j])
                elif kind in (2, 3):
                    v = number()
                else:
                    v = int.from_bytes(stream.read(1 if most < 256 else 2), "big")
                out[i, j, c] = int(Fraction(v * 255, most) + Fraction(1, 2))
    return out if depth == 3 else out[:, :, 0]


def slow_bmp(data):
    start = int.from_bytes(data[10:14], "little")
    size, width, height = struct.unpack_from("<Iii", data, 14)
    bits = int.from_bytes(data[28:30], "little")
    stride = -(-width * bits // 32) * 4
    out = np.zeros((abs(height), width, 3), np.uint8)
    for i in range(abs(height)):
        row = data[start + i * stride : start + (i + 1) * stride]
        for j in range(width):
            if bits >= 24:
                blue, green, red = row[j * bits // 8 : j * bits // 8 + 3]
            else:
                k = row[j * bits // 8] >> (8 - bits - j * bits % 8) & ((1 << bits) - 1)
                blue, green, red = data[14 + size + 4 * k : 14 + size + 4 * k + 3]
            out[i if height < 0 else abs(height) - 1 - i, j] = (red, green, blue)
    return out


def slow_mean(image, height, width):
    """The exact mean over each target pixel's area."""

    def shares(n, m):
        for k in range(m):
            lo, hi = Fraction(k * n, m), Fraction((k + 1) * n, m)
            yield [(i, min(hi, i + 1) - max(lo, i)) for i in range(int(lo), -(-hi.numerator // hi.denominator))]

    rows, columns = list(shares(image.shape[0], height)), list(shares(image.shape[1], width))
    return [[sum(int(image[i, j]) * a * b for i, a in r for j, b in c) / (sum(a for _, a in r) * sum(b for _, b in c)) for c in columns] for r in rows]


def slow_hash(image):
    grey = image if image.ndim == 2 else None
    if grey is None:
        planes = [slow_mean(image[:, :, c], 8, 9) for c in range(3)]
        mean = [[Fraction(299, 1000) * planes[0][i][j] + Fraction(587, 1000) * planes[1][i][j] + Fraction(114, 1000) * planes[2][i][j] for j in range(9)] for i in range(8)]
    else:
        mean = slow_mean(grey, 8, 9)
    mean = [[round(float(x), 6) for x in r] for r in mean]
    bits = "".join("1" if r[j] < r[j + 1] else "0" for r in mean for j in range(8))
    return int(bits, 2) - (1 << 64 if bits[0] == "1" else 0)


def check(data, height, width, image, tile, dhash, size):
    want = slow_bmp(data) if data[:2] == b"BM" else slow_netpbm(data)
    assert (height, width) == want.shape[:2] and (image is None or (image == want).all())
    got = np.load(io.BytesIO(tile))
    assert got.dtype == np.uint8 and got.shape == (size, size, *want.shape[2:])
    for c in range(3 if want.ndim == 3 else 1):
        exact = np.array(slow_mean(want if want.ndim == 2 else want[:, :, c], size, size), dtype=float)
        plane = got if want.ndim == 2 else got[:, :, c]
        assert (np.abs(plane - exact) <= 0.5 + 1e-6).all()
    assert dhash == slow_hash(want)


def pictures():
    rng = np.random.default_rng(7)
    out = []
    for w, h in ((1, 1), (7, 5), (9, 12), (33, 3)):
        bits = rng.integers(0, 2, (h, w))
        out.append(f"P1\n# a remark\n{w} {h}\n".encode() + b"\n".join(b"".join(b"%d" % x for x in r) for r in bits))
        out.append(f"P4 {w} {h}\n".encode() + np.packbits(bits.astype(np.uint8), axis=1).tobytes())
        for most in (1, 100, 255, 256, 65535):
            for depth in (1, 3):
                v = rng.integers(0, most + 1, (h, w * depth))
                out.append(f"P{1 + depth // 2 + 1}\n{w} {h} # x\n{most}\n".encode() + b"\n".join(b" ".join(b"%d" % x for x in r) for r in v))
                out.append(f"P{5 + depth // 2} {w}\t{h} {most}\n".encode() + v.astype(">u1" if most < 256 else ">u2").tobytes())
        for depth in (1, 4, 8, 24, 32):
            for down in (False, True):
                palette = rng.integers(0, 256, (1 << depth if depth < 9 else 0) * 4).astype(np.uint8).tobytes()
                stride = -(-w * depth // 32) * 4
                body = rng.integers(0, 256, h * stride).astype(np.uint8).tobytes()
                out.append(struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, 54 + len(palette), 40, w, -h if down else h, 1, depth, 0, 0, 0, 0, 0, 0) + palette + body)
    return out


def test_all_formats_by_slow_decoders(spark):
    data = pictures()
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "media_id long, media binary")
    for r in media.media_tiles(df, tile=5).collect():
        d = data[r["media_id"]]
        assert r["error"] is None, (d[:20], r["error"])
        check(d, r["height"], r["width"], media.decode(d)[1], r["tile"], r["dhash"], 5)


def test_media_query_by_slow_versions(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = {r["media_id"]: bytes(r["media"]) for r in media.embedding_images(rows).collect()}
    got = queries.op2_media_tiles(spark, SF).collect()
    assert sorted(r["media_id"] for r in got) == sorted(data) and all(r["error"] is None for r in got)
    for r in got:
        if r["media_id"] % 5 < 2:
            check(data[r["media_id"]], r["height"], r["width"], None, r["tile"], r["dhash"], media.TILE)


def test_tiles_are_written_and_null_vectors_have_no_image(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.0, 1.0, 2.0]), (None, [1.0]), (3, None), (4, []), (5, [None, float("nan")]), (1, [0.0, 1.0, 2.0])], "vec_id long, embedding array<double>")
    images = media.embedding_images(rows)
    assert sorted(str(r["media_id"]) for r in images.filter("media is null").collect()) == ["3", "4", "5"] and images.count() == 6
    media.write_tiles(media.media_tiles(images), str(tmp_path / "tiles"))
    back = spark.read.parquet(str(tmp_path / "tiles")).collect()
    assert len(back) == 3 and all(np.load(io.BytesIO(r["tile"])).shape[:2] == (media.TILE, media.TILE) for r in back)


# --- pages


class Walk(HTMLParser):
    """Blocks of a well-formed page, one event at a time."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.linked, self.link, self.hidden = [], "", 0, False, []

    def cut(self):
        text = " ".join(self.text.split())
        if text:
            self.out.append((text, min(self.linked, len(text))))
        self.text, self.linked = "", 0

    def tag(self, name, opens):
        if name in ("script", "style", "noscript", "template", "svg", "math", "iframe", "head", "select"):
            if opens:
                if name in ("head", "select"):
                    self.cut()
                self.hidden.append(name)
            elif name in self.hidden:
                self.hidden.remove(name)
                if name in ("head", "select") and not self.hidden:
                    self.cut()
        elif self.hidden:
            pass
        elif name == "a":
            self.link = opens
        elif name in html.BLOCK:
            self.cut()
            if name not in ("br", "div"):
                self.link = False

    def handle_starttag(self, name, attrs):
        self.tag(name, True)

    def handle_endtag(self, name):
        self.tag(name, False)

    def handle_startendtag(self, name, attrs):
        self.tag(name, True)

    def handle_data(self, data):
        if not self.hidden:
            self.text += data
            if self.link:
                self.linked += len(" ".join(data.split()))


def slow_text(page):
    walk = Walk()
    walk.feed(page)
    walk.close()
    walk.cut()
    found = walk.out
    few = lambda t: sum(w in html.STOP for w in re.findall(r"\w+", t.lower())) < 0.1 * max(1, len(re.findall(r"\w+", t.lower())))
    labels = []
    for text, linked in found:
        if "©" in text or linked > 0.2 * len(text) or len(text) < 70 and linked:
            labels.append("bad")
        elif len(text) < 70:
            labels.append("?")
        else:
            labels.append("bad" if few(text) else "good")
    if "good" not in labels:
        new = []
        for kind, run in groupby(range(len(found)), key=lambda i: labels[i]):
            run = list(run)
            joined = " ".join(found[i][0] for i in run)
            # Once a run is good, later runs keep their labels.
            if kind == "?" and len(joined) >= 70:
                kind = "bad" if few(joined) else "good"
            new += [kind] * len(run)
        labels = new
    decided = [i for i, x in enumerate(labels) if x != "?"]
    kept = []
    for i, (text, _) in enumerate(found):
        near = min(decided, key=lambda j: (abs(i - j), j), default=None)
        if near is not None and labels[near] == "good":
            kept.append(text)
    return "\n".join(kept), len(found), len(kept)


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_html_query_by_a_slow_version(spark, folder):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = {r["page_id"]: (r["text"], r["n_blocks"], r["n_good"]) for r in queries.op10_html_extraction(spark, folder).collect()}
    assert got == {i: slow_text(p) for i, p in pages.items()}
    assert sum(n > 0 for *_, n in got.values()) > 0.9 * len(got)


def test_many_long_pages_and_texts(spark):
    para = "This is the text of an article that was written for the readers of the page and it is as long as it has to be. "
    page = "<p>" + para * 1500 + "</p>"
    got = html.extract(spark.createDataFrame([(i, "u", page) for i in range(300)], "page_id long, url string, html string")).collect()
    assert len(got) == 300 and {r["text"] for r in got} == {" ".join((para * 1500).split())}
