"""Image descriptors: decoding, edited copies, and cases without a picture."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import images


def png(grey):
    raw = b"".join(b"\x00" + row.tobytes() for row in grey.astype(np.uint8))
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_decoding():
    grey = np.arange(48).reshape(6, 8).astype(float)
    assert (images.decode(png(grey)) == grey).all() and (images.decode(images.encode(grey)) == grey).all()
    for bad in (None, b"", b"P5 x", b"\x89PNG\r\n\x1a\nrubbish", b"P5 9 9 255\nabc"):
        assert images.decode(bad) is None


def test_more_kinds_of_png():
    """Palettes, 16 bits, few bits, every filter."""
    rng = np.random.default_rng(8)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def made(width, height, depth, kind, raw, *more):
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, 0)) + b"".join(more) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")

    grey = rng.integers(0, 256, (10, 7, 3)).astype(np.uint8)
    rows, above = [], np.zeros(21, np.int64)
    for y, row in enumerate(grey.reshape(10, 21).astype(np.int64)):
        left, corner = np.concatenate([[0] * 3, row[:-3]]), np.concatenate([[0] * 3, above[:-3]])
        guess = left + above - corner
        near = np.stack([abs(guess - left), abs(guess - above), abs(guess - corner)]).argmin(axis=0)
        paeth = np.choose(near, [left, above, corner])
        rows.append(bytes([y % 5]) + ((row - [0 * row, left, above, (left + above) // 2, paeth][y % 5]) & 255).astype(np.uint8).tobytes())
        above = row
    assert (images.decode(made(7, 10, 8, 2, b"".join(rows))) == grey.mean(axis=2)).all()
    assert images.decode(made(3, 1, 2, 3, b"\x00" + bytes([0b00011000]), part(b"PLTE", bytes([0, 0, 0, 30, 30, 30, 90, 0, 0])))).tolist() == [[0, 30, 30]]
    assert images.decode(made(2, 1, 16, 0, b"\x00\x07\xff\x10\x00")).tolist() == [[7, 16]]
    assert images.decode(made(9, 1, 1, 0, b"\x00\xa0\x80")).tolist() == [[255, 0, 255, 0, 0, 0, 0, 0, 255]]
    assert images.decode(made(2, 1, 8, 5, b"\x00ab")) is None


def test_copies_are_found(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = images.copies(spark, vectors).collect()
    asked = vectors.where("vec_id % 50 = 0").count()
    assert sum(r["query_id"] == r["best_id"] for r in got) >= 0.9 * asked and len(got) <= asked
    assert all(r["n_links"] >= 1 and r["class_id"] <= r["best_id"] and r["agreeing"] <= r["of"] for r in got)


def test_clashing_columns(spark):
    """Columns of internal names, and names that differ in case only."""
    rng = np.random.default_rng(1)
    rows = [(n, rng.normal(size=64).tolist(), 1, 2, "x") for n in (0, 50, None)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, image int, digest int, data string")
    clash = frame.select("*", F.lit(9).alias("key"), F.lit(8).alias("corners"), F.lit(7).alias("VEC_ID"))
    assert {r["query_id"]: r["best_id"] for r in images.copies(spark, clash).collect()} == {0: 0, 50: 50}
    empty = images.copies(spark, frame.limit(0))
    assert empty.count() == 0 and empty.columns == ["query_id", "class_id", "n_links", "best_id", "agreeing", "of"]


def test_odd_images(spark):
    rng = np.random.default_rng(1)
    picture = images.draw(rng.normal(size=64).tolist())
    turned = np.rot90(picture)
    rows = [(1, images.encode(picture)), (2, images.encode(picture)), (3, images.encode(turned)), (4, None), (5, b"no image"), (6, images.encode(np.zeros((4, 4)))), (None, images.encode(images.draw(rng.normal(size=64).tolist())))]
    frame = spark.createDataFrame(rows, "image_id bigint, data binary")
    got = {(r["query_id"], r["image_id"], r["copies"]) for r in images.search(frame.where("image_id in (1, 4, 5, 6)"), frame).collect()}
    assert (1, 1, 2) in got and (1, 3, 1) in got and (5, 5, 1) in got and (6, 6, 1) in got
    assert not any(q == 4 or i is None for q, i, _ in got)
    assert images.search(frame.limit(0), frame).count() == 0


def all_pairs(asked, held):
    """Close corners by comparing all bits of all pairs."""
    bits = lambda c: np.unpackbits(c["words"].view(np.uint8).reshape(len(c), 32), axis=1).astype(int)
    a, b = bits(asked), bits(held)
    differ = a.sum(axis=1)[:, None] + b.sum(axis=1)[None] - 2 * a @ b.T
    return set(zip(*(n.tolist() for n in np.nonzero(differ <= images.MOST_BITS)), strict=True))


def test_all_close_corners_meet():
    """Up to MOST_BITS flipped bits, anywhere in the descriptor."""
    rng = np.random.default_rng(2)
    held = np.zeros(700, images.CORNER)
    held["words"] = rng.integers(0, 2**64, (700, 4), np.uint64)
    asked = held[rng.integers(0, 700, 300)].copy()
    raw = asked["words"].copy().view(np.uint8).reshape(300, 32)
    for n in range(300):
        flip = np.zeros(256, np.uint8)
        flip[rng.choice(256, n % 56, replace=False)] = 1
        raw[n] ^= np.packbits(flip)
    asked["words"] = raw.view("<u8")
    got = set(zip(*(n.tolist() for n in images.close(asked, held)), strict=True))
    assert got == all_pairs(asked, held) and len(got) >= 250
    assert len(images.close(asked[:0], held)[0]) == len(images.close(asked, held[:0])[0]) == 0


def test_noisy_copies_are_found(spark):
    """Noise that flips bits in every run of a descriptor."""
    rng = np.random.default_rng(4)
    pictures = [images.draw(rng.normal(size=64).tolist()) for _ in range(12)]
    rows = [(n, images.encode(p)) for n, p in enumerate(pictures)]
    noisy = [(n, images.encode(p + rng.normal(0, 25, p.shape))) for n, p in enumerate(pictures)]
    schema = "image_id bigint, data binary"
    got = {(r["query_id"], r["image_id"]) for r in images.search(spark.createDataFrame(noisy, schema), spark.createDataFrame(rows, schema)).collect()}
    assert got == {(n, n) for n in range(12)}


def test_recall_of_every_edit(spark):
    """search() against all pairs of corners compared bit by bit: what it finds is right, and it finds nine in ten of each kind."""
    rng = np.random.default_rng(6)
    kinds = {name: [lambda p, n, e=edit: e(p, n)] for name, edit in images.EDITS.items()}
    kinds |= {"turned by 10": [lambda p, n: images.rotated(p, 10)], "turned by 30": [lambda p, n: images.rotated(p, 30)], "scale 0.9": [lambda p, n: images.resize(p, 0.9)]}
    pictures = [images.draw(rng.normal(size=64).tolist()) for _ in range(20)]
    schema = "image_id bigint, data binary"
    held = spark.createDataFrame([(n, images.encode(p)) for n, p in enumerate(pictures)], schema)
    edits = {(k * 100 + n): 0.85 * f[0](p, n) + 15 for k, f in enumerate(kinds.values()) for n, p in enumerate(pictures)}
    asked = spark.createDataFrame([(k, images.encode(p)) for k, p in edits.items()], schema)
    got = {(r["query_id"], r["image_id"]) for r in images.search(asked, held).collect()}
    corners = lambda picture: images.describe(images.decode(images.encode(picture)))
    known, want = [corners(p) for p in pictures], set()
    for k, picture in edits.items():
        a = corners(picture)
        for m, b in enumerate(known):
            pairs = np.array(sorted(all_pairs(a, b)), np.int64).reshape(-1, 2)
            if images.agreeing(a, b, pairs[:, 0], pairs[:, 1]) >= images.LEAST:
                want.add((k, m))
    assert got <= want and len(got) >= 0.98 * len(want)
    for k, name in enumerate(kinds):
        assert sum((k * 100 + n, n) in got for n in range(20)) >= 18, name


def test_hot_keys(spark, monkeypatch):
    """Chunks of a few entries give the same result as whole buckets."""
    rng = np.random.default_rng(3)
    base = images.draw(rng.normal(size=64).tolist())
    rows = [(n, images.encode(base + rng.normal(0, 3, base.shape))) for n in range(30)]
    frame = spark.createDataFrame(rows, "image_id bigint, data binary")
    listed = lambda: sorted(images.search(frame.where("image_id % 3 = 0"), frame).collect())
    whole = listed()
    monkeypatch.setattr(images, "CHUNK", 2)
    assert listed() == whole and len(whole) == 300


def test_near_copies_share_rows_of_entries(spark):
    """Near copies that lie together have one row of a key that they share; before, one for each of them."""
    rng = np.random.default_rng(4)
    base = images.draw(rng.normal(size=64).tolist())
    rows = [(n, images.encode(base + rng.normal(0, 2, base.shape))) for n in range(40)]
    frame = spark.createDataFrame(rows, "image_id bigint, data binary").coalesce(1)
    made = images.classes(images.described(frame.withColumnRenamed("image_id", "key"), 12)).coalesce(1)
    q, i = images.tables(made.where("image % 20 = 0"), made)
    number, listed = i.agg({"*": "count"}).first()[0], i.selectExpr("sum(size(images))").first()[0]
    assert i.selectExpr("hkey", "explode(images) as image").distinct().count() == listed
    assert 2 * number < listed and q.selectExpr("max(size(images))").first()[0] == 1
