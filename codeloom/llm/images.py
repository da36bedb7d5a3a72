"""Local image descriptors: finding cropped or edited copies of images.

Images are bytes (PGM, PPM or PNG). At several scales, corners are picked by their Harris
response and placed between pixels; a patch around each is turned to its intensity centroid
and described by binary tests, sampled between pixels too. Each of TABLES tables keys a corner
by KEY_BITS bits from all over its descriptor. Images of which two different corners share
keys are compared corner by corner: two corners meet if at most ``most`` bits differ, each
meeting votes for the rotation, scale and shift it implies, and an image matches if enough
corners agree on one vote.

Bytes are read and described where they lie; only digests, corner records and table entries
travel. Equal images (by SHA-256) form a class, so copies are looked up once. Entries under keys
that no query has go first. A key that very many corners share is dealt out as pairs of chunks of at most CHUNK entries a side, so no task
holds a whole bucket; a task answers with lists a query and block of images, not with a row for
each meeting, and no bucket is cut short.

The tables miss a pair of corners that share no key: with a share p of differing bits that is
(1 - (1 - p) ** KEY_BITS) ** TABLES; an image is lost only if all corners but one are.

Defined results: null or unreadable bytes (JPEG, interlaced PNG, other formats, an empty palette, a height
or width of 0, sizes that don't fit the bytes) are described by nothing, and match only images of equal bytes, null none; images smaller than a patch have no
corners; equal images always match (their class is listed); an image with the same response
everywhere has none either; images of any size are read whole; null keys are kept as any other;
an empty table matches nothing; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .frames import stored, take

HALF, MARGIN = 7, 10
SCALES = (1.0, 0.89, 0.79, 0.7)
MOST_BITS = 48  # of 256 that may differ
LEAST = 8  # agreeing corners of a match; unrelated pictures reach 6 in one pair of a hundred, 8 in one of two thousand
TABLES, KEY_BITS = 14, 34
TOGETHER = 512  # images whose entries of a key travel as one row
CHUNK = 1024  # entries of one key on either side of a task's comparison
BLOCK_BITS = 16  # images of a block, as a power of two
CORNER = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("angle", "<f4"), ("words", "<u8", 4)])
_RNG = np.random.default_rng(5)
_TESTS = np.clip(np.round(_RNG.normal(0, HALF / 2.2, (256, 4))), -HALF, HALF)
_DY, _DX = (a.ravel() for a in np.mgrid[-HALF : HALF + 1, -HALF : HALF + 1])
_DISC = (_DY**2 + _DX**2 <= HALF**2).astype(float)


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """The rows of a PNG without their filters; ``step``: bytes from a value to the one before it."""
    height, width = raw.shape[0], raw.shape[1] - 1
    out, above = np.zeros((height, width), np.uint8), np.zeros(width, np.uint8)
    for y in range(height):
        kind, row = int(raw[y, 0]), raw[y, 1:]
        if kind == 1:
            wide = np.zeros(-(-width // step) * step, np.uint8)
            wide[:width] = row
            row = np.cumsum(wide.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:width]
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            now, up = row.tolist(), above.tolist()
            for x in range(width):
                a, b, c = (now[x - step], up[x], up[x - step]) if x >= step else (0, up[x], 0)
                if kind == 4:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                else:
                    guess = (a + b) // 2
                now[x] = (now[x] + guess) & 255
            row = np.array(now, np.uint8)
        out[y] = above = row
    return out


def _png(data: bytes) -> np.ndarray | None:
    at, body, head, palette = 8, [], None, None
    while at + 8 <= len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"PLTE":
            palette = np.frombuffer(data[at + 8 : at + 8 + size], np.uint8).reshape(-1, 3).mean(axis=1)
        elif kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += size + 12
    if head is None or head[3] not in (0, 2, 3, 4, 6) or head[6] or not head[0] or not head[1] or (head[3] == 3 and (palette is None or not len(palette))):
        return None
    width, height, depth, channels = head[0], head[1], head[2], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    line = -(-width * channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + line)
    rows = _unfiltered(raw, max(1, channels * depth // 8))
    if depth == 16:
        values = rows.reshape(height, -1, 2)[:, :, 0].astype(float)
    elif depth == 8:
        values = rows.astype(float)
    else:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        values = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2)[:, : width * channels].astype(float)
        values = values if head[3] == 3 else values * 255 / (2**depth - 1)
    if head[3] == 3:
        values = palette[np.minimum(values.astype(int), len(palette) - 1)]
    return values.reshape(height, width, channels)[:, :, : 3 if channels > 2 else 1].mean(axis=2)


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of an image, or None."""
    try:
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data and data[:2] in (b"P5", b"P6"):
            kind, width, height, most = data[:64].split(None, 4)[:4]
            head = len(data) - int(width) * int(height) * (3 if kind == b"P6" else 1)
            if most != b"255" or head <= 0 or int(width) < 1 or int(height) < 1:
                return None
            return np.frombuffer(data, np.uint8, offset=head).reshape(int(height), int(width), -1).mean(axis=2)
    except (ValueError, IndexError, TypeError, OverflowError, zlib.error, struct.error):  # what damaged bytes can lead to
        return None
    return None


def encode(image: np.ndarray) -> bytes:
    """A PGM file."""
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + np.clip(np.round(image), 0, 255).astype(np.uint8).tobytes()


def _between(level: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values at places between pixels, bilinear, edges repeated."""
    y, x = np.clip(y, 0, level.shape[0] - 1.001), np.clip(x, 0, level.shape[1] - 1.001)
    y0, x0 = y.astype(np.int64), x.astype(np.int64)
    y, x = y - y0, x - x0
    flat, width, at = level.ravel(), level.shape[1], y0 * level.shape[1] + x0
    return (flat[at] * (1 - x) + flat[at + 1] * x) * (1 - y) + (flat[at + width] * (1 - x) + flat[at + width + 1] * x) * y


def resize(image: np.ndarray, scale: float) -> np.ndarray:
    height, width = (max(1, int(round(n * scale))) for n in image.shape)
    if min(image.shape) < 2:
        return image
    return _between(image.astype(float), ((np.arange(height) + 0.5) / scale - 0.5)[:, None], ((np.arange(width) + 0.5) / scale - 0.5)[None])


def _smooth(image: np.ndarray) -> np.ndarray:
    for axis in (0, 1):
        pad = [(2, 2) if a == axis else (0, 0) for a in (0, 1)]
        p = np.pad(image, pad, mode="edge")
        cut = lambda k: p[k : k + image.shape[0]] if axis == 0 else p[:, k : k + image.shape[1]]  # noqa: B023,E731
        image = (cut(0) + 4 * cut(1) + 6 * cut(2) + 4 * cut(3) + cut(4)) / 16
    return image


def _peak(before: np.ndarray, at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Where a parabola through three responses has its top, from the middle one."""
    bend = before - 2 * at + after
    return np.where(bend < 0, np.clip(0.5 * (before - after) / np.where(bend == 0, 1, bend), -0.5, 0.5), 0)


def describe(image: np.ndarray, corners: int = 12) -> np.ndarray:
    """CORNER records of the strongest corners of each scale, in the image's own pixels; ``corners`` for each 72 x 72 pixels of it."""
    found = [np.zeros(0, CORNER)]
    for scale in SCALES:
        level = _smooth(resize(image, scale) if scale != 1 else image)
        if min(level.shape) <= 2 * MARGIN + 1:
            continue
        gy, gx = np.gradient(level)
        a, b, c = _smooth(gx * gx), _smooth(gy * gy), _smooth(gx * gy)
        response = a * b - c * c - 0.05 * (a + b) ** 2
        inner = response[MARGIN:-MARGIN, MARGIN:-MARGIN]
        around = [response[MARGIN + dy : response.shape[0] - MARGIN + dy, MARGIN + dx : response.shape[1] - MARGIN + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
        ys, xs = np.nonzero((inner > 1.0) & np.logical_and.reduce([inner >= o for o in around]))
        wanted = max(corners, int(corners * image.size / 72**2))
        best = np.argsort(-inner[ys, xs], kind="stable")[:wanted]
        ys, xs = ys[best] + MARGIN, xs[best] + MARGIN
        if not len(ys):
            continue
        y = (ys + _peak(response[ys - 1, xs], response[ys, xs], response[ys + 1, xs]))[:, None]
        x = (xs + _peak(response[ys, xs - 1], response[ys, xs], response[ys, xs + 1]))[:, None]
        patch = _between(level, y + _DY, x + _DX) * _DISC
        angle = np.arctan2((patch * _DY).sum(axis=1), (patch * _DX).sum(axis=1))
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        values = [_between(level, y + sin * _TESTS[None, :, i] + cos * _TESTS[None, :, i + 1], x + cos * _TESTS[None, :, i] - sin * _TESTS[None, :, i + 1]) for i in (0, 2)]
        records = np.zeros(len(ys), CORNER)
        records["x"], records["y"], records["scale"], records["angle"] = (x[:, 0] + 0.5) / scale, (y[:, 0] + 0.5) / scale, scale, angle
        records["words"] = np.packbits(values[0] < values[1], axis=1).view("<u8")
        found.append(records)
    return np.concatenate(found)


def _bits(corners: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(corners["words"]).view(np.uint8).reshape(len(corners), 32), axis=1)


@lru_cache(maxsize=1)
def picked() -> np.ndarray:
    """(TABLES x KEY_BITS) the bits of each table's keys: such as tell little of each other, judged by 48 fixed random pictures.

    Turned patches make many tests alike; of 32 bits drawn blindly, two unrelated corners agree in one of 2**15, of 34 picked so in one of 2**22.
    """
    rng = np.random.default_rng(7)
    bits = _bits(np.concatenate([describe(128 + resize(rng.normal(0, 45, (24, 24)), 3.0)) for _ in range(48)]))
    even = np.flatnonzero(np.abs(bits.mean(axis=0) - 0.5) < 0.25)
    alike = np.corrcoef(bits[:, even].T) ** 2
    tables = np.zeros((TABLES, KEY_BITS), np.int64)
    for table in tables:
        chosen = [int(rng.integers(len(even)))]
        while len(chosen) < KEY_BITS:
            score = alike[:, chosen].sum(axis=1) + 0.1 * rng.random(len(even)) * len(chosen) ** 0.5
            score[chosen] = np.inf
            chosen.append(int(score.argmin()))
        table[:] = even[chosen]
    return tables


def keys(corners: np.ndarray) -> np.ndarray:
    """(corners x TABLES) the key of each corner in each table; keys of different tables differ."""
    bits, chosen = _bits(corners), picked()
    packed = np.zeros((len(corners), TABLES), np.int64)
    for n in range(KEY_BITS):
        packed |= bits[:, chosen[:, n]].astype(np.int64) << n
    return packed | (np.arange(TABLES, dtype=np.int64) << KEY_BITS)


def described(rows: DataFrame, corners: int) -> DataFrame:
    """(key, digest, found, corners) of rows (key, data) that have bytes."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                digests, made = [], []
                for value in part.column("data"):
                    data = value.as_py()
                    grey = decode(data)
                    digests.append(None if data is None else hashlib.sha256(data).digest())
                    made.append(np.zeros(0, CORNER) if grey is None else describe(grey, corners))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(digests, pa.binary()), pa.array([len(m) for m in made], pa.int64()), pa.array([m.tobytes() for m in made], pa.binary())], ["key", "digest", "found", "corners"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, digest binary, found bigint, corners binary").where("digest is not null")


def classes(made: DataFrame) -> DataFrame:
    """(image, digest, key, copies, found, corners): a row for each distinct image, with its least key."""
    once = made.groupBy("digest").agg(F.min("key").alias("key"), F.count("*").alias("copies"), F.any_value("found").alias("found"), F.any_value("corners").alias("corners"))
    return stored(once.withColumn("image", F.monotonically_increasing_id()), "described")


def entries(images: DataFrame, asked: bool) -> DataFrame:
    """(hkey, images, corner): the table entries of each image; only for images asked about a corner is told, and these have an entry a row.

    Other images of up to TOGETHER that lie together and share a key, as near copies do, have one row of it.
    """

    def of(batch):
        names, parts = batch.column("image").to_numpy(), [np.frombuffer(c.as_buffer(), CORNER) if len(c.as_buffer()) else np.zeros(0, CORNER) for c in batch.column("corners")]
        count = np.array([len(p) for p in parts])
        hashed = keys(np.concatenate([np.zeros(0, CORNER), *parts])).ravel()
        image = np.repeat(np.repeat(names, count), TABLES)
        corner = np.repeat(np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in count)]), TABLES) if asked else np.full(len(image), -1)
        ends = np.arange(len(image) + 1)
        if not asked:  # a key that an image has twice counts once
            order = np.lexsort((image, hashed))
            hashed, image = hashed[order], image[order]
            new = np.ones(len(image), bool)
            new[1:] = (hashed[1:] != hashed[:-1]) | (image[1:] != image[:-1])
            hashed, image = hashed[new], image[new]
            first = np.flatnonzero(np.concatenate([[True], hashed[1:] != hashed[:-1]])) if len(hashed) else np.zeros(0, np.int64)
            hashed, corner, ends = hashed[first], corner[: len(first)], np.append(first, len(image))
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(image, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(hashed), listed, pa.array(corner, pa.int32())], ["hkey", "images", "corner"])

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, TOGETHER):
                yield of(batch.slice(low, TOGETHER))

    return images.where("found > 0").select("image", "corners").mapInArrow(run, "hkey bigint, images array<bigint>, corner int")


def tables(asked: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Table entries of both sides; of the images, those under keys that an image asked about has."""
    q = stored(entries(asked, True), "asked_entries")
    return q, stored(entries(images, False).join(q.select("hkey").distinct(), "hkey", "left_semi"), "entries")


def _dealt(q: DataFrame, i: DataFrame) -> DataFrame:
    """Entries of both sides by key and chunk pair: (hkey, qchunk, ichunk, images, corner)."""
    both = q.unionByName(i)
    count = both.groupBy("hkey").agg(F.count_if(F.col("corner") >= 0).alias("nq"), F.sum(F.when(F.col("corner") < 0, F.size("images")).otherwise(0)).alias("ni")).where("nq > 0 and ni > 0")
    chunks = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    told = both.join(stored(count.where(f"nq > {CHUNK} or ni > {CHUNK}").select(F.col("hkey").alias("_hkey"), chunks("nq").alias("qs"), chunks("ni").alias("is")), "hot_keys"), F.col("hkey") == F.col("_hkey"), "left")
    own = F.pmod(F.xxhash64("images", "corner"), F.coalesce(F.when(F.col("corner") >= 0, F.col("qs")).otherwise(F.col("is")), F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.when(F.col("corner") >= 0, F.col("is")).otherwise(F.col("qs")), F.lit(1)) - 1))
    spread = told.select("hkey", "images", "corner", own.alias("own"), other.alias("other"))
    asked = F.col("corner") >= 0
    return spread.select("hkey", F.when(asked, F.col("own")).otherwise(F.col("other")).alias("qchunk"), F.when(asked, F.col("other")).otherwise(F.col("own")).alias("ichunk"), "images", "corner")


def _summed(q: np.ndarray, i: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of images, each once, with the least and the greatest corner of the image asked about that met."""
    order = np.lexsort((i, q))
    q, i, low, high = q[order], i[order], low[order], high[order]
    new = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (i[1:] != i[:-1])])) if len(q) else np.zeros(0, np.int64)
    if not len(new):
        return q, i, low, high
    return q[new], i[new], np.minimum.reduceat(low, new), np.maximum.reduceat(high, new)


def _lists(q: np.ndarray, i: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """A row for each image asked about and block of images, of summed pairs."""
    block = i >> BLOCK_BITS
    new = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (block[1:] != block[:-1])])) if len(q) else np.zeros(0, np.int64)
    ends = pa.array(np.concatenate([new, [len(q)]]), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(v, k)) for v, k in ((i, pa.int64()), (low, pa.int32()), (high, pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array(q[new], pa.int64()), pa.array(block[new], pa.int64()), *lists], ["qimage", "block", "images", "low", "high"])


_LISTS = "qimage bigint, block bigint, images array<bigint>, low array<int>, high array<int>"
_HELD = 1 << 20  # meetings or pairs that a task holds before it sums them up


def meetings(q: DataFrame, i: DataFrame) -> DataFrame:
    """Lists a query image and block of images whose corners share a key, with the least and greatest corner of the query that does."""

    def run(batches):
        held, size, now, mine = [], 0, None, None

        def out():
            return _lists(*_summed(*(np.concatenate([h[k] for h in held]) for k in range(4))))

        for batch in batches:
            number = pc.list_value_length(batch.column("images")).to_numpy()
            image = batch.column("images").flatten().to_numpy()
            hkey, qchunk, ichunk, corner = (np.repeat(batch.column(c).to_numpy(), number) for c in ("hkey", "qchunk", "ichunk", "corner"))
            edge = np.flatnonzero(np.concatenate([[True], (hkey[1:] != hkey[:-1]) | (qchunk[1:] != qchunk[:-1]) | (ichunk[1:] != ichunk[:-1])])) if len(hkey) else np.zeros(0, np.int64)
            asked = np.add.reduceat((corner >= 0).astype(np.int64), edge) if len(edge) else edge
            end = np.concatenate([edge[1:], [len(hkey)]]) if len(edge) else edge
            first = (hkey[0], qchunk[0], ichunk[0]) if len(hkey) else None
            wanted = np.flatnonzero(asked > 0)
            if len(edge) and now == first and mine is not None and (not len(wanted) or wanted[0] != 0):
                wanted = np.concatenate([[0], wanted])
            for n in wanted.tolist():
                at, to, k = int(edge[n]), int(end[n]), int(asked[n])
                name = (hkey[at], qchunk[at], ichunk[at])
                own = (image[at : at + k], corner[at : at + k])
                if n == 0 and now == name and mine is not None:  # began in the batch before
                    own = tuple(np.concatenate([a, b]) for a, b in zip(mine, own, strict=True))
                met = image[at + k : to]
                if n == len(edge) - 1:
                    now, mine = name, own
                for low in range(0, len(met), CHUNK):
                    part = met[low : low + CHUNK]
                    c = np.repeat(own[1], len(part))
                    held.append((np.repeat(own[0], len(part)), np.tile(part, len(own[0])), c, c))
                    size += len(c)
                    if size > _HELD:
                        yield out()
                        held, size = [], 0
            if len(edge) and (not len(wanted) or wanted[-1] != len(edge) - 1):
                now, mine = (hkey[-1], qchunk[-1], ichunk[-1]), None
        if held:
            yield out()

    # images asked about come first in a chunk pair
    sorted_ = _dealt(q, i).repartition("hkey", "qchunk", "ichunk").sortWithinPartitions("hkey", "qchunk", "ichunk", F.col("corner").desc())
    return sorted_.mapInArrow(run, _LISTS)


def candidates(met: DataFrame) -> DataFrame:
    """(qimage, iimage): images of which at least two different corners share keys with a query's."""

    def run(batches):
        name, held, size = None, [], 0

        def summed():
            return _summed(*(np.concatenate([h[k] for h in held]) for k in range(4)))

        def out():
            q, i, low, high = summed()
            keep = low < high
            return pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(i[keep])], ["qimage", "iimage"])

        for batch in batches:
            columns = [batch.column(c) for c in ("qimage", "block", "images", "low", "high")]
            for at in range(batch.num_rows):
                now = (columns[0][at].as_py(), columns[1][at].as_py())
                if now != name and held and size > _HELD // 16:
                    yield out()
                    held, size = [], 0
                images, low, high = (c[at].values.to_numpy() for c in columns[2:])
                name = now
                held.append((np.full(len(images), now[0]), images, low, high))
                size += len(images)
                if size > _HELD:  # sums of one block are at most 2 ** BLOCK_BITS long
                    held = [summed()]
                    size = len(held[0][0])
        if held:
            yield out()

    return met.repartition("qimage", "block").sortWithinPartitions("qimage", "block").mapInArrow(run, "qimage bigint, iimage bigint")


def close(asked: np.ndarray, held: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``asked`` and ``held`` (CORNER records) of all pairs of corners that differ in at most ``most`` bits."""
    differ = np.bitwise_count(asked["words"][:, None] ^ held["words"][None]).sum(axis=2, dtype=np.int64)
    return np.nonzero(differ <= most)


def agreeing(q: np.ndarray, i: np.ndarray, at: np.ndarray, to: np.ndarray) -> int:
    """Corners of ``q`` that agree on one vote, the most for any, of meetings q[at], i[to]."""
    if not len(at):
        return 0
    a, b = ({c: corners[c][n].astype(float) for c in ("x", "y", "scale", "angle")} for corners, n in ((q, at), (i, to)))
    angle, grow = b["angle"] - a["angle"], a["scale"] / b["scale"]
    turn = np.mod(np.round(angle / (np.pi / 6)), 12).astype(np.int64)
    # a corner of the query, turned and grown, must land where the image has it
    x = b["x"] - grow * (np.cos(angle) * a["x"] - np.sin(angle) * a["y"])
    y = b["y"] - grow * (np.sin(angle) * a["x"] + np.cos(angle) * a["y"])
    vote = turn * 8 + np.round(np.log2(grow) * 2).astype(np.int64) + 4
    # each vote counts in the cell it falls in and the next ones, so a cell's border parts no votes
    spot = lambda v, add: np.clip(np.floor(v / 12 + add).astype(np.int64), -(1 << 17), (1 << 17) - 1) + (1 << 17)
    cells = np.concatenate([(vote << 36) + (spot(x, m) << 18) + spot(y, n) for m in (0, 0.5) for n in (0, 0.5)])
    _, group = np.unique(cells, return_inverse=True)
    once = np.unique(group * len(q) + np.tile(at, 4)) // len(q)  # a corner asked about counts once in a cell
    return int(np.bincount(once).max())


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, least: int, most: int) -> DataFrame:
    """(qimage, iimage, agreeing) of the candidate pairs in which at least ``least`` corners agree."""

    def run(batches):
        for batch in batches:
            number = np.zeros(batch.num_rows, np.int64)
            for n in range(batch.num_rows):
                q, i = (np.frombuffer(batch.column(c)[n].as_buffer(), CORNER) for c in ("qcorners", "icorners"))
                number[n] = agreeing(q, i, *close(q, i, most))
            made = pa.RecordBatch.from_arrays([batch.column("qimage"), batch.column("iimage"), pa.array(number)], ["qimage", "iimage", "agreeing"])
            yield made.filter(pa.array(number >= least))

    told = lambda df, p: df.select(F.col("image").alias(f"{p}image"), F.col("corners").alias(f"{p}corners"))
    return pairs.join(told(right, "i"), "iimage").join(told(left, "q"), "qimage").select("qimage", "iimage", "qcorners", "icorners").mapInArrow(run, "qimage bigint, iimage bigint, agreeing bigint")


def search(asked: DataFrame, images: DataFrame, least: int = LEAST, corners: int = 12, most: int = MOST_BITS, data: str = "data", key: str = "image_id") -> DataFrame:
    """(query_id, image_id, copies, agreeing, of): distinct images that share enough agreeing corners with an image asked about.

    An image is told by its least key and the number of its copies; each row asked about is listed. ``agreeing``: corners of
    the query's ``of`` that agree; all of them for equal images.
    """
    rows = stored(described(take(asked, key=key, data=data), corners), "asked")
    left, right = classes(rows), classes(described(take(images, key=key, data=data), corners))
    pairs = candidates(meetings(*tables(left, right)))
    same = left.select("digest", F.col("image").alias("qimage"), F.col("found").alias("agreeing")).join(right.select("digest", F.col("image").alias("iimage")), "digest").select("qimage", "iimage", "agreeing")
    matched = verified(pairs, left, right, least, most).join(same, ["qimage", "iimage"], "left_anti").unionByName(same)
    query = left.select(F.col("image").alias("qimage"), "digest").join(rows.select("digest", F.col("key").alias("query_id"), F.col("found").alias("of")), "digest").drop("digest")
    image = right.select(F.col("image").alias("iimage"), F.col("key").alias(key), "copies")
    return matched.join(image, "iimage").join(query, "qimage").select("query_id", key, "copies", "agreeing", "of")


@lru_cache(maxsize=4)
def _textures(n: int, size: int) -> np.ndarray:
    """n fixed textures, laid out flat."""
    rng = np.random.default_rng(n)
    return np.stack([resize(rng.normal(size=(size // 3, size // 3)), 3.0).ravel() for _ in range(n)])


def draw(vector: list[float], size: int = 72) -> np.ndarray:
    """A picture that depends on every number of a vector: textures laid over each other in its proportions."""
    v = np.asarray(vector, float)
    picture = v @ _textures(len(v), size)
    return 128 + 45 * (picture / (picture.std() or 1)).reshape(size, size)


def rotated(picture: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about its middle, edges repeated."""
    (height, width), t = picture.shape, np.deg2rad(degrees)
    y, x = np.mgrid[:height, :width] - np.array([(height - 1) / 2, (width - 1) / 2])[:, None, None]
    return _between(picture, np.cos(t) * y - np.sin(t) * x + (height - 1) / 2, np.cos(t) * x + np.sin(t) * y + (width - 1) / 2)


#: Edits of the query's pictures; an edit and a number make the picture that is asked about.
EDITS = {
    "shift": lambda p, n: p[n % 5 : len(p) - 4 + n % 5, 4 - n % 5 : len(p) - n % 5],
    "half": lambda p, n: (p[1:, 1:] + p[:-1, 1:] + p[1:, :-1] + p[:-1, :-1]) / 4,
    "crop": lambda p, n: p[: -(len(p) // 4), len(p) // 4 :],
    "rotate": lambda p, n: rotated(p, 5 + 7 * (n % 13)),
    "shrink": lambda p, n: resize(p, 0.8 + 0.1 * (n % 2)),
    "grow": lambda p, n: resize(p, 1.25),
    "noise": lambda p, n: p + np.random.default_rng(n).normal(0, 20, p.shape),
}


def edited(picture: np.ndarray, number: int) -> np.ndarray:
    """A shift, crop, turn, change of size or noise, as ``number`` tells, with changed brightness and contrast."""
    return 0.85 * list(EDITS.values())[number % len(EDITS)](picture, number // len(EDITS)) + 15


def drawn(vectors: DataFrame, change: bool = False) -> DataFrame:
    """(image_id, data): a picture of each row of (vec_id, embedding), edited if asked for."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                part, data = batch.slice(low, 128), []
                for number, vector in zip(part.column("vec_id").to_pylist(), part.column("embedding").to_pylist(), strict=True):
                    picture = None if vector is None else draw(vector)
                    data.append(None if picture is None else encode(edited(picture, number // 50 if number is not None else 0) if change else picture))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(data, pa.binary())], ["image_id", "data"])

    return take(vectors, vec_id="vec_id", embedding="embedding").mapInArrow(run, "image_id bigint, data binary")


def found(pairs: DataFrame, key: str = "image_id") -> DataFrame:
    """A row for each image asked about that was found at all: (query_id, class_id, n_links, best_id, agreeing, of).

    class_id: least id of its matches; n_links: matching images, copies included; best_id: the match with the most agreeing
    corners, the least id of several.
    """
    best = F.min_by(key, F.struct(-F.col("agreeing"), F.col(key)))
    return pairs.groupBy("query_id").agg(F.min(key).alias("class_id"), F.sum("copies").alias("n_links"), best.alias("best_id"), F.max("agreeing").alias("agreeing"), F.max("of").alias("of"))


def copies(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """Edited pictures of every row whose id is divisible by 50, searched for among the pictures of all rows: ``found``.

    One row a query, as a group of near copies has a match for each pair of a query and an image of it; ``search`` lists them.
    """
    rows = take(vectors, vec_id="vec_id", embedding="embedding")
    return found(search(drawn(rows.where("vec_id % 50 = 0"), change=True), drawn(rows)))
