"""Join of texts whose sets of word n-grams have Jaccard similarity of at least a threshold.

Equal sets form a class first. Classes whose MinHash values agree on a whole band of the
signature are candidates. Inside a bucket of candidates the values of two classes are
compared a few at a time; the pair is dropped as soon as the posterior probability that it
reaches the threshold, given the agreements so far, falls below a tolerance. What survives
is verified exactly. Each pair is judged in the first bucket that both share.

Large buckets are dealt out as pairs of bounded chunks, so no task holds a whole bucket,
and a task returns counts and a spanning forest, not its pairs. Groups are the connected
components of the links, found by joins of tables; nothing is collected to the driver.

Defined results: null text counts as empty; a text of fewer than n words has the one n-gram
of all its words; a text without words is in a class of its own and has no links; rows with
equal texts are in one class and linked with each other; null and repeated keys are kept as
any others; texts of any length are worked on whole, with memory of about ten times the longest;
an empty table gives an empty result; columns may have any names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import meet, place, restore, slices, stored, take, utf8
from .hashing import mix, range_hashes, window_hashes, word_hashes, words

BANDS, ROWS = 28, 4
#: Signature positions that are compared before the next look at the posterior.
STEP = 16


@lru_cache(maxsize=1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return (seeds[: BANDS * ROWS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[BANDS * ROWS :] >> np.uint64(32)).astype(np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-grams of each text."""
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    wide = window_hashes(hashes, n)
    whole = range_hashes(hashes, first[:-1], first[1:])
    out = []
    for i in range(len(offsets) - 1):
        a, b = int(first[i]), int(first[i + 1])
        out.append(np.unique(wide[a : b - n + 1]) if b - a >= n else whole[i : i + (b > a)])
    return out


def signature(grams: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHash values of a set of hashes."""
    a, b = _multipliers()
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(short), 2048):
        part = short[at : at + 2048, None] * a
        part += b
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        part ^= part >> np.uint32(12)
        np.minimum(low, part.min(axis=0), out=low)
    return low


def bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit value for each band of signatures (rows)."""
    out = np.zeros((len(values), BANDS), np.uint64)
    parts = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
    for i in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i] + np.uint64(1))
    return out


@lru_cache(maxsize=8)
def least_agreements(threshold: float, tolerance: float) -> np.ndarray:
    """m -> the fewest agreements among m values that leave the pair alive.

    With a uniform prior the similarity given k of m agreements is Beta(k + 1, m - k + 1);
    its tail above the threshold is the binomial sum P(Bin(m + 1, threshold) <= k).
    """
    least = np.zeros(BANDS * ROWS + 1, np.int64)
    for m in range(STEP, BANDS * ROWS + 1, STEP):
        mass = np.zeros(m + 2)
        mass[0] = 1.0
        for _ in range(m + 1):
            mass[1:] = mass[1:] * (1 - threshold) + mass[:-1] * threshold
            mass[0] *= 1 - threshold
        least[m] = int(np.searchsorted(np.cumsum(mass), tolerance))
    return least


def alive(left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which rows of two signature matrices survive the incremental comparison."""
    least = least_agreements(threshold, tolerance)
    index, agree = np.arange(len(left)), np.zeros(len(left), np.int64)
    for at in range(0, BANDS * ROWS, STEP):
        agree += (left[index, at : at + STEP] == right[index, at : at + STEP]).sum(axis=1)
        keep = agree >= least[at + STEP]
        index, agree = index[keep], agree[keep]
    return index


def hashed(taken: DataFrame) -> DataFrame:
    return taken.withColumn("text", F.col("text").cast("string")).withColumn("h", F.xxhash64("text"))


def classes(docs: DataFrame, n: int, text: str, key: str) -> DataFrame:
    """(key, h, c1, c2, grams, bands): a hash of each row's text, the 128-bit name of its n-gram set, its size and band values."""
    narrow = hashed(take(docs, key=key, text=text))

    def run(batches):
        for batch in batches:
            for low, high in slices(batch.column("text")):
                part = batch.slice(low, high - low)
                sets = shingles(*utf8(part.column("text")), n)
                names = [name(s) for s in sets]
                sign = bands(np.stack([signature(s) for s in sets]))
                flat = pa.array(sign.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("h"), pa.array([c for c, _ in names], pa.int64()), pa.array([c for _, c in names], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), flat)],
                    ["key", "h", "c1", "c2", "grams", "bands"],
                )

    return narrow.mapInArrow(run, f"key {narrow.schema['key'].dataType.simpleString()}, h bigint, c1 bigint, c2 bigint, grams bigint, bands array<bigint>")


def name(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of hashes."""
    both = np.array([grams.sum(dtype=np.uint64), mix(grams).sum(dtype=np.uint64)], np.uint64).view(np.int64)
    return int(both[0]), int(both[1])


def homes(sets: DataFrame) -> DataFrame:
    """(c1, c2, homes): the buckets in which a class meets others, ascending; buckets with equal members count once."""
    named = sets.select("c1", "c2", F.posexplode("bands").alias("band", "value")).select("c1", "c2", F.xxhash64("band", "value").alias("bucket"))
    size = named.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("c1", "c2")).alias("m1"), F.bit_xor(F.xxhash64("c2", "c1")).alias("m2"))
    shared = size.where("n > 1")
    once = shared.groupBy("n", "m1", "m2").agg(F.min("bucket").alias("home"))
    # at most BANDS buckets a class
    return named.join(shared.join(once, ["n", "m1", "m2"]).select("bucket", "home"), "bucket").groupBy("c1", "c2").agg(F.sort_array(F.collect_set("home")).alias("homes"))


def payloads(docs: DataFrame, wanted: DataFrame, n: int, text: str, key: str) -> DataFrame:
    """(c1, c2, grams, sign) as bytes, from the texts of the classes' representatives."""
    narrow = hashed(take(docs, key=key, text=text))
    asked = wanted.select(F.col("rep.key").alias("_key"), F.col("rep.h").alias("_h"))
    # whatever the size, both sides are shuffled: how many classes meet others has no bound
    own = narrow.join(asked.hint("merge"), F.col("key").eqNullSafe(F.col("_key")) & (F.col("h") == F.col("_h")), "left_semi").select("text")

    def run(batches):
        for batch in batches:
            for low, high in slices(batch.column("text")):
                sets = shingles(*utf8(batch.column("text").slice(low, high - low)), n)
                names = [name(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in names], pa.int64()), pa.array([c for _, c in names], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([signature(s).tobytes() for s in sets], pa.binary())], ["c1", "c2", "grams", "sign"])

    return own.mapInArrow(run, "c1 bigint, c2 bigint, grams binary, sign binary")


class Chunk:
    """Classes of a bucket as arrays: names, copies, n-gram sets laid end to end, signatures, homes."""

    def __init__(self, rows: list[tuple]):
        self.names = [(r[0], r[1]) for r in rows]
        self.copies = np.array([r[2] for r in rows], np.int64)
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        distinct, self.grams = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(distinct), np.int32)
        self.sign = np.stack([np.frombuffer(r[4], np.uint32) for r in rows])
        self.homes = np.full((len(rows), BANDS), np.iinfo(np.int64).max)
        for i, r in enumerate(rows):
            self.homes[i, : len(r[5])] = r[5]

    def links(self, home: int, apart: np.ndarray | None, threshold: float, tolerance: float):
        """(i, the j > i that i is linked with). apart: side of each row, if only pairs across sides are asked for."""
        for i in range(len(self.names) - 1):
            other = np.arange(i + 1, len(self.names))
            if apart is not None:
                other = other[apart[other] != apart[i]]
            a, b = self.sizes[i], self.sizes[other]
            other = other[np.minimum(a, b) >= threshold * np.maximum(a, b)]
            if before := self.homes[i][self.homes[i] < home].tolist():  # such a pair is judged there
                other = other[~np.isin(self.homes[other], before).any(axis=1)]
            other = other[alive(np.broadcast_to(self.sign[i], (len(other), self.sign.shape[1])), self.sign[other], threshold, tolerance)]
            if len(other):
                own = self.grams[self.ends[i] : self.ends[i + 1]]
                self.mark[own] = 1
                if len(other) > 16:
                    both = np.add.reduceat(self.mark[self.grams[self.ends[i + 1] :]], self.ends[i + 1 : -1] - self.ends[i + 1])[other - i - 1]
                else:
                    both = np.array([self.mark[self.grams[self.ends[j] : self.ends[j + 1]]].sum() for j in other.tolist()])
                self.mark[own] = 0
                found = other[both >= threshold * (self.sizes[i] + self.sizes[other] - both) - 1e-9]
                if len(found):
                    yield i, found


def judged(dealt: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(a1, a2, b1, b2, texts, copies): link counts of classes (b null) and edges that span the links."""
    out = ["a1", "a2", "b1", "b2", "texts", "copies"]

    def judge(home: int, deal: tuple[int, int], rows: dict):
        if len(rows) < 2:
            return
        chunk = Chunk([r[:6] for r in rows.values()])
        apart = np.array([r[6] for r in rows.values()]) if deal[0] != deal[1] else None
        texts, copies = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        root = list(range(len(rows)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i, found in chunk.links(home, apart, threshold, tolerance):
            texts[i] += len(found)
            copies[i] += chunk.copies[found].sum()
            texts[found] += 1
            copies[found] += chunk.copies[i]
            for j in found.tolist():
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
        groups: dict[int, list[int]] = {}
        for i in np.flatnonzero(texts).tolist():
            yield (*chunk.names[i], None, None, int(texts[i]), int(copies[i]))
            groups.setdefault(top(i), []).append(i)
        for members in groups.values():  # a binary tree, so that no class has many edges
            for at in range(1, len(members)):
                yield (*chunk.names[members[at]], *chunk.names[members[(at - 1) // 2]], 0, 0)

    def run(batches):
        now, rows, made = None, {}, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("home", "low", "high", "c1", "c2", "copies", "grams", "sign", "homes", "side")]
            for home, low, high, c1, c2, copies, grams, sign, own, side in zip(*columns, strict=True):
                if now != (home, low, high):
                    if now:
                        made += judge(now[0], now[1:], rows)
                    now, rows = (home, low, high), {}
                rows[c1, c2] = (c1, c2, copies, grams, sign, own, side)
            yield table(made)
            made = []
        if now:
            made += judge(now[0], now[1:], rows)
        yield table(made)

    def table(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.int64()) for i in range(6)], out)

    return dealt.mapInArrow(run, ", ".join(f"{c} bigint" for c in out))


def deal(met: DataFrame, chunk_rows: int, chunk_bytes: int) -> DataFrame:
    """Members of each bucket, dealt out as pairs of chunks: a class goes to every pair that its chunk is in."""
    members = met.select("c1", "c2", "copies", "homes", "grams", F.explode("homes").alias("home"))
    size = stored(members.groupBy("home").agg(F.count("*").alias("n"), F.sum(F.col("grams") * 8).alias("bytes")).where("n > 1"), "sizes")
    chunks = F.greatest(F.ceil(F.col("n") / chunk_rows), F.ceil(F.col("bytes") / chunk_bytes)).cast("int")
    side = F.pmod(F.xxhash64("home", "c1", "c2"), F.col("chunks")).cast("int")
    spread = members.drop("grams").join(size.select("home", chunks.alias("chunks")), "home").withColumn("side", side).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return spread.withColumn("low", F.least("side", "to")).withColumn("high", F.greatest("side", "to")).drop("chunks", "to")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, by label propagation with shortcuts."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        lower = labels.join(near.select(F.col("a").alias("node"), "m"), "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = stored(meet(lower, jump, ["root"]).select("node", "old", F.least("root", "next").alias("root")), "labels")
        if after.where("root <> old").isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")


def grouped(docs: DataFrame, n: int, threshold: float, tolerance: float, text: str, key: str, chunk_rows: int, chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(rows (key, h, c1, c2, grams), classes (c1, c2, rep, copies, root, texts, linked)); rep: least (key, h) of a class."""
    rows = stored(classes(docs, n, text, key), "classes")
    sets = stored(rows.where("grams > 0").groupBy("c1", "c2").agg(F.min(F.struct("key", "h")).alias("rep"), F.count("*").alias("copies"), F.any_value("grams").alias("grams"), F.any_value("bands").alias("bands")), "sets")
    met = stored(homes(sets).join(sets.select("c1", "c2", "rep", "copies", "grams"), ["c1", "c2"]), "homes")
    dealt = deal(met, chunk_rows, chunk_bytes).join(payloads(docs, met, n, text, key), ["c1", "c2"]).repartition("home", "low", "high").sortWithinPartitions("home", "low", "high")
    found = stored(judged(dealt, threshold, tolerance), "links")
    counts = found.groupBy("a1", "a2").agg(F.sum("texts").alias("texts"), F.sum("copies").alias("linked")).select(F.col("a1").alias("c1"), F.col("a2").alias("c2"), "texts", "linked")
    roots = components(found.where("b1 is not null").select(F.struct(F.col("a1").alias("c1"), F.col("a2").alias("c2")).alias("a"), F.struct(F.col("b1").alias("c1"), F.col("b2").alias("c2")).alias("b")))
    named = sets.select("c1", "c2", "rep", "copies").join(roots.select("node.c1", "node.c2", "root"), ["c1", "c2"], "left").withColumn("root", F.coalesce("root", F.struct("c1", "c2")))
    return rows.drop("bands"), named.join(counts, ["c1", "c2"], "left").fillna(0, ["texts", "linked"])


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, text: str = "text", key: str = "doc_id", chunk_rows: int = 512, chunk_bytes: int = 24 << 20) -> DataFrame:
    """A row for each document.

    class_id: least key of its group (documents linked directly or through others);
    n_links: other documents at or above the threshold; text_id: least key among equal
    n-gram sets; n_text_links: other such sets at or above the threshold.
    """
    rows, sets = grouped(docs, n, threshold, tolerance, text, key, chunk_rows, chunk_bytes)
    least = sets.groupBy("root").agg(F.min("rep.key").alias("class_id"))
    named = meet(sets, least, ["root"]).select("c1", "c2", "class_id", F.col("rep.key").alias("text_id"), "copies", "texts", "linked")
    linked = rows.where("grams > 0").join(named, ["c1", "c2"]).select(F.col("key").alias(key), "class_id", (F.col("linked") + F.col("copies") - 1).alias("n_links"), "text_id", F.col("texts").alias("n_text_links"))
    alone = rows.where("grams = 0").select(F.col("key").alias(key), F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("text_id"), F.lit(0).cast("long").alias("n_text_links"))
    return linked.unionByName(alone)


def distinct(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, text: str = "text", key: str = "doc_id", chunk_rows: int = 512, chunk_bytes: int = 24 << 20) -> DataFrame:
    """``docs`` with one row of each group: the least by key, then by a hash of the text. Rows without words all stay."""
    _, sets = grouped(docs, n, threshold, tolerance, text, key, chunk_rows, chunk_bytes)
    chosen = sets.groupBy("root").agg(F.min("rep").alias("rep")).select(F.col("rep.key").alias("_key"), F.col("rep.h").alias("_h"))
    held = hashed(take(docs, row="row", apart=text, key=key, text=text))
    names, word = docs.columns, F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))
    kept = held.where(word).join(chosen, F.col("key").eqNullSafe(F.col("_key")) & (F.col("h") == F.col("_h")), "left_semi").dropDuplicates(["key", "h"])
    return restore(kept.unionByName(held.where(~word)), "row", names, {place(names, text): F.col("text")})


#: ``join`` as DuckDB SQL, for tables of distinct ids.
JOIN_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), g AS (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS gram FROM w)
), s AS (
  SELECT doc_id, md5(string_agg(gram, chr(1) ORDER BY gram)) AS grams, count(*) AS n FROM g GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y, b.grams AS other, a.grams AS own FROM met JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE shared >= 0.8 * (a.n + b.n - shared)
), walk AS (
  SELECT doc_id AS seed, doc_id AS node FROM w UNION SELECT seed, y FROM walk JOIN links ON x = node
), c AS (
  SELECT seed AS doc_id, min(node) AS class_id FROM walk GROUP BY seed
), n AS (
  SELECT x AS doc_id, count(*) AS n_links, count(DISTINCT other) FILTER (WHERE other <> own) AS n_text_links FROM links GROUP BY x
), t AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY grams) AS text_id FROM s
)
SELECT doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(text_id, doc_id) AS text_id, CAST(coalesce(n_text_links, 0) AS BIGINT) AS n_text_links
FROM c LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
