"""Removal of word sequences that occur more than once, by relative Lempel-Ziv parsing.

The reference is the collection itself. Each text is cut into blocks at content-defined
anchors (the least hash of ANCHOR words in every stretch that makes up a window), so equal
passages have equal blocks wherever they stand; a block has a window's words at least. The
index holds every block that occurs more than once, with one place of reference.

A text is factored greedily from left to right: a factor starts at an indexed block and
takes in the blocks that follow as long as they continue at the same place of reference.
All windows inside a block of a factor are duplicates. Windows at factor and block boundaries
are in no single block; those are looked up one by one among the boundary windows of all
texts and the windows of one copy of each indexed block. So the result is exact: a word
goes if and only if a window over it starts at another place too, in whatever text.

Each distinct text is worked on once, with a note whether it has copies; rows take their
text's result, so copies cost a narrow join each. A text is named by 64 bits, of a hash under
which no two texts that differ in 128 bits meet (a job of its own looks for that, and takes the
next seed); blocks are told by 122 bits and windows by 91, of two polynomials over independent hashes of
the words (see ``hashing``); anchors, where a false match does no harm, by 61.

Defined results: null text counts as empty; texts of fewer words than a window keep them
all; texts of any length are worked on whole, with memory of about ten times the longest;
equal texts lose the same words, however many there are; null and repeated keys are kept as
any others; an empty table gives an empty result; columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import gather
from .frames import meet, place, restore, slices, take, utf8
from .hashing import OTHER, fits, range_hashes, sliding, window_hashes, word_hashes, words

#: Words of an anchor; a window of w words holds w - ANCHOR + 1 places where one may start.
ANCHOR = 12


class Words:
    """Words of a few texts laid end to end."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = utf8(column)
        self.starts, self.ends, self.first = words(self.data, self.offsets)
        self.n = len(self.starts)
        self.text = np.repeat(np.arange(len(column)), np.diff(self.first))
        self.hashes = word_hashes(self.data, self.starts, self.ends)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where anchors start, their hashes, for each window start the least anchor hash in it or 0)."""
        span = window - ANCHOR + 1
        if self.n < window:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(self.n, np.uint64)
        grams = window_hashes(self.hashes, ANCHOR)
        least = sliding(grams, span, np.minimum)
        least[~fits(self.first, window, self.n)[: len(least)]] = 0
        pad = np.zeros(span - 1, np.uint64)
        at = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), span, np.maximum) == grams)
        return at, grams[at], np.concatenate([least, np.zeros(window - 1, np.uint64)])

    def blocks(self, window: int, at: np.ndarray, indexed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the stretch of a window's words or more from each indexed anchor to an end of another."""
        if not len(at):
            return at, at
        to = np.searchsorted(at, at + window - ANCHOR)
        inside = to < len(at)
        to = np.minimum(to, len(at) - 1)
        missing = np.concatenate([[0], np.cumsum(~indexed)])
        inside &= (missing[to + 1] == missing[np.arange(len(at))]) & (self.text[at] == self.text[at[to]])
        return at[inside], at[to[inside]] + ANCHOR


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, row of each) of a list column; null counts as empty."""
    column = batch.column(name)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.repeat(np.arange(len(column)), sizes)


def _parts(batches):
    for batch in batches:
        for low, high in slices(batch.column("text")):
            part = batch.slice(low, high - low)
            yield part, Words(part.column("text"))


#: The name of a distinct text.
NAME = "t"


def _named(part: pa.RecordBatch, rows: np.ndarray) -> pa.Array:
    return part.column(NAME).take(pa.array(rows))


def anchors(texts: DataFrame, window: int) -> DataFrame:
    """(t, anchor, n): the anchors of each text and how often it has them, twice if it has copies."""

    def run(batches):
        for part, text in _parts(batches):
            at, values, _ = text.anchors(window)
            rows = text.text[at]
            order = np.lexsort((values, rows))
            rows, values = rows[order], values[order]
            new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])])) if len(rows) else np.zeros(0, np.int64)
            counts = np.diff(np.concatenate([new, [len(rows)]])) * _copies(part)[rows[new]]
            yield pa.RecordBatch.from_arrays([_named(part, rows[new]), pa.array(values[new].view(np.int64)), pa.array(counts, pa.int32())], [NAME, "anchor", "n"])

    return texts.mapInArrow(run, "t bigint, anchor bigint, n int")


def _copies(part: pa.RecordBatch) -> np.ndarray:
    return part.column("copies").to_numpy()


def _indexed(part: pa.RecordBatch, values: np.ndarray) -> np.ndarray:
    seeds = np.unique(_lists(part, "seeds")[0].to_numpy(zero_copy_only=False).view(np.uint64))
    return np.isin(values, seeds)


def reference_blocks(seeded: DataFrame, window: int) -> DataFrame:
    """(t, b1, b2, words, starts, copies): the blocks between indexed anchors, with all their places in the text."""

    def run(batches):
        for part, text in _parts(batches):
            at, values, _ = text.anchors(window)
            start, end = text.blocks(window, at, _indexed(part, values))
            rows, block, other = text.text[start], range_hashes(text.hashes, start, end), range_hashes(text.hashes, start, end, OTHER)
            order = np.lexsort((start, other, block, rows))
            rows, block, other, start, size = rows[order], block[order], other[order], start[order], (end - start)[order]
            new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (block[1:] != block[:-1]) | (other[1:] != other[:-1])])) if len(rows) else np.zeros(0, np.int64)
            places = pa.ListArray.from_arrays(pa.array(np.concatenate([new, [len(rows)]]), pa.int32()), pa.array(start - text.first[rows], pa.int32()))
            kept = [pa.array(block[new].view(np.int64)), pa.array(other[new].view(np.int64)), pa.array(size[new], pa.int32()), places, pa.array(_copies(part)[rows[new]], pa.int32())]
            yield pa.RecordBatch.from_arrays([_named(part, rows[new]), *kept], [NAME, "b1", "b2", "words", "starts", "copies"])

    return seeded.mapInArrow(run, "t bigint, b1 bigint, b2 bigint, words int, starts array<int>, copies int")


def _factors(part: pa.RecordBatch, text: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, words, whether it is its own reference, whether it begins a factor) of each indexed block, by place."""
    flat, rows = _lists(part, "found")
    size, ref, ref_start = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(1, 4))
    places = flat.field(0)
    times = places.value_lengths().to_numpy(zero_copy_only=False) if len(places) else np.zeros(0, np.int64)
    start = places.flatten().to_numpy(zero_copy_only=False)
    rows, size, ref, ref_start = (np.repeat(x, times) for x in (rows, size, ref, ref_start))
    own = (ref == part.column(NAME).to_numpy()[rows]) & (ref_start == start)
    order = np.lexsort((start, rows))
    start, size, ref, shift, rows, own = start[order].astype(np.int64), size[order].astype(np.int64), ref[order], (ref_start - start)[order], rows[order], own[order]
    begins = np.ones(len(rows), bool)
    begins[1:] = (rows[1:] != rows[:-1]) | (ref[1:] != ref[:-1]) | (shift[1:] != shift[:-1]) | (start[1:] > (start + size)[:-1])
    return start + text.first[rows], size, own, begins


def _spans(start: np.ndarray, size: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, words) of factors: runs of blocks that continue each other."""
    first = np.flatnonzero(begins)
    if not len(first):
        return start, size
    return start[first], np.maximum.reduceat(start + size, first) - start[first]


def _inside(n: int, start: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    """Which of n window starts lie in one of the blocks."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, start + size - window + 1, -1)
    return np.cumsum(steps[:-1]) > 0


def windows(parsed: DataFrame, window: int, boundary: bool) -> DataFrame:
    """(window, other, weight, t, start): boundary windows weigh 1, in texts with copies 2; unless only those are asked for, windows of reference blocks weigh 2."""

    def run(batches):
        for part, text in _parts(batches):
            at, values, least = text.anchors(window)
            start, size, own, _ = _factors(part, text)
            seeds = np.unique(_lists(part, "seeds")[0].to_numpy(zero_copy_only=False).view(np.uint64))
            inside = _inside(text.n, start, size, window)
            edge = np.flatnonzero((least > 0) & ~inside & np.isin(least, seeds))
            kept = np.zeros(0, np.int64) if boundary else np.flatnonzero(_inside(text.n, start[own], size[own], window))
            at = np.concatenate([edge, kept])
            hashes = window_hashes(text.hashes, window).view(np.int64)[at]
            others = (window_hashes(text.hashes, window, OTHER)[at] >> np.uint64(33)).astype(np.int32)
            rows = text.text[edge]
            none = pa.nulls(len(kept), pa.int32())
            names = pa.concat_arrays([_named(part, rows), pa.nulls(len(kept), pa.int64())])
            place = pa.concat_arrays([pa.array(edge - text.first[rows], pa.int32()), none])
            weight = pa.array(np.concatenate([_copies(part)[rows], np.full(len(kept), 2)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(others), weight, names, place], ["window", "other", "weight", NAME, "start"])

    return parsed.mapInArrow(run, "window bigint, other int, weight int, t bigint, start int")


def _names(docs: DataFrame, text: str):
    """A function of a text column that names its texts: the first of a row of hashes under which no two texts of ``docs`` share a name."""
    each = take(docs, text=text).select(F.col("text").cast("string").alias("text"))
    for seed in range(100):
        name = lambda column, seed=seed: F.xxhash64(F.lit(f"name {seed}"), column).alias(NAME)
        told = each.select(name(F.col("text")), F.xxhash64("text").alias("own")).groupBy(NAME).agg(F.min("own").alias("low"), F.max("own").alias("high"))
        if told.where("low <> high").isEmpty():
            return name
    raise ValueError("no hash tells the texts apart")


def _parsed(docs: DataFrame, window: int, text: str, name) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(distinct texts with their names, seeds of each, indexed blocks of each)."""
    each = take(docs, text=text).select(F.col("text").cast("string").alias("text"))
    texts = each.select(name(F.col("text")), "text").groupBy(NAME).agg(F.any_value("text").alias("text"), F.least(F.count("*"), F.lit(2)).cast("int").alias("copies"))
    met = anchors(texts, window)
    repeated = met.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    seeds = meet(met.select(NAME, "anchor"), repeated, ["anchor"]).groupBy(NAME).agg(F.collect_list("anchor").alias("seeds"))  # at most a text's words
    blocks = reference_blocks(texts.join(seeds, NAME), window)
    first = F.struct(NAME, F.get("starts", F.lit(0)).alias("start"))
    index = blocks.groupBy("b1", "b2").agg(F.sum(F.size("starts") * F.col("copies")).alias("n"), F.min(first).alias("ref")).where("n > 1")
    found = meet(blocks.drop("copies"), index.select("b1", "b2", "ref"), ["b1", "b2"]).groupBy(NAME).agg(F.collect_list(F.struct("starts", "words", f"ref.{NAME}", "ref.start")).alias("found"))
    return texts, seeds, found


def factors(docs: DataFrame, window: int = 35, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, start, words, own): the factors of each text, in words; own: its block is the index's place of reference."""
    name = _names(docs, text)
    texts, _, found = _parsed(docs, window, text, name)

    def run(batches):
        for part, words_of in _parts(batches):
            start, size, own, begins = _factors(part, words_of)
            at, length = _spans(start, size, begins)
            rows = words_of.text[at]
            yield pa.RecordBatch.from_arrays([_named(part, rows), pa.array(at - words_of.first[rows], pa.int64()), pa.array(length, pa.int64()), pa.array(own[begins])], [NAME, "start", "words", "own"])

    made = texts.join(found, NAME).mapInArrow(run, "t bigint, start bigint, words bigint, own boolean")
    rows = take(docs, key=key, text=text).select("key", name(F.col("text").cast("string")))
    return rows.join(made, NAME).select(F.col("key").alias(key), "start", "words", "own")


def removed(docs: DataFrame, window: int, text: str, name) -> DataFrame:
    """(t, n_words, n_removed, kept) of each distinct text: its words without the repeated ones, joined by one blank."""
    texts, seeds, found = _parsed(docs, window, text, name)
    parsed = texts.join(seeds, NAME).join(found, NAME, "left")
    told = ["window", "other"]
    twice = windows(parsed, window, boundary=False).groupBy(*told).agg(F.sum("weight").alias("n")).where("n > 1").select(*told)
    edges = meet(windows(parsed, window, boundary=True).select(*told, NAME, "start"), twice, told, "left_semi").groupBy(NAME).agg(F.collect_list("start").alias("edges"))
    whole = texts.join(found, NAME, "left").join(edges, NAME, "left")

    def run(batches):
        for part, own in _parts(batches):
            start, size, _, begins = _factors(part, own)
            start, size = _spans(start, size, begins)
            at, rows = _lists(part, "edges")
            at = at.to_numpy(zero_copy_only=False).astype(np.int64) + own.first[rows]
            start, size = np.concatenate([start, at]), np.concatenate([size, np.full(len(at), window)])
            stay = ~_inside(own.n, start, size, 1)
            lengths = (own.ends - own.starts)[stay] + 1
            made, ends = gather(np.concatenate([own.data, [np.uint8(32)]]), own.starts[stay], lengths)
            made[ends[1:] - 1] = 32
            before = np.concatenate([[0], np.cumsum(stay)])[own.first]  # kept words before each text
            counts, bytes_at = np.diff(before), ends[before]
            raw = made.tobytes()
            kept = [raw[a : b - (c > 0)] for a, b, c in zip(bytes_at[:-1].tolist(), bytes_at[1:].tolist(), counts.tolist(), strict=True)]
            total = np.diff(own.first)
            columns = [part.column(NAME), pa.array(total, pa.int64()), pa.array(total - counts, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [NAME, "n_words", "n_removed", "kept"])

    return whole.mapInArrow(run, "t bigint, n_words bigint, n_removed bigint, kept string")


def without_repeats(docs: DataFrame, window: int = 35, text: str = "text") -> DataFrame:
    """``docs`` without the repeated words in its text; rows of which no word is left go, other columns stay.

    A text from which nothing is removed stays as it was, so only others travel to their rows.
    """
    names, name = docs.columns, _names(docs, text)
    changed = removed(docs, window, text, name).where("n_removed > 0").select(NAME, "kept", (F.col("n_words") > F.col("n_removed")).alias("left"))
    rows = take(docs, row="row", apart=text, text=text).withColumn("text", F.col("text").cast("string"))
    made = rows.select("row", "text", name(F.col("text"))).join(changed, NAME, "left").where(F.coalesce("left", F.lit(True)))
    return restore(made, "row", names, {place(names, text): F.when(F.col("left"), F.col("kept")).otherwise(F.col("text"))})


def digest(docs: DataFrame, window: int = 35, text: str = "text", key: str = "doc_id") -> DataFrame:
    name = _names(docs, text)
    made = removed(docs, window, text, name).select(NAME, "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    rows = take(docs, key=key, text=text).select("key", name(F.col("text").cast("string")))
    return rows.join(made, NAME).select(F.col("key").alias(key), "n_words", "n_removed", "kept_sha256")


#: ``digest`` as DuckDB SQL.
DIGEST_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), p AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35
), g AS (
  SELECT doc_id, i, array_to_string(words[i:i+34], ' ') AS gram FROM p
), c AS (
  SELECT gram FROM g GROUP BY gram HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM g JOIN c USING (gram)
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
