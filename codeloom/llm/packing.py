"""Packing documents into windows of a fixed number of tokens.

A document's ids are cut into whole windows and a remainder. The histogram of remainders
is all that planning looks at: shallow combinations (two or three lengths that fill a
window) are enumerated, their repeat counts are solved by non-negative least squares
against the histogram, rounded, and what is left over is packed greedily: first into
further combinations, then end to end, cut at window ends. The last, unfilled window is
cut into powers of two, which need no padding. A row finds its place from its remainder
and its rank among equal remainders alone.

Defined results: null text counts as empty text; an empty text still has its end id; a
text of any length is packed whole; equal rows, null and repeated keys are packed one by one;
remainders of one length are alike, so their order among themselves is that of their rows; an
empty table gives no pieces; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from .bpe import byte_characters, gather
from .frames import slices, stored, strings, take

#: The tokenizer's split for lower-case Latin-1 text; other words take the library's own splitter.
_LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾ ]+")
_BYTES = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})


class WordBpe:
    """Ids by a tokenizers file whose pieces never cross white space. ``cache`` bounds the bytes of what is remembered."""

    #: Longer pieces are encoded each time; texts are cut at blanks into stretches of about so many characters.
    LONGEST, STRETCH = 64, 1 << 18

    def __init__(self, path: str, cache: int = 64 << 20):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        self.most = cache
        self.forget()

    def forget(self) -> None:
        self.pieces: dict[str, int] = {}  # of plain texts
        self.words: dict[str, int] = {}  # of others, between blanks
        self.held = 0
        self.flat = array("i")
        self.ends = array("q", [0])

    def _add(self, mapped: list[str]) -> int:
        for piece in mapped:
            self.flat.extend([t.id for t in self.model.tokenize(piece)])
        self.ends.append(len(self.flat))
        self.held += 4 * int(self.ends[-1] - self.ends[-2]) + 8
        return len(self.ends) - 2

    def _keep(self, known: dict[str, int], word: str, at: int) -> int:
        if len(word) <= self.LONGEST:
            known[word] = at
            self.held += 100 + len(word)  # the entry, the string and its number
        return at

    def _piece(self, piece: str) -> int:
        return self._keep(self.pieces, piece, self._add([piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)]))

    def _word(self, word: str) -> int:
        normal = self.tokenizer.normalizer.normalize_str(word)
        return self._keep(self.words, word, self._add([p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]))

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with ``end`` after it; offsets)."""
        made, counts, total = [np.zeros(0, np.int32)], [0], 0
        at: list[int] = []
        marks: list[int] = []  # how many of ``at`` each finished text has

        def flush() -> None:
            nonlocal total
            where, ends = np.asarray(at, np.int64), np.frombuffer(self.ends, np.int64)  # views: gone before the arrays grow again
            ids, offsets = gather(np.frombuffer(self.flat, np.int32) if self.flat else np.zeros(0, np.int32), ends[where], ends[where + 1] - ends[where])
            made.append(ids)
            counts.extend((offsets[np.asarray(marks, np.int64)] + total).tolist())
            total += len(ids)
            at.clear(), marks.clear()

        for text in texts:
            if text:
                line = text.replace("\n", " ")
                plain, lower = _plain(line), 0
                while lower < len(line):
                    upper = line.find(" ", lower + self.STRETCH) if len(line) - lower > self.STRETCH else -1
                    part = line[lower:upper] if upper >= 0 else line[lower:]
                    lower = upper + 1 if upper >= 0 else len(line)  # blanks part pieces and are in none
                    if plain:
                        get, learn = self.pieces.get, self._piece
                        at += [learn(p) if (i := get(p)) is None else i for p in _LATIN.findall(part.lower())]
                    else:
                        get, learn = self.words.get, self._word
                        at += [learn(w) if (i := get(w)) is None else i for w in part.split(" ")]
                    if self.held > self.most or len(at) > 4 * self.STRETCH:
                        flush()
                        if self.held > self.most:
                            self.forget()
            last = self.words.get("\n")  # no word has a line feed in it
            if last is None:
                self.flat.append(end)
                self.ends.append(len(self.flat))
                self.words["\n"] = last = len(self.ends) - 2
            at.append(last)
            marks.append(len(at))
        flush()
        return np.concatenate(made), np.asarray(counts)


def _plain(line: str) -> bool:
    """Printable Latin-1 text, which the short pattern splits as the library would."""
    if not line.isprintable():
        return False
    if line.isascii():
        return True
    try:
        line.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=4)
def codec(path: str) -> WordBpe:
    return WordBpe(path)


def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """Rows (a, b, c), a <= b <= c or a = 0, of present lengths that sum to ``window``."""
    rows = [np.array([[0, a, window - a] for a in range(1, window // 2 + 1) if present[a] and present[window - a]], np.int64).reshape(-1, 3)]
    for a in np.flatnonzero(present[: window // 3 + 1]):
        if a:
            b = np.arange(a, (window - a) // 2 + 1)
            b = b[present[b] & present[window - a - b]]
            rows.append(np.stack([np.full(len(b), a), b, window - a - b], axis=1))
    return np.concatenate(rows)


def _apart(columns: list[np.ndarray], candidates: np.ndarray, lengths: int) -> np.ndarray:
    """Candidates, best first, that share no length with a better one that is chosen."""
    chosen = [np.zeros(0, np.int64)]
    while len(candidates):
        own, place = [c[candidates] for c in columns], np.arange(len(candidates))
        first = np.full(lengths, len(candidates))
        first[np.stack(own, axis=1)[::-1].ravel()] = np.repeat(place[::-1], 3)  # the last to write is the best
        good = ((own[0] == 0) | (first[own[0]] == place)) & (first[own[1]] == place) & (first[own[2]] == place)
        chosen.append(candidates[good])
        used = np.zeros(lengths, bool)
        for c in own:
            used[c[good]] = True
        used[0] = False
        candidates = candidates[~(used[own[0]] | used[own[1]] | used[own[2]])]
    return np.concatenate(chosen)


def nonnegative_least_squares(parts: np.ndarray, counts: np.ndarray, tolerance: float = 5e-4, near: float = 0.002) -> np.ndarray:
    """x >= 0 that brings the sum of x over the rows that use a length close to its count.

    Descent by blocks: each round moves columns that share no length, those that gain most
    first, each to its own minimum. It ends when the counts are met within half a document (or
    ``near`` of the mean count) in the quadratic mean, as rounding adds as much, or when a round
    lowers the squared distance by less than ``tolerance`` of it.
    """
    x, left = np.zeros(len(parts)), counts.astype(float)
    left[0] = 0
    columns = [np.ascontiguousarray(parts[:, i]) for i in range(3)]
    norm = sum((parts == c[:, None]).sum(axis=1) * (c > 0) for c in columns).astype(float)
    met = len(counts) * max(0.5, near * left.mean()) ** 2
    while len(parts) and (far := float(left @ left)) > met:
        slope = left[columns[0]] + left[columns[1]] + left[columns[2]]
        step = np.maximum(slope / norm, -x)
        gain = step * (2 * slope - norm * step)
        candidates = np.flatnonzero(gain > max(tolerance * far / len(counts), gain.max() / 16))
        chosen = _apart(columns, candidates[np.argsort(-gain[candidates], kind="stable")], len(counts))
        x[chosen] += step[chosen]
        for c in columns:
            left -= np.bincount(c[chosen], step[chosen], len(counts))
        left[0] = 0
        if far - float(left @ left) <= tolerance * far:
            break
    return x


def plan(histogram: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows a, b, c, repeats; what is left of each length). histogram[r]: remainders of length r, [0] is not used."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    parts = combinations(window, left > 0)
    times = np.floor(nonnegative_least_squares(parts, left) + 0.5).astype(np.int64)
    made = np.zeros(len(parts), np.int64)

    def place(index: int, most: int) -> None:
        row = parts[index][parts[index] > 0]
        lengths, uses = np.unique(row, return_counts=True)
        n = min(most, int((left[lengths] // uses).min()))
        if n > 0:
            left[lengths] -= uses * n
            made[index] += n

    for i in np.argsort(-times, kind="stable")[: int((times > 0).sum())].tolist():
        place(i, int(times[i]))
    for i in range(len(parts)):  # what rounding left
        if left[parts[i][1]] and left[parts[i][2]]:
            place(i, 1 << 60)
    used = made > 0
    return np.column_stack([parts[used], made[used]]), left


class Places:
    """Where the k-th remainder of a length goes."""

    def __init__(self, histogram: np.ndarray, window: int, wholes: int):
        self.window = window
        rows, left = plan(histogram, window)
        segments: dict[int, list[tuple[int, int, int]]] = {}
        taken, at = np.zeros(len(histogram), np.int64), wholes
        for a, b, c, n in rows.tolist():
            offset = 0
            for length in (a, b, c):
                if length:
                    segments.setdefault(length, []).append((int(taken[length]), at, offset))
                    taken[length] += n
                    offset += length
            at += n
        self.segments = {r: tuple(np.array(v, np.int64) for v in zip(*s, strict=True)) for r, s in segments.items()}
        self.taken = taken
        sizes = left * np.arange(len(left))
        self.base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.total, self.stream = int(sizes.sum()), at
        rest = self.total % window
        self.full = self.total - rest
        cuts = [self.full]
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                cuts.append(cuts[-1] + (1 << bit))
        self.cuts = np.array(cuts, np.int64)

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the remainder, length, sequence, offset)."""
        if rank < self.taken[length]:
            begins, sequences, offsets = self.segments[length]
            i = int(np.searchsorted(begins, rank, side="right")) - 1
            return [(0, length, int(sequences[i] + rank - begins[i]), int(offsets[i]))]
        at = int(self.base[length]) + (rank - int(self.taken[length])) * length
        end, begin, out = at + length, at, []
        while at < end:
            if at < self.full:
                sequence, offset = divmod(at, self.window)
                stop = min(end, (sequence + 1) * self.window)
            else:
                i = int(np.searchsorted(self.cuts, at, side="right")) - 1
                sequence, offset, stop = self.full // self.window + i, at - int(self.cuts[i]), min(end, int(self.cuts[i + 1]))
            out.append((at - begin, stop - at, self.stream + sequence, offset))
            at = stop
        return out


def tokenized(docs: DataFrame, path: str, end: int, window: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids as little-endian bytes, n, remainder, part, rank in the part, whole windows before it in the part)."""
    narrow = take(docs, key=key, text=text).withColumn("text", F.col("text").cast("string"))
    names = ["key", "ids", "n", "remainder", "part", "rank", "wholes"]

    def run(batches):
        bpe = codec(path)
        kind = "<u2" if bpe.size <= 1 << 16 and end < 1 << 16 else "<u4"
        part, seen, wholes = TaskContext.get().partitionId(), [0] * window, 0
        for batch in batches:
            for low, high in slices(batch.column("text")):
                rows = batch.slice(low, high - low)
                ids, offsets = bpe.encode(strings(rows, "text"), end)
                raw, width = ids.astype(kind).tobytes(), int(kind[-1])
                sizes = np.diff(offsets)
                ranks, before = [], []
                for n in sizes.tolist():
                    ranks.append(seen[n % window])
                    seen[n % window] += 1
                    before.append(wholes)
                    wholes += n // window
                data = [raw[a * width : b * width] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("key"), pa.array(data, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sizes % window, pa.int32()), pa.array([part] * len(data), pa.int32()), pa.array(ranks, pa.int64()), pa.array(before, pa.int64())], names
                )

    return narrow.mapInArrow(run, f"key {narrow.schema['key'].dataType.simpleString()}, ids binary, n bigint, remainder int, part int, rank bigint, wholes bigint")


def pack(docs: DataFrame, path: str, window: int = 2048, end: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each piece: key, start, length, ids (as bytes), ids_crc32, doc_tokens, sequence_id, offset."""
    rows = stored(tokenized(docs, path, end, window, text, key), "pack")
    per_part = rows.groupBy("part", "remainder").agg(F.count("*").alias("n"), F.sum(F.expr(f"n div {window}")).alias("whole"))
    counted = per_part.groupBy("remainder").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole")).collect()  # at most ``window`` rows
    histogram = np.zeros(window, np.int64)
    for r in counted:
        histogram[r["remainder"]] = r["n"]
    places = Places(histogram, window, sum(r["whole"] for r in counted))
    earlier = Window.partitionBy("remainder").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    wholes = per_part.groupBy("part").agg(F.sum("whole").alias("whole"))  # a row for each task of the tokenizing stage
    first_whole = wholes.select(F.col("part").alias("part"), F.coalesce(F.sum("whole").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first_whole"))
    # written first: its size is known then, and up to Spark's own bound it is sent to the rows instead of shuffling them
    first = stored(per_part.select("part", "remainder", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")).join(first_whole, "part"), "places")
    placed = rows.join(first, ["part", "remainder"]).select("key", "ids", "n", "remainder", (F.col("rank") + F.col("first")).alias("rank"), (F.col("wholes") + F.col("first_whole")).alias("whole"))
    out = ["key", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            kinds = [batch.schema.field("key").type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            made: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for doc, ids, n, remainder, rank, whole in zip(*columns, strict=True):
                cut = [(i * window, window, whole + i, 0) for i in range(n // window)]
                cut += [(n - remainder + s, m, q, o) for s, m, q, o in places.pieces(remainder, rank)] if remainder else []
                width = len(ids) // n
                for start, length, sequence, offset in cut:
                    piece = ids[start * width : (start + length) * width]
                    wide = np.frombuffer(piece, f"<u{width}").astype("<u4").tobytes()
                    made.append((doc, start, length, piece, zlib.crc32(wide), n, sequence, offset))
                if len(made) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], out)
                    made = []
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], out)

    kind = rows.schema["key"].dataType.simpleString()
    return placed.mapInArrow(run, f"key {kind}, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint").withColumnRenamed("key", key)
