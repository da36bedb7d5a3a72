"""Byte-level BPE: encoding to ids and decoding to bytes, over Arrow batches.

The merges come from a public rank file (one base64 token and its rank a line).
Each match of the split pattern is mapped byte by byte to printable characters and
given to the BPE model of the tokenizers library; an id list decodes through the
reversed table. A short chunk of text that was met before is looked up, not encoded anew; what
is remembered is bounded by its bytes. Rows are worked on about a megabyte at a time, and a long
text in stretches that end where no match can go on.

Defined results: null text encodes as empty text (no ids); empty text has no ids; text of any
length is encoded whole; equal rows give equal rows; of equal ranks there are none, as a rank file
names each once; null and repeated keys are kept as any others; an empty table gives an empty
result; extra columns are dropped by ``encode``, whatever their names.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers.models import BPE

from .frames import slices, strings, take

#: White space as the pattern's \s means it; Python's own \s takes four controls more.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
_BLANK = re.compile(rf"[{_SPACE}\s]")
#: A blank between white space and white space (or the end) is not the start of a piece.
_UNSAFE = re.compile(r"\s (?=\s|\Z)")


def byte_characters() -> list[str]:
    """Character of each byte: itself where printable Latin-1, else the next from U+0100 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that are merged last into ``token``."""
    parts = [token[i : i + 1] for i in range(len(token))]
    below = ranks[token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], below))
        if ranks.get(parts[best] + parts[best + 1], below) >= below:
            return None
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


class ByteBpe:
    """Encoder and decoder of one rank file. ``cache`` bounds the bytes of what is remembered."""

    #: Longer chunks are encoded each time; texts are cut into stretches of about so many characters.
    LONGEST, STRETCH = 64, 1 << 18

    def __init__(self, path: str, pattern: str, cache: int = 96 << 20):
        ranks = read_ranks(path)
        letters = byte_characters()
        self.table = str.maketrans({chr(b): c for b, c in enumerate(letters)})
        shown = lambda token: token.decode("latin-1").translate(self.table)
        merges = [(shown(h[0]), shown(h[1])) for t in sorted(ranks, key=ranks.get) if len(t) > 1 and (h := _halves(t, ranks))]
        self.model = BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        inside = pattern.replace(r"[^\s", rf"[^{_SPACE}").replace(r"\S", rf"[^{_SPACE}]").replace(r"\s", rf"[{_SPACE}]")
        self.split = regex.compile(inside)
        self.most = cache
        self.forget()
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.flat = array("i")
        self.ends = array("q", [0])

    def piece(self, text: str) -> list[int]:
        """Ids of one match of the pattern."""
        mapped = text.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table)
        return [t.id for t in self.model.tokenize(mapped)]

    def _learn(self, chunk: str) -> int:
        for match in self.split.findall(chunk):
            self.flat.extend(self.piece(match))
        self.ends.append(len(self.flat))
        at = len(self.ends) - 2
        self.held += 4 * int(self.ends[-1] - self.ends[-2]) + 8
        if len(chunk) <= self.LONGEST:
            self.known[chunk] = at
            self.held += 100 + len(chunk)  # the entry, the string and its number
        return at

    def stretches(self, text: str):
        """Parts of a text that are encoded on their own: a match starts at a blank after something that is not white space."""
        at = 0
        while len(text) - at > self.STRETCH:
            cut = text.find(" ", at + self.STRETCH)
            while cut >= 0 and _BLANK.match(text[cut - 1]):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:] if at else text

    def chunks(self, text: str) -> list[str]:
        """Stretches that never share a match: cut before blanks, where that is safe."""
        if not text:
            return []
        if _UNSAFE.search(text):
            return self.split.findall(text)
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)] if first else [" " + x for x in rest]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        made, counts, total = [np.zeros(0, np.int32)], [0], 0
        at: list[int] = []
        marks: list[int] = []  # how many of ``at`` each finished text has

        def flush() -> None:
            nonlocal total
            where = np.asarray(at, np.int64)
            ends = np.frombuffer(self.ends, np.int64)  # views: gone before the arrays grow again
            ids, offsets = gather(np.frombuffer(self.flat, np.int32) if self.flat else np.zeros(0, np.int32), ends[where], ends[where + 1] - ends[where])
            made.append(ids)
            counts.extend((offsets[np.asarray(marks, np.int64)] + total).tolist())
            total += len(ids)
            at.clear(), marks.clear()

        for text in texts:
            for part in self.stretches(text or ""):
                get, learn = self.known.get, self._learn
                at += [learn(c) if (i := get(c)) is None else i for c in self.chunks(part)]
                if self.held > self.most or len(at) > 4 * self.STRETCH:
                    flush()
                    if self.held > self.most:
                        self.forget()
            marks.append(len(at))
        flush()
        return np.concatenate(made), np.asarray(counts)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all id lists, offsets)."""
        data, ends = gather(self.bytes, self.starts[ids], self.lengths[ids])
        return data, ends[offsets]

    def places(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First code point of its text that each token touches, and the one after its last; tokens that split a character share it."""
        data, ends = gather(self.bytes, self.starts[ids], self.lengths[ids])
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        begun, done = lead[np.minimum(ends[:-1] + 1, len(data))] - 1, lead[ends[1:]]
        first = np.repeat(lead[ends[offsets[:-1]]], np.diff(offsets))
        return begun - first, done - first

    def character_spans(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """``places`` of one text's ids."""
        return list(zip(*(v.tolist() for v in self.places(ids, np.array([0, len(ids)]))), strict=True))


def gather(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """source[s : s + n] of all (s, n), one after another, and their offsets."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    index = np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])
    return source[index], ends


def complete(data: bytes) -> tuple[str, bytes]:
    """Text of a decoded run and the bytes of a character that it splits, to be put before the next run."""
    for back in range(1, min(4, len(data) + 1)):
        lead = data[-back]
        if lead >= 0xC0:
            if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                return data[:-back].decode("utf-8", "replace"), data[-back:]
            break
        if lead < 0x80:
            break
    return data.decode("utf-8", "replace"), b""


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> ByteBpe:
    """One codec a worker process."""
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", offsets: bool = False) -> DataFrame:
    """(key, ids array<int>) of every row; ``offsets`` adds starts and ends (array<int>), the code points that each id touches."""
    told = offsets

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            for low, high in slices(batch.column("text")):
                part = batch.slice(low, high - low)
                ids, offsets = bpe.encode(strings(part, "text"))
                lists = [ids, *(bpe.places(ids, offsets) if told else ())]
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, pa.int32())) for v in lists)], ["key", *("ids", "starts", "ends")[: len(lists)]])

    narrow = take(docs, key=key, text=text).withColumn("text", F.col("text").cast("string"))
    kinds = "ids array<int>" + (", starts array<int>, ends array<int>" if told else "")
    return narrow.mapInArrow(run, f"key {narrow.schema['key'].dataType.simpleString()}, {kinds}").withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of each id list; a null list gives null."""
    names = encoded.columns

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            sizes = batch.column(names.index(ids)).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            low = 0
            while low < batch.num_rows:  # lists of about a million ids at a time
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + (1 << 20), side="right")) - 1)
                part = batch.slice(low, high - low)
                low = high
                lists = part.column(names.index(ids))
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                own = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                got, at = bpe.decode(flat, np.concatenate([[0], np.cumsum(own)]))
                whole = got.tobytes()
                made = [None if gone else whole[a:b] for gone, a, b in zip(lists.is_null().to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], [*names, data])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{kinds}, `{data}` binary")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode, and describe both by digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    encoded = encode(docs, path, pattern).select("doc_id", F.col("ids"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"))
    return decode(encoded, path, pattern).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
