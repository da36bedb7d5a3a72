"""Texts as numbers: blocks of documents whose words are codes into a list of the block's own distinct words.

A block holds about BLOCK_BYTES of text, or one longer document. Its codes go by falling count, so
most are small; they are kept byte plane by byte plane, which packs well in Parquet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .frames import utf8
from .hashing import BLANK, words

BLOCK_BYTES = 6 << 20


def code(columns: list[pa.Array], kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes of all words in order, words of each text, distinct words) of columns of texts.

    kept: what each byte of a text becomes; words are what stands between blanks after that.
    """
    parts = [utf8(c) for c in columns]
    data = kept[np.concatenate([d for d, _ in parts])]
    lengths = np.concatenate([np.diff(o) for _, o in parts])
    starts, ends, first = words(data, np.concatenate([[0], np.cumsum(lengths)]))
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    letters = data[~BLANK[data]]
    listed = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    codes = listed.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(-np.bincount(codes, minlength=len(listed.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return rank[codes], np.diff(first), listed.dictionary.take(pa.array(order)).cast(pa.binary())


#: What bytes become for ``code``: A-Z in lower case, all else as it is.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def planes(codes: np.ndarray) -> bytes:
    return np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplaned(kept: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(kept, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def gathered(batches, sized, most: int = BLOCK_BYTES):
    """Lists of slices of record batches that make up a block each. sized: batch -> bytes of each row."""
    held, size = [], 0
    for batch in batches:
        at, weights = 0, sized(batch)
        for i, w in enumerate(weights):
            if size and size + w > most:
                if i > at:
                    held.append(batch.slice(at, i - at))
                yield held
                held, size, at = [], 0, i
            size += w
        if at < len(weights):
            held.append(batch.slice(at))
    if held:
        yield held


def one_list(column: pa.Array) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
