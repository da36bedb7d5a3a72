"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded; filters of several widths slide over fixed-length windows; each filter's
maximum over a window feeds a softmax. A text is cut into windows from end to end, and the
mean of their log-probabilities decides. Training takes a bounded sample of labelled rows
(``Budget``), the same for the same table.

Defined results: null text, and text without a letter, is ``und`` with score 0; texts of any
length are read whole; equal texts have equal predictions, of equally likely languages the first by
name; null and repeated keys are kept as any others, a null one is never held out; without labelled
rows every text is ``und``; an empty table gives an empty result; columns may have any names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .frames import place, restore, slices, take, utf8

UNKNOWN = "und"


@dataclass(frozen=True)
class Budget:
    """Bounds of training. Languages beyond ``languages``, rarest first, are not learned."""

    languages: int = 64
    rows: int = 400  # of each language
    windows: int = 6  # of each row, spread evenly over its text
    steps: int = 500
    batch: int = 96
    window: int = 256
    seed: int = 11


class Network:
    WIDTHS, FILTERS, DIM = (2, 3, 4), 16, 8

    def __init__(self, labels: list[str], window: int, seed: int):
        rng = np.random.default_rng(seed)
        self.labels, self.window = labels, window
        wide, total = max(self.WIDTHS), self.FILTERS * len(self.WIDTHS)
        self.embed = rng.normal(0, 0.5, (256, self.DIM)).astype(np.float32)
        self.mask = np.zeros((wide * self.DIM, total), np.float32)
        for i, width in enumerate(self.WIDTHS):
            self.mask[: width * self.DIM, i * self.FILTERS : (i + 1) * self.FILTERS] = 1
        self.filters = (rng.normal(0, 0.4, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(total, np.float32)
        self.out = rng.normal(0, 0.1, (total, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def patches(self, x: np.ndarray) -> np.ndarray:
        """(windows, places, wide * DIM) of byte windows (rows)."""
        wide = max(self.WIDTHS)
        e = self.embed[x]
        flat = np.lib.stride_tricks.as_strided(e, (len(x), x.shape[1] - wide + 1, wide * self.DIM), (e.strides[0], e.strides[1], e.strides[2]))
        return np.ascontiguousarray(flat)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = self.patches(x)
        return p, (p.reshape(-1, p.shape[2]) @ self.filters).reshape(len(x), -1, len(self.bias)), self.bias

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.labels)), np.float32)
        for at in range(0, len(x), 128):
            _, h, bias = self.pooled(x[at : at + 128])
            z = np.maximum(h.max(axis=1) + bias, 0) @ self.out + self.out_bias
            z -= z.max(axis=1, keepdims=True)
            out[at : at + 128] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int, seed: int) -> "Network":
        rng = np.random.default_rng(seed)
        names = ("embed", "filters", "bias", "out", "out_bias")
        first = {n: np.zeros_like(getattr(self, n)) for n in names}
        second = {n: np.zeros_like(getattr(self, n)) for n in names}
        wide = max(self.WIDTHS)
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            xb, yb = x[pick], y[pick]
            p, h, bias = self.pooled(xb)
            where = h.argmax(axis=1)
            top = np.take_along_axis(h, where[:, None], 1)[:, 0] + bias
            act = np.maximum(top, 0)
            z = act @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(batch), yb] -= 1
            z /= batch
            back = (z @ self.out.T) * (top > 0)
            chosen = p[np.arange(batch)[:, None], where]  # (batch, filters, wide * DIM)
            to_patch = (back[:, :, None] * self.filters.T[None]).reshape(-1, self.DIM)
            bytes_at = xb[np.arange(batch)[:, None, None], where[:, :, None] + np.arange(wide)].reshape(-1)
            embed = np.stack([np.bincount(bytes_at, to_patch[:, d], 256) for d in range(self.DIM)], axis=1)
            grads = {"embed": embed, "filters": np.einsum("bf,bfk->kf", back, chosen) * self.mask, "bias": back.sum(axis=0), "out": act.T @ z, "out_bias": z.sum(axis=0)}
            for n in names:
                g = grads[n].astype(np.float32)
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                getattr(self, n)[...] -= 0.01 * (1 - step / (steps + 1)) * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
        return self


def windows(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(byte windows that cover the texts from end to end, last ones padded with 0; text of each)."""
    lengths = np.diff(offsets)
    count = np.maximum(1, -(-lengths // size))
    text = np.repeat(np.arange(len(lengths)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = offsets[text][:, None] + (number * size)[:, None] + np.arange(size)
    inside = at < offsets[text + 1][:, None]
    padded = np.concatenate([data, np.zeros(1, np.uint8)])
    return np.where(inside, padded[np.minimum(at, len(data))], 0).astype(np.uint8), text


def sample(docs: DataFrame, budget: Budget, text: str, key: str, lang: str) -> DataFrame:
    """(lang, windows binary): byte windows of at most ``rows`` rows of each of at most ``languages`` languages, by a hash of the key."""
    known = take(docs, key=key, text=text, lang=lang).withColumn("text", F.col("text").cast("string")).where("lang is not null and text is not null and key is not null").where(F.crc32(F.col("key").cast("string")) % 5 != 0).withColumn("order", F.xxhash64("key"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(budget.languages)
    # thinned by the hash to a few times what is wanted, then exactly that many
    share = F.col("order") / F.lit(2.0**64) + 0.5 <= F.lit(3.0 * budget.rows) / F.col("n") + F.lit(50.0) / F.col("n")
    thin = known.join(F.broadcast(counts), "lang").where(share)  # at most ``languages`` rows

    def cut(batches):
        for batch in batches:
            made = []
            for body in batch.column("text").to_pylist():
                raw = np.frombuffer(body.encode(), np.uint8)
                starts = np.arange(max(1, -(-len(raw) // budget.window))) * budget.window
                keep = np.unique(np.linspace(0, len(starts) - 1, budget.windows).astype(int))
                made.append(b"".join(raw[s : s + budget.window].tobytes().ljust(budget.window, b"\0") for s in starts[keep]))
            tie = [int.from_bytes(hashlib.sha256(m).digest()[:7]) for m in made]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("order"), pa.array(tie, pa.int64()), pa.array(made, pa.binary())], ["lang", "order", "tie", "windows"])

    # texts stay where they are: of each row a few windows travel
    windowed = thin.select("lang", "order", "text").mapInArrow(cut, "lang string, order bigint, tie bigint, windows binary")
    ranked = windowed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "tie")))
    return ranked.where(F.col("rank") <= budget.rows).select("lang", "windows")


def fit(docs: DataFrame, budget: Budget = Budget(), text: str = "text", key: str = "doc_id", lang: str = "lang") -> Network | None:
    # at most languages * rows * windows * window bytes
    rows = sorted((r["lang"], bytes(r["windows"])) for r in sample(docs, budget, text, key, lang).collect())
    if not rows:
        return None
    labels = sorted({name for name, _ in rows})
    xs = [np.frombuffer(body, np.uint8).reshape(-1, budget.window) for _, body in rows]
    ys = np.repeat([labels.index(name) for name, _ in rows], [len(x) for x in xs])
    return Network(labels, budget.window, budget.seed).train(np.concatenate(xs), ys, budget.steps, budget.batch, budget.seed)


def _predict(narrow: DataFrame, network: Network | None, carried: list[str]) -> DataFrame:
    """``carried``, lang_pred and score of rows with a text."""

    def run(batches):
        for batch in batches:
            for low, high in slices(batch.column("text"), 1 << 19):
                part = batch.slice(low, high - low)
                n = part.num_rows
                letter = part.column("letter").fill_null(False).to_numpy(zero_copy_only=False)
                names, scores = [UNKNOWN] * n, [0.0] * n
                if network is not None:
                    x, text = windows(*utf8(part.column("text")), network.window)
                    logs = network.log_probabilities(x)
                    mean = np.stack([np.bincount(text, logs[:, c], n) for c in range(logs.shape[1])], axis=1) / np.bincount(text, minlength=n)[:, None]
                    odds = np.exp(mean - mean.max(axis=1, keepdims=True))
                    odds /= odds.sum(axis=1, keepdims=True)
                    best = odds.argmax(axis=1)
                    names = [network.labels[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letter.tolist(), strict=True)]
                    scores = [s if ok else 0.0 for s, ok in zip(odds[np.arange(n), best].tolist(), letter.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*carried, "lang_pred", "score"])

    asked = narrow.withColumn("text", F.col("text").cast("string")).withColumn("letter", F.col("text").rlike(r"\p{L}"))
    kinds = ", ".join(f"{c} {asked.schema[c].dataType.simpleString()}" for c in carried)
    return asked.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame, network: Network | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, lang_pred, score) of every row."""
    made = _predict(take(docs, key=key, text=text), network, ["key"])
    held = F.coalesce(F.crc32(F.col("key").cast("string")) % 5 == 0, F.lit(False))
    return made.select(F.col("key").alias(key), held.alias("held_out"), "lang_pred", "score")


def known(docs: DataFrame, network: Network | None, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of at least ``least``."""
    made = _predict(take(docs, row="row", apart=text, text=text), network, ["row", "text"])
    names = docs.columns
    return restore(made.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)), "row", names, {place(names, text): F.col("text")})
