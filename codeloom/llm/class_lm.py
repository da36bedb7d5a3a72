"""Scoring of texts by a class-based n-gram model (after Brown), its classes found by exchange.

A text is its words and one end, A-Z in lower case. The probability of a token is that of its class
after the class of the token before it, times that of the word in its class:

    P(w | v) = P(class(w) | class(v)) * count(w) / count(class(w))

The end has a class of its own; a text begins after an end. Words that training lacks are one
unknown token in a class of its own, whose share is that of the words seen once (Good and Turing).
Transitions are smoothed towards the classes' own shares (Witten and Bell), so the
probabilities of all known words, the end and the unknown token sum to one after any token.

Classes come by exchange: a unit goes to the class to which its move adds most to the likelihood
of the training texts. A word that makes up SHARE of the tokens or more is a unit of its own; rarer
words are exchanged together with those of the same last bytes (ENDING of them), or all others where these are
too few. So there are at most 2 / SHARE units at any size of corpus, and what a round gathers is
bounded: for each unit, how often each class stands before and after it. Tasks count that
over their blocks, counts meet by chunks of units, and gains are computed where they met, so the driver gets
the table of classes and the units that move. In each round a part of the units is moved, and
a round that lowered the likelihood is taken back and a smaller part moved.

Texts are read once, into blocks of codes (see ``coded``), written to the shared folder. Counts of
words are exact, by the words themselves, in one shuffle of (word, block); what words count in other blocks reaches a
block grouped, so memory is bounded by its distinct words.

Defined results: null text is empty, and scored as its end alone; rows with equal or null ids are scored each on
its own; a row with null id is neither held out nor learnt from; where nothing is learnt from, the unknown
token is certain and scores are 0; texts of any length are scored whole (a task holds the longest);
an empty table gives an empty result; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .coded import LOWER, code, gathered, one_list, planes, unplaned
from .frames import stored, take

#: Least share of the tokens that makes a word a unit of its own, and bytes of the ending that rarer words share.
SHARE, ENDING = 1e-5, 2
CLASSES, ROUNDS = 64, 5
#: Pseudo-count of the unigram model.
ADDED = 0.1
TRAIN, HELD, NEITHER = 0, 1, 2


def blocks(docs: DataFrame, folds: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, keys, part, sizes, words, counts, codes), written to the shared folder. words: parted by blanks; counts: of each word in texts to learn from."""
    fold = F.crc32(F.col("key").cast("string")) % folds
    rows = take(docs, key=key, text=text).select("key", F.col("text").cast("string").alias("text"), F.when(fold == 0, HELD).when(fold > 0, TRAIN).otherwise(NEITHER).cast("int").alias("part"), F.monotonically_increasing_id().alias("row"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        def sized(batch):
            return pc.binary_length(batch.column("text")).fill_null(0).to_pylist()

        for held in gathered(batches, sized):
            codes, sizes, words = code([b.column("text") for b in held], LOWER)
            part = pa.concat_arrays([b.column("part") for b in held])
            learnt = np.repeat(part.to_numpy() == TRAIN, sizes)
            counts = np.bincount(codes[learnt], minlength=len(words))
            columns = [
                held[0].column("row").slice(0, 1),
                one_list(pa.concat_arrays([b.column("key") for b in held])),
                one_list(part),
                one_list(pa.array(sizes, pa.int32())),
                pa.array([b" ".join(words.to_pylist()).decode()], pa.string()),
                one_list(pa.array(counts, pa.int32())),
                pa.array([planes(codes)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["block", "keys", "part", "sizes", "words", "counts", "codes"])

    return stored(rows.mapInArrow(run, f"block bigint, keys array<{kind}>, part array<int>, sizes array<int>, words string, counts array<int>, codes binary"), "coded")


def vocabulary(coded: DataFrame) -> DataFrame:
    """(word, block, pos, n), written to the shared folder: the words of the texts to learn from, with their counts n.

    ``word`` stands in one row of each word; ``block`` and ``pos`` name a place in a block's list whose
    count there isn't all of n. Other places need no row. A word has a row a block at most, so words meet in one
    shuffle and no group is larger than the number of blocks.
    """
    listed = F.arrays_zip(F.split("words", " ").alias("words"), "counts")
    each = coded.where("words <> ''").select("block", F.posexplode(listed).alias("pos", "w")).select("block", "pos", F.col("w.words").cast("binary").alias("word"), F.col("w.counts").cast("long").alias("own"))
    of = Window.partitionBy("word")
    met = each.withColumn("n", F.sum("own").over(of)).withColumn("first", F.min("block").over(of) == F.col("block")).where("n > 0 and (first or n > own)")
    return stored(met.select(F.when(F.col("first"), F.col("word")).alias("word"), F.when(F.col("n") > F.col("own"), F.col("block")).alias("block"), "pos", "n"), "vocabulary")


@dataclass
class Totals:
    """Tokens and distinct tokens to learn from, ends among them, and words seen once."""

    tokens: int
    distinct: int
    ends: int
    once: int


def totals(coded: DataFrame, words: DataFrame) -> Totals:
    v = words.where("word is not null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1)).first()
    ends = coded.agg(F.coalesce(F.sum(F.size(F.filter("part", lambda p: p == TRAIN))), F.lit(0))).first()[0]
    return Totals(v[0] + ends, v[1] + (ends > 0), ends, v[2])


class Units:
    """What is exchanged: frequent words, endings of rarer words, and the rest. At most 2 / share of them.

    Unit 0 is the end, 1 the rest.
    """

    def __init__(self, words: DataFrame, total: Totals, share: float = SHARE, ending: int = ENDING):
        least = max(1.0, share * total.tokens)
        self.length, listed = ending, words.where("word is not null")
        rows = listed.where(F.col("n") >= least).orderBy(F.desc("n"), "word").select("word", "n").collect()  # at most 1 / share
        last = F.expr(f"substring(word, greatest(length(word) - {ending - 1}, 1))")
        ends = listed.where(F.col("n") < least).groupBy(last.alias("last")).agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "last")
        self.words = pa.array([bytes(r["word"]) for r in rows], pa.binary())
        self.endings = pa.array([bytes(r["last"]) for r in ends.collect()], pa.binary())  # at most 1 / share
        self.n = 2 + len(self.words) + len(self.endings)
        self.counts = np.zeros(self.n, np.int64)
        self.counts[0] = total.ends
        self.counts[2 : 2 + len(rows)] = [r["n"] for r in rows]

    def of(self, words: pa.Array) -> np.ndarray:
        own = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False)
        last = pc.index_in(pc.binary_slice(words, -self.length), value_set=self.endings).fill_null(-1).to_numpy(zero_copy_only=False)
        return np.where(own >= 0, own + 2, np.where(last >= 0, last + 2 + len(self.words), 1)).astype(np.int64)


def _flat(codes: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(values of all tokens with an end after each text, where each text begins)."""
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(starts[-1], end, codes.dtype)
    inside = np.ones(starts[-1], bool)
    inside[starts[1:] - 1] = False
    out[inside] = codes
    return out, starts[:-1]


def _listed(words: pa.Scalar) -> pa.Array:
    """The words of a block."""
    return pa.array(words.as_py().encode().split(b" ") if words.as_py() else [], pa.binary())


def _row(batch: pa.RecordBatch, i: int, *names: str) -> list[np.ndarray]:
    return [batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in names]


#: Units whose counts travel and are summed together.
TOGETHER = 512


def _tables(column: pa.Array, n: int):
    """Tables of counts, n columns each, kept as bytes."""
    for value in column:
        yield np.frombuffer(value.as_buffer(), np.int64).reshape(-1, n)


def neighbours(coded: DataFrame, units: Units, classes: np.ndarray, n: int) -> tuple[DataFrame, DataFrame]:
    """(chunk, before, after), written to the shared folder, and of it (chunk, after): how often each class stands before and after each unit in the texts to learn from.

    Units are dealt out to chunks in turn: chunk k of m holds units k, k + m, and so on, a row of n counts each. A task
    sends a row a chunk, rows of a chunk are added one by one where they meet, and none come to the driver.
    """
    number, chunks, size = units.n, -(-units.n // TOGETHER), units.n * n
    sent = coded.sparkSession.sparkContext.broadcast((units, classes))

    def run(batches):
        units, classes = sent.value
        total = None
        for batch in batches:
            for i in range(len(batch)):
                if total is None:
                    total = np.zeros((2, size), np.int64)
                sizes, part = _row(batch, i, "sizes", "part")
                unit, _ = _flat(units.of(_listed(batch.column("words")[i]))[unplaned(batch.column("codes")[i].as_py())], sizes.astype(np.int64), 0)
                learnt = np.repeat(part == TRAIN, sizes + 1)
                unit = unit.astype(np.int32)
                before = np.concatenate([np.zeros(1, np.int32), unit[:-1]])[learnt]
                unit = unit[learnt]
                total[0] += np.bincount(unit * np.int64(n) + classes[before], minlength=size)
                total[1] += np.bincount(before * np.int64(n) + classes[unit], minlength=size)
        for chunk in range(chunks) if total is not None else ():
            held = [np.ascontiguousarray(t.reshape(-1, n)[chunk::chunks]) for t in total]
            if held[0].any() or held[1].any():
                packed = [pa.array([pa.compress(h.tobytes(), "lz4", asbytes=True)], pa.binary()) for h in held]
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), *packed], ["chunk", "before", "after"])

    def add(batches):
        now, total = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([t.tobytes()], pa.binary()) for t in total)], ["chunk", "before", "after"])

        for batch in batches:
            for i, chunk in enumerate(batch.column("chunk").to_pylist()):
                if chunk != now:
                    if now is not None:
                        yield out()
                    now, total = chunk, np.zeros((2, len(range(chunk, number, chunks)) * n), np.int64)
                for t, name in zip(total, ("before", "after"), strict=True):
                    t += np.frombuffer(pa.decompress(batch.column(name)[i].as_buffer(), 8 * len(t), "lz4"), np.int64)
        if now is not None:
            yield out()

    kept = "chunk int, before binary, after binary"
    counted = coded.select("sizes", "part", "words", "codes").mapInArrow(run, kept)
    summed = stored(counted.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, kept), "neighbours")
    return summed, summed.select("chunk", "after")


def _g(x: np.ndarray) -> np.ndarray:
    """x * log(x), 0 for what isn't positive."""
    return x * np.log(np.maximum(x, 1))


def transitions(after: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of a class (row) followed by another. after: as ``neighbours`` gives it; a task sends the driver one table of classes."""
    chunks, n = -(-len(classes) // TOGETHER), int(classes.max()) + 1

    def run(batches):
        table = np.zeros((n, n), np.int64)
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), _tables(batch.column("after"), n), strict=True):
                np.add.at(table, classes[chunk::chunks], counts)
        if table.any():
            yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["counts"])

    table = np.zeros((n, n), np.int64)
    for row in after.mapInArrow(run, "counts binary").collect():  # 2 / SHARE / TOGETHER rows at most
        table += np.frombuffer(row["counts"], np.int64).reshape(n, n)
    return table


def likelihood(table: np.ndarray) -> float:
    """Log-likelihood of the classes' bigrams, without what doesn't depend on the classes."""
    table = table.astype(float)
    return float(_g(table).sum() - _g(table.sum(axis=1)).sum() - _g(table.sum(axis=0)).sum())


def _side(counts: np.ndarray, back: np.ndarray, classes: np.ndarray, table: np.ndarray, step: int = 20_000) -> np.ndarray:
    """What joining each class adds by its bigrams with the classes after the units, but itself.

    counts: of classes after each unit, back: of classes before it; table: a class followed by another. A unit's own bigrams are taken out of its class first.
    """
    out = np.zeros(counts.shape)
    unit, other = np.nonzero(counts)
    for low in range(0, len(unit), step):
        u, c = unit[low : low + step], other[low : low + step]
        x, each = counts[u, c].astype(float), np.arange(len(u))
        base = table[:, c].T.astype(float)
        left = c == classes[u]
        base[left] -= back[u[left]]  # bigrams of any class with the unit, which counted for the class it leaves
        base[each, classes[u]] -= x
        gain = _g(base + x[:, None]) - _g(base)
        gain[each, c] = 0
        first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        out[u[first]] += np.add.reduceat(gain, first)
    return out


def gains(before: np.ndarray, after: np.ndarray, classes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What it adds to the likelihood to put each unit, taken out of its class, into each class. The units' bigrams with themselves count as with their class."""
    each, own = np.arange(len(classes)), before.sum(axis=1)
    out = _side(after, before, classes, table) + _side(before, after, classes, table.T)
    both = before + after
    middle = np.tile(np.diag(table), (len(classes), 1))
    middle[each, classes] = np.maximum(middle[each, classes] - both[each, classes], 0)
    out += _g((middle + both).astype(float)) - _g(middle.astype(float))
    for sums in (table.sum(axis=1), table.sum(axis=0)):
        rest = np.tile(sums, (len(classes), 1))
        rest[each, classes] -= own
        out -= _g((rest + own[:, None]).astype(float)) - _g(rest.astype(float))
    return out


def moves(counts: DataFrame, classes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class to which each unit's move adds most, its own if none adds; the end stays. Only units that would move come to the driver."""
    chunks, n = -(-len(classes) // TOGETHER), len(table)
    sent = counts.sparkSession.sparkContext.broadcast((classes, table))

    def run(batches):
        classes, table = sent.value
        for batch in batches:
            both = zip(_tables(batch.column("before"), n), _tables(batch.column("after"), n), strict=True)
            for chunk, sides in zip(batch.column("chunk").to_pylist(), both, strict=True):
                kept, each = classes[chunk::chunks], np.arange(chunk, len(classes), chunks)
                gain = gains(*sides, kept, table)
                gain[:, n - 1] = -np.inf  # the end's
                to, rows = gain.argmax(axis=1), np.arange(len(each))
                moved = (gain[rows, to] > gain[rows, kept] + 1e-9) & (each > 0)
                yield pa.RecordBatch.from_arrays([pa.array(each[moved], pa.int32()), pa.array(to[moved], pa.int32())], ["unit", "to"])

    out = classes.copy()
    found = counts.mapInArrow(run, "unit int, to int").toArrow()  # a row a unit at most
    out[found.column("unit").to_numpy()] = found.column("to").to_numpy()
    return out


def exchange(coded: DataFrame, units: Units, n: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, counts of a class followed by another); class ``n`` is the end's."""
    classes = np.concatenate([[n], np.arange(units.n - 1) % n])
    best, part = None, 2
    deal = np.array([zlib.crc32(str(i).encode()) for i in range(units.n)])
    for turn in range(rounds + 1):
        counts, after = neighbours(coded, units, classes, n + 1)
        table = transitions(after, classes)
        value = likelihood(table)
        if best is None or value > best[0]:
            best = (value, classes, table, counts)
        else:
            part *= 2
        if turn == rounds:
            break
        _, kept, table, counts = best
        classes = np.where(deal % part == turn % part, moves(counts, kept, table), kept)
    return best[1], best[2]


@dataclass
class Model:
    units: Units
    classes: np.ndarray  # of units
    table: np.ndarray  # log10 of a class after another; the last is the unknown token's
    sizes: np.ndarray  # tokens of each class
    total: Totals


def model(units: Units, classes: np.ndarray, counts: np.ndarray, total: Totals) -> Model:
    n = len(counts)
    sizes = counts.sum(axis=0).astype(float)
    shares = np.append(sizes, total.once + 1.0) / (total.tokens + total.once + 1.0)
    seen, kinds = counts.sum(axis=1).astype(float), (counts > 0).sum(axis=1).astype(float)
    table = np.tile(shares, (n + 1, 1))
    some = np.flatnonzero(seen > 0)
    table[some] = (np.pad(counts[some], ((0, 0), (0, 1))) + kinds[some, None] * shares) / (seen + kinds)[some, None]
    with np.errstate(divide="ignore"):
        return Model(units, classes, np.log10(table), sizes, total)


def train(coded: DataFrame, words: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS, share: float = SHARE) -> Model:
    total = totals(coded, words)
    units = Units(words, total, share)
    return model(units, *exchange(coded, units, classes, rounds), total)


def _elsewhere(words: DataFrame) -> DataFrame:
    """(block, met): places in a block's list whose words occur elsewhere too, and their counts."""
    return words.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("pos", "n")).alias("met"))  # at most a block's distinct words


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", classes: int = CLASSES, rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each text; scores are log10 probabilities."""
    coded = blocks(docs, key=key, text=text)
    words = vocabulary(coded)
    made = train(coded, words, classes, rounds, share)
    total = made.total
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(made))
    kind = coded.schema["keys"].dataType.elementType.simpleString()
    names = ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        made = pickle.loads(sent.value)
        units, unknown = made.units, len(made.table) - 1
        for batch in batches:
            for i in range(len(batch)):
                sizes, part, n = _row(batch, i, "sizes", "part", "counts")
                n = n.astype(np.int64)
                own = units.of(_listed(batch.column("words")[i]))
                if batch.column("met")[i].is_valid:
                    met = batch.column("met")[i].values
                    n[met.field(0).to_numpy(zero_copy_only=False)] = met.field(1).to_numpy(zero_copy_only=False)
                n = np.append(n, total.ends)  # the end comes after the words
                known = n > 0
                of = np.where(known, made.classes[np.append(own, 0)], unknown).astype(np.int16)
                inside = np.log10(np.maximum(n, 1)) - np.log10(np.maximum(np.append(made.sizes, 1)[of], 1))
                base = np.log10((n + ADDED) / (total.tokens + ADDED * (total.distinct + 1)))
                codes, starts = _flat(unplaned(batch.column("codes")[i].as_py()), sizes.astype(np.int64), len(own))
                now = of[codes]
                before = np.concatenate([of[-1:], now[:-1]])
                token = made.table[before, now]
                token += np.where(known, inside, 0)[codes]
                columns = [
                    batch.column("keys")[i].values,
                    pa.array(part == HELD),
                    pa.array(sizes + 1, pa.int64()),
                    pa.array(np.add.reduceat(known[codes], starts, dtype=np.int64)),
                    pa.array(np.full(len(sizes), total.tokens, np.int64)),
                    pa.array(np.add.reduceat(base[codes], starts)),
                    pa.array(np.add.reduceat(token, starts)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    parts = coded.join(_elsewhere(words), "block", "left").mapInArrow(run, f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return parts.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).withColumnRenamed("key", key)
