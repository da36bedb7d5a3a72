"""Whitening, class-based scoring and ranked search against plain forms."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import class_lm, coded, lexical, queries, whitening

from .. import oracle

SF = "/root/testdata/sf0.001"


# whitening


def whole(v):
    return None if v is None or any(c is None or not math.isfinite(c) for c in v) else tuple(math.floor(256 * float(c)) for c in v)


def check_whitening(rows, got, components=4):
    kept = [(k, x) for k, v in rows if (x := whole(v)) is not None]
    listed = np.array(sorted({x for _, x in kept}), float)
    n, sums = len(listed), [sum(int(r[d]) for r in listed) for d in range(listed.shape[1])]
    cov = (listed - listed.mean(axis=0)).T @ (listed - listed.mean(axis=0)) / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, len(values))
    assert len(got) == len(kept) * k and {r["component"] for r in got} == set(range(1, k + 1))
    signs = {}
    want = {(key, j): (sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), float((np.array(x) - listed.mean(axis=0)) @ vectors[:, j - 1] / math.sqrt(values[j - 1]))) for key, x in kept for j in range(1, k + 1)}
    for r in got:
        deviation, value = want[r["vec_id"], r["component"]]
        sign = signs.setdefault(r["component"], 1 if r["whitened"] * value > 0 else -1) if abs(value) > 1e-6 else 1
        assert r["n"] == n and r["deviation"] == deviation and r["whitened"] == pytest.approx(sign * value, rel=1e-6, abs=1e-6)
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / cov.trace(), rel=1e-6) and r["identity_error"] < 1e-6


VECTORS = "vec_id bigint, embedding array<float>, label int"


def test_whitening_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(rows, queries.op11_whitening(spark, SF).collect())


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(np.float32(c)) for c in rng.normal(3, s, 6)]) for i, s in enumerate([0.1, 1, 5] * 20)]
    rows = [*good, *((100 + i, v) for i, (_, v) in enumerate(good[:20])), (None, good[3][1]), (5, None), (6, [None] * 6), (7, [math.nan] + [0.0] * 5), (8, [math.inf] * 6), (9, [])]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], VECTORS).repartition(5).withColumnRenamed("label", "X").select("*", F.lit(1).alias("x"), F.lit(2).alias("component"))
    got = whitening.whiten(df).collect()
    check_whitening([r for r in rows if r[1] != []], got)


def test_whitening_without_variance(spark):
    flat = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0), (2, [1.0, 2.0, 3.0], 0)], VECTORS)
    got = whitening.whiten(flat).collect()
    assert len(got) == 6 and all(r["whitened"] is None and r["explained"] is None and r["n"] == 1 and r["deviation"] == 0 for r in got)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], 0) for i in range(9)], VECTORS)
    got = whitening.whiten(line).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) and r["identity_error"] < 1e-9 for r in got)
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0


def test_whitening_of_several_lengths_and_large_entries(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 1, 3 + i % 2).tolist()) for i in range(60)]
    got = whitening.whiten(spark.createDataFrame([(k, v, 0) for k, v in rows], VECTORS)).collect()
    for d in (3, 4):
        own = [(k, np.float32(v).tolist()) for k, v in rows if len(v) == d]
        check_whitening(own, [r for r in got if r["vec_id"] in dict(own)])
    large = spark.createDataFrame([(i, [1e14 * i, 3.0], 0) for i in range(4)] + [(9, [3e38, 1.0], 0)], "vec_id bigint, embedding array<double>, label int")
    got = whitening.whiten(large).collect()
    assert {r["vec_id"] for r in got} == {0, 1, 2, 3} and all(r["deviation"] is None for r in got)


def test_moments_merge_in_any_order():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(1e6, 50, (500, 5)))
    parts = np.split(x, [1, 7, 200, 350])
    for order in ([0, 1, 2, 3, 4], [4, 2, 0, 3, 1]):
        total = {}
        for i in order:
            total = whitening.merged(total, {5: whitening.moments(parts[i], parts[i].astype(np.int64))})
        m = total[5]
        assert m.n == 500 and list(m.sums) == [int(s) for s in x.sum(axis=0)]
        assert np.allclose(m.scatter, np.cov(x.T, bias=True) * 500, rtol=1e-9) and np.allclose(m.mean, x.mean(axis=0), rtol=1e-14)


# scoring


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + [None]


def fold(key):
    return None if key is None else zlib.crc32(str(key).encode()) % 10


def check_scores(rows, got):
    """All but the model's own score, against plain counts; rows may share ids."""
    counts = Counter(w for k, t in rows if fold(k) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(k), fold(k) == 0, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for k, t in rows for ws in [tokens(t)])
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want


def test_base_scores(spark, docs, hard_texts, unnamed, clashing, empty):
    rows = list(enumerate(hard_texts))
    got = class_lm.score(docs, rounds=1).collect()
    check_scores(rows, got)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    check_scores([(None if i % 2 else 7, t) for i, t in rows], class_lm.score(unnamed, rounds=1).collect())
    assert sorted(map(str, class_lm.score(clashing, rounds=1).collect())) == sorted(map(str, got))
    assert class_lm.score(empty).count() == 0


def test_nothing_to_learn_from(spark):
    held = [i for i in range(100) if fold(i) == 0][:3]
    got = class_lm.score(spark.createDataFrame([(i, t) for i, t in zip(held, ["a b", None, "c"], strict=True)], "doc_id bigint, text string")).collect()
    assert all(r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0 and r["base_score"] == 0 for r in got)


def plain_score(rows, classes):
    """Scores from classes of words, by dictionaries."""
    train = [tokens(t) for k, t in rows if fold(k)]
    counts = Counter(w for ws in train for w in ws)
    once = sum(n == 1 for w, n in counts.items() if w is not None)
    pairs, firsts, sizes = Counter(), Counter(), Counter()
    for ws in train:
        for a, b in zip([None, *ws], ws):
            pairs[classes[a], classes[b]] += 1
            firsts[classes[a]] += 1
        sizes.update(classes[w] for w in ws)
    kinds = Counter(a for a, _ in pairs)
    n = sum(counts.values())
    share = lambda c: ((once + 1) if c == "?" else sizes[c]) / (n + once + 1)
    of = lambda w: classes[w] if counts[w] else "?"

    def after(a, b):
        return share(b) if not firsts[a] else (pairs[a, b] + kinds[a] * share(b)) / (firsts[a] + kinds[a])

    out = []
    for _, t in rows:
        ws = tokens(t)
        out.append(sum(math.log10(after(of(a), of(b)) * (counts[b] / sizes[of(b)] if counts[b] else 1)) for a, b in zip([None, *ws], ws)))
    return out, after, set(classes.values()) | {"?"}


@pytest.mark.parametrize("share", [1e-5, 0.02])
def test_scores_follow_the_model(spark, share):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words[: 1 + rng.randrange(30)]) for _ in range(rng.randrange(60))) + f" rare{i} Ünik{i % 7}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    made = class_lm.blocks(docs)
    listed = class_lm.vocabulary(made)
    model = class_lm.train(made, listed, 5, 3, share)
    assert model.units.n <= 2 / share + 2
    known = [bytes(r["word"]) for r in listed.where("word is not null").collect()]
    classes = {w.decode(): int(c) for w, c in zip(known, model.classes[model.units.of(pa.array(known, pa.binary()))], strict=True)} | {None: 5}
    want, after, names = plain_score(rows, classes)
    got = {r["doc_id"]: r for r in class_lm.score(docs, classes=5, rounds=3, share=share).collect()}
    assert [got[i]["score"] for i, _ in rows] == pytest.approx(want, rel=1e-9)
    assert all(r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"])) for r in got.values())
    for a in names:
        assert sum(after(a, b) for b in names) == pytest.approx(1)


def test_exchange_finds_kinds_of_words(spark):
    """Words of two kinds that alternate come into classes of their own, and the likelihood never falls."""
    rng = random.Random(5)
    a, b = [f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)]
    rows = [(i, " ".join(w for _ in range(20) for w in (rng.choice(a), rng.choice(b)))) for i in range(80)]
    made = class_lm.blocks(spark.createDataFrame(rows, "doc_id bigint, text string"))
    words = class_lm.vocabulary(made)
    units = class_lm.Units(words, class_lm.totals(made, words))
    start = np.concatenate([[2], np.arange(units.n - 1) % 2])
    before = class_lm.likelihood(class_lm.transitions(class_lm.neighbours(made, units, start, 3)[1], start))
    classes, table = class_lm.exchange(made, units, 2, 8)
    assert class_lm.likelihood(table) > before
    kinds = defaultdict(set)
    for w in (*a, *b):
        kinds[w[0]].add(int(classes[units.of(pa.array([w.encode()]))[0]]))
    assert all(len(k) == 1 for k in kinds.values()) and kinds["a"] != kinds["b"]


def test_counts_of_the_exchange_stay_off_the_driver(spark, monkeypatch):
    """Counts of units are summed, and gains computed, in chunks of units on the executors; chunks of any size give the same classes."""
    rng = random.Random(8)
    names = [f"w{i}" for i in range(40)]
    made = class_lm.blocks(spark.createDataFrame([(i, " ".join(rng.choices(names, range(1, 41), k=30))) for i in range(120)], "doc_id bigint, text string").repartition(3))
    units = class_lm.Units(class_lm.vocabulary(made), class_lm.totals(made, class_lm.vocabulary(made)))
    start = np.concatenate([[5], np.arange(units.n - 1) % 5])
    whole = class_lm.exchange(made, units, 5, 3)
    monkeypatch.setattr(class_lm, "TOGETHER", 7)
    counts = class_lm.neighbours(made, units, start, 6)[0]
    assert counts.count() == -(-units.n // 7) and counts.select(F.max(F.length("before"))).first()[0] <= 7 * 6 * 8
    parted = class_lm.exchange(made, units, 5, 3)
    assert (parted[0] == whole[0]).all() and (parted[1] == whole[1]).all()
    # against counts made here, text by text
    want = np.zeros((2, units.n, 6), np.int64)
    for row in made.collect():
        of, codes, at = units.of(pa.array(row["words"].encode().split(b" "), pa.binary())), coded.unplaned(bytes(row["codes"])), 0
        for part, size in zip(row["part"], row["sizes"], strict=True):
            line = [0, *of[codes[at : at + size]].tolist(), 0]
            at += size
            for v, w in zip(line, line[1:]) if part == class_lm.TRAIN else ():
                want[0, w, start[v]] += 1
                want[1, v, start[w]] += 1
    got, m = np.zeros_like(want), -(-units.n // 7)
    for row in counts.collect():
        for side, name in enumerate(("before", "after")):
            got[side, row["chunk"] :: m] = np.frombuffer(row[name], np.int64).reshape(-1, 6)
    assert (got == want).all()


def test_gains_are_differences_of_likelihood():
    rng = np.random.default_rng(6)
    n, u = 4, 9
    flow = rng.integers(0, 6, (u, u))
    np.fill_diagonal(flow, 0)  # a unit's bigrams with itself are taken for ones with its class
    classes = rng.integers(0, n, u)

    def table(of):
        out = np.zeros((n, n), np.int64)
        np.add.at(out, (of[:, None], of[None, :]), flow)
        return out

    before = np.stack([np.bincount(classes, flow[:, w], n) for w in range(u)]).astype(np.int64)
    after = np.stack([np.bincount(classes, flow[w], n) for w in range(u)]).astype(np.int64)
    # margins of a unit must agree, as in a corpus
    gain = class_lm._side(after, before, classes, table(classes)) + class_lm._side(before, after, classes, table(classes).T)
    for w in range(u):
        for b in range(n):
            to = classes.copy()
            to[w] = b
            cells = lambda t: class_lm._g(t.astype(float)).sum()
            off = gain[w, b] - gain[w, classes[w]]
            t0, t1 = table(classes), table(to)
            a = classes[w]
            diag = sum(class_lm._g(np.array([float(t1[x, x])]))[0] - class_lm._g(np.array([float(t0[x, x])]))[0] for x in {a, b})
            assert off == pytest.approx(cells(t1) - cells(t0) - diag)


def test_held_out_texts_score_better_than_by_single_words(spark):
    got = queries.op12_class_lm(spark, SF).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


# search


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(rows, items, k=50):
    listed = [(i, Counter(plain_terms(t))) for i, t in rows]
    listed = [(i, c) for i, c in listed if c]
    n, length = len(listed), sum(sum(c.values()) for _, c in listed)
    df = Counter(w for _, c in listed for w in c)
    asked = defaultdict(set)
    for item, t in items:
        if item is not None:
            asked[item] |= set(plain_terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for i, c in listed:
            m = 50 + (50 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in words if c[w])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_search(docs, unnamed, clashing, empty, spark, hard_texts):
    items = [(1, hard_texts[0]), (2, "the THE The"), (3, None), (4, "nothing-like.this"), (5, hard_texts[-3]), (None, "the"), (6, "an er"), (6, "th"), (7, "é 😀 two")]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    for k in (50, 3):
        assert found(lexical.search(lexical.index(docs), asked, k)) == plain_search(list(enumerate(hard_texts)), items, k)
    assert found(lexical.search(lexical.index(unnamed), asked)) == plain_search([(None if i % 2 else 7, t) for i, t in enumerate(hard_texts)], items)
    assert found(lexical.search(lexical.index(clashing), asked.withColumn("term", F.lit(1)))) == plain_search(list(enumerate(hard_texts)), items)
    assert lexical.search(lexical.index(empty), asked).count() == 0 and lexical.search(lexical.index(docs), asked.limit(0)).count() == 0


def test_search_against_sql(spark):
    con = oracle.connect(SF)
    assert oracle.spark_rows(queries.QUERIES["op13_ranked_search"](spark, SF)) == oracle.duck_rows(con, lexical.SEARCH_SQL)


def test_search_in_several_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 3)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(words[min(int(rng.expovariate(0.02)), 299)] for _ in range(n))
    rows = [(i, text(rng.randrange(1, 80))) for i in range(700)]
    items = [(i, text(8)) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert found(lexical.search(lexical.index(df), spark.createDataFrame(items, "item_id bigint, text string"), 7)) == plain_search(rows, items, 7)


def test_search_stops_early_and_stays_exact():
    rng = np.random.default_rng(8)
    n, k = 5000, 10
    postings = []
    for df in (15, 60, 400, 3000, 4500):
        d = np.sort(rng.choice(n, df, replace=False))
        postings.append((d, rng.integers(1, 1000, df)))
    order = [np.lexsort((d, -i)) for d, i in postings]
    groups = [(i[o], d[o]) for (d, i), o in zip(postings, order, strict=True)]
    asked = {0: 5000, 1: 3000, 2: 900, 3: 40, 4: 5}
    flat = np.concatenate([d for _, d in groups])
    by = np.argsort(flat, kind="stable")
    begin = np.searchsorted(flat[by], np.arange(n + 1))
    forward = (begin, np.repeat(np.arange(5), [len(d) for _, d in groups])[by], np.concatenate([i for i, _ in groups])[by])
    counted = {}
    docs, scores = lexical.best_of_shard(asked, groups, forward, n, np.arange(n), k, counted)
    whole_scores = np.zeros(n, np.int64)
    for t, (i, d) in enumerate(groups):
        whole_scores[d] += asked[t] * i
    want = np.lexsort((np.arange(n), -whole_scores))[:k]
    assert docs.tolist() == want.tolist() and scores.tolist() == whole_scores[want].tolist()
    assert counted["gone through"] < 0.5 * len(flat)


def test_codes_of_blocks():
    codes, sizes, words = coded.code([pa.array(["B a\tb", None]), pa.array(["c b"])], coded.LOWER)
    assert [words[int(c)].as_py() for c in codes] == [b"b", b"a", b"b", b"c", b"b"] and sizes.tolist() == [3, 0, 2] and codes[0] == 0
    assert coded.unplaned(coded.planes(codes)).tolist() == codes.tolist()
