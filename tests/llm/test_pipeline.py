"""The stages one after another, as one query, against plain forms, and on odd tables."""

import math
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codeloom.llm import frames, langid, secrets

from . import brute
from .conftest import SCHEMA

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, sizes = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    whole = corpus_pipeline.run(spark, SF)
    order = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(order).collect())) == sorted(map(tuple, docs.select(order).collect()))


def plain_language(network, text):
    """(language, score) by loops over windows, filters and places."""
    if text is None or not re.search(r"[^\W\d_]", text):
        return "und", 0.0
    raw, total = text.encode(), np.zeros(len(network.labels))
    starts = range(0, max(1, len(raw)), network.window)
    for start in starts:
        window = raw[start : start + network.window].ljust(network.window, b"\0")
        features = []
        for f in range(len(network.bias)):
            width = network.WIDTHS[f // network.FILTERS]
            weights = network.filters[: width * network.DIM, f].reshape(width, network.DIM).astype(float)
            # places are as many as the widest filter has
            best = max(sum(float(weights[k] @ network.embed[window[at + k]]) for k in range(width)) for at in range(network.window - max(network.WIDTHS) + 1))
            features.append(max(0.0, best + float(network.bias[f])))
        z = [sum(a * float(w) for a, w in zip(features, network.out[:, c], strict=True)) + float(network.out_bias[c]) for c in range(len(network.labels))]
        top = max(z)
        norm = top + math.log(sum(math.exp(v - top) for v in z))
        total += np.array(z) - norm
    mean = total / len(starts)
    odds = np.exp(mean - mean.max())
    return network.labels[int(mean.argmax())], float(odds.max() / odds.sum())


def test_network_against_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    network = langid.fit(docs)
    asked = docs.where("length(text) < 600").orderBy("doc_id").limit(12).unionByName(docs.limit(1).withColumn("text", F.lit("12 ?")))
    texts = [r["text"] for r in asked.collect()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in langid.identify(frame, network).collect():
        name, score = plain_language(network, texts[r["doc_id"]])
        assert r["lang_pred"] == name and abs(r["score"] - score) < 1e-3


def test_stages_against_plain_forms(spark, docs, hard_texts):
    """Each stage but the first on its own input, by brute force."""
    own = spark.read.parquet(f"{SF}/documents.parquet")
    frame = own.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100_000))
    stages = dict(corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r["text"] for r in frame.collect()}
    ids = sorted(rows)
    links = brute.links([rows[i] for i in ids])
    want = {i for k, i in enumerate(ids) if links[k][0] == k}
    near = stages["near_duplicates"](spark, frame, SF)
    assert {r["doc_id"] for r in near.collect()} == want
    cut = {r["doc_id"]: r for r in stages["repeated_passages"](spark, frame, SF).collect()}
    for i, (n, gone, digest) in zip(ids, brute.without_repeats([rows[i] for i in ids]), strict=True):
        assert (i in cut) == (n > gone or gone == 0)
        if i in cut and gone:
            assert brute.without_repeats([cut[i]["text"]], 1 << 30)[0][2] == digest and cut[i]["n_chars"] == len(cut[i]["text"])
        elif i in cut:
            assert cut[i]["text"] == rows[i]
    hidden = {r["doc_id"]: r["text"] for r in stages["secret_scan"](spark, frame, SF).collect()}
    assert hidden == {i: t if t is None else secrets.hidden(t, secrets.find(t)) for i, t in rows.items()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = {r["doc_id"]: r["n"] for r in stages["packing"](spark, frame, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert packed == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows.items()}


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_odd_tables(spark, tmp_path, hard_texts, kind):
    """Nulls in every column, repeated rows and ids, clashing columns; and a table without rows."""
    rows = [(None if i % 5 == 0 else i // 2, t, "en" if i % 3 else None, None, None, i, "x") for i, t in enumerate(hard_texts + hard_texts)]
    frame = spark.createDataFrame(rows if kind == "odd" else [], SCHEMA + ", row int, kept string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    before = frames.written()
    made = corpus_pipeline.run(spark, str(tmp_path))
    # of what was stored, the last stage's input and what packing needs are left
    assert (made.count() > 0) == (kind == "odd") and frames.written() - before <= 3
