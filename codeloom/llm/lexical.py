"""Ranked lexical search over an impact-ordered index, score at a time.

The index is dealt in shards of documents (about SHARD_BYTES of text). For each term of a shard it
holds the postings grouped by their exact impact, highest first: an impact depends on how often
the term occurs in the document and on the document's length against the mean, all in whole numbers; what a
term is worth in the whole collection is the same for all its postings and is multiplied in when a
question comes. So whatever the question, a term's groups are in order of what they add to a score.

Questions are asked in blocks of ITEMS. The postings of a block's terms meet by shard. A task
works through them in falling order of impact, all terms of a question side by side, level by
level, and adds up what documents have got so far. The highest impacts left, summed over the
terms, bound what any document can still get. When that is less than what separates the last of the best from
documents not among CANDIDATES, no other can come in: the candidates' scores are completed from the postings by
document, and the best of the shard are told. The best of all shards are the result; nothing is estimated.

Defined results: null text has no terms; a document without terms ranks nowhere and doesn't count; rows with equal
ids are ranked each by itself (equal scores of equal ids in any order, they look the same), null ids after
others of equal score; a question without terms, or whose terms no document has, has no rows; questions with equal
ids are one question of all their terms, of null id none; texts of any length are indexed whole; an empty
collection or no question gives no rows; other columns are dropped, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .coded import code, gathered
from .frames import slices, stored, take, utf8
from .hashing import words

#: ASCII letters and digits and all else beyond ASCII are of terms; A-Z in lower case, what parts them a blank.
TERM = np.array([i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256)], np.uint8)
SHARD_BYTES = 16 << 20
ITEMS = 256
#: Documents of a shard among which the best must be before their scores are completed, as a multiple of the best asked for.
CANDIDATES = 4
#: Each level goes down to this share of the impact that the one before stopped at.
STEP = 0.75
#: Fixed values of the score: scale of an impact, weight of the length, scale of a term's worth.
TOP, TF, LENGTH, B, WORTH = 1_000_000_000, 1000, 20, 50, 1000


@dataclass
class Index:
    """postings: (shard, term, impacts, sizes, docs, ids): groups of a term by falling impact, documents by place in ``ids`` of the shard's row whose term is empty.

    n: documents with a term; length: all their terms.
    """

    postings: DataFrame
    n: int
    length: int


def _lengths(docs: DataFrame, text: str) -> tuple[int, int]:
    """(documents with a term, their terms) of all."""

    def run(batches):
        n = length = 0
        for batch in batches:
            for low, high in slices(batch.column("text"), SHARD_BYTES // 4):
                data, offsets = utf8(batch.column("text").slice(low, high - low))
                sizes = np.diff(words(TERM[data], offsets)[2])
                n, length = n + int((sizes > 0).sum()), length + int(sizes.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([length], pa.int64())], ["n", "length"])

    each = take(docs, text=text).select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n bigint, length bigint")
    row = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    return row[0], row[1]


def _grouped(codes: np.ndarray, sizes: np.ndarray, total: tuple[int, int]):
    """(impact, term, document) of each posting, by term, falling impact and document."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    pairs, tf = np.unique(codes.astype(np.int64) * len(sizes) + doc, return_counts=True)
    term, doc = pairs // len(sizes), pairs % len(sizes)
    n, length = total
    # in Python's numbers, as sizes * n can be large
    m = np.array([100 - B + (B * s * n) // length if s else 0 for s in sizes.tolist()], np.int64)
    impact = (TOP * tf) // (TF * tf + LENGTH * m[doc])
    order = np.lexsort((doc, -impact, term))
    return impact[order], term[order], doc[order]


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of all rows, written to the shared folder in order of the terms."""
    total = _lengths(docs, text)
    rows = take(docs, key=key, text=text).select(F.col("key").cast("long").alias("key"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))

    def run(batches):
        def sized(batch):
            return pc.binary_length(batch.column("text")).fill_null(0).to_pylist()

        for held in gathered(batches, sized, SHARD_BYTES):
            codes, sizes, listed = code([b.column("text") for b in held], TERM)
            ids = pa.concat_arrays([b.column("key") for b in held])
            impact, term, doc = _grouped(codes, sizes, total)
            new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (impact[1:] != impact[:-1])])) if len(term) else np.zeros(0, np.int64)
            group_sizes = np.diff(np.append(new, len(term)))
            by_term = np.searchsorted(term[new], np.arange(len(listed) + 1))
            docs_at = np.append(new, len(term))[by_term]
            shard = held[0].column("row")[0].as_py()
            lists = [
                pa.ListArray.from_arrays(pa.array(by_term, pa.int32()), pa.array(impact[new], pa.int64())),
                pa.ListArray.from_arrays(pa.array(by_term, pa.int32()), pa.array(group_sizes, pa.int32())),
                pa.ListArray.from_arrays(pa.array(docs_at, pa.int32()), pa.array(doc, pa.int32())),
            ]
            names = ["shard", "term", "impacts", "sizes", "docs", "ids"]
            own = pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([b""], pa.binary()), *(pa.nulls(1, a.type) for a in lists), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], names)
            yield own
            for low in range(0, len(listed), 20_000):
                part = slice(low, low + 20_000)
                n = len(listed[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), listed[part], *(a[part] for a in lists), pa.nulls(n, pa.list_(pa.int64()))], names)

    made = rows.mapInArrow(run, "shard bigint, term binary, impacts array<bigint>, sizes array<int>, docs array<int>, ids array<bigint>")
    return Index(stored(made.sortWithinPartitions("term", "shard"), "postings"), *total)


def questions(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term): the terms of each question, once each."""
    rows = take(items, key=key, text=text).select(F.col("key").cast("long").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null")

    def run(batches):
        for batch in batches:
            codes, sizes, listed = code([batch.column("text")], TERM)
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), listed.take(pa.array(codes))], ["item", "term"])

    return rows.mapInArrow(run, "item bigint, term binary").distinct()


def _completed(docs: np.ndarray, postings: tuple[np.ndarray, np.ndarray, np.ndarray], worth: dict[int, int]) -> np.ndarray:
    """Whole scores of some documents. postings: where each document's begin, their terms, their impacts."""
    begin, term, impact = postings
    sizes = begin[docs + 1] - begin[docs]
    at = np.repeat(begin[docs] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    asked = np.fromiter(worth, np.int64, len(worth))
    place = np.minimum(np.searchsorted(asked, term[at]), len(asked) - 1)
    gain = np.where(asked[place] == term[at], np.fromiter(worth.values(), np.int64, len(worth))[place] * impact[at], 0)
    out = np.zeros(len(docs), np.int64)
    np.add.at(out, np.repeat(np.arange(len(docs)), sizes), gain)
    return out


def best_of_shard(asked: dict[int, int], groups: list[tuple[np.ndarray, np.ndarray]], by_document, n_docs: int, ids: np.ndarray, k: int, counted: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the ``k`` best of a question in a shard, in order.

    asked: worth of each term, by rising number; groups: (impact of each posting, documents) of each
    term of the shard, by falling impact. ``counted`` gets how many postings were gone through.
    """
    lists = [(worth * groups[t][0], groups[t][1]) for t, worth in asked.items()]
    got, at = np.zeros(n_docs, np.int64), [0] * len(lists)
    left = [int(i[0]) for i, _ in lists]  # the highest impact of each term not gone through yet
    level, candidates = max(left, default=0), None
    while any(left):
        level = min(int(level * STEP), max(left))
        taken = []
        for j, (impacts, docs) in enumerate(lists):
            if left[j] >= level and left[j]:
                end = len(impacts) - int(np.searchsorted(impacts[::-1], level, side="left"))  # whole groups of one impact
                taken.append((docs[at[j] : end], impacts[at[j] : end]))
                at[j], left[j] = end, int(impacts[end]) if end < len(impacts) else 0
        np.add.at(got, np.concatenate([d for d, _ in taken]), np.concatenate([i for _, i in taken]))
        if n_docs > k and any(left):
            last = int(np.partition(got, n_docs - k)[n_docs - k])
            bound = sum(left)
            if last > bound:  # no document without points can come in
                near = np.flatnonzero(got + bound >= last)
                if len(near) <= CANDIDATES * k:
                    candidates = near
                    break
    if counted is not None:
        counted["gone through"] = counted.get("gone through", 0) + sum(at)
    if candidates is None:
        candidates = np.flatnonzero(got)
        scores = got[candidates]
    else:
        scores = _completed(candidates, by_document, asked)
    kept = scores > 0
    candidates, scores = candidates[kept], scores[kept]
    order = np.lexsort((ids[candidates], -scores))[:k]
    return candidates[order], scores[order]


def search(index: Index, items: DataFrame, k: int = 50, key: str = "item_id", text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(key, rank, doc, score): the ``k`` best documents of each question, equal scores by rising id."""
    asked = stored(questions(items, key, text), "questions")
    found = index.postings.select("term", F.size("docs").alias("n")).join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
    worth = F.floor(F.lit(float(WORTH)) * F.log(F.lit(float(2 * index.n + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    blocks = asked.select("item").distinct().withColumn("block", F.pmod(F.xxhash64("item"), F.lit(_blocks(asked))))
    placed = asked.join(blocks, "item")
    # the questions of a block are bounded, so is the list of those that hold a term; the empty term brings a shard's ids
    wanted = placed.groupBy("block", "term").agg(F.collect_list("item").alias("items")).join(found.withColumn("worth", worth), "term").select("block", "term", "items", "worth")
    wanted = wanted.unionByName(placed.select("block").distinct().select("block", F.lit(b"").alias("term"), F.array().cast("array<bigint>").alias("items"), F.lit(0).cast("long").alias("worth")))
    met = index.postings.join(wanted, "term")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        named = table.column("term").to_pylist()
        own = named.index(b"")
        ids = table.column("ids")[own].values
        # null ids after all others
        ids_at = np.where(ids.is_null(), np.iinfo(np.int64).max, ids.fill_null(0).to_numpy(zero_copy_only=False))
        rows = [i for i, w in enumerate(named) if w]
        groups, questions, numbers = [], {}, [table.column(c) for c in ("impacts", "sizes", "docs", "items", "worth")]
        for t, i in enumerate(rows):
            impacts, sizes, docs, items = (c[i].values.to_numpy(zero_copy_only=False) for c in numbers[:4])
            groups.append((np.repeat(impacts, sizes), docs))
            for item in items.tolist():
                questions.setdefault(item, {})[t] = numbers[4][i].as_py()
        flat = np.concatenate([d for _, d in groups]) if groups else np.zeros(0, np.int32)
        order = np.argsort(flat, kind="stable")
        begin = np.searchsorted(flat[order], np.arange(len(ids) + 1))
        term = np.repeat(np.arange(len(groups)), [len(d) for _, d in groups])[order] if groups else flat
        impact = np.concatenate([i for i, _ in groups])[order] if groups else np.zeros(0, np.int64)
        told = [(item, *best_of_shard(of, groups, (begin, term, impact), len(ids), ids_at, k)) for item, of in questions.items()]
        at = np.concatenate([np.zeros(0, np.int64), *(d for _, d, _ in told)])
        scores = np.concatenate([np.zeros(0, np.int64), *(s for _, _, s in told)])
        item = np.repeat(np.array([i for i, _, _ in told], np.int64), [len(d) for _, d, _ in told])
        return pa.table([pa.array(item), ids.take(pa.array(at)), pa.array(scores)], names=["item", "doc", "score"])

    each = met.groupBy("block", "shard").applyInArrow(run, "item bigint, doc bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item").alias(key), "rank", F.col("doc").alias(doc), "score")


def _blocks(asked: DataFrame) -> int:
    """In how many blocks the questions are asked."""
    return max(1, -(-asked.select("item").distinct().count() // ITEMS))


#: ``search(index(documents), benchmark)`` as DuckDB SQL.
SEARCH_SQL = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), filled AS (
  SELECT doc_id, r, terms, len(terms) AS n FROM t WHERE len(terms) > 0
), total AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS length FROM filled
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL
), p AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM filled) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * max(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, total GROUP BY term
), scored AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // length))))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term), total GROUP BY item_id, r, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
