"""Batches into a keyed table, and closures of edges."""

import random

from codeloom.operators import resolve
from codeloom.plans.upsert import KeyedTable


def test_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(40)]), rng.randrange(50), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k bigint, at bigint, id bigint")
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], ["at", "id"], buckets=8)
    assert table.read(df.schema).count() == 0 and table.apply(df.limit(0)) == []
    want = {}
    for low in range(0, 300, 100):
        table.apply(df.where(f"id >= {low} and id < {low + 100}"))
        for k, at, i in rows[low : low + 100]:
            want[k] = max(want.get(k, (-1, -1)), (at, i))
        assert {r["k"]: (r["at"], r["id"]) for r in table.read(df.schema).collect()} == want
    before = table.manifest()
    one = spark.createDataFrame([(7, 99, 1000)], df.schema)
    touched = table.apply(one)
    after = table.manifest()
    assert len(touched) == 1 and all(before[b] == after[b] for b in before if b not in touched) and before[touched[0]] != after[touched[0]]
    table.apply(one)
    found = table.lookup(df.schema, 7)
    assert [tuple(r) for r in found.collect()] == [(7, 99, 1000)] and len(found.inputFiles()) == 1
    assert [tuple(r) for r in table.lookup(df.schema, None).collect()] == [(None, *want[None])] and table.lookup(df.schema, 12345).count() == 0


def test_closure(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (102, 0), (5, 5), (None, 1)]
    got = {tuple(r) for r in resolve.closure(spark.createDataFrame(chain, "start int, target int")).collect()}
    want, edges = set(), {(a, b) for a, b in chain if a is not None}
    while edges - want:
        want |= edges
        edges = {(a, d) for a, b in want for c, d in want if b == c}
    assert got == want


def test_closure_of_a_long_chain_and_a_ring(spark):
    n = 300
    chain = [(i, i + 1) for i in range(n)] + [(1000 + i, 1000 + (i + 1) % 7) for i in range(7)]
    got = [tuple(r) for r in resolve.closure(spark.createDataFrame(chain, "start int, target int")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(n) for b in range(a + 1, n + 1)} | {(1000 + a, 1000 + b) for a in range(7) for b in range(7)}
