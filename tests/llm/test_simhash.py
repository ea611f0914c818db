import re

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import simhash
from lattica.llm.components import components
from lattica.llm.queries import ORACLE_SQL


def one(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(prints):
    up = list(range(len(prints)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


@pytest.mark.parametrize("hot", [200_000, 2])
def test_as_brute_force(docs, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_BLOCK", hot)
    rows = docs.select("doc_id", "text").collect()
    prints = [one(r["text"]) for r in rows]
    of = groups(prints)
    names = {g: min((r["doc_id"] for r, x in zip(rows, of) if x == g and r["doc_id"] is not None), default=None) for g in of}
    want = sorted((str(r["doc_id"]), f"{p:016x}", str(names[g])) for r, p, g in zip(rows, prints, of))
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


def kept_by_brute_force(rows):
    """Of each component of (id, text) rows the smallest id, a null one last; a repeated id's text is picked by the operator's own rule."""
    of = groups([one(t) for _, t in rows])
    return {g: min((i is None, i or 0) for (i, _), x in zip(rows, of) if x == g) for g in of}, of


def test_keep_one(spark, docs):
    kept = simhash.keep_one(docs)
    assert kept.dtypes == docs.dtypes
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, of = kept_by_brute_force(rows)
    component = dict(zip(rows, of))
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(component[r] for r in got) == sorted(want)
    assert all((i is None, i or 0) == want[component[i, t]] for i, t in got)


def test_keep_one_is_by_row_where_ids_repeat_or_are_null(spark):
    a, near = "alpha beta gamma delta " * 30 + "one", "alpha beta gamma delta " * 30 + "one"
    b, c, d = ("quite another text about " + w * 3 for w in ("rivers ", "mountains ", "deserts "))
    rows = [(3, a), (5, near), (5, b), (5, b), (5, c), (None, a), (None, d), (None, d), (7, None), (None, None), (8, "")]
    docs = spark.createDataFrame([(*r, f"x{n}") for n, r in enumerate(rows)], "doc_id long, text string, extra string").repartition(5)
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()), key=str)
    assert got == sorted([(3, a), (5, b), (5, c), (None, d), (7, None)], key=str)
    with_map = docs.withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    assert simhash.keep_one(with_map).count() == 5
    assert simhash.keep_one(docs.where("false")).count() == 0


def test_keep_one_over_one_id(spark):
    """Many different texts under one id, and copies of some of them: none is lost, no copy stays."""
    own = [f"{w} " * 9 + f"{w * 2} closes number {n} with {w[::-1]}" for n, w in enumerate("abcd efgh ijkl mnop qrst uvwx yzab cdef".split())]
    docs = spark.createDataFrame([(1, t) for t in own * 3], "doc_id long, text string").repartition(4)
    assert sorted(r["text"] for r in simhash.keep_one(docs).collect()) == sorted(own)


@pytest.mark.parametrize("seed", range(6))
def test_trie_groups(seed):
    rng = np.random.default_rng(seed)
    codes, group, top = [], [], []
    for g in range(4):
        own = set()
        for base in rng.integers(0, 1 << 62, 6).tolist():
            for _ in range(25):
                x = base
                for k in rng.integers(0, 48, rng.integers(0, 6)).tolist():
                    x ^= 1 << k
                own.add((x & (1 << 48) - 1) | (g << 48))
        codes += sorted(own)
        group += [g] * len(own)
        top += [16] * len(own)
    got = simhash.trie_groups(np.array(group), np.array(codes, dtype=np.uint64), np.array(top), small=4, frontier=50)
    assert got.tolist() == groups(codes)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 7), (3, 11), (20, 21), (21, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {2: 1, 3: 1, 11: 1, 8: 7, 9: 7, 21: 20} | {101 + i: 100 for i in range(40)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("hubs", [1000, 3])
def test_components_with_hubs(spark, monkeypatch, hubs):
    monkeypatch.setattr("lattica.llm.components.HUBS", hubs)
    edges = [(5, i) for i in range(6, 60)] + [(60, i) for i in range(30, 90)] + [(200, 201), (201, 202)] + [(100 + i, 101 + i) for i in range(9)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 5 for i in range(6, 90)} | {201: 200, 202: 200} | {101 + i: 100 for i in range(9)}


def test_sql_says_the_same(texts):
    own = [*texts, *("x" * n for n in (1, 3, 4, 7, 8, 12, 31, 32, 33, 64, 71)), "a b", "A b", "Ünï cödé wörds"]
    documents = pd.DataFrame({"doc_id": range(len(own)), "text": own})  # noqa: F841  the SQL's table
    prints = [one(t) for t in own]
    want = [(i, f"{p:016x}", g) for i, (p, g) in enumerate(zip(prints, groups(prints)))]
    assert sorted(duckdb.sql(ORACLE_SQL["op2_simhash_trie"]).fetchall()) == want
