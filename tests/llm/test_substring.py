import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import substring
from lattica.llm.fmindex import FmIndex, WaveletMatrix, suffix_array


def brute(texts, window):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4096, 0])
def test_as_brute_force(docs, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    rows = docs.select("doc_id", "text").collect()
    want = sorted((str(r["doc_id"]), *x) for r, x in zip(rows, brute([r["text"] for r in rows], 35)))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.judge(docs).collect())
    assert got == want
    assert sum(x[2] for x in want) > 500


@pytest.mark.parametrize("seed", range(2))
def test_few_words(spark, seed, monkeypatch):
    monkeypatch.setattr(substring, "LONGEST", 50)
    rng = random.Random(seed)
    pool = [[rng.choice("ab") for _ in range(rng.randint(1, 60))] for _ in range(5)]
    texts = [" ".join(x for _ in range(rng.randint(1, 5)) for x in rng.choice(pool)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((i, *x) for i, x in enumerate(brute(texts, 35)))
    assert sorted(tuple(r) for r in substring.judge(docs).collect()) == want


def test_empty(empty):
    assert substring.judge(empty).count() == 0
    assert substring.remove_repeats(empty).columns == empty.columns


def test_remove_repeats(docs):
    got = substring.remove_repeats(docs)
    assert got.dtypes == docs.dtypes and got.count() == docs.count()
    before = {(r["doc_id"], r["text"]): r for r in substring.judge(docs).join(docs.drop("spans"), "doc_id").collect()}
    judged = {r["doc_id"]: r for r in substring.judge(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got.collect():
        own = judged[r["doc_id"]]
        if own["n_removed"] == 0:
            assert r["text"] == texts[r["doc_id"]]
        else:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == own["kept_sha256"] and r["n_chars"] == len(r["text"])
    assert before


def test_fm_index():
    rng = random.Random(4)
    for _ in range(60):
        width, top = rng.choice([3, 6]), rng.choice([2, 4, 40])
        pool = [[rng.randint(1, top) for _ in range(rng.randint(1, 20))] for _ in range(5)]
        seqs = [[x for _ in range(rng.randint(1, 4)) for x in rng.choice(pool)] for _ in range(rng.randint(1, 9))]
        index = FmIndex(np.array([x for s in seqs for x in s]), np.array([len(s) for s in seqs]))
        seen = Counter(tuple(s[i : i + width]) for s in seqs for i in range(len(s) - width + 1))
        want = {(j, i) for j, s in enumerate(seqs) for i in range(len(s) - width + 1) if seen[tuple(s[i : i + width])] > 1}
        for steps in (160, 5, 0):
            assert {(j, i) for j, a, b in zip(*(x.tolist() for x in index.repeated(np.arange(len(seqs)), width, steps))) for i in range(a, b - width + 1)} == want


def test_parts():
    values = np.random.default_rng(1).integers(0, 9, 500)
    assert suffix_array(values).tolist() == sorted(range(500), key=lambda i: values[i:].tolist())
    wm = WaveletMatrix(values, 9)
    for c in range(9):
        assert wm.rank(np.full(501, c), np.arange(501)).tolist() == [int((values[:i] == c).sum()) for i in range(501)]


@pytest.mark.parametrize("hot", [4096, 1])
def test_rows_that_repeat_share_one_list_of_spans(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    text, other = " ".join(f"w{i % 50}" for i in range(300)), " ".join(f"v{i}" for i in range(80))
    tail = " ".join(f"w{i}" for i in range(10, 50)) + " and an end"
    rows = [(1, text)] * 400 + [(None, text)] * 3 + [(2, other), (3, tail)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spans = substring.repeated_spans(docs.withColumn("text_hash", F.xxhash64("text"))).collect()
    assert sorted(str(r["doc_id"]) for r in spans) == ["1", "3", "None"]
    assert all(len(r["spans"]) < 400 for r in spans)
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.judge(docs).collect()}
    assert got == {(1, 300, 300), (None, 300, 300), (2, 80, 0), (3, 43, 40)}


def test_index_counts_copies():
    symbols, sizes = np.array([1, 2, 3, 4, 5, 1, 2, 3, 9]), np.array([5, 4])
    once = FmIndex(symbols, sizes).repeated(np.arange(2), 3)
    assert sorted(zip(*(x.tolist() for x in once))) == [(0, 0, 3), (1, 0, 3)]
    twice = FmIndex(symbols, sizes, np.array([2, 1])).repeated(np.arange(2), 3)
    assert sorted(zip(*(x.tolist() for x in twice))) == [(0, 0, 5), (1, 0, 3)]
