import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattica.llm import ppm
from lattica.llm.queries import ORACLE_SQL, QUERIES

from .test_simhash import groups, one

corpus_pipeline = pytest.importorskip("corpus_pipeline")
STAGE = dict(corpus_pipeline.STAGES)


def test_stages_as_brute_force(spark, docs, tmp_path):
    docs = docs.drop("fp", "spans").where("doc_id is not null").dropDuplicates(["doc_id"])
    # an id that repeats with another text: both stay unless they are copies
    twice = docs.limit(1).select("doc_id", F.lit("quite another text under an id that another row has").alias("text"), "lang", "source", F.lit(51).cast("long").alias("n_chars"))
    docs = docs.unionByName(twice)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    model = ppm.fit(docs)
    kept = [(i, t) for i, t in rows for lang, score, known in model.judged([t]) if lang != "und" and score >= 0.5 and known]
    of = groups([one(t) for _, t in kept])
    least = {g: min(i for (i, _), x in zip(kept, of) if x == g) for g in of}
    kept = [(i, t) for (i, t), g in zip(kept, of) if i == least[g]]
    assert len(kept) == len(least)  # no component of these holds two rows of its least id
    first = STAGE["near_dedup"](spark, STAGE["language"](spark, docs, str(tmp_path)), str(tmp_path))
    assert sorted((r["doc_id"], r["text"]) for r in first.collect()) == sorted(kept)
    words = [(i, t, re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in kept]
    seen = Counter(tuple(w[i : i + 35]) for *_, w in words for i in range(len(w) - 34))
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = defaultdict(int)
    for i, whole, w in words:
        gone = {k for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        text = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else whole
        sizes[i] += len(tok.encode(text, add_special_tokens=False).ids) + 1
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] += r["length"]
    assert dict(got) == dict(sizes)
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = stage(spark, before, str(tmp_path))
        assert before.dtypes == docs.dtypes, name


def test_registry():
    numbers = [int(m[1]) for m in (re.match(r"op(\d+)_", n) for n in QUERIES) if m]
    assert sorted(numbers) == list(range(1, 11)) and "pipeline" in QUERIES and set(ORACLE_SQL) < set(QUERIES)
