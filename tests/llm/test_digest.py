import hashlib
import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.llm import digest
from lattica.llm.queries import ORACLE_SQL


def test_counts_as_brute_force(texts):
    table = digest._bucket_table()
    for t in texts:
        raw = (t or "").encode()
        want = [0] * digest.BUCKETS
        for n, (a, b, c) in enumerate(digest.TRIPLETS):
            for i in range(len(raw) - c):
                want[table[raw[i + a] << 16 | raw[i + b] << 8 | raw[i + c] ^ n * 85]] += 1
        assert digest.bucket_counts(raw).tolist() == want


def test_long_text_in_parts():
    raw = bytes(i * i % 251 for i in range((1 << 18) + 77))
    whole = digest.bucket_counts(raw)
    assert whole.sum() == sum(len(raw) - c for _, _, c in digest.TRIPLETS)


def test_score():
    a, b = digest.fingerprint(b"some text " * 50), digest.fingerprint(bytes(range(256)) * 40)
    assert digest.likeness(a, a) == 1 and digest.difference(a, b) == digest.difference(b, a) > 0
    assert 0 <= digest.likeness(a, b) < 0.5
    assert set(digest.fingerprint(b"")) == {"0"} and digest.likeness(digest.fingerprint(b""), digest.fingerprint(b"ab")) <= 1


def slow_print(raw):
    """The digest by its definition, triplet by triplet."""
    counts = [0] * 256
    for n, (a, b, c) in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 4))):
        for i in range(len(raw) - c):
            x = (raw[i + a] << 16 | raw[i + b] << 8 | (raw[i + c] ^ n * 85)) * 2654435761 % (1 << 32)
            counts[(x ^ x >> 15) * 2246822519 % (1 << 32) >> 24] += 1
    ordered = sorted(counts)
    codes = [sum(c > ordered[q] for q in (64, 128, 192)) for c in counts] if any(counts) else [0] * 256
    packed = bytes(codes[i] | codes[i + 1] << 2 | codes[i + 2] << 4 | codes[i + 3] << 6 for i in range(0, 256, 4))
    return bytes([min(255, round(8 * math.log2(1 + len(raw))))]).hex() + packed.hex(), [min(255, round(8 * math.log2(1 + len(raw)))), *codes]


def slow_likeness(x, y):
    steps = [abs(a - b) for a, b in zip(x[1:], y[1:])]
    return max(0.0, 1 - (sum(6 if s == 3 else s for s in steps) + 4 * max(0, abs(x[0] - y[0]) - 1)) / 300)


def test_digest_and_likeness_by_definition(texts):
    raws = [(t or "").encode() for t in texts]
    prints = [slow_print(r) for r in raws]
    assert [digest.fingerprint(r) for r in raws] == [p[0] for p in prints]
    for i in range(len(raws)):
        assert digest.likeness(prints[i][0], prints[i - 1][0]) == pytest.approx(slow_likeness(prints[i][1], prints[i - 1][1]), abs=1e-12)


def test_rows_under_one_id_are_spread(spark):
    rows = [(7, f"text {i} of one id " * (1 + i % 5)) for i in range(120)] + [(None, "the same text in all of these rows")] * 120 + [(i, f"other {i}") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r["doc_id"], r["edited_sha256"]) for r in digest.compare_next(docs).collect()), key=str)
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    assert got == sorted(((r["doc_id"], hashlib.sha256(digest.edited(r["text"], own[(i + 1) % len(own)]["text"]).encode()).hexdigest()) for i, r in enumerate(own)), key=str)
    keyed = docs.withColumn("key", F.coalesce("doc_id", F.lit(digest._LEAST))).withColumn("hash", F.xxhash64("text"))
    cuts = digest._cuts(keyed, 16)
    assert sum(k == 7 for k, _, _ in cuts) > 2 and sum(k == digest._LEAST for k, _, _ in cuts) > 2 and cuts == sorted(set(cuts))


@pytest.mark.parametrize("partitions", ["4", "1", "13"])
def test_next_documents(spark, docs, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = sorted(map(tuple, digest.compare_next(docs).collect()), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = docs.select("doc_id", "text").collect()
    rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    want = []
    for i, r in enumerate(rows):
        own, after = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        k = len(own) // 4
        changed = (own[: len(own) - k] + after[:k]).encode()
        a, b, c = digest.fingerprint(own.encode()), digest.fingerprint(changed), digest.fingerprint(after.encode())
        want.append((r["doc_id"], len(own), hashlib.sha256(changed).hexdigest(), a, b, digest.likeness(a, b), digest.likeness(a, c)))
    assert got == sorted(want, key=str)


def test_few_rows(spark, empty):
    assert digest.compare_next(empty).count() == 0
    one = spark.createDataFrame([(5, "abc" * 40)], "doc_id long, text string")
    row = digest.compare_next(one).collect()[0]
    assert row["near_next"] == row["near_edited"] == 1.0


def test_sql_says_the_same(spark, texts):
    rows = [(i * 7, t) for i, t in enumerate(texts)]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841  the SQL's table
    found = duckdb.sql(ORACLE_SQL["op10_quartile_digest"])
    got = digest.compare_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select(*found.columns).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())
