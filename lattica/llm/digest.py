"""Quartile bucket digest: hashed byte triplets counted in buckets, each bucket's quartile and the length encoded.

After the public TLSH scheme (Oliver, Cheng and Chen 2013), with a hash and a score of our own.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import id_text, map_arrow, materialize, pieces, ready

BUCKETS = 256
#: A difference of so much or more is a likeness of zero.
MOST = 300
#: Places, in a window of five bytes, of the triplets that are counted.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))
COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@lru_cache(maxsize=1)
def _bucket_table() -> np.ndarray:
    """The bucket of each byte triplet: high bits of a multiplicative hash."""
    x = np.arange(1 << 24, dtype=np.uint32)
    x *= np.uint32(2654435761)
    x ^= x >> np.uint32(15)
    x *= np.uint32(2246822519)
    return (x >> np.uint32(24)).astype(np.uint8)


def bucket_counts(text: bytes) -> np.ndarray:
    """How many triplets of text fall in each bucket."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    table = _bucket_table()
    for at in range(0, len(text), 1 << 18):
        raw = np.frombuffer(text[at : at + (1 << 18) + 4], dtype=np.uint8).astype(np.int32)
        last = at + (1 << 18) >= len(text)
        for i, (a, b, c) in enumerate(TRIPLETS):
            n = len(raw) - c if last else 1 << 18
            if n > 0:
                counts += np.bincount(table[raw[a : a + n] << 16 | raw[b : b + n] << 8 | (raw[c : c + n] ^ i * 85)], minlength=BUCKETS)
    return counts


def fingerprint(text: bytes) -> str:
    """Hex: two digits for the length, then two bits for each bucket's quartile. An empty text gives zeros."""
    counts = bucket_counts(text)
    q = np.sort(counts)[[BUCKETS // 4, BUCKETS // 2, BUCKETS * 3 // 4]]
    codes = (counts[:, None] > q).sum(1) if counts.any() else np.zeros(BUCKETS, np.int64)
    length = min(255, round(8 * np.log2(1 + len(text))))
    return f"{length:02x}" + (codes.reshape(-1, 4) << [0, 2, 4, 6]).sum(1).astype(np.uint8).tobytes().hex()


def difference(a: str, b: str) -> int:
    """Steps between quartiles, six for the farthest, and the difference of lengths beyond one step."""
    x, y = (np.frombuffer(bytes.fromhex(s), dtype=np.uint8) for s in (a, b))
    codes = [(v[1:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).astype(np.int64) for v in (x, y)]
    step = np.abs(codes[0] - codes[1])
    return int(np.where(step == 3, 6, step).sum() + 4 * max(0, abs(int(x[0]) - int(y[0])) - 1))


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 from a difference of MOST on."""
    return 1.0 if a == b else max(0.0, 1.0 - difference(a, b) / MOST)


def edited(text: str, after: str) -> str:
    """text with the last quarter of its code points replaced by as many of after's first."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def _compared(own: tuple, after: str, after_print: str) -> tuple:
    """A row of COMPARED for own (id, text, fingerprint) and the document behind it."""
    changed = edited(own[1], after).encode()
    print_ = own[2] if changed == own[1].encode() else fingerprint(changed)
    return own[0], len(own[1]), hashlib.sha256(changed).hexdigest(), own[2], print_, likeness(own[2], print_), likeness(own[2], after_print)


_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.string())
_DEALT = COMPARED + ", bucket int, is_first boolean, text string"


def _batch(rows: list[tuple], kinds: tuple = _KINDS, schema: str = _DEALT) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[] for _ in kinds]
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in schema.split(", ")])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and place: each row that has another one of its bucket behind it is compared with that.

    A bucket's first and last rows also come out as they are (bucket, is_first, doc_id, text), for the pairs between buckets.
    """

    def edge(bucket: int, is_first: bool, row: tuple) -> tuple:
        return (row[0], *[None] * 6, bucket, is_first, row[1])

    bucket, own = None, None
    for batch in batches:
        for part in pieces(batch):
            out = []
            for b, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("bucket", "doc_id", "text"))):
                text = text or ""
                row = doc_id, text, fingerprint(text.encode())
                if b == bucket:
                    out.append((*_compared(own, text, row[2]), None, None, None))
                else:
                    if own is not None:
                        out.append(edge(bucket, False, own))
                    out.append(edge(b, True, row))
                bucket, own = b, row
            yield _batch(out)
    if own is not None:
        yield _batch([edge(bucket, False, own)])


def _between(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The last row of a bucket with the first one of the next (after_text)."""
    rows = []
    for doc_id, text, after in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "after_text"))):
        rows.append(_compared((doc_id, text, fingerprint(text.encode())), after, fingerprint(after.encode())))
    return _batch(rows, _KINDS[:7], COMPARED)


_LEAST = -(1 << 63)


def _cuts(rows: DataFrame, n: int) -> list[tuple[int, int, int]]:
    """At most n - 1 places (key, hash, salt), in order, that deal rows into about equal parts, however many share a key or a hash.

    Keys that take several quantiles are cut by quantiles of their hashes, and (key, hash) pairs that do so by even parts of the salt.
    """

    def quantiles(df: DataFrame, col: str, parts: int) -> Column:
        return F.percentile_approx(col, [i / parts for i in range(1, parts)], 10_000)

    if n < 2:
        return []
    times = Counter(rows.agg(quantiles(rows, "key", n)).first()[0] or [])
    out = [(k, _LEAST, _LEAST) for k in times]
    hot = {k: t for k, t in times.items() if t > 1}
    if hot:
        most = max(hot.values()) + 1
        for r in rows.where(F.col("key").isin(list(hot))).groupBy("key").agg(quantiles(rows, "hash", most).alias("q")).collect():
            for h, t in Counter(r["q"]).items():
                out.append((r["key"], h, _LEAST))
                out += [(r["key"], h, _LEAST + (1 << 64) * i // t) for i in range(1, t)]
    return sorted(set(out))


def compare_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with likenesses (see COMPARED).

    The next document is that with the next larger id; after the last comes the first, so a lone document follows
    itself. Null texts count as empty. Null ids come before all others; rows with equal ids are ordered by their text's
    hash. An empty table gives an empty result; other columns are ignored.
    The table is dealt into ranges of (id, hash, salt), so that rows that share an id, and even rows that share a text too,
    are spread; texts are moved once. The pairs between ranges are made from their first and last rows. The driver sees a
    few numbers for each shuffle partition.
    """
    spark = docs.sparkSession
    ready(spark)
    rows = id_text(docs, id_col, text_col).withColumn("key", F.coalesce("doc_id", F.lit(_LEAST))).withColumn("hash", F.xxhash64("text"))
    cuts = _cuts(rows, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = np.array([c[0] for c in cuts], dtype=np.int64)

    @F.pandas_udf("int")
    def bucket_of(key, hash_, salt):
        import pandas as pd

        own = key.to_numpy()
        low, high = (np.searchsorted(keys, own, side=side) for side in ("left", "right"))
        for i in np.flatnonzero(high - low > 1).tolist():  # a key that is cut within
            high[i] = bisect_right(cuts, (int(own[i]), int(hash_.iloc[i]), int(salt.iloc[i])))
        return pd.Series(high)

    # a row's place in its file split is the same whenever the split is read again
    dealt = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).withColumn("bucket", bucket_of("key", "hash", "salt"))
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "key", "hash", "salt").select("bucket", "doc_id", "text")
    done = materialize(dealt.mapInArrow(_pairs, _DEALT), "compared")
    edges = done.where("bucket is not null").select("bucket", "is_first", "doc_id", "text")
    order = sorted(r["bucket"] for r in edges.where("is_first").select("bucket").collect())
    before = spark.createDataFrame([(b, order[i - 1]) for i, b in enumerate(order)], "bucket int, before int")
    firsts = edges.where("is_first").join(F.broadcast(before), "bucket").select(F.col("before").alias("bucket"), F.col("text").alias("after_text"))
    between = edges.where("not is_first").select("bucket", "doc_id", "text").join(firsts, "bucket").select("doc_id", "text", "after_text")
    columns = [x.split()[0] for x in COMPARED.split(", ")]
    return done.where("bucket is null").select(*columns).unionByName(map_arrow(between, _between, COMPARED))
