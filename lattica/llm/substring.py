"""Exact substring dedup: FM-index shards that share their texts by content.

A window is `WINDOW` words. The least hash of its runs of `GRAM` words depends on the window alone, so equal windows
have equal least hashes: consecutive windows with one least hash form a segment, and the hash is the key that brings
all places together where such a window may repeat. Segments whose hash occurs once, and in one place of its text,
go no further. Of the others each different segment is indexed once, with the number of its copies: the FM-index of a
shard is built over them and searched with them: matching statistics of each segment by backward search, intervals
above the window reported, and handed to all places of the segment. Segments are told apart by two 64-bit hashes, of
all their words and of the least run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import WORDS, id_text, map_arrow, materialize, ready, texts
from .fmindex import FmIndex

WINDOW, GRAM = 35, 8
#: Windows in a segment at most; longer runs are cut.
LONGEST = 220
#: Different segments under one hash beyond which their windows are dealt out one by one.
HOT = 4096
#: Words in a shard's index, unless one hash has more.
SHARD_WORDS = 250_000
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_JUDGED = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ x >> np.uint64(29)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Spans:
    """64-bit hashes of any span of a sequence of word hashes."""

    def __init__(self, hashes: np.ndarray, base: int):
        self.inverse = _powers(pow(base, -1, 1 << 64), len(hashes) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(base, len(hashes)), dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + end.astype(np.uint64) - start.astype(np.uint64))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def segments(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, least gram hash, content hash, whether the text has that gram again) of each segment."""
    n = len(hashes) - window + 1
    if n < 1:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, bool))
    g, size = hashes, 1
    while size * 2 <= gram:
        g = g[: len(g) - size] * np.uint64(pow(_BASE, size, 1 << 64)) + g[size:]
        size *= 2
    least, size, want = _mix(g), 1, window - gram + 1
    ordered = np.sort(least)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    while size < want:
        step = min(size, want - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    turn = np.concatenate([[True], least[1:] != least[:-1]])
    starts = np.flatnonzero(turn)
    counts = np.diff(np.append(starts, n))
    if counts.max() > LONGEST:
        parts = -(-counts // LONGEST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        counts = np.minimum(LONGEST, np.repeat(counts, parts) - nth * LONGEST)
        starts = np.repeat(starts, parts) + nth * LONGEST
    least = least[starts]
    return starts, counts, least, _Spans(hashes, _BASE).of(starts, starts + counts + window - 1), np.isin(least, again) if len(again) else np.zeros(len(least), bool)


def _sketch(docs: DataFrame, window: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [segments(word_hashes(WORDS.findall(t)), window) for t in texts(batch)]
        offsets = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32)
        start, count, least, content, again = (np.concatenate(x) for x in zip(*found))
        rows = pa.StructArray.from_arrays(
            [pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(least.view(np.int64)), pa.array(content.view(np.int64)), pa.array(again)],
            ["start", "n", "least", "content", "again"],
        )
        return pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.ListArray.from_arrays(pa.array(offsets), rows)], ["doc_id", "text_hash", "segs"])

    return map_arrow(docs, run, "doc_id long, text_hash long, segs array<struct<start:int,n:int,least:long,content:long,again:boolean>>")


def _texts_of(docs: DataFrame, window: int) -> DataFrame:
    """The words of the segments to look at; of segments under a hot hash, the hashes of each window instead."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: dict[str, list] = {c: [] for c in ("least", "content", "copies", "at", "words", "w1", "w2")}

        def put(*values) -> None:
            for col, value in zip(cols.values(), values):
                col.append(value)

        for text, segs in zip(texts(batch), batch.column("segs").to_pylist()):
            words = WORDS.findall(text)
            spans = None
            for s in segs:
                if s["classes"] <= HOT:
                    put(s["least"], s["content"], s["copies"], 0, b" ".join(words[s["start"] : s["start"] + s["n"] + window - 1]), None, None)
                    continue
                if spans is None:
                    hashes = word_hashes(words)
                    spans = _Spans(hashes, _BASE), _Spans(_mix(hashes), _BASE2)
                at = np.arange(s["start"], s["start"] + s["n"])
                w1, w2 = (x.of(at, at + window).view(np.int64).tolist() for x in spans)
                for i in range(s["n"]):
                    put(s["least"], s["content"], s["copies"], i, None, w1[i], w2[i])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols.values(), kinds)], list(cols))

    return map_arrow(docs, run, "least long, content long, copies long, at int, words binary, w1 long, w2 long")


def _search(window: int):
    """Rows sorted by least hash; all rows of some hashes make a shard."""

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        ids: dict[bytes, int] = {}
        symbols: list[int] = []
        sizes = []
        for row in rows:
            words = row[3].split(b" ")
            sizes.append(len(words))
            symbols += [ids.setdefault(w, len(ids) + 1) for w in words]
        index = FmIndex(np.array(symbols, dtype=np.int64), np.array(sizes), np.array([row[2] for row in rows], dtype=np.int64))
        seq, a, b = index.repeated(np.arange(len(rows)), window)
        least, content = (np.array([row[i] for row in rows], dtype=np.int64)[seq] for i in (0, 1))
        return pa.record_batch([pa.array(least), pa.array(content), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["least", "content", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, group = 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("least", "content", "copies", "words"))):
                if held and row[0] != held[-1][0] and size >= SHARD_WORDS:
                    yield shard(held)
                    held, size = [], 0
                held.append(row)
                size += row[3].count(b" ") + 1
        if held:
            yield shard(held)

    return run


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, spans (array of a, b): words from a up to b are covered by windows that also start elsewhere.

    docs: doc_id, text, text_hash. Rows that repeat both an id and a text share one row of the result.
    """
    spark = docs.sparkSession
    ready(spark)
    sketch = materialize(_sketch(docs, window), "segments")
    all_segs = sketch.select("doc_id", "text_hash", F.inline("segs"))
    met = all_segs.groupBy("least").agg(F.count("*").alias("places"), F.max("again").alias("again")).where("places > 1 or again").select("least")
    segs = materialize(all_segs.join(met, "least", "left_semi"), "met")
    classes = materialize(segs.groupBy("least", "content").agg(F.count("*").alias("copies"), F.max("again").alias("again"), F.min(F.struct("doc_id", "text_hash", "start", "n")).alias("one")), "classes")
    several = classes.groupBy("least").agg(F.count("*").alias("classes"))
    look = classes.join(several, "least").select("one.*", F.struct(F.col("one.start").alias("start"), F.col("one.n").alias("n"), "least", "content", "copies", "classes").alias("seg"))
    look = look.groupBy(*_row_key()).agg(F.collect_list("seg").alias("segs"))
    once = docs.groupBy(*_row_key()).agg(F.first("text").alias("text"))  # of rows that repeat both an id and a text one is read
    rows = materialize(_texts_of(once.join(look, ["none", "id", "text_hash"]).select("text", "segs"), window), "shards")
    found = rows.where("words is not null").drop("w1", "w2").repartition("least").sortWithinPartitions("least").mapInArrow(_search(window), "least long, content long, a int, b int")
    single = rows.where("words is null").select("least", "content", "at", "copies", "w1", "w2")
    twice = single.groupBy("w1", "w2").agg(F.sum("copies").alias("n")).where("n > 1").select("w1", "w2")
    hot = single.join(twice, ["w1", "w2"], "left_semi").select("least", "content", F.col("at").alias("a"), (F.col("at") + window).alias("b"))
    by_class = found.unionByName(hot).groupBy("least", "content").agg(F.collect_list(F.struct("a", "b")).alias("found"))
    spans = segs.join(by_class, ["least", "content"]).select("doc_id", "text_hash", F.transform("found", lambda x: F.struct((x["a"] + F.col("start")).alias("a"), (x["b"] + F.col("start")).alias("b"))).alias("own"))
    return spans.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("own")).alias("spans"))


def _row_key() -> list[Column]:
    """A row's id and text without nulls, so that joins by them and groups share a partitioning."""
    return [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash")]


def kept_words(text: bytes, spans: list[dict] | None) -> tuple[int, list[bytes]]:
    """Number of words, and those outside spans."""
    words = WORDS.findall(text)
    if spans is None or not len(spans):
        return len(words), words
    turn = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(turn, [s["a"] for s in spans], 1)
    np.add.at(turn, [s["b"] for s in spans], -1)
    return len(words), [words[i] for i in np.flatnonzero(np.cumsum(turn[:-1]) == 0).tolist()]


def _with_spans(docs: DataFrame, window: int) -> DataFrame:
    spans = materialize(repeated_spans(docs.select("doc_id", "text", "text_hash"), window), "spans")
    return docs.join(spans, _same_row(docs, spans), "left").drop(spans["doc_id"]).drop(spans["text_hash"])


def judge(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed and the hash of the words left, joined by one space.

    Null text has no words. Texts under `window` words lose none. Repeated rows and copies lose every window they share.
    Rows with a null id are judged like others. An empty table gives an empty result; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, sha = [], [], []
        for text, spans in zip(texts(batch), batch.column("spans").to_pylist()):
            n, kept = kept_words(text, spans)
            n_words.append(n)
            n_removed.append(n - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.record_batch([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = id_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return map_arrow(_with_spans(rows, window).select("doc_id", "text", "spans"), run, _JUDGED)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """docs with repeated words taken out of their texts; texts that lose none stay as they are, to the byte.

    A changed text is the words left, joined by one space; count_col, if there, is counted anew. No row goes.
    """

    @F.pandas_udf("string")
    def cut(text, spans):
        import pandas as pd

        def one(t, s):
            return t if t is None or s is None or not len(s) else b" ".join(kept_words(t.encode(), s)[1]).decode()

        return pd.Series([one(t, s) for t, s in zip(text, spans)], dtype=object)

    ready(docs.sparkSession)
    columns = docs.columns
    own = docs.withColumn("__own", F.struct(*columns)).select("__own", F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = _with_spans(own.withColumn("text_hash", F.xxhash64("text")), window)
    changed = F.col("spans").isNotNull()
    text = F.when(changed, cut("text", "spans")).otherwise(F.col("text"))
    rows = rows.withColumn("__new", text)
    kinds = dict(docs.dtypes)
    fields = {c: F.col("__own")[c] for c in columns} | {text_col: F.col("__new")}
    if count_col in columns:
        fields[count_col] = F.when(changed, F.char_length("__new").cast(kinds[count_col])).otherwise(F.col("__own")[count_col])
    return rows.select(*[f.alias(c) for c, f in fields.items()])
