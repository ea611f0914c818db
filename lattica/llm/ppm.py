"""Language identification by prediction by partial matching: byte context trees per language, frozen after fitting.

A text is coded word by word (runs of letters, lowered); the context of a byte is what precedes it in its word, up to
ORDER bytes. What stands between words (digits, marks, white space) is the same in all languages here and isn't coded:
it would add equal bits to every language, and contexts that run over it would make each place of a text a case of its
own instead of each distinct word. Under frozen statistics a byte's code length depends on those bytes alone, so it is worked out once for
each distinct run of ORDER + 1 bytes and once for each distinct word, and summed exactly for every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import id_text, map_arrow, ready

ORDER = 4
#: Labelled rows per language that the statistics are fitted on, and the longest text among them, in characters, as long as a label has enough shorter ones.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 20_000
#: A letter, for Spark.
_HAS_LETTERS = r"\p{L}"
#: A text is of a language if it takes at most MARGIN times the bits a byte that this share of the language's sampled texts stay within.
MARGIN, WITHIN = 3.0, 0.99
#: Languages at most; more labels than that are an error.
LANGUAGES = 500
#: Distinct words and byte runs that a worker keeps between batches.
KEPT = 120_000


#: Runs of letters and of number signs such as fractions and Roman numerals, which word_runs() takes out.
_RUNS = re.compile(r"[^\W\d_]+")


def _letters_only(run: str) -> list[str]:
    return "".join(c if c.isalpha() else " " for c in run).split()


def word_runs(texts: list[str | None]) -> list[list[str]]:
    """Of each text, lowered, the runs of letters (Unicode category L).

    The pattern takes other numbers for letters, too: of the distinct runs, those that hold any are taken apart.
    """
    found = [_RUNS.findall(t.lower()) if t else [] for t in texts]
    odd = {w: _letters_only(w) for w in set().union(*found) if not w.isalpha()}
    return [[p for w in f for p in odd.get(w, (w,))] for f in found] if odd else found


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def grams(words: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of each word (with a space on both sides) packed with the `order` bytes before it; sizes per word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    raw = np.frombuffer(b" ".join([b"", *words, b""]), dtype=np.uint8).astype(np.uint64)
    within = np.arange(len(raw) - 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # place in its word, from 0
    out = raw[1:].copy()
    padded = np.concatenate([np.zeros(order, np.uint64), raw])
    for back in range(1, order + 1):
        before = padded[order + 1 - back :][: len(out)]
        out |= np.where(within + 1 >= back, before, np.uint64(0)) << np.uint64(8 * back)
    return out, sizes


@dataclass
class Tree:
    """Counts of one language: for each order, sorted runs with counts, and sorted contexts with totals and kinds."""

    runs: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def fit(cls, words: dict[bytes, int], order: int = ORDER) -> Tree:
        own = sorted(words)
        packed, sizes = grams(own, order)
        weight = np.repeat(np.array([words[w] for w in own], dtype=np.int64), sizes)
        runs, contexts = [], []
        for k in range(order + 1):
            keys, of = np.unique(packed & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            counts = np.bincount(of, weights=weight).astype(np.int64)
            ctx, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            runs.append((keys, counts))
            contexts.append((ctx, np.bincount(of, weights=counts).astype(np.int64), np.bincount(of)))
        return cls(runs, contexts)

    def code_lengths(self, packed: np.ndarray) -> np.ndarray:
        """Bits for the last byte of each run: escapes (method C) from the longest context down to one that knows it."""
        bits = np.zeros(len(packed))
        todo = np.arange(len(packed))
        for k in range(len(self.runs) - 1, -1, -1):
            key = packed[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
            ctx, total, kinds = self.contexts[k]
            at = np.minimum(np.searchsorted(ctx, key >> np.uint64(8)), len(ctx) - 1)
            seen = ctx[at] == key >> np.uint64(8)
            keys, counts = self.runs[k]
            to = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[to] == key
            whole = np.log2((total + kinds)[at])
            bits[todo] += np.where(hit, whole - np.log2(counts[to]), np.where(seen, whole - np.log2(kinds[at]), 0))
            todo = todo[~hit]
        bits[todo] += 8.0
        return bits


@dataclass
class Model:
    languages: list[str]
    trees: list[Tree]
    limits: list[float]
    runs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    bits: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    words: dict[str, int] = field(default_factory=dict)
    lengths: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def __getstate__(self):
        return self.languages, self.trees, self.limits

    def __setstate__(self, state):
        self.__init__(*state)

    def _word_bits(self, words: list[str]) -> np.ndarray:
        packed, sizes = grams([w.encode() for w in words])
        own, of = np.unique(packed, return_inverse=True)
        known = np.isin(own, self.runs, assume_unique=True)
        if not known.all():
            new = own[~known]
            bits = np.stack([t.code_lengths(new) for t in self.trees], 1)
            if len(self.runs) > KEPT:
                new, self.runs = own, self.runs[:0]
                bits = np.stack([t.code_lengths(new) for t in self.trees], 1)
                self.bits = np.zeros((0, len(self.trees)))
            runs = np.concatenate([self.runs, new])
            order = np.argsort(runs)
            self.runs, self.bits = runs[order], np.concatenate([self.bits.reshape(-1, len(self.trees)), bits])[order]
        each = self.bits[np.searchsorted(self.runs, own)][of]
        return np.add.reduceat(each, np.cumsum(sizes) - sizes, axis=0)

    def score(self, texts: list[str | None], most: int = 2_000_000) -> list[tuple[str, float]]:
        """(language, its share of the posterior under equal priors) of whole texts; und and 0 without letters or languages.

        Texts of about `most` characters together are taken apart at a time, however many come in.
        """
        return [own[:2] for own in self.judged(texts, most)]

    def judged(self, texts: list[str | None], most: int = 2_000_000) -> list[tuple[str, float, bool]]:
        """(language, share, whether the text's code length is one of that language) of whole texts."""
        out, at, held = [], 0, 0
        for i, t in enumerate(texts):
            held += len(t or "")
            if held >= most or i == len(texts) - 1:
                out += self._score(texts[at : i + 1])
                at, held = i + 1, 0
        return out

    def _score(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        found = word_runs(texts)
        if not self.languages:
            return [("und", 0.0, False)] * len(texts)
        if len(self.words) > KEPT:
            self.words, self.lengths = {}, self.lengths[:0]
        new = list({w for f in found for w in f} - self.words.keys())
        if new:
            self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))
            own = np.column_stack([self._word_bits(new), [len(w.encode()) + 1 for w in new]])  # bits by tree, and bytes
            self.lengths = np.concatenate([self.lengths.reshape(-1, own.shape[1]), own])
        out, place = [], self.words.__getitem__
        for own in found:
            if not own:
                out.append(("und", 0.0, False))
                continue
            *bits, size = self.lengths[np.fromiter(map(place, own), np.int64, len(own))].sum(0)
            bits = np.array(bits)
            best = int(bits.argmin())
            out.append((self.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()), bool(bits[best] <= self.limits[best] * size)))
        return out


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trees from at most SAMPLE_ROWS rows of each label, those with the least hash of their id and text.

    Only rows count that aren't held out and have an id, a label and a text with letters; rows equal in label, id and text
    count once. Texts of at most SAMPLE_CHARS characters come first; a label with fewer than SAMPLE_ROWS of them gets longer
    ones too, whole, until SAMPLE_ROWS * SAMPLE_CHARS characters are reached. A label with very many rows is thinned by that
    hash before its rows are ranked, so no task gets more than a few times SAMPLE_ROWS; its least row always stays, so every
    label with such a row is learned.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike(_HAS_LETTERS))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("size", F.char_length("text")).withColumn("long", F.col("size") > SAMPLE_CHARS)
    short, long = F.when(~F.col("long"), F.col("h")), F.when(F.col("long"), F.col("h"))
    kinds = rows.groupBy("lang").agg(F.approx_count_distinct(short).alias("short"), F.approx_count_distinct(long).alias("long"), F.min(F.struct("long", "h")).alias("least"))
    counts = kinds.limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels")
    # a hash below its label's mark comes first: about four times the rows wanted, whatever the table's size
    shares = [
        (r["lang"], min(1.0, 4 * SAMPLE_ROWS / max(1, r["short"])), min(1.0, 4 * SAMPLE_ROWS / max(1, r["long"])) if r["short"] < 1.5 * SAMPLE_ROWS else 0.0, r["least"]["h"]) for r in counts
    ]
    marks = docs.sparkSession.createDataFrame(shares, "lang string, share double, long_share double, least long")
    mark = F.when(F.col("long"), F.col("long_share")).otherwise(F.col("share"))
    near = (mark > 0) & (F.col("h") / float(1 << 63) <= 2 * mark - 1)
    rows = rows.join(F.broadcast(marks), "lang").where(near | (F.col("h") == F.col("least")))
    rows = rows.groupBy("lang", "h").agg(*[F.first(c).alias(c) for c in ("text", "size", "long")])
    first = Window.partitionBy("lang").orderBy("long", "h")
    rows = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= SAMPLE_ROWS)
    upto = F.sum("size").over(Window.partitionBy("lang").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).where(F.col("upto") - F.col("size") < SAMPLE_ROWS * SAMPLE_CHARS)
    languages, trees, limits = [], [], []
    sample = rows.select("lang", "nth", "text").sortWithinPartitions("lang", "nth").toLocalIterator()
    for lang, own in groupby(sample, key=lambda r: r["lang"]):
        said = [c for r in own if (c := Counter(w.encode() for w in word_runs([r["text"]])[0]))]
        if said:
            languages.append(lang)
            trees.append(Tree.fit(_total(said)))
            limits.append(_limit(said))
    order = sorted(range(len(languages)), key=languages.__getitem__)
    return Model(*([x[i] for i in order] for x in (languages, trees, limits)))


def _total(said: list[Counter[bytes]]) -> Counter[bytes]:
    out: Counter[bytes] = Counter()
    for own in said:
        out.update(own)
    return out


def _limit(said: list[Counter[bytes]]) -> float:
    """Bits a byte up to which a text is of the language: MARGIN times what WITHIN of the sampled texts need in a tree of the other half.

    A single text shows nothing of what others need: any is let through.
    """
    halves = said[::2], said[1::2]
    if not halves[1]:
        return float("inf")
    rates = []
    for own, other in (halves, halves[::-1]):
        words = list(_total(own))
        packed, sizes = grams(words)
        runs, of = np.unique(packed, return_inverse=True)
        bits = np.add.reduceat(Tree.fit(_total(other)).code_lengths(runs)[of], np.cumsum(sizes) - sizes)
        bits_of = dict(zip(words, bits.tolist()))
        rates += [sum(n * bits_of[w] for w, n in c.items()) / sum(n * (len(w) + 1) for w, n in c.items()) for c in own]
    return MARGIN * float(np.quantile(rates, WITHIN))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row. Equal texts get equal predictions; ties go to the first label in order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = shared.value.score(batch.column("text").to_pylist())
        return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(id_text(docs, id_col, text_col).withColumn("held_out", held_out()), run, PREDICTED)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fits on docs' labels and predicts for every row.

    Null texts and texts without letters are und, as is everything when no row is labelled. Rows with a null id aren't
    held out and aren't learned from. Repeated rows come back as often; an empty table gives an empty result.
    """
    return predict(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without texts that have no letters, those of which no language takes at least `least` of the posterior, and
    those whose code length isn't one of their best language (gibberish, and languages that weren't learned; see MARGIN).

    Without any labelled row nothing can be told, and only texts without letters go.
    """
    ready(docs.sparkSession)
    model = fit(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(text):
        import pandas as pd

        own = [None if t is None else t for t in text]
        if not model_known:
            return pd.Series([bool(f) for f in word_runs(own)])
        return pd.Series([known and score >= least for _, score, known in shared.value.judged(own)])

    model_known = bool(model.languages)
    return docs.where(good(F.col(text_col)))
