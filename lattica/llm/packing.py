"""Best-fit packing: few-document length patterns, counts by non-negative least squares, residuals by best fit.

The plan is made on the histogram of piece lengths alone (at most max_tokens bins), so its cost and size do not
grow with the corpus; documents are then dealt to the plan by their rank among pieces of the same length.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import id_text, map_arrow, materialize, ready

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
#: Rows of one length that are ranked in one group; longer lists are dealt out over several.
RANK_GROUP = 1_000_000


def nnls_patterns(bins: np.ndarray, patterns: np.ndarray, rounds: int = 150) -> np.ndarray:
    """x >= 0 that makes sum_p x_p * patterns_p fit bins in least squares.

    Active-set method (Lawson and Hanson 1974) that lets several columns with disjoint bins enter at a time.
    patterns: int array (n, depth) of bin numbers, -1 for no document.
    """
    n, depth = patterns.shape
    size = len(bins)
    padded = np.where(patterns < 0, size, patterns)
    x, inside = np.zeros(n), np.zeros(n, bool)

    def columns(which: np.ndarray) -> np.ndarray:
        a = np.zeros((size + 1, len(which)))
        for d in range(depth):
            np.add.at(a, (padded[which, d], np.arange(len(which))), 1.0)
        return a[:size]

    tolerance = 1e-7 * max(1.0, float(bins.max(initial=0)))
    best = np.inf
    for _ in range(rounds):
        used = np.flatnonzero(x)
        rest = np.append(bins - (columns(used) @ x[used] if len(used) else 0), 0.0)
        error = float(rest @ rest)
        if error > best * (1 - 1e-6):
            break
        best = error
        gain = rest[padded].sum(1)
        gain[inside] = -np.inf
        order = np.argsort(-gain, kind="stable")[:4096]
        taken = np.zeros(size + 1, bool)
        entering = []
        for p in order:
            if gain[p] <= tolerance:
                break
            if not taken[own := padded[p][padded[p] < size]].any():
                taken[own] = True
                entering.append(p)
        if not entering:
            break
        inside[entering] = True
        while True:
            passive = np.flatnonzero(inside)
            a = columns(passive)
            gram = a.T @ a
            gram[np.diag_indices_from(gram)] += 1e-9
            z = np.linalg.solve(gram, a.T @ bins)
            if (z > 0).all():
                x[:] = 0
                x[passive] = z
                break
            now = x[passive]
            low = z <= 0
            step = np.min(now[low] / np.maximum(now[low] - z[low], 1e-300))
            now = now + step * (z - now)
            now[low & (now <= 1e-12)] = 0
            leaving = passive[now <= 1e-12]
            x[passive] = np.maximum(now, 0)
            x[leaving] = 0
            inside[leaving] = False
    return x


def few_document_patterns(n_bins: int, present: np.ndarray) -> np.ndarray:
    """All multisets of one to three present bins whose upper ends add up to the whole sequence."""
    have = set((np.flatnonzero(present) + 1).tolist())
    found = [(n_bins - 1, -1, -1)] if n_bins in have else []
    for a in sorted(have, reverse=True):
        b = n_bins - a
        if 0 < b <= a and b in have:
            found.append((a - 1, b - 1, -1))
        for b in range(min(a, n_bins - a - 1), 0, -1):
            c = n_bins - a - b
            if c > b:
                break
            if b in have and c in have:
                found.append((a - 1, b - 1, c - 1))
    return np.array(found, dtype=np.int64).reshape(-1, 3)


def pack_histogram(counts: dict[int, int], most: int = 4096, bins: int = 512) -> list[tuple[list[tuple[int, int]], int]]:
    """Groups of equal sequences ([(length, how many in a row)...], number of sequences) that hold all of counts.

    Lengths are rounded up to one of `bins` bins (to one of `most` if that isn't a multiple), patterns of up to three bins get repeat counts by NNLS, rounded
    down; what is left is packed by best fit, longest first, into the gaps and into new sequences.
    """
    left = np.zeros(most + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    width = most // bins if most % bins == 0 else 1
    n_bins = most // width
    groups: list[tuple[list[tuple[int, int]], int]] = []
    if left[most]:
        groups.append(([(most, 1)], int(left[most])))
        left[most] = 0
    binned = np.add.reduceat(left[1:], np.arange(0, most, width)).astype(float)
    patterns = few_document_patterns(n_bins, binned > 0)
    repeats = np.floor(nnls_patterns(binned, patterns) + 1e-6).astype(np.int64) if len(patterns) else np.zeros(0, np.int64)
    open_at: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    spaces: list[int] = []

    def put(space: int, slots: list[tuple[int, int]], n: int) -> None:
        if space == 0:
            groups.append((slots, n))
            return
        if space not in open_at:
            open_at[space] = []
            insort(spaces, space)
        open_at[space].append((slots, n))

    def longest(bin_no: int) -> int:
        for length in range((bin_no + 1) * width, bin_no * width, -1):
            if left[length]:
                return length
        return 0

    for p in np.argsort(-repeats, kind="stable"):
        own = [b for b in patterns[p].tolist() if b >= 0]
        todo = int(repeats[p])
        while todo > 0:
            lengths, n = [], todo
            for b in own:
                length = longest(b)
                if not length:
                    break
                left[length] -= 1
                lengths.append(length)
            for length in lengths:
                left[length] += 1
            if len(lengths) < len(own):
                break
            for length in set(lengths):
                n = min(n, int(left[length]) // lengths.count(length))
            for length in lengths:
                left[length] -= n
            put(most - sum(lengths), [(length, 1) for length in lengths], n)
            todo -= n
    for length in range(most, 0, -1):
        n = int(left[length])
        while n > 0:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                fit = most // length
                if whole := n // fit:
                    put(most - fit * length, [(length, fit)], whole)
                if n % fit:
                    put(most - n % fit * length, [(length, n % fit)], 1)
                n = 0
                continue
            space = spaces[at]
            slots, seqs = open_at[space].pop()
            if not open_at[space]:
                del open_at[space]
                spaces.pop(at)
            fit = space // length
            whole = min(seqs, n // fit)
            if whole:
                put(space - fit * length, [*slots, (length, fit)], whole)
                n -= whole * fit
                seqs -= whole
            if seqs and n and n < fit:
                put(space - n * length, [*slots, (length, n)], 1)
                n, seqs = 0, seqs - 1
            if seqs:
                put(space, slots, seqs)
    for rows in open_at.values():
        groups.extend(rows)
    return groups


def plan_table(groups: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, documents in a row, first sequence, offset), sorted by length and first rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for slots, n in groups:
        offset = 0
        for length, fit in slots:
            first = used.get(length, 0)
            rows.append((length, first, fit, sequence, offset))
            used[length] = first + fit * n
            offset += length * fit
        sequence += n
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


class Tokens:
    """Ids of whole texts, from the library's own for each distinct piece.

    The tokenizer lowers, splits and then merges within pieces only, so a text's ids are those of its pieces one after
    another. Pieces are found here for texts of printable ASCII and Latin-1 letters, where lowering and the split's classes
    can be said in a few ranges; any other text, and any that holds an added token, goes to the library whole.
    """

    #: Distinct pieces whose ids are kept.
    KEPT = 500_000
    OTHER = re.compile(r"[^\x09-\x0d\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]")
    #: The file's split pattern with its classes written out for these characters, after lowering.
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\x09-\x0d a-z0-9\xdf-\xf6\xf8-\xff]+")
    #: What the file must say for this to hold.
    STEPS = [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s for k, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")) for s in (spec.get(k) or {}).get(inner, [])]
        self.by_piece = steps == self.STEPS and spec["model"]["type"] == "BPE" and not spec.get("truncation") and not spec.get("padding")
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.known: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        """Pieces, one word each, encoded in one go: no merge reaches over a space."""
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            got = self.whole.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(got.ids, dtype="<u4").tobytes()
            ends = np.searchsorted(np.array(got.word_ids), np.arange(len(part)), side="right") * 4
            starts = [0, *ends[:-1].tolist()]
            self.known.update((p, ids[s:e]) for p, s, e in zip(part, starts, ends.tolist()))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [self.PIECE.findall(t.lower()) if self.by_piece and not self.OTHER.search(t) and not any(a in t for a in self.added) else None for t in texts]
        if len(self.known) > self.KEPT:
            self.known.clear()
        self._learn(list(set(chain.from_iterable(s for s in split if s)) - self.known.keys()))
        of = self.known.__getitem__
        return [np.array(self.whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() if s is None else b"".join(map(of, s)) for t, s in zip(texts, split)]


@lru_cache(maxsize=2)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def token_pieces(docs: DataFrame, tokenizer: str, most: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece of at most `most` tokens: every document's ids, then end_id. Null text counts as empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list[int]] = [[], [], [], [], []]
        end = np.array([end_id], dtype="<u4").tobytes()
        own = _tokens(tokenizer).ids([t or "" for t in batch.column("text").to_pylist()])
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * most)):
                part = ids[at : at + 4 * most]
                for col, value in zip(cols, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                    col.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs, run, PIECES)


def pack(docs: DataFrame, tokenizer: str, most: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most `most` tokens; one row per piece (see PACKED).

    Null or empty texts are one piece that holds the end id only. Repeated rows are packed as often as they occur.
    An empty table gives an empty result. Other columns are ignored.
    The driver sees two aggregates: a histogram of at most `most` lengths, and one count for each RANK_GROUP rows.
    """
    spark = docs.sparkSession
    ready(spark)
    rows = materialize(token_pieces(id_text(docs, id_col, text_col), tokenizer, most), "pieces")
    lengths = rows.groupBy("length").count().collect()
    counts = {r["length"]: r["count"] for r in lengths}
    table = plan_table(pack_histogram(counts, most))
    salts = [(length, 1 + n // RANK_GROUP) for length, n in counts.items()]
    dealt = rows.join(F.broadcast(spark.createDataFrame(salts, "length long, salts int")), "length").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts")).cast("int")
    )
    base: dict[tuple[int, int], int] = {}
    seen: dict[int, int] = {}
    for r in sorted(dealt.groupBy("length", "salt").count().collect()):
        base[r["length"], r["salt"]] = seen.get(r["length"], 0)
        seen[r["length"]] = base[r["length"], r["salt"]] + r["count"]
    base_keys = np.array([length << 32 | salt for length, salt in base], dtype=np.int64)
    base_ranks = np.array(list(base.values()), dtype=np.int64)
    keys = table[:, 0] << 44 | table[:, 1]

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, salt, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "salt", "rank"))
        rank = rank - 1 + base_ranks[np.searchsorted(base_keys, length << 32 | salt)]
        row = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
        nth = rank - row[:, 1]
        cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        return pa.record_batch(
            [*cols, pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )

    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")).cast("long"))
    return map_arrow(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "salt", "rank"), place, PACKED)
