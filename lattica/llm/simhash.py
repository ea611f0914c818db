"""SimHash near-dedup by a binary trie self-join.

A pair of 64-bit fingerprints that differ in at most 3 bits agrees on at least one of four blocks of 16 bits. So the
join walks four tries, each with another block at the top and no errors allowed on those first 16 levels: down to
there only a node with itself can meet, which makes the block's value a shuffle key. Below, node pairs are walked
together with their differing bits counted, and a pair of nodes is left as soon as it exceeds the budget.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import WORDS, id_text, map_arrow, materialize, ready, texts
from .components import components

#: Fingerprints under one block value beyond which a trie is split by a second block, and then by a third.
HOT_BLOCK = 200_000
#: Such block values up to which their table is broadcast; more are joined without.
BROADCAST_GROUPS = 300_000


def shingle_hashes(text: bytes, words: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each shingle of A-Z-lowered words; fewer words than that make one shingle, none makes none."""
    found = WORDS.findall(text.lower())
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(found), seed)] if found else []
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], seed) for s, e in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())]


def simhash(hashes: list[list[int]]) -> np.ndarray:
    """A fingerprint for each list: a bit is set where over half of the hashes have it; an empty list gives zero."""
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    out = np.zeros(len(hashes), dtype=np.uint64)
    flat = np.array([x for h in hashes for x in h], dtype=np.uint64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    powers = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    for i in range(len(hashes)):
        total = np.zeros(64, dtype=np.int64)
        for at in range(bounds[i], bounds[i + 1], 1 << 16):
            part = flat[at : min(at + (1 << 16), bounds[i + 1])].astype(">u8").view(np.uint8).reshape(-1, 8)
            total += np.unpackbits(part, axis=1).sum(0, dtype=np.int32)
        out[i] = powers[total * 2 > sizes[i]].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """doc_id, fp and the extra columns of docs (doc_id, text, extra)."""
    own = ["doc_id", *extra]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = simhash([shingle_hashes(t) for t in texts(batch)])
        return pa.record_batch([*(batch.column(c) for c in own), pa.array(prints.view(np.int64))], [*own, "fp"])

    return map_arrow(docs, run, ", ".join(f"{c} {kind}" for c, kind in docs.select(*own).dtypes) + ", fp long")


class _Labels:
    """Least index of each member's group, kept flat."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            a, b = self.of[u], self.of[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(self.of, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.of[self.of]
                if (up == self.of).all():
                    break
                self.of = up


def trie_groups(group: np.ndarray, code: np.ndarray, top: np.ndarray, budget: int = 3, small: int = 16, frontier: int = 1 << 20) -> np.ndarray:
    """Labels that join all codes of one group that are linked by at most `budget` differing bits.

    Rows are sorted by (group, code), codes are distinct within a group and agree on their first `top` bits there.
    Node pairs (ranges a and b of the sorted codes) go down one bit at a time. Pairs of nodes whose members are all in one
    group already are left too: they can't join anything more.
    """
    n = len(code)
    labels = _Labels(n)
    if n < 2:
        return labels.of
    near = (group[1:] == group[:-1]) & (np.bitwise_count(code[1:] ^ code[:-1]) <= budget)
    labels.link(np.flatnonzero(near), np.flatnonzero(near) + 1)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.append(starts[1:], n)
    big = ends - starts > 1
    starts, ends = starts[big].astype(np.int32), ends[big].astype(np.int32)
    sums: dict[int, np.ndarray] = {}

    def ones(level: int) -> np.ndarray:
        if level not in sums:
            bit = ((code >> np.uint64(63 - level)) & np.uint64(1)).astype(np.int32)
            sums[level] = np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)])
        return sums[level]

    def useful(pairs: list[np.ndarray]) -> list[np.ndarray]:
        turns = np.concatenate([[0, 0], np.cumsum(labels.of[1:] != labels.of[:-1])])  # turns[i+1]: changes up to i
        alo, ahi, blo, bhi, _ = pairs
        settled = (turns[ahi] == turns[alo + 1]) & (turns[bhi] == turns[blo + 1]) & (labels.of[alo] == labels.of[blo])
        return [p[~settled] for p in pairs]

    def compare(pairs: list[np.ndarray]) -> None:
        """All members of small pairs, each against each, some at a time."""
        for at in range(0, len(pairs[0]), 1 << 16):
            alo, ahi, blo, bhi, _ = useful([p[at : at + (1 << 16)].astype(np.int64) for p in pairs])
            if not len(alo):
                continue
            wide = bhi - blo
            times = (ahi - alo) * wide
            of = np.repeat(np.arange(len(times)), times)
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            i, j = alo[of] + nth // wide[of], blo[of] + nth % wide[of]
            keep = i < j
            i, j = i[keep], j[keep]
            keep = np.bitwise_count(code[i] ^ code[j]) <= budget
            labels.link(i[keep], j[keep])

    stack = []
    for level in np.unique(top[starts]) if len(starts) else []:
        own = top[starts] == level
        stack.append((int(level), [starts[own], ends[own], starts[own], ends[own], np.zeros(own.sum(), np.int8)]))
    while stack:
        level, pairs = stack.pop()
        pairs = useful(pairs)
        direct = (pairs[1] - pairs[0]).astype(np.int64) * (pairs[3] - pairs[2]) <= small
        compare([p[direct] for p in pairs])
        pairs = [p[~direct] for p in pairs]
        if not len(pairs[0]):
            continue
        if len(pairs[0]) > frontier:
            half = len(pairs[0]) // 2
            stack += [(level, [p[half:] for p in pairs]), (level, [p[:half] for p in pairs])]
            continue
        alo, ahi, blo, bhi, err = pairs
        count = ones(level)
        amid, bmid = ahi - (count[ahi] - count[alo]), bhi - (count[bhi] - count[blo])
        other = (alo != blo) | (ahi != bhi)
        more = (err + 1).astype(np.int8)
        children = [
            np.concatenate(x)
            for x in (
                (alo, amid, alo, amid[other]), (amid, ahi, amid, ahi[other]), (blo, bmid, bmid, blo[other]), (bmid, bhi, bhi, bmid[other]), (err, err, more, more[other]),
            )
        ]
        lo, hi, blo, bhi, err = children
        alone = (lo == blo) & (hi == bhi) & (hi - lo < 2)
        keep = (lo < hi) & (blo < bhi) & (err <= budget) & ~alone
        stack.append((level + 1, [c[keep] for c in children]))
    return labels.of


def _links(batches: Iterator[pa.RecordBatch], most: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and code; whole groups are joined, many at a time; yields a star for each set of linked ones."""
    held: list[list[np.ndarray]] = []
    size = 0

    def joined() -> pa.RecordBatch:
        grp, code, top, fp = (np.concatenate(c) for c in zip(*held))
        code = code.view(np.uint64)
        prefix = code >> (64 - top).astype(np.uint64)
        turn = (grp[1:] != grp[:-1]) | (prefix[1:] != prefix[:-1]) | (top[1:] != top[:-1])
        labels = trie_groups(np.concatenate([[0], np.cumsum(turn)]), code, top)
        tied = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.record_batch([pa.array(fp[tied]), pa.array(fp[labels[tied]])], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "code", "top", "fp")]
        if size >= most and cols[0][-1] != held[-1][0][-1]:
            cut = int(np.flatnonzero(cols[0] != held[-1][0][-1])[0])
            held.append([c[:cut] for c in cols])
            yield joined()
            held, size, cols = [], 0, [c[cut:] for c in cols]
        held.append(cols)
        size += len(cols[0])
    if held:
        yield joined()


def _turned(low: Column, bits: int, by: Column, parts: int = 4) -> Column:
    """The lowest `bits` bits, turned left by the by-th of `parts` blocks of them."""
    mask, width = F.lit((1 << bits) - 1), bits // parts
    return F.coalesce(*[F.when(by == i, F.shiftleft(low, width * i).bitwiseAND(mask).bitwiseOR(F.shiftrightunsigned(low, bits - width * i)) if i else low) for i in range(parts)])


def _split(rows: DataFrame, top: int) -> DataFrame:
    """Groups that agree on their first `top` bits, each split by the four blocks of the rest: a pair of at most 3 differing bits agrees on one."""
    bits = 64 - top
    width, mask = bits // 4, F.lit((1 << bits) - 1)
    rows = rows.withColumn("s", F.explode(F.array(*map(F.lit, range(4)))))
    rows = rows.withColumn("code", F.col("code").bitwiseAND(F.lit(~((1 << bits) - 1))).bitwiseOR(_turned(F.col("code").bitwiseAND(mask), bits, F.col("s"))))
    block = F.shiftrightunsigned(F.col("code").bitwiseAND(mask), bits - width)
    return rows.select(F.xxhash64("grp", "s", block).alias("grp"), "code", F.lit(top + width).alias("top"), "fp")


def trie_links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to links (u, v) that span every set joined by at most 3 differing bits.

    Groups over HOT_BLOCK are split by a second and a third block; what agrees on 37 bits is one group, whatever its size.
    """
    ready(prints.sparkSession)
    rows = prints.withColumn("b", F.explode(F.array(*map(F.lit, range(4)))))
    code = F.coalesce(*[F.when(F.col("b") == i, F.shiftleft("fp", 16 * i).bitwiseOR(F.shiftrightunsigned("fp", 64 - 16 * i)) if i else F.col("fp")) for i in range(4)])
    rows = rows.withColumn("code", code).select((F.shiftrightunsigned("code", 48) * 4 + F.col("b")).alias("grp"), "code", F.lit(16).alias("top"), "fp")
    done = []
    for top in (16, 28):
        hot = materialize(rows.groupBy("grp").count().where(F.col("count") > HOT_BLOCK).select("grp"), "hot")
        n = hot.limit(BROADCAST_GROUPS + 1).count()
        if n == 0:
            break
        own = F.broadcast(hot) if n <= BROADCAST_GROUPS else hot
        done.append(rows.join(own, "grp", "left_anti").select("grp", "code", "top", "fp"))
        rows = _split(rows.join(own, "grp", "left_semi"), top)
    rows = reduce(DataFrame.unionByName, done, rows)
    return rows.repartition("grp").sortWithinPartitions("grp", "code").mapInArrow(_links, "u long, v long")


def _classes(docs: DataFrame, extra: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text, extra) as (doc_id, extra, fp), and each distinct fp with its least row (least) and its component (root)."""
    prints = materialize(fingerprints(docs, extra), "simhash")
    least = F.min(F.struct(*extra)) if extra else F.min("doc_id")
    classes = materialize(prints.groupBy("fp").agg(least.alias("least")), "classes")
    roots = components(trie_links(classes.select("fp")))
    return prints, classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs.

    Null and blank texts have fingerprint zero and link like any other. A component is named by its smallest doc_id;
    null ids don't name one, and a component of null ids alone has a null name. Repeated rows come back as often as they
    occur. An empty table gives an empty result; other columns are ignored.
    """
    prints, classes = _classes(id_text(docs, id_col, text_col))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = classes.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each component, whatever their ids.

    The smallest id stays, a null one only where no row of the component has another; of rows that share it, the one with
    the least text hash; of rows that share id and text, the one whose other columns have the least hash (maps aside).
    Columns stay as they are. An empty table gives an empty result.
    """
    id_, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    key = {"__none": id_.isNull(), "__id": F.coalesce(id_, F.lit(0)), "__hash": F.xxhash64(text), "__size": F.coalesce(F.octet_length(text), F.lit(-1))}
    _, classes = _classes(docs.select(id_.alias("doc_id"), text.alias("text"), *[c.alias(k) for k, c in key.items()]), list(key))
    kept = classes.groupBy("root").agg(F.min("least").alias("kept")).select("kept.*")
    hashed = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind]
    once = docs.select(*[c.alias(k) for k, c in key.items()], F.struct(*map(F.col, docs.columns)).alias("row"), F.xxhash64(*hashed).alias("nth"))
    once = once.groupBy(*key).agg(F.min_by("row", "nth").alias("row"))
    return once.join(kept, list(key), "left_semi").select("row.*")
