"""WARC files: writing, reading, and a Merkle fixity audit of stored replicas.

A record is stored as a gzip member of its own, closed by an empty member, so that a file stays plain gzip to any reader and
the offset ranges of records can be found in stored bytes, damaged ones included. These ranges are the leaves of a file's
tree; files hang in a tree by the digits of their name's hash. An audit compares roots and goes down only where they differ,
to the records that do.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import map_arrow, materialize, new_path, ready

#: A file ends before it has more bytes than that (a longer record is a file of its own), or more records; children of a tree node.
FILE_BYTES, FILE_RECORDS, FANOUT = 32 << 20, 65_536, 16
DATE = "2024-01-01T00:00:00Z"
#: Levels of the tree above files, as leading hex digits of their names' hashes, from the root.
DIGITS = (0, 2, 4)
RECORDS = "file string, idx long, record_offset long, record_length long, record_id string, uri string, content binary"
#: A file's tree: where its records start, their page ids, and the hashes of all nodes, 32 bytes each, leaves first, level by level.
TREE = "file string, size long, root binary, offsets array<long>, ids array<string>, nodes binary"
AUDITED = "page_id long, warc_file string, idx long, record_offset long, record_length long, sha256 string, status string"


def record_text(page_id: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """A resource record without the two line ends behind it. Null html is an empty block; a null url has no Target-URI line."""
    body = F.coalesce(html, F.lit(""))
    uri = F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(url, r"[\r\n]", "%0A"), F.lit("\r\n"))
    digest = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))).cast("binary"))
    uuid = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    page = F.coalesce(F.concat(F.lit("X-Page-Id: "), page_id.cast("string"), F.lit("\r\n")), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {date}\r\n"), F.coalesce(uri, F.lit("")), page,
        F.lit("Content-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
    )


#: Both ends of the empty member: what every member starts with, and an empty block with its sum and size.
_START, _EMPTY = b"\x1f\x8b\x08\0\0\0\0\0\0\xff", b"\x03\0" + b"\0" * 8
CLOSER = _START + _EMPTY
_RECORD_END = b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """data as a gzip member without a time, the same whenever it is packed."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    return _START + pack.compress(data) + pack.flush() + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def _write(rows: DataFrame, path: str, line_end: bytes) -> None:
    """rows (warc, seq, value binary) as a file for each warc, line_end behind each value; a warc's rows come from one task."""
    rows = rows.sortWithinPartitions("warc", "seq").select("warc", F.col("value").cast("string").alias("value"))
    rows.write.partitionBy("warc").option("encoding", "ISO-8859-1").option("lineSep", line_end.decode("latin-1")).option("compression", "none").text(path)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", compression: str = "none") -> None:
    """pages as WARC files under path, in the order they are read; nothing is shuffled.

    A task starts another file when the one it writes would pass FILE_BYTES or FILE_RECORDS. With compression "gzip" each
    record is a member of its own (see the module's text), else it is stored as it is.
    """
    ready(pages.sparkSession)
    packed = compression == "gzip"
    most, records, line_end = FILE_BYTES, FILE_RECORDS, CLOSER if packed else _RECORD_END
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, file, size, seq = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                files, seqs, values = [], [], []
                for value in batch.column("value").slice(at, 64).cast(pa.binary()).to_pylist():
                    value = member(value + _RECORD_END) if packed else value
                    n = len(value) + len(line_end)
                    if seq and (size + n > most or seq >= records):
                        file, size, seq = file + 1, 0, 0
                    files.append(f"{task:06d}-{file:06d}")
                    seqs.append(seq)
                    values.append(value)
                    size, seq = size + n, seq + 1
                yield pa.record_batch([pa.array(files, pa.string()), pa.array(seqs, pa.int64()), pa.array(values, pa.binary())], ["warc", "seq", "value"])

    rows = own.select(record_text(F.col("page_id"), F.col("url"), F.col("html")).alias("value"))
    _write(rows.mapInArrow(run, "warc string, seq long, value binary"), path, line_end)


_HEAD = re.compile(rb"WARC/[0-9.]+\r\n(?:[^\r\n]+\r\n)*\r\n")
_LENGTH = re.compile(rb"(?im)^Content-Length:[ \t]*([0-9]+)[ \t]*\r$")


def split_records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, header) of each record; what can't be read as one up to the end of data is a last record without a header."""
    at = 0
    while at < len(data):
        head = _HEAD.match(data, at)
        size = _LENGTH.search(head[0]) if head else None
        end = head.end() + int(size[1]) + 4 if size else -1
        if size is None or end > len(data) or data[end - 4 : end] != b"\r\n\r\n":
            yield at, len(data) - at, b""
            return
        yield at, end - at, head[0]
        at = end


def split_members(data: bytes) -> Iterator[tuple[int, int]]:
    """(offset, length) of each stored record with the empty member that closes it.

    A closer with a harmed half is known by the other half and what stands next to it, so a turned bit never moves a record's
    ends. What follows the last closer is a record of its own.
    """
    at = 0
    while at < len(data):
        end = data.find(CLOSER, at)
        end = len(data) if end < 0 else end + len(CLOSER)
        start = data.find(_START, at + 1, end)
        while start >= 0:
            if start + 20 < end and data.startswith(_START, start + 20):  # the closer's second half is harmed
                break
            if data.startswith(_EMPTY, start - 10) and start - 20 > at:  # its first half is
                start -= 20
                break
            start = data.find(_START, start + 1, end)
        if start >= 0 and start + 20 < end:
            end = start + 20
        yield at, end - at
        at = end


def _head(stored: bytes) -> bytes:
    """The header of a stored record; nothing if it can't be unpacked."""
    unpack, out = zlib.decompressobj(31), b""
    try:
        while b"\r\n\r\n" not in out and not unpack.eof:
            part = unpack.decompress(stored if not out else unpack.unconsumed_tail, 1024)
            if not part:
                break
            out += part
    except zlib.error:
        return b""
    found = _HEAD.match(out)
    return found[0] if found else b""


def stored_records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, header) of each record in a file's stored bytes; where gzip wasn't written by write_warc, in its unpacked bytes."""
    if data[:2] != b"\x1f\x8b" and CLOSER not in data:
        yield from split_records(data)
    elif CLOSER in data:
        for offset, length in split_members(data):
            yield offset, length, _head(data[offset : offset + length])
    else:
        yield from split_records(_plain(data))


def _field(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + name + rb":[ \t]*(.*?)\r$", head)
    return m[1].decode("utf-8", "replace") if m else None


def _plain(data: bytes) -> bytes:
    """data, unpacked if it is gzip (one member or one a record); as it is if it can't be."""
    if data[:2] != b"\x1f\x8b":
        return data
    try:
        return gzip.decompress(data)
    except (OSError, EOFError, zlib.error):
        return data


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content): a file is named by its warc folder, or by its own name where it has none."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.where(~F.col("path").rlike("/[_.][^/]*$")).select(F.regexp_extract("path", r"(warc=[^/]*|[^/]*$)(?:/[^/]*)?$", 1).alias("file"), "content")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of WARC files, plain or gzip, under path (see RECORDS); content is the block without its header.

    Offsets are those of stored bytes (see stored_records). A record that can't be unpacked has its stored bytes as content.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(7)]
        for file, raw in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
            apart = CLOSER in raw
            data = raw if apart else _plain(raw)
            for idx, (offset, length, head) in enumerate(stored_records(raw)):
                text = _plain(data[offset : offset + length]) if apart else data[offset : offset + length]
                block = text[len(head) : len(text) - (4 if head else 0)]
                for col, value in zip(cols, (file, idx, offset, length, _field(head, b"X-Page-Id") or _field(head, b"WARC-Record-ID"), _field(head, b"WARC-Target-URI"), block)):
                    col.append(value)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in RECORDS.split(", ")])

    return map_arrow(_files(spark, path), run, RECORDS)


def write_replica(spark: SparkSession, source: str, path: str, damage: Callable[[str, list[tuple[str | None, bytes]]], list[bytes]]) -> None:
    """The gzip archive under source stored again under path, over a medium that does damage to stored records.

    damage: (file, [(page id, stored bytes without the closer)]) to the stored records that arrive.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        files, seqs, values = [], [], []
        for file, raw in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
            own = [(_field(head, b"X-Page-Id"), raw[offset : offset + length - len(CLOSER)]) for offset, length, head in stored_records(raw)]
            for seq, value in enumerate(damage(file, own)):
                files.append(file.removeprefix("warc="))
                seqs.append(seq)
                values.append(value)
        return pa.record_batch([pa.array(files, pa.string()), pa.array(seqs, pa.int64()), pa.array(values, pa.binary())], ["warc", "seq", "value"])

    _write(map_arrow(_files(spark, source), run, "warc string, seq long, value binary"), path, CLOSER)


def _parent(own: list[tuple[int, int, bytes]]) -> tuple[int, int, bytes]:
    lo, hi = own[0][0], own[-1][1]
    return lo, hi, hashlib.sha256(b"\1" + lo.to_bytes(8) + hi.to_bytes(8) + b"".join(x[2] for x in own)).digest()


def tree_of(data: bytes, fanout: int = FANOUT) -> tuple[list[list[tuple[int, int, bytes]]], list[str | None]]:
    """Levels of a file's tree, leaves first, as (first byte, end, hash) in order of offsets; and the leaves' page ids."""
    whole = data if CLOSER in data else _plain(data)
    found = list(stored_records(data))
    levels = [[(o, o + n, hashlib.sha256(b"\0" + whole[o : o + n]).digest()) for o, n, _ in found]]
    while len(levels[-1]) > 1:
        levels.append([_parent(levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels, [_field(head, b"X-Page-Id") for _, _, head in found]


def fixity_tree(spark: SparkSession, path: str, through: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """A row (see TREE) for the stored bytes of each file under path, in one written table.

    through: what a file's stored bytes pass on the way, such as a faulty medium in a drill.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for file, raw in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
            raw = through(raw) if through else raw
            levels, ids = tree_of(raw)
            top = levels[-1][0][2] if levels[-1] else hashlib.sha256(b"").digest()
            size = levels[-1][0][1] if levels[-1] else 0
            root = hashlib.sha256(len(ids).to_bytes(8) + size.to_bytes(8) + top).digest()
            rows.append((file, size, root, [x[0] for x in levels[0]], ids, b"".join(x[2] for level in levels for x in level)))
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in TREE.split(", ")])

    return materialize(map_arrow(_files(spark, path), run, TREE), "tree")


def _above(files: DataFrame) -> DataFrame:
    """(digits, grp, up, hash) of groups of files for each of DIGITS, in one written table; up: the group above."""
    own = files.select(F.md5("file").alias("name"), F.col("file").alias("grp"), F.col("root").alias("hash"))
    levels = []
    for k in range(len(DIGITS) - 1, -1, -1):
        entries = F.transform(F.array_sort(F.collect_list(F.struct("grp", F.hex("hash").alias("hash")))), lambda x: F.concat_ws(":", x["grp"], x["hash"]))
        own = own.groupBy(F.substring("name", 1, DIGITS[k]).alias("grp")).agg(F.min("name").alias("name"), F.unhex(F.sha2(F.concat_ws(",", entries).cast("binary"), 256)).alias("hash"))
        levels.append(own.select(F.lit(DIGITS[k]).alias("digits"), "grp", F.substring("name", 1, DIGITS[max(0, k - 1)]).alias("up"), "hash"))
    return materialize(reduce(DataFrame.unionByName, levels), "groups")


def _differ(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys under which the replicas' hashes differ or only one has a node; written, so that plans stay short."""
    both = a.select(key, F.col("hash").alias("ha")).join(b.select(key, F.col("hash").alias("hb")), key, "full")
    return materialize(both.where(~F.col("ha").eqNullSafe(F.col("hb"))).select(key), "differ")


def wrong_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """file: those whose trees differ or that only one replica has, found from the root down."""
    above = [_above(x) for x in (a, b)]
    wrong = _differ(*(x.where("digits = 0") for x in above), "grp")
    for digits in DIGITS[1:]:
        parents = wrong.select(F.col("grp").alias("up"))
        wrong = _differ(*(x.where(F.col("digits") == digits).join(parents, "up", "left_semi") for x in above), "grp")
    parents = wrong.select(F.col("grp").alias("up"))
    tops = [x.select("file", F.col("root").alias("hash"), F.substring(F.md5("file"), 1, DIGITS[-1]).alias("up")).join(parents, "up", "left_semi") for x in (a, b)]
    return _differ(*tops, "file")


def _nodes(nodes: bytes, n: int, fanout: int = FANOUT) -> list[list[bytes]]:
    """Hashes level by level, leaves first, of a tree over n records."""
    levels, at = [], 0
    while n:
        levels.append([nodes[i : i + 32] for i in range(at, at + 32 * n, 32)])
        at += 32 * n
        n = 0 if n == 1 else -(-n // fanout)
    return levels


def descend(a: list[list[bytes]], b: list[list[bytes]], fanout: int = FANOUT) -> list[int]:
    """Leaves in which two trees of one shape differ; only branches whose hashes differ are entered."""
    wrong = [0] if a and a[-1] != b[-1] else []
    for k in range(len(a) - 2, -1, -1):
        wrong = [i for up in wrong for i in range(up * fanout, min((up + 1) * fanout, len(a[k]))) if a[k][i] != b[k][i]]
    return wrong


def _rising(values: list[int]) -> list[int]:
    """Places of a longest strictly rising run of values, in order."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(tails, v)
        if at == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[at], ends[at] = v, i
        back[i] = ends[at - 1] if at else -1
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def compare(a: list[bytes], b: list[bytes]) -> tuple[dict[int, str], list[int]]:
    """Of two replicas' record hashes in order: status of the records of a that aren't the same in b, and places of extra ones in b.

    Records that are equal and keep their order are paired; between two pairs as many are corrupt as both sides have, in
    order, and what is left over is missing or extra.
    """
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    places: dict[bytes, list[int]] = {}
    for j in range(len(b) - last - 1, first - 1, -1):
        places.setdefault(b[j], []).append(j)
    met = [(i, places[a[i]].pop()) for i in range(first, len(a) - last) if places.get(a[i])]
    pairs = [met[k] for k in _rising([j for _, j in met])]
    status, extra = {}, []
    i, j = first, first
    for i_next, j_next in [*pairs, (len(a) - last, len(b) - last)]:
        both = min(i_next - i, j_next - j)
        status |= {x: "corrupt" if x < i + both else "missing" for x in range(i, i_next)}
        extra += range(j + both, j_next)
        i, j = i_next + 1, j_next + 1
    return status, extra


def _judge(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Records of files with their status, from the trees of both replicas; a file without differences has only the first."""
    cols: list[list] = [[] for _ in range(7)]

    def put(row: dict, side: str, leaves: list[bytes], i: int, status: str) -> None:
        offsets, page = row[f"offsets_{side}"], row[f"ids_{side}"][i]
        end = offsets[i + 1] if i + 1 < len(offsets) else row[f"size_{side}"]
        page_id = int(page) if page is not None and re.fullmatch(r"-?[0-9]{1,19}", page) and -(1 << 63) <= int(page) < 1 << 63 else None
        for col, value in zip(cols, (page_id, row["file"], i, offsets[i], end - offsets[i], leaves[i].hex(), status)):
            col.append(value)

    for row in batch.to_pylist():
        trees = [_nodes(row[f"nodes_{s}"] or b"", len(row[f"offsets_{s}"] or ())) for s in "ab"]
        a, b = (t[0] if t else [] for t in trees)
        status, extra = {}, []
        if row["differs"]:
            if row["offsets_a"] == row["offsets_b"] and row["size_a"] == row["size_b"]:
                status = dict.fromkeys(descend(*trees), "corrupt")
            else:
                status, extra = compare(a, b)
        for i in range(len(a)):
            put(row, "a", a, i, status.get(i, "ok"))
        for j in extra:
            put(row, "b", b, j, "extra")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in AUDITED.split(", ")])


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every record of both trees with its status: ok, corrupt (in b), missing (from b) or extra (in b). See AUDITED.

    Offsets and hashes are those of a, of extra records those of b.
    """
    wrong = wrong_files(a, b)
    own = a.select("file", *[F.col(c).alias(f"{c}_a") for c in ("size", "offsets", "ids", "nodes")])
    other = b.join(wrong, "file", "left_semi").select("file", *[F.col(c).alias(f"{c}_b") for c in ("size", "offsets", "ids", "nodes")], F.lit(True).alias("same"))
    rows = own.join(wrong.withColumn("differs", F.lit(True)), "file", "left").join(other, "file", "full")
    return map_arrow(rows.withColumn("differs", F.coalesce("differs", "same", F.lit(False))).drop("same"), _judge, AUDITED)


def bit_rot(file: str, records: list[tuple[str | None, bytes]], every: int = 97) -> list[bytes]:
    """A drill's faulty medium: in stored records whose page id is divisible by `every`, one bit anywhere is turned over."""
    out = []
    for page, stored in records:
        if page is not None and int(page) % every == 0:
            at = zlib.crc32(page.encode()) % (8 * len(stored))
            stored = stored[: at // 8] + bytes([stored[at // 8] ^ 1 << at % 8]) + stored[at // 8 + 1 :]
        out.append(stored)
    return out


def fixity_drill(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives pages as WARC files, stores a replica over a faulty medium, and audits the replica's stored bytes by the archive's.

    One row per record. An empty table gives an empty result; repeated rows are records of their own; null ids have a null page_id.
    """
    spark = pages.sparkSession
    ready(spark)
    path, replica = new_path(spark, "warc"), new_path(spark, "warc-replica")
    write_warc(pages, path, id_col, url_col, html_col, "gzip")
    if not spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").where(~F.col("path").rlike("/[_.][^/]*$")).take(1):
        return spark.createDataFrame([], AUDITED)
    write_replica(spark, path, replica, bit_rot)
    return audit(fixity_tree(spark, path), fixity_tree(spark, replica))
