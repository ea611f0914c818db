import gzip

import pytest

from lattica.llm import warc


@pytest.fixture()
def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>page {i}\r\n\r\nWARC/1.0 {'é' * (i % 50)}</p>", "clash") for i in range(300)]
    rows += [(301, None, "no url", ""), (302, "http://h/\r\nx", None, ""), (None, "http://none", "no id", ""), rows[5]]
    return spark.createDataFrame(rows, "page_id long, url string, html string, file string").repartition(4)


def test_round_trip(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 64)
    for kind in ("none", "gzip"):
        warc.write_warc(pages, str(tmp_path / kind), compression=kind)
        rows = warc.read_warc(spark, str(tmp_path / kind)).collect()
        got = sorted((r["record_id"], r["content"].decode()) for r in rows if r["record_id"].isdigit())
        assert got == sorted((str(r["page_id"]), r["html"] or "") for r in pages.collect() if r["page_id"] is not None)
        assert len(rows) == pages.count()
        by_file = {}
        for r in sorted(rows, key=lambda r: (r["file"], r["idx"])):
            assert r["record_offset"] == by_file.get(r["file"], 0)
            by_file[r["file"]] = r["record_offset"] + r["record_length"]


def test_members_of_gzip_and_torn_files():
    a, b = (b"WARC/1.0\r\nContent-Length: 3\r\n\r\n" + x + b"\r\n\r\n" for x in (b"abc", b"xyz"))
    assert warc._plain(gzip.compress(a) + gzip.compress(b)) == a + b
    assert [(o, n) for o, n, _ in warc.split_records(a + b[:-3])] == [(0, len(a)), (len(a), len(b) - 3)]
    assert list(warc.split_records(b"")) == []


def test_audit_finds_what_was_harmed(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 64)
    path = str(tmp_path / "w")
    warc.write_warc(pages.coalesce(1).sortWithinPartitions("page_id"), path)  # files of 64 ids each, in order
    sound = warc.fixity_tree(spark, path)
    assert {r["status"] for r in warc.audit(sound, warc.fixity_tree(spark, path)).select("status").collect()} == {"ok"}

    def harm(data: bytes) -> bytes:
        found = [(warc._field(head, b"X-Page-Id"), data[o : o + n]) for o, n, head in warc.split_records(data)]
        records = [x if i is None or int(i) % 29 else x[:-9] + bytes([x[-9] ^ 1]) + x[-8:] for i, x in found]  # a bit of the block
        if b"X-Page-Id: 70\r" in data:
            records.pop()  # the file's last record is lost
        if b"X-Page-Id: 140\r" in data:
            records.append(records[0])
        return b"".join(records)

    rows = warc.audit(sound, warc.fixity_tree(spark, path, harm)).collect()
    status = {}
    for r in rows:
        status.setdefault(r["status"], []).append(r["page_id"])
    assert sorted(status["corrupt"]) == sorted(i for i in range(0, 300, 29) if i != 0 or True)
    assert len(status["missing"]) == 1 and len(status["extra"]) == 1
    assert sum(map(len, status.values())) == pages.count() + 1


def test_trees_of_other_height(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 64)
    pages = spark.createDataFrame([(i, "u", f"t{i}") for i in range(40)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    warc.write_warc(pages, path)
    short = warc.fixity_tree(spark, path, lambda data: b"".join(data[o : o + n] for o, n, _ in list(warc.split_records(data))[:10]))
    rows = warc.audit(warc.fixity_tree(spark, path), short).collect()
    assert sorted((r["idx"], r["status"]) for r in rows) == [(i, "ok" if i < 10 else "missing") for i in range(40)]


def some_members(n=9):
    return [warc.member(b"WARC/1.0\r\nX-Page-Id: %d\r\nContent-Length: 5\r\n\r\nabc%02d\r\n\r\n" % (i, i)) for i in range(n)]


def test_every_turned_bit_marks_one_record():
    whole = warc.CLOSER.join([*some_members(5), b""])
    ranges = [(o, n) for o, n, _ in warc.stored_records(whole)]
    assert [n for _, n in ranges] == [len(m) + 20 for m in some_members(5)] and gzip.decompress(whole).count(b"WARC/1.0") == 5
    sound = [x[2] for x in warc.tree_of(whole)[0][0]]
    for at in range(8 * len(whole)):
        data = bytearray(whole)
        data[at // 8] ^= 1 << at % 8
        leaves = warc.tree_of(bytes(data))[0][0]
        assert [(lo, hi - lo) for lo, hi, _ in leaves] == ranges, at
        assert [o <= at // 8 < o + n for o, n in ranges] == [x[2] != h for x, h in zip(leaves, sound)], at


def test_descent_is_the_comparison_of_all_leaves():
    for n in (1, 2, 15, 16, 17, 300):
        data = warc.CLOSER.join([*some_members(n), b""])
        records = list(warc.split_members(data))
        for wrong in ({}, {0}, {n - 1}, {0, n // 2}):
            other = bytearray(data)
            for i in wrong:
                other[records[i][0] + 12] ^= 4
            trees = [warc.tree_of(bytes(x))[0] for x in (data, other)]
            assert warc.descend(*([[x[2] for x in level] for level in t] for t in trees)) == sorted(set(wrong))


def test_lost_and_added_records_by_brute_force():
    import itertools

    def slow(a, b):  # longest common subsequence by trying all
        for k in range(min(len(a), len(b)), -1, -1):
            if any(list(x) == list(y) for x in itertools.combinations(a, k) for y in itertools.combinations(b, k)):
                return k

    own = [bytes([i]) for i in range(6)]
    for other in ([0, 1, 2, 3, 4, 5], [0, 2, 3, 4, 5], [9, 0, 1, 2, 3, 4, 5], [0, 1, 9, 3, 4], [0, 1, 4, 5], [5, 4, 3], [], [1, 0, 2, 9, 9, 5, 7], [0, 1, 2, 8, 7, 3, 4, 5]):
        b = [bytes([i]) for i in other]
        status, extra = warc.compare(own, b)
        same = len(own) - len(status)
        assert same == slow(own, b)
        corrupt, missing = (sum(s == x for s in status.values()) for x in ("corrupt", "missing"))
        assert same + corrupt + missing == 6 and same + corrupt + len(extra) == len(b)
    assert warc.compare(own, [own[0], own[1], b"x", own[3], own[5]]) == ({2: "corrupt", 4: "missing"}, [])


def test_stored_replica_with_all_kinds_of_harm(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 64)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    warc.write_warc(pages, a, compression="gzip")

    def harm(file, records):
        out = []
        for page, stored in records:
            if page == "70":
                continue
            out += [stored, warc.member(b"no record of ours")] if page == "140" else [stored[:-1] + bytes([stored[-1] ^ 128])] if page == "33" else [stored]
        return out

    warc.write_replica(spark, a, b, harm)
    rows = warc.audit(warc.fixity_tree(spark, a), warc.fixity_tree(spark, b)).collect()
    assert sorted((r["status"], r["page_id"]) for r in rows if r["status"] != "ok") == [("corrupt", 33), ("extra", None), ("missing", 70)]
    assert len(rows) == pages.count() + 1
    warc.write_replica(spark, a, str(tmp_path / "c"), lambda file, records: [stored for _, stored in records])
    assert {r["status"] for r in warc.audit(warc.fixity_tree(spark, a), warc.fixity_tree(spark, str(tmp_path / "c"))).collect()} == {"ok"}


def test_files_end_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 5000)
    rows = [(i, "u", "x" * (20_000 if i == 7 else 300)) for i in range(60)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_warc(docs, str(tmp_path / "w"))
    sizes = [len(r["content"]) for r in warc._files(spark, str(tmp_path / "w")).collect()]
    assert len(sizes) > 5 and sorted(sizes)[-2] <= 5000 < max(sizes)


def test_very_long_page_and_clashing_columns(spark):
    rows = [(1, "u", "long " * 400_000, "c"), (97, "u", "y" * 1_500_000, "c"), (2, "u", "", "c"), ((1 << 63) - 1, "u", "the largest id", "c")]
    got = warc.fixity_drill(spark.createDataFrame(rows, "page_id long, url string, html string, file string")).collect()
    assert sorted((r["page_id"], r["status"]) for r in got) == [(1, "ok"), (2, "ok"), (97, "corrupt"), ((1 << 63) - 1, "ok")]


def test_drill(spark, pages):
    rows = warc.fixity_drill(pages).collect()
    assert len(rows) == pages.count()
    assert sorted(r["page_id"] for r in rows if r["status"] == "corrupt") == [0, 97, 194, 291]
    assert warc.fixity_drill(spark.createDataFrame([], pages.schema)).count() == 0
