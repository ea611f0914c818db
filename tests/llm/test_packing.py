import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lattica.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, most):
    tok = Tokenizer.from_file(PATH)
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, t in texts.items()}
    found = defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == r["piece"] * most and len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        found[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in found.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= most
    return ids, found


def test_packs_everything(docs):
    most = 256
    rows = packing.pack(docs, PATH, most).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids, found = check(rows, texts, most)
    pieces = Counter((r["doc_id"], r["piece"]) for r in rows)
    assert set(pieces) == {(d, p) for d, x in ids.items() for p in range(-(-len(x) // most))}
    assert pieces[0, 0] == 2  # the repeated row
    total = sum(r["length"] for r in rows)
    assert len(found) <= -(-total // most) + 1


def test_empty(empty):
    assert packing.pack(empty, PATH).count() == 0


def test_hot_length_is_ranked_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 10)
    docs = spark.createDataFrame([(i, "a") for i in range(95)], "doc_id long, text string")
    rows = packing.pack(docs, PATH, 16).collect()
    _, found = check(rows, {i: "a" for i in range(95)}, 16)
    assert len(rows) == 95 and len(found) == 12


def test_plan_is_near_the_bound():
    rng = random.Random(3)
    counts = Counter(min(512, int(rng.lognormvariate(4.5, 1)) + 1) for _ in range(20_000))
    groups = packing.pack_histogram(counts, 512)
    held = Counter()
    for slots, n in groups:
        assert sum(length * fit for length, fit in slots) <= 512
        for length, fit in slots:
            held[length] += fit * n
    assert held == counts
    bound = -(-sum(k * v for k, v in counts.items()) // 512)
    assert sum(n for _, n in groups) <= bound * 1.005 + 1


def test_nnls_recovers_counts():
    present = np.zeros(32, bool)
    present[[3, 7, 11, 15, 19, 23, 27]] = True
    patterns = packing.few_document_patterns(32, present)
    true = np.zeros(len(patterns))
    true[::2] = 5
    bins = np.zeros(32)
    for p, x in zip(patterns, true):
        for b in p[p >= 0]:
            bins[b] += x
    got = packing.nnls_patterns(bins, patterns)
    fit = np.zeros(32)
    for p, x in zip(patterns, got):
        for b in p[p >= 0]:
            fit[b] += x
    assert (got >= 0).all() and np.allclose(fit, bins, atol=1e-3)


def test_ids_as_the_library(texts):
    lib, own = Tokenizer.from_file(PATH), packing.Tokens(PATH)
    assert own.by_piece
    rng = random.Random(5)
    odd = ["".join(rng.choice("abZ É'sStT0 1.,!-\n\tß÷×µªñÿŸΣσ中\u0301\x85\xa0\x1c") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    safe = ["".join(rng.choice("abZ É'slreLRE0 1.,!-\n\t\x0b\x0cßñÿÐþ~|<>") for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    odd += ["<|endoftext|> x", "a<|startoftext|>b", "it's we'LL DON'T ''s 's!'s", "...!?'", "12345"]
    for text, got in zip(all_ := [*odd, *safe, *(t or "" for t in texts)], own.ids(all_)):
        assert np.frombuffer(got, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text
