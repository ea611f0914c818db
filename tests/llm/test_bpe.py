import hashlib
import random

import public_tokenizers as P
import tiktoken

from lattica.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


def test_as_the_library(texts):
    own = bpe.load(PATH, P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(1)
    odd = ["a" * 900, "\n\n \t x", " " * 700, "日本語😀" * 40, "don't I'll 123!!", "é" * 300, "<|endoftext|>"]
    odd += ["".join(rng.choice("ab \n'sétion!1") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    for text, ids in zip(all_ := [*odd, *(t or "" for t in texts)], own.encode(all_)):
        assert ids == lib.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_kept_ids_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    own = bpe.Bpe(bpe.load(PATH, P.PATTERN).ranks, P.PATTERN)
    for _ in range(3):
        assert own.encode(["several quite different wordss heree"]) == bpe.load(PATH, P.PATTERN).encode(["several quite different wordss heree"])


def test_table(docs, empty):
    rows = bpe.round_trip(docs, PATH, P.PATTERN).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    own = bpe.load(PATH, P.PATTERN)
    assert len(rows) == docs.count()
    for r in rows:
        ids = own.encode([texts[r["doc_id"]].decode()])[0]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]]).hexdigest()
    assert bpe.round_trip(empty, PATH, P.PATTERN).count() == 0
    back = bpe.decode_table(bpe.encode_table(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert all(r["bytes"] == texts[r["doc_id"]] for r in back)
