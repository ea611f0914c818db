import math
import random

import numpy as np

from lattica.llm import ppm

WORDS = {"xx": ["aba", "abba", "baab", "zab"], "yy": ["öko", "koko", "oköl", "zok"]}


def slow_bits(counts, word, order):
    """Code length of one word from counts of runs, by the definition."""
    padded = b"\0" * order + b" " + word.encode() + b" "
    total = 0.0
    for i in range(order + 1, len(padded)):
        for k in range(order, -2, -1):
            if k < 0:
                total += 8
                break
            ctx = padded[i - k : i]
            own = {run[-1]: n for run, n in counts[k].items() if run[:-1] == ctx}
            if padded[i] in own:
                total -= math.log2(own[padded[i]] / (sum(own.values()) + len(own)))
                break
            if own:
                total -= math.log2(len(own) / (sum(own.values()) + len(own)))
    return total


def test_code_lengths():
    rng = random.Random(2)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))): rng.randint(1, 5) for _ in range(60)}
    order = ppm.ORDER
    counts = [{} for _ in range(order + 1)]
    for w, n in words.items():
        padded = b"\0" * order + b" " + w.encode() + b" "
        for i in range(order + 1, len(padded)):
            for k in range(order + 1):
                counts[k][padded[i - k : i + 1]] = counts[k].get(padded[i - k : i + 1], 0) + n
    tree = ppm.Tree.fit({w.encode(): n for w, n in words.items()})
    asked = [*words, "zzz", "abcabcabc", "é", "ß"]
    packed, sizes = ppm.grams([w.encode() for w in asked])
    got = np.add.reduceat(tree.code_lengths(packed), np.cumsum(sizes) - sizes)
    assert np.allclose(got, [slow_bits(counts, w, order) for w in asked])


def made(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(20)), lang) for i in range(n) for lang in [rng.choice(["xx", "yy"])]]


def test_learns_and_holds_out(spark, monkeypatch):
    rows = made(200, 1)
    docs = spark.createDataFrame([*rows, (500, None, "xx"), (501, "12 !?", "yy"), (None, "öko koko", "yy"), (502, "aba", None), rows[3]], "doc_id long, text string, lang string").withColumnRenamed("lang", "lang")
    got = ppm.identify(docs).collect()
    assert len(got) == docs.count()
    want = {i: lang for i, _, lang in rows}
    assert all(r["lang_pred"] == want[r["doc_id"]] for r in got if r["doc_id"] in want)
    by = {r["doc_id"]: r for r in got}
    assert by[500]["lang_pred"] == by[501]["lang_pred"] == "und" and by[500]["score"] == 0
    assert by[None]["lang_pred"] == "yy" and by[502]["lang_pred"] == "xx" and by[None]["held_out"] is False
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    # labels of held-out rows make no difference
    other = docs.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'zz' else lang end as lang")
    assert sorted(map(str, ppm.identify(other).collect())) == sorted(map(str, got))
    monkeypatch.setattr(ppm, "KEPT", 3)
    assert sorted(map(str, ppm.identify(docs).collect())) == sorted(map(str, got))


def test_edges(spark, docs, empty):
    assert ppm.identify(empty).count() == 0
    none = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in ppm.identify(none).collect()] == [("und", 0.0)]
    assert ppm.keep_identified(none).count() == 1
    assert ppm.identify(docs).count() == docs.count()
    kept = ppm.keep_identified(docs)
    assert kept.dtypes == docs.dtypes
    assert all(r["text"] and any(c.isalpha() for c in r["text"]) for r in kept.collect())


def test_labels_of_long_texts_are_learned(spark, monkeypatch):
    monkeypatch.setattr(ppm, "SAMPLE_ROWS", 6)
    monkeypatch.setattr(ppm, "SAMPLE_CHARS", 60)
    rows = [(i, " ".join(WORDS["xx"] * 6), "xx") for i in range(2000)]  # all long
    rows += [(5000 + i, " ".join(WORDS["yy"] * (2 if i % 100 == 0 else 6)), "yy") for i in range(2000)]  # 20 short ones
    rows += [(8000 + i, ("uvu vuv" if i < 15 else None if i < 1000 else "1 2"), "zz") for i in range(2000)]  # few texts
    rows += [(20000 + i, "ded " * 100, "ww") for i in range(40)]  # 400 characters each, and one is enough
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = ppm.fit(docs)
    assert model.languages == ["ww", "xx", "yy", "zz"]
    said = {lang: int(tree.runs[0][1].sum()) for lang, tree in zip(model.languages, model.trees)}
    size = lambda text: len(text.encode()) + (not text.endswith(" "))  # noqa: E731 a word's bytes and the space behind it
    assert said["ww"] == 400
    assert said["yy"] == 6 * size(" ".join(WORDS["yy"] * 2)) and said["zz"] == 6 * size("uvu vuv")
    assert said["xx"] == 4 * size(" ".join(WORDS["xx"] * 6))  # 107 characters each: 360 are reached with the fourth
    assert {r["lang_pred"] for r in ppm.predict(docs.where("lang = 'xx'"), model).collect()} == {"xx"}


def test_gibberish_and_other_languages_go(spark):
    rng = random.Random(5)
    rows = made(300, 3)
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (3, 10, 50, 300)]
    junk += ["Wszyscy ludzie rodzą się wolni", "Все люди рождаются свободными", "人人生而自由"]
    docs = spark.createDataFrame([*rows, *((1000 + i, t, None) for i, t in enumerate(junk))], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in ppm.keep_identified(docs).collect()) == [i for i, _, _ in rows]
    assert all(lang != "und" and score >= 0.5 for lang, score in ppm.fit(docs).score(junk))  # the posterior alone keeps them


def test_number_signs_are_no_letters(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([*(("und noch ein wort", "de"), ("and another word", "en")) * 20, ("½ ²", None), ("Ⅳ ⅷ ①", None), ("12 ½x", None)])], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in ppm.identify(docs).collect()}
    assert got[40] == got[41] == "und" and got[42] != "und"
    assert ppm.word_runs(["a½b Ⅳ é_1 ß²c 漢字 ªº", None, "", "½", "X y"]) == [["a", "b", "é", "ß", "c", "漢字", "ªº"], [], [], [], ["x", "y"]]


def test_labels_under_few_ids_are_learned(spark, monkeypatch):
    monkeypatch.setattr(ppm, "SAMPLE_ROWS", 6)
    for own in (0, 1, 3, 4, 5, 7, 9):  # ids that aren't held out, or only the others count
        rows = [(own, f"wort nummer {'abcdefghij'[i % 10] * (1 + i // 10)}", "de") for i in range(3000)]
        rows += [(own, "the one text that all of these rows repeat", "en")] * 3000
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
        if docs.where(ppm.held_out()).limit(1).count():
            continue
        model = ppm.fit(docs)
        assert model.languages == ["de", "en"]
        assert int(model.trees[1].runs[0][1].sum()) == len("the one text that all of these rows repeat") + 1
        assert int(model.trees[0].runs[0][1].sum()) > 5 * len("wort nummer a")
