import itertools
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lattica.operators import corpus, graphs, joins, ordered, state, vectors


def test_ordinals_and_order(spark):
    for parts in (1, 2, 17):
        df = spark.createDataFrame([(x,) for x in (5, 3, 1, 4, 2)], "x int").repartition(parts)
        rows = {r["x"]: r["i"] for r in ordered.with_ordinal(df, ["x"]).collect()}
        assert rows == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}
    assert ordered.with_ordinal(spark.createDataFrame([], "x int"), ["x"]).count() == 0


def test_statistics(spark):
    df = spark.createDataFrame([("a", x) for x in (4, 7, 2, 9, 1, 5, 8, 3, 6, 5)] + [("b", 42)], "k string, x int")
    got = {r["k"]: r for r in ordered.statistics(df, ["k"], "x").collect()}
    assert (got["a"]["mean"], got["a"]["median"], got["a"]["variance"], got["a"]["mode"], got["a"]["spread"]) == (5.0, 5.0, 6.0, 5, 8)
    assert (got["b"]["mean"], got["b"]["variance"]) == (42.0, 0.0)
    three = ordered.equal_width_histogram(df.where("k = 'a'"), "x", 3).collect()
    assert sorted((r["bucket"], r["n"]) for r in three) == [(0, 3), (1, 4), (2, 3)]
    assert ordered.equal_width_histogram(df.where("k = 'b'"), "x", 3).collect()[0]["n"] == 1


def test_intervals_windows_folds(spark):
    spans = spark.createDataFrame([("k", *p) for p in ((1, 3), (2, 6), (8, 10), (15, 18), (9, 11))], "k string, s int, e int")
    assert sorted((r["s"], r["e"]) for r in ordered.merge_intervals(spans, ["k"], "s", "e").collect()) == [(1, 6), (8, 11), (15, 18)]
    xs = spark.createDataFrame([("k", i, x) for i, x in enumerate((1, 3, -2, 5, 3, -1))], "k string, i int, x int")
    assert [ordered.window_max_sum(xs, ["k"], "i", "x", w).collect()[0]["largest_sum"] for w in (3, 2, 9)] == [7, 8, 0]
    assert ordered.fold_ordered(xs, ["k"], "i", "x", F.lit(""), lambda a, x: F.concat(a, x.cast("string"), F.lit(";"))).collect()[0]["folded"] == "1;3;-2;5;3;-1;"
    assert [r["x"] for r in ordered.take(ordered.drop(xs, "i", 2), "i", 2).collect()] == [-2, 5]
    assert ordered.drop(xs, "i", 99).count() == 0 and ordered.drop(xs, "i", 0).count() == 6
    assert [r["i"] for r in ordered.reversed_(xs, "i").collect()] == [5, 4, 3, 2, 1, 0]
    with pytest.raises(PySparkException):
        ordered.extremes(xs.where("false"), "x", strict=True).collect()
    assert tuple(ordered.extremes(xs.where("false"), "x").collect()[0]) == (None, None)
    empty = ordered.any_all_none(xs.where("false"), [], F.col("x") > 0).collect()[0]
    assert (empty["any_true"], empty["all_true"], empty["none_true"], empty["n_true"]) == (False, True, True, 0)


def test_joins(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 4, 40), ("b", 3, 30)], "k string, t int, v int")
    assert sorted((r["k"], r["t"], r["v"]) for r in joins.as_of(left, right, ["k"], "t", "v").collect()) == [("a", 1, 10), ("a", 5, 40), ("b", 2, None)]
    owners = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "x")], "o string, m string")
    sets = spark.createDataFrame([("I", "x"), ("I", "y"), ("J", "x")], "g string, m string")
    assert sorted(map(tuple, joins.satisfies(owners, sets, "o", "g", "m").collect())) == [("A", "I"), ("A", "J"), ("B", "J")]
    table = spark.createDataFrame([(0, "java.util", "u"), (1, "java", "j"), (2, "java.util.x", "never")], "i int, prefix string, to string")
    names = spark.createDataFrame([("java.util.x.List",), ("java.io",), ("kotlin",)], "import string")
    assert {r["import"]: r["to"] for r in corpus.map_imports(names, table).collect()} == {"java.util.x.List": "u", "java.io": "j", "kotlin": None}
    docs = spark.createDataFrame([(1, "An apple Pie here"), (2, None), (3, "nothing")], "d int, text string")
    needles = spark.createDataFrame([(7, "apple pie"), (9, "pie"), (8, " ")], "n long, text string")
    assert [tuple(r) for r in joins.containment(docs, needles, "text", "n", "text").select("d", "least_item").collect()] == [(1, 7)]


def test_lexing_and_segments(spark):
    code = 'package main\n\nfunc main() {\n\tx := 1 // note\n\tfor i := 0; i < 3; i++ { f(i,\n 2) }\n}\n\nif a { b() } else { c() }\nz := "a;b"; y()\n'
    docs = spark.createDataFrame([(1, code), (2, None), (3, "")], "doc_id long, text string")
    tokens = corpus.lex(docs, "doc_id", "text")
    assert [r["value"] for r in corpus.without_trivia(tokens).orderBy("pos").collect()] == corpus.word_tokens(code)
    chunks = {r["chunk"]: " ".join(r["tokens"]) for r in corpus.chunk_arrays(corpus.segment(tokens, "doc_id"), "doc_id").collect()}
    assert chunks[0] == "package main" and chunks[1].startswith("func main ( )") and chunks[2] == "if a { b ( ) } else { c ( ) }" and chunks[3] == 'z := "a;b"' and chunks[4] == "y ( )" and len(chunks) == 5
    ended = " ".join(r["value"] for r in corpus.insert_terminators(tokens, "doc_id").orderBy("pos").collect())
    assert ended.startswith("package main ; func main ( ) { x := 1 ; for") and "( i , 2 )" in ended
    parts = corpus.unfold_table(corpus.chunk_arrays(corpus.segment(tokens, "doc_id"), "doc_id").where("chunk = 1"), "doc_id").orderBy("part_no").collect()
    assert parts[0]["part"] == "header" and parts[-1]["part"] == "footer" and {p["owner"] for p in parts} == {"main"}
    assert corpus.scan('s = """a\nb"""\nval x', "kotlin")[-2] == ("keyword", "val", 3, 1)


def test_clamped_depth(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate("))(()")], "k int, pos int, value string")
    assert [r["d"] for r in corpus.clamped_depth(rows, "k", "pos", ("(",), (")",), "d").orderBy("pos").collect()] == [0, 0, 1, 2, 1]


def test_placeholders(spark):
    words = ["func", "add", "(", "a", ",", "b", ")", "{", "x", "=", "12", "+", "a", '"lit"', '", "', "1", "'c'", '"%d"', "_", "3.5", "12", "`raw`"]
    rows = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "k int, pos int, value string")
    named = corpus.anonymize(rows, ["k"], "pos", keep=["func"])
    got = [r["placeholder"] for r in named.orderBy("pos").collect()]
    assert got == ["func", "ID0", "(", "ID1", ",", "ID2", ")", "{", "ID3", "=", "NUM0", "+", "ID1", "STR0", '", "', "1", "CHR0", '"%d"', "_", "NUM1", "NUM0", "STR1"]
    back = corpus.deanonymize(named, corpus.placeholder_map(named, ["k"]), ["k"])
    assert [r["restored"] for r in back.orderBy("pos").collect()] == words
    m = F.create_map(F.lit("ID0"), F.lit("name"))
    toks = F.array(F.lit("ID0"), F.lit('"${ID0}!"'), F.lit("x"))
    assert spark.range(1).select(corpus.restore_text(toks, m).alias("t")).collect()[0]["t"] == ["name", '"${name}!"', "x"]
    for chunk, want in ((["a", ";", "}", ";", "b", ";"], ["a", "}", "b"]), ([";", ";", "a"], ["a"]), ([";"], []), ([], []), (["a", ";", "b"], ["a", ";", "b"])):
        assert spark.createDataFrame([(chunk,)], "t array<string>").select(corpus.normalize_chunk(F.col("t")).alias("t")).collect()[0]["t"] == want


def test_shapes(spark):
    a = spark.createDataFrame([(1, "ID3 = ID1 + ID3"), (2, "ID0 = NUM0")], "a int, t string")
    b = spark.createDataFrame([(9, "ID0 = ID7 + ID0"), (8, "ID0 = ID1 + ID1")], "b int, t string")
    got = corpus.align(a, b, "t").collect()
    assert [(r["a"], r["b"], r["mapping"]) for r in got] == [(1, 9, {"ID0": "ID3", "ID7": "ID1"})]


def test_vocabulary(spark):
    rows = spark.createDataFrame([(["a", "b", "a", "c"],), (["b", "d"],)], "w array<string>")
    vocab = corpus.vocabulary(corpus.token_counts(rows, F.col("w")))
    assert [(r["id"], r["token"]) for r in vocab.orderBy("id").collect()] == [(0, "<pad>"), (1, "<bos>"), (2, "<eos>"), (3, "<unk>"), (4, "a"), (5, "b"), (6, "c"), (7, "d")]
    coded = corpus.encode(spark.createDataFrame([("a",), ("zz",)], "token string"), vocab)
    assert sorted((r["token"], r["id"]) for r in coded.collect()) == [("a", 4), ("zz", 3)]
    words = F.array(*map(F.lit, ["<pad>", "<bos>", "<eos>", "<unk>", "a", "b"]))
    ids = F.array(*map(F.lit, [1, 4, 0, 5, 2, 4]))
    assert spark.range(1).select(corpus.decode(ids, words).alias("d"), corpus.pad(F.array(F.lit(4).cast("long")), 3).alias("p")).collect()[0][:] == (["a", "b"], [4, 0, 0])


def test_augmentation_and_splits(spark):
    texts = ["ID0 = ID1 + NUM0", "ID1 ID0 NUM0"]
    a, b = corpus.renumber(texts, 3)
    ids = a.split()
    assert b == f"{ids[2]} {ids[0]} {ids[4]}" and a == corpus.renumber(texts, 3)[0]
    x, y = corpus.rename(['foo = bar("foo")', "foo(only)"], 1, frozenset(["bar"]))
    assert '"foo"' in x and "bar" in x and "only" in y and x.split()[0] == y.split("(")[0] != "foo"
    pairs = spark.createDataFrame([(i, f"ID{i} = 1", f"x{i}") for i in range(50)], "i int, a string, b string")
    more = corpus.augment(pairs, "a", "b", 3, lambda t, s: corpus.renumber(t, s))
    assert more.count() == 150 and sorted(map(str, more.collect())) == sorted(map(str, more.repartition(7).collect()))
    train, held = corpus.split_pairs(more, "a", "b", 0.3)
    assert train.count() + held.count() == 150
    assert corpus.without_leaks(train, held, "a", "b").count() == train.count()
    assert corpus.without_leaks(more, held, "a", "b").count() == train.count()
    made = corpus.made_up_pairs(spark, 100, 1)
    assert sorted(map(str, made.collect())) == sorted(map(str, corpus.made_up_pairs(spark, 100, 1).collect())) and not made.where("source rlike '\\\\{[abnm]\\\\}|\\\\{\\\\{'").count()


def test_scores_and_declarations(spark):
    cases = spark.createDataFrame([("a", 4, 2, True, True), ("b", 0, 0, True, False), ("c", 4, 4, False, None)], "name string, chunks int, confident int, compiled boolean, matched boolean")
    r = corpus.run_summary(cases).collect()[0]
    assert (r["cases"], r["compiled"], r["matched"], r["coverage"], r["n_failing"]) == (3, 2, 1, 0.75, 2) and abs(r["score"] - (0.8 + 0.4 + 0.4) / 3) < 1e-9
    assert sorted(r["name"] for r in corpus.failing_cases(cases).collect()) == ["b", "c"]
    classes = spark.createDataFrame([("d", "P", False), ("d", "Q", True)], "doc string, cls string, has_init boolean")
    fields = spark.createDataFrame([("d", "P", 1, "y", "Int"), ("d", "P", 0, "x", "Int")], "doc string, cls string, i int, name string, type string")
    assert {r["cls"]: r["init"] for r in corpus.synthesize_init(classes, fields).collect()} == {"P": "init(x: Int, y: Int) { this.x = x; this.y = y }", "Q": None}
    methods = spark.createDataFrame([("d", "P", 1, "m1"), ("d", "P", 0, "m0"), ("d", "Z", 0, "free")], "doc string, receiver string, i int, body string")
    own, left = corpus.promote_methods(classes, methods)
    assert {r["cls"]: r["methods"] for r in own.collect()} == {"P": ["m0", "m1"], "Q": []} and [r["body"] for r in left.collect()] == ["free"]
    parts = spark.createDataFrame([(1, "f", "footer", 3, "}"), (1, "f", "header", 0, "f {"), (1, "f", "statement", 2, "b"), (1, "f", "statement", 1, "a"), (1, "g", "statement", 9, "lost")], "k int, owner string, part string, i int, text string")
    assert corpus.splice(parts, "k").collect()[0]["text"] == "f {\na\nb\n}\nlost"
    acc = spark.range(1).select(corpus.token_accuracy(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("c"), F.lit("d"))).alias("r")).collect()[0]["r"]
    assert tuple(acc) == (1, 3)


def test_patterns_and_rewrites(spark):
    rules = [(r"\bfoo\b", "bar")]
    assert corpus.rewrite_outside_literals('foo "foo" // foo\nfoo', rules) == 'bar "foo" // foo\nbar'
    df = spark.createDataFrame([("for _, v := range xs {",), ("x := len(ys)",), ("a, b = b, a",), ("xs = append(xs, 3)",), (None,)], "t string")
    assert [r["r"] for r in df.select(corpus.rewrite(F.col("t")).alias("r")).collect()] == ["for (v in xs) {", "var x = ys.size", "(a, b) = (b, a)", "xs.add(3)", None]
    assert [r["rewritten"] for r in corpus.rewrite_safe(df, "t").collect()][:2] == ["for (v in xs) {", "var x = ys.size"]
    chunks = spark.createDataFrame([(1, "for i in xs { f ( i ) }".split()), (2, ["zzz"]), (3, []), (4, "$ = $".split())], "k int, t array<string>")
    patterns = [corpus.Pattern(0, tuple("for $i in $xs { $b }".split())), corpus.Pattern(1, tuple("$a in $b".split())), corpus.Pattern(2, tuple("$x = $x".split()))]
    got = {r["k"]: r for r in corpus.best_patterns(chunks, ["k"], "t", patterns).collect()}
    assert got[1]["pattern_no"] == 0 and got[1]["slots"]["$b"] == "f ( i )" and got[2]["pattern_no"] is None and got[3]["pattern_no"] is None and got[4]["pattern_no"] == 2
    assert corpus.bind_slots("a ) b".split(), ["$x"]) is None and corpus.bind_slots([], []) == {}
    texts = ["func f() {", "}", " ", "go func() {}", "a, b = b, a", "a[i], a[j] = a[j], a[i]", "for _, v := range xs {", "make([]int, 3)", "x := []int{1}", "dp[i][j]", "a[i] = 3", "var n = 5", "for i := 0; i < n; i++ {", "} else {", "fmt.Println(a, b)", "f(a, b, c)", "s = s + i"]
    texts += ["x = 1", "fmt.Println(a)", "a[i] == 3", "s = t + i", "f(a, b)"]
    routes = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", corpus.route(F.col("t")).alias("r")).collect()
    assert [r["r"] for r in sorted(routes)] == ["fallback", "identity", *["fallback"] * 15, *["template"] * 5]
    named = spark.createDataFrame([(1, "class A { b }".split()), (2, "for A { b }".split()), (3, "x = y".split())], "k int, t array<string>")
    own = [corpus.Pattern(0, tuple("$NAME A { $b }".split())), corpus.Pattern(1, tuple("$x = $y".split())), corpus.Pattern(2, tuple("$p = $q".split()))]
    assert [r["pattern_no"] for r in sorted(corpus.best_patterns(named, ["k"], "t", own).collect())] == [None, None, 1]
    near = {r["k"]: r for r in corpus.best_patterns(named, ["k"], "t", own, embedded=True, near=lambda t: {2}).collect()}
    like = float(vectors.sequence_vector("x = y".split()) @ vectors.sequence_vector("$p = $q".split()))
    assert near[3]["pattern_no"] == 2 and abs(near[3]["score"] - (2 + 0.1 * like + 0.1)) < 1e-9
    files = spark.createDataFrame([("p", "b.kt", "import z\nimport a\nfun main() {}"), ("p", "c.kt", "import a\nclass C")], "project string, path string, source string")
    r = corpus.merge_projects(files).collect()[0]
    assert r["imports"] == ["import a", "import z"] and r["body"] == "class C\nfun main() {}"
    upper = corpus.predict(spark.createDataFrame([("a",), ("b",)], "t string"), lambda: lambda batch: [t.upper() for t in batch], "t")
    assert [r["predicted"] for r in upper.collect()] == ["A", "B"]


def test_vectors(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(60, 8))
    data[7] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, v array<double>").repartition(5)
    got = vectors.top_k(rows.where("id % 10 = 0"), rows, "id", "v", 4, query_block=2, row_block=7).collect()
    for q in range(0, 60, 10):
        n = np.linalg.norm(data, axis=1) * np.linalg.norm(data[q])
        score = np.round(np.divide(data @ data[q], n, out=np.zeros(60), where=n > 0), 9)
        want = sorted(range(60), key=lambda i: (-score[i], i))[:4]
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    hv = vectors.hypervectors(spark.createDataFrame([(["a", "b"],), ([],), (["a", "b"],)], "w array<string>"), "w").collect()
    assert hv[0]["hv"] == hv[2]["hv"] and set(hv[0]["hv"]) == {1, -1} and set(hv[1]["hv"]) == {0}
    assert abs(np.linalg.norm(vectors.sequence_vector(["some", "words"])) - 1) < 1e-9 and not vectors.sequence_vector([]).any()
    signs = spark.createDataFrame([("k", [1, -1, 1]), ("k", [1, 1, -1])], "k string, v array<int>")
    assert vectors.bundle(signs, ["k"], "v").collect()[0]["bundle"] == [1, 1, 1]
    r = spark.createDataFrame([([1.0, 2.0, 3.0], [0.0, 0.0, 0.0])], "a array<double>, z array<double>").select(vectors.permute(F.col("a"), 1), vectors.cosine(F.col("a"), F.col("z")), vectors.bind(F.col("a"), F.col("a")), vectors.permute(F.col("a"), -1)).collect()[0]
    assert r[0] == [3.0, 1.0, 2.0] and r[1] == 0.0 and r[2] == [1.0, 4.0, 9.0] and r[3] == [2.0, 3.0, 1.0]
    p = vectors.softmax(spark.createDataFrame([("k", 1.0), ("k", 1.0)], "k string, s double"), ["k"], "s").collect()
    assert [x["p"] for x in p] == [0.5, 0.5]


def test_memories(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(40, 4))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    som = vectors.Som(rounds=50).fit(data)
    rows = som.assign(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, v array<double>"), "v")
    cells = {r["id"]: r["cell"] for r in rows.collect()}
    assert cells == dict(enumerate((data @ som.codebook.T).argmax(1).tolist()))
    near = som.neighbourhood(rows, rows.where("id < 3"), "cell", 5, "id").collect()
    for r in near:
        a, b = divmod(cells[r["query_id"]], 6), divmod(cells[r["id"]], 6)
        assert max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 1 and r["score"] == 0.0
    memory = spark.createDataFrame([("a", 1, "old"), ("b", 2, "keep")], "k string, i int, v string")
    news = spark.createDataFrame([("a", 0, "new"), ("c", 5, "more")], "k string, i int, v string")
    assert {r["k"]: r["v"] for r in vectors.remember(memory, news, "k", "i").collect()} == {"a": "new", "b": "keep", "c": "more"}
    m = state.Soinn(most_age=2)
    e = np.eye(9)
    assert [m.observe("t", "a", e[0]), m.observe("u", "a", e[1]), m.observe("t", "other", e[0])] == [0, 1, 0] and m.wins == [1, 0] and m.neighbours(0) == [1]
    assert m.templates == [("t", "a"), ("u", "a")] and m.edges == {(0, 1): 0}  # the first answer stays; the hit renewed the tie, as the neuron itself is the best
    for _ in range(3):
        m.observe("t", "a", e[1])  # ties neither age on hits nor are renewed when another neuron is the best
    assert m.edges == {(0, 1): 0}
    for i in range(2, 5):
        m.observe(f"n{i}", "a", e[i])  # all equally far: tied to the first neuron; each birth ages all ties, its own included
    assert m.edges == {(0, 3): 2, (0, 4): 1} and m.neighbours(0) == [3, 4]


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (4, 4)], "src long, dst long")
    sizes = graphs.cascade_sizes(edges, edges.select(F.col("src").alias("node"))).collect()
    assert {r["start"]: r["size"] for r in sizes} == {1: 3, 2: 3, 3: 3, 4: 2}
    nodes = spark.createDataFrame([(i, i * 10) for i in range(1, 6)], "node long, value long")
    assert {r["node"]: r["value"] for r in graphs.relax(nodes, edges).collect()} == {1: 30, 2: 30, 3: 30, 4: 40, 5: 50}
    scopes = spark.createDataFrame([("inner", "outer"), ("outer", None)], "scope string, parent string")
    decls = spark.createDataFrame([(1, "x", "outer"), (2, "x", "inner"), (3, "y", "outer")], "decl long, name string, scope string")
    refs = spark.createDataFrame([(10, "x", "inner"), (11, "y", "inner"), (12, "z", "inner"), (13, "x", "outer")], "ref long, name string, scope string")
    assert {r["ref"]: r["decl"] for r in graphs.resolve(refs, decls, scopes).collect()} == {10: 2, 11: 3, 13: 1}
    few = graphs.power_law(spark.createDataFrame([(3,)] * 5, "s int"), "s").collect()[0]
    assert np.isnan(few["alpha"])
    bins = graphs.log2_histogram(spark.createDataFrame([(s,) for s in (1, 2, 3, 4, 7, 8, 1000)], "s int"), "s").collect()
    assert {r["bin"]: r["n"] for r in bins} == {0: 1, 1: 2, 2: 2, 3: 1, 7: 1}


def test_ordered_state(spark):
    rows = spark.createDataFrame([("k", i, x) for i, x in enumerate((1.0, 2.0, 3.0))], "k string, i int, x double").repartition(3)
    want = 0.0
    for x in (1.0, 2.0, 3.0):
        want = want * 0.95 + x * (1 - 0.95)
    assert abs(state.ema(rows, ["k"], "i", "x").collect()[0]["ema"] - want) < 1e-12
    r = state.controller(rows, ["k"], "i", "x").collect()[0]
    ema, theta = 1.0, 0.35
    for x in (1.0, 2.0, 3.0):
        ema = ema * 0.95 + x * 0.05
        theta = min(0.8, max(0.1, theta + 0.01 * (ema - 1)))
    assert abs(r["ema"] - ema) < 1e-12 and abs(r["threshold"] - theta) < 1e-12
    vecs = spark.createDataFrame([("k", 0, [1.0, -1.0]), ("k", 1, [-9.0, 0.0])], "k string, i int, v array<double>")
    assert state.leaky_context(vecs, ["k"], "i", "v").collect()[0]["context"] == [-1, -1]
    grown = state.soinn(spark.createDataFrame([("k", i, t, t, [1.0, float(i)]) for i, t in enumerate("aba")], "k string, i int, s string, t string, v array<double>"), ["k"], "i", "s", "t", "v").collect()
    assert sorted((r["s"], r["wins"], r["neighbours"]) for r in grown) == [("a", 1, [1]), ("b", 0, [0])]


def test_repartitioning_changes_nothing(spark):
    words = spark.createDataFrame([(k, i, w) for k, text in enumerate(["the cat sat on the mat the cat ran"]) for i, w in enumerate(text.split())], "k int, i int, w string")
    for n in (1, 2, 17):
        df = words.repartition(n)
        counts = {r["token"]: r["cnt"] for r in corpus.token_counts(df, F.array("w")).collect()}
        assert counts == {"the": 3, "cat": 2, "sat": 1, "on": 1, "mat": 1, "ran": 1}
        assert ordered.group_collect(df, ["k"], "w", "i").collect()[0]["values"] == "the cat sat on the mat the cat ran".split()
    assert list(itertools.islice(corpus.detokenize(corpus.word_tokens("f(a, b)[1].c")), 20)) == list("f(a, b)[1].c")


def slow_learner(pairs, most_age=200):
    """The learner by its rules, pair by pair, on lists."""
    neurons, ties, theta, ema, n = [], {}, 0.35, 1.0, 0
    for source, target, vector in pairs:
        if not source.strip() or not target.strip():
            continue
        order = sorted(range(len(neurons)), key=lambda i: -sum(a * b for a, b in zip(neurons[i][2], vector)))
        known = [i for i, x in enumerate(neurons) if x[0] == source]
        if known:
            own = known[0]
            neurons[own][3] += 1
            if len(order) > 1 and order[0] == own:
                ties[frozenset((own, order[1]))] = 0
        else:
            own = len(neurons)
            neurons.append([source, target, vector, 0])
            if order:
                ties[frozenset((own, order[0]))] = 0
            ties = {k: age + 1 for k, age in ties.items() if age + 1 <= most_age}
        spread = 1
        for other in sorted(next(iter(k - {own})) for k in ties if own in k)[:32]:
            spread += sum(a * b for a, b in zip(neurons[own][2], neurons[other][2])) / len(vector) >= theta
        ema = 0.95 * ema + 0.05 * spread
        theta, n = min(0.8, max(0.1, theta + 0.01 * (ema - 1))), n + 1
    return [(x[0], x[1], x[3], sorted(next(iter(k - {i})) for k in ties if i in k)) for i, x in enumerate(neurons)], theta, ema, n


@pytest.mark.parametrize("seed, most_age", [(1, 200), (2, 3), (3, 40)])
def test_learner_as_brute_force(spark, seed, most_age):
    rng = np.random.default_rng(seed)
    base = rng.choice([-1.0, 1.0], size=(12, 16))
    base[6:] = base[:6] * rng.choice([1, 1, 1, 1, -1], size=(6, 16))  # each has a near one
    pairs = [(f"t{k}", f"a{i}", base[k].tolist()) for i, k in enumerate(rng.integers(0, 12, 80).tolist())] + [(" ", "a", [1.0] * 16), ("x", "", [1.0] * 16)]
    rows = spark.createDataFrame([("k", i, *p) for i, p in enumerate(pairs)], "k string, i int, s string, t string, v array<double>").repartition(3)
    want, theta, ema, n = slow_learner(pairs, most_age)
    got = sorted(state.learn(rows, ["k"], "i", "s", "t", "v", most_age).collect(), key=lambda r: r["id"])
    assert [(r["s"], r["t"], r["wins"], r["neighbours"]) for r in got] == want
    assert all(abs(r["threshold"] - theta) < 1e-9 and abs(r["branching"] - ema) < 1e-9 and r["learned"] == n for r in got)


def test_recall_over_all_of_memory(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(90, 6))
    rows = spark.createDataFrame([(i, v.tolist(), f"s{i if i != 20 else 33}") for i, v in enumerate(data)], "id long, v array<double>, s string").repartition(4)
    asked, memory = rows.where("id % 10 = 0"), rows.where("id % 10 <> 0")
    got = {r["query_id"]: r for r in vectors.recall(asked, memory, "id", "v", "s", query_block=2, row_block=7).collect()}
    own = [i for i in range(90) if i % 10]
    assert (got[20]["id"], got[20]["score"], got[20]["p"], got[20]["accepted"]) == (33, 1.0, 1.0, True) and len(got) == 9
    for q in (0, 10, 40):
        sims = np.array([data[q] @ data[i] / np.linalg.norm(data[q]) / np.linalg.norm(data[i]) for i in own])
        e = np.exp((sims - sims.max()) / 0.1)
        best = int(sims.argmax())
        assert got[q]["id"] == own[best] and abs(got[q]["p"] - e[best] / e.sum()) < 1e-6 and got[q]["accepted"] == (got[q]["p"] >= 0.55 and sims[best] >= 0.3)
    assert vectors.recall(asked, memory.where("false"), "id", "v").count() == 0


def test_limits_are_checked_before_rows_are_taken(spark, monkeypatch):
    monkeypatch.setattr(joins, "MOST_NEEDLES", 3)
    docs = spark.createDataFrame([(1, "An apple")], "d int, text string")
    needles = spark.createDataFrame([(i, f"n{i}") for i in range(4)], "n long, text string")
    with pytest.raises(ValueError):
        joins.containment(docs, needles, "text", "n", "text")
    with pytest.raises(ValueError):
        joins.theta(docs, needles, F.lit(True), most=3)
    scopes = spark.createDataFrame([(f"s{i}", f"s{i - 1}" if i else None) for i in range(6)], "scope string, parent string")
    decls = spark.createDataFrame([(1, "x", "s0")], "decl long, name string, scope string")
    refs = spark.createDataFrame([(1, "x", "s5")], "ref long, name string, scope string")
    with pytest.raises(RuntimeError):
        graphs.resolve(refs, decls, scopes, most_depth=3)
    assert [r["decl"] for r in graphs.resolve(refs, decls, scopes).collect()] == [1]


def test_prefixes_and_medians(spark):
    table = spark.createDataFrame([(0, "ab", "u"), (1, "a", "j"), (2, "abc", "never")], "i int, prefix string, to string")
    names = spark.createDataFrame([("abcd",), ("abcd",), ("a",), (None,), ("b",)], "t string")
    assert sorted((str(r["t"]), r["to"]) for r in joins.first_prefix(names, "t", table, "prefix", "i").collect()) == [("None", None), ("a", "j"), ("abcd", "u"), ("abcd", "u"), ("b", None)]
    xs = spark.createDataFrame([("a", x) for x in (1, 2, 2, 9)] + [("b", None)] + [("c", x) for x in (3, None, 5, 4)], "k string, x int")
    got = {r["k"]: r["median"] for r in ordered.statistics(xs, ["k"], "x").collect()}
    assert got["a"] == 2.0 and got["c"] == 4.0
    assert ordered.statistics(xs, [], "x").collect()[0]["median"] == 3.0


def test_reevaluation_as_a_worklist(spark):
    """A rule that isn't monotone in one step: texts are put together from own, children and sources."""
    tree = {1: (None, "a"), 2: (1, "b"), 3: (1, "c"), 4: (2, "d"), 5: (2, "e"), 6: (3, "f")}
    edges = [(4, 6), (5, 3), (6, 3)]
    nodes = spark.createDataFrame([(i, p, o) for i, (p, o) in tree.items()], "node long, parent long, own string")
    e = spark.createDataFrame(edges, "src long, dst long")
    rule = lambda own, met: F.concat(own, F.coalesce(met, F.lit("")))

    def settled(owns):
        value = {}
        for _ in range(10):
            value = {i: owns[i] + max([v for j, v in value.items() if tree[j][0] == i or (j, i) in edges], default="") for i in tree}
        return value

    state = graphs.reevaluate(nodes, e, F.max, rule)
    owns = {i: o for i, (_, o) in tree.items()}
    assert {r["node"]: r["value"] for r in state.collect()} == settled(owns)
    assert all(1 <= r["version"] <= r["temperature"] for r in state.collect())
    sizes = {r["start"]: r["size"] for r in graphs.perturb(state, spark.createDataFrame([(4, "z"), (1, "y"), (3, "c")], "node long, own string"), nodes, e, F.max, rule).collect()}
    changed = lambda k, o: sum(a != b for a, b in zip(settled(owns | {k: o}).values(), settled(owns).values()))
    assert sizes == {4: changed(4, "z"), 1: changed(1, "y"), 3: 1}  # a name put back as it was is one change, its own
    assert {r["node"]: r["value"] for r in state.collect()} == settled(owns)


def test_perturbation_keeps_what_changes(spark, monkeypatch):
    """Many children of one parent, each renamed by itself: rows for what changes, not for each pair of siblings; slices add up."""
    n, rule = 120, lambda own, met: F.greatest(own, met)
    nodes = spark.createDataFrame([(0, None, 0)] + [(i, 0, i) for i in range(1, n)], "node long, parent long, own long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, n - 1, 40)] + [(5, n + 7)], "src long, dst long")
    state = graphs.reevaluate(nodes, edges, F.max, rule)
    renamed = spark.createDataFrame([(i, 1000 + i) for i in range(1, n + 2)], "node long, own long")
    written, write = [], graphs.materialize

    def spy(df, label):
        out = write(df, label)
        written.append((out.count(), label))
        return out

    monkeypatch.setattr(graphs, "materialize", spy)
    want = {i: 3 if i % 40 == 1 and i < n - 1 else 2 for i in range(1, n)}
    assert {r["start"]: r["size"] for r in graphs.perturb(state, renamed, nodes, edges, F.max, rule).collect()} == want
    assert max(written)[0] <= 3 * n, max(written)
    assert {r["start"]: r["size"] for r in graphs.perturb(state, renamed, nodes, edges, F.max, rule, runs_at_once=50).collect()} == want


def test_perturbation_by_ranks_is_that_by_rounds(spark):
    """Ways of different lengths, values that fall, rules that don't follow their inputs, a circle and what comes after it: the same changes."""
    n, lift = 26, random.Random(5)
    nodes = [(i, lift.randrange(i) if i and lift.random() < 0.6 else None, lift.randrange(30)) for i in range(n)]
    edges = [(i, lift.randrange(i)) for i in range(1, n) for _ in range(lift.randrange(3))] + [(6, 8), (n + 3, 4), (5, n + 4)]
    nodes, edges = spark.createDataFrame(nodes, "node long, parent long, own long"), spark.createDataFrame(edges, "src long, dst long")
    renamed = spark.createDataFrame([(i, 40 if i % 3 == 0 else -i if i % 3 == 1 else None) for i in range(n)], "node long, own long")
    rules = [lambda own, met: F.greatest(own, met), lambda own, met: F.least(own + F.coalesce(met, F.lit(0)) % 7, F.lit(40))]
    for combine, rule in ((F.max, rules[0]), (F.max, rules[1]), (F.min, rules[1])):
        straight = edges.where("src <> 6 or dst <> 8")
        for e in (straight, edges) if rule is rules[0] else (straight,):
            state = graphs.reevaluate(nodes, e, combine, rule).select("node", "value")
            want = sorted(map(tuple, graphs.perturb(state, renamed, nodes, e, lambda c, f=combine: f(c), rule).collect()))
            assert sorted(map(tuple, graphs.perturb(state, renamed, nodes, e, combine, rule).collect())) == want
            assert len(want) == n and max(s for _, s in want) > 2


def test_perturbation_writes_changes_once(spark, monkeypatch):
    """A chain: what a run changed before isn't written again with each further change."""
    n, rule = 24, lambda own, met: F.greatest(own, met)
    nodes = spark.createDataFrame([(i, None, 0) for i in range(n)], "node long, parent long, own long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "src long, dst long")
    state = nodes.select("node", F.lit(0).cast("long").alias("value"))
    rows, kept = [], (graphs.materialize, getattr(graphs, "parted", None))

    def materialize(df, label):
        out = kept[0](df, label)
        rows.append(0 if label in ("waiting",) else out.count())
        return out

    def parted(df, path, by):
        rows.append(df.count())
        kept[1](df, path, by)

    monkeypatch.setattr(graphs, "materialize", materialize)
    monkeypatch.setattr(graphs, "parted", parted, raising=False)
    renamed = nodes.select("node", F.lit(5).cast("long").alias("own"))
    assert {r["start"]: r["size"] for r in graphs.perturb(state, renamed, nodes, edges, F.max, rule).collect()} == {i: n - i for i in range(n)}
    changes = n * (n + 1) // 2
    assert sum(rows) < 2 * changes + 20 * n, sum(rows)
