import numpy as np
from pyspark.sql import functions as F

from lattica.operators import graphs, memory, scopes, state, vectors


def test_steps_go_before_the_end_of_their_block():
    flat = lambda t: " ".join(scopes.place_steps(t).split())
    assert flat("while (a) {/*step: i += 1*/ x() while (b) {/*step: j += 1*/ y('}') } }") == "while (a) { x() while (b) { y('}') j += 1 } i += 1 }"
    assert flat("f() {/*step: i += 1*/ x()") == "f() { x()" and flat("} a /* b */") == "} a /* b */" and scopes.place_steps("") == ""


def test_variables_of_one_block_get_names_of_their_own():
    assert scopes.distinct_variables('{ var i = 0; f(i) var i = 1; f(i, a.i, "i") { var i = 2; f(i) } f(i) } f(i)') == '{ var i = 0; f(i) var i_2 = 1; f(i_2, a.i, "i") { var i = 2; f(i) } f(i_2) } f(i)'
    assert scopes.distinct_variables("let x let x let x // x\nx") == "let x let x_2 let x_3 // x\nx_3"


def test_assigned_parameters_are_copied():
    got = scopes.shadow_parameters("func f(n: Int64, m: Int64): Int64 { if (n == m) { n = n / 10 } b.m = 1 } func g(n: Int64) { h(n) } func broken(n: Int64 { n = 1")
    assert got == "func f(n_param: Int64, m: Int64): Int64 {\nvar n = n_param if (n == m) { n = n / 10 } b.m = 1 } func g(n: Int64) { h(n) } func broken(n: Int64 { n = 1"
    assert scopes.shadow_parameters("func s(n: Int64): Int64\nfunc t(k: Int64) { k++ }") == "func s(n: Int64): Int64\nfunc t(k_param: Int64) {\nvar k = k_param k++ }"


def test_fixes_over_a_column(spark):
    df = spark.createDataFrame([(1, "{ var a var a }"), (2, None), (3, "")], "k int, t string")
    assert {r["k"]: r["fixed"] for r in scopes.apply(df, "t").collect()} == {1: "{ var a var a_2 }", 2: None, 3: ""}
    assert scopes.apply(df.where("false"), "t").count() == 0


def test_translation(spark):
    held = spark.createDataFrame(
        [(1, "ID0 := NUM0", "var ID0 = NUM0"), (2, "for ID0 := 0 ; ID0 < ID1 ; ID0 ++ {", "while (ID0 < ID1) {"), (3, "bad ID0", "ID0 ID9"), (4, "return ID0 + ID1 + NUM0 * 2", "return ID0 + ID1 + NUM0 * 2"), (5, "", "x"), (6, "ID0 := NUM0", "later")],
        "id long, source string, target string",
    )
    asked = spark.createDataFrame(
        [(10, "ID0 := NUM0"), (11, "for ID0 := 0 ; ID0 < NUM0 ; ID0 ++ {"), (12, "bad ID0"), (13, "nothing like it at all"), (14, ""), (15, None), (16, "for ID0 := 0 ; ID0 < ID1 ; ID0 ++ { ID2 += 1 }")], "key long, text string"
    )
    got = {r["key"]: (r["answer"], r["confidence"]) for r in memory.translate(asked, held).collect()}
    assert got[10] == ("var ID0 = NUM0", 1.0)
    alike = float(np.dot(*(vectors.sequence_hypervector(t.split()).astype(float) for t in ("for ID0 := 0 ; ID0 < NUM0 ; ID0 ++ {", "for ID0 := 0 ; ID0 < ID1 ; ID0 ++ {")))) / 2048
    assert alike > memory.LEAST and got[11][0] == "while (ID0 < NUM0) {" and abs(got[11][1] - alike) < 1e-6
    assert got[13] == got[14] == got[15] == (None, 0.0)
    assert got[12] == ("ID0 ID9", got[12][1]) and 0.99 < got[12][1] <= 1  # equal, though not certain: its own shape, nothing to rename
    assert got[16][0] is None  # a whole loop is no head of a block
    context = asked.withColumn("ctx", F.when(F.col("key") == 11, F.array_repeat(F.lit(1).cast("tinyint"), 2048)))
    assert {r["key"]: (r["answer"], r["confidence"]) for r in memory.translate(context, held, context="ctx").collect()} == got
    assert {r["answer"] for r in memory.translate(asked, held.where("false")).collect()} == {None} and memory.translate(asked.where("false"), held).count() == 0


def test_grains_and_perturbation(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (3, 5), (5, 3), (6, 6)], "src long, dst long")
    starts = spark.createDataFrame([(4, 0), (1, 1), (6, 2), (2, 3)], "node long, i int")
    assert sorted(map(tuple, graphs.grains(starts, edges).collect())) == [(1, 1, 2), (4, 0, 3), (6, 2, 1)]
    assert {r["start"]: r["size"] for r in graphs.perturbation(edges).collect()} == {1: 4, 2: 3, 3: 2, 4: 3, 5: 2, 6: 1}
    assert graphs.grains(starts.where("false"), edges).count() == 0


def test_moving_average_in_blocks(spark):
    rows = [("hot", i, float(i % 7)) for i in range(50)] + [("b", 3, 5.0), (None, 1, 2.0)]
    df = spark.createDataFrame(rows, "k string, i int, x double").repartition(5)
    want = {}
    for k, i, x in rows:
        want[k] = want.get(k, 0.0) * 0.95 + x * (1 - 0.95)
    for block in (1, 7, 1000):
        got = {r["k"]: r["ema"] for r in state.ema(df, ["k"], "i", "x", block=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert state.ema(df.where("false"), ["k"], "i", "x").count() == 0


def test_contexts_before_each_row(spark):
    rows = [("a", 0, [1.0, -1.0]), ("a", 1, [-9.0, 0.0]), ("a", 2, None), ("a", 3, [1.0, 1.0]), ("b", 0, [0.0, 0.0]), ("b", 1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "k string, i int, v array<double>").repartition(3)
    got = {(r["k"], r["i"]): r["context"] for r in state.contexts(df, ["k"], "i", "v").collect()}
    assert got == {("a", 0): None, ("a", 1): [1, -1], ("a", 2): [-1, -1], ("a", 3): [-1, -1], ("b", 0): None, ("b", 1): None}
