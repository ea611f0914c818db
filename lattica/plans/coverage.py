"""Queries of array, map, text and vector operators that the other modules leave out, and of Spark's own SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import collections as C, extensions, scalars as S
from lattica.operators import graphs, joins, state, vectors
from lattica.streaming import events

from .catalogue import _LIST, _PART_EDGES, _XS, _orders_with_quantities, _part_edges, _text
from .registry import query


def _columns(**named: str) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in named.items())


# --- arrays and maps -------------------------------------------------------------------------------------------------
@query(
    _XS
    + "SELECT o, "
    + _columns(
        indexed="array_to_string(list_transform(xs, lambda x, i: (i - 1) || ':' || x), ',')", flat=_LIST.format("flatten([xs, [0], xs])"), first_big="coalesce(list_filter(xs, lambda x: x > 45)[1], -1)", last_big="coalesce(list_filter(xs, lambda x: x > 45)[-1], -1)",
        first_any="xs[1]", empty="false", not_empty="true", none_empty="len(list_filter(xs, lambda x: x > 45)) = 0", pair="xs[1] || '/' || len(xs)", swapped="len(xs) || '/' || xs[1]", third="xs[1] || '/' || xs[-1] || '/' || len(xs)", literal=_LIST.format("[xs[1], 7, 7]"),
        as_set=_LIST.format("CASE WHEN xs[1] = 7 THEN [7] ELSE [xs[1], 7] END"), removed=_LIST.format("xs[2:]"), kept=_LIST.format("xs"), between="CAST(len(list_filter(xs, lambda x: x BETWEEN 10 AND 20)) AS INTEGER)", until="CAST(len(list_filter(xs, lambda x: x >= 10 AND x < 20)) AS INTEGER)",
        zeros=_LIST.format("list_transform(range(0, len(xs)), lambda i: 0)"), grid="CAST(len(xs) * 3 AS INTEGER)", places=_LIST.format("range(0, len(xs))"), up=_LIST.format("range(1, xs[1] + 1)"), not_null=_LIST.format("list_filter(xs, lambda x: x <> 7)"), less=_LIST.format("list_filter(xs, lambda x: x < xs[1])"),
    )
    + " FROM a"
)
def array_access(read):
    xs, big = F.col("xs"), lambda x: x > 45
    head, n = C.first(xs), F.size(xs)
    told = lambda *parts: F.concat_ws("/", *[p.cast("string") for p in parts])
    pair, three = C.pair(head, n), C.triple(head, C.last(xs), n)
    swapped = F.struct(n.alias("first"), head.alias("second"))
    back = C.swapped(F.struct(swapped["second"].alias("first"), swapped["first"].alias("second")))
    return _orders_with_quantities(read).select(
        "o", F.array_join(F.transform(C.with_index(xs), lambda p: F.concat(p["index"].cast("string"), F.lit(":"), p["value"].cast("string"))), ",").alias("indexed"), _text(C.flatten(F.array(xs, C.list_of(F.lit(0).cast("long")), xs))).alias("flat"),
        S.elvis(C.first_or_null(xs, big), -1).alias("first_big"), S.elvis(C.last_or_null(xs, big), -1).alias("last_big"), C.first_or_null(xs).alias("first_any"), C.is_empty(xs).alias("empty"), C.is_not_empty(xs).alias("not_empty"), C.is_empty(C.filter_(xs, big)).alias("none_empty"),
        told(pair["first"], pair["second"]).alias("pair"), told(back["first"], back["second"]).alias("swapped"), told(three["first"], three["second"], three["third"]).alias("third"), _text(C.list_of(head, F.lit(7).cast("long"), F.lit(7).cast("long"))).alias("literal"),
        _text(C.set_of(head, F.lit(7).cast("long"), F.lit(7).cast("long"))).alias("as_set"), _text(C.remove(xs, head)).alias("removed"), _text(C.filter_(xs, lambda x: F.lit(True))).alias("kept"), C.count(xs, lambda x: C.in_range(x, 10, 20)).alias("between"), C.count(xs, lambda x: C.in_until(x, 10, 20)).alias("until"),
        _text(C.repeat_value(0, n)).alias("zeros"), F.size(C.flatten(C.grid(0, n, F.lit(3)))).alias("grid"), _text(C.indices(xs)).alias("places"), _text(C.range_to(F.lit(1).cast("long"), head)).alias("up"), _text(C.filter_not_null(C.map_(xs, lambda x: F.when(x != 7, x)))).alias("not_null"), _text(C.filter_(xs, lambda x: x < head)).alias("less"),
    )


@query(
    _XS
    + ", u AS (SELECT o, xs, list_distinct(xs) AS d, list_sort(list_distinct(xs)) AS k FROM a), m AS (SELECT o, x % 3 AS c, max(x) AS x FROM (SELECT o, unnest(xs) AS x FROM a) GROUP BY 1, 2), by_key AS (SELECT o, string_agg(c || '=' || x, ';' ORDER BY c) AS rekeyed FROM m GROUP BY 1) SELECT o, "
    + _columns(
        squares="array_to_string(list_transform(k, lambda x: x || '=' || x * x), ';')", keys=_LIST.format("k"), values_sum="CAST(list_sum(list_transform(k, lambda x: x * x)) AS BIGINT)", has7="list_contains(xs, 7)", put7="CASE WHEN list_contains(xs, 7) THEN 49 ELSE -1 END", size7="CAST(len(k) + CAST(NOT list_contains(xs, 7) AS INTEGER) AS INTEGER)", set7="CAST(-2 AS BIGINT)", literal="'a=1;b=2'", rekeyed="rekeyed",
    )
    + " FROM u JOIN by_key USING (o)"
)
def map_forms(read):
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ";")
    long = lambda x: F.lit(x).cast("long")
    rows = _orders_with_quantities(read).withColumn("ys", F.array_sort("xs"))
    m = C.associate_with(C.distinct(F.col("xs")), lambda x: x * x)
    rows = rows.withColumn("m", m)
    m = F.col("m")
    with7 = C.get_or_put(m, long(7), long(-1))
    return rows.select(
        "o", flat(m).alias("squares"), _text(F.array_sort(C.keys(m))).alias("keys"), C.sum_(C.values(m)).alias("values_sum"), C.contains_key(m, long(7)).alias("has7"), F.element_at(with7, long(7)).alias("put7"), F.size(with7).alias("size7"),
        F.element_at(C.put(m, long(7), long(-2)), long(7)).alias("set7"), flat(C.map_of(a=1, b=2)).alias("literal"), flat(C.map_keys(C.associate_with(C.distinct(F.col("ys")), lambda x: x), lambda k, v: k % 3)).alias("rekeyed"),
    )


@query("SELECT o_orderpriority AS name, CAST(e.ordinal AS INTEGER) AS ordinal, count(*) AS n FROM orders JOIN (VALUES (0, '1-URGENT'), (1, '2-HIGH'), (2, '3-MEDIUM'), (3, '4-LOW'), (4, '5-NONE')) AS e(ordinal, name) ON name = o_orderpriority GROUP BY ALL UNION ALL SELECT 'none of these', -1, count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-LOW', '5-NONE') OR o_orderpriority IS NULL HAVING count(*) > 0")
def enum_entries(read):
    """Rows by an enumeration's entries, as a table of its own."""
    entries = C.enum_values("1-URGENT", "2-HIGH", "3-MEDIUM", "4-LOW", "5-NONE")
    orders = read("orders")
    table = orders.sparkSession.range(1).select(F.inline(entries))
    rows = orders.join(F.broadcast(table), F.col("name") == F.col("o_orderpriority"), "left")
    return rows.groupBy(F.coalesce("name", F.lit("none of these")).alias("name"), F.coalesce("ordinal", F.lit(-1)).alias("ordinal")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_size * p_size + 1 AS squared, 'p' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS label, p_size > 25 AS large FROM part WHERE p_size % 2 = 0")
def extension_functions(read):
    part = read("part")
    extensions.define(part.sparkSession, "plus_square", "x INT", "INT", "x * x + 1")
    extensions.define(part.sparkSession, "label_of", "prefix STRING, n BIGINT", "STRING", "prefix || lpad(CAST(n AS STRING), 6, '0')")
    return extensions.chain(
        part, lambda df: df.where("p_size % 2 = 0"), lambda df: df.select("p_partkey", F.expr("plus_square(p_size)").alias("squared"), F.expr("label_of('p', p_partkey)").alias("label"), (F.col("p_size") > 25).alias("large"))
    )


# --- scalars ---------------------------------------------------------------------------------------------------------
@query(
    "SELECT p_partkey, "
    + _columns(
        spelled="array_to_string(list_transform(range(1, length(p_brand) + 1), lambda i: substring(p_brand, CAST(i AS INTEGER), 1)), '-')", empty="p_type = ''", not_empty="p_type <> ''", left_trimmed="'  ' || p_name", right_trimmed="p_name || '  '", digits="len(regexp_extract_all(p_brand, '[0-9]'))", letters="len(regexp_extract_all(p_brand, '[A-Za-z]'))",
        spaces="len(regexp_extract_all(p_name, ' '))", uppers="len(regexp_extract_all(p_brand, '[A-Z]'))", lowers="len(regexp_extract_all(p_brand, '[a-z]'))", either="len(regexp_extract_all(p_brand, '[A-Za-z0-9]'))", filled="p_name || ' is ' || p_size || ' of ' || p_brand", made="chr(65 + p_size % 26)", apart="CAST(ord(p_name) - 97 AS INTEGER)",
        as_int="p_size + 1", as_long="CAST(p_partkey AS BIGINT) * 10000000000", as_double="CAST(p_size AS DOUBLE) / 2", no_double="coalesce(TRY_CAST(p_brand AS DOUBLE), -1.5)", said="CAST(p_size AS VARCHAR)", kind="true", cast_or="coalesce(TRY_CAST(p_name AS INTEGER), -1)", inserted="left(p_brand, 2) || '_' || substring(p_brand, 3)", cut="left(p_brand, 1) || substring(p_brand, 3)",
    )
    + " FROM part"
)
def text_forms(read):
    n, b, t, s = F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size")
    spaced = F.concat(F.lit("  "), n, F.lit("  "))
    count = lambda of, text: F.size(F.filter(S.chars(text), of)).cast("long")
    return read("part").select(
        "p_partkey", F.array_join(S.chars(b), "-").alias("spelled"), S.is_empty(t).alias("empty"), S.is_not_empty(t).alias("not_empty"), S.trim_end(spaced).alias("left_trimmed"), S.trim_start(spaced).alias("right_trimmed"), count(S.is_digit, b).alias("digits"), count(S.is_letter, b).alias("letters"), count(S.is_whitespace, n).alias("spaces"),
        count(S.is_upper, b).alias("uppers"), count(S.is_lower, b).alias("lowers"), count(S.is_letter_or_digit, b).alias("either"), S.template("%s is %d of %s", n, s, b).alias("filled"), S.to_char(s % 26 + 65).alias("made"), S.char_distance(n, F.lit("a")).alias("apart"), (S.to_int(S.to_string(s)) + 1).alias("as_int"),
        (S.to_long(S.to_string(F.col("p_partkey"))) * 10000000000).alias("as_long"), (S.to_double(S.to_string(s)) / 2).alias("as_double"), S.elvis(S.to_double_or_null(b), -1.5).alias("no_double"), S.to_string(s).alias("said"), S.is_type(s, "int").alias("kind"), S.elvis(S.as_or_null(n, "int"), -1).alias("cast_or"), S.insert(b, 2, "_").alias("inserted"), S.delete_char_at(b, 1).alias("cut"),
    )


@query(
    "SELECT p_partkey, round(pow(p_size, 2.5), 6) AS powered, round(pi() * p_size, 9) AS around, round(exp(1) * p_size, 9) AS grown, CAST(p_partkey AS BIGINT) // 8 AS shifted, NOT p_size > 10 AS negated, p_size >= 10 AND p_size < 20 OR p_size = 7 AS chosen, p_size IS NOT NULL AS there, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS said FROM part"
)
def number_forms(read):
    s = F.col("p_size")
    return read("part").select(
        "p_partkey", F.round(S.pow_(s, 2.5), 6).alias("powered"), F.round(S.pi() * s, 9).alias("around"), F.round(S.e() * s, 9).alias("grown"), S.ushr(F.col("p_partkey"), 3).alias("shifted"), (~(s > 10)).alias("negated"), (((s >= 10) & (s < 20)) | (s == 7)).alias("chosen"), s.isNotNull().alias("there"),
        S.when_((s < 10, "small"), (s < 30, "middle"), otherwise="large").alias("said"),
    )


# --- vectors and memories --------------------------------------------------------------------------------------------
@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings) SELECT vec_id, round(list_sum(list_transform(list_zip(a, list_reverse(a)), lambda p: p[1] * p[2] * p[1])), 9) AS bound FROM v")
def vec_bind(read):
    a = F.col("embedding").cast("array<double>")
    return read("embeddings").select("vec_id", F.round(vectors.dot(vectors.bind(a, F.reverse(a)), a), 9).alias("bound"))


def _som(read, side: int = 4) -> vectors.Som:
    """A map whose codebook is the first vectors of the table, so that its cells are known."""
    som = vectors.Som(side)
    som.codebook = vectors.matrix(read("embeddings").where(F.col("vec_id") < side * side).orderBy("vec_id"), "embedding")
    return som


_CELLS = "b AS (SELECT vec_id AS cell, CAST(embedding AS DOUBLE[]) AS b FROM embeddings WHERE vec_id < 16), c AS (SELECT vec_id, arg_max(cell, list_inner_product(b, CAST(embedding AS DOUBLE[]))) AS cell FROM embeddings, b GROUP BY 1)"


@query(f"WITH {_CELLS} SELECT vec_id, CAST(cell AS INTEGER) AS cell FROM c")
def som_cells(read):
    return _som(read).assign(read("embeddings"), "embedding").select("vec_id", "cell")


@query(
    f"WITH {_CELLS}, n AS (SELECT q.vec_id AS query_id, q.cell AS own, c.vec_id AS id, c.cell FROM c q JOIN c ON abs(q.cell // 4 - c.cell // 4) <= 1 AND abs(q.cell % 4 - c.cell % 4) <= 1 WHERE q.vec_id % 50 = 0) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CAST(cell <> own AS INTEGER), cell, id) AS rank FROM n QUALIFY rank <= 6"
)
def som_neighbours(read):
    som = _som(read)
    rows = som.assign(read("embeddings"), "embedding")
    near = som.neighbourhood(rows, rows.where("vec_id % 50 = 0"), "cell", 6, "vec_id")
    return near.select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_custkey AS key, max(o_orderkey) AS at, arg_max(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY 1")
def hopfield_remember(read):
    """Orders of a memory's first half, then those of the second half as news, which win."""
    rows = read("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("value"))
    half = rows.agg(F.floor(F.avg("at")).alias("half"))
    both = rows.join(F.broadcast(half))
    old, new = both.where("at <= half").drop("half"), both.where("at > half").drop("half")
    return vectors.remember(vectors.remember(old.limit(0), old, "key", "at"), new, "key", "at")


_BITS = "list_transform(range(0, 128), lambda i: ((CAST('0x' || substring(md5(token), CAST(i // 4 AS INTEGER) + 1, 1) AS INTEGER) >> CAST(3 - i % 4 AS INTEGER)) & 1) * 2 - 1)"
_TURNED = "list_concat({0}[128 - {1} + 1 :], {0}[: 128 - {1}])"


@query(
    f"""
WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations),
t AS (SELECT conv_id, turn, unnest(w) AS token, unnest(range(len(w))) AS pos FROM w), v AS (SELECT token, {_BITS} AS v FROM (SELECT DISTINCT token FROM t)),
p AS (SELECT conv_id, turn, pos, v, lead(v, 1) OVER o AS b, lead(v, 2) OVER o AS c FROM t JOIN v USING (token) WINDOW o AS (PARTITION BY conv_id, turn ORDER BY pos)),
g AS (SELECT conv_id, turn, v AS x FROM p UNION ALL SELECT conv_id, turn, list_transform(list_zip(v, {_TURNED.format('b', 1)}, {_TURNED.format('c', 2)}), lambda z: z[1] * z[2] * z[3]) FROM p WHERE c IS NOT NULL),
d AS (SELECT conv_id, turn, dim, CASE WHEN sum(x) >= 0 THEN 1 ELSE -1 END AS s FROM (SELECT conv_id, turn, unnest(x) AS x, unnest(range(128)) AS dim FROM g) GROUP BY ALL)
SELECT a.conv_id, a.turn, round(sum(a.s * b.s) / 128, 9) AS similarity FROM d a JOIN d b ON a.conv_id = b.conv_id AND a.dim = b.dim AND b.turn = a.turn + 1 GROUP BY 1, 2
"""
)
def md5_hypervectors(read):
    """How alike each turn and the next one are."""
    rows = read("conversations").select("conv_id", "turn", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("w"))
    hv = vectors.md5_hypervectors(rows, ["conv_id", "turn"], "w")
    pairs = hv.join(hv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("hv").alias("next_hv")), ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(vectors.similarity(F.col("hv"), F.col("next_hv")), 9).alias("similarity"))


@query(
    "WITH v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) - 1 AS back, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), d AS (SELECT label, dim, sum(0.15 * pow(0.85::DOUBLE, back) * x) AS s FROM (SELECT label, back, unnest(x) AS x, unnest(range(len(x))) AS dim FROM v) GROUP BY 1, 2) SELECT label, string_agg(CASE WHEN s >= 0 THEN 1 ELSE -1 END, ',' ORDER BY dim) AS context FROM d GROUP BY 1"
)
def predictive_context(read):
    return state.leaky_context(read("embeddings"), ["label"], "vec_id", "embedding").select("label", _text(F.col("context")).alias("context"))


@query(
    "WITH RECURSIVE v AS (SELECT vec_id % 4 AS grp, vec_id, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) AS r FROM embeddings), f AS (SELECT grp, CAST(0 AS BIGINT) AS r, 1.0::DOUBLE AS e, 0.35::DOUBLE AS t FROM (SELECT DISTINCT grp FROM v) UNION ALL SELECT f.grp, f.r + 1, f.e * 0.95::DOUBLE + 0.05::DOUBLE * x.s, greatest(0.1::DOUBLE, least(0.8::DOUBLE, f.t + 0.01::DOUBLE * (f.e * 0.95::DOUBLE + 0.05::DOUBLE * x.s - 1))) FROM f JOIN (SELECT grp, r, CASE WHEN r = 1 THEN 1 ELSE 2 END AS s FROM v) x ON x.grp = f.grp AND x.r = f.r + 1) SELECT grp, max(r) AS learned, round(arg_max(e, r), 6) AS branching, round(arg_max(t, r), 6) AS threshold FROM f GROUP BY 1"
)
def learned_memories(read):
    """Learners that see two templates in turn whose vectors are equal signs: each pair from the second one on spreads over the tie between both."""
    rows = read("embeddings").select((F.col("vec_id") % 4).alias("grp"), "vec_id", F.concat(F.lit("t"), F.floor(F.col("vec_id") / 4) % 2).alias("source"), F.lit("answer").alias("target"), F.array_repeat(F.lit(1.0), 8).alias("signs"))
    out = state.learn(rows, ["grp"], "vec_id", "source", "target", "signs").where("id = 0")
    return out.select("grp", "learned", F.round("branching", 6).alias("branching"), F.round("threshold", 6).alias("threshold"))


# --- graphs ----------------------------------------------------------------------------------------------------------
@query(
    "WITH d AS (SELECT n_nationkey AS nation, CASE WHEN n_nationkey % 3 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS name, n_nationkey AS decl FROM nation UNION ALL SELECT NULL, NULL, NULL WHERE false), r AS (SELECT n_nationkey, n_regionkey FROM nation), reg AS (SELECT r_regionkey AS region, 'AUTOMOBILE' AS name, 100 + r_regionkey AS decl FROM region) SELECT c_custkey AS ref, CAST(coalesce(d.decl, reg.decl, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1000 END) AS BIGINT) AS decl FROM customer JOIN r ON n_nationkey = c_nationkey LEFT JOIN d ON d.nation = c_nationkey AND d.name = c_mktsegment LEFT JOIN reg ON region = n_regionkey AND reg.name = c_mktsegment WHERE coalesce(d.decl, reg.decl, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1000 END) IS NOT NULL"
)
def resolved_references(read):
    """Customers' segments as names, declared in nations, in regions or at the top."""
    nation, region = read("nation"), read("region")
    scope = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    top = nation.sparkSession.createDataFrame([("top", None)], "scope string, parent string")
    scopes = nation.select(scope("n", "n_nationkey").alias("scope"), scope("r", "n_regionkey").alias("parent")).unionByName(region.select(scope("r", "r_regionkey").alias("scope"), F.lit("top").alias("parent"))).unionByName(top)
    named = F.when(F.col("n_nationkey") % 3 == 0, "BUILDING").otherwise("MACHINERY")
    decls = nation.select(F.col("n_nationkey").cast("long").alias("decl"), named.alias("name"), scope("n", "n_nationkey").alias("scope"))
    decls = decls.unionByName(region.select((F.col("r_regionkey") + 100).cast("long").alias("decl"), F.lit("AUTOMOBILE").alias("name"), scope("r", "r_regionkey").alias("scope")))
    decls = decls.unionByName(top.select(F.lit(1000).cast("long").alias("decl"), F.lit("HOUSEHOLD").alias("name"), F.col("scope")))
    refs = read("customer").select(F.col("c_custkey").alias("ref"), F.col("c_mktsegment").alias("name"), scope("n", "c_nationkey").alias("scope"))
    return graphs.resolve(refs, decls, scopes).select("ref", "decl")


#: Parts as a tree under three roots, with the dependencies among parts beside it; who reads whom.
_READS = f"{_PART_EDGES}, reads AS (SELECT src, dst FROM e UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey >= 3)"


def _part_tree(read):
    key = F.col("p_partkey")
    return read("part").select(key.alias("node"), F.when(key >= 3, S.div(key, F.lit(3).cast("long"))).alias("parent"), (key * 37 % 1009).alias("own"))


def _greatest(own, met):
    return F.greatest(own, met)


@query(f"WITH RECURSIVE {_READS}, n AS (SELECT p_partkey AS node, p_partkey * 37 % 1009 AS own FROM part), r AS (SELECT node AS start, node FROM n UNION SELECT r.start, reads.dst FROM r JOIN reads ON r.node = reads.src) SELECT r.node, max(n.own) AS value FROM r JOIN n ON n.node = r.start GROUP BY 1")
def reevaluated_tree(read):
    return graphs.reevaluate(_part_tree(read), _part_edges(read), F.max, _greatest).select("node", "value")


@query(f"WITH RECURSIVE {_READS}, r AS (SELECT DISTINCT src AS start, src AS node FROM e UNION SELECT r.start, reads.dst FROM r JOIN reads ON r.node = reads.src) SELECT start, count(*) AS size FROM r GROUP BY 1")
def perturbed_and_restored(read):
    """Each part that others depend on gets a value above all others: what reads it, directly or not, changes once."""
    nodes, edges = _part_tree(read), _part_edges(read)
    state = graphs.reevaluate(nodes, edges, F.max, _greatest)
    renamed = edges.select(F.col("src").alias("node")).distinct().select("node", (F.col("node") + 5000).alias("own"))
    return graphs.perturb(state, renamed, nodes, edges, F.max, _greatest)


# --- Spark's own SQL -------------------------------------------------------------------------------------------------
@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_linestatus) AS INTEGER) AS level, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_lines(read):
    return read("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping("l_linestatus").cast("int").alias("level"), F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def grouping_sets_lines(read):
    sets = [[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_linenumber")], []]
    return read("lineitem").groupingSets(sets, "l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'without', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'all_without', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'all_both', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier)")
def set_operations(read):
    customers, buyers = read("customer").select("c_custkey"), read("orders").select("o_custkey")
    homes, sources = read("customer").select("c_nationkey"), read("supplier").select("s_nationkey")
    found = {"both": customers.intersect(buyers), "without": customers.subtract(buyers), "either": homes.union(sources).distinct(), "all_without": homes.exceptAll(sources), "all_both": homes.intersectAll(sources)}
    out = None
    for kind, df in found.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT l_returnflag, true AS near_count, true AS near_median FROM lineitem GROUP BY 1")
def approximate_aggregates(read):
    """Estimates within their stated errors of what is counted exactly beside them."""
    near = lambda a, b, share: F.abs(a - b) <= share * b
    out = read("lineitem").groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.count_distinct("l_partkey").alias("b"), F.percentile_approx("l_extendedprice", 0.5, 10_000).alias("c"), F.percentile("l_extendedprice", F.lit(0.5)).alias("d")
    )
    return out.select("l_returnflag", near(F.col("a"), F.col("b"), 0.1).alias("near_count"), near(F.col("c"), F.col("d"), 0.02).alias("near_median"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(o_orderdate + INTERVAL 40 DAY AS DATE) AS later, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INTEGER) AS days, strftime(o_orderdate, '%Y/%m') AS text, last_day(CAST(o_orderdate AS DATE)) AS ending FROM orders")
def date_scalars(read):
    d = F.col("o_orderdate")
    return read("orders").select(
        "o_orderkey", F.year(d).alias("y"), F.quarter(d).alias("q"), F.trunc(d.cast("date"), "month").alias("month"), (d + F.expr("INTERVAL 40 DAYS")).cast("date").alias("later"), F.datediff(F.lit("2000-01-01").cast("date"), d).alias("days"), F.date_format(d, "yyyy/MM").alias("text"), F.last_day(d).alias("ending")
    )


@query("SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k, CAST(coalesce(json_array_length(json_keys(props)), 0) AS INTEGER) AS n_keys, props->>'$.none' AS nothing FROM events")
def json_scalars(read):
    parsed = F.from_json("props", "map<string,string>")
    return read("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.coalesce(F.size(F.map_keys(parsed)), F.lit(0)).alias("n_keys"), F.get_json_object("props", "$.none").alias("nothing"))


@query("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) SELECT c_custkey, round(total, 2) AS total FROM customer c JOIN big ON o_custkey = c_custkey WHERE total > (SELECT avg(total) FROM big) AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
def subqueries_and_views(read):
    orders, customer = read("orders"), read("customer")
    orders.createOrReplaceTempView("lattica_orders")
    customer.createOrReplaceTempView("lattica_customer")
    return orders.sparkSession.sql("""
        WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM lattica_orders GROUP BY 1)
        SELECT c_custkey, round(total, 2) AS total FROM lattica_customer c JOIN big ON o_custkey = c_custkey
        WHERE total > (SELECT avg(total) FROM big) AND EXISTS (SELECT 1 FROM lattica_orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')
    """)


@query("SELECT epoch_us(s) AS start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY 1")
def sliding_windows(read):
    out = events.sliding(read("events"), "ts", "1 hour", "30 minutes", "value")
    return out.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "n", F.round("total", 4).alias("total"))


@query("SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_seen_events(read):
    rows = read("events").select("event_type", "user_id", "event_id", "ts")
    firsts = events.first_seen(rows, ["event_type", "user_id"], "ts").select("event_type", "user_id")
    return firsts.join(rows, ["event_type", "user_id"]).groupBy("event_type", "user_id").agg(F.min("event_id").alias("event_id"))


@query("SELECT n.n_nationkey, count(*) AS n FROM nation n JOIN supplier s ON s.s_acctbal > n.n_nationkey * 400 AND s.s_nationkey <> n.n_nationkey GROUP BY 1")
def theta_join(read):
    """Suppliers by thresholds of nations, 25 of them by definition of the table: the small side is checked and broadcast."""
    return joins.theta(read("supplier"), read("nation").select("n_nationkey"), (F.col("s_acctbal") > F.col("n_nationkey") * 400) & (F.col("s_nationkey") != F.col("n_nationkey"))).groupBy("n_nationkey").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, round(coalesce(sum(value), 0), 4) AS total, first_value FROM (SELECT user_id, event_type, value, first(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS first_value FROM events) GROUP BY user_id, event_type, first_value")
def window_and_aggregate(read):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    rows = read("events").withColumn("first_value", F.first("event_id").over(w))
    return rows.groupBy("user_id", "event_type", "first_value").agg(F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"))

