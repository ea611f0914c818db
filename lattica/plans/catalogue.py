"""All named queries and, for those that SQL can say, their DuckDB text. A query reads whole tables from a folder of Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lattica.functions import collections as C, scalars as S
from lattica.operators import corpus, graphs, joins, ordered, scopes, state, vectors

from .registry import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES"]

def _orders_with_quantities(read) -> DataFrame:
    """o, xs: each order's whole quantities in order of line numbers."""
    return ordered.group_collect(read("lineitem").select(F.col("l_orderkey").alias("o"), "l_linenumber", F.col("l_quantity").cast("long").alias("q")), ["o"], "q", "l_linenumber", "xs")


_XS = "WITH a AS (SELECT l_orderkey AS o, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)) AS xs FROM lineitem GROUP BY 1) "
_LIST = "array_to_string({}, ',')"


def _text(xs):
    return F.array_join(F.transform(xs, lambda x: x.cast("string")), ",")


# --- words, filters, folds -------------------------------------------------------------------------------------------
@query("SELECT token, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) GROUP BY 1 ORDER BY cnt DESC, token LIMIT 50")
def token_freq_topk(read):
    return corpus.top_tokens(corpus.token_counts(read("documents"), corpus.words_of(F.col("text"))), 50)


@query("SELECT CAST(coalesce(sum(CAST(l_quantity AS BIGINT) * l_linenumber), 0) AS BIGINT) AS total FROM lineitem WHERE l_quantity > 20 AND l_returnflag = 'R'")
def filter_map_sum(read):
    rows = read("lineitem").where((F.col("l_quantity") > 20) & (F.col("l_returnflag") == "R"))
    return ordered.sum_of(rows, F.col("l_quantity").cast("long") * F.col("l_linenumber"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT coalesce(l_quantity > 10, false)")
def filter_not_rows(read):
    return ordered.filter_not(read("lineitem"), F.col("l_quantity") > 10).select("l_orderkey", "l_linenumber")


@query("SELECT event_id FROM events WHERE value IS NOT NULL")
def filter_not_null_rows(read):
    return ordered.filter_not_null(read("events"), "value").select("event_id")


@query(
    "SELECT l_orderkey, bool_or(l_quantity > 40) AS any_true, bool_and(l_quantity > 40) AS all_true, count(*) FILTER (l_quantity > 40) AS n_true, NOT bool_or(l_quantity > 40) AS none_true FROM lineitem GROUP BY 1"
)
def any_all_none(read):
    return ordered.any_all_none(read("lineitem"), ["l_orderkey"], F.col("l_quantity") > 40)


@query("SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS keys FROM orders GROUP BY 1")
def group_collect(read):
    return ordered.group_collect(read("orders"), ["o_custkey"], "o_orderkey", "o_orderkey", "xs").select("o_custkey", _text("xs").alias("keys"))


@query("SELECT o_custkey AS key, arg_max(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY 1")
def associate_last_wins(read):
    return ordered.associate(read("orders"), F.col("o_custkey"), F.col("o_orderstatus"), "o_orderkey")


@query("SELECT coalesce(l_quantity > 25, false) AS matches, count(*) AS n FROM lineitem GROUP BY 1")
def partition_counts(read):
    return ordered.partition_flag(read("lineitem"), F.col("l_quantity") > 25).groupBy("matches").agg(F.count("*").alias("n"))


@query(
    "SELECT block, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 100) AS BIGINT) AS block FROM orders) GROUP BY 1"
)
def chunked_blocks(read):
    rows = ordered.chunked(ordered.with_ordinal(read("orders").select("o_orderkey"), ["o_orderkey"]), "i", 100)
    return rows.groupBy("block").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query(
    "SELECT c.i, c_custkey, s_suppkey FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_custkey FROM customer) c JOIN (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, s_suppkey FROM supplier) s ON c.i = s.i"
)
def zip_shortest(read):
    return ordered.zip_positional(ordered.with_ordinal(read("customer").select("c_custkey"), ["c_custkey"]), ordered.with_ordinal(read("supplier").select("s_suppkey"), ["s_suppkey"]))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def distinct_first(read):
    return ordered.distinct_first(read("events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20 OFFSET 30")
def take_drop(read):
    rows = read("part").select("p_partkey", "p_name")
    return ordered.take(ordered.drop(rows, "p_partkey", 30), "p_partkey", 20)


@query("SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS rank FROM part")
def sorted_by_stable(read):
    return ordered.sorted_with_rank(read("part").select("p_partkey", "p_size"), F.col("p_size"), "p_partkey", descending=True)


@query(
    "WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), f AS (SELECT user_id, r, (7 + event_id % 10) % 1000003 AS v FROM (SELECT *, 0 AS z FROM e WHERE r = 1) UNION ALL SELECT e.user_id, e.r, (f.v * 31 + e.event_id % 10) % 1000003 FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1) SELECT user_id, CAST(arg_max(v, r) AS BIGINT) AS folded FROM f GROUP BY 1"
)
def fold_ordered(read):
    start = F.lit(None).cast("long")
    f = lambda a, x: F.when(a.isNull(), (F.lit(7) + x % 10) % 1000003).otherwise((a * 31 + x % 10) % 1000003)
    return ordered.fold_ordered(read("events"), ["user_id"], "event_id", "event_id", start, f)


@query("SELECT o_custkey, min(o_orderkey) AS first_value, max(o_orderkey) AS last_value FROM orders GROUP BY 1")
def first_last_per_key(read):
    return ordered.first_last(read("orders"), ["o_custkey"], "o_orderkey", "o_orderkey")


@query(
    "SELECT o_custkey, coalesce(min(o_orderkey) FILTER (o_totalprice > 100000), -1) AS first_index, coalesce(max(o_orderkey) FILTER (o_totalprice > 100000), -1) AS last_index FROM orders GROUP BY 1"
)
def index_of_match(read):
    return ordered.index_of(read("orders"), ["o_custkey"], "o_orderkey", F.col("o_totalprice") > 100000)


@query("SELECT n_regionkey, string_agg(upper(n_name), '; ' ORDER BY n_nationkey) AS joined FROM nation GROUP BY 1")
def join_to_string(read):
    return ordered.join_to_string(read("nation"), ["n_regionkey"], F.upper("n_name"), "n_nationkey", "; ")


@query("SELECT min(l_extendedprice) AS least, max(l_extendedprice) AS largest FROM lineitem")
def extremes(read):
    return ordered.extremes(read("lineitem"), "l_extendedprice", strict=True)


@query("SELECT n_nationkey - CASE WHEN n_nationkey > 7 THEN 1 ELSE 0 END AS n_nationkey, n_name FROM nation WHERE n_nationkey <> 7")
def remove_at(read):
    return ordered.remove_at(read("nation").select("n_nationkey", "n_name"), "n_nationkey", 7)


@query(
    "WITH m AS (SELECT f, q AS mode FROM (SELECT l_returnflag AS f, l_quantity AS q, count(*) AS c FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY f ORDER BY c DESC, q) = 1) SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, round(var_pop(l_quantity), 6) AS variance, max(l_quantity) - min(l_quantity) AS spread, mode FROM lineitem JOIN m ON m.f = l_returnflag GROUP BY l_returnflag, mode"
)
def stats_summary(read):
    out = ordered.statistics(read("lineitem"), ["l_returnflag"], "l_quantity")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("variance", F.round("variance", 6))


@query(
    "SELECT CAST(coalesce(least(floor((l_extendedprice - lo) * 10 / (hi - lo)), 9), 0) AS INTEGER) AS bucket, count(*) AS n FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY 1"
)
def equal_width_histogram(read):
    return ordered.equal_width_histogram(read("lineitem"), "l_extendedprice", 10)


@query(
    "WITH v AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + 1800000000 AS e FROM events), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM v), g AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS no FROM m) SELECT user_id, min(s) AS s, max(e) AS e FROM g GROUP BY user_id, no"
)
def merge_intervals(read):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return ordered.merge_intervals(read("events").select("user_id", at.alias("s"), (at + 1_800_000_000).alias("e")), ["user_id"], "s", "e")


@query(
    "SELECT user_id, CAST(coalesce(max(CASE WHEN n = 3 THEN s END), 0) AS BIGINT) AS largest_sum FROM (SELECT user_id, sum(event_id % 17) OVER w AS s, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING)) GROUP BY 1"
)
def window_max_sum(read):
    return ordered.window_max_sum(read("events").select("user_id", "event_id", (F.col("event_id") % 17).alias("x")), ["user_id"], "event_id", "x", 3)


@query(
    "WITH t AS (SELECT conv_id, turn, role, lead(role, 1) OVER w AS b, lead(role, 2) OVER w AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, role || '|' || b || '|' || c AS gram FROM t WHERE c IS NOT NULL"
)
def ngrams3(read):
    return ordered.ngrams(read("conversations"), ["conv_id"], "turn", "role", 3).select("conv_id", "turn", F.array_join("gram", "|").alias("gram"))


# --- array forms -----------------------------------------------------------------------------------------------------
@query(
    _XS
    + "SELECT o, "
    + ", ".join(
        f"{e} AS {n}"
        for n, e in {
            "mapped": _LIST.format("list_transform(xs, lambda x: x * 2)"), "kept": _LIST.format("list_filter(xs, lambda x: x > 20)"), "not_kept": _LIST.format("list_filter(xs, lambda x: NOT x > 20)"),
            "indexed": _LIST.format("list_transform(xs, lambda x, i: x * (i - 1))"), "flat": _LIST.format("flatten(list_transform(xs, lambda x: [x, -x]))"), "back": _LIST.format("list_reverse(xs)"),
        }.items()
    )
    + " FROM a"
)
def array_elements(read):
    xs = F.col("xs")
    return _orders_with_quantities(read).select(
        "o", _text(C.map_(xs, lambda x: x * 2)).alias("mapped"), _text(C.filter_(xs, lambda x: x > 20)).alias("kept"), _text(C.filter_not(xs, lambda x: x > 20)).alias("not_kept"),
        _text(C.map_indexed(xs, lambda i, x: x * i)).alias("indexed"), _text(C.flat_map(xs, lambda x: F.array(x, -x))).alias("flat"), _text(C.reversed_(xs)).alias("back"),
    )


@query(
    _XS
    + "SELECT o, len(list_filter(xs, lambda x: x > 45)) > 0 AS has_any, len(list_filter(xs, lambda x: x > 3)) = len(xs) AS has_all, len(list_filter(xs, lambda x: x > 49)) = 0 AS has_none, CAST(len(list_filter(xs, lambda x: x % 2 = 0)) AS INTEGER) AS evens, CAST(list_sum(xs) AS BIGINT) AS total, CAST(list_sum(list_transform(xs, lambda x: x * x)) AS BIGINT) AS squares, round(list_avg(xs), 9) AS average, list_max(xs) AS largest, list_min(xs) AS least, CAST(list_sum(xs) + 100 AS BIGINT) AS folded, CAST(list_sum(xs) AS BIGINT) AS reduced FROM a"
)
def array_folds(read):
    xs = F.col("xs")
    return _orders_with_quantities(read).select(
        "o", C.any_(xs, lambda x: x > 45).alias("has_any"), C.all_(xs, lambda x: x > 3).alias("has_all"), C.none(xs, lambda x: x > 49).alias("has_none"), C.count(xs, lambda x: x % 2 == 0).alias("evens"), C.sum_(xs).alias("total"), C.sum_of(xs, lambda x: x * x).alias("squares"),
        F.round(C.average(xs), 9).alias("average"), C.max_(xs).alias("largest"), C.min_or_null(xs).alias("least"), C.fold(xs, F.lit(100).cast("long"), lambda a, x: a + x).alias("folded"), C.reduce_(xs, lambda a, x: a + x).alias("reduced"),
    )


@query(
    _XS
    + ", k AS (SELECT o, list(x ORDER BY x % 5, i) AS up, list(x ORDER BY x % 5 DESC, i) AS down FROM (SELECT o, unnest(xs) AS x, unnest(range(len(xs))) AS i FROM a) GROUP BY o) "
    + "SELECT o, "
    + ", ".join(f"{_LIST.format(e)} AS {n}" for n, e in {"sorted": "list_sort(xs)", "falling": "list_reverse_sort(xs)", "by_key": "up", "by_key_down": "down", "head": "xs[1:2]", "tail": "xs[3:]", "middle": "xs[2:3]"}.items())
    + ", xs[1] AS first_x, xs[-1] AS last_x, coalesce(list_filter(xs, lambda x: x > 30)[1], -1) AS found, coalesce(list_filter(xs, lambda x: x > 30)[-1], -1) AS found_last FROM a JOIN k USING (o)"
)
def array_order_and_parts(read):
    xs = F.col("xs")
    texts = {
        "sorted": C.sorted_(xs), "falling": C.sorted_descending(xs), "by_key": C.sorted_by(xs, lambda x: x % 5), "by_key_down": C.sorted_by_descending(xs, lambda x: x % 5), "head": C.take(xs, 2), "tail": C.drop(xs, 2), "middle": C.sub_list(xs, 1, 3),
    }
    big = lambda x: x > 30
    return _orders_with_quantities(read).select("o", *[_text(e).alias(n) for n, e in texts.items()], C.first(xs).alias("first_x"), C.last(xs).alias("last_x"), S.elvis(C.find(xs, big), -1).alias("found"), S.elvis(C.find_last(xs, big), -1).alias("found_last"))


@query(
    _XS
    + "SELECT o, CAST(coalesce(list_position(list_transform(xs, lambda x: x > 30), true), 0) - 1 AS INTEGER) AS first_at, CAST(CASE WHEN len(list_filter(xs, lambda x: x > 30)) = 0 THEN -1 ELSE len(xs) - list_position(list_transform(list_reverse(xs), lambda x: x > 30), true) END AS INTEGER) AS last_at, list_contains(xs, 7) AS has7, "
    + "array_to_string(list_transform(range(0, len(xs), 2), lambda s: array_to_string(xs[s + 1 : s + 2], '+')), ',') AS chunks, array_to_string(list_transform(range(0, len(xs) - 1), lambda s: array_to_string(xs[s + 1 : s + 2], '+')), ',') AS windows, array_to_string(list_transform(range(0, len(xs) - 1), lambda s: CAST(xs[s + 1] * xs[s + 2] AS VARCHAR)), ',') AS zipped, '<' || array_to_string(list_transform(xs, lambda x: 'q' || x), ' ') || '>' AS joined, "
    + "array_to_string(list_transform(list_reverse(xs), lambda x: x), ',') AS seq FROM a"
)
def array_search_and_blocks(read):
    xs = F.col("xs")
    big = lambda x: x > 30
    blocks = lambda b: F.array_join(F.transform(b, lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "+")), ",")
    down = F.transform(C.down_to(C.last_index(xs), F.lit(0)), lambda i: F.get(xs, i.cast("int")))
    return _orders_with_quantities(read).select(
        "o", C.index_of_first(xs, big).alias("first_at"), C.index_of_last(xs, big).alias("last_at"), C.contains(xs, 7).alias("has7"), blocks(C.chunked(xs, 2)).alias("chunks"), blocks(C.windowed(xs, 2)).alias("windows"),
        _text(C.zip_(xs, C.drop(xs, 1), lambda a, b: a * b)).alias("zipped"), C.join_to_string(xs, " ", "<", ">", lambda x: F.concat(F.lit("q"), x.cast("string"))).alias("joined"), _text(down).alias("seq"),
    )


@query(
    _XS
    + ", u AS (SELECT o, unnest(xs) AS x, unnest(range(len(xs))) AS i FROM a), d AS (SELECT o, x, min(i) AS i FROM u GROUP BY 1, 2), dd AS (SELECT o, array_to_string(list(x ORDER BY i), ',') AS uniq FROM d GROUP BY o), g AS (SELECT o, x % 3 AS k, string_agg(x, '+' ORDER BY i) AS v, arg_max(x, i) AS lastx FROM u GROUP BY 1, 2), gg AS (SELECT o, string_agg(k || '=' || v, ';' ORDER BY k) AS grouped, string_agg(k || '=' || lastx, ';' ORDER BY k) AS assoc, string_agg(k || '=' || (lastx + k), ';' ORDER BY k) AS changed FROM g GROUP BY o) "
    + "SELECT o, uniq, grouped, assoc, changed, coalesce((SELECT lastx FROM g WHERE g.o = a.o AND k = 1), -5) AS with_default, array_to_string(list_filter(xs, lambda x: x > 20), ',') || '|' || array_to_string(list_filter(xs, lambda x: NOT x > 20), ',') AS parts FROM a JOIN dd USING (o) JOIN gg USING (o)"
)
def array_groups_and_maps(read):
    xs = F.col("xs")
    key = lambda x: x % 3
    flat = lambda m, f: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"].cast("string"), F.lit("="), f(e["value"]))), ";")
    text = lambda v: v.cast("string")
    assoc = C.associate_by(xs, key)
    split = C.partition(xs, lambda x: x > 20)
    return _orders_with_quantities(read).select(
        "o", _text(C.distinct(xs)).alias("uniq"), flat(C.group_by(xs, key), lambda v: F.array_join(F.transform(v, text), "+")).alias("grouped"), flat(assoc, text).alias("assoc"), flat(C.map_values(assoc, lambda k, v: v + k), text).alias("changed"),
        C.get_or_default(assoc, F.lit(1).cast("long"), F.lit(-5).cast("long")).alias("with_default"), F.concat(_text(split["matching"]), F.lit("|"), _text(split["rest"])).alias("parts"),
    )


@query(
    _XS
    + "SELECT o, "
    + ", ".join(
        f"{_LIST.format(e)} AS {n}"
        for n, e in {
            "added": "list_append(xs, 0)", "both": "list_concat(xs, xs)", "inserted": "list_concat(list_append(xs[1:1], -1), xs[2:])", "removed_at": "list_concat(xs[1:1], xs[3:])", "popped": "xs[1:len(xs) - 1]", "range_up": "range(0, CAST(xs[1] AS BIGINT), 3)", "squares": "list_transform(range(0, len(xs)), lambda i: i * i)",
        }.items()
    )
    + ", CAST(0 AS INTEGER) AS cleared FROM a"
)
def array_changed_copies(read):
    xs = F.col("xs")
    texts = {
        "added": C.add(xs, F.lit(0).cast("long")), "both": C.add_all(xs, xs), "inserted": C.insert_at(xs, 1, F.lit(-1).cast("long")), "removed_at": C.remove_at(xs, 1), "popped": C.pop(xs), "range_up": C.until(F.lit(0), F.get(xs, F.lit(0)), 3), "squares": C.array_of(F.size(xs), lambda i: i * i),
    }
    return _orders_with_quantities(read).select("o", *[_text(e).alias(n) for n, e in texts.items()], F.size(C.clear(xs)).alias("cleared"))


# --- scalars ---------------------------------------------------------------------------------------------------------
@query(
    "SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS len, CASE WHEN length(p_brand) >= 12 THEN p_brand ELSE lpad(p_brand, 12, '*') END AS padded, CASE WHEN length(p_brand) >= 12 THEN p_brand ELSE rpad(p_brand, 12, '.') END AS padded_end, CAST(strpos(p_name, 'a') - 1 AS INTEGER) AS at, starts_with(p_name, 'P') AS starts, suffix(p_name, '1') AS ends, contains(p_type, 'E') AS has, replace(p_type, 'A', '.') AS replaced, array_to_string(string_split(p_type, ' '), '_') AS joined, substring(p_name, 2, 3) AS mid, repeat(p_brand, 2) AS twice, left(p_name, 3) AS head, substring(p_name, 4) AS tail, reverse(p_name) AS back, nullif(substring(p_name, 3, 1), '') AS third, upper(p_name) AS up, lower(p_type) AS low, trim(concat(' ', p_name, '  ')) AS trimmed, p_brand || p_size AS text, CAST(ord(p_name) AS INTEGER) AS code, chr(ord(p_name) + 1) AS following, coalesce(TRY_CAST(p_brand AS INTEGER), -1) AS number FROM part"
)
def string_scalars(read):
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return read("part").select(
        "p_partkey", S.length(n).alias("len"), S.pad_start(b, 12, "*").alias("padded"), S.pad_end(b, 12, ".").alias("padded_end"), S.index_of(n, "a").alias("at"), S.starts_with(n, "P").alias("starts"), S.ends_with(n, "1").alias("ends"), S.contains(t, "E").alias("has"), S.replace(t, "A", ".").alias("replaced"),
        S.join(S.split(t, " "), "_").alias("joined"), S.substring(n, 1, 4).alias("mid"), S.repeat(b, 2).alias("twice"), S.take(n, 3).alias("head"), S.drop(n, 3).alias("tail"), S.reversed_(n).alias("back"), S.char_at(n, 2).alias("third"), S.upper_ascii(n).alias("up"), S.lower_ascii(t).alias("low"),
        S.trim(F.concat(F.lit(" "), n, F.lit("  "))).alias("trimmed"), S.plus(b, F.col("p_size")).alias("text"), S.code(n).alias("code"), S.char_plus(n, 1).alias("following"), S.elvis(S.to_int_or_null(b), -1).alias("number"),
    )


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey // 7 AS quotient, -l_partkey % 7 AS remainder, (l_partkey << 3) AS shl, (l_partkey >> 1) AS shr, l_partkey & 12 AS band, l_partkey | 3 AS bor, xor(l_partkey, 5) AS bxor, greatest(l_partkey, l_suppkey) AS larger, least(l_partkey, l_suppkey) AS smaller, abs(l_suppkey - l_partkey) AS distance, round(sqrt(l_partkey), 9) AS root, CAST(floor(l_extendedprice) AS BIGINT) AS down, CAST(ceil(l_extendedprice) AS BIGINT) AS up, CASE WHEN l_quantity < 10 THEN 'few' WHEN l_quantity < 30 THEN 'some' ELSE 'many' END AS amount, coalesce(nullif(l_returnflag, 'N'), '-') AS flag FROM lineitem"
)
def number_scalars(read):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return read("lineitem").select(
        "l_orderkey", "l_linenumber", S.div(p, F.lit(7)).alias("quotient"), S.rem(-p, F.lit(7)).alias("remainder"), S.shl(p, 3).alias("shl"), S.shr(p, 1).alias("shr"), S.bit_and(p, F.lit(12)).alias("band"), S.bit_or(p, F.lit(3)).alias("bor"), S.bit_xor(p, F.lit(5)).alias("bxor"), S.max_of(p, s).alias("larger"), S.min_of(p, s).alias("smaller"),
        S.abs_(s - p).alias("distance"), F.round(S.sqrt(p), 9).alias("root"), S.floor(F.col("l_extendedprice")).alias("down"), S.ceil(F.col("l_extendedprice")).alias("up"), S.when_((F.col("l_quantity") < 10, "few"), (F.col("l_quantity") < 30, "some"), otherwise="many").alias("amount"), S.elvis(F.nullif(F.col("l_returnflag"), F.lit("N")), "-").alias("flag"),
    )


# --- joins -----------------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey, coalesce(c_mktsegment, 'none') AS c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_nationkey < 5")
def lookup_default(read):
    wanted = read("customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return joins.lookup_default(read("orders"), wanted, "o_custkey", "c_mktsegment", "none").select("o_orderkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def members_semi(read):
    return joins.members(read("customer"), read("orders").where("o_totalprice > 200000").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphans_anti(read):
    return joins.orphans(read("customer"), read("orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey")


@query("SELECT doc_id, min(item_id) AS least_item FROM documents JOIN benchmark ON contains(lower(documents.text), lower(benchmark.text)) WHERE length(trim(benchmark.text)) > 0 GROUP BY 1")
def leakage_containment(read):
    return joins.containment(read("documents"), read("benchmark"), "text", "item_id", "text").select("doc_id", "least_item")


@query("SELECT count(*) AS n_clean FROM documents WHERE lower(trim(text)) NOT IN (SELECT lower(trim(text)) FROM benchmark WHERE text IS NOT NULL)")
def leakage_anti(read):
    same = F.lower(F.trim("text")).alias("t")
    return joins.orphans(read("documents").select("doc_id", same), read("benchmark").select(same), ["t"]).agg(F.count("*").alias("n_clean"))


@query(
    "WITH b AS (SELECT DISTINCT p_brand FROM part WHERE p_size <= 3), s AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT l_suppkey FROM s WHERE p_brand IN (SELECT p_brand FROM b) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM b)"
)
def relational_division(read):
    part = read("part")
    pairs = read("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand")
    return joins.relational_division(pairs, "l_suppkey", "p_brand", part.where("p_size <= 3"))


@query(
    "WITH s AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders), i AS (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 300000), z AS (SELECT o_orderstatus, count(*) AS n FROM i GROUP BY 1) SELECT o_custkey, o_orderstatus FROM s JOIN i USING (o_orderpriority) JOIN z USING (o_orderstatus) GROUP BY o_custkey, o_orderstatus, n HAVING count(*) = n"
)
def satisfies_all(read):
    orders = read("orders")
    return joins.satisfies(orders, orders.where("o_totalprice > 300000"), "o_custkey", "o_orderstatus", "o_orderpriority")


@query(
    "WITH r AS (SELECT r_regionkey AS i, r_name, left(r_name, 2) AS prefix FROM region) SELECT n_nationkey, arg_min(r_name, i) AS r_name FROM nation LEFT JOIN r ON starts_with(n_name, prefix) GROUP BY 1"
)
def longest_prefix(read):
    table = read("region").select(F.col("r_regionkey").alias("i"), "r_name", F.substring("r_name", 1, 2).alias("prefix"))
    return joins.first_prefix(read("nation").select("n_nationkey", "n_name"), "n_name", table, "prefix", "i").select("n_nationkey", "r_name")


@query(
    "SELECT a.event_id, coalesce(arg_max(b.event_id, (b.ts, b.event_id)), -1) AS previous_purchase FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts <= a.ts AND a.event_type <> 'purchase' WHERE a.event_type <> 'purchase' GROUP BY 1"
)
def as_of(read):
    events = read("events")
    right = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("previous_purchase"))
    return joins.as_of(events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "previous_purchase").select("event_id", S.elvis(F.col("previous_purchase"), -1).alias("previous_purchase"))


@query("SELECT p_partkey, s_suppkey FROM part, supplier WHERE p_retailprice >= s_acctbal AND p_retailprice < s_acctbal + 50")
def range_join(read):
    spans = read("supplier").select("s_suppkey", F.col("s_acctbal").alias("a"), (F.col("s_acctbal") + 50).alias("b"))
    return joins.range_join(read("part"), spans, "p_retailprice", "a", "b", 100.0).select("p_partkey", "s_suppkey")


# --- corpus ----------------------------------------------------------------------------------------------------------
_TOKENS = "WITH t AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)) "


def _document_tokens(read) -> DataFrame:
    return read("documents").select("doc_id", F.posexplode(corpus.words_of(F.col("text"))).alias("pos", "token"))


@query(
    _TOKENS + ", f AS (SELECT doc_id, token, min(pos) AS p FROM t GROUP BY 1, 2), n AS (SELECT doc_id, token, dense_rank() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS r FROM f) SELECT doc_id, count(*) AS n_tokens, CAST(sum(r) AS BIGINT) AS sum_ranks, max(r) AS last_rank FROM t JOIN n USING (doc_id, token) GROUP BY 1"
)
def first_appearance_ids(read):
    named = corpus.anonymize(_document_tokens(read).withColumn("value", F.concat(F.lit("v_"), "token")), ["doc_id"], "pos")
    rank = F.substring("placeholder", 3, 20).cast("long")
    return named.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum(rank).alias("sum_ranks"), F.max(rank).alias("last_rank"))


@query("SELECT doc_id, md5(array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ')) AS restored, CAST(len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: x <> '_'))) AS BIGINT) AS n_placeholders FROM documents WHERE regexp_matches(text, '[A-Za-z]')")
def anonymize_roundtrip(read):
    named = corpus.anonymize(_document_tokens(read).withColumnRenamed("token", "value"), ["doc_id"], "pos")
    mapping = corpus.placeholder_map(named, ["doc_id"])
    back = ordered.group_collect(corpus.deanonymize(named, mapping, ["doc_id"]), ["doc_id"], "restored", "pos", "words")
    counts = mapping.groupBy("doc_id").agg(F.count("*").alias("n_placeholders"))
    return back.join(counts, "doc_id").select("doc_id", F.md5(F.array_join("words", " ")).alias("restored"), "n_placeholders")


@query(
    _TOKENS + ", c AS (SELECT token, count(*) AS cnt FROM t GROUP BY 1 HAVING count(*) >= 5) SELECT row_number() OVER (ORDER BY cnt DESC, token) + 3 AS id, token, cnt FROM c UNION ALL SELECT * FROM (VALUES (0, '<pad>', 0), (1, '<bos>', 0), (2, '<eos>', 0), (3, '<unk>', 0)) AS s(id, token, cnt)"
)
def vocabulary(read):
    return corpus.vocabulary(corpus.token_counts(read("documents"), corpus.words_of(F.col("text"))), 5)


@query(
    _TOKENS + ", c AS (SELECT token, count(*) AS cnt FROM t GROUP BY 1 HAVING count(*) >= 5), v AS (SELECT row_number() OVER (ORDER BY cnt DESC, token) + 3 AS id, token FROM c) SELECT doc_id, CAST(sum(coalesce(id, 3)) AS BIGINT) AS sum_ids, count(*) FILTER (id IS NULL) AS n_unknown FROM t LEFT JOIN v USING (token) GROUP BY 1"
)
def encode_documents(read):
    vocab = corpus.vocabulary(corpus.token_counts(read("documents"), corpus.words_of(F.col("text"))), 5)
    return corpus.encode(_document_tokens(read), vocab).groupBy("doc_id").agg(F.sum("id").alias("sum_ids"), F.count_if(F.col("id") == 3).alias("n_unknown"))


@query(
    "SELECT lang, count(*) AS n, count(*) FILTER (p = quality) AS n_right, round(avg(CASE WHEN p = quality THEN 1 ELSE 0 END), 9) AS accuracy FROM (SELECT lang, quality, CAST(n_chars > 400 AS INTEGER) AS p FROM documents JOIN labels USING (doc_id)) GROUP BY 1"
)
def label_accuracy(read):
    rows = read("documents").join(read("labels"), "doc_id").withColumn("p", (F.col("n_chars") > 400).cast("int"))
    return corpus.accuracy(rows, "p", "quality", ["lang"]).withColumn("accuracy", F.round("accuracy", 9))


@query(
    "WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS a, lead(string_split(text, ' ')) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT conv_id, turn, CAST(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i])) AS INTEGER) AS hits, CAST(greatest(len(a), len(b)) AS INTEGER) AS places FROM t WHERE b IS NOT NULL"
)
def token_accuracy(read):
    from pyspark.sql import Window

    rows = read("conversations").withColumn("a", S.split(F.col("text"), " "))
    rows = rows.withColumn("b", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return rows.select("conv_id", "turn", corpus.token_accuracy(F.col("a"), F.col("b")).alias("r")).select("conv_id", "turn", "r.*")


@query(
    """
SELECT p_size AS project, array_to_string(list_sort(list_distinct(list('import lib' || p_partkey % 5))), ';') AS imports, string_agg(body, chr(10) ORDER BY main, path) AS body
FROM (SELECT p_size, p_partkey, p_name || '/' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS path, CAST(p_partkey % 4 = 0 AS INTEGER) AS main,
             CASE WHEN p_partkey % 4 = 0 THEN 'fun main() {}' || chr(10) ELSE '' END || p_name AS body FROM part) GROUP BY 1
"""
)
def project_merge(read):
    key = F.col("p_partkey")
    body = F.concat(F.lit("import lib"), (key % 5).cast("string"), F.lit("\n"), F.when(key % 4 == 0, F.lit("fun main() {}\n")).otherwise(F.lit("")), F.col("p_name"))
    path = F.concat("p_name", F.lit("/"), F.lpad(key.cast("string"), 9, "0"))
    merged = corpus.merge_projects(read("part").select(F.col("p_size").alias("project"), path.alias("path"), body.alias("source")))
    return merged.select("project", F.array_join("imports", ";").alias("imports"), "body")


@query(
    "SELECT p_partkey, 'func f(a_param: Int64, b: Int64) {\nvar a = a_param a += ' || p_size || '; var i = b; while (i > 0) { i -= 1 \ni += 2\n} var i_2 = 0; var s = \"i\"; g(i_2, x.i) }' AS fixed FROM part"
)
def scope_fixes(read):
    text = F.concat(F.lit("func f(a: Int64, b: Int64) { a += "), "p_size", F.lit('; var i = b; while (i > 0) {/*step: i += 2*/ i -= 1 } var i = 0; var s = "i"; g(i, x.i) }'))
    return scopes.apply(read("part").select("p_partkey", text.alias("text")), "text").select("p_partkey", "fixed")


@query(
    "SELECT count(*) AS cases, count(*) FILTER (o_totalprice > 50000) AS compiled, count(*) FILTER (o_totalprice > 150000) AS matched, CAST(sum(o_custkey) AS BIGINT) AS chunks, CAST(sum(o_custkey // 2) AS BIGINT) AS confident, round(sum(o_custkey // 2) / sum(o_custkey), 9) AS coverage, round(avg(0.4 * CAST(CASE WHEN o_custkey > 0 THEN (o_custkey // 2) / o_custkey ELSE 0 END AS DOUBLE) + CASE WHEN o_totalprice > 50000 THEN 0.4 ELSE 0 END + CASE WHEN o_totalprice > 150000 THEN 0.2 ELSE 0 END), 9) AS score, count(*) FILTER (NOT (o_totalprice > 50000 AND o_totalprice > 150000)) AS n_failing FROM orders"
)
def run_summary(read):
    cases = read("orders").select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_custkey").alias("chunks"), S.div(F.col("o_custkey"), F.lit(2)).alias("confident"), (F.col("o_totalprice") > 50000).alias("compiled"), (F.col("o_totalprice") > 150000).alias("matched"))
    return corpus.run_summary(cases).withColumn("coverage", F.round("coverage", 9)).withColumn("score", F.round("score", 9))


# --- vectors ---------------------------------------------------------------------------------------------------------
@query(
    "WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(a, CAST(embedding AS DOUBLE[])), 9) AS score FROM q, embeddings) SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10"
)
def vec_topk_cosine(read):
    rows = read("embeddings")
    best = vectors.top_k(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", 10)
    return best.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(
    "SELECT label, dim, round(CAST(sum(CAST(CAST(x AS DOUBLE) AS DECIMAL(20, 6))) AS DOUBLE) / count(*), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim FROM embeddings) GROUP BY 1, 2"
)
def vec_mean_by_label(read):
    sums = vectors.vector_sum(read("embeddings"), ["label"], "embedding")
    return sums.select("label", "dim", F.round(F.col("total").cast("double") / F.col("n"), 6).alias("mean"))


@query(
    "WITH s AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM embeddings), t AS (SELECT label, dim, CASE WHEN sum(CAST(CAST(x AS DOUBLE) AS DECIMAL(20, 9))) >= 0 THEN 1 ELSE -1 END AS sign FROM s GROUP BY 1, 2) SELECT label, array_to_string(list(sign ORDER BY dim), ',') AS bundle FROM t GROUP BY 1"
)
def bundle_sign(read):
    return vectors.bundle(read("embeddings"), ["label"], "embedding").select("label", _text(F.col("bundle")).alias("bundle"))


@query(
    "WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 100 = 50), s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(a, CAST(embedding AS DOUBLE[])), 9) AS score FROM q, embeddings WHERE vec_id % 50 <> 0), e AS (SELECT *, exp((score - max(score) OVER (PARTITION BY query_id)) / 0.1) AS x FROM s), p AS (SELECT *, x / sum(x) OVER (PARTITION BY query_id) AS p, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM e) SELECT query_id, id, round(score, 6) AS score, round(p, 6) AS p, p >= 0.55 AND score >= 0.3 AS accepted FROM p WHERE rank = 1 UNION ALL SELECT vec_id, vec_id + 1, 1, 1, true FROM embeddings WHERE vec_id % 100 = 0"
)
def softmax_recall(read):
    """Every other query has the surface form of a row of the memory."""
    key = F.col("vec_id")
    rows = read("embeddings").withColumn("surface", F.concat(F.lit("s"), F.when(key % 100 == 0, key + 1).otherwise(key)))
    found = vectors.recall(rows.where("vec_id % 50 = 0"), rows.where("vec_id % 50 <> 0"), "vec_id", "embedding", "surface")
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.round("p", 6).alias("p"), "accepted")


@query(
    "WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x) AS a FROM embeddings), r AS (SELECT vec_id, a, list_concat(a[len(a) - 2 :], a[1 : len(a) - 3]) AS b FROM v) SELECT vec_id, round(sqrt(list_inner_product(a, a)), 6) AS norm, round(list_cosine_similarity(a, b), 6) AS turned FROM r"
)
def vec_norm_permute(read):
    v = F.col("v")
    rows = read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rows.select("vec_id", F.round(vectors.norm(v), 6).alias("norm"), F.round(vectors.cosine(v, vectors.permute(v, 3)), 6).alias("turned"))


@query(
    "WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents), m AS (SELECT token, '^' || token || '$' AS s FROM t), g AS (SELECT token, 1.0 AS w, token AS g FROM m UNION ALL SELECT token, 0.5, substring(s, i, 2) FROM m, range(1, 50) r(i) WHERE i + 1 <= length(s) UNION ALL SELECT token, 0.5, substring(s, i, 3) FROM m, range(1, 50) r(i) WHERE i + 2 <= length(s)), h AS (SELECT token, w, CAST('0x' || substring(md5(g), 1, 8) AS BIGINT) % 64 AS slot, CAST('0x' || substring(md5(g), 9, 1) AS INTEGER) >= 8 AS up FROM g) SELECT token, CAST(slot AS INTEGER) AS slot, CAST(sum(CASE WHEN up THEN w ELSE -w END) AS DOUBLE) AS weight FROM h GROUP BY 1, 2"
)
def md5_embed(read):
    tokens = read("documents").select(F.explode(corpus.words_of(F.col("text"))).alias("token")).distinct().withColumn("key", F.col("token"))
    return vectors.md5_embed(tokens, "key", "token").withColumnRenamed("key", "token")


@query(None)
def hash_embed(read):
    out = vectors.embed(read("documents").select("doc_id", corpus.words_of(F.col("text")).alias("w")), "w")
    return out.select("doc_id", F.transform("vector", lambda x: F.round(x, 9)).alias("vector"))


@query(None)
def hypervector_similarity(read):
    rows = read("conversations").select("conv_id", "turn", corpus.words_of(F.col("text")).alias("w"))
    hv = vectors.hypervectors(rows, "w")
    pairs = hv.select("conv_id", "turn", "hv").join(hv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("hv").alias("next_hv")), ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(vectors.similarity(F.col("hv"), F.col("next_hv")), 9).alias("similarity"))


# --- graphs and state ------------------------------------------------------------------------------------------------
def _transitions(read) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    both = read("events").select(F.concat_ws("/", "event_type", F.col("user_id") % 7).alias("src"), F.lead(F.concat_ws("/", "event_type", F.col("user_id") % 7)).over(w).alias("dst"))
    return both.where("dst is not null").distinct()


_EDGES = "e AS (SELECT DISTINCT src, dst FROM (SELECT event_type || '/' || (user_id % 7) AS src, lead(event_type || '/' || (user_id % 7)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT DISTINCT src AS start, src AS node FROM e UNION SELECT r.start, e.dst FROM r JOIN e ON r.node = e.src) SELECT start, count(*) AS size FROM r GROUP BY 1")
def fixpoint_reach(read):
    edges = _transitions(read)
    return graphs.cascade_sizes(edges, edges.select(F.col("src").alias("node")))


#: Dependencies among parts: each third one has none, others depend downwards, and each seventh one back upwards, so there are cycles.
_PART_EDGES = "e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey % 3 <> 0 UNION SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 7 = 0 AND p_partkey + 1 IN (SELECT p_partkey FROM part))"


def _part_edges(read) -> DataFrame:
    part = read("part").select("p_partkey")
    down = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("src"), S.div(F.col("p_partkey"), F.lit(2).cast("long")).alias("dst"))
    up = part.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst")).join(part.select(F.col("p_partkey").alias("dst")), "dst", "left_semi").select("src", "dst")
    return down.unionByName(up)


@query(f"WITH RECURSIVE {_PART_EDGES}, n AS (SELECT p_partkey AS node, p_partkey * 37 % 1009 AS value FROM part), r AS (SELECT node AS start, node FROM n UNION SELECT r.start, e.dst FROM r JOIN e ON r.node = e.src) SELECT r.node, max(n.value) AS value FROM r JOIN n ON n.node = r.start GROUP BY 1")
def relax_fixpoint(read):
    nodes = read("part").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") * 37 % 1009).alias("value"))
    return graphs.relax(nodes, _part_edges(read)).select("node", "value")


@query(
    f"WITH RECURSIVE {_PART_EDGES}, s AS (SELECT p_partkey AS start, xor(p_partkey, 85) AS i FROM part), r AS (SELECT start, i, start AS node FROM s UNION SELECT r.start, r.i, e.dst FROM r JOIN e ON r.node = e.src), o AS (SELECT node, min(i) AS i FROM r GROUP BY 1) SELECT s.start, s.i, count(*) AS size FROM o JOIN s USING (i) GROUP BY 1, 2"
)
def grain_avalanches(read):
    starts = read("part").select(F.col("p_partkey").alias("node"), F.col("p_partkey").bitwiseXOR(85).alias("i"))
    return graphs.grains(starts, _part_edges(read))


@query(f"WITH RECURSIVE {_PART_EDGES}, r AS (SELECT src AS start, src AS node FROM e UNION SELECT r.start, e.dst FROM r JOIN e ON r.node = e.src) SELECT start, count(*) AS size FROM r GROUP BY 1")
def perturbation_sizes(read):
    return graphs.perturbation(_part_edges(read))


@query(
    "WITH RECURSIVE t AS (SELECT p_partkey AS node, CASE WHEN p_partkey < 3 THEN NULL ELSE p_partkey // 3 END AS parent FROM part), p AS (SELECT node, CAST(0 AS INTEGER) AS depth, CAST(node AS VARCHAR) AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.node, p.depth + 1, p.path || '/' || t.node FROM t JOIN p ON t.parent = p.node AND t.node <> p.node) SELECT node, depth, path FROM p"
)
def preorder_walk(read):
    key = F.col("p_partkey")
    tree = read("part").select(key.alias("node"), F.when(key >= 3, S.div(key, F.lit(3).cast("long"))).alias("parent"), key.alias("i"))
    return graphs.preorder(tree).select("node", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


@query("SELECT CAST(least(floor(log2(n)), 7) AS INTEGER) AS bin, count(*) AS n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def log2_histogram(read):
    sizes = read("orders").groupBy("o_custkey").agg(F.count("*").alias("s"))
    return graphs.log2_histogram(sizes, "s")


@query("SELECT count(*) AS n, round(1 + count(*) / sum(ln(s / 0.5)), 9) AS alpha FROM (SELECT o_custkey, count(*) AS s FROM orders GROUP BY 1)")
def powerlaw_alpha(read):
    return graphs.power_law(read("orders").groupBy("o_custkey").agg(F.count("*").alias("s")), "s").withColumn("alpha", F.round("alpha", 9))


_EMA = "WITH RECURSIVE v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM (SELECT user_id, event_id, coalesce(value, 0) AS value FROM events)), f AS (SELECT user_id, r, {first} FROM v WHERE r = 1 UNION ALL SELECT v.user_id, v.r, {step} FROM f JOIN v ON v.user_id = f.user_id AND v.r = f.r + 1) "


@query(_EMA.format(first="0.0::DOUBLE * 0.95 + value * (1 - 0.95::DOUBLE) AS e", step="f.e * 0.95::DOUBLE + v.value * (1 - 0.95::DOUBLE)") + "SELECT user_id, round(arg_max(e, r), 6) AS ema FROM f GROUP BY 1")
def ema_per_user(read):
    rows = read("events").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return state.ema(rows, ["user_id"], "event_id", "value").withColumn("ema", F.round("ema", 6))


@query(
    "WITH RECURSIVE v AS (SELECT user_id, CAST(event_id % 3 AS DOUBLE) AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), f AS (SELECT user_id, CAST(0 AS BIGINT) AS r, 1.0::DOUBLE AS e, 0.35::DOUBLE AS t FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT v.user_id, v.r, f.e * 0.95::DOUBLE + v.value * 0.05::DOUBLE, least(greatest(f.t + (f.e * 0.95::DOUBLE + v.value * 0.05::DOUBLE - 1) * 0.01::DOUBLE, 0.1::DOUBLE), 0.8::DOUBLE) FROM f JOIN v ON v.user_id = f.user_id AND v.r = f.r + 1) SELECT user_id, round(arg_max(e, r), 6) AS ema, round(arg_max(t, r), 6) AS threshold FROM f GROUP BY 1"
)
def ema_threshold(read):
    rows = read("events").withColumn("x", F.col("event_id") % 3)
    return state.controller(rows, ["user_id"], "event_id", "x").select("user_id", F.round("ema", 6).alias("ema"), F.round("threshold", 6).alias("threshold"))


@query(
    """
WITH v AS (SELECT label, vec_id, 't' || (vec_id % 20) AS source, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
n AS (SELECT label, source, min(vec_id) AS born, arg_min(x, vec_id) AS x, count(*) - 1 AS wins, row_number() OVER (PARTITION BY label ORDER BY min(vec_id)) - 1 AS id FROM v GROUP BY 1, 2),
-- what an observation finds: the neurons that were there before it, its own template's included
s AS (SELECT v.label, v.vec_id, own.id AS own, own.born < v.vec_id AS known, n.id AS other, row_number() OVER (PARTITION BY v.label, v.vec_id ORDER BY list_inner_product(n.x, v.x) DESC, n.id) AS place
      FROM v JOIN n own ON own.label = v.label AND own.source = v.source JOIN n ON n.label = v.label AND n.born < v.vec_id),
e AS (SELECT label, own AS a, other AS b FROM s WHERE NOT known AND place = 1
      UNION SELECT x.label, x.own, y.other FROM s x JOIN s y USING (label, vec_id) WHERE x.known AND x.place = 1 AND x.other = x.own AND y.place = 2),
both_ways AS (SELECT * FROM e UNION SELECT label, b, a FROM e),
near AS (SELECT label, a AS id, string_agg(b, ',' ORDER BY b) AS neighbours FROM both_ways GROUP BY 1, 2)
SELECT label, id, source, 'a' || arg_min(born, born) AS target, wins, coalesce(neighbours, '') AS neighbours FROM n LEFT JOIN near USING (label, id) GROUP BY label, id, source, wins, neighbours
"""
)
def soinn_memory(read):
    """Each template's first answer stays; answers here differ each time. Fewer than 200 neurons are born, so no tie is too old."""
    rows = read("embeddings").select("label", "vec_id", F.concat(F.lit("t"), F.col("vec_id") % 20).alias("source"), F.concat(F.lit("a"), "vec_id").alias("target"), "embedding")
    return state.soinn(rows, ["label"], "vec_id", "source", "target", "embedding").withColumn("neighbours", _text(F.col("neighbours")))


# --- Spark's own, without a counterpart ------------------------------------------------------------------------------
@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_lines(read):
    return read("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(read):
    from lattica.streaming import events

    return events.tumbling(read("events"), "ts", "1 hour", ["event_type"], "value").select(F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "event_type", "n")


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, no"
)
def session_windows(read):
    from lattica.streaming import events

    return events.sessions(read("events"), "ts", "2 hours", ["user_id"]).select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "n")


from . import programs, coverage  # noqa: E402, F401  more queries of the same registry
