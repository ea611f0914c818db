"""Queries of the corpus operators over small programs: each order is one, with a line for each of its line items.

What a line's tokens, statements and rewrites are is known from how it is made, so SQL can say what the operators must find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lattica.operators import corpus, memory
from lattica.sources import files
from lattica.tables import new_path

from .registry import query

#: o, i (place in the program), k (kind of line), p, q; raw: the line as it stands; spaced: its tokens, without comments.
_LINES = """WITH l AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i, l_linenumber % 4 AS k, l_partkey AS p, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
s AS (SELECT *, CASE k WHEN 1 THEN 'x' || p || ' := ' || q WHEN 2 THEN 'f(x' || p || ', ' || q || ')' WHEN 3 THEN 'if x' || p || ' > ' || q || ' { y++ }' ELSE 'z = "s;' || q || '" // note ' || p END AS raw,
             CASE k WHEN 1 THEN 'x' || p || ' := ' || q WHEN 2 THEN 'f ( x' || p || ' , ' || q || ' )' WHEN 3 THEN 'if x' || p || ' > ' || q || ' { y ++ }' ELSE 'z = "s;' || q || '"' END AS spaced FROM l)
"""


def _lines(read) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = read("lineitem").select(F.col("l_orderkey").alias("o"), (F.row_number().over(w) - 1).alias("i"), (F.col("l_linenumber") % 4).alias("k"), F.col("l_partkey").alias("p"), F.col("l_quantity").cast("long").alias("q"))
    p, q = F.col("p").cast("string"), F.col("q").cast("string")

    def text(one: str, two: str, three: str, four: str):
        fill = lambda form: F.replace(F.replace(F.lit(form), F.lit("@p"), p), F.lit("@q"), q)
        return F.when(F.col("k") == 1, fill(one)).when(F.col("k") == 2, fill(two)).when(F.col("k") == 3, fill(three)).otherwise(fill(four))

    raw = text("x@p := @q", "f(x@p, @q)", "if x@p > @q { y++ }", 'z = "s;@q" // note @p')
    return rows.withColumn("raw", raw).withColumn("spaced", text("x@p := @q", "f ( x@p , @q )", "if x@p > @q { y ++ }", 'z = "s;@q"'))


def _programs(read, head: str = "", foot: str = "") -> DataFrame:
    """o, text."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "raw"))), lambda s: s["raw"]), "\n")
    return _lines(read).groupBy("o").agg(F.concat(F.lit(head), lines, F.lit(foot)).alias("text"))


@query(_LINES + "SELECT o, count(*) AS n_lines, CAST(sum(len(string_split(spaced, ' '))) AS BIGINT) AS n_tokens, count(*) FILTER (k = 3) AS n_keywords, count(*) FILTER (k = 0) AS n_strings, count(*) FILTER (k = 0) AS n_comments, count(*) - 1 AS n_newlines FROM s GROUP BY 1")
def lex_programs(read):
    kinds = corpus.lex(_programs(read), "o", "text")
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return kinds.groupBy("o").agg((F.max("line")).cast("long").alias("n_lines"), (F.count("*") - count("comment") - count("newline")).alias("n_tokens"), *[count(k).alias(f"n_{k}s") for k in ("keyword", "string", "comment", "newline")])


@query(_LINES + "SELECT o, string_agg(spaced, ' ' ORDER BY i) AS tokens FROM s GROUP BY 1")
def trivia_filtered(read):
    rows = corpus.without_trivia(corpus.lex(_programs(read), "o", "text"))
    return rows.groupBy("o").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]), " ").alias("tokens"))


@query(_LINES + "SELECT o, i, spaced AS tokens, CASE WHEN k = 0 THEN spaced WHEN k = 3 THEN 'if x' || p || ' > ' || q || ' {' || chr(10) || '    y++' || chr(10) || '}' ELSE raw END AS text FROM s")
def word_tokens_and_text(read):
    rows = corpus.detokenized(corpus.tokenized(_lines(read), "raw", "words"), "words")
    return rows.select("o", "i", F.array_join("words", " ").alias("tokens"), "text")


@query(_LINES + "SELECT o, i AS chunk, spaced AS tokens FROM s")
def segment_by_depth(read):
    chunks = corpus.chunk_arrays(corpus.segment(corpus.lex(_programs(read), "o", "text"), "o"), "o")
    return chunks.select("o", F.col("chunk").cast("long").alias("chunk"), F.array_join("tokens", " ").alias("tokens"))


@query(_LINES + "SELECT o, string_agg(spaced, ' ; ' ORDER BY i) AS tokens FROM s GROUP BY 1")
def terminators(read):
    rows = corpus.insert_terminators(corpus.lex(_programs(read), "o", "text"), "o")
    return rows.groupBy("o").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]), " ").alias("tokens"))


@query(
    _LINES
    + """, u AS (SELECT o, -1 AS i, 0 AS j, 'header' AS part, 'func g ( ) {' AS text FROM (SELECT DISTINCT o FROM s)
      UNION ALL SELECT o, i, j, part, text FROM (SELECT o, i, unnest(CASE WHEN k = 3 THEN [1, 2, 3] ELSE [1] END) AS j, unnest(CASE WHEN k = 3 THEN ['header', 'statement', 'footer'] ELSE ['statement'] END) AS part, unnest(CASE WHEN k = 3 THEN ['if x' || p || ' > ' || q || ' {', 'y ++', '}'] ELSE [spaced] END) AS text FROM s)
      UNION ALL SELECT o, max(i) + 1, 0, 'footer', '}' FROM s GROUP BY o)
SELECT o, CAST(row_number() OVER (PARTITION BY o ORDER BY i, j) - 1 AS INTEGER) AS part_no, 'g' AS owner, part, text FROM u"""
)
def unfold_functions(read):
    chunks = corpus.chunk_arrays(corpus.segment(corpus.lex(_programs(read, "func g() {\n", "\n}\n"), "o", "text"), "o"), "o")
    lines = chunks.withColumn("tokens", F.filter("tokens", lambda t: t != ""))
    # newlines inside a function aren't tokens of its chunk: statements are told apart by terminators instead
    ended = corpus.insert_terminators(corpus.lex(_programs(read, "func g() {\n", "\n}\n"), "o", "text"), "o").withColumn("chunk", F.lit(0))
    lines = corpus.chunk_arrays(ended.where("kind <> 'newline'"), "o")
    parts = corpus.unfold_table(lines.withColumn("tokens", _without_last(F.col("tokens"))), "o")
    return parts.select("o", "part_no", "owner", "part", F.array_join("tokens", " ").alias("text"))


def _without_last(tokens):
    """Without the ; behind the last brace."""
    return F.when(F.try_element_at(tokens, F.lit(-1)) == ";", F.slice(tokens, 1, F.size(tokens) - 1)).otherwise(tokens)


@query(_LINES + "SELECT o, 'func f() {' || chr(10) || string_agg(raw, chr(10) ORDER BY i) || chr(10) || '}' || chr(10) || 'lost ' || count(*) AS text FROM s GROUP BY 1")
def function_splice(read):
    lines = _lines(read)
    ends = lines.groupBy("o").agg(F.count("*").alias("n"))
    parts = lines.select("o", F.lit("f").alias("owner"), F.lit("statement").alias("part"), "i", F.col("raw").alias("text"))
    for owner, part, at, text in (("f", "header", -1, F.lit("func f() {")), ("f", "footer", 10_000, F.lit("}")), ("none", "statement", 20_000, F.concat(F.lit("lost "), F.col("n").cast("string")))):
        parts = parts.unionByName(ends.select("o", F.lit(owner).alias("owner"), F.lit(part).alias("part"), F.lit(at).alias("i"), text.alias("text")))
    return corpus.splice(parts, "o")


@query(
    "WITH t AS (SELECT o, list_transform(xs, lambda x: CASE WHEN x % 5 = 0 THEN ';' WHEN x % 7 = 0 THEN '}' ELSE 'x' || x END) AS t FROM (SELECT l_orderkey AS o, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)) AS xs FROM lineitem GROUP BY 1)), k AS (SELECT o, array_to_string(list_filter(t, lambda x, i: NOT (x = ';' AND (coalesce(CASE WHEN i > 1 THEN t[i - 1] END, '}') = '}' OR coalesce(t[i + 1], '}') = '}'))), ' ') AS k FROM t) SELECT o, CASE WHEN regexp_matches(k, '^(; ?)*$') THEN '' ELSE regexp_replace(regexp_replace(k, '^(; )+', ''), '( ;)+$', '') END AS chunk FROM k"
)
def normalized_chunks(read):
    from .catalogue import _orders_with_quantities

    tokens = F.transform("xs", lambda x: F.when(x % 5 == 0, ";").when(x % 7 == 0, "}").otherwise(F.concat(F.lit("x"), x.cast("string"))))
    return _orders_with_quantities(read).select("o", F.array_join(corpus.normalize_chunk(tokens), " ").alias("chunk"))


# --- rewriting and matching ------------------------------------------------------------------------------------------
#: Rewrites without back references, which SQL's dialect of patterns lacks.
PLAIN_RULES = tuple(r for r in corpus.IDIOMS if "\\1" not in r[0] and "\\2" not in r[0])


PLAIN_FRAGILE = tuple(p for p in corpus.FRAGILE if "\\1" not in p)


def _fragile(text: str) -> str:
    return " OR ".join(f"regexp_matches({text}, '{p}')" for p in PLAIN_FRAGILE)


def _rewritten(text: str) -> str:
    for pattern, replacement in PLAIN_RULES:
        text = "regexp_replace({}, '{}', '{}', 'g')".format(text, pattern, replacement.replace("$", "\\"))
    return text


_CODE = """t AS (SELECT o, i, CASE q % 9 WHEN 0 THEN 'for _, v := range xs' || p || ' {' WHEN 1 THEN 'go func() { f(x' || p || ') }' WHEN 2 THEN '}' WHEN 3 THEN 'n := len(ys' || p || ')' WHEN 4 THEN 'a := make([]int, ' || q || ')' WHEN 5 THEN 'b := []int{1, ' || q || '}' WHEN 6 THEN 'func g' || p || '() {' WHEN 7 THEN 'i' || p || '--' ELSE 'fmt.Println(x' || p || ')' END AS text FROM l)"""


def _code(read) -> DataFrame:
    forms = ("for _, v := range xs@p {", "go func() { f(x@p) }", "}", "n := len(ys@p)", "a := make([]int, @q)", "b := []int{1, @q}", "func g@p() {", "i@p--", "fmt.Println(x@p)")
    form = F.element_at(F.array(*map(F.lit, forms)), (F.col("q") % 9 + 1).cast("int"))
    return _lines(read).select("o", "i", F.replace(F.replace(form, F.lit("@p"), F.col("p").cast("string")), F.lit("@q"), F.col("q").cast("string")).alias("text"))


@query(_LINES + ", " + _CODE + rf" SELECT o, i, CASE WHEN trim(text) = '}}' THEN 'identity' WHEN regexp_matches(text, '^\s*func[^}}]*\{{\s*$') OR {_fragile('text')} THEN 'fallback' ELSE 'template' END AS route, {_rewritten('text')} AS rewritten FROM t")
def route_and_rewrite(read):
    return _code(read).select("o", "i", corpus.route(F.col("text"), PLAIN_FRAGILE).alias("route"), corpus.rewrite(F.col("text"), PLAIN_RULES).alias("rewritten"))


@query(_LINES + """SELECT o, i, CASE k WHEN 1 THEN 'x' || p || ' = ' || q WHEN 3 THEN 'if x' || p || ' > ' || q || ' { yy }' ELSE raw END AS rewritten FROM s""")
def rewrite_outside_strings(read):
    """What stands in strings and comments isn't rewritten: a quoted ; and the word note are rules' targets too."""
    return corpus.rewrite_safe(_lines(read), "raw", ((":=", "="), (r"y\+\+", "yy"), (";", "#"), ("note", "gone"))).select("o", "i", "rewritten")


@query(_LINES + "SELECT o, i, CASE k WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS pattern_no, CASE k WHEN 1 THEN '$a=x' || p || ';$b=' || q WHEN 2 THEN '$a=x' || p || ';$b=' || q WHEN 3 THEN '$a=x' || p || ';$b=' || q || ';$c=y ++' ELSE '' END AS slots FROM s")
def pattern_slots(read):
    patterns = [corpus.Pattern(n, tuple(t.split())) for n, t in enumerate(("$a := $b", "f ( $a , $b )", "if $a > $b { $c }"))]
    found = corpus.best_patterns(_lines(read).withColumn("tokens", F.split("spaced", " ")), ["o", "i"], "tokens", patterns)
    slots = F.array_join(F.transform(F.array_sort(F.map_entries("slots")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("o", "i", "pattern_no", F.coalesce(slots, F.lit("")).alias("slots"))


@query(_LINES + "SELECT o, i, 'ID0 := ' || CASE WHEN q IN (0, 1) THEN CAST(q AS VARCHAR) ELSE 'NUM0' END AS source, 'var ID0 = ' || CASE WHEN q IN (0, 1) THEN CAST(q AS VARCHAR) ELSE 'NUM0' END AS target FROM s WHERE k = 1")
def anonymized_pairs(read):
    """Both texts of a pair share one map: the target's tokens come behind all of the source's."""
    pairs = _lines(read).where("k = 1").select("o", "i", F.split("spaced", " ").alias("a"), F.split(F.concat(F.lit("var "), F.replace("spaced", F.lit(":="), F.lit("="))), " ").alias("b"))
    tokens = pairs.select("o", "i", F.posexplode(F.concat("a", "b")).alias("pos", "value"), F.size("a").alias("n"))
    named = corpus.anonymize(tokens, ["o", "i"], "pos", keep=["var"])
    side = lambda p: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(p, F.struct("pos", "placeholder")))), lambda s: s["placeholder"]), " ")
    return named.groupBy("o", "i").agg(side(F.col("pos") < F.col("n")).alias("source"), side(F.col("pos") >= F.col("n")).alias("target"))


@query(
    "SELECT p_partkey AS a, p_size % 3 AS b, CASE p_size % 3 WHEN 0 THEN 'ID0=ID' || p_partkey || ';NUM2=NUM' || p_size WHEN 1 THEN 'ID4=ID' || p_partkey || ';ID7=NUM' || p_size ELSE 'ID1=ID' || p_partkey || ';ID2=NUM' || p_size END AS mapping FROM part"
)
def placeholder_alignment(read):
    """Texts of three shapes against one text of each: the k-th different placeholder of one is the k-th of the other."""
    n, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    forms = F.element_at(F.array(*map(F.lit, ("ID@n = NUM@s", "ID@n = ID@n + NUM@s", "f ( ID@n , NUM@s , ID@n )"))), F.col("p_size") % 3 + 1)
    left = read("part").select(F.col("p_partkey").alias("a"), F.replace(F.replace(forms, F.lit("@n"), n), F.lit("@s"), s).alias("t"))
    right = read("part").sparkSession.createDataFrame([(0, "ID0 = NUM2"), (1, "ID4 = ID4 + ID7"), (2, "f ( ID1 , ID2 , ID1 )")], "b int, t string")
    pairs = corpus.align(left, right, "t")
    return pairs.select("a", "b", F.array_join(F.transform(F.array_sort(F.map_entries("mapping")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("mapping"))


@query("SELECT p_partkey, 'ID' || p_partkey || ',NUM' || p_size || ',STR1' AS found FROM part")
def placeholders_found(read):
    text = F.concat(F.lit("f ( ID"), F.col("p_partkey").cast("string"), F.lit(" , NUM"), F.col("p_size").cast("string"), F.lit(" , STR1 , XID1 , ID )"))
    return read("part").select("p_partkey", F.array_join(corpus.placeholders(text), ",").alias("found"))


# --- learning and splitting ------------------------------------------------------------------------------------------
_CANON = r"regexp_replace(regexp_replace(trim({}), '\b(ID|NUM|STR|CHR)\d+\b', '\1', 'g'), '\s+', ' ', 'g')"


@query(
    f"WITH p AS (SELECT md5({_CANON.format('role')} || chr(1) || {_CANON.format('text')}) AS h FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL), f AS (SELECT h, CAST('0x' || substring(h, 1, 8) AS BIGINT) % 10000 < 1000 AS held FROM p) SELECT count(*) FILTER (NOT held) AS n_train, count(*) FILTER (held) AS n_held, count(*) FILTER (held AND h IN (SELECT h FROM f WHERE NOT held)) AS n_leaks FROM f"
)
def canonical_split(read):
    pairs = read("conversations").where("role is not null and text is not null").select(F.col("role").alias("source"), F.col("text").alias("target"))
    train, held = corpus.split_pairs(pairs, "source", "target", 0.1)
    kept, clean = corpus.without_leaks(train, held, "source", "target"), corpus.without_leaks(held, train, "source", "target")
    rows = corpus.union(train=kept.select("source"), held=held.select("source"), clean=clean.select("source"))
    of = lambda name: F.count_if(F.col("origin") == name)
    return rows.agg(of("train").alias("n_train"), of("held").alias("n_held"), (of("held") - of("clean")).alias("n_leaks"))


@query("SELECT origin, count(*) AS n FROM (SELECT 'a' AS origin FROM customer UNION ALL SELECT 'b' FROM supplier UNION ALL SELECT 'c' FROM nation) GROUP BY 1")
def union_of_sources(read):
    rows = corpus.union(a=read("customer").select(F.col("c_name").alias("name")), b=read("supplier").select(F.col("s_name").alias("name"), "s_acctbal"), c=read("nation").select(F.col("n_name").alias("name")))
    return rows.groupBy("origin").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CAST(3 AS BIGINT) AS variants, CAST(3 AS BIGINT) AS alike, CAST(3 AS BIGINT) AS paired FROM part")
def augmented_pairs(read):
    """Renumbered variants of each part's pair: all have its canonical form, and source and target stay consistent."""
    n, s = F.col("p_partkey").cast("string"), (F.col("p_partkey") + F.col("p_size") + 1).cast("string")
    pairs = read("part").select("p_partkey", F.concat(F.lit("ID"), n, F.lit(" := ID"), s).alias("source"), F.concat(F.lit("var ID"), n, F.lit(" = ID"), s).alias("target"))
    more = corpus.augment(pairs, "source", "target", 3, lambda t, seed: corpus.renumber(t, seed))
    form = corpus.canonical(F.col("source"), F.col("target")) == F.lit("ID := ID\u0001var ID = ID")
    paired = F.concat(F.lit("var "), F.replace("source", F.lit(":="), F.lit("="))) == F.col("target")
    return more.groupBy("p_partkey").agg(F.count("*").alias("variants"), F.count_if(form).alias("alike"), F.count_if(paired).alias("paired"))


@query("SELECT p_partkey, CAST(2 AS BIGINT) AS variants, CAST(2 AS BIGINT) AS renamed, CAST(2 AS BIGINT) AS paired FROM part")
def renamed_pairs(read):
    """Names that both sides share are renamed alike; strings, protected names and names of one side stay."""
    n = F.col("p_partkey").cast("string")
    pairs = read("part").select("p_partkey", F.concat(F.lit("name"), n, F.lit(' = show("name'), n, F.lit('")')).alias("source"), F.concat(F.lit("let name"), n, F.lit(' = show("name'), n, F.lit('")')).alias("target"))
    more = corpus.augment(pairs, "source", "target", 2, lambda t, seed: corpus.rename(t, seed, frozenset(["show"])))
    stays = F.concat(F.lit(' = show("name'), n, F.lit('")'))
    renamed = ~F.startswith("source", F.concat(F.lit("name"), n)) & F.endswith("source", stays)
    return more.groupBy("p_partkey").agg(F.count("*").alias("variants"), F.count_if(renamed).alias("renamed"), F.count_if(F.concat(F.lit("let "), "source") == F.col("target")).alias("paired"))


@query("SELECT conv_id, turn, md5(replace(text, 'a', 'b')) AS predicted FROM conversations")
def model_inference(read):
    asked = corpus.predict(read("conversations"), lambda: lambda batch: [None if t is None else t.replace("a", "b") for t in batch], "text")
    return asked.select("conv_id", "turn", F.md5("predicted").alias("predicted"))


@query("SELECT l_orderkey AS o, array_to_string(list_resize(list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)), 5, 0), ',') AS ids FROM lineitem GROUP BY 1")
def padded_ids(read):
    from .catalogue import _orders_with_quantities, _text

    return _orders_with_quantities(read).select("o", _text(corpus.pad(F.col("xs"), 5)).alias("ids"))


@query("SELECT conv_id, string_agg(coalesce(role, '?'), ' ' ORDER BY turn) AS decoded FROM conversations GROUP BY 1")
def decode_roles(read):
    """Roles as ids of a vocabulary, padded with marks, and back."""
    rows = read("conversations").select("conv_id", "turn", F.coalesce("role", F.lit("?")).alias("token"))
    vocab = corpus.vocabulary(rows.groupBy("token").agg(F.count("*").alias("cnt")))
    ids = corpus.encode(rows, vocab).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "id"))), lambda s: s["id"]).alias("ids"))
    words = vocab.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "token"))), lambda s: s["token"]).alias("words"))  # a handful of roles
    mark = lambda *ids: F.array(*[F.lit(i).cast("long") for i in ids])
    return ids.join(F.broadcast(words)).select("conv_id", F.array_join(corpus.decode(F.concat(mark(1), "ids", mark(0, 2, 4)), F.col("words")), " ").alias("decoded"))


@query(
    _LINES
    + "SELECT k || ':' || (q % 50) AS key, CASE k WHEN 1 THEN 'var ID0 = NUM0' WHEN 2 THEN 'f ( ID0 , NUM0 )' WHEN 3 THEN 'if ( ID0 > NUM0 ) { y += 1 }' END AS answer, CAST(CASE WHEN k = 0 THEN 0 ELSE 1 END AS DOUBLE) AS confidence, count(*) AS n FROM s GROUP BY ALL"
)
def associative_translation(read):
    """Lines without their numbers, asked of a memory of three pairs; assignments of strings it doesn't know."""
    forms = F.regexp_replace(F.regexp_replace("spaced", r"\bx\d+\b", "ID0"), r" \d+", " NUM0")
    asked = _lines(read).select(F.concat_ws(":", "k", F.col("q") % 50).alias("name"), F.regexp_replace(forms, r'"s;\d+"', "STR0").alias("text"))
    kinds = asked.groupBy("text").agg(F.min(F.crc32("text")).alias("key"))
    pairs = [(1, "ID0 := NUM0", "var ID0 = NUM0"), (2, "f ( ID0 , NUM0 )", "f ( ID0 , NUM0 )"), (3, "if ID0 > NUM0 { y ++ }", "if ( ID0 > NUM0 ) { y += 1 }")]
    known = asked.sparkSession.createDataFrame(pairs, "id long, source string, target string")
    answers = memory.translate(kinds, known).join(kinds, "key").select("text", "answer", "confidence")
    return asked.join(answers, "text").groupBy(F.col("name").alias("key"), "answer", F.col("confidence")).agg(F.count("*").alias("n"))


# --- declarations and files ------------------------------------------------------------------------------------------
_FIELDS = "f AS (SELECT p_size AS doc, p_brand AS cls, p_partkey AS i, 'a' || p_partkey AS name, p_type AS type FROM part), c AS (SELECT doc, cls, min(i) % 3 = 0 AS has_init FROM f GROUP BY 1, 2)"


def _fields(read) -> tuple[DataFrame, DataFrame]:
    fields = read("part").select(F.col("p_size").alias("doc"), F.col("p_brand").alias("cls"), F.col("p_partkey").alias("i"), F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("type"))
    return fields, fields.groupBy("doc", "cls").agg((F.min("i") % 3 == 0).alias("has_init"))


@query(f"WITH {_FIELDS} SELECT doc, cls, CASE WHEN NOT any_value(has_init) THEN 'init(' || string_agg(name || ': ' || type, ', ' ORDER BY i) || ') {{ ' || string_agg('this.' || name || ' = ' || name, '; ' ORDER BY i) || ' }}' END AS init FROM f JOIN c USING (doc, cls) GROUP BY 1, 2")
def struct_init_synthesis(read):
    fields, classes = _fields(read)
    return corpus.synthesize_init(classes, fields).select("doc", "cls", "init")


@query(
    f"WITH {_FIELDS}, m AS (SELECT doc, CASE WHEN i % 5 = 0 THEN 'free' ELSE cls END AS receiver, i, name AS body FROM f), own AS (SELECT doc, receiver AS cls, string_agg(body, ',' ORDER BY i) AS methods FROM m GROUP BY 1, 2) SELECT doc, cls, coalesce(methods, '') AS methods FROM c LEFT JOIN own USING (doc, cls) UNION ALL SELECT doc, 'free', string_agg(body, ',' ORDER BY i) FROM m WHERE receiver = 'free' GROUP BY 1"
)
def method_promotion(read):
    fields, classes = _fields(read)
    methods = fields.select("doc", F.when(F.col("i") % 5 == 0, "free").otherwise(F.col("cls")).alias("receiver"), "i", F.col("name").alias("body"))
    own, left = corpus.promote_methods(classes, methods)
    free = left.groupBy("doc", F.col("receiver").alias("cls")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "body"))), lambda s: s["body"]), ",").alias("methods"))
    return own.select("doc", "cls", F.array_join("methods", ",").alias("methods")).unionByName(free)


@query(_LINES + "SELECT o, count(*) AS n, md5(string_agg(raw, chr(10) ORDER BY i)) AS text FROM s GROUP BY 1")
def jsonl_pairs(read):
    """Lines as pairs of a JSON-lines sink, read back by the pair source, which numbers lines and drops pairs without both sides."""
    lines = _lines(read)
    spark = lines.sparkSession
    path = new_path(spark, "pairs")
    own = lines.select(F.concat_ws("/", "o", "i").alias("source"), F.col("raw").alias("target"))
    files.write_json(own, path, "gzip")
    back = files.read_pairs(spark, path)
    at = F.split("source", "/")
    rows = back.select(at[0].cast("long").alias("o"), at[1].cast("int").alias("i"), "target")
    return rows.groupBy("o").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "target"))), lambda s: s["target"]), "\n")).alias("text"))


@query("SELECT p_size AS project, count(*) AS n_files, md5(string_agg('// ' || p_name, chr(10) ORDER BY p_partkey)) AS text FROM part GROUP BY 1")
def text_files(read):
    """A text file for each size of part, written and read whole again."""
    part = read("part")
    spark = part.sparkSession
    path = new_path(spark, "texts")
    rows = part.select("p_size", "p_partkey", F.concat(F.lit("// "), "p_name").alias("value")).repartition("p_size").sortWithinPartitions("p_size", "p_partkey")
    rows.select("p_size", "value").write.partitionBy("p_size").text(path)
    texts = files.read_texts(spark, path).select(F.regexp_extract("path", r"p_size=(\d+)", 1).cast("int").alias("project"), F.rtrim(F.col("text"), F.lit("\n")).alias("text"))
    return texts.select("project", F.size(F.split("text", "\n")).cast("long").alias("n_files"), F.md5("text").alias("text"))
