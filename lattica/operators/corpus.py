"""Corpus processing: lexing, segmentation, placeholders, vocabularies, augmentation, splits, patterns, merging and scores.

Texts are worked on one document at a time, in Arrow batches, where a scanner needs state; everything that brings rows
of several documents together is a DataFrame plan.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lattica.tables import ready

# --- lexing ----------------------------------------------------------------------------------------------------------
#: These words are told from other names.
KEYWORDS = {
    "go": "break case chan const continue default defer else fallthrough false for func go goto if import interface iota map nil package range return select struct switch true type var",
    "kotlin": "as break class continue do else false for fun if in interface is null object package return super this throw true try typealias val var when while",
    "swift": "Any Self as associatedtype break case catch class continue convenience default defer deinit do else enum extension fallthrough false fileprivate final for func guard if import in init inout internal is lazy let mutating nil nonmutating open operator override private protocol public repeat required return self static struct subscript super switch throw throws true try typealias unowned var weak where while",
    "ts": "abstract any as async await boolean break case catch class const continue declare default delete do else enum export extends false finally for from function get if implements import in instanceof interface let module namespace never new null number of private protected public readonly return set static string super switch this throw true try type typeof undefined unknown var void while yield",
}
#: Kinds in the order they are tried; newlines are tokens, other white space isn't.
_KINDS = (
    ("comment", r"/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*"), ("space", r"[^\S\n]+"), ("newline", r"\n"), ("string", r'"""[\s\S]*?"""|"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])*\''),
    ("number", r"0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?"), ("name", r"[^\W\d]\w*"),
    ("mark", r"\.\.\.|\.\.<|<<=|>>=|===|!==|&\^=|\?\?=|\?\.|\?\?|\?:|:=|=>|->|<-|&\^|<<|>>|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|!!|::|\.\.|[^\w\s]"),
)
_SCAN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _KINDS))
TOKEN = "kind string, value string, line int, col int"


def scan(text: str, language: str = "go") -> list[tuple[str, str, int, int]]:
    """(kind, value, line, column) of each token, places from 1; keywords are told from other names."""
    words = _keywords(language)
    out, line, start = [], 1, 0
    for m in _SCAN.finditer(text):
        kind, value = m.lastgroup, m[0]
        if kind != "space":
            out.append(("keyword" if kind == "name" and value in words else kind, value, line, m.start() - start + 1))
        if "\n" in value:
            line += value.count("\n")
            start = m.start() + value.rfind("\n") + 1
    return out


@lru_cache
def _keywords(language: str) -> frozenset[str]:
    return frozenset(KEYWORDS[language].split())


def lex(df: DataFrame, id_col: str, text_col: str, language: str = "go") -> DataFrame:
    """id, pos, kind, value, line, col: a row per token; null texts have none."""
    ready(df.sparkSession)
    kind = dict(df.dtypes)[id_col]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, n, *t) for i, text in zip(part[id_col], part[text_col]) if text is not None for n, t in enumerate(scan(text, language))]
            yield pd.DataFrame(rows, columns=[id_col, "pos", "kind", "value", "line", "col"])

    return df.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, pos int, {TOKEN}")


def without_trivia(tokens: DataFrame) -> DataFrame:
    return tokens.where(~F.col("kind").isin("comment", "newline"))


def words_of(text: Column, pattern: str = "[a-z]+") -> Column:
    """Lowered ASCII words of a text, in SQL functions only."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)


def word_tokens(text: str) -> list[str]:
    """Words for a sequence model: quoted parts whole, longest operators first, no comments or white space."""
    return [v for k, v, _, _ in scan(text) if k not in ("comment", "newline")]


def tokenized(df: DataFrame, text: str, name: str = "tokens") -> DataFrame:
    """df with word_tokens() of each text, null for null."""
    ready(df.sparkSession)

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else word_tokens(t) for t in rows], dtype=object)

    return df.withColumn(name, run(text))


_NO_SPACE_BEFORE, _NO_SPACE_AFTER = frozenset(", ; ) ] . : ++ -- ? !".split()), frozenset("( [ . ! &".split())


def detokenize(tokens: Sequence[str]) -> str:
    """Text again: no space inside brackets and around dots, calls tight, a new line behind ; and around braces."""
    out, indent = "", 0
    last = None
    for t in tokens:
        if t == "}":
            indent = max(0, indent - 1)
            out = out.rstrip() + "\n" + "    " * indent + t
        elif last is None or out.endswith("\n"):
            out += "    " * indent + t
        else:
            tight = t in _NO_SPACE_BEFORE or last in _NO_SPACE_AFTER or (t in ("(", "[") and re.fullmatch(r"\w+|[)\]]", last) and last not in _keywords("go"))
            out += ("" if tight else " ") + t
        if t == "{":
            indent += 1
        if t in ("{", ";") or (t == "}"):
            out += "\n"
        last = t
    return out.strip()


def detokenized(df: DataFrame, tokens: str, name: str = "text") -> DataFrame:
    """df with detokenize() of each array of tokens, null for null."""
    ready(df.sparkSession)

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else detokenize(list(t)) for t in rows], dtype=object)

    return df.withColumn(name, run(tokens))


# --- statements ------------------------------------------------------------------------------------------------------
#: Tokens behind which a line goes on.
CONTINUES = tuple("( [ { , ; : . + - * / % & | ^ = == != < > <= >= && || ! := += -= *= /= <- -> =>".split())


def clamped_depth(tokens: DataFrame, key: str, pos: str, opening: Sequence[str], closing: Sequence[str], name: str) -> DataFrame:
    """Bracket depth behind each token, never below zero: a running sum less its running minimum."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("value").isin(*opening), 1).when(F.col("value").isin(*closing), -1).otherwise(0)
    rows = tokens.withColumn("__s", F.sum(step).over(w))
    return rows.withColumn(name, F.col("__s") - F.least(F.lit(0), F.min("__s").over(w))).drop("__s")


def insert_terminators(tokens: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Newlines become ; where a statement ends: outside ( and [, and not behind a token that goes on. Comments go.

    Of several newlines in a row the first one counts. Places keep their order, not their numbers.
    """
    rows = tokens.where("kind <> 'comment'")
    rows = clamped_depth(rows, key, pos, ("(",), (")",), "__round")
    rows = clamped_depth(rows, key, pos, ("[",), ("]",), "__square")
    w = Window.partitionBy(key).orderBy(pos)
    before = F.lag("value").over(w)
    ends = (F.col("__round") == 0) & (F.col("__square") == 0) & before.isNotNull() & (before != "\n") & ~before.isin(*CONTINUES)
    rows = rows.withColumn("__ends", ends)
    rows = rows.where((F.col("kind") != "newline") | F.col("__ends"))
    line = F.col("kind") == "newline"
    return rows.withColumn("value", F.when(line, ";").otherwise(F.col("value"))).withColumn("kind", F.when(line, "mark").otherwise(F.col("kind"))).drop("__round", "__square", "__ends")


def segment(tokens: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """tokens with chunk (from 0 per key): cut at ; and newlines at depth zero and behind a closing } there.

    No cut before else or catch, nor at the ; of a for clause. Newlines and cutting ; at depth zero belong to no chunk and go.
    """
    rows = tokens.where("kind <> 'comment'")
    rows = clamped_depth(rows, key, pos, ("(", "[", "{"), (")", "]", "}"), "__depth")
    w = Window.partitionBy(key).orderBy(pos)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    following = F.first(F.when(F.col("kind") != "newline", F.col("value")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("__next", following)
    # a for clause lasts from its keyword at depth zero to the brace that opens its body
    opens = F.when((F.col("value") == "for") & (F.col("kind") == "keyword") & (F.col("__depth") == 0), F.col(pos))
    body = F.when((F.col("value") == "{") & (F.col("__depth") == 1), F.col(pos))
    head = F.coalesce(F.max(opens).over(run), F.lit(-1)) > F.coalesce(F.max(body).over(run), F.lit(-1))
    rows = rows.withColumn("__head", head)
    flat = F.col("__depth") == 0
    joins = F.coalesce(F.col("__next").isin("else", "catch"), F.lit(False))
    line = flat & ~F.col("__head") & ((F.col("value") == ";") | ((F.col("kind") == "newline") & ~joins))
    behind = flat & (F.col("value") == "}") & ~joins
    rows = rows.withColumn("__out", line | (flat & (F.col("kind") == "newline"))).withColumn("__cut", F.when(line | behind, 1).otherwise(0))
    rows = rows.withColumn("__no", F.coalesce(F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("not __out")
    return rows.withColumn("chunk", F.dense_rank().over(Window.partitionBy(key).orderBy("__no")) - 1).drop("__depth", "__next", "__head", "__out", "__cut", "__no")


def chunk_arrays(tokens: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """key, chunk, tokens: each chunk's values in order."""
    return tokens.where("kind <> 'newline'").groupBy(key, "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, "value"))), lambda s: s["value"]).alias("tokens"))


def unfold(tokens: Sequence[str], owner: str | None = None) -> list[tuple[str | None, str, list[str]]]:
    """(owner, part, tokens): a function as header, statements and footer; its blocks in turn, owned by the function."""
    if "{" not in tokens:
        return [(owner, "statement", list(tokens))]
    at = tokens.index("{")
    depth, end = 0, len(tokens) - 1
    for i in range(at, len(tokens)):
        depth += (tokens[i] == "{") - (tokens[i] == "}")
        if depth == 0:
            end = i
            break
    own = tokens[tokens.index("func") + 1] if "func" in tokens[:at] and tokens.index("func") + 1 < at else owner
    out: list[tuple[str | None, str, list[str]]] = [(own, "header", list(tokens[: at + 1]))]
    depth, now = 0, []
    for t in tokens[at + 1 : end]:
        depth += (t in "{(["[:3] and t in ("{", "(", "[")) - (t in ("}", ")", "]"))
        if depth == 0 and t in (";", "\n"):
            if now:
                out += unfold(now, own)
            now = []
        else:
            now.append(t)
            if depth == 0 and t == "}":
                out += unfold(now, own)
                now = []
    if now:
        out += unfold(now, own)
    out.append((own, "footer", list(tokens[end : end + 1])))
    return out + (unfold(tokens[end + 1 :], owner) if tokens[end + 1 :] else [])


def unfold_table(chunks: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """key, chunk, part_no, owner, part, tokens."""
    ready(chunks.sparkSession)

    @F.pandas_udf("array<struct<owner:string,part:string,tokens:array<string>>>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([[{"owner": o, "part": p, "tokens": t} for o, p, t in unfold(list(r))] for r in rows])

    return chunks.withColumn("__p", run(tokens)).select(key, "chunk", F.posexplode("__p").alias("part_no", "__q")).select(key, "chunk", "part_no", "__q.*")


# --- placeholders ----------------------------------------------------------------------------------------------------
#: String bodies that join other texts and stay as they are. Results depend on them.
GLUE = ("", " ", "\\n", "\\t", ", ", ": ", " = ", "=", " - ", " + ")


def placeholder_kind(token: Column, keep: Sequence[str] = ()) -> Column:
    """ID, NUM, STR, CHR, or null for what stays: marks, keywords, _, 0, 1 and -1, glue, formats and interpolated strings."""
    inside = lambda mark: (F.char_length(token) > 1) & F.startswith(token, F.lit(mark)) & F.endswith(token, F.lit(mark))
    quoted = inside('"')
    body = F.substring(token, F.lit(2), F.greatest(F.char_length(token) - 2, F.lit(0)))
    stays = quoted & (body.isin(*GLUE) | F.contains(body, F.lit("%")) | F.contains(body, F.lit("${")))
    return (
        F.when(token.isin("_", "0", "1", "-1", *keep), F.lit(None).cast("string"))
        .when(token.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), "ID")
        .when(stays, F.lit(None).cast("string"))
        .when(quoted | inside("`"), "STR")
        .when(inside("'"), "CHR")
        .when(token.rlike(r"^-?\d+$|^-?\d*\.\d+([eE][+-]?\d+)?$"), "NUM")
    )


def anonymize(tokens: DataFrame, keys: Sequence[str], pos: str, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """tokens with placeholder: its kind and the place of its first appearance among the kind's values in the chunk; others as they are.

    For a pair of texts, let pos place all of the source before all of the target, and both share one map.
    """
    # all of a chunk's tokens go to one task once; both windows below need no other shuffle
    rows = tokens.withColumn("__kind", placeholder_kind(F.col(value), keep)).repartition(*keys)
    rows = rows.withColumn("__first", F.min(pos).over(Window.partitionBy(*keys, "__kind", value)))
    rank = F.dense_rank().over(Window.partitionBy(*keys, "__kind").orderBy("__first")) - 1
    return rows.withColumn("placeholder", F.when(F.col("__kind").isNull(), F.col(value)).otherwise(F.concat("__kind", rank.cast("string")))).drop("__kind", "__first")


def placeholder_map(anonymized: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """keys, placeholder, original."""
    return anonymized.where(F.col("placeholder") != F.col(value)).select(*keys, "placeholder", F.col(value).alias("original")).distinct()


def deanonymize(tokens: DataFrame, mapping: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tokens (with placeholder) with restored: what the map says, else the placeholder itself."""
    return tokens.join(mapping, [*keys, "placeholder"], "left").withColumn("restored", F.coalesce("original", "placeholder")).drop("original")


def restore_text(tokens: Column, mapping: Column) -> Column:
    """An array of tokens with a map's placeholders put back, also inside ${...}."""
    inner = lambda t: F.reduce(F.map_entries(mapping), t, lambda a, e: F.replace(a, F.concat(F.lit("${"), e["key"], F.lit("}")), F.concat(F.lit("${"), e["value"], F.lit("}"))))
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(mapping, t), F.when(F.contains(t, F.lit("${")), inner(t)).otherwise(t)))


def normalize_chunk(tokens: Column) -> Column:
    """Without ; behind or before }, and without ; at both ends."""
    n = F.size(tokens)
    kept = F.filter(tokens, lambda t, i: ~((t == ";") & (F.coalesce(F.get(tokens, i - 1) == "}", F.lit(True)) | F.coalesce(F.get(tokens, i + 1) == "}", F.lit(True)))))
    solid = F.transform(kept, lambda t: t != ";")
    first = F.array_position(solid, True)
    last = F.array_position(F.reverse(solid), True)
    return F.when((n == 0) | (first == 0), F.slice(tokens, 1, 0)).otherwise(F.slice(kept, first.cast("int"), (F.size(kept) - last + 1 - first + 1).cast("int")))


# --- vocabularies ----------------------------------------------------------------------------------------------------
SPECIALS = ("<pad>", "<bos>", "<eos>", "<unk>")


def token_counts(df: DataFrame, tokens: Column) -> DataFrame:
    """token, cnt; counted before the shuffle."""
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("cnt"))


def top_tokens(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent, ties by token."""
    return counts.orderBy(F.col("cnt").desc(), "token").limit(k)


def vocabulary(counts: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """id, token, cnt: specials first, then tokens by falling count and by name.

    Ids need a global order; with `most` only that many tokens are ordered, as a distributed top-k.
    """
    from .ordered import with_ordinal

    spark = counts.sparkSession
    kept = counts.where(F.col("cnt") >= least)
    if most is not None:
        kept = top_tokens(kept, most)
    placed = with_ordinal(kept, [F.col("cnt").desc(), F.col("token").asc()], "id").select((F.col("id") + len(SPECIALS)).cast("long").alias("id"), "token", F.col("cnt").cast("long").alias("cnt"))
    special = spark.createDataFrame([(i, t, 0) for i, t in enumerate(SPECIALS)], "id long, token string, cnt long")
    return special.unionByName(placed)


def encode(tokens: DataFrame, vocab: DataFrame, token: str = "token") -> DataFrame:
    """tokens with id; unknown ones get that of <unk>."""
    return tokens.join(vocab.select(F.col("token").alias(token), "id"), token, "left").withColumn("id", F.coalesce("id", F.lit(SPECIALS.index("<unk>")).cast("long")))


def decode(ids: Column, words: Column) -> Column:
    """Tokens of an array of ids by an array of words: <bos> and <pad> are skipped, <eos> ends it."""
    end = F.array_position(F.transform(ids, lambda i: i == SPECIALS.index("<eos>")), True)
    upto = F.when(end > 0, F.slice(ids, 1, F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(ids)
    return F.transform(F.filter(upto, lambda i: ~i.isin(SPECIALS.index("<pad>"), SPECIALS.index("<bos>"))), lambda i: F.get(words, i.cast("int")))


def pad(ids: Column, width: int, value: int = 0) -> Column:
    """Cut or filled on the right to width."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(value).cast("long"), width)), 1, width)


def predict(df: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]], source: str, name: str = "predicted", batch: int = 64) -> DataFrame:
    """A model over a column of texts: loaded once for each task, asked in batches; the caller brings the model."""
    ready(df.sparkSession)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            yield pd.Series([x for at in range(0, len(part), batch) for x in model(part.iloc[at : at + batch].tolist())], dtype=object)

    return df.withColumn(name, run(source))


# --- augmentation and made-up data -----------------------------------------------------------------------------------
def renumber(texts: Sequence[str], seed: int, most: int = 16) -> list[str]:
    """Placeholder numbers drawn anew from 0 to most - 1, each kind by itself, the same way in all texts."""
    rng = random.Random(seed)
    own: dict[str, dict[str, str]] = {}
    for kind, number in dict.fromkeys(m for t in texts for m in re.findall(r"\b(ID|NUM|STR|CHR)(\d+)\b", t)):
        own.setdefault(kind, {})[number] = ""
    for kind, numbers in own.items():
        numbers.update(zip(numbers, map(str, rng.sample(range(max(most, len(numbers))), len(numbers)))))
    return [re.sub(r"\b(ID|NUM|STR|CHR)(\d+)\b", lambda m: m[1] + own[m[1]][m[2]], t) for t in texts]


def rename(texts: Sequence[str], seed: int, protected: frozenset[str] = frozenset()) -> list[str]:
    """Names that all texts share, outside strings and not protected, replaced by new ones, the same way everywhere."""
    rng = random.Random(seed)
    scans = [scan(t) for t in texts]
    shared = set.intersection(*({v for k, v, _, _ in s if k == "name"} for s in scans)) - protected if scans else set()
    taken = {v for s in scans for _, v, _, _ in s}
    own = {}
    for old in sorted(shared):
        while (new := rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(1000))) in taken:
            pass
        taken.add(new)
        own[old] = new
    cut = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])*'|[^\W\d]\w*")
    return [cut.sub(lambda m: own.get(m[0], m[0]), t) for t in texts]


def augment(pairs: DataFrame, source: str, target: str, factor: int, how: Callable[[Sequence[str], int], list[str]], seed: int = 0) -> DataFrame:
    """`factor` variants of each pair, with variant from 0; seeded by the pair's own text, so a rerun gives the same."""
    ready(pairs.sparkSession)

    @F.pandas_udf(f"struct<{source}:string,{target}:string>")
    def run(a: pd.Series, b: pd.Series, s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([how([x, y], int(z)) for x, y, z in zip(a, b, s)], columns=[source, target])

    rows = pairs.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))) if factor > 0 else pairs.where(F.lit(False)).withColumn("variant", F.lit(0))
    rows = rows.withColumn("__s", F.xxhash64(source, target, "variant", F.lit(seed)))
    return rows.withColumn("__new", run(source, target, "__s")).withColumn(source, F.col("__new")[source]).withColumn(target, F.col("__new")[target]).drop("__s", "__new")


#: (weight, source, target) with {a} {b} for names, {n} {m} for numbers and {{ }} for braces; a form for each kind of statement.
MADE = (
    (2, "var {a} int = {n}", "var {a}: Int64 = {n}"), (1, "var {a} string", 'var {a}: String = ""'), (3, "{a} := {n}", "var {a} = {n}"), (2, "{a} := {b} * {m}", "var {a} = {b} * {m}"),
    (1, "const {a} = {n}", "let {a} = {n}"), (2, "{a} = {b} + {n}", "{a} = {b} + {n}"), (1, "{a} -= {n}", "{a} -= {n}"), (1, "{a}++", "{a} += 1"), (1, "{a}--", "{a} -= 1"),
    (2, "fmt.Println({a})", "println({a})"), (1, "fmt.Print({a})", "print({a})"), (1, 'fmt.Printf("value=%d\\n", {a})', 'print("value=${{{a}}}\\n")'),
    (1, "if {a} > {n} {{ {b} = {m} }}", "if ({a} > {n}) {{ {b} = {m} }}"), (1, "if {a} == {n} {{ {b} = {m} }} else {{ {b} = {n} }}", "if ({a} == {n}) {{ {b} = {m} }} else {{ {b} = {n} }}"),
    (1, "if {a} < {n} {{ {b} = {n} }} else if {a} < {m} {{ {b} = {m} }} else {{ {b} = 0 }}", "if ({a} < {n}) {{ {b} = {n} }} else if ({a} < {m}) {{ {b} = {m} }} else {{ {b} = 0 }}"),
    (1, "for {a} := 0; {a} < {n}; {a}++ {{ {b} += {a} }}", "for ({a} in 0..{n}) {{ {b} += {a} }}"), (1, "for {a} < {n} {{ {a} += {m} }}", "while ({a} < {n}) {{ {a} += {m} }}"), (1, "for {{ {a}++ }}", "while (true) {{ {a} += 1 }}"),
    (1, "for _, {a} := range {b} {{ fmt.Println({a}) }}", "for ({a} in {b}) {{ println({a}) }}"), (1, "for {a}, v := range {b} {{ fmt.Println({a}, v) }}", "for ({a} in 0..{b}.size) {{ let v = {b}[{a}]; println(\"${{{a}}} ${{v}}\") }}"),
    (1, "func {a}({b} int) int {{ return {b} + {n} }}", "func {a}({b}: Int64): Int64 {{ return {b} + {n} }}"), (1, "func {a}({b} int) (int, int) {{ return {b}, {n} }}", "func {a}({b}: Int64): (Int64, Int64) {{ return ({b}, {n}) }}"),
    (1, "return {a}, {b}", "return ({a}, {b})"), (2, "return {a}", "return {a}"), (1, "break", "break"), (1, "continue", "continue"), (1, "{a} := len({b})", "var {a} = {b}.size"), (1, "{a} = append({a}, {n})", "{a}.add({n})"),
    (1, "{a} := []int{{{n}, {m}}}", "var {a} = ArrayList<Int64>([{n}, {m}])"), (1, "{a} := make(map[string]int)", "var {a} = HashMap<String, Int64>()"), (1, "{a} == nil", "{a}.isNone()"), (1, '{a} := {b} + "s"', 'var {a} = {b} + "s"'), (1, "{a} := {b}({n}, {m})", "var {a} = {b}({n}, {m})"),
    (1, "{a} := {b}.Get({n})", "var {a} = {b}.get({n})"), (1, "type {a} struct {{ {b} int }}", "class {a} {{ var {b}: Int64 = 0 }}"), (1, "type {a} interface {{ {b}() int }}", "interface {a} {{ func {b}(): Int64 }}"),
    (1, "switch {a} {{ case {n}: {b} = {m} }}", "match ({a}) {{ case {n} => {b} = {m} case _ => () }}"), (1, "package {a}", "package {a}"), (1, 'import "{a}"', "import std.{a}.*"), (1, "func main() {{ {a}() }}", "main() {{ {a}() }}"), (1, "{a}({b})", "{a}({b})"),
)


def made_up_pairs(spark, n: int, seed: int = 0, templates: Sequence[tuple[int, str, str]] = MADE) -> DataFrame:
    """i, source, target: weighted templates filled with seeded names and numbers; row i depends on the seed and i alone."""
    total = sum(w for w, _, _ in templates)
    rows = spark.range(n).withColumnRenamed("id", "i")
    draw = lambda salt, m: F.pmod(F.xxhash64("i", F.lit(seed), F.lit(salt)), F.lit(m))
    pick, source, target, upto = draw("t", total), None, None, 0
    for w, s, t in templates:
        upto += w
        source = F.when(pick < upto, s) if source is None else source.when(pick < upto, s)
        target = F.when(pick < upto, t) if target is None else target.when(pick < upto, t)
    a, b = F.concat(F.lit("x"), draw("a", 50).cast("string")), F.concat(F.lit("y"), draw("b", 50).cast("string"))
    for mark, value in (("{a}", a), ("{b}", b), ("{n}", draw("n", 100).cast("string")), ("{m}", draw("m", 100).cast("string")), ("{{", F.lit("{")), ("}}", F.lit("}"))):
        source, target = F.replace(source, F.lit(mark), value), F.replace(target, F.lit(mark), value)
    return rows.select("i", source.alias("source"), target.alias("target"))


def union(**sources: DataFrame) -> DataFrame:
    """Rows of all sources, by column names, with the source's name in `origin`; repeated rows stay."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("origin", F.lit(name)) for name, df in sources.items()])


# --- splits and scores -----------------------------------------------------------------------------------------------
def canonical(*texts: Column) -> Column:
    """What variants of a pair have in common: its texts with every placeholder number and run of white space made equal."""
    one = lambda t: F.regexp_replace(F.regexp_replace(F.trim(t), r"\b(ID|NUM|STR|CHR)\d+\b", "$1"), r"\s+", " ")
    return F.concat_ws("\u0001", *map(one, texts))


def split_pairs(pairs: DataFrame, source: str, target: str, share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(train, held out) by the hash of the canonical pair: variants stay on one side."""
    from .joins import hash_split

    flagged = hash_split(pairs, canonical(F.col(source), F.col(target)), share, "__held")
    return flagged.where("not __held").drop("__held"), flagged.where("__held").drop("__held")


def without_leaks(train: DataFrame, held: DataFrame, source: str, target: str) -> DataFrame:
    """train without pairs whose canonical form is held out."""
    mark = lambda df: df.withColumn("__c", F.sha2(canonical(F.col(source), F.col(target)), 256))
    return mark(train).join(mark(held).select("__c"), "__c", "left_anti").drop("__c")


def token_accuracy(predicted: Column, reference: Column) -> Column:
    """Struct of hits and places: equal tokens place by place, over the longer one's length."""
    hits = F.size(F.filter(F.zip_with(predicted, reference, lambda a, b: a.eqNullSafe(b)), lambda x: x))
    return F.struct(hits.alias("hits"), F.greatest(F.size(predicted), F.size(reference)).alias("places"))


def accuracy(df: DataFrame, predicted: str, reference: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, n_right, accuracy of a predicted column; rows where either is null count as wrong."""
    right = F.coalesce(F.col(predicted) == F.col(reference), F.lit(False))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(right).alias("n_right"), F.avg(right.cast("int")).alias("accuracy"))


def case_score(coverage: Column, compiles: Column, matches: Column) -> Column:
    """0.4 of the coverage, 0.4 for compiling and 0.2 for the right output."""
    return coverage * 0.4 + F.when(compiles, 0.4).otherwise(0.0) + F.when(matches, 0.2).otherwise(0.0)


def run_summary(cases: DataFrame) -> DataFrame:
    """Totals over case results (name, chunks, confident, compiled, matched): counts, coverage, mean score and how many fail."""
    share = F.when(F.col("chunks") > 0, F.col("confident") / F.col("chunks")).otherwise(0.0)
    return cases.agg(
        F.count("*").alias("cases"), F.count_if("compiled").alias("compiled"), F.count_if("matched").alias("matched"), F.sum("chunks").alias("chunks"), F.sum("confident").alias("confident"),
        (F.sum("confident") / F.nullif(F.sum("chunks"), F.lit(0))).alias("coverage"), F.avg(case_score(share, F.col("compiled"), F.col("matched"))).alias("score"), F.count_if(_fails()).alias("n_failing"),
    )


def _fails() -> Column:
    return ~(F.coalesce("compiled", F.lit(False)) & F.coalesce("matched", F.lit(False)))


def failing_cases(cases: DataFrame) -> DataFrame:
    """The cases that don't compile or don't match, a row each."""
    return cases.where(_fails())


# --- declarations ----------------------------------------------------------------------------------------------------
def synthesize_init(classes: DataFrame, fields: DataFrame) -> DataFrame:
    """classes (doc, cls, has_init) with init: a constructor from its fields (doc, cls, i, name, type), null where there is one."""
    ordered = F.array_sort(F.collect_list(F.struct("i", "name", "type")))
    own = fields.groupBy("doc", "cls").agg(ordered.alias("__f"))
    params = F.array_join(F.transform("__f", lambda f: F.concat(f["name"], F.lit(": "), f["type"])), ", ")
    body = F.array_join(F.transform("__f", lambda f: F.concat(F.lit("this."), f["name"], F.lit(" = "), f["name"])), "; ")
    init = F.concat(F.lit("init("), params, F.lit(") { "), body, F.lit(" }"))
    return classes.join(own, ["doc", "cls"], "left").withColumn("init", F.when(~F.col("has_init"), F.coalesce(init, F.lit("init() { }")))).drop("__f")


def promote_methods(classes: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes with methods (array in order of i), methods whose receiver is no class of the document).

    classes: doc, cls; methods: doc, receiver, i, body.
    """
    own = methods.groupBy("doc", F.col("receiver").alias("cls")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "body"))), lambda m: m["body"]).alias("methods"))
    left = methods.join(classes.select("doc", F.col("cls").alias("receiver")), ["doc", "receiver"], "left_anti")
    return classes.join(own, ["doc", "cls"], "left").withColumn("methods", F.coalesce("methods", F.array().cast("array<string>"))), left


def splice(parts: DataFrame, key: str) -> DataFrame:
    """key, text: each function's header, body statements and footer in order, bodies without a function at the end.

    parts: key, owner, part (header, statement or footer), i, text.
    """
    rank = F.when(F.col("part") == "header", 0).when(F.col("part") == "footer", 2).otherwise(1)
    functions = parts.where("part = 'header'").groupBy(key, "owner").agg(F.min("i").alias("__at"))
    body = parts.withColumn("__rank", rank).groupBy(key, "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rank", "i", "text"))), lambda s: s["text"]), "\n").alias("__text"), F.min("i").alias("__i"))
    placed = body.join(functions, [key, "owner"], "left").withColumn("__orphan", F.col("__at").isNull().cast("int"))
    return placed.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__orphan", F.coalesce("__at", "__i").alias("at"), "__text"))), lambda s: s["__text"]), "\n").alias("text"))


# --- rewriting and matching ------------------------------------------------------------------------------------------
#: Forms that a stored template tends to get wrong: they are left to the rewriter. Where a chunk goes depends on them. The list is a part of what the survey names.
FRAGILE = (
    r"\bgo\s+func\b", r"\bselect\s*\{", r"\bdefer\b", r"<-",
    r"\w+(\s*\[[^\[\]]+\])?\s*,\s*\w+(\s*\[[^\[\]]+\])?\s*=\s*\w+(\s*\[[^\[\]]+\])?\s*,\s*\w+",  # swaps
    r"\bfor\s+\w+\s*(,\s*\w+\s*)?:=\s*range\b", r"\bmake\s*\(\s*\[\s*\]", r"\[\s*\]\s*(\[\s*\]\s*)?[A-Za-z_]\w*\s*\{",  # ranges, made and literal slices
    r"\w+\s*\[[^\[\]]+\]\s*\[[^\[\]]+\]", r"\w+\s*\[[^\[\]]+\]\s*=([^=]|$)",  # two subscripts, writes to a place
    r"^\s*var\s+\w+\s*=\s*-?\d+(\.\d+)?\s*$", r"\bfor\s+\w+\s*:=[^;]+;[^;{]+;[^{]*(\+\+|--|\+=|-=)", r"\}\s*else\s*\{",  # untyped numbers, counted loops, both branches
    r"\bfmt\s*\.\s*Print(ln|f)?\s*\(\s*[^,)]+,", r"\bfmt\s*\.\s*Printf\s*\(", r"\b\w+\s*\(\s*[^,()]+\s*,\s*[^,()]+\s*,\s*[^,()]+",  # prints and calls of several values
    r"\b(\w+)\s*=\s*\1\b\s*[+\-*/%]",  # updates of a name by itself
)


def route(text: Column, fragile: Sequence[str] = FRAGILE) -> Column:
    """fallback, identity or template for a chunk's text: headers, empty chunks and fragile forms can't be left to templates."""
    out = F.when(F.trim(text) == "", "fallback").when(F.trim(text) == "}", "identity").when(text.rlike(r"^\s*(func|type|class|struct|interface)\b[^}]*\{\s*$"), "fallback")
    for pattern in fragile:
        out = out.when(text.rlike(pattern), "fallback")
    return out.otherwise("template")


#: (pattern, replacement) in order; $1 refers to groups.
IDIOMS = (
    (r"\bfmt\.Println\(", "println("), (r"\bmake\(\[\]int\s*,\s*([^)]+)\)", "Array<Int64>($1, repeat: 0)"), (r"\[\]int\{([^}]*)\}", "[$1]"), (r"\bfor\s+_,\s*(\w+)\s*:=\s*range\s+(\w+)\s*\{", "for ($1 in $2) {"),
    (r"\bfor\s+(\w+)\s*:=\s*(\w+)\s*;\s*\1\s*<\s*([\w.]+)\s*;\s*\1\+\+\s*\{", "for ($1 in $2..$3) {"), (r"(\w+)\s*,\s*(\w+)\s*=\s*\2\s*,\s*\1\b", "($1, $2) = ($2, $1)"), (r"(\w+)\s*=\s*append\(\1\s*,\s*([^)]+)\)", "$1.add($2)"),
    (r"\blen\((\w+)\)", "$1.size"), (r"(\w+)\s*:=\s*", "var $1 = "), (r"(\w+)\+\+", "$1 += 1"), (r"(\w+)--", "$1 -= 1"),
)


def rewrite(text: Column, rules: Sequence[tuple[str, str]] = IDIOMS) -> Column:
    """Ordered regular-expression rewrites, in SQL functions only."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


_LITERALS = re.compile(r"/\*[\s\S]*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])*'")


def rewrite_outside_literals(text: str, rules: Sequence[tuple[str, str]]) -> str:
    """The same, with strings and comments out of reach: they are masked, and put back afterwards."""
    held: list[str] = []

    def mask(m: re.Match) -> str:
        held.append(m[0])
        return f"\ue000{len(held) - 1}\ue001"

    text = _LITERALS.sub(mask, text)
    for pattern, replacement in rules:
        text = re.sub(pattern, re.sub(r"\$(\d)", r"\\g<\1>", replacement), text)
    return re.sub("\ue000(\\d+)\ue001", lambda m: held[int(m[1])], text)


def rewrite_safe(df: DataFrame, text: str, rules: Sequence[tuple[str, str]] = IDIOMS, name: str = "rewritten") -> DataFrame:
    ready(df.sparkSession)

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else rewrite_outside_literals(t, rules) for t in rows], dtype=object)

    return df.withColumn(name, run(text))


@dataclass(frozen=True)
class Pattern:
    """Anchors and slots ($name): `for $i in $xs { $body }`."""

    no: int
    tokens: tuple[str, ...]

    @property
    def anchors(self) -> int:
        return sum(not t.startswith("$") for t in self.tokens)


def bind_slots(tokens: Sequence[str], pattern: Sequence[str]) -> dict[str, str] | None:
    """What each slot takes, or None. Anchors have to be there; a slot takes at least one token, balanced in brackets,
    up to the next anchor; a slot that comes twice takes the same; all tokens are used up."""
    pairs = {")": "(", "]": "[", "}": "{"}

    def match(i: int, k: int, bound: dict[str, str]) -> dict[str, str] | None:
        if k == len(pattern):
            return bound if i == len(tokens) else None
        want = pattern[k]
        if not want.startswith("$"):
            return match(i + 1, k + 1, bound) if i < len(tokens) and tokens[i] == want else None
        following = pattern[k + 1] if k + 1 < len(pattern) and not pattern[k + 1].startswith("$") else None
        open_: list[str] = []
        for j in range(i, len(tokens)):
            t = tokens[j]
            if t in pairs.values():
                open_.append(t)
            elif t in pairs:
                if not open_ or open_.pop() != pairs[t]:
                    return None
            if open_:
                continue
            if following is not None and (j + 1 >= len(tokens) or tokens[j + 1] != following):
                continue
            taken = " ".join(tokens[i : j + 1])
            if bound.get(want, taken) == taken and (out := match(j + 1, k + 1, {**bound, want: taken})) is not None:
                return out
        return None

    return match(0, 0, {})


#: A slot of this name takes a plain name: none of these may open what it binds. Fixed values.
NAME_SLOT, NOT_NAMES = "$NAME", frozenset(
    "for while if else do switch case default return throw try catch finally break continue new typeof let const var function class interface enum struct type abstract import export".split()
)


def best_patterns(chunks: DataFrame, keys: Sequence[str], tokens: str, patterns: Sequence[Pattern], embedded: bool = False, near: Callable[[list[str]], set[int]] | None = None) -> DataFrame:
    """keys, pattern_no, score, slots: of the patterns that fit a chunk that with the largest score, the first of equals.

    The score is one more than the number of anchors; with `embedded` a tenth of the cosine of both token sequences' embeddings
    comes on top, and with `near` (tokens to numbers of patterns, such as a map's neighbourhood) a tenth for a pattern in it.
    A slot NAME_SLOT doesn't take what begins with one of NOT_NAMES. Patterns are a fixed table that travels with the function,
    indexed by first anchor; null where none fits.
    """
    from .vectors import sequence_vector

    ready(chunks.sparkSession)
    by_first: dict[str, list[Pattern]] = {}
    for p in patterns:
        by_first.setdefault(p.tokens[0] if p.tokens and not p.tokens[0].startswith("$") else "", []).append(p)
    vectors = {p.no: sequence_vector(list(p.tokens)) for p in patterns} if embedded else {}

    @F.pandas_udf("struct<pattern_no:int,score:double,slots:map<string,string>>")
    def run(rows: pd.Series) -> pd.DataFrame:
        out = []
        for row in rows:
            own = list(row) if row is not None else []
            vector = sequence_vector(own) if embedded else None
            close = near(own) if near else ()
            best = (None, None, None)
            for p in sorted([*by_first.get(own[0] if own else "", []), *(by_first.get("", []) if own else [])], key=lambda p: p.no):
                slots = bind_slots(own, p.tokens)
                if slots is None or slots.get(NAME_SLOT, "").partition(" ")[0] in NOT_NAMES:
                    continue
                score = 1.0 + p.anchors + (0.1 * float(vector @ vectors[p.no]) if embedded else 0.0) + 0.1 * (p.no in close)
                if best[1] is None or score > best[1]:
                    best = (p.no, score, slots)
            out.append(best)
        return pd.DataFrame(out, columns=["pattern_no", "score", "slots"]).astype({"pattern_no": "Int32"})

    return chunks.withColumn("__b", run(tokens)).select(*keys, "__b.pattern_no", "__b.score", "__b.slots")


# --- projects --------------------------------------------------------------------------------------------------------
def merge_projects(files: DataFrame, project: str = "project", path: str = "path", source: str = "source") -> DataFrame:
    """project, imports, body: files in order of path, those with a main function last, as one text; imports once, sorted.

    A project's files meet in one row, as one program must.
    """
    has_main = F.col(source).rlike(r"(?m)^\s*(fun|func)\s+main\s*\(").cast("int")
    lines = F.split(F.col(source), "\n")
    is_import = lambda line: line.rlike(r"^\s*import\s")
    rows = files.select(project, F.col(path).alias("__p"), has_main.alias("__m"), F.transform(F.filter(lines, is_import), lambda line: F.trim(line)).alias("__i"), F.array_join(F.filter(lines, lambda line: ~is_import(line)), "\n").alias("__b"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__m", "__p", "__b"))), lambda s: s["__b"]), "\n")
    return rows.groupBy(project).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__i")))).alias("imports"), body.alias("body"))


def map_imports(imports: DataFrame, table: DataFrame, name: str = "import", prefix: str = "prefix", ordinal: str = "i") -> DataFrame:
    """imports with the first entry of table whose prefix the name starts with."""
    from .joins import first_prefix

    return first_prefix(imports, name, table, prefix, ordinal)


# --- placeholder shapes ----------------------------------------------------------------------------------------------
def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b(?:ID|NUM|STR|CHR)\d+\b"), 0)


def shape(text: Column) -> Column:
    """The text with its k-th distinct placeholder written as #k: two texts can be aligned iff their shapes are equal."""
    own = F.array_distinct(placeholders(text))
    marked = F.regexp_replace(text, r"\b((?:ID|NUM|STR|CHR)\d+)\b", "\u0002$1\u0003")
    return F.reduce(F.transform(own, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), marked, lambda a, s: F.replace(a, F.concat(F.lit("\u0002"), s["p"], F.lit("\u0003")), F.concat(F.lit("#"), s["i"].cast("string"))))


def align(left: DataFrame, right: DataFrame, text: str) -> DataFrame:
    """Pairs of rows with equal shapes, with a map from the right's placeholders to the left's: an equality join."""
    a = left.withColumn("__shape", shape(F.col(text))).withColumn("__l", F.array_distinct(placeholders(F.col(text)))).withColumnRenamed(text, "left_text")
    b = right.withColumn("__shape", shape(F.col(text))).withColumn("__r", F.array_distinct(placeholders(F.col(text)))).withColumnRenamed(text, "right_text")
    return a.join(b, "__shape").withColumn("mapping", F.map_from_arrays("__r", "__l")).drop("__shape", "__l", "__r")
