"""The corpus operators as queries over the driver's tables, with SQL where that can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, digest, gif, packing, ppm, simhash, styletree, substring, urlfilter, warc

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op2_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.fixity_drill(_read(spark, sf_dir, "pages"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.judge(_read(spark, sf_dir, "documents"))


def op6_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.store_and_read(_read(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_read(spark, sf_dir, "pages"))


def op8_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styletree.extract(_read(spark, sf_dir, "pages"))


def op9_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.identify(_read(spark, sf_dir, "documents"))


def op10_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.compare_next(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pattern_packing, op2_simhash_trie, op3_warc_fixity, op4_byte_bpe, op5_substring_dedup, op6_gif_media, op7_url_filter, op8_site_style_tree, op9_ppm_language, op10_quartile_digest, pipeline,
    )
}


def _url_filter_sql() -> str:
    def listed(terms: tuple[str, ...]) -> str:
        return ", ".join(f"'{t}'" for t in terms)

    return f"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         -- runs of letters of the whole URL: a term counts where it is such a run
         regexp_split_to_array(coalesce(translate(regexp_replace(url, '%[0-9A-Fa-f]{{2}}', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\\p{{L}}]') AS words
  FROM pages
), counted AS (
  SELECT *,
         CASE WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
              WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
              WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
              WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
              WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule
  FROM parts
), scored AS (
  SELECT *, CAST(len(list_filter(words, lambda x: x IN ({listed(urlfilter.STRICT)}))) AS INTEGER) AS strict_hits,
         CAST(len(list_distinct(list_filter(words, lambda x: x IN ({listed(urlfilter.SOFT)})))) AS INTEGER) AS soft_hits
  FROM counted
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN strict_hits > 0 OR soft_hits >= {urlfilter.SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict,
       strict_hits, soft_hits
FROM scored
"""


SUBSTRING_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT row_id, unnest(range(1, len(w) - 33)) AS s FROM words WHERE len(w) >= 35
), windows AS (
  SELECT row_id, s, md5(array_to_string(w[s : s + 34], ' ')) AS h FROM starts JOIN words USING (row_id)
), repeated AS (
  SELECT row_id, s FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT DISTINCT row_id, s + k AS i FROM repeated, range(0, 35) AS t(k)
), left_over AS (
  SELECT row_id, i, word FROM (SELECT row_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words) AS x ANTI JOIN covered USING (row_id, i)
), kept AS (
  SELECT row_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM left_over GROUP BY row_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (row_id)
"""

#: Digests of each text and of its edited text, byte by byte; ids are taken to be unique, as an order among equal ones is the operator's own.
DIGEST_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r FROM documents
), pairs AS (
  SELECT d.*, CAST(length(d.t) AS BIGINT) AS n, length(d.t) // 4 AS k, coalesce(n.r, f.r) AS next_r, coalesce(n.t, f.t) AS after
  FROM d LEFT JOIN d AS n ON n.r = d.r + 1 LEFT JOIN d AS f ON f.r = 1
), texts AS (
  SELECT r, false AS edited, t FROM pairs UNION ALL SELECT r, true, left(t, n - k) || left(after, k) FROM pairs
), bytes AS (
  SELECT r, edited, CAST('0x' || unnest(l) AS BIGINT) AS b, unnest(range(len(l))) AS i FROM (SELECT r, edited, regexp_extract_all(hex(encode(t)), '..') AS l FROM texts)
), near AS (
  SELECT r, edited, b AS a, lead(b, 1) OVER w AS b, lead(b, 2) OVER w AS c, lead(b, 3) OVER w AS d, lead(b, 4) OVER w AS e FROM bytes WINDOW w AS (PARTITION BY r, edited ORDER BY i)
), triplets AS (
  SELECT r, edited, unnest([a * 65536 + b * 256 + c, a * 65536 + b * 256 + xor(d, 85), a * 65536 + c * 256 + xor(e, 170)]) AS x FROM near
), hashed AS (
  SELECT r, edited, CAST(x * 2654435761 % 4294967296 AS UBIGINT) AS h FROM triplets WHERE x IS NOT NULL
), counted AS (
  SELECT r, edited, (xor(h, h >> 15) * 2246822519::UBIGINT % 4294967296::UBIGINT) >> 24 AS bucket, count(*) AS n FROM hashed GROUP BY ALL
), counts AS (
  SELECT texts.r, texts.edited, list(coalesce(c.n, 0) ORDER BY g.b) AS c
  FROM texts CROSS JOIN range({digest.BUCKETS}) AS g(b) LEFT JOIN counted AS c ON c.r = texts.r AND c.edited = texts.edited AND c.bucket = g.b GROUP BY 1, 2
), codes AS (
  SELECT r, edited, list_transform(c, lambda x: CASE WHEN list_sum(c) = 0 THEN 0 ELSE CAST(x > q[65] AS INTEGER) + CAST(x > q[129] AS INTEGER) + CAST(x > q[193] AS INTEGER) END) AS codes FROM (SELECT *, list_sort(c) AS q FROM counts)
), prints AS (
  SELECT r, edited, codes, CAST(least(255, round(8 * log2(1 + octet_length(encode(t))))) AS INTEGER) AS size FROM codes JOIN texts USING (r, edited)
), named AS (
  SELECT *, format('{{:02x}}', size) || array_to_string(list_transform(range(0, {digest.BUCKETS}, 4), lambda j: format('{{:02x}}', codes[j + 1] + 4 * codes[j + 2] + 16 * codes[j + 3] + 64 * codes[j + 4])), '') AS print FROM prints
), three AS (
  SELECT p.r, p.doc_id, p.n, o.print AS a, e.print AS b, [o.codes, e.codes, x.codes] AS c, [o.size, e.size, x.size] AS s, x.print AS z
  FROM pairs p JOIN named o ON o.r = p.r AND NOT o.edited JOIN named e ON e.r = p.r AND e.edited JOIN named x ON x.r = p.next_r AND NOT x.edited
), apart AS (
  SELECT *, list_transform([2, 3], lambda j: CAST(list_sum(list_transform(list_zip(c[1], c[j]), lambda p: CASE abs(p[1] - p[2]) WHEN 3 THEN 6 ELSE abs(p[1] - p[2]) END)) + 4 * greatest(0, abs(s[1] - s[j]) - 1) AS BIGINT)) AS diff FROM three
)
SELECT doc_id, apart.n AS n_chars, sha256(texts.t) AS edited_sha256, a AS fingerprint, b AS edited_fingerprint,
       CASE WHEN a = b THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - diff[1] / {digest.MOST}::DOUBLE) END AS near_edited,
       CASE WHEN a = z THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - diff[2] / {digest.MOST}::DOUBLE) END AS near_next
FROM apart JOIN texts ON texts.r = apart.r AND texts.edited
"""



def _simhash_sql() -> str:
    """XXH64 step by step in 128-bit arithmetic, a vote for each bit, links between all distinct fingerprints, and their closure."""
    word = 1 << 64
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    seed = 42

    def cut(x: str) -> str:
        return f"(({x}) % {word}::UHUGEINT)"

    def turn(x: str, by: int) -> str:
        return f"(({x}) % {1 << (64 - by)}::UHUGEINT * {1 << by}::UHUGEINT + ({x}) // {1 << (64 - by)}::UHUGEINT)"

    def number(first: str, size: int) -> str:
        return f"CAST('0x' || array_to_string(list_reverse(b[{first} : {first} + {size - 1}]), '') AS UHUGEINT)"

    def lane(k: int) -> str:
        """The k-th of four sums over stripes of 32 bytes."""
        start = (seed + 11400714785074694791 + 14029467366897019727, seed + 14029467366897019727, seed, seed - 11400714785074694791)[k] % word
        numbers = f"list_transform(range(0, n // 32), lambda i: {number(f'(32 * i + {8 * k + 1})', 8)})"
        return f"list_reduce({numbers}, lambda a, x: {cut(turn(cut(f'a + x * {p2}'.replace('x * ' + p2, cut('x * ' + p2))), 31) + ' * ' + p1)}, {start}::UHUGEINT)"

    def merged(h: str, v: str) -> str:
        return cut(f"{cut(f'xor({h}, {v}) * {p1}')} + {p4}")

    rounds = ", ".join(f"{cut(turn(cut(f'v{k} * {p2}'), 31) + ' * ' + p1)} AS m{k}" for k in range(4))
    votes = " + ".join(f"CASE WHEN 2 * sum((h >> {i}) & 1) > count(*) THEN {1 << i}::UHUGEINT ELSE 0::UHUGEINT END" for i in range(64))
    return f"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT r, unnest(list_transform(range(1, greatest(2, len(w) - 1)), lambda i: array_to_string(w[i : i + 2], ' '))) AS s FROM words WHERE len(w) > 0
), bytes AS MATERIALIZED (
  SELECT s, regexp_extract_all(hex(encode(s)), '..') AS b, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s FROM shingles)
), lanes AS (
  SELECT s, b, n, {", ".join(f"CASE WHEN n >= 32 THEN {lane(k)} END AS v{k}" for k in range(4))} FROM bytes
), turned AS (
  SELECT *, {rounds}, {cut(f"{turn('v0', 1)} + {turn('v1', 7)} + {turn('v2', 12)} + {turn('v3', 18)}")} AS h FROM lanes
), m0 AS (SELECT * REPLACE ({merged("h", "m0")} AS h) FROM turned
), m1 AS (SELECT * REPLACE ({merged("h", "m1")} AS h) FROM m0
), m2 AS (SELECT * REPLACE ({merged("h", "m2")} AS h) FROM m1
), m3 AS (SELECT * REPLACE ({merged("h", "m3")} AS h) FROM m2
), begun AS (
  SELECT s, b, n, {cut(f"coalesce(h, {seed}::UHUGEINT + {p5}) + CAST(n AS UHUGEINT)")} AS h, n // 32 * 32 AS pos FROM m3
), eights AS (
  SELECT s, b, n, pos + (n - pos) // 8 * 8 AS pos, list_reduce(list_transform(range(0, (n - pos) // 8), lambda i: {cut(turn(cut(number('(pos + 8 * i + 1)', 8) + ' * ' + p2), 31) + ' * ' + p1)}), lambda a, x: {cut(cut(turn('xor(a, x)', 27) + ' * ' + p1) + ' + ' + p4)}, h) AS h FROM begun
), fours AS (
  SELECT s, b, n, CASE WHEN n - pos >= 4 THEN pos + 4 ELSE pos END AS pos, CASE WHEN n - pos >= 4 THEN xor(h, {cut(number('(pos + 1)', 4) + ' * ' + p1)}) END AS x, h FROM eights
), ones AS (
  SELECT s, b, n, pos, CASE WHEN x IS NULL THEN h ELSE {cut(cut(turn('x', 23) + ' * ' + p2) + ' + ' + p3)} END AS h FROM fours
), tails AS (
  SELECT s, list_reduce(list_transform(range(0, n - pos), lambda i: {cut(number('(pos + i + 1)', 1) + ' * ' + p5)}), lambda a, x: {cut(turn('xor(a, x)', 11) + ' * ' + p1)}, h) AS h FROM ones
), a1 AS (SELECT s, {cut(f"xor(h, h // {1 << 33}::UHUGEINT) * {p2}")} AS h FROM tails
), a2 AS (SELECT s, {cut(f"xor(h, h // {1 << 29}::UHUGEINT) * {p3}")} AS h FROM a1
), hashes AS MATERIALIZED (SELECT s, CAST(xor(h, h // {1 << 32}::UHUGEINT) AS UBIGINT) AS h FROM a2
), voted AS (
  SELECT r, CAST({votes} AS UBIGINT) AS fp FROM shingles JOIN hashes USING (s) GROUP BY r
), prints AS MATERIALIZED (
  SELECT words.r, doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM words LEFT JOIN voted ON voted.r = words.r
), f AS MATERIALIZED (
  SELECT DISTINCT fp FROM prints
), links AS MATERIALIZED (
  SELECT x.fp AS a, y.fp AS b FROM f AS x JOIN f AS y ON bit_count(xor(x.fp, y.fp)) <= 3 AND x.fp <> y.fp
), reached AS (
  SELECT fp AS start, fp AS node FROM f UNION SELECT reached.start, links.b FROM reached JOIN links ON links.a = reached.node
), named AS (
  SELECT start AS fp, min(doc_id) AS component_id FROM reached JOIN prints ON prints.fp = reached.node GROUP BY 1
)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM prints JOIN named USING (fp)
"""


ORACLE_SQL: dict[str, str] = {"op5_substring_dedup": SUBSTRING_SQL, "op7_url_filter": _url_filter_sql(), "op10_quartile_digest": DIGEST_SQL, "op2_simhash_trie": _simhash_sql()}
