"""URL filter: host and path rules first, then a weighted vocabulary counted with an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_arrow

#: (verdict, host, path): fits the host and its subdomains if the URL's path starts with path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: One of these blocks. Terms are runs of a-z.
STRICT = (
    "adult", "camgirl", "camgirls", "casino", "cialis", "erotica", "escort", "escorts", "hentai", "keygen", "milf", "nsfw", "porn", "porno", "sportsbook", "spam", "upskirt", "viagra", "warez", "xnxx", "xvideos", "xxx",
)
#: So many different ones of these block.
SOFT = (
    "ads", "affiliate", "baccarat", "bet", "bets", "betting", "bingo", "blackjack", "bonus", "cheap", "coupon", "coupons", "dating", "erotic", "fetish", "forex", "free", "gambling", "giveaway", "hardcore", "hookup", "hookups",
    "jackpot", "loan", "loans", "lottery", "lotto", "meds", "naked", "nude", "nudes", "payday", "pills", "poker", "popunder", "prize", "prizes", "replica", "roulette", "sex", "sexy", "singles", "slots", "stripper", "swingers", "torrents",
    "track", "weightloss", "win",
)
SOFT_HITS = 2
FILTERED = "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_hits int"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lowered; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without a ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: str, path: str, rules: Sequence[tuple[str, str, str]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits; of equally long ones the first."""
    best = None
    for verdict, own, prefix in rules:
        if path.startswith(prefix) and (host == own or host.endswith(f".{own}")) and (best is None or len(own) + len(prefix) > len(best[0])):
            best = own + prefix, verdict
    return best


@lru_cache(maxsize=4)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    out = ahocorasick.Automaton()
    for term, is_strict in [*((t, False) for t in soft), *((t, True) for t in strict)]:
        out.add_word(term, (term, is_strict))
    out.make_automaton()
    return out


def searched(url: Column) -> Column:
    """What the vocabulary is counted over: the whole URL, A-Z lowered, percent escapes as blanks; empty for null."""
    return F.coalesce(F.translate(F.regexp_replace(url, "%[0-9A-Fa-f]{2}", " "), _UPPER, _LOWER), F.lit(""))


def vocabulary_hits(low: str, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> tuple[int, int]:
    """(strict hits, different soft terms) in a lowered URL. A term counts only with no letter (Unicode category L) on either side of it."""
    n_strict, seen = 0, set()
    for end, (term, is_strict) in _automaton(strict, soft).iter(low):
        before, after = end - len(term), end + 1
        if (before >= 0 and low[before].isalpha()) or (after < len(low) and low[after].isalpha()):
            continue
        if is_strict:
            n_strict += 1
        else:
            seen.add(term)
    return n_strict, len(seen)


def judge(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_hits: int = SOFT_HITS
) -> DataFrame:
    """A row per page (see FILTERED). The longest rule that fits decides, or else the vocabulary over the whole URL, query and fragment included.

    URLs without :// have an empty host and path and no rule; their vocabulary is counted too. Null urls pass. Repeated rows
    come back as often; an empty table gives an empty result; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], []]
        for host, path, url in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "url"))):
            n_strict, n_soft = vocabulary_hits(url, strict, soft)
            rule, verdict = longest_rule(host, path, rules) or (None, "block" if n_strict or n_soft >= soft_hits else "allow")
            for col, value in zip(cols, (rule, verdict, n_strict, n_soft)):
                col.append(value)
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
        return pa.record_batch([*(batch.column(c) for c in ("page_id", "host", "path")), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"])

    url = F.col(url_col).cast("string")
    return map_arrow(pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), searched(url).alias("url")), run, FILTERED)
