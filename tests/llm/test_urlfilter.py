import re
import unicodedata

import duckdb
import pandas as pd

from lattica.llm import urlfilter
from lattica.llm.queries import ORACLE_SQL

URLS = [
    "http://a.example.org/es/1", "https://example.org/en/1?x", "http://www.example.org/en/15", "http://A.ORG/x", "http://a.org", "http://com/fr/2", "http://b.com/de/2", "http://b.com/de", "http://evilexample.org/es/1",
    "http://www.casino-win.example.net/en", "http://free-bets.net/", "http://freebets.net/", "http://free.net/free/free", "http://n.net/spamming", "http://n.net/?casino", None, "", "no scheme", "x://", "a://b://c/fr/", "http://com/fr/casino", "http://user@H.Net:80/p#f", "http://ünï.net/ß", "http://h.net/a\nb?c",
    "http://x.net/écasino", "http://x.net/casinoé", "http://x.net/é-casino", "http://x.example.net/go?to=casino", "http://n.net/?q=free+pills", "www.porn.com/xxx", "http://n.net/p#poker,bingo", "http://n.net/?q=free%2Fpills", "http://n.net/?q=%66free",
    "http://n.net/\u212Aasino", "http://n.net/½casino", "http://n.net/Ⅳporn", "casino", "http://org/casino?xxx", "http://n.net/%casino%2", "HTTP://N.NET/PORN",
]


def slow(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if path.startswith(p) and (host == h or host.endswith("." + h))]
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.sub("%[0-9A-Fa-f]{2}", " ", url or ""))
    words = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in low).split(" ")
    strict = sum(w in urlfilter.STRICT for w in words)
    soft = len({w for w in words if w in urlfilter.SOFT})
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if strict or soft >= 2 else "allow"


def test_as_brute_force(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(None, "http://casino.net", ""), (0, URLS[0], "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted(((str(r["page_id"]), r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in urlfilter.judge(pages).collect()))
    assert got == sorted((str(i), *(x or "" for x in slow(u))) for i, u, _ in rows)
    assert urlfilter.judge(spark.createDataFrame([], pages.schema)).count() == 0


def test_sql_says_the_same():
    pages = pd.DataFrame({"page_id": range(len(URLS)), "url": URLS})  # noqa: F841  the SQL's table
    got = duckdb.sql(ORACLE_SQL["op7_url_filter"]).fetchall()
    assert sorted((r[0], r[1], r[2], r[3], r[4]) for r in got) == sorted((i, *slow(u)) for i, u in enumerate(URLS))
    verdicts = {URLS[r[0]]: r[4] for r in got}
    assert verdicts["http://x.net/écasino"] == "allow" and verdicts["http://x.net/é-casino"] == "block" and verdicts["http://n.net/?q=free+pills"] == "block"


def test_boundaries():
    hits = urlfilter.vocabulary_hits
    assert hits("casino") == (1, 0) and hits("casinos") == (0, 0) and hits("my-casino.x") == (1, 0) and hits("casino1") == (1, 0)
    assert hits("free-free-free") == (0, 1) and hits("cheap_pills") == (0, 2) and hits("casino-casino") == (2, 0)
