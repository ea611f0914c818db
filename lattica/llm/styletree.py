"""Main-text extraction with a site style tree (after Yi, Liu and Li 2003).

Pages of one host are merged by style path: the chain of elements (tag, classes, id, role) above a block. For each path the
host's pages give a presentation importance (entropy of the sequences of children that it is used with) and for each
of its texts a content importance (one less the entropy of the pages that repeat it). What an element says about itself is
one more feature of its path: elements and names that mark navigation, notices and the like take importance away, as do
links where a name is doubtful, and what is inside a main article has some from the start. A branch whose importance is low
on its host is cut from each page; nothing is cut but by the tree. Copies of a page on one host are counted once, so that
copied pages don't lose their text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, materialize, ready
from .urlfilter import host_of

#: Importance at or below which a branch is cut; how fast the weight moves from a node to what is below it.
CUT, DECAY = 0.2, 0.9
#: Share of the importance that a branch or text inside a main article has, however often it is repeated.
MAIN_PRIOR = 0.1
#: Importance that elements without main text, telling names and doubtful names take away; the last grows by up to LINKS with the share of linked text.
NO_TEXT, TELLING, CLEAR, DOUBTFUL, LINKS = 1.0, 0.9, 0.8, 0.3, 0.6
#: Depth above which only elements that mark themselves are cut: the page and its body always stay.
PAGE_DEPTH = 2
#: Low-importance branches up to which the table is broadcast.
BROADCAST_ROWS = 50_000
#: What stands between the blocks of a page's text.
BETWEEN = "\n\n"
EXTRACTED = "page_id long, url string, text string, n_chars long"

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ENDS = re.compile(r"[>\"']")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements that hold no main text, whatever they are called.
_NO_TEXT = frozenset(
    "head script style nav aside footer form noscript template svg iframe object canvas button select textarea input label dialog menu audio video map noembed noframes xmp title fieldset option".split()
)
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"),
}
_SCOPES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
#: Words in a class, id or role that mark what isn't main text, in any company.
_TELLING = frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs masthead footer sidebar banner cookie cookies consent gdpr modal overlay ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus newsletter subscribe subscription signup toolbar pagination pager disclaimer copyright tagcloud outbrain taboola complementary contentinfo".split()
)
#: Words that do so alone or with words of layout, and leave a doubt with others (social-history, side-effects, article-header).
_WEAK = frozenset("header foot side aside rail notice notices alert popup reply replies respond discussion share sharing social related recommended login search widget widgets skip teaser form".split())
_LAYOUT = frozenset(
    "area article articles bar block bottom box btn button buttons col column container content count floating fixed global group icon icons inner item items left link links list main outer page panel post posts right section site small stories sticky tab tabs top widget wp wrap wrapper".split()
)
_MAIN = frozenset(("article", "main"))
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(eq=False, slots=True)
class Node:
    """An element that holds blocks; path is a hash of the styles down to it, branch that of its ancestor just under the body."""

    path: int
    parent: Node | None
    branch: int
    depth: int
    noise: float
    main: bool
    children: list[str] = field(default_factory=list)
    low: bool = False


@dataclass(slots=True)
class Block:
    node: Node
    text: str
    linked: float


_SEEN: dict[tuple[str, str], tuple[str, float, bool]] = {}


def name_noise(names: str) -> float:
    """How much the words of class, id and role names speak against main text."""
    worst = 0.0
    for name in names.split():
        words = {w.lower() for w in _WORDS.findall(name)}
        if words & _TELLING:
            return TELLING
        if words & _WEAK:
            heading = "header" in words and words & {"article", "post", "content", "entry"}
            worst = max(worst, CLEAR if words <= _WEAK | _LAYOUT and not heading else DOUBTFUL)
    return worst


def _style(tag: str, raw: str) -> tuple[str, float, bool]:
    """(style name, noise, main) of a start tag; the name tells the other two."""
    if (got := _SEEN.get((tag, raw))) is not None:
        return got
    attrs = {}
    for name, value in _ATTR.findall(raw):
        attrs.setdefault(name.lower(), value.strip("\"'"))
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""))
    noise = NO_TEXT if tag in _NO_TEXT or hidden else 0.0
    if tag not in ("html", "body", "main"):
        noise = max(noise, name_noise(f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}"))
    main = tag in _MAIN or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"
    own = re.sub(r"\d+", "0", ".".join([tag, *sorted(attrs.get("class", "").split())]) + (f"#{attrs['id']}" if attrs.get("id") else ""))
    if len(_SEEN) > 50_000:
        _SEEN.clear()
    _SEEN[tag, raw] = f"{own} {noise}{'m' if main else ''}", noise, main
    return _SEEN[tag, raw]


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


class _Stack:
    """Open elements, with the places of each tag, so that the nearest one is known without a walk."""

    def __init__(self, root: Node):
        self.nodes, self.tags, self.blocks = [root], ["#root"], [0]
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, node: Node) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag in _BLOCK:
            self.blocks.append(len(self.tags))
        self.nodes.append(node)
        self.tags.append(tag)

    def nearest(self, tags: tuple[str, ...]) -> int:
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=0)

    def pop(self) -> None:
        self.places[self.tags.pop()].pop()
        self.nodes.pop()
        if self.blocks[-1] == len(self.tags):
            self.blocks.pop()


def parse(source: str) -> tuple[list[Block], list[Node]]:
    """Blocks of text in page order with the node that holds them, and all nodes, parents first; tolerant of unclosed and stray tags.

    The time is linear in the page's length, whatever its nesting.
    """
    root = Node(0, None, 0, 0, 0.0, False)
    nodes, blocks, stack = [root], [], _Stack(root)
    held: list[str] = []
    linked, in_link, quotes = 0, False, True

    def say(text: str) -> None:
        nonlocal linked
        held.append(text)
        if in_link:
            linked += len(text)

    def flush() -> None:
        nonlocal linked
        if held:
            raw = "".join(held)
            text = " ".join(entities.unescape(raw).split())
            if text:
                blocks.append(Block(stack.nodes[-1], text, min(1.0, linked / len(raw))))
            held.clear()
            linked = 0

    def pop_to(tags: tuple[str, ...], stops: tuple[str, ...] = ()) -> None:
        at = stack.nearest(tags)
        if at and at > stack.nearest(stops):
            flush()
            while len(stack.tags) > at:
                stack.pop()

    def end_of_tag(at: int) -> int:
        nonlocal quotes
        start = at
        while quotes:
            m = _ENDS.search(source, at)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            at = m.end()
            if source[max(start, m.start() - 8) : m.start()].rstrip().endswith("="):  # a quote opens a value only there
                at = source.find(m[0], at) + 1
                if not at:
                    break
        quotes = False  # a quote is never closed: from here on they are letters
        return source.find(">", start)

    at, n = 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            say(source[at:])
            break
        if lt > at:
            say(source[at:lt])
        if source.startswith(("<!", "<?"), lt):
            comment = source.startswith("<!--", lt)
            end = source.find("-->" if comment else ">", lt + (4 if comment else 2))
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        closing = source.startswith("/", lt + 1)
        m = _NAME.match(source, lt + 1 + closing)
        if m is None:
            say("<")
            at = lt + 1
            continue
        end = end_of_tag(m.end())
        if end < 0:
            say(source[lt:])
            break
        at = end + 1
        tag = m[0].lower()
        if closing:
            if tag == "a":
                in_link = False
            if tag == "p" and not stack.nearest(("p",)):
                flush()
            elif tag == "br":
                say(" ")
            elif tag in _BLOCK or tag in _NO_TEXT:
                pop_to((tag,))
            elif (place := stack.nearest((tag,))) > stack.blocks[-1]:
                if stack.nodes[place] is not stack.nodes[place - 1] or stack.nodes[-1] is not stack.nodes[place]:
                    flush()
                while len(stack.tags) > place:
                    stack.pop()
            continue
        raw = source[m.end() : end]
        name, noise, main = _style(tag, raw)
        block = tag in _BLOCK
        if tag in _VOID:
            if block:
                flush()
            elif tag == "br":
                say(" ")
            continue
        in_link = in_link or tag == "a"
        if block or noise:
            flush()
            if block:
                pop_to(("p",), ("td", "th", "table", "button", "object"))
                if tag in _CLOSES:
                    for _ in _CLOSES[tag]:
                        pop_to(_CLOSES[tag], _SCOPES.get(tag, ("table",)))
                while len(stack.tags) - 1 > stack.blocks[-1] and stack.nodes[-1] is stack.nodes[-2]:
                    stack.pop()  # an inline element that was never closed doesn't hold the next block
        parent = node = stack.nodes[-1]
        if block or noise:
            if tag == "header" and not parent.main:
                noise = max(noise, TELLING)
            path = _hash(f"{parent.path}/{name}")
            depth = parent.depth + 1
            node = Node(path, parent, path if depth <= PAGE_DEPTH + 1 else parent.branch, depth, max(parent.noise, noise), parent.main or main)
            parent.children.append(name)
            nodes.append(node)
        if tag in _RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = found.end() if found else n
            continue
        if raw.endswith("/") and not block:
            continue
        stack.push(tag, node)
    flush()
    return blocks, nodes


def _page_key(blocks: list[Block]) -> int:
    """The same for copies of a page: a hash of its main article if that is half of the text without clear noise, else of all of that."""
    rest = [b for b in blocks if b.node.noise < CLEAR]
    main = [b for b in rest if b.node.main]
    own = main if 2 * sum(len(b.text) for b in main) >= sum(len(b.text) for b in rest) else rest
    return _hash("\n".join(b.text for b in own))


_STYLE = "path long, parent long, branch long, depth int, noise double, main boolean"
_FEATURE = f"host string, page long, {_STYLE}, kind string, feat long, chars long, linked double"


def page_features(blocks: list[Block], nodes: list[Node]) -> list[tuple]:
    """Distinct (node, kind, feat, chars, linked chars) of a page: P for a sequence of children, C for a text.

    Of a branch of clear noise only its top counts, once, without what is in it: nothing below can save it.
    """
    own: dict[tuple, tuple] = {}
    for n in nodes:
        if n.noise < CLEAR:
            own[n.path, "P", _hash(" ".join(n.children))] = n, 0, 0.0
        elif n.parent is None or n.parent.noise < CLEAR:
            own[n.path, "P", 0] = n, 0, 0.0
    for b in blocks:
        if b.node.noise < CLEAR:
            own[b.node.path, "C", _hash(b.text)] = b.node, len(b.text), b.linked * len(b.text)
    return [(n, kind, feat, chars, linked) for (_, kind, feat), (n, chars, linked) in own.items()]


def _features(pages: DataFrame) -> DataFrame:
    """page_features of every page; page is equal for copies."""
    names = [x.split()[0] for x in _FEATURE.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.float64())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            blocks, nodes = parse(source or "")
            key = _page_key(blocks)
            rows += [(host, key, n.path, n.parent.path if n.parent else None, n.branch, n.depth, n.noise, n.main, *rest) for n, *rest in page_features(blocks, nodes)]
        cols = zip(*rows) if rows else [[] for _ in kinds]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return map_arrow(pages, run, _FEATURE)


def composite(nodes: dict[str, tuple[float | None, float | None]], parent_of: Callable | None = None, depth_of: Callable | None = None) -> dict[str, float]:
    """Importance of each path of a host from (presentation, content) importance of its own and of what is below it.

    Paths are texts with slashes unless parent_of and depth_of tell where they belong.
    """
    parent_of, depth_of = parent_of or (lambda p: p.rpartition("/")[0] if p else None), depth_of or (lambda p: p.count("/"))
    below: dict[str, list[str]] = {}
    for path in nodes:
        below.setdefault(parent_of(path), []).append(path)
    out: dict[str, float] = {}
    for path in sorted(nodes, key=lambda p: -depth_of(p)):
        shown, said = nodes[path]
        parts = [out[c] for c in below.get(path, ())]
        if said is not None:
            parts.append(said)
        inner = sum(parts) / len(parts) if parts else None
        outer = shown if below.get(path) else None
        if inner is None:
            out[path] = outer if outer is not None else 1.0
        elif outer is None:
            out[path] = inner
        else:
            out[path] = (1 - DECAY) * outer + DECAY * inner
    return out


def importance(value, main, noise, linked):
    """A path's or a text's final importance from its statistics (value) and what its elements say."""
    doubt = noise + LINKS * linked if 0 < noise < CLEAR else noise
    return (1 - min(doubt, 1.0)) * (MAIN_PRIOR + (1 - MAIN_PRIOR) * value if main else value)


def cut_of(styles: list[dict]) -> list[int]:
    """Paths of one branch of a host's tree at which it is cut; what is below a cut path isn't listed."""
    own = {s["path"]: s for s in styles}
    stats = {p: (s["shown"], s["said"]) for p, s in own.items() if s["noise"] < CLEAR}
    values = composite(stats, lambda p: own[p]["parent"], lambda p: own[p]["depth"])
    gone, out = set(), []
    for path in sorted(own, key=lambda p: own[p]["depth"]):
        s = own[path]
        if s["parent"] in gone:
            gone.add(path)
        elif (s["depth"] > PAGE_DEPTH or s["noise"] >= CLEAR) and importance(values.get(path, 1.0), s["main"], s["noise"], s["linked"] or 0.0) <= CUT:
            gone.add(path)
            out.append(path)
    return out


def low_branches(pages: DataFrame) -> DataFrame:
    """host, path, feat: branches of each host's style tree that aren't important; feat null for a whole branch."""
    keys, style = ["host", "path", "kind", "feat"], ["parent", "branch", "depth", "noise", "main"]
    firsts = [F.first(c).alias(c) for c in style]
    once = _features(pages).groupBy("page", *keys).agg(*firsts, F.max("chars").alias("chars"), F.max("linked").alias("linked"))
    counts = once.groupBy(*keys).agg(F.count("*").alias("n"), *firsts, F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    counts = materialize(counts, "styles")
    # one use more than counted, which repeats nothing: few uses say little, and what has a single one is important
    most = F.log(F.col("m") + 1)
    shown = 1 - F.col("same") / F.col("m") / most
    said = 1 - F.col("repeats") / most
    uses, log_n = F.when(F.col("kind") == "P", F.col("n")), F.log("n")
    own = counts.groupBy("host", "path").agg(
        F.sum(uses).alias("m"), F.sum(uses * log_n).alias("same"), F.avg(F.when(F.col("kind") == "C", log_n)).alias("repeats"), *firsts, F.try_divide(F.sum("linked"), F.sum("chars")).alias("linked")
    )
    # paths used once have importance 1, and count for no other
    own = own.where("m >= 2 or noise > 0").select("host", "path", *style, "m", shown.alias("shown"), said.alias("said"), "linked")

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, paths = [], []
        for host, styles in zip(batch.column("host").to_pylist(), batch.column("styles").to_pylist()):
            for path in cut_of(styles):
                hosts.append(host)
                paths.append(path)
        return pa.record_batch([pa.array(hosts, pa.string()), pa.array(paths, pa.int64())], ["host", "path"])

    # distinct style paths, not pages, of what stands under one element below a host's body
    told = F.struct("path", "parent", "depth", "noise", "main", "shown", "said", "linked")
    branches = map_arrow(own.groupBy("host", "branch").agg(F.collect_list(told).alias("styles")), judge, "host string, path long")
    repeated = counts.where("kind = 'C' and n > 1").join(own.select("host", "path", "m"), ["host", "path"])
    alone = 1 - log_n / most
    value = F.when(F.col("main"), MAIN_PRIOR + (1 - MAIN_PRIOR) * alone).otherwise(alone)
    doubt = F.when(F.col("noise") > 0, F.least(F.lit(1.0), F.col("noise") + LINKS * F.col("linked") / F.greatest("chars", F.lit(1)))).otherwise(0.0)
    repeated = repeated.where((1 - doubt) * value <= CUT).select("host", "path", "feat")
    return branches.select("host", "path", F.lit(None).cast("long").alias("feat")).unionByName(repeated)


def main_text(source: str, branches: set[int], repeated: set[tuple[int, int]]) -> str:
    """Blocks of a page that stay, joined by two line ends: all that are in no low branch and aren't low themselves, in its article or outside."""
    blocks, nodes = parse(source)
    for n in nodes:
        n.low = n.path in branches or (n.parent is not None and n.parent.low)
    return BETWEEN.join(b.text for b in blocks if not b.node.low and (b.node.path, _hash(b.text)) not in repeated)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    Null html is empty and gives an empty text; pages without a host share the host ''. Every host and style path with two
    uses has statistics; what all pages of a host say goes from four different pages on, or five in an article. Elements
    that mark themselves as no main text go from the first page on. Repeated rows come back as often; an empty table gives
    an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    ready(spark)
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    own = own.withColumn("host", host_of(F.col("url")))
    low = materialize(low_branches(own.select("host", "html")), "low")
    small = low.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    by_host = low.groupBy("host").agg(F.collect_list(F.struct("path", "feat")).alias("low"))
    joined = own.join(F.broadcast(by_host) if small else by_host, "host", "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        known: dict[str, tuple[set, set]] = {}
        for host, source, rows in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), _lists(batch.column("low"), batch.column("host"))):
            if host not in known:
                known[host] = {r["path"] for r in rows if r["feat"] is None}, {(r["path"], r["feat"]) for r in rows if r["feat"] is not None}
            out.append(main_text(source or "", *known[host]))
        return pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(joined.select("page_id", "url", "host", "html", "low"), run, EXTRACTED)


def _lists(low: pa.Array, hosts: pa.Array) -> Iterator[list[dict]]:
    """Each row's list, unpacked once for each host."""
    seen: dict[str, list[dict]] = {}
    for i, host in enumerate(hosts.to_pylist()):
        if host not in seen:
            seen[host] = low[i].as_py() or []
        yield seen[host]
