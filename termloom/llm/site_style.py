"""Main-text extraction with site style trees.

The distinct pages of a host are merged into a tree of styles: a node is a path of tags and classes. For each node two
normalised entropies over these pages are taken, so that copies of a page weigh as much as one: of its presentation (the
child tags) and of its content (its own text). A node's own importance is the larger of them. It is weighed with what the
same path is worth on other hosts, which counts as much as BACKOFF further pages: a host of few pages leans on the tree
merged over all hosts, one of many on its own. A branch is as important as its most important node, and branches under
IMPORTANCE go, wherever they stand. What the markup itself says comes before all counts: elements that are menus, footers,
asides, forms and the like, and classes made up of such words alone, are worth nothing; prose inside an article or main
element is article text, however often a host repeats it. On pages that have such an element, what stands outside it must
prove its importance (DOUBT).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import BROADCAST_BYTES, arrow_map, batch_of, column, cut, slices

#: Branches below this importance go.
IMPORTANCE = 0.3
#: What other hosts' trees say of a path counts as much as so many pages of the host; so does the belief that a path nobody else has is important.
BACKOFF = 4
#: Outside an article a branch starts at the first importance and is kept from the second on.
DOUBT = (0.4, 0.5)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|title|textarea|xmp|noembed|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Element kinds.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
_APART = frozenset("nav footer aside form head button select option menu dialog input label fieldset search".split())
_MAIN = frozenset(("article", "main"))
# Elements that hold a whole page or article, which no class cuts.
_WHOLE = frozenset(("html", "body", "article", "main"))
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Words in classes, ids and roles of branches that are no article text.
_WORDS = frozenset(
    "nav navbar navigation menu topbar toolbar sidebar aside complementary footer contentinfo ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "cookie cookies consent notice notification alert gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "comment comments respond replies discussion disqus related recommended breadcrumb breadcrumbs pagination pager widget search form disclaimer copyright legal skip".split()
)


# Parts of class names that say nothing by themselves; "site-footer" is a footer, "search-algorithms" is no search box.
_NEUTRAL = frozenset(
    "site page global main top bottom left right inner outer box block area bar wrap wrapper container section list item items group panel slot unit content body primary secondary "
    "post posts article articles entry text mobile desktop sticky fixed js is holder row col column columns link links button buttons icon icons image first last small large default".split()
)


def _says(name: str, words: frozenset[str]) -> bool:
    """Whether a class name consists of the words and of neutral parts alone."""
    parts = [p for p in re.split(r"[-_]+|(?<=[a-z])(?=\d)", name) if p and not p.isdigit()]
    return any(p in words for p in parts) and all(p in words or p in _WORDS or p in _NEUTRAL for p in parts)


_HEADER = frozenset(("header", "masthead"))


@lru_cache(maxsize=4096)
def _kind(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """Name of the node in the tree, whether its tag or attributes tell it apart from text, whether they call it a header."""
    names = [w for m in _NAMES.finditer(attrs) for w in (m[1] or m[2] or m[3] or "").lower().split()]
    label = ".".join([tag, *(re.sub(r"\d+", "0", w) for w in names)])
    apart = tag in _APART or (tag not in _WHOLE and any(_says(w, _WORDS) for w in names))
    return label, apart, tag == "header" or (tag not in _WHOLE and any(_says(w, _HEADER) for w in names))


class _Open:
    __slots__ = ("tag", "path", "apart", "main", "kept")

    def __init__(self, tag: str, path: str, apart: bool, main: bool, kept: bool):
        self.tag, self.path, self.apart, self.main, self.kept = tag, path, apart, main, kept


def walk(html: str, low: frozenset[str] = frozenset(), tree: dict[str, tuple[list, list]] | None = None) -> list[tuple[bool, str, str]]:
    """Blocks in page order, each with whether it lies in an article or main element and its path; branches that go are left out.

    low: paths of little importance. tree: gets for each path its child tags and its own texts.
    """
    stack = [_Open("", "", False, False, True)]
    out: list[tuple[bool, str, str]] = []
    pieces: list[str] = []
    at = 0

    def flush() -> None:
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                out.append((stack[-1].main, stack[-1].path, text))
            pieces.clear()

    def text(lo: int, hi: int) -> None:
        if hi > lo:
            top = stack[-1]
            if tree is not None:
                tree.setdefault(top.path, ([], []))[1].append(html[lo:hi])
            if top.kept:
                pieces.append(html[lo:hi])

    for m in _TOKEN.finditer(html):
        text(at, m.start())
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            if tag == "p" or any(o.tag == tag for o in stack):
                if tag in _BLOCK:
                    flush()
                if any(o.tag == tag for o in stack):
                    while stack[-1].tag != tag:
                        stack.pop()
                    stack.pop()
            continue
        if tag == "br":
            if stack[-1].kept:
                pieces.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            if any(o.tag == "p" for o in stack):
                depth = max(k for k, o in enumerate(stack) if o.tag == "p")
                if not any(o.tag in ("td", "th", "button", "table") for o in stack[depth:]):
                    del stack[depth:]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _CLOSES.get(tag, ()):
                    del stack[k:]
                    break
                if stack[k].tag in ("ul", "ol", "table", "dl", "select", "div", "article", "section", "body"):
                    break
        up = stack[-1]
        label, apart, header = _kind(tag, m["attrs"])
        path = f"{up.path}>{label}" if up.path else label
        if tree is not None:
            tree.setdefault(up.path, ([], []))[0].append(tag)
            tree.setdefault(path, ([], []))
        if tag in _VOID:
            continue
        main = up.main or (tag in _MAIN and not apart)
        apart = up.apart or apart or (header and not main)
        kept = up.kept and not apart and (path not in low or (main and (tag in _PROSE or tag in _MAIN)))
        stack.append(_Open(tag, path, apart, main, kept))
    text(at, len(html))
    flush()
    return out


def main_text(html: str, low: frozenset[str] = frozenset(), doubtful: frozenset[str] = frozenset()) -> str:
    """The page's blocks that are left, one a line; on pages with an article or main element those outside it whose path is doubtful go."""
    blocks = walk(html, low)
    inside = any(main for main, _, _ in blocks)
    return "\n".join(t for main, path, t in blocks if main or not inside or path not in doubtful)


_NODES = pa.schema([("host", pa.string()), ("path", pa.string()), ("kind", pa.int32()), ("value", pa.int64()), ("n", pa.int64())])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each node's presentations (kind 0) and contents (kind 1) over a slice's pages."""
    hash_ = lambda s: xxhash.xxh3_64_intdigest(s) - (1 << 63)
    for batch, texts in slices(batches, "html"):
        total: Counter = Counter()
        for host, html in zip(column(batch, "host").to_pylist(), texts.to_pylist()):
            tree: dict[str, tuple[list, list]] = {}
            walk(html, tree=tree)
            for path, (tags, own) in tree.items():
                if path:
                    total[host, path, 0, hash_(" ".join(dict.fromkeys(tags)))] += 1
                    total[host, path, 1, hash_(" ".join(" ".join(own).split()))] += 1
        if total:
            host, path, kind, value = map(list, zip(*total))
            yield batch_of(_NODES, host, path, kind, value, list(total.values()))


def importance(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance, outside) of the distinct pages(host, html), both from 0 to 1 and the largest in the branch.

    With n pages of a host that have the node, own their entropy, W and S the sums of n - 1 and (n - 1) * own over all other
    hosts and B = BACKOFF: the tree of others says (S + B) / (W + B), importance is ((n - 1) * own + B * that) / (n - 1 + B),
    outside is ((n - 1) * own + B * DOUBT[0]) / (n - 1 + B).
    """
    pages = pages.groupBy("host", F.md5("html").alias("digest")).agg(F.first("html").alias("html")).select("host", "html")
    counts = arrow_map(pages, _merge, "host string, path string, kind int, value long, n long").groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))
    nodes = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    entropy = F.when(F.col("pages") > 1, F.round((F.ln("pages") - F.col("s") / F.col("pages")) / F.ln("pages"), 9)).otherwise(F.lit(0.0))
    nodes = cut(nodes.groupBy("host", "path").agg(F.max("pages").alias("pages"), F.max(entropy).alias("own")))
    seen, b = F.col("pages") - 1, F.lit(float(BACKOFF))
    paths = cut(nodes.groupBy("path").agg(F.sum(seen * F.col("own")).alias("s"), F.sum(seen).alias("w")))
    others = (F.col("s") - seen * F.col("own") + b) / (F.col("w") - seen + b)
    weigh = lambda before: F.round((seen * F.col("own") + b * before) / (seen + b), 9)
    nodes = nodes.join(sized(paths, "path"), "path").select("host", "path", "pages", weigh(others).alias("own"), weigh(F.lit(DOUBT[0])).alias("out"))
    steps = F.split("path", ">")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), ">"))
    branches = nodes.select("host", F.explode(above).alias("path"), "own", "out").groupBy("host", "path").agg(F.max("own").alias("importance"), F.max("out").alias("outside"))
    return nodes.select("host", "path", "pages").join(branches, ["host", "path"])


def sized(df: DataFrame, *texts: str) -> DataFrame:
    """A written table with a broadcast hint if its rows and the texts they hold are small together."""
    rows, held = df.agg(F.count("*"), F.coalesce(F.sum(sum((F.octet_length(c) for c in texts), F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if held + 64 * rows <= BROADCAST_BYTES else df


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple, tuple] = {}
    for batch, texts in slices(batches, "html"):
        out = []
        for html, lists in zip(texts.to_pylist(), column(batch, "lists").to_pylist()):
            if lists not in known:
                if len(known) > 1000:
                    known.clear()
                low, doubtful = ((lists or "\x1e").split("\x1e") + [""])[:2]
                known[lists] = frozenset(filter(None, low.split("\x1f"))), frozenset(filter(None, doubtful.split("\x1f")))
            out.append(main_text(html, *known[lists]))
        yield batch_of(_TEXTS, column(batch, "id").to_numpy(), column(batch, "url"), out, [len(t) for t in out])


def extract(pages: DataFrame, least: float = IMPORTANCE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page: its article text, blocks joined by one newline, each with single blanks.

    Character references are decoded. A null html is empty; a null url has the empty host. Pages with a null id are
    dropped. Equal pages give equal rows. Branches of importance under `least` go, as do, on pages with an article or main
    element, branches outside it that are doubtful; least = 0 leaves the tree aside. If nothing is left, a page's text is
    empty. An empty table gives no rows. Other columns are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    pages = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host")).where("id is not null")
    judged = importance(pages.select("host", "html"))
    listed = lambda which: F.array_join(F.sort_array(F.collect_list(F.when(which, F.col("path")))), "\x1f")
    lists = F.concat_ws("\x1e", listed(F.col("importance") < least), listed((F.col("outside") < DOUBT[1]) & F.lit(least > 0)))
    found = cut(judged.groupBy("host").agg(lists.alias("lists")))  # paths of a host: its templates, not its pages
    joined = pages.join(sized(found, "host", "lists"), "host", "left").select("id", "url", "html", "lists")
    return arrow_map(joined, _extract, "page_id long, url string, text string, n_chars long")
