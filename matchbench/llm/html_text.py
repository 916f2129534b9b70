"""Main text of web pages by nearest-URL page differencing.

Pages are cut into lines, one for each block element. Each page is paired with the page of the same
host whose URL path shares the most leading segments with its own. The two pages' lines are aligned
by their longest common subsequence, and lines of the page that align are site furniture: deleted.
Lines inside landmark elements (nav, header, footer, aside, forms, scripts, elements whose class or
id names an advert, notice, sidebar, menu or comment) align by their element, not their words, since
menus and adverts change from page to page; runs of such lines count as one.

An exact check of the element structure follows, because differencing alone can't give right results:
an article repeats paragraphs of its neighbour (which differencing would delete), and furniture may
have no counterpart on the neighbour (which it would keep). So paragraphs, headings, quotations and
table cells (``PROSE``) inside ``article`` or ``main`` never align, landmark lines go even if the neighbour
lacks them, and on pages with an article the lines outside it go. Other lines inside an article (share
lines, notices, lists) go if they align, unless nothing else of the article is left: then the neighbour
is a copy. On pages without such elements the alignment decides alone. A notice inside an article that is
marked up as a paragraph stays.

Pairing uses the least and greatest page id under each path prefix, pre-aggregated, so a hot host is
no hot task: a page takes the deepest prefix that another page shares.

Edge cases: null html is empty, giving empty text; a null URL, or a host's only page, has no partner
and is cut by its structure alone; repeated rows give equal results; with a null page id, a page
still pairs with others but is nobody's partner; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, giving_back, materialize, small

#: Partners whose lines are broadcast at most; more are joined by shuffle.
BROADCAST_KEYS = 100_000
#: Elements by what they do.
HIDDEN = frozenset("script style noscript template head title svg iframe object select textarea button".split())
RAW = frozenset("script style textarea title noscript iframe".split())
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
CONTENT = frozenset("article main".split())
#: Elements whose lines inside an article are article text.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption td th dt dd".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the given name closes.
CLOSED_BY = {
    "p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}),
}
#: Class names of furniture: one of these words, alone or with words of layout.
_WHAT = "ads?|advert\\w*|banner|sponsor\\w*|promo\\w*|cookies?|consent|notices?|gdpr|popup|modal|newsletter|subscribe|share|social|sidebar|side|menu|nav\\w*|breadcrumbs?|footer|header|masthead|comments?|replies|reply|related|widget|toolbar|pagination|pager"
_LAYOUT = "site|page|main|global|top|bottom|left|right|inner|outer|bar|box|block|list|links?|buttons?|icons?|section|area|wrap|wrapper|container|content|item|items|body|title|posts?|articles?|form|thread|unit|slot|inline|policy|row|col|\\d+"
_NAMED = re.compile(rf"(?i)(?:^|\s)(?:(?:{_LAYOUT})[_-]+)*(?:{_WHAT})(?:[_-]+(?:{_LAYOUT}|{_WHAT}))*(?=\s|$)")
_READERS = re.compile(r"(?i)(?:^|[\s_-])(?:comments?|repl(?:y|ies))(?:$|[\s_-])")
#: A quote that isn't closed reaches to the page's end, so no place is read twice.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?i)\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())
_SPACE = re.compile(r"\s+")


def lines_of(page: str) -> list[tuple[str, str]]:
    """Lines as (key, text). The key is ``+`` in the prose of an article, ``=`` elsewhere inside it, the
    element's name inside furniture, and empty elsewhere. Hidden elements have no lines. Takes time in
    proportion to the page, however its tags nest."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # open elements: name, and the key of what is inside
    opened: dict[str, int] = {}
    held: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(held))).strip() if held else ""
        held.clear()
        key = stack[-1][1] if stack else ""
        if text and key != "hidden":
            out.append((key, text))

    def close(name: str) -> None:
        while stack:
            last = stack.pop()[0]
            opened[last] -= 1
            if last == name:
                return

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        closing, name = m.group(1), m.group(2).lower()
        if name in BLOCKS or name in HIDDEN:
            flush()
        if closing:
            if opened.get(name):
                close(name)
            continue
        if name in VOID or m.group(3).endswith("/"):
            continue
        if shut := CLOSED_BY.get(name):
            for i in range(len(stack) - 1, max(-1, len(stack) - 65), -1):  # such elements lie close together
                if stack[i][0] in shut:
                    close(stack[i][0])
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "div", "article", "section", "td", "body"):
                    break
        named = [next(x for x in a if x) for a in _ATTRIBUTE.findall(m.group(3)) if any(a)]
        above = stack[-1][1] if stack else ""
        inside = above in ("+", "=")
        if above == "hidden" or above.startswith("!"):
            key = above
        elif name in HIDDEN:
            key = "hidden"
        elif name in CONTENT:
            key = "!" + name if any(_READERS.search(x) for x in named) else "="
        elif name in FURNITURE and not (name == "header" and inside) or name not in ("body", "html") and any(x.lower() in _ROLES or _NAMED.search(x) for x in named):
            key = "!" + name
        else:
            key = "+" if above == "+" or inside and name in PROSE else above
        stack.append((name, key))
        opened[name] = opened.get(name, 0) + 1
        if name in RAW:  # no tags inside
            found = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            close(name)
            at = found.end() if found else end
    flush()
    return out


def align_keys(lines: list[tuple[str, str]]) -> list[str | None]:
    """What each line aligns by: its element in furniture (once for a run), its words elsewhere, None
    in an article's prose."""
    keys: list[str | None] = []
    for key, text in lines:
        k = None if key == "+" else "\1" + text if key == "=" else "\0" + key if key else text
        keys.append(k)
    return keys


def common_lines(a: list[str | None], b: list[str | None]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``. Runs of equal keys are one
    key. Equal ends are cut off; the rest is solved by longest increasing subsequences of matches."""
    from bisect import bisect_left

    def runs(keys):
        out: list[tuple[str, list[int]]] = []
        for i, k in enumerate(keys):
            if k is None:
                continue
            if out and out[-1][0] == k:
                out[-1][1].append(i)
            else:
                out.append((k, [i]))
        return out

    x, y = runs(a), runs(b)
    lo = 0
    while lo < min(len(x), len(y)) and x[lo][0] == y[lo][0]:
        lo += 1
    hi = 0
    while hi < min(len(x), len(y)) - lo and x[-1 - hi][0] == y[-1 - hi][0]:
        hi += 1
    kept = [*range(lo), *range(len(x) - hi, len(x))]
    places: dict[str, list[int]] = {}
    for j in range(lo, len(y) - hi):
        places.setdefault(y[j][0], []).append(j)
    tails: list[int] = []  # the least end of an increasing run of each length
    nodes: list[tuple[int, object]] = []
    for i in range(lo, len(x) - hi):
        for j in reversed(places.get(x[i][0], ())):
            n = bisect_left(tails, j)
            node = (i, nodes[n - 1] if n else None)
            if n == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[n], nodes[n] = j, node
    node = nodes[-1] if nodes else None
    while node:
        kept.append(node[0])
        node = node[1]
    return {i for k in kept for i in x[k][1]}


def main_text(lines: list[tuple[str, str]], partner: list[str | None] | None) -> str:
    """The page's text after differencing with its partner's keys and the check of its structure."""
    shared = common_lines(align_keys(lines), partner) if partner else set()
    inside = any(key in ("+", "=") for key, _ in lines)
    copy = all(key != "+" and (key != "=" or i in shared) for i, (key, _) in enumerate(lines))
    kept = [text for i, (key, text) in enumerate(lines) if key == "+" or (key == "=" and (copy or i not in shared)) or (i not in shared and not key and not inside)]
    return "\n".join(kept)


def url_prefixes(url: Column) -> Column:
    """``host/a/b`` and so on, the deepest first, down to the host."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.-]*://", ""), r"[?#].*$", "")
    parts = F.filter(F.split(bare, "/"), lambda x: x != "")
    n = F.size(parts)
    return F.when(F.size(parts) > 0, F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))


def partners(pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Rows (page_id, url, partner) for the pages that have a partner."""
    x = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url")).where("url is not null")
    x = x.select("page_id", "url", F.posexplode(url_prefixes(F.col("url"))).alias("depth", "prefix"))
    ends = x.groupBy("prefix").agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi")).where("lo < hi")
    near = x.join(ends, "prefix").withColumn("partner", F.when(F.col("page_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")))
    return near.groupBy("page_id", "url").agg(F.min_by("partner", "depth").alias("partner"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with ``main_text``; the html column is read once a page and once for each partner."""
    if "main_text" in {c.lower() for c in pages.columns}:
        raise ValueError("the input already has main_text")
    pair = materialize(partners(pages, page_id, url), "html-partners")
    p, keys, i, u = fresh(pages, "partner", "keys", "id", "url")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[k for k in align_keys(lines_of(h or "")) if k is not None] for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], [p, keys])

    id_type = pages.schema[page_id].dataType
    wanted = pair.select(F.col("partner").alias(i)).distinct()
    texts = pages.select(F.col(f"`{page_id}`").alias(i), F.col(f"`{html}`").alias("html")).join(small(wanted), i, "left_semi")
    theirs = texts.mapInArrow(giving_back(cut), T.StructType([T.StructField(p, id_type), T.StructField(keys, T.ArrayType(T.StringType()))])).dropDuplicates([p])
    theirs = materialize(theirs, "html-keys")
    theirs = small(theirs, BROADCAST_KEYS)
    pair = pair.select(F.col("page_id").alias(i), F.col("url").alias(u), F.col("partner").alias(p))
    own = pages.join(small(pair), pages[f"`{page_id}`"].eqNullSafe(pair[i]) & (pages[f"`{url}`"] == pair[u]), "left").drop(i, u)
    both = own.join(theirs, p, "left").select(*[f"`{c}`" for c in pages.columns], keys)
    at, last = pages.columns.index(html), len(pages.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(lines_of(h or ""), k) for h, k in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(texts, pa.string())], [*batch.schema.names[:last], "main_text"])

    return both.mapInArrow(giving_back(run), T.StructType([*pages.schema.fields, T.StructField("main_text", T.StringType())]))
