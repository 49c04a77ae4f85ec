"""Main text of web pages with a site style tree.

The DOMs of a host's pages are merged: elements with the same path of tags, classes and ids are
one style node. With m distinct pages that have the node, its importance is that of what it looks
like and of what it holds, from the leaves up:

    text:      1 - mean over its distinct pieces of log_m(pages that have the piece)
    style node: (1 - g^l) * H(child sequences) + g^l * mean(importance of its text and child nodes),

where H is entropy to the base m, l the number of child nodes (its own text is one) and g = 0.9.
What is the same on all pages comes to 0, what every page has for itself to 1. A node on
:data:`PAGES` or more distinct pages is noise if it and everything below it, texts included, is
below :data:`NOISE`; its branch is cut from every page. Hosts with fewer distinct pages have no
tree of their own: their pages are merged into one tree of all such hosts, which knows the
boilerplate of the templates they share.

Importance can't tell an advert or a reader's comment, which differ from page to page, from an
article. So elements whose tag or role is not an article's (navigation, forms, scripts, ...) and
those with a class or id that names them as clutter go too, unless they hold the article, the
page's main part or its title: then they are wrappers, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrid.llm.common import map_arrow, slices, small, stored, table

DECAY, NOISE, PAGES = 0.9, 0.2, 5
#: Sites whose noise is broadcast at most (a short list of numbers each); more are joined by a shuffle.
BROADCAST_NODES = 100_000
_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*+(?:>|\Z)|/([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Weight of an article, main part or title among what an element holds; of paragraphs each counts one.
_WHOLE = 1 << 20
#: Elements that never are wrappers of an article.
_ASIDE = frozenset("head script style noscript template nav footer header aside button select option textarea input iframe object embed applet svg math canvas audio video dialog menu map noframes datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source td th".split())
#: Elements that end an open paragraph.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_SCOPE = frozenset("html body article main div section td th table button caption object blockquote aside nav header footer form ul ol dl li".split())
_SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": ("tr", ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": ("option", ("select", "datalist"))}
_DROPPED = frozenset("head script style noscript template nav header footer aside form button select option textarea input iframe object embed applet svg math canvas audio video dialog menu map noframes datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status".split())
_NOISY = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|adslot|adunit|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|popup|modal|overlay|side-?bar|widgets?|share|sharing|social|"
    r"comments?|commentlist|disqus|discussion|respond|replies|reply|related|recommend\w*|breadcrumbs?|menu|nav|navbar|navigation|footer|header|masthead|topbar|newsletter|subscri\w*|signup|login|"
    r"pagination|pager|skip|toolbar|outbrain|taboola|rail|hidden|visually-hidden|sr-only|print-only)(?:$|[\s_-])",
    re.I,
)
#: A class that says what an element or its page has, has not or stands beside isn't the name of the element itself.
_STATE = re.compile(r"^(?:no|has|with|without|is|page|layout|template|single|body|site|not|show|hide|left|right|col)[_-]|[_-](?:with|without|has|no)[_-]", re.I)
#: Open elements at most, as in browsers; what is nested deeper counts as a child of the last one.
DEPTH = 512
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_FIXED = frozenset("html body main article".split())
#: What is no part of a page's looks or contents.
_NOTHING = frozenset("head script style noscript template".split())
_NO_ARTICLE = re.compile(r"(?:^|[_-])(?:comment|reply|related|promo|ad)(?:$|[_-])", re.I)
_BODY = re.compile(r"(?:^|\s)(?:article-?body|post-?content|entry-?content|article-?content|story-?body|article|post|entry|content|main|main-?content)(?:$|\s)", re.I)


class Node:
    """An element: its style path as a hash, and its children (elements and pieces of text)."""

    __slots__ = ("tag", "path", "children", "drop", "body")

    def __init__(self, tag: str, path: int, drop: bool, body: int) -> None:
        self.tag, self.path, self.drop, self.body = tag, path, drop, body
        self.children: list[Node | str] = []


def _element(tag: str, written: str, parent: Node) -> Node:
    kept = {}
    if written and not written.isspace():
        for m in _ATTRIBUTE.finditer(written):
            kept.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    style = " ".join(sorted(kept.get("class", "").split()))
    mark = f"{kept.get('class', '')} {kept.get('id', '')}"
    named = lambda pattern: any(pattern.search(x) and not _STATE.search(x) for x in mark.split())
    drop = tag in _DROPPED or "hidden" in kept or kept.get("aria-hidden", "").lower() == "true" or kept.get("role", "").lower() in _ROLES
    if not drop and tag not in ("html", "body", "main", "article") and mark != " ":
        drop = named(_NOISY)
    elif tag == "article" and mark != " ":  # a reader's comment may be an article of its own
        drop = named(_NO_ARTICLE)
    if not drop and "style" in kept:
        drop = re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", kept["style"], re.I) is not None
    body = 3 if tag == "article" else 2 if tag == "main" or kept.get("role", "").lower() == "main" else 1 if kept.get("itemprop", "").lower() == "articlebody" or (mark != " " and _BODY.search(mark)) else 0
    return Node(tag, xxhash.xxh64_intdigest(f"{parent.path}/{tag}.{style}#{kept.get('id', '')}"), drop, body)


def parsed(html: str) -> Node:
    """The tree of a page; never fails: what isn't understood is text, what isn't closed ends with its parent."""
    root = Node("", 0, False, 0)
    stack = [root]
    at, n = 0, len(html)
    opened: dict[str, int] = {}

    def close(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag] -= 1
        del stack[k:]

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if not opened.get(tag):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in _INLINE and stack[k].tag in _SCOPE:
                    break
        elif m[2]:
            tag = m[2].lower()
            if tag in _ENDS_P and opened.get("p"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in _SCOPE:
                        break
            elif tag in _SAME:
                ends, scope = _SAME[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in scope:
                        break
                    if stack[k].tag == ends or stack[k].tag in ends and type(ends) is tuple:
                        close(k)
                        break
            if tag == "br":
                stack[-1].children.append(" ")
                continue
            node = _element(tag, m[3], stack[-1])
            stack[-1].children.append(node)
            if tag in _RAW:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
                node.children.append(html[at : end.start() if end else n])
                at = end.end() if end else n
            elif tag not in _VOID and not m[3].endswith("/") and len(stack) < DEPTH:
                stack.append(node)
                opened[tag] = opened.get(tag, 0) + 1
    _spare(root)
    return root


def _spare(root: Node) -> None:
    """Wrappers of an article, a main part or a page's title, and forms around paragraphs, aren't clutter."""
    order = [root]
    for node in order:
        # What a dropped article or a heading in an aside holds is no reason to spare what is around it.
        order.extend(c for c in node.children if type(c) is Node)
    holds: dict[int, int] = {}
    for node in reversed(order):
        inside = sum(holds.get(id(c), 0) for c in node.children if type(c) is Node)
        if node.drop and inside and (node.tag == "form" and inside >= 2 or inside >= _WHOLE and node.tag not in _ASIDE):
            node.drop = False
        if not node.drop:
            own = _WHOLE if node.body >= 2 or node.tag == "h1" else 1 if node.tag == "p" else 0
            holds[id(node)] = inside + own


def _bodies(root: Node) -> list[Node]:
    """The outermost elements that hold the article; the whole page if nothing says so."""
    best, found = 0, [root]
    todo = [root]
    while todo:
        node = todo.pop()
        if node.drop:
            continue
        if node.body > best:
            best, found = node.body, [node]
        elif node.body and node.body == best:
            found.append(node)
        if node.body < 3:
            todo.extend(c for c in reversed(node.children) if type(c) is Node)
    if best:
        inside: set[int] = set()
        for node in found:
            todo = [c for c in node.children if type(c) is Node]
            while todo:
                x = todo.pop()
                inside.add(id(x))
                todo.extend(c for c in x.children if type(c) is Node)
        found = [x for x in found if id(x) not in inside]
    return found


def _blocks(body: Node, noise: frozenset[int]) -> list[str]:
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if now:
            text = " ".join(unescape("".join(now)).split())
            if text:
                out.append(text)
            now.clear()

    todo: list[Node | str | None] = [body]
    while todo:
        node = todo.pop()
        if node is None:
            flush()
        elif type(node) is str:
            now.append(node)
        elif node.drop or node.path in noise and node.tag not in _FIXED:
            if node.tag == "header" and node is not body:  # the title of an article often stands in its header
                todo.extend(c for c in reversed(node.children) if type(c) is Node and c.tag in _HEADINGS)
        elif node.tag in _INLINE:
            if node.tag in ("td", "th"):
                now.append(" ")
            todo.extend(reversed(node.children))
        else:
            flush()
            todo.append(None)
            todo.extend(reversed(node.children))
    flush()
    return out


def main_text(html: str | None, noise: frozenset[int] = frozenset()) -> str:
    """The text of a page's article without the branches in ``noise``, one line a block.

    If cutting by importance would leave nothing, only what names itself as clutter is cut.
    """
    if not html:
        return ""
    bodies = _bodies(parsed(html))
    text = "\n".join(b for body in bodies for b in _blocks(body, noise))
    return text or "\n".join(b for body in bodies for b in _blocks(body, frozenset()))


def style_nodes(html: str) -> tuple[int, list[tuple[int, int, int, list[int]]]]:
    """Hash of a page's texts, and of every style node (path, path of the style node above or 0, hash of its child
    sequence, hashes of the pieces of its own text). Inline elements belong to the style node around them.
    """
    merged: dict[int, tuple[int, list[bytes], dict[bytes, None]]] = {}
    todo: list[tuple[Node, int]] = [(c, 0) for c in reversed(parsed(html).children) if type(c) is Node]
    while todo:
        node, up = todo.pop()
        if node.tag in _NOTHING:
            continue
        own = merged.setdefault(node.path, (up, [], {}))
        look: list[bytes] = []
        said: list[str] = []

        def piece() -> None:
            words = " ".join("".join(said).split())  # noqa: B023
            if words:
                own[2][words.encode("utf-8", "replace")] = None  # noqa: B023
            said.clear()  # noqa: B023

        inner: list[Node | str] = list(reversed(node.children))
        below: list[tuple[Node, int]] = []
        while inner:
            child = inner.pop()
            if type(child) is str:
                said.append(child)
            elif child.tag in _INLINE:
                inner.extend(reversed(child.children))
            else:
                piece()
                kind = child.path.to_bytes(8, "little")
                if child.tag not in _NOTHING and (not look or look[-1] != kind):
                    look.append(kind)
                below.append((child, node.path))
        piece()
        own[1].append(b"".join(look))
        todo.extend(reversed(below))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    digest = lambda x: signed(xxhash.xxh64_intdigest(x))
    page = digest(b"\0".join(t for _, _, texts in merged.values() for t in texts))
    return page, [(signed(p), signed(up), digest(b"|".join(look)), [digest(t) for t in texts]) for p, (up, look, texts) in merged.items()]


def noise_of(nodes: list[dict], noise: float = NOISE) -> list[int]:
    """The style nodes of a site that are of low importance with everything below them.

    ``nodes`` are those on enough pages: node, up, look (entropy of child sequences), pieces and
    own (number and importance of its texts), rare (child nodes on too few pages, which are
    important).
    """
    below: dict[int, list[int]] = {}
    by = {x["node"]: x for x in nodes}
    for x in nodes:
        below.setdefault(x["up"] if x["up"] in by else 0, []).append(x["node"])
    order = list(below.get(0, ()))
    for node in order:
        order.extend(below.get(node, ()) if node else ())
    rated: dict[int, tuple[float, bool]] = {}
    for node in reversed(order):
        x = by[node]
        parts = [rated[c] for c in below.get(node, ())] + [(x["own"], x["own"] < noise)] * (x["pieces"] > 0)
        n = len(parts) + x["rare"]
        share = DECAY**n
        importance = (1 - share) * x["look"] + share * (sum(v for v, _ in parts) + x["rare"]) / max(1, n)
        rated[node] = importance, importance < noise and not x["rare"] and all(low for _, low in parts)
    return [node for node, (_, low) in rated.items() if low]


def noise_nodes(pages: DataFrame, least: int = PAGES, noise: float = NOISE) -> DataFrame:
    """(site, nodes): the noise of each site's tree; ``pages`` has site and html.

    Sites of fewer than ``least`` distinct pages come as one, the site ``""``. Equal pages of a
    site count once. Counts are combined before each shuffle, so a host with a third of all pages
    is many small partial counts; of a site only the nodes on ``least`` pages meet in a task.
    """
    schema = pa.schema([("site", pa.string()), *((c, pa.int64()) for c in ("page", "node", "up", "look")), ("own", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            rows = []
            for site, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                page, nodes = style_nodes(html)
                rows += [(site, page, *x) for x in nodes]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, schema.types)], schema=schema)

    rows = map_arrow(pages.where("site is not null and html is not null").select("site", "html"), run, "site string, page long, node long, up long, look long, own array<long>")
    # Of equal pages of a site one stays; which one makes no difference.
    each = stored(rows.groupBy("site", "page", "node").agg(*(F.first(c).alias(c) for c in ("up", "look", "own"))), "style-nodes")
    sizes = each.groupBy("site").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") < least).select("site", F.lit(True).alias("few"))
    sizes = stored(sizes, "small-sites")
    each = each.join(F.broadcast(sizes) if small(sizes, BROADCAST_NODES) else sizes, "site", "left").withColumn("site", F.when(F.col("few"), "").otherwise(F.col("site")))
    kinds = F.concat(F.array(F.struct(F.lit(0).alias("kind"), F.col("look").alias("value"))), F.transform("own", lambda x: F.struct(F.lit(1).alias("kind"), x.alias("value"))))
    # A path has one path above it.
    counts = each.select("site", "node", "up", F.explode(kinds).alias("x")).groupBy("site", "node", "x").agg(F.count("*").alias("n"), F.first("up").alias("up"))
    kind = lambda k, x: F.sum(F.when(F.col("x.kind") == k, x).otherwise(0))
    nodes = counts.groupBy("site", "node").agg(
        F.first("up").alias("up"), kind(0, F.col("n")).alias("m"), kind(0, F.col("n") * F.log("n")).alias("looks"), kind(1, F.lit(1)).alias("pieces"), kind(1, F.log("n")).alias("said")
    )
    often = F.col("m") >= least
    zero = F.lit(0.0)
    look = 1 - F.coalesce(F.col("looks") / F.nullif(F.col("m") * F.log("m"), zero), zero)
    own = 1 - F.coalesce(F.col("said") / F.nullif(F.col("pieces") * F.log("m"), zero), zero)
    listed = F.struct("node", "up", look.alias("look"), F.col("pieces"), own.alias("own"), F.lit(0).alias("rare"))
    # A node on too few pages only adds to the count of the node above it.
    holds = F.struct(F.col("up").alias("node"), F.lit(None).cast("long").alias("up"), zero.alias("look"), F.lit(0).cast("long").alias("pieces"), zero.alias("own"), F.lit(1).alias("rare"))
    marks = nodes.select("site", F.when(often, listed).otherwise(holds).alias("x")).groupBy("site", "x.node").agg(*(F.max(f"x.{c}").alias(c) for c in ("up", "look", "pieces", "own")), F.sum("x.rare").alias("rare"))
    trees = marks.where("up is not null").groupBy("site").agg(F.collect_list(F.struct("node", "up", "look", "pieces", "own", "rare")).alias("nodes"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([noise_of(x, noise) for x in part.column(1).to_pylist()], pa.list_(pa.int64()))], names=["site", "nodes"])

    return map_arrow(trees, cut, "site string, nodes array<long>").where("size(nodes) > 0").withColumn("few", F.lit(False)).unionByName(sizes.select("site", F.lit(None).cast("array<long>").alias("nodes"), "few"))


def extracted(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(every column of ``pages`` but the html, text): the main text of each page.

    Null and empty html gives an empty text; a null or unparsable url makes a page of no site,
    cleaned by its own tags alone; sites of few distinct pages share a tree; columns may have any name; repeated rows are kept; an empty table gives an empty result.
    """
    keep = [c for c in pages.columns if c not in (html, "text")]
    # The other columns travel as one, so that their names can't clash.
    named = pages.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(html).cast("string").alias("html"), F.nullif(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit("")).alias("site"))
    found = stored(noise_nodes(named.select("site", "html")), "noise")
    # Sites without a tree of their own take the common one.
    common = [r["nodes"] for r in found.where("site = '' and not few").select("nodes").collect()]
    own = F.when(F.col("few"), F.lit(common[0] if common else []).cast("array<long>")).otherwise(F.col("nodes"))
    noise = found.where("site <> ''").select("site", own.alias("nodes"))
    few = small(noise, BROADCAST_NODES) and (noise.agg(F.sum(F.size("nodes"))).first()[0] or 0) <= BROADCAST_NODES
    joined = named.join(F.broadcast(noise) if few else noise, "site", "left").select("row", "html", "nodes")
    schema = joined.select("row").withColumn("text", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [main_text(h, frozenset(x & 0xFFFFFFFFFFFFFFFF for x in nodes or ())) for h, nodes in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    return map_arrow(joined, run, schema).select(*(F.col(f"row.`{c}`") for c in keep), "text")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
