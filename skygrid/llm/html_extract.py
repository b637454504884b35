"""Main text of web pages by site template removal.

A page is parsed into a tree.  The subtree of each container is hashed, tags and text, and counted per host over the pages
that differ in their body; a subtree that recurs on many pages of its host is part of the site's template and goes.  What
pages state about themselves goes as well: navigation, headers, footers, asides, forms and scripts by their element or
role, notices, adverts, comments and the like by class or id, but for wrappers of the page's content.  The text comes from the article or main element if there is one,
otherwise from the body.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygrid.llm.common import cut, small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math canvas object select noframes xmp".split())
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption "
    "address hr details summary center nav header footer aside form fieldset legend hgroup dialog menu search".split()
)
GONE = frozenset("nav footer aside form header menu dialog button search head input".split()) | RAW
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = BLOCK - HEADINGS - frozenset("html body article main p hr pre blockquote td th tr tbody thead tfoot caption figcaption li dt dd".split())
TEXT_BLOCKS = BLOCK - frozenset("html body article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
COMMENTS = frozenset("comment comments commentlist commentary reply replies respond responses discussion disqus".split())
MARKS = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored sponsors banner banners promo promos promotion promoted cookie cookies "
    "consent gdpr notice notices notification notifications alert alerts popup popups modal overlay newsletter subscribe subscription signup share sharing "
    "shares social related recommended recommendations sidebar sidebars menu menus nav navbar navigation navigator breadcrumb breadcrumbs footer footers "
    "header masthead topbar toolbar widget widgets pagination pager copyright disclaimer login search skip".split()
)
#: First words of a class that states what an element has or lacks, not what it is: has-sidebar, no-header.
STATES = frozenset("has have no not with without".split())
#: What an opening tag closes before it opens: tag -> (tags closed, tags that stop the search).
_LIST, _CELL = frozenset(("ul", "ol", "menu")), frozenset(("table",))
CLOSES = {
    "li": (frozenset(("li",)), _LIST),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), _CELL),
    "td": (frozenset(("td", "th")), _CELL | {"tr"}),
    "th": (frozenset(("td", "th")), _CELL | {"tr"}),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?|[^<]++|<", re.S
)
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    """An element: tag, whether it goes by its own marks and only by a class or id, and children, nodes or texts."""

    __slots__ = ("tag", "gone", "aside", "classed", "children")

    def __init__(self, tag: str, gone: bool = False, aside: bool = False, classed: bool = False) -> None:
        self.tag, self.gone, self.aside, self.classed, self.children = tag, gone, aside, classed, []


def _marked(tag: str, attrs: str) -> tuple[bool, bool, bool]:
    """Whether an element goes by its attributes, whether it is a reader comment, and whether only class or id say so."""
    gone = aside = classed = False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            parts = (_SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1-\2", part).lower()) for part in value.split())
            words = {w for part in parts if part[0] not in STATES for w in part}
            aside |= not COMMENTS.isdisjoint(words)
            classed |= not MARKS.isdisjoint(words)
        elif name == "role":
            gone |= value.lower() in ROLES
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            gone = True
        elif name == "style":
            gone |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
    return gone or classed, aside, classed and not gone


def _keep_wrappers(root: Node) -> None:
    """Let elements that go by class or id alone stay where they hold the page's content.

    An element stays that holds main.  While neither main, article nor half of the page's text stands outside such elements, one
    with more than half of the text stays, after it those that hold an article; reader comments don't.  What stays has its own
    parts judged in turn.
    """
    # For each node: main elements, articles and characters of text in it; main elements and articles, and characters, in no such element inside it.
    facts: dict[int, tuple[int, int, int, int, int]] = {}
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and (not c.gone or c.classed)]
    for node in reversed(order):
        mains, articles, chars, content, free = int(node.tag == "main"), int(node.tag == "article"), 0, int(node.tag in ("main", "article")), 0
        for c in node.children:
            if isinstance(c, str):
                n = len("".join(c.split()))
                chars, free = chars + n, free + n
            elif id(c) in facts:
                m, a, n, o, f = facts[id(c)]
                mains, articles, chars = mains + m, articles + a, chars + n
                if not c.gone:
                    content, free = content + o, free + f
        facts[id(node)] = mains, articles, chars, content, free

    def within(node: Node) -> list[Node]:
        found, todo = [], [c for c in node.children if isinstance(c, Node)]
        while todo:
            c = todo.pop()
            if c.gone and c.classed:
                found.append(c)
            elif not c.gone:
                todo += [x for x in c.children if isinstance(x, Node)]
        return found

    _, _, total, content, free = facts[id(root)]
    open_ = within(root)
    while open_:
        stay = [x for x in open_ if facts[id(x)][0]]
        if not stay and not content and 2 * free <= total:
            stay = [x for x in open_ if not x.aside and 2 * facts[id(x)][2] > total] or [x for x in open_ if not x.aside and facts[id(x)][1]]
        if not stay:
            return
        for x in stay:
            x.gone = False
            content, free = content + facts[id(x)][3], free + facts[id(x)][4]
        kept = {id(x) for x in stay}
        open_ = [x for x in open_ if id(x) not in kept] + [y for x in stay for y in within(x)]


def parse(page: str) -> Node:
    """The tree of a page; unclosed, misnested and stray tags are put right roughly as browsers do."""
    root = Node("html")
    stack, at, n, wrappers = [root], 0, len(page), False
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        token = m[0]
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if token[0] != "<" or token == "<":
                stack[-1].children.append(html.unescape(token) if "&" in token else token)
            continue
        if m[1] or m[4]:
            _close(stack, tag)
            continue
        attrs = m[3] if m[2] else m[6]
        if tag in ("html", "body", "head"):
            if tag == "head":
                stack.append(Node(tag, True))
                stack[-2].children.append(stack[-1])
            elif tag == "body":
                del stack[1:]
            continue
        if tag in BLOCK:
            _close_p(stack)
        if tag in CLOSES:
            closed, stops = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closed:
                    del stack[k:]
                    if tag != "tr":
                        break
                if k < len(stack) and stack[k].tag in stops:
                    break
        gone, aside, classed = _marked(tag, attrs) if attrs and attrs != "/" else (False, False, False)
        node = Node(tag, tag in GONE or (gone and tag not in ("article", "main")), aside, classed and tag not in GONE and tag not in ("article", "main"))
        if node.tag == "header" and not gone and any(x.tag == "article" for x in stack):
            node.gone = False
        if node.aside and tag == "article":
            node.gone = True
        stack[-1].children.append(node)
        if node.classed:
            wrappers = True
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
        elif tag not in VOID and attrs.endswith("/") and tag in BLOCK:
            stack.append(node)
    if wrappers:
        _keep_wrappers(root)
    return root


def _close_p(stack: list[Node]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == "p":
            del stack[k:]
            return
        if stack[k].tag in BLOCK:
            return


def _close(stack: list[Node], tag: str) -> None:
    if tag in ("html", "body"):
        return
    headings = tag in HEADINGS
    for k in range(len(stack) - 1, 0, -1):
        own = stack[k].tag
        if own == tag or (headings and own in HEADINGS):
            del stack[k:]
            return
        if tag not in BLOCK and tag != "head" and own in BLOCK:
            return


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def subtree_hashes(root: Node) -> dict[int, int]:
    """Hash of the subtree of each container with text, by id() of its node, and of the root at key 0."""
    out: dict[int, int] = {}
    hashes: dict[int, str] = {}
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        parts = [" ".join(c.split()) if isinstance(c, str) else hashes.pop(id(c)) for c in node.children]
        parts = [p for p in parts if p]
        h = _digest(node.tag + "\x01" + "\x02".join(parts))
        hashes[id(node)] = f"\x03{h:x}" if parts else ""
        if parts and node.tag in CONTAINERS and not node.gone:
            out[id(node)] = h
    out[0] = _digest(hashes[id(root)])
    return out


def _roots(root: Node, skip: set[int]) -> list[Node]:
    """The outermost articles with text, within main if there is one; otherwise main; otherwise the root."""

    def outermost(within: list[Node], tag: str) -> list[Node]:
        found, todo = [], within[::-1]
        while todo:
            node = todo.pop()
            if node.gone or id(node) in skip:
                continue
            if node.tag == tag:
                found.append(node)
            else:
                todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        return [x for x in found if blocks([x], skip)]

    mains = outermost([root], "main")
    return outermost(mains or [root], "article") or mains or [root]


def blocks(roots: list[Node], skip: set[int]) -> list[str]:
    """The texts of blocks in page order, white space as one space; nodes that go or are in ``skip`` are left out."""
    out: list[str] = []
    own: list[str] = []

    def end() -> None:
        text = " ".join("".join(own).split())
        own.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = list(roots[::-1])
    while todo:
        node = todo.pop()
        if node is None:
            end()
        elif isinstance(node, str):
            own.append(node)
        elif node.tag == "br":
            own.append(" ")
        elif node.gone or id(node) in skip:
            if node.tag in BLOCK:
                end()
        else:
            if node.tag in BLOCK:
                end()
                todo.append(None)
            todo += node.children[::-1]
    end()
    return out


def main_text(page: str | None, template: frozenset[int] = frozenset()) -> str:
    """The main text of a page, given the hashes of its host's template; null or empty pages give an empty text."""
    root = parse(page or "")
    skip: set[int] = set()
    if template:
        skip = {k for k, h in subtree_hashes(root).items() if k and h in template}
    return "\n\n".join(blocks(_roots(root, skip), skip))


def host_of(url: Column) -> Column:
    """The lower-case host of an address, without user and port; empty for a null one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _subtrees(pages: DataFrame) -> DataFrame:
    """(host, a, b, hash, body): each different subtree of each page of ``pages`` (host, html, a, b), and the hash of its body."""
    small_batches(pages.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, bodies = [], [], []
            for k, page in enumerate(batch.column(1).to_pylist()):
                found = subtree_hashes(parse(page or ""))
                body = found.pop(0)
                own = set(found.values())
                rows += [k] * len(own)
                hashes += own
                bodies += [body] * len(own)
            at = pa.array(rows, pa.int64())
            columns = [batch.column(0).take(at), batch.column(2).take(at), batch.column(3).take(at), pa.array(hashes, pa.int64()), pa.array(bodies, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["host", "a", "b", "hash", "body"])

    return pages.select("host", "html", "a", "b").mapInArrow(run, "host string, a long, b long, hash long, body long")


def _keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, host and html of ``pages``, and a 128-bit hash (a, b) of html."""
    own = pages.select(F.col("page_id"), F.col("url"), host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    return own.withColumns({"a": F.xxhash64("html"), "b": F.xxhash64(F.lit(1), "html")})


def site_templates(pages: DataFrame, *, min_pages: int = 5) -> DataFrame:
    """(host, hash): subtrees on at least ``min_pages`` different pages of a host, however many it has.

    ``pages`` has page_id, url and html.  Pages of one host with the same body count once, so copies of a page are no template.
    """
    return _templates(_subtrees(_keyed(pages)), min_pages)


def _templates(seen: DataFrame, min_pages: int) -> DataFrame:
    counts = seen.select("host", "hash", "body").distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_pages).select("host", "hash")


def extract(pages: DataFrame, *, min_pages: int = 5, max_shared: int = 100_000) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text, a null url belongs to the host without a name.  Rows that repeat an id are taken each
    for itself; other columns are not looked at; an empty table gives no rows.  Pages are parsed once for their subtrees and once
    for their text.  Templates go to all tasks while they are at most ``max_shared`` hashes; beyond that a page is joined with
    those of its own subtrees that are template.
    """
    spark = pages.sparkSession
    keyed = _keyed(pages)
    seen = _subtrees(keyed)
    templates = cut(_templates(seen, min_pages))
    own = keyed.drop("a", "b")
    by_host: dict[str, set[int]] = {}
    joins = templates.limit(max_shared + 1).count() > max_shared
    if joins:
        lists = seen.join(templates, ["host", "hash"]).groupBy("host", "a", "b").agg(F.collect_set("hash").alias("hashes"))
        own = keyed.join(lists, ["host", "a", "b"], "left").select("page_id", "url", "host", "html", "hashes")
    else:
        for r in templates.collect():  # max_shared rows at most
            by_host.setdefault(r["host"], set()).add(r["hash"])
    shared = spark.sparkContext.broadcast({k: frozenset(v) for k, v in by_host.items()})
    small_batches(spark, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, htmls = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            if joins:
                sets = [frozenset(x or ()) for x in batch.column(4).to_pylist()]
            else:
                sets = [shared.value.get(h, frozenset()) for h in hosts]
            texts = [main_text(p, s) for p, s in zip(htmls, sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    fields = {f.name: f for f in own.schema.fields}
    schema = f"page_id {fields['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return own.mapInArrow(run, schema)
