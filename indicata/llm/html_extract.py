"""Main text of web pages by wrapper induction.

Pages of a host share a template.  Over all pages of a host, each content of an element
is counted at its path; contents that a share of the pages with that path hold are
constant and make up the host's wrapper.  Every page is then aligned with its host's
wrapper by simple tree matching: what meets a constant node and equals it is template,
the varying slots are content.  Pages that are nearly equal are counted once, and a few
versions of a story make no template: that takes a share of the host's pages.  What a wrapper
can't tell, as reader comments and adverts vary like articles, the names in the markup do:
by element and role, and by a word of class or id where the element doesn't hold the page's text.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicata.llm.common import text_bytes, written

#: a content is constant where this share of the host's pages with its path hold it, and so many pages at least,
#: or all of them where the host has fewer; a path counts where it is on this share of the host's pages.
#: So a wrapper has so many contents a path, and paths, whatever the number of pages
SHARE, LEAST, PATH_SHARE = 0.1, 4, 0.05
#: pages are nearly equal where the longest blocks that make up this share of their text are the same
NEARLY = 0.9
#: elements nested deeper than this are no nodes of the tree: their text and blocks go to the last one within it,
#: and what is no article goes nowhere, as above
DEPTH = 120
#: an element that a word of its class or id names holds the page's text where it has this share of it, and what
#: would be left without it is less than this share of what it has
MOST, REST = 0.5, 0.25
#: a list or a box whose text lies in links by this share is a menu, outside an article
LINK_SHARE = 0.6

# --- fixed values of HTML ---
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "option": ("option",),
}
SCOPES = frozenset("ul ol dl table div section article aside nav header footer main form body html td th blockquote".split())
# --- what no article is: by element, by role, by a word of class or id ---
NEVER = frozenset("head nav footer aside form script style noscript template iframe svg math button select textarea input object embed canvas audio video dialog menu title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
WORDS = frozenset(
    "nav navbar navigation menu header masthead topbar footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo "
    "banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login comment comments "
    "disqus respond replies share sharing social breadcrumb breadcrumbs related recommended recommendations pagination pager widget toolbar skip "
    "copyright legal disclaimer".split())
# an article or main element is none where a class or id of it begins with one of these
CARDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo comment comments disqus reply replies respond related recommended "
    "recommendations newsletter".split())
# reader comments by the first word of a class or id; words before a name that don't make an element one
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
NEGATIONS = frozenset("no not has have with without".split())
ARTICLE = frozenset(("article", "main"))
BOX = frozenset(("div", "section", "ul", "ol", "table", "dl"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """An element.  ``bad``: 0, or no article by a word of its names (1) or by what it is (2).  ``flat``:
    it is nested too deep and shares the children of the one above."""

    __slots__ = ("tag", "signature", "children", "bad", "content", "flat")

    def __init__(self, tag: str, mark: str = "", bad: int = 0):
        self.tag, self.signature, self.children, self.bad, self.content, self.flat = tag, f"{tag}.{mark}" if mark else tag, [], bad, "", False


def _named(tag: str, value: str) -> int:
    """Whether a class or id names what is no article: 1, or 2 for reader comments."""
    worst = 0
    for token in value.split():
        words = [w.lower() for w in _NAME_WORDS.findall(token)]
        if not words or words[0] in NEGATIONS:
            continue
        if words[0] in COMMENTS:
            worst = 2
        elif tag in ARTICLE:  # "promo-card", not "legal-article"
            worst = max(worst, int(words[0] in CARDS))
        elif tag not in ("body", "html"):
            worst = max(worst, int(not WORDS.isdisjoint(words)))
    return worst


def _marked(tag: str, attrs: str) -> tuple[str, int]:
    """What of the attributes tells elements apart, and whether they name something that is no article."""
    mark, bad = "", (1 if tag == "form" else 2) if tag in NEVER else 0
    if attrs.strip():
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name in ("class", "id"):
                mark += f" {value}"
                bad = max(bad, _named(tag, value))
            elif name == "role" and value.lower() in ROLES:
                bad = max(bad, 1 if value.lower() == "form" else 2)
            elif name in ("hidden", "aria-hidden") and (name == "hidden" or value.lower() == "true"):
                bad = 2
    return re.sub(r"\d+", "0", " ".join(mark.split())), bad


def parse(page: str) -> Node:
    """A tree of the page's elements and texts, however broken the markup is."""
    root = Node("#")
    stack, at, low = [root], 0, None
    while True:
        m = _TOKEN.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text:
            stack[-1].children.append(text)
        if not m:
            return root
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    _end(stack, k)
                    break
                if stack[k].tag in ("article", "main", "body") and tag not in ("body", "html", "article", "main"):
                    break  # an end tag without its start doesn't end what it lies in
            continue
        if tag in BLOCK:
            _close(stack, ("p",))
        if tag in CLOSES:
            _close(stack, CLOSES[tag])
        mark, bad = _marked(tag, attrs)
        node = Node(tag, mark, bad)
        deep = len(stack) >= DEPTH and tag not in VOID and tag not in RAW
        if not deep:
            stack[-1].children.append(node)
        if tag in RAW:
            low = page.lower() if low is None or len(low) != len(page) else low
            end = low.find(f"</{tag}", at) if len(low) == len(page) else _raw_end(page, tag, at)
            end = len(page) if end < 0 else end
            close = page.find(">", end)
            at = len(page) if close < 0 else close + 1
        elif tag not in VOID and not attrs.rstrip().endswith("/"):
            if deep and not bad:
                node.flat, node.children = True, stack[-1].children
                _divide(node)
            stack.append(node)


def _divide(node: Node) -> None:
    """The text of a flat block begins, or ends, a block of its own in the element that it shares."""
    if node.flat and node.tag in BLOCK:
        node.children.append(Node("hr"))


def _end(stack: list[Node], k: int) -> None:
    for node in reversed(stack[k:]):
        _divide(node)
    del stack[k:]


def _raw_end(page: str, tag: str, at: int) -> int:
    m = re.compile(f"</{tag}", re.IGNORECASE).search(page, at)
    return m.start() if m else -1


def _close(stack: list[Node], tags: tuple[str, ...]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            _end(stack, k)
            return
        if stack[k].tag in SCOPES and stack[k].tag not in tags:
            return


def settle_names(root: Node) -> Node:
    """``root`` with the elements that only a word names taken for what they hold: the outermost one
    that has most of the page's text, where little would be left without it, is no menu or advert."""
    while True:
        marked: list[tuple[int, Node]] = []

        def measure(node: Node, within: bool) -> tuple[int, int]:
            every = plain = 0
            for child in node.children:
                if isinstance(child, str):
                    n = len(child) - child.count(" ") - child.count("\n")
                    every, plain = every + n, plain + n
                elif child.bad < 2 and child.tag not in RAW and child.tag not in VOID and child.tag != "header":
                    n, m = measure(child, within or child.bad == 1)
                    every, plain = every + n, plain + (0 if child.bad else m)
                    if child.bad and not within:
                        marked.append((n, child))
            return every, plain

        every, plain = measure(root, False)
        size, largest = max(marked, key=lambda x: x[0], default=(0, None))
        if largest is None or size < MOST * every or plain >= REST * size or not size:
            return root
        largest.bad = 0


# ---- wrappers -------------------------------------------------------------
# A skeleton is [signature, members, children]: siblings of one signature are folded into
# one node, so that a list of any length aligns with any other, and their children are
# folded together.  Members are the elements themselves, in a wrapper the contents that
# are constant.  Children are in the order of their signatures, so that matching in
# order finds every pair.

def seal(node: Node) -> Node:
    """``node`` with a hash of its content at each element: "" where it shows no text."""
    content, shown = xxhash.xxh3_64(), False
    for child in node.children:
        if isinstance(child, str):
            text = " ".join(child.split())
            if text:
                content.update(f"{text}\0".encode("utf-8", "replace"))
                shown = True
        elif not child.bad and child.tag not in RAW and child.tag not in VOID:
            seal(child)
            if child.content:
                content.update(f"<{child.signature}\0{child.content}".encode("utf-8", "replace"))
                shown = True
    node.content = content.hexdigest() if shown else ""
    return node


def skeleton(members: list[Node]) -> list:
    kinds: dict[str, list[Node]] = {}
    for node in members:
        for child in node.children:
            if not isinstance(child, str) and not child.bad and child.content:
                kinds.setdefault(child.signature, []).append(child)
    return [members[0].signature, members, [skeleton(kinds[k]) for k in sorted(kinds)]]


def judged(node: Node, in_article: bool) -> bool:
    """Whether an element is dropped where it is constant."""
    return node.tag in BOX or not in_article and node.tag in BLOCK and node.tag not in ("html", "body")


def contents(node: list, in_article: bool = False) -> list:
    """A skeleton with the distinct contents of its judged members for the members."""
    inside = in_article or node[1][0].tag in ARTICLE
    children = [c for c in (contents(x, inside) for x in node[2]) if c[1] or c[2]]
    return [node[0], sorted({m.content for m in node[1] if judged(m, in_article)}), children]


def match(a: list, b: list) -> list[tuple[list, list]]:
    """Pairs of aligned nodes of two skeletons: simple tree matching."""
    return _match(a, b)[1]


def _match(a: list, b: list) -> tuple[int, list[tuple[list, list]]]:
    if a[0] != b[0]:
        return 0, []
    one, two = a[2], b[2]
    sub = [[_match(x, y) if x[0] == y[0] else (0, []) for y in two] for x in one]
    best = [[0] * (len(two) + 1) for _ in range(len(one) + 1)]
    for i in range(len(one)):
        for j in range(len(two)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + sub[i][j][0])
    pairs, i, j = [(a, b)], len(one), len(two)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs += sub[i][j][1]
    return best[-1][-1] + 1, pairs


def held(node: list, path: str = "", out: set[tuple[str, str]] | None = None) -> set[tuple[str, str]]:
    """(path, content) of a skeleton's contents, and (path, "") of the nodes that have any, the root always."""
    out = {("#", "")} if out is None else out
    path = f"{path}\n{node[0]}" if path else node[0]
    if node[1]:
        out.add((path, ""))
        out.update((path, c) for c in node[1])
    for child in node[2]:
        held(child, path, out)
    return out


def wrapper_of(constant: list[tuple[str, str]]) -> list:
    """The skeleton of the constant contents, given with their paths."""
    root: tuple[set, dict] = (set(), {})
    for path, content in constant:
        node = root
        for signature in path.split("\n")[1:]:
            node = node[1].setdefault(signature, (set(), {}))
        node[0].add(content)

    def listed(signature: str, node: tuple[set, dict]) -> list:
        return [signature, sorted(node[0]), [listed(k, node[1][k]) for k in sorted(node[1])]]

    return listed("#", root)


def constant_parts(page: list, wrapper: list | None, few: bool = False) -> set[int]:
    """Ids of the page's elements that meet a node of the wrapper and equal a constant content of it.
    Where the host has only ``few`` pages, an element that holds most of the text is none: these
    may be versions of one story."""
    if not wrapper:
        return set()
    found = [m for x, y in match(page, wrapper) if y[1] for m in x[1] if m.content in y[1]]
    if few and found:
        every = _size(page[1][0])
        found = [m for m in found if _size(m) <= MOST * every]
    return {id(m) for m in found}


def _size(node: Node) -> int:
    """Characters of text, without what is no article."""
    return sum(len(c.strip()) if isinstance(c, str) else 0 if c.bad or c.tag in RAW else _size(c) for c in node.children)


# ---- extraction -----------------------------------------------------------

def _link_share(node: Node) -> float:
    def size(n: Node, linked: bool) -> tuple[int, int]:
        total = in_links = 0
        for c in n.children:
            if isinstance(c, str):
                m = len(c.strip())
                total, in_links = total + m, in_links + m * linked
            elif c.tag not in RAW:
                t, k = size(c, linked or c.tag == "a")
                total, in_links = total + t, in_links + k
        return total, in_links

    total, in_links = size(node, False)
    return in_links / total if total else 0.0


def _articles(node: Node, out: list[Node]) -> None:
    """Outermost article and main elements outside what is no article."""
    for child in node.children:
        if not isinstance(child, str) and not child.bad:
            if child.tag in ARTICLE:
                out.append(child)
            else:
                _articles(child, out)


def _lone(node: Node, template: set[int]) -> set[int]:
    """Constant children of ``node`` whose whole run of neighbours of one signature is constant."""
    runs: list[list[Node]] = []
    for child in node.children:
        if isinstance(child, str) or child.bad or not child.content:
            continue
        if runs and runs[-1][0].signature == child.signature:
            runs[-1].append(child)
        else:
            runs.append([child])
    return {id(c) for run in runs if all(id(c) in template for c in run) for c in run}


def _blocks(node: Node, template: set[int], in_article: bool, out: list[list[str]]) -> None:
    # a constant box is template by itself; a constant paragraph or item among others that vary is text
    lone = _lone(node, template) if template and not in_article else ()
    for child in node.children:
        if isinstance(child, str):
            out[-1].append(child)
            continue
        if child.bad or child.tag in RAW or (child.tag == "header" and not in_article):
            continue
        if child.tag in VOID:
            if child.tag == "br":
                out[-1].append(" ")
            elif child.tag == "hr":
                out.append([])
            continue
        if id(child) in lone or child.tag in BOX and id(child) in template:
            continue
        if child.tag in BOX and not in_article and _link_share(child) >= LINK_SHARE:
            continue
        block = child.tag in BLOCK
        if block:
            out.append([])
        _blocks(child, template, in_article or child.tag in ARTICLE, out)
        if block:
            out.append([])


def extract(page: str, wrapper: list | None = None, few: bool = False) -> str:
    """The main text: one line for each block.

    With a wrapper, all varying slots are text, inside and outside of articles; an article
    only settles that its own headers and link lists belong to it.  Without one, the text
    is that of the articles where the page has any.  ``few``: the wrapper is of less than LEAST pages."""
    if not page:
        return ""
    tree = seal(settle_names(parse(page)))
    template = constant_parts(skeleton([tree]), wrapper, few)
    articles: list[Node] = []
    if wrapper is None:
        _articles(tree, articles)

    def lines(template: set[int]) -> str:
        out: list[list[str]] = [[]]
        for node in articles or [tree]:
            out.append([])
            _blocks(node, template, bool(articles), out)
        joined = (" ".join(html_lib.unescape("".join(b)).split()) for b in out)
        return "\n".join(b for b in joined if b)

    # where all of a page is constant, its host shows copies of one page, not a template
    return lines(template) or lines(set())


def host_of(url):
    """Lower-cased host of a url, without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def nearly(tree: Node) -> str:
    """A key that nearly equal pages share: a hash of the longest blocks that make up NEARLY of the text."""
    blocks: list[list[str]] = [[]]
    _blocks(tree, set(), False, blocks)
    texts = sorted({" ".join("".join(b).split()) for b in blocks}, key=len, reverse=True)
    left, key = NEARLY * sum(map(len, texts)), []
    for text in texts:
        if key and left <= 0 and len(text) < len(key[-1]):
            break
        key.append(text)
        left -= len(text)
    return xxhash.xxh3_128_hexdigest("\n".join(sorted(key)).encode("utf-8", "replace"))


def wrappers(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, wrapper, few) of the hosts that have two pages that aren't nearly equal: the contents
    that at least ``share`` of a host's pages with that path hold, counted over all of them;
    ``few``: of less than LEAST pages."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                trees = [seal(settle_names(parse(t.decode("utf-8", "replace")))) for t in text_bytes(part.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([nearly(t) for t in trees], pa.string()),
                     pa.array([json.dumps(contents(skeleton([t])), separators=(",", ":")) for t in trees], pa.string())], names=["host", "key", "tree"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter((host, *x) for host, tree in zip(*(c.to_pylist() for c in batch.columns)) for x in held(json.loads(tree)))
            columns = [pa.array([x[k] for x in found], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.int64())], names=["host", "path", "content", "n"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [wrapper_of([(x["path"], x["content"]) for x in found or []]) for found in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([json.dumps(t, separators=(",", ":")) for t in trees], pa.string()), batch.column(1)], names=["host", "wrapper", "few"])

    seen = pages.select(host_of(F.col("url")).alias("host"), "html").filter("host is not null and html is not null").mapInArrow(
        shapes, "host string, key string, tree string")
    distinct = seen.groupBy("host", "key").agg(F.min("tree").alias("tree")).select("host", "tree")
    # summed in each task first; a content that one page holds is no row here
    counted = written(distinct.mapInArrow(counts, "host string, path string, content string, n long").groupBy("host", "path", "content").agg(
        F.sum("n").alias("n")).filter("content = '' or n >= 2"), "counted")
    totals = counted.filter("content = ''")
    hosts = totals.filter((F.col("path") == "#") & (F.col("n") >= 2)).select("host", F.col("n").alias("_pages"))
    paths = totals.join(hosts, "host").filter(F.col("n") >= PATH_SHARE * F.col("_pages")).select("host", "path", F.col("n").alias("_of"), "_pages")
    many = (F.col("n") >= LEAST) & (F.col("n") >= share * F.col("_of"))
    constant = counted.filter("content != ''").join(paths, ["host", "path"]).filter(many | (F.col("n") == F.col("_pages"))).groupBy("host").agg(
        F.collect_list(F.struct("path", "content")).alias("found"))
    return hosts.join(constant, "host", "left").select("host", (F.col("_pages") < LEAST).alias("few"), "found").mapInArrow(
        made, "host string, wrapper string, few boolean")


def main_text(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html; others are left aside): page_id, url,
    text, n_chars.

    A null or empty html has the empty text.  A page without a host, or whose host shows one
    page or nearly equal ones, is judged by its own markup.  Rows that repeat an id are taken each by
    itself, and equal pages have equal texts; nothing depends on an order, so ties don't arise.  An empty
    table gives an empty one.  A page of any length and nesting is read whole.  Columns of other
    names are left aside, whatever they are called."""
    # a row for each host, written so that Spark knows its size before it chooses the join
    known = written(wrappers(pages, share), "wrappers")
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host_of(F.col("url")).alias("_host"))
    joined = rows.join(known, F.col("_host") == F.col("host"), "left").select("page_id", "url", "html", "wrapper", "few")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, list] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = []
                for raw, own, few in zip(text_bytes(part.column(2)), part.column(3).to_pylist(), part.column(4).to_pylist()):
                    if own is not None and own not in parsed:
                        if len(parsed) > 1000:
                            parsed.clear()
                        parsed[own] = json.loads(own)
                    texts.append(extract(raw.decode("utf-8", "replace"), parsed.get(own), bool(few)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
