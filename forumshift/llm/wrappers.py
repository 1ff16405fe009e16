"""Operator 10: main text of web pages by wrapper induction.

Pages of one host share a template.  One page of each host is its reference; every other
page's tree of blocks is aligned with it by simple tree matching (the largest top-down,
order-preserving matching of nodes with equal labels).  Counts of how often a reference
node is met, and met with the same text, are summed over the host's pages: nodes whose
text stays the same are template, varying ones are slots.  A page's text is then read
from its content slots: those of the article element where the page names one, else of
the body.  Menus, headers, footers, side bars, notices, adverts, forms and reader comments
vary from page to page too, so slots under an element that says so (by tag, role, class or
id) are never content.

Copies are no evidence of a template: pages of a host with equal text count as one page,
and inside a named article a page counts for a node only if at least half of the
article's other text differs from the reference's.

Counting is pre-aggregated in each task by host and node, so a host with a third of all
pages adds a few rows per task.  References go to the tasks as a broadcast if their
measured size allows it, else by a join on the host.
"""

from __future__ import annotations

import bisect
import html as entities
import json
import re
import sys
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import LlmQuery
from .common import bounded_batches, process_cache, table, written

BROADCAST_BYTES = 16 << 20
#: a reference node is template if met on so many pages and unchanged on this share of them
LEAST_PAGES, CONSTANT_PCT = 5, 90
#: cells of a table of child lists that is held at once; larger ones are solved by halves
CELLS = 1 << 16
#: levels down to which trees are aligned; deeper blocks are no template, their text is read as any other
ALIGNED_LEVELS = 3000

# fixed values: the public HTML element names by role
RAW = ("script", "style", "title", "textarea", "noscript", "iframe", "template", "svg")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table "
                  "tbody tfoot thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CHROME_TAGS = frozenset("nav footer aside form menu dialog button select option head".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form".split())
CHROME_WORDS = frozenset("nav navbar navigation menu footer sidebar aside ad ads adv advert adverts advertisement advertising "
                         "banner promo sponsor sponsored cookie cookies consent gdpr notice notices popup modal overlay subscribe "
                         "subscription newsletter signup login search comment comments commentlist respond reply replies disqus "
                         "discussion share sharing social related breadcrumb breadcrumbs widget toolbar masthead".split())
HEADER_WORDS = frozenset(("header", "masthead"))
# words that only say where or how an element stands: comment-list is a list of comments, has-sidebar no side bar
PLACE_WORDS = frozenset("area bar block bottom box buttons container content form global group inner item items left links list main "
                        "outer panel posts right row section site slot top unit wrap wrapper".split())
# an open element that a start tag of the same group ends
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCE = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|textarea|noscript|iframe|template|svg)\b(?:[^\"'>]|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<[a-zA-Z][^>]*\Z", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
# what a reader does not see: copies of a page may differ in it
UNSEEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>"
_PARTS = re.compile(r"[a-z0-9]+")


class Node:
    """A block element: its label, its text runs and child blocks in order."""

    __slots__ = ("tag", "label", "items", "chrome", "size", "number", "own", "said", "hidden")

    def __init__(self, tag, label, chrome):
        self.tag, self.label, self.chrome, self.items, self.size, self.number = tag, label, chrome, [], 0, -1
        self.own, self.said, self.hidden = None, False, False

    def children(self):
        return [x for x in self.items if x.__class__ is Node]

    def text(self):
        if self.own is None:
            self.own = " ".join("".join(x if x.__class__ is str else " " for x in self.items).split())
        return self.own


def _says(name: str, words: frozenset) -> bool:
    """Whether a class or id names one of the words, alone or with words of place."""
    parts = {x for x in _PARTS.findall(name) if x.isalpha()}  # not the 300x250 of ad-300x250
    return bool(parts & words) and parts <= words | PLACE_WORDS


def _is_chrome(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool, bool, str]:
    """Chrome by its tag, chrome by its words or role, hidden, and the label.  Words count on
    blocks only: an inline element's class says how a part of a sentence looks."""
    label, chrome, said, hidden = tag, tag in CHROME_TAGS, tag == "header" and not in_article, False
    if attrs and attrs.strip():
        words = ""
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), (values[0] or values[1] or values[2]).lower()
            if name in ("class", "id"):
                words += " " + value
                if tag not in BLOCK or (name == "id" and in_article and (tag in HEADINGS or tag == "section")):
                    continue  # also the target of a link, named by the story
                for x in value.split():
                    said = said or _says(x, CHROME_WORDS) or (not in_article and _says(x, HEADER_WORDS))
            elif name == "role":
                said = said or value in CHROME_ROLES
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (
                    name == "style" and "display:none" in value.replace(" ", "")):
                hidden = True
        if words:
            label += "." + "".join(words.split())
    return chrome, said, hidden, label


def _settle(root: Node) -> None:
    """Marks chrome.  If every article (or main element) of a page is, or stands in, an
    element whose words, role or form tag make it chrome, then these elements are none,
    provided that they hold at least as much text as the rest of the page."""
    free, marked = False, []  # (element, marked elements above it as a linked list: how many, the last, the rest)
    todo: list = [(root, None)]
    while todo:
        n, above = todo.pop()
        if n.hidden or (n.chrome and n.tag != "form"):
            continue
        if n.chrome or n.said:
            above = (above[0] + 1 if above else 1, n, above)
        if n.tag in ("article", "main"):
            free = free or not above
            marked.append((n, above))
        todo.extend((c, above) for c in n.children())

    def each(above):
        while above:
            yield above[1]
            above = above[2]

    def mark(n: Node):
        rest = [n]
        while rest:
            x = rest.pop()
            x.chrome = x.chrome or x.said or x.hidden
            rest.extend(x.children())

    def weight(n: Node):
        return sum(len(x.text()) for x in content_nodes(n))

    one = sum(n.tag == "article" for n, _ in marked) == 1
    marked = [] if free else [(n, above) for n, above in marked if one or not n.said]  # many that say so: readers' comments
    if marked:
        fewest = min(above[0] for _, above in marked)
        cleared = {id(x): x for _, above in marked if above[0] == fewest for x in each(above)}.values()
        before = [(x, x.chrome, x.said) for x in cleared]
        mark(root)
        rest = weight(root)
        for x in cleared:
            x.chrome = x.said = False
        if sum(weight(n) for n, above in marked if above[0] == fewest) < rest:
            for x, chrome, said in before:
                x.chrome, x.said = chrome, said
    mark(root)


def parse(page: str) -> Node:
    """Tree of the blocks of a page; forgiving of unclosed and misplaced tags."""
    root = Node("html", "html", False)
    stack = [("html", root)]  # open elements (also inline ones) and the block they write to
    articles, at = 0, 0
    opened: Counter = Counter()  # open elements by tag

    def close_to(i):
        nonlocal articles
        for tag, node in stack[i:]:
            opened[tag] -= 1
            if node.tag == tag and tag in ("article", "main"):
                articles -= 1
        del stack[i:]

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            t = page[at:m.start()]
            stack[-1][1].items.append(entities.unescape(t) if "&" in t else t)
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            continue
        tag = tag.lower()
        if m.group("end"):
            for i in range(len(stack) - 1 if opened[tag] else 0, 0, -1):
                if stack[i][0] == tag:
                    close_to(i)
                    break
            continue
        if tag in ("html", "body"):
            continue
        block = tag in BLOCK
        if block and tag != "hr":
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[i][0] == "p":
                    close_to(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if tag in ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ENDS[tag]:
                    close_to(i)
                    break
                if stack[i][0] in FENCE[tag]:
                    break
        here = stack[-1][1]
        if tag in VOID:
            if tag in ("br", "hr"):
                here.items.append(" ")
            continue
        chrome, said, hidden, label = _is_chrome(tag, m.group("attrs"), articles > 0)
        if block or chrome or said or hidden:
            node = Node(tag, label, chrome)
            node.said, node.hidden = said, hidden
            here.items.append(node)
            if tag in ("article", "main"):
                articles += 1
        else:
            node = here
            if tag in ("td", "th"):
                here.items.append(" ")
        if not m.group("attrs").rstrip().endswith("/") or block:
            stack.append((tag, node))
            opened[tag] += 1
    if at < len(page):
        t = page[at:]
        stack[-1][1].items.append(entities.unescape(t) if "&" in t else t)
    _settle(root)
    return root


def _flat(root: Node) -> list[Node]:
    """Nodes in page order, numbered."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        n.number = len(out)
        out.append(n)
        todo.extend(reversed(n.children()))
    return out


def _leaf_pairs(xs: list[Node], ys: list[Node]):
    """Leaves of one label: all of the shorter list pair up, and among those matchings the
    one with the most pairs of equal text (texts that either list holds once) is taken.

    With d = place in the longer list minus place in the shorter, a matching is complete if
    d never falls and stays within the difference of the lengths: a longest chain.
    """
    if len(xs) > len(ys):
        return [(u, v) for v, u in _leaf_pairs(ys, xs)]
    spare, place, seen = len(ys) - len(xs), {}, {}
    for j, v in enumerate(ys):
        place[v.text()] = -1 if v.text() in place else j
    for u in xs:
        seen[u.text()] = u.text() in seen
    tops: list[int] = []  # smallest last d of the chains of each length
    ends, back, known = [], {}, []
    for i, u in enumerate(xs):
        j = place.get(u.text(), -1)
        if u.text() and j >= 0 and not seen[u.text()] and 0 <= j - i <= spare:
            k = bisect.bisect_right(tops, j - i)
            tops[k:k + 1], ends[k:k + 1] = [j - i], [i]
            back[i] = (ends[k - 1] if k else -1, j - i)
    i = ends[-1] if ends else -1
    while i >= 0:
        known.append((i, back[i][1]))
        i = back[i][0]
    shift, known, out = 0, known[::-1], []
    for i, u in enumerate(xs):
        if known and known[0][0] == i:
            shift = known.pop(0)[1]
        out.append((u, ys[i + shift]))
    return out


def match(a: Node, b: Node) -> dict[int, int]:
    """Simple tree matching: numbers of a's nodes -> numbers of b's nodes.

    Among the largest matchings those with more nodes of equal text go first.
    """
    memo: dict = {}
    level = [0]
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * ALIGNED_LEVELS))
    one = 1 << 32  # a pair; equal text counts 1

    def alone(x: Node, y: Node) -> int:
        return one + (x.text() == y.text() != "")

    def size(x: Node, y: Node) -> int:
        if x.label != y.label:
            return 0
        if not (x.size and y.size):
            return alone(x, y)
        key = (x.number, y.number)
        if key not in memo:
            if level[0] >= ALIGNED_LEVELS:
                return alone(x, y)
            level[0] += 1
            total = alone(x, y)
            for u, v in aligned(x.children(), y.children()):  # calls of Python functions only: frames are on the heap
                total += size(u, v)
            level[0] -= 1
            memo[key] = total
        return memo[key]

    def aligned(xs: list[Node], ys: list[Node]):
        """Pairs of an order-preserving matching of two lists with the largest sum of sizes."""
        at, n, m = 0, len(xs), len(ys)
        # equal leaves at both ends: no other partner is better
        while at < n and at < m and equal(xs[at], ys[at]):
            at += 1
        while n > at and m > at and equal(xs[n - 1], ys[m - 1]):
            n, m = n - 1, m - 1
        out = [*zip(xs[:at], ys[:at]), *zip(xs[n:], ys[m:])]
        xs, ys = xs[at:n], ys[at:m]
        if not xs or not ys:
            return out
        if not any(x.size for x in xs) and not any(y.size for y in ys) and len({x.label for x in xs} | {y.label for y in ys}) == 1:
            return out + _leaf_pairs(xs, ys)
        return out + table_pairs(xs, ys)

    def equal(x: Node, y: Node) -> bool:
        return not x.size and not y.size and x.label == y.label and x.text() == y.text()

    def sums(xs, ys):
        """Last row of the table of best sums."""
        last = [0] * (len(ys) + 1)
        for u in xs:
            row = [0]
            for j, v in enumerate(ys):
                best = last[j + 1] if last[j + 1] > row[j] else row[j]
                if u.label == v.label:
                    w = last[j] + size(u, v)
                    best = w if w > best else best
                row.append(best)
            last = row
        return last

    def table_pairs(xs, ys):
        if len(xs) > 1 and len(xs) * len(ys) > CELLS:  # halves of the list, so that the memory stays linear
            half = len(xs) // 2
            left, right = sums(xs[:half], ys), sums(xs[half:][::-1], ys[::-1])
            cut = max(range(len(ys) + 1), key=lambda j: left[j] + right[len(ys) - j])
            return table_pairs(xs[:half], ys[:cut]) + table_pairs(xs[half:], ys[cut:])
        m = [[0] * (len(ys) + 1)]
        for u in xs:
            last, row = m[-1], [0]
            for j, v in enumerate(ys):
                best = last[j + 1] if last[j + 1] > row[j] else row[j]
                if u.label == v.label:
                    w = last[j] + size(u, v)
                    best = w if w > best else best
                row.append(best)
            m.append(row)
        out, i, j = [], len(xs), len(ys)
        while i and j:
            if m[i][j] == m[i - 1][j]:
                i -= 1
            elif m[i][j] == m[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((xs[i], ys[j]))
        return out

    pairs, todo = {}, [(a, b, 0)] if a.label == b.label else []
    while todo:
        x, y, depth = todo.pop()
        pairs[x.number] = y.number
        if x.size and y.size and depth < ALIGNED_LEVELS:
            level[0] = depth
            todo.extend((u, v, depth + 1) for u, v in aligned(x.children(), y.children()))
    return pairs


def tree(page: str | None) -> tuple[Node, list[Node]]:
    root = parse(page or "")
    nodes = _flat(root)
    for n in nodes:
        n.size = len(n.children())
    return root, nodes


def encode_reference(page: str) -> str:
    """A reference page as JSON: each node's label, parent and text."""
    root, nodes = tree(page)
    parent = {c.number: n.number for n in nodes for c in n.children()}
    return json.dumps([[n.label, parent.get(n.number, -1), n.text()] for n in nodes], ensure_ascii=False)


def decode_reference(data: str) -> tuple[Node, list[str]]:
    nodes, texts = [], []
    for number, (label, parent, text) in enumerate(json.loads(data)):
        n = Node(label.split(".")[0], label, False)
        n.number, n.own = number, text
        nodes.append(n)
        texts.append(text)
        if parent >= 0:
            nodes[parent].items.append(n)
    for n in nodes:
        n.size = len(n.items)
    return nodes[0], texts


def _reference(data: str):
    kept = process_cache().setdefault("references", {})
    if data not in kept:
        if len(kept) >= 500:
            kept.clear()
        kept[data] = decode_reference(data)
    return kept[data]


def named_content(root: Node) -> list[Node]:
    """The page's article elements, else its main elements, outside chrome."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    for tag, named in found.items():
        todo = [root] if not found["article"] else []
        while todo:
            n = todo.pop()
            if n.chrome:
                continue
            if n.tag == tag:
                named.append(n)
            else:
                todo.extend(reversed(n.children()))
    return found["article"] or found["main"]


def content_nodes(n: Node) -> list[Node]:
    """Nodes with text of their own at and below ``n``, outside chrome."""
    out, todo = [], [n]
    while todo:
        x = todo.pop()
        if not x.chrome:
            if x.text():
                out.append(x)
            todo.extend(x.children())
    return out


def main_text(root: Node, template: frozenset | set = frozenset()) -> str:
    """Text of the content blocks; ``template``: numbers of the page's template nodes."""
    blocks: list[str] = []
    for top in named_content(root) or [root]:
        todo = [] if top.chrome else [(top, 0)]
        while todo:
            n, at = todo.pop()
            run = []
            while at < len(n.items) and (n.items[at].__class__ is str or (n.items[at].chrome and n.items[at].tag not in BLOCK)):
                if n.items[at].__class__ is str:  # what is left out inside a line does not break it
                    run.append(n.items[at])
                at += 1
            if run and n.number not in template:
                t = " ".join("".join(run).split())
                if t:
                    blocks.append(t)
            if at < len(n.items):
                todo.append((n, at + 1))
                if not n.items[at].chrome:
                    todo.append((n.items[at], 0))
    return "\n".join(blocks)


# ---- Spark ---------------------------------------------------------------------------

def _encode(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column("host"), pa.array([encode_reference(x) for x in b.column("html").to_pylist()], pa.string())], names=["host", "ref"])


def _evidence(root: Node, nodes: list[Node], pairs: dict[int, int], texts: list[str]):
    """``(reference node, same text)`` of the pairs that count.  Inside a named article a
    node counts if at least half of the article's other text is not the reference's."""
    inside = {x.number: len(x.text()) for n in named_content(root) for x in content_nodes(n)}
    total = sum(inside.values())
    same = {i for i, j in pairs.items() if nodes[i].text() == texts[j]}
    alike = sum(inside[i] for i in same if i in inside)
    for i, j in pairs.items():
        if i in inside:
            own = inside[i]
            if 2 * (alike - own * (i in same)) > total - own or total == own:
                continue
        if texts[j] or nodes[i].items:
            yield j, i in same


def _compare(batches):
    """Counts (host, node, met, same) of a task's pages, each page with its weight."""
    met: dict = {}
    for b in batches:
        for host, page, weight, ref in zip(*(b.column(c).to_pylist() for c in ("host", "html", "weight", "ref"))):
            ref_root, texts = _reference(ref)
            root, nodes = tree(page)
            for j, same in _evidence(root, nodes, match(root, ref_root), texts):
                c = met.setdefault((host, j), [0.0, 0.0])
                c[0] += weight
                c[1] += weight * same
        if len(met) > 100_000:
            yield _counts(met)
            met = {}
    yield _counts(met)


def _counts(met):
    return pa.RecordBatch.from_arrays(
        [pa.array([h for h, _ in met], pa.string()), pa.array([j for _, j in met], pa.int32()),
         pa.array([c for c, _ in met.values()], pa.float64()), pa.array([s for _, s in met.values()], pa.float64())],
        names=["host", "node", "met", "same"])


def _extract(batches):
    for b in batches:
        out = []
        for page, ref, fixed in zip(*(b.column(c).to_pylist() for c in ("html", "ref", "fixed"))):
            root, _ = tree(page)
            template: set = set()
            if ref is not None and fixed:
                wanted = set(fixed)
                template = {i for i, j in match(root, _reference(ref)[0]).items() if j in wanted}
            out.append(main_text(root, template))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())],
                                         names=["page_id", "url", "text"])


def _with_references(pages: DataFrame, refs: DataFrame) -> DataFrame:
    size = refs.agg(F.sum(F.octet_length("ref"))).first()[0] or 0
    return pages.join(F.broadcast(refs) if size <= BROADCAST_BYTES else refs, "host", "left")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text)`` of each page.

    Character references are decoded, white space inside a block becomes one space, blocks
    are joined by one line feed.  A null, empty or unreadable page has the empty text.
    Pages without a host (null or odd url) share the empty host.  Repeated pages each keep
    their row; other columns are ignored.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    refs = written(base.filter("html <> ''").groupBy("host")
                   .agg(F.min_by("html", F.struct(F.xxhash64("page_id"), F.xxhash64("html"))).alias("html"))
                   .mapInArrow(_encode, "host string, ref string"), "references")
    keyed = base.select("host", "html", F.xxhash64(F.regexp_replace("html", UNSEEN, "")).alias("seen"))
    copies = written(keyed.groupBy("host", "seen").agg(F.count("*").alias("n")).filter("n > 1")
                     .select("host", "seen", (F.lit(1.0) / F.col("n")).alias("weight")), "copies")
    weighed = (keyed.join(F.broadcast(copies) if copies.count() * 100 <= BROADCAST_BYTES else copies, ["host", "seen"], "left")
               .select("host", "html", F.coalesce("weight", F.lit(1.0)).alias("weight")))
    counts = (_with_references(weighed, refs).filter("ref IS NOT NULL")
              .mapInArrow(_compare, "host string, node int, met double, same double")
              .groupBy("host", "node").agg(F.round(F.sum("met"), 6).alias("met"), F.round(F.sum("same"), 6).alias("same")))
    fixed = (counts.filter((F.col("met") >= LEAST_PAGES) & (F.col("same") * 100 >= F.col("met") * CONSTANT_PCT))
             .groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("fixed")))
    wrappers = written(refs.join(fixed, "host", "left"), "wrappers")
    return (_with_references(base, wrappers).select("page_id", "url", "html", "ref", "fixed")
            .mapInArrow(_extract, pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.lit("").alias("text")).schema)
            .withColumnsRenamed({"page_id": id_col, "url": url_col}))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERY = LlmQuery("op10_wrapper_text", query, None)
