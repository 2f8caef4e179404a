"""HTML extraction by wrapper induction.

A page becomes a DOM tree; its skeleton keeps tags and classes, runs of siblings of one shape collapsed. The skeletons of a host's pages
are aligned by simple tree matching (most common first; unmatched nodes are added to the host's template). Aligned nodes of all pages
form a slot. A text that stands in the same slot of many pages of a host is constant: template, which goes; slots whose texts vary
are content. Pages of a host count once for each distinct content, so copies of an article do not make it look like template. The content is
the set of texts of the kind that is wanted of the page (marked article, else what is not labelled), so menus, adverts and other labelled parts may differ.

What varies is not always article: nodes in navigation, page headers and footers, asides, forms, notices, adverts and reader comments
(told by tag, role, class or id) and blocks that are mostly links are left out in any case. Where a page marks its article (article or main),
only that is content, and a text in it counts as template only if practically all of many pages have it.

Hosts are never gathered: distinct skeletons per host are counted first, texts of a slot are counted with map-side sums, and pages
themselves do not move if the table of template texts is small enough to broadcast (its size is checked; else it is joined).

Null or empty html gives an empty text. Rows are kept one for one; repeated and null keys too. A null or odd URL belongs to the empty host.
Only key, URL and html are read, so other columns cannot clash.
"""
from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpoint
from .url_filter import host

# HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math canvas object textarea title select".split())
REST = frozenset("script style title textarea".split())  # unclosed, they take the rest of the page
BLOCK = frozenset("html body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main header footer nav aside form fieldset blockquote pre figure figcaption address details summary hr menu dialog center".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSED_IN = frozenset("ul ol dl table div section article main body nav aside form".split())
ASIDE = frozenset("nav footer aside form menu dialog button head".split())
# Words of class, id and role that mark what is not article.
NOT_ARTICLE = frozenset("ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promotion banner cookie cookies consent notice notices gdpr popup modal newsletter subscribe subscription share sharing social sidebar widget widgets related recommended recommendations comment comments commentlist respond disqus replies breadcrumb breadcrumbs menu nav navbar navigation topbar masthead footer pager pagination login signup search toolbar alert contentinfo complementary dialog form".split())
HEADER = frozenset("header banner masthead topbar".split())

OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
MARK = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+)|([^\s=\"'/]+)")
WORD = re.compile(r"[a-z0-9]+")

LABELLED, MAIN, PLAIN = range(3)
DEEP = 150  # elements nested deeper have their texts read, but are not in the skeleton


def text_hash(t: str) -> int:
    return int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little", signed=True)


class Node:
    __slots__ = ("tag", "label", "children", "kind", "shape", "path", "parent")

    def __init__(self, label, tag, kind, parent):
        self.tag, self.label, self.kind, self.parent, self.children, self.shape, self.path = tag, label, kind, parent, [], None, None


def attributes(source: str) -> dict:
    return {(m[1] or m[3]).lower(): entities.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(source)} if source.strip(" /") else {}


class Tags:
    """The tags, comments and declarations of a page, each found once from left to right: (start, end, slash, name, attributes); name is empty for what is no tag.

    A quote opens a value only after an equals sign, and only if it is closed later; a tag whose quotes swallow all that follows ends at its first `>`, and from then on
    quotes are not regarded. So every step moves on, however odd the page."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def end_of(self, at: int) -> int:
        page, p = self.page, at
        while self.quotes:
            m = MARK.search(page, p)
            if not m:
                self.quotes = False
                break
            c, p = m.group(), m.end()
            if c == ">":
                return p
            if page[at:m.start()].rstrip()[-1:] == "=" if m.start() - at < 200 else page[m.start() - 1] == "=":
                if self.last[c] >= p:
                    p = page.find(c, p) + 1
        return page.find(">", at) + 1

    def __iter__(self):
        page, at = self.page, 0
        while True:
            at = page.find("<", at)
            if at < 0:
                return
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4) + 3
                end = end if end > 2 else len(page)
                yield at, end, "", "", ""
                at = end
                continue
            if at > self.last[">"]:  # no tag can end any more
                return
            m = OPENING.match(page, at)
            if m:
                end = self.end_of(m.end())
                jump = yield at, end, m[1], m[2], page[m.end():end - 1]
                at = max(end, jump or 0)
            elif page[at + 1:at + 2] in ("!", "?"):
                end = page.find(">", at) + 1
                yield at, end, "", "", ""
                at = end
            else:
                at += 1


def parse(page: str) -> tuple[Node, list]:
    """The tree and its text blocks [node, pieces, characters in links]; unclosed and crossing tags are mended."""
    root = Node("html", "html", PLAIN, None)
    stack, blocks, at, links = [root], [], 0, 0
    fresh = True

    def text(t):
        nonlocal fresh
        if not t:
            return
        if "&" in t:
            t = entities.unescape(t)
        if stack[-1].kind == LABELLED and stack[-1].tag not in BLOCK and next(n for n in reversed(stack) if n.tag in BLOCK).kind != LABELLED:
            return  # a button or another labelled inline element inside a block
        if fresh:
            if t.isspace():
                return
            node = next(n for n in reversed(stack) if n.tag in BLOCK)
            blocks.append([node, [], 0])
            fresh = False
        blocks[-1][1].append(t)
        if links:
            blocks[-1][2] += len(t)

    def close(k):
        nonlocal fresh, links
        for n in stack[k:]:
            links -= n.tag == "a"
            fresh = fresh or n.tag in BLOCK
        del stack[k:]

    tags, jump, unclosed = iter(Tags(page)), None, set()
    while True:
        try:
            start, end, slash, name, source = tags.send(jump)
        except StopIteration:
            text(page[at:])
            return root, blocks
        jump = None
        text(page[at:start])
        at = end
        if not name:
            continue
        tag = name.lower()
        if slash:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if k:
                close(k)
            fresh = fresh or tag in BLOCK
            continue
        if tag in ("html", "body"):
            continue
        if tag in RAW:
            if tag in ("svg", "math") and source.endswith("/"):
                continue
            end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end:
                at = jump = end.end()
            elif tag in REST:
                at = jump = len(page)
            else:  # never closed: only its start tag goes
                unclosed.add(tag)
            continue
        if tag in BLOCK and stack[-1].tag != "html":
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in BLOCK), 0)
            if stack[k].tag == "p":
                close(k)
            elif tag in CLOSES:
                k = len(stack) - 1
                while k > 0 and stack[k].tag not in CLOSED_IN and not (stack[k].tag in CLOSES[tag] and stack[k - 1].tag not in CLOSES[tag]):
                    k -= 1
                if stack[k].tag in CLOSES[tag]:
                    close(k)
        if tag in BLOCK:
            fresh = True
        if tag in VOID:
            if tag == "br":
                if not fresh:
                    blocks[-1][1].append(" ")
            continue
        has = attributes(source) if source else {}
        names = set(WORD.findall(f"{has.get('class', '')} {has.get('id', '')} {has.get('role', '')}".lower())) if has else set()
        up = stack[-1]
        opens = tag in ("article", "main") or "main" in names and tag == "div"
        own = set(f"{has.get('class', '')} {has.get('id', '')} {has.get('role', '')}".lower().split()) if opens else names  # of a marked article only whole words count: `long-form` is none
        marked = tag in ASIDE or bool(own & NOT_ARTICLE) or "hidden" in has or has.get("aria-hidden") == "true" or "display:none" in has.get("style", "").replace(" ", "")
        marked = marked or up.kind != MAIN and not opens and (tag == "header" or bool(names & HEADER))
        kind = LABELLED if marked or up.kind == LABELLED else MAIN if opens or up.kind == MAIN else PLAIN
        label = re.sub(r"[\s()]", "_", ".".join([tag, *sorted(has.get("class", "").split())]))
        node = Node(label, tag, kind, up)
        if len(stack) < DEEP:
            up.children.append(node)
        stack.append(node)
        links += tag == "a"


def shape(node: Node) -> str:
    """The skeleton below a node, runs of siblings of one shape collapsed."""
    out = []
    for c in node.children:
        if c.tag in BLOCK or c.tag == "a":
            s = shape(c)
            if not out or out[-1] != s:
                out.append(s)
    node.shape = node.label + (f"({' '.join(out)})" if out else "")
    return node.shape


def paths(root: Node) -> None:
    """The number of each node in its skeleton, in page order."""
    counter = [0]

    def walk(nodes):
        """nodes: all page nodes that one skeleton node stands for."""
        for n in nodes:
            n.path = counter[0]
        counter[0] += 1
        groups = []
        for n in nodes[:1]:
            for c in n.children:
                if c.shape is None:
                    continue
                if groups and groups[-1][0].shape == c.shape:
                    groups[-1].append(c)
                else:
                    groups.append([c])
        rest = []
        for n in nodes[1:]:
            k = -1
            for c in n.children:
                if c.shape is None:
                    continue
                if k < 0 or groups[k][0].shape != c.shape:
                    k += 1
                rest.append((k, c))
        for k, c in rest:
            groups[k].append(c)
        for g in groups:
            walk(g)
    walk([root])


def blocks_of(page: str) -> tuple[str, list[tuple[int, int, str]]]:
    """Skeleton, and (skeleton node, kind, text) of every text block in page order."""
    root, blocks = parse(page)
    skeleton = shape(root)
    paths(root)
    out = []
    for node, pieces, linked in blocks:
        t = " ".join("".join(pieces).split())
        if t:
            kind = node.kind
            while node.path is None:  # inside an inline element, or nested too deep for the skeleton
                node = node.parent
            if kind == PLAIN and 2 * linked > len(t):
                kind = LABELLED
            out.append((node.path, kind, t))
    return skeleton, out


# -- simple tree matching ----------------------------------------------------------
def tree(skeleton: str) -> list:
    """[label, children] of a skeleton string, numbered in page order."""
    root, stack, number = None, [], 0
    for m in re.finditer(r"([^\s()]+)|(\()|(\))", skeleton):
        if m[1]:
            node = [m[1], [], number]
            number += 1
            if stack:
                stack[-1][1].append(node)
            root, last = root or node, node
        elif m[2]:
            stack.append(last)
        else:
            last = stack.pop()
    return root


def match(a: list, b: list, memo: dict) -> tuple[int, tuple]:
    """The largest number of pairs of nodes with equal labels that keeps ancestors and order, and the matched pairs of children."""
    if a[0] != b[0]:
        return 0, ()
    key = (id(a), id(b))
    if key in memo:
        return memo[key]
    # children whose label the other node's children lack have no pair; without them a wide template costs no more than the page
    labels = {c[0] for c in b[1]}
    left = [i for i, c in enumerate(a[1]) if c[0] in labels]
    labels = {a[1][i][0] for i in left}
    right = [j for j, c in enumerate(b[1]) if c[0] in labels]
    m, n = len(left), len(right)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        row, above = best[i], best[i - 1]
        for j in range(1, n + 1):
            row[j] = max(above[j], row[j - 1], above[j - 1] + match(a[1][left[i - 1]], b[1][right[j - 1]], memo)[0])
    pairs, i, j = [], m, n
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((left[i], right[j]))
    memo[key] = 1 + best[m][n], tuple(reversed(pairs))
    return memo[key]


class Template:
    """Aligned skeletons of one host; every node is a slot."""

    def __init__(self):
        self.root, self.slots = None, 0

    def _slot(self, node):
        new = [node[0], [], self.slots]
        self.slots += 1
        new[1] = [self._slot(c) for c in node[1]]
        return new

    def align(self, skeleton: str, extend: bool) -> list[int]:
        """The slot of each skeleton node (-1: none, if the template is not extended)."""
        page = tree(skeleton)
        if self.root is None:
            self.root = self._slot(page)
        memo, out = {}, {}

        def walk(t, p):
            out[p[2]] = t[2]
            done = dict((j, i) for i, j in match(t, p, memo)[1])
            shift, last = 0, -1
            for j, c in enumerate(p[1]):
                if j in done:
                    last = done[j] + shift
                    walk(t[1][last], c)
                elif extend:
                    new = self._slot(c)
                    shift, last = shift + 1, last + 1
                    t[1].insert(last, new)
                    fill(new, c)

        def fill(t, p):
            out[p[2]] = t[2]
            for x, y in zip(t[1], p[1]):
                fill(x, y)
        if self.root[0] == page[0]:
            walk(self.root, page)
        return [out.get(k, -1) for k in range(1 + max(n[2] for n in _every(page)))]


def _every(node):
    yield node
    for c in node[1]:
        yield from _every(c)


# -- jobs --------------------------------------------------------------------------
def page_blocks(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """key, url, host, skeleton, nodes, kinds, texts, hashes of each page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                got = [blocks_of(h) if h else ("html", []) for h in part.column(3).to_pylist()]
                lists = [pa.array([[f(x) for x in blocks] for _, blocks in got], t) for f, t in (
                    (lambda x: x[0], pa.list_(pa.int32())), (lambda x: x[1], pa.list_(pa.int32())), (lambda x: x[2], pa.list_(pa.string())), (lambda x: text_hash(x[2]), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([s for s, _ in got]), *lists], ["key", "url", "host", "skeleton", "nodes", "kinds", "texts", "hashes"])
    return pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host(F.col(url)).alias("host"), F.col(html).alias("html")).mapInArrow(
        run, f"key {kind}, url string, host string, skeleton string, nodes array<int>, kinds array<int>, texts array<string>, hashes array<bigint>")


def aligned(skeletons: DataFrame) -> DataFrame:
    """host, skeleton, slots of distinct (host, skeleton, n): most common first, each is aligned and adds its unmatched nodes to the host's template.
    Slots keep their numbers, so earlier skeletons need no second alignment. Rows of a host stream by; only its template is held."""
    def run(batches):
        at, template = None, None
        for b in batches:
            out = []
            for h, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if h != at:
                    at, template = h, Template()
                out.append(template.align(s, True))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], ["host", "skeleton", "slots"])
    return skeletons.repartition("host").sortWithinPartitions("host", F.col("n").desc(), "skeleton").select("host", "skeleton").mapInArrow(run, "host string, skeleton string, slots array<int>")


def wanted_kind() -> Column:
    """The kind of a page's blocks that are content."""
    return F.when(F.array_contains("kinds", MAIN), MAIN).otherwise(PLAIN)


def template_texts(blocks: DataFrame, share: float, least: int, main_share: float, main_least: int) -> DataFrame:
    """host, skeleton, drops: (node, hash) of the constant texts of aligned slots."""
    lean = checkpoint(blocks.select("host", F.xxhash64("skeleton").alias("sk"), "skeleton", "nodes", "kinds", "hashes"))
    skeletons = lean.groupBy("host", "skeleton").agg(F.count("*").alias("n"), F.first("sk").alias("sk"))
    slots = checkpoint(aligned(skeletons.select("host", "skeleton", "n")).select("host", F.xxhash64("skeleton").alias("sk"), "slots"))
    # a page counts once for each distinct content; one page stands for all that have it
    want = wanted_kind()
    content = F.array_sort(F.array_distinct(F.transform(F.filter(F.arrays_zip("kinds", "hashes"), lambda b: b["kinds"] == want), lambda b: b["hashes"])))
    once = lean.groupBy("host", F.xxhash64(content).alias("content")).agg(F.min(F.struct("sk", "nodes", "kinds", "hashes")).alias("one")).select("host", "one.*")
    each = once.select("host", "sk", F.explode(F.array_distinct(F.arrays_zip("nodes", "kinds", "hashes"))).alias("b")).filter(F.col("b.kinds") != LABELLED)
    each = each.groupBy("host", "sk", F.col("b.nodes").alias("node"), F.col("b.kinds").alias("kind"), F.col("b.hashes").alias("hash")).agg(F.count("*").alias("n"))
    total = once.groupBy("host", "sk").agg(F.count("*").alias("pages"))
    have = slots.join(total, ["host", "sk"]).select("host", F.posexplode("slots").alias("node", "slot"), "pages").filter("slot >= 0").groupBy("host", "slot").agg(F.sum("pages").alias("pages"))
    in_slot = each.join(slots, ["host", "sk"]).select("host", "sk", "node", "kind", "hash", "n", F.element_at("slots", F.col("node") + 1).alias("slot")).filter("slot >= 0")
    common = in_slot.groupBy("host", "slot", "hash").agg(F.sum("n").alias("n"), F.max("kind").alias("kind"), F.min("kind").alias("inside")).join(have, ["host", "slot"])
    inside = F.col("inside") == MAIN
    constant = common.filter((inside & (F.col("n") >= main_least) & (F.col("n") >= main_share * F.col("pages"))) | (~inside & (F.col("n") >= least) & (F.col("n") >= share * F.col("pages")))).select("host", "slot", "hash")
    # for every skeleton, also those of pages that another one stands for
    of_skeleton = slots.select("host", "sk", F.posexplode("slots").alias("node", "slot")).filter("slot >= 0")
    return of_skeleton.join(constant, ["host", "slot"]).groupBy("host", "sk").agg(F.collect_set(F.struct("node", "hash")).alias("drops"))


SMALL = 200_000  # (host, skeleton) rows with template texts that are broadcast; more are joined by a shuffle


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", share: float = 0.5, least: int = 3, main_share: float = 0.95, main_least: int = 10) -> DataFrame:
    """key, url, text: blocks in page order, joined by two newlines."""
    blocks = page_blocks(pages, key, url, html)
    drops = checkpoint(template_texts(blocks, share, least, main_share, main_least))
    drops = drops.select(F.col("host").alias("h"), F.col("sk").alias("s"), "drops")
    size = drops.agg(F.count("*"), F.sum(F.size("drops"))).first()
    drops = F.broadcast(drops) if size[0] <= SMALL and (size[1] or 0) <= 4 * SMALL else drops
    out = blocks.join(drops, (F.col("host") == F.col("h")) & (F.xxhash64("skeleton") == F.col("s")), "left")
    want = wanted_kind()
    keep = F.filter(F.arrays_zip("nodes", "kinds", "texts", "hashes"), lambda b: (b["kinds"] == want) & ~F.coalesce(F.array_contains("drops", F.struct(b["nodes"].alias("node"), b["hashes"].alias("hash"))), F.lit(False)))
    return out.select(F.col("key").alias(key), F.col("url").alias(url), F.array_join(F.transform(keep, lambda b: b["texts"]), "\n\n").alias("text"))
