"""HTML extraction by wrapper induction.

The DOM trees of a host's pages, with equal siblings folded, are aligned by simple tree matching and merged into
one template tree.  A slot of the template (the text directly in one of its nodes) that holds the same text on
nearly all different pages of the host is template; a slot whose text varies is content.  What page markup
names as no content (navigation, forms, notices, comments and the like) is dropped as well, which also serves
hosts with too few pages to compare.

Merging is associative enough to be done in parts: each task merges the pages it reads, parts are merged in a
bounded fan-in over the cluster.  Slot constancy is counted over all pages with a pre-aggregated group-by.

Defined results: null or empty html gives an empty text; equal pages count once as evidence and get equal
texts; a null url is a host of its own; nesting below ``MAX_DEPTH`` is flattened; empty input, empty output.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.session import materialize

MAX_DEPTH = 200
#: A slot is constant from so many different pages and such a share of equal texts.
MIN_PAGES, CONSTANT_SHARE = 3, 0.9
#: Partial templates merged by one task, and templates of one task held before they are put out.
FAN_IN, HELD_HOSTS = 64, 2000

#: Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object select canvas audio video".split())
DROPPED = frozenset("nav footer aside form button dialog menu head label fieldset".split()) | RAW
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "legend", "summary", "figcaption"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body table ul ol dl div section article main aside nav header footer form".split())
#: Words in class, id or role that name what is no content.
NAMES = frozenset(
    "ad ads advert advertisement adverts adsense banner breadcrumb breadcrumbs byline comment comments cookie cookies consent copyright disqus footer gdpr hidden login masthead menu menubar nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
KEPT_INSIDE = frozenset("p h1 h2 h3 h4 h5 h6 article main html body".split())

_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_WORDS = re.compile(r"[A-Za-z]+")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


class Node:
    __slots__ = ("tag", "label", "names", "items", "slot")

    def __init__(self, tag: str, label: str, names: frozenset):
        self.tag, self.label, self.names, self.items, self.slot = tag, label, names, [], None


def _tag_end(text: str, at: int) -> int:
    """Place of the ``>`` that ends the tag at ``at``, outside of quotes; the end of the text if there is none."""
    quote = ""
    end = text.find(">", at)
    if end < 0:
        return len(text)
    inside = text[at:end]
    if '"' not in inside and "'" not in inside:
        return end
    i = at
    while i < len(text):
        c = text[i]
        if quote:
            if c == quote:
                quote = ""
        elif c == ">":
            return i
        elif c in "\"'" and text[i - 1] == "=":
            quote = c
        i += 1
    return end


def parse(text: str | None) -> Node:
    """The tree of a page; end tags that HTML lets out are filled in."""
    root = Node("#root", "#root", frozenset())
    stack = [root]
    at, size = 0, len(text or "")
    text = text or ""
    while at < size:
        open_ = text.find("<", at)
        if open_ < 0:
            open_ = size
        if open_ > at:
            stack[-1].items.append(text[at:open_])
        if open_ >= size:
            break
        after = text[open_ + 1 : open_ + 2]
        if text.startswith("<!--", open_):
            end = text.find("-->", open_ + 4)
            at = size if end < 0 else end + 3
        elif after in ("!", "?"):
            end = text.find(">", open_)
            at = size if end < 0 else end + 1
        elif after == "/" and _NAME.match(text, open_ + 2):
            tag = _NAME.match(text, open_ + 2).group().lower()
            end = text.find(">", open_)
            at = size if end < 0 else end + 1
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE and tag not in SCOPE:
                    break
        elif m := _NAME.match(text, open_ + 1):
            tag = m.group().lower()
            end = _tag_end(text, m.end())
            at = end + 1
            attributes = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(text[m.end() : end])} if end - m.end() > 5 else {}
            names = frozenset(w.lower() for v in attributes.values() for w in _WORDS.findall(v))
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\b", re.I).search(text, at)
                at = size if close is None else max(text.find(">", close.end()) + 1, close.end())
                continue
            if tag in ENDS_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        del stack[i:]
                        break
                    if stack[i].tag in SCOPE:
                        break
            if tag in SIBLINGS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in SIBLINGS[tag]:
                        del stack[i:]
                        break
                    if stack[i].tag in SCOPE:
                        break
            label = tag + "".join(f".{w}" for w in sorted(attributes.get("class", "").lower().split())[:3]) if attributes else tag
            node = Node(tag, label, names)
            stack[-1].items.append(node)
            if tag not in VOID and not text.startswith("/", end - 1) and len(stack) < MAX_DEPTH:
                stack.append(node)
        else:
            stack[-1].items.append("<")
            at = open_ + 1
    return root


def folded(nodes: list[Node]) -> list:
    """``[label, children]`` of nodes seen as one, with equal siblings folded."""
    groups: dict[str, list[Node]] = {}
    for node in nodes:
        for item in node.items:
            if isinstance(item, Node) and item.tag not in VOID:
                groups.setdefault(item.label, []).append(item)
    return [nodes[0].label, [folded(g) for g in groups.values()]]


def _match(a: list, b: list, memo: dict) -> tuple[int, list]:
    """Simple tree matching: size of the largest top-down, order-keeping match of two trees and its child pairs."""
    if a[0] != b[0]:
        return 0, []
    key = (id(a), id(b))
    if key in memo:
        return memo[key]
    x, y = a[1], b[1]
    if [c[0] for c in x] == [c[0] for c in y]:
        total, pairs = 1 + sum(_match(c, d, memo)[0] for c, d in zip(x, y)), [(i, i) for i in range(len(x))]
    else:
        m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, c in enumerate(x):
            for j, d in enumerate(y):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + (_match(c, d, memo)[0] if c[0] == d[0] else 0))
        i, j, pairs = len(x), len(y), []
        while i and j:
            if m[i][j] == m[i - 1][j]:
                i -= 1
            elif m[i][j] == m[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        pairs.reverse()
        total = 1 + m[-1][-1]
    memo[key] = (total, pairs)
    return memo[key]


def merge(a: list, b: list, memo: dict | None = None) -> list:
    """Both trees in one: matched nodes once, the others at their places."""
    memo = {} if memo is None else memo
    pairs = _match(a, b, memo)[1]
    out, i, j = [], 0, 0
    for p, q in [*pairs, (len(a[1]), len(b[1]))]:
        out += a[1][i:p] + b[1][j:q]
        if p < len(a[1]) and q < len(b[1]):
            out.append(merge(a[1][p], b[1][q], memo))
        i, j = p + 1, q + 1
    return [a[0], out]


def number(tree: list, into: dict | None = None) -> dict[int, int]:
    """Preorder number of each node of a template, by identity."""
    into = {} if into is None else into
    into[id(tree)] = len(into)
    for c in tree[1]:
        number(c, into)
    return into


def assign(nodes: list[Node], shape: list, template: list | None, numbers: dict[int, int], memo: dict) -> None:
    """Sets ``slot`` of every page node to the number of the template node it is aligned with."""
    for n in nodes:
        n.slot = numbers.get(id(template)) if template is not None else None
    groups: dict[str, list[Node]] = {}
    for node in nodes:
        for item in node.items:
            if isinstance(item, Node) and item.tag not in VOID:
                groups.setdefault(item.label, []).append(item)
    to = dict(_match(shape, template, memo)[1]) if template is not None else {}
    for i, g in enumerate(groups.values()):
        assign(g, shape[1][i], template[1][to[i]] if i in to else None, numbers, memo)


def aligned(text: str | None, template: list | None, numbers: dict[int, int]) -> Node:
    root = parse(text)
    if template is not None:
        assign([root], folded([root]), template, numbers, {})
    return root


def _clean(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def slots(root: Node) -> dict[int, list[str]]:
    """The texts directly in each slot, in page order."""
    out: dict[int, list[str]] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        for item in node.items:
            if isinstance(item, Node):
                todo.append(item)
            elif node.slot is not None and (t := _clean(item)):
                out.setdefault(node.slot, []).append(t)
    return out


def _dropped(node: Node, inside: bool) -> bool:
    if node.tag in DROPPED or (node.tag == "header" and not inside):
        return True
    return node.tag not in ("html", "body", "main") and bool(node.names & NAMES)


def _links(node: Node) -> bool:
    """A list of links: three links or more that hold nearly all its text."""
    linked, whole, n = 0, 0, 0
    todo = [(node, False)]
    while todo:
        x, within = todo.pop()
        for item in x.items:
            if isinstance(item, Node):
                n += item.tag == "a"
                todo.append((item, within or item.tag == "a"))
            else:
                size = len(item.strip())
                whole += size
                linked += size * within
    return n >= 3 and linked >= 0.8 * whole


def main_text(root: Node, constant: frozenset[int] = frozenset()) -> str:
    """The content blocks of an aligned page."""
    tops, todo = [], [root]
    while todo:
        node = todo.pop()
        if _dropped(node, False):
            continue
        if node.tag in ("article", "main"):
            tops.append(node)
        else:
            todo += [x for x in reversed(node.items) if isinstance(x, Node)]
    blocks: list[list[str]] = [[]]
    todo = [(x, bool(tops)) for x in reversed(tops or [root])]
    while todo:
        item, inside = todo.pop()
        if item is None:
            blocks.append([])
        elif isinstance(item, str):
            blocks[-1].append(item)
        elif item.tag in ("br", "hr"):
            blocks[-1].append(" ")
        elif _dropped(item, inside) or (item.tag in ("ul", "ol", "div", "table") and _links(item)):
            continue
        else:
            mute = item.slot in constant and not (inside and item.tag in KEPT_INSIDE and not item.names)
            edge = [(None, inside)] if item.tag in BLOCK else []
            todo += edge + [(x, inside) for x in reversed(item.items) if isinstance(x, Node) or not mute] + edge
    return "\n\n".join(t for b in blocks if (t := _clean("".join(b))))


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, list] = {}
    known: set = set()

    def put() -> pd.DataFrame:
        out = pd.DataFrame({"host": list(held), "tree": [json.dumps(t) for t in held.values()]}, dtype=object)
        held.clear()
        known.clear()
        return out

    for batch in batches:
        for h, text in zip(batch["host"], batch["html"]):
            shape = folded([parse(text)])
            code = (h, json.dumps(shape))
            if code in known:
                continue
            held[h] = merge(held[h], shape) if h in held else shape
            if len(known) < HELD_HOSTS:
                known.add(code)
            if len(held) > HELD_HOSTS:
                yield put()
    yield put()


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    trees = [json.loads(t) for t in sorted(set(group["tree"]))]
    out = trees[0]
    for t in trees[1:]:
        out = merge(out, t)
    return pd.DataFrame({"host": [group["host"].iloc[0]], "tree": [json.dumps(out)]})


def templates(pages: DataFrame) -> DataFrame:
    """``host, tree``: the merged template of each host, in two rounds of bounded groups."""
    parts = pages.filter("html IS NOT NULL").mapInPandas(_partial, "host string, tree string").withColumn("part", F.spark_partition_id() % FAN_IN)
    once = parts.groupBy("host", "part").applyInPandas(lambda g: _merged(g), "host string, tree string")
    return materialize(once.groupBy("host").applyInPandas(lambda g: _merged(g), "host string, tree string"))


def _loaded(cache: dict, host_: str, tree: str | None) -> tuple[list | None, dict[int, int]]:
    if tree is None:
        return None, {}
    if host_ not in cache:
        if len(cache) > HELD_HOSTS:
            cache.clear()
        template = json.loads(tree)
        cache[host_] = (template, number(template))
    return cache[host_]


def _slot_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cache: dict = {}
    for batch in batches:
        rows = []
        for h, text, tree in zip(batch["host"], batch["html"], batch["tree"]):
            page = xxhash.xxh64_intdigest(text) >> 1
            for slot, texts in slots(aligned(text, *_loaded(cache, h, tree))).items():
                rows.append((h, slot, xxhash.xxh64_intdigest("\n".join(texts)) >> 1, page))
        yield pd.DataFrame(rows, columns=["host", "slot", "value", "page"])


def constants(pages: DataFrame, trees: DataFrame) -> DataFrame:
    """``host, constant``: the numbers of the slots that hold one text on nearly all different pages of a host."""
    values = pages.filter("html IS NOT NULL").join(trees, "host").select("host", "html", "tree").mapInPandas(_slot_values, "host string, slot int, value long, page long")
    counted = values.distinct().groupBy("host", "slot", "value").agg(F.count(F.lit(1)).alias("n"))
    share = counted.groupBy("host", "slot").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    return share.filter((F.col("n") >= MIN_PAGES) & (F.col("most") >= CONSTANT_SHARE * F.col("n"))).groupBy("host").agg(F.sort_array(F.collect_set("slot")).alias("constant"))


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cache: dict = {}
    for batch in batches:
        found = []
        for h, text, tree, constant in zip(batch["host"], batch["html"], batch["tree"], batch["constant"]):
            found.append(main_text(aligned(text, *_loaded(cache, h, tree)), frozenset(() if constant is None else map(int, constant))))
        yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": found, "n_chars": [len(t) for t in found]})


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    trees = templates(rows.select("host", "html"))
    wrappers = materialize(trees.join(constants(rows, trees), "host", "left"))
    return rows.join(wrappers, "host", "left").mapInPandas(_texts, "page_id long, url string, text string, n_chars long")
