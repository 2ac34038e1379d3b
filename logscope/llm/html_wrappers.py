"""HTML extraction by wrappers: union-free regular expressions inferred from pages of the same host.

A page is read as a stream of tags and texts, balanced by the rules for omitted end tags. The streams of a host's pages are
aligned one after another, element by element: what all have is required, what some lack becomes an *optional* group,
neighbours of one kind fold into a *repeated* group, and texts that differ become a *slot*. No alternatives arise, so
the wrapper is union-free. In it, the content is the deepest main, article or other container that leaves
nothing behind but boilerplate by its tag or class, links and the page's header.

All pages are grouped by host and template, the tags on the way to the content. A wrapper is inferred from all pages of a
template: each task aligns its own, and the wrappers of the tasks are aligned with one another. The path to its content is
followed in each page of the template, first by tag and class, then by tag; where it ends or leaves text of the page behind, the
page's own path is taken. Of the content all text is kept but that in boilerplate elements. Elements on the way to the content
align by their tag, as the template says, and keep the marks they have in common. An element with more than ``KIDS`` children in a wrapper
keeps one repeated group per kind, or if kinds differ from page to page per tag, so that a wrapper does not grow with the pages.

Pages are joined with wrappers by host. That table is small; where it is not, Spark sorts and splits hot hosts.

Defined results: null or empty html gives an empty text; a url without a host shares the host ``''``; repeated rows
each give a row; elements deeper than ``DEPTH`` open and close like others, but their texts and blocks become those of
the element at that depth, without those of boilerplate elements.
"""

from __future__ import annotations

import html
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache, partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.llm import common

#: Children of an element in a wrapper that keep their order.
KIDS, DEPTH = 256, 150
#: Characters of pages whose wrappers a task holds before it hands them on; and groups that join the tasks' wrappers of a template first.
HELD, SHARES = 8 << 20, 64

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template noscript iframe object svg math canvas title textarea select head".split())
#: Of those, what holds text only, up to the end of the page if it has no end tag; and what may close itself.
PLAIN, FOREIGN = set("script style title textarea".split()), {"svg", "math"}
BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: Start tags that end an open element, up to an element that bounds the search.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = set("ul ol dl table body article section main div".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that are themselves text, so that no content element is looked for in them.
CLOSED = HEADINGS | set("header p b i em strong span table ul ol dl pre blockquote figure details address".split())
CHROME = set("nav aside footer form button input menu dialog".split()) | RAW
#: Marks (classes, ids, roles) of boilerplate. Those of ``WEAK`` may also stand at text of an article; they need support.
STRONG = set(
    "ad ads advert advertisement advertising sponsor sponsored cookie cookies consent gdpr popup modal newsletter subscribe signup sidebar "
    "share sharing breadcrumb breadcrumbs navbar navigation pagination pager comment comments disqus respond widget footer masthead".split()
)
WEAK = set("promo banner notice notification alert related social menu skip".split())
#: Words that a mark of boilerplate may be made up of besides; with any other word it is no mark of boilerplate.
PARTS = set(
    "area article articles bar block bottom box button buttons container desktop form google header icon icons inner item items left link links "
    "list main mobile nav outer page panel post posts primary right secondary section site slot top unit wrap wrapper zone".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^<>]*)>|<[/!?a-zA-Z][^<>]*\Z|(?P<text>[^<]+|<)", re.S
)
_KIND = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


_PART = "host string, template string, place long, tree string"


class Node:
    """An element or a text of a page, or of a wrapper."""

    __slots__ = ("name", "key", "kids", "text", "optional", "repeated", "chars", "marked", "spine")

    def __init__(self, name: str, key: str, text: str | None = None, marked: tuple[int, int] = (0, 0)):
        self.name, self.key, self.text, self.kids, self.marked = name, key, text, [], marked
        self.optional = self.repeated = False
        self.spine = False  # on the way to the content
        self.chars = 0  # of a wrapper: text in slots, or of a text that all pages share


def _raw_ends(page: str, name: str) -> dict[int, int]:
    """Where the raw elements of a name end, by where their start tags end; one without an end tag is left out."""
    ends, opened = {}, []
    for m in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+|[^<>]*)>", page, re.I):
        if not m[1]:
            if not (name in FOREIGN and m[2].endswith("/")):
                opened.append(m.end())
        elif opened:
            ends[opened.pop()] = m.end()
    return ends


def parse(page: str) -> Node:
    root = Node("#root", "#root")
    # Each open element's name, where its texts go, and whether it is too deep for a node of its own.
    stack: list[tuple[str, Node, bool]] = [("#root", root, False)]
    places: dict[str, list[int]] = defaultdict(list)
    blocks_open: list[int] = []
    raw_ends: dict[str, dict[int, int]] = {}
    at = 0

    def close(k: int):
        while len(stack) > k:
            name, _, deep = stack.pop()
            places[name].pop()
            if name in BLOCKS:
                blocks_open.pop()
                if deep:
                    stack[-1][1].kids.append(Node(name, name))

    def last(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m["text"]
        inside = stack[-1][1]
        if text is not None:
            before = inside.kids[-1] if inside.kids else None
            if before is not None and before.name == "#text":
                before.text += text
            else:
                inside.kids.append(Node("#text", "#text", text))
            continue
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            if places.get(name):
                close(places[name][-1])
            continue
        rest = m["rest"] or m["rest2"] or ""
        if name in CLOSES:
            k = last(CLOSES[name])
            if k > last(BOUNDS):
                close(k)
        elif name in BLOCKS and blocks_open and stack[blocks_open[-1]][0] == "p":
            close(blocks_open[-1])
        marks = sorted({(w.lower(), kind.lower() == "id") for kind, a, b, c in _KIND.findall(rest) for w in (a or b or c).split()}) if "=" in rest else []
        node = Node(name, " ".join([name, *dict.fromkeys(w for w, _ in marks)]), marked=marked(name, tuple(marks)))
        inside = stack[-1][1]
        inside.kids.append(node)
        if name in PLAIN:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            ended = -1 if end is None else page.find(">", end.start())
            at = len(page) if ended < 0 else ended + 1
        elif name in RAW and name != "head":
            if not (name in FOREIGN and rest.endswith("/")):
                if name not in raw_ends:
                    raw_ends[name] = _raw_ends(page, name)
                at = raw_ends[name].get(at, at)
        elif name not in VOID and not rest.endswith("/"):
            deep = len(stack) >= DEPTH
            if name in BLOCKS:
                blocks_open.append(len(stack))
            places[name].append(len(stack))
            stack.append((name, inside if deep and (max(inside.marked) > 1 or max(node.marked) < 2) else node, deep))
    return root


def mark(word: str) -> int:
    """0 for a mark of text, 1 for one of boilerplate that needs support, 2 for one of boilerplate."""
    parts = [p for p in re.split(r"[_-]+", word) if p and not re.fullmatch(r"\d+(x\d+)?", p)]
    if not all(p in STRONG or p in WEAK or p in PARTS for p in parts):
        return 0
    return 2 if not STRONG.isdisjoint(parts) else 1 if not WEAK.isdisjoint(parts) else 0


@lru_cache(1 << 14)
def marked(name: str, marks: tuple[tuple[str, bool], ...]) -> tuple[int, int]:
    """How an element is marked, outside and inside of the content.

    Headings are text, whatever they are marked with. Ids of sections are often made of their titles; inside they do not count.
    """
    if name in CHROME:
        return 2, 2
    if not marks or name in HEADINGS or name in ("html", "body", "article", "main"):
        return 0, 0
    return max(mark(w) for w, _ in marks), max((mark(w) for w, is_id in marks if not (is_id and name == "section")), default=0)


def linked(node: Node) -> bool:
    """Whether half or more of the text of an element is in links, or it has no text."""
    def sizes(node: Node, link: bool) -> tuple[int, int]:
        if node.name == "#text":
            n = node.chars or len(" ".join(html.unescape(node.text or "").split()))
            return n, n if link else 0
        both = [sizes(k, link or node.name in ("a", "button")) for k in node.kids]
        return sum(n for n, _ in both), sum(n for _, n in both)

    n, links = sizes(node, False)
    return 2 * links >= n


def boilerplate(node: Node, fixed: frozenset[str] = frozenset(), inside: bool = False) -> bool:
    """Whether an element is no text by its tag or marks; a weak mark needs that the host repeats it (``fixed``) or that it is links."""
    level = node.marked[inside]
    return level > 1 or level == 1 and (node.key in fixed or linked(node))


def fixed_keys(wrapper: Node) -> frozenset[str]:
    """The weakly marked elements that have the same text on all pages of a wrapper, if its pages differ at all."""
    same, differ, slots = set(), set(), 0

    def walk(node: Node, optional: bool) -> bool:
        nonlocal slots
        optional = optional or node.optional
        if node.name == "#text":
            slots += node.text is None
            return node.text is not None and not optional
        constant = all([walk(k, optional) for k in node.kids]) and not optional
        if 1 in node.marked:
            (same if constant else differ).add(node.key)
        return constant

    walk(wrapper, False)
    return frozenset(same - differ) if slots else frozenset()


def _alternates(node: Node, one: str, other: str) -> bool:
    """Whether the two kinds take turns among an element's children."""
    keys = [k.key for k in node.kids if k.key in (one, other)]
    return one != "#text" and other != "#text" and len(keys) > 3 and all(a != b for a, b in zip(keys, keys[1:]))


def fold(node: Node) -> Node:
    """A page as a wrapper: neighbours of one kind, or of an alternation of two, fold into repeated groups."""
    out = Node(node.name, node.key, None if node.text is None else " ".join(html.unescape(node.text).split()), node.marked)
    out.spine = node.spine
    if node.name == "#text":
        out.chars = len(out.text)
        return out
    turns: dict[tuple[str, str], bool] = {}

    def alternate(one: str, other: str) -> bool:
        if (one, other) not in turns:
            turns[one, other] = _alternates(node, one, other)
        return turns[one, other]

    for kid in map(fold, node.kids):
        if kid.name == "#text" and not kid.chars:
            continue
        kids = out.kids
        if kids and kids[-1].key == kid.key:
            kids[-1] = merge(kids[-1], kid)
            kids[-1].repeated = True
        elif len(kids) >= 2 and kids[-2].key == kid.key and kids[-1].repeated == kids[-2].repeated and alternate(kid.key, kids[-1].key):
            # The pair before holds this one too; its second half follows and merges likewise.
            kids[-2], kids[-1] = kids[-1], merge(kids[-2], kid)
            kids[-1].repeated = kids[-2].repeated = True
        else:
            kids.append(kid)
    out.chars = sum(k.chars for k in out.kids)
    return out


def merge(a: Node, b: Node) -> Node:
    """The least general wrapper of two of one kind."""
    key = a.key
    if a.key != b.key:
        both = set(b.key.split(" "))
        key = " ".join([a.name, *(w for w in a.key.split(" ")[1:] if w in both)])
    out = Node(a.name, key, marked=tuple(map(min, a.marked, b.marked)))
    out.optional, out.repeated, out.spine = a.optional or b.optional, a.repeated or b.repeated, a.spine or b.spine
    if a.name == "#text":
        out.text = a.text if a.text == b.text else None
        out.chars = a.chars if out.text is not None else a.chars + b.chars
        return out
    x, y = ([k.name + " " if k.spine else k.key for k in n.kids] for n in (a, b))
    if x == y:
        out.kids += map(merge, a.kids, b.kids)
    else:
        for kind, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            if kind == "equal":
                out.kids += map(merge, a.kids[i:j], b.kids[k:m])
            else:
                for kid in a.kids[i:j] + b.kids[k:m]:
                    kid.optional = True
                    out.kids.append(kid)
    if len(out.kids) > KIDS:
        out.kids = gathered(out.kids)
    out.chars = sum(k.chars for k in out.kids)
    return out


def gathered(kids: list[Node]) -> list[Node]:
    """One repeated group per kind of children; where kinds are too many, per tag and mark."""
    for kind in (lambda k: k.key, lambda k: (k.name, k.marked, k.spine)):
        groups: dict = {}
        for kid in kids:
            before = groups.get(kind(kid))
            if before is None:
                groups[kind(kid)] = kid
            else:
                made = groups[kind(kid)] = merge(before, kid)
                made.optional, made.repeated = before.optional and kid.optional, True
        kids = list(groups.values())
        if len(kids) <= KIDS:
            break
    return kids


def packed(node: Node) -> list:
    """A wrapper as nested lists."""
    return [node.name, node.key, node.text, *node.marked, node.optional, node.repeated, node.spine, node.chars, [packed(k) for k in node.kids]]


def unpacked(row: list) -> Node:
    name, key, text, outside, inside, optional, repeated, spine, chars, kids = row
    node = Node(name, key, text, (outside, inside))
    node.optional, node.repeated, node.spine, node.chars, node.kids = optional, repeated, spine, chars, [unpacked(k) for k in kids]
    return node


def written_out(node: Node) -> str:
    """The wrapper as a regular expression over tokens: ``#`` is a slot, ``( )?`` optional, ``( )+`` repeated."""
    if node.name == "#text":
        inner = "#" if node.text is None else node.text
    else:
        inner = f"<{node.key}>" + "".join(map(written_out, node.kids)) + ("" if node.name in VOID else f"</{node.name}>")
    mark = ("+" if node.repeated else "") + ("?" if node.optional else "")
    return f"({inner}){mark}" if mark else inner


def weigh(tree: Node, fixed: frozenset[str] = frozenset()) -> dict[int, int]:
    """By the identity of each element or text that counts, the text in it that is no boilerplate, link or site header."""
    weights: dict[int, int] = {}

    def weight(node: Node, inside: str) -> int:
        if node.name == "#text":
            w = node.chars or len(" ".join(html.unescape(node.text or "").split()))
        elif node.name == "a" or boilerplate(node, fixed):
            w = 0
        elif node.name == "header":
            # Of a header only the headings belong to the text, and none if it is that of the whole page.
            w = 0 if inside in ("#root", "html", "body") else sum(weight(k, node.name) for k in headings(node, fixed))
        else:
            w = sum(weight(k, node.name) for k in node.kids)
        weights[id(node)] = w
        return w

    weight(tree, "")
    return weights


def headings(node: Node, fixed: frozenset[str]) -> list[Node]:
    """The headings in a header."""
    out = []
    for kid in node.kids:
        if kid.name in HEADINGS:
            out.append(kid)
        elif kid.name != "#text" and not boilerplate(kid, fixed):
            out += headings(kid, fixed)
    return out


def content_nodes(tree: Node, fixed: frozenset[str] = frozenset()) -> list[Node]:
    """The elements from the root to the one that holds the content of a page or wrapper.

    That is the deepest main or article that leaves no text behind; without one, the deepest other container.
    """
    weights = weigh(tree, fixed)
    total = weights[id(tree)]
    path, node, named = [], tree, None
    while total:
        kid = next((k for k in node.kids if weights.get(id(k)) == total), None)
        if kid is None or kid.name == "#text" or kid.name in CLOSED:
            break
        path, node = [*path, kid], kid
        if kid.name in ("article", "main"):
            named = path
    return path if named is None else named


def content_path(tree: Node, fixed: frozenset[str] = frozenset()) -> list[str]:
    """The keys of these elements."""
    return [node.key for node in content_nodes(tree, fixed)]


def follow(root: Node, path: list[str], fixed: frozenset[str] = frozenset()) -> list[Node]:
    """The elements at the end of a path, by tag and class where they fit, else by tag."""
    nodes = [root]
    for key in path:
        kids = [k for n in nodes for k in n.kids if k.name != "#text"]
        name = key.split(" ")[0]
        nodes = [k for k in kids if k.key == key] or [k for k in kids if k.name == name and not boilerplate(k, fixed)]
    return nodes


def blocks(nodes: list[Node], fixed: frozenset[str] = frozenset()) -> list[str]:
    """The texts of the blocks of a content, in page order."""
    out: list[str] = []
    inline: list[str] = []

    def close():
        text = " ".join(html.unescape("".join(inline)).split())
        if text:
            out.append(text)
        inline.clear()

    def walk(node: Node, header: bool):
        if node.name == "#text":
            if not header:
                inline.append(node.text)
        elif node.name in ("br", "td", "th", "wbr"):
            inline.append("" if node.name == "wbr" else " ")
            for kid in node.kids:
                walk(kid, header)
        elif not boilerplate(node, fixed, True):
            block = node.name in BLOCKS
            if block:
                close()
            # Of a header only the headings belong to the text.
            inside = node.name == "header" or header and node.name not in HEADINGS
            for kid in node.kids:
                walk(kid, inside)
            if block:
                close()

    for node in nodes:
        close()
        for kid in node.kids:
            walk(kid, False)
    close()
    return out


def template(tree: Node) -> str:
    """The tags on the way to the content of a page: pages of a host that agree in them share a wrapper."""
    return "/".join(key.split(" ")[0] for key in content_path(tree))


def extract(page: str | None, known: dict[str, tuple[list[str], frozenset[str]]] | None) -> str:
    """The text of a page by the wrapper of its template; by its own path, if the wrapper's leaves any of its text behind."""
    if not page:
        return ""
    root = parse(page)
    path, fixed = (known or {}).get(template(root), (None, frozenset()))
    weights = weigh(root, fixed)
    found = [] if path is None else follow(root, path, fixed)
    if not found or sum(weights.get(id(n), 0) for n in found) < weights[id(root)]:
        found = follow(root, content_path(root, fixed), fixed)
    return "\n".join(blocks(found, fixed))


def _sent(held: dict[tuple[str, str], Node], place: int) -> pa.RecordBatch:
    rows = [(*key, place, json.dumps(packed(wrapper))) for key, wrapper in held.items()]
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["host", "template", "place", "tree"])


def _aligned(batches: Iterator[pa.RecordBatch], held_chars: int) -> Iterator[pa.RecordBatch]:
    """The wrapper of the pages of a task, per host and template; several, if those of the task are too many to hold."""
    held, chars, place = {}, 0, TaskContext.get().partitionId() << 33
    for batch in batches:
        for name, page in zip(batch.column("host").to_pylist(), batch.column("html")):
            page = page.as_py()
            if not page:
                continue
            tree = parse(page)
            way = content_nodes(tree)
            for node in way:
                node.spine = True
            key = name, "/".join(node.name for node in way)
            made = fold(tree)
            if key in held:
                held[key] = merge(held[key], made)
                continue
            held[key] = made
            chars += len(page)
            if chars > held_chars:
                yield _sent(held, place)
                held, chars, place = {}, 0, place + 1
    yield _sent(held, place)


def _joined(parts: pa.Table) -> Node:
    """The wrapper of wrappers of one template."""
    parts = parts.sort_by("place")
    wrapper = None
    for tree in parts.column("tree"):
        made = unpacked(json.loads(tree.as_py()))
        wrapper = made if wrapper is None else merge(wrapper, made)
    return wrapper


def _join(parts: pa.Table) -> pa.Table:
    first = parts.sort_by("place").select(["host", "template", "place"])[:1]
    return first.append_column("tree", pa.array([json.dumps(packed(_joined(parts)))]))


def _infer(parts: pa.Table) -> pa.Table:
    """The wrapper of a template of a host, the path to its content and the weakly marked elements it repeats."""
    wrapper = _joined(parts)
    fixed = fixed_keys(wrapper)
    path = content_path(wrapper, fixed)
    return pa.table({
        **{c: parts.column(c)[:1].cast(pa.string()) for c in ("host", "template")},
        "wrapper": [written_out(wrapper)], "path": [json.dumps(path)], "fixed": [json.dumps(sorted(fixed))],
    })


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str | None, dict] = {None: {}}
    for batch in batches:
        texts = []
        for page, found in zip(batch.column("html"), batch.column("wrappers")):
            key = found.as_py()
            if key not in known:
                known[key] = {w["template"]: (json.loads(w["path"]), frozenset(json.loads(w["fixed"]))) for w in json.loads(key)}
            texts.append(extract(page.as_py(), known[key]))
        names = [n for n in batch.schema.names if n not in ("html", "wrappers")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"]
        )


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame, held_chars: int = HELD) -> DataFrame:
    """(host, template, wrapper, path, fixed) of each template of each host of ``pages`` (page_id, url, html); all pages count."""
    parts = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(partial(_aligned, held_chars=held_chars), _PART)
    share = F.pmod(F.shiftright("place", 33), F.lit(SHARES)).alias("share")
    few = parts.groupBy("host", "template", share).applyInArrow(_join, _PART)
    return few.groupBy("host", "template").applyInArrow(_infer, "host string, template string, wrapper string, path string, fixed string")


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (page_id, url, html): the main text, a line per block."""
    of_host = F.to_json(F.collect_list(F.struct("template", "path", "fixed")))
    known = common.written(wrappers(pages).groupBy(F.col("host").alias("_host")).agg(of_host.alias("wrappers")), "wrappers")
    rows = pages.select("page_id", "url", "html")
    joined = rows.join(known, host(F.col("url")) == F.col("_host"), "left").drop("_host")
    page_id = rows.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(_extract, f"page_id {page_id}, url string, text string, n_chars long")


def op7_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
