"""Main text of web pages by equivalence classes of template tokens.

Tokens of a page are its tags, told apart by their path of open elements, and
its text nodes, told apart by path and content. A token's occurrence vector
says how often it stands on each page of a host; it is kept as a fingerprint
that is combined by exclusive or, so no host's pages ever meet in one task.
Tokens of one host with the same vector are an equivalence class. Classes that
hold tags and several tokens, and of which it is certain enough that they stand
on most of the host's pages, are the template: their tags once a page nest as
containers, their text nodes are boilerplate, and what varies between them are
the slots. The innermost container that holds most of the slots' text is the
host's content; its slots are extracted, less elements that are no part of an
article by their kind, role or class, such as menus, adverts or comments.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, map_arrow, materialize
from .flat import mix

#: Share of a host's pages that a template token exceeds, with the confidence of so many standard errors; share of the slots' text that a content container holds.
SHARE, CERTAIN, HOLDS = 0.5, 1.96, 0.8
#: Tokens that a task holds before it hands on their sums.
HELD = 100_000
EVERY = "*"

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mi mn mo mrow msub msup mfrac msqrt mroot mtext".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = {"p": ("button", "table", "td", "th", "article", "div", "section"), "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Elements and roles of areas beside the article.
BESIDE = frozenset("nav aside form footer button select dialog menu head svg".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
#: A container is beside the article if a class consists of these words, and words that only say where or how.
CONTAINERS = frozenset("div section ul ol dl table iframe header span p".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar "
    "related recommended recommendations widget widgets share sharing social footer cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe "
    "subscription signup login comment comments commentlist disqus respond replies".split()
)
NEUTRAL = frozenset("the site page top bottom left right inner outer main box bar area wrapper container block list item items section links form post posts js".split())
#: A comment's or declaration's begin, or a tag: slash, name, rest up to its end, the end unless the page ends before. Possessive, so linear in time; a quoted value is a whole, a quote elsewhere, or that nothing closes, a character as any other.
TAG = re.compile(r"""<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(>?+))""")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)""", re.I)
DIGITS = re.compile(r"\d+")
CLOSING = {t: re.compile(rf"</{t}\s*+>", re.I) for t in RAW}
_MASK = (1 << 64) - 1


class Node:
    """An element: its parent, its path as a hash, how deep it is, whether it is beside the article or in a link, and the characters of text under it.

    ``state``: 2 in an article element, 1 in a main element, else 0; ``inner``:
    within one, so that no content container begins here. ``inside``: within
    the content container.
    """

    __slots__ = ("parent", "tag", "path", "depth", "beside", "link", "state", "inner", "chars", "inside")

    def __init__(self, parent: Node | None, tag: str, path: int, depth: int, beside: bool, link: bool, state: int, inner: bool):
        self.parent, self.tag, self.path, self.depth, self.beside, self.link, self.state, self.inner = parent, tag, path, depth, beside, link, state, inner
        self.chars, self.inside = 0, False


def _hash(x: str) -> int:
    """A 64-bit hash of a string that is the same in every process."""
    return xxhash.xxh3_64_intdigest(x.encode(errors="replace"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str | None]]]:
    """The elements of a page in order, the first being the page; and its texts (element, decoded text), None where a block begins or ends.

    Contents of scripts, styles and the like are left out. Time and memory are
    linear in the page, whatever it consists of.
    """
    top = Node(None, "", 0, 0, False, False, 0, False)
    nodes, events, stack = [top], [], [top]
    opened: dict[str, list[int]] = {}  # where the open elements of each tag are, so that no search walks through the others
    at = text = 0
    size, search, unescape = len(page), TAG.search, html.unescape

    def cut(k: int) -> Node:
        while len(stack) > k:
            opened[stack.pop().tag].pop()
        return stack[-1]

    def last(tags: tuple[str, ...]) -> int:
        out = 0
        for t in tags:
            x = opened.get(t)
            if x and x[-1] > out:
                out = x[-1]
        return out

    while True:
        m = search(page, at)
        begin = m.start() if m else size
        if begin > text:
            what = page[text:begin]
            if "&" in what:
                what = unescape(what)
            if not top.beside and not top.link and not what.isspace():
                top.chars += len(what)
            events.append((top, what))
        if not m:
            break
        comment, other, slash, tag, rest, end = m.groups()
        at = text = m.end()
        if tag is None:
            stop = page.find("-->" if comment else ">", at)
            if stop < 0:
                break
            at = text = stop + (3 if comment else 1)
            continue
        if not end:
            break  # a tag that never ends
        tag = tag.lower()
        block = tag not in INLINE
        if block:
            events.append((top, None))
        if slash:
            x = opened.get(tag)
            if x:
                top = cut(x[-1])
            continue
        if tag in CLOSES_P and opened.get("p"):
            k = opened["p"][-1]
            if k > last(STOPS["p"]):
                top = cut(k)
        if tag in SAME:
            k = last(SAME[tag])
            if k > last(STOPS[tag]):
                top = cut(k)
        label, classes, names = tag, (), {}
        if rest and not rest.isspace():
            names = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)}
            classes = names.get("class", "").split()
            if classes:
                label = DIGITS.sub("0", f"{tag}.{classes[0]}")
        above = top.state
        state = 2 if tag == "article" else above or (1 if tag == "main" else 0)
        beside = tag != "main" and (top.beside or _beside(tag, names, classes, state))
        node = Node(top, tag, _signed(_hash(f"{top.path} {label}")), top.depth + 1, beside, top.link or tag == "a", state, above == 2 or (above == 1 and tag != "article"))
        nodes.append(node)
        if tag in RAW:
            close = CLOSING[tag].search(page, at)
            at = text = close.end() if close else size
        elif tag not in VOID and not rest.endswith("/"):
            opened.setdefault(tag, []).append(len(stack))
            stack.append(node)
            top = node
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
    return nodes, events


def _beside(tag: str, names: dict[str, str], classes: list[str], state: int) -> bool:
    """No part of an article by its kind, its role, or a name all of whose words say so. Outside of articles an id counts as a class does."""
    if tag in BESIDE or (tag == "header" and not state):
        return True
    if not names:
        return False
    if names.get("role", "").lower() in ROLES:
        return True
    if tag not in CONTAINERS:
        return False
    return any(_named(x) for x in [*classes, *([names["id"]] if not state and names.get("id") and tag != "p" else [])])


def _named(name: str) -> bool:
    words = [w for w in re.split(r"[\s_\-]+", name.lower()) if w and not w.isdigit()]
    return bool(words) and all(w in WORDS or w in NEUTRAL for w in words) and any(w in WORDS for w in words)


def _tokens(page: str) -> dict[tuple[int, int], list[int]]:
    """(path, 0 or hash of the text) -> times, characters of slots' text under it, depth, whether no container begins there."""
    nodes, events = parse(page)
    out: dict[tuple[int, int], list[int]] = {}
    for node in nodes:
        x = out.setdefault((node.path, 0), [0, 0, node.depth, int(node.inner)])
        x[0] += 1
        x[1] += node.chars
    for node, what in events:
        if what and not what.isspace():
            out.setdefault((node.path, _text_token(node.path, what)), [0, 0, 0, 0])[0] += 1
    return out


def _text_token(path: int, what: str) -> int:
    return _signed(_hash(f"{path}\n{' '.join(what.split())}") or 1)


def _counts(pages: DataFrame) -> DataFrame:
    """host, path, token (0: the tag, else the text's hash), vector (fingerprint), times, pages, chars, depth, inner; tags for all hosts together as well."""
    names = ["host", "path", "token", "vector", "times", "pages", "chars", "depth", "inner"]
    types = (pa.string(), *[pa.int64()] * 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], list[int]] = {}
        row = TaskContext.get().partitionId() << 36

        def flush() -> pa.RecordBatch:
            cols = list(zip(*[(*k, _signed(v[0]), *v[1:]) for k, v in held.items()], strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row += 1
                own = int(mix(np.array([row], np.uint64))[0])
                for (path, token), (times, chars, depth, inner) in _tokens(page.as_py()).items():
                    seen = own * (2 * times - 1) & _MASK
                    for h in (host,) if token else (host, EVERY):
                        x = held.setdefault((h, path, token), [0, 0, 0, 0, depth, inner])
                        x[0] ^= seen
                        x[1] += times
                        x[2] += 1
                        x[3] += chars
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()

    raw = map_arrow(pages.select("host", "html"), run, "host string, path bigint, token bigint, vector bigint, times bigint, pages bigint, chars bigint, depth bigint, inner bigint")
    return raw.groupBy("host", "path", "token").agg(F.bit_xor("vector").alias("vector"), *[F.sum(c).alias(c) for c in ("times", "pages", "chars")], *[F.max(c).alias(c) for c in ("depth", "inner")])


def certain_share(k: Column, n: Column, z: float = CERTAIN) -> Column:
    """Lower bound of the share that k of n pages are evidence of (Wilson). The same rule at every number of pages; it exceeds one half from four pages of four on."""
    p = k / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def templates(pages: DataFrame) -> DataFrame:
    """A row for each host with a template and for all hosts (``*``): host, root (path of the content), fixed (hashes of the template's text nodes), n (pages).

    Roots are chosen by aggregates over containers. A host's list ``fixed`` is
    bounded by a page: all of it stands on most of the host's pages.
    """
    counts = materialize(_counts(pages), "web-counts")
    whole = (F.col("path") == 0) & (F.col("token") == 0)
    total = counts.groupBy("host").agg(F.max(F.when(whole, F.col("pages"))).alias("all"), F.max(F.when(whole, F.col("chars"))).alias("text"), F.count_if(F.col("pages") > 1).alias("n"))
    total = materialize(total, "web-hosts")
    known = join_hot(counts.where("pages > 1"), total.where("n > 0"), ["host"], ["path", "token"]).drop("n")
    frequent = materialize(known.where(certain_share(F.col("pages"), F.col("all")) >= SHARE), "web-frequent")
    classes = frequent.groupBy("host", "vector").agg(F.count_if(F.col("token") == 0).alias("tags"), F.count("*").alias("n")).where("tags > 0 and n > 1")  # a valid class is large and holds tags
    member = materialize(join_hot(frequent, materialize(classes, "web-classes"), ["host", "vector"], ["path", "token"]).drop("n", "tags"), "web-template")
    fixed = member.where("token <> 0").groupBy("host").agg(F.collect_list("token").alias("fixed"))
    holds = F.col("chars") >= HOLDS * F.col("text") * F.col("pages") / F.col("all")
    inside = member.where("token = 0 and path <> 0 and times = pages and inner = 0 and text > 0").where(holds)
    roots = inside.groupBy("host").agg(F.max(F.struct("depth", "chars", "path"))["path"].alias("root"))
    out = materialize(total.select("host", F.col("all").alias("n")).join(roots, "host", "left").join(fixed, "host", "left"), "web-templates")
    for old in (counts, frequent, member):
        discard(old)
    return out


def main_text(page: str, roots: tuple[int, ...], fixed: frozenset[int]) -> str:
    """Text of the slots within the content container: the first of ``roots`` that this page has, else its article or main element, else its body.

    Text nodes of the template are left out, unless nothing else is there.
    """
    nodes, events = parse(page)
    have = {node.path for node in nodes if not node.beside}
    root = next((r for r in roots if r in have), 0)
    if not root:
        named = [node for node in nodes if node.tag in ("article", "main") and not node.beside and not node.inner]
        articles = [node for node in named if node.tag == "article"]
        root = (articles if len(articles) == 1 else named)[0].path if named else 0
    for node in nodes:
        node.inside = node.path == root or (node.parent is not None and node.parent.inside)
    every: list[str] = []
    slots: list[str] = []
    for node, what in events:
        if what is None:
            every.append("\0")
            slots.append("\0")
        elif node.inside and not node.beside:
            what = what.replace("\0", " ")
            every.append(what)
            if not fixed or what.isspace() or _text_token(node.path, what) not in fixed:
                slots.append(what)
    return _joined(slots) or _joined(every)


def _joined(parts: list[str]) -> str:
    return " ".join(x for part in "".join(parts).split("\0") if (x := " ".join(part.split())))


def extract(pages: DataFrame) -> DataFrame:
    """Main text of pages (page_id, url, html): page_id, url, text, n_chars, host.

    A null html is an empty page, with empty text; a null url or one without a
    host has the host ''. Repeated rows each give a row; an empty table gives
    none; other columns are not read. A page of any length is worked whole, in
    linear time. Where a host has too few pages for a template of its own, the
    containers of all hosts together count.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    own = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), host.alias("host"))
    found = templates(own)
    every = found.where(F.col("host") == EVERY).select("root").first()  # one row
    common = every["root"] if every and every["root"] is not None else 0
    joined = join_hot(own, found.where(F.col("host") != EVERY), ["host"], ["page_id", "url"], how="left")
    page, url = (own.schema[c].dataType.simpleString() for c in ("page_id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, frozenset()
        for batch in batches:
            text = []
            for h, page_html, root, fixed in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), batch.column(5), strict=True):
                if h != last:
                    last, kept = h, frozenset(fixed.as_py() or ())
                text.append(main_text(page_html.as_py(), tuple(r for r in (root, common) if r), kept))
            size = pa.array([len(x) for x in text], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), size, batch.column(2)], names=["page_id", "url", "text", "n_chars", "host"])

    return map_arrow(joined.select("page_id", "url", "host", "html", "root", "fixed"), run, f"page_id {page}, url {url}, text string, n_chars bigint, host string")
