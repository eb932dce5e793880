"""Main text of web pages by wrapper induction over the pages of a host.

Every page becomes a tree of labelled nodes. Each host has one reference page, that of the smallest hash, and every page of the host is
aligned with it by simple tree matching (the largest order-preserving match of equally labelled nodes; of equal ones that with more equal
texts); a matched node with the same text is constant there. Counts by host and node (labels on its path, hash of its text) are
added up over the whole host, so a host of any size is never gathered and the result does not depend on how pages lie. Copies of a page count
once. Nodes constant in ``SHARE`` or more of a host's different pages, if it has ``LEAST`` or more, are its template and leave the
text; varying slots are content.

The template cannot tell what varies and still is not content (menus of related pages, adverts, comments). So parts that pages
mark as such leave as well: by element (scripts, styles, menus, forms, asides, page headers and footers) and by the names in
class, id and role, taken as whole words or as such a word with a plain one behind a hyphen (share-bar); html, body, main and article never
leave by name. If a page has an article (or else a main) element, its content lies in there.

A text block ends where a block element starts or ends. Character references are decoded, white space becomes one space, and blocks
are joined by line feeds. Open or crossed tags are closed as browsers do for paragraphs, list items and table parts.

Null and empty html give the empty text; a null url is the host "". Rows with null or repeated page_id give one
result row each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchloom.llm.common import look_up, materialize

SHARE = 0.8
LEAST = 8
#: Up to so many hosts with a template (some kB each at most) are broadcast; more are joined by shuffle.
BROADCAST_HOSTS = 20_000
#: Reference pages of so many bytes together are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: A host's counts leave a task when it holds so many.
HELD = 200_000
#: Cells of a table of the match that are kept whole; a larger table is halved along its rows.
CELLS = 1 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("script style noscript template head title nav footer aside form button iframe svg select textarea object canvas audio video dialog menu".split())
MARKED = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo search alert".split())
#: What may follow one of these names behind a hyphen or underscore.
PLAIN = frozenset("area bar block bottom box button buttons container inner item items left link links list panel right section slot top unit widget wrap wrapper".split())
NEVER = frozenset("#root html body main article".split())
#: A start of the key ends an open element of the values, unless a boundary element lies in between.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDARY = frozenset("ul ol dl table article section div body html main nav aside footer header td th li".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(script|style|textarea|title|noscript)\b[^>]*>.*?(?:</\1\s*>|$)|</([a-zA-Z][^\s>/]*)[^>]*>|<([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S | re.I)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[-_]+")


class Node:
    """An element: its tag, the words that name it, whether it is dropped, text pieces and children in order."""

    __slots__ = ("children", "dropped", "items", "label", "parent", "path", "shape", "tag", "text")

    def __init__(self, tag, names, parent):
        self.tag, self.parent, self.items, self.children, self.text, self.shape = tag, parent, [], [], 0, 0
        self.label = hash64(tag + "." + names)
        self.path = hash64(f"{parent.path if parent else 0}/{self.label}")
        self.dropped = tag in DROPPED or (tag not in NEVER and any(map(named, names.lower().split())))


def named(word: str) -> bool:
    """Whether a word of class, id or role marks what is not content."""
    first, *rest = [p for p in _PART.split(word) if p] or [""]
    return first in MARKED and PLAIN.issuperset(rest)


def hash64(s: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s) >> 1


def tree(html: str | None) -> Node:
    """The tree of a page; raw-text elements are left out."""
    root = at = Node("#root", "", None)
    for m in _TOKEN.finditer(html or ""):
        raw, end, start, attributes, text = m.groups()
        if text is not None:
            at.items.append(text)
        elif end:
            tag, node = end.lower(), at
            while node.parent and node.tag != tag:
                if node.tag in BOUNDARY and tag not in BOUNDARY:
                    break
                node = node.parent
            if node.tag == tag and node.parent:
                at = node.parent
        elif start:
            tag = start.lower()
            closes, node = CLOSES.get(tag, {"p"} if tag in BLOCK else ()), at
            while closes and node.parent:
                if node.tag in closes:
                    at = node.parent
                    break
                if node.tag in BOUNDARY:
                    break
                node = node.parent
            names = " ".join(x for g in _NAMES.findall(attributes) for x in g if x) if attributes and "=" in attributes else ""
            node = Node(tag, names, at)
            at.items.append(node)
            at.children.append(node)
            if tag not in VOID and not attributes.endswith("/"):
                at = node
    order = [root]
    for node in order:
        own = " ".join("".join(x for x in node.items if isinstance(x, str)).split())
        node.text = hash64(own) if own else 0
        order += node.children
    for node in reversed(order):
        node.shape = hash64(f"{node.label}:{[c.shape for c in node.children]}") if node.children else node.label
    return root


def key(node: Node) -> int:
    """A node as the template knows it: the labels on its path and its own text."""
    return hash64(f"{node.path}:{node.text}")


def matched(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of the largest order-preserving match of two trees with equal root labels (simple tree matching)."""
    sizes: dict[tuple[int, int], int] = {}
    pairs, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        if x.children and y.children:
            _measure(x, y, sizes)
            stack += _chosen(x.children, y.children, sizes)
    return pairs


def _measure(a: Node, b: Node, sizes: dict) -> None:
    """Sizes of the match, by shapes, of all pairs of children below two nodes that can meet; without recursion, as pages may be deep."""
    stack = [(a, b, False)]
    while stack:
        x, y, ready = stack.pop()
        if (x.shape, y.shape) in sizes and (x, y) != (a, b):
            continue
        if not ready:
            stack.append((x, y, True))
            left, right = ({c.shape: c for c in n.children} for n in (x, y))
            stack += [(c, d, False) for c in left.values() for d in right.values() if c.label == d.label and (c.shape, d.shape) not in sizes]
        elif not x.children or not y.children:
            sizes[x.shape, y.shape] = 1
        elif (x, y) != (a, b):
            sizes[x.shape, y.shape] = 1 + int(_scores(x.children, _gains(x.children, y.children, sizes, False))[-1])


def _gains(left: list[Node], right: list[Node], sizes: dict, texts: bool):
    """A function of a left node that gives what it gains with each right node: 0 for other labels; with texts, equal texts break ties."""
    shapes = {d.shape: i for i, d in enumerate(right)}
    place = {s: i for i, s in enumerate(shapes)}
    of = np.array([place[d.shape] for d in right])
    kinds = [right[i] for i in shapes.values()]
    own = np.array([d.text for d in right], np.int64)
    scale = len(left) + len(right) + 1 if texts else 1
    rows: dict[int, np.ndarray] = {}

    def gain(c: Node) -> np.ndarray:
        if c.shape not in rows:
            rows[c.shape] = scale * np.array([sizes[c.shape, d.shape] if c.label == d.label else 0 for d in kinds], np.int64)[of]
        row = rows[c.shape]
        return row + ((own == c.text) & (row > 0)) if texts and c.text else row

    return gain


def _scores(left: list[Node], gain, backward: bool = False, keep: bool = False):
    """Best sums over left and each number of first right nodes (last ones if backward); with keep, after each left node as well."""
    best, table = None, []
    for c in reversed(left) if backward else left:
        row = gain(c)[::-1] if backward else gain(c)
        if best is None:
            best = np.zeros(len(row) + 1, np.int64)
            table.append(best)
        now = best.copy()
        np.maximum(best[1:], best[:-1] + row, out=now[1:])
        best = np.maximum.accumulate(now)
        if keep:
            table.append(best)
    return table if keep else best


def _chosen(left: list[Node], right: list[Node], sizes: dict) -> list[tuple[Node, Node]]:
    """The pairs of children in the best match."""
    gain = _gains(left, right, sizes, True)
    out, parts = [], [(0, len(left), 0, len(right))]
    while parts:
        a, b, c, d = parts.pop()
        if a == b or c == d:
            continue
        some = lambda x, c=c, d=d: gain(x)[c:d]
        if (b - a) * (d - c) > CELLS and b - a > 1:
            half = (a + b) // 2
            at = c + int(np.argmax(_scores(left[a:half], some) + _scores(left[half:b], some, True)[::-1]))
            parts += [(a, half, c, at), (half, b, at, d)]
            continue
        best = _scores(left[a:b], some, keep=True)
        i, j = b - a, d - c
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((left[a + i], right[c + j]))
    return out


def constants(reference: Node, page: Node) -> set[int]:
    """Keys of the texted nodes of a reference page that are the same in another."""
    return {key(x) for x, y in matched(reference, page) if x.text and x.text == y.text}


def main_text(root: Node, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The content of a page, without the nodes of its host's template."""
    regions: list[Node] = []
    for tag in ("article", "main"):
        stack = [root]
        while stack and not regions or stack and tag == "article":
            node = stack.pop()
            if node.tag == tag and not node.dropped:
                regions.append(node)
            elif not node.dropped:
                stack += node.children[::-1]
        if regions:
            break
    inside = bool(regions)
    blocks: list[str] = []
    piece: list[str] = []

    def close():
        text = " ".join("".join(piece).split())
        if text:
            blocks.append(text)
        piece.clear()

    todo: list = list(reversed(regions)) if inside else [root]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            piece.append(entities.unescape(x))
        elif x.dropped or (x.tag == "header" and not inside) or (x.text and template and key(x) in template):
            if x.tag in BLOCK:
                close()
        elif x.tag == "br":
            piece.append(" ")
        else:
            items = list(reversed(x.items))
            if x.tag in BLOCK or x.tag == "#root":
                close()
                items = [None, *items]
            todo += items
    close()
    return "\n".join(blocks)


def host_column():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template, n): hashes of the nodes that are constant over each host of LEAST different pages or more, and its pages."""
    rows = pages.select("page_id", "html", host_column().alias("host"), F.xxhash64("html").alias("print")).where("html is not null")
    prints = materialize(rows.groupBy("host", "print").agg(F.count("*").alias("n"), F.min("page_id").alias("first")), "prints")
    sizes = prints.groupBy("host").agg(F.count("*").alias("pages"), F.sum("n").alias("n"), F.min("print").alias("print")).where(F.col("pages") >= LEAST)
    sizes = materialize(sizes, "hosts")
    known = F.broadcast(sizes) if sizes.count() <= BROADCAST_HOSTS else sizes.hint("merge")
    chosen = rows.join(known.select("host", "print"), ["host", "print"])
    references = materialize(chosen.groupBy("host").agg(F.min("html").alias("reference")).join(sizes.select("host", "n").hint("merge"), "host"), "references")
    copies = prints.where("n > 1 and first is not null").select(F.xxhash64("host", "print").alias("copy"), F.col("first").alias("only"), "n")
    rows = look_up(rows.withColumn("copy", F.xxhash64("host", "print")), copies, "copy", "only", "page_id").where("only is null or only = page_id") if not copies.isEmpty() else rows
    rows = rows.select("page_id", "host", "html")
    if (references.agg(F.sum(F.octet_length("reference"))).first()[0] or 0) <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(references.drop("n")), "host")
    else:
        rows = look_up(rows, references, "host", "reference", "page_id").where("reference is not null")

    def run(batches):
        counts: Counter[tuple[str, int]] = Counter()
        parsed: dict[str, Node] = {}

        def batch_of():
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["host", "node", "n"])
            counts.clear()
            return out

        for batch in batches:
            for host, html, reference in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if host not in parsed:
                    if len(parsed) >= 500:
                        parsed.clear()
                    parsed[host] = tree(reference)
                for k in constants(parsed[host], tree(html)):
                    counts[host, k] += 1
                if len(counts) > HELD:
                    yield batch_of()
        yield batch_of()

    counts = rows.select("host", "html", "reference").mapInArrow(run, "host string, node long, n long").groupBy("host", "node").agg(F.sum("n").alias("found"))
    return counts.join(known, "host").where(F.col("found") >= SHARE * F.col("pages")).groupBy("host").agg(F.collect_list("node").alias("template"), F.min("n").alias("n"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    known = materialize(templates(pages), "templates")
    rows = pages.select("page_id", "url", "html", host_column().alias("host"))
    rows = rows.join(F.broadcast(known.drop("n")), "host", "left") if known.count() <= BROADCAST_HOSTS else look_up(rows, known, "host", "template", "page_id")
    rows = rows.select("page_id", "url", "html", "template")

    def run(batches):
        for batch in batches:
            texts = [main_text(tree(h), set(t or ())) for h, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
