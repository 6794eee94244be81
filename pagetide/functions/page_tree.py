"""The two Python helpers of the library: HTML to a flat tree, embedded JSON to flat nodes.

Both run as Arrow UDFs on the executors and only parse, a piece of a batch at a time: what a
worker holds does not grow with the rows of its partition.  What the nodes mean (noise, lines,
hints, fields) is decided by column expressions on their output.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values
DROP_TAGS = ("script", "style", "nav", "footer", "header", "aside", "iframe", "noscript")
NOISE_CLASSES = (
    "dropdown", "menu", "search-hot", "search-form", "search-box", "column-search-panel",
    "login-step", "login-form", "guide-download-app", "side-entry", "hot-job-box", "sidebar",
    "comments", "popup", "modal", "tooltip", "ad", "advertisement", "share-box", "cookie-banner",
)
NOISE_CLASS_PREFIXES = (
    "ambox", "mbox", "navbox", "hatnote", "infobox", "metadata", "noprint", "mw-editsection",
    "mw-jump-link", "shortdescription", "sistersitebox", "catlinks", "reflist", "reference", "toc",
    "toccolours", "message-box", "banner", "notice", "disclaimer",
)
NOISE_ID_PREFIXES = ("toc", "catlinks", "mw-panel", "mw-navigation", "footer")
NOISE_ROLES = ("navigation", "banner", "complementary")
JOB_BLOCK_WORDS, JOB_BLOCK_PARTS = ("job-info", "company-job-item"), ("job-card",)
JOB_PART, JOB_FRAMES = "job", ("job-list", "position")
HIDDEN_STYLES = ("display:none", "display: none", "visibility:hidden", "visibility: hidden")
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
    "source", "track", "wbr",
)
ASSIGNMENT_MARKERS = (
    "__NEXT_DATA__", "__NUXT__", "__APOLLO_STATE__", "__INITIAL_STATE__", "__PRELOADED_STATE__",
    "__REACT_QUERY_STATE__", "ShopifyAnalytics.meta.product", "ShopifyAnalytics.meta",
    "window.Shopify", "window.__PRODUCT__", "window.__PRODUCT_DATA__",
    "window.__INITIAL_PRODUCT__", "BigCommerce", "__SFCC", "window.__JOB_DATA__",
    "window.__INITIAL_JOB__", "window.__CAREERS_DATA__", "window.__JOB_POSTING__",
    "window.__ASHBY_DATA__", "window.__GREENHOUSE_DATA__", "window.__LEVER_DATA__",
    "window.__ICIMS_DATA__", "jobPosting",
)
LINKED_DATA_KEYS = ("@graph", "itemListElement", "mainEntity", "offers")
NAME_KEYS = (
    "name", "title", "text", "label", "displayName", "locationsText", "addressLocality",
    "addressRegion", "@id", "url",
)
# ---- end of fixed values

# Attributes that later expressions read; the others are not shipped to the JVM.
KEPT_ATTRIBUTES = frozenset(
    ("class", "id", "type", "itemprop", "content", "value", "property", "name", "rel", "href",
     "data-smart-captured-response")
)
# Characters of text whose nodes are Python objects at one time; a longer text is a piece of its own.
PIECE_CHARS = 1 << 19
_RAW_TEXT = frozenset(("script", "style", "template"))
_VOID = frozenset(VOID_TAGS)
_BLOCKS = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main "
    "nav ol p pre section table ul".split()
)
# An unclosed tag ends at the next start tag listed here, unless a fence tag lies between.
_ENDED_BY = {"p": _BLOCKS | {"li", "td", "th", "tr"}, "li": {"li"}, "td": {"td", "th", "tr"},
             "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_FENCE = {"p": {"table", "button"}, "li": {"ul", "ol"}, "td": {"table"}, "th": {"table"},
          "tr": {"table"}, "option": {"select"}, "dt": {"dl"}, "dd": {"dl"}}
# The same the other way round: what a start tag may end.
_ENDS = {tag: [older for older, by in _ENDED_BY.items() if tag in by] for tag in set().union(*_ENDED_BY.values())}


def pieces(sizes: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of rows, in order, whose sizes sum up to `most`, or of a single larger row."""
    most = PIECE_CHARS if most is None else most
    start = held = 0
    for row, size in enumerate(sizes.to_pylist()):
        size = size or 0
        if row > start and held + size > most:
            yield start, row - start
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes) - start


def _in_pieces(batches: Iterator[pa.Array], sizes: Callable[[pa.Array], pa.Array], parse: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """What `parse` makes of each value, piece by piece."""
    for batch in batches:
        for start, rows in pieces(sizes(batch)):
            yield pa.array([parse(v) for v in batch.slice(start, rows).to_pylist()], kind)
        if not len(batch):
            yield pa.array([], kind)


class _Blocks:
    """Job blocks around a place, carried from an element to those inside it.

    `numbers` has, for each class word and part that makes a block, the nearest such element at or above the place, and
    for each frame the nearest frame around the nearest element with a job class; -1 where there is none.
    """

    def __init__(self, numbers: tuple[int, ...], frames: tuple[int, ...]):
        self.numbers, self.frames = numbers, frames

    def below(self, no: int, classes: str) -> _Blocks:
        if JOB_PART not in classes and not any(f in classes for f in JOB_FRAMES):
            return self
        words, size = classes.split(), len(JOB_BLOCK_WORDS) + len(JOB_BLOCK_PARTS)
        own = [w in words for w in JOB_BLOCK_WORDS] + [p in classes for p in JOB_BLOCK_PARTS]
        blocks = [no if hit else above for hit, above in zip(own, self.numbers, strict=False)]
        framed = self.frames if JOB_PART in classes else self.numbers[size:]
        return _Blocks((*blocks, *framed), tuple(no if f in classes else above for f, above in zip(JOB_FRAMES, self.frames, strict=True)))

    def shipped(self) -> list[int] | None:
        return list(self.numbers) if max(self.numbers) >= 0 else None


_OUTSIDE = _Blocks((-1,) * (len(JOB_BLOCK_WORDS) + len(JOB_BLOCK_PARTS) + len(JOB_FRAMES)), (-1,) * len(JOB_FRAMES))


class _Tree(HTMLParser):
    """Elements in document order with subtree and text ranges; adjacent character data merged.

    Open elements stand on one stack, and their depths on a stack for each tag. So the element that a tag closes, and the
    fence that keeps it open, are found without a walk, and every element is closed once.
    """

    def __init__(self, drop_tags: frozenset[str], keep: frozenset[str] = KEPT_ATTRIBUTES):
        super().__init__(convert_charrefs=True)
        self.drop_tags = drop_tags
        self.keep = keep
        self.elements: list[dict] = []
        self.texts: list[dict] = []
        self.open: list[int] = []
        self.depths: dict[str, list[int]] = defaultdict(list)
        # Of the page and of each open element: the last child so far, and the job blocks around its children.
        self.last_child = [-1]
        self.blocks = [_OUTSIDE]
        self.data: list[str] = []
        self.cells = 0

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers, which the parser counts for its callers, are not wanted."""
        return j

    def flush(self) -> None:
        if not self.data:
            return
        text = "".join(self.data)
        self.data.clear()
        if text.strip():
            top = self.elements[self.open[-1]] if self.open else None
            self.texts.append(
                {
                    "text": text,
                    "dropped_by": top["dropped_by"] if top else -1,
                    "raw": bool(top) and top["tag"] in _RAW_TEXT,
                    "blocks": self.blocks[-1].shipped(),
                }
            )

    def close_down_to(self, depth: int) -> None:
        for no in reversed(self.open[depth:]):
            element = self.elements[no]
            element["end"] = len(self.elements)
            element["t1"] = len(self.texts)
            element["c1"] = self.cells
            self.depths[element["tag"]].pop()
        del self.open[depth:], self.last_child[depth + 1 :], self.blocks[depth + 1 :]

    def depth_of(self, tags) -> int:
        """Depth of the innermost open element with one of the tags, -1 without one."""
        return max((self.depths[tag][-1] for tag in tags if self.depths.get(tag)), default=-1)

    def end_unclosed(self, tag: str) -> None:
        """Close what the start tag ends: innermost first, nothing behind a fence."""
        if tag not in _ENDS:
            return
        while ending := [older for older in _ENDS.get(tag, ()) if self.depth_of((older,)) > self.depth_of(_FENCE[older])]:
            self.close_down_to(self.depth_of(ending))

    def handle_starttag(self, tag, attrs):
        self.flush()
        self.end_unclosed(tag)
        no = len(self.elements)
        values = {k: v or "" for k, v in attrs}
        above = self.elements[self.open[-1]]["dropped_by"] if self.open else -1
        blocks = self.blocks[-1].below(no, values.get("class", "").lower())
        self.elements.append(
            {
                "no": no, "end": no + 1, "tag": tag,
                "attrs": {k: v for k, v in values.items() if k in self.keep},
                "t0": len(self.texts), "t1": len(self.texts), "c0": self.cells, "c1": self.cells,
                "dropped_by": no if self.is_noise(tag, values) else above,
                "parent": self.open[-1] if self.open else -1, "prev": self.last_child[-1],
                "blocks": blocks.shipped(),
            }
        )
        self.last_child[-1] = no
        self.cells += tag in ("td", "th")
        if tag not in _VOID:
            self.depths[tag].append(len(self.open))
            self.open.append(no)
            self.last_child.append(-1)
            self.blocks.append(blocks)

    def handle_endtag(self, tag):
        self.flush()
        if self.depths.get(tag):
            self.close_down_to(self.depths[tag][-1])

    def handle_data(self, data):
        self.data.append(data)

    def handle_comment(self, data):
        self.flush()

    def is_noise(self, tag: str, attrs: dict[str, str]) -> bool:
        if not attrs:
            return tag in self.drop_tags
        classes = attrs.get("class", "").lower().split()
        style = attrs.get("style", "").lower()
        return (
            tag in self.drop_tags
            or any(s in style for s in HIDDEN_STYLES)
            or any(c in NOISE_CLASSES or c.startswith(NOISE_CLASS_PREFIXES) for c in classes)
            or attrs.get("id", "").strip().lower().startswith(NOISE_ID_PREFIXES)
            or attrs.get("role", "").strip().lower() in NOISE_ROLES
        )

    def finish(self):
        self.close()
        self.flush()
        self.close_down_to(0)
        return self.elements, self.texts


TREE_TYPE = """
    elements ARRAY<STRUCT<no: INT, end: INT, tag: STRING, attrs: MAP<STRING,STRING>, t0: INT,
        t1: INT, c0: INT, c1: INT, dropped_by: INT, parent: INT, prev: INT, blocks: ARRAY<INT>>>,
    texts ARRAY<STRUCT<text: STRING, dropped_by: INT, raw: BOOLEAN, blocks: ARRAY<INT>>>
"""

_INT, _TEXT, _ATTRS = pa.int32(), pa.string(), pa.map_(pa.string(), pa.string())
_ELEMENT = [
    ("no", _INT), ("end", _INT), ("tag", _TEXT), ("attrs", _ATTRS), ("t0", _INT), ("t1", _INT), ("c0", _INT), ("c1", _INT),
    ("dropped_by", _INT), ("parent", _INT), ("prev", _INT), ("blocks", pa.list_(_INT)),
]
_PLACED = [("text", _TEXT), ("dropped_by", _INT), ("raw", pa.bool_()), ("blocks", pa.list_(_INT))]
_TREE = pa.struct([("elements", pa.list_(pa.struct(_ELEMENT))), ("texts", pa.list_(pa.struct(_PLACED)))])


def page_tree(html: Column, drop_tags: tuple[str, ...] = DROP_TAGS, keep: tuple[str, ...] = ()) -> Column:
    """STRUCT<elements, texts>; `keep` names attributes to ship besides the usual ones.

    `dropped_by` is the number of the nearest enclosing element that is a dropped tag, hidden
    or a noise block, -1 when there is none.  `t0`..`t1` is the range of an
    element's texts, `c0`..`c1` that of the table cells in it.  `parent` and `prev` number the
    parent and the sibling before; `blocks` is what `_Blocks` says of the place, NULL outside all.
    """
    dropped, kept = frozenset(drop_tags), KEPT_ATTRIBUTES | frozenset(keep)

    def tree(page: str | None) -> dict:
        builder = _Tree(dropped, kept)
        builder.feed(page or "")
        elements, texts = builder.finish()
        for e in elements:
            e["attrs"] = list(e["attrs"].items())
        return {"elements": elements, "texts": texts}

    @F.arrow_udf(TREE_TYPE)
    def parse(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _in_pieces(pages, pc.utf8_length, tree, _TREE)

    return parse(html)


_COMPACT = re.compile(r"[^a-z0-9]+")
_SPACES = re.compile(r"\s+")
_ASSIGNMENTS = [re.compile(re.escape(m) + r"[^=]*=[ \t\r\n]*(?=[{\[])") for m in ASSIGNMENT_MARKERS]
_DECODER = json.JSONDecoder()


def _is_empty(value) -> bool:
    return value is None or value == "" or value == [] or value == {}


def hint_text(value) -> str:
    """Text of a JSON value: first non-blank of a list, naming key of an object."""
    if isinstance(value, list):
        value = next((v for v in value if not _is_empty(v)), "")
    if isinstance(value, dict):
        value = next((value[k] for k in NAME_KEYS if value.get(k)), "")
    return _SPACES.sub(" ", str(value).strip()) if value is not None else ""


def _decode(text: str, start: int = 0):
    try:
        return _DECODER.raw_decode(text, start)
    except ValueError:
        return None, -1


def _documents(kind: str, text: str):
    """JSON values of one script: the whole text, or the right-hand sides of known assignments."""
    if kind != "assign":
        value, end = _decode(text)
        if end >= 0 and not text[end:].strip():
            yield value
        return
    for pattern in _ASSIGNMENTS:
        at = 0
        while found := pattern.search(text, at):
            value, end = _decode(text, found.end())
            if end >= 0:
                yield value
            at = max(end, found.end() + 1)


def _types(item: dict) -> list[str]:
    raw = item.get("@type") or item.get("type") or ""
    names = raw if isinstance(raw, list) else [raw]
    return [t for t in (str(n).strip().lower() for n in names) if t]


def _flatten(document) -> list[dict]:
    """Every JSON object in document order, with its parent, the key leading to it and its texts; the
    objects below it are those from the next one up to `end`."""
    nodes: list[dict] = []
    pending = [(document, -1, "", True)]
    while pending:
        value, parent, via, linked = pending.pop()
        if isinstance(value, list):
            pending.extend((v, parent, via, linked) for v in reversed(value))
        elif isinstance(value, dict):
            no, fields, children = len(nodes), {}, []
            for key, child in value.items():
                name = _COMPACT.sub("", str(key).lower())
                text = hint_text(child)
                if text:
                    fields.setdefault(name, text)
                if isinstance(child, list):
                    fields.setdefault(name + "#", str(len(child)))
                if isinstance(child, (dict, list)):
                    children.append((child, no, name, linked and key in LINKED_DATA_KEYS))
            nodes.append(
                {
                    "no": no, "end": no + 1, "parent": parent, "via": via, "linked": linked, "types": _types(value),
                    "fields": fields, "keys": " ".join(str(k).lower() for k in value),
                }
            )
            pending.extend(reversed(children))
    for node in reversed(nodes):
        if node["parent"] >= 0:
            above = nodes[node["parent"]]
            above["end"] = max(above["end"], node["end"])
    return nodes


PAYLOADS_TYPE = """
    ARRAY<STRUCT<src: INT, seq: INT, nodes: ARRAY<STRUCT<no: INT, end: INT, parent: INT, via: STRING,
        linked: BOOLEAN, types: ARRAY<STRING>, fields: MAP<STRING,STRING>, keys: STRING>>>>
"""

_NODE = [
    ("no", _INT), ("end", _INT), ("parent", _INT), ("via", _TEXT), ("linked", pa.bool_()), ("types", pa.list_(_TEXT)),
    ("fields", _ATTRS), ("keys", _TEXT),
]
_PAYLOADS = pa.list_(pa.struct([("src", _INT), ("seq", _INT), ("nodes", pa.list_(pa.struct(_NODE)))]))


def json_payloads(scripts: Column) -> Column:
    """Payloads of ARRAY<STRUCT<src, kind, text>> scripts, each a list of flat nodes."""

    def payloads(page: list[dict] | None) -> list[dict]:
        found = []
        for script in page or ():
            for document in _documents(script["kind"], script["text"].strip()):
                nodes = _flatten(document)
                for node in nodes:
                    node["fields"] = list(node["fields"].items())
                if nodes:
                    found.append({"src": script["src"], "seq": len(found), "nodes": nodes})
        return found

    def sizes(pages: pa.Array) -> pa.Array:
        return pa.array([sum(len(s["text"] or "") for s in page) if page else 0 for page in (v.as_py() for v in pages)], pa.int64())

    @F.arrow_udf(PAYLOADS_TYPE)
    def parse(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _in_pieces(pages, sizes, payloads, _PAYLOADS)

    return parse(scripts)
