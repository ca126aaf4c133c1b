"""Raw HTML to page tables: text, anchors and blocks. The one job of the library that runs Python on rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

BLOCK_TAGS = {
    "div", "section", "article", "li", "td", "tr", "table", "ul", "ol", "p", "main", "nav", "footer", "aside", "header", "body", "h1", "h2", "h3"}
SILENT_TAGS = {"script", "style", "noscript", "template", "title"}
NODE = (
    "struct<kind:string, block_id:int, pos:int, parent_id:int, depth:int, ancestors:array<int>, tag:string, css_class:string, "
    "attrs:map<string,string>, hidden:boolean, text:string, href:string, title:string, aria_label:string, img_alt:string>")
KINDS = ("block", "anchor")
#: Characters of node texts in one output slice.
SLICE_CHARS = 4_000_000
#: A tag that reads the same in any parser, and its attributes: a plain name, values in quotes. What else a page may hold is left to HTMLParser,
#: and so are pages with elements whose content is no markup.
_PLAIN_TAG = re.compile(r"""<(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\r\n\f]+[a-zA-Z][-a-zA-Z0-9_:]*(?:="[^"]*"|='[^']*')?)*))[ \t\r\n\f]*>""")
_PLAIN_ATTRIBUTE = re.compile(r"""([a-zA-Z][-a-zA-Z0-9_:]*)(?:="([^"]*)"|='([^']*)')?""")
_TAGS = re.compile(r"(<[^<>]*>)")
_OTHER_CONTENT = SILENT_TAGS | {"textarea", "xmp", "iframe", "noembed", "noframes", "plaintext", "svg", "math"}
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "map<string,string>": pa.map_(pa.string(), pa.string())}
_FIELD_TYPES = [pa.field(n, _ARROW[t]) for n, t in (x.split(":", 1) for x in NODE[7:-1].split(", "))]


class _Reader(HTMLParser):
    """Collects blocks and anchors of one page; unclosed and stray tags are tolerated.

    The page's words are held once, tidied as they come (see _tidy): `words` makes up one text, in which a block or anchor knows
    where its own begins and ends. Blocks are lists [parent, ancestors, tag, class, attributes, hidden, start, end], anchors
    [line of blocks, href, title, aria label, image text, start, end].
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.blocks, self.anchors, self.open, self.silent, self.link = [], [], [], [], 0, None
        self.size, self.fresh, self.blank = 0, True, False  # characters so far; whether a line begins here; whether a blank waits for its next word

    def handle_starttag(self, tag, attrs):
        self.start(tag, *_prepared(tag, attrs))

    def start(self, tag, got, css_class, hidden):
        if tag in BLOCK_TAGS:
            blocks, around = self.blocks, self.open
            if tag == "p" and around and blocks[around[-1]][2] == "p":
                self.close_block()
            parent = around[-1] if around else None
            blocks.append([parent, around[:], tag, css_class, got, hidden or (parent is not None and blocks[parent][5]), self.size, None])
            around.append(len(blocks) - 1)
            self.blank = False
            if not self.fresh:
                self.end_line()
        elif tag == "a":
            if "href" in got:
                self.close_link()
                self.link = [self.open[:], got["href"], got.get("title"), got.get("aria-label"), None, self.size, None]
                self.anchors.append(self.link)
        elif tag == "br":
            self.end_line()
        elif tag == "img":
            if self.link is not None and got.get("alt"):
                self.link[4] = got["alt"]
        elif tag in SILENT_TAGS:
            self.silent += 1

    def close_block(self):
        block = self.blocks[self.open.pop()]
        block[7] = self.size
        return block[2]

    def close_link(self):
        if self.link is not None:
            self.link[6] = self.size
        self.link = None

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            blocks, around = self.blocks, self.open
            if around and blocks[around[-1]][2] == tag:
                self.end_line()
                blocks[around.pop()][7] = self.size
            elif any(blocks[i][2] == tag for i in around):
                self.end_line()
                while self.close_block() != tag:
                    pass
        elif tag == "a":
            self.close_link()
        elif tag in SILENT_TAGS:
            self.silent = max(0, self.silent - 1)

    def handle_data(self, data):
        if self.silent or not data.strip():
            return
        if _UNTIDY(data):
            *lines, data = _BLANKS.sub(" ", data).split("\n")
            for line in lines:
                self.say(line)
                self.end_line()
        self.say(data)

    def end_line(self):
        self.blank = False
        if not self.fresh:
            self.words.append("\n")
            self.size += 1
            self.fresh = True

    def say(self, line):
        """Adds words without line breaks and with single blanks; blanks at the ends of the page's lines never get in."""
        if self.fresh:
            line = line.lstrip()
        elif line[:1] == " ":
            self.blank, line = True, line[1:]
        if not line:
            return
        if self.blank:
            line = " " + line
        self.blank, self.fresh = line[-1] == " ", False
        if self.blank:
            line = line[:-1]
        self.words.append(line)
        self.size += len(line)


_UNTIDY, _BLANKS = re.compile(r"[\n\t\r\f]|  ").search, re.compile(r"[ \t\r\f]+")


def _prepared(tag: str, attrs: list) -> tuple[dict, str, bool]:
    """Attributes by name, class, and whether they hide a block."""
    got = {k: v or "" for k, v in attrs}
    return got, got.get("class", ""), "hidden" in got or "display:none" in got.get("style", "").replace(" ", "") or got.get("aria-hidden") == "true"


def _plain_tag(text: str) -> tuple | None:
    """(tag, what _prepared() gives, or None for an end tag) of a plain tag; None if it is none."""
    m = _PLAIN_TAG.fullmatch(text)
    if m is None or (m[1] or m[2]).lower() in _OTHER_CONTENT:
        return None
    if m[1]:
        return m[1].lower(), None
    tag, values = m[2].lower(), []
    if m[3]:
        values = [(a[1].lower(), a[2] if a[2] is not None else a[3]) for a in _PLAIN_ATTRIBUTE.finditer(m[3])]
        if "&" in m[3]:
            values = [(n, unescape(v) if v else v) for n, v in values]
    return tag, _prepared(tag, values)


def _read_plain(html: str, reader: _Reader, known: dict) -> bool:
    """Hands the parts of a page of plain tags to the reader, as HTMLParser would; whether it is such a page. `known` keeps tags without links."""
    parts = _TAGS.split(html)
    read = []
    for text in parts[1::2]:
        tag = known.get(text)
        if tag is None:
            tag = _plain_tag(text)
            if tag is None:
                return False
            if len(known) < 1000 and "href" not in text:
                known[text] = tag
        read.append(tag)
    if "<" in "".join(parts[::2]):
        return False
    start, end, data = reader.start, reader.handle_endtag, reader.handle_data
    for text, (tag, got) in zip(parts[::2], read):
        if text:
            data(unescape(text) if "&" in text else text)
        if got is None:
            end(tag)
        else:
            start(tag, *got)
    if parts[-1]:
        data(unescape(parts[-1]))
    return True


def _tidy(words: str) -> str:
    """Words with single blanks, and lines without blank ends or empty ones between them: what the text of a node is of all words inside it."""
    if "  " in words or "\t" in words or "\r" in words or "\f" in words:
        words = re.sub(r"[ \t\r\f]+", " ", words)
    lines = words.split("\n")
    if len(lines) == 1:
        return words.strip()
    # a line loses the one blank before its end, and all white space at its start
    cut = [x[:-1] if x[-1:] == " " else x for x in lines[:-1]]
    rest = [x.lstrip() for x in [*cut[1:], lines[-1]]]
    return "\n".join([cut[0], *filter(None, rest)]).strip()


def _read(html: str | None, known: dict) -> tuple[str, _Reader]:
    """(the page's words, the reader that knows its blocks and anchors)."""
    reader = _Reader()
    if not _read_plain(html or "", reader, known):
        reader.feed(html or "")
        reader.close()
    return "".join(reader.words), reader


def _listed(lists: list[list[int]]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, lists))], pa.int32()), pa.array([x for one in lists for x in one], pa.int32()))


def _block_columns(blocks: list[tuple[int, str, list]]) -> dict[str, pa.Array]:
    """The fields of blocks, given as (block_id, text, as the reader has it)."""
    found = [b for _, _, b in blocks]
    attrs = [b[4] for b in found]
    names, values = pa.array([n for a in attrs for n in a], pa.string()), pa.array([v for a in attrs for v in a.values()], pa.string())
    return {
        "block_id": pa.array([n for n, _, _ in blocks], pa.int32()), "parent_id": pa.array([b[0] for b in found], pa.int32()), "depth": pa.array([len(b[1]) for b in found], pa.int32()),
        "ancestors": _listed([b[1] for b in found]), "tag": pa.array([b[2] for b in found], pa.string()), "css_class": pa.array([b[3] for b in found], pa.string()),
        "attrs": pa.MapArray.from_arrays(pa.array([0, *accumulate(map(len, attrs))], pa.int32()), names, values), "hidden": pa.array([b[5] for b in found], pa.bool_()),
        "text": pa.array([t for _, t, _ in blocks], pa.string())}


def _anchor_columns(anchors: list[tuple[int, str, list]]) -> dict[str, pa.Array]:
    """The fields of anchors, given as (pos, text, as the reader has it)."""
    found = [a for _, _, a in anchors]
    return {
        "block_id": pa.array([a[0][-1] if a[0] else None for a in found], pa.int32()), "pos": pa.array([n for n, _, _ in anchors], pa.int32()), "ancestors": _listed([a[0] for a in found]),
        "text": pa.array([t for _, t, _ in anchors], pa.string()), **{c: pa.array([a[k] for a in found], pa.string()) for k, c in enumerate(("href", "title", "aria_label", "img_alt"), 1)}}


def page_nodes(pages: DataFrame, html_col: str = "html", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """All columns but the HTML, plus one row a block or anchor in `node`; pages without any of the kinds asked for give no row.

    A block's text is all text inside it, so nested blocks repeat it. `ancestors` are the blocks around a block, or around an anchor, the
    innermost last. Nodes leave the task in slices of about SLICE_CHARS characters; memory follows the largest page.
    """
    keep = [c for c in pages.columns if c != html_col]
    schema = ", ".join(f"`{c}` {t}" for c, t in pages.select(*keep).dtypes) + f", node {NODE}"
    columns_of = {"block": _block_columns, "anchor": _anchor_columns}

    def slices(batch: pa.RecordBatch, at: dict[str, list[int]], nodes: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for kind in kinds:
            if nodes[kind]:
                n, given = len(nodes[kind]), columns_of[kind](nodes[kind])
                given["kind"] = pa.repeat(pa.scalar(kind), n)
                columns = [given[f.name].cast(f.type) if f.name in given else pa.nulls(n, f.type) for f in _FIELD_TYPES]
                taken = pa.array(at[kind], pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(taken) for c in keep], pa.StructArray.from_arrays(columns, fields=_FIELD_TYPES)], names=[*keep, "node"])

    def run(batches):
        known: dict = {}
        for batch in batches:
            at, nodes, size = {k: [] for k in kinds}, {k: [] for k in kinds}, 0
            for i, html in enumerate(batch.column(html_col).to_pylist()):
                words, reader = _read(html, known)
                for kind, found in (("block", reader.blocks), ("anchor", reader.anchors)):
                    if kind in kinds:
                        for n, node in enumerate(found):
                            text = words[node[-2]:node[-1]].strip()
                            at[kind].append(i)
                            nodes[kind].append((n, text, node))
                            size += len(text) + 200
                            if size >= SLICE_CHARS:
                                yield from slices(batch, at, nodes)
                                at, nodes, size = {k: [] for k in kinds}, {k: [] for k in kinds}, 0
            yield from slices(batch, at, nodes)

    return pages.mapInArrow(run, schema)


def _columns(nodes: DataFrame, kind: str, *fields: str) -> DataFrame:
    own = [c for c in nodes.columns if c != "node"]
    return nodes.where(F.col("node.kind") == kind).select(*own, *[F.col(f"node.{c}").alias(c) for c in fields])


def page_anchors(nodes: DataFrame) -> DataFrame:
    return _columns(nodes, "anchor", "pos", "block_id", "href", "text", "title", "aria_label", "img_alt", "ancestors")


def page_blocks(nodes: DataFrame) -> DataFrame:
    return _columns(nodes, "block", "block_id", "parent_id", "depth", "ancestors", "tag", "css_class", "attrs", "hidden", "text")


def page_text(nodes: DataFrame) -> DataFrame:
    """One row a page: the text of its outermost blocks in order."""
    top = nodes.where("node.kind = 'block' AND node.depth = 0")
    keys = [c for c in nodes.columns if c != "node"]
    g = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("node.block_id", "node.text"))).alias("t"))
    return g.select(*keys, F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


def read_pages_html(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a Parquet table of raw pages (page_id, url, html)."""
    return page_nodes(spark.read.parquet(path).select("page_id", "url", "html"))
