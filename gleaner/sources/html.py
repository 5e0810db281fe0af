"""Pages as node and text arrays, one row per page.

Only the reading of markup happens in Python (standard-library tokenizer, Arrow in and
out, no shuffle). Everything computed *from* the nodes is Spark column work, see
``gleaner.functions.html``.

A node knows its parent, the span ``t0:t1`` of text pieces below it, and its spans in
the source: ``h0:h1`` the element, ``h0:h2`` with the text that follows it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

ATTRS = ("class", "id", "href", "rel", "name", "property", "content", "src", "alt", "datetime")
NODE = "struct<tag:string,parent:int,cls:string,id:string,href:string,rel:string,name:string,prop:string,content:string,src:string,alt:string,time:string,link:string,own:int,tail:int,t0:int,t1:int,h0:int,h1:int,h2:int>"
PIECE = "struct<at:int,s:string>"

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b big cite code em font i s small span strike strong sub sup tt u".split())
_BLOCK = frozenset("address article aside blockquote center dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
# what a start tag closes when it is still open, and where the search for it stops
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}


class _Reader(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.lines = [0, *itertools.accumulate(len(line) + 1 for line in html.split("\n"))]
        self.nodes: list[list] = []
        self.pieces: list[tuple[int, str]] = []
        self.open: list[int] = []
        self.ended: list[int] = []  # closed, end of the end tag not seen yet
        self.trailing: list[int] = []  # closed, following text not over yet
        self.fresh = -1  # node whose start tag was the last thing read
        self.feed(html)
        self.close()
        self._close(0, len(html))
        self._mark(len(html), True)

    def _here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _mark(self, at: int, markup: bool) -> None:
        for n in self.ended:
            self.nodes[n][18] = at
        self.ended = []
        if markup:
            for n in self.trailing:
                self.nodes[n][19] = at
            self.trailing = []

    def _close(self, depth: int, at: int) -> None:
        while len(self.open) > depth:
            n = self.open.pop()
            self.nodes[n][16], self.nodes[n][18] = len(self.pieces), at
            self.trailing.append(n)

    def handle_starttag(self, tag, attrs):
        at = self._here()
        self._mark(at, True)
        names = [self.nodes[n][0] for n in self.open]
        if tag in _BLOCK:
            inner = len(names)
            while inner and names[inner - 1] in _INLINE:
                inner -= 1
            if inner and names[inner - 1] == "p":
                self._close(inner - 1, at)
        if tag in _CLOSES:
            shut, stop = _CLOSES[tag]
            for i in range(len(self.open) - 1, -1, -1):
                name = self.nodes[self.open[i]][0]
                if name in stop:
                    break
                if name in shut:
                    self._close(i, at)
                    break
        self._mark(at, True)
        got = dict(reversed(attrs))
        values = [got.get(a) for a in ATTRS]
        n = len(self.nodes)
        self.nodes.append([tag, self.open[-1] if self.open else -1, *values, got.get("type"), 0, 0, len(self.pieces), len(self.pieces), at, at, at])
        self.fresh = n
        if tag in _VOID:
            self.ended.append(n)
            self.trailing.append(n)
            self.fresh = -1
        else:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        at = self._here()
        self._mark(at, True)
        self.fresh = -1
        for i in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[i]][0] == tag:
                n = self.open[i]
                self._close(i + 1, at)
                self._mark(at, True)
                self._close(i, at)
                self.ended.append(n)
                break

    def handle_data(self, data):
        at = self._here()
        self._mark(at, False)
        inside = self.nodes[self.open[-1]] if self.open else None
        if inside is not None and inside[0] in ("script", "style"):
            if inside[12] == "application/ld+json":
                inside[8] = data
            return
        if self.fresh >= 0:
            self.nodes[self.fresh][13] = len(data)
        for n in self.trailing:
            self.nodes[n][14] = len(data)
        self.fresh = -1
        self.pieces.append((at, data))

    def _other(self, *_):
        self._mark(self._here(), True)
        self.fresh = -1

    handle_comment = handle_decl = handle_pi = unknown_decl = _other


def _absolute(base: str, href: str | None) -> str | None:
    if href is None:
        return None
    try:
        return urljoin(base, href.strip())
    except ValueError:
        return None


def _arrays(urls: list[str], htmls: list[str]) -> tuple[pa.Array, pa.Array]:
    fields = [[] for _ in range(20)]
    at, text, node_offsets, piece_offsets = [], [], [0], [0]
    for url, html in zip(urls, htmls):
        read = _Reader(html or "")
        for node in read.nodes:
            node[12] = _absolute(url or "", node[4])  # the type attribute has served its purpose
            for column, value in zip(fields, node):
                column.append(value)
        for a, s in read.pieces:
            at.append(a)
            text.append(s)
        node_offsets.append(len(fields[0]))
        piece_offsets.append(len(at))
    names = "tag parent cls id href rel name prop content src alt time link own tail t0 t1 h0 h1 h2".split()
    kinds = [pa.int32() if n in ("parent", "own", "tail", "t0", "t1", "h0", "h1", "h2") else pa.string() for n in names]
    nodes = pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(fields, kinds)], names)
    pieces = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(text, pa.string())], ["at", "s"])
    wrap = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    return wrap(node_offsets, nodes), wrap(piece_offsets, pieces)


def with_nodes(pages: DataFrame, step: int = 64) -> DataFrame:
    """Adds ``nodes`` and ``texts`` to rows with ``url`` and ``html``. Filters on other
    columns belong before this call: Spark cannot push them through it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                cols = part.schema.names
                nodes, texts = _arrays(part.column(cols.index("url")).to_pylist(), part.column(cols.index("html")).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, nodes, texts], [*cols, "nodes", "texts"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInArrow(read, f"{kept}, nodes array<{NODE}>, texts array<{PIECE}>")
