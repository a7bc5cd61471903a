"""Pages to element rows: the one place where HTML nesting is read.

``read_nodes`` keeps pages partitioned as they come and adds per page the visible text, the JSON-LD script bodies and
one struct per element: ``seq`` (document order), ``stop`` (first seq after its descendants), ``tag``, ``attrs``, and
``a``/``b``, the slice of the text it covers. The text also comes in pieces of ``PIECE`` characters, so that the text
of an element is read where it lies and not from the start of the page. Selector rules are Spark expressions over that array (see
``leadloom.functions.nodes``), so a page is parsed once however many rules read it.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# an opening tag of the key closes an open element of the value, up to the nearest list or table
IMPLIED_END = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
               "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
SCOPE = frozenset("ul ol table select dl".split())
CLOSES_P = frozenset("p div ul ol table section article header footer nav h1 h2 h3 h4 h5 h6 form main aside".split())

NODES_DDL = "array<struct<seq:int,stop:int,tag:string,attrs:map<string,string>,a:int,b:int>>"
_NODE = pa.struct([
    ("seq", pa.int32()), ("stop", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
    ("a", pa.int32()), ("b", pa.int32())])
PAGES_PER_BATCH = 64
#: Characters of a piece of text, a power of two.
PIECE = 256


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[dict] = []
        self.text: list[str] = []
        self.size = 0
        self.silent = 0
        self.ld: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close({"p"}, stop_at=SCOPE | {"div", "td", "th", "li"})
        if tag in IMPLIED_END:
            self._close(IMPLIED_END[tag], stop_at=SCOPE)
        node = {"seq": len(self.nodes), "stop": len(self.nodes) + 1, "tag": tag,
                "attrs": list({k: v or "" for k, v in attrs}.items()), "a": self.size, "b": self.size}
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.silent += tag in ("script", "style")
            if tag == "script" and dict(attrs).get("type") == "application/ld+json":
                self.ld.append("")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._close({tag}, stop_at=frozenset())

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            self.size += len(data)
        elif self.ld and self.open and dict(self.open[-1]["attrs"]).get("type") == "application/ld+json":
            self.ld[-1] += data

    def _close(self, tags, stop_at) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] in tags:
                for node in self.open[i:]:
                    self._end(node)
                del self.open[i:]
                return
            if self.open[i]["tag"] in stop_at:
                return

    def _end(self, node) -> None:
        node["stop"], node["b"] = len(self.nodes), self.size
        self.silent -= node["tag"] in ("script", "style")



def parse(html: str | None) -> tuple[list[dict], str, list[str]]:
    """Elements, text and JSON-LD bodies. Text offsets count code points, as Spark's substring does."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    for node in reader.open:
        reader._end(node)
    return reader.nodes, "".join(reader.text), reader.ld


def _parser(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES_PER_BATCH):
                part = batch.slice(start, PAGES_PER_BATCH)
                parsed = [parse(h.as_py()) for h in part.column("html")]
                columns = [part.column(c) for c in keep] + [
                    pa.array([p[0] for p in parsed], pa.list_(_NODE)), pa.array([p[1] for p in parsed], pa.string()),
                    pa.array([p[2] for p in parsed], pa.list_(pa.string())),
                    pa.array([[p[1][i:i + PIECE] for i in range(0, len(p[1]), PIECE)] for p in parsed], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "nodes", "page_text", "ld", "page_pieces"])
    return run


def read_nodes(pages: DataFrame, keep_html: bool = False) -> DataFrame:
    """Columns of ``pages`` (``html`` only on request) plus ``nodes``, ``page_text``, ``ld`` and ``page_pieces``.

    Narrow and filter ``pages`` first: neither reaches through the Python step.
    """
    kept = [f for f in pages.schema.fields if keep_html or f.name != "html"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return pages.mapInArrow(
        _parser([f.name for f in kept]), f"{ddl}, nodes {NODES_DDL}, page_text string, ld array<string>, page_pieces array<string>")
