"""Stored pages as a table of nodes: a tokenizer with a stack of open tags, run over Arrow batches.

Nested cells and lists, tags that are never closed, end tags without a start and attributes in any order or quoting come out
as a browser would nest them; comments, scripts and styles are no markup. One row per element; what a page holds is then
asked of the rows with ordinary filters and joins.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

# Fixed values of the markup language: elements without content, with raw text, and which open elements a start tag ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style"}
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDS = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
        "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})} | {b: ({"p"}, {"td", "th", "li", "div", "table", "button"}) for b in BLOCKS}
BREAKS = BLOCKS | ENDS.keys() | {"br", "table"}

_TAG = re.compile(r"""<!--.*?(?:-->|$)|<![^>]*>|<(/?)([A-Za-z][A-Za-z0-9-]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>=`]+)))?""")
AT_ONCE = 4 << 20  # characters of text, and 64 for every element, that a task turns into one Arrow batch
NODES = "node int, parent int, depth int, tag string, attributes map<string,string>, text string, cell int"


def nodes_of(page: str) -> list[tuple]:
    """(node, parent, depth, tag, attributes, text, cell) of every element in page order; node 0 is the page itself.

    ``text`` is all text inside with blanks collapsed, ``cell`` the nearest table cell around the element.
    """
    out: list[list] = [[0, None, 0, "", {}, [], None]]
    stack, at = [0], 0

    def text(part: str) -> None:
        if part:
            for n in stack:
                out[n][5].append(part)

    while found := _TAG.search(page, at):
        text(page[at : found.start()])
        at = found.end()
        closing, tag = found[1], (found[2] or "").lower()
        if not tag:
            continue
        if tag in BREAKS:
            text(" ")
        if closing:
            if any(out[n][3] == tag for n in stack[1:]):
                while out[stack.pop()][3] != tag:
                    pass
            continue
        ended, walls = ENDS.get(tag, ((), ()))
        for depth in range(len(stack) - 1, 0, -1):
            name = out[stack[depth]][3]
            if name in ended:
                del stack[depth:]
                break
            if name in walls:
                break
        attributes = {}
        for a in _ATTRIBUTE.finditer(found[3]):
            attributes.setdefault(a[1].lower(), html.unescape(next((v for v in a.groups()[1:] if v is not None), "")))
        cell = next((n for n in reversed(stack) if out[n][3] in ("td", "th")), None)
        out.append([len(out), stack[-1], len(stack), tag, attributes, [], cell])
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = end.start() if end else len(page)
        if tag not in VOID and not found[3].endswith("/"):
            stack.append(len(out) - 1)
    text(page[at:])
    return [(n, parent, depth, tag, attributes, " ".join(html.unescape("".join(parts)).split()), cell) for n, parent, depth, tag, attributes, parts, cell in out]


def node_batches(key: Sequence[str]):
    """Arrow batches of the key and the source to Arrow batches of elements, each of some pages only."""
    names = [*key, *[c.split()[0] for c in NODES.split(", ")]]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32()]

    def batch_of(keys: list[pa.Array], of: list[int], rows: list[tuple]) -> pa.RecordBatch:
        values = [pa.array([list(v.items()) for v in c] if t == types[4] else c, t) for c, t in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays([*[k.take(pa.array(of, pa.int64())) for k in keys], *values], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sources = [batch.column(i) for i in range(len(key))], batch.column(len(key))
            of, rows, size = [], [], 0
            for i in range(batch.num_rows):
                found = nodes_of(sources[i].as_py() or "")
                of += [i] * len(found)
                rows += found
                size += sum(64 + len(n[5]) for n in found)
                if size >= AT_ONCE:
                    yield batch_of(keys, of, rows)
                    of, rows, size = [], [], 0
            if rows:
                yield batch_of(keys, of, rows)

    return run


def page_nodes(pages: DataFrame, key: Sequence[str], source: str = "html") -> DataFrame:
    """One row per element of every page, node 0 for the page itself; a null page has node 0 only."""
    key = list(key)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select(*key, source).mapInArrow(node_batches(key), ", ".join(f"{k} {kinds[k]}" for k in key) + ", " + NODES)


def node_links(nodes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every link of a page with its place, target and text."""
    w = Window.partitionBy(*key).orderBy("node")  # the links of one page
    found = nodes.where((F.col("tag") == "a") & F.col("attributes")["href"].isNotNull())
    return found.select(*key, (F.row_number().over(w) - 1).alias("place"), F.col("attributes")["href"].alias("href"), "text")


def node_cells(nodes: DataFrame, key: Sequence[str], cell_class: str | None = None, inner: str = "p") -> DataFrame:
    """Stat cells in page order, as ``pages.stat_cells`` gives them: the lines of a cell belong to side A and B in turn.

    A cell's lines are its own ``inner`` elements, not those of cells nested in it; a cell without any is one line of its own
    text. A page without cells stays, with one row of NULLs.
    """
    key = list(key)
    cells = nodes.where(F.col("tag").isin("td", "th"))
    if cell_class:
        cells = cells.where(F.array_contains(F.split(F.coalesce(F.col("attributes")["class"], F.lit("")), r"\s+"), cell_class))
    w = Window.partitionBy(*key).orderBy("node")  # the cells of one page
    numbered = cells.select(*key, F.col("node").alias("of"), F.col("text").alias("whole"), (F.row_number().over(w) - 1).alias("place"))
    lines = nodes.where(F.col("tag") == inner).select(*key, F.col("cell").alias("of"), F.col("node").alias("at"), "text")
    both = numbered.join(lines, [*key, "of"], "left")
    line = F.row_number().over(Window.partitionBy(*key, "of").orderBy("at")) - 1  # the lines of one cell
    rows = both.select(*key, F.col("place").alias("cell"), line.alias("line"), F.coalesce("text", "whole").alias("value"))
    rows = rows.select(*key, "cell", (F.col("line") % 2).alias("side"), F.floor(F.col("line") / 2).cast("int").alias("pair"), "value")
    return nodes.where(F.col("node") == 0).select(*key).join(rows, key, "left")
