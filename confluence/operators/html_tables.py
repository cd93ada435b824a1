"""Tables of web pages as rows.

Open elements form a stack: an end tag closes the newest open element of its name and all that was opened
inside, one without an open element is ignored, and what is open at the end of the page ends there.  Only
``table``, ``tr``, ``td`` and ``th`` nest; other tags are passed over, as are comments, scripts and styles.  A
nested table's rows and cells belong to the outer table and row too, in the order in which they begin.  A cell's
text is that of its text nodes, each without white space around it, entities decoded, put together without blanks.

Pages are read where they lie, a batch at a time, and nothing is shuffled.  This is Python as SQL's ``aggregate`` copies
its state at every step: a table of 6,000 rows takes a minute there.  The work grows with a page's tags times
the depth at which they are nested.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = ("td", "th")
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|(?P<text><[^<]*|[^<]+)""",
    re.S | re.I,
)


def tables(page: str) -> list[list[list[tuple[str, list[str]]]]]:
    """The page's tables in order, each a list of rows, each a list of cells (tag, stretches of text)."""
    found, stack = [], []  # the stack holds (tag, what the element holds)
    for token in _TOKEN.finditer(page):
        if (text := token["text"]) is not None:
            text = entities.unescape(text).strip()
            for name, held in stack if text else ():
                if name in CELLS:
                    held.append(text)
            continue
        name = (token["name"] or "").lower()
        if name not in ("table", "tr", *CELLS):
            continue
        if token["end"]:
            at = max((i for i, (n, _) in enumerate(stack) if n == name), default=len(stack))
            del stack[at:]
            continue
        held = []
        for outer, holds in stack:
            if outer == "table" and name == "tr":
                holds.append(held)
            elif outer == "tr" and name in CELLS:
                holds.append((name, held))
        if name == "table":
            found.append(held)
        if not token[0].endswith("/>"):
            stack.append((name, held))
    return found


def rows_of(page: str, names: list[tuple[str, ...]], head: tuple[str, ...], body: tuple[str, ...], first: bool) -> list[list[str]]:
    """The rows of the page's first table with all the headers: the wanted cells of each (see ``columns``)."""
    for table in tables(page):
        if not table:
            continue
        texts = [[("".join(parts)) for name, parts in row if name in kinds] for row, kinds in zip(table, [head] + [body] * (len(table) - 1))]
        at = [next((i for i, title in enumerate(texts[0]) if title in some), None) for some in names]
        if None in at:
            continue
        rows = [[row[i] for i in at] for row in texts[1:] if len(row) > max(at) and row[at[0]]]
        if rows or first:
            return rows
    return []


def columns(pages: DataFrame, names: dict[str, tuple[str, ...]], html: str = "html", key: str = "page_id", head: tuple[str, ...] = CELLS, body: tuple[str, ...] = CELLS, first: bool = False) -> DataFrame:
    """(key, pos, a column for each of ``names``): columns of each page's first table whose header row has them all.

    A column is the first in the header row under one of its names.  ``head`` and ``body`` say which cells count in
    the header row and in the others.  Rows that are too short are left out, as are rows whose first column
    asked for is empty; a table without any row left gives way to the next one unless ``first``.  Null and empty pages, and
    pages without such a table, have no rows; pages that share a key have theirs each.
    """
    own = pages.select(F.col(key).alias("key"), F.col(html).cast("string").alias("html"))
    schema = T.StructType([T.StructField(key, own.schema["key"].dataType), T.StructField("pos", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in names]])
    titles = list(names.values())

    def run(source):
        for batch in source:
            found = [rows_of(page or "", titles, head, body, first) for page in batch.column(1).to_pylist()]
            pages_of = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
            places = pa.array([pos for rows in found for pos in range(len(rows))], pa.int32())
            values = [pa.array([row[n] for rows in found for row in rows], pa.string()) for n in range(len(titles))]
            yield pa.record_batch([batch.column(0).take(pages_of), places, *values], [key, "pos", *names])

    return own.mapInArrow(run, schema)
