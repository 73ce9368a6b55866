"""Start tags, text and end tags of markup that may be broken, and character references."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+))""")
#: What markup is made of: comments, sections of plain characters, declarations, end tags, start tags,
#: and a tag that the end cuts off, which is dropped. What looks like none is text.
PIECE = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<plain>.*?)(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<![A-Za-z](?:\[[^\]]*\]|[^>\[])*(?:>|\Z)"""
    r"""|</\s*(?P<close>[^\s<>/]+)[^<>]*>|<(?P<open>[A-Za-z_][^\s<>/]*)(?P<attributes>(?:"[^"]*"|'[^']*'|[^<>"'])*?)(?P<empty>/?)>|<[/A-Za-z_][^<>]*\Z""",
    re.S,
)


def unescaped(s: str) -> str:
    """Character references with their semicolon; names that nothing has stay as they are."""
    known = lambda m: html.unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0])
    return REFERENCE.sub(known, s) if "&" in s else s


def local(name: str) -> str:
    """A name without its name space."""
    return name.rpartition(":")[2]


def events(source: str) -> Iterator[tuple[str, str, dict]]:
    """(kind, name or text, attributes) in order, kinds open, close and text.

    Every element that opens closes: an end tag closes what is still open inside its element, one that matches no open
    element is passed over, and what is open at the end closes there. So broken markup keeps all of its text.
    """
    standing: list[str] = []
    at = 0
    for m in PIECE.finditer(source):
        if m.start() > at:
            yield "text", unescaped(source[at : m.start()]), {}
        at = m.end()
        if m["open"]:
            name = local(m["open"])
            yield "open", name, {local(a): unescaped(next(v for v in (b, c, d) if v or v == "")) for a, b, c, d in ((x[1], x[2], x[3], x[4]) for x in ATTRIBUTE.finditer(m["attributes"]))}
            if m["empty"]:
                yield "close", name, {}
            else:
                standing.append(name)
        elif m["close"]:
            name = local(m["close"])
            if name in standing:
                while True:
                    last = standing.pop()
                    yield "close", last, {}
                    if last == name:
                        break
        elif m["plain"]:
            yield "text", m["plain"], {}
    if at < len(source):
        yield "text", unescaped(source[at:]), {}
    while standing:
        yield "close", standing.pop(), {}


# ---------------------------------------------------------------- columns


def resolve(c: Column) -> Column:
    """All character references of HTML as their characters, in Arrow batches; for short strings that were cut out before."""

    def run(x: pa.Array) -> pa.Array:
        return pa.array([s if s is None or "&" not in s else html.unescape(s) for s in x.to_pylist()], pa.string())

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(c)


def tags(c: Column, name: str) -> Column:
    """Start tags of a name, whole, in order; a > between quotes ends none."""
    return F.regexp_extract_all(c, F.lit(rf"""(?is)<{name}\b(?:"[^"]*"|'[^']*'|[^>"'])*>"""), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """Value of a start tag's attribute, in either quotes or none, as it is written; '' if it has none."""
    form = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, form, i) for i in (1, 2, 3)])
