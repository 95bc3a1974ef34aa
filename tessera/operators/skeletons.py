"""Skeletons and symbol spans over a table of source files.

``line_skeletons`` is all built-in functions: lines that carry structure stay, runs of others become one
line that counts them.  Python files are scanned by a small state machine in Arrow batches: brackets and
strings join lines to logical ones, indentation nests them.  A file that the scanner can't read (an open
bracket or string, an indentation that fits no outer one) is a row with ``ok`` false and no spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that begin a line of structure, and lines that only close a block.
MARKERS = (
    "async\\s+def", "def", "class", "@", "export\\s+default", "export", "import", "from", "public", "private", "protected", "internal", "static", "abstract",
    "function", "func", "fn", "interface", "type", "struct", "enum", "impl", "trait", "module", "package", "namespace",
)
STRUCTURE = "^\\s*(?:" + "|".join(MARKERS) + ")\\b"
CLOSER = "^\\s*[)}\\]]+;?\\s*$"
#: What stays of a text: blank lines, lines without indentation, structure and closers, in one pattern.
KEPT = "^(?:[^ \\t]|\\s*(?:$|(?:" + "|".join(MARKERS) + ")\\b|[)}\\]]+;?\\s*$))"


def _elided(n: Column) -> Column:
    return F.concat(F.lit("    ... # "), n.cast("string"), F.when(n == 1, " line").otherwise(" lines"), F.lit(" elided"))


def _with(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(c), use), 1)


def _line_skeleton(c: Column) -> Column:
    """The skeleton of one text by its lines, without a row for each line: kept lines, and before each what was left out since the last one."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\\r\\n?", "\n"), "\n$", "")

    def kept(lines: Column) -> Column:
        told = F.transform(lines, lambda line, n: F.when(line.rlike(KEPT), F.struct(n.alias("n"), line.alias("line"))))
        # A last row behind the text shows what was left out at its end.
        return F.concat(F.array_compact(told), F.array(F.struct(F.size(lines).alias("n"), F.lit(None).cast("string").alias("line"))))

    def shown(rows: Column) -> Column:
        before = F.concat(F.array(F.lit(-1)), F.transform(rows, lambda x: x["n"]))
        gaps = F.zip_with(rows, before, lambda x, b: F.struct(x["line"].alias("line"), (x["n"] - b - 1).alias("gap")))
        return F.flatten(F.transform(gaps, lambda x: F.array_compact(F.array(F.when(x["gap"] > 0, _elided(x["gap"])), x["line"]))))

    return F.array_join(_with(_with(F.split(body, "\n"), kept), shown), "\n")


def line_skeletons(files: DataFrame) -> DataFrame:
    """Rows (path, text, skeleton) of files (path, text) in any language, by their lines alone; no shuffle.

    Blank lines, lines without indentation, lines that begin with a marker and lines that only close a block stay.  A null text is an
    empty one.
    """
    return files.select("path", "text", _line_skeleton(F.col("text")).alias("skeleton"))


_TOKEN = re.compile(
    r"(?P<string>(?i:\b[rbuf]{1,2})?(?:'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'(?:[^\\\n']|\\.)*'|\"(?:[^\\\n\"]|\\.)*\"))|(?P<comment>#[^\n]*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<joined>\\\n)|(?P<line>\n)|(?P<bad>['\"])",
    re.DOTALL,
)
#: A line of code that ends where it stands: no bracket, comment or backslash, and strings only between plain double quotes.
_PLAIN = re.compile(r"""([ \t]*)([^\s'"#()\[\]{}\\][^'"#()\[\]{}\\\n]*(?:(?:"[^"\\\n]+"|""(?!"))[^'"#()\[\]{}\\\n]*)*)\n""")
_PAIRS = {")": "(", "]": "[", "}": "{"}
_HEAD = re.compile(r"(?:(async)[ \t\\\n]+)?(def|class)[ \t\\\n]+(\w+)")


class Broken(ValueError):
    """A file that the scanner can't read."""


def logical_lines(source: str) -> list[tuple[int, int, int, str, bool]]:
    """(first line, last line, indentation, text, only strings) of each line that has code; lines count from 1."""
    out, stack = [], []
    start, number, first, rest_is_code = 0, 1, 1, False

    def ended(at: int) -> None:
        text = source[start:at]
        bare = text.lstrip(" \t\f\n")
        if rest_is_code or strings:
            lead = text[: len(text) - len(bare)]
            out.append((first + lead.count("\n"), number, len(lead.rpartition("\n")[2].expandtabs(8)), bare, not rest_is_code and bool(strings)))

    at, strings = 0, 0
    while at <= len(source):
        if at == start and not stack and (m := _PLAIN.match(source, at)):
            out.append((number, number, len(m[1].expandtabs(8)), m[2], False))
            start = at = m.end()
            number += 1
            first = number
            continue
        m = _TOKEN.search(source, at)
        stop = m.start() if m else len(source)
        rest_is_code = rest_is_code or bool(source[at:stop].strip())
        if not m:
            if stack:
                raise Broken("an open bracket")
            ended(len(source))
            return out
        kind, at = m.lastgroup, m.end()
        if kind == "bad":
            raise Broken("an open string")
        if kind == "string":
            strings += 1
            plain = source[m.start()] in "'\"rRuU" and source[m.start() : m.start() + 2].lower() not in ("rb", "rf")
            rest_is_code = rest_is_code or not plain
        elif kind == "open":
            stack.append(m.group())
            rest_is_code = True
        elif kind == "close":
            if not stack or stack.pop() != _PAIRS[m.group()]:
                raise Broken("a bracket that none opens")
        if kind == "line" and not stack:
            ended(m.start())
            start, first, rest_is_code, strings = at, number + 1, False, 0
        number += m.group().count("\n")
    return out


def python_spans(source: str) -> list[dict]:
    """Definitions of a file: name, kind, ``line`` of the def, ``first`` (decorators included), ``last``, and ``body``.

    ``body`` is (first, last) of what a skeleton leaves out of a function: all below its signature but a docstring; None for
    classes and where the signature's line holds the body.
    """
    lines = logical_lines(source)
    indents, found, open_, decorated = [0], [], [], None
    expects = False
    for first, last, indent, text, only_strings in lines:
        if expects:
            if indent <= indents[-1]:
                raise Broken("a block without lines")
            indents.append(indent)
        elif indent > indents[-1]:
            raise Broken("an indentation without a block")
        while indent < indents[-1]:
            indents.pop()
        if indent != indents[-1]:
            raise Broken("an indentation that fits no outer one")
        while open_ and open_[-1]["indent"] >= indent:
            open_.pop()
        for d in open_:
            d["last"] = last
            # What the body begins with: a docstring stays, a decorator too, since a definition begins at its def.
            if d["state"] == "head":
                d["state"] = "doc" if only_strings else "deco" if text.startswith("@") else "body"
                d["from"] = last + 1 if only_strings else first
            elif d["state"] == "deco" and not text.startswith("@"):
                d["state"], d["from"] = "body", first
        if text.startswith("@"):
            decorated = first if decorated is None else decorated
            expects = False
            continue
        head = _HEAD.match(text)
        bare = _strip_comment(text)
        expects = bare.endswith(":")
        if head:
            d = {"name": head.group(3), "kind": head.group(2), "line": first, "first": first if decorated is None else decorated, "last": last, "indent": indent, "from": None, "state": "head" if expects else "line"}
            found.append(d)
            if expects:
                open_.append(d)
        decorated = None
    if expects:
        raise Broken("a block without lines")
    out = []
    for d in found:
        inner = d["kind"] == "def" and d["from"] is not None and d["line"] < d["from"] <= d["last"]
        out.append({"name": d["name"], "kind": d["kind"], "line": d["line"], "first": d["first"], "last": d["last"], "body": (d["from"], d["last"]) if inner else None})
    return out


def _strip_comment(text: str) -> str:
    """A logical line without the comment behind it."""
    if "#" not in text:
        return text.rstrip()
    end = len(text)
    for m in _TOKEN.finditer(text):
        if m.lastgroup == "comment" and "\n" not in text[m.end() :].rstrip():
            end = m.start()
    return text[:end].rstrip()


def python_skeleton(source: str, spans: list[dict]) -> str:
    """The file with each outermost function body as one line that counts what is left out."""
    lines, out, upto = source.split("\n"), [], 0
    bodies = sorted((d["body"] for d in spans if d["body"]), key=lambda b: (b[0], -b[1]))
    if bodies and lines and lines[-1] == "":
        lines.pop()
    for first, last in bodies:
        if first <= upto:
            continue
        line = lines[first - 1]
        n = last - first + 1
        out += lines[upto : first - 1] + [" " * (len(line) - len(line.lstrip(" "))) + f"... # {n} line{'s' if n > 1 else ''} elided"]
        upto = last
    return "\n".join(out + lines[upto:])


def _scanned(text: str | None) -> tuple[str | None, list[dict]]:
    """(skeleton, spans) of a file, (None, []) of one that the scanner can't read."""
    source = (text or "").replace("\r\n", "\n")
    try:
        found = python_spans(source)
    except Broken:
        return None, []
    return python_skeleton(source, found), found


def scan_python(files: DataFrame) -> DataFrame:
    """Rows (path, ok, skeleton, spans) of Python files (path, text); a null text is an empty one.

    ``spans``: name, kind, line, first, last of each definition, in order of its line.  Lines end with \\n or \\r\\n.
    """
    names = ["name", "kind", "line", "first", "last"]
    span = pa.list_(pa.struct([(n, pa.string() if n in ("name", "kind") else pa.int32()) for n in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                skeleton, found = _scanned(text)
                out.append((skeleton is not None, skeleton, [{n: d[n] for n in names} for d in found]))
            ok, skeleton, spans = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ok, pa.bool_()), pa.array(skeleton, pa.string()), pa.array(spans, span)], ["path", "ok", "skeleton", "spans"])

    return files.select("path", "text").mapInArrow(run, "path string, ok boolean, skeleton string, spans array<struct<name: string, kind: string, line: int, first: int, last: int>>")


def skeletons(files: DataFrame) -> DataFrame:
    """Rows (path, text, skeleton, method): Python by its definitions; all else, and Python that can't be read, by lines.

    A file's text goes along with its scan, so each is scanned once and no text is joined.
    """
    is_python = F.coalesce(F.col("path").rlike("(?i)\\.pyi?$"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_scanned(text)[0] for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string())], ["path", "text", "skeleton"])

    python = files.where(is_python).select("path", "text").mapInArrow(run, "path string, text string, skeleton string")
    method = F.when(F.col("skeleton").isNotNull(), "definitions").otherwise("lines")
    # The scanner's text comes back as it was; lines count only where there is no skeleton yet.
    python = python.select("path", "text", F.coalesce("skeleton", _line_skeleton(F.col("text"))).alias("skeleton"), method.alias("method"))
    return python.unionAll(line_skeletons(files.where(~is_python)).withColumn("method", F.lit("lines")))
