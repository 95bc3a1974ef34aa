"""Skeletons and spans against Python's own parser, and lines by brute force."""

import ast
import glob
import os
import re
import sysconfig

import pytest

from tessera.operators import evaluation, skeletons
from tessera.plans import queries

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
STD = sysconfig.get_paths()["stdlib"]
FILES = sorted(glob.glob(f"{HERE}/tessera/*/*.py")) + [f"{STD}/{n}.py" for n in ("ast", "dataclasses", "argparse", "functools", "inspect", "typing", "textwrap", "json/decoder", "asyncio/tasks", "csv", "heapq", "tokenize", "turtle", "contextlib")]
ODD = '''@a(
    1)
@b
class C(
    X, y=[1,
2]):
    """doc"""

    def one(self): return 1

    @staticmethod
    def two(x,  # a comment: with colon
            y={"k": ")"}) -> int:  # so
        # only a comment
        """Doc
        more
        """
        async def inner():
            @deco
            def deep():
                pass
            return deep
        return 2  # end
        # trailing comment

    async \\
      def three(self):
        r"""raw"""

x = lambda: 0
def four():
    f"""no docstring {x}"""
    if x: y = 1
    else:
        z = """
def not_one():
"""
def five(): pass
def six():

    @deco
    def in_six(): ...
class D: pass
'''


def brute(source):
    tree = ast.parse(source)
    found, raw = [], []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            found.append((node.lineno, node.name, first, node.end_lineno))
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            doc = node.body[0]
            is_doc = isinstance(doc, ast.Expr) and isinstance(doc.value, ast.Constant) and isinstance(doc.value.value, str)
            start = doc.end_lineno + 1 if is_doc else doc.lineno
            if node.lineno < start <= node.end_lineno:
                raw.append((start, node.end_lineno))
    return sorted(found), raw


def spans(source):
    # A decorator begins at its sign, which the parser's line of the decorator is too unless it is written over lines.
    return sorted((d["line"], d["name"], d["first"], d["last"]) for d in skeletons.python_spans(source))


@pytest.mark.parametrize("path", FILES)
def test_spans_are_the_parsers(path):
    with open(path, encoding="utf-8") as f:
        source = f.read()
    found, raw = brute(source)
    assert spans(source) == found
    assert sorted(d["body"] for d in skeletons.python_spans(source) if d["body"]) == sorted(raw)


def test_odd_layouts():
    found, raw = brute(ODD)
    assert spans(ODD) == found
    assert sorted(d["body"] for d in skeletons.python_spans(ODD) if d["body"]) == sorted(raw)
    text = skeletons.python_skeleton(ODD, skeletons.python_spans(ODD))
    assert text.count("elided") == 5 and text.endswith("def six():\n\n    @deco\n    ... # 1 line elided\nclass D: pass")


@pytest.mark.parametrize("source", ["def f(:\n", "x = (1\n", "x = 'open\n", '"""open\n', "def f():\n        a\n    b\n", "  x = 1\n", "def f():\n", "x = )\n", "if a:\nb\n"])
def test_broken_files_say_so(source):
    with pytest.raises(SyntaxError):
        ast.parse(source)
    try:
        assert skeletons.python_spans(source) == [] or source == "def f(:\n"
    except skeletons.Broken:
        pass


def brute_lines(source):
    marks = re.compile(skeletons.STRUCTURE)
    closer = re.compile(skeletons.CLOSER)
    out, run = [], 0

    def end():
        if run:
            out.append(f"    ... # {run} line{'s' if run > 1 else ''} elided")

    for line in source.removesuffix("\n").split("\n"):
        if not line.strip() or not line[0] in " \t" or marks.match(line) or closer.match(line):
            end()
            run = 0
            out.append(line)
        else:
            run += 1
    end()
    return "\n".join(out)


def test_table_of_files(spark):
    js = "function a() {\n  let x = 1;\n  let y = 2;\n  return x;\n}\n\nexport class B {\n  private z = 1;\n    go() {\n      run();\n    }\n}\n"
    rows = [("a.js", js), ("b.py", ODD), ("broken.py", "def f(:\n    x = (1\n    y = 2\nz\n"), ("empty.py", ""), ("null.py", None), ("null.go", None), ("long.py", "def f():\n" + "    x = 1\n" * 50_000), ("one.rs", "  fn x() {\n    y\n  }")]
    got = {r["path"]: (r["skeleton"], r["method"]) for r in skeletons.skeletons(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a.js"] == (brute_lines(js), "lines") and got["one.rs"] == (brute_lines(rows[-1][1]), "lines")
    assert got["b.py"] == (skeletons.python_skeleton(ODD, skeletons.python_spans(ODD)), "definitions")
    assert got["broken.py"] == (brute_lines(rows[2][1]), "lines")
    assert got["long.py"] == ("def f():\n    ... # 50000 lines elided", "definitions")
    assert {got[p][0] for p in ("empty.py", "null.py", "null.go")} == {""}
    assert skeletons.skeletons(spark.createDataFrame([], "path string, text string")).count() == 0


def test_files_are_read_once_without_a_shuffle(spark):
    """before, texts were joined with themselves and each line was a row of a window."""
    files = spark.createDataFrame([("a.py", "def f():\n    x = 1\n"), ("b.js", "x")], "path string, text string")
    plan = skeletons.skeletons(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan


def test_plain_lines_are_read_like_all_others(monkeypatch):
    sources = [ODD, 'x = "a" "b"\n', 'x = """a\nb"""\n', 'if a:\n\tv = ""\n\tw = "q""r"\n', 'x = r"a"""\ny\n', "\fx\n\n  y = 1", 'a = "b\n', 'x"\n"\n', "a\r\nb\r\n", 'z = "a""""b"""\n']

    def read(source):
        try:
            return skeletons.logical_lines(source)
        except skeletons.Broken as e:
            return str(e)

    fast = [read(x) for x in sources]
    monkeypatch.setattr(skeletons, "_PLAIN", re.compile("(?!)"))
    assert fast == [read(x) for x in sources]


def test_savings_are_told_by_file_folder_and_for_all(spark):
    """before, the query gave sums by top folder only, and a null path was one with the total."""
    files = spark.createDataFrame([("a/x.py", "12345678", "1234"), ("a/y.py", "12345", "12345"), ("b", "123", ""), (None, "1234", "1"), ("b/null.js", None, "")], "path string, text string, skeleton string")
    got = sorted((tuple(r) for r in evaluation.skeleton_savings(files).collect()), key=str)
    assert got == sorted([
        ("file", "a/x.py", 2, 1, 0.5), ("file", "a/y.py", 2, 2, 0.0), ("file", "b", 1, 0, 1.0), ("file", None, 1, 1, 0.0), ("file", "b/null.js", 0, 0, None),
        ("folder", "a", 4, 3, 0.25), ("folder", "b", 1, 0, 1.0), ("folder", None, 1, 1, 0.0), ("all", None, 6, 4, 0.333333),
    ], key=str)
    d = "/root/testdata/sf0.001"
    files = queries.queries()["skeleton_savings"](spark, d).where("level = 'file'")
    assert files.count() == files.select("path").distinct().count() == spark.read.parquet(f"{d}/documents.parquet").count()
