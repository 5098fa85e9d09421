"""Facts about Python source, read from the syntax tree. Source is parsed, never run.

One parse of a file gives both the facts that rules look at and the tools that it defines.
"""

from __future__ import annotations

import ast
import math
import time
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Every file has a fact of kind "file" besides: ``name`` says why it could not be read whole (else null), ``nanos`` how long it took.
FACTS = "skill_id string, path string, fact_ord int, kind string, name string, line_number int, detail string, length int, entropy double, snippet string, nanos long"
TOOLS = "skill_id string, path string, tool_ord int, name string, description string, return_direct boolean"


def entropy(text: str) -> float:
    n = len(text)
    return sum(-c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def dotted(node: ast.AST) -> str | None:
    """a.b.c of a chain of names, however long; None for anything else."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


#: Constants that add up to more are an error of the file: names that double each other would fill any memory.
MAX_CONSTANT = 1_000_000


def constant(node: ast.AST | None, names: dict[str, str] | None = None) -> str | None:
    """The string that an expression of literals adds up to; ``names`` and f-strings only where given."""
    parts, left = [], [node]
    while left:
        match left.pop():
            case ast.Constant(value=str(s)):
                parts.append(s)
            case ast.BinOp(left=a, op=ast.Add(), right=b):
                left += [b, a]
            case ast.Name(id=i) if names is not None and i in names:
                parts.append(names[i])
            case ast.JoinedStr(values=vs) if names is not None:
                left += vs[::-1]
            case _:
                return None
    if sum(map(len, parts)) > MAX_CONSTANT:
        raise ValueError("a constant is too long")
    return "".join(parts)


def _mode(call: ast.Call) -> str:
    given = [k.value for k in call.keywords if k.arg == "mode"] or call.args[1:2]
    texts = [g.value for g in given if isinstance(g, ast.Constant) and isinstance(g.value, str)]
    return texts[-1] if texts else "r"


def _assembled(call: ast.Call) -> str | None:
    """The name that getattr is given, for getattr(...) and getattr(...)()."""
    for c in (call, call.func):
        if isinstance(c, ast.Call) and dotted(c.func) == "getattr" and len(c.args) >= 2 and (name := constant(c.args[1])) is not None:
            return name
    return None


def facts(source: str) -> Iterator[tuple]:
    """(kind, name, line, detail, length, entropy, snippet) in breadth-first order."""
    lines = source.splitlines()

    def at(node: ast.AST) -> str | None:
        return lines[node.lineno - 1].strip() if 1 <= node.lineno <= len(lines) else None

    for node in ast.walk(ast.parse(source)):
        value = None
        match node:
            case ast.Import(names=names):
                for a in names:
                    yield "import", a.name.split(".")[0], node.lineno, None, None, None, at(node)
            case ast.ImportFrom(module=str(m)):
                yield "import", m.split(".")[0], node.lineno, None, None, None, at(node)
            case ast.Assign():
                value = node.value
                for t in node.targets:
                    if isinstance(t, ast.Subscript) and dotted(t.value) == "os.environ":
                        yield "env_write", "os.environ", node.lineno, None, None, None, at(node)
            case ast.Return():
                value = node.value
            case ast.Call():
                if name := dotted(node.func):
                    detail = None
                    if name == "open":
                        detail = _mode(node)
                    elif name in ("eval", "exec") and node.args:
                        inner = (x for x in ast.walk(node.args[0]) if isinstance(x, ast.Call))
                        detail = "b64" if any(dotted(x.func) == "base64.b64decode" for x in inner) else None
                    yield "call", name, node.lineno, detail, None, None, at(node)
                if name := _assembled(node):
                    yield "getattr", name, node.lineno, None, None, None, at(node)
        if value is not None:
            for c in ast.walk(value):
                if isinstance(c, ast.Constant) and isinstance(c.value, str):
                    s = c.value
                    yield "literal", None, c.lineno, "url" if "://" in s else None, len(s), entropy(s), s if len(s) <= 80 else s[:80] + "..."


def tools(source: str) -> Iterator[tuple[str, str, bool]]:
    """(name, description, return_direct) of the tools that a file constructs."""
    tree = ast.parse(source)
    makers, names = {"Tool"}, {}
    for node in tree.body:
        if isinstance(node, ast.ImportFrom) and "langchain" in (node.module or ""):
            makers |= {a.asname or a.name for a in node.names if a.name == "Tool"}
        elif isinstance(node, ast.Assign | ast.AnnAssign) and (text := constant(node.value, names)) is not None:
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(t, ast.Name):
                    names[t.id] = text
    for node in ast.walk(tree):
        if not isinstance(node, ast.Call):
            continue
        f = node.func
        if not (isinstance(f, ast.Name) and f.id in makers or isinstance(f, ast.Attribute) and f.attr == "Tool"):
            continue
        given = {k.arg: k.value for k in node.keywords if k.arg}
        direct = given.get("return_direct")
        yield constant(given.get("name"), names) or "unnamed_tool", constant(given.get("description"), names) or "", isinstance(direct, ast.Constant) and direct.value is True


#: What a file can do to whoever reads it.
UNREADABLE = (SyntaxError, ValueError, TypeError, RecursionError, MemoryError)


def read(source: str | None, reader) -> tuple[list[tuple], str | None]:
    """What ``reader`` finds in a source, and why it did not get to its end, if so; what it had found by then counts."""
    found: list[tuple] = []
    if source is None:
        return found, "not valid UTF-8"
    try:
        for row in reader(source):
            found.append(row)
    except UNREADABLE as e:
        return found, type(e).__name__
    return found, None


def fact_table(sources: DataFrame) -> DataFrame:
    """(skill_id, path, content) to facts; the time of a file is taken where it is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FACTS.split(", ")]
        for b in batches:
            rows = []
            for skill, path, text in zip(b["skill_id"], b["path"], b["content"], strict=True):
                began = time.perf_counter_ns()
                found, problem = read(text, facts)
                rows += [(skill, path, i, *r, None) for i, r in enumerate(found)]
                rows.append((skill, path, -1, "file", problem, None, None, None, None, None, time.perf_counter_ns() - began))
            yield pd.DataFrame(rows, columns=names).astype({"line_number": "Int32", "length": "Int32", "nanos": "Int64"})

    return sources.select("skill_id", "path", "content").mapInPandas(run, FACTS)


def unread(facts_: DataFrame) -> DataFrame:
    """(path, reason) of files that could not be read to their end."""
    return facts_.where("kind = 'file' AND name IS NOT NULL").selectExpr("path", "concat('Python source not read: ', name) AS reason").distinct()


def file_times(facts_: DataFrame) -> DataFrame:
    """(skill_id, nanos): the time that reading a skill's sources took."""
    return facts_.where("kind = 'file'").groupBy("skill_id").agg({"nanos": "sum"}).withColumnRenamed("sum(nanos)", "nanos")


def tool_table(sources: DataFrame) -> DataFrame:
    """(skill_id, path, content) to the tools defined there; a file that is not read whole is among the facts' ``unread``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TOOLS.split(", ")]
        for b in batches:
            each = zip(b["skill_id"], b["path"], b["content"], strict=True)
            yield pd.DataFrame([(skill, path, i, *r) for skill, path, text in each for i, r in enumerate(read(text, tools)[0])], columns=names)

    return sources.select("skill_id", "path", "content").mapInPandas(run, TOOLS)
