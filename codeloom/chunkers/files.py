"""Chunking of Markdown, YAML, JSON templates, Liquid and Python sources; other files fall to line windows.

A chunk is a dict (start_line, end_line, type, symbol_name, parent, content, and metrics for Python). chunk_files() runs the
chunkers over a table with Arrow batches.
"""

from __future__ import annotations

import ast
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codeloom.tables import partitions

WINDOW, OVERLAP, MOST = 75, 10, 225
SCHEMA = "file string, start_line int, end_line int, type string, symbol_name string, parent string, content string, complexity int, cognitive int, volume double, imports array<string>, calls array<string>, call_sites array<struct<symbol:string,line:int,captured:boolean>>, exports array<string>, imported_symbols map<string,array<string>>, halstead struct<n1:int,total1:int,n2:int,total2:int>"


def _chunk(start: int, end: int, kind: str, lines: list[str], name: str | None = None, parent: str | None = None, **more) -> dict:
    return {"start_line": start, "end_line": end, "type": kind, "symbol_name": name, "parent": parent, "content": "\n".join(lines[start - 1 : end]), **more}


def windows(lines: list[str], first: int = 1, last: int | None = None, kind: str = "block", name: str | None = None) -> list[dict]:
    out, last, at = [], len(lines) if last is None else last, first
    while at <= last:
        end = min(at + WINDOW - 1, last)
        if any(x.strip() for x in lines[at - 1 : end]):
            out.append(_chunk(at, end, kind, lines, name))
        if end >= last:
            break
        at += WINDOW - OVERLAP
    return out


def markdown(content: str) -> list[dict]:
    """Sections by heading, named by the path of headings above them; headings inside fences don't count."""
    lines, fence, path, cuts = content.split("\n"), None, [], []
    for n, line in enumerate(lines, 1):
        mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if mark:
            if fence is None:
                fence = mark[1]
            elif mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = None
            continue
        head = re.match(r" {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line) if fence is None else None
        if head:
            path = [p for p in path if p[0] < len(head[1])] + [(len(head[1]), head[2])]
            cuts.append((n, " > ".join(p[1] for p in path)))
    if not cuts or cuts[0][0] > 1:
        cuts.insert(0, (1, None))
    out = []
    for (start, name), (following, _) in zip(cuts, [*cuts[1:], (len(lines) + 1, None)], strict=True):
        end = following - 1
        if not any(x.strip() for x in lines[start - 1 : end]):
            continue
        out += windows(lines, start, end, "doc", name) if end - start + 1 > MOST else [_chunk(start, end, "doc", lines, name)]
    return out


def yaml(content: str) -> list[dict]:
    """One chunk per top-level key of each document; keys of later documents carry doc[n]."""
    lines = content.split("\n")
    bounds, starts = [], [0, *(i + 1 for i, x in enumerate(lines) if re.match(r"---(\s|$)", x))]
    for d, begin in enumerate(starts):
        end = next((i for i in range(begin, len(lines)) if re.match(r"---(\s|$)", lines[i])), len(lines))
        keys = [(i, m[1].strip("'\"")) for i in range(begin, end) if (m := re.match(r"([A-Za-z_'\"][^\s:#]*)\s*:(\s|$)", lines[i]))]
        many = len(starts) > 2 or (len(starts) == 2 and any(x.strip() for x in lines[: starts[1] - 1]))
        for (i, key), (j, _) in zip(keys, [*keys[1:], (end, "")], strict=True):
            bounds.append((i + 1, j, f"doc[{d}].{key}" if many else key))
    return [_chunk(a, b, "config", lines, name) for a, b, name in bounds if any(x.strip() for x in lines[a - 1 : b])] or windows(lines)


def json_template(content: str) -> list[dict]:
    """A theme template: one chunk for the file, its imports the types of its sections."""
    lines = content.split("\n")
    try:
        sections = json.loads(content).get("sections", {})
        imports = sorted({f"sections/{s['type']}" for s in sections.values() if isinstance(s, dict) and isinstance(s.get("type"), str)})
    except (ValueError, AttributeError):
        imports = []
    return [_chunk(1, len(lines), "template", lines, imports=imports)] if content.strip() else []


_TAGS = re.compile(r"\{%-?\s*(?:render|include|section)\s+['\"]([^'\"]+)['\"]")


def liquid(content: str) -> list[dict]:
    """Blocks that open a schema, style or script of their own, and the rest in windows; comments hold no imports."""
    bare = re.sub(r"\{%-?\s*comment\s*-?%\}.*?\{%-?\s*endcomment\s*-?%\}", "", content, flags=re.S)
    imports, lines, out, taken = list(dict.fromkeys(_TAGS.findall(bare))), content.split("\n"), [], set()
    for m in re.finditer(r"\{%-?\s*(schema|style|stylesheet|javascript)\s*-?%\}.*?\{%-?\s*end\1\s*-?%\}", content, re.S):
        a, b = content.count("\n", 0, m.start()) + 1, content.count("\n", 0, m.end()) + 1
        out.append(_chunk(a, b, "block", lines, m[1]))
        taken.update(range(a, b + 1))
    at = 1
    while at <= len(lines):
        end = at
        while end < len(lines) and end + 1 not in taken:
            end += 1
        if at not in taken:
            out += [c | {"imports": imports} for c in windows(lines, at, end, "template")]
        at = end + 1
        while at in taken:
            at += 1
    return sorted(out, key=lambda c: c["start_line"])


_BRANCH = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.comprehension, ast.match_case)


def cyclomatic(node: ast.AST, nodes: list[ast.AST] | None = None) -> int:
    """1 + branches; each logical operator beyond the first operand is one."""
    return 1 + sum(len(n.values) - 1 if isinstance(n, ast.BoolOp) else isinstance(n, _BRANCH) for n in nodes or ast.walk(node))


def cognitive(node: ast.AST, depth: int = 0) -> int:
    """Branches cost one and their nesting; else branches and runs of one logical operator cost one."""
    total = 0
    for child in ast.iter_child_nodes(node):
        if isinstance(child, ast.If):
            total += 1 + depth
            total += cognitive(ast.Expression(child.test), depth) + cognitive(ast.Module(child.body, []), depth + 1)
            rest = child.orelse
            while len(rest) == 1 and isinstance(rest[0], ast.If):
                total += 1 + cognitive(ast.Expression(rest[0].test), depth) + cognitive(ast.Module(rest[0].body, []), depth + 1)
                rest = rest[0].orelse
            total += 1 + cognitive(ast.Module(rest, []), depth + 1) if rest else 0
        elif isinstance(child, (ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.Match, ast.ExceptHandler)):
            total += 1 + depth + cognitive(child, depth + 1)
        elif isinstance(child, ast.BoolOp):
            total += 1 + cognitive(child, depth)
        else:
            nested = isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda))
            total += cognitive(child, depth + nested)
    return total


def halstead_counts(node: ast.AST, nodes: list[ast.AST] | None = None) -> tuple[int, int, int, int]:
    """Distinct and total operators, distinct and total operands."""
    operators, operands = Counter(), Counter()
    for n in nodes or ast.walk(node):
        if isinstance(n, (ast.operator, ast.unaryop, ast.boolop, ast.cmpop, ast.stmt, ast.Call, ast.Attribute, ast.Subscript)):
            operators[type(n).__name__] += 1
        if isinstance(n, ast.Name):
            operands[n.id] += 1
        elif isinstance(n, ast.Constant):
            operands[repr(n.value)] += 1
        elif isinstance(n, ast.arg):
            operands[n.arg] += 1
    return len(operators), sum(operators.values()), len(operands), sum(operands.values())


def call_sites(node: ast.AST, nodes: list[ast.AST] | None = None) -> list[dict]:
    """Calls of names and attributes with their lines, and whether anything is done with what they return."""
    nodes = nodes or list(ast.walk(node))
    bare = {id(n.value) for n in nodes if isinstance(n, ast.Expr)}
    found = [n for n in nodes if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute))]
    rows = [{"symbol": n.func.id if isinstance(n.func, ast.Name) else n.func.attr, "line": n.lineno, "captured": id(n) not in bare} for n in found]
    return sorted(rows, key=lambda r: (r["line"], r["symbol"], r["captured"]))


def exported(tree: ast.Module) -> list[str]:
    """__all__ if it is a plain list, else public functions, classes and names at the top."""
    names = []
    for n in tree.body:
        targets = [t.id for t in getattr(n, "targets", []) if isinstance(t, ast.Name)] if isinstance(n, ast.Assign) else []
        if "__all__" in targets and isinstance(n.value, (ast.List, ast.Tuple)):
            return [e.value for e in n.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
        names += [n.name] if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else targets
    return list(dict.fromkeys(x for x in names if not x.startswith("_")))


def imported(tree: ast.Module, nodes: list[ast.AST] | None = None) -> dict[str, list[str]]:
    """Module -> the names that are taken from it, the module's own where it is imported whole."""
    out: dict[str, list[str]] = {}
    for n in nodes or ast.walk(tree):
        if isinstance(n, ast.Import):
            for a in n.names:
                out.setdefault(a.name, []).append(a.asname or a.name)
        elif isinstance(n, ast.ImportFrom):
            out.setdefault("." * n.level + (n.module or ""), []).extend(a.name for a in n.names)
    return out


def uncovered(covered: list[tuple[int, int]], last: int) -> list[tuple[int, int]]:
    """Ranges of lines, from 1 to last, that no covered range touches."""
    out, at = [], 1
    for a, b in sorted(covered):
        if a > at:
            out.append((at, a - 1))
        at = max(at, b + 1)
    return [*out, (at, last)] if at <= last else out


def python(content: str) -> list[dict]:
    """Functions and methods with metrics, classes, and what lies between; a source that doesn't parse goes by lines."""
    lines = content.split("\n")
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return windows(lines)
    nodes = list(ast.walk(tree))
    imports = [a.name for n in nodes if isinstance(n, ast.Import) for a in n.names]
    imports += ["." * n.level + (n.module or "") for n in nodes if isinstance(n, ast.ImportFrom)]
    out, taken, exports, symbols = [], [], exported(tree), imported(tree, nodes)

    def visit(body: list[ast.stmt], parent: str | None) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                start = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                inside = list(ast.walk(n))
                n1, big1, n2, big2 = halstead_counts(n, inside)
                volume = math.floor((big1 + big2) * math.log2(n1 + n2) * 100 + 0.5) / 100 if n1 + n2 else 0.0
                calls = sorted({c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in inside if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))})
                out.append(_chunk(start, n.end_lineno, "function", lines, n.name, parent, complexity=cyclomatic(n, inside), cognitive=cognitive(n), volume=volume, imports=imports, calls=calls, call_sites=call_sites(n, inside), exports=exports, imported_symbols=symbols, halstead={"n1": n1, "total1": big1, "n2": n2, "total2": big2}))
                taken.append((start, n.end_lineno))
            elif isinstance(n, ast.ClassDef):
                start = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                first = n.body[0].lineno - 1 if n.body else n.end_lineno
                out.append(_chunk(start, max(start, first), "class", lines, n.name, parent, imports=imports, exports=exports, imported_symbols=symbols))
                taken.append((start, max(start, first)))
                visit(n.body, n.name if parent is None else f"{parent}.{n.name}")

    visit(tree.body, None)
    for a, b in uncovered(taken, len(lines)):
        out += [c | {"imports": imports, "exports": exports, "imported_symbols": symbols} for c in windows(lines, a, b)]
    return sorted(out, key=lambda c: (c["start_line"], c["end_line"]))


def chunk_file(file: str, content: str) -> list[dict]:
    """By kind: Liquid, theme JSON, Markdown, YAML, Python, else line windows."""
    name = file.lower()
    if name.endswith(".liquid"):
        return liquid(content)
    if name.endswith(".json") and re.search(r"(^|/)(templates|sections)/", name):
        return json_template(content)
    if name.endswith((".md", ".mdx", ".markdown")):
        return markdown(content)
    if name.endswith((".yml", ".yaml")):
        return yaml(content)
    return python(content) if name.endswith(".py") else windows(content.split("\n"))


def chunk_files(files: DataFrame) -> DataFrame:
    """SCHEMA rows from (file, content); one pass over files that are dealt to all tasks first, as a small table lies in one split
    and parsing takes far longer than reading."""
    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))
    names, types = arrow.names, arrow.types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                rows = [{"file": f} | c for f, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True) for c in chunk_file(f or "", text or "")]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

    return files.select("file", "content").repartition(partitions(files)).mapInArrow(run, SCHEMA)
