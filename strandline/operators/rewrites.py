"""Rewrites of Python sources: meaning kept, or broken in one place. Each works on one program at a time."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .dealing import dealt


def parsed(source: str | None) -> ast.Module | None:
    try:
        return ast.parse(source or "")
    except (SyntaxError, ValueError):
        return None


def locals_of(tree: ast.AST) -> list[str]:
    """Arguments and assigned names of functions, in order of appearance; what nested scopes declare elsewhere is left alone."""
    blocked = {name for x in ast.walk(tree) if isinstance(x, ast.Global | ast.Nonlocal) for name in x.names}
    names: dict[str, None] = {}
    for function in (x for x in ast.walk(tree) if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)):
        for x in ast.walk(function):
            if isinstance(x, ast.arg):
                names[x.arg] = None
            elif isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store):
                names[x.id] = None
    return [x for x in names if x not in blocked]


def rename(tree: ast.Module) -> ast.Module | None:
    """Local names become neutral ones."""
    taken = {x.id for x in ast.walk(tree) if isinstance(x, ast.Name)} | {x.arg for x in ast.walk(tree) if isinstance(x, ast.arg)}
    new: dict[str, str] = {}
    for name in locals_of(tree):
        k = len(new)
        while f"name{k}" in taken:
            k += 1
        new[name] = f"name{k}"
        taken.add(new[name])
    keywords = {x.arg for x in ast.walk(tree) if isinstance(x, ast.keyword)}
    new = {k: v for k, v in new.items() if k not in keywords}
    if not new:
        return None
    for x in ast.walk(tree):
        if isinstance(x, ast.Name):
            x.id = new.get(x.id, x.id)
        elif isinstance(x, ast.arg):
            x.arg = new.get(x.arg, x.arg)
    return tree


class _Expand(ast.NodeTransformer):
    fired = False

    def visit_AugAssign(self, node: ast.AugAssign) -> ast.AST:  # noqa: N802
        if not isinstance(node.target, ast.Name):
            return node
        self.fired = True
        return ast.Assign([node.target], ast.BinOp(ast.Name(node.target.id, ast.Load()), node.op, node.value), lineno=node.lineno)


class _Unfold(ast.NodeTransformer):
    """A list comprehension that is all of an assignment becomes a loop."""

    fired = False

    def visit_Assign(self, node: ast.Assign) -> ast.AST | list[ast.stmt]:  # noqa: N802
        value = node.value
        if not (isinstance(value, ast.ListComp) and len(value.generators) == 1 and not value.generators[0].is_async and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name)):
            return node
        name, source = node.targets[0].id, value.generators[0]
        if any(isinstance(x, ast.Name) and x.id == name for x in ast.walk(value)):
            return node
        self.fired = True
        body: list[ast.stmt] = [ast.Expr(ast.Call(ast.Attribute(ast.Name(name, ast.Load()), "append", ast.Load()), [value.elt], []))]
        for test in reversed(source.ifs):
            body = [ast.If(test, body, [])]
        return [ast.Assign(node.targets, ast.List([], ast.Load()), lineno=node.lineno), ast.For(source.target, source.iter, body, [], lineno=node.lineno)]


class _While(ast.NodeTransformer):
    """A loop over one range of a plain name becomes a while loop, where nothing in it leaves or rebinds the counter."""

    fired = False

    def visit_For(self, node: ast.For) -> ast.AST | list[ast.stmt]:  # noqa: N802
        self.generic_visit(node)
        call = node.iter
        plain = isinstance(call, ast.Call) and isinstance(call.func, ast.Name) and call.func.id == "range" and len(call.args) == 1 and isinstance(call.args[0], ast.Name | ast.Constant)
        if not (plain and isinstance(node.target, ast.Name) and not node.orelse):
            return node
        written = {x.id for s in node.body for x in ast.walk(s) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)}
        if node.target.id in written or isinstance(call.args[0], ast.Name) and call.args[0].id in written or any(isinstance(x, ast.Continue | ast.Break) for s in node.body for x in ast.walk(s)):
            return node
        self.fired = True
        counter = ast.Name(node.target.id, ast.Load())
        step = ast.AugAssign(ast.Name(node.target.id, ast.Store()), ast.Add(), ast.Constant(1))
        return [ast.Assign([node.target], ast.Constant(0), lineno=node.lineno), ast.While(ast.Compare(counter, [ast.Lt()], [call.args[0]]), [*node.body, step], [])]


def _by(transformer: type) -> callable:
    def run(tree: ast.Module) -> ast.Module | None:
        made = transformer()
        tree = made.visit(tree)
        return tree if made.fired else None

    return run


REWRITES = {"rename": rename, "expand": _by(_Expand), "unfold": _by(_Unfold), "while": _by(_While)}
SWAPS = {ast.Lt: ast.LtE, ast.LtE: ast.Lt, ast.Gt: ast.GtE, ast.GtE: ast.Gt, ast.Eq: ast.NotEq, ast.NotEq: ast.Eq, ast.Add: ast.Sub, ast.Sub: ast.Add, ast.Mult: ast.Add, ast.FloorDiv: ast.Mult}


def rewritten(source: str | None, kind: str) -> str | None:
    """The source after a rewrite; null if it doesn't parse or nothing applies."""
    tree = parsed(source)
    tree = REWRITES[kind](tree) if tree is not None else None
    return ast.unparse(ast.fix_missing_locations(tree)) if tree is not None else None


def with_bug(source: str | None) -> tuple[str, int] | None:
    """The source with the first operator that can be swapped exchanged, and its line."""
    tree = parsed(source)
    if tree is None:
        return None
    places = sorted((x for x in ast.walk(tree) if isinstance(x, ast.Compare | ast.BinOp)), key=lambda x: (x.lineno, x.col_offset))
    for node in places:
        op = node.ops[0] if isinstance(node, ast.Compare) else node.op
        if type(op) in SWAPS:
            new = SWAPS[type(op)]()
            if isinstance(node, ast.Compare):
                node.ops[0] = new
            else:
                node.op = new
            return ast.unparse(tree), node.lineno
    return None


def shape(source: str | None) -> str | None:
    """What stays of a source without its names and constants."""
    tree = parsed(source)
    if tree is None:
        return None
    for x in ast.walk(tree):
        for field in ("id", "arg", "name", "attr", "value"):
            if isinstance(getattr(x, field, None), str):
                setattr(x, field, "_")
    return ast.dump(tree)


NAMED = ("id", "arg", "name", "attr", "value")


def same_shape(a: object, b: object) -> bool:
    """Whether two trees (their nodes, lists and constants) have one ``shape``; ends at the first difference."""
    if type(a) is not type(b):
        return False
    if isinstance(a, ast.AST):
        pairs = ((f, getattr(a, f, None), getattr(b, f, None)) for f in a._fields)
        return all(f in NAMED and isinstance(x, str) and isinstance(y, str) or same_shape(x, y) for f, x, y in pairs)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same_shape, a, b))
    return repr(a) == repr(b)


#: What a tree must have for a rewrite to apply; renaming asks the tree itself.
NEEDS = {"expand": ast.AugAssign, "unfold": ast.ListComp, "while": ast.For}


def contrast_pairs(programs: DataFrame) -> DataFrame:
    """program, kind, source, rewritten, same_shape for each rewrite that applies; renaming keeps the shape, the others must not."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for program, source in zip(batch["program"], batch["source"], strict=True):
                own = parsed(source)
                kinds = {type(x) for x in ast.walk(own)} if own is not None else set()
                for kind in REWRITES if own is not None else ():
                    new = rewritten(source, kind) if kind not in NEEDS or NEEDS[kind] in kinds else None
                    if new is not None and same_shape(own, parsed(new)) == (kind == "rename"):
                        rows.append((program, kind, source, new, kind == "rename"))
            yield pd.DataFrame(rows, columns=["program", "kind", "source", "rewritten", "same_shape"])

    return dealt(programs.select("program", "source"), "program").mapInPandas(run, "program string, kind string, source string, rewritten string, same_shape boolean")


def injected_bugs(programs: DataFrame) -> DataFrame:
    """program, broken, line of each program that an operator could be swapped in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *found) for p, s in zip(batch["program"], batch["source"], strict=True) if (found := with_bug(s))]
            yield pd.DataFrame(rows, columns=["program", "broken", "line"])

    return dealt(programs.select("program", "source"), "program").mapInPandas(run, "program string, broken string, line int")


def function_body(text: str | None) -> str | None:
    """Of a model's text: the lines from the first that is indented until the indentation ends, if they make a body."""
    lines = (text or "").replace("\t", "    ").split("\n")
    begin = next((k for k, x in enumerate(lines) if x.startswith(" ") and x.strip()), None)
    if begin is None:
        return None
    body = []
    for line in lines[begin:]:
        if line.strip() and not line.startswith(" "):
            break
        body.append(line)
    text = "\n".join(body).rstrip()
    return text if parsed("def f():\n" + text) is not None else None
