"""Names in Python files: exports, attribute and bare-name candidates, symbol spans and reference candidates."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame

NAMES = (
    "path string, defined array<string>, bindings array<struct<local:string,module:string,name:string>>, stars array<string>, listed array<string>, "
    "computed boolean, attributes array<struct<head:string,attr:string>>, bare array<string>, "
    "spans array<struct<sym:int,name:string,kind:string,start:int,end:int,parent:int>>, "
    "candidates array<struct<owner:int,head:string,attr:string,kind:string,line:int>>, shadowed array<struct<owner:int,name:string>>"
)


def names_of(text: str) -> dict | None:
    """All of a file's names; None where it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return None
    return exports(tree) | uses(tree) | symbols(tree)


def targets(node: ast.AST) -> list[str]:
    """Plain names that an assignment target binds."""
    return [n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Store, ast.Del))]


def exports(tree: ast.Module) -> dict:
    """Top-level definitions, import bindings, star imports, the literal ``__all__``, and whether it is computed."""
    defined, bindings, stars, listed, computed = [], [], [], None, False

    def read(body):
        nonlocal listed, computed
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                defined.append(node.name)
            elif isinstance(node, ast.Import):
                for a in node.names:
                    bindings.append((a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0], None))
            elif isinstance(node, ast.ImportFrom):
                module = "." * node.level + (node.module or "")
                for a in node.names:
                    if a.name == "*":
                        stars.append(module)
                    else:
                        bindings.append((a.asname or a.name, module, a.name))
            elif isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                names = [n for t in (node.targets if isinstance(node, ast.Assign) else [node.target]) for n in targets(t)]
                defined.extend(n for n in names if n != "__all__")
                if "__all__" in names:
                    literal = _strings(node.value)
                    if literal is None or isinstance(node, ast.AugAssign) and listed is None:
                        computed = True
                    else:
                        listed = (listed or []) + literal if isinstance(node, ast.AugAssign) else literal
            elif isinstance(node, (ast.If, ast.Try, ast.With)):
                for inner in ("body", "orelse", "finalbody"):
                    read(getattr(node, inner, []))
                for handler in getattr(node, "handlers", []):
                    read(handler.body)
            elif isinstance(node, ast.Expr) and "__all__" in {n.id for n in ast.walk(node) if isinstance(n, ast.Name)}:
                computed = True

    read(tree.body)
    return {"defined": sorted(set(defined)), "bindings": sorted(set(bindings), key=str), "stars": sorted(set(stars)), "listed": listed, "computed": computed}


def _strings(value) -> list[str] | None:
    if isinstance(value, (ast.List, ast.Tuple)) and all(isinstance(e, ast.Constant) and isinstance(e.value, str) for e in value.elts):
        return [e.value for e in value.elts]
    return None


def uses(tree: ast.Module) -> dict:
    """(head, attr) of every attribute of a plain name or dotted name, and the names that stand alone."""
    attributes, bare, heads = set(), set(), set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Attribute) and isinstance(node.ctx, ast.Load):
            head = _dotted(node.value)
            if head:
                attributes.add((head, node.attr))
                heads.add(id(node.value))
    for node in ast.walk(tree):
        if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load) and id(node) not in heads:
            bare.add(node.id)
    return {"attributes": sorted(attributes), "bare": sorted(bare)}


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return head and f"{head}.{node.attr}"
    return None


def symbols(tree: ast.Module) -> dict:
    """Spans of classes, functions and methods with their parents, what each refers to (call, extends, annotation,
    decorator or value), and the parameters and locals that hide outer names."""
    spans, candidates, shadowed = [], set(), set()

    def refer(owner, node, kind):
        for n in ast.walk(node):
            if isinstance(n, ast.Call) and kind == "value":
                note(owner, n.func, "call")
        called = {id(n.func) for n in ast.walk(node) if isinstance(n, ast.Call)} if kind == "value" else set()
        inner = {id(n.value) for n in ast.walk(node) if isinstance(n, ast.Attribute)}
        for n in ast.walk(node):
            if isinstance(n, (ast.Name, ast.Attribute)) and isinstance(n.ctx, ast.Load) and id(n) not in called and id(n) not in inner:
                note(owner, n, kind)

    def note(owner, node, kind):
        if isinstance(node, ast.Name):
            candidates.add((owner, node.id, None, kind, node.lineno))
        elif isinstance(node, ast.Attribute) and (head := _dotted(node.value)):
            candidates.add((owner, head, node.attr, kind, node.lineno))

    def walk(body, owner, in_class):
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                sym, is_class = len(spans), isinstance(node, ast.ClassDef)
                first = min([node.lineno, *(x.lineno for x in node.decorator_list)])
                spans.append((sym, node.name, "class" if is_class else "method" if in_class else "function", first, node.end_lineno, owner))
                for x in node.decorator_list:
                    refer(sym, x, "decorator")
                if is_class:
                    for x in [*node.bases, *(k.value for k in node.keywords)]:
                        refer(sym, x, "extends")
                else:
                    args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *filter(None, [node.args.vararg, node.args.kwarg])]
                    shadowed.update((sym, a.arg) for a in args)
                    for x in [*(a.annotation for a in args), node.returns]:
                        if x is not None:
                            refer(sym, x, "annotation")
                    for x in [*node.args.defaults, *node.args.kw_defaults]:
                        if x is not None:
                            refer(sym, x, "value")
                walk(node.body, sym, is_class)
            else:
                inner = [f for f in ("body", "orelse", "finalbody", "handlers", "cases") if isinstance(getattr(node, f, None), list)]
                for child in ast.iter_child_nodes(node):
                    if not any(child in getattr(node, f) for f in inner):
                        refer(owner, child, "annotation" if isinstance(node, ast.AnnAssign) and child is node.annotation else "value")
                if isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.For, ast.AsyncFor)) and owner >= 0 and spans[owner][2] != "class":
                    for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                        shadowed.update((owner, n) for n in targets(t))
                for f in inner:
                    for child in getattr(node, f):
                        walk(child.body if hasattr(child, "body") and not isinstance(child, ast.stmt) else [child], owner, in_class)

    walk(tree.body, -1, False)
    return {"spans": spans, "candidates": sorted(candidates, key=str), "shadowed": sorted(shadowed)}


def _rows(parts):
    for part in parts:
        rows = []
        for path, content in zip(part["path"], part["content"]):
            found = names_of(content or "")
            if found is not None:
                rows.append({"path": path, **found})
        yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _columns()])


def _columns() -> list[str]:
    return ["path", "defined", "bindings", "stars", "listed", "computed", "attributes", "bare", "spans", "candidates", "shadowed"]


def python_names(files: DataFrame) -> DataFrame:
    """One row for each Python file (path, content) that parses."""
    return files.select("path", "content").mapInPandas(_rows, NAMES)
