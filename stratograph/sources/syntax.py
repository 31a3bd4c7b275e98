"""Per-file syntax: metrics, identifiers, symbols and imports.  Python through its own parser; Go, TypeScript and Rust by
a lexer that leaves out comments and strings."""

from __future__ import annotations

import ast
import io
import re
import tokenize

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import importable

# Fixed values.
IDENTIFIER_STOP = {
    "self", "cls", "args", "kwargs", "return", "None", "True", "False", "str", "int", "list", "dict", "set", "type", "object",
    "Exception", "value", "name", "key", "data", "result", "item", "obj", "i", "e",
}
MAX_SYMBOLS = 60
KINDS = {"class": 0, "func": 1, "method": 2, "interface": 3, "type": 4, "const": 5}

PARSED = (
    "path string, loc long, code_lines long, complexity long, identifiers map<string,long>, "
    "symbols array<struct<name:string,kind:int,start:int,end:int>>, "
    "imports array<struct<level:int,module:string,from_:boolean,names:array<string>>>, generated boolean"
)


def code_lines_python(text: str, tree: ast.Module) -> int:
    """Lines with a token that is neither comment nor docstring."""
    skip = set()
    for node in ast.walk(tree):
        if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and node.body:
            first = node.body[0]
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                skip.add((first.lineno, first.col_offset))
    lines: set[int] = set()
    blank = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER}
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type not in blank and not (t.type == tokenize.STRING and t.start in skip):
            lines.update(range(t.start[0], t.end[0] + 1))
    return len(lines)


def python_file(path: str, text: str) -> dict | None:
    """Facts of a Python file; None where it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return None
    complexity, names = 0, {}

    def seen(name: str, times: int) -> None:
        if len(name) > 2 and not name.startswith("__") and name not in IDENTIFIER_STOP:
            names[name] = names.get(name, 0) + times

    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.BoolOp)):
            complexity += 1
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            seen(node.name, 3)
        elif isinstance(node, ast.Name):
            seen(node.id, 1)
        elif isinstance(node, ast.Attribute):
            seen(node.attr, 1)
    symbols = []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            symbols.append((node.name, KINDS["func"], node.lineno, node.end_lineno))
        elif isinstance(node, ast.ClassDef):
            symbols.append((node.name, KINDS["class"], node.lineno, node.end_lineno))
            symbols += [(m.name, KINDS["method"], m.lineno, m.end_lineno) for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
    imports = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports.append((0, "", False, [a.name for a in node.names]))
        elif isinstance(node, ast.ImportFrom):
            imports.append((node.level, node.module or "", True, [a.name for a in node.names]))
    return {
        "path": path, "loc": text.count("\n") + 1, "code_lines": code_lines_python(text, tree), "complexity": complexity, "identifiers": names,
        "symbols": sorted(symbols, key=lambda s: s[2])[:MAX_SYMBOLS], "imports": imports, "generated": is_generated(text),
    }


def is_generated(text: str) -> bool:
    return any(mark in line for line in text.split("\n")[:5] for mark in ("@generated", "DO NOT EDIT", "This file was generated by [ts-rs]"))


# comments, strings, then everything else stays
BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])'|'(?:\\.|[^'\\\n])*'(?=[\s,;)\]])", re.S)
BRANCH = {
    "go": r"\b(?:if|for|switch|select|case)\b|&&|\|\|",
    "typescript": r"\b(?:if|for|while|switch|case|catch|try)\b|&&|\|\||\?\?|\?(?![.:?])",
    "rust": r"\b(?:if|for|while|loop|match)\b|&&|\|\||=>",
}
SYMBOL = {
    "go": [(r"^func\s+(?:\([^)]*\)\s*)(\w+)", "method"), (r"^func\s+(\w+)", "func"), (r"^type\s+(\w+)\s+interface\b", "interface"), (r"^type\s+(\w+)\s+struct\b", "class"), (r"^type\s+(\w+)", "type")],
    "typescript": [(r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", "class"), (r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+(\w+)", "func"), (r"^(?:export\s+)?interface\s+(\w+)", "interface"), (r"^(?:export\s+)?type\s+(\w+)", "type"), (r"^(?:export\s+)?const\s+(\w+)", "const")],
    "rust": [(r"^\s+(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", "method"), (r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", "func"), (r"^(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+(\w+)", "class"), (r"^(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)", "interface"), (r"^(?:pub(?:\([^)]*\))?\s+)?type\s+(\w+)", "type"), (r"^(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(\w+)", "const")],
}
IMPORT = {
    "go": r"^\s*import\s+(?:[\w.]+\s+)?\"([^\"]+)\"|^\s+(?:[\w.]+\s+)?\"([^\"]+)\"\s*$",
    "typescript": r"(?:\bfrom|\bimport|\brequire\()\s*['\"]([^'\"]+)['\"]",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);",
}


def other_file(path: str, text: str, language: str) -> dict:
    plain = BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    names: dict = {}
    for name in re.findall(r"[A-Za-z_]\w{2,}", plain):
        names[name] = names.get(name, 0) + 1
    symbols = []
    lines = plain.split("\n")
    for i, line in enumerate(lines, 1):
        for pattern, kind in SYMBOL[language]:
            if (m := re.match(pattern, line)) and not (language == "typescript" and m[1].startswith("_")):
                depth, end = 0, i
                for j in range(i - 1, len(lines)):
                    depth += lines[j].count("{") - lines[j].count("}")
                    end = j + 1
                    if depth <= 0:
                        break
                symbols.append((m[1], KINDS[kind], i, end))
                break
    source = text
    if language == "go":
        source = "\n".join(re.findall(r"^import\s*\(.*?\)|^import\s+.*$", text, re.M | re.S))
    found = [next(g for g in m.groups() if g) for m in re.finditer(IMPORT[language], source, re.M)]
    return {
        "path": path, "loc": text.count("\n") + 1, "code_lines": sum(bool(x.strip()) for x in plain.split("\n")),
        "complexity": len(re.findall(BRANCH[language], plain)), "identifiers": names, "symbols": symbols[:MAX_SYMBOLS],
        "imports": [(0, x.strip(), False, []) for x in found], "generated": is_generated(text),
    }


def parsed(files: DataFrame, language: str) -> DataFrame:
    """The facts of source files (path, content); Python files with a syntax error are left out whole."""

    importable(files.sparkSession)

    def run(frames):
        for frame in frames:
            rows = []
            for path, text in frame.itertuples(index=False):
                row = python_file(path, text) if language == "python" else other_file(path, text, language)
                if row:
                    rows.append(row)
            yield pd.DataFrame(rows, columns=["path", "loc", "code_lines", "complexity", "identifiers", "symbols", "imports", "generated"])

    return files.select("path", "content").mapInPandas(run, PARSED)


def nonblank_lines(text):
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))


# ---- three-valued build constraints: True, False, None for unknown


def three_and(a, b):
    return False if a is False or b is False else None if a is None or b is None else True


def three_or(a, b):
    return True if a is True or b is True else None if a is None or b is None else False


def three_not(a):
    return None if a is None else not a


def constraint(text: str, tag) -> bool | None:
    """A Go build expression (``&&``, ``||``, ``!``, brackets) over ``tag(name)``; None where it does not parse."""
    tokens = re.findall(r"&&|\|\||!|\(|\)|[\w.]+", text)
    if re.sub(r"\s", "", text) != "".join(tokens):
        return None
    at = 0

    def either():
        nonlocal at
        value = both()
        while at < len(tokens) and tokens[at] == "||":
            at += 1
            value = three_or(value, both())
        return value

    def both():
        nonlocal at
        value = one()
        while at < len(tokens) and tokens[at] == "&&":
            at += 1
            value = three_and(value, one())
        return value

    def one():
        nonlocal at
        t = tokens[at]
        at += 1
        if t == "!":
            return three_not(one())
        if t == "(":
            value = either()
            if tokens[at] != ")":
                raise IndexError
            at += 1
            return value
        if t in ("&&", "||", ")"):
            raise IndexError
        return tag(t)

    try:
        value = either()
        return value if at == len(tokens) else None
    except IndexError:
        return None


# Fixed values.
GO_SYSTEMS = {"aix", "android", "darwin", "dragonfly", "freebsd", "illumos", "ios", "js", "linux", "netbsd", "openbsd", "plan9", "solaris", "wasip1", "windows"}
GO_MACHINES = {"386", "amd64", "arm", "arm64", "loong64", "mips", "mips64", "mips64le", "mipsle", "ppc64", "ppc64le", "riscv64", "s390x", "wasm"}
GO_RELEASE = 26


def go_tag(name: str) -> bool | None:
    """Build tags of linux/amd64 with gc, no cgo and no tags of one's own."""
    if name.startswith("goexperiment.") or name == "boringcrypto":
        return None
    if m := re.fullmatch(r"go1\.(\d+)", name):
        return int(m[1]) <= GO_RELEASE
    return name in ("linux", "unix", "amd64", "gc")


def go_in_build(path: str, text: str) -> bool | None:
    """Whether a Go file is in the build: by its name, ``import "C"``, and its one ``//go:build`` line."""
    stem = path.rsplit("/", 1)[-1].removesuffix(".go")
    if stem[:1] in ("_", "."):
        return False
    parts = stem.removesuffix("_test").split("_")[1:]
    system = next((p for p in parts[-2:] if p in GO_SYSTEMS), None)
    machine = parts[-1] if parts and parts[-1] in GO_MACHINES else None
    if machine is None and parts and parts[-1] not in GO_SYSTEMS:
        system = None
    if (system and system != "linux") or (machine and machine != "amd64"):
        return False
    if re.search(r'^\s*(?:import\s+)?"C"\s*$', text, re.M):
        return False
    head = text.split("\npackage ", 1)[0]
    lines = re.findall(r"^//go:build\s+(.*)$", head, re.M)
    if len(lines) > 1:
        return None
    return constraint(lines[0].strip(), go_tag) if lines else True


def rust_cfg(text: str) -> bool | None:
    """``cfg`` predicates (all, any, not, key = "value") on x86_64 Linux; features, test and own names are unknown."""
    # Fixed values.
    known = {"unix": True, "windows": False, "debug_assertions": None}
    keys = {"target_os": "linux", "target_arch": "x86_64", "target_family": "unix", "target_env": "gnu", "target_pointer_width": "64", "target_endian": "little"}
    text = text.strip()
    if m := re.fullmatch(r'(\w+)\s*=\s*"([^"]*)"', text):
        return m[2] == keys[m[1]] if m[1] in keys else None
    if m := re.fullmatch(r"(all|any|not)\s*\((.*)\)", text, re.S):
        parts, depth, start = [], 0, 0
        for i, c in enumerate(m[2] + ","):
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                parts.append(m[2][start:i])
                start = i + 1
        values = [rust_cfg(p) for p in parts if p.strip()]
        if m[1] == "not":
            return three_not(values[0]) if len(values) == 1 else None
        out = m[1] == "all"
        for v in values:
            out = three_and(out, v) if m[1] == "all" else three_or(out, v)
        return out
    return known.get(text)
