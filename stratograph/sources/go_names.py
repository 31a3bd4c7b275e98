"""Names in Go files: imports with their local names, selectors, declarations, receivers and signatures, by a scanner that
knows comments, strings and brackets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

NAMES = (
    "path string, package string, imports array<struct<local:string,path:string>>, selectors array<struct<head:string,name:string>>, "
    "declared array<struct<name:string,kind:string,receiver:string,params:int,results:int,line:int>>"
)
_TOKENS = re.compile(r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_IMPORT = re.compile(r"^[ \t]*import\s*(?:\(([^)]*)\)|([^\n(]+))", re.M)
_SPEC = re.compile(r"(?:([\w.]+)\s+)?[\"`]([^\"`]+)[\"`]")


def masked(text: str, strings: bool = True) -> str:
    """The text with comments, and strings too, as blanks of the same length."""
    blank = lambda m: m[0] if not strings and m[0][0] not in "/" else re.sub(r"[^\n]", " ", m[0])
    return _TOKENS.sub(blank, text)


def closing(text: str, at: int) -> int:
    """The place behind the bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] in "([{") - (text[i] in ")]}")
        if not depth:
            return i + 1
    return len(text)


def arity(inner: str) -> int:
    """Parameters of a bracketed list; a name without a type takes the next one's and counts."""
    depth, parts, part = 0, [], ""
    for c in inner:
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            parts.append(part)
            part = ""
        else:
            part += c
    return sum(bool(p.strip()) for p in [*parts, part])


def go_file(text: str) -> dict:
    plain, spelled = masked(text), masked(text, strings=False)
    package = re.search(r"^package\s+(\w+)", plain, re.M)
    imports = []
    for m in _IMPORT.finditer(spelled):
        for s in _SPEC.finditer(m[1] if m[1] is not None else m[2]):
            imports.append((s[1] or s[2].rsplit("/", 1)[-1], s[2]))
    heads = {local for local, _ in imports}
    selectors = sorted({(h, n) for h, n in re.findall(r"(?<![\w.])(\w+)\.([A-Za-z_]\w*)", plain) if h in heads})
    declared = []
    line = lambda at: plain.count("\n", 0, at) + 1
    for m in re.finditer(r"^func\s*", plain, re.M):
        at, receiver = m.end(), None
        if plain[at : at + 1] == "(":
            end = closing(plain, at)
            own = re.search(r"(\w+)\s*(?:\[[^\]]*\])?\s*$", plain[at + 1 : end - 1])
            receiver, at = own and own[1], end
        name = re.compile(r"\s*(\w+)").match(plain, at)
        if not name:
            continue
        at = name.end()
        if plain[at : at + 1] == "[":
            at = closing(plain, at)
        if plain[at : at + 1] != "(":
            continue
        end = closing(plain, at)
        params = arity(plain[at + 1 : end - 1])
        rest = plain[end:].lstrip(" \t")
        if rest.startswith("("):
            results = arity(rest[1 : closing(rest, 0) - 1])
        else:
            results = int(bool(re.match(r"[^\s{]", rest)))
        declared.append((name[1], "method" if receiver else "func", receiver, params, results, line(m.start())))
    for m in re.finditer(r"^type\s+(\w+)(?:\[[^\]]*\])?\s+(struct|interface)?", plain, re.M):
        declared.append((m[1], m[2] or "type", None, None, None, line(m.start())))
    for m in re.finditer(r"^(const|var)\s+(\w+)", plain, re.M):
        declared.append((m[2], m[1], None, None, None, line(m.start())))
    return {"package": package and package[1], "imports": imports, "selectors": selectors, "declared": sorted(declared, key=lambda d: d[5])}


def go_names(files: DataFrame) -> DataFrame:
    """One row for each Go file (path, content)."""

    def run(parts):
        for part in parts:
            rows = [{"path": p, **go_file(c or "")} for p, c in zip(part["path"], part["content"])]
            yield pd.DataFrame(rows, columns=["path", "package", "imports", "selectors", "declared"])

    return files.select("path", "content").mapInPandas(run, NAMES)
