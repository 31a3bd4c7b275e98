"""Texts of manifests, progress lines and reports: parsing and formatting."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset basis and prime of the 64-bit FNV-1a hash.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def path_hash(paths) -> str:
    """``cycle-`` and the 64-bit FNV-1a hash of the sorted paths, each ended by a zero byte."""
    h = FNV_BASIS
    for byte in b"".join(p.encode() + b"\0" for p in sorted(paths)):
        h = (h ^ byte) * FNV_PRIME % 2**64
    return f"cycle-{h:016x}"


def path_hashes(paths: Column) -> Column:
    """The same for an array column."""
    return F.udf(lambda p: None if p is None else path_hash(p), "string")(paths)


def workspace_regex(pattern: str) -> str:
    """A workspace glob as a regular expression: ``*`` within a segment, ``**`` any number of segments, all else itself."""
    out = []
    segments = [s for s in pattern.strip("/").split("/") if s not in ("", ".")]
    for i, s in enumerate(segments):
        last = i == len(segments) - 1
        if s == "**":
            out.append(".*" if last else "(?:[^/]+/)*")
        else:
            out.append("[^/]*".join(re.escape(x) for x in s.split("*")) + ("" if last else "/"))
    return "^" + "".join(out) + "$"


def workspace_members(folder: Column, patterns: list[str]) -> Column:
    """Whether a folder is one of a workspace's members: a pattern takes it in and none with ``!`` leaves it out."""
    any_of = lambda ps: F.lit(False) if not ps else F.greatest(*[folder.rlike(workspace_regex(p)) for p in ps], F.lit(False))
    return any_of([p for p in patterns if not p.startswith("!")]) & ~any_of([p[1:] for p in patterns if p.startswith("!")])


def strip_jsonc(text: str) -> str:
    """JSON from JSON with comments and trailing commas."""
    kept = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", kept, flags=re.S)


def jsonc(text: str):
    """The value, or None where the text is not JSON."""
    try:
        return json.loads(strip_jsonc(text))
    except ValueError:
        return None


#: Conditions of an export, in the order in which they are tried before all others.
CONDITIONS = ("source", "types", "import", "module", "require", "default")


def export_targets(exports, subpath: str = ".") -> list[str]:
    """Files that a package's ``exports`` give for ``subpath`` (``.`` or ``./x``), in order; one ``*`` of a key stands for
    any text, which replaces the ``*`` of the target; a longer key counts before a shorter one."""
    table = exports if isinstance(exports, dict) and any(k.startswith(".") for k in exports) else {".": exports}
    if subpath in table:
        return _leaves(table[subpath], None)
    for key in sorted((k for k in table if k.count("*") == 1), key=lambda k: (-len(k), k)):
        head, tail = key.split("*")
        if subpath.startswith(head) and subpath.endswith(tail) and len(subpath) >= len(head) + len(tail):
            return _leaves(table[key], subpath[len(head) : len(subpath) - len(tail)])
    return []


def _leaves(value, star: str | None) -> list[str]:
    if isinstance(value, str):
        return [value if star is None else value.replace("*", star)]
    if isinstance(value, list):
        return [x for v in value for x in _leaves(v, star)]
    if isinstance(value, dict):
        first = [k for k in CONDITIONS if k in value]
        return [x for k in [*first, *(k for k in value if k not in first)] for x in _leaves(value[k], star)]
    return []


def rfc3339(seconds: Column) -> Column:
    """Seconds since 1970 as UTC text."""
    days = F.floor(seconds / 86_400)
    rest = seconds - days * 86_400
    clock = F.format_string("%02d:%02d:%02d", F.floor(rest / 3_600), F.floor(rest % 3_600 / 60), rest % 60)
    return F.concat(F.date_format(F.date_from_unix_date(days.cast("int")), "yyyy-MM-dd"), F.lit("T"), clock, F.lit("Z"))


def fanin_text(value: Column, lang: Column) -> Column:
    """Fan-in as a report shows it: of languages whose imports are shared two places, of Python the whole number."""
    whole = F.floor(value).cast("long").cast("string")
    return F.when((lang == "python") & (value == F.floor(value)), whole).otherwise(F.format_string("%.2f", value.cast("double")))


def percent_text(share: Column) -> Column:
    """A share as a percentage without places, ties to even."""
    return F.concat(F.rint(share * 100).cast("long").cast("string"), F.lit("%"))


def git_progress(line: Column) -> Column:
    """A struct (stage, percent, done, total, received in bytes) of a progress line; null where it is none."""
    pattern = r"^(?:remote: )?([A-Z][A-Za-z ]*): +(\d+)% \((\d+)/(\d+)\)(?:, ([\d.]+) (bytes|KiB|MiB|GiB))?"
    part = lambda i: F.regexp_extract(line, pattern, i)
    unit = F.when(part(6) == "KiB", 1 << 10).when(part(6) == "MiB", 1 << 20).when(part(6) == "GiB", 1 << 30).otherwise(1)
    received = F.when(part(5) != "", F.rint(F.try_to_number(part(5), F.lit("99999999.99")).cast("double") * unit).cast("long"))
    made = F.struct(
        part(1).alias("stage"), part(2).cast("int").alias("percent"), part(3).cast("long").alias("done"), part(4).cast("long").alias("total"), received.alias("received")
    )
    return F.when(line.rlike(pattern), made)
