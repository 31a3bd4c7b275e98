"""Scalar functions over columns: rounding, paths, globs, versions, package names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round_even(x: Column, digits: int) -> Column:
    """Ties to even on ``x * 10**digits``."""
    scale = F.lit(float(10**digits))
    return F.rint(x.cast("double") * scale) / scale


def round_report(x: Column, digits: int = 6) -> Column:
    """:func:`round_even` without negative zero."""
    r = round_even(x, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def round_away(x: Column, digits: int) -> Column:
    """Half away from zero on ``x * 10**digits``."""
    scale = F.lit(float(10**digits))
    y = x.cast("double") * scale
    return F.signum(y) * F.floor(F.abs(y) + 0.5) / scale


def dirname(path: Column) -> Column:
    """What stands before the last slash, else the empty string."""
    return F.regexp_extract(path, r"^(.*)/", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def segments(path: Column) -> Column:
    """Directory segments of a path (without the file name)."""
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def path_depth(path: Column) -> Column:
    return F.when(path == "", F.lit(0)).otherwise(F.size(F.split(path, "/")))


def is_below(path: Column, directory: Column) -> Column:
    """Ancestry with a segment boundary; everything is below the root ''."""
    return (directory == "") | (path == directory) | path.startswith(F.concat(directory, F.lit("/")))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading equal elements of two arrays."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_miss = F.array_position(same, F.lit(False))
    return F.when(first_miss == 0, F.size(same)).otherwise(first_miss - 1).cast("int")


def proximity(a: Column, b: Column) -> Column:
    """Leading directory segments that two paths share, over the deeper one's number (1 at least)."""
    x, y = segments(a), segments(b)
    return common_prefix(x, y).cast("double") / F.greatest(F.size(x), F.size(y), F.lit(1))


def normalized(path: Column) -> Column:
    """``.`` and ``..`` segments resolved; ``..`` above the root is dropped."""
    step = lambda acc, s: (
        F.when((s == ".") | (s == ""), acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def glob_regex(glob: str) -> str:
    """A segment-wise glob as an anchored regular expression: ``*`` and ``?`` stay inside a segment, a ``**`` segment
    stands for any number of segments, none included."""
    out, parts = "", glob.split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += "(?:[^/]+(?:/[^/]+)*)?" if last else "(?:[^/]+/)*"
            if last and out.endswith("/(?:[^/]+(?:/[^/]+)*)?"):
                out = out.removesuffix("/(?:[^/]+(?:/[^/]+)*)?") + "(?:/[^/]+)*"
            continue
        out += "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in part)
        out += "" if last else "/"
    return f"^{out}$"


def glob_match(path: Column, glob: str) -> Column:
    return path.rlike(glob_regex(glob))


def filter_match(path: Column, pattern: str) -> Column:
    """A report filter: a prefix, or with wildcards a glob over the whole path (``*`` crosses segments there)."""
    if not re.search(r"[*?]", pattern):
        return path.startswith(pattern)
    body = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern)
    return path.rlike(f"^{body}$")


# Fixed values.
LANGUAGES = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "cjs": "javascript", "py": "python", "pyi": "python", "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin",
    "rb": "ruby", "php": "php", "cs": "csharp",
}
TEST_DIRS = ["test", "tests", "__tests__", "spec", "e2e"]
TEST_STEMS = ["tests"]
TEST_MARKERS = [".test.", ".spec."]
TEST_PREFIXES = ["test_"]
TEST_SUFFIXES = ["_test", "_tests", "_spec"]
NON_PRODUCTION_DIRS = ["storybook"]
NON_PRODUCTION_MARKERS = [".stories."]
ENTRY_STEMS = [
    "main", "__main__", "__init__", "index", "lib", "mod", "build", "app", "cli", "server", "setup", "conftest", "manage",
    "wsgi", "asgi", "tests",
]
ENTRY_DIRS = ["test", "tests", "__tests__", "spec", "e2e", "bin", "scripts", "examples", "benches"]
ENTRY_MARKERS = [".test.", ".spec.", ".config.", ".d."]
ENTRY_PREFIXES = ["test_"]
ENTRY_SUFFIXES = ["_test", "_tests"]
STOP_SEGMENTS = ["src", "lib", "pkg", "internal", "packages", "core", "app", "python"]


def language_of(path: Column) -> Column:
    """By extension; an unknown extension stands for itself."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    extension = F.regexp_extract(path, r"\.([^.]*)$", 1)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension), extension)


def _path_rule(path: Column, dirs=(), stems=(), markers=(), prefixes=(), suffixes=()) -> Column:
    name = basename(path)
    stem = F.element_at(F.split(name, r"\."), 1)
    hit = F.exists(segments(path), lambda s: s.isin(list(dirs)))
    for rule in (
        [stem.isin(list(stems))] * bool(stems)
        + [name.contains(m) for m in markers]
        + [stem.startswith(p) for p in prefixes]
        + [stem.endswith(p) for p in suffixes]
    ):
        hit = hit | rule
    return hit


def is_test_path(path: Column) -> Column:
    return _path_rule(path, TEST_DIRS, TEST_STEMS, TEST_MARKERS, TEST_PREFIXES, TEST_SUFFIXES)


def is_non_production_path(path: Column) -> Column:
    return _path_rule(path, NON_PRODUCTION_DIRS, (), NON_PRODUCTION_MARKERS)


def is_entry_path(path: Column) -> Column:
    return _path_rule(path, ENTRY_DIRS, ENTRY_STEMS, ENTRY_MARKERS, ENTRY_PREFIXES, ENTRY_SUFFIXES)


def member_fingerprint(paths: Column) -> Column:
    """First 12 hex digits of the SHA-1 of sorted members, joined by line ends."""
    return F.substring(F.sha1(F.array_join(F.array_sort(paths), "\n").cast("binary")), 1, 12)


def package_key(ecosystem: Column, name: Column) -> Column:
    """Cargo takes ``_`` as ``-``; Python names are lower case with runs of ``-_.`` as one ``-``; others stay."""
    return (
        F.when(ecosystem == "cargo", F.replace(name, F.lit("_"), F.lit("-")))
        .when(ecosystem == "pypi", F.regexp_replace(F.lower(name), r"[-_.]+", "-"))
        .otherwise(name)
    )


def is_commit(text: Column) -> Column:
    return text.rlike(r"^(?:[0-9a-f]{40}|[0-9a-f]{64})$")


def is_safe_path(path: Column) -> Column:
    """Relative, without empty, ``.`` or ``..`` segments."""
    return (path != "") & ~path.rlike(r"^/|\\|(^|/)(\.{0,2})(/|$)")


def go_pseudo_hash(version: Column) -> Column:
    """The 12 hex digits after a 14-digit time in a Go pseudo-version, else null."""
    found = F.regexp_extract(version, r"(?:^|[-.])\d{14}-([0-9a-f]{12})(?:\+incompatible)?$", 1)
    return F.when(found == "", F.lit(None)).otherwise(found)


def version_parts(version: Column) -> Column:
    """Three numbers of a plain version, else null (pre-releases and wildcards are not judged)."""
    plain = F.regexp_extract(version, r"^v?(\d+(?:\.\d+){0,2})$", 1)
    numbers = F.transform(F.split(plain, r"\."), lambda p: F.try_to_number(p, F.lit("9999999999")).cast("long"))
    return F.when(plain != "", F.slice(F.concat(numbers, F.array_repeat(F.lit(0).cast("long"), 3)), 1, 3))


def satisfies(requirement: Column, version: Column, ecosystem: Column) -> Column:
    """Whether a version meets a comma-joined requirement; null where the requirement is not judged (alternatives,
    hyphen ranges, wildcards, pre-releases)."""
    have = version_parts(version)

    def one(term: Column) -> Column:
        op = F.regexp_extract(term, r"^\s*(\^|~=|~|>=|<=|==|=|!=|>|<)?", 1)
        raw = F.trim(F.regexp_replace(term, r"^\s*(\^|~=|~|>=|<=|==|=|!=|>|<)?", ""))
        want = version_parts(raw)
        given = F.size(F.split(raw, r"\."))
        major, minor, patch = (want[i] for i in range(3))
        # the next version that a caret or a tilde leaves out
        caret = (
            F.when((major > 0) | (given == 1), F.array(major + 1, F.lit(0).cast("long"), F.lit(0).cast("long")))
            .when((minor > 0) | (given == 2), F.array(major, minor + 1, F.lit(0).cast("long")))
            .otherwise(F.array(major, minor, patch + 1))
        )
        tilde = F.when(given == 1, F.array(major + 1, F.lit(0).cast("long"), F.lit(0).cast("long"))).otherwise(
            F.array(major, minor + 1, F.lit(0).cast("long"))
        )
        compatible = F.when(given <= 2, F.array(major + 1, F.lit(0).cast("long"), F.lit(0).cast("long"))).otherwise(
            F.array(major, minor + 1, F.lit(0).cast("long"))
        )
        bare = F.when(ecosystem == "cargo", (have >= want) & (have < caret)).otherwise(have == want)
        return (
            F.when(op == "^", (have >= want) & (have < caret))
            .when(op == "~", (have >= want) & (have < tilde))
            .when(op == "~=", (have >= want) & (have < compatible))
            .when(op == ">=", have >= want)
            .when(op == "<=", have <= want)
            .when(op == ">", have > want)
            .when(op == "<", have < want)
            .when(op == "!=", have != want)
            .when(op.isin("=", "=="), have == want)
            .otherwise(bare)
        )

    unjudged = requirement.rlike(r"\|\||\s-\s|[xX*]|\d-[A-Za-z]")
    terms = F.filter(F.split(requirement, r"\s*,\s*|\s+(?=[<>=!~^])"), lambda t: F.trim(t) != "")
    verdicts = F.transform(terms, one)
    bad = F.exists(verdicts, lambda v: v.isNull())
    return F.when(unjudged | bad | (F.size(terms) == 0), F.lit(None).cast(T.BooleanType())).otherwise(
        ~F.exists(verdicts, lambda v: ~v)
    )


def polygon_area(ring: Column) -> Column:
    """Shoelace area of a ring of [x, y] pairs, positive counter-clockwise."""
    after = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    parts = F.zip_with(ring, after, lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x) / 2


def search_marks(text: Column, query: str) -> Column:
    """[start, end) of the non-overlapping, case-insensitive occurrences of a query, from 0."""
    if not query:
        return F.array().cast("array<struct<start:int,end:int>>")
    pieces = F.split(F.lower(text), re.escape(query.lower()), -1)
    ends = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))),
        lambda i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda acc, p: acc + F.length(p)) + (i - 1) * len(query),
    )
    marks = F.transform(ends, lambda s: F.struct(s.cast("int").alias("start"), (s + len(query)).cast("int").alias("end")))
    return F.when(F.size(pieces) > 1, marks).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
