import pytest
from pyspark.sql import functions as F

from stratograph.functions import scalar as S
from stratograph.operators import organization, overlay, resolve
from stratograph.sources import repository, syntax


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "digits", "even"), [(0.125, 2, 0.12), (0.375, 2, 0.38), (-0.125, 2, -0.12)])
def test_ties(spark, value, digits, even):
    assert one(spark, S.round_even(F.col("v"), digits), v=value) == even


def test_half_away(spark):
    assert one(spark, S.round_away(F.col("v"), 2), v=0.125) == 0.13


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [
        ("src/*.py", "src/a.py", True), ("src/*.py", "src/a/b.py", False), ("**/b.py", "b.py", True), ("**/b.py", "x/y/b.py", True),
        ("src/**", "src/a/b", True), ("src/**/t.py", "src/t.py", True), ("a?c", "abc", True), ("a?c", "a/c", False),
    ],
)
def test_glob(spark, glob, path, hit):
    assert one(spark, S.glob_match(F.col("p"), glob), p=path) is hit


@pytest.mark.parametrize(("a", "b", "p"), [("a/b/c.py", "a/b/d.py", 1.0), ("a/b/c.py", "a/x/d.py", 0.5), ("c.py", "d.py", 0.0), ("a/c.py", "b/c.py", 0.0)])
def test_proximity(spark, a, b, p):
    assert one(spark, S.proximity(F.col("a"), F.col("b")), a=a, b=b) == p


@pytest.mark.parametrize(
    ("requirement", "version", "ecosystem", "ok"),
    [
        ("^1.2.0", "1.4.0", "npm", True), ("^0.2.3", "0.3.0", "npm", False), ("~1.2", "1.2.9", "npm", True), (">=0.3", "0.3.0", "pypi", True),
        (">=1.0,<2.0", "2.0.0", "pypi", False), ("~=1.4", "1.9.0", "pypi", True), ("1.2", "1.4.0", "cargo", True), ("1.2 || 2", "2.0.0", "npm", None),
        ("1.x", "1.0.0", "npm", None), ("==1.0", "1.0.0", "pypi", True), ("1.0.0-rc1", "1.0.0", "npm", None),
    ],
)
def test_satisfies(spark, requirement, version, ecosystem, ok):
    assert one(spark, S.satisfies(F.col("r"), F.col("v"), F.col("e")), r=requirement, v=version, e=ecosystem) is ok


def test_normalized_and_names(spark):
    assert one(spark, S.normalized(F.col("p")), p="a/./b/../c") == "a/c"
    assert one(spark, S.package_key(F.lit("pypi"), F.col("p")), p="A_b.C--d") == "a-b-c-d"
    assert one(spark, S.go_pseudo_hash(F.col("p")), p="v0.0.0-20240101120000-abcdef123456") == "abcdef123456"
    assert [tuple(m) for m in one(spark, S.search_marks(F.col("t"), "ab"), t="xABab")] == [(1, 3), (3, 5)]


def test_python_file():
    row = syntax.python_file("m.py", '"""Doc."""\n# note\nimport os\nfrom .x import y\n\nclass A:\n    def f(self):\n        if a and b or c:\n            return 1\n')
    assert row["complexity"] == 4 and row["loc"] == 10 and row["code_lines"] == 6
    assert [s[0] for s in row["symbols"]] == ["A", "f"]
    assert row["imports"] == [(0, "", False, ["os"]), (1, "x", True, ["y"])]
    assert syntax.python_file("b.py", "def (:") is None


def test_other_languages():
    go = syntax.other_file("a.go", 'package a\nimport "fmt"\n// if for\ntype T struct {\n}\nfunc (t T) M() {\n if true {\n }\n}\n', "go")
    assert go["imports"][0][1] == "fmt" and [s[0] for s in go["symbols"]] == ["T", "M"] and go["complexity"] == 1
    ts = syntax.other_file("a.ts", "import { x } from './x';\nexport class C {}\nconst _y = 1;\n", "typescript")
    assert ts["imports"][0][1] == "./x" and [s[0] for s in ts["symbols"]] == ["C"]


@pytest.mark.parametrize(
    ("path", "text", "known"),
    [
        ("a_windows.go", "package a", False), ("a_linux.go", "package a", True), ("a.go", "//go:build windows && goexperiment.x\n\npackage a", False),
        ("a.go", "//go:build goexperiment.x\n\npackage a", None), ("a.go", "//go:build !slicelabels\n\npackage a", True), ("a.go", "//go:build linux &&\n\npackage a", None),
    ],
)
def test_go_build(path, text, known):
    assert syntax.go_in_build(path, text) is known


def test_rust_cfg():
    assert syntax.rust_cfg('all(unix, not(target_os = "windows"))') is True
    assert syntax.rust_cfg('any(windows, feature = "x")') is None
    assert syntax.rust_cfg("all(windows, test)") is False


def test_log_and_changes():
    assert repository.parse_log("@s1\n\na\nb\n@s2\n\na\n") == [(0, "s1", "a"), (0, "s1", "b"), (1, "s2", "a")]
    assert repository.parse_changes("M\0a\0R090\0b\0c\0D\0d\0A\0e\0") == [("modified", "a", "a"), ("renamed", "b", "c"), ("deleted", "d", None), ("added", None, "e")]


def test_manifests():
    p, d = repository.manifest_rows("Cargo.toml", '[package]\nname = "x"\nversion = "0.2.0"\n[dependencies]\na = "1"\nb = { git = "https://github.com/O/R.git", rev = "abcdef1" }\n')
    assert p == [("cargo", "x", "0.2.0", "Cargo.toml")]
    assert [r[3:] for r in d] == [("a", None, "version", "1"), ("b", "o/r", "rev", "abcdef1")]
    with pytest.raises(ValueError):
        repository.manifest_rows("package.json", "{")
    assert repository.pep508("Foo_Bar[x] >=1 ; python_version > '3'") == ("foo-bar", None, "version", ">=1")


def test_organization(spark):
    provided = spark.createDataFrame(
        [("core", "cargo", "acme-core", "0.2.0", "f"), ("core", "npm", "@acme/core", "1.4.0", "f"), ("core", "pypi", "acme-core-py", "0.3.0", "f")],
        "member string, ecosystem string, name string, version string, file string",
    )
    declared = spark.createDataFrame(
        [("app", "cargo", "acme_core", "rev", "aaaaaaa"), ("app", "npm", "@acme/core", "version", "^1.2.0"), ("app", "npm", "left-pad", "version", "1.3.0"), ("app", "pypi", "acme-core-py", "version", ">=0.3"), ("app", "pypi", "./vendored", "path", "./vendored")],
        "member string, ecosystem string, name string, pin_kind string, pin_value string",
    )
    out = organization.resolve(declared, provided)
    assert {(r["name"], r["outcome"]) for r in out.collect()} == {("acme_core", "edge"), ("@acme/core", "edge"), ("left-pad", "external"), ("acme-core-py", "edge"), ("./vendored", "unresolved")}
    members = spark.createDataFrame([("core", "b" * 40)], "target string, commit string")
    status = {r["name"]: r["pin_status"] for r in organization.judged(out.where("outcome = 'edge'"), members).collect()}
    assert status == {"acme_core": "skew", "@acme/core": "match", "acme-core-py": "match"}
    assert organization.repository_edges(out).first()["evidence"] == 3


def test_overlay_round_trip(spark):
    text = 'version = 1\ntitle = "t"\n[[areas]]\nlabel = "a"\nmembers = ["x/*", "y"]\n[[paths]]\nname = "p"\nstops = [{ at = "y" }, { at = "x/1" }]\n'
    rows = overlay.parse(text)
    again = overlay.parse(overlay.to_toml("t", overlay.table(spark, rows)))
    assert sorted(rows) == sorted(again)
    with pytest.raises(ValueError):
        overlay.parse('version = 1\nmore = 2\n')


def test_reexports_stop_at_doubt(spark):
    b = spark.createDataFrame([("a", "x", "b", "x"), ("b", "x", "c", "y"), ("d", "z", "e", "z"), ("d", "z", "f", "z")], "module string, name string, to_module string, to_name string")
    s = spark.createDataFrame([("a", "x"), ("d", "z"), ("q", "w")], "module string, name string")
    out = {(r["module"], r["name"]): (r["target"], r["target_name"]) for r in resolve.followed(s, b).collect()}
    assert out == {("a", "x"): ("c", "y"), ("d", "z"): ("d", "z"), ("q", "w"): ("q", "w")}


def test_linearized():
    out = resolve.linearized({"A": [], "B": ["A"], "C": ["A"], "D": ["B", "C"], "X": ["A", "B"], "Y": ["Y"]})
    assert out["D"] == ["D", "B", "C", "A"] and out["X"] is None and out["Y"] is None
