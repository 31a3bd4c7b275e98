"""Manifests, roots and entry points of small repositories; names in Python files; texts."""

import pytest

from stratograph.functions import text
from stratograph.operators import detect, imports
from stratograph.sources import go_names, python_names, repository

REPO = {
    "go.mod": "module example.org/town\n\ngo 1.22\n",
    "cmd/run/main.go": "package main\n\nfunc main() {}\n",
    "hall/hall.go": "package hall\n",
    "tools/deep/go.mod": 'module "example.org/town/deep"\n',
    "tools/deep/x/x.go": "package x\n",
    "package.json": '{"name": "root", "workspaces": ["apps/*", "!apps/old"], /* note */ "bin": {"run": "./dist/cli.js"},}',
    "apps/web/package.json": '{"name": "web", "exports": {".": {"types": "./dist/i.d.ts", "import": "./src/index.ts"}, "./f/*": "./src/f/*.ts"}, "main": "lib/x.js"}',
    "apps/web/tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "up": ["../up/index.ts"]}}}',
    "apps/old/package.json": '{"name": "old"}',
    "apps/web/src/index.ts": "export {}",
    "apps/web/index.html": '<script type="module" src="/src/start.ts"></script><script src="/no.js"></script>',
    "apps/web/src/start.ts": "",
    "apps/web/build.js": "build({entryPoints: ['src/worker.ts', `no`]})",
    "apps/web/src/worker.ts": "",
    "src/cli.ts": "",
    "Cargo.toml": '[workspace]\nmembers = ["crates/*"]\n',
    "crates/a/Cargo.toml": '[package]\nname = "a"\n[[bin]]\nname = "one"\n',
    "crates/a/src/lib.rs": "", "crates/a/src/bin/one.rs": "", "crates/a/build.rs": "",
    "py/pyproject.toml": '[project]\nname = "Town-Hall"\n[tool.setuptools.packages.find]\nwhere = ["source"]\n',
    "py/source/town_hall/__init__.py": "", "py/source/town_hall/door.py": "", "py/source/other/__init__.py": "",
    "broken/Cargo.toml": "not toml [",
}


@pytest.fixture(scope="module")
def repo(spark):
    files = spark.createDataFrame(list(REPO.items()), "path string, content string").coalesce(1)
    facts = spark.createDataFrame(detect.manifest_facts(files).collect(), detect.FACTS).coalesce(1)
    return files, facts


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_roots(repo):
    files, facts = repo
    got = {r["language"]: (r["pkg"], r["files"], r["confidence"]) for r in detect.root_candidates(facts, files).collect()}
    assert got["go"] == (".", 3, "high") and got["rust"] == ("crates/a", 3, "high")
    assert got["typescript"] == ("apps/web", 3, "medium") and got["python"] == ("py/source/town_hall", 2, "high")


def test_workspace_and_packages(repo):
    _, facts = repo
    assert pairs(detect.workspace_folders(facts), "folder", "name") == [("apps/web", "web"), ("crates/a", "a")]
    packages = {r["name"]: (r["dir"], r["entries"]) for r in detect.stated_packages(facts).collect()}
    assert packages["web"] == ("apps/web", ["dist/i.d.ts", "src/index.ts", "lib/x.js"]) and packages["old"] == ("apps/old", [])
    aliases = pairs(facts.where("kind = 'alias'"), "folder", "name", "value")
    assert aliases == [("apps/web", "@/", "apps/web/src/"), ("apps/web", "up", "apps/up/index.ts")]


def test_entries(repo):
    files, facts = repo
    assert pairs(detect.entry_points(facts, files), "path", "reason") == [
        ("apps/web/src/index.ts", "manifest package"), ("apps/web/src/start.ts", "manifest vite"), ("cmd/run/main.go", "go main"),
        ("crates/a/build.rs", "cargo build"), ("crates/a/src/bin/one.rs", "cargo bin"), ("crates/a/src/lib.rs", "cargo lib"), ("src/cli.ts", "manifest bin by its stem"),
    ]
    assert pairs(detect.config_entries(facts, files), "path") == [("apps/web/src/worker.ts",)]
    assert pairs(detect.crate_targets(facts, files), "crate", "kind", "path") == [("a", "bin", "crates/a/src/bin/one.rs"), ("a", "build", "crates/a/build.rs"), ("a", "lib", "crates/a/src/lib.rs")]


def test_go_packages(spark, repo):
    files, facts = repo
    asked = [("m.go", "example.org/town/hall"), ("m.go", "example.org/town/deep/x"), ("m.go", "example.org/townhall"), ("m.go", "fmt")]
    got = detect.go_imports(spark.createDataFrame(asked, "src string, specifier string"), facts, files)
    assert pairs(got, "specifier", "folder") == [("example.org/town/deep/x", "tools/deep/x"), ("example.org/town/hall", "hall")]


def test_rust_modules_beside_and_below(spark):
    files = spark.createDataFrame([(p,) for p in ("src/lib.rs", "src/a.rs", "src/a/b/mod.rs", "src/b.rs")], "path string")
    tree = imports.module_files(spark.createDataFrame([("src/lib.rs", "a"), ("src/a.rs", "b"), ("src/lib.rs", "gone")], "src string, name string"), files)
    assert pairs(tree, "src", "name", "dst") == [("src/a.rs", "b", "src/a/b/mod.rs"), ("src/lib.rs", "a", "src/a.rs")]
    paths = imports.module_paths(tree, spark.createDataFrame([("src/lib.rs", "crate")], "path string, crate string"))
    assert pairs(paths, "module", "path") == [("crate", "src/lib.rs"), ("crate::a", "src/a.rs"), ("crate::a::b", "src/a/b/mod.rs")]


SOURCE = '''import os.path
import town.road as way
from .hall import open_doors as doors, Hall
from town.park import *

__all__ = ["Visitor", "doors"]

@way.marked
class Visitor(Hall):
    pace: int = way.STEP

    def walk(self, to: Hall, fast=None) -> "x":
        here = doors(to)
        if fast:
            return os.path.join(here, way.name)

def alone(x):
    return [x for _ in range(3)]

if __all__:
    late = 1
'''


def test_python_names():
    got = python_names.names_of(SOURCE)
    assert got["defined"] == ["Visitor", "alone", "late"] and got["stars"] == ["town.park"] and got["listed"] == ["Visitor", "doors"] and not got["computed"]
    assert ("way", "town.road", None) in got["bindings"] and ("doors", ".hall", "open_doors") in got["bindings"] and ("os", "os", None) in got["bindings"]
    assert ("way", "STEP") in got["attributes"] and ("os.path", "join") in got["attributes"] and "range" in got["bare"] and "way" not in got["bare"]
    assert [(s[1], s[2], s[3], s[4], s[5]) for s in got["spans"]] == [("Visitor", "class", 8, 15, -1), ("walk", "method", 12, 15, 0), ("alone", "function", 17, 18, -1)]
    refs = {(o, h, a, k) for o, h, a, k, _ in got["candidates"]}
    assert {(0, "way", "marked", "decorator"), (0, "Hall", None, "extends"), (1, "Hall", None, "annotation"), (1, "doors", None, "call"), (1, "os.path", "join", "call"), (1, "way", "name", "value")} <= refs
    assert (1, "to") in got["shadowed"] and (1, "here") in got["shadowed"] and (2, "x") in got["shadowed"]
    assert python_names.names_of("def (") is None and python_names.names_of("__all__ = [n for n in dir()]")["computed"]


def test_python_name_table(spark):
    rows = python_names.python_names(spark.createDataFrame([("a.py", SOURCE), ("b.py", "def ("), ("c.py", None)], "path string, content string")).collect()
    assert {r["path"]: len(r["spans"]) for r in rows} == {"a.py": 3, "c.py": 0}


GO = """// package wrong
package hall

import "fmt"
import (
	alias "example.org/town/road"
	"example.org/town/park/v2"
)

type Door struct{ n int }
type Opener interface { Open() error }
const limit = 3

func (d *Door) Open(a, b int, f func(x int) error) (int, error) { fmt.Println("func (x Y) No()") ; return alias.Width, nil }
func (s Stack[T]) Push(v T) {}
func plain() error { return nil }
func Map[K any](k K) {}
"""


def test_go_names(spark):
    got = go_names.go_file(GO)
    assert got["package"] == "hall" and got["imports"] == [("fmt", "fmt"), ("alias", "example.org/town/road"), ("v2", "example.org/town/park/v2")]
    assert got["selectors"] == [("alias", "Width"), ("fmt", "Println")]
    assert [d[:5] for d in got["declared"]] == [
        ("Door", "struct", None, None, None), ("Opener", "interface", None, None, None), ("limit", "const", None, None, None),
        ("Open", "method", "Door", 3, 2), ("Push", "method", "Stack", 1, 0), ("plain", "func", None, 0, 1), ("Map", "func", None, 1, 0),
    ]
    assert go_names.go_names(spark.createDataFrame([("a.go", GO), ("b.go", None)], "path string, content string")).count() == 2


def test_setup_files():
    provided, declared = repository.manifest_rows("setup.py", "from setuptools import setup\nsetup(name='A_b', version='1', install_requires=['x>=2', 'y'])\n")
    assert provided == [("pypi", "a-b", "1", "setup.py")] and [d[3] for d in declared] == ["x", "y"]
    provided, declared = repository.manifest_rows("p/setup.cfg", "[metadata]\nname = c\n[options]\ninstall_requires =\n    z==1\n")
    assert provided == [("pypi", "c", None, "p/setup.cfg")] and [d[3] for d in declared] == ["z"]
    with pytest.raises(ValueError):
        repository.manifest_rows("setup.py", "setup(")


def test_texts():
    assert text.path_hash(["a"]) == "cycle-" + format(fnv(b"a\0"), "016x") and text.path_hash(["b", "a"]) == text.path_hash(["a", "b"])
    assert text.jsonc('{"a": "// no", /* x */ "b": [1, 2,], }') == {"a": "// no", "b": [1, 2]} and text.jsonc("{") is None
    table = {".": {"require": "./r.js", "import": "./i.mjs"}, "./x/*": "./src/*.ts", "./x/y": ["./y.ts"], "./x/d/*.js": "./d/*.ts"}
    assert text.export_targets(table) == ["./i.mjs", "./r.js"] and text.export_targets("./m.js") == ["./m.js"]
    assert text.export_targets(table, "./x/q") == ["./src/q.ts"] and text.export_targets(table, "./x/y") == ["./y.ts"] and text.export_targets(table, "./x/d/e.js") == ["./d/e.ts"]
    assert text.export_targets(table, "./none") == []
    import re

    match = lambda p, s: bool(re.match(text.workspace_regex(p), s))
    assert match("apps/*", "apps/a") and not match("apps/*", "apps/a/b") and match("apps/**", "apps/a/b") and match("**/x", "a/b/x") and match("./p.q", "p.q") and not match("p.q", "pxq")


def fnv(data):
    # known vectors of the published algorithm are checked first
    def run(d):
        h = 0xCBF29CE484222325
        for b in d:
            h = ((h ^ b) * 0x100000001B3) & (2**64 - 1)
        return h

    assert run(b"") == 0xCBF29CE484222325 and run(b"a") == 0xAF63DC4C8601EC8C and run(b"foobar") == 0x85944171F73967E8
    return run(data)
