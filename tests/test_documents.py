"""Map documents, symbol indexes and proposals."""

import pytest

from stratograph.operators import suggest, symbols
from stratograph.sources import document, symbol_index


def map_tables(spark, districts=(0, 0, 1)):
    files = spark.createDataFrame(
        [(i, f"p/{c}.py", d, 0.1, 0.2, 10 + i, 2, 1, 1.0, 0.0, 0.0, 0.5, 0.5, 7) for i, (c, d) in enumerate(zip("abc", districts))],
        "file_id long, path string, district long, x double, y double, loc long, complexity long, churn long, fanin double, rx double, ry double, rw double, rh double, code_lines long",
    )
    return files, spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"), spark.createDataFrame([(0, "zero"), (1, "one")], "district long, name string")


def test_document_round_trip(spark, tmp_path):
    document.write(document.document(*map_tables(spark), "r", "c", "py", 0.25), str(tmp_path / "m"))
    got = document.load(spark, str(tmp_path / "m"))
    assert [(r["path"], r["district"], r["loc"]) for r in got["files"].orderBy("file_id").collect()] == [("p/a.py", 0.0, 10.0), ("p/b.py", 0.0, 11.0), ("p/c.py", 1.0, 12.0)]
    assert {(r["src"], r["dst"]) for r in got["arcs"].collect()} == {(0, 1), (1, 2)}
    assert got["head"].first()["q"] == 0.25


def test_bad_document_is_refused(spark, tmp_path):
    document.write(document.document(*map_tables(spark, (0, 0, 9)), "r", "c", "py", 0.0), str(tmp_path / "m"))
    with pytest.raises(ValueError, match="no name"):
        document.load(spark, str(tmp_path / "m"))


def message(*parts):
    out = b""
    for number, value in parts:
        if isinstance(value, int):
            out += bytes([number << 3, value])
        else:
            out += bytes([number << 3 | 2, len(value)]) + value
    return out


def test_symbol_index(spark, tmp_path):
    hit = message((1, bytes([4, 0, 9])), (2, b"pkg A#"), (3, 1))
    use = message((1, bytes([6, 0, 9])), (2, b"pkg A#"))
    doc = message((1, b"a.py"), (2, hit)) + message((2, use))
    (tmp_path / "x.scip").write_bytes(message((1, b"meta")) + message((2, doc)))
    rows = {tuple(r) for r in symbol_index.scan(spark, str(tmp_path)).collect()}
    assert rows == {("a.py", "pkg A#", 5, True), ("a.py", "pkg A#", 7, False)}
    with pytest.raises(ValueError):
        list(symbol_index.fields(bytes([0x12, 9, 1])))


def test_entry_route_leaves_home_before_it_cannot(spark):
    files = spark.createDataFrame([(0, 0, 0.0), (1, 0, 9.0), (2, 1, 1.0), (3, 0, 5.0)], "file_id long, district long, fanin double")
    arcs = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "src long, dst long")
    out = suggest.entry_routes(arcs, files, files.where("file_id = 0")).orderBy("step").collect()
    assert [r["file_id"] for r in out] == [0, 2]


def test_overrides(spark):
    methods = spark.createDataFrame([("A", "f", 1), ("B", "f", 2), ("B", "g", 3)], "cls string, name string, sym_id long")
    inherited = spark.createDataFrame([("B", "f", "A")], "cls string, name string, owner string")
    assert [tuple(r) for r in symbols.overrides(methods, inherited).collect()] == [(2, 1)]
