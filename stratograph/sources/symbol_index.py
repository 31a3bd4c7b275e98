"""Compiler symbol indexes in protobuf: documents read one at a time, definitions and references as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .tables import importable

OCCURRENCES = "path string, symbol string, line int, definition boolean"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields; fixed-width ones as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield number, data[at : at + size]
            at += size
        elif kind == 2:
            size = varint()
            if at + size > len(data):
                raise ValueError("a field ends past its message")
            yield number, data[at : at + size]
            at += size
        else:
            raise ValueError(f"unknown wire type {kind}")


def packed(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for b in data:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(value)
            value = shift = 0
    return out


# Field numbers of the format.
INDEX_DOCUMENT, DOCUMENT_PATH, DOCUMENT_OCCURRENCE = 2, 1, 2
OCCURRENCE_RANGE, OCCURRENCE_SYMBOL, OCCURRENCE_ROLES, ROLE_DEFINITION = 1, 2, 3, 1


def occurrences(data: bytes) -> Iterator[tuple[str, str, int, bool]]:
    """(path, symbol, line from 1, whether it is a definition) of an index."""
    for number, document in fields(data):
        if number != INDEX_DOCUMENT:
            continue
        path, found = "", []
        for n, value in fields(document):
            if n == DOCUMENT_PATH:
                path = value.decode()
            elif n == DOCUMENT_OCCURRENCE:
                line, symbol, roles = 0, "", 0
                for m, part in fields(value):
                    if m == OCCURRENCE_RANGE:
                        line = (packed(part)[0] if isinstance(part, bytes) else part) + 1
                    elif m == OCCURRENCE_SYMBOL:
                        symbol = part.decode()
                    elif m == OCCURRENCE_ROLES:
                        roles = part
                found.append((symbol, line, bool(roles & ROLE_DEFINITION)))
        yield from ((path, *f) for f in found if f[0])


def scan(spark: SparkSession, folder: str, glob: str = "*.scip") -> DataFrame:
    """Occurrences of all index files in a folder, read on the executors."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("content")

    importable(spark)

    def run(frames):
        for frame in frames:
            for data in frame["content"]:
                rows = list(occurrences(bytes(data)))
                for i in range(0, len(rows), 50_000):
                    yield pd.DataFrame(rows[i : i + 50_000], columns=["path", "symbol", "line", "definition"])

    return raw.mapInPandas(run, OCCURRENCES)
