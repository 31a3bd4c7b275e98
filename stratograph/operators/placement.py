"""Places on a map: files inside districts, repositories of an organization, symbol cards, and points in polygons."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import importable
from .layout import encoded_ring, force_layout, normalized, squarified

ORG_STEPS, APART_STEPS, RELAX_STEPS = 64, 32, 8
#: Coordinates of a card are stored as whole numbers of this fraction.
CARD_SCALE = 1e11


def apart(points: np.ndarray, gap: float, steps: int) -> np.ndarray:
    """Points moved until none is nearer to another than ``gap``, or for so many steps; cells of the gap's size tell which
    ones can be near, so that the work grows with the points."""
    at = points.copy()
    for _ in range(steps):
        cell = np.floor(at / gap).astype(np.int64)
        order = np.lexsort((cell[:, 1], cell[:, 0]))
        keys = {}
        for i in order.tolist():
            keys.setdefault((int(cell[i, 0]), int(cell[i, 1])), []).append(i)
        move, hit = np.zeros_like(at), False
        for (x, y), own in keys.items():
            near = [j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in keys.get((x + dx, y + dy), ())]
            for i in own:
                d = at[i] - at[near]
                r = np.sqrt((d**2).sum(1))
                close = (r < gap) & (np.array(near) != i)
                if close.any():
                    hit = True
                    away = np.where(r[close, None] > 1e-12, d[close] / np.maximum(r[close, None], 1e-12), _direction(i))
                    move[i] += (away * ((gap - r[close]) / 2)[:, None]).sum(0)
        if not hit:
            break
        at += move
    return at


def _direction(i: int) -> np.ndarray:
    angle = i * math.pi * (3 - math.sqrt(5))
    return np.array([math.cos(angle), math.sin(angle)])


def place_files(groups: list, degree: list[float], edges: list[tuple]) -> np.ndarray:
    """Points in the unit square for the files of one district.

    ``groups``: each file's neighbourhood; the neighbourhoods stand by a force layout of the weight between them, and a
    neighbourhood's files on a spiral around its middle, the best linked inside.  The 5th to the 95th percentile fill the
    square, what lies beyond is on its border, and files that stand on each other are moved apart.
    """
    n = len(groups)
    if not n:
        return np.zeros((0, 2))
    names = sorted(set(groups))
    number = {g: i for i, g in enumerate(names)}
    own = np.array([number[g] for g in groups])
    between: dict = {}
    for a, b, w in edges:
        x, y = sorted((int(own[a]), int(own[b])))
        if x != y:
            between[x, y] = between.get((x, y), 0.0) + w
    top = max(between.values(), default=1.0)
    centre = normalized(force_layout(len(names), [(x, y, w / top) for (x, y), w in sorted(between.items())]))
    size = np.bincount(own, minlength=len(names))
    at = np.zeros((n, 2))
    for g in range(len(names)):
        mine = np.flatnonzero(own == g)
        order = mine[np.lexsort((mine, -np.array(degree)[mine]))]
        k = np.arange(len(order))
        radius = 0.45 * np.sqrt(size[g] / n) * np.sqrt((k + 0.5) / len(order)) if len(order) > 1 else np.zeros(1)
        angle = k * math.pi * (3 - math.sqrt(5))
        at[order] = centre[g] + np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1)
    low, high = np.percentile(at, 5, axis=0), np.percentile(at, 95, axis=0)
    span = np.where(high > low, high - low, 1.0)
    at = np.where(high > low, np.clip((at - low) / span, 0, 1), 0.5)
    return np.clip(apart(at, 0.5 / math.sqrt(n), RELAX_STEPS), 0, 1)


def file_places(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_id, district, x, y) of files (file_id, district, neighbourhood); edges: a, b, weight.  A task has a district."""
    importable(files.sparkSession)
    at = lambda end: files.select(F.col("file_id").alias(end), F.col("district").alias(f"d_{end}"))
    inner = edges.join(at("a"), "a").join(at("b"), "b").where("d_a = d_b").select(F.col("d_a").alias("district"), "a", "b", "weight")
    kind = files.schema["district"].dataType.simpleString()

    def run(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("file_id", ignore_index=True)
        place = {f: i for i, f in enumerate(nodes["file_id"])}
        rows = [(place[a], place[b], w) for a, b, w in zip(links["a"], links["b"], links["weight"])]
        degree = np.zeros(len(nodes))
        for a, b, w in rows:
            degree[a] += w
            degree[b] += w
        xy = place_files(nodes["neighbourhood"].tolist(), degree.tolist(), sorted(rows))
        return pd.DataFrame({"file_id": nodes["file_id"], "district": nodes["district"], "x": np.round(xy[:, 0], 4), "y": np.round(xy[:, 1], 4)})

    rows = files.select("file_id", "district", "neighbourhood").groupBy("district").cogroup(inner.groupBy("district"))
    return rows.applyInPandas(run, f"file_id long, district {kind}, x double, y double")


def organization_places(members: list[str], edges: list[tuple[str, str, int]]) -> dict[str, tuple[float, float]]:
    """A point for each repository: a force layout by the logarithm of the evidence, then kept apart."""
    names = sorted(members)
    number = {m: i for i, m in enumerate(names)}
    rows = [(number[a], number[b], math.log1p(n)) for a, b, n in sorted(edges) if a != b]
    at = normalized(force_layout(len(names), rows, ORG_STEPS))
    if len(names):
        at = apart(at, 0.6 / math.sqrt(len(names)), APART_STEPS)
    return {m: (round(float(x), 4), round(float(y), 4)) for m, (x, y) in zip(names, at)}


def symbol_cards(spans: list[tuple], rect: tuple = (0.0, 0.0, 1.0, 1.0)) -> list[tuple]:
    """(symbol, ring) of one file's symbols (symbol, parent, lines): every symbol has a share of its parent's area by its
    lines, the file's own rectangle at the top; rings as whole numbers, the first point and then differences."""
    below: dict = {}
    for s, parent, lines in spans:
        below.setdefault(parent, []).append((s, max(lines, 1)))
    known, out = {s for s, _, _ in spans}, []
    todo = [(p, rect) for p in sorted(below, key=str) if p not in known]
    while todo:
        parent, (x, y, w, h) = todo.pop()
        rows = sorted(below.get(parent, []), key=lambda r: (-r[1], r[0]))
        for (s, _), (a, b, c, d) in zip(rows, squarified([float(n) for _, n in rows], (x, y, w, h))):
            ring = np.array([[a, b], [a + c, b], [a + c, b + d], [a, b + d]])
            out.append((s, encoded_ring(ring, CARD_SCALE)))
            todo.append((s, (a, b, c, d)))
    return sorted(out)


def cards(symbols: DataFrame) -> DataFrame:
    """(file_id, sym, ring) of symbols (file_id, sym, parent, lines); a task has a file."""
    importable(symbols.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parents = [None if pd.isna(p) else int(p) for p in rows["parent"]]
        out = symbol_cards(list(zip(rows["sym"].tolist(), parents, rows["lines"].tolist())))
        return pd.DataFrame({"file_id": [rows["file_id"].iloc[0]] * len(out), "sym": [s for s, _ in out], "ring": [r for _, r in out]})

    return symbols.select("file_id", "sym", "parent", "lines").groupBy("file_id").applyInPandas(run, "file_id long, sym long, ring array<long>")


def inside_polygons(points: DataFrame, polygons: DataFrame, cell: float = 0.05) -> DataFrame:
    """(point, polygon): polygons (polygon, ring: array of x, y) around a point (point, x, y): grid cells of the polygons'
    boxes find the pairs, the parity of crossed sides decides."""
    grid = lambda c: F.floor(c / F.lit(cell)).cast("int")
    side = lambda c, f: grid(f(F.transform("ring", lambda p: p[c])))
    tiles = polygons.select("*", F.explode(F.sequence(side("x", F.array_min), side("x", F.array_max))).alias("gx"))
    tiles = tiles.select("*", F.explode(F.sequence(side("y", F.array_min), side("y", F.array_max))).alias("gy"))
    met = points.withColumns({"gx": grid(F.col("x")), "gy": grid(F.col("y"))}).join(tiles, ["gx", "gy"])
    following = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    crosses = lambda p, q: ((p["y"] > F.col("y")) != (q["y"] > F.col("y"))) & (
        F.col("x") < (q["x"] - p["x"]) * (F.col("y") - p["y"]) / (q["y"] - p["y"]) + p["x"]
    )
    count = F.aggregate(F.zip_with("ring", following, lambda p, q: F.coalesce(crosses(p, q), F.lit(False)).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return met.where(count % 2 == 1).select("point", "polygon")
