"""Map geometry: force layout, treemaps, offshore rings, density regions, contours, capacity cells."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import importable

GRID, INSIDE, CONTOUR_POINTS, CONTOUR_SHARE = 420, 0.95, 12, 0.12


def force_layout(count: int, edges: list[tuple], iterations: int = 120, ideal: float | None = None) -> np.ndarray:
    """Points for nodes 0..count-1: golden-angle start, repulsion of all, attraction along edges, cooling, recentred."""
    if not count:
        return np.zeros((0, 2))
    k = np.arange(count)
    radius, angle = np.sqrt((k + 0.5) / count), k * math.pi * (3 - math.sqrt(5))
    at = np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1)
    ideal = ideal or 1 / math.sqrt(count)
    a = np.array([e[0] for e in edges], dtype=int)
    b = np.array([e[1] for e in edges], dtype=int)
    w = np.array([e[2] for e in edges], dtype=float)
    for step in range(iterations):
        diff = at[:, None] - at[None]
        gap = np.maximum(np.sqrt((diff**2).sum(-1)), 1e-6)
        force = (diff / gap[..., None] * (ideal**2 / gap)[..., None]).sum(1)
        if len(a):
            d = at[a] - at[b]
            pull = d * (np.sqrt((d**2).sum(1)) / ideal * w)[:, None]
            np.add.at(force, a, -pull)
            np.add.at(force, b, pull)
        size = np.maximum(np.sqrt((force**2).sum(1)), 1e-9)
        heat = 0.2 * (1 - step / iterations)
        at = at + force / size[:, None] * np.minimum(size, heat)[:, None]
        at -= at.mean(0)
    return at


def normalized(points: np.ndarray) -> np.ndarray:
    if not len(points):
        return points
    low, high = points.min(0), points.max(0)
    span = np.where(high > low, high - low, 1.0)
    return np.where(high > low, (points - low) / span, 0.5)


def squarified(values: list[float], rect: tuple) -> list[tuple]:
    """Rectangles (x, y, w, h) with areas in proportion to the values (largest first), as square as rows allow."""
    total = sum(values)
    if not values or total <= 0:
        return [(rect[0], rect[1], 0.0, 0.0) for _ in values]
    x, y, w, h = rect
    areas = [v / total * w * h for v in values]
    out, i = [], 0
    while i < len(areas):
        side, row = min(w, h), []
        worst = math.inf
        for a in areas[i:]:
            s = sum(row) + a
            ratio = max(max(side * side * r / (s * s), s * s / (side * side * r)) if r > 0 else math.inf for r in [*row, a]) if side > 0 else math.inf
            if row and ratio > worst:
                break
            row.append(a)
            worst = ratio
        depth = sum(row) / side if side > 0 else 0.0
        at = y if w >= h else x
        for a in row:
            length = a / depth if depth > 0 else 0.0
            out.append((x, at, depth, length) if w >= h else (at, y, length, depth))
            at += length
        if w >= h:
            x, w = x + depth, w - depth
        else:
            y, h = y + depth, h - depth
        i += len(row)
    return out


def treemaps(files: DataFrame, centres: DataFrame) -> DataFrame:
    """(file_id, district, x, y, w, h): a district's square, of side sqrt(share of lines) * 0.62 around its centre, cut
    by lines of code.  One task for each district.  Files: file_id, path, district, loc; centres: district, x, y."""
    importable(files.sparkSession)
    total = files.agg(F.sum("loc").cast("double").alias("all"))
    shares = files.groupBy("district").agg(F.sum("loc").alias("own")).crossJoin(F.broadcast(total))
    squares = shares.join(centres, "district").select("district", "x", "y", (F.sqrt(F.col("own") / F.col("all")) * 0.62).alias("side"))
    rows = files.join(squares, "district").select("district", "file_id", "path", F.col("loc").cast("double"), "x", "y", "side")
    kind = files.schema["district"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["loc", "path"], ascending=[False, True])
        x, y, side = (float(frame[c].iloc[0]) for c in ("x", "y", "side"))
        rects = np.array(squarified(frame["loc"].tolist(), (x - side / 2, y - side / 2, side, side))).round(5).reshape(-1, 4)
        out = frame[["file_id", "district"]].copy()
        out[["x", "y", "w", "h"]] = rects
        return out

    return rows.groupBy("district").applyInPandas(run, f"file_id long, district {kind}, x double, y double, w double, h double")


def offshore(districts: DataFrame, ring: float = 0.75, per_ring: int = 24) -> DataFrame:
    """Districts with x, y; islands and unconnected ones on rings around the size-weighted centre of the mainland."""
    main = districts.where("class = 'mainland'")
    centre = main.agg(F.try_divide(F.sum(F.col("x") * F.col("size")), F.sum("size")).alias("cx"), F.try_divide(F.sum(F.col("y") * F.col("size")), F.sum("size")).alias("cy"))
    order = Window.orderBy(F.when(F.col("class") == "island", 0).otherwise(1), F.desc("size"), "district")
    rest = districts.where("class <> 'mainland'").withColumn("k", F.row_number().over(order) - 1).crossJoin(F.broadcast(centre))
    angle = (F.col("k") % per_ring) * (2 * math.pi / per_ring)
    radius = F.lit(ring) + F.floor(F.col("k") / per_ring) * 0.12
    moved = rest.select(
        "district", "size", "class", F.round(F.coalesce("cx", F.lit(0.5)) + radius * F.cos(angle), 4).alias("x"), F.round(F.coalesce("cy", F.lit(0.5)) + radius * F.sin(angle), 4).alias("y")
    )
    return main.select("district", "size", "class", "x", "y").unionByName(moved)


def density_owner(points: np.ndarray, member: np.ndarray, grid: int = GRID, width: float = 0.03, inside: float = INSIDE) -> np.ndarray:
    """Grid of owners (-1: none): each district's Gaussian density, the largest wins, cut where ``inside`` of its members
    still are in their own region."""
    axis = (np.arange(grid) + 0.5) / grid
    best, owner = np.zeros((grid, grid)), np.full((grid, grid), -1)
    for c in np.unique(member):
        own = points[member == c]
        gx = np.exp(-((axis[None] - own[:, :1]) ** 2) / (2 * width**2))
        gy = np.exp(-((axis[None] - own[:, 1:]) ** 2) / (2 * width**2))
        field = gy.T @ gx
        better = field > best
        best[better], owner[better] = field[better], c
    cell = np.clip((points * grid).astype(int), 0, grid - 1)
    for level in (0.5, 0.35, 0.25, 0.15, 0.1, 0.05, 0.02, 0.0):
        mask = best > level
        hit = mask[cell[:, 1], cell[:, 0]] & (owner[cell[:, 1], cell[:, 0]] == member)
        if hit.mean() >= inside or level == 0.0:
            return np.where(mask, owner, -1)
    return owner


def contours(mask: np.ndarray) -> list[np.ndarray]:
    """Closed outlines of a boolean grid, as rings of cell corners."""
    padded = np.pad(mask, 1)
    steps: dict = {}
    for (dy, dx), (a, b) in {(0, -1): ((1, 0), (0, 0)), (-1, 0): ((0, 0), (0, 1)), (0, 1): ((0, 1), (1, 1)), (1, 0): ((1, 1), (1, 0))}.items():
        edge = padded & ~np.roll(padded, (-dy, -dx), (0, 1))
        for y, x in zip(*np.nonzero(edge)):
            steps.setdefault((y + a[0], x + a[1]), []).append((y + b[0], x + b[1]))
    rings = []
    while steps:
        start = min(steps)
        ring, at = [start], steps[start].pop()
        if not steps[start]:
            del steps[start]
        while at != start:
            ring.append(at)
            nxt = steps[at].pop()
            if not steps[at]:
                del steps[at]
            at = nxt
        rings.append(np.array([(x - 1, y - 1) for y, x in ring], dtype=float))
    return rings


def smoothed(ring: np.ndarray, rounds: int = 2) -> np.ndarray:
    for _ in range(rounds):
        after = np.roll(ring, -1, axis=0)
        ring = np.stack([0.75 * ring + 0.25 * after, 0.25 * ring + 0.75 * after], axis=1).reshape(-1, 2)
    return ring


def regions(points: np.ndarray, member: np.ndarray, grid: int = GRID) -> dict[int, list[np.ndarray]]:
    """Smoothed outlines of every district; small scraps are left out."""
    owner = density_owner(points, member, grid)
    out = {}
    for c in np.unique(member):
        rings = contours(owner == c)
        if rings:
            longest = max(map(len, rings))
            out[int(c)] = [smoothed(r) / grid for r in rings if len(r) >= CONTOUR_POINTS and len(r) >= CONTOUR_SHARE * longest]
    return out


def capacity_cells(sites: np.ndarray, weights: np.ndarray, side: int = 96, rounds: int = 60) -> np.ndarray:
    """Raster power diagram of the unit square whose cells' areas follow the weights: each round moves the sites to their
    cells' centres and the radii towards the area wanted."""
    axis = (np.arange(side) + 0.5) / side
    cells = np.stack(np.meshgrid(axis, axis), axis=-1).reshape(-1, 2)
    want = weights / weights.sum()
    sites, power = sites.copy(), np.zeros(len(sites))
    owner = np.zeros(len(cells), dtype=int)
    for step in range(rounds):
        gap = ((cells[:, None] - sites[None]) ** 2).sum(-1) - power[None]
        owner = gap.argmin(1)
        area = np.bincount(owner, minlength=len(sites)) / len(cells)
        if np.abs(area - want).max() < 0.02 * want.max():
            break
        power += 0.5 * (want - area) / math.pi * (1 - step / (2 * rounds))
        for k in np.flatnonzero(area):
            sites[k] = cells[owner == k].mean(0)
    return owner.reshape(side, side)


def encoded_ring(ring: np.ndarray, scale: float = 1e5) -> list[int]:
    """A ring as integer steps: first point, then differences."""
    whole = np.rint(ring * scale).astype(np.int64)
    return np.concatenate([whole[:1], np.diff(whole, axis=0)]).ravel().tolist()


def decoded_ring(steps: list[int], scale: float = 1e5) -> np.ndarray:
    return np.cumsum(np.array(steps, dtype=np.int64).reshape(-1, 2), axis=0) / scale


def area_fit(files: DataFrame) -> DataFrame:
    """One row: Pearson correlation of footprint weight (code lines, else lines) and area."""
    return files.agg(F.corr(F.coalesce("code_lines", "loc").cast("double"), "area").alias("r"))


def containing(points: DataFrame, boxes: DataFrame, cell: float = 0.05) -> DataFrame:
    """(point, box): boxes (box, x0, y0, x1, y1) that hold a point (point, x, y), through grid buckets."""
    at = lambda c: F.floor(F.col(c) / cell).cast("int")
    tiles = boxes.select("*", F.explode(F.sequence(at("x0"), at("x1"))).alias("gx")).select("*", F.explode(F.sequence(at("y0"), at("y1"))).alias("gy"))
    met = points.withColumns({"gx": at("x"), "gy": at("y")}).join(tiles, ["gx", "gy"])
    return met.where("x >= x0 and x < x1 and y >= y0 and y < y1").select("point", "box")
