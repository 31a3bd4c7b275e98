"""Relatedness signals between files and the candidate graph that they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import dirname, proximity, round_even

#: Shares of the signals in an edge's weight.
SHARES = {"static_s": 0.45, "cochange_s": 0.35, "proximity_s": 0.08, "semantic_s": 0.12}
MIN_COMMIT, MAX_COMMIT = 2, 40
MIN_SOLO, MIN_PAIRS = 3, 2
COSINE_FLOOR = 0.28
ALL_PAIRS_FILES = 600
CANDIDATE_FLOOR = 0.02
#: Vectors of a chunk, about; most blocks whose sizes are sent to every executor.
CHUNK, MAX_BROADCAST_BLOCKS = 10_000, 200_000


def churn(commit_files: DataFrame) -> DataFrame:
    """(f, churn): commits that touch a file, of any size."""
    return commit_files.groupBy("f").agg(F.count_distinct("sha").alias("churn"))


def cochange_pairs(commit_files: DataFrame, min_solo: int = MIN_SOLO, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """(a, b, cnt, weight), a < b: files changed together in commits of 2 to 40 files.

    A commit is bounded before its pairs are made, so a row meets 39 others at most.
    """
    touched = commit_files.select("sha", "f").distinct()
    sizes = touched.groupBy("sha").agg(F.count("*").alias("size")).where(F.col("size").between(MIN_COMMIT, MAX_COMMIT))
    bounded = touched.join(sizes.select("sha"), "sha")
    pairs = (
        bounded.select("sha", F.col("f").alias("a"))
        .join(bounded.select("sha", F.col("f").alias("b")), "sha")
        .where("a < b")
        .groupBy("a", "b")
        .agg(F.count("*").alias("cnt"))
        .where(F.col("cnt") >= min_pairs)
    )
    return with_solo(pairs, touched).where(F.col("solo") >= min_solo).select("a", "b", "cnt", (F.col("cnt") / F.col("solo")).alias("weight"))


def with_solo(pairs: DataFrame, touched: DataFrame) -> DataFrame:
    """Pairs with ``solo``, the commits (sha, f) of the file that has fewer."""
    solo = touched.groupBy("f").agg(F.count("*").alias("solo"))
    out = pairs.join(solo.select(F.col("f").alias("a"), F.col("solo").alias("solo_a")), "a").join(
        solo.select(F.col("f").alias("b"), F.col("solo").alias("solo_b")), "b"
    )
    return out.withColumn("solo", F.least("solo_a", "solo_b")).drop("solo_a", "solo_b")


def carriers(commit_files: DataFrame, settings: list[tuple[int, int]]) -> DataFrame:
    """(min_solo, min_pairs, pairs): how many pairs each setting leaves; the pairs are made once."""
    floor = min(p for _, p in settings), min(s for s, _ in settings)
    pairs = cochange_pairs(commit_files, floor[1], floor[0]).withColumn("solo", F.rint(F.col("cnt") / F.col("weight")))
    counts = pairs.agg(*[F.count_if((F.col("solo") >= s) & (F.col("cnt") >= p)).alias(f"n{i}") for i, (s, p) in enumerate(settings)])
    rows = F.array(*[F.struct(F.lit(s).alias("min_solo"), F.lit(p).alias("min_pairs"), F.col(f"n{i}").alias("pairs")) for i, (s, p) in enumerate(settings)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def term_vectors(terms: DataFrame, total: int) -> DataFrame:
    """(id, term, w): unit TF-IDF vectors of (id, term, tf); terms in fewer than two or more than half of ``total``
    items are dropped before the norm."""
    df = terms.groupBy("term").agg(F.count_distinct("id").alias("df")).where((F.col("df") >= 2) & (F.col("df") <= 0.5 * total))
    weighted = terms.join(df, "term").withColumn("w", (1 + F.log("tf")) * F.log(F.lit(float(total)) / F.col("df")))
    weighted = weighted.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))).where("norm > 0")
    return weighted.select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


def cosine_pairs(vectors: DataFrame, block: str | None = None, floor: float = COSINE_FLOOR) -> DataFrame:
    """(a, b, cosine), a < b, above ``floor``; only pairs with an equal ``block`` column, if one is given.

    A block's vectors are dealt to chunks, and each pair of chunks is a task: it lists one chunk's vectors by term and adds
    up, vector by vector of the other, what the lists hold.  Only vectors move, once for each chunk of their block; pairs
    under the floor are never written.
    """
    from ..sources.tables import checkpointed, importable

    importable(vectors.sparkSession)
    kind = vectors.schema["id"].dataType.simpleString()
    entries = vectors.where("term is not null").select("id", "term", "w", (F.col(block) if block else F.lit(0)).alias("k"))
    docs = checkpointed(entries.where("k is not null").groupBy("id", "k").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("ws")))
    parts = checkpointed(docs.groupBy("k").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("parts")))
    dealt = docs.join(F.broadcast(parts) if parts.count() <= MAX_BROADCAST_BLOCKS else parts, "k").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("k", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "id", "terms", "ws")

    def run(key, cell):
        import numpy as np
        import pyarrow as pa

        ids, chunk = cell["id"].to_numpy(), cell["chunk"].to_numpy()
        lists = cell["terms"].combine_chunks()
        starts = lists.offsets.to_numpy()
        starts = starts - starts[0]
        term = lists.flatten().dictionary_encode().indices.to_numpy()
        weight = cell["ws"].combine_chunks().flatten().to_numpy()
        owner = np.repeat(np.arange(len(ids)), np.diff(starts))
        listed = np.flatnonzero(chunk[owner] == key["j"])
        listed = listed[np.argsort(term[listed], kind="stable")]
        holder, held = owner[listed], weight[listed]
        ptr = np.concatenate([[0], np.cumsum(np.bincount(term[listed], minlength=term.max(initial=0) + 1))])
        left, right, sums = [], [], []
        for x in np.flatnonzero(chunk == key["i"]):
            own = slice(starts[x], starts[x + 1])
            begin = ptr[term[own]]
            count = ptr[term[own] + 1] - begin
            at = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
            cosine = np.bincount(holder[at], np.repeat(weight[own], count) * held[at], len(ids))
            hits = np.flatnonzero(cosine > floor)
            hits = hits[ids[hits] > ids[x]] if key["i"] == key["j"] else hits
            left.append(np.minimum(ids[hits], ids[x]) if ids.dtype != object else np.array([min(v, ids[x]) for v in ids[hits]], object))
            right.append(np.maximum(ids[hits], ids[x]) if ids.dtype != object else np.array([max(v, ids[x]) for v in ids[hits]], object))
            sums.append(cosine[hits])
        kept = [np.concatenate(c) if c else [] for c in (left, right, sums)]
        return pa.table({"a": pa.array(kept[0], cell.schema.field("id").type), "b": pa.array(kept[1], cell.schema.field("id").type), "cosine": pa.array(kept[2], pa.float64())})

    run_cell = lambda key, cell: run({"i": key[1].as_py(), "j": key[2].as_py()}, cell)
    return cells.groupBy("k", "i", "j").applyInArrow(run_cell, f"a {kind}, b {kind}, cosine double")


def semantic_pairs(vectors: DataFrame, files: DataFrame, floor: float = COSINE_FLOOR) -> DataFrame:
    """Cosine pairs of files (file_id, path): all of them up to 600 files, beyond only those in one directory."""
    placed = vectors.join(files.select(F.col("file_id").alias("id"), dirname(F.col("path")).alias("dir")), "id")
    return cosine_pairs(placed, None if files.count() <= ALL_PAIRS_FILES else "dir", floor)


def candidate_pairs(*pairs: DataFrame) -> DataFrame:
    """The distinct unordered pairs of several signals."""
    out = None
    for p in pairs:
        p = p.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        out = p if out is None else out.union(p)
    return out.distinct()


def static_max(static: DataFrame, files: DataFrame) -> DataFrame:
    """(lang, top): largest static weight of each language, 1 at least."""
    named = static.join(files.select(F.col("file_id").alias("a"), "lang"), "a")
    top = named.groupBy("lang").agg(F.max("weight").alias("top"))
    return files.select("lang").distinct().join(top, "lang", "left").select("lang", F.greatest(F.coalesce("top", F.lit(0.0)), F.lit(1.0)).alias("top"))


def assemble(pairs: DataFrame, files: DataFrame, static: DataFrame, cochange: DataFrame, semantic: DataFrame) -> DataFrame:
    """Candidate edges with four signals and a weight; those under the floor are dropped."""
    at = lambda end: files.select(F.col("file_id").alias(end), F.col("path").alias(f"path_{end}"), F.col("lang").alias(f"lang_{end}"))
    top = static_max(static, files)
    out = (
        pairs.join(at("a"), "a")
        .join(at("b"), "b")
        .join(top.select(F.col("lang").alias("lang_a"), "top"), "lang_a")
        .join(static.select("a", "b", F.col("weight").alias("st")), ["a", "b"], "left")
        .join(cochange.select("a", "b", F.col("weight").alias("co")), ["a", "b"], "left")
        .join(semantic.select("a", "b", F.col("cosine").alias("se")), ["a", "b"], "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = out.select(
        "a",
        "b",
        (zero("st") / F.col("top")).alias("static_s"),
        F.least(zero("co"), F.lit(1.0)).alias("cochange_s"),
        proximity(F.col("path_a"), F.col("path_b")).alias("proximity_s"),
        zero("se").alias("semantic_s"),
    )
    weight = sum((F.lit(share) * F.col(c) for c, share in SHARES.items()), F.lit(0.0))
    out = out.withColumn("weight", weight).where(F.col("weight") >= CANDIDATE_FLOOR)
    return out.select("a", "b", *[round_even(F.col(c), 4).alias(c) for c in SHARES], round_even(F.col("weight"), 5).alias("weight"))


def import_shares(arcs: DataFrame) -> DataFrame:
    """(src, dst, share): one import of a source is shared over its targets."""
    per = Window.partitionBy("src")
    return arcs.select("src", "dst").distinct().withColumn("share", F.lit(1.0) / F.count("*").over(per))


def fan_in(shares: DataFrame, digits: int | None = 2) -> DataFrame:
    """(dst, fanin): import mass that arrives at a file; without ``digits`` it is not rounded."""
    total: Column = F.sum("share")
    return shares.where("src <> dst").groupBy("dst").agg((round_even(total, digits) if digits is not None else total).alias("fanin"))


def descendant_fan_in(tree: DataFrame, shares: DataFrame) -> DataFrame:
    """(dst, fanin): import mass that a file gets from its own subtree (parent, child)."""
    from ..sources.tables import checkpointed

    closure = step = tree.select(F.col("parent").alias("top"), F.col("child").alias("below"))
    while True:  # down the tree, until its depth is reached
        step = checkpointed(
            step.join(tree.select(F.col("parent").alias("below"), "child"), "below")
            .select("top", F.col("child").alias("below"))
            .join(closure, ["top", "below"], "left_anti")
            .distinct()
        )
        if not step.limit(1).count():
            break
        closure = closure.union(step)
    inside = shares.join(closure.select(F.col("top").alias("dst"), F.col("below").alias("src")), ["src", "dst"])
    return inside.groupBy("dst").agg(round_even(F.sum("share"), 2).alias("fanin"))
