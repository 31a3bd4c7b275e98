"""Balanced label propagation: documents into equal shards, linked documents together (DataFrame functions only).

Documents with equal texts are linked.  Each group of copies is handled as *atoms*: the rows of one text that fall into
one of the salts, 64 or as many as keep an atom of any group under ``ATOM_ROWS`` rows or so, so that no group, however
large, meets in one task.  Labels (shards) start at random.  In each round an atom looks at where its group's rows are,
and moves towards the shard with most of them if that cuts fewer links; moves are accepted per shard in order of gain, as
far as the shard's quota of rows goes.  Rounds alternate between moves to lower and to higher shards, so that two atoms
never swap for ever, and end when two in a row did not lower the number of cut links, which falls at all others.

Documents without a link cost nothing wherever they stand: they fill every shard to its exact quota.  Law ``rows``: row
counts of two shards differ by one at most.  Slots number a shard's rows from 0, by prefix sums over hash buckets.

Defined results: a null text has size 1, CRC 0 and no links; an empty text is a text like any other; rows that repeat a
doc_id are rows of their own (as their texts are equal, they are linked); an empty table gives an empty result; further
columns are ignored by :func:`assign` and kept by :func:`sharded_documents`, whose shard and slot replace columns of
these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import crc32_of, forget, join_counted, read_table, written

SALTS = 64
ATOM_ROWS = 50_000
#: Steps of the acceptance order inside one level of gain.
STEPS = 64
#: Rows that one bucket of the numbering holds on average.
BUCKET_ROWS = 2_000


def digests(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, size, text_crc32, key (of the text; null without one), and a row number."""
    text = F.col("text")
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        crc32_of(text).cast("long").alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"),
        *carry,
    )


def linked_atoms(rows: DataFrame, shards: int) -> DataFrame:
    """(key, salt, n, shard) of the texts that two rows or more have, with a random first shard."""
    atoms = rows.where(F.col("key").isNotNull()).groupBy("key", "salt").agg(F.count("*").alias("n"))
    groups = atoms.groupBy("key").agg(F.sum("n").alias("rows")).where("rows > 1").select("key")
    return atoms.join(groups, "key").withColumn("shard", F.pmod(F.xxhash64("key", "salt"), F.lit(shards)).cast("int"))


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def cut_links(atoms: DataFrame) -> int:
    """Pairs of linked rows in different shards.  ``atoms``: key, shard, n."""
    shares = atoms.groupBy("key", "shard").agg(F.sum("n").cast("decimal(38,0)").alias("w"))
    whole = shares.groupBy("key").agg(F.sum("w").alias("rows"), F.sum(F.col("w") * F.col("w")).alias("squares"))
    twice = whole.agg(F.sum(F.col("rows") * F.col("rows") - F.col("squares"))).first()[0]
    return int(twice or 0) // 2


def propagate(atoms: DataFrame, quota: list[int]) -> DataFrame:
    """Rounds of balanced label propagation over atoms.  The driver sees one row per shard, and the number of cut links."""
    shards, rows = len(quota), sum(quota)
    atoms = written(atoms, "labels", rows=rows)
    quiet, turn, cut = 0, -1, cut_links(atoms)
    while quiet < 2 and cut:
        turn += 1
        load = {r["shard"]: r["n"] for r in atoms.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        free = F.array(*[F.lit(max(0, quota[s] - load.get(s, 0))) for s in range(shards)])
        where = atoms.groupBy("key", "shard").agg(F.sum("n").alias("w"))
        # neighbours' shards: at most one row for each shard and group
        near = where.select("key", F.col("shard").alias("to"), F.col("w").alias("w_to"))
        side = F.col("to") < F.col("shard") if turn % 2 == 0 else F.col("to") > F.col("shard")
        wish = (
            atoms.join(where, ["key", "shard"])
            .join(near, "key")
            .where(side)
            .withColumn("gain", F.col("w_to") - (F.col("w") - F.col("n")))
            .where("gain > 0")
            .groupBy("key", "salt", "shard", "n")
            .agg(F.max(F.struct("gain", F.xxhash64("key", "to").alias("tie"), "to")).alias("best"))
            .select("key", "salt", "n", "best.to", "best.gain")
        )
        level = F.lit(63) - F.least(F.floor(F.log2(F.col("gain").cast("double"))), F.lit(63))
        step = (level * STEPS + F.pmod(F.xxhash64("key", "salt", F.lit(turn)), F.lit(STEPS))).cast("int")
        wish = written(wish.withColumn("step", step), "wishes", rows=rows)
        # rows wished for by shard and step: few rows, whatever the number of atoms
        line = Window.partitionBy("to").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        steps = wish.groupBy("to", "step").agg(F.sum("n").alias("m")).withColumn("upto", F.sum("m").over(line))
        open_steps = steps.where(F.col("upto") <= F.element_at(free, F.col("to") + 1)).select("to", "step")
        # at most shards * 64 levels * STEPS rows
        moved = wish.join(F.broadcast(open_steps), ["to", "step"]).select("key", "salt", "to")
        new = written(
            atoms.join(moved, ["key", "salt"], "left").select("key", "salt", "n", F.coalesce("to", "shard").alias("shard")),
            "labels",
            rows=rows,
        )
        now = cut_links(new)
        quiet = 0 if now < cut else quiet + 1
        cut = now
        forget(atoms)
        forget(wish)
        atoms = new
    return atoms


def numbered(df: DataFrame, by: list[str], order: list, shards: int, buckets: int, name: str) -> DataFrame:
    """``df`` with ``place``: its rows' number from 0 within ``by``, by prefix sums over hash buckets of ``bucket``."""
    df = df.withColumn("__b", F.pmod(F.col("bucket"), F.lit(buckets)))
    counts = df.groupBy(*by, "__b").agg(F.count("*").alias("c"))
    line = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = written(counts.withColumn("__start", F.sum("c").over(line) - F.col("c")).drop("c"), name, rows=shards * buckets)
    inside = Window.partitionBy(*by, "__b").orderBy(*order)
    out = df.join(starts, [*by, "__b"]).withColumn("place", F.col("__start") + F.row_number().over(inside) - 1)
    return out.drop("__b", "__start", "bucket")


def assign(docs: DataFrame, shards: int = 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, key, law, shard, slot, and the ``carry`` columns."""
    rows = written(digests(docs, *carry), "digests")
    total = rows.count()
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(max(SALTS, total // ATOM_ROWS))).cast("int"))
    quota = quotas(total, shards)
    buckets = max(8, -(-total // (shards * BUCKET_ROWS)))
    atoms = propagate(linked_atoms(rows, shards), quota)
    labelled = rows.join(atoms.select("key", "salt", "shard"), ["key", "salt"], "left")
    linked = labelled.where("shard is not null").withColumn("bucket", F.xxhash64("key", "salt"))
    # a shard that its first, random labels overfilled gives up what stands beyond its quota
    linked = numbered(linked, ["shard"], ["key", "row"], shards, buckets, "linked-starts")
    fits = F.col("place") < F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("shard") + 1)
    placed = written(
        linked.select(*[c for c in linked.columns if c not in ("place", "shard")], F.when(fits, F.col("shard")).alias("shard")).unionByName(
            labelled.where("shard is null")
        ),
        "placed",
        rows=total,
    )
    have = {r["shard"]: r["n"] for r in placed.where("shard is not null").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    ends, upto = [], 0
    for s in range(shards):
        upto += quota[s] - have.get(s, 0)
        ends.append(upto)
    rest = placed.where("shard is null").drop("shard").withColumn("bucket", F.xxhash64("row", F.lit(1))).withColumn("all", F.lit(0))
    rest = numbered(rest, ["all"], ["row"], 1, buckets * shards, "rest-starts").drop("all")
    fill = F.aggregate(F.array(*[F.lit(e) for e in ends]), F.lit(0), lambda acc, e: acc + F.when(F.col("place") >= e, 1).otherwise(0))
    rest = rest.withColumn("shard", fill.cast("int")).drop("place")
    both = placed.where("shard is not null").unionByName(rest).withColumn("bucket", F.xxhash64("row", F.lit(2)))
    out = numbered(both, ["shard"], ["row"], shards, buckets, "slot-starts")
    return out.select(
        "doc_id", "size", "text_crc32", "key", F.lit("rows").alias("law"), "shard", F.col("place").cast("long").alias("slot"), *carry
    )


def sharded_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``.  Texts stay behind while rows are dealt, and come back by their digest, each
    distinct text once from a task; the rows of a text that many share are salted."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("__")).alias("__rest"))
    dealt = written(assign(packed, shards, carry=("__rest",)), "dealt")
    texts = (
        docs.where("text is not null")
        .groupBy(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"))
        .agg(F.first("text").alias("text"), F.count("*").alias("m"))
    )
    keyed = dealt.where("key is not null")
    out = join_counted(keyed, written(texts, "texts"), ["key"], "m", keyed.count())
    out = out.drop("m").unionByName(dealt.where("key is null").withColumn("text", F.lit(None).cast("string")))
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    return out.select(*[c if c in ("doc_id", "text") else F.col("__rest")[c].alias(c) for c in columns], "shard", "slot")


def op6_sharding(spark, sf_dir):
    out = assign(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
