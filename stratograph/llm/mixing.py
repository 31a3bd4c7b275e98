"""Mixing sources to target weights.

Every document gets a hash-random key.  Within its source the keys are cut into ranges (a range sort by the leading
digits), words are summed by range, prefix sums over the ranges find the range that holds the source's exact budget,
and prefix sums inside that one range find the document where the budget ends.  What is left is one row per source
(whole epochs, cut document, words of the cut document), so that taking the mix is a map over the documents: no text
is shuffled, and a source with a third of all rows is only ever summed by range.

Defined results: null texts have size 0 and are taken with 0 words; a null source is a source of its own, last in
order; equal keys are ordered by doc_id and size, and equal rows at the cut give equal shares of the words left, rounded
down; sources without words have target 0; an empty table gives an empty result; further columns pass through
:func:`mixed_documents`, and :func:`mix` unless they are named like one of its results, which replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import WORD, ranked, read_table, written

#: Weights by the source's place in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix takes so many times all words, and no source is taken more than so often.
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2.0
#: Hex digits of the key that name a range: 4096 ranges for each source.
RANGE_DIGITS = 3
#: A plan of up to so many sources is broadcast; beyond, it is joined by a shuffle.
MAX_BROADCAST_SOURCES = 50_000


def mix_key(doc_id: Column, seed: int = 7) -> Column:
    """32 hex digits, the same in every engine that has MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) for one row per source.

    Capped sources keep ``max_epochs`` times their size; the others share the rest by weight, until none is above.
    Only sums come to the driver.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    listed = written(ranked(sizes, F.col("source").asc_nulls_last(), name="ranked-sources").withColumn("weight", weight), "sources")
    cap = F.col("source_size") * max_epochs
    budget = (listed.agg(F.sum("source_size")).first()[0] or 0) * total_share
    rate = 0.0
    while True:  # every round caps a source more, or ends
        capped = cap <= F.col("weight") * rate
        held, free = listed.agg(F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("weight")))).first()
        new = (budget - (held or 0.0)) / free if free else rate
        if new <= rate:
            break
        rate = new
    return listed.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(rate)).alias("target"))


def mixing_plan(rows: DataFrame, **how) -> DataFrame:
    """One row per source: source_size, target, epochs, cut_key, cut_id, cut_size, cut_words.  ``rows``: source, doc_id, key, size."""
    ranges = rows.groupBy("source", F.substring("key", 1, RANGE_DIGITS).alias("part")).agg(F.sum("size").alias("part_size"))
    ranges = written(ranges, "ranges")
    goal = targets(ranges.groupBy("source").agg(F.sum("part_size").alias("source_size")), **how)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = written(
        goal.withColumn("epochs", whole).withColumn("rest", F.rint(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")),
        "goals",
    )
    named = goal.withColumnRenamed("source", "of")
    up_to = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        ranges.withColumn("upto", F.sum("part_size").over(up_to))
        .join(named.select("of", "rest"), F.col("source").eqNullSafe(F.col("of")))
        .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("part_size") <= F.col("rest")))
        .select(F.col("source").alias("of"), F.col("part").alias("cut_part"), (F.col("upto") - F.col("part_size")).alias("before"), "rest")
    )
    # only the documents of the range that holds the cut are sorted, equal rows as one
    place = ["key", "doc_id", "size"]
    inside = Window.partitionBy("source").orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("rest") - F.col("upto") + F.col("size") * F.col("m")
    end = (
        rows.join(few(cut, MAX_BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("of")) & (F.substring("key", 1, RANGE_DIGITS) == F.col("cut_part")))
        .groupBy("source", "before", "rest", *place)
        .agg(F.count("*").alias("m"))
        .withColumn("upto", F.col("before") + F.sum(F.col("size") * F.col("m")).over(inside))
        .where(F.col("upto") > F.col("rest"))
        .groupBy("source")
        .agg(F.min(F.struct(*place, F.floor(left / F.col("m")).alias("words"))).alias("at"))
        .select(F.col("source").alias("of"), "at")
    )
    return goal.join(end, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "source",
        "source_size",
        "target",
        "epochs",
        F.col("at.key").alias("cut_key"),
        F.col("at.doc_id").alias("cut_id"),
        F.col("at.size").alias("cut_size"),
        F.col("at.words").alias("cut_words"),
    )


def few(df: DataFrame, most: int) -> DataFrame:
    """``df`` for a broadcast, if it has at most ``most`` rows."""
    df = written(df, "few")
    return F.broadcast(df) if df.count() <= most else df


def mix(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """``docs`` with size, source_size, target, taken, epochs and cut_taken (words of the last, partial epoch).

    ``taken`` = epochs * size, plus the whole document before the cut, or its first words at the cut.
    """
    packed = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "source", "text")
    m = packed_mix(packed, seed, **how)
    return m.select(*[F.col("__row")[c].alias(c) for c in docs.columns if c not in MIXED], *MIXED)


MIXED = ["size", "source_size", "target", "taken", "epochs", "cut_taken"]


def packed_mix(packed: DataFrame, seed: int, **how) -> DataFrame:
    sized = packed.withColumn("size", text_size(F.col("text"))).withColumn("key", mix_key(F.col("doc_id"), seed))
    rows = written(sized.select("source", "doc_id", "key", "size"), "mix-rows")
    return apply_plan(sized, mixing_plan(rows, **how)).drop("key")


def apply_plan(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` (source, doc_id, key, size) with what the plan takes of each row."""
    plan = few(plan, MAX_BROADCAST_SOURCES)
    plan = plan.select(F.col("source").alias("__of"), *[F.col(c).alias(f"__{c}") for c in plan.columns if c != "source"])
    here = F.struct("key", "doc_id", "size")
    there = F.struct(F.col("__cut_key").alias("key"), F.col("__cut_id").alias("doc_id"), F.col("__cut_size").alias("size"))
    last = (
        F.when(F.col("__cut_key").isNull(), F.lit(0))
        .when(here < there, F.col("size"))
        .when(here == there, F.col("__cut_words"))
        .otherwise(F.lit(0))
        .cast("long")
    )
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("__of")))
    return joined.select(
        *sized.columns,
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__epochs") * F.col("size") + last).cast("long").alias("taken"),
        F.col("__epochs").alias("epochs"),
        last.alias("cut_taken"),
    )


def mixed_documents(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document stands there once for each epoch that takes it; the
    one at a source's cut stands there with the first words that the budget still takes (and its ``n_chars``)."""
    packed = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "source", "text")
    m = packed_mix(packed, seed, **how)
    copies = F.array_repeat(F.lit(-1), F.col("epochs").cast("int"))
    last = F.when(F.col("cut_taken") > 0, F.array(F.col("cut_taken").cast("int"))).otherwise(F.array().cast("array<int>"))
    m = m.withColumn("__copy", F.explode(F.concat(copies, last)))
    cut = (F.col("__copy") >= 0) & (F.col("__copy") < F.col("size"))
    # pieces that end with a word each
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    first = F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.col("__copy"), F.lit(1))), "")
    new = {"text": F.when(cut, first).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length(first).cast("long")).otherwise(F.col("__row.n_chars"))
    return m.select(*[new[c].alias(c) if c in new else F.col("__row")[c].alias(c) for c in docs.columns])


#: The same rows in DuckDB SQL; the loop caps sources one round after the other.
ORACLE_SQL = r"""
with recursive d as (
  select doc_id, source, md5('7:' || doc_id::varchar) as key,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents
), s as (
  select source, sum(size)::bigint as source_size,
    (case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3.0 when 1 then 1.0 else 2.0 end)::double as weight
  from d group by source
), b as (select sum(source_size) * 1.5::double as budget from s
), rates as (
  select 0 as i, 0.0::double as rate
  union all
  select i + 1, (select (budget - coalesce(sum(2.0 * source_size) filter (where 2.0 * source_size <= weight * r.rate), 0))
      / sum(weight) filter (where 2.0 * source_size > weight * r.rate) from s, b group by budget)
  from rates r where i < 40
), t as (
  select source, source_size, least(2.0 * source_size, weight * (select max(rate) from rates))::double as target from s
), g as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from t
), p as (
  select d.doc_id, d.size, g.source_size, g.target, g.epochs, round_even(g.target - g.epochs * g.source_size, 0) as rest,
    sum(d.size) over (partition by d.source order by d.key, d.doc_id rows between unbounded preceding and current row) - d.size as before
  from d join g on d.source is not distinct from g.source
)
select doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken
from p
"""


def op7_mixing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), mix_key(F.col("doc_id")).alias("key"))
    rows = written(sized.select("source", "doc_id", "key", "size"), "mix-rows")
    out = apply_plan(rows, mixing_plan(rows))
    return out.select("doc_id", "size", "source_size", "target", "taken")
