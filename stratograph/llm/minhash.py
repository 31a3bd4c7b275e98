"""Near duplicates by bottom-k sketches of one hash function.

1. One pass over the texts makes, for every document, the set of its hashed 5-word shingles, a digest of the whole set,
   and the sketch: the ``K`` smallest hashes.  Documents with equal sets are one class, named by its smallest doc_id.
2. Inverted lists: the sketch values of all classes are counted, and each class keeps its rarest ones.  Two sketches
   that share at least m of K values must share one of the K - m + 1 that are rarest in any common order, so values that
   thousands of documents share are left to the documents that consist of little else.  m is exact for small sets (whole
   sets are sketched) and, for sampled ones, so low that a pair at the threshold misses it with a chance under 1e-8.
3. Classes that overlap with another there go on with their full sets: lists of each set's rarest shingles, by the same
   rule and exact.  Candidates come from a list by leaders, those with the fewest shingles of their own first: every
   class of the list meets a few leaders, never all the others.  A pair inside one component needs no look, nor one
   beyond what the shingles of a class's own let it share.  Leaders leave their lists, and rounds with more leaders go
   on until no list can join two components, so every pair that could link two components has been looked at.
4. The union sketch estimates each candidate's similarity; the rest is verified on the full sets.
5. Links join classes into components by alternating star contractions, in Spark.

Lists that many classes share are salted wherever their entries meet.

Defined results: texts with fewer than five words have one shingle, the whole sequence; null, empty and blank texts have
none, are linked with nothing and kept; rows that repeat a doc_id are judged by their texts; ids may be numbers or
strings, the smallest in their own order; a row without a doc_id links nothing, has no component and is not ``kept``, but
passes :func:`deduplicated`, as nothing stands for it; an empty table gives an empty result; further columns are ignored
by :func:`near_duplicates` and kept by :func:`deduplicated`.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _arrays as A
from ._spark import forget, join_counted, keep_ids, read_table, small_batches, written

WORDS = 5
K = 64
#: Least shared values of two sampled sketches; at a similarity of 0.85 the mean is 54.4 and the deviation 2.9.
LEAST_SHARED = 36
SIMILARITY = 85
#: Candidates are estimated on longer sketches, cut from the full sets: of 256 values a pair at 0.85 shares 217.6 on
#: average, with a deviation of 5.7; smaller unions are seen whole.
ESTIMATE_K = 256
ESTIMATE_LEAST = 183
#: Leaders of each list, round after round.
LEADERS = (1, 8, 64, 512)
#: A class with more open lists does not name them, and meets a partner in each common one.
MAX_NAMED = 64
GROUP_BYTES = 2 << 20


def shingle_sets(column: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts as int64, number of each text)."""
    words = A.Words(*A.texts_of(column), A.SPACE_WORDS)
    first = words.first
    grams = A.windows(words.hashes, size).view(np.int64)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            own = np.sort(grams[a : b - size + 1])
            fresh = np.empty(len(own), dtype=bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            sets.append(own[fresh])
        elif b > a:
            sets.append(A.mixed(A.windows(words.hashes[a:b], b - a) ^ A.U(b - a)).view(np.int64))
        else:
            sets.append(np.zeros(0, dtype=np.int64))
    return np.concatenate([np.zeros(0, dtype=np.int64), *sets]), np.array([len(s) for s in sets], dtype=np.int64)


def _sketches(batches):
    for part in A.grouped(batches, "text", GROUP_BYTES):
        values, counts = shingle_sets(part.column("text"))
        ends = np.cumsum(counts)
        some = counts > 0
        sums = []
        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            total = np.zeros(len(counts), dtype=np.uint64)
            if some.any():
                total[some] = np.add.reduceat(A.mixed(values.view(np.uint64) ^ A.U(salt)), (ends - counts)[some])
            sums.append(total.view(np.int64))
        kept = np.minimum(counts, K)
        inside = np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
        sketch = A.lists(pa.array(values[np.repeat(ends - counts, kept) + inside]), kept)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").combine_chunks(), pa.array(counts), pa.array(sums[0]), pa.array(sums[1]), sketch],
            names=["doc_id", "n_shingles", "set_a", "set_b", "sketch"],
        )


def _sets(batches):
    for part in A.grouped(batches, "text", GROUP_BYTES):
        values, counts = shingle_sets(part.column("text"))
        yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), A.lists(pa.array(values), counts)], names=["c", "shingles"])


def components(links: DataFrame, nodes: int | None = None) -> DataFrame:
    """(c, comp) for every end of a link (a, b): the smallest id that it reaches.  Alternating large and small stars."""
    ends = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(links, "stars", rows=nodes and 4 * nodes)
    seen = None
    while True:
        both = ends(edges)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # after a large star every a > b; hang a's smaller neighbours, and a itself, on the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.where("a <> b").distinct(), "stars", rows=nodes and 4 * nodes)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    tops = edges.select(F.col("b").alias("c")).distinct()
    return edges.select(F.col("a").alias("c"), F.col("b").alias("comp")).union(tops.select("c", F.col("c").alias("comp")))


def needed(n):
    """Least number of values that the sketches of a linked pair share, for a set of ``n``."""
    return F.least(F.ceil(n * SIMILARITY / 100), F.lit(LEAST_SHARED))


def with_frequency(values: DataFrame) -> DataFrame:
    """``values`` with ``df``, the number of rows of their ``v``, where that is over 1."""
    shared = written(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    return join_counted(values, shared, ["v"], "df", shared.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0])


def inverted_lists(classes: DataFrame) -> DataFrame:
    """(v, c, n): the rarest sketch values of each class, as far as another class has them too."""
    values = classes.select("c", F.col("n_shingles").alias("n"), F.explode("sketch").alias("v"))
    entries = with_frequency(values)
    # values of its own come first in a class's order; a class has K values at most
    kept = F.least(F.col("n"), F.lit(K))
    ranked = entries.groupBy("c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    own = kept - F.size("vs")
    prefix = F.greatest(kept - needed(F.col("n")) + 1 - own, F.lit(0)).cast("int")
    return ranked.select("c", "n", F.explode(F.slice("vs", F.lit(1), prefix)).alias("e")).select("e.v", "c", "n")


def may_link(common, n, m):
    """Whether sets of ``n`` and ``m`` with at most ``common`` shared values can be similar enough."""
    return 100 * common >= SIMILARITY * (n + m - common)


def rarest_shingles(sets: DataFrame) -> DataFrame:
    """(v, c, n, o): lists of the rarest shingles of the full sets that the sketches' lists left.

    A class of ``n`` shingles shares 85 % of them at least with a partner, so two linked classes share one of the
    15 % + 1 that are rarest in any common order.  This is exact, and where thousands of edited copies share most of
    their sketches it parts those with different edits.  ``o`` of the ``n`` shingles occur in another class too: no
    partner shares more.
    """
    rows = sets.select("c", F.size("shingles").alias("n"), F.explode("shingles").alias("v"))
    own = Window.partitionBy("c")
    ranked = with_frequency(rows).withColumns({"rn": F.row_number().over(own.orderBy("df", "v")), "o": F.count("*").over(own)})
    least = F.ceil(F.col("n") * SIMILARITY / 100)
    kept = ranked.where((F.col("n") - F.col("o") + F.col("rn") <= F.col("n") - least + 1) & may_link(F.col("o"), F.col("n"), F.col("o")))
    return kept.select("v", "c", "n", "o")


def estimated(a, b):
    """Of the smallest values of both sketches' union, how many both have, and how many there are."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, ESTIMATE_K)
    return F.size(F.array_intersect(F.array_intersect(union, a), b)), F.size(union)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose union sketch lets them pass and whose full sets (sorted) are similar."""
    sketches = sets.select("c", F.slice("shingles", 1, ESTIMATE_K).alias("sketch"))
    both, every = F.col("both"), F.col("every")
    near = (
        pairs.join(sketches.select(F.col("c").alias("a"), F.col("sketch").alias("sa")), "a")
        .join(sketches.select(F.col("c").alias("b"), F.col("sketch").alias("sb")), "b")
        .select("a", "b", *[x.alias(k) for x, k in zip(estimated(F.col("sa"), F.col("sb")), ("both", "every"))])
        .where((every < ESTIMATE_K) & (100 * both >= SIMILARITY * every) | (every == ESTIMATE_K) & (both >= ESTIMATE_LEAST))
        .select("a", "b")
    )
    full = near.join(sets.select(F.col("c").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("c").alias("b"), F.col("shingles").alias("sb")), "b"
    )
    common = F.size(F.array_intersect("sa", "sb"))
    return full.where(100 * common >= SIMILARITY * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = written(docs.mapInArrow(_sketches, f"doc_id {kind}, n_shingles long, set_a long, set_b long, sketch array<long>"), "sketches")
    classes = (
        made.where("n_shingles > 0 and doc_id is not null")
        .groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min("doc_id").alias("c"))
    )
    classes = written(classes, "classes")
    heads = made.select("doc_id", "set_a", "set_b", "n_shingles", "sketch").join(
        classes.withColumnRenamed("c", "doc_id"), ["doc_id", "set_a", "set_b", "n_shingles"], "left_semi"
    )
    heads = heads.select(F.col("doc_id").alias("c"), "n_shingles", "sketch")
    entries = written(inverted_lists(heads), "lists")
    ids = written(entries.select("c").distinct(), "candidates")
    sets = written(keep_ids(docs, ids, "doc_id").mapInArrow(_sets, f"c {kind}, shingles array<long>"), "shingle-sets")
    entries = written(rarest_shingles(sets), "rare-lists")
    many, nodes = entries.count(), ids.count()
    known, looked, done = None, None, []
    for turn in itertools.count():  # leaders leave their lists, so the lists run out
        leaders = LEADERS[min(turn, len(LEADERS) - 1)]
        line = entries if known is None else entries.join(known, "c", "left")
        line = line.withColumn("comp", F.col("c") if known is None else F.coalesce("comp", "c"))
        spread = line.groupBy("v").agg(
            F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least_n"), F.count("*").alias("m")
        )
        spread = written(spread.where("low < high").select("v", "least_n", "m"), "list-spreads")
        line = join_counted(line, spread, ["v"], "m", many).where(may_link(F.col("o"), F.col("n"), F.greatest("least_n", "o")))
        line = line.drop("least_n")
        # of the lists that two classes have in common, the first one makes their pair
        names = line.groupBy("c").agg(F.collect_list("v").alias("vs")).where(F.size("vs") <= MAX_NAMED)
        line = written(line.join(names, "c", "left"), "open-lists", rows=many)
        for old in done:
            forget(old)
        if not line.limit(1).count():
            break
        # the class with the least of its own leads: of many edited copies, the original
        chosen = (
            line.groupBy("v", F.pmod(F.xxhash64("c", F.lit(turn)), F.lit(leaders)).alias("g"))
            .agg(F.min(F.struct((F.col("n") - F.col("o")).alias("own"), "c", "n", "o", "comp", "vs")).alias("lead"), F.max("m").alias("m"))
            .select("v", "m", *[F.col(f"lead.{k}").alias(f"l{k}") for k in ("c", "n", "o", "comp", "vs")])
        )
        chosen = written(chosen, "leaders", rows=many)
        met = (
            join_counted(line.drop("m"), chosen, ["v"], "m", many)
            .where("c <> lc and comp <> lcomp")
            .where(may_link(F.least("o", "lo"), F.col("n"), F.col("ln")))
            .where(F.coalesce(F.array_min(F.array_intersect("vs", "lvs")) == F.col("v"), F.lit(True)))
            .select(F.least("c", "lc").alias("a"), F.greatest("c", "lc").alias("b"))
            .distinct()
        )
        if looked is not None:
            met = met.join(looked, ["a", "b"], "left_anti")
        met = written(met, "pairs")
        looked = met if looked is None else looked.union(met)
        links = written(verified(met, sets), "links", rows=many)
        if links.limit(1).count():
            if known is not None:
                links = links.union(known.select(F.col("c").alias("a"), F.col("comp").alias("b")))
            known = written(components(links, nodes), "components", rows=nodes)
        gone = chosen.select("v", F.col("lc").alias("c"))
        entries = line.drop("comp", "vs", "m").join(gone, ["v", "c"], "left_anti")
        done = [line, chosen, spread]
    parts = classes if known is None else classes.join(known, "c", "left")
    parts = parts.withColumn("comp", F.col("c") if known is None else F.coalesce("comp", "c")).drop("c")
    out = made.drop("sketch").join(parts, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id; of rows that repeat a kept doc_id, all stay, and so
    do rows without one."""
    verdict = written(near_duplicates(docs), "verdicts")
    kept = verdict.where("kept").select("doc_id").distinct()
    dropped = verdict.where("not kept").select("doc_id").distinct().join(kept, "doc_id", "left_anti")
    out = keep_ids(docs, written(dropped, "dropped"), "doc_id", "left_anti")
    return out.select(*docs.columns)


#: The same rows in DuckDB SQL.
ORACLE_SQL = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), sh as (
  select distinct doc_id, array_to_string(list_slice(ws, i, i + least(5, len(ws)) - 1), ' ') as s
  from d, lateral (select unnest(range(1, len(ws) - least(5, len(ws)) + 2)) as i) where len(ws) > 0
), n as (select doc_id, count(*) as n from sh group by doc_id
), common as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all
), links as (
  select x, y from common join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)
), ends as (select x, y from links union all select y, x from links
), reach as (
  select doc_id as x, doc_id as y from n
  union
  select r.x, e.y from reach r join ends e on r.y = e.x
), comp as (select x, min(y) as component_id from reach group by x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(component_id, d.doc_id) as component_id,
  coalesce(component_id, d.doc_id) = d.doc_id as kept
from d left join n on n.doc_id = d.doc_id left join comp on comp.x = d.doc_id
"""


def op9_minhash(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
