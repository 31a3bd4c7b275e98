"""Cross-document line frequency as a quality rule (DataFrame functions only).

Lines are normalised (lower case, white space collapsed) and hashed; for every host the distinct documents that
contain a line are counted, lines above the limit are removed, and a document that loses most of its words, or is
left with almost none, is rejected.  Documents count as distinct by their whole text, so that exact copies of one
page do not turn its own lines into boilerplate.  :func:`line_frequency_rules` gives the verdicts,
:func:`cleaned_documents` the documents that pass, without the lines above the limit.

Base rules run beside it: number of words and words inside repeated 5-word windows.

Defined results: a null or empty text has no words and no lines (all counts 0, ``base_failed`` true);  a null host
is a host of its own; rows that repeat a doc_id are judged one by one; further columns of the input are ignored by the
verdicts and kept by the cleaned documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import SPACE, WORD, join_counted, let, written

#: Limits of the method.
MIN_LIMIT_DOCS = 10
LIMIT_SHARE = 0.02
MAX_REMOVED_SHARE = 0.5
MIN_WORDS_LEFT = 10
#: Up to so many over-limit lines (hash and host: under 64 bytes each) are broadcast; beyond, the join shuffles, with
#: lines that many documents share salted.
MAX_BROADCAST_LINES = 200_000
#: Up to so many documents that lose lines are broadcast (row and words: 16 bytes each).
MAX_BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_window_words(hashes: Column, size: int = 5) -> Column:
    """How many words stand inside windows of ``size`` words that occur at least twice; linearithmic in the text.

    ``hashes``: array<long> of the windows' hashes, in text order.
    """

    def covered(h: Column) -> Column:
        # (hash, place) sorted: equal windows become neighbours
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        blank = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("i")))

        def marked(s: Column) -> Column:
            before = F.concat(blank, F.slice(s, 1, F.size(s) - 1))
            after = F.concat(F.slice(s, 2, F.size(s)), blank)
            sides = F.arrays_zip(s.alias("s"), before.alias("b"), after.alias("a"))
            twice = F.filter(sides, lambda z: (z["s"]["h"] == z["b"]["h"]) | (z["s"]["h"] == z["a"]["h"]))
            return F.array_sort(F.transform(twice, lambda z: z["s"]["i"]))

        def union_length(places: Column) -> Column:
            following = F.concat(F.slice(places, 2, F.size(places)), F.array(F.lit(2**31 - 1)))
            return F.aggregate(
                F.zip_with(places, following, lambda p, q: F.least(q - p, F.lit(size))),
                F.lit(0).cast("long"),
                lambda acc, x: acc + x,
            )

        return let(let(order, marked), union_length)

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(hashes, covered))


def window_hashes(words: Column) -> Column:
    """Hashes of all windows of five words (none for a shorter text), by pairing shifted copies of the word hashes."""

    def windows(h: Column) -> Column:
        pairs = F.zip_with(h, F.slice(h, 2, F.size(h)), lambda a, b: F.xxhash64(a, b))
        fours = let(pairs, lambda p: F.zip_with(p, F.slice(p, 3, F.size(p)), lambda a, b: F.xxhash64(a, b)))
        fives = let(fours, lambda f: F.zip_with(f, F.slice(h, 5, F.size(h)), lambda a, b: F.xxhash64(a, b)))
        return F.slice(fives, 1, F.greatest(F.size(h) - 4, F.lit(0)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def base_counts(docs: DataFrame, *carry: str) -> DataFrame:
    """One row per document: the base counts, ``lines`` (hash and number of words of each line with a word), ``carry``.

    The one-element explodes are barriers: without them the optimiser copies the split into each of its uses.
    """
    rows = docs.select("doc_id", F.col("source").alias("host"), F.coalesce("text", F.lit("")).alias("text"), *carry)
    rows = rows.select("*", F.explode(F.array(words_of(F.col("text")))).alias("words"))
    rows = rows.select("*", F.explode(F.array(window_hashes(F.col("words")))).alias("windows"))
    with_word = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("*", F.explode(F.array(with_word)).alias("raw_lines"))
    return rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.length(F.regexp_replace("text", WORD, ""))).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("raw_lines") - F.size(F.array_distinct("raw_lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("windows")).alias("n_repeat_words"),
        F.transform("raw_lines", lambda x: let(words_of(F.lower(x)), lambda w: F.struct(line_hash(w).alias("line"), F.size(w).alias("words")))).alias("lines"),
        *carry,
    )


def line_hash(words: Column) -> Column:
    return F.xxhash64(F.array_join(words, " "))


def boilerplate_lines(base: DataFrame, min_docs: int = MIN_LIMIT_DOCS, share: float = LIMIT_SHARE) -> DataFrame:
    """(host, line, line_docs, line_rows) of lines in more distinct documents of their host than
    ``max(min_docs, share * documents of the host)``; ``line_rows``: how often they stand there, copies included."""
    totals = base.groupBy("host").agg(F.count_distinct("text_hash").alias("host_docs"))
    counts = (
        base.select("host", "text_hash", F.explode("lines.line").alias("line"))
        .groupBy("host", "line")
        .agg(F.count_distinct("text_hash").alias("line_docs"), F.count("*").alias("line_rows"))
        .where(F.col("line_docs") > min_docs)
    )
    # few lines pass the first limit, so the totals meet a small table
    totals = totals.withColumnRenamed("host", "of_host")
    return (
        counts.join(totals, F.col("host").eqNullSafe(F.col("of_host")))
        .where(F.col("line_docs") > F.lit(share) * F.col("host_docs"))
        .select("host", "line", "line_docs", "line_rows")
    )


def over_limit(base: DataFrame, min_docs: int, share: float, broadcast_lines: int) -> DataFrame:
    """(row, line, words) of every line of ``base`` that is above its host's limit."""
    host = [F.coalesce("host", F.lit("")).alias("host_key"), F.col("host").isNull().alias("no_host")]
    over = written(boilerplate_lines(base, min_docs, share).select(*host, "line", "line_rows"), "over-limit")
    lines = base.select("row", *host, F.explode("lines").alias("l")).select("row", "host_key", "no_host", "l.line", "l.words")
    keys = ["host_key", "no_host", "line"]
    if over.count() <= broadcast_lines:
        found = lines.join(F.broadcast(over), keys)
    else:
        found = join_counted(lines, over, keys, "line_rows", over.agg(F.sum("line_rows")).first()[0])
    return found.select("row", "line", "words")


def with_removed(base: DataFrame, removed: DataFrame) -> DataFrame:
    """``base`` with its rows of ``removed`` (by row, null where it has none)."""
    removed = written(removed, "removed")
    return base.join(F.broadcast(removed) if removed.count() <= MAX_BROADCAST_ROWS else removed, "row", "left")


def verdict(max_removed: float, min_left: int) -> tuple[Column, Column, Column]:
    """(removed words, base_failed, kept)."""
    removed_words = F.coalesce("removed_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (removed_words > max_removed * F.col("n_words")) | (
        (removed_words > 0) & (F.col("n_words") - removed_words < min_left)
    )
    return removed_words, failed, ~failed & ~depleted


def line_frequency_rules(
    docs: DataFrame,
    min_docs: int = MIN_LIMIT_DOCS,
    share: float = LIMIT_SHARE,
    max_removed: float = MAX_REMOVED_SHARE,
    min_left: int = MIN_WORDS_LEFT,
    broadcast_lines: int = MAX_BROADCAST_LINES,
) -> DataFrame:
    """Every document with its base counts, the words removed with over-limit lines, and the verdict.

    ``kept`` is false where a base rule fails or where over-limit lines hold more than ``max_removed`` of the words,
    or leave fewer than ``min_left``.
    """
    base = written(base_counts(docs), "line-hashes")
    lost = over_limit(base, min_docs, share, broadcast_lines).groupBy("row").agg(F.sum("words").alias("removed_words"))
    removed_words, failed, kept = verdict(max_removed, min_left)
    return with_removed(base.drop("lines"), lost).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), kept.alias("kept"), removed_words.alias("removed_words"),
    )


def cleaned_documents(
    docs: DataFrame,
    min_docs: int = MIN_LIMIT_DOCS,
    share: float = LIMIT_SHARE,
    max_removed: float = MAX_REMOVED_SHARE,
    min_left: int = MIN_WORDS_LEFT,
    broadcast_lines: int = MAX_BROADCAST_LINES,
) -> DataFrame:
    """The documents that are kept, their texts without the lines above the limit; all columns stay."""
    packed = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("__all"))
    base = written(base_counts(packed, "__all"), "line-hashes")
    lost = over_limit(base, min_docs, share, broadcast_lines)
    lost = lost.groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("drop"))
    out = with_removed(base, lost).where(verdict(max_removed, min_left)[2])
    left = F.filter(F.split(F.col("__all.text"), "\n"), lambda x: ~F.array_contains(F.col("drop"), line_hash(words_of(F.lower(x)))))
    text = F.when(F.col("drop").isNull(), F.col("__all.text")).otherwise(F.array_join(left, "\n"))
    return out.select(*[text.alias("text") if c == "text" else F.col("__all")[c].alias(c) for c in docs.columns])


#: The same rows in DuckDB SQL.
ORACLE_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, source as host, coalesce(text, '') as text from documents
), w as (
  select r, doc_id, host, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from d
), g as (
  select r, i, list_slice(ws, i, i + 4) as win from w, lateral (select unnest(range(1, len(ws) - 3)) as i)
), rep as (
  select r, count(distinct p) as n_repeat_words
  from (select r, i, count(*) over (partition by r, win) as c from g) q, lateral (select unnest(range(q.i, q.i + 5)) as p)
  where c > 1 group by r
), l as (
  select r, host, text, list_filter(regexp_split_to_array(lower(u), '[\x20\x09-\x0D]+'), lambda x: x <> '') as lw
  from (select r, host, text, unnest(ls) as u from w)
), lines as (select r, host, text, array_to_string(lw, ' ') as line, len(lw) as words from l
), totals as (select host, count(distinct text) as host_docs from w group by host
), lim as (
  select c.host, c.line from (select host, line, count(distinct text) as n from lines group by host, line) c
  join totals t on c.host is not distinct from t.host where n > 10 and n > 0.02 * host_docs
), rem as (
  select r, sum(words) as removed_words from lines join lim on lines.host is not distinct from lim.host and lines.line = lim.line
  group by r
), f as (
  select w.doc_id, len(ws)::bigint as n_words,
    (length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]+', '', 'g')))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    coalesce(removed_words, 0)::bigint as removed_words
  from w left join rep using (r) left join rem using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words
    or removed_words > 0.5 * n_words or (removed_words > 0 and n_words - removed_words < 10)) as kept,
  removed_words
from f
"""


def op1_line_frequency(spark, sf_dir):
    from ._spark import read_table

    return line_frequency_rules(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
