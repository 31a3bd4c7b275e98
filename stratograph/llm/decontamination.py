"""Benchmark decontamination with suffix arrays over the training text.

Each task cuts its part of the corpus into shards of a few MB.  A shard's words become numbers (0: a word that no test
item has, or the end of a document), and all suffixes that start with a test word are sorted by their first ``size``
words: the shard's suffix array.  Every suffix of the test items that has ``size`` words, and every shorter item, is
binary-searched in it, which gives the range of places where those words stand verbatim.  The words found are compared
byte by byte.  Where whole windows stand, the passages found and the items are ranked together to full depth (prefix
doubling); a passage's neighbours in that order give its longest match at every place, and each longest match that none
contains is reported with one item and place that has it.

A shard keeps one number for every occurrence of a window, one pair for every document and window, and a logarithm of
ranks for every word found, so repetitive texts cost no more than others.  Test items come in blocks of bounded size;
each block is broadcast and searched in a pass of its own over the documents, written before the next block is read.

Contamination: a document word inside an occurrence of a window is hit.  Windows are ``size`` consecutive item words,
or the whole item where it is shorter.  A document is contaminated if at least a twentieth of its words is hit.

Defined results: null or empty texts have no words and are clean; items without words are in no document; items that
repeat an id count once; an item without an id has the empty string as its id; an empty table on either side gives no
hits; of :func:`find_contamination`, input columns named like a result are replaced, all others kept;
:func:`decontaminated` keeps all columns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _arrays as A
from ._spark import read_table, small_batches, written

SIZE = 13
SHARD_BYTES = 4 << 20
BLOCK_WORDS = 200_000

MATCH = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("item_start", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("length", T.IntegerType()),
    ]
)
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("matches", T.ArrayType(MATCH)),
        T.StructField("contaminated", T.BooleanType()),
    ]
)


class Needles:
    """Windows and suffixes of one block of test items."""

    def __init__(self, items: list[tuple[str, str]], size: int = SIZE):
        self.size, self.ids = size, [i for i, _ in items]
        words = A.Words(*A.texts_of(pa.array([t for _, t in items], type=pa.string())), A.ALNUM_WORDS)
        self.hashes, at, numbers = np.unique(words.hashes, return_index=True, return_inverse=True)
        self.spelled = [b"", *(words.text(i) for i in at)]
        numbers = numbers + 1
        self.bits = max(1, int(len(self.hashes)).bit_length())
        self.per = 64 // self.bits
        counts = words.counts()
        #: The words of all items, a 0 after each; of each place its item and the words left.
        self.line = np.zeros(len(numbers) + len(items), dtype=np.int64)
        self.line[np.arange(len(numbers)) + words.owners()] = numbers
        self.item = np.repeat(np.arange(len(items)), counts + 1)
        begin = np.concatenate([[0], np.cumsum(counts + 1)]).astype(np.int64)
        self.place = np.arange(len(self.line)) - begin[self.item]
        self.left = counts[self.item] - self.place
        own = np.flatnonzero((self.left >= size) | ((self.place == 0) & (self.left > 0)))
        lengths = np.minimum(self.left[own], size)
        reach = np.arange(size)
        table = np.where(reach < lengths[:, None], self.line[np.minimum(own[:, None] + reach, max(0, len(self.line) - 1))], 0)
        self.windows, which = np.unique(table.reshape(-1, size), axis=0, return_inverse=True)
        self.lengths = (self.windows > 0).sum(axis=1)
        # the distinct items of each window
        pairs = np.unique(which.reshape(-1).astype(np.int64) * max(1, len(items)) + self.item[own])
        self.owner = pairs % max(1, len(items))
        self.owner_start = np.searchsorted(pairs // max(1, len(items)), np.arange(len(self.windows) + 1))
        high = np.where(reach[None, :] < self.lengths[:, None], self.windows, (1 << self.bits) - 1)
        self.low_keys = self.packed(lambda k: self.windows[:, k], len(high))
        self.high_keys = self.packed(lambda k: high[:, k], len(high))

    def packed(self, column, count: int) -> list[np.ndarray]:
        """``size`` columns of word numbers, asked for one by one, as few 64-bit keys with the same order."""
        keys = []
        for a in range(0, self.size, self.per):
            key = np.zeros(count, dtype=np.uint64)
            for q in range(self.per):
                key <<= np.uint64(self.bits)
                if a + q < self.size:
                    key |= column(a + q).astype(np.uint64)
            keys.append(key)
        return keys


def bound(keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """Where each wanted key stands in the sorted suffix array, all binary searches side by side."""
    low = np.zeros(len(wanted[0]), dtype=np.int64)
    high = np.full(len(wanted[0]), len(keys[0]), dtype=np.int64)
    while True:
        busy = np.flatnonzero(low < high)
        if not len(busy):
            return low
        mid = (low[busy] + high[busy]) >> 1
        before = np.full(len(busy), right)
        for key, want in zip(reversed(keys), reversed(wanted)):
            a, b = key[mid], want[busy]
            before = np.where(a == b, before, a < b)
        low[busy[before]] = mid[before] + 1
        high[busy[~before]] = mid[~before]


def numbered(words: A.Words, needles: Needles) -> np.ndarray:
    """The items' number of each word; 0 if no item has it."""
    if not len(needles.hashes):
        return np.zeros(len(words), dtype=np.int64)
    near = np.minimum(np.searchsorted(needles.hashes, words.hashes), len(needles.hashes) - 1)
    return np.where(needles.hashes[near] == words.hashes, near + 1, 0)


def search(words: A.Words, number: np.ndarray, needles: Needles) -> tuple[np.ndarray, np.ndarray]:
    """(window, first word) of every occurrence in a shard."""
    none = np.zeros(0, dtype=np.int64)
    if not len(words) or not len(needles.windows):
        return none, none
    # one 0 after every document, and enough at the end
    owners = words.owners()
    line = np.zeros(len(number) + len(words.first) + needles.size, dtype=np.uint32)
    line[np.arange(len(number)) + owners] = number
    suffixes = np.flatnonzero(number)
    at = suffixes + owners[suffixes]
    if not len(at):
        return none, none
    keys = needles.packed(lambda k: line[at + k], len(at))
    order = np.lexsort(keys[::-1])
    array, keys = suffixes[order], [k[order] for k in keys]
    low, high = bound(keys, needles.low_keys, False), bound(keys, needles.high_keys, True)
    count = np.maximum(high - low, 0)
    window = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
    word = array[np.repeat(low, count) + inside]
    # equal hashes are compared by their bytes
    length = needles.lengths[window]
    found = np.flatnonzero(covered(word, length, len(number)))
    wrong = np.zeros(len(number) + 1, dtype=np.int64)
    wrong[1:][found] = [words.text(p) != needles.spelled[n] for p, n in zip(found.tolist(), number[found].tolist())]
    if wrong.any():
        upto = np.cumsum(wrong)
        good = upto[word + length] == upto[word]
        window, word = window[good], word[good]
    return window, word


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Of ``n`` words, whether each is in one of the spans."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def suffix_ranks(line: np.ndarray, depth: int) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until ``depth`` or until more words tell none apart."""
    classes, rank = np.unique(line, return_inverse=True)
    levels, kinds, reach = [rank], len(classes), 1
    while reach < depth:
        after = np.zeros_like(rank)
        after[:-reach] = rank[reach:] + 1
        classes, rank = np.unique(rank * (kinds + 1) + after, return_inverse=True)
        if len(classes) == kinds:
            break
        levels.append(rank)
        kinds, reach = len(classes), 2 * reach
    return levels


def common_words(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``a`` and ``b`` have in common, before either's end is looked at."""
    n, last = np.zeros(len(a), dtype=np.int64), len(levels[0]) - 1
    n[levels[-1][a] == levels[-1][b]] = last + 1
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + n, last), np.minimum(b + n, last)
        more = (n <= last) & (a + n <= last) & (b + n <= last) & (levels[k][x] == levels[k][y])
        n[more] += 1 << k
    return n


def longest(number: np.ndarray, words: A.Words, start: np.ndarray, needles: Needles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, place in the items' line) of the longest matches from the places ``start`` (sorted), where
    whole windows stand, without those inside a longer one."""
    n = len(number)
    inside = np.flatnonzero(covered(start, np.full(len(start), needles.size), n))
    # the covered words in one line, a 0 after each passage and after each document
    owner = np.searchsorted(words.first, inside, side="right") - 1
    gap = np.zeros(len(inside), dtype=np.int64)
    gap[1:] = (np.diff(inside) > 1) | (np.diff(owner) > 0)
    at = np.arange(len(inside)) + np.cumsum(gap)
    text = np.zeros(int(at[-1]) + 2, dtype=np.int64)
    text[at] = number[inside]
    stop = np.flatnonzero(text == 0)
    left = stop[np.searchsorted(stop, np.arange(len(text)))] - np.arange(len(text))
    levels = suffix_ranks(np.concatenate([text, needles.line]), int(min(left.max(), needles.left.max())) + 1)
    items = len(text) + np.flatnonzero(needles.left >= needles.size)
    items = items[np.argsort(levels[-1][items], kind="stable")]
    q = at[np.searchsorted(inside, start)]
    near = np.searchsorted(levels[-1][items], levels[-1][q])
    length, source = np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.int64)
    for side in (near, near - 1):
        p = items[np.clip(side, 0, len(items) - 1)]
        both = np.minimum(np.minimum(common_words(levels, q, p), left[q]), needles.left[p - len(text)])
        better = both > length
        length[better], source[better] = both[better], (p - len(text))[better]
    fresh = np.ones(len(q), dtype=bool)
    fresh[1:] = ~((np.diff(start) == 1) & (np.diff(owner[np.searchsorted(inside, start)]) == 0) & (length[1:] < length[:-1]))
    return start[fresh], length[fresh], source[fresh]


def found_in(words: A.Words, number: np.ndarray, needles: Needles):
    """Of each document of a shard: its item numbers and longest matches (item, item_start, start, length)."""
    window, word = search(words, number, needles)
    out = [([], []) for _ in range(len(words.first) - 1)]
    if not len(window):
        return out
    owner = np.searchsorted(words.first, word, side="right") - 1
    # each window once for a document, then each item once
    pairs = np.unique(owner * len(needles.windows) + window)
    doc, own = pairs // len(needles.windows), pairs % len(needles.windows)
    count = np.diff(needles.owner_start)[own]
    source = np.repeat(needles.owner_start[own], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    pairs = np.unique(np.repeat(doc, count) * len(needles.ids) + needles.owner[source])
    for d, i in zip((pairs // len(needles.ids)).tolist(), (pairs % len(needles.ids)).tolist()):
        out[d][0].append(i)
    whole = needles.lengths[window] == needles.size
    places = np.unique(word[whole])
    told = []
    if len(places):
        start, length, source = longest(number, words, places, needles)
        told += zip(start.tolist(), needles.item[source].tolist(), needles.place[source].tolist(), length.tolist())
    # an item shorter than a window matches whole
    short = np.flatnonzero(~whole)
    told += zip(word[short].tolist(), needles.owner[needles.owner_start[window[short]]].tolist(), [0] * len(short), needles.lengths[window[short]].tolist())
    for p, item, place, length in sorted(told):
        d = int(np.searchsorted(words.first, p, side="right")) - 1
        out[d][1].append((item, place, p - int(words.first[d]), length))
    return out


def merged_length(spans: list[tuple[int, int]]) -> int:
    total, upto = 0, 0
    for a, n in sorted(spans):
        total += max(0, a + n - max(a, upto))
        upto = max(upto, a + n)
    return total


def _pass(shared, fields: pa.DataType, share: int, drop: bool, blank: bool):
    """A pass over Arrow batches with columns row, text and found (of the passes before)."""

    def run(batches):
        needles: Needles = shared.value
        for part in A.grouped(batches, "text", SHARD_BYTES):
            words = A.Words(*A.texts_of(part.column("text")), A.ALNUM_WORDS)
            before = part.column("found").to_pylist()
            out = []
            for n, (items, matches), old in zip(words.counts().tolist(), found_in(words, numbered(words, needles), needles), before):
                old = old or {"item_ids": [], "matches": []}
                told = [{"item_id": needles.ids[i], "item_start": p, "start": s, "length": k} for i, p, s, k in matches]
                told = old["matches"] + told
                ids = sorted({*old["item_ids"], *(needles.ids[i] for i in items)})
                hit = merged_length([(m["start"], m["length"]) for m in told])
                out.append({"n_words": n, "n_hit": hit, "item_ids": ids, "matches": told, "contaminated": hit > 0 and share * hit >= n})
            table = part.set_column(part.schema.get_field_index("found"), "found", pa.array(out, type=fields))
            if blank:
                table = table.set_column(table.schema.get_field_index("text"), "text", pa.nulls(len(table), pa.string()))
            if drop:
                table = table.filter(pa.array([not x["contaminated"] for x in out]))
            yield from table.to_batches()

    return run


def blocks_of(benchmark: DataFrame, block_words: int):
    """Test items in blocks of about so many words."""
    block, held = [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").toLocalIterator():
        block.append((r["i"], r["text"] or ""))
        held += len(block[-1][1]) // 2 + 1
        if held >= 3 * block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def searched(docs: DataFrame, benchmark: DataFrame, size: int, share: int, drop: bool, keep_text: bool, block_words: int) -> DataFrame:
    """row (the other columns of ``docs``), text and found."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    small_batches(spark)
    rest = [F.col(c) for c in docs.columns if c != "text"] or [F.lit(0).alias("__none")]
    rows = docs.select(F.struct(*rest).alias("row"), "text", F.lit(None).cast(FOUND).alias("found"))
    schema, blocks = rows.schema, blocks_of(benchmark, block_words)
    block, following = next(blocks, []), next(blocks, None)
    while True:
        shared, last = spark.sparkContext.broadcast(Needles(block, size)), following is None
        rows = rows.mapInArrow(_pass(shared, to_arrow_type(FOUND), share, drop and last, last and not keep_text), schema)
        if last:
            return rows
        rows = written(rows, "searched")  # one block at a time is in memory
        shared.destroy()
        block, following = following, next(blocks, None)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = SIZE, share: int = 20, drop: bool = False, keep_text: bool = True, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids, matches and contaminated.

    ``drop``: clean documents only.  Without ``keep_text`` the texts do not travel back from Python (``text`` is null).
    """
    rows = searched(docs, benchmark, size, share, drop, keep_text, block_words)
    new = [f.name for f in FOUND]
    return rows.select(
        *[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in new], *[F.col("found")[c].alias(c) for c in new]
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, share: int = 20) -> DataFrame:
    """The clean documents, with the columns of ``docs``."""
    rows = searched(docs, benchmark, size, share, drop=True, keep_text=True, block_words=BLOCK_WORDS)
    return rows.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def items_digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


#: The same rows in DuckDB SQL.
ORACLE_SQL = r"""
with d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from documents
), b as (
  select item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from benchmark
), win as (
  select distinct item_id, least(13, len(ws)) as n, array_to_string(list_slice(ws, i, i + least(13, len(ws)) - 1), ' ') as w
  from b, lateral (select unnest(range(1, len(ws) - least(13, len(ws)) + 2)) as i) where len(ws) > 0
), lens as (select distinct n from win
), spots as (
  select r, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') as w
  from d, lens, lateral (select unnest(range(1, len(ws) - n + 2)) as i) where len(ws) >= n
), hits as (select s.r, s.i, s.n, win.item_id from spots s join win on s.w = win.w and s.n = win.n
), words as (
  select r, count(distinct p) as n_hit from (select distinct r, i, n from hits) h, lateral (select unnest(range(h.i, h.i + h.n)) as p) group by r
), items as (
  select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct r, item_id::varchar as item_id from hits) group by r
)
select doc_id, coalesce(len(ws), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, (coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws)) as contaminated
from d left join words using (r) left join items using (r)
"""


def op2_decontamination(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_contamination(docs, read_table(spark, sf_dir, "benchmark"), keep_text=False)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )
