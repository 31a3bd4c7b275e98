"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Features of a text: its words and word pairs, lower case, and its word *shapes* and shape pairs (runs of letters and of
digits shortened to one mark each, other characters as they are), hashed into ``2**BITS`` places; a pair of equal words
also has a place shared by all such pairs.  A place's value is
its count over the number of features, so that a score does not depend on the length.  The score is the logistic of a
sparse dot product and the bias.

Training reads a bounded sample of labelled rows (``MAX_TRAINING``, by smallest MD5 of the doc_id, so that it does not
depend on the row order), one text for each: of rows that repeat a sampled doc_id the smallest; of labels that repeat one
the largest.  Features are made on the executors, and the per-coordinate updates, which are sequential, run
in one task over sparse rows: the distinct places of a whole text with their counts, at most ``2**BITS``.  The driver gets
the weights only (2 MB).  Scoring covers every whole text too.

Defined results: null and empty texts have no features and score the bias's logistic; a null label or a label without a
document trains nothing; without training rows every score is 0.5; a null doc_id is scored and never trains; repeated
rows are scored one by one; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._spark import read_table, small_batches

BITS = 18
MAX_TRAINING = 6_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.0005, 0.1
SCALE = 8.0
GROUP_BYTES = 1 << 20

_B = np.arange(256)
#: Classes of bytes in a shape: a, A, digit, high; the rest stand for themselves.
_SHAPE = _B.astype(np.uint8).copy()
_SHAPE[(_B >= 97) & (_B <= 122)] = 97
_SHAPE[(_B >= 65) & (_B <= 90)] = 65
_SHAPE[(_B >= 48) & (_B <= 57)] = 48
_SHAPE[_B >= 128] = 97


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places of all texts, number of each text)."""
    raw, offsets = A.texts_of(column)
    words = A.Words(raw, offsets, A.SPACE_WORDS)
    shaped = _SHAPE[raw]
    # shorten runs, but not across texts
    keep = np.ones(len(shaped), dtype=bool)
    keep[1:] = shaped[1:] != shaped[:-1]
    inner = offsets[1:-1]
    keep[inner[inner < len(shaped)]] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    shapes = A.Words(shaped[keep], upto[offsets], A.SPACE_WORDS, lower=False)
    mask = A.U((1 << BITS) - 1)
    out, owners = [], []
    for salt, w in ((1, words), (3, shapes)):
        who = w.owners()
        out.append(A.mixed(w.hashes ^ A.U(salt)) & mask)
        owners.append(who)
        if len(who) > 1:
            same = who[1:] == who[:-1]
            out.append((A.windows(w.hashes, 2)[same] ^ A.U(salt + 1)) & mask)
            owners.append(who[1:][same])
            # a pair of one word with itself is a feature of its own, whatever the word
            twice = same & (w.hashes[1:] == w.hashes[:-1])
            out.append(np.full(int(twice.sum()), salt, dtype=np.uint64))
            owners.append(who[1:][twice])
    places, who = np.concatenate(out), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return places[order].astype(np.int64), np.bincount(who, minlength=len(offsets) - 1)


def sparse_rows(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    places, counts = features(column)
    rows, at = [], 0
    for n in counts.tolist():
        own = places[at : at + n]
        at += n
        p, c = np.unique(own, return_counts=True)
        rows.append((p, c / max(1, len(own)) * SCALE))
    return rows


class FollowTheLeader:
    """FTRL-proximal updates of a logistic model, coordinate by coordinate."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, places: np.ndarray) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(places)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ values, -35, 35)))
        g = (p - label) * values
        n = self.n[places]
        self.z[places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[places] = n + g * g

    def all_weights(self) -> np.ndarray:
        return self.weights(np.arange(len(self.z)))


def _featurise(batches):
    for part in A.grouped(batches, "text", GROUP_BYTES):
        rows = sparse_rows(part.column("text"))
        counts = np.array([len(p) for p, _ in rows], dtype=np.int64)
        join = lambda k, kind: np.concatenate([np.zeros(0, kind), *(r[k].astype(kind) for r in rows)])
        yield pa.RecordBatch.from_arrays(
            [
                part.column("rank").combine_chunks(),
                part.column("label").combine_chunks(),
                A.lists(pa.array(join(0, np.int32)), counts),
                A.lists(pa.array(join(1, np.float32)), counts),
            ],
            names=["rank", "label", "places", "weights"],
        )


def _trained(batches):
    """One row: the weights after all updates, as bytes."""
    examples = []
    for part in batches:
        places, weights = part.column("places"), part.column("weights")
        ends = places.offsets.to_numpy().astype(np.int64)
        p, w = places.values.to_numpy(), weights.values.to_numpy()
        for rank, label, a, b in zip(part.column("rank").to_pylist(), part.column("label").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
            examples.append((rank, label, p[a:b], w[a:b]))
    examples.sort(key=lambda x: (x[0], len(x[2]), x[3].sum()))
    model = FollowTheLeader(1 << BITS)
    bias = np.array([1 << BITS])
    for _ in range(EPOCHS):
        for _, label, places, values in examples:
            model.update(np.concatenate([places, bias]), np.concatenate([values, [1.0]]), label)
    yield pa.RecordBatch.from_arrays([pa.array([model.all_weights().tobytes()], pa.binary())], names=["model"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING) -> np.ndarray:
    """Weights (the bias last) from at most ``most`` labelled rows; reads text and label only."""
    small_batches(docs.sparkSession)
    sample = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy(F.col("doc_id").cast("string").alias("doc_id"))
        .agg(F.max("quality").cast("int").alias("label"))
        .where(~held_out(F.col("doc_id")))
        .select("doc_id", "label", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("rank"))
        .orderBy("rank")
        .limit(most)
    )
    # at most ``most`` rows of under 100 bytes
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("rank", "label").agg(F.min("text").alias("text"))
    got = rows.select("rank", "label", "text").mapInArrow(_featurise, "rank string, label int, places array<int>, weights array<float>")
    # the sample's features, some 7 KB a row, meet in one task, as each update needs the one before
    model = got.repartition(1).mapInArrow(_trained, "model binary").collect()
    return np.frombuffer(bytes(model[0]["model"])) if model else FollowTheLeader(1 << BITS).all_weights()


def _scorer(shared, keep_above: float | None):
    def run(batches):
        weights = shared.value
        for part in A.grouped(batches, "text", GROUP_BYTES):
            places, counts = features(part.column("text"))
            who = np.repeat(np.arange(len(counts)), counts)
            sums = np.bincount(who, weights=weights[places], minlength=len(counts)) * SCALE / np.maximum(counts, 1)
            score = 1.0 / (1.0 + np.exp(-np.clip(sums + weights[-1], -35, 35)))
            if keep_above is None:
                table = part.drop_columns(["text"]).append_column("score", pa.array(score))
            else:
                table = part.filter(pa.array(score >= keep_above))
            yield from table.to_batches()

    return run


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    return docs.select("doc_id", "text").mapInArrow(_scorer(shared, None), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, weights: np.ndarray, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, all columns kept."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    packed = docs.select("text", F.struct(*docs.columns).alias("all"))
    return packed.mapInArrow(_scorer(shared, least), packed.schema).select("all.*")


def op10_quality_classifier(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
