"""Token counts with a digest cache.

A count depends on the normalised content (null becomes empty; nothing else is changed, as it would change the count)
and on the tokenizer's file.  Both are digested; the distinct digests join a stored table of counts; those that miss
are encoded once each and appended to the table.  Texts shuffle by digest with one copy left of each on the map side, so
a text that a third of all rows share travels once from each task; with a warm cache, texts that it has stay where they
are, if the misses are few enough to be broadcast, or else leave as one copy a task.  Counts come back to the rows by a
join in which the rows of a digest that many share are salted.

Cache table: ``content`` and ``tokenizer`` (SHA-256, binary), ``n_tokens``.  Appends may repeat a digest if two jobs run
at once; reads take it once.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted one by one from one cache row;
null doc_ids pass through; an empty table gives an empty result and leaves the cache as it is; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from . import _bpe
from ._spark import join_counted, read_table, scratch_path, small_batches, written

LIMIT = 512
GROUP_BYTES = 2 << 20
#: Missing digests (32 bytes each) that are broadcast at most.
MAX_BROADCAST_DIGESTS = 200_000
CACHE = "content binary, tokenizer binary, n_tokens long"


def tokenizer_digest(path: str) -> bytes:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).digest()


def _counter(path: str):
    def run(batches):
        if path.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda column: np.array([len(x) for x in library.encode([t or "" for t in column.to_pylist()], num_threads=1)], dtype=np.int64)
        else:
            encoder = _bpe.encoder(path)
            count = lambda column: np.diff(encoder.encode_column(column)[1]).astype(np.int64)
        for group in A.grouped(batches, "text", GROUP_BYTES):
            yield pa.RecordBatch.from_arrays(
                [group.column("content").combine_chunks(), pa.array(count(group.column("text").combine_chunks()))], names=["content", "n_tokens"]
            )

    return run


def cached(spark, cache: str) -> DataFrame | None:
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def token_counts(
    docs: DataFrame, tokenizer: str, cache: str, limit: int = LIMIT, broadcast_digests: int = MAX_BROADCAST_DIGESTS
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, from the cache at ``cache`` after the misses were appended."""
    spark = docs.sparkSession
    small_batches(spark)
    version = F.lit(tokenizer_digest(tokenizer))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content"))
    keyed = written(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content"), "digests")
    distinct = written(keyed.groupBy("content").agg(F.count("*").alias("m")), "distinct-digests")
    stored = cached(spark, cache)
    texts = rows.select("content", "text")
    if stored is None:
        missing = texts.groupBy("content").agg(F.first("text").alias("text"))
    else:
        have = stored.where(F.col("tokenizer") == version).select("content")
        misses = written(distinct.select("content").join(have, "content", "left_anti"), "misses")
        few = misses.count() <= broadcast_digests
        missing = (texts.join(F.broadcast(misses), "content", "left_semi") if few else texts).groupBy("content").agg(F.first("text").alias("text"))
        missing = missing if few else missing.join(misses, "content", "left_semi")
    counted = missing.select("content", "text").mapInArrow(_counter(tokenizer), "content binary, n_tokens long")
    counted.select("content", version.alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    known = known.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    found = written(distinct.join(known, "content"), "found-counts")
    out = join_counted(keyed, found, ["content"], "m", keyed.count())
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, _bpe.public_path(), scratch_path(spark, "token-cache"))
