"""Token ids as fixed-width packed files.

File format (``.tpk``):

    bytes 0-3    magic ``TPK1``
    bytes 4-7    bits of an id (the minimum for the vocabulary)
    bytes 8-15   number of ids n
    bytes 16-19  ids of a block B
    bytes 20-23  number of documents d
    then         8 bytes for each document: its first id's place in the file, and n at the end (d + 1 values)
    then         8 bytes for each block: where its bytes start, and their end at the end (ceil(n / B) + 1 values)
    then         the blocks: B ids, packed without gaps, lowest bit first, each block starting on a byte

All numbers are little-endian.  A block is unpacked by a few numpy operations; any id is found by its block's offset, and
a reader fetches the head and the blocks it needs, nothing else.

Documents are range-partitioned and sorted by doc_id, encoded, and written as files of about ``FILE_IDS`` ids in that
order, to a store that Spark and pyarrow both know.  Every attempt of a task writes files of names of its own and reports
them in rows of the index, a table that Spark commits; a file that the index does not name is the remains of a lost or
repeated attempt, and is deleted after the commit.  Starts come from the index by prefix sums over files within a task
and over tasks.  The ids' checks are read back from the files.

Defined results: null texts are empty and have the end id alone; null doc_ids come first; rows that repeat a doc_id follow
each other, ordered by text; ids beyond the vocabulary's width are refused; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _arrays as A
from . import _bpe
from ._spark import read_table, scratch_path, small_batches

END_ID = 2
FILE_IDS = 1 << 20
BLOCK_IDS = 4096
GROUP_BYTES = 2 << 20
#: Files that a task reads back.
FILES_A_TASK = 2
MAGIC = b"TPK1"
INDEX = "part int, seq int, n_ids long, doc_ids array<{}>, file string"


def width(vocabulary: int) -> int:
    return max(1, (max(vocabulary, 2) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits == 16:
        return ids.astype("<u2").tobytes()
    return np.packbits((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1 == 1, bitorder="little").tobytes()


def unpack(data: bytes | memoryview, count: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, dtype="<u2", count=count).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return flags.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def to_file(ids: np.ndarray, doc_starts: np.ndarray, bits: int, block: int = BLOCK_IDS) -> bytes:
    """One file.  ``doc_starts``: first places of its documents, and the number of ids at the end."""
    blocks = [pack(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)])
    head = MAGIC + struct.pack("<IQII", bits, len(ids), block, len(doc_starts) - 1)
    return b"".join([head, doc_starts.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), *blocks])


class File:
    """Random access to one file's ids.  ``data``: its bytes, or a file that can be read at any place."""

    def __init__(self, data):
        self.source = data
        head = self._read(0, 24)
        if head[:4] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.count, self.block, docs = struct.unpack_from("<IQII", head, 4)
        blocks = -(-self.count // self.block)
        at = 24 + 8 * (docs + 1)
        self.body = at + 8 * (blocks + 1)
        places = np.frombuffer(self._read(24, self.body - 24), dtype="<u8").astype(np.int64)
        self.doc_starts, self.offsets = places[: docs + 1], places[docs + 1 :]

    def _read(self, start: int, size: int):
        if isinstance(self.source, bytes):
            return memoryview(self.source)[start : start + size].tobytes()
        return self.source.read_at(size, start)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids of the places start to end: only their blocks are read and unpacked."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        base = int(self.offsets[first])
        data = memoryview(self._read(self.body + base, int(self.offsets[last + 1]) - base))
        parts = [
            unpack(data[self.offsets[b] - base : self.offsets[b + 1] - base], min(self.block, self.count - b * self.block), self.bits)
            for b in range(first, last + 1)
        ]
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.doc_starts[i]), int(self.doc_starts[i + 1]))


def store_of(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def open_file(path: str) -> File:
    store, place = store_of(path)
    return File(store.open_input_file(place))


def _writer(tokenizer: str, folder: str, end_id: int, file_ids: int):
    def run(batches):
        from pyspark import TaskContext

        encoder = _bpe.encoder(tokenizer)
        bits = width(max(encoder.vocabulary, end_id + 1))
        part, seq = TaskContext.get().partitionId(), 0
        store, place = store_of(folder)
        ids, starts, docs, count = [], [0], [], 0

        def file():
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.tpk"
            with store.open_output_stream(f"{place}/{name}") as out:
                out.write(to_file(np.concatenate(ids), np.array(starts), bits))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([seq], pa.int32()),
                    pa.array([count], pa.int64()),
                    A.lists(pa.concat_arrays(docs), np.array([len(starts) - 1])),
                    pa.array([f"{folder}/{name}"]),
                ],
                names=["part", "seq", "n_ids", "doc_ids", "file"],
            )

        for group in A.grouped(batches, "text", GROUP_BYTES):
            flat, offsets = encoder.encode_column(group.column("text").combine_chunks())
            keys, first = group.column("doc_id").combine_chunks(), 0
            for k in range(len(keys)):
                own = flat[offsets[k] : offsets[k + 1]]
                ids += [own, np.array([end_id], np.uint32)]
                count += len(own) + 1
                starts.append(count)
                if count >= file_ids or k == len(keys) - 1:
                    docs.append(keys[first : k + 1])
                    first = k + 1
                if count >= file_ids:
                    yield file()
                    ids, starts, docs, count, seq = [], [0], [], 0, seq + 1
        if docs:
            yield file()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order to files in ``path``/ids; their index."""
    spark = docs.sparkSession
    small_batches(spark)
    store, place = store_of(f"{path}/ids")
    store.create_dir(place, recursive=True)
    index = INDEX.format(docs.schema["doc_id"].dataType.simpleString())
    order = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    order.mapInArrow(_writer(tokenizer, f"{path}/ids", end_id, file_ids), index).write.parquet(f"{path}/index")
    files = spark.read.schema(index).parquet(f"{path}/index")
    drop_remains(files, f"{path}/ids")
    return files


def drop_remains(files: DataFrame, folder: str) -> None:
    """Delete the files in ``folder`` that the index ``files`` does not name; the driver sees names that are too many."""
    spark = files.sparkSession
    store, place = store_of(folder)
    # names only: a file has about a million ids
    there = [f.base_name for f in store.get_file_info(pa.fs.FileSelector(place)) if f.is_file]
    if len(there) == files.count():
        return
    named = files.select(F.element_at(F.split("file", "/"), -1).alias("name"))
    for r in spark.createDataFrame([(n,) for n in there], "name string").join(named, "name", "left_anti").toLocalIterator():
        store.delete_file(f"{place}/{r['name']}")


def _reader(batches):
    for batch in batches:
        part, seq, lists = (batch.column(c) for c in ("part", "seq", "doc_ids"))
        for i, name in enumerate(batch.column("file").to_pylist()):
            file = open_file(name)
            flat = file.ids(0, file.count).astype("<u4")
            starts = file.doc_starts
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            docs = lists.slice(i, 1).flatten()
            yield pa.RecordBatch.from_arrays(
                [
                    docs,
                    pa.array([part[i].as_py()] * len(docs), pa.int32()),
                    pa.array([seq[i].as_py()] * len(docs), pa.int32()),
                    pa.array(starts[:-1]),
                    pa.array(np.diff(starts)),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "part", "seq", "inside", "n_tokens", "ids_crc32"],
            )


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files of an index."""
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    counts = files.select("part", "seq", "n_ids")
    # one row for each task that wrote
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before().orderBy("part")), F.lit(0)))
    starts = counts.withColumn("ahead", F.coalesce(F.sum("n_ids").over(before("part").orderBy("seq")), F.lit(0)))
    starts = starts.join(parts.select("part", "base"), "part").select("part", "seq", (F.col("ahead") + F.col("base")).alias("ahead"))
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    dealt = files.select("part", "seq", "doc_ids", "file").repartition(max(1, files.count() // FILES_A_TASK), "file")
    rows = dealt.mapInArrow(
        _reader, f"doc_id {kind}, part int, seq int, inside long, n_tokens long, ids_crc32 long"
    )
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("ahead") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_output(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_tokens(write_tokens(docs, _bpe.public_path(), scratch_path(spark, "token-files")))
