"""Training-order materialisation: token sequences as fixed-stride binary shards, in a keyed random order.

Every document's ids (and an end id) are cut into sequences of ``length`` tokens, the last padded. A
first pass counts the sequences of each input partition; their running sum numbers all sequences
densely. A keyed Feistel permutation with cycle-walking sends each number to its global slot. Slots
are range-partitioned into shards of ``per_shard`` records, each a row of files of ``per_file``
records, which follow from the number of all (shard=0/file=0, shard=0/file=1, ...), sorted, and written by Spark's own file writer, so a
lost executor costs a task, and a store that only Spark reaches will do. A record is

    int64 doc_id (the smallest if null), uint32 sequence in the document, uint32 tokens in use,
    ``length`` ids (uint16 where the vocabulary fits, else uint32), uint16 zero

little-endian, so slot i is in file i // per_file (numbered through all shards), at byte
(i % per_file) * stride, and reading resumes anywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstone.llm._spark import shared_dir, whole
from weirstone.llm._text import lists, slices
from weirstone.llm.feistel import permute
from weirstone.llm.tokens import SLICE_BYTES, PreTokens, encode, load, piece_counts

HEADER = 16

#: Bytes of text whose records are made together: several numbers by token are held meanwhile.
RECORD_BYTES = 5 << 20

#: Records of a file (9 MB of 256 tokens) and of a shard (2.2 GB) at least. Files grow with the records, so that there are no more than MOST_FILES until they hold LARGEST records.
PER_FILE, PER_SHARD, LARGEST, MOST_FILES = 1 << 14, 1 << 22, 1 << 21, 1 << 16
NO_ID = -(1 << 63)


def file_records(n: int) -> int:
    """Records of a file, a power of two, for ``n`` in all."""
    return min(max(PER_FILE, (1 << max(n - 1, 0).bit_length()) // MOST_FILES), LARGEST)


def id_width(model: str) -> int:
    """Bytes of an id: two if all ids of the vocabulary fit, else four."""
    return 2 if load(model).get_piece_size() <= 1 << 16 else 4


def end_id(model: str) -> int:
    end = load(model).eos_id()
    if end < 0:
        raise ValueError(f"{model} has no end id to close documents with")
    return end


def stride(length: int, width: int = 2) -> int:
    return HEADER + width * length + 2


def record_type(length: int, width: int) -> np.dtype:
    return np.dtype([("doc_id", "<i8"), ("sequence", "<u4"), ("used", "<u4"), ("ids", f"<u{width}", (length,)), ("zero", "<u2")])


def _sequences(model: str, length: int, tokens: PreTokens) -> np.ndarray:
    """The number of sequences of each row; a row without text has none."""
    count = tokens.per_row(piece_counts(model, tokens.distinct))
    return np.where(count > 0, (count + length) // length, 0)  # ceil((count + 1) / length), with the end id


def _totals(model: str, length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for batch in slices(batches, "text", SLICE_BYTES):
        total += int(_sequences(model, length, PreTokens(batch.column("text"))).sum())
    yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "n": pa.array([total], pa.int64())})


def records(doc_ids: np.ndarray, tokens: PreTokens, flat: np.ndarray, lengths: np.ndarray, length: int, end: int, width: int = 2) -> np.ndarray:
    """All records of a slice, as rows of bytes, in input order."""
    count = tokens.per_row(lengths)
    with_end = np.where(count > 0, count + 1, 0)
    n_seq = -(-with_end // length)
    # Half the bytes where they do, as there are several numbers by token.
    kind = np.int32 if max(int(n_seq.sum()) * length, int(count.sum())) < 1 << 31 else np.int64
    begin = (np.cumsum(lengths) - lengths).astype(kind)
    per_token = lengths.astype(kind)[tokens.code]
    # Where each pre-token's ids go: rows begin at whole sequences.
    row_at = (np.cumsum(n_seq) - n_seq) * length
    before = np.cumsum(per_token, dtype=kind) - per_token
    shift = (row_at - (np.cumsum(count) - count)).astype(kind)
    target = before + np.repeat(shift, np.diff(tokens.first))
    inside = np.arange(int(count.sum()), dtype=kind) - np.repeat(before, per_token)
    body = np.zeros(int(n_seq.sum()) * length, f"<u{width}")
    source = np.repeat(begin[tokens.code], per_token)
    source += inside
    inside += np.repeat(target, per_token)
    body[inside] = flat[source]
    del inside, source
    some = count > 0
    body[row_at[some] + count[some]] = end
    owner = np.repeat(np.arange(len(count)), n_seq)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(n_seq) - n_seq, n_seq)
    out = np.zeros(len(owner), record_type(length, width))
    out["doc_id"], out["sequence"] = doc_ids[owner], number
    out["used"] = np.minimum(with_end[owner] - number * length, length)
    out["ids"] = body.reshape(-1, length)
    return out.view(np.uint8).reshape(len(owner), out.itemsize) if len(owner) else np.zeros((0, out.itemsize), np.uint8)


def _records(model: str, length: int, width: int, end: int, per_file: int, key: int, offsets: object, n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = stride(length, width)
    part = TaskContext.get().partitionId()
    at, upto = offsets.value.get(part, (0, 0))
    for batch in slices(batches, "text", RECORD_BYTES):
        doc_ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        tokens = PreTokens(batch.column("text"))
        rows = records(doc_ids, tokens, *encode(model, tokens.distinct), length, end, width)
        if at + len(rows) > upto:
            raise RuntimeError(f"partition {part} holds other rows than when it was counted")
        slot = permute(np.arange(at, at + len(rows)), n, key)
        at += len(rows)
        for k in range(0, len(rows), 1 << 14):
            some = rows[k : k + (1 << 14), :-1]
            bounds = np.arange(len(some) + 1, dtype=np.int32) * (size - 1)
            body = pa.Array.from_buffers(pa.string(), len(some), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(some))])
            where = slot[k : k + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array((where // per_file).astype(np.int32)), pa.array(where), body], names=["file", "slot", "record"])
    if at != upto:
        raise RuntimeError(f"partition {part} holds other rows than when it was counted")


@contextmanager
def _same_partitions(spark: SparkSession):
    """While this holds, scans are dealt into the same partitions, whatever happens to the number of executors."""
    name = "spark.sql.files.minPartitionNum"
    was = spark.conf.get(name, None)
    spark.conf.set(name, was or spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.set(name, was) if was else spark.conf.unset(name)


def write_sequences(docs: DataFrame, model: str, path: str, *, length: int = 256, per_file: int | None = None, per_shard: int = PER_SHARD, key: int = 1, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Write all sequences of ``docs`` as shards below ``path``; the number of sequences, n. Files hold ``file_records(n)`` records unless ``per_file`` says otherwise.

    ``docs`` is scanned twice, so it must be a table's rows (or a checkpoint), not the outcome of a
    shuffle; a task that finds other rows than were counted fails. Null and empty texts have no
    sequence; repeated rows each have their own, and rows without an id too. Without any sequence
    nothing is written. A model without an end id is refused, and so are ids that are no whole numbers, as records have no place for them.
    """
    if not whole(docs, id_col):
        raise TypeError(f"records hold whole numbers as ids; {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    if per_file and per_shard % per_file:
        raise ValueError("a shard holds whole files")
    spark, width, end = docs.sparkSession, id_width(model), end_id(model)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with _same_partitions(spark):
        totals = sorted((r.part, r.n) for r in base.mapInArrow(partial(_totals, model, length), "part long, n long").collect())  # a number for each partition
        offsets, n = {}, 0
        for part, count in totals:
            offsets[part] = (n, n + count)
            n += count
        per_file = per_file or file_records(n)
        if n:
            fn = partial(_records, model, length, width, end, per_file, key, spark.sparkContext.broadcast(offsets), n)
            rows = base.mapInArrow(fn, "file int, slot long, record string")
            rows = rows.withColumn("shard", F.floor(F.col("file") / (per_shard // per_file)).cast("int"))
            # In the order of the folders first, as the writer would sort once more otherwise.
            rows = rows.repartitionById(-(-n // per_file), "file").sortWithinPartitions("shard", "file", "slot").select("shard", "file", "record")
            # One file by number, whatever the session says of the records of a file.
            rows.write.partitionBy("shard", "file").option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 0).text(path)
    return n


def _parsed(length: int, width: int, per_file: int, per_shard: int, begin: int, end: int | None, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    kind = record_type(length, width)
    for batch in batches:
        for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
            every = np.frombuffer(content.as_buffer(), kind)
            first = file * per_file
            low, high = max(0, begin - first), len(every) if end is None else min(len(every), end - first)
            for k in range(low, high, 1 << 13):
                rows = every[k : min(k + (1 << 13), high)]
                slot = np.arange(k, k + len(rows), dtype=np.int64) + first
                held = memoryview(np.ascontiguousarray(rows["ids"]).tobytes())
                begins, ends = np.arange(len(rows)) * length * width, rows["used"].astype(np.int64) * width
                crc = [zlib.crc32(held[i:j]) for i, j in zip(begins.tolist(), (begins + ends).tolist(), strict=True)]
                said = {"ids": lists(rows["ids"][np.arange(length) < rows["used"][:, None]].astype(np.int32), rows["used"])} if with_ids else {}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), pa.array((slot // per_shard).astype(np.int32)), pa.array(slot % per_shard * kind.itemsize), pa.array(rows["doc_id"], mask=rows["doc_id"] == NO_ID), pa.array(rows["sequence"].astype(np.int64)), pa.array(rows["used"].astype(np.int64)), pa.array(crc, pa.int64()), *said.values()],
                    names=["slot", "shard", "byte_offset", "doc_id", "sequence", "n_tokens", "ids_crc32", *said],
                )


READ = "slot long, shard int, byte_offset long, doc_id long, sequence long, n_tokens long, ids_crc32 long"


def read_sequences(spark: SparkSession, path: str, *, length: int = 256, width: int = 2, per_file: int = PER_FILE, per_shard: int = PER_SHARD, begin: int = 0, end: int | None = None, with_ids: bool = True) -> DataFrame:
    """The records of slots ``begin`` to before ``end`` below ``path``, one row each, from the files themselves. Files without such slots are not opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.where(F.col("file") >= begin // per_file)
    files = files if end is None else files.where(F.col("file") <= (end - 1) // per_file)
    return files.select(F.col("file").cast("int").alias("file"), "content").mapInArrow(partial(_parsed, length, width, per_file, per_shard, begin, end, with_ids), READ + ", ids array<int>" * with_ids)


def materialise(docs: DataFrame, model: str, *, length: int = 256, per_file: int | None = None, per_shard: int = PER_SHARD, key: int = 1, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards (by default into a new folder of the shared one) and read back every record's slot, place (byte of the shard), owner and a digest of its ids."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/sequences-{uuid.uuid4().hex}"
    n = write_sequences(docs, model, path, length=length, per_file=per_file, per_shard=per_shard, key=key, id_col=id_col, text_col=text_col)
    if not n:
        return spark.createDataFrame([], READ)
    return read_sequences(spark, path, length=length, width=id_width(model), per_file=per_file or file_records(n), per_shard=per_shard, with_ids=False)
