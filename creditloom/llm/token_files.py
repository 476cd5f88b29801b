"""Token ids as Arrow files of fixed-size lists: equal-length sequences and masks that can be read in place.

Documents are range-partitioned by id; each partition writes one shard, ``NNNNN.sequences.arrow``: record batches of
``ROWS`` rows, each row a list of ``LENGTH`` ids and a list of as many mask bits (1 for an id, 0 for the padding of a shard's last
sequence). Ids are as narrow as the vocabulary allows and nothing is compressed, so sequence ``i`` of a shard and its mask bits
are views into the mapped file. ``NNNNN.documents.arrow`` names the documents of the shard with their first id and number of ids, and the
Parquet table ``shards`` holds a row per shard with the ids before it. Ids of a document run on over the ends of sequences.

A file is written under a name of its task attempt and then renamed; a task that is run again writes the same bytes.

Defined results: a null text is an empty one; an empty text is the end mark alone; a null id is the smallest; rows of one id
follow each other in the order of the input; repeated rows are encoded once each; an empty table gives no shard; other columns
are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditloom.llm.common import read, shared_dir, small_batches, text_or_empty
from creditloom.llm.tokens import loaded

#: Ids of a sequence, sequences of a record batch, and the id that ends a document.
LENGTH, ROWS, END = 1024, 256, 2
SHARDS = "shard int, name string, documents long, ids long, sequences long"
DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def sequence_schema(vocabulary: int, length: int = LENGTH) -> pa.Schema:
    ids = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([pa.field("ids", pa.list_(pa.field("item", ids, nullable=False), length), nullable=False),
                      pa.field("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length), nullable=False)])


class _Shard:
    """Writes the two files of a shard; at most one record batch of ids is held."""

    def __init__(self, files: fs.FileSystem, folder: str, name: str, attempt: str, schema: pa.Schema, length: int) -> None:
        self.files, self.length, self.schema = files, length, schema
        self.moves = [(f"{folder}/_{name}-{attempt}.{kind}", f"{folder}/{name}.{kind}.arrow") for kind in ("sequences", "documents")]
        self.out = [files.open_output_stream(temporary) for temporary, _ in self.moves]
        self.sequences, self.documents = (pa.ipc.new_file(out, s) for out, s in zip(self.out, (schema, DOCUMENTS)))
        self.kind = schema.field("ids").type.value_type.to_pandas_dtype()
        self.held, self.n_held, self.ids, self.rows, self.count = [], 0, 0, 0, 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        start = self.ids + np.cumsum(counts) - counts
        self.documents.write_batch(pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(start), pa.array(counts)], schema=DOCUMENTS))
        self.held.append(ids.astype(self.kind))
        self.n_held, self.ids, self.count = self.n_held + len(ids), self.ids + len(ids), self.count + len(counts)
        block = ROWS * self.length
        if self.n_held >= block:
            flat = np.concatenate(self.held)
            for at in range(0, len(flat) - block + 1, block):
                self._write(flat[at:at + block], block)
            self.held = [flat[len(flat) // block * block:]]
            self.n_held = len(self.held[0])

    def _write(self, flat: np.ndarray, real: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((flat, np.arange(len(flat)) < real), self.schema)]
        self.sequences.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.rows += len(flat) // self.length

    def close(self) -> None:
        flat = np.concatenate([*self.held, np.zeros(-self.n_held % self.length, dtype=self.kind)])
        if len(flat):
            self._write(flat, self.n_held)
        for writer, out in zip((self.sequences, self.documents), self.out):
            writer.close()
            out.close()
        for temporary, final in self.moves:
            self.files.move(temporary, final)


def _writer(folder: str, tokenizer: str, length: int, end: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tokens, task = None, loaded(tokenizer), TaskContext.get()
        files, at = fs.FileSystem.from_uri(folder)
        name = f"{task.partitionId():05d}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if shard is None:
                schema = sequence_schema(max(end + 1, len(tokens.blank)), length)
                shard = _Shard(files, at, name, f"{task.taskAttemptId()}-{uuid.uuid4().hex}", schema, length)
            ids, counts = tokens.batch(batch.column(1))
            shard.add(batch.column(0), np.insert(ids, np.cumsum(counts), end), counts + 1)
        if shard is not None:
            shard.close()
            row = (task.partitionId(), name, shard.count, shard.ids, shard.rows)
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "name", "documents", "ids", "sequences"), row))],
                                             schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("sequences", pa.int64())]))

    return write


def write_files(docs: DataFrame, folder: str, tokenizer: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts, by ascending id, to ``folder`` (which executors share); returns the table of shards."""
    spark = docs.sparkSession
    files, at = fs.FileSystem.from_uri(folder)
    files.create_dir(at, recursive=True)
    small_batches(spark)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), F.monotonically_increasing_id().alias("tie"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    dealt = base.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    dealt.mapInArrow(_writer(folder, tokenizer, length, end), SHARDS).write.parquet(f"{folder}/written")
    written = spark.read.schema(SHARDS).parquet(f"{folder}/written")
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    written.withColumn("ids_before", F.coalesce(F.sum("ids").over(before), F.lit(0))).write.parquet(f"{folder}/shards")
    return spark.read.schema(f"{SHARDS}, ids_before long").parquet(f"{folder}/shards")


class SequenceFile:
    """Random access to the sequences of a shard; on a local file the arrays are views into the mapped file.

    The length of a sequence must be a multiple of eight, so that the mask of each starts with a byte.
    """

    def __init__(self, files: fs.FileSystem, path: str) -> None:
        source = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        self._at, self._batch = -1, None

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of record batch ``k``, a row per sequence, and the bits of their masks, lowest first, eight to a byte."""
        if k != self._at:
            batch = self.reader.get_batch(k)
            ids = batch.column(0).flatten().to_numpy(zero_copy_only=True).reshape(-1, self.length)
            bits = np.frombuffer(batch.column(1).flatten().buffers()[1], dtype=np.uint8, count=ids.size // 8).reshape(len(ids), -1)
            self._at, self._batch = k, (ids, bits)
        return self._batch

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sequence ``i`` and the bits of its mask; ``np.unpackbits(bits, bitorder="little")`` gives a value per id."""
        ids, bits = self.block(i // ROWS)
        return ids[i % ROWS], bits[i % ROWS]

    def pieces(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ``n`` ids from position ``start`` of the shard on, block by block."""
        size = ROWS * self.length
        while n > 0:
            ids, bits = self.block(start // size)
            flat = ids.reshape(-1)[start % size:start % size + n]
            last = start % size + len(flat) - 1
            if not len(flat) or not bits.reshape(-1)[last // 8] >> (last % 8) & 1:
                raise ValueError("a document reaches beyond the ids of its shard")
            yield flat
            start, n = start + len(flat), n - len(flat)


def _digests(folder: str):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                sequences = SequenceFile(files, f"{at}/{row['name']}.sequences.arrow")
                with files.open_input_file(f"{at}/{row['name']}.documents.arrow") as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        docs, crcs = index.get_batch(k), []
                        for start, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist()):
                            crc = 0
                            for ids in sequences.pieces(start, n):
                                crc = zlib.crc32(ids.astype("<u4"), crc)
                            crcs.append(crc)
                        start = pa.array(docs.column(1).to_numpy() + row["ids_before"])
                        yield pa.RecordBatch.from_arrays([docs.column(0), start, docs.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return digest


def read_digests(shards: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of unsigned 32-bit ids) from the files, a task per shard."""
    n = shards.count()
    return shards.repartition(max(1, n)).select("name", "ids_before").mapInArrow(_digests(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/tokens"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_digests(write_files(read(spark, sf_dir, "documents"), folder, public_tokenizers.path(tokenizer)), folder)
