"""Token ids in binary files: fixed-width bit packing with block offsets.

Every id takes the fewest bits that the vocabulary needs. A file (shard) is

    8 bytes   b"RVLNTOK1"
    blocks    BLOCK ids each (the last may have fewer), packed with the lowest
              bit first and padded to a whole byte
    footer    numpy arrays of little-endian longs: each block's offset in the
              file, then each document's id, whether it has one (0 or 1) and its number of ids
    trailer   7 longs: bits, ids, blocks, documents, ids in a block, vocabulary, the footer's offset; 8 bytes b"RVLNEND1"

A block unpacks by itself with numpy, and a document's ids are the run of ids
from the sum of the counts before it, so any document can be read from the
blocks that hold it. Shards hold consecutive ranges of documents in ascending
order of doc_id; a task writes its shard as a stream, block by block, under a
name that no other attempt uses, and the manifest (a table) names the shards
of successful attempts only. Files lie in the folder all executors share.

Defined cases: a null or empty text has only the end id. Rows that share a
doc_id are documents of their own, ordered by text. Rows without a doc_id come
last. An empty table gives an empty manifest. Other columns of the input are
neither read nor written.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.llm.scratch import new_dir, table
from ravelin.llm.tokens import Encoder

HEAD, TAIL = b"RVLNTOK1", b"RVLNEND1"
BLOCK = 1 << 16
TRAILER = 7 * 8 + len(TAIL)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids as unsigned integers of so many bits, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)).astype(np.uint8) & 1
    return np.packbits(planes.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first count ids of packed data."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * bits)
    return (planes.reshape(count, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class ShardWriter:
    """Writes one shard as documents arrive."""

    def __init__(self, stream, vocabulary: int):
        self.stream, self.vocabulary, self.bits = stream, vocabulary, max(1, int(vocabulary - 1).bit_length())
        self.stream.write(HEAD)
        self.place, self.waiting = len(HEAD), np.empty(0, np.int64)
        self.offsets: list[int] = []
        self.docs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.n_ids = 0

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.place)
        self.stream.write(data)
        self.place += len(data)

    def add(self, doc_ids: np.ndarray, named: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents in order: their ids, whether they have one, how many token ids each has, and those in a row."""
        self.docs.append(np.stack([doc_ids, named]).astype("<i8"))
        self.counts.append(counts.astype("<i8"))
        self.n_ids += len(ids)
        ids = np.concatenate([self.waiting, ids])
        for at in range(0, len(ids) - BLOCK + 1, BLOCK):
            self._block(ids[at : at + BLOCK])
        self.waiting = ids[len(ids) // BLOCK * BLOCK :]

    def close(self) -> tuple[int, int]:
        """Ends the file; the numbers of documents and of ids in it."""
        if len(self.waiting):
            self._block(self.waiting)
        docs = np.concatenate(self.docs, axis=1) if self.docs else np.empty((2, 0), "<i8")
        counts = np.concatenate(self.counts) if self.counts else np.empty(0, "<i8")
        for array in (np.array(self.offsets, "<i8"), docs[0], docs[1], counts):
            self.stream.write(array.tobytes())
        ends = [self.bits, self.n_ids, len(self.offsets), len(counts), BLOCK, self.vocabulary, self.place]
        self.stream.write(np.array(ends, "<i8").tobytes() + TAIL)
        return len(counts), self.n_ids


class ShardReader:
    """Reads one shard from a random-access file, a block at a time."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail = file.read_at(TRAILER, size - TRAILER)
        if tail[-len(TAIL) :] != TAIL:
            raise ValueError("not a token file")
        self.bits, self.n_ids, n_blocks, n_docs, self.block, self.vocabulary, place = np.frombuffer(tail[: -len(TAIL)], "<i8").tolist()
        longs = np.frombuffer(file.read_at((n_blocks + 3 * n_docs) * 8, place), "<i8")
        self.offsets, rest = longs[:n_blocks], longs[n_blocks:].reshape(3, n_docs)
        self.doc_ids, self.named, self.counts = rest
        self.starts = np.cumsum(self.counts) - self.counts

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids from place first up to last, from the blocks that hold them."""
        if first >= last:
            return np.empty(0, np.uint32)
        parts = []
        for b in range(first // self.block, (last - 1) // self.block + 1):
            n = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack(self.file.read_at((n * self.bits + 7) // 8, int(self.offsets[b])), self.bits, n))
        base = first // self.block * self.block
        return np.concatenate(parts)[first - base : last - base]

    def document(self, number: int) -> np.ndarray:
        """The ids of the shard's document of that number."""
        return self.ids(int(self.starts[number]), int(self.starts[number] + self.counts[number]))


def write(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encodes and writes all documents in ascending order of doc_id; the manifest: shard, path, n_docs, n_ids."""
    folder = new_dir(docs.sparkSession, "tokens")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, path, shard, encoder = None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder, shard = Encoder.of(tokenizer), batch.column("shard")[0].as_py()
                store, at = fs.FileSystem.from_uri(folder)
                store.create_dir(at, recursive=True)
                path = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok"
                writer = ShardWriter(store.open_output_stream(f"{at}/{path}"), encoder.vocabulary)
            column, first = batch.column("doc_id"), 0
            named = column.is_valid().to_numpy(zero_copy_only=False)
            doc_ids = column.fill_null(0).to_numpy()
            for counts, ids in encoder.encode(batch.column("text")):
                here = slice(first, first := first + len(counts))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                writer.add(doc_ids[here], named[here], counts + 1, ids)
        if writer is not None:
            n_docs, n_ids = writer.close()
            writer.stream.close()
            row = {"shard": [shard], "path": [f"{folder}/{path}"], "n_docs": [n_docs], "n_ids": [n_ids]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    by_id = F.col("doc_id").asc_nulls_last()
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(by_id).sortWithinPartitions(by_id, "text")
    dealt = dealt.withColumn("shard", F.spark_partition_id())
    return table(dealt.mapInArrow(work, "shard int, path string, n_docs long, n_ids long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files that the manifest names."""
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("before"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as file:
                    shard = ShardReader(file)
                    ends = shard.starts + shard.counts
                    first = 0
                    while first < len(ends):
                        # documents of about 16 blocks at once, one at least
                        last = max(first + 1, int(np.searchsorted(ends, shard.starts[first] + 16 * BLOCK, side="right")))
                        base = int(shard.starts[first])
                        data = shard.ids(base, int(ends[last - 1])).astype("<u4").tobytes()
                        spans = zip(((shard.starts[first:last] - base) * 4).tolist(), ((ends[first:last] - base) * 4).tolist(), strict=True)
                        crc = [zlib.crc32(data[s:e]) for s, e in spans]
                        ids = pa.array(shard.doc_ids[first:last], mask=shard.named[first:last] == 0)
                        columns = [ids, pa.array(shard.starts[first:last] + before), pa.array(shard.counts[first:last]), pa.array(crc, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])
                        first = last

    # as many partitions as files: the adaptive planner would put rows this few and small into one task
    return files.repartition(max(1, manifest.count()), "shard").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
