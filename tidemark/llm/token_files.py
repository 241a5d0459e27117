"""Token ids in binary files of fixed-width bits.

Every id takes the least number of bits that the vocabulary needs. Documents follow one another in
ascending doc_id; a file holds whole documents, about ``FILE_IDS`` ids, and is complete in itself:

    header       magic, bits, ids per block, documents, ids, shard, part, number of blocks
    documents    doc_id of each (and whether it is null), and where its ids begin in the file
    blocks       where each block begins in the file
    payload      blocks of ``BLOCK`` ids, each packed from its first bit, lowest bit first
    one newline  written by the sink behind every record

Blocks begin at known places, so any range of ids is read from the blocks that hold it (``TokenFile``
takes bytes or a memory map), and numpy packs and unpacks eight lanes of a block at a time.

Files are written by Spark's text sink, one record a file: it takes any bytes, works on any file
system that Spark knows, and commits a task's files once, so a lost or repeated task leaves no
half-written ones. Shard and part numbers in the headers give the order of the files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.workdir import shared_folder

from .common import documents, slices, staged
from .encoder import Encoder

MAGIC = b"TMTOKENS"
HEADER = struct.Struct("<8sIIQQIIQ")
BLOCK = 1 << 14
FILE_IDS = 1 << 24
END = 2


def bits_for(vocabulary: int) -> int:
    """The least width that holds every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits, id i in the bits from i * bits on, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    groups = -(-len(ids) // 8)
    lanes = np.zeros((groups, 8), np.uint64)
    lanes.ravel()[: len(ids)] = ids
    out = np.zeros((groups, bits + 8), np.uint8)  # eight ids take ``bits`` bytes; the rest stays zero
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = lanes[:, lane] << np.uint64(shift)
        for k in range((shift + bits + 7) // 8):
            out[:, byte + k] |= ((value >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
    return out[:, :bits].tobytes()[: (len(ids) * bits + 7) // 8]


def unpack_bits(data: bytes | memoryview | np.ndarray, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of ``pack_bits``."""
    raw = np.frombuffer(data, np.uint8)
    if bits in (8, 16, 32):
        return raw[: n * bits // 8].view(f"<u{bits // 8}").astype(np.uint32)
    groups = -(-n // 8)
    padded = np.zeros((groups, bits), np.uint8)
    padded.ravel()[: (n * bits + 7) // 8] = raw[: (n * bits + 7) // 8]
    out = np.empty((groups, 8), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = np.zeros(groups, np.uint64)
        for k in range((shift + bits + 7) // 8):
            value |= padded[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = (value >> np.uint64(shift)) & mask
    return out.ravel()[:n]


class FileBuilder:
    """One file in the making: whole documents, their ids packed block by block as they come."""

    def __init__(self, bits: int, shard: int, part: int, block: int = BLOCK):
        self.bits, self.shard, self.part, self.block = bits, shard, part, block
        self.names: list[int | None] = []
        self.ends: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.blocks: list[bytes] = []
        self.open, self.n_ids = np.zeros(0, np.uint32), 0

    def add(self, names: Sequence[int | None], ends: np.ndarray, ids: np.ndarray) -> None:
        """Documents with these ids; ``ends`` counts from the first of them."""
        self.names += names
        self.ends.append(ends + self.n_ids)
        self.n_ids += len(ids)
        ids = np.concatenate([self.open, ids])
        full = len(ids) - len(ids) % self.block
        self.blocks += [pack_bits(ids[i : i + self.block], self.bits) for i in range(0, full, self.block)]
        self.open = ids[full:].copy()

    def bytes(self) -> bytes:
        blocks = [*self.blocks, pack_bits(self.open, self.bits)] if len(self.open) else self.blocks
        n = len(self.names)
        known = np.array([d is not None for d in self.names], np.uint8).tobytes()
        names = np.array([0 if d is None else d for d in self.names], "<i8").tobytes()
        front = HEADER.size + 8 * n + n + 8 * (n + 1) + 8 * (len(blocks) + 1)
        places = front + np.append(0, np.cumsum([len(b) for b in blocks], dtype=np.int64))
        head = HEADER.pack(MAGIC, self.bits, self.block, n, self.n_ids, self.shard, self.part, len(blocks))
        return b"".join([head, names, known, np.concatenate(self.ends).astype("<u8").tobytes(), places.astype("<u8").tobytes(), *blocks])


@dataclass
class TokenFile:
    """A token file in memory or mapped: ``TokenFile(np.memmap(path, np.uint8))``."""

    data: bytes | memoryview | np.ndarray

    def __post_init__(self) -> None:
        self.raw = np.frombuffer(self.data, np.uint8)
        magic, self.bits, self.block, n, self.n_ids, self.shard, self.part, blocks = HEADER.unpack(self.raw[: HEADER.size].tobytes())
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEADER.size
        names, at = self._numbers(at, n, "<i8")
        known, at = self.raw[at : at + n], at + n
        self.doc_ids = [int(d) if k else None for d, k in zip(names, known, strict=True)]
        self.begins, at = self._numbers(at, n + 1, "<u8")
        self.places, at = self._numbers(at, blocks + 1, "<u8")

    def _numbers(self, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
        return np.frombuffer(self.raw[at : at + 8 * n].tobytes(), kind).astype(np.int64), at + 8 * n

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, from the blocks that hold them."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        parts = [unpack_bits(self.raw[self.places[b] : self.places[b + 1]], min(self.block, self.n_ids - b * self.block), self.bits) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.begins[i]), int(self.begins[i + 1]))


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int = END, file_ids: int = FILE_IDS, block: int = BLOCK) -> None:
    """Write every document's ids, then ``end``, to token files under ``path``, in ascending doc_id.

    Documents are dealt by ranges of (doc_id, hash of the text) and a number that spreads equal rows, so
    many rows with one id do not meet in one task, and sorted in each task; a task encodes about 3 MB of text at a
    time. Documents with one id follow one another in the order of their texts' hashes, those
    without id come last; an empty or null text has the end id alone. A text longer than a file
    makes that file longer. An empty table gives no documents. Other columns are ignored.
    """
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 10))
    rows = documents(docs).withColumn("_spread", spread).repartitionByRange("_doc", "_text", "_spread").sortWithinPartitions("_doc", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        bits, shard = bits_for(max(encoder.size, end + 1)), TaskContext.get().partitionId()
        file = FileBuilder(bits, shard, 0, block)
        for batch in batches:
            for a, b in slices(((t.as_py() or 0) for t in pc.binary_length(batch["text"])), 3 << 20):
                piece = batch.slice(a, b - a)
                ids, ends = encoder.encode_flat(piece["text"], end)
                own, done = piece["doc_id"].to_pylist(), 0
                while done < len(own):
                    base = int(ends[done - 1]) if done else 0
                    stop = max(done + 1, int(np.searchsorted(ends, base + file_ids - file.n_ids, side="right")))
                    file.add(own[done:stop], ends[done:stop] - base, ids[base : int(ends[stop - 1])])
                    done = stop
                    if file.n_ids >= file_ids or done < len(own):
                        yield pa.RecordBatch.from_arrays([pa.array([file.bytes()], pa.binary())], names=["value"])
                        file = FileBuilder(bits, shard, file.part + 1, block)
        if file.names:
            yield pa.RecordBatch.from_arrays([pa.array([file.bytes()], pa.binary())], names=["value"])

    files = rows.select("doc_id", "text").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _open(content: pa.Array) -> Iterator[TokenFile]:
    for one in content:
        data = one.as_buffer()
        if data is not None and data.size:
            yield TokenFile(memoryview(data))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of the token files under ``path``: doc_id, start, n_tokens, ids_crc32, and the ids on demand.

    ``start`` is the number of ids of all documents before. A file is one row of the reader; it is
    unpacked in pieces of 10,000 documents. The driver sees one number per shard (task of the writer).
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    fields = "shard int, part int, place long, doc_id long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in _open(batch["content"]):
                for a in range(0, len(f.doc_ids), 10_000):
                    b = min(len(f.doc_ids), a + 10_000)
                    base = int(f.begins[a])
                    ids = f.ids(base, int(f.begins[b])).astype("<u4", copy=False)
                    raw, edges = memoryview(ids).cast("B"), (f.begins[a : b + 1] - base).tolist()
                    crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(edges, edges[1:], strict=False)]
                    columns = [pa.array([f.shard] * (b - a), pa.int32()), pa.array([f.part] * (b - a), pa.int32()), pa.array(f.begins[a:b], pa.int64()),
                               pa.array(f.doc_ids[a:b], pa.int64()), pa.array(np.diff(f.begins[a : b + 1]), pa.int64()), pa.array(crc, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.view(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in fields.split(", ")])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(f.shard, f.part, f.n_ids) for f in _open(batch["content"])]
            yield pa.RecordBatch.from_pylist([{"shard": s, "part": p, "n": n} for s, p, n in found],
                                             schema=pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("n", pa.int64())]))

    rows = files.mapInArrow(run, fields)
    if with_ids:
        counts = staged(files.mapInArrow(sizes, "shard int, part int, n long"))
    else:
        rows = staged(rows)
        counts = rows.groupBy("shard", "part").agg(F.sum("n_tokens").alias("n"))
    starts, total = [], 0
    for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect():
        starts.append((r["shard"], total))
        total += r["n"]
    earlier = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shards = spark.createDataFrame(starts, "shard int, base long")
    places = counts.join(shards, "shard").select("shard", "part", (F.col("base") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("before"))
    out = rows.join(places, ["shard", "part"])
    return out.select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read their documents back, without the ids."""
    path = f"{shared_folder(docs.sparkSession)}/tokens"
    write_tokens(docs, tokenizer, path, end)
    return read_tokens(docs.sparkSession, path, with_ids=False)
