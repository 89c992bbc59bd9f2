"""Operator 6: token ids in binary files with bit-plane shuffling.

A file holds ids in blocks of ``BLOCK``. A block's ids are transposed into bit planes
(plane b: bit b of every id, 8 ids to a byte) or byte planes, and every plane is
compressed by zstandard on its own: the high planes of a vocabulary are nearly constant
and the frequent low ids show in the middle ones. Layout, all numbers little-endian:

    b"TIDPLN1\\0" | planes of block 0 | planes of block 1 | ... | documents | index | tail
    index: per block: first id's place in the file (u64), ids (u32), then per plane
           offset (u64) and bytes (u32)
    documents: zstandard of (doc_id i64 array, null flags u8 array, ids per document u64 array)
    tail: blocks, planes, documents, flag "byte planes" (u32 each), offsets of documents
          and index (u64 each), bytes of documents (u64), b"TIDPLN1\\0"

Texts are range-partitioned by doc_id before they are encoded, each task writes files of
about ``FILE_IDS`` ids under a name of its own (written aside, then renamed), and the
table of finished files is kept beside them. A repeated task leaves a file that no table
names, never half a file or a file twice.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_store, use_small_batches
from .libtokens import word_ids

MAGIC = b"TIDPLN1\0"
BLOCK = 1 << 16
FILE_IDS = 1 << 22
TAIL = struct.Struct("<IIIIQQQ8s")


def to_planes(ids: np.ndarray, by_byte: bool) -> list[bytes]:
    """Planes of an array of uint16 or uint32, lowest first."""
    octets = ids.view(np.uint8).reshape(len(ids), -1)
    if by_byte:
        return [p.tobytes() for p in octets.T]
    return [np.packbits(p, bitorder="little").tobytes() for p in np.unpackbits(octets, axis=1, bitorder="little").T]


def from_planes(planes: list[bytes], n: int, by_byte: bool) -> np.ndarray:
    rows = [np.frombuffer(p, np.uint8) for p in planes]
    if not by_byte:
        bits = np.stack([np.unpackbits(r, count=n, bitorder="little") for r in rows], axis=1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    else:
        octets = np.stack(rows, axis=1)
    return np.ascontiguousarray(octets).view(f"<u{octets.shape[1]}").ravel()


def write_file(out, ids: np.ndarray, doc_ids: list, sizes: list[int], by_byte: bool = False, level: int = 3) -> None:
    """Writes ids (uint16 or uint32) of whole documents to a binary stream."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=level).compress
    out.write(MAGIC)
    at, index, planes = len(MAGIC), [], 0
    for i in range(0, len(ids), BLOCK):
        part = ids[i:i + BLOCK]
        parts = [squeeze(p) for p in to_planes(part, by_byte)]
        planes = len(parts)
        index.append(struct.pack("<QI", i, len(part)))
        for p in parts:
            index.append(struct.pack("<QI", at, len(p)))
            out.write(p)
            at += len(p)
    docs = squeeze(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids) + np.array(sizes, "<u8").tobytes())
    table = b"".join(index)
    out.write(docs + table + TAIL.pack(-(-len(ids) // BLOCK), planes, len(doc_ids), by_byte, at, at + len(docs), len(docs), MAGIC))


class TokenFile:
    """Random access to the blocks and documents of one file (a seekable stream)."""

    def __init__(self, stream):
        import zstandard

        self.stream, self.grow = stream, zstandard.ZstdDecompressor().decompress
        end = stream.seek(0, 2)
        blocks, self.planes, n, self.by_byte, docs_at, index_at, docs_len, magic = TAIL.unpack(self._read(end - TAIL.size, TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        entry = 12 * (1 + self.planes)
        table = self._read(index_at, blocks * entry)
        self.index = [[struct.unpack_from("<QI", table, b * entry + 12 * k) for k in range(1 + self.planes)] for b in range(blocks)]
        docs = self.grow(self._read(docs_at, docs_len))
        absent = docs[8 * n:9 * n]
        self.doc_ids = [None if a else d for d, a in zip(np.frombuffer(docs, "<i8", n).tolist(), absent)]
        self.sizes = np.frombuffer(docs, "<u8", n, 9 * n).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def block(self, b: int) -> np.ndarray:
        (_, n), *places = self.index[b]
        return from_planes([self.grow(self._read(at, size)) for at, size in places], n, self.by_byte)

    def documents(self):
        """(doc_id, ids as uint32) one by one; holds the blocks of one document at most."""
        waiting, b = np.zeros(0, "<u4"), 0
        for doc_id, size in zip(self.doc_ids, self.sizes.tolist()):
            parts = [waiting]
            have = len(waiting)
            while have < size:
                parts.append(self.block(b).astype("<u4"))
                have += len(parts[-1])
                b += 1
            whole = np.concatenate(parts) if len(parts) > 1 else waiting
            yield doc_id, whole[:size]
            waiting = whole[size:]


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, by_byte: bool = False) -> DataFrame:
    """Writes every text of ``docs`` and returns the table of files: path, part, seq, docs, ids, start
    (ids in files before it). Ascending by doc_id, nulls first, equal ids by text checksum.
    Null texts count as empty and have the end id alone; repeated rows are written as often
    as they occur; other columns are ignored. ``folder`` must be shared by all workers."""
    spark = docs.sparkSession
    use_small_batches(spark)

    def run(batches):
        from pyspark import TaskContext

        words = word_ids(tokenizer_path)
        narrow = words.library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        kind = "<u2" if narrow else "<u4"
        end = np.array([end_id], kind)
        store, base = open_store(folder)
        part, seq = TaskContext.get().partitionId(), 0
        ids, doc_ids, sizes, held = [], [], [], 0

        def flush():
            name = f"{base}/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(name + ".unfinished") as out:
                write_file(out, np.concatenate(ids), doc_ids, sizes, by_byte)
            store.move(name + ".unfinished", name + ".tid")
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/{name.rpartition('/')[2]}.tid"], "part": pa.array([part], pa.int64()), "seq": pa.array([seq], pa.int64()),
                                               "docs": pa.array([len(doc_ids)], pa.int64()), "ids": pa.array([held], pa.int64())})

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), words.encode([t or "" for t in batch.column(1).to_pylist()])):
                own = np.concatenate([np.frombuffer(raw, "<u4").astype(kind), end])
                ids.append(own), doc_ids.append(doc_id), sizes.append(len(own))
                held += len(own)
                if held >= FILE_IDS:
                    yield flush()
                    ids, doc_ids, sizes, held, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(n, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    files = f"{folder}/files.parquet"
    dealt.mapInArrow(run, "file string, part long, seq long, docs long, ids long").write.parquet(files)
    # one row per file of FILE_IDS ids or per task
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spark.read.parquet(files).withColumn("start", before.cast("long"))


def read_token_files(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files; ``start``
    counts the ids of all documents before it, ``ids`` are little-endian unsigned 32-bit."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = open_store(path)
                rows, held = [], 0
                with store.open_input_file(at) as stream:
                    for doc_id, ids in TokenFile(stream).documents():
                        raw = ids.tobytes()
                        rows.append((doc_id, start, len(ids), zlib.crc32(raw), raw)[:len(names)])
                        start += len(ids)
                        held += len(ids)
                        if held > 1 << 20 or len(rows) >= 4096:
                            yield _batch(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    files = files.select("file", "start")
    n = max(1, min(files.count(), int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return files.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def _batch(rows: list, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 4 else pa.binary()) for k, c in enumerate(cols)], names=names)
