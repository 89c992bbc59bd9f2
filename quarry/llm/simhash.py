"""Operator 1: SimHash near-duplicates by anchor-point covering.

A fingerprint is 64 bits. Two fingerprints that differ in at most ``max_bits``
bits differ in at most ``max_bits // 2`` bits in one of their 32-bit halves, so
each half is searched on its own. The anchors of a half are the words of a
covering code: the [31, 26] Hamming code (perfect, covering radius 1) on 31 bits
times the free 32nd bit. For two halves x, y at most t bits apart there is a word
at most ceil(t / 2) from both, and an anchor at most 1 from that word; so sending
each half to every anchor within (covering radius + ceil(t / 2)) makes x and y
meet at an anchor, whatever they are. The syndrome of a half looks up its flip
masks (17 anchors for t = 2), so no search over anchors takes place.

At an anchor, fingerprints are compared over all 64 bits and only a spanning
forest of the links is emitted: never all pairs of a group. Fingerprints are
distinct before they are replicated (a group of exact copies is one row), anchors
with one fingerprint are dropped by a count, and an anchor with more than
``chunk`` fingerprints is cut into chunk pairs which are compared in separate
tasks; every pair of an anchor is compared in some task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, use_small_batches

SEED = 42  # of XXH64
HALF = 32
RADIUS = 1  # covering radius of the Hamming code


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit set, bit 0 first."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        if len(part) < 256:
            total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            by_byte = np.concatenate([np.bincount(part[:, j], minlength=256) for j in range(8)]).reshape(8, 256)
            total += (by_byte @ BITS_OF_BYTE).reshape(64)
    return total


BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int) -> int:
    """The signed 64-bit SimHash of a text's word shingles, 0 without a word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-shingle].tolist()]
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())),
                             np.uint64, len(starts))
    bits = (2 * bit_sums(hashes) > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


SALTS = 64  # places for the rows of one component


def flip_masks(radius: int) -> list[list[int]]:
    """For each syndrome of a 32-bit half, the flips of at most ``radius`` bits that
    lead to a word of the code (bits 0..30 have the parity columns 1..31, bit 31 is free)."""
    from itertools import combinations

    out: list[list[int]] = [[] for _ in range(32)]
    for n in range(radius + 1):
        for places in combinations(range(HALF), n):
            syndrome = mask = 0
            for p in places:
                syndrome ^= (p + 1) % 32
                mask |= 1 << p
            out[syndrome].append(mask)
    return out


def anchors(half, radius: int):
    """Column: the anchors of a 32-bit half (bigint), as an array."""
    syndrome = F.lit(0)
    for j in range(5):
        parity = sum(1 << p for p in range(31) if (p + 1) >> j & 1)
        syndrome = syndrome + F.pmod(F.bit_count(half.bitwiseAND(F.lit(parity).cast("bigint"))), F.lit(2)) * (1 << j)
    table = F.array(*[F.array(*[F.lit(m).cast("bigint") for m in row]) for row in flip_masks(radius)])
    return F.transform(F.element_at(table, (syndrome + 1).cast("int")), lambda m: half.bitwiseXOR(m))


def forest(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Positions (i, j) of a spanning forest of the links among fingerprints."""
    out, rest = [], np.arange(len(values))
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near = np.bitwise_count(values[rest] ^ values[at]) <= max_bits
            if near.any():
                hit = rest[near].tolist()
                out.extend((at, j) for j in hit)
                todo.extend(hit)
                rest = rest[~near]
    return out


def _linked(max_bits: int):
    """mapInArrow over rows (anchor, cell, fp) sorted by cell: links in each cell."""
    def whole(keys: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        bounds = np.concatenate([[0], cuts, [len(values)]])
        size = np.diff(bounds)
        out = []
        for n in (2, 3, 4):  # most cells: all pairs of the same shape at once
            at = bounds[:-1][size == n]
            for i in range(n):
                for j in range(i + 1, n):
                    a, b = values[at + i], values[at + j]
                    near = np.bitwise_count(a ^ b) <= max_bits
                    out.append((a[near], b[near]))
        for k in np.flatnonzero(size > 4).tolist():
            part = values[bounds[k]:bounds[k + 1]]
            if pairs := forest(part, max_bits):
                p = np.array(pairs)
                out.append((part[p[:, 0]], part[p[:, 1]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            k = np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)], axis=1)
            keys = np.concatenate([keys, k])
            values = np.concatenate([values, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(keys):
                continue
            last = len(keys) - int(np.argmax(np.any(keys[::-1] != keys[-1], axis=1))) if np.any(keys != keys[-1]) else 0
            if last:  # the last cell may go on in the next batch
                yield from emit(whole(keys[:last], values[:last]))
                keys, values = keys[last:], values[last:]
        if len(keys):
            yield from emit(whole(keys, values))

    def emit(found):
        a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
        b = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.uint64)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp): one row per row of ``docs``; null and word-free texts get 0."""
    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["doc_id", "text_hash", "fp"])

    use_small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
            .mapInArrow(run, "doc_id long, text_hash long, fp long"))


def fingerprint_links(distinct: DataFrame, max_bits: int = 4, chunk: int = 4096) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp``: a spanning set of all pairs
    at most ``max_bits`` bits apart (every such pair is connected through them)."""
    radius = RADIUS + -(-(max_bits // 2) // 2)
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    high = F.shiftrightunsigned("fp", 32)
    side = F.lit(1 << 32).cast("bigint")  # tells the halves' anchors apart
    sent = distinct.select("fp", F.explode(F.concat(anchors(low, radius), F.transform(anchors(high, radius), lambda a: a + side))).alias("anchor"))
    met = sent.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select(F.col("anchor").alias("k"), "n")
    parts = F.ceil(F.col("n") / chunk).cast("long")
    own = F.pmod(F.xxhash64("fp"), parts)
    # chunk pairs of an anchor: chunk c takes part in the cells (min(c, j), max(c, j)) for every j
    cells = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda j: F.least(own, j) * parts + F.greatest(own, j))
    # "merge": Spark takes the exploded rows to be as small as what they come from and would broadcast them
    dealt = (sent.join(met.hint("merge"), sent.anchor == met.k)
             .select("anchor", F.explode(F.when(F.col("n") <= chunk, F.array(F.lit(0).cast("long"))).otherwise(cells)).alias("cell"), "fp"))
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(n, "anchor", "cell").sortWithinPartitions("anchor", "cell", "fp").mapInArrow(_linked(max_bits), "a long, b long")
    return found.distinct()


def simhash_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, then
    component (a fingerprint that names the group, also where ids repeat) and text_hash.

    Reads the columns ``doc_id`` and ``text`` and ignores others. component_id is the smallest
    doc_id among the documents reachable over links of at most ``max_bits``
    differing bits (itself included). Null or word-free texts have fingerprint 0
    and link like any other. Repeated rows stay rows of their own. A null doc_id
    keeps its row; component_id ignores null ids and is null where a component
    has no other. An empty table gives an empty result.
    """
    marked = checkpointed(fingerprints(docs, shingle))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(fingerprint_links(distinct.select("fp"), max_bits))
    named = checkpointed(distinct.join(roots, distinct.fp == roots.node, "left").select(F.col("fp").alias("key"), "low", "root"))
    alone = named.where("root is null").select("key", F.col("key").alias("component"), F.col("low").alias("component_id"))
    linked = named.where("root is not null")
    # a component may hold very many fingerprints: its answer goes to SALTS places, never by a broadcast
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id")).select(F.col("root").alias("component"), "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("place"))
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS))
    linked = linked.join(lows.hint("merge"), (F.col("root") == F.col("component")) & (salt == F.col("place"))).select("key", "component", "component_id")
    known = alone.union(linked)
    return (marked.join(known, marked.fp == known.key)
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component", "text_hash"))
