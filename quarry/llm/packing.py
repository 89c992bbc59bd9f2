"""Operator 5: packing documents into sequences by best fit and swap-based local search.

Pieces are dealt to groups of about ``GROUP`` pieces. A group is packed best fit,
longest first; then its underfull bins improve each other: the fullest takes documents
from emptier ones by a move, a one-for-one or a two-for-one exchange, whichever fills it
most, which always raises the sum of squared fills, until bins run empty and no exchange
helps. Pieces of bins that stay underfull go on to a next round of fewer groups, so that
what is left over of all groups meets, while that saves groups. A group's size is fixed,
whatever the corpus.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, use_small_batches
from .libtokens import word_ids

GROUP = 40_000
MAX_PASSES = 20
SHRINK = 0.8  # a further round takes place if its groups are at most this part of the last round's


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of positions; longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}
    mask = 0  # bit r: some bin has r tokens of room
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[i]
        if fits := mask >> size:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        if left := r - size:
            room.setdefault(left, []).append(b)
            mask |= 1 << left
    return bins


class Pool:
    """Documents of the emptier bins by length."""

    def __init__(self):
        self.of: dict[int, list[tuple[int, int]]] = {}
        self.mask = 0

    def add(self, size: int, doc: int, owner: int) -> None:
        self.of.setdefault(size, []).append((doc, owner))
        self.mask |= 1 << size

    def drop(self, size: int, doc: int, owner: int) -> None:
        self.of[size].remove((doc, owner))
        if not self.of[size]:
            self.mask ^= 1 << size

    def longest(self, limit: int) -> int:
        """The longest length up to ``limit``, 0 if there is none."""
        return max((self.mask & (1 << limit + 1) - 1).bit_length() - 1, 0) if limit > 0 else 0


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search among underfull bins; returns the bins that are not empty."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    for _ in range(MAX_PASSES):
        pool = Pool()
        heap = [(-fill[b], b) for b in range(len(bins)) if 0 < fill[b] < capacity]
        heapq.heapify(heap)
        for _, b in heap:
            for i in bins[b]:
                pool.add(lengths[i], i, b)
        done, changed = set(), False
        while heap:
            f, taker = heapq.heappop(heap)
            if taker in done or -f != fill[taker] or not bins[taker]:
                continue  # an entry from before its bin changed
            done.add(taker)
            for i in bins[taker]:
                pool.drop(lengths[i], i, taker)
            while (gap := capacity - fill[taker]) and (step := _best(bins[taker], gap, lengths, pool, fill, capacity)):
                out, come, home = step
                owners = {o for _, o in come}
                before = sum(fill[o] ** 2 for o in {taker, *owners})
                for j, owner in come:
                    _shift(j, owner, taker, bins, fill, lengths)
                if out is not None:
                    _shift(out, taker, home, bins, fill, lengths)
                if sum(fill[o] ** 2 for o in {taker, *owners}) <= before:  # a fuller giver: take it back
                    if out is not None:
                        _shift(out, home, taker, bins, fill, lengths)
                    for j, owner in come:
                        _shift(j, taker, owner, bins, fill, lengths)
                    break
                for j, owner in come:
                    pool.drop(lengths[j], j, owner)
                if out is not None:
                    pool.add(lengths[out], out, home)
                for o in owners:
                    heapq.heappush(heap, (-fill[o], o))
                changed = True
        if not changed:
            break
    return [b for b in bins if b]


def _shift(doc: int, old: int, new: int, bins: list[list[int]], fill: list[int], lengths: list[int]) -> None:
    bins[old].remove(doc)
    bins[new].append(doc)
    fill[old] -= lengths[doc]
    fill[new] += lengths[doc]


def _best(own: list[int], gap: int, lengths: list[int], pool: Pool, fill: list[int], capacity: int):
    """(document to give or None, documents to take as (document, giver), giver that gets the
    document) that fills a bin most; None if nothing does."""
    best, gain = None, 0
    if (size := pool.longest(gap)) > gain:
        best, gain = (None, [pool.of[size][-1]], None), size
    seen = set()
    for x in own:
        a = lengths[x]
        if gain == gap or a in seen:
            continue
        seen.add(a)
        if (size := pool.longest(a + gap)) - a > gain:
            best, gain = (x, [pool.of[size][-1]], pool.of[size][-1][1]), size - a
        rest = pool.mask & (1 << a + gap) - 1
        while rest and gain < gap:  # the longer one of two, from the longest down to half
            y = rest.bit_length() - 1
            if 2 * y <= a + gain:
                break
            rest ^= 1 << y
            z = pool.longest(min(y, a + gap - y))
            if z and y + z - a > gain:
                two = [pool.of[y][-1], pool.of[z][-1]] if y != z else pool.of[y][-2:]
                home = [o for _, o in two if fill[o] - sum(lengths[j] for j, w in two if w == o) + a <= capacity]
                if len(two) == 2 and home:
                    best, gain = (x, two, home[0]), y + z - a
    return best


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    return improve(best_fit(lengths, capacity), lengths, capacity)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the token pieces of every row."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words = word_ids(tokenizer_path)
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            row = []
            for k, ids in enumerate(words.encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                n = len(ids) // 4
                at, stop = 0, n % capacity or capacity  # the first piece is the shorter one
                if n <= capacity:
                    stop = n
                piece = 0
                while at < n:
                    part = ids[4 * at:4 * stop]
                    for c, v in zip(cols[1:], (piece, at, stop - at, zlib.crc32(part), part)):
                        c.append(v)
                    row.append(k)
                    piece, at, stop = piece + 1, stop, stop + capacity
            out = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:5]]]
            yield pa.RecordBatch.from_arrays([*out, *[pa.array(c, pa.binary()) for c in cols[5:]]], names=names)

    use_small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def _pack_group(capacity: int):
    def run(key, rows):
        lengths = rows.column("length").to_pylist()
        uid = rows.column("uid").to_pylist()
        order = sorted(range(len(uid)), key=uid.__getitem__)  # a fixed order, whatever the shuffle's
        size = [lengths[i] for i in order]
        slot, offset, full = [0] * len(uid), [0] * len(uid), [False] * len(uid)
        for b, members in enumerate(pack(size, capacity)):
            at = 0
            whole = sum(size[i] for i in members) == capacity
            for i in members:
                slot[order[i]], offset[order[i]], full[order[i]] = b, at, whole
                at += size[i]
        return pa.table([rows.column("uid"), pa.array(lengths, pa.int64()), pa.array(slot, pa.int64()), pa.array(offset, pa.int64()), pa.array(full, pa.bool_()),
                         rows.column("grp")], names=["uid", "length", "slot", "offset", "full", "grp"])
    return run


def pack_pieces(table: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """``table`` (a column ``length`` from 1 to ``capacity``, others ride along) with
    ``sequence_id`` and ``offset``. Reads ``table`` once and checkpoints it with row numbers."""
    clash = [c for c in ("uid", "sequence_id", "offset") if c in table.columns]
    if clash:
        raise ValueError(f"columns in the way: {clash}")
    named = checkpointed(table.withColumn("uid", F.monotonically_increasing_id()))
    whole = named.where(F.col("length") == capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = named.where(F.col("length") < capacity).select("uid", "length")
    places, turn = whole, 0
    groups = max(1, -(-left.count() // group))
    while True:
        done = checkpointed(left.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(groups)))
                            .groupBy("grp").applyInArrow(_pack_group(capacity), "uid long, length long, slot long, offset long, full boolean, grp long"))
        turn += 1
        fewer = -(-done.where("not full").count() // group)
        last = groups == 1 or fewer > SHRINK * groups
        # the sign keeps these numbers apart from the row numbers of whole pieces
        number = -((F.lit(turn).cast("long") * (1 << 55)) + F.col("grp") * (1 << 17) + F.col("slot")) - 1
        places = places.union((done if last else done.where("full")).select("uid", number.alias("sequence_id"), "offset"))
        if last:
            break
        left, groups = done.where("not full").select("uid", "length"), max(1, fewer)
    places = places.withColumnRenamed("uid", "u")
    return named.join(places, named.uid == places.u).drop("uid", "u")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its ids and ``end_id``; null texts count as empty and have one piece
    of one id. Only documents longer than ``capacity`` are cut; their first piece is the
    shorter one. Repeated rows and null ids are packed like any other row, ties are
    settled by row number, other columns are ignored, an empty table gives no rows.
    """
    return pack_pieces(pieces(docs, tokenizer_path, capacity, end_id, with_ids), capacity)
