"""Operator 10: removal of repeated byte strings by blockwise suffix sorting with a
difference cover.

A byte goes if it lies in a string of ``min_bytes`` bytes that also starts anywhere
else. Whole suffix arrays would compare hundreds of bytes for every tie; here, as in
difference-cover blockwise sorting, long ties are settled by ranks of a sparse sample
of suffixes that is ordered first:

1. *Cover sample.* Positions whose residue modulo v lies in a difference cover D get a
   rank class by their first ``min_bytes - v + 1`` bytes. For any two positions p, q
   there is a shift d < v that takes both into the sample, and the classes of p + d and
   q + d agree if the strings at p and q do. A suffix without a repeated sample class
   among the next v positions is unique within ``min_bytes`` bytes and is settled.
2. *Suffixes, one bucket at a time.* The suffixes left are named by their first
   ``min_bytes`` bytes, dealt to buckets by the leading bits of the name, and each
   bucket is sorted by itself; equal neighbours are repeats.

Only equality of prefixes matters for removal, so a class is named by a 64-bit
polynomial fingerprint (an odd multiplier modulo 2^64, then mixed) in place of its
lexicographic rank. A suffix has two such names, the second over random numbers for the
bytes and with another multiplier; it is a repeat if both are met again. A suffix that is
none passes both tests by chance with probability (n / 2^64)^2 among n suffixes, so about
n^3 / 2^128 suffixes are wrongly cut: 6e-10 for the 6e9 of 30 GB.

Texts are grouped into chunks of about ``chunk_bytes`` by one shuffle, which all three
passes read. A chunk sends each distinct name once (delta coded in sorted order), so a
passage that a third of all documents share costs one entry per chunk; it gets back one
bit per name. Names of samples only choose the suffixes to be named, so they have 48 bits:
any one of the 6e9 samples of 30 GB is taken for repeated by chance with probability 2e-5,
which sends a few suffixes more and changes no result. Every task holds one chunk or one bucket. Of documents with the same
text one takes part in the search; the others are repeats as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release_memory, text_bytes, use_small_batches

MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd: 2^64 over the golden ratio, and one independent of it
BYTES = np.random.default_rng(181).integers(0, 1 << 64, 256, np.uint64)  # stand for the bytes in second names
SEGMENT = 1 << 20  # bytes fingerprinted at once
NAMES_IN_BUCKET = 1 << 21
SALTS = 32
SAMPLE_BITS = ~np.uint64(0xFFFF)  # the zero planes compress away


def difference_cover(r: int) -> tuple[int, list[int]]:
    """Colbourn and Ling's cover: (v, D) with every difference modulo v in D - D,
    v = 24 r^2 + 36 r + 13 and 6 r + 4 members."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, [0, *np.cumsum(steps).tolist()]


def cover_for(min_bytes: int) -> tuple[int, list[int]]:
    """The largest cover whose period leaves the sample at least half of ``min_bytes``."""
    best = (1, [0])
    r = 0
    while (found := difference_cover(r))[0] <= min_bytes // 2 + 1:
        best, r = found, r + 1
    return best


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        p = np.full(max(n, SEGMENT + (1 << 16)), base, np.uint64)
        p[0] = 1
        _POWERS[base] = np.multiply.accumulate(p)
    return _POWERS[base][:n]


class Prefixes:
    """Fingerprints of any window of one byte array, of the first or second kind."""

    def __init__(self, data: np.ndarray, kind: int = 0):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values = BYTES[data] if kind else data.astype(np.uint64) + np.uint64(1)
        values *= _powers(MULTIPLIERS[kind], len(data))
        np.cumsum(values, out=self.sums[1:])
        self.down = _powers(pow(MULTIPLIERS[kind], -1, 1 << 64), len(data))

    def names(self, at: np.ndarray, width: int) -> np.ndarray:
        h = (self.sums[at + width] - self.sums[at]) * self.down[at]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def segments(texts: list[bytes], width: int):
    """Byte arrays of about SEGMENT bytes: (data, pieces), a piece being (text number,
    offset in it, place in the array, bytes, window starts that belong to it). A longer
    text is cut into pieces that overlap by ``width`` - 1 bytes."""
    parts, pieces, size = [], [], 0
    for k, t in enumerate(texts):
        for off in range(0, max(len(t), 1), SEGMENT):
            body = t[off:off + SEGMENT + width - 1]
            pieces.append((k, off, size, len(body), min(SEGMENT, len(t) - off)))
            parts.append(body)
            size += len(body)
            if size >= SEGMENT:
                yield np.frombuffer(b"".join(parts), np.uint8), pieces
                parts, pieces, size = [], [], 0
    if size:
        yield np.frombuffer(b"".join(parts), np.uint8), pieces


class Chunk:
    """The texts of a chunk and the three passes over them."""

    def __init__(self, texts: list[bytes], min_bytes: int):
        self.texts, self.width = texts, min_bytes
        self.v, cover = cover_for(min_bytes)
        self.cover = np.array(cover, np.int64)
        self.short = min_bytes - self.v + 1

    def sample(self):
        """Per segment (data, pieces, prefixes, end of piece by position, sample positions, their names)."""
        for data, pieces in segments(self.texts, self.width):
            sums = Prefixes(data)
            ends = np.repeat(np.array([at + n for _, _, at, n, _ in pieces], np.int32), [n for *_, n, _ in pieces])
            grid = (np.arange(0, len(data), self.v)[:, None] + self.cover).ravel()
            grid = grid[grid < len(data)]
            grid = grid[grid + self.short <= ends[grid]]
            yield data, pieces, sums, ends, grid, sums.names(grid, self.short) & SAMPLE_BITS

    def suffixes(self, repeated: np.ndarray):
        """Per segment (pieces, positions, names, second names) of the suffixes with a repeated sample class in reach."""
        for data, pieces, sums, ends, grid, names in self.sample():
            hits = grid[among(names, repeated)]
            if not len(hits):
                continue
            starts = np.repeat(np.array([at for _, _, at, _, _ in pieces], np.int32), [n for *_, n, _ in pieces])
            mark = np.zeros(len(data) + 1, np.int32)
            np.add.at(mark, np.maximum(hits - self.v + 1, starts[hits]), 1)
            np.add.at(mark, hits + 1, -1)
            at = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            own = np.repeat(np.array([a + m for _, _, a, _, m in pieces], np.int32), [n for *_, n, _ in pieces])
            at = at[(at + self.width <= ends[at]) & (at < own[at])]
            names = sums.names(at, self.width)
            del sums, grid, mark, own, starts
            yield pieces, at.astype(np.int32), names, Prefixes(data, 1).names(at, self.width)

    def covered(self, found, repeated: np.ndarray, again: np.ndarray) -> list[np.ndarray]:
        """Per text, +1 where a repeated window starts and -1 behind its end, summed: over 0 where a byte goes."""
        marks = [np.zeros(len(t) + 1, np.int32) for t in self.texts]
        for pieces, at, names, second in found:
            at = at[among(names, repeated) & among(second, again)].astype(np.int64)
            cut = np.searchsorted(at, [p[2] for p in pieces] + [pieces[-1][2] + pieces[-1][3]])
            for (k, off, place, _, _), i, j in zip(pieces, cut[:-1].tolist(), cut[1:].tolist()):
                if i < j:
                    p = at[i:j] - place + off  # distinct
                    marks[k][p] += 1
                    marks[k][p + self.width] -= 1
        return [np.cumsum(m[:-1], dtype=np.int32) for m in marks]


def among(names: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which names are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(names), bool)
    return known[np.minimum(np.searchsorted(known, names), len(known) - 1)] == names


def repeats(sorted_names: np.ndarray) -> np.ndarray:
    same = sorted_names[1:] == sorted_names[:-1]
    return np.unique(sorted_names[1:][same])


def by_bucket(names: np.ndarray, buckets: int):
    """(bucket, slice) of sorted distinct names; a bucket is a range of names."""
    of = ((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
    bounds = [0, *cuts.tolist(), len(names)]
    return [(int(of[i]), slice(i, j)) for i, j in zip(bounds[:-1], bounds[1:]) if i < j]


def packed(names: np.ndarray) -> bytes:
    """Sorted names as byte planes of their differences (the high planes are near zero and compress away)."""
    steps = np.diff(names, prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def tidy(fn):
    """``fn`` over one group, leaving nothing in the worker that the next stage would carry."""
    def run(key, docs, notes=None):
        try:
            return fn(key, docs) if notes is None else fn(key, docs, notes)
        finally:
            _POWERS.clear()
            release_memory()

    return (lambda key, notes: run(key, notes)) if fn.__code__.co_argcount == 2 else (lambda key, docs, notes: run(key, docs, notes))


NOTE = "bucket long, pid long, kind int, payload binary"
TWIN, SAMPLE, WINDOW, SECOND = 0, 1, 2, 3  # kinds of notes


def _notes(rows) -> pa.Table:
    cols = list(zip(*rows)) or [[], [], [], []]
    return pa.table({"bucket": pa.array(cols[0], pa.int64()), "pid": pa.array(cols[1], pa.int64()),
                     "kind": pa.array(cols[2], pa.int32()), "payload": pa.array(cols[3], pa.binary())})


def _read(docs: pa.Table, notes: pa.Table):
    """Rows in a fixed order, the texts that take part, and notes by kind and bucket."""
    ids, shas = docs.column("doc_id").to_pylist(), docs.column("sha").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (shas[i], ids[i] is not None, ids[i] or 0))
    told = {(k, b): p for b, k, p in zip(notes.column("bucket").to_pylist(), notes.column("kind").to_pylist(), notes.column("payload").to_pylist())
            if k != TWIN}
    twins = {p.decode() for k, p in zip(notes.column("kind").to_pylist(), notes.column("payload").to_pylist()) if k == TWIN}
    gone = {i for i in order if f"{shas[i]}:{ids[i]}" in twins}
    texts = docs.column("body")
    taking = [i for i in order if i not in gone]
    return taking, [texts[i].as_py() for i in taking], told, twins


def _distinct(sorted_names: np.ndarray) -> np.ndarray:
    return sorted_names[np.concatenate([[True], sorted_names[1:] != sorted_names[:-1]])] if len(sorted_names) else sorted_names


def _tally(arrays) -> tuple[np.ndarray, np.ndarray]:
    """The distinct names, sorted, and those met more than once; arrays are folded one at a time."""
    none = np.zeros(0, np.uint64)
    seen, twice = [none], [none]
    for names in arrays:
        names = np.sort(names)
        twice.append(repeats(names))
        seen.append(_distinct(names))
    both = np.sort(np.concatenate(seen))
    twice.append(repeats(both))
    return _distinct(both), np.unique(np.concatenate(twice))


def _shift(kind: int, buckets: int) -> int:
    """Second names have buckets of their own."""
    return buckets if kind == SECOND else 0


def _answered(tally: tuple[np.ndarray, np.ndarray], told: dict, kind: int, buckets: int) -> np.ndarray:
    """The distinct sorted names that are repeated: in this chunk, or by the bits that came back."""
    names, here = tally
    found = [here]
    for b, part in by_bucket(names, buckets):
        if bits := told.get((kind, b + _shift(kind, buckets))):
            own = names[part]
            found.append(own[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)])
    return np.unique(np.concatenate(found))


def _sent(names: np.ndarray, pid: int, kind: int, buckets: int) -> list:
    """Notes with sorted distinct names."""
    return [(b + _shift(kind, buckets), pid, kind, packed(names[part])) for b, part in by_bucket(names, buckets)]


def _send_samples(min_bytes: int, buckets: int):
    def run(key, docs: pa.Table, notes: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _notes([])
        pid = key[0].as_py()
        _, texts, _, twins = _read(docs, notes)
        names, _ = _tally(x[-1] for x in Chunk(texts, min_bytes).sample())
        return _notes([(-1 - pid, pid, TWIN, t.encode()) for t in sorted(twins)] + _sent(names, pid, SAMPLE, buckets))
    return run


def _send_suffixes(min_bytes: int, buckets: int):
    def run(key, docs: pa.Table, notes: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _notes([])
        pid = key[0].as_py()
        _, texts, told, twins = _read(docs, notes)
        chunk = Chunk(texts, min_bytes)
        repeated = _answered(_tally(x[-1] for x in chunk.sample()), told, SAMPLE, buckets)
        names = ([np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)])
        for _, _, *both in chunk.suffixes(repeated):
            for held, new in zip(names, both):
                held.append(_distinct(np.sort(new)))
        first, second = (np.unique(np.concatenate(held)) for held in names)
        kept = [(-1 - pid, pid, TWIN, t.encode()) for t in sorted(twins)]
        kept += [(-1 - pid, pid, SAMPLE, np.int64(b).tobytes() + p) for (_, b), p in told.items()]  # the third pass needs them
        return _notes(kept + _sent(first, pid, WINDOW, buckets) + _sent(second, pid, SECOND, buckets))
    return run


def _sort_bucket(key, notes):
    """Sorts one bucket's names and tells each chunk which of its names others have too."""
    if key[0].as_py() < 0:  # notes of one chunk on their way to the next pass
        rows = zip(*(notes.column(c).to_pylist() for c in ("bucket", "pid", "kind", "payload")))
        return _notes([(int(np.frombuffer(p[:8], np.int64)[0]), pid, k, p[8:]) if k == SAMPLE else (b, pid, k, p) for b, pid, k, p in rows])
    own = [unpacked(p.as_py()) for p in notes.column("payload")]
    twice = repeats(np.sort(np.concatenate(own)))
    out = []
    for pid, kind, names in zip(notes.column("pid").to_pylist(), notes.column("kind").to_pylist(), own):
        hit = among(names, twice)
        if hit.any():
            out.append((key[0].as_py(), pid, kind, np.packbits(hit).tobytes()))
    return _notes(out)


def _remove(min_bytes: int, buckets: int, names_out: list[str], as_text: bool):
    def run(key, docs: pa.Table, notes: pa.Table) -> pa.Table:
        taking, texts, told, twins = _read(docs, notes)
        keys = [f"{s}:{i}" for s, i in zip(docs.column("sha").to_pylist(), docs.column("doc_id").to_pylist())]
        chunk = Chunk(texts, min_bytes)
        repeated = _answered(_tally(x[-1] for x in chunk.sample()), told, SAMPLE, buckets) if texts else np.zeros(0, np.uint64)
        found = list(chunk.suffixes(repeated))
        windows = _answered(_tally(x[2] for x in found), told, WINDOW, buckets)
        again = _answered(_tally(x[3] for x in found), told, SECOND, buckets)
        marks = dict(zip(taking, chunk.covered(found, windows, again)))
        removed, spans, kept = [], [], []
        for i in range(docs.num_rows):
            body = docs.column("body")[i].as_py()
            if keys[i] in twins or "+" + keys[i] in twins:  # the text has a copy
                removed.append(len(body)), spans.append(1), kept.append(b"")
                continue
            gone = marks[i] > 0
            n = int(gone.sum())
            removed.append(n)
            spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0)
            kept.append(np.frombuffer(body, np.uint8)[~gone].tobytes() if n else body)
        sizes = [r + len(k) for r, k in zip(removed, kept)]
        return pa.table([docs.column("row"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                         pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())], names=names_out)
    return run


def remove_repeats(docs: DataFrame, min_bytes: int = 400, chunk_bytes: int = 4 << 20, as_text: bool = False) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept): one row per row of ``docs``.

    ``row`` is a struct of the input row without its text, ``kept`` the remaining
    bytes of the text (UTF-8; cuts may fall inside a character), or with ``as_text`` the
    remaining text without the characters that a cut has broken. Strings are judged on
    the input. Null texts count as empty; texts shorter than ``min_bytes`` cannot hold
    a repeat and pass unchanged. Repeated rows are copies of each other and both go if
    long enough, also when doc_id is equal or null. An empty table gives an empty
    result; further columns ride along in ``row`` whatever their names.
    """
    use_small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), body.alias("body"), F.col("doc_id").cast("long").alias("doc_id"))
    whole = int(docs.select(F.sum(text_bytes())).first()[0] or 0)
    chunks = max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-whole // chunk_bytes))
    v, cover = cover_for(min_bytes)
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-whole * len(cover) // v // NAMES_IN_BUCKET))

    long = rows.where(F.octet_length("body") >= min_bytes).withColumn("sha", F.sha2("body", 256))
    same = long.groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1").withColumnRenamed("sha", "s")
    pid = F.pmod(F.xxhash64("sha", "doc_id"), F.lit(chunks))
    # a text that very many rows share is spread over SALTS tasks; Spark takes its SALTS rows for one and would broadcast them
    salted = same.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    twins = (long.select("sha", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
             .join(salted.hint("merge"), (F.col("sha") == F.col("s")) & (F.col("salt") == F.col("t")))
             .select(pid.alias("pid"), F.concat_ws(":", "sha", F.coalesce(F.col("doc_id").cast("string"), F.lit("None"))).alias("key"),
                     F.col("doc_id").eqNullSafe(F.col("first")).alias("is_first")))
    # "+": the copy that takes part; it goes as a whole too, but others are matched against it
    told = twins.select(F.lit(-1).cast("long").alias("bucket"), "pid", F.lit(TWIN).alias("kind"),
                        F.concat(F.when(F.col("is_first"), F.lit("+")).otherwise(F.lit("")), "key").cast("binary").alias("payload"))

    keyed = long.withColumn("pid", pid)
    passes = lambda notes, fn, schema: keyed.groupBy("pid").cogroup(notes.groupBy("pid")).applyInArrow(tidy(fn), schema)
    sorted_ = lambda sent: sent.groupBy("bucket").applyInArrow(tidy(_sort_bucket), NOTE)
    samples = sorted_(passes(told, _send_samples(min_bytes, buckets), NOTE))
    windows = sorted_(passes(samples, _send_suffixes(min_bytes, buckets), NOTE))
    out = T.StructType([T.StructField("row", rows.schema["row"].dataType), *T.StructType.fromDDL(f"n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")])
    cut = passes(windows, _remove(min_bytes, buckets, out.names, as_text), out)
    zero = F.lit(0).cast("long")
    short = rows.where(F.octet_length("body") < min_bytes).select("row", F.octet_length("body").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("body").cast(out["kept"].dataType).alias("kept"))
    return cut.union(short)
