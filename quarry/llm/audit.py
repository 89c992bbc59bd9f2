"""Operator 12: interaction audit of five filters by contraction of contingency tensors.

Each document fails or passes each of five filters; per part (``source``) the documents
fill a 2x2x2x2x2 table of counts (axis x: filter x, index 1: fails), beside it one for
documents labelled good and one for toxic ones. Whatever an order of filters does at a
step is then a contraction of that table: along each axis ``pass``, ``fail`` or ``all`` is
selected, by one einsum for all parts of a batch and all 600 (order, step) pairs. Texts are
read once; tables of 32 cells travel.

Filters (words: maximal runs of anything but space and tab to carriage return):
A under 50 words, B 100 * distinct words < 65 * words, C 100 * [A-Z] > 5 * code points,
D holds one of ``#$%&*|``, E the same text as a row with a smaller doc_id anywhere in the
table. Equality of texts is equality of their sha256 digests.

Null texts count as empty (they fail A, and E if another empty text has a smaller id).
Null parts count as the empty string. Rows that share id and text are not copies of each
other; a row without an id has no smaller and is no smaller one, so it passes E. Labels
repeated for an id: one with quality = 1 (toxic = 1) is enough. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .spans import let

FILTERS = "ABCDE"
SPACE = "[\\x20\\x09-\\x0D]+"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def own_failures(text: Column) -> dict[str, Column]:
    """The conditions that a text settles by itself."""
    words = F.array_remove(F.split(text, SPACE), "")
    sizes = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d")))
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"sizes": sizes, "A": F.col("sizes.n") < 50, "B": F.col("sizes.d") * 100 < F.col("sizes.n") * 65,
            "C": upper.cast("long") * 100 > F.length(text).cast("long") * 5, "D": text.rlike("[#$%&*|]")}


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cell, n, good, toxic): counts per part and cell; bit x of a cell: filter x fails."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    tests = own_failures(F.col("text"))
    rows = rows.select("*", tests.pop("sizes").alias("sizes"))
    bits = sum((F.when(c, 1 << FILTERS.index(name)).otherwise(0) for name, c in tests.items()), F.lit(0))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), bits.alias("cell"))
    rows = checkpointed(rows.groupBy("doc_id", "digest", "part", "cell").agg(F.count("*").alias("n")))
    # a digest is joined together with the id, so copies are spread by their ids
    least = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least"))
    rows = rows.alias("r").join(least.alias("m"), (F.col("r.digest") == F.col("m.digest")) & (F.col("r.doc_id") == F.col("m.least")), "left")
    copy = F.col("m.least").isNull() & F.col("r.doc_id").isNotNull()
    rows = rows.select("r.doc_id", "r.part", "r.n", (F.col("r.cell") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("cell"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(marks, "doc_id", "left")
    return rows.groupBy("part", "cell").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])


def _choices(of) -> list[np.ndarray]:
    """Per axis the (order, step) x 2 selections that ``of`` names for a filter: its own
    place in the order against the step."""
    rows = [[of(order.index(f), step) for f in FILTERS] for order in ORDERS for step in range(len(FILTERS))]
    return list(np.array(rows, np.int64).transpose(1, 0, 2))


def contract(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of all (order, step) pairs, (parts, 600), from tensors (parts, 2, 2, 2, 2, 2)."""
    def through(tensor, of):
        return np.einsum("pabcde,sa,sb,sc,sd,se->ps", tensor, *_choices(of), optimize=True)

    taken = lambda place, step: PASS if place < step else FAIL if place == step else ALL
    removed = through(n, taken)
    mine = np.array([FILTERS.index(order[step]) for order in ORDERS for step in range(len(FILTERS))])
    credit = removed @ (mine[:, None] == np.arange(len(FILTERS)))  # over all orders, per filter
    return {
        "kept": through(n, lambda place, step: PASS if place <= step else ALL),
        "removed": removed,
        "redundant": through(n, lambda place, step: FAIL if place == step else ALL) - removed,
        "unique_fails": through(n, lambda place, step: FAIL if place == step else PASS),
        "good_lost": through(good, taken),
        "toxic_lost": through(toxic, taken),
        "shapley": credit[:, mine],
    }


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: counts of documents, see SCHEMA."""
    names = pa.array(np.repeat(ORDERS, len(FILTERS)))
    steps = pa.array(np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS)), pa.int32())

    def tables(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                some = batch.slice(k, 64)
                full = np.zeros((3, some.num_rows, 2 ** len(FILTERS)), np.int64)
                for i, found in enumerate(some.column(1).to_pylist()):  # 32 cells at most
                    for c in found:
                        full[:, i, c["cell"]] = c["n"], c["good"], c["toxic"]
                # the highest bit is the first axis of a reshape: axes are turned to A, B, C, D, E
                shape = (some.num_rows, *[2] * len(FILTERS))
                out = contract(*[t.reshape(shape).transpose(0, *range(len(FILTERS), 0, -1)) for t in full])
                for i, part in enumerate(some.column(0).to_pylist()):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(names), pa.string()), names, steps, *[pa.array(out[c][i], pa.int64()) for c in COUNTS]],
                        names=["part", "filter_order", "step", *COUNTS])

    per_part = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("cell", "n", "good", "toxic")).alias("cells"))
    return per_part.mapInArrow(tables, SCHEMA)


def oracle() -> str:
    """The same table in DuckDB SQL, document by document and order by order."""
    place = lambda f: f"strpos(filter_order, '{f}')"
    fails = {f: f"list_contains(fails, '{f}')" for f in FILTERS}
    first = "coalesce(" + "least(" + ", ".join(f"case when {c} then {place(f)} end" for f, c in fails.items()) + "), 9)"
    return f"""
with words as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
tests as (
  select doc_id, part,
    [case when len(w) < 50 then 'A' end, case when 100 * len(list_distinct(w)) < 65 * len(w) then 'B' end,
     case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) then 'C' end,
     case when regexp_matches(text, '[#$%&*|]') then 'D' end,
     case when doc_id > min(doc_id) over (partition by text) then 'E' end] as marks
  from words),
marks as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
each as (
  select part, list_filter(marks, lambda x: x is not null) as fails, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
  from tests left join marks using (doc_id)),
kinds as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from each group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
run as (select part, filter_order, fails, n, good, toxic, {first} as gone from kinds, orders),
steps as (
  select part, filter_order, step, substr(filter_order, step, 1) as f,
    sum(case when gone > step then n else 0 end) as kept,
    sum(case when gone = step then n else 0 end) as removed,
    sum(case when gone < step and list_contains(fails, substr(filter_order, step, 1)) then n else 0 end) as redundant,
    sum(case when fails = [substr(filter_order, step, 1)] then n else 0 end) as unique_fails,
    sum(case when gone = step then good else 0 end) as good_lost,
    sum(case when gone = step then toxic else 0 end) as toxic_lost
  from run, (select unnest([1, 2, 3, 4, 5]) as step) group by all)
select part, filter_order, cast(step as integer) as step, {", ".join(f"cast({c} as bigint) as {c}" for c in COUNTS[:-1])},
  cast(sum(removed) over (partition by part, f) as bigint) as shapley
from steps"""
