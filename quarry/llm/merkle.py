"""Operator 13: Merkle dataset manifest with pointer-jumping proofs.

A row is a leaf, H = sha256 (lower-case hex; the input of a node is the hex text of its
children). Per part (``source``) the leaves ascend by key; every three consecutive nodes
of a level make their parent, the last run may hold fewer, until one node, the subroot,
is left. Subroots in order of their part (null first, bytewise) make the root likewise.

*Numbering.* Digests, never texts, are range-partitioned by (part, key, leaf) and sorted;
a row's place in its part is its place in its block plus the sizes of the part's earlier
blocks. A part with a third of all rows is spread over as many blocks as its share.

*Building.* Each round groups ``3 ** hop`` neighbours (a bounded array) and works out
``hop`` levels; only block tops go into the next round.

*Proofs.* A node is named (tree, level, place); tree -1 is the one above the subroots and
a subroot is its level 0. Every leaf and every block top holds the segment of siblings on
its way to the ancestor at most ``hop`` levels up. Block tops join themselves by that
ancestor: segments are concatenated and the distance doubles, until all reach the root; in
the end each leaf is joined with its block top. At distance d a key has at most 3^d rows, and
what stands that high is that much smaller; AQE broadcasts or splits what is left.

Rows that are the same in part, key and leaf are leaves of their own, side by side; rows
with one key and different contents follow by their leaf digest. Null keys come first. A
null field counts as ``-``, an empty one as ``0:``. An empty table has no rows, no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3  # children of a node
HOP = 4  # levels worked out in one grouping: 81 nodes at most
TOP = -1  # the tree above the subroots


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 (binary) of the fields: ``-`` for null, else UTF-8 length, ``:``, value."""
    def part(c):
        s = c.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return F.unhex(F.sha2(F.concat(*map(part, fields)).cast("binary"), 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def fold(leaf: Column, proof: Column) -> Column:
    """The root (hex) that a leaf (binary) and its proof lead to."""
    return F.aggregate(proof, hexed(leaf), lambda acc, s: F.sha2(F.concat(hexed(s["l"]), acc, hexed(s["r"])).cast("binary"), 256))


def siblings_digest(proof: Column) -> Column:
    """H (hex) of all siblings of a proof from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: hexed(F.concat(s["l"], s["r"]))), "").cast("binary"), 256)


def _joined(digests: Column) -> Column:
    """Bytes of an array of digests."""
    return F.aggregate(digests, F.lit(b""), lambda a, d: F.concat(a, d))


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.size(F.filter(F.array(*[F.lit(FAN ** k) for k in range(40)]), lambda t: t < n))


def _numbered(rows: DataFrame) -> DataFrame:
    """(tree, height, idx, key, leaf, payload): the place of every row in its part and of the part among the parts."""
    order = ["part", "key", "leaf", "uid"]
    ordered = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                           .withColumn("pid", F.spark_partition_id()).withColumn("mid", F.monotonically_increasing_id()).drop("uid"))
    blocks = ordered.groupBy("pid", "part").agg(F.count("*").alias("n"), F.min("mid").alias("first"))
    own = Window.partitionBy("part")  # a part has at most one row per range partition
    blocks = checkpointed(blocks.select("pid", "part", "first", (F.sum("n").over(own.orderBy("pid")) - F.col("n")).alias("before"), F.sum("n").over(own).alias("size")))
    starts = blocks.where("before = 0").select("pid", "part", F.row_number().over(Window.partitionBy("pid").orderBy("part")).alias("k"))
    sums = starts.groupBy("pid").agg(F.count("*").alias("n"))  # one row per range partition
    sums = sums.select("pid", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("pid")) - F.col("n")).alias("earlier"))
    trees = starts.join(sums, "pid").select("part", (F.col("earlier") + F.col("k") - 1).alias("tree"))
    blocks = blocks.alias("b").join(trees.alias("t"), F.col("b.part").eqNullSafe(F.col("t.part"))).select("b.*", "t.tree")
    rest = [F.col(f"o.{c}") for c in ordered.columns if c not in ("part", "pid", "mid")]
    same = (F.col("o.pid") == F.col("b.pid")) & F.col("o.part").eqNullSafe(F.col("b.part"))
    return ordered.alias("o").join(blocks.alias("b"), same).select(
        F.col("b.tree").cast("long").alias("tree"), _height(F.col("b.size")).alias("height"), (F.col("o.mid") - F.col("b.first") + F.col("b.before")).alias("idx"), *rest)


def _parents(digests: Column) -> Column:
    """The next level over an array of consecutive digests."""
    starts = F.sequence(F.lit(1), F.size(digests), F.lit(FAN))
    return F.transform(starts, lambda i: F.unhex(F.sha2(hexed(_joined(F.slice(digests, i, F.lit(FAN)))).cast("binary"), 256)))


def _round(nodes: DataFrame, base: int, hop: int) -> DataFrame:
    """Groups of neighbours with their next levels: l0 are the nodes of level ``base``,
    ``t`` is the level (from l0) that leads out of the group, ``top`` its one digest."""
    own = [c for c in nodes.columns if c not in ("tree", "height", "idx")]  # first of them: the digest
    groups = nodes.groupBy("tree", "height", F.expr(f"idx div {FAN ** hop}").alias("grp")).agg(F.sort_array(F.collect_list(F.struct("idx", *own))).alias("kids"))
    groups = groups.withColumn("t", F.least(F.lit(hop), F.col("height") - base)).withColumn("l0", F.transform("kids", lambda k: k[own[0]]))
    for j in range(hop):
        # above the tree's own height there is nothing
        groups = groups.withColumn(f"l{j + 1}", F.when(F.col("t") > j, _parents(F.col(f"l{j}"))).otherwise(F.array().cast("array<binary>")))
    top = F.element_at(F.array(*[F.col(f"l{j}") for j in range(hop + 1)]), F.col("t") + 1)[0]
    return checkpointed(groups.withColumn("top", top).withColumn("base", F.lit(base)))


def _held(groups: DataFrame, hop: int) -> DataFrame:
    """The nodes of the groups' lowest level, each with its segment to the group's top."""
    i, levels = F.col("i"), []
    for j in range(hop):
        at = F.expr(f"cast(i div {FAN ** j} as int)")
        left = F.slice(F.col(f"l{j}"), at - at % FAN + 1, at % FAN)
        right = F.slice(F.col(f"l{j}"), at + 2, F.lit(FAN - 1) - at % FAN)
        levels.append(F.struct(_joined(left).alias("l"), _joined(right).alias("r")))
    rows = groups.select("*", F.posexplode("kids").alias("i", "kid"))
    done = F.col("base") + F.col("t") == F.col("height")
    sub = done & (F.col("tree") != TOP)
    return rows.select(
        "tree", F.col("base").alias("level"), F.col("kid.idx").alias("place"), "kid",
        F.slice(F.array(*levels), F.lit(1), F.col("t")).alias("seg"),
        F.when(sub, TOP).otherwise(F.col("tree")).cast("long").alias("a_tree"), F.when(sub, 0).otherwise(F.col("base") + F.col("t")).cast("int").alias("a_level"),
        F.when(sub, F.col("tree")).otherwise(F.col("grp")).cast("long").alias("a_place"))


def _build(nodes: DataFrame, height: int, hop: int) -> tuple[list[DataFrame], DataFrame]:
    """The groups of all rounds, and (tree, digest) of the trees' roots."""
    rounds, roots, base = [], None, 0
    while True:
        groups = _round(nodes, base, hop)
        rounds.append(groups)
        ready = groups.where(F.col("base") + F.col("t") == F.col("height")).select("tree", F.col("top").alias("digest"))
        roots = ready if roots is None else roots.union(ready)
        if height <= base + hop:
            return rounds, roots
        nodes = groups.where(F.col("base") + F.col("t") < F.col("height")).select("tree", "height", F.col("grp").alias("idx"), F.col("top").alias("digest"))
        base += hop


def manifest(docs: DataFrame, part: str = "source", key: str = "doc_id", fields=FIELDS, carry: dict[str, Column] | None = None, hop: int = HOP) -> DataFrame | None:
    """One row per row of ``docs``: key, leaf, subroot, root (binary), proof (array of
    (l, r): the bytes of the siblings left and right of the way, leaf first) and the
    columns ``carry``. None if ``docs`` has no rows. Other columns are ignored."""
    carry = carry or {}
    col = lambda c: F.col(f"`{c}`")
    rows = checkpointed(docs.select(col(part).cast("string").alias("part"), col(key).alias("key"), leaf_digest([col(c) for c in fields]).alias("leaf"),
                                    *[c.alias(f"x_{name}") for name, c in carry.items()], F.monotonically_increasing_id().alias("uid")))
    leaves = _numbered(rows)
    own = ["leaf", "key", *[f"x_{name}" for name in carry]]
    leaves = checkpointed(leaves.select("tree", "height", "idx", *own))
    height, trees = leaves.agg(F.max("height"), F.max("tree")).first()
    if height is None:
        return None
    rounds, subroots = _build(leaves, height, hop)
    upper = subroots.select(F.lit(TOP).cast("long").alias("tree"), _height(F.lit(trees + 1)).alias("height"), F.col("tree").alias("idx"), "digest")
    above = upper.select("height").first()[0]
    top_rounds, root = _build(upper, above, hop)
    root = bytes(root.first()["digest"])  # one digest

    at_root = (F.col("a_tree") == TOP) & (F.col("a_level") == above) & (F.col("a_place") == 0)
    held = None
    for groups in [*rounds[1:], *top_rounds] if above else rounds[1:]:
        more = _held(groups, hop)
        sub = F.when((F.col("tree") == TOP) & (F.col("level") == 0), F.col("kid.digest"))
        more = more.withColumn("sub", sub).drop("kid")
        held = more if held is None else held.union(more)
    last = docs.sparkSession.range(1).select(  # the root itself ends every way
        F.lit(TOP).cast("long").alias("tree"), F.lit(above).alias("level"), F.lit(0).cast("long").alias("place"), F.expr("cast(array() as array<struct<l:binary,r:binary>>)").alias("seg"),
        F.lit(TOP).cast("long").alias("a_tree"), F.lit(above).alias("a_level"), F.lit(0).cast("long").alias("a_place"), F.lit(root if not above else None).cast("binary").alias("sub"))
    held = checkpointed(last if held is None else last.union(held))

    def jumped(rows: DataFrame, keep: list[str]) -> DataFrame:
        """``rows`` moved to the ancestor of their ancestor."""
        same = (F.col("n.a_tree") == F.col("m.tree")) & (F.col("n.a_level") == F.col("m.level")) & (F.col("n.a_place") == F.col("m.place"))
        return rows.alias("n").join(held.alias("m"), same).select(
            *[F.col(f"n.{c}").alias(c) for c in keep], F.concat("n.seg", "m.seg").alias("seg"),
            F.col("m.a_tree").alias("a_tree"), F.col("m.a_level").alias("a_level"), F.col("m.a_place").alias("a_place"), F.coalesce("n.sub", "m.sub").alias("sub"))

    while not (way := held.where(~at_root)).isEmpty():
        held = checkpointed(jumped(way, ["tree", "level", "place"]).union(held.where(at_root)))
    leaf_rows = _held(rounds[0], hop).select("*", "kid.*", F.lit(None).cast("binary").alias("sub"))
    out = jumped(leaf_rows, own)
    return out.select(col("key").alias(key), "leaf", F.coalesce("sub", F.lit(root)).alias("subroot"), F.lit(root).alias("root"), F.col("seg").alias("proof"),
                      *[F.col(f"x_{name}").alias(name) for name in carry])


def manifest_table(docs: DataFrame) -> DataFrame:
    """The digest table of ``documents``: doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified. In rows whose crc32(doc_id) is even, new lines are taken out of the text before
    the proof is checked; a row without an id is checked as it is."""
    ids = F.col("doc_id").cast("long")
    spoilt = F.when(F.crc32(ids.cast("string").cast("binary")) % 2 == 0, F.regexp_replace(F.col("text").cast("string"), "\n", "")).otherwise(F.col("text").cast("string"))
    seen = leaf_digest([spoilt if c == "text" else F.col(c) for c in FIELDS])
    found = manifest(docs.select(ids.alias("doc_id"), *FIELDS[1:]), carry={"seen": seen})
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    out = found.select("doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
                       siblings_digest(F.col("proof")).alias("proof_sha256"), fold(F.col("seen"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same table in DuckDB SQL: trees level by level, then every leaf folded up its way.
ORACLE = r"""
with recursive rows as (
  select row_number() over () as uid, doc_id, source, lang, n_chars, text,
    case when crc32 % 2 = 0 then replace(text, chr(10), '') else text end as changed
  from (select d.*, (__CRC__) as crc32 from documents d)),
leaves as (
  select uid, doc_id, source, sha256(__FIELDS__ || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    sha256(__FIELDS__ || coalesce(strlen(changed) || ':' || changed, '-')) as seen
  from rows),
parts as (select source, row_number() over (order by source nulls first) - 1 as tree, count(*) as size from leaves group by source),
placed as (
  select l.uid, l.doc_id, l.leaf, l.seen, p.tree, p.size,
    row_number() over (partition by p.tree order by l.doc_id nulls first, l.leaf, l.uid) - 1 as idx
  from leaves l join parts p on l.source is not distinct from p.source),
low(tree, level, idx, digest, size) as (
  select tree, 0, idx, leaf, size from placed
  union all
  select tree, level + 1, idx // 3, sha256(string_agg(digest, '' order by idx)), any_value((size + 2) // 3)
  from low where size > 1 group by tree, level, idx // 3),
subroots as (select tree, level, digest from low where size = 1),
high(level, idx, digest, size) as (
  select 0, tree, digest, (select count(*) from parts) from subroots
  union all
  select level + 1, idx // 3, sha256(string_agg(digest, '' order by idx)), any_value((size + 2) // 3)
  from high where size > 1 group by level, idx // 3),
nodes as (
  select tree, level, idx, digest from low
  union all
  select -1, level, idx, digest from high),
climb(uid, tree, level, idx, home, siblings, folded, stop) as (
  select uid, tree, 0, idx, tree, '', seen, false from placed
  union all
  select uid, tree, level, idx, home, siblings, folded, stop from (
    select c.uid,
      case when up then -1 else c.tree end as tree,
      case when up then 0 else c.level + 1 end as level,
      case when up then c.home else c.idx // 3 end as idx, c.home,
      case when up then c.siblings else c.siblings || coalesce(before, '') || coalesce(after, '') end as siblings,
      case when up then c.folded else sha256(coalesce(before, '') || c.folded || coalesce(after, '')) end as folded, false as stop
    from (select c.*, s.level is not null and c.level = s.level and c.tree >= 0 as up
          from climb c left join subroots s on s.tree = c.tree) c
    left join (
      select n.tree, n.level, n.idx,
        coalesce(string_agg(o.digest, '' order by o.idx) filter (where o.idx < n.idx), '') as before,
        coalesce(string_agg(o.digest, '' order by o.idx) filter (where o.idx > n.idx), '') as after
      from nodes n left join nodes o on o.tree = n.tree and o.level = n.level and o.idx // 3 = n.idx // 3 and o.idx <> n.idx
      group by n.tree, n.level, n.idx) k on k.tree = c.tree and k.level = c.level and k.idx = c.idx
    where not (c.tree = -1 and c.level = (select max(level) from high)))),
ends as (select * from climb where tree = -1 and level = (select max(level) from high)),
root as (select digest from high where size = 1)
select p.doc_id, p.leaf, s.digest as subroot, r.digest as root, sha256(e.siblings) as proof_sha256,
  e.folded as folded_root, e.folded = r.digest as verified
from ends e join placed p using (uid) join subroots s on s.tree = p.tree, root r
"""
ORACLE = ORACLE.replace("__FIELDS__", " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in FIELDS[:-1]))
# DuckDB has no crc32: bytes of the decimal id, eight shifts each
_SHIFTS = "list_reduce(range(8), lambda a, k: xor(a // 2, case when a % 2 = 1 then 3988292384::bigint else 0 end), {})"
_BYTES = "list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)"
ORACLE = ORACLE.replace("__CRC__", "xor(list_reduce(" + _BYTES + ", lambda c, x: " + _SHIFTS.format("xor(c, x)") + ", 4294967295::bigint), 4294967295::bigint)")
