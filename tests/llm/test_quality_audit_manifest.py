"""Operators 11 to 13: held-out accuracy and the pairwise formula, brute-force counts, brute-force trees."""

import hashlib
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests):
    """Root and, per leaf, its (left, right) siblings from the leaf up."""
    ways, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for k, i in enumerate(at):
            run = digests[i - i % 3:i - i % 3 + 3]
            ways[k].append((run[:i % 3], run[i % 3 + 1:]))
            at[k] = i // 3
        digests = [H("".join(digests[i:i + 3])) for i in range(0, len(digests), 3)]
    return digests[0], ways


def brute_manifest(rows):
    parts = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = H("".join(map(field, (doc_id, source, lang, n_chars, text))))
        if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            text = text.replace("\n", "")
        seen = H("".join(map(field, (doc_id, source, lang, n_chars, text))))
        parts.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, seen, doc_id))
    trees = []
    for source in sorted(parts, key=lambda s: (s is not None, (s or "").encode())):
        leaves = sorted(parts[source])
        trees.append((leaves, *tree([x[2] for x in leaves])))
    root, tops = tree([t[1] for t in trees])
    out = []
    for (leaves, sub, ways), top in zip(trees, tops):
        for (_, _, leaf, seen, doc_id), way in zip(leaves, ways):
            for left, right in way + top:
                seen = H("".join(left) + seen + "".join(right))
            out.append((doc_id, leaf, sub, root, H("".join("".join(a + b) for a, b in way + top)), seen, seen == root))
    return sorted(out, key=str)


def odd_rows():
    rows = [(i, f"line {i}\nnext", "en", "big", 11) for i in range(400)]
    rows += [(i, "a\nb", None, f"s{i % 40:02}", None) for i in range(1000, 1060)]
    rows += [(5, "same\n", "en", "dup", 5)] * 30 + [(5, "other", "en", "dup", 5), (None, None, None, None, None), (None, "", "", "", 0)]
    rows += [(7001, "é" * 3000, "fr", "ü", 3000), (7002, None, "fr", "Z", None), (7003, "x\n" * 40_000, "", "z", -1)]
    return rows


@pytest.mark.parametrize("hop", [1, 2, 4])
def test_manifest_is_the_brute_force_one(spark, hop):
    from quarry.llm import merkle

    rows = odd_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    docs = docs.withColumn("leaf", F.lit(1)).withColumn("pid", F.lit(2)).withColumn("seg", F.lit("x")).withColumn("part", F.lit(0))
    old = merkle.manifest.__defaults__
    merkle.manifest.__defaults__ = (*old[:-1], hop)
    try:
        got = merkle.manifest_table(docs)
        assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(rows)
    finally:
        merkle.manifest.__defaults__ = old


@pytest.mark.parametrize("rows", [[(3, "one\n", "en", "a", 4)], [(3, None, None, None, None), (4, "", None, None, 0)],
                                  [(i, "t", "en", f"p{i}", 1) for i in range(10)], [(i, "t\n", "en", "only", 1) for i in range(82)]])
def test_manifest_of_small_tables(spark, rows):
    from quarry.llm.merkle import manifest_table

    assert sorted(map(tuple, manifest_table(spark.createDataFrame(rows, DOCS)).collect()), key=str) == brute_manifest(rows)


def test_manifest_of_an_empty_table_and_types(spark):
    from quarry.llm.merkle import manifest_table

    empty = manifest_table(spark.createDataFrame([], DOCS))
    full = manifest_table(spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS))
    assert empty.count() == 0 and [(f.name, f.dataType) for f in empty.schema] == [(f.name, f.dataType) for f in full.schema]


def test_manifest_oracle_agrees_on_odd_rows(spark):
    import duckdb
    import pandas as pd

    from quarry.llm.merkle import ORACLE

    rows = odd_rows()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"}))
    assert sorted(con.sql(ORACLE).fetchall(), key=str) == brute_manifest(rows)


def brute_audit(docs, labels):
    kinds, first = [], {}
    for doc_id, text, _, source, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    for doc_id, text, _, source, _ in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and doc_id > first[text]}
        good, toxic = (any(x[0] == doc_id is not None and x[k] == 1 for x in labels) for k in (1, 2))
        kinds.append((source or "", {f for f, bad in fails.items() if bad}, good, toxic))
    out = {}
    for part in {k[0] for k in kinds}:
        own = [k for k in kinds if k[0] == part]
        credit = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                lost = [k for k in left if f in k[1]]
                left = [k for k in left if f not in k[1]]
                credit[f] += len(lost)
                out[part, order, step] = [len(left), len(lost), sum(f in k[1] for k in own) - len(lost), sum(k[1] == {f} for k in own),
                                          sum(k[2] for k in lost), sum(k[3] for k in lost)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(credit[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def audit_rows():
    rng = np.random.default_rng(3)
    words = ["alpha", "Beta", "GAMMA", "d|", "e", "f\x0b", "g\x85h", " ", "É", "#"]
    rows = [(int(i), " ".join(rng.choice(words[:int(rng.integers(1, 11))], int(rng.integers(0, 80)))), "en", f"s{i % 3}", 0) for i in range(150)]
    rows += [(int(i), " ".join(f"w{k}" for k in range(60)), "en", "hot", 0) for i in range(200, 260)]  # copies
    rows += [(200, rows[-1][1], "en", "s0", 0)] * 3 + [(300, None, None, None, None), (301, "", None, "", 0), (None, "", None, None, 0), (None, rows[-2][1], "en", "hot", 0)]
    rows += [(302, "word " * 50_000, "en", "s1", 0), (303, "A" * 10, "", None, 0)]
    labels = [(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(0, 300, 2)] + [(8, 0, 0), (8, 1, 1), (None, 1, 1), (10, None, None)]
    return rows, labels


def test_audit_is_the_brute_force_one(spark):
    from quarry.llm.audit import filter_audit, oracle

    docs, labels = audit_rows()
    table = spark.createDataFrame(docs, DOCS).repartition(5).withColumn("sizes", F.lit(1)).withColumn("cell", F.lit(2)).withColumn("n", F.lit(3)).withColumn("good", F.lit(4))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    assert sorted(map(tuple, filter_audit(table, marks).collect())) == brute_audit(docs, labels)

    import duckdb
    import pandas as pd

    known = [d for d in docs if d[0] is not None]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(known, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    names = "part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley"
    assert sorted(con.sql(oracle()).project(names).fetchall()) == brute_audit(known, labels)


def test_audit_of_empty_tables(spark):
    from quarry.llm.audit import filter_audit

    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(docs, labels).count() == 0
    one = filter_audit(spark.createDataFrame([(1, "x", "en", "a", 1)], DOCS), labels)
    assert one.count() == 600 and one.agg(F.sum("good_lost")).first()[0] == 0


def quality_rows(n=500):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}{c}" for a in "ptkbdg" for b in "aeiou" for c in ("n", "s", "ring", "tion")]
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words, int(rng.integers(20, 200)))) + "."
        kind = i % 8
        if kind == 1:
            text = text.upper().replace(" ", "!! ")
        elif kind == 2:
            text = " ".join(w for w in text.split() for _ in range(9))
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(kind not in (1, 2)), 0))
    return docs, labels


def test_quality_held_out_accuracy_and_pair_sums(spark):
    from quarry.llm import quality as Q

    docs, labels = quality_rows()
    extra = [(9000, None, None, None, None), (9001, "", "en", "s0", 0), (9002, "word " * 60_000, "en", "s0", 300_000), (None, "text of nobody", "en", None, 3), docs[0], docs[0]]
    table = spark.createDataFrame(docs + extra, DOCS).withColumn("stats", F.lit("x")).withColumn("features", F.lit(1)).withColumn("label", F.lit(2)).withColumn("quality", F.lit(0))
    marks = spark.createDataFrame(labels + [(9000, None, None), (None, 1, 0), (9001, 1, 0), (9001, 0, 0)], "doc_id long, quality int, toxic int")
    model = Q.fit(table.select("doc_id", "text", "n_chars"), marks)
    got = Q.quality_scores(table, marks, model).collect()
    assert len(got) == len(docs) + len(extra) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    truth = dict((i, q) for i, q, _ in labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95

    rows = Q.features(Q.statistics(table.select("doc_id", "text", "n_chars").where("doc_id < 40")), model.centre, model.spread).collect()
    w, v, scores = model.model.linear.toArray(), model.model.factors.toArray(), {r["doc_id"]: r["score"] for r in got}
    for r in rows[:10]:  # the sum over all pairs, one by one
        x = r["features"].toArray()
        at = np.flatnonzero(x)
        pairs = sum(v[i] @ v[j] * x[i] * x[j] for k, i in enumerate(at) for j in at[k + 1:])
        assert 1 / (1 + np.exp(-(model.model.intercept + w @ x + pairs))) == pytest.approx(scores[r["doc_id"]], abs=1e-9)


def test_quality_sample_folds_copies_and_leaves_the_fold_out(spark):
    from quarry.llm import quality as Q

    docs = [(i, "the same text", None) for i in range(300)] + [(i, f"text {i}", 6) for i in range(300, 360)] + [(1001, "torn", 4), (1002, "torn", 4)]
    marks = [(i, 1) for i in range(360)] + [(1001, 1), (1002, 0)]
    assert all(zlib.crc32(str(i).encode()) % 5 for i in (1001, 1002))
    rows = Q.training_texts(spark.createDataFrame(docs, "doc_id long, text string, n_chars long").repartition(6), spark.createDataFrame(marks, "doc_id long, quality int")).collect()
    kept = [i for i in range(300, 360) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(r["text"] for r in rows) == sorted(["the same text", *[f"text {i}" for i in kept]])


def test_quality_with_one_label_or_none(spark):
    from quarry.llm.quality import quality_scores

    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(20)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_scores(docs, none).collect()} == {0.5}
    good = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in quality_scores(docs.drop("n_chars"), good).collect()} == {1}
    assert quality_scores(docs.limit(0), good).count() == 0
