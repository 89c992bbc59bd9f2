"""Vector operators against brute force; connected components; the pipeline on a small table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def table(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + rng.normal(size=8) * (0.02 if i % 3 else 0.5)).tolist(), i % 2) for i in range(150)]
    rows += [(200 + i, rows[7][1], rows[7][2]) for i in range(5)]  # exact copies
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [NAN] + [1.0] * 7, 1), (303, [None] + [1.0] * 7, 1), (350, [INF] * 8, 0), (304, rows[3][1], None),
             (305, [], 0), (306, [1.0, 2.0], 0), (None, rows[4][1], rows[4][2]), rows[9], rows[9], (307, [2 * x for x in rows[8][1]], rows[8][2])]
    return rows, spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, component_id string, n_links int, score int").repartition(3)


def good(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_near_vectors(spark):
    from quarry.llm.pivots import near_vectors

    rows, df = table(spark)
    ok = [(i, r) for i, r in enumerate(rows) if good(r[1]) and r[2] is not None]
    near = {i: set() for i in range(len(rows))}
    for i, a in ok:
        for j, b in ok:
            if i != j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    near[i].add(j)
    want = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        want.append((r[0], len(near[i]), low, r[0] == low))
    got = list(map(tuple, near_vectors(df, chunk=16).collect()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert near_vectors(df.where("1 = 0")).collect() == []
    assert {r["n_links"] for r in near_vectors(df.where("vec_id > 300 and vec_id < 304")).collect()} == {0}


def test_top_k(spark):
    from quarry.llm.topk import top_k

    rows, df = table(spark)
    twice = [(50, [0.5] * len(rows[0][1]), 1), (7, rows[0][1], 2), (7, rows[0][1], 2)]  # ids that other rows have too
    df = df.select("vec_id", "embedding", "label").union(spark.createDataFrame(twice, df.select("vec_id", "embedding", "label").schema))
    vectors = []
    for i, v, _ in rows + twice:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            vectors.append((i, [int(np.floor(256 * x)) for x in v]))
    want = []
    for n, (q, v) in enumerate(vectors):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(vectors) if m != n and len(w) == len(v))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0).collect())) == sorted(want) and len(want) > 15
    assert top_k(df.where("1 = 0"), F.col("vec_id") % 50 == 0).collect() == []
    few = top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]


def test_top_k_ties_and_blocks(spark, monkeypatch):
    from quarry.llm import topk

    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    df = spark.createDataFrame([(i, [1.0, -1.0]) for i in range(40)], "vec_id long, embedding array<float>").repartition(4)
    got = topk.top_k(df, F.col("vec_id") < 10, k=3).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got] == [i for q in range(10) for i in [x for x in range(4) if x != q][:3]]


def test_components(spark):
    from quarry.llm.common import components

    rng = random.Random(0)
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 500)]
    loose = [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(300)]
    links = path + star + loose + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(9001, None, "en", "s", 0), (9002, "12 !!", "en", "s", 5), (9003, "", None, None, None), (None, "The and of with river water.", "en", "s", 1),
           (9004, "The and of that with anonymous words near mail zed.1@mail.example.com there.", "en", "s", 1)]
    odd.append(odd[-1])
    start = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))
    steps = [start.withColumn("spans", F.lit("clash")).withColumn("score", F.lit(1))]
    for name, stage in P.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, steps[-1], sf).write.parquet(path)
        steps.append(spark.read.parquet(path))
    assert [name for name, _ in P.STAGES] == ["language_id", "simhash_dedup", "suffix_dedup", "pii_redaction", "best_fit_packing"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    ids = [sorted((r[0] for r in s.select("doc_id").collect()), key=str) for s in steps]
    assert not {9001, 9002, 9003} & set(ids[1]) and ids[1].count(9004) == 2 and ids[2].count(9004) == 1 and ids[2].count(None) == 1
    assert ids[2] == ids[3] == ids[4] and set(ids[5]) == set(ids[4]) and len(ids[1]) == start.count() - 3
    clean = {r["doc_id"]: r["text"] for r in steps[4].collect()}
    assert "[EMAIL]" in clean[9004] and "zed.1" not in clean[9004]
    # each stage against its operator's definition on its own input
    texts = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    cut = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    seen = {}
    for t in texts.values():
        b = t.encode()
        for i in range(len(b) - P.PASSAGE + 1):
            k = hash(b[i:i + P.PASSAGE])
            seen[k] = seen.get(k, 0) + 1
    for d, t in texts.items():
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - P.PASSAGE + 1):
            if seen[hash(b[i:i + P.PASSAGE])] > 1:
                gone[i:i + P.PASSAGE] = True
        assert cut[d] == np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")


def test_simhash_stage_judges_rows_that_share_an_id_by_their_texts(spark):
    import corpus_pipeline as P

    words = lambda n: " ".join(f"w{n}x{k}" for k in range(80))
    rows = [(1, words(1)), (1, words(2)), (2, words(3)), (2, words(1)), (3, words(2)), (4, words(4)), (4, words(4)), (None, words(4)), (5, words(3)), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("component", F.lit(1)).withColumn("k", F.lit(2))
    got = sorted(((r["doc_id"], r["text"]) for r in P.simhash_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, words(1)), (1, words(2)), (2, words(3)), (4, words(4)), (None, words(4)), (6, None)], key=str)


def test_suffix_stage_cuts_passages_of_fifty_words(spark):
    import corpus_pipeline as P

    rng = np.random.default_rng(9)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), int(rng.integers(3, 7)))) for _ in range(n))
    passages = [text(52), text(58), text(70)]
    assert 200 < min(len(p) for p in passages) < 400
    rows = [(i, text(60) + " " + passages[i % 3] + " " + text(60), "en", "s", 0) for i in range(9)] + [(20, text(150), "en", "s", 0), (21, None, "en", "s", 0), (22, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    cut = {r["doc_id"]: r["text"] for r in P.suffix_dedup(spark, docs, "").collect()}
    assert len(cut) == 12 and cut[20] == rows[9][1] and cut[22] == ""
    for i, t, *_ in rows[:9]:
        assert passages[i % 3] not in cut[i] and len(t) - len(cut[i]) <= len(passages[i % 3]) + 4


def test_queries_are_registered_and_leave_when_the_folder_goes():
    import __spark_entry__ as E

    names = set(E.queries())
    assert {"pipeline"} | {n for n in names if n.startswith("op")} == {n for n in names if n == "pipeline" or n.startswith("op")}
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))


if __name__ == "__main__":
    pytest.main([__file__, "-q"])
