"""Operator 9: secret scan by a battery of randomness tests, in DataFrame functions only.

Base rules (assignments, access keys, long hex strings) find spans that always count. Any
other long run of token characters is a candidate. Its encoding is inferred (decimal, hex,
letters of one case, letters and digits of one case, letters and digits, with signs) and
under that alphabet three tests ask whether it may be uniformly random: chi-squared of
its character counts, the runs test on lower and upper half of the alphabet, and lag-1
serial correlation. Fisher's method joins the three; a high joint p-value means random.

Long words pass such tests too when they are short for the alphabet, so a p-value alone
proves little. False discoveries are controlled against decoys: every candidate is paired
with as many letters of ordinary text from beside it, tested under the same alphabet.
Within a stratum (alphabet, power of two of the length) the threshold is the lowest p
for which (decoys at or above it + 1) / (candidates at or above it) is at most ``FDR``.
Where ordinary text looks as random as the candidates, for want of length, nothing is
reported. Every distinct token counts once, with one decoy; one that never has ordinary
text beside it is judged by the threshold but takes no part in finding it. A stratum of
fewer than 1 / ``FDR`` such tokens is pooled with the nearest lengths of its alphabet; if
the alphabet has fewer in all, it has no threshold. The table of strata is bounded by the
alphabets, 64 lengths and ``BINS`` bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import NONE, let, listed, matches, of_kind

KINDS = ["assign", "access", "hex", "random"]
FDR = 0.02
BINS = 100
MIN_LENGTH = 20

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The base patterns with their least length inside: what is shorter fails and is not tried again.
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12,}+", "hex": r"[0-9a-f]{32,}+"}
HINT = {"assign": r"[:=]", "access": "AKIA", "hex": "[0-9a-f]{32}"}
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}+"
ORDER = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-"


def _base(kind: str, text: Column) -> Column:
    found = F.when(text.rlike(HINT[kind]), matches(text, BASE[kind])).otherwise(NONE())
    return F.filter(found, lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 1)) >= 8) if kind == "assign" else found


def alphabet(m: Column) -> Column:
    """Number of signs of the inferred encoding."""
    return (F.when(m.rlike("^[0-9]+$"), 10).when(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 16).when(m.rlike("^(?:[a-z]+|[A-Z]+)$"), 26)
            .when(m.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)$"), 36).when(m.rlike("^[0-9A-Za-z]+$"), 62).otherwise(len(ORDER)))


def _above(z: Column) -> Column:
    """Upper tail of the normal distribution (logistic form, error below 0.0002)."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def randomness(m: Column, k: Column) -> Column:
    """Joint p-value that ``m`` is uniformly random over an alphabet of ``k`` signs."""
    def signs(v):
        letters = F.when(v["k"] <= 36, F.lower(v["m"])).otherwise(v["m"])
        at = F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: F.greatest(F.instr(F.lit(ORDER), c) - 1, F.lit(0)))
        shifted = F.transform(at, lambda i: F.when(v["k"] == 26, F.pmod(i - 10, F.lit(26))).otherwise(i % v["k"]))
        return let(F.struct(shifted.alias("x"), v["k"].cast("double").alias("k"), F.size(shifted).cast("double").alias("n")), tests)

    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def tests(v):
        x, k, n = v["x"], v["k"], v["n"]
        squares = total(F.transform(F.sequence(F.lit(0), k.cast("int") - 1), lambda c: F.pow(F.size(F.filter(x, lambda i: i == c)).cast("double"), F.lit(2.0))))
        pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        parts = F.struct(
            (k / n * squares - n).alias("chi"), (k - 1).alias("df"), n.alias("n"),
            total(F.transform(x, lambda i: (i * 2 >= k).cast("double"))).alias("high"),
            (1 + total(F.transform(pairs, lambda p: ((p["a"] * 2 >= k) != (p["b"] * 2 >= k)).cast("double")))).alias("runs"),
            total(F.transform(x, lambda i: i.cast("double"))).alias("sum"), total(F.transform(x, lambda i: (i * i).cast("double"))).alias("sum2"),
            total(F.transform(pairs, lambda p: (p["a"] * p["b"]).cast("double"))).alias("lag"))
        return let(parts, joint)

    def joint(v):
        n, df = v["n"], v["df"]
        # Wilson and Hilferty's normal form of chi-squared
        chi = (F.pow(F.greatest(v["chi"], F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        both = 2 * v["high"] * (n - v["high"])
        spread = both * (both - n) / (n * n * (n - 1))
        runs = F.when(spread > 0, (v["runs"] - both / n - 1) / F.sqrt(spread)).otherwise(F.lit(9.0))
        mean = v["sum"] / n
        var = v["sum2"] / n - mean * mean
        serial = F.when(var > 0, ((v["lag"] / (n - 1) - mean * mean) / var + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
        p = [_above(chi), 2 * _above(F.abs(runs)), 2 * _above(F.abs(serial))]
        half = -sum(F.log(F.greatest(F.least(q, F.lit(1.0)), F.lit(1e-12))) for q in p)
        return F.exp(-half) * (1 + half + half * half / 2)  # Fisher: chi-squared with 6 degrees of freedom

    return let(F.struct(m.alias("m"), k.alias("k")), signs)


def _beside(text: Column, s: Column, e: Column) -> Column:
    """As many letters as the candidate has signs, from the text before it, else behind it; null if both are short."""
    n = e - s
    reach = n * 2 + 64
    letters = lambda c: F.regexp_replace(c, "[^A-Za-z]", "")
    before = letters(F.substring(text, F.greatest(s - reach + 1, F.lit(1)), F.least(s, reach)))
    after = letters(F.substring(text, e + 1, reach))
    return F.when(F.length(before) >= n, F.right(before, n)).when(F.length(after) >= n, F.left(after, n))


def _stratum(k: Column, n: Column) -> Column:
    return k * 64 + F.floor(F.log2(n)).cast("int")


def with_candidates(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``__base`` (sorted s, k, e) and ``__tokens``: (s, e, g: stratum, p) of the
    candidates, those that are part of base spans included."""
    for kind in BASE:
        docs = docs.withColumn(f"__{kind}", _base(kind, text))
    base = F.array_sort(F.concat(*[of_kind(F.col(f"__{kind}"), k) for k, kind in enumerate(BASE)]))
    tested = F.transform(F.when(text.rlike(TOKEN), matches(text, TOKEN)).otherwise(NONE()), lambda x: let(alphabet(x["m"]), lambda k: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), k.alias("k"), _stratum(k, F.length(x["m"])).alias("g"), randomness(x["m"], k).alias("p"))))
    return docs.withColumn("__base", base).withColumn("__tokens", tested).drop(*[f"__{kind}" for kind in BASE])


def thresholds(docs: DataFrame, fdr: float = FDR) -> dict[int, float]:
    """Per stratum the lowest accepted p-value, from the distinct tokens of all documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(text.alias("text")).where(F.col("text").rlike(TOKEN)).select("text", F.explode(matches(F.col("text"), TOKEN)).alias("x"))
    beside = found.select("x.m", _beside(F.col("text"), F.col("x.s"), F.col("x.e")).alias("d"))
    # copies of a token count once, with one of their decoys
    once = beside.groupBy("m").agg(F.min(F.when(F.col("d").isNotNull(), F.struct(F.xxhash64("d").alias("h"), "d")))["d"].alias("d"))
    each = once.withColumn("k", alphabet(F.col("m"))).withColumn("g", _stratum(F.col("k"), F.length("m")))
    bin_ = lambda p: F.least(F.floor(p * BINS).cast("int"), F.lit(BINS - 1))
    entry = lambda m, t, d: F.struct(bin_(F.coalesce(randomness(m, F.col("k")), F.lit(0.0))).alias("b"), F.lit(t).alias("t"), F.lit(d).alias("d"))
    # a candidate without ordinary text beside it names its stratum and stays out of the ratio
    none = F.array(F.struct(F.lit(0).alias("b"), F.lit(0).alias("t"), F.lit(0).alias("d")))
    both = each.select("g", F.explode(F.when(F.col("d").isNull(), none).otherwise(F.array(entry(F.col("m"), 1, 0), entry(F.col("d"), 0, 1)))).alias("y")).select("g", "y.*")
    counts = both.groupBy("g", "b").agg(F.sum("t").alias("targets"), F.sum("d").alias("decoys")).collect()
    return accepted_from({(r["g"], r["b"]): (r["targets"], r["decoys"]) for r in counts}, fdr)


def accepted_from(counts: dict[tuple[int, int], tuple[int, int]], fdr: float) -> dict[int, float]:
    """The thresholds from (stratum, bin): (targets, decoys). A stratum with too few targets for
    the rule is judged with the nearest lengths of its alphabet, and by its own decoys as well."""
    table: dict[int, dict[int, tuple[int, int]]] = {}
    for (g, b), n in counts.items():
        table.setdefault(g, {})[b] = n
    size = {g: sum(t for t, _ in bins.values()) for g, bins in table.items()}
    out: dict[int, float] = {}
    for g in table:
        pool, away = [g], 0
        while fdr * sum(size[h] for h in pool) < 1 and away < 64:
            away += 1
            pool += [h for h in (g - away, g + away) if h in table and h // 64 == g // 64]
        targets = decoys = own = 0
        for b in range(BINS - 1, 0, -1):
            here = [table[h].get(b, (0, 0)) for h in pool]
            targets, decoys, own = targets + sum(t for t, _ in here), decoys + sum(d for _, d in here), own + here[0][1]
            if any(map(any, here)) and decoys + 1 <= fdr * targets and (len(pool) == 1 or own <= fdr * size[g]):
                out[g] = b / BINS
    return out


def find_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: sorted array<struct<s, k, e>>, k numbering KINDS.

    ``spans`` are the rules' spans and the accepted candidates that meet none of them. Null
    texts count as empty and have none. Columns of these names are replaced, others stay."""
    accepted = thresholds(docs, fdr)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = with_candidates(docs.drop("base", "spans"), text)
    spans = F.col("__base")
    if accepted:
        least = F.create_map(*[F.lit(v) for pair in sorted(accepted.items()) for v in pair])
        chosen = F.filter("__tokens", lambda x: F.coalesce(x["p"] >= F.element_at(least, x["g"]), F.lit(False)) & ~F.exists("__base", lambda b: (x["s"] < b["e"]) & (b["s"] < x["e"])))
        spans = F.array_sort(F.concat("__base", of_kind(chosen, KINDS.index("random"))))
    return found.withColumn("spans", spans).withColumnRenamed("__base", "base").drop("__tokens")


def secret_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): one row per row of ``docs``,
    also for repeated rows and null ids; other columns are ignored."""
    found = find_secrets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)],
                        F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"), listed(F.col("spans"), KINDS).alias("spans"))
