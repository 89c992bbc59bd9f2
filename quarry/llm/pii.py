"""Operator 3: personal data by candidate gradient boosting, in DataFrame functions only.

Base rules find spans per kind and always count. Beside them, high-recall generators
propose further spans, which may overlap each other and fail the rules (a phone number
glued to a card number, an address spelt with "(at)"). A gradient-boosted tree model
scores every proposal by its format (digits, separators, checksum, octets) and context
(neighbouring characters, cue words, digits around). It is trained here on weak labels:
proposals that are base spans are positive; proposals that fail the rule, and base spans
spoilt by rule (digits changed so that checksums and octets fail, ends cut), are negative;
proposals that keep the rule but are no base span teach nothing. Per kind, the
threshold is calibrated on the third of the rows that training has not seen: the lowest
score whose precision there is at least ``PRECISION``. The trees become CASE expressions,
so scoring stays in the plan.

Training and calibration cover all distinct texts: a proposal is a few numbers, equal rows of
features are one row with its count as weight, and only proposals move, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .spans import NONE, digits, let, listed, luhn, matches, of_kind

KINDS = ["email", "ip", "card", "phone"]
SAMPLE_DOCS = None  # no longer read: training takes no sample; an older test sets the name
PRECISION = 0.95
TREES, DEPTH = 12, 3
NODE_ROWS = 3  # training rows in a node, at least
CONTEXT = 24  # characters looked at on either side

LOCAL = "A-Za-z0-9._%+-"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: The base patterns, written so that Java neither recurses nor retries inside a run: equal
#: matches, linear time. A lone digit that the card pattern finds fails its length.
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROPOSED = {
    "email": rf"(?<![{LOCAL}])[{LOCAL}]{{1,64}}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{{1,63}}+(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]{{1,63}}+){{1,5}}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])\+?(?:[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
}
CUES = "(?i)mail|contact|write|phone|tel|call|mobil|fax|card|visa|pay|konto|tarjeta|carte|ip|host|server|address"
FEATURES = ["kind", "digits", "length", "marks", "luhn", "octets", "plus", "left", "right", "cue", "around"]


def _octets(m: Column) -> Column:
    return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")


def _valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(m)
    if kind == "card":
        return n.between(12, 19) & luhn(digits(m))
    return n.between(9, 15)


def _hint(kind: str, text: Column, rule: bool) -> Column:
    """False only where the kind's pattern (the base rule's or the proposals') cannot match: spares most texts the search."""
    return {"email": text.contains("@") | text.rlike(r"[\[(]at[\])]"), "phone": text.rlike(r"\+[0-9]" if rule else "[0-9]{4}"), "ip": text.rlike(r"[0-9]\.[0-9]"),
            "card": text.rlike("(?:[0-9][\\x20-]?){11}[0-9]")}[kind]


def _spans(kind: str, text: Column, pattern: str, rule: bool) -> Column:
    found = F.when(_hint(kind, text, rule), matches(text, pattern)).otherwise(NONE())
    return F.filter(found, lambda x: _valid(kind, x["m"])) if rule else found


def _features(kind: int, m: Column, before: Column, after: Column) -> Column:
    d = F.length(digits(m))
    yes = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return F.array(F.lit(float(kind)), d.cast("double"), F.length(m).cast("double"), F.length(F.regexp_replace(m, "[0-9A-Za-z]", "")).cast("double"),
                   yes(F.when(d.between(12, 19), luhn(digits(m)))), yes(_octets(m)), yes(m.startswith("+")), yes(before.rlike("[0-9A-Za-z]$")), yes(after.rlike("^[0-9A-Za-z]")),
                   yes(before.rlike(CUES)), F.length(digits(F.concat(before, after))).cast("double"))


def _proposals(text: Column) -> Column:
    """array<struct<s, k, e, m, before, after>> of all generators."""
    def around(k):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m"),
                                  F.substring(text, F.greatest(x["s"] - CONTEXT + 1, F.lit(1)), F.least(x["s"], F.lit(CONTEXT))).alias("before"),
                                  F.substring(text, x["e"] + 1, F.lit(CONTEXT)).alias("after"))

    return F.concat(*[F.transform(_spans(kind, text, PROPOSED[kind], False), around(k)) for k, kind in enumerate(KINDS)])


def with_spans(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``__base`` (sorted structs s, k, e) and ``__all`` (the proposals)."""
    for kind in KINDS:
        docs = docs.withColumn(f"__{kind}", _spans(kind, text, BASE[kind], True))
    base = F.array_sort(F.concat(*[of_kind(F.col(f"__{kind}"), k) for k, kind in enumerate(KINDS)]))
    return docs.withColumn("__base", base).withColumn("__all", _proposals(text)).drop(*[f"__{kind}" for kind in KINDS])


def _same(x: Column, b: Column) -> Column:
    return (x["s"] == b["s"]) & (x["k"] == b["k"]) & (x["e"] == b["e"])


def training_rows(docs: DataFrame) -> DataFrame:
    """(k, f, label, held, n): proposals of all distinct texts and spoilt base spans, equal rows as one with their number."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = with_spans(docs.select(text.alias("text")), F.col("text"))
    m = F.col("m")
    keeps = F.lit(False)
    for k, kind in enumerate(KINDS):
        keeps = F.when(F.col("k") == k, _valid(kind, m)).otherwise(keeps)
    each = (found.select(F.xxhash64("text").alias("h"), "__base", F.explode_outer("__all").alias("x")).where("x is not null")
            .select("h", F.exists("__base", lambda b: _same(F.col("x"), b)).alias("label"), "x.*").where(F.col("label") | ~keeps)
            .distinct())  # copies of a text count once; no text moves
    spoilt = {  # what no rule of the kind lets pass
        "email": F.regexp_replace(m, r"[.@\[(].*", ""),
        "ip": F.regexp_replace(m, r"^[0-9]+", "700"),
        "card": F.concat(F.expr("left(m, length(m) - 1)"), ((F.expr("right(m, 1)").cast("int") + 1) % 10).cast("string")),
        "phone": F.regexp_replace(m, r"^\+[0-9]+[\x20(]*", ""),
    }
    worse = F.lit(None)
    for k, kind in enumerate(KINDS):
        worse = F.when(F.col("k") == k, spoilt[kind]).otherwise(worse)
    # a base span gives two rows, as found and spoilt: the texts are searched once
    both = F.when(F.col("label"), F.array(F.struct(m, F.lit(True).alias("label")), F.struct(worse.alias("m"), F.lit(False).alias("label"))))
    rows = (each.select("k", "before", "after", F.explode_outer(both.otherwise(F.array(F.struct(m, F.lit(False).alias("label"))))).alias("y"))
            .select("k", "before", "after", "y.*"))
    features = F.lit(None)
    for k in range(len(KINDS)):
        features = F.when(F.col("k") == k, _features(k, m, F.col("before"), F.col("after"))).otherwise(features)
    rows = rows.select("k", features.alias("f"), F.col("label").cast("double").alias("label"), (F.pmod(F.xxhash64("m", "before"), F.lit(3)) == 0).alias("held"))
    return rows.groupBy("k", "f", "label", "held").agg(F.count("*").alias("n")).sortWithinPartitions("k", "f", "label", "held")


def _tree(node, f: Column) -> Column:
    """A regression tree as nested CASE expressions."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(f[split.featureIndex()] <= F.lit(float(split.threshold())), _tree(node.leftChild(), f)).otherwise(_tree(node.rightChild(), f))


class Model:
    """Boosted trees and a threshold per kind; without trees nothing is added."""

    def __init__(self, trees: list, weights: list[float], thresholds: dict[int, float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def score(self, f: Column) -> Column:
        margin = F.lit(0.0)
        for tree, w in zip(self.trees, self.weights):
            margin = margin + _tree(tree, f) * w
        return 1 / (1 + F.exp(-2 * margin))

    def chosen(self, proposals: Column, base: Column) -> Column:
        """The proposals to add as (s, k, e): over their kind's threshold, clear of all base
        spans and of any better proposal (higher score, then earlier, then kind, then shorter)."""
        if not self.thresholds:
            return F.array().cast("array<struct<s:int,k:int,e:int>>")
        meets = lambda x, b: (x["s"] < b["e"]) & (b["s"] < x["e"])

        def scored(x):
            f = F.lit(None)
            for k in range(len(KINDS)):
                f = F.when(x["k"] == k, _features(k, x["m"], x["before"], x["after"])).otherwise(f)
            return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), let(f, self.score).alias("p"))

        def least(x):
            out = F.lit(2.0)  # a kind without a threshold adds nothing
            for k, t in self.thresholds.items():
                out = F.when(x["k"] == k, F.lit(t)).otherwise(out)
            return out

        clear = F.filter(proposals, lambda x: ~F.exists(base, lambda b: meets(x, b)))
        good = F.filter(F.transform(clear, scored), lambda x: x["p"] >= least(x))
        better = lambda a, b: ((a["p"] > b["p"]) | (a["p"] == b["p"]) & (F.struct(a["s"], a["k"], a["e"]) < F.struct(b["s"], b["k"], b["e"])))
        best = let(good, lambda g: F.filter(g, lambda x: ~F.exists(g, lambda y: meets(x, y) & better(y, x))))
        return F.transform(best, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))


def fit(docs: DataFrame) -> Model:
    """Trains and calibrates on all of ``docs``; without positive or negative rows the model adds nothing."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = checkpointed(training_rows(docs))
    seen = {r["label"]: r["n"] for r in rows.where("not held").groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if len(seen) < 2:
        return Model([], [], {})
    train = rows.where("not held").select(array_to_vector("f").alias("features"), "label", F.col("n").cast("double").alias("n"))
    least = min(NODE_ROWS / sum(seen.values()), 0.49)  # a node's rows are counted by weight
    gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=64, weightCol="n", minWeightFractionPerNode=least).fit(train)
    model = Model([t._java_obj.rootNode() for t in gbt.trees], list(gbt.treeWeights), {})
    # precision from the top down, by thousandths of the score
    held = rows.where("held").groupBy("k", F.round(model.score(F.col("f")), 3).alias("p")).agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect()
    for k in range(len(KINDS)):
        good = n = 0
        own = sorted((r for r in held if r["k"] == k), key=lambda r: -r["p"])
        for r, lower in zip(own, [*(x["p"] for x in own[1:]), 0.0]):
            good, n = good + r["good"], n + r["n"]
            if good >= PRECISION * n and r["p"] >= 0.5:
                model.thresholds[k] = max(0.5, (r["p"] + lower) / 2)  # halfway to the scores left out
    return model


def find_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: sorted array<struct<s, k, e>>, k numbering KINDS.

    ``base`` holds the rules' spans, ``spans`` these and the chosen proposals; null texts count as
    empty and have none. Columns of these names are replaced, others stay."""
    model = model or fit(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = with_spans(docs.drop("base", "spans"), text)
    spans = F.array_sort(F.concat("__base", model.chosen(F.col("__all"), F.col("__base"))))
    return found.withColumn("spans", spans).withColumnRenamed("__base", "base").drop("__all")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span as [KIND]; spans that overlap become one, named after the first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, x):
        new = x["s"] >= acc["at"]
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.element_at(names, x["k"] + 1))
        return F.struct(F.when(new, put).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], x["e"]).alias("at"))

    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))


def pii_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): one row per row of
    ``docs``, also for repeated rows and null ids; other columns are ignored."""
    found = find_pii(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
                        F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"), listed(F.col("spans"), KINDS).alias("spans"))
