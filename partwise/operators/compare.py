"""Pairs of records: attribute by attribute comparison, features, typed relation, score and decision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwise.functions import codes
from partwise.functions import knowledge as K
from partwise.functions import text as X
from partwise.operators import kg
from partwise.operators.graph import materialise


def facts(records: DataFrame) -> DataFrame:
    """What pairs are compared by, made once per record: each attribute in the forms that its comparison needs."""
    graph = sorted({a.key for c in K.CLASSES.values() for a in c.attributes if a.has("K")})
    scales = X.mapping({f"{c.code}>{a.key}": a.scale for c in K.CLASSES.values() for a in c.attributes if a.scale})
    ranks = X.mapping({f"{n}>{k}": r for n in K.SCALES for k, r in kg.ranks(n).items()}, "int")
    linked: dict[str, list[str]] = {}
    for x, y in kg.closure():
        linked.setdefault(x, []).append(y)
    near = X.mapping(linked, "array<string>")

    def fact(k: Column, a: Column) -> Column:
        v = a["value"]
        scale = F.try_element_at(scales, F.concat_ws(">", F.col("class_code"), k))
        family = F.when(F.array_contains(X.strings(graph), k), kg.family_of(v))
        return F.struct(
            v.alias("value"),
            X.basic(v).alias("basic"),
            X.plain_key(v).alias("key"),
            a["number"].alias("number"),
            family.alias("family"),
            F.try_element_at(near, family).alias("near"),
            F.try_element_at(ranks, F.concat_ws(">", scale, X.plain_key(v))).alias("rank"),
            F.when(k == "standard", X.plain_key(kg.canonical_standard(v))).alias("standard"),
            F.when(k == "service", F.array_sort(F.split(v, r"\+"))).alias("services"),
        )

    return records.select(
        "id", F.col("cpse_code").alias("org"), "class_code", "own_clean", "identity", "completeness", "coverage", "base_price", "annual_demand",
        X.content_tokens(F.col("own_clean")).alias("words"), F.array_distinct(X.char_ngrams(F.col("own_clean"), 3, 3)).alias("grams"),
        F.map_from_entries(F.transform(F.map_entries("attributes"), lambda e: F.struct(e["key"].alias("key"), fact(e["key"], e["value"]).alias("value")))).alias("facts"),
    )


SPEC = "array<struct<key:string,label:string,mandatory:boolean,blocking:boolean,number:boolean,graph:boolean,standard:boolean,service:boolean,scale:string,serves:boolean,requires:array<string>,dimensional:boolean>>"
DIMENSIONAL = {"nominal_size", "thread", "length_mm", "bore_mm", "csa_sqmm", "designation"}


def specs() -> dict[str, list[dict]]:
    return {
        c.code: [
            {
                "key": a.key, "label": a.label, "mandatory": a.has("M"), "blocking": a.has("B"), "number": a.has("N"), "graph": a.has("K"), "standard": a.has("S"), "service": a.has("Q"),
                "scale": a.scale or None, "serves": K.SCALES[a.scale]["serves"] if a.scale else None, "requires": K.SCALES[a.scale]["requires"] if a.scale else [], "dimensional": a.has("N") or a.key in DIMENSIONAL,
            }
            for a in c.attributes
        ]
        for c in K.CLASSES.values()
    }


def status(s: Column, a: Column, b: Column) -> Column:
    """struct(status, direction) of one attribute s of both records; either side may be null.

    exact, kg_equiv (through the graph or equal on a scale), directed (one
    serves for the other), conflict, missing (on one side), unknown, absent_both.
    """
    ra, rb = a["rank"], b["rank"]
    no_side = a.isNull() | b.isNull()
    same = F.when(a["basic"] == b["basic"], "exact").otherwise("conflict")
    of_number = F.when(a["number"].isNull() | b["number"].isNull(), same).when(a["number"] == b["number"], "exact").otherwise("conflict")
    on_scale = F.when(a["key"] == b["key"], "exact").when(ra.isNull() | rb.isNull(), "unknown").when(ra == rb, "kg_equiv").when(~s["serves"], "conflict").otherwise("directed")
    in_graph = (
        F.when(a["key"] == b["key"], "exact")
        .when(a["family"].isNull() | b["family"].isNull(), "unknown")
        .when(a["family"] == b["family"], "exact")
        .when(F.array_contains(a["near"], b["family"]), "kg_equiv")
        .otherwise("conflict")
    )
    out = (
        F.when(a.isNull() & b.isNull(), "absent_both")
        .when(s["service"], F.when(a["services"] == b["services"], "exact").otherwise("unknown"))
        .when(no_side, "missing")
        .when(s["standard"], F.when(a["standard"] == b["standard"], "exact").otherwise("conflict"))
        .when(s["number"], of_number)
        .when(s["scale"].isNotNull(), on_scale)
        .when(s["graph"], in_graph)
        .otherwise(same)
    )
    direction = F.when(s["scale"].isNotNull() & ~no_side & (ra > rb), "a->b").when(s["scale"].isNotNull() & ~no_side & (ra < rb), "b->a").otherwise("")
    return F.struct(F.coalesce(out, F.lit("unknown")).alias("status"), F.coalesce(direction, F.lit("")).alias("direction"))


def compared(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """pairs (a_id, b_id, ...) with rows, one per attribute of a's class, and the sides' facts.

    Each side is met by one join on its id. records come from facts().
    """
    side = lambda c: records.select(*[F.col(n).alias(f"{c}_{n}") for n in records.columns])
    met = pairs.join(side("a"), "a_id").join(side("b"), "b_id")
    spec = F.try_element_at(X.constant(specs(), f"map<string,{SPEC}>"), F.col("a_class_code"))

    def row(s: Column) -> Column:
        a, b = F.try_element_at("a_facts", s["key"]), F.try_element_at("b_facts", s["key"])
        st = status(s, a, b)
        return F.struct(
            s["key"].alias("key"), s["label"].alias("label"), a["value"].alias("a"), b["value"].alias("b"), s["mandatory"].alias("mandatory"), s["blocking"].alias("blocking"), s["number"].alias("number"),
            s["standard"].alias("standard"), s["service"].alias("service"), s["dimensional"].alias("dimensional"), s["requires"].alias("requires"), st["status"].alias("status"), F.when(st["status"] == "directed", st["direction"]).otherwise("").alias("direction"),
        )

    return met.withColumn("rows", F.transform(spec, row))


def _rows(keep) -> Column:
    return F.filter("rows", keep)


def _n(keep) -> Column:
    return F.size(_rows(keep))


def _is(*names: str):
    return lambda r: r["status"].isin(*names)


# Features in order and their prior weights
PRIORS = {
    "bias": -3.4, "identity_key": 4.2, "exact_ratio": 3.6, "kg_ratio": 2.4, "conflicts": -3.1, "missing_ratio": -0.9, "mandatory_covered": 2.8, "blocking_equal": 2.2,
    "numeric_match": 1.4, "numeric_mismatch": -3.4, "cosine": 1.8, "token_jaccard": 0.9, "trigram": 0.6, "same_class": 1.2, "service_unknown": -2.6, "standard_conflict": -1.3,
}


def with_features(pairs: DataFrame) -> DataFrame:
    """compared pairs (cosine optional) with x, the array of features in the order of PRIORS."""
    if "cosine" not in pairs.columns:
        pairs = pairs.withColumn("cosine", F.lit(0.0))
    there = F.greatest(_n(lambda r: r["status"] != "absent_both"), F.lit(1))
    mandatory, numbers = _n(lambda r: r["mandatory"]), _n(lambda r: r["number"] & (r["status"] != "absent_both"))
    blocking = lambda r: r["blocking"] & (r["status"] != "absent_both")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    x = [
        F.lit(1.0),
        flag(F.arrays_overlap("a_identity", "b_identity")),
        _n(_is("exact")) / there,
        _n(_is("kg_equiv")) / there,
        _n(_is("conflict")).cast("double"),
        _n(_is("missing")) / there,
        F.coalesce(F.try_divide(_n(lambda r: r["mandatory"] & r["status"].isin("exact", "kg_equiv", "directed")), mandatory), F.lit(0.0)),
        flag((_n(blocking) > 0) & (_n(lambda r: blocking(r) & ~r["status"].isin("exact", "kg_equiv")) == 0)),
        _n(lambda r: r["number"] & (r["status"] == "exact")) / F.greatest(numbers, F.lit(1)),
        _n(lambda r: r["number"] & (r["status"] == "conflict")) / F.greatest(numbers, F.lit(1)),
        F.coalesce("cosine", F.lit(0.0)),
        X.jaccard(F.col("a_words"), F.col("b_words")),
        X.jaccard(F.col("a_grams"), F.col("b_grams")),
        flag(F.col("a_class_code") == F.col("b_class_code")),
        flag(_n(lambda r: r["service"] & (r["status"] == "unknown")) > 0),
        flag(_n(lambda r: r["standard"] & (r["status"] == "conflict")) > 0),
    ]
    return pairs.withColumn("x", F.array(*x))


def explained(x: Column, weights: list[float], top: int = 6) -> Column:
    """The features that weigh most in a score: struct(feature, value, weight, contribution)."""
    named = X.constant([{"feature": n, "weight": w} for n, w in zip(PRIORS, weights, strict=True)], "array<struct<feature:string,weight:double>>")
    parts = F.zip_with(named, x, lambda n, v: F.struct((-F.abs(v * n["weight"])).alias("o"), n["feature"].alias("feature"), F.round(v, 4).alias("value"), F.round(n["weight"], 4).alias("weight"), F.round(v * n["weight"], 4).alias("contribution")))
    return F.transform(F.slice(F.array_sort(parts), 1, top), lambda p: p.dropFields("o"))


def series(value: Column) -> Column:
    """The series of a thread; threads of different series are never sizes of one scale."""
    return F.when(value.rlike("(?i)^M.{0,3}[0-9]"), "metric").when(value.rlike("(?i)UNC|UNF|BSW|BSF|UN$"), "unified").when(value.rlike("(?i)NPT|BSP"), "pipe").otherwise("unknown")


def solved(pairs: DataFrame, strict: bool = False) -> DataFrame:
    """compared pairs with relation, direction, blocked_by, proof and reason.

    In this order: other classes DISTINCT; a service qualifier on one side
    UNDETERMINED; a blocking conflict VARIANT_OF if it is the only conflict and
    a size of one scale, else DISTINCT; a directed difference SUBSTITUTABLE if
    what the scale requires agrees and nothing conflicts, else DISTINCT; any
    conflict DISTINCT; a shared identity key, or all mandatory attributes exact
    and nothing by way of the graph, IDENTICAL; else EQUIVALENT. strict: two
    different values that the graph does not know also conflict.
    """
    if strict:
        unknown = lambda r: (r["status"] == "unknown") & ~r["service"] & (r["a"] != r["b"])
        pairs = pairs.withColumn("rows", F.transform("rows", lambda r: r.withField("status", F.when(unknown(r), "conflict").otherwise(r["status"]))))
    conflict = lambda r: r["status"] == "conflict"
    step = pairs.withColumns(
        {
            "conflicts": _rows(conflict),
            "hard": _rows(lambda r: conflict(r) & r["blocking"]),
            "serving": F.get(_rows(_is("directed")), F.lit(0)),
            "by_graph": _rows(_is("kg_equiv")),
            "unsure": F.get(_rows(lambda r: r["service"] & (r["status"] == "unknown")), F.lit(0)),
            "mandatory_rows": _rows(lambda r: r["mandatory"]),
            "same_item": F.arrays_overlap("a_identity", "b_identity"),
        }
    )
    one = F.get("conflicts", F.lit(0))
    sa, sb = series(one["a"]), series(one["b"])
    variant = (F.size("conflicts") == 1) & one["dimensional"] & one["blocking"] & ((one["key"] != "thread") | ((sa == sb) & (sa != "unknown")))
    unmet = F.get(_rows(lambda r: F.array_contains(F.col("serving")["requires"], r["key"]) & ~r["status"].isin("exact", "kg_equiv", "absent_both")), F.lit(0))
    proven = (F.size("mandatory_rows") > 0) & F.forall("mandatory_rows", lambda r: r["status"] == "exact") & (F.size("by_graph") == 0)
    says = lambda relation, by, reason: F.struct(F.lit(relation).alias("relation"), (F.lit(None).cast("string") if by is None else by).alias("blocked_by"), reason.alias("reason"))
    versus = lambda r: F.concat(r["label"], F.lit(" "), F.coalesce(r["a"], F.lit("-")), F.lit(" vs "), F.coalesce(r["b"], F.lit("-")))
    listed = lambda c: F.array_join(F.transform(c, versus), ", ")
    hard = F.get("hard", F.lit(0))
    not_stated = F.filter("mandatory_rows", lambda r: r["status"].isin("missing", "absent_both", "unknown"))
    ladder = (
        F.when(F.col("a_class_code") != F.col("b_class_code"), says("DISTINCT", F.lit("class"), F.concat_ws(" vs ", "a_class_code", "b_class_code")))
        .when(F.col("unsure").isNotNull(), says("UNDETERMINED", F.lit("service_qualifier"), F.lit("service qualifier on one record only; a domain engineer decides")))
        .when((F.size("hard") > 0) & variant, says("VARIANT_OF", None, F.concat(F.lit("same family, other size: "), versus(one))))
        .when(F.size("hard") > 0, says("DISTINCT", hard["key"], F.concat(F.lit("conflict on "), listed(F.col("hard")))))
        .when(F.col("serving").isNotNull() & unmet.isNotNull(), says("DISTINCT", unmet["key"], F.concat(F.lit("would serve, but must match: "), versus(unmet))))
        .when(F.size("conflicts") > 0, says("DISTINCT", None, F.concat(F.lit("conflict on "), listed(F.col("conflicts")))))
        .when(F.col("serving").isNotNull(), says("SUBSTITUTABLE", None, F.concat(F.lit("one serves for the other: "), versus(F.col("serving")))))
        .when(F.col("same_item"), says("IDENTICAL", None, F.lit("same maker's or vendor's number")))
        .when(proven, says("IDENTICAL", None, F.lit("every mandatory attribute agrees")))
        .when(F.size(not_stated) > 0, says("EQUIVALENT", None, F.concat(F.lit("not stated on both: "), F.array_join(F.transform(not_stated, lambda r: r["label"]), ", "))))
        .when(F.size("by_graph") > 0, says("EQUIVALENT", None, F.concat(F.lit("through the standards graph: "), listed(F.col("by_graph")))))
        .otherwise(says("EQUIVALENT", None, F.lit("all that can be compared agrees")))
    )
    weight = lambda r: F.when(r["mandatory"], 2.0).otherwise(1.0)
    worth = lambda r: weight(r) * F.when(r["status"] == "exact", 1.0).when(r["status"] == "kg_equiv", 0.75).when(r["status"] == "directed", 0.5).otherwise(0.0)
    total = lambda f: F.aggregate("rows", F.lit(0.0), lambda s, r: s + f(r))
    step = step.withColumn("verdict", ladder).withColumns(
        {"relation": F.col("verdict.relation"), "blocked_by": F.col("verdict.blocked_by"), "reason": F.col("verdict.reason"), "proof": F.coalesce(F.round(F.try_divide(total(worth), total(weight)), 4), F.lit(0.0))}
    )
    step = step.withColumn("direction", F.when(F.col("relation") == "SUBSTITUTABLE", F.coalesce(F.nullif(F.col("serving.direction"), F.lit("")), F.lit("a->b"))).otherwise(""))
    step = step.withColumn("has_graph_path", (F.size("by_graph") > 0) | (F.col("relation") == "IDENTICAL")).withColumn("n_conflicts", F.size("conflicts")).withColumn("counterfactual", counterfactual())
    return step.drop("verdict", "conflicts", "hard", "serving", "unsure", "mandatory_rows", "by_graph")


def counterfactual() -> Column:
    """What would change the verdict."""
    one, part = F.get("conflicts", F.lit(0)), F.get("by_graph", F.lit(0))
    gap = F.get(_rows(lambda r: (r["status"] == "missing") & r["mandatory"]), F.lit(0))
    low = lambda r: F.lower(r["label"])
    return (
        F.when((F.col("relation") == "UNDETERMINED"), F.lit("the service qualifier on both records would let this be typed"))
        .when((F.col("relation") == "DISTINCT") & one.isNotNull(), F.concat(F.lit("EQUIVALENT would be considered if "), low(one), F.lit(" agreed")))
        .when(F.col("relation") == "DISTINCT", F.lit(None))
        .when(part.isNotNull(), F.concat(F.lit("the same grade of "), low(part), F.lit(" on both would make this IDENTICAL, another one DISTINCT")))
        .when(gap.isNotNull(), F.concat(low(gap), F.lit(" on both, and equal, would make this IDENTICAL")))
    )


# --- scores and decisions ----------------------------------------------------

# Share of wrong decisions allowed by class, and classes that need an identity key
ALPHA = {"VALVE": 0.001, "PIPE": 0.001, "PIPE_FITTING": 0.001, "GASKET": 0.001, "FASTENER_BOLT": 0.001, "FASTENER_NUT": 0.001, "BEARING": 0.01, "CABLE": 0.01, "GENERIC": 0.05}
DEFAULT_ALPHA = 0.01
NEEDS_KEY = ["VALVE", "PIPE", "PIPE_FITTING", "GASKET", "FASTENER_BOLT", "FASTENER_NUT"]


def alpha_of(code: Column) -> Column:
    return F.coalesce(F.try_element_at(X.mapping(ALPHA, "double"), code), F.lit(DEFAULT_ALPHA))


def score(x: Column, weights: list[float] | None = None) -> Column:
    w = F.array(*[F.lit(float(v)) for v in (weights or PRIORS.values())])
    return codes.sigmoid(codes.dot(x, w))


def fit_scorer(x: np.ndarray, y: np.ndarray, start: list[float] | None = None, epochs: int = 400, rate: float = 0.35, l2: float = 0.002, positive: float = 1.0, pull: float = 0.25, times: np.ndarray | None = None) -> tuple[list[float], float]:
    """Gradient descent on the log loss of labelled features, with an L2 penalty and a pull to the priors. (weights, loss). times: how often each row counts, once unless given."""
    cost = np.where(y > 0.5, positive, 1.0) * (1.0 if times is None else times)
    n = float(len(x) if times is None else times.sum())
    return _descent(lambda w: _slope(x, y, cost, w), n, start, epochs, rate, l2, pull)


def _slope(x: np.ndarray, y: np.ndarray, cost: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient of the summed log loss, and behind it the loss."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    loss = -(cost * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum()
    return np.append(x.T @ ((p - y) * cost), loss)


def _descent(slope, n: float, start: list[float] | None, epochs: int, rate: float, l2: float, pull: float) -> tuple[list[float], float]:
    prior = np.array(list(PRIORS.values()))
    w = np.array(start or prior, dtype=float)
    if not n:
        return w.tolist(), float("nan")
    loss = 0.0
    for _ in range(epochs):
        told = slope(w)
        loss = float(told[-1] / n)
        w = w - rate * (told[:-1] / n + l2 * w + pull * (w - prior) / n)
    return w.tolist(), loss


def fit_on_all(labelled: DataFrame, most: int = 100_000, epochs: int = 400, rate: float = 0.35, l2: float = 0.002, pull: float = 0.25) -> tuple[list[float], float]:
    """fit_scorer on every row of labelled (x, label).

    Equal rows are counted first. Up to most different ones are sent to the
    driver; of more, each step sums its gradient where the rows are and sends
    one row a partition. Both give the same weights.
    """
    counted = labelled.groupBy("x", F.col("label").cast("double").alias("y")).agg(F.count("*").cast("double").alias("n"))
    counted = materialise(counted.select(*[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(len(PRIORS))], "y", "n"))
    names = [f"x{i}" for i in range(len(PRIORS))]
    parts = lambda t: (np.column_stack([t.column(c).to_numpy(zero_copy_only=False) for c in names]), *[t.column(c).to_numpy(zero_copy_only=False) for c in ("y", "n")])
    different, n = counted.agg(F.count("*"), F.sum("n")).first()
    if different <= most:
        x, y, times = parts(counted.orderBy(*names, "y").toArrow())
        return fit_scorer(x, y, None, epochs, rate, l2, 1.0, pull, times)

    def slope(w: np.ndarray) -> np.ndarray:
        def run(batches):
            total = np.zeros(len(names) + 1)
            for b in batches:
                x, y, times = parts(b)
                total += _slope(x, y, times, w)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

        return np.sum([r.s for r in kept.mapInArrow(run, "s array<double>").collect()], axis=0)

    kept = counted.persist()
    try:
        return _descent(slope, float(n), None, epochs, rate, l2, pull)
    finally:
        kept.unpersist()


def evaluate(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Confusion, precision, recall and F1 of scored labels (score, label)."""
    yes, true = F.col("score") >= threshold, F.col("label") == 1
    n = scored.agg(F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & true).alias("fn"), F.count_if(~yes & ~true).alias("tn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return n.select("*", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 4).alias("f1"))


def order_statistic(scores: DataFrame, group: str, value: str, q: Column, name: str) -> DataFrame:
    """By group, the value of rank ceil((n + 1) q), at least 1 and at most n, of its sorted values; exact.

    Equal values are counted before they are ordered, so the window holds
    distinct values only.
    """
    counts = scores.groupBy(group, value).agg(F.count("*").alias("_c"), F.first(q).alias("_q"))
    w = Window.partitionBy(group).orderBy(value)
    whole = Window.partitionBy(group)
    step = counts.withColumn("_until", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(whole))
    # The product is rounded, so that a rank that is a whole number stays one.
    rank = F.greatest(F.lit(1), F.least(F.col("_n"), F.ceil(F.round((F.col("_n") + 1) * F.col("_q"), 9))))
    return step.where(F.col("_until") >= rank).groupBy(group).agg(F.min(value).alias(name))


def thresholds(scored: DataFrame, least: int = 12) -> DataFrame:
    """Conformal thresholds by class of scored labels (class_code, score, label): accept, reject, n_positive, n_negative, fallback.

    accept is the (1 - alpha) order statistic of the negatives, reject the
    alpha one of the positives; a class with fewer than `least` labels takes
    those of all classes together, the row of class *. Floors: accept within
    0.55..0.999, reject within 0.001..min(accept - 0.05, 0.5); without
    negatives accept is 0.95, without positives reject 0.05.
    """
    own = scored.select("class_code", "score", "label")
    pooled = own.withColumn("class_code", F.lit("*"))
    both = own.unionByName(pooled)
    alpha = alpha_of(F.col("class_code"))
    counts = both.groupBy("class_code").agg(F.count_if(F.col("label") == 1).alias("n_positive"), F.count_if(F.col("label") != 1).alias("n_negative"))

    def floored(df: DataFrame, alpha_class: Column) -> DataFrame:
        accept = F.least(F.greatest(F.least(F.coalesce("accept", F.lit(0.95)), F.lit(0.999)), F.lit(0.55)), F.lit(0.999))
        df = df.withColumn("accept", accept)
        reject = F.least(F.greatest(F.coalesce("reject", F.lit(0.05)), F.lit(0.001)), F.least(F.col("accept") - 0.05, F.lit(0.5)))
        return df.withColumn("reject", F.round(reject, 6)).withColumn("accept", F.round("accept", 6)).withColumn("alpha", alpha_class)

    accept = order_statistic(both.where("label <> 1"), "class_code", "score", 1 - alpha, "accept")
    reject = order_statistic(both.where("label = 1"), "class_code", "score", alpha, "reject")
    raw = counts.join(accept, "class_code", "left").join(reject, "class_code", "left")
    few = counts.where((F.col("n_positive") + F.col("n_negative") < least) & (F.col("class_code") != "*")).select("class_code", alpha.alias("own"))
    # A class with few labels takes the quantiles of all labels at its own alpha, of which there are a handful.
    every = own.groupBy("score", "label").agg(F.count("*").alias("c")).crossJoin(F.broadcast(few.select("own").distinct()))
    w, n = Window.partitionBy("own", "label").orderBy("score"), Window.partitionBy("own", "label")
    q = F.when(F.col("label") == 1, F.col("own")).otherwise(1 - F.col("own"))
    ordered = every.withColumn("until", F.sum("c").over(w)).withColumn("n", F.sum("c").over(n)).where(F.col("until") >= F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.round((F.col("n") + 1) * q, 9)))))
    shared = ordered.groupBy("own").agg(F.min(F.when(F.col("label") != 1, F.col("score"))).alias("accept_all"), F.min(F.when(F.col("label") == 1, F.col("score"))).alias("reject_all"))
    out = raw.join(few.select("class_code", "own", F.lit(True).alias("fallback")).join(shared, "own", "left").drop("own"), "class_code", "left")
    out = out.withColumn("fallback", F.coalesce("fallback", F.lit(False)))
    out = out.withColumn("accept", F.when(F.col("fallback"), F.col("accept_all")).otherwise(F.col("accept"))).withColumn("reject", F.when(F.col("fallback"), F.col("reject_all")).otherwise(F.col("reject")))
    return floored(out.drop("accept_all", "reject_all"), alpha)


def decided(pairs: DataFrame, calibration: DataFrame | None = None) -> DataFrame:
    """Solved and scored pairs with tier (auto_accept, review, auto_reject) and why.

    calibration comes from thresholds() and has one row a class; a class
    without one takes the row *; without any, 0.95 and 0.05, and nothing is
    accepted unseen.
    """
    if calibration is None:
        met = pairs.withColumns({"accept": F.lit(0.95), "reject": F.lit(0.05), "points": F.lit(0)})
    else:
        by_class = calibration.select(F.col("class_code").alias("a_class_code"), F.struct("accept", "reject", (F.col("n_positive") + F.col("n_negative")).alias("points")).alias("t"))
        pooled = calibration.where("class_code = '*'").select(F.struct("accept", "reject", (F.col("n_positive") + F.col("n_negative")).alias("points")).alias("u"))
        met = pairs.join(F.broadcast(by_class.where("a_class_code <> '*'")), "a_class_code", "left").join(F.broadcast(pooled), how="left")
        found = F.coalesce("t", "u")
        met = met.withColumns({"accept": F.coalesce(found["accept"], F.lit(0.95)), "reject": F.coalesce(found["reject"], F.lit(0.05)), "points": F.coalesce(found["points"], F.lit(0))}).drop("t", "u")
    needs = F.col("a_class_code").isin(NEEDS_KEY)
    high = F.col("score") >= F.col("accept")
    proved = F.col("same_item") | F.col("has_graph_path") | (F.col("relation") == "IDENTICAL")
    says = lambda tier, why: F.struct(F.lit(tier).alias("tier"), F.lit(why).alias("why"))
    ladder = (
        F.when(F.col("relation") == "DISTINCT", says("auto_reject", "hard conflict"))
        .when(F.col("relation") == "UNDETERMINED", says("review", "an attribute that cannot be inferred is missing"))
        .when(F.col("relation").isin("SUBSTITUTABLE", "VARIANT_OF"), says("review", "never merged by a machine"))
        .when(F.col("score") <= F.col("reject"), says("auto_reject", "score at or below the reject threshold"))
        .when(high & (F.col("points") == 0), says("review", "class not calibrated"))
        .when(high & needs & ~F.col("same_item"), says("review", "class needs an identity key"))
        .when(high & ~proved, says("review", "no identity key and no path in the graph"))
        .when(high, says("auto_accept", "score above the accept threshold and identity established"))
        .otherwise(says("review", "score between the thresholds"))
    )
    return met.withColumn("_d", ladder).withColumns({"tier": F.col("_d.tier"), "why": F.col("_d.why")}).drop("_d", "points")


def precision_by_tier(decisions: DataFrame) -> DataFrame:
    """Labelled decisions (tier, label): rows and share of true matches by tier."""
    return decisions.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg(F.col("label").cast("double")), 6).alias("match_rate"))


def annual_spend() -> Column:
    side = lambda c: F.coalesce(F.col(f"{c}_annual_demand"), F.lit(0.0)) * F.coalesce(F.col(f"{c}_base_price"), F.lit(0.0))
    return F.round(side("a") + side("b"), 2)


def priority(score: Column, spend: Column, size: Column | int = 2) -> Column:
    """What a steward's answer is worth: doubt, times cluster size, times spend."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.round((1 - 2 * F.abs(score - 0.5)) * (1 + F.sqrt(F.greatest(size - 1, F.lit(0)).cast("double"))) * (1 + F.sqrt(F.greatest(spend, F.lit(0.0))) / 100), 6)


def substitutions(decisions: DataFrame) -> DataFrame:
    """Directed edges: from serves for to."""
    forth = F.col("direction") == "a->b"
    return decisions.where("relation = 'SUBSTITUTABLE'").select(F.when(forth, F.col("a_id")).otherwise(F.col("b_id")).alias("from_id"), F.when(forth, F.col("b_id")).otherwise(F.col("a_id")).alias("to_id"), "score", "reason")


# --- labels ------------------------------------------------------------------


def said() -> Column:
    """What a record says of its identity: array of struct(source, key); 0 a vendor's number, 1 a maker's, 2 the values of all attributes where the mandatory ones are stated."""
    letters = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    mandatory = F.try_element_at(X.constant({c.code: c.keys("M") for c in K.CLASSES.values()}, "map<string,array<string>>"), F.col("class_code"))
    stated = F.size(F.array_except(mandatory, F.map_keys("attributes"))) == 0
    vector = F.array_join(F.transform(F.array_sort(F.map_keys("attributes")), lambda k: F.concat(k, F.lit("="), letters(F.element_at("attributes", k)["value"]))), "|")
    return F.concat(
        F.transform("identity", lambda k: F.struct(F.when(F.startswith(k, F.lit("vmn:")), 0).otherwise(1).alias("source"), k.alias("key"))),
        F.when(stated & (F.length(vector) > 12), F.array(F.struct(F.lit(2).alias("source"), F.concat_ws("|", "class_code", vector).alias("key")))).otherwise(F.array().cast("array<struct<source:int,key:string>>")),
    )


def positives(records: DataFrame, most: int = 60) -> DataFrame:
    """Pairs that are the same item by what the records say: (a, b, label, source, weight).

    A shared vendor's, then a maker's number across organisations; then, weight
    0.6, equal values of all attributes where the mandatory ones are stated.
    Groups of 2 to `most` rows; the first source of a pair counts.
    """
    keyed = records.select("id", F.col("cpse_code").alias("org"), F.explode(said()).alias("k")).select("id", "org", "k.*")
    sizes = keyed.groupBy("source", "key").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("source", "key")
    kept = keyed.join(sizes, ["source", "key"], "left_semi")
    a, b = (kept.select("source", "key", F.col("id").alias(c), F.col("org").alias(f"o{c}")) for c in "ab")
    met = a.join(b, ["source", "key"]).where((F.col("a") < F.col("b")) & ((F.col("source") == 2) | (F.col("oa") != F.col("ob"))))
    first = met.groupBy("a", "b").agg(F.min("source").alias("s"))
    return first.select("a", "b", F.lit(1).alias("label"), F.element_at(F.array(F.lit("vmn"), F.lit("mpn"), F.lit("classification")), F.col("s") + 1).alias("source"), F.when(F.col("s") == 2, 0.6).otherwise(1.0).alias("weight"))


def nearly() -> Column:
    """Whether a compared pair is of one class, with a single conflict and two or more agreements."""
    return (F.col("a_class_code") == F.col("b_class_code")) & (_n(_is("conflict")) == 1) & (_n(_is("exact", "kg_equiv")) >= 2)


def labelled(pairs: DataFrame, records: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """All compared pairs whose label is known: 1 by the rules of positives, else 0 if they nearly agree; stewards' decisions count before both.

    Pairs are looked at one by one, so groups may be of any size.
    """
    side = lambda c: records.select(F.col("id").alias(f"{c}_id"), said().alias(f"{c}_said"))
    met = pairs.join(side("a"), "a_id").join(side("b"), "b_id")
    values = F.filter("a_said", lambda s: s["source"] == 2)
    same = F.arrays_overlap(values, "b_said") | ((F.col("a_org") != F.col("b_org")) & F.arrays_overlap("a_said", "b_said"))
    label = F.when(same, 1).when(nearly(), 0)
    if decisions is not None:
        told = steward_labels(decisions).dropDuplicates(["a", "b"]).select(F.col("a").alias("a_id"), F.col("b").alias("b_id"), F.col("label").alias("told"))
        met, label = met.join(told, ["a_id", "b_id"], "left"), F.coalesce("told", label)
    return met.withColumn("label", label).where("label IS NOT NULL").drop("a_said", "b_said", "told")


def hard_negatives(pairs: DataFrame, positive: DataFrame, most: int = 4000) -> DataFrame:
    """Compared pairs that nearly agree and are no positives; `most` of them, drawn by a hash of their ids."""
    rows = pairs.where(nearly()).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    out = rows.join(positive.select("a", "b"), ["a", "b"], "left_anti").orderBy(F.xxhash64("a", "b"), "a", "b").limit(most)
    return out.select("a", "b", F.lit(0).alias("label"), F.lit("hard_negative").alias("source"), F.lit(1.0).alias("weight"))


def easy_negatives(records: DataFrame, positive: DataFrame, seed: int = 7) -> DataFrame:
    """For every record one of another class, drawn by a hash: the record that follows it in hash order among those of the next class."""
    hashed = records.select("id", "class_code", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(4096)).alias("slot"))
    slots = hashed.groupBy("class_code", "slot").agg(F.min("id").alias("other"))
    some = F.broadcast(slots.groupBy("class_code").agg(F.min_by("other", "slot").alias("any")))
    order = Window.orderBy("class_code")
    following = F.broadcast(some.select("class_code", F.coalesce(F.lead("class_code").over(order), F.first("class_code").over(order)).alias("next"), F.coalesce(F.lead("any").over(order), F.first("any").over(order)).alias("any")))
    met = hashed.join(following, "class_code").where("class_code <> next").join(slots.select(F.col("class_code").alias("next"), "slot", "other"), ["next", "slot"], "left")
    partner = F.coalesce("other", "any")
    out = met.select(F.least("id", partner).alias("a"), F.greatest("id", partner).alias("b")).where("a <> b").distinct().join(positive.select("a", "b"), ["a", "b"], "left_anti")
    return out.select("a", "b", F.lit(0).alias("label"), F.lit("easy_negative").alias("source"), F.lit(0.5).alias("weight"))


def steward_labels(decisions: DataFrame) -> DataFrame:
    """Stewards' decisions (a_id, b_id, decision) as labels."""
    yes = F.col("decision").isin("endorse", "merge", "approve")
    return decisions.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), F.when(yes, 1).otherwise(0).alias("label"), F.lit("steward").alias("source"), F.lit(1.0).alias("weight"))


def evidence_card(redact: bool = False) -> Column:
    """Struct of all that a pair's verdict rests on; redact leaves prices and demand out."""
    money = F.lit(None).cast("double")
    view = lambda c: F.struct(F.col(f"{c}_id").alias("id"), F.col(f"{c}_org").alias("organisation"), F.col(f"{c}_own_clean").alias("description"), F.col(f"{c}_class_code").alias("class_code"), (money if redact else F.col(f"{c}_base_price")).alias("base_price"), (money if redact else F.col(f"{c}_annual_demand")).alias("annual_demand"))
    ratio = F.round(F.try_divide(F.greatest("a_base_price", "b_base_price"), F.least("a_base_price", "b_base_price")), 4)
    return F.struct(view("a").alias("a"), view("b").alias("b"), F.col("rows").alias("attributes"), F.col("relation"), F.col("direction"), F.col("blocked_by"), F.col("proof"), F.col("score"), F.col("tier"), F.col("why"), F.col("reason"), F.col("counterfactual"), (money if redact else ratio).alias("price_ratio"), explained(F.col("x"), list(PRIORS.values())).alias("contributions"))


def narrative() -> Column:
    return F.concat_ws(" ", F.concat(F.lit("Records "), "a_id", F.lit(" and "), "b_id", F.lit(" are "), "relation", F.lit(":")), F.concat("reason", F.lit(".")), F.concat(F.lit("Score "), F.format_number("score", 3), F.lit(", "), "tier", F.lit(".")))
