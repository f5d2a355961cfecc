"""The standards graph: designations in text, and verdicts on pairs of values, from lookup tables closed on the driver."""

from __future__ import annotations

from functools import cache
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.functions import knowledge as K
from partwise.functions import text as X

SHORT = 3
MAX_HOPS = 3


def key(value: str) -> str:
    """plain_key of a fixed ASCII value, on the driver."""
    return "".join(c for c in value.upper() if c not in " .-_\t")


@cache
def aliases() -> tuple[tuple[str, str], ...]:
    """(alias key, family), longest first and then by family backwards; a later family takes over a shared alias."""
    names: dict[str, str] = {}
    for family, (_, _, values) in K.FAMILIES.items():
        for v in [*values, family]:
            names[key(v)] = family
    return tuple(sorted(names.items(), key=lambda r: (len(r[0]), r[1]), reverse=True))


@cache
def service_aliases() -> tuple[tuple[str, str], ...]:
    names: dict[str, str] = {}
    for service, (_, _, values) in K.SERVICES.items():
        for v in [*values, service]:
            names[key(v)] = service
    return tuple(names.items())


def bounded(alias: str) -> str | None:
    """A name that begins or ends in a digit where no further digit touches that end, whatever separates its signs; null for other names."""
    if not (alias[0].isdigit() or alias[-1].isdigit()):
        return None
    return ("(?<![0-9])" if alias[0].isdigit() else "") + r"[\s.\-_]*".join(alias) + ("(?![0-9])" if alias[-1].isdigit() else "")


def _named(value: Column, cleaned: Column, names: tuple[tuple[str, str], ...]) -> Column:
    """Meanings of the names in value, each once: a short name as a token of its own, a longer one anywhere in the key, but not out of a longer number."""
    table = X.constant([{"alias": a, "meaning": m, "short": len(a) <= SHORT, "bounds": bounded(a)} for a, m in names], "array<struct<alias:string,meaning:string,short:boolean,bounds:string>>")

    def told(v: Column) -> Column:
        long = lambda r: F.contains(v["whole"], r["alias"]) & (r["bounds"].isNull() | F.rlike(v["basic"], r["bounds"]))
        return F.filter(table, lambda r: F.when(r["short"], F.array_contains(v["own"], r["alias"])).otherwise(long(r)))

    keyed = lambda b: F.struct(b.alias("basic"), F.regexp_replace(b, r"[\s.\-_]+", "").alias("whole"), F.transform(X.tokens(cleaned), X.plain_key).alias("own"))
    return F.array_distinct(F.transform(X.let(X.let(X.basic(value), keyed), told), lambda r: r["meaning"]))


def find_designations(value: Column, cleaned: Column | None = None) -> Column:
    """Every family named in free text, the longest name first."""
    return _named(value, X.clean(value) if cleaned is None else cleaned, aliases())


def family_of(value: Column) -> Column:
    exact = X.mapping(dict(aliases()))
    longest = tuple(sorted(aliases(), key=lambda r: -len(r[0])))
    return F.coalesce(F.try_element_at(exact, X.plain_key(value)), F.get(_named(value, X.clean(value), longest), F.lit(0)))


def find_services(value: Column, cleaned: Column | None = None) -> Column:
    return _named(value, X.clean(value) if cleaned is None else cleaned, service_aliases())


def canonical_standard(value: Column) -> Column:
    """The successor of a withdrawn standard, else the value."""
    k, out = X.plain_key(value), value
    for old, new, _ in reversed(K.SUPERSEDED):
        o = key(old)
        out = F.when((k == o) | (F.contains(k, F.lit(o)) if len(o) >= 5 else F.lit(False)), F.lit(new)).otherwise(out)
    return out


# --- verdict tables ----------------------------------------------------------


@cache
def closure() -> dict[tuple[str, str], list[tuple[str, str, str, bool, str]]]:
    """Shortest paths of at most MAX_HOPS links between different families, links walked both ways; of equally short ones the one found first."""
    near: dict[str, list] = {}
    for a, b, kind, partial, citation in K.LINKS:
        near.setdefault(a, []).append((a, b, kind, partial, citation))
        near.setdefault(b, []).append((b, a, kind, partial, citation))
    out: dict[tuple[str, str], list] = {}
    for start in K.FAMILIES:
        reached, paths = {start}, [(start, [])]
        for _ in range(MAX_HOPS):
            grown = []
            for at, path in paths:
                for link in near.get(at, []):
                    if link[1] not in reached:
                        reached.add(link[1])
                        grown.append((link[1], [*path, link]))
                        out[start, link[1]] = grown[-1][1]
            paths = grown
    return out


DIRECTED = {"gradeSatisfiedBy", "variantOf", "castEquivalentOf", "sourServiceVariantOf", "memberOf"}


def material_rows() -> list[tuple]:
    """(a, b, relation, partial, hops, citation) of every pair of families."""
    rows = []
    for a, b in product(K.FAMILIES, repeat=2):
        path = closure().get((a, b))
        if a == b:
            rows.append((a, b, "IDENTICAL", False, 0, K.FAMILIES[a][1]))
        elif path is None:
            rows.append((a, b, "CONFLICT", False, None, ""))
        else:
            partial = any(p[3] or p[2] in DIRECTED for p in path)
            rows.append((a, b, "EQUIVALENT", partial, len(path), " / ".join(dict.fromkeys(p[4] for p in path))))
    return rows


def material_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(material_rows(), "fa string, fb string, relation string, partial boolean, hops int, citation string")


@cache
def ranks(scale: str) -> dict[str, int]:
    """Rank of each value's key; values that are equal share that of the first of them."""
    spec = K.SCALES[scale]
    head = {key(v): key(group[0]) for group in spec["equal"] for v in group}
    out: dict[str, int] = {}
    for value in spec["values"]:
        k = key(value)
        h = head.get(k, k)
        if h not in out:
            out[h] = len(set(out.values()))
        out[k] = out[h]
    return out


def scale_table(spark: SparkSession) -> DataFrame:
    rows = [(scale, k, r, K.SCALES[scale]["serves"], K.SCALES[scale]["requires"]) for scale in K.SCALES for k, r in ranks(scale).items()]
    return spark.createDataFrame(rows, "scale string, value_key string, rank int, serves boolean, requires array<string>")


def _lookup(values: dict[str, object], k: Column) -> Column:
    kind = {bool: "boolean", int: "int", str: "string"}[type(next(iter(values.values())))]
    return F.try_element_at(X.mapping(values, kind), k)


def verdict_material(a: Column, b: Column) -> Column:
    """IDENTICAL, EQUIVALENT, CONFLICT or UNKNOWN of two designations, either of which may be null."""
    fa, fb = family_of(a), family_of(b)
    linked = {f"{x}>{y}": "EQUIVALENT" for x, y in closure()}
    return (
        F.when(F.coalesce(a, F.lit("")).eqNullSafe("") | F.coalesce(b, F.lit("")).eqNullSafe(""), "UNKNOWN")
        .when(X.plain_key(a) == X.plain_key(b), "IDENTICAL")
        .when(fa.isNull() | fb.isNull(), "UNKNOWN")
        .when(fa == fb, "IDENTICAL")
        .otherwise(F.coalesce(_lookup(linked, F.concat(fa, F.lit(">"), fb)), F.lit("CONFLICT")))
    )


def verdict_ordered(scale: Column, a: Column, b: Column) -> Column:
    """struct(relation, direction) of two values on a scale; the higher one serves for the lower where the scale allows it."""
    rank = {f"{s}>{k}": r for s in K.SCALES for k, r in ranks(s).items()}
    serves = {s: spec["serves"] for s, spec in K.SCALES.items()}
    ka, kb = X.plain_key(a), X.plain_key(b)
    ra, rb = (_lookup(rank, F.concat(scale, F.lit(">"), k)) for k in (ka, kb))
    relation = (
        F.when(_lookup(serves, scale).isNull(), "UNKNOWN")
        .when(ka == kb, "IDENTICAL")
        .when(ra.isNull() | rb.isNull(), "UNKNOWN")
        .when(ra == rb, "EQUIVALENT")
        .when(~_lookup(serves, scale), "CONFLICT")
        .otherwise("SUBSTITUTABLE")
    )
    return F.struct(relation.alias("relation"), F.when(relation == "SUBSTITUTABLE", F.when(ra > rb, "a->b").otherwise("b->a")).otherwise("").alias("direction"))


def verdict_service(a: Column, b: Column) -> Column:
    """IDENTICAL for equal sets of qualifiers, else UNKNOWN: what is not stated is not known."""
    none = F.lit("")
    same = F.array_sort(find_services(F.coalesce(a, none))) == F.array_sort(find_services(F.coalesce(b, none)))
    return F.when(same, "IDENTICAL").otherwise("UNKNOWN")


def verdict_standard(a: Column, b: Column) -> Column:
    return (
        F.when(F.coalesce(a, F.lit("")).eqNullSafe("") | F.coalesce(b, F.lit("")).eqNullSafe(""), "UNKNOWN")
        .when(X.plain_key(canonical_standard(a)) == X.plain_key(canonical_standard(b)), "IDENTICAL")
        .otherwise("CONFLICT")
    )


def stats(spark: SparkSession) -> DataFrame:
    rows = [("families", len(K.FAMILIES)), ("aliases", len(aliases())), ("links", len(K.LINKS)), ("scales", len(K.SCALES)), ("services", len(K.SERVICES)), ("superseded", len(K.SUPERSEDED))]
    return spark.createDataFrame(rows, "what string, n int")
