"""Item classes by keyword, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.functions import knowledge as K
from partwise.functions import text as X

GLUED = 5


def keywords() -> list[tuple[str, str, int]]:
    """(keyword, class, weight), longest first, then alphabetically."""
    rows = [(k, c.code, 10 * len(k.split()) + len(k)) for c in K.CLASSES.values() for k in c.keywords]
    return sorted(rows, key=lambda r: (-len(r[0]), r[0]))


def _votes(hays: list[Column], words: list[tuple[str, str, int]]) -> Column:
    """Classes with a keyword in a hay: array of struct(score, first, code), the best first."""
    table = X.constant([{"word": k, "code": c, "weight": w, "at": -i} for i, (k, c, w) in enumerate(words)], "array<struct<word:string,code:string,weight:int,at:int>>")
    hits = F.filter(table, lambda r: F.contains(hays[0], r["word"]) | F.contains(hays[1], r["word"]))

    def of_class(code: Column, found: Column) -> Column:
        own = F.filter(found, lambda r: r["code"] == code)
        score = F.aggregate(own, F.lit(0), lambda s, r: s + r["weight"])
        return F.struct(score.alias("score"), F.get(own, F.lit(0))["at"].alias("first"), code.alias("code"))

    ranked = lambda found: F.transform(F.array_distinct(F.transform(found, lambda r: r["code"])), lambda c: of_class(c, found))
    return F.reverse(F.array_sort(X.let(hits, ranked)))


def classify(cleaned: Column, expanded: Column) -> Column:
    """struct(code, confidence): the class with the highest sum over its keywords; GENERIC at 0.25 if none is found.

    Keywords stand as whole words in the cleaned or the expanded text; if none
    does, those of several words are also looked for without their spaces. Of
    equal sums the class of the first matching keyword wins.
    """
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    # Bound once: both texts are looked through for every keyword.
    both = F.struct(padded(cleaned).alias("c"), padded(expanded).alias("n"))
    glued = [(k.replace(" ", ""), c, w) for k, c, w in keywords() if " " in k and len(k.replace(" ", "")) >= GLUED]
    glued = sorted(glued, key=lambda r: (-len(r[0]), r[0]))
    whole = X.let(both, lambda v: _votes([v["c"], v["n"]], [(f" {k} ", c, w) for k, c, w in keywords()]))
    tight = F.struct(*[F.replace(padded(t), F.lit(" "), F.lit("")).alias(n) for t, n in ((cleaned, "c"), (expanded, "n"))])
    loose = X.let(tight, lambda v: _votes([v["c"], v["n"]], glued))

    def decided(votes: Column) -> Column:
        best, second = F.get(votes, F.lit(0)), F.coalesce(F.get(votes, F.lit(1))["score"], F.lit(0))
        margin = F.try_divide(best["score"] - second, best["score"])
        return F.when(F.size(votes) > 0, F.struct(best["code"].alias("code"), F.round(F.least(0.55 + 0.45 * margin, F.lit(0.99)), 4).alias("confidence")))

    none = F.struct(F.lit(K.GENERIC).alias("code"), F.lit(0.25).alias("confidence"))
    return F.coalesce(X.let(whole, decided), X.let(loose, decided), none)


def engineered(description: Column) -> Column:
    """The first mark of an item made to order that is in the description; null if none."""
    return X.let(X.basic(description), lambda hay: F.get(F.filter(X.strings(K.ENGINEERED), lambda mark: F.contains(hay, mark)), F.lit(0)))


def class_table(spark: SparkSession) -> DataFrame:
    """Facets of every class."""
    rows = [(c.code, c.item_name, c.nsc, c.unspsc, c.hsn, c.eclass, K.VERSION) for c in K.CLASSES.values()]
    return spark.createDataFrame(rows, "class_code string, item_name string, nsc string, unspsc string, hsn string, eclass string, facet_version string")


def attribute_table(spark: SparkSession) -> DataFrame:
    """Attributes of every class in order, with their flags."""
    rows = [(a.code, a.ord, a.key, a.label, a.unit, *[a.has(f) for f in "MBNKSQ"], a.scale or None) for c in K.CLASSES.values() for a in c.attributes]
    return spark.createDataFrame(rows, "class_code string, ord int, key string, label string, unit string, mandatory boolean, blocking boolean, is_number boolean, through_graph boolean, is_standard boolean, is_service boolean, scale string")


def by_class(values: dict[str, object], code: Column, default=None) -> Column:
    """A constant of the class, by a CASE over the classes."""
    out = F.lit(default)
    for c, v in values.items():
        out = F.when(code == c, F.lit(v)).otherwise(out)
    return out
