"""Operator 1, URL filters: a path-template tree per host, judged by smoothed labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.llm.shared import materialise, table, typed

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: Shapes of one path segment that are variable whatever stands around them, first match wins.
SHAPES = [
    ("^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "{date}"),
    ("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "{uuid}"),
    ("^[0-9]+$", "{num}"),
    ("^(?=.*[0-9])[0-9a-fA-F]{8,}$", "{hex}"),
]
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty where the url is null or has no ://."""
    whole = url.isNotNull() & F.contains(url, F.lit("://"))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWERED)
    return F.when(whole, host).otherwise(""), F.when(whole, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(verdict, rule); null if none does. rules: (allow or block, host/path)."""
    found = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        its_host, _, its_path = rule.partition("/")
        fits = ((host == its_host) | F.endswith(host, F.lit(f".{its_host}"))) & F.startswith(path, F.lit(f"/{its_path}"))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def shaped(path: Column, max_depth: int | None = None) -> Column:
    """Segments with those of a variable shape generalised (an extension stays); those below max_depth, if it is given, become one **."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")

    def general(s: Column) -> Column:
        ext = F.regexp_extract(s, r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1)
        stem = F.substring(s, F.lit(1), F.length(s) - F.length(ext))
        out = stem
        for pattern, name in reversed(SHAPES):
            out = F.when(stem.rlike(pattern), F.lit(name)).otherwise(out)
        return F.concat(out, ext)

    if max_depth is None:
        return F.transform(segments, general)
    head = F.transform(F.slice(segments, 1, max_depth), general)
    return F.when(F.size(segments) > max_depth, F.concat(head, F.array(F.lit("**")))).otherwise(head)


def template_tree(
    urls: DataFrame, wide: int = 40, rare: float = 0.02, z: float = 1.96, prior: float = 10.0, reject: float = 0.5
) -> DataFrame:
    """Templates of urls (host, segments, labelled, bad): (host, segments, template, pages, labelled, bad, purity, rejected).

    The tree is built from counts of distinct shaped paths, one level a round, down to the deepest path:
    - a literal segment becomes * where its parent has more than wide children
      and the segment has less than the share rare of the parent's pages;
    - siblings above the same set of suffixes whose share of bad labels lies
      within z standard errors of their parent's are merged to (+).
    purity is (bad + prior * base) / (labelled + prior), base being the share
    of bad labels over all urls; templates at or above reject are rejected.
    Counts are summed before every shuffle, so a host's share of rows is harmless.
    """
    paths = materialise(urls.groupBy("host", "segments").agg(F.count("*").alias("pages"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")))
    base = paths.agg(F.sum("bad"), F.sum("labelled"), F.max(F.size("segments"))).first()
    rate = (base[0] or 0) / base[1] if base[1] else 0.0
    depth = base[2] or 0
    tree = paths.withColumn("at", F.lit("")).withColumn("path", F.array_join("segments", "/"))
    for d in range(1, depth + 1):
        node = tree.withColumn("seg", F.get("segments", F.lit(d - 1))).withColumn("rest", F.array_join(F.slice("segments", d + 1, depth), "/"))
        child = (
            node.where("seg IS NOT NULL")
            .groupBy("host", "at", "seg", "rest")
            .agg(*[F.sum(c).alias(c) for c in ("pages", "labelled", "bad")])
            .groupBy("host", "at", "seg")
            .agg(*[F.sum(c).alias(c) for c in ("pages", "labelled", "bad")], F.sum(F.xxhash64("rest").cast("decimal(38,0)")).alias("below"))
        )
        parent = child.groupBy("host", "at").agg(F.count("*").alias("children"), *[F.sum(c).alias(f"all_{c}") for c in ("pages", "labelled", "bad")])
        judged = child.join(parent, ["host", "at"])
        share = F.try_divide("all_bad", "all_labelled")
        error = F.sqrt(F.try_divide(share * (1 - share), F.col("labelled")))
        similar = (F.col("children") > 1) & ((F.col("labelled") == 0) | (F.abs(F.try_divide("bad", "labelled") - share) <= z * error))
        token = F.when((F.col("children") > wide) & (F.col("pages") < rare * F.col("all_pages")), F.lit("*")).otherwise(F.col("seg"))
        judged = judged.select("host", "at", "seg", token.alias("token"), "below", F.coalesce(similar, F.lit(False)).alias("similar"))
        alike = judged.where("similar").groupBy("host", "at", "below").agg(F.count_distinct("token").alias("alike"))
        judged = judged.join(alike, ["host", "at", "below"], "left")
        judged = judged.select("host", "at", "seg", F.when(F.col("similar") & (F.col("alike") > 1), F.lit("(+)")).otherwise(F.col("token")).alias("token"))
        step = node.join(judged, ["host", "at", "seg"], "left")
        tree = step.select("host", "segments", "pages", "labelled", "bad", "path", F.when(F.col("token").isNull(), F.col("at")).otherwise(F.concat("at", F.lit("/"), "token")).alias("at"))
        tree = materialise(tree)
    judged = tree.groupBy("host", "at").agg(*[F.sum(c).alias(f"t_{c}") for c in ("pages", "labelled", "bad")])
    purity = (F.col("t_bad") + F.lit(prior * rate)) / (F.col("t_labelled") + F.lit(prior))
    judged = judged.select("host", "at", F.col("t_pages").alias("pages"), F.col("t_labelled").alias("labelled"), F.col("t_bad").alias("bad"), purity.alias("purity"), (purity >= reject).alias("rejected"))
    return tree.select("host", "segments", "at").join(judged, ["host", "at"]).withColumnRenamed("at", "template")


def url_filter(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], max_depth: int | None = None, **tree) -> DataFrame:
    """Judge every row of pages (page_id, url); labels: (page_id, bad boolean) of some of them.

    Returns page_id, host, path, rule, verdict. The longest rule that fits
    decides; else block if the url's template is rejected, else allow. Null
    urls and urls without :// have empty host and path and are allowed, as no
    template is made of them. Repeated rows are judged alike; of several
    labels of a page one bad one counts. Empty tables give no rows.
    """
    host, path = split_url(F.col("url"))
    urls = typed(pages, page_id="long", url="string").select("page_id", host.alias("host"), path.alias("path")).withColumn("segments", shaped(F.col("path"), max_depth))
    marks = typed(labels, page_id="long", bad="boolean").where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("is_bad"))
    labelled = urls.where("host <> ''").join(marks, "page_id", "left")
    one = F.lit(1).cast("long")
    counted = labelled.select("host", "segments", F.when(F.col("is_bad").isNotNull(), one).otherwise(0).alias("labelled"), F.when(F.col("is_bad"), one).otherwise(0).alias("bad"))
    rejected = template_tree(counted, **tree).where("rejected").select("host", "segments", F.lit(True).alias("rejected"))
    judged = urls.join(rejected, ["host", "segments"], "left").withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("rejected"), F.lit("block")).otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: the labels row of the same number; a page is bad if it has quality 0 or is toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter(table(spark, sf_dir, "pages"), labels, RULES)
