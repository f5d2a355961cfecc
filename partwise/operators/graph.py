"""Written intermediate tables, global ranks, connected components and constrained pivot clustering."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one is set only where none is named and everything runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="partwise-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: a short plan over durable files."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that materialise wrote and that no plan will read again."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def per_value(df: DataFrame, names: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns that make adds to the table of its different values of names: each value is worked on once, however many rows say it.

    That table is written, in partitions enough for all cores; null meets null.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    made = materialise(make(df.select(*names).distinct().repartition(parts, *names)))
    # The hash comes first among the keys, so that rows are sorted by a number.
    told = made.select(F.xxhash64(*names).alias("_at"), *[F.col(c).alias(f"_{c}") if c in names else F.col(c) for c in made.columns])
    same = F.col("_here") == F.col("_at")
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.withColumn("_here", F.xxhash64(*names)).join(told, same).drop("_here", "_at", *[f"_{c}" for c in names])


def ranked(df: DataFrame, *order: Column | str, running: Iterable[str] = ()) -> DataFrame:
    """df with rank, from 1 in the given order, and run_<c>, the running sum of each column of running.

    Rows are range-partitioned, ranked within partitions, and carried on from
    the totals of the partitions before, of which there is one row each.
    """
    names = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = df.repartitionByRange(*names).withColumn("_part", F.spark_partition_id())
    sums = [F.sum(c).alias(f"_sum_{c}") for c in running]
    dealt = materialise(dealt)
    totals = dealt.groupBy("_part").agg(F.count("*").alias("_n"), *sums)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_from_{c}") for c in running])
    own = Window.partitionBy("_part").orderBy(*names)
    grown = own.rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn("_own", F.row_number().over(own))
    for c in running:
        out = out.withColumn(f"_own_{c}", F.sum(c).over(grown))
    out = out.join(F.broadcast(totals), "_part").withColumn("rank", F.col("_before") + F.col("_own"))
    for c in running:
        out = out.withColumn(f"run_{c}", F.col(f"_from_{c}") + F.col(f"_own_{c}"))
    return out.drop("_part", "_before", "_own", *[f"_from_{c}" for c in running], *[f"_own_{c}" for c in running])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root): the smallest id of the connected component of each id in edges (a, b).

    Large-star and small-star rounds; each keeps at most as many edges as the
    one before and ends in stars. A round is written to the shared folder.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def star(e: DataFrame, small: bool) -> DataFrame:
        # (u, v), u > v. small: each u links its smaller neighbours to the smallest; large: its larger ones.
        near = e if small else e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        linked = near.join(least, "u")
        if small:
            out = linked.select(F.col("v").alias("x"), "m").union(least.select(F.col("u").alias("x"), "m"))
        else:
            out = linked.where("v > u").select(F.col("v").alias("x"), "m")
        return out.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = digest(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        last, edges = edges, materialise(star(star(edges, False), True))
        now = digest(edges)
        forget(last)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def with_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node (id) with the root of its component; a node without edges is its own."""
    found = components(edges)
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def pivot_one(nodes: list[int], edges: list[tuple[int, int, float]], must: list[tuple[int, int]], cannot: list[tuple[int, int]], max_size: int) -> dict[int, int]:
    """Clusters of one component: node to pivot.

    Nodes that must stay together are one. The node with the greatest weight of
    links (then most links, then smallest id) takes its linked neighbours, the
    strongest first, but none that may not be with a member, nor more than
    max_size nodes; then the next node that is left.
    """
    group = {n: n for n in nodes}

    def top(n: int) -> int:
        while group[n] != n:
            group[n] = group[group[n]]
            n = group[n]
        return n

    for a, b in must:
        x, y = sorted((top(a), top(b)))
        group[y] = x
    size: dict[int, int] = {}
    for n in nodes:
        size[top(n)] = size.get(top(n), 0) + 1
    near: dict[int, dict[int, float]] = {n: {} for n in size}
    for a, b, w in edges:
        x, y = top(a), top(b)
        if w > 0 and x != y:
            near[x][y] = near[y][x] = max(near[x].get(y, 0.0), w)
    apart: dict[int, set[int]] = {}
    for a, b in cannot:
        x, y = top(a), top(b)
        if x != y:
            apart.setdefault(x, set()).add(y)
            apart.setdefault(y, set()).add(x)
    owner: dict[int, int] = {}
    for pivot in sorted(size, key=lambda n: (-sum(near[n].values()), -len(near[n]), n)):
        if pivot in owner:
            continue
        owner[pivot] = pivot
        banned, total = set(apart.get(pivot, ())), size[pivot]
        for other, _ in sorted(near[pivot].items(), key=lambda kv: (-kv[1], kv[0])):
            if other in owner or other in banned or total + size[other] > max_size:
                continue
            owner[other] = pivot
            banned |= apart.get(other, set())
            total += size[other]
    return {n: owner[top(n)] for n in nodes}


def cluster(nodes: DataFrame, edges: DataFrame, must: DataFrame | None = None, cannot: DataFrame | None = None, max_size: int = 60) -> DataFrame:
    """(id, cluster_id) of nodes (id) by constrained pivot clustering; cluster_id is the cluster's smallest id.

    edges: (a, b, weight), must and cannot: (a, b). A pivot never reaches
    beyond its component, so components are clustered apart, in parallel, and
    the result is that of one run over all. Only nodes with links are grouped.
    """
    spark = nodes.sparkSession
    none = spark.createDataFrame([], "a long, b long, weight double")
    kinds = [edges.select("a", "b", F.col("weight").cast("double").alias("weight"), F.lit("edge").alias("kind"))]
    for df, kind in ((must, "must"), (cannot, "cannot")):
        kinds.append((none if df is None else df).select("a", "b", F.lit(0.0).alias("weight"), F.lit(kind).alias("kind")))
    links = kinds[0].where("weight > 0").union(kinds[1])
    roots = materialise(components(links))
    told = kinds[0].union(kinds[1]).union(kinds[2])
    at = told.join(roots.withColumnRenamed("id", "a"), "a").join(roots.select(F.col("id").alias("b"), F.col("root").alias("root_b")), "b").where("root = root_b")

    def run(pdf):
        import pandas as pd  # only workers of this function need it

        rows = {k: list(g[["a", "b", "weight"]].itertuples(index=False, name=None)) for k, g in pdf.groupby("kind")}
        members = sorted(set(pdf.a) | set(pdf.b))
        pairs = lambda k: [r[:2] for r in rows.get(k, [])]
        owner = pivot_one(members, rows.get("edge", []), pairs("must"), pairs("cannot"), max_size)
        least: dict[int, int] = {}
        for n in members:
            least[owner[n]] = min(least.get(owner[n], n), n)
        return pd.DataFrame({"id": members, "cluster_id": [least[owner[n]] for n in members]})

    found = at.select("root", "a", "b", "weight", "kind").groupBy("root").applyInPandas(run, "id long, cluster_id long")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("cluster_id", "id").alias("cluster_id"))


def disagreement(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Weight of positive edges between clusters plus that of negative ones within."""
    side = lambda c: clusters.select(F.col("id").alias(c), F.col("cluster_id").alias(f"c{c}"))
    met = edges.join(side("a"), "a").join(side("b"), "b")
    cost = F.when((F.col("weight") > 0) & (F.col("ca") != F.col("cb")), F.col("weight")).when((F.col("weight") < 0) & (F.col("ca") == F.col("cb")), -F.col("weight")).otherwise(0.0)
    return met.agg(F.round(F.sum(cost), 6).alias("disagreement"))


def purity(clusters: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of rows that have the majority label (truth: id, label) of their cluster, and clusters with several labels."""
    counts = clusters.join(truth, "id").groupBy("cluster_id", "label").agg(F.count("*").alias("n"))
    best = counts.groupBy("cluster_id").agg(F.max("n").alias("most"), F.sum("n").alias("size"), F.count("*").alias("labels"))
    return best.agg(F.round(F.sum("most") / F.sum("size"), 6).alias("purity"), F.count_if(F.col("labels") > 1).alias("impure"), F.count("*").alias("clusters"))


def cluster_pairs(clusters: DataFrame, most: int = 60) -> DataFrame:
    """Pairs (a, b) of rows of one cluster; clusters hold at most `most` rows."""
    a, b = clusters.select("cluster_id", F.col("id").alias("a")), clusters.select("cluster_id", F.col("id").alias("b"))
    return a.join(b, "cluster_id").where("a < b").select("a", "b")


def precision_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """True and false positives, false negatives, precision, recall and F1 of two sets of pairs (a, b)."""
    both = found.select("a", "b").distinct().withColumn("f", F.lit(1)).join(truth.select("a", "b").distinct().withColumn("t", F.lit(1)), ["a", "b"], "full")
    n = both.agg(F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return n.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"))
