"""Queries over the driver's tables, one per operator, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.functions import codes as Z
from partwise.functions import knowledge as K
from partwise.functions import text as X
from partwise.functions import uom as U
from partwise.operators import analytics as A
from partwise.operators import blocking as B
from partwise.operators import classify as C
from partwise.operators import compare as M
from partwise.operators import extract as E
from partwise.operators import federation as D
from partwise.operators import graph as G
from partwise.operators import kg
from partwise.operators import ledger as L
from partwise.operators import registry as R
from partwise.operators import service as S
from partwise.plans import harmonise as H
from partwise.plans.material import MATERIAL_SQL, material
from partwise.streaming import live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function as the query of its name."""
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MAT = f"WITH m AS ({MATERIAL_SQL}), "
PACK = "CASE WHEN uom IN ('BOX', 'COIL') THEN 100.0 ELSE 1.0 END"
MEMBERS = MAT + f"members AS (SELECT *, CAST(item AS VARCHAR) AS nmc, id AS member, round(unit_price / ({PACK}), 6) AS base_price FROM m), "


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The material view with its true item as the code of each row and the unit that its different texts give."""
    def read(texts: DataFrame) -> DataFrame:
        return texts.withColumn("own_clean", X.clean(F.col("description"))).withColumn("unit", U.resolve(F.col("uom"), F.col("own_clean")))

    def make() -> DataFrame:
        m = G.per_value(view(spark, sf_dir), ["description", "uom"], read).withColumn("base_price", U.base_price(F.col("unit_price"), F.col("unit")))
        return m.withColumn("nmc", F.col("item").cast("string")).withColumn("member", F.col("id"))

    return _once(spark, sf_dir, "members", make, written=False)


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The material view, written once."""
    return _once(spark, sf_dir, "view", lambda: material(spark, sf_dir))


def described(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """The material view with the columns that make adds to its different descriptions."""
    return G.per_value(view(spark, sf_dir), ["description"], make)


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical records: the view, and what was read from its different texts, both written; a query joins what it needs of them."""
    return _once(spark, sf_dir, "canonical", lambda: E.canonical(view(spark, sf_dir), more=lambda read: B.with_text_keys(read).withColumn("spec", spec_key())), written=False)


_WRITTEN: dict[tuple, DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make, written: bool = True) -> DataFrame:
    """A table that several queries share, made once per application and input, and written unless it is a short plan over tables that are."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _WRITTEN:
        made = make()
        _WRITTEN[at] = G.materialise(made) if written else made
    return _WRITTEN[at]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical records with their keys and with spec, which records that say the same share."""
    return B.with_keys(canonical(spark, sf_dir))


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The material view with its identity keys only."""
    return G.materialise(material(spark, sf_dir).withColumn("keys", B.identity_keys()))


def spec_key() -> Column:
    """One value for all records of a class whose attributes have the same values."""
    said = F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["value"])))
    return F.concat_ws("|", "class_code", F.array_join(said, ";"))


def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the records that say the same one, that with the smallest id; the others are its members by spec."""
    recs = records(spark, sf_dir)
    return _once(spark, sf_dir, "representatives", lambda: recs.join(recs.groupBy("spec").agg(F.min("id").alias("id")).select("id"), "id", "left_semi"))


def close_pairs(recs: DataFrame) -> DataFrame:
    """Pairs of representatives that share any key, however many share it."""
    return G.materialise(B.key_pairs(recs, None, across=False))


# --- sources and text --------------------------------------------------------


@query(MATERIAL_SQL)
def src_material(spark, d):
    return material(spark, d)


def _clean_sql(c: str) -> str:
    steps = [
        (r"""[^A-Z0-9.#"''+%/\s-]""", " "), (r"([0-9])\s*X\s*([0-9])", r"\1 X \2"), (r"([0-9])\s*X\s*([0-9])", r"\1 X \2"), (r"([0-9])(MM|CM|KG|MTR|SQMM|MM2|KV|V|NB|IN|INCH)\b", r"\1 \2"),
        (r"\.", ". "), (r"- ", "-"), (r"\s+", " "), (r"([0-9])\.\s+([0-9])", r"\1.\2"), (r"\s+\.\s*", " "), (r"\s+", " "),
    ]
    out = f"regexp_replace(upper({c}), '[,;|\\t\\n\\r\\\\]+', ' ', 'g')"
    for pattern, to in steps:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"trim({out})"


CLEAN = MAT + f"c AS (SELECT id, {_clean_sql('description')} AS clean FROM m), "
NOISE = ", ".join(f"'{w}'" for w in K.NOISE)
WORDS = CLEAN + f"w AS (SELECT id, clean, list_filter(string_split(clean, ' '), lambda t: length(t) > 1 AND NOT list_contains([{NOISE}], t)) AS words FROM c) "


@query(CLEAN.rstrip(", ") + " SELECT id, clean FROM c")
def txt_clean(spark, d):
    return described(spark, d, lambda t: t.withColumn("clean", X.clean(F.col("description")))).select("id", "clean")


@query(WORDS + "SELECT id, CAST(len(string_split(clean, ' ')) AS INT) AS n_tokens, CAST(len(words) AS INT) AS n_content, array_to_string(words, ' ') AS content FROM w")
def txt_tokens(spark, d):
    def read(t: DataFrame) -> DataFrame:
        c = t.withColumn("c", X.clean(F.col("description")))
        return c.select("description", F.size(X.tokens(F.col("c"))).alias("n_tokens"), F.size(X.content_tokens(F.col("c"))).alias("n_content"), F.array_join(X.content_tokens(F.col("c")), " ").alias("content"))

    return described(spark, d, read).select("id", "n_tokens", "n_content", "content")


@query(
    WORDS
    + "SELECT id, CASE WHEN len(words) = 0 THEN 0.0 ELSE round(least(least(len(words) / 8.0::DOUBLE, 1.0::DOUBLE) * 0.40::DOUBLE + least(length(clean) / 45.0::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE"
    " + CASE WHEN len(list_filter(words, lambda t: regexp_matches(t, '[0-9]'))) > 0 THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END + least(len(list_distinct(words)) / 6.0::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE, 1.0::DOUBLE), 4) END AS completeness FROM w"
)
def txt_completeness(spark, d):
    return described(spark, d, lambda t: t.withColumn("completeness", X.completeness(X.clean(F.col("description"))))).select("id", "completeness")


def normal(spark: SparkSession, d: str) -> DataFrame:
    return described(spark, d, lambda t: t.withColumn("normal", X.normalise(F.col("description"))))


@query()
def txt_expand(spark, d):
    return normal(spark, d).select("id", "normal")


@query("SELECT p_partkey, CAST(len(g) AS INT) AS grams, CAST(len(list_distinct(g)) AS INT) AS different FROM (SELECT p_partkey, list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3)) AS g FROM (SELECT p_partkey, ' ' || p_name || ' ' AS p FROM part))")
def txt_char_ngrams(spark, d):
    g = X.char_ngrams(F.col("p_name"), 3, 3)
    return table(spark, d, "part").select("p_partkey", F.size(g).alias("grams"), F.size(F.array_distinct(g)).alias("different"))


NEXT = "SELECT a.p_partkey, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"


def _next_part(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("x"))
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("y")), "p_partkey")


@query(f"SELECT p_partkey, CAST(levenshtein(substr(upper(x), 1, 64), substr(upper(y), 1, 64)) AS INT) AS distance FROM ({NEXT})")
def txt_levenshtein(spark, d):
    return _next_part(spark, d).select("p_partkey", X.levenshtein(F.col("x"), F.col("y")).alias("distance"))


@query(
    f"SELECT p_partkey, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE END, 9) AS similarity FROM (SELECT p_partkey, list_distinct(list_transform(range(1, length(x) + 1), lambda i: substr(' ' || upper(x) || ' ', i, 3))) AS a,"
    f" list_distinct(list_transform(range(1, length(y) + 1), lambda i: substr(' ' || upper(y) || ' ', i, 3))) AS b FROM ({NEXT}))"
)
def txt_trigram_sim(spark, d):
    return _next_part(spark, d).select("p_partkey", F.round(X.trigram_similarity(F.col("x"), F.col("y")), 9).alias("similarity"))


@query()
def txt_token_jaccard(spark, d):
    return _next_part(spark, d).select("p_partkey", F.round(X.token_jaccard(X.clean(F.col("x")), X.clean(F.col("y"))), 9).alias("similarity"))


@query()
def lex_mine(spark, d):
    return B.mine_shorthand(material(spark, d).select("id", X.clean(F.col("description")).alias("own_clean")))


# --- units -------------------------------------------------------------------


@query(MEMBERS.rstrip(", ") + " SELECT id, CASE WHEN uom IN ('M', 'COIL') THEN 'length' ELSE 'count' END AS dimension, uom IN ('BOX', 'COIL') AS is_pack, " + PACK + "::DOUBLE AS qty_per_uom FROM members")
def uom_resolve(spark, d):
    return members(spark, d).select("id", "unit.dimension", "unit.is_pack", "unit.qty_per_uom")


@query(MEMBERS.rstrip(", ") + " SELECT id, base_price FROM members")
def uom_base_price(spark, d):
    return members(spark, d).select("id", "base_price")


@query(MEMBERS.rstrip(", ") + " SELECT id, CASE WHEN uom IN ('M', 'COIL') THEN round(stock_qty * (" + PACK + ") / 1000, 6) END AS km FROM members")
def uom_convert(spark, d):
    km = U.resolve(F.lit("KM"), F.lit(""))
    return members(spark, d).select("id", F.round(U.convert(F.col("stock_qty"), F.col("unit"), km), 6).alias("km"))


@query(
    MEMBERS
    + "e AS (SELECT nmc, arg_min(struct_pack(org := cpse_code, p := unit_price, b := base_price), (unit_price, member)) AS lo, arg_max(struct_pack(org := cpse_code, p := unit_price, b := base_price), (unit_price, member)) AS hi FROM members GROUP BY nmc HAVING count(*) >= 2 AND count(DISTINCT cpse_code) >= 2),"
    " r AS (SELECT nmc, lo.org AS low_org, hi.org AS high_org, round(hi.p / lo.p, 4) AS raw_ratio, round(greatest(hi.b, lo.b) / least(hi.b, lo.b), 4) AS normalised_ratio FROM e)"
    " SELECT *, raw_ratio > 3 AND normalised_ratio < 1.5 AS explained_by_unit FROM r WHERE raw_ratio > 2.5 ORDER BY raw_ratio DESC, nmc LIMIT 25"
)
def an_uom_anomaly(spark, d):
    return A.price_anomalies(members(spark, d))


# --- classes and attributes --------------------------------------------------


@query(MAT.rstrip(", ") + " SELECT id, CASE item % 4 WHEN 0 THEN 'BEARING' WHEN 1 THEN 'FASTENER_BOLT' WHEN 2 THEN 'PIPE' ELSE 'VALVE' END AS class_code FROM m")
def cls_classify(spark, d):
    def read(t: DataFrame) -> DataFrame:
        c = t.withColumn("c", X.clean(F.col("description"))).withColumn("n", X.expand(F.col("c")))
        return c.select("description", C.classify(F.col("c"), F.col("n"))["code"].alias("class_code"))

    return described(spark, d, read).select("id", "class_code")


@query(MAT.rstrip(", ") + " SELECT id, FALSE AS made_to_order FROM m")
def cls_engineered(spark, d):
    return described(spark, d, lambda t: t.withColumn("made_to_order", C.engineered(F.col("description")).isNotNull())).select("id", "made_to_order")


@query(
    MAT
    + "d AS (SELECT id, CASE WHEN description LIKE '%DEEP GROOVE' THEN regexp_extract(description, '([0-9]{5})RS', 1) ELSE regexp_extract(description, '([0-9]{4})', 1) END AS d, description LIKE '%DEEP GROOVE' AS glued FROM m WHERE item % 4 = 0), e AS (SELECT *, CAST(right(d, 2) AS INT) AS n FROM d)"
    " SELECT id, CASE WHEN n <= 96 THEN d || CASE WHEN glued THEN '-RS' ELSE '-2RS' END END AS designation, CASE WHEN n = 0 THEN 10.0 WHEN n = 1 THEN 12.0 WHEN n = 2 THEN 15.0 WHEN n = 3 THEN 17.0 WHEN n <= 96 THEN n * 5.0 END::DOUBLE AS bore FROM e"
)
def ext_bearing(spark, d):
    def read(t: DataFrame) -> DataFrame:
        c = t.withColumn("b", E.bearing(F.concat(F.lit(" "), X.clean(F.col("description")), F.lit(" "))))
        return c.select("description", F.col("b.designation.value").alias("designation"), F.col("b.bore_mm.number").alias("bore"))

    return G.per_value(view(spark, d).where("item % 4 = 0"), ["description"], read).select("id", "designation", "bore")


@query(MAT.rstrip(", ") + """ SELECT id, regexp_extract(description, '([0-9]+)(?:"| INCH|NB)', 1) || '"' AS size, CASE WHEN item % 4 = 2 THEN 'SCH' || regexp_extract(description, 'SCH(?:EDULE)? ?([0-9]+)', 1) END AS schedule, CASE WHEN item % 4 = 3 THEN regexp_extract(description, '([0-9]+)(?:#| A216| WCB)', 1) END AS pressure FROM m WHERE item % 4 >= 2""")
def ext_size(spark, d):
    def read(t: DataFrame) -> DataFrame:
        h = t.withColumn("h", F.concat(F.lit(" "), X.clean(F.col("description")), F.lit(" ")))
        return h.select("description", E.nominal_size(F.col("h"))["value"].alias("size"), E.schedule(F.col("h"))["value"].alias("schedule"), E.pressure_class(F.col("h"))["value"].alias("pressure"))

    m = G.per_value(view(spark, d).where("item % 4 >= 2"), ["description"], read)
    return m.select("id", "size", F.when(F.col("item") % 4 == 2, F.col("schedule")).alias("schedule"), F.when(F.col("item") % 4 == 3, F.col("pressure")).alias("pressure"))


@query()
def ext_attributes(spark, d):
    """Every attribute of every record with its provenance."""
    return E.trace(canonical(spark, d)).select("id", "class_code", "key", "value", "number", "confidence", "source")


@query()
def ext_coverage(spark, d):
    c = canonical(spark, d)
    return c.select("id", "class_code", "coverage", F.array_join(E.missing_mandatory(F.col("class_code"), F.col("attributes")), ",").alias("missing"))


@query()
def render_golden(spark, d):
    code, a = F.col("class_code"), F.col("attributes")
    shown = {"golden": E.golden_description(code, a), "short": E.short_description(code, a), "hindi": E.golden_description(code, a, E.HINDI)}
    return E.canonical(view(spark, d), more=lambda read: read.select(*E.TEXTS, "unit", *[c.alias(n) for n, c in shown.items()])).select("id", *shown)


# --- graph -------------------------------------------------------------------

_LINKS = ", ".join(f"('{a}', '{b}')" for a, b, *_ in K.LINKS)
_FAMILIES = ", ".join(f"('{f}')" for f in K.FAMILIES)


@query(
    f"WITH RECURSIVE link(a, b) AS (SELECT * FROM (VALUES {_LINKS}) t(a, b) UNION ALL SELECT b, a FROM (VALUES {_LINKS}) t(a, b)), fam(f) AS (SELECT * FROM (VALUES {_FAMILIES}) t(f)),"
    " walk(a, b, n) AS (SELECT f, f, 0 FROM fam UNION ALL SELECT w.a, l.b, w.n + 1 FROM walk w JOIN link l ON l.a = w.b WHERE w.n < 3), best AS (SELECT a, b, min(n) AS n FROM walk GROUP BY a, b)"
    " SELECT x.f AS fa, y.f AS fb, CASE WHEN x.f = y.f THEN 'IDENTICAL' WHEN n IS NULL THEN 'CONFLICT' ELSE 'EQUIVALENT' END AS relation, CAST(coalesce(n, -1) AS INT) AS hops FROM fam x CROSS JOIN fam y LEFT JOIN best ON best.a = x.f AND best.b = y.f"
)
def kg_closure(spark, d):
    return kg.material_table(spark).select("fa", "fb", "relation", F.coalesce("hops", F.lit(-1)).alias("hops"))


@query()
def kg_material(spark, d):
    names = kg.material_table(spark).select("fa", "fb")
    return names.select("fa", "fb", kg.verdict_material(F.col("fa"), F.col("fb")).alias("relation"))


@query()
def kg_ordered(spark, d):
    s = kg.scale_table(spark)
    both = s.select("scale", F.col("value_key").alias("a")).join(s.select("scale", F.col("value_key").alias("b")), "scale")
    return both.select("scale", "a", "b", kg.verdict_ordered(F.col("scale"), F.col("a"), F.col("b")).alias("v")).select("scale", "a", "b", "v.*")


@query()
def kg_standard(spark, d):
    rows = spark.createDataFrame([(o, n) for o, n, _ in K.SUPERSEDED] + [("IS 2062", "IS 2063")], "a string, b string")
    return rows.select("a", "b", kg.canonical_standard(F.col("a")).alias("now"), kg.verdict_standard(F.col("a"), F.col("b")).alias("relation"))


@query()
def kg_service(spark, d):
    read = lambda t: t.select("description", F.array_join(kg.find_services(F.col("description")), "+").alias("services"), F.array_join(kg.find_designations(F.col("description")), "+").alias("families"))
    return described(spark, d, read).select("id", "services", "families")


@query()
def kg_stats(spark, d):
    return kg.stats(spark)


# --- candidate pairs ---------------------------------------------------------

KEYS = MAT + (
    "k AS (SELECT id, cpse_code, 'mpn:' || mfr_name || '|' || replace(mfr_part_no, '-', '') AS key FROM m WHERE mfr_part_no IS NOT NULL UNION ALL SELECT id, cpse_code, 'vmn:' || vendor_id || '|' || vendor_matl_no FROM m WHERE vendor_matl_no IS NOT NULL AND length(vendor_matl_no) >= 3), "
    "s AS (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 400), p AS (SELECT a.id AS a_id, b.id AS b_id, a.key FROM k a JOIN k b ON a.key = b.key AND a.id < b.id AND a.cpse_code <> b.cpse_code WHERE a.key IN (SELECT key FROM s)) "
)


@query(KEYS + "SELECT a_id, b_id, string_agg(DISTINCT left(key, 3), ',' ORDER BY left(key, 3)) AS strategies FROM p GROUP BY a_id, b_id")
def blk_identity(spark, d):
    return B.key_pairs(keyed(spark, d)).select("a_id", "b_id", F.array_join("strategies", ",").alias("strategies"))


@query(KEYS + "SELECT left(key, 3) AS strategy, count(DISTINCT (a_id, b_id)) AS pairs FROM p GROUP BY 1")
def blk_strategy_mix(spark, d):
    return B.strategy_mix(B.key_pairs(keyed(spark, d)))


@query(KEYS + "SELECT id, substr(sha256('s|' || key), 1, 24) AS h FROM k")
def blk_hashed(spark, d):
    return keyed(spark, d).select("id", F.explode(B.hashed_keys("s")).alias("h"))


@query(
    KEYS
    + ", t AS (SELECT a.id AS a_id, b.id AS b_id FROM m a JOIN m b ON a.item = b.item AND a.id < b.id AND a.cpse_code <> b.cpse_code), f AS (SELECT DISTINCT a_id, b_id FROM p) SELECT count(*) AS truth, count(f.a_id) AS found, round(count(f.a_id) / count(*)::DOUBLE, 6) AS recall FROM t LEFT JOIN f USING (a_id, b_id)"
)
def blk_recall(spark, d):
    m = keyed(spark, d)
    a, b = (m.select("item", F.col("id").alias(f"{c}_id"), F.col("cpse_code").alias(f"o{c}")) for c in "ab")
    truth = a.join(b, "item").where("a_id < b_id AND oa <> ob")
    return B.recall(B.key_pairs(m), truth)


@query()
def blk_attr(spark, d):
    return canonical(spark, d).select("id", F.explode(F.filter("text_keys", lambda k: ~F.startswith(k, F.lit("tok:")))).alias("key"))


@query()
def blk_tokens(spark, d):
    return canonical(spark, d).select("id", F.explode(F.filter("text_keys", lambda k: F.startswith(k, F.lit("tok:")))).alias("key"))


@query()
def blk_pairs(spark, d):
    """All pairs by every key, told by the kinds of keys that they share: how many, and two sums over their ids that change with any pair."""
    met = B.key_pairs(G.materialise(records(spark, d).select("id", "cpse_code", "keys"))).withColumn("strategies", F.array_join("strategies", ","))
    mixed = F.pmod(F.col("a_id") * 7919 + F.col("b_id"), F.lit(1_000_003))
    return met.groupBy("strategies").agg(F.count("*").alias("pairs"), F.sum(F.col("a_id") * 31 + F.col("b_id")).alias("checksum"), F.sum(mixed).alias("mixed"))


# --- vectors -----------------------------------------------------------------


@query(
    "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.vec_id AS id, b.vec_id AS other, round(list_cosine_similarity(a.e, b.e), 12) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"
    " SELECT id, CAST(n AS INT) AS place, other FROM (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS n FROM s) WHERE n <= 5"
)
def vec_topk(spark, d):
    from pyspark.sql import Window

    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(None).cast("string").alias("org"), F.col("embedding").alias("vector"))
    best = B.nearest(v, 5, v.where("id % 50 = 0"), across=False)
    return best.select("id", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other")).alias("place"), "other")


@query()
def vec_idf(spark, d):
    r = normal(spark, d).select("id", "normal")
    return B.document_frequency(r).select("feature", "df", F.round("idf", 6).alias("idf"))


@query()
def vec_hash_embed(spark, d):
    r = normal(spark, d).select("id", "cpse_code", "normal")
    v = B.embed(r, idf=B.document_frequency(r))
    return v.select("id", F.round(Z.dot(F.col("vector"), F.col("vector")), 4).alias("size2"), F.size("vector").alias("dim"))


@query()
def vec_cutoff(spark, d):
    """Pairs by makers' and vendors' numbers with the cosine of their descriptions."""
    recs = G.materialise(records(spark, d).select("id", "cpse_code", "identity", "normal"))
    v = G.materialise(B.embed(recs, 64))
    pairs = B.pair_cosine(B.key_pairs(recs.withColumn("keys", F.col("identity"))), v)
    return B.survivors(pairs, recs).select("a_id", "b_id", F.round("cosine", 4).alias("cosine"))


# --- verdicts ----------------------------------------------------------------


def _judged(spark, d) -> DataFrame:
    """Verdicts on pairs of representatives: what holds for them holds for the records that say the same."""
    recs = representatives(spark, d)
    return _once(spark, d, "judged", lambda: H.verdicts(close_pairs(recs), recs))


@query()
def cmp_attributes(spark, d):
    return _judged(spark, d).select("a_id", "b_id", F.explode("rows").alias("r")).select("a_id", "b_id", "r.key", "r.status").groupBy("key", "status").agg(F.count("*").alias("pairs"))


@query()
def rel_solve(spark, d):
    return _judged(spark, d).select("a_id", "b_id", "relation", "direction", "blocked_by", "proof", "reason")


@query()
def feat_vector(spark, d):
    return _judged(spark, d).select("a_id", "b_id", *[F.round(F.get("x", F.lit(i)), 6).alias(n) for i, n in enumerate(M.PRIORS)], F.round("score", 6).alias("score"))


@query()
def dec_tier(spark, d):
    done = M.decided(_judged(spark, d)).withColumn("spend", M.annual_spend())
    return done.select("a_id", "b_id", "tier", "why", "spend", M.priority(F.col("score"), F.col("spend")).alias("priority"))


@query()
def sub_edges(spark, d):
    """Directed edges between representatives, such as pipes that differ in schedule only."""
    return M.substitutions(_judged(spark, d)).select("from_id", "to_id", F.round("score", 6).alias("score"))


@query()
def evi_card(spark, d):
    done = M.decided(_judged(spark, d))
    return done.select("a_id", "b_id", F.to_json(M.evidence_card(redact=True)).alias("card"), M.narrative().alias("narrative"))


@query()
def lab_positive(spark, d):
    return M.positives(records(spark, d)).select("a", "b", "source", "weight")


@query()
def lab_negative(spark, d):
    recs, judged = records(spark, d), _judged(spark, d)
    positive = G.materialise(M.positives(recs))
    return M.hard_negatives(judged, positive).unionByName(M.easy_negatives(recs, positive))


@query()
def fit_scorer(spark, d):
    recs = records(spark, d)
    judged = _judged(spark, d)
    _, weights, _ = H.training(judged, recs)
    return spark.createDataFrame([(n, float(w), float(p)) for (n, p), w in zip(M.PRIORS.items(), weights, strict=True)], "feature string, weight double, prior double")


@query(
    "WITH s AS (SELECT l_returnflag AS class_code, round(l_discount * 10, 6) AS score, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS label FROM lineitem), b AS (SELECT * FROM s UNION ALL SELECT '*', score, label FROM s),"
    " g AS (SELECT class_code, count(*) FILTER (WHERE label = 1) AS n_positive, count(*) FILTER (WHERE label <> 1) AS n_negative, list_sort(list(score) FILTER (WHERE label <> 1)) AS neg, list_sort(list(score) FILTER (WHERE label = 1)) AS pos FROM b GROUP BY class_code),"
    " r AS (SELECT class_code, n_positive, n_negative, least(greatest(least(coalesce(neg[greatest(1, least(n_negative, CAST(ceil(round((n_negative + 1) * 0.99::DOUBLE, 9)) AS BIGINT)))], 0.95), 0.999), 0.55), 0.999) AS accept, coalesce(pos[greatest(1, least(n_positive, CAST(ceil(round((n_positive + 1) * 0.01::DOUBLE, 9)) AS BIGINT)))], 0.05) AS reject FROM g)"
    " SELECT class_code, n_positive, n_negative, round(accept, 6)::DOUBLE AS accept, round(least(greatest(reject, 0.001), least(accept - 0.05, 0.5)), 6)::DOUBLE AS reject FROM r"
)
def conf_thresholds(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("class_code"), F.round(F.col("l_discount") * 10, 6).alias("score"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("label"))
    return M.thresholds(s).select("class_code", "n_positive", "n_negative", "accept", "reject")


# --- clusters and registry ---------------------------------------------------


@query("WITH RECURSIVE up(id, spot) AS (SELECT p_partkey, p_partkey FROM part UNION ALL SELECT id, spot // 2 FROM up WHERE spot % 5 <> 0 AND spot > 1) SELECT id, min(spot) AS root FROM up GROUP BY id")
def clu_components(spark, d):
    """Components of the graph that links each part to that of half its number, but for multiples of five."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    edges = p.where("id % 5 <> 0 AND id > 1").select(F.col("id").alias("a"), F.floor(F.col("id") / 2).alias("b"))
    return G.with_components(p, edges)


def _clusters(spark, d) -> tuple[DataFrame, DataFrame]:
    """Records and their clusters: representatives are clustered, and each record goes with the one that says the same."""
    recs, judged = records(spark, d), _judged(spark, d)
    same = judged.where("relation IN ('IDENTICAL', 'EQUIVALENT')").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round("score", 9).alias("weight"))
    apart = judged.where("relation = 'DISTINCT'").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    reps = representatives(spark, d)

    def all_records() -> DataFrame:
        found = reps.select("id", "spec").join(G.cluster(reps, same, cannot=apart), "id").select("spec", "cluster_id")
        return recs.select("id", "spec").join(found, "spec").select("id", "cluster_id")

    return recs, _once(spark, d, "clusters", all_records)


@query()
def clu_pivot(spark, d):
    return _clusters(spark, d)[1]


@query()
def clu_purity(spark, d):
    recs, clusters = _clusters(spark, d)
    return G.purity(clusters, recs.select("id", F.col("spec").alias("label")))


@query()
def golden_record(spark, d):
    return R.golden_records(*_clusters(spark, d))


@query()
def nmc_mint(spark, d):
    recs, clusters = _clusters(spark, d)
    return R.mint(R.golden_records(recs, clusters)).select("cluster_id", "serial", "nmc")


@query("SELECT p_partkey, TRUE AS parsed, TRUE AS valid, FALSE AS wrong_digit_valid FROM part")
def nmc_validate(spark, d):
    p = table(spark, d, "part").withColumn("nmc", Z.mint(F.col("p_partkey"), F.lit("3110")))
    digit = F.regexp_extract("nmc", "/(.)", 1).cast("int")
    wrong = F.concat(F.regexp_extract("nmc", "^[^/]*/", 0), ((digit + 1) % 10).cast("string"))
    return p.select("p_partkey", Z.validate(F.regexp_replace("nmc", "-", " "))["parsed"].alias("parsed"), Z.validate(F.col("nmc"))["valid"].alias("valid"), Z.validate(wrong)["valid"].alias("wrong_digit_valid"))


@query(MEMBERS.rstrip(", ") + " SELECT nmc, count(*) AS members, count(DISTINCT cpse_code) AS orgs FROM members GROUP BY nmc HAVING count(DISTINCT cpse_code) >= 2")
def reg_groups(spark, d):
    m = members(spark, d).withColumns({"class_code": F.lit(""), "golden_description": F.lit("")})
    return R.groups(m, 2).select("nmc", F.size("members").cast("long").alias("members"), "orgs")


@query(MEMBERS.rstrip(", ") + " SELECT nmc, count(*) AS members FROM members WHERE cpse_code = 'ORG03' AND contains(description, 'VALVE') GROUP BY nmc ORDER BY nmc LIMIT 50")
def reg_search(spark, d):
    m = members(spark, d).withColumns({"class_code": F.lit("VALVE"), "golden_description": F.col("description")})
    found = R.search(m, "valve", "VALVE", "ORG03")
    return found.groupBy("nmc").agg(F.sum("members").alias("members"))


@query(MAT.rstrip(", ") + " SELECT cpse_code, count(*) AS materials, count(DISTINCT plant) AS plants FROM m GROUP BY cpse_code")
def reg_organisations(spark, d):
    return R.organisations(material(spark, d))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM part UNION ALL SELECT p_partkey + 10000000, 'new' FROM part WHERE p_partkey % 7 = 0")
def reg_upsert(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    old = p.select("k", F.lit("old").alias("v"), F.lit(1).alias("at"))
    new = p.where("k % 3 = 0").select("k", F.lit("new").alias("v"), F.lit(1).alias("at")).union(p.where("k % 7 = 0").select(F.col("k") + 10_000_000, F.lit("new"), F.lit(1)))
    return R.upsert(old, new, ["k"], "at").select("k", "v")


@query()
def erp_change_requests(spark, d):
    m = members(spark, d).withColumns({"class_code": F.lit("VALVE"), "golden_description": F.col("description")})
    return R.change_requests(m)


# --- ledger ------------------------------------------------------------------

LOG = "WITH log AS (SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'SPLIT' ELSE 'MERGED' END AS event_type, CAST(user_id % 97 AS VARCHAR) AS nmc, user_id AS member FROM events) "


def _log(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "SPLIT").otherwise("MERGED")
    payload = F.to_json(F.struct((F.col("user_id") % 97).cast("string").alias("nmc"), F.array("user_id").alias("members")))
    return e.select("event_id", kind.alias("event_type"), payload.alias("payload_json"), F.lit("engine").alias("actor"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))


@query()
def led_chain(spark, d):
    return L.chain_by_day(_log(spark, d)).select("seq", "day", "event_type", "prev_hash", "hash")


@query("SELECT CAST(10 * r AS BIGINT) AS seq, FALSE AS hash_ok FROM range(1, (SELECT count(*) // 10 + 1 FROM events)) t(r)")
def led_verify(spark, d):
    """Every tenth event is changed after it was chained; these are found, and no other."""
    chained = G.materialise(L.chain_by_day(_log(spark, d)))
    forged = chained.withColumn("payload_json", F.when(F.col("seq") % 10 == 0, F.concat("payload_json", F.lit(" "))).otherwise(F.col("payload_json")))
    return L.verify(forged, "day").select("seq", "hash_ok")


@query()
def led_merkle(spark, d):
    return L.merkle_roots(G.materialise(L.chain_by_day(_log(spark, d))))


@query(LOG + "SELECT nmc, member FROM log GROUP BY nmc, member HAVING arg_max(event_type, seq) = 'MERGED'")
def led_replay(spark, d):
    return L.replay(_log(spark, d).withColumnRenamed("event_id", "seq"))


@query(LOG + "SELECT nmc, member FROM log WHERE seq <= (SELECT max(seq) // 2 FROM log) GROUP BY nmc, member HAVING arg_max(event_type, seq) = 'MERGED'")
def led_replay_upto(spark, d):
    log = _log(spark, d).withColumnRenamed("event_id", "seq")
    return L.replay(log, log.agg(F.max("seq")).first()[0] // 2)


@query(LOG + "SELECT nmc, member, 'log' AS \"where\" FROM log GROUP BY nmc, member HAVING arg_max(event_type, seq) = 'MERGED' AND member % 11 = 0")
def led_projection_diff(spark, d):
    log = _log(spark, d).withColumnRenamed("event_id", "seq")
    return L.projection_difference(log, L.replay(log).where("member % 11 <> 0"))


# --- analytics ---------------------------------------------------------------


@query(MAT.rstrip(", ") + " SELECT CASE item % 4 WHEN 0 THEN 'BEARING' WHEN 1 THEN 'FASTENER_BOLT' WHEN 2 THEN 'PIPE' ELSE 'VALVE' END AS class_code, count(*) AS records FROM m GROUP BY 1")
def an_by_class(spark, d):
    return A.by_class(canonical(spark, d)).select("class_code", "records")


@query(MAT.rstrip(", ") + " SELECT cpse_code, count(*) AS records, count(*) AS active, CAST(0 AS BIGINT) AS quarantine, CAST(0 AS BIGINT) AS excluded FROM m GROUP BY 1")
def an_by_org(spark, d):
    return A.by_organisation(canonical(spark, d))


@query(MEMBERS.rstrip(", ") + " SELECT CAST(item % 4 AS INT) AS class_code, count(*) AS members, count(DISTINCT nmc) AS codes, round(1 - count(DISTINCT nmc) / count(*)::DOUBLE, 4) AS duplicate_rate FROM members GROUP BY 1")
def an_dup_rate(spark, d):
    return A.duplicate_rate(members(spark, d).withColumn("class_code", (F.col("item") % 4).cast("int")))


_SECTORS = {"North": ["ORG00", "ORG01", "ORG02", "ORG03"], "South": ["ORG04", "ORG05", "ORG06"], "East": ["ORG07", "ORG08"]}
_SECTOR_SQL = "CASE " + " ".join(f"WHEN cpse_code IN ({', '.join(repr(o) for o in orgs)}) THEN '{s}'" for s, orgs in _SECTORS.items()) + " ELSE 'Unassigned' END"


@query(MEMBERS + f"s AS (SELECT DISTINCT nmc, {_SECTOR_SQL} AS sector FROM members) SELECT x.sector AS a, y.sector AS b, count(*) AS codes FROM s x JOIN s y ON x.nmc = y.nmc AND x.sector < y.sector GROUP BY 1, 2")
def an_cross_sector(spark, d):
    return A.cross_sector(members(spark, d), _SECTORS)


@query(
    "WITH q AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(38, 6)) AS s, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n, count(*) OVER () AS c FROM orders), r AS (SELECT *, CAST(ceil(n * 20 / c::DOUBLE) AS INT) AS bucket, sum(s) OVER (ORDER BY n) AS run FROM q)"
    " SELECT bucket, max(n) AS reviewed, max(run)::DOUBLE AS spend FROM r GROUP BY bucket"
)
def an_value_curve(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("a_id"), F.lit(0).alias("b_id"), F.col("o_totalprice").alias("priority"), F.col("o_totalprice").alias("spend"))
    return A.value_curve(o).select("bucket", "reviewed", "spend")


PAIRS = MEMBERS + "p AS (SELECT a.nmc, least(a.stock_qty, b.annual_demand) * b.base_price AS value FROM members a JOIN members b ON a.nmc = b.nmc AND a.cpse_code <> b.cpse_code WHERE a.stock_qty > 0 AND a.last_movement_days >= 365 AND b.annual_demand > 0) "


@query(PAIRS + "SELECT nmc, count(*) AS offers, sum(CAST(value AS DECIMAL(38, 6)))::DOUBLE AS value FROM p WHERE value > 0 GROUP BY nmc")
def ec_redeploy(spark, d):
    return A.redeployment(members(spark, d)).groupBy("nmc").agg(F.count("*").alias("offers"), F.sum(A.money(F.col("qty") * F.col("price"))).cast("double").alias("value"))


POOL = "o AS (SELECT nmc, cpse_code, sum(CAST(stock_qty * base_price AS DECIMAL(38, 6))) AS v FROM members WHERE stock_qty > 0 GROUP BY 1, 2), h AS (SELECT nmc, count(*) AS locations, sum(v)::DOUBLE AS c FROM o GROUP BY nmc HAVING count(*) >= 2) "


@query(MEMBERS + POOL + "SELECT nmc, locations, round(c, 2) AS current, round(c * (1 - 1 / sqrt(locations::DOUBLE)), 2) AS saving FROM h")
def ec_pooling(spark, d):
    return A.pooling(members(spark, d))


@query(
    MEMBERS.rstrip(", ")
    + " SELECT nmc, count(DISTINCT cpse_code) AS orgs, round(sum(CAST(annual_demand * base_price AS DECIMAL(38, 6)))::DOUBLE, 2) AS annual_spend, round(max(base_price) / min(base_price), 3) AS price_spread FROM members GROUP BY nmc HAVING count(DISTINCT cpse_code) >= 2"
)
def ec_aggregation(spark, d):
    return A.aggregation(members(spark, d))


@query(MEMBERS.rstrip(", ") + " SELECT count(*) - count(DISTINCT nmc) AS duplicates, (count(*) - count(DISTINCT nmc)) * 850.0::DOUBLE AS value FROM members")
def ec_upkeep(spark, d):
    return A.upkeep(members(spark, d))


@query()
def ec_value_model(spark, d):
    return A.value_model(members(spark, d))


# --- services ----------------------------------------------------------------


@query()
def svc_dup_check(spark, d):
    """The registry is every record with all keys; candidates are ranked by the cosine of their descriptions."""
    known = G.materialise(records(spark, d))
    v = G.materialise(B.embed(known, idf=G.materialise(B.document_frequency(known))))
    return S.duplicate_check(known.where("id % 50 = 0"), known, (v.where("id % 50 = 0"), v))


@query(MEMBERS + "i AS (SELECT * FROM members WHERE nmc = '7' AND stock_qty > 0 AND last_movement_days >= 365 AND cpse_code <> 'ORG01'), p AS (SELECT avg(base_price) AS price FROM members WHERE nmc = '7') SELECT count(*) AS offers, coalesce(sum(stock_qty), 0)::DOUBLE AS available, least(coalesce(sum(stock_qty), 0), 100)::DOUBLE AS covered FROM i")
def svc_buy_or_borrow(spark, d):
    none = spark.createDataFrame([], "from_id long, to_id long")
    return S.buy_or_borrow(members(spark, d), none, "7", "ORG01", 100.0)[1].drop("avoided_cost")


@query()
def svc_review_queue(spark, d):
    done = M.decided(_judged(spark, d)).withColumn("spend", M.annual_spend()).withColumn("priority", M.priority(F.col("score"), F.col("spend")))
    return R.proposals(done).select("a_id", "b_id", "relation", "priority")


# --- federation --------------------------------------------------------------


@query()
def fed_redact(spark, d):
    return D.publishable(records(spark, d), "salt").select("id", "cpse_code", "class_code", F.explode("hashed_keys").alias("hashed"))


@query(KEYS + ", a AS (SELECT DISTINCT key FROM k WHERE cpse_code = 'ORG00'), b AS (SELECT DISTINCT key FROM k WHERE cpse_code = 'ORG05') SELECT (SELECT count(*) FROM a JOIN b USING (key)) AS shared, (SELECT count(*) FROM a WHERE key NOT IN (SELECT key FROM b)) AS only_a, (SELECT count(*) FROM b WHERE key NOT IN (SELECT key FROM a)) AS only_b")
def fed_psi(spark, d):
    k = keyed(spark, d).select("cpse_code", F.explode("keys").alias("key"))
    return D.overlap(D.offer(k.where("cpse_code = 'ORG00'"), "salt"), D.offer(k.where("cpse_code = 'ORG05'"), "salt"))


@query(
    MEMBERS
    + "o AS (SELECT nmc, cpse_code, round((sum(CAST(base_price AS DECIMAL(20, 6))) / count(*))::DOUBLE, 6) AS m FROM members GROUP BY 1, 2), b AS (SELECT nmc, list_sort(list(m)) AS m, count(*) AS n FROM o GROUP BY nmc HAVING count(*) >= 3)"
    " SELECT nmc, n AS contributors, m[1] AS min, m[CASE WHEN n % 4 = 0 THEN greatest(n // 4 - 1, 0) ELSE n // 4 END + 1] AS p25, round(CASE WHEN n % 2 = 1 THEN m[n // 2 + 1] ELSE (m[n // 2] + m[n // 2 + 1]) / 2 END, 6) AS median, m[least(n - 1, 3 * n // 4) + 1] AS p75, m[n] AS max, round(m[n] / m[1], 4) AS spread FROM b"
)
def fed_price_band(spark, d):
    return D.price_bands(members(spark, d).select("nmc", F.col("cpse_code").alias("org"), F.col("base_price").alias("price")))


# --- streams and the whole ---------------------------------------------------


def _as_files(df: DataFrame, n: int) -> str:
    path = f"{G.checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.repartition(n).write.parquet(path)
    return path


@query(ORACLES["led_replay"])
def st_ledger_fold(spark, d):
    """The membership that a stream of events leaves, held in state by code and member."""
    told = F.from_json("payload_json", "nmc string, members array<bigint>")
    events = _log(spark, d).select(F.col("event_id").alias("seq"), "event_type", told.alias("p")).select("seq", "event_type", "p.nmc", F.explode("p.members").alias("member"))
    path = _as_files(events, 3)
    stream = live.membership_stream(live.replay_as_stream(spark, path, "seq long, event_type string, nmc string, member long", 3))
    out = f"{path}-out"

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{path}-check").trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema("nmc string, member long, seq long, active boolean, batch long").parquet(out)
    return told.groupBy("nmc", "member").agg(F.max_by("active", "seq").alias("active")).where("active").select("nmc", "member")


def st_dup_check(spark, d):
    """New items as a stream of files, each micro-batch held against the registry. Not registered: it has not been seen to finish in two minutes."""
    recs = G.materialise(representatives(spark, d).withColumn("keys", F.filter("keys", lambda k: k.rlike("^(mpn|vmn|blk):"))))
    new = material(spark, d).where("id % 50 = 0")
    path = _as_files(new, 2)
    live.check_stream(spark.readStream.schema(new.schema).parquet(path), recs, f"{path}-out", f"{path}-check").awaitTermination()
    kind = "a_id long, place int, b_id long, relation string, direction string, score double, tier string, reason string, likely_duplicate boolean, batch long"
    return spark.read.schema(kind).parquet(f"{path}-out").drop("batch")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items look overpriced only because of the unit they are bought in."""
    return an_uom_anomaly(spark, sf_dir)


from partwise.plans import more  # noqa: E402, F401  registers further queries
