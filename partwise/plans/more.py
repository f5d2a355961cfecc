"""Further queries: connectors, state, stewards' decisions, and operators over stated cases; and SQL for queries of the catalogue.

A stated case is an input with the result that the domain's rules give it,
written out by hand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.functions import codes as Z
from partwise.functions import knowledge as K
from partwise.functions import text as X
from partwise.functions import uom as U
from partwise.operators import blocking as B
from partwise.operators import classify as C
from partwise.operators import compare as M
from partwise.operators import extract as E
from partwise.operators import federation as D
from partwise.operators import graph as G
from partwise.operators import kg
from partwise.operators import ledger as L
from partwise.operators import models as W
from partwise.operators import registry as R
from partwise.operators import stewardship as T
from partwise.plans.catalogue import CLEAN, KEYS, MAT, MEMBERS, ORACLES, PAIRS, POOL, WORDS, material, members, query, records, table
from partwise.sources import odata, readers, writers


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def stated(columns: str, rows: list[tuple]) -> str:
    """SQL of stated rows; columns: name type, ... in DuckDB's types."""
    names = [c.split() for c in columns.split(", ")]
    values = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    return "SELECT " + ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in names) + f" FROM (VALUES {values}) t({', '.join(n for n, _ in names)})"


def folder(spark: SparkSession) -> str:
    return f"{G.checkpoint_dir(spark)}/{uuid.uuid4().hex}"


# --- SQL for queries of the catalogue ----------------------------------------

SHORT = "CASE t " + " ".join(f"WHEN {literal(s)} THEN {literal(w)}" for s, w in K.SHORTHAND.items()) + " ELSE t END"
NORMAL = CLEAN + f"n AS (SELECT id, array_to_string(list_transform(string_split(clean, ' '), lambda t: {SHORT}), ' ') AS normal FROM c) "

#: What the shapes of the material view say, by class (kind) and style.
SPEC = (
    MAT
    + "p0 AS (SELECT *, item % 4 AS kind, CAST(right(cpse_code, 2) AS INT) % 3 AS style, item // 4 AS q FROM m),"
    " p1 AS (SELECT *, 4 + q % 20 AS z, CAST(6000 + ((q // 93) % 3) * 100 + (q % 93) + 4 AS VARCHAR) AS brg, CAST(20 + 5 * ((q // 20) % 17) AS VARCHAR) AS len, ['20', '40', '80', '120', '160'][(q // 20) % 5 + 1] AS sch,"
    " ['150', '300', '600', '900', '1500'][(q // 20) % 5 + 1] AS pc, ['GATE', 'GLOBE', 'BALL', 'CHECK'][(q // 100) % 4 + 1] AS vt FROM p0),"
    " p2 AS (SELECT *, CASE WHEN style = 2 THEN brg || '2' ELSE brg END AS d, CASE WHEN style = 2 THEN 'RS' ELSE '2RS' END AS seal,"
    " CASE z WHEN 4 THEN 'x0.7' WHEN 5 THEN 'x0.8' WHEN 6 THEN 'x1' WHEN 8 THEN 'x1.25' WHEN 10 THEN 'x1.5' WHEN 12 THEN 'x1.75' WHEN 14 THEN 'x2' WHEN 16 THEN 'x2' WHEN 18 THEN 'x2.5' WHEN 20 THEN 'x2.5' WHEN 22 THEN 'x2.5' ELSE '' END AS pitch,"
    " CASE kind WHEN 0 THEN 'BEARING' WHEN 1 THEN 'FASTENER_BOLT' WHEN 2 THEN 'PIPE' ELSE 'VALVE' END AS class_code FROM p1),"
    " p AS (SELECT *, CASE CAST(right(d, 2) AS INT) WHEN 0 THEN 10 WHEN 1 THEN 12 WHEN 2 THEN 15 WHEN 3 THEN 17 ELSE CAST(right(d, 2) AS INT) * 5 END AS bore, 'M' || z || pitch AS thread FROM p2),"
    " a AS ("
    + " UNION ALL ".join(
        f"SELECT id, class_code, '{key}' AS key, CAST({value} AS VARCHAR) AS value, CAST({number} AS DOUBLE) AS number, CAST({sure} AS DOUBLE) AS confidence, '{source}' AS source FROM p WHERE {where}"
        for key, value, number, sure, source, where in [
            ("designation", "d || '-' || seal", "NULL", "1", "grammar", "kind = 0"),
            ("bore_mm", "bore", "bore", "1", "grammar", "kind = 0"),
            ("series", "left(d, length(d) - 2)", "NULL", "1", "grammar", "kind = 0"),
            ("seal", "seal", "NULL", "1", "grammar", "kind = 0"),
            ("thread", "thread", "z", "CASE WHEN pitch = '' THEN 0.85 ELSE 0.92 END", "grammar", "kind = 1"),
            ("length_mm", "len", "len", "0.95", "grammar", "kind = 1"),
            ("material", "CASE kind WHEN 1 THEN 'SS316' WHEN 2 THEN 'CS_A106B' ELSE 'WCB' END", "NULL", "0.98", "kg", "kind > 0"),
            ("head", "'HEX'", "NULL", "1", "grammar", "kind = 1"),
            ("nominal_size", "z || '\"'", "z * 25.4::DOUBLE", "1", "grammar", "kind > 1"),
            ("schedule", "'SCH' || sch", "NULL", "1", "grammar", "kind = 2"),
            ("construction", "'SEAMLESS'", "NULL", "1", "grammar", "kind = 2 AND style < 2"),
            ("standard", "'ASTM A106'", "NULL", "1", "grammar", "kind = 2 AND style = 2"),
            ("valve_type", "vt", "NULL", "1", "grammar", "kind = 3"),
            ("pressure_class", "pc", "NULL", "1", "grammar", "kind = 3"),
            ("end_connection", "'FLGD'", "NULL", "1", "grammar", "kind = 3"),
        ]
    )
    + "), first AS (SELECT *, CASE kind WHEN 0 THEN CAST(bore AS VARCHAR) WHEN 1 THEN upper(replace(thread, '.', '')) ELSE CAST(z AS VARCHAR) END AS dim, CASE kind WHEN 0 THEN '' WHEN 1 THEN 'SS316' WHEN 2 THEN 'CSA106B' ELSE 'WCB' END AS mat FROM p),"
    " ka AS (SELECT id, cpse_code, 'attr:' || class_code || '|' || dim || '|' || mat AS key FROM first UNION ALL SELECT id, cpse_code, 'dim:' || class_code || '|' || dim FROM first UNION ALL SELECT id, cpse_code, 'std:ASTMA106|' || dim FROM first WHERE kind = 2 AND style = 2"
    " UNION ALL SELECT id, cpse_code, 'blk:' || class_code || '|' || CASE kind WHEN 0 THEN d || seal || '|' || bore || '|' || left(d, length(d) - 2) || '|' || seal WHEN 1 THEN dim || '|' || len || '|SS316|HEX' WHEN 2 THEN dim || '|CSA106B' || CASE WHEN style < 2 THEN '|SEAMLESS' ELSE '' END ELSE vt || '|' || dim || '|WCB|FLGD' END FROM first) "
)
TOKENS = (
    "tw AS (SELECT DISTINCT id, w FROM (SELECT id, unnest(words) AS w FROM w) WHERE regexp_matches(w, '[0-9]') OR length(w) >= 5), tr AS (SELECT id, regexp_replace(w, '[^A-Z0-9]', '', 'g') AS k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(w) DESC, w) AS i FROM tw) WHERE i <= 3),"
    " kt AS (SELECT id, 'tok:' || k AS key FROM tr WHERE length(k) >= 3) "
)
FAMILY_LABEL = {f: v[0] for f, v in K.FAMILIES.items()}


def _golden(labels: dict[str, str], short: bool = False) -> str:
    """SQL of the golden descriptions of the view's shapes."""
    name = lambda label: labels.get(label, label)
    bearing = f"'BEARING, BALL, ANNULAR: {name('DESIGNATION')}=' || d || '-' || seal || '; {name('BORE')}=' || bore || ' MM'" + ("" if short else f" || '; {name('SERIES')}=' || left(d, length(d) - 2) || '; {name('SEAL')}=' || seal")
    bolt = f"'BOLT, HEXAGON HEAD: {name('THREAD')}=' || thread || '; {name('LENGTH')}=' || len || ' MM; {name('MATERIAL')}={FAMILY_LABEL['SS316']}'" + ("" if short else f" || '; {name('HEAD')}=HEX'")
    pipe = f"'PIPE, SEAMLESS: {name('SIZE')}=' || z || '\" NB; {name('SCHEDULE')}=SCH' || sch || '; {name('MATERIAL')}={FAMILY_LABEL['CS_A106B']}'" + ("" if short else f" || CASE WHEN style < 2 THEN '; {name('CONSTRUCTION')}=SEAMLESS' ELSE '; {name('STD')}=ASTM A106' END")
    valve = f"'VALVE: {name('TYPE')}=' || vt || '; {name('SIZE')}=' || z || '\" NB; {name('CLASS')}=' || pc || '; {name('BODY MATERIAL')}={FAMILY_LABEL['WCB']}'" + ("" if short else f" || '; {name('ENDS')}=FLGD'")
    return f"CASE kind WHEN 0 THEN {bearing} WHEN 1 THEN {bolt} WHEN 2 THEN {pipe} ELSE {valve} END"


def _scales() -> str:
    """Rows (scale, key, rank, serves) of every scale: values in order, equal ones share a rank."""
    rows = []
    for scale, spec in K.SCALES.items():
        equal = {kg.key(v): min(map(kg.key, group), key=[kg.key(x) for x in spec["values"]].index) for group in spec["equal"] for v in group if all(kg.key(x) in [kg.key(y) for y in spec["values"]] for x in group)}
        order: list[str] = []
        for v in map(kg.key, spec["values"]):
            head = equal.get(v, v)
            if head not in order:
                order.append(head)
            rows.append((scale, v, order.index(head), spec["serves"]))
    return ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in dict.fromkeys(rows))


_PAD = b"salt".ljust(64, b"\0")
HMAC = f"left(sha256(unhex('{bytes(b ^ 0x5C for b in _PAD).hex()}') || unhex(sha256(unhex('{bytes(b ^ 0x36 for b in _PAD).hex()}') || encode(key)))), 32)"

ORACLES |= {
    "txt_expand": NORMAL + "SELECT * FROM n",
    "txt_token_jaccard": "WITH x AS (SELECT a.p_partkey, list_distinct(list_filter(string_split(a.p_name, ' '), lambda t: length(t) > 1)) AS x, list_distinct(list_filter(string_split(b.p_name, ' '), lambda t: length(t) > 1)) AS y FROM (SELECT p_partkey, upper(p_name) AS p_name FROM part) a JOIN (SELECT p_partkey, upper(p_name) AS p_name FROM part) b ON b.p_partkey = a.p_partkey + 1)"
    " SELECT p_partkey, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE END, 9) AS similarity FROM x",
    "ext_attributes": SPEC + "SELECT * FROM a",
    "ext_coverage": SPEC + "SELECT id, class_code, round(CASE kind WHEN 0 THEN 4 / 7.0::DOUBLE WHEN 1 THEN 4 / 10.0::DOUBLE WHEN 2 THEN 4 / 8.0::DOUBLE ELSE 5 / 9.0::DOUBLE END, 4) AS coverage, '' AS missing FROM p",
    "render_golden": SPEC + f"SELECT id, {_golden({})} AS golden, {_golden({}, True)} AS short, {_golden(E.HINDI)} AS hindi FROM p",
    "kg_material": ORACLES["kg_closure"].replace(", CAST(coalesce(n, -1) AS INT) AS hops", ""),
    "kg_ordered": f"WITH s(scale, k, r, serves) AS (VALUES {_scales()}) SELECT x.scale, x.k AS a, y.k AS b, CASE WHEN x.k = y.k THEN 'IDENTICAL' WHEN x.r = y.r THEN 'EQUIVALENT' WHEN NOT x.serves THEN 'CONFLICT' ELSE 'SUBSTITUTABLE' END AS relation, CASE WHEN x.r = y.r OR NOT x.serves THEN '' WHEN x.r > y.r THEN 'a->b' ELSE 'b->a' END AS direction FROM s x JOIN s y ON x.scale = y.scale",
    "kg_standard": stated("a VARCHAR, b VARCHAR, now VARCHAR, relation VARCHAR", [(o, n, n, "IDENTICAL") for o, n, _ in K.SUPERSEDED] + [("IS 2062", "IS 2063", "IS 2062", "CONFLICT")]),
    "kg_service": SPEC + "SELECT id, '' AS services, CASE kind WHEN 0 THEN '' WHEN 1 THEN 'SS316' WHEN 2 THEN 'CS_A106B' ELSE 'WCB' END AS families FROM p",
    "kg_stats": stated("what VARCHAR, n INT", [("families", 32), ("aliases", 140), ("links", 17), ("scales", 5), ("services", 4), ("superseded", 6)]),
    "blk_attr": SPEC + "SELECT id, key FROM ka",
    "blk_tokens": WORDS.replace("w AS (SELECT", "w AS (SELECT", 1).rstrip() + ", " + TOKENS + "SELECT id, key FROM kt",
    "blk_pairs": SPEC.rstrip() + ", " + KEYS[len(MAT) : KEYS.index("s AS (SELECT key")] + WORDS[len(MAT) :].rstrip() + ", " + TOKENS.rstrip() + ", every AS (SELECT DISTINCT * FROM (SELECT id, cpse_code, key FROM k UNION ALL SELECT id, cpse_code, key FROM ka UNION ALL SELECT kt.id, cpse_code, key FROM kt JOIN m ON m.id = kt.id)),"
    " kept AS (SELECT * FROM every WHERE key IN (SELECT key FROM every GROUP BY key HAVING count(*) BETWEEN 2 AND 400)), met AS (SELECT x.id AS a_id, y.id AS b_id, string_agg(DISTINCT split_part(x.key, ':', 1), ',' ORDER BY split_part(x.key, ':', 1)) AS strategies FROM kept x JOIN kept y ON x.key = y.key AND x.id < y.id AND x.cpse_code <> y.cpse_code GROUP BY 1, 2)"
    " SELECT strategies, count(*) AS pairs, CAST(sum(a_id * 31 + b_id) AS BIGINT) AS checksum, CAST(sum((a_id * 7919 + b_id) % 1000003) AS BIGINT) AS mixed FROM met GROUP BY 1",
    "vec_idf": NORMAL.rstrip() + ", ws AS (SELECT id, normal, string_split(normal, ' ') AS s FROM n), f AS (SELECT id, 'w:' || unnest(s) AS feature FROM ws UNION ALL SELECT id, 'b:' || s[i] || '_' || s[i + 1] FROM (SELECT id, s, unnest(range(1, len(s))) AS i FROM ws)"
    " UNION ALL SELECT id, 'c:' || substr(' ' || normal || ' ', i, g) FROM (SELECT id, normal, g, unnest(range(1, length(normal) + 4 - g)) AS i FROM ws, (VALUES (3), (4)) t(g))), d AS (SELECT feature, count(DISTINCT id) AS df FROM f GROUP BY 1) SELECT feature, df, round(ln((SELECT count(*) + 1.0::DOUBLE FROM m) / (df + 0.5::DOUBLE)) + 1, 6) AS idf FROM d",
    "vec_hash_embed": MAT.rstrip(", ") + " SELECT id, 1.0::DOUBLE AS size2, CAST(256 AS INT) AS dim FROM m",
    "erp_change_requests": MEMBERS.rstrip(", ") + """ SELECT cpse_code || '|' || matnr || '|' || nmc AS idempotency_key, cpse_code, matnr, nmc, '{"classification":{"class":"ZNMC_CLASS","class_type":"001","characteristics":[{"ATNAM":"ZNMC","ATWRT":"' || nmc || '"},{"ATNAM":"ZNMC_CLASS_CODE","ATWRT":"VALVE"}]},"z_xref":{"table":"ZNMC_XREF","MATNR":"' || matnr || '","NMC":"' || nmc || '"},"proposed_standard_description":"' || replace(description, '"', '\\"') || '","requires_human_approval":true}' AS payload FROM members""",
    "ec_value_model": PAIRS.rstrip() + ", " + POOL + "SELECT 'redeployment' AS lever, TRUE AS measured, round(coalesce(sum(CAST(value AS DECIMAL(38, 6)))::DOUBLE, 0), 2) AS value FROM p WHERE value > 0 UNION ALL SELECT 'pooling', FALSE, round(coalesce(sum(CAST(round(c * (1 - 1 / sqrt(locations::DOUBLE)), 2) AS DECIMAL(38, 6)))::DOUBLE, 0) * 0.45::DOUBLE, 2) FROM h"
    " UNION ALL SELECT 'aggregation', TRUE, round(coalesce(sum(s)::DOUBLE, 0), 2) FROM (SELECT sum(CAST(annual_demand * base_price AS DECIMAL(38, 6))) AS s FROM members GROUP BY nmc HAVING count(DISTINCT cpse_code) >= 2) UNION ALL SELECT 'upkeep', FALSE, (count(*) - count(DISTINCT nmc)) * 850.0::DOUBLE FROM members",
    "fed_redact": SPEC.rstrip() + ", " + KEYS[len(MAT) : KEYS.index("s AS (SELECT key")] + WORDS[len(MAT) :].rstrip() + ", " + TOKENS.rstrip() + ", every AS (SELECT DISTINCT * FROM (SELECT id, key FROM k UNION ALL SELECT id, key FROM ka UNION ALL SELECT id, key FROM kt))"
    f" SELECT e.id, p.cpse_code, p.class_code, {HMAC} AS hashed FROM every e JOIN p ON p.id = e.id",
    "lex_mine": WORDS.rstrip()
    + ", r AS (SELECT id, list_distinct(words) AS s FROM w WHERE len(words) BETWEEN 2 AND 24), t AS (SELECT id, unnest(s) AS t FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(t) DESC, t) AS i FROM t WHERE length(t) >= 3), k AS (SELECT id, t FROM o WHERE i <= 3), g AS (SELECT t FROM k GROUP BY t HAVING count(*) BETWEEN 2 AND 60),"
    " p AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.t = y.t AND x.id < y.id WHERE x.t IN (SELECT t FROM g)), d AS (SELECT list_filter(x.s, lambda e: NOT list_contains(y.s, e)) AS xa, list_filter(y.s, lambda e: NOT list_contains(x.s, e)) AS yb, len(list_intersect(x.s, y.s)) AS n FROM p JOIN r x ON x.id = a JOIN r y ON y.id = b),"
    " e AS (SELECT u, unnest(yb) AS v FROM (SELECT unnest(xa) AS u, yb FROM d WHERE len(xa) BETWEEN 1 AND 2 AND len(yb) BETWEEN 1 AND 2 AND n >= 3)), l AS (SELECT CASE WHEN length(u) < length(v) THEN u ELSE v END AS short, CASE WHEN length(u) < length(v) THEN v ELSE u END AS long FROM e),"
    " c2 AS (SELECT short, long, count(*) AS count FROM l WHERE length(short) < length(long) AND length(short) >= 3 AND left(short, 1) = left(long, 1) AND regexp_matches(left(short, 1), '[A-Z]') AND (starts_with(long, short) OR regexp_matches(long, '^' || array_to_string(list_transform(string_split(short, ''), lambda ch: regexp_escape(ch)), '.*')) OR starts_with(regexp_replace(long, '[AEIOU]', '', 'g'), short)) GROUP BY 1, 2),"
    f" f AS (SELECT t, count(*) AS f FROM t GROUP BY 1), z AS (SELECT short, long, count, round((count / nn) / ((a.f / nn) * (b.f / nn)), 6) AS lift FROM c2 JOIN f a ON a.t = short JOIN f b ON b.t = long, (SELECT count(*)::DOUBLE AS nn FROM r) WHERE count >= 2 AND short NOT IN ({', '.join(map(literal, K.SHORTHAND))}))"
    " SELECT short, long, count, lift FROM (SELECT *, row_number() OVER (PARTITION BY short ORDER BY ln(lift) * count DESC, long DESC, count DESC) AS i FROM z WHERE lift >= 1.2) WHERE i = 1",
}


@query(ORACLES["lex_mine"].replace(WORDS.rstrip(), "WITH w AS (SELECT p_partkey AS id, [CASE WHEN p_partkey % 4 < 2 THEN 'BRNG' ELSE 'BEARING' END, 'ROLLER', 'TAPERED', 'X' || lpad(CAST(p_partkey // 4 AS VARCHAR), 9, '0')] AS words FROM part)", 1))
def lex_parts(spark, d):
    """Shorthand in names that are written in two ways for four parts each."""
    word = F.when(F.col("p_partkey") % 4 < 2, "BRNG").otherwise("BEARING")
    name = F.concat_ws(" ", word, F.lit("ROLLER TAPERED"), F.concat(F.lit("X"), F.lpad(F.floor(F.col("p_partkey") / 4).cast("string"), 9, "0")))
    return B.mine_shorthand(table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("own_clean")))


# --- connectors --------------------------------------------------------------


def _parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.concat(F.lit("P"), "p_partkey").alias("no"), "p_name", "p_brand", F.format_number("p_retailprice", 2).alias("price"), F.when(F.col("p_size") % 2 == 0, "NO").alias("unit"))


@query("SELECT 'P' || p_partkey AS matnr, p_name AS description, round(p_retailprice, 2) AS unit_price, CASE WHEN p_size % 2 = 0 THEN 'NO' END AS uom, 'ORG01' AS cpse_code, p_brand AS mfr_name FROM part")
def src_csv(spark, d):
    """Parts written as CSV under headers from the wild, with ; between and thousands commas, and read back."""
    at = folder(spark)
    _parts(spark, d).toDF("Item Code", "Material Description", "Make", "Std-Price", "Base UOM").withColumn("Colour", F.lit("red")).write.option("header", True).option("sep", ";").csv(at)
    return readers.read_csv(spark, at, "ORG01").select("matnr", "description", "unit_price", "uom", "cpse_code", "mfr_name")


@query(stated("header VARCHAR, field VARCHAR", [("Item Code", "matnr"), (" desc ", "description"), ("MPN", "mfr_part_no"), ("on hand", "stock_qty"), ("Base-UOM", "uom"), ("Colour", None), ("plant", "plant"), ("Warehouse", "plant"), ("supplier part no", "vendor_matl_no")]))
def src_headers(spark, d):
    rows = ["Item Code", " desc ", "MPN", "on hand", "Base-UOM", "Colour", "plant", "Warehouse", "supplier part no"]
    return spark.createDataFrame([(h, readers.header_field(h)) for h in rows], "header string, field string")


@query(stated("header VARCHAR", [("Colour",), ("Zone 7",)]))
def src_unmapped(spark, d):
    df = spark.createDataFrame([("a", "b", "c", "d")], "`Item Code` string, Colour string, desc string, `Zone 7` string")
    return spark.createDataFrame([(h,) for h in readers.unmapped(df)], "header string")


@query("SELECT 'P' || p_partkey AS matnr, p_name AS description, p_brand AS mfr_name FROM part")
def src_json(spark, d):
    """Parts in a JSON envelope, read back."""
    at = folder(spark)
    rows = _parts(spark, d).select(F.col("no").alias("material"), F.col("p_name").alias("description"), F.col("p_brand").alias("make"))
    packed = rows.groupBy(F.pmod(F.xxhash64("material"), F.lit(8)).alias("b")).agg(F.to_json(F.struct(F.collect_list(F.struct("material", "description", "make")).alias("records"))).alias("value"))
    packed.write.partitionBy("b").text(at)
    return readers.read_json(spark, at).select("matnr", "description", "mfr_name")


@query("SELECT 'P' || p_partkey AS matnr, CASE WHEN p_partkey % 3 = 0 THEN 'P' || p_partkey ELSE p_name END AS description, round(p_retailprice, 2) AS unit_price, p_brand AS mfr_name, 'ORG02' AS cpse_code FROM part")
def src_erp_tables(spark, d):
    """Parts as table exports, of which some lack a text, joined by their number."""
    at, p = folder(spark), table(spark, d, "part").withColumn("no", F.concat(F.lit("P"), "p_partkey"))
    out = lambda df, name: df.write.option("header", True).csv(f"{at}/{name}.csv")
    out(p.select(F.col("no").alias("MATNR"), F.lit("NO").alias("MEINS"), F.col("p_brand").alias("MFRNR")), "MARA")
    out(p.where("p_partkey % 3 <> 0").select(F.col("no").alias("MATNR"), F.col("p_name").alias("MAKTX")), "MAKT")
    out(p.select(F.col("no").alias("MATNR"), F.round("p_retailprice", 2).alias("STPRS")), "MBEW")
    read = odata.Connection.from_config("ORG02", {"mode": "csv", "folder": at}).read(spark)
    return read.select("matnr", "description", "unit_price", "mfr_name", "cpse_code")


@query("SELECT 'P' || p_partkey AS matnr, CASE WHEN p_partkey % 5 = 0 THEN 'P' || p_partkey ELSE p_name END AS description, p_brand AS mfr_name, 'SAP/Q1' AS source_system FROM part")
def src_odata(spark, d):
    """Parts as answers of an OData service, in both envelopes."""
    p = table(spark, d, "part")
    row = F.struct(F.concat(F.lit("P"), "p_partkey").alias("Product"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("ProductDescription"), F.col("p_brand").alias("ManufacturerNumber"))
    pages = p.groupBy(F.pmod(F.xxhash64("p_partkey"), F.lit(16)).alias("page")).agg(F.collect_list(row).alias("rows"))
    body = F.when(F.col("page") % 2 == 0, F.to_json(F.struct(F.struct(F.col("rows").alias("results")).alias("d")))).otherwise(F.to_json(F.struct(F.col("rows").alias("value"))))
    read = odata.Connection.from_config("ORG03", {"mode": "odata", "base_url": "http://erp", "system_id": "Q1"}).read(spark, pages.select(body.alias("body")))
    return read.select("matnr", "description", "mfr_name", "source_system")


@query(MEMBERS.rstrip(", ") + " SELECT cpse_code || '|' || matnr || '|' || nmc AS idempotency_key, CASE WHEN id % 7 = 0 THEN 'failed' ELSE 'sent' END AS status, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 2 = 0 THEN 'CR' || id ELSE cpse_code || '|' || matnr || '|' || nmc END AS external_ref FROM members")
def erp_posted(spark, d):
    """Bodies of all write-back requests and what answers of the service make of them."""
    m = members(spark, d).withColumns({"class_code": F.lit("VALVE"), "golden_description": F.col("description")})
    sent = odata.Connection.from_config("ORG", {"mode": "odata", "base_url": "http://erp/"}).submit(R.change_requests(m))
    answers = sent.join(m.select(F.concat_ws("|", "cpse_code", "matnr", "nmc").alias("idempotency_key"), "id"), "idempotency_key")
    answer = F.when(F.col("id") % 2 == 0, F.concat(F.lit('{"d":{"ChangeRequest":"CR'), "id", F.lit('"}}'))).otherwise("{}")
    return odata.outcomes(answers.select("idempotency_key", F.when(F.col("id") % 7 == 0, 500).otherwise(201).alias("code"), answer.alias("body")))


@query(MEMBERS.rstrip(", ") + " SELECT cpse_code, count(*) AS requests FROM members GROUP BY cpse_code")
def erp_outbox(spark, d):
    """All requests sent to the outbox twice: each is there once."""
    m = members(spark, d).withColumns({"class_code": F.lit("VALVE"), "golden_description": F.col("description")})
    at = folder(spark)
    node = odata.Connection.from_config("ORG", {"outbox": at})
    requests = G.materialise(R.change_requests(m))
    node.submit(requests)
    node.submit(requests)
    return spark.read.schema(requests.schema).json(at).groupBy("cpse_code").agg(F.count("*").alias("requests"))


@query(MEMBERS.rstrip(", ") + " SELECT cpse_code, matnr, nmc FROM members")
def erp_cross_reference(spark, d):
    at = folder(spark)
    writers.write_cross_reference(members(spark, d).withColumns({"class_code": F.lit("VALVE"), "golden_description": F.lit("")}), at)
    return spark.read.option("header", True).csv(at).select("cpse_code", "matnr", "nmc")


@query(stated("organisation VARCHAR, mode VARCHAR, live BOOLEAN, writes VARCHAR", [("A", "csv", False, "outbox"), ("B", "odata", False, "outbox"), ("C", "odata", True, odata.WRITE_PATH)]))
def erp_connections(spark, d):
    made = [odata.Connection.from_config("A", {}), odata.Connection.from_config("B", {"mode": "odata", "password": "x"}), odata.Connection.from_config("C", {"mode": "odata", "base_url": "http://erp"})]
    told = [c.describe() for c in made]
    return spark.createDataFrame([(t["organisation"], t["mode"], t["live"], t["writes"]) for t in told], "organisation string, mode string, live boolean, writes string")


INGEST = "SELECT p_partkey, 'M' || p_partkey AS matnr FROM part"


@query("SELECT 'ORG' AS cpse_code, 'M' || p_partkey AS matnr, CASE WHEN p_partkey % 4 = 0 THEN 'again' ELSE p_name END AS description FROM part UNION ALL SELECT 'ORG', 'N' || p_partkey, 'new' FROM part WHERE p_partkey % 9 = 0")
def src_ingest(spark, d):
    """A second delivery laid over a first: known numbers keep their ids, the last row of a number counts."""
    p = table(spark, d, "part")
    first = readers.ingest(p.select(F.lit("ORG").alias("cpse_code"), F.concat(F.lit("M"), "p_partkey").alias("matnr"), F.col("p_name").alias("description")))
    again = p.where("p_partkey % 4 = 0").select(F.lit("ORG").alias("cpse_code"), F.concat(F.lit("M"), "p_partkey").alias("matnr"), F.lit("again").alias("description"))
    new = p.where("p_partkey % 9 = 0").select(F.lit("ORG").alias("cpse_code"), F.concat(F.lit("N"), "p_partkey").alias("matnr"), F.lit("new").alias("description"))
    out = readers.ingest(again.union(new), G.materialise(first))
    return out.select("cpse_code", "matnr", "description")


# --- stated cases ------------------------------------------------------------


def _given(spark, kind: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, kind)


_UNITS = [("M", "KM", True, 0.001), ("KG", "G", True, 1000.0), ("DOZEN", "NO", True, 12.0), ("M", "KG", False, None), ("L", "ML", True, 1000.0), ("ZZZ", "NO", True, 1.0), ("PAIR", "DOZEN", True, 0.16666667)]


@query(stated("a VARCHAR, b VARCHAR, same BOOLEAN, one_in_other DOUBLE", _UNITS))
def uom_cases(spark, d):
    rows = _given(spark, "a string, b string", [r[:2] for r in _UNITS]).select("a", "b", U.resolve(F.col("a"), F.lit("")).alias("x"), U.resolve(F.col("b"), F.lit("")).alias("y"))
    return rows.select("a", "b", U.comparable(F.col("x"), F.col("y")).alias("same"), F.round(U.convert(F.lit(1.0), F.col("x"), F.col("y")), 8).alias("one_in_other"))


_PACKS = [("DRUM", "CABLE 1 DRUM OF 500 M", "length", 500.0, "explicit"), ("BOX", "BOLT BOX OF 50 NOS", "count", 50.0, "explicit"), ("BOX", "BOLT", "count", 100.0, "default"), ("ROLL", "TAPE", "length", 50.0, "default"), ("BAG", "CEMENT 25 KG PER BAG", "mass", 25.0, "explicit"), ("NO", "BOLT", "count", 1.0, "")]


@query(stated("uom VARCHAR, description VARCHAR, dimension VARCHAR, qty DOUBLE, pack_source VARCHAR", _PACKS))
def uom_packs(spark, d):
    rows = _given(spark, "uom string, description string", [r[:2] for r in _PACKS]).withColumn("u", U.resolve(F.col("uom"), X.clean(F.col("description"))))
    return rows.select("uom", "description", "u.dimension", F.col("u.qty_per_uom").alias("qty"), "u.pack_source")


@query(stated("dimension VARCHAR, base VARCHAR", list(K.BASES.items())))
def uom_bases(spark, d):
    """Every unit is a multiple of its dimension's base unit."""
    rows = _given(spark, "code string", [(u,) for u in K.UNITS]).withColumn("u", U.resolve(F.col("code"), F.lit("")))
    return rows.groupBy("u.dimension").agg(F.max("u.base_code").alias("base")).select("dimension", "base")


_FRACTIONS = [("2", 2.0), ("1.5", 1.5), ("3/4", 0.75), ("1 1/2", 1.5), ("", None), ("A", None), ("1/0", None)]


@query(stated("text VARCHAR, value DOUBLE", _FRACTIONS))
def ext_fractions(spark, d):
    return _given(spark, "text string", [r[:1] for r in _FRACTIONS]).select("text", X.fraction(F.col("text")).alias("value"))


_CLASSES = [("HEX BOLT M12", "FASTENER_BOLT"), ("NYLOC NUT M10", "FASTENER_NUT"), ('ELBOW 90 DEG 2" SCH 40', "PIPE_FITTING"), ("SPIRAL WOUND GASKET", "GASKET"), ("POWER CABLE 3CX95", "CABLE"), ("GATEVALVE 2 INCH", "VALVE"), ("BALL VALVE WITH HEX BOLT", "FASTENER_BOLT"), ("WIDGET BLUE", "GENERIC"), ("SMLS PIPE", "PIPE"), ("BRG 6205", "BEARING")]


@query(stated("description VARCHAR, class_code VARCHAR", _CLASSES))
def cls_cases(spark, d):
    rows = _given(spark, "description string", [r[:1] for r in _CLASSES]).withColumn("c", X.clean(F.col("description"))).withColumn("n", X.expand(F.col("c")))
    return rows.select("description", C.classify(F.col("c"), F.col("n"))["code"].alias("class_code"))


_ORDERED = [("PUMP AS PER DRAWING 12", True), ("SKID MOUNTED PUMP", True), ("TAILOR MADE COVER", True), ("HEX BOLT M12", False), ("", False)]


@query(stated("description VARCHAR, made_to_order BOOLEAN", _ORDERED))
def cls_made_to_order(spark, d):
    return _given(spark, "description string", [r[:1] for r in _ORDERED]).select("description", C.engineered(F.col("description")).isNotNull().alias("made_to_order"))


@query(stated("class_code VARCHAR, item_name VARCHAR, nsc VARCHAR, unspsc VARCHAR, hsn VARCHAR, eclass VARCHAR", [("FASTENER_BOLT", "BOLT, HEXAGON HEAD", "5306", "31161501", "73181500", "23-11-01-01"), ("BEARING", "BEARING, BALL, ANNULAR", "3110", "31171500", "84821011", "23-05-01-01"), ("GENERIC", "ITEM", "9999", "00000000", "00000000", "00-00-00-00")]))
def cls_facets(spark, d):
    return C.class_table(spark).where("class_code IN ('FASTENER_BOLT', 'BEARING', 'GENERIC')").drop("facet_version")


@query(stated("class_code VARCHAR, attributes BIGINT, mandatory VARCHAR, blocking VARCHAR", [
    ("FASTENER_BOLT", 10, "thread,length_mm,material", "thread,length_mm,material,head,service"), ("FASTENER_NUT", 8, "thread,material", "thread,material,style,service"), ("PIPE", 8, "nominal_size,schedule,material", "nominal_size,material,construction,end_connection,service"),
    ("VALVE", 9, "valve_type,nominal_size,pressure_class,material,end_connection", "valve_type,nominal_size,material,end_connection,operation,service"), ("BEARING", 7, "designation,bore_mm", "designation,bore_mm,series,seal,clearance"), ("CABLE", 7, "cores,csa_sqmm,voltage,insulation,conductor", "cores,csa_sqmm,insulation,conductor,armour"),
    ("GASKET", 7, "gasket_type,nominal_size,pressure_class,material", "gasket_type,nominal_size,pressure_class,material,service"), ("GENERIC", 4, "noun", "noun,service"),
]))
def cls_attributes(spark, d):
    t = C.attribute_table(spark).where("class_code <> 'PIPE_FITTING'")
    named = lambda flag: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(flag), F.struct("ord", "key")))), lambda x: x["key"]), ",")
    return t.groupBy("class_code").agg(F.count("*").alias("attributes"), named("mandatory").alias("mandatory"), named("blocking").alias("blocking"))


_FAMILIES = [("SS 316", "SS316"), ("UNS S31600", "SS316"), ("A4-70", "FC_A4_70"), ("ASTM A106 GR.B", "CS_A106B"), ("WCB", "WCB"), ("PAPER", None), ("", None)]


@query(stated("designation VARCHAR, family VARCHAR", _FAMILIES))
def kg_family(spark, d):
    return _given(spark, "designation string", [r[:1] for r in _FAMILIES]).select("designation", kg.family_of(F.col("designation")).alias("family"))


_SERVICES = [("NACE MR0175", "NACE MR0175", "IDENTICAL"), ("NACE MR0175", "", "UNKNOWN"), ("", "", "IDENTICAL"), (None, None, "IDENTICAL")]


@query(stated("a VARCHAR, b VARCHAR, relation VARCHAR", _SERVICES))
def kg_services(spark, d):
    return _given(spark, "a string, b string", [r[:2] for r in _SERVICES]).select("a", "b", kg.verdict_service(F.col("a"), F.col("b")).alias("relation"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({literal(f)}, {literal(v[0])}, {literal(v[1])})" for f, v in K.FAMILIES.items()) + ") t(family, label, citation)")
def kg_labels(spark, d):
    """The label of each family as it is shown, and the citation of its identity."""
    rows = kg.material_table(spark).where("fa = fb")
    return rows.select(F.col("fa").alias("family"), E.shown(F.col("fa")).alias("label"), "citation")


_SCALES_REQUIRE = [(s, ",".join(spec["requires"])) for s, spec in K.SCALES.items()]


@query(stated("scale VARCHAR, requires VARCHAR", _SCALES_REQUIRE))
def kg_requires(spark, d):
    return kg.scale_table(spark).select("scale", F.array_join("requires", ",").alias("requires")).distinct()


#: One description of each class that the material view lacks, and the values that it states.
_READ = [
    ('HEX BOLT 1/2"-13UNC X 50 MM B7 NACE MR0175', "FASTENER_BOLT", {"thread": '1/2"-13UNC', "length_mm": "50", "grade": "B7", "head": "HEX"}),
    ("NYLOC NUT M12 A4-70", "FASTENER_NUT", {"thread": "M12x1.75", "style": "NYLOC"}),
    ('ELBOW 90 DEG 2" SCH 40 A234 WPB BUTT WELD', "PIPE_FITTING", {"fitting_type": "ELBOW", "angle": "90DEG", "nominal_size": '2"', "schedule": "SCH40", "end_connection": "BW"}),
    ("CABLE 3C X 95 SQMM XLPE CU 1.1KV SWA", "CABLE", {"cores": "3", "csa_sqmm": "95", "voltage": "1100V", "insulation": "XLPE", "conductor": "CU", "armour": "SWA"}),
    ('SPIRAL WOUND GASKET 2" 300# SS316 GRAPHITE', "GASKET", {"gasket_type": "SPIRAL WOUND", "nominal_size": '2"', "pressure_class": "300", "material": "GRAPHITE", "winding": "SS316"}),
    ('GATE VALVE 2" 300# A105 FLANGED GEAR OPERATED', "VALVE", {"valve_type": "GATE", "nominal_size": '2"', "pressure_class": "300", "operation": "GO", "end_connection": "FLGD"}),
    ("ROLLER BEARING 6205-2RS C3", "BEARING", {"designation": "6205-2RS", "bore_mm": "25", "series": "62", "seal": "2RS", "clearance": "C3"}),
    ('SEAMLESS PIPE 1 1/2" SCH XS A106 GR.B', "PIPE", {"nominal_size": '1 1/2"', "schedule": "XS", "construction": "SEAMLESS"}),
]


@query(stated("n BIGINT, class_code VARCHAR, key VARCHAR, value VARCHAR", [(i, c, k, v) for i, (_, c, values) in enumerate(_READ) for k, v in values.items()]))
def ext_cases(spark, d):
    rows = _given(spark, "id long, cpse_code string, description string, uom string, unit_price double, annual_demand double", [(i, "A", t, "NO", 1.0, 1.0) for i, (t, _, _) in enumerate(_READ)])
    c = G.materialise(E.canonicalise(rows)).select(F.col("id").alias("n"), "class_code", F.explode("attributes").alias("key", "a"))
    wanted = _given(spark, "n long, key string", [(i, k) for i, (_, _, values) in enumerate(_READ) for k in values])
    return c.join(wanted, ["n", "key"], "left_semi").select("n", "class_code", "key", "a.value")


#: Pairs and the relation that the rules give them: the named pairs of the domain, and a variant, a stronger and an unlike one.
_RELATIONS = [
    ("HEX BOLT M12 X 50 SS316", 'BOLT HEX 1/2"-13UNC X 50 SS316', "DISTINCT", ""),
    ("HEX BOLT M12X50 MM SS316", "BOLT HEXAGON M12 X 50MM STAINLESS STEEL 316", "IDENTICAL", ""),
    ("BRG 6205 2RS", "BRG 6206 2RS", "DISTINCT", ""),
    ("CABLE 3CX95 SQMM XLPE CU 1.1KV SWA", "CABLE 3C X 95 SQMM XLPE CU 1100V ARMOURED", "EQUIVALENT", ""),
    ("CABLE 3CX95 SQMM XLPE CU 1.1KV SWA", "CABLE 3CX95 SQMM XLPE CU 1.1KV UNARMOURED", "DISTINCT", ""),
    ('GATE VALVE 2" 300# A105 FLANGED NACE MR0175', 'GATE VALVE 2" 300# A105 FLANGED', "UNDETERMINED", ""),
    ("HEX BOLT M12 X 50 SS316", "HEX BOLT M16 X 50 SS316", "VARIANT_OF", ""),
    ('PIPE 4" SCH 80 A106 GR.B', 'PIPE 4" SCH 40 A106 GR.B', "SUBSTITUTABLE", "a->b"),
    ('PIPE 4" SCH 40 A106 GR.B', 'PIPE 4" SCH 80 A106 GR.B', "SUBSTITUTABLE", "b->a"),
    ('GATE VALVE 2" 300# A105 FLANGED', "BRG 6205 2RS", "DISTINCT", ""),
]


def _related(spark) -> DataFrame:
    rows = [(2 * i + j, "AB"[j], r[j], "NO", 10.0, 2.0) for i, r in enumerate(_RELATIONS) for j in (0, 1)]
    recs = G.materialise(B.with_keys(G.materialise(E.canonicalise(_given(spark, "id long, cpse_code string, description string, uom string, unit_price double, annual_demand double", rows)))))
    pairs = _given(spark, "a_id long, b_id long", [(2 * i, 2 * i + 1) for i in range(len(_RELATIONS))])
    return M.with_features(M.solved(M.compared(pairs, M.facts(recs)))).withColumn("score", M.score(F.col("x")))


@query(stated("a_id BIGINT, relation VARCHAR, direction VARCHAR", [(2 * i, r[2], r[3]) for i, r in enumerate(_RELATIONS)]))
def rel_cases(spark, d):
    return _related(spark).select("a_id", "relation", F.coalesce("direction", F.lit("")).alias("direction"))


@query(stated("a_id BIGINT, tier VARCHAR", [(0, "auto_reject"), (2, "review"), (12, "review")]))
def dec_cases(spark, d):
    """Without calibration a conflict is rejected at once, and what is alike is reviewed."""
    return M.decided(_related(spark)).where("a_id IN (0, 2, 12)").select("a_id", "tier")


@query(stated("z DOUBLE, p DOUBLE", [(0.0, 0.5), (30.0, 1.0), (-30.0, 0.0), (100.0, 1.0)]))
def fit_sigmoid(spark, d):
    return _given(spark, "z double", [(0.0,), (30.0,), (-30.0,), (100.0,)]).select("z", F.round(Z.sigmoid(F.col("z")), 9).alias("p"))


# --- scores, labels, precision -----------------------------------------------


@query("SELECT l_returnflag AS tier, count(*) AS n, round(avg(CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS match_rate FROM lineitem GROUP BY 1")
def conf_precision(spark, d):
    return M.precision_by_tier(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("tier"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("label")))


_DECISIONS = "SELECT event_id AS decision_id, user_id % 500 AS proposal_id, CASE event_id % 7 WHEN 0 THEN 'reject' WHEN 1 THEN 'distinct' ELSE 'endorse' END AS decision, 'u' || (user_id % 13) AS actor, 'ORG' || (event_id % 4) AS actor_cpse, CASE WHEN event_id % 11 = 0 THEN 'registrar' ELSE 'steward' END AS actor_role FROM events"
_PROPOSALS = "SELECT range AS proposal_id, range * 2 AS a_id, range * 2 + 1 AS b_id, 'ORG' || (range % 4) AS a_org, 'ORG' || (range % 3) AS b_org FROM range(0, 600)"


def _decisions(spark, d) -> DataFrame:
    return table(spark, d, "events").selectExpr("event_id AS decision_id", "user_id % 500 AS proposal_id", "CASE event_id % 7 WHEN 0 THEN 'reject' WHEN 1 THEN 'distinct' ELSE 'endorse' END AS decision", "concat('u', user_id % 13) AS actor", "concat('ORG', event_id % 4) AS actor_cpse", "CASE WHEN event_id % 11 = 0 THEN 'registrar' ELSE 'steward' END AS actor_role")


def _proposals(spark) -> DataFrame:
    return spark.range(600).selectExpr("id AS proposal_id", "id * 2 AS a_id", "id * 2 + 1 AS b_id", "concat('ORG', id % 4) AS a_org", "concat('ORG', id % 3) AS b_org")


@query(
    f"WITH d AS ({_DECISIONS}), p AS ({_PROPOSALS}), r AS (SELECT proposal_id, max(decision_id) AS gone FROM d WHERE decision <> 'endorse' GROUP BY 1), v AS (SELECT d.* FROM d LEFT JOIN r USING (proposal_id) WHERE decision = 'endorse' AND (gone IS NULL OR decision_id > gone)),"
    " s AS (SELECT p.proposal_id, r.gone, count(DISTINCT CASE WHEN v.actor_cpse IN (a_org, b_org) THEN v.actor_cpse END) AS n, CASE WHEN a_org = b_org THEN 1 ELSE 2 END AS need, coalesce(bool_or(v.actor_role = 'registrar'), FALSE) AS reg FROM p LEFT JOIN v USING (proposal_id) LEFT JOIN r USING (proposal_id) GROUP BY p.proposal_id, r.gone, a_org, b_org)"
    " SELECT proposal_id, CASE WHEN n = need OR reg THEN 'endorsed' WHEN n > 0 THEN 'partial' WHEN gone IS NOT NULL THEN 'rejected' ELSE 'open' END AS status, CAST(need - n AS INT) AS waiting FROM s"
)
def stw_status(spark, d):
    """Status of every proposal after all decisions of the log."""
    return T.statuses(_proposals(spark), _decisions(spark, d)).select("proposal_id", "status", F.size("waiting_for").alias("waiting"))


@query(f"WITH d AS ({_DECISIONS}), p AS ({_PROPOSALS}) SELECT a_id AS a, b_id AS b, CASE WHEN arg_max(decision, decision_id) = 'endorse' THEN 'must' ELSE 'cannot' END AS kind FROM d JOIN p USING (proposal_id) WHERE decision <> 'reject' GROUP BY 1, 2")
def stw_constraints(spark, d):
    return T.constraints(_proposals(spark), _decisions(spark, d))


@query(f"WITH d AS ({_DECISIONS}), p AS ({_PROPOSALS}), l AS (SELECT proposal_id, arg_max(actor, decision_id) AS approved_by FROM d WHERE decision = 'endorse' GROUP BY 1) SELECT a_id AS from_id, b_id AS to_id, approved_by, CASE WHEN approved_by IS NULL THEN 'proposed' ELSE 'approved' END AS status FROM p LEFT JOIN l USING (proposal_id)")
def stw_substitutions(spark, d):
    edges = _proposals(spark)
    votes = _decisions(spark, d).where("decision = 'endorse'").join(edges, "proposal_id").select(F.col("a_id").alias("from_id"), F.col("b_id").alias("to_id"), "actor", "decision_id")
    return T.approved(edges.select(F.col("a_id").alias("from_id"), F.col("b_id").alias("to_id")), votes)


@query(MEMBERS.rstrip(", ") + " SELECT cpse_code || '|' || matnr || '|' || nmc AS idempotency_key, CASE WHEN id % 3 = 0 THEN 'applied' WHEN id % 5 = 0 THEN 'sent' ELSE 'queued' END AS status FROM members WHERE item % 2 = 0")
def stw_writebacks(spark, d):
    """Requests of every second code, and the last status that the systems told of them."""
    m = members(spark, d).withColumns({"class_code": F.lit("VALVE"), "golden_description": F.col("description")})
    queue = T.queued(m, m.where("item % 2 = 0"))
    key = F.concat_ws("|", "cpse_code", "matnr", "nmc").alias("idempotency_key")
    told = m.where("id % 5 = 0").select(key, F.lit("sent").alias("status"), F.lit(1).alias("at")).union(m.where("id % 3 = 0").select(key, F.lit("applied").alias("status"), F.lit(2).alias("at")))
    return T.with_status(queue, told).select("idempotency_key", "status")


@query(MEMBERS.rstrip(", ") + " SELECT nmc, count(*) FILTER (WHERE id % 6 <> 0) AS stay, count(*) FILTER (WHERE id % 6 = 0) AS gone FROM members GROUP BY nmc")
def reg_unlink(spark, d):
    """Every sixth member leaves its code."""
    m = members(spark, d)
    stay, split = T.unlinked(m, m.where("id % 6 = 0").select("nmc", "member"))
    told = split.select("nmc", F.size(F.from_json("payload_json", "members array<bigint>")["members"]).cast("long").alias("gone"))
    kept = stay.groupBy("nmc").agg(F.count("*").alias("stay"))
    return kept.join(told, "nmc", "full").select("nmc", F.coalesce("stay", F.lit(0)).alias("stay"), F.coalesce("gone", F.lit(0)).alias("gone"))


@query(MEMBERS.rstrip(", ") + " SELECT id, cpse_code, matnr FROM members WHERE id % 50 = 0")
def reg_by_ids(spark, d):
    m = members(spark, d)
    return T.by_ids(m, m.where("id % 50 = 0").select("id")).select("id", "cpse_code", "matnr")


@query("SELECT max(event_id) AS run_id, arg_max(user_id, event_id) AS started_by FROM events")
def reg_latest_run(spark, d):
    return T.latest_run(table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("started_by")))


@query("SELECT coalesce(l_returnflag, '*') AS source, count(*) FILTER (WHERE l_linestatus = 'O') AS positive, count(*) FILTER (WHERE l_linestatus <> 'O') AS negative, count(*) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def lab_summary(spark, d):
    return T.label_summary(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("source"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("label")))


@query("SELECT user_id AS a, event_id + 1000000 AS b, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS label FROM events")
def lab_steward(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") + 1_000_000).alias("a_id"), F.col("user_id").alias("b_id"), F.when(F.col("event_id") % 3 == 0, "reject").otherwise("endorse").alias("decision"))
    return M.steward_labels(e).select("a", "b", "label")


# --- codes and state ---------------------------------------------------------

_D5 = [[(i + j) % 5 if i < 5 and j < 5 else (i + (j - 5)) % 5 + 5 if i < 5 else (i - 5 - j) % 5 + 5 if j < 5 else (i - j) % 5 for j in range(10)] for i in range(10)]
_P = [list(range(10)), [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]]
while len(_P) < 8:
    _P.append([_P[-1][_P[1][j]] for j in range(10)])
CODES = (
    MEMBERS
    + f"g AS (SELECT item AS cluster_id, row_number() OVER (ORDER BY item) AS r FROM (SELECT DISTINCT item FROM members)), s AS (SELECT cluster_id, {Z.FIRST_SERIAL} + r AS serial FROM g), t AS (SELECT *, '4820{Z.COUNTRY}' || lpad(CAST(serial % 10000000 AS VARCHAR), 7, '0') AS core FROM s),"
    f" v AS (SELECT *, list_reduce(list_prepend(0, list_transform(range(0, 13), lambda i: {_P}[(i + 1) % 8 + 1][CAST(core[13 - i] AS INT) + 1])), lambda x, y: {_D5}[x + 1][y + 1]) AS c FROM t) "
)


@query(CODES + f"SELECT cluster_id, serial, '4820-{Z.COUNTRY}-' || substr(core, 7, 3) || '-' || substr(core, 10, 4) || '/' || list_position({_D5}[c + 1], 0) - 1 AS nmc FROM v")
def nmc_serials(spark, d):
    """A code for every item of the material view, as if all were valves."""
    g = members(spark, d).select(F.col("item").alias("cluster_id")).distinct().withColumn("class_code", F.lit("VALVE"))
    return R.mint(g).select("cluster_id", "serial", "nmc")


@query(stated("code VARCHAR, core VARCHAR, stated INT", [("5306-72-000-1234/5", "5306720001234", 5), ("5306 72 000 1234", "5306720001234", None), ("53067200012345", "5306720001234", 5), ("5306-72", None, None), ("", None, None)]))
def nmc_parse(spark, d):
    p = Z.parse(F.col("code"))
    return _given(spark, "code string", [("5306-72-000-1234/5",), ("5306 72 000 1234",), ("53067200012345",), ("5306-72",), ("",)]).select("code", p["core"].alias("core"), p["check"].alias("stated"))


@query(stated("part VARCHAR, digits INT, permanent BOOLEAN", [("class", 4, False), ("country", 2, True), ("serial", 7, True), ("check", 1, True)]))
def nmc_describe(spark, d):
    return W.code_parts(spark).select("part", F.length("example").alias("digits"), "permanent")


@query(MEMBERS.rstrip(", ") + " SELECT nmc, count(*) AS members FROM members WHERE item % 40 = 0 GROUP BY nmc")
def reg_members(spark, d):
    """Members by code, by way of clusters and minted codes."""
    m = members(spark, d)
    minted = m.select(F.col("item").alias("cluster_id"), "nmc").distinct().withColumns({"class_code": F.lit("VALVE"), "golden_description": F.lit("")})
    return R.members(minted, m.select(F.col("item").alias("cluster_id"), "id")).where(F.col("nmc").cast("long") % 40 == 0).groupBy("nmc").agg(F.count("*").alias("members"))


@query(MEMBERS.rstrip(", ") + " SELECT count(*) AS materials, count(DISTINCT cpse_code) AS organisations, count(*) AS active, CAST(0 AS BIGINT) AS quarantined, CAST(0 AS BIGINT) AS excluded FROM members")
def reg_counts(spark, d):
    r = records(spark, d)
    none = spark.createDataFrame([], "tier string, relation string")
    return R.counts(r, none, r.select("item").distinct()).select("materials", "organisations", "active", "quarantined", "excluded")


@query("SELECT TRUE AS enough, count(*) FILTER (WHERE vec_id % 50 = 0) AS asked FROM embeddings")
def vec_cells(spark, d):
    """Neighbours of every fiftieth vector by cells, held against those of all vectors: whether 0.9 of them are found."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(None).cast("string").alias("org"), F.col("embedding").alias("vector"))
    asked = v.where("id % 50 = 0")
    real = B.nearest(v, 10, asked, across=False).select("id", "other")
    got = B.nearest_in_cells(v, 10, asked, across=False).select("id", "other", F.lit(1).alias("hit"))
    met = real.join(got, ["id", "other"], "left")
    return met.agg((F.count("hit") >= 0.9 * F.count("*")).alias("enough"), F.count_distinct("id").alias("asked"))


@query("SELECT vec_id, CAST(64 AS INT) AS dim, CAST(256 AS INT) AS bytes, TRUE AS same FROM embeddings")
def vec_packed(spark, d):
    """Vectors packed to bytes and unpacked again."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    packed = W.pack(v)
    back = W.unpack(packed).select("vec_id", F.col("vector").alias("back"))
    met = v.join(back, "vec_id").join(packed.select("vec_id", F.octet_length("vector").alias("bytes")), "vec_id")
    return met.select("vec_id", F.size("back").alias("dim"), "bytes", (F.col("vector") == F.col("back")).alias("same"))


@query(stated("feature VARCHAR, weight DOUBLE, prior DOUBLE, moved DOUBLE", [(n, p + 0.5, p, 0.5) for n, p in M.PRIORS.items()]))
def fit_state(spark, d):
    """Weights saved, loaded and shown beside their priors."""
    at = folder(spark)
    W.save(spark, at, scorer=W.scorer_state([p + 0.5 for p in M.PRIORS.values()], [0.7, 0.4], 100))
    return W.weight_table(spark, W.weights_of(W.load(spark, at)["scorer"])).withColumns({c: F.round(c, 9) for c in ("weight", "prior", "moved")})


@query(ORACLES["conf_thresholds"])
def conf_state(spark, d):
    """Thresholds saved and loaded."""
    from partwise.plans.catalogue import conf_thresholds

    at = folder(spark)
    W.save_table(conf_thresholds(spark, d), at)
    return spark.read.parquet(at)


@query(stated("relation VARCHAR, both_ways BOOLEAN, one_code BOOLEAN", [("IDENTICAL", True, True), ("EQUIVALENT", True, True), ("SUBSTITUTABLE", False, False), ("VARIANT_OF", True, False), ("DISTINCT", True, False)]))
def rel_summary(spark, d):
    return W.relations(spark)


@query(stated("what VARCHAR, n INT", [("classes", 9), ("units", 23), ("packs", 10), ("families", 32), ("aliases", 140), ("links", 17), ("scales", 5), ("services", 4), ("superseded", 6)]))
def sys_info(spark, d):
    return W.system_tables(spark).where("what NOT IN ('attributes', 'shorthand')")


# --- ledger ------------------------------------------------------------------

LOG = "WITH log AS (SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'SPLIT' ELSE 'MERGED' END AS event_type, CAST(user_id % 97 AS VARCHAR) AS nmc FROM events) "


def _log(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "SPLIT").otherwise("MERGED").alias("event_type"), (F.col("user_id") % 97).cast("string").alias("subject"), F.lit("h").alias("hash"))


@query(LOG + "SELECT seq, event_type FROM log WHERE nmc = '7' ORDER BY seq DESC LIMIT 20 OFFSET 5")
def led_events(spark, d):
    """A page of the events of one code, the last first."""
    return L.events(_log(spark, d), 20, 5, "7").select("seq", "event_type")


@query(LOG + "SELECT max(seq) AS seq, count(*) AS events FROM log")
def led_head(spark, d):
    log = _log(spark, d)
    return spark.createDataFrame([(L.head(log)[0], log.count())], "seq long, events long")


@query(stated("seq BIGINT, event_type VARCHAR, linked BOOLEAN", [(1, "INGESTED", True), (2, "MERGED", True), (3, "SPLIT", True)]))
def led_append(spark, d):
    """Three events chained in two batches: each holds the hash of the one before."""
    first, at = L.append(spark, (0, L.GENESIS), [{"event_type": "INGESTED", "payload": {"rows": 3}, "actor": "a"}, {"event_type": "MERGED", "payload": {"nmc": "X", "members": [1, 2]}, "actor": "a"}])
    log = L.unmerge(spark, first, "X", [2], "b", "wrong")
    bad = L.verify(log).select("seq").withColumn("bad", F.lit(True))
    return log.join(bad, "seq", "left").select("seq", "event_type", F.col("bad").isNull().alias("linked"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS nmc, p_partkey % 5 = 0 AND p_partkey % 10 <> 0 AS deprecated FROM part")
def led_codes(spark, d):
    """Codes that a log of minting, deprecation and reinstatement leaves."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    told = lambda kind, where, at: p.where(where).select((F.col("k") + at).alias("seq"), F.lit(kind).alias("event_type"), F.to_json(F.struct(F.col("k").cast("string").alias("nmc"), F.lit("VALVE").alias("class_code"), F.lit("x").alias("golden_description"))).alias("payload_json"))
    log = told("MINTED", "true", 0).union(told("DEPRECATED", "k % 5 = 0", 10_000_000)).union(told("REINSTATED", "k % 10 = 0", 20_000_000))
    return L.codes(log).select("nmc", "deprecated")


# --- federation --------------------------------------------------------------


@query(MEMBERS.rstrip(", ") + " SELECT DISTINCT nmc, cpse_code AS org FROM members WHERE cpse_code <> 'ORG01' AND nmc IN (SELECT nmc FROM members WHERE cpse_code = 'ORG01' AND item % 10 = 0)")
def fed_surplus(spark, d):
    """Who is told that ORG01 asks for every tenth item that it holds."""
    m = members(spark, d)
    asked = m.where("cpse_code = 'ORG01' AND item % 10 = 0").select("nmc", F.lit("ORG01").alias("org"), F.lit(1.0).alias("qty"))
    return D.broadcast_surplus(asked, m.select("nmc", F.col("cpse_code").alias("org"))).select("nmc", "org")


@query(stated("what VARCHAR, holds BOOLEAN", [("as exported", True), ("body changed", False), ("other key", False)]))
def fed_bundle(spark, d):
    rows = spark.createDataFrame([(1, "A")], "id long, cpse_code string")
    b = D.export_bundle(rows, "node", "key")
    told = [("as exported", D.verify_bundle(b, "key")["valid"]), ("body changed", D.verify_bundle(b | {"body": b["body"] + " "}, "key")["valid"]), ("other key", D.verify_bundle(b, "other")["valid"])]
    return spark.createDataFrame(told, "what string, holds boolean")


@query(stated("field VARCHAR, leaves BOOLEAN", [("id", True), ("cpse_code", True), ("description", True), ("uom", True), ("unit_price", False), ("stock_qty", False), ("annual_demand", False), ("vendor_id", False), ("mfr_part_no", False), ("currency", False)]))
def fed_boundary(spark, d):
    told = D.boundary(material(spark, d))
    rows = [(c, c in told["leaves"]) for c in ("id", "cpse_code", "description", "uom", "unit_price", "stock_qty", "annual_demand", "vendor_id", "mfr_part_no", "currency")]
    return spark.createDataFrame(rows, "field string, leaves boolean")


@query(stated("id BIGINT, text VARCHAR, plain VARCHAR", [(1, "café", "cafe"), (2, "Ø10 – 20", None), (3, "ｆｕｌｌ", "full"), (4, "plain", "plain")]))
def txt_accents(spark, d):
    rows = _given(spark, "id long, text string", [(1, "café"), (2, "Ø10 – 20"), (3, "ｆｕｌｌ"), (4, "plain")])
    return rows.select("id", "text", F.when(F.col("id") != 2, X.strip_accents(F.col("text"))).alias("plain"))
