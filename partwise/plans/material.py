"""The material view: item master rows of 14 organisations, derived from lineitem.

One SQL text that Spark and DuckDB both run; (organisation, item) is unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MATERIAL_SQL = """
WITH base AS (
  SELECT l_suppkey % 14 AS org, l_partkey AS item, min(l_extendedprice) AS unit_price,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS stock_qty, CAST(count(*) AS DOUBLE) AS annual_demand, min(l_suppkey) AS supp
  FROM lineitem GROUP BY l_suppkey % 14, l_partkey
), shape AS (
  SELECT *, item * 14 + org AS id, org % 3 AS style, item % 4 AS kind, CAST(floor(item / 4.0) AS BIGINT) AS q FROM base
), dims AS (
  SELECT *, CAST(4 + q % 20 AS VARCHAR(10)) AS z,
    CAST(6000 + (CAST(floor(q / 93.0) AS BIGINT) % 3) * 100 + (q % 93) + 4 AS VARCHAR(10)) AS brg,
    CAST(20 + 5 * (CAST(floor(q / 20.0) AS BIGINT) % 17) AS VARCHAR(10)) AS len,
    CASE CAST(floor(q / 20.0) AS BIGINT) % 5 WHEN 0 THEN '20' WHEN 1 THEN '40' WHEN 2 THEN '80' WHEN 3 THEN '120' ELSE '160' END AS sch,
    CASE CAST(floor(q / 20.0) AS BIGINT) % 5 WHEN 0 THEN '150' WHEN 1 THEN '300' WHEN 2 THEN '600' WHEN 3 THEN '900' ELSE '1500' END AS pc,
    CASE CAST(floor(q / 100.0) AS BIGINT) % 4 WHEN 0 THEN 'GATE' WHEN 1 THEN 'GLOBE' WHEN 2 THEN 'BALL' ELSE 'CHECK' END AS vt
  FROM shape
)
SELECT id, concat('ORG', lpad(CAST(org AS VARCHAR(10)), 2, '0')) AS cpse_code, concat('M', CAST(item AS VARCHAR(20))) AS matnr, item,
  CASE
    WHEN kind = 0 AND style = 0 THEN concat('BEARING ', brg, '-2RS')
    WHEN kind = 0 AND style = 1 THEN concat('BRG ', brg, ' 2RS')
    WHEN kind = 0 THEN concat('BALL BEARING ', brg, '2RS DEEP GROOVE')
    WHEN kind = 1 AND style = 0 THEN concat('HEX BOLT M', z, 'X', len, ' MM SS316')
    WHEN kind = 1 AND style = 1 THEN concat('BOLT HEXAGON M', z, ' X ', len, 'MM, STAINLESS STEEL 316')
    WHEN kind = 1 THEN concat('BLT HEX M', z, ' X', len, ' SS-316')
    WHEN kind = 2 AND style = 0 THEN concat('PIPE SEAMLESS ', z, '" SCH ', sch, ' A106 GR.B')
    WHEN kind = 2 AND style = 1 THEN concat('SMLS PIPE ', z, ' INCH SCH', sch, ' A106B')
    WHEN kind = 2 THEN concat('PIPE ', z, 'NB SCHEDULE ', sch, ' ASTM A106 GR.B')
    WHEN style = 0 THEN concat(vt, ' VALVE ', z, '" ', pc, '# WCB FLANGED')
    WHEN style = 1 THEN concat('VALVE ', vt, ' ', z, ' INCH CLASS ', pc, ' A216 WCB FLGD')
    ELSE concat(vt, 'VALVE ', z, '" CL ', pc, ' WCB FLGD')
  END AS description,
  CASE WHEN kind = 2 AND style = 2 THEN 'COIL' WHEN kind < 2 AND style = 1 THEN 'BOX' WHEN kind = 2 THEN 'M' ELSE 'NO' END AS uom,
  unit_price, 'INR' AS currency, stock_qty, annual_demand, CAST(id % 1300 AS INT) AS last_movement_days,
  CASE WHEN org % 5 = 0 THEN concat('MAKER', CAST(item % 7 AS VARCHAR(10))) END AS mfr_name,
  CASE WHEN org % 5 = 0 THEN concat('PN-', lpad(CAST(item AS VARCHAR(20)), 6, '0')) END AS mfr_part_no,
  CASE WHEN supp % 3 = 0 THEN concat('V', CAST(supp AS VARCHAR(20))) END AS vendor_id,
  CASE WHEN supp % 3 = 0 THEN concat('VM', CAST(item AS VARCHAR(20))) END AS vendor_matl_no,
  concat('PL', CAST(id % 5 AS VARCHAR(10))) AS plant
FROM dims
"""


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item master rows; the scan reads the five columns of lineitem that are used."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(MATERIAL_SQL.replace("FROM lineitem", "FROM {lines}"), lines=lines)
