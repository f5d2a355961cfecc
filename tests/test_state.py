from pyspark.sql import functions as F

from partwise.operators import analytics as A, federation as D, ledger as L, registry as R
from partwise.sources import readers, writers


def test_ledger(spark):
    log, top = L.append(spark, (0, L.GENESIS), [{"event_type": "MERGED", "payload": {"nmc": "X", "members": [1, 2]}, "actor": "a"}, {"event_type": "MERGED", "payload": {"nmc": "Y", "members": [3]}, "actor": "a"}])
    assert L.head(log) == top and L.verify(log).count() == 0
    split = L.unmerge(spark, log, "X", [2], "b", "wrong")
    assert L.verify(split).count() == 0
    now = lambda x, **k: sorted((r.nmc, r.member) for r in L.replay(x, **k).collect())
    assert now(split) == [("X", 1), ("Y", 3)] and now(split, upto=2) == [("X", 1), ("X", 2), ("Y", 3)]
    forged = split.withColumn("payload_json", F.when(F.col("seq") == 2, F.lit("{}")).otherwise(F.col("payload_json")))
    assert [r.seq for r in L.verify(forged).collect()] == [2]
    assert L.projection_difference(split, L.replay(log)).collect()[0]["where"] == "table"


def test_endorsement(spark):
    p = spark.createDataFrame([(1, "A", "B"), (2, "A", "A"), (3, "A", "B")], "proposal_id long, a_org string, b_org string")
    d = spark.createDataFrame([(1, "endorse", "A", "steward"), (1, "endorse", "C", "steward"), (2, "endorse", "A", "steward"), (3, "endorse", "Z", "registrar")], "proposal_id long, decision string, actor_cpse string, actor_role string")
    got = {r.proposal_id: r.complete for r in L.endorsements(p, d).collect()}
    assert got == {1: False, 2: True, 3: True}


def test_registry_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, at int")
    new = spark.createDataFrame([(2, "c", 5), (2, "d", 6), (3, "e", 1)], "k long, v string, at int")
    assert sorted(map(tuple, R.upsert(old, new, ["k"], "at").collect())) == [(1, "a", 1), (2, "d", 6), (3, "e", 1)]


def test_value(spark):
    rows = [("X", 1, "A", 10.0, 5.0, 2.0, 400), ("X", 2, "B", 0.0, 4.0, 3.0, 10), ("Y", 3, "A", 1.0, 0.0, 1.0, 0)]
    m = spark.createDataFrame(rows, "nmc string, member long, cpse_code string, stock_qty double, annual_demand double, base_price double, last_movement_days int")
    assert [r.value for r in A.redeployment(m).collect()] == [12.0]
    agg = A.aggregation(m).first()
    assert (agg.nmc, agg.annual_spend, agg.price_spread) == ("X", 22.0, 1.5)
    assert A.upkeep(m).first().value == 850.0
    assert {r.lever for r in A.value_model(m).collect()} == {"redeployment", "pooling", "aggregation", "upkeep"}


def test_federation(spark):
    prices = spark.createDataFrame([("X", o, p) for o, p in (("A", 1.0), ("A", 3.0), ("B", 4.0), ("C", 6.0), ("D", 8.0))] + [("Y", "A", 1.0)], "nmc string, org string, price double")
    band = D.price_bands(prices).collect()
    assert len(band) == 1 and (band[0].min, band[0].p25, band[0].median, band[0].p75, band[0].max) == (2.0, 2.0, 5.0, 8.0, 8.0)
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    got = D.overlap(D.offer(keys("a", "b", "b"), "s"), D.offer(keys("b", "c", "d"), "s")).first()
    assert tuple(got) == (1, 1, 2)
    bundle = D.export_bundle(prices, "node", "key")
    assert D.verify_bundle(bundle, "key")["valid"] and not D.verify_bundle(bundle | {"body": "x"}, "key")["valid"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Item Code;Desc;Rate;Qty;Colour\nM1;"BOLT; HEX";1,250.5;x;red\nM2;;3;1;blue\n')
    got = readers.read_csv(spark, str(tmp_path / "a.csv"), "ORG").collect()
    assert len(got) == 1 and (got[0].matnr, got[0].description, got[0].unit_price, got[0].stock_qty, got[0].cpse_code) == ("M1", "BOLT; HEX", 1250.5, None, "ORG")
    (tmp_path / "b.json").write_text('{"d": {"results": [{"material": "M3", "description": "NUT"}]}}')
    assert readers.read_json(spark, str(tmp_path / "b.json")).first().matnr == "M3"
    (tmp_path / "MARA.csv").write_text("MATNR,MEINS\n1,NO\n2,M\n")
    (tmp_path / "MAKT.csv").write_text("MATNR,MAKTX\n1,OLD\n1,NEW\n")
    erp = {r.matnr: r.description for r in readers.read_erp_tables(spark, str(tmp_path), "ORG").collect()}
    assert erp == {"1": "NEW", "2": "2"}
    first = readers.ingest(readers.read_erp_tables(spark, str(tmp_path), "ORG"))
    again = readers.ingest(readers.read_csv(spark, str(tmp_path / "a.csv"), "ORG"), first)
    assert sorted(r.id for r in again.collect()) == [1, 2, 3]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "A"), ("k1", "A"), ("k2", "B")], "idempotency_key string, cpse_code string")
    out = str(tmp_path / "box")
    writers.write_outbox(rows, out)
    writers.write_outbox(rows, out)
    assert spark.read.json(out).count() == 2
