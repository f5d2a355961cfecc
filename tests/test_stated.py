"""Queries over stated cases and small tables against their SQL; steward decisions, state and neighbours by cells."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from partwise.operators import blocking as B, compare as M, models as W, stewardship as T
from partwise.plans import catalogue
from partwise.sources import odata

SF = "/root/testdata/sf0.001"
NAMES = "src_csv src_json src_odata src_ingest erp_posted uom_cases uom_packs cls_cases kg_family ext_cases rel_cases stw_status stw_constraints stw_writebacks reg_unlink nmc_serials nmc_parse led_append led_codes led_chain fed_bundle lex_parts vec_cells".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", [n for n in NAMES if n in catalogue.ORACLES])
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    plain = lambda v: repr(round(float(v), 8)) if isinstance(v, float) else str(v)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    told = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in told.fetchall())


def test_chains_of_days_are_those_of_a_loop(spark):
    from partwise.operators import ledger as L

    rows = [(i, "MERGED", f'{{"n":{i}}}', "a", f"2024-01-{1 + i % 3:02d}T00:00:00Z") for i in range(50)]
    log = L.chain_by_day(spark.createDataFrame(rows, "event_id long, event_type string, payload_json string, actor string, created_at string")).orderBy("seq").collect()
    prev = {}
    for r, (_, kind, payload, actor, at) in zip(log, rows, strict=True):
        before = prev.get(at[:10], L.GENESIS)
        assert r.prev_hash == before and r.hash == L.digest(r.seq, kind, payload, actor, before, at)
        prev[at[:10]] = r.hash


def test_rejections_void_what_was_before(spark):
    p = spark.createDataFrame([(1, 10, 11, "A", "B"), (2, 20, 21, "A", "B")], "proposal_id long, a_id long, b_id long, a_org string, b_org string")
    d = spark.createDataFrame([(1, 1, "endorse", "x", "A", "steward"), (2, 1, "reject", "y", "B", "steward"), (3, 1, "endorse", "x", "B", "steward"), (4, 2, "endorse", "x", "A", "steward"), (5, 2, "endorse", "x", "B", "steward")], "decision_id long, proposal_id long, decision string, actor string, actor_cpse string, actor_role string")
    got = {r.proposal_id: (r.status, r.waiting_for) for r in T.statuses(p, d).collect()}
    assert got == {1: ("partial", ["A"]), 2: ("endorsed", [])}


def test_state_round_trips(spark, tmp_path):
    weights = [0.1 * i for i in range(len(M.PRIORS))]
    W.save(spark, f"{tmp_path}/s", scorer=W.scorer_state(weights, [1.0], 5))
    assert W.weights_of(W.load(spark, f"{tmp_path}/s")["scorer"]) == weights
    v = spark.createDataFrame([(1, [0.5, -1.25]), (2, None), (3, [])], "id long, vector array<float>")
    assert [r.vector for r in W.unpack(W.pack(v)).orderBy("id").collect()] == [[0.5, -1.25], None, []]


def test_connection_tells_no_secret():
    c = odata.Connection.from_config("A", {"mode": "odata", "base_url": "http://x/", "password": "p", "username": "u"})
    assert "p" not in str(c.describe().values()).replace("API", "").replace("http", "") or "password" not in str(c)
    assert c.read_url(10).startswith("http://x/sap/") and "password" not in repr(c)
    with pytest.raises(ValueError):
        odata.Connection.from_config("A", {"mode": "ftp"})


def test_neighbours_by_cells_and_a_hot_cell(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 16))
    v = np.concatenate([middle[rng.integers(0, 12, 400)] + 0.2 * rng.normal(size=(400, 16)), np.repeat(middle[:1], 200, axis=0) + 0.01 * rng.normal(size=(200, 16))])
    df = spark.createDataFrame([(i, "A", x.tolist()) for i, x in enumerate(v)], "id long, org string, vector array<float>")
    asked = df.where(F.col("id") % 50 == 0)
    real = {(r.id, r.other) for r in B.nearest(df, 5, asked, across=False).collect()}
    got = {(r.id, r.other) for r in B.nearest_in_cells(df, 5, asked, cells=12, probes=3, across=False, most=50).collect()}
    assert len(real & got) >= 0.9 * len(real)
