import numpy as np
import pytest
from pyspark.sql import functions as F

from partwise.operators import blocking as B, compare as M, extract as E, graph as G

CASES = [
    ("HEX BOLT M12 X 50 SS316", 'BOLT HEX 1/2"-13UNC X 50 SS316', "DISTINCT"),
    ("HEX BOLT M12X50 MM SS316", "BOLT HEXAGON M12 X 50MM STAINLESS STEEL 316", "IDENTICAL"),
    ("BRG 6205 2RS", "BRG 6206 2RS", "DISTINCT"),
    ("CABLE 3CX95 SQMM XLPE CU 1.1KV SWA", "CABLE 3C X 95 SQMM XLPE CU 1100V ARMOURED", "EQUIVALENT"),
    ("CABLE 3CX95 SQMM XLPE CU 1.1KV SWA", "CABLE 3CX95 SQMM XLPE CU 1.1KV UNARMOURED", "DISTINCT"),
    ('GATE VALVE 2" 300# A105 FLANGED NACE MR0175', 'GATE VALVE 2" 300# A105 FLANGED', "UNDETERMINED"),
    ("HEX BOLT M12 X 50 SS316", "HEX BOLT M16 X 50 SS316", "VARIANT_OF"),
    ('PIPE 4" SCH 80 A106 GR.B', 'PIPE 4" SCH 40 A106 GR.B', "SUBSTITUTABLE"),
    ('GATE VALVE 2" 300# A105 FLANGED', "BRG 6205 2RS", "DISTINCT"),
]


@pytest.fixture(scope="module")
def recs(spark):
    rows = [(2 * i + j, "AB"[j], c[j], "NO", 10.0, 2.0) for i, c in enumerate(CASES) for j in (0, 1)]
    rows += [(100, "A", "SKID MOUNTED PUMP", "NO", 1.0, 1.0), (101, "A", "WIDGET", None, None, None), (102, "A", None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, cpse_code string, description string, uom string, unit_price double, annual_demand double")
    return G.materialise(B.with_keys(G.materialise(E.canonicalise(df))))


def test_status(recs):
    got = {r.id: r.status for r in recs.where("id >= 100").collect()}
    assert got == {100: "excluded", 101: "quarantine", 102: "quarantine"}


def test_relations(spark, recs):
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(len(CASES))], "a_id long, b_id long")
    judged = M.with_features(M.solved(M.compared(pairs, M.facts(recs)))).withColumn("score", M.score(F.col("x")))
    rows = {r.a_id: r for r in M.decided(judged).withColumn("card", F.to_json(M.evidence_card())).withColumn("said", M.narrative()).collect()}
    assert [rows[2 * i].relation for i in range(len(CASES))] == [c[2] for c in CASES]
    assert rows[14].direction == "a->b" and rows[10].blocked_by == "service_qualifier"
    assert rows[2].x[0] == 1.0 and len(rows[2].x) == len(M.PRIORS)
    assert rows[0].tier == "auto_reject" and rows[12].tier == "review" and rows[2].tier == "review"
    assert "attributes" in rows[2].card and rows[2].said.startswith("Records 2 and 3 are IDENTICAL")


def test_keys_and_pairs(spark):
    rows = [(1, "A", "Maker", "PN-1234", None, None), (2, "B", "MAKER", "pn1234", None, None), (3, "A", "MAKER", "PN 1234", "V1", "99-9"), (4, "B", None, None, "V1", "999"), (5, "C", None, "12", None, None)]
    df = spark.createDataFrame(rows, "id long, cpse_code string, mfr_name string, mfr_part_no string, vendor_id string, vendor_matl_no string").withColumn("keys", B.identity_keys())
    got = {(r.a_id, r.b_id): r.strategies for r in B.key_pairs(df).collect()}
    assert got == {(1, 2): ["mpn"], (2, 3): ["mpn"], (3, 4): ["vmn"]}
    truth = spark.createDataFrame([(1, 2), (1, 5)], "a_id long, b_id long")
    assert B.recall(B.key_pairs(df), truth).first().recall == 0.5


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(i, "AB"[i % 2], v[i].tolist()) for i in range(60)], "id long, org string, vector array<float>")
    got = {}
    for r in B.nearest(df, 3, blocks=4).collect():
        got.setdefault(r.id, []).append((-round(r.cosine, 9), r.other))
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for i in range(60):
        want = sorted((-round(float(u[i] @ u[j]), 9), j) for j in range(60) if j % 2 != i % 2)[:3]
        assert [o for _, o in sorted(got[i])] == [o for _, o in want]


def test_thresholds(spark):
    rows = [("BEARING", 0.01 * k, 0) for k in range(1, 31)] + [("BEARING", 0.75 + 0.005 * k, 1) for k in range(49)] + [("CABLE", 0.5, 1)]
    got = {r.class_code: r for r in M.thresholds(spark.createDataFrame(rows, "class_code string, score double, label int")).collect()}
    assert got["BEARING"].accept == 0.55 and got["BEARING"].reject == 0.5
    assert got["CABLE"].fallback and not got["BEARING"].fallback and "*" in got


def test_clusters(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "id long")
    edges = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.8), (3, 4, 0.9), (4, 5, 0.7), (0, 0, 1.0)], "a long, b long, weight double")
    cannot = spark.createDataFrame([(1, 2)], "a long, b long")
    must = spark.createDataFrame([(6, 7)], "a long, b long")
    got = {r.id: r.cluster_id for r in G.cluster(nodes, edges, must, cannot).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 3, 6: 6, 7: 6}
    roots = {r.id: r.root for r in G.with_components(nodes, edges).collect()}
    assert roots == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7}
    clusters = spark.createDataFrame(list(got.items()), "id long, cluster_id long")
    truth = spark.createDataFrame([(i, "x" if i < 4 else "y") for i in range(8)], "id long, label string")
    assert G.purity(clusters, truth).first().impure == 1
    pr = G.precision_recall(G.cluster_pairs(clusters), spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")).first()
    assert (pr.tp, pr.fn) == (1, 1)


def test_fit_moves_towards_labels():
    x = np.ones((40, len(M.PRIORS)))
    w, loss = M.fit_scorer(x, np.zeros(40))
    before = float(np.ones(len(M.PRIORS)) @ np.array(list(M.PRIORS.values())))
    assert sum(w) < before and loss > 0


def test_shorthand(spark):
    rows = [(i, f"GALV STEEL PLATE {i} HEAVY DUTY") for i in range(4)] + [(10 + i, f"GALVANISED STEEL PLATE {i} HEAVY DUTY") for i in range(4)] + [(20 + i, f"BRNG ROLLER TAPERED CHROME {i}") for i in range(4)] + [(30 + i, f"BEARING ROLLER TAPERED CHROME {i}") for i in range(4)]
    rows += [(100 + i, f"UNRELATED ITEM NUMBER X{i}") for i in range(40)]
    got = {r.short: r.long for r in B.mine_shorthand(spark.createDataFrame(rows, "id long, own_clean string")).collect()}
    assert got.get("BRNG") == "BEARING"
    assert "GALV" not in got  # known already
