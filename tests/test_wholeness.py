"""Work that is done once per value, and nothing that is left out."""

import numpy as np
from pyspark.sql import functions as F

from partwise.operators import blocking as B
from partwise.operators import compare as M
from partwise.operators import extract as E
from partwise.operators import graph as G
from partwise.operators import service as S
from partwise.plans import catalogue
from partwise.plans import harmonise as H
from partwise.sources import writers

ITEM = "id long, cpse_code string, description string, uom string, unit_price double, annual_demand double, mfr_part_no string"


def test_each_different_text_is_read_once(spark):
    rows = [(i, "AB"[i % 2], ["HEX BOLT M12 X 50 SS316", "BRG 6205 2RS", None][i % 3], ["NO", None][i % 2], 1.0 + i, 1.0, None if i % 5 else f"PN-{i:06d}") for i in range(60)]
    items = spark.createDataFrame(rows, ITEM)
    seen = []
    one = G.materialise(B.with_keys(E.canonicalise(items)))
    two = B.with_keys(E.canonical(items, more=lambda read: (seen.append(read.count()), B.with_text_keys(read))[1]))
    assert seen == [len({(r[2], r[3], r[6]) for r in rows})]
    plain = lambda df: {r.id: str([r[c] for c in one.columns]) for r in df.select(*one.columns).collect()}
    assert plain(one) == plain(two)


def test_records_that_share_only_a_common_token_are_judged(spark):
    rows = [(i, "A", [f"tok:SEAMLESS", f"attr:{i}"]) for i in range(450)]
    reps = G.materialise(spark.createDataFrame(rows, "id long, cpse_code string, keys array<string>"))
    assert catalogue.close_pairs(reps).count() == 450 * 449 // 2


def test_the_scorer_sees_every_label(spark):
    """Few pairs of one kind among many of another: no draw, and the same weights on the driver and where the rows are."""
    rng = np.random.default_rng(1)
    x = np.round(rng.random((3000, len(M.PRIORS))), 3)
    y = (x[:, 2] > 0.7).astype(int)
    df = G.materialise(spark.createDataFrame([(r.tolist(), int(v)) for r, v in zip(x, y)] * 2, "x array<double>, label int"))
    want, _ = M.fit_scorer(np.vstack([x, x]), np.tile(y.astype(float), 2), epochs=5)
    for most in (100_000, 10):
        got, _ = M.fit_on_all(df, most, epochs=5)
        assert np.allclose(got, want, atol=1e-9)


def test_all_labels_are_used(spark):
    items = [(i, f"O{i % 7}", f"HEX BOLT M{4 + i // 40} X {20 + 5 * (i % 40)} MM SS316", "NO", 1.0, 1.0, None) for i in range(200)]
    recs = H.records_of(spark.createDataFrame(items, ITEM))
    judged = H.verdicts(catalogue.close_pairs(recs), recs)
    scored, _, _ = H.training(judged, recs)
    near = judged.where(M.nearly()).count()
    assert near > 4000 and scored.where("label = 0").count() == near


def test_nearest_rows_are_those_of_all_rows(spark):
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 4, (30, 6)).astype(float) + 0.1
    rows = [(int(i), None, [float(v) for v in kinds[rng.integers(0, 30)]]) for i in range(300)]
    v = G.materialise(spark.createDataFrame(rows, "id long, org string, vector array<float>"))
    asked = v.where("id % 5 = 0")
    plain = lambda df: sorted((r.id, r.other, round(r.cosine, 9)) for r in df.collect())
    assert plain(S.nearest_rows(v, 7, asked)) == plain(B.nearest(v, 7, asked, across=False))


def test_equal_texts_have_one_vector(spark):
    rows = [(i, "A", ["BOLT M12", "NUT M8", ""][i % 3]) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, cpse_code string, normal string")
    idf = B.document_frequency(df)
    assert {r.feature: r.df for r in idf.where("feature IN ('w:BOLT', 'b:NUT_M8')").collect()} == {"w:BOLT": 3, "b:NUT_M8": 3}
    got = {r.id: r.vector for r in B.embed(df, 16, idf).collect()}
    assert set(got) == {0, 1, 3, 4, 6, 7} and got[0] == got[3] == got[6] != got[1]


def test_the_outbox_is_small_and_holds_each_request_once(spark, tmp_path):
    rows = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("idempotency_key"), F.repeat(F.lit("payload "), 50).alias("payload"))
    for _ in range(2):
        writers.write_outbox(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("part-*")) < 2000 * 100
