"""Queries of the catalogue look at all records."""

from partwise.operators import service
from partwise.plans import catalogue


def test_duplicate_check_ranks_all_records_by_cosine(spark, monkeypatch):
    seen = {}

    def asked_with(asked, registry, vectors=None):
        seen.update(asked=asked, registry=registry, vectors=vectors)
        return asked

    monkeypatch.setattr(service, "duplicate_check", asked_with)
    d = "/root/testdata/sf0.001"
    catalogue.svc_dup_check(spark, d)
    n = catalogue.records(spark, d).count()
    assert seen["registry"].count() == n and seen["vectors"][1].count() == n
    assert seen["vectors"][0].count() == seen["asked"].count() > 0
    assert seen["registry"].where("exists(keys, k -> startswith(k, 'tok:'))").count() > 0
