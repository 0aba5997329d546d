"""The protocol's whole grid, and labels from terms that verification kept."""

from terrafold.plans import catalog, pipeline

SF = "/root/testdata/sf0.001"


def test_clean_protocol_has_every_variant_under_every_mapper(spark):
    rows = catalog.queries()["clean_protocol"](spark, SF).collect()
    assert {(r["variant"], r["mapper"]) for r in rows} == {(v, m) for v in pipeline.VARIANTS for m in ("rule", "shifted", "nearest")}
    assert len(rows) == 21


def test_modular_labels_come_from_verified_terms(spark, monkeypatch):
    seen = []
    real = pipeline.verified_terms
    monkeypatch.setattr(pipeline, "verified_terms", lambda *a: seen.append(real(*a)) or seen[-1])
    out = catalog.queries()["modular_labels"](spark, SF)
    assert out.count() == 1000
    frames = {r["frame_id"] for r in out.select("frame_id").distinct().collect()}
    assert {r["frame_id"] for r in seen[0].collect()} == frames
