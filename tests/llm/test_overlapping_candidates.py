"""Candidates of several kinds in one place: each is judged, and the right one stays."""

from terrafold.llm import pii

from .cases import DOCS

IBANS = ("DE89370400440532013000", "ES9121000418450200051332", "FR1420041010050500013M02606", "GB29NWBK60161331926819")


def test_compact_ibans_are_found_and_masked(spark):
    rows = [(i, f"{t} account {IBANS[i % 4]} for the rent", "", "", 1) for i, t in enumerate(["é", "my bank"] * 20)]
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    rows += [(100 + i, f'token = "{key[i:] + key[:i]}"', "", "", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["spans"] for r in pii.span_digests(docs).collect()}
    for i, t, *_ in rows[:40]:
        at = t.index(IBANS[i % 4])
        assert got[i] == f"iban:{at}:{at + len(IBANS[i % 4])}"
    assert all(got[100 + i].startswith("secret:") for i in range(20))
    out = {r["doc_id"]: r["text"] for r in pii.mask(docs).collect()}
    assert all(out[i].endswith(" account <IBAN> for the rent") for i in range(40)) and out[100] == 'token = "<SECRET>"'


def test_both_kinds_are_candidates_and_overlaps_are_resolved_after_the_verdict():
    text = f"account {IBANS[0]}"
    found = pii.candidates(text, [])
    assert [(s, k, e) for s, k, e, *_ in found] == [(8, "secret", 30), (8, "iban", 30)]
    assert pii.resolved([(8, "secret", 30, "0"), (8, "iban", 30, "1,0")]) == [(8, "iban", 30)]
    assert pii.resolved([(8, "secret", 30, "1"), (8, "iban", 30, "0,1")]) == [(8, "secret", 30)]
    assert pii.resolved([(8, "secret", 30, "1"), (20, "iban", 44, "1,0"), (44, "name", 50, "1")]) == [(8, "secret", 30), (44, "name", 50)]
