from quillstone import api

ROWS = [
    ("a_0001", "a", "First", "Smith, deep learning", "Deep learning", "Smith", "10.1/x", "VALID_CORRECT", "HIGH", True, False),
    ("a_0002", "a", "First", "Doe, 100% sure", "Sure", "Doe", "", "DOI_MISSING", "LOW", False, True),
    ("b_0001", "b", "Second", "Roe, trade", "Trade", "Roe", None, "AMBIGUOUS", "LOW", None, True),
]
COLUMNS = "reference_id string, source_eid string, source_title string, raw_reference string, resolved_title string, resolved_authors string, normalized_doi string, final_status string, confidence string, scopus_link_valid boolean, needs_human_review boolean"


def test_entry_points(spark):
    refs = spark.createDataFrame(ROWS, COLUMNS)
    k = api.stats(refs)["kpis"].first()
    assert (k.total_references, k.total_documents, k.linked, k.review, k.with_doi) == (3, 2, 1, 2, 1)
    assert [(r.confidence, r.n) for r in api.stats(refs)["confidences"].collect()] == [("LOW", 2), ("HIGH", 1)]
    rows, totals = api.references(refs, size=1, page=2, sort_by="final_status", direction="desc")
    assert rows.first().reference_id == "a_0002" and tuple(totals.first()) == (3, 3)
    ids = lambda **f: [r.reference_id for r in api.found(refs, **f).orderBy("reference_id").collect()]
    assert ids(search=" DEEP ") == ["a_0001"] and ids(has_doi=False) == ["a_0002", "b_0001"] and ids(has_doi=True) == ["a_0001"]
    assert ids(status="AMBIGUOUS, DOI_MISSING") == ["a_0002", "b_0001"] and ids(linked=False) == ["a_0002"] and ids(source_eid="b") == ["b_0001"]
    assert [(r.source_eid, r.ref_count) for r in api.documents(refs).collect()] == [("a", 2), ("b", 1)]
    assert len(api.document(refs, "a").first().references) == 2 and api.export(refs, confidence="LOW").count() == 2
    over = spark.createDataFrame([("a_0002", "checked", "DOI_RECOVERED")], "reference_id string, notes string, status string")
    r = {x.reference_id: (x.reviewed_by_user, x.final_status) for x in api.reviewed(refs, over).collect()}
    assert r["a_0002"] == (True, "DOI_RECOVERED") and r["a_0001"] == (False, "VALID_CORRECT")
