"""Terms disclose by their documents, wherever they stand."""

from math import log2

from lodestone.llm import pii


def test_far_terms_and_counts(spark):
    rows = [(k, f"Zorblax wrote.\n\n{'so it goes on ' * 20}\nanna@mail.example.org\nZorblax") for k in range(4)]
    rows += [(10, "Zorblax again"), *((100 + k, "so it goes on at noon wrote") for k in range(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(pii.find_personal_data(docs)).collect()}
    assert len(clean) == len(rows) and clean[0].count("[NAME]") == 2 and clean[10] == "Zorblax again"
    assert "Zorblax" not in clean[0] and clean[100] == rows[-1][1] and "[EMAIL]" in clean[0]


def test_removed_everywhere_and_all_holders_counted(spark):
    rows = [(k, f"Zorblax\n\n{'so on ' * 30}\nanna@mail.example.org") for k in range(60)] + [(99, "only Zorblax"), (98, "anna@mail.example.org")]
    docs = spark.createDataFrame(rows + [(1000 + k, "so on only") for k in range(3000)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(pii.find_personal_data(docs)).collect()}
    assert clean[99] == "only " and "Zorblax" not in clean[0] and clean[1000] == "so on only"
    texts = docs.selectExpr("doc_id as uid", "doc_id", "text")
    row = pii.disclosures(texts, pii._detected(texts), support=3, generalise=0.8).collect()[0]
    n, ne, nt = 3062, 61, 61
    assert abs(row.disclosure - log2(n * 60 / (ne * nt)) / log2(n / ne)) < 1e-9


def test_one_entity_in_a_third_of_all_documents(spark):
    """Each document meets the terms that it holds, not all those of its entity."""
    rows = [(k, f"ask bob{k // 3}x at boss@firm.example now" if k % 3 == 0 else f"ask bob{k // 3}x now or then") for k in range(1200)]
    rows += [(k, f"code word{k % 40}y of boss@firm.example") for k in range(1200, 1400)]
    out = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(any(s.kind == "email" for s in out[k]) for k in range(0, 1200, 3))
    told = {r[1][s.start : s.end] for r in rows for s in out[r[0]] or [] if s.kind not in pii.KINDS}
    assert told >= {f"word{k}y" for k in range(40)} and not any(t.startswith("bob") for t in told)
