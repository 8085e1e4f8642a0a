"""Words beside an entity that occurs once, at the production parameters."""

from plumbline.llm import pii_disclosure


def test_an_entity_seen_once_is_judged(spark):
    once = "common words here zanzibar boss@corp.com wrote common letters"
    rows = [(0, once)] + [(10 + i, "common words here and common letters wrote") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii_disclosure.find_pii(docs).collect()}
    at = once.index("zanzibar")
    assert [s for s in got[0].split(",") if s.startswith("term")] == [f"term:{at}:{at + 8}"] and got[10] == ""
    text = {r["doc_id"]: r["text"] for r in pii_disclosure.redact(docs).collect()}
    assert text[0] == "common words here <TERM> <EMAIL> wrote common letters" and text[10] == rows[1][1]
