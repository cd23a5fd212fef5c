from sparkvigil.llm import pii


def test_copies_hide_no_term(spark):
    texts = ["Zaphodia writes zb@heart.example today", "again Zaphodia wrote zb@heart.example here"]
    texts += [f"filler{i} words of other people" for i in range(60)]
    once = [(i, t) for i, t in enumerate(texts)]
    copied = once + [(100 + 10 * k + i, t) for k in range(2) for i, t in once[:2]]
    terms = [{r.term: round(r.bits, 9) for r in pii.disclosing_terms(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} for rows in (once, copied)]
    assert "zaphodia" in terms[0] and terms[0] == terms[1]
