from docketry import fixed_values as fixed
from docketry.functions import cards as C
from docketry.functions.glossary import detect_terms, glossary
from docketry.operators import joins


def test_detect_terms(one):
    texts = ["He had just cause.", "Misconduct ahead of JUST CAUSE, misconduct again", "none", "",
             "unjust causes", "a de novo hearing on the balance of probabilities"]
    assert one(detect_terms, texts) == [
        ["just cause"], ["misconduct", "just cause"], [], [], [],
        ["de novo hearing", "balance of probabilities"]]


def test_document_terms_and_frequency(spark):
    df = spark.createDataFrame(
        [("a", "misconduct, then just cause"), ("b", "Just cause"), ("c", "x")],
        "url string, text string")
    rows = joins.document_terms(df).orderBy("url", "ord").collect()
    assert [(r["url"], r["ord"], r["term"]) for r in rows] == [
        ("a", 0, "misconduct"), ("a", 1, "just cause"), ("b", 0, "just cause")]
    assert all(r["definition"] and r["context"] for r in rows)
    assert {tuple(r) for r in joins.term_frequency(df).collect()} == {
        ("misconduct", 1), ("just cause", 2)}


def test_get_entry_in_any_case(spark):
    assert glossary(spark).count() == len(fixed.GLOSSARY) == 12
    asked = spark.createDataFrame([("JUST Cause",), ("misconduct",), ("absent",)], "term string")
    assert {r["entry"] for r in joins.get_entry(asked).collect()} == {"just cause", "misconduct"}


def test_sanitize_card(one):
    cards = ["<think>a\nb</think>**Issue:** x", "Sure!\n**Key Facts:** y **Outcome:** z ",
             " no head ", "<THINK>q</Think> plain", "**Outcome:** a **Issue:** b"]
    assert one(C.sanitize_card, cards) == [
        "**Issue:** x", "**Key Facts:** y **Outcome:** z", "no head", "plain",
        "**Outcome:** a **Issue:** b"]


def test_card_sections(one):
    (row,) = one(C.card_sections, ["**Issue:** i\n**Key Facts:**\nf\n**Outcome:** o"])
    assert row.asDict() == {"issue": "i", "key_facts": "f", "test_applied": "", "outcome": "o"}


def test_claim_sources(spark):
    card = ("**Issue:**\n- Was it late?\n  [Source: para 1-2 | explicit]\n"
            "**Key Facts:**\n- He was ill.\n  [Source: para 3 |inferred ]\n"
            "- Two lines\n  of claim.\n  [Source: general context | inferred]\n"
            "**Outcome:**\nNo source here.")
    df = spark.createDataFrame([("u", card)], "url string, card string")
    rows = C.claim_sources(df).collect()
    assert sorted(tuple(r) for r in rows) == [
        ("u", "Issue", 0, "Was it late?", "para 1-2", "explicit"),
        ("u", "Key Facts", 0, "He was ill.", "para 3", "inferred"),
        ("u", "Key Facts", 1, "Two lines\n  of claim.", "general context", "inferred")]


def test_two_marks_on_a_line_stay_apart(spark):
    card = "**Issue:** - a [Source: p1 | inferred] - b [Source: p2 | explicit]"
    df = spark.createDataFrame([("u", card)], "url string, card string")
    assert [(r["source_ref"], r["confidence"]) for r in C.claim_sources(df).collect()] == [
        ("p1", "inferred"), ("p2", "explicit")]
