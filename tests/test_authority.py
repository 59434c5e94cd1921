import math

import pytest
from pyspark.sql import functions as F

from docketry.functions import authority as A

YEAR = 2026


def test_parse_year(one):
    dates = ["2021-03-15", "2019", "decided in March 2018, filed 2017", "", None, "no year",
             "12021-3", "case 1850", "1999-2001"]
    assert one(A.parse_year, dates) == [2021, 2019, 2018, None, None, None, None, None, 1999]


def test_parse_year_of_a_date_column(spark):
    df = spark.sql("select date'2020-05-01' as d, timestamp'2011-01-01 10:00:00' as t")
    row = df.select(A.parse_year(F.col("d")), A.parse_year(F.col("t"))).first()
    assert tuple(row) == (2020, 2011)


def test_recency_factor_halves_every_seven_years(one):
    values = one(lambda d: A.recency_factor(d, YEAR), ["2026", "2019", "2012", "2030", None, "x"])
    assert values == pytest.approx([1.0, 0.5, 0.25, 1.0, 0.5, 0.5])


def test_recency_factor_defaults_to_the_current_year(one, spark):
    year = spark.sql("select year(current_date())").first()[0]
    assert one(A.recency_factor, [str(year - 7)]) == pytest.approx([0.5])


def test_recency_label(one):
    dates = ["2024", "2021", "2020", "2014", "2013", "2040", None, "soon"]
    assert one(lambda d: A.recency_label(d, YEAR), dates) == [
        "Recent", "Recent", "Older", "Older", "Historical", "Recent", "Unknown", "Unknown"]


def test_relevance_label(one):
    scores = [0.75, 0.65, 0.6499, 0.35, 0.3499, 0.0]
    assert one(A.relevance_label, scores, "double") == [
        "High", "High", "Medium", "Medium", "Low", "Low"]


@pytest.mark.parametrize("date,score,risk", [
    ("2025", 0.8, "Low"), ("2018", 0.7, "Medium"), ("2024", 0.5, "Medium"),
    ("2011", 0.8, "Verify"), ("2025", 0.2, "Verify"), (None, 0.9, "Verify"),
    ("2014", 0.9, "Medium"), ("2013", 0.9, "Verify")])
def test_authority_risk(one, date, score, risk):
    assert one(lambda d: A.authority_risk(d, F.lit(score), YEAR), [date]) == [risk]


def test_grounding_factor(one):
    texts = [
        "", None, "nothing of note", "The ANALYSIS follows.", "paralysis", "section 4 " * 3,
        "section 4 " * 40, "I find, therefore. The evidence fits the test.",
        "I find that. Therefore the evidence. I am not satisfied. The criteria. I conclude.",
        "Analysis: section 1 " + "s. 2 the Act minister " * 30
        + "I find therefore the evidence. I am satisfied. The law. I am persuaded."]
    assert one(A.grounding_factor, texts) == pytest.approx(
        [0.75, 0.75, 0.75, 0.80, 0.75, 0.78, 0.85, 0.83, 0.85, 1.0])


def test_citations_match_whole_words_only(one):
    texts = ["the Regulation and the regulations", "s.42 and s. 7 and S.\n9", "this section 12a",
             "Tribunal, MINISTER; employment insurance act; Canada Pension Plan", None]
    assert one(A.citation_count, texts) == [1, 3, 0, 4, 0]


def test_reasoning_hits_count_kinds_not_occurrences(one):
    texts = ["I find I find I find", "the law, the test", "unsatisfied; wherefore",
             "I am satisfied. I am persuaded."]
    assert one(A.reasoning_hits, texts) == [1, 1, 0, 2]


def test_outcome(one):
    texts = [
        "The appeal is allowed.", "THE APPEAL IS DISMISSED", "no result", "", None,
        "The appeal is allowed. The cross-appeal is dismissed.", "Appeal dismissed",
        "x" * 790 + " appeal is allowed", "x" * 700 + " appeal is allowed in part"]
    assert one(A.outcome, texts) == [
        "Allowed", "Dismissed", "Unknown", "Unknown", "Unknown", "Unknown", "Unknown",
        "Unknown", "Allowed"]


def test_with_authority(spark):
    df = spark.createDataFrame(
        [(0.8, "2019-01-01", "The appeal is allowed. Analysis."), (0.9, None, None)],
        "score double, date string, text string")
    first, second = A.with_authority(df, "score", "date", as_of_year=YEAR).collect()
    assert first["authority_score"] == pytest.approx(0.8 * 0.5 * 0.8)
    assert (first["relevance_label"], first["recency_label"], first["authority_risk"],
            first["outcome"]) == ("High", "Older", "Medium", "Allowed")
    assert second["authority_score"] == pytest.approx(0.9 * 0.5 * 0.75)
    assert second["recency_factor"] == 0.5 and second["authority_risk"] == "Verify"


def test_authority_never_exceeds_relevance(spark):
    df = spark.range(200).select(
        (F.col("id") / 200).alias("score"), (F.lit(1990) + F.col("id") % 40).cast("string")
        .alias("date"), F.expr("repeat('section 3 therefore ', id % 20)").alias("text"))
    out = A.with_authority(df, "score", "date", as_of_year=YEAR)
    assert out.filter("authority_score > score or authority_score < 0").count() == 0
    assert math.isclose(out.agg(F.max("grounding_factor")).first()[0], 0.87)
