"""Text functions against plain computations in Python."""

import re

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T


def values(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column.alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


def test_noise_stops_at_prose(spark):
    texts = ["Neuroscience 1974 we show that cells fire. Then", "Journal of Cell Biology, 2001; (3) Axons grow", "See https://x.org/a and VOLUME of data", None]
    assert values(spark, T.without_noise(F.col("t")), texts) == ["we show that cells fire. Then", "Axons grow", "See and of data", None]


def test_sentences_and_the_relevant_one(spark):
    texts = ["One here. Two drift there!  Three?\nFour", "", "no stop", None, "A drift model. A drift model of things."]
    plain = [None if t is None else [s for s in re.split(r"(?<=[.!?])\s+", t) if s] for t in texts]
    assert values(spark, T.sentences(F.col("t")), texts) == plain
    assert values(spark, T.relevant_sentence(F.col("t"), ["drift", "model"]), texts) == ["Two drift there!", None, None, None, "A drift model."]


@pytest.mark.parametrize("end", ["\nKeywords: a", "\n 1. First", "\nIntroduction here"])
def test_abstract_between_its_word_and_the_next_section(spark, end):
    assert values(spark, T.abstract_of(F.col("t")), ["Title\nABSTRACT: What we\nfound." + end + "\nmore", "no mark " * 100]) == ["What we found.", ("no mark " * 100).strip()[:500]]


def test_readable_sentences(spark):
    texts = ["We show that drift models explain the data.", "Too short to be so.", "See www.x.org/homepage for the full list of papers.", "The departmentofpsychology has a study of memory here.",
             "12 34 56 78 90 12 34 56 we see 77 88", "Memory,attention and recall are studied in this work.", "", None]
    assert values(spark, T.readable(F.col("t")), texts) == [True, False, False, False, False, False, False, False]


def test_headers_and_query_variants(spark):
    titles = ["Psychological Review 1974, Vol. 81", "Cognition91(2019) 1437", "July 20, 2011 31(29)", "0270-6474/82", " ", "How memory drifts over time", "Paid $02.00"]
    assert values(spark, T.is_header(F.col("t")), titles) == [True, True, True, True, True, False, True]
    prose = "We show that memory drifts over time in all of our subjects. " + "It does so in every task. " * 12
    got = values(spark, T.query_variants(F.lit("How memory drifts over time"), F.col("t")), [prose, "short", None])
    assert got[0] == [prose.strip()[:250], prose[80:380].strip()[:250], prose[120:420].strip()[:250], "How memory drifts over time"]
    assert got[1] == got[2] == ["How memory drifts over time"]
    garbled = values(spark, T.query_variants(F.lit("Psychological Review 1974, a"), F.col("t")), [prose[:90]])[0]
    assert garbled == [prose[:90].strip(), "Psychological Review 1974, a"]
    assert values(spark, T.recovered_title(F.col("t")), [prose, "short"]) == ["We show that memory drifts over time in all of our subjects", ""]


def test_display_claims_and_findings(spark):
    page = "Cognition 91(2019)1437-1460 Contents lists available at ScienceDirect. We show that rates of change grow with size of groups. Other lines tell little of note here. Our results suggest a link between the two rates."
    rows = [(page, "A title"), ("", "The Journal of Odd Things Rates of Change in Groups Department of X"), ("", "short"), (None, None), ("One sentence of several plain words at Princeton. Second one from the University of Here.", "The Rates of Change")]
    df = spark.createDataFrame(rows, "page string, title string").withColumn("s", T.prose(F.col("page")))
    got = df.select(T.displayed(F.col("page")), T.main_claim(F.col("s"), F.col("title")), T.key_finding(F.col("s"), F.col("title"))).collect()
    assert got[0][0].startswith("We show that rates") and "ScienceDirect" not in got[0][0]
    assert got[0][1:] == ("rates of change grow with size of groups...", "a link between the two rates...")
    assert got[1][1:] == ("change in groups", "change in groups")
    assert got[2][1:] == got[3][1:] == (T.NO_CLAIM, T.NO_FINDING)
    assert got[4][1:] == ("rates of change", "rates of change")
