import json

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import signals as S
from quillgraph.functions import text as T
from quillgraph.functions.vectors import mean_pool
from quillgraph.sources import documents, logs, works
from quillgraph.streaming import watches

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>On <hi>Drift</hi></title></titleStmt></fileDesc><profileDesc><abstract><p>We study drift.</p></abstract></profileDesc><idno type="DOI">10.1234/ABC.5</idno></teiHeader>
<text><body><div><head n="1">Introduction</head><p>As <ref type="bibr" target="#b0">Smith</ref> showed.</p><p>More.</p></div><div><head>3.2 Experimental Setup</head><p>Setup text.</p><formula>E = mc2</formula></div><div></div>
<figure><head>Curve</head><label>1</label><figDesc>A curve.</figDesc></figure><figure type="table"><head>Table 1</head><table><row><cell>a</cell><cell>b</cell></row><row><cell>1</cell><cell>2</cell></row></table></figure></body>
<back><div><listBibl><biblStruct xml:id="b0"><analytic><title type="main">A ﬁne model</title><author><persName><forename>Jo</forename><surname>Smith</surname></persName></author></analytic><monogr><imprint><date when="1987-02"/></imprint></monogr></biblStruct>
<biblStruct xml:id="b1"><analytic><title>Other 10.5555/xyz123</title></analytic></biblStruct></listBibl></div></back></text></TEI>"""


def test_tei_documents(spark):
    landed = spark.createDataFrame([("a.xml", TEI), ("bad.xml", "<TEI"), ("none.xml", None)], "path string, xml string")
    rows = documents.tei(landed).collect()
    assert [r.path for r in rows] == ["a.xml"]
    r = rows[0]
    assert (" ".join(r.title.split()), r.abstract, r.doi) == ("On Drift", "We study drift.", "10.1234/abc.5")
    assert [(s.heading, s.section_type, s.number) for s in r.sections] == [("Introduction", "introduction", "1"), ("3.2 Experimental Setup", "experiments", "3.2")]
    assert r.sections[0].text.endswith("\n\nMore.") and r.equations == ["E = mc2"]
    assert r.figures[0].label == "Figure 1: Curve" and r.tables[0].text == "a | b | 1 | 2" and len(r.tables[0].rows) == 2
    assert (r.refs[0].title, r.refs[0].year, r.refs[0].authors, r.refs[0].raw) == ("A fine model", "1987", ["Jo Smith"], "Jo Smith (1987). A fine model")
    assert [c.section_type for c in r.refs[0].contexts] == ["introduction"] and r.refs[1].doi == "10.5555/xyz123"
    assert documents.local_references(documents.tei(landed)).count() == 2


@pytest.mark.parametrize("heading,kind", [("IV. Results", "results"), ("Limitations", "limitations"), ("(a) Related Work", "related_work"), ("", "other"), ("Notes", "other")])
def test_section_kinds_agree(spark, heading, kind):
    assert documents.section_kind(heading) == kind
    assert spark.createDataFrame([(heading,)], "h string").select(T.section_type(F.col("h"))).first()[0] == kind


def test_openalex_pages(spark):
    item = {"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1/X", "display_name": " A title ", "publication_year": 2020, "cited_by_count": 7, "abstract_inverted_index": {"b": [1], "a": [0, 2]},
            "authorships": [{"author": {"display_name": "Ann Lee"}}], "primary_location": {"source": {"display_name": "J", "type": "journal"}}}
    rows = works.openalex(spark.createDataFrame([(json.dumps(item),), (json.dumps({"display_name": ""}),)], "json string")).collect()
    assert len(rows) == 1 and (rows[0].title, rows[0].abstract, rows[0].doi, rows[0].is_peer_reviewed, rows[0].cited_by_count) == ("A title", "a b a", "10.1/x", True, 7)
    assert rows[0].paper_id.startswith("doi_") and rows[0].authors == ["Ann Lee"]


def test_crossref_pages(spark):
    good = {"DOI": "10.1/AB", "title": ["T"], "abstract": "<jats:p>An  abstract</jats:p>", "author": [{"given": "A", "family": "B"}, {"family": "C"}], "published-print": {"date-parts": [[2019, 1]]}, "container-title": ["Venue"], "type": "journal-article"}
    noise = [good | {"DOI": "10.5860/choice.1"}, good | {"type": "report"}, good | {"container-title": ["The Library Journal"]}, good | {"title": [""]}]
    rows = works.crossref(spark.createDataFrame([(json.dumps(x),) for x in [good, *noise]], "json string")).collect()
    assert [(r.doi, r.abstract, r.authors, r.year, r.url, r.is_peer_reviewed) for r in rows] == [("10.1/ab", "An abstract", ["A B", "C"], 2019, "https://doi.org/10.1/ab", True)]


def test_other_sources(spark):
    item = {"paperId": "s9", "title": "S", "externalIds": {"ArXiv": "2101.1"}, "authors": [{"name": "X"}], "year": 2021}
    row = works.semantic_scholar(spark.createDataFrame([(json.dumps(item),)], "json string")).first()
    assert (row.paper_id, row.is_peer_reviewed, row.url) == ("s2_s9", False, "https://arxiv.org/abs/2101.1")
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2101.00001v2</id><title>Q</title><summary>S</summary><published>2021-01-02T00:00:00Z</published><author><name>N</name></author></entry></feed>'
    row = works.arxiv(spark.createDataFrame([(feed,), ("<broken",)], "xml string")).first()
    assert (row.arxiv_id, row.year, row.paper_id, row.venue) == ("2101.00001", 2021, "arxiv_2101.00001", "arXiv")


def test_fetch_waits_and_gives_up():
    waits = []
    answers = iter([(503, "", {}), (429, "", {"Retry-After": "7"}), (200, "body", {})])
    assert works.fetch(lambda: next(answers), sleep=waits.append) == "body" and waits == [1.0, 7.0]
    assert works.fetch(lambda: (404, "", {}), sleep=waits.append) is None
    assert works.fetch(lambda: (500, "", {}), tries=2, sleep=waits.append) is None


def test_logs(spark, tmp_path):
    path = tmp_path / "audit.jsonl"
    path.write_text('{"ts": 2.0, "event": "screen", "paper_id": "a"}\n\nnot json\n{"ts": 1.0, "event": "search", "n_results": 5, "sources": {"x": 3}}\n')
    rows = logs.read_events(spark, f"file://{path}").collect()
    assert [r.event for r in rows] == ["search", "screen"] and rows[0].sources == {"x": 3}
    logs.log_event(spark, f"file://{tmp_path}/log", 3.0, "fulltext", paper_id="z")
    assert logs.read_events(spark, f"file://{tmp_path}/log", "fulltext").first().paper_id == "z"
    metrics = tmp_path / "metrics.jsonl"
    metrics.write_text('{"timestamp_iso": "2024-01-02", "total_papers": 3}\n{"timestamp_iso": "2024-01-01", "density": 0.5}\n')
    rows = logs.read_metrics(spark, f"file://{metrics}", "timestamp_iso string, total_papers long, density double").collect()
    assert [r.total_papers for r in rows] == [0, 3] and rows[1].density != rows[1].density
    assert logs.read_metrics(spark, f"file://{metrics}", "timestamp_iso string, total_papers long", last=1).first().total_papers == 3


def test_notes(spark, tmp_path):
    (tmp_path / "a.md").write_text("# My essay\n\nText.\n\n## Methods\n\nHow.\n\nResults\n-------\n\nWhat.\n")
    (tmp_path / "b.txt").write_text("plain")
    notes = documents.notes(spark, f"file://{tmp_path}")
    assert sorted(r.title for r in notes.collect()) == ["My essay", "b"]
    sections = {(r.path.rsplit("/", 1)[1], r.section_type): r.text for r in documents.markdown_sections(notes).collect()}
    assert sections["a.md", "methods"] == "How." and sections["a.md", "results"] == "What." and sections["b.txt", "other"] == "plain"


def test_streams_take_up_where_they_ended(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    schema = "user string, ts long, v string"
    spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], schema).write.mode("append").parquet(folder)
    state = watches.State(spark, "t", spark.createDataFrame([], schema))
    seen = []

    def batch(df, number):
        seen.append(sorted(r.v for r in df.collect()))

    spot = f"file://{tmp_path}/spot"
    watches.run_now(watches.files(spark, folder, schema), batch, spot)
    spark.createDataFrame([("a", 3, "z"), ("b", 2, "w")], schema).write.mode("append").parquet(folder)
    watches.run_now(watches.files(spark, folder, schema), batch, spot)
    assert seen == [["x", "y"], ["w", "z"]]
    latest = watches.latest_by(watches.files(spark, folder, schema), "user", ["ts"], state)
    assert {r.user: r.v for r in latest.collect()} == {"a": "z", "b": "y"}


def test_state_goes_on_in_its_folder(spark, tmp_path):
    folder, base, schema = f"file://{tmp_path}/in", f"file://{tmp_path}/state", "user string, ts long, v string"
    spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], schema).write.parquet(folder)
    opened = lambda: watches.State(spark, "t", spark.createDataFrame([], schema), base)
    assert opened().read().count() == 0
    watches.latest_by(watches.files(spark, folder, schema), "user", ["ts"], opened())
    spark.createDataFrame([("a", 3, "z"), ("b", 2, "w")], schema).write.mode("append").parquet(folder)
    again = watches.latest_by(watches.files(spark, folder, schema), "user", ["ts"], opened())
    assert {r.user: r.v for r in again.collect()} == {r.user: r.v for r in opened().read().collect()} == {"a": "z", "b": "y"}


def test_a_batch_that_runs_again_gives_the_same_state(spark, tmp_path):
    state = watches.State(spark, "t", spark.createDataFrame([], "n long"), f"file://{tmp_path}/state")
    add = lambda number: state.replace(state.read(number).unionByName(spark.range(number, number + 1).toDF("n")), number)
    for number in (0, 1, 1, 2, 2, 3):
        add(number)
    assert sorted(r.n for r in state.read().collect()) == [0, 1, 2, 3]
    assert sorted({n for n, _ in state._versions()}) == [2, 3]


def one(spark, expression, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expression).first()[0]


def test_signals_by_hand(spark):
    day = 86400.0
    assert one(spark, S.temporal_decay(F.col("r"), 1000 * day), r=910 * day) == pytest.approx(0.5)
    assert one(spark, S.temporal_decay(F.col("r"), 1000 * day), r=640 * day) == 0.25 and one(spark, S.temporal_decay(F.col("r"), 1000 * day), r=0.0) == 1.0
    assert one(spark, S.reciprocal_rank_fusion(F.array(F.lit(0), F.lit(1)))) == pytest.approx((1 / 61 + 1 / 62) / (4 / 61))
    assert one(spark, S.impact(F.lit(100), F.lit(2014), 2024)) == pytest.approx(0.6098682) and one(spark, S.impact(F.lit(None).cast("int"), F.lit(2014), 2024)) is None
    assert one(spark, S.fused_score(F.array(F.lit(0.8), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(2.0)))) == pytest.approx(0.8)
    assert [one(spark, S.edge_confidence(F.lit(a), F.lit(a), F.lit(0.5))) for a in (1, 2, 3)] == [0.5, 0.65, 0.75]
    assert [one(spark, S.coerced_year(F.lit(y))) for y in ("2018-05", "n.d.", "0999", " 2101")] == [2018, None, None, None]


def test_texts_by_hand(spark):
    assert one(spark, T.clean(F.lit("ﬁne  – text\té"))) == "fine - text"
    assert one(spark, T.doi(F.lit("see https://doi.org/10.1234/abc.5678)."))) == "10.1234/abc.5678" and one(spark, T.doi(F.lit("10.1234/a"))) == ""
    assert one(spark, T.without_equations(F.lit("words of text\nx=1+2\n\n++ == --\nab"))) == "words of text\n"
    assert one(spark, T.keyword_score("the drift diffusion", F.lit("Drift diffusion"), F.lit(""))) == 1.0
    assert one(spark, T.citation_intent(F.lit("This confirms and supports it.")))["intent"] == "supports"
    assert one(spark, T.without_noise(F.lit("Available online at www.x.org Real title © 2019 Foo."))) == "Real title"
    assert one(spark, T.title_mention(F.lit("We extend Diffusion decisions further here."), F.lit("Diffusion decisions"))).startswith("We extend")
    assert len(one(spark, T.chunks(F.lit(" ".join(["word"] * 1000))))) == 4


def test_pooling(spark):
    df = spark.createDataFrame([([1.0, 0.0], 3.0), ([0.0, 1.0], 1.0), (None, 9.0)], "v array<double>, w double")
    assert mean_pool(df, "v", "w").first().pooled == pytest.approx([3 / 10**0.5, 1 / 10**0.5])
