"""Queries over stored forms: layers, metric series, archives, parsed documents, feedback lists, SQL functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import catalog
from quillgraph.functions.embedding import hash_embedding
from quillgraph.functions.store import folder
from quillgraph.operators import exchange
from quillgraph.plans.model import AS_OF, Model
from quillgraph.plans.registration import r6, registrar
from quillgraph.sources import documents as D

QUERIES, ORACLES, query = registrar()


@query("select layer, count(*) as n, round(sum(weight), 4) as weight from (select 'semantic' as layer, weight from semantic_edges union all select 'citation', weight from citation_edges union all select 'combined', weight::double from combined_edges) group by layer", "combined_edges")
def layer_views(m: Model) -> DataFrame:
    """GRF-09, GRF-19: every layer a view of one edge table; the combined layer is derived, not stored"""
    layer = lambda df, name: df.select(F.lit(name).alias("layer"), "src", "dst", "weight")
    edges = layer(m.semantic_edges, "semantic").unionByName(layer(m.citation_edges, "citation")).unionByName(layer(m.combined_edges, "combined"))
    return edges.groupBy("layer").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query(
    """daily as (select strftime(date_trunc('day', ts), '%Y-%m-%d') as timestamp_iso, count(*) filter (event_type = 'click' and value > 150) as c, sum(value) filter (event_type = 'view' and value > 150) as v from events group by 1)
    select timestamp_iso, c as total_events, round(coalesce(v, 0), 4) as view_value, v is null as value_missing from daily"""
)
def metric_series(m: Model) -> DataFrame:
    """SRC-22: a metric series with what is missing filled by kind"""
    is_ = lambda kind: (F.col("event_type") == kind) & (F.col("value") > 150)
    daily = m.table("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("timestamp_iso")).agg(F.sum(F.when(is_("click"), 1)).alias("c"), F.sum(F.when(is_("view"), F.col("value"))).alias("v"))
    return daily.select("timestamp_iso", F.coalesce("c", F.lit(0)).cast("long").alias("total_events"), F.round(F.coalesce("v", F.lit(0.0)), 4).alias("view_value"), F.col("v").isNull().alias("value_missing"))


@query("select paper_id, case when user_rating >= 7 then 'anchor' when user_rating <= 3 then 'avoid' else 'seen' end as list, round(weight, 6) as weight from candidates where user_rating is not null", "candidates")
def scout_feedback(m: Model) -> DataFrame:
    """ITR-15: what ratings of a scout's finds make of them"""
    kind = F.when(F.col("user_rating") >= 7, "anchor").when(F.col("user_rating") <= 3, "avoid").otherwise("seen")
    return m.candidates.where("user_rating is not null").select("paper_id", kind.alias("list"), r6("weight"))


@query("select doc_id, md5(trim(text)) as body, 'introduction' as kind, md5(trim(split_part(text, chr(10), 1))) as title, 'ref' || doc_id as cited from documents")
def parsed_documents(m: Model) -> DataFrame:
    """SRC-03, SRC-04, SRC-07, SRC-08: structured documents made from every text and parsed back"""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    number = F.col("doc_id").cast("string")
    xml = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>'), F.substring(esc(F.substring_index("text", "\n", 1)), 1, 100_000), F.lit("</title></titleStmt></fileDesc></teiHeader><text><body><div><head>1. Introduction</head><p>"), esc(F.col("text")),
        F.lit('<ref type="bibr" target="#b0"/></p></div></body><back><listBibl><biblStruct xml:id="b0"><title>ref'), number, F.lit("</title></biblStruct></listBibl></back></text></TEI>"),
    )
    parsed = D.tei(m.table("documents").select(number.alias("path"), xml.alias("xml")))
    md5 = lambda c: F.md5(F.encode(F.trim(c), "UTF-8"))
    whole = m.table("documents").select(number.alias("path"), "doc_id", F.substring_index("text", "\n", 1).alias("first"))
    joined = parsed.join(whole, "path")
    # A header title keeps 300 characters; longer first lines are compared by those.
    title = F.when(F.col("title") == F.substring(F.trim("first"), 1, 300), md5(F.col("first"))).otherwise(md5(F.col("title")))
    return joined.select("doc_id", md5(F.col("sections")[0]["text"]).alias("body"), F.col("sections")[0]["section_type"].alias("kind"), title.alias("title"), F.col("refs")[0]["title"].alias("cited"))


@query("select 'papers' as name, count(*) as n from papers union all select 'edges', count(*) from semantic_edges", "papers", "semantic_edges")
def archive_roundtrip(m: Model) -> DataFrame:
    """SNK-03, SRC-24: tables exported with a manifest, read back and checked"""
    path = f"{folder(m.spark)}/quillgraph/archive-{uuid.uuid4().hex}"
    papers = m.papers.select("paper_id", "title", "year", "doi", "user_rating")
    exchange.export_archive({"papers": papers, "edges": m.semantic_edges}, path)
    back = exchange.import_archive(m.spark, path, {"papers": "paper_id string, title string, year int, doi string, user_rating double", "edges": "src string, dst string, weight double"})
    return back["papers"].agg(F.count("*").alias("n")).select(F.lit("papers").alias("name"), "n").unionByName(back["edges"].agg(F.count("*").alias("n")).select(F.lit("edges").alias("name"), "n"))


@query("select p_brand, md5(substr(array_to_string((list(p_name order by p_partkey))[1:40], chr(10)), 1, 4000)) as digest from part group by p_brand")
def equation_texts(m: Model) -> DataFrame:
    """STR-T16: the first forty lines of each, joined and cut to what is embedded"""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda s: s["p_name"])
    text = F.substring(F.array_join(F.slice("lines", 1, 40), "\n"), 1, 4000)
    grouped = m.table("part").groupBy("p_brand").agg(listed.alias("lines")).select("p_brand", text.alias("text"))
    return grouped.where(F.size(hash_embedding(F.col("text"))) > 0).select("p_brand", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query(
    f"select paper_id, round(list_inner_product(embedding, context), 6) as likeness, round(case when rated_at <= 0 then 1.0 else greatest(0.25, pow(2.0, -({AS_OF} - rated_at) / 86400.0 / 90.0)) end, 6) as decay, case when user_rating is null then 'skipped' when user_rating >= 6 then 'included' else 'excluded' end as decision from candidates, context",
    "candidates", "context",
)
def sql_functions(m: Model) -> DataFrame:
    """UDF-05: the engine's functions called from SQL"""
    catalog.register(m.spark)
    return m.spark.sql(
        f"select paper_id, round(dot_product(embedding, context), 6) as likeness, round(rating_decay(rated_at, {AS_OF}d), 6) as decay, screening(user_rating) as decision from {{papers}} cross join {{context}}",
        papers=m.candidates, context=m.context,
    )
