"""Queries behind reports: audit counts, themes, review exports, ranking quality, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import signals as S
from quillgraph.functions import text as T
from quillgraph.functions.vectors import dot
from quillgraph.operators import quality as Y
from quillgraph.plans.model import CTES, Model
from quillgraph.plans.registration import r6, registrar

QUERIES, ORACLES, query = registrar()

CTES["audit"] = (
    """audit as (select event_id, ts, user_id, value, case event_type when 'click' then 'search' when 'view' then 'screen' when 'purchase' then 'fulltext' when 'signup' then 'snowball' else 'watch_check' end as event,
      cast(substr(props, 7, length(props) - 7) as bigint) as n from events)""",
    (),
)
CTES["review"] = ("review as (select * from papers where kind = 'paper' and (user_rating >= 6 or user_rating is null))", ("papers",))
CTES["quality"] = (
    """rated as (select paper_id, user_rating, embedding from corpus where user_rating is not null),
likes as (select i, sum(x) as x, count(*) as n from (select unnest(embedding) as x, generate_subscripts(embedding, 1) as i from rated where user_rating >= 7) group by i),
left_out as (select r.paper_id, i, l.x - case when r.user_rating >= 7 then r.e else 0 end as x, r.e, r.user_rating from (select paper_id, user_rating, unnest(embedding) as e, generate_subscripts(embedding, 1) as i from rated) r join likes l using (i)),
quality as (select paper_id, any_value(user_rating) as rating, greatest(0, least(1, (sum(x * e) / sqrt(sum(x * x)) + 1) / 2)) as score from left_out group by paper_id)""",
    ("corpus",),
)


def audit(m: Model) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "search").when(F.col("event_type") == "view", "screen").when(F.col("event_type") == "purchase", "fulltext").when(F.col("event_type") == "signup", "snowball").otherwise("watch_check")
    return m.table("events").select("event_id", "ts", "user_id", "value", kind.alias("event"), F.get_json_object("props", "$.k").cast("long").alias("n"))


def review(m: Model) -> DataFrame:
    return m.papers.where("kind = 'paper' and (user_rating >= 6 or user_rating is null)")


@query(
    """latest as (select user_id, decision from (select user_id, case when value >= 6 then 'included' else 'excluded' end as decision, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from audit where event = 'screen') where rn = 1)
    select count(*) filter (event = 'search') as n_searches, cast(sum(n) filter (event = 'search') as bigint) as identified_search, cast(sum(n) filter (event = 'snowball') as bigint) as identified_snowball, cast(sum(n) filter (event = 'watch_check') as bigint) as identified_watch,
      count(distinct user_id) filter (event = 'fulltext') as fulltext_retrieved, (select count(*) from latest) as screened, (select count(*) from latest where decision = 'included') as included, (select count(*) from latest where decision = 'excluded') as excluded from audit""",
    "audit",
)
def prisma_counts(m: Model) -> DataFrame:
    """AGG-05, STR-05"""
    return Y.prisma(audit(m))


@query("select event, strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as n, round(sum(value), 4) as total from audit group by all", "audit")
def audit_by_day(m: Model) -> DataFrame:
    """SRC-21, STR-07: tumbling days over the event log"""
    return audit(m).groupBy("event", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    """edges as (select confidence, ts from (select value / (select max(value) from events) as confidence, ts from events)),
    daily as (select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, round(avg(confidence), 6) as mean, round(avg(case when confidence < 0.05 then 1.0 else 0.0 end), 6) as low from edges group by 1),
    drift as (select day, mean, low, mean - avg(mean) over (order by day rows between 8 preceding and 1 preceding) as drift from daily)
    select day, mean, low, round(drift, 6) as drift, case when (case when low > 0.35 then 1 else 0 end) + (case when drift < -0.02 then 1 else 0 end) >= 2 then 'risk' when (case when low > 0.35 then 1 else 0 end) + (case when drift < -0.02 then 1 else 0 end) = 1 then 'watch' else 'good' end as health from drift"""
)
def reliability_history(m: Model) -> DataFrame:
    """AGG-07, WIN-21: drift of the mean against the last eight snapshots, and the health it implies"""
    events = m.table("events")
    top = events.agg(F.max("value").alias("top"))
    scaled = events.crossJoin(F.broadcast(top)).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("value") / F.col("top")).alias("c"))
    daily = scaled.groupBy("day").agg(F.round(F.avg("c"), 6).alias("mean"), F.round(F.avg((F.col("c") < 0.05).cast("double")), 6).alias("low"))
    return Y.health(daily, "day", low_limit=0.35, drop_limit=-0.02).select("day", "mean", "low", r6("drift"), "health")


@query(
    """select (select count(*) from papers) as total_papers, (select count(*) from papers where source = 'seed') as seed_papers, (select count(*) from papers where user_rating is not null) as rated_papers, (select count(*) from clusters where level = 1) as niche_clusters,
      (select count(*) from clusters where level = 2) as area_clusters, (select count(distinct paper_id) from refs) as citations_loaded, (select count(*) from source_counts where n_sources >= 2) as multi_source_refs, (select count(*) from papers where is_peer_reviewed) as peer_reviewed, (select count(*) from papers where not is_peer_reviewed) as preprints,
      (select count(*) from semantic_edges) as semantic_edges, (select count(*) from citation_edges) as citation_edges""",
    "papers", "clusters", "source_counts", "semantic_edges", "citation_edges",
)
def graph_stats(m: Model) -> DataFrame:
    """AGG-08"""
    p = m.papers.agg(
        F.count("*").alias("total_papers"), F.count_if(F.col("source") == "seed").alias("seed_papers"), F.count("user_rating").alias("rated_papers"), F.count_if(F.col("is_peer_reviewed")).alias("peer_reviewed"), F.count_if(~F.col("is_peer_reviewed")).alias("preprints")
    )
    c = m.clusters.agg(F.count_if(F.col("level") == 1).alias("niche_clusters"), F.count_if(F.col("level") == 2).alias("area_clusters"))
    r = m.refs.groupBy("paper_id").agg(F.count_distinct("source").alias("k")).agg(F.count("*").alias("citations_loaded"), F.count_if(F.col("k") >= 2).alias("multi_source_refs"))
    e = m.semantic_edges.agg(F.count("*").alias("semantic_edges")).crossJoin(m.citation_edges.agg(F.count("*").alias("citation_edges")))
    return p.crossJoin(c).crossJoin(r).crossJoin(e)


@query(
    """pairs as (select avg(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0.0 end) as auc from quality a, quality b where a.rating >= 7 and b.rating <= 3),
    k as (select greatest(1, least(10, count(*) filter (rating >= 7))) as k from quality),
    ranked as (select *, row_number() over (order by score desc, paper_id) as rn, row_number() over (order by rating desc, paper_id desc) as best from quality)
    select count(*) as rated, count(*) filter (rating >= 7) as positives, count(*) filter (rating <= 3) as negatives, round((select auc from pairs) + 1e-9, 4)::double as auc,
      round(sum(case when rn <= k and rating >= 7 then 1.0 else 0 end) / any_value(k) + 1e-9, 4)::double as precision_at_k, round(sum(case when rn <= k then rating / log2(rn + 1) else 0 end) / sum(case when best <= k then rating / log2(best + 1) else 0 end) + 1e-9, 4) as ndcg_at_k, round(corr(score, rating) + 1e-9, 4) as rating_corr from ranked, k""",
    "quality",
)
def ranking_quality(m: Model) -> DataFrame:
    """AGG-09, AGG-10, AGG-11, AGG-12: leave-one-out preference alignment"""
    return Y.alignment(Y.leave_one_out(m.corpus.where("user_rating is not null").select("paper_id", F.col("user_rating").alias("rating"), "embedding")))


@query(
    """select coalesce(niche, 'unclustered') as theme, count(*) as n, count(user_rating) as n_rated, min(year) as first_year, max(year) as last_year, count(*) >= 3 and count(user_rating) < greatest(2, count(*) // 3) as gap from review group by all""", "review"
)
def review_themes(m: Model) -> DataFrame:
    """AGG-16, AGG-17"""
    g = review(m).groupBy(F.coalesce("niche", F.lit("unclustered")).alias("theme"))
    n, rated = F.count("*"), F.count("user_rating")
    return g.agg(n.alias("n"), rated.alias("n_rated"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), ((n >= 3) & (rated < F.greatest(F.lit(2), F.floor(n / 3)))).alias("gap"))


@query(
    """sums as (select least(a.niche, b.niche) as a, greatest(a.niche, b.niche) as b, sum(e.weight) as w from semantic_edges e join corpus a on a.paper_id = e.src join corpus b on b.paper_id = e.dst where a.niche <> b.niche group by all)
    select a, b, round(w / (select max(w) from sums) + 1e-9, 3) as w from sums where w / (select max(w) from sums) >= 0.05 qualify row_number() over (order by w desc, a, b) <= 80""",
    "semantic_edges", "corpus",
)
def theme_coupling(m: Model) -> DataFrame:
    """AGG-17: the strongest links between themes"""
    niche = m.corpus.select("paper_id", "niche")
    e = m.semantic_edges.join(niche.select(F.col("paper_id").alias("src"), F.col("niche").alias("x")), "src").join(niche.select(F.col("paper_id").alias("dst"), F.col("niche").alias("y")), "dst").where("x <> y")
    sums = e.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("weight").alias("s"))
    share = F.col("s") / F.col("top")
    return sums.crossJoin(F.broadcast(sums.agg(F.max("s").alias("top")))).where(share >= 0.05).orderBy(F.desc("s"), "a", "b").limit(80).select("a", "b", F.round(share + 1e-9, 3).alias("w"))


@query("select theme, word, n from (select niche as theme, word, n, row_number() over (partition by niche order by n desc, word) as rn from (select niche, word, count(*) as n from (select niche, unnest(regexp_extract_all(lower(title), '[a-z]{4,}')) as word from review) where word not in ('from', 'with', 'into') group by all)) where rn <= 4", "review")
def theme_words(m: Model) -> DataFrame:
    """AGG-16: the four most frequent title words name a theme"""
    words = review(m).select(F.col("niche").alias("theme"), F.explode(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word")).where(~F.col("word").isin(*T.KEY_STOP_WORDS))
    counts = words.groupBy("theme", "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy("theme").orderBy(F.desc("n"), "word")
    return counts.withColumn("rn", F.row_number().over(w)).where("rn <= 4").drop("rn")


_KEY = """case when coalesce(lower(regexp_replace(list_last(string_split(authors[1], ' ')), '[^A-Za-z]', '', 'g')), '') = '' then 'anon' else lower(regexp_replace(list_last(string_split(authors[1], ' ')), '[^A-Za-z]', '', 'g')) end || coalesce(cast(year as varchar), 'nd') ||
  coalesce(list_filter(regexp_extract_all(lower(title), '[a-z]+'), lambda w: not list_contains(['a','an','the','of','in','on','and','or','for','to','with','from','into','via','by'], w))[1], '')"""
CTES["keys"] = (
    f"""keys as (select paper_id, base || case when rn = 1 then '' when rn <= 26 then chr(cast(96 + rn as integer)) else '-' || rn end as cite_key from (select paper_id, base, row_number() over (partition by base order by coalesce(year, 0), title, paper_id) as rn from (select *, {_KEY} as base from review)))""",
    ("review",),
)


def keys(m: Model) -> DataFrame:
    w = Window.partitionBy("base").orderBy(F.coalesce("year", F.lit(0)), "title", "paper_id")
    suffix = F.when(F.col("rn") == 1, "").when(F.col("rn") <= 26, F.char((F.col("rn") + 96).cast("long"))).otherwise(F.concat(F.lit("-"), F.col("rn").cast("string")))
    based = review(m).withColumn("base", T.citation_key(F.col("authors"), F.col("year"), F.col("title"))).withColumn("rn", F.row_number().over(w))
    return based.select("paper_id", F.concat("base", suffix).alias("cite_key"))


@query("select * from keys", "keys")
def citation_keys(m: Model) -> DataFrame:
    """WIN-11"""
    return keys(m)


@query("select paper_id, row_number() over (order by coalesce(year, 0), title, paper_id) as position from review", "review")
def review_order(m: Model) -> DataFrame:
    """WIN-10"""
    from quillgraph.operators.ranking import numbered

    return numbered(review(m), [F.coalesce("year", F.lit(0)), F.col("title"), F.col("paper_id")]).select("paper_id", "position")


_TYPE = "case when venue = '' then 'misc' when lower(venue) like '%proceedings%' or lower(venue) like '%conference%' or lower(venue) like '%workshop%' or lower(venue) like '%symposium%' then 'inproceedings' else 'article' end"
_ESC = "trim(replace(replace(replace(replace(replace({}, '\\', ''), '{{', '('), '}}', ')'), '&', '\\&'), '%', '\\%'))"


@query(
    f"""select paper_id, '@' || {_TYPE} || '{{' || cite_key || ',' || chr(10) || concat_ws(',' || chr(10), '  title      = {{' || {_ESC.format('title')} || '}}', case when len(authors) > 0 then '  author     = {{' || {_ESC.format("array_to_string(authors, ' and ')")} || '}}' end, case when year is not null then '  year       = {{' || year || '}}' end,
      case when venue <> '' then case when {_TYPE} = 'inproceedings' then '  booktitle  = {{' else '  journal    = {{' end || {_ESC.format('venue')} || '}}' end, case when doi <> '' then '  doi        = {{' || doi || '}}' end) || chr(10) || '}}' as entry from review join keys using (paper_id)""",
    "review", "keys",
)
def bibtex_entries(m: Model) -> DataFrame:
    """SNK-05"""
    field = lambda name, value: F.concat(F.lit(f"  {name:<10} = {{"), value, F.lit("}"))
    kind, esc = T.entry_type(F.col("venue")), T.bibliography_escaped
    body = F.concat_ws(
        ",\n", field("title", esc(F.col("title"))), F.when(F.size("authors") > 0, field("author", esc(F.array_join("authors", " and ")))), F.when(F.col("year").isNotNull(), field("year", F.col("year").cast("string"))),
        F.when(F.col("venue") != "", F.when(kind == "inproceedings", field("booktitle", esc(F.col("venue")))).otherwise(field("journal", esc(F.col("venue"))))), F.when(F.col("doi") != "", field("doi", F.col("doi"))),
    )
    return review(m).join(keys(m), "paper_id").select("paper_id", F.concat(F.lit("@"), kind, F.lit("{"), "cite_key", F.lit(",\n"), body, F.lit("\n}")).alias("entry"))


@query(
    f"""select paper_id, concat_ws(chr(10), 'TY  - ' || case when {_TYPE} = 'inproceedings' then 'CONF' when venue <> '' then 'JOUR' else 'GEN' end, 'TI  - ' || title, case when len(authors) > 0 then 'AU  - ' || array_to_string(authors, chr(10) || 'AU  - ') end, 'PY  - ' || year,
      case when venue <> '' then 'JO  - ' || venue end, case when doi <> '' then 'DO  - ' || doi end, 'ER  - ') as record from review""",
    "review",
)
def ris_records(m: Model) -> DataFrame:
    """SNK-06"""
    tag = lambda name, value: F.concat(F.lit(f"{name}  - "), value)
    kind = F.when(T.entry_type(F.col("venue")) == "inproceedings", "CONF").when(F.col("venue") != "", "JOUR").otherwise("GEN")
    lines = F.concat_ws(
        "\n", tag("TY", kind), tag("TI", F.col("title")), F.when(F.size("authors") > 0, tag("AU", F.array_join("authors", "\nAU  - "))), tag("PY", F.col("year").cast("string")),
        F.when(F.col("venue") != "", tag("JO", F.col("venue"))), F.when(F.col("doi") != "", tag("DO", F.col("doi"))), F.lit("ER  - "),
    )
    return review(m).select("paper_id", lines.alias("record"))


@query(
    """select cite_key, title, array_to_string(authors, '; ') as authors, year, venue, doi, case when is_peer_reviewed then 'yes' when not is_peer_reviewed then 'no' else '' end as peer_reviewed, cast(user_rating as integer) as rating,
      case when user_rating is null then '' when user_rating >= 6 then 'included' else 'excluded' end as decision, niche as theme, case when filepath <> '' then 'yes' else 'no' end as has_fulltext, coalesce(n_sections, 0) as n_sections, coalesce(n_refs, 0) as n_refs, source
    from review join keys using (paper_id) left join (select paper_id, count(*) as n_sections from sections group by all) using (paper_id) left join (select paper_id, count(distinct ref_id) as n_refs from refs group by all) using (paper_id)""",
    "review", "keys", "sections", "refs",
)
def synthesis_matrix(m: Model) -> DataFrame:
    """SNK-07"""
    n_sections = m.sections.groupBy("paper_id").agg(F.count("*").alias("n_sections"))
    n_refs = m.refs.groupBy("paper_id").agg(F.count_distinct("ref_id").alias("n_refs"))
    joined = review(m).join(keys(m), "paper_id").join(n_sections, "paper_id", "left").join(n_refs, "paper_id", "left")
    return joined.select(
        "cite_key", "title", F.array_join("authors", "; ").alias("authors"), "year", "venue", "doi", F.when(F.col("is_peer_reviewed"), "yes").when(~F.col("is_peer_reviewed"), "no").otherwise("").alias("peer_reviewed"),
        F.col("user_rating").cast("int").alias("rating"), F.when(F.col("user_rating").isNull(), "").otherwise(S.screen_decision(F.col("user_rating"))).alias("decision"), F.col("niche").alias("theme"),
        F.when(F.col("filepath") != "", "yes").otherwise("no").alias("has_fulltext"), F.coalesce("n_sections", F.lit(0)).alias("n_sections"), F.coalesce("n_refs", F.lit(0)).alias("n_refs"), "source",
    )


@query("select paper_id, title, user_rating from papers where user_rating is not null qualify row_number() over (order by user_rating desc, paper_id) <= 5", "papers")
def top_rated(m: Model) -> DataFrame:
    """AGG-35: a top-5 listing"""
    return m.papers.where("user_rating is not null").orderBy(F.desc("user_rating"), "paper_id").limit(5).select("paper_id", "title", "user_rating")


@query("select source, count(*) as n from papers where kind = 'paper' group by source union all select 'rated', count(*) from papers where user_rating is not null union all select 'thoughts', count(*) from papers where kind <> 'paper'", "papers")
def accessors(m: Model) -> DataFrame:
    """GRF-15: seed, rated and own-text views, counted"""
    p = m.papers
    return (
        p.where("kind = 'paper'").groupBy("source").agg(F.count("*").alias("n"))
        .unionByName(p.where("user_rating is not null").agg(F.count("*").alias("n")).select(F.lit("rated").alias("source"), "n"))
        .unionByName(p.where("kind <> 'paper'").agg(F.count("*").alias("n")).select(F.lit("thoughts").alias("source"), "n"))
    )


@query("select paper_id, title from papers where kind = 'paper' and lower(title) like '%tion%' qualify row_number() over (order by ordinal) <= 12", "papers")
def library_search(m: Model) -> DataFrame:
    """JON-20: the first 12 papers whose title has a fragment"""
    return m.papers.where((F.col("kind") == "paper") & F.contains(F.lower("title"), F.lit("tion"))).orderBy("ordinal").limit(12).select("paper_id", "title")


@query("select paper_id, round(weight, 6) as weight, year from papers where filepath = '' and (doi <> '' or arxiv_id <> '') qualify row_number() over (order by round(weight, 9) desc, coalesce(year, 0) desc, paper_id) <= 50", "papers")
def harvest_order(m: Model) -> DataFrame:
    """WIN-09: the next 50 papers to fetch"""
    able = m.papers.where("filepath = '' and (doi <> '' or arxiv_id <> '')")
    return able.orderBy(F.desc(F.round("weight", 9)), F.desc(F.coalesce("year", F.lit(0))), "paper_id").limit(50).select("paper_id", r6("weight"), "year")


@query(
    """best as (select paper_id, 1 as tier, row_number() over (order by user_rating desc, coalesce(year, 0) desc, paper_id) as rn from papers where user_rating >= 10 and kind = 'paper' and source <> 'capsule'),
    first_ as (select paper_id, tier, rn from best where rn <= 10),
    fill as (select paper_id, 2 as tier, row_number() over (order by ordinal desc) as rn from papers where kind = 'paper' and doi <> '' and source in ('snowball', 'discovered') and paper_id not in (select paper_id from first_))
    select paper_id, tier from (select *, row_number() over (order by tier, rn) as pos from (select * from first_ union all select * from fill)) where pos <= 10""",
    "papers",
)
def snowball_seeds(m: Model) -> DataFrame:
    """WIN-07, WIN-08: ten seeds, the best rated first, then the newest of the frontier"""
    papers = m.papers.where("kind = 'paper'")
    best = papers.where("user_rating >= 10 and source <> 'capsule'").orderBy(F.desc("user_rating"), F.desc(F.coalesce("year", F.lit(0))), "paper_id").limit(10)
    n = best.count()
    frontier = papers.where("doi <> '' and source in ('snowball', 'discovered')").join(F.broadcast(best.select("paper_id")), "paper_id", "left_anti")
    return best.select("paper_id", F.lit(1).alias("tier")).unionByName(frontier.orderBy(F.desc("ordinal")).limit(10 - n).select("paper_id", F.lit(2).alias("tier")))


@query(
    """nodes as (select paper_id from papers where role = 'corpus' qualify row_number() over (order by ordinal) <= 400),
    links as (select src, dst, weight, layer from (select src, dst, weight, 'semantic' as layer from semantic_edges where weight >= 0.27 union all select src, dst, weight, 'citation' from citation_edges) where src in (select paper_id from nodes) and dst in (select paper_id from nodes) qualify row_number() over (order by round(weight, 9) desc, layer, src, dst) <= 2000)
    select paper_id, count(src) as degree from nodes left join (select src, paper_id from (select src, src as paper_id from links union all select src, dst from links)) using (paper_id) group by paper_id""",
    "papers", "semantic_edges", "citation_edges",
)
def graph_view(m: Model) -> DataFrame:
    """WIN-16: degrees in a view of at most 400 papers and their 2000 strongest links"""
    nodes = m.corpus.orderBy("ordinal").limit(400).select("paper_id")
    links = m.semantic_edges.where("weight >= 0.27").withColumn("layer", F.lit("semantic")).unionByName(m.citation_edges.select("src", "dst", "weight").withColumn("layer", F.lit("citation")))
    for end in ("src", "dst"):
        links = links.join(F.broadcast(nodes.select(F.col("paper_id").alias(end))), end, "left_semi")
    cut = links.orderBy(F.desc(F.round("weight", 9)), "layer", "src", "dst").limit(2000)
    deg = cut.select(F.explode(F.array("src", "dst")).alias("paper_id")).groupBy("paper_id").agg(F.count("*").alias("degree"))
    return nodes.join(deg, "paper_id", "left").select("paper_id", F.coalesce("degree", F.lit(0)).alias("degree"))


@query(
    """kept as (select paper_id, doi, embedding, row_number() over (order by ordinal) - 1 as idx from corpus where kind = 'paper')
    select a.idx as src, b.idx as dst, round(weight, 6) as weight from semantic_edges e join kept a on a.paper_id = e.src join kept b on b.paper_id = e.dst""",
    "corpus", "semantic_edges",
)
def capsule_edges(m: Model) -> DataFrame:
    """SNK-04: edges of an exported capsule, papers numbered from 0 without gaps"""
    from quillgraph.operators.ranking import numbered

    kept = numbered(m.corpus.where("kind = 'paper'").select("paper_id", "ordinal"), [F.col("ordinal")], "n").select("paper_id", (F.col("n") - 1).alias("idx"))
    e = m.semantic_edges.join(kept.select(F.col("paper_id").alias("src"), F.col("idx").alias("a")), "src").join(kept.select(F.col("paper_id").alias("dst"), F.col("idx").alias("b")), "dst")
    return e.select(F.col("a").alias("src"), F.col("b").alias("dst"), r6("weight"))


@query(
    """mine as (select lower(doi) as doi, embedding from corpus where kind = 'paper'), best as (select c.paper_id, max(list_inner_product(c.embedding, p.embedding)) as best from candidates c, mine p group by c.paper_id)
    select paper_id, case when doi <> '' and lower(doi) in (select doi from mine) then 'shared_by_doi' when doi <> '' and title <> '' then 'imported' when best >= 0.4 then 'shared_by_embedding' else 'novel' end as class, round(best, 6) as best from candidates join best using (paper_id)""",
    "candidates", "corpus",
)
def capsule_reconciliation(m: Model) -> DataFrame:
    """JON-14, AGG-32: what becomes of each paper of a received capsule"""
    from quillgraph.operators.exchange import reconcile

    return reconcile(m.candidates, m.corpus.where("kind = 'paper'"), 0.4).select("paper_id", "class", r6("best"))


@query("select source, count(*) as fetched, count(distinct case when doi = '' then paper_id else doi end) as new_unique, round(count(distinct case when doi = '' then paper_id else doi end) / count(*) + 1e-9, 3) as saturation from papers group by source", "papers")
def source_saturation(m: Model) -> DataFrame:
    """AGG-33"""
    key = F.when(F.col("doi") == "", F.col("paper_id")).otherwise(F.col("doi"))
    return m.papers.groupBy("source").agg(F.count("*").alias("fetched"), F.count_distinct(key).alias("new_unique")).withColumn("saturation", F.round(F.col("new_unique") / F.col("fetched") + 1e-9, 3))


@query(
    """daily as (select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as events, count(distinct user_id) as users, round(avg(value) + 1e-9, 6) as mean from events group by 1)
    select day, events, users, mean, events - first_value(events) over (order by day) as change from daily qualify row_number() over (order by day desc) <= 500"""
)
def evolution_series(m: Model) -> DataFrame:
    """AGG-34, SNK-09: the last 500 snapshots and their change since the first"""
    daily = m.table("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value") + 1e-9, 6).alias("mean"))
    first = daily.agg(F.min_by("events", "day").alias("first"))
    return daily.orderBy(F.desc("day")).limit(500).crossJoin(F.broadcast(first)).select("day", "events", "users", "mean", (F.col("events") - F.col("first")).alias("change"))


@query(
    """folded as (select user_id, list({'c': value % 10 + 1, 'u': (value * 7) % 10 + 1} order by event_id) as x from events where event_type = 'view' group by user_id)
    select user_id, round(list_reduce(list_prepend(1.0::double, list_transform(x, lambda f: f.c + f.u)), lambda w, s: greatest(0.05, w * 0.8 + 2 * 0.2 * s / 20)), 6) as weight, len(x) as n from folded"""
)
def style_profile(m: Model) -> DataFrame:
    """AGG-18: an exponential moving average over feedback in order"""
    c, u = F.col("value") % 10 + 1, (F.col("value") * 7) % 10 + 1
    rows = m.table("events").where("event_type = 'view'").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", (c + u).alias("s")))).alias("x"))
    return rows.select("user_id", r6(Y.moving_average(F.transform("x", lambda r: r["s"])), "weight"), F.size("x").cast("long").alias("n"))


@query("select paper_id, user_rating, round(dot, 6) as similarity from (select paper_id, user_rating, list_inner_product(embedding, question) as dot from corpus, question) where user_rating is not null", "corpus", "question")
def rated_against_question(m: Model) -> DataFrame:
    """ITR-12, AGG-36: the latest ratings beside their similarity to the question"""
    return m.corpus.where("user_rating is not null").crossJoin(F.broadcast(m.question)).select("paper_id", "user_rating", r6(dot("embedding", "question"), "similarity"))


