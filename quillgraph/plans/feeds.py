"""Queries over sources, sinks and increments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.model import Model
from quillgraph.plans.registration import registrar
from quillgraph.sources import logs as L
from quillgraph.sources import works as W
from quillgraph.streaming import watches as X

QUERIES, ORACLES, query = registrar()


@query(
    """select o_orderkey, (not (kind = '' or kind in ('journal-article', 'book-chapter', 'proceedings-article', 'posted-content')) or doi like '10.5860/choice.%' or doi like '10.5860/crln.%' or venue like '%choice reviews%' or venue like '%library journal%' or venue like '%publishers weekly%') as noise from (
      select o_orderkey, ['', 'journal-article', 'report', 'posted-content'][o_custkey % 4 + 1] as kind, ['10.5860/choice.', '10.1/a.', '10.5860/crln.', '10.2/b.', '10.3/c.'][o_orderkey % 5 + 1] || o_orderkey as doi, ['the library journal', 'annals', 'letters'][o_custkey % 3 + 1] as venue from orders)"""
)
def source_noise(m: Model) -> DataFrame:
    """SRC-12"""
    pick = lambda values, key: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))
    doi = F.concat(pick(("10.5860/choice.", "10.1/a.", "10.5860/crln.", "10.2/b.", "10.3/c."), F.col("o_orderkey")), F.col("o_orderkey").cast("string"))
    return m.table("orders").select("o_orderkey", W.is_noise(doi, pick(("", "journal-article", "report", "posted-content"), F.col("o_custkey")), pick(("the library journal", "annals", "letters"), F.col("o_custkey"))).alias("noise"))


_ID = "case when {s2} <> '' then 's2_' || {s2} when {doi} <> '' then 'doi_' || substr(sha1(lower({doi})), 1, 10) when {arxiv} <> '' then 'arxiv_' || {arxiv} else 'title_' || substr(sha1(lower(title)), 1, 10) end as paper_id"


def _landed(papers: DataFrame, **fields) -> DataFrame:
    """A page a paper, as a service would land it."""
    return papers.select(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("json"))


@query(
    f"""words as (select doc_id, unnest(w) as w, generate_subscripts(w, 1) as i from (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') as w from documents)),
    texts as (select doc_id, string_agg(w, ' ' order by i) as t from words group by doc_id),
    listed as (select papers.* replace (substr(trim(title), 1, 250) as title), coalesce(t, '') as t, lower(doi) as low from papers left join texts on doc_id = ordinal)
    select {_ID.format(s2="''", doi="low", arxiv="''")}, title, md5(substr(t, 1, 2000)) as abstract, array_to_string(authors, '; ') as authors, year, low as doi, case when low <> '' then 'https://doi.org/10.1234/DOC.' || substr(low, 13) else 'https://openalex.org/W' || ordinal end as url, venue,
      [true, false, null][ordinal % 3 + 1] as is_peer_reviewed, cited_by_count from listed where title <> ''""",
    "papers",
)
def works_scan(m: Model) -> DataFrame:
    """SRC-09, SRC-10: landed pages of a works index as papers, abstracts put together from their inverted form"""
    words = m.table("documents").select("doc_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("p", "w")).groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps"))
    inverted = words.groupBy(F.col("doc_id").alias("ordinal")).agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("inverted"))
    kind = F.element_at(F.array(F.lit("Journal"), F.lit("repository"), F.lit("")), (F.pmod("ordinal", F.lit(3)) + 1).cast("int"))
    place = F.struct(F.struct(F.col("venue").alias("display_name"), kind.alias("type")).alias("source"))
    landed = _landed(
        m.papers.join(inverted, "ordinal", "left"), id=F.concat(F.lit("https://openalex.org/W"), "ordinal"), doi=F.when(F.col("doi") != "", F.concat(F.lit("https://doi.org/"), F.upper("doi"))), display_name=F.col("title"), publication_year=F.col("year"),
        cited_by_count=F.col("cited_by_count"), abstract_inverted_index=F.col("inverted"), authorships=F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))), primary_location=place,
    )
    got = W.openalex(landed)
    return got.select("paper_id", "title", F.md5(F.encode("abstract", "UTF-8")).alias("abstract"), F.array_join("authors", "; ").alias("authors"), "year", "doi", "url", "venue", "is_peer_reviewed", "cited_by_count")


@query(
    f"""kinds as (select * replace (substr(trim(title), 1, 250) as title), trim(title) as whole, ['journal-article', 'posted-content', 'report', ''][ordinal % 4 + 1] as form, case when ordinal % 11 = 0 then '10.5860/choice.' || ordinal else doi end as d, case when ordinal % 10 = 3 then 'Library Journal' else venue end as place from papers)
    select {_ID.format(s2="''", doi="d", arxiv="''")}, title, substr(regexp_replace('Of ' || regexp_replace(whole, '[<>]', '', 'g') || ' & more', '\\s+', ' ', 'g'), 1, 2000) as abstract, array_to_string(authors, '; ') as authors, year, d as doi, case when d <> '' then 'https://doi.org/' || d else '' end as url, place as venue,
      case form when 'journal-article' then true when 'posted-content' then false end as is_peer_reviewed, cited_by_count
    from kinds where title <> '' and ordinal % 11 <> 0 and form <> 'report' and place <> 'Library Journal'""",
    "papers",
)
def registry_scan(m: Model) -> DataFrame:
    """SRC-11, SRC-12: landed pages of a DOI registry as papers, without tags and noise"""
    o, title = F.col("ordinal"), F.trim("title")
    form = F.element_at(F.array(*[F.lit(x) for x in ("journal-article", "posted-content", "report", "")]), (F.pmod(o, F.lit(4)) + 1).cast("int"))
    dated = F.struct(F.when(F.col("year").isNotNull(), F.array(F.array("year", F.lit(3)))).alias("date-parts"))
    landed = _landed(
        m.papers, DOI=F.when(F.pmod(o, F.lit(11)) == 0, F.concat(F.lit("10.5860/CHOICE."), o.cast("string"))).otherwise(F.col("doi")), type=form, title=F.array(title), abstract=F.concat(F.lit("<jats:p>Of \n "), F.regexp_replace(title, r"[<>]", ""), F.lit("  &</jats:p> more")),
        author=F.transform("authors", lambda a: F.struct(F.substring_index(a, " ", 1).alias("given"), F.substring_index(a, " ", -1).alias("family"))), **{"container-title": F.array(F.when(F.pmod(o, F.lit(10)) == 3, "Library Journal").otherwise(F.col("venue"))), "is-referenced-by-count": F.col("cited_by_count")},
        **{("issued", "published-online")[i]: F.when(F.pmod(o, F.lit(2)) == i, dated) for i in (0, 1)},
    )
    return W.crossref(landed).select("paper_id", "title", "abstract", F.array_join("authors", "; ").alias("authors"), "year", "doi", "url", "venue", "is_peer_reviewed", "cited_by_count")


@query(
    f"""listed as (select * replace (substr(trim(title), 1, 250) as title), trim(title) as whole from papers)
    select {_ID.format(s2="s2_id", doi="doi", arxiv="arxiv_id")}, title, array_to_string(authors, '; ') as authors, year, doi, s2_id, arxiv_id, case when ordinal % 2 = 0 then 'https://example.org/' || ordinal when arxiv_id <> '' then 'https://arxiv.org/abs/' || arxiv_id else '' end as url, venue,
      case when ordinal % 3 = 0 then true when arxiv_id <> '' and venue = '' then false end as is_peer_reviewed from listed where title <> ''""",
    "papers",
)
def scholar_scan(m: Model) -> DataFrame:
    """SRC-13: landed pages of a scholar index as papers"""
    o = F.col("ordinal")
    landed = _landed(
        m.papers, paperId=F.col("s2_id"), title=F.col("title"), abstract=F.col("abstract"), year=F.col("year"), url=F.when(F.pmod(o, F.lit(2)) == 0, F.concat(F.lit("https://example.org/"), o.cast("string"))), authors=F.transform("authors", lambda a: F.struct(a.alias("name"))),
        externalIds=F.struct(F.col("doi").alias("DOI"), F.col("arxiv_id").alias("ArXiv")), publicationVenue=F.struct(F.col("venue").alias("name"), F.when(F.pmod(o, F.lit(3)) == 0, "Journal").alias("type")),
    )
    return W.semantic_scholar(landed).select("paper_id", "title", F.array_join("authors", "; ").alias("authors"), "year", "doi", "s2_id", "arxiv_id", "url", "venue", "is_peer_reviewed")


@query(
    f"""listed as (select *, ordinal || '.5' as number, year is not null as dated from papers where ordinal % 5 <> 0)
    select {_ID.format(s2="''", doi="''", arxiv="number").replace("lower(title)", "lower(t)")}, t as title, 'Of ' || ordinal as abstract, array_to_string(authors, '; ') as authors, year, number as arxiv_id, 'https://arxiv.org/abs/' || number as url, 'arXiv' as venue, false as is_peer_reviewed from (select *, 'A < B of ' || ordinal as t from listed)""",
    "papers",
)
def preprint_scan(m: Model) -> DataFrame:
    """SRC-14: landed Atom feeds of a preprint server as papers; a fifth of the feeds does not parse"""
    o = F.col("ordinal").cast("string")
    people = F.array_join(F.transform("authors", lambda a: F.concat(F.lit("<author><name>"), a, F.lit("</name></author>"))), "")
    dated = F.coalesce(F.concat(F.lit("<published>"), F.col("year").cast("string"), F.lit("-02-03T00:00:00Z</published>")), F.lit(""))
    entry = F.concat(F.lit("<entry><id>http://arxiv.org/abs/"), o, F.lit(".5v2</id><title> A &lt; B of "), o, F.lit(" </title><summary>Of "), o, F.lit("</summary>"), people, dated, F.lit("</entry>"))
    whole = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), entry, F.lit("</feed>"))
    feeds = m.papers.select(F.when(F.pmod("ordinal", F.lit(5)) == 0, "<feed><entry>").otherwise(whole).alias("xml"))
    return W.arxiv(feeds).select("paper_id", "title", "abstract", F.array_join("authors", "; ").alias("authors"), "year", "arxiv_id", "url", "venue", "is_peer_reviewed")


@query("select page_id, sha256('1|pages|' || url) as key from pages")
def cache_keys(m: Model) -> DataFrame:
    """SRC-29"""
    return m.table("pages").select("page_id", W.cache_key("pages", F.col("url")).alias("key"))


@query("select paper_id, coalesce(case when arxiv_id <> '' then 'https://arxiv.org/pdf/' || arxiv_id end, case when ordinal % 3 = 0 and doi <> '' then 'unpaywall:' || doi end, case when doi <> '' then 'openalex:' || doi end) as location from papers", "papers")
def open_access_locations(m: Model) -> DataFrame:
    """SRC-18, UDF-02: the first resolver that knows a place"""
    named = lambda prefix, c: F.when(F.col(c) != "", F.concat(F.lit(prefix), c)).otherwise("")
    second = F.when(F.pmod("ordinal", F.lit(3)) == 0, named("unpaywall:", "doi")).otherwise("")
    return m.papers.select("paper_id", W.first_known(named("https://arxiv.org/pdf/", "arxiv_id"), second, named("openalex:", "doi")).alias("location"))


@query(
    """select p.paper_id, case when length(b.text) > length(p.title) then md5(b.text) else md5(p.title) end as title, case when p.doi = '' and b.text is not null then '10.9/x' || p.ordinal else p.doi end as doi from papers p left join benchmark b on b.item_id = p.ordinal""", "papers"
)
def upgraded_papers(m: Model) -> DataFrame:
    """SRC-27: papers after their documents were parsed"""
    parsed = m.table("benchmark").select(F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("paper_id"), F.col("text").alias("title"), F.lit("").alias("abstract"), F.concat(F.lit("10.9/x"), F.col("item_id").cast("string")).alias("doi"))
    return W.upgraded(m.papers.select("paper_id", "title", "abstract", "doi"), parsed).select("paper_id", F.md5(F.encode("title", "UTF-8")).alias("title"), "doi")


@query("select event_id, user_id, event_type from events where ts >= timestamp '2024-01-15'")
def records_since(m: Model) -> DataFrame:
    """SRC-19, STR-02: records created since a mark, whatever they are dated"""
    return m.table("events").where(F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id", "user_id", "event_type")


@query("select p.p_partkey, p.p_name, count(l_orderkey) as cited_by from part p semi join (select distinct l_partkey from lineitem where l_quantity >= 49) w on w.l_partkey = p.p_partkey left join lineitem on lineitem.l_partkey = p.p_partkey group by all")
def works_by_id(m: Model) -> DataFrame:
    """SRC-20: works named by a list of ids, with how often they are cited"""
    lines = m.table("lineitem")
    wanted = lines.where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    cited = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("cited_by"))
    return m.table("part").join(wanted, "p_partkey", "left_semi").join(cited, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("cited_by", F.lit(0)).alias("cited_by"))


@query(
    """daily as (select strftime(date_trunc('day', ts), '%Y-%m-%d') as snapshot_file, count(*) as n from events group by 1)
    select snapshot_file, n from daily""",
)
def compacted_history(m: Model) -> DataFrame:
    """SNK-02: snapshots folded into the log once, however often it is done"""
    daily = m.table("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("snapshot_file")).agg(F.count("*").alias("n"))
    log = L.compacted(daily.where("snapshot_file < '2024-01-16'"), daily.where("snapshot_file >= '2024-01-10'"))
    return L.compacted(log, daily)


@query(
    """found as (select paper_id as token, round(list_inner_product(embedding, context), 6) as score from papers, context where kind = 'paper')
    select token, score from found where score >= 0.05 and token not in (select paper_id from corpus)""",
    "papers", "corpus", "context",
)
def inbox(m: Model) -> DataFrame:
    """STR-03, SNK-11, API-07: finds above the threshold that neither the inbox nor the graph has, each once"""
    from quillgraph.functions.vectors import dot

    scored = m.papers.where("kind = 'paper'").crossJoin(F.broadcast(m.context)).select(F.col("paper_id").alias("token"), F.round(dot("embedding", "context"), 6).alias("score"), F.lit("drift").alias("watch")).where("score >= 0.05")
    empty = scored.where(F.lit(False))
    once = L.inbox_added(empty, scored, m.corpus)
    return L.inbox_added(once, scored, m.corpus).select("token", "score")


@query("select user_id, round_, value from (select user_id, event_id as round_, value, row_number() over (order by event_id desc) as rn from events where event_type = 'purchase') where rn <= 100")
def experiment_tail(m: Model) -> DataFrame:
    """SNK-16, WIN-21: the last hundred rows of a log"""
    return m.table("events").where("event_type = 'purchase'").orderBy(F.desc("event_id")).limit(100).select("user_id", F.col("event_id").alias("round_"), "value")


@query("select paper_id from papers where kind = 'paper' and user_rating >= 7 and paper_id not in (select 'p' || vec_id from embeddings where label = 4)", "papers")
def unused_seeds(m: Model) -> DataFrame:
    """STR-04, SET-03: seeds that no earlier round used"""
    used = m.table("embeddings").where("label = 4").select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("paper_id"))
    return m.papers.where("kind = 'paper' and user_rating >= 7").join(used, "paper_id", "left_anti").select("paper_id")


@query("select user_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def stream_latest(m: Model) -> DataFrame:
    """STR-05: the latest event of every user, kept by a stream"""
    schema = m.table("events").schema
    stream = X.files(m.spark, m.sf_dir, schema, "events.parquet")
    empty = m.table("events").select("user_id", "ts", "event_id", "event_type", "value").where(F.lit(False))
    state = X.State(m.spark, "latest", m.spark.createDataFrame([], empty.schema))
    return X.latest_by(stream, "user_id", ["ts", "event_id"], state).select("user_id", "event_type", "value")


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) as n from events group by all")
def stream_windows(m: Model) -> DataFrame:
    """STR-07: hourly counts of a stream with a watermark"""
    schema = m.table("events").schema
    stream = X.files(m.spark, m.sf_dir, schema, "events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    state = X.State(m.spark, "windows", m.spark.createDataFrame([], "start timestamp, event_type string, n long"))
    counts = X.windowed_counts(stream, "at", "1 hour", "40 days", ["event_type"], state)
    return counts.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query(
    """slid as (select unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) as start, event_type from events)
    select strftime(start, '%Y-%m-%d %H:%M') as start, event_type, count(*) as n from slid group by all"""
)
def stream_sliding_windows(m: Model) -> DataFrame:
    """STR-07: counts of a stream over the last hour, every thirty minutes"""
    stream = X.files(m.spark, m.sf_dir, m.table("events").schema, "events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    state = X.State(m.spark, "sliding", m.spark.createDataFrame([], "start timestamp, event_type string, n long"))
    counts = X.windowed_counts(stream, "at", "1 hour", "40 days", ["event_type"], state, "30 minutes")
    return counts.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query(
    """marked as (select user_id, ts, coalesce(ts - lag(ts) over w >= interval '6 hours', true) as opens from events window w as (partition by user_id order by ts)),
    told as (select user_id, ts, sum(opens::int) over (partition by user_id order by ts) as s from marked),
    sessions as (select user_id, s, min(ts) as start, max(ts) as ending, count(*) as n from told group by all)
    select user_id, strftime(start, '%Y-%m-%d %H:%M:%S') as start, n from sessions where ending + interval '6 hours' <= (select max(ts) from events) - interval '1 day'"""
)
def stream_sessions(m: Model) -> DataFrame:
    """STR-07: closed sessions of every user in a stream, six hours without an event apart"""
    stream = X.files(m.spark, m.sf_dir, m.table("events").schema, "events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    state = X.State(m.spark, "sessions", m.spark.createDataFrame([], "start timestamp, user_id long, n long"))
    closed = X.session_counts(stream, "at", "6 hours", "1 day", ["user_id"], state)
    return closed.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("select distinct user_id, event_type from events")
def stream_first_seen(m: Model) -> DataFrame:
    """STR-03: stateful deduplication of a stream"""
    stream = X.files(m.spark, m.sf_dir, m.table("events").schema, "events.parquet")
    state = X.State(m.spark, "seen", m.spark.createDataFrame([], "user_id long, event_type string"))
    return X.first_seen(stream, ["user_id", "event_type"], state)


@query(
    """select event_id as token, 'w-' || event_type as watch, value as score from events where event_type in ('view', 'signup') and value >= 40 and ts >= case event_type when 'view' then timestamp '2024-01-10' else timestamp '2024-01-20' end
    and event_id not in (select o_orderkey from orders where o_orderstatus = 'F')"""
)
def stream_watches(m: Model) -> DataFrame:
    """STR-01, STR-03: a watch check over a stream, with a mark for each watch"""
    stream = X.files(m.spark, m.sf_dir, m.table("events").schema, "events.parquet").select(F.col("event_id").alias("token"), F.col("ts").alias("created"), F.col("event_type").alias("topic"), F.col("value").alias("score"))
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    marks = m.spark.createDataFrame([("w-view", "view"), ("w-signup", "signup")], "watch string, topic string").withColumn("since", F.when(F.col("topic") == "view", stamp("2024-01-10 00:00:00")).otherwise(stamp("2024-01-20 00:00:00")))
    state = X.State(m.spark, "watch", m.spark.createDataFrame([], "token long, watch string, score double, created timestamp_ntz"))
    known = m.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("token"))
    return X.watch_check(stream, marks, known, state, 40).select("token", "watch", "score")


