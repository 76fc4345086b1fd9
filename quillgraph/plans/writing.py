"""Queries that embed, render and check: embeddings, scaffolds, digests, arguments, storage constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import embedding as E
from quillgraph.functions.text import STOP_WORDS
from quillgraph.functions.vectors import dot
from quillgraph.operators import rendering as N
from quillgraph.plans import graphs, reasoning, reporting
from quillgraph.plans.model import QUESTION, Model
from quillgraph.plans.registration import r6, registrar

QUERIES, ORACLES, query = registrar()

_BYTES = "list_transform(range(32), lambda i: ((strpos('0123456789abcdef', substr(h, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 2 * i + 2, 1)) - 1)::double)"


@query(f"select doc_id, round(list_extract(b, 1) / sqrt(12 * list_inner_product(b, b)), 6) as first, round(list_extract(b, 32) / sqrt(12 * list_inner_product(b, b)), 6) as last from (select doc_id, {_BYTES} as b from (select doc_id, sha256(text) as h from documents))")
def hash_embeddings(m: Model) -> DataFrame:
    """ITR-16"""
    v = E.hash_embedding(F.col("text"))
    return m.table("documents").select("doc_id", v.alias("v")).select("doc_id", r6(F.element_at("v", 1), "first"), r6(F.element_at("v", -1), "last"))


@query(
    """words as (select doc_id, text, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') as w from documents),
    cut as (select doc_id, text, list_filter(list_transform(range(0, len(w), 240), lambda i: array_to_string(w[i + 1 : i + 300], ' ')), lambda c: length(c) > 60) as c from words)
    select doc_id, greatest(1, least(8, len(c))) as n_chunks from cut"""
)
def chunk_embeddings(m: Model) -> DataFrame:
    """SRC-30, STR-T17, ITR-23: texts embedded in chunks and pooled; here the number of chunks of each"""
    return E.pooled_texts(m.table("documents").select("doc_id", "text"), "doc_id", "text").where(F.size("pooled") == E.DIMENSION).select("doc_id", "n_chunks")


@query("select paper_id, md5(case when trim(abstract) <> '' then abstract else title end) as digest from papers", "papers")
def embedded_text(m: Model) -> DataFrame:
    """ITR-23: the text that a paper is embedded by"""
    return m.papers.select("paper_id", F.md5(F.encode(E.best_text(F.lit(""), F.col("abstract"), F.col("title")), "UTF-8")).alias("digest"))


@query("select doi, count(*) as n from papers where doi <> '' group by doi having count(*) > 1 union all select paper_id, count(*) from papers group by paper_id having count(*) > 1", "papers")
def uniqueness_violations(m: Model) -> DataFrame:
    """GRF-17: keys that are not unique; none is the expected answer"""
    twice = lambda c: m.papers.where(F.col(c) != "").groupBy(F.col(c).alias("doi")).agg(F.count("*").alias("n")).where("n > 1")
    return twice("doi").unionByName(twice("paper_id"))


@query("select paper_id, (length(t) - length(replace(t, 'the', ''))) // 3 as hits from (select paper_id, lower(title || ' ' || abstract) as t from papers) where contains(t, 'the')", "papers")
def full_text_hits(m: Model) -> DataFrame:
    """GRF-17: papers whose title or abstract holds a fragment, and how often"""
    t = F.lower(F.concat_ws(" ", "title", "abstract"))
    hit = m.papers.select("paper_id", t.alias("t")).where(F.contains("t", F.lit("the")))
    return hit.select("paper_id", F.floor((F.length("t") - F.length(F.replace("t", F.lit("the"), F.lit("")))) / 3).alias("hits"))


@query(
    """older as (select d.src, d.dst from direct d join corpus a on a.paper_id = d.src join corpus b on b.paper_id = d.dst where b.year < a.year - 15),
    chains as (select src || '>' || dst as path, dst as tip, 1 as hops from older union all select path || '>' || o.dst, o.dst, hops + 1 from chains join older o on o.src = tip where hops < 3)
    select path, hops from chains qualify row_number() over (order by hops desc, path) <= 50""",
    "direct", "corpus",
)
def citation_chains(m: Model) -> DataFrame:
    """GRF-18: fifty chains of one to three citations, each to a work at least fifteen years older"""
    year = m.corpus.select("paper_id", "year")
    cites = m.direct_edges.select("src", "dst")
    older = cites.join(year.select(F.col("paper_id").alias("src"), F.col("year").alias("a")), "src").join(year.select(F.col("paper_id").alias("dst"), F.col("year").alias("b")), "dst").where("b < a - 15").select("src", "dst")
    chains = older.select(F.concat_ws(">", "src", "dst").alias("path"), F.col("dst").alias("tip"), F.lit(1).alias("hops"))
    out = chains
    for hop in (2, 3):
        chains = chains.join(older, F.col("tip") == F.col("src")).select(F.concat_ws(">", "path", "dst").alias("path"), F.col("dst").alias("tip"), F.lit(hop).alias("hops"))
        out = out.unionByName(chains)
    return out.orderBy(F.desc("hops"), "path").limit(50).select("path", "hops")


@query()
def review_scaffold(m: Model) -> DataFrame:
    """SNK-08"""
    review = reporting.review(m)
    themes = review.groupBy(F.col("niche").alias("theme")).agg(F.count("*").alias("n"), F.count("user_rating").alias("n_rated"))
    return N.review_scaffold(review, reporting.keys(m), themes).select("position.part", "position.order", "line")


@query(
    """found as (select paper_id as token, title, niche as watch, list_inner_product(embedding, context) as score from candidates, context where list_inner_product(embedding, context) > 0.05)
    select 0 as part, watch || '/0' as "order", '## ' || watch || ' (' || count(*) || ' kept)' as line from found group by watch
    union all select 0, watch || '/1/' || lpad((row_number() over (partition by watch order by score desc, token))::varchar, 9, '0'), '- **' || title || '** — ' || round(score, 3)::varchar from found""",
    "candidates", "context",
)
def watch_digest(m: Model) -> DataFrame:
    """SNK-12"""
    found = m.candidates.crossJoin(F.broadcast(m.context)).select(F.col("paper_id").alias("token"), "title", F.col("niche").alias("watch"), dot("embedding", "context").alias("score")).where("score > 0.05")
    return N.digest(found).select("position.part", "position.order", "line")


def _talk(m: Model) -> tuple[DataFrame, DataFrame]:
    from quillgraph.operators import reasoning as A

    shown = reasoning.shown(m)
    return shown, A.connections(shown, *reasoning.among(m, shown), m.refs, m.membership)


@query("select kind, case kind when 'evolution' then n >= 2 and span >= 5 when 'convergence' then n >= 2 and edges >= 1 when 'tension' then n >= 2 when 'gap' then n >= 1 else n >= 3 and niches >= 1 end as feasible from (select unnest(['evolution', 'convergence', 'tension', 'gap', 'synthesis']) as kind), (select count(*) as n, max(year) - min(year) as span from shown), (select count(*) as edges from shown a join shown b on a.rank < b.rank where exists (select 1 from combined_edges c where (c.src = a.paper_id and c.dst = b.paper_id) or (c.src = b.paper_id and c.dst = a.paper_id))), (select count(*) as niches from shown a join shown b on a.rank < b.rank join corpus x on x.paper_id = a.paper_id join corpus y on y.paper_id = b.paper_id where x.niche = y.niche)", "retrieved", "combined_edges", "corpus")
def feasible_arguments(m: Model) -> DataFrame:
    """STR-T15"""
    return N.feasible_arguments(*_talk(m))


@query()
def arguments(m: Model) -> DataFrame:
    """STR-T15, STR-T19"""
    return N.arguments(QUESTION, *_talk(m))


@query()
def context_facts(m: Model) -> DataFrame:
    """ITR-22"""
    return N.context_facts(reasoning.shown(m), graphs.influences(m), m.membership)


@query(
    f"""told as (select conv_id, turn, list_filter(string_split_regex(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '') as w, row_number() over () as k from conversations),
    runs as (select k, list_transform(string_split(array_to_string(list_transform(w, lambda x: case when x in {STOP_WORDS} then '|' else x end), ' '), '|'), lambda r: trim(r)) as r from told where w is not null),
    cut as (select k, unnest(r) as run, generate_subscripts(r, 1) as i from runs),
    best as (select k, array_to_string(string_split(run, ' ')[1:4], ' ') as theme from cut qualify row_number() over (partition by k order by case when run = '' then 0 else len(string_split(run, ' ')) end desc, i) = 1)
    select conv_id, turn, theme from told left join best using (k)"""
)
def theme_phrases(m: Model) -> DataFrame:
    """STR-T13"""
    return m.table("conversations").select("conv_id", "turn", N.theme_phrase(F.col("text")).alias("theme"))


@query(
    """split as (select doc_id, string_split(text, chr(10)) as l from documents)
    select doc_id, md5(trim(coalesce(
      list_filter(l[1:30], lambda x: length(trim(x)) between 15 and 250 and not starts_with(trim(x), 'http') and not (length(trim(x)) < 60 and length(regexp_replace(trim(x), '[^\\p{L}]', '', 'g')) < length(trim(x)) * 0.5) and not (upper(trim(x)) = trim(x) and length(trim(x)) < 40))[1],
      list_filter(l[1:10], lambda x: length(trim(x)) > 10 and length(trim(x)) < 250)[1], l[1]))) as title from split"""
)
def guessed_titles(m: Model) -> DataFrame:
    """STR-T05"""
    return m.table("documents").select("doc_id", F.md5(F.encode(N.guessed_title(F.col("text")), "UTF-8")).alias("title"))


@query("select conv_id, turn, length(text) >= 80 and len(list_filter(string_split_regex(text, '[.!?]\\s+'), lambda s: s <> '')) >= 2 and regexp_matches(text, '\\b(19|20)\\d{2}\\b|\\([A-Z][a-z]+') as passes from (select conv_id, turn, text || case when turn % 2 = 0 then ' (Smith 2020).' else '' end as text from conversations)")
def argument_gate(m: Model) -> DataFrame:
    """STR-T19: whether a written text may stand as an argument"""
    text = F.concat("text", F.when(F.pmod("turn", F.lit(2)) == 0, " (Smith 2020).").otherwise(""))
    return m.table("conversations").select("conv_id", "turn", N.passes_gate(text).alias("passes"))
