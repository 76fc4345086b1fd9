"""Queries over text functions, whole tables and whole texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.vectors import dot
from quillgraph.plans.model import QUESTION, Model
from quillgraph.plans.registration import registrar

QUERIES, ORACLES, query = registrar()

_quote = lambda s: "'" + s.replace("'", "''") + "'"


def _nested(pairs, column: str) -> str:
    for old, new in pairs:
        column = f"replace({column}, {_quote(old)}, {_quote(new)})"
    return column


def _count(phrases, column: str) -> str:
    return "(" + " + ".join(f"contains({column}, {_quote(p)})::int" for p in phrases) + ")"


md5 = lambda c: F.md5(F.encode(c, "UTF-8"))
_CLEAN = f"trim(regexp_replace(regexp_replace({_nested(T.LIGATURES, 'text')}, '\\s+', ' ', 'g'), '[^\\x20-\\x7E\\n]', '', 'g'))"


@query(f"select doc_id, length({_CLEAN}) as n, md5({_CLEAN}) as digest from documents")
def cleaned_texts(m: Model) -> DataFrame:
    """STR-T01"""
    c = T.clean(F.col("text"))
    return m.table("documents").select("doc_id", F.length(c).cast("long").alias("n"), md5(c).alias("digest"))


@query(
    """select paper_id, case when length(d) >= 12 then d else '' end as found from (select paper_id, trim(regexp_extract('see ' || title || ' (doi:' || doi || '). ' || abstract, '10\\.\\d{4,9}/[^\\s"''<>\\[\\]{},;]+'), '.,;:)(') as d from papers)""", "papers"
)
def extracted_dois(m: Model) -> DataFrame:
    """STR-T02"""
    text = F.concat(F.lit("see "), "title", F.lit(" (doi:"), "doi", F.lit("). "), "abstract")
    return m.papers.select("paper_id", T.doi(text).alias("found"))


@query(
    """words as (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') as w from documents),
    cut as (select doc_id, list_filter(list_transform(range(0, len(w), 320), lambda i: array_to_string(w[i + 1 : i + 400], ' ')), lambda c: length(c) > 60) as c from words)
    select doc_id, len(c) as n, md5(array_to_string(c, '|')) as digest from cut"""
)
def word_chunks(m: Model) -> DataFrame:
    """STR-T03"""
    c = T.chunks(F.col("text"))
    return m.table("documents").select("doc_id", c.alias("c")).select("doc_id", F.size("c").cast("long").alias("n"), md5(F.array_join("c", "|")).alias("digest"))


_HEADINGS = ("Introduction", "Related Work", "Experimental Setup", "Methods and Materials", "Results", "General Discussion", "Limitations", "Concluding remarks", "Acknowledgments", "Appendix", "Prior work", "Ablation", "Notes", "Future Work", "Abstract", "Preliminaries")
_RULES = " ".join(f"when {' or '.join(f'contains(h, {_quote(w)})' for w in words)} then '{name}'" for name, words in T.SECTION_RULES)


@query(
    f"""select p_partkey, case {_RULES} else 'other' end as kind from (select p_partkey, trim(lower(regexp_replace(heading, '^\\s*(\\d+(\\.\\d+)*|[IVXLCDM]+|\\([a-z]\\))(\\s*[.):]\\s*|\\s+|$)', ''))) as h from (
      select p_partkey, ['', '3.2 ', 'IV. ', '(b) ', '7: '][p_partkey % 5 + 1] || {list(_HEADINGS)}[p_size % 16 + 1] as heading from part))"""
)
def section_types(m: Model) -> DataFrame:
    """STR-T06"""
    pick = lambda values, key: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))
    heading = F.concat(pick(("", "3.2 ", "IV. ", "(b) ", "7: "), F.col("p_partkey")), pick(_HEADINGS, F.col("p_size")))
    return m.table("part").select("p_partkey", T.section_type(heading).alias("kind"))


@query(
    f"""select doc_id, md5(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda l: trim(l) = '' or (length(trim(l)) > 4 and length(regexp_replace(l, '[^\\p{{L}}]', '', 'g')) >= length(trim(l)) * 0.35 and not regexp_matches(trim(l), {_quote(T.MATH_LINE)}))), lambda l: case when trim(l) = '' then '' else l end), chr(10))) as digest from documents"""
)
def without_equations(m: Model) -> DataFrame:
    """STR-T09"""
    return m.table("documents").select("doc_id", md5(T.without_equations(F.col("text"))).alias("digest"))


@query(f"select doc_id, md5(regexp_replace({_nested(T.MOJIBAKE + T.PLAIN_QUOTES, 'text')}, '[\\x{{80}}-\\x{{9f}}]', '', 'g')) as digest from documents")
def repaired_texts(m: Model) -> DataFrame:
    """STR-T10"""
    return m.table("documents").select("doc_id", md5(T.repaired(F.col("text"))).alias("digest"))


_NOISY = "case when ordinal % 2 = 0 then 'Cognition 91(2019)1437-1460 Available online at www.example.org ' else 'Neuroscience 1974 we show that ' end || regexp_replace(title, '[^ -~]', '', 'g') || ' © 2019 Elsevier B.V. All. ' || regexp_replace(abstract, '[^ -~\\n]', '', 'g')"


def _without(patterns, column: str) -> str:
    for p in patterns:
        column = f"regexp_replace({column}, {_quote(p)}, '', 'g')"
    return column


_QUIET = f"trim(regexp_replace({_without(T.NOISE, _nested(T.LIGATURES, 'noisy'))}, '\\s{{2,}}', ' ', 'g'))"


def _noisy():
    head = F.when(F.pmod("ordinal", F.lit(2)) == 0, "Cognition 91(2019)1437-1460 Available online at www.example.org ").otherwise("Neuroscience 1974 we show that ")
    # Word boundaries beside letters beyond ASCII differ between engines: titles and abstracts go in as ASCII.
    title, abstract = F.regexp_replace("title", "[^ -~]", ""), F.regexp_replace("abstract", r"[^ -~\n]", "")
    return F.concat(head, title, F.lit(" © 2019 Elsevier B.V. All. "), abstract)


@query(f"select paper_id, length({_QUIET}) as n, md5({_QUIET}) as digest from (select paper_id, {_NOISY} as noisy from papers)", "papers")
def noise_removed(m: Model) -> DataFrame:
    """STR-T08"""
    quiet = T.without_noise(_noisy())
    return m.papers.select("paper_id", F.length(quiet).cast("long").alias("n"), md5(quiet).alias("digest"))


_quiet = lambda column: f"trim(regexp_replace({_without(T.NOISE, _nested(T.LIGATURES, column))}, '\\s{{2,}}', ' ', 'g'))"
_GARBLED = "(" + " or ".join(f"regexp_matches(t, {_quote(p)})" for p in T.HEADER_LINES) + ")"
_TITLES = ("", "Psychological Review 1974, ", "Cognition 91 (2019) ", "July 20, 2011 ")


@query(
    f"""given as (select paper_id, {list(_TITLES)}[ordinal % 4 + 1] || regexp_replace(title, '[^ -~]', '', 'g') as t, {_NOISY} as a from papers),
    quiet as (select *, {_GARBLED} as garbled, {_quiet('a')} as q1, {_quiet('substr(a, 81, 300)')} as q2, {_quiet('substr(a, 121, 300)')} as q3, {_quiet('t')} as q4 from given),
    found as (select *, case when length(a) < 30 or length(q1) < 15 then '' when regexp_extract(q1, {_quote(T.FIRST_CHUNK)}, 1) <> '' then trim(regexp_extract(q1, {_quote(T.FIRST_CHUNK)}, 1)) else trim(substr(q1, 1, 150)) end as f from quiet),
    listed as (select paper_id, garbled, f, list_filter([case when length(a) > 40 and length(q1) > 40 then substr(q1, 1, 250) end, case when length(a) > 120 and length(q2) > 40 then substr(q2, 1, 250) end,
      case when length(a) > 200 and length(q3) > 40 then substr(q3, 1, 250) end, case when garbled and length(f) > 15 then substr(f, 1, 200) end,
      case when not garbled and length(t) > 15 and length(q4) > 15 then substr(q4, 1, 200) end, case when length(t) > 20 then substr(t, 1, 200) end], lambda v: v is not null) as v from found),
    keyed as (select *, list_transform(v, lambda x: lower(trim(substr(x, 1, 50)))) as k from listed)
    select paper_id, garbled, f as recovered, list_filter(v, lambda x, i: list_position(k, k[i]) = i) as variants from keyed""",
    "papers",
)
def query_variants(m: Model) -> DataFrame:
    """STR-T08: titles that are rather a journal's line, titles recovered from abstracts, and the texts to look papers up by"""
    t = F.concat(F.element_at(F.array(*[F.lit(x) for x in _TITLES]), (F.pmod("ordinal", F.lit(4)) + 1).cast("int")), F.regexp_replace("title", "[^ -~]", ""))
    given = m.papers.select("paper_id", t.alias("t"), _noisy().alias("a"))
    return given.select("paper_id", T.is_header(F.col("t")).alias("garbled"), T.recovered_title(F.col("a")).alias("recovered"), T.query_variants(F.col("t"), F.col("a")).alias("variants"))


@query("select conv_id, turn, case when regexp_matches(text, '(?i)\\b(?:gap|missing|lack|future|open\\s+question|unresolved|unclear|unknown|unexplored|understudied|not\\s+yet|limited)\\b') then 3.0 else 1.0 end::double as gap, case when regexp_matches(text, '(?i)\\b(?:conflict|disagree|debate|tension|contradict|competing|controversial|challenge|opposing|different\\s+view|vs\\.?\\s|versus|dispute)\\b') then 3.0 else 1.0 end::double as tension from (select conv_id, turn, text || case when turn % 2 = 0 then ' future debate' else '' end as text from conversations)")
def query_intents(m: Model) -> DataFrame:
    """SIG-34"""
    text = F.concat("text", F.when(F.pmod("turn", F.lit(2)) == 0, " future debate").otherwise(""))
    boosts = T.intent_boosts(text)
    return m.table("conversations").select("conv_id", "turn", boosts["gap"].alias("gap"), boosts["tension"].alias("tension"))


_CONTEXT = "lower(text || [' This finding is consistent with earlier work and confirms it.', ' However, it challenges prior claims.', ' See also, for a review, the survey.', ''][turn % 4 + 1])"


@query(
    f"""select conv_id, turn, case when short then 'mentions' when s >= c and s >= n then 'supports' when c >= n then 'contradicts' else 'mentions' end as intent, round(case when short then 0.3 else least(0.9, 0.45 + 0.12 * greatest(s, c, n)) end::double, 6) as confidence
    from (select *, length(trim(t)) < 10 or greatest(s, c, n) = 0 as short from (select conv_id, turn, {_CONTEXT} as t, {_count(T.SUPPORT_PHRASES, _CONTEXT)} as s, {_count(T.CONTRADICT_PHRASES, _CONTEXT)} as c, {_count(T.MENTION_PHRASES, _CONTEXT)} as n from conversations))"""
)
def citation_intents(m: Model) -> DataFrame:
    """ITR-17"""
    more = F.element_at(F.array(*[F.lit(x) for x in (" This finding is consistent with earlier work and confirms it.", " However, it challenges prior claims.", " See also, for a review, the survey.", "")]), (F.pmod("turn", F.lit(4)) + 1).cast("int"))
    got = T.citation_intent(F.concat("text", more))
    return m.table("conversations").select("conv_id", "turn", got["intent"].alias("intent"), F.round(got["confidence"], 6).alias("confidence"))


@query(
    """select src, dst, case when sim > 0.72 then 'supports' else 'mentions' end as intent, case when sim > 0.72 then 0.5 when sim > 0.45 then 0.45 else 0.35 end::double as confidence from (
      select d.src, d.dst, list_inner_product(a.embedding, b.embedding) as sim from direct d join corpus a on a.paper_id = d.src join corpus b on b.paper_id = d.dst)
    union all select src, dst, case when sim > 0.68 then 'supports' else 'mentions' end, case when sim > 0.68 then 0.52 else 0.45 end from (
      select e.src, e.dst, list_inner_product(a.embedding, b.embedding) as sim from citation_edges e join corpus a on a.paper_id = e.src join corpus b on b.paper_id = e.dst where e.etype = 'bib_coupling')""",
    "direct", "corpus", "citation_edges",
)
def annotated_citations(m: Model) -> DataFrame:
    """ITR-18, ITR-19: the kind of each citation edge, where no text mentions the cited title"""
    linked = F.col("ab") | F.col("ba")
    edge = lambda a, b, direct: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(direct).alias("direct"))
    coupled = F.when(~linked & F.col("shared").isNotNull(), F.array(edge("a", "b", False), edge("b", "a", False)))
    cited = F.array_compact(F.array(F.when(F.col("ab"), edge("a", "b", True)), F.when(F.col("ba"), edge("b", "a", True))))
    e = m.pairs("a", "b", "sim", "shared", "ab", "ba", threshold=None).select(F.explode(F.coalesce(coupled, cited)).alias("e"), "sim").select("e.*", "sim")
    direct, s = F.col("direct"), F.col("sim")
    limit = F.when(direct, 0.72).otherwise(0.68)
    confidence = F.when(direct, F.when(s > 0.72, 0.5).when(s > 0.45, 0.45).otherwise(0.35)).otherwise(F.when(s > 0.68, 0.52).otherwise(0.45))
    return e.select("src", "dst", F.when(s > limit, "supports").otherwise("mentions").alias("intent"), confidence.alias("confidence"))


@query(
    """select paper_id, coalesce(case when year between 1900 and 2030 then year end, case when try_cast(regexp_extract(substr(t, 1, 250), '\\((\\d{4})\\)', 1) as integer) between 1950 and 2030 then try_cast(regexp_extract(substr(t, 1, 250), '\\((\\d{4})\\)', 1) as integer) end, try_cast(regexp_extract(substr(t, 1, 300), '\\b(19[5-9]\\d|20[0-2]\\d)\\b', 1) as integer)) as year
    from (select paper_id, year, case when ordinal % 34 = 0 then 'First published (1987), ' when ordinal % 34 = 17 then 'Since 2003, ' else '' end || abstract as t from papers)""",
    "papers",
)
def resolved_years(m: Model) -> DataFrame:
    """SIG-30"""
    text = F.concat(F.when(F.pmod("ordinal", F.lit(34)) == 0, "First published (1987), ").when(F.pmod("ordinal", F.lit(34)) == 17, "Since 2003, ").otherwise(""), "abstract")
    return m.papers.select("paper_id", T.resolved_year(F.col("year"), text).alias("year"))


@query("select paper_id, case when n = '' then paper_id else n end || '_' || substr(paper_id, 1, 10) || '.pdf' as filename from (select paper_id, regexp_replace(trim(substr(regexp_replace(title, '[^A-Za-z0-9 _-]+', '', 'g'), 1, 80)), '\\s+', '_', 'g') as n from papers)", "papers")
def safe_filenames(m: Model) -> DataFrame:
    """STR-T18"""
    return m.papers.select("paper_id", T.safe_filename(F.col("title"), F.col("paper_id")).alias("filename"))


@query("select event_id, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%m-%dT%H:%M:%S') as stamp, strftime(cast(ts as date) - 30, '%Y-%m-%d') as since from events")
def date_stamps(m: Model) -> DataFrame:
    """STR-T18"""
    return m.table("events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"), F.date_format(F.date_sub(F.col("ts").cast("date"), 30), "yyyy-MM-dd").alias("since"))


@query("select paper_id, case when len(authors) > 1 then list_last(string_split(authors[1], ' ')) || ' et al.' when len(authors) = 1 then list_last(string_split(authors[1], ' ')) else 'the authors' end as author from papers", "papers")
def short_authors(m: Model) -> DataFrame:
    """STR-T14"""
    return m.papers.select("paper_id", T.short_author(F.col("authors")).alias("author"))


_SENTENCES = "list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


@query(f"select doc_id, len(s) as n, md5(array_to_string(s, '|')) as digest from (select doc_id, {_SENTENCES} as s from documents)")
def sentence_split(m: Model) -> DataFrame:
    """STR-T11: the sentences of every text"""
    s = T.sentences(F.col("text"))
    return m.table("documents").select("doc_id", F.size(s).cast("long").alias("n"), md5(F.array_join(s, "|")).alias("digest"))


_MARKED_AS = " or ".join(f"contains(lower(x), {_quote(p)})" for p in T.METADATA_MARKERS)
_PROSE = f"""length(x) >= 20 and length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) / length(x) >= 0.55::double and not ({_MARKED_AS}) and len(w) >= 5
      and len(list_filter(w, lambda y: length(y) > 12 and regexp_matches(substr(y, 2), '\\p{{Lu}}'))) <= greatest(1.0, len(w) * 0.25)
      and len(list_filter(w, lambda y: (length(y) > 15 and lower(y) = y and regexp_matches(y, '\\p{{L}}')) or (length(y) > 10 and contains(y, ',')))) = 0"""


@query(
    f"""cut as (select doc_id, unnest(s) as x, generate_subscripts(s, 1) as i from (select doc_id, {_SENTENCES} as s from documents)),
    told as (select doc_id, i, x, list_filter(string_split_regex(x, '\\s+'), lambda y: y <> '') as w from cut),
    kept as (select doc_id, list(x order by i) as s from told where {_PROSE} group by doc_id)
    select doc_id, coalesce(len(s), 0) as n, md5(coalesce(array_to_string(s, '|'), '')) as digest from documents left join kept using (doc_id) where text is not null"""
)
def readable_sentences(m: Model) -> DataFrame:
    """STR-T11: the sentences of every text that read as prose"""
    s = F.filter(T.sentences(F.col("text")), lambda s: T.readable(s))
    return m.table("documents").where("text is not null").select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), md5(F.array_join("s", "|")).alias("digest"))


_HEADS = ("Results suggest that the rate of change grows with the size of the group. ", "Cognition 91(2019)1437-1460 Contents lists available at ScienceDirect. ", "")
_blanked = lambda patterns, x: reduce(lambda t, p: f"regexp_replace({t}, {_quote(p)}, ' ', 'g')", patterns, x)
_REPAIRED = f"regexp_replace({_nested(T.MOJIBAKE + T.PLAIN_QUOTES, 'page')}, '[\\x{{80}}-\\x{{9f}}]', '', 'g')"
_DISPLAYED = f"trim(regexp_replace({_blanked(T.DISPLAY_NOISE, f'regexp_replace({_nested(T.LIGATURES, _REPAIRED)}, {_quote(T.CHARACTER_CODES)}, {_quote(str())}, {_quote(chr(103))})')}, '\\s{{2,}}', ' ', 'g'))"
_PAGES = f"select paper_id, title, {list(_HEADS)}[ordinal % 3 + 1] || regexp_replace(abstract, '[^ -~\\n]', '', 'g') as page from papers"


def _pages(m: Model) -> DataFrame:
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (F.pmod("ordinal", F.lit(3)) + 1).cast("int"))
    return m.papers.select("paper_id", "title", F.concat(head, F.regexp_replace("abstract", r"[^ -~\n]", "")).alias("page"))


@query(f"select paper_id, length(x) as n, md5(x) as digest from (select paper_id, {_DISPLAYED} as x from ({_PAGES}))", "papers")
def displayed_texts(m: Model) -> DataFrame:
    """STR-T11: the prose of texts with publishers' phrases; compared on ASCII, as word boundaries differ between engines"""
    return _pages(m).select("paper_id", T.displayed(F.col("page")).alias("x")).select("paper_id", F.length("x").cast("long").alias("n"), md5(F.col("x")).alias("digest"))


_JUNK = " or ".join(f"regexp_matches(y, {_quote(p)})" for p in T.CLAIM_JUNK)
_PLAUSIBLE = rf"""lambda y: length(y) >= 15 and not ({_JUNK}) and len(list_filter(string_split_regex(y, '\s+'), lambda z: length(z) > 25 and regexp_matches(z, '^-*\p{{L}}[\p{{L}}-]*$'))) = 0
      and length(y) - length(replace(y, ',', '')) <= greatest(2.0, len(list_filter(string_split_regex(y, '\s+'), lambda z: z <> '')) * 0.3)"""
_stripped = lambda x: f"regexp_replace({x}, {_quote(T.OUTER_SPACE)}, '', 'g')"
_TITLE = reduce(lambda t, p: _stripped(f"regexp_replace({t}, {_quote(p[0])}, {_quote(p[1])}, 'g')"), T.TITLE_CUTS, _stripped("title"))
_unmarked = lambda x: f"regexp_replace(lower({x}), {_quote(T.CLOSING_MARKS)}, '')"
_after = lambda s, openers, longest: f"list_transform(list_filter(list_transform(list_filter({s}, lambda y: regexp_matches(y, {_quote(openers)})), lambda y: substr(regexp_extract(y, {_quote(openers + '(?s:' + chr(92) + 's*(.*))')}, 1), 1, {longest})), lambda y: length(y) > 20), lambda y: {_unmarked('y')} || '...')"
_sentence = lambda x, least, longest: f"case when length(substr({x}, 1, {longest})) > {least} then {_unmarked(f'substr({x}, 1, {longest})')} end"


@query(
    f"""pages_ as ({_PAGES}), cut as (select paper_id, unnest(s) as x, generate_subscripts(s, 1) as i from (select paper_id, {_SENTENCES} as s from (select paper_id, {_DISPLAYED} as text from pages_))),
    told as (select paper_id, i, x, list_filter(string_split_regex(x, '\\s+'), lambda y: y <> '') as w from cut),
    kept as (select paper_id, list(x order by i) as s from told where {_PROSE} group by paper_id),
    titled as (select paper_id, case when length(t) > 90 then regexp_replace(substr(t, 1, 90), ' [^ ]*$', '') else t end as t from (select paper_id, {_TITLE} as t from pages_)),
    found as (select paper_id, t, list_filter(list_concat({_after('s', T.CLAIM_OPENERS, 110)}, list_filter([{_sentence('s[2]', 25, 110)}, {_sentence('s[1]', 20, 110)}], lambda y: y is not null)), {_PLAUSIBLE}) as c,
      list_filter(list_concat({_after('s[2:]', T.FINDING_OPENERS, 90)}, list_filter([{_sentence('s[-1]', 20, 90)}], lambda y: y is not null)), {_PLAUSIBLE}) as f from titled left join kept using (paper_id))
    select paper_id, coalesce(c[1], case when length(t) > 10 then lower(t) end, {_quote(T.NO_CLAIM)}) as claim, coalesce(f[1], case when length(t) > 10 then lower(t) end, {_quote(T.NO_FINDING)}) as finding from found""",
    "papers",
)
def claims_and_findings(m: Model) -> DataFrame:
    """STR-T12: what each paper claims and what it found"""
    told = _pages(m).select("paper_id", "title", T.prose(F.col("page")).alias("s"))
    return told.select("paper_id", T.main_claim(F.col("s"), F.col("title")).alias("claim"), T.key_finding(F.col("s"), F.col("title")).alias("finding"))


_TERMS = [w for w in QUESTION.split() if w not in T.STOP_WORDS]


@query(
    f"""cut as (select doc_id, unnest(s) as sentence, generate_subscripts(s, 1) as i from (select doc_id, {_SENTENCES} as s from documents)),
    shares as (select *, len(list_intersect(list_distinct(regexp_split_to_array(lower(sentence), '[^a-z0-9]+')), {_TERMS})) / {float(len(_TERMS))} as share from cut),
    best as (select * from shares qualify row_number() over (partition by doc_id order by share desc, i) = 1)
    select doc_id, case when share > 0.08 then sentence end as sentence from documents left join best using (doc_id)"""
)
def relevant_sentences(m: Model) -> DataFrame:
    """STR-T12: the sentence of each document that holds most of the question's words"""
    return m.table("documents").select("doc_id", T.relevant_sentence(F.col("text"), _TERMS).alias("sentence"))


@query(
    """words as (select distinct lower(w) as w from (select unnest(regexp_extract_all(title, '[A-Za-z]{4,}')) as w from corpus where source = 'seed'))
    select w as keyword from words where w not in ('from', 'with', 'into', 'that', 'this', 'these', 'those') qualify row_number() over (order by length(w) desc, w) <= 8""",
    "corpus",
)
def seed_keywords(m: Model) -> DataFrame:
    """ITR-20: eight keywords from the titles of seed papers"""
    words = m.corpus.where("source = 'seed'").select(F.explode(F.regexp_extract_all("title", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("w")).select(F.lower("w").alias("keyword")).distinct()
    return words.where(~F.col("keyword").isin("from", "with", "into", "that", "this", "these", "those")).orderBy(F.desc(F.length("keyword")), "keyword").limit(8)


@query("select item_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), ' ') as text from benchmark")
def inverted_abstracts(m: Model) -> DataFrame:
    """SRC-10: texts put back together from words and their positions"""
    words = m.table("benchmark").select("item_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("p", "w"))
    inverted = words.groupBy("item_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("inverted"))
    return inverted.select("item_id", T.inverted_to_text(F.col("inverted")).alias("text"))


@query("select page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as links, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '<[^>]+>', '', 'g')) as title from pages")
def page_links(m: Model) -> DataFrame:
    """SRC-11: tags stripped from marked-up text, and the links of every page"""
    title = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), "<[^>]+>", ""))
    return m.table("pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), title.alias("title"))


_MARKED = "case when doc_id % 2 = 0 then 'A title' || chr(10) || 'Abstract: ' || text || chr(10) || 'Keywords: one, two' else text end"
_CLEANED = lambda column: _CLEAN.replace("text", column)


@query(
    f"""marked as (select doc_id, {_MARKED} as t, regexp_extract({_MARKED}, '(?is)abstract[:\\s]+(.*?)\\n\\s*(?:introduction|keywords|1[.\\s]|background)', 1) as found from documents)
    select doc_id, md5(case when found <> '' then substr({_CLEANED('found')}, 1, 1200) else substr({_CLEANED('t')}, 1, 500) end) as abstract from marked"""
)
def abstracts(m: Model) -> DataFrame:
    """STR-T04: what a text says between the word abstract and its next section, or its beginning; half of the texts are marked"""
    marked = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.lit("A title\nAbstract: "), "text", F.lit("\nKeywords: one, two"))).otherwise(F.col("text"))
    return m.table("documents").select("doc_id", marked.alias("t")).select("doc_id", md5(T.abstract_of(F.col("t"))).alias("abstract"))
