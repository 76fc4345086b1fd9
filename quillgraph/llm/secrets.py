"""Secret scans by a trigram inverted index, in DataFrame functions only.

From each rule's regex a Boolean query over lower-cased trigrams is derived that every match satisfies. The index holds
postings for the trigrams that some query names: documents fall into slots by a hash of their key, and a slot has one
posting list a trigram. Queries are answered slot by slot, AND by intersecting lists, OR by uniting them. The regex
then runs only over the candidates it was given; a rule without mandatory trigrams runs over every text.

The candidates are a written table. It is broadcast when it has at most BROADCAST_ROWS rows, and otherwise joined by
a shuffle.

Positions are code points: the pieces between matches and the matches themselves are measured and summed up.

Defined results: a null or empty text has no spans; rows without doc_id are scanned like others and keep their null;
rows that share a doc_id share candidates, but each is verified on its own text; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import table, written

# Patterns of the base, fixed by the query's contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]+)"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is read alike by Java and Python; matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


RULES = (
    Rule("assign", ASSIGN, 2, 8, base=True),
    Rule("access", ACCESS, 1, 16, base=True),
    Rule("hex", HEX, 1, 32, base=True),
    Rule("github", r"(gh[pousr]_[A-Za-z0-9]{36,})"),
    Rule("slack", r"(xox[abprs]-[0-9A-Za-z-]{10,})"),
    Rule("google", r"(AIza[0-9A-Za-z_-]{35})"),
    Rule("stripe", r"([sr]k_live_[0-9A-Za-z]{16,})"),
    Rule("npm", r"(npm_[A-Za-z0-9]{36})"),
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    Rule("pem", r"(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)"),
    Rule("url", r"([A-Za-z][A-Za-z0-9+.-]{1,16}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@)"),
)
#: Documents in a slot, about.
SLOT_ROWS = 2_000
BROADCAST_ROWS = 500_000
#: Strings that a part of a regex may stand for, at most; beyond, the part counts as anything.
MOST_STRINGS = 64

# A query is True (anything matches), a trigram, or ("and" | "or", parts).


def _both(parts):
    flat = []
    for p in parts:
        if p is True:
            continue
        flat += p[1] if isinstance(p, tuple) and p[0] == "and" else [p]
    flat = list(dict.fromkeys(flat))
    return True if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _either(parts):
    if any(p is True for p in parts):
        return True
    # A part that asks for more than another one adds nothing.
    asked = {p: set(p[1]) if isinstance(p, tuple) and p[0] == "and" else {p} for p in dict.fromkeys(parts)}
    parts = [p for p in asked if not any(asked[q] < asked[p] for q in asked)]
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]):
    """One of these strings occurs."""
    return _either([_both([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def trigram_query(pattern: str):
    """The Boolean trigram query that the lower-cased text of every match satisfies."""
    parser = re._parser

    def sequence(items) -> tuple[set[str] | None, object]:
        """The strings that the items stand for (None: too many to tell), and what else must hold."""
        exact: set[str] | None = {""}
        runs, told = [{""}], []
        for op, arg in items:
            strings, more = one(str(op), arg)
            told.append(more)
            if strings is None:
                exact = None
                runs.append({""})
                continue
            joined = {a + b for a, b in product(runs[-1], strings)}
            if len(joined) > MOST_STRINGS:
                exact = None
                runs.append(strings)
            else:
                runs[-1] = joined
                exact = joined if exact is not None else None
        if exact is not None:
            return exact, _both(told)
        return None, _both(told + [_of_strings(r) for r in runs])

    def one(op: str, arg) -> tuple[set[str] | None, object]:
        if op == "LITERAL":
            return {chr(arg).lower()}, True
        if op == "AT":
            return {""}, True
        if op == "SUBPATTERN":
            return sequence(arg[3])
        if op == "IN":
            found = set()
            for kind, x in arg:
                if str(kind) == "LITERAL":
                    found.add(chr(x).lower())
                elif str(kind) == "RANGE" and x[1] - x[0] < MOST_STRINGS:
                    found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None, True
            return (found, True) if len(found) <= 8 else (None, True)
        if op == "BRANCH":
            got = [sequence(x) for x in arg[1]]
            if all(s is not None for s, _ in got) and len(u := set().union(*(s for s, _ in got))) <= MOST_STRINGS:
                return u, True
            return None, _either([q if s is None else _both([q, _of_strings(s)]) for s, q in got])
        if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, item = arg
            strings, more = sequence(item)
            if least == 0:
                return (strings | {""}, True) if int(most) == 1 and strings is not None and more is True else (None, True)
            if least == most and int(least) <= 4 and strings is not None and len(strings) ** int(least) <= MOST_STRINGS:
                return {"".join(p) for p in product(strings, repeat=int(least))}, more
            return None, more if strings is None else _both([more, _of_strings(strings)])
        return None, True

    strings, query = sequence(parser.parse(pattern))
    return query if strings is None else _both([query, _of_strings(strings)])


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _key() -> Column:
    """Rows without doc_id share a key; a document of that number is at worst verified for nothing."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))


def index(docs: DataFrame, names: list[str], slots: int) -> DataFrame:
    """One row a slot; column t<i> is the posting list of ``names[i]``: distinct keys of the documents that contain it."""
    low = F.lower("text")
    flags = docs.select(_key().alias("key"), "text").select(
        F.pmod(F.xxhash64("key"), F.lit(slots)).alias("slot"), "key", *[F.contains(low, F.lit(t)).alias(f"t{i}") for i, t in enumerate(names)]
    )
    return flags.groupBy("slot").agg(*[F.collect_set(F.when(F.col(f"t{i}"), F.col("key"))).alias(f"t{i}") for i in range(len(names))])


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules): the documents that each rule's query finds, and by which rules."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not True}
    names = sorted(set().union(*map(trigrams, queries.values())) if queries else set())
    if not names:
        return docs.sparkSession.createDataFrame([], "key long, rules array<string>")
    slots = max(1, -(-docs.select("doc_id").count() // SLOT_ROWS))

    def answer(query) -> Column:
        if isinstance(query, str):
            return F.col(f"t{names.index(query)}")
        out = answer(query[1][0])
        for part in query[1][1:]:
            out = (F.array_intersect if query[0] == "and" else F.array_union)(out, answer(part))
        return out

    postings = index(docs.select("doc_id", "text"), names, slots)
    hits = postings.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), answer(q).alias("keys")) for k, q in queries.items()])).alias("h"))
    return hits.select("h.rule", F.explode("h.keys").alias("key")).groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _spans(rule: Rule, order: int) -> Column:
    """Struct (start, kind, stop) of every match that is long enough."""
    pattern = F.lit(rule.pattern)
    text = F.col("text")
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = F.transform(F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("hit"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part")), lambda x: F.struct(F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("hit"), F.length(x["part"]).alias("part")))
    empty = F.expr("cast(array() as array<struct<start: bigint, kind: int, stop: bigint>>)")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        stop = begin + F.coalesce(x["hit"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(order).alias("kind"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(x["part"] >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(measured, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a document: (doc_id, found), the spans of all rules as structs (start, kind, stop) by start, then kind."""
    found = written(candidates(docs, rules), "candidates")
    few = found.count() <= BROADCAST_ROWS
    rows = docs.select(F.col("doc_id").cast("long"), _key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(found) if few else found, "key", "left")
    parts = []
    for i, rule in enumerate(rules):
        # The trigram query is necessary, a plain search for a long enough run is, too, and cheap.
        if trigram_query(rule.pattern) is True:
            runs = re.fullmatch(r"\((\[[^]]+\])\+\)", rule.pattern)
            named = F.col("text").rlike(f"{runs[1]}{{{rule.least}}}") if runs else F.lit(True)
        else:
            named = F.array_contains("rules", rule.kind)
        parts.append(F.when(named, _spans(rule, i)))
    none = F.expr("cast(array() as array<struct<start: bigint, kind: int, stop: bigint>>)")
    return rows.select("doc_id", F.array_sort(F.concat(*[F.coalesce(p, none) for p in parts])).alias("found"))


def _rendered(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))))


def detect(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a document: counts and digest of the base spans, and all spans."""
    base = [i for i, r in enumerate(rules) if r.base]
    count = lambda i: F.size(F.filter("found", lambda s: s["kind"] == i)).cast("long").alias(f"n_{rules[i].kind}")
    return scan(docs, rules).select("doc_id", *map(count, base), F.sha2(_rendered(F.filter("found", lambda s: s["kind"].isin(base)), rules), 256).alias("base_sha256"), _rendered(F.col("found"), rules).alias("spans"))


def op3_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    parts = []
    for i, r in enumerate(RULES):
        p = quoted(r.pattern)
        parts.append(
            f"select row, {i} as kind, '{r.kind}' as name, gaps, hits, parts, {r.least} as least from (select row, regexp_split_to_array(text, {p}) as gaps,"
            f" regexp_extract_all(text, {p}) as hits, regexp_extract_all(text, {p}, {r.group}) as parts from docs) where len(hits) > 0"
        )
    base = ",".join(str(i) for i, r in enumerate(RULES) if r.base)
    counts = ", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in RULES if r.base)
    counted = ", ".join(f"cast(count(*) filter (kind = {i}) as bigint) as n_{r.kind}" for i, r in enumerate(RULES) if r.base)
    return f"""
with docs as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
found as ({" union all ".join(parts)}),
listed as (
  select row, kind, name, least, unnest(generate_series(1, len(hits))) as i, gaps, hits, parts from found
),
measured as (
  select row, kind, name, least, length(parts[i]) as part, length(hits[i]) as hit,
    sum(length(gaps[i]) + length(hits[i])) over (partition by row, kind order by i) as stop
  from listed
),
spans as (select row, kind, name, cast(stop - hit as bigint) as start, cast(stop as bigint) as stop from measured where part >= least),
told as (
  select row, {counted},
    string_agg(name || ':' || start || ':' || stop, ',' order by start, kind, stop) as spans,
    string_agg(name || ':' || start || ':' || stop, ',' order by start, kind, stop) filter (kind in ({base})) as base
  from spans group by row
)
select doc_id, {counts}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join told using (row)
"""


QUERIES = {"op3_secret_spans": op3_secret_spans}
ORACLES = {"op3_secret_spans": _oracle()}
