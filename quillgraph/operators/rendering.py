"""Texts made from results: review scaffolds, digests, argument templates, facts for a language model. One row a line or item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T


def lines(parts: list[DataFrame]) -> DataFrame:
    """(position, line) of parts that each hold (order, line); parts follow each other."""
    out = None
    for i, p in enumerate(parts):
        df = p.select(F.struct(F.lit(i).alias("part"), F.col("order").cast("string").alias("order")).alias("position"), "line")
        out = df if out is None else out.unionByName(df)
    return out


def review_scaffold(review: DataFrame, keys: DataFrame, themes: DataFrame) -> DataFrame:
    """Markdown of a review: a heading for each theme, its numbers, and its papers by year and title."""
    spark = review.sparkSession
    head = spark.createDataFrame([("0", "# Literature review")], "order string, line string")
    told = F.concat(F.lit("## "), "theme", F.lit(" ("), F.col("n").cast("string"), F.lit(" papers, "), F.col("n_rated").cast("string"), F.lit(" rated)"))
    sections = themes.select(F.concat("theme", F.lit("/0")).alias("order"), told.alias("line"))
    cited = F.concat(F.lit("- "), "title", F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit(") [@"), "cite_key", F.lit("]"))
    items = review.join(keys, "paper_id").select(F.concat("niche", F.lit("/1/"), F.coalesce("year", F.lit(0)).cast("string"), F.lit("/"), "title", F.lit("/"), "paper_id").alias("order"), cited.alias("line"))
    return lines([head, sections.unionByName(items)])


def digest(found: DataFrame) -> DataFrame:
    """Markdown of what watches kept: (watch, token, title, score) under a heading for each watch, best first."""
    head = found.groupBy("watch").agg(F.count("*").alias("n")).select(F.concat("watch", F.lit("/0")).alias("order"), F.concat(F.lit("## "), "watch", F.lit(" ("), F.col("n").cast("string"), F.lit(" kept)")).alias("line"))
    rank = F.row_number().over(Window.partitionBy("watch").orderBy(F.desc("score"), "token"))
    items = found.withColumn("rn", rank).select(F.concat("watch", F.lit("/1/"), F.lpad(F.col("rn").cast("string"), 9, "0")).alias("order"), F.concat(F.lit("- **"), "title", F.lit("** — "), F.round("score", 3).cast("string")).alias("line"))
    return lines([head.unionByName(items)])


def feasible_arguments(shown: DataFrame, connections: DataFrame) -> DataFrame:
    """(kind, feasible): which kinds of argument the shown papers can carry."""
    facts = shown.agg(F.count("*").alias("n"), (F.max("year") - F.min("year")).alias("span")).crossJoin(connections.agg(F.count_if(F.col("kind") == "edge").alias("edges"), F.count_if(F.col("kind") == "niche").alias("niches")))
    rules = (("evolution", (F.col("n") >= 2) & (F.col("span") >= 5)), ("convergence", (F.col("n") >= 2) & (F.col("edges") >= 1)), ("tension", F.col("n") >= 2), ("gap", F.col("n") >= 1), ("synthesis", (F.col("n") >= 3) & (F.col("niches") >= 1)))
    return facts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(c, F.lit(False)).alias("feasible")) for k, c in rules])).alias("r")).select("r.*")


def arguments(query: str, shown: DataFrame, connections: DataFrame, seed: int = 7, n: int = 3) -> DataFrame:
    """(kind, weight, text): up to n feasible kinds, drawn without replacement by weights that the query's intent raises.

    The draw is the largest key u^(1/weight) over a hash of seed and kind, so it is the same each time.
    """
    boosts = T.intent_boosts(F.lit(query))
    u = (F.pmod(F.xxhash64(F.lit(seed), "kind"), F.lit(1 << 30)) + 1) / float(1 << 30)
    drawn = feasible_arguments(shown, connections).where("feasible").withColumn("weight", F.coalesce(boosts[F.col("kind")], F.lit(1.0)))
    drawn = drawn.withColumn("draw", F.pow(u, 1 / F.col("weight"))).orderBy(F.desc("draw"), "kind").limit(n)
    ends = shown.agg(F.min_by("title", F.struct("rank")).alias("best"), F.min_by("title", F.struct("year", "rank")).alias("oldest"), F.max_by("title", F.struct("year", "rank")).alias("newest"), F.min("year").alias("y0"), F.max("year").alias("y1"))
    y = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("n.d."))
    text = (
        F.when(F.col("kind") == "evolution", F.concat(F.lit("From “"), "oldest", F.lit("” ("), y("y0"), F.lit(") to “"), "newest", F.lit("” ("), y("y1"), F.lit("), the question has shifted.")))
        .when(F.col("kind") == "convergence", F.concat(F.lit("Linked studies around “"), "best", F.lit("” point the same way.")))
        .when(F.col("kind") == "tension", F.concat(F.lit("“"), "best", F.lit("” and “"), "newest", F.lit("” need not agree.")))
        .when(F.col("kind") == "gap", F.concat(F.lit("What “"), "best", F.lit("” leaves open remains unstudied here.")))
        .otherwise(F.concat(F.lit("Together, work from “"), "oldest", F.lit("” on forms one account.")))
    )
    return drawn.crossJoin(F.broadcast(ends)).select("kind", "weight", text.alias("text"))


def passes_gate(text: Column) -> Column:
    """Whether a written argument may stand: long enough, two sentences or more, and with a year or a surname in brackets."""
    return (F.length(text) >= 80) & (F.size(T.sentences(text)) >= 2) & text.rlike(r"\b(19|20)\d{2}\b|\([A-Z][a-z]+")


def context_facts(shown: DataFrame, causal: DataFrame, members: DataFrame, first: int = 5) -> DataFrame:
    """(kind, line): what a language model is told about the first papers: lines, influences, shared niches."""
    top = shown.where(F.col("rank") <= first).select("paper_id", "title", "year", "rank")
    papers = top.select(F.lit("paper").alias("kind"), F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title", F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit(")")).alias("line"))
    end = lambda name: F.broadcast(top.select(F.col("paper_id").alias(name), F.col("rank").alias(f"r_{name}")))
    influence = causal.join(end("src"), "src").join(end("dst"), "dst").select(F.lit("influence").alias("kind"), F.concat(F.lit("["), F.col("r_src").cast("string"), F.lit("] INFLUENCED ["), F.col("r_dst").cast("string"), F.lit("] "), F.round("confidence", 2).cast("string")).alias("line"))
    niche = members.where("level = 1").join(F.broadcast(top), "paper_id").groupBy("cluster_id").agg(F.sort_array(F.collect_list("rank")).alias("rs")).where(F.size("rs") > 1)
    groups = niche.select(F.lit("niche").alias("kind"), F.concat("cluster_id", F.lit(": "), F.array_join(F.transform("rs", lambda r: r.cast("string")), ", ")).alias("line"))
    return papers.unionByName(influence).unionByName(groups)


def theme_phrase(text: Column, most: int = 4) -> Column:
    """The longest run of words between stop words, the first of equals."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+"), lambda w: w != "")
    marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(*T.STOP_WORDS), "|").otherwise(w)), " ")
    runs = F.transform(F.split(marked, r"\|"), lambda r: F.trim(r))
    size = lambda r: F.when(r == "", 0).otherwise(F.size(F.split(r, " ")))
    best = F.array_max(F.transform(runs, lambda r, i: F.struct(size(r).alias("n"), (-i).alias("place"), r.alias("run"))))
    return F.array_join(F.slice(F.split(best["run"], " "), 1, most), " ")


def guessed_title(text: Column) -> Column:
    """The first of a text's 30 first lines that reads like a title."""
    s = F.trim
    letters = lambda l: F.length(F.regexp_replace(l, r"[^\p{L}]", ""))
    fine = lambda l: F.length(s(l)).between(15, 250) & ~s(l).startswith("http") & ~((F.length(s(l)) < 60) & (letters(s(l)) < F.length(s(l)) * 0.5)) & ~((F.upper(s(l)) == s(l)) & (F.length(s(l)) < 40))
    all_lines = F.split(text, "\n")
    plain = F.get(F.filter(F.slice(all_lines, 1, 10), lambda l: (F.length(s(l)) > 10) & (F.length(s(l)) < 250)), F.lit(0))
    return s(F.coalesce(F.get(F.filter(F.slice(all_lines, 1, 30), fine), F.lit(0)), plain, F.get(all_lines, F.lit(0))))
