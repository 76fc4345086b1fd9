"""Folds behind reports: audit flow, health of a metric series, ranking quality, moving averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.vectors import dot


def prisma(audit: DataFrame) -> DataFrame:
    """One row of flow counts from (event_id, ts, user_id, value, event, n); the latest screening of a paper decides."""
    of = lambda kind: F.col("event") == kind
    total = lambda kind: F.coalesce(F.sum(F.when(of(kind), F.col("n"))), F.lit(0))
    counts = audit.agg(
        F.count_if(of("search")).alias("n_searches"), total("search").alias("identified_search"), total("snowball").alias("identified_snowball"), total("watch_check").alias("identified_watch"),
        F.count_distinct(F.when(of("fulltext"), F.col("user_id"))).alias("fulltext_retrieved"),
    )
    latest = audit.where(of("screen")).groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    decisions = latest.agg(F.count("*").alias("screened"), F.count_if(F.col("v") >= 6).alias("included"), F.count_if(F.col("v") < 6).alias("excluded"))
    return counts.crossJoin(decisions)


def health(series: DataFrame, order: str, window: int = 8, low_limit: float = 0.35, drop_limit: float = -0.08) -> DataFrame:
    """Adds drift against the mean of the last ``window`` rows, and health by the number of broken limits.

    A snapshot series is short (one row a save); its window needs one order over all of it.
    """
    w = Window.orderBy(order).rowsBetween(-window, -1)
    drift = F.col("mean") - F.avg("mean").over(w)
    broken = F.col("_low") + F.col("_drop")
    out = series.withColumn("drift", drift).withColumn("_low", (F.col("low") > low_limit).cast("int")).withColumn("_drop", F.coalesce((F.col("drift") < drop_limit).cast("int"), F.lit(0)))
    return out.withColumn("health", F.when(broken >= 2, "risk").when(broken == 1, "watch").otherwise("good")).drop("_low", "_drop")


def leave_one_out(rated: DataFrame, liked: float = 7.0) -> DataFrame:
    """(paper_id, rating, score): likeness of each rated paper to the mean of the others liked, from 0 to 1.

    The sum over all liked papers is made once; a liked paper is taken out of it by subtraction.
    """
    sums = rated.where(F.col("rating") >= liked).select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    total = sums.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("total"))
    joined = rated.crossJoin(F.broadcast(total))
    others = F.when(F.col("rating") >= liked, F.zip_with("total", "embedding", lambda t, x: t - x)).otherwise(F.col("total"))
    scored = joined.withColumn("_o", others)
    cosine = dot("_o", "embedding") / F.sqrt(dot("_o", "_o"))
    return scored.select("paper_id", "rating", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine + 1) / 2)).alias("score"))


def alignment(scored: DataFrame, liked: float = 7.0, disliked: float = 3.0, most: int = 10) -> DataFrame:
    """One row: AUC by ranks (ties at half), precision and NDCG at k, correlation with the ratings.

    AUC needs no pairs: with average ranks among liked and disliked papers, U = sum of liked ranks - n(n+1)/2.
    """
    ends = scored.where((F.col("rating") >= liked) | (F.col("rating") <= disliked))
    by = ends.groupBy("score").agg(F.count("*").alias("n"), F.count_if(F.col("rating") >= liked).alias("p"))  # ties share a row
    w = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    u = ranked.agg(F.sum(F.col("p") * (F.col("below") + (F.col("n") + 1) / 2)).alias("r"), F.sum("p").alias("np"), F.sum(F.col("n") - F.col("p")).alias("nn"))
    auc = u.select(F.when((F.col("np") > 0) & (F.col("nn") > 0), (F.col("r") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nn"))).alias("auc"))
    counts = scored.agg(F.count("*").alias("rated"), F.count_if(F.col("rating") >= liked).alias("positives"), F.count_if(F.col("rating") <= disliked).alias("negatives"), F.corr("score", "rating").alias("rating_corr"))
    k = max(1, min(most, counts.first()["positives"]))
    from quillgraph.operators.ranking import top

    first = top(scored, [F.desc("score"), F.col("paper_id")], k)
    ideal = top(scored, [F.desc("rating"), F.desc("paper_id")], k)
    gain = lambda df: F.sum(F.col("rating") / F.log2(F.col("rank") + 1))
    at_k = first.agg((F.count_if(F.col("rating") >= liked) / F.count("*")).alias("precision_at_k"), gain(first).alias("dcg")).crossJoin(ideal.agg(gain(ideal).alias("idcg")))
    r4 = lambda c, n: F.round(c + 1e-9, 4).alias(n)
    return counts.crossJoin(auc).crossJoin(at_k).select(
        "rated", "positives", "negatives", r4(F.col("auc"), "auc"), r4(F.col("precision_at_k"), "precision_at_k"), r4(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")), "ndcg_at_k"), r4(F.col("rating_corr"), "rating_corr")
    )


def moving_average(scores: Column, rate: float = 0.2, floor: float = 0.05) -> Column:
    """From 1.0: w = max(floor, w (1 - rate) + 2 rate s / 20) over the scores (two marks of 1..10 summed) in order."""
    return F.aggregate(scores, F.lit(1.0), lambda w, s: F.greatest(F.lit(floor), w * (1 - rate) + 2 * rate * s / 20))
