"""Signals that need the corpus: similarities to contexts and clusters, coupling, section and network signals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import signals as S
from quillgraph.functions.store import small
from quillgraph.functions.vectors import dot, mean_pool
from quillgraph.operators import layers

#: Vectors of a block of ``top_similar``, about, and those that are compared with the other block at once.
BLOCK_ROWS, ASKED_ROWS = 6_144, 512


def context_similarity(candidates: DataFrame, context: DataFrame) -> DataFrame:
    """(paper_id, context): cosine with the one-row context vector."""
    return candidates.select("paper_id", "embedding").crossJoin(F.broadcast(context)).select("paper_id", dot("embedding", "context").alias("context"))


def cluster_similarity(candidates: DataFrame, clusters: DataFrame) -> DataFrame:
    """(paper_id, niche, area): best cosine with weighted level-1 centroids, and with those above."""
    weighted = small(clusters.where("weight > 0").select("level", "centroid"), 4096)
    sims = candidates.select("paper_id", "embedding").crossJoin(weighted).select("paper_id", "level", dot("embedding", "centroid").alias("sim"))
    best = lambda test, name: F.coalesce(F.max(F.when(test, F.col("sim"))), F.lit(0.0)).alias(name)
    return sims.groupBy("paper_id").agg(best(F.col("level") == 1, "niche"), best(F.col("level") >= 2, "area"))


def citation_signal(candidates: DataFrame, corpus: DataFrame, refs: DataFrame) -> DataFrame:
    """(paper_id, citation): mean over coupled weighted papers of coupling x weight / 10 x the weaker list's support."""
    support = refs.groupBy(F.col("paper_id").alias("id")).agg(F.count_distinct("source").alias("k")).select("id", S.source_support(F.col("k")).alias("support"))
    asked = candidates.select(F.col("paper_id").alias("id")).join(support, "id")
    known = corpus.where("weight > 0").select(F.col("paper_id").alias("id"), (F.col("weight") / 10.0).alias("part")).join(support, "id")
    scores = layers.coupled_means(asked, known, refs).select(F.col("id").alias("paper_id"), F.col("mean").alias("citation"))
    return candidates.select("paper_id").join(scores, "paper_id", "left").select("paper_id", F.coalesce("citation", F.lit(0.0)).alias("citation"))


def favourites_similarity(candidates: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """(paper_id, snf): mean cosine with the first k papers of weight 6 or more, in order of arrival."""
    first = corpus.where("weight >= 6").orderBy("ordinal").limit(k).select(F.col("embedding").alias("other"))
    sims = candidates.select("paper_id", "embedding").join(F.broadcast(first), F.lit(True), "left")
    return sims.groupBy("paper_id").agg(F.coalesce(F.avg(dot("embedding", "other")), F.lit(0.0)).alias("snf"))


def section_contexts(sections: DataFrame, as_of: float) -> DataFrame:
    """(section_type, pooled): what the user likes in each kind of section, by rating and its decay."""
    liked = sections.where("user_rating >= 5").withColumn("w", F.col("user_rating") * S.temporal_decay(F.col("rated_at"), as_of))
    return mean_pool(liked, "vector", "w", ["section_type"])


def section_signals(sections: DataFrame, contexts: DataFrame) -> DataFrame:
    """(paper_id, one column a scored section type): cosine with the user's context; null where either is missing."""
    sims = sections.join(F.broadcast(contexts), "section_type").select("paper_id", "section_type", dot("vector", "pooled").alias("sim"))
    return sims.groupBy("paper_id").agg(*[F.max(F.when(F.col("section_type") == t, F.col("sim"))).alias(t) for t in S.SECTION_TYPES])


def equation_signal(equations: DataFrame, wanted: DataFrame, as_of: float) -> DataFrame:
    """(paper_id, equation): cosine of the wanted papers' equations with the user's; null where either is missing."""
    liked = equations.where("user_rating >= 5").withColumn("w", F.col("user_rating") * S.temporal_decay(F.col("rated_at"), as_of))
    context = mean_pool(liked, "vector", "w")
    own = equations.join(wanted.select("paper_id"), "paper_id", "left_semi")
    return own.crossJoin(F.broadcast(context)).select("paper_id", dot("vector", "pooled").alias("equation"))


def network_signal(candidates: DataFrame, corpus: DataFrame, mass: DataFrame, k: int = 10) -> DataFrame:
    """(paper_id, ppr): similarity-weighted network mass of the k most alike corpus papers of positive similarity."""
    own = mass.select(F.col("id").alias("other"), "mass")
    known = corpus.select(F.col("paper_id").alias("other"), F.col("embedding").alias("v")).join(own, "other", "left_semi")
    near = top_similar(candidates, known, k).join(own, "other")
    return candidates.select("paper_id").join(near.groupBy("paper_id").agg((F.sum(F.col("sim") * F.col("mass")) / F.sum("sim")).alias("ppr")), "paper_id", "left").select("paper_id", F.coalesce("ppr", F.lit(0.0)).alias("ppr"))


def top_similar(candidates: DataFrame, known: DataFrame, k: int, positive: bool = True) -> DataFrame:
    """(paper_id, other, sim, rank): the k rows of ``known`` (other, v) most alike each candidate, ties to the smaller id.

    Both sides are dealt into blocks by a hash of the id, and every pair of blocks meets in one task as two matrices,
    which hands on k rows a candidate: nothing holds all pairs. Null vectors take no part, and vectors of different
    lengths do not meet. Products are added dimension by dimension, as ``dot`` adds them, so equal vectors tie.
    """
    left = candidates.select(F.col("paper_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("v is not null")
    right = known.select(F.col("other").cast("string").alias("id"), F.col("v").cast("array<double>").alias("v")).where("v is not null and id is not null")
    blocks = [max(1, -(-df.count() // BLOCK_ROWS)) for df in (left, right)]
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = left.select(F.lit(True).alias("asked"), "id", "v", F.size("v").alias("d"), deal(blocks[0]).alias("x"), every(blocks[1]).alias("y"))
    there = right.select(F.lit(False).alias("asked"), "id", "v", F.size("v").alias("d"), deal(blocks[1]).alias("y"), every(blocks[0]).alias("x"))

    def best(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        asked = table["asked"].to_numpy()
        ids = np.array(table["id"].to_pylist(), object)
        v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), table["d"][0].as_py())
        a, b = v[asked], v[~asked]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for low in range(0, len(a), ASKED_ROWS):
            rows, places, values = _nearest(a[low : low + ASKED_ROWS], b, k)
            found.append((rows + low, places, values))
        rows, places, values = (np.concatenate(x) for x in zip(*found))
        keep = values > 0 if positive else ~np.isnan(values)
        return pa.table([pa.array(ids[asked][rows[keep]], pa.string()), pa.array(ids[~asked][places[keep]], pa.string()), pa.array(values[keep])], names=["paper_id", "other", "sim"])

    found = asked.unionByName(there).groupBy("x", "y", "d").applyInArrow(best, "paper_id string, other string, sim double")
    w = Window.partitionBy("paper_id").orderBy(F.desc("sim"), "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, product): for each row of a the k largest products, largest first, ties to the earlier row of b.

    A matrix product, which may be off by rounding, finds who can be among the k; only their products are added up
    dimension by dimension.
    """
    rough = a @ b.T
    if len(b) > k and np.isfinite(rough).all():
        rounding = 4 * (a.shape[1] + 1) * np.finfo(float).eps * np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max()
        least = np.partition(rough, len(b) - k, axis=1)[:, len(b) - k]
        rows, places = np.nonzero(rough >= (least - rounding)[:, None])
    else:
        rows, places = np.divmod(np.arange(rough.size), max(len(b), 1))
    sims = np.zeros(len(rows))
    for i in range(a.shape[1]):
        sims += a[rows, i] * b[places, i]
    order = np.lexsort((places, -sims, rows))  # places without a number come last
    rows, places, sims = rows[order], places[order], sims[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[first], places[first], sims[first]


def novelty(candidates: DataFrame, corpus: DataFrame, clusters: DataFrame) -> DataFrame:
    """(paper_id, novelty): one minus the mean of the three best cosines with papers and centroids."""
    known = corpus.select(F.col("paper_id").alias("other"), F.col("embedding").alias("v")).unionByName(clusters.select(F.col("cluster_id").alias("other"), F.col("centroid").alias("v")))
    return top_similar(candidates, known, 3, positive=False).groupBy("paper_id").agg((1 - F.avg("sim")).alias("novelty"))


def unseen(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """Candidates whose id and trimmed lower-case title the corpus does not have."""
    title = lambda c: F.trim(F.lower(c))
    fresh = candidates.join(corpus.select("paper_id"), "paper_id", "left_anti")
    return fresh.join(corpus.select(title(F.col("title")).alias("_t")).distinct(), title(F.col("title")) == F.col("_t"), "left_anti")


def cold_start(candidates: DataFrame, corpus: DataFrame, context: DataFrame, now_year: int) -> DataFrame:
    """(paper_id, score) for small corpora: context, every weighted paper, recency and quality, weighted."""
    others = small(corpus.where("weight > 0").select(F.col("embedding").alias("v"), "weight"))
    sums = candidates.select("paper_id", "embedding").join(others, F.lit(True), "left").groupBy("paper_id").agg(F.sum(dot("embedding", "v") * F.col("weight") / 5.0).alias("top"), F.sum(F.col("weight") / 5.0).alias("total"))
    near = context_similarity(candidates, context)
    age = F.when(F.col("year").isNull(), F.lit(0.0)).otherwise(F.lit(0.5))
    top = F.coalesce("top", F.lit(0.0)) + 4.0 * F.col("context") + age * S.recency(F.col("year"), now_year) + 0.3 * S.publication_quality(F.col("is_peer_reviewed"))
    total = F.coalesce("total", F.lit(0.0)) + 4.0 + age + 0.3
    joined = candidates.select("paper_id", "year", "is_peer_reviewed").join(near, "paper_id").join(sums, "paper_id")
    return joined.select("paper_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), top / total)).alias("score"))


def signal_table(model, wanted: DataFrame, now_year: int, as_of: float, mass: DataFrame) -> DataFrame:
    """(paper_id, signals, mask): the fourteen signals of the wanted papers and which of them each can supply."""
    parts = [
        context_similarity(wanted, model.context), cluster_similarity(wanted, model.clusters), citation_signal(wanted, model.known, model.refs),
        favourites_similarity(wanted, model.known), network_signal(wanted, model.known, mass),
    ]
    sections = model.sections.join(wanted.select("paper_id"), "paper_id", "left_semi")
    optional = [section_signals(sections, section_contexts(model.sections.where("role = 'corpus'"), as_of)), equation_signal(model.equations, wanted, as_of)]
    df = wanted.select("paper_id", "year", "is_peer_reviewed", "cited_by_count")
    for p in parts:
        df = df.join(p, "paper_id")
    for p in optional:
        df = df.join(p, "paper_id", "left")
    df = df.withColumn("quality", S.publication_quality(F.col("is_peer_reviewed"))).withColumn("recency", S.recency(F.col("year"), now_year)).withColumn("impact", S.impact(F.col("cited_by_count"), F.col("year"), now_year))
    maskable = (*S.SECTION_TYPES, "impact", "equation")
    value = lambda n: F.coalesce(n, F.lit(0.0)) if n in maskable else F.col(n)
    flag: dict[str, Column] = {n: F.when(F.col(n).isNull(), 0.0).otherwise(1.0) for n in maskable}
    return df.select("paper_id", F.array(*[value(n) for n in S.SIGNALS]).alias("signals"), F.array(*[flag.get(n, F.lit(1.0)) for n in S.SIGNALS]).alias("mask"))


def fused(signals: DataFrame, weights: tuple[float, ...] = S.SIGNAL_WEIGHTS) -> DataFrame:
    return signals.withColumn("score", S.fused_score(F.col("signals"), F.col("mask"), F.array(*[F.lit(float(w)) for w in weights])))


def coverage_gaps(clusters: DataFrame, few: int = 1) -> DataFrame:
    """Level-1 clusters without liked papers, or with no more than ``few`` among four and more."""
    return clusters.where(f"level = 1 and ((size >= 2 and high = 0) or (size >= 4 and high <= {few}))")


def exploration_ratio(corpus: DataFrame, membership: DataFrame, base: float = 0.25, cold: int = 15) -> DataFrame:
    """One row (ratio): how much of a slate goes to exploration, by corpus size and the entropy of ratings over niches."""
    rated = corpus.where("user_rating is not null").join(membership.where("level = 1"), "paper_id").groupBy("cluster_id").agg(F.count("*").alias("c"))
    p = F.col("c") / F.col("t")
    spread = rated.crossJoin(F.broadcast(rated.agg(F.sum("c").alias("t")))).agg(F.count("*").alias("k"), F.coalesce(F.max("t"), F.lit(0)).alias("n_rated"), (-F.sum(p * F.log(p + 1e-10))).alias("entropy"))
    sizes = corpus.agg(F.count("*").alias("n")).crossJoin(membership.where("level = 1").agg(F.count_distinct("cluster_id").alias("niches")))
    diversity = F.col("entropy") / F.log(F.col("k") + 1e-10)
    ratio = (
        F.when(F.col("n") < cold, F.least(F.lit(0.4), F.lit(base * 1.6)))
        .when(F.col("niches") <= 1, F.least(F.lit(0.4), F.lit(base * 1.5)))
        .when((F.col("k") >= 2) & (F.col("n_rated") >= 10), F.greatest(F.lit(0.1), F.least(F.lit(0.4), base * (1.5 - diversity))))
        .otherwise(F.lit(base))
    )
    return sizes.crossJoin(spread).select(ratio.alias("ratio"))
