"""Scalar scoring signals of papers, as column expressions. The clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Values that define the scores, fixed by the semantics that the queries reproduce.
DEFAULT_WEIGHT = 5.0
HALF_LIFE_DAYS = 90.0
DECAY_FLOOR = 0.25
ABSTRACT_DISCOUNT = 0.7
RRF_K = 60
RRF_SOURCES = 4
RRF_BLEND = 0.15
IMPACT_SATURATION = 50
SIGNALS = ("context", "niche", "area", "citation", "snf", "quality", "recency", "methods", "results", "discussion", "introduction", "ppr", "impact", "equation")
SIGNAL_WEIGHTS = (3.0, 2.0, 1.0, 2.0, 1.5, 0.5, 0.3, 1.2, 0.8, 0.6, 0.5, 1.5, 0.5, 0.8)
SECTION_TYPES = ("methods", "results", "discussion", "introduction")


def coerced_year(year: Column) -> Column:
    """The first four characters as a year from 1000 to 2100, else null."""
    y = F.substring(F.trim(year.cast("string")), 1, 4).try_cast("int")
    return F.when(y.between(1000, 2100), y)


def peer_review(arxiv_id: Column, doi: Column, venue: Column) -> Column:
    """False for preprints, true with a DOI alone, null when neither can be told. Empty strings mean unknown."""
    low = F.lower(venue)
    return (
        F.when((arxiv_id != "") & (doi == ""), F.lit(False))
        .when(low.contains("arxiv") | low.contains("preprint"), F.lit(False))
        .when((doi != "") & (arxiv_id == ""), F.lit(True))
    )


def publication_quality(is_peer_reviewed: Column) -> Column:
    return F.when(is_peer_reviewed, F.lit(1.0)).when(~is_peer_reviewed, F.lit(0.3)).otherwise(F.lit(0.5))


def temporal_decay(rated_at: Column, as_of: float) -> Column:
    """2^(-age / half life), not under the floor; 1 for papers never rated."""
    days = (F.lit(float(as_of)) - rated_at) / 86400.0
    return F.when(rated_at <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(DECAY_FLOOR), F.pow(F.lit(2.0), -days / HALF_LIFE_DAYS)))


def evidence_factor(source: Column, has_full_text: Column) -> Column:
    return F.when(has_full_text, F.lit(1.0)).when(source == "scout", F.lit(ABSTRACT_DISCOUNT)).otherwise(F.lit(1.0))


def effective_weight(rating: Column, source: Column, decay: Column, evidence: Column) -> Column:
    return F.when(rating.isNotNull(), rating * decay * evidence).when(source == "seed", F.lit(DEFAULT_WEIGHT)).otherwise(F.lit(0.0))


def recency(year: Column, now_year: int) -> Column:
    return F.when(year.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0), F.lit(now_year) - year) / 20.0))


def impact(cited_by: Column, year: Column, now_year: int) -> Column:
    """Citations a year on a log scale, saturating; null without a count."""
    age = F.greatest(F.lit(0.5), (F.lit(now_year) - F.coalesce(year, F.lit(now_year))).cast("double"))
    rate = F.log1p(F.greatest(F.lit(0.0), cited_by.cast("double")) / age) / F.log1p(F.lit(float(IMPACT_SATURATION)))
    return F.when(cited_by.isNotNull(), F.least(F.lit(1.0), rate))


def reciprocal_rank_fusion(ranks: Column) -> Column:
    """``ranks``: array of 0-based ranks, one a source; against the best that four sources can give."""
    total = F.aggregate(ranks, F.lit(0.0), lambda s, r: s + 1.0 / (F.lit(RRF_K + 1) + r))
    return F.least(F.lit(1.0), total / (RRF_SOURCES / (RRF_K + 1)))


def blended(score: Column, rrf: Column, times_shown: Column, hyde: Column | None = None) -> Column:
    """Relevance with hypothetical-document similarity, rank fusion and the penalty for papers shown before."""
    rel = score if hyde is None else F.when(hyde.isNull(), score).otherwise(score * 0.6 + F.greatest(F.lit(0.0), hyde) * 0.4)
    rel = F.when(rrf > 0, rel * (1 - RRF_BLEND) + rrf * RRF_BLEND).otherwise(rel)
    return F.when(times_shown > 0, rel / (1.0 + times_shown * 0.15)).otherwise(rel)


def fused_score(signals: Column, mask: Column, weights: Column) -> Column:
    """Masked weighted mean of the signals, clipped to 0..1; masked signals leave both sums."""
    masked = F.zip_with(weights, mask, lambda w, m: w * m)
    top = F.aggregate(F.zip_with(signals, masked, lambda s, w: s * w), F.lit(0.0), lambda a, x: a + x)
    total = F.aggregate(masked, F.lit(0.0), lambda a, x: a + x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), top / F.when(total == 0, F.lit(1.0)).otherwise(total)))


def metadata_quality(doi: Column, s2_id: Column, year: Column, abstract: Column, n_authors: Column, title: Column) -> Column:
    points = [(doi != "", 0.25), (s2_id != "", 0.2), (year.between(1900, 2030), 0.15), (F.length(abstract) > 50, 0.2), (n_authors > 0, 0.1), (F.length(title) > 10, 0.1)]
    return sum((F.when(c, F.lit(p)).otherwise(F.lit(0.0)) for c, p in points), F.lit(0.0))


def source_support(n_sources: Column) -> Column:
    """Confidence in a reference list by the number of sources that gave it; none counts as one."""
    return F.when(n_sources >= 3, F.lit(1.0)).when(n_sources == 2, F.lit(0.8)).otherwise(F.lit(0.55))


def edge_confidence(n_a: Column, n_b: Column, base: Column) -> Column:
    n = F.least(n_a, n_b)
    return F.least(F.lit(1.0), base * F.when(n >= 3, F.lit(1.5)).when(n >= 2, F.lit(1.3)).otherwise(F.lit(1.0)))


def screen_decision(rating: Column) -> Column:
    return F.when(rating.isNull(), F.lit("skipped")).when(rating >= 6, F.lit("included")).otherwise(F.lit("excluded"))


def is_due(enabled: Column, last_run: Column, interval_hours: Column, now: float) -> Column:
    return enabled & ((F.lit(float(now)) - last_run) >= F.greatest(F.lit(1.0), interval_hours) * 3600.0)


def linear_fusion(semantic: Column, citation: Column, alpha: float = 0.6) -> Column:
    return semantic * alpha + citation * (1 - alpha)
