"""Signal weights learned from ratings, their bootstrap ensemble, uncertainty, and parameter tuning."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.signals import SIGNAL_WEIGHTS, fused_score

MIN_RATINGS = 8
ENSEMBLE = 12
ENSEMBLE_RATINGS = 10
SEED = 12345
#: Ratings that a step of the fit takes at once.
FIT_ROWS = 65_536


def fit_weights(x: np.ndarray, y: np.ndarray, counts: np.ndarray | None = None, steps: int = 200, rate: float = 0.5, penalty: float = 0.1, floor: float = 0.05) -> np.ndarray:
    """Logistic regressions without intercept by plain gradient steps from ones; floored, scaled to the default budget.

    ``counts`` has a row for each fit: how often each rating counts in it. Without it there is one fit, of all ratings once.
    """
    times = np.ones((1, len(y))) if counts is None else counts
    share = times / times.sum(1, keepdims=True)
    w = np.ones((len(times), x.shape[1]))
    parts = [slice(at, at + FIT_ROWS) for at in range(0, len(y), FIT_ROWS)]
    for _ in range(steps):
        slope = penalty * w
        for p in parts:
            miss = 1 / (1 + np.exp(-np.clip(w @ x[p].T, -20, 20))) - y[p]
            slope += (share[:, p] * miss) @ x[p]
        w -= rate * slope
    w = np.maximum(w, floor)
    w *= sum(SIGNAL_WEIGHTS[: x.shape[1]]) / w.sum(1, keepdims=True)
    return w if counts is not None else w[0]


def ensemble(x: np.ndarray, y: np.ndarray, members: int = ENSEMBLE, seed: int = SEED) -> np.ndarray | None:
    """Weights of stratified bootstrap samples, as multinomial counts within the liked and the other papers; none for too few."""
    strata = [s for s in (y >= 0.5, y < 0.5) if s.sum() >= 2]
    if len(y) < ENSEMBLE_RATINGS or len(strata) < 2:
        return None
    rng = np.random.default_rng(seed)
    counts = np.zeros((members, len(y)))
    for s in strata:
        counts[:, s] = rng.multinomial(s.sum(), np.full(s.sum(), 1 / s.sum()), size=members)
    return fit_weights(x, y, counts)


def rated_matrix(signals: DataFrame, ratings: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signals, labels (7 and above) and ratings of all rated papers, in order of id; the driver gets columns, not a row object each."""
    found = signals.join(ratings.select("paper_id", "user_rating"), "paper_id").where("user_rating is not null").select("paper_id", "signals", F.col("user_rating").cast("double").alias("r"))
    rows = found.toArrow().sort_by("paper_id").combine_chunks()
    n, flat = rows.num_rows, pc.list_flatten(rows["signals"]).to_numpy()
    x, r = flat.reshape(n, len(flat) // n if n else len(SIGNAL_WEIGHTS)), rows["r"].to_numpy()
    return x, (r >= 7).astype(float), r


def auc(good: np.ndarray, bad: np.ndarray) -> float:
    """Share of the pairs in which the good one is ahead, ties half, by places among the sorted; 0 where a side is empty."""
    if not len(good) or not len(bad):
        return 0.0
    bad = np.sort(bad)
    ahead = int((np.searchsorted(bad, good) + np.searchsorted(bad, good, "right") - len(bad)).sum())
    return (ahead / (len(good) * len(bad)) + 1) / 2


def learned(signals: DataFrame, ratings: DataFrame) -> tuple[np.ndarray | None, np.ndarray | None]:
    """(weights, ensemble), or none where there are too few ratings, liked papers (7 up) or disliked ones (4 down)."""
    x, y, r = rated_matrix(signals, ratings)
    if len(y) < MIN_RATINGS or (r >= 7).sum() < 2 or (r <= 4).sum() < 2:
        return None, None
    return fit_weights(x, y), ensemble(x, y)


def uncertainty(signals: DataFrame, weights: np.ndarray, members: np.ndarray | None) -> DataFrame:
    """(paper_id, score, sigma, acquisition): fused score, its spread over the ensemble, and the worth of asking for a rating."""
    of = lambda w: fused_score(F.col("signals"), F.col("mask"), F.array(*[F.lit(float(v)) for v in w]))
    df = signals.withColumn("score", of(weights))
    if members is None:
        df = df.withColumn("sigma", F.lit(0.0))
    else:
        scores = F.array(*[of(w) for w in members])
        n = float(len(members))
        df = df.withColumn("_s", scores).withColumn("_m", F.aggregate("_s", F.lit(0.0), lambda a, v: a + v) / n)
        df = df.withColumn("sigma", F.sqrt(F.aggregate("_s", F.lit(0.0), lambda a, v: a + (v - F.col("_m")) * (v - F.col("_m"))) / n))
    return df.select("paper_id", "score", "sigma", (F.col("sigma") * F.sqrt(F.greatest("score", F.lit(0.0)))).alias("acquisition"))


def tune(evaluate: Callable[[Mapping[str, float]], tuple[float, float | None]], bounds: Mapping[str, tuple[float, float, float]], start: Mapping[str, float], rounds: int = 20, seed: int = 7, margin: float = 0.003) -> tuple[dict[str, float], list[dict]]:
    """Perturb one parameter a round, in turn; keep a change that gains more than ``margin`` in training and loses no more in validation.

    ``bounds``: low, high, largest step. ``evaluate`` gives (training, validation or none). Returns the best values and the log.
    """
    rng = np.random.default_rng(seed)
    best, log = dict(start), []
    train, held = evaluate(best)
    names = sorted(bounds)
    for i in range(rounds):
        name = names[i % len(names)]
        low, high, step = bounds[name]
        trial = best | {name: float(np.clip(best[name] + rng.uniform(-step, step), low, high))}
        t, v = evaluate(trial)
        kept = t > train + margin and (v is None or held is None or v >= held - margin)
        log.append({"round": i + 1, "parameter": name, "value": trial[name], "train": t, "validation": v, "kept": kept})
        if kept:
            best, train, held = trial, t, v
    return best, log


def feedback(edges: DataFrame, papers: DataFrame, shown: DataFrame, rating: float, least: float = 0.30) -> tuple[DataFrame, DataFrame]:
    """Edges and weights after a rated query: (src, dst, weight, etype) and (paper_id, weight).

    From 7 up, edges among the shown papers gain a tenth of the boost, missing ones are made where the papers are
    alike, and the first five unrated papers gain weight; from 3 down, the first five lose some.
    """
    from quillgraph.functions.vectors import dot

    weights = papers.select("paper_id", "weight", "user_rating").join(F.broadcast(shown.select("paper_id", "rank")), "paper_id", "left")
    first = F.col("rank") <= 5
    if rating >= 7:
        boost = (rating - 6) * 0.5
        own = papers.select("paper_id", "embedding").join(F.broadcast(shown.select("paper_id", "rank")), "paper_id")
        a, b = (own.select(F.col("paper_id").alias(p), F.col("rank").alias(f"r{p}"), F.col("embedding").alias(f"v{p}")) for p in ("src", "dst"))
        pairs = a.crossJoin(F.broadcast(b)).where("rsrc < rdst").select("src", "dst", dot("vsrc", "vdst").alias("sim"))
        joined = edges.join(pairs, ["src", "dst"], "full_outer")
        known = F.col("weight").isNotNull()
        new = F.when(known & F.col("sim").isNotNull(), F.least(F.lit(1.0), F.col("weight") + boost * 0.1)).when(known, F.col("weight")).otherwise(F.col("sim"))
        edges = joined.where(known | (F.col("sim") > least)).select("src", "dst", new.alias("weight"), F.when(known, F.col("etype")).otherwise("interest").alias("etype"))
        changed = F.when(first & F.col("user_rating").isNull(), F.least(F.lit(10.0), F.col("weight") + boost * 0.2)).otherwise(F.col("weight"))
    elif rating <= 3:
        changed = F.when(first, F.greatest(F.lit(1.0), F.col("weight") - (4 - rating) * 0.2)).otherwise(F.col("weight"))
    else:
        changed = F.col("weight")
    return edges, weights.select("paper_id", changed.alias("weight"))
