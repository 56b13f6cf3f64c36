"""Texts cut off by field limits or in transfer, and how often each source cuts.

Per source a right-censored log-normal distribution of the lengths is fitted by maximum likelihood. Lengths at which far
more values lie than the fit allows are candidate limits; a value there is censored with a posterior probability, a value
elsewhere with the rate of other cuts. The posteriors are used twice. They teach what an ending weighs: texts at limits are
mostly cut, the others mostly not, so the log odds of every degree of ending evidence follow from how often it stands among
both (expectation maximisation over a histogram of bounded size). And they are the prior odds of each text, unclipped, to
which its ending's log odds are added.

Defined cases: null and blank texts are complete; a text that ends as only complete ones do is complete, at a limit too; a
null source is a source of its own; sources with fewer than MIN_FIT texts get no limits, only the common rate; where no source
has a limit, nothing teaches the weights and only sure marks of a cut count (SURE_EVIDENCE); repeated texts are judged each; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.endings import with_endings
from driftloom.llm.textunits import is_blank
from driftloom.session import broadcast_if_small, cut_lineage

MIN_FIT, FIT_ROUNDS = 20, 12
#: Share of cut texts away from any limit, to begin with.
OTHER_CUTS = 0.03
#: Degrees of ending evidence: bins of this width between these ends. Rounds of the estimate, and texts each degree has from the start.
DEGREE, LEAST_DEGREE, MOST_DEGREE = 1.0, -8, 13
WEIGHT_ROUNDS, WEIGHT_START = 20, 0.5
#: Evidence that needs no limit to be believed: notes, open ends, ends inside markup.
SURE_EVIDENCE, SURE_WEIGHT = 7, 9.0
#: A candidate limit holds at least so many values and so many times those expected around it.
LIMIT_VALUES, LIMIT_RATIO = 5, 4.0


def _normal(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Density and upper tail of the standard normal distribution."""
    from math import erfc

    return np.exp(-(z**2) / 2) / np.sqrt(2 * np.pi), np.array([max(erfc(x / np.sqrt(2)) / 2, 1e-12) for x in z])


def censored_fit(lengths: np.ndarray, counts: np.ndarray) -> list[tuple[int, float]]:
    """(limit, posterior probability that a value of that length was cut) from a histogram of lengths.

    EM for a right-censored log-normal: values at a limit are a mixture of uncensored ones, as the density says, and
    censored ones, which count with the moments of the tail beyond the limit.
    """
    x, n = np.log(lengths.astype(float)), counts.astype(float)
    if n.sum() < MIN_FIT:
        return []
    # a first sight of the spikes: against the mean count of the lengths within 5 %
    around = np.array([n[(lengths > v * 0.95) & (lengths < v * 1.05) & (lengths != v)].sum() / max(2, 0.1 * v) for v in lengths[n >= LIMIT_VALUES]])
    spikes = lengths[n >= LIMIT_VALUES][n[n >= LIMIT_VALUES] > LIMIT_RATIO * np.maximum(around, 0.5)]
    post = np.where(np.isin(lengths, spikes), 0.9, 0.0)
    for _ in range(FIT_ROUNDS):
        if not n.sum():
            break
        whole, part = n * (1 - post), n * post
        mu = sigma = None
        m1, m2 = (whole * x).sum(), (whole * x**2).sum()
        if _ == 0:
            mu, sigma = np.average(x, weights=n), max(np.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n)), 1e-3)
        else:
            at = part > 0
            pdf, tail = _normal((x[at] - state[0]) / state[1])
            hazard, z = pdf / tail, (x[at] - state[0]) / state[1]
            e1 = state[0] + state[1] * hazard
            e2 = state[0] ** 2 + 2 * state[0] * state[1] * hazard + state[1] ** 2 * (1 + z * hazard)
            m1, m2 = m1 + (part[at] * e1).sum(), m2 + (part[at] * e2).sum()
            mu = m1 / n.sum()
            sigma = max(np.sqrt(max(m2 / n.sum() - mu**2, 0)), 1e-3)
        state = (mu, sigma)
        pdf, _tail = _normal((x - mu) / sigma)
        expected = n.sum() * pdf / (sigma * lengths)
        post = np.where(np.isin(lengths, spikes), np.clip(1 - expected / n, 0.0, 0.999), 0.0)
    return [(int(v), float(p)) for v, p in zip(lengths, post) if p > 0.5]


def limit_posteriors(texts: DataFrame, text: str, source: str) -> DataFrame:
    """(source, length, posterior) of each source's candidate limits. A group holds one row per length of the source.

    Repeated texts count once: they would look like limits.
    """
    return _fit_limits(texts.where(~is_blank(F.col(text))).select(F.col(source).alias("source"), F.length(text).alias("length"), F.xxhash64(text).alias("same")))


def _fit_limits(sizes: DataFrame) -> DataFrame:
    """From (source, length, same)."""
    histogram = sizes.select("source", "length", "same").distinct().groupBy("source", "length").agg(F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("length")
        found = censored_fit(pdf["length"].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame({"source": pd.Series([pdf["source"].iloc[0]] * len(found), dtype=object), "length": [v for v, _ in found], "posterior": [p for _, p in found]})

    return histogram.groupBy("source").applyInPandas(fit, "source string, length int, posterior double")


def ending_weights(counts: list[tuple[int, float | None, bool, int]]) -> tuple[dict[int, float], float]:
    """(log odds of a cut by degree of evidence, rate of cuts away from limits) from (degree, posterior or None, complete, texts).

    Begins with what the limits alone say; texts that end as only complete ones do are whole at any length. Log odds never
    fall with the evidence.
    """
    degrees = np.arange(LEAST_DEGREE, MOST_DEGREE + 1)
    if not any(p is not None for _, p, _, _ in counts):
        return {int(d): 30.0 if d >= SURE_EVIDENCE else -30.0 for d in degrees}, 0.5
    at, free, whole = (np.array([x(c) for c in counts]) for x in (lambda c: c[0] - LEAST_DEGREE, lambda c: c[1] is None, lambda c: c[2]))
    n = np.array([c[3] for c in counts], dtype=float)
    fixed = np.array([0.0 if p is None else min(max(p, 1e-6), 1 - 1e-6) for _, p, _, _ in counts])
    rate, weight = OTHER_CUTS, np.zeros(len(degrees))
    for _ in range(WEIGHT_ROUNDS):
        prior = np.where(free, rate, fixed)
        cut = np.where(whole, 0.0, 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + weight[at]))))
        among_cut, among_whole = (np.bincount(at, weights=n * x, minlength=len(degrees)) + WEIGHT_START for x in (cut, 1 - cut))
        weight = _rising(np.log(among_cut / among_cut.sum()) - np.log(among_whole / among_whole.sum()), among_cut + among_whole)
        rate = min(max((n * cut)[free].sum() / max(n[free].sum(), 1), 1e-4), 0.5)
    # sure marks stand away from limits too, where nothing teaches them
    return {int(d): float(max(w, SURE_WEIGHT) if d >= SURE_EVIDENCE else w) for d, w in zip(degrees, weight)}, float(rate)


def _rising(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The closest values that never fall: neighbours that do are averaged."""
    parts: list[list[float]] = []
    for v, s in zip(values, sizes):
        parts.append([v, s, 1])
        while len(parts) > 1 and parts[-2][0] > parts[-1][0]:
            (a, x, i), (b, y, j) = parts[-2:]
            parts[-2:] = [[(a * x + b * y) / (x + y), x + y, i + j]]
    return np.concatenate([np.full(int(k), v) for v, _, k in parts])


def judge(texts: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, length, limit_posterior, cut_probability, cut_evidence) of every non-blank text. ``key`` must be unique."""
    # the texts are read twice, for their endings and for the counts; all else needs their sizes only
    evidence = with_endings(texts, key, text).withColumnRenamed(key, "_key")
    own = cut_lineage(texts.select(F.col(key), F.col(source).alias("source")).join(evidence, F.col(key) == F.col("_key")).drop("_key"))
    limits = broadcast_if_small(cut_lineage(_fit_limits(own).withColumnRenamed("source", "_s").withColumnRenamed("length", "_l")))
    prior = own.join(limits, F.col("source").eqNullSafe(F.col("_s")) & (F.col("length") == F.col("_l")), "left").drop("_s", "_l")
    degree = F.greatest(F.least(F.round(F.col("cut_evidence") / DEGREE), F.lit(MOST_DEGREE)), F.lit(LEAST_DEGREE)).cast("int")
    both = prior.withColumn("_degree", degree)
    counts = both.groupBy("_degree", F.round("posterior", 2).alias("p"), "complete").agg(F.count("*").alias("n")).collect()  # degrees times 101 times 2 at most
    weights, rate = ending_weights([(r["_degree"], r["p"], r["complete"], r["n"]) for r in counts])
    weight = F.element_at(F.array(*(F.lit(weights[d]) for d in sorted(weights))), F.col("_degree") - LEAST_DEGREE + 1)
    p = F.coalesce("posterior", F.lit(rate))
    probability = F.when(F.col("complete"), 0.0).otherwise(F.round(1 / (1 + F.exp(-(F.log(p / (1 - p)) + weight))), 6))
    return both.select(key, "source", "length", F.col("posterior").alias("limit_posterior"), probability.alias("cut_probability"), "cut_evidence")


def cut_texts(texts: DataFrame, key: str, text: str, source: str) -> DataFrame:
    return judge(texts, key, text, source).where("cut_probability > 0.5")


def cut_report(texts: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Per source: documents (blank ones included), cut documents, their share, and those cut at a limit."""
    judged = judge(texts, key, text, source).withColumn("_cut", F.col("cut_probability") > 0.5)
    cuts = judged.groupBy("source").agg(F.count_if("_cut").alias("cut"), F.count_if(F.col("_cut") & F.col("limit_posterior").isNotNull()).alias("cut_at_limit"))
    whole = texts.groupBy(F.col(source).alias("_s")).agg(F.count("*").alias("documents"))
    both = whole.join(cuts, F.col("_s").eqNullSafe(F.col("source")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select(F.col("_s").alias("source"), "documents", zero("cut").alias("cut"), zero("cut_at_limit").alias("cut_at_limit"), F.round(zero("cut") / F.col("documents"), 6).alias("cut_share"))
