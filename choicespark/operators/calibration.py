"""Calibration of simulated decisions to a target reroute rate.

A decision leaves the usual route when the delay override applies or when another route's utility is
ahead of it.  Both conditions are thresholds: the override applies where a row's keyed draw is below
the override probability, and another route is ahead where the decision margin exceeds the inertia (a
utility added to the usual route).  So the rate is a monotone function of either knob, given by the
distribution of the draws or of the margins, and the knob that yields a wanted number of reroutes
is a quantile of it.  The quantile is exact, so the rate is met to one decision (ties apart); the
rows are decided once more with the knobs, not adjusted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicespark import config as cfg
from choicespark.operators.aggregates import exact_quantiles
from choicespark.operators.choice import decide_rows, decision_margins
from choicespark.session import cut_lineage


@dataclass(frozen=True)
class Calibration:
    """The knobs, and the reroute counts before and after."""

    force_prob: float
    inertia: float
    total: int
    reroutes_before: int
    reroutes_after: int


def _threshold(values: DataFrame, col: str, n: int, below: int) -> float:
    """A number with ``below`` of the ``n`` values under it: half-way between two neighbours in order."""
    if below <= 0:
        return float("-inf")
    if below >= n:
        return float("inf")
    return exact_quantiles(values, col, [(below - 0.5) / (n - 1)])[0]


def calibrate(rows: DataFrame, target: float | None = None, lo: float = cfg.TARGET_REROUTE_RATE[0], hi: float = cfg.TARGET_REROUTE_RATE[1],
              force_prob: float = cfg.FORCE_REROUTE_PROB, noisy: bool = True, seed: int = cfg.SEED) -> Calibration:
    """Knobs that bring the reroute rate of ``rows`` to ``target``.

    Without a target the rate stays when it lies in [lo, hi], and goes to the middle of the range
    otherwise.  The override probability is moved first, as far as it reaches; inertia does the rest.
    """
    m = cut_lineage(decision_margins(rows, noisy, seed), "margins")  # three numbers a decision, read a few times
    ahead = F.coalesce(F.col("margin") > 0, F.lit(False))
    forced = F.col("eligible") & (F.col("draw") < force_prob)
    c = m.agg(F.count(F.lit(1)).alias("n"), F.count_if(ahead | forced).alias("now"), F.count_if(ahead).alias("ahead"),
              F.count_if(F.col("eligible") & ~ahead).alias("open")).first()
    n, now = c["n"], c["now"]
    if not n or (target is None and lo <= now / n <= hi):
        return Calibration(force_prob, 0.0, n, now, now)
    wanted = int(n * (target if target is not None else (lo + hi) / 2) + 0.5)
    if c["ahead"] <= wanted <= c["ahead"] + c["open"]:  # the override alone
        q = _threshold(m.filter(F.col("eligible") & ~ahead), "draw", c["open"], wanted - c["ahead"])
        return Calibration(min(1.0, max(0.0, q)), 0.0, n, now, wanted)
    prob = 0.0 if wanted < c["ahead"] else 1.0
    rest = m.filter(~(F.col("eligible") & (F.col("draw") < prob)) & F.col("margin").isNotNull())
    k = rest.count()
    fixed = m.filter(F.col("eligible") & (F.col("draw") < prob)).count()
    above = min(k, max(0, wanted - fixed))
    x = _threshold(rest, "margin", k, k - above)
    return Calibration(prob, x, n, now, fixed + above)


def decide_calibrated(rows: DataFrame, target: float | None = None, noisy: bool = True, seed: int = cfg.SEED, **limits) -> tuple[DataFrame, Calibration]:
    """The decisions of ``rows`` under calibrated knobs, and the knobs."""
    found = calibrate(rows, target, noisy=noisy, seed=seed, **limits)
    return decide_rows(rows, noisy, seed, found.force_prob, found.inertia), found
