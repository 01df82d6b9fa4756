"""Choice scoring: utility, Gumbel noise, arg-max, threshold override, reasons.

Two physical shapes share the same expressions:

* **array path** – a scenario row carries its alternatives in ``routes``; the
  decision is a per-row expression (no shuffle).
* **long path** – one row per (scenario, alternative); the decision is one
  ``groupBy(scenario)`` whose aggregates (``max`` / ``min`` of structs) are
  partially aggregated map-side, so the shuffle moves at most one row per
  scenario per map task, whatever the number of alternatives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicespark import config as cfg
from choicespark.functions import draws as D
from choicespark.functions.text import fragments, int_text


def uncertainty_cost(level: Column) -> Column:
    expr = None
    for k, v in cfg.UNCERTAINTY_COST.items():
        expr = F.when(level == k, F.lit(float(v))) if expr is None else expr.when(level == k, F.lit(float(v)))
    return expr.otherwise(F.lit(0.0))


def utility(time: Column, delay: Column, level: Column, familiarity: Column, meeting: Column,
            time_sensitivity: Column, risk_aversion: Column, familiar_pref: Column) -> Column:
    """Linear utility of one alternative (C1); a missing factor counts as 0."""
    boost = F.when(F.coalesce(meeting, F.lit(False)), F.lit(cfg.MEETING_BOOST)).otherwise(F.lit(1.0))
    ts = F.coalesce(time_sensitivity, F.lit(0.0))
    ra = F.coalesce(risk_aversion, F.lit(0.0))
    fp = F.coalesce(familiar_pref, F.lit(0.0))
    time_cost = F.lit(cfg.W_TIME) * time.cast("double") * boost
    delay_pen = F.lit(cfg.W_DELAY) * ts * delay.cast("double") * boost
    unc_pen = F.lit(cfg.W_UNCERTAINTY) * ra * uncertainty_cost(level)
    fam_bonus = F.lit(cfg.W_FAMILIARITY) * fp * familiarity
    return time_cost + delay_pen + unc_pen + fam_bonus


def noise(key: Column, route_id: Column, seed: int = cfg.SEED, scale: float = cfg.GUMBEL_SCALE) -> Column:
    """Gumbel(0, scale) noise keyed by (scenario, alternative)."""
    return D.gumbel(seed, "gumbel", F.concat_ws("|", key.cast("string"), route_id.cast("string")), scale)


def force_uniform(key: Column, seed: int = cfg.SEED) -> Column:
    return D.uniform(seed, "force_reroute", key)


def force_draw(key: Column, seed: int = cfg.SEED, prob: float = cfg.FORCE_REROUTE_PROB) -> Column:
    """Bernoulli(0.85) for the threshold override."""
    return force_uniform(key, seed) < F.lit(float(prob))


# FIXED VALUES: the fragments of the next function must equal the texts being reproduced.

def reasoning_text(a_delay: Column, tolerance: Column, ts: Column, ra: Column, fp: Column, meeting: Column,
                   chosen: Column, a_time: Column, chosen_time: Column) -> Column:
    """Reasons joined by ``"; "``."""
    saved = a_time - chosen_time
    parts = [
        F.when(a_delay > tolerance, "delay exceeds tolerance threshold")
        .when(a_delay > 5, "moderate delay on usual route"),
        F.when(ts > 0.5, "time-sensitive"),
        F.when(ra > 0.5, "risk-averse (prefer predictability)"),
        F.when(fp > 0.5, "prefer familiar routes"),
        F.when(F.coalesce(meeting, F.lit(False)), "urgent meeting"),
        F.when(chosen != "A", F.when(saved > 0, F.concat(F.lit("saves "), int_text(saved), F.lit(" minutes")))
               .otherwise("avoids uncertainty")).otherwise("within tolerance"),
    ]
    return fragments("; ", parts, "balanced choice")


def decide(scen: DataFrame, personas: DataFrame, noisy: bool = True, seed: int = cfg.SEED) -> DataFrame:
    """Array path (C1–C4) for separately supplied tables: scenarios ⋈ personas → decisions.

    Personas are joined by key (J2); Spark/AQE picks a broadcast when the
    persona side is measured small and a shuffle join otherwise.
    """
    p = personas.select("persona_id", "delay_tolerance_planned", "preference_factors")
    rows = decide_rows(scen.join(p, "persona_id", "inner"), noisy, seed)
    return rows.select("scenario_id", "persona_id", "chosen_route", "reroute", "reasoning", "utility_scores",
                       "overridden")


def _with_scores(rows: DataFrame, noisy: bool, seed: int, inertia: float) -> DataFrame:
    """``_scores``: utility, position and id of every route; ``inertia`` is added to the usual route A."""
    ts = F.col("preference_factors.time_sensitivity")
    ra = F.col("preference_factors.risk_aversion")
    fp = F.col("preference_factors.familiar_route_preference")
    meeting = F.col("context.has_important_meeting")
    key = F.col("scenario_id")

    def score(r: Column, i: Column) -> Column:
        u = utility(r.getField("current_travel_time"), r.getField("current_delay"), r.getField("uncertainty_level"),
                    r.getField("familiarity"), meeting, ts, ra, fp)
        if noisy:
            u = u + noise(key, r.getField("id"), seed)
        if inertia:
            u = u + F.when(i == 0, F.lit(float(inertia))).otherwise(F.lit(0.0))
        return F.struct(u.alias("u"), (-i).alias("neg_pos"), r.getField("id").alias("id"))

    return rows.withColumn("_scores", F.transform("routes", score))


def _least_delay() -> Column:
    """Id of the route with the least delay; ties go to the first."""
    return F.array_min(F.transform(
        "routes", lambda r, i: F.struct(r.getField("current_delay").alias("d"), i.alias("pos"), r.getField("id").alias("id"))
    )).getField("id")


def _tolerance() -> Column:
    return F.coalesce(F.col("delay_tolerance_planned"), F.lit(10))


def decide_rows(rows: DataFrame, noisy: bool = True, seed: int = cfg.SEED, force_prob: float = cfg.FORCE_REROUTE_PROB,
                inertia: float = 0.0) -> DataFrame:
    """Add the decision columns to rows that carry scenario and persona columns (no join, no shuffle).

    ``force_prob`` and ``inertia`` (utility added to the usual route) are what :mod:`calibration` solves for.
    """
    ts = F.col("preference_factors.time_sensitivity")
    ra = F.col("preference_factors.risk_aversion")
    fp = F.col("preference_factors.familiar_route_preference")
    meeting = F.col("context.has_important_meeting")
    key = F.col("scenario_id")
    staged = _with_scores(rows, noisy, seed, inertia)
    a = F.col("routes")[0]
    best = F.array_max("_scores").getField("id")
    least_delay, tol = _least_delay(), _tolerance()
    override = (a.getField("current_delay") > tol) & force_draw(key, seed, force_prob) & (least_delay != "A")
    staged = staged.withColumns({"overridden": override, "chosen_route": F.when(override, least_delay).otherwise(best)})
    chosen_time = F.filter("routes", lambda r: r.getField("id") == F.col("chosen_route"))[0].getField(
        "current_travel_time")
    return staged.withColumns({
        "reroute": F.col("chosen_route") != "A",
        "reasoning": reasoning_text(a.getField("current_delay"), tol, ts, ra, fp, meeting, F.col("chosen_route"),
                                    a.getField("current_travel_time"), chosen_time),
        "utility_scores": F.map_from_arrays(F.transform("_scores", lambda s: s.getField("id")),
                                            F.transform("_scores", lambda s: s.getField("u"))),
    }).drop("_scores")


def decision_margins(rows: DataFrame, noisy: bool = True, seed: int = cfg.SEED) -> DataFrame:
    """What decides each row: ``margin`` (best other utility less the usual route's, null without another route),
    ``eligible`` (the delay override may apply) and ``draw`` (it does where this is below its probability)."""
    staged = _with_scores(rows, noisy, seed, 0.0)
    usual = F.filter("_scores", lambda s: s.getField("neg_pos") == 0)[0].getField("u")
    other = F.array_max(F.transform(F.filter("_scores", lambda s: s.getField("neg_pos") != 0), lambda s: s.getField("u")))
    eligible = (F.col("routes")[0].getField("current_delay") > _tolerance()) & (_least_delay() != "A")
    return staged.select("scenario_id", (other - usual).alias("margin"), F.coalesce(eligible, F.lit(False)).alias("eligible"),
                         force_uniform(F.col("scenario_id"), seed).alias("draw"))


def decide_long(alts: DataFrame, key: str = "scenario_id", noisy: bool = True, seed: int = cfg.SEED) -> DataFrame:
    """Long path (C1–C4, W4, W5): one row per alternative → one decision per scenario.

    Expected columns: ``key, alt_id, alt_pos, time, delay, uncertainty_level,
    familiarity, meeting, time_sensitivity, risk_aversion, familiar_pref, tolerance``.
    ``alt_pos`` orders alternatives (lowest = the usual one); utility ties go to
    the lower position, then the larger ``alt_id``; delay ties to the lower
    position.  Grouping is on ``key`` itself, so when the input was joined on
    ``key`` the aggregate reuses that hash partitioning (no extra exchange).
    """
    scored = alts.withColumn("utility", utility_of(key, noisy, seed))
    agg = scored.groupBy(key).agg(
        F.max(F.struct("utility", (-F.col("alt_pos")).alias("neg_pos"), "alt_id", "time")).alias("best"),
        F.min(F.struct("delay", "alt_pos", "alt_id")).alias("least_delay"),
        F.min(F.struct("alt_pos", "alt_id", "delay", "time", "tolerance")).alias("usual"),
        F.count(F.lit(1)).alias("n_alternatives"),
    )
    usual = F.col("usual")
    override = ((usual.getField("delay") > usual.getField("tolerance")) & force_draw(F.col(key), seed)
                & (F.col("least_delay.alt_id") != usual.getField("alt_id")))
    chosen_id = F.when(override, F.col("least_delay.alt_id")).otherwise(F.col("best.alt_id"))
    return agg.select(
        key, "n_alternatives",
        chosen_id.alias("chosen_alt"),
        (chosen_id != usual.getField("alt_id")).alias("reroute"),
        override.alias("overridden"),
        F.col("best.utility").alias("best_utility"),
    )


def utility_of(key: str = "scenario_id", noisy: bool = True, seed: int = cfg.SEED) -> Column:
    u = utility(F.col("time"), F.col("delay"), F.col("uncertainty_level"), F.col("familiarity"), F.col("meeting"),
                F.col("time_sensitivity"), F.col("risk_aversion"), F.col("familiar_pref"))
    if noisy:
        u = u + noise(F.col(key), F.col("alt_id"), seed)
    return u


def argmax_choice(alts: DataFrame, key: str = "scenario_id", score: str = "utility") -> DataFrame:
    """The alternative with the highest score per scenario; ties go to the first position, then the larger id."""
    best = alts.groupBy(key).agg(F.max(F.struct(score, (-F.col("alt_pos")).alias("neg_pos"), "alt_id")).alias("b"))
    return best.select(key, F.col("b.alt_id").alias("best_alt"))


def route_distribution(dec: DataFrame, route: str = "chosen_route") -> DataFrame:
    """Decisions and share per chosen route (A4)."""
    from choicespark.operators.aggregates import shares

    return shares(dec.groupBy(route).agg(F.count(F.lit(1)).alias("count")))


def preference_consistency(dec: DataFrame, score: Column, reroute: str = "reroute", cut: float = 0.5) -> DataFrame:
    """Reroute rate per band of a preference score: above ``cut``, below ``-cut``, between."""
    band = F.when(score > cut, "high").when(score < -cut, "low").otherwise("mid")
    g = dec.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if(reroute).alias("reroutes"))
    return g.withColumn("reroute_rate", F.col("reroutes") / F.col("n"))


def decision_stats(dec: DataFrame) -> DataFrame:
    """Total, reroute count, keep count, reroute rate (A4)."""
    return dec.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("reroute")).alias("reroute_count"),
        F.count_if(~F.col("reroute")).alias("keep_count"),
        F.try_divide(F.count_if(F.col("reroute")).cast("double"), F.count(F.lit(1)).cast("double")).alias("reroute_rate"),
    )


def rate_in_range(rate: Column, lo: float = cfg.TARGET_REROUTE_RATE[0], hi: float = cfg.TARGET_REROUTE_RATE[1]) -> Column:
    """Target-range check (Q9)."""
    return F.coalesce(rate.between(lo, hi), F.lit(False))


def keyword_coverage(dec: DataFrame, text_col: str = "reasoning", keywords=tuple(cfg.REASON_KEYWORDS)) -> DataFrame:
    """Rows whose text contains each keyword: one aggregate, then unpivot (A5)."""
    aggs = [F.count_if(F.col(text_col).contains(k)).alias(f"k{i}") for i, k in enumerate(keywords)]
    wide = dec.agg(F.count(F.lit(1)).alias("total"), *aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("keyword"), F.col(f"k{i}").alias("count"))
                                for i, k in enumerate(keywords)]))
    return wide.select("total", stack.alias("s")).select(
        F.col("s.keyword").alias("keyword"), F.col("s.count").alias("count"),
        F.coalesce(F.try_divide(F.col("s.count") * 100.0, F.col("total").cast("double")), F.lit(0.0)).alias("percentage"),
    )


def preference_pairs(alts: DataFrame, decisions: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Chosen vs rejected alternative pairs per scenario.

    One row per non-chosen alternative, so output size equals the input
    alternatives minus one per scenario — never all pairs.
    """
    chosen = decisions.select(key, F.col("chosen_alt"))
    j = alts.join(chosen, key, "inner")
    return j.filter(F.col("alt_id") != F.col("chosen_alt")).select(
        key, F.col("chosen_alt").alias("chosen"), F.col("alt_id").alias("rejected"))


def rule_probability(a_delay: Column, meeting: Column, ts: Column) -> Column:
    """Documented rule-based reroute probability (D13): 0.8/0.4/0.1 by delay band, +0.2 meeting, −0.15 patient."""
    base = F.when(a_delay > 15, 0.8).when(a_delay > 5, 0.4).otherwise(0.1)
    adj = base + F.when(F.coalesce(meeting, F.lit(False)), 0.2).otherwise(0.0) \
        - F.when(F.coalesce(ts, F.lit(0.0)) < -0.5, 0.15).otherwise(0.0)
    return F.least(F.greatest(adj, F.lit(0.0)), F.lit(1.0))
