"""Scenario generation as table operators: fan out personas, then draw columns.

Every drawn value is a keyed draw on ``scenario_id`` (see
:mod:`choicespark.functions.draws`), so the scenarios of a persona depend only
on that persona's row.  After one exchange that spreads the personas by key the whole
step is narrow, and a lost partition recomputes to the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicespark import config as cfg
from choicespark.functions import draws as D
from choicespark.functions.nulls import zfill
from choicespark.session import cut_lineage
from choicespark.operators.features import delay_level, period_from_template, period_stats_key, uncertainty_level

ROUTE_TYPE = ("struct<id:string,name:string,description:string,normal_travel_time:int,current_delay:int,"
              "current_travel_time:int,uncertainty_level:string,familiarity:double>")
EVENT_TYPE = "struct<location:string,type:string,severity:string,expected_delay:int>"


def fan_out(personas: DataFrame, n: int = cfg.SCENARIOS_PER_PERSONA, id_col: str = "persona_id") -> DataFrame:
    """Each persona → ``n`` rows with ``scenario_id = {persona}_S{idx:02d}`` (G1)."""
    return (personas.withColumn("scenario_idx", F.explode(F.sequence(F.lit(1), F.lit(n))))
            .withColumn("scenario_id", F.concat(F.col(id_col), F.lit("_S"), zfill(F.col("scenario_idx"), 2))))


def _arr(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _pick_index(u: Column, weights) -> Column:
    return D.weighted_choice(u, [(i, w) for i, w in enumerate(weights)])


STREAMS = ["template", "delay_band", "delay", "a_ratio", "a_fam", "b_delay", "b_ratio", "b_diff", "b_fam",
           "event_location", "event_type", "event_severity", "weather", "meeting", "buffer"]

def _uniforms(key: str, attempt: int, seed: int) -> dict[str, Column]:
    return {st: D.uniform(seed, f"{st}#{attempt}", key) for st in STREAMS}


def draw_fields(df: DataFrame, key: str, commute: str, seed: int = cfg.SEED) -> DataFrame:
    """Add the drawn scalar fields as ``s_*`` columns, with ``redrawn`` and ``still_invalid``.

    The uniforms of the first attempt are hashed once per row, and those of the second only where
    the first makes an invalid scenario.  Every field is then computed once, from the uniforms that
    count.  The projections stay apart, as each reads columns of the one before it several
    times: no hash is computed twice, and the generated methods stay small enough for the JVM to compile.
    The second attempt's hashes are one lambda, which few rows evaluate; it also parts the generated code.
    """
    carried = df.columns
    df = _times(df.withColumns({f"u_{st}": u for st, u in _uniforms(key, 0, seed).items()}), "u_", commute)
    again = F.transform(_arr([f"{st}#1" for st in STREAMS]), lambda st: D.uniform(seed, st, F.col(key)))
    df = df.withColumn("_valid", F.expr(_valid_sql("u_")))
    df = df.withColumn("_again", F.when(F.col("_valid"), F.lit(None)).otherwise(again))
    df = df.select(*carried, "_valid", *[F.when(F.col("_valid"), F.col(f"u_{st}")).otherwise(F.col("_again")[i]).alias(f"v_{st}") for i, st in enumerate(STREAMS)])
    df = _times(df, "v_", commute)
    # SQL expressions: one JVM call per field instead of hundreds of Column constructions per query plan
    return df.select(*carried, *[F.expr(sql).alias(f"s_{f}") for f, sql in _field_sql("v_").items()], (~F.col("_valid")).alias("redrawn"),
                     F.expr(f"NOT {_valid_sql('v_')}").alias("still_invalid"))


def _d(x: float) -> str:
    return f"{float(x)!r}D"


def _sarr(values) -> str:
    return "array(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def _scase(u: str, options) -> str:
    cum = D.cumulative([w for _, w in options])
    lit = (lambda v: f"'{v}'" if isinstance(v, str) else str(v))
    whens = " ".join(f"WHEN {u} < {_d(c)} THEN {lit(v)}" for (v, _), c in zip(options[:-1], cum[:-1]))
    return f"(CASE {whens} ELSE {lit(options[-1][0])} END)"


def _times(df: DataFrame, p: str, commute: str) -> DataFrame:
    """Delay and travel times of one attempt as ``{p}s_*`` columns, from its ``{p}*`` uniform columns."""
    def u(stream: str) -> str:
        return f"`{p}{stream}`"

    c, (r0, r1) = f"`{commute}`", cfg.TRAVEL_TIME_RATIO
    small = cfg.ALT_SMALL_DELAY[1] - cfg.ALT_SMALL_DELAY[0]
    diff = cfg.ALT_TIME_DIFFERENCE[1] - cfg.ALT_TIME_DIFFERENCE[0]
    lo, hi = (f"element_at({_sarr([b[k] for b in cfg.DELAY_BANDS])}, `{p}s_band`)" for k in (1, 2))
    steps = [
        {"band": f"({_scase(u('delay_band'), [(i, b[3]) for i, b in enumerate(cfg.DELAY_BANDS)])} + 1)",
         "template": f"({_scase(u('template'), [(i, t[4]) for i, t in enumerate(cfg.TEMPLATES)])} + 1)"},
        {"delay": f"CAST({lo} + floor({u('delay')} * CAST({hi} - {lo} + 1 AS DOUBLE)) AS INT)",
         "a_normal": f"CAST({c} * ({_d(r0)} + {u('a_ratio')} * {_d(r1 - r0)}) AS INT)",
         "b_normal": f"(CAST({c} * ({_d(r0)} + {u('b_ratio')} * {_d(r1 - r0)}) AS INT) + CAST(floor({u('b_diff')} * {_d(diff)}) AS INT))"},
        {"b_delay": f"(CASE WHEN `{p}s_delay` > 5 THEN 0 ELSE CAST(floor({u('b_delay')} * {_d(small)}) AS INT) END)"},
    ]
    for step in steps:
        df = df.withColumns({f"{p}s_{name}": F.expr(sql) for name, sql in step.items()})
    return df


def _valid_sql(p: str) -> str:
    """Whether both routes of an attempt pass :func:`route_ok`."""
    def ok(normal: str, delay: str) -> str:
        return (f"(({normal} + {delay}) >= {cfg.MIN_TRAVEL_TIME} AND ({normal} + {delay}) <= {cfg.MAX_TRAVEL_TIME} AND ({normal} <= 0 OR "
                f"CAST({delay} AS DOUBLE) / (CASE WHEN {normal} > 0 THEN {normal} ELSE 1 END) <= {_d(cfg.MAX_DELAY_TO_NORMAL)}))")

    return f"({ok(f'`{p}s_a_normal`', f'`{p}s_delay`')} AND {ok(f'`{p}s_b_normal`', f'`{p}s_b_delay`')})"


def _field_sql(p: str) -> dict[str, str]:
    """Spark SQL for the fields of an attempt, reading its uniforms and what :func:`_times` adds."""
    def u(stream: str) -> str:
        return f"`{p}{stream}`"

    def real(stream: str, bounds: tuple[float, float]) -> str:
        return f"({_d(bounds[0])} + {u(stream)} * {_d(bounds[1] - bounds[0])})"

    n_loc, buf = len(cfg.EVENT_LOCATIONS), cfg.TIME_BUFFER_RANGE[1] - cfg.TIME_BUFFER_RANGE[0]
    of_template = lambda k: f"element_at({_sarr([t[k] for t in cfg.TEMPLATES])}, `{p}s_template`)"
    return {
        "template": of_template(0), "origin": of_template(1), "destination": of_template(2), "trip_purpose": of_template(3),
        "delay": f"`{p}s_delay`",
        "a_normal": f"`{p}s_a_normal`",
        "a_time": f"(`{p}s_a_normal` + `{p}s_delay`)",
        "a_fam": real("a_fam", cfg.FAMILIARITY_USUAL),
        "b_delay": f"`{p}s_b_delay`",
        "b_normal": f"`{p}s_b_normal`",
        "b_time": f"(`{p}s_b_normal` + `{p}s_b_delay`)",
        "b_fam": real("b_fam", cfg.FAMILIARITY_ALT),
        "ev_location": f"element_at({_sarr(cfg.EVENT_LOCATIONS)}, CAST(floor({u('event_location')} * {_d(n_loc)}) + 1 AS INT))",
        "ev_type": _scase(u("event_type"), cfg.EVENT_TYPES),
        "ev_severity": _scase(u("event_severity"), cfg.EVENT_SEVERITY),
        "weather": _scase(u("weather"), cfg.WEATHER),
        "meeting": f"({u('meeting')} < {_d(cfg.IMPORTANT_MEETING_PROB)})",
        "buffer": f"CAST(floor({u('buffer')} * {_d(buf)}) AS INT)",
    }


def route_ok(time: Column, normal: Column, delay: Column) -> Column:
    """One route inside [5, 180] minutes with delay ≤ 2 × normal when normal > 0."""
    ratio_ok = (normal <= 0) | (delay.cast("double") / F.when(normal > 0, normal).otherwise(1)
                                <= F.lit(cfg.MAX_DELAY_TO_NORMAL))
    return (time >= cfg.MIN_TRAVEL_TIME) & (time <= cfg.MAX_TRAVEL_TIME) & ratio_ok


def scenario_valid(routes: Column) -> Column:
    """Every route of a ``routes`` array passes :func:`route_ok` (Q8), for any number of routes."""
    return F.forall(routes, lambda r: route_ok(r.getField("current_travel_time"), r.getField("normal_travel_time"),
                                               r.getField("current_delay")))


def _route(i: int, normal: Column, d: Column, fam: Column) -> Column:
    rid, name, desc = cfg.ROUTES[i]
    return F.struct(F.lit(rid).alias("id"), F.lit(name).alias("name"), F.lit(desc).alias("description"),
                    normal.alias("normal_travel_time"), d.alias("current_delay"),
                    (normal + d).alias("current_travel_time"), uncertainty_level(d).alias("uncertainty_level"),
                    fam.alias("familiarity"))


def generate_scenarios(personas: DataFrame, n: int = cfg.SCENARIOS_PER_PERSONA, seed: int = cfg.SEED,
                       keep_persona: bool = False) -> DataFrame:
    """Personas → scenarios with one unchecked redraw of invalid attempts.

    The redraw is accepted without re-validation (kept behaviour); the
    ``still_invalid`` flag reports those rows.  The personas (one row each) are
    spread by key once; the fan-out after that is narrow.  With ``keep_persona`` the
    persona columns ride along, so later steps need no join back to the personas.
    """
    base = personas if keep_persona else personas.select("persona_id", "commute_time_morning")
    # Persona tables come out of aggregations that AQE may coalesce into very few
    # partitions; the fan-out multiplies rows and is CPU-heavy, so spread the
    # personas by key over the configured parallelism first (one row each).
    # A hash of the key, as the planner drops a repartitioning that the input's own
    # partitioning by the key satisfies, and AQE then coalesces that one.
    target = int(personas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = fan_out(base.repartition(target, F.xxhash64("persona_id")), n)
    return _drawn(df, "scenario_id", [c for c in personas.columns if c != "persona_id"] if keep_persona else [], seed)


def _drawn(df: DataFrame, key: str, keep: Sequence[str], seed: int) -> DataFrame:
    """Scenario columns from two attempts keyed by ``key``, the second where the first is invalid; ``keep`` rides along."""
    df = draw_fields(df, key, "commute_time_morning", seed)
    s = {f: F.col(f"s_{f}") for f in _field_sql("v_")}
    event = F.struct(s["ev_location"].alias("location"), s["ev_type"].alias("type"),
                     s["ev_severity"].alias("severity"), s["delay"].alias("expected_delay"))
    return df.select(
        "scenario_id", "persona_id", *keep,
        s["origin"].alias("origin"), s["destination"].alias("destination"),
        period_from_template(s["template"]).alias("time_period"), s["trip_purpose"].alias("trip_purpose"),
        F.array(_route(0, s["a_normal"], s["delay"], s["a_fam"]),
                _route(1, s["b_normal"], s["b_delay"], s["b_fam"])).alias("routes"),
        F.when(s["delay"] > 0, F.array(event)).otherwise(F.array().cast(f"array<{EVENT_TYPE}>")).alias("traffic_events"),
        F.struct(s["weather"].alias("weather"),
                 s["template"].isin("commute_morning", "commute_evening").alias("is_rush_hour"),
                 s["meeting"].alias("has_important_meeting"), s["buffer"].alias("time_buffer")).alias("context"),
        "redrawn", "still_invalid",
    )


def flatten_scenarios(sc: DataFrame) -> DataFrame:
    """Route A/B, event and context fields as top-level columns (for joins and SQL checks)."""
    a, b = F.col("routes")[0], F.col("routes")[1]
    ev = F.try_element_at(F.col("traffic_events"), F.lit(1))
    return sc.select(
        "scenario_id", "persona_id", "origin", "destination", "time_period", "trip_purpose",
        a.getField("normal_travel_time").alias("a_normal"), a.getField("current_delay").alias("a_delay"),
        a.getField("current_travel_time").alias("a_time"), a.getField("uncertainty_level").alias("a_uncertainty"),
        a.getField("familiarity").alias("a_familiarity"),
        b.getField("normal_travel_time").alias("b_normal"), b.getField("current_delay").alias("b_delay"),
        b.getField("current_travel_time").alias("b_time"), b.getField("uncertainty_level").alias("b_uncertainty"),
        b.getField("familiarity").alias("b_familiarity"),
        F.when(F.size("traffic_events") > 0, ev.getField("type")).alias("event_type"),
        F.when(F.size("traffic_events") > 0, ev.getField("severity")).alias("event_severity"),
        F.when(F.size("traffic_events") > 0, ev.getField("location")).alias("event_location"),
        F.col("context.weather").alias("weather"), F.col("context.is_rush_hour").alias("is_rush_hour"),
        F.col("context.has_important_meeting").alias("has_important_meeting"),
        F.col("context.time_buffer").alias("time_buffer"), "redrawn", "still_invalid",
    )


def scenario_stats(sc: DataFrame) -> DataFrame:
    """Four category distributions in one pass (A3): (category, key, count, percentage)."""
    keyed = sc.select(
        delay_level(F.col("routes")[0].getField("current_delay")).alias("delay_levels"),
        F.coalesce(F.try_element_at(F.col("traffic_events"), F.lit(1)).getField("type"), F.lit("none")).alias("event_types"),
        F.col("trip_purpose").alias("trip_purposes"),
        period_stats_key(F.coalesce(F.col("time_period"), F.lit("off-peak hours"))).alias("time_periods"),
    )
    long = keyed.unpivot([], ["delay_levels", "event_types", "trip_purposes", "time_periods"], "category", "key")
    counts = long.groupBy("category", "key").agg(F.count(F.lit(1)).alias("count"))
    # every category partitions all scenarios, so its count total is the row total;
    # the window runs over the few grouped rows only
    total = F.sum("count").over(Window.partitionBy("category"))
    share = F.try_divide(F.col("count") * 100.0, total.cast("double"))
    return counts.select("category", "key", "count", share.alias("share"), F.round(share, 2).alias("percentage"))


def _distinct(value: Column, domain: Sequence[str]) -> Column:
    """Number of different values out of a small fixed domain: bits are OR-ed map-side, rows are not multiplied."""
    bit = F.lit(0)
    for i, v in enumerate(domain):
        bit = F.when(value == v, F.lit(1 << i)).otherwise(bit)
    return F.bit_count(F.bit_or(bit)).cast("bigint")


def coverage_check(sc: DataFrame, min_delay_levels: int = 3, min_event_types: int = 2,
                   min_periods: int = 2) -> DataFrame:
    """Per-persona coverage of delay levels, event types and periods."""
    event = F.coalesce(F.try_element_at(F.col("traffic_events"), F.lit(1)).getField("type"), F.lit("none"))
    per = sc.groupBy("persona_id").agg(
        _distinct(delay_level(F.col("routes")[0].getField("current_delay")), ["none", "minor", "moderate", "severe"]).alias("n_delay_levels"),
        _distinct(event, ["none", *[name for name, _ in cfg.EVENT_TYPES]]).alias("n_event_types"),
        _distinct(period_stats_key(F.col("time_period")), ["morning_rush", "evening_rush", "off_peak"]).alias("n_periods"),
    )
    return per.withColumn("covered", (F.col("n_delay_levels") >= min_delay_levels)
                          & (F.col("n_event_types") >= min_event_types) & (F.col("n_periods") >= min_periods))


#: Values that a persona's scenarios must cover, and how many of each.
COVERAGE = {"delay_levels": 3, "event_types": 2, "time_periods": 2}


def _facets() -> list[Column]:
    event = F.coalesce(F.try_element_at(F.col("traffic_events"), F.lit(1)).getField("type"), F.lit("none"))
    return [delay_level(F.col("routes")[0].getField("current_delay")).alias("delay_levels"), event.alias("event_types"),
            period_stats_key(F.col("time_period")).alias("time_periods")]


def _covered(facets: Column, limits: dict[str, int]) -> Column:
    """How much of the limits an array of facet structs covers; their sum when all of it."""
    def part(facet: str, need: int) -> Column:
        return F.least(F.size(F.array_distinct(F.transform(facets, lambda s: s.getField(facet)))), F.lit(need))

    parts = [part(f, need) for f, need in limits.items()]
    return sum(parts[1:], parts[0])


def cover_scenarios(personas: DataFrame, n: int = cfg.SCENARIOS_PER_PERSONA, seed: int = cfg.SEED, limits: dict[str, int] | None = None,
                    tries: int = 16, max_rounds: int = 12) -> tuple[DataFrame, DataFrame]:
    """Scenarios of which every persona's cover the limits, and the personas that could not be covered.

    Scenarios are generated as always.  Then, in rounds, every persona that is not covered has the
    scenario that its coverage needs least (the last of equals) drawn again ``tries`` times, keyed by
    scenario, round and try, and takes the first valid draw that covers most if it covers more than
    before.  Draws depend on keys only, so the rows are the same under any partitioning.  A round
    touches the uncovered personas only and is stored, one row per persona and try passes through it.
    Personas that stay uncovered after ``max_rounds`` (more limits than scenarios, say) are returned
    with what they cover.
    """
    limits = limits or COVERAGE
    full = sum(limits.values())
    commute = cut_lineage(personas.select("persona_id", "commute_time_morning"), "commute")
    sc = cut_lineage(generate_scenarios(commute, n, seed), "scenarios")
    columns = sc.columns
    spread = sc.select("persona_id", "scenario_id", F.struct(*_facets()).alias("f"))
    seen = spread.groupBy("persona_id").agg(F.sort_array(F.collect_list(F.struct("scenario_id", "f"))).alias("own"))  # n each
    seen = seen.withColumn("score", _covered(F.transform("own", lambda s: s.getField("f")), limits))
    seen = cut_lineage(seen, "coverage")
    todo = seen.filter(F.col("score") < full)
    taken: list[DataFrame] = []
    for r in range(max_rounds):
        if not todo.limit(1).count():
            break
        others = lambda s: F.filter("own", lambda o: o.getField("scenario_id") != s.getField("scenario_id"))
        ranked = F.transform("own", lambda s, i: F.struct(_covered(F.transform(others(s), lambda o: o.getField("f")), limits).alias("left"), i.alias("at"), s.getField("scenario_id").alias("id")))
        work = todo.withColumn("victim", F.array_max(ranked).getField("id"))
        work = work.withColumn("rest", F.filter("own", lambda o: o.getField("scenario_id") != F.col("victim")))
        work = cut_lineage(work, f"victims-{r}")  # else the search for them is repeated in every drawn column
        drawn = work.join(commute, "persona_id").withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
        drawn = drawn.withColumn("scenario_id", F.col("victim")).withColumn("draw_key", F.concat_ws("#", "victim", F.lit(f"r{r}"), "try"))
        drawn = cut_lineage(_drawn(drawn, "draw_key", ["score", "rest", "try"], seed), f"draws-{r}").filter(~F.col("still_invalid"))
        drawn = drawn.withColumn("f", F.struct(*_facets()))
        drawn = drawn.withColumn("after", _covered(F.concat(F.transform("rest", lambda o: o.getField("f")), F.array("f")), limits))
        best = drawn.groupBy("persona_id").agg(F.max_by(F.struct(*columns, "f", "rest", "after", "score"), F.struct("after", -F.col("try"))).alias("b"))
        best = cut_lineage(best.filter("b.after > b.score"), f"cover-{r}")
        new = best.select("persona_id", F.sort_array(F.concat("b.rest", F.array(F.struct(F.col("b.scenario_id").alias("scenario_id"), F.col("b.f").alias("f"))))).alias("own"),
                          F.col("b.after").alias("score"))
        taken.append(best.select(*[F.col(f"b.{c}").alias(c) for c in columns]).withColumn("_round", F.lit(r)))
        todo = cut_lineage(todo.join(new.select("persona_id"), "persona_id", "left_anti").unionByName(new).filter(F.col("score") < full), f"uncovered-{r}")
    if not taken:
        return sc, todo.select("persona_id", "score")
    fresh = taken[0]
    for t in taken[1:]:
        fresh = fresh.unionByName(t)
    fresh = fresh.groupBy("scenario_id").agg(F.max_by(F.struct(*columns), "_round").alias("s")).select("s.*")
    kept = sc.join(fresh.select("scenario_id"), "scenario_id", "left_anti").select(*columns)
    return kept.unionByName(fresh), todo.select("persona_id", "score")
