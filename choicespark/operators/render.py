"""Prompt / response rendering as string expressions.

All text is built with ``concat_ws`` over conditional fragments (a rule that
does not fire yields null and is skipped): JVM expressions, no Python per row.
The parts over lists (routes, events) use ``transform`` and ``filter`` with lambdas,
which Spark evaluates outside generated code.  Input is one row carrying persona,
scenario and decision columns (see :func:`sample_rows`).

FIXED VALUES: the sentences, labels and blank lines in the functions below must equal the
texts being reproduced, byte for byte; they stand plainly, in the order in which they are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicespark import config as cfg
from choicespark.functions.text import capitalize, int_text, word_count
from choicespark.operators.features import familiarity_band
from choicespark.operators.personas import dominant_factor

NL = "\n"


def _s(c: Column) -> Column:
    """Python ``str.format`` of a value: null prints as ``None``."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def _factor(name: str) -> Column:
    return F.coalesce(F.col(f"preference_factors.{name}"), F.lit(0.0))


def render_prompt() -> Column:
    """The instruction prompt (X17): fixed line order and blank lines."""
    route_block = F.array_join(F.transform("routes", lambda r: F.concat_ws(
        NL,
        F.concat(F.lit("Route "), r.getField("id"), F.lit(" ("), r.getField("name"), F.lit("):")),
        F.concat(F.lit("- Description: "), r.getField("description")),
        F.concat(F.lit("- Normal travel time: "), int_text(r.getField("normal_travel_time")), F.lit(" minutes")),
        F.concat(F.lit("- Current travel time: "), int_text(r.getField("current_travel_time")),
                 F.lit(" minutes (delay: "), int_text(r.getField("current_delay")), F.lit(" min)")),
        F.concat(F.lit("- Familiarity: "), familiarity_band(r.getField("familiarity"))),
        F.concat(F.lit("- Uncertainty: "), r.getField("uncertainty_level")),
        F.lit(""),
    )), NL)
    events_block = F.when(F.size("traffic_events") > 0, F.concat_ws(
        NL, F.lit("Current traffic conditions:"),
        F.array_join(F.transform("traffic_events", lambda e: F.concat(
            F.lit("- "), capitalize(e.getField("type")), F.lit(" at "), e.getField("location"), F.lit(": "),
            e.getField("severity"), F.lit(" severity, expected "), int_text(e.getField("expected_delay")),
            F.lit("-minute delay"))), NL),
        F.lit("")))
    weather = F.col("context.weather")
    weather_block = F.when(weather != "clear", F.concat(F.lit("Weather: "), weather, F.lit(NL)))
    return F.concat_ws(
        NL,
        F.lit("You play the role of the person:"),
        F.concat(F.lit("Name: "), _s(F.col("name")), F.lit(" | Age: "), _s(F.col("age")), F.lit(" | Gender: "),
                 _s(F.col("gender")), F.lit(" | Country: "), _s(F.col("country"))),
        F.concat(F.lit("Occupation: "), _s(F.col("occupation")), F.lit(" | Education: "), _s(F.col("education"))),
        F.lit(""),
        F.concat(F.lit("Transportation preferences: "), _s(F.col("preferences_in_transportation"))),
        F.concat(F.lit("Personality traits: "), _s(F.col("innate"))),
        F.lit(""),
        F.lit("Current situation:"),
        F.concat(F.lit("Time period: "), F.col("time_period")),
        F.concat(F.lit("Location: "), F.col("origin")),
        F.concat(F.lit("Destination: "), F.col("destination")),
        F.concat(F.lit("Purpose: "), F.replace(F.col("trip_purpose"), F.lit("_"), F.lit(" "))),
        F.when(F.coalesce(F.col("context.has_important_meeting"), F.lit(False)),
               F.lit("⚠️ Important: You have an urgent meeting and cannot be late.")),
        F.lit(""),
        F.lit("Available routes:"),
        route_block,
        events_block,
        weather_block,
        F.lit("What route would you choose and why? Respond in JSON format:"),
        F.lit("{"),
        F.lit('    "thinking": "your step-by-step analysis of the situation",'),
        F.lit('    "reflection": "your final reasoning and decision-making process",'),
        F.lit('    "plan": "your route choice (use \'none\' to keep Route A, or \'update path: <route_description>\' '
              'to switch)",'),
        F.lit('    "concepts": []'),
        F.lit("}"),
    )


def _route_line(label: str, r: Column) -> Column:
    return F.concat(F.lit(f"- Route {label}: "), int_text(r.getField("current_travel_time")), F.lit("min (delay: "),
                    int_text(r.getField("current_delay")), F.lit("min, uncertainty: "), r.getField("uncertainty_level"),
                    F.lit(")"))


def render_thinking() -> Column:
    """Step-by-step analysis (X18), lines joined by newline; factor lines at > 0.3."""
    a = F.col("routes")[0]
    b = F.try_element_at(F.col("routes"), F.lit(2))
    tol = F.coalesce(F.col("delay_tolerance_planned"), F.lit(10))
    d = a.getField("current_delay")
    return F.concat_ws(
        NL,
        F.lit("Let me analyze the current situation:"),
        _route_line("A (usual)", a),
        F.when(b.isNotNull(), _route_line("B (alternative)", b)),
        F.lit("\nConsidering my preferences:"),
        F.when(_factor("time_sensitivity") > 0.3, F.lit("- I prioritize time efficiency")),
        F.when(_factor("risk_aversion") > 0.3, F.lit("- I prefer predictable routes over uncertain ones")),
        F.when(_factor("familiar_route_preference") > 0.3, F.lit("- I prefer sticking with familiar routes")),
        F.when(_factor("rerouting_proactiveness") > 0.3, F.lit("- I tend to actively seek alternative routes")),
        F.when(F.coalesce(F.col("context.has_important_meeting"), F.lit(False)),
               F.lit("- I have an urgent meeting, cannot afford to be late")),
        F.concat(F.lit("\nThe delay ("), int_text(d), F.lit("min) "),
                 F.when(d > tol, F.lit("exceeds")).otherwise(F.lit("is within")),
                 F.lit(" my tolerance threshold ("), int_text(tol), F.lit("min).")),
    )


PREFERENCE_SENTENCES = {
    "risk_aversion": "As someone who values travel time reliability and predictability, I prefer routes with less "
                     "uncertainty even if they take slightly longer.",
    "time_sensitivity": "Time efficiency is important to me, so I tend to choose the fastest option available.",
    "familiar_route_preference": "I generally prefer sticking with my familiar route unless there's a compelling "
                                 "reason to change.",
    "rerouting_proactiveness": "I am proactive about finding alternative routes to avoid delays and uncertainties.",
}


def render_reflection() -> Column:
    """Decision narrative (X19), sentences joined by a space."""
    a = F.col("routes")[0]
    b = F.try_element_at(F.col("routes"), F.lit(2))
    d = a.getField("current_delay")
    ev = F.try_element_at(F.col("traffic_events"), F.lit(1))
    desc = F.when(d > 15, "a significant").when(d > 5, "a moderate").otherwise("a minor")
    delay_sentence = F.when(d > 0, F.concat(
        F.lit("My usual route (Route A) shows "), desc, F.lit(" "), int_text(d), F.lit("-minute delay"),
        F.when(ev.isNotNull(), F.concat(F.lit(" due to "), ev.getField("type"), F.lit(" at "), ev.getField("location")))
        .otherwise(F.lit("")), F.lit("."),
    )).otherwise(F.concat(F.lit("My usual route (Route A) is currently clear with normal travel time of "),
                          int_text(a.getField("normal_travel_time")), F.lit(" minutes.")))
    dom = dominant_factor(F.col("preference_factors"))
    pref = None
    for name, sentence in PREFERENCE_SENTENCES.items():
        cond = (dom == name) & (F.col(f"preference_factors.{name}") > 0.3)
        pref = F.when(cond, F.lit(sentence)) if pref is None else pref.when(cond, F.lit(sentence))
    tol = F.coalesce(F.col("delay_tolerance_planned"), F.lit(10))
    diff = a.getField("current_travel_time") - b.getField("current_travel_time")
    conclusion = (
        F.when(F.col("reroute") & b.isNotNull(),
               F.when(diff > 0, F.concat(F.lit("Therefore, I will switch to Route "), F.col("chosen_route"),
                                         F.lit(", which saves "), int_text(diff),
                                         F.lit(" minutes and avoids the congested area.")))
               .otherwise(F.concat(F.lit("Therefore, I will switch to Route "), F.col("chosen_route"),
                                   F.lit(" for better reliability, even though it may take slightly longer."))))
        .when(d > 0, F.concat(F.lit("However, the delay is still within my tolerance (threshold: "), int_text(tol),
                              F.lit(" minutes), so I will stick with my usual route.")))
        .otherwise(F.lit("Therefore, I will continue with my usual Route A."))
    )
    return F.concat_ws(
        " ",
        F.concat(F.lit("I am currently at "), F.col("origin"), F.lit(", planning to travel to "), F.col("destination"),
                 F.lit(" during "), F.col("time_period"), F.lit(".")),
        delay_sentence,
        pref,
        F.when(F.coalesce(F.col("context.has_important_meeting"), F.lit(False)),
               F.lit("Given that I have an important meeting and cannot afford to be late, time reliability is "
                     "especially critical.")),
        conclusion,
    )


def render_plan() -> Column:
    """``none`` or ``update path: <description>`` with ``via `` removed and `` and `` → ``, ``."""
    chosen = F.try_element_at(F.filter("routes", lambda r: r.getField("id") == F.col("chosen_route")), F.lit(1))
    desc = F.replace(F.replace(chosen.getField("description"), F.lit("via "), F.lit("")), F.lit(" and "), F.lit(", "))
    return (F.when(~F.coalesce(F.col("reroute"), F.lit(False)) | chosen.isNull(), F.lit("none"))
            .otherwise(F.concat(F.lit("update path: "), desc)))


def sample_rows(df: DataFrame) -> DataFrame:
    """Persona + scenario + decision rows → training samples (``id, persona_id,
    scenario_id, prompt, thinking, reflection, plan, concepts``)."""
    return df.select(
        F.col("scenario_id").alias("id"), "persona_id", "scenario_id",
        render_prompt().alias("prompt"),
        render_thinking().alias("thinking"),
        render_reflection().alias("reflection"),
        render_plan().alias("plan"),
        F.array().cast("array<string>").alias("concepts"),
    )


def json_string(c: Column) -> Column:
    """A JSON string literal (quotes included, non-ASCII kept raw)."""
    j = F.to_json(F.struct(c.alias("v")))
    return F.substring(j, 6, 1 << 30).substr(F.lit(1), F.length(j) - 6)


def response_json(thinking: Column, reflection: Column, plan: Column) -> Column:
    """``json.dumps(response, indent=2, ensure_ascii=False)`` byte for byte."""
    return F.concat(
        F.lit('{\n  "thinking": '), json_string(thinking),
        F.lit(',\n  "reflection": '), json_string(reflection),
        F.lit(',\n  "plan": '), json_string(plan),
        F.lit(',\n  "concepts": []\n}'),
    )


def chat_text(prompt: Column, thinking: Column, reflection: Column, plan: Column) -> Column:
    """Chat-template text."""
    return F.concat(F.lit(cfg.CHAT_TEMPLATE_PREFIX), prompt, F.lit(cfg.CHAT_TEMPLATE_MIDDLE),
                    response_json(thinking, reflection, plan), F.lit(cfg.CHAT_TEMPLATE_SUFFIX))


def _sample_words(samples: DataFrame) -> DataFrame:
    plan_type = (F.when(F.col("plan").startswith("update path"), "update_path")
                 .when(F.col("plan") == "none", "none").otherwise("other"))
    return samples.select(word_count(F.col("prompt")).alias("pw"), word_count(F.col("reflection")).alias("rw"),
                          plan_type.alias("plan_type"))


def sample_stats(samples: DataFrame) -> DataFrame:
    """Plan-class distribution with word totals per class."""
    return _sample_words(samples).groupBy("plan_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pw").alias("prompt_words"), F.sum("rw").alias("reflection_words"))


def sample_means(samples: DataFrame) -> DataFrame:
    """Number of samples and mean prompt / reflection word counts over all of them."""
    return _sample_words(samples).agg(F.count(F.lit(1)).alias("n"), F.avg("pw").alias("mean_prompt_words"),
                                      F.avg("rw").alias("mean_reflection_words"))


def chat_segment(role: Column, text: Column) -> Column:
    """One chat-template turn: ``<|im_start|>{role}\\n{text}<|im_end|>\\n``.

    A conversation's text is the concatenation of its segments in turn order;
    segments are produced per row, so no conversation is gathered into one task.
    """
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))
