"""Risk explanations (K10-K17): per-account component, boost, counterfactual,
severity-driver and waterfall tables, plus the narrative text and JSON report.

Each account's explanation rows come from a fixed-size array of structs built
in the row itself (4 components, a handful of boost rules), sorted with
``array_sort`` and exploded with ``posexplode`` — per-row work only, no window
and no shuffle, so it scales with the number of scored rows.

Numbers inside text are rounded with ``round`` first (HALF_UP) and only then
formatted, so the text does not depend on the formatter's tie rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.scoring import (COMPONENT_LABELS, COMPONENTS, CONTRIB_NAMES, CRITICAL_THRESH,
                                        ELEVATED_THRESH, HIGH_THRESH, WEIGHTS,
                                        action_expr)

# ---- fixed values (must equal the reference) -------------------------------
CATEGORY_TEXT = {
    "BLOCK": "presents critically elevated fraud risk indicators",
    "REVIEW": "exhibits significant fraud risk indicators requiring analyst review",
    "MONITOR": "shows moderate fraud risk indicators warranting enhanced monitoring",
    "SAFE": "shows low fraud risk indicators consistent with normal behaviour",
}

def level_label(score: Column) -> Column:
    """HIGH >= 75, ELEVATED >= 60, MODERATE >= 30, else LOW."""
    return (F.when(score >= HIGH_THRESH, "HIGH").when(score >= ELEVATED_THRESH, "ELEVATED")
            .when(score >= 30, "MODERATE").otherwise("LOW"))


def _fmt(fmt: str, *cols: Column, digits: int | None = None) -> Column:
    if digits is not None:
        cols = tuple(F.round(c, digits) for c in cols)
    return F.format_string(fmt, *cols)


def _components(scored: DataFrame) -> Column:
    """array<struct> of the 4 components in their fixed order."""
    score = F.col("risk_score")
    return F.array(*[F.struct(
        F.lit(i).alias("ord"), F.lit(c).alias("component"), F.lit(COMPONENT_LABELS[c]).alias("label"),
        F.col(c).alias("raw_score"), F.lit(WEIGHTS[c]).alias("weight"),
        F.col(CONTRIB_NAMES[c]).alias("contribution"),
        F.when(score > 0, F.col(CONTRIB_NAMES[c]) / score * 100).otherwise(0.0).alias("pct_of_total"),
        level_label(F.col(c)).alias("level")) for i, c in enumerate(COMPONENTS)])


def _sorted_desc(arr: Column, key: str = "contribution") -> Column:
    """Sort by ``key`` desc, component order asc (stable, like Python's sorted)."""
    return F.array_sort(arr, lambda a, b: F.when(a[key] > b[key], -1).when(a[key] < b[key], 1)
                        .otherwise(F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)))


def component_explanation(scored: DataFrame, key: str = "account_id") -> DataFrame:
    """One row per component, sorted by contribution desc (rank 1 = largest)."""
    x = scored.select(key, F.posexplode(_sorted_desc(_components(scored))).alias("pos", "c"))
    return x.select(key, (F.col("pos") + 1).alias("rank"), "c.component", "c.label", "c.raw_score",
                    "c.weight", "c.contribution", "c.pct_of_total", "c.level")


def dominant_signal(scored: DataFrame, key: str = "account_id") -> DataFrame:
    """Component with the largest contribution, first in component order on ties."""
    top = F.element_at(_sorted_desc(_components(scored)), 1)
    return scored.select(key, top["component"].alias("component"), top["label"].alias("label"),
                         top["raw_score"].alias("raw_score"), top["contribution"].alias("contribution"),
                         top["pct_of_total"].alias("pct_of_total"))


def boost_rules(scored: DataFrame, key: str = "account_id") -> DataFrame:
    """Fired rules (high-signal per component, critical alert, convergence) and the
    'no component exceeded' row when no high-signal boost fired."""
    rules = []
    for i, c in enumerate(COMPONENTS):
        lab = COMPONENT_LABELS[c]
        rules.append(F.when(F.col(f"hs_{c}") > 0, F.struct(
            F.lit(i).alias("ord"), F.lit(f"HIGH_SIGNAL: {lab}").alias("rule"),
            F.lit(f"{lab} > {HIGH_THRESH}").alias("condition"),
            _fmt("%.1f", F.col(c), digits=1).alias("value"),
            _fmt("+%.3f×", F.col(f"hs_{c}"), digits=3).alias("boost_added"), F.lit(True).alias("fired"))))
    rules.append(F.when(F.col("critical_boost") > 0, F.struct(
        F.lit(4).alias("ord"), F.lit("CRITICAL_ALERT: Rule-Based Alert").alias("rule"),
        F.lit(f"Alert Score > {CRITICAL_THRESH}").alias("condition"),
        _fmt("%.1f", F.col("alert_score"), digits=1).alias("value"),
        _fmt("+%.3f×", F.col("critical_boost"), digits=3).alias("boost_added"), F.lit(True).alias("fired"))))
    rules.append(F.when(F.col("interaction_boost") > 0, F.struct(
        F.lit(5).alias("ord"),
        F.format_string("CONVERGENT_EVIDENCE: %d signals elevated", F.col("n_elevated")).alias("rule"),
        F.format_string(f"≥%d scores > {ELEVATED_THRESH}", F.col("n_elevated")).alias("condition"),
        F.format_string("n=%d", F.col("n_elevated")).alias("value"),
        _fmt("+%.3f×", F.col("interaction_boost"), digits=3).alias("boost_added"), F.lit(True).alias("fired"))))
    no_high = sum((F.col(f"hs_{c}") > 0).cast("int") for c in COMPONENTS) == 0
    rules.append(F.when(no_high, F.struct(
        F.lit(6).alias("ord"), F.lit("HIGH_SIGNAL: No component exceeded threshold").alias("rule"),
        F.lit(f"Any score > {HIGH_THRESH}").alias("condition"), F.lit("N/A").alias("value"),
        F.lit("+0.000×").alias("boost_added"), F.lit(False).alias("fired"))))
    arr = F.filter(F.array(*rules), lambda r: r.isNotNull())
    x = scored.select(key, F.posexplode(arr).alias("pos", "r"))
    return x.select(key, (F.col("pos") + 1).alias("rank"), "r.rule", "r.condition", "r.value",
                    "r.boost_added", "r.fired")


def counterfactual(scored: DataFrame, key: str = "account_id") -> DataFrame:
    """Per non-SAFE account, the (at most 2) components whose drop alone would move
    the score to the next lower category, smallest drop first. Module weights are used
    and the boost is held fixed, as in the reference."""
    cat = F.col("risk_category")
    target = F.when(cat == "BLOCK", 80).when(cat == "REVIEW", 60).when(cat == "MONITOR", 30)
    tcat = F.when(cat == "BLOCK", "REVIEW").when(cat == "REVIEW", "MONITOR").when(cat == "MONITOR", "SAFE")
    red = F.col("risk_score") - target
    items = []
    for i, c in enumerate(COMPONENTS):
        eff = F.lit(WEIGHTS[c]) * F.col("boost_multiplier")
        drop = F.when(eff > 0, red / eff)
        items.append(F.struct(F.lit(i).alias("ord"), F.lit(c).alias("component"),
                              F.lit(COMPONENT_LABELS[c]).alias("label"), F.col(c).alias("current"),
                              F.greatest(F.lit(0.0), F.col(c) - drop).alias("needed"),
                              drop.alias("drop_needed")))
    arr = F.filter(F.array(*items), lambda s: s["drop_needed"] <= s["current"])
    arr = F.array_sort(arr, lambda a, b: F.when(a["drop_needed"] < b["drop_needed"], -1)
                       .when(a["drop_needed"] > b["drop_needed"], 1)
                       .otherwise(F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)))
    x = (scored.filter(cat != "SAFE")
         .select(key, cat.alias("current_category"), tcat.alias("target_category"),
                 target.alias("target_score"), red.alias("reduction_needed"),
                 F.posexplode(F.slice(arr, 1, 2)).alias("pos", "s")))
    return x.select(key, (F.col("pos") + 1).alias("rank"), "current_category", "target_category",
                    "target_score", "reduction_needed", "s.component", "s.label", "s.current", "s.needed",
                    "s.drop_needed")


# fixed texts (must equal the reference)
SAFE_MESSAGE = "Account is already in the lowest risk category (SAFE)."
DROP_NOTE = "Reducing %s from %.0f to %.0f would be sufficient to move to %s category, assuming other scores unchanged."


def counterfactual_notes(scored: DataFrame, key: str = "account_id") -> DataFrame:
    """K13 in words, for every account: the SAFE message, the easiest drop as a sentence, or nothing if no single drop suffices
    (numbers rounded to one digit, then to none)."""
    tenth = lambda c: F.round(F.round(F.col(c), 1), 0)
    best = counterfactual(scored, key).where("rank = 1").select(
        F.col(key).alias("__key"), F.format_string(DROP_NOTE, "label", tenth("current"), tenth("needed"), "target_category").alias("note"))
    x = scored.select(key, "risk_category").join(best, F.col(key) == F.col("__key"), "left")
    safe = F.col("risk_category") == "SAFE"
    return x.select(key, F.when(safe, F.lit(SAFE_MESSAGE)).otherwise(F.coalesce("note", F.lit(""))).alias("note"))


def severity_drivers(scored: DataFrame, key: str = "account_id") -> DataFrame:
    """Components (HIGH >= 75 / MEDIUM >= 60 / LOW), convergence (boost x base)
    and critical override drivers, sorted by contribution desc (stable)."""
    items = []
    for i, c in enumerate(COMPONENTS):
        raw = F.col(c)
        items.append(F.struct(F.lit(i).alias("ord"), F.lit(COMPONENT_LABELS[c]).alias("factor"),
                              F.when(raw >= HIGH_THRESH, "HIGH").when(raw >= ELEVATED_THRESH, "MEDIUM")
                              .otherwise("LOW").alias("impact"),
                              raw.alias("raw_score"), F.col(CONTRIB_NAMES[c]).alias("contribution")))
    items.append(F.when(F.col("n_elevated") >= 2, F.struct(
        F.lit(4).alias("ord"),
        F.format_string("Convergent Evidence (%d signals elevated)", F.col("n_elevated")).alias("factor"),
        F.lit("HIGH").alias("impact"), F.col("n_elevated").cast("double").alias("raw_score"),
        (F.col("interaction_boost") * F.col("base_score")).alias("contribution"))))
    items.append(F.when(F.col("critical_boost") > 0, F.struct(
        F.lit(5).alias("ord"), F.lit("Critical Alert Override").alias("factor"), F.lit("CRITICAL").alias("impact"),
        F.col("alert_score").alias("raw_score"),
        (F.col("critical_boost") * F.col("base_score")).alias("contribution"))))
    arr = _sorted_desc(F.filter(F.array(*items), lambda r: r.isNotNull()))
    x = scored.select(key, F.posexplode(arr).alias("pos", "d"))
    return x.select(key, (F.col("pos") + 1).alias("rank"), "d.factor", "d.impact", "d.raw_score", "d.contribution")


def waterfall(scored: DataFrame, key: str = "account_id") -> DataFrame:
    """Running start / end per component (fixed order), a boost step when
    score - base > 0.01, and the total bar."""
    steps = []
    run = F.lit(0.0)
    for i, c in enumerate(COMPONENTS):
        v = F.col(CONTRIB_NAMES[c])
        steps.append(F.struct(F.lit(i + 1).alias("step"), F.lit(c).alias("label"), F.lit("component").alias("type"),
                              v.alias("value"), run.alias("start_at"), (run + v).alias("end_at")))
        run = run + v
    boost_v = F.col("risk_score") - F.col("base_score")
    steps.append(F.when(boost_v > 0.01, F.struct(
        F.lit(5).alias("step"), _fmt("Boost x%.3f", F.col("boost_multiplier"), digits=3).alias("label"),
        F.lit("boost").alias("type"), boost_v.alias("value"), run.alias("start_at"), (run + boost_v).alias("end_at"))))
    steps.append(F.struct(F.lit(6).alias("step"), F.lit("FINAL").alias("label"), F.lit("total").alias("type"),
                          F.col("risk_score").alias("value"), F.lit(0.0).alias("start_at"), F.col("risk_score").alias("end_at")))
    arr = F.filter(F.array(*steps), lambda r: r.isNotNull())
    x = scored.select(key, F.explode(arr).alias("s"))
    return x.select(key, "s.step", "s.label", "s.type", "s.value", "s.start_at", "s.end_at")


def narrative(scored: DataFrame, key: str = "account_id") -> DataFrame:
    """The regulatory narrative. Note the reference uses >= 60 for 'elevated' here
    while the convergence boost uses > 60."""
    cat = F.col("risk_category")
    cat_text = F.create_map(*[x for kv in CATEGORY_TEXT.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    top = F.element_at(_sorted_desc(_components(scored)), 1)
    opening = F.format_string("This account %s with a composite risk score of %.1f/100 (category: %s). ",
                              cat_text[cat], F.round(F.col("risk_score"), 1), cat)
    comp_name = F.regexp_replace(top["component"], "_", " ")
    raw_dom = F.round(top["raw_score"], 1)
    driver = F.format_string("The primary risk driver is the %s (%s: %.1f/100), which contributes %.1f points "
                             "(%.0f%%) to the final score. ", top["label"], comp_name, raw_dom,
                             F.round(top["contribution"], 1), F.round(top["pct_of_total"], 0))
    elevated = F.array_compact(F.array(*[
        F.when(F.col(c) >= ELEVATED_THRESH,
               F.format_string(f"{COMPONENT_LABELS[c]} (%.0f)", F.round(F.col(c), 0))) for c in COMPONENTS]))
    elev_txt = F.when(F.size(elevated) > 0, F.concat(
        F.lit(f"The following signals are elevated (≥{ELEVATED_THRESH:.0f}): "),
        F.array_join(elevated, ", "), F.lit(". "))).otherwise(F.lit(""))
    added = F.col("boost_multiplier") - 1.0
    highs = F.array_compact(F.array(*[F.when(F.col(f"hs_{c}") > 0, F.lit(COMPONENT_LABELS[c])) for c in COMPONENTS]))
    reasons = F.array_compact(F.array(
        F.when(F.size(highs) > 0, F.concat(F.lit("high-signal thresholds exceeded in "), F.array_join(highs, ", "))),
        F.when(F.col("critical_boost") > 0, F.lit("critical alert threshold exceeded")),
        F.when(F.col("interaction_boost") > 0,
               F.format_string("convergent evidence from %d independent signals", F.col("n_elevated")))))
    boost_txt = F.when(added > 0.01, F.concat(
        F.format_string("The base score of %.1f was amplified by a boost multiplier of %.3f× (total boost: +%.0f%%) due to: ",
                        F.round(F.col("base_score"), 1), F.round(F.col("boost_multiplier"), 3), F.round(added * 100, 0)),
        F.array_join(reasons, "; "), F.lit(". "))).otherwise(F.lit("No signal amplification boosts were triggered. "))
    action = F.concat(F.lit("Recommended action: "), action_expr(cat), F.lit("."))
    return scored.select(key, F.concat(opening, driver, elev_txt, boost_txt, action).alias("narrative"))


def report_json(scored: DataFrame, key: str = "account_id") -> DataFrame:
    """Nested report (inputs, components, boost trace, category, explanation) as JSON text. The explanation block holds the
    component breakdown in order of contribution, the dominant signal and the narrative."""
    parts = _sorted_desc(_components(scored))
    told = narrative(scored, key).select(F.col(key).alias("__key"), "narrative")
    scored = scored.join(told, F.col(key) == F.col("__key")).drop("__key")
    named = F.transform(parts, lambda c: F.struct(c["component"].alias("component"), c["label"].alias("label"), c["raw_score"].alias("raw_score"),
                                                  c["contribution"].alias("contribution"), c["pct_of_total"].alias("pct_of_total")))
    rep = F.struct(
        F.col(key).alias("account_id"), F.col("risk_score").alias("score"), F.col("risk_category").alias("category"),
        action_expr(F.col("risk_category")).alias("category_action"),
        F.struct(*[F.col(c).alias(c) for c in COMPONENTS]).alias("inputs"),
        F.struct(*[F.col(CONTRIB_NAMES[c]).alias(c) for c in COMPONENTS]).alias("components"),
        F.struct(F.col("base_score"), F.col("boost_multiplier"),
                 F.struct(*[F.col(f"hs_{c}").alias(c) for c in COMPONENTS]).alias("high_signal"),
                 F.col("critical_boost").alias("critical_alert"), F.col("interaction_boost").alias("interaction"),
                 F.col("n_elevated")).alias("boost"),
        F.struct(F.element_at(parts, 1)["component"].alias("dominant_signal"), named.alias("component_breakdown"), F.col("narrative")).alias("explanation"))
    return scored.select(key, F.to_json(rep).alias("report"))
