"""The five-criterion scorecard of annotated entities as Column expressions, its decisions, explanations and baselines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRITERIA = ("congruence", "coverage", "constraint", "completeness", "consistency")
# Default weights, thresholds and settings.
WEIGHTS = {"congruence": 0.25, "coverage": 0.15, "constraint": 0.25, "completeness": 0.15, "consistency": 0.20}
THRESHOLDS = {"pass": 0.75, "review": 0.50}
SETTINGS = {
    "congruence_min_similarity": 0.7,
    "congruence_exact_match_bonus": 0.2,
    "coverage_novelty_threshold": 3,
    "coverage_novelty_bonus": 0.3,
    "constraint_min_length": 2,
    "constraint_max_length": 200,
    "constraint_violation_penalty": 0.25,
    "completeness_optional_weight": 0.15,
    "consistency_agreement_bonus": 0.3,
    "consistency_base_score": 0.5,
}
EXACT, NOVEL, CAP = 0.95, 0.8, 0.8
# Word lists of the type heuristics.
POPULATION = ["patients", "subjects", "individuals", "participants", "cohort", "group", "male", "female", "adults", "children", "men", "women", "cases", "controls"]
FINDING = ["pain", "ache", "fever", "cough", "symptom", "sign", "elevated", "decreased", "abnormal", "normal", "positive", "negative", "swelling", "rash", "bleeding", "dysfunction"]
GENERIC = ["the", "a", "an", "this", "that"]
NUMERIC_TYPES = ["examination_measure", "parameter", "score"]


def check_config(weights: Mapping[str, float], thresholds: Mapping[str, float], settings: Mapping[str, float]) -> None:
    """Raise ValueError where a configuration could lead out of [0, 1]."""
    if any(w is None or not 0 <= w <= 1 for w in weights.values()):
        raise ValueError("each weight lies between 0 and 1")
    if abs(sum(weights.values()) - 1) > 0.01:
        raise ValueError("weights add up to 1")
    if not 0 <= thresholds["review"] < thresholds["pass"] <= 1:
        raise ValueError("thresholds: 0 <= review < pass <= 1")
    for k, v in settings.items():
        if not k.endswith(("_length", "_threshold")) and not 0 <= v <= 1:
            raise ValueError(f"{k} lies between 0 and 1")
    if settings["coverage_novelty_bonus"] > 0.5:
        raise ValueError("coverage_novelty_bonus is 0.5 at most")
    if settings["coverage_novelty_threshold"] < 1 or not 1 <= settings["constraint_min_length"] < settings["constraint_max_length"]:
        raise ValueError("novelty threshold and lengths are positive, the shortest below the longest")


def with_defaults(given: Mapping[str, float | None] | None) -> dict:
    """A stored configuration with defaults where it has nulls or nothing."""
    return {k: v if (given or {}).get(k) is None else given[k] for k, v in SETTINGS.items()}


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def congruence(best: Column, settings: Mapping = SETTINGS) -> Column:
    """best: the highest similarity to a known label; 0.5 where none is near enough."""
    near = best >= settings["congruence_min_similarity"]
    return F.when(F.coalesce(near, F.lit(False)), F.when(best >= EXACT, F.least(F.lit(1.0), best + settings["congruence_exact_match_bonus"])).otherwise(best)).otherwise(0.5)


def coverage(matches: Column, best: Column, settings: Mapping = SETTINGS) -> Column:
    """matches: how many labels are similar at all."""
    bonus, few = settings["coverage_novelty_bonus"], matches < settings["coverage_novelty_threshold"]
    return (
        F.when(matches == 0, 0.5 + bonus).when(few & (best < NOVEL), 0.5 + bonus * 0.7).when(few, 0.5).otherwise(F.greatest(F.lit(0.3), 0.6 - 0.3 * best))
    )


def type_violations(text: Column, kind: Column) -> Column:
    """Names of the type heuristics that a text breaks."""
    low = F.lower(F.trim(text))
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    n, people = F.size(words), F.size(F.filter(words, lambda w: w.isin(*POPULATION)))
    described = kind.isin("finding", "disease", "substance")
    found = [
        F.when(described & ((people >= 2) | ((n > 5) & (people >= 1))), "population"),
        F.when(described & (n > 8), "too_complex"),
        F.when((kind == "finding") & (n > 4) & ~low.rlike("|".join(FINDING)) & low.contains("with"), "uncertain_finding"),
        F.when((kind == "substance") & low.isin(*GENERIC), "generic_substance"),
        F.when((kind == "disease") & low.rlike("patient|subject"), "patient_reference"),
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def constraint(text: Column, kind: Column, settings: Mapping = SETTINGS) -> Column:
    """struct(score, violations, type_valid). kind: a canonical type, or null if the type is unknown."""
    t = F.trim(text)
    size, shortest, penalty = F.length(t), settings["constraint_min_length"], settings["constraint_violation_penalty"]
    numeric = ~F.coalesce(kind.isin(*NUMERIC_TYPES), F.lit(False)) & t.rlike(r"^[\d\s.,-]+$")
    rules = [
        (kind.isNull(), "invalid_type", F.lit(0.3)),
        (size < shortest, "too_short", 0.2 + 0.6 * (1 - size / shortest)),
        (size > settings["constraint_max_length"], "too_long", F.lit(0.1)),
        ((size <= 2) & ~t.rlike(r"^[\p{L}\p{N}]+$"), "single_sign", F.lit(0.5)),
        (text.rlike(r"[<>{}|\[\]\\]"), "invalid_characters", F.lit(penalty)),
        (numeric, "only_numeric", F.lit(0.2)),
    ]
    own = F.filter(F.array(*[F.when(c, n) for c, n, _ in rules]), lambda x: x.isNotNull())
    by_type = F.coalesce(type_violations(text, kind), F.array().cast("array<string>"))
    lost = sum((F.when(c, cost).otherwise(0.0) for c, _, cost in rules), F.lit(0.0)) + penalty * F.size(by_type)
    return F.struct(_unit(1 - lost).alias("score"), F.concat(own, by_type).alias("violations"), kind.isNotNull().alias("type_valid"))


def completeness(fields: Mapping[str, Column], required: Sequence[str] = ("type", "text"), settings: Mapping = SETTINGS) -> Column:
    """Share of required fields, and of the others with the optional weight. fields: name -> is it there. A required field that isn't among them is missing."""

    def share(names: Sequence[str]) -> Column:
        return sum((F.coalesce(fields[n].cast("int"), F.lit(0)) if n in fields else F.lit(0) for n in names), F.lit(0)) / F.lit(float(len(names))) if names else F.lit(1.0)

    w = settings["completeness_optional_weight"]
    return share(list(required)) * (1 - w) + share([f for f in fields if f not in required]) * w


def consistency(confidence: Column, agreed: Column, p: Column, settings: Mapping = SETTINGS) -> Column:
    """agreed: whether a second classifier found the same type; null where it abstained or wasn't asked."""
    c, bonus = F.coalesce(confidence, F.lit(settings["consistency_base_score"])), settings["consistency_agreement_bonus"]
    capped = F.least(F.lit(CAP), c)
    score = F.when(agreed, F.least(F.lit(1.0), c + bonus * p)).when(~agreed, F.greatest(F.lit(0.0), capped - bonus * 0.75 * p)).otherwise(capped)
    return _unit(score)


def overall(weights: Mapping[str, float] = WEIGHTS, drop: Sequence[str] = (), digits: int = 3) -> Column:
    """Weighted mean of the criteria (columns) that were assessed, with weights scaled anew. Half up counts from nine digits, since sums of weights miss ties by their last bits."""
    kept = [c for c in CRITERIA if c not in drop]
    total = sum(F.when(F.col(c).isNotNull(), F.lit(float(weights[c]))).otherwise(0.0) for c in kept)
    value = sum(F.coalesce(F.col(c) * float(weights[c]), F.lit(0.0)) for c in kept)
    return F.round(F.round(_unit(F.when(total > 0, value / total).otherwise(0.0)), 9), digits)


def review(score: Column, constraint_score: Column, type_valid: Column, agreed: Column, congruence_score: Column, thresholds: Mapping = THRESHOLDS) -> Column:
    """struct(status, recommendation) as a reviewer gives them: only scores below half of the review threshold fail."""

    def both(status: str, advice: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(advice).alias("recommendation"))

    middle = score >= thresholds["review"]
    return (
        F.when((constraint_score < 0.4) | ~type_valid, both("failed", "reject"))
        .when(score >= thresholds["pass"], both("passed", "approve"))
        .when(middle & F.coalesce(~agreed, F.lit(False)), both("needs_review", "verify_type"))
        .when(middle & F.coalesce(congruence_score > 0.95, F.lit(False)), both("needs_review", "check_duplicate"))
        .when(~middle & (score < thresholds["review"] / 2), both("failed", "reject"))
        .otherwise(both("needs_review", "manual_review"))
    )


def decide(score: Column, constraint_score: Column, type_valid: Column, thresholds: Mapping = THRESHOLDS) -> Column:
    """The decision that analyses use: everything below the review threshold fails."""
    return F.when((constraint_score < 0.4) | ~type_valid, "failed").when(score >= thresholds["pass"], "passed").when(score >= thresholds["review"], "needs_review").otherwise("failed")


def mean_scorecard(rows: DataFrame, group: Sequence[str] = (), weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """group, n, the mean of each criterion where it was assessed, ``overall`` (weighted mean of these means) and the share of each decision (column ``decision``)."""
    shares = [F.avg((F.col("decision") == d).cast("double")).alias(d) for d in ("passed", "needs_review", "failed")]
    means = rows.groupBy(*group).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in CRITERIA], *shares)
    return means.withColumn("overall", overall(weights, digits=6))


def explain(score: Column, weights: Mapping[str, float] = WEIGHTS) -> Column:
    """One line for each criterion and the overall score."""
    lines = [F.concat(F.lit(f"{c} (weight {weights[c]:.2f}): "), F.coalesce(F.format_number(c, 3), F.lit("not assessed"))) for c in CRITERIA]
    return F.concat_ws("\n", F.concat(F.lit("overall: "), F.format_number(score, 3)), *lines)


def cross_check(entities: DataFrame, predictions: DataFrame) -> DataFrame:
    """entities (text, kind) with bert_status, agreed, p: the most confident prediction (first on ties) for the same text.

    predictions: text, pred_type, p, pos. A text without predictions means that the classifier abstained; an unknown type is not compared.
    """
    best = predictions.groupBy("text").agg(F.min_by(F.struct("pred_type", "p"), F.struct(-F.col("p"), F.col("pos"))).alias("b")).select("text", "b.*")
    rows = entities.join(best, "text", "left")
    status = F.when(F.col("kind").isNull(), "unavailable: entity type is not a project type").when(F.col("p").isNull(), "abstained").when(F.col("pred_type") == F.col("kind"), "agreed").otherwise("disagreed")
    rows = rows.withColumn("bert_status", status)
    return rows.withColumn("agreed", F.when(F.col("bert_status") == "agreed", True).when(F.col("bert_status") == "disagreed", False))


def scorecard(df: DataFrame, weights: Mapping[str, float] = WEIGHTS, settings: Mapping = SETTINGS, thresholds: Mapping = THRESHOLDS) -> DataFrame:
    """Adds the five criteria, overall, status and recommendation to rows with text, kind, kg_matches, kg_best, confidence, agreed, p, context, normalized_form.

    kg_matches null: the graph could not be asked, so congruence and coverage are not assessed.
    """
    asked = F.col("kg_matches").isNotNull()
    fields = {
        "type": F.col("kind").isNotNull(),
        "text": F.length(F.trim("text")) >= settings["constraint_min_length"],
        "context": F.coalesce(F.col("context"), F.lit("")) != "",
        "normalized_form": F.coalesce(F.col("normalized_form"), F.lit("")) != "",
        "confidence": F.col("confidence").isNotNull(),
    }
    rows = df.withColumn("__c", constraint(F.col("text"), F.col("kind"), settings)).withColumns(
        {
            "congruence": F.when(asked, congruence(F.col("kg_best"), settings)),
            "coverage": F.when(asked, coverage(F.col("kg_matches"), F.coalesce("kg_best", F.lit(0.0)), settings)),
            "constraint": F.col("__c.score"),
            "completeness": completeness(fields, settings=settings),
            "consistency": consistency(F.col("confidence"), F.col("agreed"), F.col("p"), settings),
            "violations": F.col("__c.violations"),
            "type_valid": F.col("__c.type_valid"),
        }
    )
    rows = rows.withColumn("overall", overall(weights))
    rows = rows.withColumn("__r", review(F.col("overall"), F.col("constraint"), F.col("type_valid"), F.col("agreed"), F.col("congruence"), thresholds))
    return rows.select("*", "__r.status", "__r.recommendation").drop("__c", "__r")


def ablation(df: DataFrame, label: str = "y", weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """dropped, auroc: the overall score with all criteria ('none') and without each of them. One grouped plan."""
    from .stats import auroc

    variants = [F.struct(F.lit("none").alias("dropped"), overall(weights).alias("s"))] + [F.struct(F.lit(c).alias("dropped"), overall(weights, [c]).alias("s")) for c in CRITERIA]
    return auroc(df.select(label, F.inline(F.array(*variants))), "s", label, ["dropped"])


def baselines(confidence: Column, agreed: Column, p: Column, stratum: Column) -> list[Column]:
    """b0: confidence, 0.5 if missing; b1: signed probability of the second classifier; b2: seen with this type."""
    return [
        F.coalesce(confidence, F.lit(0.5)).alias("b0"),
        F.when(agreed, F.coalesce(p, F.lit(0.0))).when(~agreed, -F.coalesce(p, F.lit(0.0))).otherwise(0.0).alias("b1"),
        (stratum == "A_seen_same_type").cast("double").alias("b2"),
    ]


def compare_scorers(df: DataFrame, scorers: Sequence[str], label: str = "y", group: Sequence[str] = ()) -> DataFrame:
    """scorer, auroc, pr_auc for each group, all scorers in one plan."""
    from .stats import auroc, average_precision

    long = df.select(*group, label, F.inline(F.array(*[F.struct(F.lit(s).alias("scorer"), F.col(s).cast("double").alias("v")) for s in scorers])))
    keys = [*group, "scorer"]
    return auroc(long, "v", label, keys).join(average_precision(long, "v", label, keys), keys)
