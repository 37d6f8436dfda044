"""Text functions as Column expressions: tokens, surfaces, types, responses, prompts. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokenizer's pattern, with its word characters spelled out as Unicode classes.
TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:[-‑'][\p{L}\p{M}\p{N}_]+)*|[^\p{L}\p{M}\p{N}_\s]"
# Tokens that take no space before or after them.
TIGHT_BEFORE = [".", ",", ";", ":", "!", "?", ")", "]", "}", "%", "'s"]
TIGHT_AFTER = ["(", "[", "{"]
# Label aliases of IOB files.
LABEL_ALIASES = {
    "imagingprocedure": "imaging_procedure",
    "examinationprocedure": "examination_procedure",
    "therapeuticprocedure": "therapeutic_procedure",
    "imagingresult": "imaging_result",
    "examinationmeasure": "examination_measure",
    "adverseevent": "adverse_event",
    "chemical": "substance",
    "drug": "substance",
    "medication": "substance",
    "procedure": "therapeutic_procedure",
    "treatment": "therapy",
    "quantitative_measure": "parameter",
    "quantitativemeasure": "parameter",
    "measure": "parameter",
}
# The closed entity types.
ENTITY_TYPES = ["disease", "symptom", "finding", "organ", "imaging_procedure", "examination_procedure", "therapeutic_procedure", "imaging_result", "examination_measure", "parameter", "score", "therapy", "substance", "adverse_event"]


def _map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def tokenize(text: Column) -> Column:
    """Words with inner hyphens or apostrophes, and single signs."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def detokenize(tokens: Column) -> Column:
    """Tokens joined by spaces, none before closing signs nor after opening ones."""
    tight = F.array(*[F.lit(t) for t in TIGHT_BEFORE])

    def step(out: Column, token: Column) -> Column:
        opened = F.lit(False)
        for sign in TIGHT_AFTER:
            opened = opened | F.endswith(out, F.lit(sign))
        return F.when(F.array_contains(tight, token) | opened, F.concat(out, token)).otherwise(F.concat(out, F.lit(" "), token))

    rest = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.when(F.size(tokens) > 0, F.aggregate(rest, F.try_element_at(tokens, F.lit(1)), step)).otherwise("")


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def mention_text(tokens: Column, start: Column, end: Column) -> Column:
    """The tokens of a half-open span."""
    return F.array_join(F.slice(tokens, start + 1, end - start), " ")


def normalize_mention(text: Column) -> Column:
    """Lower case, plain hyphens, single spaces: the key of surfaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "‑–", "--"), r"(?U)\s+", " "))


def normalize_tokens(tokens: Column) -> Column:
    """normalize_mention of every token, by one pass over the joined tokens."""
    joined = F.array_join(tokens, "\u0001", "")
    joined = F.regexp_replace(F.translate(F.lower(joined), "‑–", "--"), r"(?U)\s+", " ")
    return F.when(F.size(tokens) > 0, F.transform(F.split(joined, "\u0001"), F.trim)).otherwise(F.array().cast("array<string>"))


def normalize_label(text: Column) -> Column:
    """Lower-case ASCII letters, digits and single spaces: the key of graph labels. Other letters vanish."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""), r"\s+", " "))


def normalize_domain(domain: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(domain)), " ", "")


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), r"([a-z0-9])(?=[A-Z])", "$1_"), r"[\s\-]+", "_"))


def normalize_entity_type(name: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """One of the closed types, or null."""
    key = snake_case(name)
    if aliases:
        key = F.coalesce(F.element_at(_map(aliases), key), key)
    return F.when(key.isin(*ENTITY_TYPES), key)


def normalize_relation_type(name: Column) -> Column:
    return F.coalesce(snake_case(name), F.lit(""))


def normalize_iob_label(label: Column) -> Column:
    """Upper-case prefix, snake-case type with aliases; what is no B- or I- label stays."""
    prefix = F.upper(F.substring(label, 1, 2))
    kind = F.lower(F.regexp_replace(F.substring(label, 3, 1 << 30), r"(?<!^)(?=[A-Z])", "_"))
    kind = F.coalesce(F.element_at(_map(LABEL_ALIASES), kind), kind)
    return F.when(label.isin("O", "o"), "O").when(prefix.isin("B-", "I-"), F.concat(prefix, kind)).otherwise(label)


def case_insensitive(name: Column, canonical: Mapping[str, str]) -> Column:
    """The canonical spelling of a type, or null."""
    return F.element_at(_map({k.strip().lower(): v for k, v in canonical.items()}), F.lower(F.trim(name)))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of the text between two spaces and one."""
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def uri_local_name(uri: Column) -> Column:
    return F.element_at(F.split(uri, "[#/]"), -1)


def has_alphanumeric(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def parse_response(content: Column) -> Column:
    """struct(entities array<struct<text, type, confidence, normalized_form>>, error) of a model's JSON answer.

    What is no JSON is tried again from its first to its last brace. Errors: empty, invalid_json, no_entities_field.
    """
    whole = F.try_parse_json(content)
    inner = F.try_parse_json(F.nullif(F.regexp_extract(content, r"(?s)\{.*\}", 0), F.lit("")))
    data = F.coalesce(whole, inner)
    found = F.try_variant_get(data, "$.entities", "array<variant>")
    entities = F.transform(
        F.filter(found, lambda e: F.schema_of_variant(e).startswith("OBJECT")),
        lambda e: F.struct(
            F.try_variant_get(e, "$.text", "string").alias("text"),
            F.try_variant_get(e, "$.type", "string").alias("type"),
            confidence(e).alias("confidence"),
            F.try_variant_get(e, "$.normalized_form", "string").alias("normalized_form"),
        ),
    )
    error = F.when(F.coalesce(content, F.lit("")) == "", "empty").when(data.isNull(), "invalid_json").when(found.isNull(), "no_entities_field")
    return F.struct(F.when(error.isNull(), entities).alias("entities"), error.alias("error"))


def confidence(entity: Column) -> Column:
    """A number (no truth value) between 0 and 1, or null."""
    raw = F.try_variant_get(entity, "$.confidence", "variant")
    number = F.schema_of_variant(raw).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(number, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_variant_get(entity, "$.confidence", "double"))))


def content_hash(*parts: Column) -> Column:
    """sha256 of parts that are joined by NUL."""
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def row_json(*columns: str) -> Column:
    """A row as JSON, for sinks and hashes."""
    return F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})


def gold_answer(tokens: Column, spans: Column) -> Column:
    """The answer a demonstration shows: distinct mentions in order, as JSON."""
    mentions = F.array_distinct(F.transform(spans, lambda x: F.struct(mention_text(tokens, x["s"], x["e"]).alias("text"), x["type"].alias("type"))))
    return F.to_json(F.struct(mentions.alias("entities")))


def render_fact(surface: Column, types: Column, non_entity: Column, label: Column | None = None) -> Column:
    """One retrieved fact as a line: types by falling count, occurrences outside mentions, and the closest form."""
    by_count = F.array_sort(F.map_entries(types), lambda x, y: y["value"].cast("int") - x["value"].cast("int"))
    seen = F.array_join(F.transform(by_count, lambda x: F.format_string("%s (%sx)", x["key"], x["value"].cast("string"))), ", ")
    line = F.concat(F.lit('"'), surface, F.lit('": annotated as '), seen)
    line = F.concat(line, F.when(non_entity > 0, F.format_string("; seen %sx outside mentions", non_entity.cast("string"))).otherwise(""))
    return line if label is None else F.concat(line, F.coalesce(F.concat(F.lit("; closest known form: "), label), F.lit("")))


def render_messages(messages: Column) -> Column:
    """array<struct<role, content>> as plain text."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("]\n"), m["content"])), "\n\n")


def build_messages(system: Column, facts: Column, demonstrations: Column, query: Column) -> Column:
    """array<struct<role, content>>: system text with facts as bullets, demonstration turns, the query.

    demonstrations: array<struct<text, answer>>.
    """
    bullets = F.when(F.size(facts) > 0, F.concat(F.lit("\n\nKnown facts:\n"), F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f)), "\n"))).otherwise("")

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    turns = F.flatten(F.transform(demonstrations, lambda d: F.array(message("user", d["text"]), message("assistant", d["answer"]))))
    return F.concat(F.array(message("system", F.concat(system, bullets))), turns, F.array(message("user", query)))
