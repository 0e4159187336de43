"""Structured answers of model vendors, as columns: the named tool's payload, checked against its shape. What doesn't fit raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Verdicts that a model may give.
JUDGE_VERDICTS = ("contradiction", "not_contradiction", "uncertain")
DEFINITION_VERDICTS = ("definition_consistent", "definition_divergent", "uncertain")
MULTI_VERDICTS = ("multi_party_contradiction", "not_contradiction", "uncertain")
DEFINITION = "struct<term:string,definition_text:string,containing_sentence:string>"


def tool_payload(response: Column | str, tool: str) -> Column:
    """The input (JSON) of the first block of type tool_use with this name; without one, raises."""
    blocks = F.from_json(col(response), "struct<content:array<struct<type:string,name:string,input:string>>>")["content"]
    found = F.filter(F.coalesce(blocks, F.array().cast("array<struct<type:string,name:string,input:string>>")), lambda b: (b["type"] == "tool_use") & (b["name"] == tool))
    return F.when(F.size(found) > 0, F.coalesce(F.get(found, F.lit(0))["input"], F.lit("{}"))).otherwise(F.raise_error(F.lit(f"no tool_use block named {tool} in the response")))


def _is(value: Column, *kinds: str) -> Column:
    """Whether a variant has one of these types."""
    return F.coalesce(F.schema_of_variant(value).isin(*kinds), F.lit(False))


def _strings(value: Column) -> Column:
    """An array of strings from a variant; an empty one where it is missing, null where it is something else."""
    kept = F.when(_is(value, "ARRAY<STRING>", "ARRAY<VOID>"), F.coalesce(F.try_variant_get(value, "$", "array<string>"), F.array().cast("array<string>")))
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(kept)


def _checked(value: Column, what: str, json: Column) -> Column:
    """value; null raises."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"not a payload, {what}: "), F.coalesce(F.substring(json, 1, 200), F.lit("null")))))


def extraction_payload(json: Column | str) -> Column:
    """STRUCT<assertions, definitions> of an extractor's answer; either may be missing. Other types, or an empty part of a definition, raise."""
    json = col(json)
    v = F.try_parse_json(json)
    parts = F.from_json(json, "struct<definitions:array<struct<term:variant,definition_text:variant,containing_sentence:variant>>>")["definitions"]
    raw = F.try_variant_get(v, "$.definitions", "variant")
    text = lambda x: F.coalesce(_is(x, "STRING") & (F.try_variant_get(x, "$", "string") != ""), F.lit(False))
    fits = raw.isNull() | (F.schema_of_variant(raw).startswith("ARRAY") & parts.isNotNull() & F.forall(parts, lambda d: d.isNotNull() & text(d["term"]) & text(d["definition_text"]) & text(d["containing_sentence"])))
    definitions = F.when(fits, F.coalesce(F.from_json(json, f"struct<definitions:array<{DEFINITION}>>")["definitions"], F.array().cast(f"array<{DEFINITION}>")))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    assertions = F.when(is_object, _strings(F.try_variant_get(v, "$.assertions", "variant")))
    return F.struct(_checked(assertions, "assertions", json).alias("assertions"), _checked(definitions, "definitions", json).alias("definitions"))


def verdict_payload(json: Column | str, verdicts: tuple[str, ...] = JUDGE_VERDICTS, *, subset: bool = False) -> Column:
    """STRUCT<verdict, rationale, evidence_spans> of a judge's answer, with contradicting_subset (of A, B, C) if asked for.

    A verdict outside the list, an empty rationale, parts of another type and further parts raise.
    """
    json = col(json)
    v = F.try_parse_json(json)
    allowed = ["verdict", "rationale", "evidence_spans", *(["contradicting_subset"] if subset else [])]
    known = F.coalesce(F.size(F.array_except(F.json_object_keys(json), F.array(*map(F.lit, allowed)))) == 0, F.lit(False))
    get = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    verdict = F.when(known & get("verdict", "string").isin(*verdicts), get("verdict", "string"))
    rationale = F.when(_is(get("rationale", "variant"), "STRING") & (get("rationale", "string") != ""), get("rationale", "string"))
    out = [_checked(verdict, "verdict", json).alias("verdict"), _checked(rationale, "rationale", json).alias("rationale"), _checked(_strings(get("evidence_spans", "variant")), "evidence_spans", json).alias("evidence_spans")]
    if subset:
        letters = _strings(get("contradicting_subset", "variant"))
        out.append(_checked(F.when(F.forall(letters, lambda x: x.isin("A", "B", "C")), letters), "contradicting_subset", json).alias("contradicting_subset"))
    return F.struct(*out)


def organisation_payload(json: Column | str) -> Column:
    """STRUCT<label, reason> of an answer on a document's organisation: a label, or null, and org_found or no_org."""
    json = col(json)
    v = F.try_parse_json(json)
    label, reason = F.try_variant_get(v, "$.label", "variant"), F.try_variant_get(v, "$.reason", "string")
    there = F.coalesce(F.array_contains(F.json_object_keys(json), "label"), F.lit(False))
    fits = there & reason.isin("org_found", "no_org") & (label.isNull() | _is(label, "STRING", "VOID"))
    return _checked(F.when(fits, F.struct(F.try_variant_get(v, "$.label", "string").alias("label"), reason.alias("reason"))), "organisation", json)
