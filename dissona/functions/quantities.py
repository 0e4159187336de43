"""Quantities in sentences, as arrays of structs (metric, value, unit, polarity, scope), all in Spark expressions.

A regular expression finds the numbers; its groups come out as parallel arrays. What stands before each number comes from a split by
the same expression, put together again up to that number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, strip

# Direction verbs by direction, articles, scope and number patterns, unit names.
UP = "grew grow grows growing rose rise rises rising risen increased increase increases increasing gained gain gains gaining expanded expand expands expanding jumped jump jumps jumping surged surge surges surging added adds adding climbed climb climbs climbing".split()
DOWN = "fell fall falls falling fallen declined decline declines declining decreased decrease decreases decreasing dropped drop drops dropping lost lose loses losing shrank shrink shrinks shrinking shrunk contracted contract contracts contracting slid slide slides sliding".split()
ARTICLES = ("the", "a", "an")
SCOPE = r"(?iU)\b(fiscal\s+year\s+\d{4}|fiscal\s+\d{4}|FY\s*\d{2,4}|Q[1-4]\s+\d{4}|H[12]\s+\d{4}|year\s+\d{4}|in\s+\d{4}|during\s+\d{4})\b"
NUMBER = r"(?iU)([$€£])?\s*([+-])?\s*(\d[\d,]*(?:\.\d+)?)\s*(%|percent|basis\s*points|bps|million|billion|thousand|dollars?|euros?|pounds?)?"
UNITS = {"%": "percent", "percent": "percent", "bps": "basis_points", "basis points": "basis_points", "basispoints": "basis_points", "million": "million", "billion": "billion", "thousand": "thousand", "dollars": "usd", "dollar": "usd", "euros": "eur", "euro": "eur", "pounds": "gbp", "pound": "gbp"}
CURRENCIES = {"$": "usd", "€": "eur", "£": "gbp"}
MAGNITUDES = ("million", "billion", "thousand")
TYPE = "array<struct<metric:string,value:double,unit:string,polarity:string,scope:string>>"
_SPACE = r"(?U)\s+"


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def _scope(found: Column) -> Column:
    return F.when(found != "", F.regexp_replace(F.regexp_replace(F.lower(strip(found)), _SPACE, " "), "^(in|during) ", ""))


def _masked(x: Column | str, found: Column) -> Column:
    return F.when(found == "", col(x)).otherwise(F.overlay(col(x), F.repeat(F.lit(" "), F.length(found)), F.call_function("locate", found, col(x))))


def scope_of(x: Column | str) -> Column:
    """The first time phrase, lower case, without in or during; null without one."""
    return let(F.regexp_extract(col(x), SCOPE, 1), _scope)


def masked(x: Column | str) -> Column:
    """The text with its first time phrase blanked, at the same length."""
    return let(F.regexp_extract(col(x), SCOPE, 1), lambda found: _masked(x, found))


def unit_of(unit: Column, currency: Column) -> Column:
    """A unit's name; magnitudes take the currency with them, which alone is a unit too."""
    money = F.try_element_at(_map(CURRENCIES), currency)
    named = let(F.try_element_at(_map(UNITS), F.regexp_replace(F.lower(strip(unit)), _SPACE, " ")), lambda name: F.when(name.isin(*MAGNITUDES) & money.isNotNull(), F.concat_ws("_", name, money)).otherwise(name))
    return F.when(unit == "", money).otherwise(named)


def metric_of(x: Column) -> Column:
    """Lower-case words without marks around them and without articles."""
    words = F.transform(F.split(F.lower(x), _SPACE), lambda w: F.regexp_replace(w, r"^[.,;:()]+|[.,;:()]+$", ""))
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*ARTICLES)), " ")


def extract_quantities(x: Column | str) -> Column:
    """All quantities of a sentence; an empty array where there are none or the sentence is null.

    With a direction verb: the subject is the metric, numbers of the predicate count, the sign or else the verb is the polarity.
    Without: the metric is what stands before a number, and a number needs a unit or a sign.
    """
    none = F.array().cast(TYPE)

    def split_at_verb(t: Column) -> Column:
        words = F.filter(F.split(t["text"], _SPACE), lambda w: w != "")
        return let(F.struct(t["scope"].alias("scope"), t["text"].alias("text"), words.alias("words")), lambda u: let(F.array_position(F.transform(u["words"], lambda w: F.lower(F.regexp_replace(w, "^[.,;:()'\"`]+|[.,;:()'\"`]+$", "")).isin(*UP, *DOWN)), True).cast("int"), lambda at: sides(u, at)))

    def sides(u: Column, at: Column) -> Column:
        verb = F.lower(F.regexp_replace(F.try_element_at(u["words"], F.when(at > 0, at)), "^[.,;:()'\"`]+|[.,;:()'\"`]+$", ""))
        direction = let(verb, lambda v: F.when(v.isin(*UP), "up").when(v.isin(*DOWN), "down").otherwise("none"))
        subject = F.regexp_replace(F.array_join(F.slice(u["words"], F.lit(1), F.greatest(at - 1, F.lit(0))), " "), "[.,;:]+$", "")
        source = F.when(at > 0, F.array_join(F.slice(u["words"], at + 1, F.size(u["words"])), " ")).otherwise(u["text"])
        return let(F.struct(u["scope"].alias("scope"), source.alias("source"), F.when(at > 0, metric_of(subject)).alias("subject"), direction.alias("direction")), numbers)

    def numbers(v: Column) -> Column:
        group = lambda i: F.regexp_extract_all(v["source"], F.lit(NUMBER), F.lit(i))
        parts = F.struct(v["scope"].alias("scope"), v["subject"].alias("subject"), v["direction"].alias("direction"), group(3).alias("values"), group(2).alias("signs"), group(4).alias("units"), group(1).alias("money"), F.when(v["subject"].isNull(), group(0)).alias("wholes"), F.when(v["subject"].isNull(), F.split(v["source"], NUMBER)).alias("pieces"))
        return let(parts, lambda n: F.when(F.size(n["values"]) > 0, F.transform(F.sequence(F.lit(0), F.size(n["values"]) - 1), lambda i: one(n, i))).otherwise(none))

    def one(n: Column, i: Column) -> Column:
        lead = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), i), lambda j: F.array(F.get(n["pieces"], j), F.when(j < i, F.get(n["wholes"], j)).otherwise("")))), "")
        sign = F.get(n["signs"], i)
        return F.struct(
            F.coalesce(n["subject"], metric_of(lead)).alias("metric"),
            F.replace(F.get(n["values"], i), F.lit(",")).try_cast("double").alias("value"),
            unit_of(F.get(n["units"], i), F.get(n["money"], i)).alias("unit"),
            F.when(sign == "+", "pos").when(sign == "-", "neg").otherwise(n["direction"]).alias("polarity"),
            n["scope"].alias("scope"),
        )

    found = let(F.regexp_extract(col(x), SCOPE, 1), lambda f: let(F.struct(_scope(f).alias("scope"), _masked(x, f).alias("text")), split_at_verb))
    kept = F.filter(found.cast(TYPE), lambda q: q["value"].isNotNull() & (q["metric"] != "") & (q["unit"].isNotNull() | (q["polarity"] != "none")))
    return F.when(col(x).rlike(r"(?U)\d"), kept).otherwise(none)


def same_subject(a: Column, b: Column) -> Column:
    """Equal metric, and equal scope and unit where none equals none."""
    return (a["metric"] == b["metric"]) & a["scope"].eqNullSafe(b["scope"]) & a["unit"].eqNullSafe(b["unit"])


def opposite(a: Column, b: Column) -> Column:
    """One goes up and the other down."""
    up, down = ("up", "pos"), ("down", "neg")
    return (a["polarity"].isin(*up) & b["polarity"].isin(*down)) | (a["polarity"].isin(*down) & b["polarity"].isin(*up))


def is_sign_flip(a: Column, b: Column) -> Column:
    return same_subject(a, b) & opposite(a, b)


def relative_difference(a: Column, b: Column) -> Column:
    return F.try_divide(F.abs(a["value"] - b["value"]), F.greatest(F.abs(a["value"]), F.abs(b["value"])))


def sign_flips(a: Column | str, b: Column | str) -> Column:
    """The pairs of quantities of two arrays that flip, in the order of a, then b."""
    return F.flatten(F.transform(col(a), lambda x: F.transform(F.filter(col(b), lambda y: is_sign_flip(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def value_disagreements(a: Column | str, b: Column | str, threshold: float = 0.10) -> Column:
    """The pairs of one subject, without a flip, whose values differ by the threshold or more. A negative threshold raises."""
    if threshold < 0:
        raise ValueError("the threshold can't be negative")
    differ = lambda x, y: same_subject(x, y) & ~is_sign_flip(x, y) & F.coalesce(relative_difference(x, y) >= threshold, F.lit(False))
    return F.flatten(F.transform(col(a), lambda x: F.transform(F.filter(col(b), lambda y: differ(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def number_text(x: Column) -> Column:
    """A double as 12.0 or 12.5, without an exponent."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e16), F.concat(F.floor(x).cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(x.cast("string"))


def short_circuit(flips: Column | str) -> Column:
    """A verdict without a judge from the first flip: struct of verdict, rationale, evidence_spans; null without a flip."""
    first = F.get(col(flips), F.lit(0))
    a, b, unit = first["a"], first["b"], F.coalesce(first["a"]["unit"], F.lit(""))
    va, vb = F.concat(number_text(a["value"]), unit), F.concat(number_text(b["value"]), unit)
    rationale = F.concat(F.lit("Numeric short-circuit: metric="), a["metric"], F.lit(", A="), va, F.lit(", B="), vb, F.lit(", polarity mismatch."))
    return F.when(F.size(col(flips)) > 0, F.struct(F.lit("numeric_short_circuit").alias("verdict"), rationale.alias("rationale"), F.array(va, vb).alias("evidence_spans")))


def numeric_context(disagreements: Column | str) -> Column:
    """A line for each disagreement, null without any."""
    line = lambda d: F.concat(F.lit("metric="), d["a"]["metric"], F.lit(": A="), number_text(d["a"]["value"]), F.lit(", B="), number_text(d["b"]["value"]), F.coalesce(F.concat(F.lit(" "), d["a"]["unit"]), F.lit("")), F.coalesce(F.concat(F.lit(" ("), d["a"]["scope"], F.lit(")")), F.lit("")))
    return F.when(F.size(col(disagreements)) > 0, F.array_join(F.transform(col(disagreements), line), "\n"))
