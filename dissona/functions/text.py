"""Text measures, labels and formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = r"[^\p{L}]"
SPACE = r"(?U)\s"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: inside a lambda an expression would be computed at each of its places."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(x: Column | str, chars: str = SPACE) -> Column:
    """Without characters of a class at both ends."""
    return F.regexp_replace(col(x), f"^{chars}+|{chars}+$" if not chars.startswith("(?U)") else f"(?U)^{chars[4:]}+|{chars[4:]}+\\z", "")


def alpha_count(x: Column | str) -> Column:
    return F.length(F.regexp_replace(col(x), LETTERS, ""))


def alpha_ratio(x: Column | str) -> Column:
    """Letters per character; 0 for an empty text."""
    return F.coalesce(F.try_divide(alpha_count(x).cast("double"), F.length(col(x))), F.when(col(x).isNotNull(), F.lit(0.0)))


def looks_empty(x: Column | str, least: int = 100) -> Column:
    return alpha_count(x) < least


def needs_ocr(text: Column | str, pages: Column | str, size: Column | str) -> Column:
    """Too little text for a file of two pages and 100 kB or more."""
    return looks_empty(text) & (col(pages) >= 2) & (col(size) >= 100_000)


def newlines(x: Column | str) -> Column:
    """Line ends as \\n, as a text-mode read gives them."""
    return F.regexp_replace(col(x), "\r\n?", "\n")


def doc_label(title: Column | str, path: Column | str, doc_id: Column | str) -> Column:
    """Title, else path, else id; an empty string counts as missing."""
    return F.coalesce(F.nullif(col(title), F.lit("")), F.nullif(col(path), F.lit("")), col(doc_id).cast("string"))


def truncated(x: Column | str, n: int) -> Column:
    return F.when(F.length(col(x)) > n, F.concat(F.substring(col(x), 1, n - 1), F.lit("…"))).otherwise(col(x))


def slug(x: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(col(x), "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", ""))


def score_text(x: Column | str) -> Column:
    """Two decimals, or a dash where there is no score."""
    return F.when(col(x).isNull(), F.lit("—")).otherwise(F.bround(col(x).cast("decimal(38,18)"), 2).cast("decimal(38,2)").cast("string"))


def quoted_spans(x: Column | str) -> Column:
    return F.array_join(F.transform(col(x), lambda s: F.concat(F.lit("`"), s, F.lit("`"))), ", ")


def json_strings(x: Column | str) -> Column:
    """An array of strings from JSON text; an empty one for null or malformed text."""
    return F.coalesce(F.from_json(col(x), "array<string>"), F.array().cast("array<string>"))


def rendered(template: Column | str, **values: Column) -> Column:
    """Literal {name} placeholders replaced."""
    out = col(template)
    for name, v in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), v)
    return out


def without_fence(x: Column | str) -> Column:
    """Without a Markdown code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(col(x)), r"(?i)^```(?:json)?\s*\n?", ""), r"\n?\s*```\z", ""))


def eta_text(gated: Column, judged: Column, elapsed: Column) -> Column:
    """Time left at the present pace, in seconds, minutes or hours; null before the first judgement."""
    left = F.try_divide((gated - judged) * elapsed, judged)
    return F.when(left < 60, F.concat(F.bround(left).cast("int").cast("string"), F.lit("s"))).when(left < 3600, F.concat(F.bround(left / 60).cast("int").cast("string"), F.lit("m"))).otherwise(F.concat(F.bround(left / 3600).cast("int").cast("string"), F.lit("h")))


def percent(done: Column, total: Column) -> Column:
    """Between 0 and 100; 0 for nothing to do."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.bround(F.try_divide(done * 100.0, total)).cast("int"), F.lit(0))))
