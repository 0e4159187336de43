"""Defined terms and organisations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, col, strip

# Quote characters, and legal forms of organisations.
QUOTES = "\"'“”‘’`"
LEGAL_FORMS = ("limited", "ltd", "company", "co", "corporation", "corp", "lp", "l.p.", "llc", "inc")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_EDGE = "[" + "".join("\\" + c for c in PUNCTUATION) + "“”‘’]"


def canonical_term(x: Column | str) -> Column:
    """What two spellings of a defined term have in common: no quotes around, lower case, no leading article, no plural s."""
    bare = F.lower(strip(strip(strip(x), f"[{QUOTES}]")))
    bare = F.regexp_replace(bare, "^the ", "")
    return F.when((F.length(bare) > 2) & bare.endswith("s") & ~bare.endswith("ss"), F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)


def folded(x: Column | str) -> Column:
    """Caseless form. Spark has no case folding; what folds apart from its lower case is written out."""
    return F.replace(F.replace(F.lower(F.upper(F.replace(col(x), F.lit("ß"), F.lit("ss")))), F.lit("ς"), F.lit("σ")), F.lit("ſ"), F.lit("s"))


def comparable_definition(x: Column | str) -> Column:
    return strip(F.regexp_replace(strip(folded(x)), SPACE + "+", " "), _EDGE)


def definitions_equivalent(a: Column | str, b: Column | str) -> Column:
    """Equal but for case, white space and marks at the ends."""
    return comparable_definition(a) == comparable_definition(b)


def is_definitional(term: Column | str, text: Column | str) -> Column:
    """The text has the term, quoted or not, followed by means or shall mean. False for a missing or empty term or text."""
    term, text = col(term), col(text)
    quote = f"[{QUOTES}]?"
    literal = F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.concat(F.lit("(?iuU)" + quote), literal, F.lit(quote + r"\s*,?\s*(?:means|shall\s+mean)\b"))
    return F.coalesce((term != "") & (text != "") & F.regexp(text, pattern), F.lit(False))


def _words(x: Column | str) -> Column:
    spaced = F.regexp_replace(folded(x), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(F.regexp_replace(F.trim(spaced), "^the ", ""), " "), lambda w: w != "")


def pre_suffix_key(x: Column | str) -> Column:
    """An organisation's name in lower case, words only, without a leading article."""
    return F.coalesce(F.array_join(_words(x), " "), F.lit(""))


def organisation_key(x: Column | str) -> Column:
    """The same without one trailing legal form, if a word stays. Apply once. Null or blank gives an empty key."""
    words = _words(x)
    split_lp = (F.size(words) >= 3) & (F.array_join(F.slice(words, -2, 2), " ") == "l p")
    form = (F.size(words) >= 2) & F.element_at(words, -1).isin(*LEGAL_FORMS)
    cut = F.when(F.size(words) < 2, words).when(split_lp, F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))).when(form, F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    return F.coalesce(F.array_join(cut, " "), F.lit(""))
