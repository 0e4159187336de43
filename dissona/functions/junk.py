"""Why a line or an assertion is junk: a reason, or null. The first reason that holds counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import alpha_count, alpha_ratio, let, strip

# Patterns and thresholds of the reasons.
PAGE = r"(?i)^(?:page\s+)?\d{1,4}$|^[-–—]\s*\d{1,4}\s*[-–—]$"
LEADER = r"\.{5,}"
POINTER = r"(?i)^(?:as\s+(?:defined|set\s+forth|described|provided|used|referenced)|see)\b"
TARGET = r"(?i)\b(?:article|section|paragraph|clause|bylaws?|agreement|exhibit|schedule|herein|hereof|hereunder|above|below)\b"
LONG, RATIO, FEW, POINTER_LETTERS = 8, 0.15, 10, 30


def junk_line(x: Column | str) -> Column:
    """page_number, dot_leader or mostly_non_alpha; null for a clean, blank or missing line."""
    return let(strip(x), lambda bare: F.when(bare == "", None).when(bare.rlike(PAGE), "page_number").when(bare.rlike(LEADER), "dot_leader").when((F.length(bare) >= LONG) & (alpha_ratio(bare) < RATIO), "mostly_non_alpha"))


def junk_assertion(x: Column | str) -> Column:
    """dot_fragment, mostly_non_alpha, near_empty or cross_reference; null for a clean or missing text."""

    def reason(bare: Column) -> Column:
        pointer = bare.rlike(POINTER) & bare.rlike(TARGET) & (alpha_count(bare) < POINTER_LETTERS)
        return F.when(bare.rlike(LEADER), "dot_fragment").when((F.length(bare) >= LONG) & (alpha_ratio(bare) < RATIO), "mostly_non_alpha").when(alpha_count(bare) < FEW, "near_empty").when(pointer, "cross_reference")

    return let(strip(x), reason)
