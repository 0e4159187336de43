"""Definition pairs: assertions that define one term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dissona.functions.ids import mined_pair_id
from dissona.functions.terms import canonical_term, comparable_definition, is_definitional, organisation_key
from dissona.functions.text import col, strip


def definitions(assertions: DataFrame) -> DataFrame:
    """assertion_id, doc_id, term, assertion_text, term_key of real definitions: kind definition, and the text defines the term."""
    return assertions.filter((F.col("kind") == "definition") & is_definitional("term", "assertion_text")).select("assertion_id", "doc_id", "term", "assertion_text", canonical_term("term").alias("term_key"))


def with_organisation(defs: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds org_key of the document; empty where unknown."""
    labels = documents.select("doc_id", organisation_key("org_label").alias("org_key"))
    return defs.join(labels, "doc_id", "left").withColumn("org_key", F.coalesce("org_key", F.lit("")))


def definition_pairs(defs: DataFrame, *, across_organisations: bool = True) -> DataFrame:
    """a_id < b_id of one term, with suppressed (scoped, and both organisations known and different) and same_text (no judge needed)."""
    x = defs.filter("term_key <> ''").select("assertion_id", "term_key", "org_key", comparable_definition("assertion_text").alias("norm"))
    a = x.select("term_key", F.col("assertion_id").alias("a_id"), F.col("org_key").alias("a_org"), F.col("norm").alias("a_norm"))
    b = x.select("term_key", F.col("assertion_id").alias("b_id"), F.col("org_key").alias("b_org"), F.col("norm").alias("b_norm"))
    hidden = F.lit(not across_organisations) & (F.col("a_org") != "") & (F.col("b_org") != "") & (F.col("a_org") != F.col("b_org"))
    return a.join(b, "term_key").filter("a_id < b_id").select("a_id", "b_id", "term_key", hidden.alias("suppressed"), (F.col("a_norm") == F.col("b_norm")).alias("same_text"))


def definition_classes(defs: DataFrame, *, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """What definition_pairs says, in size of the different definitions: a hot term's copies make no pairs.

    Members: assertion_id, class_id (definitions of one term, text and organisation). Pairs: class_a <= class_b of one term, n_pairs of
    assertions between them, cross_org (both organisations known and different), same_text. A class meets itself if it has two members.
    With exact, texts are told apart to the letter, and pairs have text_a and text_b; same_text still goes by comparable texts.
    """
    text = F.col("assertion_text") if exact else F.lit("")
    x = defs.filter("term_key <> ''").select("assertion_id", "term_key", "org_key", comparable_definition("assertion_text").alias("norm"), text.alias("text"))
    x = x.withColumn("class_id", F.sha2(F.concat_ws("\u0001", "term_key", "org_key", "norm", "text"), 256))
    c = x.groupBy("class_id", "term_key", "org_key", "norm", "text").agg(F.count("*").alias("n"))
    side = lambda p: c.select("term_key", *(F.col(f).alias(f"{f}_{p}") for f in ("class_id", "org_key", "norm", "text", "n")))
    both = side("a").join(side("b"), "term_key").filter("class_id_a <= class_id_b")
    itself = F.col("class_id_a") == F.col("class_id_b")
    n = F.when(itself, F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b")).cast("long")
    cross = (F.col("org_key_a") != "") & (F.col("org_key_b") != "") & (F.col("org_key_a") != F.col("org_key_b"))
    pairs = both.select("term_key", F.col("class_id_a").alias("class_a"), F.col("class_id_b").alias("class_b"), n.alias("n_pairs"), cross.alias("cross_org"), (F.col("norm_a") == F.col("norm_b")).alias("same_text"), *(["text_a", "text_b"] if exact else [])).filter("n_pairs > 0")
    return x.select("assertion_id", "class_id"), pairs


def pass_counts(found: DataFrame, n_pairs: str | None = None) -> DataFrame:
    """n_judged, n_divergent, n_short_circuited, n_suppressed of a definition pass's findings, or of classes, whose rows stand for n_pairs each."""
    v = F.col("judge_verdict")
    short = v == "definition_consistent_auto"
    n = F.lit(1) if n_pairs is None else F.col(n_pairs)
    count = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long")
    return found.agg(count(v.isNotNull() & ~short).alias("n_judged"), count(v == "definition_divergent").alias("n_divergent"), count(short).alias("n_short_circuited"), count(F.col("suppressed")).alias("n_suppressed"))


def definition_pair_counts(defs: DataFrame, *, across_organisations: bool = True) -> DataFrame:
    """n_pairs, n_suppressed, n_short_circuited, n_to_judge without making a pair: from counts by term, organisation and text."""
    x = defs.filter("term_key <> ''").select("term_key", "org_key", comparable_definition("assertion_text").alias("norm"))
    cell = x.groupBy("term_key", "norm", "org_key").agg(F.count("*").alias("n"))
    two = lambda n: n * (n - 1) / 2

    def pairs(keys: list[str]) -> DataFrame:
        """Pairs, and of these those of two known, different organisations."""
        inner = cell.groupBy(*keys, "org_key").agg(F.sum("n").alias("n"))
        known = F.col("org_key") != ""
        g = inner.groupBy(*keys).agg(F.sum("n").alias("all"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("known"), F.sum(F.when(known, two(F.col("n"))).otherwise(0.0)).alias("own"))
        return g.agg(F.coalesce(F.sum(two(F.col("all"))), F.lit(0.0)).cast("long").alias("n"), F.coalesce(F.sum(two(F.col("known")) - F.col("own")), F.lit(0.0)).cast("long").alias("x"))

    total, same = pairs(["term_key"]).select(F.col("n").alias("t"), F.col("x").alias("tx")), pairs(["term_key", "norm"]).select(F.col("n").alias("s"), F.col("x").alias("sx"))
    hide = F.lit(0 if across_organisations else 1).cast("long")
    one = total.join(F.broadcast(same))  # one row each
    return one.select((F.col("t") - hide * F.col("tx")).alias("n_pairs"), (hide * F.col("tx")).alias("n_suppressed"), (F.col("s") - hide * F.col("sx")).alias("n_short_circuited"), (F.col("t") - hide * F.col("tx") - F.col("s") + hide * F.col("sx")).alias("n_to_judge"))


# How a definition text begins that only points elsewhere.
CROSS_REFERENCE = (
    r"^\s*(?:has|have|having|shall\s+have)\s+the\s+meanings?\s+(?:set\s+forth|given|assigned|specified|ascribed|attributed|provided|referred)",
    r"^\s*the\s+meanings?\s+(?:set\s+forth|given|assigned|specified|ascribed|attributed|provided)",
    r"^\s*as\s+(?:defined|set\s+forth)\b",
)


def is_cross_reference(x: Column | str) -> Column:
    """The definition only points elsewhere. False for a missing text."""
    return F.coalesce(F.regexp(col(x), F.lit("(?iuU)" + "|".join(CROSS_REFERENCE))), F.lit(False))


def _first_rows(rows: DataFrame, cap: int) -> DataFrame:
    """Enough of each term's definitions for the first cap pairs in the order of mined_pairs, however many share a term, document or text.

    With n = cap + 1 these are, each by id among those that the step before left: n of a term, document and text, 2n of a term and
    text, 2n of a term and document, 5n of a term. A row beyond n has n pairs of its own kind before each of its own. Of a row's 2n
    predecessors in a text (or document) n at most share its partner's document (or text), so n pairs of its kind or a better one
    come first; of 5n in a term, 2n at most share the partner's text and 2n its document.
    """
    n = cap + 1
    for keys, most in ((["term_key", "doc_id", "body"], n), (["term_key", "body"], 2 * n), (["term_key", "doc_id"], 2 * n), (["term_key"], 5 * n)):
        rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("assertion_id"))).filter(F.col("__r") <= most).drop("__r")
    return rows


def mined_pairs(assertions: DataFrame, cap: int) -> DataFrame:
    """Pairs of definitions to label: a_id, b_id, term_key, category, term (of the lesser id), def_a, def_b, doc_a, doc_b.

    assertions have definition_text; those whose text is missing, blank or a cross-reference are left out. The first cap pairs: those
    across documents before others, texts that differ (review) before equal ones (identical), then by term and ids.
    """
    whole = assertions.filter((F.col("kind") == "definition") & is_definitional("term", "assertion_text") & ~is_cross_reference(strip("definition_text")))
    rows = whole.select("assertion_id", "doc_id", "term", canonical_term("term").alias("term_key"), strip("definition_text").alias("body")).filter("term_key <> '' and body <> ''")
    x = _first_rows(rows, cap)
    side = lambda p: x.select("term_key", F.col("assertion_id").alias(f"{p}_id"), F.col("doc_id").alias(f"doc_{p}"), F.col("body").alias(f"def_{p}"), F.col("term").alias(f"term_{p}"))
    category = F.when(F.col("def_a") == F.col("def_b"), "identical").otherwise("review")
    pairs = side("a").join(side("b").drop("term_b"), "term_key").filter("a_id < b_id").withColumn("category", category)
    order = [F.col("doc_a") == F.col("doc_b"), F.col("category") == "identical", "term_key", "a_id", "b_id"]
    return pairs.orderBy(*order).limit(cap).select("a_id", "b_id", "term_key", "category", F.col("term_a").alias("term"), "def_a", "def_b", "doc_a", "doc_b")


def candidate_lines(mined: DataFrame) -> DataFrame:
    """One JSON line for each mined pair, its label empty."""
    name = mined_pair_id(F.col("term_key"), F.col("a_id").cast("string"), F.col("b_id").cast("string"))
    return mined.select(F.to_json(F.struct(name.alias("pair_id"), "category", "term", "def_a", "def_b", F.col("doc_a").cast("string").alias("doc_a"), F.col("doc_b").cast("string").alias("doc_b"), F.lit("").alias("label"))).alias("value"))
