import pytest
from pyspark.errors.exceptions.captured import IllegalArgumentException, PythonException  # noqa: F401
from pyspark.sql import functions as F

from dissona.functions import ids, junk, quantities, terms, text


def one(spark, column, **values):
    """The value of an expression over one row of literals."""
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def each(spark, function, values):
    return [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", function("t").alias("x")).orderBy("i").collect()]


def test_ids(spark):
    import hashlib

    assert one(spark, ids.hash_id(F.lit("ab"), F.lit("c"))) == hashlib.sha256(b"abc").hexdigest()[:16]
    assert one(spark, ids.pair_key(F.lit("b"), F.lit("a"))) == "a:b"
    assert one(spark, ids.pair_key(F.lit("b"), F.lit(None))) is None
    with pytest.raises(ValueError):
        ids.pair_key(F.lit("a"))
    assert one(spark, ids.is_pair_key(F.lit("0123456789abcdef:0123456789abcdef"))) is True
    assert one(spark, ids.is_pair_key(F.lit("0123456789abcdef"))) is False
    a, b = (F.lit(x) for x in ("d1", "s1")), (F.lit(x) for x in ("d0", "s2"))
    a, b = list(a), list(b)
    assert one(spark, ids.unordered_finding_id(*a, *b)) == one(spark, ids.unordered_finding_id(*b, *a))


def test_canonical_terms(spark):
    given = [' "The Borrowers" ', "Loss", "“Agents”", "as", None, "''", "The Class", "`Fees`"]
    assert each(spark, terms.canonical_term, given) == ["borrower", "loss", "agent", "as", None, "", "class", "fee"]


def test_organisations(spark):
    given = ["Foo Co., Ltd", "The A.B.C. L.P.", "Straße & Co", "inc", "", None, "Foo Co Ltd", "L P", "Acme Trust"]
    assert each(spark, terms.organisation_key, given) == ["foo co", "a b c", "strasse", "inc", "", "", "foo co", "l p", "acme trust"]
    assert each(spark, terms.pre_suffix_key, ["The Foo, Ltd"]) == ["foo ltd"]


def test_definitional(spark):
    rows = [("Lender", '"Lender" means a bank', True), ("A.B", "a.b shall  mean x", True), ("x\\E", "x\\E means", True), ("Agent", "the Agent's meaning", False), ("T", "“T”, means", True), ("A.B", "aXb means", False), (None, "x means", False), ("x", None, False), ("", "means", False)]
    got = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(rows)], "i int, t string, s string").select("i", terms.is_definitional("t", "s").alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [w for *_, w in rows]


def test_equivalent_definitions(spark):
    same = lambda a, b: one(spark, terms.definitions_equivalent(F.lit(a), F.lit(b)))
    assert same("  The  Foo, bar. ", "the foo, BAR")
    assert same("Straße", "STRASSE")
    assert not same("a, b", "a b")


def test_junk(spark):
    lines = ["Page 12", "- 3 -", "Intro ..... 4", "12 34 56 78 9", "ok then", "  ", None, "12345"]
    assert each(spark, junk.junk_line, lines) == ["page_number", "page_number", "dot_leader", "mostly_non_alpha", None, None, None, None]
    texts = ["a ..... b", "1234 5678 90", "short", "As defined in Article 11", "As used herein, Director means a member of the board of directors.", None, "a perfectly good sentence"]
    assert each(spark, junk.junk_assertion, texts) == ["dot_fragment", "mostly_non_alpha", "near_empty", "cross_reference", None, None, None]


def test_quantities(spark):
    rows = {
        "Revenue grew 12% in fiscal 2025.": [("revenue", 12.0, "percent", "up", "fiscal 2025")],
        "The total was $12 million and +3 bps": [("total was", 12.0, "million_usd", "none", None), ("total was $12 million and", 3.0, "basis_points", "pos", None)],
        "Growth of -4.5% during 2023, then 1,200.50 euros": [("growth of", 4.5, "percent", "neg", "2023"), ("growth of -4.5% then", 1200.5, "eur", "none", "2023")],
        "Sales fell by €3 million, 20 percent.": [("sales", 3.0, "million_eur", "down", None), ("sales", 20.0, "percent", "down", None)],
        "value 2024-2025": [("value 2024", 2025.0, None, "neg", None)],
        "no numbers rise here": [],
        "": [],
        "grew 5%": [],
    }
    got = each(spark, quantities.extract_quantities, [*rows, None])
    assert [[tuple(q) for q in g] for g in got] == [*rows.values(), []]


def test_flips_and_disagreements(spark):
    df = spark.createDataFrame([("Revenue grew 12% in fiscal 2025.", "Revenue declined 5% in fiscal 2025."), ("cost is $10 million", "Cost is $12 million"), ("cost is $10 million", "Cost is $10 million in 2024"), ("x is 0 %", "x is 0 %")], "a string, b string")
    q = df.select(quantities.extract_quantities("a").alias("a"), quantities.extract_quantities("b").alias("b"))
    got = q.select(quantities.short_circuit(quantities.sign_flips("a", "b")).alias("v"), quantities.numeric_context(quantities.value_disagreements("a", "b")).alias("c")).collect()
    assert got[0]["v"]["rationale"] == "Numeric short-circuit: metric=revenue, A=12.0percent, B=5.0percent, polarity mismatch."
    assert got[0]["v"]["evidence_spans"] == ["12.0percent", "5.0percent"] and got[0]["c"] is None
    assert got[1]["v"] is None and got[1]["c"] == "metric=cost is: A=10.0, B=12.0 million_usd"
    assert got[2]["v"] is None and got[2]["c"] is None
    assert got[3]["c"] is None
    with pytest.raises(ValueError):
        quantities.value_disagreements("a", "b", -0.1)


def test_text(spark):
    assert one(spark, text.score_text(F.lit(0.83))) == "0.83"
    assert one(spark, text.score_text(F.lit(None).cast("double"))) == "—"
    assert each(spark, text.slug, ["A b/c--", "--x"]) == ["a-b-c", "x"]
    assert one(spark, text.truncated(F.lit("abcdef"), 4)) == "abc…"
    assert one(spark, text.doc_label(F.lit(""), F.lit(None), F.lit(3))) == "3"
    assert one(spark, text.json_strings(F.lit("nonsense"))) == []
    assert one(spark, text.without_fence(F.lit("```json\n[1]\n```"))) == "[1]"
    assert one(spark, text.newlines(F.lit("a\r\nb\rc"))) == "a\nb\nc"
    assert one(spark, text.eta_text(F.lit(10), F.lit(5), F.lit(600.0))) == "10m"
    assert one(spark, text.percent(F.lit(5), F.lit(0))) == 0
    assert one(spark, text.rendered(F.lit("{a} and {b}"), a=F.lit("x"), b=F.lit("{a}"))) == "x and {a}"
    assert one(spark, text.alpha_ratio(F.lit(""))) == 0.0
