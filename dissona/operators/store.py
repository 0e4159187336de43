"""The document store: tables as DataFrames; changes give the next state of a table."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from dissona.runtime import remove, rename


class CrossCorpusDocumentError(ValueError):
    """A document belongs to another corpus already."""


def first_wins(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first in order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def latest_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one with the greatest order; by an aggregate, which combines before the shuffle. Columns: keys, then the others."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("__o"), *(F.col(c) for c in rest))).alias("m"))
    return best.select(*keys, *(F.col("m")[c].alias(c) for c in rest))


def backfilled(rows: DataFrame, **values: object) -> DataFrame:
    """The rows with a value wherever a column has none, as for rows from before there was the column."""
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in values.items()})


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """The table with the new rows whose key it lacks; among new ones the first wins."""
    fresh = first_wins(new, [key], order).select(*existing.columns)
    return existing.unionByName(fresh.join(existing.select(key), key, "left_anti").select(*existing.columns))


def insert_documents(existing: DataFrame, new: DataFrame, order: list[Column | str]) -> DataFrame:
    """insert_or_ignore by doc_id; a null corpus, or a document of another corpus, raises."""
    if not new.filter("corpus_id is null").isEmpty():
        raise ValueError("a document needs a corpus")
    clash = new.join(existing.select("doc_id", F.col("corpus_id").alias("__c")), "doc_id").filter("corpus_id <> __c")
    if not clash.isEmpty():
        raise CrossCorpusDocumentError("a document is in another corpus")
    return insert_or_ignore(existing, new, "doc_id", order)


def delete_corpus(tables: dict[str, DataFrame], corpus_id: str) -> dict[str, DataFrame]:
    """The tables corpora, documents, assertions, runs, findings without a corpus and what hangs on it."""
    gone = tables["documents"].filter(F.col("corpus_id") == corpus_id).select("doc_id")
    runs = tables["runs"].filter(F.col("corpus_id") == corpus_id).select("run_id")
    keep = lambda t, k, x: tables[t].join(x, k, "left_anti").select(*tables[t].columns)
    not_it = lambda t: tables[t].filter(~F.col("corpus_id").eqNullSafe(corpus_id))
    return tables | {"corpora": not_it("corpora"), "documents": not_it("documents"), "runs": not_it("runs"), "assertions": keep("assertions", "doc_id", gone), "findings": keep("findings", "run_id", runs)}


_CLAUSE = re.compile(r"\s*([a-z_]+)\s*(=|like)\s*'((?:[^']|'')*)'\s*", re.I)


def safe_where(text: str, columns: list[str]) -> Column:
    """A condition from col = 'x' and col LIKE 'x' with AND and OR, over listed columns; anything else raises. LIKE ignores case."""
    out, at, joiner = None, 0, ""
    while True:
        m = _CLAUSE.match(text, at)
        if not m or m[1].lower() not in columns:
            raise ValueError(f"not a condition on {', '.join(columns)}: {text!r}")
        value = m[3].replace("''", "'")
        one = F.col(m[1].lower()) == value if m[2] == "=" else F.col(m[1].lower()).ilike(value)
        # AND binds closer: alternatives are kept apart until the end
        if out is None:
            out = [one]
        elif joiner == "and":
            out[-1] = out[-1] & one
        else:
            out.append(one)
        at = m.end()
        if at == len(text):
            break
        j = re.compile(r"(and|or)\b", re.I).match(text, at)
        if not j:
            raise ValueError(f"not a condition: {text!r}")
        joiner, at = j[1].lower(), j.end()
    cond = out[0]
    for x in out[1:]:
        cond = cond | x
    return cond


def reassign(documents: DataFrame, where: str, to_corpus: str) -> DataFrame:
    """Documents that meet a safe condition go to another corpus."""
    cond = safe_where(where, ["doc_id", "source_path", "title", "doc_type", "corpus_id", "org_label"])
    return documents.withColumn("corpus_id", F.when(F.coalesce(cond, F.lit(False)), F.lit(to_corpus)).otherwise(F.col("corpus_id")))


def update_organisations(documents: DataFrame, labels: DataFrame, *, only_missing: bool) -> DataFrame:
    """Labels by doc_id (doc_id, new_label); over all rows, or only where there was none."""
    x = documents.join(labels.select("doc_id", "new_label"), "doc_id", "left")
    new = F.coalesce("org_label", "new_label") if only_missing else F.coalesce("new_label", "org_label")
    return x.withColumn("org_label", new).select(*documents.columns)


def assertions_of(assertions: DataFrame, documents: DataFrame, *, corpus_id: str | None = None, doc_id: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Assertions by document or corpus, in a stable order, a page of them."""
    out = assertions if doc_id is None else assertions.filter(F.col("doc_id") == doc_id)
    if corpus_id is not None:
        out = out.join(documents.filter(F.col("corpus_id") == corpus_id).select("doc_id"), "doc_id", "left_semi")
    out = out.orderBy("created_at", "assertion_id").offset(offset)
    return out if limit is None else out.limit(limit)


def page(rows: DataFrame, order: list[Column | str], number: int, size: int = 25) -> DataFrame:
    """A page of an ordered listing, the first being 1; lesser numbers are the first."""
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of listed ids."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def store_stats(documents: DataFrame, assertions: DataFrame) -> DataFrame:
    """n_documents, n_assertions, n_embedded."""
    a = assertions.agg(F.count("*").alias("n_assertions"), F.count("embedded_at").alias("n_embedded"))
    return documents.agg(F.count("*").alias("n_documents")).join(F.broadcast(a))


#: Places of a document whose running sums one task makes.
SLICE = 4096


def element_text(elements: DataFrame) -> DataFrame:
    """elements (doc_id, idx, text): for each kept element its place in the document's text, elements apart by a blank line.

    Blank and junk elements are left out; char_start, char_end are code points, end exclusive. Sums run within slices of a document's
    places; the slices' own sums run within a document, a row for SLICE places, and are added. Both come from one shuffle by slice.
    """
    from dissona.functions.junk import junk_line
    from dissona.functions.text import strip

    rest = [c for c in elements.columns if c != "text"]
    made = elements.select(*rest, F.inline(F.array(F.struct(strip("text").alias("text"), junk_line("text").alias("__reason")))))  # a generator: a plain column would be computed anew in the filter
    kept = made.filter("text <> '' and __reason is null").select(*elements.columns)
    dealt = kept.withColumn("__slice", F.floor(F.col("idx") / SLICE)).repartition("doc_id", "__slice")
    size = F.length("text") + 2
    within = Window.partitionBy("doc_id", "__slice").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    slices = dealt.groupBy("doc_id", "__slice").agg(F.sum(size).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.partitionBy("doc_id").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = slices.select("doc_id", "__slice", before.alias("__before"))
    placed = dealt.withColumn("__own", F.coalesce(F.sum(size).over(within), F.lit(0))).join(begins, ["doc_id", "__slice"])
    start = F.col("__before") + F.col("__own")
    return placed.withColumn("char_start", start).withColumn("char_end", start + F.length("text")).select(*elements.columns, "char_start", "char_end")


class RefusedError(ValueError):
    """Rows that a table doesn't take: how many, by column."""

    def __init__(self, counts: dict[str, int]):
        super().__init__("refused: " + ", ".join(f"{n} in {c}" for c, n in counts.items() if n))
        self.counts = counts


def write_checked(rows: DataFrame, target: str, allowed: dict[str, tuple[str, ...]], *, nullable: tuple[str, ...] = ()) -> int:
    """Appends a batch to the table at target if all its rows fit; their number. Otherwise RefusedError, and nothing of it stays.

    allowed: the values that columns may have; null is none of them, unless the column is nullable. Rows are counted while they are
    written, to a folder that readers pass over; it gets its name as a part of the table once the counts are there.
    """
    spark = rows.sparkSession
    name = uuid.uuid4().hex
    aside, final = f"{target.rstrip('/')}/_{name}", f"{target.rstrip('/')}/batch={name}"
    seen = Observation()
    fits = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(c in nullable) & F.col(c).isNull())
    watched = rows.observe(seen, F.count(F.lit(1)).alias("n"), *(F.count_if(~fits(c, values)).alias(f"bad_{i}") for i, (c, values) in enumerate(allowed.items())))
    try:
        watched.write.parquet(aside)
        counts = {c: seen.get[f"bad_{i}"] for i, c in enumerate(allowed)}
        if any(counts.values()):
            raise RefusedError(counts)
        rename(spark, aside, final)
    except BaseException:
        remove(spark, aside)
        raise
    return seen.get["n"]


def read_checked(spark: SparkSession, target: str) -> DataFrame:
    """What write_checked has put there, without the batches' names."""
    return spark.read.parquet(target).drop("batch")


def payload_assertions(payloads: DataFrame) -> DataFrame:
    """payloads (doc_id, chunk_id, claims, definitions: ARRAY<STRUCT<term, definition_text, containing_sentence>>): assertions, claims first, blank ones dropped, the first of equal ids kept."""
    from dissona.functions.ids import hash_id

    null = F.lit(None).cast("string")
    claim = lambda c: F.struct(F.lit("claim").alias("kind"), c.alias("text"), null.alias("term"), null.alias("definition_text"))
    define = lambda d: F.struct(F.lit("definition").alias("kind"), d["containing_sentence"].alias("text"), d["term"].alias("term"), d["definition_text"].alias("definition_text"))
    all_ = F.concat(F.transform(F.coalesce("claims", F.array().cast("array<string>")), claim), F.transform("definitions", define))
    rows = payloads.select("doc_id", "chunk_id", F.posexplode(all_).alias("seq", "x")).filter("trim(x.text) <> ''").select("doc_id", "chunk_id", "seq", "x.kind", F.col("x.text").alias("assertion_text"), "x.term", "x.definition_text")
    return first_wins(rows.withColumn("assertion_id", hash_id("doc_id", "assertion_text")), ["assertion_id"], ["chunk_id", "seq"])


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of child whose key, if it has one, isn't in parent."""
    there = parent.select(F.col(parent_key or key).alias("__k")).distinct()
    return child.filter(F.col(key).isNotNull()).join(there, F.col(key) == F.col("__k"), "left_anti")


def any_rows(*tables: DataFrame) -> DataFrame:
    """there: whether any of the tables has a row; one row of each is read."""
    one = [t.limit(1).select(F.lit(1).alias("x")) for t in tables]
    both = one[0]
    for t in one[1:]:
        both = both.unionAll(t)
    return both.agg((F.count("*") > 0).alias("there"))


def vector_of(embeddings: DataFrame, assertion_id) -> DataFrame:
    """The vector of an assertion."""
    return embeddings.filter(F.col("assertion_id") == assertion_id).select("assertion_id", "embedding")


def checked_vectors(vectors: DataFrame, width: int) -> DataFrame:
    """The vectors; one of another width, or null, raises."""
    ok = F.col("embedding").isNotNull() & (F.size("embedding") == width)
    return vectors.filter(F.assert_true(ok, F.concat(F.lit(f"a vector has {width} numbers, not "), F.coalesce(F.size("embedding").cast("string"), F.lit("null")))).isNull())
