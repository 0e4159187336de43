"""Sources. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dissona.functions.ids import hash_id
from dissona.functions.text import newlines, without_fence
from dissona.operators.store import first_wins
from dissona.runtime import durable

from .documents import loader

Loader = Callable[[DataFrame], DataFrame]
# What an upload may have.
UPLOAD_FILE, UPLOAD_COUNT, UPLOAD_TOTAL = 100 << 20, 100, 500 << 20
LEAST_MEMORY = 512


def plain_text(files: DataFrame) -> DataFrame:
    """path, title (the file's stem), text of binary files read as UTF-8."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.regexp_replace(name, r"\.[^.]*\z", "").alias("title"), newlines(F.decode("content", "UTF-8")).alias("text"))


LOADERS: dict[str, Loader] = {".txt": plain_text, ".md": plain_text, ".pdf": loader(".pdf"), ".docx": loader(".docx")}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files under a folder, at any depth. A missing folder raises on read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def load_files(files: DataFrame, loaders: dict[str, Loader] | None = None) -> DataFrame:
    """doc_id, source_path, title, text, by each file's loader; files of other kinds are left out. Each kind is one branch of the plan."""
    loaders = loaders or LOADERS
    out = None
    for loader in dict.fromkeys(loaders.values()):
        own = [e for e, f in loaders.items() if f is loader]
        if loader is not plain_text and files.filter(extension(F.col("path")).isin(*own)).isEmpty():
            continue
        rows = loader(files.filter(extension(F.col("path")).isin(*own)))
        out = rows if out is None else out.unionByName(rows)
    return out.select(hash_id("text").alias("doc_id"), F.col("path").alias("source_path"), "title", "text")


def load_corpus(spark: SparkSession, folder: str, loaders: dict[str, Loader] | None = None) -> DataFrame:
    """load_files of a folder; sort by source_path for the walk's order."""
    return load_files(list_files(spark, folder), loaders)


def load_path(spark: SparkSession, path: str, loaders: dict[str, Loader] | None = None) -> DataFrame:
    """One file; an unknown extension raises."""
    loaders = loaders or LOADERS
    if os.path.splitext(path)[1].lower() not in loaders:
        raise ValueError(f"no loader for {path}")
    return load_files(spark.read.format("binaryFile").load(path), loaders)


def upload_decisions(files: DataFrame) -> DataFrame:
    """path, length, reason: why a file of an upload isn't taken (extension, file_size, file_count, total_size), null if it is. In path order.

    Files are dealt out by ranges of paths; numbers and sizes run within a range, and the ranges' own sums, a row each, are added.
    """
    ok = extension(F.col("path")).isin(*LOADERS) & (F.col("length") <= UPLOAD_FILE)
    x = durable(files.select("path", "length", ok.cast("int").alias("ok")).repartitionByRange("path").withColumn("range", F.spark_partition_id()))
    taken, size = F.col("ok"), F.when(F.col("ok") == 1, F.col("length")).otherwise(0)
    within = Window.partitionBy("range").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = x.groupBy("range").agg(F.sum(taken).alias("n"), F.sum(size).alias("total")).select("range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "total")))
    y = x.withColumns({"n": F.sum(taken).over(within), "total": F.sum(size).over(within)}).join(F.broadcast(sums), "range")
    many, much = F.col("n") + F.col("n_before") > UPLOAD_COUNT, F.col("total") + F.col("total_before") > UPLOAD_TOTAL
    reason = F.when(~extension(F.col("path")).isin(*LOADERS), "extension").when(F.col("length") > UPLOAD_FILE, "file_size").when(many, "file_count").when(much, "total_size")
    return y.select("path", "length", reason.alias("reason"))


def empty_texts(documents: DataFrame) -> DataFrame:
    """source_path of files without text."""
    return documents.filter("trim(text) = ''").select("source_path")


def _only(rows: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    message = F.concat(F.lit(f"{column} isn't one of {', '.join(allowed)}: "), F.coalesce(F.col(column), F.lit("null")))
    return rows.filter(F.assert_true(F.col(column).isNotNull() & F.col(column).isin(*allowed), message).isNull())


def contradoc_pairs(spark: SparkSession, path: str, sample: int | None = None) -> DataFrame:
    """Document pairs with a label; a label outside the list raises."""
    rows = _only(spark.read.schema("pair_id string, document_a string, document_b string, label string").json(path), "label", ("contradiction", "not_contradiction"))
    return rows if sample is None else rows.limit(sample)


def targeted_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled assertion pairs; blank lines and // lines are skipped, missing fields, unknown values and repeated ids raise."""
    schema = "pair_id string, bucket string, assertion_a string, assertion_b string, ground_truth string, relation string, notes string"
    lines = spark.read.text(path).filter("trim(value) <> '' and not ltrim(value) like '//%'")
    rows = lines.select(F.from_json("value", schema).alias("x")).select("x.*")
    for c in ("pair_id", "assertion_a", "assertion_b"):
        rows = rows.filter(F.assert_true(F.col(c).isNotNull(), F.lit(f"{c} is missing")).isNull())
    rows = _only(rows, "bucket", ("rule_exception", "modal_divergence", "temporal_scope"))
    rows = _only(rows, "ground_truth", ("contradiction", "not_contradiction", "uncertain"))
    rows = _only(rows, "relation", ("contradiction", "contrariety", "override", "entailment", "scope_mismatch", "independent"))
    twice = rows.groupBy("pair_id").count().filter("count > 1").first()
    if twice:
        raise ValueError(f"pair_id {twice['pair_id']} is there twice")
    return rows


def definition_pairs_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("pair_id string, category string, term string, def_a string, def_b string, label string").json(path)


def baseline_run(spark: SparkSession, path: str) -> DataFrame:
    """One row per finding of a run file; findings may be an array or a string of JSON, fenced or not."""
    finding = "array<struct<doc_a:string,span_a:string,doc_b:string,span_b:string,type:string,rationale:string>>"
    x = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", "run_id string, model string, corpus_name string, findings string, input_tokens long, output_tokens long, cost_usd double, timestamp string").alias("r")).select("r.*")
    return x.withColumn("f", F.explode(F.from_json(without_fence("findings"), finding))).select("run_id", "model", "corpus_name", "input_tokens", "output_tokens", "cost_usd", "timestamp", "f.*")


def finding_labels(spark: SparkSession, path: str) -> DataFrame:
    """finding_id, label, notes of a labelled CSV; rows without a label are skipped, an unknown one raises."""
    schema = "finding_id string, doc_a string, span_a string, doc_b string, span_b string, type string, rationale string, label string, notes string"
    rows = spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path).filter("label is not null and trim(label) <> ''")
    return _only(rows, "label", ("real", "false_positive", "dismissed")).select("finding_id", "label", "notes")


def candidate_pairs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Candidates of several files, the first of each pair_id."""
    rows = spark.read.schema("pair_id string, category string, term string, def_a string, def_b string").json(paths)
    return first_wins(rows, ["pair_id"], ["category", "term", "def_a", "def_b"])


def saved_labels(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """pair_id, label of rows (pair_id, label, seq): the last label that isn't empty; one without a candidate raises."""
    last = rows.filter("label is not null and label <> ''").groupBy("pair_id").agg(F.max_by("label", "seq").alias("label"))
    orphan = last.join(candidates.select("pair_id"), "pair_id", "left_anti").first()
    if orphan:
        raise ValueError(f"a label for {orphan['pair_id']}, which isn't a candidate")
    return last


def flat_settings(text: str) -> dict[str, str]:
    """Settings of a YAML text by name, as strings. Where no YAML library is there, lines `name: value` are read, nested by indentation."""
    try:
        import yaml
    except ImportError:
        out, above = {}, []
        for line in text.splitlines():
            bare = line.split("#", 1)[0].rstrip()
            if not bare.strip():
                continue
            indent, (name, _, value) = len(bare) - len(bare.lstrip()), bare.strip().partition(":")
            above = [x for x in above if x[0] < indent]
            if value.strip():
                out["_".join([*(n for _, n in above), name.strip()])] = value.strip().strip("'\"")
            else:
                above.append((indent, name.strip()))
        return out
    loaded = yaml.safe_load(text) or {}
    if not isinstance(loaded, dict):
        raise ValueError("settings are names and values")

    def walk(x: dict, head: tuple[str, ...]) -> dict[str, str]:
        out = {}
        for k, v in x.items():
            out |= walk(v, (*head, str(k))) if isinstance(v, dict) else {"_".join((*head, str(k))): "" if v is None else str(v)}
        return out

    return walk(loaded, ())


@dataclass(frozen=True)
class Config:
    """Settings; unknown names raise. An environment variable CC_<NAME> goes before a file's value."""

    corpus_dir: str = ""
    judge_provider: str = "moonshot"
    max_chunk_chars: int = 1000
    chunk_overlap_chars: int = 0
    gate_top_k: int = 20
    gate_similarity_threshold: float = 0.7
    nli_contradiction_threshold: float = 0.5
    triangle_weak_top_k: int = 50
    triangle_weak_threshold: float = 0.5
    max_triangles_per_run: int = 1000
    junk_filter_enabled: bool = True
    pairwise_enabled: bool = False
    deep: bool = False
    scope_definitions_by_org: bool = False
    max_cost: float | None = None
    max_memory_mb: int | None = None
    extra: dict = field(default_factory=dict, repr=False)

    @classmethod
    def read(cls, text: str, environment: dict[str, str] | None = None) -> Config:
        """From YAML (of nested settings the names are joined by underscores), with the environment over them."""
        types = {f.name: f for f in fields(cls) if f.name != "extra"}
        found = flat_settings(text)
        found |= {n: v for n in types if (v := (environment if environment is not None else os.environ).get(f"CC_{n.upper()}")) is not None}
        if unknown := set(found) - set(types):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        made = {}
        for n, v in found.items():
            default = types[n].default
            if default is None and v.lower() in ("", "null", "none", "~"):
                continue
            made[n] = v.lower() in ("1", "true", "yes", "on") if isinstance(default, bool) else type(default)(v) if default is not None else int(v) if n == "max_memory_mb" else float(v)
        if made.get("max_memory_mb", LEAST_MEMORY) < LEAST_MEMORY:
            raise ValueError(f"max_memory_mb is {LEAST_MEMORY} or more")
        return cls(**made)


def load_environment(text: str, environment: dict[str, str]) -> dict[str, str]:
    """An environment with the lines NAME=value of a file where it has none."""
    pairs = (x.strip().removeprefix("export ").partition("=") for x in text.splitlines() if "=" in x and not x.lstrip().startswith("#"))
    return {n.strip(): v.strip().strip("'\"") for n, _, v in pairs} | environment
