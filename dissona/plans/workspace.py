"""A workspace: the engine's tables in a folder, and the steps that change and read them.

Tables are Parquet in folders. A version is a small file that lists the folders it is made of: a change writes a new folder and then
the next version, an append only the rows it adds, so readers see a whole state or the one before. Two writers can't make the same
version: the later one gets a ConflictError. A step that is run again finds its rows there and adds nothing.
"""

from __future__ import annotations

import json
import logging
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dissona.functions.ids import hash_id
from dissona.functions.junk import junk_assertion
from dissona.operators import audit, definitions, evaluation, gate, organisations, store, triangles
from dissona.operators.chunking import chunk_documents
from dissona.sources import readers, sinks

from . import pipeline, plugins

# The relations, in the order of the changes that brought them.
MIGRATIONS = (
    (1, "documents", "doc_id string, corpus_id string, source_path string, title string, doc_date string, doc_type string, org_label string, org_reason string, ingested_at timestamp_ntz"),
    (2, "assertions", "assertion_id string, doc_id string, chunk_id string, assertion_text string, kind string, term string, definition_text string, char_start int, char_end int, created_at timestamp_ntz"),
    (3, "embeddings", "assertion_id string, doc_id string, embedding array<float>, embedded_at timestamp_ntz"),
    (4, "run_events", "run_id string, corpus_id string, run_kind string, status string, seq long, at timestamp_ntz, message string"),
    (5, "findings", "finding_id string, run_id string, detector_type string, assertion_a_id string, assertion_b_id string, gate_score double, nli_label string, nli_p_contradiction double, nli_p_entailment double, nli_p_neutral double, judge_verdict string, judge_rationale string, evidence_spans array<string>, suppressed boolean"),
    (6, "multi_party_findings", "finding_id string, run_id string, assertion_ids array<string>, edge_scores array<struct<a:string,b:string,score:double>>, judge_verdict string, judge_rationale string, evidence_spans array<string>, contradicting_subset array<string>"),
    (7, "verdict_events", "pair_key string, detector_type string, verdict string, note string, set_at timestamp_ntz"),
    (8, "corpora", "corpus_id string, corpus_name string, corpus_path string, judge_provider string, created_at timestamp_ntz"),
    (9, "junk_drops", "stage string, reason string, doc_id string, text_snippet string"),
    (10, "run_counters", "run_id string, n_assertions long, n_pairs_gated long, n_pairs_judged long, n_findings long, n_files_total long, n_files_done long, notes string, at timestamp_ntz"),
)
# Of a table, the column that names a row of another.
KEYS = (("documents", "corpus_id", "corpora"), ("assertions", "doc_id", "documents"), ("embeddings", "assertion_id", "assertions"), ("run_events", "corpus_id", "corpora"), ("findings", "run_id", "run_events"), ("multi_party_findings", "run_id", "run_events"))
FOLDERS = 64  # that a version may have before an append makes one of them
NAME = re.compile(r"[^\s/\\][^/\\]{0,99}")
PROVIDERS = ("moonshot", "anthropic", "openai", "fixture")


class ConflictError(RuntimeError):
    """Another writer has made the next version of a table."""


class ActiveRunError(RuntimeError):
    """A corpus has a run that hasn't ended."""


def whole_chunk_claims(chunks: DataFrame) -> DataFrame:
    """The extractor that needs no model: each chunk is one claim, and its sentences that define a quoted term are definitions."""
    define = r"[\"“]([^\"”]{1,80})[\"”]\s*,?\s*(?:means|shall\s+mean)\b[^.]*\.?"
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(define), F.lit(1)).alias("term"), F.regexp_extract_all("text", F.lit(define), F.lit(0)).alias("sentence"))
    as_struct = F.transform(found, lambda x: F.struct(x["term"].alias("term"), x["sentence"].alias("definition_text"), x["sentence"].alias("containing_sentence")))
    return chunks.select("doc_id", "chunk_id", F.array(F.trim("text")).alias("claims"), as_struct.alias("definitions"))


class Workspace:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = lambda p: p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Tables

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _version(self, name: str) -> str | None:
        path = self._path(name)
        if not self._fs(path).exists(path):
            return None
        marks = [s.getPath().getName() for s in self._fs(path).listStatus(path) if s.getPath().getName().startswith("VERSION-")]
        return max(marks).removeprefix("VERSION-") if marks else None

    def _folders(self, name: str, version: str) -> list[str]:
        mark = self._path(name, f"VERSION-{version}")
        stream = self._fs(mark).open(mark)
        try:
            return bytes(stream.readAllBytes()).decode().split()
        finally:
            stream.close()

    def _commit(self, name: str, before: str | None, folders: list[str]) -> None:
        """The version after `before`; a ConflictError if it is there already."""
        mark = self._path(name, f"VERSION-{int(before or 0) + 1:08d}")
        try:
            stream = self._fs(mark).create(mark, False)
        except Exception as e:
            raise ConflictError(f"{name} has been changed by another writer") from e
        stream.write("\n".join(folders).encode())
        stream.close()

    def _put(self, name: str, df: DataFrame) -> str:
        """A new folder with the rows, in the table's columns."""
        schema = self.spark.createDataFrame([], next(s for _, n, s in MIGRATIONS if n == name)).schema
        there, folder = set(df.columns), uuid.uuid4().hex
        df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in there else F.lit(None).cast(f.dataType).alias(f.name) for f in schema)).write.parquet(f"{self.folder}/{name}/{folder}")
        return folder

    def migrate(self) -> list[int]:
        """Makes the tables that aren't there; gives the numbers of the changes that were new."""
        new = []
        for number, name, schema in MIGRATIONS:
            if self._version(name) is None:
                self.write(name, self.spark.createDataFrame([], schema))
                new.append(number)
        return new

    def read(self, name: str) -> DataFrame:
        schema = next(s for _, n, s in MIGRATIONS if n == name)
        folders = self._folders(name, self._version(name))
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{name}/{f}" for f in folders))

    def write(self, name: str, df: DataFrame) -> None:
        """The next version: rows first, then its mark."""
        before = self._version(name)
        self._commit(name, before, [self._put(name, df)])

    def append(self, name: str, df: DataFrame, key: str | None = None) -> None:
        """Adds rows; with a key only those it lacks. Only the new rows are written."""
        before = self._version(name)
        folders = self._folders(name, before)
        new = df if key is None else df.dropDuplicates([key]).join(self.read(name).select(key), key, "left_anti")
        if len(folders) >= FOLDERS:
            self._commit(name, before, [self._put(name, self.read(name).unionByName(new, allowMissingColumns=True))])
        else:
            self._commit(name, before, [*folders, self._put(name, new)])

    def orphans(self) -> DataFrame:
        """table_name, key, n: rows that name a row of another table which isn't there."""
        out = []
        for table, key, parent in KEYS:
            there = self.read(parent)
            out.append(store.orphans(self.read(table), there, key).agg(F.count("*").alias("n")).select(F.lit(table).alias("table_name"), F.lit(key).alias("key"), "n"))
        every = out[0]
        for x in out[1:]:
            every = every.unionByName(x)
        return every.filter("n > 0")

    # Corpora

    def corpus_id(self, name: str) -> str:
        """By name, then by id; neither raises, with the names there are."""
        rows = self.read("corpora").select("corpus_id", "corpus_name").collect()
        for r in rows:
            if r["corpus_name"] == name:
                return r["corpus_id"]
        for r in rows:
            if r["corpus_id"] == name:
                return name
        raise ValueError(f"no corpus {name}; there are {', '.join(sorted(r['corpus_name'] for r in rows)) or 'none'}")

    def create_corpus(self, name: str, path: str = "", provider: str = "moonshot", *, reuse: bool = True) -> str:
        """Its id. A name that is taken is reused, or raises. An unknown provider becomes the default."""
        if not NAME.fullmatch(name):
            raise ValueError("a corpus name has 1 to 100 characters and no slash")
        there = self.read("corpora").filter(F.col("corpus_name") == name).first()
        if there:
            if not reuse:
                raise ValueError(f"corpus {name} is there already")
            return there["corpus_id"]
        row = self.spark.range(1).select(hash_id(F.lit(name)).alias("corpus_id"), F.lit(name).alias("corpus_name"), F.lit(path).alias("corpus_path"), F.lit(provider if provider in PROVIDERS else PROVIDERS[0]).alias("judge_provider"), F.localtimestamp().alias("created_at"))
        self.append("corpora", row)
        return self.corpus_id(name)

    def rename_corpus(self, name: str, new: str) -> None:
        if not NAME.fullmatch(new):
            raise ValueError("a corpus name has 1 to 100 characters and no slash")
        own = self.corpus_id(name)
        self.write("corpora", self.read("corpora").withColumn("corpus_name", F.when(F.col("corpus_id") == own, new).otherwise(F.col("corpus_name"))))

    def delete_corpus(self, name: str, *, sure: bool) -> None:
        """With all that hangs on it; vectors and verdicts stay, as they are keyed by content."""
        if not sure:
            raise ValueError("deleting a corpus has to be confirmed")
        own = self.corpus_id(name)
        tables = {"corpora": self.read("corpora"), "documents": self.read("documents"), "assertions": self.read("assertions"), "runs": self.read("run_events"), "findings": self.read("findings")}
        after = store.delete_corpus(tables, own)
        for table, key in (("findings", "findings"), ("run_events", "runs"), ("assertions", "assertions"), ("documents", "documents"), ("corpora", "corpora")):
            self.write(table, after[key])

    def reassign(self, where: str, to: str) -> None:
        self.write("documents", store.reassign(self.read("documents"), where, self.corpus_id(to)))

    def adopt_orphans(self, corpus: str) -> None:
        """Documents from before there were corpora go to one."""
        own = self.create_corpus(corpus)
        self.write("documents", store.backfilled(self.read("documents"), corpus_id=own))

    # Runs

    def event(self, run_id: str, corpus_id: str, kind: str, status: str, message: str = "") -> None:
        seq = self.read("run_events").filter(F.col("run_id") == run_id).count()
        self.append("run_events", self.spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(corpus_id).alias("corpus_id"), F.lit(kind).alias("run_kind"), F.lit(status).alias("status"), F.lit(seq).alias("seq"), F.localtimestamp().alias("at"), F.lit(message).alias("message")))

    def runs(self) -> DataFrame:
        """run_id, corpus_id, run_kind, run_status, started_at, finished_at."""
        e = self.read("run_events")
        who = e.groupBy("run_id").agg(F.first("corpus_id").alias("corpus_id"), F.first("run_kind").alias("run_kind"))
        return audit.run_states(e.select("run_id", "status", "at", "seq")).withColumnRenamed("status", "run_status").join(who, "run_id")

    def begin(self, corpus_id: str, kind: str) -> str:
        """A run's id; raises while the corpus has another."""
        if not self.active_runs(corpus_id).isEmpty():
            raise ActiveRunError("the corpus has a run that hasn't ended")
        run_id = uuid.uuid4().hex[:16]
        self.event(run_id, corpus_id, kind, "running")
        return run_id

    def clear_stuck(self, corpus: str) -> int:
        """Ends all runs of a corpus that haven't, as failed."""
        own = self.corpus_id(corpus)
        stuck = self.runs().filter((F.col("corpus_id") == own) & F.col("run_status").isin("pending", "running")).select("run_id", "run_kind").collect()
        for r in stuck:
            self.event(r["run_id"], own, r["run_kind"], "failed", "cleared")
        return len(stuck)

    # Steps

    def count(self, run_id: str, **counts) -> None:
        """A run's counters, or some of them; the latest of each are its state."""
        row = self.spark.range(1).select(F.lit(run_id).alias("run_id"), F.localtimestamp().alias("at"), *(F.lit(v).alias(k) for k, v in counts.items()))
        self.append("run_counters", row)

    def counters(self, run_id: str) -> dict:
        """n_assertions, n_pairs_gated, n_pairs_judged, n_findings, n_files_total, n_files_done, notes of a run, null where they aren't known."""
        names = ["n_assertions", "n_pairs_gated", "n_pairs_judged", "n_findings", "n_files_total", "n_files_done", "notes"]
        rows = self.read("run_counters").filter(F.col("run_id") == run_id)
        return rows.agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in names)).first().asDict()

    def progress(self, run_id: str) -> dict:
        """A run's live counters (audit.live_counters)."""
        c = self.counters(run_id)
        run = self.runs().filter(F.col("run_id") == run_id).select("run_id", "corpus_id", "run_kind", "run_status", "started_at", "finished_at", F.timestamp_diff("SECOND", "started_at", F.coalesce("finished_at", F.localtimestamp())).alias("elapsed"), *(F.lit(v).cast("long" if k != "notes" else "string").alias(k) for k, v in c.items()))
        return audit.live_counters(run, self.read("findings").filter(F.col("run_id") == run_id), self.read("multi_party_findings").filter(F.col("run_id") == run_id)).first().asDict()

    def events(self, run_id: str, *, poll: float = 1.0, most: int = 3600, tail: float = 5.0) -> Iterator[dict]:
        """A run's progress every `poll` seconds until it has ended, at most `most` times; the last state once more after `tail` seconds, then no more."""
        for _ in range(most):
            now = self.progress(run_id)
            yield now
            if now["run_status"] in audit.TERMINAL:
                time.sleep(tail)
                yield self.progress(run_id) | {"closed": True}
                return
            time.sleep(poll)

    def in_background(self, step: Callable[[], object]) -> threading.Thread:
        """A step (ingest or check) in a thread of its own; what it raises is in the log, and in the run's events if it has begun one."""
        def run() -> None:
            try:
                step()
            except Exception:
                logging.getLogger("dissona").exception("a step in the background broke off")

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        return thread

    def add_files(self, folder: str, corpus: str, *, new: bool = False, **options) -> threading.Thread:
        """Ingests files into a corpus in the background; a name that is taken (new) or a run that hasn't ended raises first."""
        own = self.create_corpus(corpus, folder, reuse=not new)
        if not self.active_runs(own).isEmpty():
            raise ActiveRunError("the corpus has a run that hasn't ended")
        return self.in_background(lambda: self.ingest(folder, corpus, **options))

    def active_runs(self, corpus_id: str) -> DataFrame:
        return self.runs().filter((F.col("corpus_id") == corpus_id) & F.col("run_status").isin("pending", "running"))

    def active_corpus(self, requested: str | None = None) -> str | None:
        first = audit.active_corpus(self.read("corpora"), self.runs(), requested).first()
        return first["corpus_id"] if first else None

    def ingest(self, folder: str, corpus: str, *, config: readers.Config | None = None, embedder: plugins.Embedder | None = None, extract=whole_chunk_claims, identify=None, loaders: dict | None = None, progress: Callable[[int, int], None] | None = None) -> dict:
        """Files to documents, chunks, assertions and vectors; counts of them. Junk assertions are dropped and listed. progress gets the files done and all files."""
        config = config or readers.Config()
        own = self.create_corpus(corpus, folder, config.judge_provider)
        run = self.begin(own, "ingest")
        try:
            now = F.localtimestamp()
            loaded = pipeline.durable(readers.load_corpus(self.spark, folder, loaders))
            n_files, tell = loaded.count(), progress or (lambda done, every: None)
            self.count(run, n_files_total=n_files, n_files_done=0)
            tell(0, n_files)
            docs = loaded.select("doc_id", F.lit(own).alias("corpus_id"), "source_path", "title", now.alias("ingested_at"))
            docs = docs if identify is None else docs.join(identify(loaded), "doc_id", "left")
            old = self.read("documents")
            both = store.insert_documents(old, docs.select(*(c if c in docs.columns else F.lit(None).cast("string").alias(c) for c in old.columns)), ["source_path"])
            self.write("documents", both)
            chunks = pipeline.durable(chunk_documents(loaded.dropDuplicates(["doc_id"]), max_chars=config.max_chunk_chars, overlap_chars=config.chunk_overlap_chars))
            found = pipeline.durable(store.payload_assertions(extract(chunks)).join(chunks.select("chunk_id", "char_start", "char_end"), "chunk_id", "left"))
            kept = found
            if config.junk_filter_enabled:
                kept = found.filter(junk_assertion("assertion_text").isNull())
                self.append("junk_drops", sinks.junk_drops(found.withColumnRenamed("assertion_text", "text"), "assertion", junk_assertion("text")))
            self.append("assertions", kept.withColumn("created_at", now), "assertion_id")
            n = self.embed_pending(embedder or plugins.HashEmbedder())
            empty = [r["source_path"] for r in readers.empty_texts(loaded).limit(1000).collect()]
            self.count(run, n_files_done=n_files, n_assertions=kept.count(), notes=json.dumps({"empty_text_files": empty}))
            self.event(run, own, "ingest", "done")
            tell(n_files, n_files)
        except Exception as e:
            self.event(run, own, "ingest", "failed", str(e)[:500])
            raise
        return {"documents": loaded.count(), "chunks": chunks.count(), "assertions": kept.count(), "embedded": n}

    def embed_pending(self, embedder: plugins.Embedder) -> int:
        """Vectors for assertions without one, of all corpora."""
        have = self.read("embeddings")
        todo = self.read("assertions").join(have.select("assertion_id"), "assertion_id", "left_anti").select("assertion_id", "doc_id", "assertion_text")
        made = pipeline.durable(todo.select("assertion_id", "doc_id", plugins.embedding(todo, "assertion_text", embedder).alias("embedding"), F.localtimestamp().alias("embedded_at")))
        if not have.filter(F.size("embedding") != embedder.width).isEmpty():
            raise ValueError("vectors of another width are there")
        self.append("embeddings", store.checked_vectors(made, embedder.width))
        return made.count()

    def rebuild_index(self, embedder: plugins.Embedder) -> int:
        """All vectors anew."""
        a = self.read("assertions")
        self.write("embeddings", a.select("assertion_id", "doc_id", plugins.embedding(a, "assertion_text", embedder).alias("embedding"), F.localtimestamp().alias("embedded_at")))
        return a.count()

    def _members(self, own: str) -> DataFrame:
        return self.read("assertions").join(self.read("documents").filter(F.col("corpus_id") == own).select("doc_id"), "doc_id", "left_semi")

    def _pairs(self, own: str, config: readers.Config, threshold: float | None = None, k: int | None = None) -> DataFrame:
        return pipeline.gated_pairs(self.read("embeddings"), members=self._members(own).select("assertion_id"), k=k or config.gate_top_k, threshold=config.gate_similarity_threshold if threshold is None else threshold)

    def _definitions(self, own: str) -> DataFrame:
        return definitions.with_organisation(definitions.definitions(self._members(own)), self.read("documents"))

    def estimate(self, corpus: str, config: readers.Config | None = None) -> DataFrame:
        """n_calls, cost_low, cost_high of a check."""
        config, own = config or readers.Config(), self.corpus_id(corpus)
        pairs = self._pairs(own, config).agg(F.count("*").alias("n")) if config.pairwise_enabled else self.spark.range(1).select(F.lit(0).cast("long").alias("n"))
        defs = definitions.definition_pair_counts(self._definitions(own), across_organisations=not config.scope_definitions_by_org).select(F.col("n_to_judge").alias("n"))
        return audit.cost_estimate(pairs, defs, config.judge_provider)

    def check(self, corpus: str, *, judge: plugins.Judge, checker: plugins.NliChecker | None = None, multi_judge: plugins.MultiPartyJudge | None = None, config: readers.Config | None = None) -> str:
        """A run of the detectors that are on; its id. Pairs are made only if pairwise is on; deep needs it."""
        config, own = config or readers.Config(), self.corpus_id(corpus)
        if config.deep and not config.pairwise_enabled:
            raise ValueError("deep needs pairwise")
        audit.guard_cost(self.estimate(corpus, config), config.max_cost) if config.max_cost is not None else None
        run = self.begin(own, "check")
        try:
            members = self._members(own)
            n_assertions, gated = members.count(), 0
            self.count(run, n_assertions=n_assertions)
            made = [pipeline.definition_pass(members, self.read("documents"), run_id=run, judge=judge, scoped=config.scope_definitions_by_org)]
            if config.pairwise_enabled:
                strong = pipeline.durable(self._pairs(own, config))
                gated = strong.count()
                self.count(run, n_pairs_gated=gated)
                made.append(pipeline.pairwise_pass(strong, members, run_id=run, checker=checker or plugins.FixtureNli({}), judge=judge, threshold=config.nli_contradiction_threshold))
                if config.deep:
                    weak = self._pairs(own, config, config.triangle_weak_threshold, config.triangle_weak_top_k)
                    found = triangles.best_triangles(triangles.union_edges(strong, weak), members, config.max_triangles_per_run, id_column="assertion_id")
                    found = triangles.with_strong_edges(found, strong)
                    self.append("multi_party_findings", pipeline.triangle_findings(found, run) if multi_judge is None else pipeline.judged_triangles(found, members, run, multi_judge), "finding_id")
            found = made[0]
            for df in made[1:]:
                found = found.unionByName(df, allowMissingColumns=True)
            found = pipeline.durable(found)
            self.append("findings", found)
            n = found.filter("detector_type = 'contradiction'").agg(F.count("*").alias("judged"), F.count_if(F.col("judge_verdict").isin(*audit.FOUND)).alias("found")).first()
            self.count(run, n_pairs_gated=gated, n_pairs_judged=n["judged"], n_findings=n["found"])
            self.event(run, own, "check", "done")
        except Exception as e:
            self.event(run, own, "check", "failed", str(e)[:500])
            raise
        return run

    def review(self, a: str, b: str, detector: str, verdict: str | None, note: str = "") -> None:
        """A reviewer's verdict on a pair; None takes the last one back."""
        self.review_all((a, b), detector, verdict, note)

    def review_all(self, ids: tuple[str, ...], detector: str, verdict: str | None, note: str = "") -> None:
        """A reviewer's verdict on assertions, of a pair or of more."""
        if verdict is not None and verdict not in audit.REVIEWS:
            raise ValueError(f"not a verdict: {verdict}")
        self.append("verdict_events", self.spark.range(1).select(F.lit(":".join(sorted(ids))).alias("pair_key"), F.lit(detector).alias("detector_type"), F.lit(verdict).cast("string").alias("verdict"), F.lit(note).alias("note"), F.localtimestamp().alias("set_at")))

    # Reading

    def latest_run(self, corpus: str | None = None) -> str | None:
        r = self.runs() if corpus is None else self.runs().filter(F.col("corpus_id") == self.corpus_id(corpus))
        first = audit.last_check(r).first()
        return first["run_id"] if first else None

    def findings(self, run_id: str) -> DataFrame:
        return audit.hydrated(audit.filtered_findings(self.read("findings"), run_id=run_id), self.read("assertions"), self.read("documents"), audit.current_reviews(self.read("verdict_events")))

    def _report(self, run_id: str | None) -> DataFrame:
        run_id = run_id or self.latest_run()
        if run_id is None:
            raise ValueError("there is no run")
        f = pipeline.durable(self.findings(run_id))
        counts = {k: v or 0 for k, v in self.counters(run_id).items()}
        terms = self.read("assertions").select(F.col("assertion_id").alias("assertion_a_id"), "term")
        multi = self.read("multi_party_findings").filter(F.col("run_id") == run_id)
        return sinks.report_lines({"run_id": run_id} | counts, f, sinks.multi_party_sections(multi, self.read("assertions")), sinks.definition_sections(f.join(terms, "assertion_a_id")))

    def report(self, run_id: str | None = None, most: int = sinks.MOST_SHOWN) -> str:
        """The report of a run, by default the latest check, as one string: of each part the first `most` findings."""
        return sinks.shown_report(self._report(run_id), most)

    def write_report(self, path: str, run_id: str | None = None) -> None:
        """The whole report, as a folder of text files."""
        sinks.write_report(self._report(run_id), path)

    def precision(self, corpus: str | None = None) -> DataFrame:
        runs = self.runs() if corpus is None else self.runs().filter(F.col("corpus_id") == self.corpus_id(corpus))
        f, multi = audit.of_corpora(self.read("findings"), runs), audit.of_corpora(self.read("multi_party_findings"), runs)
        return evaluation.detector_precision(audit.reviewed_rows(f, multi, audit.current_reviews(self.read("verdict_events"))))

    def assertion(self, assertion_id: str) -> DataFrame:
        """An assertion with its document's label."""
        return audit.assertion_detail(self.read("assertions"), self.read("documents"), assertion_id)

    def vector(self, assertion_id: str) -> DataFrame:
        return store.vector_of(self.read("embeddings"), assertion_id)

    def warning(self, corpus: str, config: readers.Config | None = None) -> str:
        """What to know before definitions of a corpus are compared; empty where there is nothing."""
        config, own = config or readers.Config(), self.corpus_id(corpus)
        docs = self.read("documents").filter(F.col("corpus_id") == own)
        buckets = organisations.organisation_buckets(docs, F.struct("source_path", "doc_id"), with_order=True)
        return organisations.corpus_warning(buckets, config.scope_definitions_by_org).first()["message"]

    def stats(self) -> DataFrame:
        a = self.read("assertions").join(self.read("embeddings").select("assertion_id", "embedded_at"), "assertion_id", "left")
        return store.store_stats(self.read("documents"), a)

    def sidebar(self) -> DataFrame:
        return audit.sidebar(self.read("corpora"), self.read("documents"), self.read("assertions"), self.runs())

    def neighbours(self, k: int) -> DataFrame:
        """The index's own answer, over all corpora."""
        x = self.read("embeddings").withColumn("id", F.xxhash64("assertion_id"))
        return gate.top_neighbours(x, k)

    def output_name(self, kind: str, run_id: str = "") -> str:
        return sinks.output_name(kind, datetime.now(), run_id)
