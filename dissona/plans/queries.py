"""The registered queries: each operator over whole driver tables, with the same in SQL beside it.

The driver's tables stand in for the engine's: lines of documents for extracted elements, parts for definitions, orders and their
customers for sentences with numbers, line items for findings (runs are orders, assertions parts and suppliers), events for runs and
reviewer verdicts, conversations for findings of several runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dissona.functions import ids, junk, quantities, terms, text
from dissona.operators import audit, chunking, definitions, evaluation, gate, numeric, organisations, store, triangles
from dissona.runtime import table
from dissona.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
K, STRONG, WEAK = 20, 0.3, 0.27


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# Relations


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("doc_id"))


def _edges(spark: SparkSession, sf: str, threshold: float = STRONG) -> DataFrame:
    return gate.ann_gate(_vectors(spark, sf), k=K, threshold=threshold)


def _edges_sql(threshold: float, name: str = "edges") -> str:
    return f"""sims AS (SELECT a.vec_id src, b.vec_id dst, a.label sl, b.label dl, round(coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), 9) s FROM embeddings a, embeddings b),
{name}_near AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) r FROM sims),
{name} AS (SELECT least(src, dst) a_id, greatest(src, dst) b_id, max(s) score FROM {name}_near WHERE r <= {K + 1} AND src <> dst AND sl <> dl AND s >= {threshold} GROUP BY 1, 2)"""


# Definition texts by a part's number modulo 17: those that only point elsewhere, those that look like it, none, and real ones.
_MEANINGS = {1: "has the meaning assigned in Section 3", 2: " The  meanings given in Section 4", 3: "shall have the meaning referred to below", 4: "As set forth in Schedule A", 5: "as defined", 6: "the amounts set forth in Schedule A", 7: "has the meaning intended by both", 8: "the meaning referred to below", 9: " ", 10: None, 11: "as definedly stated"}


def _meaning(key: F.Column) -> F.Column:
    text = F.concat(F.lit(" an item of size "), (key % 3).cast("string"), F.when(key % 2 == 0, " ").otherwise(""))
    for n, t in _MEANINGS.items():
        text = F.when(key % 17 == n, F.lit(t).cast("string")).otherwise(text)
    return text


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Assertions and documents: every part defines the term of its name, type and brand; a document for each part, of an organisation by brand."""
    p = table(spark, sf, "part")
    term = F.concat(F.when(F.col("p_partkey") % 2 == 0, "The ").otherwise(""), F.initcap("p_name"), F.lit(" "), "p_type", F.lit(" "), "p_brand", F.when(F.col("p_partkey") % 3 == 0, "s").otherwise(""))
    body = F.concat(F.lit(" means an item of size "), (F.col("p_size") % 3).cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".").otherwise(""))
    a = p.select(F.col("p_partkey").alias("assertion_id"), F.col("p_partkey").alias("doc_id"), term.alias("term"), F.concat(F.lit('"'), term, F.lit('"'), F.when(F.col("p_partkey") % 10 == 0, " has the meaning set forth herein").otherwise(body)).alias("assertion_text"), F.lit("definition").alias("kind"))
    d = p.select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") % 4 == 0, None).otherwise(F.concat(F.lit("Maker "), (F.col("p_size") % 4).cast("string"), F.when(F.col("p_partkey") % 2 == 0, " Inc.").otherwise(" LLC"))).alias("org_label"))
    return a, d


_PART_TEXT_SQL = """'"' || (CASE WHEN p_partkey % 2 = 0 THEN 'The ' ELSE '' END) || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' ' || p_type || ' ' || p_brand || (CASE WHEN p_partkey % 3 = 0 THEN 's' ELSE '' END) || '" means an item of size ' || (p_size % 3)::VARCHAR || (CASE WHEN p_partkey % 2 = 0 THEN '.' ELSE '' END)"""
_DEFS_SQL = """defs AS (SELECT p_partkey id, lower(p_name || ' ' || p_type || ' ' || p_brand) term_key,
 CASE WHEN p_size % 4 = 0 THEN '' ELSE 'maker ' || (p_size % 4)::VARCHAR END org_key,
 lower((CASE WHEN p_partkey % 2 = 0 THEN 'The ' ELSE '' END) || p_name || ' ' || p_type || ' ' || p_brand || (CASE WHEN p_partkey % 3 = 0 THEN 's' ELSE '' END)) || '" means an item of size ' || (p_size % 3)::VARCHAR norm
 FROM part WHERE p_partkey % 10 <> 0),
pairs AS (SELECT a.id a_id, b.id b_id, a.term_key, (a.org_key <> '' AND b.org_key <> '' AND a.org_key <> b.org_key) suppressed, a.norm = b.norm same_text FROM defs a JOIN defs b ON a.term_key = b.term_key AND a.id < b.id)"""


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders").repartition("o_custkey"), table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")  # a customer's orders together, as the join would have them
    verb = F.when(F.col("o_orderstatus") == "F", "rose").when(F.col("o_orderstatus") == "O", "fell").otherwise("was")
    sentence = F.concat(F.lit("The "), F.lower("c_mktsegment"), F.lit(" revenue, "), verb, F.lit(" $"), F.floor("o_totalprice").cast("long").cast("string"), F.lit(" million in "), F.year("o_orderdate").cast("string"), F.lit("."))
    return o.join(c, "o_custkey").select("o_orderkey", "o_custkey", "o_orderdate", sentence.alias("sentence"))


_SENT_SQL = """sent AS (SELECT o_orderkey, o_custkey, o_orderdate, lower(c_mktsegment) || ' revenue' || (CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN ' was' ELSE '' END) metric, floor(o_totalprice)::DOUBLE "value", 'million_usd' unit, CASE o_orderstatus WHEN 'F' THEN 'up' WHEN 'O' THEN 'down' ELSE 'none' END polarity, year(o_orderdate)::VARCHAR scope FROM orders JOIN customer ON c_custkey = o_custkey),
pairs AS (SELECT a.*, b.o_orderkey b_key, b.metric b_metric, b."value" b_value, b.polarity b_polarity, b.scope b_scope FROM sent a JOIN sent b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey)"""
_FLIP = "metric = b_metric AND scope = b_scope AND ((polarity = 'up' AND b_polarity = 'down') OR (polarity = 'down' AND b_polarity = 'up'))"


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")  # noqa: E741
    return l.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("finding_id"), F.col("l_orderkey").alias("run_id"), F.concat(F.lit("p"), "l_partkey").alias("assertion_a_id"), F.concat(F.lit("s"), "l_suppkey").alias("assertion_b_id"),
        F.when(F.col("l_linestatus") == "O", "contradiction").otherwise("definition_inconsistency").alias("detector_type"), F.when(F.col("l_returnflag") == "A", "contradiction").when(F.col("l_returnflag") == "R", "not_contradiction").otherwise("uncertain").alias("judge_verdict"), F.col("l_discount").alias("gate_score"), (F.col("l_tax") == 0).alias("suppressed"), "l_quantity", "l_extendedprice", "l_shipdate",
    )


_FINDINGS_SQL = """findings AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) finding_id, l_orderkey run_id, 'p' || l_partkey a, 's' || l_suppkey b, CASE WHEN l_linestatus = 'O' THEN 'contradiction' ELSE 'definition_inconsistency' END detector_type, CASE l_returnflag WHEN 'A' THEN 'contradiction' WHEN 'R' THEN 'not_contradiction' ELSE 'uncertain' END judge_verdict, l_discount gate_score, l_tax = 0 suppressed, l_quantity, l_extendedprice, l_shipdate FROM lineitem)"""


def _reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict events: of parts and suppliers by an event's user and number."""
    e = table(spark, sf, "events")
    v = F.when(F.col("event_type") == "view", "confirmed").when(F.col("event_type") == "click", "false_positive").when(F.col("event_type") == "purchase", "dismissed").when(F.col("event_type") == "signup", "confirmed")
    key = F.concat(F.lit("p"), (F.col("event_id") * 7 % 500).cast("string"), F.lit(":s"), (F.col("user_id") % 50).cast("string"))
    return e.select(key.alias("pair_key"), F.when(F.col("event_id") % 2 == 0, "contradiction").otherwise("definition_inconsistency").alias("detector_type"), v.alias("verdict"), F.col("props").alias("note"), F.struct("ts", "event_id").alias("set_at"))


_REVIEWS_SQL = """reviews AS (SELECT * FROM (SELECT 'p' || (event_id * 7 % 500) || ':s' || (user_id % 50) pair_key, CASE WHEN event_id % 2 = 0 THEN 'contradiction' ELSE 'definition_inconsistency' END detector_type,
 CASE event_type WHEN 'view' THEN 'confirmed' WHEN 'click' THEN 'false_positive' WHEN 'purchase' THEN 'dismissed' WHEN 'signup' THEN 'confirmed' END verdict, row_number() OVER (PARTITION BY event_id * 7 % 500, user_id % 50, event_id % 2 ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r = 1 AND verdict IS NOT NULL),
reviewed AS (SELECT f.*, v.verdict reviewer_verdict FROM findings f LEFT JOIN reviews v ON v.pair_key = f.a || ':' || f.b AND v.detector_type = f.detector_type)"""


def _reviewed(spark: SparkSession, sf: str) -> DataFrame:
    """Findings with their reviews, which have 50,000 keys at most, however many events: they go to the findings."""
    return audit.with_reviews(_findings(spark, sf), F.broadcast(audit.current_reviews(audit.checked_reviews(_reviews(spark, sf)))))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))


_LINES_SQL = "lines AS (SELECT doc_id, u.i - 1 idx, u.t AS text FROM (SELECT doc_id, string_split(text, chr(10)) p FROM documents), LATERAL (SELECT unnest(p) t, generate_subscripts(p, 1) i) u)"
_BARE = "trim(text, ' ' || chr(9) || chr(13))"
_ALPHA = r"length(regexp_replace({0}, '[^\p{{L}}]', '', 'g'))"


# Gates and graphs


@query(f"WITH {_edges_sql(STRONG)} SELECT a_id, b_id, round(score, 6) score FROM edges")
def ann_gate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).select("a_id", "b_id", F.round("score", 6).alias("score"))


@query("SELECT a.n_nationkey a_id, b.n_nationkey b_id, 1.0::DOUBLE score FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
def all_pairs_gate(spark: SparkSession, sf: str) -> DataFrame:
    return gate.all_pairs_gate(table(spark, sf, "nation"), id_column="n_nationkey", doc_column="n_regionkey")


@query(f"WITH {_edges_sql(STRONG)}, m AS (SELECT vec_id FROM embeddings WHERE label < 5) SELECT count(*) FILTER (a_id IN (FROM m) AND b_id IN (FROM m)) n_kept, count(*) FILTER (NOT (a_id IN (FROM m) AND b_id IN (FROM m))) n_dropped FROM edges")
def gate_corpus_filter(spark: SparkSession, sf: str) -> DataFrame:
    return gate.corpus_drops(_edges(spark, sf), _vectors(spark, sf).filter("doc_id < 5"))


_TRI_SQL = """tri AS (SELECT ab.a_id, ab.b_id, bc.b_id c_id, least(ab.score, ac.score, bc.score) min_edge FROM {0} ab JOIN {0} ac ON ab.a_id = ac.a_id AND ab.b_id < ac.b_id JOIN {0} bc ON bc.a_id = ab.b_id AND bc.b_id = ac.b_id
 JOIN embeddings x ON x.vec_id = ab.a_id JOIN embeddings y ON y.vec_id = ab.b_id JOIN embeddings z ON z.vec_id = ac.b_id WHERE NOT (x.label = y.label AND y.label = z.label))"""


@query(f"WITH {_edges_sql(WEAK)}, {_TRI_SQL.format('edges')} SELECT a_id, b_id, c_id, round(min_edge, 6) min_edge FROM tri ORDER BY tri.min_edge DESC, a_id, b_id, c_id LIMIT 100")
def triangles_topn(spark: SparkSession, sf: str) -> DataFrame:
    return triangles.best_triangles(_edges(spark, sf, WEAK), _vectors(spark, sf), 100).select("a_id", "b_id", "c_id", F.round("min_edge", 6).alias("min_edge"))


@query(f"""WITH {_edges_sql(WEAK)}, strong AS (SELECT * FROM edges WHERE score >= {STRONG}), {_TRI_SQL.format('edges')}, top AS (SELECT * FROM tri ORDER BY min_edge DESC, a_id, b_id, c_id LIMIT 100)
SELECT a_id, b_id, c_id, n_strong FROM (SELECT t.*, (SELECT count(*) FROM strong s WHERE (s.a_id = t.a_id AND s.b_id = t.b_id) OR (s.a_id = t.a_id AND s.b_id = t.c_id) OR (s.a_id = t.b_id AND s.b_id = t.c_id))::INT n_strong FROM top t) WHERE n_strong >= 2""")
def triangles_strong2(spark: SparkSession, sf: str) -> DataFrame:
    strong, weak = _edges(spark, sf), _edges(spark, sf, WEAK)
    found = triangles.best_triangles(triangles.union_edges(strong, weak), _vectors(spark, sf), 100)
    return triangles.with_strong_edges(found, strong).select("a_id", "b_id", "c_id", "n_strong")


@query("SELECT least(l_partkey, l_suppkey) u, greatest(l_partkey, l_suppkey) v, max(l_discount) s FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2")
def edge_dedup_max(spark: SparkSession, sf: str) -> DataFrame:
    return triangles.canonical_edges(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a_id"), F.col("l_suppkey").alias("b_id"), F.col("l_discount").alias("score")))


@query(f"WITH {_edges_sql(WEAK)} SELECT least(a_id::VARCHAR, b_id::VARCHAR) || ':' || greatest(a_id::VARCHAR, b_id::VARCHAR) pair_key FROM edges")
def pair_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf, WEAK).select(ids.pair_key(F.col("a_id").cast("string"), F.col("b_id").cast("string")).alias("pair_key"))


# Documents and text


@query("SELECT doc_id, substr(sha256(text), 1, 16) content_id, substr(sha256(doc_id::VARCHAR || text), 1, 16) assertion_id FROM documents")
def doc_hash_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", ids.hash_id("text").alias("content_id"), ids.hash_id(F.col("doc_id").cast("string"), "text").alias("assertion_id"))


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) r FROM documents) WHERE r = 1")
def doc_dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    return store.first_wins(d, ["h"], ["doc_id"]).select("doc_id", "lang")


_JUNK = ("Page {}", "  {}", "- {} -", "Chapter one ..... {}", "#{} 123-456 / 789", "plain line {}", "page {} of many")


@query(rf"""WITH {_LINES_SQL}, bare AS (SELECT {_BARE} t FROM lines UNION ALL SELECT trim(replace(p, '{{}}', (c_custkey % 2000)::VARCHAR)) FROM customer, (SELECT unnest({list(_JUNK)}) p)) SELECT reason, count(*) n FROM (SELECT CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, '^(page\s+)?\d{{1,4}}$', 'i') OR regexp_matches(t, '^[-–—]\s*\d{{1,4}}\s*[-–—]$') THEN 'page_number' WHEN regexp_matches(t, '\.{{5,}}') THEN 'dot_leader' WHEN length(t) >= 8 AND {_ALPHA.format('t')} / length(t)::DOUBLE < 0.15 THEN 'mostly_non_alpha' END reason FROM bare) GROUP BY 1""")
def junk_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents, and for each customer lines that are junk, or look like it."""
    number = (F.col("c_custkey") % 2000).cast("string")
    planted = table(spark, sf, "customer").select(F.explode(F.array(*(F.replace(F.lit(p), F.lit("{}"), number) for p in _JUNK))).alias("text"))
    return _lines(spark, sf).select("text").unionByName(planted).groupBy(junk.junk_line("text").alias("reason")).agg(F.count("*").alias("n"))


_POINTING = ("See Section {}.", "as defined in Article {}", "AS SET FORTH herein {}", "As provided above, {} of the agreement is ended", "See you there, {}", "described in Section {}", "as describedly in Section {}")


@query(rf"""WITH {_LINES_SQL}, bare AS (SELECT {_BARE} t FROM lines UNION ALL SELECT replace(p, '{{}}', c_custkey::VARCHAR) FROM customer, (SELECT unnest({list(_POINTING)}) p)) SELECT reason, count(*) n FROM (SELECT CASE WHEN regexp_matches(t, '\.{{5,}}') THEN 'dot_fragment' WHEN length(t) >= 8 AND {_ALPHA.format('t')} / length(t)::DOUBLE < 0.15 THEN 'mostly_non_alpha' WHEN {_ALPHA.format('t')} < 10 THEN 'near_empty'
 WHEN regexp_matches(t, '^(as\s+(defined|set\s+forth|described|provided|used|referenced)|see)\b', 'i') AND regexp_matches(t, '\b(article|section|paragraph|clause|bylaws?|agreement|exhibit|schedule|herein|hereof|hereunder|above|below)\b', 'i') AND {_ALPHA.format('t')} < 30 THEN 'cross_reference' END reason FROM bare) GROUP BY 1""")
def junk_assertions(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents, and for each customer sentences that only point elsewhere, or look like it."""
    planted = table(spark, sf, "customer").select(F.explode(F.array(*(F.replace(F.lit(p), F.lit("{}"), F.col("c_custkey").cast("string")) for p in _POINTING))).alias("text"))
    return _lines(spark, sf).select("text").unionByName(planted).groupBy(junk.junk_assertion("text").alias("reason")).agg(F.count("*").alias("n"))


@query(rf"SELECT doc_id, {_ALPHA.format('text')} n_alpha, round({_ALPHA.format('text')} / length(text)::DOUBLE, 6) ratio, {_ALPHA.format('text')} < 100 looks_empty, {_ALPHA.format('text')} < 100 AND doc_id % 3 >= 2 AND n_chars * 1000 >= 100000 needs_ocr FROM documents".replace("n_alpha,", "n_alpha,"))
def alpha_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.alpha_count("text").cast("long").alias("n_alpha"), F.round(text.alpha_ratio("text"), 6).alias("ratio"), text.looks_empty("text").alias("looks_empty"), text.needs_ocr("text", F.col("doc_id") % 3, F.col("n_chars") * 1000).alias("needs_ocr"))


@query(rf"""WITH {_LINES_SQL}, bare AS (SELECT doc_id, idx, {_BARE} t FROM lines), kept AS (SELECT * FROM bare WHERE t <> '' AND NOT (regexp_matches(t, '^(page\s+)?\d{{1,4}}$', 'i') OR regexp_matches(t, '^[-–—]\s*\d{{1,4}}\s*[-–—]$') OR regexp_matches(t, '\.{{5,}}') OR (length(t) >= 8 AND {_ALPHA.format('t')} / length(t)::DOUBLE < 0.15)))
SELECT doc_id, idx::BIGINT idx, char_start, char_start + length(t) char_end FROM (SELECT *, coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT char_start FROM kept)""")
def element_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return store.element_text(_lines(spark, sf)).select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


_BLANK = r"\t\x0b\x0c\r \x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"  # white space but for the line's end
_OPENING = "(\"''“‘\\["
_ABBREVIATED = "|".join(sorted(w.replace(".", r"\.") for w in chunking.ABBREVIATIONS))


def _chunks_sql(max_chars: int, overlap: int) -> str:
    """Sentences: pieces between a mark or a line's end and what follows it, put together where a piece ends in an abbreviation. Windows: one after the other."""
    return rf"""WITH RECURSIVE d AS (SELECT doc_id::VARCHAR doc_id, text, regexp_replace(text, '[\n{_BLANK}]+$', '') whole FROM documents WHERE text <> ''),
p AS (SELECT doc_id, text, string_split(regexp_replace(whole, '([.!?]["''”’)\]]{{0,3}}[\n{_BLANK}]+|\n[\n{_BLANK}]*)', '\1' || chr(1), 'g'), chr(1)) parts FROM d),
u AS (SELECT doc_id, unnest(parts) part, generate_subscripts(parts, 1) i, len(parts) n FROM p),
v AS (SELECT doc_id, i, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) e, i = n OR NOT regexp_matches(part, '(^|[\n{_BLANK}{_OPENING}])((?i:{_ABBREVIATED})|\p{{Lu}})\.[{_BLANK}]+$') ends FROM u),
s AS (SELECT doc_id, list(e ORDER BY i) e FROM v WHERE ends GROUP BY 1),
t AS (SELECT doc_id, text, list_concat([0], e[1:len(e) - 1]) starts, list_concat(e[1:len(e) - 1], [length(text)]) ends FROM s JOIN d USING (doc_id)),
w AS (SELECT doc_id, 1 f, greatest(1, len(list_filter(ends, lambda x: x <= {max_chars}))) l, starts, ends FROM t
 UNION ALL SELECT doc_id, f, greatest(i, len(list_filter(ends, lambda x: x - starts[f] <= {max_chars}))) l, starts, ends FROM
  (SELECT doc_id, CASE WHEN tail = f THEN i ELSE tail END f, i, starts, ends FROM (SELECT *, l + 1 i, CASE WHEN {overlap} = 0 THEN l + 1 ELSE greatest(f, least(l + 1, len(list_filter(starts, lambda x: x < ends[l] - {overlap})) + 1)) END tail FROM w WHERE l < len(ends))))
SELECT substr(sha256(doc_id || starts[f]::VARCHAR || ends[l]::VARCHAR), 1, 16) chunk_id, doc_id, substr(text, starts[f]::BIGINT + 1, (ends[l] - starts[f])::BIGINT) AS text, starts[f]::INT char_start, ends[l]::INT char_end FROM w JOIN (SELECT doc_id, text FROM t) USING (doc_id)"""


@query(_chunks_sql(1000, 200))
def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, sf, "documents"), max_chars=1000, overlap_chars=200)


@query(f"""WITH {_LINES_SQL} SELECT assertion_id, doc_id, idx FROM (SELECT substr(sha256(doc_id::VARCHAR || text), 1, 16) assertion_id, doc_id, idx::BIGINT idx, row_number() OVER (PARTITION BY doc_id, text ORDER BY idx) r FROM lines WHERE trim(text) <> '') WHERE r = 1""")
def payload_assertions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("c").alias("chunk_id"), F.split("text", "\n").alias("claims"), F.array().cast("array<struct<term:string,definition_text:string,containing_sentence:string>>").alias("definitions"))
    return store.payload_assertions(d).select("assertion_id", F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("idx"))


@query("SELECT page_id, lower(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '-')) slug, CASE WHEN length(url) > 20 THEN substr(url, 1, 19) || '…' ELSE url END short, coalesce(nullif(CASE WHEN page_id % 2 = 0 THEN '' ELSE url END, ''), page_id::VARCHAR) label FROM pages")
def text_formats(spark: SparkSession, sf: str) -> DataFrame:
    title = F.when(F.col("page_id") % 2 == 0, "").otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", text.slug("url").alias("slug"), text.truncated("url", 20).alias("short"), text.doc_label(title, F.lit(None).cast("string"), "page_id").alias("label"))


# Terms, definitions, organisations


@query("SELECT p_partkey, lower(p_name || ' ' || p_type || ' ' || p_brand) term_key FROM part")
def canonical_terms(spark: SparkSession, sf: str) -> DataFrame:
    a, _ = _parts(spark, sf)
    return a.select(F.col("assertion_id").alias("p_partkey"), terms.canonical_term(F.concat(F.lit(' "'), "term", F.lit('" '))).alias("term_key"))


def _defs(spark: SparkSession, sf: str) -> DataFrame:
    a, d = _parts(spark, sf)
    return definitions.with_organisation(definitions.definitions(a), d)


@query(f"WITH {_DEFS_SQL} SELECT * FROM pairs")
def definition_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return definitions.definition_pairs(_defs(spark, sf), across_organisations=False)


@query(f"WITH {_DEFS_SQL} SELECT count(*) FILTER (NOT suppressed) n_pairs, count(*) FILTER (suppressed) n_suppressed, count(*) FILTER (NOT suppressed AND same_text) n_short_circuited, count(*) FILTER (NOT suppressed AND NOT same_text) n_to_judge FROM pairs")
def definition_counts(spark: SparkSession, sf: str) -> DataFrame:
    return definitions.definition_pair_counts(_defs(spark, sf), across_organisations=False)


_MEANINGS_SQL = "CASE p_partkey % 17 " + " ".join(f"WHEN {n} THEN " + ("NULL" if t is None else f"'{t}'") for n, t in _MEANINGS.items()) + " ELSE ' an item of size ' || p_partkey % 3 || (CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE '' END) END"


_MINED_SQL = r"""WITH d AS (SELECT p_partkey id, CASE WHEN p_partkey % 40 < 20 THEN 'base' ELSE 'doc' || p_partkey % 5 END doc, (CASE WHEN p_partkey % 2 = 0 THEN 'The ' ELSE '' END) || p_type || (CASE WHEN p_partkey % 3 = 0 THEN 's' ELSE '' END) term, lower(p_type) key, trim(""" + _MEANINGS_SQL + r""") t FROM part WHERE p_partkey % 10 <> 0),
k AS (SELECT * FROM d WHERE t <> '' AND NOT regexp_matches(t, '^(has|have|having|shall\s+have)\s+the\s+meanings?\s+(set\s+forth|given|assigned|specified|ascribed|attributed|provided|referred)', 'i') AND NOT regexp_matches(t, '^the\s+meanings?\s+(set\s+forth|given|assigned|specified|ascribed|attributed|provided)', 'i') AND NOT regexp_matches(t, '^as\s+(defined|set\s+forth)\b', 'i'))
SELECT {0} FROM (SELECT a.id a_id, b.id b_id, a.key term_key, CASE WHEN a.t = b.t THEN 'identical' ELSE 'review' END category, a.term, a.t def_a, b.t def_b, substr(a.key, 1, 24) || '_' || substr(sha256(least(a.id::VARCHAR, b.id::VARCHAR) || ':' || greatest(a.id::VARCHAR, b.id::VARCHAR)), 1, 10) pair_id, a.doc doc_a, b.doc doc_b
FROM k a JOIN k b ON a.key = b.key AND a.id < b.id ORDER BY a.doc = b.doc, a.t = b.t, a.key, a.id, b.id LIMIT 3000)"""


def _mined(spark: SparkSession, sf: str) -> DataFrame:
    """Parts define the term of their type, in documents of which one has half of all; the first 3000 pairs."""
    key = F.col("p_partkey")
    term = F.concat(F.when(key % 2 == 0, "The ").otherwise(""), "p_type", F.when(key % 3 == 0, "s").otherwise(""))
    doc = F.when(key % 40 < 20, "base").otherwise(F.concat(F.lit("doc"), (key % 5).cast("string")))
    text = F.concat(F.lit('"'), term, F.when(key % 10 == 0, '" has the meaning set forth herein').otherwise('" means as follows.'))
    a = table(spark, sf, "part").select(key.alias("assertion_id"), doc.alias("doc_id"), term.alias("term"), text.alias("assertion_text"), F.lit("definition").alias("kind"), _meaning(key).alias("definition_text"))
    return definitions.mined_pairs(a, 3000)


@query(_MINED_SQL.replace("{0}", "a_id, b_id, term_key, category, term, def_a, def_b, pair_id"))
def mined_definition_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _mined(spark, sf).select("a_id", "b_id", "term_key", "category", "term", "def_a", "def_b", ids.mined_pair_id(F.col("term_key"), F.col("a_id").cast("string"), F.col("b_id").cast("string")).alias("pair_id"))


@query(f"WITH {_DEFS_SQL} SELECT substr(sha256('run' || 'definition_suppressed' || a_id::VARCHAR || b_id::VARCHAR), 1, 16) finding_id, a_id assertion_a_id, b_id assertion_b_id FROM pairs WHERE suppressed")
def suppressed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = definitions.definition_pairs(_defs(spark, sf), across_organisations=False).withColumns({"a_id": F.col("a_id").cast("string"), "b_id": F.col("b_id").cast("string")})
    return audit.suppressed_findings(pairs, "run").select("finding_id", F.col("assertion_a_id").cast("long").alias("assertion_a_id"), F.col("assertion_b_id").cast("long").alias("assertion_b_id"))


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    form = F.element_at(F.array(*map(F.lit, (" Ltd.", ", Inc", " Trust", ""))), (F.col("c_nationkey") % 4 + 1).cast("int"))
    label = F.when(F.col("c_custkey") % 11 == 0, None).otherwise(F.concat(F.when(F.col("c_custkey") % 2 == 0, "The ").otherwise(""), F.initcap("c_mktsegment"), F.lit(" Group"), form))
    reason = F.when(F.col("c_nationkey") == 3, "llm_error").when(F.col("c_nationkey") == 7, "truncated").otherwise("ok")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), label.alias("org_label"), reason.alias("org_reason"))


_CUST_SQL = """cust AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (CASE WHEN c_custkey % 2 = 0 THEN 'The ' ELSE '' END) || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Group' || [' Ltd.', ', Inc', ' Trust', ''][c_nationkey % 4 + 1] END label FROM customer),
buckets AS (SELECT CASE WHEN label IS NULL THEN '' ELSE regexp_replace(regexp_replace(lower(label), '^the ', ''), ' ltd\\.$|, inc$', '') END org_key, coalesce(arg_min(label, c_custkey) FILTER (label IS NOT NULL), 'unknown') display, count(*) n_docs FROM cust GROUP BY 1)""".replace("\\\\", "\\")


@query(f"WITH {_CUST_SQL} SELECT * FROM buckets")
def org_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return organisations.organisation_buckets(_customers(spark, sf), F.col("doc_id"))


@query(f"WITH {_CUST_SQL} SELECT a.org_key first_key, b.org_key second_key FROM buckets a JOIN buckets b ON a.org_key < b.org_key AND (b.org_key LIKE a.org_key || ' %') WHERE a.org_key <> '' ORDER BY 1, 2 LIMIT 1")
def org_fragments(spark: SparkSession, sf: str) -> DataFrame:
    return organisations.organisation_fragments(organisations.organisation_buckets(_customers(spark, sf), F.col("doc_id")), F.col("org_key"))


@query("SELECT count(*) FILTER (c_nationkey IN (3, 7)) n_failed, count(*) n_docs, round_even(count(*) FILTER (c_nationkey IN (3, 7)) * 100.0 / count(*), 0)::INT pct, count(*) FILTER (c_nationkey IN (3, 7)) / count(*)::DOUBLE > 0.2 notice FROM customer")
def org_failures(spark: SparkSession, sf: str) -> DataFrame:
    return organisations.identification_failures(_customers(spark, sf))


@query(f"""WITH {_CUST_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY org_key) r FROM buckets WHERE org_key <> ''), u AS (SELECT coalesce(sum(n_docs), 0)::BIGINT u FROM buckets WHERE org_key = '')
SELECT count(*) n_known, '⚠ Corpus spans ' || count(*) || ' organizations: ' || string_agg(display || ' (' || n_docs || (CASE WHEN r = 1 THEN ' docs' ELSE '' END) || ')', ', ' ORDER BY r) || '.' || any_value(CASE WHEN u > 0 THEN ' Plus ' || u || (CASE WHEN u = 1 THEN ' doc' ELSE ' docs' END) || ' with no identified organization.' ELSE '' END) || ' Cross-org definition pairs are suppressed (--org-scope); pass --no-org-scope to compare across orgs.' message FROM k, u""")
def org_warning(spark: SparkSession, sf: str) -> DataFrame:
    return organisations.corpus_warning(organisations.organisation_buckets(_customers(spark, sf), F.col("doc_id")), True)


# Quantities


@query(f'WITH {_SENT_SQL} SELECT o_orderkey, metric, "value", unit, polarity, scope FROM sent')
def quantity_tuples(spark: SparkSession, sf: str) -> DataFrame:
    return _sentences(spark, sf).select("o_orderkey", F.explode_outer(quantities.extract_quantities("sentence")).alias("q")).filter("q is not null").select("o_orderkey", "q.*")


def _sentence_quantities(spark: SparkSession, sf: str) -> DataFrame:
    return _sentences(spark, sf).select("o_custkey", "o_orderkey", quantities.extract_quantities("sentence").alias("q"))


@query(f"""WITH {_SENT_SQL} SELECT o_orderkey a_key, b_key, 'numeric_short_circuit' verdict, 'Numeric short-circuit: metric=' || metric || ', A=' || "value"::BIGINT || '.0million_usd, B=' || b_value::BIGINT || '.0million_usd, polarity mismatch.' rationale FROM pairs WHERE {_FLIP}""")
def sign_flips(spark: SparkSession, sf: str) -> DataFrame:
    x = numeric.flipping(_sentence_quantities(spark, sf), "o_custkey", "o_orderkey", "q").withColumn("v", quantities.short_circuit("d"))
    return x.select("a_key", "b_key", "v.verdict", "v.rationale")


@query(f"""WITH {_SENT_SQL} SELECT o_orderkey a_key, b_key, round(abs("value" - b_value) / greatest("value", b_value), 6) difference, 'metric=' || metric || ': A=' || "value"::BIGINT || '.0, B=' || b_value::BIGINT || '.0 million_usd (' || scope || ')' context FROM pairs WHERE metric = b_metric AND scope = b_scope AND NOT ({_FLIP}) AND greatest("value", b_value) > 0 AND abs("value" - b_value) / greatest("value", b_value) >= 0.1""")
def value_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    x = numeric.disagreeing(_sentence_quantities(spark, sf), "o_custkey", "o_orderkey", "q")
    return x.select("a_key", "b_key", F.round(quantities.relative_difference(F.col("d")[0]["a"], F.col("d")[0]["b"]), 6).alias("difference"), quantities.numeric_context("d").alias("context"))


# Model scores


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN c >= e AND c >= n THEN 'contradiction' WHEN e >= n THEN 'entailment' ELSE 'neutral' END label, c p FROM (SELECT *, greatest(l_discount, l_tax) c, CASE WHEN l_discount >= l_tax THEN l_tax ELSE l_discount END e, 0.05::DOUBLE n FROM lineitem) WHERE c >= 0.05")
def nli_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = lambda c, e: F.struct(F.col(c).alias("p_contradiction"), F.col(e).alias("p_entailment"), F.lit(0.05).alias("p_neutral"))
    x = table(spark, sf, "lineitem").withColumn("s", evaluation.stronger_direction(d("l_discount", "l_tax"), d("l_tax", "l_discount"))).filter("s.p_contradiction >= 0.05")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", evaluation.best_label(F.col("s.p_contradiction"), F.col("s.p_entailment"), F.col("s.p_neutral")).alias("label"), F.col("s.p_contradiction").alias("p"))


# Audit


@query(f"WITH {_FINDINGS_SQL}, {_REVIEWS_SQL} SELECT detector_type, count(*) FILTER (reviewer_verdict = 'confirmed') n_confirmed, count(*) FILTER (reviewer_verdict = 'false_positive') n_false_positive, count(*) FILTER (reviewer_verdict = 'dismissed') n_dismissed, round(count(*) FILTER (reviewer_verdict = 'confirmed') / nullif(count(*) FILTER (reviewer_verdict IN ('confirmed', 'false_positive')), 0)::DOUBLE, 6) AS \"precision\" FROM reviewed GROUP BY 1")
def detector_precision(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.detector_precision(_reviewed(spark, sf))


@query(f"WITH {_FINDINGS_SQL}, {_REVIEWS_SQL} SELECT count(*) n_all, count(*) FILTER (reviewer_verdict IS NULL) n_open, count(*) FILTER (reviewer_verdict = 'confirmed') n_confirmed, count(*) FILTER (reviewer_verdict = 'false_positive') n_false_positive, count(*) FILTER (reviewer_verdict = 'dismissed') n_dismissed FROM reviewed")
def chip_counts(spark: SparkSession, sf: str) -> DataFrame:
    return audit.chip_counts(_reviewed(spark, sf))


@query(f"WITH {_FINDINGS_SQL}, {_REVIEWS_SQL} SELECT judge_verdict, count(*) n, count(*) FILTER (reviewer_verdict IS NULL) n_open FROM reviewed WHERE reviewer_verdict IS DISTINCT FROM 'false_positive' AND NOT suppressed GROUP BY 1")
def report_findings(spark: SparkSession, sf: str) -> DataFrame:
    return audit.filtered_findings(audit.not_false_positive(_reviewed(spark, sf)), suppressed=False).groupBy("judge_verdict").agg(F.count("*").alias("n"), F.count_if(F.col("reviewer_verdict").isNull()).alias("n_open"))


@query(f"WITH {_FINDINGS_SQL}, {_REVIEWS_SQL} SELECT verdict, count(*) n FROM reviews GROUP BY 1")
def verdict_counts(spark: SparkSession, sf: str) -> DataFrame:
    return audit.verdict_counts(audit.current_reviews(_reviews(spark, sf)))


@query(f"WITH {_FINDINGS_SQL}, {_REVIEWS_SQL} SELECT pair_key, detector_type, verdict FROM reviews")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    return audit.current_reviews(_reviews(spark, sf)).select("pair_key", "detector_type", "verdict")


@query(f"WITH {_FINDINGS_SQL}, {_REVIEWS_SQL} SELECT finding_id, a_text, b_text, doc_a_label, doc_b_label, reviewer_verdict FROM (SELECT r.finding_id, p_name a_text, s_name b_text, 'Brand ' || p_brand doc_a_label, CASE WHEN n_nationkey IS NULL THEN 'n' || s_nationkey ELSE n_name END doc_b_label, reviewer_verdict FROM reviewed r JOIN part ON 'p' || p_partkey = a JOIN supplier ON 's' || s_suppkey = b LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = s_nationkey)")
def findings_hydrated(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("assertion_id"), F.col("p_name").alias("assertion_text"), F.concat(F.lit("b"), "p_brand").alias("doc_id"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("assertion_id"), F.col("s_name").alias("assertion_text"), F.concat(F.lit("n"), "s_nationkey").alias("doc_id"))
    n = table(spark, sf, "nation").filter("n_nationkey < 20").select(F.concat(F.lit("n"), "n_nationkey").alias("doc_id"), F.col("n_name").alias("title"), F.lit("").alias("source_path"))
    b = table(spark, sf, "part").select("p_brand").distinct().select(F.concat(F.lit("b"), "p_brand").alias("doc_id"), F.lit("").alias("title"), F.concat(F.lit("Brand "), "p_brand").alias("source_path"))
    out = audit.hydrated(_findings(spark, sf), p.unionByName(s), n.unionByName(b), audit.current_reviews(_reviews(spark, sf)))
    return out.select("finding_id", "a_text", "b_text", "doc_a_label", "doc_b_label", "reviewer_verdict")


@query(f"WITH {_FINDINGS_SQL} SELECT detector_type, count(*) n FROM (SELECT detector_type FROM findings UNION ALL SELECT 'multi_party' FROM orders) GROUP BY 1")
def detector_totals(spark: SparkSession, sf: str) -> DataFrame:
    return audit.detector_totals(_findings(spark, sf), table(spark, sf, "orders"))


@query("SELECT l_orderkey finding_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY x) - 1)::INT AS \"position\", x assertion_id FROM (SELECT l_orderkey, unnest(list_distinct(list(l_partkey))) x FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 3 AND count(DISTINCT l_suppkey) >= 2)")
def multi_party_members(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("finding_id")).agg(F.collect_set("l_partkey").alias("assertion_ids"), F.collect_set("l_suppkey").alias("doc_ids")).filter("size(assertion_ids) >= 3 and size(doc_ids) >= 2")
    return audit.member_rows(m)


@query(f"WITH {_FINDINGS_SQL} SELECT count(*) FILTER (gate_score > 0.02) n_gated, count(*) FILTER (gate_score > 0.02 AND NOT suppressed) n_judged, count(*) FILTER (gate_score > 0.02 AND NOT suppressed AND judge_verdict = 'contradiction') n_findings, count(*) FILTER (gate_score <= 0.02) n_dropped FROM findings")
def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    return audit.run_counters(_findings(spark, sf).select((F.col("gate_score") > 0.02).alias("in_corpus"), F.when(~F.col("suppressed"), F.col("judge_verdict")).alias("verdict")))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "view", "pending").otherwise("running")
    return e.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("corpus_id"), F.col("ts").alias("started_at"), F.when(F.col("event_type") == "signup", "ingest").otherwise("check").alias("run_kind"), status.alias("run_status"))


@query("SELECT corpus_id, run_id, run_kind FROM (SELECT user_id corpus_id, event_id run_id, CASE WHEN event_type = 'signup' THEN 'ingest' ELSE 'check' END run_kind, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r = 1")
def latest_run_per_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return audit.latest_runs(_runs(spark, sf)).select("corpus_id", "run_id", "run_kind")


@query("SELECT user_id run_id, coalesce(arg_min(s, event_id) FILTER (s IN ('done', 'failed')), arg_max(s, event_id)) status, min(event_id) FILTER (s IN ('done', 'failed')) finished FROM (SELECT *, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'pending' ELSE 'running' END s FROM events) GROUP BY 1")
def run_terminal_state(spark: SparkSession, sf: str) -> DataFrame:
    e = _runs(spark, sf).select(F.col("corpus_id").alias("run_id"), F.col("run_status").alias("status"), F.col("run_id").alias("at"), F.col("run_id").alias("seq"))
    return audit.run_states(e).select("run_id", "status", F.col("finished_at").alias("finished"))


@query("SELECT r_regionkey corpus_id, r_name corpus_name, (SELECT count(*) FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) n_assertions, (SELECT count(*) FROM events WHERE user_id = r_regionkey) n_runs, coalesce((SELECT bool_or(event_type NOT IN ('error', 'purchase')) FROM events WHERE user_id = r_regionkey), false) active FROM region")
def sidebar_rows(spark: SparkSession, sf: str) -> DataFrame:
    corpora = table(spark, sf, "region").select(F.col("r_regionkey").alias("corpus_id"), F.col("r_name").alias("corpus_name"))
    docs = table(spark, sf, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_regionkey").alias("corpus_id"))
    return audit.sidebar(corpora, docs, table(spark, sf, "supplier").select(F.col("s_nationkey").alias("doc_id")), _runs(spark, sf))


@query(f"WITH {_edges_sql(STRONG)}, {_DEFS_SQL} SELECT n + m n_calls, round((n + m) * 0.0001::DOUBLE, 6) cost_low, round((n + m) * 0.001::DOUBLE, 6) cost_high FROM (SELECT count(*) n FROM edges), (SELECT count(*) m FROM pairs)")
def cost_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return audit.cost_estimate(_edges(spark, sf).agg(F.count("*").alias("n")), definitions.definition_pair_counts(_defs(spark, sf)).select(F.col("n_pairs").alias("n")))


# Store


@query("SELECT (SELECT count(*) FROM documents) n_documents, count(*) n_assertions, count(o_totalprice) FILTER (o_orderstatus <> 'P') n_embedded FROM orders")
def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("embedded_at"))
    return store.store_stats(table(spark, sf, "documents"), a)


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 25")
def paged_listing(spark: SparkSession, sf: str) -> DataFrame:
    return store.page(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), [F.desc("n_chars"), "doc_id"], 2)


@query("SELECT l_partkey k, l_orderkey v FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) r FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)) WHERE r = 1 UNION ALL SELECT p_partkey, -1 FROM part WHERE p_size < 25")
def insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    there = table(spark, sf, "part").filter("p_size < 25").select(F.col("p_partkey").alias("k"), F.lit(-1).cast("long").alias("v"))
    return store.insert_or_ignore(there, table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_orderkey").alias("v"), "l_linenumber"), "k", ["v", "l_linenumber"])


@query("SELECT doc_id, CASE WHEN source = 'src1' OR (lang ILIKE 'E%' AND source LIKE 'src2%') THEN 'moved' ELSE lang END corpus_id FROM documents")
def corpus_reassign(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("corpus_id"), F.col("source").alias("source_path"))
    return store.reassign(d, "source_path = 'src1' OR corpus_id LIKE 'E%' AND source_path LIKE 'src2%'", "moved").select("doc_id", "corpus_id")


@query("SELECT 'corpora' t, count(*) n FROM region WHERE r_name <> 'ASIA' UNION ALL SELECT 'documents', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA') UNION ALL SELECT 'assertions', count(*) FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA') UNION ALL SELECT 'runs', count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA') UNION ALL SELECT 'findings', count(*) FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')")
def corpus_delete(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region").select(F.col("r_name").alias("corpus_id"), "r_regionkey")
    n = table(spark, sf, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("doc_id"), "corpus_id")
    tables = {
        "corpora": r,
        "documents": n,
        "assertions": table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("doc_id")),
        "runs": table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_nationkey").alias("doc_id")).join(n, "doc_id"),
        "findings": table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("run_id")),
    }
    out = None
    for name, df in store.delete_corpus(tables, "ASIA").items():
        one = df.agg(F.lit(name).alias("t"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT c_custkey doc_id, coalesce(CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END, n_name) org_label FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON n_nationkey = c_nationkey")
def org_update(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), "c_nationkey", F.when(F.col("c_custkey") % 11 == 0, None).otherwise(F.col("c_mktsegment")).alias("org_label"))
    named = c.join(table(spark, sf, "nation").filter("n_nationkey % 2 = 0"), F.col("c_nationkey") == F.col("n_nationkey")).select("doc_id", F.col("n_name").alias("new_label"))
    return store.update_organisations(c.drop("c_nationkey"), named, only_missing=True)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def bulk_lookup(spark: SparkSession, sf: str) -> DataFrame:
    ids_ = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return store.by_ids(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ids_, "o_custkey")


@query("SELECT doc_id || ',' || lang || ',' || n_chars AS line FROM documents")
def export_rows(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("assertion_id"), F.lit(0).alias("created_at"), "lang", "n_chars")
    return sinks.assertion_export(a, ("doc_id", "lang", "n_chars")).select(F.concat_ws(",", "doc_id", "lang", "n_chars").alias("line"))


@query("""SELECT '{"assertion_id":' || s_suppkey || ',"doc_id":' || s_nationkey || ',"created_at":' || coalesce(CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey::VARCHAR END, 'null') || ',"source_path":"' || n_name || '","doc_date":null}' AS "value" FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def export_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("assertion_id"), F.col("s_nationkey").alias("doc_id"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey")).alias("created_at"))
    return sinks.assertion_lines(a, table(spark, sf, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("source_path"), F.lit(None).cast("string").alias("doc_date")))


# Evaluation


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    gold = F.when(F.col("quality") == 0, "contradiction").otherwise("not_contradiction")
    predicted = F.when(F.col("toxic") == 1, "contradiction").when(F.col("n_chars") < 300, "uncertain").otherwise("not_contradiction")
    return x.select("doc_id", F.col("lang").alias("bucket"), gold.alias("gold"), predicted.alias("predicted"))


_LABELLED_SQL = "x AS (SELECT doc_id, lang bucket, CASE WHEN quality = 0 THEN 'contradiction' ELSE 'not_contradiction' END gold, CASE WHEN toxic = 1 THEN 'contradiction' WHEN n_chars < 300 THEN 'uncertain' ELSE 'not_contradiction' END predicted FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (gold = 'contradiction' AND predicted = 'contradiction') tp, count(*) FILTER (gold <> 'contradiction' AND predicted = 'contradiction') fp, count(*) FILTER (gold = 'contradiction' AND predicted <> 'contradiction') fn, count(*) FILTER (gold <> 'contradiction' AND predicted <> 'contradiction') tn FROM x)"


@query(f"WITH {_LABELLED_SQL} SELECT tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6) AS \"precision\", round(tp / (tp + fn)::DOUBLE, 6) recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) f1 FROM c")
def confusion_prf(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.scores(evaluation.confusion(_labelled(spark, sf), "contradiction"), undefined=0.0)


@query(f"WITH {_LABELLED_SQL} SELECT bucket, count(*) n, round(count(*) FILTER (gold = predicted) / count(*)::DOUBLE, 6) accuracy, round(count(*) FILTER (gold <> 'contradiction' AND predicted = 'contradiction') / nullif(count(*) FILTER (gold <> 'contradiction'), 0)::DOUBLE, 6) fp_rate, round(count(*) FILTER (gold = 'contradiction' AND predicted = 'not_contradiction') / nullif(count(*) FILTER (gold = 'contradiction'), 0)::DOUBLE, 6) fn_rate, round(count(*) FILTER (predicted = 'uncertain') / count(*)::DOUBLE, 6) abstain_rate FROM x GROUP BY GROUPING SETS ((bucket), ())")
def bucket_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.bucket_metrics(_labelled(spark, sf))


@query(f"WITH {_LABELLED_SQL} SELECT bucket category, count(*) n, round(avg((gold = predicted)::INT), 6) accuracy FROM x GROUP BY 1")
def category_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.category_accuracy(_labelled(spark, sf).withColumnRenamed("bucket", "category"))


def _run_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations' texts as findings of three runs."""
    c = table(spark, sf, "conversations")
    return c.select(ids.unordered_finding_id(F.col("role"), F.col("text"), F.lit("b"), F.col("role")).alias("finding_id"), (F.col("conv_id") % 3).alias("run_id"), "conv_id", "turn")


_CONV_SQL = "f AS (SELECT substr(sha256(CASE WHEN (role, text) <= ('b', role) THEN role || '|' || text || '|b|' || role ELSE 'b|' || role || '|' || role || '|' || text END), 1, 16) finding_id, conv_id % 3 run_id, conv_id, turn FROM conversations)"


@query(f"WITH {_CONV_SQL} SELECT finding_id, run_id, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY conv_id, turn) r FROM f) WHERE r = 1")
def runs_union(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.run_union(_run_findings(spark, sf), F.struct("conv_id", "turn"))


@query(f"WITH {_CONV_SQL} SELECT finding_id FROM f GROUP BY 1 HAVING count(DISTINCT run_id) = (SELECT count(DISTINCT run_id) FROM f)")
def runs_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.run_intersection(_run_findings(spark, sf))


@query(f"WITH {_CONV_SQL}, g AS (SELECT finding_id, count(DISTINCT run_id) runs, count(*) n, CASE min(conv_id) % 4 WHEN 0 THEN 'real' WHEN 1 THEN 'false_positive' WHEN 2 THEN 'dismissed' END label FROM f GROUP BY 1) SELECT coalesce(sum(n), 0)::BIGINT n_total, count(*) n_union, count(*) FILTER (runs = (SELECT count(DISTINCT run_id) FROM f)) n_intersection, count(*) FILTER (label = 'real') n_real, count(*) FILTER (label = 'false_positive') n_false_positive, count(*) FILTER (label = 'dismissed') n_dismissed, round(count(*) FILTER (runs = (SELECT count(DISTINCT run_id) FROM f)) / count(*)::DOUBLE, 6) agreement, round(count(*) FILTER (label = 'real') / nullif(count(*) FILTER (label IN ('real', 'false_positive')), 0)::DOUBLE, 6) AS \"precision\" FROM g")
def runs_comparison(spark: SparkSession, sf: str) -> DataFrame:
    f = _run_findings(spark, sf)
    kind = F.element_at(F.array(F.lit("real"), F.lit("false_positive"), F.lit("dismissed"), F.lit(None).cast("string")), (F.min("conv_id") % 4 + 1).cast("int"))
    return evaluation.comparison(f, f.groupBy("finding_id").agg(kind.alias("label")))
