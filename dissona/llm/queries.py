"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dissona.runtime import table

from . import decon, langid, mlm, negatives, packing, pii, quality, secrets, sharding, simhash, sstable, suffixdedup, whitening


def op1_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op2_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = sstable.new_folder(spark)
    manifest = sstable.write_shards(table(spark, sf_dir, "documents"), folder)
    return sstable.read_shards(spark, folder, manifest, with_ids=False).drop("ids")


def op3_tiled_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mlm.score_documents(table(spark, sf_dir, "documents"))


def op5_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op6_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), with_kept=False).drop("kept")


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    model = langid.learn(docs.filter("doc_id is not null and not held_out"))
    return langid.predict_languages(docs, model, keep=("doc_id", "held_out"))


def op8_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan_pii(table(spark, sf_dir, "documents")))


def op10_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decon.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "item_ids", F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["item_id"], h["start"], h["end"], h["edits"])), ",").alias("spans"))


def op11_voronoi_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("vec_id")
    label = F.when(own % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), own % 50 == 0, label)


def op12_chan_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5's operator finds of the base kinds."""
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents"))).select("doc_id", "n_assign", "n_access", "n_hex")


def personal_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9's operator finds of the base kinds."""
    return pii.digest(pii.scan_pii(table(spark, sf_dir, "documents"))).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's counts and base rule, without a model."""
    found = quality.judge_quality(table(spark, sf_dir, "documents"), None)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def deviations_of_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op12's operator says of vectors before any component: the fit list's length, and each vector's exact deviation."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=1).select("vec_id", "n", "deviation")


def shard_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13's records: each in one of the shards, and its size."""
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "law", F.col("shard").between(0, 7).alias("placed"))


_SPACE = r"\x20\x09-\x0D"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_EITHER = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
_INTEGERS = "v AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)"
ORACLE_SQL: dict[str, str] = {
    "op11_voronoi_negatives": f"""WITH {_INTEGERS}, w AS (SELECT vec_id, x, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END l FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL),
 s AS (SELECT a.vec_id a, b.vec_id b, a.l = b.l same, list_inner_product(a.x, b.x)::BIGINT s FROM w a JOIN w b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
 p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) r FROM s WHERE same) WHERE r <= 5),
 n AS (SELECT p.a anchor_id, p.b positive_id, p.s positive_score, s.b negative_id, s.s negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS "rank" FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
 SELECT anchor_id, positive_id, "rank"::INT AS "rank", negative_id, positive_score, negative_score FROM n WHERE "rank" <= 3""",
    "deviations_of_vectors": f"""WITH {_INTEGERS}, d AS (SELECT DISTINCT x FROM v), u AS (SELECT unnest(x) c, generate_subscripts(x, 1) i FROM d), s AS (SELECT list(t ORDER BY i) s, (SELECT count(*) FROM d) n FROM (SELECT i, sum(c)::BIGINT t FROM u GROUP BY 1))
 SELECT vec_id, n, list_sum(list_transform(x, lambda c, i: (n * c::BIGINT - s[i]) * (n * c::BIGINT - s[i])))::BIGINT deviation FROM v, s""",
    "shard_records": "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 size, 'bytes' law, true placed FROM documents",
    "secret_base_counts": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents) SELECT doc_id,
 len(list_filter(regexp_extract_all(t, '({_EITHER})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) n_assign,
 len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) n_hex FROM d""",
    "personal_base_counts": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents) SELECT doc_id,
 len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) n_email,
 len(list_filter(regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), lambda x: regexp_full_match(x, '{_OCTET}(?:\.{_OCTET}){{3}}'))) n_ip,
 len(list_filter(list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))), lambda x: length(x) BETWEEN 13 AND 19
  AND list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(x, i, 1)::INT WHEN substr(x, i, 1)::INT > 4 THEN 2 * substr(x, i, 1)::INT - 9 ELSE 2 * substr(x, i, 1)::INT END)) % 10 = 0)) n_card,
 len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) n_phone FROM d""",
    "quality_base_counts": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, '[^{_SPACE}]+') words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) rows FROM d),
 windows AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') x FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) i FROM w)), twice AS (SELECT doc_id, x FROM windows GROUP BY 1, 2 HAVING count(*) > 1),
 places AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) p FROM windows JOIN twice USING (doc_id, x)), n AS (SELECT doc_id, count(*) n FROM places GROUP BY 1),
 c AS (SELECT w.doc_id, len(words) n_words, length(regexp_replace(t, '[{_SPACE}]', '', 'g')) word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, len(rows) - len(list_distinct(rows)) n_dup_lines, coalesce(n, 0) n_repeat_words FROM w LEFT JOIN n USING (doc_id))
 SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words base_failed FROM c""",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_hierarchical_packing, op2_sstable_shards, op3_tiled_simhash, op4_masked_likelihood, op5_credential_linking, op6_suffix_runs, op7_language_mixture, op8_boosted_quality, op9_deobfuscated_pii, op10_qgram_decontamination, op11_voronoi_negatives, op12_chan_whitening, op13_sampled_splitters, secret_base_counts, personal_base_counts, quality_base_counts, deviations_of_vectors, shard_records)}
