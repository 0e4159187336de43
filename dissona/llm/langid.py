"""Language identification: multilingual mixture inference.

A language is a distribution over hashed character n-grams, counted over all documents to learn from. A document's n-grams come
from a mixture of languages, whose proportions expectation-maximisation estimates (all documents of a batch at once, as matrix
products). The set of languages is chosen by penalised likelihood: sets of the best one, two, three ... up to all languages are fitted,
and each language beyond the first must earn half the logarithm of the number of n-grams. A size is left out only where an upper
bound on the likelihood of any mixture shows that it can't win. The prediction is the language with the
largest share; the score is that share or, for a set of one, its posterior among single languages.

Defined cases: a null text or one without a letter is `und` with score 0, as is every text when nothing can be learnt; rows with
a null language or a null doc_id aren't learnt from; a null doc_id stays null and isn't held out; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored; texts are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissona.runtime import rows_bound, ship

from .common import map_batches, map_rows, replaced

BUCKETS = 4096
MOST_LANGUAGES = 1000
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def ngram_counts(texts: list[str], buckets: int = BUCKETS, rows: int = 64) -> Iterator[np.ndarray]:
    """Counts of hashed trigrams, a row for each text, for `rows` texts at a time."""
    shift = np.uint32(32 - (buckets - 1).bit_length())
    for at in range(0, len(texts), rows):
        part = [f" {t.lower()} " for t in texts[at : at + rows]]
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        c = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        h = (c[:-2] * _A + c[1:-1] * _B + c[2:] * _C) >> shift
        ends = np.cumsum(lengths)
        row = np.repeat(np.arange(len(part)), lengths)[: len(h)]
        inside = np.arange(len(h)) + 2 < ends[row]
        yield np.bincount((row * buckets + h)[inside], minlength=len(part) * buckets).reshape(len(part), buckets)


@dataclass
class Languages:
    names: list[str]
    p: np.ndarray  # language x bucket


def learn(docs: DataFrame, *, text_column: str = "text", lang_column: str = "lang", buckets: int = BUCKETS, smoothing: float = 0.5) -> Languages:
    """From every row with a text and a language. What comes to the driver is languages x buckets counts.

    A column of more than MOST_LANGUAGES different values isn't one of languages: a ValueError, before anything is collected.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for at, counts in enumerate(ngram_counts(texts, buckets)):
                own = langs[at * 64 : at * 64 + len(counts)]
                for lang in set(own.tolist()):
                    total[lang] = total.get(lang, 0) + counts[own == lang].sum(0)
        for lang, v in total.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(v[at], pa.int64())], ["lang", "bucket", "n"])

    rows = docs.select(F.col(f"`{lang_column}`").cast("string").alias("lang"), F.col(f"`{text_column}`").cast("string").alias("text")).filter("lang is not null and text is not null")
    if not rows_bound(rows.select("lang").distinct(), MOST_LANGUAGES):
        raise ValueError(f"{lang_column} has more than {MOST_LANGUAGES} different values")
    got = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    names = sorted({r["lang"] for r in got})
    p = np.full((len(names), buckets), smoothing)
    at = {n: i for i, n in enumerate(names)}
    for r in got:
        p[at[r["lang"]], r["bucket"]] += r["n"]
    return Languages(names, p / p.sum(1, keepdims=True))


def mixtures(c: np.ndarray, p: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares (row x language, only of allowed ones) and log-likelihoods by expectation-maximisation."""
    n = np.maximum(c.sum(1, keepdims=True), 1)
    pi = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        pi = pi * ((c / (pi @ p)) @ p.T) / n
        pi = np.maximum(pi, 1e-12) * allowed
        pi /= pi.sum(1, keepdims=True)
    return pi, (c * np.log(pi @ p)).sum(1)


def predict_counts(c: np.ndarray, model: Languages, most: int | None = None, rounds: int = 10, overlap: float = 3.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number, score, and the shares of the chosen set, for each row of counts. Trigrams overlap, so a likelihood counts a third."""
    c, p = c.astype(np.float32), model.p.astype(np.float32)
    k = len(p)
    single = (c @ np.log(p).T) / overlap
    best = single.argmax(1)
    posterior = np.exp(single - single.max(1, keepdims=True))
    shares = np.eye(k, dtype=np.float64)[best]
    score = 1 / posterior.sum(1)
    value = single.max(1).astype(np.float64)
    pi, ll = mixtures(c, p, np.ones((len(c), k), np.float32), rounds)
    n = np.maximum(c.sum(1), 1).astype(np.float64)
    limit = (ll + n * np.log(((c / (pi @ p)) @ p.T / n[:, None]).max(1)) + 1) / overlap  # no mixture is likelier (Jensen); 1 for rounding
    order = np.argsort(-pi, axis=1, kind="stable")
    penalty = 0.5 * np.log(np.maximum(c.sum(1), 2.0))
    for size in range(2, min(most or k, k) + 1):
        at = np.flatnonzero(limit - (size - 1) * penalty > value)
        if not len(at):
            break
        allowed = np.zeros((len(at), k), pi.dtype)
        np.put_along_axis(allowed, order[at, :size], 1, 1)
        q, ll = mixtures(c[at], p, allowed, rounds)
        v = ll / overlap - (size - 1) * penalty[at]
        better = v > value[at] + 1e-6
        at, q = at[better], q[better]
        value[at], shares[at], score[at] = v[better], q, q.max(1)
    return shares.argmax(1), np.clip(score, 0, 1), shares


def predict_texts(texts: list[str | None], model: Languages, most: int | None = None) -> tuple[list[str], list[float], list[list[dict]]]:
    """Of each text the language, the score and the chosen set by share."""
    there = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))] if model.names else []
    names, scores, sets = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    done = 0
    for counts in ngram_counts([texts[i] for i in there], model.p.shape[1]):
        best, score, shares = predict_counts(counts, model, most)
        for j in range(len(counts)):
            i = there[done + j]
            names[i], scores[i] = model.names[best[j]], round(float(score[j]), 6)
            sets[i] = [{"lang": model.names[k], "share": round(float(shares[j, k]), 6)} for k in np.argsort(-shares[j], kind="stable") if shares[j, k] > 0]
        done += len(counts)
    return names, scores, sets


def predict_languages(docs: DataFrame, model: Languages, *, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text", most: int | None = None) -> DataFrame:
    """The columns `keep`, lang_pred, score, and languages ARRAY<STRUCT<lang, share>> of the chosen set, by share. No shuffle."""
    kept = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_column}`").cast("string").alias("__text"))
    types = kept.schema
    from pyspark.sql.pandas.types import to_arrow_type

    def run(columns: list[list]) -> list[list]:
        return [*columns[:-1], *predict_texts(columns[-1], model, most)]

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in types.fields[:-1]) + "lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    fields = [to_arrow_type(f.dataType) for f in types.fields[:-1]] + [pa.string(), pa.float64(), pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))]
    return map_rows(kept, run, schema.replace("`", "") if all(c.isidentifier() for c in keep) else schema, fields, 256)


def keep_languages(docs: DataFrame, model: Languages, *, text_column: str = "text", lang_column: str = "lang", least_score: float = 0.4) -> DataFrame:
    """The rows of docs, all their columns, whose text has a learned language with this score at least; lang_column is set to it. No shuffle."""
    at, lang = docs.columns.index(text_column), docs.columns.index(lang_column)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores, _ = predict_texts(batch.column(at).to_pylist(), model)
        good = pa.array([n != "und" and s >= least_score for n, s in zip(names, scores, strict=True)], pa.bool_())
        return replaced(batch, lang, pa.array(names, pa.string())).filter(good)

    return map_batches(docs, run, 256)
