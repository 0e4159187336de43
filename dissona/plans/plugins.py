"""Models as plug-ins: what they take and give, deterministic ones that need no network, and the columns they make."""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol, TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissona.functions import responses
from dissona.operators.chunking import sentence_spans
from dissona.runtime import ship

X, Y = TypeVar("X"), TypeVar("Y")

NLI_TYPE = "struct<p_contradiction:double,p_entailment:double,p_neutral:double>"
VERDICT_TYPE = "struct<verdict:string,rationale:string,evidence_spans:array<string>>"
MULTI_TYPE = "struct<verdict:string,rationale:string,evidence_spans:array<string>,contradicting_subset:array<string>>"
EXTRACTION_TYPE = "struct<claims:array<string>,definitions:array<struct<term:string,definition_text:string,containing_sentence:string>>>"
TRIES = 3
#: Waits at most for a vendor that is busy or out of reach, the first and the longest in seconds; texts that a checker scores at a time.
WAITS, FIRST_WAIT, LONGEST_WAIT, NLI_BATCH = 6, 0.5, 60.0, 32
# Fixed value: what a pair of texts takes of a checker's tokens besides their own.
PAIR_TOKENS = 3
# Fixed value: characters of a document that its organisation is sought in.
ORG_CHARS = 2000


class Embedder(Protocol):
    width: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Extractor(Protocol):
    """extract: a chunk's claims, and its definitions as dicts of term, definition_text, containing_sentence. identify: label and reason for a title and the beginning of a text."""

    def extract(self, text: str) -> tuple[list[str], list[dict[str, str]]]: ...

    def identify(self, title: str | None, beginning: str) -> tuple[str | None, str]: ...


class NliChecker(Protocol):
    """release, if there is one, is called when a partition is done.

    A checker that has max_tokens also has count_tokens, of a list of texts; premises that don't fit are then split, see `split_scores`.
    """

    def score(self, pairs: list[tuple[str, str]]) -> list[tuple[float, float, float]]: ...


class Judge(Protocol):
    def judge(self, a: str, b: str, context: str | None) -> tuple[str, str, list[str]]: ...


class MultiPartyJudge(Protocol):
    """A fourth part of the answer, if given, are the letters (A, B, C) of the texts that contradict each other."""

    def judge(self, texts: list[str]) -> tuple: ...


class Provider(Protocol):
    """A vendor's client: an answer (JSON text of a payload) to a prompt. Clients themselves live outside."""

    def request_payload(self, system: str, user: str) -> str: ...


class Gate(Protocol):
    """Candidate pairs (a_id, b_id, score) of assertions (id, doc_id, embedding)."""

    def pairs(self, assertions: DataFrame) -> DataFrame: ...


class HashEmbedder:
    """A unit vector from a text's SHA-256, the same everywhere."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> np.ndarray:
        rows = []
        for t in texts:
            raw = b"".join(hashlib.sha256(f"{i}:{t}".encode()).digest() for i in range(-(-self.width * 4 // 32)))
            v = np.frombuffer(raw, "<u4")[: self.width] / 2**31 - 1
            rows.append(v / (np.linalg.norm(v) or 1))
        return np.array(rows, np.float32).reshape(-1, self.width)


class FixtureNli:
    """Probabilities from a table of (premise, hypothesis); others get the default."""

    def __init__(self, table: dict[tuple[str, str], tuple[float, float, float]], default: tuple[float, float, float] = (0.0, 0.0, 1.0)):
        self.table, self.default = table, default

    def score(self, pairs: list[tuple[str, str]]) -> list[tuple[float, float, float]]:
        return [self.table.get(p, self.default) for p in pairs]


class FunctionNli:
    """Probabilities by a function of premise and hypothesis. Reads no more than max_tokens words of both, if given."""

    def __init__(self, function: Callable[[str, str], tuple[float, float, float]], max_tokens: int | None = None):
        self.function, self.max_tokens = function, max_tokens

    def count_tokens(self, texts: list[str]) -> list[int]:
        return [len(t.split()) for t in texts]

    def score(self, pairs: list[tuple[str, str]]) -> list[tuple[float, float, float]]:
        seen = lambda p, h: p if self.max_tokens is None else " ".join(p.split()[: max(0, self.max_tokens - PAIR_TOKENS - len(h.split()))])
        return [self.function(seen(p, h), h) for p, h in pairs]


class FixtureJudge:
    """Verdicts from a table of (a, b); others get the default."""

    def __init__(self, table: dict[tuple[str, str], tuple[str, str, list[str]]], default: tuple[str, str, list[str]] = ("not_contradiction", "", [])):
        self.table, self.default = table, default

    def judge(self, a: str, b: str, context: str | None) -> tuple[str, str, list[str]]:
        return self.table.get((a, b), self.table.get((b, a), self.default))


class FixtureMultiJudge:
    """One answer for all."""

    def __init__(self, answer: tuple):
        self.answer = answer

    def judge(self, texts: list[str]) -> tuple:
        return self.answer


class FixtureExtractor:
    """Answers from tables by text and title; others have no definitions, are one claim, and belong to no organisation."""

    def __init__(self, table: dict[str, tuple[list[str], list[dict[str, str]]]] | None = None, labels: dict[str | None, tuple[str | None, str]] | None = None):
        self.table, self.labels = table or {}, labels or {}

    def extract(self, text: str) -> tuple[list[str], list[dict[str, str]]]:
        return self.table.get(text, ([text.strip()], []))

    def identify(self, title: str | None, beginning: str) -> tuple[str | None, str]:
        return self.labels.get(title, (None, "no_org"))


class Busy(Exception):
    """What a vendor's client raises when it is to wait; `seconds` where the vendor says how long."""

    def __init__(self, message: str = "", seconds: float | None = None):
        super().__init__(message)
        self.seconds = seconds


def patient(call: Callable[[], Y]) -> Y:
    """The call's result. A vendor that is busy or out of reach is called again, WAITS times, after ever longer waits of random parts; then its error goes through."""
    for n in range(WAITS):
        try:
            return call()
        except (Busy, ConnectionError, TimeoutError) as e:
            longest = min(LONGEST_WAIT, FIRST_WAIT * 2**n)
            time.sleep(max(getattr(e, "seconds", None) or 0, random.uniform(longest / 2, longest)))
    return call()


def in_order(model: object, function: Callable[[X], Y], items: list[X]) -> list[Y]:
    """function of each item, in order; as many at a time as the model's `concurrency` says, one without. The first error ends it."""
    n = min(getattr(model, "concurrency", 1), len(items))
    if n < 2:
        return [function(x) for x in items]
    pool = ThreadPoolExecutor(n)
    try:
        return list(pool.map(function, items))
    finally:
        pool.shutdown(cancel_futures=True)


class ProviderModel:
    """A model by a vendor's client, asked `concurrency` times at once by each task. An answer that is no payload is a ValueError, so it is asked for again."""

    def __init__(self, provider: Provider, system: str, template: str, concurrency: int = 8):
        self.provider, self.system, self.template, self.concurrency = provider, system, template, concurrency

    def answer(self, **parts: str | None) -> dict:
        user = self.template
        for name, text in parts.items():
            user = user.replace("{" + name + "}", text or "")
        x = json.loads(patient(lambda: self.provider.request_payload(self.system, user)))
        if not isinstance(x, dict):
            raise ValueError("not a payload")
        return x


class ProviderJudge(ProviderModel):
    """A judge of pairs, or of definitions with responses.DEFINITION_VERDICTS: the template has {a}, {b} and {context}."""

    def __init__(self, provider: Provider, system: str, template: str, verdicts: tuple[str, ...] = responses.JUDGE_VERDICTS, concurrency: int = 8):
        super().__init__(provider, system, template, concurrency)
        self.verdicts = verdicts

    def judge(self, a: str, b: str, context: str | None) -> tuple[str, str, list[str]]:
        return checked_answer(self.answer(a=a, b=b, context=context), self.verdicts)


class ProviderMultiJudge(ProviderModel):
    """A judge of three texts: the template has {a}, {b} and {c}. Only a contradiction has a subset."""

    def judge(self, texts: list[str]) -> tuple[str, str, list[str], list[str]]:
        x = self.answer(**dict(zip("abc", texts, strict=True)))
        subset = x.pop("contradicting_subset", [])
        if not _strings(subset) or set(subset) - {"A", "B", "C"} or subset and x.get("verdict") != "multi_party_contradiction":
            raise ValueError("not a payload")
        return (*checked_answer(x, responses.MULTI_VERDICTS), subset)


class ProviderExtractor(ProviderModel):
    """An extractor: the template has {text}; that of organisations {title} and {text}."""

    def __init__(self, provider: Provider, system: str, template: str, organisation_template: str = "{title}\n{text}", concurrency: int = 8):
        super().__init__(provider, system, template, concurrency)
        self.organisation = ProviderModel(provider, system, organisation_template)

    def extract(self, text: str) -> tuple[list[str], list[dict[str, str]]]:
        x = self.answer(text=text)
        claims, definitions = x.get("assertions") or [], x.get("definitions") or []
        names = ("term", "definition_text", "containing_sentence")
        if not _strings(claims) or not isinstance(definitions, list) or not all(isinstance(d, dict) and all(isinstance(d.get(n), str) and d[n] for n in names) for d in definitions):
            raise ValueError("not a payload")
        return claims, [{n: d[n] for n in names} for d in definitions]

    def identify(self, title: str | None, beginning: str) -> tuple[str | None, str]:
        x = self.organisation.answer(title=title, text=beginning)
        if "label" not in x or not (x["label"] is None or isinstance(x["label"], str)) or x.get("reason") not in ("org_found", "no_org"):
            raise ValueError("not a payload")
        return x["label"], x["reason"]


def _strings(x: object) -> bool:
    return isinstance(x, list) and all(isinstance(s, str) for s in x)


def checked_answer(x: str | dict, verdicts: tuple[str, ...]) -> tuple[str, str, list[str]]:
    """functions.responses.verdict_payload for one answer inside a worker; what doesn't fit is a ValueError."""
    x = json.loads(x) if isinstance(x, str) else x
    if not isinstance(x, dict) or set(x) - {"verdict", "rationale", "evidence_spans"}:
        raise ValueError("not a payload")
    verdict, rationale, spans = x.get("verdict"), x.get("rationale"), x.get("evidence_spans", [])
    if verdict not in verdicts or not isinstance(rationale, str) or not rationale or not _strings(spans):
        raise ValueError("not a payload")
    return verdict, rationale, spans


def again(call: Callable[[], Y]) -> Y:
    """The call's result; an invalid answer (ValueError) is asked for again, twice."""
    for _ in range(TRIES - 1):
        try:
            return call()
        except ValueError:
            continue
    return call()


def extracted(chunks: DataFrame, model: Extractor) -> DataFrame:
    """doc_id, chunk_id, claims, definitions of chunks by an extractor: what Workspace.ingest takes as `extract`."""
    ship(chunks.sparkSession)

    @F.pandas_udf(EXTRACTION_TYPE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield pd.DataFrame(in_order(model, lambda x: again(lambda: model.extract(x or "")), list(t)), columns=["claims", "definitions"])

    made = chunks.select("doc_id", "chunk_id", run.asNondeterministic()(F.col("text")).alias("x"))
    return made.select("doc_id", "chunk_id", "x.*")


def identified(documents: DataFrame, model: Extractor) -> DataFrame:
    """doc_id, org_label, org_reason: asked with the title and the first ORG_CHARS characters.

    The reason is `truncated` where nothing was found and the text is longer; an answer that fails is asked for again, then llm_error.
    """
    ship(documents.sparkSession)

    def one(row: tuple[str | None, str]) -> tuple[str | None, str]:
        title, text = row
        try:
            label, reason = again(lambda: model.identify(title, text[:ORG_CHARS]))
        except ValueError:
            return None, "llm_error"
        return label, "truncated" if reason == "no_org" and len(text) > ORG_CHARS else reason

    @F.pandas_udf("struct<org_label:string,org_reason:string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for title, text in batches:
            yield pd.DataFrame(in_order(model, one, [(a, b or "") for a, b in zip(title.where(title.notna(), None), text, strict=True)]), columns=["org_label", "org_reason"])

    made = documents.select("doc_id", run.asNondeterministic()(F.col("title"), F.substring("text", 1, ORG_CHARS + 1)).alias("x"))
    return made.select("doc_id", "x.*")


def embedding(df: DataFrame, text: str, model: Embedder) -> Column:
    """ARRAY<FLOAT> of a text column; one model per worker, texts in batches."""
    ship(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series(list(model.embed(t.fillna("").tolist())), index=t.index)

    return run(F.col(text))


def split_scores(model: NliChecker, pairs: list[tuple[str, str]]) -> list[tuple[float, float, float]]:
    """Scores of pairs (premise, hypothesis), asked for in batches of texts of like length.

    A premise that doesn't fit with its hypothesis into the checker's max_tokens is split into sentences, and the score is that of the
    sentence which contradicts most (the first of several), so that what stands in its tail is seen. One sentence goes as it is.
    """
    most = getattr(model, "max_tokens", None)
    parts, owners, split = [], [], {}
    sizes = model.count_tokens([t for pair in pairs for t in pair]) if most is not None else []
    for i, (p, h) in enumerate(pairs):
        own = [p]
        if most is not None and sizes[2 * i] + sizes[2 * i + 1] + PAIR_TOKENS > most:
            if p not in split:  # premises repeat within a batch
                split[p] = [t for s, e in sentence_spans(p) if (t := p[s:e].strip())]
            own = split[p] if len(split[p]) > 1 else [p]
        parts += [(t, h) for t in own]
        owners += [i] * len(own)
    order = sorted(range(len(parts)), key=lambda j: len(parts[j][0]) + len(parts[j][1]))
    scores: list[tuple[float, float, float] | None] = [None] * len(parts)
    for at in range(0, len(order), NLI_BATCH):
        some = order[at : at + NLI_BATCH]
        for j, score in zip(some, model.score([parts[j] for j in some]), strict=True):
            scores[j] = score
    best: list[tuple[float, float, float] | None] = [None] * len(pairs)
    for i, score in zip(owners, scores, strict=True):
        if best[i] is None or score[0] > best[i][0]:
            best[i] = score
    return best


def nli(df: DataFrame, premise: str, hypothesis: str, model: NliChecker) -> Column:
    """NLI_TYPE of two text columns, by split_scores; a missing text is empty. Not evaluated anew by the optimizer."""
    ship(df.sparkSession)

    @F.pandas_udf(NLI_TYPE)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        try:
            for p, h in batches:
                yield pd.DataFrame(split_scores(model, list(zip(p.fillna(""), h.fillna(""), strict=True))), columns=["p_contradiction", "p_entailment", "p_neutral"])
        finally:
            getattr(model, "release", lambda: None)()

    return run.asNondeterministic()(F.col(premise), F.col(hypothesis))


def nli_both(df: DataFrame, a: str, b: str, model: NliChecker) -> Column:
    """A struct of f (a is the premise) and g (b is), NLI_TYPE each, as `nli` gives them, of one pass over the texts."""
    ship(df.sparkSession)
    names = ["p_contradiction", "p_entailment", "p_neutral"]

    @F.pandas_udf(f"struct<{','.join(f'{d}_{n}:double' for d in 'fg' for n in names)}>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        try:
            for x, y in batches:
                x, y = x.fillna("").tolist(), y.fillna("").tolist()
                scores = split_scores(model, [*zip(x, y, strict=True), *zip(y, x, strict=True)])
                made = np.array(scores, float).reshape(2, len(x), 3)
                yield pd.DataFrame(np.hstack(list(made)), columns=[f"{d}_{n}" for d in "fg" for n in names])
        finally:
            getattr(model, "release", lambda: None)()

    return run.asNondeterministic()(F.col(a), F.col(b))


def asked(model: Judge, x: str, y: str, c: str | None) -> tuple[str, str, list[str]]:
    """An answer; an invalid one is asked for again, and after the last try the verdict is uncertain."""
    try:
        return again(lambda: model.judge(x, y, c))
    except ValueError as e:
        return "uncertain", f"no valid answer: {e}", []


def verdict(df: DataFrame, a: str, b: str, context: str, model: Judge) -> Column:
    """VERDICT_TYPE of two texts. An invalid answer is asked again, twice; then the verdict is uncertain. Other errors go through."""
    ship(df.sparkSession)

    @F.pandas_udf(VERDICT_TYPE)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y, c in batches:
            yield pd.DataFrame(in_order(model, lambda r: asked(model, *r), list(zip(x, y, c.where(c.notna(), None), strict=True))), columns=["verdict", "rationale", "evidence_spans"])

    return run.asNondeterministic()(F.col(a), F.col(b), F.col(context))


def multi_verdict(df: DataFrame, texts: str, model: MultiPartyJudge) -> Column:
    """MULTI_TYPE of an array of texts; asked again as for pairs."""
    ship(df.sparkSession)

    class Paired:
        def judge(self, a: list[str], b: None, context: None) -> tuple:
            answer = model.judge(a)
            if len(answer) > 3 and set(answer[3]) - {"A", "B", "C"}:
                raise ValueError("a subset has the letters A, B and C")
            return answer

    @F.pandas_udf(MULTI_TYPE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in batches:
            answers = in_order(model, lambda x: asked(Paired(), list(x), None, None), list(t))
            yield pd.DataFrame([(*a[:3], list(a[3]) if len(a) > 3 else []) for a in answers], columns=["verdict", "rationale", "evidence_spans", "contradicting_subset"])

    return run.asNondeterministic()(F.col(texts))


KINDS = ("extractor", "embedder", "nli", "judge", "definition_judge", "multi_party_judge", "gate")


def make(kind: str, provider: str, models: dict[tuple[str, str], Callable[[], object]]):
    """A model of a kind by its provider's name; an unknown kind, or one that isn't plugged in, raises."""
    if kind not in KINDS:
        raise ValueError(f"no such kind of model: {kind}")
    if (kind, provider) not in models:
        raise ValueError(f"no {kind} for {provider}")
    return models[kind, provider]()


def make_judge(provider: str, models: dict[str, Callable[[], Judge]]) -> Judge:
    """A judge by its provider's name; one that isn't plugged in raises."""
    return make("judge", provider, {("judge", p): f for p, f in models.items()})
