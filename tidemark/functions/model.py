"""Model calls as column functions, and their untrusted answers as typed rows."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICTS = ("pass", "partial", "fail", "uncertain")


def model_column(make: Callable[[], Callable[[str], str]], prompt: Column) -> Column:
    """A column of answers. `make` builds the provider once in each Python worker; errors answer with ''."""

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = make()

        def answer(text: str) -> str:
            try:
                return ask(text)
            except Exception:  # a failing call is an empty answer: the rules alone then decide
                return ""

        for prompts in batches:
            yield prompts.map(answer)

    return call(prompt)


def constant_model(answer: str = "{}") -> Callable[[], Callable[[str], str]]:
    """The default provider: the same answer to everything."""
    return lambda: lambda _: answer


_FENCE = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.S)


def _objects(text: str) -> Iterator[str]:
    """The balanced {...} of a text by their start, in one pass, once with braces inside strings left out, once with them.

    The second reading is for quotes of the prose around an object, which open no string.
    """
    open_, plain, spans, quoted, escaped = [], [], set(), False, False
    for i, c in enumerate(text):
        if c == "{":
            plain.append(i)
        elif c == "}" and plain:
            spans.add((plain.pop(), i + 1))
        if quoted:
            if c == '"' and not escaped:
                quoted = False
            escaped = c == "\\" and not escaped
        elif c == "{":
            open_.append(i)
        elif open_ and c == '"':
            quoted, escaped = True, False
        elif open_ and c == "}":
            spans.add((open_.pop(), i + 1))
    for start, end in sorted(spans):
        yield text[start:end]


def first_json_object(text: str | None) -> str | None:
    """The first JSON object in a text: in a fence if there is one, else the first balanced braces that parse.

    An unmatched or bad brace before an object does not hide it.
    """
    fenced = [m[1] for m in _FENCE.finditer(text or "")]
    for candidate in (*fenced, *_objects(text or "")):
        try:
            value = json.loads(candidate)
        except (json.JSONDecodeError, RecursionError):
            continue
        if isinstance(value, dict):
            return json.dumps(value, ensure_ascii=False)
    return None


def json_object(text: Column) -> Column:
    """Column form of first_json_object."""

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(first_json_object)

    return find(text)


_FINDING = "struct<severity:string,description:string,evidence:string,rule_id:string>"


def typed_results(df: DataFrame, answer: str, max_score: int = 12) -> DataFrame:
    """df with verdict, score, confidence and findings read from the JSON text of `answer`.

    Unknown verdicts are uncertain, numbers are clamped (confidence 70 without one), anything that is no
    object in findings is left out.
    """
    v = F.try_parse_json(answer)
    read = lambda path, kind: F.try_variant_get(v, path, kind)
    verdict = F.lower(read("$.verdict", "string"))
    findings = F.filter(F.coalesce(read("$.findings", f"array<{_FINDING}>"), F.array().cast(f"array<{_FINDING}>")), lambda x: x.isNotNull() & x["description"].isNotNull())
    clamp = lambda c, top, default: F.greatest(F.lit(0), F.least(F.lit(top), F.coalesce(c, F.lit(default))))
    return df.withColumns({
        "verdict": F.when(verdict.isin(*VERDICTS), verdict).otherwise("uncertain"),
        "score": clamp(read("$.score", "int"), max_score, 0),
        "confidence": clamp(read("$.confidence", "int"), 100, 70),
        "findings": findings,
    })


def _severity(value: Column) -> Column:
    low = F.lower(F.coalesce(value, F.lit("medium")))
    return F.when(low.isin("high", "medium", "low"), low).otherwise("medium")


def _cut_findings(found: Column, most: int | None) -> Column:
    """Findings with known severities and texts of 1000 and 800 characters at most."""
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    typed = F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: F.struct(
        _severity(x["severity"]).alias("severity"), cut(x["description"], 1000).alias("description"), cut(x["evidence"], 800).alias("evidence"), x["rule_id"].alias("rule_id")))
    return typed if most is None else F.slice(typed, 1, most)


def _answer(answer: str):
    v = F.try_parse_json(answer)
    read = lambda path, kind: F.try_variant_get(v, path, kind)
    first = lambda kind, *paths: F.coalesce(*[read(p, kind) for p in paths])
    clamp = lambda c, top, default: F.greatest(F.lit(0), F.least(F.lit(top), F.coalesce(c, F.lit(default))))
    none = F.array().cast(f"array<{_FINDING}>")
    found = F.coalesce(read("$.findings", f"array<{_FINDING}>"), none)
    return read, first, clamp, found


def explorer_answers(df: DataFrame, answer: str) -> DataFrame:
    """df with an explorer's answer: verdict_hint, score_hint, confidence, up to 20 findings, evidence_refs, reasoning."""
    _, first, clamp, found = _answer(answer)
    hint = F.lower(first("string", "$.verdict_hint", "$.verdict"))
    return df.withColumns({
        "verdict_hint": F.when(hint.isin(*VERDICTS), hint).otherwise("uncertain"),
        "score_hint": clamp(first("int", "$.score_hint", "$.score"), 12, 0),
        "confidence": clamp(first("int", "$.confidence", "$.confidence_hint"), 100, 50),
        "findings": _cut_findings(found, 20),
        "evidence_refs": F.coalesce(first("array<string>", "$.evidence_refs"), F.array().cast("array<string>")),
        "reasoning": F.substring(F.coalesce(first("string", "$.reasoning", "$.details", "$.notes"), F.lit("")), 1, 3000),
    })


def critic_answers(df: DataFrame, answer: str) -> DataFrame:
    """df with a critic's answer: verdict, score, confidence, selected_from, evidence_verified, findings, review, reasoning."""
    read, first, clamp, found = _answer(answer)
    verdict, selected = F.lower(read("$.verdict", "string")), read("$.selected_from", "string")
    known = F.when(verdict.isin(*VERDICTS), verdict).otherwise("uncertain")
    return df.withColumns({
        "verdict": known,
        "score": clamp(read("$.score", "int"), 12, 0),
        "confidence": clamp(read("$.confidence", "int"), 100, 50),
        "selected_from": F.when(selected.isin("A", "B", "merged", "critic_only"), selected).otherwise("merged"),
        "evidence_verified": F.coalesce(read("$.evidence_verified", "boolean"), F.lit(False)),
        "findings": _cut_findings(found, None),
        "human_review_required": F.coalesce(read("$.human_review_required", "boolean"), F.lit(False)) | (known == "uncertain"),
        "reasoning": F.substring(F.coalesce(first("string", "$.reasoning", "$.details"), F.lit("")), 1, 5000),
    })


def staffing_answers(df: DataFrame, answer: str) -> DataFrame:
    """df with staffing facts from JSON text: numbers that do not parse are null, or 0 where a count is meant."""
    read, _, _, _ = _answer(answer)
    number = lambda name: read(f"$.{name}", "int")
    names = lambda name: F.coalesce(read(f"$.{name}", "array<string>"), F.array().cast("array<string>"))
    return df.withColumns({
        **{f: number(f) for f in ("total_employees", "safety_engineers_actual", "section_supervisors_actual", "patrol_workers_actual")},
        "pipeline_count": F.coalesce(number("pipeline_count"), F.lit(0)), "pipeline_length_km": F.coalesce(read("$.pipeline_length_km", "double"), F.lit(0.0)),
        "pipeline_names": names("pipeline_names"), "pipeline_kinds": names("pipeline_kinds"),
    })


def with_retry(ask: Callable[[str], str], retries: int = 2, backoff: float = 0.0, fallback: Callable[[str], str] | None = None) -> Callable[[str], str]:
    """A provider that tries again after failures, waiting longer each time, and then falls back.

    A denied permission is neither tried again nor answered otherwise.
    """

    def call(prompt: str) -> str:
        for attempt in range(retries + 1):
            try:
                return ask(prompt)
            except PermissionError:
                raise
            except Exception as error:
                last = error
                if attempt < retries and backoff:
                    time.sleep(backoff * (attempt + 1))
        if fallback is not None:
            return fallback(prompt)
        raise RuntimeError("all tries failed") from last

    return call


def scripted_model(answers: dict[str, str], default: str = "{}") -> Callable[[], Callable[[str], str]]:
    """A provider for tests: the answer of the first key that a prompt holds."""
    return lambda: lambda prompt: next((a for k, a in answers.items() if k in prompt), default)


def http_model(url: str, model: str, key_variable: str = "MODEL_API_KEY", timeout: float = 120.0, retries: int = 2) -> Callable[[], Callable[[str], str]]:
    """A provider behind a chat completion endpoint; only time-outs and broken connections are tried again."""

    def make() -> Callable[[str], str]:
        import os
        import urllib.error
        import urllib.request

        def ask(prompt: str) -> str:
            body = json.dumps({"model": model, "messages": [{"role": "user", "content": prompt}]}).encode()
            request = urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(key_variable, '')}"})
            for attempt in range(retries + 1):
                try:
                    with urllib.request.urlopen(request, timeout=timeout) as reply:
                        return json.load(reply)["choices"][0]["message"]["content"]
                except urllib.error.HTTPError:
                    raise  # an answer of the server, not a broken connection
                except (urllib.error.URLError, TimeoutError):
                    if attempt == retries:
                        raise
            return ""

        return ask

    return make


PROVIDERS = {"constant": constant_model, "scripted": scripted_model, "http": http_model}


def provider(config: dict) -> Callable[[], Callable[[str], str]]:
    """The provider that a configuration names: {"kind": ..., and its arguments}."""
    options = dict(config)
    kind = options.pop("kind", "constant")
    if kind not in PROVIDERS:
        raise ValueError(f"unknown provider {kind}")
    return PROVIDERS[kind](**options)


def vision_column(make: Callable[[], Callable[[bytes, str], str]], image: Column, prompt: Column) -> Column:
    """A column of answers about images (binary content), as model_column is about prompts."""

    @F.pandas_udf("string")
    def call(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        look = make()

        def answer(content: bytes | None, text: str | None) -> str:
            try:
                return look(content or b"", text or "")
            except Exception:  # as in model_column
                return ""

        for contents, prompts in batches:
            yield pd.Series([answer(c, p) for c, p in zip(contents, prompts, strict=True)], dtype=object)

    return call(image, prompt)


def described_images(files: DataFrame, make: Callable[[], Callable[[bytes, str], str]], prompt: str) -> DataFrame:
    """Image files (path, content) with the first JSON object of the model's answer as `analysis`."""
    return files.select("path", json_object(vision_column(make, F.col("content"), F.lit(prompt))).alias("analysis"))
