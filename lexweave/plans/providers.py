"""Interfaces to models, and deterministic stand-ins that need no network."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C


class Model(Protocol):
    """Turns a prompt into a reply; raises when it cannot."""

    def __call__(self, prompt: str) -> str: ...


class Truncated(Exception):
    """The reply was cut off: ask for less."""


class Refused(Exception):
    """Credentials are wrong: asking again is no use."""


@dataclass(frozen=True)
class Retry:
    """How often a failed call is made again, and how long is waited before."""

    attempts: int = 3
    first_delay: float = 5.0
    sleep: Callable[[float], None] | None = None

    def call(self, model: Model, prompt: str) -> str:
        import time

        for n in range(1, self.attempts + 1):
            try:
                return model(prompt)
            except (Truncated, Refused):
                raise
            except Exception:
                if n == self.attempts:
                    raise
                (self.sleep or time.sleep)(self.first_delay * 2 ** (n - 1))
        raise AssertionError


def ask(df: DataFrame, key: str, prompt: str, make_model: Callable[[], Model], retry: Retry = Retry()) -> DataFrame:
    """(key, reply, error): each prompt's reply; the model is made once per worker batch stream."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            rows = []
            for k, p in zip(batch["key"], batch["prompt"], strict=True):
                try:
                    rows.append((k, retry.call(model, p), None))
                except Refused:
                    raise
                except Exception as error:
                    rows.append((k, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["key", "reply", "error"])

    out = df.select(F.col(key).alias("key"), F.col(prompt).alias("prompt")).mapInPandas(run, f"key {kind}, reply string, error string")
    return out.withColumnRenamed("key", key)


def extract(batch: list[dict], render: Callable[[list[dict]], str], model: Model, retry: Retry = Retry()) -> list[str]:
    """Replies for a batch of articles; where a reply is cut off, for its halves, down to single articles."""
    try:
        return [retry.call(model, render(batch))]
    except Truncated:
        if len(batch) < 2:
            return []
        half = len(batch) // 2
        return extract(batch[:half], render, model, retry) + extract(batch[half:], render, model, retry)


def correct(reply: str, model: Model, retry: Retry = Retry()) -> str:
    """A reply of keywords whose empty lists are asked for once more and replaced."""
    made = json.loads(reply)
    broken = {k["article_id"] for k in made.get("keywords", []) if not (k["keywords"].get("ru") and k["keywords"].get("kz"))}
    if not broken:
        return reply
    fixed = {k["article_id"]: k for k in json.loads(retry.call(model, json.dumps(sorted(broken)))).get("keywords", [])}
    made["keywords"] = [fixed.get(k["article_id"], k) if k["article_id"] in broken else k for k in made["keywords"]]
    return json.dumps(made, ensure_ascii=False)


# -- prompts --------------------------------------------------------------------

#: What a model is told to do; the sections that follow hold what it is told to do it with.
INTENT_TASK = (
    "Classify the question. Reply with one JSON object: language (ru, kz or mixed), is_legal_question, codex_slugs (only slugs of the list that govern the "
    "question, else none), keywords (4 to 10 legal terms in Russian, each with a weight from 0.1 to 1, heaviest first)."
)
ANSWER_TASK = (
    "Answer the question from the context alone, in the language of the question. Reply with one JSON object: answer (plain text; it begins with "
    f"{C.INSUFFICIENT} if the context does not suffice), citations (article_id, codex_prefix, number, name_ru of the articles used), confidence (0 to 1)."
)
FAITHFULNESS_TASK = "Judge from 0 to 1 how far the context supports every statement of the answer to the question. Reply with one JSON object: score, reason."
RELEVANCE_TASK = "Judge from 0 to 1 how far the answer answers the question. Reply with one JSON object: score, reason."
_SECTION = "### "


def prompt(task: str, **sections: Column) -> Column:
    """A task and its named sections; null and empty ones are left out."""
    parts = [F.lit(task)]
    for name, value in sections.items():
        parts.append(F.when(F.trim(F.coalesce(value, F.lit(""))) != "", F.concat(F.lit(f"{_SECTION}{name}\n"), value)))
    return F.array_join(F.array_compact(F.array(*parts)), "\n\n")


def section(text: str, name: str) -> str:
    """What a prompt has under a name; the last section may hold anything, also lines that look like names."""
    begin = text.find(f"\n\n{_SECTION}{name}\n")
    if begin < 0:
        return ""
    body = text[begin + len(f"\n\n{_SECTION}{name}\n") :]
    ends = [at for other in ("codexes", "history", "question", "answer", "context") if (at := body.find(f"\n\n{_SECTION}{other}\n")) >= 0]
    return body[: min(ends)] if ends and name != "context" else body


class WithFallback:
    """A model asked for replies of a schema first, and for plain JSON where that call fails."""

    def __init__(self, structured: Model, plain: Model) -> None:
        self.structured, self.plain = structured, plain

    def __call__(self, text: str) -> str:
        try:
            return self.structured(text)
        except (Truncated, Refused):
            raise
        except Exception:
            return self.plain(text)


class RuleIntent:
    """Stand-in for intent analysis: the question's longer words as keywords, longest first."""

    def __call__(self, prompt: str) -> str:
        question = section(prompt, "question")
        found = list(dict.fromkeys(w for w in re.findall(r"\w+", question.lower()) if len(w) > 3))
        found.sort(key=lambda w: (-len(w), w))
        keywords = [{"text": w, "weight": round(1 - 0.1 * i, 2)} for i, w in enumerate(found[:6])]
        return json.dumps({"language": "ru", "is_legal_question": bool(found), "codex_slugs": [], "keywords": keywords}, ensure_ascii=False)


class ExtractiveAnswer:
    """Stand-in for synthesis: the first article of the context, cited."""

    def __call__(self, prompt: str) -> str:
        context = section(prompt, "context")
        heads = re.findall(r"^\[(.+?) \| \S+ (.+?)\] ?(.*)$", context, re.MULTILINE)
        if not heads:
            return json.dumps({"answer": "", "citations": [], "confidence": 0.1})
        cited = [{"article_id": "", "codex_prefix": c, "number": n, "name_ru": name} for c, n, name in heads[:3]]
        body = context.split("\n", 1)[1] if "\n" in context else context
        return json.dumps({"answer": body[:500], "citations": cited, "confidence": 0.6}, ensure_ascii=False)


class OverlapJudge:
    """Stand-in for a judge: the share of the answer's words that the context has, or of the question's that the answer has."""

    def __call__(self, prompt: str) -> str:
        part = lambda name: set(re.findall(r"\w+", section(prompt, name).lower()))
        a, b = (part("answer"), part("context")) if section(prompt, "context") else (part("question"), part("answer"))
        return json.dumps({"score": len(a & b) / len(a) if a else 0.0, "reason": "word overlap"})


def judge(
    cases: DataFrame, key: str, question: str, answer: str, context: str | None = None, make_model: Callable[[], Model] = OverlapJudge, answer_chars: int = 2000, context_chars: int = 6000
) -> DataFrame:
    """(key, score, reason): a judge's score within 0 to 1 and its reason; a null score where it failed.

    With ``context`` it is the faithfulness of the answer to it, without one the
    relevance of the answer to the question.
    """
    cut = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n)
    held = {"context": cut(context, context_chars)} if context else {}
    asked = prompt(FAITHFULNESS_TASK if context else RELEVANCE_TASK, question=F.col(question), answer=cut(answer, answer_chars), **held)
    replies = ask(cases.select(key, asked.alias("_p")), key, "_p", make_model)
    made = F.from_json("reply", "score double, reason string")
    score = F.when(~F.isnan(made["score"]), F.greatest(F.lit(0.0), F.least(F.lit(1.0), made["score"])))
    return replies.select(key, score.alias("score"), F.coalesce(F.col("error"), made["reason"], F.lit("")).alias("reason"))
