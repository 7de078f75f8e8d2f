"""Text generators: requests and answers as Column expressions, and a sender that tries again.

Requests and answers are JSON, so a stage can write requests, send them once, and read answers again without asking twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T

#: Statuses below 500 after which a request is sent again, tries, and seconds of pause after the first.
AGAIN = (408, 409, 425, 429)
TRIES, PAUSE = 3, 1.5
MOST_TOKENS = 8192
#: What a field context is without an answer, and how much of an answer that is no JSON is kept as notes.
UNKNOWN = {"field": "未知领域", "subfield": "未知子领域", "terminology_notes": "按通用学术中文术语翻译。"}
KEPT_NOTES = 1000


class ProviderError(RuntimeError):
    """A provider refused a request, or did not answer in all tries."""


class Cancelled(RuntimeError):
    """The caller gave up."""


def prompt(template: str, **values: Column) -> Column:
    """The template with each ``{{name}}`` replaced by its value; values are not searched again for the names before them."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{%s}}" % name), value)
    return out


def request(messages: Column, model: str, kind: str, temperature: float = 0.2) -> Column:
    """The JSON body for an array of struct(role, content). ``chat`` takes messages as they are; ``messages`` takes the system
    ones apart, joined by empty lines, knows user and assistant only, and needs one message. Null contents are empty."""
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    role, content = (lambda m: F.coalesce(m["role"], F.lit("user"))), (lambda m: F.coalesce(m["content"], F.lit("")))
    if kind == "chat":
        return F.to_json(F.struct(F.lit(model).alias("model"), F.transform(messages, lambda m: message(role(m), content(m))).alias("messages"), F.lit(temperature).alias("temperature")))
    others = F.transform(F.filter(messages, lambda m: role(m) != "system"), lambda m: message(F.when(role(m) == "assistant", "assistant").otherwise("user"), content(m)))
    said = F.when(F.size(others) > 0, others).otherwise(F.array(message(F.lit("user"), F.lit(""))))
    system = F.filter(messages, lambda m: role(m) == "system")
    joined = F.when(F.size(system) > 0, F.array_join(F.transform(system, content), "\n\n"))
    return F.to_json(F.struct(F.lit(model).alias("model"), said.alias("messages"), F.lit(temperature).alias("temperature"), F.lit(MOST_TOKENS).alias("max_tokens"), joined.alias("system")))


def context(answer: Column) -> Column:
    """A field context from a generator's answer, JSON in a fence or without; an answer that is no JSON object becomes notes."""
    bare = F.regexp_replace(F.coalesce(answer, F.lit("")), r"^[` \n]+|[` \n]+$", "")
    found = F.from_json(T.strip(F.regexp_replace(bare, r"^json", "")), ", ".join(f"{name} string" for name in UNKNOWN), {"mode": "PERMISSIVE"})
    good = F.coalesce(F.get_json_object(F.regexp_replace(bare, r"^json", ""), "$").startswith("{"), F.lit(False))
    part = lambda name: F.when(good, F.coalesce(found[name], F.lit(UNKNOWN[name]))).otherwise(F.substring(F.coalesce(answer, F.lit("")), 1, KEPT_NOTES) if name == "terminology_notes" else F.lit(UNKNOWN[name]))
    return F.struct(*(part(name).alias(name) for name in UNKNOWN))


def trying(send: Callable[[str], tuple[int, str]], cancelled: Callable[[], bool] = lambda: False, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """``send`` (body to status and answer) that tries again after errors of the network and of the provider, not after refusals."""

    def ask(body: str) -> str:
        reason = None
        for attempt in range(TRIES):
            if cancelled():
                raise Cancelled
            if attempt:
                sleep(PAUSE * attempt)
            try:
                status, answer = send(body)
            except OSError as e:
                reason = str(e)
                continue
            if status < 400:
                return answer
            reason = f"status {status}"
            if status < 500 and status not in AGAIN:
                break
        raise ProviderError(f"no answer after {attempt + 1} tries: {reason}")

    return ask


def asked(rows: DataFrame, send: Callable[[str], tuple[int, str]], body_col: str = "body", out_col: str = "answer") -> DataFrame:
    """``rows`` with the answer to each body, null for null. The column is not deterministic: write it before it is read twice."""

    @F.arrow_udf("string")
    def answers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ask = trying(send)
        for bodies in batches:
            yield pa.array([None if b is None else ask(b) for b in bodies.to_pylist()], pa.string())

    return rows.withColumn(out_col, answers.asNondeterministic()(F.col(body_col)))
