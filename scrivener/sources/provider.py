"""Completions from a provider that is called once for each request."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.completion import sanitized

RESPONSE = "text string, model string, finishReason string, usage struct<inputTokens:double,outputTokens:double>"
# Kinds of errors.
ERRORS = ("network", "timeout", "aborted", "http", "malformed_response", "provider")


class HttpError(Exception):
    """An answer with a status that is no success."""


def noop(request: str) -> str:
    """A provider that proposes nothing."""
    return '{"text": ""}'


class Endpoint:
    """A provider that posts ``{"request": ...}`` as JSON to an address.

    ``headers``: a mapping, or a function that makes one for each request; only texts are
    sent.  The client gives up after ``timeout`` seconds, and a status that is no success is
    an ``HttpError``.  Sent to the executors, it holds nothing but these settings.
    """

    def __init__(self, url: str, headers: dict[str, str] | Callable[[], dict[str, str]] | None = None, timeout: float = 2.5, method: str = "POST"):
        self.url, self.headers, self.timeout, self.method = url, headers, timeout, method

    def __call__(self, request: str) -> str:
        own = self.headers() if callable(self.headers) else self.headers or {}
        headers = {"content-type": "application/json"} | {k: v for k, v in own.items() if isinstance(v, str)}
        body = json.dumps({"request": json.loads(request)}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, body, headers, method=self.method), timeout=self.timeout) as answer:
                return answer.read().decode()
        except urllib.error.HTTPError as fault:
            raise HttpError(str(fault.code)) from None
        except urllib.error.URLError as fault:
            raise (fault.reason if isinstance(fault.reason, TimeoutError) else ConnectionError(str(fault.reason))) from None


def completed(requests: DataFrame, provider: Callable[[str], str] = noop, column: str = "request") -> DataFrame:
    """Adds body, what ``provider`` answers to each request (JSON text), and error, the kind of its failure.

    A provider may raise TimeoutError, ConnectionError, HttpError, InterruptedError (a call
    that was given up) or anything else; a failure is a row's outcome, not the job's.  Its
    own client sets the time limit.
    """
    names = requests.columns

    def call(request: str) -> tuple[str | None, str | None]:
        try:
            return provider(request), None
        except TimeoutError:
            return None, "timeout"
        except ConnectionError:
            return None, "network"
        except InterruptedError:
            return None, "aborted"
        except HttpError:
            return None, "http"
        except Exception:
            return None, "provider"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [call(r) for r in batch[column]]
            yield batch[names].assign(body=[a for a, _ in answers], error=[e for _, e in answers])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.mapInPandas(rows, f"{schema}, body string, error string")


def parsed(body: Column, error: Column) -> Column:
    """Struct (text, model, finish_reason, error) of a response body; one without a text is malformed."""
    r = F.from_json(body, RESPONSE)
    raw = F.get_json_object(body, "$.text")
    quoted = F.try_parse_json(body).isNotNull() & F.schema_of_variant(F.variant_get(F.try_parse_json(body), "$", "variant")).contains("text: STRING")
    sound = error.isNull() & raw.isNotNull() & quoted
    kind = F.when(error.isNotNull(), error).when(~F.coalesce(sound, F.lit(False)), "malformed_response")
    return F.struct(F.when(kind.isNull(), r["text"]).alias("text"), F.when(kind.isNull(), r["model"]).alias("model"), F.when(kind.isNull(), r["finishReason"]).alias("finish_reason"), kind.alias("error"))


def shown(responses: DataFrame, before: str = "context_before", most: int = 220) -> DataFrame:
    """Responses (body, error, ``before``) with text as it may be shown, and error."""
    answer = responses.withColumn("answer", parsed(F.col("body"), F.col("error")))
    text = sanitized(F.col("answer.text"), F.col(before), F.expr("cast(array() as array<string>)"), most)
    return answer.drop("error").withColumns({"text": text, "error": F.col("answer.error")}).drop("answer")
