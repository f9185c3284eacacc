"""Calls of models and agents as a source: one answer for each row, kept in a table so that none is asked twice."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.operators.lineage import ship

ANSWER = "content string, reasoning string, ok boolean, error string, attempts int, seconds double, prompt_tokens long, completion_tokens long"

#: Error codes of agents and whether a call is repeated, codes of HTTP statuses, retry limits.
RETRIED = {"MODEL_TIMEOUT": True, "OVERLOADED": True, "MODEL_ERROR": True, "INTERNAL": False, "UNSUPPORTED_PROMPT_TYPE": False, "INVALID_REQUEST": False}
STATUS = {400: "INVALID_REQUEST", 422: "UNSUPPORTED_PROMPT_TYPE", 429: "OVERLOADED", 500: "INTERNAL", 502: "MODEL_ERROR", 503: "OVERLOADED", 504: "MODEL_TIMEOUT"}
RETRIES, BACKOFF, PER_SAMPLE = 3, 1.0, 300.0


class CallError(Exception):
    """A call that failed; `code` decides whether it is repeated."""

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(message or code)
        self.code = code


def code_of(status: int) -> str:
    return STATUS.get(status, "MODEL_ERROR" if 500 <= status < 600 else "INTERNAL")


def divided(content: str | None, reasoning: str | None = None) -> tuple[str | None, str | None]:
    """(answer, reasoning) with thoughts between think tags moved to the reasoning."""
    if content is None:
        return None, reasoning
    thoughts = [reasoning] if reasoning else []
    thoughts += [t.strip() for t in re.findall(r"(?s)<think>(.*?)</think>", content)]
    rest = re.sub(r"(?s)<think>.*?</think>", "", content)
    if "</think>" in rest:
        thought, rest = rest.split("</think>", 1)
        thoughts.append(thought.strip())
    elif "<think>" in rest:
        rest, thought = rest.split("<think>", 1)
        thoughts.append(thought.strip())
    return rest.strip(), "\n".join(t for t in thoughts if t) or None


@dataclass(frozen=True)
class Chat:
    """A chat-completion endpoint. Rows give `prompt` and may give `system_prompt`."""

    url: str
    model: str
    key: str = ""
    parameters: tuple[tuple[str, Any], ...] = ()
    timeout: float = PER_SAMPLE

    def __call__(self, row: dict[str, Any]) -> dict[str, Any]:
        messages = [{"role": "system", "content": row["system_prompt"]}] if row.get("system_prompt") else []
        body = {"model": self.model, "messages": [*messages, {"role": "user", "content": row["prompt"]}], **dict(self.parameters)}
        reply = posted(self.url, body, {"Authorization": f"Bearer {self.key}"} if self.key else {}, self.timeout)
        message, usage = reply["choices"][0]["message"], reply.get("usage") or {}
        content, reasoning = divided(message.get("content"), message.get("reasoning_content") or message.get("reasoning"))
        return {"content": content, "reasoning": reasoning, "prompt_tokens": usage.get("prompt_tokens"), "completion_tokens": usage.get("completion_tokens")}


@dataclass(frozen=True)
class Agent:
    """A participant's service: the row's `payload`, JSON without answers, is posted; `prediction` comes back."""

    url: str
    timeout: float = PER_SAMPLE

    def __call__(self, row: dict[str, Any]) -> dict[str, Any]:
        reply = posted(self.url, json.loads(row["payload"]), {}, self.timeout)
        if "prediction" not in reply:
            raise CallError("INTERNAL", "no prediction")
        given = reply["prediction"]
        return {"content": given if isinstance(given, str) else json.dumps(given, ensure_ascii=False), "reasoning": reply.get("reasoning")}


def posted(url: str, body: dict[str, Any], headers: dict[str, str], timeout: float) -> dict[str, Any]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            reply = json.loads(answer.read())
    except urllib.error.HTTPError as error:
        raise CallError(code_of(error.code), str(error)) from error
    except OSError as error:
        raise CallError("MODEL_TIMEOUT", str(error)) from error
    except ValueError as error:
        raise CallError("INTERNAL", "not JSON") from error
    if not isinstance(reply, dict):
        raise CallError("INTERNAL", "not an object")
    if reply.get("error"):
        problem = reply["error"]
        raise CallError(str(problem.get("code", "INTERNAL")) if isinstance(problem, dict) else "INTERNAL", str(problem))
    return reply


def answered(call: Callable[[dict[str, Any]], dict[str, Any]], row: dict[str, Any], retries: int = RETRIES, pause: float = BACKOFF, limit: float = PER_SAMPLE) -> dict[str, Any]:
    """One answer: repeated with pauses of 1, 2, 4 ... seconds where the error allows it and the time suffices."""
    began = time.monotonic()
    out: dict[str, Any] = {"content": None, "reasoning": None, "prompt_tokens": None, "completion_tokens": None}
    for attempt in range(1, retries + 2):
        out["attempts"] = attempt
        try:
            return out | call(row) | {"ok": True, "error": None, "seconds": time.monotonic() - began}
        except CallError as error:
            out |= {"ok": False, "error": error.code}
            wait = pause * 2 ** (attempt - 1)
            if attempt > retries or not RETRIED.get(error.code, False) or time.monotonic() - began + wait > limit:
                break
            time.sleep(wait)
    return out | {"seconds": time.monotonic() - began}


def asked(rows: DataFrame, call: Callable[[dict[str, Any]], dict[str, Any]], key: str, threads: int = 8, retries: int = RETRIES, pause: float = BACKOFF) -> DataFrame:
    """(key, content, reasoning, ok, error, attempts, seconds, tokens): `call` for every row, `threads` at once in a
    task. `call` is pickled to the executors. A plan that reads this twice asks twice: use `ask`."""
    columns = [c for c in (key, "prompt", "system_prompt", "payload") if c in rows.columns]
    names = [part.split()[0] for part in ANSWER.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                replies = pool.map(lambda r: answered(call, r, retries, pause), frame.to_dict("records"))
                out = pd.DataFrame(list(replies), columns=names)
                for c in ("prompt_tokens", "completion_tokens"):
                    out[c] = out[c].astype("Int64")
                out.insert(0, key, frame[key].to_numpy())
                yield out

    ship(rows.sparkSession)
    sent = rows.select(*columns)
    kind = sent.schema[key].dataType.simpleString()
    return sent.mapInPandas(run, f"{key} {kind}, {ANSWER}")


def ask(rows: DataFrame, call: Callable[[dict[str, Any]], dict[str, Any]], key: str, path: str, threads: int = 8) -> DataFrame:
    """`asked`, appended to the Parquet table at `path`: keys that it has with success are not asked again.

    Returns the table's successful answers, the failed ones of this run included where none succeeded.
    """
    spark = rows.sparkSession
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    if location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location):
        done = spark.read.parquet(path).filter("ok").select(key).distinct()
        rows = rows.join(done, key, "left_anti")
    asked(rows, call, key, threads).write.mode("append").parquet(path)
    table = spark.read.parquet(path)
    value = F.struct(*(c for c in table.columns if c != key))
    # the successful answer of the fewest attempts; a retried task may have written a key twice
    return table.groupBy(key).agg(F.min_by(value, F.struct(~F.col("ok"), "attempts", "content")).alias("a")).select(key, "a.*")


def usage(answers: DataFrame) -> DataFrame:
    """(calls, succeeded, failed, attempts, seconds, prompt_tokens, completion_tokens) in all."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return answers.agg(F.count(F.lit(1)).alias("calls"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), *map(total, ("attempts", "seconds", "prompt_tokens", "completion_tokens")))
