"""Recognition of page images by a client that the caller supplies: requests, answers, retries and pace."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscribe.functions import text as T
from veriscribe.functions.detect import TAXONOMY
from veriscribe.sources.files import LOG_SCHEMA

DEFAULT_PROMPT = "Transcribe all text in the images exactly, in order, and return the text only."
#: Longest part of each text in a question about kinds of errors.
ASKED_CHARS = 3000


@dataclass(frozen=True)
class Options:
    model: str = "echo"
    attempts: int = 5
    longest_wait: float = 30.0
    least_interval: float = 0.0
    parallel: int = 4
    prompt: str = ""
    personal_prompt: str = ""


def prompt_of(options: Options) -> str:
    return options.prompt or options.personal_prompt or DEFAULT_PROMPT


def with_retries(call: Callable[[], dict], options: Options, sleep: Callable[[float], None] = time.sleep) -> tuple[dict | None, str | None]:
    """The answer, or the last error, after waits that double up to a bound."""
    error = None
    for attempt in range(options.attempts):
        try:
            return call(), None
        except Exception as x:  # noqa: BLE001 - a client may raise anything, and the case's row reports it
            error = f"{type(x).__name__}: {x}"
            if attempt + 1 < options.attempts:
                sleep(min(options.longest_wait, 2.0**attempt))
    return None, error


def clean(text: str | None) -> str:
    for marker in T.MARKERS:
        text = (text or "").replace(marker, "")
    return text.strip("\n")


def diagnostics(response: Column) -> dict[str, Column]:
    """Fields of a response in JSON text, null where absent."""
    get = lambda path: F.get_json_object(response, path)
    reason = get("$.choices[0].finish_reason")
    return {
        "response_id": get("$.id"),
        "response_model": get("$.model"),
        "finish_reason": reason,
        "usage": F.from_json(get("$.usage"), "map<string,string>"),
        "refusal": get("$.choices[0].message.refusal"),
        "blocked_by_safety": F.when(reason.isin("content_filter", "safety"), True),
    }


def recognise(cases: DataFrame, client: Callable[[], Callable[[str, list[bytes]], dict]], options: Options = Options()) -> DataFrame:
    """Log rows of cases (code_id, ratio, page_paths, contents).

    client() is made once for each task and called with the prompt and the pages' bytes; it returns the response
    as a dict with a text, or raises. Tasks, at most options.parallel at a time, keep the interval between their calls.
    """
    columns = [c.split(" ")[0] for c in re.split(r",\s*(?![^<]*>)", LOG_SCHEMA)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, last = client(), 0.0
        for batch in batches:
            rows = []
            for case in batch.itertuples():
                pause = options.least_interval - (time.monotonic() - last)
                if last and pause > 0:
                    time.sleep(pause)
                last = time.monotonic()
                answer, error = with_retries(lambda: call(prompt_of(options), list(case.contents)), options)
                paths = list(case.page_paths)
                row = {"code_id": case.code_id, "ratio": case.ratio, "num_pages": len(paths), "image_paths": paths, "image_path": paths[0] if paths else None, "model": options.model}
                if error is None:
                    text = clean(answer.get("text"))
                    reason = answer.get("finish_reason")
                    row |= {k: answer.get(k) for k in ("response_id", "response_model", "finish_reason", "refusal")} | {"text": text, "text_len": len(text)}
                    row["usage"] = {str(k): str(v) for k, v in (answer.get("usage") or {}).items()} or None
                    row["blocked_by_safety"] = True if reason in ("content_filter", "safety") else None
                else:
                    row["error"] = error
                rows.append({c: row.get(c) for c in columns})
            yield pd.DataFrame(rows, columns=columns)

    return cases.repartition(options.parallel).mapInPandas(run, LOG_SCHEMA)


def echo_client(texts: dict[bytes, str] | None = None) -> Callable[[], Callable]:
    """A client for tests: the text that belongs to the first page, or its length."""

    def make() -> Callable:
        return lambda prompt, pages: {"text": (texts or {}).get(pages[0], f"{len(pages[0])} bytes") if pages else "", "finish_reason": "stop", "response_id": "echo", "usage": {"pages": len(pages)}}

    return make


def question(reference: str, hypothesis: str) -> str:
    return f"Name the kinds of errors, of {', '.join(TAXONOMY)}, as a JSON list.\nReference:\n{reference[:ASKED_CHARS]}\nTranscription:\n{hypothesis[:ASKED_CHARS]}"


def kinds_in(answer: Column) -> Column:
    """The first JSON list in a free answer; an empty one if there is none or it can't be read."""
    return F.coalesce(F.from_json(F.regexp_extract(answer, r"(?s)(\[.*?\])", 1), "array<string>"), F.expr("cast(array() as array<string>)"))


def ask_kinds(pairs: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """pairs with the kinds of errors that a caller's model names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def of(a: str, b: str) -> list[str]:
            try:
                found = re.search(r"\[.*?\]", ask(question(a or "", b or "")), re.S)
                return [str(x) for x in json.loads(found[0])] if found else []
            except Exception:  # noqa: BLE001 - any failure of the model means that it names nothing
                return []

        for batch in batches:
            batch["kinds"] = [of(a, b) for a, b in zip(batch["reference"], batch["hypothesis"])]
            yield batch

    schema = type(pairs.schema)([*pairs.schema.fields]).add("kinds", "array<string>")
    return pairs.mapInPandas(run, schema)
