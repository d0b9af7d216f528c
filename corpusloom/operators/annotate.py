"""Annotation service operators: batching, cache, validation, repair, and a pluggable annotator."""

from __future__ import annotations

import json
import subprocess
import time
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codebook

#: Takes ids, texts and a ceiling of results; gives one record (a dict with an id) for each item it could label.
Annotator = Callable[[list[str], list[str], int], list[dict]]


def json_from(text: Column, schema: str) -> Column:
    """The record in a noisy answer: code fences off, from the first brace to the last."""
    return F.from_json(F.regexp_extract(F.regexp_replace(text, "```(json)?", ""), r"(?s)\{.*\}", 0), schema)


#: The schema of an answer of triples.
TRIPLES = "triples array<struct<subject:string,subject_type:string,relation:string,object:string,object_type:string,valence:string>>"


def triples_from(cache: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, subject, subject_type, relation, object, object_type, valence): one row a triple of each cached answer; an answer that can't be read has none."""
    return cache.select(key, F.inline(json_from(F.col(answer), TRIPLES)["triples"]))


def quota(message: Column) -> list[Column]:
    """limit_tokens, used_tokens and window ("day", "minute" or null) from a provider's error message; null where it doesn't say."""
    number = lambda name: F.nullif(F.regexp_extract(message, name + " ([0-9]+)", 1), F.lit("")).cast("long")
    window = F.when(message.rlike("per[- ]day"), "day").when(message.rlike("per[- ]minute"), "minute")
    return [number("Limit").alias("limit_tokens"), number("Used").alias("used_tokens"), window.alias("window")]


def first_fault(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that a record breaks (a null answer breaks it too), else null."""
    out = None
    for name, holds in rules:
        bad = ~F.coalesce(holds, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def label_rules(fields: dict[str, Column], flags: dict[str, Column], confidence: Column | None = None) -> list[tuple[str, Column]]:
    """Rules of the codebook: closed sets, flags present, confidence in [0, 1], nothing evaluated where not relevant."""
    rules = [(f"{f} not in the codebook", c.isin(codebook.LEVELS[f])) for f, c in fields.items()]
    rules += [(f"{f} missing", c.isNotNull()) for f, c in flags.items()]
    if confidence is not None:
        rules.append(("confidence out of range", confidence.between(0, 1)))
    if {"relevance", "stance"} <= fields.keys():
        rules.append(("stance without relevance", (fields["relevance"] != "not_relevant") | (fields["stance"] == "non_evaluative")))
    return rules


def uncached(batches: DataFrame, cache: DataFrame) -> DataFrame:
    """Batches whose key the cache doesn't hold."""
    return batches.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def missing_ids(wanted: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    return wanted.join(labelled.select(key).distinct(), key, "left_anti")


def repair_ids(cache: DataFrame) -> DataFrame:
    """(cache_key, position, id, result): results one a row; one that echoes an id foreign to its batch gets the id at its position."""
    rows = cache.select("cache_key", "ids", F.posexplode("results").alias("position", "result"))
    return rows.select("cache_key", F.col("position").cast("long").alias("position"), F.when(F.array_contains("ids", F.col("result.id")), F.col("result.id")).otherwise(F.try_element_at("ids", F.col("position") + 1)).alias("id"), "result")


def purge_plan(cache: DataFrame) -> DataFrame:
    """(cache_key, wanted, returned, purge): what a purge of short batches would drop; the dry run of `purge_short`."""
    wanted, returned = F.size("ids").cast("long"), F.size("results").cast("long")
    return cache.select("cache_key", wanted.alias("wanted"), returned.alias("returned"), (returned < wanted).alias("purge"))


def purge_short(cache: DataFrame) -> DataFrame:
    """The cache without batches that brought fewer results than ids."""
    return cache.where(F.size("results") >= F.size("ids"))


def shards(df: DataFrame, key: str, n: int) -> DataFrame:
    """df with the shard (0 to n-1) that works on each row, by the key's remainder."""
    return df.withColumn("shard", F.pmod(F.col(key), F.lit(n)).cast("long"))


#: Factors of the pause after a failure and a success, its bounds in seconds for a hosted service.
SLOWER, FASTER, SHORTEST, LONGEST = 1.6, 0.9, 12.0, 180.0


def next_pause(pause: float, failed: bool, shortest: float = SHORTEST) -> float:
    """The pause before the next call; a pace of 0, of a local annotator, stays 0 until a call fails."""
    if failed:
        return min(LONGEST, max(pause, shortest) * SLOWER)
    return max(shortest, pause * FASTER) if pause else 0.0


def valid(record: dict, fields: dict[str, list[str]]) -> bool:
    """Whether a record has an id and a level of the codebook in each field."""
    return "id" in record and all(record.get(f) in levels for f, levels in fields.items())


def annotate(batches: DataFrame, annotator: Annotator, ceiling: int = 2400, attempts: int = 3, pace: float = 0.0, shortest: float = SHORTEST, fields: dict[str, list[str]] | None = None) -> DataFrame:
    """(cache_key, ids, results): each batch (cache_key, ids, texts) through the annotator, results as JSON.

    A short answer is asked for again with twice the ceiling, and the larger
    kept; with `fields`, records that break the codebook don't count. Pauses
    follow `next_pause`. A task that runs again gives the same keys.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pause = pace
        for p in parts:
            out = []
            for ids, texts in zip(p.column("ids"), p.column("texts"), strict=True):  # one batch's texts are Python objects at a time
                ids, texts = ids.as_py(), texts.as_py()
                best, room = [], ceiling
                for _ in range(attempts):
                    time.sleep(pause)
                    try:
                        got = [r for r in annotator(ids, texts, room) if fields is None or valid(r, fields)]
                        pause = next_pause(pause, False, shortest)
                    except (OSError, ValueError):
                        got, pause = [], next_pause(pause, True, shortest)
                    best = max(best, got, key=len)
                    if len(best) >= len(ids):
                        break
                    room *= 2
                out.append([json.dumps(r, sort_keys=True) for r in best])
            yield pa.RecordBatch.from_arrays([p.column("cache_key"), p.column("ids"), pa.array(out, pa.list_(pa.string()))], ["cache_key", "ids", "results"])

    return batches.select("cache_key", "ids", "texts").mapInArrow(run, "cache_key string, ids array<string>, results array<string>")


def keyword_annotator(ids: list[str], texts: list[str], ceiling: int) -> list[dict]:
    """An offline stand-in: labels by word counts, as far as the ceiling (characters) goes."""
    out, used = [], 0
    for i, t in zip(ids, texts, strict=True):
        used += len(t) // 4 + 20
        if used > ceiling:
            break
        n = len(t.split())
        out.append({"id": i, "relevance": codebook.LEVELS["relevance"][n % 2], "stance": codebook.LEVELS["stance"][n % 4] if n % 2 == 0 else "non_evaluative"})
    return out


def command_annotator(command: list[str], timeout: float = 600.0) -> Annotator:
    """A program that reads {"items": [{"id", "text"}], "ceiling"} as JSON and writes an answer with {"results": [...]} in it."""

    def run(ids: list[str], texts: list[str], ceiling: int) -> list[dict]:
        asked = json.dumps({"items": [{"id": i, "text": t} for i, t in zip(ids, texts, strict=True)], "ceiling": ceiling})
        try:
            done = subprocess.run(command, input=asked, capture_output=True, text=True, timeout=timeout, check=True)
        except subprocess.SubprocessError as e:
            raise OSError(str(e)) from e
        return results_in(done.stdout)

    return run


def endpoint_annotator(url: str, model: str, key: str, instruction: str, schema: dict, timeout: float = 120.0) -> Annotator:
    """A chat-completion endpoint that is asked for an answer of the given JSON schema, with {"results": [...]} in it."""

    def run(ids: list[str], texts: list[str], ceiling: int) -> list[dict]:
        items = json.dumps([{"id": i, "text": t} for i, t in zip(ids, texts, strict=True)])
        body = {"model": model, "max_tokens": ceiling, "messages": [{"role": "system", "content": instruction}, {"role": "user", "content": items}], "response_format": {"type": "json_schema", "json_schema": {"name": "results", "schema": schema}}}
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return results_in(json.load(answer)["choices"][0]["message"]["content"])

    return run


def results_in(answer: str) -> list[dict]:
    """The results in a noisy answer, from its first brace to its last; a ValueError if there are none to read."""
    found = json.loads(answer[answer.find("{") : answer.rfind("}") + 1] or "null")
    if not isinstance(found, dict) or not isinstance(found.get("results"), list):
        raise ValueError("no results in the answer")
    return [r for r in found["results"] if isinstance(r, dict)]


def prompt(text: Column, fields: list[str], compact: bool = True) -> Column:
    """The prompt of one item: the codebook's block and the text's first 1500 characters, as the format has it."""
    return F.concat(F.lit(codebook.prompt_block(fields, compact) + "\n\n"), F.substring(text, 1, 1500))
