"""Language-model providers.  A provider turns messages into responses; operators know no other contract.

messages: question_id, db_id, sample_idx, system, user and, if calls share a text, prefix; responses add response, input_tokens, output_tokens, stop_reason, and
those of a remote model latency_ms, cache_creation_input_tokens, cache_read_input_tokens.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark import recovery
from linkspark.functions.text import estimated_tokens
from linkspark.operators.prompts import prompt_hash
from linkspark.scale import numbered, running_sum

RESPONSE = "question_id bigint, db_id string, sample_idx int, system string, user string, response string, input_tokens bigint, output_tokens bigint, stop_reason string, cache_creation_input_tokens bigint, cache_read_input_tokens bigint, latency_ms bigint"


class Provider(Protocol):
    def __call__(self, messages: DataFrame) -> DataFrame: ...


def samples(messages: DataFrame, k: int) -> DataFrame:
    return messages.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("sample_idx", F.col("sample_idx").cast("int"))


def replay(responses: DataFrame) -> Provider:
    """Scripted answers: responses (user_hash, turn, response) by hash of the user message; a message's samples cycle through its turns.

    A message without script gets a null response.
    """

    def run(messages: DataFrame) -> DataFrame:
        scripts = responses.groupBy("user_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "response"))), lambda x: x["response"]).alias("turns"))
        rows = messages.withColumn("user_hash", F.sha2("user", 256)).join(scripts, "user_hash", "left")
        text = F.get("turns", (F.col("sample_idx") % F.size("turns")).cast("int"))
        return rows.select("question_id", "db_id", "sample_idx", "system", "user", text.alias("response"), estimated_tokens(F.concat("system", "user")).alias("input_tokens"), F.when(text.isNull(), 0).otherwise(estimated_tokens(text)).cast("long").alias("output_tokens"), F.when(text.isNull(), "error").otherwise("end_turn").alias("stop_reason"))

    return run


class Transient(Exception):
    """A fault that a later attempt may not meet: connection, rate limit, server error."""


def is_transient(error: BaseException) -> bool:
    """Transient itself, lost connections, timeouts, and errors whose status_code or status is 429 or 500 and above."""
    status = getattr(error, "status_code", getattr(error, "status", None))
    return isinstance(error, Transient | ConnectionError | TimeoutError) or isinstance(status, int) and (status == 429 or status >= 500)


def system_blocks(system: str, prefix: str | None, caching: bool) -> str | list[dict]:
    """The system part of a request.  A prefix that many calls share is a block of its own, marked for the model's cache; without
    caching it is text before the rest."""
    if prefix is None:
        return system
    if not caching:
        return f"{prefix}\n\n{system}"
    return [{"type": "text", "text": prefix, "cache_control": {"type": "ephemeral"}}, {"type": "text", "text": system}]


def remote(call: Callable[[str, str], tuple], attempts: int = 5, first_wait: float = 1.0, longest_wait: float = 8.0, caching: bool = True) -> Provider:
    """A provider from call(system, user) -> (text, input tokens, output tokens, stop reason[, cache tokens written, read]).

    Where messages have a column prefix, system is as ``system_blocks`` gives it.
    Transient errors are tried again with growing waits.  A message that fails for good gets a null response and the stop reason
    "error", so others go on.  A task that is run again asks again: write the answers before use, as the linkers do.
    """

    def ask(system: str | list[dict], user: str) -> tuple:
        wait = first_wait
        for attempt in range(attempts):
            began = time.monotonic()
            try:
                text, read, made, stop, *cache = call(system, user)
                return text, read, made, stop, *(cache or (0, 0)), round(1000 * (time.monotonic() - began))
            except Exception as error:
                if not is_transient(error):
                    break
                if attempt + 1 < attempts:
                    time.sleep(wait)
                    wait = min(2 * wait, longest_wait)
        return None, 0, 0, "error", 0, 0, 0

    added = ("response", "input_tokens", "output_tokens", "stop_reason", "cache_creation_input_tokens", "cache_read_input_tokens", "latency_ms")

    def run(messages: DataFrame) -> DataFrame:
        def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                got = [ask(system_blocks(s, p, caching), u) for s, u, p in zip(part["system"], part["user"], part["prefix"], strict=True)]
                yield part.drop(columns="prefix").assign(**{name: [g[i] for g in got] for i, name in enumerate(added)})

        prefix = F.col("prefix") if "prefix" in messages.columns else F.lit(None).cast("string").alias("prefix")
        return messages.select("question_id", "db_id", "sample_idx", "system", "user", prefix).mapInPandas(batches, RESPONSE)

    return run


def scripted(turns: Sequence[tuple | Exception]) -> Callable[[str, str], tuple]:
    """A call for ``remote`` that gives its turns one after another, over again; turns that are exceptions are raised."""
    position = -1

    def call(system: str, user: str) -> tuple:
        nonlocal position
        position += 1
        turn = turns[position % len(turns)]
        if isinstance(turn, Exception):
            raise turn
        return turn

    return call


class CapExceeded(RuntimeError):
    """The ledger's total has reached the cap; what was answered before is logged."""


#: Tokens that a call's envelope may add to those of its texts.
ENVELOPE = 64


def metered(provider: Provider, price: DataFrame, model: str, temperature: float, phase: str, path: str, cap: float, most_output: int = 4096, stop: bool = False) -> Provider:
    """``provider`` under a cost cap, its calls logged in the ledger at ``path``, which may hold earlier calls.

    Calls go by question_id and sample_idx, and one is made only while the ledger's total is below the cap: the call that reaches it
    is the last, as if each were asked alone.  They are asked in waves all the same: a text has no more tokens than bytes, and an
    answer ``most_output``, so the calls whose greatest costs together (a running sum) stay below what is left are safe at once; if
    not even the next one is, it is asked alone.  A wave's calls are logged before the next one.  Later messages get a null
    response and the stop reason "blocked"; with ``stop``, CapExceeded is raised instead, with all asked calls in the ledger.
    """

    def run(messages: DataFrame) -> DataFrame:
        from linkspark.operators.ledger import total_cost
        from linkspark.sources import readers, sinks

        spark = messages.sparkSession
        p = price.where(F.col("model") == model).first()
        read = F.octet_length("system") + F.octet_length("user") + ENVELOPE + (F.coalesce(F.octet_length("prefix"), F.lit(0)) if "prefix" in messages.columns else 0)
        most = F.ceil(read * max(p.p_in, p.p_write) + most_output * p.p_out) / 1e6
        named = ["question_id", "db_id", "sample_idx", "system", "user", *(["prefix"] if "prefix" in messages.columns else [])]
        dealt = messages.select(*named, most.cast("decimal(18,6)").alias("__most"))
        order = [F.col("question_id"), F.col("sample_idx")]
        dealt = recovery.written(running_sum(numbered(dealt, *order, name="__call"), F.col("__most"), *order, name="__upto"))
        total, asked, answers = dealt.count(), 0, []
        while asked < total:
            spent = total_cost(readers.ledger(spark, [path])).first().cost_usd if readers.exists(spark, path) else 0.0
            if spent >= cap:
                if stop:
                    raise CapExceeded(f"{spent:.4f} USD of {cap:.4f} are spent; {total - asked} calls of {phase} were not made")
                rest = dealt.where(F.col("__call") >= asked).drop("__most", "__call", "__upto")
                answers.append(rest.withColumns({"response": F.lit(None).cast("string"), "stop_reason": F.lit("blocked"), "input_tokens": F.lit(0).cast("long"), "output_tokens": F.lit(0).cast("long")}))
                break
            begun = dealt.where(F.col("__call") == asked).first()["__upto"]
            safe = F.col("__upto") + F.col("__most") - F.lit(begun) < F.lit(cap - spent).cast("double")
            wave = dealt.where((F.col("__call") >= asked) & (safe | (F.col("__call") == asked)))
            asked += wave.count()
            answers.append(recovery.written(provider(wave.drop("__most", "__call", "__upto"))))
            sinks.append_lines(ledger_rows(answers[-1], price, model, temperature, phase), path)
        if not answers:
            return provider(messages)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), answers)

    return run


def ledger_rows(responses: DataFrame, price: DataFrame, model: str, temperature: float, phase: str) -> DataFrame:
    """Ledger rows of successful calls, with cost."""
    from linkspark.operators.ledger import with_cost

    counted = lambda name: (F.coalesce(name, F.lit(0)) if name in responses.columns else F.lit(0)).cast("long").alias(name)
    rows = responses.where("response is not null").select(
        F.current_timestamp().alias("timestamp"), F.lit(model).alias("model"), F.lit(temperature).alias("temperature"), prompt_hash(F.col("system"), F.col("user")).alias("prompt_hash"),
        "input_tokens", "output_tokens", counted("cache_creation_input_tokens"), counted("cache_read_input_tokens"), F.lit(0.0).alias("cost_usd"), counted("latency_ms"),
        "stop_reason", F.create_map(F.lit("phase"), F.lit(phase), F.lit("question_id"), F.col("question_id").cast("string")).alias("metadata"), F.sha2("response", 256).alias("response_text_hash"),
    )
    order = rows.columns
    return with_cost(rows, price).select(*order)
