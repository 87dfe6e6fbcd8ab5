"""Decks built by an external model: asked, judged, and asked again with the errors until valid.

The loop is over rounds, not over requests: each round hands all open requests to the builder at once,
judges the answers in one job and keeps the invalid ones open. What a round found is a written table, so
a lost executor, or a driver that starts again, never asks the model twice for the same answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.plans.prompts import MAX_ROUNDS, judge_by_facts, named_facts, pool_facts
from cardloom.session import shared_dir, written
from cardloom.sources.stores import is_whole

# (request_id, attempt, prompt) -> (request_id, attempt, response)
Builder = Callable[[DataFrame], DataFrame]

VALID, EXHAUSTED = "valid", "exhausted"
# Names of a pool that are not looked up in the answers first.
SMALL_POOL = 100_000
FOUND = "request_id {id}, attempt int, prompt string, response string, errors string, is_valid boolean"


def in_batches(answer: Callable[[pd.DataFrame], Sequence[str | None]], tasks: int | None = None) -> Builder:
    """A builder from a function that answers a batch of prompts (request_id, attempt, prompt), one text or None for each.

    Batches are Arrow's; `tasks` says how many ask at a time, where that is not to follow the partitions.
    """

    def build(asked: DataFrame) -> DataFrame:
        id_type = asked.schema["request_id"].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch[["request_id", "attempt"]].assign(response=list(answer(batch)))

        dealt = asked.repartition(tasks) if tasks else asked
        return dealt.mapInPandas(run, f"request_id {id_type}, attempt int, response string")

    return build


def with_errors(prompt: Column, errors: Column) -> Column:
    """The next prompt: the last one and what was wrong with its answer."""
    return F.concat(prompt, F.lit("\n\nThe previous deck broke these rules:\n- "), F.replace(errors, F.lit("; "), F.lit("\n- ")))


def _once(df: DataFrame, path: str) -> DataFrame:
    """The rows as the table at `path`, written unless it is there as a whole."""
    if not is_whole(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_rounds(
    prompts: DataFrame, cards: DataFrame, builder: Builder, max_rounds: int = MAX_ROUNDS, base: str | None = None
) -> list[DataFrame]:
    """What each round found: request_id, attempt, prompt, response, errors, is_valid.

    Rounds end when no request is open or after `max_rounds`. A request the builder gives no answer for
    has an unreadable one; of several answers one counts. Rounds are kept below
    `base`; a call with the same `base` goes on where an earlier one stopped.
    """
    base = base or shared_dir(prompts.sparkSession, "deck-rounds")
    asked = prompts.select("request_id", F.lit(1).alias("attempt"), "prompt")
    facts = written(pool_facts(cards), "pool")  # worked out once for all rounds
    small = facts.count() <= SMALL_POOL
    rounds = []
    for attempt in range(1, max_rounds + 1):
        asked = _once(asked, f"{base}/asked-{attempt}")
        answers = _once(builder(asked).select("request_id", "attempt", "response"), f"{base}/answers-{attempt}")
        one = answers.groupBy("request_id").agg(F.max("response").alias("response"))
        known = asked.join(one, "request_id", "left").withColumn("response", F.coalesce("response", F.lit("")))
        found_at = f"{base}/found-{attempt}"
        if not is_whole(prompts.sparkSession, found_at):
            # Of a large pool, the names in the answers are a table of known size: where it is small it goes to every
            # task, and the answers stay where their request is.
            named = facts if small else written(named_facts(answers, facts), "named")
            judged = judge_by_facts(known.select("request_id", "attempt", "response"), named).drop("attempt")
            known = known.join(judged, "request_id")  # all of a round have the same attempt
            known.select("request_id", "attempt", "prompt", "response", "errors", "is_valid").write.mode("overwrite").parquet(found_at)
        found = prompts.sparkSession.read.schema(FOUND.format(id=prompts.schema["request_id"].dataType.simpleString())).parquet(found_at)
        rounds.append(found)
        still = found.where(~F.col("is_valid"))
        if attempt == max_rounds or still.isEmpty():
            return rounds
        asked = still.select("request_id", F.lit(attempt + 1).alias("attempt"), with_errors(F.col("prompt"), F.col("errors")).alias("prompt"))
    return rounds


def build_until_valid(
    prompts: DataFrame, cards: DataFrame, builder: Builder, max_rounds: int = MAX_ROUNDS, base: str | None = None
) -> DataFrame:
    """request_id, attempts, status, errors and response of every request: its first valid answer, or its last one.

    `prompts` holds (request_id, prompt) with unique ids. ``status`` is ``valid``, or ``exhausted`` where the last round's
    answer still breaks rules. No requests give no rows.
    """
    rounds = build_rounds(prompts, cards, builder, max_rounds, base)
    # A request is open in the next round exactly when its answer was not valid.
    ended = [r.where("is_valid") for r in rounds[:-1]] + rounds[-1:]
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    return out.select(
        "request_id", F.col("attempt").alias("attempts"), F.when(F.col("is_valid"), VALID).otherwise(EXHAUSTED).alias("status"), "errors", "response"
    )
