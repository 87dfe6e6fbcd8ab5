"""Tables around an external deck-building model: prompts, parsed answers, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom import schemas
from cardloom.functions.columns import no_strings
from cardloom.functions.constants import DEFAULT_POWER_LEVEL, STRONGEST
from cardloom.operators.collection import first_named
from cardloom.operators.validate import card_facts, deck_errors, deck_facts
from cardloom.session import written

RULES = [
    "Exactly 100 cards including one commander.",
    "The commander is a legendary creature.",
    "Every card stays within the commander's color identity.",
    "One copy of each card except basic lands.",
]
MAX_ROUNDS = 3
# Facts of cards are sent to every task up to this size; a card takes so many bytes besides its line.
SENT_BYTES, FACT_BYTES = 64 << 20, 40


def with_request_defaults(requests: DataFrame) -> DataFrame:
    """Requests that leave power level or preference open get the usual ones."""
    return requests.withColumn(
        "power_level", F.coalesce("power_level", F.lit(DEFAULT_POWER_LEVEL))
    ).withColumn("collection_preference", F.coalesce("collection_preference", F.lit(STRONGEST)))


def _lines(name: str) -> Column:
    """Collected (rank, line) pairs as one text block in rank order."""
    ordered = F.transform(F.sort_array(F.collect_list(name)), lambda x: x["line"])
    return F.array_join(ordered, "\n")


def _facts(cards: DataFrame) -> DataFrame:
    return cards.select(F.col("id").alias("card_id"), "ordinal", F.concat(F.lit("- "), "name", F.lit(" | "), "type_line").alias("line"))


def build_prompts(requests: DataFrame, context: DataFrame, candidates: DataFrame, cards: DataFrame, offerable: DataFrame | None = None) -> DataFrame:
    """One prompt per request.

    ``context`` is (request_id, card_id); ``candidates`` is (request_id, rank,
    card_id) and never exceeds the candidate limit per request. `offerable` are the ids of all cards that candidates may
    be, where they are known: the facts of few such cards go to every task, and candidates that lie by request are
    listed where they lie, so that neither they nor their lines are exchanged.
    """
    facts = _facts(cards)
    if offerable is not None:
        few = written(facts.join(offerable.select("card_id"), "card_id", "left_semi").select("card_id", "line"), "offerable")
        size = few.agg(F.sum(F.octet_length("line") + FACT_BYTES)).first()[0] or 0
        if size <= SENT_BYTES:
            offered = candidates.select("request_id", "rank", "card_id").join(F.broadcast(few), "card_id")
            offered = offered.withColumn("_offered", F.struct(F.col("rank").cast("bigint").alias("rank"), "line"))
            chosen = context.select("request_id", "card_id").join(facts, "card_id")
            chosen = chosen.withColumn("_chosen", F.struct(F.col("ordinal").cast("bigint").alias("rank"), "line"))
            listed = [rows.groupBy("request_id").agg(_lines(f"_{name}").alias(name)) for name, rows in (("chosen", chosen), ("offered", offered))]
            return _texts(requests, *listed)
    chosen = context.select("request_id", F.lit("chosen").alias("part"), F.lit(None).cast("bigint").alias("rank"), "card_id")
    offered = candidates.select("request_id", F.lit("offered").alias("part"), F.col("rank").cast("bigint").alias("rank"), "card_id")
    place = F.when(F.col("part") == "chosen", F.col("ordinal").cast("bigint")).otherwise(F.col("rank")).alias("rank")
    # Both lists meet the cards at once.
    listed = chosen.unionByName(offered).join(facts, "card_id").select("request_id", "part", place, "line")
    blocks = (
        listed.withColumn("_chosen", F.when(F.col("part") == "chosen", F.struct("rank", "line")))
        .withColumn("_offered", F.when(F.col("part") == "offered", F.struct("rank", "line")))
        .groupBy("request_id")
        .agg(_lines("_chosen").alias("chosen"), _lines("_offered").alias("offered"))
    )
    return _texts(requests, blocks)


def _texts(requests: DataFrame, *blocks: DataFrame) -> DataFrame:
    """The prompts from the blocks of lines of each request."""
    rules = "\n".join(f"- {rule}" for rule in RULES)
    prompt = F.concat_ws(
        "\n\n",
        F.lit("Build a deck around the selected cards."),
        F.concat(F.lit("Power level: "), "power_level"),
        F.concat(F.lit("Collection preference: "), "collection_preference"),
        F.when(F.col("chosen") != "", F.concat(F.lit("Selected cards:\n"), "chosen")),
        F.when(F.col("offered") != "", F.concat(F.lit("Candidate cards:\n"), "offered")),
        F.lit(f"Rules:\n{rules}"),
    )
    whole = with_request_defaults(requests)
    for rows in blocks:
        whole = whole.join(rows, "request_id", "left")
    return whole.select("request_id", prompt.alias("prompt"))


def parse_responses(responses: DataFrame) -> DataFrame:
    """(request_id, attempt, response) -> commander, cards and explanation per answer.

    ``readable`` is false for text that is no deck; its fields are NULL.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = responses.withColumn("_r", F.from_json("response", schemas.DECK_RESPONSE_JSON, options))
    readable = F.col("_r").isNotNull() & F.col("_r._corrupt").isNull() & F.col("_r.cards").isNotNull()
    return parsed.select(
        "request_id",
        "attempt",
        readable.alias("readable"),
        *[F.when(readable, F.col(f"_r.{name}")).alias(name) for name in ("commander", "cards", "explanation")],
    )


def pool_facts(cards: DataFrame) -> DataFrame:
    """What the rules need to know of each name: of several cards of one name the first of the pool is meant."""
    return card_facts(first_named(cards.select("id", "oracle_id", "name", "type_line", "ci_mask", "ordinal")))


def named_facts(responses: DataFrame, facts: DataFrame) -> DataFrame:
    """The facts of the names that the answers hold; all that judging these answers needs."""
    names = F.concat(F.coalesce(F.col("cards")["name"], no_strings()), F.array("commander"))
    return facts.join(parse_responses(responses).select(F.explode(names).alias("card_name")).distinct(), "card_name", "left_semi")


def judge_responses(responses: DataFrame, cards: DataFrame) -> DataFrame:
    """request_id, attempt, is_valid and errors for every answer, readable or not.

    Every text is parsed once. Cards with unknown names count towards the size and
    are reported as such; of several cards of one name the first of the pool is meant.
    """
    return judge_by_facts(responses, pool_facts(cards))


def judge_by_facts(responses: DataFrame, facts: DataFrame) -> DataFrame:
    """`judge_responses` from the facts of the names."""
    deck = ["request_id", "attempt", "readable", "commander"]
    listed = parse_responses(responses).select(*deck, F.inline_outer("cards"))
    rows = (
        listed.withColumn("quantity", F.when(F.col("name").isNotNull(), F.coalesce("quantity", F.lit(1))))
        .withColumnRenamed("name", "listed")
        .join(facts.drop("can_lead", "card_id"), F.col("listed") == F.col("card_name"), "left")
    )
    leaders = facts.select(F.col("card_name").alias("commander"), "can_lead", F.col("ci_mask").alias("leader_mask"))
    led = F.col("commander").isNotNull()
    whole = deck_facts(rows, deck).join(leaders, "commander", "left").select(
        "request_id",
        "attempt",
        "readable",
        "unknown",
        (F.coalesce("copies", F.lit(0)) + led.cast("int")).cast("bigint").alias("deck_size"),
        led.alias("has_commander"),
        "can_lead",
        "leader_mask",
        "mask",
        "repeated",
    )
    note = F.when(F.col("unknown") > 0, F.concat(F.col("unknown").cast("string"), F.lit(" unknown card names")))
    errors = F.when(
        F.col("readable"), F.concat_ws("; ", deck_errors(whole), note)
    ).otherwise(F.lit("answer is not readable"))
    return whole.select("request_id", "attempt", errors.alias("errors")).withColumn("is_valid", F.col("errors") == "")


def retry_table(judged: DataFrame, prompts: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Every invalid answer with its errors: to be asked again, or out of rounds.

    ``status`` is ``retry`` with the next attempt's number and prompt, or ``exhausted``
    with neither once `max_rounds` attempts have been made.
    """
    again = F.col("attempt") < max_rounds
    text = F.concat(
        "prompt", F.lit("\n\nThe previous deck broke these rules:\n- "), F.replace(F.col("errors"), F.lit("; "), F.lit("\n- "))
    )
    return judged.where(~F.col("is_valid")).join(prompts, "request_id", "left").select(
        "request_id",
        F.col("attempt").alias("failed_attempt"),
        F.when(again, F.lit("retry")).otherwise(F.lit("exhausted")).alias("status"),
        "errors",
        F.when(again, F.col("attempt") + 1).alias("attempt"),
        F.when(again, text).alias("prompt"),
    )


def split_result(generated: DataFrame, listed: DataFrame, collection: DataFrame) -> DataFrame:
    """Display rows of a generated deck: each card as owned or missing, missing as proxy."""
    owners = generated.select("request_id", "user_id")
    have = collection.select("user_id", "card_id", F.col("quantity").alias("_have"))
    owned = F.coalesce("_have", F.lit(0)) > 0
    return (
        listed.join(owners, "request_id")
        .join(have, ["user_id", "card_id"], "left")
        .select("request_id", "section", "card_id", "quantity", owned.alias("owned"), (~owned).alias("proxy"))
    )
