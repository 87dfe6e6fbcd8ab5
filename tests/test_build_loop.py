"""The loop around an external deck builder against a plain loop."""

import json

import pytest
from pyspark.sql import functions as F

from cardloom.plans import build_loop
from cardloom.plans.prompts import named_facts, pool_facts


@pytest.fixture(scope="module")
def pool(make_cards):
    rows = [("L", "Lead", "Legendary Creature", "W"), ("B", "Plains", "Basic Land", "W"), ("R", "Red", "Creature", "R")]
    return make_cards(rows + [(f"s{k}", f"Spell {k}", "Instant", "W") for k in range(5)])


def deck(basics=99, extra=(), leader="Lead"):
    return json.dumps({"commander": leader, "cards": [{"name": "Plains", "quantity": basics}, *({"name": n, "quantity": q} for n, q in extra)]})


# Answers of each request, attempt by attempt; the last one is repeated.
ANSWERS = {
    "good": [deck()], "second": [deck(98), deck()], "third": ["{", deck(97, [("Red", 2)]), deck()], "never": [deck(12)],
    "silent": [None, deck()], "lost": [deck(98, [("nobody", 1)]), deck(98, [("Spell 1", 1)])],
}


def answer(batch):
    return [ANSWERS[i][min(a, len(ANSWERS[i])) - 1] for i, a in zip(batch["request_id"], batch["attempt"])]


def test_loop(spark, pool, rows_of):
    prompts = spark.createDataFrame([(i, f"Build {i}") for i in ANSWERS], "request_id string, prompt string").repartition(3)
    rounds = build_loop.build_rounds(prompts, pool, build_loop.in_batches(answer))
    assert [sorted(r.request_id for r in x.collect()) for x in rounds] == [
        sorted(ANSWERS), ["lost", "never", "second", "silent", "third"], ["never", "third"],
    ]
    third = rounds[2].where("request_id = 'third'").first()
    assert third.prompt == (
        "Build third\n\nThe previous deck broke these rules:\n- answer is not readable\n\nThe previous deck broke these rules:\n"
        "- cards outside the commander's color identity\n- 1 cards exceed 1 copy"
    )
    got = rows_of(build_loop.build_until_valid(prompts, pool, build_loop.in_batches(answer, tasks=2)), "request_id", "attempts", "status", "errors")
    assert got == sorted([
        ("good", 1, "valid", ""), ("second", 2, "valid", ""), ("third", 3, "valid", ""), ("silent", 2, "valid", ""), ("lost", 2, "valid", ""),
        ("never", 3, "exhausted", "expected 100 cards, found 13"),
    ], key=str)


def test_loop_with_a_large_pool(spark, pool, rows_of, monkeypatch):
    """Judging by the names in the answers gives what the whole pool gives; names that nobody wrote are left out."""
    prompts = spark.createDataFrame([(i, f"Build {i}") for i in ANSWERS], "request_id string, prompt string")
    columns = ("request_id", "attempts", "status", "errors")
    small = rows_of(build_loop.build_until_valid(prompts, pool, build_loop.in_batches(answer)), *columns)
    monkeypatch.setattr(build_loop, "SMALL_POOL", 0)
    assert rows_of(build_loop.build_until_valid(prompts, pool, build_loop.in_batches(answer)), *columns) == small
    answers = spark.createDataFrame([(i, 1, a) for i, texts in ANSWERS.items() for a in texts], "request_id string, attempt int, response string")
    named = named_facts(answers, pool_facts(pool))
    assert rows_of(named, "card_name") == [("Lead",), ("Plains",), ("Red",), ("Spell 1",)]


def test_loop_goes_on_where_it_stopped(spark, pool, tmp_path):
    prompts = spark.createDataFrame([("second", "x"), ("third", "y")], "request_id string, prompt string")
    log = tmp_path / "asked"
    log.mkdir()

    def noted(batch):
        for i, a in zip(batch["request_id"], batch["attempt"]):
            with open(log / f"{i}-{a}", "a") as file:
                file.write("x")
        return answer(batch)

    base = str(tmp_path / "loop")
    assert len(build_loop.build_rounds(prompts, pool, build_loop.in_batches(noted), max_rounds=2, base=base)) == 2
    done = build_loop.build_until_valid(prompts, pool, build_loop.in_batches(noted), max_rounds=3, base=base)
    assert {r.request_id: r.attempts for r in done.collect()} == {"second": 2, "third": 3}
    assert {p.name: p.read_text() for p in log.iterdir()} == {"second-1": "x", "third-1": "x", "second-2": "x", "third-2": "x", "third-3": "x"}


def test_loop_with_an_odd_builder(spark, pool):
    """No requests, answers that are missing, and several answers to one request."""
    none = spark.createDataFrame([], "request_id string, prompt string")
    assert build_loop.build_until_valid(none, pool, build_loop.in_batches(answer)).count() == 0
    prompts = spark.createDataFrame([("a", "x"), ("b", "y")], "request_id string, prompt string")
    partial = build_loop.build_until_valid(
        prompts, pool, lambda asked: asked.where("request_id = 'a'").select("request_id", "attempt", F.explode(F.array(F.lit(deck()), F.lit(deck()))).alias("response")), max_rounds=2
    )
    assert {(r.request_id, r.attempts, r.status) for r in partial.collect()} == {("a", 1, "valid"), ("b", 2, "exhausted")}
