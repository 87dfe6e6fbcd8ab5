import random

import numpy as np
import pytest

from cardloom import session
from cardloom.operators import nearest
from cardloom.operators.nearest import vector_topk
from cardloom.plans import knowledge, prompts, retrieve
from cardloom.registry import QUERIES
from cardloom.sources import vector_store
from pyspark.sql import functions as F


def brute(queries, vectors, k):
    ids = sorted(vectors)
    matrix = np.array([vectors[i] for i in ids], dtype=float)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    out = {}
    for q, v in queries.items():
        scores = np.round(matrix @ (np.array(v) / np.linalg.norm(v)), 6)
        order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
        out[q] = [(ids[i], float(scores[i])) for i in order]
    return out


@pytest.mark.parametrize("spread,k,block,batch", [(0.05, 5, 100, 16), (2.0, 7, 4000, 1000), (0.01, 40, 64, 10), (0.3, 500, 150, 64)])
def test_topk_equals_brute_force(spark, spread, k, block, batch):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(5, 6))
    # one cluster holds most rows, a third of it exact copies
    which = np.where(rng.random(400) < 0.6, 0, rng.integers(0, 5, 400))
    points = centers[which] + spread * rng.normal(size=(400, 6))
    points[:80] = points[0]
    vectors = {i: [float(np.float32(x)) for x in p] for i, p in enumerate(points)}
    vectors[999] = [0.0] * 6
    queries = {f"q{j}": [float(x) for x in centers[j % 5] + spread * rng.normal(size=6)] for j in range(30)}
    qdf = spark.createDataFrame(list(queries.items()) + [("zero", [0.0] * 6)], "request_id string, vector array<double>")
    vdf = spark.createDataFrame(list(vectors.items()), "card_id bigint, embedding array<float>")
    got = {}
    for r in vector_topk(qdf, vdf, k, block, batch).orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append((r["card_id"], r["score"]))
    del vectors[999]
    assert got == brute(queries, vectors, k)


def test_topk_without_vectors(spark):
    q = spark.createDataFrame([("q", [1.0])], "request_id string, vector array<double>")
    v = spark.createDataFrame([], "card_id bigint, embedding array<float>")
    assert vector_topk(q, v).count() == 0


def test_synergistic_equals_brute_force(spark):
    rng = random.Random(4)
    tags = "abcdefgh"
    cards = [(i, i, rng.sample(tags, rng.choice([0, 1, 2, 3]))) for i in range(200)]
    asks = [(j, rng.sample(tags + "z", rng.choice([0, 1, 3, 5]))) for j in range(25)]
    cdf = spark.createDataFrame(cards, "id bigint, ordinal bigint, tags array<string>")
    qdf = spark.createDataFrame(asks, "request_id bigint, mechanics array<string>")
    for k in (3, 30, 10, 5):
        got = {}
        for r in retrieve.synergistic_cards(qdf, cdf, k).orderBy("request_id", "rank").collect():
            got.setdefault(r["request_id"], []).append(r["card_id"])
        for j, wanted in asks:
            scored = [(-len(set(wanted) & set(t)), i) for i, _, t in cards if set(wanted) & set(t)]
            assert got.get(j, []) == [i for _, i in sorted(scored)[:k]]


def test_knowledge_documents_and_embeddings(spark, make_cards):
    cards = make_cards([("1", "Alpha", "Instant", "W"), ("2", "Beta", "Instant", "U")])
    cards = cards.withColumn("oracle_text", F.when(F.col("id") == "1", "Draw a card.").otherwise(""))
    meta = spark.createDataFrame(
        [("1", "Short.", ["Ramp", "Fixing"], [], ["Fast"], None)],
        "card_id string, summary string, roles array<string>, themes array<string>, strengths array<string>, weaknesses array<string>",
    )
    docs = {r["card_id"]: r["document"] for r in knowledge.build_documents(cards, meta).collect()}
    assert docs["1"] == "Card:\n\nAlpha\n\nSummary:\n\nShort.\n\nRoles:\n\nRamp\nFixing\n\nStrengths:\n\nFast\n\nOracle Text:\n\nDraw a card."
    assert docs["2"] == "Card:\n\nBeta"
    built = knowledge.build_documents(cards, meta)
    tfidf = {r["card_id"]: r["embedding"] for r in knowledge.embed_documents(built, features=64).collect()}
    assert abs(np.linalg.norm(tfidf["1"]) - 1) < 1e-5 and len(tfidf["2"]) == 64
    own = knowledge.embed_documents(built, encoder=lambda texts: [[len(t), 1.0] for t in texts])
    assert {r["card_id"]: r["embedding"] for r in own.collect()}["2"] == [float(len(docs["2"])), 1.0]
    record = knowledge.vector_records(own, cards, meta).where("meta.name = 'Alpha'").first()
    assert record["meta"]["roles"] == ["Ramp", "Fixing"] and record["meta"]["colors"] == ["W"]


def test_metadata_answers(spark, rows_of):
    answers = [
        ("1", '{"roles":["Ramp"],"game_stage":"Early","power_rating":3}'),
        ("2", '{"roles":["Ramp"],"game_stage":"Never","power_rating":3}'),
        ("3", '{"roles":[],"game_stage":"Early","power_rating":3}'),
        ("4", '{"roles":["Ramp"],"game_stage":"Late","power_rating":30}'),
        ("5", '{"roles":["Ramp"'),
        ("6", None),
        ("7", '{"roles":["Ramp"],"game_stage":"Late","power_rating":"high"}'),
    ]
    good, bad = knowledge.ingest_metadata(spark.createDataFrame(answers, "card_id string, response string"), max_rating=10)
    assert rows_of(good, "card_id", "themes") == [("1", [])]
    assert rows_of(bad, "card_id", "reason") == [
        ("2", "game stage"), ("3", "no roles"), ("4", "power rating"), ("5", "malformed"), ("6", "malformed"), ("7", "malformed"),
    ]


def test_answers_retries_and_prompts(spark, make_cards, rows_of):
    cards = make_cards([("l", "Lead", "Legendary Creature", "WU"), ("i", "Isle", "Basic Land", "U"), ("x", "Spell", "Instant", "W")])
    answers = [
        ("ok", 1, '{"commander":"Lead","cards":[{"name":"Isle","quantity":98},{"name":"Spell","quantity":1}]}'),
        ("few", 1, '{"commander":"Lead","cards":[{"name":"Isle","quantity":9},{"name":"Bogus","quantity":2}]}'),
        ("torn", 2, '{"commander":"Lead","cards":[{"na'),
        ("last", 3, "{}"),
    ]
    judged = prompts.judge_responses(spark.createDataFrame(answers, "request_id string, attempt int, response string"), cards)
    assert rows_of(judged, "request_id", "is_valid", "errors") == [
        ("few", False, "expected 100 cards, found 12; 1 unknown card names"),
        ("last", False, "answer is not readable"),
        ("ok", True, ""),
        ("torn", False, "answer is not readable"),
    ]
    requests = spark.createDataFrame(
        [("few", "u", None, None), ("torn", "u", "Casual", "Prefer cards I own")],
        "request_id string, user_id string, power_level string, collection_preference string",
    )
    context = spark.createDataFrame([("few", "x")], "request_id string, card_id string")
    offered = spark.createDataFrame([("few", 2, "l"), ("few", 1, "i")], "request_id string, rank int, card_id string")
    asked = prompts.build_prompts(requests, context, offered, cards)
    text = {r["request_id"]: r["prompt"] for r in asked.collect()}
    assert "Power level: Focused\n\nCollection preference: Build strongest possible deck\n\nSelected cards:\n- Spell | Instant" in text["few"]
    assert "Candidate cards:\n- Isle | Basic Land\n- Lead | Legendary Creature\n\nRules:" in text["few"]
    assert "Selected cards" not in text["torn"]
    again = rows_of(prompts.retry_table(judged, asked), "request_id", "failed_attempt", "status", "attempt", "prompt")
    assert [r[:4] for r in again] == [("few", 1, "retry", 2), ("last", 3, "exhausted", None), ("torn", 2, "retry", 3)]
    assert again[1][4] is None and again[0][4].endswith("broke these rules:\n- expected 100 cards, found 12\n- 1 unknown card names")


def test_upgrades_skip_the_deck(spark, rows_of):
    found = spark.createDataFrame([("r", "a", 0.9), ("r", "b", 0.8), ("r", "c", 0.7)], "request_id string, card_id string, score double")
    deck = spark.createDataFrame([("r", "a")], "request_id string, card_id string")
    requests = spark.createDataFrame([("r", "u")], "request_id string, user_id string")
    owned = spark.createDataFrame([("u", "c", 1), ("u", "b", 0)], "user_id string, card_id string, quantity int")
    got = rows_of(retrieve.upgrade_suggestions(found, deck, requests, owned, 2), "rank", "card_id", "owned")
    assert got == [(1, "b", False), (2, "c", True)]


def test_records_embed_only_what_is_new(spark, tmp_path):
    base = str(tmp_path / "store")
    facts = [("a", "A", ["W"], 1.0), ("b", "B", [], 2.0), ("c", "C", None, 3.0), ("d", "D", [], 4.0)]
    cards = spark.createDataFrame(facts, "id string, name string, colors array<string>, mana_value double")
    meta = spark.createDataFrame([("a", ["Ramp"], None)], "card_id string, roles array<string>, themes array<string>")

    def run(texts, **more):
        docs = spark.createDataFrame(list(texts.items()), "card_id string, document string")
        changes = vector_store.update_records(docs, cards, meta, base, **more)
        rows = {r.card_id: r for r in vector_store.read_records(spark, base).collect()}
        return {r.card_id: r.change for r in changes.collect()}, rows

    first = {"a": "red dragon", "b": "blue bird bird", "c": "red bird"}
    changes, rows = run(first)
    assert changes == dict.fromkeys("abc", "new") and rows["a"].meta.roles == ["Ramp"] and rows["b"].meta.themes == []
    whole = {r.card_id: r.embedding for r in knowledge.embed_documents(spark.createDataFrame(list(first.items()), "card_id string, document string")).collect()}
    assert all(np.allclose(rows[k].embedding, whole[k]) for k in first)
    second = {"a": "red dragon", "b": "a fish", "d": "red red"}
    changes, later = run(second)
    assert changes == {"b": "changed", "c": "gone", "d": "new"} and set(later) == {"a", "b", "d"}
    assert later["a"].embedding == rows["a"].embedding  # not worked out again
    docs = spark.createDataFrame(list(second.items()), "card_id string, document string")
    counted = {r.slot: r.documents for r in vector_store.read_frequencies(spark, base).where(f"slot <> {vector_store.NOTE}").collect()}
    assert counted == {r.slot: r.documents for r in knowledge.document_frequencies(docs).collect()}
    fresh = {r.card_id: r.embedding for r in knowledge.embed_documents(docs).collect()}
    assert all(np.allclose(later[k].embedding, fresh[k]) for k in "bd")
    # A run that stopped after the counts counts nothing twice.
    third = {**second, "c": "blue fish"}
    docs = spark.createDataFrame(list(third.items()), "card_id string, document string")
    load, vector_store.stores.load_changed = vector_store.stores.load_changed, None
    try:
        with pytest.raises(TypeError):
            run(third)
    finally:
        vector_store.stores.load_changed = load
    assert run(third)[0] == {"c": "new"} and run(third)[0] == {}
    counted = {r.slot: r.documents for r in vector_store.read_frequencies(spark, base).where(f"slot <> {vector_store.NOTE}").collect()}
    assert counted == {r.slot: r.documents for r in knowledge.document_frequencies(docs).collect()}
    _, all_new = run(third, embed_all=True)
    fresh = {r.card_id: r.embedding for r in knowledge.embed_documents(docs).collect()}
    assert all(np.allclose(all_new[k].embedding, fresh[k]) for k in third)
    # A vector of one's own encoder.
    _, own = run({"a": "xyz"}, encoder=lambda texts: [[float(len(t))] for t in texts], embed_all=True)
    assert own["a"].embedding == [3.0]


def test_empty_documents_have_zero_vectors(spark):
    docs = spark.createDataFrame([("a", ""), ("b", " \n"), ("c", "x"), ("d", None)], "card_id string, document string")
    made = {r.card_id: r.embedding for r in knowledge.embed_documents(docs, features=8).collect()}
    assert made["a"] == made["b"] == made["d"] == [0.0] * 8 and abs(sum(made["c"]) - 1) < 1e-6


@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_cells_lose_nothing(spread):
    rng = np.random.default_rng(int(spread * 100))
    centres = rng.normal(size=(12, 8))

    def unit(n):
        x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 8)) * spread
        return x / np.linalg.norm(x, axis=1)[:, None]

    vectors, asks = unit(900), unit(70)
    vectors[500:520] = vectors[3]  # ties
    rows, scores, skipped = nearest.best_of(asks, vectors, 30, slice_rows=16, cell_rows=40)
    whole = np.round(asks @ vectors.T, nearest.DIGITS)
    best = np.argsort(-whole, axis=1, kind="stable")[:, :30]
    assert (rows == best).all() and (scores == np.take_along_axis(whole, best, 1)).all()
    assert skipped > 10_000 if spread < 1 else skipped >= 0
    rows, _, _ = nearest.best_of(asks, vectors[:7], 30)
    assert (np.sort(rows, axis=1) == np.arange(7)).all()


def test_record_filter(spark):
    rows = [("a", ("Red Bolt", ["R"], ["Removal"], None, 1.0)), ("b", ("Bolt", None, None, ["Fire"], 2.0)), ("c", ("Ring", ["W", "U"], ["Ramp", "Land"], ["Fire", "Ice"], None))]
    made = spark.createDataFrame(rows, "id string, meta struct<name:string,colors:array<string>,roles:array<string>,themes:array<string>,mana_value:double>")

    def ids(**wanted):
        return "".join(sorted(r.id for r in made.where(retrieve.record_filter(**wanted)).collect()))

    assert ids() == "abc" and ids(name="BOLT") == "ab" and ids(colors=["U", "R"]) == "ac" and ids(roles=["Land"]) == "c"
    assert ids(themes=["Fire"], max_mana=2) == "b" and ids(colors=[]) == "" and ids(name="o", colors=["R"], roles=["Removal"], max_mana=1) == "a"


def test_quarantine_has_ratings_above_the_scale(spark, tmp_path, rows_of):
    """Answers rated above 10 are set aside as well."""
    docs = [(0, "a", "en", "s", 5000), (1, "b", "en", "s", 5001), (2, "c", "en", "s", 9000), (3, "d", "en", "s", 10), (4, "e", "en", "s", 9000)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(4, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    found = rows_of(QUERIES["metadata_quarantine"](spark, str(tmp_path)), "card_id", "reason")
    assert found == [(1, "power rating"), (2, "power rating"), (3, "game stage"), (4, "malformed")]


def test_scores_below_the_kth_are_not_sorted(monkeypatch):
    sorted_in = []
    top = nearest._top
    monkeypatch.setattr(nearest, "_top", lambda rows, values, k: sorted_in.append(values.size) or top(rows, values, k))
    rng = np.random.default_rng(3)
    asks, vectors = (nearest.unit_rows(list(rng.normal(size=(n, 24)))) for n in (50, 3000))
    vectors[1500:1700] = vectors[:200]
    rows, scores, _ = nearest.best_of(asks, vectors, 10, slice_rows=20, cell_rows=100)
    whole = np.round(asks @ vectors.T, nearest.DIGITS)
    best = np.lexsort((np.broadcast_to(np.arange(3000), whole.shape), -whole), axis=1)[:, :10]
    assert (rows == best).all() and (scores == np.take_along_axis(whole, best, 1)).all()
    assert sum(sorted_in) < whole.size / 2


def test_candidates_are_dealt_by_request_once(spark):
    queries = spark.createDataFrame([(1, 1, ["t"], [1.0, 0.0]), (2, 1, ["t"], [0.0, 1.0])], "request_id long, mask int, mechanics array<string>, vector array<double>")
    cards = spark.createDataFrame(
        [(1, 1, 1, ["t"], "Ramp"), (2, 2, 1, ["u"], "Ramp"), (3, 3, 1, ["t"], "Utility")], "id long, ordinal long, ci_mask int, tags array<string>, primary_role string"
    )
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.6, 0.8])], "card_id long, embedding array<float>")
    found = retrieve.candidates(queries, cards, vectors)
    got = {(r.request_id, r.card_id): (r.score, r.kinds, r.rank) for r in found.collect()}
    assert got == {
        (1, 1): (1.0, "similar+supporting+synergistic", 1), (1, 3): (1.0, "similar+synergistic", 2), (1, 2): (0.5, "supporting", 3),
        (2, 1): (1.0, "similar+supporting+synergistic", 1), (2, 3): (1.0, "similar+synergistic", 2), (2, 2): (0.5, "supporting", 3),
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [request_id" in plan and "collect_set" not in plan


def test_words_are_counted_without_a_row_for_each(spark):
    rows = [(1, "a b  A\tc\x0bd\x0ce\rf\n"), (1, "a zz"), (2, None), (3, "   "), (None, "a q"), (4, "é É x\u2003y"), (5, "")]
    docs = spark.createDataFrame(rows, "card_id long, document string").repartition(3)
    lists = knowledge.term_lists(docs, 64)
    plan = lists._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and lists.where("card_id <> 1").groupBy("card_id").count().where("count > 1").isEmpty()
    made = knowledge.embed_documents(docs, features=64)
    norms = {(r.card_id, r.document): round(sum(x * x for x in r.embedding), 5) for r in made.collect()}
    assert len(norms) == 7
    assert {k: norms[k] for k in rows} == {k: 1.0 if k[0] in (1, 4) else 0.0 for k in rows}
    one = {tuple(r.embedding) for r in made.where("card_id = 1").collect()}
    assert len(one) == 1  # the words of both texts of the card
    counted = knowledge.document_frequencies(docs, 64)
    assert counted.where("slot = -1").first().documents == 7 and counted.where("slot >= 0").agg(F.max("documents")).first()[0] >= 2


@pytest.mark.parametrize("round_bytes,batch,block", [(1, 10, 30), (9000, 16, 30), (9000, 1000, 50), (1 << 20, 1000, 50)])
def test_topk_over_many_rounds(spark, monkeypatch, round_bytes, batch, block):
    """Blocks go round by round to all batches, in one lane or several; neither they nor the queries are exchanged for each other."""
    monkeypatch.setattr(nearest, "ROUND_BYTES", round_bytes)
    rng = np.random.default_rng(5)
    points = rng.normal(size=(300, 4)).astype(np.float32)
    points[100:140] = points[7]
    vectors = {f"c{i:03}": [float(x) for x in p] for i, p in enumerate(points)}
    queries = {j: [float(x) for x in rng.normal(size=4)] for j in range(40)}
    qdf = spark.createDataFrame(list(queries.items()), "request_id int, vector array<double>")
    vdf = spark.createDataFrame(list(vectors.items()), "card_id string, embedding array<float>").repartition(3)
    found = vector_topk(qdf, vdf, 25, block, batch)
    got = {}
    for r in found.orderBy("request_id", "rank").collect():
        got.setdefault(r.request_id, []).append((r.card_id, r.score))
    assert got == brute(queries, vectors, 25)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "hashpartitioning(block" not in plan and "MapInArrow" in plan


def test_vectors_of_other_lengths_are_refused(spark):
    q = spark.createDataFrame([("q", [1.0, 2.0])], "request_id string, vector array<double>")
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0, 4.0])], "card_id bigint, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="differ in length"):
        vector_topk(q, v).collect()


def test_records_in_waves(spark, tmp_path, monkeypatch):
    """Waves of buckets give the same records, and leave no texts behind but those of the store."""
    cards = spark.createDataFrame([(f"c{i}", f"C{i}", ["W"], 1.0) for i in range(60)], "id string, name string, colors array<string>, mana_value double")
    meta = spark.createDataFrame([("c1", ["Ramp"], None)], "card_id string, roles array<string>, themes array<string>")
    texts = [(f"c{i}", f"word{i % 7} bird " * (i + 1)) for i in range(50)]
    later = [(k, x + " more" if i % 3 else x) for i, (k, x) in enumerate(texts[5:])] + [("c55", "fish")]

    def run(base):
        changed = []
        for docs in (texts, later):
            given = spark.createDataFrame(docs, "card_id string, document string")
            changed.append(sorted(map(tuple, vector_store.update_records(given, cards, meta, base).collect())))
        return changed, sorted(map(str, vector_store.read_records(spark, base).collect()))

    whole = run(str(tmp_path / "whole"))
    monkeypatch.setattr(vector_store, "WAVE_BYTES", 300)
    monkeypatch.setattr(vector_store, "WAVES", 3)
    tables, plain = [], vector_store.written
    monkeypatch.setattr(vector_store, "written", lambda df, name: tables.append((name, plain(df, name))) or tables[-1][1])
    assert run(str(tmp_path / "waves")) == whole
    assert [name for name, _ in tables].count("differing") == 6
    assert {name for name, x in tables if session._WRITTEN.get(x)} == {"changes"}
    assert not (tmp_path / "waves" / "records-staged").exists() and not (tmp_path / "waves" / "records" / "_next").exists()


def test_prompts_list_candidates_where_they_lie(spark, rows_of, monkeypatch, make_cards):
    """With the cards that may be offered known and few, candidates are not exchanged for their lines; the prompts are the same."""
    cards = make_cards([("l", "Lead", "Legendary Creature", "WU"), ("i", "Isle", "Basic Land", "U"), ("x", "Spell", "Instant", "W"), ("y", None, "Instant", "W")])
    requests = spark.createDataFrame(
        [("a", None, None), ("b", "Casual", None), ("c", None, None), ("d", None, None)], "request_id string, power_level string, collection_preference string"
    )
    context = spark.createDataFrame([("a", "x"), ("a", "l"), ("b", "i")], "request_id string, card_id string")
    offered = spark.createDataFrame([("a", 2, "l"), ("a", 1, "i"), ("a", 3, "y"), ("c", 1, "x"), ("c", 2, "gone")], "request_id string, rank int, card_id string")
    offered = offered.repartition("request_id")
    offerable = spark.createDataFrame([("l",), ("i",), ("x",), ("y",), ("no",)], "card_id string")
    plain = rows_of(prompts.build_prompts(requests, context, offered, cards))
    made = prompts.build_prompts(requests, context, offered, cards, offerable)
    assert rows_of(made) == plain and "Candidate cards:\n- Isle | Basic Land\n- Lead" in plain[0][1]
    aggregate = made._jdf.queryExecution().optimizedPlan().toString().split("collect_list(_offered")[1]
    assert aggregate.index("BROADCAST" if "BROADCAST" in aggregate else "rightHint=(strategy=broadcast)") < aggregate.index("RepartitionByExpression")
    monkeypatch.setattr(prompts, "SENT_BYTES", 1)
    assert rows_of(prompts.build_prompts(requests, context, offered, cards, offerable)) == plain


def test_offerable_cards_hold_all_candidates(spark):
    queries = spark.createDataFrame([(i, 31, ["t", f"w{i % 4}"], [1.0, float(i)]) for i in range(6)], "request_id long, mask int, mechanics array<string>, vector array<double>")
    cards = spark.createDataFrame(
        [(i, i, i % 32, ["t", f"w{i % 5}"] if i % 7 else [], "Ramp" if i % 2 else "Utility") for i in range(90)],
        "id long, ordinal long, ci_mask int, tags array<string>, primary_role string",
    )
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(80, 90)], "card_id long, embedding array<float>")
    found = {r.card_id for r in retrieve.candidates(queries, cards, vectors, similar=4, synergistic=6, supporting=2).collect()}
    held = {r.card_id for r in retrieve.offerable(cards, vectors, 6, 2).collect()}
    assert found <= held and len(held) < 90
