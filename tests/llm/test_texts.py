"""Classifiers, scores, near-duplicates and the pipeline."""

import math
import pickle
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from cardloom.llm import components, dart_minhash, languages, mixing, quality
from tests.llm.conftest import SCHEMA, sentence

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, k % 2, 0) for k in range(24)] + [(None, 1, 0), (3, None, 0), (999, 1, 0)]
    return spark.createDataFrame(rows, LABELS)


@pytest.fixture(scope="module")
def separable(spark):
    rows = [(k, (sentence(k, 40).upper().replace(" ", "!! ") if k % 2 else sentence(k, 40)), "de" if k % 3 else "en", "s", 1) for k in range(400)]
    rows = [(d, " ".join(w + "ung" for w in t.split()) if lang == "de" else t, lang, s, n) for d, t, lang, s, n in rows]
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs, spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(400)], LABELS)


def held(doc, parts, rest):
    return doc is not None and zlib.crc32(str(doc).encode()) % parts == rest


def test_quality_learns(separable):
    rows = quality.score_quality(*separable).collect()
    test = [r for r in rows if r.held_out]
    assert len(rows) == 400 and all(r.held_out == held(r.doc_id, 3, 1) for r in rows)
    assert np.mean([r.predicted == 1 - r.doc_id % 2 for r in test]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_quality_of_odd_rows(spark, documents, clashing, no_documents, labels):
    rows = quality.score_quality(clashing, labels).collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (103, 104, 105)}) == 1
    assert quality.score_quality(no_documents, labels).count() == 0
    unlabelled = quality.score_quality(documents, spark.createDataFrame([], LABELS)).collect()
    assert {r.score for r in unlabelled} == {0.5}


def test_held_out_labels_change_nothing(separable):
    docs, labels = separable
    turned = labels.withColumn("quality", F.expr("IF(crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1, 1 - quality, quality)"))
    first, second = ({r.doc_id: r.score for r in quality.score_quality(docs, x).collect()} for x in (labels, turned))
    assert first == second


def test_languages_learn(separable):
    rows = languages.predict_languages(separable[0]).collect()
    truth = {r.doc_id: r.lang for r in separable[0].collect()}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(documents, clashing, no_documents):
    rows = languages.predict_languages(clashing).collect()
    assert len(rows) == documents.count()
    assert {r.lang_pred for r in rows if r.doc_id in (103, 104, 105, 106)} == {"und"}
    assert {r.lang_pred for r in rows if r.doc_id in (107, 109)} <= {"en", "de"}
    assert languages.predict_languages(no_documents).count() == 0
    nothing = languages.predict_languages(documents.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_language_stage_judges_by_the_network(spark, separable):
    """Texts of letters that the network cannot place are rejected; clean ones stay, held-out ones too."""
    docs = separable[0].filter("doc_id % 2 = 0")
    mixed = [(9000 + k, " ".join(w + "ung" * (n % 2) for n, w in enumerate(sentence(k, 40).split())), None, "s", 1) for k in range(20)]
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs.unionByName(spark.createDataFrame(mixed, SCHEMA)), "").collect()}
    assert kept == {r.doc_id for r in docs.collect()}


def test_floor_is_set_by_all_training_documents(spark, separable, monkeypatch):
    """The floor is the exact quantile over every training document, however few the network is fitted on."""
    docs = separable[0]
    monkeypatch.setattr(languages, "SAMPLE", 60)
    net = languages.train(docs, judging=True)
    rows = [r for r in languages.with_language(docs, net).collect() if r.lang is not None and not held(r.doc_id, 3, 1)]
    scores = np.array([r.score for r in rows if r.score > 0])
    assert len(scores) > 200 and abs(net.floor - (1 / len(net.langs) + np.quantile(scores, 0.001)) / 2) < 1e-12
    drawn = [0.0, 1.0, 0.25, 0.25, 0.25 + 2**-54, 0.25 + 2**-52] + [0.5] * 40 + list(np.random.default_rng(3).random(400))
    frame = spark.createDataFrame([(float(x),) for x in drawn], "score double")
    assert [languages._at_rank(frame, k) for k in (0, 1, 100, 101, 102, 103, 250, 445)] == [sorted(drawn)[k] for k in (0, 1, 100, 101, 102, 103, 250, 445)]


def test_gradients_through_time():
    rng = np.random.default_rng(0)
    h = languages.HIDDEN
    shapes = [(256, 3 * h), (h, 3 * h), (256, 3 * h), (h, 3 * h), (2 * h, 3), (3,)]
    weights = [rng.normal(size=s) * 0.3 for s in shapes]
    x, lang = rng.integers(0, 256, (4, 5)), np.array([0, 2, 1, 2])

    def loss():
        probs = languages.label_positions(weights, x)[0]
        return -np.log(probs[:, np.arange(4), lang]).mean()

    grads = languages._gradients(weights, x, lang)
    for w, g in zip(weights, grads):
        spots = np.argwhere(np.abs(g) > 1e-6)
        for at in map(tuple, spots[rng.permutation(len(spots))[:6]]):
            kept = w[at]
            w[at] = kept + 1e-5
            up = loss()
            w[at] = kept - 1e-5
            down = loss()
            w[at] = kept
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_text_scores(documents, clashing, no_documents):
    rows = mixing.score_texts(clashing).collect()
    texts = [(r.doc_id, (r.text or "").encode().lower().split()) for r in documents.collect()]
    learned = [t for d, t in texts if d is not None and not held(d, 7, 2)]
    counts = {}
    for t in learned:
        for w in [*t, b"end"]:
            counts[w] = counts.get(w, 0) + 1
    counts_of = {**{k: v for k, v in counts.items() if k != b"end"}}
    total, distinct = sum(counts.values()), len(counts)
    expected = []
    for d, t in texts:
        c = [counts_of.get(w, 0) for w in t] + [len(learned)]
        expected.append((str(d), held(d, 7, 2), len(c), sum(x > 0 for x in c), total, round(sum(np.log10((x + 1) / (total + distinct + 1)) for x in c), 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(got) == sorted(expected)
    assert all(r.score < 0 for r in rows)
    assert mixing.score_texts(no_documents).count() == 0


def test_scores_are_probabilities():
    """At any place the probabilities of all next bytes add up to one, whatever the state of the tables."""
    rng = np.random.default_rng(1)
    counts = [rng.integers(0, 9, (size, 2)).astype(np.float32) for size in mixing.SLOTS]
    weights = rng.normal(size=(mixing.GATES * 8, len(mixing.ORDERS) + 1)).astype(np.float32) * 0.2
    refine = rng.uniform(0.05, 0.95, (mixing.GATES, mixing.CELLS)).astype(np.float32)
    model = mixing.Model(counts, weights, refine, 10, 0.0)
    known = mixing.events(["ab"])
    assert len(known.bit) == 24 and all(len(s) == 24 for s in known.slots)
    prefix = mixing.word_scores(model, ["a"], np.zeros(1))[0]  # 'a' and a space
    nexts = [bytes([b]) for b in range(128) if b not in b" "]
    inner = mixing.word_scores(model, [("a" + b.decode()) for b in nexts], np.zeros(len(nexts)))
    # P(a) = sum of P(a, next byte): the closing space's share of each is below one, so the sum stays below P(a).
    first = mixing.word_scores(model, ["a", "b", "c"], np.zeros(3))
    assert 10.0**prefix + (10.0**inner).sum() < 1 and (10.0**first).sum() < 1


def test_scores_by_a_plain_loop():
    """Bit by bit, byte by byte: stretched counts, weights by gate, the last table, the word's own share."""
    rng = np.random.default_rng(2)
    counts = [rng.integers(0, 200, (size, 2)).astype(np.float32) for size in mixing.SLOTS]
    weights = rng.normal(size=(mixing.GATES * 8, len(mixing.ORDERS) + 1)).astype(np.float32) * 0.3
    refine = rng.uniform(0.05, 0.95, (mixing.GATES, mixing.CELLS)).astype(np.float32)
    words, seen = ["a", "straße", "the", "x" * 40, mixing.END], np.array([0.0, 3, 70, 0, 5])
    got = mixing.word_scores(mixing.Model(counts, weights, refine, 100, 0.25), words, seen)
    for word, often, score in zip(words, seen, got):
        ev, total, k = mixing.events([word]), 0.0, 0
        for byte in word.encode() + (b"" if word == mixing.END else b" "):
            for place in range(8):
                bit = byte >> (7 - place) & 1
                pairs = [counts[o][ev.slots[o][k]] for o in range(len(mixing.ORDERS))]
                known = float(pairs[-1].sum())
                gate = sum(known > x for x in (0, 2, 8, 64))
                inputs = [math.log((float(n[1]) + mixing.PRIOR) / (float(n[0]) + mixing.PRIOR)) for n in pairs] + [0.3]
                odds = sum(float(w) * x for w, x in zip(weights[gate * 8 + place], inputs))
                at = min(max((odds + mixing.REACH) / (2 * mixing.REACH) * (mixing.CELLS - 1), 0), mixing.CELLS - 1.001)
                cell = int(at)
                table = float(refine[gate, cell]) * (1 - at + cell) + float(refine[gate, cell + 1]) * (at - cell)
                one = 0.5 / (1 + math.exp(-max(-20, min(20, odds)))) + 0.5 * table
                total += math.log10(min(max(one if bit else 1 - one, 1e-6), 1 - 1e-6))
                k += 1
        assert abs(score - math.log10(0.25 * often / 100 + 0.75 * 10**total)) < 1e-3 * max(1, abs(score) / 10)


def test_runs_over_words_add_up():
    """Learning lowers the cost of what was learned from, and rows of several runs give their weighed mean."""
    words = ["the", "there", "then", "other", "mother", "this", "that"] * 30
    distinct = sorted(set(words))
    times = np.full(len(distinct), 30.0)
    counts = [np.zeros((size, 2), np.float32) for size in mixing.SLOTS]
    ev = mixing.events(distinct)
    for table, slot in zip(counts, ev.slots):
        np.add.at(table, (slot, ev.bit), times[ev.word])
    found = mixing.learn(mixing.Stretched(counts, True), iter([(distinct, times)] * 40), len(words))
    rows = [tuple(r.values()) for r in mixing._learn_rows(found).to_pylist()]
    weights, refine, share = mixing.mixer_of(rows)
    assert np.allclose(weights[found.mass > 0], found.weights[found.mass > 0], atol=1e-6) and 0 <= share < 1
    before = mixing.mixer_of([])
    cost = [mixing.word_scores(mixing.Model(counts, *m, len(words), 0.0), distinct, times).sum() for m in (before[:2], (weights, refine))]
    assert cost[1] > cost[0]
    twice: dict = {}
    for kind, place, number, mass in rows + rows:
        a, b = twice.get((kind, place), (0.0, 0.0))
        twice[kind, place] = (a + number, b + mass)
    again = mixing.mixer_of([(k, p, a, b) for (k, p), (a, b) in twice.items()])
    assert np.allclose(again[0], weights, atol=1e-6) and again[2] == share


def test_scores_know_the_word_before(spark):
    """Words in their learned order are likelier than the same words in another; so are the order's first and last word."""
    ring = "stone river house winter garden letter music silver paper morning".split()
    text = " ".join(ring * 3)
    out = [k for k in range(100, 400) if held(k, 7, 2)][:2]
    rows = [(k, text, "en", "s", 1) for k in range(60)] + [(out[0], " ".join(ring), "en", "s", 1), (out[1], " ".join(ring[::-1]), "en", "s", 1)]
    found = {r.doc_id: r for r in mixing.score_texts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    first, turned = (found[k] for k in out)
    assert first.held_out and turned.held_out and abs(first.base_score - turned.base_score) < 1e-9
    assert first.score > turned.score + 5


def test_contexts_cross_the_blank():
    """The word before reaches the contexts of its follower, the whole of it only the one that takes both."""
    cat, hat, far = (mixing.events(["on"], [w]).slots for w in ("cat", "hat", "mcat"))
    alone = mixing.events(["on"]).slots
    differs = {o: (a != b).any() for o, a, b in zip(mixing.ORDERS, cat, hat)}
    assert differs == {0: False, 1: False, 2: False, 3: False, 4: True, mixing.BOTH: True, mixing.OWN: False}
    assert {o for o, a, b in zip(mixing.ORDERS, cat, far) if (a != b).any()} == {mixing.BOTH}
    assert {o for o, a, b in zip(mixing.ORDERS, cat, alone) if (a != b).any()} == {1, 2, 3, 4, mixing.BOTH}
    ev = mixing.events(["on", "x", mixing.END], ["", "cat", "on"])
    assert [a.tolist() for a in ev.slots] == [
        np.concatenate([mixing.events([w], [b]).slots[k] for w, b in (("on", ""), ("x", "cat"), (mixing.END, "on"))]).tolist() for k in range(len(mixing.ORDERS))
    ]


def test_held_out_texts_change_no_score(documents):
    changed = documents.withColumn("text", F.expr("IF(crc32(cast(cast(doc_id AS string) AS binary)) % 7 = 2, 'other', text)"))
    first, second = ({str(r.doc_id): (r.score, r.held_out) for r in mixing.score_texts(x).collect()} for x in (documents, changed))
    assert all(abs(first[d][0] - second[d][0]) < 1e-9 for d in first if not first[d][1])


def shingle_sets(documents):
    out = []
    for r in documents.collect():
        w = (r.text or "").replace("\n", " ").replace("\t", " ").lower().split(" ")
        w = [x for x in w if x]
        out.append((r.doc_id, r.text or "", {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    return out


def classes_by_force(rows, threshold=0.8):
    label = list(range(len(rows)))
    sets = [s for _, _, s in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    ids = {}
    for (d, _, _), c in zip(rows, label):
        ids.setdefault(c, []).append(d)
    least = {c: min((d for d in v if d is not None), default=None) for c, v in ids.items()}
    return [(d, least[c]) for (d, _, _), c in zip(rows, label)]


def test_near_documents(documents, clashing, no_documents):
    got = dart_minhash.classes(clashing).collect()
    expected = classes_by_force(shingle_sets(documents))
    assert sorted(str((r.doc_id, r.class_id)) for r in got) == sorted(map(str, expected))
    assert {(r.class_id, r.doc_id) for r in got if r.kept and r.doc_id is not None} == {(c, c) for _, c in expected if c is not None}
    dropped = {r.doc_id for r in got if not r.kept}
    assert {101, 102} <= dropped
    assert dart_minhash.classes(no_documents).count() == 0
    kept = dart_minhash.keep_one(documents)
    assert kept.columns == documents.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(d) for d, _ in expected if d not in dropped})
    assert kept.filter("doc_id IN (103, 104, 105)").count() == 3


@pytest.mark.parametrize("block", [256, 8])
def test_near_documents_in_blocks(spark, monkeypatch, block):
    """A star of near copies that are near their base only, and a chain; in one block and in many."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(300)]
    rows = [(1000, " ".join(base), "en", "s", 1)]
    for k in range(60):
        words = list(base)
        for at in rng.choice(290, 4, replace=False):
            words[at] = f"c{k}x{at}"
        rows.append((k, " ".join(words), "en", "s", 1))
    chain = [f"v{k}" for k in range(200)]
    for k in range(12):
        rows.append((2000 + k, " ".join(chain), "en", "s", 1))
        chain = [*chain[5:], *(f"y{k}z{j}" for j in range(5))]
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(dart_minhash, "BLOCK", block)
    monkeypatch.setattr(dart_minhash, "HUBS", 2)
    got = [(r.doc_id, r.class_id) for r in dart_minhash.classes(docs).collect()]
    assert sorted(got) == sorted(classes_by_force(shingle_sets(docs)))


def test_candidates_have_few_links(spark):
    """A group's links follow its nodes, however many of its nodes are hubs of bands; all nodes of a band stay together."""
    rng = np.random.default_rng(8)
    rows = [(f"g{g}n{n:03d}", 1000 * g + 50 * band + int(rng.integers(50))) for g in range(3) for n in range(200) for band in range(16)]
    rows += [("alone", -1), ("pair1", -2), ("pair2", -2)]
    links = [tuple(r) for r in dart_minhash.candidate_links(spark.createDataFrame(rows, "node string, band long")).collect()]
    hubs, near = {}, {}
    for node, band in rows:
        hubs[band] = min(node, hubs.get(band, node))
    for node, band in rows:
        near.setdefault(node, set()).add(hubs[band])
    plain = {(a, node) for node, found in near.items() for a in found if a != node}
    # One link a node, and hubs among each other.
    assert len(set(links)) == len(links) < len(plain) / 2
    parts = [components.components(spark.createDataFrame(sorted(x), "a string, b string")).collect() for x in (links, plain)]
    assert sorted(map(tuple, parts[0])) == sorted(map(tuple, parts[1])) and len(parts[0]) == 602


def test_near_documents_of_repeats(spark):
    """Sets of shingles decide links, however often a text repeats its passages."""
    rows = []
    for k in range(20):
        text = " ".join(f"p{k}q{j}" for j in range(100)) + " "
        rows += [(4 * k + n, text * times, "en", "s", 1) for n, times in enumerate((1, 2, 3, 10))]
    rows += [(1000, "word " * 5000, "en", "s", 1), (1001, "word " * 10, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [(r.doc_id, r.class_id) for r in dart_minhash.classes(docs).collect()]
    assert sorted(got) == sorted((d, 1000 if d >= 1000 else d // 4 * 4) for d, *_ in rows)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(6)
    errors = []
    for _ in range(20):
        a, b = rng.uniform(0, 3, (2, 150)) * (rng.random((2, 150)) < 0.7)
        element = dart_minhash.mix(np.arange(150, dtype=np.uint64))
        rows, cols = np.nonzero(np.stack([a, b]))
        found = dart_minhash.signatures(rows, element[cols], np.stack([a, b])[rows, cols], 2)
        errors.append((found[0] == found[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.04 and np.std(errors) < 0.12


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_draw_links_anew(spark, monkeypatch):
    """Rows written over all rounds follow the links, also where a group is a long chain in no order."""
    rng = np.random.default_rng(12)
    rows, plain = {"edges": 0}, components.written

    def counting(df, name):
        out = plain(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(components, "written", counting)
    places = rng.permutation(1500)
    links = [(int(places[k]), int(places[k + 1])) for k in range(1499)]
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == [(k, 0) for k in range(1500)]
    assert rows["edges"] < 3 * 2 * len(links)


def test_pipeline(spark, tmp_path, separable):
    docs, labels = separable
    docs = docs.unionByName(docs.filter("doc_id = 2").withColumn("doc_id", F.lit(5000).cast("long")))
    docs = docs.unionByName(spark.createDataFrame([(6000, "12 34", "en", "s", 1), (6001, None, "en", "s", 0)], SCHEMA))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    ids = {r.doc_id for r in kept.collect()}
    assert ids and 5000 not in ids and not ids & {6000, 6001}
    assert np.mean([d % 2 == 0 for d in ids]) > 0.95
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == ids and sum(r.length for r in rows if r.start == 0) > 0


def test_pipeline_on_empty_tables(spark, tmp_path, no_documents):
    no_documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_counts_are_sent_once_and_compressed(spark, monkeypatch):
    sent = []
    send = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(len(pickle.dumps(value))) or send(value))
    rows = [(k, sentence(k, 30), "en", "s", 1) for k in range(40)]
    found = mixing.score_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 40 and all(r.score < 0 for r in found)
    # Uncompressed the tables take 55 MB.
    assert 0 < sum(sent) < 5_000_000


def test_tables_come_back_from_their_chunks():
    part = np.arange(2 * mixing.CHUNK, dtype="<f4").reshape(2, -1)
    tables = mixing._tables([(3, 2 * mixing.CHUNK, zstandard.ZstdCompressor().compress(part.tobytes()))])
    assert [len(x) for x in tables] == list(mixing.SLOTS) and all(not x.any() for k, x in enumerate(tables) if k != 3)
    assert (tables[3][2 * mixing.CHUNK : 3 * mixing.CHUNK] == part.T).all() and not tables[3][: 2 * mixing.CHUNK].any()
