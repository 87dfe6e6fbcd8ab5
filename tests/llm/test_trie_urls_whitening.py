"""Conversation trie, URL rules and whitening against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cardloom.llm import turn_trie, url_rules, whitening

TALK = "conv_id long, turn long, role string, text string"


# --- conversation trie ---------------------------------------------------------


def brute_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = (turn is not None, turn or 0, role.encode()[:64], text[:64], hashlib.md5(f"{len(role.encode())}:{role}:{text}".encode()).digest())
            own.setdefault(conv, []).append((key, (role, text)))
    own = {c: [x for _, x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    children = {}
    for path in nodes:
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    leaves, saved = {}, {}
    for path, convs in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] = leaves.get(path[:d], 0) + (path not in children)
            saved[path[:d]] = saved.get(path[:d], 0) + (len(convs) - 1) * (len(path[-1][1]) if path else 0)
    for path, convs in nodes.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(path))
        out.append((
            min(convs), len(path), min(nodes[path[:-1]]) if path else None, len(convs), children.get(path, 0),
            leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(map(str, out))


def talks(seed, convs=260, words=3):
    pick = random.Random(seed)
    rows = []
    for c in range(-30, convs):
        for t in range(pick.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, t, pick.choice(["user", "assistant"]) if t else "user", "é" * pick.randrange(words) + "x" * (t % 2)))
    rows += [(1000, None, None, None), (1000, 3, "user", "a"), (1000, 3, "user", "a"), (1000, 3, "bot", "b"), (None, 0, "user", "lost"), (1005, 2, None, ""), (77777, 0, "user", "w" * 300_000)]
    rows += [(2000, t, "user", f"turn {t % 7}") for t in range(400)] + [(2001, t, "user", f"turn {t % 7}") for t in range(390)]
    rows += [(c, t, "user", "same") for c in range(3000, 3150) for t in range(6)]
    return rows


def test_trie(spark):
    rows = talks(1)
    made = spark.createDataFrame(rows, TALK).repartition(5)
    clashing = made.selectExpr("*", "1 AS conv", "2 AS depth", "'x' AS parent", "3 AS i", "4 AS place", "5 AS name", "6 AS kind")
    got = sorted(str(tuple(r)) for r in turn_trie.conversation_trie(clashing).collect())
    assert got == brute_trie(rows)


@pytest.mark.parametrize("nodes", [1, 7, 40])
def test_trie_in_many_shards(spark, nodes):
    rows = talks(2, 60, 2)
    got = sorted(str(tuple(r)) for r in turn_trie.conversation_trie(spark.createDataFrame(rows, TALK).repartition(5), shard_nodes=nodes).collect())
    assert got == brute_trie(rows)


def test_trie_in_many_parts(spark):
    """One conversation and one node spread over many parts."""
    rows = [(5, t, "user", f"t{t}") for t in range(600)] + [(c, 0, "user", "hi") for c in range(100, 700)]
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(str(tuple(r)) for r in turn_trie.conversation_trie(spark.createDataFrame(rows, TALK), shard_nodes=50).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_trie(rows)


def test_no_talks(spark):
    assert turn_trie.conversation_trie(spark.createDataFrame([], TALK)).count() == 0
    assert turn_trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], TALK)).count() == 0
    turnless = turn_trie.conversation_trie(spark.createDataFrame([(3, 1, "user", "x")], TALK)).collect()
    assert [tuple(r) for r in turnless] == [(3, 0, None, 1, 0, 1, 0, hashlib.sha256(b"3").hexdigest())]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=1, max_size=400), st.integers(-1, 5))
def test_find_close(steps, after):
    depth = [0]
    for s in steps:  # a preorder: at most one deeper than before
        depth.append(min(depth[-1] + 1, s % 12 + 1))
    tree = turn_trie.Parentheses(np.array(depth), after)
    close, bits, leaves = tree.find_close(), tree.open_here, tree.leaf_ranks()
    for k, at in enumerate(tree.opens.tolist()):
        level, end = 0, -1
        for j in range(at, len(bits)):
            level += 1 if bits[j] else -1
            if level == 0:
                end = j
                break
        assert close[k] == end
        if end >= 0:
            assert leaves[end] - leaves[at] == sum(bits[j] and not bits[j + 1] for j in range(at, end))


# --- URL rules -------------------------------------------------------------------

RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/private", "block"), ("a.example.net", "", "allow"),
    ("org", "/fr/", "allow"), ("org", "/fr", "block"), ("example.org", "/", "allow"), ("twice.com", "/", "allow"), ("twice.com", "/", "block"),
    ("com", "//x/", "block"), ("x.y.z", "/a/b/c/", "block"), ("z", "/a/b/c/d/e", "allow"),
]
URLS = [
    None, "", "no scheme", "http://", "http://NET", "https://a.Example.NET/en/page?x=/fr/", "x://example.net/en", "x://example.net/en/privateer/1",
    "x://a.example.net", "x://a.example.net/en/private", "x://b.a.example.net/en/z#q", "http://q.org/fr/a", "http://q.org/french", "http://example.org/fr/",
    "http://twice.com/", "http://twice.com", "http://m.com//x/y", "http://x.y.z/a/b/c/d/efg", "http://x.y.z/a/b/c/", "http://anet/", "http://net:80/",
    "http://user@net/", "http://h://net/", "x://net?://org/fr/", "x://.net/", "x://net./", "http://É.NET/\n/a", "x://" + "a." * 3000 + "net/" + "p/" * 3000,
]


def brute_rule(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0] if cut < len(rest) else ""
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if not fits:
        return host, path, None, default
    best = max(fits, key=lambda r: (r[0].count(".") + 1 + r[1].count("/"), r[0].count("."), len(r[1].split("/")[-1]), r[2]))
    return host, path, best[0] + best[1], best[2]


@pytest.mark.parametrize("chars", [url_rules.TRIE_CHARS, 0])
def test_url_rules(spark, chars):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(None, URLS[5]), (3, URLS[3])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS path", "1 AS rule", "2 AS verdict").repartition(3)
    got = sorted(str(tuple(r)) for r in url_rules.judge_urls(pages, RULES, trie_chars=chars).collect())
    assert got == sorted(str((k, *brute_rule(u, RULES))) for k, u in rows)
    assert {r.verdict for r in url_rules.judge_urls(pages, [], "block", trie_chars=chars).collect()} == {"block"}
    assert url_rules.judge_urls(pages.limit(0), RULES, trie_chars=chars).count() == 0


def test_odd_rules_are_refused(spark):
    pages = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    for rule in (("", "/", "allow"), ("a", None, "allow"), ("a", "/", "maybe")):
        with pytest.raises(ValueError):
            url_rules.judge_urls(pages, [rule])


HOSTS = st.lists(st.sampled_from(["a", "b", "net"]), min_size=1, max_size=3).map(".".join)
PATHS = st.lists(st.sampled_from(["", "a", "ab", "b"]), max_size=3).map(lambda x: "/".join(["", *x]))


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.tuples(HOSTS, PATHS), st.sampled_from(["allow", "block"]), max_size=8), HOSTS, PATHS)
def test_trie_of_rules(rules, host, path):
    listed = [(*k, v) for k, v in rules.items()]
    found = url_rules.Trie(listed).match(host, path)
    assert (found or (None, "allow")) == brute_rule(f"x://{host}{path}", listed)[2:]


# --- whitening -------------------------------------------------------------------


def test_whitening(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 24)) * np.linspace(0.2, 3, 24)
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)]
    rows += [(1000 + k, rows[7][1]) for k in range(300)] + [(7, rows[7][1]), (None, rows[8][1])]
    rows += [(2000, None), (2001, [None] * 24), (2002, [float("nan")] * 24), (2003, [float("inf")] * 24), (2004, []), (2005, [1.0, 2.0]), (2006, [0.0] * 24)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS x", "2 AS component", "3 AS n").repartition(4)
    got = whitening.whiten(made).collect()
    used = [(i, np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000) for i, v in rows if v and len(v) == 24 and None not in v and np.isfinite(v).all()]
    fit = np.unique(np.array([v for _, v in used]), axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    assert len(got) == 16 * len(used) and {r.n for r in got} == {n}
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    sign = {}
    for i, v in used:
        expected = (v - total / n) @ vectors / np.sqrt(values)
        deviation = sum(int(y) ** 2 for y in n * v - total)
        for k in range(16):
            for r in by_row[i][k + 1]:
                sign.setdefault(k, np.sign(expected[k] * r.whitened))
                assert r.deviation == deviation
                assert abs(r.whitened - sign[k] * expected[k]) < 1e-9
                assert abs(r.explained - values[k] / np.trace(centred.T @ centred / n)) < 1e-12
                assert 0 <= r.identity_error < 1e-9


def test_whitening_without_spread(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(5)], schema)).collect()
    assert {r.component for r in line} == {1} and len(line) == 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0.0, 1e-3, 1.0, 1.0 + 1e-9, 2.0, 5.0, 1e4]), min_size=1, max_size=14), st.integers(0, 9))
def test_leading_eigenvalues(spectrum, seed):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(len(spectrum), len(spectrum))))
    v = q @ np.diag(spectrum) @ q.T
    values, vectors = whitening.leading(v, 8)
    largest = max(spectrum)
    expected = [e for e in sorted(spectrum, reverse=True)[:8] if e > 0]
    assert len(values) == len(expected)
    assert np.allclose(values, expected, rtol=0, atol=1e-11 * max(largest, 1))
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-9)
    assert np.allclose(v @ vectors, vectors * values, atol=1e-9 * max(largest, 1))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10**6), st.floats(-3, 3))
def test_inertia_and_solution(n, seed, shift):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, n))
    v = v + v.T
    v[rng.random(n) < 0.3] *= 0
    v = np.tril(v) + np.tril(v, -1).T
    a = v - shift * np.eye(n)
    factors, exact = whitening.Factors(a), np.linalg.eigvalsh(a)
    if np.abs(exact).min() > 1e-8:
        assert factors.negative() == int((exact < 0).sum())
        x = rng.normal(size=n)
        assert np.allclose(a @ factors.solve(x), x, atol=1e-6)
