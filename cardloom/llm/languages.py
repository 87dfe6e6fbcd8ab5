"""Language by a bidirectional gated recurrent network over bytes.

The network reads runs between blanks, in windows of at most WINDOW bytes, once from each end; its
output layer gives every byte's position a distribution over the languages. A document's distribution
is the mean over all its positions. The network is trained in numpy by backpropagation through time.
A window's positions depend on the window alone, so each distinct run of a batch is read once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import fold, ready, text_of, written
from cardloom.llm.labelled import sample_texts
from cardloom.llm.pieces import Coder, text_sums

# Documents that the network is trained on at most (its floor is set by all), and how.
SAMPLE = 1500
STEPS = 1200
BATCH = 256
RATE = 0.01
HIDDEN = 16
WINDOW = 24
UNKNOWN = "und"
# Distinct runs that one Python worker remembers over its tasks; forgetting costs time, not results.
WORKER_RUNS = 600_000
_LETTER = re.compile(r"[^\W\d_]")


class Network(NamedTuple):
    """For each direction: what a byte adds to the gates (update, reset, candidate), and the recurrent weights."""

    langs: list[str]
    weights: list[np.ndarray]  # forward bytes, forward recurrent, backward bytes, backward recurrent, output, bias
    floor: float = 0.0  # least probability of a document's language for it to count as known


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, table: np.ndarray, recur: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (time, batch, hidden) over windows of one length, and what the way back needs."""
    h = np.zeros((len(x), HIDDEN), table.dtype)
    states, steps = [], []
    for t in range(x.shape[1]):
        given, back = table[x[:, t]], h @ recur
        z = _sigmoid(given[:, :HIDDEN] + back[:, :HIDDEN])
        r = _sigmoid(given[:, HIDDEN : 2 * HIDDEN] + back[:, HIDDEN : 2 * HIDDEN])
        n = np.tanh(given[:, 2 * HIDDEN :] + r * back[:, 2 * HIDDEN :])
        steps.append((h, z, r, n, back[:, 2 * HIDDEN :]))
        h = n + z * (h - n)
        states.append(h)
    return np.stack(states), steps


def _back(x: np.ndarray, grads: np.ndarray, steps: list, table: np.ndarray, recur: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the byte table and the recurrent weights, backwards through time."""
    d_table, d_recur, d_h = np.zeros_like(table), np.zeros_like(recur), np.zeros_like(grads[0])
    for t in range(len(steps) - 1, -1, -1):
        h, z, r, n, held = steps[t]
        d = d_h + grads[t]
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (h - n) * z * (1 - z)
        d_r = d_n * held * r * (1 - r)
        d_given = np.concatenate([d_z, d_r, d_n], axis=1)
        d_back = np.concatenate([d_z, d_r, d_n * r], axis=1)
        np.add.at(d_table, x[:, t], d_given)
        d_recur += h.T @ d_back
        d_h = d * z + d_back @ recur.T
    return d_table, d_recur


def label_positions(weights: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """(time, batch, language) probabilities of every position of windows of one length."""
    table_f, recur_f, table_b, recur_b, out, bias = weights
    ahead, steps_f = _run(x, table_f, recur_f)
    behind, steps_b = _run(x[:, ::-1], table_b, recur_b)
    both = np.concatenate([ahead, behind[::-1]], axis=2)
    logits = both @ out + bias
    e = np.exp(logits - logits.max(axis=2, keepdims=True))
    return e / e.sum(axis=2, keepdims=True), (both, steps_f, steps_b)


def _gradients(weights: list[np.ndarray], x: np.ndarray, lang: np.ndarray) -> list[np.ndarray]:
    table_f, recur_f, table_b, recur_b, out, bias = weights
    probs, (both, steps_f, steps_b) = label_positions(weights, x)
    error = probs.copy()
    error[:, np.arange(len(lang)), lang] -= 1
    error /= len(lang) * x.shape[1]
    d_both = error @ out.T
    d_out = np.tensordot(both, error, ([0, 1], [0, 1]))
    ahead = _back(x, d_both[:, :, :HIDDEN], steps_f, table_f, recur_f)
    behind = _back(x[:, ::-1], d_both[::-1, :, HIDDEN:], steps_b, table_b, recur_b)
    return [*ahead, *behind, d_out, error.sum(axis=(0, 1))]


def windows(run: str) -> list[bytes]:
    raw = run.encode("utf-8", "surrogatepass")
    return [raw[at : at + WINDOW] for at in range(0, len(raw), WINDOW)]


def fit(texts: list[str], labels: list[str]) -> Network:
    """Adam on batches of windows of one length; every window of the sample is as likely as any other."""
    langs = sorted(set(labels))
    if not langs:
        return Network([], [])
    by_length: dict[int, tuple[list[bytes], list[int]]] = {}
    for text, label in zip(texts, labels):
        for run in text.split():
            for w in windows(run):
                rows, own = by_length.setdefault(len(w), ([], []))
                rows.append(w)
                own.append(langs.index(label))
    rng = np.random.default_rng(5)
    small = 1 / np.sqrt(HIDDEN)
    shapes = [(256, 3 * HIDDEN), (HIDDEN, 3 * HIDDEN), (256, 3 * HIDDEN), (HIDDEN, 3 * HIDDEN), (2 * HIDDEN, len(langs)), (len(langs),)]
    weights = [rng.uniform(-small, small, s).astype(np.float32) for s in shapes]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    lengths = sorted(by_length)
    data = {n: (np.frombuffer(b"".join(rows), np.uint8).reshape(-1, n), np.array(own, np.int32)) for n, (rows, own) in by_length.items()}
    by_length.clear()
    share = np.array([len(data[n][1]) * n for n in lengths], float)
    for step in range(1, STEPS + 1 if lengths else 0):
        x, lang = data[lengths[rng.choice(len(lengths), p=share / share.sum())]]
        pick = rng.integers(0, len(lang), BATCH)
        rate = RATE * (1 - 0.9 * step / STEPS)
        for w, m, s, g in zip(weights, mean, square, _gradients(weights, x[pick], lang[pick])):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Network(langs, weights)


class _Reader:
    """Sums of the positions' probabilities, their number, and whether there is a letter, of each distinct run."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.coder = Coder(self._learn, self._forget, words=True, memory=WORKER_RUNS)
        self._forget()

    def _forget(self) -> None:
        self.rows = np.zeros((0, len(self.net.langs) + 2))

    def _learn(self, fresh: list[str]) -> None:
        rows = np.zeros((len(fresh), len(self.net.langs) + 2))
        by_length: dict[int, tuple[list[bytes], list[int]]] = {}
        for k, run in enumerate(fresh):
            for w in windows(run):
                raw, owner = by_length.setdefault(len(w), ([], []))
                raw.append(w)
                owner.append(k)
            rows[k, -1] = _LETTER.search(run) is not None
        for n, (raw, owner) in by_length.items():
            x, own = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, n), np.array(owner)
            for at in range(0, len(x), 8192):
                found = label_positions(self.net.weights, x[at : at + 8192])[0].sum(axis=0)
                np.add.at(rows[:, :-2], own[at : at + 8192], found)
            np.add.at(rows[:, -2], own, float(n))
        self.rows = np.concatenate([self.rows, rows])

    def read(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and its probability of each text."""
        if not self.net.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        codes, starts = self.coder.encode(texts)
        sums = text_sums(self.rows[codes], starts)
        mean = sums[:, :-2] / np.maximum(sums[:, -2:-1], 1)
        best = mean.argmax(axis=1)
        letters = sums[:, -1] > 0
        score = np.where(letters, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)
        return [self.net.langs[b] if k else UNKNOWN for b, k in zip(best, letters)], score


_READERS: dict[bytes, _Reader] = {}


def _reader(net: Network) -> _Reader:
    """The worker's reader of this network; that of another network goes."""
    key = hashlib.sha256(b"".join(w.tobytes() for w in net.weights) + repr(net.langs).encode()).digest()
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = _Reader(net)
    return _READERS[key]


# A round of `_at_rank` splits its range of scores into so many parts, one counted row each.
PARTS = 1 << 16


def _at_rank(scores: DataFrame, rank: int) -> float:
    """The score with exactly `rank` smaller ones before it, in order; of the column `score`, within 0 to 1.

    Each round counts the parts of what is left, and goes on with the part that holds the rank, until that is one value.
    """
    while True:
        ends = scores.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
        if ends.low == ends.high:
            return float(ends.low)
        place = F.least(F.floor((F.col("score") - ends.low) / (ends.high - ends.low) * PARTS), F.lit(PARTS - 1)).cast("int")
        split = scores.withColumn("place", place)
        for part, n in sorted((r.place, r["count"]) for r in split.groupBy("place").count().collect()):  # PARTS rows at most
            if rank < n:
                break
            rank -= n
        scores = split.filter(F.col("place") == part).select("score")


def floor_of(net: Network, texts: DataFrame) -> float:
    """Half way from chance to the score that all but one in a thousand of the texts with letters reach.

    `texts` has the column `text`, one row for each training document; all of them are read, and the quantile is exact. With one
    language every text scores 1, and nothing can be told from it.
    """
    if len(net.langs) < 2:
        return 0.0
    scores = written(with_language(texts.select("text"), net).filter("score > 0").select("score"), "language-scores")
    n = scores.count()
    if not n:
        return 0.0
    at = 0.001 * (n - 1)
    low = _at_rank(scores, int(at))
    high = _at_rank(scores, int(at) + 1) if at > int(at) else low
    return (1 / len(net.langs) + low + (high - low) * (at - int(at))) / 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", judging: bool = False) -> Network:
    """Learn from documents of non-NULL language whose crc32(id as text) mod 3 is not 1; an id with several languages counts by its least.

    With `judging` the network also has the floor that all its training documents set, not the fitted ones alone.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.col(lang_col).cast("string").alias("label"))
    training = rows.filter(F.col("label").isNotNull() & (fold(F.col("doc_id"), 3) != 1))
    known = training.groupBy("doc_id").agg(F.min("label").alias("label"))
    sample = sample_texts(rows.select("doc_id", "text"), known, SAMPLE)
    net = fit([r[0] for r in sample], [r[1] for r in sample])
    return net._replace(floor=floor_of(net, training)) if judging else net


def with_language(docs: DataFrame, net: Network, text_col: str = "text", keep_only: bool = False) -> DataFrame:
    """All columns and rows of `docs` with `lang_pred` and `score`; or, with `keep_only`, only the rows with a language whose score reaches the network's floor, as they are.

    A text that is NULL, empty or without a letter is `und` with score 0. Clashing columns are replaced.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(net)  # weights of fixed size
    base = docs if keep_only else docs.drop("lang_pred", "score")
    schema = base.schema if keep_only else base.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    names, place = base.columns, base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(shared.value)
        for batch in batches:
            langs, score = reader.read(batch.column(place).cast(pa.string()).fill_null("").to_pylist())
            if keep_only:
                yield batch.filter(pa.array([x != UNKNOWN and s >= shared.value.floor for x, s in zip(langs, score)], pa.bool_()))
            else:
                added = [pa.array(langs, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*names, "lang_pred", "score"])

    return base.mapInArrow(run, schema)


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    Without training documents every text is `und`. A NULL id is not held out and not learned from.
    Repeated rows give repeated rows; other columns play no part; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    read = with_language(rows, train(docs, id_col, text_col, lang_col))
    return read.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
