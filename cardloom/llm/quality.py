"""Quality by supervised subword embeddings.

Every word has a vector for itself and one for each of its character n-grams, all in one hashed table,
and so has the word pair of two equal words, whatever the word; a document is the average over its
words and such pairs of the average of their vectors, and a softmax layer reads
it. Table and layer are learned by stochastic gradient descent in numpy on a bounded sample of
labelled documents. As the layer is linear, a word's part of the scores is one row of numbers, worked
out once for each distinct word of a batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import fold, ready, text_of
from cardloom.llm.labelled import sample_texts
from cardloom.llm.pieces import Coder, pieces, text_sums

# Labelled documents that the model is fitted on at most.
SAMPLE = 2000
BUCKETS = 1 << 16
DIM = 12
NGRAMS = (3, 4, 5)
EPOCHS = 6
BATCH = 16
RATE = 3.0
# The word n-gram that all pairs of equal neighbours share.
SAME = "\x01same"


class Model(NamedTuple):
    scores: np.ndarray  # by bucket and class: the table times the layer
    bias: np.ndarray


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What `_features` gives, for slices of a long list: its arrays are many times the words."""
    parts = [_features(words[at : at + 20_000]) for at in range(0, max(1, len(words)), 20_000)]
    return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its n-grams with the word's ends marked, one word after the other; how many each has."""
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    text = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(raw)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(text))  # bytes up to the word's end
    with np.errstate(over="ignore"):
        place = np.arange(len(text)) - np.repeat(ends - sizes, sizes)
        power = np.cumprod(np.full(int(sizes.max(initial=1)), 0x100000001B3, np.uint64))
        whole = np.add.reduceat(power[place] * (text + np.uint64(1)), ends - sizes) if len(raw) else np.zeros(0, np.uint64)
        hashes, owners = [whole], [np.arange(len(raw))]
        for n in NGRAMS:
            at = np.flatnonzero(left >= n)
            code = np.full(len(at), n, np.uint64)
            for k in range(n):
                code = code * np.uint64(0x100000001B3) + text[at + k]
            hashes.append(code)
            owners.append(owner[at])
        code = np.concatenate(hashes) * np.uint64(0x9E3779B97F4A7C15)
        bucket = ((code >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.bincount(owner, minlength=len(raw))


def repeats(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many words of each text equal the word before them."""
    same = np.zeros(len(codes), np.int64)
    same[1:] = codes[1:] == codes[:-1]
    same[starts[:-1][np.diff(starts) > 0]] = 0
    return text_sums(same, starts)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[int], classes: int = 2) -> Model:
    """Stochastic gradient descent over small batches of documents with a falling rate."""
    rng = np.random.default_rng(11)
    if not texts:
        return Model(np.zeros((BUCKETS, classes)), np.zeros(classes))
    places, names, starts = pieces(texts, words=True)
    again = repeats(places, starts)
    bucket, sizes = features([*names, SAME])
    begin = np.cumsum(sizes) - sizes
    docs = []
    for a, b, same in zip(starts[:-1], starts[1:], again):
        own, count = np.unique(places[a:b], return_counts=True)
        own, count = np.append(own, len(names)), np.append(count, same)
        docs.append((own.astype(np.int32), (count / max(1, b - a + same) / sizes[own]).astype(np.float32)))
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, bias = np.zeros((DIM, classes)), np.zeros(classes)
    truth = np.eye(classes)[np.array(labels)]
    steps = EPOCHS * -(-len(docs) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(docs), BATCH):
            rows = order[at : at + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            own = np.concatenate([docs[r][0] for r in rows])
            n = sizes[own]
            feats = bucket[np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            weight = np.repeat(np.concatenate([docs[r][1] for r in rows]), n)
            doc = np.repeat(np.repeat(np.arange(len(rows)), [len(docs[r][0]) for r in rows]), n)
            parts = table[feats] * weight[:, None]
            hidden = np.stack([np.bincount(doc, parts[:, d], len(rows)) for d in range(DIM)], axis=1)
            error = (_softmax(hidden @ layer + bias) - truth[rows]) / len(rows)
            back = error @ layer.T
            layer -= rate * hidden.T @ error
            bias -= rate * error.sum(axis=0)
            touched, where = np.unique(feats, return_inverse=True)
            change = np.stack([np.bincount(where, weight * back[doc, d], len(touched)) for d in range(DIM)], axis=1)
            # The rate is per document: a document's vectors share its weight of one.
            table[touched] -= rate * len(rows) * change
    return Model((table @ layer), bias)


def _scorer(model: Model) -> Coder:
    known = [np.zeros((0, len(model.bias)))]

    def learn(fresh: list[str]) -> None:
        bucket, sizes = features(fresh)
        rows = np.add.reduceat(model.scores[bucket], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        known[0] = np.concatenate([known[0], rows])

    def forget() -> None:
        known[0] = known[0][:0]

    coder = Coder(learn, forget, words=True)
    coder.known = known
    return coder


def probabilities(model: Model, coder: Coder, texts: list[str]) -> np.ndarray:
    """Class probabilities of each text; a text without words gets those of the bias alone."""
    codes, starts = coder.encode(texts)
    again = repeats(codes, starts)
    sums = text_sums(coder.known[0][codes], starts) + again[:, None] * model.scores[features([SAME])[0]].mean(axis=0)
    return _softmax(sums / np.maximum(np.diff(starts) + again, 1)[:, None] + model.bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from the labelled rows whose crc32(id as text) mod 3 is not 1.

    Ids with several labels count by their mean, at 0.5 as 1; NULL labels and ids are left out.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col(label_col).cast("double").alias("label")).dropna()
    known = known.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label")).filter(fold(F.col("doc_id"), 3) != 1)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # Labels without a document would use up the sample.
    known = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = sample_texts(texts, known, SAMPLE)
    return fit([r[0] for r in rows], [r[1] for r in rows])


def with_quality(docs: DataFrame, model: Model, text_col: str = "text", keep_only: bool = False) -> DataFrame:
    """All columns and rows of `docs` with `score` and `predicted`; or, with `keep_only`, only the rows of predicted 1, as they are.

    A NULL or empty text gets the model's score of no words. Clashing columns are replaced.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # a table of fixed size
    base = docs if keep_only else docs.drop("score", "predicted")
    schema = base.schema if keep_only else base.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    names, place = base.columns, base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        coder = _scorer(model)
        for batch in batches:
            texts = batch.column(place).cast(pa.string()).fill_null("").to_pylist()
            score = probabilities(model, coder, texts)[:, 1]
            if keep_only:
                yield batch.filter(pa.array(score >= 0.5))
            else:
                added = [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*names, "score", "predicted"])

    return base.mapInArrow(run, schema)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Without labelled documents every score is 0.5. A NULL id is not held out and not learned from.
    Repeated rows give repeated rows; other columns play no part; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    scored = with_quality(rows, train(docs, labels, id_col, text_col, label_col))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
