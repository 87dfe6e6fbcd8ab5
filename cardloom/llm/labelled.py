"""Bounded samples of labelled texts for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_texts(docs: DataFrame, labels: DataFrame, size: int) -> list[tuple[str, object]]:
    """(text, label) of the `size` labelled ids of smallest hash, in order of id.

    `docs` has doc_id and text, `labels` doc_id and label, one row for each id. Ids are chosen first, so
    that no text is moved that is not used; rows that share an id give their smallest text.
    """
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).collect()
    if not chosen:
        return []
    picked = docs.sparkSession.createDataFrame(chosen, labels.schema)
    # The list has `size` rows at most.
    rows = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return [(r.text, r.label) for r in sorted(rows.collect(), key=lambda r: r.doc_id)]
