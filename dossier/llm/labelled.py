"""A bounded sample of labelled documents for the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import cut, learning_row


def labelled_sample(docs: DataFrame, labels: DataFrame, mark: str, rows: int, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, text, y of about `rows` labelled documents at most, never of the held-out fold.

    Documents are taken by the hash of their id, alike at every size. A doc_id labelled more than once gets the
    majority (1 on a tie); null marks and null ids don't count.
    """
    marks = (
        labels.select("doc_id", F.col(mark).alias("y")).where(learning_row(folds, held_out)).where("y is not null")
        .groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    )
    marks = cut(marks)
    n = marks.count()
    if n > rows:
        share = int(rows / n * (1 << 30))
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    # About `rows` narrow rows: their size has a bound, so each task can look ids up.
    return docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")


def gathered(sample: pa.Table, column: str) -> list[np.ndarray]:
    """The arrays of a list column as views of one buffer each chunk: no Python object per number."""
    out: list[np.ndarray] = []
    for chunk in sample[column].chunks:
        offsets, values = chunk.offsets.to_numpy(), chunk.values.to_numpy(zero_copy_only=False)
        out += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    return out
