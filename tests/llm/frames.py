"""Small frames that the tests of this folder share."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None):
    """Documents with ids from 0; `sources` one per text (default: s0)."""
    rows = [(i, t, "en", (sources or {}).get(i, "s0") if isinstance(sources, dict) else (sources[i] if sources else "s0"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def crowded(df):
    """The same rows with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    for name in ("key", "n", "row", "size", "score", "h", "comp", "node", "word", "start", "no", "block", "g", "k"):
        df = df.withColumn(name, F.lit("x"))
    return df


def rows(df, *names):
    """Sorted tuples of the columns `names` (nulls first)."""
    found = [tuple(r[n] for n in names) for r in df.select(*names).collect()]
    return sorted(found, key=lambda r: [(v is not None, v if v is not None else 0) for v in r])
