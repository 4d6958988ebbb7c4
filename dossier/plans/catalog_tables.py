"""Table queries over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from dossier.operators import grid
from dossier.operators import tables as tb
from dossier.operators.text import repeated_blocks
from dossier.plans import inputs

_KEYS = ("standard_id", "table_idx")


def _tables(spark, sf):
    return tb.tables_of(inputs.blocks(spark, sf))


def table_cells(spark, sf):
    return grid.table_cells(_tables(spark, sf), _KEYS)


def grid_shape(spark, sf):
    return grid.grid_shape(table_cells(spark, sf), _KEYS).withColumn("fill_rate", F.round("fill_rate", 6))


def table_quality(spark, sf):
    b = inputs.blocks(spark, sf)
    return tb.table_quality(tb.tables_of(b), repeated_blocks(b)).drop("html", "img_path").withColumn(
        "fill_rate", F.round("fill_rate", 6)
    )


def _flat(df):
    join = lambda c: F.array_join(c, "|")
    for c in ("notes", "footnotes"):
        if c in df.columns:
            df = df.withColumn(c, join(c))
    if "hierarchy" in df.columns:
        titles = F.transform("hierarchy", lambda h: F.concat(h["level"].cast("string"), F.lit(":"), h["title"]))
        df = df.withColumn("hierarchy", join(titles))
    return df


def heading_context(spark, sf):
    b = inputs.blocks(spark, sf)
    return _flat(tb.heading_context(b, repeated_blocks(b)))


def trailing_context(spark, sf):
    b = inputs.blocks(spark, sf)
    return _flat(tb.trailing_context(b, repeated_blocks(b)))


def table_units(spark, sf):
    units, rejected = tb.table_units(inputs.blocks(spark, sf))
    return _flat(units).drop("html", "img_path").withColumn("reject_reason", F.lit("")).unionByName(
        rejected.drop("html_len"), allowMissingColumns=True
    )


def stitch_fragments(spark, sf):
    units, _ = tb.table_units(inputs.blocks(spark, sf))
    merged = tb.stitch_fragments(units, max_page_gap=2)
    return _flat(merged).withColumn("merged_pages", F.array_join(F.col("merged_pages").cast("array<string>"), ",")).drop("list_order")


def resolve_footnotes(spark, sf):
    return tb.resolve_footnotes(inputs.cells(spark, sf, "value"), inputs.table_notes(spark, sf).select("table_id", "footnotes"))


def classify_tables(spark, sf):
    styles = ("value", "binary", "key_value")
    all_cells = [
        inputs.cells(spark, sf, s).withColumn("table_id", F.concat(F.lit(f"{s}/"), "table_id")) for s in styles
    ]
    return tb.classify_tables(reduce(lambda a, b: a.unionByName(b), all_cells)).withColumn("x_share", F.round("x_share", 6))


def value_matrix_facts(spark, sf):
    return tb.value_matrix_facts(inputs.cells(spark, sf, "value"), inputs.table_notes(spark, sf))


def binary_matrix_facts(spark, sf):
    return tb.binary_matrix_facts(inputs.cells(spark, sf, "binary"), inputs.table_notes(spark, sf))


def key_value_facts(spark, sf):
    return tb.key_value_facts(inputs.cells(spark, sf, "key_value"), inputs.table_notes(spark, sf))


def table_documents(spark, sf):
    notes = inputs.table_notes(spark, sf)
    facts = tb.table_facts(inputs.cells(spark, sf, "value"), notes)
    return tb.table_documents(notes, facts).select("table_id", "display_name", "serialized")


def variant_tables(spark, sf):
    return inputs.blocks(spark, sf).filter("type = 'table'").select(
        F.concat_ws("#", "standard_id", F.col("block_idx").cast("string")).alias("table_id"),
        F.array_join("table_caption", " ").alias("caption"), "page_idx", F.col("table_body").alias("html"),
        F.col("table_footnote").alias("footnotes"),
    )


def serialization_variants(spark, sf):
    """The five texts SQL can give; the serializer text (E) is checked by table_documents."""
    return tb.serialization_variants(variant_tables(spark, sf)).filter("method <> 'E'")


def serialization_variants_full(spark, sf):
    return tb.serialization_variants(variant_tables(spark, sf)).filter("method = 'E'")


QUERIES = {
    f.__name__: f
    for f in (table_cells, grid_shape, table_quality, heading_context, trailing_context, table_units, stitch_fragments,
              resolve_footnotes, classify_tables, value_matrix_facts, binary_matrix_facts, key_value_facts,
              table_documents, serialization_variants, serialization_variants_full)
}
