"""Inputs derived from the given star-schema and text tables, for checks and benchmarks.

Each source is read as one standard, each document as one page, each line as one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.lineage import cut
from dossier.functions.scan import Running, running_values
from dossier.functions.sizes import is_small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page blocks with all block types, headings, captions and small tables, as a stored table."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("standard_id"), "doc_id", F.split("text", "\n", -1).alias("lines")
    )
    placed = running_values(
        docs, ["standard_id"], "doc_id",
        [Running("page_no", "sum", F.lit(1)), Running("n_upto", "sum", F.size("lines"))],
        span=512,
    )
    line = F.col("line")
    n = F.length("line")
    level = F.when(n == 0, None).when((F.col("line_no") == 0) & (n < 120), 1).when(n < 40, 2 + n % 3)
    rows = placed.select(
        "standard_id",
        (F.col("page_no") - 1).cast("int").alias("page_idx"),
        (F.col("n_upto") - F.size("lines")).alias("first"),
        F.posexplode_outer("lines").alias("line_no", "line"),
    ).select(
        "standard_id", "page_idx", (F.col("first") + F.col("line_no")).cast("long").alias("block_idx"),
        line, n.alias("n"), level.cast("int").alias("text_level"),
    )
    kind = (
        F.when(F.col("text_level").isNotNull(), "text")
        .when(F.col("n") % 19 == 5, "table").when(F.col("n") % 17 == 3, "header")
        .when(F.col("n") % 13 == 4, "page_footnote").when(F.col("n") % 11 == 2, "list").otherwise("text")
    )
    typed = rows.withColumn("type", kind)
    plain = (F.col("type") == "text") & F.col("text_level").isNull()
    none = F.array().cast("array<string>")
    body = F.replace(F.replace(F.regexp_replace("line", "[<>&]", ""), F.lit(". "), F.lit("</td></tr><tr><td>")), F.lit(" "), F.lit("</td><td>"))
    is_table = F.col("type") == "table"
    return cut(typed.select(
        "standard_id",
        "page_idx",
        "block_idx",
        "type",
        F.when(is_table, None).when(plain & (F.col("n") % 23 == 1), "Notes:")
        .when(plain & (F.col("n") % 29 == 2), F.concat(F.lit("Legend: X = "), line)).otherwise(line).alias("text"),
        "text_level",
        F.when(F.col("type").isin("list", "page_footnote"), F.split("line", ", ", -1)).otherwise(none).alias("list_items"),
        F.when(is_table, F.concat(F.lit("<table><tr><td>"), body, F.lit("</td></tr></table>"))).alias("table_body"),
        F.when(is_table & (F.col("n") % 2 == 0), F.array(F.substring_index("line", " ", 1))).otherwise(none).alias("table_caption"),
        F.when(is_table, F.array(F.concat(F.lit("1 "), line))).otherwise(none).alias("table_footnote"),
        F.lit("").alias("img_path"),
    ))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a report whose turns are numbered items."""
    numbered = F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("report_id"), "turn", F.posexplode_outer(F.split(numbered, "\n", -1)).alias("pos", "line")
    ).select("report_id", (F.col("turn") * 1_000_000 + F.col("pos")).alias("line_no"), "line")


# --- cells -----------------------------------------------------------------------------

KEY_VALUE_HEADS = ["Month", "Urgent Orders", "High Orders", "Medium Orders", "Plain Orders", "low orders"]


def order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per nation, month (as a dotted code) and priority digit."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    per_customer = orders.groupBy(
        "o_custkey", F.date_format("o_orderdate", "yyyy.MM").alias("rl"), F.substring("o_orderpriority", 1, 1).alias("p")
    ).agg(F.count(F.lit(1)).alias("c"))
    return (
        per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("table_id"), "rl", "p")
        .agg(F.sum("c").alias("c"))
    )


def _cell_text(style: str) -> Column:
    c, n = F.col("c"), F.col("c").cast("string")
    if style == "value":
        return (
            F.when(c.isNull(), "").when(c % 3 == 0, F.concat(n, F.lit("$^{1}$")))
            .when(c % 5 == 0, F.concat(F.lit("$\\geq "), n, F.lit("^{2}$"))).when(c % 7 == 0, F.concat(n, F.lit(" [9]"))).otherwise(n)
        )
    if style == "binary":
        return F.when(c.isNull(), "").when(c % 7 == 0, F.lit("see [1]")).when(c > 1, "X").otherwise("")
    if style == "status":
        return F.when(c.isNull(), "").when(c % 5 == 0, "Note 1").when(c % 2 == 0, "Qualified").otherwise("Partially Qualified")
    return F.when(c.isNull(), "").when(c % 4 == 0, F.concat(F.col("rl"), F.lit("; 1."), n)).when(c % 3 == 0, F.concat(n, F.lit(" [1]"))).otherwise(n)


def cells(spark: SparkSession, sf_dir: str, style: str = "value") -> DataFrame:
    """A table per nation: months down, priorities across; missing counts are blank cells."""
    counts = order_counts(spark, sf_dir)
    rows = running_values(
        counts.select("table_id", "rl").distinct().withColumn("key", F.replace("rl", F.lit("."), F.lit("")).cast("long")),
        ["table_id"], "key", [Running("row_idx", "sum", F.lit(1))],
    ).select("table_id", "rl", F.col("row_idx").cast("int").alias("row_idx"))
    digits = F.explode(F.array(*[F.lit(str(d)) for d in range(1, 6)]))
    heads = F.array(*[F.lit(h) for h in KEY_VALUE_HEADS])
    name = F.get(heads, F.col("col_idx")) if style == "key_value" else F.concat(F.lit("1."), F.col("p"))
    corner = F.lit("Month" if style == "key_value" else "Hazard Class")
    slots = rows.withColumn("p", digits).withColumn("col_idx", F.col("p").cast("int"))
    body = slots.join(counts, ["table_id", "rl", "p"], "left").select("table_id", "row_idx", "col_idx", _cell_text(style).alias("text"))
    labels = rows.select("table_id", "row_idx", F.lit(0).alias("col_idx"), F.col("rl").alias("text"))
    tables = rows.select("table_id").distinct()
    header = tables.withColumn("p", digits).withColumn("col_idx", F.col("p").cast("int")).select(
        "table_id", F.lit(0).alias("row_idx"), "col_idx", name.alias("text")
    )
    corners = tables.select("table_id", F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"), corner.alias("text"))
    return body.unionByName(labels).unionByName(header).unionByName(corners)


def table_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legend, notes, footnotes, name and page of the tables above."""
    nations = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    unnamed = F.concat(F.lit("Table_page"), key.cast("string"))
    return nations.select(
        F.col("n_name").alias("table_id"),
        F.when(key % 3 == 0, unnamed).otherwise(F.concat(F.lit("Orders of "), F.col("n_name"))).alias("table_name"),
        key.cast("int").alias("page_idx"),
        F.when(key % 2 == 0, F.concat(F.lit("Legend: X = orders of "), F.col("n_name"), F.lit(" seen; else none"))).otherwise("").alias("legend"),
        F.when(key % 4 == 0, F.array(F.lit("first note"), F.lit("second note"))).otherwise(F.array().cast("array<string>")).alias("notes"),
        F.array(F.concat(F.lit("$^{1}$ counted in "), F.col("n_name")), F.lit("2 by month")).alias("footnotes"),
        F.when(
            key % 5 != 0,
            F.array(
                F.struct(F.lit(2).alias("level"), F.concat(F.lit("Near "), F.col("n_name")).alias("title")),
                F.struct(F.lit(1).alias("level"), F.lit("Far").alias("title")),
            ),
        ).otherwise(F.array().cast("array<struct<level:int,title:string>>")).alias("hierarchy"),
    )


# --- retrieval -------------------------------------------------------------------------


BROADCAST_VECTORS = 100_000  # some 30 MB
N_BASES = 3  # numbers repeat in every base: (base, number) is the key, a number alone is not


def base_of(id_: str) -> Column:
    return F.concat(F.lit("kb"), (F.col(id_) % N_BASES).cast("string"))


def number_in_base(id_: str) -> Column:
    return F.expr(f"{id_} div {N_BASES}")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, dealt to the bases."""
    return table(spark, sf_dir, "documents").select(
        base_of("doc_id").alias("kb"), number_in_base("doc_id").alias("doc_id"), F.col("text").alias("document"), "source"
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages, asked of every base."""
    bases = F.explode(F.array(*[F.lit(f"kb{b}") for b in range(N_BASES)])).alias("kb")
    return table(spark, sf_dir, "benchmark").select(bases, F.col("item_id").alias("query_id"), "text")


def vector_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored vectors; the label decides the type."""
    return table(spark, sf_dir, "embeddings").select(
        _doc_id(F.col("vec_id")).alias("doc_id"),
        F.when(F.col("label") % 3 == 0, "table").otherwise("text_chunk").alias("type"),
        "embedding", "label", "vec_id",
    )


def _doc_id(number: Column) -> Column:
    return F.concat(F.lit("k"), F.lpad(number.cast("string"), 9, "0"))


def text_vector(text: Column) -> Column:
    """A deterministic stand-in encoder: 64 numbers from the digits of two hashes of the text."""
    digits = F.concat(F.md5(text.cast("binary")), F.md5(F.concat(F.lit("x"), text).cast("binary")))
    places = F.sequence(F.lit(1), F.lit(64))
    numbers = lambda d: F.transform(
        places, lambda i: ((F.instr(F.lit("0123456789abcdef"), F.substr(d, i, F.lit(1))) - 8.5) / 40.0).cast("float")
    )
    # The hashes are bound once: an expression inside a transform is taken anew for each of its elements.
    return F.element_at(F.transform(F.array(digits), numbers), 1)


def kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as bases, with the stored vector of the same number, else one from the text."""
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("__n"), "embedding", "label")
    docs = table(spark, sf_dir, "documents")
    # sent where it is small, else hashed: texts need not be sorted to meet the vector of their number
    near = F.broadcast(stored) if is_small(stored.select("__n"), BROADCAST_VECTORS) else stored.hint("shuffle_hash")
    both = docs.join(near, docs["doc_id"] == stored["__n"], "left").withColumn("number", number_in_base("doc_id"))
    kind = F.when(F.coalesce(F.col("label").cast("long"), F.col("number")) % 3 == 0, "table").otherwise("text_chunk")
    both = both.withColumn("type", kind)
    is_table = F.col("type") == "table"
    text = F.col("text")
    name = F.concat(F.lit("Table "), (F.col("n_chars") % 150).cast("string"))
    return both.select(
        base_of("doc_id").alias("kb"), _doc_id(F.col("number")).alias("doc_id"), "type",
        F.coalesce("embedding", text_vector(text)).alias("embedding"),
        F.when(is_table, name).otherwise("").alias("table_name"),
        F.when(is_table, name).otherwise("").alias("display_name"),
        F.when(is_table, "").otherwise(
            F.concat(F.lit("chunk_p"), (F.col("n_chars") % 50).cast("string"), F.lit("_idx"), F.col("n_chars").cast("string"))
        ).alias("chunk_id"),
        F.when(is_table, "").otherwise(F.col("source")).alias("title"),
        F.when(is_table, "").otherwise(F.concat(F.lit("Root > "), F.col("source"))).alias("section_path"),
        text.alias("document"),
        F.when(is_table, text).otherwise("").alias("serialized"),
        F.when(is_table, "").otherwise(text).alias("content"),
        F.lit("").alias("html"), F.lit("").alias("notes"), F.lit("").alias("legend"), F.lit("").alias("footnotes"),
        F.lit("").alias("img_path"), (F.col("n_chars") % 50).cast("int").alias("page_idx"), F.lit(0).alias("synth"),
    )


def written_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`kb` written once, as a stored base is: a search reads its vectors, its texts and its facts separately."""
    return cut(kb(spark, sf_dir))


def kb_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages, asked of every base, with the stored vector of the same number, else one from the text."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    asked = passages(spark, sf_dir).join(vectors, "query_id", "left")
    return cut(asked.withColumn("embedding", F.coalesce("embedding", text_vector(F.col("text")))))


def nearness_scorer(pairs: DataFrame) -> DataFrame:
    """A deterministic stand-in for a pair scorer: nearer vectors score higher.

    Candidates without a distance (lexical ones) get the worst vector score of their query.
    """
    from pyspark.sql import Window

    far = F.max("distance").over(Window.partitionBy("kb", "query_id"))
    return pairs.withColumn("rerank_score", F.round(F.lit(0.0) - F.coalesce(F.col("distance"), far), 9))


# --- verdicts --------------------------------------------------------------------------

MODELS = [("small", 3, 3.0, "local"), ("medium", 5, 17.0, "cloud"), ("large", 9, 120.0, "cloud")]


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "model string, k int, params_b double, provider string")


def verdict_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of three stand-in models on all labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    good, bad = F.lit("COMPLIANT"), F.lit("NON_COMPLIANT")
    expected = F.when(F.col("quality") == 1, good).otherwise(bad)
    wrong = F.when(F.col("quality") == 1, bad).otherwise(good)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("k")) for m, k, _, _ in MODELS])).alias("m")
    return labels.join(docs, "doc_id").select("*", each).select(
        F.col("m.model").alias("model"),
        F.col("doc_id").alias("item_no"),
        F.col("source").alias("grp"),
        expected.alias("expected"),
        F.when(F.col("n_chars") % 17 == 0, "NOT_EVALUATED").when(F.col("n_chars") % F.col("m.k") == 0, wrong).otherwise(expected).alias("verdict"),
        (F.col("n_chars") % 1000 / 100.0).alias("elapsed_s"),
    )


