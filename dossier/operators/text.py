"""Text preparation: repeated lines, sections, windows, language routing, report items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.config import SPAN_ROWS, TextConfig
from dossier.functions.lineage import cut
from dossier.functions.scan import Running, running_values
from dossier.functions.sizes import written_side
from dossier.functions.text import (
    join_nonempty,
    norm_line,
    rstrip,
    split_lines,
    strip,
)

# Block types without body text, heading levels, type names.
SKIP_TYPES = ["footer", "page_number", "header", "table"]
HEADING_LEVELS = [1, 2, 3, 4]
LIST_TYPES = ["list", "page_footnote"]
PREAMBLE = "Preamble"

# Stop words whose rate tells English from Turkish text.
EN_STOP = (
    "the and of to in for is are be as that with this or by an from at which "
    "shall not on all any such where when"
).split()
TR_STOP = (
    "ve bir bu için ile olan da de en çok veya göre gibi ancak ise her daha olarak "
    "madde edilir yapılır şekilde durumda ya"
).split()
TR_ONLY_LETTERS = "ığş"
LANGUAGE_WORD = "[a-zçğıöşü]+"


DROPPED_ROWS = 100_000  # blocks with lines to drop that may be sent to all tasks


def _body(text: Column, type_: Column, items: Column) -> Column:
    own = strip(F.coalesce(text, F.lit("")))
    listed = F.transform(F.coalesce(items, F.array().cast("array<string>")), strip)
    return (
        F.when(type_ == "text", own)
        .when(type_.isin(LIST_TYPES), join_nonempty(F.concat(F.array(own), listed), "\n"))
        .otherwise(F.lit(""))
    )


def block_text(blocks: DataFrame) -> DataFrame:
    """Text of every block that can carry text, as column `content`."""
    return blocks.filter(~F.col("type").isin(SKIP_TYPES)).withColumn(
        "content", _body(F.col("text"), F.col("type"), F.col("list_items"))
    )


def _norm_lines(blocks: DataFrame) -> DataFrame:
    with_text = block_text(blocks)
    return with_text.select(
        "standard_id",
        "block_idx",
        F.coalesce("page_idx", F.lit(0)).alias("page_idx"),
        # outer: otherwise Spark would first filter on the size of the computed array, and so
        # compute it twice
        F.explode_outer(split_lines(F.col("content"))).alias("line"),
    ).withColumn("line", norm_line(F.col("line"))).filter(F.length("line") > 0)


def repeated_lines(blocks: DataFrame, min_pages: int = TextConfig.repeat_min_pages) -> DataFrame:
    """Normalised lines found on at least `min_pages` different pages of one standard.

    The page is part of the first shuffle key, so a line repeated everywhere is deduplicated
    map-side and never gathers on one task.
    """
    counted = (
        _norm_lines(blocks)
        .select("standard_id", "line", "page_idx")
        .distinct()
        .groupBy("standard_id", "line")
        .agg(F.count(F.lit(1)).alias("n_pages"))
    )
    return counted.filter((F.col("n_pages") >= min_pages) & F.lit(min_pages > 0))


def strip_repeated_lines(blocks: DataFrame, repeated: DataFrame) -> DataFrame:
    """Blocks with column `content` freed of repeated lines; order and indices unchanged.

    Only normalised lines travel to the match; the text itself is joined by block with the
    short list of lines to drop, which is written once, however often the blocks are read.
    """
    drop = written_side(
        _norm_lines(blocks)
        .select("standard_id", "block_idx", "line")
        .join(repeated.select("standard_id", "line"), ["standard_id", "line"], "left_semi")
        .groupBy("standard_id", "block_idx")
        .agg(F.collect_set("line").alias("__drop")),
        DROPPED_ROWS,
    )
    kept = F.filter(
        split_lines(F.col("content")),
        lambda ln: ~F.array_contains(F.col("__drop"), norm_line(ln)),
    )
    joined = block_text(blocks).join(drop, ["standard_id", "block_idx"], "left")
    return joined.withColumn(
        "content",
        F.when(F.col("__drop").isNull(), F.col("content")).otherwise(strip(F.array_join(kept, "\n"))),
    ).drop("__drop")


def repeated_blocks(blocks: DataFrame, min_pages: int = TextConfig.repeat_min_pages) -> DataFrame:
    """Whole-block texts (any type, five characters or more) on at least `min_pages` pages."""
    own = strip(F.coalesce("text", F.lit("")))
    return (
        blocks.filter(F.length(own) >= 5)
        .select("standard_id", F.lower(own).alias("text"), F.coalesce("page_idx", F.lit(-1)).alias("page_idx"))
        .distinct()
        .groupBy("standard_id", "text")
        .agg(F.count(F.lit(1)).alias("n_pages"))
        .filter(F.col("n_pages") >= min_pages)
    )


def _marked_rows(blocks: DataFrame, min_pages: int) -> DataFrame:
    """Body rows with heading marks; headings that are repeated lines are left out."""
    repeated = written_side(repeated_lines(blocks, min_pages))
    title = strip(F.coalesce("text", F.lit("")))
    heading = (
        (F.col("type") == "text")
        & F.coalesce(F.col("text_level").isin(HEADING_LEVELS), F.lit(False))
        & (F.length(title) > 0)
    )
    rows = strip_repeated_lines(blocks, repeated).select(
        "standard_id",
        "block_idx",
        F.coalesce("page_idx", F.lit(0)).alias("page_idx"),
        heading.alias("is_heading"),
        F.when(heading, F.col("text_level")).alias("level"),
        F.when(heading, title).alias("title"),
        F.when(heading, title).otherwise(F.col("content")).alias("content"),
        # other rows get a key of their own, so that a shuffle by line would not pile them up
        F.when(heading, norm_line(F.col("text")))
        .otherwise(F.concat(F.lit("\u0000"), F.col("block_idx").cast("string"))).alias("line"),
    )
    # A heading that is itself a repeated line neither opens a section nor adds content.
    return rows.join(
        repeated.select("standard_id", "line"), ["standard_id", "line"], "left_anti"
    ).drop("line").filter(F.length("content") > 0)


def _opened(rows: DataFrame, span: int) -> DataFrame:
    """Narrow rows with `start_idx`, the section start in force, and `is_start`.

    The first content before any heading opens the Preamble section: a running minimum finds it
    in the same scan that carries the last heading, so no row looks for its standard's first one.
    """
    scanned = running_values(
        rows, ["standard_id"], "block_idx",
        [Running("first", "min", F.col("block_idx")), Running("heading", "max", F.when(F.col("is_heading"), F.col("block_idx")))],
        span,
    )
    opens = (F.col("block_idx") == F.col("first")) & ~F.col("is_heading")
    return scanned.select(
        "standard_id", "block_idx", "page_idx",
        (F.col("is_heading") | opens).alias("is_start"),
        F.when(opens, F.lit(1)).otherwise(F.col("level")).alias("level"),
        F.when(opens, F.lit(PREAMBLE)).otherwise(F.col("title")).alias("title"),
        F.coalesce("heading", "first").alias("start_idx"),
    )


def _stack_depth(starts: DataFrame, span: int) -> DataFrame:
    """Depth of the heading stack after each section start.

    Levels may skip, so depth_i = min(depth_{i-1} + 1, level_i). In closed form, with the
    starts numbered i = 1, 2, ...: depth_i = i + min(0, min over j <= i of (level_j - j)).
    Both parts add up over spans, so one pass with a carry is enough.
    """
    keys = ["standard_id", "__span"]
    w = Window.partitionBy(*keys).orderBy("block_idx")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = (
        starts.withColumn("__span", F.expr(f"block_idx div {int(span)}"))
        .withColumn("i", F.row_number().over(w))
        .withColumn("gap", F.col("level") - F.col("i"))
        .withColumn("low", F.min("gap").over(upto))
    )
    over_spans = (
        Window.partitionBy("standard_id").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        here.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("c"), F.min("gap").alias("m"))
        .withColumn("base", F.coalesce(F.sum("c").over(over_spans), F.lit(0)))
        .withColumn("low_before", F.min(F.col("m") - F.col("base")).over(over_spans))
        .select(*keys, "base", "low_before")
    )
    low = F.least(F.lit(0), F.col("low") - F.col("base"), F.col("low_before"))
    return (
        here.join(carry, keys)
        .withColumn("depth", (F.col("i") + F.col("base") + low).cast("int"))
        .select(*starts.columns, "depth")
    )


def _sections_of(starts: DataFrame, span: int) -> DataFrame:
    depth = _stack_depth(starts, span)
    at = [
        Running(f"t{p}", "last", F.when(F.col("depth") == p, F.col("title"))) for p in HEADING_LEVELS
    ]
    stacked = running_values(depth, ["standard_id"], "block_idx", at, span)
    return stacked.select(
        "standard_id",
        F.col("block_idx").alias("start_idx"),
        "page_idx",
        "title",
        F.slice(F.array("t1", "t2", "t3", "t4"), F.lit(1), F.col("depth")).alias("section_path"),
    )


def _sectioned(blocks: DataFrame, min_pages: int, span: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sections, narrow rows with their section start, and rows with their text.

    Only the narrow rows are written and scanned; texts stay where they are until a section
    collects them.
    """
    marked = _marked_rows(blocks, min_pages)
    narrow = cut(marked.select("standard_id", "block_idx", "page_idx", "is_heading", "level", "title"))
    placed = cut(_opened(narrow, span))
    starts = placed.filter("is_start").select("standard_id", "block_idx", "page_idx", "level", "title")
    return _sections_of(starts, span), placed, marked.select("standard_id", "block_idx", "content")


def section_paths(
    blocks: DataFrame, min_pages: int = TextConfig.repeat_min_pages, span: int = SPAN_ROWS
) -> DataFrame:
    """Heading stack in force at every body row (heading rows included)."""
    sections, placed, _ = _sectioned(blocks, min_pages, span)
    return placed.select("standard_id", "block_idx", "start_idx").join(
        sections.select("standard_id", "start_idx", "title", "section_path"), ["standard_id", "start_idx"]
    )


def section_chunks(
    blocks: DataFrame,
    min_pages: int = TextConfig.repeat_min_pages,
    min_chars: int = TextConfig.min_content_chars,
    span: int = SPAN_ROWS,
) -> DataFrame:
    """One chunk per heading section; sections with too little content are left out.

    A chunk is one output value, so its lines meet in one row; nothing larger does.
    """
    sections, placed, texts = _sectioned(blocks, min_pages, span)
    owned = texts.join(placed.select("standard_id", "block_idx", "start_idx"), ["standard_id", "block_idx"])
    bodies = owned.groupBy("standard_id", "start_idx").agg(
        F.sort_array(F.collect_list(F.struct("block_idx", "content"))).alias("rows")
    )
    content = strip(F.array_join(F.transform("rows", lambda r: r["content"]), "\n"))
    return (
        bodies.select("standard_id", "start_idx", content.alias("content"))
        .filter(F.length("content") >= min_chars)
        .join(sections, ["standard_id", "start_idx"])
        .select(
            "standard_id",
            F.concat(
                F.lit("chunk_p"), F.col("page_idx").cast("string"),
                F.lit("_idx"), F.col("start_idx").cast("string"),
            ).alias("chunk_id"),
            "title",
            "section_path",
            "content",
            "page_idx",
            F.col("start_idx"),
            F.lit("text_chunk").alias("type"),
        )
    )


def pack_windows(chunks: DataFrame, max_chars: int = TextConfig.window_max_chars) -> DataFrame:
    """Pack the lines of each chunk greedily into windows of at most `max_chars`.

    A single longer line stays whole. All windows keep the chunk's id; `doc_id` carries the
    window number only if there is more than one. Chunks are packed inside their own row.
    """
    content = F.col("content")
    lines = F.split(content, "\n", -1)
    empty = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit("").alias("cur"),
    )

    def step(acc: Column, line: Column) -> Column:
        full = (F.length(acc["cur"]) > 0) & (F.length(acc["cur"]) + 1 + F.length(line) > max_chars)
        joined = F.when(F.length(acc["cur"]) > 0, F.concat(acc["cur"], F.lit("\n"), line)).otherwise(line)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, line).otherwise(joined).alias("cur"),
        )

    def finish(acc: Column) -> Column:
        return F.when(
            F.length(strip(acc["cur"])) > 0, F.concat(acc["done"], F.array(acc["cur"]))
        ).otherwise(acc["done"])

    whole = (F.length(content) <= max_chars) | F.lit(max_chars <= 0)
    windows = F.when(whole, F.array(content)).otherwise(F.aggregate(lines, empty, step, finish))
    packed = chunks.withColumn("__windows", windows).withColumn("__n", F.size("__windows"))
    return (
        packed.select("*", F.posexplode_outer("__windows").alias("window_no", "window"))
        .filter(F.col("window_no").isNotNull())
        .withColumn(
            "doc_id",
            F.when(F.col("__n") == 1, F.col("chunk_id")).otherwise(
                F.concat(F.col("chunk_id"), F.lit("__w"), F.col("window_no").cast("string"))
            ),
        )
        .drop("__windows", "__n")
    )


def route_language(
    docs: DataFrame, sample_chars: int | None = None, text: str = "text", min_words: int = 30
) -> DataFrame:
    """Encoder family for each text from stop-word rates and letters English does not have.

    The whole text counts; `sample_chars` limits it to a beginning, as the published system
    does with 20,000. Everything happens inside the row.
    """
    body = F.col(text) if sample_chars is None else F.substring(F.col(text), 1, sample_chars)
    lowered = F.lower(body)
    sized = docs.withColumn("__low", lowered).withColumn(
        "__words", F.regexp_extract_all(F.col("__low"), F.lit(LANGUAGE_WORD), F.lit(0))
    )
    n = F.size("__words")
    rate = lambda stop: F.when(n > 0, F.size(F.filter("__words", lambda w: w.isin(stop))) / n).otherwise(0.0)
    letters = F.length("__low") - F.length(F.translate("__low", TR_ONLY_LETTERS, ""))
    measured = sized.select(
        *docs.columns, n.alias("n_words"), rate(EN_STOP).alias("en_rate"),
        rate(TR_STOP).alias("tr_rate"), letters.alias("tr_letters"),
    )
    return measured.withColumn("route", _route(min_words))


def _route(min_words: int) -> Column:
    foreign = (F.col("tr_letters") >= 5) | (F.col("tr_rate") > F.col("en_rate")) | (F.col("en_rate") < 0.04)
    return F.when((F.col("n_words") >= min_words) & foreign, F.lit("multilingual")).otherwise(F.lit("english"))


def route_bases(docs: DataFrame, text: str = "document", min_words: int = 30) -> DataFrame:
    """One encoder family per knowledge base, from the words of all its texts together."""
    rates = route_language(docs.select("kb", text), None, text, min_words)
    n = F.sum("n_words")
    share = lambda c: F.when(n > 0, F.sum(F.col(c) * F.col("n_words")) / n).otherwise(F.lit(0.0))
    return rates.groupBy("kb").agg(
        share("en_rate").alias("en_rate"), share("tr_rate").alias("tr_rate"), F.sum("tr_letters").alias("tr_letters"), n.alias("n_words")
    ).withColumn("route", _route(min_words))


def route_counts(routed: DataFrame, *by: str) -> DataFrame:
    """Texts per route (and per further column)."""
    return routed.groupBy("route", *by).agg(F.count(F.lit(1)).alias("n_docs"))


_ITEM_START = r"(?U)^(\d{1,3})\.\s+(.*)"


def marked_lines(lines: DataFrame, *more: str) -> DataFrame:
    """report_id, line_no, no, part, starts of each line: whether it starts an item, its number, its text."""
    # a line is one physical line here: trailing white space is not part of it
    trimmed = rstrip(F.col("line"))
    return lines.select(
        "report_id",
        "line_no",
        F.regexp_extract(trimmed, _ITEM_START, 1).alias("no"),
        F.when(trimmed.rlike(_ITEM_START), strip(F.regexp_extract(trimmed, _ITEM_START, 2)))
        .otherwise(strip(trimmed)).alias("part"),
        trimmed.rlike(_ITEM_START).alias("starts"),
        *more,
    )


def numbered_items(lines: DataFrame, span: int = SPAN_ROWS) -> DataFrame:
    """Numbered items of each report.

    Input: report_id, line_no (a unique long, increasing), line. A line `12. text` starts an
    item, later non-blank lines continue it, lines before the first item are dropped.
    """
    numbered = marked_lines(lines)
    opened = Running("item_line", "max", F.when(F.col("starts"), F.col("line_no")))
    placed = running_values(numbered, ["report_id"], "line_no", [opened], span)
    items = (
        placed.filter(F.col("item_line").isNotNull())
        .groupBy("report_id", "item_line")
        .agg(
            F.max(F.when(F.col("starts"), F.col("no"))).cast("int").alias("item_no"),
            F.sort_array(
                F.collect_list(
                    F.when(F.col("starts") | (F.length("part") > 0), F.struct("line_no", "part"))
                )
            ).alias("parts"),
        )
    )
    return item_texts(items.withColumn("parts", F.transform("parts", lambda p: p["part"])))


def item_texts(items: DataFrame) -> DataFrame:
    """report_id, item_line, item_no, text of items whose lines stand in `parts`; blank items are dropped."""
    text = strip(F.array_join("parts", " "))
    return items.select("report_id", "item_line", "item_no", text.alias("text")).filter(F.length("text") > 0)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """First `n` rows of each key; Spark prunes groups before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")
