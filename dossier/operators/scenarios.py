"""Labelled claims derived from table cells."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.config import SPAN_ROWS, AuditConfig
from dossier.functions.numbers import parse_numbers, parse_range, pick_inside
from dossier.functions.scan import Running, running_values
from dossier.functions.text import collapse, strip

_CFG = AuditConfig()

# value class, is the claim true, sentence; {col} and {row} are the headers of the cell
CLAIMS = [
    ("Qualified", _CFG.compliant, "Staff of {col} carry out unit {row} alone and are rated fully qualified."),
    ("Partially Qualified", _CFG.compliant, "Staff of {col} carry out unit {row} only under supervision, as partially qualified."),
    ("Partially Qualified", _CFG.violation, "Staff of {col} carry out unit {row} alone and are rated fully qualified."),
    ("", _CFG.violation, "Staff of {col} are rated qualified for unit {row} without further training."),
]
CLAIM_SCHEMA = "value string, expected string, template string"


def fill(template: Column, **values: Column) -> Column:
    """Put values in the {named} places of a sentence."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def _grid_rows(cells: DataFrame) -> DataFrame:
    return cells.groupBy("table_id", "row_idx").agg(
        F.sort_array(F.collect_list(F.struct("col_idx", "text"))).alias("c")
    ).select("table_id", "row_idx", F.transform("c", lambda x: strip(x["text"])).alias("cells"))


def matrix_claims(cells: DataFrame, claims: Sequence[tuple] = tuple(CLAIMS)) -> DataFrame:
    """True and false claims for every clean cell of a status matrix.

    Rows count whose label starts with a digit; conditional cells (`Note ...`) are left out.
    """
    rows = _grid_rows(cells)
    header = rows.filter("row_idx = 0").select("table_id", F.col("cells").alias("header"))
    body = rows.filter((F.col("row_idx") > 0) & F.col("cells")[0].rlike(r"^\d")).join(header, "table_id")
    each = F.transform(
        "header",
        lambda h, j: F.struct(
            j.cast("int").alias("col_idx"), h.alias("col"), F.coalesce(F.get("cells", j), F.lit("")).alias("value")
        ),
    )
    flat = (
        body.select("table_id", "row_idx", F.col("cells")[0].alias("row"), F.explode_outer(each).alias("e"))
        .filter("e.col_idx > 0")
        .select("table_id", "row_idx", "e.col_idx", "row", "e.col", "e.value")
        .filter(~F.col("value").startswith("Note"))
    )
    # the claim list is part of the program, a few rows
    table = cells.sparkSession.createDataFrame(list(claims), CLAIM_SCHEMA)
    return flat.join(F.broadcast(table), "value").select(
        "table_id", "row_idx", "col_idx",
        fill(F.col("template"), col=F.col("col"), row=F.col("row")).alias("text"), "expected",
    )


@dataclass(frozen=True)
class LimitRule:
    """How claims around a limit are made; {subject}, {measure} and {value} may be used."""

    kind: str
    compliant: str
    violation: str


LIMIT_RULES = [
    LimitRule("max_count", "With {subject} there are {value} seats in a row.", "With {subject} as many as {value} seats stand in a row."),
    LimitRule("min_distance", "{subject} of size {measure} stands {value} m away.", "{subject} of size {measure} stands only {value} m away."),
    LimitRule("min_clearance", "{subject} of size {measure} keeps {value} m from the border.", "{subject} of size {measure} keeps only {value} m from the border."),
    LimitRule("max_length", "In {subject} the longest way is {value} m.", "In {subject} the longest way is as much as {value} m."),
    LimitRule("factor", "For {subject} the factor {value} is used.", "For {subject} the factor {value} is taken."),
    LimitRule("threshold", "{subject} of height {value} m has detection.", "{subject} of height {value} m has no detection."),
]
# Load factors from which a wrong one is taken.
FACTORS = [1.5, 1.0, 0.5, 3.0, 5.0, 10.0, 20.0, 30.0]
_WHOLE = ["max_count", "max_length"]


def threshold_claims(limits: DataFrame, rules: Sequence[LimitRule] = tuple(LIMIT_RULES), less_word: str = "az") -> DataFrame:
    """Values on both sides of each limit, as compliant and violating claims.

    `limits`: table_id, row_idx, kind, subject, range_text, limit_text. The limit is the first
    number of `limit_text`; the measured size is taken from inside `range_text`.
    """
    lim = F.get(parse_numbers(F.col("limit_text")), F.lit(0))
    size = pick_inside(parse_range(F.coalesce("range_text", F.lit("")), less_word))
    whole = F.floor(lim).cast("double")
    other = F.get(
        F.filter(F.array(*[F.lit(x) for x in FACTORS]), lambda x: F.abs(x - F.col("lim")) > 0.6), F.lit(0)
    )
    L, W = F.col("lim"), F.col("whole")
    kind = F.col("kind")
    good = (
        F.when(kind == "max_count", F.greatest(F.lit(1.0), W - 2))
        .when(kind.isin("min_distance", "min_clearance"), F.bround(L * 1.5 + 3, 1))
        .when(kind == "max_length", F.floor(L * 0.6).cast("double"))
        .when(kind == "factor", L)
        .when(kind == "threshold", F.bround(L + 5, 1))
    )
    bad = (
        F.when(kind == "max_count", W + 3)
        .when((kind == "min_distance") & (L > 1), F.bround(L * 0.5, 1))
        .when(kind == "min_clearance", F.bround(F.greatest(F.lit(0.3), L * 0.5), 1))
        .when(kind == "max_length", F.floor(L * 1.7 + 5).cast("double"))
        .when(kind == "factor", F.coalesce(other, L * 2))
        .when(kind == "threshold", F.bround(L + 5, 1))
    )
    texts = cells_of_rules(limits, rules)
    measured = (
        limits.join(F.broadcast(texts), "kind")
        .withColumns({"lim": lim, "whole": whole, "measure": size})
        .filter(F.col("lim").isNotNull() & ((kind != "threshold") | F.contains("limit_text", F.lit(">"))))
        .withColumn("measure", F.when(kind == "min_clearance", F.floor("measure").cast("double")).otherwise(F.col("measure")))
    )
    pair = F.array(
        F.struct(good.alias("value"), F.lit(_CFG.compliant).alias("expected"), F.col("compliant").alias("template")),
        F.struct(bad.alias("value"), F.lit(_CFG.violation).alias("expected"), F.col("violation").alias("template")),
    )
    value = F.when(kind.isin(_WHOLE), F.col("p.value").cast("long").cast("string")).otherwise(F.col("p.value").cast("string"))
    return (
        measured.select("table_id", "row_idx", "kind", "subject", "measure", F.explode(pair).alias("p"))
        .filter(F.col("p.value").isNotNull())
        .select(
            "table_id", "row_idx", "kind", "measure", "p.value", "p.expected",
            fill(F.col("p.template"), subject=F.col("subject"), measure=F.col("measure").cast("string"), value=value).alias("text"),
        )
    )


def cells_of_rules(limits: DataFrame, rules: Sequence[LimitRule]) -> DataFrame:
    """The rule sentences as a table of a few rows."""
    return limits.sparkSession.createDataFrame(
        [(r.kind, r.compliant, r.violation) for r in rules], "kind string, compliant string, violation string"
    )


# Cell contents that mean "no entry".
NIL_WORDS = ["", "nil"]
PAIR_TRUE = "A person with the {ra} title '{ta}' counts as equal to the {rb} title '{tb}' in group {g}."
PAIR_FALSE = "A person with the {ra} title '{ta}' of group {g} counts as equal to the {rb} title '{tb}' of group {h}."


def equivalence_rows(cells: DataFrame, regimes: Sequence[str], nil_words: Sequence[str] = tuple(NIL_WORDS), span: int = SPAN_ROWS) -> DataFrame:
    """Groups with their title in each regime, empty entries left out, numbered per table."""
    rows = _grid_rows(cells).filter("row_idx > 0").filter(F.length(F.col("cells")[0]) > 0)

    def entry(i: int, name: str) -> Column:
        raw = collapse(F.coalesce(F.get("cells", F.lit(i + 1)), F.lit("")))
        value = strip(F.substring_index(raw, "&#", 1))
        empty = F.lower(value).isin(list(nil_words)) | F.contains(F.substring(F.lower(value), 1, 4), F.lit("nil"))
        return F.when(~empty & (F.length(value) > 0), F.struct(F.lit(name).alias("regime"), value.alias("title")))

    entries = F.filter(F.array(*[entry(i, r) for i, r in enumerate(regimes)]), lambda e: e.isNotNull())
    kept = rows.select("table_id", "row_idx", F.col("cells")[0].alias("grp"), entries.alias("entries")).filter(F.size("entries") > 0)
    numbered = running_values(kept, ["table_id"], "row_idx", [Running("row_no", "sum", F.lit(1))], span)
    return numbered.withColumn("row_no", F.col("row_no") - 1)


def equivalence_pairs(rows: DataFrame, n_false: int) -> DataFrame:
    """True claims from two regimes of one row, and `n_false` false claims across rows per table.

    False claims are drawn, not enumerated: draw t pairs row t mod N with the row
    1 + t div N places further on, so N(N-1) draws would give every ordered pair once.
    """
    a_b = F.flatten(
        F.transform("entries", lambda a, i: F.transform(
            F.filter(F.transform("entries", lambda b, j: F.struct(b.alias("b"), j.alias("j"))), lambda x: x["j"] > i),
            lambda x: F.struct(a.alias("a"), x["b"].alias("b")),
        ))
    )
    true = rows.select("table_id", "grp", F.explode_outer(a_b).alias("p")).filter(F.col("p").isNotNull()).select(
        "table_id",
        fill(F.lit(PAIR_TRUE), ra=F.col("p.a.regime"), ta=F.col("p.a.title"), rb=F.col("p.b.regime"), tb=F.col("p.b.title"), g=F.col("grp")).alias("text"),
        F.lit(_CFG.compliant).alias("expected"),
    )
    sized = rows.join(rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_rows")), "table_id")
    first = F.col("entries")[0]
    turns = F.least(F.ceil(F.lit(n_false) / F.col("n_rows")), F.col("n_rows") - 1).cast("int")
    draws = (
        sized.filter("n_rows > 1")
        .select("table_id", "row_no", "n_rows", "grp", first.alias("a"), F.explode(F.sequence(F.lit(1), turns)).alias("s"))
        .filter((F.col("s") - 1) * F.col("n_rows") + F.col("row_no") < n_false)
        .withColumn("row_no", F.pmod(F.col("row_no") + F.col("s"), F.col("n_rows")))
    )
    partner = rows.select("table_id", "row_no", F.col("grp").alias("h"), first.alias("b"))
    false = draws.join(partner, ["table_id", "row_no"]).select(
        "table_id",
        fill(F.lit(PAIR_FALSE), ra=F.col("a.regime"), ta=F.col("a.title"), rb=F.col("b.regime"), tb=F.col("b.title"), g=F.col("grp"), h=F.col("h")).alias("text"),
        F.lit(_CFG.violation).alias("expected"),
    )
    return true.unionByName(false).dropDuplicates(["table_id", "text"])


def balanced_sample(pool: DataFrame, n: int, by: Sequence[str] = ("table_id",), seed: str = "42") -> DataFrame:
    """n claims per group, half of each label, in an order set by the seed."""
    order = F.md5(F.concat(F.lit(seed), F.col("text")))
    w = Window.partitionBy(*by, "expected").orderBy(order, "text")
    quota = F.when(F.col("expected") == _CFG.compliant, F.lit(n // 2)).otherwise(F.lit(n - n // 2))
    ranked = pool.filter(F.col("expected").isin(*_CFG.verdicts)).withColumn("__rn", F.row_number().over(w))
    return ranked.filter(F.col("__rn") <= n - n // 2).filter(F.col("__rn") <= quota).drop("__rn")


BRIDGE_TRUE = "For {task} a person holds '{qual}...' and has finished the bridging units."
BRIDGE_MISSING = "For {task} a person holds '{qual}...' but has no bridging units."
BRIDGE_OTHER = "For {task} a person relies only on '{qual}...', which belongs to {other}."


def bridging_claims(
    cells: DataFrame, step: int = 3, span: int = SPAN_ROWS, qualification_chars: int | None = None
) -> DataFrame:
    """Claims from rows (task, qualification, bridging) in which all three are given.

    Besides a true and a false claim per row, a false one takes the qualification `step` rows
    further on (cyclic), unless both rows have the same task. `qualification_chars` shortens the
    quoted qualification (the published system quotes 70 characters).
    """
    cell = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    full = _grid_rows(cells).filter("row_idx > 0").filter(
        (F.length(cell(0)) > 0) & (F.length(cell(1)) > 0) & (F.length(cell(2)) > 0)
    )
    quoted = collapse(cell(1))
    if qualification_chars is not None:
        quoted = F.substring(quoted, 1, qualification_chars)
    rows = full.select("table_id", "row_idx", cell(0).alias("task"), quoted.alias("qual"))
    numbered = running_values(rows, ["table_id"], "row_idx", [Running("no", "sum", F.lit(1))], span)
    numbered = numbered.withColumn("no", F.col("no") - 1).join(
        rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("n")), "table_id"
    )
    further = numbered.select("table_id", F.col("no").alias("to"), F.col("task").alias("other"), F.col("qual").alias("other_qual"))
    paired = numbered.withColumn("to", F.pmod(F.col("no") + step, F.col("n"))).join(further, ["table_id", "to"])
    made = F.array(
        F.struct(fill(F.lit(BRIDGE_TRUE), task=F.col("task"), qual=F.col("qual")).alias("text"), F.lit(_CFG.compliant).alias("expected")),
        F.struct(fill(F.lit(BRIDGE_MISSING), task=F.col("task"), qual=F.col("qual")).alias("text"), F.lit(_CFG.violation).alias("expected")),
        F.struct(
            F.when(
                F.col("task") != F.col("other"),
                fill(F.lit(BRIDGE_OTHER), task=F.col("task"), qual=F.col("other_qual"), other=F.col("other")),
            ).alias("text"),
            F.lit(_CFG.violation).alias("expected"),
        ),
    )
    return paired.select("table_id", "row_idx", F.explode(made).alias("m")).select(
        "table_id", "row_idx", "m.text", "m.expected"
    ).filter(F.col("text").isNotNull())
