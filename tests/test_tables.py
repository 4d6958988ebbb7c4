"""Tables: spans, context, fragments and facts on small hand-made input."""

import random

from pyspark.sql import functions as F

from dossier.functions.cells import clean_cell, initials, labelled_code
from dossier.operators import grid
from dossier.operators import tables as tb

BLOCK = ("standard_id string, block_idx long, page_idx int, type string, text string, text_level int, "
         "list_items array<string>, table_body string, table_caption array<string>, img_path string")


def test_spans_are_written_out():
    html = (
        "<table><tr><th rowspan=2>A</th><th colspan='2'>B</th></tr><tr><td>c</td><td>d &amp; e</td></tr>"
        "<tr><td> </td><td></td></tr><tr><td rowspan='x'>f</td><td rowspan=3>g</td></tr><tr><td>h</td></tr><tr></tr></table>"
    )
    assert grid.grid_of(html) == [["A", "B", "B"], ["A", "c", "d & e"], ["f", "g"], ["h", "g"], ["g"]]
    assert grid.grid_of(html, expand_spans=False)[0] == ["A", "B"]


def test_plain_pages_are_read_as_the_parser_reads_them(monkeypatch):
    r = random.Random(3)
    marks = [f"<{end}{tag}>" for tag in ("table", "tbody", "tr", "td", "th") for end in ("", "/")] + ["a", " b ", "c>d", "\n", ""]
    pages = ["".join(r.choice(marks) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    plain = [(grid.raw_rows(p), grid.grid_of(p)) for p in pages]
    with monkeypatch.context() as m:
        m.setattr(grid, "_plain_rows", lambda html: None)
        assert [(grid.raw_rows(p), grid.grid_of(p)) for p in pages] == plain
    monkeypatch.setattr(grid, "_Marks", None)
    assert grid.grid_of("<table><tr><td>a</td><th> b</th></tr><tr><td> </td></tr></table>") == [["a", "b"]]


def test_cells_of_many_tables(spark):
    df = spark.createDataFrame([(i, f"<tr><td>{i}</td><td colspan=2>x</td></tr>") for i in range(50)], "table_id int, html string")
    got = {(r.table_id, r.row_idx, r.col_idx): r.text for r in grid.table_cells(df).collect()}
    assert len(got) == 150 and got[7, 0, 0] == "7" and got[7, 0, 2] == "x"
    shape = grid.grid_shape(grid.table_cells(df)).filter("table_id = 3").first()
    assert (shape.n_rows, shape.n_cols, shape.fill_rate) == (1, 3, 1.0)


def test_clean_cells(spark):
    texts = {
        "12$^{1}$": "12[1]",
        r"$1.3^{2} \leq Q_{p}$": "1.3^(2) ≤ Q_(p)",
        r"a $\text{Group K} \rightarrow x$ b": "a Group K → x b",
        "$5$": "[5]",
        " plain ": "plain",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.c for r in df.select("t", clean_cell(F.col("t")).alias("c")).collect()}
    assert got == texts
    r = spark.range(1).select(
        initials(F.lit("Hazard Division")).alias("a"), initials(F.lit("hazard Division")).alias("b"),
        labelled_code(F.lit("Hazard Division"), F.lit("1.1")).alias("c"), labelled_code(F.lit(""), F.lit("1.1")).alias("d"),
    ).first()
    assert (r.a, r.b, r.c, r.d) == ("HD", "", "HD 1.1 (Hazard Division 1.1)", "1.1")


def context_fold(rows, at):
    """Legend, notes, footnotes after row `at`, by the plain walk."""
    legend, notes, foots, on = "", [], [], False
    for kind, text, level, items in rows[at + 1:]:
        if kind == "table":
            break
        if kind == "page_footnote":
            foots += [text] if text else []
        elif kind == "text":
            low = text.lower().rstrip(":")
            if not on and ("legend" in low or low.startswith("x=") or "mixing permitted" in low):
                legend = text
            elif low in ("note", "notes"):
                on = True
            elif (level is not None and level <= 2) or text[:3] in ("1.1", "2.3"):
                break
            elif on and text:
                notes.append(text)
        elif kind == "list" and items:
            on = True
            notes += items
    return legend, notes, foots


def titles_fold(rows, at):
    found = {}
    for kind, text, level, _ in reversed(rows[:at]):
        if kind == "table":
            break
        if kind == "text" and text and level is not None and level not in found:
            found[level] = text
        if len(found) >= 3:
            break
    return list(found.items())


def test_context_equals_the_walk(spark):
    rnd = random.Random(5)
    data = {}
    for s in range(25):
        rows = []
        for i in range(rnd.randint(5, 40)):
            kind = rnd.choice(["text"] * 6 + ["table", "table", "list", "page_footnote"])
            text = rnd.choice([f"body {s} {i}", "Notes:", "note", f"Legend: X {i}", f"x= a{i}", f"1.1 head {i}", ""])
            level = rnd.choice([None, None, None, 1, 2, 3, 4, 6]) if kind == "text" else None
            items = rnd.choice([[], [f"p{i}", f"q{i}"]]) if kind == "list" else []
            rows.append((kind, None if kind == "table" else text, level, items))
        data[f"s{s}"] = [(k, t or "", lv, it) for k, t, lv, it in rows]
    flat = [
        (s, i, 0, k, t if k != "table" else None, lv, it, None, [], "") for s, rows in data.items() for i, (k, t, lv, it) in enumerate(rows)
    ]
    blocks = spark.createDataFrame(flat, BLOCK)
    none = spark.createDataFrame([], "standard_id string, text string, n_pages long")
    for span in (4, 10**6):
        after = {(r.standard_id, r.table_idx): r for r in tb.trailing_context(blocks, none, span).collect()}
        before = {(r.standard_id, r.table_idx): r for r in tb.heading_context(blocks, none, span).collect()}
        for s, rows in data.items():
            for i, (kind, *_) in enumerate(rows):
                if kind == "table":
                    r = after[s, i]
                    assert (r.legend, r.notes, r.footnotes) == context_fold(rows, i)
                    assert [(h.level, h.title) for h in before[s, i].hierarchy] == titles_fold(rows, i)


def merge_fold(units, gap):
    """Groups of table positions by the plain walk over the list."""
    used, groups = set(), []
    for a, u in enumerate(units):
        if a in used or u["unnamed"]:
            continue
        used.add(a)
        head, tail, last = [], [a], u["page"]
        for b in range(a - 1, -1, -1):
            v = units[b]
            if b in used or not v["unnamed"] or v["cols"] != u["cols"] or u["page"] - v["page"] > gap:
                break
            head.insert(0, b)
            used.add(b)
        for b in range(a + 1, len(units)):
            v = units[b]
            fits = (u["stem"] and u["stem"] == v["stem"]) or (v["unnamed"] and v["cols"] == u["cols"])
            if b in used or v["page"] - last > gap or not fits:
                break
            tail.append(b)
            used.add(b)
            last = v["page"]
        groups.append(tuple(head + tail))
    return set(groups) | {(b,) for b in range(len(units)) if b not in used}


def test_fragments_equal_the_walk(spark):
    rnd = random.Random(11)
    rows, want = [], {}
    for s in range(30):
        page, units = 0, []
        for i in range(rnd.randint(1, 15)):
            page += rnd.choice([0, 0, 1, 1, 2])
            kind = rnd.choice(["unnamed", "unnamed", "plain", "paged", "paged"])
            stem = rnd.choice(["T1", "T2"]) if kind == "paged" else ""
            cols = rnd.choice([1, 2])
            name = {"unnamed": f"Table_page{page}", "plain": f"Plain {i}", "paged": f"{stem} (PAGE {i})"}[kind]
            units.append({"unnamed": kind == "unnamed", "stem": stem, "cols": cols, "page": page})
            html = "<table><tr>" + "<td>x</td>" * cols + "</tr></table>"
            rows.append((f"s{s}", i * 10, name, page, html, "", "L" if i % 3 == 0 else "", [f"n{i % 2}"], [f"f{i}"], []))
        want[f"s{s}"] = merge_fold(units, 1)
    schema = ("standard_id string, table_idx long, table_name string, page_idx int, html string, img_path string, legend string, "
              "notes array<string>, footnotes array<string>, hierarchy array<struct<level:int,title:string>>")
    got = tb.stitch_fragments(spark.createDataFrame(rows, schema), 1, span=35).collect()
    names = {(r[0], r[1]): r[2] for r in rows}
    for s, groups in want.items():
        mine = [r for r in got if r.standard_id == s]
        assert {(r.table_idx // 10, len(r.merged_pages or [0])) for r in mine} == {(g[0], len(g)) for g in groups}
        for r in mine:
            g = next(g for g in groups if g[0] == r.table_idx // 10)
            assert r.footnotes == [f"f{i}" for i in g]
            assert r.notes == list(dict.fromkeys(f"n{i % 2}" for i in g))
            named = [names[s, i * 10] for i in g if not names[s, i * 10].startswith("Table_page")]
            if len(g) > 1:
                assert r.table_name == named[0].split(" (PAGE")[0]


def test_units_and_facts(spark):
    long = "<table>" + "".join(f"<tr><td>row {i}</td><td>{i} metres</td></tr>" for i in range(6)) + "</table>"
    empty = "<table>" + "<tr><td></td><td></td><td></td></tr>" * 8 + "</table>"
    rows = [
        ("s", 0, 0, "text", "Storage", 1, [], None, [], ""), ("s", 1, 0, "table", None, None, [], long, [" Limits "], ""),
        ("s", 2, 0, "text", "Notes", None, [], None, [], ""), ("s", 3, 0, "text", "keep dry", None, [], None, [], ""),
        ("s", 4, 1, "table", None, None, [], "<table></table>", [], ""), ("s", 5, 1, "table", None, None, [], empty, [], ""),
    ]
    units, rejected = tb.table_units(spark.createDataFrame(rows, BLOCK))
    u = units.first()
    assert (u.table_name, u.notes, [h.title for h in u.hierarchy]) == ("Limits", ["keep dry"], ["Storage"])
    assert {(r.table_idx, r.reject_reason) for r in rejected.collect()} == {(4, "html_too_short"), (5, "low_fill")}
    one = units.withColumn("table_id", F.lit("t"))
    docs = tb.table_documents(one, tb.table_facts(grid.table_cells(one), one)).first()
    assert docs.serialized.startswith("Limits\nSection: Storage\n\nrow 0: row 1; 0 metres: 1 metres.")
    assert docs.serialized.endswith("Notes:\n- keep dry")


def test_band_is_promoted_once(spark):
    grid_rows = [["Kind", "Distance", "Distance"], ["Kind", "D1", "D2"], ["a", "1", "2 [1]"], ["b", "", "4"]]
    cells = spark.createDataFrame(
        [("t", r, c, t) for r, row in enumerate(grid_rows) for c, t in enumerate(row)], "table_id string, row_idx int, col_idx int, text string"
    )
    notes = spark.createDataFrame([("t", "", ["$^{1}$ in metres"])], "table_id string, legend string, footnotes array<string>")
    facts = [r.fact for r in tb.key_value_facts(cells, notes).orderBy("row_idx").collect()]
    assert facts == ["Distance:", "Kind: a; D1: 1; D2: 2 (in metres).", "Kind: b; D2: 4."]
