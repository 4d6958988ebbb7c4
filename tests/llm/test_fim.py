import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dossier.llm import fim
from tests.llm.frames import DOCS, crowded, documents, rows

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [
    None, "", " ", " \t\n", "one", " one two  ", "a\x0bb\x0c c", "naïve ü 🙂 x", "has <P> inside", "ends <", "<S", "x<M>", "<<S <P <M",
    "nbsp joins words", "word " * 3000, "\n".join(["line of text"] * 400),
]


def plain_rows(doc_id, text):
    """The contract by regular expression and list slices."""
    text = text or ""
    units = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.lists(st.integers(0, 3), max_size=300))
@settings(max_examples=60, deadline=None)
def test_ranks_equal_counts(classes):
    matrix = fim.WaveletMatrix(np.array(classes, np.uint8))
    at = np.arange(len(classes) + 1)
    for c in range(4):
        assert matrix.rank(c, at).tolist() == [classes[:i].count(c) for i in range(len(classes) + 1)]


@given(st.lists(st.tuples(st.integers(0, 10**12), st.text(alphabet=" \t\x0babü🙂<>PSM", max_size=40)), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_cuts_equal_regular_expression(pairs):
    ids, texts = zip(*pairs)
    for doc_id, text, (n, form, p, m, s) in zip(ids, texts, fim.cut_texts(list(ids), list(texts))):
        want = plain_rows(doc_id, text)
        output = fim.assemble(form, p, m, s)
        assert (n, form, output) == (want[0], want[1], want[4])
        if form != "plain":
            assert (len(p), len(m)) == want[2:4]
        assert p + m + s == text and fim.restore(output, form) == text


@pytest.mark.parametrize("form", ["psm", "spm"])
@pytest.mark.parametrize("parts", [("<", "<S", "<M"), ("a<", "P>", "S>"), ("", "", ""), ("<P", ">", "<"), ("S>", "M>", "P>")])
def test_half_markers_at_cuts_are_restored(form, parts):
    assert fim.restore(fim.assemble(form, *parts), form) == "".join(parts)


@pytest.mark.parametrize("run_chars", [1, 50, 1 << 20])
def test_rows_equal_plain_fold(spark, run_chars):
    docs = documents(spark, TEXTS * 4).unionAll(spark.createDataFrame([(None, "no id", "en", "s", 5), (3, "again", "en", "s", 5), (3, "again", "en", "s", 5)], DOCS))
    found = fim.with_digests(fim.fill_in_middle(crowded(docs), run_chars=run_chars))
    want = []
    for r in docs.collect():
        n, form, p, m, output = plain_rows(r["doc_id"], r["text"])
        want.append((r["doc_id"], n, form, p, m, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    assert found.columns == list(names)
    assert sorted(rows(found, *names), key=str) == sorted(want, key=str)


def test_shares_and_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert fim.with_digests(fim.fill_in_middle(empty)).count() == 0
    forms = [r["form"] for r in fim.fill_in_middle(documents(spark, ["a few words of text"] * 2000)).select("form").collect()]
    assert 0.44 < forms.count("plain") / 2000 < 0.56
    assert 0.33 < forms.count("spm") / 2000 < 0.47
    assert forms.count("psm") > 100
