import math
import re

import pytest

from dossier.llm import html_text as ht
from dossier.llm.html_text import main_text
from tests.llm.frames import crowded, rows

LONG = [f"Paragraph number {i} goes on, with commas, and says something longer about the matter at hand. It ends here." for i in range(6)]
BODY = "".join(f"<p>{t}</p>" for t in LONG)
WANT = "\n\n".join(LONG)
NAV = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Contact us", "Imprint")) + "</ul>"


def page(inner, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{inner}</body></html>"


def test_article_without_what_stands_around_it():
    got = main_text(page(
        f"<header><h1>Site</h1></header><nav>{NAV}</nav><!-- x <p>no</p> --><div class='ad'>Buy, now. Cheap.</div><article><h1>Title</h1>{BODY}"
        f"<ul><li>first</li><li>second</ul></article><aside><p>{LONG[0]}</p></aside><section id='comments'><p>{LONG[1]}</p></section>"
        f"<div class='cookie-notice'>We use cookies, really.</div><form><p>Your name</p><input></form><footer>&copy; x. y.</footer>"
        f"<script>var a='</p><p>no'</script><style>p{{}}</style>"
    ))
    assert got == "\n\n".join(["Title", *LONG, "first", "second"])


def test_pages_without_names_are_parted_by_ratios():
    got = main_text(page(f"<div>{NAV}</div><div><h1>Title</h1>{BODY}<p>Short.</p></div><div><span>All rights reserved</span></div>"))
    assert got == "\n\n".join(["Title", *LONG, "Short."])


def test_links_inside_an_article_are_left_out_and_in_text_kept():
    got = main_text(page(f"<article>{BODY}<p>See <a href='x'>this, there.</a></p><ul><li><a>Other</a></li><li><a>More</a></li></ul></article>"))
    assert got == WANT + "\n\nSee this, there."


def test_missing_ratios_change_the_result(monkeypatch):
    tags = "".join(f"<li>topic {i} of many</li>" for i in range(100))  # more text than the article, in scraps
    source = page(f"<div>{NAV}</div><div>{BODY}</div><div><ul>{tags}</ul></div>")
    assert main_text(source) == WANT
    monkeypatch.setattr(ht.PathRatios, "score", property(lambda self: 1.0))
    assert main_text(source) != WANT


def test_ratios_equal_plain_sums():
    read = ht.read_page(page(f"<div>{NAV}</div><div><h2>Head, line</h2>{BODY}</div>"))
    kernel = {d: math.exp(-d * d / 2) for d in range(3)}
    sums = {}
    for b in read.blocks:
        s = sums.setdefault(b.path, [0, 0, 0])
        s[0] += 1
        s[1] += len(b.text) - b.links
        s[2] += len(re.findall("[.,;:!?]", b.text))
    raw = [[sums[b.path][1] / sums[b.path][0], (sums[b.path][2] + 1) / sums[b.path][0]] for b in read.blocks]
    smooth = []
    for i in range(len(raw)):
        near = [(kernel[abs(i - j)], raw[j]) for j in range(len(raw)) if abs(i - j) < 3]
        smooth.append([sum(w * v[k] for w, v in near) / sum(w for w, _ in near) for k in range(2)])
    found = ht.path_ratios(read.blocks)
    for path, (n, _, _) in sums.items():
        mean = [sum(s[k] for s, b in zip(smooth, read.blocks) if b.path == path) / n for k in range(2)]
        outside = sum(len(b.text) - b.links for b in read.blocks if b.path == path) / sum(len(b.text) for b in read.blocks if b.path == path)
        assert found[path].score == pytest.approx(math.sqrt(mean[0] * mean[1] * outside), rel=1e-3)


@pytest.mark.parametrize("source, want", [
    (None, ""), ("", ""), ("just words", "just words"), ("a < b & c", "a < b & c"), ("<p>un<b>closed", "unclosed"),
    ("<p>a\n\t b&nbsp;&amp; c&#33;<br>d</p>", "a b & c! d"), ("<p>one<p>two", "one\n\ntwo"), ("</p></div>x</body>", "x"),
    ("<script>only</script>", ""), ("<p title='a>b'>x</p><p hidden>y</p>", "x"), ("<nav>menu</nav>", ""),
    ("<div class='content-with-sidebar'><p>Kept, yes.</p></div>", "Kept, yes."), ("<div class='sidebar'>all there is</div>", "all there is"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"), ("<p>x</p><!-- open", "x"), ("<P CLASS=Ad>no, no.</P><P>Yes, yes.</P>", "Yes, yes."),
    ("<article><header><p>by</p><h1>Head</h1></header><p>Text, here.</p><footer>end</footer></article>", "Head\n\nText, here."),
])
def test_small_and_broken_pages(source, want):
    assert main_text(source) == want


def test_very_long_and_deep_pages():
    many = "".join(f"<p>Line {i}, of many.</p>" for i in range(20000))
    assert main_text(page(f"<article>{many}</article>")).count("\n\n") == 19999
    assert main_text("<div>" * 3000 + "Deep, text." + "</div>" * 3000) == "Deep, text."
    assert len(main_text("<article><p>" + "word, " * 200000 + "</p></article>")) == 1199999


def test_table(spark):
    given = [(1, "u", page(f"<article>{BODY}</article>")), (1, "u", page(f"<article>{BODY}</article>")), (None, None, None), (2, "v", "")]
    df = spark.createDataFrame(given, "page_id long, url string, html string")
    found = rows(ht.extract_text(crowded(df)), "page_id", "url", "text", "n_chars")
    assert found == [(None, None, "", 0), (1, "u", WANT, len(WANT)), (1, "u", WANT, len(WANT)), (2, "v", "", 0)]
    assert ht.extract_text(df.limit(0)).count() == 0
