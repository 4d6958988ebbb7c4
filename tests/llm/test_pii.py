import hashlib
import random
import re

from dossier.llm import pii
from tests.llm.frames import DOCS, crowded, documents

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, text):
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if valid(kind, m.group())]
    return sorted(found)


TEXTS = [
    None, "", "mail a.b+c@x-y.example.com, then a@b@c.de and a@b.c@d.e @ x@y", "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 1.2.3 007.1.1.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4041894974608795", "+1 (988) 555-2485 +1+49 30 123456789- +12 +1 2345678901234567",
    "é@é.com naïve ü.x@ü.de 🙂 z@q.org", "٣٤٥.١.١.١ 1.1.1.1", "password=hunter22 iban GB82 WEST 1234 5698 7654 32 SSN: 123-45-6789",
    "http://user:pw12@host.example/x?y http://plain.example/", "9" * 4000 + "." + "1.1.1", "@" * 3000, "+" * 500 + "1-2", "a" * 3000 + "@b",
]


def test_long_parts_of_a_chain():
    assert pii.digest(pii.Finder().spans("1.2.3." + "0" * 5000 + "4")).startswith("ip:0:")
    assert not any(s[1] == 1 for s in pii.Finder().spans("1.2.3." + "0" * 5000 + "256"))


def test_base_spans_equal_plain_search_on_odd_texts():
    finder = pii.Finder()
    rng = random.Random(4)
    made = ["".join(rng.choice("ab@.+-% 0123456789()4\n:/") for _ in range(rng.randint(0, 120))) for _ in range(3000)]
    for text in TEXTS + made:
        assert [s for s in finder.spans(text) if s[1] < 4] == base_spans(text), text


def test_query_rows(spark):
    docs = crowded(documents(spark, TEXTS + TEXTS[:3]))
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert len(got) == len(TEXTS) + 3
    for i, text in enumerate(TEXTS + TEXTS[:3]):
        want = base_spans(text)
        joined = pii.digest(want)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(s[1] == k for s in want) for k in range(4)]
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(got[i]["spans"].split(","))
    assert "account" in got[8]["spans"] and got[8]["n_added"] == 3 and "url" in got[9]["spans"] and got[9]["n_added"] == 1
    assert pii.find_pii(spark.createDataFrame([], DOCS)).count() == 0


def test_redaction_keeps_rows_and_columns(spark):
    docs = crowded(documents(spark, TEXTS))
    out = {r["doc_id"]: r for r in pii.redact_pii(docs).collect()}
    assert pii.redact_pii(docs).columns == docs.columns and len(out) == len(TEXTS)
    assert out[0]["text"] is None and out[1]["text"] == ""
    assert out[4]["text"] == "card [CARD] and 4111-1111-1111-1112, [CARD]" and out[4]["n_chars"] == len(out[4]["text"])
    finder = pii.Finder()
    for i in range(2, 10):
        assert not [s for s in finder.spans(out[i]["text"]) if s[1] == 0]
