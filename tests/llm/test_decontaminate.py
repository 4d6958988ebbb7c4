import hashlib
import random
import re

from dossier.llm import decontaminate as d
from tests.llm.frames import DOCS, crowded, rows

ITEMS = "item_id long, text string"


def words(text):
    lower = re.sub(r"[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, items, width=10):
    own = words(text)
    hit, found = set(), set()
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - width + 1)) if w else ():
            window = w[i : i + width]
            for at in range(len(own) - len(window) + 1):
                if own[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    found.add(str(item))
    ids = ",".join(sorted(found))
    return len(own), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def sample(seed=2):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "é", "a1", "x-y", "Zoo", "the", "end", "mid", "low"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 9, 10, 11, 14]))) for i in range(12)] + [(20, None), (21, ""), (22, "rare word"), (3, "the second text of three")]
    items.append((30, items[4][1]))
    texts = [say(rng.randint(0, 60)) for _ in range(30)] + [None, "", "...", "Rare, WORD!", "rare  words"]
    texts += [f"{say(5)} {items[i][1]} {say(3)}" for i in range(6)] + [texts[0], items[5][1] * 3]
    return texts, items


def test_against_brute_force(spark, monkeypatch):
    texts, items = sample()
    docs = crowded(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS))
    bench = crowded(spark.createDataFrame(items, ITEMS))
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = [(i, *brute(t, items)) for i, t in enumerate(texts)]
    assert rows(d.decontaminate(docs, bench), *names) == want
    monkeypatch.setattr(d, "SENT_WORDS", 2)  # too many words to send: all are joined
    assert rows(d.decontaminate(docs, bench), *names) == want
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id") == [(w[0],) for w in want if not w[-1]]


def test_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "rare word here", "en", "s", 0), (1, "clean", "en", "s", 0), (None, "rare word", "en", "s", 0), (1, "clean", "en", "s", 0)], DOCS)
    bench = spark.createDataFrame([(7, "rare word")], ITEMS)
    assert rows(d.decontaminate(docs, bench), "doc_id", "n_hit") == [(None, 2), (1, 0), (1, 0), (1, 2)]
    assert rows(d.drop_contaminated(docs, bench), "text") == [("clean",), ("clean",)]
    assert d.decontaminate(spark.createDataFrame([], DOCS), bench).count() == 0
    assert {r["contaminated"] for r in d.decontaminate(docs, spark.createDataFrame([], ITEMS)).collect()} == {False}
