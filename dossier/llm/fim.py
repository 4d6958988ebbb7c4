"""Fill-in-the-middle training texts: each text is cut in two places and its middle moved to the end.

Where the cuts fall is asked of a wavelet matrix over character classes. A text's code points fall into four classes:
white space, a character inside a word, the last character of a word, the last white space of a text that ends in white
space. Tokens (white space with the word after it, or white space at the end) end exactly where one of the last two
classes stands, so two rank queries together count the tokens that end before a position; bisection on those ranks finds
the position where a given number of them is reached. One matrix serves a run of texts laid end to end, and all their
cuts are located together.

A null text is empty; a null doc_id counts as an empty number. Every row gives a row, repeated ones too. A text without
tokens, or with a marker in it, stays plain; so does the share that its hash leaves plain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from dossier.llm.common import map_rows, table

# Markers, seed and shares (of 100) of the query's contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
FIM_SHARE = 50
SPM_SHARE = 80

WHITE, INSIDE, WORD_END, TEXT_END = 0, 1, 2, 3
RUN_CHARS = 1 << 20  # code points of one matrix, about; a longer text has one of its own


class WaveletMatrix:
    """Rank over a sequence of small classes: a bit plane for each bit, zeros of a plane before its ones in the next.

    Ranks inside a plane are counts before each word of 64 bits plus the bits of that word up to the position.
    """

    def __init__(self, classes: np.ndarray, bits: int = 2):
        self.bits, self.planes = bits, []
        for level in range(bits - 1, -1, -1):
            plane = (classes >> level) & 1
            packed = np.packbits(plane.astype(np.uint8), bitorder="little")
            words = np.zeros(len(packed) // 8 + 1, "<u8")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            zeros = len(classes) - int(before[-1])
            self.planes.append((words, before, zeros))
            classes = np.concatenate([classes[plane == 0], classes[plane == 1]])

    @staticmethod
    def _ones(plane, at: np.ndarray) -> np.ndarray:
        words, before, _ = plane
        w, b = at >> 6, (at & 63).astype(np.uint64)
        return before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << b) - np.uint64(1)))

    def rank(self, cls: int, at: np.ndarray) -> np.ndarray:
        """How many places before each position of `at` hold the class."""
        low, high = np.zeros_like(at), at
        for level, plane in zip(range(self.bits - 1, -1, -1), self.planes):
            ones_low, ones_high = self._ones(plane, low), self._ones(plane, high)
            if cls >> level & 1:
                low, high = plane[2] + ones_low, plane[2] + ones_high
            else:
                low, high = low - ones_low, high - ones_high
        return high - low


def character_classes(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each code point of texts laid end to end; `ends` are their (exclusive) ends."""
    white = (points == 32) | ((points >= 9) & (points <= 13))
    last = np.zeros(len(points), bool)
    last[ends[ends > np.concatenate([[0], ends[:-1]])] - 1] = True
    stops = last.copy()
    stops[:-1] |= white[1:]
    classes = np.where(white, WHITE, INSIDE).astype(np.uint8)
    classes[~white & stops] = WORD_END
    classes[white & last] = TEXT_END
    return classes


def boundaries(matrix: WaveletMatrix, at: np.ndarray) -> np.ndarray:
    """How many tokens end before each position."""
    return matrix.rank(WORD_END, at) + matrix.rank(TEXT_END, at)


def after_tokens(matrix: WaveletMatrix, starts: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each text the least position after which `wanted` of its tokens have ended, by bisection on ranks."""
    goal = boundaries(matrix, starts) + wanted
    low, high = starts.copy(), ends.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        reached = boundaries(matrix, middle) >= goal
        high = np.where(open_ & reached, middle, high)
        low = np.where(open_ & ~reached, middle + 1, low)
    return low


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits from the SHA-256 of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def assemble(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return prefix + middle + suffix


def restore(output: str, form: str) -> str:
    """The text that `output` was made from. No part of a cut text holds a marker, so the first of each kind parts it."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, _, rest = output[len(first) :].partition(second)
    tail, _, middle = rest.partition(MIDDLE)
    return head + middle + tail if form == "psm" else tail + middle + head


def cut_texts(ids: list[int | None], texts: list[str], seed: int = SEED) -> Iterable[tuple[int, str, str, str, str]]:
    """n, form, prefix, middle, suffix of each text; all cuts of the run come from one matrix."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    matrix = WaveletMatrix(character_classes(points, ends))
    n = boundaries(matrix, ends) - boundaries(matrix, starts)
    drawn = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    first, second = drawn[:, 0] % (n + 1), drawn[:, 1] % (n + 1)
    cut_a = after_tokens(matrix, starts, ends, np.minimum(first, second)) - starts
    cut_b = after_tokens(matrix, starts, ends, np.maximum(first, second)) - starts
    for text, k, a, b, h in zip(texts, n.tolist(), cut_a.tolist(), cut_b.tolist(), drawn.tolist()):
        marked = PREFIX in text or SUFFIX in text or MIDDLE in text
        if not text or marked or h[2] % 100 >= FIM_SHARE:
            form = "plain"
        else:
            form = "spm" if h[3] % 100 < SPM_SHARE else "psm"
        yield k, form, text[:a], text[a:b], text[b:]


def _runs(ids: list, texts: list[str], limit: int) -> Iterable[tuple[list, list[str]]]:
    some_ids, some, size = [], [], 0
    for i, t in zip(ids, texts):
        if some and size + len(t) > limit:
            yield some_ids, some
            some_ids, some, size = [], [], 0
        some_ids.append(i)
        some.append(t)
        size += len(t)
    if some:
        yield some_ids, some


FIM_COLUMNS = "doc_id long, n long, form string, prefix string, middle string, suffix string, output string"


def fill_in_middle(docs: DataFrame, seed: int = SEED, run_chars: int = RUN_CHARS) -> DataFrame:
    """doc_id, n (tokens), form, prefix, middle, suffix (null where plain) and the training text `output`."""

    def make():
        def step(given):
            for ids, texts in _runs(given["doc_id"], [t or "" for t in given["text"]], run_chars):
                found = {c: [] for c in ("doc_id", "n", "form", "prefix", "middle", "suffix", "output")}
                for i, (n, form, *parts) in zip(ids, cut_texts(ids, texts, seed)):
                    kept = [None] * 3 if form == "plain" else parts
                    for c, v in zip(found, (i, n, form, *kept, assemble(form, *parts))):
                        found[c].append(v)
                yield found

        return step

    return map_rows(docs.selectExpr("cast(doc_id as long) doc_id", "text"), FIM_COLUMNS, make, rows=256)


def with_digests(cut: DataFrame) -> DataFrame:
    """The digest columns of the contract: lengths of the cut parts, hashes of the output and of the text rebuilt from it."""

    def make():
        def sha(text):
            return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

        def step(given):
            plain = [f == "plain" for f in given["form"]]
            yield {
                "doc_id": given["doc_id"], "n": given["n"], "form": given["form"],
                "prefix_chars": [None if p else len(t) for p, t in zip(plain, given["prefix"])],
                "middle_chars": [None if p else len(t) for p, t in zip(plain, given["middle"])],
                "output_sha256": [sha(o) for o in given["output"]],
                "restored_sha256": [sha(restore(o, f)) for o, f in zip(given["output"], given["form"])],
            }

        return step

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return map_rows(cut.select("doc_id", "n", "form", "prefix", "middle", "output"), schema, make, rows=256)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digests(fill_in_middle(table(spark, sf_dir, "documents")))


OP13_SQL = r"""
with cut as (select doc_id, coalesce(text, '') as body, sha256('42:' || doc_id) as h,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units from documents),
drawn as (select *, len(units) as n, ('0x' || h[1:8])::bigint % (len(units) + 1) as c1, ('0x' || h[9:16])::bigint % (len(units) + 1) as c2,
  ('0x' || h[17:24])::bigint % 100 as c3, ('0x' || h[25:32])::bigint % 100 as c4 from cut),
parts as (select *, case when body = '' or contains(body, '<P>') or contains(body, '<S>') or contains(body, '<M>') or c3 >= 50 then 'plain'
  when c4 < 80 then 'spm' else 'psm' end as form, array_to_string(units[1:least(c1, c2)], '') as p,
  array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') as m, array_to_string(units[greatest(c1, c2) + 1:], '') as s from drawn)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else body end)
  as output_sha256, sha256(body) as restored_sha256 from parts
"""
