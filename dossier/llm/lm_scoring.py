"""Scoring texts with a causal self-attention model, trained here in numpy on subword ids.

Tokens are words with A-Z lower-cased and one end. Words become subword ids of a public tokenizer, and the model gives
each id a probability: that of its class, from attention over the ids before it and from the last one alone, times the
id's share of its class, which for frequent ids depends on the class before. Windows of `WINDOW` places overlap by `PAD`: each id is scored once, with at least that many
places before it (ends stand before a text), in batches of masked attention.

What is learned comes from all learning rows: word counts for the base score, subword counts, counts of classes behind
a subword, and attention weights, trained on all consecutive windows of all texts (the padded last ones included). Runs of
up to `RUN` windows are stored by round and cut into windows where these train: they are dealt by hash into rounds, each
about twice as large as the one before, and in a round into groups of about `TASK_WINDOWS` windows, each trained from the
mean of the last round; so weights do not move with partitions. Without any learning row there is
no attention term. Classes, input symbols
and columns of subwords come from the counts of all learning rows too: of subwords, and of the frequent ones on both
sides of each (a table of vocabulary times 512). Texts are cut into subwords once for all counts.

The base score needs the count of every word of every text. Words with large counts, at most `HEAD_WORDS`, are looked up
in each task; all others meet their counts in a join, so that no frequent word gathers anywhere.

Null and empty texts are scored as texts of the end alone. Repeated rows are scored each. Null ids are for scoring only.
"""

from __future__ import annotations

import base64
from array import array
from collections import Counter
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import cut, held_out_row, learning_row, map_rows, plain_words, table

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
WINDOW, STRIDE = 32, 24
PAD = WINDOW - STRIDE
SIZE = 16  # of the vectors
CLASSES, OWN_CLASS, RARE_CLASSES = 64, 24, 4
GROUP = 8  # classes of a group: a class is predicted as its group, then inside it
SYMBOLS = 1024  # inputs told apart: frequent ids, and the classes of all others
FREQUENT = 2048  # ids whose share of their class depends on the class before
SMOOTHING = 8.0
HEAD_WORDS = 200_000
SIDES = 255  # frequent ids that describe the ids beside them; all others are one more
START_WINDOWS = 4_096  # about so many in the first round
TASK_WINDOWS = 8_192
PADDED = 65_535  # stands behind a text in its last window; no id
HELD_CELLS = 1_000_000  # of `sides_of` that a task keeps before they leave it
RUN = 8  # windows that are stored and dealt together
_PIECE = 64  # longest part of a word given to the tokenizer at once, in bytes
_LOG10 = float(np.log(10))


def read_ranks(path: str = TOKENIZER) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Subwords(dict):
    """From a word (UTF-8) to the bytes of its subword ids (uint16); the first `most` words are remembered."""

    def __init__(self, ranks: dict[bytes, int], most: int = 150_000) -> None:
        import tiktoken

        self.encode = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.most = most

    def __missing__(self, word: bytes) -> bytes:
        piece = b" " + word
        if len(piece) <= _PIECE:
            ids = self.encode(piece)
        else:
            ids = [i for at in range(0, len(piece), _PIECE) for i in self.encode(piece[at : at + _PIECE])]
        out = array("H", ids).tobytes()
        if len(self) < self.most:
            self[word] = out
        return out

    def ids(self, texts: list[list[bytes]], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, each with `end` behind it, and their lengths."""
        last = array("H", [end]).tobytes()
        parts = [b"".join(map(self.__getitem__, words)) + last for words in texts]
        return np.frombuffer(b"".join(parts), np.uint16).astype(np.int32), np.array([len(p) // 2 for p in parts], np.int64)


_SUBWORDS: dict[tuple, Subwords] = {}


def subwords_of(ranks: dict[bytes, int]) -> Subwords:
    """One cache for all tasks of a worker process."""
    key = len(ranks), ranks.get(b" the"), ranks.get(b"er")
    if key not in _SUBWORDS:
        _SUBWORDS[key] = Subwords(ranks)
    return _SUBWORDS[key]


def by_count(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids by falling count, and those of them whose class is clustered."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    return order, order[OWN_CLASS:][counts[order[OWN_CLASS:]] >= 3]


def sides_of(x: np.ndarray, lengths: np.ndarray, end: int, order: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells (512 times id, plus the frequent id before it, or 256 and that behind it) and their counts, of ids marked in
    `told`, in texts laid end to end. The end stands before a text."""
    side = np.full(len(order), SIDES, np.int64)
    side[order[:SIDES]] = np.arange(min(SIDES, len(order)))
    before = np.concatenate([[end], x[:-1]])  # a text's last id is the end
    inner = np.ones(len(x), bool)
    inner[np.cumsum(lengths) - 1] = False
    behind = np.flatnonzero(inner)
    cells = np.concatenate([x.astype(np.int64) * 512 + side[before], x[behind].astype(np.int64) * 512 + 256 + side[x[behind + 1]]])
    return np.unique(cells[told[cells // 512]], return_counts=True)


def cluster_classes(texts: list[np.ndarray], vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`classes_of` for texts in memory, each an array of ids that ends in the last id of the vocabulary."""
    flat = np.concatenate(texts) if texts else np.zeros(0, np.int32)
    counts = np.bincount(flat, minlength=vocabulary)
    order, seen = by_count(counts)
    told = np.zeros(vocabulary, bool)
    told[seen] = True
    if not len(flat):
        return classes_of(counts, flat, flat)
    return classes_of(counts, *sides_of(flat, np.array([len(t) for t in texts if len(t)]), vocabulary - 1, order, told))


def classes_of(counts: np.ndarray, cells: np.ndarray, n: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """class, symbol and column of every id, from counts of ids and of `sides_of`. Columns: frequent ids, then the rest of each class."""
    rng = np.random.default_rng(seed)
    vocabulary = len(counts)
    order, seen = by_count(counts)
    classes = (CLASSES - RARE_CLASSES + np.arange(vocabulary) % RARE_CLASSES).astype(np.int32)
    classes[order[:OWN_CLASS]] = np.arange(min(OWN_CLASS, vocabulary))
    k = CLASSES - RARE_CLASSES - OWN_CLASS
    if len(seen) > k:
        # An id is described by the frequent ids on both sides of it.
        at = np.full(vocabulary, -1)
        at[seen] = np.arange(len(seen))
        about = np.zeros((len(seen), 512), np.float32)
        about[at[cells // 512], cells % 512] = n
        about /= about.sum(1, keepdims=True).clip(1)
        np.sqrt(about, out=about)
        centre = about[rng.choice(len(seen), k, replace=False)]
        for _ in range(12):
            group = np.argmax(about @ centre.T - 0.5 * (centre * centre).sum(1), 1)
            for c in range(k):
                if (group == c).any():
                    centre[c] = about[group == c].mean(0)
        classes[seen] = OWN_CLASS + group
    else:
        classes[seen] = OWN_CLASS + np.arange(len(seen))
    symbols = (SYMBOLS - CLASSES + classes).astype(np.int32)
    own = order[: SYMBOLS - CLASSES]
    symbols[own] = np.arange(len(own))
    columns = (FREQUENT + classes).astype(np.int32)
    columns[order[:FREQUENT]] = np.arange(min(FREQUENT, vocabulary))
    return classes, symbols, columns


class Shares:
    """log10 of an id's share of its class, given the class before: a table of columns, and what is left inside a rest."""

    def __init__(self, ids: np.ndarray, pairs: np.ndarray, classes: np.ndarray, columns: np.ndarray) -> None:
        """`ids`: counts by id; `pairs`: counts by class before and column."""
        share = (ids + 1) / np.bincount(classes, ids + 1, CLASSES)[classes]
        rare = columns >= FREQUENT
        column_share = np.bincount(columns, share, FREQUENT + CLASSES)
        of = np.concatenate([np.zeros(FREQUENT, np.int64), np.arange(CLASSES)])
        of[columns[~rare]] = classes[~rare]
        totals = np.stack([np.bincount(of, row, CLASSES) for row in pairs])
        table = (pairs + SMOOTHING * column_share) / (totals[:, of] + SMOOTHING)
        self.table = np.log10(np.maximum(table, 1e-30)).astype(np.float32)
        self.inside = np.where(rare, np.log10(share / column_share[columns]), 0.0).astype(np.float32)
        self.classes, self.columns = classes, columns

    def log(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        at = self.classes[before] * (FREQUENT + CLASSES) + self.columns[target]
        return self.table.ravel().take(at) + self.inside.take(target)


def longest(rows: np.ndarray) -> float:
    return float(np.sqrt(np.einsum("ij,ij->i", rows, rows).max()))


def sums_by(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places that occur, and the sums of their rows: sorted by place, so that each sum is one run."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    at = at.take(order)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.add.reduceat(rows.take(order, 0), first, 0)


def logits_of(logits: np.ndarray, last: np.ndarray, aim: np.ndarray, biases: np.ndarray) -> tuple[np.ndarray, ...]:
    """Logits of each target inside its own group, then those of the groups, in rows of GROUP; those rows' places among
    all such rows; and the target's place in each. `logits` have all classes, then the groups."""
    n = logits.shape[1] // GROUP
    own, rows = aim // GROUP, np.arange(0, len(aim) * n, n)
    pick = np.concatenate([rows + own, rows + (n - 1)])
    part = logits.reshape(-1, GROUP).take(pick, 0)
    last = last * n
    part += biases.take(np.concatenate([last + own, last + (n - 1)]), 0)
    return part, pick, np.concatenate([aim % GROUP, own]) + np.arange(0, len(pick) * GROUP, GROUP)


class AttentionModel:
    """One causal head over symbols, added to the logits of the class behind the last symbol: its group, then inside it."""

    NAMES = ("embed", "wq", "wk", "wv", "near", "out", "groups")

    def __init__(self, follow: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        symbols, classes = follow.shape
        # Log probabilities behind a symbol: of a group, and of a class inside its group (a row for each symbol and group).
        group = np.log(np.exp(follow).reshape(symbols, -1, GROUP).sum(2))
        self.group = group.astype(np.float32)
        self.inside = (follow.reshape(symbols, -1, GROUP) - group[:, :, None]).reshape(-1, GROUP).astype(np.float32)
        shapes = {"embed": (symbols, SIZE), "wq": (SIZE, SIZE), "wk": (SIZE, SIZE), "wv": (SIZE, SIZE), "near": (WINDOW,), "out": (SIZE, classes), "groups": (SIZE, classes // GROUP)}
        scale = {"embed": 0.5, "wq": SIZE**-0.5, "wk": SIZE**-0.5, "wv": SIZE**-0.5, "near": 0.0, "out": 0.05, "groups": 0.05}
        self.p = {n: (rng.normal(size=s) * scale[n]).astype(np.float32) for n, s in shapes.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> AttentionModel:
        at = 0
        for n in self.NAMES:
            self.p[n] = flat[at : at + self.p[n].size].reshape(self.p[n].shape).astype(np.float32)
            at += self.p[n].size
        return self

    def tables(self) -> tuple[np.ndarray, ...]:
        """By symbol: queries, then keys, values and a one; and the causal weights of distances: what windows look up.

        Places from PAD on ask; all places of the window up to their own answer. Exponents stay in range without
        looking for maxima: queries are scaled down where learnt weights could exceed it.
        """
        p = self.p
        far = np.arange(PAD, WINDOW)[:, None] - np.arange(WINDOW)[None, :]
        mask = np.where(far >= 0, np.exp(np.clip(p["near"][far.clip(0)], -20, 20)), 0).astype(p["embed"].dtype)
        both = np.ones((len(p["embed"]), 2 * SIZE + 1), p["embed"].dtype)
        np.matmul(p["embed"], np.concatenate([p["wk"], p["wv"]], 1), out=both[:, :-1])
        q = p["embed"] @ (p["wq"] * np.asarray(SIZE**-0.5, p["wq"].dtype))
        most = longest(q) * longest(both[:, :SIZE])
        return q if most <= 40 else q * np.asarray(40 / most, q.dtype), both, mask

    def biases(self) -> np.ndarray:
        """Rows of GROUP: for each symbol the classes of each group, then the groups."""
        return np.concatenate([self.inside.reshape(len(self.group), -1, GROUP), self.group[:, None]], 1).reshape(-1, GROUP)

    def scoring_tables(self) -> tuple[np.ndarray, ...]:
        """The tables, biases and what attention adds to logits, scaled down likewise."""
        q, both, mask = self.tables()
        out = np.concatenate([self.p["out"], self.p["groups"]], 1)
        most = longest(both[:, SIZE : 2 * SIZE]) * longest(out.T)
        return q, both, mask, self.biases(), out if most <= 40 else out * np.asarray(40 / most, out.dtype)

    def attended(self, s: np.ndarray, tables) -> tuple[np.ndarray, ...]:
        """Of windows of symbols: queries, keys, values with a one, weights, their sums' inverse and the mean values."""
        tq, both, mask = tables
        q, found = tq.take(s[:, PAD:], 0), both.take(s, 0)
        k, v = found[:, :, :SIZE], found[:, :, SIZE:]
        w = np.matmul(q, k.transpose(0, 2, 1))
        np.exp(w, out=w)
        w *= mask
        h = np.matmul(w, v)  # the last column sums the weights
        z = 1 / h[:, :, SIZE:]
        return q, k, v, w, z, h[:, :, :SIZE] * z

    def class_log_probs(self, s: np.ndarray, target: np.ndarray, tables) -> np.ndarray:
        """Log probability of each target class (n x STRIDE) behind windows of symbols (n x WINDOW)."""
        h = self.attended(s, tables[:3])[-1].reshape(-1, SIZE)
        part, _, hit = logits_of(h @ tables[4], s[:, PAD:].ravel(), target.ravel(), tables[3])
        total = part.ravel().take(hit)
        np.exp(part, out=part)
        total -= np.log(part @ np.ones(GROUP, part.dtype))
        return total.reshape(2, -1).sum(0).reshape(target.shape)

    def gradients(self, s: np.ndarray, target: np.ndarray, biases: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over windows and its gradients, by hand. Targets below 0 do not count.

        Slopes of queries, keys and values are summed by symbol first; all else follows from these sums.
        """
        p, g = self.p, {}
        kind, classes = p["embed"].dtype, p["out"].shape[1]
        q, k, v, w, z, h = self.attended(s, self.tables())
        out, flat_h, aim = np.concatenate([p["out"], p["groups"]], 1), h.reshape(-1, SIZE), target.ravel()
        inside_text, aim = aim >= 0, np.maximum(aim, 0)
        counted = max(1, int(np.count_nonzero(inside_text)))
        probs, pick, hit = logits_of(flat_h @ out, s[:, PAD:].ravel(), aim, self.biases() if biases is None else biases)
        most = probs
        while most.shape[1] > 1:
            most = np.maximum(most[:, ::2], most[:, 1::2])
        probs -= most
        np.exp(probs, out=probs)
        probs /= probs @ np.ones((GROUP, 1), kind)
        right = probs.ravel().take(hit)
        loss = -float(np.log(right + 1e-30).reshape(2, -1)[:, inside_text].sum()) / counted
        probs.ravel()[hit] = right - 1
        probs *= np.asarray(1 / counted, kind)
        if counted < len(aim):
            probs.reshape(2, -1, GROUP)[:, ~inside_text] = 0
        wide = np.zeros((len(aim) * out.shape[1] // GROUP, GROUP), kind)
        wide[pick] = probs
        wide = wide.reshape(len(aim), -1)
        by_class = flat_h.T @ wide
        g["out"], g["groups"] = by_class[:, :classes], by_class[:, classes:]
        # The slope of a weight is itself times that of its value less that of the mean: one product, the mean's behind it.
        dh = np.empty((*h.shape[:2], SIZE + 1), kind)
        dh[:, :, :SIZE] = (wide @ out.T).reshape(h.shape)
        dh[:, :, SIZE] = -np.einsum("bij,bij->bi", dh[:, :, :SIZE], h)
        dh *= z
        ds = np.matmul(dh, v.transpose(0, 2, 1))
        ds *= w
        far = np.arange(PAD, WINDOW)[:, None] - np.arange(WINDOW)[None, :]
        total = (np.ones(len(s), kind) @ ds.reshape(len(s), -1)).reshape(far.shape)
        g["near"] = np.bincount(far[far >= 0], total[far >= 0], WINDOW).astype(p["near"].dtype)
        d = np.empty((*s.shape, 3 * SIZE), kind)
        d[:, :PAD, :SIZE] = 0
        np.matmul(ds, k, out=d[:, PAD:, :SIZE])
        np.matmul(ds.transpose(0, 2, 1), q, out=d[:, :, SIZE : 2 * SIZE])
        np.matmul(w.transpose(0, 2, 1), dh[:, :, :SIZE], out=d[:, :, 2 * SIZE :])
        seen, d = sums_by(s.ravel(), d.reshape(-1, 3 * SIZE))
        d[:, :SIZE] *= np.asarray(SIZE**-0.5, kind)
        by_place = p["embed"].take(seen, 0).T @ d
        g["wq"], g["wk"], g["wv"] = (by_place[:, at : at + SIZE] for at in range(0, 3 * SIZE, SIZE))
        g["embed"] = np.zeros_like(p["embed"])
        g["embed"][seen] = d @ np.concatenate([p["wq"], p["wk"], p["wv"]], 1).T
        return loss, g

    def train(self, s: np.ndarray, target: np.ndarray, epochs: int, rate: float, batch: int = 64, seed: int = 1) -> float:
        """Adam over shuffled batches; the mean loss of the last epoch."""
        rng, t, biases = np.random.default_rng(seed), 0, self.biases()
        all_p, losses = self.flat(), [0.0]
        m, v, at = np.zeros_like(all_p), np.zeros_like(all_p), 0
        for n in self.NAMES:  # now parts of one array, moved together
            self.p[n] = all_p[at : at + self.p[n].size].reshape(self.p[n].shape)
            at += self.p[n].size
        for _ in range(epochs):
            losses = []
            order = rng.permutation(len(s))
            for at in range(0, len(s), batch):
                part = order[at : at + batch]
                loss, g = self.gradients(s[part], target[part], biases)
                losses.append(loss)
                t += 1
                x = np.concatenate([g[n].ravel() for n in self.NAMES])
                m += 0.1 * (x - m)
                v += 0.01 * (x * x - v)
                down = np.sqrt(v / np.float32(1 - 0.99**t))
                down += np.float32(1e-7)
                all_p -= np.float32(rate / (1 - 0.9**t)) * m / down
        return float(np.mean(losses))


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and start (in its targets) of each window of texts of these lengths; a window scores STRIDE targets."""
    n = -(-lengths // STRIDE)
    return np.repeat(np.arange(len(lengths)), n), (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE


def behind(lengths: np.ndarray) -> np.ndarray:
    """Places in the inputs of the id before each target."""
    return np.arange(lengths.sum()) + np.repeat(PAD * (np.arange(len(lengths)) + 1), lengths)


def inputs_of(target: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of texts laid end to end, each behind PAD + 1 ends and without its last id, and where each begins."""
    n = len(lengths)
    given = np.full(len(target) + PAD * n, end, np.int32)
    at = np.arange(len(target)) + np.repeat(PAD * (np.arange(n) + 1) + 1, lengths)
    inner = np.ones(len(target), bool)
    inner[np.cumsum(lengths) - 1] = False
    given[at[inner]] = target[inner]
    return given, np.cumsum(lengths) - lengths + PAD * np.arange(n)


class Scorer:
    """log10 probabilities of texts given as ids that end in `end`."""

    def __init__(self, model: AttentionModel, symbols: np.ndarray, shares: Shares, end: int) -> None:
        self.model, self.classes, self.symbols, self.shares, self.end = model, shares.classes, symbols, shares, end
        self.tables = model.scoring_tables()

    def score(self, target: np.ndarray, lengths: np.ndarray, batch: int = 128) -> np.ndarray:
        total = np.zeros(len(lengths))
        if not len(lengths):
            return total
        given, begin = inputs_of(target, lengths, self.end)
        first = np.cumsum(lengths) - lengths
        s, c = self.symbols.astype(np.intp)[given], self.classes.astype(np.intp)[target]
        before = given[behind(lengths)]
        total += np.add.reduceat(self.shares.log(before, target), first, dtype=float)
        owner, start = windows_of(lengths)
        here, there = np.arange(STRIDE), np.arange(WINDOW)
        for at in range(0, len(owner), batch):
            o, st = owner[at : at + batch], start[at : at + batch]
            inside = st[:, None] + here < lengths[o][:, None]
            take = np.minimum((begin[o] + st)[:, None] + there, len(s) - 1)
            aims = np.where(inside, (first[o] + st)[:, None] + here, 0)
            logp = self.model.class_log_probs(s[take], c[aims], self.tables)
            logp[~inside] = 0
            total += np.bincount(o, logp.sum(1, dtype=float), len(lengths)) / _LOG10
        return total


def read(train: DataFrame, ranks) -> DataFrame:
    """What all learning rows give, in rows of three kinds: (word, n), (id, n) and (doc_id, ids): a text's ids with their end."""
    end = len(ranks)
    sent = train.sparkSession.sparkContext.broadcast(ranks)

    def make():
        words: Counter[bytes] = Counter()
        subwords = subwords_of(sent.value)
        counts = np.zeros(end + 1, np.int64)

        def flush():
            out = {"word": list(words), "n": list(words.values())}
            words.clear()
            return out | dict.fromkeys(("id", "doc_id", "ids"), [None] * len(out["n"]))

        def step(given):
            own = [plain_words(t) for t in given["text"]]
            for w in own:
                words.update(w)
            words[b""] += len(own)
            x, lengths = subwords.ids(own, end)
            counts[:] += np.bincount(x, minlength=len(counts))
            none = [None] * len(own)
            ids = [p.astype(np.uint16).tobytes() for p in np.split(x, np.cumsum(lengths)[:-1])]
            yield {"word": none, "id": none, "n": none, "doc_id": given["doc_id"], "ids": ids}
            if len(words) > 250_000:
                yield flush()

        def rest():
            yield flush()
            at = np.flatnonzero(counts)
            none = [None] * len(at)
            yield {"word": none, "id": at, "n": counts[at], "doc_id": none, "ids": none}

        step.rest = rest
        return step

    return map_rows(train.select("doc_id", "text"), "word binary, id int, n long, doc_id long, ids binary", make)


def _laid(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts laid end to end, and their lengths."""
    return np.frombuffer(b"".join(rows), np.uint16).astype(np.int32), np.array([len(r) // 2 for r in rows], np.int64)


def summed(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sums of n by id, for ids of a bounded table."""
    t = rows.groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    return t["id"].to_numpy(), t["n"].to_numpy()


def learnt_classes(texts: DataFrame, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`classes_of` for all texts, given as ids: every task sums the cells it saw, at most
    HELD_CELLS at a time."""
    order, seen = by_count(counts)
    told = np.zeros(len(counts), bool)
    told[seen] = True
    sent = texts.sparkSession.sparkContext.broadcast((order, told))

    def make():
        order, told = sent.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            cells = np.concatenate([c for c, _ in held])
            cells, at = np.unique(cells, return_inverse=True)
            held[:] = [(cells, np.bincount(at, np.concatenate([n for _, n in held]), len(cells)).astype(np.int64))]

        def rest():
            if held:
                merged()
                (cells, n), = held
                held.clear()
                for start in range(0, len(cells), 1 << 18):
                    yield {"id": cells[start : start + (1 << 18)], "n": n[start : start + (1 << 18)]}

        def step(given):
            held.append(sides_of(*_laid(given["ids"]), len(order) - 1, order, told))
            if sum(len(c) for c, _ in held) > HELD_CELLS:
                merged()
                if len(held[0][0]) > HELD_CELLS // 2:
                    yield from rest()

        step.rest = rest
        return step

    return classes_of(counts, *summed(map_rows(texts.select("ids"), "id int, n long", make)))


def gather(texts: DataFrame, classes: np.ndarray, symbols: np.ndarray, columns: np.ndarray) -> DataFrame:
    """What all texts, given as ids, say of the model, in rows of two kinds: (id, n) and (doc_id, start, window).

    id is a pair of symbol and following class; then come pairs of class and following column. Up to RUN windows behind
    each other are one row, with their text's doc_id and their place in it: the inputs of the first, then all targets.
    """
    end = len(classes) - 1
    sent = texts.sparkSession.sparkContext.broadcast((classes, symbols, columns))

    def make():
        classes, symbols, columns = sent.value
        width = FREQUENT + CLASSES
        pairs, shares = np.zeros(SYMBOLS * CLASSES, np.int64), np.zeros(CLASSES * width, np.int64)

        def step(given):
            x, lengths = _laid(given["ids"])
            before, begin = inputs_of(x, lengths, end)
            first = np.cumsum(lengths) - lengths
            last = before[behind(lengths)]
            pairs[:] += np.bincount(symbols[last] * CLASSES + classes[x], minlength=len(pairs))
            shares[:] += np.bincount(classes[last] * width + columns[x], minlength=len(shares))
            x, before = x.astype(np.uint16), before.astype(np.uint16)
            doc, start, window = [], [], []
            for d, n, at, here in zip(given["doc_id"], lengths.tolist(), first.tolist(), begin.tolist()):
                for k in range(0, n, RUN * STRIDE):
                    head = before[here + k : min(here + k + WINDOW, here + n + PAD)]
                    head = np.pad(head, (0, WINDOW - len(head)), constant_values=end)  # not the next text's
                    doc.append(d)
                    start.append(k)
                    window.append(head.tobytes() + x[at + k : at + min(n, k + RUN * STRIDE)].tobytes())
            none = [None] * len(doc)
            yield {"id": none, "n": none, "doc_id": doc, "start": start, "window": window}

        def rest():
            both = np.concatenate([pairs, shares])
            at = np.flatnonzero(both)
            none = [None] * len(at)
            yield {"id": at, "n": both[at], "doc_id": none, "start": none, "window": none}

        step.rest = rest
        return step

    return map_rows(texts, "id int, n long, doc_id long, start long, window binary", make)


def _window_arrays(rows: list[bytes], classes, symbols) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and target classes of the windows of runs; -1 behind a text, where inputs are ends."""
    end, parts = len(classes) - 1, []
    for r in rows:
        x = np.frombuffer(r, np.uint16)
        n = -(-(len(x) - WINDOW) // STRIDE)
        line = np.full(n * STRIDE + PAD + 1, PADDED, np.uint16)
        line[: PAD + 1] = x[: PAD + 1]
        line[PAD + 1 : PAD + 1 + len(x) - WINDOW] = x[WINDOW:]
        parts.append(np.lib.stride_tricks.sliding_window_view(line, WINDOW + 1)[::STRIDE])
    x = np.concatenate(parts).astype(np.intp)
    inputs, aims = np.where(x == PADDED, end, x)[:, :WINDOW], x[:, PAD + 1 :]
    return symbols.astype(np.intp)[inputs], np.where(aims == PADDED, -1, classes.astype(np.intp)[np.minimum(aims, end)])


def windows_in(targets):
    return F.ceil(targets / STRIDE)


def rounds_of(n: int) -> int:
    """Rounds of training over n windows."""
    return max(1, int(np.ceil(np.log2(n / START_WINDOWS + 1))))


def round_of(rounds: int):
    """The round of a run: round k has 2**k of 2**rounds - 1 equal parts of all."""
    at = F.pmod(F.xxhash64("doc_id", "start", "window"), F.lit(1 << 40))
    edges = [(1 << 40) * ((1 << k) - 1) // ((1 << rounds) - 1) for k in range(1, rounds)]
    return sum(((at >= e).cast("int") for e in edges), F.lit(0))


def trained(windows: DataFrame, model: AttentionModel, classes: np.ndarray, symbols: np.ndarray) -> AttentionModel:
    """Rounds of training over all windows (doc_id, start, window; round, if they are stored by it); a round's groups start
    from the mean of the last one's."""
    if "round" not in windows.columns:
        n = windows.agg(F.sum(windows_in(F.length("window") / 2 - WINDOW))).first()[0] or 0
        windows = windows.withColumn("round", round_of(rounds_of(n)))
    sizes = {r["round"]: r["n"] for r in windows.groupBy("round").agg(F.sum(windows_in(F.length("window") / 2 - WINDOW)).alias("n")).collect()}
    if not sizes:
        model.p["out"][:] = 0
        model.p["groups"][:] = 0
        return model
    for k in sorted(sizes):
        groups = max(1, round(sizes[k] / TASK_WINDOWS))
        sent = windows.sparkSession.sparkContext.broadcast((model, classes, symbols))
        epochs, rate = (6, 0.01) if k == 0 else (1, 0.002)

        def learn(given):
            import copy

            base, classes, symbols = sent.value
            own = copy.deepcopy(base)
            rows = given.sort_by([("place", "ascending"), ("window", "ascending")])["window"].to_pylist()
            s, c = _window_arrays(rows, classes, symbols)
            own.train(s, c, epochs=epochs, rate=rate)
            # As whole numbers: their sums do not depend on the order, which training would amplify.
            w = np.rint(own.flat().astype(float) * (1 << 24)).astype(np.int64) * len(s)
            return pa.table({"at": np.arange(len(w), dtype=np.int32), "value": w, "n": np.full(len(w), len(s), np.int64)})

        part = windows.where(F.col("round") == k).select(F.xxhash64("doc_id", "start", "window").alias("place"), "window")
        part = part.select(F.pmod(F.xxhash64("place"), F.lit(groups)).alias("g"), "place", "window")
        parts = part.groupBy("g").applyInArrow(learn, "at int, value long, n long")
        mean = parts.groupBy("at").agg((F.sum("value") / F.sum("n") / (1 << 24)).alias("w")).toArrow()
        if mean.num_rows:
            model.load(mean.sort_by("at")["w"].to_numpy())
    return model


def score_texts(docs: DataFrame, train: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score. `train` has the learning rows."""
    spark = docs.sparkSession
    context = spark.sparkContext
    ranks = read_ranks(tokenizer)
    end = len(ranks)

    # 1. Words and subwords of all learning rows, in one pass over their texts.
    found = cut(read(train, ranks))
    counts = cut(found.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")))
    n_all, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ids = np.zeros(end + 1, np.int64)
    at, n = summed(found.where("id is not null"))
    ids[at] = n

    # 2. Classes from what stands beside each subword, then counts of the model's size and windows.
    texts = found.where("ids is not null").select("doc_id", "ids")
    classes, symbols, columns = learnt_classes(texts, ids)
    n = texts.agg(F.sum(windows_in(F.length("ids") / 2))).first()[0] or 0
    found = cut(gather(texts, classes, symbols, columns).withColumn("round", round_of(rounds_of(n))), "round")
    tally = np.zeros(SYMBOLS * CLASSES + CLASSES * (FREQUENT + CLASSES))
    at, n = summed(found.where("id is not null"))
    tally[at] = n
    pairs, shares = np.split(tally, [SYMBOLS * CLASSES])
    pairs, shares = pairs.reshape(SYMBOLS, CLASSES), Shares(ids, shares.reshape(CLASSES, -1), classes, columns)
    overall = (pairs.sum(0) + 1) / (pairs.sum() + CLASSES)
    follow = np.log((pairs + 5 * overall) / (pairs.sum(1, keepdims=True) + 5))
    model = trained(found.where("window is not null").select("doc_id", "start", "window", "round"), AttentionModel(follow), classes, symbols)

    # 3. Words with large counts, so many that at most HEAD_WORDS are sent to the tasks.
    sizes = {int(r["b"]): r["n"] for r in counts.groupBy((F.length(F.bin("c")) - 1).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, room = max(sizes, default=0) + 1, HEAD_WORDS
    while least > 0 and sizes.get(least - 1, 0) <= room:
        least -= 1
        room -= sizes.get(least, 0)
    is_head = F.col("c") >= F.lit(1 << least)
    head = {bytes(r["word"]): r["c"] for r in counts.where(is_head).toLocalIterator()}
    sent = context.broadcast((ranks, {w: float(np.log10(c + 1)) for w, c in head.items()}, (model, symbols, shares, end)))

    def make_scores():
        ranks, head, parts = sent.value
        subwords, scorer = subwords_of(ranks), Scorer(*parts)

        def step(given):
            out = {n: [] for n in ("n_tokens", "sum", "n_known", "words", "counts")}
            own = [plain_words(t) for t in given["text"]]
            find, last = head.get, head.get(b"")
            for words in own:
                logs = list(map(find, words))
                tail = Counter([w for w, log in zip(words, logs) if log is None])
                ends = [] if last is None else [last]
                out["n_tokens"].append(len(words) + 1)
                out["n_known"].append(len(words) - tail.total() + len(ends))
                out["sum"].append(fsum([*filter(None, logs), *ends]))  # a known word's log is above 0
                if last is None:
                    tail[b""] = 1
                out["words"].append(list(tail))
                out["counts"].append(list(tail.values()))
            yield {"doc_id": given["doc_id"], "row": given["row"], "score": scorer.score(*subwords.ids(own, end)), **out}

        return step

    schema = "doc_id long, row long, score double, n_tokens long, sum double, n_known long, words array<binary>, counts array<int>"
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    scored = cut(map_rows(numbered, schema, make_scores, rows=128))

    # 4. All other words meet their counts.
    tail = scored.select("row", F.explode(F.arrays_zip("words", "counts")).alias("r"))
    tail = tail.select("row", F.col("r.words").alias("word"), F.col("r.counts").alias("n"))
    met = tail.join(counts.where(~is_head), "word").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("tail_sum"), F.sum("n").alias("tail_known")
    )
    below = float(np.log10(n_all + n_distinct + 1))
    return scored.drop("words", "counts").join(met, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("sum") + F.coalesce("tail_sum", F.lit(0.0)) - F.col("n_tokens") * below).alias("base_score"), "score",
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, docs.where(learning_row(7, 2)))
    return scored.select("doc_id", held_out_row(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
