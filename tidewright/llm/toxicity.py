"""Toxicity by a learned lexicon, matched through Levenshtein automata, and the context of each match.

From labelled rows (never the held-out ones) words are learned that mark toxic texts, counted by
their distinct left neighbours, so that copies of one text don't lend a word support. A word's misspellings
count unless those seen in the labelled rows stand in harmless texts. The lexicon is a trie; its intersection with the Levenshtein automata of a corpus word is walked as one automaton whose
states are sets of (trie node, edits spent), made deterministic as words ask for them. Each match is
weighed by a window of words around it: between an opening and a closing quotation mark that both stand in the window, after a
reporting verb, next to an address in the second person. A logistic model over these counts gives the score.

Labels serve for fitting alone: at most about ``sample`` labelled rows, drawn by a hash, everything else
covers all rows. Null and empty texts have no matches and get the score of a text without any; without
labels of both classes every score is the smoothed share of toxic labels. Several labels of one document
count as toxic if any does. Each input row gives one row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_column, chunks, kept, materialize, pieces

SAMPLE = 8000
#: Words around a match that are its context.
WINDOW = 6
#: Verbs that report speech, and second-person words, of the corpus's languages.
REPORTING = frozenset(
    "said says say wrote writes called calls quoted quotes quote cited reported posted tweeted term word dit écrit appelle mot sagte sagt schrieb wort nannte dijo dice escribió palabra llamó".split()
)
ADDRESS = frozenset("you your you're youre u ur ye tu toi vous ton du dich dein ihr sie tú usted eres".split())
QUOTES = "\"“”«»„‟‹›"
TRIM = ".,;:!?()[]{}<>'’‘`*_~-…|#$%&" + QUOTES
_QUOTES, _STARTS, _ENDS = frozenset(QUOTES), "([{*_~-", ".,;:!?)]}*_~-…|#$%&"
FEATURES = ("hits", "quoted", "addressed", "any", "rate")
#: What a misspelled term counts beside an exact one.
MISSPELLED = 0.8
MOST_CACHED = 300_000
_FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def edits_allowed(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 8 else 2


class Automaton(dict):
    """Word -> edits to the nearest lexicon word, or -1. A trie under Levenshtein edits, determinised as needed.

    ``words`` maps each lexicon word to the edits it is allowed.
    """

    def __init__(self, words: dict[str, int]):
        self.next, self.ends, self.budget = [{}], [None], [0]
        for w in sorted(words):
            node = 0
            for c in w:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                    self.budget.append(0)
                node = self.next[node][c]
                self.budget[node] = max(self.budget[node], words[w])
            self.ends[node] = (words[w], w)
            self.budget[0] = max(self.budget[0], words[w])
        self.states: list[dict[int, int]] = []
        self.ids: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, str]] = []
        self.start = self._state({0: 0})

    def _state(self, cost: dict[int, int]) -> int:
        todo = list(cost)
        while todo:  # letters of the lexicon word that are left out
            node = todo.pop()
            for to in self.next[node].values():
                if cost[node] + 1 <= self.budget[to] and cost[node] + 1 < cost.get(to, 99):
                    cost[to] = cost[node] + 1
                    todo.append(to)
        if not cost:
            return -1
        key = frozenset(cost.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(dict(cost))
            self.moves.append({})
            self.accepts.append(min(((d, self.ends[n][1]) for n, d in cost.items() if self.ends[n] and d <= self.ends[n][0]), default=(-1, "")))
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        cost: dict[int, int] = {}
        for node, d in self.states[state].items():
            for letter, to in self.next[node].items():
                e = d + (letter != c)
                if e <= self.budget[to] and e < cost.get(to, 99):
                    cost[to] = e
            if d + 1 <= self.budget[node] and d + 1 < cost.get(node, 99):  # a letter too many
                cost[node] = d + 1
        out = self.moves[state][c] = self._state(cost)
        return out

    def match(self, word: str) -> tuple[int, str]:
        """The least edits and the lexicon word they lead to, or -1."""
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return -1, ""
        return self.accepts[state]

    def __missing__(self, raw: str) -> int:
        d = self.match(raw.strip(TRIM))[0]
        if len(raw) <= 48:
            if len(self) >= MOST_CACHED:
                self.clear()
            self[raw] = d
        return d


def words_of(text: bytes) -> list[str]:
    return [w.decode() for w in text.lower().split()]  # bytes.lower() folds A-Z alone


def within_quotes(around: list[str], at: int) -> bool:
    """Whether the word at ``at`` stands between a mark that opens a quotation and one that closes it, both among the words around.

    A mark at a word's start opens, one at its end closes; the nearest mark on each side decides, so that a stray mark quotes nothing.
    """
    opened = closed = False
    for k in range(at, -1, -1):
        w = around[k].rstrip(_ENDS)
        if k < at and w and w[-1] in QUOTES:
            break
        if around[k].lstrip(_STARTS)[:1] in _QUOTES:
            opened = True
            break
    for k in range(at, len(around)):
        if k > at and around[k].lstrip(_STARTS)[:1] in _QUOTES:
            break
        w = around[k].rstrip(_ENDS)
        if w and w[-1] in QUOTES:
            closed = True
            break
    return opened and closed


def features(words: list[str], auto: Automaton) -> list[float]:
    """Counts over the matches of one text, damped, in the order of FEATURES."""
    hits = [w for w in set(words) if auto[w] >= 0]
    if not hits:
        return [0.0] * len(FEATURES)
    known = dict.fromkeys(hits)
    open_hits = 0.0
    quoted = addressed = 0
    for i, w in enumerate(words):
        if w in known:
            lo = max(0, i - WINDOW)
            around = words[lo : i + WINDOW + 1]
            plain = [x.strip(TRIM) for x in around]
            if within_quotes(around, i - lo) or any(x in REPORTING for x in plain[: i - lo]):
                quoted += 1
            else:
                open_hits += MISSPELLED if auto[w] else 1.0
            addressed += any(x in ADDRESS for x in plain)
    return [math.log1p(open_hits), math.log1p(quoted), math.log1p(addressed), min(1.0, open_hits), math.log1p(100.0 * open_hits / len(words))]


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of doc_id as text is 0 modulo ``parts``; null counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and toxic of labelled rows that are not held out, about ``sample`` of them."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    share = min(1.0, sample / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(77), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    by_doc = drawn.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select(
        "doc_id", F.col("text").cast("string").alias("text")
    ).join(by_doc, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def _neighbour(word: str) -> int:
    """A hash of a word that all workers agree on."""
    return xxhash.xxh3_64_intdigest(word.encode()) - (1 << 63)


def _pairs(batches):
    """Distinct (word, left neighbour) of each batch and class."""
    for b in batches:
        texts, toxic = byte_column(b), b.column("toxic").to_pylist()
        for lo, hi in chunks([len(t) for t in texts], 1 << 20):
            found = set()
            for t, y in zip(texts[lo:hi], toxic[lo:hi], strict=True):
                words = [w for w in (x.strip(TRIM) for x in words_of(t)) if w]
                found.update((w, _neighbour(p), y) for p, w in zip(["", *words], words) if any(map(str.isalpha, w)))  # noqa: B905
            cols = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], names=["word", "before", "toxic"]
            )


def learn_lexicon(rows: DataFrame, least: int = 4, purity: float = 0.5) -> list[str]:
    """Words that stand after ``least`` or more different words in toxic rows, and hardly ever in others.

    ``purity`` bounds the Wilson lower limit (z = 2) of the toxic share of a word's left neighbours.
    """
    a, n = F.col("a").cast("double"), (F.col("a") + F.col("b")).cast("double")
    low = (a / n + 2 / n - 2 * F.sqrt(a / n * (1 - a / n) / n + 1 / (n * n))) / (1 + 4 / n)
    seen = rows.mapInArrow(_pairs, "word string, before long, toxic int").distinct()
    by_word = seen.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    return sorted(r["word"] for r in by_word.where((F.col("a") >= least) & (low >= purity)).select("word").collect())  # bounded by the sample


def _misses(lexicon: dict[str, int]):
    """Misspelled lexicon words of each batch: the term meant, the left neighbour and the class."""

    def run(batches):
        auto = Automaton(lexicon)
        for b in batches:
            found = set()
            for t, y in zip(byte_column(b), b.column("toxic").to_pylist(), strict=True):
                words = words_of(t)
                found.update((auto.match(w.strip(TRIM))[1], _neighbour(p), y) for p, w in zip(["", *words], words) if auto[w] > 0)  # noqa: B905
            cols = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], names=["word", "before", "toxic"]
            )

    return run


def allow_edits(rows: DataFrame, words: list[str], most_harmless: float = 0.5) -> dict[str, int]:
    """The edits of each word: none where what resembles it stands in harmless rows for more than that share."""
    allowed = {w: edits_allowed(w) for w in words}
    seen = rows.mapInArrow(_misses(allowed), "word string, before long, toxic int").distinct()
    harmless = seen.groupBy("word").agg((F.count_if(F.col("toxic") == 0) / F.count("*")).alias("share")).where(F.col("share") > most_harmless)
    return allowed | {r["word"]: 0 for r in harmless.select("word").collect()}  # bounded by the lexicon


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Logistic regression with an intercept by Newton steps; the weights may not be negative but for quotation."""
    x = np.hstack([np.ones((len(x), 1)), x])
    keep = list(range(x.shape[1]))
    while True:
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x[:, keep] @ w[keep], -30, 30)))
            ridge = np.array([1e-6 if k == 0 else penalty for k in keep])
            h = (x[:, keep] * (p * (1 - p))[:, None]).T @ x[:, keep] + np.diag(ridge + 1e-9)
            step = np.linalg.solve(h, x[:, keep].T @ (y - p) - ridge * w[keep])
            w[keep] += step
            if np.abs(step).max() < 1e-8:
                break
        worst = min((k for k in keep if k and FEATURES[k - 1] not in ("quoted", "addressed")), key=lambda k: w[k], default=None)
        if worst is None or w[worst] >= 0:
            return w
        keep.remove(worst)


def _automaton(words: dict[str, int]) -> Automaton:
    return kept("toxicity", tuple(sorted(words.items())), lambda: Automaton(words))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, int], np.ndarray]:
    """The lexicon, with the edits that each word is allowed, and the weights."""
    rows = materialize(training_rows(docs, labels, sample), "labelled")
    lexicon = allow_edits(rows, learn_lexicon(rows))

    def extract(batches):
        auto = _automaton(lexicon)
        for b in pieces(batches):
            x = [features(words_of(t), auto) for t in byte_column(b)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("toxic")], names=["x", "toxic"])

    got = rows.mapInArrow(extract, "x array<double>, toxic int").groupBy("x", "toxic").count().collect()  # bounded by the sample
    n, ones = sum(r["count"] for r in got), sum(r["count"] for r in got if r["toxic"])
    if not 0 < ones < n:
        p = (ones + 0.5) / (n + 1)
        return lexicon, np.array([math.log(p / (1 - p)), *[0.0] * len(FEATURES)])
    got.sort(key=lambda r: (r["toxic"], r["x"]))
    x = np.repeat(np.array([r["x"] for r in got]), [r["count"] for r in got], axis=0)
    return lexicon, _fit(x, np.repeat([float(r["toxic"] > 0) for r in got], [r["count"] for r in got]))


def score_documents(docs: DataFrame, lexicon: dict[str, int], weights: np.ndarray) -> DataFrame:
    """doc_id, score of each document; a map without a shuffle."""

    def run(batches):
        auto = _automaton(lexicon)
        for b in pieces(batches):
            z = [float(weights[0] + np.dot(weights[1:], features(words_of(t), auto))) for t in byte_column(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z], pa.float64())], names=["doc_id", "score"]
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    scored = score_documents(docs, *fit(docs, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
