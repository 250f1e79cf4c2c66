"""Language-model scores by a weighted backoff automaton.

States are histories, from none (the root) to ``order`` - 1 tokens. A state has an arc for each token that follows it in the
training texts, and a failure arc to the state of its history less the first token; the root has an arc for every token. With
Dirichlet smoothing, p(w | h) = (c(hw) + mu p(w | h')) / (c(h) + mu): an arc carries that probability, a failure arc
mu / (c(h) + mu), an arc of the root the add-one probability of its token. A text is traversed once from left to right: at each
token the automaton takes the state's arc, or fails until it has one, and log10 of what it passes adds up. mu is the value of a fixed
grid with the best leave-one-out likelihood over all training texts; the path doesn't depend on it. The texts of a part are
traversed in stretches that take their steps side by side.

The automaton of the corpus is never held whole. Texts are read once, into blocks of about ``block_bytes``, and written as word
numbers. A block asks for the counts of its distinct n-grams, packed and sorted and split by hash into shards. A shard adds up what
the blocks counted in training texts and answers in the order in which each asked. Each part of a block then has the
states and arcs that its own texts can reach. Every n-gram counts; nothing is cut off or sampled, and what moves grows with the
corpus. There are as many shards as blocks, up to ``ROADS``; then shards grow to ``FULL`` blocks' texts; beyond, shards are as
small as before, but blocks send to ``ROADS`` ranges only, and teams of blocks ask together for a range's shards.

Texts are lower-cased (A-Z); tokens are runs of characters outside [\\x20\\x09-\\x0D], then one end. A text is
learned from unless crc32(doc_id as text) modulo ``parts`` is ``out``; a null doc_id counts as empty
text. Null and empty texts hold the end alone. Without training texts N and V are 0. Each input row
gives one row. A text longer than a part is cut between words and goes on with the tokens before the cut, which lead to the
same state, so that no task holds a long text's tokens at once.
"""

from __future__ import annotations

import math
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, byte_column, give_back, materialize, mix64, pieces, word_hashes

ORDER = 3
BLOCK_BYTES, PART_BYTES = 8 << 20, 512 << 10
#: Ranges of keys that a block sends to; blocks' texts that a shard may stand for; and blocks that ask together, where there is more.
ROADS, FULL, TEAM = 512, 4, 512
GRID = (1.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0, 16384.0)
#: Tokens that a traversal takes in a row, beside others of the part.
STRETCH = 128
END = np.uint64(0x3C2F733E)
_ROLL = np.uint64(0x9E3779B97F4A7C15)
#: Bits by which the keys of n-grams of two or more words are shorter.
SHORT = 12
_LOW = np.uint64((1 << SHORT) - 1)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def held_out(doc_id: Column, parts: int = 7, out: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == out


def _planes(x: np.ndarray, width: int) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def _whole(blob: bytes, width: int, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as compressed planes of their differences' bytes; low bits that all keys have at 0 are left out."""
    shift = 0 if (keys & _LOW).any() else SHORT
    return bytes([shift]) + _planes(np.diff(keys >> np.uint64(shift), prepend=np.uint64(0)), 8)


def unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(_whole(blob[1:], 8, np.uint64), dtype=np.uint64) << np.uint64(blob[0])


def pack_counts(counts: np.ndarray) -> bytes:
    return _planes(counts.astype("<u4"), 4)


def unpack_counts(blob: bytes) -> np.ndarray:
    return _whole(blob, 4, "<u4")


def ranges(keys: np.ndarray, n: int, lo: int = 0, of: int = 1) -> list[tuple[int, int, int]]:
    """(number, start, end) of the parts of sorted keys in each of the n equal ranges of range ``lo`` of ``of``; empty ones are left out."""
    cuts = np.array([((lo * n + i) << 64) // (n * of) for i in range(1, n)], np.uint64)
    edges = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
    return [(lo * n + i, a, z) for i, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if z > a]


def windows(text: bytes, most: int):
    """The text in pieces of about ``most`` bytes, cut between words."""
    at = 0
    while len(text) - at > most:
        m = _SPACE.search(text, at + most)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def rolled(tokens: np.ndarray, sizes: np.ndarray, order: int):
    """For n from 1 to ``order``, the positions where an n-gram of some token sequences ends, and its key.

    Keys of words have 64 bits, those of longer n-grams 52 (see the README), the lowest 12 being 0.
    """
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    h = mix64(tokens)
    for k in range(1, order + 1):
        if k > 1:
            with np.errstate(over="ignore"):
                longer = np.zeros_like(h)
                longer[1:] = mix64(h[:-1] * _ROLL + tokens[1:])
            h = longer
        at = np.flatnonzero(place >= k - 1)
        yield at, h[at] if k == 1 else h[at] & ~_LOW


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys, sorted, each once, and how often each stands there."""
    keys = np.sort(keys)
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[new], np.diff(np.append(new, len(keys)))


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys, sorted, each once; the number of each position's key among them; and one position of each."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.append(True, s[1:] != s[:-1])[: len(s)]
    where = np.empty(len(keys), np.int32)
    where[order] = np.cumsum(new) - 1
    return s[new], where, order[new]


class Grams:
    """The distinct n-grams of some token sequences: keys, the positions where they end, which they are there, and one position of each."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, order: int):
        self.of = []
        for at, h in rolled(tokens, sizes, order):
            keys, where, one = numbered(h)
            self.of.append((keys, at.astype(np.int32), where, at[one]))


class Automaton:
    """The states and arcs that the n-grams of a part can reach; ``known`` has the n-grams' counts in the training texts."""

    def __init__(self, grams: Grams, known: list[np.ndarray], size: int):
        order = len(grams.of)
        self.words = len(grams.of[0][0])
        number = [np.full(size, -1) for _ in range(order)]  # the n-gram that ends at each position
        for x, (_, at, where, _) in zip(number, grams.of, strict=True):
            x[at] = where
        self.word = number[0]
        # arcs: one for each word at the root, then the n-grams that the training texts have; states: the root, then those n-grams as histories
        arc_of, state_of = [np.arange(self.words)], []
        arcs, states = self.words, 1
        for k, c in enumerate(known):
            seen = c > 0
            if k:
                arc_of.append(np.where(seen, arcs + np.cumsum(seen) - 1, -1))
                arcs += int(seen.sum())
            if k < order - 1:
                state_of.append(np.where(seen, states + np.cumsum(seen) - 1, 0))
                states += int(seen.sum())
        self.count, self.prior, self.lower = np.zeros(arcs, np.int64), np.zeros(arcs, np.int64), np.full(arcs, -1)
        target, self.fail, self.mass = np.zeros(arcs, np.int64), np.zeros(states, np.int64), np.zeros(states, np.int64)
        source, label = np.zeros(arcs, np.int64), np.zeros(arcs, np.int64)
        self.count[: self.words] = known[0]
        if order > 1:
            target[: self.words] = state_of[0]
        for k, (_, _, _, first) in enumerate(grams.of):
            seen = known[k] > 0
            p = first[seen]
            if k:
                a = arc_of[k][seen]
                self.count[a], self.prior[a] = known[k][seen], known[k - 1][number[k - 1][p - 1]]
                self.lower[a] = arc_of[k - 1][number[k - 1][p]]
                source[a], label[a] = state_of[k - 1][number[k - 1][p - 1]], number[0][p]
                target[a] = state_of[k][seen] if k < order - 1 else state_of[k - 1][number[k - 1][p]]
            if k < order - 1:
                s = state_of[k][seen]
                self.mass[s] = known[k][seen]
                self.fail[s] = state_of[k - 1][number[k - 1][p]] if k else 0
        self.level = [slice(0, self.words)] + [slice(int(a[a >= 0].min()), int(a.max()) + 1) if (a >= 0).any() else slice(0, 0) for a in arc_of[1:]]
        self.source, self.label, self.to = source, label, target
        self.depth = np.zeros(states, np.int64)  # the tokens in each state's history
        for k, s in enumerate(state_of):
            self.depth[s[s > 0]] = k + 1
        # the arc that a state of each depth has for the token at a position, if its history stands before it: none where it is -1
        self.offer = np.full((order, size), -1)
        for k, (_, at, where, _) in enumerate(grams.of):
            self.offer[k, at] = arc_of[k][where]

    @cached_property
    def arc(self) -> dict[int, int]:
        return dict(
            zip((self.source[self.words :] * self.words + self.label[self.words :]).tolist(), range(self.words, len(self.count)), strict=True)
        )

    @cached_property
    def target(self) -> list[int]:
        return self.to.tolist()

    @cached_property
    def failure(self) -> list[int]:
        return self.fail.tolist()

    def traverse(self, words: list[int], state: int, path: list[int], failed: list[int]) -> int:
        """The arcs and failures passed from ``state`` over ``words``, put on the two lists; gives the state arrived in."""
        arc, target, failure, width = self.arc.get, self.target, self.failure, self.words
        for w in words:
            a = arc(state * width + w) if state else w
            while a is None:
                failed.append(state)
                state = failure[state]
                a = arc(state * width + w) if state else w
            path.append(a)
            state = target[a]
        return state

    def traverse_all(self, begin: np.ndarray, end: np.ndarray, lead: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
        """What ``traverse`` passes over the part's texts, from ``begin`` to ``end`` of its positions, ``lead`` tokens before them known.

        Texts are cut in stretches, which all take a step at a time; a stretch first carries the root's state over the
        tokens before it, at most as many as a history has, which lead to the state that the whole text before it does. Gives the
        arc passed at each position, and the states failed from at each position, -1 where there are no more.
        """
        order, size = self.offer.shape
        cuts = -(-(end - begin) // stretch)
        of = np.repeat(np.arange(len(cuts)), cuts)
        at = begin[of] + stretch * (np.arange(len(of)) - (np.cumsum(cuts) - cuts)[of])
        steps, before = np.minimum(end[of] - at, stretch), np.minimum(at - begin[of] + lead[of], order - 1)
        longest = np.argsort(-steps, kind="stable")
        at, steps, before = at[longest], steps[longest], before[longest]
        passed, failed = np.full(size, -1), np.full((max(order - 1, 1), size), -1)
        state = np.zeros(len(at), np.int64)

        def step(here: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, list]:
            a, fell = self.offer[self.depth[s], here], []
            out = np.flatnonzero(a < 0)
            while len(out):
                fell.append((here[out], s[out]))
                s[out] = self.fail[s[out]]
                a[out] = self.offer[self.depth[s[out]], here[out]]
                out = out[a[out] < 0]
            return a, fell

        for j in range(order - 1, 0, -1):
            some = np.flatnonzero(before >= j)
            a, _ = step(at[some] - j, state[some])
            state[some] = self.to[a]
        for j, n in enumerate(np.searchsorted(-steps, -np.arange(steps[0]) if len(steps) else []).tolist()):
            here = at[:n] + j
            a, fell = step(here, state[:n])
            passed[here] = a
            for k, (where, s) in enumerate(fell):
                failed[k, where] = s
            state[:n] = self.to[a]
        return passed, failed

    def weights(self, total: int, vocabulary: int, mu: float, less: int = 0) -> np.ndarray:
        """The probability of each arc; ``less``: 1 to leave one occurrence of its n-gram out of an arc's counts."""
        p = np.empty(len(self.count))
        p[self.level[0]] = (self.count[self.level[0]] + 1.0) / (total + vocabulary + 1.0)
        for a in self.level[1:]:
            p[a] = (self.count[a] - less + mu * p[self.lower[a]]) / (self.prior[a] - less + mu)
        return p

    def failures(self, mu: float) -> np.ndarray:
        """The weight of each state's failure arc."""
        return mu / (self.mass + mu)


_INDEX = "block long, parts array<struct<words:binary,numbers:binary,texts:array<struct<doc_id:long,row:long,held_out:boolean,size:int,lead:int,whole:boolean>>>>"
_TEXT = pa.struct(
    [("doc_id", pa.int64()), ("row", pa.int64()), ("held_out", pa.bool_()), ("size", pa.int32()), ("lead", pa.int32()), ("whole", pa.bool_())]
)
_PART = pa.struct([("words", pa.binary()), ("numbers", pa.binary()), ("texts", pa.list_(_TEXT))])


class _Block:
    """Gathers the parts of a block: the words of each, and its tokens as numbers of words."""

    def __init__(self, number: int):
        self.number, self.bytes, self.held = number, 0, 0
        self.parts: list[dict] = []
        self.tokens: list[np.ndarray] = []
        self.texts: list[dict] = []

    def add(self, tokens: np.ndarray, text: dict, size: int):
        self.tokens.append(tokens)
        self.texts.append(text)
        self.held += size
        self.bytes += size

    def close_part(self):
        if self.texts:
            words, number, _ = numbered(np.concatenate(self.tokens))
            self.parts.append({"words": pack(words), "numbers": pack_counts(number), "texts": self.texts})
            self.tokens, self.texts, self.held = [], [], 0

    def row(self) -> pa.RecordBatch:
        self.close_part()
        return pa.RecordBatch.from_arrays([pa.array([self.number], pa.int64()), pa.array([self.parts], pa.list_(_PART))], names=["block", "parts"])


def _index(order: int, block_bytes: int, part_bytes: int):
    def run(batches):
        base = TaskContext.get().partitionId() << 32
        row, block = base, _Block(base)
        for b in pieces(batches):
            ids, held = b.column("doc_id").to_pylist(), b.column("held_out").to_pylist()
            for i, t in enumerate(byte_column(b)):
                cuts = list(windows(t, part_bytes)) if len(t) > part_bytes else [t]
                before = np.zeros(0, np.uint64)
                for j, w in enumerate(cuts):
                    words = w.lower().split()  # bytes.lower() folds A-Z alone
                    new = np.empty(len(words) + (j == len(cuts) - 1), np.uint64)
                    new[: len(words)] = word_hashes(words)
                    if len(new) > len(words):
                        new[-1] = END
                    if not len(new):
                        continue
                    tokens = np.concatenate([before, new])
                    block.add(
                        tokens,
                        {"doc_id": ids[i], "row": row, "held_out": bool(held[i]), "size": len(tokens), "lead": len(before), "whole": len(cuts) == 1},
                        len(w) + 1
                    )
                    before = tokens[max(0, len(tokens) - order + 1) :] if order > 1 else before
                    if block.held >= part_bytes:
                        block.close_part()
                    if block.bytes >= block_bytes:
                        yield block.row()
                        block = _Block(block.number + 1)
                row += 1
        if block.bytes:
            yield block.row()
        give_back()

    return run


def _parts(parts: list[dict]):
    """(tokens, texts) of each part of a block."""
    for p in parts:
        yield unpack(p["words"])[unpack_counts(p["numbers"])], p["texts"]


def _own(texts: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of a part aren't led in from a piece before, and which text each belongs to."""
    size, lead = np.array([t["size"] for t in texts]), np.array([t["lead"] for t in texts])
    of = np.repeat(np.arange(len(texts)), size)
    return np.arange(len(of)) - (np.cumsum(size) - size)[of] >= lead[of], of


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of several lists, with the sums of their counts."""
    every, where = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_inverse=True)
    return every, np.bincount(where, weights=np.concatenate(counts) if counts else None, minlength=len(every)).astype(np.int64)


_ASK = "block long, n int, shard int, a binary, b binary"


def _ask(order: int, roads: int):
    """What each block asks for: its distinct n-grams, with their counts in its training texts."""

    def run(batches):
        for b in batches:
            for number, parts in zip(b.column("block").to_pylist(), (x.as_py() for x in b.column("parts")), strict=True):
                tokens, of, learned = [], [], []
                for t, texts in _parts(parts):
                    own, n = _own(texts)
                    tokens.append(t)
                    of.append(np.bincount(n))
                    learned.append(own & ~np.array([x["held_out"] for x in texts])[n])
                if not tokens:
                    continue
                counted = np.concatenate(learned)
                for k, (at, h) in enumerate(rolled(np.concatenate(tokens), np.concatenate(of), order)):
                    on = counted[at]
                    keys, counts = distinct(h)
                    if not on.all():
                        some, often = distinct(h[on])
                        counts[:] = 0
                        counts[np.searchsorted(keys, some)] = often
                    rows = [(s, pack(keys[a:z]), pack_counts(counts[a:z])) for s, a, z in ranges(keys, roads)]
                    s, a, z = zip(*rows, strict=True) if rows else ([], [], [])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([number] * len(rows), pa.int64()), pa.array([k + 1] * len(rows), pa.int32()), pa.array(s, pa.int32()),
                            pa.array(a, pa.binary()), pa.array(z, pa.binary())
                        ],
                        names=["block", "n", "shard", "a", "b"]
                    )
        give_back()

    return run


_ANSWER = "block long, n int, shard int, known binary, total long, vocabulary long"


def _answer(key, table):
    """Adds up the counts of one shard, and gives each asker those of its keys; block -1 has the shard's total and vocabulary."""
    keys = [unpack(x) for x in table.column("a").to_pylist()]
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(
        where, weights=np.concatenate([unpack_counts(x) for x in table.column("b").to_pylist()]), minlength=len(every)
    ).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    blobs = [pack_counts(x) for x in np.split(total[where], ends[:-1])]
    n, shard = key[0].as_py(), key[1].as_py()
    rows = len(blobs) + 1
    return pa.table({
        "block": pa.array(
            [*table.column("block").to_pylist(), -1], pa.int64()
        ), "n": pa.array([n] * rows, pa.int32()), "shard": pa.array([shard] * rows, pa.int32()),
        "known": pa.array([*blobs, None], pa.binary()), "total": pa.array(
            [*[None] * len(blobs), int(total.sum())], pa.int64()
        ), "vocabulary": pa.array(
            [*[None] * len(blobs), int((total > 0).sum())], pa.int64()
        ),
    })


def _team_asks(roads: int, shards_a_road: int):
    """What the blocks of a team ask for in one range, asked once, by shard."""

    def run(key, table):
        n, road, team = (k.as_py() for k in key)
        keys, counts = merged([unpack(x) for x in table.column("a").to_pylist()], [unpack_counts(x) for x in table.column("b").to_pylist()])
        rows = [(s, pack(keys[a:z]), pack_counts(counts[a:z])) for s, a, z in ranges(keys, shards_a_road, road, roads)]
        s, a, b = zip(*rows, strict=True)
        return pa.table(
            {
                "block": pa.array([team] * len(rows), pa.int64()), "n": pa.array([n] * len(rows), pa.int32()), "shard": pa.array(s, pa.int32()),
                "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())
            }
        )

    return run


def _team_answers(asks, answers):
    """The answers to a team, in one range, dealt out to its blocks."""
    if not asks.num_rows:
        return pa.table(
            {"block": pa.array([], pa.int64()), "n": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "known": pa.array([], pa.binary())}
        )
    keys = [unpack(x) for x in asks.column("a").to_pylist()]
    every = np.unique(np.concatenate(keys))
    told = sorted(zip(answers.column("shard").to_pylist(), answers.column("known").to_pylist(), strict=True), key=lambda r: r[0])
    known = np.concatenate([unpack_counts(x) for _, x in told])
    return pa.table(
        {
            "block": asks.column("block"), "n": asks.column("n"), "shard": asks.column("shard"),
            "known": pa.array([pack_counts(known[np.searchsorted(every, k)]) for k in keys], pa.binary())
        }
    )


def exchange(asks: DataFrame, shards: int, roads: int, team: int) -> tuple[DataFrame, DataFrame]:
    """The answers to ``asks`` (block, n, shard, a, b), and each shard's total and vocabulary (n, total, vocabulary)."""
    if shards <= roads:
        answers = materialize(asks.groupBy("n", "shard").applyInArrow(_answer, _ANSWER), "answers")
        return answers.where("block >= 0").select("block", "n", "shard", "known"), answers.where("block = -1")
    a_road = -(-shards // roads)
    asks = materialize(asks, "asks")  # read again when the answers are dealt out
    teamed = asks.withColumn("team", F.pmod(F.xxhash64("block"), F.greatest(F.lit(1), F.ceil(F.lit(asks.select("block").distinct().count() / team)))))
    together = materialize(
        teamed.groupBy("n", "shard", "team").applyInArrow(_team_asks(roads, a_road), "block long, n int, shard int, a binary, b binary"), "teams"
    )
    answers = materialize(together.groupBy("n", "shard").applyInArrow(_answer, _ANSWER), "answers")
    of_team = answers.where("block >= 0").select(
        F.col("block").alias("team"), "n", F.floor(F.col("shard") / a_road).cast("int").alias("road"), "shard", "known"
    )
    back = teamed.withColumnRenamed("shard", "road").select(
        "team", "n", "road", "block", F.col("road").alias("shard"), "a"
    ).groupBy("team", "n", "road")
    dealt = back.cogroup(of_team.groupBy("team", "n", "road")).applyInArrow(_team_answers, "block long, n int, shard int, known binary")
    return materialize(dealt, "dealt"), answers.where("block = -1")


_SCORED = "doc_id long, row long, whole boolean, held_out boolean, n_tokens long, n_known long, base_score double, scores array<double>, left_out array<double>"


def _score(order: int, total: int, vocabulary: int):
    def run(table, answers):
        parts = [p for row in table.column("parts").to_pylist() for p in row]
        out: list[pa.Table] = []
        told = sorted(
            zip(answers.column("n").to_pylist(), answers.column("shard").to_pylist(), answers.column("known").to_pylist(), strict=True),
            key=lambda r: r[:2]
        )
        counts = [
            np.concatenate([unpack_counts(x) for n, _, x in told if n == k] or [np.zeros(0, np.uint32)]).astype(np.int64) for k in range(1, order + 1)
        ]
        of_part = lambda p: np.array([t["size"] for t in p["texts"]])
        grams = [Grams(tokens, of_part(p), order) for (tokens, _), p in zip(_parts(parts), parts, strict=True)]
        asked = [distinct(np.concatenate([g.of[k][0] for g in grams]))[0] if grams else np.zeros(0, np.uint64) for k in range(order)]
        while parts:
            p, g = parts.pop(0), grams.pop(0)
            auto = Automaton(g, [c[np.searchsorted(x, keys)] for c, x, (keys, *_) in zip(counts, asked, g.of, strict=True)], int(of_part(p).sum()))
            out.append(_walk(auto, p["texts"], total, vocabulary))
        return pa.concat_tables(out) if out else pa.table({x.name: pa.array([], x.type) for x in _RESULT}, schema=_RESULT)

    return run


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()), ("row", pa.int64()), ("whole", pa.bool_()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
        ("n_known", pa.int64()), ("base_score", pa.float64()), ("scores", pa.list_(pa.float64())), ("left_out", pa.list_(pa.float64()))
    ]
)


def _ranked(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``x``, which are below ``n``, in order, and the place of each value of ``x`` among them."""
    used = np.zeros(n, bool)
    used[x] = True
    return np.flatnonzero(used), (np.cumsum(used) - 1)[x]


def _walk(auto: Automaton, texts: list[dict], total: int, vocabulary: int) -> pa.Table:
    """Traverses the texts of a part, and weighs their paths for each mu."""
    size, lead = np.array([t["size"] for t in texts]), np.array([t["lead"] for t in texts])
    ends = np.cumsum(size)
    passed, failed = auto.traverse_all(ends - size + lead, ends, lead)
    own_ = size - lead
    starts = np.cumsum(own_) - own_
    counted, of = _own(texts)
    path, learned = passed[counted], np.array([not t["held_out"] for t in texts])[of[counted]]
    fell = failed >= 0
    of_failure, failed = np.concatenate([of[x] for x in fell]), failed[fell]
    first = auto.count[auto.word[counted]]
    used, which = _ranked(path, len(auto.count))
    some, which_failed = _ranked(failed, len(auto.fail))
    often = np.bincount(which[learned], minlength=len(used))
    taught = np.flatnonzero(often)
    scores, left = [], []
    for mu in GRID:
        arcs, fails = np.log(auto.weights(total, vocabulary, mu)[used]), np.log(auto.failures(mu)[some])
        scores.append(
            (np.add.reduceat(arcs[which], starts) + np.bincount(of_failure, weights=fails[which_failed], minlength=len(texts))) / math.log(10)
        )
        left.append(float(np.log(auto.weights(total, vocabulary, mu, 1)[used[taught]]) @ often[taught]))
    n = len(texts)
    none = [0.0] * len(GRID)
    return pa.table(
        [
            pa.array(
                [t["doc_id"] for t in texts], pa.int64()
            ), pa.array([t["row"] for t in texts], pa.int64()), pa.array([t["whole"] for t in texts]), pa.array([t["held_out"] for t in texts]), pa.array(own_, pa.int64()),
            pa.array(np.add.reduceat((first > 0).astype(np.int64), starts), pa.int64()), pa.array(
                np.add.reduceat(np.log10((first + 1.0) / (total + vocabulary + 1.0)), starts)
            ),
            pa.array(list(np.stack(scores, 1)), pa.list_(pa.float64())), pa.array(
                [left if i == 0 else none for i in range(n)], pa.list_(pa.float64())
            ),
        ],
        schema=_RESULT,
    )


def shards_for(size: int, block_bytes: int, roads: int) -> int:
    """The number of shards for so many bytes of text: at most ``roads``, unless they would stand for more than ``FULL`` blocks each."""
    blocks = max(1, math.ceil(size / block_bytes))
    return blocks if blocks > FULL * roads else min(blocks, roads)


def score_documents(
    docs: DataFrame, order: int = ORDER, parts: int = 7, out: int = 2, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES,
    roads: int = ROADS, team: int = TEAM
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    bound_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    shards = shards_for(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0, block_bytes, roads)
    texts = docs.select("doc_id", text.alias("text"), held_out(F.col("doc_id"), parts, out).alias("held_out"))
    # a row for each block, about half its text's size; small row groups, as a reader holds one
    index = materialize(texts.mapInArrow(_index(order, block_bytes, part_bytes), _INDEX), "index", row_group=block_bytes)
    asks = index.mapInArrow(_ask(order, min(shards, roads)), _ASK)
    answers, sums = exchange(asks, shards, roads, team)
    of_all = sums.where("n = 1").agg(F.sum("total"), F.sum("vocabulary")).first()
    total, vocabulary = of_all[0] or 0, of_all[1] or 0
    scored = materialize(index.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(order, total, vocabulary), _SCORED), "scored")
    likely = scored.agg(*[F.sum(F.col("left_out")[i]).alias(f"g{i}") for i in range(len(GRID))]).first()
    best = max(range(len(GRID)), key=lambda i: likely[i] if likely[i] is not None else 0.0)
    each = scored.select("doc_id", "row", "whole", "held_out", "n_tokens", "n_known", "base_score", F.col("scores")[best].alias("score"))
    sums_of = [
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"),
        *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    ]
    whole = each.where("whole").drop("row", "whole").unionByName(each.where("NOT whole").groupBy("row").agg(*sums_of).drop("row"))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
