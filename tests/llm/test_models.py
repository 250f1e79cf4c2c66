import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import SF
from tidewright.llm import lm, toxicity

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)) + [None]


def held(i, parts, out):
    return zlib.crc32(("" if i is None else str(i)).encode()) % parts == out


def counted(rows, order):
    grams = [Counter() for _ in range(order)]
    for i, t in rows:
        if not held(i, 7, 2):
            w = tokens(t)
            for k in range(order):
                grams[k].update(tuple(w[j : j + k + 1]) for j in range(len(w) - k))
    return grams


def chances(w, grams, order, mu, less=0):
    """The probability of each token by the interpolation formula; ``less``: 1 to leave the token's own occurrence out."""
    n, v = sum(grams[0].values()), len(grams[0])
    for j, x in enumerate(w):
        p = (grams[0][(x,)] + 1) / (n + v + 1)
        for k in range(1, min(j + 1, order)):
            p = (max(grams[k][tuple(w[j - k : j + 1])] - less, 0) + mu * p) / (max(grams[k - 1][tuple(w[j - k : j])] - less, 0) + mu)
        yield p


def brute(rows, order):
    grams = counted(rows, order)
    n, v = sum(grams[0].values()), len(grams[0])
    likely = {mu: sum(math.log10(p) for i, t in rows if not held(i, 7, 2) for p in chances(tokens(t), grams, order, mu, 1)) for mu in lm.GRID}
    mu = max(lm.GRID, key=lambda x: likely[x])
    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((grams[0][(x,)] + 1) / (n + v + 1)) for x in w)
        out.append((i, held(i, 7, 2), len(w), sum(grams[0][(x,)] > 0 for x in w), n, base, sum(math.log10(p) for p in chances(w, grams, order, mu))))
    return out


def check(df, order, **how):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got = sorted((tuple(r) for r in lm.score_documents(df, order, **how).collect()), key=key)
    want = sorted(brute(rows, order), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize(
    ("order", "how"),
    [
        (1, {}), (2, {}), (3, {"block_bytes": 30_000, "part_bytes": 4000}), (4, {"block_bytes": 100_000, "part_bytes": 700}),
        (3, {"block_bytes": 20_000, "part_bytes": 5000, "roads": 3, "team": 4})
    ],
)
def test_scores_equal_brute_force(docs, order, how):
    """The whole grid, the choice in it by leave-one-out likelihood, long texts in pieces, and blocks that ask in teams."""
    check(docs, order, **how)


def test_scores_of_odd_rows(odd, none, clashing):
    check(odd, 3, part_bytes=50_000)
    assert lm.score_documents(none).count() == 0
    assert lm.score_documents(clashing).count() == clashing.count()


def test_no_training_rows(spark):
    i = next(k for k in range(100) if held(k, 7, 2))
    r = lm.score_documents(spark.createDataFrame([(i, "a b")], "doc_id long, text string")).first()
    assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0)


def automaton(texts, order=3, learned=None):
    """The automaton over all n-grams of some texts, counted in those ``learned``, with the number of each word."""
    import numpy as np

    names = {w: k for k, w in enumerate(sorted({x for t in texts for x in t}))}
    flat = np.array([names[x] for t in texts for x in t], np.uint64)
    sizes = np.array([len(t) for t in texts])
    grams = lm.Grams(flat, sizes, order)
    on = np.repeat(np.array(learned if learned is not None else [True] * len(texts)), sizes)
    known = [np.bincount(where[on[at]], minlength=len(keys)) for keys, at, where, _ in grams.of]
    auto = lm.Automaton(grams, known, len(flat))
    return auto, {w: int(auto.word[np.flatnonzero(flat == k)[0]]) for w, k in names.items()}


def test_probabilities_sum_to_one():
    """From every state inside a text, the weights that the automaton passes for all words, an unseen one included, sum to one."""
    texts = [list("abac."), list("ba."), list("ccab."), list("u.")]  # the last is not learned from: u stands for all unseen words
    auto, word = automaton(texts, 3, [True, True, True, False])
    n, v = 13, 4
    arcs, fails = auto.weights(n, v, 16.0), auto.failures(16.0)
    inside = {auto.traverse([word[x] for x in h], 0, [], []) for h in ("", "a", "b", "c", "ab", "ba", "ac", "cc", "ca", "bu", "u")}
    assert len(inside) == 9  # u has no state, and bu leads where u does
    for state in inside:
        total = 0.0
        for w in word.values():
            path, failed = [], []
            auto.traverse([w], state, path, failed)
            total += arcs[path[0]] * math.prod(fails[f] for f in failed)
        assert total == pytest.approx(1.0)


def test_the_state_is_carried():
    """States are the longest known histories, failures shorten them by their first word."""
    auto, word = automaton([list("abcd."), list("bcx.")], 3, [True, True])
    path, failed = [], []
    auto.traverse([word[x] for x in "abcx"], 0, path, failed)
    assert len(path) == 4 and len(failed) == 0  # bc is followed by d and by x
    path, failed = [], []
    auto.traverse([word[x] for x in "abca"], 0, path, failed)
    assert len(failed) == 2 and auto.failure[failed[0]] == failed[1]  # from bc to c to the root
    assert auto.failure[failed[1]] == 0


@given(
    st.lists(st.tuples(st.text("abc", min_size=1, max_size=30), st.integers(0, 2), st.booleans()), min_size=1, max_size=6),
    st.integers(1, 4), st.integers(1, 9)
)
@settings(deadline=None)
def test_stretches_side_by_side_pass_what_texts_do(texts, order, stretch):
    """However texts are cut in stretches, each position has the arc and the failures that a traversal of its text from its start passes there."""
    import numpy as np

    lead = np.array([min(n, order - 1, len(t) - 1) for t, n, _ in texts])
    auto, word = automaton([t for t, *_ in texts], order, [x for *_, x in texts])
    ends = np.cumsum([len(t) for t, *_ in texts])
    begins = ends - [len(t) for t, *_ in texts] + lead
    passed, failed = auto.traverse_all(begins, ends, lead, stretch)
    own = np.zeros(len(passed), bool)
    for (t, *_), begin, end, k in zip(texts, begins, ends, lead, strict=True):
        state = auto.traverse([word[x] for x in t[:k]], 0, [], [])
        own[begin:end] = True
        for at, x in zip(range(begin, end), t[k:], strict=True):
            arcs, states = [], []
            state = auto.traverse([word[x]], state, arcs, states)
            assert [passed[at]] == arcs and [s for s in failed[:, at] if s >= 0] == states
    assert (passed[~own] == -1).all() and (failed[:, ~own] == -1).all()


def test_shards_grow_before_blocks_ask_in_teams(docs, monkeypatch):
    """A few times as many blocks as roads send straight to larger shards, without the tables of teams; scores are the same."""
    written = []
    monkeypatch.setattr(lm, "materialize", lambda df, name, *a, f=lm.materialize, **how: written.append(name) or f(df, name, *a, **how))
    size = sum(len((r.text or "").encode()) for r in docs.select("text").collect())
    check(docs, 3, block_bytes=size // 12, part_bytes=size // 40, roads=4)
    assert written == ["index", "answers", "scored"]
    assert lm.shards_for(size, size // 12, 2) > 8  # beyond, in teams


@given(st.binary(max_size=60), st.integers(1, 9))
def test_windows(text, most):
    assert b"".join(lm.windows(text, most)) == text
    assert [w for x in lm.windows(text, most) for w in x.split()] == text.split()


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=50))
def test_packing(keys):
    import numpy as np

    k = np.unique(np.array(keys, np.uint64))
    short = np.unique(k & ~np.uint64(0xFFF))
    assert (lm.unpack(lm.pack(short)) == short).all() and len(lm.unpack(lm.pack(k[:0]))) == 0
    assert (lm.unpack(lm.pack(k)) == k).all() and (lm.unpack_counts(lm.pack_counts(np.arange(len(k)))) == np.arange(len(k))).all()
    whole = {n: k[a:z].tolist() for n, a, z in lm.ranges(k, 12)}
    parts = {}
    for road, a, z in lm.ranges(k, 4):  # first by roads, then by a road's shards
        of_road = k[a:z]
        parts |= {n: of_road[x:y].tolist() for n, x, y in lm.ranges(of_road, 3, road, 4)}
    assert parts == whole


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.dictionaries(st.text("abc", min_size=1, max_size=6), st.integers(0, 2), min_size=1, max_size=6), st.text("abcd", max_size=8))
@settings(max_examples=400, deadline=None)
def test_automaton_equals_edit_distance(words, word):
    near = [edits(word, w) for w, most in words.items() if edits(word, w) <= most]
    assert toxicity.Automaton(words).match(word)[0] == min(near, default=-1)


def test_misspelled_and_quoted():
    auto = toxicity.Automaton({"worthless": 2, "idiot": 1})
    f = lambda t: dict(zip(toxicity.FEATURES, toxicity.features(toxicity.words_of(t.encode()), auto), strict=True))
    assert f("a fine day")["hits"] == 0 == f("a fine day")["rate"]
    assert f("you idiot")["hits"] > f("you idoot")["hits"] > 0
    assert f("Such a WORTHLES thing")["hits"] > 0
    assert f('the word "idiot" is rude')["quoted"] > 0 == f('the word "idiot" is rude')["hits"]


def test_a_stray_mark_quotes_nothing():
    auto = toxicity.Automaton({"idiot": 1})
    f = lambda t: dict(zip(toxicity.FEATURES, toxicity.features(toxicity.words_of(t.encode()), auto), strict=True))
    for text in ('a 5" pipe for you idiot and more', '"It began ' + "stone " * 30 + "you idiot here", 'he left" and you idiot "then he came', 'an idiot and "something else" after'):
        assert f(text)["hits"] > 0 == f(text)["quoted"], text
    for text in ('"you idiot" is what it read', 'it read “such an idiot today”, no more', '("idiot")'):
        assert f(text)["quoted"] > 0 == f(text)["hits"], text


def test_decorated_and_long_terms(spark):
    """Terms with hyphens, digits, apostrophes and marks around them, and of any length, are learned."""
    term, long = "num-8sk'ull", "x" * 30 + "y"
    rows = [(i, f"w{i} v{i % 7} {term}### then u{i} {long}", 1) for i in range(30)] + [
        (i, f"w{i} v{i % 7} nothing then else u{i}", 0) for i in range(30, 300)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert {term, long} <= set(toxicity.learn_lexicon(df.select("text", "toxic")))


def test_misspelled_and_quoted_end_to_end(spark):
    """Learned from labelled rows: exact and misspelled abuse scores high, quotation and clean text low, held-out rows included."""
    import random

    r = random.Random(5)
    fill = lambda n: " ".join(
        r.choice("alpha beta gamma delta house river stone cloud table lamp".split()) + str(r.randrange(40)) for _ in range(n)
    )
    kinds = {
        "abuse": lambda: f"{fill(8)} you blockhead {fill(4)} such a dunderhead {fill(6)}", "misspelled": lambda: f"{fill(8)} you blockhaed {fill(4)} such a dunderhed {fill(6)}",
        "quoted": lambda: f'{fill(8)} he said "blockhead" and {fill(4)} wrote “a dunderhead” once {fill(6)}', "clean": lambda: fill(20),
    }
    rows = [
        (i, kinds[k](), k, int(k in ("abuse", "misspelled"))) for i, k in enumerate(["abuse", "misspelled", "quoted", "clean", "clean", "clean"] * 60)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, toxic int")
    got = toxicity.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")).join(df, "doc_id").collect()
    for k in kinds:
        right = [x.predicted == x.toxic for x in got if x.kind == k and x.held_out]
        assert len(right) > 5 and sum(right) >= 0.95 * len(right), k


def auc(pairs):
    ones, zeros = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    assert got.count() == 10_000
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    out = [(r.score, r.toxic) for r in rows if r.held_out]
    assert auc(out) > 0.9
    assert sum(s >= 0.5 and not y for s, y in out) <= 0.01 * len(out)
    assert sum(s >= 0.5 and y for s, y in out) >= 0.9 * sum(y for _, y in out)


def test_toxicity_odd_rows(spark, odd, none, clashing):
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, 0), (4, 1, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd, labels).count() == odd.count()
    assert toxicity.toxicity(none, labels).count() == 0
    no_labels = labels.limit(0)
    assert {r.score for r in toxicity.toxicity(odd, no_labels).collect()} == {0.5}
    assert toxicity.toxicity(clashing, spark.read.parquet(f"{SF}/labels.parquet")).count() == clashing.count()
