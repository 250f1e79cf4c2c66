import hashlib
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import SF
from tests.oracle import assert_same, connect
from tidewright.llm import exact_dedup, quality, queries, repeats

W = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - {"op4_near_dedup"}))
def test_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])


@pytest.mark.parametrize("most", [32 << 20, 1 << 10])
def test_exact_odd_rows(odd, most):
    got = exact_dedup.exact_groups(odd, most).collect()
    assert len(got) == odd.count()
    groups = defaultdict(list)
    for r in got:
        groups[r.text_sha256].append(r)
    for g in groups.values():
        assert sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} and len({r.keep_id for r in g}) == 1
    by_id = {r.doc_id: r for r in got}
    assert by_id[4].keep_id == 6  # most code points in the original
    assert by_id[1].keep_id == 3 and by_id[1].group_size == 4


def test_exact_without_filter(docs, monkeypatch):
    want = sorted(map(str, exact_dedup.exact_groups(docs).collect()))
    monkeypatch.setattr(exact_dedup, "repeat_filter", lambda *a: None)
    assert sorted(map(str, exact_dedup.exact_groups(docs).collect())) == want


def test_filter_bounds():
    assert repeats.shards_for(1) == 1 and repeats.shards_for(10**12) == 0
    assert repeats.shards_for(10**7) * repeats.SHARD_BITS // 8 <= repeats.MOST_BYTES


def test_exact_drop(odd, none, clashing):
    kept = exact_dedup.drop_exact_duplicates(odd).collect()
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in odd.collect()})
    assert exact_dedup.drop_exact_duplicates(none).count() == 0 == exact_dedup.exact_groups(none).count()
    out = exact_dedup.drop_exact_duplicates(clashing)
    assert out.columns == clashing.columns and 0 < out.count() < clashing.count()


def brute(t):
    w = W.findall(t)
    five = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + j for i in range(len(w) - 4) if five[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if W.search(x)]
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), failed


def test_quality_equals_brute_force(docs, rows):
    got = {r.doc_id: r for r in quality.judge_repetition(docs).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t)
        assert not (r.base_failed and r.kept)
        w = W.findall(t)
        for n, share in r.ngram_shares.items():
            grams = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
            inside = {k + j for k in range(len(w) - n + 1) if grams[tuple(w[k : k + n])] > 1 for j in range(n)}
            size = sum(map(len, w))
            assert share == pytest.approx(sum(len(w[k]) for k in inside) / size if size else 0.0)
        lines = [x for x in t.split("\n") if W.search(x)]
        again = sum(map(len, lines)) - sum(map(len, set(lines)))
        assert r.line_share == pytest.approx(again / sum(map(len, lines)) if lines else 0.0)
        within = all(share <= quality.limit_at(quality.NGRAM_LIMITS[n], len(w)) for n, share in r.ngram_shares.items())
        assert r.kept == (not r.base_failed and r.line_share <= quality.LINE_LIMIT and within)


def test_quality_odd_rows(odd, none, clashing):
    got = quality.judge_repetition(odd).collect()
    assert len(got) == odd.count()
    for r, d in zip(got, odd.collect(), strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(d.text or "")
    assert quality.judge_repetition(none).count() == 0 == quality.keep_good(none).count()
    kept = quality.keep_good(clashing)
    assert kept.columns == clashing.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.judge_repetition(clashing).collect() if r.kept}


def test_shares_count_characters(spark):
    """A word of many bytes weighs as its characters do."""
    text = "ééééé ééééé bbbbb ééééé ééééé ccccc ddddd fffff ggggg hhhhh"
    got = quality.judge_repetition(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.word_chars == 50 and got.ngram_shares[2] == pytest.approx(20 / 50)


def test_long_repeats_are_rejected(spark):
    text = " ".join(f"w{i}" for i in range(80)) + " " + " ".join("only these ten words come again and again here".split() * 2)
    got = quality.judge_repetition(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.base_failed == brute(text)[-1]


def test_short_phrases_are_rejected(spark):
    """Stuffing that repeats no 5 words passes the base rule; clean, quoting and long texts stay."""
    fresh = iter(f"w{i:04d}" for i in range(10**6))
    new = lambda n: " ".join(next(fresh) for _ in range(n))
    quote = "as they said before all of this came to pass"
    stuffed = [
        " ".join(f"{p} {new(1)}" for _ in range(n)) for n,
        p in [(12, "buy now"), (60, "buy now"), (12, "cheap pills now"), (2500, "cheap pills now"), (2500, "cheap pills shipped now")]
    ] + [" ".join(f"{x} " * 5 for x in new(8).split())]
    pairs = [new(2) for _ in range(300)]
    good = [new(40), f"{new(50)} {quote} {new(30)} {quote} {new(15)}", " ".join(f"{pairs[i % 300]} {new(2)}" for i in range(1000))]
    got = {
        r.doc_id: r for r in quality.judge_repetition(spark.createDataFrame(list(enumerate(stuffed + good)), "doc_id long, text string")).collect()
    }
    assert not any(r.base_failed for r in got.values())
    assert [got[i].kept for i in range(len(got))] == [False] * len(stuffed) + [True] * len(good)
    assert quality.limit_at(0.2, 10**6) == 0.2 and quality.limit_at((0.3, 0.1, 0.45), 100) == 0.3
    assert quality.limit_at((0.3, 0.1, 0.45), 400) == pytest.approx(0.4) and quality.limit_at((0.3, 0.1, 0.45), 10**6) == 0.45


def test_digest():
    assert exact_dedup.digest_of("a b ".encode()) == hashlib.sha256("ab ".encode()).digest()
