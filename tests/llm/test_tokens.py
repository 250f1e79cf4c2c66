import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import byte_bpe, token_count

P = pytest.importorskip("public_tokenizers")
NAMES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def reference(name):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path(name)), special_tokens={})


@pytest.fixture(scope="module", params=NAMES)
def both(request):
    return byte_bpe.Codec(byte_bpe.serialise(byte_bpe.read_ranks(P.path(request.param))), P.PATTERN), reference(request.param)


def test_byte_characters():
    chars = byte_bpe.byte_characters()
    assert len(set(chars)) == 256 and not any(c.isspace() for c in chars)


def test_documents(both, rows):
    codec, other = both
    for _, t in rows:
        ids = codec.encode(t)
        assert ids.tolist() == other.encode_ordinary(t)
        assert codec.decode(ids.tolist()) == t.encode()


def test_every_entry(both):
    codec, _ = both
    for i in random.Random(1).sample(range(len(codec.bytes_of)), 2000):
        assert codec.decode([i]) == codec.bytes_of[i]


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_any_text(both, text):
    codec, other = both
    ids = codec.encode(text).tolist()
    assert ids == other.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_digests_and_round_trip(docs, odd, none):
    path = P.path(NAMES[1])
    other = reference(NAMES[1])
    for df in (docs, odd):
        want = [(r.doc_id, other.encode_ordinary(r.text or ""), r.text or "") for r in df.collect()]
        got = byte_bpe.token_digests(df, path, P.PATTERN).collect()
        import numpy as np

        assert [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got] == [
            (i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, x, t in want
        ]
        coded = byte_bpe.encode_documents(df, path, P.PATTERN)
        assert [(r.token_ids, bytes(r.decoded)) for r in coded.collect()] == [(x, t.encode()) for _, x, t in want]
        back = byte_bpe.decode_ids(coded.drop("decoded"), path, P.PATTERN).collect()
        assert [bytes(r.decoded) for r in back] == [t.encode() for _, _, t in want]
    assert byte_bpe.token_digests(none, path, P.PATTERN).count() == 0 == byte_bpe.encode_documents(none, path, P.PATTERN).count()


def test_clashing_columns(clashing, docs):
    """Columns of the names that are added stay, whatever their case; the new ones come last under other names."""
    from pyspark.sql import functions as F

    path = P.path(NAMES[1])
    df = clashing.withColumns({"token_ids": F.lit("own"), "Decoded": F.lit("mine"), "n_tokens": F.lit(-1), "round_trip": F.lit("r")})
    coded = byte_bpe.encode_documents(df, path, P.PATTERN)
    assert coded.columns == [*df.columns, "_token_ids", "_decoded"]
    out = byte_bpe.add_tokens(df, path, P.PATTERN)
    assert out.columns == [*df.columns, "_token_ids", "_n_tokens", "_round_trip"]
    r = out.first()
    assert (r.token_ids, r.Decoded, r.n_tokens, r.round_trip) == ("own", "mine", -1, "r") and r._round_trip and r._n_tokens == len(r._token_ids)
    assert byte_bpe.add_tokens(docs, path, P.PATTERN).columns == [*docs.columns, "token_ids", "n_tokens", "round_trip"]
    assert byte_bpe.token_digests(df, path, P.PATTERN).count() == docs.count() == token_count.count_tokens(df, P.path("piece_bpe_32k.model")).count()
    assert byte_bpe.decode_ids(coded.drop("_decoded"), path, P.PATTERN, "_token_ids").columns[-1] == "_decoded"


@pytest.fixture(scope="module")
def counter():
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        return token_count.Counter(token_count.read_scores(f.read()))


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


TRICKY = [
    "", " ", "  a  b ", "\n\n x\n", "▁▁x ▁", "<s> </s> <unk> <0x41>", "a" * 3000, "日本語 テスト", "\u0000\u0001 x", "    \t\n\r   foo", "😀😀 zero​width",
    "1234567", "▁" * 40
]


def test_counts(counter, pieces, rows):
    texts = [t for _, t in rows] + TRICKY
    assert [counter.count(t) for t in texts] == [len(x) for x in pieces.encode(texts, num_threads=1)]


@given(st.text(alphabet=st.one_of(st.sampled_from(" \n▁aet<x1"), st.characters(exclude_categories=["Cs"])), max_size=60))
@settings(max_examples=200, deadline=None)
def test_any_count(counter, pieces, text):
    assert counter.count(text) == len(pieces.encode(text))


def test_count_query(odd, none, pieces):
    path = P.path("piece_bpe_32k.model")
    for r, d in zip(token_count.count_tokens(odd, path).collect(), odd.collect(), strict=True):
        n = len(pieces.encode(d.text or ""))
        assert (r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) == (d.doc_id, len((d.text or "").encode()), n, n > 4096)
    assert token_count.count_tokens(none, path).count() == 0


def test_other_normalisation_is_refused():
    with pytest.raises(ValueError):
        token_count.read_scores(byte_bpe._field(3, byte_bpe._field(1, "nmt_nfkc")))


def test_other_models_are_refused():
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    assert token_count.read_scores(model)
    piece = byte_bpe._field(1, byte_bpe._field(1, "own") + byte_bpe._field(2, 0.0) + byte_bpe._field(3, 4))
    with pytest.raises(ValueError, match="user"):
        token_count.read_scores(model + piece)
    with pytest.raises(ValueError, match="byte pieces"):  # no byte pieces
        token_count.read_scores(
            byte_bpe.serialise({b"a": 0}).replace(byte_bpe._field(5, False), byte_bpe._field(5, True)).replace(
                byte_bpe._field(3, False) + byte_bpe._field(4, False), byte_bpe._field(3, True) + byte_bpe._field(4, False)
            )
        )
