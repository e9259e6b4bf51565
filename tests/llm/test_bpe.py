"""The streaming transducer against the library, and its lookahead against all continuations."""

import itertools
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from visitprep.llm import bpe, queries

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.default_tokenizer()
ODD = ["'", "s", "re", "ll", "D", "A", "ß", "É", "é", "́", "ͅ", "가", "ᄀ", "ᅡ", "ᆨ", "漢", "1", "²", "!", "<|", "<|endoftext|>", " ", "\n", "\x85", "　", "\x1c", "İ", "Σ", "ſ", "\U0001f600", "‍", "\x00", "ﬁ", "in", "th", "ing", "don't", "'LL"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH)


@pytest.fixture(scope="module")
def decoder():
    return bpe.Decoder(PATH)


def ids(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=40).map("".join))
def test_same_ids_and_text(library, encoder, decoder, text):
    got = encoder.encode(text)
    assert got == ids(library, text)
    assert decoder.decode(got) == library.decode(np.frombuffer(got, "<u4").tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("block", [4, 7, 16])
def test_same_ids_in_small_blocks(library, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK", block)
    small, rng = bpe.Encoder(PATH), random.Random(block)
    for _ in range(3000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randrange(60)))
        assert small.encode(text) == ids(library, text), ascii(text)


def test_long_words_in_constant_memory(library, encoder):
    rng = random.Random(5)
    pieces = [t for t in library.get_vocab() if t.isascii() and t.isalpha()]
    for text in ("a" * 20_000, "in" * 9_000, "!" * 9_000, "漢" * 9_000, "".join(rng.choice(pieces) for _ in range(9_000)), "".join(rng.choice("aeinrst") for _ in range(30_000))):
        assert encoder.encode(text) == ids(library, text)
    one, held = bpe.Transducer(encoder.merges), 0
    for _ in range(300):
        one.feed(b"interestingly" * 10)
        held = max(held, len(one.waiting))
    assert held <= one.limit


def small_list(rng, letters="abc", n=9):
    """A random proper merge list over few letters."""
    shown = bpe.byte_characters()
    vocabulary = {c: i for i, c in enumerate(shown)}
    tokens, merges = list(letters), []
    while len(merges) < n:
        left, right = rng.choice(tokens), rng.choice(tokens)
        if left + right not in vocabulary:
            vocabulary[left + right] = len(vocabulary)
            tokens.append(left + right)
            merges.append((left, right))
    return bpe.MergeList(vocabulary, merges)


@pytest.mark.parametrize("seed", range(8))
def test_lookahead_settles_tokens(seed):
    """Whatever follows, tokens that end a lookahead before the end of what was read stay."""
    rng = random.Random(seed)
    rules = small_list(rng)
    for _ in range(25):
        seen = [ord(rng.choice("abc")) for _ in range(rules.lookahead + rng.randrange(1, 12))]
        inner = [rules.inner[b] for b in seen]
        ends = list(itertools.accumulate(rules.size[t] for t in rules.merge(inner)))
        settled = [e for e in ends if e <= len(seen) - rules.lookahead]
        for more in itertools.product("abc", repeat=2):
            longer = rules.merge(inner + [rules.inner[ord(c)] for c in more])
            assert list(itertools.accumulate(rules.size[t] for t in longer))[: len(settled)] == settled


def test_unordered_rules_are_refused():
    vocabulary = {c: i for i, c in enumerate(bpe.byte_characters())} | {"ab": 256, "abc": 257}
    with pytest.raises(ValueError, match="out of order"):
        bpe.MergeList(vocabulary, [("ab", "c"), ("a", "b")])


def test_byte_level_decoder_holds_back_broken_characters():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, decoder, rng = tokenizers.Tokenizer.from_file(path), bpe.Decoder(path), random.Random(2)
    for text in ("naïve 漢字 \U0001f600 end", "", "é" * 50):
        known = library.encode(text).ids
        assert "".join([*(decoder.feed([i]) for i in known), decoder.close()]) == text
    for _ in range(300):
        some = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert decoder.decode(np.array(some, "<u4").tobytes()) == library.decode(some, skip_special_tokens=False)


def test_other_layouts_are_refused(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError, match="not a tokenizer of"):
        bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    told = json.load(open(PATH, encoding="utf-8"))
    told["decoder"] = {"type": "Metaspace"}
    (tmp_path / "odd.json").write_text(json.dumps(told))
    with pytest.raises(ValueError, match="Metaspace"):
        bpe.Decoder(str(tmp_path / "odd.json"))


def test_awkward_rows(awkward, empty, library):
    got = bpe.decode(bpe.encode(awkward), keep=["doc_id", "ids"]).collect()
    want = sorted(((r.doc_id, ids(library, r.text or "")) for r in awkward.collect()), key=repr)
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got), key=repr) == want
    assert all(r.decoded == library.decode(np.frombuffer(bytes(r.ids), "<u4").tolist(), skip_special_tokens=False) for r in got)
    both = bpe.round_trip(awkward).collect()
    assert sorted(map(repr, both)) == sorted(map(repr, got))
    assert bpe.decode(bpe.encode(empty)).count() == 0 and bpe.round_trip(empty).count() == 0
    kept = bpe.encode(awkward, keep=["doc_id", "size", "spans", "text"]).collect()
    assert len(kept) == len(got) and {r.spans for r in kept} == {"x", None}
    with pytest.raises(ValueError, match="not called 'ids'"):
        bpe.encode(awkward.withColumnRenamed("spans", "ids"), keep=["ids"])


def test_query_is_a_digest_of_the_library(spark, library):
    import hashlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.queries()["op12_bpe"](spark, "/root/testdata/sf0.001").collect()}
    want = {}
    for r in docs:
        data = ids(library, r.text or "")
        text = library.decode(np.frombuffer(data, "<u4").tolist(), skip_special_tokens=False)
        want[r.doc_id] = (len(data) // 4, hashlib.sha256(data).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert got == want
