import hashlib
import json
import random
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sagaframe.llm import bpe as B

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def mine():
    with open(PATH, encoding="utf-8") as f:
        return B.load(f.read())


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


def same(mine, theirs, text):
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids
    assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


ODD = ["", "  ", "<|endoftext|>a<|startoftext|>", "ΑΣ ΣΑΣ", "İIıſ", "a\x1cb\x85c d　e", "é", "don't WE'LL '’s x²½ ٣ 漢字かな 😀", "﻿x\x00y"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(mine, theirs, text):
    same(mine, theirs, text)


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cn", "Cs"]), max_size=80))
def test_any_text(mine, theirs, text):
    same(mine, theirs, text)


def test_long_words_stream(mine, theirs):
    rng = random.Random(4)
    for n in (700, 3000, 9000):
        same(mine, theirs, "".join(rng.choice("aestinorlhcd") for _ in range(n)))
    same(mine, theirs, "a" * 4000 + " " + "ha" * 2000)


def small(merges):
    alphabet = B.byte_alphabet()
    vocab = [c + e for e in ("", B.SUFFIX) for c in alphabet] + list(dict.fromkeys(a + b for a, b in merges))
    spec = {"model": {"vocab": {t: i for i, t in enumerate(vocab)}, "merges": [f"{a} {b}" for a, b in merges]}, "added_tokens": []}
    return B.Bpe(json.dumps(spec))


def test_lookahead_suffices_for_small_merge_lists(monkeypatch):
    """Streams with little room agree with merging the whole word at once."""
    monkeypatch.setattr(B, "WINDOW_BYTES", 1)
    rng = random.Random(7)
    for _ in range(60):
        tokens, merges = ["a", "b", "c"], []
        for _ in range(rng.randrange(2, 14)):
            pair = rng.choice(tokens), rng.choice(tokens)
            if pair[0] + pair[1] not in tokens:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        bpe = small(merges)
        for _ in range(20):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 120))).encode()
            whole = bpe._merge([bpe.start[x] for x in word[:-1]] + [bpe.final[word[-1]]])
            assert [*bpe.transduce(word)] == whole


def test_decoding_is_incremental(mine, theirs):
    text = "héllo wörld 😀 <|endoftext|>"
    ids = mine.encode(text)
    assert mine.decode(ids, readable=True) == text
    assert mine.decode(mine.encode("𐍈")[:1], readable=True).endswith("�")
    for readable, want in ((True, text), (False, theirs.decode(ids, skip_special_tokens=False))):
        machine = B.Decoder(mine, readable)
        parts = [machine.push([i]) for i in ids] + [machine.end()]
        assert "".join(parts) == want and machine.push([]) == ""


def test_every_word_goes_through_the_transducer(monkeypatch):
    with open(PATH, encoding="utf-8") as f:
        bpe = B.Bpe(f.read())
    seen, plain = [], bpe.transduce
    monkeypatch.setattr(bpe, "transduce", lambda word: seen.append(word) or plain(word))
    long = "x" * 5000 + "yz" * 3000
    bpe.encode(f"one two {long} two")
    assert seen == [b"one", b"two", long.encode()]
    assert bpe.encode(long) == bpe._merge([bpe.start[x] for x in long.encode()[:-1]] + [bpe.final[ord("z")]]) and len(seen) == 4


def test_query_and_odd_rows(spark, sf_dir, mine, theirs):
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = B.op9_bpe_codec(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = theirs.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    rows = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "Hi there", 3)], "doc_id long, text string, ids int")
    out = sorted(((r.doc_id, r.n_tokens, r.decoded_text) for r in B.encode_documents(rows).collect()), key=repr)
    assert out == sorted([(None, 0, ""), (1, 0, ""), (1, 2, "hi there ")], key=repr)
    assert B.encode_documents(rows.filter("false")).count() == 0


def test_decoded_digest_is_made_from_the_ids(theirs, monkeypatch):
    with open(PATH, encoding="utf-8") as f:
        bpe = B.Bpe(f.read())
    monkeypatch.setattr(B, "load", lambda file: bpe)
    monkeypatch.setattr(B, "WORDS_AT_ONCE", 3, raising=False)
    texts = ["", " ", "one two <|endoftext|> three, four's five " * 3, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["__id", "__text"])
    run = lambda: next(B._coded(SimpleNamespace(value=""), False)([batch])).to_pylist()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    before = run()
    for r, text in zip(before, texts):
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(theirs.decode(ids, skip_special_tokens=False))
    bpe.token[bpe.encode("three")[0]] = "wrong"  # after its word has been met
    after = run()
    assert after[2]["ids_sha256"] == before[2]["ids_sha256"] and after[2]["decoded_sha256"] != before[2]["decoded_sha256"]
