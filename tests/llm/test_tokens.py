import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm.tokens import TOKENIZER_DIR, WORD_PATTERN, Encoder, encode_corpus, encoder, token_counts, vocabulary_path

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    rows = open(os.path.join(TOKENIZER_DIR, "byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rows)}
    return tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="aabcdeinst \n'0", max_size=80)), max_size=5))
def test_equals_public_encoder(reference, texts):
    enc = encoder(vocabulary_path())
    ids, counts = enc.encode(texts)
    want = [reference.encode_ordinary(t) for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]
    assert enc.count(texts).tolist() == counts.tolist()


def test_every_token_and_long_words(reference):
    enc = Encoder(vocabulary_path())
    for word in ("a" * 20_000, "ab" * 5_000, "<|endoftext|>", "é漢字😀"):
        ids, _ = enc.encode([word])
        assert ids.tolist() == reference.encode_ordinary(word)
    assert reference.decode(enc.encode(["round trip, 42 ≤ x"])[0].tolist()) == "round trip, 42 ≤ x"


def test_corpus(spark, reference):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, "", "y"), (3, None, None), (None, " a", "z"), (1, "Hello world", "x")], "doc_id long, text string, ids string")
    rows = sorted(((r.doc_id, list(r.ids)) for r in encode_corpus(df).collect()), key=repr)
    assert rows == sorted([(1, reference.encode_ordinary("Hello world"))] * 2 + [(2, []), (3, []), (None, reference.encode_ordinary(" a"))], key=repr)
    assert encode_corpus(df.limit(0)).count() == 0
    sizes = {r.doc_id: r.n_tokens for r in token_counts(df, ["doc_id"]).collect()}
    assert sizes == {1: 2, 2: 0, 3: 0, None: 1}
