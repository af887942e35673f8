import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from viewloom.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def whole(tokenizer, text):
    return len(tokenizer.encode(text or "", add_special_tokens=False))


def test_rows_equal_the_library(tricky, pairs, tokenizer, by_rows):
    got = tokens.count_tokens(tricky, PATH, chunk=4000, overlap=100).select("doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(i, len((t or "").encode()), n := whole(tokenizer, t), n > 1024) for i, t in pairs]
    assert by_rows(got.collect()) == by_rows(want)


PARTS = [" ", "  ", "\n", " \n", "a", "bc", "é", "1", "<|endoftext|>", "<|endof", "'s", "!!", "　", "\x1c", "日本", "’"]


def test_pieces_and_splices_equal_the_library(tokenizer):
    rng = random.Random(3)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 300))) for _ in range(300)]
    counter = tokens.Counter(PATH, chunk=10_000)
    assert [n for n, _ in counter.count(texts)] == [whole(tokenizer, t) for t in texts]
    for text in texts:
        assert tokens.count_spliced(tokenizer, text, 100, 40)[0] == whole(tokenizer, text)


def test_an_overlap_without_a_common_place_is_widened(tokenizer):
    text = "word " * 50 + "a" * 900 + " end" * 100
    count, widened = tokens.count_spliced(tokenizer, text, 300, 40)
    assert count == whole(tokenizer, text) and widened > 0


def test_the_memo_is_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(tokens, "MEMO", 50)
    counter = tokens.Counter(PATH)
    texts = [" ".join(f"w{k}x{i}" for k in range(40)) for i in range(20)]
    for t in texts:
        assert counter.count([t])[0][0] == whole(tokenizer, t)
        assert len(counter.memo) <= 90


def test_no_rows(nothing):
    assert tokens.count_tokens(nothing, PATH).count() == 0
