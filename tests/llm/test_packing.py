import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from viewloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def whole(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def brute(tokenizer, text, capacity):
    ids = whole(tokenizer, text) + bytes(4)
    starts = range(0, len(ids) // 4, capacity)
    parts = [ids[4 * s : 4 * (s + capacity)] for s in starts]
    return [(k, s, len(p) // 4, zlib.crc32(p)) for k, (s, p) in enumerate(zip(starts, parts))]


PARTS = [" ", "\n", "a", "the", "É", "1", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "!!", "　", "\x1c", "Σ", "H̱", "İ", "K", "x."]


def test_ids_equal_the_library(tokenizer):
    rng = random.Random(4)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 60))) for _ in range(500)]
    texts += [f"The {w}. {w.upper()}!? ({w})" for w in ("straße", "çan", "ªº", "ǆ", "don't", "x" * 100)]
    assert list(packing.Ids(PATH).ids(texts)) == [whole(tokenizer, t) for t in texts]


def check_sequences(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        place = 0
        for offset, length in sorted(own):
            assert offset == place
            place += length
        assert place <= capacity
    return sequences


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pieces_and_places(tricky, pairs, tokenizer, by_rows, capacity):
    rows = packing.pack_documents(tricky, PATH, capacity).collect()
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert by_rows(got) == by_rows((i, *p) for i, t in pairs for p in brute(tokenizer, t, capacity))
    sequences = check_sequences(rows, capacity)
    assert len(sequences) <= 1.02 * sum(r.length for r in rows) / capacity + 1


def test_few_sequences(spark):
    """Many blocks still come within a few sequences of the least possible number."""
    rng = random.Random(1)
    lengths = [rng.randint(20, 1900) if rng.random() < 0.5 else rng.randint(5, 300) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long").cache()
    rows = packing.pack_items(items, len(lengths), 2048, block=512).collect()
    assert sorted(r.uid for r in rows) == list(range(len(lengths)))
    bins = {}
    for r in rows:
        bins[r.block, r.bin] = bins.get((r.block, r.bin), 0) + lengths[r.uid]
    assert max(bins.values()) <= 2048
    assert len(bins) <= sum(lengths) / 2048 * 1.01 + 6
    again = packing.pack_items(items.repartition(7), len(lengths), 2048, block=512).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_a_child_has_every_item_once():
    rng = random.Random(7)
    lengths = [rng.randint(1, 99) for _ in range(200)]
    one, other = (packing.Packing([], lengths, 100).best_fit(rng.sample(range(200), 200)) for _ in range(2))
    for child in (packing.inject(one, other, rng), packing.mutate(one, rng)):
        assert sorted(i for b in child.bins for i in b) == list(range(200))
        assert max(child.fills) <= 100 and child.fills == [sum(lengths[i] for i in b) for b in child.bins]
        assert packing.decode(packing.encode(child), lengths, 100).fills == child.fills


def test_generations_help_where_best_fit_fails():
    """Triples that fill a bin exactly: falling order does not find them."""
    rng = random.Random(2)
    lengths = []
    for _ in range(40):
        a, b = rng.randint(260, 400), rng.randint(260, 400)
        lengths += [a, b, 1000 - a - b]
    plain = packing.Packing([], lengths, 1000).best_fit(sorted(range(120), key=lambda i: -lengths[i]))
    evolved = packing.evolve(lengths, [], "s", 1000, 60, 6)
    assert len(evolved.bins) < len(plain.bins)


def test_no_rows(nothing):
    assert packing.pack_documents(nothing, PATH).count() == 0
