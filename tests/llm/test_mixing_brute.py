"""The mixture against one worked out row by row in plain Python."""

import math
import struct

import pytest
import xxhash

from viewloom.llm import mixing


def h(data, seed):
    return xxhash.xxh64_intdigest(data, seed)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def key_of(doc_id, text):
    # a null is passed over
    seed = 42 if doc_id is None else h(doc_id.encode(), 42)
    return h((text or "").encode(), seed)


def draw_of(key, number):
    return h(struct.pack("<i", mixing.SEED), h(struct.pack("<q", number), h(struct.pack("<Q", key), 42)))


def exponent_of(tokens, evenness, max_repeats, budget):
    tokens = [t for t in tokens if t]

    def weights(a):
        return [(t / max(tokens)) ** a for t in tokens]

    def even(a):
        w = weights(a)
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w) / math.log(len(w)) if len(w) > 1 else 1.0

    def repeats(a):
        scale = 1.0 if budget is None else budget / (sum(weights(a)) * max(tokens))
        return max(w / (t / max(tokens)) for w, t in zip(weights(a), tokens)) * scale

    def least(meets):
        if meets(0.0):
            return 0.0
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if meets(middle) else (middle, high)
        return high

    flat = (1.0 if max_repeats is None else 0.0) if evenness is None else least(lambda a: even(a) <= evenness)
    rare = 0.0 if max_repeats is None else least(lambda a: repeats(a) <= max_repeats)
    return max(flat, rare)


def by_hand(rows, evenness, max_repeats, budget):
    sources = {}
    for doc_id, source, text in rows:
        sources.setdefault(source, []).append((doc_id, text, key_of(doc_id, text), len((text or "").split())))
    totals = {s: sum(r[3] for r in own) for s, own in sources.items()}
    a, largest = exponent_of(totals.values(), evenness, max_repeats, budget), max(totals.values())
    z = sum((t / largest) ** a for t in totals.values() if t)
    out = []
    for source, own in sources.items():
        times = (totals[source] / largest) ** (a - 1) * (1 if budget is None else budget / (z * largest)) if totals[source] else 1.0
        blocks, whole = math.ceil(math.sqrt(len(own))), math.floor(times)
        rest = math.floor((times - whole) * totals[source])

        def place(row, number):
            draw = draw_of(row[2], number)
            return (draw >> 1) % blocks, signed(draw)

        for number in range(whole):
            out += [(row[0], source, number, *place(row, number)) for row in own]
        given = 0
        for at in sorted({place(row, whole) for row in own}) if rest else ():
            together = [row for row in own if place(row, whole) == at]
            given += sum(row[3] for row in together)
            if given > rest:
                break
            out += [(row[0], source, whole, *at) for row in together]
    return out


@pytest.mark.parametrize("evenness, max_repeats, budget", [(0.9, 2.0, None), (0.97, None, None), (None, 1.7, None), (0.9, None, 700), (0.8, 3.0, 3001), (None, None, None)])
def test_as_by_hand(spark, by_rows, evenness, max_repeats, budget):
    sizes = {"big": 150, "mid": 40, "small": 21, None: 10}
    rows = [(f"{s}{k}", s, "w " * (1 + k % 7)) for s, n in sizes.items() for k in range(n)]
    rows += [("e", "empty", ""), ("n", "empty", None), (None, "big", "w w"), ("big1", "big", "w " * 2), ("z", "mid", None)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, text string")
    mixed = mixing.mix_sources(docs, evenness=evenness, max_repeats=max_repeats, budget=budget)
    got = mixed.select("doc_id", "source", "pass", "block", "draw").collect()
    assert by_rows(got) == by_rows(by_hand(rows, evenness, max_repeats, budget))
