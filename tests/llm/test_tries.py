import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from viewloom.llm import tries

TURN = "conv_id long, turn long, role string, text string"


def rebuilt_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            told = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, told, role, text))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
    return out


def by_hand(rebuilt):
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    leaves, saved, out = defaultdict(int), defaultdict(int), []
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1].encode()) if node else 0
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if rebuilt[c] == node)
        parent = min(members[node[:-1]]) if node else None
        hashed = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(own), len(node), parent, len(own), len(kids[node]) if node in kids else 0, leaves[node], saved[node], hashed))
    return out


def found(spark, rows, limit):
    lists = tries.regraft(tries.turn_lists(spark.createDataFrame(rows, TURN)))
    return tries.prefix_trie(lists, limit).select(*tries.COLUMNS).collect()


def talks(n, seed=1, turns=7, words=2):
    rng = random.Random(seed)
    return [(c, t, rng.choice("ua"), rng.choice("éx") * rng.randrange(1, words + 1)) for c in range(n) for t in range(rng.randrange(1, turns))]


@pytest.mark.parametrize("limit", [1, 5, 512])
def test_as_by_hand(spark, by_rows, limit):
    rows = talks(120)
    assert by_rows(found(spark, rows, limit)) == by_rows(by_hand(rebuilt_by_hand(rows)))


def test_long_common_beginning_bursts_once(spark, by_rows, monkeypatch):
    """A large group that shares many turns parts in one round, and copies end in one node."""
    rows = [(5 * c, t, "u", f"turn {t}") for c in range(40) for t in range(60)]
    rows += [(5 * c, 60, "u", f"own {c % 3}") for c in range(20)]
    rounds = []
    burst = tries._burst
    monkeypatch.setattr(tries, "_burst", lambda *a: rounds.append(1) or burst(*a))
    assert by_rows(found(spark, rows, 6)) == by_rows(by_hand(rebuilt_by_hand(rows)))
    # at depth 60, and at the copies' ends: 7, 7 and 6 of them
    assert len(rounds) <= 3


def test_odd_rows(spark, by_rows):
    rows = talks(20) + talks(20)[:15] + [(None, 1, "u", "x"), (3, None, None, None), (3, None, "u", ""), (-7, 0, "", None), (10**12, 1, "u", "y" * 50000)]
    for limit in (2, 512):
        assert by_rows(found(spark, rows, limit)) == by_rows(by_hand(rebuilt_by_hand(rows)))
    assert found(spark, [], 5) == []


def test_other_columns_are_not_read(spark):
    docs = spark.createDataFrame(talks(9), TURN)
    more = docs.withColumns({c: F.lit("z") for c in ("t", "ids", "sizes", "head", "top", "parent", "id", "a.b", "stem")})
    assert tries.turn_lists(more).count() == 9
    assert sorted(tries.turn_lists(more).collect()) == sorted(tries.turn_lists(docs).collect())


def test_sweep_of_a_single_turnless_conversation():
    assert tries.sweep([(4, [], [])], 0) == [[4, 0, None, 1, 0, 1, 0, hashlib.sha256(b"4").hexdigest()]]
