import random
from bisect import bisect_left, insort

import pytest

from braidworks.operators import churn

LOG = "thread long, seq long, is_delete boolean, key long"


def one_set(log):
    """The log with what each entry did, by one sorted list a thread."""
    live, out = {}, []
    for thread, seq, is_delete, key in sorted(log):
        keys = live.setdefault(thread, [])
        at = bisect_left(keys, key)
        if is_delete:
            victim = keys.pop(at) if at < len(keys) else None
            out.append((thread, seq, True, key, victim, 0 if victim is None else -1))
        else:
            new = not (at < len(keys) and keys[at] == key)
            if new:
                insort(keys, key)
            out.append((thread, seq, False, key, None, int(new)))
    return out


def plain(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("deletes,hot", [(0.1, 0.0), (0.45, 0.0), (0.6, 0.5)])
def test_replay_in_ranges_is_one_sets(spark, deletes, hot):
    draw = random.Random(int(deletes * 100))
    log = [(0 if draw.random() < 0.8 else draw.randrange(1, 4), seq, draw.random() < deletes, 77 if draw.random() < hot else draw.randrange(5000)) for seq in range(10_000)]
    expected = one_set(log)
    assert any(r[2] and r[4] is None for r in expected) and any(r[4] is not None for r in expected)
    got = churn.replay(spark.createDataFrame(log, LOG).repartition(3), ranges=7)
    assert plain(got.collect()) == plain(expected)


def test_a_delete_passes_ranges_that_are_empty_by_then(spark):
    puts = [(0, k, False, k) for k in range(100)]  # all ranges have had keys
    drain = [(0, 100 + k, True, 10) for k in range(90)]  # up to the last one, then none is left
    more = [(0, 300, True, 10), (0, 301, False, 55), (0, 302, True, 10), (0, 303, True, 9), (0, 303, True, 9)]
    log = puts + drain + more
    got = churn.replay(spark.createDataFrame(log, LOG), ranges=5).collect()
    assert plain(got) == plain(one_set(log))
    assert {r.seq: r.victim for r in got if r.seq > 299 and r.is_delete and r.seq != 303} == {300: None, 302: 55}


def test_nulls_ties_and_no_rows(spark):
    log = [(0, 1, True, 5), (0, 1, False, 5), (0, 1, False, 5), (0, 2, True, 5), (None, 3, False, 1), (0, None, False, 1), (0, 4, None, 1), (0, 5, False, None)]
    got = plain(churn.replay(spark.createDataFrame(log, LOG), ranges=3).collect())
    assert got == plain(one_set(log[:4]))
    assert churn.replay(spark.createDataFrame([], LOG)).count() == 0
    words = spark.createDataFrame([("a", 1, False, "x"), ("a", 2, False, "é"), ("a", 3, True, "y"), ("a", 4, True, "")], "thread string, seq int, is_delete boolean, key string")
    assert {r.seq: r.victim for r in churn.replay(words, ranges=2).where("is_delete").collect()} == {3: "é", 4: "x"}


def test_a_log_ends_when_the_set_is_large_enough(spark):
    draw = random.Random(4)
    log = [(seq % 2, seq, draw.random() < 0.2, draw.randrange(300)) for seq in range(1000)] + [(9, 1, False, 1)]
    replayed = one_set(log)
    expected, held, over = [], {}, set()
    for r in replayed:
        if r[0] not in over:
            held[r[0]] = held.get(r[0], 0) + r[5]
            if not r[2] or r[4] is not None:
                expected.append((r[0], r[1], r[2], r[3] if r[4] is None else r[4]))
            if held[r[0]] >= 50:
                over.add(r[0])
    assert over == {0, 1}
    cut = churn.commands(churn.until_size(churn.replay(spark.createDataFrame(log, LOG), ranges=4), 50))
    assert plain(cut.collect()) == plain(expected)


def test_ordered_keys_split_and_empty_their_blocks(monkeypatch):
    monkeypatch.setattr(churn, "BLOCK", 4)
    draw, keys, plain_keys = random.Random(1), churn.OrderedKeys(), []
    for _ in range(3000):
        k = draw.randrange(200)
        at = bisect_left(plain_keys, k)
        if draw.random() < 0.55:
            new = not (at < len(plain_keys) and plain_keys[at] == k)
            assert keys.add(k) == new
            if new:
                insort(plain_keys, k)
        else:
            assert keys.pop_from(k) == (plain_keys.pop(at) if at < len(plain_keys) else None)
        assert [x for b in keys.blocks for x in b] == plain_keys and keys.highest == [b[-1] for b in keys.blocks]
