"""op2's rounds send a row for each block and hash range: blocks grow with the ranges, so that rows don't get short."""

import numpy as np
import pytest

from fathom.llm import suffix
from fathom.llm.shared import settle


def test_rows_of_a_round_hold_enough_positions(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [rng.integers(97, 123, 150, dtype=np.uint8) for _ in range(2000)]
    rows = [(i, 0, 7, base[i % 2000].tobytes() if i < 2500 else np.roll(base[i - 2500], 20).tobytes()) for i in range(4000)]
    contexts = spark.createDataFrame([(d, t, s, bytearray(x)) for d, t, s, x in rows], "doc long, tie long, start long, text binary").repartition(3)

    def entries():
        out = set()
        for r in suffix._doubled(settle(contexts), 100, 4).collect():
            out |= set(zip(*(np.frombuffer(x, "<i8").tolist() for x in (r.docs, r.s, r.n))))
        return out

    want = entries()
    sent, pairs = [], suffix._pairs

    def counted(*args):
        out = pairs(*args)
        sent.append(out.count())
        return out

    monkeypatch.setattr(suffix, "_pairs", counted)
    monkeypatch.setattr(suffix, "BLOCK", 1 << 12)
    monkeypatch.setattr(suffix, "RANGE_POSITIONS", 1 << 14)
    monkeypatch.setattr(suffix, "ROW_POSITIONS", 256, raising=False)
    assert entries() == want and len(want) >= 500
    assert max(sent) * 256 <= 1.3 * 4000 * 150


@pytest.mark.parametrize("gb", [1, 6, 12])
def test_blocks_grow_with_the_ranges(gb):
    positions = gb * 366_000_000  # of the fringe, as over check_l
    shards = -(-positions // suffix.RANGE_POSITIONS)
    assert suffix._block_bytes(shards) <= suffix.RANGE_POSITIONS
    assert positions / suffix._block_bytes(shards) * shards <= 1.05 * positions / 1024


def test_repeated_and_kinds_against_unique():
    rng = np.random.default_rng(7)
    for n, top in ((0, 5), (1, 5), (1000, 300), (5000, 1 << 40), (64, 1)):
        key = rng.integers(0, top, n, dtype=np.uint64)
        u, first, rank, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        got = suffix._kinds(key)
        for a, b in zip(got, (first, rank, count)):
            assert a.tolist() == b.tolist()
        assert key[got[0]].tolist() == u.tolist()
        assert suffix._repeated(key).tolist() == np.flatnonzero(count[rank] > 1).tolist()
    assert suffix._repeated(np.array([3, 1, 3, 2], "<u4")).tolist() == [0, 2]
