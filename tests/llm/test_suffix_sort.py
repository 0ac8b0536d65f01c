import numpy as np
import pytest

from lodestar.llm.suffix_sort import RangeMin, TupleQueue, joined_text, repeated, suffix_order


def plain(text, most):
    t = text.tolist()
    order = sorted(range(len(t)), key=lambda i: t[i:])
    lcp = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < most and a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        lcp.append(k)
    return order, lcp


@pytest.mark.parametrize("memory", [7, 10**6])
def test_suffix_order_and_common_prefixes(memory):
    rng = np.random.default_rng(5)
    for case in range(150):
        sigma = int(rng.choice([1, 2, 3, 20]))
        pieces = [rng.integers(0, sigma, int(rng.integers(1, 40))).astype(np.uint8) for _ in range(int(rng.integers(1, 6)))]
        if case % 3 == 0:
            pieces.append(np.concatenate([pieces[0], pieces[0], pieces[-1]]))
        text, _ = joined_text(pieces)
        order, lcp = suffix_order(text, 12, memory)
        want, want_lcp = plain(text, 12)
        assert order.tolist() == want
        assert lcp.tolist() == want_lcp


def test_repeated_strings():
    rng = np.random.default_rng(6)
    for _ in range(60):
        pieces = [rng.integers(0, 2, int(rng.integers(1, 30))).astype(np.uint8) for _ in range(4)]
        seen = {}
        for p, x in enumerate(pieces):
            for i in range(len(x) - 4):
                seen.setdefault(x[i : i + 5].tobytes(), []).append((p, i))
        want = [sorted(i for v in seen.values() if len(v) > 1 for q, i in v if q == p) for p in range(4)]
        assert [r.tolist() for r in repeated(pieces, 5)] == want


def test_queue_spills_and_orders():
    rng = np.random.default_rng(7)
    q = TupleQueue(10)
    keys, ties = rng.integers(0, 5, 100).astype(np.uint64), rng.permutation(100)
    for lo in range(0, 100, 9):
        q.push(keys[lo : lo + 9], ties[lo : lo + 9], np.arange(lo, min(100, lo + 9)))
    got = np.concatenate([b[2] for b in q.blocks()])
    assert got.tolist() == np.lexsort((ties, keys)).tolist()


def test_range_minimum():
    v = np.array([5, 3, 8, 1, 9, 2, 7], np.int32)
    pairs = [(i, j) for i in range(7) for j in range(i + 1, 8)]
    lo, hi = np.array(pairs).T
    assert RangeMin(v)(lo, hi).tolist() == [v[i:j].min() for i, j in pairs]
