import numpy as np

from quillstone.llm.cuckoo import CuckooFilter


def keys(rng, n):
    return rng.integers(-(2**63), 2**63 - 1, n), rng.integers(-(2**63), 2**63 - 1, n)


def test_inserted_keys_are_found_and_deleted_ones_go():
    rng = np.random.default_rng(1)
    a, b = keys(rng, 50_000)
    f = CuckooFilter.from_bytes(CuckooFilter.of(a, b).to_bytes())
    more = keys(rng, 5_000)
    assert f.insert(*more)
    assert f.contains(a, b).all() and f.contains(*more).all()
    assert f.contains(*keys(rng, 100_000)).mean() < 0.001
    assert f.delete(a[:30_000], b[:30_000]) == 30_000
    assert f.contains(a[30_000:], b[30_000:]).all() and f.contains(*more).all()
    assert f.contains(a[:30_000], b[:30_000]).mean() < 0.001
    assert f.delete(a[30_000:], b[30_000:]) + f.delete(*more) == 25_000
    assert not f.table.any()


def test_a_full_table_says_so_and_keeps_what_it_has():
    rng = np.random.default_rng(2)
    a, b = keys(rng, 100)
    f = CuckooFilter.of(a, b)
    assert not f.insert(*keys(rng, 10_000))
    assert f.contains(a, b).all()


def test_few_keys():
    none = np.empty(0, np.int64)
    f = CuckooFilter.of(none, none)
    assert f.contains(none, none).size == 0 and f.delete(none, none) == 0
    one = np.array([5])
    assert f.insert(one, one) and f.contains(one, one).all()
