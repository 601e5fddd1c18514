import numpy as np

from quillstone.llm.fm_index import FmIndex, WaveletMatrix


def test_counts():
    rng = np.random.default_rng(1)
    for symbols in (1, 2, 5, 300):
        seq = rng.integers(0, symbols, 1000)
        w = WaveletMatrix(seq, symbols)
        s, i = rng.integers(0, symbols, 500), rng.integers(0, 1001, 500)
        assert (w.count(s, i) == [(seq[:k] == x).sum() for x, k in zip(s, i, strict=True)]).all()


def longest(piece, i, held, depth):
    """How many of the words of ``piece`` from ``i`` on stand in a row in some held sequence, up to ``depth``."""
    there = lambda n: any(tuple(h[k : k + n]) == tuple(piece[i : i + n]) for h in held for k in range(len(h) - n + 1))
    return max(n for n in range(min(depth, len(piece) - i) + 1) if n == 0 or there(n))


def test_matching_statistics():
    index = FmIndex(np.array([0, 1, 2, 3, 0, 1]), np.array([0, 6]), 3)
    got = index.statistics(np.array([9, 0, 1, 2, 9, 1, 2, 3, 3, 3]), np.array([0, 10]))
    assert got.tolist() == [0, 3, 2, 1, 0, 3, 2, 1, 1, 1]
    rng = np.random.default_rng(3)
    cut = lambda ps: np.concatenate(([0], np.cumsum([p.size for p in ps])))
    for symbols, depth in ((2, 5), (3, 4), (3, 20), (1, 4), (30, 2), (4, 1)):
        for _ in range(6):
            held = [rng.integers(0, symbols, rng.integers(1, 30)) for _ in range(5)]
            asked = [rng.integers(0, symbols + 1, rng.integers(1, 30)) for _ in range(4)] + [held[0], held[1][2:]]
            got = FmIndex(np.concatenate(held), cut(held), depth).statistics(np.concatenate(asked), cut(asked))
            assert got.tolist() == [longest(p, i, held, depth) for p in asked for i in range(p.size)]


def test_the_index_is_small():
    rng = np.random.default_rng(4)
    words, n = rng.integers(0, 1000, 50_000), 50_000
    index = FmIndex(words, np.array([0, n]), 20)
    held = sum(a.nbytes for a in [*index.bwt.words, *index.bwt.before, index.bwt.leaf, index.less, index.common, *index.cuts])
    assert held < 4 * 20 * n
