"""op3: tokens read by Arrow, and chances as products of factors made once."""

import numpy as np
import pyarrow as pa
import pytest

from scorewise.llm import lm_score as M

TEXTS = [b"", b" ", b"  two\twords ", b"Upper \xc3\x84 \xc2\x85 \x1c bare\xff\xfe", b"a\x0bb\x0cc\rd\ne", b"*** x*** ...", b"z" * 70_000 + b" " + b"|" * 70_000, b"a a A"]


def test_tokens_and_classes_equal_those_of_plain_bytes():
    for texts in (pa.array(TEXTS, pa.binary()), pa.array([b"left out", *TEXTS], pa.large_binary()).slice(1)):
        words, n = M.tokens_of(texts)
        want = [[*t.lower().split(), M.END] for t in TEXTS]
        assert n.tolist() == [len(w) for w in want] and words.to_pylist() == sum(want, [])
        assert M.word_classes(words).tolist() == [M.word_class(w) for w in words.to_pylist()]
        assert M.word_classes(words.slice(3, 5)).tolist() == [M.word_class(w) for w in words.to_pylist()[3:8]]
    assert len(M.word_classes(pa.array([], pa.binary()))) == 0


@pytest.mark.parametrize("size", [1, 250, 10**9])
def test_portions_hold_every_row_in_order(size):
    batches = [pa.record_batch({"i": list(range(a, b)), "text": pa.array([b"t" * (i % 7) for i in range(a, b)], pa.binary())}) for a, b in ((0, 9), (9, 9), (9, 30))]
    got = list(M.portions(iter(batches), size))
    assert sum((b.column("i").to_pylist() for b in got), []) == list(range(30))
    assert len(got) == {1: 30, 250: 10, 10**9: 1}[size]
    assert not list(M.portions(iter([]), size))


def plain(m, before, target):
    s = sum(m.ctx[j][before[j]].astype(float) for j in range(M.ORDER)) @ m.vec.T.astype(float) + m.bias
    high = s.max(axis=1, keepdims=True)
    return (s - high)[np.arange(len(target)), target] - np.log(np.exp(s - high).sum(axis=1))


@pytest.mark.parametrize("scale", [1, 10, 300])
def test_chances_equal_plain_sums_also_when_the_distances_disagree(scale):
    rng = np.random.default_rng(2)
    m = M.Model(np.log(np.full(20, 0.05)))
    for p in (m.ctx, m.vec):
        p *= scale
    before, target = rng.integers(0, 21, (M.ORDER, 3000)), rng.integers(0, 20, 3000)
    assert np.allclose(m.log_chances(before, target), plain(m, before, target), rtol=1e-5, atol=1e-5)
    assert len(m.log_chances(before[:, :0], target[:0])) == 0


def test_exponentials_do_not_grow_with_the_tokens(monkeypatch):
    exp, seen = np.exp, []
    monkeypatch.setattr(M.np, "exp", lambda x, *a, **k: seen.append(np.size(x)) or exp(x, *a, **k))
    rng = np.random.default_rng(3)
    m = M.Model(np.log(np.full(20, 0.05)))
    m.log_chances(rng.integers(0, 21, (M.ORDER, 20_000)), rng.integers(0, 20, 20_000))
    assert sum(seen) == M.ORDER * 21 * 20
