import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterlake.functions.curves import hilbert_order
from rasterlake.functions.halves import from_half_bits, to_half_bits
from rasterlake.operators import entropy, rle, wavelets
from rasterlake.operators.quantise import Params, base_rates, rates

SYMBOLS = st.lists(st.integers(0, 400), min_size=1, max_size=400)


@given(SYMBOLS)
@settings(max_examples=150, deadline=None)
def test_arithmetic_coder_is_lossless(symbols):
    x = np.array(symbols)
    model = entropy.build_model(x)
    assert model[-1][2] in (entropy.MASS, entropy.MASS - 1)
    assert (entropy.arith_decode(entropy.arith_encode(x, model), model) == x).all()


def test_coder_is_close_to_entropy():
    rng = np.random.default_rng(3)
    x = np.minimum(rng.geometric(0.4, 20000), 30)
    model = entropy.build_model(x)
    shares = {s: p / entropy.MASS for s, p, _ in model}
    bits = -sum(np.log2(shares[s]) for s in x.tolist())
    assert 8 * (len(entropy.arith_encode(x, model)) - 4) <= bits + 32


def test_one_symbol_is_length_and_a_byte():
    model = entropy.build_model(np.full(9, 5))
    assert entropy.arith_encode(np.full(9, 5), model) == b"\t\0\0\0\x80"


@given(st.lists(st.sampled_from([0, 0, 0, 1, 2]), max_size=300), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_runs_are_lossless(symbols, min_block):
    literals, blocks = rle.encode(np.array(symbols, int), 0, min_block)
    assert rle.decode(literals, 0, blocks).tolist() == symbols
    assert not blocks or rle.encoded_length(blocks) == len(symbols)


def test_run_golden_values():
    x = np.array([1] * 5 + [0] * 5 + [2] * 3 + [0] * 2 + [3] * 3 + [0] * 6)
    literals, blocks = rle.encode(x, 0, 4)
    assert len(literals) == 13 and blocks == [5, 5 | rle.CONST_FLAG, 8, 6 | rle.CONST_FLAG]
    literals, blocks = rle.encode(x, 0, 32)
    assert len(literals) == 24 and blocks == [24]
    long = np.concatenate([np.ones(40000, int), np.zeros(70000, int)])
    literals, blocks = rle.encode(long, 0, 4)
    assert [b & rle.MAX_BLOCK for b in blocks] == [32767, 7233, 32767, 32767, 4466]
    assert (rle.decode(literals, 0, blocks) == long).all()
    assert rle.best_block_size(x, 0, (2, 4, 32)) in (2, 4)


def test_model_golden_values():
    assert [c for *_, c in entropy.build_model(np.array([0] * 5 + [1] * 3 + [2] * 2))] == [32767, 52427, 65534]
    assert [c for *_, c in entropy.build_model(np.array([0, 1, 2]))] == [21845, 43690, 65535]


@pytest.mark.parametrize("family,tolerance", [("haar", 1e-14), ("cdf53", 1e-14), ("cdf97", 1e-7)])
@pytest.mark.parametrize("n", [8, 64])
def test_wavelets_invert(family, tolerance, n):
    x = np.random.default_rng(n).normal(size=n)
    assert np.abs(wavelets.synthesis_matrix(family, n) @ (wavelets.analysis_matrix(family, n) @ x) - x).max() < tolerance


def test_d4_inverts_inside_only():
    x = np.random.default_rng(1).normal(size=16)
    error = np.abs(wavelets.synthesis_matrix("d4", 16) @ (wavelets.analysis_matrix("d4", 16) @ x) - x)
    assert error[3:-3].max() < 1e-12 and error.max() > 1e-3


def test_wavelet_golden_values():
    x = np.arange(1, 9.0)
    assert wavelets.analysis_matrix("haar", 8) @ x == pytest.approx([1.5, 3.5, 5.5, 7.5, -0.5, -0.5, -0.5, -0.5])
    assert wavelets.analysis_matrix("cdf53", 8) @ x == pytest.approx([1.5, 3, 5, 7, -0.25, 0, 0, 1])
    assert wavelets.analysis_matrix("cdf97", 8) @ x == pytest.approx([1.333641, 3.073267, 4.946502, 7.06341, 0.25, 0, -0.182544, 0.865087], abs=1e-6)
    assert [wavelets.n_primary_passes(s, "cdf97") for s in (8, 16, 64, 1024, 4096)] == [1, 2, 4, 8, 10]
    with pytest.raises(ValueError):
        wavelets.n_primary_passes(4, "cdf97")


@pytest.mark.parametrize("log_space", [True, False])
def test_normalised_transform_inverts(log_space):
    p = np.random.default_rng(2).normal(size=(3, 32, 32)) * 200
    q, norms = wavelets.normalised_forward(p, log_space=log_space)
    assert norms.min() >= 1
    assert np.abs(wavelets.normalised_inverse(q, norms, log_space=log_space) - p).max() < 1e-3


def test_hilbert_is_a_bijection_and_starts_as_known():
    for side in (1, 2, 8, 64):
        assert sorted(hilbert_order(side).tolist()) == list(range(side * side))
    order = hilbert_order(4).tolist()
    assert [divmod(order.index(t), 4)[::-1] for t in range(6)] == [(0, 0), (1, 0), (1, 1), (0, 1), (0, 2), (0, 3)]
    at = {t: divmod(i, 64) for i, t in enumerate(hilbert_order(64).tolist())}
    assert all(abs(at[t][0] - at[t + 1][0]) + abs(at[t][1] - at[t + 1][1]) == 1 for t in range(4095))


def test_rates():
    assert base_rates(0.3) == (12, 4)
    assert rates(16, Params()) == [192, 96, 48, 24, 12]
    assert rates(1024, Params())[0] == 12288 and rates(4096, Params())[0] == 32767


def test_halves():
    x = np.array([0.1, 70000, 1e6, np.inf, -0.0, 1e-6], np.float32)
    back = from_half_bits(to_half_bits(x, ieee=False), ieee=False)
    assert back == pytest.approx([0.09997559, 69952, 124992, 65536, -3.0517578e-05, 3.1977892e-05], rel=1e-6)
    assert from_half_bits(to_half_bits(np.array([0.5, -2, 1024])))[:].tolist() == [0.5, -2, 1024]
