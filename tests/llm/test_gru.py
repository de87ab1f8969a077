import numpy as np
import pytest

from tallyweave.llm.gru import backward, forward, glorot


@pytest.mark.parametrize("anew", [False, True])
def test_gradients_equal_differences(anew):
    rng = np.random.default_rng(0)
    steps, h, b = 5, 4, 3
    gates = rng.normal(size=(steps, 3 * h, b)).astype(np.float32)
    weights, bias = glorot(rng, 3 * h, h), rng.normal(size=(h, 1)).astype(np.float32)
    start = rng.normal(size=(h, b)).astype(np.float32)
    pull = rng.normal(size=(steps, h, b)).astype(np.float32)
    alive = (rng.random((steps, b)) < 0.6).astype(np.float32) if anew else None
    loss = lambda: float((forward(gates, weights, bias, start, alive=alive)[1:] * pull).sum())
    states, kept = forward(gates, weights, bias, start, keep=True, alive=alive)
    d_gates, d_weights, d_bias = backward(pull, states, kept, weights, alive)
    for array, grad in ((gates, d_gates), (weights, d_weights), (bias, d_bias)):
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in array.shape)
            held, step = array[at], np.float32(1e-2)
            array[at] = held + step
            up = loss()
            array[at] = held - step
            down = loss()
            array[at] = held
            assert abs((up - down) / (2 * step) - grad[at]) < 5e-3


def test_state_goes_on():
    rng = np.random.default_rng(1)
    gates, weights = rng.normal(size=(8, 9, 2)).astype(np.float32), glorot(rng, 9, 3)
    bias, zero = np.zeros((3, 1), np.float32), np.zeros((3, 2), np.float32)
    whole = forward(gates, weights, bias, zero)
    half = forward(gates[:4], weights, bias, zero)
    assert np.allclose(forward(gates[4:], weights, bias, half[-1]), whole[4:], atol=1e-6)


def test_state_begins_anew():
    rng = np.random.default_rng(2)
    gates, weights = rng.normal(size=(6, 9, 2)).astype(np.float32), glorot(rng, 9, 3)
    bias, start = np.zeros((3, 1), np.float32), rng.normal(size=(3, 2)).astype(np.float32)
    alive = np.ones((6, 2), np.float32)
    alive[4, 1] = 0
    got = forward(gates, weights, bias, start, alive=alive)
    assert np.allclose(got[:, :, 0], forward(gates, weights, bias, start)[:, :, 0], atol=1e-6)
    assert np.allclose(got[5:, :, 1], forward(gates[4:], weights, bias, np.zeros((3, 2), np.float32))[1:, :, 1], atol=1e-6)
