"""Filter coefficients and block filtering with numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLOCK = 64


def _prototype(order):
    k = np.arange(1, order + 1)
    return np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))


def _bilinear(z, p, gain, fs):
    """Analogue zeros, poles and gain to digital ones; zeros at infinity land on -1."""
    c = 2.0 * fs
    extra = len(p) - len(z)
    gain = gain * np.real(np.prod(c - z) / np.prod(c - p))
    return np.append((c + z) / (c - z), -np.ones(extra)), (c + p) / (c - p), gain


def _sections(z, p, gain):
    """Second-order sections [b0 b1 b2 a1 a2] from conjugate pairs; real zeros are dealt out in equal shares."""
    poles = [q for q in p if q.imag > 1e-12]
    zeros = sorted(z.real)
    half = len(poles)
    out = []
    for i, q in enumerate(poles):
        a, b = zeros[i], zeros[-1 - i]
        out.append([1.0, -(a + b), a * b, -2 * q.real, abs(q) ** 2])
    out = np.array(out)
    out[:, :3] *= gain ** (1.0 / half)
    return out


@lru_cache(maxsize=32)
def bandpass(order, low, high, fs):
    """Butterworth band-pass as second-order sections."""
    w1, w2 = (2 * fs * np.tan(np.pi * f / fs) for f in (low, high))
    bw, w0 = w2 - w1, np.sqrt(w1 * w2)
    half = _prototype(order) * bw / 2
    root = np.sqrt(half * half - w0 * w0 + 0j)
    p = np.concatenate([half + root, half - root])
    return _sections(*_bilinear(np.zeros(order), p, bw ** order, fs))


@lru_cache(maxsize=32)
def highpass(order, cut, fs):
    w = 2 * fs * np.tan(np.pi * cut / fs)
    p = w / _prototype(order)
    return _sections(*_bilinear(np.zeros(order), p, 1.0, fs))


@lru_cache(maxsize=64)
def notch(freq, q, fs):
    w = 2 * np.pi * freq / fs
    g = 1.0 / (1.0 + np.tan(w / q / 2))
    return np.array([[g, -2 * g * np.cos(w), g, -2 * g * np.cos(w), 2 * g - 1]])


@lru_cache(maxsize=512)
def _block(b0, b1, b2, a1, a2, n):
    """Matrices of n steps of one section: outputs and exit state from entry state and inputs."""
    step, drive = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    power = [np.eye(2)]
    for _ in range(n):
        power.append(step @ power[-1])
    see = np.array([m[0] for m in power[:n]])
    pulse = np.array([b0] + [(m @ drive)[0] for m in power[:n - 1]])
    lag = np.arange(n)[:, None] - np.arange(n)[None, :]
    reply = np.where(lag >= 0, pulse[np.maximum(lag, 0)], 0.0)
    carry = np.array([power[n - 1 - j] @ drive for j in range(n)]).T
    return see, reply, power[n], carry


def apply(sos, x, state=None):
    """Filter rows of x (n x channels); returns (y, exit state [sections][2][channels])."""
    y = np.asarray(x, dtype=float)
    state = np.zeros((len(sos), 2, y.shape[1])) if state is None else np.array(state, dtype=float)
    for k, section in enumerate(sos):
        out, s = np.empty_like(y), state[k]
        for i in range(0, len(y), BLOCK):
            part = y[i:i + BLOCK]
            see, reply, jump, carry = _block(*map(float, section), len(part))
            out[i:i + BLOCK] = see @ s + reply @ part
            s = jump @ s + carry @ part
        state[k], y = s, out
    return y, state


def _settled(sos):
    """Section states that belong to a constant input of 1."""
    states, level = [], 1.0
    for b0, b1, b2, a1, a2 in sos:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        s1 = b2 * level - a2 * gain * level
        states.append([(b1 * level - a1 * gain * level) + s1, s1])
        level *= gain
    return np.array(states)


def zero_phase(sos, x):
    """Forward and backward pass with odd extension at both ends."""
    x = np.asarray(x, dtype=float)
    pad = min(3 * (2 * len(sos) + 1), len(x) - 1)
    left = 2 * x[0] - x[pad:0:-1]
    right = 2 * x[-1] - x[-2:-pad - 2:-1]
    ext = np.concatenate([left, x, right])
    rest = _settled(sos)[:, :, None]
    for _ in range(2):
        ext, _ = apply(sos, ext, rest * ext[0])
        ext = ext[::-1]
    return ext[pad:len(ext) - pad]


def training_chain(x, fs):
    """40 Hz high-pass of order 4, notches 50..450 Hz below Nyquist with Q 30; both zero-phase."""
    y = zero_phase(highpass(4, 40.0, float(fs)), x)
    top = min(450.0, fs / 2.0 - 1.0)
    for f in np.arange(50.0, top + 0.1, 50.0):
        y = zero_phase(notch(float(f), 30.0, float(fs)), y)
    return y


def resample_taps(up, down, beta=5.0):
    """Kaiser-windowed low-pass of an up/down resampler, centred, gain `up`."""
    top = max(up, down)
    half = 10 * top
    t = np.arange(-half, half + 1)
    h = np.sinc(t / top) / top * np.i0(beta * np.sqrt(np.maximum(0, 1 - (t / half) ** 2))) / np.i0(beta)
    return h / h.sum() * up, half
