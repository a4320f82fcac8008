"""A small character tagger in numpy: bidirectional LSTM emissions, CRF transitions, Viterbi decoding.

Sequences run in lockstep, one column each, so a time step is a few array operations over all sequences.
"""

from __future__ import annotations

import numpy as np

HIDDEN, EMBED = 8, 8
#: Symbols: a-z, then these kinds of character.
OTHER, SPACE, LINE, UPPER, DIGIT, LETTER = range(26, 32)
SIGNS = "@.-+()_%:/,#"
SYMBOLS = 32 + len(SIGNS)

_CODES = np.full(0x180, OTHER, np.uint8)
_CODES[0xC0:] = LETTER
for _i in range(26):
    _CODES[97 + _i], _CODES[65 + _i] = _i, UPPER
for _c in b"0123456789":
    _CODES[_c] = DIGIT
_CODES[ord(" ")] = SPACE
_CODES[ord("\n")] = LINE
for _i, _c in enumerate(SIGNS):
    _CODES[ord(_c)] = 32 + _i


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _CODES[np.minimum(points, len(_CODES) - 1)]


def initial(tags: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(0, 0.5, (EMBED, SYMBOLS)), "out": rng.normal(0, 0.3, (tags, 2 * HIDDEN)), "out_bias": np.zeros((tags, 1)),
         "step": np.zeros((tags, tags)), "first": np.zeros(tags)}
    for way in "fb":
        p[f"in_{way}"] = rng.normal(0, 0.4, (4 * HIDDEN, EMBED))
        p[f"rec_{way}"] = rng.normal(0, 0.3, (4 * HIDDEN, HIDDEN))
        bias = np.zeros((4 * HIDDEN, 1))
        bias[HIDDEN:2 * HIDDEN] = 1.0  # remember at first
        p[f"bias_{way}"] = bias
    return {k: v.astype(np.float32) for k, v in p.items()}


def _run(p: dict, way: str, x: np.ndarray, kept: list | None = None, onto: np.ndarray | None = None) -> np.ndarray | None:
    """One direction over (time, sequences); gates in the order in, forget, out, new.

    Gates are piecewise linear, clip(0.2 z + 0.5, 0, 1). Returns the hidden states (time, hidden, sequences) and keeps what
    the slopes need in ``kept``; or, with ``onto``, adds their emissions there and keeps nothing.
    """
    scale = np.repeat(np.array([0.2, 0.2, 0.2, 1.0], np.float32), HIDDEN)[:, None]
    shift = np.repeat(np.array([0.5, 0.5, 0.5, 0.0], np.float32), HIDDEN)[:, None]
    table = scale * (p[f"in_{way}"] @ p["embed"] + p[f"bias_{way}"]) + shift
    rec = scale * p[f"rec_{way}"]
    out = np.ascontiguousarray(p["out"][:, :HIDDEN] if way == "f" else p["out"][:, HIDDEN:])
    steps, n = x.shape
    h = c = np.zeros((HIDDEN, n), table.dtype)
    states = np.empty((steps, HIDDEN, n), table.dtype) if onto is None else None
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        z = rec @ h
        z += np.take(table, x[t], axis=1)
        np.clip(z[:3 * HIDDEN], 0, 1, out=z[:3 * HIDDEN])
        i, f, o, g = (z[k * HIDDEN:(k + 1) * HIDDEN] for k in range(4))
        np.tanh(g, out=g)
        old, before = c, h
        c = f * c
        c += i * g
        h = np.tanh(c)
        h *= o
        if onto is None:
            states[t] = h
        else:
            onto[t] += out @ h
        if kept is not None:
            kept.append((t, z, old, before, c))
    return states


def emissions(p: dict, x: np.ndarray) -> np.ndarray:
    """(time, tags, sequences)"""
    scores = np.empty((len(x), len(p["out"]), x.shape[1]), np.float32)
    scores[:] = p["out_bias"]
    for way in "fb":
        _run(p, way, x, onto=scores)
    return scores


def decode(p: dict, x: np.ndarray) -> np.ndarray:
    """The best tag sequence of every column.

    Leaving tag 0 for k positions takes part in at most k + 1 other transitions, none of which gains more than ``most`` over
    staying. A column in which tag 0 leads by more than twice that everywhere is tag 0 throughout; the others are decoded.
    """
    scores = emissions(p, x)
    step, first = p["step"], p["first"]
    most = max(0.0, float(step.max() - step[0, 0]), float(first.max() - first[0]))
    unsure = np.flatnonzero((scores[:, 0] - scores[:, 1:].max(axis=1)).min(axis=0) <= 2 * most + 1e-3)
    tags = np.zeros(x.shape, np.uint8)
    if not len(unsure):
        return tags
    scores = np.ascontiguousarray(scores[:, :, unsure])
    scores[0] += first[:, None]
    for t in range(1, len(x)):
        scores[t] += (scores[t - 1][:, None, :] + step[:, :, None]).max(axis=0)
    best = scores[-1].argmax(axis=0)
    tags[-1, unsure] = best
    for t in range(len(x) - 1, 0, -1):
        best = (scores[t - 1] + step[:, best]).argmax(axis=0)
        tags[t - 1, unsure] = best
    return tags


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_slopes(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood of the tags and its slopes, by forward-backward and back-propagation through time."""
    steps, n = x.shape
    kept: dict[str, list] = {"f": [], "b": []}
    states = {way: _run(p, way, x, kept[way]) for way in "fb"}
    both = np.concatenate([states["f"], states["b"]], axis=1)
    e = np.matmul(p["out"], both) + p["out_bias"]
    step, cols = p["step"], np.arange(n)
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + p["first"][:, None]
    for t in range(1, steps):
        alpha[t] = e[t] + _log_sum(alpha[t - 1][:, None] + step[:, :, None], 0)
    for t in range(steps - 2, -1, -1):
        beta[t] = _log_sum(step[:, :, None] + (e[t + 1] + beta[t + 1])[None], 1)
    total = _log_sum(alpha[-1], 0)
    right = p["first"][y[0]] + e[np.arange(steps)[:, None], y, cols].sum(0) + step[y[:-1], y[1:]].sum(0)
    d_e = np.exp(alpha + beta - total)
    d_e[np.arange(steps)[:, None], y, cols] -= 1
    d_e /= n
    d = {k: np.zeros_like(v) for k, v in p.items()}
    d["first"] = d_e[0].sum(1)
    for t in range(1, steps):
        d["step"] += np.exp(alpha[t - 1][:, None] + step[:, :, None] + (e[t] + beta[t])[None] - total).sum(2) / n
    np.subtract.at(d["step"], (y[:-1].ravel(), y[1:].ravel()), 1 / n)
    d["out"] = np.einsum("tkn,thn->kh", d_e, both)
    d["out_bias"] = d_e.sum((0, 2))[:, None]
    d_both = np.matmul(p["out"].T, d_e)
    for k, way in enumerate("fb"):
        dh_next = dc_next = np.zeros((HIDDEN, n), np.float32)
        for t, z, c_old, h_old, c in reversed(kept[way]):
            i, f, o, g = (z[j * HIDDEN:(j + 1) * HIDDEN] for j in range(4))
            sloped = 0.2 * ((z[:3 * HIDDEN] > 0) & (z[:3 * HIDDEN] < 1))
            dh = d_both[t, k * HIDDEN:(k + 1) * HIDDEN] + dh_next
            tc = np.tanh(c)
            dc = dc_next + dh * o * (1 - tc * tc)
            dz = np.concatenate([np.concatenate([dc * g, dc * c_old, dh * tc]) * sloped, dc * i * (1 - g * g)])
            d[f"rec_{way}"] += dz @ h_old.T
            by_symbol = np.zeros((SYMBOLS, 4 * HIDDEN), np.float32)
            np.add.at(by_symbol, x[t], dz.T)
            d[f"in_{way}"] += by_symbol.T @ p["embed"].T
            d["embed"] += p[f"in_{way}"].T @ by_symbol.T
            d[f"bias_{way}"] += dz.sum(1, keepdims=True)
            dh_next, dc_next = p[f"rec_{way}"].T @ dz, dc * f
    return float((total - right).mean()), d


def fit(x: np.ndarray, y: np.ndarray, tags: int, steps: int = 250, batch: int = 128, rate: float = 0.02, seed: int = 7) -> dict:
    """Parameters after ``steps`` Adam steps over random columns of x and y (time, sequences)."""
    p, rng = initial(tags, seed), np.random.default_rng(seed)
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for k in range(1, steps + 1):
        at = rng.integers(0, x.shape[1], batch)
        _, slopes = loss_and_slopes(p, x[:, at], y[:, at])
        size = np.sqrt(sum(float((s * s).sum()) for s in slopes.values()))
        now = rate * min(1.0, 2 * (steps - k + 1) / steps)
        for name, s in slopes.items():
            s = s * min(1.0, 5.0 / (size + 1e-9))
            mean[name] = 0.9 * mean[name] + 0.1 * s
            square[name] = 0.99 * square[name] + 0.01 * s * s
            p[name] = (p[name] - now * (mean[name] / (1 - 0.9 ** k)) / (np.sqrt(square[name] / (1 - 0.99 ** k)) + 1e-8)).astype(np.float32)
    return p
