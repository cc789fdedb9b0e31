"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, carried state.

Targets are numbers: a frequent word is (class, place in class), any other word
is a rare class alone.  Arrays are (time, stream, ...).
"""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def product(x, w, offset):
    out = x @ w
    out += offset
    return out


def exps(x):
    """exp(x) and its sums over the last axis; x is a logarithm plus a small term, so only runaway values need a bound."""
    e = np.exp(np.minimum(x, 60, out=x), out=x)
    return e, e @ np.ones(e.shape[-1], e.dtype)


def chosen_log(x, target):
    """Log probability of each row's target under the softmax of the row; ``x`` is used up."""
    own = x[np.arange(len(x)), target].copy()
    return np.minimum(own, 60) - np.log(exps(x)[1])


def softmax_loss(x, target):
    """Sum of the targets' negative log probabilities, and its derivative by ``x``, which takes the place of ``x``."""
    rows = np.arange(len(x))
    own = x[rows, target].copy()
    e, total = exps(x)
    e /= total[:, None]
    e[rows, target] -= 1
    return (np.log(total) - np.minimum(own, 60)).sum(dtype=np.float64), e


def start(rng: np.random.Generator, inputs: int, hidden: int, class_log: np.ndarray, word_log: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters whose first predictions are the given unigram logarithms: ``class_log`` (classes), ``word_log`` (frequent classes, places)."""
    small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    return {"x": small(inputs, 3 * hidden), "u": small(hidden, 3 * hidden), "c": small(hidden, len(class_log)) * 0.1, "cb": class_log.astype(np.float32),
            "w": small(word_log.shape[0], hidden, word_log.shape[1]) * 0.1, "wb": word_log.astype(np.float32)}


def step(p, xw, h):
    """One step for inputs already multiplied: gates z, r, candidate n, next state."""
    k = h.shape[1]
    hu = h @ p["u"]
    zr = sigmoid(xw[:, :2 * k] + hu[:, :2 * k])
    z, r = zr[:, :k], zr[:, k:]
    n = np.tanh(xw[:, 2 * k:] + r * hu[:, 2 * k:])
    return z, r, n, hu, (1 - z) * n + z * h


def log_probability(p, h, cls, place):
    """Natural log probability of each target given its state; places of rare classes are not read."""
    out = chosen_log(product(h, p["c"], p["cb"]), cls).astype(np.float64)
    order = np.argsort(cls.astype(np.int16), kind="stable")
    ends = np.searchsorted(cls[order], np.arange(len(p["w"]) + 1))
    for k in np.flatnonzero(np.diff(ends)):
        at = order[ends[k]:ends[k + 1]]
        out[at] += chosen_log(product(h[at], p["w"][k], p["wb"][k]), place[at])
    return out


def gradients(p, x, cls, place, mask, h0, fresh=None):
    """Loss (nats, summed over masked targets), gradients within the window, and the state after it.

    ``fresh`` marks the tokens before which the state is cleared.
    """
    steps, after, h, width = [], [], h0, h0.shape[1]
    whole = mask.all()
    xw = p["x"][x]
    for t in range(len(x)):
        if fresh is not None and fresh[t].any():
            h = np.where(fresh[t][:, None], 0, h).astype(h.dtype)
        z, r, n, hu, new = step(p, xw[t], h)
        steps.append((h, z, r, n, hu))
        h = new if whole else np.where(mask[t][:, None], new, h)
        after.append(h)
    flat = np.concatenate(after)
    on = slice(None) if whole else np.flatnonzero(mask.ravel())
    s, c, w = flat[on], cls.ravel()[on], place.ravel()[on]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    # targets by class, so that every class is a slice
    order = np.argsort(c.astype(np.int16), kind="stable")
    s, c, w = s[order], c[order], w[order]
    ends = np.searchsorted(c, np.arange(len(p["w"]) + 1))
    loss, dc = softmax_loss(product(s, p["c"], p["cb"]), c)
    g["c"], g["cb"] = s.T @ dc, np.ones(len(dc), dc.dtype) @ dc
    ds = dc @ p["c"].T
    for k in np.flatnonzero(np.diff(ends)):
        part = slice(ends[k], ends[k + 1])
        more, dw = softmax_loss(product(s[part], p["w"][k], p["wb"][k]), w[part])
        loss += more
        g["w"][k], g["wb"][k] = s[part].T @ dw, np.ones(len(dw), dw.dtype) @ dw
        ds[part] += dw @ p["w"][k].T
    dh_out = np.zeros_like(flat)
    dh_out[order if whole else on[order]] = ds
    dh_out = dh_out.reshape(len(x), -1, width)
    dxw, dhu = np.empty_like(xw), np.empty_like(xw)
    dh = np.zeros_like(h0)
    for t in range(len(x) - 1, -1, -1):
        before, z, r, n, hu = steps[t]
        total = dh + dh_out[t]
        d = total if whole else np.where(mask[t][:, None], total, 0)
        dn = d * (1 - z) * (1 - n * n)
        dxw[t, :, :width] = dhu[t, :, :width] = d * (before - n) * z * (1 - z)
        dxw[t, :, width:2 * width] = dhu[t, :, width:2 * width] = dn * hu[:, 2 * width:] * r * (1 - r)
        dxw[t, :, 2 * width:] = dn
        np.multiply(dn, r, out=dhu[t, :, 2 * width:])
        dh = d * z + dhu[t] @ p["u"].T
        if not whole:
            dh = dh + np.where(mask[t][:, None], 0, total)
        if fresh is not None and fresh[t].any():
            dh = np.where(fresh[t][:, None], 0, dh).astype(dh.dtype)
    g["u"] = np.concatenate([q[0] for q in steps]).T @ dhu.reshape(-1, 3 * width)
    # inputs of one number lie together, and each group is one sum
    inputs = x.ravel()
    order = np.argsort(inputs.astype(np.int16), kind="stable")
    first = np.flatnonzero(np.diff(inputs[order], prepend=-1))
    g["x"][inputs[order[first]]] = np.add.reduceat(dxw.reshape(-1, 3 * width)[order], first, axis=0)
    return loss, g, h


class Adam:
    def __init__(self, p, rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def update(self, p, g, count: int):
        self.t += 1
        for k in p:
            grad = g[k] / max(count, 1)
            self.m[k] = 0.9 * self.m[k] + 0.1 * grad
            self.v[k] = 0.99 * self.v[k] + 0.01 * grad * grad
            p[k] -= self.rate * (self.m[k] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[k] / (1 - 0.99 ** self.t)) + 1e-6)


def train_epoch(p, texts, rate: float, window: int = 16, streams: int = 512):
    """One pass over ``texts`` of (inputs, classes, places), one behind the other in ``streams`` equal lanes; every text starts with a fresh state."""
    p = {k: v.copy() for k, v in p.items()}
    x, cls, place = (np.concatenate([t[k] for t in texts] or [np.empty(0, np.int64)]) for k in range(3))
    fresh = np.zeros(len(x), bool)
    fresh[np.cumsum([0, *map(len, (t[0] for t in texts))])[:-1]] = True
    streams = max(1, min(streams, len(x) // (64 * window)))  # a short pass keeps enough steps
    height = -(-len(x) // streams)
    lanes = lambda v: np.append(v, np.zeros(height * streams - len(v), v.dtype)).reshape(streams, height).T
    mask, (x, cls, place, fresh) = lanes(np.ones(len(x), bool)), map(lanes, (x, cls, place, fresh))
    adam, h = Adam(p, rate), np.zeros((streams, p["u"].shape[0]), np.float32)
    for at in range(0, height, window):
        part = slice(at, at + window)
        _, g, h = gradients(p, x[part], cls[part], place[part], mask[part], h, fresh[part])
        adam.update(p, g, int(mask[part].sum()))
    return p


def score_texts(p, texts, window: int = 32, rows: int = 1 << 15) -> np.ndarray:
    """Natural log probability of each whole text; texts go side by side, longest first, and keep their states across windows."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i][0]))
    lengths = np.array([len(texts[i][0]) for i in order])
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    x, cls, place = (np.concatenate([texts[i][k] for i in order]) for k in range(3))
    out, h = np.zeros(len(texts)), np.zeros((len(texts), p["u"].shape[0]), np.float32)
    live = np.searchsorted(-lengths, -np.arange(lengths[0] + 1), side="left")  # texts longer than t are the first live[t]
    states, targets, owners, held = [], [], [], 0

    def settle():
        at = np.concatenate(targets)
        np.add.at(out, np.concatenate(owners), log_probability(p, np.concatenate(states), cls[at], place[at]))
        states.clear(), targets.clear(), owners.clear()

    for t in range(int(lengths[0])):
        n = int(live[t])
        at = first[:n] + t
        h[:n] = step(p, p["x"][x[at]], h[:n])[4]
        states.append(h[:n].copy())
        targets.append(at)
        owners.append(np.arange(n))
        held += n
        if held >= rows:
            settle()
            held = 0
    if held:
        settle()
    back = np.empty(len(texts))
    back[order] = out
    return back
