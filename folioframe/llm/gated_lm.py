"""A gated recurrent language model in numpy: reset-after GRU, class-factored softmax, truncated backpropagation.

Words are numbered by falling frequency and cut into CLASSES classes of SIZE; P(word | state) = P(class | state) times
P(word | class, state). Word 0 is the end of a text, word 1 stands for all words outside the vocabulary. A text starts from
a zero state with the end as its first input. State is carried from window to window, in training (gradients stop at a
window's start) and in scoring, where each text is scored whole.
"""

from __future__ import annotations

import itertools

import numpy as np

END, OTHER = 0, 1
CLASSES, SIZE, HIDDEN = 32, 64, 16
WORDS = CLASSES * SIZE
STREAMS, WINDOW = 32, 32
#: Learning from all texts: so many words in so many streams at once.
RUN, WIDE = 1 << 16, 128
#: A start is fitted to so many words at least, texts that are few again and again.
FIT = 1 << 18
F32 = np.float32


def fresh(used: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters for a vocabulary of which the first `used` words exist."""
    g, h = np.random.default_rng(seed), HIDDEN
    p = {"E": g.normal(0, 0.1, (WORDS, h)), "W": g.normal(0, h**-0.5, (h, 3 * h)), "b": np.zeros(3 * h), "U": g.normal(0, h**-0.5, (h, 3 * h)), "Wc": g.normal(0, 0.1, (h, CLASSES)), "bc": np.zeros(CLASSES), "Ww": g.normal(0, 0.1, (CLASSES, h, SIZE)), "bw": np.zeros((CLASSES, SIZE))}
    p["bw"].reshape(-1)[used:] = -1e9
    p["bc"][-(-used // SIZE) :] = -1e9
    return {k: v.astype(F32) for k, v in p.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(0.5) * np.tanh(F32(0.5) * x) + F32(0.5)


def softmax(x: np.ndarray, share: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities times share, and the logarithm of their sum before scaling; x is overwritten. Rows are lowered only where they need it."""
    top = x.max()
    if top > 60:
        lowered = x.max(-1, keepdims=True)
        x -= lowered
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)  # faster than a sum of short rows
    x *= (share / total)[:, None]
    return x, np.log(total) + (lowered[:, 0] if top > 60 else 0)


def log_sums(x: np.ndarray) -> np.ndarray:
    """log(sum(exp(x))) of each row; x is overwritten."""
    top = x.max()
    lowered = x.max(1, keepdims=True) if top > 60 else None
    if lowered is not None:
        x -= lowered
    np.exp(x, out=x)
    return np.log(x @ np.ones(x.shape[1], x.dtype)) + (0 if lowered is None else lowered[:, 0])


def step(gx: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    k = len(u)
    gh = h @ u
    zr = gx[:, : 2 * k] + gh[:, : 2 * k]
    zr *= F32(0.5)  # a sigmoid, in place
    np.tanh(zr, out=zr)
    zr *= F32(0.5)
    zr += F32(0.5)
    z, r, ghn = zr[:, :k], zr[:, k:], gh[:, 2 * k :]
    n = r * ghn
    n += gx[:, 2 * k :]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, z, r, n, ghn


def by_class(c: np.ndarray, classes: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The rows in order of their classes, and where the rows of each class that occurs lie in that order."""
    order = np.argsort(c.astype(np.int16), kind="stable")  # sixteen bits are sorted by digits
    edge = np.searchsorted(c[order], np.arange(classes + 1))
    return order, [(k, slice(edge[k], edge[k + 1])) for k in range(classes) if edge[k + 1] > edge[k]]


def window_gradients(p: dict, inputs: np.ndarray, targets: np.ndarray, h0: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """inputs, targets: [time, stream]. Mean negative log-likelihood, gradients, the state after the window."""
    (t_max, b), (classes, size), kind, k = inputs.shape, p["bw"].shape, p["U"].dtype, HIDDEN  # the model's own, in whatever process
    gx, alive = (p["E"] @ p["W"] + p["b"])[inputs], (inputs != END).astype(kind)[..., None]
    h, ended = h0, (inputs == END).any(1)
    before, hs, z, r, n, ghn = (np.empty((t_max, b, k), kind) for _ in range(6))
    for t in range(t_max):
        before[t] = h * alive[t] if ended[t] else h
        h, z[t], r[t], n[t], ghn[t] = step(gx[t], before[t], p["U"])
        hs[t] = h
    hs = hs.reshape(-1, k)
    y = targets.reshape(-1)
    c, w, at, share = y // size, y % size, np.arange(len(y)), 1 / len(y)
    lc = hs @ p["Wc"] + p["bc"]
    loss = -float(lc[at, c].sum())
    dc, sums = softmax(lc, share)
    loss += float(sums.sum())
    dc[at, c] -= share
    g = {name: np.zeros_like(v) for name, v in p.items()}
    ones = np.ones(len(y), dc.dtype)  # products are faster than sums
    g["Wc"], g["bc"], dhs = hs.T @ dc, ones @ dc, dc @ p["Wc"].T
    order, parts = by_class(c, classes)
    states, place, back = hs[order], w[order], np.empty_like(dhs)
    for i, own in parts:
        mine, spot = states[own], (at[: own.stop - own.start], place[own])
        lw = mine @ p["Ww"][i] + p["bw"][i]
        loss -= float(lw[spot].sum())
        dw, sums = softmax(lw, share)
        loss += float(sums.sum())
        dw[spot] -= share
        g["Ww"][i], g["bw"][i] = mine.T @ dw, ones[: len(dw)] @ dw
        back[own] = dw @ p["Ww"][i].T
    dhs[order] += back
    dhs = dhs.reshape(t_max, b, k)
    # for all steps at once, what a state's gradient is multiplied by
    q = 1 - z
    to_n = q * (1 - n * n)
    to_z, to_r = (before - n) * z * q, to_n * ghn * r * (1 - r)
    dh, dgx, dgh, turned = np.zeros((b, k), kind), np.empty_like(gx), np.empty_like(gx), np.ascontiguousarray(p["U"].T)
    for t in range(t_max - 1, -1, -1):
        dh += dhs[t]
        own = dgx[t]
        np.multiply(dh, to_z[t], out=own[:, :k])
        np.multiply(dh, to_r[t], out=own[:, k : 2 * k])
        np.multiply(dh, to_n[t], out=own[:, 2 * k :])
        dgh[t] = own
        dgh[t, :, 2 * k :] *= r[t]
        dh *= z[t]
        dh += dgh[t] @ turned
        if ended[t]:
            dh *= alive[t]
    g["U"] = before.reshape(-1, k).T @ dgh.reshape(-1, 3 * k)
    # what reaches the inputs, summed for each word
    x = inputs.reshape(-1)
    order = np.argsort(x.astype(np.int16), kind="stable")
    first = np.flatnonzero(np.diff(x[order], prepend=-1))
    dgx = dgx.reshape(-1, 3 * k)
    g["W"], g["b"] = p["E"][x].T @ dgx, ones @ dgx
    g["E"][x[order][first]] = np.add.reduceat((dgx @ p["W"].T)[order], first, axis=0)
    return loss / len(y), g, h


class Adam:
    def __init__(self, p: dict):
        self.n, self.m, self.v = 0, {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}

    def move(self, p: dict, g: dict, rate: float) -> None:
        """One step, with the gradient cut to length 1."""
        self.n += 1
        norm = float(np.sqrt(sum((d * d).sum() for d in g.values())))
        scale = F32(min(1.0, 1.0 / (norm + 1e-9)))
        for k in p:
            d = g[k] * scale
            self.m[k] += F32(0.1) * (d - self.m[k])
            self.v[k] += F32(0.01) * (d * d - self.v[k])
            p[k] -= F32(rate / (1 - 0.9**self.n)) * self.m[k] / (np.sqrt(self.v[k] / F32(1 - 0.99**self.n)) + F32(1e-6))


def one_pass(p: dict, whole: np.ndarray, streams: int, window: int, rates, adam: Adam) -> int:
    """Truncated backpropagation over a run of words, cut into streams side by side; gives the words learned from."""
    steps = len(whole) // streams
    if steps < 2:
        return 0
    y = whole[: steps * streams].reshape(streams, steps).T
    x = np.concatenate([np.full((1, streams), END), y[:-1]])
    h = np.zeros((streams, HIDDEN), F32)
    for a in range(0, steps, window):
        _, g, h = window_gradients(p, x[a : a + window], y[a : a + window], h)
        adam.move(p, g, next(rates))
    return steps * streams


def train(texts: list[np.ndarray], used: int, epochs: int = 3, rate: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit to texts, each an array of word numbers that ends with END. The same texts give the same model."""
    p, order = fresh(used, seed), np.random.default_rng(seed)
    epochs = max(epochs, min(50, FIT // max(1, sum(map(len, texts)))))
    windows = -(-(sum(map(len, texts)) // STREAMS) // WINDOW) * epochs
    rates, adam = (rate * max(0.05, 1 - n / (windows + 1)) for n in range(1, windows + 2)), Adam(p)
    for _ in range(epochs):
        one_pass(p, np.concatenate([texts[i] for i in order.permutation(len(texts))]) if texts else np.zeros(0, np.int64), STREAMS, WINDOW, rates, adam)
    return p


class Learner:
    """Goes on from a model, with texts as they come, in runs of RUN words; what is left over waits for the next run."""

    def __init__(self, start: dict, rate: float = 0.01):
        self.p, self.waiting, self.size, self.words = {k: v.copy() for k, v in start.items()}, [], 0, 0
        self.adam, self.rates = Adam(self.p), (rate * min(1.0, n / 20) for n in itertools.count(1))

    def learn(self, words: np.ndarray, last: bool = False) -> None:
        self.waiting.append(words)
        self.size += len(words)
        if self.size < RUN and not last:
            return
        whole = np.concatenate(self.waiting)
        end = len(whole) if last else len(whole) // RUN * RUN
        for a in range(0, end, RUN):
            part = whole[a : min(a + RUN, end)]
            # a short last run has fewer streams, so that none is shorter than a window; where it is all, it is gone over again
            learned = one_pass(self.p, part, max(1, min(WIDE, len(part) // WINDOW)), WINDOW, self.rates, self.adam)
            for _ in range(min(20, RUN // max(1, len(part))) - 1 if not self.words else 0):
                one_pass(self.p, part, max(1, min(STREAMS, len(part) // WINDOW)), WINDOW, self.rates, self.adam)
            self.words += learned
        self.waiting, self.size = [whole[end:]], len(whole) - end


def packed(p: dict) -> bytes:
    return b"".join(p[k].astype("<f4").tobytes() for k in sorted(p))


def unpacked(data: bytes, like: dict) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(data, "<f4"), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def scores(p: dict, words: np.ndarray, counts: np.ndarray, window: int = 32) -> np.ndarray:
    """Natural log-likelihood of each text. words: the numbers of all texts' words in order, each text with its END; counts: how many each has.

    State goes on from step to step; the softmax is taken over some `window` thousand states at once, however few texts a
    step still has.
    """
    order = np.argsort(-counts, kind="stable")  # so that the texts that go on are always the first ones
    begin, size = (np.cumsum(counts) - counts)[order], counts[order]
    out, steps = np.zeros(len(counts)), int(size[0]) if len(size) else 0
    lives = np.searchsorted(-size, -np.arange(steps), "left")  # at each step, how many sizes are above it
    table = p["E"] @ p["W"] + p["b"]
    h, own, before = np.zeros((len(counts), HIDDEN), F32), np.arange(len(counts)), np.full(len(counts), END)
    state, target, text, held = [], [], [], 0
    for t in range(steps):
        live = lives[t]
        h = step(table[before[:live]], h[:live], p["U"])[0]
        before = words[begin[:live] + t]
        state.append(h)
        target.append(before)
        text.append(own[:live])
        held += live
        if held >= window << 10 or t + 1 == steps:
            text = np.concatenate(text)
            out += np.bincount(text, log_likelihoods(p, np.concatenate(state), np.concatenate(target)), len(counts))
            state, target, text, held = [], [], [], 0
    result = np.zeros(len(counts))
    result[order] = out
    return result


def log_likelihoods(p: dict, state: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each state's next word."""
    classes, width = p["bw"].shape
    kind = target // width
    turn, parts = by_class(kind, classes)
    # in order of the classes, so that each is one run of rows
    state, kind, place, rows = state[turn], kind[turn], (target % width)[turn], np.arange(len(turn))
    lc = state @ p["Wc"] + p["bc"]
    found = lc[rows, kind] - log_sums(lc)
    for k, run in parts:
        lw = state[run] @ p["Ww"][k] + p["bw"][k]
        found[run] += lw[rows[: run.stop - run.start], place[run]] - log_sums(lw)
    out = np.empty_like(found)
    out[turn] = found
    return out
