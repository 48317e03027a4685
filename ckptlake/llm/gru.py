"""A gated recurrent language model in numpy, with a class-factored output.

The words of a bounded vocabulary (the most frequent ones) are dealt to classes
by rank. The probability of a word is that of its class given the state, times
that of the word given class and state. All other words are in one tail class,
inside which a word's share is its smoothed count; that factor is left to the
caller, who knows all counts. Training is truncated backpropagation through time
over windows of a few dozen steps; documents are laid end to end in lanes, and
each lane's state is carried from window to window and cleared where a document
begins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CLASS = 32  # words a class
STEPS = 32  # steps a window


def layout(lengths: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Lane and first step of each document, longest first into the shortest lane; the number of steps."""
    import heapq

    heap = [(0, k) for k in range(lanes)]
    lane, start = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for d in np.argsort(-lengths, kind="stable"):
        used, k = heapq.heappop(heap)
        lane[d], start[d] = k, used
        heapq.heappush(heap, (used + int(lengths[d]), k))
    return lane, start, max((u for u, _ in heap), default=0)


class Lanes:
    """Tokens of documents as (steps, lanes) arrays: what goes in, what is to be foretold, where a document begins, and whose a step is."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, start_token: int, lanes: int):
        lane, start, steps = layout(lengths, lanes)
        steps = -(-steps // STEPS) * STEPS
        self.doc = np.full((steps, lanes), -1, np.int32)
        self.target = np.zeros((steps, lanes), np.int32)
        self.source = np.full((steps, lanes), start_token, np.int32)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        owner = np.repeat(np.arange(len(lengths)), lengths)
        row = np.arange(len(tokens)) - offsets[owner] + start[owner]
        self.doc[row, lane[owner]] = owner
        self.target[row, lane[owner]] = tokens
        inner = np.arange(len(tokens)) > offsets[owner]
        self.source[row[inner], lane[owner[inner]]] = tokens[np.flatnonzero(inner) - 1]
        self.keep = np.ones((steps, lanes), np.float32)
        self.keep[start, lane] = 0
        self.steps, self.lanes = steps, lanes


@dataclass
class Model:
    """size words with ranks 0..size-1 (a multiple of CLASS), then the tail, then the start of a document."""

    p: dict[str, np.ndarray]
    size: int

    @classmethod
    def new(cls, counts: np.ndarray, tail: float, hidden: int = 16, seed: int = 5) -> Model:
        """counts: of the ranked words, filled up with zeros; at first the model is the unigram of classes and words."""
        rng, size = np.random.default_rng(seed), len(counts)
        groups = (counts + 0.5).reshape(-1, CLASS)
        classes = np.concatenate([groups.sum(1), [tail + 0.5]])
        recurrent = np.concatenate([np.linalg.qr(rng.normal(size=(hidden, hidden)))[0] for _ in range(3)], axis=1) * 0.7
        p = {
            "x": rng.normal(scale=0.3, size=(size + 2, 3 * hidden)),
            "u": recurrent,
            "c": np.zeros((hidden, size // CLASS + 1)),
            "cb": np.log(classes / classes.sum()),
            "w": np.zeros((size // CLASS, hidden, CLASS)),
            "wb": np.log(groups / groups.sum(1, keepdims=True)),
        }
        p["x"][:, :hidden] += 0.5
        return cls({k: v.astype(np.float32) for k, v in p.items()}, size)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def with_flat(self, flat: np.ndarray) -> Model:
        out, at = {}, 0
        for k in sorted(self.p):
            n = self.p[k].size
            out[k] = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return Model(out, self.size)

    def run(self, source: np.ndarray, keep: np.ndarray, h: np.ndarray, tape: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after each step of a window, and the last; tape: gets what the way back needs."""
        n = self.p["u"].shape[0]
        x = self.p["x"][source]
        out = np.empty((len(source), source.shape[1], n), np.float32)
        for t in range(len(source)):
            h = h * keep[t][:, None]
            a = h @ self.p["u"]
            g = x[t, :, : 2 * n] + a[:, : 2 * n]
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            z, r = g[:, :n], g[:, n:]
            m = np.tanh(x[t, :, 2 * n :] + r * a[:, 2 * n :])
            if tape is not None:
                tape.append((h, z, r, m, a[:, 2 * n :]))
            h = m + z * (h - m)
            out[t] = h
        return out, h

    def emit(self, states: np.ndarray, target: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each target (of the tail: of its class); with grad, its gradients, and those of the states, of the summed loss."""
        s = states.reshape(-1, states.shape[-1])
        group = np.where(target < self.size, target // CLASS, self.size // CLASS)
        logits = s @ self.p["c"] + self.p["cb"]
        logits -= logits.max(1, keepdims=True)
        e = np.exp(logits)
        total = e.sum(1)
        rows = np.arange(len(s))
        out = logits[rows, group] - np.log(total)
        back = None
        if grad is not None:
            d = e / total[:, None]
            d[rows, group] -= 1
            grad["c"], grad["cb"] = s.T @ d, d.sum(0)
            back = d @ self.p["c"].T
            grad["w"], grad["wb"] = np.zeros_like(self.p["w"]), np.zeros_like(self.p["wb"])
        order = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[order], np.arange(self.size // CLASS + 1))
        for k in range(self.size // CLASS):
            own = order[bounds[k] : bounds[k + 1]]
            if not len(own):
                continue
            logits = s[own] @ self.p["w"][k] + self.p["wb"][k]
            logits -= logits.max(1, keepdims=True)
            e = np.exp(logits)
            total = e.sum(1)
            at = target[own] - k * CLASS
            out[own] += logits[np.arange(len(own)), at] - np.log(total)
            if grad is not None:
                d = e / total[:, None]
                d[np.arange(len(own)), at] -= 1
                grad["w"][k], grad["wb"][k] = s[own].T @ d, d.sum(0)
                back[own] += d @ self.p["w"][k].T
        return out, back

    def gradient(self, source: np.ndarray, target: np.ndarray, keep: np.ndarray, real: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Mean gradients over a window's real steps, the state after it, and the mean loss."""
        tape: list = []
        states, after = self.run(source, keep, h, tape)
        n, grad = self.p["u"].shape[0], {}
        where = np.flatnonzero(real.ravel())
        logs, back = self.emit(states.reshape(-1, n)[where], target.ravel()[where], grad)
        d_states = np.zeros((states.shape[0] * states.shape[1], n), np.float32)
        d_states[where] = back
        d_states = d_states.reshape(states.shape)
        dx = np.empty((*source.shape, 3 * n), np.float32)
        du, dh = np.zeros_like(self.p["u"]), np.zeros_like(h)
        for t in range(len(source) - 1, -1, -1):
            h0, z, r, m, an = tape[t]
            dh = dh + d_states[t]
            dm = dh * (1 - z) * (1 - m * m)
            dz = dh * (h0 - m) * z * (1 - z)
            dr = dm * an * r * (1 - r)
            dx[t, :, :n], dx[t, :, n : 2 * n], dx[t, :, 2 * n :] = dz, dr, dm
            da = np.concatenate([dz, dr, dm * r], axis=1)
            du += h0.T @ da
            dh = (dh * z + da @ self.p["u"].T) * keep[t][:, None]
        flat, of = dx.reshape(-1, 3 * n), source.ravel()
        order = np.argsort(of, kind="stable")
        names, first = np.unique(of[order], return_index=True)
        grad["x"] = np.zeros_like(self.p["x"])
        grad["x"][names] = np.add.reduceat(flat[order], first)
        grad["u"] = du
        count = max(1, len(where))
        return {k: v / count for k, v in grad.items()}, after, float(-logs.sum() / count)


def train(model: Model, lanes: Lanes, stride: int = 1, rate: float = 0.01, phase: int = 0) -> tuple[Model, list[float]]:
    """Truncated backpropagation over lanes: the state goes through every window, weights change at every stride-th."""
    p = {k: v.copy() for k, v in model.p.items()}
    own = Model(p, model.size)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    h, losses, step = np.zeros((lanes.lanes, p["u"].shape[0]), np.float32), [], 0
    for k, at in enumerate(range(0, lanes.steps, STEPS)):
        cut = slice(at, at + STEPS)
        if (k + phase) % stride:
            h = own.run(lanes.source[cut], lanes.keep[cut], h)[1]
            continue
        grad, h, loss = own.gradient(lanes.source[cut], lanes.target[cut], lanes.keep[cut], lanes.doc[cut] >= 0, h)
        losses.append(loss)
        step += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        for name, g in grad.items():
            g = g * np.float32(scale)
            m[name] += 0.1 * (g - m[name])
            v2[name] += 0.01 * (g * g - v2[name])
            p[name] -= np.float32(rate / (1 - 0.9**step)) * m[name] / (np.sqrt(v2[name] / (1 - 0.99**step)) + np.float32(1e-6))
    return own, losses


def score(model: Model, lanes: Lanes, docs: int) -> np.ndarray:
    """Natural log probability of each document, with tail words as their class."""
    out, h = np.zeros(docs), np.zeros((lanes.lanes, model.p["u"].shape[0]), np.float32)
    for at in range(0, lanes.steps, 2 * STEPS):
        cut = slice(at, at + 2 * STEPS)
        states, h = model.run(lanes.source[cut], lanes.keep[cut], h)
        of = lanes.doc[cut].ravel()
        where = np.flatnonzero(of >= 0)
        logs, _ = model.emit(states.reshape(-1, states.shape[-1])[where], lanes.target[cut].ravel()[where])
        out += np.bincount(of[where], logs, docs)
    return out
