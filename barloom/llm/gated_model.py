"""A gated recurrent language model with a class-factored output, in numpy, for code inside tasks.

Tokens: `heads` frequent words, in classes of SIZE words by rank, then TAILS tail classes, each one
input and one output for all other words that fall into it. A token's probability is that of its class
given the state times, for a word of a head class, that of the word in its class given the state. What
a word has within its tail class is not the model's business.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

HIDDEN, SIZE, TAILS, WINDOW = 16, 32, 16, 24


class GatedModel:
    def __init__(self, counts: np.ndarray, tails: np.ndarray, seed: int = 3):
        """counts of the head words by rank and of the tail classes: the model starts at these rates."""
        self.heads, self.head_classes = len(counts), -(-len(counts) // SIZE)
        rng, f = np.random.default_rng(seed), np.float32
        padded = np.pad(counts.astype(np.float64) + 1.0, (0, self.head_classes * SIZE - self.heads)).reshape(-1, SIZE)
        mass = np.concatenate([padded.sum(1), tails + 1.0])
        with np.errstate(divide="ignore"):
            words = np.where(padded > 0, np.log(padded), -1e9)
        self.p = {
            "E": (rng.standard_normal((self.heads + TAILS, 3 * HIDDEN)) * 0.1).astype(f),
            "U": (rng.standard_normal((HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(f),
            "W": np.zeros((HIDDEN, self.head_classes + TAILS), f),
            "b": np.log(mass / mass.sum()).astype(f),
            "V": np.zeros((self.head_classes, SIZE, HIDDEN), f),
            "c": words.astype(f),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Arrays of the parameters' shapes from numbers in a row."""
        out, at = {}, 0
        for k, v in self.p.items():
            out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return out

    def load(self, flat: np.ndarray) -> GatedModel:
        self.p = self.parts(flat)
        return self

    def fresh_memory(self) -> dict[str, np.ndarray]:
        """Adagrad's sums before the first update."""
        return {k: np.full(v.shape, 1e-2, np.float32) for k, v in self.p.items()}

    def forward(self, ids: np.ndarray, keep: np.ndarray, h: np.ndarray, saved: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States before each of the tokens (steps, lanes), and the last state. keep is 0 where a
        document begins. Gates are clipped lines, 0.5 + x / 4 between 0 and 1."""
        n2 = 2 * HIDDEN
        x, u = self.p["E"][ids], self.p["U"].copy()
        x[:, :, :n2] *= 0.25
        x[:, :, :n2] += 0.5
        u[:, :n2] *= 0.25
        states = np.empty((*ids.shape, HIDDEN), x.dtype)
        hu, gates = (np.empty((*ids.shape, k), x.dtype) if saved is not None else [None] * len(ids) for k in (3 * HIDDEN, n2))
        new = np.empty_like(states) if saved is not None else [None] * len(ids)
        for t in range(len(ids)):
            h = np.multiply(h, keep[t][:, None], out=states[t])
            y = np.matmul(h, u, out=hu[t])
            g = np.add(y[:, :n2], x[t, :, :n2], out=gates[t])
            np.maximum(g, 0.0, out=g)
            np.minimum(g, 1.0, out=g)
            n = np.multiply(g[:, HIDDEN:], y[:, n2:], out=new[t])
            n += x[t, :, n2:]
            np.tanh(n, out=n)
            h = h - n
            h *= g[:, :HIDDEN]
            h += n
        if saved is not None:
            saved |= {"hu": hu, "gates": gates, "new": new}
        return states, h

    def log_probs(self, h: np.ndarray, ids: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each token given its state; with grads, fills in the gradients of
        the summed loss and returns that of the states."""
        p = self.p
        head = np.flatnonzero(ids < self.heads)
        ids = ids.astype(np.int16)
        cls = np.where(ids < self.heads, ids // SIZE, ids - self.heads + self.head_classes)
        rows = np.arange(len(ids))
        e = h @ p["W"]
        e += p["b"]
        e -= e.max(1, keepdims=True)
        out = e[rows, cls]
        np.exp(e, out=e)
        total = e.sum(1)
        out = out - np.log(total)
        order = head[np.argsort(cls[head], kind="stable")]
        c = cls[order].astype(np.int64)
        first = np.flatnonzero(np.diff(c, prepend=-1))
        spans = list(zip(c[first].tolist(), first.tolist(), np.append(first[1:], len(order)).tolist()))
        word, mine, rows_in = ids[order] - c * SIZE, h[order], np.arange(len(order))
        ei = np.empty((len(order), SIZE), h.dtype)
        for k, x, y in spans:
            part = np.matmul(mine[x:y], p["V"][k].T, out=ei[x:y])
            part += p["c"][k]
        ei -= ei.max(1, keepdims=True, initial=-1e30)
        picked = ei[rows_in, word]
        np.exp(ei, out=ei)
        inner_total = ei.sum(1)
        out[order] += picked - np.log(inner_total)
        if grads is None:
            return out, None
        e /= total[:, None]
        e[rows, cls] -= 1.0
        grads["W"], grads["b"] = h.T @ e, e.sum(0)
        dh = e @ p["W"].T
        ei /= inner_total[:, None]
        ei[rows_in, word] -= 1.0
        grads["V"], grads["c"] = np.zeros_like(p["V"]), np.zeros_like(p["c"])
        if len(order):
            grads["c"][c[first]] = np.add.reduceat(ei, first)
        back = np.empty_like(mine)
        for k, x, y in spans:
            np.matmul(ei[x:y].T, mine[x:y], out=grads["V"][k])
            np.matmul(ei[x:y], p["V"][k], out=back[x:y])
        dh[order] += back
        return out, dh

    def gradients(self, ids: np.ndarray, valid: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[dict, float, np.ndarray]:
        """Gradients of the loss over one window, truncated at its start; the loss; the last state."""
        saved: dict = {}
        states, last = self.forward(ids, keep, h, saved)
        grads: dict = {}
        logp, d_out = self.log_probs(states[valid], ids[valid], grads)
        d_states = np.zeros_like(states)
        d_states[valid] = d_out
        n2, kind = 2 * HIDDEN, states.dtype.type
        gates, new = saved["gates"], saved["new"]
        z, r = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:]
        open_gates = ((gates > 0.0) & (gates < 1.0)) * kind(0.25)
        to_new = (1.0 - new * new) * (1.0 - z)
        to_z = (states - new) * open_gates[:, :, :HIDDEN]
        to_r = saved["hu"][:, :, n2:] * open_gates[:, :, HIDDEN:]
        d_new, d_hu = np.empty_like(states), np.empty((*ids.shape, 3 * HIDDEN), states.dtype)
        dh, ut = np.zeros_like(h), np.ascontiguousarray(self.p["U"].T)
        for t in reversed(range(len(ids))):
            back = d_hu[t]
            np.multiply(dh, to_z[t], out=back[:, :HIDDEN])
            dn = np.multiply(dh, to_new[t], out=d_new[t])
            np.multiply(dn, to_r[t], out=back[:, HIDDEN:n2])
            np.multiply(dn, r[t], out=back[:, n2:])
            dh = dh * z[t]
            dh += back @ ut
            dh += d_states[t]
            dh *= keep[t][:, None]
        grads["U"] = states.reshape(-1, HIDDEN).T @ d_hu.reshape(-1, 3 * HIDDEN)
        d_pre = d_hu
        d_pre[:, :, n2:] = d_new
        flat = ids.ravel()
        order = np.argsort(flat.astype(np.int16), kind="stable")
        first = np.flatnonzero(np.diff(flat[order].astype(np.int64), prepend=-1))
        grads["E"] = (flat[order][first], np.add.reduceat(d_pre.reshape(-1, 3 * HIDDEN)[order], first))
        return grads, -float(logp.sum()), last

    def train(self, docs: list[np.ndarray], rate: float, lanes: int = 64, window: int = 16, memory: dict | None = None) -> dict:
        """One pass of truncated backpropagation through time with Adagrad; memory goes on between calls."""
        memory = memory if memory is not None else self.fresh_memory()
        for ids, valid, keep, h, put, _ in windows(docs, lanes, window):
            n = max(1, int(valid.sum()))
            grads, _, last = self.gradients(ids, valid, keep, h)
            put(last)
            scale = np.float32(1.0 / np.sqrt(n))
            for k, g in grads.items():
                rows = slice(None)
                if k == "E":
                    rows, g = g
                g = np.clip(g * scale, -5.0, 5.0)
                memory[k][rows] += g * g
                self.p[k][rows] -= rate * g / np.sqrt(memory[k][rows])
        return memory

    def score(self, docs: list[np.ndarray], lanes: int = 512) -> np.ndarray:
        """Natural log probability of each document's tokens; the state goes from window to window."""
        out = np.zeros(len(docs))
        total, longest = sum(map(len, docs)), max(map(len, docs), default=1)
        lanes = int(min(lanes, max(8, 4 * total // max(longest, 1))))
        for ids, valid, keep, h, put, owner in windows(docs, lanes, WINDOW):
            states, last = self.forward(ids, keep, h)
            put(last)
            logp, _ = self.log_probs(states[valid], ids[valid])
            out += np.bincount(owner[valid], weights=logp, minlength=len(docs))
        return out


def windows(docs: list[np.ndarray], lanes: int, window: int) -> Iterator[tuple]:
    """Deal documents to lanes, longest first to the emptiest lane, and go through all lanes a window at
    a time; lanes that have ended drop out. Yields ids, valid, keep, state, a setter for the state and the
    documents."""
    lanes = max(1, min(lanes, len(docs)))
    heap, dealt = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for d in sorted(range(len(docs)), key=lambda d: (-len(docs[d]), d)):
        size, k = heapq.heappop(heap)
        dealt[k].append(d)
        heapq.heappush(heap, (size + len(docs[d]), k))
    dealt = sorted((x for x in dealt if x), key=lambda x: -sum(len(docs[d]) for d in x))
    sizes = np.array([sum(len(docs[d]) for d in x) for x in dealt], np.int64)
    if not len(sizes) or not sizes[0]:
        return
    # the lanes as columns of one table
    ids, owner, first = np.zeros((sizes[0], len(dealt)), np.uint16), np.full((sizes[0], len(dealt)), -1, np.int32), np.ones((sizes[0], len(dealt)), np.float32)
    for k, x in enumerate(dealt):
        n = [len(docs[d]) for d in x]
        ids[: sizes[k], k], owner[: sizes[k], k] = np.concatenate([docs[d] for d in x]), np.repeat(x, n)
        starts = np.cumsum([0, *n[:-1]])
        first[starts[starts < sizes[k]], k] = 0.0
    state = {"h": np.zeros((len(dealt), HIDDEN), np.float32)}

    def put(h: np.ndarray) -> None:
        state["h"] = h

    for t in range(0, int(sizes[0]), window):
        active = int((sizes > t).sum())
        part = slice(t, t + window)
        own = owner[part, :active]
        yield ids[part, :active], own >= 0, first[part, :active], state["h"][:active], put, own
