"""A gated recurrent language model in numpy: training by truncated backpropagation, and scoring.

Texts run in lanes, one after another; the state is carried from window to window and set to zero
where a text begins. The output softmax is factored: a word's class, then the word in its class.
"""

from __future__ import annotations

import numpy as np


def word_classes(counts: np.ndarray, n_classes: int) -> np.ndarray:
    """Class of each token: tokens by falling count, cut where the sum of the counts' square roots is even."""
    order = np.argsort(-counts, kind="stable")
    mass = np.cumsum(np.sqrt(counts[order] + 1.0))
    out = np.zeros(len(counts), np.int64)
    out[order] = np.minimum(n_classes - 1, (mass / mass[-1] * n_classes * (1 - 1e-12)).astype(int))
    return np.unique(out, return_inverse=True)[1]


class Gru:
    def __init__(self, counts: np.ndarray, hidden: int = 16, n_classes: int = 40, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden, self.word_class = hidden, word_classes(counts, n_classes)
        v, k = len(counts), int(self.word_class.max()) + 1
        self.members = [np.flatnonzero(self.word_class == c) for c in range(k)]
        self.place = np.zeros(v, np.int64)
        for m in self.members:
            self.place[m] = np.arange(len(m))
        class_counts = np.bincount(self.word_class, counts, minlength=k)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        # biases start at the logarithms of the counts: the untrained model is about a unigram model
        self.p = {
            "x": small(v, 3 * hidden), "u": small(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32),
            "c": small(hidden, k), "cb": np.log(class_counts + 0.1).astype(np.float32), "o": small(v, hidden), "ob": np.log(counts + 0.1).astype(np.float32),
        }
        self.square = {n: np.full_like(a, 1e-2) for n, a in self.p.items()}

    def step(self, h: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, tuple]:
        n, p = self.hidden, self.p
        x, hu = p["x"][tokens] + p["b"], h @ p["u"]
        zr = 1 / (1 + np.exp(-(x[:, : 2 * n] + hu[:, : 2 * n])))
        z, r = zr[:, :n], zr[:, n:]
        new = np.tanh(x[:, 2 * n :] + r * hu[:, 2 * n :])
        return new + z * (h - new), (h, z, r, new, hu[:, 2 * n :])

    def log_probabilities(self, h: np.ndarray, targets: np.ndarray, back: bool = False):
        """Natural logarithm for each row of states and its target; with ``back``: also gradients of their sum."""
        p, n = self.p, len(targets)
        cls = self.word_class[targets]
        logits = h @ p["c"] + p["cb"]
        top = logits.max(1, keepdims=True)
        e = np.exp(logits - top)
        total = e.sum(1, keepdims=True)
        out = logits[np.arange(n), cls] - (top + np.log(total))[:, 0]
        if back:
            d = -e / total
            d[np.arange(n), cls] += 1
            grad = {"c": h.T @ d, "cb": d.sum(0), "o": np.zeros_like(p["o"]), "ob": np.zeros_like(p["ob"])}
            dh = d @ p["c"].T
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        cut = np.searchsorted(cls[order], np.arange(len(self.members) + 1))
        for c, words in enumerate(self.members):
            rows = order[cut[c] : cut[c + 1]]
            if not len(rows) or len(words) == 1:
                continue
            hc = h[rows]
            logits = hc @ p["o"][words].T + p["ob"][words]
            at = self.place[targets[rows]]
            top = logits.max(1, keepdims=True)
            e = np.exp(logits - top)
            total = e.sum(1, keepdims=True)
            out[rows] += logits[np.arange(len(rows)), at] - (top + np.log(total))[:, 0]
            if back:
                d = -e / total
                d[np.arange(len(rows)), at] += 1
                grad["o"][words] += d.T @ hc
                grad["ob"][words] += d.sum(0)
                dh[rows] += d @ p["o"][words]
        return (out, grad, dh) if back else out

    def train_window(self, h: np.ndarray, tokens: np.ndarray, fresh: np.ndarray, targets: np.ndarray, rate: float) -> np.ndarray:
        """One update from a window (steps x lanes), propagated back within it; returns the state to go on with."""
        steps, lanes = tokens.shape
        n, p, kept, states = self.hidden, self.p, [], []
        for t in range(steps):
            h = np.where(fresh[t][:, None], np.float32(0), h)
            h, cache = self.step(h, tokens[t])
            kept.append(cache)
            states.append(h)
        _, grad, dout = self.log_probabilities(np.concatenate(states), targets.ravel(), back=True)
        dout = dout.reshape(steps, lanes, n)
        gates, du, dh = np.zeros((steps, lanes, 3 * n), np.float32), np.zeros_like(p["u"]), np.zeros((lanes, n), np.float32)
        for t in reversed(range(steps)):
            before, z, r, new, hu = kept[t]
            dh = dh + dout[t]
            dnew = dh * (1 - z) * (1 - new * new)
            dz = dh * (before - new) * z * (1 - z)
            dr = dnew * hu * r * (1 - r)
            gates[t] = np.concatenate([dz, dr, dnew], axis=1)
            inner = np.concatenate([dz, dr, dnew * r], axis=1)
            du += before.T @ inner
            dh = np.where(fresh[t][:, None], np.float32(0), dh * z + inner @ p["u"].T)
        flat, ids = gates.reshape(-1, 3 * n), tokens.ravel()
        order = np.argsort(ids, kind="stable")
        used, first = np.unique(ids[order], return_index=True)
        dx = np.zeros_like(p["x"])
        dx[used] = np.add.reduceat(flat[order], first, axis=0)
        grad |= {"x": dx, "u": du, "b": flat.sum(0)}
        for k, g in grad.items():  # Adagrad, upwards in likelihood
            g = np.clip(g / lanes, -1, 1)
            self.square[k] += g * g
            p[k] += (rate * g / np.sqrt(self.square[k])).astype(np.float32)
        return h

    def train(self, texts: list[np.ndarray], lanes: int = 64, steps: int = 16, rate: float = 0.1) -> int:
        """One pass over token arrays; returns the number of tokens learnt from."""
        tokens, fresh, targets = streams(texts, lanes, steps)
        h = np.zeros((lanes, self.hidden), np.float32)
        for t in range(0, len(tokens), steps):
            h = self.train_window(h, tokens[t : t + steps], fresh[t : t + steps], targets[t : t + steps], rate)
        return tokens.size

    def score(self, texts: list[np.ndarray], lanes: int = 512, steps: int = 32) -> np.ndarray:
        """Natural logarithm of each whole text's probability, its end included."""
        total = np.zeros(len(texts))
        if not len(texts):
            return total
        # longest first, each to the lane that is shortest so far; lanes then end in order
        size = np.array([len(x) + 1 for x in texts])
        lanes = min(lanes, len(texts))
        lane_of, load = deal(size, lanes)
        order = np.argsort(-load, kind="stable")
        turn = np.empty(lanes, int)
        turn[order] = np.arange(lanes)
        lane_of, load = turn[lane_of], load[order]
        length = int(load[0])
        tokens, targets, doc = (np.zeros((length, lanes), np.int32) for _ in range(3))
        fresh = np.zeros((length, lanes), bool)
        at = np.zeros(lanes, int)
        for i, x in enumerate(texts):
            k, a = lane_of[i], at[lane_of[i]]
            tokens[a + 1 : a + 1 + len(x), k] = x
            targets[a : a + len(x), k] = x
            fresh[a, k], doc[a : a + len(x) + 1, k] = True, i
            at[k] += len(x) + 1
        h = np.zeros((lanes, self.hidden), np.float32)
        for t in range(0, length, steps):
            end, live = min(t + steps, length), int(np.searchsorted(-load, -t, "left"))
            h, states, rows = h[:live], [], []
            for s in range(t, end):
                live = int(np.searchsorted(-load, -s, "left"))
                h = np.where(fresh[s, :live, None], np.float32(0), h[:live])
                h, _ = self.step(h, tokens[s, :live])
                states.append(h)
                rows.append(live)
            goal = np.concatenate([targets[t + i, :n] for i, n in enumerate(rows)])
            who = np.concatenate([doc[t + i, :n] for i, n in enumerate(rows)])
            total += np.bincount(who, self.log_probabilities(np.concatenate(states), goal), minlength=len(texts))
        return total


def deal(size: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Lane of each text, longest first to the shortest lane; and the lanes' lengths."""
    import heapq

    heap = [(0, k) for k in range(lanes)]
    lane_of, load = np.zeros(len(size), int), np.zeros(lanes, int)
    for i in np.argsort(-size, kind="stable"):
        n, k = heapq.heappop(heap)
        lane_of[i] = k
        load[k] = n + size[i]
        heapq.heappush(heap, (int(load[k]), k))
    return lane_of, load


def streams(texts: list[np.ndarray], lanes: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, starts of texts, targets), each steps x lanes: texts in a row, cut into equal lanes.

    A text's inputs begin with the end token 0, its targets end with it. What is left over is filled
    with empty texts.
    """
    empty = np.zeros(1, np.int32)
    ins = np.concatenate([np.concatenate([empty, x]) for x in texts] or [empty])
    outs = np.concatenate([np.concatenate([x, empty]) for x in texts] or [empty])
    first = np.zeros(len(ins), bool)
    first[np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])[:-1]]).astype(int) if texts else [0]] = True
    length = -(-len(ins) // lanes)
    length = -(-length // steps) * steps
    pad = length * lanes - len(ins)
    shape = lambda a, fill: np.concatenate([a, np.full(pad, fill, a.dtype)]).reshape(lanes, length).T.copy()
    return shape(ins, 0), shape(first, True), shape(outs, 0)
