"""A character-level bidirectional LSTM with a linear-chain CRF, in numpy.

Gates and cells are piecewise linear (hard sigmoid, hard tangent), as the
transcendental ones would cost most of the time of reading; a cell stays within
``BOUND``, so that a text may be of any length. Inputs are character classes
and binary features; the input weights of a class are one row of a table, so no
product is needed for them. ``Network.read`` runs whole sequences of any
lengths in a batch and decodes them, ``scores`` and ``viterbi`` do the same
plainly for sequences of equal length, ``loss`` gives the negative log
likelihood of the CRF with all gradients for training.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]
#: Largest value of a cell, either way.
BOUND = 4
#: Steps whose hidden states are kept until they are turned into scores.
STEPS = 8
#: Sequences run together: few enough for the caches of a core, enough for the calls of a step.
COLUMNS = 384
#: Gain below which a run of labels is out, less rounding.
SLACK = 0.01


def initial(classes: int, features: int, hidden: int, labels: int, seed: int = 0) -> Params:
    r = np.random.RandomState(seed)
    p: Params = {}
    for d in "fb":
        p[f"x{d}"] = (r.randn(classes, 4 * hidden) * 0.3).astype(np.float32)
        p[f"x{d}"][:, hidden : 2 * hidden] += 1.0
        p[f"u{d}"] = (r.randn(features, 4 * hidden) * 0.3).astype(np.float32)
        p[f"h{d}"] = (r.randn(hidden, 4 * hidden) / np.sqrt(hidden)).astype(np.float32)
    p["o"] = (r.randn(2 * hidden, labels) / np.sqrt(2 * hidden)).astype(np.float32)
    p["ob"] = np.zeros(labels, np.float32)
    p["t"] = np.zeros((labels, labels), np.float32)
    return p


def _run(x: np.ndarray, w: np.ndarray, keep: bool):
    """Hidden states of one direction over inputs (T, B, 4H); gates i, f, o, g."""
    steps, batch, wide = x.shape
    hidden = wide // 4
    out = np.empty((steps, batch, hidden), x.dtype)
    h, c = np.zeros((batch, hidden), x.dtype), np.zeros((batch, hidden), x.dtype)
    kept = []
    for t in range(steps):
        z = h @ w
        z += x[t]
        s = np.clip(z[:, : 3 * hidden] / 4 + 0.5, 0, 1)
        g = np.clip(z[:, 3 * hidden :], -1, 1)
        i, f, o = s[:, :hidden], s[:, hidden : 2 * hidden], s[:, 2 * hidden :]
        before = c
        c = np.clip(f * c + i * g, -BOUND, BOUND)
        th = np.clip(c, -1, 1)
        h = o * th
        out[t] = h
        if keep:
            kept.append((s, g, before, th, c))
    return out, kept


def _inputs(p: Params, d: str, chars: np.ndarray, features: np.ndarray) -> np.ndarray:
    x = p[f"x{d}"][chars]
    for k in range(features.shape[2]):
        t, b = np.nonzero(features[:, :, k])
        x[t, b] += p[f"u{d}"][k]
    return x


def scores(p: Params, chars: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Label scores (T, B, labels) of windows: chars (T, B) of class numbers, features (T, B, F) of 0 and 1."""
    f, _ = _run(_inputs(p, "f", chars, features), p["hf"], False)
    b, _ = _run(_inputs(p, "b", chars, features)[::-1], p["hb"], False)
    half = f.shape[2]
    return f @ p["o"][:half] + b[::-1] @ p["o"][half:] + p["ob"]


def viterbi(score: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Best labels (T, B)."""
    steps, batch, _ = score.shape
    best = score[0].copy()
    back = np.empty(score.shape, np.int8)
    for t in range(1, steps):
        each = best[:, :, None] + transition[None]
        back[t] = each.argmax(1)
        best = each.max(1) + score[t]
    out = np.empty((steps, batch), np.int8)
    out[-1] = best.argmax(1)
    rows = np.arange(batch)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = back[t, rows, out[t]]
    return out


class Network:
    """The network made ready for reading: slopes folded into the weights, one row of input for each class with each set of features, both directions in one product."""

    def __init__(self, p: Params):
        self.hidden, self.labels = len(p["hf"]), len(p["t"])
        features = len(p["uf"])
        given = (np.arange(1 << features)[:, None] >> np.arange(features) & 1).astype(np.float32)
        slope = np.repeat(np.float32([0.25, 0.25, 0.25, 1]), self.hidden)
        shift = np.repeat(np.float32([0.5, 0.5, 0.5, 0]), self.hidden)
        rows, weights = [], []
        for d in "fb":
            x = (p[f"x{d}"] + (given @ p[f"u{d}"])[:, None]).reshape(-1, 4 * self.hidden) * slope + shift
            rows.append(x.reshape(-1, 4, self.hidden).transpose(1, 0, 2))
            weights.append((p[f"h{d}"] * slope).reshape(self.hidden, 4, self.hidden).transpose(1, 0, 2))
        #: Row of each code: those without a feature, which most characters have, lie together.
        self.place = np.arange(len(given) * len(p["xf"]), dtype=np.int32).reshape(len(given), -1).T.ravel()
        #: By gate: the rows of both directions one after the other; the weights by direction.
        self.rows = np.ascontiguousarray(np.concatenate(rows, 1), np.float32)
        self.weights = np.ascontiguousarray(np.stack(weights, 1), np.float32)
        #: Filled up with zeros, as products with eight columns are faster.
        self.out = np.zeros((2, self.hidden, -(-self.labels // 8) * 8), np.float32)
        self.out[:, :, : self.labels] = np.split(p["o"], 2)
        self.bias, self.transition = p["ob"], p["t"]
        self.space: dict[str, np.ndarray] = {}
        t = p["t"]
        #: What a label gains on 0 by the transition to it from any label but 0, at most.
        self.gain = t[1:].max(0) - t[0, 0]
        #: What a run of labels gains more by its first and last transition, at most: inside a sequence and at its edges.
        self.entry, self.exit = float((t[0, 1:] - t[0, 0] - self.gain[1:]).max()), float(t[1:, 0].max() - t[0, 0])
        self.opening = float(-self.gain[1:].min())

    def _room(self, name: str, kind: type, *shape: int) -> np.ndarray:
        """An array of any content that is used again by the next call."""
        size = int(np.prod(shape))
        if name not in self.space or len(self.space[name]) < size:
            self.space[name] = np.empty(size, kind)
        return self.space[name][:size].reshape(shape)

    def _scores(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores (T, 2, B, labels and fill) of both directions, of ``codes`` (T, 2, B) that are rows of ``self.rows``; the columns have descending sizes, and only what is left of them is computed."""
        steps, _, batch = codes.shape
        hidden, n = self.hidden, batch
        left = np.searchsorted(-sizes, -np.arange(steps), "left").tolist()
        scores = self._room("scores", np.float32, steps, 2, batch, self.out.shape[2])
        kept, cell, last = (self._room(name, np.float32, *shape, 2, batch, hidden) for name, shape in (("kept", [STEPS]), ("cell", []), ("last", [])))
        for a in (kept, cell, last):
            a.fill(0)
        flat = self._room("flat", np.float32, 2, 8 * batch * hidden)
        x, z = flat.reshape(2, 4, 2, batch, hidden)
        c = cell
        zero, one, bound = np.float32(0), np.float32(1), np.float32(BOUND)
        for t in range(steps):
            if left[t] != n:
                n = left[t]
                x, z = (b[: 8 * n * hidden].reshape(4, 2, n, hidden) for b in flat)
                c, last = cell[:, :n], last[:, :n]
            h = kept[t % STEPS, :, :n]
            self.rows.take(codes[t, :, :n], 1, x, "clip")
            np.matmul(last, self.weights, out=z)
            np.add(z, x, out=z)
            gates, g = z[:3], z[3]
            gates.clip(zero, one, gates)
            g.clip(-one, one, g)
            np.multiply(g, gates[0], out=g)
            np.multiply(c, gates[1], out=c)
            np.add(c, g, out=c)
            c.clip(-bound, bound, c)
            c.clip(-one, one, g)
            np.multiply(g, gates[2], out=h)
            last = h
            if t % STEPS == STEPS - 1 or t == steps - 1:
                begin = t - t % STEPS
                np.matmul(kept[: t + 1 - begin], self.out, out=scores[begin : t + 1])
        return scores

    def _read(self, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (characters, labels and fill) without the bias, of sequences of descending sizes, one after the other, and their sizes."""
        sizes = np.asarray([len(c) for c in codes])
        steps, batch = int(sizes[0]), len(sizes)
        ahead = self._room("ahead", np.int32, 2, batch, steps)
        for j, c in enumerate(codes):
            row = ahead[0, j, : len(c)]
            self.place.take(c, 0, row, "clip")
            np.add(row[::-1], len(self.place), out=ahead[1, j, : len(c)])
        line = self._room("line", np.intp, steps, 2, batch)
        line[:] = ahead.transpose(2, 0, 1)
        scores = self._scores(line, sizes).reshape(-1, self.out.shape[2])
        column, begin = np.arange(batch), np.cumsum(sizes) - sizes
        at = np.arange(0, 2 * batch * int(sizes.sum()), 2 * batch)
        at += np.repeat(column - 2 * batch * begin, sizes)
        score, back = (self._room(name, np.float32, len(at), scores.shape[1]) for name in ("forth", "back"))
        scores.take(at, 0, score, "clip")
        np.subtract(np.repeat(2 * (batch * (sizes - 1) + column) + batch, sizes), at, out=at)
        scores.take(at, 0, back, "clip")
        score += back
        return score, sizes

    def read(self, codes: list[np.ndarray]) -> list[np.ndarray | None]:
        """Best labels of each sequence, None where all are 0. Codes: the class times the number of sets of features, plus the set, of each character."""
        out: list[np.ndarray | None] = [None] * len(codes)
        order = sorted((k for k in range(len(codes)) if len(codes[k])), key=lambda k: -len(codes[k]))
        runs, where, before = [], [], 0
        for c in range(0, len(order), COLUMNS):
            score, sizes = self._read([codes[k] for k in order[c : c + COLUMNS]])
            unsure, first, last = self.unsure(score, sizes)
            at = np.flatnonzero(unsure)
            runs.append((score[at, : self.labels] + self.bias, first[at], last[at], at + before))
            where.append(sizes)
            before += len(score)
        if not before:
            return out
        score, first, last, at = (np.concatenate(x) for x in zip(*runs))
        label, sizes = self.decoded(score, first, last, at), np.concatenate(where)
        at, label = at[label > 0], label[label > 0]
        begin = np.cumsum(sizes) - sizes
        for k, a, n, i, j in zip(order, begin.tolist(), sizes.tolist(), np.searchsorted(at, begin).tolist(), np.searchsorted(at, begin + sizes).tolist()):
            if j > i:
                out[k] = np.zeros(n, np.int8)
                out[k][at[i:j] - a] = label[i:j]
        return out

    def unsure(self, score: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where sequences in a row may have a label on the best path, and where they begin and end.

        On the best path a run of labels gains on zeros in its place. It gains at
        most the sum, over its characters, of what the best label with the best
        transition to it gains, and what it pays to begin and end; so a character
        is 0 where no stretch around it comes to a gain. The best stretch up to a
        character is a difference of sums from the start.
        """
        first, last = np.zeros((2, len(score)), bool)
        end = np.cumsum(sizes)
        first[end - sizes], last[end - 1] = True, True
        more = self.gain + self.bias - self.bias[0]
        most = score[:, 1] + more[1]
        for j in range(2, self.labels):
            np.maximum(most, score[:, j] + more[j], out=most)
        most -= score[:, 0]
        most[first] += self.opening - self.entry
        most[last] -= self.exit
        total = np.zeros(len(most) + 1)
        np.cumsum(most, dtype=np.float64, out=total[1:])
        up, down = np.minimum.accumulate(total[:-1]), np.maximum.accumulate(total[:0:-1])[::-1]
        down -= up
        return down >= -(self.entry + self.exit + SLACK), first, last

    def decoded(self, score: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Best labels, by the CRF and exact, of the characters ``at`` these places; those between them are 0, and ``first`` and ``last`` tell the edges of sequences."""
        label, t_ = np.zeros(len(score), np.int8), self.transition
        if not len(score):
            return label
        gap = np.diff(at) > 1
        begin = np.flatnonzero(first | np.r_[True, gap])
        size = np.flatnonzero(last | np.r_[gap, True]) + 1 - begin
        score = np.ascontiguousarray(score.T)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        left = np.searchsorted(-size, -np.arange(size[0]), "left")
        best = [score[:, begin] + np.where(first[begin], 0, t_[0][:, None])]
        for t in range(1, size[0]):
            before = best[-1][:, : left[t]]
            now = before[0] + t_[0][:, None]
            for i in range(1, len(t_)):
                np.maximum(now, before[i] + t_[i][:, None], out=now)
            best.append(now + score[:, begin[: left[t]] + t])
        now, ending = np.zeros(len(begin), np.int64), np.where(last[begin + size - 1], 0, t_[:, :1])
        for t in range(size[0] - 1, -1, -1):
            n, goes = left[t], left[t + 1] if t + 1 < size[0] else 0
            now[goes:n] = (best[t][:, goes:n] + ending[:, goes:n]).argmax(0)
            now[:goes] = (best[t][:, :goes] + t_[:, now[:goes]]).argmax(0)
            label[begin[:n] + t] = now[:n]
        return label


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def loss(p: Params, chars: np.ndarray, features: np.ndarray, labels: np.ndarray) -> tuple[float, Params]:
    """Mean negative log likelihood per character and its gradients."""
    steps, batch = chars.shape
    f, keep_f = _run(_inputs(p, "f", chars, features), p["hf"], True)
    b, keep_b = _run(_inputs(p, "b", chars, features)[::-1], p["hb"], True)
    half = f.shape[2]
    both = np.concatenate([f, b[::-1]], 2)
    s = both @ p["o"] + p["ob"]
    t_ = p["t"]
    alpha = np.empty_like(s)
    alpha[0] = s[0]
    for t in range(1, steps):
        alpha[t] = _lse(alpha[t - 1][:, :, None] + t_[None], 1) + s[t]
    z = _lse(alpha[-1], 1)
    beta = np.zeros_like(s)
    for t in range(steps - 2, -1, -1):
        beta[t] = _lse(t_[None] + (s[t + 1] + beta[t + 1])[:, None, :], 2)
    rows = np.arange(batch)
    gold = s[np.arange(steps)[:, None], rows, labels].sum(0) + t_[labels[:-1], labels[1:]].sum(0)
    value = float((z - gold).mean() / steps)
    ds = np.exp(alpha + beta - z[None, :, None])
    ds[np.arange(steps)[:, None], rows, labels] -= 1
    dt = np.zeros_like(t_)
    for t in range(1, steps):
        dt += np.exp(alpha[t - 1][:, :, None] + t_[None] + (s[t] + beta[t] - z[:, None])[:, None, :]).sum(0)
    np.add.at(dt, (labels[:-1].ravel(), labels[1:].ravel()), -1)
    scale = np.float32(1 / (batch * steps))
    ds *= scale
    g: Params = {"t": dt * scale, "ob": ds.sum((0, 1))}
    flat = ds.reshape(-1, ds.shape[2])
    g["o"] = both.reshape(len(flat), -1).T @ flat
    dboth = ds @ p["o"].T
    onehot = np.zeros((steps * batch, len(p["xf"])), np.float32)
    onehot[np.arange(steps * batch), chars.ravel()] = 1
    for d, kept, out, dh in (("f", keep_f, f, dboth[:, :, :half]), ("b", keep_b, b, dboth[::-1, :, half:])):
        dz = np.empty((steps, batch, 4 * half), np.float32)
        back_h, back_c = np.zeros((batch, half), np.float32), np.zeros((batch, half), np.float32)
        w = p[f"h{d}"]
        dw = np.zeros_like(w)
        for t in range(steps - 1, -1, -1):
            gates, cand, before, th, now = kept[t]
            i, fo, o = gates[:, :half], gates[:, half : 2 * half], gates[:, 2 * half :]
            h = dh[t] + back_h
            c = (h * o * (np.abs(th) < 1) + back_c) * (np.abs(now) < BOUND)
            step = dz[t]
            step[:, :half] = c * cand
            step[:, half : 2 * half] = c * before
            step[:, 2 * half : 3 * half] = h * th
            step[:, : 3 * half] *= ((gates > 0) & (gates < 1)) / np.float32(4)
            step[:, 3 * half :] = c * i * (np.abs(cand) < 1)
            back_c = c * fo
            back_h = step @ w.T
            if t:
                dw += out[t - 1].T @ step
        g[f"h{d}"] = dw
        if d == "b":
            dz = dz[::-1]
        z2 = dz.reshape(steps * batch, -1)
        g[f"x{d}"] = onehot.T @ z2
        g[f"u{d}"] = features.reshape(steps * batch, -1).astype(np.float32).T @ z2
    return value, g


class Adam:
    def __init__(self, p: Params):
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.n = 0

    def step(self, p: Params, g: Params, rate: float) -> None:
        self.n += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        clip = min(1.0, 1.0 / max(norm, 1e-9))
        for k in p:
            d = g[k] * clip
            self.m[k] = 0.9 * self.m[k] + 0.1 * d
            self.v[k] = 0.999 * self.v[k] + 0.001 * d * d
            p[k] -= (rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.999**self.n)) + 1e-8)).astype(np.float32)
