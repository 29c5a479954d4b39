"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

import numpy as np

#: Characters below 128 stand for themselves; then other letters, other characters, and the padding.
LETTER, OTHER, PAD = 128, 129, 130


def encode(texts: list[str], width: int) -> np.ndarray:
    """Character numbers of each text, cut or padded to width."""
    out = np.full((len(texts), width), PAD, np.int64)
    for row, t in zip(out, texts, strict=True):
        codes = [ord(c) if c < "\x80" else LETTER if c.isalpha() else OTHER for c in t[:width]]
        row[: len(codes)] = codes
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class BestTags:
    """The best tags of a stretch of any length by Viterbi; its scores come piece by piece, a byte per tag and character stays."""

    def __init__(self, trans: np.ndarray):
        self.trans, self.score, self.back = trans, None, []

    def add(self, e: np.ndarray) -> None:
        back = np.zeros(e.shape, np.uint8)
        for t, now in enumerate(e):
            if self.score is None:
                self.score = now
            else:
                every = self.score[:, None] + self.trans
                back[t] = every.argmax(axis=0)
                self.score = every.max(axis=0) + now
        self.back.append(back)

    def tags(self) -> np.ndarray:
        back = np.concatenate(self.back)
        tags = np.empty(len(back), np.uint8)
        if len(tags):
            tags[-1] = self.score.argmax()
        for t in range(len(tags) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags


class Tagger:
    """Scores tags for each character from both sides; the CRF scores a tag by the one before it."""

    def __init__(self, tags: int, hidden: int = 16, seed: int = 11):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) * 0.15).astype(np.float32)
        self.hidden = hidden
        self.p = {"trans": normal(tags, tags), "out": normal(2 * hidden, tags), "bias": np.zeros(tags, np.float32)}
        for way in ("l", "r"):
            self.p[f"{way}_in"], self.p[f"{way}_h"] = normal(PAD + 1, 4 * hidden), normal(hidden, 4 * hidden)
            self.p[f"{way}_in"][:, hidden : 2 * hidden] += 1  # remember by default

    def _run(self, way: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states (time, row, hidden) for x (time, row), and what the way back needs."""
        n, (table, w) = self.hidden, (self.p[f"{way}_in"], self.p[f"{way}_h"])
        h = c = np.zeros((x.shape[1], n), np.float32)
        states, kept = np.empty((*x.shape, n), np.float32), []
        for t in range(len(x)):
            z = table[x[t]] + h @ w
            gates, g = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            before, past = h, c
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            c = f * past + i * g
            q = np.tanh(c)
            h = o * q
            states[t] = h
            kept.append((before, past, i, f, o, g, q))
        return states, kept

    def _back(self, way: str, x: np.ndarray, kept: list, grad: np.ndarray, into: dict) -> None:
        n, w = self.hidden, self.p[f"{way}_h"]
        table, dw = np.zeros_like(self.p[f"{way}_in"]), np.zeros_like(w)
        dh = dc = np.zeros((x.shape[1], n), np.float32)
        for t in range(len(x) - 1, -1, -1):
            before, past, i, f, o, g, q = kept[t]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - q * q)
            dz = np.concatenate([dc * g * i * (1 - i), dc * past * f * (1 - f), dh * q * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            np.add.at(table, x[t], dz)
            dw += before.T @ dz
            dh, dc = dz @ w.T, dc * f
        into[f"{way}_in"], into[f"{way}_h"] = table, dw

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Tag scores (row, time, tag) of encoded windows (row, time)."""
        x = x.T
        both = np.concatenate([self._run("l", x)[0], self._run("r", x[::-1])[0][::-1]], axis=2)
        return (both @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)

    def _step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood of tags y for windows x (both time, row), and its gradients."""
        p, g = self.p, {}
        left, kept_l = self._run("l", x)
        right, kept_r = self._run("r", x[::-1])
        both = np.concatenate([left, right[::-1]], axis=2)
        e, trans = both @ p["out"] + p["bias"], p["trans"]
        time, rows = x.shape
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, time):
            alpha[t] = _log_sum(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(time - 2, -1, -1):
            beta[t] = _log_sum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _log_sum(alpha[-1], 1)
        de = np.exp(alpha + beta - z[:, None])
        pair = np.exp(alpha[:-1][:, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None]).sum(axis=(0, 1))
        at, row = np.arange(time)[:, None], np.arange(rows)
        gold = e[at, row, y].sum() + trans[y[:-1], y[1:]].sum()
        de[at, row, y] -= 1
        np.subtract.at(pair, (y[:-1], y[1:]), 1)
        g["trans"], g["out"], g["bias"] = pair, np.einsum("trh,trk->hk", both, de), de.sum(axis=(0, 1))
        dboth, n = de @ p["out"].T, self.hidden
        self._back("l", x, kept_l, dboth[:, :, :n], g)
        self._back("r", x[::-1], kept_r, dboth[::-1, :, n:], g)
        return float(z.sum() - gold), {k: v / rows for k, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 300, rows: int = 48, rate: float = 0.02, seed: int = 5) -> "Tagger":
        """About `steps` steps of Adam on the likelihood of tags y for windows x (both row, time), at a falling rate."""
        rng, step = np.random.default_rng(seed), 0
        epochs = -(-steps // -(-len(x) // rows))
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), rows):
                part, step = order[at : at + rows], step + 1
                _, grads = self._step(x[part].T, y[part].T)
                norm = np.sqrt(sum(float((d * d).sum()) for d in grads.values()))
                for k, d in grads.items():
                    d = d * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.p[k] -= (rate * max(0.05, 1 - step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best tag of each character for scores (time, tag)."""
        path = BestTags(self.p["trans"])
        path.add(e)
        return path.tags()
