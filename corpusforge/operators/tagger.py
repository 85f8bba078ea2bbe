"""A neural segmenter in numpy: a recurrent network in both directions gives B, M, E, S scores, a Viterbi pass the tags.

The network has long short-term memory cells (G12, G13). It learns from tokens that another segmenter gave; learning is
for a bounded sample, tagging runs over Arrow batches with the parameters in a broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .segment import PARTS, TAGS, Memo, tokens_added, untagged

#: Bytes of texts whose new runs are tagged together.
AT_ONCE = 1 << 20
#: Which tag may follow which, and which may begin and end a run.
FOLLOWS = np.array([[0, 1, 1, 0], [0, 1, 1, 0], [1, 0, 0, 1], [1, 0, 0, 1]], bool)
BEGINS, ENDS = np.array([1, 0, 0, 1], bool), np.array([0, 0, 1, 1], bool)


def tags_of(tokens: list[str]) -> list[int]:
    out = []
    for t in tokens:
        out += [TAGS["S"]] if len(t) == 1 else [TAGS["B"], *[TAGS["M"]] * (len(t) - 2), TAGS["E"]]
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Tagger:
    """p: embedding e; of each direction d: input w, recurrent u, bias b of the gates i, f, o, g; output v and c."""

    def __init__(self, alphabet: list[str], size: int = 16, hidden: int = 16, seed: int = 0):
        r = np.random.default_rng(seed)
        self.ids, self.hidden = {x: k + 1 for k, x in enumerate(alphabet)}, hidden
        self.p = {"e": r.normal(0, 0.3, (len(alphabet) + 1, size)), "v": r.normal(0, 0.2, (2 * hidden, 4)), "c": np.zeros(4)}
        for d in "fb":
            self.p |= {f"w{d}": r.normal(0, 0.2, (size, 4 * hidden)), f"u{d}": r.normal(0, 0.2, (hidden, 4 * hidden)), f"b{d}": np.zeros(4 * hidden)}

    def encode(self, text: str) -> np.ndarray:
        return np.array([self.ids.get(x, 0) for x in text], np.int64)

    def run(self, d: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States of one direction over inputs x (steps, size), in the order of the text, and what the way back needs."""
        n, h = self.hidden, np.zeros(self.hidden)
        c, out, kept = np.zeros(n), np.zeros((len(x), n)), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = x[t] @ self.p[f"w{d}"] + h @ self.p[f"u{d}"] + self.p[f"b{d}"]
            i, f, o, g = _sigmoid(z[:n]), _sigmoid(z[n : 2 * n] + 1), _sigmoid(z[2 * n : 3 * n]), np.tanh(z[3 * n :])
            before, c = c, f * c + i * g
            kept.append((t, h, before, c, i, f, o, g))
            h = out[t] = o * np.tanh(c)
        return out, kept

    def scores(self, ids: np.ndarray) -> np.ndarray:
        x = self.p["e"][ids]
        return np.concatenate([self.run("f", x)[0], self.run("b", x)[0]], axis=1) @ self.p["v"] + self.p["c"]

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the tags and its gradients, by backpropagation through time."""
        x, n = self.p["e"][ids], self.hidden
        runs = {d: self.run(d, x) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=1)
        z = both @ self.p["v"] + self.p["c"]
        z -= z.max(axis=1, keepdims=True)
        prob = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        at = np.arange(len(ids))
        loss = -float(np.log(np.maximum(prob[at, tags], 1e-300)).mean())
        prob[at, tags] -= 1
        prob /= len(ids)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["v"], grads["c"] = both.T @ prob, prob.sum(axis=0)
        d_both, dx = prob @ self.p["v"].T, np.zeros_like(x)
        for k, d in enumerate("fb"):
            dh, dc = np.zeros(n), np.zeros(n)
            for t, h, before, c, i, f, o, g in reversed(runs[d][1]):
                dh = dh + d_both[t, k * n : (k + 1) * n]
                th = np.tanh(c)
                dc = dc + dh * o * (1 - th * th)
                dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)])
                grads[f"w{d}"] += np.outer(x[t], dz)
                grads[f"u{d}"] += np.outer(h, dz)
                grads[f"b{d}"] += dz
                dx[t] += self.p[f"w{d}"] @ dz
                dh, dc = self.p[f"u{d}"] @ dz, dc * f
        np.add.at(grads["e"], ids, dx)
        return loss, grads

    def fit(self, samples: list[list[str]], rounds: int = 5, rate: float = 0.01, seed: int = 0) -> list[float]:
        """Adam over token lists, one at a time in a seeded order; the mean loss of each round."""
        data = [(self.encode("".join(s)), np.array(tags_of(s))) for s in samples if any(s)]
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        r, step, means = np.random.default_rng(seed), 0, []
        for _ in range(rounds):
            losses = []
            for k in r.permutation(len(data)):
                loss, grads = self.gradients(*data[k])
                losses.append(loss)
                step += 1
                for name, g in grads.items():
                    m[name] += 0.1 * (g - m[name])
                    v[name] += 0.001 * (g * g - v[name])
                    self.p[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
            means.append(float(np.mean(losses)) if losses else 0.0)
        return means

    def states(self, d: str, x: np.ndarray) -> np.ndarray:
        """States of one direction over many inputs of one length at once: x (steps, inputs, size)."""
        n = self.hidden
        z = x @ self.p[f"w{d}"] + self.p[f"b{d}"]
        h, c, out = np.zeros((x.shape[1], n)), np.zeros((x.shape[1], n)), np.zeros((len(x), x.shape[1], n))
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            own = z[t] + h @ self.p[f"u{d}"]
            i, f, o = _sigmoid(own[:, :n]), _sigmoid(own[:, n : 2 * n] + 1), _sigmoid(own[:, 2 * n : 3 * n])
            c = f * c + i * np.tanh(own[:, 3 * n :])
            h = out[t] = o * np.tanh(c)
        return out

    def cut_all(self, texts: list[str], cells: int = 1 << 14) -> list[list[str]]:
        """The tokens of many runs, as `cut` gives them one by one: runs of one length are stepped through together."""
        by_length: dict[int, list[int]] = {}
        for k, t in enumerate(texts):
            by_length.setdefault(len(t), []).append(k)
        out: list[list[str]] = [[] for _ in texts]
        for length, places in by_length.items():
            size = max(1, cells // max(1, length))
            for at in range(0, len(places) if length else 0, size):
                some = places[at : at + size]
                x = self.p["e"][np.stack([self.encode(texts[k]) for k in some], axis=1)]
                s = np.concatenate([self.states("f", x), self.states("b", x)], axis=2) @ self.p["v"] + self.p["c"]
                best, back = np.where(BEGINS, s[0], -np.inf), np.zeros(s.shape, np.int8)
                for t in range(1, length):
                    ways = np.where(FOLLOWS, best[:, :, None], -np.inf)
                    back[t] = ways.argmax(axis=1)
                    best = ways.max(axis=1) + s[t]
                tags = np.zeros((length, len(some)), np.int8)
                tags[-1] = np.argmax(np.where(ENDS, best, -np.inf), axis=1)
                every = np.arange(len(some))
                for t in range(length - 1, 0, -1):
                    tags[t - 1] = back[t, every, tags[t]]
                for j, k in enumerate(some):
                    out[k] = untagged(texts[k], tags[:, j].tolist())
        return out

    def cut(self, text: str) -> list[str]:
        """The tokens of the best allowed tags."""
        if not text:
            return []
        s = self.scores(self.encode(text))
        best, back = np.where(BEGINS, s[0], -np.inf), []
        for row in s[1:]:
            ways = np.where(FOLLOWS, best[:, None], -np.inf)
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + row
        tag = int(np.argmax(np.where(ENDS, best, -np.inf)))
        tags = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            tags.append(tag)
        return untagged(text, tags[::-1])


def tagged(df: DataFrame, model: Tagger, text: str = "text", out: str = "tokens") -> DataFrame:
    """Tokens by the network: runs of letters are tagged, digits and marks stand alone; null and empty texts have none.

    The runs that a slice of the texts brings anew go through the network together.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        memo = Memo()

        def cut(texts: list[str | None]) -> list[list[str]]:
            parts = [PARTS.findall((x or "").lower()) for x in texts]
            new = list({p: None for x in parts for p in x if p[0].isalpha() and p not in memo})
            # Of this slice all runs stay at hand, of earlier ones those that the memo has kept.
            known = dict(zip(new, shared.value.cut_all(new), strict=True)) if new else {}
            found = []
            for x in parts:
                tokens: list[str] = []
                for p in x:
                    if p[0].isalpha():
                        tokens += known[p] if p in known else memo[p]
                    else:
                        tokens.append(p)
                found.append(tokens)
            for p, tokens in known.items():
                memo.keep(p, tokens)
            return found

        return cut

    return tokens_added(df, text, out, make, AT_ONCE)
