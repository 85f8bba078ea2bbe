"""A bidirectional gated recurrent network over bytes in numpy, trained by backpropagation through time.

Arrays are (units, lanes): many segments of text step together, so every step is a few wide operations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BiGru:
    """hidden units a direction, classes. One embedding table of the gates' inputs stands for each byte (256: padding)."""

    hidden: int
    classes: int
    seed: int = 1
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if not self.p:
            r, h = np.random.default_rng(self.seed), self.hidden
            for d in "fb":
                self.p[f"w{d}"] = r.normal(0, 0.3, (3 * h, 257))
                self.p[f"u{d}"] = r.normal(0, 1 / np.sqrt(h), (3 * h, h))
            self.p["v"] = r.normal(0, 1 / np.sqrt(2 * h), (self.classes, 2 * h))
            self.p["c"] = np.zeros((self.classes, 1))
        self.p = {k: np.ascontiguousarray(v, np.float32) for k, v in self.p.items()}

    def direction(self, d: str, x: np.ndarray, cache: list | None = None, start: np.ndarray | None = None, active: np.ndarray | None = None) -> np.ndarray:
        """States (steps, hidden, lanes) of one direction over bytes x (steps, lanes); d: f or b.

        start: the lanes' states before (zero by default). active: lanes, the first so many, that have a byte at each
        step; the states of the others stay as they are.
        """
        w, u, h, (steps, lanes) = self.p[f"w{d}"], self.p[f"u{d}"], self.hidden, x.shape
        out = np.empty((steps, h, lanes), np.float32)
        s = np.zeros((h, lanes), np.float32) if start is None else start
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            n_active = lanes if active is None else active[t]
            whole = n_active == lanes
            before = s if whole else np.ascontiguousarray(s[:, :n_active])
            a, g = w.take(x[t] if whole else x[t, :n_active], axis=1), u @ before
            rz = a[: 2 * h]
            rz += g[: 2 * h]
            np.multiply(rz, 0.5, out=rz)
            np.tanh(rz, out=rz)
            rz *= 0.5
            rz += 0.5
            n = rz[:h] * g[2 * h :]
            n += a[2 * h :]
            np.tanh(n, out=n)
            if cache is not None:
                cache.append((t, s, rz, n, g[2 * h :]))
            after = n + rz[h:] * (before - n)
            if whole:
                s = after
            else:
                s = s.copy() if t in (0, steps - 1) else s
                s[:, :n_active] = after
            out[t] = s
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (steps, classes, lanes) of the classes at every position."""
        return self.labelled(self.direction("f", x), self.direction("b", x))

    def labelled(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """Probabilities of the classes from the states of both directions."""
        z = self.p["v"][:, : self.hidden] @ forward
        z += self.p["v"][:, self.hidden :] @ backward
        z += self.p["c"]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the positions' classes against y (lanes), mask (steps, lanes), and its gradients."""
        h, (steps, lanes) = self.hidden, x.shape
        caches = {"f": [], "b": []}
        states = {d: self.direction(d, x, caches[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=1)
        z = self.p["v"] @ both + self.p["c"]
        z -= z.max(axis=1, keepdims=True)
        prob = np.exp(z)
        prob /= prob.sum(axis=1, keepdims=True)
        total = max(1.0, float(mask.sum()))
        lane = np.arange(lanes)
        loss = -float((np.log(np.maximum(prob[:, y, lane], 1e-12)) * mask).sum()) / total
        dz = prob
        dz[:, y, lane] -= 1
        dz *= mask[:, None, :] / total
        grads = {"v": np.einsum("tcl,thl->ch", dz, both, optimize=True), "c": dz.sum(axis=(0, 2))[:, None]}
        dboth = np.einsum("ch,tcl->thl", self.p["v"], dz, optimize=True)
        for k, d in enumerate("fb"):
            u = self.p[f"u{d}"]
            du, dw = np.zeros_like(u), np.zeros((257, 3 * h), np.float32)
            carry = np.zeros((h, lanes), np.float32)
            for t, before, rz, n, gn in reversed(caches[d]):
                ds = dboth[t, k * h : (k + 1) * h] + carry
                r, zt = rz[:h], rz[h:]
                dn = ds * (1 - zt) * (1 - n * n)
                da = np.concatenate([dn * gn * r * (1 - r), ds * (before - n) * zt * (1 - zt), dn])
                dg = da.copy()
                dg[2 * h :] *= r
                du += dg @ before.T
                carry = ds * zt + u.T @ dg
                np.add.at(dw, x[t], da.T)
            grads[f"u{d}"], grads[f"w{d}"] = du, dw.T
        return loss, grads

    def fit(self, batches, steps: int, rate: float = 0.02) -> list[float]:
        """Adam over (x, y, mask) batches, its rate falling to a tenth over the steps; the losses."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for i, (x, y, mask) in enumerate(batches, 1):
            loss, grads = self.gradients(x, y, mask)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = (g * min(1.0, 1.0 / max(norm, 1e-9))).astype(np.float32)
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                self.p[k] -= rate * (1 - 0.9 * min(1.0, i / steps)) * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-8)
            losses.append(loss)
        return losses
