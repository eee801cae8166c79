"""Reverse-mode differentiation over NumPy arrays: what the two networks need, and AdamW."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Var:
    """An array, and how its gradient flows to what it was computed from."""

    def __init__(self, value: np.ndarray, parents: tuple[tuple["Var", Callable], ...] = ()) -> None:
        self.value, self.parents, self.grad = np.asarray(value, float), parents, None

    def __add__(self, other: "Var") -> "Var":
        return Var(self.value + other.value, ((self, lambda g: _fit(g, self.value.shape)), (other, lambda g: _fit(g, other.value.shape))))

    def __mul__(self, other: "Var") -> "Var":
        return Var(self.value * other.value, ((self, lambda g: _fit(g * other.value, self.value.shape)), (other, lambda g: _fit(g * self.value, other.value.shape))))

    def __matmul__(self, other: "Var") -> "Var":
        return Var(self.value @ other.value, ((self, lambda g: g @ other.value.T), (other, lambda g: self.value.T @ g)))

    def __getitem__(self, key) -> "Var":
        def back(g: np.ndarray) -> np.ndarray:
            out = np.zeros_like(self.value)
            np.add.at(out, key, g)
            return out

        return Var(self.value[key], ((self, back),))

    def scaled(self, factor) -> "Var":
        return Var(self.value * factor, ((self, lambda g: _fit(g * factor, self.value.shape)),))

    def sigmoid(self) -> "Var":
        y = 1 / (1 + np.exp(-np.clip(self.value, -60, 60)))
        return Var(y, ((self, lambda g: g * y * (1 - y)),))

    def tanh(self) -> "Var":
        y = np.tanh(self.value)
        return Var(y, ((self, lambda g: g * (1 - y * y)),))

    def relu(self) -> "Var":
        return Var(np.maximum(self.value, 0), ((self, lambda g: g * (self.value > 0)),))

    def unit_rows(self, eps: float = 1e-12) -> "Var":
        """Rows divided by their length."""
        n = np.maximum(np.linalg.norm(self.value, axis=1, keepdims=True), eps)
        y = self.value / n
        return Var(y, ((self, lambda g: (g - y * (g * y).sum(1, keepdims=True)) / n),))

    def segment_mean(self, segment: np.ndarray, n: int) -> "Var":
        """Means of the rows of each segment; an empty one is 0."""
        count = np.maximum(np.bincount(segment, minlength=n), 1)[:, None]
        out = np.zeros((n, self.value.shape[1]))
        np.add.at(out, segment, self.value)
        return Var(out / count, ((self, lambda g: (g / count)[segment]),))

    def segment_max(self, segment: np.ndarray, n: int) -> "Var":
        out = np.full((n, self.value.shape[1]), -np.inf)
        np.maximum.at(out, segment, self.value)
        first = self.value == out[segment]
        share = np.zeros_like(out)
        np.add.at(share, segment, first)
        return Var(np.where(np.isfinite(out), out, 0.0), ((self, lambda g: first * (g / np.maximum(share, 1))[segment]),))

    def backward(self, grad: np.ndarray) -> None:
        """Add gradients to every variable that this one was computed from."""
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack.append((v, True))
                stack += [(p, False) for p, _ in v.parents]
        self.grad = grad
        for v in reversed(order):
            for p, back in v.parents:
                g = back(v.grad)
                p.grad = g if p.grad is None else p.grad + g


def _fit(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    while g.ndim > len(shape):
        g = g.sum(0)
    for k, n in enumerate(shape):
        if n == 1 and g.shape[k] != 1:
            g = g.sum(k, keepdims=True)
    return g


def joined(*parts: Var) -> Var:
    """Columns side by side."""
    edges = np.cumsum([0] + [p.value.shape[-1] for p in parts])
    return Var(np.concatenate([p.value for p in parts], -1), tuple((p, lambda g, a=a, b=b: g[..., a:b]) for p, a, b in zip(parts, edges[:-1], edges[1:], strict=True)))


def dropout(x: Var, rate: float, rng: np.random.Generator | None) -> Var:
    return x if rng is None or not rate else x.scaled((rng.random(x.value.shape) >= rate) / (1 - rate))


def logit_loss(logit: Var, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted binary cross-entropy with logits, and its gradient."""
    z, w = logit.value.ravel(), weight / weight.sum()
    loss = np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))
    return float((w * loss).sum()), (w * (1 / (1 + np.exp(-z)) - y)).reshape(logit.value.shape)


class AdamW:
    def __init__(self, parameters: dict[str, Var], rate: float = 1e-3, decay: float = 1e-4, clip: float = 1.0) -> None:
        self.parameters, self.rate, self.decay, self.clip, self.step = parameters, rate, decay, clip, 0
        self.mean = {k: np.zeros_like(v.value) for k, v in parameters.items()}
        self.var = {k: np.zeros_like(v.value) for k, v in parameters.items()}

    def __call__(self) -> None:
        grads = {k: np.zeros_like(v.value) if v.grad is None else v.grad for k, v in self.parameters.items()}
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, self.clip / (norm + 1e-6))
        self.step += 1
        for k, v in self.parameters.items():
            g = grads[k] * scale
            self.mean[k] = 0.9 * self.mean[k] + 0.1 * g
            self.var[k] = 0.999 * self.var[k] + 0.001 * g * g
            v.value = v.value * (1 - self.rate * self.decay) - self.rate * (self.mean[k] / (1 - 0.9**self.step)) / (np.sqrt(self.var[k] / (1 - 0.999**self.step)) + 1e-8)
            v.grad = None
