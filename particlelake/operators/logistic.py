"""Multinomial logistic regressions of several folds fitted in the same passes."""

from __future__ import annotations

from collections.abc import Generator, Sequence

import numpy as np

from particlelake.operators.cluster.stacked import Chunk, Item, Kernel, Packed, Stack, settle, sums

#: Corrections that a step remembers, and function values that must have settled.
MEMORY, HISTORY = 10, 10
#: Probabilities of a slice of rows.
SLICE_VALUES = 1 << 19
TOLERANCE = 1e-6


def _minimum(x: np.ndarray, max_iter: int, tol: float) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS with a Wolfe line search; yields points, takes value and gradient there, returns the last point."""
    f, g = yield x
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    values = [f]
    for _ in range(max_iter):
        if np.linalg.norm(g) <= max(tol * abs(f), 1e-8):
            break
        d, past = -g, []
        for s, y in reversed(pairs):
            past.append((s @ d) / (s @ y))
            d = d - past[-1] * y
        if pairs:
            s, y = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(past)):
            d = d + (a - (y @ d) / (s @ y)) * s
        slope = g @ d
        if slope >= 0:
            pairs, d, slope = [], -g, -(g @ g)
        step, low, high = (1.0 if pairs else 1.0 / np.linalg.norm(d)), 0.0, np.inf
        for _ in range(30):
            after = x + step * d
            value, gradient = yield after
            if not np.isfinite(value) or value > f + 1e-4 * step * slope:
                high = step
            elif gradient @ d < 0.9 * slope:
                low = step
            else:
                break
            step = (low + high) / 2 if high < np.inf else 2 * step
        if not value < f:
            break
        if (after - x) @ (gradient - g) > 0:
            pairs = [*pairs, (after - x, gradient - g)][-MEMORY:]
        x, f, g = after, value, gradient
        values.append(f)
        if max(values[-HISTORY - 1: -1]) - f <= tol * abs(values[0]):
            break
    return x


def _scores(coefficients: np.ndarray, constants: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(rows, models, classes)."""
    models, classes, dims = coefficients.shape
    return (x @ coefficients.reshape(-1, dims).T + constants.reshape(-1)).reshape(len(x), models, classes)


def _loss_sums(params: tuple, samples: np.ndarray, chunk: Chunk) -> np.ndarray:
    """Weighted loss and its gradient over the rows that are not in the fold of a model."""
    coefficients, constants, weights = params
    models, classes, dims = coefficients.shape
    out = np.zeros((models, 1 + classes * (dims + 1)))
    size = max(1, SLICE_VALUES // (models * classes))
    for s in range(0, len(chunk.x), size):
        x, label, fold = chunk.x[s: s + size], chunk.labels[s: s + size, 0], chunk.labels[s: s + size, 1]
        z = _scores(coefficients, constants, x)
        z -= z.max(axis=2, keepdims=True)
        own = np.take_along_axis(z, label[:, None, None], axis=2)[:, :, 0]
        np.exp(z, out=z)
        whole = z.sum(axis=2)
        w = weights[:, label].T * (fold[:, None] != samples)
        out[:, 0] += (w * (np.log(whole) - own)).sum(axis=0)
        z *= (w / whole)[:, :, None]
        z[np.arange(len(x)), :, label] -= w
        out[:, 1: 1 + classes * dims] += (z.reshape(len(x), -1).T @ x).reshape(models, -1)
        out[:, 1 + classes * dims:] += z.sum(axis=0)
    return out


def _recall_sums(params: tuple, samples: np.ndarray, chunk: Chunk) -> np.ndarray:
    """Right rows and rows of each class in the fold of a model."""
    coefficients, constants = params
    classes = coefficients.shape[1]
    out = np.zeros((len(samples), 2 * classes))
    size = max(1, SLICE_VALUES // (len(samples) * classes))
    for s in range(0, len(chunk.x), size):
        label, fold = chunk.labels[s: s + size, 0], chunk.labels[s: s + size, 1]
        best = _scores(coefficients, constants, chunk.x[s: s + size]).argmax(axis=2)
        for i, own in enumerate(samples):
            held = fold == own
            out[i] += np.concatenate([np.bincount(label[held & (best[:, i] == label)], minlength=classes), np.bincount(label[held], minlength=classes)])
    return out


def _square_sums(params: tuple, samples: np.ndarray, chunk: Chunk) -> np.ndarray:
    return (chunk.x * chunk.x).sum(axis=0)[None, :]


class LogisticStack(Stack):
    """One model for each fold that it does not see; -1 is no fold."""

    def __init__(self, folds: Sequence[int], weights: np.ndarray, totals: np.ndarray, regs: np.ndarray, spread: np.ndarray, scaled: bool, max_iter: int, tol: float):
        super().__init__(folds, {}, np.inf, tol)
        models, self.classes = weights.shape
        self.weights, self.totals, self.regs, self.dims = weights, totals, regs, len(spread)
        # steps are taken for values of unit spread, the penalty is on values as they are or also of unit spread
        self.unit = np.divide(1.0, spread, out=np.zeros(len(spread)), where=spread > 0)
        self.penalty = np.ones(len(spread)) if scaled else self.unit**2
        start = np.zeros(self.classes * (self.dims + 1))
        self.searches = [_minimum(start, max_iter, tol) for _ in range(models)]
        self.points = np.array([next(s) for s in self.searches])

    def kernel(self) -> Kernel:
        return _loss_sums

    def split(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.classes * self.dims
        return self.points[chosen, :cut].reshape(len(chosen), self.classes, self.dims), self.points[chosen, cut:]

    def params(self, chosen: np.ndarray) -> tuple:
        steps, constants = self.split(chosen)
        return steps * self.unit, constants, self.weights[chosen]

    def width(self) -> int:
        return 1 + self.classes * (self.dims + 1)

    def absorb(self, chosen: np.ndarray, totals: np.ndarray) -> np.ndarray:
        done = np.zeros(len(chosen), bool)
        for at, (i, total) in enumerate(zip(chosen, totals)):
            (steps,), _ = self.split(np.array([i]))
            loss, gradient = total[0] / self.totals[i], total[1:] / self.totals[i]
            slopes = gradient[: steps.size].reshape(steps.shape) * self.unit + self.regs[i] * self.penalty * steps
            value = loss + 0.5 * self.regs[i] * (self.penalty * steps * steps).sum()
            try:
                self.points[i] = self.searches[i].send((value, np.concatenate([slopes.ravel(), gradient[steps.size:]])))
            except StopIteration as end:
                self.points[i], done[at] = end.value, True
        return done


def logistics(
    packed: Packed, weights: Sequence[np.ndarray], totals: Sequence[float], regs: Sequence[float], scaled: bool, max_iter: int, tol: float = TOLERANCE
) -> tuple[list[float], np.ndarray]:
    """Balanced accuracy on each held-out fold, and the coefficients of a model of all rows.

    ``packed`` has class and fold as labels. ``weights`` are those of the classes without each
    fold, then of all rows, ``totals`` their sums over rows. With ``scaled`` values count in units of their spread.
    """
    folds = [*range(len(weights) - 1), -1]
    squares = sums(packed, [Item(_square_sums, (), np.zeros(1, int))])[0][0]
    spread = np.sqrt(squares / max(packed.rows - 1, 1))
    spread[spread <= 1e-12 * np.abs(packed.centre)] = 0.0
    stack = LogisticStack(folds, np.array(weights), np.array(totals, float), np.array(regs, float), spread, scaled, max_iter, tol)
    settle(packed, [stack])
    steps, constants = stack.split(np.arange(len(folds)))
    item = Item(_recall_sums, (steps[:-1] * stack.unit, constants[:-1]), np.array(folds[:-1]))
    hits, seen = np.hsplit(sums(packed, [item])[0], 2)
    accuracy = [float((h[n > 0] / n[n > 0]).mean()) for h, n in zip(hits, seen)]
    return accuracy, steps[-1] if scaled else steps[-1] * stack.unit
