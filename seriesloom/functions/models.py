"""Forecasting models on lag windows, in NumPy: fit on (X, y), predict on X. One task fits one model of one series.

The registry names eleven models with their selected settings; ``make`` builds one.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np

SEED = 2026


class OutOfTime(TimeoutError):
    """A fit or a prediction went on beyond its limit."""


class Deadline:
    """Seconds that a piece of work may take from now on; none without a limit."""

    def __init__(self, seconds: float | None = None) -> None:
        self.ends = None if seconds is None else time.monotonic() + seconds
        self.seconds = seconds

    def check(self) -> None:
        if self.ends is not None and time.monotonic() > self.ends:
            raise OutOfTime(f"beyond {self.seconds} s")


#: What a model without a limit is given.
NO_LIMIT = Deadline()


class Model(Protocol):
    def fit(self, x: np.ndarray, y: np.ndarray) -> None: ...

    def predict(self, x: np.ndarray) -> np.ndarray: ...


@dataclass
class Constant:
    """Zero, or the mean of what it was fitted on."""

    use_mean: bool = False
    value: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.value = float(y.mean()) if self.use_mean and len(y) else 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


@dataclass
class RidgeLag:
    """Linear in the window, squared coefficients penalised, the intercept not."""

    alpha: float = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mx, self.my = x.mean(axis=0), y.mean()
        c = x - self.mx
        self.w = np.linalg.solve(c.T @ c + self.alpha * np.eye(x.shape[1]), c.T @ (y - self.my))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mx) @ self.w + self.my


@dataclass
class EchoState:
    """Leaky reservoir run from rest over each window; the last state and a one are read out by penalised least squares.
    Windows, states and readout are single precision, the recurrence and the fit double.

    ``gains``: the factor on the recurrent part goes from the first to the second along the window.
    """

    size: int = 160
    radius: float = 0.92
    scale: float = 0.12
    leak: float = 0.9
    ridge: float = 1e-3
    gains: tuple[float, float] = (1.0, 1.0)
    seed: int = SEED

    def _build(self) -> None:
        rng = np.random.RandomState(self.seed)
        self.win = (rng.rand(self.size) - 0.5) * 2 * self.scale
        w = (rng.rand(self.size, self.size) - 0.5) * 2
        self.w = w * (self.radius / max(np.abs(np.linalg.eigvals(w)).max(), 1e-12))

    def _states(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32).astype(float)
        h = np.zeros((len(x), self.size))
        steps = x.shape[1]
        first, last = self.gains
        for t in range(steps):
            getattr(self, "deadline", NO_LIMIT).check()
            gain = first * (last / first) ** (t / max(steps - 1, 1))
            h = (1 - self.leak) * h + self.leak * np.tanh(x[:, t, None] * self.win + gain * (h @ self.w.T))
        return np.hstack([h, np.ones((len(x), 1))]).astype(np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self._build()
        s = self._states(x).astype(float)
        self.out = np.linalg.solve(s.T @ s + self.ridge * np.eye(s.shape[1]), s.T @ y.astype(np.float32)).astype(np.float32)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (self._states(x) @ self.out).astype(float)


@dataclass
class LogisticNet:
    """States that follow a logistic map whose rate the input steers within bounds; only the linear readout learns."""

    size: int = 64
    beta: float = 0.08
    rates: tuple[float, float] = (3.55, 3.8)
    ridge: float = 1e-3
    seed: int = SEED

    def _states(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        a, b = rng.normal(0, 1, self.size), rng.normal(0, 0.5, self.size)
        h = np.full((len(x), self.size), 0.5)
        z = (x - self.mean) / self.sd
        for t in range(x.shape[1]):
            getattr(self, "deadline", NO_LIMIT).check()
            r = self.rates[0] + (self.rates[1] - self.rates[0]) / (1 + np.exp(-(z[:, t, None] * a + b)))
            h = (1 - self.beta) * h + self.beta * r * h * (1 - h)
        return np.hstack([h, np.ones((len(x), 1))])

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.sd = x.mean(), max(x.std(), 1e-12)
        s = self._states(x)
        self.out = np.linalg.solve(s.T @ s + self.ridge * np.eye(s.shape[1]), s.T @ y)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._states(x) @ self.out


@dataclass
class Trained:
    """Gradient training by Adam on mean squared error, with a held-out tail for early stopping; best weights stay.

    ``trace`` has the mean loss of every epoch on what it learns from and on the tail, and why the training ended.
    A ``deadline`` set before the fit is checked before every batch.
    """

    epochs: int = 30
    patience: int = 5
    batch: int = 128
    rate: float = 1e-3
    seed: int = SEED
    params: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, width: int, rng: np.random.Generator) -> None:
        raise NotImplementedError

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, object]:
        raise NotImplementedError

    def backward(self, cache: object, grad: np.ndarray) -> dict[str, np.ndarray]:
        raise NotImplementedError

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(self.seed)
        self.mx, self.sx, self.my, self.sy = x.mean(), max(x.std(), 1e-12), y.mean(), max(y.std(), 1e-12)
        z, t = ((x - self.mx) / self.sx).astype(np.float32), ((y - self.my) / self.sy).astype(np.float32)
        held = max(1, len(z) // 5)
        zt, tt, zv, tv = z[:-held], t[:-held], z[-held:], t[-held:]
        self.start(x.shape[1], rng)
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        s = {k: np.zeros_like(v) for k, v in self.params.items()}
        best, kept, bad, step = np.inf, None, 0, 0
        deadline = getattr(self, "deadline", NO_LIMIT)
        self.trace: dict = {"train_loss": [], "val_loss": [], "stop_reason": "epochs"}
        for _ in range(self.epochs):
            order, total = rng.permutation(len(zt)), 0.0
            for at in range(0, len(order), self.batch):
                deadline.check()
                pick = order[at : at + self.batch]
                out, cache = self.forward(zt[pick])
                total += float(((out - tt[pick]) ** 2).sum())
                step += 1
                for k, g in self.backward(cache, (out - tt[pick]) * np.float32(2 / len(pick))).items():
                    m[k] = np.float32(0.9) * m[k] + np.float32(0.1) * g
                    s[k] = np.float32(0.999) * s[k] + np.float32(0.001) * g * g
                    self.params[k] -= np.float32(self.rate / (1 - 0.9**step)) * m[k] / (np.sqrt(s[k] / np.float32(1 - 0.999**step)) + np.float32(1e-8))
            loss = float(((self.forward(zv)[0] - tv) ** 2).mean())
            self.trace["train_loss"].append(total / max(len(zt), 1))
            self.trace["val_loss"].append(loss)
            if loss < best - 1e-9:
                best, kept, bad = loss, {k: v.copy() for k, v in self.params.items()}, 0
            else:
                bad += 1
                if bad >= self.patience:
                    self.trace["stop_reason"] = "patience"
                    break
        self.params = kept or self.params

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(((x - self.mx) / self.sx).astype(np.float32))[0].astype(float) * self.sy + self.my


@dataclass
class Perceptron(Trained):
    """Dense layers; the activation is a rectifier or, with ``chaos``, one step of the logistic map."""

    hidden: tuple[int, ...] = (128, 64)
    chaos: float | None = None

    def start(self, width: int, rng: np.random.Generator) -> None:
        sizes = [width, *self.hidden, 1]
        self.params = {}
        for i, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
            bound = 1 / np.sqrt(a)
            self.params[f"w{i}"], self.params[f"b{i}"] = rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)

    def _act(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.chaos is None:
            return np.maximum(u, 0), (u > 0).astype(u.dtype)
        t = np.tanh(u)
        v = (t + 1) / 2
        return 2 * self.chaos * v * (1 - v) - 1, self.chaos * (1 - 2 * v) * (1 - t * t)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, object]:
        cache, h, last = [], x, len(self.hidden)
        for i in range(last):
            a, slope = self._act(h @ self.params[f"w{i}"] + self.params[f"b{i}"])
            cache.append((h, slope))
            h = a
        return (h @ self.params[f"w{last}"] + self.params[f"b{last}"])[:, 0], (cache, h)

    def backward(self, cache: object, grad: np.ndarray) -> dict[str, np.ndarray]:
        layers, h = cache
        g, out, last = grad[:, None], {}, len(self.hidden)
        out[f"w{last}"], out[f"b{last}"] = h.T @ g, g.sum(axis=0)
        g = g @ self.params[f"w{last}"].T
        for i in range(last - 1, -1, -1):
            h, slope = layers[i]
            g = g * slope
            out[f"w{i}"], out[f"b{i}"] = h.T @ g, g.sum(axis=0)
            g = g @ self.params[f"w{i}"].T
        return out


@dataclass
class Lstm(Trained):
    """One recurrent layer of gated cells over the window and a linear head; ``chaos`` starts weights from a logistic map."""

    size: int = 32
    chaos: float | None = None
    epochs: int = 40
    patience: int = 6

    def start(self, width: int, rng: np.random.Generator) -> None:
        n = self.size
        bound = 1 / np.sqrt(n)
        w = rng.uniform(-bound, bound, (1 + n, 4 * n))
        if self.chaos is not None:
            x, flat = 0.37, np.empty(w.size)
            for i in range(w.size):
                x = self.chaos * x * (1 - x)
                flat[i] = x
            w = (2 * flat.reshape(w.shape) - 1) * np.sqrt(6 / (1 + 5 * n))
        self.params = {"w": w, "b": np.zeros(4 * n), "v": rng.uniform(-bound, bound, (n, 1)), "c": np.zeros(1)}

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, object]:
        n = self.size
        h = c = np.zeros((len(x), n), x.dtype)
        steps, w, b = [], self.params["w"], self.params["b"]
        for t in range(x.shape[1]):
            u = h @ w[1:]
            u += x[:, t, None] * w[0]
            u += b
            gates = 1 / (1 + np.exp(-u[:, : 3 * n]))
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            g = np.tanh(u[:, 3 * n :])
            steps.append((x[:, t], h, i, f, o, g, c))
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            steps[-1] += (tc,)
        return (h @ self.params["v"] + self.params["c"])[:, 0], (steps, h)

    def backward(self, cache: object, grad: np.ndarray) -> dict[str, np.ndarray]:
        steps, h = cache
        g0 = grad[:, None]
        out = {"v": h.T @ g0, "c": g0.sum(axis=0), "w": np.zeros_like(self.params["w"]), "b": np.zeros_like(self.params["b"])}
        dh, dc = g0 @ self.params["v"].T, 0.0
        w = self.params["w"][1:].T
        for x, before_h, i, f, o, g, before, tc in reversed(steps):
            dc = dc + dh * o * (1 - tc * tc)
            du = np.hstack([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)])
            out["w"][0] += x @ du
            out["w"][1:] += before_h.T @ du
            out["b"] += du.sum(axis=0)
            dh, dc = du @ w, dc * f
        return out


#: Selected settings of each model; fixed values.
REGISTRY: dict[str, Callable[[], Model]] = {
    "naive_zero": Constant,
    "naive_mean": lambda: Constant(use_mean=True),
    "ridge_lag": lambda: RidgeLag(alpha=1.0),
    "esn": lambda: EchoState(160, 0.92, 0.12, 0.9, 1e-3),
    "chaotic_esn": lambda: EchoState(128, 1.3, 0.08, 0.7, 5e-4),
    "transient_chaotic_esn": lambda: EchoState(96, 0.95, 0.1, 0.8, 1e-4, gains=(1.3, 0.95)),
    "vanilla_mlp": lambda: Perceptron(hidden=(128, 64)),
    "chaotic_mlp": lambda: Perceptron(hidden=(64, 32), chaos=3.8),
    "chaotic_logistic_net": lambda: LogisticNet(64, 0.08, (3.55, 3.8)),
    "lstm_forecast": lambda: Lstm(size=32),
    "chaotic_lstm_forecast": lambda: Lstm(size=64, chaos=3.9),
}


def n_parameters(model: Model) -> int:
    """How many numbers a fitted model learned."""
    if isinstance(model, Trained):
        return int(sum(v.size for v in model.params.values()))
    return int(np.size(getattr(model, "out", getattr(model, "w", ())))) + isinstance(model, RidgeLag) + (isinstance(model, Constant) and model.use_mean)


def make(name: str, **settings) -> Model:
    model = REGISTRY[name]()
    for k, v in settings.items():
        if not hasattr(model, k):
            raise ValueError(f"{name} has no setting {k}")
        setattr(model, k, v)
    return model
