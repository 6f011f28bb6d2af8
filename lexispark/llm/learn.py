"""Small learners for the driver: they see bounded samples of numeric features only."""

from __future__ import annotations

import numpy as np


class Scaler:
    """Standardises columns; constant ones become zero, and outliers are clipped."""

    def __init__(self, x: np.ndarray, clip: float = 8.0):
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.std = x.std(axis=0) if len(x) else np.ones(x.shape[1])
        self.std[self.std < 1e-9] = np.inf
        self.clip = clip

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -self.clip, self.clip)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Logistic:
    """Weighted logistic regression with an L2 penalty, by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, rounds: int = 40):
        self.scale = Scaler(x)
        a = np.hstack([self.scale(x), np.ones((len(x), 1))])
        self.w = np.zeros(a.shape[1])
        ridge = np.full(a.shape[1], penalty)
        ridge[-1] = 1e-6
        for _ in range(rounds):
            p = sigmoid(a @ self.w)
            grad = a.T @ (weight * (p - y)) + ridge * self.w
            hess = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
            step = np.linalg.solve(hess, grad)
            self.w -= step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.hstack([self.scale(x), np.ones((len(x), 1))]) @ self.w)


class Net:
    """One hidden layer of tanh units; ``fit`` is given the gradient of the risk by the outputs."""

    def __init__(self, scale: Scaler, inputs: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.scale = scale
        self.p = [rng.normal(0, 1 / np.sqrt(inputs), (inputs, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3][0], h

    def step(self, z: np.ndarray, h: np.ndarray, slope: np.ndarray, rate: float, decay: float) -> None:
        dh = slope[:, None] * self.p[2] * (1 - h * h)
        grads = [z.T @ dh + decay * self.p[0], dh.sum(axis=0), h.T @ slope + decay * self.p[2], np.array([slope.sum()])]
        self.t += 1
        for a, g, m, v in zip(self.p, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.forward(self.scale(x))[0])


def pu_slopes(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of a batch's risk by the outputs for positive and unlabelled rows, times their number; see ``fit_nnpu``."""
    # l(g) = log(1 + exp(-g)); its slope is -sigmoid(-g), and that of l(-g) is sigmoid(g)
    if np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean() >= 0:
        return prior * (-sigmoid(-gp) - sigmoid(gp)), sigmoid(gu)
    return prior * sigmoid(gp), -sigmoid(gu)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, epochs: int = 60, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Net:
    """Minimises the non-negative unbiased PU risk with the logistic loss.

    risk = prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]); where the second part of a batch is negative, the
    step goes against it instead (Kiryo et al., 2017).
    """
    scale = Scaler(np.concatenate([positive, unlabelled]))
    zp, zu = scale(positive), scale(unlabelled)
    net, rng = Net(scale, zp.shape[1], hidden, seed), np.random.default_rng(seed + 1)
    rounds = max(1, max(len(zp), len(zu)) // batch)
    rounds, epochs = max(rounds, 8), epochs
    for epoch in range(epochs):
        for _ in range(rounds):
            p, u = zp[rng.integers(0, len(zp), batch)], zu[rng.integers(0, len(zu), batch)]
            z = np.concatenate([p, u])
            g, h = net.forward(z)
            gp, gu = g[:batch], g[batch:]
            net.step(z, h, np.concatenate(pu_slopes(gp, gu, prior)) / batch, rate * (1 - epoch / epochs) + 1e-4, decay)
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, by the best bin of a classifier's scores on held-out rows.

    At every threshold c the ratio of the shares above c bounds the prior from above; the ratio at the threshold with the
    least confidence bound is the estimate (best-bin estimation, Garg et al., 2021).
    """
    sp, su = np.sort(positive), np.sort(unlabelled)
    cuts = np.unique(np.quantile(np.concatenate([sp, su]), np.linspace(0, 0.99, 100)))
    qp = 1 - np.searchsorted(sp, cuts) / len(sp)
    qu = 1 - np.searchsorted(su, cuts) / len(su)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(sp)) + np.sqrt(np.log(4 / delta) / 2 / len(su))
    ok = qp > 0
    bound = (qu[ok] + slack) / qp[ok]
    best = int(np.argmin(bound))
    return float(np.clip(qu[ok][best] / qp[ok][best], 0.01, 0.99))
