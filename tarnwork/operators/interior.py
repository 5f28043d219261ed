"""Linear support vector regression by an interior-point method that only needs sums over rows.

0.5 |w|^2 + c * sum(max(0, |error| - epsilon)) has one minimum. A pass asks every part of the rows for sums and largest values; what
it holds of a row follows from the row and the steps so far, so a part can be an array in a task or a piece of a table on any executor.
Some 15 to 30 rounds of three passes do, for any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Generator

import numpy as np

#: Where rounds end: a duality gap of such a share of the minimum. Weights count as converged up to the second.
AIM, ENOUGH = 1e-11, 1e-9
#: Rounds without a smaller gap, after which rounding leaves nothing to gain.
STUCK = 5


class Part:
    """Rows with an intercept column; above and below the tube (axis 0) the slack, its distance to the error beyond epsilon, and their multipliers."""

    def __init__(self, x: np.ndarray, y: np.ndarray, c: float, epsilon: float):
        self.a, self.y, self.c, self.epsilon, self.done = np.concatenate([x, np.ones((len(x), 1))], axis=1), y, c, epsilon, 0

    def moved(self, along: np.ndarray, barrier: float, first: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Changes of multiplier, slack and distance with weights that move such that errors change by along; first: those of the predictor, for terms of second order."""
        u, z, p, s = self.u, self.z, self.p, self.s
        at_p, at_s = (0.0, 0.0) if first is None else (first[0] * first[2], -first[0] * first[1])
        du = (barrier * (z - u) + u * z * (s - p + np.stack([along, -along])) - z * at_p + u * at_s) / (z * p + u * s)
        ds = (barrier + s * du - at_s) / z - s
        return du, ds, ds - np.stack([along, -along])

    def follow(self, barrier: float, past: list) -> None:
        """From the start with this barrier, take the steps that are still missing."""
        if not self.done:
            self.error = -self.y
            t = np.stack([self.error, -self.error]) - self.epsilon
            root = np.sqrt((self.c * t) ** 2 + 4 * barrier * barrier)
            # the two roots without cancellation: s solves c s^2 - (c t + 2 barrier) s + barrier t = 0, p = s - t
            far = (self.c * np.abs(t) + 2 * barrier + root) / (2 * self.c)
            near = barrier / (self.c - barrier / far)
            self.s, self.p = np.where(t > 0, far, near), np.where(t > 0, near, far)
            self.u, self.z, self.done = barrier / self.p, barrier / self.s, 1
        for predictor, step, lower, share in past[self.done - 1 :]:
            along = self.a @ step
            du, ds, dp = self.moved(along, lower, self.moved(self.a @ predictor, 0.0))
            self.u, self.z, self.p, self.s, self.error = self.u + share * du, self.z - share * du, self.p + share * dp, self.s + share * ds, self.error + share * along
        self.done = len(past) + 1

    def reach(self, du: np.ndarray, ds: np.ndarray, dp: np.ndarray) -> float:
        """The inverse of the longest step that keeps all positive."""
        return max(0.0, (-du / self.u).max(), (du / self.z).max(), (-dp / self.p).max(), (-ds / self.s).max())

    def begin(self) -> tuple[np.ndarray, list[float]]:
        return np.array([len(self.y), np.abs(self.y).sum()]), [0.0]

    def system(self) -> tuple[np.ndarray, list[float]]:
        u, z, p, s = self.u, self.z, self.p, self.s
        under, beta = z * p + u * s, u[0] - u[1]
        fixed, per_barrier = u * z * (s - p) / under, (z - u) / under
        sums = np.stack([beta, fixed[0] - fixed[1], per_barrier[0] - per_barrier[1]]) @ self.a
        loss = np.maximum(np.abs(self.error) - self.epsilon, 0).sum()
        matrix = (self.a * (u * z / under).sum(axis=0)[:, None]).T @ self.a
        return np.concatenate([[(u * p + z * s).sum(), loss, beta @ self.y, np.abs(beta).sum()], sums.ravel(), matrix.ravel()]), [0.0]

    def predictor(self, step: np.ndarray) -> tuple[np.ndarray, list[float]]:
        du, ds, dp = self.moved(self.a @ step, 0.0)
        second = -du * (self.z * dp + self.u * ds) / (self.z * self.p + self.u * self.s)
        return np.concatenate([[(du * (dp - ds)).sum()], (second[0] - second[1]) @ self.a]), [self.reach(du, ds, dp)]

    def tries(self, step: np.ndarray, steps: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, list[float]]:
        first = self.moved(self.a @ step, 0.0)
        return np.zeros(1), [self.reach(*self.moved(self.a @ d, lower, first)) for d, lower in steps]

    def answer(self, barrier: float, past: list, ask: str, given: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Sums and largest values of one pass."""
        with np.errstate(all="ignore"):
            if barrier:
                self.follow(barrier, past)
            sums, most = getattr(self, ask)(*given)
        return sums, np.array(most)


def merged(one: tuple, other: tuple) -> tuple:
    return one[0] + other[0], np.maximum(one[1], other[1])


def rounds(c: float, epsilon: float, passes: int) -> Generator[tuple, tuple, tuple[np.ndarray, float, bool]]:
    """Yields what Part.answer is to be asked and is sent the parts' merged answers; returns weights, intercept and whether they have converged within so many passes."""
    (n, total), _ = yield 0.0, [], "begin", ()
    barrier, past, w, best, since = c * (total / n + epsilon) or c, [], 0.0, (np.inf, np.nan, 0.0), 0
    for _ in range(max(1, passes // 3)):
        sums, _ = yield barrier, past, "system", ()
        left, loss, beta_y, beta_size = sums[:4]
        width = round((-3 + np.sqrt(9 + 4 * (len(sums) - 4))) / 2)
        beta_x, fixed, per_barrier = sums[4 : 4 + 3 * width].reshape(3, width)
        w = np.zeros(width) + w
        # weights that any beta within its limits gives bound the minimum from below
        value = 0.5 * w @ w + c * loss
        gap = value + 0.5 * beta_x @ beta_x + beta_y + epsilon * beta_size
        if not np.isfinite(gap):
            break
        best, since = ((gap, w, value), 0) if gap < best[0] else (best, since + 1)
        if gap <= AIM * value + 1e-15 or since >= STUCK:
            break
        system = np.eye(width) + sums[4 + 3 * width :].reshape(width, width)
        try:
            first = np.linalg.solve(system, -w - beta_x - fixed)
            (cross, *second), (reach,) = yield barrier, past, "predictor", (first,)
            share = min(1.0, 1 / reach) if reach else 1.0
            aim = min(1.0, max(1e-8, (1 - share + share * share * cross / left) ** 3))
            cuts, mean = [min(1.0, aim / 10), aim, min(1.0, aim * 10), 0.1, 0.5], left / (4 * n)
            steps = [(np.linalg.solve(system, -w - beta_x - fixed - second - cut * mean * per_barrier), cut * mean) for cut in cuts]
        except np.linalg.LinAlgError:
            break
        _, reach = yield barrier, past, "tries", (first, steps)
        shares = np.minimum(1.0, 0.99 / np.maximum(reach, 0.99))
        k = int(np.argmin(1 - shares * (1 - np.array(cuts))))
        past = [*past, (first, *steps[k], float(shares[k]))]
        w = w + shares[k] * steps[k][0]
    gap, w, value = best[0], best[1] + np.zeros(width), best[2]
    return w[:-1], float(w[-1]), bool(gap <= ENOUGH * value + 1e-12)


def interior_svr(x: np.ndarray, y: np.ndarray, c: float = 1.0, epsilon: float = 0.05, steps: int = 20_000) -> tuple[np.ndarray, float, bool]:
    """As models.linear_svr, for rows in one task."""
    part = Part(x, y, c, epsilon)
    return solved({0: rounds(c, epsilon, steps)}, lambda asks: {0: part.answer(*asks[0])})[0]


def solved(running: dict[int, Generator], answers: Callable[[dict[int, tuple]], dict[int, tuple]]) -> dict[int, tuple[np.ndarray, float, bool]]:
    """What each of the running rounds returns; answers gets the questions of all that still run at once."""
    asks, done = {k: next(g) for k, g in running.items()}, {}
    while asks:
        got, more = answers(asks), {}
        for k in asks:
            try:
                more[k] = running[k].send(got[k])
            except StopIteration as end:
                done[k] = end.value
        asks = more
    return done
