"""Iterations over whole graphs in NumPy, to compare the distributed forms with."""

from __future__ import annotations

import numpy as np
import pandas as pd

def chebyshev(c: np.ndarray, e: np.ndarray, up: np.ndarray, down: np.ndarray, start: np.ndarray, damping: float, tolerance: float, most_rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Personalised PageRank of claims and of entities: see `detect.pagerank`; start: each claim's share of the restart."""
    entities = int(e.max(initial=-1)) + 1
    raised = lambda d: np.bincount(e, up * d[c], entities)
    middle, half = 1 - damping**2 / 2, damping**2 / 2
    x, r = np.zeros(len(start)), (1 - damping) * start
    d, rho = r / middle, half / middle
    for _ in range(most_rounds):
        x, r = x + d, r - d + np.bincount(c, down * raised(d)[e], len(start))
        last, rho = rho, 1 / (2 * middle / half - rho)
        d = rho * last * d + 2 * rho / half * r
        if np.abs(r).max() <= tolerance * x.max():
            return x, raised(x)
    raise RuntimeError(f"PageRank has not converged in {most_rounds} rounds")


def push_task(seeds: list, alpha: float, epsilon: float, most_rounds: int):
    """For mapInPandas over all of (v, o, weight): (seed, v, p, r, pushed), see `local_push.local_push`; seeds that have edges."""

    def step(batches):
        frames = list(batches)
        if not frames:
            return
        frame = pd.concat(frames)
        ends, names = pd.factorize(np.concatenate([frame["v"].to_numpy(), frame["o"].to_numpy()]))
        n, half = len(names), len(frame)
        order = np.argsort(ends[:half], kind="stable")
        v, o, weight = ends[:half][order], ends[half:][order], frame["weight"].to_numpy()[order]
        k = np.bincount(v, weight, n)
        many = np.bincount(v, minlength=n)
        k[(k == 0) & (many > 0)] = 1.0
        begin, share = np.cumsum(many) - many, (1 - alpha) * weight / k[v]
        place = {name: i for i, name in enumerate(names)}
        for seed in seeds:
            p, r, pushed, reached = np.zeros(n), np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
            r[place[seed]] = 1.0
            reached[place[seed]] = True
            for _ in range(most_rounds):
                hot = np.flatnonzero(r > epsilon * k)
                if not len(hot):
                    break
                size = many[hot]
                steps = np.repeat(begin[hot] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                spread = np.bincount(o[steps], np.repeat(r[hot], size) * share[steps], n)
                p[hot] += alpha * r[hot]
                r[hot] = 0.0
                r += spread
                pushed[hot] = True
                reached[o[steps]] = True
            else:
                raise RuntimeError(f"residuals are not below the tolerance after {most_rounds} rounds")
            at = np.flatnonzero(reached)
            yield pd.DataFrame({"seed": seed, "v": names[at], "p": p[at], "r": r[at], "pushed": pushed[at]})

    return step
