"""Dense linear algebra for one model: guards, splines, principal components. NumPy only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Methods of treating missing cells by number: rows cut off at either end, and what is filled. Fixed values.
METHODS = {1: ("none", "smooth"), 2: ("sparse", "fill"), 3: ("sparse", "none"), 4: ("empty", "fill"), 5: ("none", "fill")}
SPARSE = 0.8


def symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def real(a: np.ndarray) -> np.ndarray:
    return np.real(a) if np.iscomplexobj(a) else a


def clean(a: np.ndarray, fill: float = 0.0, diagonal: float | None = None) -> np.ndarray:
    """Non-finite entries become ``fill``; on the diagonal ``diagonal`` if given."""
    out = np.where(np.isfinite(a), a, fill)
    if diagonal is not None and a.ndim == 2:
        i = np.flatnonzero(~np.isfinite(np.diag(a)))
        out[i, i] = diagonal
    return out


def positive(a: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """Symmetric, with a ridge that lifts the smallest eigenvalue to ``least``."""
    a = symmetric(real(a))
    low = float(np.linalg.eigvalsh(a)[0]) if len(a) else least
    return a if low >= least else a + (least - low) * np.eye(len(a))


def cap_eigenvalues(a: np.ndarray, most: float = 1e6) -> np.ndarray:
    top = float(np.abs(np.linalg.eigvalsh(symmetric(a))).max(initial=0.0))
    return a * (most / top) if top > most else a


def spectral_radius(a: np.ndarray) -> float:
    return float(np.abs(np.linalg.eigvals(a)).max(initial=0.0))


def clip_ar(rho: np.ndarray | float, low: float = -0.99, high: float = 0.99) -> np.ndarray:
    return np.clip(np.nan_to_num(rho), low, high)


def regularisation(a: np.ndarray, scale: float = 1e-5, least: float = 1e-8) -> float:
    return max(float(np.trace(a)) * scale, least)


def solve(a: np.ndarray, b: np.ndarray, scale: float | None = 1e-5, least: float = 1e-8, acted: Callable[[], None] | None = None) -> np.ndarray:
    """``a x = b`` for a symmetric ``a``: a ridge if it is ill-conditioned, the pseudo-inverse if it is singular.

    Without ``scale`` there is no ridge. ``acted`` is called when either guard is needed.
    """
    cond = np.linalg.cond(a) if np.isfinite(a).all() else np.inf
    if cond > 1e8 and acted is not None:
        acted()
    if cond > 1e12:
        return np.linalg.pinv(clean(a)) @ clean(b)
    if cond > 1e8 and scale is not None:
        a = a + regularisation(a, scale, least) * np.eye(len(a))
    return np.linalg.solve(a, b)


def log_det(a: np.ndarray) -> float:
    sign, value = np.linalg.slogdet(a)
    return float(value) if sign > 0 else float("nan")


def stationary_covariance(a: np.ndarray, q: np.ndarray, fallback: float = 0.1) -> np.ndarray:
    """V with V = A V A' + Q, by the Kronecker system; ``fallback`` I if it has no good solution."""
    n = len(a)
    try:
        v = np.linalg.solve(np.eye(n * n) - np.kron(a, a), q.ravel()).reshape(n, n)
    except np.linalg.LinAlgError:
        return fallback * np.eye(n)
    v = symmetric(v)
    return v if np.isfinite(v).all() and np.linalg.eigvalsh(v)[0] > -1e-8 else fallback * np.eye(n)


def block_diagonal(blocks: list[np.ndarray]) -> np.ndarray:
    rows, columns = sum(b.shape[0] for b in blocks), sum(b.shape[1] for b in blocks)
    out, r, c = np.zeros((rows, columns)), 0, 0
    for b in blocks:
        out[r : r + b.shape[0], c : c + b.shape[1]] = b
        r, c = r + b.shape[0], c + b.shape[1]
    return out


def principal_components(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues by size and their vectors; each vector's first non-zero entry is positive."""
    values, vectors = np.linalg.eigh(symmetric(clean(cov)))
    order = np.argsort(-np.abs(values), kind="stable")[:k]
    values, vectors = values[order], vectors[:, order]
    for j in range(vectors.shape[1]):
        lead = vectors[np.flatnonzero(np.abs(vectors[:, j]) > 1e-12)[:1], j]
        if len(lead) and lead[0] < 0:
            vectors[:, j] *= -1
    return values, vectors


def ols(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Coefficients by row of ``x``; zeros if there is nothing to fit."""
    if len(x) <= x.shape[1]:
        return np.zeros((x.shape[1], y.shape[1]))
    return solve(x.T @ x, x.T @ y)


def constrained_ls(x: np.ndarray, y: np.ndarray, r: np.ndarray, q: np.ndarray, longest: float = 10.0) -> np.ndarray:
    """Least squares under R b = q, cut to a length; unconstrained if the system is singular."""
    g = x.T @ x + 1e-10 * np.eye(x.shape[1])
    b = solve(g, x.T @ y)
    try:
        gr = np.linalg.solve(g, r.T)
        b = b - gr @ np.linalg.solve(r @ gr, r @ b - q)
    except np.linalg.LinAlgError:
        pass
    size = np.linalg.norm(b)
    return b * (longest / size) if size > longest else b


def rotation(cross: np.ndarray) -> np.ndarray:
    """The orthogonal matrix nearest to the cross products estimate' true."""
    u, _, vt = np.linalg.svd(cross, full_matrices=False)
    return u @ vt


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic spline; a parabola through three points, a line through two."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x, y, n - 1), at) if n else np.full(len(at), np.nan)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    system, right = np.zeros((n, n)), np.zeros(n)  # for the slopes at the knots
    i = np.arange(1, n - 1)
    system[i, i - 1], system[i, i], system[i, i + 1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    right[1:-1] = 3 * (h[1:] * slope[:-1] + h[:-1] * slope[1:])
    for end, a, b in ((0, 0, 1), (n - 1, n - 2, n - 3)):
        two = h[a] + h[b]
        near = 1 if end == 0 else n - 2
        system[end, end], system[end, near] = h[b], two
        right[end] = ((h[a] + 2 * two) * h[b] * slope[a] + h[a] ** 2 * slope[b]) / two
    d = np.linalg.solve(system, right)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    u, w = at - x[k], h[k]
    c2 = (3 * slope[k] - 2 * d[k] - d[k + 1]) / w
    c3 = (d[k] + d[k + 1] - 2 * slope[k]) / w**2
    return y[k] + u * (d[k] + u * (c2 + u * c3))


def moving_average(x: np.ndarray, k: int) -> np.ndarray:
    """Centred, over 2 k + 1 values, the ends repeated."""
    wide = np.concatenate([np.full(k, x[0]), x, np.full(k, x[-1])])
    return np.convolve(wide, np.ones(2 * k + 1) / (2 * k + 1), "valid")


def spline_fill(x: np.ndarray, mode: str = "spline", smooth: int = 3) -> np.ndarray:
    """Fill the missing cells of a series from the spline through its values; see the operator."""
    there = np.flatnonzero(np.isfinite(x))
    if not len(there) or len(there) == len(x):
        return x
    out, inside = x.astype(float).copy(), np.arange(there[0], there[-1] + 1)
    if len(there) > 1:
        out[inside] = cubic_spline(there.astype(float), x[there], inside.astype(float))
        out[there] = x[there]
    gaps = ~np.isfinite(x)
    if mode == "median":
        out[gaps] = np.nanmedian(out)
        return out
    if mode == "smooth":
        filled = np.where(np.isfinite(out), out, np.nanmedian(out))
        return np.where(gaps, moving_average(filled, smooth), x)
    if mode != "spline":
        raise ValueError(f"unknown mode {mode!r}")
    edges = ~np.isfinite(out)
    filled = np.where(edges, np.nanmedian(out), out)
    out[edges] = moving_average(filled, smooth)[edges]
    return out


def treated(x: np.ndarray, method: int = 2, smooth: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A T x N panel with its gaps filled as the method says, and which rows lie inside its cut.

    Cells that stay missing are 0, the mean of a standardised panel.
    """
    cut, fill = METHODS[method]
    missing = ~np.isfinite(x)
    full = np.flatnonzero(missing.sum(1) <= {"none": 1.0, "sparse": SPARSE, "empty": 1 - 1e-9}[cut] * x.shape[1])
    inside = np.zeros(len(x), bool)
    if len(full):
        inside[full[0] : full[-1] + 1] = True
    if fill != "none" and len(x):
        x = np.column_stack([spline_fill(c, "smooth" if fill == "smooth" else "spline", smooth) for c in x.T])
    return np.nan_to_num(x, posinf=0.0, neginf=0.0), inside
