"""Singular values and right singular vectors of a small square matrix by way of its bidiagonal form.

Householder reflections make the matrix bidiagonal, differential quotient-difference steps with shifts (dqds) give its singular values
with small relative errors, and twisted factorizations of the shifted Gram matrix give a vector for each. Vectors of values that
lie close together are made orthogonal to each other; where a value repeats, inverse iteration fills up the space.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
TINY = np.finfo(float).tiny
#: Values nearer than this, relatively, are treated as a group.
CLOSE = 1e-3


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and upper diagonal of U'AW, and the orthogonal W."""
    a = np.array(matrix, float)
    size = len(a)
    right = np.eye(size)
    for k in range(size):
        _reflect(a[k:, k:], a[k:, k])
        if k < size - 2:
            v = _reflect(a[k:, k + 1 :].T, a[k, k + 1 :])
            if v is not None:
                right[:, k + 1 :] -= np.outer(right[:, k + 1 :] @ v, 2 * v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _reflect(block: np.ndarray, column: np.ndarray) -> np.ndarray | None:
    """Apply in place the reflection that turns ``column`` into a multiple of its first unit vector."""
    scale = np.abs(column).max(initial=0.0)
    if scale == 0 or not np.abs(column[1:]).any():
        return None
    v = column / scale
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    v /= np.linalg.norm(v)
    block -= np.outer(2 * v, v @ block)
    return v


def _step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """One dqds transform; False if the shift was beyond the smallest value."""
    n = len(q)
    new_q, new_e = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    for k in range(n - 1):
        new_q[k] = d + e[k]
        if d < 0 or new_q[k] <= 0:
            return q, e, False
        t = q[k + 1] / new_q[k]
        new_e[k] = e[k] * t
        d = d * t - shift
    new_q[-1] = d
    return new_q, new_e, d >= 0


def squared_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, largest first."""
    found: list[float] = []
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(upper).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(diagonal))
    work = [((diagonal / scale) ** 2, (upper / scale) ** 2, 0.0)]
    while work:
        q, e, moved = work.pop()
        stuck = 0
        while len(q) > 1:
            small = e <= EPS * EPS * np.minimum(q[:-1], q[1:]) + TINY
            small |= e <= EPS * EPS * moved
            if small.any():
                at = int(np.flatnonzero(small)[-1])
                work.append((q[: at + 1], e[:at], moved))
                q, e = q[at + 1 :], e[at + 1 :]
                continue
            if q[0] * 1.5 < q[-1]:
                q, e = q[::-1].copy(), e[::-1].copy()
            # The least eigenvalue of the last two rows bounds the least of all from above; a failed shift is cut down.
            mid, corner, product = q[-2] + e[-1], q[-1], e[-1] * q[-1]
            half = (mid - corner) / 2
            shift = max(0.0, corner - product / (half + np.copysign(np.hypot(half, np.sqrt(product)), half))) if half or product else corner
            shift *= 1 - 8 * EPS
            done = False
            for cut in (1.0, 0.9, 0.5, 0.1, 0.0):
                if stuck > 30 and cut:
                    continue
                new_q, new_e, done = _step(q, e, shift * cut)
                if done:
                    q, e, moved = new_q, new_e, moved + shift * cut
                    break
            if not done:
                # Only a zero pivot stops a step without shift: the row is split off.
                q, e = q + TINY, e
            stuck += 1
        found += [moved + float(x) for x in q]
    return np.sort(np.array(found))[::-1] * scale * scale


def _twisted(d: np.ndarray, l: np.ndarray, value: float, floor: float) -> np.ndarray:
    """Vector of the twisted factorization of LDL' - value that has the smallest twist pivot; d, l from the bidiagonal form."""
    n = len(d)
    up, low, s, p = np.empty(n), np.empty(n), np.empty(n), np.empty(n)
    lead, tail = np.empty(n - 1), np.empty(n - 1)
    s[0] = -value
    for i in range(n - 1):
        up[i] = s[i] + d[i]
        if abs(up[i]) < floor:
            up[i] = -floor
        lead[i] = d[i] * l[i] / up[i]
        s[i + 1] = lead[i] * l[i] * s[i] - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        low[i + 1] = d[i] * l[i] * l[i] + p[i + 1]
        if abs(low[i + 1]) < floor:
            low[i + 1] = -floor
        t = d[i] / low[i + 1]
        tail[i] = l[i] * t
        p[i] = p[i + 1] * t - value
    twist = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -lead[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -tail[i] * z[i]
    return z / np.linalg.norm(z)


def _solve(diagonal: np.ndarray, off: np.ndarray, b: np.ndarray, floor: float) -> np.ndarray:
    """A tridiagonal system, with row exchanges."""
    n = len(diagonal)
    a, c, c2, x = diagonal.copy(), np.append(off, 0.0), np.zeros(n), b.copy()
    low = off.copy()
    for i in range(n - 1):
        if abs(low[i]) > abs(a[i]):
            a[i], low[i] = low[i], a[i]
            c[i], a[i + 1] = a[i + 1], c[i]
            c2[i], c[i + 1] = c[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        a[i] = a[i] if abs(a[i]) > floor else floor
        f = low[i] / a[i]
        a[i + 1] -= f * c[i]
        c[i + 1] -= f * c2[i]
        x[i + 1] -= f * x[i]
    a[-1] = a[-1] if abs(a[-1]) > floor else floor
    for i in range(n - 1, -1, -1):
        x[i] = (x[i] - (c[i] * x[i + 1] if i + 1 < n else 0.0) - (c2[i] * x[i + 2] if i + 2 < n else 0.0)) / a[i]
    return x


def _orthogonal(z: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, float]:
    for _ in range(2):
        for o in others:
            z = z - (o @ z) * o
    size = float(np.linalg.norm(z))
    return (z / size if size else z), size


def right_vectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values, largest first, and the right singular vectors as columns."""
    size = len(matrix)
    diagonal, upper, right = bidiagonalise(matrix)
    values = squared_values(diagonal, upper)
    top = values[0] if size else 0.0
    if size < 2 or top == 0:
        return values, right
    floor = EPS * EPS * top
    safe = np.where(np.abs(diagonal) < np.sqrt(floor), np.sqrt(floor), diagonal)
    d, l = safe[:] ** 2, upper / safe[:-1]
    on = diagonal**2 + np.concatenate([[0.0], upper**2])
    off = diagonal[:-1] * upper
    found: list[np.ndarray] = []
    group: list[np.ndarray] = []
    rng = np.random.default_rng(0)
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLOSE * values[k - 1] and values[k - 1] - value > 64 * EPS * top:
            group = []
        z, left = _orthogonal(_twisted(d, l, value, floor), group)
        error = np.linalg.norm(on * z + np.append(off * z[1:], 0) + np.append(0, off * z[:-1]) - value * z)
        if left < 0.5 or error > 64 * EPS * top:
            z, _ = _orthogonal(z if left > 1e-3 else rng.standard_normal(size), group)
            for _ in range(4):
                z, _ = _orthogonal(_solve(on - value, off, z, EPS * top), group)
        group.append(z)
        found.append(z)
    return values, right @ np.stack(found, 1)
