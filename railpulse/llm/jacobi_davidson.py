"""Block Jacobi-Davidson for the largest eigenpairs of a symmetric matrix that is only known by its products.

``largest`` is the driver's side: it holds the search space (as many columns as
``max_basis``, each as long as a vector has dimensions) and asks ``product`` for the
matrix times a block of columns. Each such call is one pass over the data, so all
wanted pairs advance together:

1. Rayleigh-Ritz in the search space; leading pairs whose residual has reached
   double precision are locked and leave the search space.
2. For each pair still wanted the projected correction equation
   ``(I - PP')(V - theta I)(I - PP') t = -r`` is solved roughly by MINRES, where P holds
   the locked vectors and the Ritz vectors at work. The inner iterations of all pairs
   go in step: one product serves all of them.
3. The corrections, made orthogonal, enlarge the space. A space that would grow beyond
   ``max_basis`` is first cut back to its leading Ritz vectors.

At the end the locked vectors go through one more Rayleigh-Ritz step on a fresh
product, and their residuals are checked again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

EPS = np.finfo(np.float64).eps


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal base of what ``block`` has outside the columns of ``against``; dependent columns go."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        for known in against:
            block = block - known @ (known.T @ block)
        block, r = np.linalg.qr(block)
        block = block[:, np.abs(np.diag(r)) > 1e-10]
    for known in against:  # what dropping columns left
        block = block - known @ (known.T @ block)
    return np.linalg.qr(block)[0] if block.shape[1] else block


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, rtol: float) -> np.ndarray:
    """MINRES from zero for the columns of ``b`` in step; a column stops moving when its residual fell by ``rtol``."""
    n, k = b.shape
    x = np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    goal = rtol * beta
    v_old, v = np.zeros_like(b), b / np.where(beta > 0, beta, 1)
    d_old, d = np.zeros_like(b), np.zeros_like(b)
    c_old, s_old, c, s = np.ones(k), np.zeros(k), np.ones(k), np.zeros(k)
    rest, link = beta.copy(), np.zeros(k)
    alive = beta > 0
    for _ in range(steps):
        if not alive.any():
            break
        w = apply(v) - link * v_old
        alpha = np.sum(v * w, axis=0)
        w = w - alpha * v
        link_next = np.linalg.norm(w, axis=0)
        # the column of the tridiagonal matrix through the last two rotations
        eps_ = s_old * link
        delta = c_old * link
        over = c * delta + s * alpha
        gamma_bar = -s * delta + c * alpha
        gamma = np.hypot(gamma_bar, link_next)
        safe = np.where(gamma > 0, gamma, 1)
        c_new, s_new = gamma_bar / safe, link_next / safe
        d_new = (v - over * d - eps_ * d_old) / safe
        move = alive & (gamma > 0)
        x = x + np.where(move, c_new * rest, 0) * d_new
        rest = np.where(move, -s_new * rest, rest)
        alive = move & (np.abs(rest) > goal) & (link_next > EPS * np.abs(alpha))
        c_old, s_old, c, s = c, s, c_new, s_new
        d_old, d = d, d_new
        v_old, v = v, w / np.where(link_next > 0, link_next, 1)
        link = link_next
    return x


def largest(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, *, inner: int = 6, max_basis: int | None = None, max_outer: int = 200, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Values (falling) and vectors (columns) of the ``wanted`` largest eigenpairs, residuals at double precision.

    A residual counts as double precision at ``8 * sqrt(dims) * eps`` times the largest value.
    ArithmeticError if ``max_outer`` rounds don't get there.
    """
    wanted = min(wanted, dims)
    if wanted == 0:
        return np.empty(0), np.empty((dims, 0))
    room = min(dims, max(max_basis or 4 * wanted, 2 * wanted + 8))
    rng = np.random.default_rng(seed)
    locked, values = np.empty((dims, 0)), np.empty(0)
    basis = _orthonormal(rng.standard_normal((dims, min(dims, wanted + min(8, wanted)))))
    image = product(basis)
    for _ in range(max_outer):
        h = basis.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, mapped = basis @ y, image @ y
        top = max(np.abs(np.concatenate([values, theta])).max(), np.finfo(float).tiny)
        left = wanted - locked.shape[1]
        at_work = min(left, len(theta))
        residual = mapped - ritz * theta
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        tolerance = 8 * np.sqrt(dims) * EPS * top
        done = 0
        while done < at_work and size[done] <= tolerance:
            done += 1
        if done:
            locked, values = np.hstack([locked, ritz[:, :done]]), np.concatenate([values, theta[:done]])
            basis, image, theta, residual, size = ritz[:, done:], mapped[:, done:], theta[done:], residual[:, done:], size[done:]
            if locked.shape[1] >= wanted:
                break
        else:
            basis, image = ritz, mapped
        at_work = min(wanted - locked.shape[1], len(theta))
        known = np.hstack([locked, basis[:, :at_work]])
        outside = lambda z, p=known: z - p @ (p.T @ z)
        open_ = np.flatnonzero(size[:at_work] > tolerance)
        shift = theta[open_]

        def shifted(z, shift=shift, outside=outside):
            z = outside(z)
            return outside(product(z) - z * shift)

        corrections = minres(shifted, -outside(residual[:, open_]), inner, 0.05) if len(open_) else np.empty((dims, 0))
        if basis.shape[1] + corrections.shape[1] > room - locked.shape[1]:
            keep = min(basis.shape[1], max(at_work + 8, room - locked.shape[1] - corrections.shape[1]))
            basis, image = basis[:, :keep], image[:, :keep]
        new = _orthonormal(corrections, locked, basis)
        if new.shape[1] == 0 and locked.shape[1] + basis.shape[1] < dims:  # nothing new: a fresh direction
            new = _orthonormal(rng.standard_normal((dims, 1)), locked, basis)
        if new.shape[1] == 0:
            image = product(basis)  # the space is whole: what remains is rounding
        else:
            basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
    else:
        raise ArithmeticError(f"{locked.shape[1]} of {wanted} pairs after {max_outer} rounds")
    locked = _orthonormal(locked)
    image = product(locked)
    h = locked.T @ image
    values, y = np.linalg.eigh((h + h.T) / 2)
    values, vectors, mapped = values[::-1], locked @ y[:, ::-1], image @ y[:, ::-1]
    worst = np.linalg.norm(mapped - vectors * values, axis=0).max()
    if worst > 4 * tolerance:
        raise ArithmeticError(f"a residual of {worst} against {tolerance}")
    return values, vectors
