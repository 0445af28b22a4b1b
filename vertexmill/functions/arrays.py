"""Geometry on numpy arrays, for the solvers that run inside tasks. Leading axes are batches."""

from __future__ import annotations

import numpy as np

#: Columns of a camera row that the functions here take, in order.
CAMERA = ("kind", "fx", "fy", "cx", "cy", "xi", "k1", "k2", "p1", "p2", "k3")
DETECTOR_CORNERS = np.array([(-0.5, 0.5, 0.0), (0.5, 0.5, 0.0), (0.5, -0.5, 0.0), (-0.5, -0.5, 0.0)])


class Lenses:
    """Cameras of batches: values (..., len(CAMERA)) and the registered models that their first number names.

    The first number is 0 for pinhole_radtan, 1 for omni_radtan and 2 + k for
    the k-th of models, pairs of array functions (project, unproject) that take
    arrays (n, 3) or (n, 2) and a dictionary of parameters, each (n,). Arrays
    without such models may stand for themselves.
    """

    def __init__(self, values: np.ndarray, models: tuple = ()):
        self.values, self.models = values, models

    def __getitem__(self, key) -> Lenses:
        return Lenses(self.values[key], self.models)

    def __len__(self) -> int:
        return len(self.values)


def _lens(camera: np.ndarray | Lenses) -> tuple[np.ndarray, tuple]:
    return (camera.values, camera.models) if isinstance(camera, Lenses) else (camera, ())


def _by_model(out: np.ndarray, given: np.ndarray, camera: np.ndarray, models: tuple, which: int) -> np.ndarray:
    """out with what registered models make of given where a camera is theirs."""
    if not models or not (camera[..., 0] > 1).any():
        return out
    kind, shape = np.broadcast_to(camera[..., 0], out.shape[:-1]), out.shape[:-1]
    every = [np.broadcast_to(camera[..., k], shape) for k in range(1, len(CAMERA))]
    given, out = np.broadcast_to(given, (*shape, given.shape[-1])), out.copy()
    for k, model in enumerate(models):
        mine = kind == k + 2
        if mine.any():
            out[mine] = model[which](given[mine], {n: x[mine] for n, x in zip(CAMERA[1:], every, strict=True)})
    return out


def project(points: np.ndarray, camera: np.ndarray | Lenses) -> np.ndarray:
    """Pixels (..., 2) of points (..., 3) in the camera's frame; NaN where not seen."""
    values, models = _lens(camera)
    return _by_model(_project(points, values)[0], points, values, models, 0)


def _project(points: np.ndarray, camera: np.ndarray) -> tuple:
    """Pixels by the built-in models, and what their slopes need."""
    omni, fx, fy, cx, cy, xi, k1, k2, p1, p2, k3 = np.moveaxis(camera, -1, 0)
    length = np.linalg.norm(points, axis=-1)
    depth = points[..., 2] + np.where(omni == 1, xi * length, 0.0)
    seen = (length > 1e-12) & (depth > 1e-12 * np.where(omni == 1, length, 1.0))
    z = np.where(seen, depth, 1.0)
    x, y = points[..., 0] / z, points[..., 1] / z
    r2 = x * x + y * y
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    u = fx * (x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)) + cx
    v = fy * (y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y) + cy
    return np.where(seen[..., None], np.stack([u, v], -1), np.nan), x, y, z, r2, radial, length


def project_slopes(points: np.ndarray, camera: np.ndarray | Lenses) -> tuple[np.ndarray, np.ndarray]:
    """Pixels (..., 2) and their derivatives (..., 2, 3) by the points: in closed form for the built-in models, by central differences for registered ones."""
    values, models = _lens(camera)
    pixels, x, y, z, r2, radial, length = _project(points, values)
    omni, fx, fy, _, _, xi, k1, k2, p1, p2, k3 = np.moveaxis(values, -1, 0)
    depth = np.where(omni == 1, xi / np.where(length > 1e-12, length, 1.0), 0.0)[..., None] * points
    depth[..., 2] += 1.0
    flat = np.stack([x, y], -1)[..., None] * -depth[..., None, :]
    flat[..., 0, 0] += 1.0
    flat[..., 1, 1] += 1.0
    flat /= z[..., None, None]
    grow = 2 * (k1 + r2 * (2 * k2 + 3 * k3 * r2))
    bent = np.stack([
        np.stack([fx * (radial + grow * x * x + 2 * p1 * y + 6 * p2 * x), fx * (grow * x * y + 2 * p1 * x + 2 * p2 * y)], -1),
        np.stack([fy * (grow * x * y + 2 * p1 * x + 2 * p2 * y), fy * (radial + grow * y * y + 6 * p1 * y + 2 * p2 * x)], -1),
    ], -2)
    slopes = bent @ flat
    if models and (values[..., 0] > 1).any():
        pixels = _by_model(pixels, points, values, models, 0)
        for k in range(3):
            h = np.zeros_like(points)
            h[..., k] = 1e-6 * np.maximum(1.0, np.abs(points[..., k]))
            ahead, behind = (_by_model(pixels, points + s, values, models, 0) for s in (h, -h))
            other = np.broadcast_to(values[..., :1] > 1, pixels.shape)
            slopes[..., k] = np.where(other, (ahead - behind) / (2 * h[..., k : k + 1]), slopes[..., k])
    return pixels, slopes


def unproject(pixels: np.ndarray, camera: np.ndarray | Lenses, steps: int = 10) -> np.ndarray:
    """Unit rays (..., 3) of pixels (..., 2): `steps` steps of a fixed-point iteration undo the distortion."""
    ray = rays(pixels, camera, steps)
    n = np.linalg.norm(ray, axis=-1, keepdims=True)
    return np.where(n > 1e-12, ray / np.where(n > 1e-12, n, 1.0), np.nan)


def rays(pixels: np.ndarray, camera: np.ndarray | Lenses, steps: int = 10) -> np.ndarray:
    """The same before they are brought to length one: a pinhole's have z = 1."""
    values, models = _lens(camera)
    omni, fx, fy, cx, cy, xi, k1, k2, p1, p2, k3 = np.moveaxis(values, -1, 0)
    x0, y0 = (pixels[..., 0] - cx) / fx, (pixels[..., 1] - cy) / fy
    x, y = x0, y0
    for _ in range(steps):
        r2 = x * x + y * y
        radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
        dx = x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)
        dy = y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
        x, y = x + x0 - dx, y + y0 - dy
    r2 = x * x + y * y
    alpha = (xi + np.sqrt(np.maximum(0.0, 1 + (1 - xi * xi) * r2))) / (1 + r2)
    one = np.where(omni == 1, alpha, 1.0)
    ray = np.stack([one * x, one * y, np.where(omni == 1, alpha - xi, 1.0)], -1)
    return _by_model(ray, pixels, values, models, 1)


def turn_slopes(r: np.ndarray) -> np.ndarray:
    """(..., 3, 3) matrices J with d(R v) = -[R v] J dr for the rotation R of a rotation vector r."""
    angle = np.linalg.norm(r, axis=-1)[..., None, None]
    K = cross_matrices(r)
    small = angle < 1e-4
    safe = np.where(small, 1.0, angle)
    a = np.where(small, 0.5 - angle**2 / 24, (1 - np.cos(safe)) / safe**2)
    b = np.where(small, 1 / 6 - angle**2 / 120, (safe - np.sin(safe)) / safe**3)
    return np.eye(3) + a * K + b * (K @ K)


def cross_matrices(v: np.ndarray) -> np.ndarray:
    """(..., 3, 3) matrices of the products v x ."""
    K = np.zeros((*v.shape, 3))
    K[..., 0, 1], K[..., 0, 2], K[..., 1, 2] = -v[..., 2], v[..., 1], -v[..., 0]
    return K - np.swapaxes(K, -1, -2)


def rotations(r: np.ndarray) -> np.ndarray:
    """Rotation matrices (..., 3, 3) of rotation vectors (..., 3)."""
    angle = np.linalg.norm(r, axis=-1)[..., None, None]
    K = cross_matrices(r)
    small = angle < 1e-10
    safe = np.where(small, 1.0, angle)
    return np.eye(3) + np.where(small, 1.0, np.sin(safe) / safe) * K + np.where(small, 0.5, (1 - np.cos(safe)) / safe**2) * (K @ K)


def rotation_vectors(R: np.ndarray) -> np.ndarray:
    """Rotation vectors of matrices (n, 3, 3)."""
    skew = np.stack([R[:, 2, 1] - R[:, 1, 2], R[:, 0, 2] - R[:, 2, 0], R[:, 1, 0] - R[:, 0, 1]], -1) / 2
    sin = np.linalg.norm(skew, axis=1)
    cos = np.clip((np.trace(R, axis1=1, axis2=2) - 1) / 2, -1, 1)
    angle = np.arctan2(sin, cos)
    out = skew * np.where(sin > 1e-8, angle / np.maximum(sin, 1e-8), 1.0)[:, None]
    for i in np.flatnonzero((cos < 0) & (sin < 1e-6)):  # near half a turn
        square = (R[i] + np.eye(3)) / 2
        k = int(np.argmax(np.diag(square)))
        axis = square[k] / np.sqrt(square[k, k])
        out[i] = axis / np.linalg.norm(axis) * angle[i]
    return out


def squares_to_poses(flat: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """The two poses (n, 2, 3, 3), (n, 2, 3) of a square marker from its corners (n, 4, 2) on the plane z = 1, in detector order.

    Infinitesimal plane-based pose estimation: the homography's derivative at
    the marker's centre fixes the rotation up to two solutions; translations
    follow by least squares.
    """
    n = len(flat)
    corners = DETECTOR_CORNERS * size
    x, y = corners[:, 0], corners[:, 1]
    u, v = flat[..., 0], flat[..., 1]
    one, zero = np.ones((n, 4)), np.zeros((n, 4))
    X, Y = np.broadcast_to(x, (n, 4)), np.broadcast_to(y, (n, 4))
    rows = np.concatenate([np.stack([X, Y, one, zero, zero, zero, -u * X, -u * Y], -1), np.stack([zero, zero, zero, X, Y, one, -v * X, -v * Y], -1)], 1)
    h = np.linalg.solve(rows, np.concatenate([u, v], 1)[..., None])[..., 0]
    H = np.concatenate([h, np.ones((n, 1))], 1).reshape(n, 3, 3)
    J = H[:, :2, :2] - H[:, 2:, :2] * H[:, :2, 2:]
    c = H[:, :2, 2]
    # the rotation that turns the optical axis to the marker's centre
    ray = np.concatenate([c, np.ones((n, 1))], 1)
    ray /= np.linalg.norm(ray, axis=1, keepdims=True)
    a, b, w = ray.T
    Rv = np.empty((n, 3, 3))
    Rv[:, 0], Rv[:, 1] = np.stack([1 - a * a / (1 + w), -a * b / (1 + w), a], -1), np.stack([-a * b / (1 + w), 1 - b * b / (1 + w), b], -1)
    Rv[:, 2] = np.stack([-a, -b, w], -1)
    B = Rv[:, :2, :2] - c[..., None] * Rv[:, 2:, :2]
    A = np.linalg.solve(B, J)
    gamma = np.linalg.svd(A, compute_uv=False)[:, 0]
    Q = A / gamma[:, None, None]
    left = np.eye(2) - np.swapaxes(Q, 1, 2) @ Q
    d0, d1 = np.sqrt(np.maximum(left[:, 0, 0], 0)), np.sqrt(np.maximum(left[:, 1, 1], 0))
    d1 = np.where(left[:, 0, 1] < 0, -d1, d1)
    Rs, ts = [], []
    for sign in (1.0, -1.0):
        first = np.stack([Q[:, 0, 0], Q[:, 1, 0], sign * d0], -1)
        second = np.stack([Q[:, 0, 1], Q[:, 1, 1], sign * d1], -1)
        local = np.stack([first, second, np.cross(first, second)], -1)
        R = Rv @ local
        p = np.einsum("nij,kj->nki", R, corners)
        # u (pz + tz) = px + tx, v (pz + tz) = py + ty
        M = np.concatenate([np.stack([one, zero, -u], -1), np.stack([zero, one, -v], -1)], 1)
        rhs = np.concatenate([u * p[..., 2] - p[..., 0], v * p[..., 2] - p[..., 1]], 1)
        Mt = np.swapaxes(M, 1, 2)
        ts.append(np.linalg.solve(Mt @ M, Mt @ rhs[..., None])[..., 0])
        Rs.append(R)
    return np.stack(Rs, 1), np.stack(ts, 1)
