"""Rigid transforms and vectors as column expressions.

A vector is an array of three doubles, a pose T_A_B a struct of R, an array of
three rows, and t; it maps points from frame B into frame A. All functions are
plain column arithmetic, so that they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def vector(x, y, z) -> Column:
    return F.array(*[c if isinstance(c, Column) else F.lit(float(c)) for c in (x, y, z)])


def parts(v: Column) -> tuple[Column, Column, Column]:
    return v[0], v[1], v[2]


def dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Column, b: Column) -> Column:
    return vector(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def plus(a: Column, b: Column) -> Column:
    return vector(*[a[i] + b[i] for i in range(3)])


def minus(a: Column, b: Column) -> Column:
    return vector(*[a[i] - b[i] for i in range(3)])


def times(a: Column, s: Column) -> Column:
    return vector(*[a[i] * s for i in range(3)])


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v at length one; null for a vector that is nearly zero."""
    n = norm(v)
    return F.when(n > EPSILON, vector(*[v[i] / n for i in range(3)]))


def unit_reason(v: Column) -> Column:
    """Why unit(v) is null, else null."""
    return F.when(v.isNull(), "missing vector").when(~(norm(v) > EPSILON), "near-zero vector")


def rotation_y(cos: Column, sin: Column) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(F.array(cos, zero, sin), F.array(zero, one, zero), F.array(-sin, zero, cos))


def pose(R: Column, t: Column) -> Column:
    return F.struct(R.alias("R"), t.alias("t"))


def identity() -> Column:
    return pose(rotation_y(F.lit(1.0), F.lit(0.0)), vector(0, 0, 0))


def rotate(R: Column, v: Column) -> Column:
    return vector(*[dot(R[i], v) for i in range(3)])


def rotate_back(R: Column, v: Column) -> Column:
    """The transpose of R times v."""
    return vector(*[R[0][i] * v[0] + R[1][i] * v[1] + R[2][i] * v[2] for i in range(3)])


def transpose(R: Column) -> Column:
    return F.array(*[F.array(*[R[j][i] for j in range(3)]) for i in range(3)])


def product(A: Column, B: Column) -> Column:
    return F.array(*[F.array(*[A[i][0] * B[0][j] + A[i][1] * B[1][j] + A[i][2] * B[2][j] for j in range(3)]) for i in range(3)])


def transform(T: Column, point: Column) -> Column:
    return plus(rotate(T["R"], point), T["t"])


def transform_back(T: Column, point: Column) -> Column:
    """The point in frame B of a point given in frame A."""
    return rotate_back(T["R"], minus(point, T["t"]))


def inverse(T: Column) -> Column:
    back = rotate_back(T["R"], T["t"])
    return pose(transpose(T["R"]), vector(*[-back[i] for i in range(3)]))


def compose(A: Column, B: Column) -> Column:
    return pose(product(A["R"], B["R"]), transform(A, B["t"]))


def relative(T1: Column, T2: Column) -> Column:
    """The pose of camera 1 in the frame of camera 2: R2' R1 and R2' (t1 - t2)."""
    return pose(product(transpose(T2["R"]), T1["R"]), rotate_back(T2["R"], minus(T1["t"], T2["t"])))


def optical_axis(T: Column) -> Column:
    """The unit third column of the rotation."""
    return unit(vector(T["R"][0][2], T["R"][1][2], T["R"][2][2]))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def angle_deg(a: Column, b: Column) -> Column:
    """Degrees between two unit vectors."""
    return F.degrees(F.acos(clip(dot(a, b), -1.0, 1.0)))


def to_vector(T: Column) -> Column:
    """The pose as [t, rotation vector]; translation and rotation stay apart."""
    R = T["R"]
    skew = vector(R[2][1] - R[1][2], R[0][2] - R[2][0], R[1][0] - R[0][1])
    cos = clip((R[0][0] + R[1][1] + R[2][2] - 1) / 2, -1.0, 1.0)
    sin = norm(skew) / 2
    angle = F.atan2(sin, cos)
    usual = times(skew, F.when(sin > 1e-8, angle / (2 * F.when(sin > 1e-8, sin))).otherwise(0.5))
    # near half a turn the axis comes from the symmetric part; its largest entry is taken as positive
    axis = [F.sqrt(F.greatest(F.lit(0.0), (R[i][i] + 1) / 2)) for i in range(3)]
    big = F.greatest(*axis)
    def signed(i):
        j, k = (i + 1) % 3, (i + 2) % 3
        return vector(*[v for _, v in sorted(((i, axis[i]), (j, (R[i][j] + R[j][i]) / (4 * axis[i])), (k, (R[i][k] + R[k][i]) / (4 * axis[i]))))])
    half = F.when(axis[0] == big, signed(0)).when(axis[1] == big, signed(1)).otherwise(signed(2))
    r = F.when((cos < 0) & (sin < 1e-6), times(half, angle)).otherwise(usual)
    return F.concat(T["t"], r)


def from_vector(x: Column) -> Column:
    """The pose of [t, rotation vector]."""
    r = F.slice(x, 4, 3)
    angle = norm(r)
    small = angle < 1e-10
    safe = F.when(small, F.lit(1.0)).otherwise(angle)
    a = F.when(small, F.lit(1.0)).otherwise(F.sin(angle) / safe)
    b = F.when(small, F.lit(0.5)).otherwise((1 - F.cos(angle)) / (safe * safe))
    K = [[F.lit(0.0), -r[2], r[1]], [r[2], F.lit(0.0), -r[0]], [-r[1], r[0], F.lit(0.0)]]
    square = [[K[i][0] * K[0][j] + K[i][1] * K[1][j] + K[i][2] * K[2][j] for j in range(3)] for i in range(3)]
    R = F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) + a * K[i][j] + b * square[i][j] for j in range(3)]) for i in range(3)])
    return pose(R, F.slice(x, 1, 3))


POSE_JSON = "struct<R:array<array<double>>,t:array<double>>"


def to_json(T: Column) -> Column:
    return F.to_json(T)


def from_json(text: Column) -> Column:
    """A pose from its JSON text; null if it is not three rows of three numbers and three numbers."""
    T = F.from_json(text, POSE_JSON)
    whole = (F.size(T["R"]) == 3) & F.forall(T["R"], lambda r: F.size(r) == 3) & (F.size(T["t"]) == 3)
    return F.when(whole, T)


#: Corners of a square marker of side 2, y up, by order.
CORNER_ORDERS = {
    "y_up": ((-1, -1), (1, -1), (1, 1), (-1, 1)),
    "detector": ((-1, 1), (1, 1), (1, -1), (-1, -1)),
    "export": ((-1, -1), (-1, 1), (1, 1), (1, -1)),
}


def marker_corners(size: float, order: str) -> Column:
    """An array of (corner, point) of a marker with sides of the given length."""
    if not (size > 0 and size < float("inf")):
        raise ValueError(f"marker size must be finite and positive, got {size}")
    half = size / 2
    return F.array(*[F.struct(F.lit(i).alias("corner"), vector(x * half, y * half, 0).alias("point")) for i, (x, y) in enumerate(CORNER_ORDERS[order])])
