"""Pose geometry as Column expressions.

Vectors are arrays of 3, rotations arrays of 9 in row-major order, quaternions arrays (w, x, y, z). All
functions are closed-form built-ins. A null argument or element makes the elements that depend on it
null; NaN elements give NaN.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12
LONG = 120


def elements(a: Column, n: int) -> list[Column]:
    return [a[i] for i in range(n)]


def _lets(f: Callable[..., Column]) -> Callable[..., Column]:
    """Evaluate long argument expressions once.

    The functions below name each element of an argument several times; nested calls would multiply the
    expression at every level. An argument that is more than a column or two is therefore bound to a lambda
    variable first. Short arguments stay as they are, inside generated code.
    """

    @functools.wraps(f)
    def wrapped(*args, **kwargs):
        long = [i for i, a in enumerate(args) if isinstance(a, Column) and len(str(a)) > LONG]
        if not long:
            return f(*args, **kwargs)

        def call(bound: Column) -> Column:
            return f(*[bound[f"v{i}"] if i in long else a for i, a in enumerate(args)], **kwargs)

        return F.transform(F.array(F.struct(*[args[i].alias(f"v{i}") for i in long])), call)[0]

    return wrapped


def _array(values: list[Column]) -> Column:
    return F.array(*values)


@_lets
def dot(a: Column, b: Column, n: int = 3) -> Column:
    out = a[0] * b[0]
    for i in range(1, n):
        out = out + a[i] * b[i]
    return out


@_lets
def norm(a: Column, n: int = 3) -> Column:
    return F.sqrt(dot(a, a, n))


@_lets
def cross(a: Column, b: Column) -> Column:
    return _array([a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]])


@_lets
def scale(a: Column, s: Column | float, n: int = 3) -> Column:
    return _array([a[i] * s for i in range(n)])


@_lets
def add(a: Column, b: Column, n: int = 3) -> Column:
    return _array([a[i] + b[i] for i in range(n)])


@_lets
def subtract(a: Column, b: Column, n: int = 3) -> Column:
    return _array([a[i] - b[i] for i in range(n)])


@_lets
def unit(a: Column, n: int = 3) -> Column:
    """``a`` over its norm; null for a zero vector."""
    length = norm(a, n)
    return F.when(length > TINY, _array([a[i] / length for i in range(n)]))


@_lets
def transpose(m: Column) -> Column:
    return _array([m[3 * (k % 3) + k // 3] for k in range(9)])


column_major = transpose


@_lets
def multiply(a: Column, b: Column) -> Column:
    return _array([a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)])


@_lets
def apply(m: Column, v: Column) -> Column:
    return _array([m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3)])


@_lets
def determinant(m: Column) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


@_lets
def trace(m: Column) -> Column:
    return m[0] + m[4] + m[8]


@_lets
def frobenius(a: Column, b: Column) -> Column:
    difference = subtract(a, b, 9)
    return norm(difference, 9)


@_lets
def skew(v: Column) -> Column:
    zero = F.lit(0.0)
    return _array([zero, -v[2], v[1], v[2], zero, -v[0], -v[1], v[0], zero])


@_lets
def normalise_quaternion(q: Column) -> Column:
    return unit(q, 4)


@_lets
def quaternion_to_rotation(q: Column, normalise: bool = True) -> Column:
    """Rotation of a quaternion; without ``normalise`` it is taken as a unit quaternion."""
    return _from_unit_quaternion(normalise_quaternion(q) if normalise else q)


@_lets
def _from_unit_quaternion(q: Column) -> Column:
    w, x, y, z = elements(q, 4)
    return _array(
        [
            1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
            2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
            2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
        ]
    )


@_lets
def rotation_to_quaternion(m: Column) -> Column:
    """Unit quaternion with w >= 0 from the largest of the four squared parts, which is well conditioned."""
    t = trace(m)
    s0 = F.sqrt(F.greatest(t + 1, F.lit(0.0))) * 2
    s1 = F.sqrt(F.greatest(1 + m[0] - m[4] - m[8], F.lit(0.0))) * 2
    s2 = F.sqrt(F.greatest(1 + m[4] - m[0] - m[8], F.lit(0.0))) * 2
    s3 = F.sqrt(F.greatest(1 + m[8] - m[0] - m[4], F.lit(0.0))) * 2
    a, b, c = m[7] - m[5], m[2] - m[6], m[3] - m[1]
    q = (
        F.when(t > 0, F.array(s0 / 4, a / s0, b / s0, c / s0))
        .when((m[0] >= m[4]) & (m[0] >= m[8]), F.array(a / s1, s1 / 4, (m[1] + m[3]) / s1, (m[2] + m[6]) / s1))
        .when(m[4] >= m[8], F.array(b / s2, (m[1] + m[3]) / s2, s2 / 4, (m[5] + m[7]) / s2))
        .otherwise(F.array(c / s3, (m[2] + m[6]) / s3, (m[5] + m[7]) / s3, s3 / 4))
    )
    return F.when(m.isNotNull() & t.isNotNull(), canonical_quaternion(q))


@_lets
def canonical_quaternion(q: Column) -> Column:
    """Of q and -q, the one whose first part that is not zero is positive."""
    w, x, y, z = elements(q, 4)
    negative = (w < 0) | ((w == 0) & ((x < 0) | ((x == 0) & ((y < 0) | ((y == 0) & (z < 0))))))
    sign = F.when(negative, -1.0).otherwise(1.0)
    return _array([w * sign, x * sign, y * sign, z * sign])


@_lets
def quaternion_product(a: Column, b: Column) -> Column:
    aw, ax, ay, az = elements(a, 4)
    bw, bx, by, bz = elements(b, 4)
    return _array(
        [aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw]
    )


@_lets
def quaternion_rotate(q: Column, v: Column) -> Column:
    return apply(quaternion_to_rotation(q), v)


@_lets
def quaternion_to_scaled_rotation(q: Column) -> Column:
    """Rotation times the squared norm of the quaternion."""
    return scale(quaternion_to_rotation(q), dot(q, q, 4), 9)


@_lets
def angle_axis_to_quaternion(v: Column) -> Column:
    angle = norm(v)
    k = F.when(angle > TINY, F.sin(angle / 2) / angle).otherwise(0.5)
    return _array([F.cos(angle / 2), v[0] * k, v[1] * k, v[2] * k])


@_lets
def quaternion_to_angle_axis(q: Column) -> Column:
    """Rotation vector with an angle of at most pi."""
    return _rotation_vector(canonical_quaternion(q))


@_lets
def _rotation_vector(q: Column) -> Column:
    s = F.sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    k = F.when(s > TINY, 2 * F.atan2(s, q[0]) / s).otherwise(2.0)
    return _array([q[1] * k, q[2] * k, q[3] * k])


@_lets
def angle_axis_to_rotation(v: Column) -> Column:
    return quaternion_to_rotation(angle_axis_to_quaternion(v))


@_lets
def rotation_to_angle_axis(m: Column) -> Column:
    return quaternion_to_angle_axis(rotation_to_quaternion(m))


@_lets
def rotate_by_angle_axis(v: Column, p: Column) -> Column:
    return apply(angle_axis_to_rotation(v), p)


@_lets
def rotation_to_euler_zyx(m: Column) -> Column:
    """(roll, pitch, yaw) in degrees of R = Rz(yaw) Ry(pitch) Rx(roll); with the pitch at a pole, yaw is 0."""
    sy = F.sqrt(m[0] * m[0] + m[3] * m[3])
    regular = sy >= 1e-6
    roll = F.when(regular, F.atan2(m[7], m[8])).otherwise(F.atan2(-m[5], m[4]))
    yaw = F.when(regular, F.atan2(m[3], m[0])).otherwise(0.0)
    return _array([F.degrees(roll), F.degrees(F.atan2(-m[6], sy)), F.degrees(yaw)])


@_lets
def euler_zyx_to_rotation(e: Column) -> Column:
    r, p, y = (F.radians(x) for x in elements(e, 3))
    cr, sr, cp, sp, cy, sy = F.cos(r), F.sin(r), F.cos(p), F.sin(p), F.cos(y), F.sin(y)
    return _array([cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, -sp, cp * sr, cp * cr])


@_lets
def cayley_to_rotation(c: Column) -> Column:
    return quaternion_to_rotation(_array([F.lit(1.0), c[0], c[1], c[2]]))


@_lets
def rotation_to_cayley(m: Column) -> Column:
    """Cayley parameters; null for a half turn, which has none."""
    return _cayley_of(rotation_to_quaternion(m))


@_lets
def _cayley_of(q: Column) -> Column:
    return F.when(q[0] > TINY, _array([q[1] / q[0], q[2] / q[0], q[3] / q[0]]))


@_lets
def pose_to_parameters(m: Column, t: Column) -> Column:
    return F.concat(rotation_to_cayley(m), t)


def parameters_to_pose(p: Column) -> Column:
    return F.struct(cayley_to_rotation(F.slice(p, 1, 3)).alias("r"), F.slice(p, 4, 3).alias("t"))


@_lets
def camera_centre(m: Column, t: Column) -> Column:
    """Centre of a pose x = R X + t."""
    return scale(apply(transpose(m), t), -1.0)


@_lets
def to_world_translation(m: Column, centre: Column) -> Column:
    """Translation t of x = R X + t from the centre: format RwTw to RwTc."""
    return scale(apply(m, centre), -1.0)


POSE_FORMATS = ("RwTw", "RwTc", "RcTw", "RcTc")


def convert_pose(m: Column, t: Column, source: str, target: str) -> tuple[Column, Column]:
    """A pose in another format. Rw turns world to camera axes, Rc back; Tw is the centre, Tc is -Rw Tw."""
    if source not in POSE_FORMATS or target not in POSE_FORMATS:
        raise ValueError(f"pose formats are {POSE_FORMATS}")
    rw = m if source.startswith("Rw") else transpose(m)
    centre = t if source.endswith("Tw") else camera_centre(rw, t)
    return (rw if target.startswith("Rw") else transpose(rw)), (centre if target.endswith("Tw") else to_world_translation(rw, centre))


def invert_pose(m: Column, t: Column) -> tuple[Column, Column]:
    rt = transpose(m)
    return rt, scale(apply(rt, t), -1.0)


def relative_pose(ri: Column, ti: Column, rj: Column, tj: Column) -> tuple[Column, Column]:
    """x_j ~ Rij x_i + tij of two global poses in format RwTw."""
    return multiply(rj, transpose(ri)), apply(rj, subtract(ti, tj))


@_lets
def rotation_angle(a: Column, b: Column) -> Column:
    """Angle between two rotations in degrees."""
    cosine = (dot(a, b, 9) - 1) / 2
    return F.degrees(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))))


@_lets
def direction_angle(a: Column, b: Column) -> Column:
    """Angle between two directions in degrees; null if either has no length."""
    lengths = norm(a) * norm(b)
    cosine = dot(a, b) / lengths
    return F.when(lengths > TINY, F.degrees(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))))


@_lets
def distance(a: Column, b: Column) -> Column:
    return norm(subtract(a, b))


@_lets
def essential_matrix(m: Column, t: Column) -> Column:
    return multiply(skew(t), m)


@_lets
def camera_matrix(fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    zero = F.lit(0.0)
    return _array([fx.cast("double"), zero, cx.cast("double"), zero, fy.cast("double"), cy.cast("double"), zero, zero, F.lit(1.0)])


@_lets
def bearing(u: Column, v: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Unit viewing direction of a pixel; null for a focal length that is not positive."""
    x, y = (u - cx) / fx, (v - cy) / fy
    length = F.sqrt(x * x + y * y + 1)
    return F.when((fx > 0) & (fy > 0) & u.isNotNull() & v.isNotNull(), _array([x / length, y / length, 1 / length]))


@_lets
def bearing_pair(b1: Column, b2: Column) -> Column:
    return F.concat(b1, b2)


def split_bearing_pair(pair: Column) -> tuple[Column, Column]:
    return F.slice(pair, 1, 3), F.slice(pair, 4, 3)


@_lets
def pixel_in_image(u: Column, v: Column, width: Column, height: Column) -> Column:
    return (u >= 0) & (u < width) & (v >= 0) & (v < height)


@_lets
def pose_is_sane(m: Column, t: Column, tolerance: float = 0.1) -> Column:
    """Whether a pose is finite and its rotation's determinant near 1. A zero translation is sane."""
    finite = F.lit(True)
    for x in [*elements(m, 9), *elements(t, 3)]:
        finite = finite & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    return F.coalesce(finite & (F.abs(determinant(m) - 1) <= tolerance), F.lit(False))
