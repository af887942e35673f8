"""3x3 / 4x4 algebra on lists of columns, row-major.

Expressions are plain arithmetic, so a chain of transforms stays in one
generated-code stage; arrays are built only for the final column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = Sequence[Column]


def entries(matrix: Column, size: int = 16) -> list[Column]:
    return [F.get(matrix, F.lit(i)) for i in range(size)]


def pack(values: Matrix) -> Column:
    return F.array(*values)


def rotation(m16: Matrix) -> list[Column]:
    return [m16[4 * r + c] for r in range(3) for c in range(3)]


def translation(m16: Matrix) -> list[Column]:
    return [m16[3], m16[7], m16[11]]


def rigid(rot: Matrix, pos: Matrix) -> list[Column]:
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = [[rot[3 * r], rot[3 * r + 1], rot[3 * r + 2], pos[r]] for r in range(3)]
    return [x for row in rows for x in row] + [zero, zero, zero, one]


def transpose(rot: Matrix) -> list[Column]:
    return [rot[3 * c + r] for r in range(3) for c in range(3)]


def inverse(rot: Matrix) -> list[Column]:
    """Inverse of a 3x3 matrix: the adjugate over the determinant; NULL for a singular one."""
    rows = [rot[3 * r : 3 * r + 3] for r in range(3)]
    cofactors = [cross(rows[1], rows[2]), cross(rows[2], rows[0]), cross(rows[0], rows[1])]
    determinant = dot(rows[0], cofactors[0])
    return [F.try_divide(cofactors[c][r], determinant) for r in range(3) for c in range(3)]


def dot(a: Matrix, b: Matrix) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        total = total + x * y
    return total


def norm(v: Matrix) -> Column:
    return F.sqrt(dot(v, v))


def cross(a: Matrix, b: Matrix) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def times_vector(rot: Matrix, v: Matrix) -> list[Column]:
    return [dot(rot[3 * r : 3 * r + 3], v) for r in range(3)]


def times(a: Matrix, b: Matrix) -> list[Column]:
    columns = [[b[c], b[3 + c], b[6 + c]] for c in range(3)]
    return [dot(a[3 * r : 3 * r + 3], columns[c]) for r in range(3) for c in range(3)]
