"""4 x 4 matrices as arrays of 16 doubles by rows; row vectors, left-handed, translation in the last row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _matrix(cells: dict[tuple[int, int], Column | float]) -> Column:
    cell = lambda i, j: cells.get((i, j), 1.0 if i == j and (i, j) not in cells else 0.0)
    return F.array(*[(c if isinstance(c, Column) else F.lit(float(c))).cast("double") for c in (cell(i, j) for i in range(4) for j in range(4))])


def identity() -> Column:
    return _matrix({})


def translation(x: Column, y: Column, z: Column) -> Column:
    return _matrix({(3, 0): x, (3, 1): y, (3, 2): z})


def scale(x: Column, y: Column, z: Column) -> Column:
    return _matrix({(0, 0): x, (1, 1): y, (2, 2): z})


def rotation(axis: str, angle: Column) -> Column:
    a, b = {"x": (1, 2), "y": (2, 0), "z": (0, 1)}[axis]
    return _matrix({(a, a): F.cos(angle), (a, b): F.sin(angle), (b, a): -F.sin(angle), (b, b): F.cos(angle)})


def perspective(fov: Column, aspect: Column, near: Column, far: Column) -> Column:
    y = 1 / F.tan(fov / 2)
    return _matrix({(0, 0): y / aspect, (1, 1): y, (2, 2): far / (far - near), (2, 3): 1.0, (3, 2): -near * far / (far - near), (3, 3): 0.0})


def orthographic(width: Column, height: Column, near: Column, far: Column) -> Column:
    return _matrix({(0, 0): 2 / width, (1, 1): 2 / height, (2, 2): 1 / (far - near), (3, 2): -near / (far - near)})


def transpose(m: Column) -> Column:
    return F.array(*[m[4 * (k % 4) + k // 4] for k in range(16)])


def multiply(a: Column, b: Column) -> Column:
    return F.array(*[sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j]) for i in range(4) for j in range(4)])


def _minor(m: Column, rows: tuple[int, ...], columns: tuple[int, ...]) -> Column:
    if len(rows) == 1:
        return m[4 * rows[0] + columns[0]]
    out = None
    for k, c in enumerate(columns):
        term = m[4 * rows[0] + c] * _minor(m, rows[1:], columns[:k] + columns[k + 1 :])
        out = term if out is None else out + term if k % 2 == 0 else out - term
    return out


def determinant(m: Column) -> Column:
    return _minor(m, (0, 1, 2, 3), (0, 1, 2, 3))


def inverse(m: Column) -> Column:
    """By cofactors; a determinant of zero counts as 1e-5."""
    d = determinant(m)
    d = F.when(d == 0, F.lit(1e-5)).otherwise(d)
    others = lambda k: tuple(x for x in range(4) if x != k)
    cofactor = lambda i, j: _minor(m, others(i), others(j)) * (-1.0 if (i + j) % 2 else 1.0)
    return F.array(*[cofactor(j, i) / d for i in range(4) for j in range(4)])
