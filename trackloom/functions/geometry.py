"""Geometry as column expressions: polygons, boxes, rigid transforms, the fisheye camera."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def inside(x: Column, y: Column, polygon: Sequence[tuple[float, float]]) -> Column:
    """Even-odd test against a fixed ring; a point without coordinates is outside."""
    odd = F.lit(False)
    for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        straddles = (F.lit(float(ay)) > y) != (F.lit(float(by)) > y)
        cut = F.lit(float(bx - ax)) * (y - F.lit(float(ay))) / F.lit(float(by - ay) + 1e-12) + F.lit(float(ax))
        odd = odd != (straddles & (x < cut))
    return F.coalesce(odd, F.lit(False))


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """The same test against an array<struct<x,y>> column."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, i)

    def crosses(i: Column) -> Column:
        a, b = at(i + 1), at(F.when(i + 1 == n, F.lit(1)).otherwise(i + 2))
        straddles = (a["y"] > y) != (b["y"] > y)
        return straddles & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"] + F.lit(1e-12)) + a["x"])

    odd = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), lambda acc, i: acc != F.coalesce(crosses(i), F.lit(False)))
    return F.when(n > 0, odd).otherwise(False)


def inside_any(x: Column, y: Column, rings: Column) -> Column:
    return F.coalesce(F.exists(rings, lambda ring: inside_ring(x, y, ring)), F.lit(False))


def fisheye(x: Column, y: Column, z: Column, k: Sequence[float], fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Pixel of a camera-frame point: an odd polynomial of the angle from the axis."""
    r = F.sqrt(x * x + y * y)
    theta = F.atan2(r, z)
    bent = sum((F.lit(c) * F.pow(theta, F.lit(3.0 + 2 * i)) for i, c in enumerate(k)), theta)
    scale = F.when(r < 1e-9, F.lit(0.0)).otherwise(bent / F.greatest(r, F.lit(1e-9)))
    return F.lit(fx) * x * scale + F.lit(cx), F.lit(fy) * y * scale + F.lit(cy)


def visible(u: Column, v: Column, z: Column, width: int, height: int) -> Column:
    return F.coalesce((z > 0) & (u >= 0) & (u < width) & (v >= 0) & (v < height), F.lit(False))


def transform(pose: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A row-major 4x4 array column applied to a point."""
    m = lambda i: F.element_at(pose, i + 1)
    return tuple(m(4 * r) * x + m(4 * r + 1) * y + m(4 * r + 2) * z + m(4 * r + 3) for r in range(3))


def untransform(pose: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The inverse of a rigid pose applied to a point."""
    m = lambda i: F.element_at(pose, i + 1)
    d = (x - m(3), y - m(7), z - m(11))
    return tuple(m(c) * d[0] + m(4 + c) * d[1] + m(8 + c) * d[2] for c in range(3))


def corners(cx: Column, cy: Column, cz: Column, length: Column, width: Column, height: Column, yaw: Column) -> Column:
    """The eight corners: the top face (front left, front right, rear left, rear right), then the bottom."""
    c, s = F.cos(yaw), F.sin(yaw)

    def corner(a: float, b: float, h: float) -> Column:
        dx, dy = length * (a / 2), width * (b / 2)
        return F.struct((cx + dx * c - dy * s).alias("x"), (cy + dx * s + dy * c).alias("y"), (cz + height * (h / 2)).alias("z"))

    return F.array(*[corner(a, b, h) for h in (1.0, -1.0) for a in (1.0, -1.0) for b in (1.0, -1.0)])


def bounding_box(points: Column, width: int, height: int) -> Column:
    """(x1, y1, x2, y2) of array<struct<u,v>> clipped to the image; null without points."""
    low = lambda f, top: F.greatest(F.lit(0.0), F.least(F.array_min(F.transform(points, f)), F.lit(float(top - 1))))
    high = lambda f, top: F.greatest(F.lit(0.0), F.least(F.array_max(F.transform(points, f)), F.lit(float(top - 1))))
    u, v = (lambda p: p["u"]), (lambda p: p["v"])
    return F.when(F.size(points) > 0, F.struct(low(u, width).alias("x1"), low(v, height).alias("y1"), high(u, width).alias("x2"), high(v, height).alias("y2")))


def range_xy(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def rigid(yaw: Column, x: Column, y: Column, z: Column) -> Column:
    """A row-major 4x4 array: a turn about the vertical axis, then a shift."""
    zero, one, c, s = F.lit(0.0), F.lit(1.0), F.cos(yaw), F.sin(yaw)
    return F.array(c, -s, zero, x, s, c, zero, y, zero, zero, one, z, zero, zero, zero, one)


def compose(a: Column, b: Column) -> Column:
    """The 4x4 product: first b, then a. So world <- sensor is compose(world <- vehicle, vehicle <- sensor).
    Matrices should be columns of the rows, not expressions, which would be written out many times."""
    at = lambda m, i, j: F.element_at(m, 4 * i + j + 1)
    return F.array(*[sum((at(a, i, k) * at(b, k, j) for k in range(1, 4)), at(a, i, 0) * at(b, 0, j)) for i in range(4) for j in range(4)])


def inverse(pose: Column) -> Column:
    """The inverse of a rigid 4x4: the turn transposed, the shift turned back. So camera <- lidar is compose(inverse(camera), lidar)."""
    m = lambda i, j: F.element_at(pose, 4 * i + j + 1)
    rows = [[m(0, i), m(1, i), m(2, i), -(m(0, i) * m(0, 3) + m(1, i) * m(1, 3) + m(2, i) * m(2, 3))] for i in range(3)]
    return F.array(*[c for row in rows for c in row], F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def to_pixel(camera: Column, x: Column, y: Column, z: Column, lens: dict, width: int, height: int) -> Column:
    """struct<u, v, depth> of a point through a camera <- point transform (a column); null where the image does not show it."""
    px, py, pz = transform(camera, x, y, z)
    u, v = fisheye(px, py, pz, **lens)
    return F.when(visible(u, v, pz, width, height), F.struct(u.alias("u"), v.alias("v"), pz.alias("depth")))


def box_in_image(box: Column, camera: Column, lens: dict, width: int, height: int) -> Column:
    """struct<box struct<x1, y1, x2, y2> in tenths of pixels, n_visible> of the corners (`corners`) of a box: the range of those that the
    image shows, clipped to it; a null box where it shows none."""
    shown = F.filter(F.transform(box, lambda p: to_pixel(camera, p["x"], p["y"], p["z"], lens, width, height)), lambda p: p.isNotNull())
    own = bounding_box(shown, width, height)
    tenths = F.when(own.isNotNull(), F.struct(*[F.round(own[c], 1).alias(c) for c in ("x1", "y1", "x2", "y2")]))
    return F.struct(tenths.alias("box"), F.size(shown).alias("n_visible"))


def heading_corners(cx: Column, cy: Column, cz: Column, length: Column, width: Column, height: Column, hx: Column, hy: Column) -> Column:
    """The eight corners of a box along a heading vector (along +x where it stands still): the ground ring, then the top one."""
    size = F.sqrt(hx * hx + hy * hy)
    c, s = F.when(size > 1e-9, hx / size).otherwise(1.0), F.when(size > 1e-9, hy / size).otherwise(0.0)

    def corner(a: float, b: float, h: float) -> Column:
        dx, dy = length * (a / 2), width * (b / 2)
        return F.struct((cx + dx * c - dy * s).alias("x"), (cy + dx * s + dy * c).alias("y"), (cz + height * (h / 2)).alias("z"))

    return F.array(*[corner(a, b, h) for h in (-1.0, 1.0) for a, b in ((1.0, 1.0), (1.0, -1.0), (-1.0, -1.0), (-1.0, 1.0))])


def in_turned_box(x: Column, y: Column, z: Column, centre: tuple[Column, Column, Column], sizes: tuple[Column, Column, Column], q: tuple[Column, Column, Column, Column]) -> Column:
    """Whether a point is in a box with the turn of a unit quaternion (scalar first), borders included."""
    w, i, j, k = q
    d = [p - c for p, c in zip((x, y, z), centre, strict=True)]
    columns = [  # the box's axes in space
        (1 - 2 * (j * j + k * k), 2 * (i * j + k * w), 2 * (i * k - j * w)),
        (2 * (i * j - k * w), 1 - 2 * (i * i + k * k), 2 * (j * k + i * w)),
        (2 * (i * k + j * w), 2 * (j * k - i * w), 1 - 2 * (i * i + j * j)),
    ]
    inside = [F.abs(a[0] * d[0] + a[1] * d[1] + a[2] * d[2]) <= size / 2 for a, size in zip(columns, sizes, strict=True)]
    return inside[0] & inside[1] & inside[2]


def polygon_space(low_x: Column, low_y: Column, high_x: Column, high_y: Column, width: int, height: int, metres: float = 200.0) -> Column:
    """Whether coordinates of such a range are pixels of an image or metres around a vehicle; null where they can be neither."""
    pixels = (low_x >= 0) & (low_y >= 0) & (high_x <= width) & (high_y <= height) & ((high_x > metres) | (high_y > metres))
    near = (F.greatest(F.abs(low_x), F.abs(high_x)) <= metres) & (F.greatest(F.abs(low_y), F.abs(high_y)) <= metres)
    return F.when(pixels, "pixel").when(near, "metric")


def box_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))
