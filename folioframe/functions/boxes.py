"""Arithmetic on boxes, images and colours, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of the layout detector, their names and the element types they stand for ("" overrides nothing).
CLASS_NAMES = {0: "title", 1: "plain text", 2: "abandon", 3: "figure", 4: "figure_caption", 5: "table", 6: "table_caption", 7: "table_footnote", 8: "isolate_formula", 9: "formula_caption"}
CLASS_TYPES = {0: "header", 1: "paragraph", 2: "", 3: "figure", 4: "caption", 5: "table", 6: "caption", 7: "footnote", 8: "equation", 9: "caption"}


def contains(x1, y1, x2, y2, px, py) -> Column:
    return px.between(x1, x2) & py.between(y1, y2)


def overlaps(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    return (ax1 < bx2) & (ax2 > bx1) & (ay1 < by2) & (ay2 > by1)


def iou(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    w, h = F.least(ax2, bx2) - F.greatest(ax1, bx1), F.least(ay2, by2) - F.greatest(ay1, by1)
    both = w * h
    union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - both
    return F.when((w <= 0) | (h <= 0) | (union <= 0), 0.0).otherwise(both / union)


def from_centre(cx, cy, w, h) -> tuple[Column, ...]:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def scaled_to_page(v: Column, scale: Column, pad: Column, limit: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least((v - pad) / scale, limit))


def letterbox(w: Column, h: Column, target_w: int, target_h: int) -> dict[str, Column]:
    """Scale, new size and padding of an image fitted into a frame."""
    scale = F.least(target_w / w, target_h / h)
    new_w, new_h = F.floor(w * scale).cast("int"), F.floor(h * scale).cast("int")
    return {"scale": scale, "new_w": new_w, "new_h": new_h, "pad_x": F.floor((target_w - new_w) / 2).cast("int"), "pad_y": F.floor((target_h - new_h) / 2).cast("int")}


def align_up(size: Column, stride: int) -> Column:
    return (F.ceil(size / stride) * stride).cast("int")


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(v, F.lit(high)))


def text_size(height: Column) -> Column:
    """Font size from the height of a text line's box."""
    return clamp(height / 0.7, 6.0, 72.0)


def flipped_y(page_height: Column, y: Column, scale: Column, height: Column) -> Column:
    return page_height - y * scale - height


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, ...]:
    """From bytes to bytes."""
    part = lambda v: ((1 - v / 255.0) * (1 - k / 255.0) * 255.0).cast("int")
    return part(c), part(m), part(y)


def transformed(x: Column, y: Column, m: Column) -> tuple[Column, Column]:
    """A point through a matrix of six numbers."""
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def svg_path(ops: Column, height: Column, x0: Column, y0: Column, pad: float = 5.0) -> Column:
    """Path data of ops (array of struct op, points (array of struct x, y)), Y turned down, from the box's corner and padded."""
    point = lambda p: F.format_string("%.2f %.2f", p["x"] - x0 + pad, height - (p["y"] - y0) + pad)
    return F.array_join(F.transform(ops, lambda o: F.trim(F.concat(o["op"], F.lit(" "), F.array_join(F.transform(o["points"], point), " ")))), " ")
