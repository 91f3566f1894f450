"""Array operators on model outputs: decoding, suppression, components. Models themselves are injected callables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def argmax(row: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(row, F.array_max(row)) - 1).cast("int")


def ctc_decode(logits: Column, steps: int, classes: int, chars: Column) -> dict[str, Column]:
    """Greedy CTC: best class of each step, repeats and blanks (class 0) dropped. text, and the mean score of what is kept."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda t: F.slice(logits, (t * classes + 1).cast("int"), classes))
    best = F.transform(rows, lambda r: F.struct(argmax(r).alias("c"), F.array_max(r).cast("double").alias("p")))
    kept = F.filter(F.transform(best, lambda b, i: F.struct(b["c"].alias("c"), b["p"].alias("p"), F.when(i == 0, F.lit(-1)).otherwise(best[i - 1]["c"]).alias("before"))), lambda b: (b["c"] != 0) & (b["c"] != b["before"]) & (b["c"] <= F.size(chars)))
    right = F.size(logits) == steps * classes
    text = F.when(right, F.array_join(F.transform(kept, lambda b: chars[b["c"] - 1]), "")).otherwise("")
    conf = F.when(right & (F.size(kept) > 0), F.aggregate(kept, F.lit(0.0), lambda a, b: a + b["p"]) / F.size(kept)).otherwise(0.0)
    return {"text": text, "confidence": conf}


def suppressed(detections: DataFrame, iou_threshold: float = 0.45, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Greedy non-maximum suppression by page and class: the most confident first, others go that overlap a kept one by more than the threshold.

    A page's detections are one array, folded in order inside the JVM; ties go to the smaller ord.
    """
    d = detections.select(*keys, "class_id", F.struct((-F.col("confidence")).alias("c"), "ord", "x1", "y1", "x2", "y2").alias("d"))
    per = d.groupBy(*keys, "class_id").agg(F.array_sort(F.collect_list("d")).alias("ds"))
    w, h = "(least(k.x2, v.x2) - greatest(k.x1, v.x1))", "(least(k.y2, v.y2) - greatest(k.y1, v.y1))"
    both = f"({w} * {h})"
    union = f"((k.x2 - k.x1) * (k.y2 - k.y1) + (v.x2 - v.x1) * (v.y2 - v.y1) - {both})"
    hit = f"{w} > 0 and {h} > 0 and {union} > 0 and {both} / {union} > {iou_threshold}D"
    kept = F.expr(f"aggregate(ds, slice(ds, 1, 0), (a, v) -> if(exists(a, k -> {hit}), a, array_append(a, v)))")
    out = per.select(*keys, "class_id", F.inline(kept))
    return out.select(*keys, "ord", "class_id", (-F.col("c")).alias("confidence"), "x1", "y1", "x2", "y2")


def labelled(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """4-connected components, numbered from 1 in raster order of their first pixel."""
    h, w = mask.shape
    parent = [0]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    labels = np.zeros((h, w), np.int64)
    for y in range(h):
        for x in np.flatnonzero(mask[y]):
            up, left = labels[y - 1, x] if y else 0, labels[y, x - 1] if x else 0
            if up and left:
                a, b = find(up), find(left)
                labels[y, x] = parent[max(a, b)] = min(a, b)
            elif up or left:
                labels[y, x] = find(up or left)
            else:
                parent.append(len(parent))
                labels[y, x] = len(parent) - 1
    number: dict[int, int] = {}
    for y, x in zip(*np.nonzero(labels)):
        labels[y, x] = number.setdefault(find(labels[y, x]), len(number) + 1)
    return labels, len(number)


def component_boxes(maps: DataFrame, probs: str, width: int, threshold: float = 0.3, box_threshold: float = 0.5, least: int = 3, scale: float = 1.0, key: str = "doc_id") -> DataFrame:
    """key, label, x1, y1, x2, y2 (exclusive), score: text regions of probability maps given as rows of arrays."""
    kind = dict(maps.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = np.array(p, np.float32).reshape(-1, width)
                labels, n = labelled(m >= np.float32(threshold))
                for i in range(1, n + 1):
                    ys, xs = np.nonzero(labels == i)
                    x1, y1, x2, y2, score = int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1, float(m[ys, xs].astype(np.float64).mean())
                    if score >= box_threshold and min(x2 - x1, y2 - y1) >= least:
                        half = lambda v: int(np.floor(v / scale + 0.5))
                        rows.append((k, i, half(x1), half(y1), half(x2), half(y2), score))
            cols = list(zip(*rows)) or [()] * 7
            types = [batch.column(0).type, *[pa.int32()] * 5, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["k", "label", "x1", "y1", "x2", "y2", "score"])

    out = maps.select(F.col(key).alias("k"), F.col(probs).alias("p")).mapInArrow(run, f"k {kind}, label int, x1 int, y1 int, x2 int, y2 int, score double")
    return out.withColumnRenamed("k", key)


def yolo_boxes(output: Column, boxes: int, features: int) -> Column:
    """A detector's output [features, boxes], flat, as rows of (x1, y1, x2, y2, confidence, class): the best class above 0."""
    at = lambda f, i: output[(F.lit(f) * boxes + i).cast("int")].cast("double")

    def one(i: Column) -> Column:
        scores = F.transform(F.sequence(F.lit(4), F.lit(features - 1)), lambda f: output[(f * boxes + i).cast("int")].cast("double"))
        cx, cy, w, h = (at(f, i) for f in range(4))
        return F.struct((cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2"), F.greatest(F.array_max(scores), F.lit(0.0)).alias("confidence"), F.when(F.array_max(scores) > 0, argmax(scores)).otherwise(0).alias("class_id"))

    return F.transform(F.sequence(F.lit(0), F.lit(boxes - 1)), one)


# ImageNet's mean and standard deviation of red, green and blue.
IMAGENET_MEAN = (0.485, 0.456, 0.406)
IMAGENET_DEVIATION = (0.229, 0.224, 0.225)


@lru_cache(maxsize=1024)
def resampling(n: int, m: int) -> np.ndarray:
    """Catmull-Rom weights [m, n] that make m pixels of n."""
    x = np.abs((np.arange(n)[None, :] - ((np.arange(m)[:, None] + 0.5) * n / m - 0.5)) / max(1.0, n / m))
    w = np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))
    return w / w.sum(1, keepdims=True)


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Catmull-Rom resampling of [h, w, channels]."""
    h, w, channels = image.shape
    out = (resampling(h, height) @ image.reshape(h, -1).astype(np.float64)).reshape(height, w, channels)
    return np.clip(np.round(resampling(w, width) @ out), 0, 255).astype(np.uint8)


def letterboxed(image: np.ndarray, size: int, fill: int = 114) -> np.ndarray:
    """An image in the middle of a square, as a float tensor [channel, row, column] in 0..1."""
    h, w = image.shape[:2]
    scale = min(size / w, size / h)
    nw, nh = int(w * scale), int(h * scale)
    out = np.full((size, size, 3), fill, np.uint8)
    y, x = (size - nh) // 2, (size - nw) // 2
    out[y : y + nh, x : x + nw] = resized(image, nw, nh)
    return (out.astype(np.float32) / 255).transpose(2, 0, 1)


def detection_tensor(image: np.ndarray, short: int = 960, stride: int = 32) -> np.ndarray:
    """Input of a text detector: the shorter side `short` at least, both sides multiples of `stride`; [channel, row, column], by ImageNet's mean and deviation."""
    h, w = image.shape[:2]
    scale = max(1.0, short / min(h, w))
    up = lambda v: max(stride, -(-int(v * scale) // stride) * stride)
    x = resized(image, up(w), up(h)).astype(np.float32) / 255
    return ((x - np.array(IMAGENET_MEAN, np.float32)) / np.array(IMAGENET_DEVIATION, np.float32)).transpose(2, 0, 1)


def recognition_tensor(image: np.ndarray, box: tuple[int, int, int, int], height: int = 48, width: int = 320) -> np.ndarray | None:
    """Input of a text recogniser: what a box (x1, y1, x2, y2) holds of the image, at that height, values in -1..1, zeros to the right; None if the box is empty."""
    h, w = image.shape[:2]
    x1, x2 = (min(max(v, 0), w) for v in (box[0], box[2]))
    y1, y2 = (min(max(v, 0), h) for v in (box[1], box[3]))
    if x2 <= x1 or y2 <= y1:
        return None
    own = max(1, min(int(height * (x2 - x1) / (y2 - y1)), width))
    out = np.zeros((3, height, width), np.float32)
    out[:, :, :own] = (resized(image[y1:y2, x1:x2], own, height).astype(np.float32) / 127.5 - 1).transpose(2, 0, 1)
    return out


def inferred(rows: DataFrame, model: Callable[[], Callable] | None, tensor: str, output: str, schema: str) -> DataFrame:
    """rows with a model's output. model: gives a callable on arrays, once for each worker. Without one the output is null: never an error."""
    if model is None:
        return rows.withColumn(output, F.lit(None).cast("array<float>"))

    def run(batches):
        call = model()
        for b in batches:
            got = [[float(v) for v in np.ravel(call(np.array(t, np.float32)))] for t in b.column(tensor).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.float32()))], [*b.schema.names, output])

    return rows.mapInArrow(run, schema)
