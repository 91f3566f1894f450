"""Thresholds of the layout operators, and presets."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    header_size_ratio: float = 1.2
    level_ratios: tuple[float, ...] = (2.0, 1.75, 1.5, 1.3, 1.15)  #: of a header's size to the body's, for levels 1 to 5
    min_image_size: float = 50.0
    equation_score_threshold: int = 2
    indent: float = 5.0
    wide_gap_multiple: float = 3.0
    line_height_multiplier: float = 1.6
    sentence_gap_multiplier: float = 1.5
    median_gap_multiplier: float = 1.2
    word_gap: float = 0.5
    same_line: float = 2.0
    detection_confidence: float = 0.25
    nms_iou: float = 0.45
    override_confidence: float = 0.5
    match_iou: float = 0.3
    link_share: float = 0.3
    column_gap: float = 30.0  #: points between columns of text
    min_table_columns: int = 2
    min_table_rows: int = 2
    column_tolerance: float = 5.0
    row_tolerance: float = 3.0
    min_table_confidence: float = 0.5
    exclude_top: float = 0.0
    exclude_bottom: float = 0.0


DEFAULT = Config()
PRESETS = {"default": DEFAULT, "academic": replace(DEFAULT, equation_score_threshold=1), "technical": replace(DEFAULT, header_size_ratio=1.15), "minimal": replace(DEFAULT, min_image_size=100.0)}


def from_session(spark, preset: str = "default") -> Config:
    """A preset with what the session sets under folioframe.layout.<field>."""
    base = PRESETS[preset]
    changes = {}
    for name, value in vars(base).items():
        found = spark.conf.get(f"folioframe.layout.{name}", None)
        if found is not None and not isinstance(value, tuple):
            changes[name] = type(value)(found)
    return replace(base, **changes)
