"""The frame row: schema, validation and the classification of tag columns.

A frame is a row with a video id, a frame number, a timestamp, pixels and
metadata; its tags are ordinary nullable columns, so unused ones are pruned.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VIDEO, NUMBER, TIME, FRAME, META = "source_video_id", "frame_number", "timestamp", "frame", "additional_metadata"

PIXELS = T.StructType(
    [
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)

FRAME_SCHEMA = T.StructType(
    [
        T.StructField(VIDEO, T.StringType(), False),
        T.StructField(NUMBER, T.LongType(), False),
        T.StructField(TIME, T.DayTimeIntervalType()),
        T.StructField(FRAME, PIXELS),
        T.StructField(META, T.MapType(T.StringType(), T.StringType())),
    ]
)

#: Tags that can say how different two frames are, and those that only measure one frame.
DIVERSITY_SUITABLE = frozenset({"dhash", "phash", "ahash", "clip_embedding", "model_embedding", "color_hist"})
METRIC_ONLY = frozenset({"blur_score", "entropy", "edge_density"})
#: Internal columns that never take part in auto-detection.
INTERNAL = frozenset({"hash_value"})


def tag_category(tag: str) -> str:
    """``metric_only`` or ``diversity_suitable``; tags that aren't known are suitable."""
    return "metric_only" if tag in METRIC_ONLY else "diversity_suitable"


def is_diversity_suitable(tag: str) -> bool:
    return tag_category(tag) == "diversity_suitable"


def is_metric_only(tag: str) -> bool:
    return tag in METRIC_ONLY


def pixels_row(array: np.ndarray) -> tuple[int, int, int, bytes]:
    """The pixel struct of an array (H, W) or (H, W, C); empty frames are valid."""
    if not isinstance(array, np.ndarray):
        raise TypeError("frame data must be a numpy array")
    if array.ndim not in (2, 3) or array.ndim == 3 and array.shape[2] not in (1, 3, 4):
        raise ValueError(f"frame data must be (H, W) or (H, W, C) with 1, 3 or 4 channels, not {array.shape}")
    h, w = array.shape[:2]
    return h, w, 1 if array.ndim == 2 else array.shape[2], np.ascontiguousarray(array, np.uint8).tobytes()


def to_array(frame) -> np.ndarray:
    """The array of a pixel struct: (H, W) for one channel, else (H, W, C)."""
    # Beside missing frames numbers may come as floats.
    h, w, c = (int(frame[k]) for k in ("height", "width", "channels"))
    flat = np.frombuffer(frame["data"], np.uint8)
    return flat.reshape(h, w) if c == 1 else flat.reshape(h, w, c)


def frame_row(array, number, timestamp, video, metadata=None) -> tuple:
    """A row of ``FRAME_SCHEMA``; ``TypeError`` or ``ValueError`` if a value doesn't fit."""
    pixels = pixels_row(array)
    if not isinstance(number, int | np.integer) or number < 0:
        raise ValueError("frame_number must be a whole number, not negative")
    if not isinstance(timestamp, dt.timedelta):
        raise TypeError("timestamp must be a timedelta")
    if not isinstance(video, str) or not video.strip():
        raise ValueError("source_video_id must be a string that isn't blank")
    if metadata is not None and not isinstance(metadata, dict):
        raise TypeError("additional_metadata must be a dict")
    return video, int(number), timestamp, pixels, {str(k): str(v) for k, v in (metadata or {}).items()}


def get_tag(df: DataFrame, tag: str, default=None) -> Column:
    """The tag's column, its nulls as ``default``; the default alone if there is no such column."""
    if tag not in df.columns:
        return F.lit(default)
    return F.col(tag) if default is None else F.coalesce(F.col(tag), F.lit(default))


def has_tags(df: DataFrame, tags) -> bool:
    """Whether all tags are columns; their values may be null."""
    return set(tags) <= set(df.columns)
