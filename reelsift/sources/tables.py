"""Frames from tables: embeddings as small gray frames, events as tag streams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelsift.functions import pixels
from reelsift.schema import FRAME, FRAME_SCHEMA, NUMBER, TIME, VIDEO


def embedding_frames(spark: SparkSession, folder: str) -> DataFrame:
    """8 x 8 gray frames (``px``) of each vector; its label is the video, the rank of its id the frame number."""
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    w = W.partitionBy("label").orderBy("vec_id")
    return e.select(
        F.col("label").cast("string").alias(VIDEO),
        (F.row_number().over(w) - 1).cast("long").alias(NUMBER),
        "vec_id",
        pixels.scaled_gray(F.col("embedding")).alias("px"),
        F.col("embedding").alias("clip_embedding"),
    )


def rgb_frames(spark: SparkSession, folder: str, height: int, width: int) -> DataFrame:
    """RGB frames of any size, made of the small gray ones: their pixels enlarged, under a slope of its own for each channel."""
    small = embedding_frames(spark, folder).select(VIDEO, NUMBER, F.make_dt_interval(secs=(F.col(NUMBER) / 30).cast("decimal(18,6)")).alias(TIME), "vec_id", "px")
    y, x, ch = np.ogrid[:height, :width, :3]
    place = (y * 8 // height * 8 + x * 8 // width)[:, :, 0]
    pixels = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])

    def run(batches):
        for batch in batches:
            made = []
            for px in batch.column("px").to_pylist():
                a = (np.array(px)[place][:, :, None] * (2 + ch) + 5 * y + 3 * x + 40 * ch) % 256
                made.append({"height": height, "width": width, "channels": 3, "data": a.astype(np.uint8).tobytes()})
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(made, pixels)], [VIDEO, NUMBER, TIME, "vec_id", FRAME])

    fields = [f for f in small.schema.fields if f.name != "px"] + [FRAME_SCHEMA[FRAME]]
    return small.mapInArrow(run, T.StructType(fields))


def event_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames without pixels: a user is a video, the order of events that of frames, ``value`` a tag."""
    e = spark.read.parquet(f"{folder}/events.parquet")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").cast("string").alias(VIDEO), (F.row_number().over(w) - 1).cast("long").alias(NUMBER), "event_id", "value")

