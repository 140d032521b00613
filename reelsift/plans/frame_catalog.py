"""Registered queries over RGB frames, sources, sinks, extensions and the SQL functions, with their SQL oracles.

Frames come from ``rgb_frames``, so taggers, filters and pipelines run here as
they do on decoded videos, through the pass in Python workers.
"""

from __future__ import annotations

import datetime as dt
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelsift.functions import distance as D
from reelsift.functions.sql import register as register_functions
from reelsift.operators import filters as FL
from reelsift.operators import taggers as TG
from reelsift.operators.greedy import TemporalBuffer
from reelsift.plans import frame_oracles as R
from reelsift.plans import oracles as O
from reelsift.plans import strategies as S
from reelsift.plans.catalog import IDS, _greedy_sql, _stage_row, register, rounded
from reelsift.plans.pipeline import FramePipeline, per_video_metrics
from reelsift.schema import FRAME, NUMBER, TIME, VIDEO, frame_row, to_array
from reelsift.session import shared_dir
from reelsift.sources.tables import embedding_frames, event_frames, rgb_frames
from reelsift.sources.video import VideoFiles, extract_frames, frames_from, load_video_frames, write_video

F32, F16, F8, F89 = (R.frames(*size) for size in ((32, 32), (16, 16), (8, 8), (8, 9)))


def _tag(tagger, size: tuple[int, int], *columns):
    """A query that gives a tagger's columns of every frame."""

    def run(spark, d):
        frames = FramePipeline([tagger()], keep_frames=False).apply(rgb_frames(spark, d, *size))
        return frames.selectExpr("vec_id", *columns)

    return run


# Taggers

register("frame_blur", f"WITH {F32}, {R.blur(32, 32)} SELECT vec_id, round(blur_score, 6) + 0.0 AS blur_score FROM blur")(
    _tag(TG.BlurTagger, (32, 32), "round(blur_score, 6) + 0.0D AS blur_score")
)
register("frame_entropy", f"WITH {F32}, {R.entropy(32, 32)} SELECT vec_id, round(entropy, 6) + 0.0 AS entropy FROM entropies")(
    _tag(TG.EntropyTagger, (32, 32), "round(entropy, 6) + 0.0D AS entropy")
)
for _kind, _size, _frames, _rows in (
    ("phash", (32, 32), F32, R.COSINE), ("ahash", (8, 8), F8, R.AVERAGE), ("dhash", (8, 9), F89, R.DIFFERENCE), ("whash", (16, 16), F16, R.WAVELET),
    ("colorhash", (16, 16), f"{F16}, {R.HSV.format('blue', 'red')}", R.color_bits(256, 8)),
):
    register(f"frame_{_kind}", f"WITH {_frames}, {R.bits('b', _rows)} SELECT vec_id, hex AS {_kind}, hex AS hash_value FROM b")(
        _tag(lambda kind=_kind: TG.HashTagger(kind), _size, _kind, "hash_value")
    )


@register("tag_dhash", f"WITH {F89}, {R.bits('b', R.DIFFERENCE)} SELECT vec_id, hex AS dhash FROM b")
def tag_dhash(spark, d):
    """The difference hash of gray frames of its own size."""
    gray = F.udf(lambda frame: (lambda a: (a.shape[0], a.shape[1], 1, _hash_gray(a).tobytes()))(to_array(frame)), T.StructType([T.StructField(n, t) for n, t in (("height", T.IntegerType()), ("width", T.IntegerType()), ("channels", T.IntegerType()), ("data", T.BinaryType()))]), useArrow=True)
    frames = rgb_frames(spark, d, 8, 9)
    return TG.HashTagger("dhash").apply(frames.withColumn(FRAME, gray(FRAME))).select("vec_id", "dhash")


def _hash_gray(a: np.ndarray) -> np.ndarray:
    from reelsift.functions.images import luma_swapped

    return luma_swapped(a)


@register("hash_difference", f"WITH {F8}, {R.bits('b', R.AVERAGE)} SELECT a.vec_id, CAST({O.HAMMING.format(a='a.bits', b='c.bits')} AS BIGINT) AS bits FROM b a JOIN b c ON c.vec_id = a.vec_id + 1")
def hash_difference(spark, d):
    h = _tag(lambda: TG.HashTagger("ahash"), (8, 8), "ahash")(spark, d)
    after = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("ahash").alias("_after"))
    return h.join(after, "vec_id").select("vec_id", D.hamming_bits(F.col("ahash"), F.col("_after")).cast("long").alias("bits"))


_BINS = "range(32) b(b)"
_HIST = " UNION ALL ".join(f"SELECT vec_id, {32 * i} + {c} // 8 AS bin FROM {{0}}" for i, c in enumerate(("{1}", "{2}", "{3}")))


def _histogram_sql(source: str, table: str, columns: tuple[str, str, str]) -> str:
    return f"WITH {source}, h AS (SELECT vec_id, bin, count(*) AS c FROM ({_HIST.format(table, *columns)}) GROUP BY ALL) SELECT vec_id, bin, round(c / 768.0::DOUBLE, 6) AS share FROM h"


def _shares(column: str):
    return lambda df: df.select("vec_id", F.posexplode(column).alias("bin", "_share")).where("_share > 0").select("vec_id", F.col("bin").cast("long").alias("bin"), F.round("_share", 6).alias("share"))


@register("frame_color_hist", _histogram_sql(f"{F16}, {R.HSV.format('red', 'blue')}", "hsv", ("hue", "sat", "val")))
def frame_color_hist(spark, d):
    return _shares("color_hist")(_tag(TG.ColorHistogramTagger, (16, 16), "color_hist")(spark, d))


@register("frame_color_histogram", _histogram_sql(F16, "f", ("red", "green", "blue")))
def frame_color_histogram(spark, d):
    return _shares("color_histogram")(_tag(TG.DominantColorTagger, (16, 16), "color_histogram")(spark, d))


@register("frame_dominant_color", f"WITH {F16} SELECT vec_id, CAST(sum(red) // 256 AS INTEGER) AS red, CAST(sum(green) // 256 AS INTEGER) AS green, CAST(sum(blue) // 256 AS INTEGER) AS blue FROM f GROUP BY vec_id")
def frame_dominant_color(spark, d):
    found = _tag(TG.DominantColorTagger, (16, 16), "dominant_color")(spark, d)
    return found.select("vec_id", *(F.col("dominant_color")[i].alias(c) for i, c in enumerate(("red", "green", "blue"))))


_MOMENTS = ", ".join([f"round(avg({c}), 6) AS mean_{c}, round(stddev_pop({c}), 6) AS deviation_{c}" for c in ("red", "green", "blue")])


@register("frame_moments", f"WITH {F16} SELECT vec_id, {_MOMENTS} FROM f GROUP BY vec_id")
def frame_moments(spark, d):
    found = _tag(TG.MomentsTagger, (16, 16), "model_embedding")(spark, d)
    names = [f"{k}_{c}" for k in ("mean", "deviation") for c in ("red", "green", "blue")]
    return found.select("vec_id", *(F.round(F.col("model_embedding")[i], 6).alias(n) for i, n in enumerate(names)))


@register("frame_edges", f"WITH {F16}, {R.edges(16, 16)} SELECT vec_id, edge_count, round(edge_count / 256.0::DOUBLE, 6) AS edge_density FROM edge")
def frame_edges(spark, d):
    return _tag(TG.EdgeDensityTagger, (16, 16), "edge_count", "round(edge_density, 6) AS edge_density")(spark, d)


_SATURATION = f"{F16}, {R.HSV.format('red', 'blue')}, saturated AS (SELECT vec_id, sum(sat) / 256.0::DOUBLE / 255 AS saturation FROM hsv GROUP BY vec_id)"


@register("frame_saturation", f"WITH {_SATURATION} SELECT vec_id, round(saturation, 6) AS saturation FROM saturated")
def frame_saturation(spark, d):
    return _tag(TG.SaturationTagger, (16, 16), "round(saturation, 6) AS saturation")(spark, d)


@register("saturation_filter", f"WITH {_SATURATION} SELECT vec_id FROM saturated WHERE saturation BETWEEN 0.5 AND 0.6")
def saturation_filter(spark, d):
    return FramePipeline([TG.SaturationTagger(), FL.ColorSaturationFilter(0.5, 0.6)], keep_frames=False).apply(rgb_frames(spark, d, 16, 16)).select("vec_id")


def _channel_means(name: str, weights: str, device: str):
    """A model that is a channel's mean each: something that SQL can say."""
    return lambda arrays: np.array([a.mean(axis=(0, 1)) for a in arrays])


_MEANS = "m AS (SELECT vec_id, avg(red) AS r, avg(green) AS g, avg(blue) AS b FROM f GROUP BY vec_id)"


@register("frame_clip", f"WITH {F16}, {_MEANS} SELECT vec_id, " + ", ".join(f"round(CAST(CAST({c} / sqrt(r * r + g * g + b * b) AS FLOAT) AS DOUBLE), 4) AS {c}" for c in "rgb") + " FROM m")
def frame_clip(spark, d):
    found = _tag(lambda: TG.CLIPTagger(_channel_means, batch_size=7), (16, 16), "clip_embedding")(spark, d)
    return found.select("vec_id", *(F.round(F.col("clip_embedding")[i].cast("double"), 4).alias(c) for i, c in enumerate("rgb")))


def _broken_model():
    raise RuntimeError("no device")


@register("frame_model_fallback", f"WITH {F16} SELECT vec_id, round(avg(red), 2) AS mean_red FROM f GROUP BY vec_id")
def frame_model_fallback(spark, d):
    """Embeddings of a model that fails on its device: every batch is taken by the fallback."""
    means = lambda: lambda arrays: np.array([[a[:, :, 0].mean(), 0.0] for a in arrays])
    tagger = TG.EmbeddingTagger(_broken_model, "vector", 16, means, 1)
    tagger.compute_batch = lambda arrays, t=tagger: [(v.tolist(),) for v in t._run(arrays)]
    out = FramePipeline([tagger], gpu_batch_size=5, keep_frames=False).apply(rgb_frames(spark, d, 16, 16))
    return out.select("vec_id", F.round(F.col("vector")[0].cast("double"), 2).alias("mean_red"))


# Filters and strategies

_MEASURED = f"{F32}, {R.blur(32, 32)}, {R.entropy(32, 32)}, {R.bits('b', R.COSINE)}, t AS MATERIALIZED (SELECT i.*, blur_score, entropy, bits FROM (SELECT DISTINCT source_video_id, frame_number, vec_id FROM f) i JOIN blur USING (vec_id) JOIN entropies USING (vec_id) JOIN b USING (vec_id))"
_COLUMNS = "source_video_id, frame_number, blur_score, entropy, bits"
_BOTH = "{'b': blur_score, 'e': entropy}"
BLUR, DUPLICATE, APART = 6000.0, 0.42, 40.0
_NEAR = f"{O.HAMMING.format(a='h', b='f.v')} <= {64 * DUPLICATE}"
_SMART = f"""WITH RECURSIVE {_MEASURED}, s0 AS MATERIALIZED (SELECT {_COLUMNS} FROM t WHERE blur_score >= {BLUR}),
{O.greedy('s1', 's0', 'bits', O.none_rejects(_NEAR), 50, _COLUMNS)},
{O.greedy('s2', 's1', _BOTH, O.none_rejects(f"greatest(abs(h.b - f.v.b), abs(h.e - f.v.e)) < {APART}"), 100, _COLUMNS)}"""


def _smart(**options) -> FramePipeline:
    return S.with_smart_sampling(blur_threshold=BLUR, duplicate_threshold=DUPLICATE, diversity_min_distance=APART, **options)


@register("frame_smart_sampling", f"{_SMART} SELECT source_video_id, frame_number, round(blur_score, 6) + 0.0 AS blur_score, round(entropy, 6) + 0.0 AS entropy FROM s2")
def frame_smart_sampling(spark, d):
    """The strategy with its default hash, over whole frames that stay with the rows."""
    out = _smart().apply(rgb_frames(spark, d, 32, 32))
    return out.select(*IDS, rounded(F.col("blur_score")).alias("blur_score"), rounded(F.col("entropy")).alias("entropy"))


@register("frame_smart_eager", f"{_SMART} SELECT source_video_id, frame_number FROM s2")
def frame_smart_eager(spark, d):
    return _smart(lazy_evaluation=False, keep_frames=False, n_workers=4).apply(rgb_frames(spark, d, 32, 32)).select(*IDS)


@register("frame_duplicates", f"WITH RECURSIVE {_MEASURED}, {O.greedy('r', 't', 'bits', O.none_rejects(_NEAR), 50, 'source_video_id, frame_number')} SELECT source_video_id, frame_number FROM r")
def frame_duplicates(spark, d):
    """Hashes are made on demand: there is no tagger before the filter."""
    return FramePipeline([FL.DuplicateFilter(50, DUPLICATE)]).apply(rgb_frames(spark, d, 32, 32)).select(*IDS)


@register("frame_duplicate_strategy", f"WITH RECURSIVE {_MEASURED}, {O.greedy('r', 't', 'bits', O.none_rejects(_NEAR), 9, 'source_video_id, frame_number')} SELECT source_video_id, frame_number FROM r")
def frame_duplicate_strategy(spark, d):
    return S.with_duplicate_detection(threshold=DUPLICATE, window_size=9).apply(rgb_frames(spark, d, 32, 32)).select(*IDS)


@register("frame_auto_diversity", f"WITH RECURSIVE {_MEASURED}, {O.greedy('r', 't', 'bits', O.none_rejects(f'({O.HAMMING}) / 64.0 < 0.42'.format(a='h', b='f.v')), 100, 'source_video_id, frame_number')} SELECT source_video_id, frame_number FROM r")
def frame_auto_diversity(spark, d):
    """The tags that say how different frames are, are found among those before."""
    stages = [TG.BlurTagger(), TG.HashTagger(), FL.DiversityFilter(min_distance=0.42)]
    return FramePipeline(stages).apply(rgb_frames(spark, d, 32, 32)).select(*IDS)


@register("frame_wavelet_diversity", f"WITH RECURSIVE {F16}, {R.bits('b', R.WAVELET)}, t AS (SELECT DISTINCT source_video_id, frame_number, bits FROM f JOIN b USING (vec_id)), {O.greedy('r', 't', 'bits', O.none_rejects(f'({O.HAMMING}) / 64.0 < 0.35'.format(a='h', b='f.v')), 100, 'source_video_id, frame_number')} SELECT source_video_id, frame_number FROM r")
def frame_wavelet_diversity(spark, d):
    """Every kind of hash is compared by its bits."""
    stages = [TG.HashTagger("whash"), FL.DiversityFilter(diversity_tags=["whash"], min_distance=0.35)]
    return FramePipeline(stages).apply(rgb_frames(spark, d, 16, 16)).select(*IDS)


def _motion_sql(source: str, accepts: str, size: int) -> str:
    return _greedy_sql(f"{source}, {R.gray_lists()}", "px", accepts, size)


_LATEST = O.MEAN_DIFF.format(a="f.v", b="g.buf[len(g.buf)]")
for _method, _least, _sql in (("mean_diff", 70.0, O.MEAN_DIFF), ("mse", 8000.0, O.MSE), ("histogram", 1.0, O.HISTOGRAM)):
    register(f"frame_motion_{_method}", _motion_sql(F8, f"({_sql.format(a='f.v', b='g.buf[len(g.buf)]')}) > {_least}", 5))(
        lambda spark, d, m=_method, t=_least: FramePipeline([FL.MotionFilter(5, t, m)]).apply(rgb_frames(spark, d, 8, 8)).select(*IDS)
    )


@register("scene_change", _motion_sql(F8, f"{_LATEST} > 0.28 * 255", 5))
def scene_change(spark, d):
    return FramePipeline([FL.SceneChangeFilter(5, 0.28)]).apply(rgb_frames(spark, d, 8, 8)).select(*IDS)


@register(
    "temporal_smoothing",
    f"WITH {O.EVENTS} SELECT source_video_id, frame_number FROM (SELECT *, sum(CAST(value > 20 AS INTEGER)) OVER (PARTITION BY source_video_id ORDER BY frame_number ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM t) WHERE n = 3",
)
def temporal_smoothing(spark, d):
    return FL.TemporalSmoothingFilter("value", 20.0, 3).apply(event_frames(spark, d)).select(*IDS)


@register("face_filter", f"WITH {O.EVENTS} SELECT source_video_id, frame_number FROM t WHERE coalesce(value, 0) BETWEEN 1 AND 10")
def face_filter(spark, d):
    frames = event_frames(spark, d).withColumnRenamed("value", "face_count")
    return FL.FaceFilter().apply(frames).select(*IDS)


def _bright_corner():
    """A detector that takes a bright corner for a face."""
    return lambda a: [(0, 0, 4, 4)] if a[:4, :4].mean() > 110 else []


_FACES = f"{F16}, {R.blur(16, 16)}, faces AS (SELECT source_video_id, frame_number, vec_id, avg(red + green + blue) FILTER (y < 4 AND x < 4) / 3 > 110 AS has_faces FROM f GROUP BY ALL)"


@register("face_strategy", f"WITH {_FACES} SELECT source_video_id, frame_number, 1::INTEGER AS face_count, 4::INTEGER AS wide FROM faces JOIN blur USING (vec_id) WHERE has_faces AND blur_score >= 12000")
def face_strategy(spark, d):
    out = FramePipeline(strategy=S.FaceDetectionStrategy(_bright_corner, 1, 12000.0)).apply(rgb_frames(spark, d, 16, 16))
    return out.select(*IDS, "face_count", F.col("face_boxes")[0][2].alias("wide"))


@register("high_quality", f"WITH {F16}, {R.blur(16, 16)}, {R.entropy(16, 16)}, {R.edges(16, 16)} SELECT vec_id FROM blur JOIN entropies USING (vec_id) JOIN edge USING (vec_id) WHERE blur_score >= 11000 AND entropy >= 6.3 AND edge_count / 256.0 >= 0.6")
def high_quality(spark, d):
    return FramePipeline(strategy=S.HighQualityStrategy(11000.0, 6.3, 0.6)).apply(rgb_frames(spark, d, 16, 16)).select("vec_id")


@register(
    "adaptive_sampling",
    f"WITH RECURSIVE {_MEASURED}, {R.gray_lists().replace('t AS', 'q AS', 1)}, a0 AS MATERIALIZED (SELECT source_video_id, frame_number, bits, px FROM t JOIN q USING (source_video_id, frame_number) WHERE blur_score >= {BLUR}), "
    + O.greedy("a1", "a0", "px", "list_sum(list_transform(range(1, 1025), lambda i: abs(f.v[i] - g.buf[len(g.buf)][i]))) / 1024.0 > 0.25 * 255", 5, "source_video_id, frame_number, bits")
    + f", {O.greedy('a2', 'a1', 'bits', O.none_rejects(_NEAR), 50, 'source_video_id, frame_number')} SELECT source_video_id, frame_number FROM a2",
)
def adaptive_sampling(spark, d):
    return FramePipeline(strategy=S.AdaptiveSamplingStrategy(BLUR, DUPLICATE, 0.25)).apply(rgb_frames(spark, d, 32, 32)).select(*IDS)


@register("quality_filter_nan", f"WITH {O.EVENTS} SELECT source_video_id, frame_number FROM t WHERE frame_number % 3 = 1 AND value >= 30")
def quality_filter_nan(spark, d):
    """A third of the tags is NaN and a third null: neither reaches anything."""
    third = F.col(NUMBER) % 3
    frames = event_frames(spark, d).withColumn("value", F.when(third == 1, F.col("value")).when(third == 0, F.lit(float("nan"))))
    return FL.QualityFilter({"value": 30.0}).apply(frames).select(*IDS)


# Metrics


class _Dark(TG.Tagger):
    """Fails on bright frames."""

    fields = (T.StructField("darkness", T.DoubleType()),)

    def compute(self, array):
        if array[:, :, 0].sum() > 128 * 256:
            raise RuntimeError("too bright")
        return (256.0 - array[:, :, 0].sum() / 256,)


_ERRORS_SQL = f"""WITH {F16}, {R.blur(16, 16)}, t AS (SELECT vec_id, blur_score >= 11000 AS sharp, sum(red) > 128 * 256 AS bright FROM f JOIN blur USING (vec_id) GROUP BY ALL),
n AS (SELECT count(*) AS a, count(*) FILTER (sharp) AS b, count(*) FILTER (sharp AND bright) AS bad FROM t)
""" + " UNION ALL ".join(
    f"SELECT {i}::INTEGER AS stage, '{name}' AS stage_name, {seen} AS frames_evaluated, {passed} AS frames_passed, {bad} AS errors FROM n"
    for i, (name, seen, passed, bad) in enumerate([("0:BlurTagger", "a", "a", "0::BIGINT"), ("1:BlurFilter", "a", "b", "0::BIGINT"), ("2:_Dark", "b", "b", "bad"), ("3:_Dark", "b", "b", "bad"), ("4:ThresholdFilter", "b", "b - bad", "0::BIGINT")])
)


def _failing() -> FramePipeline:
    return FramePipeline([TG.BlurTagger(), FL.BlurFilter(11000.0), _Dark(), _Dark(), FL.ThresholdFilter("darkness", 0.0)], lazy_evaluation=False, keep_frames=False)


@register("tagger_errors", _ERRORS_SQL)
def tagger_errors(spark, d):
    """A tagger after a filter fails at some of the frames that are left; another of its class is counted by itself."""
    return _failing().stage_metrics(rgb_frames(spark, d, 16, 16)).select("stage", "stage_name", "frames_evaluated", "frames_passed", "errors")


@register("observed_metrics", _ERRORS_SQL)
def observed_metrics(spark, d):
    """The same counts as they are observed while the selected frames are made."""
    out, result = _failing().process(rgb_frames(spark, d, 16, 16))
    out.write.format("noop").mode("overwrite").save()
    rows = [tuple(s[k] for k in ("stage", "stage_name", "frames_evaluated", "frames_passed", "errors")) for s in result.refresh().stages]
    return spark.createDataFrame(rows, "stage int, stage_name string, frames_evaluated long, frames_passed long, errors long")


@register("observed_summary", f"{_SMART} SELECT (SELECT count(*) FROM t) AS total_frames, (SELECT count(*) FROM s2) AS selected_frames, (SELECT count(*) FROM t) - (SELECT count(*) FROM s2) AS filtered_frames, round((SELECT count(*) FROM s2) * 100.0::DOUBLE / (SELECT count(*) FROM t), 6) AS selection_rate, true AS timed")
def observed_summary(spark, d):
    out, result = _smart().process(rgb_frames(spark, d, 32, 32))
    out.write.format("noop").mode("overwrite").save()
    s = result.refresh().get_summary()
    row = (s["total_frames"], s["selected_frames"], s["filtered_frames"], round(s["selection_rate"], 6), s["throughput"] > 0 and s["processing_time"] > 0)
    return spark.createDataFrame([row], "total_frames long, selected_frames long, filtered_frames long, selection_rate double, timed boolean")


@register(
    "frame_stage_metrics",
    f"{_SMART} "
    + " UNION ALL ".join(
        _stage_row(n, name, kind, f"(SELECT count(*) FROM {a})", f"(SELECT count(*) FROM {b})")
        for n, (name, kind, a, b) in enumerate([("0:BlurTagger", "tagger", "t", "t"), ("3:BlurFilter", "filter", "t", "s0"), ("1:HashTagger", "tagger", "s0", "s0"), ("4:DuplicateFilter", "filter", "s0", "s1"), ("2:EntropyTagger", "tagger", "s1", "s1"), ("5:DiversityFilter", "filter", "s1", "s2")])
    ),
)
def frame_stage_metrics(spark, d):
    return _smart().stage_metrics(rgb_frames(spark, d, 32, 32)).withColumn("pass_rate", F.round("pass_rate", 6))


# Sources and sinks

_IDS_SQL = f"WITH {O.EMBEDDED} SELECT source_video_id, frame_number FROM e"


def _row_list(spark, d) -> list[tuple]:
    """Rows of ``frame_row`` from a table; as many as a driver's list is for."""
    rows = rgb_frames(spark, d, 8, 8).select(*IDS, TIME, FRAME)
    return [frame_row(to_array(r[FRAME]), r[NUMBER], r[TIME] or dt.timedelta(0), r[VIDEO], {"n": r[NUMBER]}) for r in rows.toLocalIterator()]


_SOURCE_SQL = f"WITH {F8} SELECT source_video_id, frame_number, CAST(frame_number AS VARCHAR) AS n, CAST(sum(red * (y + 1) + blue * x) AS BIGINT) AS seen FROM f GROUP BY ALL"


class _Seen(TG.Tagger):
    """A sum that depends on every pixel's place and channel."""

    fields = (T.StructField("seen", T.LongType()),)

    def compute(self, array):
        a, (y, x) = array.astype(int), np.ogrid[: array.shape[0], : array.shape[1]]
        return (int((a[:, :, 0] * (y + 1) + a[:, :, 2] * x).sum()),)


def _seen(frames: DataFrame) -> DataFrame:
    return _Seen().apply(frames).select(*IDS, F.col("additional_metadata")["n"].alias("n"), "seen")


@register("source_list", _SOURCE_SQL)
def source_list(spark, d):
    return _seen(frames_from(spark, _row_list(spark, d)))


@register("source_iterable", _SOURCE_SQL)
def source_iterable(spark, d):
    return _seen(frames_from(spark, tuple(_row_list(spark, d))))


@register("source_iterator", _SOURCE_SQL)
def source_iterator(spark, d):
    """An iterator is stored a few frames at a time."""
    return _seen(frames_from(spark, iter(_row_list(spark, d))))


@register("process_iterator", _greedy_sql(f"{F8}, {R.bits('b', R.AVERAGE)}, t AS (SELECT DISTINCT source_video_id, frame_number, bits FROM f JOIN b USING (vec_id))", "bits", O.none_rejects(f"{O.HAMMING.format(a='h', b='f.v')} <= 19.2"), 50))
def process_iterator(spark, d):
    """Frames one by one through the stages of a pipeline in this process; here in the order of the table."""
    rows = sorted(_row_list(spark, d), key=lambda r: (r[0], r[1]))
    out = FramePipeline(strategy=S.DuplicateDetectionStrategy(0.3, 50, "ahash")).process_iterator(iter(rows))
    return spark.createDataFrame([(r[VIDEO], r[NUMBER]) for r in out], f"{VIDEO} string, {NUMBER} long")


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/reelsift-videos-{uuid.uuid4().hex}"


@register("sink_video", f"WITH {O.EMBEDDED} SELECT source_video_id, source_video_id || '.y4m' AS name, count(*) AS written, 0::BIGINT AS skipped FROM e GROUP BY ALL")
def sink_video(spark, d):
    out = write_video(rgb_frames(spark, d, 8, 8), _folder(spark))
    return out.select(VIDEO, F.element_at(F.split("path", "/"), -1).alias("name"), "written", "skipped")


_FILES_SQL = f"WITH {O.EMBEDDED} SELECT source_video_id || '.y4m' AS source_video_id, frame_number, CAST(floor(frame_number * 1000 / 25.0) AS BIGINT) AS millis, 8::INTEGER AS height, 12::INTEGER AS width, 3::INTEGER AS channels FROM e"


def _videos(spark, d) -> str:
    folder = _folder(spark)
    write_video(rgb_frames(spark, d, 8, 12), folder, fps=25).collect()
    return folder


@register("source_files", _FILES_SQL)
def source_files(spark, d):
    """Videos that were written, read back from their folder."""
    frames = load_video_frames(spark, _videos(spark, d))
    millis = (F.col(TIME).cast("interval second").cast("decimal(18,6)") * 1000).cast("long")
    return frames.select(*IDS, millis.alias("millis"), *(F.col(f"{FRAME}.{c}").alias(c) for c in ("height", "width", "channels")))


@register("process_files", f"WITH {O.EMBEDDED} SELECT source_video_id || '.y4m' AS source_video_id, frame_number, 96::BIGINT AS pixels FROM e WHERE frame_number % 2 = 0")
def process_files(spark, d):
    """Files that are decoded in the pass of the stages."""
    stages = [_Count(), _Even()]
    return FramePipeline(stages, lazy_evaluation=False, keep_frames=False).apply(VideoFiles(spark, _videos(spark, d))).select(*IDS, "pixels")


class _Count(TG.Tagger):
    fields = (T.StructField("pixels", T.LongType()),)

    def compute(self, array):
        return (array.shape[0] * array.shape[1],)


class _Even(FL.Filter):
    """A filter that is a predicate on the row alone."""

    def apply(self, df, flag=None, active=None):
        return df.where(F.col(NUMBER) % 2 == 0)


@register("extract_frames", f"WITH {O.EMBEDDED} SELECT frame_number, 288::BIGINT AS bytes FROM e WHERE source_video_id = (SELECT min(source_video_id) FROM e)")
def extract(spark, d):
    folder = _videos(spark, d)
    first = embedding_frames(spark, d).agg(F.min(VIDEO)).first()[0]
    return extract_frames(spark, f"{folder}/{first}.y4m").select(NUMBER, F.octet_length(f"{FRAME}.data").cast("long").alias("bytes"))


@register("source_missing", "SELECT * FROM (VALUES ('missing file', 'FileNotFoundError'), ('no decoder', 'RuntimeError'), ('no frames', 'TypeError')) v(source, error)")
def source_missing(spark, d):
    """What sources that can't be read raise when they are named."""
    rows = []
    for name, source in (("missing file", f"{d}/absent.y4m"), ("no decoder", f"{d}/embeddings.parquet"), ("no frames", 7)):
        try:
            frames_from(spark, [source][0] if name != "no decoder" else _undecoded(spark))
        except (FileNotFoundError, RuntimeError, TypeError) as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "source string, error string")


def _undecoded(spark) -> str:
    from reelsift.session import file_system

    path = f"{shared_dir(spark)}/reelsift-{uuid.uuid4().hex}.mov"
    files, at = file_system(path)
    with files.open_output_stream(at) as out:
        out.write(b"x")
    return path


# Extensions


class _Red(TG.Tagger):
    fields = (T.StructField("red", T.LongType()),)

    def compute(self, array):
        return (int(array[:, :, 0].astype(int).sum()),)


class _NotThird(FL.StatelessFilter):
    required_tags = ["red"]

    def condition(self) -> Column:
        return F.col("red") % 3 != 0

    def keeps(self, tags):
        return [v is not None and v % 3 != 0 for v in tags("red")]


class _Apart(D.Distance):
    """Absolute difference in thousands."""

    name = "thousands"

    def expr(self, a: Column, b: Column) -> Column:
        return F.abs(a - b) / 1000.0

    def compute(self, a, b) -> float:
        return abs(a - b) / 1000.0


class _Rising(FL.StatefulFilter):
    """Frames above the last accepted one, or far below it."""

    required_tags = ["red"]

    def payload(self, df):
        return ["red"]

    def accepts(self, value, buffer):
        return not buffer or value[0] > buffer[-1][0] or buffer[-1][0] - value[0] > 3000


class _Own(S.FilterStrategy):
    def build_pipeline(self):
        return [_Red(), _NotThird(), _Rising(3), FL.DiversityFilter(4, ["red"], 0.2, comparison_strategies={"red": _Apart()})]


_OWN_COLUMNS = "source_video_id, frame_number, red"


@register(
    "custom_stages",
    f"WITH RECURSIVE {F8}, t AS MATERIALIZED (SELECT source_video_id, frame_number, sum(red) AS red FROM f GROUP BY ALL HAVING sum(red) % 3 <> 0), "
    + O.greedy("r", "t", "red", "f.v > g.buf[len(g.buf)] OR g.buf[len(g.buf)] - f.v > 3000", 3, _OWN_COLUMNS)
    + ", "
    + O.greedy("s", "r", "red", O.none_rejects("abs(h - f.v) / 1000.0 < 0.2"), 4, _OWN_COLUMNS)
    + " SELECT source_video_id, frame_number, CAST(red AS BIGINT) AS red FROM s",
)
def custom_stages(spark, d):
    """A user's tagger, predicate, greedy filter, distance and strategy."""
    return FramePipeline(strategy=_Own()).apply(rgb_frames(spark, d, 8, 8)).select(*IDS, "red")


@register("find_similar", f"WITH {O.EVENTS} SELECT source_video_id, first(event_id ORDER BY frame_number) AS event_id FROM t WHERE value >= 30 GROUP BY source_video_id")
def find_similar(spark, d):
    """The oldest frame in a buffer that is like another one: here all frames of a video that reach a value."""

    def run(key, rows):
        buffer = TemporalBuffer(len(rows))
        for r in rows.sort_values(NUMBER).itertuples():
            buffer.add(r)
        found = buffer.find_similar(30.0, lambda least, r: r.value >= least)
        return rows.iloc[:0][[VIDEO, "event_id"]] if found is None else rows.loc[[found.Index], [VIDEO, "event_id"]]

    return event_frames(spark, d).groupBy(VIDEO).applyInPandas(run, f"{VIDEO} string, event_id long")


@register("raw_history", f"WITH {O.EVENTS} SELECT source_video_id, frame_number, round(coalesce(value - avg(value) OVER (PARTITION BY source_video_id ORDER BY frame_number ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0), 6) + 0.0 AS above FROM t")
def raw_history(spark, d):
    """How far a frame is from the mean of the raw frames before it."""
    from reelsift.operators.greedy import raw_history as history

    out = history(event_frames(spark, d), VIDEO, [NUMBER], F.avg("value"), 5, "_mean")
    return out.select(*IDS, rounded(F.coalesce(F.col("value") - F.col("_mean"), F.lit(0.0))).alias("above"))


@register("tag_classes", "SELECT * FROM (VALUES ('blur_score', 'metric_only'), ('entropy', 'metric_only'), ('edge_density', 'metric_only'), ('phash', 'diversity_suitable'), ('clip_embedding', 'diversity_suitable'), ('anything', 'diversity_suitable')) v(tag, category)")
def tag_classes(spark, d):
    from reelsift.schema import tag_category

    return spark.createDataFrame([(t, tag_category(t)) for t in ("blur_score", "entropy", "edge_density", "phash", "clip_embedding", "anything")], "tag string, category string")


# SQL functions

for _name, _payload, _sql, _function in (
    ("euclidean", "embedding", O.EUCLIDEAN, "euclidean_distance"), ("manhattan", "embedding", O.MANHATTAN, "manhattan_distance"), ("cosine", "embedding", O.COSINE, "cosine_distance"),
    ("intersection", O.HIST16, O.INTERSECTION, "intersection_distance"), ("chi_square", O.HIST16, O.CHI_SQUARE, "chi_square_distance"), ("bhattacharyya", O.HIST16, O.BHATTACHARYYA, "bhattacharyya_distance"),
):

    def _run(spark, d, payload=_payload, function=_function):
        from reelsift.functions.pixels import histogram

        register_functions(spark)
        v = F.col("clip_embedding").cast("array<double>") if payload == "embedding" else histogram(F.col("px"), 16)
        embedding_frames(spark, d).select("vec_id", v.alias("v")).createOrReplaceTempView("frame_vectors")
        return spark.sql(f"SELECT a.vec_id, round({function}(a.v, b.v), 6) + 0.0D AS distance FROM frame_vectors a JOIN frame_vectors b ON b.vec_id = a.vec_id + 1")

    register(
        f"sql_{_name}",
        f"WITH {O.PIXELS}, v AS MATERIALIZED (SELECT vec_id, {_payload} AS v FROM t) "
        f"SELECT a.vec_id, round(CAST({_sql.format(a='a.v', b='b.v')} AS DOUBLE), 6) + 0.0 AS distance FROM v a JOIN v b ON b.vec_id = a.vec_id + 1",
    )(_run)


@register("sql_hamming", f"WITH {F8}, {R.bits('b', R.AVERAGE)} SELECT a.vec_id, CAST({O.HAMMING.format(a='a.bits', b='c.bits')} AS INTEGER) AS bits FROM b a JOIN b c ON c.vec_id = a.vec_id + 1")
def sql_hamming(spark, d):
    register_functions(spark)
    _tag(lambda: TG.HashTagger("ahash"), (8, 8), "ahash")(spark, d).createOrReplaceTempView("frame_hashes")
    return spark.sql("SELECT a.vec_id, hamming_bits(a.ahash, b.ahash) AS bits FROM frame_hashes a JOIN frame_hashes b ON b.vec_id = a.vec_id + 1")


@register("video_rates", f"{_SMART}, n AS (SELECT source_video_id, count(*) AS total_frames FROM t GROUP BY ALL), p AS (SELECT source_video_id, count(*) AS c FROM s2 GROUP BY ALL) SELECT n.source_video_id, total_frames, coalesce(c, 0) AS selected_frames, total_frames - coalesce(c, 0) AS filtered_frames, round(coalesce(c, 0) * 100.0::DOUBLE / total_frames, 6) AS selection_rate FROM n LEFT JOIN p USING (source_video_id)")
def video_rates(spark, d):
    marked = _smart(keep_frames=False).annotate(rgb_frames(spark, d, 32, 32))
    return per_video_metrics(marked, "pass_5").withColumn("selection_rate", F.round("selection_rate", 6))
