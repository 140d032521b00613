"""Registered frame-selection queries and their SQL oracles.

Queries run over whole tables. Floats are rounded to six places, and negative
zeros removed, so both engines print them alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsift.functions import distance as D
from reelsift.functions import pixels
from reelsift.operators.filters import BlurFilter, DiversityFilter, DuplicateFilter, EntropyFilter, MotionFilter, QualityFilter, RangeFilter, ThresholdFilter
from reelsift.operators.greedy import native_select, window_antijoin
from reelsift.operators.taggers import BlurTagger, EntropyTagger, HashTagger
from reelsift.plans import oracles as O
from reelsift.plans.pipeline import FramePipeline, per_video_metrics
from reelsift.plans.strategies import DuplicateDetectionStrategy, SmartSamplingStrategy
from reelsift.schema import NUMBER, VIDEO
from reelsift.session import shared_dir
from reelsift.sources.tables import embedding_frames, event_frames
from reelsift.streaming.greedy_stream import greedy_stream

FLAGSHIP = "smart_sampling"
QUERIES: dict = {}
ORACLES: dict = {}
IDS = [VIDEO, NUMBER]


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(c: Column) -> Column:
    return F.round(c, 6) + 0.0


# Stateless filters over tag streams


def _threshold(op: str):
    return lambda spark, d: ThresholdFilter("value", 28.57, op).apply(event_frames(spark, d)).select(*IDS, "value")


for _name, _op in {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "==", "ne": "!="}.items():
    _sql_op = {"==": "=", "!=": "<>"}.get(_op, _op)
    register(f"threshold_{_name}", f"WITH {O.EVENTS} SELECT source_video_id, frame_number, value FROM t WHERE value {_sql_op} 28.57::DOUBLE")(_threshold(_op))


@register("range_filter", f"WITH {O.EVENTS} SELECT source_video_id, frame_number, value FROM t WHERE coalesce(value, 0) BETWEEN 20 AND 60")
def range_filter(spark, d):
    return RangeFilter("value", 20.0, 60.0, 0.0).apply(event_frames(spark, d)).select(*IDS, "value")


# Taggers


def _tagged(spark: SparkSession, d: str, *taggers) -> DataFrame:
    out = embedding_frames(spark, d)
    for t in taggers:
        out = t.apply(out)
    return out


@register("tag_blur", f"WITH {O.PIXELS} SELECT vec_id, round(blur_score, 6) + 0.0 AS blur_score FROM t")
def tag_blur(spark, d):
    return _tagged(spark, d, BlurTagger()).select("vec_id", rounded(F.col("blur_score")).alias("blur_score"))


@register("tag_entropy", f"WITH {O.PIXELS} SELECT vec_id, round(entropy, 6) + 0.0 AS entropy FROM t")
def tag_entropy(spark, d):
    return _tagged(spark, d, EntropyTagger()).select("vec_id", rounded(F.col("entropy")).alias("entropy"))


@register("tag_ahash", f"WITH {O.PIXELS} SELECT vec_id, ahash FROM t")
def tag_ahash(spark, d):
    return _tagged(spark, d, HashTagger("ahash")).select("vec_id", "ahash")


@register("tag_histogram", f"WITH {O.PIXELS} SELECT vec_id, list_sum(list_transform(range(1, 17), lambda i: i * h[i] * h[i])) AS weighed FROM (SELECT vec_id, {O.HIST16} AS h FROM t)")
def tag_histogram(spark, d):
    h = pixels.histogram(F.col("px"), 16)
    weighed = F.aggregate(F.transform(h, lambda x, i: (i + 1) * x * x), F.lit(0.0), lambda a, x: a + x)
    return embedding_frames(spark, d).select("vec_id", weighed.alias("weighed"))


@register("filter_blur", f"WITH {O.PIXELS} SELECT source_video_id, frame_number FROM t WHERE blur_score >= 60000")
def filter_blur(spark, d):
    return FramePipeline([BlurTagger(), BlurFilter(60000.0)]).apply(embedding_frames(spark, d)).select(*IDS)


@register("filter_entropy", f"WITH {O.PIXELS} SELECT source_video_id, frame_number FROM t WHERE entropy >= 5.7")
def filter_entropy(spark, d):
    return FramePipeline([EntropyTagger(), EntropyFilter(5.7)]).apply(embedding_frames(spark, d)).select(*IDS)


@register("filter_quality", f"WITH {O.PIXELS} SELECT source_video_id, frame_number FROM t WHERE blur_score >= 55000 AND entropy >= 5.65")
def filter_quality(spark, d):
    stages = [BlurTagger(), EntropyTagger(), QualityFilter({"blur_score": 55000.0, "entropy": 5.65})]
    return FramePipeline(stages).apply(embedding_frames(spark, d)).select(*IDS)


# Distances of neighbours


def _hist16() -> Column:
    return pixels.histogram(F.col("px"), 16)


def _distance(column: str, dist: D.Distance):
    def run(spark, d):
        frames = _tagged(spark, d, HashTagger("ahash"))
        frames = frames.select("vec_id", (_hist16() if column == "hist" else F.col(column)).alias("v"))
        after = frames.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
        return frames.join(after, "vec_id").select("vec_id", rounded(dist.expr(F.col("v"), F.col("w"))).alias("distance"))

    return run


for _name, _column, _dist, _payload, _sql in (
    ("hamming", "ahash", D.HammingDistance(), "bits", O.HAMMING + " / 64.0"),
    ("euclidean", "clip_embedding", D.EmbeddingDistance("euclidean"), "embedding", O.EUCLIDEAN),
    ("manhattan", "clip_embedding", D.EmbeddingDistance("manhattan"), "embedding", O.MANHATTAN),
    ("cosine", "clip_embedding", D.EmbeddingDistance("cosine"), "embedding", O.COSINE),
    ("intersection", "hist", D.HistogramDistance("intersection"), O.HIST16, O.INTERSECTION),
    ("chi_square", "hist", D.HistogramDistance("chi_square"), O.HIST16, O.CHI_SQUARE),
    ("bhattacharyya", "hist", D.HistogramDistance("bhattacharyya"), O.HIST16, O.BHATTACHARYYA),
):
    register(
        f"dist_{_name}",
        f"WITH {O.PIXELS}, v AS MATERIALIZED (SELECT vec_id, {_payload} AS v FROM t) "
        f"SELECT a.vec_id, round(CAST({_sql.format(a='a.v', b='b.v')} AS DOUBLE), 6) + 0.0 AS distance FROM v a JOIN v b ON b.vec_id = a.vec_id + 1",
    )(_distance(_column, _dist))


# Greedy selections


def _greedy_sql(source: str, payload: str, accepts: str, size: int) -> str:
    return f"WITH RECURSIVE {source}, {O.greedy('r', 't', payload, accepts, size, 'source_video_id, frame_number')} SELECT source_video_id, frame_number FROM r"


def _far(dist: str, least: float) -> str:
    return O.none_rejects(f"({dist.format(a='h', b='f.v')}) < {least}")


@register("duplicate_filter", _greedy_sql(O.PIXELS, "bits", O.none_rejects(f"{O.HAMMING.format(a='h', b='f.v')} <= 19.2"), 50))
def duplicate_filter(spark, d):
    frames = _tagged(spark, d, HashTagger("ahash")).select(*IDS, "ahash")
    return DuplicateFilter(50, 0.3, "ahash").apply(frames).select(*IDS)


def _diversity(tag: str, **options):
    def run(spark, d):
        frames = embedding_frames(spark, d).withColumn("color_hist", _hist16()).select(*IDS, tag)
        return DiversityFilter(diversity_tags=[tag], **options).apply(frames).select(*IDS)

    return run


for _name, _least, _sql in (("euclidean", 1.2, O.EUCLIDEAN), ("manhattan", 8.0, O.MANHATTAN), ("cosine", 0.8, O.COSINE)):
    register(f"diversity_{_name}", _greedy_sql(O.PIXELS, "embedding", _far(_sql, _least), 100))(
        _diversity("clip_embedding", min_distance=_least, metric=_name)
    )

register("diversity_hist", _greedy_sql(O.PIXELS, O.HIST16, _far(O.INTERSECTION, 0.25), 100))(
    _diversity("color_hist", min_distance=0.25)
)
register("diversity_value", _greedy_sql(O.EVENTS, "value", O.none_rejects("abs(h - f.v) < 1.0"), 50))(
    lambda spark, d: DiversityFilter(50, ["value"], 1.0).apply(event_frames(spark, d).select(*IDS, "value")).select(*IDS)
)


def _measured(spark, d) -> DataFrame:
    return _tagged(spark, d, BlurTagger(), EntropyTagger()).select(*IDS, "blur_score", "entropy")


_BOTH = "{'b': blur_score, 'e': entropy}"


@register("diversity_max", _greedy_sql(O.PIXELS, _BOTH, O.none_rejects("greatest(abs(h.b - f.v.b), abs(h.e - f.v.e)) < 500"), 100))
def diversity_max(spark, d):
    return DiversityFilter(100, ["blur_score", "entropy"], 500.0).apply(_measured(spark, d)).select(*IDS)


@register(
    "diversity_weighted",
    _greedy_sql(
        O.PIXELS, _BOTH,
        O.none_rejects("CASE WHEN greatest(abs(h.b - f.v.b), abs(h.e - f.v.e)) = 0 THEN 0 ELSE (0.7 * abs(h.b - f.v.b) + 0.3 * abs(h.e - f.v.e)) / greatest(abs(h.b - f.v.b), abs(h.e - f.v.e)) END < 0.700001"),
        20,
    ),
)
def diversity_weighted(spark, d):
    options = {"enable_weighted_combination": True, "tag_weights": {"blur_score": 0.7, "entropy": 0.3}}
    return DiversityFilter(20, ["blur_score", "entropy"], 0.700001, **options).apply(_measured(spark, d)).select(*IDS)


def _motion(method: str, compare: str, threshold: float):
    def run(spark, d):
        return MotionFilter(5, threshold, method, compare).apply(embedding_frames(spark, d).select(*IDS, "px")).select(*IDS)

    return run


_MEAN = "list_transform(range(1, 65), lambda i: CAST(floor(list_sum(list_transform(g.buf, lambda h: h[i])) / len(g.buf)) AS INTEGER))"
for _method, _threshold_value, _sql in (("mean_diff", 60.0, O.MEAN_DIFF), ("mse", 5000.0, O.MSE), ("histogram", 1.0, O.HISTOGRAM)):
    for _compare, _accepts in (
        ("latest", f"({_sql.format(a='f.v', b='g.buf[len(g.buf)]')}) > {_threshold_value}"),
        ("mean", f"({_sql.format(a='f.v', b='m.v')}) > {_threshold_value} FROM (SELECT {_MEAN} AS v) m"),
        ("max", f"list_max(list_transform(g.buf, lambda h: {_sql.format(a='f.v', b='h')})) > {_threshold_value}"),
    ):
        # A sub-query that selects from a derived table keeps the mean in one place.
        _accepts = f"(SELECT {_accepts})" if _compare == "mean" else _accepts
        register(f"motion_{_method}_{_compare}", _greedy_sql(O.PIXELS, "px", _accepts, 5))(_motion(_method, _compare, _threshold_value))


@register("native_greedy", _greedy_sql(O.EVENTS, "value", O.none_rejects("abs(h - f.v) < 1.0"), 50))
def native_greedy(spark, d):
    return native_select(event_frames(spark, d), VIDEO, [NUMBER], F.col("value"), lambda a, b: F.abs(a - b) < 1.0, 50).select(*IDS)


@register(
    "window_antijoin",
    f"""WITH {O.EVENTS} SELECT a.source_video_id, a.frame_number FROM t a WHERE NOT EXISTS (
SELECT 1 FROM t b WHERE b.source_video_id = a.source_video_id AND b.frame_number BETWEEN a.frame_number - 10 AND a.frame_number - 1 AND abs(a.value - b.value) < 1.0)""",
)
def raw_antijoin(spark, d):
    return window_antijoin(event_frames(spark, d), VIDEO, [NUMBER], lambda a, b: F.abs(a - b) < 1.0, F.col("value"), 10).select(*IDS)


# Strategies


@register("blur_removal", ORACLES["filter_blur"])
def blur_removal(spark, d):
    from reelsift.plans.strategies import with_blur_removal

    return with_blur_removal(threshold=60000.0).apply(embedding_frames(spark, d)).select(*IDS)


@register("duplicate_detection", ORACLES["duplicate_filter"])
def duplicate_detection(spark, d):
    frames = embedding_frames(spark, d).select(*IDS, "px")
    return FramePipeline(strategy=DuplicateDetectionStrategy(0.3, 50, "ahash")).apply(frames).select(*IDS)


SMART = {"blur_threshold": 55000.0, "duplicate_threshold": 0.3, "duplicate_window": 50, "diversity_window": 100, "diversity_min_distance": 200.0, "hash_type": "ahash"}
_COLUMNS = "source_video_id, frame_number, blur_score, entropy, bits"
_SMART_SQL = f"""WITH RECURSIVE {O.PIXELS}, b AS MATERIALIZED (SELECT {_COLUMNS} FROM t WHERE blur_score >= 55000),
{O.greedy('d', 'b', 'bits', O.none_rejects(f"{O.HAMMING.format(a='h', b='f.v')} <= 19.2"), 50, _COLUMNS)},
{O.greedy('s', 'd', _BOTH, O.none_rejects("greatest(abs(h.b - f.v.b), abs(h.e - f.v.e)) < 200"), 100, _COLUMNS)}"""


@register("smart_sampling", f"{_SMART_SQL} SELECT source_video_id, frame_number, round(blur_score, 6) + 0.0 AS blur_score, round(entropy, 6) + 0.0 AS entropy FROM s")
def smart_sampling(spark, d):
    frames = embedding_frames(spark, d).select(*IDS, "px")
    out = FramePipeline(strategy=SmartSamplingStrategy(**SMART)).apply(frames)
    return out.select(*IDS, rounded(F.col("blur_score")).alias("blur_score"), rounded(F.col("entropy")).alias("entropy"))


# Metrics

_COUNTS = "(SELECT count(*) FROM {0})"


def _stage_row(n: int, name: str, kind: str, seen: str, passed: str) -> str:
    rate = f"coalesce(round({passed} * 100.0::DOUBLE / nullif({seen}, 0), 6), 0.0)" if kind == "filter" else "0.0::DOUBLE"
    return f"SELECT {n}::INTEGER AS stage, '{name}' AS stage_name, '{kind}' AS kind, {seen} AS frames_evaluated, {passed} AS frames_passed, {seen} - {passed} AS frames_filtered, 0::BIGINT AS errors, {rate} AS pass_rate"


@register(
    "stage_metrics",
    f"{_SMART_SQL} "
    + " UNION ALL ".join(
        _stage_row(n, name, kind, _COUNTS.format(a), _COUNTS.format(b))
        for n, (name, kind, a, b) in enumerate(
            [
                ("0:BlurTagger", "tagger", "t", "t"), ("3:BlurFilter", "filter", "t", "b"), ("1:HashTagger", "tagger", "b", "b"),
                ("4:DuplicateFilter", "filter", "b", "d"), ("2:EntropyTagger", "tagger", "d", "d"), ("5:DiversityFilter", "filter", "d", "s"),
            ]
        )
    ),
)
def stage_metrics(spark, d):
    frames = embedding_frames(spark, d).select(*IDS, "px")
    out = FramePipeline(strategy=SmartSamplingStrategy(**SMART)).stage_metrics(frames)
    return out.withColumn("pass_rate", F.round("pass_rate", 6))


@register(
    "selection_rate",
    f"""{_SMART_SQL}, n AS (SELECT source_video_id, count(*) AS total_frames FROM t GROUP BY ALL), p AS (SELECT source_video_id, count(*) AS c FROM s GROUP BY ALL)
SELECT n.source_video_id, total_frames, coalesce(c, 0) AS selected_frames, total_frames - coalesce(c, 0) AS filtered_frames, round(coalesce(c, 0) * 100.0::DOUBLE / total_frames, 6) AS selection_rate
FROM n LEFT JOIN p ON n.source_video_id = p.source_video_id""",
)
def selection_rate(spark, d):
    frames = embedding_frames(spark, d).select(*IDS, "px")
    marked = FramePipeline(strategy=SmartSamplingStrategy(**SMART)).annotate(frames)
    return per_video_metrics(marked, "pass_5").withColumn("selection_rate", F.round("selection_rate", 6))


# Streaming


@register("stream_diversity", f"WITH RECURSIVE {O.EVENTS}, {O.greedy('r', 't', 'value', O.none_rejects('abs(h - f.v) < 1.0'), 50, 'source_video_id, frame_number, event_id')} SELECT source_video_id, event_id FROM r")
def stream_diversity(spark, d):
    """The greedy selection as a streaming query over the events, run until the table is read."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # As a pattern the path may be one file or a folder of files.
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    rows = events.select(F.col("user_id").cast("string").alias(VIDEO), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("place"), "value")
    held = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(held)
    spark.conf.set(held, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    try:
        chosen = greedy_stream(rows, VIDEO, ["place", "event_id"], "value", lambda v, buffer: min(abs(v - h) for h in buffer) >= 1.0, 50)
        query = chosen.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(held, before)
    return spark.read.schema(rows.schema).parquet(f"{at}/rows").select(VIDEO, "event_id")
