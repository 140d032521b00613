"""Filters, the greedy operator in all its forms, and pipelines."""

import datetime as dt
from collections import deque

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelsift.errors import ConfigurationError
from reelsift.functions import distance as D
from reelsift.operators import filters as FL
from reelsift.operators.greedy import TemporalBuffer, greedy_select, native_select
from reelsift.operators.taggers import BlurTagger, EdgeDensityTagger, EmbeddingTagger, EntropyTagger, HashTagger, MomentsTagger, Tagger
from reelsift.plans import strategies as S
from reelsift.plans.metrics import MetricsCollector
from reelsift.plans.pipeline import FramePipeline
from reelsift.schema import FRAME_SCHEMA, frame_row, get_tag, has_tags, tag_category

NAN = float("nan")
TAGS = "source_video_id string, frame_number long, blur_score double, entropy double, phash string"


def tags(spark, rows):
    return spark.createDataFrame([("v", i, *r) if not isinstance(r[0], str) or len(r) < 4 else r for i, r in enumerate(rows)], TAGS)


def passed(df):
    return sorted(r.frame_number for r in df.collect())


@pytest.mark.parametrize(("op", "want"), [(">", [0]), ("<", [2]), (">=", [0, 1]), ("<=", [1, 2]), ("==", [1]), ("!=", [0, 2, 4])])
def test_threshold_filter(spark, op, want):
    df = tags(spark, [(x, 0.0, None) for x in (150.0, 100.0, 50.0, None, NAN)])
    assert passed(FL.ThresholdFilter("blur_score", 100.0, op).apply(df)) == want


def test_stateless_filters(spark):
    df = tags(spark, [(150.0, 5.0, None), (100.0, 4.0, None), (50.0, 3.9, None), (None, None, None)])
    assert passed(FL.BlurFilter().apply(df)) == [0, 1] and passed(FL.EntropyFilter().apply(df)) == [0, 1]
    assert passed(FL.RangeFilter("entropy", 3.9, 4.0).apply(df)) == [1, 2] and passed(FL.RangeFilter("entropy", 0, 4, 0.0).apply(df)) == [1, 2, 3]
    assert passed(FL.QualityFilter({"blur_score": 100, "entropy": 0}).apply(df)) == [0, 1]
    for bad in (lambda: FL.BlurFilter(-1), lambda: FL.EntropyFilter(-1), lambda: FL.ThresholdFilter("a", 1, "~")):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize(
    ("values", "size", "least", "want"),
    [((100, 105), 9, 10, [0]), ((100, 150), 9, 10, [0, 1]), ((0, 5, 0), 1, 1, [0, 1, 2]), ((0, 5, 0), 2, 1, [0, 1]), ((100, None), 9, 10, [0]), ((None, 100), 9, 10, [0]), ((NAN, 1, 2), 9, 10, [0])],
)
def test_diversity_of_one_tag(spark, values, size, least, want):
    df = tags(spark, [(None if v is None else float(v), 0.0, None) for v in values])
    assert passed(FL.DiversityFilter(size, ["blur_score"], least).apply(df)) == want


def test_diversity_options(spark):
    df = tags(spark, [(1.0, 1.0, "00"), (1.0, 9.0, "ff"), (1.5, 1.0, "01")])
    assert passed(FL.DiversityFilter(9, None, 5.0).apply(df)) == [0, 1, 2]  # no tags: all pass
    weighted = FL.DiversityFilter(9, ["blur_score", "entropy"], 0.6, enable_weighted_combination=True, tag_weights={"entropy": 2.0})
    assert passed(weighted.apply(df)) == [0, 1]
    one = FL.DiversityFilter(9, ["blur_score"], 0.5, enable_weighted_combination=True)
    assert one.distance((3.0,), (3.0,)) == 0 and one.distance((3.0,), (3.1,)) == 1
    assert FL.DiversityFilter(9, ["phash"]).distance(("zz",), ("00",)) == 0  # a failing distance is passed over
    assert isinstance(FL.DiversityFilter(9, ["phash"]).distance_of("phash"), D.HammingDistance)
    for bad in ({"metric": "x"}, {"min_distance": -1}, {"comparison_strategies": {"a": 1}}, {"buffer_size": 0}):
        with pytest.raises(ValueError):
            FL.DiversityFilter(**bad)


def test_duplicates(spark):
    h = "00000000000000"
    df = tags(spark, [(0.0, 0.0, h + "00"), (0.0, 0.0, h + "00"), (0.0, 0.0, h + "07"), (0.0, 0.0, h + "0f"), (0.0, 0.0, None)])
    assert passed(FL.DuplicateFilter().apply(df)) == [0, 3]  # three bits are near, four are not
    assert passed(FL.DuplicateFilter().apply(tags(spark, [(0.0, 0.0, None), (0.0, 0.0, h + "00")]))) == [0, 1]
    with pytest.raises(ValueError):
        FL.DuplicateFilter(threshold=2)


def test_motion(spark):
    px = [[0] * 64, [0] * 64, [255] * 64, [250] * 64, [0] * 64]
    df = spark.createDataFrame([("v", i, p) for i, p in enumerate(px)], "source_video_id string, frame_number long, px array<int>")
    assert passed(FL.MotionFilter(5, 10.0).apply(df)) == [0, 2, 4]
    assert passed(FL.MotionFilter(1, 10.0, compare_with="max").apply(df)) == [0, 2, 4]
    assert passed(FL.MotionFilter(5, 130.0, compare_with="mean").apply(df)) == [0, 2]  # of 0 and 255 the mean is 127
    assert passed(FL.MotionFilter(5, 100.0, "mse").apply(df)) == [0, 2, 4]
    for bad in ({"method": "x"}, {"compare_with": "x"}, {"buffer_size": 0}):
        with pytest.raises(ValueError):
            FL.MotionFilter(**bad)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.sampled_from([None, NAN, 0.0, 1.0, 2.5, float("inf"), -1.0])] * 2), min_size=1, max_size=30))
def test_conditions_equal_their_twins(spark, rows):
    """Every predicate says the same as an expression and beside Python taggers, for null and NaN, too."""
    df = tags(spark, [(*r, None) for r in rows])
    predicates = [FL.ThresholdFilter("blur_score", 1.0, op) for op in FL.ThresholdFilter.OPS]
    predicates += [FL.RangeFilter("entropy", 0.0, 2.5), FL.RangeFilter("entropy", 0.0, 2.5, 1.0), FL.QualityFilter({"blur_score": 1.0, "entropy": 0.0}), FL.QualityFilter({"blur_score": -5.0})]
    held = {"blur_score": [r[0] for r in rows], "entropy": [r[1] for r in rows]}
    for p in predicates:
        assert passed(p.apply(df)) == [i for i, k in enumerate(p.keeps(held.get)) if k], (p.name, vars(p))


def simulate(rows, size, least):
    out, buffers = [], {}
    for key, n, v in sorted(rows):
        b = buffers.setdefault(key, deque(maxlen=size))
        if all(abs(v - h) >= least for h in b):
            b.append(v)
            out.append((key, n))
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 30)), max_size=60), st.integers(1, 6), st.integers(0, 5))
def test_greedy_forms_agree(spark, values, size, least):
    rows = [(k, i, float(v)) for i, (k, v) in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, n long, v double").repartition(3)
    want = sorted(simulate(rows, size, least))
    streamed = greedy_select(df, "k", ["n"], ["v"], lambda x, b: all(abs(x[0] - h[0]) >= least for h in b), size)
    assert sorted((r.k, r.n) for r in streamed.collect()) == want
    native = native_select(df, "k", ["n"], F.col("v"), lambda a, b: F.abs(a - b) < least, size)
    assert sorted((r.k, r.n) for r in native.collect()) == want


def test_streams_are_apart_unless_asked(spark):
    df = spark.createDataFrame([("a", 0, 5.0), ("b", 1, 5.0), ("a", 2, 5.0), (None, 3, 5.0)], "source_video_id string, frame_number long, blur_score double")
    assert passed(FL.DiversityFilter(9, ["blur_score"], 1.0).apply(df)) == [0, 1, 3]
    assert passed(FL.DiversityFilter(9, ["blur_score"], 1.0, state_key=None).apply(df)) == [0]


def test_temporal_buffer():
    b = TemporalBuffer(2)
    assert not b and b.find_similar(1, lambda x, y: True) is None
    for x in (1, 2, 3):
        b.add(x)
    assert b.get_window() == [2, 3] and b.is_full() and len(b) == 2 and b.find_similar(3, lambda x, y: x > 0) == 2
    b.clear()
    assert not b
    with pytest.raises(ValueError):
        TemporalBuffer(0)


def frames(spark, arrays, video="v"):
    return spark.createDataFrame([frame_row(a, i, dt.timedelta(seconds=i / 30), video) for i, a in enumerate(arrays)], FRAME_SCHEMA)


def sharp(seed):
    a = np.random.default_rng(seed).integers(0, 256, (60, 60, 3), dtype=np.uint8)
    a[20:40], a[:, 20:40] = 255, 0
    return a


BLURRY = np.full((60, 60, 3), 128, np.uint8)


def test_pipeline_keeps_sharp_frames_in_order(spark):
    df = frames(spark, [sharp(0), BLURRY, sharp(1), BLURRY, sharp(2)])
    for lazy in (True, False):
        out, result = FramePipeline([BlurTagger(), EntropyTagger(), HashTagger(), FL.BlurFilter(50.0)], lazy_evaluation=lazy).process(df)
        assert [r.frame_number for r in out.collect()] == [0, 2, 4]
        assert ("phash" in out.columns) == (not lazy)
        result.refresh()
        assert (result.total_frames, result.selected_frames, result.filtered_frames, result.selection_rate) == (5, 3, 2, 60.0)
        assert result.get_summary()["stages"][-1]["frames_filtered"] == 2 and result.throughput > 0
    result.print_summary()
    assert FramePipeline([BlurTagger()]).apply(df).where("blur_score IS NOT NULL").count() == 5 and FramePipeline().apply(df).count() == 5


def test_pipeline_short_circuits(spark):
    """A tagger that a later filter needs measures only what passed before."""
    plan = S.with_smart_sampling(diversity_min_distance=0.0).plan()
    assert [i for i, _ in plan] == [0, 3, 1, 4, 2, 5]
    df = frames(spark, [sharp(0), BLURRY, sharp(0), sharp(5)])
    out = S.with_smart_sampling().apply(df)
    assert passed(out) == [0, 3]
    assert passed(S.with_duplicate_detection(keep_frames=False).apply(df)) == [0, 1, 3]
    assert passed(S.with_blur_removal(threshold=50.0, n_workers=2).apply(df)) == [0, 2, 3]


def test_one_pass_equals_stage_by_stage(spark):
    """The fused pass gives the rows, tags and errors of stages that are applied one by one."""
    df = frames(spark, [sharp(0), BLURRY, sharp(1), BLURRY // 2, sharp(0)[:, :, 0]])
    stages = [BlurTagger(), Failing(), FL.ThresholdFilter("blur_score", 0.5, ">="), EntropyTagger(), FL.RangeFilter("entropy", -1, 9), MomentsTagger(), FL.QualityFilter({"blur_score": 1.0})]
    fused = FramePipeline(stages, lazy_evaluation=False, keep_frames=False).apply(df)
    apart = df
    for s in stages:
        apart = s.apply(apart, label=f"{stages.index(s)}:{s.name}") if isinstance(s, Tagger) else s.apply(apart)
    names = ["frame_number", "blur_score", "entropy", "model_embedding", "_errors"]
    assert "frame" not in fused.columns
    assert sorted(map(repr, fused.select(names).collect())) == sorted(map(repr, apart.select(names).collect()))


def test_validation():
    for bad in ([FL.BlurFilter()], [FL.BlurFilter(), BlurTagger()], ["stage"], [BlurTagger(), FL.EntropyFilter()]):
        with pytest.raises(ConfigurationError):
            FramePipeline(bad)
    for bad in (lambda: FramePipeline(n_workers=0), lambda: HashTagger("x"), lambda: S.BlurRemovalStrategy(-1), lambda: S.DuplicateDetectionStrategy(2), lambda: S.SmartSamplingStrategy(duplicate_window=0), lambda: S.AdaptiveSamplingStrategy(duplicate_threshold=2), lambda: FramePipeline(gpu_batch_size=0)):
        with pytest.raises(ValueError):
            bad()
    for good in (S.HighQualityStrategy(), S.AdaptiveSamplingStrategy(), S.ThresholdStrategy(BlurTagger(), "blur_score", 1), S.TaggedRangeStrategy(EdgeDensityTagger(), "edge_density", 0, 1)):
        FramePipeline(strategy=good)
    auto = FL.DiversityFilter()
    FramePipeline([HashTagger("phash"), BlurTagger(), MomentsTagger(), auto])
    assert auto.tags() == ["phash", "model_embedding"]


class Failing2(Tagger):
    fields = BlurTagger.fields
    name = "Failing"

    def compute(self, array):
        raise ValueError("never works")


class Failing(Tagger):
    fields = BlurTagger.fields

    def compute(self, array):
        if array.mean() > 127:
            raise RuntimeError("too bright")
        return (1.0,)


def test_failing_taggers_and_models(spark):
    df = frames(spark, [BLURRY, BLURRY // 2])
    rows = Failing().apply(df).orderBy("frame_number").collect()
    assert [r.blur_score for r in rows] == [None, 1.0] and rows[0]._errors == ["Failing: too bright"] and rows[1]._errors == []
    metrics = FramePipeline([Failing(), FL.BlurFilter(0.0)]).stage_metrics(df).orderBy("stage").collect()
    assert [(m.errors, m.frames_passed) for m in metrics] == [(1, 2), (0, 1)]

    # A tagger after a filter sees what the filter left, and two of a class are counted apart.
    stages = [BlurTagger(), FL.BlurFilter(50.0), Failing(), EdgeDensityTagger(), Failing2(), FL.ThresholdFilter("blur_score", 0.0)]
    df2 = frames(spark, [sharp(0), BLURRY, BLURRY, BLURRY])
    p = FramePipeline(stages, lazy_evaluation=False)
    metrics = p.stage_metrics(df2).orderBy("stage").collect()
    assert [(m.frames_evaluated, m.errors) for m in metrics] == [(4, 0), (4, 0), (1, 0), (1, 0), (1, 1), (1, 0)]
    out, result = p.process(df2)
    assert not result.finished() and out.count() == 0
    assert [(s["frames_evaluated"], s["errors"]) for s in result.refresh().stages] == [(m.frames_evaluated, m.errors) for m in metrics]

    def broken():
        raise RuntimeError("no device")

    model = EmbeddingTagger(broken, batch_size=1, fallback=lambda: lambda arrays: [[3.0, 4.0] for _ in arrays], max_failures=1)
    assert [r.clip_embedding for r in model.apply(df).collect()] == [[pytest.approx(0.6), pytest.approx(0.8)]] * 2
    assert model.compute(BLURRY) and model.stats == {"batches": 1, "failures": 1, "fallback_batches": 1}
    with pytest.raises(RuntimeError):
        EmbeddingTagger(broken).compute(BLURRY)


def test_rows_and_tags(spark):
    for bad, error in (("x", TypeError), (np.zeros(3), ValueError), (np.zeros((2, 2, 5)), ValueError)):
        with pytest.raises(error):
            frame_row(bad, 0, dt.timedelta(0), "v")
    for args, error in (((-1, dt.timedelta(0), "v"), ValueError), ((0, 1.0, "v"), TypeError), ((0, dt.timedelta(0), " "), ValueError), ((0, dt.timedelta(0), "v", 1), TypeError)):
        with pytest.raises(error):
            frame_row(np.zeros((2, 2)), *args)
    df = tags(spark, [(1.0, None, None)])
    assert df.select(get_tag(df, "entropy", 7.0).alias("x"), get_tag(df, "other", 3).alias("y")).first()[:] == (7.0, 3)
    assert has_tags(df, ["entropy"]) and not has_tags(df, ["other"]) and tag_category("blur_score") == "metric_only" and tag_category("new") == "diversity_suitable"


def test_endless_iterators_and_files(spark, tmp_path):
    """An iterator that never ends is taken frame by frame; files are decoded in the pass of the stages."""
    import itertools

    from reelsift.sources.video import VideoFiles, frames_from, load_video_frames

    endless = (frame_row(sharp(i) if i % 3 else BLURRY, i, dt.timedelta(0), "v") for i in itertools.count())
    got = list(itertools.islice(S.with_smart_sampling().process_iterator(endless), 4))
    assert [r["frame_number"] for r in got][:2] == [1, 2] and all(r["phash"] for r in got)
    np.save(tmp_path / "a.npy", np.stack([sharp(0), BLURRY, sharp(1)]))
    np.save(tmp_path / "b.npy", np.stack([BLURRY, BLURRY, sharp(2)]))
    for keep in (True, False):
        p = FramePipeline([BlurTagger(), HashTagger(), FL.BlurFilter(50.0)], keep_frames=keep)
        files = VideoFiles(spark, str(tmp_path), fps=30)
        want = sorted((r.source_video_id, r.frame_number, r.timestamp, r.blur_score) for r in p.apply(load_video_frames(spark, str(tmp_path), fps=30)).collect())
        out, result = p.process(files)
        rows = out.collect()
        assert sorted((r.source_video_id, r.frame_number, r.timestamp, r.blur_score) for r in rows) == want and len(want) == 3
        assert ("frame" in out.columns) == keep and result.refresh().total_frames == 6 and result.selected_frames == 3
    assert rows[0].additional_metadata["raw_frame_index_from_loader"] == str(rows[0].frame_number)
    one = frame_row(BLURRY, 7, dt.timedelta(seconds=1, microseconds=5), "v", {"a": "b"})
    stored = frames_from(spark, iter([one])).first()
    assert (stored.frame_number, stored.timestamp, stored.additional_metadata, bytes(stored.frame.data)) == (7, one[2], {"a": "b"}, one[3][3])


def test_clip_tagger_and_faces(spark):
    from reelsift.errors import GPUDependencyError
    from reelsift.operators.taggers import CLIPTagger, FaceDetectionTagger, SaturationTagger

    asked = []
    tagger = CLIPTagger(lambda *a: asked.append(a) or (lambda arrays: np.ones((len(arrays), 4))))
    assert tagger.compute(BLURRY)[0] == [0.5] * 4 and asked == [("MobileCLIP-S1", "datacompdr", "cpu")]
    with pytest.raises(GPUDependencyError):
        CLIPTagger(lambda *a: None, device="cuda")
    with pytest.raises(GPUDependencyError):
        FramePipeline(use_gpu=True)
    FramePipeline([tagger], gpu_batch_size=3)
    assert tagger.batch_size == 3
    assert FaceDetectionTagger(lambda: lambda a: [(1, 2, 3, 4)]).compute(BLURRY) == (1, [[1, 2, 3, 4]], True)
    assert SaturationTagger().compute(BLURRY) == (0.0,) and SaturationTagger().compute(np.array([[[255, 0, 0]]], np.uint8)) == (1.0,)


def test_temporal_smoothing_in_a_pipeline(spark):
    df = tags(spark, [(x, 0.0, None) for x in (150.0, 160.0, 50.0, 150.0, 150.0, 150.0, None)])
    assert passed(FL.TemporalSmoothingFilter("blur_score", 100.0, 2).apply(df)) == [1, 4, 5]
    with pytest.raises(ValueError):
        FL.TemporalSmoothingFilter(min_consecutive=0)


def test_metrics_collector():
    m = MetricsCollector()
    m.start_stage("a")
    m.end_stage("a")
    m.record_filter("a", True)
    m.record_filter("a", False)
    m.record_filter("a", False, error=True)
    m.record_tagger("t", error=True)
    m.total_frames, m.selected_frames, m.processed_frames = 4, 1, 4
    s = m.finalize().get_summary()
    assert s["stages"]["a"]["pass_rate"] == pytest.approx(100 / 3) and s["stages"]["a"]["errors"] == 1 and s["stages"]["t"]["error_rate"] == 100 and s["selection_rate"] == 25
