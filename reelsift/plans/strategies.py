"""Named pipelines. The defaults of their parameters are fixed values."""

from __future__ import annotations

from reelsift.operators.filters import BlurFilter, DiversityFilter, DuplicateFilter, FaceFilter, QualityFilter, RangeFilter, SceneChangeFilter, ThresholdFilter
from reelsift.operators.taggers import BlurTagger, EdgeDensityTagger, EntropyTagger, FaceDetectionTagger, HashTagger
from reelsift.plans.pipeline import FramePipeline


def _not_negative(**values) -> None:
    for name, v in values.items():
        if v < 0:
            raise ValueError(f"{name} must not be negative")


class FilterStrategy:
    """Builds a list of stages."""

    def build_pipeline(self) -> list:
        raise NotImplementedError


class BlurRemovalStrategy(FilterStrategy):
    """Keeps sharp frames."""

    def __init__(self, threshold: float = 100.0):
        _not_negative(threshold=threshold)
        self.threshold = threshold

    def build_pipeline(self):
        return [BlurTagger(), BlurFilter(self.threshold)]


class DuplicateDetectionStrategy(FilterStrategy):
    """Keeps frames that don't look like one of the last accepted ones."""

    def __init__(self, threshold: float = 0.05, window_size: int = 50, hash_type: str = "phash", hash_size: int = 8):
        if not 0 <= threshold <= 1:
            raise ValueError("threshold must be within 0 and 1")
        if window_size <= 0 or hash_size <= 0:
            raise ValueError("window_size and hash_size must be above zero")
        self.threshold, self.window_size, self.hash_type, self.hash_size = threshold, window_size, hash_type, hash_size

    def build_pipeline(self):
        return [HashTagger(self.hash_type, self.hash_size), DuplicateFilter(self.window_size, self.threshold, self.hash_type, self.hash_size)]


class SmartSamplingStrategy(FilterStrategy):
    """Sharp frames, without near duplicates, that differ in sharpness or entropy."""

    def __init__(self, blur_threshold=100.0, duplicate_threshold=0.05, duplicate_window=50, diversity_window=100, diversity_min_distance=0.1, hash_type="phash"):
        _not_negative(blur_threshold=blur_threshold, diversity_min_distance=diversity_min_distance)
        if not 0 <= duplicate_threshold <= 1:
            raise ValueError("duplicate_threshold must be within 0 and 1")
        if duplicate_window <= 0 or diversity_window <= 0:
            raise ValueError("windows must be above zero")
        self.blur_threshold, self.duplicate_threshold, self.duplicate_window = blur_threshold, duplicate_threshold, duplicate_window
        self.diversity_window, self.diversity_min_distance, self.hash_type = diversity_window, diversity_min_distance, hash_type

    def build_pipeline(self):
        return [
            BlurTagger(),
            HashTagger(self.hash_type, 8),
            EntropyTagger(),
            BlurFilter(self.blur_threshold),
            DuplicateFilter(self.duplicate_window, self.duplicate_threshold, self.hash_type, 8),
            DiversityFilter(self.diversity_window, ["blur_score", "entropy"], self.diversity_min_distance, "euclidean"),
        ]


class HighQualityStrategy(FilterStrategy):
    """Sharp frames with much information and many edges."""

    def __init__(self, blur_threshold: float = 150.0, entropy_threshold: float = 5.0, edge_threshold: float = 0.15):
        _not_negative(blur_threshold=blur_threshold, entropy_threshold=entropy_threshold, edge_threshold=edge_threshold)
        self.least = {"blur_score": blur_threshold, "entropy": entropy_threshold, "edge_density": edge_threshold}

    def build_pipeline(self):
        return [BlurTagger(), EntropyTagger(), EdgeDensityTagger(), QualityFilter(self.least)]


class AdaptiveSamplingStrategy(FilterStrategy):
    """Sharp frames at which the scene changes, without near duplicates."""

    def __init__(self, base_threshold: float = 100.0, duplicate_threshold: float = 0.05, scene_change_threshold: float = 0.3):
        _not_negative(base_threshold=base_threshold, scene_change_threshold=scene_change_threshold)
        if not 0 <= duplicate_threshold <= 1:
            raise ValueError("duplicate_threshold must be within 0 and 1")
        self.base, self.duplicate, self.scene = base_threshold, duplicate_threshold, scene_change_threshold

    def build_pipeline(self):
        return [BlurTagger(), HashTagger(), BlurFilter(self.base), SceneChangeFilter(threshold=self.scene), DuplicateFilter(50, self.duplicate)]


class FaceDetectionStrategy(FilterStrategy):
    """Sharp frames with faces; ``load`` gives the detector."""

    def __init__(self, load, min_faces: int = 1, blur_threshold: float = 100.0):
        _not_negative(min_faces=min_faces, blur_threshold=blur_threshold)
        self.load, self.min_faces, self.blur = load, min_faces, blur_threshold

    def build_pipeline(self):
        return [BlurTagger(), FaceDetectionTagger(self.load), BlurFilter(self.blur), FaceFilter(self.min_faces)]


class TaggedRangeStrategy(FilterStrategy):
    """A tagger and an inclusive range of one of its tags, a number of faces for instance."""

    def __init__(self, tagger, tag_key: str, low: float, high: float, missing: float = 0.0):
        self.stages = [tagger, RangeFilter(tag_key, low, high, missing)]

    def build_pipeline(self):
        return list(self.stages)


class ThresholdStrategy(FilterStrategy):
    """A tagger and a threshold on one of its tags."""

    def __init__(self, tagger, tag_key: str, threshold: float, operator: str = ">"):
        self.stages = [tagger, ThresholdFilter(tag_key, threshold, operator)]

    def build_pipeline(self):
        return list(self.stages)


_RUN = ("n_workers", "use_gpu", "gpu_batch_size", "lazy_evaluation", "release_memory", "keep_frames")


def _split(options: dict) -> tuple[dict, dict]:
    return {k: v for k, v in options.items() if k not in _RUN}, {k: v for k, v in options.items() if k in _RUN}


def with_blur_removal(**options) -> FramePipeline:
    own, run = _split(options)
    return FramePipeline(strategy=BlurRemovalStrategy(**own), **run)


def with_duplicate_detection(**options) -> FramePipeline:
    own, run = _split(options)
    return FramePipeline(strategy=DuplicateDetectionStrategy(**own), **run)


def with_smart_sampling(**options) -> FramePipeline:
    own, run = _split(options)
    return FramePipeline(strategy=SmartSamplingStrategy(**own), **run)
