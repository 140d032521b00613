"""Taggers: projections that add tag columns to frames.

A frame's pixels are either a struct column ``frame`` (measured by Arrow-batched
numpy code) or, for small gray frames, an integer array ``px`` of a given shape
(measured by Catalyst expressions). Python taggers are marked as
nondeterministic, so Catalyst keeps them where the plan puts them, between
filters, and still drops them when nothing reads their tags.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelsift.functions import images, pixels
from reelsift.operators.devices import choose_device
from reelsift.schema import FRAME, to_array

PX = "px"


class Tagger:
    """Adds ``fields`` to a frame. Subclasses give ``compute`` (one array to a tuple of tag values)."""

    fields: tuple[T.StructField, ...] = ()
    requires_gpu = supports_gpu = False

    @property
    def tag_keys(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def name(self) -> str:
        return type(self).__name__

    def compute(self, array: np.ndarray) -> tuple:
        raise NotImplementedError

    def compute_batch(self, arrays: list[np.ndarray]) -> list[tuple | Exception]:
        """Tag values of each frame; a frame that fails has the exception instead."""
        out: list[tuple | Exception] = []
        for a in arrays:
            try:
                out.append(self.compute(a))
            except Exception as e:  # a failing frame goes on without the tags
                out.append(e)
        return out

    def native(self, df: DataFrame) -> dict | None:
        """Tag expressions for ``px`` frames, if there are such."""
        return None

    def apply(self, df: DataFrame, active: str | None = None, label: str | None = None) -> DataFrame:
        """``df`` with the tags and, for Python taggers, messages of failures in ``_errors``.

        active: a boolean column; where it isn't true the frame isn't measured
        and has no tags. label: what messages begin with, the tagger's name
        unless given.
        """
        if PX in df.columns and FRAME not in df.columns:
            found = self.native(df)
            if found is None:
                raise TypeError(f"{self.name} needs a {FRAME} column")
            return df.withColumns({k: F.when(F.col(active), e) for k, e in found.items()} if active else found)
        label = label or self.name
        kind = T.StructType([*self.fields, T.StructField("_error", T.StringType())])
        tagger = self

        @F.pandas_udf(kind)
        def measure(frames: pd.DataFrame, on: pd.Series) -> pd.DataFrame:
            none = (None,) * len(tagger.fields)
            rows, places, arrays = [(*none, None)] * len(on), [], []
            for i, (r, use) in enumerate(zip(frames.itertuples(index=False), on, strict=True)):
                if use:
                    try:
                        arrays.append(to_array(dict(zip(frames.columns, r, strict=True))))
                        places.append(i)
                    except (TypeError, ValueError) as e:
                        rows[i] = (*none, str(e))
            for i, r in zip(places, tagger.compute_batch(arrays), strict=True):
                rows[i] = (*none, str(r)) if isinstance(r, Exception) else (*r, None)
            return pd.DataFrame(rows, columns=kind.names).astype(object)

        on = F.coalesce(F.col(active), F.lit(False)) if active else F.lit(True)
        made = df.withColumn("_tags", measure.asNondeterministic()(F.when(on, F.col(FRAME)), on))
        error = F.when(F.col("_tags._error").isNotNull(), F.array(F.concat(F.lit(f"{label}: "), F.col("_tags._error")))).otherwise(F.array().cast("array<string>"))
        before = F.col("_errors") if "_errors" in df.columns else F.array().cast("array<string>")
        columns = {f.name: F.col(f"_tags.{f.name}") for f in self.fields} | {"_errors": F.concat(before, error)}
        return made.withColumns(columns).drop("_tags")


class _Small(Tagger):
    """A tagger that also has expressions for ``px`` frames of a known shape."""

    def __init__(self, height: int = 8, width: int = 8):
        self.height, self.width = height, width


class BlurTagger(_Small):
    """``blur_score``: variance of the Laplacian; low for blurred frames."""

    fields = (T.StructField("blur_score", T.DoubleType()),)

    def compute(self, array):
        return (images.blur_score(array),)

    def native(self, df):
        return {"blur_score": pixels.blur_score(F.col(PX), self.height, self.width)}


class EntropyTagger(_Small):
    """``entropy``: Shannon entropy of the gray values."""

    fields = (T.StructField("entropy", T.DoubleType()),)

    def compute(self, array):
        return (images.entropy(array),)

    def native(self, df):
        return {"entropy": pixels.entropy(F.col(PX))}


class HashTagger(Tagger):
    """A perceptual hash as hex under its own name, and as ``hash_value``."""

    def __init__(self, hash_type: str = "phash", hash_size: int = 8, highfreq_factor: int = 4):
        if hash_type not in images.HASHES:
            raise ValueError(f"hash type must be one of {sorted(images.HASHES)}, not {hash_type!r}")
        self.hash_type, self.hash_size, self.highfreq_factor = hash_type, hash_size, highfreq_factor
        self.fields = (T.StructField(hash_type, T.StringType()), T.StructField("hash_value", T.StringType()))

    def compute(self, array):
        h = images.image_hash(array, self.hash_type, self.hash_size)
        return h, h

    def native(self, df):
        if self.hash_type != "ahash" or self.hash_size != 8:
            return None
        h = pixels.average_hash(F.col(PX))
        return {"ahash": h, "hash_value": h}


class ColorHistogramTagger(Tagger):
    """``color_hist``: hue, saturation and value histograms."""

    fields = (T.StructField("color_hist", T.ArrayType(T.DoubleType())),)

    def __init__(self, bins: int = 32):
        self.bins = bins

    def compute(self, array):
        return (images.color_histogram(array, self.bins).tolist(),)


class DominantColorTagger(Tagger):
    """``color_histogram`` of each channel, and the truncated mean colour."""

    fields = (T.StructField("color_histogram", T.ArrayType(T.DoubleType())), T.StructField("dominant_color", T.ArrayType(T.IntegerType())))

    def __init__(self, bins: int = 32):
        self.bins = bins

    def compute(self, array):
        channels = [array] if array.ndim == 2 else [array[:, :, i] for i in range(array.shape[2])]
        counts = np.concatenate([np.histogram(c, self.bins, (0, 256))[0] for c in channels]).astype(float)
        return (counts / max(counts.sum(), 1)).tolist(), [int(c.mean()) for c in channels]


class SaturationTagger(Tagger):
    """``saturation``: mean saturation, 0 to 1; 0 for gray frames."""

    fields = (T.StructField("saturation", T.DoubleType()),)

    def compute(self, array):
        return (images.saturation(array),)


class FaceDetectionTagger(Tagger):
    """``face_count``, ``face_boxes`` and ``has_faces`` of a detector that is loaded once in each worker.

    load: gives a function from an array to (x, y, width, height) boxes. No
    detector comes with the package.
    """

    fields = (T.StructField("face_count", T.IntegerType()), T.StructField("face_boxes", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("has_faces", T.BooleanType()))

    def __init__(self, load: Callable):
        self.load, self._detect = load, None

    def __getstate__(self):
        return self.__dict__ | {"_detect": None}

    def compute(self, array):
        if self._detect is None:
            self._detect = self.load()
        boxes = [[int(x) for x in box] for box in self._detect(array)]
        return len(boxes), boxes, bool(boxes)


class EdgeDensityTagger(Tagger):
    """``edge_density`` and ``edge_count``."""

    fields = (T.StructField("edge_density", T.DoubleType()), T.StructField("edge_count", T.LongType()))

    def __init__(self, low: float = 50, high: float = 150):
        self.low, self.high = low, high

    def compute(self, array):
        return images.edge_density(array, self.low, self.high)


class MomentsTagger(Tagger):
    """``model_embedding``: mean and deviation of each channel."""

    fields = (T.StructField("model_embedding", T.ArrayType(T.DoubleType())),)

    def compute(self, array):
        return (images.mean_and_deviation(array).tolist(),)


class EmbeddingTagger(Tagger):
    """Unit vectors of a model that is loaded once in each worker.

    load: gives a function from a list of arrays to an array of vectors. A batch
    that fails on the accelerator is tried by ``fallback`` instead; after
    ``max_failures`` of those only the fallback is used.
    """

    supports_gpu = True

    def __init__(self, load: Callable, tag: str = "clip_embedding", batch_size: int = 32, fallback: Callable | None = None, max_failures: int = 3):
        if batch_size < 1:
            raise ValueError("batch_size must be 1 at least")
        self.load, self.tag, self.batch_size = load, tag, batch_size
        self.fallback, self.max_failures = fallback, max_failures
        self.fields = (T.StructField(tag, T.ArrayType(T.FloatType())),)
        self._models: dict = {}
        self.stats = {"batches": 0, "failures": 0, "fallback_batches": 0}

    def __getstate__(self):
        return self.__dict__ | {"_models": {}}

    def _model(self, load: Callable) -> Callable:
        if load not in self._models:
            self._models[load] = load()
        return self._models[load]

    def _run(self, arrays: list[np.ndarray]) -> np.ndarray:
        self.stats["batches"] += 1
        if self.fallback is None or self.stats["failures"] < self.max_failures:
            try:
                return np.asarray(self._model(self.load)(arrays), float)
            except Exception:
                self.stats["failures"] += 1
                if self.fallback is None:
                    raise
        self.stats["fallback_batches"] += 1
        return np.asarray(self._model(self.fallback)(arrays), float)

    def compute(self, array):
        result = self.compute_batch([array])[0]
        if isinstance(result, Exception):
            raise result
        return result

    def compute_batch(self, arrays):
        out: list[tuple | Exception] = []
        for at in range(0, len(arrays), self.batch_size):
            some = arrays[at : at + self.batch_size]
            try:
                vectors = self._run(some)
            except Exception as e:
                out += [e] * len(some)
                continue
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            out += [(v.astype(np.float32).tolist(),) for v in vectors / np.where(norms == 0, 1, norms)]
        return out


class CLIPTagger(EmbeddingTagger):
    """``clip_embedding`` of a vision model that is named by architecture and weights.

    device: ``auto`` takes a GPU if there is one; ``cuda`` without one is a
    ``GPUDependencyError``. On a CPU without a named model the small one is
    taken. load: gives, from (model name, weights, device), a function from
    arrays to vectors; no model comes with the package. With a GPU, batches that
    fail there are tried on the CPU.
    """

    #: The models by default, on a GPU and on a CPU.
    GPU_MODEL, CPU_MODEL = ("ViT-B-32", "openai"), ("MobileCLIP-S1", "datacompdr")

    def __init__(self, load: Callable, model_name: str | None = None, pretrained: str | None = None, device: str = "auto", batch_size: int = 32, max_failures: int = 3):
        self.device = choose_device(device)
        name, weights = self.GPU_MODEL if self.device == "cuda" else self.CPU_MODEL
        self.model_name, self.pretrained = model_name or name, pretrained or weights
        on = lambda device: partial(load, self.model_name, self.pretrained, device)
        super().__init__(on(self.device), "clip_embedding", batch_size, on("cpu") if self.device == "cuda" else None, max_failures)
