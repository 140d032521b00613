"""Pipelines of taggers and filters, compiled to one lazy DataFrame.

With ``lazy_evaluation`` a tagger is placed just before the first filter that
needs one of its tags, so it measures only frames that passed the filters
before; taggers that no filter needs are left out. If there are no filters, or
without ``lazy_evaluation``, taggers stand where the user put them.
"""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from types import SimpleNamespace
from typing import ClassVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from reelsift.errors import ConfigurationError
from reelsift.operators.devices import choose_device
from reelsift.operators.filters import DiversityFilter, DuplicateFilter, Filter, MotionFilter, StatefulFilter, StatelessFilter
from reelsift.operators.fused import COUNTS, apply_fused, can_fuse, fused_files
from reelsift.operators.taggers import EmbeddingTagger, HashTagger, Tagger
from reelsift.schema import FRAME, FRAME_SCHEMA, NUMBER, PIXELS, VIDEO, to_array
from reelsift.sources.video import VideoFiles


class FramePipeline:
    """Stages in order; ``apply`` gives the selected frames, ``annotate`` all of them with a flag for each filter."""

    def __init__(
        self, stages: list | None = None, strategy=None, n_workers: int = 1, use_gpu: bool = False, gpu_batch_size: int | None = None,
        lazy_evaluation: bool = True, release_memory: bool = True, keep_frames: bool = True,
    ):
        """use_gpu: a ``GPUDependencyError`` without one. gpu_batch_size: frames that taggers with a model take at once.

        release_memory: kept for callers; rejected frames are never held.
        """
        if n_workers < 1 or gpu_batch_size is not None and gpu_batch_size < 1:
            raise ValueError("n_workers and gpu_batch_size must be 1 at least")
        if use_gpu:
            choose_device("cuda")
        self.stages = list(strategy.build_pipeline() if strategy is not None else stages or [])
        self.n_workers, self.lazy_evaluation, self.keep_frames = n_workers, lazy_evaluation, keep_frames
        self.use_gpu, self.release_memory = use_gpu, release_memory
        for stage in self.stages:
            if gpu_batch_size is not None and isinstance(stage, EmbeddingTagger):
                stage.batch_size = gpu_batch_size
        self.validate()

    def validate(self) -> None:
        """``ConfigurationError`` if a stage isn't one, or a filter's tag comes from no earlier tagger."""
        known: list[str] = []
        for i, stage in enumerate(self.stages):
            if isinstance(stage, Tagger):
                known += stage.tag_keys
            elif isinstance(stage, Filter):
                if missing := [t for t in stage.required_tags if t not in known]:
                    raise ConfigurationError(f"stage {i} ({stage.name}) needs {missing}, which no earlier tagger gives")
                if isinstance(stage, DiversityFilter):
                    stage.available = list(known)
            else:
                raise ConfigurationError(f"stage {i} is neither a tagger nor a filter: {stage!r}")

    def needed_tags(self, stage: Filter) -> list[str]:
        """Tags that a filter reads, also those it finds by itself."""
        if isinstance(stage, DiversityFilter):
            return stage.tags()
        if isinstance(stage, DuplicateFilter):
            return [stage.hash_type]
        return list(stage.required_tags)

    def plan(self) -> list[tuple[int, object]]:
        """(place in the pipeline, stage) in the order of execution."""
        filters = [i for i, s in enumerate(self.stages) if isinstance(s, Filter)]
        if not self.lazy_evaluation or not filters:
            return list(enumerate(self.stages))
        out: list[tuple[int, object]] = []
        placed: set[int] = set()
        for i in filters:
            for tag in self.needed_tags(self.stages[i]):
                # Of several taggers of one tag the last before the filter counts.
                makers = [j for j in range(i) if isinstance(self.stages[j], Tagger) and tag in self.stages[j].tag_keys]
                if makers and makers[-1] not in placed:
                    placed.add(makers[-1])
                    out.append((makers[-1], self.stages[makers[-1]]))
            out.append((i, self.stages[i]))
        return out

    def _needs_pixels_later(self, plan: list, at: int) -> bool:
        later = [s for _, s in plan[at:]]
        return any(isinstance(s, Tagger | MotionFilter) or isinstance(s, DuplicateFilter) for s in later)

    def apply(self, frames: DataFrame | VideoFiles, observe: list | None = None) -> DataFrame:
        """The frames that pass every filter, with the tags that were made.

        Taggers and predicates up to the first greedy filter share one pass
        over the pixels, which don't come back unless they are read later.
        Greedy filters shuffle whole rows, so pixels that no later stage reads
        are dropped before them unless ``keep_frames``. Files are decoded in the
        first pass, so only what is kept of a frame leaves the worker. observe: a list that
        gets an observation for each step, with what it counts.
        """
        plan = self.plan()
        files = isinstance(frames, VideoFiles)
        out = frames.repartition(self.n_workers) if self.n_workers > 1 and not files else frames

        def counted(df: DataFrame, what, *counts) -> DataFrame:
            if observe is None:
                return df
            seen = Observation()
            observe.append((seen, what))
            return df.observe(seen, *counts)

        start = 0
        if files or FRAME in frames.columns:
            while start < len(plan) and can_fuse(plan[start][1]):
                start += 1
            if any(isinstance(s, Tagger) for _, s in plan[:start]):
                fused, labels = [s for _, s in plan[:start]], [label(*p) for p in plan[:start]]
                keep = self.keep_frames or self._needs_pixels_later(plan, start)
                count = observe is not None
                out = fused_files(frames.spark, frames.paths, frames.rows(), fused, keep, labels, count) if files else apply_fused(out, fused, keep, labels, count)
                if observe is not None:
                    out = counted(out, start, *(F.sum(F.col(COUNTS)[k]).alias(f"c{k}") for k in range(3 * start + 1)))
                    out = out.where(F.col(COUNTS).isNull()).drop(COUNTS)
            else:
                start, out = 0, frames.frames() if files else out
        dealt = None
        if not start:
            out = counted(out, "in", F.count("*").alias("n"))
        for at, (i, stage) in enumerate(plan[start:], start):
            if not self.keep_frames and isinstance(stage, StatefulFilter) and FRAME in out.columns and not self._needs_pixels_later(plan, at):
                out = out.drop(FRAME)
            if isinstance(stage, Tagger):
                out = stage.apply(out, label=label(i, stage))
            elif isinstance(stage, StatefulFilter):  # one shuffle serves all that go by the same key and order
                out, dealt = stage.apply(out, dealt_out=dealt == (stage.state_key, stage.order)), (stage.state_key, stage.order)
            else:
                out, dealt = stage.apply(out), dealt if isinstance(stage, StatelessFilter) else None
            if isinstance(stage, Tagger):
                failed = _failed(label(i, stage)) if "_errors" in out.columns else F.lit(False)
                out = counted(out, at, F.count("*").alias("n"), F.count_if(failed).alias("bad"))
            else:
                out = counted(out, at, F.count("*").alias("n"))
        return out

    def annotate(self, frames: DataFrame) -> DataFrame:
        """All frames with ``pass_<place>`` for each filter: null where an earlier filter had rejected the frame.

        A tagger measures just the frames that have passed so far.
        """
        out, on, dealt = frames, None, None
        for i, stage in self.plan():
            if isinstance(stage, Tagger):
                out = stage.apply(out, active=on, label=label(i, stage))
                continue
            flag = f"pass_{i}"
            if isinstance(stage, StatelessFilter):
                passes = stage.passes()
                out = out.withColumn(flag, passes if on is None else F.when(F.col(on), passes))
            elif isinstance(stage, StatefulFilter):
                out, dealt = stage.apply(out, flag, on, dealt == (stage.state_key, stage.order)), (stage.state_key, stage.order)
            else:
                out, dealt = stage.apply(out, flag=flag, active=on), None
            on = flag
        return out

    def process(self, source: DataFrame | VideoFiles, session_id: str | None = None) -> tuple[DataFrame, ProcessingResult]:
        """The selected frames, each video's in order, and a result that the run of that frame fills.

        Counts are observed while the plan runs, so nothing runs twice.
        """
        began, seen = time.time(), []
        out = self.apply(source, observe=seen)
        plan = self.plan()
        if not (plan and isinstance(plan[-1][1], StatefulFilter) and plan[-1][1].state_key == VIDEO):  # else it is in order
            n = int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            out = out.repartition(n, VIDEO).sortWithinPartitions(VIDEO, NUMBER)
        return out, ProcessingResult(self, out, session_id or uuid.uuid4().hex[:8], source, seen, began)

    def process_iterator(self, rows) -> Iterator[dict]:
        """Selected frames of an iterator of rows (``frame_row``), one by one as it goes; it may never end.

        Each is a dict of the row's columns and tags. Stages run in this
        process, in the order of the plan; state is kept by video.
        """
        plan = self.plan()
        buffers: dict = {}
        for row in rows:
            held = dict(zip(FRAME_SCHEMA.names, row, strict=True))
            held[FRAME] = dict(zip(PIXELS.names, held[FRAME], strict=True))
            if all(self._local(i, stage, held, buffers) for i, stage in plan):
                yield held

    @staticmethod
    def _local(i: int, stage, held: dict, buffers: dict) -> bool:
        """Whether a frame goes on after a stage; tags are added to it."""
        if isinstance(stage, Tagger):
            [got] = stage.compute_batch([to_array(held[FRAME])])
            if isinstance(got, Exception):
                held.setdefault("_errors", []).append(f"{label(i, stage)}: {got}")
                got = (None,) * len(stage.fields)
            held.update(zip(stage.tag_keys, got, strict=True))
            return True
        if isinstance(stage, StatelessFilter):
            return stage.keeps(lambda tag: [held.get(tag)])[0]
        if not isinstance(stage, StatefulFilter):
            raise ConfigurationError(f"{stage.name} needs a table of frames")
        if isinstance(stage, DuplicateFilter) and stage.hash_type not in held:
            held[stage.hash_type] = HashTagger(stage.hash_type, stage.hash_size).compute(to_array(held[FRAME]))[0]
        buffer = buffers.setdefault((i, held[stage.state_key] if stage.state_key else None), deque(maxlen=stage.buffer_size))
        value = stage.ready(tuple(held.get(c) for c in stage.payload(SimpleNamespace(columns=list(held)))))
        passed = bool(stage.accepts(value, buffer))
        if passed:
            buffer.append(value)
        return passed

    def stage_metrics(self, frames: DataFrame) -> DataFrame:
        """A row for each executed stage; counts come from one aggregation over the annotated frames."""
        marked = self.annotate(frames)
        plan = self.plan()
        counts = {"_total": F.count("*")}
        for i, stage in plan:
            if isinstance(stage, Filter):
                counts[f"_seen_{i}"] = F.count_if(F.col(f"pass_{i}").isNotNull())
                counts[f"_pass_{i}"] = F.count_if(F.col(f"pass_{i}"))
            elif "_errors" in marked.columns:
                counts[f"_bad_{i}"] = F.count_if(_failed(label(i, stage)))
        summed = marked.agg(*(c.alias(k) for k, c in counts.items()))
        rows, seen = [], F.col("_total")
        for n, (i, stage) in enumerate(plan):
            tagger = isinstance(stage, Tagger)
            errors = F.col(f"_bad_{i}") if f"_bad_{i}" in counts else F.lit(0)
            evaluated = seen if tagger else F.col(f"_seen_{i}")
            passed = evaluated if tagger else F.col(f"_pass_{i}")
            rows.append(
                F.struct(
                    F.lit(n).alias("stage"), F.lit(label(i, stage)).alias("stage_name"), F.lit("tagger" if tagger else "filter").alias("kind"),
                    evaluated.cast("long").alias("frames_evaluated"), passed.cast("long").alias("frames_passed"),
                    (evaluated - passed).cast("long").alias("frames_filtered"), errors.cast("long").alias("errors"),
                    (F.lit(0.0) if tagger else F.coalesce(F.try_divide(passed.cast("double") * 100, evaluated.cast("double")), F.lit(0.0))).alias("pass_rate"),
                )
            )
            seen = passed
        return summed.select(F.inline(F.array(*rows))) if rows else frames.sparkSession.createDataFrame([], "stage int, stage_name string, kind string, frames_evaluated long, frames_passed long, frames_filtered long, errors long, pass_rate double")


def label(i: int, stage) -> str:
    """A stage's place and name, which tell apart two of a kind."""
    return f"{i}:{stage.name}"


def _failed(name: str):
    """Whether a frame has a failure of the tagger that is labelled so."""
    return F.exists("_errors", lambda e: e.startswith(f"{name}: "))


@dataclass
class ProcessingResult:
    """Counts and rates of one run of ``frames``, read by ``refresh`` when it has run."""

    #: Seconds that counts may arrive after the rows.
    GRACE: ClassVar[float] = 2.0

    pipeline: FramePipeline
    frames: DataFrame
    session_id: str
    source: DataFrame | VideoFiles = field(repr=False)
    observed: list = field(repr=False)
    began: float = 0.0
    total_frames: int = 0
    processed_frames: int = 0
    selected_frames: int = 0
    filtered_frames: int = 0
    processing_time: float = 0.0
    stages: list = field(default_factory=list)

    def finished(self) -> bool:
        """Whether the frames have been run."""
        return any(self._completed())

    def _completed(self) -> list[bool]:
        return [seen._jo is not None and seen._jo.future().isCompleted() for seen, _ in self.observed]

    def refresh(self) -> ProcessingResult:
        """Fills the counts; frames that haven't been run yet are run once for it, without being kept."""
        if not self.finished():
            self.frames.write.format("noop").mode("overwrite").save()
        if not self.processing_time:
            self.processing_time = time.time() - self.began
        plan, counts, total = self.pipeline.plan(), [], None
        deadline = time.time() + self.GRACE
        while not all(self._completed()) and time.time() < deadline:  # they arrive a little after the rows
            time.sleep(0.01)
        try:
            if not all(self._completed()):
                return self._counted_again()
            observed = [({k: v or 0 for k, v in seen.get.items()}, what) for seen, what in self.observed]
        except Py4JJavaError:  # nothing was selected, and the plan that counted was replaced by an empty one
            return self._counted_again()
        for got, what in observed:
            if what == "in":
                total = got.get("n", 0)
            elif counts or total is not None:
                before = counts[-1][1] if counts else total
                counts.append((before, got.get("n", 0), got.get("bad", 0)))
            else:  # the stages of one pass
                total = got.get("c0", 0)
                counts = [tuple(got.get(f"c{1 + 3 * k + j}", 0) for j in range(3)) for k in range(what)]
        self.stages = []
        for n, ((i, stage), (evaluated, passed, errors)) in enumerate(zip(plan, counts, strict=True)):
            tagger = isinstance(stage, Tagger)
            rate = 100.0 * passed / evaluated if evaluated and not tagger else 0.0
            row = {"stage": n, "stage_name": label(i, stage), "kind": "tagger" if tagger else "filter", "frames_evaluated": evaluated, "frames_passed": passed}
            self.stages.append(row | {"frames_filtered": evaluated - passed, "errors": errors, "pass_rate": rate})
        return self._totals(total or 0)

    def _counted_again(self) -> ProcessingResult:
        source = self.source.frames() if isinstance(self.source, VideoFiles) else self.source
        self.stages = [r.asDict() for r in self.pipeline.stage_metrics(source).orderBy("stage").collect()]
        return self._totals(self.stages[0]["frames_evaluated"] if self.stages else source.count())

    def _totals(self, total: int) -> ProcessingResult:
        self.total_frames = self.processed_frames = total
        self.selected_frames = self.stages[-1]["frames_passed"] if self.stages else total
        self.filtered_frames = self.total_frames - self.selected_frames
        return self

    @property
    def selection_rate(self) -> float:
        return 100 * self.selected_frames / self.total_frames if self.total_frames else 0.0

    @property
    def throughput(self) -> float:
        return self.total_frames / self.processing_time if self.processing_time else 0.0

    def get_summary(self) -> dict:
        keys = ("session_id", "total_frames", "processed_frames", "selected_frames", "filtered_frames", "processing_time", "stages")
        return {k: getattr(self, k) for k in keys} | {"selection_rate": self.selection_rate, "throughput": self.throughput}

    def print_summary(self) -> None:
        print(f"Session {self.session_id}: {self.selected_frames}/{self.total_frames} frames selected ({self.selection_rate:.1f}%), {self.filtered_frames} filtered")
        print(f"{self.processing_time:.2f} s, {self.throughput:.1f} frames a second")
        for s in self.stages:
            print(f"  {s['stage_name']}: {s['frames_evaluated']} evaluated, {s['frames_passed']} passed, {s['errors']} errors")


def per_video_metrics(marked: DataFrame, flag: str) -> DataFrame:
    """Total, selected and filtered frames and the selection rate of each video of annotated frames."""
    selected = F.count_if(F.coalesce(F.col(flag), F.lit(False)))
    out = marked.groupBy(VIDEO).agg(F.count("*").alias("total_frames"), selected.alias("selected_frames"))
    rate = F.try_divide(F.col("selected_frames").cast("double") * 100, F.col("total_frames").cast("double"))
    return out.withColumns({"filtered_frames": F.col("total_frames") - F.col("selected_frames"), "selection_rate": F.coalesce(rate, F.lit(0.0))})
