"""Counters of a run that is driven from Python, stage by stage."""

from __future__ import annotations

import time
from dataclasses import dataclass


@dataclass
class StageMetrics:
    """Counts and seconds of one stage; rates are percentages and 0 where nothing was counted."""

    frames_processed: int = 0
    frames_evaluated: int = 0
    frames_passed: int = 0
    frames_filtered: int = 0
    errors: int = 0
    seconds: float = 0.0

    @property
    def pass_rate(self) -> float:
        return 100 * self.frames_passed / self.frames_evaluated if self.frames_evaluated else 0.0

    @property
    def error_rate(self) -> float:
        n = self.frames_evaluated or self.frames_processed
        return 100 * self.errors / n if n else 0.0

    @property
    def average_seconds(self) -> float:
        n = self.frames_evaluated or self.frames_processed
        return self.seconds / n if n else 0.0


class MetricsCollector:
    """Collects stage metrics; the throughput is of processed frames."""

    def __init__(self):
        self.stages: dict[str, StageMetrics] = {}
        self.workers: dict[str, dict] = {}
        self.total_frames = self.processed_frames = self.selected_frames = 0
        self._began, self._ended, self._open = time.time(), None, {}

    def stage(self, name: str) -> StageMetrics:
        return self.stages.setdefault(name, StageMetrics())

    def start_stage(self, name: str) -> None:
        self._open[name] = time.time()

    def end_stage(self, name: str) -> None:
        self.stage(name).seconds += time.time() - self._open.pop(name, time.time())

    def record_tagger(self, name: str, error: bool = False) -> None:
        s = self.stage(name)
        s.errors += error
        s.frames_processed += 1

    def record_filter(self, name: str, passed: bool, error: bool = False) -> None:
        s = self.stage(name)
        s.frames_evaluated += 1
        s.errors += error
        s.frames_passed += passed and not error
        s.frames_filtered += not passed and not error

    def record_worker(self, name: str, metric: str, value) -> None:
        self.workers.setdefault(name, {})[metric] = value

    def finalize(self) -> MetricsCollector:
        self._ended = time.time()
        return self

    @property
    def duration(self) -> float:
        return (self._ended or time.time()) - self._began

    @property
    def throughput(self) -> float:
        return self.processed_frames / self.duration if self.duration else 0.0

    @property
    def selection_rate(self) -> float:
        return 100 * self.selected_frames / self.total_frames if self.total_frames else 0.0

    def get_summary(self) -> dict:
        stages = {k: vars(s) | {"pass_rate": s.pass_rate, "error_rate": s.error_rate, "average_seconds": s.average_seconds} for k, s in self.stages.items()}
        return {"duration": self.duration, "throughput": self.throughput, "selection_rate": self.selection_rate, "stages": stages, "workers": self.workers}
