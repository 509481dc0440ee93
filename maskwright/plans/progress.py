"""Progress of a run: tasks count bytes and files in accumulators, which a thread of the driver reads out."""

from __future__ import annotations

import sys
import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Event:
    """Counts only grow, and end at their totals; ``stage`` says what the run does."""

    stage: str
    files_done: int
    files_total: int
    bytes_done: int
    bytes_total: int


class Meter:
    """``with`` a callback, or nothing to report to."""

    def __init__(self, spark: SparkSession, report: Callable[[Event], None] | None, every: float = 0.5):
        self.report, self.every = report, every
        self.files, self.bytes = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
        self.files_total = self.bytes_total = 0
        self.stage, self.last, self.ended = "list", (0, 0), threading.Event()
        self.thread = threading.Thread(target=self._poll, daemon=True)

    def expect(self, files: int, size: int) -> None:
        self.files_total, self.bytes_total = files, size

    def tell(self, stage: str | None = None, whole: bool = False) -> None:
        self.stage = stage or self.stage
        if self.report is None:
            return
        # a repeated task counts again; no count passes its total or goes back
        now = (self.files_total, self.bytes_total) if whole else (min(self.files.value, self.files_total), min(self.bytes.value, self.bytes_total))
        self.last = tuple(map(max, self.last, now))
        self.report(Event(self.stage, self.last[0], self.files_total, self.last[1], self.bytes_total))

    def _poll(self) -> None:
        while not self.ended.wait(self.every):
            self.tell()

    def __enter__(self) -> Meter:
        if self.report:
            self.thread.start()
        return self

    def __exit__(self, kind, *_) -> None:
        self.ended.set()
        if self.report:
            self.thread.join()
            self.tell("done" if kind is None else "failed", whole=kind is None)


def size_text(n: int) -> str:
    """``1536`` as ``1.5 KiB``."""
    power = max((n.bit_length() - 1) // 10, 0) if n else 0
    return f"{n} B" if not power else f"{n / 1024**power:.1f} {'KMGTPE'[power - 1]}iB"


def bar(stream=None, width: int = 30) -> Callable[[Event], None] | None:
    """A line on a terminal that is written anew with each event; nothing for other streams."""
    stream = stream or sys.stderr
    if not stream.isatty():
        return None

    def show(e: Event) -> None:
        share = e.bytes_done / e.bytes_total if e.bytes_total else float(e.stage == "done")
        stream.write(f"\r\x1b[K{e.stage:<8}|{'=' * round(share * width):<{width}}| {share:4.0%}  {e.files_done} of {e.files_total} files, {size_text(e.bytes_done)}")
        stream.write("\n" if e.stage in ("done", "failed") else "")
        stream.flush()

    return show
