"""What a run logs of itself: metrics by step and epoch, reports by level, traces.

These are a few numbers a step, kept on the driver; frames() hands them to the DataFrame reports of
operators/metrics.py. The level comes from the caller or from the variable MESHWEAVE_PROFILE_LEVEL.
"""

from __future__ import annotations

import json
import os
import time
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

LEVEL_VARIABLE = "MESHWEAVE_PROFILE_LEVEL"
LOGS = ("init", "step", "epoch")
#: Items there are from the start, by log: sizes as log_sizes fills them in and the usual times; callers add theirs by register_item.
OWN_ITEMS = {
    "init": {"init": 1, "rank_nodes": 2},
    "step": {"num_node": 1, "num_sample": 1, "train_time": 1, "sample_time": 2, "gather_time": 2, "last_layer_size": 3},
    "epoch": {"total_time": 1},
}


def level() -> int:
    value = os.environ.get(LEVEL_VARIABLE, "")
    return int(value) if value in ("1", "2", "3") else 0


class RunLog:
    """Metrics and traces of one run; steps are told apart by epoch * steps_per_epoch + step."""

    steps_per_epoch: int

    def _store(self) -> dict[str, dict]:
        if not hasattr(self, "_logged"):
            self._logged = {"init": {}, "step": defaultdict(dict), "epoch": defaultdict(dict), "trace": defaultdict(lambda: [0, 0])}
            self._items = {log: dict(own) for log, own in OWN_ITEMS.items()}
        return self._logged

    def register_item(self, log: str, item: str, level: int = 1) -> None:
        """Let an item be logged in 'init', 'step' or 'epoch'; reports of its level and above show it."""
        if log not in LOGS or level not in (1, 2, 3):
            raise ValueError(f"logs are {', '.join(LOGS)}, levels 1 to 3")
        self._store()
        self._items[log][item] = level

    def items(self, log: str) -> dict[str, int]:
        """Items of a log with their levels."""
        self._store()
        return dict(self._items[log])

    def batch_key(self, epoch: int, step: int) -> int:
        return epoch * self.steps_per_epoch + step

    def _known(self, item: str, log: str) -> str:
        if item not in self.items(log):
            raise KeyError(f"no item {item} in the {log} log: see register_item")
        return item

    def log_init(self, item: str, val: float) -> None:
        self._store()["init"][self._known(item, "init")] = float(val)

    def log_step(self, epoch: int, step: int, item: str, val: float) -> None:
        self._store()["step"][self._known(item, "step")][self.batch_key(epoch, step)] = float(val)

    def log_step_add(self, epoch: int, step: int, item: str, val: float) -> None:
        self.log_step(epoch, step, item, self.get_log_step_value(epoch, step, item) + val)

    def log_epoch_add(self, epoch: int, item: str, val: float) -> None:
        own = self._store()["epoch"][self._known(item, "epoch")]
        own[epoch] = own.get(epoch, 0.0) + float(val)

    def get_log_init_value(self, item: str) -> float:
        return self._store()["init"].get(self._known(item, "init"), 0.0)

    def get_log_step_value(self, epoch: int, step: int, item: str) -> float:
        return self._store()["step"][self._known(item, "step")].get(self.batch_key(epoch, step), 0.0)

    def get_log_epoch_value(self, epoch: int, item: str) -> float:
        return self._store()["epoch"][self._known(item, "epoch")].get(epoch, 0.0)

    def _lines(self, title: str, log: str, value, top: int | None) -> str:
        top, own = level() if top is None else top, self.items(log)
        by_level = {k: [i for i, at in own.items() if at == k] for k in range(1, top + 1)}
        return "\n".join(f"[{title}] L{k} " + " | ".join(f"{i} {value(i):.4f}" for i in names) for k, names in by_level.items() if names)

    @staticmethod
    def _mean(values: dict[int, float]) -> float:
        """Mean without the first key, which is warm-up."""
        return sum(v for k, v in values.items() if k > 0) / max(1, len(values) - 1)

    def report_init(self, top: int | None = None) -> str:
        return self._lines("init", "init", self.get_log_init_value, top)

    def report_step(self, epoch: int, step: int, top: int | None = None) -> str:
        return self._lines(f"step E{epoch} S{step}", "step", lambda i: self.get_log_step_value(epoch, step, i), top)

    def report_step_average(self, epoch: int, step: int, top: int | None = None) -> str:
        return self._lines(f"step average E{epoch} S{step}", "step", lambda i: self._mean(self._store()["step"][i]), top)

    def report_epoch(self, epoch: int, top: int | None = None) -> str:
        return self._lines(f"epoch E{epoch}", "epoch", lambda i: self.get_log_epoch_value(epoch, i), top)

    def report_epoch_average(self, epoch: int, top: int | None = None) -> str:
        return self._lines(f"epoch average E{epoch}", "epoch", lambda i: self._mean(self._store()["epoch"][i]), top)

    def trace_step_begin(self, key: int, item: str, us: int) -> None:
        self._store()["trace"][item, key][0] = us

    def trace_step_end(self, key: int, item: str, us: int) -> None:
        self._store()["trace"][item, key][1] = us

    def trace_step_begin_now(self, key: int, item: str) -> None:
        self.trace_step_begin(key, item, time.time_ns() // 1000)

    def trace_step_end_now(self, key: int, item: str) -> None:
        self.trace_step_end(key, item, time.time_ns() // 1000)

    def dump_trace(self) -> str:
        """The trace as one JSON document of begin and end events; intervals without a begin or an end are left out."""
        lanes: dict[str, int] = {}
        events = []
        for (item, key), (begin, end) in sorted(self._store()["trace"].items(), key=lambda x: (x[0][1], x[1])):
            if begin and end:
                tid = lanes.setdefault(item, len(lanes))
                events += [{"name": f"{item}_{key}", "ph": ph, "pid": 0, "tid": tid, "ts": ts} for ph, ts in (("B", begin), ("E", end))]
        return json.dumps({"traceEvents": events})

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The logs as DataFrames: step and epoch (item, key, epoch, val), trace (item, key, begin_us, end_us)."""
        s = self._store()
        step = [(i, k, k // self.steps_per_epoch, v) for i, own in s["step"].items() for k, v in own.items()]
        epoch = [(i, k, k, v) for i, own in s["epoch"].items() for k, v in own.items()]
        trace = [(i, k, b, e) for (i, k), (b, e) in s["trace"].items()]
        shape = "item string, key long, epoch long, val double"
        return {"step": spark.createDataFrame(step, shape), "epoch": spark.createDataFrame(epoch, shape), "trace": spark.createDataFrame(trace, "item string, key long, begin_us long, end_us long")}
