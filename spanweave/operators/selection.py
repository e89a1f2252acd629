"""Model selection: epochs with saved state, a log on storage, early stopping read from that log.

After every epoch the state of the model and then a row of the log are written
to a folder that all machines share.  A run that was cut off goes on after the last
epoch of its log; a state without a row is written again.  The loop stops where
``evaluate.early_stop`` says on the log itself, and returns the best epoch's state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PATIENCE
from . import evaluate, scoring

LOG_SCHEMA = "run long, epoch int, train_loss double, valid_f1 double"
State = dict[str, np.ndarray]


def save_state(spark: SparkSession, state: State, path: str) -> None:
    """Two-dimensional arrays as rows (name, row, values); a path of its own, replaced whole."""
    rows = [(name, i, values) for name, array in state.items() for i, values in enumerate(array.tolist())]
    spark.createDataFrame(rows, "name string, row int, values array<double>").write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> State:
    rows = spark.read.parquet(path).orderBy("name", "row").collect()  # a model, not data: bounded by its parameters
    return {name: np.array([r["values"] for r in rows if r["name"] == name]) for name in sorted({r["name"] for r in rows})}


@dataclass(frozen=True)
class Selected:
    """The log of a run, its best epoch (None if no F1 was above 0) and that epoch's state (else the last)."""

    log: DataFrame
    best_epoch: int | None
    state: State


def select_model(spark: SparkSession, folder: str, run: int, start: State, step: Callable[[State], tuple[State, float]],
                 valid_f1: Callable[[State], float], max_epochs: int = 200, patience: int = PATIENCE) -> Selected:
    """Epochs of ``step`` (state → state and training loss), each judged by ``valid_f1``, until the log says stop.

    ``folder`` is shared by all machines; called again with it, the run goes on where
    its log ends.  At least one epoch is run.
    """
    base = f"{folder.rstrip('/')}/run={run}"

    def path(epoch: int) -> str:
        return f"{base}/state/epoch={epoch}"

    def read() -> DataFrame:
        return spark.read.schema(LOG_SCHEMA).parquet(f"{base}/log/*")

    from_before = _exists(spark, f"{base}/log")
    summary = evaluate.run_summary(read(), patience).first() if from_before else None
    last = read().agg(F.max("epoch")).first()[0] if summary else -1
    state = load_state(spark, path(last)) if summary else start
    while last + 1 < max(1, max_epochs) and (summary is None or summary.stop_epoch is None):
        last += 1
        state, loss = step(state)
        save_state(spark, state, path(last))
        row = spark.createDataFrame([(run, last, float(loss), float(valid_f1(state)))], LOG_SCHEMA)
        row.coalesce(1).write.mode("overwrite").parquet(f"{base}/log/epoch={last:06d}")
        summary = evaluate.run_summary(read(), patience).first()
    best = summary.best_epoch if summary.best_valid_f1 > 0 else None
    return Selected(read(), best, load_state(spark, path(last if best is None else best)))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the log holds an epoch that was written to its end."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def lr_start(attributes: list[str], num_features: int) -> State:
    shape = (num_features + 1, scoring.N_TAGS * len(attributes))
    return {"squares": np.zeros(shape), "weights": np.zeros(shape)}


def lr_step(rows: DataFrame, rate: float = 0.5, reg: float = 1e-6) -> Callable[[State], tuple[State, float]]:
    """An epoch of the logistic-regression tagger: one pass over the rows of ``scoring.lr_rows``, one scaled gradient step."""
    total = rows.agg(F.sum("n")).first()[0] or 1

    def step(state: State) -> tuple[State, float]:
        weights = state["weights"]
        loss, gradient = scoring._lr_pass(rows, weights)
        gradient = gradient / total + reg * weights
        squares = state["squares"] + gradient * gradient
        moved = np.divide(gradient, np.sqrt(squares), out=np.zeros_like(gradient), where=squares > 0)
        return {"squares": squares, "weights": weights - rate * moved}, loss / total

    return step
