"""Model stages. The engine runs no networks: a stage takes a runner, and a table-backed one reads what a model has given before."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame

#: Rows that a runner gets at once.
BATCH = 8


class ModelRunner(Protocol):
    """Turns a batch of input rows into output rows of ``schema``; made once in each task by its own ``open``."""

    schema: str

    def open(self) -> None: ...

    def run(self, batch: pd.DataFrame) -> pd.DataFrame: ...


def _tried(runner: ModelRunner, batch: pd.DataFrame, lost: Accumulator | None) -> Iterator[pd.DataFrame]:
    """The runner's rows; a batch that fails is halved until the rows that fail stand alone, and these are left out."""
    try:
        yield runner.run(batch)
    except (ValueError, OSError) as error:
        if len(batch) > 1:
            for part in (batch.iloc[: len(batch) // 2], batch.iloc[len(batch) // 2 :]):
                yield from _tried(runner, part, lost)
            return
        warnings.warn(f"a row is left out: {error}", stacklevel=2)
        if lost is not None:
            lost.add(1)


def apply(inputs: DataFrame, runner: ModelRunner, batch: int = BATCH, lost: Accumulator | None = None) -> DataFrame:
    """The runner over all rows, ``batch`` at a time. Rows that fail are left out with a warning, as one bad image must not end a job, and
    counted in ``lost``."""

    def work(batches):
        runner.open()
        for whole in batches:
            for at in range(0, len(whole), batch):
                yield from _tried(runner, whole.iloc[at : at + batch], lost)

    return inputs.mapInPandas(work, runner.schema)


def from_table(inputs: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """The table-backed runner: results of the inputs' keys."""
    return results.join(inputs.select(*keys).distinct(), keys, "left_semi")
