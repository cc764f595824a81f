"""Python functions travel to the executors with the job, which need not have the library installed."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module])
