"""readloom: a PySpark-native engine for aligned sequencing reads."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(name: str) -> None:
    """Send a module to Python workers by value.

    Executors then need no copy of the repository on their own import path.
    Call it at the top of each module whose functions run on workers.
    """
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)
