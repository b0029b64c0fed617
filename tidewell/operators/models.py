"""Models kept by the Python workers."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable
from typing import TypeVar

from pyspark import cloudpickle

M = TypeVar("M")

# A worker process forgets its oldest model when it would hold more.
_MODELS_PER_WORKER = 4


def once_per_worker(make: Callable[[], M]) -> Callable[[], M]:
    """``make`` for use inside tasks: later tasks of a worker process get the same model.

    Spark reuses worker processes, so a heavy model is loaded once per process
    instead of once per partition. Models go by what makes them, its code and arguments:
    the same maker given again, in a later call too, finds the model of before.
    """
    key = hashlib.sha256(cloudpickle.dumps(make)).hexdigest()

    def get() -> M:
        # Functions arrive anew with every task; a module stays.
        home = sys.modules.setdefault("tidewell_models", types.ModuleType("tidewell_models"))
        models = home.__dict__.setdefault("models", {})
        if key not in models:
            while len(models) >= _MODELS_PER_WORKER:
                del models[next(iter(models))]
            models[key] = make()
        return models[key]

    return get
