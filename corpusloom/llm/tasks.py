"""What Python tasks over whole texts share: batches bounded by bytes, and memory given back at a task's end."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

from pyspark.sql import DataFrame

#: Bytes of an Arrow batch of texts. Rows alone don't bound a batch, and the JVM, Arrow and Python each hold it.
BATCH = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def by_bytes(rows: DataFrame) -> DataFrame:
    """``rows``, with the session's Arrow batches held to BATCH bytes unless it asks for smaller ones."""
    conf = rows.sparkSession.conf
    given = conf.get(_SETTING, f"{BATCH + 1}b")
    asked = int(given.removesuffix("b")) if given.removesuffix("b").isdigit() else BATCH + 1
    if not 0 < asked <= BATCH:
        conf.set(_SETTING, str(BATCH))
    return rows


def give_back() -> None:
    """Free memory to the system; a worker that waits for its next task holds nothing of the last."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call in other C libraries
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, giving memory back behind the last."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole
