"""Calls to remote services from inside tasks: several at a time, with limits, each failure its own."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from postloom.shipping import ship


@dataclass(frozen=True)
class Limits:
    """At most `at_once` calls in a task; each may take `seconds`; an error for which `again` holds is tried again so often, after backoff * 2 ** n seconds."""

    at_once: int = 16
    seconds: float = 180.0
    retries: int = 0
    backoff: float = 0.5
    again: Callable[[Exception], bool] = lambda error: True


class _Call:
    """One call in a thread of its own. It is given up when it takes too long: its thread ends with the worker, and counts no more."""

    def __init__(self, call: Callable, item, limits: Limits):
        self.result, self.error, self.began = None, None, time.monotonic()
        self.done = threading.Event()
        threading.Thread(target=self._run, args=(call, item, limits), daemon=True).start()
        self.most = limits.seconds * (limits.retries + 1) + sum(limits.backoff * 2**n for n in range(limits.retries))

    def _run(self, call: Callable, item, limits: Limits) -> None:
        try:
            for attempt in range(limits.retries + 1):
                try:
                    self.result = call(item)
                    return
                except Exception as error:  # noqa: BLE001  whatever a remote service throws
                    if attempt == limits.retries or not limits.again(error):
                        self.error = f"{type(error).__name__}: {error}"
                        return
                time.sleep(limits.backoff * 2**attempt)
        finally:
            self.done.set()

    def outcome(self) -> tuple[object, str | None]:
        if not self.done.wait(max(0.0, self.began + self.most - time.monotonic())):
            return None, f"no answer within {self.most:g} s"
        return self.result, self.error


def calls(items: Iterable, call: Callable, limits: Limits) -> Iterator[tuple[object, str | None]]:
    """(result, error) of each item in order; one of the two is None. New calls begin as earlier ones end, whichever these are."""
    waiting: deque[_Call] = deque()
    source, ended = iter(items), False
    while waiting or not ended:
        while not ended and len(waiting) < 4 * limits.at_once and sum(not c.done.is_set() and time.monotonic() < c.began + c.most for c in waiting) < limits.at_once:
            try:
                waiting.append(_Call(call, next(source), limits))
            except StopIteration:
                ended = True
        if waiting and (waiting[0].done.is_set() or time.monotonic() >= waiting[0].began + waiting[0].most):
            yield waiting.popleft().outcome()
        elif waiting:
            waiting[0].done.wait(0.005)


def called(df: DataFrame, argument: str, call: Callable, limits: Limits, result: str = "result", error: str = "error") -> DataFrame:
    """df with the text that call(argument) gives for each row, and why there is none. Rows stay in order within a partition.

    So many calls run at a time as the limits allow, times the tasks that run. Keep the outcome as a table: reading it twice calls twice.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(calls(batch[argument], call, limits))
            yield batch.assign(**{result: [r for r, _ in found], error: [e for _, e in found]})

    schema = StructType([*df.schema, StructField(result, StringType()), StructField(error, StringType())])
    return df.mapInPandas(run, schema)
