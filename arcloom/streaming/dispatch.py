"""Hand every micro-batch to several consumers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

Consumer = Callable[[DataFrame, int], None]


@dataclass(frozen=True)
class Handler:
    """A consumer and, if it does not want every row, the predicate of its rows."""

    push: Consumer
    accepts: Callable[[], Column] | None = None


def dispatcher(handlers: Sequence[Handler]) -> Consumer:
    """``foreachBatch`` function: the batch is computed once and pushed to each handler in turn."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for h in handlers:
                h.push(batch if h.accepts is None else batch.filter(h.accepts()), batch_id)
        finally:
            batch.unpersist()
    return each
