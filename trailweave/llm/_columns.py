"""Keeps a caller's extra columns from clashing with those that operators work with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

#: The columns of ``documents`` that operators read.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(documents: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` over ``documents`` whose columns but ``OWN`` have other names meanwhile, whatever they are called; the result has the same columns."""
    given = documents.columns
    names = [c if c in OWN else f"extra column {k}" for k, c in enumerate(given)]
    return run(documents.toDF(*names)).select(*(f"`{c}`" for c in names)).toDF(*given)


def free_names(documents: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that ``documents`` doesn't have, whatever the case of its own."""
    taken = {c.lower() for c in documents.columns}
    return [next(x for k in range(len(taken) + 1) if (x := f"own_{name}{'_' * k}") not in taken) for name in names]
