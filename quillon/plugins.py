"""What a user may plug in: functions, solvers, evaluators, stores and planners, registered by name and checked where they are called."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass(frozen=True)
class RealFunction:
    """f and its slope on doubles, as Python callables over NumPy arrays."""

    name: str
    value: Callable[[np.ndarray], np.ndarray]
    slope: Callable[[np.ndarray], np.ndarray] | None = None

    def column(self, x: Column) -> Column:
        return F.pandas_udf(lambda s: pd.Series(np.asarray(self.value(s.to_numpy()), np.float64)), "double")(x)


@dataclass(frozen=True)
class Meromorphic(RealFunction):
    """A real function with its poles, ascending."""

    poles: tuple[float, ...] = ()


@dataclass(frozen=True)
class IntervalFunction:
    """An enclosure of f over an exact interval, and of its slope."""

    name: str
    value: Callable
    slope: Callable


@dataclass(frozen=True)
class EigenSolver:
    """Eigenvalues, ascending, of one dense symmetric matrix; called once a group."""

    name: str
    solve: Callable[[np.ndarray], np.ndarray]

    def spectra(self, matrices: DataFrame, by: str = "matrix_id") -> DataFrame:
        """(matrix, ordinal, value, outcome); a solver that fails or returns other than n ascending finite numbers says so."""
        from .operators.linalg import _dense

        def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
            a = _dense(pdf)
            try:
                w = np.asarray(self.solve(a), np.float64)
                good = w.shape == (len(a),) and np.isfinite(w).all() and (np.diff(w) >= 0).all()
            except Exception as e:  # noqa: BLE001 - a plug-in's failure is its outcome
                return pd.DataFrame({by: [key[0]], "ordinal": [-1], "value": [np.nan], "outcome": [type(e).__name__]})
            if not good:
                return pd.DataFrame({by: [key[0]], "ordinal": [-1], "value": [np.nan], "outcome": ["invalid"]})
            return pd.DataFrame({by: key[0], "ordinal": np.arange(len(w)), "value": w, "outcome": "solved"})

        kind = matrices.schema[by].dataType.simpleString()
        return matrices.groupBy(by).applyInPandas(run, f"{by} {kind}, ordinal long, value double, outcome string")


@dataclass(frozen=True)
class Evaluator:
    """An external target u -> value, used only if the caller authorises it; values must be finite."""

    name: str
    value: Callable[[np.ndarray], np.ndarray]

    def column(self, u: Column, authorised: bool) -> Column:
        if not authorised:
            raise PermissionError(f"evaluator {self.name} was not authorised")

        def run(s: pd.Series) -> pd.Series:
            v = np.asarray(self.value(s.to_numpy()), np.float64)
            if v.shape != s.shape or not np.isfinite(v).all():
                raise ValueError(f"evaluator {self.name} returned other than finite numbers")
            return pd.Series(v)

        return F.pandas_udf(run, "double")(u)


@dataclass(frozen=True)
class Planner:
    """Rules (predicate, route) of one domain, the first that holds wins; without one the row has no route."""

    domain: str
    rules: tuple[tuple[Column, str], ...] = field(default_factory=tuple)

    def column(self) -> Column:
        return F.coalesce(*[F.when(c, F.lit(name)) for c, name in self.rules], F.lit(None).cast("string"))


class Registry:
    """Plug-ins by kind and name; a name twice is an error."""

    def __init__(self) -> None:
        self._known: dict[tuple[type, str], object] = {}

    def add(self, plugin) -> None:
        key = (type(plugin), getattr(plugin, "name", None) or plugin.domain)
        if key in self._known:
            raise ValueError(f"{key[1]} is registered already")
        self._known[key] = plugin

    def get(self, kind: type, name: str):
        return self._known[kind, name]

    def names(self, kind: type) -> list[str]:
        return sorted(n for k, n in self._known if k is kind)


class StoreSource(DataSource):
    """A Spark data source over any store with ``keys()`` and ``read(key)``: spark.read.format("quillon_store").option("factory", "module:name").

    Keys are dealt out over ``partitions`` tasks, and each task reads its own payloads.
    """

    @classmethod
    def name(cls) -> str:
        return "quillon_store"

    def schema(self) -> str:
        return "key string, payload binary"

    def reader(self, schema) -> DataSourceReader:
        return StoreReader(self.options)


class StoreReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.factory, self.n = options["factory"], int(options.get("partitions", "8"))

    def _store(self):
        from importlib import import_module

        module, _, name = self.factory.partition(":")
        return getattr(import_module(module), name)()

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.n)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, bytes]]:
        store = self._store()
        for k, key in enumerate(sorted(store.keys())):
            if k % self.n == partition.value:
                yield key, store.read(key)


def finite(x: float) -> bool:
    return math.isfinite(x)
