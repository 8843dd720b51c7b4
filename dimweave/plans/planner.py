"""Plans: transfers from sources to targets, loaded in an order that their lookups need.

A transfer is a lazily built frame and a target.  Dimensions that look up
other dimensions come after them, facts after all dimensions; a failed
dimension stops the facts.  A parent that several transfers share is computed
once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.dimensions import build_dimension, without_key
from ..operators.lookups import Lookup
from ..operators.sequences import SequenceStore, add_sequence
from ..operators.spec import Role, TargetKind, TargetSpec
from ..operators.transforms import project_to
from .publish import exists, publish, recover

Source = Callable[[SparkSession], DataFrame] | DataFrame
Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Numbered:
    """A field that draws numbers from a sequence, in the order of some columns or else of the source's partitions."""

    field: str
    order: tuple[str, ...] = ()
    sequence: str | None = None  # the target's name if not given


@dataclass(frozen=True)
class Transfer:
    """source: a frame or what makes it; steps: a function of the dimensions loaded so far; target; the names of dimensions it looks up; a field that is numbered after the steps."""

    source: Source
    target: TargetSpec
    steps: Callable[[Mapping[str, Lookup]], list[Step]] = lambda lookups: []
    needs: tuple[str, ...] = ()
    numbered: Numbered | None = None

    def rows(self, spark: SparkSession, lookups: Mapping[str, Lookup], start: int = 0) -> DataFrame:
        df = self.source if isinstance(self.source, DataFrame) else self.source(spark)
        for step in self.steps(lookups):
            df = df.transform(step)
        if self.numbered:
            df = df.transform(add_sequence(self.numbered.field, *self.numbered.order, start=start))
        return df.transform(project_to(self.target))


def union_rows(*frames: DataFrame) -> DataFrame:
    """All rows, repeats kept, by name; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


class Plan:
    """Transfers, and the frames of their targets; nothing is stored before `load`."""

    def __init__(self, *transfers: Transfer, load_date: dt.date | None = None):
        self.transfers, self.load_date = transfers, load_date
        self.targets = {t.target.name: t.target for t in transfers}
        for t in transfers:
            if self.targets[t.target.name] != t.target:
                raise ValueError(f"{t.target.name} is declared in two ways")
            if unknown := set(t.needs) - set(self.targets):
                raise ValueError(f"{t.target.name} looks up {sorted(unknown)}, which no transfer loads")

    def stages(self) -> list[list[str]]:
        """Targets by stage: each needs only what earlier stages load; facts come last."""
        graph: dict[str, set[str]] = {n: set() for n in self.targets}
        for t in self.transfers:
            graph[t.target.name] |= set(t.needs)
        dims = {n for n, t in self.targets.items() if t.kind != TargetKind.FACT}
        for n, t in self.targets.items():
            if t.kind == TargetKind.FACT:
                graph[n] |= dims
        order, out = TopologicalSorter(graph), []
        order.prepare()
        while order.is_active():
            ready = sorted(order.get_ready())
            out.append(ready)
            order.done(*ready)
        return out

    def _target_rows(self, spark: SparkSession, name: str, lookups: Mapping[str, Lookup], next_of: dict[str, int]) -> DataFrame:
        """The rows of a target; `next_of` has what its sequences give next, and is moved on."""
        frames = []
        for t in (t for t in self.transfers if t.target.name == name):
            sequence = t.numbered and (t.numbered.sequence or name)
            frames.append(t.rows(spark, lookups, next_of.get(sequence, 0) if sequence else 0))
            if sequence:
                next_of[sequence] = next_of.get(sequence, 0) + frames[-1].count()  # of a stored table
        return union_rows(*frames)

    def frames(self, spark: SparkSession, existing: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """Every target's frame: one lazy plan each, for queries and tests."""
        lookups: dict[str, Lookup] = {}
        out: dict[str, DataFrame] = {}
        numbers: dict[str, int] = {}
        for name in (n for stage in self.stages() for n in stage):
            target, rows = self.targets[name], self._target_rows(spark, name, lookups, numbers)
            if target.kind == TargetKind.FACT:
                out[name] = rows
            else:
                out[name] = build_dimension(rows, target, self.load_date, (existing or {}).get(name))
                lookups[name] = lookup_of(out[name], target)
        return out

    def load(self, spark: SparkSession, warehouse: str, format: str = "parquet", facts: str = "append") -> dict[str, int]:
        """Loads and stores all targets below `warehouse`; the rows written to each.

        Dimensions are merged with what they hold; facts are appended, or with
        `facts` "overwrite" replaced, so that a repeated load changes nothing.  Rows
        without a business key are set aside in ``<target>_rejects``.  What
        sequences give next and the targets' row counts are kept in
        ``_sequences``, stored after each target is.
        """
        store = SequenceStore(spark, f"{warehouse.rstrip('/')}/_sequences")
        numbers = {s: store.next_of(s) for s in {t.numbered.sequence or t.target.name for t in self.transfers if t.numbered}}
        lookups: dict[str, Lookup] = {}
        counts: dict[str, int] = {}
        shared = self._shared()
        for df in shared:
            df.persist()
        try:
            for name in (n for stage in self.stages() for n in stage):
                target, path = self.targets[name], self.targets[name].location or f"{warehouse.rstrip('/')}/{name}"
                rows, seen = self._target_rows(spark, name, lookups, numbers), Observation(name)
                if target.kind == TargetKind.FACT:
                    publish(rows.observe(seen, F.count(F.lit(1)).alias("rows")), path, facts, format)
                else:
                    recover(spark, path)
                    old = spark.read.format(format).load(path) if exists(spark, path) else None
                    lost = without_key(rows, target)
                    if not lost.isEmpty():
                        publish(lost, f"{path}_rejects", "append", "parquet")
                    built = build_dimension(rows, target, self.load_date, old)
                    publish(built.observe(seen, F.count(F.lit(1)).alias("rows")), path, "overwrite", format)
                    lookups[name] = lookup_of(spark.read.format(format).load(path), target)
                counts[name] = seen.get["rows"]
                if numbers:
                    store.commit(**numbers)
            store.set_row_counts(**counts)
        finally:
            for df in shared:
                df.unpersist()
        return counts

    def _shared(self) -> list[DataFrame]:
        """Frames that are the source of two transfers or more."""
        frames = [t.source for t in self.transfers if isinstance(t.source, DataFrame)]
        return [f for i, f in enumerate(frames) if sum(g is f for g in frames) > 1 and all(g is not f for g in frames[:i])]


def lookup_of(dim: DataFrame, target: TargetSpec) -> Lookup:
    return Lookup(dim, target.named(Role.LOOKUP), target.first(Role.PRI), target.first(Role.SCD_VALIDFROM), target.first(Role.SCD_VALIDTO))


def row_counts(**frames: DataFrame) -> DataFrame:
    """(name, rows) of each frame."""
    return union_rows(*(df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in frames.items()))
