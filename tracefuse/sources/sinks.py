"""Table sinks (S7, S8): whole-table replacement and checks in the writing pass.

A table is written beside the old one and swapped in by renames once it is
complete (Spark's ``_SUCCESS`` marker) and its checks have passed, so a job that
dies leaves the old table readable.  The counts that the checks need are
collected by the writing job itself (``Observation``), not by jobs of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tracefuse.session import hadoop_path

_NEW, _OLD = ".new-", ".old-"
_AQE_EXCLUDED = "spark.sql.adaptive.optimizer.excludedRules"
_EMPTY_RULE = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"


def _beside(spark: SparkSession, path: str, kind: str) -> list:
    """Complete side tables of a path, the latest first."""
    fs, at = hadoop_path(spark, path.rstrip("/"))
    if at.getParent() is None or not fs.exists(at.getParent()):
        return []
    jvm = spark._jvm.org.apache.hadoop.fs
    found = [s for s in fs.listStatus(at.getParent()) if s.getPath().getName().startswith(f".{at.getName()}{kind}")]
    whole = [s for s in found if fs.exists(jvm.Path(s.getPath(), "_SUCCESS"))]
    return [s.getPath() for s in sorted(whole, key=lambda s: -s.getModificationTime())]


def recover_table(spark: SparkSession, path: str) -> bool:
    """Puts a table back whose replacement stopped between its two renames; True where it did.

    The new table is complete by then (it has its marker), so it is preferred to the old one.
    """
    fs, at = hadoop_path(spark, path.rstrip("/"))
    if fs.exists(at):
        return False
    for side in (*_beside(spark, path, _NEW), *_beside(spark, path, _OLD)):
        if fs.rename(side, at):
            return True
    return False


def _swap(spark: SparkSession, path: str, new: str, old: str) -> None:
    fs, at = hadoop_path(spark, path)
    _, new_at = hadoop_path(spark, new)
    _, old_at = hadoop_path(spark, old)
    moved = fs.exists(at) and fs.rename(at, old_at)
    if not fs.rename(new_at, at):
        if moved:
            fs.rename(old_at, at)
        raise OSError(f"{path} could not be replaced")
    if moved:
        fs.delete(old_at, True)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = (), header: bool = True, check: Callable[[], None] | None = None) -> None:
    """Features, predictions and metrics tables; metrics reports use the same sink.

    ``overwrite`` replaces the whole table after the new one is complete and
    ``check`` (called when the writing job has ended) has not raised; the old
    table may be an input of ``df``.  Other modes write in place.
    """
    spark, path = df.sparkSession, path.rstrip("/")

    def save(to: str, how: str) -> None:
        w = df.write.mode(how).format(fmt)
        if partition_by:
            w = w.partitionBy(*partition_by)
        if fmt == "csv":
            w = w.option("header", header)
        w.save(to)

    if mode != "overwrite":
        save(path, mode)
        if check:
            check()
        return
    recover_table(spark, path)
    parent, _, name = path.rpartition("/")
    run = uuid.uuid4().hex
    new, old = (f"{parent}/.{name}{kind}{run}" if parent else f".{name}{kind}{run}" for kind in (_NEW, _OLD))
    try:
        save(new, "errorifexists")
        if check:
            check()
        _swap(spark, path, new, old)
    finally:
        fs, at = hadoop_path(spark, new)
        fs.delete(at, True)


class CheckedWrite:
    """Counts collected while a table is written, and the rules they must meet.

    A task of an inner stage that runs again may be counted again, so counts of
    lines are exact without lost executors and never too small; those of the
    written rows are exact.  In a session that has collected counts, Spark 4.1
    cannot send an MLlib model with a training summary to its tasks:
    ``models.score`` drops the summary, other callers use ``models.without_summary``.
    """

    def __init__(self):
        self._observed: dict[str, Observation] = {}
        self._rules: list[tuple[Callable[[Mapping[str, dict]], str | None], type[Exception]]] = []
        self.counts: dict[str, dict] = {}

    def observe(self, df: DataFrame, name: str, **counts: Column) -> DataFrame:
        """``df`` with counts (aggregates) that the writing job collects under ``name``."""
        self._observed[name] = Observation(f"{name}-{uuid.uuid4().hex}")
        return df.observe(self._observed[name], *[c.alias(n) for n, c in counts.items()])

    def require(self, rule: Callable[[Mapping[str, dict]], str | None], error: type[Exception] = ValueError) -> None:
        """``rule`` sees all counts and returns what is wrong, or None."""
        self._rules.append((rule, error))

    def _check(self) -> None:
        self.counts = {name: o.get for name, o in self._observed.items()}
        for rule, error in self._rules:
            if wrong := rule(self.counts):
                raise error(wrong)

    def write(self, df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> dict[str, dict]:
        """Writes, checks and swaps in; returns the counts.  Where a rule fails, the old table stays."""
        # AQE would drop an input that turned out empty from the plan, and its counts with it
        conf = df.sparkSession.conf
        before = conf.get(_AQE_EXCLUDED, None)
        conf.set(_AQE_EXCLUDED, ",".join([before, _EMPTY_RULE] if before else [_EMPTY_RULE]))
        try:
            write_table(df, path, fmt=fmt, partition_by=partition_by, check=self._check)
        finally:
            conf.set(_AQE_EXCLUDED, before) if before else conf.unset(_AQE_EXCLUDED)
        return self.counts


def contract_counts(contract: Sequence[str]) -> dict[str, Column]:
    """Aggregates for :meth:`CheckedWrite.observe`: rows, and NULL or NaN values in the contract's columns."""
    bad = F.lit(0).cast("bigint")
    for c in contract:
        v = F.col(f"`{c}`")
        bad = bad + F.count_if(v.isNull() | F.isnan(v))
    return {"rows": F.count(F.lit(1)), "bad": bad}
