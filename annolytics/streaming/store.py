"""A project's tables, upserted and deleted from in single commits, by any number of jobs at once.

Upserts are appended as folded states, which can be combined in any order and grouping, so two that meet lose nothing.
Reading folds the folders of one snapshot. Folders are merged in tiers, so their number grows with the logarithm of the number of commits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics.operators.annotations import KEY, ML_KEY, fold_submissions, merge_states, state_rows
from annolytics.plans.sizing import broadcast_if_small
from annolytics.sources.snapshots import Segment, Snapshot, commit, latest_snapshot

DELETED = "deleted projects"
#: How many folders of a tier are merged into one of the next.
FAN_IN = 8


class Table(NamedTuple):
    """How a table is kept: its key, the columns of a state, and how submissions become states and states rows.

    The last state of a key wins, by ``last``; annotations keep the first time as well.
    """

    key: list[str]
    schema: str
    states: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    rows: Callable[[DataFrame], DataFrame]


def _last_wins(key: list[str], columns: dict[str, str], made: bool = False) -> Table:
    """A table of rows that are replaced whole. ``made`` adds both times of the last submission."""
    fields = ", ".join(f"{name}:{kind}" for name, kind in {"ts": "timestamp_ntz", "event_id": "bigint", **columns}.items())
    keys = ", ".join(f"{name} {'bigint' if name == 'row_index' else 'string'}" for name in key)

    def merge(states: DataFrame) -> DataFrame:
        return states.groupBy(*key).agg(F.max("last").alias("last"))

    def states(submissions: DataFrame) -> DataFrame:
        return merge(submissions.select(*key, F.struct("ts", "event_id", *columns).alias("last")))

    def rows(states: DataFrame) -> DataFrame:
        times = [F.col("last.ts").alias("created_at"), F.col("last.ts").alias("updated_at")] if made else []
        return states.select(*key, *[F.col(f"last.{name}").alias(name) for name in columns], *times)

    return Table(key, f"{keys}, last struct<{fields}>", states, merge, rows)


def _sums(key: list[str], columns: list[str]) -> Table:
    """A table of counts, of which every commit adds its share."""
    keys = [f"{name} {'bigint' if name == 'row_index' else 'string'}" for name in key]

    def merge(states: DataFrame) -> DataFrame:
        return states.groupBy(*key).agg(*[F.sum(name).alias(name) for name in columns])

    return Table(key, ", ".join([*keys, *[f"{name} bigint" for name in columns]]), lambda rows: merge(rows.select(*key, *columns)), merge, lambda states: states)


TABLES = {
    "annotations": Table(
        KEY,
        "project_id string, row_index bigint, user_id string, created_at timestamp_ntz, last struct<ts:timestamp_ntz,event_id:bigint,data:string>",
        fold_submissions,
        merge_states,
        state_rows,
    ),
    "ml_annotations": _last_wins(ML_KEY, {"annotator": "string", "data": "string"}, made=True),
    "permissions": _last_wins(["project_id", "user_id"], {"role": "string"}),
    "projects": _last_wins(["project_id"], {"name": "string", "tags": "string"}),
    "project_progress": _sums(["project_id"], ["annotated_rows", "total_annotations"]),
    "user_progress": _sums(["project_id", "user_id"], ["annotated_rows"]),
    "row_progress": _sums(["project_id", "row_index"], ["n_annotations"]),
}


class ProjectStore:
    """The tables of ``TABLES`` below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, fan_in: int = FAN_IN):
        self.spark, self.root, self.fan_in = spark, root.rstrip("/"), fan_in

    def _folder(self) -> str:
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def _add(self, tables: dict[str, str], stream: str | None = None, batch: int = 0) -> Snapshot:
        """Commit new folders, by table, all at once."""

        def change(base: Snapshot) -> Snapshot | None:
            if stream is not None and base.batches.get(stream, -1) >= batch:
                return None
            at = base.version + 1
            added = tuple(Segment(table, folder, 0, at, at) for table, folder in tables.items())
            batches = {**base.batches, stream: batch} if stream is not None else base.batches
            return Snapshot(at, base.segments + added, batches)

        return commit(self.spark, self.root, change)

    def upsert(self, submissions: dict[str, DataFrame], stream: str | None = None, batch: int = 0) -> None:
        """Upsert submissions, by table, in one commit.

        Submissions have the key and the columns of their table, ``ts`` and ``event_id``. A micro-batch that ``stream`` has committed already is left out.
        """
        if stream is not None and latest_snapshot(self.spark, self.root).batches.get(stream, -1) >= batch:
            return
        folders = {}
        for table, rows in submissions.items():
            folders[table] = self._folder()
            TABLES[table].states(rows).write.parquet(folders[table])
        self._add(folders, stream, batch)

    def delete_projects(self, project_ids: DataFrame) -> None:
        """Delete projects from all tables in one commit. What is upserted later for such a project is there again."""
        folder = self._folder()
        project_ids.select("project_id").distinct().write.parquet(folder)
        self._add({DELETED: folder})

    def _states(self, snapshot: Snapshot, table: str, segments: list[Segment], until: int | None = None) -> DataFrame:
        """The unmerged states of segments, without projects deleted after them (and up to a commit)."""
        schema = TABLES[table].schema
        deletions = [s for s in snapshot.of(DELETED) if until is None or s.first <= until]
        groups: dict[tuple[str, ...], list[str]] = {}
        for segment in segments:
            later = tuple(s.folder for s in deletions if s.first > segment.last)
            groups.setdefault(later, []).append(segment.folder)
        parts = []
        for later, folders in groups.items():
            rows = self.spark.read.schema(schema).parquet(*folders)
            if later:
                gone = self.spark.read.schema("project_id string").parquet(*later).distinct()
                rows = rows.join(broadcast_if_small(gone), "project_id", "left_anti").select(*rows.columns)
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def read(self, table: str, snapshot: Snapshot | None = None) -> DataFrame:
        """A table's rows, of one snapshot (the newest, unless given). Tests on the key reach the scan."""
        snapshot = snapshot or latest_snapshot(self.spark, self.root)
        kept = TABLES[table]
        return kept.rows(kept.merge(self._states(snapshot, table, snapshot.of(table))))

    def snapshot(self) -> Snapshot:
        """One snapshot to read several tables by."""
        return latest_snapshot(self.spark, self.root)

    def compact(self, table: str) -> int:
        """Merge folders of a tier, the oldest first, wherever there are ``fan_in`` of them, while others write and read. Gives the number of merges.

        The merged folder takes the place of its parts in one commit, if they are all still there. Parts stay on disk, for readers of older snapshots.
        """
        merges = 0
        while True:
            snapshot = latest_snapshot(self.spark, self.root)
            chosen = next((run for run in self._runs(snapshot.of(table))), None)
            if chosen is None:
                return merges
            kept, folder, last = TABLES[table], self._folder(), chosen[-1].last
            merged = kept.merge(self._states(snapshot, table, chosen, until=last))
            merged.repartitionByRange(*kept.key).sortWithinPartitions(*kept.key).write.parquet(folder)
            whole = Segment(table, folder, chosen[0].tier + 1, chosen[0].first, last)

            def change(base: Snapshot) -> Snapshot | None:
                if not set(chosen) <= set(base.segments):
                    return None
                rest = tuple(s for s in base.segments if s not in chosen)
                oldest = min(s.last for s in (*rest, whole) if s.table != DELETED)
                # Deletions that come before all that is left have nothing more to delete.
                live = tuple(s for s in rest if s.table != DELETED or s.first > oldest)
                return base._replace(segments=(*live, whole))

            commit(self.spark, self.root, change)
            merges += 1

    def _runs(self, segments: list[Segment]):
        """Neighbouring folders of one tier, as many as are merged."""
        for at in range(len(segments) - self.fan_in + 1):
            run = segments[at : at + self.fan_in]
            if len({s.tier for s in run}) == 1:
                yield run
