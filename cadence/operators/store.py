"""A store of partial aggregates: sums kept per landed slice, replaced one slice at
a time, merged when they are read.

    <path>/data/slice=2024-01/version=3/   the partials of a slice (keys, s, n, rows)
    <path>/whole/slice=2024-01/version=3/  a note that they are whole, written last

A slice counts with its latest whole version. Putting a slice again writes a new
version beside the old one, so a reader never meets half a slice, a run that died
leaves nothing that counts, and running it again gives the same result. Only the
slice's own facts are scanned for it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.binding import FactSet
from cadence.operators.aggregate import Keys, by_keys, key_sums
from cadence.sinks.writers import delete_folder, list_folders


@dataclass(frozen=True)
class PartialStore:
    spark: SparkSession
    path: str
    keys: Sequence[str]

    def _versions(self, kind: str) -> dict[str, list[int]]:
        """slice -> versions, by the folders there are: slices are calendar units,
        so there are few."""
        out: dict[str, list[int]] = {}
        for folder in list_folders(self.spark, f"{self.path}/{kind}"):
            name = folder.removeprefix("slice=")
            found = list_folders(self.spark, f"{self.path}/{kind}/{folder}")
            out[name] = sorted(int(v.removeprefix("version=")) for v in found)
        return out

    def latest(self) -> dict[str, int]:
        """slice -> the version that counts."""
        return {s: v[-1] for s, v in self._versions("whole").items() if v}

    def put(self, name: str, partials: DataFrame) -> int:
        """Set the partials (keys, s, n, rows) of a slice; returns the version."""
        if not name or "/" in name or "=" in name:
            raise ValueError(f"no slice name: {name!r}")
        taken = self._versions("data").get(name, [])
        version = max([*taken, *self._versions("whole").get(name, [])], default=0) + 1
        at = f"slice={name}/version={version}"
        partials.select(*self.keys, "s", "n", "rows").write.parquet(f"{self.path}/data/{at}")
        self.spark.range(1).write.json(f"{self.path}/whole/{at}")
        return version

    def put_month(self, fs: FactSet, year: int, month: int, keys: Keys) -> int:
        """Set the slice of a month from the facts of that month alone."""
        return self.put(f"{year:04d}-{month:02d}", key_sums(fs.for_month(year, month), keys))

    def missing_months(self, months: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
        have = self.latest()
        return [(y, m) for y, m in months if f"{y:04d}-{m:02d}" not in have]

    def partials(self, slices: Sequence[str] | None = None) -> DataFrame:
        """The stored rows of all slices (or some), with their slice."""
        latest = self.latest()
        chosen = sorted(latest) if slices is None else [s for s in slices if s in latest]
        if not chosen:
            raise ValueError("the store has no such slice")
        paths = [f"{self.path}/data/slice={s}/version={latest[s]}" for s in chosen]
        rows = self.spark.read.option("basePath", f"{self.path}/data").parquet(*paths)
        return rows.withColumn("slice", F.col("slice").cast("string")).drop("version")

    def merged(self, slices: Sequence[str] | None = None) -> DataFrame:
        """(keys, s, n, rows) over all slices (or some): equal to one pass over their facts."""
        return by_keys(self.partials(slices), self.keys)

    def vacuum(self, keep: int = 2) -> int:
        """Remove versions older than the last ``keep`` whole ones of each slice, and
        data of runs that died before a later whole version. Returns how many went.
        A reader that began up to ``keep`` - 1 versions ago is not disturbed."""
        gone = 0
        whole, data = self._versions("whole"), self._versions("data")
        for name, versions in data.items():
            kept = whole.get(name, [])[-max(1, keep) :]
            for v in versions:
                if kept and v < kept[-1] and v not in kept:
                    delete_folder(self.spark, f"{self.path}/whole/slice={name}/version={v}")
                    delete_folder(self.spark, f"{self.path}/data/slice={name}/version={v}")
                    gone += 1
        return gone
