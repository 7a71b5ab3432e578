"""Tables with one row per key as a log of changes: small writes, merged when read.

A write adds one folder of changed rows, cut into buckets by a hash of the key; nothing else is
rewritten. Reading takes the latest change of each key and the rows of the base that no change
touches; a reader that names its buckets opens only those. ``compact`` folds changes together once there
are many, and into the base once they are a fair share of it, so a change is rewritten a few
times in all, however many writes there are.

Which folders count is said by a small manifest that is written after them, in turn into one of two
places: the other one always holds the version before, so a writer lost at any moment leaves a
table to read. One writer at a time; a batch that is delivered again replaces its own folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.schemas import parse

BUCKETS = 32
#: Change folders beyond which ``compact`` folds them, and their share of the base that joins it.
MOST_CHANGES = 8
SHARE = 0.25
ENTRY = "version LONG, seq LONG, kind STRING, folder STRING, run STRING, batch LONG, rows LONG"


@dataclass(frozen=True)
class Entry:
    """A folder of the table: its base, a change, or one that counts no more and may be emptied."""

    seq: int
    kind: str
    folder: str
    run: str
    batch: int
    rows: int


def _found(reader, *paths: str) -> DataFrame | None:
    try:
        return reader.parquet(*paths)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


class KeyedLog:
    """A table under ``path`` with the columns ``schema`` and one row per ``key``."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str | T.StructType,
        key: str = "content_id",
        buckets: int = BUCKETS,
        most_changes: int = MOST_CHANGES,
        share: float = SHARE,
    ) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = parse(schema) if isinstance(schema, str) else schema
        self.most_changes, self.share = most_changes, share

    # --- Manifest ---

    def _listed(self, tries: int = 3) -> list:
        read = _found(self.spark.read.schema(f"{ENTRY}, slot INT"), f"{self.path}/manifest")
        try:
            return [] if read is None else read.collect()
        except PySparkException:
            if tries == 1:
                raise
            return self._listed(tries - 1)  # a writer has just replaced one of the two places

    def manifest(self) -> tuple[int, list[Entry]]:
        """The latest version and its folders in order; (0, []) before the first write."""
        rows = self._listed()
        version = max((r.version for r in rows), default=0)
        entries = [Entry(r.seq, r.kind, r.folder, r.run, r.batch, r.rows) for r in rows if r.version == version]
        return version, sorted(entries, key=lambda e: e.seq)

    def _publish(self, version: int, entries: Sequence[Entry]) -> int:
        rows = [(version, e.seq, e.kind, e.folder, e.run, e.batch, e.rows) for e in entries]
        frame = self.spark.createDataFrame(rows, ENTRY).coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.path}/manifest/slot={version % 2}")
        return version

    # --- Reading ---

    def bucket_of(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of the keys; at most as many numbers as there are buckets."""
        return sorted(r.b for r in keys.select(self.bucket_of().alias("b")).distinct().collect())

    def _folders(self, entries: Sequence[Entry], buckets: Sequence[int] | None) -> DataFrame | None:
        if not entries:
            return None
        schema = T.StructType([*self.schema, T.StructField("_seq", T.LongType()), T.StructField("bucket", T.IntegerType())])
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data")
        # The folder is a partition column too, so that all folders are one scan.
        full = rows.schema(T.StructType([*schema, T.StructField("folder", T.StringType())]))
        read = full.parquet(*(f"{self.path}/data/folder={e.folder}" for e in entries)).drop("folder")
        return read if buckets is None else read.filter(F.col("bucket").isin(list(buckets)))

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != self.key]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.col("_seq")).alias("_r"))
        return last.select(self.key, *(F.col("_r")[c].alias(c) for c in rest)).select(*rows.columns)

    def _merged(self, entries: Sequence[Entry], buckets: Sequence[int] | None) -> DataFrame | None:
        base = self._folders([e for e in entries if e.kind == "base"], buckets)
        changes = self._folders([e for e in entries if e.kind == "change"], buckets)
        if changes is None:
            return base
        if base is None:
            return self._latest(changes)
        keys = changes.select(self.key).distinct()
        untouched = base.join(keys, self.key, "left_anti")
        if min(e.seq for e in entries if e.kind == "change") < max(e.seq for e in entries if e.kind == "base"):
            # A batch that stayed apart from a fold may be older than what was folded.
            changes = changes.unionByName(base.join(keys, self.key, "left_semi"))
        return untouched.unionByName(self._latest(changes))

    def read(self, buckets: Sequence[int] | None = None, skip: tuple[str, int] | None = None) -> DataFrame:
        """The table as it is now: of these buckets, and without what one batch has written."""
        _, entries = self.manifest()
        live = [e for e in entries if (e.run, e.batch) != skip]
        rows = self._merged(live, buckets)
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        return rows.select(*self.schema.fieldNames())

    # --- Writing ---

    def _write(self, rows: DataFrame, folder: str) -> int:
        """Write one folder cut into buckets; gives its number of rows."""
        counted = Observation()
        cut = rows.withColumn("bucket", self.bucket_of()).hint("rebalance", F.col("bucket"))
        cut = cut.observe(counted, F.count(F.lit(1)).alias("n"))
        cut.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/folder={folder}")
        return counted.get["n"]

    def _shaped(self, rows: DataFrame, seq: int) -> DataFrame:
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        return rows.select(*columns, F.lit(seq).cast("long").alias("_seq"))

    def replace(self, rows: DataFrame) -> int:
        """Make these rows (one per key) the whole table; gives the new version."""
        version, entries = self.manifest()
        seq = max((e.seq for e in entries), default=0) + 1
        folder = f"base-{version + 1}"
        count = self._write(self._shaped(rows, seq), folder)
        self._empty(entries)
        gone = [replace(e, kind="gone") for e in entries if e.kind != "gone"]
        return self._publish(version + 1, [*gone, Entry(seq, "base", folder, "", -1, count)])

    def add(self, rows: DataFrame, run: str, batch: int) -> int:
        """Add changed rows (one per key) as batch ``batch`` of ``run``; doing it again replaces them."""
        version, entries = self.manifest()
        own = next((e for e in entries if (e.run, e.batch, e.kind) == (run, batch, "change")), None)
        seq = own.seq if own else max((e.seq for e in entries), default=0) + 1
        folder = f"{run}-{batch}"
        count = self._write(self._shaped(rows, seq), folder)
        rest = [e for e in entries if e is not own]
        return self._publish(version + 1, [*rest, Entry(seq, "change", folder, run, batch, count)])

    def changes(self, run: str, batch: int) -> DataFrame:
        """The rows one batch has written, while ``compact`` has not folded them."""
        found = self._folders([e for e in self.manifest()[1] if (e.run, e.batch, e.kind) == (run, batch, "change")], None)
        if found is None:
            return self.spark.createDataFrame([], self.schema)
        return found.select(*self.schema.fieldNames())

    def _empty(self, entries: Sequence[Entry]) -> None:
        """Empty the folders that no version since the last fold has counted."""
        shape = T.StructType([*self.schema, T.StructField("_seq", T.LongType())])
        for e in entries:
            if e.kind == "gone":
                none = self.spark.createDataFrame([], shape)
                none.write.mode("overwrite").parquet(f"{self.path}/data/folder={e.folder}")

    def compact(self, always: bool = False) -> bool:
        """Fold the changes once there are many; True when something was folded.

        The newest batch of every run stays apart, for it may be delivered again. Folders folded
        now are emptied by the next fold, when no reader uses them any more.
        """
        version, entries = self.manifest()
        newest = {e.run: e.batch for e in sorted(entries, key=lambda e: e.batch) if e.kind == "change"}
        old = [e for e in entries if e.kind == "change" and (e.run == "" or newest[e.run] != e.batch)]
        if not old or (len(old) <= self.most_changes and not always):
            return False
        base = [e for e in entries if e.kind == "base"]
        whole = always or not base or sum(e.rows for e in old) >= self.share * sum(e.rows for e in base)
        # Rows keep their seq, so what stays apart still compares with them.
        folded = [*base, *old] if whole else old
        rows = self._merged(folded, None)
        kind, folder = ("base" if whole else "change"), f"fold-{version + 1}"
        count = self._write(rows.select(*self.schema.fieldNames(), "_seq"), folder)
        seq = max(e.seq for e in folded)
        kept = [e for e in entries if e not in folded and e.kind != "gone"]
        self._empty(entries)
        gone = [replace(e, kind="gone") for e in folded]
        self._publish(version + 1, [*gone, *kept, Entry(seq, kind, folder, "", version + 1, count)])
        return True
