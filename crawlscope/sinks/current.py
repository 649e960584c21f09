"""Tables on disk of which a run rewrites only the folders that its rows fall in.

A current-state table lies in folders `buckets=<count>/bucket=<n>/` of Parquet files; a row's bucket is the hash of some of its key
columns. A history lies in folders by date. A merge reads the touched folders (Spark prunes the others), writes what becomes of
them beside the table, and then lets that replace them, folder by folder. If a run breaks off while replacing, the written copy
is still whole and the next run begins by finishing it; as every merge can be applied twice, a run that broke off earlier is
simply repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscope.operators import ledger
from crawlscope.session import cut_lineage
from crawlscope.skew import lookup_join

# Rows that one task writes into a bucket, about.
ROWS_PER_FILE = 2_000_000
# Sites whose newest dates are sent to every task, a few dozen bytes each.
SITES_SENT = 500_000


class FolderTable:
    """Rows in folders by the value of one column, with swaps of whole folders."""

    folder: str

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    @property
    def _root(self) -> str:
        return self.path

    @property
    def _staging(self) -> str:
        return f"{self.path}-staging"

    def _folder_of(self) -> Column:
        return F.col(self.folder)

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _there(self, path: str) -> bool:
        place, system = self._place(path)
        return system.exists(place)

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self._root)

    def _merge(self, updates: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> list:
        """Replace the folders that `updates` fall in by what `merged` makes of their rows. Gives back these folders."""
        self._finish()
        updates = cut_lineage(updates.withColumn(self.folder, self._folder_of()))
        # one row per touched folder: a bounded number of buckets, or the days of a landing
        counts = {r[0]: r[1] for r in updates.groupBy(self.folder).count().collect()}
        if not counts:
            return []
        touched = sorted(counts)
        if self._there(self._root):
            old = self._stored().filter(F.col(self.folder).isin(touched))
            for r in old.groupBy(self.folder).count().collect():
                counts[r[0]] += r[1]
        else:
            old = self.spark.createDataFrame([], updates.schema)
        rows = merged(old, updates).withColumn(self.folder, self._folder_of())
        files = F.create_map(*[F.lit(v) for b in touched for v in (b, 1 + counts[b] // ROWS_PER_FILE)])
        # a folder leaves in as many parts as its rows ask for, dealt by the hash of the whole key
        part = F.pmod(F.xxhash64(*self.keys), F.coalesce(F.try_element_at(files, F.col(self.folder)), F.lit(1)))
        rows.repartition(self.folder, part).write.partitionBy(self.folder).parquet(self._staging, mode="overwrite")
        self._finish()
        return touched

    def _finish(self) -> None:
        """Let written folders take the place of the table's; nothing happens where none were written in full.

        A folder leaves the staging place only by the renaming that puts it in its own, so this can be begun again at any point.
        """
        if not self._there(f"{self._staging}/_SUCCESS"):
            return
        staging, system = self._place(self._staging)
        root, _ = self._place(self._root)
        system.mkdirs(root)
        for status in system.listStatus(staging):
            name = status.getPath().getName()
            if name.startswith(f"{self.folder}="):
                target, _ = self._place(f"{self._root}/{name}")
                system.delete(target, True)
                if not system.rename(status.getPath(), target):
                    raise OSError(f"{status.getPath()} cannot be moved to {self._root}")
        system.delete(staging, True)


class CurrentTable(FolderTable):
    """Rows by natural key. `by` names the key columns that decide a row's bucket; all of `keys` if not given.

    Buckets by a part of the key keep the slices of that part together, so replacing one touches one bucket. Within a bucket
    rows are dealt over as many files as their number asks for, so a heavy slice is written by many tasks.
    """

    folder = "bucket"

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], by: Sequence[str] | None = None, buckets: int = 256) -> None:
        super().__init__(spark, path, keys)
        self.by, self.buckets = list(by or keys), buckets

    @property
    def _root(self) -> str:
        return f"{self.path}/buckets={self.buckets}"

    def _folder_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame | None:
        """All rows; None before the first merge."""
        self._finish()
        if not self._there(self.path):
            return None
        if not self._there(self._root):
            raise ValueError(f"{self.path} is not a table of {self.buckets} buckets")
        return self._stored().drop(self.folder)

    def upsert(self, updates: DataFrame, keep: Sequence[str] = (), order: str | None = None) -> list[int]:
        """See `operators.ledger.upsert`. Gives back the buckets that were rewritten."""
        return self._merge(updates, lambda old, new: ledger.upsert(old, new, self.keys, keep, order))

    def pages_upsert(self, crawled: DataFrame) -> list[int]:
        """See `operators.ledger.pages_upsert`."""
        return self.upsert(crawled.withColumn("first_seen", F.col("last_crawled")), keep=["first_seen"], order="last_crawled")

    def replace_slice(self, updates: DataFrame, keys: Sequence[str]) -> list[int]:
        """See `operators.ledger.replace_slice`; the buckets must go by columns of the slice, or slices would be cut."""
        if not set(self.by) <= set(keys):
            raise ValueError(f"buckets go by {self.by}, which do not lie within the slice's {list(keys)}")
        return self._merge(updates, lambda old, new: ledger.replace_slice(old, new, keys))

    def greatest(self, updates: DataFrame, order: str) -> list[int]:
        """Per key the row with the greatest `order`, of those there and those brought; of equal ones the one brought."""
        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.withColumn("_brought", F.lit(0)).unionByName(new.withColumn("_brought", F.lit(1)))
            values = [c for c in new.columns if c not in self.keys]
            top = both.groupBy(*self.keys).agg(F.max_by(F.struct(*values), F.struct(order, "_brought")).alias("_row"))
            return top.select(*self.keys, "_row.*").select(*new.columns)

        return self._merge(updates, merged)


class History(FolderTable):
    """Facts of all dates, in a folder per date, beside a small table of each site's newest date.

    The newest rows are found from the small table: the dates in it say which folders to read at all, so a history of years
    costs no more than its newest days.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ("project_id",), date: str = "date", buckets: int = 16) -> None:
        super().__init__(spark, f"{path.rstrip('/')}/rows", [*keys, date])
        self.sites, self.folder = list(keys), date
        self._newest = CurrentTable(spark, f"{path.rstrip('/')}/newest", keys, buckets=buckets)

    def land(self, rows: DataFrame) -> list:
        """Put rows in place of those of the same site and date; a window landed twice changes nothing. Gives back the dates.

        A row without a date belongs to no window and is left out.
        """
        rows = cut_lineage(rows.filter(F.col(self.folder).isNotNull()))
        dates = self._merge(rows, lambda old, new: ledger.replace_slice(old, new, [*self.sites, self.folder]))
        self._newest.greatest(rows.groupBy(*self.sites).agg(F.max(self.folder).alias(self.folder)), self.folder)
        return dates

    def read(self) -> DataFrame:
        self._finish()
        return self._stored()

    def newest(self) -> DataFrame | None:
        """The newest date of every site."""
        return self._newest.read()

    def current(self) -> DataFrame:
        """All rows of each site's newest date, in one scan of the folders that are some site's newest."""
        newest = self.newest()
        dates = [r[0] for r in newest.select(self.folder).distinct().collect()]  # at most as many as there are folders
        rows = self.read().filter(F.col(self.folder).isin(dates))
        keys = [*self.sites, self.folder]
        if newest.limit(SITES_SENT + 1).count() <= SITES_SENT:
            return rows.join(F.broadcast(newest), keys, "left_semi")
        return lookup_join(rows, newest, keys, how="left_semi")
