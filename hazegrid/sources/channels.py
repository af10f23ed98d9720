"""Channel tables of a database: read by many tasks, and only what is new.

The clock column (last change of a row) does three things. Its range, narrowed by counts that the database
makes, becomes one condition for each task, so tasks read about equally many rows however the rows crowd in
time. Its newest value so far is where the next read begins. And it tells which version of a row is current.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Key and clock of the channel tables.
KEYS = {"citizen_reports": ("id", "ts"), "inspection_status": ("action_id", "updated_at")}
#: Rows that one task reads, about.
ROWS_PER_TASK = 250_000
#: A stretch of time is not cut below this, however many rows it holds.
SHORTEST = timedelta(seconds=1)


class Stretch(NamedTuple):
    """Rows with low < clock <= high, or low <= clock for the first one."""

    low: datetime
    high: datetime
    closed: bool
    rows: int


def _sql(spark: SparkSession, jdbc: dict, text: str) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc).option("preferTimestampNTZ", True).option("query", text).load()


def _at(t: datetime) -> str:
    return "{ts '" + t.strftime("%Y-%m-%d %H:%M:%S.%f") + "'}"


class Channel:
    """A channel table behind a JDBC address. ``jdbc`` holds url, driver, user and the like.

    The database's clock is read as it stands, as UTC. ``quote`` puts names as the database wants them.
    """

    def __init__(self, spark: SparkSession, name: str, jdbc: dict, clock: str | None = None, key: str | None = None, quote: str = '"{}"'):
        own_key, own_clock = KEYS.get(name, (None, None))
        self.spark, self.name, self.jdbc = spark, name, dict(jdbc)
        self.key, self.clock = key or own_key, clock or own_clock
        if not self.key or not self.clock:
            raise ValueError(f"name the key and the clock column of {name!r}")
        self.table, self.column = quote.format(name), quote.format(self.clock)

    def _where(self, s: Stretch) -> str:
        return f"{self.column} {'>=' if s.closed else '>'} {_at(s.low)} AND {self.column} <= {_at(s.high)}"

    def bounds(self, since: datetime | None = None) -> Stretch | None:
        """The stretch of rows from ``since`` on (all by default), with its count; None without rows. One small query."""
        text = f"SELECT MIN({self.column}) AS a, MAX({self.column}) AS b, COUNT({self.column}) AS n FROM {self.table}"
        row = _sql(self.spark, self.jdbc, text + (f" WHERE {self.column} >= {_at(since)}" if since else "")).first()
        return Stretch(row[0], row[1], True, int(row[2])) if row[2] else None

    def stretches(self, whole: Stretch, rows_per_task: int = ROWS_PER_TASK) -> list[Stretch]:
        """Cut ``whole`` until no stretch holds more rows than a task should read; one counting query a round.

        Each round halves every stretch that is still too full; sixteen stretches are counted in a query.
        """
        done, open_ = [], [whole]
        while open_:
            halves = []
            for s in open_:
                if s.rows <= rows_per_task or s.high - s.low <= SHORTEST:
                    done.append(s)
                    continue
                middle = s.low + (s.high - s.low) / 2
                halves += [Stretch(s.low, middle, s.closed, 0), Stretch(middle, s.high, False, 0)]
            open_ = []
            for at in range(0, len(halves), 16):
                part = halves[at : at + 16]
                sums = ", ".join(f"SUM(CASE WHEN {self._where(s)} THEN 1 ELSE 0 END) AS n{k}" for k, s in enumerate(part))
                span = Stretch(part[0].low, part[-1].high, part[0].closed, 0)
                counts = _sql(self.spark, self.jdbc, f"SELECT {sums} FROM {self.table} WHERE {self._where(span)}").first()
                open_ += [s._replace(rows=int(n or 0)) for s, n in zip(part, counts, strict=True)]
            open_ = [s for s in open_ if s.rows]
        return sorted(done)

    def read(self, since: datetime | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
        """Rows changed at ``since`` or later, up to the newest row at the time of the call; all by default.

        One partition for each stretch. Rows without a clock come in one partition of their own, and only in a
        read of everything. A table without rows gives an empty frame with its columns.
        """
        whole = self.bounds(since)
        conditions = [self._where(s) for s in self.stretches(whole, rows_per_task)] if whole else []
        if since is None:
            conditions.append(f"{self.column} IS NULL")
        properties = {k: str(v) for k, v in self.jdbc.items() if k not in ("url", "dbtable")} | {"preferTimestampNTZ": "true"}
        rows = self.spark.read.jdbc(self.jdbc["url"], self.table, predicates=conditions or ["1 = 0"], properties=properties)
        plain = {f.name: F.col(f"`{f.name}`").cast("timestamp") for f in rows.schema if f.dataType == T.TimestampNTZType()}
        return rows.withColumns(plain) if plain else rows

    def sync(self, path: str, overlap: timedelta = timedelta(hours=1), rows_per_task: int = ROWS_PER_TASK) -> int:
        """Append what is new to the table under ``path``; the number of rows appended.

        The newest stored clock less ``overlap`` is where the read begins, so a row that the database shows late is
        still found; rows of the overlap that are stored already are left out. Nothing but the table itself records
        how far it reaches: a run that dies before its commit leaves no trace and is simply repeated.
        """
        try:
            stored = self.spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            stored = None
        newest = stored.agg(F.date_format(F.max(self.clock), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0] if stored is not None else None
        since = datetime.strptime(newest, "%Y-%m-%d %H:%M:%S.%f") - overlap if newest else None
        rows = self.read(since, rows_per_task)
        if stored is not None:
            known = stored if since is None else stored.where(F.col(self.clock) >= F.lit(since.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp"))
            mark = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(rows.columns)]).alias("_mark")
            same = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in (self.key, self.clock, "_mark")]
            old = known.select(self.key, self.clock, mark).distinct().alias("k")
            rows = rows.withColumn("_mark", mark).alias("n").join(old, same[0] & same[1] & same[2], "left_anti").drop("_mark")
        before = self._count(path)
        rows.write.mode("append").parquet(path)
        return self._count(path) - before

    def _count(self, path: str) -> int:
        try:
            return self.spark.read.parquet(path).count()
        except AnalysisException:
            return 0

    def current(self, path: str) -> DataFrame:
        """The newest version of each key in a table that ``sync`` keeps; ties go to the larger row."""
        stored = self.spark.read.parquet(path)
        others = [c for c in stored.columns if c != self.key]
        newest = F.max_by(F.struct(*others), F.struct(self.clock, *[c for c in others if c != self.clock])).alias("_new")
        return stored.groupBy(self.key).agg(newest).select(self.key, "_new.*").select(*stored.columns)
