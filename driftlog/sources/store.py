"""A log as a stored table that queries read and writers change by whole commits.

Under one folder of any store that Spark writes to lie ``log`` (partitioned by entity and commit, each commit's rows ranged over files by user and sorted by user and sequence),
``owners`` and ``summaries`` (partitioned by commit) and ``commits``, one row per commit and entity. A commit is written first and recorded last; readers see recorded commits only,
and for an entity that was rewritten those from the rewrite on. So a failed or repeated write, or a lost executor, leaves what readers see as it was, and a rewrite
touches no file of another entity. Filters reach the scan: entities and commits (a commit knows its sequence numbers) as partitions, users and sequence numbers as
row groups. There is one writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import exists, file_system, kept

# The columns of a stored log, in order; never inferred.
LOG = (
    "seq long, op_id string, user_id long, device_id string, entity_id string, playlist_id string, operation string, payload string, "
    "created_at long, received_at long, stamp long, track_id long, entity string"
)
SCHEMAS = {
    "log": f"{LOG}, commit long",
    "owners": "playlist_id string, owner_user_id long, created_at long, commit long",
    "summaries": "user_id long, entity string, n long, head long, commit long",
    "commits": "commit long, entity string, base boolean, n long, low long, high long, source string, source_batch long",
}
FILE_ROWS = 250_000  # rows of a commit's file and of the task that sorts and writes it, about


def fitted(rows: DataFrame) -> DataFrame:
    """``rows`` in the columns of ``LOG``; one that it lacks is null, others go."""
    have = set(rows.columns)
    kinds = [c.strip().rsplit(" ", 1) for c in LOG.split(",")]
    return rows.select(*((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in kinds))


@dataclass
class Seen:
    """What the recorded commits say: the last commit, the log's head, each entity's first visible commit."""

    last: int
    head: int
    bases: dict[str, int]


class LogStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        where = f"{self.path}/{name}"
        return self.spark.read.schema(SCHEMAS[name]).parquet(where) if exists(self.spark, where) else self.spark.createDataFrame([], SCHEMAS[name])

    def seen(self) -> Seen:
        rows = self.table("commits").groupBy("entity").agg(F.max("commit").alias("last"), F.max("high").alias("head"), F.max(F.when(F.col("base"), F.col("commit"))).alias("base")).collect()  # one row per entity
        return Seen(max((r.last for r in rows), default=0), max((r.head or 0 for r in rows), default=0), {r.entity: r.base or 0 for r in rows})

    def read(self, since: int = 0, entities: list[str] | None = None) -> DataFrame:
        """The visible rows after a sequence number."""
        seen = self.seen()
        wanted = sorted(e for e in seen.bases if e and (entities is None or e in entities))
        if not wanted:
            return self.spark.createDataFrame([], LOG)
        first = self.table("commits").where(F.col("high") > since).agg(F.min("commit")).first()[0] if since else 1
        from_on = {e: max(seen.bases[e], 0) for e in wanted}
        shown = F.lit(False)
        for base in sorted(set(from_on.values())):
            shown |= F.col("entity").isin(*(e for e in wanted if from_on[e] == base)) & (F.col("commit") >= base)
        low = F.col("commit") >= (first if first is not None else seen.last + 1)
        return self.table("log").where(F.col("entity").isin(*wanted) & (F.col("commit") <= seen.last) & low & shown & (F.col("seq") > since)).drop("commit")

    def owners(self) -> DataFrame:
        """Each playlist's owner: the first claim counts."""
        claims = self.table("owners").where(F.col("commit") <= self.seen().last)
        return claims.groupBy("playlist_id").agg(F.min_by("owner_user_id", "commit").alias("owner_user_id"), F.min_by("created_at", "commit").alias("created_at"))

    def summaries(self) -> DataFrame:
        """user_id, n, play_events, head per user, added up from what each commit brought or took away: no row of the log is read."""
        parts = self.table("summaries").where(F.col("commit") <= self.seen().last)
        events = F.sum(F.when(F.col("entity") == "play_events", F.col("n")).otherwise(0))
        return parts.groupBy("user_id").agg(F.sum("n").alias("n"), events.alias("play_events"), F.max("head").alias("head"))

    def applied(self, source: str, batch: int) -> bool:
        return not self.table("commits").where((F.col("source") == source) & (F.col("source_batch") == batch)).isEmpty()

    def _clear(self, commit: int, below: bool = False, entity: str = "*") -> None:
        """Deletes folders of a commit that was never recorded, or of those below one that replaced them."""
        for place in (f"log/entity={entity}/commit=*", *(() if below else ("owners/commit=*", "summaries/commit=*"))):
            store, pattern = file_system(self.spark, f"{self.path}/{place}")
            for found in store.globStatus(pattern) or ():
                number = int(found.getPath().getName().split("=")[1])
                if number < commit if below else number == commit:
                    store.delete(found.getPath(), True)

    def _write(self, name: str, rows: DataFrame, *by: str) -> None:
        rows.write.mode("append").partitionBy(*by).parquet(f"{self.path}/{name}")

    def _put(self, rows: DataFrame, commit: int, told: list) -> None:
        files = 1 + sum(r.n for r in told) // FILE_ROWS
        laid = rows.withColumn("commit", F.lit(commit).cast("long"))
        laid = laid.repartitionByRange(files, "entity", "user_id") if files > 1 else laid.coalesce(1)
        self._write("log", laid.sortWithinPartitions("entity", "user_id", "seq"), "entity", "commit")

    @staticmethod
    def _told(rows: DataFrame) -> list:
        """n, low and high of each entity: one row per entity."""
        return rows.groupBy("entity").agg(F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high")).collect()

    def _record(self, told: list, commit: int, base: bool, source: str | None, batch: int | None, entity: str = "") -> None:
        """The last step of a commit, one file; an entity without rows is recorded too where ``entity`` names it."""
        rows = [(commit, r.entity, base, r.n, r.low, r.high, source, batch) for r in told]
        if entity not in {r.entity for r in told}:
            rows.append((commit, entity, base, 0, None, None, source, batch))
        self.spark.createDataFrame(rows, SCHEMAS["commits"]).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def append(self, rows: DataFrame, claims: DataFrame | None = None, source: str | None = None, batch: int | None = None) -> int:
        """Adds numbered ``rows``, all above the head, and ``claims`` (new owners) as one commit; its number. A batch of a source that was added before is left out."""
        seen = self.seen()
        if source is not None and self.applied(source, batch):
            return seen.last
        commit = seen.last + 1
        self._clear(commit)
        rows = kept(fitted(rows))
        told = self._told(rows)
        self._put(rows, commit, told)
        number = F.lit(commit).cast("long").alias("commit")
        if claims is not None:
            self._write("owners", claims.select("playlist_id", F.col("owner_user_id").cast("long").alias("owner_user_id"), "created_at", number), "commit")
        self._write("summaries", rows.groupBy("user_id", "entity").agg(F.count("*").alias("n"), F.max("seq").alias("head")).withColumn("commit", number), "commit")
        self._record(told, commit, False, source, batch)
        return commit

    def rewrite(self, entity: str, survivors: DataFrame) -> int:
        """Puts ``survivors`` in place of all rows of an entity, as one commit, and then deletes the entity's older files. Other entities' files stay untouched."""
        commit = self.seen().last + 1
        self._clear(commit)
        rows = kept(fitted(survivors.where(F.col("entity") == entity)))
        before = self.read(entities=[entity]).groupBy("user_id").agg(F.count("*").alias("was"))
        now = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.max("seq").alias("head"))
        change = kept(before.join(now, "user_id", "full").select("user_id", F.lit(entity).alias("entity"), (F.coalesce("n", F.lit(0)) - F.coalesce("was", F.lit(0))).alias("n"), "head"))
        told = self._told(rows)
        self._put(rows, commit, told)
        self._write("summaries", change.withColumn("commit", F.lit(commit).cast("long")), "commit")
        self._record(told, commit, True, None, None, entity)
        self._clear(commit, below=True, entity=entity)
        return commit
