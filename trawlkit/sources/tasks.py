"""Tasks over a site list: submission, status, results, as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ("pending", "in_progress", "completed", "failed", "aborted")
TASKS = "task_id long, submission_id long, task_name string, scraper_name string, status string, result_count long, started_at timestamp, finished_at timestamp, updated_at timestamp, is_all_task boolean"


def site_list(submissions: DataFrame, websites: str = "websites") -> DataFrame:
    """(submission_id, place, query) of ``submissions`` with an array of sites: trimmed, blanks dropped, repeats kept."""
    each = submissions.select("submission_id", F.posexplode(F.transform(websites, lambda w: F.trim(w))).alias("place", "query"))
    return each.filter(F.coalesce(F.length("query"), F.lit(0)) > 0)


def split_tasks(submissions: DataFrame) -> DataFrame:
    """One task per site, and one for all sites of the submission."""
    single = site_list(submissions).select("submission_id", "place", F.col("query").alias("task_name"), F.lit(False).alias("is_all_task"))
    whole = submissions.select("submission_id", F.lit(-1).alias("place"), F.lit("All Task").alias("task_name"), F.lit(True).alias("is_all_task"))
    return whole.unionByName(single).withColumn("status", F.lit("pending"))


def with_status(tasks: DataFrame, ids: list[int], status: str) -> DataFrame:
    """Tasks with ``status`` for those of ``ids``; only unfinished ones can be aborted."""
    if status not in STATUSES:
        raise ValueError(f"no such status: {status}")
    hit = F.col("task_id").isin(*ids)
    if status == "aborted":
        hit = hit & F.col("status").isin("pending", "in_progress")
    return tasks.withColumn("status", F.when(hit, status).otherwise(F.col("status")))


def without(tasks: DataFrame, ids: list[int]) -> DataFrame:
    return tasks.filter(~F.col("task_id").isin(*ids))


def changed_since(tasks: DataFrame, known: DataFrame) -> DataFrame:
    """Tasks whose time of change or status differs from what a client has seen (task_id, updated_at, status)."""
    seen = known.select("task_id", F.col("updated_at").alias("_at"), F.col("status").alias("_status"))
    met = tasks.join(seen, "task_id", "left")
    return met.filter(~(F.col("updated_at").eqNullSafe(F.col("_at")) & F.col("status").eqNullSafe(F.col("_status")))).drop("_at", "_status")


def duration(started: Column, finished: Column, now: Column) -> Column:
    """Days, hours, minutes and seconds since the start, parts that are zero left out."""
    s = F.unix_timestamp(F.coalesce(finished, now)) - F.unix_timestamp(started)
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    text = F.concat_ws(" ", part(F.floor(s / 86400), "d"), part(F.floor(s / 3600) % 24, "h"), part(F.floor(s / 60) % 60, "m"), part(s % 60, "s"))
    return F.when(started.isNotNull(), F.when(text == "", "0s").otherwise(text))


class Client:
    """The task interface over frames kept as Parquet under ``folder``: create, list, results, abort, delete."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def tasks(self) -> DataFrame:
        return self.spark.read.schema(TASKS).parquet(self._path("tasks/*"))

    def create(self, submission_id: int, websites: list[str]) -> DataFrame:
        given = self.spark.createDataFrame([(submission_id, websites)], "submission_id long, websites array<string>")
        rows = split_tasks(given).withColumns({"task_id": F.col("submission_id") * 1_000_000 + F.col("place") + 1, "scraper_name": F.lit("scrape_contacts"), "result_count": F.lit(0).cast("long"), "started_at": F.lit(None).cast("timestamp"), "finished_at": F.lit(None).cast("timestamp"), "updated_at": F.current_timestamp()})
        rows.select(*(c.split()[0] for c in TASKS.split(", "))).write.mode("overwrite").parquet(self._path(f"tasks/{submission_id}"))
        return self.spark.read.parquet(self._path(f"tasks/{submission_id}"))

    def save_results(self, submission_id: int, contacts: DataFrame) -> None:
        contacts.write.mode("overwrite").parquet(self._path(f"results/{submission_id}"))

    def results(self, submission_id: int, task_name: str | None = None) -> DataFrame:
        """A submission's records; those of one site where a task is named."""
        df = self.spark.read.parquet(self._path(f"results/{submission_id}"))
        return df if task_name is None else df.filter(F.col("domain") == task_name)

    def _rewrite(self, submission_id: int, change) -> None:
        path = self._path(f"tasks/{submission_id}")
        rows = change(self.spark.read.parquet(path)).collect()  # a submission's task list, not its data
        self.spark.createDataFrame(rows, TASKS).write.mode("overwrite").parquet(path)

    def abort(self, submission_id: int, ids: list[int]) -> None:
        self._rewrite(submission_id, lambda t: with_status(t, ids, "aborted"))

    def delete(self, submission_id: int, ids: list[int]) -> None:
        self._rewrite(submission_id, lambda t: without(t, ids))
