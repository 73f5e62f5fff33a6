"""Records, assignments, users: upserts, histories, the assignment state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import drop, new_path, shuffle_partitions, written


def latest(events: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row per key in the given order (latest wins)."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("turn_", F.row_number().over(w)).where("turn_ = 1").drop("turn_")


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes``, and those of ``current`` whose key has none."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def first_occurrence(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key that is not empty."""
    return latest(df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != ""), key, F.asc(order))


def resolved_status(state: Column, status: Column, default: str = "COMPLIANT") -> Column:
    return F.coalesce(F.nullif(state, F.lit("")), F.nullif(status, F.lit("")), F.lit(default))


def ensure_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Adds the columns that are missing."""
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def history(records: DataFrame, owner: str, at: str, limit: int = 50, tie: str | None = None) -> DataFrame:
    """The last ``limit`` records of each owner."""
    w = Window.partitionBy(owner).orderBy(F.desc(at), F.desc(tie or at))
    return records.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def visible_to(rows: DataFrame, users: DataFrame, by: str, roles: tuple) -> DataFrame:
    """Rows whose user is active and has one of the roles."""
    return rows.join(users.where(F.col("role").isin(list(roles)) & F.col("is_active")), rows[by] == users["user_id"], "left_semi")


def transition(actor_is_assignee: Column, actor_is_assigner: Column, old: Column, new: Column) -> Column:
    """Status after a request to change it; null if it is refused: an assignee may only resolve, the assigner only close."""
    allowed = (actor_is_assignee & (new == "RESOLVED")) | (actor_is_assigner & (new == "CLOSED"))
    return F.when((old != "CLOSED") & allowed, new)


def transitioned(assignments: DataFrame, is_assignee: Column, is_assigner: Column, new: Column, at: Column) -> DataFrame:
    """``assignments`` (with status) after requests to change them: status, resolved_at (when it was resolved or closed; null if refused) and refused."""
    after = transition(is_assignee, is_assigner, F.col("status"), new)
    df = assignments.withColumn("after_", after)
    return df.withColumns({"resolved_at": F.when(F.col("after_").isin("RESOLVED", "CLOSED"), at), "refused": F.col("after_").isNull(), "status": F.coalesce("after_", "status")}).drop("after_")


def with_record(assignments: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """``assignments`` with ``record``: the record that each is about, null if there is none."""
    one = records.select(F.col(key), F.struct(*[c for c in records.columns if c != key]).alias("record"))
    return assignments.join(one, key, "left")


def user_by_email(asked: DataFrame, users: DataFrame) -> DataFrame:
    """``asked`` (email) with the active user of that address, without regard to case and blanks around it; addresses of nobody and of inactive users are dropped."""
    known = users.where("is_active").withColumn("email_", F.lower(F.trim("email"))).drop("email")
    return asked.withColumn("email_", F.lower(F.trim("email"))).join(known, "email_").drop("email_")


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key has not been done: resuming after a break."""
    return work.join(done.where("success"), key, "left_anti")


def status_counts(records: DataFrame, status: str, known: tuple) -> DataFrame:
    """(status, n) with ALL and zero for what does not occur."""
    one = records.agg(F.count(F.lit(1)).alias("ALL"), *[F.count_if(F.col(status) == s).alias(s) for s in known])
    return one.unpivot([], ["ALL", *known], "status", "n")


def fingerprint(*fields: tuple[str, Column]) -> Column:
    """SHA-256 of a JSON object with sorted keys; values are strings."""
    parts = [F.concat(F.lit(f'"{k}":"'), F.replace(F.replace(v.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for k, v in sorted(fields, key=lambda f: f[0])]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def merged(old: Column, new: Column) -> Column:
    """Two maps as one; the new one's entries win."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


class SortedRows:
    """Rows in a fixed order, written in ranges, of which a search by place reads those it needs. Rows that tie stand by a hash of the whole row, which also parts many with one key."""

    def __init__(self, df: DataFrame, order: str):
        spark = df.sparkSession
        self.columns, self.order = df.columns, [order, "tie_"]
        rows = written(df.withColumn("tie_", F.xxhash64(*df.columns)), "unsorted")
        self.path = new_path(spark, "sorted")
        dealt = rows.repartitionByRange(shuffle_partitions(spark), *self.order).sortWithinPartitions(*self.order)
        dealt.withColumn("part_", F.spark_partition_id()).write.partitionBy("part_").parquet(self.path)
        drop(rows)
        # an empty table writes no folder of a part
        self.rows = spark.read.schema(dealt.withColumn("part_", F.lit(0)).schema).parquet(self.path)
        at, self.starts = 0, []  # as many as there are parts
        for r in self.rows.groupBy("part_").agg(F.count(F.lit(1)).alias("n")).orderBy("part_").collect():
            self.starts.append((r.part_, at, r.n))
            at += r.n

    def range(self, start: int, end: int) -> DataFrame:
        """Rows start..end-1: only the parts that hold some of them are read, and each counts its own."""
        met = [(p, at) for p, at, n in self.starts if at < end and start < at + n]
        rows = self.rows.where(F.col("part_").isin([p for p, _ in met]) if met else F.lit(False))
        shift = F.coalesce(*[F.when(F.col("part_") == p, F.lit(at)) for p, at in met], F.lit(0))
        place = shift + F.row_number().over(Window.partitionBy("part_").orderBy(*self.order)) - 1
        return rows.withColumn("place_", place).where(F.col("place_").between(start, end - 1)).orderBy("place_").select(*self.columns)


def row_range(df: DataFrame, order: str, start: int, end: int) -> DataFrame:
    """Rows start..end-1 in the given order."""
    return SortedRows(df, order).range(start, end)


def new_assignments(requests: DataFrame, at: Column) -> DataFrame:
    """Requests to assign a record as open assignments with an id of their content, so that a repeated request is the same assignment."""
    keyed = F.left(F.sha2(F.concat_ws("|", "record_id", "assigned_by", "assigned_to"), 256), F.lit(16))
    kind = F.coalesce(F.col("action_type"), F.lit("REQUEST_EVIDENCE")) if "action_type" in requests.columns else F.lit("REQUEST_EVIDENCE")
    return requests.withColumns({"assignment_id": keyed, "action_type": kind, "status": F.lit("OPEN"), "created_at": at}).dropDuplicates(["assignment_id"])


def expired(at: Column, now: Column, minutes: int) -> Column:
    """``minutes`` have passed since ``at``."""
    return at + F.make_interval(mins=F.lit(minutes)) < now
