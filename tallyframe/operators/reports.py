"""Listings over a reconciliation: settlements, batches, censuses, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def settlement_listing(totals: DataFrame, matches: DataFrame) -> DataFrame:
    """Every settlement with its money and, if matched, its line and tier."""
    own = matches.select("settlement_id", "line_id", "tier")
    return totals.join(own, "settlement_id", "left").select("settlement_id", "gross", "fees", "tax", "refunds", "holds", "net", "payment_legs", F.col("line_id").isNotNull().alias("matched"), "line_id", "tier")


def batch_netting(order_sets: DataFrame, matches: DataFrame, orders: DataFrame) -> DataFrame:
    """(settlement_id, line_id, order_id, gross_amount) of every matched settlement's orders."""
    each = matches.select("settlement_id", "line_id").join(order_sets, "settlement_id").select("settlement_id", "line_id", F.explode(F.split("order_ids", ",")).alias("order_id"))
    return each.join(orders.select("order_id", "gross_amount"), "order_id").select("settlement_id", "line_id", "order_id", "gross_amount")


def reason_census(exceptions: DataFrame) -> DataFrame:
    return exceptions.groupBy("subject_type", "reason_code").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """One page of a listing in a stable order; order must be unique."""
    return df.orderBy(*order).offset(offset).limit(limit)


def previous_runs(runs: DataFrame) -> DataFrame:
    """Each completed run with the run before it on the same dataset; a null dataset is a dataset."""
    along = Window.partitionBy("org_id", "dataset").orderBy("created_at", "run_id")
    return runs.where("status = 'completed'").withColumn("previous_run_id", F.lag("run_id").over(along))


def latest(df: DataFrame, key: list[str]) -> DataFrame:
    """Of each key the row of the newest run."""
    newest = Window.partitionBy(*key).orderBy(F.desc("created_at"), F.desc("run_id"))
    return df.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")


def running_balance(lines: DataFrame, opening: int = 0) -> DataFrame:
    """The balance after each line of an account, in order of date and id."""
    along = Window.partitionBy("account").orderBy("txn_date", "line_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))
    return lines.withColumn("running", F.lit(opening).cast("long") + F.sum(moved).over(along))


def balance_chain(lines: DataFrame) -> DataFrame:
    """Lines whose claimed balance isn't the previous claimed balance and what moved; the first line of an account is taken as it is."""
    along = Window.partitionBy("account").orderBy("txn_date", "line_id")
    moved = F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))
    return lines.withColumn("before", F.lag("balance").over(along)).withColumn("gap", F.col("balance") - F.col("before") - moved).where("gap <> 0")


def subjects(orders: DataFrame, psp: DataFrame, bank: DataFrame) -> DataFrame:
    """(subject_type, subject_id, bank_line, psp_txn, order): every record that an exception or an audit entry can be about, as a struct in the column of its type."""
    kinds = (("bank_line", "line_id", bank), ("psp_txn", "txn_id", psp), ("order", "order_id", orders))
    shapes = {kind: df.schema.simpleString() for kind, _, df in kinds}
    every = None
    for kind, key, df in kinds:
        own = df.select(F.lit(kind).alias("subject_type"), F.col(key).alias("subject_id"), *(F.struct("*").alias(k) if k == kind else F.lit(None).cast(shapes[k]).alias(k) for k, *_ in kinds))
        every = own if every is None else every.unionByName(own)
    return every


def with_subjects(exceptions: DataFrame, known: DataFrame) -> DataFrame:
    """exceptions with their records, a struct for each type; an exception about a record that isn't there is an error."""
    joined = exceptions.join(known.withColumn("_known", F.lit(True)), ["subject_type", "subject_id"], "left")
    sure = F.when(F.col("_known"), F.col("subject_id")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no such"), "subject_type", "subject_id")).cast("string"))
    return joined.withColumn("subject_id", sure).drop("_known")


def exceptions_page(exceptions: DataFrame, offset: int, limit: int, reason: str | None = None, subject_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, totals) of a page of exceptions, of one reason or one type of subject if named: rows in order of reason, type and id; totals (n, amount) are of all that the filter keeps."""
    kept = exceptions if reason is None else exceptions.where(F.col("reason_code") == reason)
    kept = kept if subject_type is None else kept.where(F.col("subject_type") == subject_type)
    return page(kept, ["reason_code", "subject_type", "subject_id"], offset, limit), kept.agg(F.count("*").alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).cast("long").alias("amount"))


def trails(audit: DataFrame) -> DataFrame:
    """(subject_id, steps, last_stage, last_rule): how long each subject's trail is, and what it ends with."""
    last = F.max(F.struct("phase", "stage", "rule")).alias("last")
    return audit.groupBy("subject_id").agg(F.count("*").alias("steps"), last).select("subject_id", "steps", F.col("last.stage").alias("last_stage"), F.col("last.rule").alias("last_rule"))


def run_history(runs: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Each tenant's runs, numbered from the newest (place 1), with the time since the run before on the same dataset in seconds; summaries (run_id, ...) are added where there are any."""
    newest = Window.partitionBy("org_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    along = Window.partitionBy("org_id", "dataset").orderBy("created_at", "run_id")
    out = runs.withColumn("place", F.row_number().over(newest)).withColumn("seconds_since", F.timestamp_diff("SECOND", F.lag("created_at").over(along), F.col("created_at")))
    return out if summaries is None else out.join(summaries, "run_id", "left")


def widest(undecided: DataFrame) -> DataFrame:
    """(line_id, tier, why, width): of each line that several tiers left undecided the widest ambiguity, the earliest tier's among equal ones."""
    rank = Window.partitionBy("line_id").orderBy(F.desc("width"), "tier")
    return undecided.withColumn("_r", F.row_number().over(rank)).where("_r = 1").select("line_id", "tier", "why", "width")
