"""Versions of learned rules as an append-only log: every change of status is a row, nothing is overwritten.

A log row is (rule_id, version, previous_status, new_status, accuracy_before, accuracy_after, reason). The state of a rule is its row of
greatest version, found by an aggregate that combines before the exchange; a change joins the rules it names to that state and adds rows.
Appending to a log is safe to repeat as long as the rows of a change are written as one batch.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

COLUMNS = ["rule_id", "version", "previous_status", "new_status", "accuracy_before", "accuracy_after", "reason"]


def accuracy():
    return F.round(F.coalesce(F.try_divide("success_count", "usage_count"), F.lit(0.0)), 4)


def opened(rules):
    """First version of every rule, as it was created."""
    none = F.lit(None).cast("string").alias("previous_status")
    return rules.select("rule_id", F.lit(1).cast("bigint").alias("version"), none, F.col("status").alias("new_status"), F.lit(0.0).alias("accuracy_before"), accuracy().alias("accuracy_after"), F.lit("Created").alias("reason"))


def current(log):
    """Latest version of every rule: rule_id, version, status, accuracy."""
    last = F.max_by(F.struct("version", F.col("new_status").alias("status"), F.col("accuracy_after").alias("accuracy")), "version")
    return log.groupBy("rule_id").agg(last.alias("r")).select("rule_id", "r.*")


def changed(log, changes):
    """``log`` with a row per change (rule_id, new_status, accuracy_after or null to keep it, reason) of a known rule; same status, no row."""
    now = current(log)
    rows = changes.join(now, "rule_id").filter("new_status <> status").select(
        "rule_id", (F.col("version") + 1).alias("version"), F.col("status").alias("previous_status"), "new_status", F.col("accuracy").alias("accuracy_before"),
        F.coalesce("accuracy_after", "accuracy").alias("accuracy_after"), "reason")
    return log.unionByName(rows)


def rolled_back(log, rule_ids):
    """Rules named in ``rule_ids`` go back to pending, their accuracy to be shown anew."""
    return changed(log, rule_ids.select("rule_id", F.lit("pending").alias("new_status"), F.lit(0.0).alias("accuracy_after"), F.lit("Manual rollback to PENDING").alias("reason")))


def guarded(log, evaluations):
    """Pending rules with their evaluation (rule_id, precision_before, precision_after): a drop rejects, anything else approves."""
    share = lambda c: F.format_string("%.2f%%", F.col(c) * 100)
    drop = F.col("precision_after") < F.col("precision_before")
    reason = F.when(drop, F.concat(F.lit("Regression detected: "), share("precision_before"), F.lit(" -> "), share("precision_after"))).otherwise("No regression detected. Approved by RegressionGuard.")
    waiting = evaluations.join(current(log).filter("status = 'pending'").select("rule_id"), "rule_id", "left_semi")
    return changed(log, waiting.select("rule_id", F.when(drop, "rejected").otherwise("approved").alias("new_status"), F.col("precision_after").alias("accuracy_after"), reason.alias("reason")))


def rejected(log):
    """Rules whose latest version is a rejection, with what it was rejected for."""
    return log.join(current(log).filter("status = 'rejected'").select("rule_id", "version"), ["rule_id", "version"]).select(*COLUMNS)


def history(log):
    """Every change of every rule, the newest first (orden 1)."""
    return log.withColumn("orden", F.row_number().over(W.partitionBy("rule_id").orderBy(F.col("version").desc())))
