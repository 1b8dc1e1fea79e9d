"""Balance continuity: each balance must follow from the last one before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from .cluster import same

ORDER = ["page_num", "row_id"]


def opening(order: list[str] = ORDER) -> Column:
    """The balance before a document's first row that has one."""
    line = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return before(F.first(F.when(F.col("balance").isNotNull(), F.struct("balance", "debit", "credit")), True).over(line))


def before(row: Column) -> Column:
    """The balance before a row that has one."""
    debit, credit = row["debit"], row["credit"]
    return F.when(debit.isNotNull() & (debit != 0), row["balance"] + debit).when(credit.isNotNull() & (credit != 0), row["balance"] - credit).otherwise(row["balance"])


def carried(order: list[str] = ORDER) -> Column:
    """The last balance of the rows before."""
    return F.last("balance", True).over(Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def expectations(txns: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """txns with n_balances, prev_balance and expected."""
    out = txns.withColumn("n_balances", F.count("balance").over(Window.partitionBy("doc_id"))).withColumn("prev_balance", F.coalesce(carried(order), opening(order)))
    return _moved(out)


def paged_expectations(txns: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """What expectations() gives, without a window over a document's rows: each page (the first of order) is a task's
    window, and a row per page with its last balance, its first row that has one and its number of balances is scanned
    over the document. Pages are added up before they are shuffled, so one hot document is spread over all tasks."""
    page, at = order[0], F.when(F.col("balance").isNotNull(), F.struct(*order[1:]))
    rows = txns.repartition("doc_id", page)
    pages = txns.groupBy("doc_id", page).agg(F.count("balance").alias("_n"), F.max_by("balance", at).alias("_last"), F.min_by(F.struct("balance", "debit", "credit"), at).alias("_first"))
    document = Window.partitionBy("doc_id")
    line = document.orderBy(page)
    carried_in = F.last("_last", True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("_first", True).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    pages = pages.select("doc_id", page, F.sum("_n").over(document).alias("n_balances"), F.coalesce(carried_in, before(first)).alias("_before"))
    own = F.last("balance", True).over(Window.partitionBy("doc_id", page).orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1))
    both = same(rows.withColumn("_own", own), pages, ["doc_id", page])
    return _moved(both.withColumn("prev_balance", F.coalesce("_own", "_before")).drop("_own", "_before"))


def _moved(out: DataFrame) -> DataFrame:
    moved = F.col("debit").isNotNull() | F.col("credit").isNotNull()
    return out.withColumn("expected", F.when(moved, F.col("prev_balance") + F.coalesce("credit", F.lit(0.0)) - F.coalesce("debit", F.lit(0.0))))


def validate(txns: DataFrame, settings: Settings, order: list[str] = ORDER, paged: bool = False) -> DataFrame:
    """txns with validation_status and confidence_score set by their balances; a document with fewer than two balances
    stays in review. With settings.repair, a failed row whose debit and credit fit when swapped is swapped and called
    "repaired", its confidence unchanged. paged: for documents of very many pages (see paged_expectations)."""
    out = (paged_expectations if paged else expectations)(txns, order)
    allowed = F.lit(settings.tolerance) * F.greatest(F.abs("balance"), F.lit(1.0))
    open_ = (F.col("n_balances") < 2) | F.col("balance").isNull() | F.col("expected").isNull()
    good = F.abs(F.col("balance") - F.col("expected")) <= allowed
    status = F.when(open_, "needs_review").when(good, "validated")
    score = F.when(open_, F.col("confidence_score")).when(good, F.least(F.lit(1.0), F.col("confidence_score") + settings.raise_by))
    if settings.repair:
        other = F.col("prev_balance") + F.coalesce("debit", F.lit(0.0)) - F.coalesce("credit", F.lit(0.0))
        fits = F.abs(F.col("balance") - other) <= allowed
        status, score = status.when(fits, "repaired"), score.when(fits, F.col("confidence_score"))
        out = out.withColumn("_s", status.otherwise("failed"))
        swapped = F.col("_s") == "repaired"
        out = out.withColumn("validation_status", F.col("_s")).withColumn("confidence_score", score.otherwise(F.greatest(F.lit(0.0), F.col("confidence_score") - settings.lower_by)))
        out = out.withColumn("_d", F.when(swapped, F.col("credit")).otherwise(F.col("debit"))).withColumn("credit", F.when(swapped, F.col("debit")).otherwise(F.col("credit"))).withColumn("debit", F.col("_d"))
        return out.select(*txns.columns)
    out = out.withColumn("validation_status", status.otherwise("failed")).withColumn("_c", score.otherwise(F.greatest(F.lit(0.0), F.col("confidence_score") - settings.lower_by)))
    return out.withColumn("confidence_score", F.col("_c")).select(*txns.columns)


def status_summary(txns: DataFrame) -> DataFrame:
    return txns.groupBy("validation_status").agg(F.count(F.lit(1)).alias("n"))
