"""Provision summaries, due dates, row checks, amount spikes and contract checks.

Planning columns: rid, expense_category, vendor_name, amount, frequency,
last_provision_date, expected_date, confidence_score.
History columns: rid, expense_ledger, vendor, period, amount.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from closebooks import fixed_values as V
from closebooks.functions.exprs import choose, count_rows, month_text, total
from closebooks.operators import cells as ce
from closebooks.operators.issues import Check, issue_rows

NO_DAY = 2**31 - 1  # place of rows without a period: after all others
SLOTS = 65_536  # that the groups of a history are counted by
LARGE_SLOT = 500_000  # rows of one slot that a task walks through, at most
_SERIES = ["expense_ledger", "vendor"]  # whose amounts follow each other


def _frequency_counts() -> list[Column]:
    return [
        F.count_if(F.col("frequency") == f).alias(f.lower()) for f in V.FREQUENCY_MONTHS
    ]


def provision_category_summary(p: DataFrame) -> DataFrame:
    """The average is over the known amounts, the count over all rows."""
    mean = F.try_divide(F.sum("amount").cast("double"), F.count("amount").cast("double"))
    return (
        p.filter(F.col("expense_category").isNotNull())
        .groupBy("expense_category")
        .agg(
            count_rows().alias("total_provisions"), total("amount").alias("total_amount"),
            mean.alias("average_amount"), *_frequency_counts(),
        )
    )


def provision_vendor_categories(p: DataFrame) -> DataFrame:
    """The categories of each vendor, one row each: never a list in one cell."""
    return (
        p.filter(F.col("vendor_name").isNotNull())
        .groupBy("vendor_name", "expense_category")
        .agg(
            count_rows().alias("provisions"), total("amount").alias("amount"),
            *_frequency_counts(),
        )
    )


def provision_vendor_summary(p: DataFrame) -> DataFrame:
    """Built on the category rows, so a hot vendor is spread over its categories."""
    names = [f.lower() for f in V.FREQUENCY_MONTHS]
    return (
        provision_vendor_categories(p)
        .groupBy("vendor_name")
        .agg(
            F.sum("provisions").alias("total_provisions"),
            F.sum("amount").alias("total_amount"),
            F.count("expense_category").alias("category_count"),
            *[F.sum(n).alias(n) for n in names],
        )
    )


def _fixed_rows(df: DataFrame, label: str, conditions: dict[str, Column]) -> DataFrame:
    """One row per label with count and total_amount, zero rows included.

    All labels are measured in one aggregate, then laid out as rows.
    """
    return _laid_out(df.agg(*_label_measures(label, conditions)), label, list(conditions))


def _label_measures(label: str, conditions: dict[str, Column]) -> list[Column]:
    measures = []
    for name, on in conditions.items():
        measures += [
            F.count_if(on).alias(f"{label}_{name}_count"),
            total(F.when(on, F.col("amount"))).alias(f"{label}_{name}_amount"),
        ]
    return measures


def _laid_out(one: DataFrame, label: str, names: list[str]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(name).alias(label), F.col(f"{label}_{name}_count").alias("count"),
            F.col(f"{label}_{name}_amount").alias("total_amount"),
        )
        for name in names
    ]
    return one.select(F.inline(F.array(*rows)))


def _frequencies() -> dict[str, Column]:
    return {f.lower(): F.col("frequency") == f for f in V.FREQUENCY_MONTHS}


def _confidences() -> dict[str, Column]:
    score = F.col("confidence_score")
    high = F.coalesce(score > F.lit(V.CONFIDENCE_HIGH_ABOVE), F.lit(False))
    from_medium = F.coalesce(score >= F.lit(V.CONFIDENCE_MEDIUM_FROM), F.lit(False))
    return {"high": high, "medium": ~high & from_medium, "low": ~high & ~from_medium}


def provision_frequency_summary(p: DataFrame) -> DataFrame:
    return _fixed_rows(p, "frequency", _frequencies())


def provision_confidence(p: DataFrame) -> DataFrame:
    """high, medium or low confidence; a missing score is low."""
    return _fixed_rows(p, "bucket", _confidences())


def provision_cells(p: DataFrame) -> DataFrame:
    """Sums per category and vendor, from which every summary follows."""
    keys = {"category": F.col("expense_category"), "vendor": F.col("vendor_name")}
    return ce.cells_of(p, keys, [
        count_rows().alias("total_provisions"), total("amount").alias("total_amount"),
        F.count("amount").alias("known"), *_frequency_counts(),
        *_label_measures("frequency", _frequencies()),
        *_label_measures("bucket", _confidences()),
    ])


def summaries_of_cells(cells: DataFrame) -> dict[str, DataFrame]:
    """The summaries above by name, and the rows that each leaves out for want of its key."""
    names = [f.lower() for f in V.FREQUENCY_MONTHS]
    every = ce.overall(cells, [c for c in cells.columns if c not in ("category", "vendor")])
    by_category = ce.section(
        cells, "category", ["total_provisions", "total_amount", "known", *names],
        "expense_category")
    named = cells.filter(F.col("vendor").isNotNull())
    return {
        "expense_category_summary": by_category.select(
            "expense_category", "total_provisions", "total_amount",
            F.try_divide(F.col("total_amount").cast("double"), F.col("known").cast("double"))
            .alias("average_amount"), *names),
        "vendor_summary": named.groupBy(F.col("vendor").alias("vendor_name")).agg(
            F.sum("total_provisions").alias("total_provisions"),
            F.sum("total_amount").alias("total_amount"),
            F.count("category").alias("category_count"), *[F.sum(n).alias(n) for n in names]),
        "vendor_categories": named.select(
            F.col("vendor").alias("vendor_name"), F.col("category").alias("expense_category"),
            F.col("total_provisions").alias("provisions"), F.col("total_amount").alias("amount"),
            *names),
        "frequency_summary": _laid_out(every, "frequency", names),
        "confidence_analysis": _laid_out(every, "bucket", list(_confidences())),
        "excluded_rows": ce.left_out(
            cells, ["category", "vendor"], "total_provisions", "total_amount"),
    }


def provision_excluded_rows(p: DataFrame) -> DataFrame:
    """section, row_count, amount: provisions without a category, and without a vendor."""
    return summaries_of_cells(provision_cells(p))["excluded_rows"]


def provision_upcoming(p: DataFrame, as_of: date, days: int = V.UPCOMING_DAYS) -> DataFrame:
    """Expected up to `days` after `as_of`; there is no lower bound."""
    return p.filter(F.col("expected_date") <= F.date_add(F.lit(as_of), days)).select(
        "expense_category", "vendor_name", "amount",
        F.date_format("expected_date", "yyyy-MM-dd").alias("expected_date"),
        "confidence_score",
    )


def next_due(last: Column, frequency: Column) -> Column:
    """Last date plus one period; null for an unknown frequency."""
    return F.add_months(last, choose(frequency, V.FREQUENCY_MONTHS))


def provision_overdue(p: DataFrame, as_of: date) -> DataFrame:
    today = F.lit(as_of)
    due = next_due(F.col("last_provision_date"), F.col("frequency"))
    return (
        p.select("expense_category", "vendor_name", "last_provision_date",
                 due.alias("expected_date"))
        .filter(F.col("expected_date") < today)
        .withColumn("days_overdue", F.datediff(today, F.col("expected_date")))
    )


def provision_issues(p: DataFrame) -> DataFrame:
    score = F.col("confidence_score")
    checks = [
        Check(
            V.ISSUE_DATES,
            F.col("last_provision_date").isNull() | F.col("expected_date").isNull(),
        ),
        Check(
            V.ISSUE_FREQUENCY,
            ~F.coalesce(F.col("frequency").isin(*V.FREQUENCY_MONTHS), F.lit(False)),
            value=F.col("frequency"),
        ),
        Check(
            V.ISSUE_AMOUNT, F.coalesce(F.col("amount") <= 0, F.lit(False)),
            value=F.col("amount"),
        ),
        Check(
            V.ISSUE_CONFIDENCE, ~F.coalesce(score.between(0, 1), F.lit(False)), value=score,
        ),
    ]
    keys = [F.col("rid").alias("key"), "expense_category", "vendor_name"]
    return issue_rows(p, keys, checks).drop("expected", "actual")


def provision_spikes(
    history: DataFrame, percent: float = V.SPIKE_PERCENT, large: int = LARGE_SLOT
) -> DataFrame:
    """Amounts more than `percent` above the preceding one of the same ledger and vendor.

    Rows follow by period; within a period by the digest of their key, an arbitrary but
    repeatable order. The change is taken against the last known amount, while
    previous_amount is the amount (known or not) of the last row of an earlier period.
    A rise from zero is a spike without a percentage. NaN is an unknown amount. A row
    without a key comes first in its period and is not reported itself.

    A job first counts the rows of the groups' hash slots. Groups of a slot with more than
    `large` rows are cut, so that none is one task's work; the others are dealt and sorted
    once. Both give the same answer.
    """
    named = history.filter(F.col("expense_ledger").isNotNull() & F.col("vendor").isNotNull())
    slot = F.pmod(F.xxhash64(*_SERIES), F.lit(SLOTS))
    full = [r["slot"] for r in named.groupBy(slot.alias("slot")).agg(count_rows().alias("n"))
            .filter(F.col("n") > large).collect()]
    if not full:
        stepped = _stepped_whole(_placed(named))
    else:
        cut = slot.isin(full)
        stepped = _stepped_whole(_placed(named.filter(~cut))).unionByName(
            _stepped_in_buckets(_placed(named.filter(cut))))
    period = F.when(F.col("day") != NO_DAY, F.date_from_unix_date("day"))
    amount, known = F.col("amount"), F.col("known")
    change = F.when(known != 0, (amount / known - 1) * 100)
    spike = ((known == 0) & (amount > 0)) | (change > percent)
    return stepped.filter(amount.isNotNull() & spike).select(
        *_SERIES, period.alias("period"), "amount", "previous_amount", change.alias("pct_change")
    )


def _placed(named: DataFrame) -> DataFrame:
    """The rows with their day and `ord`, the place within it."""
    amount = F.col("amount").cast("double")
    return named.select(
        *_SERIES, F.when(~F.isnan(amount), amount).alias("amount"),
        F.coalesce(F.unix_date("period"), F.lit(NO_DAY)).alias("day"),
        F.unhex(F.md5(F.col("rid").cast("binary"))).alias("ord"),
    )


def _place() -> Column:
    return F.struct("ord", F.col("amount").isNotNull(), "amount")


def _stepped_whole(rows: DataFrame) -> DataFrame:
    """Rows with `known` and previous_amount, from windows over whole groups.

    The rows are sorted by a hash of their group first, which seldom needs its texts.
    """
    by = W.partitionBy("group_hash", *_SERIES)
    before = by.orderBy("day", "ord", F.col("amount").isNotNull(), "amount").rowsBetween(
        W.unboundedPreceding, -1)
    earlier = by.orderBy("day").rangeBetween(W.unboundedPreceding, -1)
    columns = [*_SERIES, "day", "ord", "amount", "known"]
    return (
        rows.repartition(*_SERIES).withColumn("group_hash", F.xxhash64(*_SERIES))
        .withColumn("known", F.last("amount", ignorenulls=True).over(before))
        .select(*columns, F.max_by("amount", F.struct("day", _place())).over(earlier)
                .alias("previous_amount"))
        .filter(F.col("ord").isNotNull()).drop("ord")
    )


def _stepped_in_buckets(placed: DataFrame) -> DataFrame:
    """The same, with each period of a group cut into 256 buckets of its order.

    Each bucket starts from what an aggregate of the buckets before it carries over; the
    windows across buckets run over one row per bucket.
    """
    bucket = [*_SERIES, "day", "bucket"]
    # Dealt by bucket once: the windows and the aggregate below both find their rows together.
    rows = placed.withColumn("bucket", F.left(F.hex("ord"), F.lit(2))).repartition(
        *bucket).withColumn("place", _place())
    ends = rows.groupBy(*bucket).agg(
        F.max_by("amount", F.when(F.col("amount").isNotNull(), F.col("place"))).alias("known"),
        F.max_by("amount", "place").alias("any"),
    )
    by_bucket = W.partitionBy(*_SERIES).orderBy("day", "bucket")
    by_day = W.partitionBy(*_SERIES).orderBy("day").rangeBetween(W.unboundedPreceding, -1)
    carried = ends.select(
        *bucket,
        F.last("known", ignorenulls=True)
        .over(by_bucket.rowsBetween(W.unboundedPreceding, -1)).alias("known_before"),
        F.max_by("any", F.struct("day", "bucket")).over(by_day).alias("previous_amount"),
    )
    before = W.partitionBy(*bucket).orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    stepped = rows.select(
        *bucket, "amount", F.last("amount", ignorenulls=True).over(before).alias("known"))
    return stepped.join(carried, bucket).select(
        *_SERIES, "day", "amount", F.coalesce("known", "known_before").alias("known"),
        "previous_amount")


def repeating_expenses(
    history: DataFrame, min_months: int = V.REPEATING_MIN_MONTHS
) -> DataFrame:
    """Expenses seen in at least `min_months` months, with a suggested quarterly accrual
    of three times the mean monthly sum."""
    monthly = (
        history.filter(
            F.col("expense_ledger").isNotNull() & F.col("vendor").isNotNull()
            & F.col("amount").isNotNull()
        )
        .groupBy("expense_ledger", "vendor", month_text("period").alias("month"))
        .agg(F.sum(F.col("amount").cast("decimal(15,2)")).alias("spent"))
    )
    months = F.count("month")
    return (
        monthly.groupBy("expense_ledger", "vendor")
        .agg(
            months.alias("months"),
            (F.sum("spent").cast("double") * 3 / months).alias("suggested_quarterly"),
        )
        .filter(F.col("months") >= min_months)
    )


def provision_vs_actual(previous: DataFrame) -> DataFrame:
    """Earlier provisions against what was spent, per vendor and category."""
    return previous.groupBy("vendor_name", "expense_category").agg(
        total("amount").alias("provided"), total("actual_amount").alias("actual"),
        (total("amount") - total("actual_amount")).alias("difference"),
    )


def missing_regular(vendors: DataFrame, ledger: DataFrame, as_of: date) -> DataFrame:
    """Running contracts whose next expense is due before `as_of` but not in the ledger.

    Due is one contract period after the vendor's last expense, or after the contract
    start when there is none. The ledger is reduced to one date per vendor first.
    """
    today = F.lit(as_of)
    last = (
        ledger.filter(F.col("transaction_date") <= today)
        .groupBy("vendor_name")
        .agg(F.max("transaction_date").alias("last_date"))
    )
    running = vendors.filter(
        (F.col("contract_start_date") <= today)
        & (F.col("contract_end_date").isNull() | (F.col("contract_end_date") >= today))
    )
    due = next_due(F.coalesce("last_date", "contract_start_date"), F.col("frequency"))
    return (
        running.join(last, "vendor_name", "left")
        .select("vendor_name", "frequency", "recurring_amount", due.alias("due_date"))
        .filter(F.col("due_date") < today)
    )
