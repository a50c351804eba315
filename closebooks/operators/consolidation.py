"""Entity and account positions, eliminations, and the consolidated trial balance.

Consolidation columns: rid, entity_code, account_code, account_name, debit_amount,
credit_amount, transaction_date, interco_flag.
Trial balance columns: entity, account, debit, credit.
Intercompany columns: entity, counterparty, account, amount.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from closebooks import fixed_values as V
from closebooks.functions.exprs import contains_any, count_rows, exceeds, total
from closebooks.operators import cells as ce
from closebooks.operators.skew import first_per_key, key_presence, lookup_join


def _positions(c: DataFrame, key: str) -> DataFrame:
    debit, credit = total("debit_amount"), total("credit_amount")
    return c.filter(F.col(key).isNotNull()).groupBy(key).agg(
        debit.alias("total_debit"), credit.alias("total_credit"),
        (debit - credit).alias("net_position"),
    )


def entity_summary(c: DataFrame) -> DataFrame:
    return _positions(c, "entity_code")


def account_summary(c: DataFrame) -> DataFrame:
    return _positions(c, "account_name")


def unbalanced_entities(c: DataFrame, tolerance: Decimal = V.MONEY_TOLERANCE) -> DataFrame:
    return _unbalanced(entity_summary(c), tolerance)


def _unbalanced(positions: DataFrame, tolerance: Decimal) -> DataFrame:
    return positions.filter(exceeds(F.col("net_position"), tolerance)).select(
        F.col("entity_code").alias("entity"), F.lit(V.ISSUE_UNBALANCED).alias("issue"),
        "net_position",
    )


def position_cells(c: DataFrame) -> DataFrame:
    """Sums per entity and account name, from which the positions follow."""
    debit, credit = total("debit_amount"), total("credit_amount")
    keys = {"entity": F.col("entity_code"), "account": F.col("account_name")}
    return ce.cells_of(c, keys, [
        count_rows().alias("rows"), debit.alias("total_debit"), credit.alias("total_credit"),
        (debit - credit).alias("net_position"), (debit + credit).alias("moved")])


def summaries_of_cells(
    cells: DataFrame, tolerance: Decimal = V.MONEY_TOLERANCE
) -> dict[str, DataFrame]:
    """Positions by name, and the rows (and what they move) that each leaves out."""
    names = ["total_debit", "total_credit", "net_position"]
    entities = ce.section(cells, "entity", names, "entity_code")
    return {
        "entity_summary": entities,
        "account_summary": ce.section(cells, "account", names, "account_name"),
        "consolidation_issues": _unbalanced(entities, tolerance),
        "excluded_rows": ce.left_out(cells, ["entity", "account"], "rows", "moved"),
    }


def position_excluded_rows(c: DataFrame) -> DataFrame:
    """section, row_count, amount: rows without an entity, and without an account name."""
    return summaries_of_cells(position_cells(c))["excluded_rows"]


def _intercompany(c: DataFrame) -> DataFrame:
    return c.filter(F.col("interco_flag") == "Y")


def interco_transactions(c: DataFrame) -> DataFrame:
    return _intercompany(c).select(
        F.col("entity_code").alias("entity"), F.col("account_name").alias("account"),
        F.col("debit_amount").alias("debit"), F.col("credit_amount").alias("credit"),
        F.col("transaction_date").alias("date"),
    )


def _debits(c: DataFrame) -> DataFrame:
    return _intercompany(c).filter(F.col("debit_amount") > 0).select(
        F.col("entity_code").alias("debit_entity"), F.col("account_name").alias("account"),
        F.col("debit_amount").alias("amount"),
    )


def _credits(c: DataFrame) -> DataFrame:
    """One row per (account, credit): the entity of the smallest row key.

    Debits are positive, so only positive credits can ever match one.
    """
    flat = _intercompany(c).filter(F.col("credit_amount") > 0).select(
        F.col("account_name").alias("account"), F.col("credit_amount").alias("amount"),
        F.col("entity_code").alias("credit_entity"), "rid",
    )
    return first_per_key(flat, ["account", "amount"], F.col("rid"), ["credit_entity"])


def elimination_entries(c: DataFrame) -> DataFrame:
    """Each intercompany debit with the first credit of equal account and amount.

    A credit may serve several debits. Credits are cut to one per key before the
    join, so no key multiplies.
    """
    return lookup_join(_debits(c), _credits(c), ["account", "amount"]).select(
        "debit_entity", "credit_entity", "account", "amount"
    )


def elimination_mismatches(c: DataFrame) -> DataFrame:
    """Intercompany debits without an equal credit."""
    keys = _credits(c).select("account", "amount")
    return lookup_join(_debits(c), keys, ["account", "amount"], "left_anti").select(
        "debit_entity", "account", "amount"
    )


def net_amount() -> Column:
    return F.col("debit") - F.col("credit")


def _beside(tb: DataFrame, cells: DataFrame, order: str | None) -> DataFrame:
    """at, of, size, net, cell, own: the trial balance beside what refers to it.

    `cells` are reduced intercompany rows with entity, counterparty and account. Each asks
    for |net| of the first trial-balance row of its two sides; the balance is cut to one row
    per (entity, account), which also gives the net. Both meet in one window over (entity,
    account), so each table is read once. A row without a cell is the balance itself. A cell
    that lacks an entity, counterparty or account asks for nothing and stays by itself.
    """
    by = F.col(order) if order else F.struct("debit", "credit")
    first = F.min_by(F.abs(F.coalesce(net_amount(), F.lit(0))), by)
    keyed = F.col("entity").isNotNull() & F.col("account").isNotNull()
    balance = tb.groupBy("entity", "account").agg(
        F.when(keyed, first).alias("size"), total(net_amount()).alias("net"))
    cell = F.struct(*cells.columns)
    asks = (F.col("entity").isNotNull() & F.col("counterparty").isNotNull()
            & F.col("account").isNotNull())

    def ask(at: Column, own: bool | None, account: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(own).cast("boolean").alias("own"),
                        account.alias("of"))

    account, nothing = F.col("account"), F.lit(None).cast("string")
    alone = F.array(ask(F.xxhash64(*cells.columns).cast("string"), None, nothing))
    asked = cells.select(cell.alias("cell"), F.inline(F.when(asks, F.array(
        ask(F.col("entity"), True, account),
        ask(F.col("counterparty"), False, account))).otherwise(alone)))
    both = balance.select(
        F.col("entity").alias("at"), F.col("account").alias("of"), "size", "net",
    ).unionByName(asked, allowMissingColumns=True)
    return both.withColumn("size", F.max("size").over(W.partitionBy("at", "of")))


def _sides(beside: DataFrame) -> DataFrame:
    """account, cell, own_size, other_size, net: each cell with both its sides."""
    account = F.coalesce(F.col("cell.account"), F.col("of"))
    known = beside.filter(F.col("cell").isNotNull() | F.col("of").isNotNull())
    return known.groupBy(account.alias("account"), "cell").agg(
        F.max(F.when(F.col("own"), F.col("size"))).alias("own_size"),
        F.max(F.when(~F.col("own"), F.col("size"))).alias("other_size"),
        F.sum("net").alias("net"))


def elimination_cells(tb: DataFrame, ic: DataFrame, order: str | None = None) -> DataFrame:
    """The trial balance beside the intercompany table, each reduced to its keys.

    All rows of an (entity, counterparty, account) eliminate the same amount, so the
    intercompany table is reduced to such triples before it meets the trial balance. All that
    a consolidation says but the single eliminations follows from these rows.
    """
    triples = ic.groupBy("entity", "counterparty", "account").agg(count_rows().alias("entries"))
    return _beside(tb, triples, order)


def _eliminated() -> tuple[Column, Column]:
    """Amount of one elimination, and of all entries of the cell; null if a side is missing."""
    each = F.when(F.col("own_size").isNotNull() & F.col("other_size").isNotNull(),
                  F.least("own_size", "other_size"))
    return each, each * F.col("cell.entries").cast("decimal(18,0)")


def elimination_totals(tb: DataFrame, ic: DataFrame, order: str | None = None) -> DataFrame:
    """Eliminations per (entity, counterparty, account): entries, amount of each, sum."""
    return totals_of_cells(elimination_cells(tb, ic, order))


def totals_of_cells(cells: DataFrame) -> DataFrame:
    each, eliminated = _eliminated()
    return _sides(cells).filter(each.isNotNull()).select(
        "cell.entity", "cell.counterparty", "account", "cell.entries",
        each.alias("elimination_amount"), eliminated.alias("eliminated"))


def tb_of_stored(stored: DataFrame, balance: str = "closing") -> DataFrame:
    """The stored trial balance as input of the consolidation: one of its three balances."""
    if balance not in ("opening", "current", "closing"):
        raise ValueError(f"no such balance: {balance}")
    return stored.select(
        F.col("entity_code").alias("entity"), F.col("account_name").alias("account"),
        F.col(f"{balance}_debit").alias("debit"), F.col(f"{balance}_credit").alias("credit"),
    )


def tb_eliminations(tb: DataFrame, ic: DataFrame, order: str | None = None) -> DataFrame:
    """One elimination per intercompany row whose both sides are in the trial balance."""
    return eliminations_of_cells(elimination_cells(tb, ic, order), ic)


def eliminations_of_cells(cells: DataFrame, ic: DataFrame) -> DataFrame:
    amounts = totals_of_cells(cells).select(
        "entity", "counterparty", "account", "elimination_amount"
    )
    rows = ic.select("entity", "counterparty", "account")
    return lookup_join(rows, amounts, ["entity", "counterparty", "account"])


def _account_net() -> Column:
    """Net of an account of the trial balance, less its eliminations; null for other accounts."""
    _, eliminated = _eliminated()
    return F.sum("net") - F.coalesce(F.sum(eliminated), F.lit(0))


def consolidated_tb(tb: DataFrame, ic: DataFrame, order: str | None = None) -> DataFrame:
    """Net per account over all entities, less everything eliminated on the account."""
    return tb_of_cells(elimination_cells(tb, ic, order))


def tb_of_cells(cells: DataFrame) -> DataFrame:
    return (
        _sides(cells).filter(F.col("account").isNotNull())
        .groupBy("account").agg(_account_net().alias("net_amount"))
        .filter(F.col("net_amount").isNotNull())
    )


def ledger_counts(
    tb: DataFrame, ic: DataFrame, order: str | None = None,
    tolerance: Decimal = V.MONEY_TOLERANCE,
) -> DataFrame:
    """One row of figures: difference, unclassified, mismatches, missing_counterparties.

    The first two are of the consolidated trial balance, the others those of
    `interco_counts`. The two groupings, by account and by pair of entities, are taken
    together over the same rows, so each table is read once.
    """
    paired = F.col("counterparty").isNotNull()
    cells = ic.groupBy(
        "entity", "counterparty", "account",
        F.when(~paired, F.col("journal_id")).alias("journal"),
    ).agg(count_rows().alias("entries"), total("amount").alias("amount"))
    rows = _sides(_beside(tb, cells, order)).select(
        "account", "cell", "own_size", "other_size", "net",
        F.when(F.col("cell.counterparty").isNotNull(), F.col("cell.entity")).alias("entity"),
        F.col("cell.counterparty").alias("counterparty"), F.col("cell.journal").alias("journal"),
        F.col("cell").isNotNull().alias("is_cell"))
    pair = ["is_cell", "entity", "counterparty", "journal"]
    by = [F.col(c) for c in ("account", *pair)]
    groups = rows.groupingSets([by[:1], by[1:]], *by).agg(
        F.grouping("account").alias("of_pair"), _account_net().alias("net_amount"),
        F.sum("cell.amount").alias("amount"))
    of_pair = (F.col("of_pair") == 1) & F.col("is_cell")
    known = (F.col("of_pair") == 0) & F.col("account").isNotNull() & F.col("net_amount").isNotNull()
    classified = in_balance_sheet() | in_profit_loss() | in_cash_flow()
    return groups.agg(
        total(F.when(known & in_balance_sheet(), F.col("net_amount"))).alias("difference"),
        F.count_if(known & ~classified).alias("unclassified"),
        F.count_if(of_pair & paired & F.col("entity").isNotNull()
                   & exceeds(F.col("amount"), tolerance)).alias("mismatches"),
        F.count_if(of_pair & ~paired).alias("missing_counterparties"))


def in_balance_sheet() -> Column:
    return contains_any(F.col("account"), V.BALANCE_SHEET_WORDS)


def in_profit_loss() -> Column:
    return contains_any(F.col("account"), V.PROFIT_LOSS_WORDS)


def in_cash_flow() -> Column:
    return contains_any(F.col("account"), V.CASH_FLOW_WORDS)


def balance_sheet(ctb: DataFrame) -> DataFrame:
    return ctb.filter(in_balance_sheet())


def profit_loss(ctb: DataFrame) -> DataFrame:
    return ctb.filter(in_profit_loss())


def cash_flow(ctb: DataFrame) -> DataFrame:
    return ctb.filter(in_cash_flow())


def unclassified_accounts(ctb: DataFrame) -> DataFrame:
    known = in_balance_sheet() | in_profit_loss() | in_cash_flow()
    return ctb.filter(~known).select("account")


def bs_balance(ctb: DataFrame, tolerance: Decimal = V.MONEY_TOLERANCE) -> DataFrame:
    difference = total(F.when(in_balance_sheet(), F.col("net_amount")))
    return ctb.agg(difference.alias("difference")).select(
        (~exceeds(F.col("difference"), tolerance)).alias("is_balanced"), "difference"
    )


def unlinked_entities(ic: DataFrame, tb: DataFrame) -> DataFrame:
    """Entities of the intercompany data that the trial balance does not know."""
    return _unlinked(ic.select("entity"), tb.select("entity"))


def unlinked_of_cells(cells: DataFrame) -> DataFrame:
    cell = F.col("cell")
    return _unlinked(cells.filter(cell.isNotNull()).select("cell.entity"),
                     cells.filter(cell.isNull()).select(F.col("at").alias("entity")))


def _unlinked(ours: DataFrame, known: DataFrame) -> DataFrame:
    named = F.col("entity").isNotNull()
    both = key_presence(ours.filter(named), known.filter(named), ["entity"])
    return both.filter(F.col("in_left") & ~F.col("in_right")).select("entity")


def mapped_eliminations(ic: DataFrame, mapping: DataFrame) -> DataFrame:
    """Intercompany amounts moved to the elimination account of their mapping.

    The mapping is keyed by (entity_from, entity_to, account_from). Amounts are summed
    per key first, so a busy pair of entities arrives at the join as one row.
    """
    sums = ic.groupBy("entity", "counterparty", "account").agg(F.sum("amount").alias("amount"))
    by_key = mapping.select(
        F.col("entity_from").alias("entity"), F.col("entity_to").alias("counterparty"),
        F.col("account_from").alias("account"), "elimination_account",
    )
    return (
        sums.join(by_key, ["entity", "counterparty", "account"])
        .groupBy("elimination_account")
        .agg(total("amount").alias("amount"))
    )
