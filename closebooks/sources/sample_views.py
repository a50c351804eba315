"""Finance-shaped views over the star-schema sample tables.

Each view joins only the tables its columns come from. Foreign keys of the sample
tables are whole, so leaving out a join changes no row.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(15,2)"

# --- Fixed values: layouts of the sample tables used here. A given schema spares the
# job that would read file footers to infer one.
SAMPLE_SCHEMAS = {
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
        "c_mktsegment string"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
        "value double, props string"
    ),
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


def _entity(nation: str) -> Column:
    return F.concat(F.lit("ENT"), F.lpad(F.col(nation).cast("string"), 3, "0"))


def _journal(order_key: str) -> Column:
    return F.concat(F.lit("J"), F.col(order_key).cast("string"))


class SampleViews:
    """Lazily built views; nothing is read until a result is asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._tables:
            reader = self.spark.read.schema(SAMPLE_SCHEMAS[name])
            self._tables[name] = reader.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    # -- building blocks -------------------------------------------------------
    @staticmethod
    def _with_key(lines: DataFrame) -> DataFrame:
        key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        return (
            lines
            .withColumn("rid", key)
            .withColumn("ship_date", F.col("l_shipdate").cast("date"))
            .withColumn("price", _money("l_extendedprice"))
        )

    @cached_property
    def lines(self) -> DataFrame:
        return self._with_key(self.raw("lineitem"))

    def _with_supplier(self, df: DataFrame) -> DataFrame:
        supplier = self.raw("supplier").select("s_suppkey", "s_name", "s_nationkey")
        return df.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))

    def _with_part(self, df: DataFrame) -> DataFrame:
        part = self.raw("part").select("p_partkey", "p_type", "p_brand")
        return df.join(part, F.col("l_partkey") == F.col("p_partkey"))

    def _with_customer(self, df: DataFrame) -> DataFrame:
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        customer = self.raw("customer").select("c_custkey", "c_nationkey")
        # Orders meet their customers first: they are fewer than the lines, which move once.
        placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        return df.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))

    @cached_property
    def postings(self) -> DataFrame:
        """Lines with their part and supplier; what is computed of a line comes on top."""
        lines = self.raw("lineitem")
        return self._with_supplier(self._with_part(lines)).select(
            *lines.columns, "p_type", "p_brand", "s_name", "s_nationkey")

    def _posted(self) -> DataFrame:
        return self._with_key(self.postings)

    # -- consolidation and journals ---------------------------------------------
    @cached_property
    def consolidation(self) -> DataFrame:
        tens = _money(F.floor(F.col("l_extendedprice") / 10) * 10)

        def side(status: str) -> Column:
            return F.when(F.col("l_linestatus") == status, tens).otherwise(_zero())

        return self._posted().select(
            "rid", _entity("s_nationkey").alias("entity_code"),
            F.concat(F.lit("ACC"), F.lpad((F.col("l_partkey") % 20).cast("string"), 4, "0"))
            .alias("account_code"),
            F.col("p_type").alias("account_name"),
            side("O").alias("debit_amount"), side("F").alias("credit_amount"),
            F.col("ship_date").alias("transaction_date"),
            F.when(F.col("l_returnflag") == "R", "Y").otherwise("N").alias("interco_flag"),
        )

    @cached_property
    def journals(self) -> DataFrame:
        quantity = F.col("l_quantity")
        return self._posted().select(
            _journal("l_orderkey").alias("journal_id"),
            F.trunc("ship_date", "month").alias("entry_date"),
            F.col("p_type").alias("account"),
            F.when(F.col("l_linestatus") == "O", "Debit").otherwise("Credit").alias("type"),
            F.when(quantity != 3, _money(F.floor(quantity / 25) * 1000)).alias("amount"),
            F.when(quantity != 2, _entity("s_nationkey")).alias("entity"),
        )

    @cached_property
    def journals_stored(self) -> DataFrame:
        kept = (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 10 == 0)
        return self.raw("orders").filter(kept).select(_journal("o_orderkey").alias("journal_id"))

    @cached_property
    def journal_entries(self) -> DataFrame:
        return self.consolidation.select(
            F.col("rid").alias("id"),
            F.concat(F.lit("J"), F.split("rid", "-")[0]).alias("journal_id"),
            "transaction_date", "account_code", "account_name", "debit_amount",
            "credit_amount", F.col("entity_code").alias("entity"),
            F.concat(F.lit("Posting "), F.col("rid")).alias("description"),
        )

    # -- intercompany --------------------------------------------------------------
    @cached_property
    def interco(self) -> DataFrame:
        # --- Fixed values: account names of the sample ------------------------
        names = {
            0: "Fixed Assets", 1: "Current Liabilities", 2: "Equity", 3: "Revenue",
            4: "Expenses", 5: "Operating Cash", 6: "Investing Cash",
        }
        slot = F.col("l_partkey") % 8
        account = F.when(slot == 0, names[0])
        for i in range(1, 7):
            account = account.when(slot == i, names[i])
        unknown = (F.col("o_orderstatus") == "P") & (F.col("l_quantity") == 3)
        # What is computed of a line comes on top of the joins, and does not move with it.
        joined = self._with_supplier(self._with_customer(self.raw("lineitem")))
        return self._with_key(joined).select(
            "rid", _entity("s_nationkey").alias("entity"),
            F.when(~unknown, _entity("c_nationkey")).alias("counterparty"),
            account.otherwise("Suspense").alias("account"),
            F.when(F.col("l_linestatus") == "O", F.col("price"))
            .otherwise(_money(-F.col("l_extendedprice"))).alias("amount"),
            _journal("l_orderkey").alias("journal_id"),
            F.col("ship_date").alias("transaction_date"),
        )

    @cached_property
    def interco_reconciliation(self) -> DataFrame:
        return self.interco.select(
            F.col("rid").alias("id"),
            F.concat(F.lit("IC"), F.col("rid")).alias("transaction_id"),
            F.col("entity").alias("entity_from"), F.col("counterparty").alias("entity_to"),
            F.col("account").alias("account_code"), "amount", "transaction_date",
            F.when(F.col("counterparty").isNull(), "UNMATCHED").otherwise("MATCHED")
            .alias("status"),
            F.col("journal_id").alias("reconciliation_id"),
        )

    @cached_property
    def trial_balance(self) -> DataFrame:
        amount = F.col("amount")
        return (
            self.interco.filter(F.col("entity") != "ENT003")
            .groupBy("entity", "account")
            .agg(
                F.sum(F.when(amount > 0, amount).otherwise(_zero())).alias("debit"),
                F.sum(F.when(amount < 0, -amount).otherwise(_zero())).alias("credit"),
            )
        )

    @cached_property
    def ic_mapping(self) -> DataFrame:
        """A mapping for every pair and account but those of Suspense."""
        return (
            self.interco.filter(F.col("account") != "Suspense")
            .filter(F.col("counterparty").isNotNull())
            .select(
                F.col("entity").alias("entity_from"), F.col("counterparty").alias("entity_to"),
                F.col("account").alias("account_from"),
            )
            .distinct()
            .withColumn(
                "elimination_account", F.concat(F.lit("ELIM "), F.col("account_from"))
            )
        )

    # -- GST -------------------------------------------------------------------------
    @cached_property
    def gst_validation(self) -> DataFrame:
        def share(rate: str) -> Column:
            return _money(F.round(F.col("price") * F.lit(rate).cast("decimal(3,2)"), 2))

        line = F.col("l_linenumber")
        cgst = share("0.09")
        igst = F.when(F.col("l_returnflag") == "R", share("0.18")).otherwise(_zero())
        bump = F.when(F.col("l_quantity") == 50, F.lit(1).cast(MONEY)).otherwise(_zero())
        rows = self._with_supplier(self.lines).select(
            "rid", F.concat(F.lit("INV"), F.col("rid")).alias("invoice_number"),
            F.concat(
                (F.col("l_suppkey") % 90 + 10).cast("string"), F.lit("AAAAA"),
                (F.col("l_partkey") % 9000 + 1000).cast("string"), F.lit("A"),
                F.when(line == 7, "0").otherwise(line.cast("string")), F.lit("Z1"),
            ).alias("gstin"),
            F.col("s_name").alias("vendor_name"), F.col("ship_date").alias("invoice_date"),
            F.col("price").alias("taxable_amount"), cgst.alias("cgst_amount"),
            cgst.alias("sgst_amount"), igst.alias("igst_amount"), bump.alias("_bump"),
            F.when(F.col("l_discount") > 0.085, "N").otherwise("Y").alias("itc_eligible"),
        )
        parts = ("taxable_amount", "cgst_amount", "sgst_amount", "igst_amount", "_bump")
        amount = F.col(parts[0])
        for p in parts[1:]:
            amount = amount + F.col(p)
        return rows.select(
            *[c for c in rows.columns if c not in ("_bump", "itc_eligible")],
            _money(amount).alias("total_amount"), "itc_eligible",
        )

    @cached_property
    def gst_return(self) -> DataFrame:
        quantity, invoice = F.col("l_quantity"), F.concat(F.lit("INV"), F.col("rid"))
        discount = F.col("l_discount")
        return self.lines.filter(quantity != 49).select(
            F.when(quantity != 2, invoice).alias("invoice_no"),
            F.when((quantity == 2) & (F.col("l_tax") < 0.045), F.lit(None))
            .when(quantity == 3, F.concat(invoice, F.lit("X")))
            .otherwise(invoice).alias("gstr_summary"),
            F.when(discount > 0.095, "Excess").when(discount > 0.085, "N").otherwise("Y")
            .alias("itc_flag"),
            F.col("ship_date").alias("invoice_date"),
        )

    # -- TDS ---------------------------------------------------------------------------
    @cached_property
    def tds_validation(self) -> DataFrame:
        # --- Fixed values: section codes of the sample -------------------------
        sections = {0: "194C", 1: "194D", 2: "194H", 3: "194I", 4: "194J"}
        slot = F.col("l_partkey") % 6
        section = F.when(slot == 0, sections[0])
        for i in range(1, 5):
            section = section.when(slot == i, sections[i])
        payment = F.col("price") * 3
        return self._with_supplier(self.lines).select(
            "rid",
            F.when(F.col("l_quantity") != 2, F.concat(F.lit("CH"), F.col("rid")))
            .alias("challan_number"),
            F.concat(
                F.lit("ABCDE"), F.lpad((F.col("l_suppkey") % 10000).cast("string"), 4, "0"),
                F.when(F.col("l_linenumber") == 7, "9").otherwise("F"),
            ).alias("pan"),
            F.col("s_name").alias("vendor_name"), section.otherwise("194Q").alias("section_code"),
            _money(F.round(payment * F.col("l_discount").cast("decimal(3,2)"), 2))
            .alias("tds_amount"),
            F.col("ship_date").alias("transaction_date"), _money(payment).alias("payment_amount"),
            F.when(F.col("l_returnflag") == "A", "PAID")
            .when(F.col("l_returnflag") == "N", "PENDING").otherwise("REJECTED").alias("status"),
            "l_linenumber", "l_quantity",
        )

    @cached_property
    def traces_data(self) -> DataFrame:
        line, status = F.col("l_linenumber"), F.col("status")
        amount, day = F.col("tds_amount"), F.col("transaction_date")
        return self.tds_validation.filter(F.col("l_quantity") > 5).select(
            "challan_number", "pan", "vendor_name", "section_code",
            F.when(line == 3, _money(amount + 5)).otherwise(amount).alias("tds_amount"),
            F.when(line == 4, F.date_add(day, 1)).otherwise(day).alias("transaction_date"),
            F.when(status == "PAID", "ACCEPTED").otherwise(status).alias("status"),
            F.when(status == "PAID", F.concat(F.lit("ACK"), F.col("rid"))).otherwise("")
            .alias("acknowledgement_number"),
        )

    # -- provisions ------------------------------------------------------------------------
    @cached_property
    def provision_planning(self) -> DataFrame:
        slot, quantity = F.col("l_linenumber") % 4, F.col("l_quantity")
        score = F.col("l_discount").cast("decimal(4,2)") * 10 + F.when(
            F.col("l_tax") > 0.075, F.lit("0.5").cast("decimal(2,1)")
        ).otherwise(F.lit(0))
        return self._posted().select(
            "rid", F.col("p_type").alias("expense_category"), F.col("s_name").alias("vendor_name"),
            F.when(quantity == 1, _money(-F.col("l_extendedprice")))
            .otherwise(F.col("price")).alias("amount"),
            F.when(slot == 0, "Annual").when(slot == 1, "Monthly").when(slot == 2, "Quarterly")
            .when(quantity == 4, "Weekly").otherwise("Monthly").alias("frequency"),
            F.when(quantity != 2, F.col("ship_date")).alias("last_provision_date"),
            F.date_add("ship_date", 30).alias("expected_date"),
            score.cast("decimal(4,2)").alias("confidence_score"),
        )

    @cached_property
    def provision_history(self) -> DataFrame:
        quantity = F.col("l_quantity")
        return self._posted().select(
            "rid", F.col("p_brand").alias("expense_ledger"), F.col("s_name").alias("vendor"),
            F.trunc("ship_date", "month").alias("period"),
            F.when(quantity == 3, F.lit(None)).when(quantity == 4, F.lit(0.0))
            .otherwise(F.col("l_extendedprice")).alias("amount"),
        )

    @cached_property
    def previous_provisions(self) -> DataFrame:
        """Planned amounts with what was spent: nothing where the quantity was 2."""
        spent = F.when(F.col("last_provision_date").isNotNull(), F.abs("amount"))
        return self.provision_planning.select(
            F.col("rid").alias("provision_id"), "expense_category", "vendor_name", "amount",
            F.col("last_provision_date").alias("provision_date"),
            _money(spent).alias("actual_amount"),
        )

    @cached_property
    def vendor_info(self) -> DataFrame:
        """One contract per supplier: period by key, some ended, some never used."""
        key = F.col("s_suppkey")
        return self.raw("supplier").select(
            key.cast("string").alias("vendor_id"), F.col("s_name").alias("vendor_name"),
            F.lit("1995-01-01").cast("date").alias("contract_start_date"),
            F.when(key % 5 == 0, F.lit("2000-12-31").cast("date")).alias("contract_end_date"),
            F.lit("NET30").alias("payment_terms"), _money("s_acctbal").alias("recurring_amount"),
            F.when(key % 3 == 0, "Monthly").when(key % 3 == 1, "Quarterly").otherwise("Annual")
            .alias("frequency"),
        )

    @cached_property
    def expense_ledger(self) -> DataFrame:
        return self._with_supplier(self.lines).select(
            F.col("rid").alias("expense_id"), F.col("s_name").alias("vendor_name"),
            F.col("price").alias("amount"), F.col("ship_date").alias("transaction_date"),
        )

    # -- audit and feedback -------------------------------------------------------------
    @cached_property
    def audit_log(self) -> DataFrame:
        user, kind = F.col("user_id"), F.col("event_type")
        turn = F.col("event_id") % 4
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("J"), user.cast("string")).alias("journal_id"),
            F.col("ts").cast("date").alias("transaction_date"),
            F.concat(F.lit("ACC"), F.lpad((user % 20).cast("string"), 4, "0"))
            .alias("account_code"),
            _money("value").alias("amount"),
            F.concat(F.lit("USER"), (user % 10).cast("string")).alias("user_id"),
            F.when(kind == "signup", "CREATE").when(kind == "click", "UPDATE")
            .when(kind == "error", "DELETE").when(kind == "view", "VERIFY")
            .otherwise("APPROVE").alias("action_type"),
            F.col("props").alias("change_details"),
            F.when(turn == 0, "PENDING").when(turn == 1, "REVIEWED")
            .when(turn == 2, "APPROVED").otherwise("REJECTED").alias("audit_status"),
        )

    @cached_property
    def feedback(self) -> DataFrame:
        """One reviewer text per order, worded after the order's status and priority."""
        order = F.col("o_orderkey").cast("string")
        status = F.when(F.col("o_orderstatus") == "P", "UNMATCHED").otherwise("MATCHED")
        missing = F.when(
            F.col("o_orderpriority") == "1-URGENT",
            F.concat(
                F.lit("### Missing Counterpart Entries\n  TX"), order,
                F.lit(" UNMATCHED - no entry\n### "),
            ),
        ).otherwise("")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.concat(
                F.lit("Review\n### Mismatched Transactions\n- IC"), order, F.lit(" "), status,
                F.lit(" - amount differs\n- IC"), order, F.lit("B MATCHED - fine\n"), missing,
                F.when(F.col("o_orderstatus") == "F", "ALL ENTRIES ARE VALID\n").otherwise(""),
                F.lit("Action Items\n 1. Check IC"), order, F.lit("\nnote\n2. Close\n4. Rest"),
            ).alias("text"),
        )

    @cached_property
    def conversations(self) -> DataFrame:
        return self.raw("conversations")

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.raw("embeddings")
