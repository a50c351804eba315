"""The registered queries in plain SQL, written apart from the DataFrame plans.

Where the plans use one aggregate over a tagged union, the SQL here uses joins, EXISTS
and window functions, so that equal results mean something.
"""

from __future__ import annotations

import re

from closebooks.fixed_values import (
    GATE_PHRASES, GSTIN_PATTERN, PAN_PATTERN, TDS_GROUP_RATES, TDS_PAYMENT_RATES,
    TDS_THRESHOLDS,
)
from closebooks.schemas import TABLE_SCHEMAS

VIEWS: dict[str, str] = {
    "base_line": """
select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) rid, l.*,
  p_type, p_brand, s_name, s_nationkey, o_custkey, o_orderstatus, c_nationkey
from lineitem l join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
  join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey""",
    "consolidation": """
select rid, concat('ENT', lpad(cast(s_nationkey as varchar(9)), 3, '0')) entity_code,
  concat('ACC', lpad(cast(l_partkey % 20 as varchar(9)), 4, '0')) account_code,
  p_type account_name,
  case when l_linestatus = 'O' then cast(floor(l_extendedprice / 10) * 10 as decimal(15,2))
    else cast(0 as decimal(15,2)) end debit_amount,
  case when l_linestatus = 'F' then cast(floor(l_extendedprice / 10) * 10 as decimal(15,2))
    else cast(0 as decimal(15,2)) end credit_amount,
  cast(l_shipdate as date) transaction_date,
  case when l_returnflag = 'R' then 'Y' else 'N' end interco_flag
from base_line""",
    "gst_validation": """
select rid, invoice_number, gstin, vendor_name, invoice_date, taxable_amount, cgst_amount,
  cgst_amount sgst_amount, igst_amount,
  cast(taxable_amount + cgst_amount + cgst_amount + igst_amount + bump as decimal(15,2))
    total_amount, itc_eligible
from (select rid, concat('INV', rid) invoice_number,
  concat(cast(l_suppkey % 90 + 10 as varchar(9)), 'AAAAA',
    cast(l_partkey % 9000 + 1000 as varchar(9)), 'A',
    case when l_linenumber = 7 then '0' else cast(l_linenumber as varchar(9)) end, 'Z1') gstin,
  s_name vendor_name, cast(l_shipdate as date) invoice_date,
  cast(l_extendedprice as decimal(15,2)) taxable_amount,
  cast(round(cast(l_extendedprice as decimal(15,2)) * cast(0.09 as decimal(3,2)), 2)
    as decimal(15,2)) cgst_amount,
  case when l_returnflag = 'R' then
    cast(round(cast(l_extendedprice as decimal(15,2)) * cast(0.18 as decimal(3,2)), 2)
      as decimal(15,2)) else cast(0 as decimal(15,2)) end igst_amount,
  case when l_quantity = 50 then cast(1 as decimal(15,2)) else cast(0 as decimal(15,2)) end bump,
  case when l_discount > 0.085 then 'N' else 'Y' end itc_eligible from base_line) t""",
    "gst_return": """
select case when l_quantity = 2 then null else concat('INV', rid) end invoice_no,
  case when l_quantity = 2 and l_tax < 0.045 then null
    when l_quantity = 3 then concat('INV', rid, 'X') else concat('INV', rid) end gstr_summary,
  case when l_discount > 0.095 then 'Excess' when l_discount > 0.085 then 'N' else 'Y' end
    itc_flag, cast(l_shipdate as date) invoice_date
from base_line where l_quantity <> 49""",
    "tds_validation": """
select rid, case when l_quantity = 2 then null else concat('CH', rid) end challan_number,
  concat('ABCDE', lpad(cast(l_suppkey % 10000 as varchar(9)), 4, '0'),
    case when l_linenumber = 7 then '9' else 'F' end) pan, s_name vendor_name,
  case l_partkey % 6 when 0 then '194C' when 1 then '194D' when 2 then '194H'
    when 3 then '194I' when 4 then '194J' else '194Q' end section_code,
  cast(round(cast(l_extendedprice as decimal(15,2)) * 3 * cast(l_discount as decimal(3,2)), 2)
    as decimal(15,2)) tds_amount,
  cast(l_shipdate as date) transaction_date,
  cast(cast(l_extendedprice as decimal(15,2)) * 3 as decimal(15,2)) payment_amount,
  case l_returnflag when 'A' then 'PAID' when 'N' then 'PENDING' else 'REJECTED' end status,
  l_linenumber, l_quantity
from base_line""",
    "traces_data": """
select challan_number, pan, vendor_name, section_code,
  case when l_linenumber = 3 then cast(tds_amount + 5 as decimal(15,2)) else tds_amount end
    tds_amount,
  case when l_linenumber = 4 then cast(transaction_date + interval '1' day as date)
    else transaction_date end transaction_date,
  case status when 'PAID' then 'ACCEPTED' else status end status,
  case when status = 'PAID' then concat('ACK', rid) else '' end acknowledgement_number
from tds_validation where l_quantity > 5""",
    "provision_planning": """
select rid, p_type expense_category, s_name vendor_name,
  case when l_quantity = 1 then cast(-l_extendedprice as decimal(15,2))
    else cast(l_extendedprice as decimal(15,2)) end amount,
  case l_linenumber % 4 when 0 then 'Annual' when 1 then 'Monthly' when 2 then 'Quarterly'
    else (case when l_quantity = 4 then 'Weekly' else 'Monthly' end) end frequency,
  case when l_quantity = 2 then null else cast(l_shipdate as date) end last_provision_date,
  cast(l_shipdate + interval '30' day as date) expected_date,
  cast(cast(l_discount as decimal(4,2)) * 10
    + case when l_tax > 0.075 then 0.5 else 0 end as decimal(4,2)) confidence_score
from base_line""",
    "provision_history": """
select rid, p_brand expense_ledger, s_name vendor,
  cast(date_trunc('month', l_shipdate) as date) period,
  case when l_quantity = 3 then null when l_quantity = 4 then 0e0 else l_extendedprice end amount
from base_line""",
    "interco": """
select rid, concat('ENT', lpad(cast(s_nationkey as varchar(9)), 3, '0')) entity,
  case when o_orderstatus = 'P' and l_quantity = 3 then null
    else concat('ENT', lpad(cast(c_nationkey as varchar(9)), 3, '0')) end counterparty,
  case l_partkey % 8 when 0 then 'Fixed Assets' when 1 then 'Current Liabilities'
    when 2 then 'Equity' when 3 then 'Revenue' when 4 then 'Expenses'
    when 5 then 'Operating Cash' when 6 then 'Investing Cash' else 'Suspense' end account,
  case when l_linestatus = 'O' then cast(l_extendedprice as decimal(15,2))
    else cast(-l_extendedprice as decimal(15,2)) end amount,
  concat('J', cast(l_orderkey as varchar(20))) journal_id,
  cast(l_shipdate as date) transaction_date
from base_line""",
    "trial_balance": """
select entity, account,
  sum(case when amount > 0 then amount else cast(0 as decimal(15,2)) end) debit,
  sum(case when amount < 0 then -amount else cast(0 as decimal(15,2)) end) credit
from interco where entity <> 'ENT003' group by entity, account""",
    "journals": """
select concat('J', cast(l_orderkey as varchar(20))) journal_id,
  cast(date_trunc('month', l_shipdate) as date) entry_date, p_type account,
  case when l_linestatus = 'O' then 'Debit' else 'Credit' end type,
  case when l_quantity = 3 then null
    else cast(floor(l_quantity / 25) * 1000 as decimal(15,2)) end amount,
  case when l_quantity = 2 then null
    else concat('ENT', lpad(cast(s_nationkey as varchar(9)), 3, '0')) end entity
from base_line""",
    "journals_clean": """
select * from journals where journal_id is not null and entry_date is not null
  and account is not null and type is not null and amount is not null and entity is not null""",
    "journals_stored": """
select concat('J', cast(o_orderkey as varchar(20))) journal_id from orders
where o_orderstatus = 'F' and o_orderkey % 10 = 0""",
    "audit_log": """
select event_id id, concat('J', cast(user_id as varchar(20))) journal_id,
  cast(ts as date) transaction_date,
  concat('ACC', lpad(cast(user_id % 20 as varchar(9)), 4, '0')) account_code,
  cast(value as decimal(15,2)) amount,
  concat('USER', cast(user_id % 10 as varchar(9))) user_id,
  case event_type when 'signup' then 'CREATE' when 'click' then 'UPDATE'
    when 'error' then 'DELETE' when 'view' then 'VERIFY' else 'APPROVE' end action_type,
  props change_details,
  case event_id % 4 when 0 then 'PENDING' when 1 then 'REVIEWED' when 2 then 'APPROVED'
    else 'REJECTED' end audit_status
from events""",
    "journal_entries": """
select rid id, 'J' || split_part(rid, '-', 1) journal_id, transaction_date, account_code,
  account_name, debit_amount, credit_amount, entity_code entity, 'Posting ' || rid description
from consolidation""",
    "interco_reconciliation": """
select rid id, 'IC' || rid transaction_id, entity entity_from, counterparty entity_to,
  account account_code, amount, transaction_date,
  case when counterparty is null then 'UNMATCHED' else 'MATCHED' end status,
  journal_id reconciliation_id
from interco""",
    "ic_mapping": """
select distinct entity entity_from, counterparty entity_to, account account_from,
  'ELIM ' || account elimination_account
from interco where account <> 'Suspense' and counterparty is not null""",
    "previous_provisions": """
select rid provision_id, expense_category, vendor_name, amount,
  case when last_provision_date is not null then abs(amount) end actual_amount
from provision_planning""",
    "vendor_info": """
select s_name vendor_name, date '1995-01-01' contract_start_date,
  case when s_suppkey % 5 = 0 then date '2000-12-31' end contract_end_date,
  cast(s_acctbal as decimal(15,2)) recurring_amount,
  case s_suppkey % 3 when 0 then 'Monthly' when 1 then 'Quarterly' else 'Annual' end frequency
from supplier""",
    "expense_ledger": """
select s_name vendor_name, cast(l_shipdate as date) transaction_date
from base_line""",
    "feedback": """
select o_orderkey id, concat(
  'Review', chr(10), '### Mismatched Transactions', chr(10), '- IC', o_orderkey, ' ',
  case when o_orderstatus = 'P' then 'UNMATCHED' else 'MATCHED' end, ' - amount differs',
  chr(10), '- IC', o_orderkey, 'B MATCHED - fine', chr(10),
  case when o_orderpriority = '1-URGENT' then
    concat('### Missing Counterpart Entries', chr(10), '  TX', o_orderkey,
      ' UNMATCHED - no entry', chr(10), '### ') else '' end,
  case when o_orderstatus = 'F' then concat('ALL ENTRIES ARE VALID', chr(10)) else '' end,
  'Action Items', chr(10), ' 1. Check IC', o_orderkey, chr(10), 'note', chr(10),
  '2. Close', chr(10), '4. Rest') text
from orders""",
    "tb_first": """
select entity, account, abs(coalesce(debit - credit, 0)) size from trial_balance""",
    "elimination_rows": """
select i.entity, i.counterparty, i.account, least(a.size, b.size) elimination_amount
from interco i join tb_first a on a.entity = i.entity and a.account = i.account
  join tb_first b on b.entity = i.counterparty and b.account = i.account""",
    "ctb": """
select t.account, t.net - coalesce(e.eliminated, 0) net_amount
from (select account, sum(debit - credit) net from trial_balance group by account) t
left join (select account, sum(elimination_amount) eliminated from elimination_rows
  group by account) e on e.account = t.account""",
    "quarters": """
select entity_code entity,
  concat(year(transaction_date), '-Q', quarter(transaction_date)) period,
  account_name metric, sum(debit_amount) - sum(credit_amount) value
from consolidation group by all""",
    "variance": """
select entity, period, metric, cast(value as double) value,
  cast(previous as double) previous_value, cast(value - previous as double) variance,
  case when previous = 0 then 0.0e0 else (cast(value as double) - cast(previous as double))
    / cast(previous as double) * 100 end variance_percentage
from (select *, lag(value) over (partition by entity, metric order by period) previous
  from quarters) q""",
    "spikes": """
select h.expense_ledger, h.vendor, cast(h.period as varchar) period, h.amount,
  l.previous_amount,
  case when h.known <> 0 then (h.amount / nullif(h.known, 0) - 1) * 100 end pct_change
from (select *, lag(amount) over (partition by expense_ledger, vendor
    order by period, md5(rid), amount) known
  from provision_history where amount is not null) h
left join (select expense_ledger, vendor, period,
    lag(last_amount) over (partition by expense_ledger, vendor order by period) previous_amount
  from (select expense_ledger, vendor, period,
      arg_max_null(amount, (md5(rid), coalesce(amount, 0e0))) last_amount
    from provision_history group by all) p) l
  on l.expense_ledger = h.expense_ledger and l.vendor = h.vendor and l.period = h.period
where (h.known = 0 and h.amount > 0)
  or (h.known <> 0 and (h.amount / nullif(h.known, 0) - 1) * 100 > 20)""",
    "logs": """
select cast(entry_date as varchar) "timestamp", entity "user", type "action",
  cast(amount as double) amount, account, journal_id,
  'Auto-log for ' || type || ' entry.' "comment"
from journals_clean""",
    "overdue": """
select expense_category, vendor_name, last_provision_date, expected_date,
  date_diff('day', expected_date, date '2001-06-30') days_overdue
from (select *, cast(case frequency
    when 'Monthly' then last_provision_date + interval '1' month
    when 'Quarterly' then last_provision_date + interval '3' month
    when 'Annual' then last_provision_date + interval '1' year end as date) expected_date
  from provision_planning_dates) d
where expected_date < date '2001-06-30'""",
    "provision_planning_dates": """
select expense_category, vendor_name, frequency, last_provision_date from provision_planning""",
    "pair_sums": """
select entity, counterparty, sum(amount) total_amount, count(distinct journal_id) journals
from interco where entity is not null and counterparty is not null
group by entity, counterparty having abs(sum(amount)) > 0.01""",
}


def _case(column: str, table: dict, default: str = "null") -> str:
    arms = " ".join(f"when '{k}' then {v}" for k, v in table.items())
    return f"case {column} {arms} else {default} end"


_PAYMENT_RATE = _case("section_code", TDS_PAYMENT_RATES, "0.00")
_GROUP_RATE = _case("section_code", TDS_GROUP_RATES, "0.00")
_THRESHOLD = _case("section_code", TDS_THRESHOLDS)

_GST_SUMS = """count(*) total_invoices, cast(sum(total_amount) as double) total_amount,
  cast(sum(cgst_amount + sgst_amount + igst_amount) as double) total_tax,
  cast(coalesce(sum(total_amount) filter (where itc_eligible = 'Y'), 0) as double) eligible_itc,
  cast(coalesce(sum(total_amount) filter (where itc_eligible = 'N'), 0) as double) ineligible_itc"""
_GST_TAXES = """cast(sum(cgst_amount) as double) cgst, cast(sum(sgst_amount) as double) sgst,
  cast(sum(igst_amount) as double) igst"""
_TDS_SUMS = """count(*) total_challans, cast(sum(tds_amount) as double) total_tds,
  cast(sum(payment_amount) as double) total_payment,
  count(*) filter (where status = 'PAID') paid, count(*) filter (where status = 'PENDING') pending,
  count(*) filter (where status = 'REJECTED') rejected"""
_FREQUENCIES = """count(*) filter (where frequency = 'Monthly') monthly,
  count(*) filter (where frequency = 'Quarterly') quarterly,
  count(*) filter (where frequency = 'Annual') annual"""
_CALCULATED = "taxable_amount + cgst_amount + sgst_amount + igst_amount"
_EXPECTED = f"payment_amount * {_PAYMENT_RATE}"
_BAD_GSTIN = f"not coalesce(regexp_matches(gstin, '{GSTIN_PATTERN}'), false)"
_BAD_PAN = f"not coalesce(regexp_matches(pan, '{PAN_PATTERN}'), false)"
_UNSET = "cast(null as double)"


def _group_check(base: str) -> str:
    return f"""
select pan, section_code, cast(expected as double) expected_tds, cast(actual as double) actual_tds,
  cast(expected - actual as double) difference
from (select pan, section_code, sum({base}) * {_GROUP_RATE} expected, sum(tds_amount) actual
  from tds_validation where pan is not null and section_code is not null
  group by pan, section_code) g
where abs(expected - actual) > 0.01"""


def _gate(source: str, keys: str) -> str:
    tests = " or ".join(f"contains(lower(text), '{p}')" for p in GATE_PHRASES["journal"])
    return f"select {keys}, coalesce({tests}, false) passed from {source}"


def _sorted(table: str) -> str:
    """Rows of a stored table; the view it comes from has its key as rid or id."""
    own_id = {"journal_entries", "interco_reconciliation", "audit_log"}
    cells = []
    for f in TABLE_SCHEMAS[table].fields:
        name = f.name
        kind = f.dataType.typeName()
        if name == "id" and table not in own_id:
            cells.append("rid id")
        elif kind == "decimal":
            cells.append(f"cast({name} as double) {name}")
        elif kind == "date":
            cells.append(f"cast({name} as varchar) {name}")
        else:
            cells.append(name)
    return f"select {', '.join(cells)} from {table}"


_COUNTS = " union all ".join(
    f"select '{source}' source, count(*) n from {view}"
    for source, view in {
        "provisions": "provision_planning", "consolidation": "consolidation",
        "journal_entries": "journals", "interco_reconciliation": "interco",
        "gst_validation": "gst_validation", "tds_validation": "tds_validation",
        "audit_logs": "audit_log", "zero_amounts": "interco where amount = 0",
    }.items()
)

_BS = "regexp_matches(account, 'Assets|Liabilities|Equity')"
_PL = "regexp_matches(account, 'Revenue|Expenses')"
_CF = "regexp_matches(account, 'Operating|Investing|Financing')"

_ANY_NULL = ("journal_id is null or entry_date is null or account is null or type is null "
             "or amount is null or entity is null")
_JOURNAL_FIELDS = ("entry_date", "account", "type", "amount", "entity", "journal_id")

_STATUS = f"""
select (select count(*) from journals where {_ANY_NULL}) null_fields,
  (select coalesce(sum(amount) filter (where type = 'Debit'), 0)
    = coalesce(sum(amount) filter (where type = 'Credit'), 0) from journals_clean) balanced,
  (select count(*) from journals_clean) - (select count(*) from (select distinct * from
    journals_clean) d) duplicates"""

_CHECKS = f"""
with_status as ({_STATUS}),
checks as (
  select 'journal_null_fields' "check", null_fields n,
    concat('Warning: ', null_fields, ' null fields found in journal entries') message
    from with_status
  union all select 'journal_balance', case when balanced then 0 else 1 end,
    'Warning: Debit-Credit balance mismatch in journal entries' from with_status
  union all select 'journal_duplicates', duplicates,
    concat('Warning: ', duplicates, ' duplicate journal entries found') from with_status
  union all select 'balance_sheet', case when abs(d) > 0.01 then 1 else 0 end,
    concat('Warning: Balance Sheet Mismatch - ', cast(d as decimal(38,2)))
    from (select coalesce(sum(net_amount), 0) d from ctb where {_BS}) b
  union all select 'unclassified_accounts', count(*), 'Warning: Unclassified Accounts - '
    from ctb where not ({_BS} or {_PL} or {_CF})
  union all select 'interco_mismatches', count(*),
    concat('Warning: ', count(*), ' intercompany mismatches found') from pair_sums
  union all select 'interco_missing_counterparties', count(*),
    concat('Warning: ', count(*), ' missing counterparties found')
    from (select distinct journal_id from interco where counterparty is null)
  union all select 'gst_mismatches', count(*),
    concat('Warning: ', count(*), ' GST mismatches found') from gst_return
    where coalesce(gstr_summary <> invoice_no, true)
  union all select 'gst_missing_invoices', count(*),
    concat('Warning: ', count(*), ' missing GST invoices found') from gst_return
    where invoice_no is null
  union all select 'gst_excess_itc', count(*),
    concat('Warning: ', count(*), ' excess ITC claims found') from gst_return
    where itc_flag = 'Excess'
  union all select 'tds_deduction_mismatches', count(*),
    concat('Warning: ', count(*), ' TDS deduction mismatches found')
    from ({_group_check("tds_amount")}) g
  union all select 'tds_missing_challans', count(*),
    concat('Warning: ', count(*), ' missing TDS challans found') from tds_validation
    where challan_number is null
  union all select 'provisions_missing', count(*),
    concat('Warning: ', count(*), ' missing provisions found') from overdue
  union all select 'provision_spikes', count(*),
    concat('Warning: ', count(*), ' provision amount spikes found') from spikes)"""

_PAIR = "e.entity is not null and e.counterparty is not null and e.journal_id is not null"

BODIES: dict[str, str] = {
    # GST
    "gst_vendor_summary": f"""
select vendor_name, {_GST_SUMS} from gst_validation where vendor_name is not null
group by vendor_name""",
    "gst_itc_summary": """
select cast(sum(case when itc_eligible = 'Y' then total_amount else 0 end) as double) eligible,
  cast(sum(case when itc_eligible = 'N' then total_amount else 0 end) as double) ineligible,
  cast(sum(total_amount) as double) total from gst_validation""",
    "gst_tax_summary": f"""
select {_GST_TAXES}, cast(sum(cgst_amount + sgst_amount + igst_amount) as double) total_tax
from gst_validation""",
    "gst_monthly_summary": f"""
select strftime(invoice_date, '%Y-%m') as "month", {_GST_SUMS} from gst_validation
where invoice_date is not null group by 1""",
    "gst_summary_levels": f"""
select 'vendor' "level", vendor_name "key", {_GST_SUMS}, {_GST_TAXES} from gst_validation
group by vendor_name
union all select 'month', strftime(invoice_date, '%Y-%m'), {_GST_SUMS}, {_GST_TAXES}
from gst_validation group by 2
union all select 'all', null, {_GST_SUMS}, {_GST_TAXES} from gst_validation""",
    "gst_tax_mismatches": f"""
select invoice_number, cast({_CALCULATED} as double) calculated,
  cast(total_amount as double) actual
from gst_validation where abs({_CALCULATED} - total_amount) > 0.01""",
    "gst_invalid_gstin": f"select invoice_number, gstin from gst_validation where {_BAD_GSTIN}",
    "gst_issues": f"""
select invoice_number "key", 'Tax calculation mismatch' issue,
  cast({_CALCULATED} as double) expected, cast(total_amount as double) actual,
  cast(null as varchar) "value"
from gst_validation where abs({_CALCULATED} - total_amount) > 0.01
union all select invoice_number, 'Invalid GSTIN format', {_UNSET}, {_UNSET}, gstin
from gst_validation where {_BAD_GSTIN}""",
    "gst_return_mismatches": """
select invoice_no, gstr_summary, itc_flag from gst_return
where gstr_summary <> invoice_no or gstr_summary is null or invoice_no is null""",
    "gst_missing_invoices": """
select gstr_summary, itc_flag from gst_return where invoice_no is null""",
    "gst_excess_itc": """
select invoice_no, gstr_summary from gst_return where itc_flag = 'Excess'""",
    "gst_return_counts": """
select count(*) filter (where gstr_summary <> invoice_no or gstr_summary is null
    or invoice_no is null) mismatches,
  count(*) filter (where invoice_no is null) missing_invoices,
  count(*) filter (where itc_flag = 'Excess') excess_itc from gst_return""",
    "gst_register_vs_return": """
select distinct invoice_number, 'return' missing_in from gst_validation g
where not exists (select 1 from gst_return r where r.gstr_summary = g.invoice_number)
union all
select distinct gstr_summary, 'register' from gst_return r where gstr_summary is not null
  and not exists (select 1 from gst_validation g where g.invoice_number = r.gstr_summary)""",
    # TDS
    "tds_vendor_summary": f"""
select vendor_name, {_TDS_SUMS} from tds_validation group by vendor_name""",
    "tds_section_summary": f"""
select section_code, {_TDS_SUMS} from tds_validation group by section_code""",
    "tds_status_summary": """
select count(*) filter (where status = 'PAID') paid,
  count(*) filter (where status = 'PENDING') pending,
  count(*) filter (where status = 'REJECTED') rejected from tds_validation""",
    "tds_monthly_summary": f"""
select strftime(transaction_date, '%Y-%m') as "month", {_TDS_SUMS} from tds_validation
group by 1""",
    "tds_summary_levels": f"""
select 'vendor' "level", vendor_name "key", {_TDS_SUMS} from tds_validation group by vendor_name
union all select 'section', section_code, {_TDS_SUMS} from tds_validation group by section_code
union all select 'month', strftime(transaction_date, '%Y-%m'), {_TDS_SUMS} from tds_validation
group by 2
union all select 'all', null, {_TDS_SUMS} from tds_validation""",
    "tds_thresholds": f"""
select rid, section, payment, threshold,
  case when payment < threshold then 'below' else 'above' end side
from (select rid, section_code section, cast(payment_amount as double) payment,
  {_THRESHOLD} threshold from tds_validation) t where threshold is not null""",
    "tds_invalid_pan": f"select rid, pan from tds_validation where {_BAD_PAN}",
    "tds_calc_mismatches": f"""
select rid, cast({_EXPECTED} as double) calculated, cast(tds_amount as double) actual
from tds_validation where abs({_EXPECTED} - tds_amount) > 0.01""",
    "tds_issues": f"""
select rid "key", 'Invalid PAN format' issue, {_UNSET} expected, {_UNSET} actual, pan "value"
from tds_validation where {_BAD_PAN}
union all select rid, 'TDS calculation mismatch', cast({_EXPECTED} as double),
  cast(tds_amount as double), null
from tds_validation where abs({_EXPECTED} - tds_amount) > 0.01""",
    "tds_group_check": _group_check("tds_amount"),
    "tds_group_check_payment": _group_check("payment_amount"),
    "tds_counts": f"""
select (select count(*) from ({_group_check("tds_amount")}) g) deduction_mismatches,
  (select count(*) from tds_validation where challan_number is null) missing_challans""",
    "tds_missing_challan": """
select rid, pan, section_code, cast(tds_amount as double) tds_amount
from tds_validation where challan_number is null""",
    "tds_missing_identifiers": """
select rid, pan, challan_number, cast(tds_amount as double) tds_amount from tds_validation
where pan is null or trim(pan) = '' or challan_number is null or trim(challan_number) = ''""",
    "traces_match": """
select coalesce(t.challan_number, r.challan_number) challan_number,
  case when r.challan_number is null then 'missing_in_traces'
    when t.challan_number is null then 'missing_in_tds'
    when t.amount = r.amount and t.d1 = r.d1 and t.d2 = r.d2 then 'matched'
    when t.d1 = r.d1 and t.d2 = r.d2 then 'amount_mismatch'
    when t.amount = r.amount then 'date_mismatch'
    else 'amount_and_date_mismatch' end match_status
from (select challan_number, sum(tds_amount) amount, min(transaction_date) d1,
    max(transaction_date) d2 from tds_validation where challan_number is not null group by 1) t
full outer join (select challan_number, sum(tds_amount) amount, min(transaction_date) d1,
    max(transaction_date) d2 from traces_data where challan_number is not null group by 1) r
  on t.challan_number = r.challan_number""",
    # provisions
    "provision_category_summary": f"""
select expense_category, count(*) total_provisions, cast(sum(amount) as double) total_amount,
  cast(sum(amount) as double) / count(amount) average_amount, {_FREQUENCIES}
from provision_planning group by expense_category""",
    "provision_vendor_summary": f"""
select vendor_name, count(*) total_provisions, cast(sum(amount) as double) total_amount,
  count(distinct expense_category) category_count, {_FREQUENCIES}
from provision_planning group by vendor_name""",
    "provision_vendor_categories": f"""
select vendor_name, expense_category, count(*) provisions, cast(sum(amount) as double) amount,
  {_FREQUENCIES} from provision_planning group by vendor_name, expense_category""",
    "provision_frequency_summary": """
select f.frequency, count(p.frequency) "count",
  cast(coalesce(sum(p.amount), 0) as double) total_amount
from (values ('monthly'), ('quarterly'), ('annual')) f(frequency)
left join provision_planning p on lower(p.frequency) = f.frequency group by f.frequency""",
    "provision_confidence": """
select b.bucket, count(p.bucket) "count", cast(coalesce(sum(p.amount), 0) as double) total_amount
from (values ('high'), ('medium'), ('low')) b(bucket)
left join (select amount, case when confidence_score > 0.9 then 'high'
    when confidence_score >= 0.7 then 'medium' else 'low' end bucket
  from provision_planning) p on p.bucket = b.bucket group by b.bucket""",
    "provision_upcoming": """
select expense_category, vendor_name, cast(amount as double) amount,
  strftime(expected_date, '%Y-%m-%d') expected_date,
  cast(confidence_score as double) confidence_score
from provision_planning where expected_date <= date '2001-06-30' + interval '30' day""",
    "provision_overdue": """
select expense_category, vendor_name, cast(last_provision_date as varchar) last_provision_date,
  cast(expected_date as varchar) expected_date, cast(days_overdue as integer) days_overdue
from overdue""",
    "provision_issues": """
select rid "key", expense_category, vendor_name, 'Missing date information' issue,
  cast(null as varchar) "value" from provision_planning
where last_provision_date is null or expected_date is null
union all select rid, expense_category, vendor_name, 'Invalid frequency', frequency
from provision_planning where frequency is null
  or frequency not in ('Monthly', 'Quarterly', 'Annual')
union all select rid, expense_category, vendor_name, 'Invalid amount', cast(amount as varchar)
from provision_planning where amount <= 0
union all select rid, expense_category, vendor_name, 'Invalid confidence score',
  cast(confidence_score as varchar)
from provision_planning where confidence_score is null or confidence_score < 0
  or confidence_score > 1""",
    "provision_spikes": "select * from spikes",
    "provision_vs_actual": """
select vendor_name, expense_category, cast(sum(amount) as double) provided,
  cast(coalesce(sum(actual_amount), 0) as double) actual,
  cast(sum(amount) - coalesce(sum(actual_amount), 0) as double) difference
from previous_provisions group by vendor_name, expense_category""",
    "missing_regular": """
select vendor_name, frequency, cast(recurring_amount as double) recurring_amount,
  cast(due as varchar) due_date
from (select v.vendor_name, v.frequency, v.recurring_amount, cast(
    coalesce(l.last_date, v.contract_start_date) + case v.frequency
      when 'Monthly' then interval '1' month when 'Quarterly' then interval '3' month
      when 'Annual' then interval '12' month end as date) due
  from vendor_info v left join (select vendor_name, max(transaction_date) last_date
    from expense_ledger where transaction_date <= date '2002-01-15' group by 1) l
    on l.vendor_name = v.vendor_name
  where v.contract_start_date <= date '2002-01-15'
    and (v.contract_end_date is null or v.contract_end_date >= date '2002-01-15')) d
where due < date '2002-01-15'""",
    "repeating_expenses": """
select expense_ledger, vendor, count(*) "months",
  cast(sum(spent) as double) * 3 / count(*) suggested_quarterly
from (select expense_ledger, vendor, strftime(period, '%Y-%m') m,
    sum(cast(amount as decimal(15,2))) spent
  from provision_history where amount is not null group by all) q
group by expense_ledger, vendor having count(*) >= 3""",
    # consolidation
    "entity_summary": """
select entity_code, cast(sum(debit_amount) as double) total_debit,
  cast(sum(credit_amount) as double) total_credit,
  cast(sum(debit_amount) - sum(credit_amount) as double) net_position
from consolidation group by entity_code""",
    "account_summary": """
select account_name, cast(sum(debit_amount) as double) total_debit,
  cast(sum(credit_amount) as double) total_credit,
  cast(sum(debit_amount) - sum(credit_amount) as double) net_position
from consolidation group by account_name""",
    "interco_transactions": """
select entity_code entity, account_name account, cast(debit_amount as double) debit,
  cast(credit_amount as double) credit, cast(transaction_date as varchar) "date"
from consolidation where interco_flag = 'Y'""",
    "elimination_entries": """
select d.entity_code debit_entity, c.entity_code credit_entity, d.account_name account,
  cast(d.debit_amount as double) amount
from (select * from consolidation where interco_flag = 'Y' and debit_amount > 0) d
join (select entity_code, account_name, credit_amount, row_number() over (
    partition by account_name, credit_amount order by rid) nr
  from consolidation where interco_flag = 'Y') c
  on c.nr = 1 and c.account_name = d.account_name and c.credit_amount = d.debit_amount""",
    "elimination_mismatches": """
select entity_code debit_entity, account_name account, cast(debit_amount as double) amount
from consolidation d where interco_flag = 'Y' and debit_amount > 0
  and not exists (select 1 from consolidation c where c.interco_flag = 'Y'
    and c.account_name = d.account_name and c.credit_amount = d.debit_amount)""",
    "unbalanced_entities": """
select entity_code entity, 'Unbalanced position' issue,
  cast(sum(debit_amount) - sum(credit_amount) as double) net_position
from consolidation group by entity_code
having abs(sum(debit_amount) - sum(credit_amount)) > 0.01""",
    "tb_eliminations": """
select entity, counterparty, account, cast(elimination_amount as double) elimination_amount
from elimination_rows""",
    "elimination_totals": """
select entity, counterparty, account, count(*) entries,
  cast(max(elimination_amount) as double) elimination_amount,
  cast(sum(elimination_amount) as double) eliminated
from elimination_rows group by entity, counterparty, account""",
    "consolidated_tb": "select account, cast(net_amount as double) net_amount from ctb",
    "balance_sheet": f"select account, cast(net_amount as double) net_amount from ctb where {_BS}",
    "profit_loss": f"select account, cast(net_amount as double) net_amount from ctb where {_PL}",
    "cash_flow": f"select account, cast(net_amount as double) net_amount from ctb where {_CF}",
    "bs_balance": f"""
select not (abs(coalesce(sum(net_amount), 0)) > 0.01) is_balanced,
  cast(coalesce(sum(net_amount), 0) as double) difference from ctb where {_BS}""",
    "unclassified_accounts": f"select account from ctb where not ({_BS} or {_PL} or {_CF})",
    "unlinked_entities": """
select distinct entity from interco i where entity is not null
  and not exists (select 1 from trial_balance t where t.entity = i.entity)""",
    "mapped_eliminations": """
select m.elimination_account, cast(sum(i.amount) as double) amount
from interco i join ic_mapping m on m.entity_from = i.entity
  and m.entity_to = i.counterparty and m.account_from = i.account
group by m.elimination_account""",
    # intercompany
    "interco_mismatches": """
select entity, counterparty, cast(total_amount as double) total_amount, journals
from pair_sums""",
    "interco_mismatch_journals": """
select i.entity, i.counterparty, i.journal_id, cast(sum(i.amount) as double) amount
from interco i join pair_sums p on p.entity = i.entity and p.counterparty = i.counterparty
group by i.entity, i.counterparty, i.journal_id""",
    "interco_counts": """
select (select count(*) from pair_sums) mismatches,
  (select count(*) from (select distinct journal_id from interco where counterparty is null))
    missing_counterparties""",
    "interco_missing_counterparty": """
select distinct journal_id from interco where counterparty is null""",
    "interco_missing_counterpart": f"""
select distinct e.entity, e.counterparty, e.journal_id from interco e
where {_PAIR} and not exists (select 1 from interco o where o.journal_id = e.journal_id
  and o.entity = e.counterparty and o.counterparty = e.entity)""",
    "interco_amount_mismatch": """
select a.entity, a.counterparty, cast(a.amount as double) amount,
  cast(b.amount as double) counter_amount
from (select entity, counterparty, sum(amount) amount from interco group by 1, 2) a
join (select entity, counterparty, sum(amount) amount from interco group by 1, 2) b
  on b.entity = a.counterparty and b.counterparty = a.entity
where abs(a.amount - b.amount) > 1""",
    # journals
    "journal_null_rows": f"select count(*) null_fields from journals where {_ANY_NULL}",
    "journal_dropna": """
select journal_id, cast(entry_date as varchar) entry_date, account, type,
  cast(amount as double) amount, entity from journals_clean""",
    "journal_duplicates": """
select count(*) duplicates from (select row_number() over (partition by journal_id, entry_date,
  account, type, amount, entity) nr from journals) r where nr > 1""",
    "journal_balance": """
select cast(d as double) total_debit, cast(c as double) total_credit, d = c balanced
from (select coalesce(sum(amount) filter (where type = 'Debit'), 0) d,
  coalesce(sum(amount) filter (where type = 'Credit'), 0) c from journals_clean) s""",
    "journal_balance_by_id": """
select journal_id, cast(d as double) debit, cast(c as double) credit
from (select journal_id, coalesce(sum(amount) filter (where type = 'Debit'), 0) d,
    coalesce(sum(amount) filter (where type = 'Credit'), 0) c
  from journals group by journal_id) s where d <> c""",
    "journal_duplicate_ids": """
select journal_id, count(*) n from journals group by journal_id having count(*) > 1""",
    "journal_status": f"""
select null_fields, balanced, duplicates,
  case when null_fields = 0 and balanced and duplicates = 0 then 'PASS' else 'FAIL' end status
from ({_STATUS}) s""",
    "journal_missing_fields": " union all ".join(
        f"select '{c}' field, count(*) filter (where {c} is null) n from journals"
        for c in _JOURNAL_FIELDS
    ),
    "journal_missing_field_rows": " union all ".join(
        f"select journal_id, '{c}' field from journals where {c} is null"
        for c in _JOURNAL_FIELDS
    ),
    "journal_existing_keys": """
select distinct journal_id from journals where journal_id in
  (select journal_id from journals_stored)""",
    "journal_new_rows": """
select journal_id, cast(entry_date as varchar) entry_date, account, type,
  cast(amount as double) amount, entity from journals j
where not exists (select 1 from journals_stored s where s.journal_id = j.journal_id)""",
    "read_back": """
select journal_id, cast(entry_date as varchar) entry_date, account, type,
  cast(amount as double) amount, entity from journals
where journal_id in (select journal_id from journals_stored)""",
    "journal_id_number": """
select journal_id, cast(substr(journal_id, 2) as bigint) number from journals""",
    # audit
    "audit_log_entries": "select * from logs",
    "audit_log_filtered": """
select * from logs where "user" = 'ENT015' and "action" = 'Debit'""",
    "audit_timeline": """
select "timestamp", "action" || ' by ' || "user" "event" from logs""",
    "audit_flags": """
select (select count(*) from logs) = 0 missing_log,
  (select count(*) from logs where journal_id in (select journal_id from audit_log)) = 0
    missing_document""",
    "audit_stale_pending": """
select id, journal_id,
  cast(date_diff('day', transaction_date, date '2024-01-31') as integer) age_days
from audit_log where audit_status = 'PENDING'
  and date_diff('day', transaction_date, date '2024-01-31') > 7""",
    "audit_missing_record": """
select distinct journal_id from journals j where not exists
  (select 1 from audit_log a where a.journal_id = j.journal_id)""",
    "source_counts": f"select source, n, n > 0 has_data from ({_COUNTS}) s",
    "missing_sources": f"select source from ({_COUNTS}) s where n = 0",
    "total_entries": f"select cast(sum(n) as bigint) total_entries from ({_COUNTS}) s",
    **{
        f"audit_sorted_{t}": _sorted(t)
        for t in (
            "journal_entries", "interco_reconciliation", "gst_validation", "tds_validation",
            "provision_planning", "consolidation", "audit_log",
        )
    },
    # reporting
    "statement_totals": f"""
select cast(coalesce(sum(net_amount) filter (where {_PL} and account like '%Revenue%'), 0)
    as double) revenue,
  cast(abs(coalesce(sum(net_amount) filter (where {_PL} and account like '%Expense%'), 0))
    as double) expenses,
  cast(coalesce(sum(net_amount) filter (where {_BS} and account like '%Asset%'), 0)
    as double) assets
from ctb""",
    "quarterly_values": """
select entity, period, metric, cast(value as double) value from quarters""",
    "period_variance": "select * from variance",
    "statement_report": f"""
select entity, period, metric, cast(value as double) value,
  cast(previous as double) previous_value, cast(value - previous as double) variance,
  case when previous = 0 then 0e0 else (cast(value as double) - cast(previous as double))
    / cast(previous as double) * 100 end variance_percentage
from (select *, lag(value) over (partition by entity, metric order by period) previous
  from (select q.entity, q.period, m.metric, case m.metric
      when 'Revenue' then coalesce(sum(amount) filter (where account = 'Revenue'), 0)
      when 'Expenses' then abs(coalesce(sum(amount) filter (where account = 'Expenses'), 0))
      else coalesce(sum(amount) filter (where account = 'Fixed Assets'), 0) end value
    from (select *, concat(year(transaction_date), '-Q', quarter(transaction_date)) period
      from interco) q, (values ('Revenue'), ('Expenses'), ('Assets')) m(metric)
    group by q.entity, q.period, m.metric) g) w""",
    "financial_report": f"""
select concat_ws('|', entity, period, metric) id,
  case when regexp_matches(metric, 'Assets|Liabilities|Equity') then 'BS'
    when regexp_matches(metric, 'Revenue|Expenses') then 'PL'
    when regexp_matches(metric, 'Operating|Investing|Financing') then 'CF' end report_type,
  period, entity, metric, cast(value as double) value, cast(previous as double) previous_value,
  cast(value - previous as double) variance,
  cast(round(cast(case when previous = 0 then 0e0 else
    (cast(value as double) - cast(previous as double)) / cast(previous as double) * 100 end
    as decimal(24,6)), 2) as double) variance_percentage
from (select *, lag(value) over (partition by entity, metric order by period) previous
  from (select entity, concat(year(transaction_date), '-Q', quarter(transaction_date)) period,
      account metric, sum(amount) value from interco group by all) q) w""",
    "empty_report_fields": """
select entity, period, metric, f.field from variance,
  (values ('value'), ('previous_value'), ('variance'), ('variance_percentage')) f(field)
where case f.field when 'value' then value is null when 'previous_value' then
  previous_value is null when 'variance' then variance is null
  else variance_percentage is null end""",
    "close_checks": "select * from checks",
    "close_warnings": "select * from checks where n > 0",
    # text, records, vectors
    "row_documents": """
select rid, concat('entity_code: ', coalesce(entity_code, 'nan'),
  ', account_code: ', coalesce(account_code, 'nan'),
  ', account_name: ', coalesce(account_name, 'nan'),
  ', debit_amount: ', coalesce(cast(debit_amount as varchar), 'nan'),
  ', credit_amount: ', coalesce(cast(credit_amount as varchar), 'nan'),
  ', transaction_date: ', coalesce(cast(transaction_date as varchar), 'nan'),
  ', interco_flag: ', coalesce(interco_flag, 'nan')) as "document" from consolidation""",
    "to_records": """
select concat('{"id":', id, ',"journal_id":"', journal_id, '","transaction_date":"',
  transaction_date, '","account_code":"', account_code, '","amount":', amount,
  ',"user_id":"', user_id, '","action_type":"', action_type, '","change_details":',
  to_json(change_details), ',"audit_status":"', audit_status, '"}') "record" from audit_log""",
    "sample_rows": """
select journal_id, cast(entry_date as varchar) entry_date, account, type,
  cast(amount as double) amount, entity from journals
order by entry_date nulls first, journal_id nulls first, account nulls first,
  type nulls first, amount nulls first, entity nulls first limit 5""",
    "feedback_gate": _gate("conversations", "conv_id, turn"),
    "feedback_gate_orders": _gate("feedback", "id"),
    "feedback_sections": """
select id, 'mismatched_transactions' section, split_part(trim(line), ' - ', 1) line from (
  select id, unnest(string_split(split_part(string_split(text, 'Mismatched Transactions')[2],
    '###', 1), chr(10))) line from feedback where contains(text, 'Mismatched Transactions')) m
where contains(line, 'IC') and contains(line, 'UNMATCHED')
union all
select id, 'missing_counterparts', split_part(trim(line), ' - ', 1) from (
  select id, unnest(string_split(split_part(string_split(text, 'Missing Counterpart Entries')[2],
    '###', 1), chr(10))) line from feedback
  where contains(text, 'Missing Counterpart Entries')) m
where contains(line, 'UNMATCHED')
union all
select id, 'action_items', trim(line) from (
  select id, unnest(string_split(string_split(text, 'Action Items')[2], chr(10))) line
  from feedback where contains(text, 'Action Items')) m
where regexp_matches(trim(line), '^[123][.]')""",
    "vector_top_k": """
select vec_id, cast(row_number() over (order by d, vec_id) as integer) "rank" from (
  select e.vec_id, list_distance(e.embedding, q.embedding) d from embeddings e,
    (select embedding from embeddings where vec_id = 0) q order by d, e.vec_id limit 4) t""",
}

_ORDER_TEXT = """
select concat(' ', o_orderkey) order_id,
  case when o_orderkey % 11 = 0 then '2024-13-01' when o_orderkey % 13 = 0 then 'n/a'
    else strftime(o_orderdate, '%Y-%m-%d') end order_date,
  case when o_orderkey % 7 = 0 then 'abc' when o_orderkey % 5 = 0 then ' '
    else cast(cast(o_totalprice as decimal(15,2)) as varchar) end total_price
from orders"""


def _left_out(table: str, amount: str, sections: dict[str, str]) -> str:
    """What the sections leave out, by the condition under which their key is missing."""
    return " union all ".join(f"""
select '{name}' section, count(*) filter (where {gone}) row_count,
  coalesce(cast(sum({amount}) filter (where {gone}) as double), 0) amount from {table}"""
                              for name, gone in sections.items())


BODIES |= {
    "vector_top_k_questions": """
select question_id, vec_id, cast(r as integer) "rank" from (
  select q.vec_id question_id, e.vec_id, row_number() over (partition by q.vec_id order by
    list_sum(list_transform(list_zip(e.embedding, q.embedding),
      lambda p: (cast(p[1] as double) - p[2]) * (cast(p[1] as double) - p[2]))), e.vec_id) r
  from embeddings e join embeddings q on q.vec_id % 50 = 7) t where r <= 4""",
    "gst_excluded_rows": _left_out("gst_validation", "total_amount", {
        "vendor": "itc_eligible = 'N'", "month": "igst_amount > 0"}),
    "tds_excluded_rows": _left_out("tds_validation", "payment_amount", {
        "vendor": "status = 'REJECTED'", "section": "section_code = '194Q'", "month": "false"}),
    "provision_excluded_rows": _left_out("provision_planning", "amount", {
        "category": "frequency = 'Weekly'", "vendor": "amount < 0"}),
    "position_excluded_rows": _left_out("consolidation", "debit_amount + credit_amount", {
        "entity": "interco_flag = 'Y'", "account": "debit_amount > 50000"}),
    "headers_normalized": _ORDER_TEXT,
    "journal_headers": f"""
select order_id "Journal ID", order_date "Type", total_price "Amount" from ({_ORDER_TEXT})""",
    "typed_rejects": """
select cast(o_orderkey as varchar) order_id,
  case when o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0
    then strftime(o_orderdate, '%Y-%m-%d') end order_date,
  case when o_orderkey % 7 <> 0 and o_orderkey % 5 <> 0
    then cast(cast(o_totalprice as decimal(15,2)) as double) end total_price,
  cast(null as varchar) note,
  concat_ws(',', case when o_orderkey % 11 = 0 then 'order_date' end,
    case when o_orderkey % 7 = 0 then 'total_price' end) bad
from orders""",
    "layouts_union": f"""
select order_id, case when cast(trim(order_id) as bigint) % 2 = 0 then order_date end order_date,
  case when cast(trim(order_id) as bigint) % 2 <> 0 then total_price end total_price
from ({_ORDER_TEXT})""",
    "stored_layout": """
select concat(digest, '-', row_number() over (partition by digest)) id, journal_id, description,
  cast(null as double) debit_amount
from (select cast(l_suppkey as varchar) journal_id, l_returnflag description,
    md5(concat_ws(chr(31), 'upload.csv', cast(l_suppkey as varchar), l_returnflag)) digest
  from lineitem)""",
}

_TABLE_COLUMNS = {
    table: ", ".join(
        f"rid {f.name}" if f.name == "id" else
        f"cast({f.name} as double) {f.name}" if "decimal" in f.dataType.simpleString() else
        f"cast({f.name} as varchar) {f.name}" for f in TABLE_SCHEMAS[table].fields)
    for table in ("gst_validation", "tds_validation")}
_JOURNAL_CELLS = """
concat('J', split_part(rid, '-', 1)) journal_id, cast(transaction_date as varchar) transaction_date,
  account_code, account_name, cast(debit_amount as double) debit_amount,
  cast(credit_amount as double) credit_amount, entity_code entity,
  concat('Posting ', rid) description"""
_CLEAN_JOURNALS = """(select * from journals where journal_id is not null and entry_date is not null
  and account is not null and type is not null and amount is not null and entity is not null)"""
_STORED_AUDIT = {
    "journal_entries": "consolidation", "interco_reconciliation": "interco",
    "gst_validation": "gst_validation", "tds_validation": "tds_validation",
    "provision_planning": "provision_planning", "consolidation": "consolidation",
    "audit_log": "audit_log"}


def _section_counts(sections: dict[str, str]) -> str:
    """Number of rows by section; a section is a query's name, or a statement."""
    return " union all ".join(
        f"select '{name}' section, count(*) row_count from ({BODIES.get(body, body)}) t"
        for name, body in sections.items())


def _rows_of(table: str) -> str:
    return f"select 1 from {table}"


_SECTIONS = {
    "upload_consolidation": {
        "data": _rows_of("consolidation"), "entity_summary": "entity_summary",
        "account_summary": "account_summary", "consolidation_issues": "unbalanced_entities",
        "excluded_rows": "position_excluded_rows",
        "intercompany_transactions": "interco_transactions",
        "elimination_entries": "elimination_entries"},
    "upload_gst": {
        "data": _rows_of("gst_validation"), "summaries": "gst_summary_levels",
        "vendor_summary": "gst_vendor_summary", "itc_summary": "gst_itc_summary",
        "tax_summary": "gst_tax_summary", "monthly_summary": "gst_monthly_summary",
        "excluded_rows": "gst_excluded_rows", "validation_issues": "gst_issues"},
    "upload_tds": {
        "data": _rows_of("tds_validation"), "summaries": "tds_summary_levels",
        "vendor_summary": "tds_vendor_summary", "section_summary": "tds_section_summary",
        "status_summary": "tds_status_summary", "monthly_summary": "tds_monthly_summary",
        "excluded_rows": "tds_excluded_rows", "threshold_analysis": "tds_thresholds",
        "validation_issues": "tds_issues"},
    "upload_provisions": {
        "data": _rows_of("provision_planning"),
        "expense_category_summary": "provision_category_summary",
        "vendor_summary": "provision_vendor_summary",
        "vendor_categories": "provision_vendor_categories",
        "frequency_summary": "provision_frequency_summary",
        "confidence_analysis": "provision_confidence",
        "excluded_rows": "provision_excluded_rows",
        "upcoming_provisions": "provision_upcoming", "validation_issues": "provision_issues"},
    "upload_journals": {
        "data": _rows_of("consolidation"),
        "existing_keys": "select distinct split_part(rid, '-', 1) from consolidation"},
    "upload_interco": {
        "data": _rows_of("interco"), "reconciliation_report": "select unnest([1, 2])",
        "existing_keys": "select distinct rid from interco"},
    "job_validate_journals": {
        "status": "journal_status", "validated_data": "journal_dropna",
        "missing_fields": "journal_missing_fields",
        "unbalanced_journals": f"""
select journal_id from {_CLEAN_JOURNALS} c group by 1
having sum(case type when 'Debit' then amount when 'Credit' then -amount else 0 end) <> 0""",
        "duplicate_ids": f"select journal_id from {_CLEAN_JOURNALS} c group by 1 having count(*) > 1",
        "documents": _rows_of(f"{_CLEAN_JOURNALS} c")},
    "job_reconcile_interco": {
        "mismatches": "interco_mismatches", "mismatch_journals": "interco_mismatch_journals",
        "missing_counterparties": "interco_missing_counterparty",
        "missing_counterparts": "interco_missing_counterpart",
        "amount_mismatches": "interco_amount_mismatch"},
    "job_validate_gst": {
        "mismatches": "gst_return_mismatches", "missing_invoices": "gst_missing_invoices",
        "excess_itc": "gst_excess_itc", "register_vs_return": "gst_register_vs_return"},
    "job_validate_tds": {
        "deduction_mismatches": "tds_group_check", "missing_challans": "tds_missing_challan",
        "missing_identifiers": "tds_missing_identifiers", "traces_match": "traces_match"},
    "job_analyze_provisions": {
        "missing_provisions": "provision_overdue", "amount_spikes": "provision_spikes",
        "repeating_expenses": "repeating_expenses"},
    "job_consolidate": {
        "consolidated_trial_balance": "consolidated_tb", "eliminations": "tb_eliminations",
        "elimination_totals": "elimination_totals", "balance_sheet": "balance_sheet",
        "profit_loss": "profit_loss", "cash_flow": "cash_flow", "balance": "bs_balance",
        "unclassified_accounts": "unclassified_accounts",
        "unlinked_entities": "unlinked_entities"},
    "job_audit_trail": {
        "logs": _rows_of(f"{_CLEAN_JOURNALS} c where entity = 'ENT015'"),
        "timeline": _rows_of(f"{_CLEAN_JOURNALS} c where entity = 'ENT015'"),
        "flags": "select 1", "missing_records": f"""
select distinct journal_id from {_CLEAN_JOURNALS} c
where journal_id not in (select journal_id from audit_log)"""},
    "job_financial_summary": {
        "counts": "select unnest([1, 2, 3])", "total": "select 1", "missing_sources": "select 1"},
    "job_audit_summary": {
        "counts": "select unnest(range(7))",
        **{name: _rows_of(view) for name, view in _STORED_AUDIT.items()}},
}
_CLOSE_AREAS = {
    "journals": "job_validate_journals", "consolidation": "job_consolidate",
    "intercompany": "job_reconcile_interco", "gst": "job_validate_gst",
    "tds": "job_validate_tds", "provisions": "job_analyze_provisions"}
_SECTIONS["job_close_report"] = {
    **{f"{area}.{name}": body for area, job in _CLOSE_AREAS.items()
       for name, body in _SECTIONS[job].items()
       if name not in ("register_vs_return", "traces_match")},
    "summary.statement_totals": "statement_totals", "summary.warnings": "close_warnings"}

BODIES |= {
    "csv_table_read": f"select {_TABLE_COLUMNS['gst_validation']} from gst_validation",
    "csv_named_read": """
select account, cast(debit as double) debit, cast(credit as double) credit, entity
from trial_balance""",
    "csv_journals_read": """
select journal_id, cast(entry_date as varchar) entry_date, account, type,
  cast(amount as double) amount, entity from journals""",
    "table_append_read": f"select {_TABLE_COLUMNS['tds_validation']} from tds_validation",
    "landing_rows": f"""
select {_JOURNAL_CELLS}, cast(0 as bigint) ingest_batch from consolidation""",
    "landing_outcomes": """
select cast(b as integer) ingest_batch, case b when 0 then 'accepted' else 'refused' end status,
  case b when 1 then 'keys already stored' end reason, count(*) row_count
from consolidation, (select unnest([0, 1]) b) group by b""",
    "upload_journal_rows": f"select {_JOURNAL_CELLS} from consolidation",
    "job_store_audit": " union all ".join(
        f"select '{name}' source, count(*) n, count(*) > 0 has_data from {view}"
        for name, view in _STORED_AUDIT.items()),
    **{name: _section_counts(sections) for name, sections in _SECTIONS.items()},
}


def _uses(sql: str, name: str) -> bool:
    return re.search(rf"\b(?:from|join)\s+{name}\b", sql) is not None


def _needed(sql: str) -> list[str]:
    """Views a statement reads, directly or through other views, in creation order."""
    found: dict[str, None] = {}

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in found and _uses(text, name):
                visit(body)
                found[name] = None

    visit(sql)
    return list(found)


def _statement(body: str) -> str:
    prelude = _CHECKS.strip() if _uses(body, "checks") else ""
    parts = [f"{n} as ({VIEWS[n].strip()})" for n in _needed(prelude + " " + body)]
    if prelude:
        parts.append(prelude)
    head = "with " + ",\n".join(parts) + "\n" if parts else ""
    return head + body.strip()


def oracle_sql() -> dict[str, str]:
    return {name: _statement(body) for name, body in BODIES.items()}
