"""C2 and its parts (period: March 1997 on the fixtures)."""

from __future__ import annotations

from arrears.catalog import query
from arrears.oracle_fixtures import with_inputs
from arrears.plans import last_contact as lc
from arrears.sources.fixtures import inputs

C2_START, C2_END = "1997-03-01", "1997-03-31"

_CTES = f"""
    march_cases AS (SELECT * FROM collection_cases WHERE start_date >= DATE '{C2_START}' AND start_date <= DATE '{C2_END}'),
    last_time AS (
        SELECT e.case_id, max(e.event_dttm) AS last_contact_dttm
        FROM contact_events e WHERE e.case_id IN (SELECT case_id FROM march_cases)
        GROUP BY e.case_id),
    detail AS (
        SELECT t.case_id, c.account_id, c.strategy_name, t.last_contact_dttm,
               e.channel AS last_channel, e.contact_result AS last_contact_result
        FROM last_time t
        JOIN collection_cases c ON c.case_id = t.case_id
        JOIN contact_events e ON e.case_id = t.case_id AND e.event_dttm = t.last_contact_dttm)"""

_IN = ["collection_cases", "contact_events"]
_IN_P = _IN + ["payments"]


@query("last_contact_time", oracle=with_inputs(_IN, "SELECT * FROM last_time", _CTES))
def last_contact_time(spark, sf_dir):
    """W2."""
    inp = inputs(spark, sf_dir)
    return lc.last_contact_time(inp.collection_cases, inp.contact_events, C2_START, C2_END)


@query("last_contact_lookup", oracle=with_inputs(_IN, "SELECT * FROM detail", _CTES))
def last_contact_lookup(spark, sf_dir):
    """J9."""
    inp = inputs(spark, sf_dir)
    return lc.last_contact_details(inp.collection_cases, inp.contact_events, C2_START, C2_END)


@query(
    "payments_after_anchor_left",
    oracle=with_inputs(
        _IN_P,
        """SELECT d.*, p.payment_id, p.payment_dttm, p.payment_amount
           FROM detail d LEFT JOIN payments p
             ON p.account_id = d.account_id AND p.payment_amount > 0
            AND CAST(p.payment_dttm AS DATE) BETWEEN CAST(d.last_contact_dttm AS DATE)
                                                AND CAST(d.last_contact_dttm AS DATE) + 4""",
        _CTES,
    ),
)
def payments_after_anchor_left(spark, sf_dir):
    """J6 (rows)."""
    inp = inputs(spark, sf_dir)
    return lc.payments_after_last_contact_rows(inp.collection_cases, inp.contact_events, inp.payments, C2_START, C2_END)


@query(
    "last_contact_payment_5d",
    oracle=with_inputs(
        _IN_P,
        """SELECT d.case_id, d.account_id, d.strategy_name, d.last_contact_dttm, d.last_channel,
                  d.last_contact_result,
                  CASE WHEN count(p.payment_id) > 0 THEN 1 ELSE 0 END AS payment_in_5d_flag,
                  CAST(sum(p.payment_amount) AS DOUBLE) AS payment_amount_5d
           FROM detail d LEFT JOIN payments p
             ON p.account_id = d.account_id AND p.payment_amount > 0
            AND CAST(p.payment_dttm AS DATE) >= CAST(d.last_contact_dttm AS DATE)
            AND CAST(p.payment_dttm AS DATE) <= CAST(d.last_contact_dttm AS DATE) + 4
           GROUP BY ALL""",
        _CTES,
    ),
)
def last_contact_payment_5d(spark, sf_dir):
    """C2."""
    inp = inputs(spark, sf_dir)
    return lc.last_contact_payments(inp.collection_cases, inp.contact_events, inp.payments, C2_START, C2_END)
