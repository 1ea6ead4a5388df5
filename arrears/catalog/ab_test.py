"""The SMS A/B test report."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrears.catalog import query
from arrears.oracle_fixtures import erfc_sql, with_inputs
from arrears.plans import ab_test as ab
from arrears.sources.fixtures import inputs

_METRICS = """count(DISTINCT customer_id) AS customers_cnt,
              round(avg(delivered_flg), 6) AS delivered_rate,
              round(avg(paid_7d_flg), 6) AS payment_rate_7d,
              round(avg(paid_amount_7d), 6) AS avg_paid_amount_per_customer_7d"""

_COUNTS = """
    cnt AS (
        SELECT CAST(sum(paid_7d_flg) FILTER (WHERE group_name = 'control') AS DOUBLE) AS sc,
               CAST(count(paid_7d_flg) FILTER (WHERE group_name = 'control') AS DOUBLE) AS nc,
               CAST(sum(paid_7d_flg) FILTER (WHERE group_name = 'treatment') AS DOUBLE) AS st,
               CAST(count(paid_7d_flg) FILTER (WHERE group_name = 'treatment') AS DOUBLE) AS nt
        FROM sms_ab_test),
    stat AS (
        SELECT (st / nt - sc / nc)
               / sqrt(((sc + st) / (nc + nt)) * (1 - (sc + st) / (nc + nt)) * (1 / nc + 1 / nt)) AS z,
               sc, nc, st, nt, nc + nt AS tot, sc + st AS paid, (nc - sc) + (nt - st) AS unpaid
        FROM cnt),
    chi AS (
        SELECT z,
               (SELECT sum(power(abs(o - e) - least(0.5, abs(o - e)), 2) / e)
                FROM (VALUES (sc, nc * paid / tot), (nc - sc, nc * unpaid / tot),
                             (st, nt * paid / tot), (nt - st, nt * unpaid / tot)) v(o, e)) AS chi2
        FROM stat)"""


@query("segment_metrics", oracle=with_inputs(["sms_ab_test"], f"SELECT segment, group_name, {_METRICS} FROM sms_ab_test GROUP BY 1, 2"))
def segment_metrics(spark, sf_dir):
    """A26."""
    return ab.segment_metrics(inputs(spark, sf_dir).sms_ab_test)


@query("overall_metrics", oracle=with_inputs(["sms_ab_test"], f"SELECT group_name, {_METRICS} FROM sms_ab_test GROUP BY 1"))
def overall_metrics(spark, sf_dir):
    """A27."""
    return ab.overall_metrics(inputs(spark, sf_dir).sms_ab_test)


@query(
    "pivot_metric",
    oracle=with_inputs(
        ["sms_ab_test"],
        """SELECT segment,
                  round(avg(paid_7d_flg) FILTER (WHERE group_name = 'control'), 6) AS control,
                  round(avg(paid_7d_flg) FILTER (WHERE group_name = 'treatment'), 6) AS treatment
           FROM sms_ab_test GROUP BY 1""",
    ),
)
def pivot_metric(spark, sf_dir):
    """A28."""
    return ab.pivot_metric(inputs(spark, sf_dir).sms_ab_test)


@query(
    "ab_counts",
    oracle=with_inputs(
        ["sms_ab_test"],
        """SELECT CAST(sum(paid_7d_flg) FILTER (WHERE group_name = 'control') AS BIGINT) AS success_control,
                  count(paid_7d_flg) FILTER (WHERE group_name = 'control') AS n_control,
                  CAST(sum(paid_7d_flg) FILTER (WHERE group_name = 'treatment') AS BIGINT) AS success_treatment,
                  count(paid_7d_flg) FILTER (WHERE group_name = 'treatment') AS n_treatment
           FROM sms_ab_test""",
    ),
)
def ab_counts(spark, sf_dir):
    """E2."""
    return ab.ab_counts(inputs(spark, sf_dir).sms_ab_test)


@query(
    "uplift",
    oracle=with_inputs(
        ["sms_ab_test"],
        """SELECT round(sc / nc, 6) AS control_rate, round(st / nt, 6) AS treatment_rate,
                  round(st / nt - sc / nc, 6) AS uplift_abs, round((st / nt - sc / nc) / (sc / nc), 6) AS uplift_rel
           FROM cnt""",
        _COUNTS,
    ),
)
def uplift(spark, sf_dir):
    """E1."""
    return ab.uplift(inputs(spark, sf_dir).sms_ab_test)


@query(
    "tests_table",
    oracle=with_inputs(
        ["sms_ab_test"],
        f"""SELECT 'z-test' AS test_name, round(z, 6) AS statistic, round({erfc_sql('abs(z) / sqrt(2.0)')}, 6) AS p_value,
                   {erfc_sql('abs(z) / sqrt(2.0)')} < 0.05 AS is_significant FROM chi
            UNION ALL
            SELECT 'chi-square', round(chi2, 6), round({erfc_sql('sqrt(chi2 / 2)')}, 6),
                   {erfc_sql('sqrt(chi2 / 2)')} < 0.05 FROM chi""",
        _COUNTS,
    ),
)
def tests_table(spark, sf_dir):
    """Z-test and Yates χ² with p-values."""
    out = ab.tests_table(inputs(spark, sf_dir).sms_ab_test)
    return out.withColumns({c: F.round(c, 6) for c in ("statistic", "p_value")})


@query(
    "ab_test_report",
    oracle=with_inputs(
        ["sms_ab_test"],
        f"""SELECT round(sc / nc, 6) AS control_rate, round(st / nt, 6) AS treatment_rate,
                   round(st / nt - sc / nc, 6) AS uplift_abs, round((st / nt - sc / nc) / (sc / nc), 6) AS uplift_rel,
                   round(z, 6) AS z_stat, round({erfc_sql('abs(z) / sqrt(2.0)')}, 6) AS p_value_z,
                   round(chi2, 6) AS chi2_stat, round({erfc_sql('sqrt(chi2 / 2)')}, 6) AS p_value_chi2
            FROM cnt CROSS JOIN chi""",
        _COUNTS,
    ),
)
def ab_test_report(spark, sf_dir):
    """C5 (headline row): rates, uplift and both tests with p-values."""
    sms = inputs(spark, sf_dir).sms_ab_test
    stats = ("z_stat", "p_value_z", "chi2_stat", "p_value_chi2")
    s = ab.test_statistics(sms).select(F.struct(*stats)).scalar()  # one scalar subquery
    return ab.uplift(sms).select(
        "control_rate", "treatment_rate", "uplift_abs", "uplift_rel", *[F.round(s[c], 6).alias(c) for c in stats],
    )


@query(
    "two_proportion_z",
    oracle=with_inputs(
        ["sms_ab_test"],
        """SELECT round(sc / nc, 6) AS p_control, round(st / nt, 6) AS p_treatment,
                  round((sc + st) / (nc + nt), 6) AS p_pool,
                  round(sqrt(((sc + st) / (nc + nt)) * (1 - (sc + st) / (nc + nt)) * (1 / nc + 1 / nt)), 6) AS se,
                  round(z, 6) AS z_stat
           FROM cnt CROSS JOIN (SELECT z FROM stat)""",
        _COUNTS,
    ),
)
def two_proportion_z(spark, sf_dir):
    """E3."""
    return ab.two_proportion_z(inputs(spark, sf_dir).sms_ab_test)


@query(
    "chi_square_2x2",
    oracle=with_inputs(
        ["sms_ab_test"],
        """SELECT round(chi2, 6) AS chi2_stat, 1 AS dof,
                  round(nc * paid / tot, 6) AS expected_control_paid,
                  round(nc * unpaid / tot, 6) AS expected_control_unpaid,
                  round(nt * paid / tot, 6) AS expected_treatment_paid,
                  round(nt * unpaid / tot, 6) AS expected_treatment_unpaid
           FROM stat CROSS JOIN (SELECT chi2 FROM chi)""",
        _COUNTS,
    ),
)
def chi_square_2x2(spark, sf_dir):
    """E4."""
    return ab.chi_square_2x2(inputs(spark, sf_dir).sms_ab_test)


@query(
    "ab_p_values",
    oracle=with_inputs(
        ["sms_ab_test"],
        f"""SELECT round({erfc_sql('abs(z) / sqrt(2.0)')}, 6) AS p_value_z,
                   round({erfc_sql('sqrt(chi2 / 2)')}, 6) AS p_value_chi2 FROM chi""",
        _COUNTS,
    ),
)
def ab_p_values(spark, sf_dir):
    """E5: two-sided p-values of both tests."""
    s = ab.test_statistics(inputs(spark, sf_dir).sms_ab_test)
    return s.select(F.round("p_value_z", 6).alias("p_value_z"), F.round("p_value_chi2", 6).alias("p_value_chi2"))


_CELL = """count(DISTINCT customer_id)::DOUBLE AS customers_cnt, avg(delivered_flg)::DOUBLE AS delivered_rate,
           avg(paid_7d_flg)::DOUBLE AS payment_rate_7d, avg(paid_amount_7d)::DOUBLE AS avg_paid_amount_per_customer_7d,
           sum(paid_7d_flg)::DOUBLE AS paid, count(paid_7d_flg)::DOUBLE AS observed"""


@query(
    "ab_test_full_report",
    oracle=with_inputs(
        ["sms_ab_test"],
        f"""SELECT section, key, metric, round(value, 6) AS value FROM (
              UNPIVOT (SELECT 'segment' AS section, segment || '/' || group_name AS key, {_CELL} FROM sms_ab_test GROUP BY segment, group_name
                       UNION ALL SELECT 'group', group_name, {_CELL} FROM sms_ab_test GROUP BY group_name)
              ON customers_cnt, delivered_rate, payment_rate_7d, avg_paid_amount_per_customer_7d, paid, observed
              INTO NAME metric VALUE value)
            UNION ALL SELECT 'counts', 'all', metric, value FROM (
              UNPIVOT (SELECT sc AS success_control, nc AS n_control, st AS success_treatment, nt AS n_treatment FROM cnt)
              ON success_control, n_control, success_treatment, n_treatment INTO NAME metric VALUE value)
            UNION ALL SELECT 'uplift', 'all', metric, round(value, 6) FROM (
              UNPIVOT (SELECT sc / nc AS control_rate, st / nt AS treatment_rate, st / nt - sc / nc AS uplift_abs,
                              (st / nt - sc / nc) / (sc / nc) AS uplift_rel FROM cnt)
              ON control_rate, treatment_rate, uplift_abs, uplift_rel INTO NAME metric VALUE value)
            UNION ALL SELECT test, 'all', metric, round(value, 6) FROM (
              UNPIVOT (SELECT test, statistic, p_value, (p_value < 0.05)::INT::DOUBLE AS significant FROM (
                         SELECT 'z-test' AS test, z AS statistic, {erfc_sql('abs(z) / sqrt(2.0)')} AS p_value FROM chi
                         UNION ALL SELECT 'chi-square', chi2, {erfc_sql('sqrt(chi2 / 2)')} FROM chi))
              ON statistic, p_value, significant INTO NAME metric VALUE value)""",
        _COUNTS,
    ),
)
def ab_test_full_report(spark, sf_dir):
    """C5 in full: segment and group tables, arm counts, uplift and both tests, in long form."""
    return ab.full_report(inputs(spark, sf_dir).sms_ab_test).withColumn("value", F.round("value", 6))
