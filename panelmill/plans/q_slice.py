"""Flagship: weekly window samples and their class balance."""

from panelmill.operators import stats
from panelmill.plans.registry import query


@query(
    "d12_class_balance",
    """SELECT coalesce(ticker, '*') AS ticker, count(*) AS n, SNAP6(avg(target)) AS positive_rate,
       avg(target) BETWEEN 0.1 AND 0.9 AS balanced FROM samples_v GROUP BY ROLLUP (ticker)""",
)
def class_balance(t):
    return stats.class_balance(t.samples, "target")
