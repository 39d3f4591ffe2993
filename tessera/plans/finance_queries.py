"""Market time-series queries."""

from __future__ import annotations

from ..functions.numeric import pct_truncated_sql
from ..operators.finance import daily_change, growth_with_close, prev_day_change, qoq_growth
from .catalog import register
from .finance_inputs import MARKET_SQL, companies, daily_prices, financials

_W = "WITH " + MARKET_SQL


@register("daily_change", _W + f"""
SELECT ticker, date, open, close, CAST(close - open AS DECIMAL(18,2)) AS change,
       {pct_truncated_sql('close - open', 'open')} AS pct_change
FROM px""")
def q_daily_change(spark, sf_dir):
    return daily_change(daily_prices(spark, sf_dir))


@register("prev_day_change", _W + f"""
, l AS (SELECT ticker, date, close, lag(date) OVER w AS prev_date, lag(close) OVER w AS prev_close
        FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, date, close, prev_date, prev_close, CAST(close - prev_close AS DECIMAL(18,2)) AS change,
       {pct_truncated_sql('close - prev_close', 'prev_close')} AS pct_change
FROM l""")
def q_prev_day_change(spark, sf_dir):
    return prev_day_change(daily_prices(spark, sf_dir))


_GROWTH = f"""
, g AS (SELECT ticker, fiscal_year, fiscal_quarter, period_end, revenue_m,
               lag(revenue_m) OVER (PARTITION BY ticker ORDER BY fiscal_year, fiscal_quarter) AS prev_revenue_m
        FROM fin),
gp AS (SELECT *, {pct_truncated_sql('revenue_m - prev_revenue_m', 'prev_revenue_m')} AS growth_pct FROM g)
"""


@register("qoq_growth", _W + _GROWTH + "SELECT * FROM gp")
def q_qoq_growth(spark, sf_dir):
    return qoq_growth(financials(spark, sf_dir))


@register("qoq_growth_leader", _W + _GROWTH + """
, lead AS (SELECT * FROM gp WHERE growth_pct IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY fiscal_year, fiscal_quarter
                                      ORDER BY growth_pct DESC, ticker ASC) = 1)
SELECT lead.*, px.close, c.name, c.sector
FROM lead JOIN px ON px.ticker = lead.ticker AND px.date = lead.period_end
LEFT JOIN companies c ON c.ticker = lead.ticker""")
def q_qoq_growth_leader(spark, sf_dir):
    return growth_with_close(financials(spark, sf_dir), daily_prices(spark, sf_dir),
                             companies(spark, sf_dir))
