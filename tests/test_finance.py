import datetime as dt
from decimal import Decimal as D

from tessera.operators.finance import daily_change, growth_with_close, prev_day_change, qoq_growth

DATES = [dt.date(2025, 1, 2), dt.date(2025, 3, 31), dt.date(2025, 6, 30), dt.date(2025, 9, 30),
         dt.date(2025, 12, 31)]
CLOSE = {"WWS": "53.00 55.60 57.80 60.90 63.50", "XBR": "76.20 83.20 91.50 99.50 107.20",
         "YFK": "38.50 39.50 40.80 41.50 42.50", "ZSF": "28.20 27.10 26.20 25.10 24.20"}
OPEN = {"WWS": "52.00 55.00 57.00 60.00 63.00", "XBR": "75.00 82.00 90.00 98.00 105.00",
        "YFK": "38.00 39.00 40.00 41.00 42.00", "ZSF": "28.00 27.00 26.00 25.00 24.00"}
REV = {"WWS": [520, 550, 590, 630], "XBR": [800, 860, 930, 1000], "YFK": [400, 420, 435, 450],
       "ZSF": [300, 295, 285, 280]}


def _px(spark):
    rows = [(t, d, D(o), D(c)) for t in CLOSE for d, o, c in zip(DATES, OPEN[t].split(), CLOSE[t].split())]
    return spark.createDataFrame(rows, "ticker string, date date, open decimal(18,2), close decimal(18,2)")


def _fin(spark):
    ends = DATES[1:]
    rows = [(t, 2025, f"Q{i + 1}", ends[i], D(r)) for t in REV for i, r in enumerate(REV[t])]
    return spark.createDataFrame(rows, "ticker string, fiscal_year int, fiscal_quarter string, "
                                       "period_end date, revenue_m decimal(18,2)")


def test_daily_change_xbr(spark):
    r = daily_change(_px(spark)).filter("ticker = 'XBR' AND date = DATE'2025-09-30'").first()
    assert r.change == D("1.50") and r.pct_change == D("1.5306")


def test_prev_day_change_wws(spark):
    r = prev_day_change(_px(spark)).filter("ticker = 'WWS' AND date = DATE'2025-06-30'").first()
    assert r.change == D("2.20") and r.prev_date == dt.date(2025, 3, 31)
    first = prev_day_change(_px(spark)).filter("date = DATE'2025-01-02'").collect()
    assert all(x.change is None for x in first)


def test_growth_leader_q3(spark):
    g = {r.ticker: r.growth_pct for r in qoq_growth(_fin(spark)).filter("fiscal_quarter = 'Q3'").collect()}
    assert g == {"XBR": D("8.1395"), "WWS": D("7.2727"), "YFK": D("3.5714"), "ZSF": D("-3.3898")}
    lead = growth_with_close(_fin(spark), _px(spark)).filter("fiscal_quarter = 'Q3'").first()
    assert (lead.ticker, lead.close) == ("XBR", D("99.50"))
