"""Accounting ratios as expressions over a dense monthly panel of statement items."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.calendar import month_end

#: The statement items that are read.
ITEMS = (
    "totalRevenue grossProfit ebitda ebit incomeBeforeTax incomeTaxExpense netIncome capitalExpenditures "
    "freeCashFlow dividendsPaid salePurchaseOfStock totalAssets totalStockholderEquity netInvestedCapital "
    "longTermDebt shortTermDebt cashAndEquivalents netDebt propertyPlantEquipment commonStockSharesOutstanding"
).split()


class Ratio(StrEnum):
    ROA = "ROA"
    ROE = "ROE"
    ROIC = "ROIC"
    GROSS_MARGIN = "GrossMargin"
    OPERATING_MARGIN = "OperatingMargin"
    NET_MARGIN = "NetMargin"
    FCF_YIELD = "FreeCashFlowYield"
    CASH_FLOW_MARGIN = "CashFlowMargin"
    CASH_FLOW_TO_INCOME = "CashFlowtoNetIncome"
    NET_PAYOUT_YIELD = "NetPayoutYield"
    EQUITY_ISSUANCE = "EquityIssuance"
    ASSET_GROWTH = "AssetGrowth"
    BOOK_GROWTH = "BookValueGrowth"
    CAPEX_GROWTH = "CapExGrowth"
    EARNINGS_GROWTH = "EarningsGrowth"
    FIXED_ASSETS_GROWTH = "FixedAssetsGrowth"
    NET_DEBT_GROWTH = "NetDebtGrowth"
    EARNINGS_TO_PRICE = "EarningsToPrice"
    SALES_TO_EV = "SalesToEV"
    SALES_TO_PRICE = "SalesToPrice"
    BOOK_TO_PRICE = "BookToPrice"
    EBITDA_TO_EV = "EBITDAToEV"
    FCF_TO_EV = "FreeCashFlowToEV"


VALUATION = (Ratio.EARNINGS_TO_PRICE, Ratio.SALES_TO_EV, Ratio.SALES_TO_PRICE, Ratio.BOOK_TO_PRICE, Ratio.EBITDA_TO_EV, Ratio.FCF_TO_EV)
PROFITABILITY = (Ratio.ROA, Ratio.ROE, Ratio.ROIC, Ratio.GROSS_MARGIN, Ratio.OPERATING_MARGIN, Ratio.NET_MARGIN)
PAYOUT = (Ratio.NET_PAYOUT_YIELD, Ratio.EQUITY_ISSUANCE)
TINY = 1e-10
MARKET_CAP = "market_cap"

#: ratio -> (numerator, denominator): s: sums over a year, l: a year ago, g: growth over a year, c: now.
RULES = {
    Ratio.ROA: ("s:netIncome", "l:totalAssets"),
    Ratio.ROE: ("s:netIncome", "l:totalStockholderEquity"),
    Ratio.ROIC: ("taxed", "l:netInvestedCapital"),
    Ratio.GROSS_MARGIN: ("s:grossProfit", "s:totalRevenue"),
    Ratio.OPERATING_MARGIN: ("s:ebit", "s:totalRevenue"),
    Ratio.NET_MARGIN: ("s:netIncome", "s:totalRevenue"),
    Ratio.FCF_YIELD: ("s:freeCashFlow", "cap"),
    Ratio.CASH_FLOW_MARGIN: ("s:freeCashFlow", "s:totalRevenue"),
    Ratio.CASH_FLOW_TO_INCOME: ("s:freeCashFlow", "s:netIncome"),
    Ratio.NET_PAYOUT_YIELD: ("payout", "cap"),
    Ratio.EQUITY_ISSUANCE: ("g:commonStockSharesOutstanding", None),
    Ratio.ASSET_GROWTH: ("g:totalAssets", None),
    Ratio.BOOK_GROWTH: ("g:totalStockholderEquity", None),
    Ratio.CAPEX_GROWTH: ("g:capitalExpenditures", None),
    Ratio.EARNINGS_GROWTH: ("gs:netIncome", None),
    Ratio.FIXED_ASSETS_GROWTH: ("g:propertyPlantEquipment", None),
    Ratio.NET_DEBT_GROWTH: ("g:netDebt", None),
    Ratio.EARNINGS_TO_PRICE: ("s:netIncome", "cap"),
    Ratio.SALES_TO_EV: ("s:totalRevenue", "ev"),
    Ratio.SALES_TO_PRICE: ("s:totalRevenue", "cap"),
    Ratio.BOOK_TO_PRICE: ("c:totalStockholderEquity", "cap"),
    Ratio.EBITDA_TO_EV: ("s:ebitda", "ev"),
    Ratio.FCF_TO_EV: ("s:freeCashFlow", "ev"),
}


def reported(statements: DataFrame, calendar: DataFrame, symbols: DataFrame, delay: int = 1) -> DataFrame:
    """Statements (symbol, report_date, items) on the monthly spine, known `delay` months after their month end.

    Of two reports of a month the later one holds, item by item; months beyond the calendar are dropped.
    """
    from .panel import dense

    items = [c for c in statements.columns if c not in ("symbol", "report_date")]
    month = F.last_day(F.add_months(month_end(F.col("report_date")), delay)).alias("date")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("report_date"))).alias(c)
    return dense(statements.groupBy("symbol", month).agg(*[latest(c) for c in items]), calendar, symbols)


def yearly(x: Column, periods: int, least: int = 4) -> Column:
    return w.rolling_sum(x, periods, least, fill=False)


def with_ratios(panel: DataFrame, names=tuple(Ratio), periods: int = 12, use_dividends: bool = False) -> DataFrame:
    """The dense panel (items and market_cap) with a column for each named ratio.

    Growth bridges gaps between values. All windows share one partitioning and order.
    """
    unknown = [n for n in names if n not in RULES]
    if unknown:
        raise ValueError(f"no ratio {unknown[0]!r}")
    parts = {p for n in names for p in RULES[n] if p}
    if "taxed" in parts:
        parts |= {"s:ebit", "s:incomeTaxExpense", "s:incomeBeforeTax"}
    made: dict[str, Column] = {}
    payout = F.col("dividendsPaid" if use_dividends else "netIncome") - F.col("salePurchaseOfStock")
    first, filled, grown = {}, {}, {}
    for part in sorted(parts):
        how, _, item = part.rpartition(":")
        if how in ("s", "gs"):
            first[f"_s_{item}"] = yearly(F.col(item), periods)
        elif how == "l":
            first[f"_l_{item}"] = w.shift(F.col(item), periods)
        if how in ("g", "gs"):
            source = F.col(f"_s_{item}") if how == "gs" else F.col(item)
            filled[f"_f_{part[:-len(item) - 1]}_{item}"] = w.fill_inside(source)
            grown[part] = f"_f_{part[:-len(item) - 1]}_{item}"
    if "payout" in parts:
        first["_payout"] = yearly(payout, periods)
    panel = panel.withColumns(first) if first else panel
    panel = panel.withColumns(filled) if filled else panel
    growths = {f"_g{k}": w.rolling_return(F.col(c), periods) for k, c in enumerate(grown.values())}
    panel = panel.withColumns(growths) if growths else panel
    names_of = dict(zip(grown, growths, strict=True))

    def value(part: str) -> Column:
        if part in names_of:
            return F.col(names_of[part])
        if part == "cap":
            return F.col(MARKET_CAP)
        if part == "ev":
            return F.col(MARKET_CAP) + F.col("longTermDebt") + F.col("shortTermDebt") - F.col("cashAndEquivalents")
        if part == "payout":
            return F.col("_payout")
        if part == "taxed":
            return F.col("_s_ebit") * (1 - F.try_divide(F.col("_s_incomeTaxExpense"), F.col("_s_incomeBeforeTax") + TINY))
        how, _, item = part.partition(":")
        return F.col(item) if how == "c" else F.col(f"_{how}_{item}")

    for name in names:
        top, bottom = RULES[name]
        made[str(name)] = value(top) if bottom is None else F.try_divide(value(top), value(bottom) + TINY)
    helpers = [*first, *filled, *growths]
    return panel.withColumns(made).drop(*helpers)
