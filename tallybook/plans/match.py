"""Three-way match of transactions, processor reports and bank statements over a period."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.operators.joins import FULL_CHAIN, chain_match
from tallybook.operators.projections import date_window
from tallybook.operators.stats import recon_summary
from tallybook.sources.files import write_summary


class Matched(NamedTuple):
    matches: DataFrame
    exceptions: DataFrame
    summary: DataFrame


def match_sources(
    trm: DataFrame,
    mpr: DataFrame,
    bank: DataFrame,
    keys: Mapping[str, str],
    amounts: Mapping[str, str],
    date_column: str,
    start: dt.date,
    end: dt.date,
    tolerance: float = 0.0,
    medium: float = 1_000.0,
    high: float = 10_000.0,
    summary_path: str | None = None,
    hot_rows: int | None = None,
    mpr_date: str | None = None,
    bank_date: str | None = None,
    margin_days: int = 0,
    orphans: bool = False,
) -> Matched:
    """Match the transactions of a period; the rows that are no full chain are the exceptions.

    With their date columns given, processor and bank rows count only within the period widened by
    ``margin_days`` on both sides.  ``orphans`` adds rows of theirs that no transaction of the widened period has.
    """
    first, last = (day + dt.timedelta(days=sign * margin_days) for day, sign in ((start, -1), (end, 1)))
    if mpr_date is not None:
        mpr = date_window(mpr, mpr_date, first, last)
    if bank_date is not None:
        bank = date_window(bank, bank_date, first, last)
    window = date_window(trm, date_column, start, end)
    claims = date_window(trm, date_column, first, last) if orphans else None
    matches = chain_match(window, mpr, bank, keys, amounts, tolerance, hot_rows, orphans, claims)
    full = F.col("level") == FULL_CHAIN
    summary = recon_summary(matches, full, amounts["trm"], "level", medium, high)
    if summary_path is not None:
        write_summary(summary, summary_path)
    return Matched(matches, matches.where(~full), summary)
