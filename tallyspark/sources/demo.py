"""A made-up ledger of a rowing club on two upright pages, as a recogniser would read it. Balances are summed, not written
down, and every other page leans a little, as scans do."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

from ..schemas import RAW_TOKENS

WIDTH, HEIGHT = 1240.0, 1754.0
PITCH, TOP, PER_PAGE = 52.0, 260.0, 8
#: Heading and left edge of each column.
COLUMNS = (("Posting Date", 70.0), ("Instrument No", 250.0), ("Details", 440.0), ("Debits", 760.0), ("Credits", 920.0), ("Running Balance", 1060.0))
START_CENTS = 91_250
#: Day, instrument, details, cents in (out, if negative).
ENTRIES = (
    ("2025-04-02", "", "Berth fees, spring", 48_000),
    ("2025-04-03", "CHQ0031170452216", "Varnish and brushes", -13_775),
    ("2025-04-05", "", "Raffle at the regatta", 20_640),
    ("2025-04-09", "CHQ0031170452217", "Trailer tyres", -25_900),
    ("2025-04-11", "", "Coaching, four evenings", -18_000),
    ("2025-04-14", "", "New members, three", 36_300),
    ("2025-04-22", "CHQ0031170452218", "Oar repair", -7_420),
    ("2025-04-28", "", "Kitchen takings", 9_385),
    ("2025-05-02", "", "Water rates", -11_260),
    ("2025-05-06", "", "Boat hire, school week", 64_500),
    ("2025-05-07", "CHQ0031170452219", "Life jackets", -40_815),
    ("2025-05-19", "", "Insurance of the boathouse", -52_190),
    ("2025-05-30", "", "Donation", 15_000),
)


def money(cents: int) -> str:
    return f"{cents / 100:,.2f}"


def demo_rows() -> list[tuple[str, ...]]:
    """The texts of each entry, column by column."""
    sums = accumulate((e[3] for e in ENTRIES), initial=START_CENTS)
    next(sums)
    return [(day, number, what, money(-c) if c < 0 else "", money(c) if c > 0 else "", money(now)) for (day, number, what, c), now in zip(ENTRIES, sums, strict=True)]


def demo_tokens(spark: SparkSession) -> DataFrame:
    """Raw token rows of the ledger, document 1."""
    rows: list[tuple] = []
    lines = demo_rows()
    for page in range(-(-len(lines) // PER_PAGE)):
        shown = [tuple(h for h, _ in COLUMNS), *lines[page * PER_PAGE : (page + 1) * PER_PAGE]]
        for n, texts in enumerate(shown):
            for k, ((_, x), text) in enumerate(zip(COLUMNS, texts, strict=True)):
                if text:
                    y = TOP + PITCH * n + (page % 2) * k
                    rows.append((1, page, 10 * n + k, text, 0.99 - 0.01 * (k % 3), x, y, x + 11.5 * len(text), y + 22, WIDTH, HEIGHT))
    return spark.createDataFrame(rows, RAW_TOKENS)
