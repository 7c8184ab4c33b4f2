"""The demo charges and the template of an upload."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The demo charges: (first id, names, amounts, first month, day, code), a charge a month.
SERIES = [
    ("t001", ["NETFLIX.COM 866-579-7172", "NETFLIX.COM", "NFLX DIGITAL", "Netflix.com", "NETFLIX LOS GATOS CA"], [15.49] * 5, "2025-11", 1, None),
    ("t010", ["ADOBE CREATIVE CLOUD"] * 4, [19.99, 19.99, 19.99, 59.99], "2025-11", 15, None),
    ("t020", ["CANVA"] * 4, [12.99, 12.99, 12.99, 119.99], "2025-10", 20, None),
    ("t040", ["SPOTIFY USA", "SPOTIFY", "Spotify Premium", "SPOTIFY USA"], [10.99, 10.99, 10.99, 11.18], "2025-11", 10, None),
    ("t050", ["VERIZON WIRELESS"] * 4, [85.00, 87.50, 86.00, 145.00], "2025-11", 3, "4814"),
    ("t060", ["PG&E AUTOPAY"] * 7, [95.00, 90.00, 92.00, 185.00, 190.00, 188.00, 210.00], "2025-07", 15, "4900"),
    ("t070", ["GITHUB"] * 4, [4.00, 4.00, 4.00, 21.00], "2025-11", 22, "7372"),
    ("t080", ["GEICO INSURANCE"] * 4, [120.00, 120.00, 120.00, 138.00], "2025-11", 1, "6300"),
]
#: Two charges of one payee on each day, the first of them always the same amount.
PAIRS = ("t030", "APPLE.COM/BILL", 2.99, [9.99, 9.99, 9.99, 14.99], "2025-11", 5)
# Names as they arrive in practice.
NOISY = [
    ("n001", "NETFLX", 15.49, "2026-04-01"),
    ("n002", "Netflx.com 866-579-7172", 15.49, "2026-05-01"),
    ("n003", "SPOTIFY-USA*REF99921", 11.18, "2026-04-10"),
    ("n004", "PG E AUTOPAY", 205.00, "2026-01-15"),
    ("n005", "ATT WIRELESS 8004310023", 95.00, "2026-04-05"),
    ("n006", "TOTALLY UNKNOWN VENDOR", 4.99, "2026-04-20"),
    ("n007", "Totally Unknown Vendor", 4.99, "2026-05-20"),
    ("n008", "totally-unknown vendor", 4.99, "2026-06-20"),
]
# The template: header, and (name, amounts, first month, day).
TEMPLATE_HEADER = "transaction_id,merchant_raw,amount,date,category_mcc,currency"
TEMPLATE_SERIES = [
    ("NETFLIX.COM", [15.49, 15.49, 15.49, 15.49, 59.99], "2025-11", 1),
    ("ADOBE CREATIVE CLOUD", [19.99, 19.99, 19.99, 59.99], "2025-11", 15),
    ("SPOTIFY USA", [10.99, 10.99, 11.18], "2025-11", 10),
]
SCHEMA = "transaction_id string, merchant_raw string, amount double, date date, category_mcc string"


def month_after(first: str, n: int, day: int) -> dt.date:
    year, month = map(int, first.split("-"))
    return dt.date(year + (month - 1 + n) // 12, (month - 1 + n) % 12 + 1, day)


def rows(noisy: bool = True) -> list[tuple]:
    """The demo charges in the order of their ids, the noisy ones last."""
    out = [(f"t{int(start[1:]) + n:03d}", name, amount, month_after(first, n, day), code) for start, names, amounts, first, day, code in SERIES for n, (name, amount) in enumerate(zip(names, amounts, strict=True))]
    start, name, low, highs, first, day = PAIRS
    out += [(f"t{int(start[1:]) + 2 * n + k:03d}", name, amount, month_after(first, n, day), None) for n, high in enumerate(highs) for k, amount in enumerate((low, high))]
    return sorted(out) + [(i, name, amount, dt.date.fromisoformat(day), None) for i, name, amount, day in NOISY] * noisy


def charges(spark, noisy: bool = True) -> DataFrame:
    """The demo charges as :func:`ledgerlight.sources.ingest.typed` gives them."""
    data = [(*r, n) for n, r in enumerate(rows(noisy), 1)]
    none = F.lit(None).cast("string")
    df = spark.createDataFrame(data, SCHEMA + ", seq bigint")
    return df.select("transaction_id", "merchant_raw", "amount", "date", F.lit("USD").alias("currency"), "category_mcc", none.alias("payment_method"), none.alias("description"), "seq")


def template() -> str:
    """A CSV to fill in, with examples."""
    lines = [(name, amount, month_after(first, n, day)) for name, amounts, first, day in TEMPLATE_SERIES for n, amount in enumerate(amounts)]
    return "\n".join([TEMPLATE_HEADER, *(f"demo-{k:03d},{name},{amount},{day},," for k, (name, amount, day) in enumerate(lines, 1))]) + "\n"
