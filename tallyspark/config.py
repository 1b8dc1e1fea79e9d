"""Settings of the statement operators, and the fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

# Header words by role, in the order in which roles are given out.
ROLE_PRIORITY = ("date", "reference", "debit", "credit", "balance", "narration")
VOCABULARY = {
    "date": ("date", "txn date", "transaction date", "value date", "posting date", "tran date", "dt"),
    "narration": ("narration", "description", "particulars", "details", "remarks", "transaction details", "particuler", "detail"),
    "debit": ("debit", "withdrawal", "withdrawals", "dr", "paid out", "money out", "amount dr", "debit amount", "withdraw", "debits", "debit(dr)"),
    "credit": ("credit", "deposit", "deposits", "cr", "received", "money in", "amount cr", "credit amount", "credits", "credit(cr)"),
    "balance": ("balance", "closing balance", "available balance", "running balance", "bal", "balance (cr/dr)", "net balance", "outstanding balance"),
    "reference": ("reference", "ref no", "ref", "chq no", "cheque no", "utr", "transaction id", "txn id", "instrument no", "chq/ref", "reference no", "ref number"),
}


@dataclass(frozen=True)
class Settings:
    """Everything the pipeline can be tuned by; the defaults are the documented behaviour."""

    min_confidence: float = 0.30
    row_eps: float = 0.012
    header_rows: int = 6
    continuation_gap: float = 0.025
    column_eps: float = 0.025
    column_min_samples: int = 2
    column_support: int = 3
    boundary_padding: float = 0.015
    near_zone: float = 0.05
    fuzzy: bool = True
    fuzzy_threshold: float = 75.0
    date_before: float = 0.25
    narration_wider: float = 0.15
    tolerance: float = 0.01
    raise_by: float = 0.15
    lower_by: float = 0.20
    repair: bool = False
    max_pages: int = 0
    vocabulary: dict = field(default_factory=lambda: dict(VOCABULARY))
