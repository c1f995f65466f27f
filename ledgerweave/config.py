"""Policy settings of a reconciliation."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ReconcileConfig:
    date_window_days: int = 3
    amount_tolerance_paise: int = 1_000
    subset_safe_rows: int = 20
    max_collision_risk: float = 0.02
    max_complement_drop: int = 3
    adjudicate: bool = True
    gateway_tokens: tuple[str, ...] = ("RAZORPAY", "RZP")


#: Tiers in the order in which they are tried, and the confidence of a match.
EXACT, FUZZY, ARITHMETIC, ADJUDICATED, EXCEPTION = "tier1_exact", "tier2_fuzzy", "tier3_subset_sum", "tier4_adjudicated", "tier5_exception"
CONFIDENCE = {EXACT: 0.99, FUZZY: 0.90, ARITHMETIC: 0.85}

#: What an operator is told to do about each type of exception.
ACTIONS = {
    "orphan_credit": "Trace credit to a non-gateway source (direct transfer, refund reversal).",
    "missing_in_bank": "Settlement reported but not yet credited. Re-run after the next bank feed.",
    "amount_mismatch": "Candidate found but amounts differ beyond tolerance. Check fees and refunds.",
    "ambiguous_candidates": "Several equally valid matches. Needs a human decision.",
    "duplicate_utr": "Two settlements share one UTR. Confirm with the gateway.",
    "malformed_row": "Row failed parsing and was quarantined. Fix the source file.",
    "chargeback_debit": "Debit line, not a settlement credit. Route to the disputes workflow.",
    "no_candidate": "No settlement rows in the window come close. Widen the window or check the report.",
    "arithmetic_unsafe": "Pool too large for an exact sum to be evidence. Supply settlement ids or narrow the date window.",
}

#: Reasons that are shown with results.
REASONS = {
    "exact": "UTR and exact net total agree",
    "fuzzy": "single group within tolerance",
    "chargeback_debit": "debit line; belongs to the disputes workflow, not settlement",
    "orphan_credit": "narration names no gateway; looks like a direct transfer, not a settlement",
    "arithmetic_unsafe": "candidate pool too large for an exact sum to be evidence; declined rather than guessed",
    "missing_in_bank": "settlement rows are all claimed; nothing left this credit could be",
    "no_candidate": "no settlement rows in the window account for this amount",
    "ambiguous_candidates": "%d candidates, none separable on the evidence",
    "sole": "sole candidate within tolerance",
    "closer": "clearly closer on amount and date",
    "equal": "candidates are equally supported; leaving for a human",
}
