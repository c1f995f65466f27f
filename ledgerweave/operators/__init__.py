"""Joins, windows, arithmetic, choice, explanations, scores and the audit log."""
