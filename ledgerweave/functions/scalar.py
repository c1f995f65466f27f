"""Column functions on money, dates, references and narrations. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerweave.config import ACTIONS

#: The date formats, in the order in which they are tried, each with the digits it takes.
DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
)
#: The usual shapes, which are read without further ado.
PLAIN_AMOUNT, PLAIN_DATE = r"^-?\d{1,15}\.\d{2}\z", r"^(?!0000)\d{4}-\d{2}-\d{2}\z"


def to_paise(c: Column) -> Column:
    """Rupee text to whole paise; fractions beyond two digits are cut; null where the text is no amount.

    Null, blank and the texts -, nan and None are 0.
    """
    text = F.trim(F.translate(F.trim(F.coalesce(c, F.lit(""))), ",₹", ""))
    number = F.regexp_replace(text, r"^[+-]+", "")
    whole = F.substring_index(number, ".", 1)
    cents = F.rpad(F.substring(F.regexp_extract(number, r"\.(\d*)$", 1), 1, 2), 2, "0")
    value = F.when(whole == "", F.lit(0)).otherwise(whole.try_cast("bigint")) * 100 + cents.try_cast("bigint")
    return (
        F.when(c.rlike(PLAIN_AMOUNT), F.translate(c, ".", "").try_cast("bigint"))
        .when(text.isin("", "-", "nan", "None"), F.lit(0).cast("bigint"))
        .when(number.rlike(r"^\d*(\.\d*)?$"), F.when(text.startswith("-"), -value).otherwise(value).cast("bigint"))
    )


def parse_date(c: Column) -> Column:
    """First of the formats that fits; null where none does."""
    text = F.trim(c)
    plain = F.when(text.rlike(PLAIN_DATE), text.try_cast("date"))
    return F.coalesce(plain, *[F.when(text.rlike(shape), F.try_to_date(F.initcap(text), form)) for shape, form in DATE_FORMATS])


def extract_utrs(c: Column) -> Column:
    """All runs of exactly 12 or 16 digits, repeats kept."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<!\d)(\d{12}|\d{16})(?!\d)"), 1)


def is_gateway(c: Column, tokens=("RAZORPAY", "RZP")) -> Column:
    return F.upper(F.coalesce(c, F.lit(""))).rlike("|".join(tokens))


def net_paise(kind: Column, gross: Column, fee: Column, tax: Column) -> Column:
    return F.when(kind == "refund", -F.abs(gross)).otherwise(gross - fee - tax)


def signed_paise(credit: Column, debit: Column) -> Column:
    return credit - debit


def is_credit(credit: Column) -> Column:
    return credit > 0


def format_inr(c: Column) -> Column:
    """₹1,23,456.78: the sign first, then groups of two digits before the last three."""
    size = F.abs(c)
    digits = F.call_function("div", size, F.lit(100)).cast("string")
    head = F.regexp_replace(F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 3, F.lit(0))), r"(?<=\d)(?=(\d{2})+$)", ",")
    tail = F.right(digits, F.lit(3))
    grouped = F.when(F.length(digits) > 3, F.concat(head, F.lit(","), tail)).otherwise(digits)
    return F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), F.lit("₹"), grouped, F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


def clean_text(c: Column, default: str | None = None) -> Column:
    """Trimmed; blank becomes null or the default."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def collision_risk(hypotheses: Column, spread: Column) -> Column:
    """Rough chance that a search of so many hypotheses hits an amount by luck."""
    return F.when(spread <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), hypotheses.cast("double") / spread))


def collision_risk_sql(hypotheses: str, spread: str) -> str:
    """The same as an SQL text, for projections of many columns."""
    return f"CASE WHEN {spread} <= 0 THEN 1.0D ELSE least(1.0D, CAST({hypotheses} AS DOUBLE) / ({spread})) END"


def exception_action(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])[c]


def reason_text(label: Column, risk: Column, delta: Column) -> Column:
    return F.concat(
        label,
        F.when(risk != 0, F.format_string(", collision risk %.1e", risk))
        .when(delta != 0, F.format_string(", delta %dp", delta)).otherwise(F.lit("")),
    )
