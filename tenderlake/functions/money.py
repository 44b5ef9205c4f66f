"""Amounts of money, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def loose_number(text: Column) -> Column:
    """The first signed number of a text, commas removed."""
    return F.regexp_extract(F.regexp_replace(text, ",", ""), r"(-?[0-9]+(\.[0-9]+)?)", 1).try_cast("double")


def money(text: Column, currency: str = "PHP") -> Column:
    """The amount of a text such as ``PHP 1,234.50``; null if there is none."""
    plain = F.trim(F.regexp_replace(text, f"(?i){currency}", ""))
    return F.regexp_replace(F.regexp_extract(plain, r"([0-9][0-9,]*(\.[0-9]{1,2})?)", 1), ",", "").try_cast(MONEY)


def strict_centavos(text: Column, currency: str = "PHP") -> Column:
    """``PHP 1,234.50`` in exactly this form as whole centavos."""
    ok = text.rlike(rf"^{currency} [0-9]{{1,3}}(,[0-9]{{3}})*\.[0-9]{{2}}$")
    return F.when(ok, F.regexp_replace(text, "[^0-9]", "").try_cast("long"))


def format_money(amount: Column, currency: str = "PHP") -> Column:
    """Two decimals and commas."""
    return F.concat(F.lit(f"{currency} "), F.format_number(amount.cast(MONEY), 2))


def same_money(a: Column, b: Column) -> Column:
    """Equality of amounts by value, so that 80,000 and 80,000.00 agree."""
    return F.coalesce(money(a) == money(b), F.lit(False))
