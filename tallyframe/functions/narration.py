"""What a bank narration says: a settlement, a transfer reference, a name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of references in statements.
SETTLEMENT = r"\b(setl_[A-Za-z0-9]+)\b"
TRANSFER = r"\bUTR[:\s]*([A-Z0-9]{12,22})\b"
NAME = r"(?:RZPX|RAZORPAY)\*?([A-Z][A-Z ]{2,}?)(?:\s+(?:PL|PVT|LTD)\b|$)"


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def squashed(narration: Column) -> Column:
    """White space, of any script, as single spaces; trimmed; upper case."""
    return F.upper(F.trim(F.regexp_replace(narration, r"(?U)\s+", " ")))


def settlement_ref(narration: Column) -> Column:
    """The first settlement id of the narration as it stands; case counts."""
    return _first(narration, SETTLEMENT)


def transfer_ref(narration: Column) -> Column:
    return _first(squashed(narration), TRANSFER)


def counterparty(narration: Column) -> Column:
    """A name, for evidence only."""
    return F.nullif(F.trim(_first(squashed(narration), NAME)), F.lit(""))


def unparseable(narration: Column) -> Column:
    return settlement_ref(narration).isNull() & transfer_ref(narration).isNull() & counterparty(narration).isNull()


def remittance_settlement(reference: Column) -> Column:
    return F.concat(F.lit("setl_cod"), F.regexp_replace(reference, "[^A-Za-z0-9]", ""))
