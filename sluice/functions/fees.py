"""Fee evidence as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks of evidence; anything else ranks as unknown.
RANKS = {"unknown": 0, "card-observed": 1, "detail-verified": 2}
DETAIL_HOST = "tenders.etimad.sa"


def normalize_digits(text: Column) -> Column:
    """Arabic-Indic digits and separators as ASCII, bidi marks removed, trimmed."""
    plain = F.translate(F.coalesce(text, F.lit("")), "٠١٢٣٤٥٦٧٨٩٫٬", "0123456789.,")
    return F.regexp_replace(F.regexp_replace(plain, "[‎‏‪-‮]", ""), r"(?U)^\s+|\s+$", "")


def fee_value(text: Column) -> Column:
    """The one non-negative amount that a text states, null if none or several."""
    plain = normalize_digits(text)
    numbers = F.transform(F.regexp_extract_all(plain, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), 1), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    distinct = F.array_distinct(numbers)
    return F.when(~plain.rlike(r"(?U)(?:^|\s)[−-]\s*\d") & (F.size(distinct) == 1), distinct[0])


def is_trusted_detail_url(url: Column) -> Column:
    """https on the portal's host, below its tender details path."""
    parts = lambda p: F.try_parse_url(url, F.lit(p))
    return F.coalesce((F.lower(parts("PROTOCOL")) == "https") & (F.lower(parts("HOST")) == DETAIL_HOST) & parts("PATH").rlike(r"(?i)^/tender/details(?:forsupplier)?(?:/|$)"), F.lit(False))


def evidence_rank(verification: Column) -> Column:
    return F.when(verification == "detail-verified", 2).when(verification == "card-observed", 1).otherwise(0)


def is_verified_free(fee: Column, verification: Column) -> Column:
    return F.coalesce((fee == 0) & (verification == "detail-verified"), F.lit(False))
