"""Names, labels and codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: letters with accents and their base letters
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
BASE = "aaaaaaceeeeiiiinooooouuuuyy"


# fixed values: the punctuation that becomes blanks
def crop_name_a(c: Column) -> Column:
    """Lower case, punctuation to blanks, blanks collapsed."""
    s = F.regexp_replace(F.lower(c), r"[(){}\[\],;:.\-/]", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def crop_name_b(c: Column) -> Column:
    """Accents stripped, non-word characters to blanks, lower case; null is empty."""
    s = F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTED, BASE)
    s = F.regexp_replace(s, r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def number(c: Column) -> Column:
    """Text to double, null when it is not a number."""
    return c.try_cast("double")


def product_date(uri: Column) -> Column:
    """Acquisition date from the third field of a product identifier."""
    return F.try_to_timestamp(F.substring(F.split(uri, "_")[2], 1, 8), F.lit("yyyyMMdd")).cast("date")


def product_tile(uri: Column) -> Column:
    return F.split(uri, "_")[5]


def product_granule(uri: Column) -> Column:
    return F.split(F.element_at(F.split(uri, "_"), -1), r"\.")[0]


def stars(p: Column) -> Column:
    """Significance stars of a p value."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "")
