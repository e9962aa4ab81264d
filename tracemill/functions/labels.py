"""Labels that may be missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a missing label.
MISSING_WORDS = ("", "none", "null", "unknown", "n/a")

#: Fixed value: the label of a missing cache bucket.
CACHE_UNAVAILABLE = "cache_unavailable"


def present(label: Column) -> Column:
    """Trimmed label, or null where it is null, blank or a word for none."""
    t = F.trim(label)
    return F.when(F.lower(t).isin(*MISSING_WORDS), None).otherwise(t)


def bucket_or_unavailable(bucket: Column) -> Column:
    """The bucket as written; ``cache_unavailable`` where null or blank."""
    return F.coalesce(F.when(F.trim(bucket) != "", bucket), F.lit(CACHE_UNAVAILABLE))
