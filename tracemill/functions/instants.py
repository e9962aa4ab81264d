"""Instants from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE_TIME = r"^\d{4}-\d{1,2}-\d{1,2}[Tt ]\d{1,2}:\d{2}(:\d{2}([.,]\d+)?)?\s*([Zz]|UTC|[+-]\d{2}(:?\d{2})?)?$"


def instant_millis(text: Column) -> Column:
    """Milliseconds since 1970 (UTC) of an ISO-8601 date-time, else null.

    Reads ``T``, ``t`` or a blank before the time, a fraction of any length
    (cut to milliseconds), and a zone as ``Z``, ``+hh:mm``, ``+hhmm`` or
    ``+hh``; without a zone the session's zone holds.  Null, blank, date-only
    and unreadable texts give null, whatever the ANSI mode.
    """
    t = F.trim(text)
    t = F.when(t.rlike(_DATE_TIME), t)
    t = F.regexp_replace(t, r"\s*[Zz]$", "Z")
    t = F.regexp_replace(t, r"\s*UTC$", "Z")
    t = F.regexp_replace(t, r"\s*([+-]\d{2})$", "$1:00")
    t = F.regexp_replace(t, r"\s*([+-]\d{2})(\d{2})$", "$1:$2")
    t = F.regexp_replace(t, r"[t ]", "T")
    t = F.regexp_replace(t, r"(:\d{2})[.,](\d{1,6})\d*", "$1.$2")
    return F.unix_millis(F.try_to_timestamp(t))
