"""Digests of message prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def message_digest(m: Column) -> Column:
    """SHA-256 of role, name and content; null parts are told from empty ones, and parts can't run into each other."""
    part = lambda c: F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(part(m["role"]), part(m["name"]), part(m["content"])), 256)


def prefix_digests(messages: Column) -> Column:
    """One digest for each prefix of the messages, by a chain: each is that of the one before it and of its message.

    Equal digests mean equal prefixes, whatever the request.  Every content is
    read once.  Null and empty messages give the digest of nothing.
    """
    nothing = F.sha2(F.lit(""), 256)
    chain = lambda acc, m: F.concat(acc, F.array(F.sha2(F.concat(F.coalesce(F.get(acc, F.size(acc) - 1), nothing), message_digest(m)), 256)))
    return F.when(F.coalesce(F.size(messages), F.lit(0)) <= 0, F.array(nothing)).otherwise(F.aggregate(messages, F.array().cast("array<string>"), chain))
