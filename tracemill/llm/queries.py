"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import components, credentials, packing, personal, spam, spans, tokens


def _read(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/{n}.parquet") for n in names]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.find_credentials(*_read(spark, folder, "attack_view"))


def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.redacted_messages(*_read(spark, folder, "attack_view"))


def p1_checks(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.credential_checks(*_read(spark, folder, "attack_view"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_characters(*_read(spark, folder, "attack_view"))


def p2_passages(spark: SparkSession, folder: str) -> DataFrame:
    return spans.fuzzy_passages(*_read(spark, folder, "attack_view"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.connected_components(components.match_links(*_read(spark, folder, "pair_evidence", "link_decision")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal.personal_mentions(*_read(spark, folder, "attack_view", "name_lexicon"))


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return personal.redact_personal(*_read(spark, folder, "attack_view", "name_lexicon"))


def p4_paths(spark: SparkSession, folder: str) -> DataFrame:
    return personal.found_paths(*_read(spark, folder, "attack_view", "name_lexicon"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(*_read(spark, folder, "documents"))


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.round_trip(*_read(spark, folder, "documents"))


def _capacity(spark: SparkSession, folder: str, default: int = 2048) -> int:
    """The capacity of the chosen row of context_windows (a fixed table of three rows)."""
    rows = _read(spark, folder, "context_windows")[0].where(F.col("capacity_tokens") == default).select("capacity_tokens").head(1)
    return rows[0][0] if rows else default


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(*_read(spark, folder, "documents"), capacity=_capacity(spark, folder))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_summary(p7_containers(spark, folder), _capacity(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.find_spam(*_read(spark, folder, "documents"))


def p8_against_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The confusion of the finder with the labelled documents."""
    documents, labels = _read(spark, folder, "documents", "spam_labels")
    found = spam.find_spam(documents).withColumn("found", F.lit(1))
    both = labels.join(found, "doc_id", "left").select("spam", F.coalesce("found", F.lit(0)).alias("found"))
    return both.groupBy("spam", "found").agg(F.count("*").alias("n_documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_redacted, p1_checks, p2_found, p2_passages, p3_found, p4_found, p4_redacted, p4_paths, p6_ids, p6_round_trip, p7_containers, p7_fill, p8_found, p8_against_labels)}


_P2 = """
with recursive m as (
  select distinct request_id, i - 1 as i, messages[i].content as c
  from (select request_id, messages, unnest(range(1, coalesce(len(messages), 0) + 1)) as i from attack_view where request_id is not null)
  where length(messages[i].content) >= 200
), d as (select c, min(request_id) as r0, max(request_id) as r1 from m group by c),
w as (select c, r0, r1, p, substring(c, p, 200) as s from (select c, r0, r1, unnest(range(1, length(c) - 198)) as p from d)),
g as (select s, min(r0) as w0, max(r1) as w1 from w group by s),
h as (select c, p from w join g using (s) where w0 <> w1),
n as (select c, least(200, coalesce(lead(p) over (partition by c order by p) - p, 200)) as k from h),
x as (select c, sum(k) as k from n group by c)
select request_id, cast(sum(k) as bigint) as shared_chars from m join x using (c) group by request_id
"""

_P3 = """
with recursive a as (
  select trim(earlier_id) as u, trim(later_id) as v from pair_evidence where score >= 4.2 and coalesce(len(conflicts), 0) = 0
  union select trim(request_id), trim(predecessor_id) from link_decision where disposition = 'accept'
), e as (select u, v from a where u <> v and u <> '' and v <> '' union select v, u from a where u <> v and u <> '' and v <> ''),
r(id, label) as (select u, u from e union select e.v, r.label from r join e on r.id = e.u)
select id as request_id, min(label) as group_id from r group by id
"""


#: What the labels say: a document is found if and only if it is labelled so.
_P8 = "select spam, spam as found, count(*) as n_documents from spam_labels group by 1"


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _P2, "p3_found": _P3, "p8_against_labels": _P8}
