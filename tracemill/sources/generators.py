"""Generators: times, overlays of invented entities, and whole invented logs.

Every choice is drawn from SHA-256 of a seed and the thing's name, so a log is
the same in every run, on any number of executors, and in other engines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .adapters import drawn


def fraction(*parts: Column) -> Column:
    """A number of [0, 1), in steps of 2**-48."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 12), 16, 10).cast("double") / float(16**12)


@dataclass(frozen=True)
class TimeModel:
    """When workflows begin and how long turns wait: seconds, hours, days."""

    start: int = 1_767_225_600
    days: int = 14
    center: int = 14
    spread: float = 6.0
    jitter_minutes: int = 30
    low: int = 20
    p50: int = 90
    p90: int = 600
    burst: float = 0.6


def timed_turns(turns: DataFrame, model: TimeModel = TimeModel(), seed: int = 7) -> DataFrame:
    """``workflow``, ``request_id``, ``turn`` with ``second``: a normal hour of the day, a jitter, then waits that add up.

    A wait is between ``low`` and ``p50`` in a burst, else between ``p50`` and
    ``p90``.  Running sums go over the turns of a workflow.
    """
    s = F.lit(str(seed))
    w = F.col("workflow")
    normal = F.sqrt(-2 * F.log(1 - fraction(s, w, F.lit("u")))) * F.cos(2 * F.lit(3.141592653589793) * fraction(s, w, F.lit("v")))
    hour = F.greatest(F.lit(0), F.least(F.lit(23), F.floor(F.lit(float(model.center)) + normal * (model.spread / 2)).cast("int")))
    begin = F.lit(model.start) + drawn(model.days, s, w, F.lit("day")) * 86_400 + hour * 3_600 + drawn(model.jitter_minutes + 1, s, w, F.lit("jitter")) * 60
    key = (s, w, F.col("turn").cast("string"))
    wait = F.when(fraction(*key, F.lit("burst")) < model.burst, F.lit(model.low) + drawn(model.p50 - model.low + 1, *key, F.lit("short"))).otherwise(F.lit(model.p50) + drawn(model.p90 - model.p50 + 1, *key, F.lit("long")))
    order = Window.partitionBy("workflow").orderBy("turn", "request_id")
    each = turns.withColumn("first", F.row_number().over(order) == 1).withColumn("wait", F.when(F.col("first"), 0).otherwise(wait))
    return each.withColumn("second", (begin + F.sum("wait").over(order)).cast("long")).drop("first", "wait")


def overlay_entities(workflow: Column, users: int = 24, projects: int = 9, orgs: int = 3, seed: int = 7) -> Column:
    """The invented user, project, organisation and tools of a workflow."""
    s = F.lit(str(seed))
    user = drawn(users, s, workflow, F.lit("user"))
    project = drawn(projects, s, user.cast("string"), F.lit("project"))
    org = project % orgs
    name = lambda kind, n: F.concat(F.lit(kind), F.lpad(n.cast("string"), 3, "0"))
    tool = F.element_at(F.array(*map(F.lit, ("pytest", "npm test", "cargo test", "go test"))), (drawn(4, s, project.cast("string"), F.lit("tool")) + 1).cast("int"))
    return F.struct(name("user", user).alias("user_id"), name("project", project).alias("project_id"), name("org", org).alias("org_id"), tool.alias("tool"))


def overlay(rows: DataFrame, profile_rate: float = 0.3, environment_rate: float = 0.7, seed: int = 7) -> DataFrame:
    """Requests as if invented users had sent them: repositories and workspaces renamed, and messages that tell of the user put in.

    ``rows``: ``request_id``, ``workflow``, ``messages``.  The environment
    message comes with the given rate a request, the profile with its rate a
    workflow.  Adds ``user_id``, ``project_id``, ``org_id``; null contents stay.
    """
    out = rows.withColumn("e", overlay_entities(F.col("workflow"), seed=seed))
    repo = F.concat(F.col("e.org_id"), F.lit("/"), F.col("e.project_id"))
    slug = F.concat(F.lit("/workspace/"), F.col("e.org_id"), F.lit("__"), F.col("e.project_id"))
    rename = lambda c: F.regexp_replace(F.regexp_replace(c, F.lit(r"\brepository=[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+"), F.concat(F.lit("repository="), repo)), F.lit(r"/workspace/[A-Za-z0-9_.-]+"), slug)
    kind = "struct<role:string,content:string,name:string>"
    message = lambda name, content: F.struct(F.lit("tool").alias("role"), content.alias("content"), F.lit(name).alias("name")).cast(kind)
    environment = message("environment", F.concat(F.lit("cwd="), slug, F.lit("; runner_home=/home/"), F.col("e.user_id"), F.lit("; preferred_check="), F.col("e.tool")))
    profile = message("profile", F.concat(F.lit("account_cache="), F.col("e.org_id"), F.lit(":acct:"), F.col("e.user_id")))
    s = F.lit(str(seed))
    put = F.array_compact(F.array(F.when(fraction(s, F.col("request_id"), F.lit("environment")) < environment_rate, environment), F.when(fraction(s, F.col("workflow"), F.lit("profile")) < profile_rate, profile)))
    renamed = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), rename(m["content"]).alias("content"), m["name"].alias("name")).cast(kind))
    return out.withColumn("messages", F.concat(put, F.coalesce(renamed, F.array().cast(f"array<{kind}>")))).select("*", "e.user_id", "e.project_id", "e.org_id").drop("e")


def generated_log(spark: SparkSession, workflows: int, turns: int = 6, noise: float = 0.05, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """An invented log and its truth: workflows of invented users, each request with all earlier messages, and unrelated requests among them."""
    s = F.lit(str(seed))
    base = spark.range(workflows).select(F.format_string("wf_%08d", "id").alias("workflow"))
    turn = base.select("workflow", F.explode(F.sequence(F.lit(1), F.lit(turns))).alias("turn")).withColumn("request_id", F.format_string("%s_%03d", F.col("workflow"), F.col("turn")))
    task = F.element_at(F.array(*map(F.lit, ("fix the failing test", "add an option", "rename a module", "speed up the build"))), (drawn(4, s, F.col("workflow"), F.lit("task")) + 1).cast("int"))
    number = F.format_string("case-%06d", drawn(1_000_000, s, F.col("workflow"), F.lit("case")))
    file = lambda i: F.format_string("src/part_%02d.py", drawn(40, s, F.col("workflow"), i.cast("string"), F.lit("file")))
    kind = "struct<role:string,content:string,name:string>"
    msg = lambda role, content, name=None: F.struct(F.lit(role).alias("role"), content.alias("content"), F.lit(name).cast("string").alias("name")).cast(kind)
    first = msg("user", F.concat(F.lit("repository=own/repo "), task, F.lit(" for "), number))
    later = F.flatten(F.transform(F.sequence(F.lit(1), F.col("turn")), lambda i: F.when(i > 1, F.array(msg("assistant", F.concat(F.lit("I will look at "), file(i))), msg("tool", F.concat(F.lit("/workspace/own__repo/"), file(i), F.lit(" changed")), "read_file"))).otherwise(F.array().cast(f"array<{kind}>"))))
    rows = overlay(turn.withColumn("messages", F.concat(F.array(first), later)), seed=seed)
    rows = timed_turns(rows, seed=seed)
    odd = fraction(s, F.col("request_id"), F.lit("noise")) < noise
    rows = rows.withColumn("messages", F.when(odd, F.array(msg("user", F.concat(F.lit("an unrelated question, "), F.col("request_id"))))).otherwise(F.col("messages")))
    log = rows.select("request_id", F.date_format(F.timestamp_seconds("second"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "messages", F.concat(F.lit("cache_"), F.col("org_id")).alias("cache_bucket"))
    truth = rows.select("request_id", "org_id", "user_id", "project_id", F.when(odd, F.col("request_id")).otherwise(F.col("workflow")).alias("workflow_id"), F.col("turn").alias("turn_id"))
    return log, truth


def exchangeable_features(features: DataFrame, groups: int) -> DataFrame:
    """Feature rows in which ``groups`` sessions of a block look alike: what tells them apart is that of the group's first one."""
    own = F.regexp_extract("truth_session", r"(\d+)$", 1).cast("long")
    first = F.floor(own / groups) * groups
    alike = F.transform("identifiers", lambda v: F.when(F.startswith(v, F.lit("case-")), F.concat(F.lit("case-"), F.lpad(first.cast("string"), 8, "0"), F.regexp_extract(v, r"^case-\d+(.*)$", 1))).otherwise(v))
    moved = F.col("minute") - own * 200 % 9_000 + first * 200 % 9_000
    return features.withColumn("minute", moved).withColumn("identifiers", alike).withColumn("shingles", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.xxhash64(first, i)))
