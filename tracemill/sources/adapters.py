"""Adapters and generators: trajectories, patches and synthetic workloads to the request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Key names by which a role or a content may be given.
ROLE_NAMES = {"human": "user", "customer": "user", "ai": "assistant", "agent": "assistant", "gpt": "assistant", "function": "tool", "observation": "tool", "environment": "tool", "developer": "system"}


def drawn(k: int, *parts: Column) -> Column:
    """A number from 0 to k - 1 by SHA-256 of the parts: random, but the same in every run and engine."""
    return (F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 12), 16, 10).cast("long") % k).cast("long")


def normal_role(role: Column) -> Column:
    r = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    out = F.when(r.isin("system", "user", "assistant", "tool"), r)
    for given, meant in ROLE_NAMES.items():
        out = out.when(r == given, meant)
    return out.otherwise("user")


def turns_from_trajectories(rows: DataFrame, id_col: str, messages: str, policy: Column, start: Column, step_seconds: int = 45, jitter: int = 16, seed: int = 7) -> DataFrame:
    """One request before each assistant message that has prior context.

    Messages are the policy as system message and all earlier messages;
    instants are ``start`` (seconds) plus a step a turn plus a hashed jitter.
    """
    m = F.transform(messages, lambda x: F.struct(normal_role(x["role"]).alias("role"), F.coalesce(x["content"], F.lit("")).alias("content"), x["name"].alias("name")))
    each = rows.select(F.col(id_col).cast("string").alias("workflow_id"), policy.alias("policy"), start.cast("long").alias("start"), m.alias("m")).select("*", F.posexplode("m").alias("pos", "x"))
    turns = each.where((F.col("x.role") == "assistant") & (F.col("pos") > 0))
    turn = F.row_number().over(Window.partitionBy("workflow_id").orderBy("pos"))
    system = F.struct(F.lit("system").alias("role"), F.substring("policy", 1, 3000).alias("content"), F.lit(None).cast("string").alias("name"))
    second = F.col("start") + step_seconds * (F.col("turn_id") - 1) + drawn(jitter, F.lit(str(seed)), F.col("workflow_id"), F.col("turn_id").cast("string"))
    return turns.withColumn("turn_id", turn).select(
        F.format_string("%s_%03d", F.col("workflow_id"), F.col("turn_id")).alias("request_id"), "workflow_id", "turn_id",
        F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.concat(F.array(system), F.slice("m", F.lit(1), F.col("pos"))).alias("messages"),
    )


def spread_turns(positions: Column, most: int = 12) -> Column:
    """At most ``most`` of an array's values, evenly spread, the first one kept."""
    n = F.size(positions)
    picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(positions, F.floor(i * n / most).cast("int")))
    return F.when(n <= most, positions).otherwise(F.array_distinct(picked))


def first_per_group(rows: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def repair_workflow(issue: Column, patch: Column, repo: Column) -> Column:
    """The message array of a four-turn repair: task, reading, patch, check."""
    msg = lambda role, content, name=None: F.struct(F.lit(role).alias("role"), content.alias("content"), F.lit(name).cast("string").alias("name"))
    return F.array(msg("user", F.concat(F.lit("repository="), repo, F.lit("\n"), issue)), msg("assistant", F.lit("I will read the failing module first.")), msg("tool", F.concat(F.lit("read "), repo), "read_file"), msg("assistant", F.lit("I will apply a small patch.")), msg("tool", patch, "apply_patch"), msg("assistant", F.lit("I will run the focused check.")), msg("tool", F.lit("1 passed"), "run_tests"), msg("assistant", F.lit("The check passes.")))


def synthetic_features(spark: SparkSession, blocks: int, per_block: int, collide: bool = False) -> DataFrame:
    """Feature rows of invented sessions of four requests, one block per bucket, without texts: fixtures of linkage at any size.

    Sessions share shingles and identifiers, projects a repository, users an
    account; with ``collide`` two users of a block share a user name.
    """
    n = blocks * per_block
    base = spark.range(n).select(F.col("id"), F.floor(F.col("id") / per_block).alias("b"), F.floor(F.col("id") / 4).alias("s"), (F.col("id") % 4).alias("t"))
    user = F.floor(F.col("s") / 5)
    name = F.when(F.lit(collide), F.floor(user / 2)).otherwise(user)
    f = lambda fmt, *c: F.format_string(fmt, *c)
    none = F.array().cast("array<string>")
    return base.select(
        f("req_%08d", F.col("id")).alias("request_id"), (F.col("b") * 10_000 + F.col("s") * 200 % 9_000 + F.col("t") * 3).cast("long").alias("minute"), f("bucket_%05d", F.col("b")).alias("bucket"), F.lit(100).alias("token_count"),
        F.array(f("repo_full:owner%06d/repo", F.floor(F.col("s") / 10)), f("repo_owner:owner%06d", F.floor(F.col("s") / 10)), f("case-%08d-alpha.core", F.col("s")), f("case-%08d-beta.core", F.col("s"))).alias("identifiers"),
        none.alias("paths"), none.alias("domains"), none.alias("traces"), F.array(f("user%06d", name)).alias("usernames"),
        F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.xxhash64(F.col("s"), i)).alias("shingles"), none.alias("signatures"), F.lit("tool").alias("tool_fp"), F.lit("system").alias("system_fp"),
        f("session_%08d", F.col("s")).alias("truth_session"), f("user_%06d", user).alias("truth_user"),
    )


def replay(rows: DataFrame, copies: int, spacing_ms: int) -> DataFrame:
    """Copies of a log with new request ids and moved instants, for scale runs."""
    n = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    out = rows.withColumn("copy", n)
    return out.withColumn("request_id", F.concat(F.col("request_id"), F.lit("#"), F.col("copy").cast("string"))).withColumn("ms", F.col("ms") + F.col("copy") * spacing_ms).drop("copy")


def monotone_times(rows: DataFrame, group: str, order: str, second: str) -> DataFrame:
    """Instants of a group made strictly increasing: at least one second after the one before."""
    w = Window.partitionBy(group).orderBy(order, "request_id")
    rn = F.row_number().over(w)
    ranked = rows.withColumn("_rn", rn)
    return ranked.withColumn(second, F.max(F.col(second) - F.col("_rn")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_rn")).drop("_rn")


def snapshot(rows: DataFrame, first: int | None = None, until_ms: int | None = None) -> DataFrame:
    """The first requests by instant, or those up to an instant; ``first`` is the feature, so it limits."""
    kept = rows if until_ms is None else rows.where(F.col("ms") <= until_ms)
    return kept if first is None else kept.orderBy(F.col("ms").asc_nulls_last(), "request_id").limit(first)
