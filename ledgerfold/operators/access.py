"""Who may do what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.text import basic_password, bearer_token, role_rank

#: Commands by the role they need; fixed values. Any other needs admin.
READS = ("PING", "GET", "EXISTS", "INFO", "DBSIZE", "SUBSCRIBE", "UNSUBSCRIBE", "AUTH")
WRITES = ("SET", "DEL", "INCR", "INCRBY", "DECR", "DECRBY", "EXPIRE", "FLUSHALL")


def role_of(secret: Column, secrets: dict[str, list[str]]) -> Column:
    """Best role that a secret opens, NULL if none; ``secrets`` lists the tokens and passwords of each role. Empty ones open nothing."""
    out = F.lit(None).cast("string")
    for role in ("reader", "writer", "admin"):
        known = [s for s in secrets.get(role, []) if s]
        out = F.when(secret.isin(known) & (secret != ""), role).otherwise(out) if known else out
    return out


def required_role(command: Column) -> Column:
    """Role that a command needs."""
    name = F.upper(command)
    return F.when(name.isin(*READS), "reader").when(name.isin(*WRITES), "writer").otherwise("admin")


def authorize(requests: DataFrame, secrets: dict[str, list[str]]) -> DataFrame:
    """``requests`` with ``role`` and ``status``: 200, 401 without a role, 403 with too low a one.

    Columns: ``authorization``, ``token``, ``password`` (headers, may be NULL) and
    ``required``. A token opens first, then a password. With no secrets set, all pass.
    """
    if not any(s for group in secrets.values() for s in group):
        return requests.withColumns({"role": F.lit("admin"), "status": F.lit(200)})
    token = F.coalesce(bearer_token(F.col("authorization")), F.nullif("token", F.lit("")))
    password = F.coalesce(basic_password(F.col("authorization")), F.nullif("password", F.lit("")))
    role = F.coalesce(role_of(token, secrets), role_of(password, secrets))
    status = F.when(F.col("role").isNull(), 401).when(role_rank(F.col("role")) < role_rank(F.col("required")), 403).otherwise(200)
    return requests.withColumn("role", role).withColumn("status", status)


def refused_on_follower(command: Column, follower: bool) -> Column:
    """Whether a follower refuses a command because it writes."""
    return F.upper(command).isin(*WRITES) & F.lit(follower)
