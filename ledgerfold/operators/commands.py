"""The store's two command surfaces as transformations from commands to replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.text import json_string, number_text, reply_bulk, reply_integer, reply_simple
from ledgerfold.operators.fold import fold


def _shown(digits: int | None) -> Column:
    return F.col("value_after") if digits is None else F.round("value_after", digits)


def web_replies(commands: DataFrame, digits: int | None = None) -> DataFrame:
    """``(lsn, method, key, status, body)`` of requests on single keys.

    ``commands``: ``lsn, method, key, value``, methods GET, PUT, DELETE and INCR (a
    step posted to a key). A PUT answers 201 if it creates and 204 if it updates, GET and DELETE
    of an absent key 404, an empty key 404 for all but INCR. Bodies are JSON where the reply has any.
    Held numbers are shown whole, or rounded to so many ``digits``.
    """
    op = F.create_map(F.lit("GET"), F.lit("read"), F.lit("PUT"), F.lit("put"), F.lit("DELETE"), F.lit("delete"), F.lit("INCR"), F.lit("incr"))[F.col("method")]
    done = fold(commands.where("key <> ''").withColumn("op", op))
    ok = F.when(F.col("method") == "PUT", F.when(F.col("live"), 204).otherwise(201)).when(F.col("method") == "DELETE", F.when(F.col("live"), 204).otherwise(404))
    ok = ok.when(F.col("method") == "GET", F.when(F.col("live"), 200).otherwise(404)).otherwise(200)
    body = F.concat(F.lit('{"key": '), json_string(F.col("key")), F.lit(', "value": '), number_text(_shown(digits)), F.lit("}"))
    replies = done.select("lsn", "method", "key", ok.alias("status"), F.when(ok == 200, body).alias("body"))
    bad = commands.where("key IS NULL OR key = ''").select("lsn", "method", "key", F.lit(404).alias("status"), F.lit(None).cast("string").alias("body"))
    return replies.unionByName(bad)


def wire_replies(commands: DataFrame, digits: int | None = None) -> DataFrame:
    """``(lsn, command, key, reply)`` of wire commands on single keys: SET, GET, DEL, EXISTS, INCR, INCRBY, DECR, DECRBY.

    ``commands``: ``lsn, command, key, value`` (the value set, or the step). INCR
    answers with the fraction cut off, while GET shows the number that is held. Any other command is an error reply.
    Held numbers are shown whole, or rounded to so many ``digits``.
    """
    c = F.upper("command")
    op = F.when(c == "SET", "put").when(c.isin("GET", "EXISTS"), "read").when(c == "DEL", "delete").when(c.isin("INCR", "INCRBY", "DECR", "DECRBY"), "incr")
    step = F.when(c == "INCR", 1.0).when(c == "DECR", -1.0).when(c == "DECRBY", -F.col("value")).otherwise(F.col("value"))
    done = fold(commands.withColumns({"op": op, "value": step}).where("op IS NOT NULL"))
    hit = F.col("live").cast("long")
    reply = F.when(c == "SET", reply_simple(F.lit("OK"))).when(c == "GET", reply_bulk(number_text(_shown(digits)))).when(c.isin("DEL", "EXISTS"), reply_integer(hit)).otherwise(reply_integer(_shown(digits)))
    known = done.select("lsn", "command", "key", reply.alias("reply"))
    other = commands.withColumn("op", op).where("op IS NULL").select("lsn", "command", "key", F.concat(F.lit("-ERR unknown command '"), c, F.lit("'\r\n")).alias("reply"))
    return known.unionByName(other)
