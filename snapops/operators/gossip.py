"""What the nodes of a ring say about each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapops.schemas import STATUS_DOCUMENT_JSON

MAX_OBSERVERS = 3


def observer_view(documents: DataFrame) -> DataFrame:
    """Owner address and liveness each status document gives for its row's ``token``.

    A document that cannot be read or does not know the token makes its observer unreachable.
    """
    status = F.from_json("document", STATUS_DOCUMENT_JSON)
    parsed = documents.withColumn("s", status).withColumn(
        "ip", F.try_element_at("s.tokenToEndpointMap", F.col("token"))
    )
    live = F.array_contains("s.live", F.col("ip"))
    reachable = F.col("ip").isNotNull() & live.isNotNull()
    return parsed.withColumns(
        {"live": F.when(reachable, live), "reachable": reachable, "ip": F.when(reachable, F.col("ip"))}
    ).drop("s", "document")


#: A token number may be in use in several applications, and its dc decides who is asked.
KEY = ["app", "dc", "token"]


def eligible_observations(observations: DataFrame, tokens: DataFrame) -> DataFrame:
    """Observations of each ``(app, dc, token)`` by other instances of the same application and dc.

    ``observations(app, token, observer_token, observer_dc, …)`` holds what was asked; nothing
    is paired up here beyond the dcs a token is asked for in.
    """
    other = F.lower("token") != F.lower("observer_token")
    met = observations.filter(other).join(tokens.select(*KEY).distinct(), ["app", "token"])
    return met.filter(F.lower("observer_dc") == F.lower("dc"))


def gossip_consensus(observations: DataFrame, order: str = "seq") -> DataFrame:
    """Verdict per token from ``(app, dc, token, ip, live, reachable, seq)``, the eligible observations.

    Between one and three observers must agree, three when there are that many. The first
    reachable ones in the given order are asked. The rank keeps three rows per token on both
    sides of the shuffle, so a token with very many observers costs no more than others.
    """
    counts = observations.groupBy(*KEY).agg(F.count(F.lit(1)).alias("eligible"))
    first = Window.partitionBy(*KEY).orderBy(order)
    asked = (
        observations.filter("reachable")
        .select(*KEY, order, "ip", "live")
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= MAX_OBSERVERS)
    )
    heard = F.sort_array(F.collect_list(F.struct("rank", "ip", "live")))
    heard = asked.groupBy(*KEY).agg(heard.alias("heard"))
    joined = counts.join(heard, KEY, "left")
    needed = F.greatest(F.lit(1), F.least(F.lit(MAX_OBSERVERS), F.col("eligible"))).cast("int")
    used = F.slice(F.coalesce("heard", F.array().cast("array<struct<rank:int,ip:string,live:boolean>>")), 1, needed)
    judged = joined.withColumns({"needed": needed, "used": used})
    claim = F.try_element_at("used", F.lit(1))
    judged = judged.withColumn("claim", claim).withColumn(
        "other",
        F.try_element_at(
            F.filter(
                "used",
                lambda o: (F.lower(o["ip"]) != F.lower(F.col("claim.ip"))) | (o["live"] != F.col("claim.live")),
            ),
            F.lit(1),
        ),
    )
    status = (
        F.when(F.col("other").isNotNull(), "MISMATCH")
        .when(F.size("used") == F.col("needed"), "GOOD")
        .otherwise("UNREACHABLE_NODES")
    )
    told = F.when(F.col("other").isNotNull() & ~F.col("claim.live"), F.col("other")).otherwise(F.col("claim"))
    return judged.withColumns({"status": status, "told": told}).select(
        *KEY, "status", F.col("told.ip").alias("ip"), F.col("told.live").alias("live")
    )


def replace_ip_existing(tokens: DataFrame, consensus: DataFrame) -> DataFrame:
    """Address to replace for each dead token ``(app, dc, token, registry_ip)`` a node may claim."""
    joined = tokens.join(consensus, KEY, "left")
    unheard = F.coalesce("status", F.lit("UNREACHABLE_NODES")) == "UNREACHABLE_NODES"
    ip = F.when(unheard, F.col("registry_ip")).when(
        (F.col("status") == "GOOD") & ~F.col("live"), F.col("ip")
    )
    return joined.select(*KEY, F.coalesce("status", F.lit("UNREACHABLE_NODES")).alias("status"), ip.alias("replace_ip"))


def replace_ip_assigned(
    tokens: DataFrame, consensus: DataFrame, permit_mismatch: bool = False
) -> DataFrame:
    """Address to replace for each token already assigned to a node with its own addresses.

    ``tokens(app, dc, token, host_ip, private_ip)``. A token others see alive, or disagree about unless
    permitted, is an error: the node has to wait.
    """
    joined = tokens.join(consensus, KEY, "left")
    good = F.coalesce("status", F.lit("UNREACHABLE_NODES")) == "GOOD"
    foreign = (F.col("ip") != F.col("host_ip")) & (F.col("ip") != F.col("private_ip"))
    error = F.when(good & foreign & F.col("live"), "owner_alive")
    if not permit_mismatch:
        error = F.coalesce(error, F.when(F.col("status") == "MISMATCH", "gossip_mismatch"))
    ip = F.when(good & foreign & ~F.col("live"), F.col("ip"))
    return joined.select(
        *KEY,
        F.coalesce("status", F.lit("UNREACHABLE_NODES")).alias("status"),
        ip.alias("replace_ip"),
        error.alias("error"),
    )


def ring_status(
    owners: DataFrame, states: DataFrame, loads: DataFrame, places: DataFrame, ownership: DataFrame
) -> DataFrame:
    """Status table of a ring, one row per token.

    ``owners(app, token, endpoint)``, ``states(app, endpoint, state)`` with the lists an
    endpoint is on, ``loads(app, endpoint, load)``, ``places(app, endpoint, dc, rack)`` and
    ``ownership(app, endpoint, owned)``. Ownership is looked up by endpoint.
    """
    key = ["app", "endpoint"]

    def on(name: str):
        return F.coalesce(F.max(F.col("state") == name), F.lit(False)).alias(name)

    lists = ["live", "unreachable", "joining", "leaving", "moving"]
    flags = states.groupBy(*key).agg(*[on(name) for name in lists])
    joined = (
        owners.join(flags, key, "left")
        .join(loads, key, "left")
        .join(places, key, "left")
        .join(ownership, key, "left")
    )
    up = F.when(F.col("live"), "Up").when(F.col("unreachable"), "Down").otherwise("?")
    state = (
        F.when(F.col("joining"), "Joining")
        .when(F.col("leaving"), "Leaving")
        .when(F.col("moving"), "Moving")
        .otherwise("Normal")
    )
    owns = F.format_string("%.2f%%", F.bround(F.coalesce("owned", F.lit(0.0)) * 100, 2))
    return joined.select(
        *key,
        F.coalesce("dc", F.lit("Unknown")).alias("dc"),
        F.coalesce("rack", F.lit("Unknown")).alias("rack"),
        up.alias("status"),
        state.alias("state"),
        F.coalesce("load", F.lit("?")).alias("load"),
        owns.alias("owns"),
        "token",
    )
