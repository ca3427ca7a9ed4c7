"""Addresses against a table of networks, by one equality join for all prefix lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.functions.net import digits, prefix


def network_table(networks: DataFrame, cidr: str = "cidr") -> DataFrame:
    """`networks` with version, bits and start of each network; text that is no network is left out.

    Host bits may be set, and an address without a length stands for itself.
    """
    address, length = f"split_part(`{cidr}`, '/', 1)", f"split_part(`{cidr}`, '/', 2)"
    rows = networks.withColumns({"__four": F.expr(digits(address, 4)), "__six": F.expr(digits(address, 6))})
    most = "CASE WHEN __four IS NOT NULL THEN 32 WHEN __six IS NOT NULL THEN 128 END"
    rows = rows.withColumn("bits", F.expr(f"CASE WHEN contains(`{cidr}`, '/') THEN CASE WHEN {length} RLIKE '^[0-9]{{1,3}}$' THEN int({length}) END ELSE {most} END"))
    rows = rows.where(f"bits <= {most}").withColumn("version", F.expr("IF(__four IS NOT NULL, 4, 6)"))
    return rows.withColumn("start", F.expr(prefix("coalesce(__four, __six)", "bits"))).drop("__four", "__six")


def in_networks(events: DataFrame, address: str, networks: DataFrame, cidr: str = "cidr") -> DataFrame:
    """Every event with every network its address lies in: the columns of both, and `bits`.

    An address becomes one key for each prefix length in use, 162 at most, so the cost of an event does
    not depend on the number of networks. Addresses that are none match nothing.
    """
    table = network_table(networks, cidr)
    used = sorted((r["version"], r["bits"]) for r in table.select("version", "bits").distinct().collect())  # 33 + 129 at most
    keys = []
    for version, name in ((4, "__four"), (6, "__six")):
        each = ", ".join(f"named_struct('version', {v}, 'bits', {bits}, 'start', {prefix(name, str(bits))})" for v, bits in used if v == version)
        if each:
            keys.append(f"CASE WHEN {name} IS NOT NULL THEN array({each}) END")
    if not keys:
        keys = ["CAST(NULL AS ARRAY<STRUCT<version:INT,bits:INT,start:STRING>>)"]
    addressed = events.withColumns({"__four": F.expr(digits(f"`{address}`", 4)), "__six": F.expr(digits(f"`{address}`", 6))})
    keyed = addressed.select(*events.columns, F.explode_outer(F.expr(f"coalesce({', '.join(keys)})")).alias("__k"))
    left = keyed.select(*events.columns, *[F.col(f"__k.{c}").alias(f"__{c}") for c in ("version", "bits", "start")])
    on = (F.col("__version") == F.col("version")) & (F.col("__bits") == F.col("bits")) & (F.col("__start") == F.col("start"))
    return left.join(table, on).drop("__version", "__bits", "__start", "version", "start")


def longest_network(events: DataFrame, by: list[str], address: str, networks: DataFrame, network_id: str, cidr: str = "cidr") -> DataFrame:
    """Per event (`by`) the smallest network its address lies in, the least id of several: by, network_id, bits.

    Equal networks are one before the join, so an event finds one for each prefix length at most, however many
    networks there are.
    """
    same = network_table(networks.select(network_id, cidr), cidr).groupBy("version", "bits", "start")
    least = same.agg(F.max_by(F.struct(network_id, cidr), F.struct(-F.col(network_id))).alias("__n"))
    found = in_networks(events.select(*by, address), address, least.select(f"__n.{network_id}", f"__n.{cidr}"), cidr)
    best = F.max_by(F.struct(network_id, "bits"), F.struct("bits", -F.col(network_id))).alias("__n")
    return found.groupBy(*by).agg(best).select(*by, f"__n.{network_id}", "__n.bits")
