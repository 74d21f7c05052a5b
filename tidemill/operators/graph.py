"""Transfers as a graph: edges, degrees, pass-through accounts, closed circuits, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.exprs import within
from tidemill.operators.history import DAY_US, asof_forward
from tidemill.operators.ranged import group_quantiles
from tidemill.session import materialize


def edges(rows: DataFrame, source: str, target: str, code: str, ts: str, amount: str, keep=None) -> DataFrame:
    """(code, src, dst, ts, amount) of the rows with both ends (and ``keep``)."""
    there = rows.filter(F.col(source).isNotNull() & (F.coalesce(F.col(target), F.lit("")) != ""))
    if keep is not None:
        there = there.filter(keep)
    return there.select(F.col(code).alias("code"), F.col(source).alias("src"), F.col(target).alias("dst"), F.col(ts).alias("ts"), F.col(amount).alias("amount"))


def sizes(e: DataFrame) -> DataFrame:
    """One row: nodes and (parallel) edges."""
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.crossJoin(e.agg(F.count(F.lit(1)).alias("edges")))  # one row each


def degree(e: DataFrame, of: str, other: str, name: str, nulls: bool = True) -> DataFrame:
    """Distinct neighbours on one side: pairs are made distinct first, so no task counts a hub's edges. ``nulls``: NULL is a neighbour."""
    e = e if nulls else e.filter(F.col(other).isNotNull())
    return e.select(of, other).distinct().groupBy(F.col(of).alias("node")).agg(F.count(F.lit(1)).alias(name))


def top(rows: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    """A top-k report with a stable order."""
    return rows.orderBy(F.desc(by), tie).limit(k)


def pass_through(features: DataFrame, account: str, ratio: str, delay: str, band=(0.7, 1.3), most_minutes: float = 30) -> DataFrame:
    """Per account: rows, quick pass-throughs, their rate, the exact median delay, and ``rate * log1p(n)``."""
    quick = (within(F.col(ratio), *band) & within(F.col(delay), 0, most_minutes)).cast("int")
    slim = features.select(F.col(account).alias("node"), quick.alias("__q"), F.col(delay).alias("__d"))
    counted = materialize(slim.groupBy("node", "__d").agg(F.count(F.lit(1)).alias("__n"), F.sum("__q").alias("__q")), "delays")
    per = counted.groupBy("node").agg(F.sum("__n").alias("n_rows"), F.sum("__q").alias("n_quick"))
    delays = group_quantiles(counted.filter("__d is not null").select("node", "__d", "__n"), ["node"], "__d", "__n", 0.5, "median_delay").withColumnRenamed("node", "__node")
    rate = F.col("n_quick") / F.col("n_rows")
    joined = per.join(delays, F.col("node").eqNullSafe(F.col("__node")), "left").drop("__node")
    return joined.withColumn("quick_rate", rate).withColumn("score", rate * F.log1p(F.col("n_quick").cast("double")))


def closed_circuits(e: DataFrame, most_days: int = 7, most_per_pair: int = 50) -> DataFrame:
    """(code_out, code_back, a, b, ts_out, ts_back, amount_out): A pays B, and the pair's next payment goes back in time.

    Ordered pairs of more than ``most_per_pair`` payments are no circuits by definition and
    leave before anything is sorted, which also bounds the groups. Of tied next payments
    the one of the least code is taken.
    """
    few = e.groupBy("src", "dst").count().filter(F.col("count") <= most_per_pair).drop("count")
    kept = e.join(few, ["src", "dst"]).withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    nxt = asof_forward(kept, ["a", "b"], "ts", "code", most_days * DAY_US, {"code_back": "code", "src_back": "src", "ts_back": "ts"})
    return nxt.filter((F.col("src_back") == F.col("dst")) & (F.col("src") != F.col("dst"))).select(
        F.col("code").alias("code_out"), "code_back", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("ts").alias("ts_out"), "ts_back", F.col("amount").alias("amount_out"))


def node_features(e: DataFrame, passing: DataFrame, circuits: DataFrame) -> DataFrame:
    """Per account: fan-in, fan-out, pass-through score, circuits (0 where there are none)."""
    fan_in = degree(e, "dst", "src", "fan_in")
    fan_out = degree(e, "src", "dst", "fan_out")
    loops = circuits.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_circuits"))
    both = fan_in.join(fan_out, "node", "full").join(passing.select("node", "n_quick", "score"), "node", "left").join(loops, "node", "left")
    filled = both.fillna(0, ["fan_in", "fan_out", "n_quick", "score", "n_circuits"])
    return filled.withColumn("in_circuit", F.col("n_circuits") > 0)


def frequent_counterparties(e: DataFrame, centres: DataFrame, per_centre: int) -> DataFrame:
    """(centre, node, n): of each centre (column ``node``) the counterparties of most edges, either way, ties by name; no centres among them.

    Pairs are counted before they are ranked, so ranks run over distinct neighbours.
    """
    c = centres.select(F.col("node").alias("centre")).distinct()
    pairs = e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    out = pairs.join(c, F.col("src") == F.col("centre")).select("centre", F.col("dst").alias("node"), "n")
    back = pairs.join(c, F.col("dst") == F.col("centre")).select("centre", F.col("src").alias("node"), "n")
    both = out.unionByName(back).groupBy("centre", "node").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("centre").orderBy(F.desc("n"), "node")
    near = both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_centre).drop("rank")
    return near.join(c.withColumnRenamed("centre", "node"), "node", "left_anti").select("centre", "node", "n")


def induced_edges(e: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """(src, dst, n): counted edges between nodes of a set, without self loops, the first ``most`` in the order of keys; isolated nodes have none."""
    some = nodes.select("node").distinct()
    inside = e.filter("src <> dst").join(some.withColumnRenamed("node", "src"), "src", "left_semi").join(some.withColumnRenamed("node", "dst"), "dst", "left_semi")
    pairs = inside.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return pairs if most is None else pairs.orderBy("src", "dst").limit(most)


def ego_sample(e: DataFrame, passing: DataFrame, circuits: DataFrame, accounts: int = 8, least_quick: int = 3, per_account: int = 2, pairs: int = 6, most: int = 300) -> DataFrame:
    """(src, dst, n): the edges among the accounts of the highest scores, their most frequent counterparties and the ends of the largest circuits."""
    centres = passing.filter(F.col("n_quick") >= least_quick).orderBy(F.desc("score"), "node").limit(accounts).select("node")
    near = frequent_counterparties(e, centres, per_account).select("node")
    ends = circuits.orderBy(F.desc("amount_out"), "code_out").limit(pairs).select(F.explode(F.array("a", "b")).alias("node"))
    return induced_edges(e, centres.unionByName(near).unionByName(ends), most)
