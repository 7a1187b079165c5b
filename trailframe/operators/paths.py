"""Least-cost paths of many requests at once over a table of edges, as rounds of joins (RTE-05).

Each round joins the reached (request, node) with the edges that leave it, keeps the least cost a request and node by a
hashed aggregate, and goes on with what became cheaper. Where the edges are few, each task holds them all and the rows of its
requests, and only the reached nodes are shuffled. Written tables compress well and look small to Spark, so that those which
grow are joined by merging: a broadcast of them takes the driver's memory. Predecessors are taken once, from the costs at the end. A node whose cost, plus the least cost that the air distance
to its target allows, is above the cost already found for the target is left out of the frontier.
Requests of the same ends are best asked as one (``searches``), so that the reached nodes grow with the different ends only.
Rounds are as many as the longest cheapest path has edges; all requests share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..sources.shared import Rounds

KEY = ["request_id", "node"]
#: Edges that every task may hold; more are dealt out by their start.
FEW_EDGES = 200_000


def searches(requests: DataFrame) -> DataFrame:
    """``(request_id, search_id, src, dst)``: requests from one place to another share one search, named by the smallest of them."""
    known = requests.dropna(subset=["request_id", "src", "dst"]).select("request_id", "src", "dst")
    return known.join(known.groupBy("src", "dst").agg(F.min("request_id").alias("search_id")).hint("merge"), ["src", "dst"]).select("request_id", "search_id", "src", "dst")


def usable(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """``(src, dst, cost)``, written: the cheapest of parallel edges, of those that some search may take.

    An edge that starts where no edge ends and no request begins is on no path.
    """
    spark = edges.sparkSession
    known = edges.dropna(subset=["src", "dst", "cost"]).filter("src <> dst").select("src", "dst", F.col("cost").cast("long").alias("cost"))
    begins = Rounds(spark, "begins").next(edges.select(F.col("dst").alias("src")).union(requests.select("src")).dropna().distinct())
    begins = begins.hint("broadcast" if begins.count() <= FEW_EDGES else "merge")
    return Rounds(spark, "edges").next(known.join(begins, "src", "left_semi").groupBy("src", "dst").agg(F.min("cost").alias("cost")))


def least_costs(edges: DataFrame, requests: DataFrame, nodes: DataFrame | None = None, cost_per_m: float = 0.0) -> DataFrame:
    """``(request_id, node, cost, prev)`` of the nodes that the search of each request has reached.

    ``edges (src, dst, cost)`` have whole costs of 0 or more, the cheapest of parallel ones counts, and ones with a null are
    left out; ``requests (request_id, src, dst)`` have unique ids. Costs of a target, and of all nodes on its path, are least ones; among
    equal ones ``prev`` is the smallest node. With ``nodes (node, lat, lon)`` and the least ``cost_per_m`` of any edge, the air
    distance bounds the search. A request whose source or target no edge touches reaches its source only.
    """
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = Rounds(spark, "requests").next(requests.dropna(subset=["request_id", "src", "dst"]).select("request_id", "src", "dst"))
    cheapest = usable(edges, asked).withColumnRenamed("cost", "step")
    few = cheapest.count() <= FEW_EDGES
    target = asked.select("request_id", F.col("src").alias("origin"), F.col("dst").alias("target"))
    if nodes is not None and cost_per_m > 0:
        at = lambda key, name: nodes.dropna().select(F.col("node").alias(key), F.struct("lat", "lon").alias(name))
        cheapest = cheapest.join(at("dst", "here").hint("merge"), "dst", "left").select("src", "dst", "step", "here")
        target = target.join(at("target", "there").hint("merge"), "target", "left")
        air = haversine_m(F.col("here.lat"), F.col("here.lon"), F.col("there.lat"), F.col("there.lon"))
        # a little less, so that rounding cuts no cheapest path off
        bound = F.coalesce(F.floor(air * cost_per_m * (1 - 1e-9)).cast("long"), F.lit(0).cast("long"))
    else:
        bound = F.lit(0).cast("long")
    target = Rounds(spark, "targets").next(target)
    # each start leads to itself as well, so that one join gives what is reached and what was there
    stay = cheapest.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(0).cast("long").alias("step"))
    dealt = Rounds(spark, "dealt").next(cheapest.unionByName(stay, allowMissingColumns=True))
    dealt = dealt.hint("broadcast" if few else "merge")
    itself = F.col("dst").isNull() | (F.col("dst") == F.col("node"))

    def onward(state: DataFrame, going: Column) -> DataFrame:
        """The rows of ``state``, and those that edges lead to from the ones ``going`` on and that may be on a path to the target."""
        goal = target.join(state.select("request_id", F.col("node").alias("target"), F.col("cost").alias("most")).hint("merge"), ["request_id", "target"], "left").drop("target")
        rows = (state.repartition(parts, "request_id") if few else state).join(goal.hint("merge"), "request_id")
        rows = rows.join(dealt, (F.col("node") == F.col("src")) & (going | (F.col("src") == F.col("dst"))), "left").withColumn("sum", F.col("cost") + F.coalesce("step", F.lit(0)))
        return rows.filter(itself | F.col("most").isNull() | (F.col("sum") + bound <= F.col("most")))

    rounds = Rounds(spark, "costs")
    state = rounds.next(asked.select("request_id", F.col("src").alias("node"), F.lit(0).cast("long").alias("cost"), F.lit(True).alias("open")))
    while not state.filter("open").isEmpty():
        reached = onward(state, F.col("open")).select("request_id", F.coalesce("dst", "node").alias("to"), "sum", F.when(itself, F.col("cost")).alias("had"))
        best = reached.groupBy("request_id", F.col("to").alias("node")).agg(F.min("sum").alias("cost"), F.min("had").alias("had"))
        state = rounds.next(best.select(*KEY, "cost", (F.col("had").isNull() | (F.col("cost") < F.col("had"))).alias("open")))
    # of the ways of the least cost, that from the smallest node
    way = F.when(~itself & (F.col("dst") != F.col("origin")), F.struct("sum", F.col("node").alias("prev")))
    best = onward(state, F.lit(True)).groupBy("request_id", F.coalesce("dst", "node").alias("node")).agg(F.min(F.when(itself, F.col("cost"))).alias("cost"), F.min(way).alias("way"))
    best = best.filter("cost IS NOT NULL").select(*KEY, "cost", F.when(F.col("way.sum") == F.col("cost"), F.col("way.prev")).alias("prev"))
    return Rounds(spark, "least-costs").next(best)


def paths(costs: DataFrame, requests: DataFrame) -> DataFrame:
    """``(request_id, place, node, cost)``: the nodes of each request's path from its source on; none for a target out of reach.

    Predecessors 1, 2, 4 ... steps back are looked up by doubling, so the rounds are the logarithm of the longest path.
    """
    spark = costs.sparkSession
    # nodes beyond the target are on no path to it
    most = requests.select("request_id", F.col("dst").alias("node")).join(costs.hint("merge"), KEY).select("request_id", F.col("cost").alias("most"))
    jumps = [costs.filter("prev IS NOT NULL").join(most.hint("merge"), "request_id").filter("cost <= most").select(*KEY, F.col("prev").alias("back"))]
    kept = Rounds(spark, "jumps", keep=1 << 30)
    while True:
        jumps[-1] = kept.next(jumps[-1])
        far = jumps[-1].select("request_id", F.col("node").alias("back"), F.col("back").alias("farther"))
        farther = jumps[-1].join(far.hint("merge"), ["request_id", "back"]).select(*KEY, F.col("farther").alias("back"))
        if farther.isEmpty():
            break
        jumps.append(farther)
    ends = requests.select("request_id", F.col("dst").alias("node")).join(costs.select(*KEY).hint("merge"), KEY)
    found = ends.withColumn("left", F.lit(0).cast("long"))
    for k in range(len(jumps) - 1, -1, -1):
        found = found.unionByName(found.join(jumps[k].hint("merge"), KEY).select("request_id", F.col("back").alias("node"), (F.col("left") + (1 << k)).alias("left")))
    length = found.groupBy("request_id").agg(F.max("left").alias("length"))
    placed = found.join(length.hint("merge"), "request_id").select("request_id", (F.col("length") - F.col("left")).alias("place"), "node")
    return placed.join(costs.select(*KEY, "cost").hint("merge"), KEY).select("request_id", "place", "node", "cost")
