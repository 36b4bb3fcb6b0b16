"""Call graphs and personalised PageRank as sparse joins."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.plans.joins import small as few
from lodeline.plans.lineage import cut

# Damping, tolerance and the most iterations.
DAMPING, TOLERANCE, ITERATIONS = 0.85, 1e-6, 100
#: A residual that is not pushed on; what stays of a request's is at most this for each node that it reached.
RESIDUAL = 1e-10
#: Links of a node that travel together; steps between two written states.
_OUT, _STEPS = 1024, 4
#: Nodes, and links, of a graph that a task may hold: some 30 MB.
SMALL_GRAPH = 500_000


def call_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller_id, callee_name): distinct calls(symbol_id, name) of names that some symbol defines, without self-calls."""
    known = symbols.select(F.col("name").alias("callee_name")).distinct()
    own = symbols.select(F.col("symbol_id").alias("caller_id"), F.col("name").alias("own_name"))
    made = calls.select(F.col("symbol_id").alias("caller_id"), F.col("name").alias("callee_name")).distinct().join(known, "callee_name", "left_semi")
    return made.join(own, "caller_id").where("callee_name <> own_name").select("caller_id", "callee_name")


def called_by(edges: DataFrame) -> DataFrame:
    """(name, called_by_count): distinct callers of each name."""
    return edges.groupBy(F.col("callee_name").alias("name")).agg(F.count_distinct("caller_id").alias("called_by_count"))


def local_called_by(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, called_by_count) within one file: classes are no callers, and a callee of the caller's own class wins.

    calls: (symbol_id, name) as found in each symbol's source.
    """
    from pyspark.sql import Window as W

    caller = symbols.where("symbol_type <> 'class'").select(F.col("symbol_id").alias("caller_id"), F.col("file").alias("caller_file"), F.col("parent_class").alias("caller_class"))
    callee = symbols.select(F.col("symbol_id").alias("callee_id"), "file", "name", "parent_class", "start_line")
    met = calls.select(F.col("symbol_id").alias("caller_id"), "name").distinct().join(caller, "caller_id").join(callee, "name").where("file = caller_file and caller_id <> callee_id")
    same = F.coalesce(F.col("caller_class") == F.col("parent_class"), F.lit(False)).cast("int")
    best = met.withColumn("same", same).withColumn("best", F.max("same").over(W.partitionBy("caller_id", "name"))).where("same = best")
    return best.groupBy(F.col("callee_id").alias("symbol_id")).agg(F.count_distinct("caller_id").alias("called_by_count"))


def _by_request(nodes: DataFrame, links: DataFrame, personal: DataFrame | None, requests: DataFrame, damping: float, iterations: int, tolerance: float | None, every: int, k: int | None = None) -> DataFrame:
    """The ranks of a graph of at most SMALL_GRAPH nodes and links (those of _prepared), which every task holds as arrays: a request is a row.

    With k, only the nodes that are a request's k best by rank to 9 digits, ordinal and node leave the task.
    """
    spark = nodes.sparkSession
    found = nodes.toPandas()
    if k is not None:
        found = found.sort_values(["ordinal", "node"], ignore_index=True)
    names = pd.Index(found["node"])
    got = links.toPandas()
    held = spark.sparkContext.broadcast((names, found["size"].to_numpy(float), found["loose"].to_numpy(float), names.get_indexer(got["src"]), names.get_indexer(got["dst"]), got["share"].to_numpy()))
    asked = requests.select("request_id").distinct()
    if personal is None:
        asked = asked.withColumn("named", F.lit(None).cast(f"array<{nodes.schema['node'].dataType.simpleString()}>"))
    else:
        known = personal.join(nodes.select("node"), "node", "left_semi").groupBy("request_id").agg(F.collect_set("node").alias("named"))
        asked = asked.join(known, "request_id", "left")

    def run(frames):
        names, size, loose, src, dst, share = held.value
        n = len(names)
        anywhere = size / size.sum()
        for f in frames:
            for request, named in zip(f["request_id"], f["named"]):
                restart = anywhere
                if named is not None and len(named):
                    restart, at = np.zeros(n), names.get_indexer(list(named))
                    restart[at] = size[at] / size[at].sum()
                rank = anywhere
                for i in range(iterations):
                    old = rank
                    rank = damping * (np.bincount(dst, old[src] * share, n) + (old * loose).sum() * anywhere) + (1 - damping) * restart
                    if tolerance is not None and (i + 1) % every == 0 and np.abs(rank - old).sum() < tolerance:
                        break
                rank = rank / size
                best = slice(None) if k is None else _best(rank, k)
                yield pd.DataFrame({"request_id": request, "node": names[best], "rank": rank[best]})

    types = f"request_id {requests.schema['request_id'].dataType.simpleString()}, node {nodes.schema['node'].dataType.simpleString()}, rank double"
    if k is not None:  # few short rows of much work each: dealt out, as they would else go to one task
        asked = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return asked.mapInPandas(run, types)


def _best(rank: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest ranks, rounded to 9 digits as Spark rounds (half up, in decimal), ties by place."""
    score, scaled = np.round(rank, 9), rank * 1e9
    for i in np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5)[0]:
        score[i] = float(Decimal(repr(float(rank[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    if k < len(rank):
        among = np.nonzero(score >= np.partition(score, len(rank) - k)[len(rank) - k])[0]
    else:
        among = np.arange(len(rank))
    return among[np.argsort(-score[among], kind="stable")][:k]


def pagerank(nodes: DataFrame, edges: DataFrame, personal: DataFrame | None = None, requests: DataFrame | None = None, damping: float = DAMPING, iterations: int = ITERATIONS, tolerance: float | None = TOLERANCE, every: int = 5, small: int = SMALL_GRAPH, k: int | None = None) -> DataFrame:
    """(request_id, node, rank): weights are shares of what leaves a node, nodes without an exit give to all alike, and the walk
    restarts at personal(request_id, node), or anywhere if a request names none.

    nodes(node), edges(src, dst, weight); without `requests` there is one, numbered 0. Repeated edges add up and edges to
    unknown nodes are left out. A step is one join on the source and one aggregation by (request, node), in which what arrives
    and what every node keeps meet; every step is written, as the next reads it twice, and every few steps the driver sees one number, the largest change of any request. tolerance None: exactly `iterations` steps.
    Fewer than two nodes: no rows. A graph of at most `small` nodes and links is held by every task, which then steps alone.
    k, with nodes(node, ordinal): the rows of a request's k best at least, by rank to 9 digits, ordinal and node; others may be left out.
    Nodes may be the cells of `alike`, with its links as edges; a row's rank is then that of each of its nodes.
    """
    spark = nodes.sparkSession
    requests = spark.range(1).select(F.col("id").alias("request_id")) if requests is None else requests
    nodes, links = _prepared(nodes, edges)
    held, n = nodes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if n < 2:
        return requests.crossJoin(nodes).select("request_id", "node", F.lit(0.0).alias("rank")).limit(0)
    if held <= small and links.count() <= small:
        return _by_request(nodes, links, personal, requests, damping, iterations, tolerance, every, k)
    if tolerance is None and iterations > 1:
        return _inner_steps(nodes, links, personal, requests, damping, iterations, n)
    base = requests.select("request_id").distinct().crossJoin(nodes.select("node", "size", "loose"))
    if personal is not None:
        known = personal.join(nodes.select("node", "size"), "node").select("request_id", "node", "size").distinct()
        counts = known.groupBy("request_id").agg(F.sum("size").alias("named"))
        base = base.join(known.select("request_id", "node", F.lit(1.0).alias("hit")), ["request_id", "node"], "left").join(counts, "request_id", "left")
        restart = F.when(F.col("named").isNull(), F.col("size") / n).otherwise(F.coalesce("hit", F.lit(0.0)) * F.col("size") / F.col("named"))
    else:
        restart = F.col("size") / n
    base = cut(base.select("request_id", "node", restart.alias("restart"), "size", "loose"))
    ranks = base.withColumn("rank", F.col("size") / n)
    stay = base.select("request_id", "node", F.lit(0.0).alias("arrived"), "restart", "size", "loose")
    for i in range(iterations):
        none = [F.lit(None).cast("double").alias(c) for c in ("restart", "size", "loose")]
        moved = ranks.join(links, ranks.node == links.src).select("request_id", F.col("dst").alias("node"), (F.col("rank") * F.col("share")).alias("arrived"), *none)
        lost = ranks.groupBy("request_id").agg(F.sum(F.col("rank") * F.col("loose")).alias("lost"))
        step = moved.unionByName(stay).groupBy("request_id", "node").agg(F.sum("arrived").alias("arrived"), *[F.max(c).alias(c) for c in ("restart", "size", "loose")]).join(lost, "request_id")
        new = step.select("request_id", "node", "restart", "size", "loose", (damping * (F.col("arrived") + F.col("lost") * F.col("size") / n) + (1 - damping) * F.col("restart")).alias("rank"))
        new = cut(new)  # each step is read twice by the next one
        if (i + 1) % every == 0 and tolerance is not None:
            old = ranks.select("request_id", "node", F.col("rank").alias("old"))
            change = new.join(old, ["request_id", "node"]).groupBy("request_id").agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("c")).agg(F.max("c")).first()[0]
            if change is None or change < tolerance:
                ranks = new
                break
        ranks = new
    return ranks.select("request_id", "node", (F.col("rank") / F.col("size")).alias("rank"))


def _restart(base: DataFrame, nodes: DataFrame, personal: DataFrame | None, n: float) -> DataFrame:
    """base(request_id, node, size, ...) with the share of each request's walk that starts again at a node."""
    if personal is None:
        return base.withColumn("restart", F.col("size") / n)
    known = personal.join(nodes.select("node", "size"), "node").select("request_id", "node", "size").distinct()
    counts = known.groupBy("request_id").agg(F.sum("size").alias("named"))
    met = base.join(known.select("request_id", "node", F.lit(1.0).alias("hit")), ["request_id", "node"], "left").join(counts, "request_id", "left")
    restart = F.when(F.col("named").isNull(), F.col("size") / n).otherwise(F.coalesce("hit", F.lit(0.0)) * F.col("size") / F.col("named"))
    return met.withColumn("restart", restart).drop("hit", "named")


def _inner_steps(nodes: DataFrame, links: DataFrame, personal: DataFrame | None, requests: DataFrame, damping: float, iterations: int, n: float) -> DataFrame:
    """The ranks after a stated number of steps, where only the last step looks at nodes without an exit and at links to them.

    Ranks add up to one, so what stands at such nodes is what the others leave; all other steps take the nodes with exits alone.
    """
    asked = requests.select("request_id").distinct()
    inner = cut(_restart(asked.crossJoin(nodes.where("loose < 1").select("node", "size", "loose")), nodes, personal, n))
    between = cut(links.join(nodes.where("loose < 1").select(F.col("node").alias("dst")), "dst", "left_semi"))
    still = between.isEmpty()
    ranks = inner.withColumn("rank", F.col("size") / n)

    def stepped(ranks, links, rows):
        lost = asked.join(ranks.groupBy("request_id").agg(F.sum(F.col("rank") * (1 - F.col("loose"))).alias("kept")), "request_id", "left").select("request_id", (1 - F.coalesce("kept", F.lit(0.0))).alias("lost"))
        met = rows.join(F.broadcast(lost) if asked_few else lost, "request_id")
        if links is None:
            met = met.withColumn("arrived", F.lit(0.0))
        else:
            moved = links.join(ranks.select("request_id", F.col("node").alias("src"), "rank"), "src").groupBy("request_id", F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("arrived"))
            met = met.join(moved, ["request_id", "node"], "left")
        rank = damping * (F.coalesce("arrived", F.lit(0.0)) + F.col("lost") * F.col("size") / n) + (1 - damping) * F.col("restart")
        return met.select("request_id", "node", "size", "loose", "restart", rank.alias("rank"))

    asked_few = asked.count() <= _OUT
    for _ in range(iterations - 1):
        ranks = cut(stepped(ranks, None if still else between, inner))
    every = _restart(asked.crossJoin(nodes.select("node", "size", "loose")), nodes, personal, n)
    return stepped(few(ranks), links, every).select("request_id", "node", (F.col("rank") / F.col("size")).alias("rank"))


def _prepared(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(node, ordinal, size, loose), links(src, dst, share)), both written; cells and links of `alike` as they are."""
    if "size" in nodes.columns:
        return cut(nodes.select("node", "ordinal", "size", "loose")), cut(edges.select("src", "dst", "share"))
    ordinal = F.min("ordinal") if "ordinal" in nodes.columns else F.first(F.lit(None).cast("long"))
    nodes = cut(nodes.groupBy("node").agg(ordinal.alias("ordinal")))
    known = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    links = known.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    leaving = links.groupBy("src").agg(F.sum("weight").alias("leaving"))
    links = cut(links.join(leaving, "src").select("src", "dst", (F.col("weight") / F.col("leaving")).alias("share")))
    exits = links.select(F.col("src").alias("node")).distinct().withColumn("exits", F.lit(True))
    return cut(nodes.join(exits, "node", "left").select("node", "ordinal", F.lit(1.0).alias("size"), F.when(F.col("exits"), 0.0).otherwise(1.0).alias("loose"))), links


def alike(symbols: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members(node, symbol_id, nth, name), cells(node, ordinal, size, loose), links(src, dst, share)) of symbols and edges(caller_id, callee_name).

    A call reaches all definers of a name alike and restarts go by names, so symbols of one name always have the same rank: they
    are one node, a cell, called by its first member, and links number as the calls of names do, not as callers times
    definers. `size` is a cell's number of members, `loose` the share of them that call nothing, `nth` a member's place. A
    symbol that calls its own name (but not itself), or has no name or several, is a cell of its own.
    """
    both = symbols.select("symbol_id", "name").distinct()
    calls = edges.groupBy(F.col("caller_id"), F.col("callee_name")).agg(F.count("*").cast("double").alias("times"))
    recursive = calls.join(both, (F.col("caller_id") == F.col("symbol_id")) & (F.col("callee_name") == F.col("name"))).select("name").distinct().withColumn("apart", F.lit(True))
    ids = symbols.groupBy("symbol_id").agg(F.min("ordinal").alias("ordinal"), F.min("name").alias("name"), F.max("name").alias("other")).join(recursive, "name", "left")
    alone = F.col("name").isNull() | (F.col("name") != F.col("other")) | F.coalesce("apart", F.lit(False))
    ids = cut(ids.select("symbol_id", "ordinal", F.when(~alone, F.col("name")).alias("shared")))
    own = ids.where("shared is null").select(F.col("symbol_id").alias("node"), "symbol_id", "ordinal", F.lit(1).alias("nth"))
    order = W.partitionBy("shared").orderBy("ordinal", "symbol_id")
    first = ids.where("shared is not null").groupBy("shared").agg(F.min(F.struct("ordinal", "symbol_id"))["symbol_id"].alias("node"))
    rest = ids.where("shared is not null").withColumn("nth", F.row_number().over(order)).join(first, "shared").select("node", "symbol_id", "ordinal", "nth")
    members = cut(own.unionByName(rest))
    cell_of = members.select("node", "symbol_id")
    named = cut(both.join(cell_of, "symbol_id").groupBy("name", "node").agg(F.count("*").alias("size")))
    made = calls.join(named.where("name is not null"), F.col("callee_name") == F.col("name")).where("caller_id <> node").select("caller_id", F.col("node").alias("dst"), (F.col("times") * F.col("size")).alias("weight"))
    made = cut(made.groupBy("caller_id", "dst").agg(F.sum("weight").alias("weight")).join(cell_of.select(F.col("symbol_id").alias("caller_id"), F.col("node").alias("src")), "caller_id"))
    leaving = made.groupBy("caller_id").agg(F.sum("weight").alias("leaving"))
    moved = made.join(leaving, "caller_id").groupBy("src", "dst").agg(F.sum(F.col("weight") / F.col("leaving")).alias("moved"))
    sizes = members.groupBy("node").agg(F.count("*").cast("double").alias("size"), F.min("ordinal").alias("ordinal"))
    callers = made.select("src", "caller_id").distinct().groupBy(F.col("src").alias("node")).agg(F.count("*").alias("callers"))
    cells = cut(sizes.join(callers, "node", "left").select("node", "ordinal", "size", ((F.col("size") - F.coalesce("callers", F.lit(0))) / F.col("size")).alias("loose")))
    return members.join(both, "symbol_id").select("node", "symbol_id", "ordinal", "nth", "name"), cells, moved.join(cells.select(F.col("node").alias("src"), "size"), "src").select("src", "dst", (F.col("moved") / F.col("size")).alias("share"))


def _pushed(state: DataFrame, out: DataFrame, damping: float) -> DataFrame:
    """One step: what is over the bar moves from residual to estimate, and its share to where the links lead."""
    push = F.when(F.col("residual") > F.col("bar"), F.col("residual")).otherwise(0.0)
    met = state.join(out, state.node == out.src, "left").withColumn("push", push)
    row = lambda node, rank, residual: F.struct(node.alias("node"), rank.alias("rank"), residual.alias("residual"))
    own = F.array(row(F.col("node"), F.col("rank") + F.col("push"), F.col("residual") - F.col("push")))
    sent = F.transform(F.coalesce("links", F.array().cast(out.schema["links"].dataType)), lambda x: row(x["dst"], F.lit(0.0), damping * x["share"] * F.col("push")))
    rows = F.when(F.coalesce("chunk", F.lit(0)) == 0, own).otherwise(F.slice(own, 1, 0))
    moved = met.select("request_id", "everywhere", "bar", F.explode(F.concat(rows, F.when(F.col("push") > 0, sent).otherwise(F.slice(sent, 1, 0)))).alias("r"))
    return moved.groupBy("request_id", "everywhere", "bar", "r.node").agg(F.sum("r.rank").alias("rank"), F.sum("r.residual").alias("residual"))


def settled_top(nodes: DataFrame, edges: DataFrame, personal: DataFrame, requests: DataFrame, k: int = 10, damping: float = DAMPING, residual: float = RESIDUAL, most: int = 400) -> DataFrame:
    """(request_id, node, score, rank): the k best of the settled ranks of `pagerank`, score rounded to 9 digits, ties by ordinal.

    nodes(node, ordinal), edges(src, dst, weight), personal(request_id, node). A request is a sparse set of (node, estimate,
    residual): residuals over a bar are pushed along the links, so a step touches no more than 1 / `residual` nodes of a
    request, and what is left unpushed, `residual` for each node reached, bounds the error (by its sum over 1 - damping). What nodes
    without an exit give to all alike is a multiple of one vector, the walk from anywhere, which is pushed once for all requests;
    the multiple follows from what ends at such nodes. So a node that a request's walk does not reach has the common vector's
    rank times that multiple, and of those only the k best, beyond the ones reached, are looked at. No request x node table is made.
    Fewer than two nodes: no rows.
    """
    nodes, links = _prepared(nodes, edges)
    held, n = nodes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    asked = requests.select("request_id").distinct()
    if n < 2:
        return asked.crossJoin(nodes).select("request_id", "node", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    leaving = links.groupBy(F.col("src").alias("from")).agg(F.ceil(F.count("*") / F.lit(_OUT)).alias("chunks"))
    shares = links.join(leaving, F.col("src") == F.col("from")).select("src", F.pmod(F.xxhash64("dst"), "chunks").alias("chunk"), "dst", "share")
    packed = shares.groupBy("src", "chunk").agg(F.collect_list(F.struct("dst", "share")).alias("links"))
    # a node's own row goes with its first chunk, so every node that has links has a chunk 0
    heads = shares.select("src").distinct().select("src", F.lit(0).cast("long").alias("chunk"))
    out = cut(heads.join(packed, ["src", "chunk"], "left").unionByName(packed.where("chunk > 0")))
    named = personal.join(nodes.select("node", "size"), "node").join(asked, "request_id", "left_semi").select("request_id", "node", "size").distinct()
    counts = cut(asked.join(named.groupBy("request_id").agg(F.sum("size").alias("named")), "request_id", "left"))
    empty = F.lit(None).cast(requests.schema["request_id"].dataType)
    start = named.join(counts, "request_id").select("request_id", F.lit(False).alias("everywhere"), F.lit(residual).alias("bar"), "node", F.lit(0.0).alias("rank"), (F.col("size") / F.col("named")).alias("residual"))
    common = nodes.select(empty.alias("request_id"), F.lit(True).alias("everywhere"), F.lit(residual / n).alias("bar"), "node", F.lit(0.0).alias("rank"), (F.col("size") / n).alias("residual"))
    state = cut(start.unionByName(common))
    for _ in range(0, most, _STEPS):
        for _ in range(_STEPS):
            state = _pushed(state, out, damping)
        state = cut(state)
        if state.where("residual > bar").isEmpty():
            break
    ranks = state.select("request_id", "everywhere", "node", (F.col("rank") + F.col("residual")).alias("x"))
    ends = ranks.join(nodes.where("loose > 0").select("node", "loose"), "node").groupBy("request_id", "everywhere").agg(F.sum(F.col("x") * F.col("loose")).alias("ends"))
    everywhere = ends.where("everywhere").agg(F.coalesce(F.max("ends"), F.lit(0.0)).alias("common_ends"))
    # p = (1 - d) x + d L u, where L, what stands at nodes without exit, is (1 - d) ends(x) + d L ends(u); u for a request without names
    lost = counts.join(ends.where("not everywhere").select("request_id", "ends"), "request_id", "left").crossJoin(F.broadcast(everywhere))
    own_ends = F.when(F.col("named").isNull(), F.col("common_ends")).otherwise(F.coalesce("ends", F.lit(0.0)))
    at_ends = (1 - damping) * own_ends / (1 - damping * F.col("common_ends"))
    factor = damping * at_ends + F.when(F.col("named").isNull(), 1 - damping).otherwise(0.0)
    scale = cut(lost.select("request_id", factor.alias("factor")))
    u = cut(ranks.where("everywhere").select("node", "x").join(nodes, "node").select("node", "ordinal", "size", (F.col("x") / F.col("size")).alias("u")))
    reached = cut(ranks.where("not everywhere").join(scale, "request_id").join(u, "node").select("request_id", "node", "ordinal", ((1 - damping) * F.col("x") / F.col("size") + F.col("factor") * F.col("u")).alias("p")))
    sizes = cut(scale.join(reached.groupBy("request_id").agg(F.count("*").alias("reached")), "request_id", "left").select("request_id", "factor", (F.coalesce("reached", F.lit(0)) + k).alias("looked")))
    looked = min(held, sizes.agg(F.max("looked")).first()[0] or k)
    best = None
    for order, where in (([F.round("u", 13).desc(), F.col("ordinal"), F.col("node")], "factor > 0"), ([F.col("ordinal"), F.col("node")], "factor <= 0")):
        placed = u.orderBy(*order).limit(looked).withColumn("nth", F.row_number().over(W.orderBy(*order)))
        wanted = sizes.where(where).select("request_id", "factor", F.explode(F.sequence(F.lit(1), F.col("looked").cast("int"))).alias("nth"))
        part = wanted.join(placed, "nth").select("request_id", "node", "ordinal", (F.col("factor") * F.col("u")).alias("p"))
        best = part if best is None else best.union(part)
    others = best.join(reached.select("request_id", "node"), ["request_id", "node"], "left_anti").select("request_id", "node", "ordinal", "p")
    scored = reached.union(others).select("request_id", "node", "ordinal", F.round("p", 9).alias("score"))
    top = F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("score"), "ordinal", "node"))
    return scored.withColumn("rank", top).where(F.col("rank") <= k).select("request_id", "node", "score", "rank")
