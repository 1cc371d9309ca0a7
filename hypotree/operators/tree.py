"""Trees of hypotheses: roots, depth and paths, frontier, expansion under budgets, pruning, audits and roll-ups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hypotree import defaults as D
from hypotree.functions.expressions import title


def create_theories(root_events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One theory and its root node for each event (id, body, observed_at)."""
    named = title(F.col("body"))
    theories = root_events.select("id", F.col("id").alias("root_event_id"), named.alias("summary"), F.lit(None).cast("double").alias("confidence"), F.col("observed_at").alias("created_at"))
    nodes = root_events.select("id", F.col("id").alias("theory_id"), F.lit(None).cast("long").alias("parent_id"), named.alias("hypothesis"), F.lit(0).alias("depth"))
    return theories, nodes


Up = dict[str, tuple[Column, Callable[[Column, Column], Column]]]
Down = dict[str, tuple[Column, Callable[[Column], Column], Callable[[Column, Column], Column]]]


def one_each(nodes: DataFrame, *more: str) -> DataFrame:
    """(id, parent_id, theory_id, *more): one row for each id; of rows that repeat one that without a parent, then the first by parent, theory and the rest."""
    columns = ["parent_id", "theory_id", *more]
    return nodes.where("id is not null").groupBy("id").agg(F.min(F.struct(*columns)).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in columns])


def walk(nodes: DataFrame, *more: str, up: Up | None = None, down: Down | None = None) -> DataFrame:
    """(id, theory_id, parent_id, *more, reached, depth, jump, *up, *down): a row for each id, by pointer doubling.

    Every node points to its parent, and in each round to what that points to, so after k rounds to its 2^k-th ancestor: as many
    rounds as the depth has binary digits, a table of one row for each node written in each. reached: whether a root is above;
    depth is then the distance to it. A walk ends in any table: pointers to ids that aren't there stop, and nodes that still
    point somewhere after more steps than there are nodes lead into a cycle; their `jump` is a node on it, else null.

    up: name -> (value of a node, (own, above) -> value over both): values over a node and all its ancestors. down: name ->
    (value of a node, aggregate, (own, below) -> value): values over a node and all its descendants, added up by the
    pointers' targets, so that no row for a node and an ancestor is ever made.
    """
    from hypotree.sources.sinks import counting, dropped

    up, down = up or {}, down or {}
    start = F.col("parent_id").isNull()
    first = one_each(nodes, *more).select(
        "id", "theory_id", "parent_id", *more, F.col("parent_id").alias("jump"), F.when(start, True).alias("reached"), F.when(start, 0).otherwise(1).cast("long").alias("depth"),
        *[v[0].alias(k) for k, v in (up | down).items()],
    )
    counts = {"open": F.count_if(F.col("jump").isNotNull()), "all": F.count("*")}
    rows, seen = counting(first, counts)
    n, span = seen["all"], 1
    while seen["open"] and span <= n:
        above = rows.select(F.col("id").alias("_id"), F.col("jump").alias("_jump"), F.col("reached").alias("_reached"), F.col("depth").alias("_depth"), *[F.col(k).alias(f"_{k}") for k in up])
        both = rows
        if down:
            below = rows.where("jump is not null").groupBy(F.col("jump").alias("_to")).agg(*[v[1](F.col(k)).alias(f"_{k}") for k, v in down.items()], F.lit(True).alias("_some"))
            both = both.join(below, F.col("id") == F.col("_to"), "left")
        both = both.join(above, F.col("jump") == F.col("_id"), "left")
        there = F.col("_id").isNotNull()
        reached = F.when(F.col("jump").isNull(), F.col("reached")).when(there, F.col("_reached")).otherwise(False)
        told = both.select(
            "id", "theory_id", "parent_id", *more, F.col("_jump").alias("jump"), reached.alias("reached"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            *[F.when(there, v[1](F.col(k), F.col(f"_{k}"))).otherwise(F.col(k)).alias(k) for k, v in up.items()],
            *[F.when(F.col("_some"), v[2](F.col(k), F.col(f"_{k}"))).otherwise(F.col(k)).alias(k) for k, v in down.items()],
        )
        old, span = rows, span * 2
        rows, seen = counting(told, counts)
        dropped(old)
    return rows.withColumns({"reached": F.coalesce("reached", F.lit(False)), "depth": F.col("depth").cast("int")})


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(id, theory_id, depth, path): path has the ids from the root, padded to 20 digits. Nodes that no root reaches are left out."""
    own = F.lpad(F.col("id").cast("string"), 20, "0")
    return walk(nodes, up={"path": (own, lambda own, above: F.concat_ws("/", above, own))}).where("reached").select("id", "theory_id", "depth", "path")


def tree_depth(nodes: DataFrame) -> DataFrame:
    return walk(nodes).where("reached").select("id", "theory_id", "depth")


def frontier(nodes: DataFrame, depth: int = D.DEPTH, branch: int = D.BRANCH) -> DataFrame:
    """Nodes that may have more children: node_id, theory_id, depth, children, slots."""
    children = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    joined = tree_depth(nodes).join(children, "id", "left").select(F.col("id").alias("node_id"), "theory_id", "depth", F.coalesce("children", F.lit(0)).alias("children"))
    return joined.where((F.col("depth") < depth) & (F.col("children") < branch)).withColumn("slots", F.lit(branch) - F.col("children"))


def expand_level(open_nodes: DataFrame, candidates: DataFrame, branch: int = D.BRANCH) -> DataFrame:
    """The best candidates (node_id, event_id, cos) of each frontier node, at most its slots, of which it has `branch` at most."""
    best = Window.partitionBy("node_id").orderBy(F.desc("cos"), "event_id")
    ranked = open_nodes.join(candidates.select("node_id", "event_id", "cos"), "node_id").withColumn("n", F.row_number().over(best)).where((F.col("n") <= branch) & (F.col("n") <= F.col("slots")))
    return ranked.select(F.col("node_id").alias("parent_id"), "theory_id", "event_id", (F.col("depth") + 1).alias("child_depth"), "cos")


def expand_to_budget(roots: DataFrame, events: DataFrame, depth: int = D.DEPTH, branch: int = D.BRANCH, tau: float = D.TAU) -> DataFrame:
    """Grows trees from roots (id, theory_id, embedding) to the budgets; events become nodes: theory_id, depth, parent_id, node_id, event_id, cos.

    Level by level: each event that the theory hasn't used goes to the open node of the highest cos (then the lower id), of those
    with at least tau; each node takes the best `branch` of what goes to it. Levels are written tables. An event leaves a tile with
    its best node of each theory only.
    """
    from hypotree.operators.similarity import best_in_groups
    from hypotree.sources.sinks import checkpointed

    level = roots.select("id", "theory_id", "embedding").where("embedding is not null")
    grown = level.select("theory_id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent_id"), F.col("id").alias("node_id"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("double").alias("cos"))
    grown = checkpointed(grown)
    for k in range(1, depth + 1):
        chosen = best_in_groups(events, level, "theory_id", tau).where("cos > 0").select(F.col("a").alias("event_id"), F.col("b").alias("node_id"), "cos")
        owned = chosen.join(level.select(F.col("id").alias("node_id"), "theory_id"), "node_id")
        free = owned.join(grown.where("event_id is not null").select("theory_id", "event_id"), ["theory_id", "event_id"], "left_anti")
        best = Window.partitionBy("node_id").orderBy(F.desc("cos"), "event_id")
        taken = free.withColumn("n", F.row_number().over(best)).where(F.col("n") <= branch)
        # a grown node's id: unique for theory and event, above all given ids
        new = taken.select("theory_id", F.lit(k).alias("depth"), F.col("node_id").alias("parent_id"), (F.lit(1_000_000_000_000) * (F.col("theory_id") + 1) + F.col("event_id")).alias("node_id"), "event_id", "cos")
        new = checkpointed(new)
        if new.isEmpty():
            break
        grown = grown.unionByName(new)
        level = new.join(events.select(F.col("id").alias("event_id"), "embedding"), "event_id").select(F.col("node_id").alias("id"), "theory_id", "embedding")
    return grown


def prune(nodes: DataFrame, floor: float = D.PRUNE_FLOOR) -> DataFrame:
    """The nodes that stay: roots, and nodes that have, with all their non-root ancestors, a score of at least floor."""
    fine = F.col("parent_id").isNull() | (F.coalesce("score", F.lit(0.0)) >= floor)
    stay = walk(nodes, "score", up={"fine": (fine, lambda own, above: own & above)}).where("reached and fine")
    return nodes.join(stay.select("id"), "id", "left_semi")


def budget_audit(nodes: DataFrame, depth: int = D.DEPTH, branch: int = D.BRANCH) -> DataFrame:
    """(kind, node_id): nodes beyond the depth, parents of too many children, nodes that no root reaches."""
    levels = walk(nodes)
    deep = levels.where(F.col("reached") & (F.col("depth") > depth)).select(F.lit("too_deep").alias("kind"), F.col("id").alias("node_id"))
    wide = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n")).where(F.col("n") > branch).select(F.lit("too_wide").alias("kind"), "node_id")
    lost = levels.where("not reached").select(F.lit("unreachable").alias("kind"), F.col("id").alias("node_id"))
    return reduce(DataFrame.unionByName, [deep, wide, lost])


def key_audit(nodes: DataFrame) -> DataFrame:
    """(kind, node_id) of nodes whose keys are unsound: on a cycle, repeated, below a parent that isn't there or is of another theory; rows without an id (null)."""
    levels = walk(nodes)
    cycle = levels.where("jump is not null").select(F.lit("cycle").alias("kind"), F.col("jump").alias("node_id")).distinct()
    repeated = nodes.where("id is not null").groupBy(F.col("id").alias("node_id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated").alias("kind"), "node_id")
    parents = levels.select(F.col("id").alias("_id"), F.col("theory_id").alias("_theory"))
    beside = levels.where("parent_id is not null").join(parents, F.col("parent_id") == F.col("_id"), "left")
    kind = F.when(F.col("_id").isNull(), "no_parent").when(~F.col("theory_id").eqNullSafe(F.col("_theory")), "other_theory")
    odd = beside.select(kind.alias("kind"), F.col("id").alias("node_id")).where("kind is not null")
    nameless = nodes.where("id is null").select(F.lit("no_id").alias("kind"), F.col("id").alias("node_id"))
    return reduce(DataFrame.unionByName, [cycle, repeated, odd, nameless])


def preorder(nodes: DataFrame) -> DataFrame:
    """(id, theory_id, path, position): position counts the nodes of a theory in pre-order, siblings by id.

    Paths are cut into ranges, so that a large theory lies in many; a range's nodes are counted in it, and of each theory
    and range only a count meets in one place.
    """
    from hypotree.sources.sinks import checkpointed

    paths = tree_paths(nodes).select("id", "theory_id", "path")
    rows = checkpointed(paths.repartitionByRange("theory_id", "path").withColumn("part", F.spark_partition_id()))
    sizes = rows.groupBy("theory_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("theory_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("theory_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("theory_id", "part").orderBy("path"))
    placed = rows.withColumn("inside", inside).join(before, ["theory_id", "part"])
    return placed.select("id", "theory_id", "path", (F.col("inside") + F.col("before")).cast("int").alias("position"))


def subtree_rollup(nodes: DataFrame) -> DataFrame:
    """(id, size, max_score, mean_score) of each node with its descendants; a null score counts for the size only."""
    add = lambda own, below: own + below
    known = F.when(F.col("score").isNotNull(), 1).otherwise(0).cast("long")
    below = {
        "size": (F.lit(1).cast("long"), F.sum, add), "known": (known, F.sum, add), "total": (F.coalesce("score", F.lit(0.0)), F.sum, add),
        "max_score": (F.col("score"), F.max, lambda own, below: F.greatest(own, below)),
    }
    rolled = walk(nodes, "score", down=below).where("reached")
    return rolled.select("id", "size", "max_score", F.try_divide("total", F.col("known")).alias("mean_score"))


def branch_stats(nodes: DataFrame) -> DataFrame:
    children = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("kids"))
    joined = walk(nodes, "score").where("reached").join(children, "id", "left").fillna(0, ["kids"])
    return joined.groupBy("theory_id", "depth").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("kids") == 0).alias("leaves"), F.avg("kids").alias("mean_children"), F.max("kids").alias("max_children"), F.avg("score").alias("mean_score"))
