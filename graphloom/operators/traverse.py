"""Graph queries: impact of changes, context, explanations, paths, levels, components.

Frontier loops run as DataFrame joins; each step is written to the shared checkpoint folder, so lineage stays short
and a lost executor costs one step. All graphs of a table advance together.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import louvain
from graphloom.operators.views import first_layer, neighbours
from graphloom.session import cut_lineage, delete_folder, written


#: Modularity that a round of moves must gain to count.
GAIN = 1e-4
#: Linked pairs of a graph that one task settles.
MOST_LINKS = 500_000


def diff_impact(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """graphId, id, role (changed or affected) of a set of changed files (graphId, filePath).

    Changed are the nodes of the files and what they contain: a ``contains`` edge is followed if its source is
    changed by the time its ordinal is reached, so containment grows along increasing ordinals. Affected are the
    neighbours of changed nodes.
    """
    start = nodes.join(files, ["graphId", "filePath"], "left_semi").select("graphId", "id", F.lit(-1).cast("long").alias("at"))
    contains = cut_lineage(edges.where("type = 'contains'").select("graphId", F.col("source").alias("id"), F.col("target").alias("child"), "edge_ord"))
    front = cut_lineage(start)
    reached = _Parts(front)
    while True:
        step = front.join(contains, ["graphId", "id"]).where(F.col("edge_ord") > F.col("at")).groupBy("graphId", F.col("child").alias("id")).agg(F.min("edge_ord").alias("at"))
        # A node met again counts only if it is met earlier, as that can open edges that were passed before.
        old = reached.all().groupBy("graphId", "id").agg(F.min("at").alias("known"))
        front = cut_lineage(step.join(old, ["graphId", "id"], "left").where("known is null or at < known").select("graphId", "id", "at"))
        if front.isEmpty():
            break
        reached.add(front)
    changed = reached.all().select("graphId", "id").distinct()
    near = neighbours(edges, changed).join(changed, ["graphId", "id"], "left_anti")
    return changed.withColumn("role", F.lit("changed")).union(near.withColumn("role", F.lit("affected")))


def unmapped_files(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Changed files that no node stands for."""
    return files.join(nodes.select("graphId", "filePath"), ["graphId", "filePath"], "left_anti")


def risk(impact: DataFrame, nodes: DataFrame, members: DataFrame, unmapped: DataFrame) -> DataFrame:
    """Per graph the facts of a change and its risks; ``low`` where none applies."""
    i = impact.join(nodes.select("graphId", "id", "complexity"), ["graphId", "id"]).join(first_layer(members).select("graphId", "id", "layer_id"), ["graphId", "id"], "left")
    facts = i.groupBy("graphId").agg(
        F.count_if((F.col("role") == "changed") & (F.col("complexity") == "complex")).alias("n_complex"), F.countDistinct("layer_id").alias("n_layers"), F.count_if(F.col("role") == "affected").alias("n_affected"),
    ).join(unmapped.groupBy("graphId").agg(F.count("*").alias("n_unmapped")), "graphId", "left").fillna(0, ["n_unmapped"])
    found = F.array_compact(F.array(
        F.when(F.col("n_complex") > 0, "complex"), F.when(F.col("n_layers") > 1, "layers"), F.when(F.col("n_affected") > 5, "wide"), F.when(F.col("n_unmapped") > 0, "unmapped"),
    ))
    return facts.withColumn("risks", F.when(F.size(found) > 0, F.array_join(found, ",")).otherwise("low"))


def explain(nodes: DataFrame, edges: DataFrame, members: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target (graphId, id): counts of what it contains and is linked with, edges each way, first layer."""
    t = targets.select("graphId", "id")
    e = edges.select("graphId", "source", "target", "type")
    out = t.join(e.withColumnRenamed("source", "id"), ["graphId", "id"]).groupBy("graphId", "id").agg(F.count_if(F.expr("type = 'contains'")).alias("n_children"), F.count_if(F.expr("type <> 'contains'")).alias("n_out"))
    inn = t.join(e.withColumnRenamed("target", "id"), ["graphId", "id"]).groupBy("graphId", "id").agg(F.count("*").alias("n_in"))
    layer = first_layer(members).select("graphId", "id", "layer_id")
    return t.join(out, ["graphId", "id"], "left").join(inn, ["graphId", "id"], "left").join(layer, ["graphId", "id"], "left").fillna(0, ["n_children", "n_out", "n_in"])


def find_symbol(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``path[:symbol]`` lookups (graphId, filePath, symbol): exact name, else last dotted part, else the file; first node wins."""
    c = wanted.join(nodes.select("graphId", "filePath", "id", "name", "type", "node_ord"), ["graphId", "filePath"])
    tier = (
        F.when(F.col("name") == F.col("symbol"), 0).when(F.element_at(F.split("symbol", r"\."), -1) == F.col("name"), 1).when(F.col("type") == "file", 2)
    )
    c = c.withColumn("tier", tier).where("tier is not null")
    return c.groupBy("graphId", "filePath", "symbol").agg(F.min_by(F.struct("id", "tier"), F.struct("tier", "node_ord")).alias("v")).select("graphId", "filePath", "symbol", "v.id", "v.tier")


class _Parts:
    """Rows that only grow: each addition is a written part of its own, and parts are merged once sixteen of one age lie there.

    So a loop of d steps writes each row about log16(d) times instead of d times, and plans stay short.
    """

    def __init__(self, *first: DataFrame):
        self._by_age: list[list[DataFrame]] = [list(first)]

    def add(self, part: DataFrame) -> None:
        self._by_age[0].append(part)
        for age, parts in enumerate(self._by_age):
            if len(parts) < 16:
                break
            if age + 1 == len(self._by_age):
                self._by_age.append([])
            self._by_age[age + 1].append(cut_lineage(reduce(DataFrame.union, parts).coalesce(max(1, parts[0].sparkSession.sparkContext.defaultParallelism))))
            self._by_age[age] = []

    def all(self) -> DataFrame:
        return reduce(DataFrame.union, chain.from_iterable(reversed(self._by_age)))


def _links(edges: DataFrame, directed: bool) -> DataFrame:
    """graphId, id, next of every step, without self-loops and repeats."""
    step = edges.select("graphId", F.col("source").alias("id"), F.col("target").alias("next"))
    return (step if directed else step.union(edges.select("graphId", "target", "source"))).where("id <> next").distinct()


def distances(edges: DataFrame, start: DataFrame, directed: bool = True) -> DataFrame:
    """Steps from the nearest start node (graphId, id) along edges; unreached nodes are left out.

    Runs until no node is new, however far that is. Along undirected edges distances differ by one at most, so a
    new front is only compared with the two before it.
    """
    step = cut_lineage(_links(edges, directed))
    front = cut_lineage(start.select("graphId", "id").distinct().withColumn("depth", F.lit(0)))
    seen, last, depth = _Parts(front), [front], 0
    while True:
        depth += 1
        known = seen.all() if directed else reduce(DataFrame.union, last)
        new = front.join(step, ["graphId", "id"]).select("graphId", F.col("next").alias("id")).distinct().join(known, ["graphId", "id"], "left_anti")
        front = cut_lineage(new.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen.all()
        seen.add(front)
        last = [last[-1], front]


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """graphId, source, target, length, path of a shortest way along edges either way, for pairs (graphId, source, target).

    Pairs of one source are searched together. Where several ways are shortest, each node is reached from its smallest
    possible predecessor. path is the ids joined by ``>``. Pairs without a way are left out; from a node to itself the
    path is the node.
    """
    step = cut_lineage(_links(edges, False))
    wanted = cut_lineage(pairs.select("graphId", "source", "target").distinct())
    front = cut_lineage(wanted.select("graphId", "source", F.col("source").alias("id"), F.lit(None).cast("string").alias("parent")).distinct())
    levels, open_ = [front], wanted.where("source <> target")
    done = [wanted.where("source = target").withColumn("length", F.lit(0))]
    while True:
        near = front.select("graphId", "source", F.col("id").alias("parent")).join(step.select("graphId", F.col("id").alias("parent"), F.col("next").alias("id")), ["graphId", "parent"])
        new = near.groupBy("graphId", "source", "id").agg(F.min("parent").alias("parent")).join(reduce(DataFrame.union, levels[-2:]), ["graphId", "source", "id"], "left_anti")
        # Searches whose targets are all found go no further.
        front = cut_lineage(new.join(open_.select("graphId", "source").distinct(), ["graphId", "source"], "left_semi"))
        if front.isEmpty():
            break
        levels.append(front)
        hit = front.select("graphId", "source", F.col("id").alias("target"))
        done.append(cut_lineage(open_.join(hit, ["graphId", "source", "target"], "left_semi").withColumn("length", F.lit(len(levels) - 1))))
        open_ = cut_lineage(open_.join(hit, ["graphId", "source", "target"], "left_anti"))
    way = None
    for depth in range(len(levels) - 1, -1, -1):
        here = done[depth].select("graphId", "source", "target", "length", F.col("target").alias("at"), F.col("target").alias("path")) if depth < len(done) else None
        way = here if way is None else way if here is None else way.union(here)
        if depth:
            up = levels[depth].select("graphId", "source", F.col("id").alias("at"), "parent")
            way = cut_lineage(way.join(up, ["graphId", "source", "at"]).select("graphId", "source", "target", "length", F.col("parent").alias("at"), F.concat_ws(">", "parent", "path").alias("path")))
    return way.select("graphId", "source", "target", "length", "path")


def containers(nodes: DataFrame, contains: DataFrame, kind: str = "file") -> DataFrame:
    """graphId, id, file: the nearest node of that kind that contains each node, at any depth; ties to the smaller id.

    The walk stops at the first such node, so it does not pass through one. A node met again is farther and is left
    out, which also ends cycles.
    """
    step = cut_lineage(contains.select("graphId", F.col("source").alias("up"), F.col("target").alias("id")).distinct())
    files = nodes.where(F.col("type") == kind).select("graphId", F.col("id").alias("up"))
    front = cut_lineage(step.join(files, ["graphId", "up"], "left_semi").groupBy("graphId", "id").agg(F.min("up").alias("file")))
    seen = _Parts(front)
    step = cut_lineage(step.join(files, ["graphId", "up"], "left_anti"))
    while not front.isEmpty():
        below = step.join(front.select("graphId", F.col("id").alias("up"), "file"), ["graphId", "up"]).groupBy("graphId", "id").agg(F.min("file").alias("file"))
        front = cut_lineage(below.join(seen.all(), ["graphId", "id"], "left_anti"))
        seen.add(front)
    return seen.all()


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Level of each node when sources are peeled off again and again; nodes on or behind cycles have level -1.

    Only the front moves: what it passes on is logged, and a node follows once it has got as much as it has edges in.
    """
    e = cut_lineage(edges.where("source <> target").select("graphId", "source", "target").distinct())
    need = cut_lineage(e.groupBy("graphId", F.col("target").alias("id")).agg(F.count("*").alias("need")))
    every = nodes.select("graphId", "id")
    front = cut_lineage(every.join(need, ["graphId", "id"], "left_anti").withColumn("level", F.lit(0)))
    levels, log, level = _Parts(front), None, 0
    while not front.isEmpty():
        level += 1
        passed = cut_lineage(e.join(front.select("graphId", F.col("id").alias("source")), ["graphId", "source"]).groupBy("graphId", F.col("target").alias("id")).agg(F.count("*").alias("got")))
        log = _Parts(passed) if log is None else log
        if level > 1:
            log.add(passed)
        got = log.all().join(passed.select("graphId", "id"), ["graphId", "id"], "left_semi").groupBy("graphId", "id").agg(F.sum("got").alias("got"))
        front = cut_lineage(got.join(need, ["graphId", "id"]).where("got = need").join(every, ["graphId", "id"], "left_semi").select("graphId", "id", F.lit(level).alias("level")))
        levels.add(front)
    found = levels.all()
    return found.union(every.join(found, ["graphId", "id"], "left_anti").withColumn("level", F.lit(-1)))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest id of the connected component of each node, by hooking to smaller neighbours and jumping pointers."""
    both = cut_lineage(_links(edges, False).select("graphId", F.col("id").alias("a"), F.col("next").alias("b")))
    label = cut_lineage(nodes.select("graphId", "id", F.col("id").alias("component")))
    while True:
        near = both.join(label.select("graphId", F.col("id").alias("b"), F.col("component").alias("lb")), ["graphId", "b"]).groupBy("graphId", F.col("a").alias("id")).agg(F.min("lb").alias("low"))
        hooked = label.join(near, ["graphId", "id"], "left").select("graphId", "id", "component", F.least("component", "low").alias("new"))
        # The label of the label: halves what is left to go.
        up = hooked.select("graphId", F.col("id").alias("new"), F.col("new").alias("up"))
        jumped = cut_lineage(hooked.join(up, ["graphId", "new"], "left").select("graphId", "id", F.least("new", "up").alias("component"), (F.least("new", "up") != F.col("component")).alias("moved")))
        label = jumped.select("graphId", "id", "component")
        if jumped.where("moved").isEmpty():
            return label


def _modularity(links: DataFrame, label: DataFrame, resolution: float) -> dict[str, float]:
    """Modularity of a partition of each graph."""
    a = links.join(label.select("graphId", F.col("id").alias("a"), F.col("community").alias("ca")), ["graphId", "a"]).join(label.select("graphId", F.col("id").alias("b"), F.col("community").alias("cb")), ["graphId", "b"])
    per = a.groupBy("graphId", F.col("ca").alias("c")).agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inner"), F.sum("w").alias("all"))
    m = per.groupBy("graphId").agg(F.sum("inner").alias("inner"), F.sum("all").alias("m2"), F.sum(F.col("all") * F.col("all")).alias("squares"))
    return {r["graphId"]: r["q"] for r in m.select("graphId", ((F.col("inner") * F.col("m2") - resolution * F.col("squares")) / (F.col("m2") * F.col("m2"))).alias("q")).collect()}


def _apart(moves: DataFrame) -> DataFrame:
    """Moves that are the best of both communities they touch; ties to the smaller node."""
    w = Window.partitionBy("graphId", "touched").orderBy(F.desc("more"), "id")
    touching = moves.select("*", F.explode(F.array("own", "to")).alias("touched"))
    best = touching.withColumn("r", F.row_number().over(w)).where("r = 1").groupBy("graphId", "id").agg(F.count("*").alias("n")).where("n = 2")
    return moves.join(best.select("graphId", "id"), ["graphId", "id"], "left_semi")


def _moved(label: DataFrame, moves: DataFrame) -> DataFrame:
    """graphId, id, old and new community."""
    return written(label.withColumnRenamed("community", "old").join(moves.select("graphId", "id", "to"), ["graphId", "id"], "left").select("graphId", "id", "old", F.coalesce("to", "old").alias("community")))


def _move(links: DataFrame, nodes: DataFrame, resolution: float) -> tuple[DataFrame, list[str]]:
    """``louvain.settle`` of all graphs together, as joins; also the graphs where a node moved."""
    degree = written(links.groupBy("graphId", F.col("a").alias("id")).agg(F.sum("w").alias("k")))
    m2 = degree.groupBy("graphId").agg(F.sum("k").alias("m2"))
    label = nodes.select("graphId", "id", F.col("id").alias("community"))
    best, turn, moved, last = _modularity(links, label, resolution), 0, set(), []
    idle = dict.fromkeys(best, 0)
    while going := [g for g, n in idle.items() if n < 2]:
        on = F.col("graphId").isin(going)
        size = label.join(degree, ["graphId", "id"]).groupBy("graphId", "community").agg(F.sum("k").alias("total"))
        mine = degree.where(on & (_group("id") == turn % 2)).join(label.withColumnRenamed("community", "own"), ["graphId", "id"])
        to = links.where(on & F.expr("a <> b")).join(label.select("graphId", F.col("id").alias("b"), "community"), ["graphId", "b"]).groupBy("graphId", F.col("a").alias("id"), "community").agg(F.sum("w").alias("w"))
        stay = mine.select("graphId", "id", F.col("own").alias("community"), F.lit(0.0).alias("w"))
        options = mine.join(to.unionByName(stay).groupBy("graphId", "id", "community").agg(F.sum("w").alias("w")), ["graphId", "id"]).join(size, ["graphId", "community"]).join(m2, "graphId")
        own = F.col("community") == F.col("own")
        gain = F.col("w") * F.col("m2") - resolution * F.col("k") * (F.col("total") - F.when(own, F.col("k")).otherwise(0.0))
        # Of equal gains the own community, then the smallest.
        w = Window.partitionBy("graphId", "id")
        ranked = options.withColumn("gain", gain).withColumns({"r": F.row_number().over(w.orderBy(F.desc("gain"), F.desc(own), "community")), "more": F.col("gain") - F.max(F.when(own, F.col("gain"))).over(w)})
        moves = written(ranked.where("r = 1 and community <> own").select("graphId", "id", "own", F.col("community").alias("to"), "more"))
        made = [moves, new := _moved(label, moves)]
        now = _modularity(links.where(on), new, resolution)
        if lost := [g for g in going if now[g] <= best[g] + GAIN]:
            of_lost = F.col("graphId").isin(lost)
            made.append(new := _moved(label, moves.where(~of_lost).union(_apart(moves.where(of_lost)))))
            now |= _modularity(links.where(of_lost), new, resolution)
        won = [g for g in going if now[g] > best[g] + GAIN]
        turn += 1
        idle |= {g: 0 if g in won else idle[g] + 1 for g in going}
        best |= {g: now[g] for g in won}
        moved |= {*won}
        label = new.select("graphId", "id", F.when(F.col("graphId").isin(won), F.col("community")).otherwise(F.col("old")).alias("community"))
        for df in last:
            delete_folder(df.sparkSession, df.inputFiles()[0].rpartition("/")[0])
        last = made
    return label, sorted(moved)


def _group(node: str) -> F.Column:
    """Nodes move in two groups."""
    return F.pmod(F.xxhash64("graphId", node), F.lit(2)).cast("int")


def _communities_by_joins(pairs: DataFrame, resolution: float) -> DataFrame:
    """graphId, id, community of linked nodes, of graphs that are too large for a task."""
    both = pairs.select("graphId", "a", "b").union(pairs.select("graphId", "b", "a"))
    links = written(both.withColumn("w", F.lit(1.0)))
    label = None
    while True:
        level = links.select("graphId", F.col("a").alias("id")).distinct()
        step, moved = _move(links, level, resolution)
        above = step.select("graphId", F.col("id").alias("mid"), F.col("community").alias("up"))
        # Graphs that were settled on an earlier level stay as they are.
        label = step if label is None else written(label.withColumnRenamed("community", "mid").join(above, ["graphId", "mid"], "left").select("graphId", "id", F.coalesce("up", "mid").alias("community")))
        if not moved:
            return label
        a, b = (step.select("graphId", F.col("id").alias(x), F.col("community").alias("c" + x)) for x in "ab")
        links = links.where(F.col("graphId").isin(moved))
        links = written(links.join(a, ["graphId", "a"]).join(b, ["graphId", "b"]).groupBy("graphId", F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, most_links: int = MOST_LINKS) -> DataFrame:
    """graphId, id, community of greatest modularity found: nodes move, communities become nodes, until nothing gains.

    A community is named by one of its members. Nodes without links stay alone. Deterministic, and the same for a graph
    whatever others the table has: graphs of up to ``most_links`` linked pairs are settled in one task each, larger ones by joins
    in the same steps.
    """
    ids = written(nodes.select("graphId", "id").distinct())
    e = edges.join(ids.withColumnRenamed("id", "source"), ["graphId", "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), ["graphId", "target"], "left_semi")
    pairs = e.where("source <> target").select("graphId", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    pairs = written(pairs.withColumns({"group_a": _group("a"), "group_b": _group("b")}))
    large = pairs.groupBy("graphId").count().where(F.col("count") > most_links).select("graphId")
    large = [r["graphId"] for r in large.collect()]

    def settled(t):
        return louvain.communities(t, resolution, GAIN)

    spark = nodes.sparkSession
    # A number of partitions, as the bytes of a graph don't tell its time.
    label = pairs.where(~F.col("graphId").isin(large)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "graphId").groupBy("graphId").applyInArrow(settled, "graphId string, id string, community string")
    if large:
        label = label.union(_communities_by_joins(pairs.where(F.col("graphId").isin(large)), resolution))
    return ids.join(label, ["graphId", "id"], "left").select("graphId", "id", F.coalesce("community", "id").alias("community"))


def numbered(df: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """Numbers the rows of each group from 0 in a total order, though no task holds a whole group.

    Rows are range-partitioned by group and order, numbered within the part of a group that a partition holds, and
    shifted by the sizes of the parts before.
    """
    cut = cut_lineage(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    local = cut.withColumn("_nth", F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)) - 1)
    sizes = cut.groupBy("_part", *[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*[f"_by_{c}" for c in by]).orderBy("_part")) - F.col("_n")).drop("_n").withColumnRenamed("_part", "_of")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col("_part") == F.col("_of"))
    return local.join(before, same).withColumn(out, F.col("_nth") + F.col("_before")).select(*df.columns, out)


def chunks(df: DataFrame, by: list[str], order: list[str], size: int, out: str = "chunk") -> DataFrame:
    """Numbers rows in order and cuts each group into chunks of a fixed size."""
    return numbered(df, by, order, "_k").withColumn(out, F.floor(F.col("_k") / size).cast("int")).drop("_k")


def split_batches(labelled: DataFrame, largest: int = 35, smallest: int = 3, pool: int = 25) -> DataFrame:
    """Batches from communities: those above ``largest`` are cut into equal parts, those below ``smallest`` pooled."""
    size = Window.partitionBy("graphId", "community")
    sized = written(labelled.withColumns({"n": F.count("*").over(size), "k": F.row_number().over(size.orderBy("id"))}))
    parts = F.ceil(F.col("n") / largest)
    big = sized.where(F.col("n") >= smallest).select("graphId", "id", F.concat("community", F.lit("#"), F.floor((F.col("k") - 1) * parts / F.col("n")).cast("string")).alias("batch"))
    small = chunks(sized.where(F.col("n") < smallest), ["graphId"], ["community", "id"], pool).select("graphId", "id", F.concat(F.lit("misc#"), F.col("chunk").cast("string")).alias("batch"))
    return big.union(small)
