"""Dataset graphs: layers, weights, components, metrics, hubs and domains.

Edges are (a, b, weight) with a < b.  Pattern tables have (dataset, subject_class, property_uri, object_class).
"""

from __future__ import annotations

import heapq
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms
from ..storage import broadcast_if_small, written


def multigraph(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices (id, label), edges (src, dst, predicate, count)) of the patterns whose object is a class; a vertex's first label by name holds."""
    typed = patterns.where(~F.col("object_class").isin(*terms.SENTINELS))
    label = lambda c: F.col(c) if c in patterns.columns else F.lit(None).cast("string")
    ends = typed.select(F.explode(F.array(F.struct(F.col("subject_class").alias("id"), label("subject_label").alias("label")), F.struct(F.col("object_class").alias("id"), label("object_label").alias("label")))).alias("v")).select("v.*")
    vertices = ends.groupBy("id").agg(F.coalesce(F.min("label"), terms.local_name(F.col("id"))).alias("label"))
    return vertices, typed.select(F.col("subject_class").alias("src"), F.col("object_class").alias("dst"), F.col("property_uri").alias("predicate"), "count")


def mapping_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices (id, dataset), edges (src, dst, predicate, confidence)) of mapping edges; the first dataset by name holds."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_class").alias("id"), F.col("source_dataset").alias("dataset")), F.struct(F.col("target_class").alias("id"), F.col("target_dataset").alias("dataset")))).alias("v")).select("v.*")
    return ends.groupBy("id").agg(F.min("dataset").alias("dataset")), edges.select(F.col("source_class").alias("src"), F.col("target_class").alias("dst"), "predicate", "confidence")


def class_datasets(patterns: DataFrame) -> DataFrame:
    """Distinct (class, dataset) of the subject classes."""
    return patterns.select(F.col("subject_class").alias("class"), "dataset").distinct()


def schema_links(patterns: DataFrame) -> DataFrame:
    """(a, b, predicate) for each pattern whose object class is a subject class of another dataset."""
    where = class_datasets(patterns).select(F.col("class").alias("object_class"), F.col("dataset").alias("other"))
    typed = patterns.where(~F.col("object_class").isin(*terms.SENTINELS))
    met = typed.join(broadcast_if_small(where), "object_class").where("dataset <> other")
    return met.select(F.least("dataset", "other").alias("a"), F.greatest("dataset", "other").alias("b"), F.col("property_uri").alias("predicate"))


def weights(links: DataFrame) -> DataFrame:
    return links.groupBy("a", "b").agg(F.count("*").alias("weight"))


def predicate_weights(links: DataFrame) -> DataFrame:
    return links.groupBy("a", "b", "predicate").agg(F.count("*").alias("count")).orderBy("a", "b", F.desc("count"), "predicate")


def mapping_links(edges: DataFrame, where: DataFrame) -> DataFrame:
    """(a, b, predicate) for each mapping edge between classes of two datasets."""
    source = where.select(F.col("class").alias("source_class"), F.col("dataset").alias("sd"))
    target = where.select(F.col("class").alias("target_class"), F.col("dataset").alias("td"))
    met = edges.join(broadcast_if_small(source), "source_class").join(broadcast_if_small(target), "target_class").where("sd <> td")
    return met.select(F.least("sd", "td").alias("a"), F.greatest("sd", "td").alias("b"), "predicate")


def added(*layers: DataFrame) -> DataFrame:
    """The sum of weighted layers."""
    return reduce(DataFrame.unionByName, layers).groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def layered(schema: DataFrame, raw: DataFrame, inferred: DataFrame) -> DataFrame:
    """(layer, a, b, weight): each layer holds the ones before it."""
    names = F.array(*(F.lit(n) for n in ("schema", "raw", "inferred")))
    one = reduce(DataFrame.unionByName, (g.select("a", "b", "weight", F.lit(i).alias("i")) for i, g in enumerate((schema, raw, inferred))))
    in_all = one.select(F.explode(F.slice(names, F.col("i") + 1, F.lit(3))).alias("layer"), "a", "b", "weight")  # a weight counts in its layer and in those after it
    return in_all.groupBy("layer", "a", "b").agg(F.sum("weight").alias("weight"))


def new_pairs(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """The pairs of ``later`` that ``earlier`` lacks."""
    return later.join(earlier.select("a", "b"), ["a", "b"], "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, weighted_degree)."""
    ends = edges.select(F.col("a").alias("node"), "weight").unionByName(edges.select(F.col("b").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("node").distinct().join(degrees(edges), "node", "left_anti")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each can reach.  Labels spread along edges and jump along labels,
    so the rounds grow with the logarithm of the longest path; each round is a written table."""
    ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = written(ends.union(ends.select("v", "u")).distinct())
    now = written(nodes.select("node").distinct().withColumn("root", F.col("node")))
    while True:
        heard = both.join(now.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("heard"))
        stepped = now.join(heard, "node", "left").select("node", F.least("root", F.coalesce("heard", "root")).alias("root"))
        jumped = stepped.join(stepped.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left").select("node", F.least("root", F.coalesce("far", "root")).alias("root"))
        after = written(jumped)
        changed = after.join(now.withColumnRenamed("root", "was"), "node").where("root <> was")
        done = changed.isEmpty()
        now = after
        if done:
            return now


def ranked_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component, size): components numbered from 0, the largest first, ties by smallest node."""
    found = components(nodes, edges)
    sizes = found.groupBy("root").agg(F.count("*").alias("size"))
    numbered = sizes.withColumn("component", F.row_number().over(Window.orderBy(F.desc("size"), "root")) - 1)  # one row for each component
    return found.join(numbered, "root").select("node", "component", "size")


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, size and diameter of the largest, density to four places.

    The searches for the diameter, one from every node of the largest component, are spread over the workers.
    """
    edges = written(edges)
    ranked = ranked_components(nodes, edges)
    totals = ranked.agg(F.count("*").alias("n_nodes"), F.countDistinct("component").alias("n_components"), F.max("size").alias("largest_component"))
    count = edges.agg(F.count("*").alias("n_edges"))
    largest = edges.join(ranked.where("component = 0").select(F.col("node").alias("a")), "a", "left_semi")
    longest = central(largest, with_betweenness=False).agg(F.coalesce(F.max("eccentricity"), F.lit(0)).cast("bigint").alias("diameter"))
    n = F.col("n_nodes")
    return totals.crossJoin(count).crossJoin(longest).select("n_nodes", "n_edges", "n_components", "largest_component", "diameter", F.round(F.when(n > 1, 2 * F.col("n_edges") / (n * (n - 1))).otherwise(0.0), 4).alias("density"))


#: A graph of datasets has at most so many edges; each worker holds them all.
DATASET_EDGES = 1 << 20


def central(edges: DataFrame, with_betweenness: bool = True, weighted: bool = False) -> DataFrame:
    """(node, eccentricity, betweenness): hops to the farthest node in reach; normalised betweenness (Brandes 2001),
    over hops or, if ``weighted``, over paths of least weight.

    For graphs of datasets: edges go to every worker, and beyond ``DATASET_EDGES`` are an error; the searches, one from
    each node, are spread over the workers and their sums added up.
    """
    spark = edges.sparkSession
    rows = edges.select("a", "b", (F.col("weight") if weighted else F.lit(1)).cast("double").alias("w")).where("a <> b").limit(DATASET_EDGES + 1).collect()
    if len(rows) > DATASET_EDGES:
        raise ValueError(f"a graph of datasets has at most {DATASET_EDGES} edges")
    near: dict[str, dict[str, float]] = {}
    for a, b, w in rows:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    sent = spark.sparkContext.broadcast(near)

    def search(batches):
        known, total, far = sent.value, {}, {}
        for batch in batches:
            for s in batch.column(0).to_pylist():
                far[s], owed = _from(known, s, weighted) if with_betweenness else (_hops(known, s), {})
                for v, x in owed.items():
                    total[v] = total.get(v, 0.0) + x
        columns = [*far, *total], [*far.values(), *(None for _ in total)], [*(0.0 for _ in far), *total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.float64()))], ["node", "far", "owed"])

    n = len(near)
    nodes = spark.createDataFrame([(x,) for x in sorted(near)], "node string").repartition(max(1, min(n, spark.sparkContext.defaultParallelism)), "node")
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return nodes.mapInArrow(search, "node string, far bigint, owed double").groupBy("node").agg(F.max("far").alias("eccentricity"), (F.sum("owed") * scale).alias("betweenness"))


def _hops(near: dict, s: str) -> int:
    depth, level, seen = 0, [s], {s}
    while True:
        level = [w for w in {w for v in level for w in near[v]} if w not in seen]
        if not level:
            return depth
        seen.update(level)
        depth += 1


def _from(near: dict, s: str, weighted: bool) -> tuple[int, dict[str, float]]:
    """(hops to the farthest node, what each node has of the lightest paths from s)."""
    cost, paths, before, order, queue = {s: 0.0}, {s: 1.0}, {s: []}, [], [(0.0, s)]
    done = set()
    while queue:
        c, v = heapq.heappop(queue)
        if v in done:
            continue
        done.add(v)
        order.append(v)
        for w, weight in near[v].items():
            further = c + weight
            if w not in cost or further < cost[w]:
                cost[w], paths[w], before[w] = further, paths[v], [v]
                heapq.heappush(queue, (further, w))
            elif further == cost[w] and w not in done:
                paths[w] += paths[v]
                before[w].append(v)
    owed = dict.fromkeys(order, 0.0)
    for w in reversed(order):
        for v in before[w]:
            owed[v] += paths[v] / paths[w] * (1 + owed[w])
    owed.pop(s)
    return _hops(near, s), owed


def hub_classes(patterns: DataFrame) -> DataFrame:
    """(class, n_datasets) of the classes in more than one dataset."""
    return class_datasets(patterns).groupBy("class").agg(F.count("*").alias("n_datasets")).where("n_datasets > 1").orderBy(F.desc("n_datasets"), "class")


def inventory(patterns: DataFrame) -> DataFrame:
    """(dataset, n_patterns, n_classes, n_typed)."""
    return patterns.groupBy("dataset").agg(F.count("*").alias("n_patterns"), F.countDistinct("subject_class").alias("n_classes"), F.count_if(~F.col("object_class").isin(*terms.SENTINELS)).alias("n_typed"))


def best_schemas(candidates: DataFrame, preferred: str = "qlever_oneshot", family: str = "qlever") -> DataFrame:
    """One of (dataset, schema_id, strategy, pattern_count) for each dataset: the preferred strategy, then its
    family, then any with patterns, then any; inside a tier the most patterns, ties by id."""
    tier = F.when(F.col("strategy") == preferred, 1).when(F.col("strategy").startswith(family), 2).when(F.col("pattern_count") > 0, 3).otherwise(4)
    best = Window.partitionBy("dataset").orderBy("tier", F.desc("pattern_count"), "schema_id")
    return candidates.withColumn("tier", tier).withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def primary_domains(keywords: DataFrame, domains: DataFrame) -> DataFrame:
    """(dataset, domain) from (dataset, position, keyword): the rarest keyword with a known domain (keyword, domain),
    else the rarest with a capital first letter, else ``Unknown``."""
    frequency = keywords.groupBy("keyword").agg(F.count("*").alias("freq"))
    ranked = keywords.join(broadcast_if_small(frequency), "keyword").join(broadcast_if_small(domains), "keyword", "left")
    known = F.min(F.when(F.col("domain").isNotNull(), F.struct("freq", "position", "domain")))
    own = F.min(F.when(F.col("keyword").isNotNull(), F.struct("freq", "position", F.concat(F.upper(F.left("keyword", F.lit(1))), F.substr("keyword", F.lit(2))).alias("domain"))))
    return ranked.groupBy("dataset").agg(F.coalesce(known["domain"], own["domain"], F.lit("Unknown")).alias("domain"))


def domain_weights(edges: DataFrame, domains: DataFrame) -> DataFrame:
    """(low, high, weight, share, within): weights between domains, their share of all to four places, and whether both are one."""
    ends = broadcast_if_small(domains)
    met = edges.join(ends.select(F.col("dataset").alias("a"), F.col("domain").alias("da")), "a").join(ends.select(F.col("dataset").alias("b"), F.col("domain").alias("db")), "b")
    found = met.groupBy(F.least("da", "db").alias("low"), F.greatest("da", "db").alias("high")).agg(F.sum("weight").alias("weight"))
    return found.crossJoin(found.agg(F.sum("weight").alias("total"))).select("low", "high", "weight", F.round(F.col("weight") / F.col("total"), 4).alias("share"), (F.col("low") == F.col("high")).alias("within"))


def domain_matrix(edges: DataFrame, domains: DataFrame) -> DataFrame:
    """A symmetric matrix: one row and one column for each domain, log(1 + weight) to six places."""
    found = domain_weights(edges, domains)
    both = found.select(F.col("low").alias("domain"), F.col("high").alias("other"), "weight").unionByName(found.where("low <> high").select(F.col("high").alias("domain"), F.col("low").alias("other"), "weight"))
    names = sorted(r.domain for r in domains.select("domain").distinct().collect())
    return both.groupBy("domain").pivot("other", names).agg(F.round(F.log1p(F.sum("weight")), 6)).na.fill(0.0)


def adjacency(edges: DataFrame, top: int = 20) -> DataFrame:
    """The matrix of weights among the ``top`` nodes by weighted degree."""
    chosen = degrees(edges).orderBy(F.desc("weighted_degree"), "node").limit(top).select("node")
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))
    names = sorted(r.node for r in chosen.collect())  # at most ``top``
    return both.where(F.col("node").isin(names) & F.col("other").isin(names)).groupBy("node").pivot("other", names).sum("weight").na.fill(0)
