"""The citation graph as tables: edges, ranks, components, communities, distances."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.session import cut

# Fixed value: damping of the rank.
DAMPING = 0.85


def known_edges(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst) whose cited paper is a node (id). The citing side may be any paper."""
    return pairs.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def all_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): the nodes and every citing paper that isn't one."""
    return nodes.select("id").unionByName(edges.select(F.col("src").alias("id"))).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree), 0 where a node has no edge. Both sides in one shuffle."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        ).alias("e")
    ).select("e.*")
    zero = nodes.select("id", F.lit(0).alias("i"), F.lit(0).alias("o"))
    return (
        ends.unionByName(zero)
        .groupBy("id")
        .agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    )


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected neighbours (src, dst) without self-loops."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.unionByName(back).where("src <> dst").distinct()


def pagerank(
    nodes: DataFrame, edges: DataFrame, tolerance: float = 1e-6, most: int = 100, piece: int = 1000
) -> DataFrame:
    """(id, pagerank): power iteration until the ranks change by less than nodes * tolerance in all.

    The mass of dangling nodes is spread evenly. Each round is one join on src
    and one aggregation on dst, and is cut. A node of more than `piece` edges
    has its rank repeated per piece, so that its edges are spread over as many
    tasks. An iteration that has not settled after `most` rounds is an error.
    """
    n = max(1, nodes.count())
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    pieces = F.ceil(F.col("out") / piece)
    links = cut(
        edges.join(out, "src").select(
            "src", "dst", "out", F.pmod(F.xxhash64("dst", F.lit(3)), pieces).alias("piece")
        )
    )
    ranks = cut(
        nodes.join(out.select(F.col("src").alias("id"), "out"), "id", "left").select(
            "id", "out", F.lit(1.0 / n).alias("before"), F.lit(1.0 / n).alias("pagerank")
        )
    )
    moved = F.sum(F.abs(F.col("pagerank") - F.col("before"))).alias("moved")
    lost = F.sum(F.when(F.col("out").isNull(), F.col("pagerank"))).alias("lost")
    state = ranks.agg(moved, lost).first()
    for _ in range(most):
        spread = ranks.where("out is not null").select(
            F.col("id").alias("src"), "pagerank", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)).alias("piece")
        )
        given = (
            links.join(spread, ["src", "piece"])
            .groupBy(F.col("dst").alias("id"))
            .agg(F.sum(F.col("pagerank") / F.col("out")).alias("got"))
        )
        base = (1 - DAMPING) / n + DAMPING * (state["lost"] or 0.0) / n
        ranks = cut(
            ranks.select("id", "out", F.col("pagerank").alias("before"))
            .join(given, "id", "left")
            .select("id", "out", "before", (F.lit(base) + DAMPING * F.coalesce("got", F.lit(0.0))).alias("pagerank"))
        )
        state = ranks.agg(moved, lost).first()  # two numbers
        if (state["moved"] or 0.0) < n * tolerance:
            return ranks.select("id", "pagerank")
    raise RuntimeError(f"ranks have not settled after {most} rounds")


def top_ranked(ranks: DataFrame, papers: DataFrame, k: int = 20) -> DataFrame:
    """(id, pagerank, title): the k papers of largest rank; ties go to the smaller id."""
    best = ranks.withColumn("pagerank", F.round("pagerank", 9)).orderBy(F.desc("pagerank"), "id").limit(k)
    return best.join(papers.select("id", "title"), "id", "left")


def components(nodes: DataFrame, edges: DataFrame, most: int = 1000) -> DataFrame:
    """(id, component): the smallest id of each undirected component.

    Labels jump: each round a node takes the smallest label around it and then
    the label of that label, so long paths shrink by powers of two. Labels that
    have not settled after `most` rounds are an error.
    """
    around = cut(both_ways(edges))
    labels = cut(nodes.select("id", F.col("id").alias("component")))
    for _ in range(most):
        near = (
            around.join(labels, around.dst == labels.id)
            .groupBy(F.col("src").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "id", "left").select(
            "id", "component", F.least("component", "near").alias("next")
        )
        jump = step.select(F.col("id").alias("next"), F.col("next").alias("jump"))
        moved = cut(
            step.join(jump, "next", "left").select(
                "id", "component", F.least("next", "jump").alias("next")
            )
        )
        changed = moved.where("component <> next").limit(1).count()
        labels = moved.select("id", F.col("next").alias("component"))
        if not changed:
            return labels
    raise RuntimeError(f"labels have not settled after {most} rounds")


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community) by synchronous label propagation; ties go to the smallest label.

    A node's own label has one vote. A fixed number of rounds; the partition is
    deterministic and is not that of modularity methods.
    """
    around = cut(both_ways(edges).unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))))
    labels = cut(nodes.select("id", F.col("id").alias("community")))
    best = Window.partitionBy("id").orderBy(F.desc("votes"), "community")
    for _ in range(rounds):
        votes = (
            around.join(labels, around.dst == labels.id)
            .groupBy(F.col("src").alias("id"), "community")
            .agg(F.count(F.lit(1)).alias("votes"))
        )
        labels = cut(
            votes.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("id", "community")
        )
    return labels


def in_blocks(
    asked: DataFrame, links: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str, a_block: int
) -> DataFrame:
    """search(rows of some queries, all links) for blocks of about a_block queries, each in one task.

    asked has a qid; links, which every block reads whole, should be numbers.
    They are packed before they are repeated, thousands to a row, so that no
    block costs a row a link in the shuffle and its sort.
    """
    queries = asked.select("qid").distinct().count()
    cores = asked.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-queries // a_block), min(cores, queries // 8))
    # more partitions than blocks, so that few blocks share one
    q = asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(n)).cast("int")).repartition(3 * n, "block")
    packed = links.mapInArrow(_packed, "rows binary")
    every = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(3 * n, "block")

    def unpacked(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in right["rows"]]
        return search(left, pa.concat_tables(tables) if tables else right)

    return q.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(unpacked, schema)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every batch of rows as one binary value."""
    for batch in batches:
        if batch.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.record_batch({"rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def numbered(around: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, no) of the nodes of symmetric links (src, dst, ...) in the order of their ids, and the links between numbers."""
    nodes = around.select(F.col("src").alias("id")).distinct()
    ids = cut(nodes.orderBy("id").withColumn("no", F.monotonically_increasing_id()))
    links = around.join(ids.select(F.col("id").alias("src"), F.col("no").alias("a")), "src").join(
        ids.select(F.col("id").alias("dst"), F.col("no").alias("b")), "dst"
    )
    return ids, cut(links.drop("src", "dst"))


def indexed(links: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of symmetric links (a, b): the nodes; the order of links by b, the places of their a among the nodes, and where each b begins."""
    a, b = links["a"].to_numpy(), links["b"].to_numpy()
    order = np.argsort(b, kind="stable")
    nodes, starts = np.unique(b[order], return_index=True)
    return nodes, order, np.searchsorted(nodes, a[order]), starts


def placed(nodes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The places of numbers, all of which are nodes, among the nodes."""
    return np.searchsorted(nodes, numbers)


def _levels(seeds: DataFrame, edges: DataFrame, depth: int | None, wanted: DataFrame | None = None) -> DataFrame:
    """(qid, id, distance) above 0 from the seeds; of the wanted pairs (qid, id) only, if they are given.

    A block of queries goes through the graph together, one bit a query and
    node, until nothing new is reached.
    """
    ids, links = numbered(both_ways(edges))
    asked = seeds.select("qid", "id", F.lit(True).alias("seed"))
    if wanted is not None:
        asked = asked.unionByName(wanted.select("qid", "id", F.lit(False).alias("seed")))
    asked = cut(asked.distinct().join(ids, "id").select("qid", "no", "seed"))
    every = wanted is None

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        qids = left["qid"].combine_chunks().dictionary_encode()
        rows, places, levels = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        numbers = np.empty(0, np.int64)
        if len(left) and len(right):
            numbers, _, source, starts = indexed(right)
            code, seed = qids.indices.to_numpy(), left["seed"].to_numpy(zero_copy_only=False)
            at = placed(numbers, left["no"].to_numpy())
            reached = np.zeros((len(numbers), -(-len(qids.dictionary) // 64)), "<u8")
            np.bitwise_or.at(reached, (at[seed], code[seed] // 64), np.uint64(1) << (code[seed] % 64).astype("<u8"))
            others, near = np.flatnonzero(~seed), np.zeros(len(left), np.int32)
            front, d = reached, 0
            while depth is None or d < depth:
                d += 1
                front = np.bitwise_or.reduceat(front[source], starts, axis=0) & ~reached
                if not front.any():
                    break
                reached = reached | front
                if every:
                    some = np.flatnonzero(front.any(axis=1))
                    bits = np.unpackbits(front[some].view(np.uint8), axis=1, bitorder="little")
                    i, q = np.nonzero(bits)
                    rows.append(q)
                    places.append(some[i])
                    levels.append(np.full(len(q), d, np.int32))
                else:
                    word = front[at[others], code[others] // 64] >> (code[others] % 64).astype("<u8")
                    near[others[(word & np.uint64(1)) == 1]] = d
            if not every:
                hit = np.flatnonzero(near)
                rows, places, levels = [code[hit].astype(np.int64)], [at[hit]], [near[hit]]
        return pa.table(
            {
                "qid": qids.dictionary.take(pa.array(np.concatenate(rows))),
                "no": pa.array(numbers[np.concatenate(places)]),
                "distance": pa.array(np.concatenate(levels), pa.int32()),
            }
        )

    kind = asked.schema["qid"].dataType.simpleString()
    found = in_blocks(asked, links, search, f"qid {kind}, no bigint, distance int", 128)
    return found.join(ids, "no").select("qid", "id", "distance")


def distances(seeds: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(qid, id, distance): undirected distances from the seeds (qid, id), up to depth if one is given."""
    start = seeds.select("qid", "id").distinct()
    return start.withColumn("distance", F.lit(0)).unionByName(_levels(start, edges, depth))


def pair_distances(pairs: DataFrame, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, id, distance): of each pair (qid, id) the smallest distance to a seed of its query; unreachable pairs are missing."""
    s, wanted = seeds.select("qid", "id").distinct(), pairs.select("qid", "id").distinct()
    lone = wanted.join(s, ["qid", "id"], "left_semi").withColumn("distance", F.lit(0))
    return lone.unionByName(_levels(s, edges, None, wanted.join(s, ["qid", "id"], "left_anti")))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, average and largest degrees, components, largest component."""
    deg = degrees(nodes, edges).agg(
        F.count(F.lit(1)).alias("nodes"),
        F.sum("in_degree").alias("edges"),
        F.avg("in_degree").alias("avg_in_degree"),
        F.max("in_degree").alias("max_in_degree"),
        F.max("out_degree").alias("max_out_degree"),
    )
    parts = components(nodes, edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    whole = parts.agg(F.count(F.lit(1)).alias("components"), F.max("size").alias("largest_component"))
    n = F.col("nodes")
    return deg.join(F.broadcast(whole), how="cross").withColumn(  # one row each
        "density", F.when(n > 1, F.col("edges") / (n * (n - 1))).otherwise(F.lit(0.0))
    )
