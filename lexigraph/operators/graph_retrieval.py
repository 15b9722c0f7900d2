"""Finding papers through the citation graph, for many queries at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.operators.dense import matrix
from lexigraph.operators.graph import both_ways, in_blocks, indexed, numbered, placed
from lexigraph.session import cut

# Scores of cited, citing and second-hop papers; how many cited papers are followed.
CITED, CITING, SECOND = 0.8, 0.7, 0.4
FOLLOWED = 5
# Steps of a walk, and the weights of neighbours without a usable similarity.
STEPS, FLOOR, UNKNOWN = 5, 0.01, 0.1


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best (qid, id, score) of each query with their rank; ties go to the smaller id."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def expansion(seeds: DataFrame, edges: DataFrame, k: int = 33) -> DataFrame:
    """(qid, id, score, rank): papers cited by, citing and two steps from the seeds.

    The second step goes on from the first FOLLOWED cited papers by id. A paper
    keeps its best score; seeds are left out.
    """
    s = seeds.select("qid", F.col("id").alias("seed")).distinct()
    out = s.join(edges, s.seed == edges.src).select("qid", "seed", F.col("dst").alias("id"))
    into = s.join(edges, s.seed == edges.dst).select("qid", F.col("src").alias("id"))
    order = Window.partitionBy("qid", "seed").orderBy("id")
    first = out.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= FOLLOWED)
    second = first.select("qid", F.col("id").alias("mid")).join(edges, F.col("mid") == edges.src)
    found = (
        out.select("qid", "id", F.lit(CITED).alias("score"))
        .unionByName(into.select("qid", "id", F.lit(CITING).alias("score")))
        .unionByName(second.select("qid", F.col("dst").alias("id"), F.lit(SECOND).alias("score")))
        .groupBy("qid", "id")
        .agg(F.max("score").alias("score"))
    )
    fresh = found.join(s.withColumnRenamed("seed", "id"), ["qid", "id"], "left_anti")
    return top(fresh, k)


def community_peers(seeds: DataFrame, membership: DataFrame, ranks: DataFrame, k: int = 33) -> DataFrame:
    """(qid, id, score, rank): other members of the seeds' communities by PageRank over the best one's.

    membership has (id, community), ranks (id, pagerank). The k best members of
    each community (and one more per seed) are found once, not once per query.
    """
    s = seeds.select("qid", "id").distinct()
    of_seed = s.join(membership, "id").select("qid", "community").distinct()
    most = s.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    order = Window.partitionBy("community").orderBy(F.desc("pagerank"), "id")
    best = (
        membership.join(ranks, "id")
        .withColumn("_r", F.row_number().over(order))
        .join(F.broadcast(most), how="cross")  # one row
        .where(F.col("_r") <= k + F.col("n"))
    )
    peers = of_seed.join(best, "community").join(s, ["qid", "id"], "left_anti")
    scored = peers.select(
        "qid", "id", (F.col("pagerank") / F.max("pagerank").over(Window.partitionBy("qid"))).alias("score")
    )
    return top(scored, k)


def expected_walk(
    seeds: DataFrame,
    edges: DataFrame,
    likeness: DataFrame | None = None,
    k: int = 33,
    steps: int = STEPS,
    vectors: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """(qid, id, score, rank): expected visits of a random walk, a visit at step i counting 1/(i+1).

    The exact expectation of walks from a random seed over both edge directions
    (a pair that cites each other counts twice), normalised by the best; seeds
    score nothing. Neighbours are taken alike, or with likeness (qid, id,
    cosine) in proportion to their cosine with the query, FLOOR at least; a
    paper that likeness lacks counts UNKNOWN, and queries it lacks walk
    uniformly. vectors, unit vectors (qid, vec) of queries and (id, vec) of
    papers, stand for the cosines of all their pairs, which are worked out in
    the blocks, so that no row stands for a query and a paper.

    A block of queries walks together: a step multiplies the mass by the links,
    which are the same for all queries, and then by the weight of the paper it
    reached. Only the k best of each query leave the block.
    """
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    pairs = edges.unionByName(back).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("m"))
    ids, links = numbered(cut(pairs))
    none, no_vec = F.lit(None).cast("double"), F.lit(None).cast("array<double>")
    asked = seeds.select("qid", "id").distinct().join(ids, "id").select("qid", "no", none.alias("cosine"), F.lit(True).alias("seed"))
    asked, links = asked.withColumn("vec", no_vec), links.withColumn("vec", no_vec)
    if likeness is not None:
        # a cosine of papers without links tells only that the query has some
        like = likeness.join(ids, "id", "left").join(seeds.select("qid").distinct(), "qid", "left_semi")
        asked = asked.unionByName(like.select("qid", "no", "cosine", F.lit(False).alias("seed"), no_vec.alias("vec")))
    if vectors is not None:
        mine = vectors[0].where("vec is not null").join(seeds.select("qid").distinct(), "qid", "left_semi")
        no_link = F.lit(None).cast("bigint")
        asked = asked.unionByName(mine.select("qid", no_link.alias("no"), none.alias("cosine"), F.lit(False).alias("seed"), "vec"))
        held = vectors[1].join(ids, "id").select(F.col("no").alias("a"), no_link.alias("b"), none.alias("m"), "vec")
        links = links.unionByName(held)
    asked = cut(asked)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        qids = left["qid"].combine_chunks().dictionary_encode()
        whose, places, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        numbers = np.empty(0, np.int64)
        held = right.filter(right["vec"].is_valid()) if len(right) else right
        right = right.filter(right["vec"].is_null()) if len(right) else right
        if len(left) and len(right):
            numbers, order, source, starts = indexed(right)
            times = right["m"].to_numpy()[order][:, None]
            stops = np.append(starts[1:], len(source))
            code, seed = qids.indices.to_numpy(), left["seed"].to_numpy(zero_copy_only=False)
            linked = left["no"].is_valid().to_numpy()
            at = placed(numbers, left["no"].fill_null(0).to_numpy())
            weight = np.ones((len(numbers), len(qids.dictionary)))
            weight[:, code[~seed]] = UNKNOWN
            known = ~seed & linked & left["cosine"].is_valid().to_numpy()
            weight[at[known], code[known]] = np.maximum(left["cosine"].to_numpy()[known], FLOOR)
            given = left["vec"].is_valid()
            if len(held) and given.to_numpy().any():
                cosines = matrix(held["vec"]) @ matrix(left["vec"].filter(given)).T
                where = np.ix_(placed(numbers, held["a"].to_numpy()), code[given.to_numpy()])
                weight[where] = np.maximum(np.round(cosines, 9), FLOOR)
            step = max(1, 64_000 // weight.shape[1])

            def moved(mass: np.ndarray) -> np.ndarray:
                got, i = np.empty_like(mass), 0
                while i < len(starts):  # so many links at once that their masses stay in the cache
                    j = max(i + 1, int(np.searchsorted(stops, starts[i] + step, "right")))
                    span = slice(starts[i], stops[j - 1])
                    got[i:j] = np.add.reduceat(mass[source[span]] * times[span], starts[i:j] - starts[i], axis=0)
                    i = j
                return got

            every = moved(weight)
            mass, visits = np.zeros_like(weight), np.zeros_like(weight)
            mass[at[seed], code[seed]] = 1
            for i in range(steps):
                mass = moved(mass / every) * weight
                visits += mass / (i + 1)
            visits[at[seed], code[seed]] = 0
            for q in range(visits.shape[1]):
                found = np.flatnonzero(visits[:, q])
                score = np.round(visits[found, q] / visits[:, q].max(initial=0), 9) if len(found) else np.empty(0)
                first = np.argsort(-score, kind="stable")[:k]
                whose.append(np.full(len(first), q))
                places.append(found[first])
                scores.append(score[first])
        return pa.table(
            {
                "qid": qids.dictionary.take(pa.array(np.concatenate(whose))),
                "no": pa.array(numbers[np.concatenate(places)]),
                "score": pa.array(np.concatenate(scores), pa.float64()),
            }
        )

    kind = asked.schema["qid"].dataType.simpleString()
    best = in_blocks(asked, links, search, f"qid {kind}, no bigint, score double", 64)
    return top(best.join(ids, "no").select("qid", "id", "score"), k)


def proximity(distances: DataFrame) -> DataFrame:
    """(qid, id, proximity): 1 / (1 + smallest distance above 0); a seed alone has none."""
    return (
        distances.where("distance > 0")
        .groupBy("qid", "id")
        .agg((1 / (1 + F.min("distance"))).alias("proximity"))
    )


def neighbour_lists(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, side, neighbour): the papers that each of ids cites ('cites') and is cited by ('cited_by'), a row each."""
    wanted = ids.select("id").distinct()
    out = wanted.join(edges, wanted.id == edges.src).select("id", F.lit("cites").alias("side"), F.col("dst").alias("neighbour"))
    into = wanted.join(edges, wanted.id == edges.dst).select("id", F.lit("cited_by").alias("side"), F.col("src").alias("neighbour"))
    return out.unionByName(into)


def citation_view(
    ids: DataFrame, edges: DataFrame, membership: DataFrame, ranks: DataFrame, papers: DataFrame, members: int = 20
) -> DataFrame:
    """(id, side, neighbour, title, pagerank): the neighbours of each of ids and some members of its community.

    'community' lists the first `members` others by id. Titles that papers (id,
    title) lack are 'Unknown', ranks that ranks lack 0.
    """
    order = Window.partitionBy("community").orderBy("neighbour")
    # one more, as a paper is no neighbour of its own
    first = (
        membership.select(F.col("id").alias("neighbour"), "community")
        .withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= members + 1)
    )
    own = ids.select("id").distinct().join(membership, "id").join(first, "community").where("id <> neighbour")
    place = F.row_number().over(Window.partitionBy("id").orderBy("neighbour"))
    peers = own.withColumn("_r", place).where(F.col("_r") <= members)
    every = neighbour_lists(ids, edges).unionByName(peers.select("id", F.lit("community").alias("side"), "neighbour"))
    about = papers.select(F.col("id").alias("neighbour"), "title")
    return (
        every.join(about, "neighbour", "left")
        .join(ranks.select(F.col("id").alias("neighbour"), "pagerank"), "neighbour", "left")
        .select(
            "id",
            "side",
            "neighbour",
            F.coalesce("title", F.lit("Unknown")).alias("title"),
            F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"),
        )
    )


def looked_up(
    asked: DataFrame, papers: DataFrame, degrees: DataFrame, ranks: DataFrame, membership: DataFrame
) -> DataFrame:
    """(asked, id, title, citations, pagerank, community) for every asked id that is known, with or without version.

    papers has (id, title). An id that is known as it stands is itself, else it is its part before a 'v'.
    """
    ids = asked.select("asked").distinct()
    known = papers.select("id", "title")
    exact = ids.join(known, ids.asked == known.id)
    rest = ids.join(exact.select("asked"), "asked", "left_anti").withColumn("id", F.get(F.split("asked", "v"), F.lit(0)))
    found = exact.unionByName(rest.join(known, "id").select("asked", "id", "title"))
    return (
        found.join(degrees.select("id", F.col("in_degree").alias("citations")), "id", "left")
        .join(ranks.select("id", "pagerank"), "id", "left")
        .join(membership, "id", "left")
        .select(
            "asked",
            "id",
            "title",
            F.coalesce("citations", F.lit(0).cast("bigint")).alias("citations"),
            F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"),
            "community",
        )
    )


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, cited, citing, either): how many papers each paper is linked to."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("cited"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("citing"))
    either = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("either"))
    zero = F.lit(0).cast("bigint")
    return (
        either.join(out, "id", "full")
        .join(into, "id", "full")
        .select(
            "id",
            F.coalesce("cited", zero).alias("cited"),
            F.coalesce("citing", zero).alias("citing"),
            F.coalesce("either", zero).alias("either"),
        )
    )
