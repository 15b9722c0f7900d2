"""Search over a stored index: one plan for a whole table of queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigraph.operators import dense, fusion, graph, graph_retrieval, lexical
from lexigraph.plans import corpus
from lexigraph.session import cut, ensure_checkpoint_dir, settled, together

METHODS = ["dense", "sparse", "hybrid", "hybrid_graph"]
#: Ranks of the dense list whose papers are the seeds of a query without any.
SEED_RANKS = 5


class Engine:
    """Searches over the tables of a folder that plans.build.build_index has written.

    Queries are a DataFrame (qid, query, vec); a single search is one row of it.
    vec may be null: such a query has no dense list. seeds (qid, id) are papers
    from which the graph is searched, by default those of the first ranks of the
    dense list; excluded (qid, arxiv_id) are papers that must not be found.
    """

    def __init__(self, spark: SparkSession, warehouse: str, candidates: int = 100, graph_candidates: int = 33):
        self.spark, self.warehouse = settled(spark), warehouse
        self.candidates, self.graph_candidates = candidates, graph_candidates
        self._lists: dict = {}

    def table(self, name: str) -> DataFrame:
        """A table of the index; a missing one is an error that names it."""
        return self.spark.read.parquet(f"{self.warehouse}/{name}")

    @cached_property
    def nodes(self) -> DataFrame:
        """(id, in_degree, out_degree, pagerank, community, title, published)."""
        return self.table("nodes")

    @cached_property
    def edges(self) -> DataFrame:
        return self.table("edges")

    @cached_property
    def ranks(self) -> DataFrame:
        return self.nodes.select("id", "pagerank")

    @cached_property
    def communities(self) -> DataFrame:
        return self.nodes.select("id", "community")

    @cached_property
    def chunks(self) -> DataFrame:
        """(chunk_id, arxiv_id, title, section_name, text), each chunk_id once."""
        return self.table("search_chunks")

    @cached_property
    def paper_of(self) -> DataFrame:
        return self.table("paper_of")

    def paper_queries(self) -> DataFrame:
        """(qid, query, vec): the stated papers with their title and, where there is one, the vector of their abstract."""
        papers = self.table("titles")
        titled = corpus.seeds(papers).join(papers.select("id", F.col("title").alias("query")), "id")
        vectors = self.table("paper_vectors").select("id", "vec")
        return cut(titled.where("query is not null").join(vectors, "id", "left").select("qid", "query", "vec"))

    def _once(self, name: str, queries: DataFrame, k: int, make) -> DataFrame:
        """A list of at least k for a query table, made once and written."""
        held = self._lists.get(name)
        if held is None or held[0] is not queries or held[1] < k:
            k = max(k, self.candidates)
            # the table of queries is kept with its list, so that no other one can pass for it
            self._lists[name] = held = (queries, k, cut(make(k)))
        return held[2]

    def dense(self, queries: DataFrame, k: int, excluded: DataFrame | None = None) -> DataFrame:
        """(qid, source, rank, key, arxiv_id) by cosine; excluded papers leave gaps in the ranks."""

        def make(n: int) -> DataFrame:
            asked = queries.where("vec is not null").select("qid", "vec")
            return self._text_list(dense.nearest(asked, self.table("vectors"), "chunk_id", n), "dense")

        found = self._once("dense", queries, k, make).where(F.col("rank") <= k)
        if excluded is None:
            return found
        left = found.join(excluded.select("qid", "arxiv_id"), ["qid", "arxiv_id"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
        return left.withColumn("rank", rank).select("qid", "source", "rank", "key", "arxiv_id")

    def sparse(self, queries: DataFrame, k: int, excluded: DataFrame | None = None) -> DataFrame:
        """(qid, source, rank, key, arxiv_id) by BM25 over title, section and text, without excluded papers."""

        def make(n: int) -> DataFrame:
            out = None
            if excluded is not None:
                held = self.paper_of.select(F.col("key").alias("chunk_id"), "arxiv_id")
                out = cut(excluded.join(held, "arxiv_id").select("qid", "chunk_id"))
            asked = queries.select("qid", "query")
            found = lexical.ranked(asked, self.table("parts"), self.table("limits"), "chunk_id", n, out)
            return self._text_list(found, "sparse")

        if excluded is not None:
            return make(k)
        return self._once("sparse", queries, k, make).where(F.col("rank") <= k)

    def _text_list(self, found: DataFrame, source: str) -> DataFrame:
        keyed = found.select("qid", F.lit(source).alias("source"), "rank", F.col("chunk_id").alias("key"))
        return keyed.join(self.paper_of, "key").select("qid", "source", "rank", "key", "arxiv_id")

    def _texts(self, queries: DataFrame, excluded: DataFrame | None = None) -> list[DataFrame]:
        """The dense and the sparse list, made at once."""
        ensure_checkpoint_dir(self.spark)
        n = self.candidates
        return together(lambda: self.dense(queries, n, excluded), lambda: self.sparse(queries, n, excluded))

    def seeds(self, queries: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
        """(qid, id): the papers of the first ranks of each query's dense list."""
        first = self.dense(queries, self.candidates, excluded).where(F.col("rank") <= SEED_RANKS)
        return first.where("arxiv_id is not null").select("qid", F.col("arxiv_id").alias("id")).distinct()

    def related(self, queries: DataFrame, seeds: DataFrame) -> DataFrame:
        """(qid, source, rank, key, arxiv_id): expansion, walk and community lists one after the other.

        The walk prefers papers whose abstract is like the query.
        """
        k = self.graph_candidates
        vectors = (queries.select("qid", "vec"), self.table("paper_vectors"))
        lists = [
            graph_retrieval.expansion(seeds, self.edges, k),
            graph_retrieval.expected_walk(seeds, self.edges, k=k, vectors=vectors),
            graph_retrieval.community_peers(seeds, self.communities, self.ranks, k),
        ]
        tagged = [x.select("qid", "id", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)]
        order = Window.partitionBy("qid").orderBy("list", "rank")
        return (
            tagged[0]
            .unionByName(tagged[1])
            .unionByName(tagged[2])
            .select(
                "qid",
                F.lit("graph").alias("source"),
                F.row_number().over(order).alias("rank"),
                F.col("id").alias("key"),
                F.col("id").alias("arxiv_id"),
            )
        )

    def fused(
        self, queries: DataFrame, seeds: DataFrame | None = None, excluded: DataFrame | None = None
    ) -> DataFrame:
        """All candidates of a query with their fused score; with seeds also those of the graph."""
        lists = DataFrame.unionByName(*self._texts(queries, excluded))
        if seeds is not None:
            lists = lists.unionByName(self.related(queries, seeds))
        return fusion.fused(lists)

    def search(
        self,
        queries: DataFrame,
        method: str = "hybrid_graph",
        k: int = 20,
        seeds: DataFrame | None = None,
        excluded: DataFrame | None = None,
    ) -> DataFrame:
        """(qid, rank, key, arxiv_id, score) of one of METHODS; an unknown method is an error."""
        if method == "dense":
            found = self.dense(queries, k, excluded).withColumn("score", F.lit(None).cast("double"))
        elif method == "sparse":
            found = self.sparse(queries, k, excluded).withColumn("score", F.lit(None).cast("double"))
        elif method == "hybrid":
            found = self.fused(queries, None, excluded)
        elif method == "hybrid_graph":
            if excluded is None:
                self._texts(queries)  # kept
            seeds = cut(self.seeds(queries, excluded) if seeds is None else seeds)
            found = cut(self.fused(queries, seeds, excluded))
            pairs = found.select("qid", F.col("arxiv_id").alias("id")).where("id is not null").distinct()
            near = graph_retrieval.proximity(graph.pair_distances(pairs, seeds, self.edges))
            found = fusion.graph_scored(found, self.ranks, near, seeds.select("qid").distinct())
        else:
            raise ValueError(f"method must be one of {METHODS}")
        return found.where(F.col("rank") <= k).select("qid", "rank", "key", "arxiv_id", "score")
