"""Building the index: every derived table once, as Parquet in a warehouse folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions.text import normalized_title
from lexigraph.operators import chunking, dense, extraction, graph, lexical
from lexigraph.plans import corpus
from lexigraph.session import ensure_checkpoint_dir, settled, spread, together
from lexigraph.sources.tables import read_table, write_table


def build_corpus(spark: SparkSession, sf_dir: str, warehouse: str) -> list[str]:
    """Write what is made of the extracted papers (each arxiv_id once): refs, cited, citation_summary and chunks.

    Chunks carry title, authors and date of their paper, and the text to embed.
    """
    settled(spark)
    extracted = read_table(
        spark, sf_dir, "extracted", "arxiv_id", "abstract", "sections", "references_text"
    ).where("arxiv_id is not null")
    one = extracted.dropDuplicates(["arxiv_id"])
    write_table(extraction.parsed_references(one), warehouse, "refs")
    refs = spark.read.parquet(f"{warehouse}/refs")
    titles = read_table(spark, sf_dir, "papers", "arxiv_id", "title")
    write_table(extraction.citation_edges(refs, titles, normalized_title), warehouse, "cited")
    cited = spark.read.parquet(f"{warehouse}/cited")
    write_table(extraction.citation_summary(refs, cited), warehouse, "citation_summary")
    described = chunking.with_metadata(chunking.chunks(one), corpus.metadata(spark, sf_dir))
    write_table(described, warehouse, "chunks")
    return ["refs", "cited", "citation_summary", "chunks"]


def _stored(spark: SparkSession, df: DataFrame, warehouse: str, name: str) -> DataFrame:
    write_table(df, warehouse, name)
    return spark.read.parquet(f"{warehouse}/{name}")


def build_graph(spark: SparkSession, sf_dir: str, warehouse: str) -> list[str]:
    """Write the citation graph: edges, and nodes with degrees, rank, community and title."""
    settled(spark)
    nodes, edges = corpus.graph_tables(spark, sf_dir)
    edges = _stored(spark, edges, warehouse, "edges")
    ranks, communities = together(lambda: graph.pagerank(nodes, edges), lambda: graph.communities(nodes, edges))
    described = (
        graph.degrees(nodes, edges)
        .join(ranks, "id")
        .join(communities, "id")
        .join(corpus.papers(spark, sf_dir), "id", "left")
    )
    write_table(described, warehouse, "nodes")
    return ["edges", "nodes"]


def build_texts(spark: SparkSession, sf_dir: str, warehouse: str) -> list[str]:
    """Write what searches without the graph read.

    titles are those of the papers; search_chunks has each chunk_id once; parts
    are the score-ready postings and limits their terms; vectors and
    paper_vectors are the usable vectors of chunks and of abstracts.
    """
    settled(spark)

    def stored(df: DataFrame, name: str) -> DataFrame:
        return _stored(spark, df, warehouse, name)

    def ranked_texts() -> DataFrame:
        rows = read_table(spark, sf_dir, "chunks", "chunk_id", "arxiv_id", "paper_title", "section_name", "text")
        chunks = stored(
            rows.where("chunk_id is not null").groupBy("chunk_id").agg(
                F.max("arxiv_id").alias("arxiv_id"),
                F.max("paper_title").alias("title"),
                F.max("section_name").alias("section_name"),
                F.max("text").alias("text"),
            ),
            "search_chunks",
        )
        parts = [F.coalesce(c, F.lit("")) for c in ("title", "section_name", "text")]
        docs = chunks.select("chunk_id", F.concat_ws(" ", *parts).alias("text"))
        posts = stored(lexical.postings(docs, "chunk_id", F.col("text")), "postings")
        size = stored(lexical.corpus_size(docs.select("chunk_id"), posts), "size")
        idf = stored(lexical.weights(posts, size), "limits")
        stored(lexical.impacts(posts, size, "chunk_id", idf), "parts")
        return chunks

    def usable_vectors() -> None:
        vectors = read_table(spark, sf_dir, "vector_index", "chunk_id", "embedding")
        usable = stored(dense.unit_vectors(spread(vectors), "chunk_id").dropDuplicates(["chunk_id"]), "vectors")
        of_paper = usable.where(F.col("chunk_id").endswith("_abstract"))
        stored(of_paper.select(F.regexp_replace("chunk_id", "_abstract$", "").alias("id"), "vec"), "paper_vectors")

    chunks, *_ = together(ranked_texts, usable_vectors, lambda: stored(corpus.papers(spark, sf_dir), "titles"))
    both = read_table(spark, sf_dir, "vector_index", "chunk_id", "arxiv_id").unionByName(
        chunks.select("chunk_id", "arxiv_id")
    )
    stored(both.groupBy(F.col("chunk_id").alias("key")).agg(F.max("arxiv_id").alias("arxiv_id")), "paper_of")
    return ["titles", "search_chunks", "postings", "size", "parts", "limits", "vectors", "paper_vectors", "paper_of"]


def build_search(spark: SparkSession, sf_dir: str, warehouse: str) -> list[str]:
    """Write the tables that plans.engine.Engine searches."""
    ensure_checkpoint_dir(spark)
    halves = together(lambda: build_graph(spark, sf_dir, warehouse), lambda: build_texts(spark, sf_dir, warehouse))
    return halves[0] + halves[1]


def build_index(spark: SparkSession, sf_dir: str, warehouse: str) -> dict[str, str]:
    """Write all tables and return their paths by name."""
    names = build_corpus(spark, sf_dir, warehouse) + build_search(spark, sf_dir, warehouse)
    return {name: f"{warehouse}/{name}" for name in names}


_built: dict[tuple[str, str], str] = {}
_done: set[tuple[str, str]] = set()


def search_index(spark: SparkSession, sf_dir: str, with_graph: bool = True) -> str:
    """The folder of a search index of sf_dir in the shared checkpoint folder, each half of it built once an application.

    Searches without the graph need but the texts.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        ensure_checkpoint_dir(spark)
        _built[key] = f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4()}"
    path = _built[key]
    halves = {"texts": build_texts} | ({"graph": build_graph} if with_graph else {})

    def made(name: str) -> None:
        if (path, name) not in _done:
            halves[name](spark, sf_dir, path)
            _done.add((path, name))

    together(*[lambda name=name: made(name) for name in halves])
    return path


def add_vectors(spark: SparkSession, warehouse: str, new: DataFrame) -> str:
    """Upsert (chunk_id, embedding) rows into the stored vectors; repeated ids count once.

    Written once, beside the old table, whose place it takes when it is whole.
    """
    old = spark.read.parquet(f"{warehouse}/vectors")
    fresh = dense.unit_vectors(new, "chunk_id").dropDuplicates(["chunk_id"])
    next_name = f"vectors-{uuid.uuid4()}"
    write_table(dense.upserted(old, fresh, "chunk_id"), warehouse, next_name)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = path(f"{warehouse}/vectors")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.rename(target, path(f"{warehouse}/{next_name}-old"))
    fs.rename(path(f"{warehouse}/{next_name}"), target)
    fs.delete(path(f"{warehouse}/{next_name}-old"), True)
    return f"{warehouse}/vectors"
