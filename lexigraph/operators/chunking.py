"""Cutting papers into chunks of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.functions.text import sanitized_name, word_count, words

# Chunk size, overlap and least size in words.
SIZE = 512
OVERLAP = 102
LEAST = 50
PARAGRAPH_LEAST = 10
SKIPPED = ["references", "reference", "bibliography"]


def _windows(w: Column, text: Column, size: int, overlap: int) -> Column:
    step = size - overlap
    count = F.ceil((F.size(w) - overlap) / step).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
        lambda i: F.array_join(F.slice(w, i * step + 1, size), " "),
    )
    return F.when(F.size(w) > size, cut).otherwise(F.array(text))


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Overlapping word windows; up to `size` words the text as it is, '' for none.

    The last window ends with the text: ceil((n - overlap) / (size - overlap))
    windows for n > size words.
    """
    return _windows(words(text), text, size, overlap)


def word_windows(documents: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece, text): the windows of each text; its words are a column of their own, split once."""
    split = documents.where(F.col(text).isNotNull()).select(key, text, words(F.col(text)).alias("_w"))
    return split.select(key, F.posexplode(_windows(F.col("_w"), F.col(text), size, overlap)).alias("piece", "text"))


def paragraphs(text: Column, delimiter: str = r"\n\s*\n") -> Column:
    """Paragraphs of at least ten words; the whole text if there are none."""
    parts = F.filter(
        F.transform(F.split(text, delimiter), lambda x: F.trim(x)), lambda p: word_count(p) >= PARAGRAPH_LEAST
    )
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def merged_paragraphs(
    text: Column, size: int = SIZE, overlap: int = OVERLAP, delimiter: str = r"\n\s*\n"
) -> Column:
    """Chunks of whole paragraphs, each starting with the last words of the one before.

    A fold over the paragraphs: one that would exceed `size` closes the chunk. A
    single longer paragraph is never split; a last chunk under 50 words is dropped.
    """
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(acc: Column, p: Column) -> Column:
        cur, out = acc["cur"], acc["out"]
        full = (word_count(cur) + word_count(p) > size) & (cur != "")
        tail = F.array_join(F.slice(words(cur), -F.least(F.size(words(cur)), F.lit(overlap)), overlap), " ")
        return F.struct(
            F.when(full, F.array_append(out, cur)).otherwise(out).alias("out"),
            F.when(full, F.concat(tail, F.lit("\n\n"), p))
            .when(cur == "", p)
            .otherwise(F.concat(cur, F.lit("\n\n"), p))
            .alias("cur"),
        )

    def finish(acc: Column) -> Column:
        return F.when(
            word_count(acc["cur"]) >= LEAST, F.array_append(acc["out"], acc["cur"])
        ).otherwise(acc["out"])

    return F.aggregate(paragraphs(text, delimiter), empty, step, finish)


def chunks(extracted: DataFrame) -> DataFrame:
    """(arxiv_id, chunk_id, section_name, chunk_type, position, text) of extracted papers.

    The abstract (50 words and more), then each section of 50 words and more but
    reference lists: whole up to 512 words, else merged paragraphs. A paper
    without any such chunk is cut into word windows of all its text. Ids that
    come again in a paper get the suffix _2, _3 and so on, but an abstract and a
    section 'Abstract' share theirs. One row per arxiv_id is expected.
    """
    section = F.posexplode_outer("sections")
    per_section = extracted.select("arxiv_id", section.alias("ord", "s")).where("s is not null")
    usable = per_section.select("arxiv_id", "ord", "s.name", F.col("s.text").alias("text")).where(
        (word_count(F.col("text")) >= LEAST)
        & ~F.coalesce(F.lower(F.trim("name")), F.lit("")).isin(SKIPPED)
    )
    long = word_count(F.col("text")) > SIZE
    pieces = usable.select(
        "arxiv_id",
        "ord",
        F.coalesce("name", F.lit("")).alias("section_name"),
        F.when(long, F.lit("paragraph")).otherwise(F.lit("section")).alias("chunk_type"),
        F.posexplode(F.when(long, merged_paragraphs(F.col("text"))).otherwise(F.array("text"))).alias(
            "piece", "text"
        ),
    )
    name = sanitized_name(F.col("section_name"))
    base = F.concat_ws(
        "_", "arxiv_id", name, F.when(F.col("chunk_type") == "paragraph", F.concat(F.lit("p"), "piece"))
    )
    again = Window.partitionBy("arxiv_id", "base").orderBy("ord", "piece")
    ordered = Window.partitionBy("arxiv_id").orderBy("ord", "piece")
    has_abstract = word_count(F.col("abstract")) >= LEAST
    abstracts = extracted.where(has_abstract).select(
        "arxiv_id",
        F.concat("arxiv_id", F.lit("_abstract")).alias("chunk_id"),
        F.lit("Abstract").alias("section_name"),
        F.lit("abstract").alias("chunk_type"),
        F.lit(0).alias("position"),
        F.trim("abstract").alias("text"),
    )
    shift = extracted.select("arxiv_id", has_abstract.cast("int").alias("shift"))
    bodies = (
        pieces.withColumn("base", base)
        .withColumn("nth", F.row_number().over(again))
        .withColumn("at", F.row_number().over(ordered))
        .join(shift, "arxiv_id")
        .select(
            "arxiv_id",
            F.when(F.col("nth") == 1, F.col("base"))
            .otherwise(F.concat_ws("_", "base", F.col("nth")))
            .alias("chunk_id"),
            "section_name",
            "chunk_type",
            (F.col("at") - 1 + F.coalesce("shift", F.lit(0))).cast("int").alias("position"),
            "text",
        )
    )
    made = abstracts.unionByName(bodies)
    everything = F.concat_ws(
        "\n\n", "abstract", F.array_join(F.transform("sections", lambda s: s["text"]), "\n\n")
    )
    bare = (
        extracted.join(made.select("arxiv_id").distinct(), "arxiv_id", "left_anti")
        .select("arxiv_id", F.posexplode(windows(everything)).alias("position", "text"))
        .where(F.trim("text") != "")
        .select(
            "arxiv_id",
            F.concat_ws("_chunk_", "arxiv_id", "position").alias("chunk_id"),
            F.lit("Full Text").alias("section_name"),
            F.lit("text").alias("chunk_type"),
            "position",
            "text",
        )
    )
    return made.unionByName(bare)


def with_metadata(made: DataFrame, papers: DataFrame) -> DataFrame:
    """chunks with paper_title, authors and published of their paper ('' and no authors where it is unknown), and the text to embed.

    papers has (arxiv_id, title, authors, published), each arxiv_id once.
    """
    known = papers.select(
        "arxiv_id", F.trim("title").alias("paper_title"), "authors", "published"
    )
    none = F.array().cast("array<string>")
    joined = made.join(known, "arxiv_id", "left").withColumns(
        {
            "paper_title": F.coalesce("paper_title", F.lit("")),
            "authors": F.coalesce("authors", none),
            "published": F.coalesce("published", F.lit("")),
        }
    )
    return joined.withColumn("embedding_text", embedding_text("paper_title", "section_name", "text"))


def embedding_text(title: str, section: str, text: str) -> Column:
    """What an encoder gets of a chunk: its title and section, then its text."""
    return F.concat(F.lit("Title: "), title, F.lit("\nSection: "), section, F.lit("\n"), text)
