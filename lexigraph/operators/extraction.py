"""From the text of a paper to title, abstract, sections and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headings that open a section, with an optional number before them.
HEADINGS = [
    "abstract",
    "introduction",
    r"related\s+work",
    "background",
    "method(s|ology)?",
    "approach",
    r"model(\s+architecture)?",
    r"experiment(s|al\s+(setup|results))?",
    r"results?(\s+and\s+(discussion|analysis))?",
    "discussion",
    "analysis",
    "evaluation",
    "conclusions?",
    r"future\s+work",
    "limitations?",
    "references?|bibliography",
    r"appendix(\s+[a-z])?",
    "acknowledgements?",
]
_HEADING = r"(?i)^(\d+\.?\s+)?(" + "|".join(HEADINGS) + r")\s*$"
# Fixed value: a numbered title of at most two levels and 79 characters.
_NUMBERED = r"^\d+(\.\d+)?\s+\S.{0,78}$"
# The abstract after its heading up to a blank line or the introduction, else up to certain words.
_ABSTRACTS = [
    r"(?is)abstract[.\s\-—]*\n(.*?)(?:\n\s*\n|\n(?:\d+\.?\s+)?introduction)",
    r"(?is)abstract[.\s\-—]*(.*?)(?:(?:\d+\.?\s+)?introduction|keywords|1\s)",
]
# arXiv ids, DOIs, years, quoted titles, and titles between authors and venue.
_ARXIV, _DOI, _YEAR = r"(\d{4}\.\d{4,5}(?:v\d+)?)", r"(10\.\d{4,}/[^\s,]+)", r"\b(20[012]\d)\b"
_QUOTED = '["\u201c]([^"\u201d]{15,200})["\u201d]'
_UNQUOTED = (
    r"(?m)(?:^|\n)\s*\[?\d+\]?\s*[A-Z][^.]+?\.\s+(.{15,200}?)\.\s+(?:In\s|Proceedings|arXiv|Journal|Trans)"
)
# Fixed value: a line that begins with a surname and a capital.
_AUTHOR_LINE = r"\n(?=[A-Z][a-z]+,?\s+[A-Z])"
MISSING_TITLE = "Unknown Title"


def stripped(text: Column) -> Column:
    """Text without blanks and line breaks at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def title_of(text: Column) -> Column:
    """The first of 20 lines with more than 15 characters and no arXiv stamp."""
    lines = F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 20)
    good = F.filter(
        F.transform(lines, lambda x: F.trim(x)),
        lambda x: (F.length(x) > 15) & ~F.lower(x).startswith("arxiv"),
    )
    return F.coalesce(F.get(good, F.lit(0)), F.lit(MISSING_TITLE))


def abstract_of(text: Column) -> Column:
    """The abstract with blanks collapsed; '' where none is found, null for null.

    The text after the word 'abstract' up to a blank line or the introduction,
    else up to the introduction, the keywords or a '1', if over 50 characters;
    else the lines after the first of 50 lines that has the word and is followed
    by text within 29 lines, up to a blank line or a numbered introduction.
    """
    found = None
    for pattern in _ABSTRACTS:
        flat = stripped(F.regexp_replace(F.regexp_extract(text, pattern, 1), r"\s+", " "))
        accepted = F.when(F.length(flat) > 50, flat)
        found = accepted if found is None else F.coalesce(found, accepted)
    lines = F.split(text, "\n")
    places = F.filter(
        F.transform(F.slice(lines, 1, 50), lambda line, i: F.when(F.lower(line).contains("abstract"), i)),
        lambda i: i.isNotNull(),
    )
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("done"))

    def step(acc: Column, line: Column) -> Column:
        blank = stripped(line) == ""
        ends = acc["done"] | (blank & (F.size(acc["out"]) > 0)) | line.rlike(r"^\d+\.?\s+(Introduction|INTRODUCTION)")
        return F.struct(
            F.when(ends | blank, acc["out"]).otherwise(F.array_append(acc["out"], stripped(line))).alias("out"),
            ends.alias("done"),
        )

    gathered = F.transform(
        places, lambda i: F.array_join(F.aggregate(F.slice(lines, i + 2, 29), start, step, lambda a: a["out"]), " ")
    )
    by_line = F.get(F.filter(gathered, lambda x: x != ""), F.lit(0))
    return F.when(text.isNotNull(), F.coalesce(found, by_line, F.lit("")))


def references_of(text: Column) -> Column:
    """From the reference heading to the end or to an appendix; '' without such a heading."""
    tail = F.regexp_extract(text, r"(?is)\n\s*(?:\d+\.?\s+)?(?:references|bibliography)\s*\n(.*)$", 1)
    return F.trim(F.get(F.split(tail, r"(?i)\n\s*(?:appendix|supplementary)\b"), F.lit(0)))


def _is_heading(line: Column) -> Column:
    return (F.length(line) <= 100) & (line.rlike(_HEADING) | line.rlike(_NUMBERED))


def sections(documents: DataFrame, key: str, text: str, least: int = 50) -> DataFrame:
    """(key, ord, name, text): segments of each text between heading lines.

    A heading is a line of up to 100 characters that is a known heading or a
    numbered title of at most two levels. Text before the first heading is
    dropped, as are sections under `least` characters; a text without any
    section left is one section 'Full Text' (ord 0). Null and blank texts have
    none. A text is cut up where it lies; nothing is shuffled.
    """
    lines = documents.where(F.col(text).isNotNull()).select(
        key, F.col(text).alias("_text"), F.split(text, "\n").alias("_lines")
    )
    named = F.transform("_lines", lambda line, i: F.struct(i.alias("at"), stripped(line).alias("name")))
    headed = lines.withColumn("_heads", F.filter(named, lambda h: _is_heading(h["name"])))

    def body(head: Column, i: Column) -> Column:
        end = F.coalesce(F.get("_heads", i + 1)["at"], F.size("_lines"))
        inside = F.slice("_lines", head["at"] + 2, end - head["at"] - 1)
        return F.struct(
            (i + 1).alias("ord"), head["name"].alias("name"), stripped(F.array_join(inside, "\n")).alias("text")
        )

    kept = headed.withColumn(
        "_kept", F.filter(F.transform("_heads", body), lambda s: F.length(s["text"]) >= least)
    )
    whole = F.struct(F.lit(0).alias("ord"), F.lit("Full Text").alias("name"), stripped(F.col("_text")).alias("text"))
    found = F.when(F.size("_kept") > 0, F.col("_kept")).when(whole["text"] != "", F.array(whole))
    return kept.select(key, F.explode(found).alias("s")).select(key, F.col("s.ord").cast("bigint").alias("ord"), "s.name", "s.text")


def split_references(references: Column) -> Column:
    """Single references of a list: by [n], else by lines that begin with an author, else by blank lines, else by lines over 20.

    Each way needs parts enough: two [n], three author lines, two blank lines.
    What stands before the first [n] on a line of its own is dropped.
    """
    marks = F.regexp_extract_all(references, F.lit(r"\n\s*\[(\d+)\]"))
    parts = F.split(references, r"\n\s*\[\d+\]")
    numbered = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p, i: F.concat(F.lit("["), F.get(marks, i), F.lit("] "), stripped(p)),
    )

    def solid(pieces: Column) -> Column:
        return F.filter(F.transform(pieces, stripped), lambda x: x != "")

    authors = F.split(references, _AUTHOR_LINE)
    paragraphs = F.split(references, r"\n\s*\n")
    lines = F.filter(F.transform(F.split(references, "\n"), stripped), lambda x: F.length(x) > 20)
    return (
        F.when(F.size(parts) > 2, numbered)
        .when(F.size(authors) > 3, solid(authors))
        .when(F.size(paragraphs) > 2, solid(paragraphs))
        .otherwise(lines)
    )


def reference_fields(refs: DataFrame, raw: str = "raw_text") -> DataFrame:
    """refs with parsed_arxiv_id, parsed_doi, parsed_title and parsed_year; null where not found.

    parsed_arxiv_id is without version. A title stands in quotes, else between
    the authors and the venue of a numbered reference.
    """

    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(raw, pattern, 1), F.lit(""))

    title = F.coalesce(found(_QUOTED), found(_UNQUOTED))
    return refs.withColumns(
        {
            "parsed_arxiv_id": F.regexp_replace(found(_ARXIV), r"v\d+$", ""),
            "parsed_doi": F.regexp_replace(found(_DOI), r"\.+$", ""),
            "parsed_title": F.regexp_replace(stripped(title), r"\.+$", ""),
            "parsed_year": found(_YEAR).cast("int"),
        }
    )


def parsed_references(documents: DataFrame, key: str = "arxiv_id", text: str = "references_text") -> DataFrame:
    """(src, ord, raw_text, parsed fields) of every reference of each document's list."""
    split = documents.where(F.col(text).isNotNull()).select(
        F.col(key).alias("src"), F.posexplode(split_references(F.col(text))).alias("ord", "raw_text")
    )
    return reference_fields(split)


def citation_edges(parsed: DataFrame, papers: DataFrame, normalized) -> DataFrame:
    """(src, dst): distinct papers that each document cites, by a reference's arXiv id or by its title.

    parsed is of parsed_references, papers has (arxiv_id, title). A document
    doesn't cite itself.
    """
    by_id = parsed.where("parsed_arxiv_id is not null and parsed_arxiv_id <> src").select(
        "src", F.col("parsed_arxiv_id").alias("dst")
    )
    titled = parsed.select("src", "ord", F.col("parsed_title").alias("title"))
    by_title = matched_titles(titled, papers, normalized).select("src", "dst")
    return by_id.unionByName(by_title).distinct()


def citation_summary(parsed: DataFrame, edges: DataFrame) -> DataFrame:
    """(arxiv_id, num_references, num_titles, num_cited): what was read from each document's list."""
    counted = parsed.groupBy(F.col("src").alias("arxiv_id")).agg(
        F.count(F.lit(1)).alias("num_references"), F.count("parsed_title").alias("num_titles")
    )
    cited = edges.groupBy(F.col("src").alias("arxiv_id")).agg(F.count(F.lit(1)).alias("num_cited"))
    zero = F.lit(0).cast("bigint")
    return counted.join(cited, "arxiv_id", "left").withColumn("num_cited", F.coalesce("num_cited", zero))


def matched_titles(refs: DataFrame, papers: DataFrame, normalized) -> DataFrame:
    """(src, ord, dst): references whose normalised title is a known paper's, other than its own.

    papers has (arxiv_id, title); of several papers with one title the largest
    arxiv_id wins. refs has (src, ord, title).
    """
    titles = (
        papers.select(normalized(F.col("title")).alias("t"), "arxiv_id")
        .where("t <> ''")
        .groupBy("t")
        .agg(F.max("arxiv_id").alias("dst"))
    )
    return (
        refs.select("src", "ord", normalized(F.col("title")).alias("t"))
        .where("t <> ''")
        .join(titles, "t")
        .where("src <> dst")
        .select("src", "ord", "dst")
    )
