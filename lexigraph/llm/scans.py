"""Repairing text that was extracted from scanned pages.

Words are counted over the whole corpus, and the frequent words of papers
without broken lines are its dictionary. Lines of papers that show signs of
scanning are numbered and looked at through SQL windows:

- Running headers, footers and page numbers stand at page breaks (next to a
  blank line) and come back from page to page once digits are masked.
- A word broken at a line end is joined with the next line of text, past blank
  lines and furniture; the dictionary says whether its hyphen belongs to it.
- A word that the dictionary lacks is grouped by its skeleton, in which glyphs
  that scanners confuse are the same; of the dictionary words of that group the
  one that the neighbouring words support, then the most frequent, is right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.session import cut

WORD = r"[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*"
BREAK_MARKS = "-\u00ac\u00ad\u2010"
# Words that may follow a hanging hyphen ("short- and long-range").
AFTER_HANGING = "and or und oder et ou y o e bis as nor".split()
# Single glyphs that are read for one another, by class.
GLYPHS = {"c": "e", "a": "o", "0": "o", "1": "i", "l": "i", "f": "t", "5": "s", "b": "h", "6": "h", "9": "g", "y": "v", "u": "h"}
# Glyph pairs (in classes above) read for one glyph; d for cl, n for ri, and so on.
PAIRS = [("vv", "w"), ("rn", "m"), ("in", "m"), ("ri", "n"), ("ei", "d"), ("ii", "h"), ("ti", "h")]
#: Frequent words that are taken out of a text before anything is joined; a bound on a broadcast.
KNOWN_WORDS = 20_000
#: Share of all words from which a word of two glyphs is usual enough to be misread.
USUAL = 0.001


def skeletons(word: Column) -> Column:
    """Two skeletons of a lower-case word, by two orders of reducing overlapping glyph pairs."""
    single = F.translate(word, "".join(GLYPHS), "".join(GLYPHS.values()))
    first, second = single, single
    for pair, glyph in PAIRS:
        first = F.regexp_replace(first, pair, glyph)
    for pair, glyph in reversed(PAIRS):
        second = F.regexp_replace(second, pair, glyph)
    return F.array_distinct(F.array(first, second))


def looks_scanned(text: Column) -> Column:
    """A word broken at a line end, or a short line with a number before a break within a sentence."""
    return text.rlike(rf"\p{{L}}[{BREAK_MARKS}][ \t]*\n") | text.rlike(
        r"\n[^\n]{0,80}\d[^\n]{0,20}\n[ \t]*\n(?:[^\n]{1,90}\n)?\p{Ll}"
    )


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"))


def clean_tokens(extracted: DataFrame) -> DataFrame:
    """(w): the words of every paper without signs of scanning, in order, as written."""
    clean = extracted.where("full_text is not null").where(~looks_scanned(F.col("full_text")))
    return clean.select(_tokens(F.col("full_text")).alias("w"))


def dictionary(tokens: DataFrame, least: int) -> DataFrame:
    """(word, n, plain): words used at least so often in clean_tokens.

    word is in lower case; plain says that it is written so at least so often,
    which tells words from names.
    """
    return (
        tokens.select(F.explode("w").alias("t"))
        .groupBy("t")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("t").rlike(r"\p{L}"))
        .groupBy(F.lower("t").alias("word"))
        .agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("t") == F.lower("t"), F.col("n"))), F.lit(0)).alias("low"))
        .where(F.col("n") >= least)
        .select("word", "n", (F.col("low") >= least).alias("plain"))
    )


def scanned_lines(extracted: DataFrame) -> DataFrame:
    """(arxiv_id, field, section_no, line_no, line, heading) of suspicious papers, one text a field.

    A paper is judged by its full text, without one by its sections and references.
    """
    parts = F.concat_ws("\n\n", F.col("sections")["text"], "references_text")
    one = (
        extracted.where("arxiv_id is not null")
        .where(looks_scanned(F.coalesce("full_text", parts)))
        .select("arxiv_id", "full_text", "references_text", "sections")
        .dropDuplicates(["arxiv_id"])
    )

    def field(name: str, number: Column, text: Column) -> Column:
        return F.struct(
            F.lit(name).alias("field"), number.cast("int").alias("section_no"), text.alias("text")
        )

    sections = F.coalesce(F.col("sections"), F.array().cast(one.schema["sections"].dataType))
    texts = F.concat(
        F.array(
            field("full_text", F.lit(-1), F.col("full_text")),
            field("references_text", F.lit(-1), F.col("references_text")),
        ),
        F.transform(sections, lambda s, i: field("section", i, s["text"])),
    )
    names = F.transform(sections, lambda s: F.lower(F.trim(s["name"])))
    lines = one.select("arxiv_id", names.alias("names"), F.explode(texts).alias("t")).select(
        "arxiv_id", "names", "t.*"
    )
    title = F.lower(F.trim(F.get(F.split("text", "\n"), F.lit(0))))
    return (
        lines.where("text is not null")
        .withColumn("title", F.when(F.col("field") == "full_text", title))
        .select("arxiv_id", "field", "section_no", "names", "title", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .withColumn("_low", F.lower(F.trim("line")))
        .select(
            "arxiv_id",
            "field",
            "section_no",
            "line_no",
            "line",
            (
                F.coalesce(F.array_contains("names", F.col("_low")), F.lit(False))
                | F.col("_low").isin("abstract", "references", "bibliography")
            ).alias("heading"),
            # a header that repeats the beginning of the title
            F.coalesce(
                (F.col("line_no") > 0)
                & (F.length("_low") >= 5)
                & F.col("title").startswith(F.col("_low")),
                F.lit(False),
            ).alias("titled"),
        )
    )


_DOCUMENT = ["arxiv_id", "field", "section_no"]


def at_page_breaks(lines: DataFrame) -> DataFrame:
    """lines with mask (digits as #), near (up to two lines from a blank one) and again."""
    order = Window.partitionBy(*_DOCUMENT).orderBy("line_no")
    blank = F.trim("line") == ""

    def blank_at(k: int) -> Column:
        return F.coalesce(F.lag("blank", k).over(order), F.lit(True))

    masked = lines.withColumn("blank", blank).withColumn(
        "mask", F.regexp_replace(F.lower(F.trim("line")), r"\d+", "#")
    )
    near = blank_at(1) | blank_at(2) | blank_at(-1) | blank_at(-2)
    return masked.withColumn("near", ~F.col("blank") & near).withColumn(
        "again", F.coalesce(F.col("mask") == F.lag("mask", 1).over(order), F.lit(False))
    )


def furniture(lines: DataFrame, papers: int = 3, share: float = 0.001) -> DataFrame:
    """lines of at_page_breaks with furniture: whether the line is a header, footer or page number.

    A masked line is furniture of its paper if it is short, ends in no sentence
    and comes back at page breaks and hardly elsewhere, never twice in a row; a
    line that comes only once must be furniture of `papers` papers and of a
    share of all papers of lines, a beginning of the title or 'name et al.'.
    Lines at page breaks that differ from it by a misread glyph or two are, too.
    """
    short = (
        (F.length("mask") <= 70)
        & (F.size(F.split("mask", r"\s+")) <= 9)
        & (~F.col("mask").rlike(r"[.,;:]$") | F.col("mask").rlike(r"et al\W$"))
        & ~F.col("heading")
        & ~F.col("blank")
    )
    use = (
        lines.where((F.col("field") == "full_text") & short)
        .groupBy("arxiv_id", "mask")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("near").alias("breaks"),
            F.count_if("again").alias("rows"),
            F.max("titled").alias("titled"),
        )
        .where("breaks > 0 and rows = 0 and breaks >= 0.7 * n")
    )
    repeated = use.where("breaks >= 2").select("arxiv_id", "mask")
    several = lines.agg(F.approx_count_distinct("arxiv_id").alias("all"))
    common = (
        repeated.groupBy("mask")
        .count()
        .join(F.broadcast(several), how="cross")  # one row
        .where((F.col("count") >= papers) & (F.col("count") >= share * F.col("all")))
        .select("mask")
    )
    named = use.where(F.col("titled") | F.col("mask").rlike(r"^\p{L}+ et al\.?$")).select("arxiv_id", "mask")
    once = use.where("breaks = 1").join(common, "mask", "left_semi").select("arxiv_id", "mask")
    marks = repeated.unionByName(named).unionByName(once).distinct()
    # the few masks of a paper, kept together with its lines
    of_paper = marks.groupBy("arxiv_id").agg(F.collect_set("mask").alias("masks"))
    like = F.exists(
        F.coalesce("masks", F.array().cast("array<string>")),
        lambda m: (m == F.col("mask"))
        | (
            (F.length(m) >= 5)
            & (F.abs(F.length(m) - F.length("mask")) <= 2)
            & (F.levenshtein(m, F.col("mask")) <= F.when(F.length(m) >= 12, 2).otherwise(1))
        ),
    )
    joined = lines.join(of_paper, "arxiv_id", "left")
    judged = F.when(F.col("near") & short, like).otherwise(F.lit(False))
    return joined.select(*_DOCUMENT, "line_no", "line", "heading", "blank", judged.alias("furniture"))


def with_neighbours(lines: DataFrame) -> DataFrame:
    """Lines of text (no blank ones, no furniture); of broken ones also the next line of text."""
    order = Window.partitionBy(*_DOCUMENT).orderBy("line_no")
    text = lines.where(~F.col("blank") & ~F.col("furniture")).select(*_DOCUMENT, "line_no", "line")
    following = F.lead("line").over(order)
    broken = F.col("line").rlike(rf"[\p{{L}}\p{{N}}][{BREAK_MARKS}]\s*$") & F.coalesce(
        following.rlike(r"^[^\p{L}\p{N}]{0,2}\p{L}"), F.lit(False)
    )
    return (
        text.withColumn("broken", broken)
        .withColumn("next_line", F.when(F.col("broken"), following))
        .withColumn("continues", F.coalesce(F.lag("broken").over(order), F.lit(False)))
    )


def corrections(unknown: DataFrame, words: DataFrame) -> DataFrame:
    """(word, right, support): for words outside the dictionary the dictionary words of their skeleton.

    unknown has one column, word. The dictionary word must not be a name and be
    like the unknown one in length and most glyphs; words of two glyphs are only
    taken for a word that is a thousandth of all words.
    """
    total = words.agg(F.sum("n").alias("total"))
    known = (
        words.join(F.broadcast(total), how="cross")  # one row
        .withColumn("usual", F.col("n") >= USUAL * F.col("total"))
        .where(F.col("plain") & ((F.length("word") >= 3) | F.col("usual")))
    )
    known = known.select(
        "usual",
        F.col("word").alias("right"), F.col("n").alias("support"), F.explode(skeletons(F.col("word"))).alias("skeleton")
    )
    asked = unknown.distinct().select("word", F.explode(skeletons(F.col("word"))).alias("skeleton"))
    letters = F.greatest(F.length("word"), F.length("right"))
    return (
        asked.join(known, "skeleton")
        .where(F.col("word") != F.col("right"))
        .where((F.length("word") >= 3) | F.col("usual"))
        .where(F.levenshtein("word", "right") <= F.greatest(F.lit(1), F.floor(letters * 0.45)))
        .select("word", "right", "support")
        .distinct()
    )


def broken_words(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(document, line_no, word, joint, known): the joined word of every broken line.

    joint is the hyphen, if the word keeps it. known is false for a word that is in no form in the dictionary.
    """
    stem = F.regexp_extract("line", rf"((?:[\p{{L}}\p{{N}}]+[-'’‐])*[\p{{L}}\p{{N}}]+)[{BREAK_MARKS}]\s*$", 1)
    rest = F.regexp_extract("next_line", rf"^[^\p{{L}}\p{{N}}]{{0,2}}({WORD})", 1)
    halves = lines.where("broken").select(
        *_DOCUMENT,
        "line_no",
        F.lower(stem).alias("stem"),
        F.lower(rest).alias("rest"),
        F.col("line").rlike(r"[-‐]\s*$").alias("hyphen"),
    )
    forms = F.array(
        F.struct(F.lit("joined").alias("form"), F.concat("stem", "rest").alias("word")),
        F.struct(F.lit("compound").alias("form"), F.concat("stem", F.lit("-"), "rest").alias("word")),
        F.struct(F.lit("stem").alias("form"), F.col("stem").alias("word")),
        F.struct(F.lit("rest").alias("form"), F.col("rest").alias("word")),
    )
    pieces = halves.select("stem", "rest", F.explode(forms).alias("f")).select("stem", "rest", "f.*").distinct()
    counted = (
        pieces.join(words, "word", "left")
        .groupBy("stem", "rest")
        .agg(
            *[
                F.max(F.when(F.col("form") == f, F.coalesce("n", F.lit(0)))).alias(f"n_{f}")
                for f in ("joined", "compound", "stem", "rest")
            ]
        )
    )
    joined, compound = F.concat("stem", "rest"), F.concat("stem", F.lit("-"), "rest")
    keeps = F.col("hyphen") & (
        (F.col("n_compound") > F.col("n_joined"))
        | ((F.col("n_joined") == 0) & (F.col("n_stem") > 0) & (F.col("n_rest") > 0) & (F.length("stem") >= 3))
    )
    hanging = (F.col("n_joined") == 0) & (F.col("n_compound") == 0) & F.col("rest").isin(AFTER_HANGING)
    return (
        halves.join(counted, ["stem", "rest"])
        .where(~(F.col("hyphen") & hanging))
        # what no dictionary knows must at least be made of letters
        .where((F.col("n_joined") > 0) | keeps | joined.rlike(r"^[\p{L}'’-]{4,}$"))
        .select(
            *_DOCUMENT,
            "line_no",
            F.when(keeps, compound).otherwise(joined).alias("word"),
            F.when(keeps, "-").otherwise("").alias("joint"),
            ((F.col("n_joined") > 0) | (F.col("n_compound") > 0) | keeps).alias("known"),
        )
    )


def unknown_words(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """(document, line_no, word, before, after): words of unbroken text that aren't frequent.

    frequent has at most KNOWN_WORDS words.
    """
    tokens = _tokens(F.lower("line"))
    inner = F.slice(
        tokens,
        F.when(F.col("continues"), 2).otherwise(1),
        F.greatest(
            F.size(tokens) - F.col("continues").cast("int") - F.col("broken").cast("int"), F.lit(0)
        ),
    )
    each = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0))),
        lambda i: F.struct(
            F.get("w", i - 1).alias("before"), F.get("w", i).alias("word"), F.get("w", i + 1).alias("after")
        ),
    )
    return (
        lines.select(*_DOCUMENT, "line_no", inner.alias("w"))
        .select(*_DOCUMENT, "line_no", F.explode(each).alias("t"))
        .select(*_DOCUMENT, "line_no", "t.*")
        .where((F.length("word") >= 2) & F.col("word").rlike(r"\p{L}"))
        .join(F.broadcast(frequent.select("word")), "word", "left_anti")
    )


def in_context(
    found: DataFrame, options: DataFrame, frequent: DataFrame, tokens: DataFrame, known: int = KNOWN_WORDS
) -> DataFrame:
    """(document, line_no, word, right): the best dictionary word for each unknown word.

    found has (document, line_no, word, before, after), tokens is of
    clean_tokens. Where a word has several options, the option that more often
    stands next to the same neighbours in these wins, then the one with fewest changes,
    then the more frequent one. Neighbours of options are sifted out by a
    broadcast before they are counted; of more than `known` options only those
    of the frequent ones, and those of the rest by a shuffle.
    """
    count = Window.partitionBy("word")
    options = options.withColumn("choices", F.count(F.lit(1)).over(count))
    asked = cut(found.join(options, "word"))
    open_ = asked.where("choices > 1")
    wanted = (
        open_.where("before is not null")
        .select("before", F.col("right").alias("after"))
        .unionByName(open_.where("after is not null").select(F.col("right").alias("before"), "after"))
        .distinct()
    )
    rights = cut(open_.select(F.col("right").alias("word")).distinct())
    many = rights.count() > known
    if many:
        rights = frequent.select("word").join(rights, "word", "left_semi")
    pairs = tokens.select(F.transform("w", lambda t: F.lower(t)).alias("w")).select(
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size("w") - 2, F.lit(0))),
                lambda i: F.struct(F.get("w", i).alias("before"), F.get("w", i + 1).alias("after")),
            )
        ).alias("p")
    ).select("p.*")
    first = rights.select(F.col("word").alias("before"), F.lit(True).alias("_first"))
    second = rights.select(F.col("word").alias("after"), F.lit(True).alias("_second"))

    def marked(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(first), "before", "left").join(F.broadcast(second), "after", "left")

    def counted(some: DataFrame, asked_for: DataFrame) -> DataFrame:
        return (
            some.where("after is not null")
            .groupBy("before", "after")
            .agg(F.count(F.lit(1)).alias("n"))
            .join(asked_for, ["before", "after"], "left_semi")
        )

    seen = counted(marked(pairs).where("_first or _second"), wanted)
    if many:
        rest = marked(wanted).where("_first is null and _second is null").select("before", "after")
        seen = seen.unionByName(counted(pairs, rest))
    left = seen.select("before", F.col("after").alias("right"), F.col("n").alias("n_before"))
    right = seen.select(F.col("before").alias("right"), "after", F.col("n").alias("n_after"))
    key = [*_DOCUMENT, "line_no", "word", "before", "after"]
    best = Window.partitionBy(*key).orderBy(
        F.desc(F.coalesce("n_before", F.lit(0)) + F.coalesce("n_after", F.lit(0))),
        F.levenshtein("word", "right"),
        F.desc("support"),
        "right",
    )
    return (
        asked.join(left, ["before", "right"], "left")
        .join(right, ["right", "after"], "left")
        .withColumn("_r", F.row_number().over(best))
        .where("_r = 1")
        .select(*_DOCUMENT, "line_no", "word", "right")
    )


def repairs(extracted: DataFrame, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """All repairs (arxiv_id, field, section_no, line_no, kind, word, stored), and the judged lines.

    stored is the misread word as it stands, in lower case, or the hyphen that a
    broken word keeps. A word is repaired once a line. Null and empty texts and
    papers without signs of scanning have no repairs; repeated extractions of a
    paper count once.
    """
    tokens = cut(clean_tokens(extracted))
    words = cut(dictionary(tokens, least))
    frequent = cut(words.orderBy(F.desc("n"), "word").limit(KNOWN_WORDS).select("word"))
    lines = cut(furniture(at_page_breaks(scanned_lines(extracted))))
    text = cut(with_neighbours(lines))
    broken = cut(broken_words(text, words))
    found = cut(unknown_words(text, frequent).join(words.select("word"), "word", "left_anti"))
    unknown = found.select("word").unionByName(broken.where(~F.col("known")).select("word"))
    options = cut(corrections(unknown, words))
    misread = in_context(found, options, frequent, tokens)
    likeliest = options.groupBy("word").agg(
        F.min_by("right", F.struct(F.levenshtein("word", "right"), -F.col("support"), "right")).alias("right")
    )
    joined = broken.join(likeliest, "word", "left").select(
        *_DOCUMENT,
        "line_no",
        F.lit("hyphen").alias("kind"),
        F.when(F.col("known"), F.col("word")).otherwise(F.coalesce("right", "word")).alias("word"),
        F.col("joint").alias("stored"),
    )
    dropped = lines.where("furniture").select(
        *_DOCUMENT, "line_no", F.lit("furniture").alias("kind"), F.lit("").alias("word")
    )
    read = misread.select(
        *_DOCUMENT, "line_no", F.lit("misread").alias("kind"), F.col("right").alias("word"), F.col("word").alias("stored")
    )
    every = (
        dropped.withColumn("stored", F.lit(""))
        .unionByName(joined)
        .unionByName(read)
    )
    return every.distinct(), lines


def _cased(word: Column, as_: Column) -> Column:
    """A lower-case word in capitals or with a capital, if as_ is written so."""
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))
    return (
        F.when(F.lower(as_) == word, as_)
        .when((F.length(as_) > 1) & (as_ == F.upper(as_)) & (as_ != F.lower(as_)), F.upper(word))
        .when(as_.rlike(r"^\p{Lu}"), capital)
        .otherwise(word)
    )


def _corrected(line: Column, wrong: Column) -> Column:
    """line with each stored word of wrong (stored, word) replaced, capitals kept."""

    def capital(word: Column) -> Column:
        return F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))

    def replaced(text: Column, stored: Column, word: Column, flags: str = "(?u)") -> Column:
        pattern = F.concat(F.lit(flags + r"(?<![\p{L}\p{N}])"), stored, F.lit(r"(?![\p{L}\p{N}])"))
        return F.regexp_replace(text, pattern, word)

    def step(text: Column, w: Column) -> Column:
        text = replaced(text, F.upper(w["stored"]), F.upper(w["word"]))
        text = replaced(text, capital(w["stored"]), capital(w["word"]))
        return replaced(text, w["stored"], w["word"], "(?iu)")

    none = F.array().cast("array<struct<stored:string,word:string>>")
    return F.aggregate(F.coalesce(wrong, none), line, step)


def reflowed(extracted: DataFrame) -> DataFrame:
    """(arxiv_id, field, section_no, paragraph_no, text): repaired paragraphs of scanned papers.

    Furniture is gone, broken words are whole, misread words right, and the
    lines of a paragraph are one line. Words keep their capitals; a broken word
    stands where its first half stood. A blank line next to furniture is a page
    break and ends no paragraph; headings are paragraphs of their own. Papers
    without signs of scanning are not listed.
    """
    every, lines = repairs(extracted)
    key = [*_DOCUMENT, "line_no"]
    whole = every.where("kind = 'hyphen'").select(*key, F.col("word").alias("whole"), F.col("stored").alias("joint"))
    wrong = (
        every.where("kind = 'misread'")
        .groupBy(*key)
        .agg(F.collect_set(F.struct("stored", "word")).alias("wrong"))
    )
    order = Window.partitionBy(*_DOCUMENT).orderBy("line_no")
    beside = F.coalesce(F.lag("furniture").over(order), F.lit(False)) | F.coalesce(
        F.lead("furniture").over(order), F.lit(False)
    )
    starts = (F.col("blank") & ~beside) | F.col("heading")
    after = F.coalesce(F.lag("heading").over(order), F.lit(False))
    # the halves of a broken word, as broken_words takes them
    stem = F.regexp_extract("line", rf"((?:[\p{{L}}\p{{N}}]+[-'’‐])*[\p{{L}}\p{{N}}]+)[{BREAK_MARKS}]\s*$", 1)
    rest = F.regexp_extract("following", rf"^[^\p{{L}}\p{{N}}]{{0,2}}({WORD})", 1)
    numbered = (
        lines.withColumn("_start", (starts | after).cast("int"))
        .withColumn("paragraph_no", F.sum("_start").over(order))
        .where(~F.col("blank") & ~F.col("furniture"))
        .join(whole, key, "left")
        .join(wrong, key, "left")
        .withColumn("following", F.lead("line").over(order))
        .withColumn("taken", F.coalesce(F.lag("whole").over(order).isNotNull(), F.lit(False)))
    )
    # what the line before took of this one is gone; what this one breaks is written whole
    opened = F.when(
        F.col("taken"), F.regexp_replace("line", rf"^[^\p{{L}}\p{{N}}]{{0,2}}{WORD}", "")
    ).otherwise(F.col("line"))
    body = F.when(
        F.col("whole").isNotNull(),
        F.regexp_replace(opened, rf"(?:[\p{{L}}\p{{N}}]+[-'’‐])*[\p{{L}}\p{{N}}]+[{BREAK_MARKS}]\s*$", ""),
    ).otherwise(opened)
    body = F.when(F.col("taken"), F.rtrim(body)).otherwise(F.trim(body))
    written = _cased(F.col("whole"), F.concat(stem, "joint", rest))
    text = _corrected(F.col("_body"), F.col("wrong"))
    blank = F.when((text != "") & ~text.rlike(r"\s$"), " ").otherwise("")
    piece = F.when(F.col("whole").isNotNull(), F.concat(text, blank, F.col("_written"))).otherwise(
        F.concat(text, F.lit(" "))
    )
    # a half that hangs on a compound of the same line has no blank before it
    glued = body.rlike(r"[-'’‐]$")
    piece = F.when(F.col("whole").isNotNull() & F.col("_glued"), F.concat(text, F.col("_written"))).otherwise(piece)
    return (
        numbered.withColumns({"_body": body, "_written": written, "_glued": glued})
        .groupBy(*_DOCUMENT, "paragraph_no")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", piece.alias("piece")))).alias("p"))
        .select(*_DOCUMENT, "paragraph_no", F.trim(F.array_join("p.piece", "")).alias("text"))
    )
