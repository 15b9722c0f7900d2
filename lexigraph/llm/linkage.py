"""Matching references to papers without a common key, with a confidence.

References are reduced to distinct profiles (title text, authors, year).
A title text that is the whole title of papers is compared with these. Any other
shares a rare key with its candidates: three neighbouring content words or one
word. It uses the few rarest of its keys that papers have. A key of many papers
is not used alone but together with an author's surname or the year, so every key
joins a bounded number of papers. A text for which that finds no paper with words
enough in common, or one of whose keys is too large even so, is compared with all
papers in a second round: blocks of texts and papers meet, shared words are
counted in arrays, and every paper with most words in common, or with some words
and an author or the text's rarest word, is a candidate, however many there are.

On every candidate pair heuristics vote in grades for, against or not at all. A
generative model (label_model) learns from the counts of vote patterns how
accurate each heuristic is, which of them err together and what a grade says,
and gives every pattern the odds of a match. As a reference describes one paper at most, the
odds of its candidates compete: confidence = odds / (1 + sum of odds).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.llm.label_model import log_odds
from lexigraph.session import cut

# Words that citations leave out or add.
GLUE = (
    "a an and as at by de des do does for from how in into is it its much of on or over the to"
    " under via with"
).split()
# Shares of the words of a title from which it is compared at all, and without an author or the rarest word in common.
SOME, MOST = 0.4, 0.6
VOTERS = [
    "v_title",
    "v_paper_words",
    "v_ref_words",
    "v_edits",
    "v_longest",
    "v_authors",
    "v_first_author",
    "v_author_count",
    "v_year",
]


def plain(text: Column) -> Column:
    """Lower case, without braces, word breaks and hyphens; other signs become blanks."""
    text = F.regexp_replace(F.lower(text), r"-\s+", "")
    text = F.regexp_replace(text, r"[{}\-‐‑'’]", "")
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def content(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: ~w.isin("", *GLUE))


def name_parts(authors: Column) -> Column:
    """Per author the lower-case name parts of three letters and more; others drop out."""
    parts = F.transform(
        F.coalesce(authors, F.array().cast("array<string>")),
        lambda a: F.filter(
            F.split(F.regexp_replace(F.lower(F.coalesce(a, F.lit(""))), r"[^\p{L} ]+", " "), " +"),
            lambda w: (F.length(w) >= 3) & ~w.isin("unknown"),
        ),
    )
    return F.filter(parts, lambda p: F.size(p) > 0)


def paper_records(papers: DataFrame, reading_list: DataFrame) -> DataFrame:
    """(arxiv_id, title, names, year, copies): papers as last harvested, before the reading list.

    Papers that agree in title, names and year can't be told apart; they are one
    row, with the lowest arxiv_id and their number as copies.
    """
    columns = ["arxiv_id", "title", "authors", "published"]
    both = papers.select(*columns, F.lit(1).alias("own"), "updated").unionByName(
        reading_list.select(*columns, F.lit(0).alias("own"), F.lit(None).cast("string").alias("updated"))
    )
    latest = (
        both.where("arxiv_id is not null and title is not null")
        .groupBy("arxiv_id")
        .agg(
            F.max_by(
                F.struct("title", "authors", "published"),
                F.struct("own", F.coalesce("updated", F.lit("")), "title"),
            ).alias("r")
        )
    )
    described = latest.select(
        "arxiv_id",
        plain(F.col("r.title")).alias("title"),
        name_parts(F.col("r.authors")).alias("names"),
        F.expr("try_cast(substring(r.published, 1, 4) as int)").alias("year"),
    ).where("title <> ''")
    return described.groupBy("title", "names", "year").agg(
        F.min("arxiv_id").alias("arxiv_id"), F.count(F.lit(1)).alias("copies")
    )


def reference_profiles(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ref_id, profile) of all references without identifiers, and the distinct profiles.

    profile is a hash of title text, authors and year. Without a title the raw
    text stands for it (whole is then true); a reference without either has no
    profile.
    """
    text = F.coalesce(
        F.when(F.trim("title") != "", F.col("title")),
        F.regexp_replace("raw_text", r"^\s*\[\d+\]\s*", ""),
    )
    whole = F.coalesce(F.trim("title"), F.lit("")) == ""
    # written, as the profiles are made of it first and the members read at the end
    known = cut(
        refs.where("ref_id is not null and arxiv_id is null and doi is null")
        .select(
            "ref_id",
            plain(text).alias("text"),
            whole.alias("whole"),
            name_parts(F.col("authors")).alias("names"),
            F.exists(
                F.coalesce("authors", F.array().cast("array<string>")),
                lambda a: F.lower(a).contains("et al"),
            ).alias("et_al"),
            F.col("year").alias("year"),
        )
        .where("text is not null and text <> ''")
        .withColumn("profile", F.xxhash64("text", "whole", "names", "et_al", "year"))
    )
    profiles = known.drop("ref_id").dropDuplicates(["profile"])
    return known.select("ref_id", "profile"), profiles


def record_keys(df: DataFrame, record_id: str, text: str, letters: int = 5) -> DataFrame:
    """(id, key, word): hashes of each triple of neighbouring content words and of each longer word.

    word tells the words from the triples.
    """
    triples = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("_c") - 3, F.lit(0))),
        lambda i: F.xxhash64(F.get("_c", i), F.get("_c", i + 1), F.get("_c", i + 2)),
    )
    singles = F.transform(F.filter("_c", lambda w: F.length(w) >= letters), lambda w: F.xxhash64(w))

    def marked(keys: Column, word: bool) -> Column:
        return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(word).alias("word")))

    singles = marked(singles, True)
    keys = F.when(F.size("_c") >= 3, F.concat(marked(triples, False), singles)).otherwise(singles)
    return (
        df.withColumn("_c", content(F.col(text)))
        .select(record_id, F.explode(F.array_distinct(keys)).alias("k"))
        .select(record_id, "k.*")
    )


def _letters(text: str) -> Column:
    return F.replace(F.col(text), F.lit(" "), F.lit(""))


def _surnames(names: Column) -> Column:
    """The last part of each author's name."""
    return F.array_distinct(F.transform(names, lambda a: F.element_at(a, -1)))


def _refined(df: DataFrame, names: Column, years: int, *kept: str) -> DataFrame:
    """(kept columns, key): hashes of each key with each of names, and with each year up to `years` away.

    Years around are those of the papers, so that all of a block count together.
    """
    about = F.when(
        F.col("year").isNotNull(), F.sequence(F.col("year") - years, F.col("year") + years)
    ).otherwise(F.array().cast("array<int>"))
    parts = F.concat(
        F.transform(names, lambda n: F.xxhash64("key", n)),
        F.transform(about, lambda y: F.xxhash64("key", F.lit("year"), y)),
    )
    return df.select(*kept, F.explode(parts).alias("key"))


def _small(keys: DataFrame, most: int) -> DataFrame:
    """(key, arxiv_id) of the keys of at most so many papers; a larger one is a single row without arxiv_id.

    Of larger keys little more than that is shuffled.
    """
    rank = F.row_number().over(Window.partitionBy("key").orderBy("arxiv_id"))
    first = keys.select("key", "arxiv_id").withColumn("_r", rank).where(F.col("_r") <= most + 1)
    large = F.max("_r").over(Window.partitionBy("key")) > most
    marked = first.withColumn("_large", large).where(~F.col("_large") | (F.col("_r") == 1))
    return marked.select("key", F.when(~F.col("_large"), F.col("arxiv_id")).alias("arxiv_id"))


def _sharing(
    chosen: DataFrame, paper_keys: DataFrame, profiles: DataFrame, papers: DataFrame, block: int, agree: int
) -> DataFrame:
    """(profile, arxiv_id): distinct pairs that agree `agree` times in the chosen keys.

    chosen has (profile, key, papers, n). A key of up to `block` papers is n
    agreements as it stands, a larger key with each name and with the year,
    where that leaves at most two blocks. A row without arxiv_id tells of a
    profile that it leaves more to.
    """
    used = chosen.select("key", "papers").distinct()
    blocks = cut(paper_keys.join(used, "key"))
    is_small = F.col("papers") <= block
    small = (
        chosen.where(is_small)
        .join(blocks.where(is_small).drop("papers"), "key")
        .select("profile", "arxiv_id", "n")
    )
    large_papers = (
        blocks.where(~is_small)
        .select("key", "arxiv_id")
        .join(papers.select("arxiv_id", "names", "year"), "arxiv_id")
    )
    large_refs = (
        chosen.where(~is_small)
        .select("key", "profile", "n")
        .join(profiles.select("profile", "names", "year"), "profile")
    )
    large = (
        _refined(large_refs, F.array_distinct(F.flatten("names")), 0, "profile", "n")
        .join(_small(_refined(large_papers, _surnames(F.col("names")), 1, "arxiv_id"), 2 * block), "key")
        .select("profile", "arxiv_id", "n")
    )
    # one shuffle serves the grouping and the join with papers that follows
    return (
        small.unionByName(large)
        .repartition("arxiv_id")
        .groupBy("profile", "arxiv_id")
        .agg(F.sum("n").alias("n"))
        .where((F.col("n") >= agree) | F.col("arxiv_id").isNull())
        .select("profile", "arxiv_id")
    )


def candidates(
    profiles: DataFrame, papers: DataFrame, rarest: int = 3, block: int = 16, agree: int = 2
) -> DataFrame:
    """(profile, arxiv_id): distinct pairs of a title text and a paper worth comparing.

    A text that is some papers' whole title is compared with those papers; any
    other text with the papers that share `agree` of its rarest keys, or one
    that no other paper has. Of a title of more than `block` papers those are
    compared that agree in a name or, within a year, in the year. A row without
    arxiv_id tells of a profile with a key that is too large even so.
    """
    texts = profiles.select("profile", "text")
    titles = papers.select("arxiv_id", F.xxhash64(_letters("title")).alias("whole_title"))
    asked = texts.withColumn("whole_title", F.xxhash64(_letters("text")))
    shared = titles.groupBy("whole_title").agg(F.count(F.lit(1)).cast("int").alias("papers"))
    titled = cut(asked.select("profile", "whole_title").join(shared, "whole_title"))
    equal = (
        titled.where(F.col("papers") <= block)
        .join(titles, "whole_title")
        .select("profile", "arxiv_id")
    )
    hot = titled.where(F.col("papers") > block).select("profile", F.col("whole_title").alias("key"), "papers", F.lit(agree).alias("n"))
    hot_titles = shared.where(F.col("papers") > block).join(titles, "whole_title")
    unequal = texts.join(titled.select("profile"), "profile", "left_anti")
    paper_keys = record_keys(papers, "arxiv_id", "title").drop("word")
    sizes = paper_keys.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("papers"))
    order = Window.partitionBy("profile").orderBy("papers", "key")
    chosen = cut(
        record_keys(unequal, "profile", "text")
        .join(sizes, "key")
        .withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= rarest)
        .select("profile", "key", "papers", F.when(F.col("papers") == 1, agree).otherwise(1).alias("n"))
        .unionByName(hot)
    )
    title_keys = hot_titles.select("arxiv_id", F.col("whole_title").alias("key"))
    # a text has either equal titles or keys
    return equal.unionByName(
        _sharing(chosen, paper_keys.unionByName(title_keys), profiles, papers, block, agree)
    )


def _word_hashes(text: str) -> Column:
    return F.array_distinct(F.transform(content(F.col(text)), lambda w: F.hash(w)))


class _Index:
    """In which rows each of some values stands."""

    def __init__(self, values: np.ndarray, rows: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.values, self.start = np.unique(values[order], return_index=True)
        self.stop = np.append(self.start[1:], len(values))
        self.rows = rows[order]

    def places(self, asked: np.ndarray) -> np.ndarray:
        """The place of each asked value, -1 where there is none."""
        at = np.searchsorted(self.values, asked)
        there = at < len(self.values)
        there[there] = self.values[at[there]] == asked[there]
        return np.where(there, at, -1)

    def of(self, places: np.ndarray) -> np.ndarray:
        """The rows of all these places one after the other; a place of -1 has none."""
        return np.concatenate([self.rows[:0], *(self.rows[self.start[i] : self.stop[i]] for i in places if i >= 0)])


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Where the list of each row begins (and the last one ends), and the values of all lists."""
    flat = column.combine_chunks()
    ends = np.append(0, np.cumsum(flat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    return ends.astype(np.int64), flat.flatten().to_numpy(zero_copy_only=False)


def _near(asked: pa.Table, held: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of asked and of held that are compared: no pair of them is left out.

    Both have words, names (hashes) and letters (a hash), asked also whole
    and rare (hashes of words). The words that a text shares with each paper are counted in an array over the papers.
    """

    def least(share: float, n: np.ndarray | int) -> np.ndarray:
        return np.maximum(np.ceil(share * n - 1e-9), 1).astype(np.int64)

    m = len(held)
    begin, values = _lists(held["words"])
    most, some = least(MOST, np.diff(begin)), least(SOME, np.diff(begin))
    words_held = _Index(values, np.repeat(np.arange(m), np.diff(begin)))
    begin, values = _lists(held["names"])
    names_held = _Index(values, np.repeat(np.arange(m), np.diff(begin)))
    same = _Index(held["letters"].to_numpy(), np.arange(m))
    w_begin, values = _lists(asked["words"])
    w_places = words_held.places(values)
    n_begin, values = _lists(asked["names"])
    n_places = names_held.places(values)
    r_begin, values = _lists(asked["rare"])
    r_places = words_held.places(values)
    s_places, whole = same.places(asked["letters"].to_numpy()), asked["whole"].to_numpy(zero_copy_only=False)
    bounds = {-1: most}  # by how many words of a text are enough
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in range(len(asked)):
        common = np.bincount(words_held.of(w_places[w_begin[i] : w_begin[i + 1]]), minlength=m)
        # a raw text holds more than a title, so that only the paper's words count
        enough = -1 if whole[i] else int(least(MOST, w_begin[i + 1] - w_begin[i]))
        if enough not in bounds:
            bounds[enough] = np.minimum(most, enough)
        by_name = names_held.of(n_places[n_begin[i] : n_begin[i + 1]])
        by_word = words_held.of(r_places[r_begin[i] : r_begin[i + 1]])
        others = np.append(by_name, by_word)
        kept = [
            np.flatnonzero(common >= bounds[enough]),
            others[common[others] >= some[others]],
            same.of(s_places[i : i + 1]),
        ]
        right.append(np.unique(np.concatenate(kept)))
        left.append(np.full(len(right[-1]), i))
    return np.concatenate(left), np.concatenate(right)


def further_candidates(
    left: DataFrame, papers: DataFrame, profiles_a_block: int = 100_000, papers_a_block: int = 250_000
) -> DataFrame:
    """(profile, arxiv_id): every paper that shares words enough with a profile, whatever their keys.

    Words enough are MOST of the paper's or the text's words, or SOME of the
    paper's where an author is shared as well or that of the text's words which
    fewest papers have; the same letters always are.
    Blocks of profiles and of papers meet, each pair of blocks in a task.
    """
    uses = papers.select(F.explode(_word_hashes("title")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    used = left.select("profile", F.explode(_word_hashes("text")).alias("word")).join(uses, "word")
    listed = used.groupBy("profile").agg(F.min("n").alias("least"), F.collect_list(F.struct("n", "word")).alias("list"))
    rarest = F.transform(F.filter("list", lambda x: x["n"] == F.col("least")), lambda x: x["word"])
    described = left.join(listed.select("profile", rarest.alias("rare")), "profile", "left").select(
        "profile",
        "whole",
        "rare",
        _word_hashes("text").alias("words"),
        F.array_distinct(F.transform(F.flatten("names"), lambda n: F.hash(n))).alias("names"),
        F.xxhash64(_letters("text")).alias("letters"),
    )
    held = papers.select(
        "arxiv_id",
        _word_hashes("title").alias("words"),
        F.transform(_surnames(F.col("names")), lambda n: F.hash(n)).alias("names"),
        F.xxhash64(_letters("title")).alias("letters"),
    )
    profiles, cores = left.count(), left.sparkSession.sparkContext.defaultParallelism
    q_blocks = max(1, -(-profiles // profiles_a_block), min(2 * cores, profiles // 200))
    d_blocks = max(1, -(-papers.count() // papers_a_block))

    def dealt(df: DataFrame, by: str, mine: str, n: int, other: str, others: int) -> DataFrame:
        own = F.pmod(F.xxhash64(by), F.lit(n)).cast("int").alias(mine)
        placed = df.select("*", own).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return placed.repartition(q_blocks * d_blocks, "qb", "db")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        rows, found = _near(a, b) if len(a) and len(b) else (np.empty(0, np.int64), np.empty(0, np.int64))
        return pa.table({"profile": a["profile"].take(pa.array(rows)), "arxiv_id": b["arxiv_id"].take(pa.array(found))})

    q = dealt(described, "profile", "qb", q_blocks, "db", d_blocks)
    d = dealt(held, "arxiv_id", "db", d_blocks, "qb", q_blocks)
    types = [df.schema[c].dataType.simpleString() for df, c in ((left, "profile"), (papers, "arxiv_id"))]
    return q.groupBy("qb", "db").cogroup(d.groupBy("qb", "db")).applyInArrow(search, f"profile {types[0]}, arxiv_id {types[1]}")


def _grade(*cases: tuple[Column, int]) -> Column:
    """The vote of the first case that holds, 0 (no vote) if none does."""
    vote = F.lit(0)
    for case, value in reversed(cases):
        vote = F.when(case, value).otherwise(vote)
    return vote.cast("tinyint")


def _flat(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda a: F.array_join(a, " ")), ";")


def _unflat(flat: Column) -> Column:
    return F.transform(F.filter(F.split(flat, ";"), lambda a: a != ""), lambda a: F.split(a, " "))


def compared(pairs: DataFrame, profiles: DataFrame, papers: DataFrame) -> DataFrame:
    """(profile, arxiv_id, copies, votes): pairs that share title words enough, with a graded vote of each heuristic."""
    # plain strings travel better than arrays; what is made of them is made where pairs meet
    described = papers.select(
        "arxiv_id", "copies", "title", _flat(F.col("names")).alias("p_flat"), F.col("year").alias("p_year")
    )
    asked = profiles.select("profile", "text", "whole", _flat(F.col("names")).alias("flat"), "et_al", "year")
    joined = (
        pairs.join(described, "arxiv_id")
        .join(asked, "profile")
        .withColumns({"p": _letters("title"), "p_words": _word_hashes("title"), "r": _letters("text"), "r_words": _word_hashes("text")})
        .withColumns({"names": _unflat(F.col("flat")), "p_names": _unflat(F.col("p_flat"))})
    )
    common = F.size(F.array_intersect("r_words", "p_words"))
    whole = F.col("whole")
    same = (F.col("r") == F.col("p")) | (whole & F.col("r").contains(F.col("p")))
    part = (F.length("r") >= 25) & (
        F.col("p").startswith(F.col("r")) | F.col("p").endswith(F.col("r"))
    )
    shared = (
        joined.withColumn("of_paper", common / F.greatest(F.size("p_words"), F.lit(1)))
        .withColumn("of_ref", common / F.greatest(F.size("r_words"), F.lit(1)))
        .withColumn("same", same)
        .withColumn("part", part)
        .withColumn("enough", F.expr("same or part or of_paper >= 0.4 or (of_ref >= 0.6 and not whole)"))
    )
    longest = F.greatest(F.length("r"), F.length("p"))
    # worked out as far as it matters: -1 beyond three edits in ten
    edits = F.when(F.col("same"), 0).when(
        F.greatest("of_paper", "of_ref") >= 0.6,
        F.expr("levenshtein(r, p, cast(ceil(0.3 * greatest(length(r), length(p))) as int))"),
    )
    edits = F.when(~whole, F.coalesce(edits, F.lit(-1)))
    # in a raw text the longest title that it holds is the best explanation
    held = F.when(whole & F.col("same"), F.length("p"))
    most = F.max(held).over(Window.partitionBy("profile"))
    of_paper, of_ref = F.col("of_paper"), F.col("of_ref")
    names, p_names = F.col("names"), F.flatten("p_names")
    p_first = F.element_at(F.get("p_names", F.lit(0)), -1)
    first_edits = F.array_min(
        F.transform(F.get("names", F.lit(0)), lambda w: F.levenshtein(w, p_first))
    )
    every = (
        shared.withColumn("edits", edits)
        .withColumn("agreed", F.size(F.filter(names, lambda a: F.arrays_overlap(a, p_names))))
        .withColumn("apart", F.abs(F.col("year") - F.col("p_year")))
        .withColumn("first", first_edits)
        .withColumn("strange", ~((F.size("names") > 0) & (F.size("p_names") > 0)))
    )
    strange, agreed, apart = F.col("strange"), F.col("agreed"), F.col("apart")
    votes = every.select(
        "profile",
        "arxiv_id",
        "copies",
        "enough",
        _grade((F.col("same"), 2), (F.col("part"), 1), (of_paper < 0.6, -1)).alias("v_title"),
        _grade((of_paper >= 1, 2), (of_paper >= 0.85, 1), (of_paper >= 0.6, 0), (of_paper >= 0.4, -1), (of_paper >= 0, -2)).alias("v_paper_words"),
        _grade((whole, 0), (of_ref >= 1, 2), (of_ref >= 0.85, 1), (of_ref >= 0.6, 0), (of_ref >= 0.4, -1), (of_ref >= 0, -2)).alias("v_ref_words"),
        _grade(
            (F.col("edits").isNull(), 0),
            (F.col("edits") == 0, 3),
            (F.col("edits") < 0, -1),
            (F.col("edits") <= 2, 2),
            (F.col("edits") <= 0.12 * longest, 1),
        ).alias("v_edits"),
        _grade((held == most, 1), (held < most, -1)).alias("v_longest"),
        _grade(
            (strange, 0),
            ((agreed == F.size("names")) & (agreed >= 2), 2),
            (agreed * 2 >= F.size("names"), 1),
            (agreed == 0, -1),
        ).alias("v_authors"),
        _grade((strange, 0), (F.col("first") == 0, 2), (F.col("first") <= 2, 1), (F.col("first") > 2, -1)).alias("v_first_author"),
        _grade(
            (strange, 0),
            (F.size("names") > F.size("p_names"), -1),
            (~F.col("et_al") & (F.size("names") == F.size("p_names")), 1),
        ).alias("v_author_count"),
        _grade((apart == 0, 1), (apart > 3, -2), (apart > 1, -1)).alias("v_year"),
    )
    # after the window, where the filter can't become a condition of the join that works out all words again;
    # pairs that hold the title, which the window compares, are always enough
    return votes.where("enough").drop("enough")


def linked(refs: DataFrame, papers: DataFrame, reading_list: DataFrame) -> DataFrame:
    """(profile, ref_id, arxiv_id, confidence): for each reference its most likely paper.

    Only references without arxiv_id and doi are matched. References without
    title and raw text, or without any candidate, are missing; equal evidence
    for several papers splits the confidence between them, and the lowest
    arxiv_id is listed.
    """
    # numbers in the order of the ids, which are written once, as short keys of all that follows
    numbered = cut(paper_records(papers, reading_list).orderBy("arxiv_id").withColumn("paper", F.monotonically_increasing_id()))
    records = numbered.drop("arxiv_id").withColumnRenamed("paper", "arxiv_id")
    members, distinct = reference_profiles(refs)
    described = cut(distinct.withColumnRenamed("profile", "hash").withColumn("profile", F.monotonically_increasing_id()))
    profiles = described.drop("hash")
    pairs = cut(candidates(profiles, records))
    unsure = pairs.where("arxiv_id is null").select("profile").distinct()
    pairs = pairs.where("arxiv_id is not null")
    first = cut(compared(pairs.join(unsure, "profile", "left_anti"), profiles, records))
    left = cut(profiles.join(first.select("profile").distinct(), "profile", "left_anti"))
    found = pairs.join(unsure, "profile", "left_semi").unionByName(further_candidates(left, records)).distinct()
    second = compared(found, left, records)
    voted = cut(first.unionByName(second))
    # grades are few, so patterns are at most 1.5 million, however many candidates
    patterns = voted.groupBy(*VOTERS).count().toPandas()
    patterns["log_odds"] = log_odds(patterns[VOTERS].to_numpy(np.int64), patterns["count"].to_numpy())
    spark = voted.sparkSession
    schema = ", ".join(f"{v} tinyint" for v in VOTERS) + ", log_odds double"
    table = spark.createDataFrame(patterns[[*VOTERS, "log_odds"]], schema)
    each = Window.partitionBy("profile")
    odds = F.exp("log_odds")
    best = F.row_number().over(each.orderBy(F.desc("log_odds"), "arxiv_id"))
    judged = (
        voted.join(table, VOTERS)
        .withColumn("_best", best)
        .withColumn("confidence", odds / (1 + F.sum(odds * F.col("copies")).over(each)))
        .where("_best = 1")
        .select("profile", F.col("arxiv_id").alias("paper"), "confidence")
    )
    named = judged.join(numbered.select("paper", "arxiv_id"), "paper").join(described.select("profile", "hash"), "profile")
    return members.join(named.select(F.col("hash").alias("profile"), "arxiv_id", "confidence"), "profile")
