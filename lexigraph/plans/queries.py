"""The registered queries of the core, each with its comparison SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from lexigraph.functions import text as tx
from lexigraph.operators import (
    answers,
    chunking,
    dense,
    dialogue,
    evaluation,
    extraction,
    fusion,
    graph,
    graph_retrieval,
    hot_keys,
    lexical,
)
from lexigraph.plans import converse, corpus
from lexigraph.plans.build import search_index
from lexigraph.plans.engine import METHODS, Engine
from lexigraph.session import cut, ensure_checkpoint_dir, settled
from lexigraph.sources import sessions
from lexigraph.sources.tables import read_table
from lexigraph.streaming import citations as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its comparison SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(settled(spark), sf_dir)
        if sql:
            ORACLES[name] = sql
        return f

    return register


# -- keys that hold most records ------------------------------------------------

PAIRS_SQL = """pairs AS MATERIALIZED (
  SELECT DISTINCT arxiv_id AS src, dst FROM (
    SELECT arxiv_id, regexp_replace(trim(unnest(cited_arxiv_ids)), 'v[0-9]+$', '') AS dst FROM citations
  ) WHERE arxiv_id IS NOT NULL AND dst IS NOT NULL AND dst <> '' AND arxiv_id <> dst
)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_keys.citation_pairs(
        read_table(spark, sf_dir, "citations", "arxiv_id", "cited_arxiv_ids")
    )


@query(
    "p4_found",
    f"""WITH {PAIRS_SQL}, n AS (SELECT count(*) AS total FROM pairs),
    c AS (
      SELECT 'citing' AS side, src AS arxiv_id, count(*) AS k FROM pairs GROUP BY src
      UNION ALL SELECT 'cited', dst, count(*) FROM pairs GROUP BY dst
    ) SELECT side, arxiv_id FROM c, n WHERE k >= 0.03 * total""",
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = {"citing": "src", "cited": "dst"}
    return hot_keys.heavy_hitters(_pairs(spark, sf_dir), sides, 0.03).select("side", "arxiv_id")


@query(
    "p4_cited_counts",
    f"WITH {PAIRS_SQL} SELECT dst AS arxiv_id, count(*) AS citations FROM pairs GROUP BY dst",
)
def p4_cited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = hot_keys.count_per_key(_pairs(spark, sf_dir), "dst", "citations")
    return counts.withColumnRenamed("dst", "arxiv_id")


@query(
    "p4_citing_counts",
    f'WITH {PAIRS_SQL} SELECT src AS arxiv_id, count(*) AS "references" FROM pairs GROUP BY src',
)
def p4_citing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = hot_keys.count_per_key(_pairs(spark, sf_dir), "src", "references")
    return counts.withColumnRenamed("src", "arxiv_id")


@query("p4_cited_lists")
def p4_cited_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_keys.lists_per_key(_pairs(spark, sf_dir), "src", "dst").withColumnRenamed(
        "src", "arxiv_id"
    )


@query(
    "p4_list_digests",
    f"""WITH {PAIRS_SQL} SELECT src AS arxiv_id, count(*) AS n, sum(('0x' || substring(md5(dst), 1, 8))::bigint)::bigint AS digest FROM pairs GROUP BY src""",
)
def p4_list_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of every list hold together: the number of its ids and a sum of their digests."""
    pieces = hot_keys.lists_per_key(_pairs(spark, sf_dir), "src", "dst")
    ids = pieces.select(F.col("src").alias("arxiv_id"), F.explode("values").alias("dst"))
    digest = F.conv(F.substring(F.md5("dst"), 1, 8), 16, 10).cast("bigint")
    return ids.groupBy("arxiv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(digest).alias("digest"))


# -- lexical ranking --------------------------------------------------------------

BLANK_SQL = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def tokens_sql(text: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '{BLANK_SQL}'),"
        " lambda x: length(x) > 1)"
    )


def bm25_sql(corpus_cte: str, key: str, queries_cte: str, k: int, prefix: str = "b") -> str:
    """CTEs that end in <prefix>_top (qid, key, rank, score, normalized)."""
    t = prefix
    return f"""
    {t}_tok AS (SELECT {key}, {tokens_sql('text')} AS t FROM {corpus_cte}),
    {t}_size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {t}_tok),
    {t}_post AS MATERIALIZED (
      SELECT term, {key}, dl, count(*) AS tf
      FROM (SELECT {key}, len(t) AS dl, unnest(t) AS term FROM {t}_tok) GROUP BY ALL),
    {t}_raw AS (
      SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw
      FROM (SELECT term, count(*) AS df FROM {t}_post GROUP BY term), {t}_size),
    {t}_idf AS MATERIALIZED (
      SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {t}_raw) ELSE raw END AS idf FROM {t}_raw),
    {t}_q AS (
      SELECT qid, term, count(*) AS times
      FROM (SELECT qid, unnest({tokens_sql('query')}) AS term FROM {queries_cte}) GROUP BY ALL),
    {t}_score AS (
      SELECT qid, {key}, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
      FROM {t}_q JOIN {t}_post USING (term) JOIN {t}_idf USING (term), {t}_size GROUP BY qid, {key}),
    {t}_rank AS (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {key}) AS rank FROM {t}_score WHERE score > 0),
    {t}_top AS (
      SELECT qid, {key}, rank, score, score / max(score) OVER (PARTITION BY qid) AS normalized
      FROM {t}_rank WHERE rank <= {k})"""


DOC_QUERIES_SQL = "dq AS (SELECT doc_id AS qid, title AS query FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL)"


def _doc_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: titles of all documents whose id is divisible by 20."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "title")
    return docs.where("doc_id % 20 = 0 and title is not null").select(
        F.col("doc_id").alias("qid"), F.col("title").alias("query")
    )


def _doc_postings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    posts = cut(lexical.postings(docs, "doc_id", F.col("text")))
    return posts, cut(lexical.corpus_size(docs.select("doc_id"), posts))


def _doc_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    posts, size = _doc_postings(spark, sf_dir)
    idf = cut(lexical.weights(posts, size))
    return lexical.impacts(posts, size, "doc_id", idf), idf


@query(
    "tokenize_stats",
    f"""SELECT source, count(*) AS docs, sum(len(t))::bigint AS tokens FROM (
      SELECT source, {tokens_sql('text')} AS t FROM documents) GROUP BY source""",
)
def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "source", "text")
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.size(tx.tokens(F.col("text")))).alias("tokens")
    )


@query(
    "bm25_vocab_idf",
    f"WITH {DOC_QUERIES_SQL}, {bm25_sql('documents', 'doc_id', 'dq', 10)}"
    " SELECT term, df, round(idf, 6) AS idf FROM b_idf",
)
def bm25_vocab_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.weights(*_doc_postings(spark, sf_dir))
    return found.withColumn("idf", F.round("idf", 6))


@query(
    "bm25_topk",
    f"WITH {DOC_QUERIES_SQL}, {bm25_sql('documents', 'doc_id', 'dq', 10)}"
    " SELECT qid, doc_id, rank, round(score, 6) AS score, round(normalized, 6) AS normalized FROM b_top",
)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = lexical.ranked(_doc_queries(spark, sf_dir), *_doc_index(spark, sf_dir), "doc_id", 10)
    return best.withColumns({"score": F.round("score", 6), "normalized": F.round("normalized", 6)})


_EXCLUDING = bm25_sql("documents", "doc_id", "dq", 10).replace(
    "b_size GROUP BY qid, doc_id", "b_size WHERE qid <> doc_id GROUP BY qid, doc_id"
)


@query(
    "bm25_topk_excluding",
    f"WITH {DOC_QUERIES_SQL}, {_EXCLUDING} SELECT qid, doc_id, rank, round(score, 6) AS score FROM b_top",
)
def bm25_topk_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _doc_queries(spark, sf_dir)
    own = queries.select("qid", F.col("qid").alias("doc_id"))
    best = lexical.ranked(queries, *_doc_index(spark, sf_dir), "doc_id", 10, own)
    return best.select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


# -- dense ranking ----------------------------------------------------------------

DENSE_SQL = """
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS v FROM embeddings),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
s AS (
  SELECT q.vec_id AS qid, q.label AS q_label, d.vec_id, d.label, round(list_dot_product(q.v, d.v), 9) AS score
  FROM u q, u d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id)"""


def _embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    data = dense.unit_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id")
    return data.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "vec"), data


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings", "vec_id", "label")


def _top_sql(where: str = "true", k: int = 10) -> str:
    return f"""SELECT qid, vec_id, label, q_label, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s WHERE {where}
    ) WHERE rank <= {k}"""


@query("dense_topk", f"WITH {DENSE_SQL} SELECT qid, vec_id, rank, round(score, 6) AS score FROM ({_top_sql()})")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, data = _embeddings(spark, sf_dir)
    found = dense.nearest(queries, data, "vec_id", 10, same=True)
    return found.withColumn("score", F.round("score", 6))


@query(
    "dense_topk_prefiltered",
    f"WITH {DENSE_SQL} SELECT qid, vec_id, rank, round(score, 6) AS score FROM ({_top_sql('label in (1, 3, 5)')})",
)
def dense_topk_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, data = _embeddings(spark, sf_dir)
    wanted = _labels(spark, sf_dir).where(F.col("label").isin(1, 3, 5)).select("vec_id")
    found = dense.nearest(queries, data.join(wanted, "vec_id", "left_semi"), "vec_id", 10, same=True)
    return found.withColumn("score", F.round("score", 6))


@query(
    "dense_topk_postfiltered",
    f"WITH {DENSE_SQL} SELECT qid, vec_id, rank, round(score, 6) AS score FROM ({_top_sql()}) WHERE label <> q_label",
)
def dense_topk_postfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, data = _embeddings(spark, sf_dir)
    labels = _labels(spark, sf_dir)
    own = labels.select(F.col("vec_id").alias("qid"), F.col("label").alias("q_label"))
    found = dense.nearest(queries, data, "vec_id", 10, same=True).join(labels, "vec_id").join(own, "qid")
    return found.where("label <> q_label").select("qid", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(
    "vector_first_wins",
    """SELECT chunk_id, arxiv_id, section_name, position FROM (
      SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY position, arxiv_id, section_name) AS r FROM vector_index
    ) WHERE r = 1""",
)
def vector_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "vector_index", "chunk_id", "arxiv_id", "section_name", "position")
    return dense.first_of_each(rows, "chunk_id", "position", "arxiv_id", "section_name")


@query(
    "vector_upsert",
    """WITH v AS (SELECT chunk_id, max(position) AS position FROM vector_index GROUP BY chunk_id),
    c AS (SELECT chunk_id, max(position) AS position FROM chunks GROUP BY chunk_id)
    SELECT v.chunk_id, v.position, 'kept' AS state FROM v ANTI JOIN c USING (chunk_id)
    UNION ALL SELECT chunk_id, position, 'written' FROM c""",
)
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    def latest(name: str, state: str) -> DataFrame:
        rows = read_table(spark, sf_dir, name, "chunk_id", "position")
        return rows.groupBy("chunk_id").agg(F.max("position").alias("position")).withColumn(
            "state", F.lit(state)
        )

    return dense.upserted(latest("vector_index", "kept"), latest("chunks", "written"), "chunk_id")


# -- text of papers ---------------------------------------------------------------

EXTRACTED_SQL = "x AS (SELECT arxiv_id, max(full_text) AS full_text, max(references_text) AS references_text FROM extracted WHERE arxiv_id IS NOT NULL GROUP BY arxiv_id)"


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per paper: repeated extractions differ in metadata only."""
    rows = read_table(spark, sf_dir, "extracted", "arxiv_id", "full_text", "references_text")
    return rows.where("arxiv_id is not null").groupBy("arxiv_id").agg(
        F.max("full_text").alias("full_text"), F.max("references_text").alias("references_text")
    )


@query(
    "extracted_titles",
    f"""WITH {EXTRACTED_SQL} SELECT arxiv_id, coalesce(list_filter(
      list_transform(list_slice(string_split(coalesce(full_text, ''), chr(10)), 1, 20), lambda l: trim(l)),
      lambda l: length(l) > 15 AND NOT starts_with(lower(l), 'arxiv'))[1], 'Unknown Title') AS title FROM x""",
)
def extracted_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).select(
        "arxiv_id", extraction.title_of(F.col("full_text")).alias("title")
    )


def _strip_sql(t: str) -> str:
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


LINES_SQL = f"""{EXTRACTED_SQL},
l AS MATERIALIZED (SELECT arxiv_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
  FROM (SELECT arxiv_id, string_split(full_text, chr(10)) AS a FROM x WHERE full_text IS NOT NULL))"""


def _abstract_sql(pattern: str) -> str:
    flat = _strip_sql(f"regexp_replace(regexp_extract(full_text, '{pattern}', 1), '\\s+', ' ', 'g')")
    return f"CASE WHEN length({flat}) > 50 THEN {flat} END"


@query(
    "extracted_abstracts",
    f"""WITH {LINES_SQL},
    n AS (SELECT *, {_strip_sql('line')} = '' AS blank, regexp_matches(line, '^\\d+\\.?\\s+(Introduction|INTRODUCTION)') AS intro FROM l),
    at_ AS (SELECT arxiv_id, pos AS i FROM l WHERE pos <= 50 AND contains(lower(line), 'abstract')),
    j AS (SELECT at_.arxiv_id, i, pos, line, blank, intro FROM at_ JOIN n ON n.arxiv_id = at_.arxiv_id AND pos > i AND pos < i + 30),
    st AS (SELECT arxiv_id, i, min(pos) FILTER (NOT blank) AS first, coalesce(min(pos) FILTER (intro), 1000000) AS intro FROM j GROUP BY ALL),
    en AS (SELECT j.arxiv_id, j.i, any_value(st.first) AS first, least(any_value(st.intro), coalesce(min(pos) FILTER (blank AND pos > st.first), 1000000)) AS stop
      FROM j JOIN st ON st.arxiv_id = j.arxiv_id AND st.i = j.i GROUP BY ALL),
    ga AS (SELECT j.arxiv_id, j.i, string_agg({_strip_sql('line')}, ' ' ORDER BY pos) AS t FROM j JOIN en ON en.arxiv_id = j.arxiv_id AND en.i = j.i
      WHERE NOT blank AND pos >= first AND pos < stop GROUP BY ALL),
    by_line AS (SELECT arxiv_id, arg_min(t, i) AS t FROM ga WHERE t <> '' GROUP BY 1)
    SELECT arxiv_id, CASE WHEN full_text IS NOT NULL THEN coalesce(
      {_abstract_sql('(?is)abstract[.\\s\\-—]*\\n(.*?)(?:\\n\\s*\\n|\\n(?:\\d+\\.?\\s+)?introduction)')},
      {_abstract_sql('(?is)abstract[.\\s\\-—]*(.*?)(?:(?:\\d+\\.?\\s+)?introduction|keywords|1\\s)')}, t, '') END AS abstract FROM x LEFT JOIN by_line USING (arxiv_id)""",
)
def extracted_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).select(
        "arxiv_id", extraction.abstract_of(F.col("full_text")).alias("abstract")
    )


@query(
    "extracted_references",
    f"""WITH {EXTRACTED_SQL} SELECT arxiv_id, trim(string_split_regex(regexp_extract(full_text,
      '(?is)\\n\\s*(?:\\d+\\.?\\s+)?(?:references|bibliography)\\s*\\n(.*)$', 1),
      '(?i)\\n\\s*(?:appendix|supplementary)\\b')[1]) AS references_text FROM x""",
)
def extracted_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).select(
        "arxiv_id", extraction.references_of(F.col("full_text")).alias("references_text")
    )


HEADS_SQL = (
    "abstract|introduction|related\\s+work|background|method(?:s|ology)?|approach|model(?:\\s+architecture)?"
    "|experiment(?:s|al\\s+(?:setup|results))?|results?(?:\\s+and\\s+(?:discussion|analysis))?|discussion|analysis"
    "|evaluation|conclusion(?:s)?|future\\s+work|limitations?|references?|bibliography|appendix(?:\\s+[a-z])?|acknowledgement(?:s)?"
)


@query(
    "section_segments",
    f"""WITH {LINES_SQL},
    t AS (SELECT *, {_strip_sql('line')} AS name FROM l),
    h AS (SELECT *, length(name) BETWEEN 1 AND 100 AND (regexp_matches(name, '(?i)^(?:\\d+\\.?\\s+)?({HEADS_SQL})\\s*$') OR (
      regexp_matches(name, '^(\\d+(?:\\.\\d+)*)\\s+(.+)$') AND length(regexp_extract(name, '^(\\d+(?:\\.\\d+)*)\\s+(.+)$', 2)) < 80
      AND len(string_split(regexp_extract(name, '^(\\d+(?:\\.\\d+)*)\\s+(.+)$', 1), '.')) <= 2)) AS head FROM t),
    m AS (SELECT *, sum(head::int) OVER (PARTITION BY arxiv_id ORDER BY pos) AS no FROM h),
    g AS (SELECT arxiv_id, no, max(CASE WHEN head THEN name END) AS name,
          {_strip_sql("coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT head), '')")} AS text FROM m WHERE no > 0 GROUP BY arxiv_id, no),
    k AS (SELECT arxiv_id, no::bigint AS ord, name, text FROM g WHERE length(text) >= 50)
    SELECT * FROM k UNION ALL SELECT arxiv_id, 0, 'Full Text', {_strip_sql('full_text')} FROM x ANTI JOIN k USING (arxiv_id) WHERE {_strip_sql('full_text')} <> ''""",
)
def section_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.sections(_extracted(spark, sf_dir), "arxiv_id", "full_text")


SPLIT_SQL = f"""{EXTRACTED_SQL}, s AS (
  SELECT arxiv_id, string_split_regex(references_text, '\\n\\s*\\[\\d+\\]') AS a, regexp_extract_all(references_text, '\\n\\s*\\[(\\d+)\\]', 1) AS no,
    string_split(regexp_replace(references_text, '\\n([A-Z][a-z]+,?\\s+[A-Z])', chr(1) || '\\1', 'g'), chr(1)) AS w,
    string_split_regex(references_text, '\\n\\s*\\n') AS b, string_split(references_text, chr(10)) AS c FROM x WHERE references_text IS NOT NULL),
p AS (SELECT arxiv_id, CASE WHEN len(a) > 2 THEN list_transform(generate_series(1, len(no)), lambda i: '[' || no[i] || '] ' || {_strip_sql('a[i + 1]')})
  WHEN len(w) > 3 THEN list_filter(list_transform(w, lambda r: {_strip_sql('r')}), lambda r: r <> '')
  WHEN len(b) > 2 THEN list_filter(list_transform(b, lambda r: {_strip_sql('r')}), lambda r: r <> '')
  ELSE list_filter(list_transform(c, lambda r: {_strip_sql('r')}), lambda r: length(r) > 20) END AS r FROM s),
split AS MATERIALIZED (SELECT arxiv_id, generate_subscripts(r, 1) - 1 AS ord, unnest(r) AS raw_text FROM p)"""


@query("reference_split", f"WITH {SPLIT_SQL} SELECT arxiv_id, ord, raw_text FROM split")
def reference_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _extracted(spark, sf_dir).where("references_text is not null")
    return texts.select(
        "arxiv_id",
        F.posexplode(extraction.split_references(F.col("references_text"))).alias("ord", "raw_text"),
    )


FIELDS_SQL = """regexp_replace(nullif(regexp_extract(raw_text, '(\\d{4}\\.\\d{4,5}(?:v\\d+)?)', 1), ''), 'v\\d+$', '') AS parsed_arxiv_id,
  regexp_replace(nullif(regexp_extract(raw_text, '(10\\.\\d{4,}/[^\\s,]+)', 1), ''), '\\.+$', '') AS parsed_doi,
  regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(raw_text, '["\u201c]([^"\u201d]{15,200})["\u201d]', 1), ''),
    nullif(regexp_extract(raw_text, '(?m)(?:^|\\n)\\s*\\[?\\d+\\]?\\s*[A-Z][^.]+?\\.\\s+(.{15,200}?)\\.\\s+(?:In\\s|Proceedings|arXiv|Journal|Trans)', 1), '')),
    '^\\s+|\\s+$', '', 'g'), '\\.+$', '') AS parsed_title,
  try_cast(nullif(regexp_extract(raw_text, '\\b(20[012]\\d)\\b', 1), '') AS int) AS parsed_year"""


@query("reference_parse", f"SELECT ref_id, {FIELDS_SQL} FROM parsed_refs")
def reference_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = read_table(spark, sf_dir, "parsed_refs", "ref_id", "raw_text")
    return extraction.reference_fields(refs).drop("raw_text")


def _norm_sql(t: str) -> str:
    kept = f"regexp_replace(trim(lower({t})), '[^a-z0-9\\s]', '', 'g')"
    return f"trim(regexp_replace({kept}, '\\s+', ' ', 'g'))"


@query(
    "title_match",
    f"""WITH t AS (SELECT {_norm_sql('title')} AS t, max(arxiv_id) AS dst FROM papers WHERE title IS NOT NULL GROUP BY 1)
    SELECT ref_id, dst FROM parsed_refs r JOIN t ON {_norm_sql('r.title')} = t.t WHERE t.t <> '' AND src_arxiv_id <> dst""",
)
def title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = read_table(spark, sf_dir, "parsed_refs", "ref_id", "src_arxiv_id", "title").select(
        F.col("src_arxiv_id").alias("src"), F.col("ref_id").alias("ord"), "title"
    )
    papers = read_table(spark, sf_dir, "papers", "arxiv_id", "title")
    found = extraction.matched_titles(refs, papers, tx.normalized_title)
    return found.select(F.col("ord").alias("ref_id"), "dst")


CITED_SQL = f"""{SPLIT_SQL}, pf AS MATERIALIZED (SELECT arxiv_id AS src, ord, {FIELDS_SQL} FROM split),
tt AS (SELECT {_norm_sql('title')} AS t, max(arxiv_id) AS dst FROM papers WHERE title IS NOT NULL GROUP BY 1),
ce AS MATERIALIZED (SELECT src, parsed_arxiv_id AS dst FROM pf WHERE parsed_arxiv_id <> src
  UNION SELECT src, dst FROM pf JOIN tt ON {_norm_sql('parsed_title')} = t WHERE t <> '' AND src <> dst)"""


def _parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parsed = cut(extraction.parsed_references(_extracted(spark, sf_dir)))
    papers = read_table(spark, sf_dir, "papers", "arxiv_id", "title")
    return parsed, extraction.citation_edges(parsed, papers, tx.normalized_title)


@query("citation_parse", f"WITH {CITED_SQL} SELECT src, dst FROM ce")
def citation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir)[1]


@query(
    "citation_summary",
    f"""WITH {CITED_SQL} SELECT arxiv_id, num_references, num_titles, coalesce(c, 0) AS num_cited FROM (
      SELECT src AS arxiv_id, count(*) AS num_references, count(parsed_title) AS num_titles FROM pf GROUP BY 1)
    LEFT JOIN (SELECT src AS arxiv_id, count(*) AS c FROM ce GROUP BY 1) USING (arxiv_id)""",
)
def citation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.citation_summary(*_parsed(spark, sf_dir))


@query(
    "chunk_windows",
    rf"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{BLANK_SQL}'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
    n AS (SELECT *, CASE WHEN len(w) > 512 THEN ceil((len(w) - 102) / 410.0)::int ELSE 1 END AS n FROM w),
    i AS (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM n)
    SELECT doc_id, i AS piece, CASE WHEN len(w) > 512 THEN array_to_string(list_slice(w, i * 410 + 1, i * 410 + 512), ' ') ELSE text END AS text FROM i""",
)
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.word_windows(read_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def _words_sql(t: str) -> str:
    return f"len(list_filter(regexp_split_to_array({t}, '{BLANK_SQL}'), lambda w: w <> ''))"


# a fold over the paragraphs p of each k of ps; fold_out (k, piece, text) are its chunks
FOLD_SQL = f"""fold AS (
  SELECT k, 0 AS i, ''::varchar AS cur, 0 AS closed, NULL::varchar AS out FROM ps
  UNION ALL
  SELECT k, i + 1, CASE WHEN too_long THEN array_to_string(list_slice(cw, greatest(len(cw) - 101, 1), len(cw)), ' ') || chr(10) || chr(10) || nxt
      WHEN cur = '' THEN nxt ELSE cur || chr(10) || chr(10) || nxt END, closed + too_long::int, CASE WHEN too_long THEN cur END
  FROM (SELECT *, cur <> '' AND len(cw) + {_words_sql('nxt')} > 512 AS too_long FROM (
    SELECT f.k, i, cur, closed, p[i + 1] AS nxt, list_filter(regexp_split_to_array(cur, '{BLANK_SQL}'), lambda w: w <> '') AS cw
    FROM fold f JOIN ps ON ps.k = f.k WHERE i < len(p)))),
fold_out AS (SELECT k, closed - 1 AS piece, out AS text FROM fold WHERE out IS NOT NULL
  UNION ALL SELECT f.k, closed, cur FROM fold f JOIN ps ON ps.k = f.k WHERE i = len(p) AND {_words_sql('cur')} >= 50)"""


def paragraphs_sql(text: str, split: str) -> str:
    good = f"list_filter(list_transform({split}, lambda x: trim(x)), lambda x: {_words_sql('x')} >= 10)"
    return f"CASE WHEN len({good}) > 0 THEN {good} ELSE [{text}] END"


@query(
    "chunk_paragraph_merge",
    f"""WITH RECURSIVE ps AS MATERIALIZED (SELECT doc_id AS k, {paragraphs_sql('text', 'string_split(text, chr(10))')} AS p FROM documents WHERE text IS NOT NULL),
    {FOLD_SQL} SELECT k AS doc_id, piece, text FROM fold_out""",
)
def chunk_paragraph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    merged = chunking.merged_paragraphs(F.col("text"), delimiter="\n")
    return docs.select("doc_id", F.posexplode(merged).alias("piece", "text"))


@query(
    "chunk_pipeline",
    f"""WITH RECURSIVE one AS MATERIALIZED (SELECT arxiv_id, any_value(abstract) AS abstract, any_value(sections) AS sections FROM extracted WHERE arxiv_id IS NOT NULL GROUP BY 1),
    sec AS (SELECT arxiv_id, generate_subscripts(sections, 1) - 1 AS ord, unnest(sections) AS s FROM one),
    us AS MATERIALIZED (SELECT arxiv_id, ord, arxiv_id || '#' || ord AS k, coalesce(s.name, '') AS section_name, s.text AS text, {_words_sql('s.text')} AS n FROM sec
      WHERE s.text IS NOT NULL AND {_words_sql('s.text')} >= 50 AND lower(trim(coalesce(s.name, ''))) NOT IN ('references', 'reference', 'bibliography')),
    ps AS MATERIALIZED (SELECT k, {paragraphs_sql('text', "string_split_regex(text, '" + chr(92) + "n" + chr(92) + "s*" + chr(92) + "n')")} AS p FROM us WHERE n > 512),
    {FOLD_SQL},
    pc AS (SELECT arxiv_id, ord, section_name, 'section' AS chunk_type, 0 AS piece, text FROM us WHERE n <= 512
      UNION ALL SELECT arxiv_id, ord, section_name, 'paragraph', f.piece, f.text FROM us JOIN fold_out f USING (k)),
    nm AS (SELECT *, substring(lower(regexp_replace(trim(regexp_replace(section_name, '[^a-zA-Z0-9{chr(92)}s]', '', 'g')), '{chr(92)}s+', '_', 'g')), 1, 50) AS name FROM pc),
    bs AS (SELECT *, arxiv_id || '_' || name || CASE WHEN chunk_type = 'paragraph' THEN '_p' || piece ELSE '' END AS base FROM nm),
    bd AS (SELECT *, row_number() OVER (PARTITION BY arxiv_id, base ORDER BY ord, piece) AS nth, row_number() OVER (PARTITION BY arxiv_id ORDER BY ord, piece) AS at_ FROM bs),
    made AS (SELECT arxiv_id, arxiv_id || '_abstract' AS chunk_id, 'Abstract' AS section_name, 'abstract' AS chunk_type, 0 AS position, trim(abstract) AS text FROM one WHERE {_words_sql('abstract')} >= 50
      UNION ALL SELECT arxiv_id, CASE WHEN nth = 1 THEN base ELSE base || '_' || nth END, section_name, chunk_type, at_ - 1 + coalesce(({_words_sql('abstract')} >= 50)::int, 0), text FROM bd JOIN one USING (arxiv_id)),
    ev AS (SELECT arxiv_id, concat_ws(chr(10) || chr(10), abstract, array_to_string(list_transform(sections, lambda s: s.text), chr(10) || chr(10))) AS text FROM one ANTI JOIN made USING (arxiv_id)),
    ew AS (SELECT *, list_filter(regexp_split_to_array(text, '{BLANK_SQL}'), lambda x: x <> '') AS w FROM ev),
    ei AS (SELECT *, unnest(generate_series(0, CASE WHEN len(w) > 512 THEN ceil((len(w) - 102) / 410.0)::int ELSE 1 END - 1)) AS i FROM ew)
    SELECT * FROM made UNION ALL SELECT arxiv_id, arxiv_id || '_chunk_' || i, 'Full Text', 'text', i,
      CASE WHEN len(w) > 512 THEN array_to_string(list_slice(w, i * 410 + 1, i * 410 + 512), ' ') ELSE text END FROM ei WHERE trim(text) <> ''""",
)
def chunk_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "extracted", "arxiv_id", "abstract", "sections")
    return chunking.chunks(rows.where("arxiv_id is not null").dropDuplicates(["arxiv_id"]))


@query("chunk_metadata")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of the pipeline with their paper's title, authors and date, and what an encoder gets."""
    return chunking.with_metadata(chunk_pipeline(spark, sf_dir), corpus.metadata(spark, sf_dir))


@query(
    "embedding_texts",
    """SELECT chunk_id, position, 'Title: ' || coalesce(paper_title, '') || chr(10) || 'Section: ' || coalesce(section_name, '') || chr(10) || coalesce(text, '') AS embedding_text FROM chunks""",
)
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.coalesce(c, F.lit("")).alias(c) for c in ("paper_title", "section_name", "text")]
    rows = read_table(spark, sf_dir, "chunks", "chunk_id", "position", "paper_title", "section_name", "text")
    filled = rows.select("chunk_id", "position", *columns)
    return filled.select("chunk_id", "position", chunking.embedding_text("paper_title", "section_name", "text").alias("embedding_text"))


@query(
    "titles_cleaned",
    r"""SELECT arxiv_id, updated, trim(regexp_replace(regexp_replace(title, '(?i)arxiv:\s*\d{4}\.\d{4,5}(v\d+)?(\s*\[[^\]]*\])?', '', 'g'), '\s+', ' ', 'g')) AS title FROM papers""",
)
def titles_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "papers", "arxiv_id", "updated", "title")
    return rows.select("arxiv_id", "updated", tx.clean_title(F.col("title")).alias("title"))


@query(
    "duplicate_counters",
    """SELECT 'vector_index' AS source, count(*) AS rows, count(DISTINCT chunk_id) AS distinct_ids, count(*) - count(DISTINCT chunk_id) AS repeated FROM vector_index
    UNION ALL SELECT 'chunks', count(*), count(DISTINCT chunk_id), count(*) - count(DISTINCT chunk_id) FROM chunks""",
)
def duplicate_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows and distinct ids: what an upsert skips or overwrites."""
    every = None
    for name in ("vector_index", "chunks"):
        ids = read_table(spark, sf_dir, name, "chunk_id")
        one = ids.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).agg(
            F.lit(name).alias("source"), F.sum("n").alias("rows"), F.count("chunk_id").alias("distinct_ids")
        )
        every = one if every is None else every.unionByName(one)
    return every.withColumn("repeated", F.col("rows") - F.col("distinct_ids"))


@query(
    "chunk_names",
    r"""SELECT section_name, count(*) AS n, substring(lower(regexp_replace(trim(regexp_replace(section_name,
      '[^a-zA-Z0-9\s]', '', 'g')), '\s+', '_', 'g')), 1, 50) AS name FROM chunks GROUP BY section_name""",
)
def chunk_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read_table(spark, sf_dir, "chunks", "section_name").groupBy("section_name")
    return counts.agg(F.count(F.lit(1)).alias("n")).withColumn(
        "name", tx.sanitized_name(F.col("section_name"))
    )


# -- citation graph ---------------------------------------------------------------

GRAPH_SQL = f"""{PAIRS_SQL},
papers_in AS (SELECT arxiv_id AS id FROM papers WHERE arxiv_id IS NOT NULL UNION SELECT arxiv_id FROM reading_list WHERE arxiv_id IS NOT NULL),
edges AS MATERIALIZED (SELECT src, dst FROM pairs SEMI JOIN papers_in ON dst = id),
nodes AS MATERIALIZED (SELECT id FROM papers_in UNION SELECT src FROM edges),
around AS MATERIALIZED (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
seeds AS MATERIALIZED (SELECT id AS qid, id FROM nodes WHERE md5(id) LIKE '0%')"""


TITLES_SQL = """titles AS MATERIALIZED (
  SELECT arxiv_id AS id, arg_max(trim(title), (own, updated, title, published)) AS title FROM (
    SELECT arxiv_id, title, published, updated, 1 AS own FROM papers
    UNION ALL SELECT arxiv_id, title, published, '', 0 FROM reading_list) WHERE arxiv_id IS NOT NULL GROUP BY arxiv_id)"""


@query("graph_edges", f"WITH {GRAPH_SQL} SELECT src, dst FROM edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.graph_tables(spark, sf_dir)[1]


DEGREES_SQL = """deg AS (
  SELECT id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM nodes
  LEFT JOIN (SELECT dst AS id, count(*) AS i FROM edges GROUP BY dst) USING (id)
  LEFT JOIN (SELECT src AS id, count(*) AS o FROM edges GROUP BY src) USING (id))"""


@query("graph_degrees", f"WITH {GRAPH_SQL}, {DEGREES_SQL} SELECT * FROM deg")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(*corpus.graph_tables(spark, sf_dir))


@query(
    "graph_neighbours",
    f"""WITH {GRAPH_SQL}, e AS (SELECT src AS id, count(*) AS either FROM around GROUP BY src), {DEGREES_SQL}
    SELECT id, out_degree AS cited, in_degree AS citing, coalesce(either, 0) AS either FROM deg LEFT JOIN e USING (id) WHERE in_degree + out_degree > 0""",
)
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_retrieval.neighbours(corpus.graph_tables(spark, sf_dir)[1])


def components_sql(rounds: int = 12) -> str:
    steps = ["c0 AS MATERIALIZED (SELECT id, id AS c FROM nodes)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"""c{i} AS MATERIALIZED (SELECT p.id, least(p.c, coalesce(m.c, p.c)) AS c FROM c{i - 1} p LEFT JOIN (
            SELECT a.src AS id, min(x.c) AS c FROM around a JOIN c{i - 1} x ON a.dst = x.id GROUP BY a.src) m ON p.id = m.id)"""
        )
    return ", ".join(steps) + f", comp AS (SELECT id, c AS component FROM c{rounds})"


@query("graph_components", f"WITH {GRAPH_SQL}, {components_sql()} SELECT * FROM comp")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(*corpus.graph_tables(spark, sf_dir))


@query(
    "graph_stats",
    f"""WITH {GRAPH_SQL}, {DEGREES_SQL}, {components_sql()},
    k AS (SELECT component, count(*) AS size FROM comp GROUP BY component)
    SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges,
      round((SELECT avg(in_degree) FROM deg), 6) AS avg_in_degree, (SELECT max(in_degree) FROM deg) AS max_in_degree,
      (SELECT max(out_degree) FROM deg) AS max_out_degree, (SELECT count(*) FROM k) AS components,
      (SELECT max(size) FROM k) AS largest_component,
      round((SELECT count(*) FROM edges) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1.0)), 9) AS density""",
)
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.stats(*corpus.graph_tables(spark, sf_dir))
    return found.withColumns(
        {"avg_in_degree": F.round("avg_in_degree", 6), "density": F.round("density", 9)}
    )


def pagerank_sql(rounds: int = 45) -> str:
    """Power iteration unrolled; ranks stand still once a round has moved less than a millionth a node in all."""
    steps = [
        "n AS (SELECT count(*)::double AS n FROM nodes)",
        "od AS (SELECT src, count(*) AS o FROM edges GROUP BY src)",
        "r0 AS MATERIALIZED (SELECT id, 1 / n AS pr, 0::double AS old FROM nodes, n)",
    ]
    for i in range(1, rounds + 1):
        steps.append(
            f"""e{i} AS MATERIALIZED (SELECT sum(abs(pr - old)) < 1e-6 * any_value(n.n) AS done FROM r{i - 1}, n),
            r{i} AS MATERIALIZED (SELECT nodes.id, CASE WHEN e.done THEN p.pr ELSE 0.15 / n.n + 0.85 * l.lost / n.n + 0.85 * coalesce(g.got, 0) END AS pr, p.pr AS old
            FROM nodes JOIN r{i - 1} p ON p.id = nodes.id LEFT JOIN (SELECT dst AS id, sum(p.pr / od.o) AS got FROM edges JOIN od USING (src) JOIN r{i - 1} p ON p.id = src GROUP BY dst) g ON g.id = nodes.id,
            n, e{i} e, (SELECT coalesce(sum(pr), 0) AS lost FROM r{i - 1} ANTI JOIN od ON id = od.src) l)"""
        )
    return ", ".join(steps) + f", pr AS MATERIALIZED (SELECT id, pr AS pagerank FROM r{rounds})"


@query("graph_pagerank", f"WITH {GRAPH_SQL}, {pagerank_sql()} SELECT id, round(pagerank, 9) AS pagerank FROM pr")
def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = graph.pagerank(*corpus.graph_tables(spark, sf_dir))
    return ranks.withColumn("pagerank", F.round("pagerank", 9))


@query(
    "graph_top_papers",
    f"""WITH {GRAPH_SQL}, {TITLES_SQL}, {pagerank_sql()} SELECT t.id, t.pagerank, title FROM (
      SELECT id, round(pagerank, 9) AS pagerank FROM pr ORDER BY 2 DESC, 1 LIMIT 20) t LEFT JOIN titles USING (id)""",
)
def graph_top_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = graph.pagerank(*corpus.graph_tables(spark, sf_dir))
    return graph.top_ranked(ranks, corpus.papers(spark, sf_dir))


def communities_sql(rounds: int = 5) -> str:
    steps = [
        "own AS MATERIALIZED (SELECT src, dst FROM around UNION ALL SELECT id, id FROM nodes)",
        "l0 AS MATERIALIZED (SELECT id, id AS c FROM nodes)",
    ]
    for i in range(1, rounds + 1):
        steps.append(
            f"""l{i} AS MATERIALIZED (SELECT id, c FROM (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY v DESC, c) AS r FROM (
            SELECT src AS id, c, count(*) AS v FROM own JOIN l{i - 1} x ON x.id = dst GROUP BY src, c)) WHERE r = 1)"""
        )
    return ", ".join(steps) + f", com AS MATERIALIZED (SELECT id, c AS community FROM l{rounds})"


@query("graph_communities", f"WITH {GRAPH_SQL}, {communities_sql()} SELECT * FROM com")
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.communities(*corpus.graph_tables(spark, sf_dir))


@query(
    "graph_community_sizes",
    f"""WITH {GRAPH_SQL}, {communities_sql()} SELECT community, count(*) AS size FROM com GROUP BY community
    ORDER BY size DESC, community LIMIT 10""",
)
def graph_community_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.communities(*corpus.graph_tables(spark, sf_dir))
    sizes = found.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return sizes.orderBy(F.desc("size"), "community").limit(10)


@query(
    "citation_view",
    f"""WITH {GRAPH_SQL}, {TITLES_SQL}, {pagerank_sql()}, {communities_sql()},
    nb AS (SELECT s.id, 'cites' AS side, dst AS neighbour FROM seeds s JOIN edges ON s.id = src UNION ALL SELECT s.id, 'cited_by', src FROM seeds s JOIN edges ON s.id = dst
      UNION ALL SELECT id, 'community', other FROM (SELECT s.id, m.id AS other, row_number() OVER (PARTITION BY s.id ORDER BY m.id) AS r
        FROM seeds s JOIN com c ON c.id = s.id JOIN com m ON m.community = c.community WHERE m.id <> s.id) WHERE r <= 20)
    SELECT nb.id, side, neighbour, coalesce(title, 'Unknown') AS title, round(coalesce(pagerank, 0), 9) AS pagerank
    FROM nb LEFT JOIN titles ON titles.id = neighbour LEFT JOIN pr ON pr.id = neighbour""",
)
def citation_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = corpus.graph_tables(spark, sf_dir)
    found = graph_retrieval.citation_view(
        corpus.seeds(nodes), edges, graph.communities(nodes, edges), graph.pagerank(nodes, edges), corpus.papers(spark, sf_dir)
    )
    return found.withColumn("pagerank", F.round("pagerank", 9))


@query(
    "paper_lookup",
    f"""WITH {GRAPH_SQL}, {TITLES_SQL}, {DEGREES_SQL}, {pagerank_sql()}, {communities_sql()},
    ask AS (SELECT DISTINCT arxiv_id AS asked FROM parsed_refs WHERE arxiv_id IS NOT NULL),
    hit AS (SELECT asked, coalesce(a.id, b.id) AS id FROM ask LEFT JOIN titles a ON a.id = asked LEFT JOIN titles b ON b.id = string_split(asked, 'v')[1])
    SELECT asked, hit.id, title, coalesce(in_degree, 0) AS citations, round(coalesce(pagerank, 0), 9) AS pagerank, community FROM hit JOIN titles ON titles.id = hit.id
    LEFT JOIN deg ON deg.id = hit.id LEFT JOIN pr ON pr.id = hit.id LEFT JOIN com ON com.id = hit.id""",
)
def paper_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every arXiv id that references give, looked up among the papers."""
    nodes, edges = corpus.graph_tables(spark, sf_dir)
    asked = read_table(spark, sf_dir, "parsed_refs", "arxiv_id").where("arxiv_id is not null")
    found = graph_retrieval.looked_up(
        asked.select(F.col("arxiv_id").alias("asked")),
        corpus.papers(spark, sf_dir),
        graph.degrees(nodes, edges),
        graph.pagerank(nodes, edges),
        graph.communities(nodes, edges),
    )
    return found.withColumn("pagerank", F.round("pagerank", 9))


def distances_sql(depth: int) -> str:
    steps = ["d0 AS MATERIALIZED (SELECT qid, id, 0 AS distance FROM seeds)"]
    for i in range(1, depth + 1):
        steps.append(
            f"""d{i} AS MATERIALIZED (SELECT * FROM d{i - 1} UNION ALL SELECT qid, dst, {i} FROM (
            SELECT DISTINCT qid, dst FROM d{i - 1} JOIN around ON id = src WHERE distance = {i - 1}) f
            ANTI JOIN d{i - 1} o ON o.qid = f.qid AND o.id = f.dst)"""
        )
    return ", ".join(steps) + f", dist AS (SELECT * FROM d{depth})"


@query("graph_distances", f"WITH {GRAPH_SQL}, {distances_sql(2)} SELECT * FROM dist")
def graph_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = corpus.graph_tables(spark, sf_dir)
    return graph.distances(corpus.seeds(nodes), edges, 2)


PROXIMITY_SQL = """near AS (SELECT qid, id, 1 / (1.0 + min(distance)) AS proximity FROM dist WHERE distance > 0 GROUP BY qid, id)"""


@query(
    "graph_proximity",
    f"WITH {GRAPH_SQL}, {distances_sql(12)}, {PROXIMITY_SQL} SELECT qid, id, round(proximity, 6) AS proximity FROM near",
)
def graph_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all papers that a stated paper reaches, however far."""
    nodes, edges = corpus.graph_tables(spark, sf_dir)
    near = graph_retrieval.proximity(graph.distances(corpus.seeds(nodes), edges))
    return near.withColumn("proximity", F.round("proximity", 6))


@query(
    "graph_pair_distances",
    f"WITH {GRAPH_SQL}, {distances_sql(12)} SELECT qid, id, distance FROM dist SEMI JOIN (SELECT id AS other FROM seeds) ON id = other",
)
def graph_pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the stated papers, meeting in the middle."""
    nodes, edges = corpus.graph_tables(spark, sf_dir)
    seeds = corpus.seeds(nodes)
    pairs = seeds.select("qid").join(seeds.select("id"), how="cross")  # a stated set with itself
    return graph.pair_distances(pairs, seeds, edges)


# -- finding papers through the graph ----------------------------------------------

EXPANSION_SQL = """ex_out AS (SELECT qid, id AS seed, dst AS id FROM seeds JOIN edges ON id = src),
ex_first AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid, seed ORDER BY id) AS r FROM ex_out) WHERE r <= 5),
ex_all AS (
  SELECT qid, id, 0.8 AS score FROM ex_out
  UNION ALL SELECT qid, src, 0.7 FROM seeds JOIN edges ON id = dst
  UNION ALL SELECT qid, dst, 0.4 FROM ex_first JOIN edges ON id = src),
ex_best AS (SELECT qid, id, max(score)::double AS score FROM ex_all GROUP BY qid, id),
ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank
  FROM ex_best ANTI JOIN seeds USING (qid, id)) WHERE rank <= 33)"""


@query("citation_expansion", f"WITH {GRAPH_SQL}, {EXPANSION_SQL} SELECT qid, id, rank, score FROM ex")
def citation_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = corpus.graph_tables(spark, sf_dir)
    return graph_retrieval.expansion(corpus.seeds(nodes), edges)


PEERS_SQL = """peers AS (
  SELECT DISTINCT s.qid, m.id, p.pagerank FROM seeds s JOIN com c ON c.id = s.id JOIN com m ON m.community = c.community
  JOIN pr p ON p.id = m.id ANTI JOIN seeds x ON x.qid = s.qid AND x.id = m.id),
peer_rank AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(pagerank, 12) DESC, id) AS rank,
  max(pagerank) OVER (PARTITION BY qid) AS best FROM peers),
cp AS (SELECT qid, id, rank, pagerank / best AS score FROM peer_rank WHERE rank <= 33)"""


@query(
    "community_retrieval",
    f"WITH {GRAPH_SQL}, {communities_sql()}, {pagerank_sql()}, {PEERS_SQL} SELECT qid, id, rank, round(score, 6) AS score FROM cp",
)
def community_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = corpus.graph_tables(spark, sf_dir)
    found = graph_retrieval.community_peers(
        corpus.seeds(nodes), graph.communities(nodes, edges), graph.pagerank(nodes, edges)
    )
    return found.select("qid", "id", "rank", F.round("score", 6).alias("score"))


def walk_sql(steps: int = 5) -> str:
    parts = [
        "links AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)",
        """moves AS MATERIALIZED (SELECT src, dst, count(*) / any_value(o) AS p FROM links JOIN (
           SELECT src, count(*)::double AS o FROM links GROUP BY src) USING (src) GROUP BY src, dst)""",
        "w0 AS (SELECT qid, id, 1.0::double AS mass FROM seeds)",
    ]
    for i in range(1, steps + 1):
        parts.append(
            f"w{i} AS MATERIALIZED (SELECT qid, dst AS id, sum(mass * p) AS mass FROM w{i - 1} JOIN moves ON id = src GROUP BY qid, dst)"
        )
    visits = " UNION ALL ".join(f"SELECT qid, id, mass / {i} AS v FROM w{i}" for i in range(1, steps + 1))
    return ", ".join(parts) + f""", wv AS (SELECT qid, id, sum(v) AS v FROM ({visits}) GROUP BY qid, id),
    wn AS (SELECT qid, id, round(v / max(v) OVER (PARTITION BY qid), 9) AS score FROM wv ANTI JOIN seeds USING (qid, id)),
    wk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM wn) WHERE rank <= 33)"""


def biased_walk_sql(steps: int = 5) -> str:
    """The walk from sd, whose steps prefer papers like the query (sq.v)."""
    parts = [
        "lm AS MATERIALIZED (SELECT src, dst, count(*) AS m FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) GROUP BY ALL)",
        "pv AS (SELECT regexp_replace(chunk_id, '_abstract$', '') AS id, v FROM vec WHERE ends_with(chunk_id, '_abstract'))",
        """wt AS MATERIALIZED (SELECT sq.qid, l.id, CASE WHEN sq.v IS NULL THEN 1.0::double WHEN pv.v IS NULL THEN 0.1 ELSE greatest(round(list_dot_product(sq.v, pv.v), 9), 0.01) END AS w
           FROM sq SEMI JOIN sd USING (qid), (SELECT DISTINCT src AS id FROM lm) l LEFT JOIN pv USING (id))""",
        "wa AS MATERIALIZED (SELECT qid, src AS id, sum(w * m) AS a FROM lm JOIN wt ON wt.id = dst GROUP BY ALL)",
        "w0 AS (SELECT qid, id, 1.0::double / count(*) OVER (PARTITION BY qid) AS mass FROM sd)",
    ]
    for i in range(1, steps + 1):
        parts.append(
            f"""w{i} AS MATERIALIZED (SELECT g.qid, g.id, g.mass * wt.w AS mass FROM (
              SELECT p.qid, dst AS id, sum(p.mass / wa.a * m) AS mass FROM w{i - 1} p JOIN wa ON wa.qid = p.qid AND wa.id = p.id JOIN lm ON lm.src = p.id GROUP BY ALL) g
              JOIN wt ON wt.qid = g.qid AND wt.id = g.id)"""
        )
    visits = " UNION ALL ".join(f"SELECT qid, id, mass / {i} AS v FROM w{i}" for i in range(1, steps + 1))
    return ", ".join(parts) + f""", wv AS (SELECT qid, id, sum(v) AS v FROM ({visits}) GROUP BY qid, id),
    wn AS (SELECT qid, id, round(v / max(v) OVER (PARTITION BY qid), 9) AS score FROM wv ANTI JOIN sd USING (qid, id)),
    wk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM wn) WHERE rank <= 33)"""


@query("expected_walk", f"WITH {GRAPH_SQL}, {walk_sql()} SELECT qid, id, rank, round(score, 6) AS score FROM wk")
def expected_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = corpus.graph_tables(spark, sf_dir)
    found = graph_retrieval.expected_walk(corpus.seeds(nodes), edges)
    return found.withColumn("score", F.round("score", 6))



# -- fusion and search ------------------------------------------------------------

SEARCH_SQL = f"""
{TITLES_SQL},
ch AS MATERIALIZED (
  SELECT chunk_id, max(arxiv_id) AS arxiv_id, max(text) AS body, coalesce(max(paper_title), '') AS head,
    coalesce(max(paper_title), '') || ' ' || coalesce(max(section_name), '') || ' ' || coalesce(max(text), '') AS text
  FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
vraw AS (SELECT chunk_id, any_value(embedding) AS e FROM vector_index
  WHERE chunk_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL)) = 64 GROUP BY chunk_id),
vd AS (SELECT chunk_id, list_transform(e, lambda x: x::double) AS v FROM vraw),
vec AS MATERIALIZED (SELECT chunk_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM vd WHERE list_dot_product(v, v) > 0),
paper_of AS MATERIALIZED (SELECT chunk_id AS key, max(arxiv_id) AS arxiv_id FROM (
  SELECT chunk_id, arxiv_id FROM vector_index UNION ALL SELECT chunk_id, arxiv_id FROM ch) GROUP BY chunk_id),
sq AS MATERIALIZED (SELECT qid, titles.title AS query, v FROM seeds JOIN titles USING (id) LEFT JOIN vec ON chunk_id = id || '_abstract' WHERE titles.title IS NOT NULL),
dn AS MATERIALIZED (SELECT * FROM (
  SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT qid, chunk_id, round(list_dot_product(sq.v, vec.v), 9) AS score FROM sq, vec WHERE sq.v IS NOT NULL)) WHERE rank <= 100),
{bm25_sql('ch', 'chunk_id', 'sq', 100)},
text_lists AS MATERIALIZED (
  SELECT qid, 'dense' AS source, 0 AS place, rank, chunk_id AS key, arxiv_id, 0.5 AS w FROM dn JOIN paper_of ON key = chunk_id
  UNION ALL SELECT qid, 'sparse', 1, rank, chunk_id, arxiv_id, 0.3 FROM b_top JOIN paper_of ON key = chunk_id)"""



def _from_dense(sql: str) -> str:
    """The same from the papers of the first dense hits."""
    return sql.replace("seeds", "sd")


RELATED_SQL = f"""sd AS MATERIALIZED (SELECT DISTINCT qid, arxiv_id AS id FROM text_lists WHERE source = 'dense' AND rank <= 5 AND arxiv_id IS NOT NULL),
{communities_sql()}, {pagerank_sql()}, {_from_dense(PEERS_SQL)}, {_from_dense(EXPANSION_SQL)}, {biased_walk_sql()}, {_from_dense(distances_sql(12))}, {PROXIMITY_SQL},
graph_lists AS MATERIALIZED (
  SELECT l.qid, 'graph' AS source, 2 AS place, row_number() OVER (PARTITION BY l.qid ORDER BY list, rank) AS rank, id AS key, id AS arxiv_id, 0.2 AS w
  FROM (SELECT qid, id, rank, 0 AS list FROM ex UNION ALL SELECT qid, id, rank, 1 FROM wk UNION ALL SELECT qid, id, rank, 2 FROM cp) l SEMI JOIN sq ON l.qid = sq.qid)"""


def fused_sql(lists: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (
      SELECT qid, key, score, arxiv_id, source, row_number() OVER (PARTITION BY qid ORDER BY score DESC, place, first_rank, key) AS rank FROM (
        SELECT qid, key, round(sum(w / (60 + rank)), 9) AS score, arg_min(arxiv_id, (place, rank)) AS arxiv_id,
          arg_min(source, (place, rank)) AS source, min(place) AS place, arg_min(rank, (place, rank)) AS first_rank
        FROM ({lists}) GROUP BY qid, key))"""


FUSED_SQL = fused_sql("SELECT * FROM text_lists", "fu")
FUSED_GRAPH_SQL = fused_sql("SELECT * FROM text_lists UNION ALL SELECT * FROM graph_lists", "fg")
SCORED_SQL = """sc AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, old_rank) AS rank FROM (
    SELECT fg.qid, key, fg.arxiv_id, source, fg.rank AS old_rank, coalesce(pagerank, 0) AS pagerank, coalesce(proximity, 0) AS proximity,
      CASE WHEN h.qid IS NULL THEN score ELSE round(0.5 * score + 0.2 * coalesce(pagerank, 0) / (SELECT max(pagerank) FROM pr) + 0.2 * coalesce(proximity, 0), 9) END AS score
    FROM fg LEFT JOIN pr ON pr.id = fg.arxiv_id LEFT JOIN near ON near.qid = fg.qid AND near.id = fg.arxiv_id LEFT JOIN (SELECT DISTINCT qid FROM sd) h ON h.qid = fg.qid))"""
ALL_SQL = f"{GRAPH_SQL}, {SEARCH_SQL}, {RELATED_SQL}, {FUSED_GRAPH_SQL}, {SCORED_SQL}"


@query(
    "search_dense",
    f"WITH {GRAPH_SQL}, {SEARCH_SQL} SELECT qid, rank, key, arxiv_id FROM text_lists WHERE source = 'dense' AND rank <= 20",
)
def search_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, search_index(spark, sf_dir, with_graph=False))
    return engine.search(engine.paper_queries(), "dense").drop("score")


@query(
    "search_sparse",
    f"WITH {GRAPH_SQL}, {SEARCH_SQL} SELECT qid, rank, key, arxiv_id FROM text_lists WHERE source = 'sparse' AND rank <= 20",
)
def search_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, search_index(spark, sf_dir, with_graph=False))
    return engine.search(engine.paper_queries(), "sparse").drop("score")


@query(
    "hybrid_no_graph",
    f"WITH {GRAPH_SQL}, {SEARCH_SQL}, {FUSED_SQL} SELECT qid, rank, key, arxiv_id, round(score, 6) AS score FROM fu WHERE rank <= 20",
)
def hybrid_no_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, search_index(spark, sf_dir, with_graph=False))
    found = engine.search(engine.paper_queries(), "hybrid")
    return found.withColumn("score", F.round("score", 6))


@query(
    "rrf_fusion",
    f"WITH {GRAPH_SQL}, {SEARCH_SQL}, {RELATED_SQL}, {FUSED_GRAPH_SQL} SELECT qid, rank, key, source, round(score, 6) AS score FROM fg",
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, search_index(spark, sf_dir))
    queries = engine.paper_queries()
    found = engine.fused(queries, cut(engine.seeds(queries)))
    return found.select("qid", "rank", "key", "source", F.round("score", 6).alias("score"))


@query("hybrid_search", f"WITH {ALL_SQL} SELECT qid, rank, key, arxiv_id, round(score, 6) AS score FROM sc WHERE rank <= 20")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, search_index(spark, sf_dir))
    found = engine.search(engine.paper_queries(), "hybrid_graph")
    return found.withColumn("score", F.round("score", 6))


@query(
    "search_excluding",
    f"""WITH {GRAPH_SQL}, {SEARCH_SQL.replace("b_size GROUP BY qid, chunk_id", "b_size WHERE chunk_id NOT IN (SELECT key FROM paper_of WHERE paper_of.arxiv_id = qid) GROUP BY qid, chunk_id")},
    kept AS (SELECT qid, source, place, row_number() OVER (PARTITION BY qid, source ORDER BY rank) AS rank, key, arxiv_id, w FROM text_lists WHERE arxiv_id IS DISTINCT FROM qid),
    {fused_sql("SELECT * FROM kept", "fu")} SELECT qid, rank, key, arxiv_id, round(score, 6) AS score FROM fu WHERE rank <= 20""",
)
def search_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid search without graph in which a paper doesn't find itself: left out after the cut of the dense list, before that of the sparse one."""
    engine = Engine(spark, search_index(spark, sf_dir, with_graph=False))
    queries = engine.paper_queries()
    own = queries.select("qid", F.col("qid").alias("arxiv_id"))
    return engine.search(queries, "hybrid", excluded=own).withColumn("score", F.round("score", 6))


@query(
    "recency_boost",
    """SELECT arxiv_id, updated, round(CASE WHEN try_cast(substring(published, 1, 4) AS int) IS NULL THEN 0.5
      ELSE 0.9 * 0.5 + 0.1 * greatest(0.0, 1 - 0.15 * (2026 - try_cast(substring(published, 1, 4) AS int))) END, 6)::double AS score FROM papers""",
)
def recency_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "papers", "arxiv_id", "updated", "published")
    boosted = F.round(fusion.recent(F.lit(0.5), F.col("published"), 2026), 6)
    return rows.select("arxiv_id", "updated", boosted.alias("score"))


def _overlap(query_column: str, text_column: str):
    """A lexical scorer in place of a trained one: share of the query's tokens in the text."""
    asked = F.array_distinct(tx.tokens(F.col(query_column)))
    got = F.size(F.array_intersect(asked, tx.tokens(F.col(text_column))))
    return got / F.greatest(F.size(asked), F.lit(1))


@query(
    "rerank_cascade",
    f"""WITH {GRAPH_SQL}, {SEARCH_SQL}, {FUSED_SQL},
    t AS (SELECT fu.qid, fu.key, fu.rank, list_distinct({tokens_sql('sq.query')}) AS q,
      {tokens_sql("coalesce(ch.head, '') || '. ' || substring(coalesce(ch.body, ''), 1, 512)")} AS d, count(*) OVER (PARTITION BY fu.qid) AS n
      FROM fu JOIN sq USING (qid) LEFT JOIN ch ON ch.chunk_id = fu.key),
    s AS (SELECT qid, key, rank, CASE WHEN n > 20 THEN round(len(list_filter(q, lambda x: list_contains(d, x))) / greatest(len(q), 1)::double, 9) END AS s FROM t WHERE rank <= 100)
    SELECT qid, key, final_rank, round(s, 6) AS rerank_score FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC NULLS LAST, rank) AS final_rank FROM s) WHERE final_rank <= 10""",
)
def rerank_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, search_index(spark, sf_dir, with_graph=False))
    queries = engine.paper_queries()
    texts = engine.chunks.select(
        F.col("chunk_id").alias("key"),
        F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.substring(F.coalesce("text", F.lit("")), 1, 512)).alias("text"),
    )
    found = engine.fused(queries).join(texts, "key", "left").join(queries.select("qid", "query"), "qid")
    best = fusion.cascade(found, _overlap("query", "text"))
    return best.select("qid", "key", "final_rank", F.round("rerank_score", 6).alias("rerank_score"))


# -- from results to answers --------------------------------------------------------

ENTRIES_SQL = """en AS (SELECT fu.qid, fu.rank, fu.key, fu.arxiv_id, coalesce(titles.title, '') AS title, coalesce(ch.body, '') AS body,
  '[' || fu.arxiv_id || '] ' || coalesce(titles.title, '') || chr(10) || coalesce(ch.body, '') AS entry
  FROM fu LEFT JOIN ch ON ch.chunk_id = fu.key LEFT JOIN titles ON titles.id = fu.arxiv_id WHERE fu.rank <= 20)"""


def _entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(qid, rank, key, arxiv_id, title, text, entry) of the hybrid search without graph, and the queries."""
    engine = Engine(spark, search_index(spark, sf_dir, with_graph=False))
    queries = engine.paper_queries()
    found = engine.search(queries, "hybrid")
    texts = engine.chunks.select(F.col("chunk_id").alias("key"), "text")
    titles = corpus.papers(spark, sf_dir).select(F.col("id").alias("arxiv_id"), "title")
    full = found.join(texts, "key", "left").join(titles, "arxiv_id", "left")
    full = full.select(
        "qid",
        "rank",
        "key",
        "arxiv_id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    entry = F.concat(F.lit("["), "arxiv_id", F.lit("] "), "title", F.lit("\n"), "text")
    return full.withColumn("entry", entry), queries


@query(
    "context_budget",
    f"""WITH {GRAPH_SQL}, {SEARCH_SQL}, {FUSED_SQL}, {ENTRIES_SQL},
    u AS (SELECT *, coalesce(sum(length(entry)) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM en)
    SELECT qid, rank, CASE WHEN used + length(entry) <= 8000 THEN entry ELSE substring(entry, 1, (8000 - used)::int) || '...' END AS entry
    FROM u WHERE used + length(entry) <= 8000 OR 8000 - used > 200""",
)
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.context(_entries(spark, sf_dir)[0].select("qid", "rank", "entry"))


@query(
    "papers_list",
    f"""WITH {GRAPH_SQL}, {SEARCH_SQL}, {FUSED_SQL}, {ENTRIES_SQL},
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, arxiv_id ORDER BY rank) AS r FROM en) WHERE r = 1)
    SELECT qid, string_agg('- ' || title || ' (' || arxiv_id || ')', chr(10) ORDER BY rank) AS papers FROM f GROUP BY qid""",
)
def papers_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.paper_list(_entries(spark, sf_dir)[0])


SNIPPET_SQL = """CASE WHEN length(flat) > 300 THEN regexp_replace(substring(flat, 1, 300), '\\s+\\S*$', '') || '...' ELSE flat END"""
FLAT_SQL = """trim(regexp_replace(regexp_replace(regexp_replace(body, '\\.{3,}', ' ', 'g'), '(\\d+(\\.\\d+)?±\\d+(\\.\\d+)?\\s*)+', '[table data] ', 'g'), '\\s+', ' ', 'g'))"""
ANSWERS_SQL = f"""sh AS (SELECT *, {FLAT_SQL} AS flat FROM (SELECT *, row_number() OVER (PARTITION BY qid, arxiv_id ORDER BY rank) AS r FROM en WHERE rank <= 5) WHERE r = 1),
an AS MATERIALIZED (SELECT sq.qid, coalesce(answer, 'No relevant passages were found.') AS answer FROM sq LEFT JOIN (
  SELECT qid, 'Relevant passages:' || chr(10) || chr(10) || string_agg('**' || title || '** (' || arxiv_id || ')' || chr(10) || {SNIPPET_SQL}, chr(10) || chr(10) ORDER BY rank) AS answer
  FROM sh GROUP BY qid) USING (qid))"""


@query("fallback_answer", f"WITH {GRAPH_SQL}, {SEARCH_SQL}, {FUSED_SQL}, {ENTRIES_SQL}, {ANSWERS_SQL} SELECT qid, answer FROM an")
def fallback_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, queries = _entries(spark, sf_dir)
    return answers.extract_answer(entries, queries)


QUALITY_SQL = f"""{ANSWERS_SQL},
tx AS (SELECT qid, list(body ORDER BY rank) AS texts, string_agg(body, chr(10) ORDER BY rank) AS context FROM en GROUP BY qid),
aq AS (SELECT an.qid, query, answer, texts, lower(context) AS context,
  list_distinct(list_filter(regexp_split_to_array(lower(query), '{BLANK_SQL}'), lambda w: length(w) > 3)) AS asked FROM an JOIN tx USING (qid) JOIN sq USING (qid)),
st AS (SELECT qid, context, unnest(list_filter(list_transform(string_split(answer, '.'), lambda x: trim(x)), lambda x: length(x) > 10)) AS sentence FROM aq),
sw AS (SELECT qid, context, list_distinct(list_filter(regexp_split_to_array(lower(sentence), '{BLANK_SQL}'), lambda w: length(w) > 4)) AS w FROM st),
fa AS (SELECT qid, avg((len(w) = 0 OR len(list_filter(w, lambda x: contains(context, x))) / len(w) > 0.3)::int) AS faithfulness FROM sw GROUP BY qid)"""


@query(
    "answer_quality",
    f"""WITH {GRAPH_SQL}, {SEARCH_SQL}, {FUSED_SQL}, {ENTRIES_SQL}, {QUALITY_SQL}
    SELECT aq.qid, round(coalesce(faithfulness, 0), 6)::double AS faithfulness,
      round(CASE WHEN len(asked) = 0 THEN 0.5 ELSE len(list_intersect(asked, regexp_split_to_array(lower(answer), '{BLANK_SQL}'))) / len(asked) END, 6)::double AS relevance,
      round(CASE WHEN len(asked) = 0 THEN 0.5 ELSE len(list_filter(texts, lambda t: len(list_filter(asked, lambda w: contains(lower(t), w))) / len(asked) > 0.2)) / len(texts) END, 6)::double AS context_precision
    FROM aq LEFT JOIN fa ON fa.qid = aq.qid""",
)
def answer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faithfulness, relevance and context precision of the extract answers of all stated queries."""
    entries, queries = _entries(spark, sf_dir)
    entries = cut(entries)
    texts = entries.groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts")
    )
    answered = answers.extract_answer(entries, queries).join(texts, "qid").join(queries.select("qid", "query"), "qid")
    context = F.array_join("texts", "\n")
    return answered.select(
        "qid",
        F.round(evaluation.faithfulness(F.col("answer"), context), 6).alias("faithfulness"),
        F.round(evaluation.answer_relevance(F.col("query"), F.col("answer")), 6).alias("relevance"),
        F.round(evaluation.context_precision(F.col("query"), F.col("texts")), 6).alias("context_precision"),
    )


# -- evaluation -------------------------------------------------------------------

METRICS_SQL = f"""WITH {ALL_SQL}, {FUSED_SQL},
rel AS MATERIALIZED (SELECT DISTINCT src AS qid, dst AS item FROM edges),
res AS MATERIALIZED (
  SELECT source AS method, qid, rank, arxiv_id AS item FROM text_lists WHERE rank <= 20
  UNION ALL SELECT 'hybrid', qid, rank, arxiv_id FROM fu WHERE rank <= 20
  UNION ALL SELECT 'hybrid_graph', qid, rank, arxiv_id FROM sc WHERE rank <= 20),
rel_n AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
hits AS (SELECT res.*, n, (rel.item IS NOT NULL)::int AS hit FROM res JOIN rel_n USING (qid) LEFT JOIN rel ON rel.qid = res.qid AND rel.item = res.item),
nth AS (SELECT *, sum(hit) OVER (PARTITION BY method, qid ORDER BY rank) AS nth FROM hits),
agg AS (SELECT method, qid, max(n) AS n, sum(hit) FILTER (rank <= 1) AS h1, sum(hit) FILTER (rank <= 5) AS h5, sum(hit) FILTER (rank <= 10) AS h10,
  sum(hit) FILTER (rank <= 20) AS h20, min(rank) FILTER (hit = 1) AS first, sum(hit / log2(rank + 1)) FILTER (rank <= 10) AS dcg,
  coalesce(sum(nth / rank) FILTER (hit = 1), 0) AS ps FROM nth GROUP BY method, qid),
m AS (SELECT method, qid, h1 / 1 AS p_at_1, h5 / 5 AS p_at_5, h10 / 10 AS p_at_10, h20 / 20 AS p_at_20, h5 / n AS r_at_5, h10 / n AS r_at_10, h20 / n AS r_at_20,
  coalesce(1 / first, 0) AS mrr,
  CASE WHEN h10 > 0 THEN dcg / list_sum(list_transform(generate_series(1, h10::bigint), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg_10,
  ps / n AS average_precision FROM agg)"""
_METRICS = "p_at_1 p_at_5 p_at_10 p_at_20 r_at_5 r_at_10 r_at_20 mrr ndcg_10 average_precision".split()


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every method over all stated queries; relevant are the papers that a paper cites."""
    engine = Engine(spark, search_index(spark, sf_dir))
    queries = engine.paper_queries()
    results = None
    for method in METHODS:
        found = engine.search(queries, method).select(
            F.lit(method).alias("method"), "qid", "rank", F.col("arxiv_id").alias("item")
        )
        results = found if results is None else results.unionByName(found)
    relevant = engine.edges.select(F.col("src").alias("qid"), F.col("dst").alias("item")).distinct()
    return evaluation.ranking_metrics(results, relevant)


@query(
    "retrieval_metrics",
    f"{METRICS_SQL} SELECT method, qid, {', '.join(f'round({c}, 6)::double AS {c}' for c in _METRICS)} FROM m",
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).withColumns({c: F.round(c, 6) for c in _METRICS})


@query(
    "ablation_report",
    f"{METRICS_SQL} SELECT method, count(*) AS queries, {', '.join(f'round(avg({c}), 6)::double AS {c}' for c in _METRICS)} FROM m GROUP BY method",
)
def ablation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.ablation(_metrics(spark, sf_dir))


# -- conversations: the documents on one paper, in the order of their arrival --------

MESSAGES_SQL = r"""msg AS MATERIALIZED (SELECT *, CASE WHEN role = 'assistant' THEN list_concat([conv_id], list_filter(ids, lambda x: x <> conv_id)) END AS arxiv_ids FROM (
  SELECT arxiv_id AS conv_id, doc_id AS turn, CASE WHEN lower(trim(source)) IN ('forum', 'qa_pairs') THEN 'user' ELSE 'assistant' END AS role,
    text AS content, regexp_extract_all(text, '\d{4}\.\d{4,5}') AS ids FROM documents WHERE arxiv_id IS NOT NULL AND text IS NOT NULL)),
tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM msg) WHERE r <= 10)"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages; those of the assistant list their paper and the papers they name."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "arxiv_id", "source", "text")
    asks = F.coalesce(F.lower(F.trim("source")).isin("forum", "qa_pairs"), F.lit(False))
    ids = F.regexp_extract_all("text", F.lit(r"(\d{4}\.\d{4,5})"))
    return docs.where("arxiv_id is not null and text is not null").select(
        F.col("arxiv_id").alias("conv_id"),
        F.col("doc_id").alias("turn"),
        F.when(asks, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.col("text").alias("content"),
        F.when(~asks, F.concat(F.array("arxiv_id"), F.filter(ids, lambda x: x != F.col("arxiv_id")))).alias("arxiv_ids"),
    )


ENTITIES_SQL = f"""{TITLES_SQL},
ent AS MATERIALIZED (SELECT id AS conv_id, 0 AS ord, regexp_extract(title, '^[^\\s:]+') AS short, title AS "full" FROM titles
  WHERE title IS NOT NULL AND regexp_extract(title, '^[^\\s:]+') <> '')"""


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of a conversation's paper: its title under its first word."""
    short = F.regexp_extract("title", r"^[^\s:]+", 0)
    return corpus.papers(spark, sf_dir).where("title is not null").select(
        F.col("id").alias("conv_id"), F.lit(0).alias("ord"), short.alias("short"), F.col("title").alias("full")
    ).where("short <> ''")


@query("recent_messages", f"WITH {MESSAGES_SQL} SELECT conv_id, turn, role, content FROM tail")
def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.last_messages(_messages(spark, sf_dir)).drop("arxiv_ids")


@query(
    "conversation_text",
    f"WITH {MESSAGES_SQL} SELECT conv_id, string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS text FROM tail GROUP BY conv_id",
)
def conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.conversation_text(_messages(spark, sf_dir))


DISCUSSED_SQL = """named AS (SELECT conv_id, turn, generate_subscripts(arxiv_ids, 1) AS pos, unnest(arxiv_ids) AS arxiv_id FROM msg WHERE arxiv_ids IS NOT NULL),
first_named AS (SELECT conv_id, arxiv_id, min(turn * 100000 + pos) AS first_at FROM named GROUP BY ALL),
discussed AS (SELECT conv_id, arxiv_id, row_number() OVER (PARTITION BY conv_id ORDER BY first_at) AS place FROM first_named)"""


@query("papers_discussed", f"WITH {MESSAGES_SQL}, {DISCUSSED_SQL} SELECT conv_id, place, arxiv_id FROM discussed")
def papers_discussed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.papers_discussed(_messages(spark, sf_dir))


@query(
    "recent_topics",
    f"""WITH {MESSAGES_SQL}, w AS (SELECT conv_id, unnest(CASE WHEN role = 'user' THEN regexp_split_to_array(content, '{BLANK_SQL}') ELSE [] END) AS w FROM tail WHERE r <= 4)
    SELECT c.conv_id, coalesce(t, []) AS topics FROM (SELECT DISTINCT conv_id FROM msg) c LEFT JOIN (
      SELECT conv_id, list_slice(list_sort(list_distinct(list(w))), 1, 5) AS t FROM w WHERE length(w) > 4 AND regexp_matches(w, '^\\p{{Lu}}') GROUP BY conv_id) USING (conv_id)""",
)
def recent_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.recent_topics(_messages(spark, sf_dir))


@query(
    "retrieval_context",
    f"""WITH {MESSAGES_SQL}, {ENTITIES_SQL} SELECT conv_id, content AS query, coalesce(short, '') AS short, coalesce("full", '') AS "full"
    FROM tail LEFT JOIN ent USING (conv_id) WHERE r = 1""",
)
def retrieval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current query with what is known; the map of entities in two columns."""
    found = dialogue.retrieval_context(_messages(spark, sf_dir), _entities(spark, sf_dir))
    return found.select(
        "conv_id",
        "query",
        F.coalesce(F.get(F.map_keys("entities"), F.lit(0)), F.lit("")).alias("short"),
        F.coalesce(F.get(F.map_values("entities"), F.lit(0)), F.lit("")).alias("full"),
    )


def _summary_sql(messages: str) -> str:
    """CTEs that end in summ (conv_id, summary) of the messages named."""
    return f"""
    tp AS (SELECT m.conv_id, string_agg(DISTINCT "full", ', ') AS topics FROM {messages} m JOIN ent USING (conv_id) WHERE contains(lower(content), lower(short)) GROUP BY 1),
    mid AS (SELECT conv_id, unnest(regexp_extract_all(content, '\\d{{4}}\\.\\d{{4,5}}')) AS arxiv_id FROM {messages}),
    pd AS (SELECT conv_id, arxiv_id, row_number() OVER (PARTITION BY conv_id ORDER BY arxiv_id) AS r FROM (SELECT DISTINCT conv_id, arxiv_id FROM mid SEMI JOIN discussed USING (conv_id, arxiv_id))),
    pp AS (SELECT conv_id, string_agg(arxiv_id, ', ' ORDER BY arxiv_id) AS papers FROM pd WHERE r <= 10 GROUP BY 1),
    pt AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Q: ' || substring(content, 1, 150)
      WHEN length(content) > 100 THEN 'A: ' || trim(string_split(content, '.')[1], ' ') END AS point FROM {messages}),
    pr5 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM pt WHERE point IS NOT NULL),
    pts AS (SELECT conv_id, string_agg('  - ' || point, chr(10) ORDER BY turn) AS points FROM pr5 WHERE r <= 5 GROUP BY 1),
    summ AS (SELECT c.conv_id, concat_ws(chr(10), 'Topics discussed: ' || topics, 'Papers referenced: ' || papers, 'Key exchanges:' || chr(10) || points) AS summary
      FROM (SELECT DISTINCT conv_id FROM {messages}) c LEFT JOIN tp USING (conv_id) LEFT JOIN pp USING (conv_id) LEFT JOIN pts USING (conv_id))"""


@query("context_compress", f"WITH {MESSAGES_SQL}, {ENTITIES_SQL}, {DISCUSSED_SQL}, {_summary_sql('msg')} SELECT conv_id, summary FROM summ")
def context_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir)
    return dialogue.compressed(messages, _entities(spark, sf_dir), dialogue.papers_discussed(messages))


@query(
    "context_assembly",
    f"""WITH {MESSAGES_SQL}, {ENTITIES_SQL}, {DISCUSSED_SQL},
    num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM msg),
    old AS (SELECT * FROM num WHERE r > 5), {_summary_sql('old')},
    rec AS (SELECT conv_id, string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS recent FROM num WHERE r <= 5 GROUP BY 1)
    SELECT conv_id, CASE WHEN summ.conv_id IS NULL THEN recent ELSE
      CASE WHEN summary <> '' THEN '[Previous context summary]' || chr(10) || summary || chr(10) || chr(10) ELSE '' END
      || '[Recent messages]' || chr(10) || recent || chr(10) END AS context FROM rec LEFT JOIN summ USING (conv_id)""",
)
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir)
    return dialogue.assembled_context(messages, _entities(spark, sf_dir), dialogue.papers_discussed(messages))


KIND_SQL = """CASE
  WHEN regexp_matches(q, 'compare|versus|vs|difference between|better') THEN 'comparative'
  WHEN regexp_matches(q, 'survey|overview|recent advances|state of the art|review') THEN 'survey'
  WHEN regexp_matches(q, 'papers by|author|wrote|published by') THEN 'author'
  WHEN regexp_matches(q, 'when|timeline|history|evolution|trend') THEN 'temporal'
  WHEN regexp_matches(q, 'citing|cited by|related papers|builds on|extends') THEN 'graph'
  WHEN regexp_matches(q, 'what is|define|explain|how does|describe') THEN 'factual' ELSE 'general' END"""


@query("classify_query", f"SELECT doc_id, {KIND_SQL} AS kind FROM (SELECT doc_id, lower(title) AS q FROM documents WHERE title IS NOT NULL)")
def classify_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "title").where("title is not null")
    return docs.select("doc_id", dialogue.query_kind(F.col("title")).alias("kind"))


def _back_sql(content: str) -> str:
    q = f"lower({content})"
    return f"""(len(list_intersect(regexp_split_to_array({q}, '{BLANK_SQL}'), ['it', 'its', 'this', 'that', 'these', 'those', 'they', 'them', 'their', 'he', 'she', 'his', 'her'])) > 0
      OR ((regexp_matches({q}, '\\b(the\\s+)?(paper|method|approach|model|system|technique|framework|algorithm)\\b')
        OR regexp_matches({q}, '\\b(the\\s+)?(same|previous|above|mentioned|discussed)\\b') OR regexp_matches({q}, '\\b(it|its|this|that|these|those)\\b'))
        AND NOT regexp_matches({q}, 'what is a|define|explain what'))
      OR regexp_matches({q}, '^(give|show|list|provide|tell)\\s+(me\\s+)?(some|more|other|a few)?')
      OR regexp_matches({q}, '\\b(more|examples|details|elaborate|expand|clarify|explain further)\\b')
      OR regexp_matches({q}, '^(how|why|what)\\s+about\\b') OR regexp_matches({q}, '^(and|also|but|however|what about)\\b')
      OR regexp_matches({q}, '^(can you|could you|please)\\s+(give|show|list|explain|elaborate)'))"""


@query("needs_rewrite", f"WITH {MESSAGES_SQL} SELECT conv_id, turn, {_back_sql('content')} AS refers_back FROM msg")
def needs_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select(
        "conv_id", "turn", dialogue.refers_back(F.col("content")).alias("refers_back")
    )


def _replaced_sql() -> str:
    """The query with its first phrase replaced by the entity: by places, as RE2 knows no count."""
    result = "query"
    for phrase in ["the method", "the paper", "this paper", "this approach", "this method", "its", "it"]:
        at = f"strpos(lower(query), '{phrase}')"
        once = f"substring(query, 1, {at} - 1) || entity || substring(query, {at} + {len(phrase)})"
        result = f"CASE WHEN {at} > 0 AND entity IS NOT NULL THEN {once} ELSE {result} END"
    return result


@query(
    "rewrite_query",
    f"""WITH {MESSAGES_SQL}, {ENTITIES_SQL},
    six AS MATERIALIZED (SELECT * FROM tail WHERE r <= 6),
    lp AS (SELECT conv_id, arg_min(arxiv_ids, r) AS papers FROM six WHERE arxiv_ids IS NOT NULL GROUP BY 1),
    le AS (SELECT conv_id, arg_min("full", r) AS spoken FROM six JOIN ent USING (conv_id) WHERE r <= 4 AND role = 'assistant' AND contains(lower(content), lower(short)) GROUP BY 1),
    lu AS (SELECT conv_id, list_filter(regexp_split_to_array(arg_min(content, r), '{BLANK_SQL}'), lambda w: length(w) > 3 AND regexp_matches(w, '^\\p{{Lu}}'))[1] AS capital
      FROM six WHERE r <= 4 AND role = 'user' GROUP BY 1),
    num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rr FROM msg),
    tpc AS (SELECT conv_id, substring(arg_max(content, turn), 1, 150) AS topic FROM num WHERE rr > 1 AND role = 'user' GROUP BY 1),
    cur AS (SELECT t.conv_id, content AS query, coalesce(spoken, capital) AS entity, papers, coalesce(topic, '') AS topic,
      {_back_sql('content')} AND (SELECT count(*) FROM msg m WHERE m.conv_id = t.conv_id) >= 2 AS back
      FROM tail t LEFT JOIN lp USING (conv_id) LEFT JOIN le USING (conv_id) LEFT JOIN lu USING (conv_id) LEFT JOIN tpc USING (conv_id) WHERE r = 1),
    rp AS (SELECT *, {_replaced_sql()} AS q1 FROM cur),
    rl AS (SELECT *, q1 || CASE WHEN contains(lower(q1), 'related') AND papers IS NOT NULL THEN ' (related to papers: ' || array_to_string(list_slice(papers, 1, 3), ', ') || ')' ELSE '' END AS q2 FROM rp)
    SELECT conv_id, query, CASE WHEN NOT back THEN query WHEN q2 = query AND (entity IS NOT NULL OR papers IS NOT NULL) AND topic <> ''
      THEN query || ' (regarding ' || topic || ')' ELSE q2 END AS rewritten FROM rl""",
)
def rewrite_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current query of every conversation, made to stand alone."""
    return dialogue.rewritten_queries(_messages(spark, sf_dir), _entities(spark, sf_dir))


@query(
    "acronym_entities",
    f"""WITH dq AS (SELECT doc_id AS qid, text AS query FROM documents WHERE regexp_matches(text, '\\b[A-Z]{{2,}}\\b')), {bm25_sql('documents', 'doc_id', 'dq', 5)},
    ac AS (SELECT qid, unnest(list_distinct(regexp_extract_all(query, '\\b[A-Z]{{2,}}\\b'))) AS acronym FROM dq),
    pat AS (SELECT qid, acronym, rank, text, '(?i)(' || acronym || ')\\s*[\\(\\[]([^)]+)[\\)\\]]|([^(]+)\\s*[\\(\\[](' || acronym || ')[\\)\\]]' AS p
      FROM ac JOIN b_top USING (qid) JOIN documents d ON d.doc_id = b_top.doc_id WHERE contains(lower(text), lower(acronym))),
    hit AS (SELECT qid, rank, regexp_extract(text, p, 1) AS a, regexp_extract(text, p, 2) AS b, regexp_extract(text, p, 3) AS c, regexp_extract(text, p, 4) AS d FROM pat),
    said AS (SELECT qid, short, arg_max("full", rank) AS "full" FROM (
      SELECT qid, rank, CASE WHEN a <> '' THEN a ELSE d END AS short, CASE WHEN a <> '' THEN b ELSE trim(c) END AS "full" FROM hit) WHERE short <> '' GROUP BY 1, 2),
    wk AS (SELECT * FROM (VALUES ('DPR', 'Dense Passage Retrieval'), ('RAG', 'Retrieval-Augmented Generation'), ('BM25', 'BM25 (Best Match 25)'),
      ('REALM', 'Retrieval-Augmented Language Model'), ('FiD', 'Fusion-in-Decoder'), ('HyDE', 'Hypothetical Document Embeddings'),
      ('ColBERT', 'Contextualized Late Interaction over BERT'), ('RETRO', 'Retrieval Enhanced Transformer')) t(short, "full"))
    SELECT qid, short, "full" FROM said UNION ALL
    SELECT qid, wk.short, wk."full" FROM ac JOIN wk ON ac.acronym = wk.short ANTI JOIN said ON said.qid = ac.qid AND said.short = wk.short""",
)
def acronym_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meanings of the acronyms of every document that has some, from the five documents BM25 finds for its text."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    asked = docs.where("text is not null").select(F.col("doc_id").alias("qid"), F.col("text").alias("query"))
    asked = asked.where(F.size(dialogue.acronyms(F.col("query"))) > 0)
    found = cut(lexical.ranked(asked, *_doc_index(spark, sf_dir), "doc_id", 5).select("qid", "doc_id", "rank"))
    results = cut(found.join(docs, "doc_id"))
    renamed = asked.withColumnRenamed("qid", "conv_id")
    found = dialogue.extracted_entities(renamed, results.select(F.col("qid").alias("conv_id"), "rank", "text"))
    return found.select(F.col("conv_id").alias("qid"), "short", "full")


@query("conversation_turn")
def conversation_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewriting, search, context and answer for the conversations on the stated papers (MD5 begins with 0)."""
    engine = Engine(spark, search_index(spark, sf_dir))
    messages = cut(_messages(spark, sf_dir).where(F.md5("conv_id").startswith("0")))
    vectors = engine.table("paper_vectors").select(F.col("id").alias("conv_id"), "vec")
    return converse.turn(engine, messages, _entities(spark, sf_dir), vectors)[0]


@query(
    "session_states",
    f"""WITH {MESSAGES_SQL}, {ENTITIES_SQL}, {DISCUSSED_SQL}
    SELECT c.conv_id AS conversation_id, c.n AS messages, coalesce(p.n, 0) AS papers, coalesce(short, '') AS short FROM (SELECT conv_id, count(*) AS n FROM tail GROUP BY 1) c
    LEFT JOIN (SELECT conv_id, least(count(*), 50) AS n FROM discussed GROUP BY 1) p USING (conv_id) LEFT JOIN ent USING (conv_id)""",
)
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States saved as JSON and read back: how many messages and papers they hold, and their first entity."""
    messages = _messages(spark, sf_dir)
    tail, discussed = dialogue.last_messages(messages), dialogue.papers_discussed(messages, 50)
    back = sessions.parsed(sessions.saved(tail, discussed, _entities(spark, sf_dir), "2026-01-01"))
    return back.select(
        "conversation_id",
        F.size("messages").cast("bigint").alias("messages"),
        F.coalesce(F.size("papers"), F.lit(0)).cast("bigint").alias("papers"),
        F.coalesce(F.get(F.map_keys("entities"), F.lit(0)), F.lit("")).alias("short"),
    ).withColumn("papers", F.greatest("papers", F.lit(0).cast("bigint")))


# -- session store: a session is what is known of a paper's discussion ----------------

STORE_SQL = """store AS (SELECT arxiv_id AS conversation_id, title AS data, strftime(added_at, '%Y-%m-%d') AS created_at,
  strftime(added_at, '%Y-%m-%d') || ' ' || doc_id AS updated_at FROM documents WHERE arxiv_id IS NOT NULL),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY updated_at DESC, data DESC NULLS LAST) AS r FROM store) WHERE r = 1)"""


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("added_at", "yyyy-MM-dd")
    docs = read_table(spark, sf_dir, "documents", "doc_id", "arxiv_id", "title", "added_at")
    return docs.where("arxiv_id is not null").select(
        F.col("arxiv_id").alias("conversation_id"),
        F.col("title").alias("data"),
        day.alias("created_at"),
        F.concat_ws(" ", day, F.col("doc_id").cast("string")).alias("updated_at"),
    )


_SESSION = "conversation_id, data, created_at, updated_at"


@query("session_latest", f"WITH {STORE_SQL} SELECT {_SESSION} FROM latest")
def session_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.newest(_store(spark, sf_dir))


@query("session_list", f"WITH {STORE_SQL} SELECT {_SESSION} FROM latest ORDER BY updated_at DESC, conversation_id LIMIT 50")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.listed(_store(spark, sf_dir))


@query(
    "session_delete",
    f"WITH {STORE_SQL} SELECT {_SESSION} FROM store ANTI JOIN (SELECT arxiv_id FROM reading_list) d ON d.arxiv_id = conversation_id",
)
def session_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = read_table(spark, sf_dir, "reading_list", "arxiv_id").withColumnRenamed("arxiv_id", "conversation_id")
    return sessions.deleted(_store(spark, sf_dir), gone)


# -- streaming --------------------------------------------------------------------

@query(
    "citation_stream",
    """WITH e AS (SELECT DISTINCT parsed_at, arxiv_id AS src, regexp_replace(trim(c), 'v[0-9]+$', '') AS dst FROM (
      SELECT parsed_at, arxiv_id, unnest(cited_arxiv_ids) AS c FROM citations))
    SELECT time_bucket(INTERVAL 30 DAYS, parsed_at, TIMESTAMP '1970-01-01') AS window_start, dst, count(*) AS citations
    FROM e WHERE parsed_at IS NOT NULL AND src IS NOT NULL AND dst <> '' AND src <> dst GROUP BY ALL""",
)
def citation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations per paper and 30 days from the table read as a stream of files, run to its end."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4()}"
    source = f"{sf_dir}/citations.parquet"
    schema = spark.read.parquet(source).schema
    rows = stream.counted_by_window(stream.citation_stream(spark, f"{source}*", schema))

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    out = rows.writeStream.outputMode("complete").foreachBatch(keep)
    out.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


FLAGSHIP = "bm25_topk"
