"""Statistics of texts, and how far each text is from the running prose of its language.

Every text is described by a dozen statistics. Per language their typical values
in prose are learned robustly from all rows: medians and median absolute
deviations pick a core, and mean and covariance of the core are refined in
concentration steps (the rows closest by Mahalanobis distance give the next
estimate). Those of a language are drawn towards those of all rows as if there
were SHRINK rows more of them, so a rare language borrows its model and a common
one has its own, without a switch between the two. A text in a language without
a list of common words counts as English and is found to be far from it. The
squared distance of a text is a sum of one contribution per statistic, so a
report tells why a text is an outlier. Sums per language and statistic pair are
all that is gathered; no row leaves its partition.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.session import cut

# Frequent words of running text by language.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his at this are or which from",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an",
    "fr": "de la le et les des en un du une que est pour qui dans par plus au sur ne se pas sont",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más",
    "ru": "и в не на что с по как для из от за к но при или это его так все мы был",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として",
}
LANGUAGES = list(COMMON)
_COMMON = {lang: frozenset(w.split()) for lang, w in COMMON.items()}
_ANY = frozenset().union(*_COMMON.values())
_KANA = re.compile("[぀-ヿ]")
_JA_WORD = re.compile("[一-鿿々]+|[ァ-ヺー]+|[ぁ-ゖ]|[^\\W぀-ヿ一-鿿]+")
_EDGE = ".,;:!?()[]{}\"'«»„“”‘’…。、「」"
_ITEM = re.compile(r"\s*(?:[-*•▪◦‣·–—+>|]\s|o\s|\(?[0-9ivxlc]{1,4}[.)]\s|\(?[a-zA-Z][.)]\s|\[\d+\])")
_END = re.compile(r"[.!?。！？]+[\"'”’»)\]]*(?=\s|$)|[。！？]")
_SYMBOL = re.compile(r"[^\w\s.,;:!?()'\"\-’‘“”«»„–…、。「」％%&¿¡]|_")
_DIGIT = re.compile(r"\d")
_STRANGE = re.compile("[\ufffdÃÂ¤¬þ]|[\x80-\x9f]")

#: Words further than this from a common word are not in running text.
REACH = 7
STATISTICS = [
    "word_length",
    "symbol_share",
    "digit_share",
    "line_end_share",
    "common_share",
    "far_share",
    "item_share",
    "single_share",
    "words_per_line",
    "words_per_end",
    "letter_share",
    "repeat_share",
    "squeeze",
]
#: Smallest standard deviation of each statistic that is believed.
FLOORS = [0.05, 0.03, 0.03, 0.15, 0.05, 0.04, 0.08, 0.04, 0.25, 0.25, 0.03, 0.06, 0.06]

#: Deviations within which every statistic of a row of the first core lies, and the rows that a language's model borrows.
CORE, SHRINK = 6.0, 100.0


def statistics(text: str) -> tuple[str, int, list[float]]:
    """Language, number of words and the statistics of a text (all finite, also for '')."""
    lines = [x for x in text.split("\n") if x.strip()]
    japanese = len(_KANA.findall(text)) * 5 > len(text)
    raw = _JA_WORD.findall(text) if japanese else text.split()
    words = [w for w in (x.strip(_EDGE) for x in raw) if w]
    n, chars = len(words), max(1, len(text) - text.count(" ") - text.count("\n"))
    lower = [w.lower() for w in words]
    if japanese:
        lang = "ja"
    else:
        hits = {x: sum(map(s.__contains__, lower)) for x, s in _COMMON.items() if x != "ja"}
        lang = max(hits, key=hits.get)
        if not hits[lang]:
            lang = "en"
    common = _COMMON[lang]
    places = [i for i, w in enumerate(lower) if w in common]
    far, before = 0, -1
    for i in [*places, n]:
        far += max(0, i - before - 1 - REACH)
        before = i
    ends = len(_END.findall(text))
    symbols = len(_SYMBOL.findall(text)) + 3 * len(_STRANGE.findall(text))
    shapes = [_DIGIT.sub("0", x.strip()) for x in lines]
    head = text.encode()
    values = [
        np.log1p(sum(map(len, words)) / max(1, n)),
        min(1.0, symbols / chars) ** 0.5,
        (len(_DIGIT.findall(text)) / chars) ** 0.5,
        sum(x.rstrip()[-1] in ".!?。:;\"'”»" for x in lines) / max(1, len(lines)),
        len(places) / max(1, n),
        far / max(1, n),
        sum(len(x) for x in lines if _ITEM.match(x)) / max(1, sum(map(len, lines))),
        0.0 if japanese else sum(len(w) == 1 for w in words) / max(1, n),
        np.log1p(min(n / max(1, len(lines)), 15.0)),
        np.log1p(min(n / (ends + 0.5), 80.0)),
        sum(map(str.isalpha, words)) / max(1, n),
        1 - len(set(shapes)) / max(1, len(shapes)),
        # short texts squeeze badly, so what counts is how much better than usual they squeeze
        len(zlib.compress(head, 1)) / (len(head) + 1) * np.log1p(len(head)) / 4.0,
    ]
    return lang, n, [float(v) for v in values]


SCHEMA = "unit string, unit_id string, ord int, lang string, words int, " + ", ".join(
    f"{s} double" for s in STATISTICS
)


def text_units(chunks: DataFrame, extracted: DataFrame) -> DataFrame:
    """(unit, unit_id, ord, text) of all chunks and sections with an id and a text."""
    sections = extracted.select(F.col("arxiv_id"), F.posexplode("sections.text").alias("ord", "text"))
    return (
        chunks.select(F.lit("chunk").alias("unit"), F.col("chunk_id").alias("unit_id"), F.lit(0).alias("ord"), "text")
        .unionByName(
            sections.select(F.lit("section").alias("unit"), F.col("arxiv_id").alias("unit_id"), "ord", "text")
        )
        .where("unit_id is not null and text is not null")
    )


def measured(units: DataFrame) -> DataFrame:
    """The statistics of every text; repeated rows stay, as they weigh in the corpus."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [statistics(t) for t in batch["text"]]
            out = batch[["unit", "unit_id", "ord"]].copy()
            out["lang"], out["words"] = [r[0] for r in rows], [r[1] for r in rows]
            table = np.array([r[2] for r in rows]).reshape(-1, len(STATISTICS))
            for i, s in enumerate(STATISTICS):
                out[s] = table[:, i]
            yield out

    return cut(units.mapInPandas(measure, SCHEMA))


def _moments(rows: DataFrame) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Count, mean and covariance per language and, as '', of all rows, by sums."""
    m = len(STATISTICS)
    sums = [F.sum(s) for s in STATISTICS]
    products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(STATISTICS) for b in STATISTICS[: i + 1]]
    found = rows.groupBy("lang").agg(F.count(F.lit(1)), *sums, *products).collect()
    states = {}
    for r in found:  # one row per language
        v = np.array(r[1:], float)
        square = np.zeros((m, m))
        square[np.tril_indices(m)] = v[1 + m :]
        square = square + np.tril(square, -1).T
        states[r[0]] = (v[0], v[1 : 1 + m], square)
    if states:
        states[""] = tuple(sum(s[i] for s in states.values()) for i in range(3))
    result = {}
    for lang, (n, total, square) in states.items():
        mean = total / n
        result[lang] = (n, mean, square / n - np.outer(mean, mean))
    return result


def _models(
    moments: dict[str, tuple[float, np.ndarray, np.ndarray]], shrink: float
) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Centre and inverse covariance per language, drawn towards those of all rows."""
    if "" not in moments:
        return {}
    _, every, spread = moments[""]
    models = {}
    for lang in [*LANGUAGES, ""]:
        n, mean, cov = moments.get(lang) or (0, every, spread)
        own = n / (n + shrink)
        mean = own * mean + (1 - own) * every
        cov = own * cov + (1 - own) * spread
        models[lang] = (mean, np.linalg.inv(cov + np.diag(np.square(FLOORS))))
    return models


def distances(rows: DataFrame, models: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """rows with distance (squared Mahalanobis) and contributions, which add up to it."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch[STATISTICS].to_numpy(float)
            parts = np.zeros_like(values)
            for lang, (mean, inverse) in models.items():
                own = (batch["lang"] == lang).to_numpy()
                away = values[own] - mean
                parts[own] = away * (away @ inverse)
            batch["distance"] = parts.sum(axis=1)
            batch["contributions"] = list(parts)
            yield batch

    return rows.mapInPandas(score, f"{SCHEMA}, distance double, contributions array<double>")


def prose_models(
    rows: DataFrame, steps: int = 2, keep: float = 30.0, shrink: float = SHRINK
) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Robust centre and inverse covariance of each language's prose."""
    long = rows.where("words >= 20")
    centres = long.groupBy("lang").agg(
        *[F.percentile_approx(s, 0.5, 2000).alias(f"m_{s}") for s in STATISTICS]
    )
    # one row per language
    away = long.join(F.broadcast(centres), "lang")
    spread = away.groupBy("lang").agg(
        *[F.percentile_approx(F.abs(F.col(s) - F.col(f"m_{s}")), 0.5, 2000).alias(f"d_{s}") for s in STATISTICS]
    )
    away = away.join(F.broadcast(spread), "lang")
    scaled = F.lit(0)
    for s, floor in zip(STATISTICS, FLOORS, strict=True):
        # a median absolute deviation as a standard deviation
        scale = F.greatest(1.4826 * F.col(f"d_{s}"), F.lit(floor))
        scaled = F.greatest(scaled, F.abs(F.col(s) - F.col(f"m_{s}")) / scale)
    core = away.where(scaled <= CORE).select(*rows.columns)
    models = _models(_moments(core), shrink)
    for _ in range(steps):
        if not models:
            break
        near = distances(long, models).where(F.col("distance") <= keep)
        models = _models(_moments(near.select(*rows.columns)), shrink)
    return models


def scored(units: DataFrame, **options) -> DataFrame:
    """Each text's statistics with distance, contributions and its most unusual statistic.

    Empty and blank texts have no words and are far from prose like any junk.
    """
    rows = measured(units)
    names = F.array(*[F.lit(s) for s in STATISTICS])
    result = distances(rows, prose_models(rows, **options))
    top = F.array_position("contributions", F.array_max("contributions")).cast("int")
    return result.withColumn("most_unusual", F.element_at(names, top))


def not_prose(units: DataFrame, limit: float = 100.0, **options) -> DataFrame:
    """(unit, unit_id, ord): units of which a stored text is no running prose; one row a unit."""
    far = scored(units, **options).where(F.col("distance") > limit)
    return far.select("unit", "unit_id", "ord").distinct()
