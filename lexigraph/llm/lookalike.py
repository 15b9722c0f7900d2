"""One consistent form for text that looks the same but is stored differently.

Each token (a run of letters) is resolved to the scripts in which all of its
shapes exist: the intersection of the script sets of its letters. One script
left: a letter from elsewhere is a mixed-script look-alike and is respelled.
Several left: the whole token is confusable, and the script of the text's
unmistakable letters decides. None left: the token really mixes scripts, and
only its look-alike letters follow the script of its unmistakable letters.
Every decision depends on shapes alone, never on the script a look-alike
happens to be stored in, so all spellings of a text reach the same form.

What a reader can see stays: accents, case, raised digits, dashes, the number
of blanks and the line breaks are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigraph.session import cut

# Letters of the same shape in Latin, Greek and Cyrillic (- for none).
SHAPES = """
A Α А   B Β В   C - С   E Ε Е   H Η Н   I Ι І   J - Ј   K Κ К   M Μ М   N Ν -
O Ο О   P Ρ Р   Q - Ԛ   S - Ѕ   T Τ Т   V - Ѵ   W - Ԝ   X Χ Х   Y Υ Ү   Z Ζ -
- Γ Г   - Π П   - Φ Ф
a - а   c ϲ с   d - ԁ   e - е   h - һ   i - і   j ϳ ј   l - ӏ   o ο о   p - р
q - ԛ   s - ѕ   v ν ѵ   w - ԝ   x - х   y - у
"""
# Hyphens that look like the ASCII one.
HYPHENS = "\u2010\u2011\u2043\ufe63\uff0d"
# Line breaks other than the line feed.
BREAKS = "\r\n|[\r\x0b\x0c\x85\u2028\u2029]"

# Look-alikes that hardly any text in their script needs.
RARE = "ѵѴѕЅӏԛԚԝԜԁһҮјЈϲϳ"

# Parts of the texts of one spelling, one per bit of a bigint.
SALTS = 64

LATIN, GREEK, CYRILLIC = 0, 1, 2
_cells = SHAPES.split()
_TRIPLES = [_cells[i : i + 3] for i in range(0, len(_cells), 3)]
#: letter -> its spelling per script, None where the script has no such shape
SPELLINGS = {
    letter: [None if x == "-" else x for x in triple]
    for triple in _TRIPLES
    for letter in triple
    if letter != "-"
}
_LETTERS = "A-Za-z\u00aa-\u024f\u0250-\u02af\u0300-\u03ff\u0400-\u052f\u1e00-\u1fff"
_TOKEN = re.compile(f"[{_LETTERS}]+")
_RARE = re.compile(f"[{RARE}]")
_OTHER_SCRIPT = re.compile("[\u0370-\u03ff\u0400-\u052f\u1f00-\u1fff]")
#: Characters whose text is in its final form already (no look-alikes, no marks to compose).
_SAFE = re.compile(
    "[\n -~\u00a1-\u00ac\u00ae-\u0131\u0134-\u01c3\u01cd-\u01f0\u01f4-\u024f\u2012-\u201f\u3001-\u3003\u3041-\u3096\u30a1-\u30fa\u30fc\u4e00-\u9fff]*"
)
_JOINING = "\u0600-\u08ff\u0900-\u0dff\u0e80-\u109f\u1780-\u17ff\u1800-\u18af\u2600-\u27bf\ufb50-\ufdff\ufe70-\ufeff\U0001f000-\U0001faff"
#: Joiners count as invisible unless they shape the letters (or pictures) on both sides.
_JOINERS = re.compile(f"(?<![{_JOINING}\ufe0f])[\u200c\u200d]+|[\u200c\u200d]+(?![{_JOINING}])")


def _folded(code: int) -> str | None:
    """What a character is replaced by wherever it stands; None to keep it."""
    char = chr(code)
    kind = unicodedata.category(char)
    if char in HYPHENS:
        return "-"
    if kind == "Zs" or char == "\t":
        return " "
    if char in "\n‌‍":
        return None
    if code in range(0x0600, 0x0606) or code in (0x06DD, 0x070F, 0x08E2):
        return None  # visible format characters
    if kind in ("Cf", "Cc") or code == 0x034F or 0xFE00 <= code < 0xFE0F or 0x180B <= code < 0x180E:
        return ""
    tag, _, _ = unicodedata.decomposition(char).partition(" ")
    joined = 0xFB00 <= code < 0xFB50 or 0x0132 <= code < 0x0134 or 0x01C4 <= code < 0x01CD
    joined = joined or 0x01F1 <= code < 0x01F4 or 0x2160 <= code < 0x2180
    if tag in ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"):
        return unicodedata.normalize("NFKD", char)
    if tag == "<compat>" and joined:
        return unicodedata.normalize("NFKD", char)
    return None


_RANGES = (range(0x80), range(0x80, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x10000))
_RANGES += (range(0x1D400, 0x1D800), range(0x1EE00, 0x1EF00), range(0xE0000, 0xE0200))
_FOLDS = {c: x for r in _RANGES for c in r if (x := _folded(c)) is not None}

def _script(letter: str) -> int | None:
    code = ord(letter)
    if 0x0370 <= code < 0x0400 or 0x1F00 <= code < 0x2000:
        return GREEK
    if 0x0400 <= code < 0x0530:
        return CYRILLIC
    return None if 0x0300 <= code < 0x0370 else LATIN


def _resolve(token: str) -> tuple[int, tuple[int, int, int]]:
    """Bits of the scripts all letters share, and the unmistakable letters per script."""
    mask, sure = 7, [0, 0, 0]
    for letter in token:
        if (own := _script(letter)) is None:
            continue
        spellings = SPELLINGS.get(letter)
        bits = sum(1 << s for s in range(3) if spellings[s]) if spellings else 1 << own
        mask &= bits
        if bits in (1, 2, 4):
            sure[bits.bit_length() - 1] += 1
    return mask, tuple(sure)


def _respell(token: str, script: int) -> str:
    return "".join(
        (SPELLINGS[x][script] or x) if x in SPELLINGS else x for x in token
    )


def _one_script(text: str, memo: dict) -> str:
    """Respell the look-alike letters of a decomposed text."""

    def resolved(token: str) -> tuple[int, tuple[int, int, int]]:
        if token not in memo:
            if len(memo) > 200_000:
                memo.clear()
            memo[token] = _resolve(token)
        return memo[token]

    tokens = _TOKEN.findall(text)
    sure = [0, 0, 0]
    for token in tokens:
        for s, n in enumerate(resolved(token)[1]):
            sure[s] += n
    main = max(range(3), key=lambda s: (sure[s], -s))

    def spelled(match: re.Match) -> str:
        token = match.group()
        if main == LATIN and token.isascii():
            return token
        mask, own = resolved(token)
        if mask == 0:
            script = max(range(3), key=lambda s: (own[s], s == main, -s))
        else:
            possible = [s for s in (main, LATIN, GREEK, CYRILLIC) if mask & (1 << s)]
            likely = [s for s in possible if not _RARE.search(_respell(token, s))]
            script = (likely or possible)[0]
        return _respell(token, script)

    return _TOKEN.sub(spelled, text)


def one_form(text: str | None, memo: dict | None = None) -> str | None:
    """The consistent form of a text; None stays None, '' stays ''."""
    if text is None or _SAFE.fullmatch(text):
        return text
    text = re.sub(BREAKS, "\n", text)
    text = text.translate(_FOLDS)
    text = _JOINERS.sub("", text)
    if _OTHER_SCRIPT.search(text):
        text = _one_script(unicodedata.normalize("NFD", text), {} if memo is None else memo)
    return unicodedata.normalize("NFC", text)


@F.pandas_udf(T.StringType())
def _one_form_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    memo: dict = {}
    for texts in batches:
        yield texts.map(lambda t: one_form(t, memo), na_action="ignore")


def consistent_text(text: Column) -> Column:
    """Column form of one_form: null for null, else the text in one form."""
    return _one_form_batches(text)


def normalized_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, text, changed): every document's text in one form.

    A null text gives a null text and changed false; empty texts stay empty.
    """
    return documents.select("doc_id", "text", consistent_text(F.col("text")).alias("_form")).select(
        "doc_id",
        F.col("_form").alias("text"),
        F.coalesce(F.col("_form") != F.col("text"), F.lit(False)).alias("changed"),
    )


def same_reading_pairs(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: texts of one form stored as different characters.

    Null texts are in no pair. Byte-identical texts make no pair with each
    other, but each of them pairs with every other spelling of its text.

    Only digests are shuffled. Unequal spellings of a form are paired first, each
    spelling one row however many texts have it. The texts of a spelling are
    spread over SALTS parts by a hash of their doc_id; a pair of spellings is
    repeated for the parts that have texts, and the texts of two parts meet. So
    only pairs that are returned are ever made, and those of a huge class of
    copies and one variant are made in many tasks.
    """
    keys = cut(
        documents.where("text is not null and doc_id is not null").select(
            "doc_id",
            F.sha2(consistent_text(F.col("text")), 256).alias("form"),
            F.sha2("text", 256).alias("stored"),
            F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("part"),
        )
    )
    spellings = keys.groupBy("form", "stored").agg(F.expr("bit_or(shiftleft(1L, part))").alias("parts"))
    a = spellings.select("form", F.col("stored").alias("stored_a"), F.col("parts").alias("parts_a"))
    b = spellings.select("form", F.col("stored").alias("stored_b"), F.col("parts").alias("parts_b"))

    def taken(parts: str) -> Column:
        every = F.sequence(F.lit(0), F.lit(SALTS - 1))
        return F.explode(F.filter(every, lambda i: F.call_function("getbit", F.col(parts), i) == 1))

    cells = cut(
        a.join(b, "form")
        .where("stored_a < stored_b")
        .select("stored_a", "stored_b", "parts_b", taken("parts_a").alias("part_a"))
        .select("stored_a", "part_a", "stored_b", taken("parts_b").alias("part_b"))
    )

    def texts(side: str) -> DataFrame:
        names = [F.col(x).alias(f"{x}_{side}") for x in ("stored", "part", "doc_id")]
        return cells.join(keys.select(*names), [f"stored_{side}", f"part_{side}"])

    return (
        texts("a")
        .join(texts("b"), ["stored_a", "part_a", "stored_b", "part_b"])
        .where("doc_id_a <> doc_id_b")
        .select(
            F.least("doc_id_a", "doc_id_b").alias("doc_id_a"),
            F.greatest("doc_id_a", "doc_id_b").alias("doc_id_b"),
        )
    )
