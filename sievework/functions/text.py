"""Text normal forms and tests as column expressions.

Every form is a different key; they are not interchangeable. Only forms that need Unicode normalization
or full case folding run in Arrow batches; the rest stays in generated code.
"""

from __future__ import annotations

import html
import re
from itertools import pairwise
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What Python calls white space.
SPACE = r"[\s\x1C-\x1F\x85\xA0  -     　]+"
#: Word characters are letters, numbers and the underscore, without combining marks.
NOT_WORD_OR_SPACE = r"[^\p{L}\p{N}_\s\x1C-\x1F\x85\xA0  -     　]"
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"
#: The five marked letters, and the alphabet of tokens.
MARKED, PLAIN = "čćđšžČĆĐŠŽ", "ccdszccdsz"
ALPHABET = "[a-zA-ZčćžšđČĆŽŠĐ]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def nfc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


@F.pandas_udf(T.StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


@F.pandas_udf(T.StringType())
def fold_marks(s: pd.Series) -> pd.Series:
    """đ becomes d, other letters lose their combining marks."""

    def one(x):
        if x is None:
            return None
        flat = unicodedata.normalize("NFD", x.replace("đ", "d").replace("Đ", "D"))
        return "".join(c for c in flat if unicodedata.category(c) != "Mn")

    return s.map(one)


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def squeeze(c) -> Column:
    return F.trim(F.regexp_replace(col(c), SPACE, " "))


def normalized(c) -> Column:
    """NFC, white space as one space, trimmed."""
    return squeeze(nfc(col(c)))


def leak_key(c) -> Column:
    """NFC, without [n] citations, squeezed, case-folded."""
    return nfc_casefold(squeeze(F.regexp_replace(nfc(col(c)), r"\[\p{Nd}+\]", "")))


def near_key(c) -> Column:
    """NFKC and case folding; what is no word character is a space."""
    return squeeze(F.regexp_replace(nfkc_casefold(col(c)), NOT_WORD_OR_SPACE, " "))


def speech_key(c) -> Column:
    return squeeze(F.regexp_replace(F.lower(nfc(col(c))), NOT_WORD_OR_SPACE, " "))


def yat_fold(c) -> Column:
    return F.regexp_replace(speech_key(c), "ije|je", "e")


def transcript_key(c) -> Column:
    return nfc(F.lower(col(c)))


def five_letter_fold(c) -> Column:
    return F.translate(col(c), MARKED, PLAIN)


def strip_citations(c) -> Column:
    return squeeze(F.regexp_replace(col(c), r"\[[0-9]+\]", ""))


def strip_bracket_refs(c) -> Column:
    return F.regexp_replace(col(c), r"\[[^\]]{0,40}\]", " ")


def flatten(c) -> Column:
    return squeeze(F.coalesce(col(c), F.lit("")))


def words(c) -> Column:
    """Runs that white space separates."""
    return F.filter(F.split(col(c), SPACE), lambda x: x != "")


def word_count(c) -> Column:
    return F.size(words(c))


def score_tokens(c) -> Column:
    """Lower-cased letters and numbers; every other character separates."""
    return F.filter(F.split(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")


def word_tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(f"({LETTERS})"), F.lit(1))


def alphabet_tokens(c) -> Column:
    return F.transform(F.regexp_extract_all(col(c), F.lit(f"({ALPHABET})"), F.lit(1)), lambda x: F.lower(x))


def stems(c) -> Column:
    """First six letters of words of two letters or more."""
    return F.transform(F.filter(word_tokens(c), lambda x: F.length(x) > 1), lambda x: F.substring(x, 1, 6))


def letters_only_key(c) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(col(c)), F.lit(r"(\p{L}+)"), F.lit(1)), " ")


def numeric_values(c) -> Column:
    """Numbers as values: a separator before exactly three digits groups thousands, another comma is a point."""
    found = F.regexp_extract_all(col(c), F.lit(r"(\d[\d.,]*\d|\d)"), F.lit(1))
    plain = F.transform(found, lambda x: F.regexp_replace(F.translate(F.regexp_replace(x, r"[.,](?=\d{3}(?!\d))", ""), ",", "."), r"\.+$", ""))
    return F.filter(F.transform(plain, lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def forward_input(c) -> Column:
    """Runs of one mark become one mark, and a mark is followed by a space."""
    once = F.regexp_replace(col(c), r"([.!?])\1+", "$1")
    return squeeze(F.regexp_replace(once, r"(?<=[.!?])(?=[^\s.!?])", " "))


#: The two alphabets, digraphs apart.
CYRILLIC, LATIN = "абвгдђежзијклмнопрстћуфхцчшАБВГДЂЕЖЗИЈКЛМНОПРСТЋУФХЦЧШ", "abvgdđežzijklmnoprstćufhcčšABVGDĐEŽZIJKLMNOPRSTĆUFHCČŠ"
DIGRAPHS = [("љ", "lj"), ("њ", "nj"), ("џ", "dž"), ("Љ", "LJ"), ("Њ", "NJ"), ("Џ", "DŽ")]
TITLED = [("Lj", "Љ"), ("Nj", "Њ"), ("Dž", "Џ")]


def to_latin(c) -> Column:
    return F.translate(reduce(lambda x, d: F.replace(x, F.lit(d[0]), F.lit(d[1])), DIGRAPHS, col(c)), CYRILLIC, LATIN)


def to_cyrillic(c) -> Column:
    pairs = [(latin, cyrillic) for cyrillic, latin in DIGRAPHS] + TITLED
    return F.translate(reduce(lambda x, d: F.replace(x, F.lit(d[0]), F.lit(d[1])), pairs, col(c)), LATIN, CYRILLIC)


def strip_tags(c) -> Column:
    """Without leading language tags such as >>bos_Latn<<."""
    return F.trim(F.regexp_replace(col(c), r"^\s*(>>[a-zA-Z_]+<<\s*)+", ""))


def has_tag(c) -> Column:
    return col(c).rlike(r"^\s*(>>[a-zA-Z_]+<<\s*)+")


def plain_html(c) -> Column:
    """Tags become spaces, entities their characters, white space one space."""
    return squeeze(unescape(F.regexp_replace(F.coalesce(col(c), F.lit("")), "<[^>]+>", " ")))


def licence_class(*fields) -> Column:
    """One of four open licences by the first field that names one; null means deny."""

    def one(c):
        t = F.lower(squeeze(F.coalesce(col(c), F.lit(""))))
        return F.when(t.rlike(r"^cc0\b|^cc[- ]zero\b"), "CC0").when(t.rlike(r"^cc[- ]by[- ]sa[- ]?\d"), "CC BY-SA").when(t.rlike(r"^cc[- ]by[- ]?\d"), "CC BY").when(t.rlike(r"^pd(\b|-)|^public domain\b"), "PD")

    return F.coalesce(*(one(c) for c in fields))


def safe_name(c) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_")


def letter_count(c) -> Column:
    return F.length(F.regexp_replace(col(c), r"[^\p{L}]+", ""))


def upper_count(c) -> Column:
    return F.length(F.regexp_replace(col(c), r"[^\p{Lu}]+", ""))


def shouted(c, least: int = 8, ratio: float = 0.8) -> Column:
    return (letter_count(c) >= least) & (upper_count(c) / F.greatest(letter_count(c), F.lit(1)) >= ratio)


def has_cyrillic(c) -> Column:
    return col(c).rlike(r"\p{IsCyrillic}")


def mostly_cyrillic(c, first: int = 200_000) -> Column:
    head = F.substring(col(c), 1, first)
    return 2 * F.length(F.regexp_replace(head, r"[^\p{IsCyrillic}]", "")) > letter_count(head)


def mostly_symbols(c, ratio: float = 0.3) -> Column:
    return letter_count(c) < ratio * F.length(col(c))


def holds_word(c, word: str) -> Column:
    """Whether word stands between characters that are no word characters, whatever its case."""
    return F.lower(col(c)).rlike(rf"(?<![\p{{L}}\p{{N}}_])\Q{word.lower()}\E(?![\p{{L}}\p{{N}}_])")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, null if none does; unknown does not hold."""
    out = None
    for name, holds in rules:
        out = F.when(holds, F.lit(name)) if out is None else out.when(holds, F.lit(name))
    return out


# --- sequential forms, in Arrow batches -------------------------------------------------------------

#: Abbreviations that do not end a sentence.
ABBREVIATIONS = frozenset(
    "dr mr mrs ms prof g gđa gdja tzv npr itd tj br sv st no vs etc jr sr inc ltd co corp sen gen col lt maj capt rev ave blvd vol pp fig al approx dept univ assoc ed eds god str op cit ing br o.š mn hrsg vidi usp".split()
)
#: Marks that may stand behind, before and around a sentence's words.
CLOSERS, OPENERS, AROUND = "\"'»”’)]}", "\"'«„“‘([{-–—", "()[]{}\"'«»„“”‘’.,;:!?-–—"
_MARK = re.compile(rf"[.!?]+[{re.escape(CLOSERS)}]*(?=\s)")
#: What keeps a sentence open before a mark: a number, a letter, initials, a Roman numeral, an abbreviation.
_OPEN_TOKEN = re.compile(rf"\d+|[^\W\d_]|(?:[^\W\d_]\.)+[^\W\d_]|[IVXLCDM]+|(?i:{'|'.join(map(re.escape, sorted(ABBREVIATIONS)))})")
_LEAD = re.compile(rf"\s*[{re.escape(OPENERS)}]*")


def sentence_ends(line: str) -> list[int]:
    """Places after the marks that end a sentence. Each mark is judged alone, by the token before and the letter after."""
    ends = []
    for mark in _MARK.finditer(line):
        token = line[: mark.start()].rstrip().rpartition(" ")[2].split()
        after = line[_LEAD.match(line, mark.end()).end() :][:1]
        if not after.islower() and not (token and _OPEN_TOKEN.fullmatch(token[-1].strip(AROUND))):
            ends.append(mark.end())
    return ends


def sentences(text: str) -> list[str]:
    cut = [(line, pairwise([0, *sentence_ends(line), len(line)])) for line in map(str.strip, text.split("\n"))]
    return [s for line, spans in cut for s in (line[i:j].strip() for i, j in spans) if s]


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_sentences(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else sentences(x))


#: Between a mark and white space, unless a digit's full stop is followed by a small letter; or a line's end.
SERVED_BREAK = r"(?<=[.!?])(?:(?<!\p{Nd}\.)\s+|\s+(?![a-zčćđšž]))|\s*\n+\s*"


def served_sentences(c) -> Column:
    parts = F.filter(F.split(F.trim(col(c)), SERVED_BREAK), lambda x: F.trim(x) != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(col(c)))


def naive_sentences(c) -> Column:
    return F.split(col(c), r"(?<=[.!?])\s+")


def case_like(model: str, word: str) -> str:
    if model.isupper():
        return word.upper()
    return word.capitalize() if model[:1].isupper() else word


def rewriter(lexicon: dict[str, str]):
    """An Arrow function that replaces whole words by lexicon (of a bounded size), keeping their case."""

    @F.pandas_udf(T.StringType())
    def rewrite(s: pd.Series) -> pd.Series:
        word = re.compile(r"[^\W\d_]+")
        swap = lambda m: case_like(m[0], lexicon[m[0].lower()]) if m[0].lower() in lexicon else m[0]
        return s.map(lambda x: None if x is None else word.sub(swap, x))

    return rewrite


_TOKEN = re.compile(r"[^\W\d_]+|\d+")
#: What between two tokens begins a sentence: a line's end, or marks of which the last ends one.
_BEGINS = re.compile(r"\n|[.!?](?![^\w\s])")
_ORDINAL = re.compile(r"\.(?![^\w\s])")


def recased(text: str, proper: frozenset[str] = frozenset()) -> str:
    """Shouted text in sentence case; a full stop after a number is an ordinal's. Underscores go."""
    letters = pd.Series(list(text), dtype=object)
    letters = letters[letters.map(str.isalpha)] if len(letters) else letters
    if len(letters) < 8 or letters.map(str.isupper).mean() < 0.8:
        return text
    text = text.replace("_", "")
    spans = [m.span() for m in _TOKEN.finditer(text)]

    def shape(before: tuple[int, int] | None, at: tuple[int, int]) -> str:
        gap = text[before[1] if before else 0 : at[0]]
        number = before is not None and text[before[0]].isdigit()
        low = text[slice(*at)].lower()
        first = before is None or _BEGINS.search(gap, 1 if number and _ORDINAL.match(gap) else 0)
        return gap + (low[:1].upper() + low[1:] if first or low in proper else low)

    shaped = [shape(before, at) for before, at in zip([None, *spans], spans)]
    return "".join(shaped) + text[spans[-1][1] :]


@F.pandas_udf(T.StringType())
def sentence_case(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else recased(x))


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


@F.pandas_udf(T.IntegerType())
def word_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(list(x), list(y)) for x, y in zip(a, b)])
