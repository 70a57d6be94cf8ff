"""Name, address, state and token normalisation as column expressions."""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from fuelspark.functions import lookups


def _accent_table() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one ASCII character, and that character.

    Combining marks come last and have no counterpart, so ``translate`` drops them.
    """
    accented, plain = [], []
    for code in [*range(0x00A0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base != chr(code):
            accented.append(chr(code))
            plain.append(base)
    marks = [chr(code) for code in range(0x0300, 0x0370)]
    return "".join(accented + marks), "".join(plain)


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(col: Column) -> Column:
    return F.translate(col, _ACCENTED, _PLAIN)


def collapse(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def blank_to_null(col: Column) -> Column:
    return F.when(F.trim(col) != "", col)


def upper_plain(col: Column) -> Column:
    """Trimmed, accent-free, upper-case text; null when blank."""
    return blank_to_null(F.upper(strip_accents(F.trim(col))))


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def expand_words(col: Column, mapping: dict) -> Column:
    """Replace whole words by the mapping in one pass over the text."""
    table = literal_map(mapping)
    runs = F.regexp_extract_all(col, F.lit(r"(\w+|\W+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.coalesce(table[w], w)), "")


def drop_legal_suffixes(col: Column) -> Column:
    pattern = r"(?:\s*\b(?:" + "|".join(lookups.LEGAL_SUFFIXES) + r")\s*)+$"
    return F.trim(F.regexp_replace(col, pattern, ""))


def _punctuation_to_space(col: Column) -> Column:
    col = F.regexp_replace(col, r"""[.,;:!?()\[\]{}/\\"'`#@$%^&*+=<>|~]""", " ")
    return F.regexp_replace(col, r"(?<!\w)-|-(?!\w)", " ")


def sorted_tokens(col: Column) -> Column:
    return F.array_join(F.array_sort(F.split(collapse(col), " ")), " ")


def normalize_name(col: Column) -> Column:
    text = expand_words(drop_legal_suffixes(upper_plain(col)), lookups.NAME_ABBREVIATIONS)
    words = F.split(collapse(_punctuation_to_space(text)), " ")
    kept = F.filter(words, lambda w: ~w.isin(lookups.STOP_WORDS))
    return blank_to_null(F.array_join(F.array_sort(kept), " "))


def comparison_from_normalized(norm_name: Column) -> Column:
    """Normalised name without stand-alone numbers."""
    return blank_to_null(sorted_tokens(F.regexp_replace(norm_name, r"\b\d+\b", "")))


def comparison_name(col: Column) -> Column:
    return comparison_from_normalized(normalize_name(col))


def tokens(comparison: Column) -> Column:
    return F.when(comparison.isNull(), F.array().cast("array<string>")).otherwise(F.split(comparison, " "))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard ratio of two comparison names; 1 when both are empty, null names count as empty."""
    return overlap_of(tokens(a), tokens(b))


def overlap_of(ta: Column, tb: Column) -> Column:
    """``token_overlap`` of the tokens themselves."""
    union = F.size(F.array_union(ta, tb))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(ta, tb)) / union)


# Address patterns, in order of application
SIN_NUMERO = r"\b(?:S\.?/N\.?|S\.?N\.?|SIN\s+NUM(?:ERO)?)\b"
KILOMETRE = r"\bKM\.?\s*[-]?\s*(\d+)(?:\.\d+)?\b"
NUMBER_PREFIX = r"(?:\b(?:NO\.?|NUM\.?|N°)|#)\s*(\d+)\b"
INTERIOR = r"\b(?:INT(?:ERIOR)?|DEPTO?|LOCAL|PISO|APT|APART(?:AMENTO)?)\b\s*\w*"


def normalize_address(col: Column) -> Column:
    text = upper_plain(col)
    text = F.regexp_replace(text, SIN_NUMERO, "SIN NUMERO")
    text = F.regexp_replace(text, KILOMETRE, "KILOMETRO $1")
    text = F.regexp_replace(text, NUMBER_PREFIX, "NUMERO $1")
    text = F.regexp_replace(text, INTERIOR, "")
    words = {**lookups.SETTLEMENT_ABBREVIATIONS, **lookups.STREET_ABBREVIATIONS}
    return blank_to_null(collapse(expand_words(text, words)))


def normalize_state(col: Column) -> Column:
    table = literal_map(lookups.STATE_ALIASES)
    text = upper_plain(col)
    return F.coalesce(table[text], table[F.trim(F.replace(text, F.lit("."), F.lit("")))], text)


def normalize_municipality(col: Column) -> Column:
    return blank_to_null(collapse(F.substring_index(upper_plain(col), ",", 1)))


def normalize_zip(col: Column) -> Column:
    digits = F.regexp_replace(col, r"\D", "")
    return F.when(F.length(digits).between(1, 5), F.lpad(digits, 5, "0"))


def register_zip(col: Column) -> Column:
    """Zip of the regulator register: padded as text, rejected when longer than 5."""
    text = F.trim(col)
    return F.when(F.length(text) <= 5, F.lpad(text, 5, "0"))


def brand_key(col: Column) -> Column:
    return blank_to_null(collapse(upper_plain(col)))
