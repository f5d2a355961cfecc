"""Column expressions over terse item descriptions."""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from partwise.functions import knowledge as K

Lexicon = dict[str, str]


def constant(value, kind: str) -> Column:
    """A constant list or map as one node of the plan, which the optimiser folds."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def strings(values: list[str]) -> Column:
    return constant(values, "array<string>")


def mapping(values: dict, kind: str = "string") -> Column:
    return constant(values, f"map<string,{kind}>")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@cache
def _folding() -> dict[str, str]:
    """Letters and signs without their accents, made from Unicode's decompositions; combining marks fold to nothing."""
    out = {}
    for point in [*range(0xA0, 0x370), *range(0x1E00, 0x1F00), *range(0x2070, 0x2090), *range(0x20D0, 0x20F1), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        sign = chr(point)
        plain = "".join(c for c in unicodedata.normalize("NFKD", sign) if not unicodedata.combining(c))
        if plain != sign:
            out[sign] = plain
    return out


def strip_accents(c: Column) -> Column:
    """Letters without accents, ligatures and full-width forms apart; other scripts stay as they are."""
    folded = F.array_join(F.transform(F.split(c, ""), lambda s: F.coalesce(F.try_element_at(mapping(_folding()), s), s)), "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def basic(c: Column) -> Column:
    """Upper case without accents; separators and white space become one space. Null becomes ''."""
    out = F.upper(let(F.coalesce(c.cast("string"), F.lit("")), strip_accents))
    return squeezed(F.regexp_replace(F.replace(out, F.lit("×"), F.lit("X")), r"[,;|\t\n\r\\]+", " "))


def transliterate(c: Column) -> Column:
    for word, meaning in K.LOCAL_WORDS.items():
        c = F.replace(c, F.lit(word), F.lit(f" {meaning} "))
    return c


# Fixed formats: what a cleaned description keeps and sets apart, in this order.
CLEANING = [
    (r"""[^A-Z0-9.\-#"'+%/\s]""", " "),
    (r"(?<=\d)(C)\s*X\s*(?=\d)", "$1 X "),
    (r"(?<=[0-9])\s*X\s*(?=[0-9])", " X "),
    (r"(?<=[0-9])(MM|CM|KG|MTR|SQMM|MM2|KV|V|NB|IN|INCH)\b", " $1"),
    (r"\.", ". "),
    (r"- ", "-"),
    (r"\s+", " "),
    (r"(\d)\.\s+(\d)", "$1.$2"),
    (r"\s+\.\s*", " "),
]


def clean(c: Column) -> Column:
    """The surface that descriptions are compared on: dimensions spaced, glued units apart, decimals whole."""
    out = basic(transliterate(F.coalesce(c.cast("string"), F.lit(""))))
    for i, (pattern, to) in enumerate(CLEANING):
        out = F.regexp_replace(out, pattern, to)
        if i == 6:
            out = F.trim(out)
    return squeezed(out)


def tokens(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, " "), lambda t: t != "")


def content_tokens(cleaned: Column) -> Column:
    """Tokens of two characters or more that are no noise."""
    noise = strings(K.NOISE)
    return F.filter(tokens(cleaned), lambda t: (F.length(t) > 1) & ~F.array_contains(noise, t))


def lexicon_map(lexicon: Lexicon | None = None) -> Column:
    """Shorthand to meaning; mined entries win over fixed ones."""
    return mapping(K.SHORTHAND | (lexicon or {}))


def expand(cleaned: Column, lexicon: Lexicon | None = None) -> Column:
    words = lexicon_map(lexicon)
    return squeezed(F.array_join(F.transform(tokens(cleaned), lambda t: F.coalesce(F.try_element_at(words, t), t)), " "))


def normalise(c: Column, lexicon: Lexicon | None = None) -> Column:
    return expand(clean(c), lexicon)


def char_ngrams(c: Column, lo: int = 3, hi: int = 5) -> Column:
    """All n-grams of lo to hi characters of the text between two spaces, repeats kept."""
    padded = F.concat(F.lit(" "), c, F.lit(" "))

    def of_size(n: int) -> Column:
        last = F.length(padded) - n + 1
        grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))
        return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[of_size(n) for n in range(lo, hi + 1)]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.coalesce(F.try_divide(both, F.size(F.array_union(a, b))), F.lit(0.0)))


def token_jaccard(a: Column, b: Column) -> Column:
    return jaccard(content_tokens(a), content_tokens(b))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(char_ngrams(a, 3, 3), char_ngrams(b, 3, 3))


def levenshtein(a: Column, b: Column, cap: int = 64) -> Column:
    return F.levenshtein(F.substring(a, 1, cap), F.substring(b, 1, cap))


def completeness(cleaned: Column) -> Column:
    """How much a description tells, 0 to 1: tokens, length, a digit, different tokens."""
    words = content_tokens(cleaned)
    score = (
        F.least(F.size(words) / 8.0, F.lit(1.0)) * 0.40
        + F.least(F.length(cleaned) / 45.0, F.lit(1.0)) * 0.25
        + F.when(F.exists(words, lambda t: t.rlike("[0-9]")), 0.20).otherwise(0.0)
        + F.least(F.size(F.array_distinct(words)) / 6.0, F.lit(1.0)) * 0.15
    )
    return F.when(F.size(words) == 0, 0.0).otherwise(F.round(F.least(score, F.lit(1.0)), 4))


def plain_key(c: Column) -> Column:
    """basic without white space, dots, hyphens and underlines."""
    return F.regexp_replace(basic(c), r"[\s.\-_]+", "")


def letters_digits(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")


def number(c: Column) -> Column:
    """A double as text without needless zeros: 60, 1.75."""
    return F.regexp_replace(c.cast("decimal(18,6)").cast("string"), r"\.?0+$", "")


def fraction(c: Column) -> Column:
    """Double of 2, 1.5, 3/4 or 1 1/2; null for anything else."""
    s = squeezed(c)
    over = F.try_divide(F.regexp_extract(s, r"(\d+(?:\.\d+)?)/", 1).try_cast("double"), F.regexp_extract(s, r"/(\d+(?:\.\d+)?)$", 1).try_cast("double"))
    return (
        F.when(s.rlike(r"^\d+(\.\d+)?$"), s.try_cast("double"))
        .when(s.rlike(r"^\d+(\.\d+)?/\d+(\.\d+)?$"), over)
        .when(s.rlike(r"^\d+ \d+/\d+$"), F.regexp_extract(s, r"^(\d+) ", 1).try_cast("double") + F.try_divide(F.regexp_extract(s, r" (\d+)/", 1).try_cast("double"), F.regexp_extract(s, r"/(\d+)$", 1).try_cast("double")))
    )


def first_phrase(hay: Column, table: list[tuple[str, str]]) -> Column:
    """The meaning of the longest phrase of table in hay as whole words; of equally long ones the first."""
    out = F.lit(None).cast("string")
    for phrase, meaning in reversed(sorted(table, key=lambda r: -len(r[0]))):
        out = F.when(F.contains(hay, F.lit(f" {phrase} ")), F.lit(meaning)).otherwise(out)
    return out
