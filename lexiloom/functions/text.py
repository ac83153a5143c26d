"""Column functions on sentences: normalizers, predicates, and the character classes they share.

Java's, Python's and RE2's shorthand classes differ outside ASCII, so the classes are
spelled out here and mean the same everywhere.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as Unicode-aware string functions know it.
SPACES = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Without the information separators, as a tokenizer's strip knows it.
TRIMMED = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"\p{L}\p{N}_"

# What URLs and e-mail addresses look like, and which characters scripts have.
URL = rf"(https?|sftp?)://[{WORD}/:%#$&?()~.=+\-]+"
EMAIL = rf"[{WORD}\-]+@[{WORD}\-]+\.[{WORD}.\-]+"
SCRIPT = r"[{|}]"
# What a citation mark looks like. Alternatives are tried in this order.
CITATION = r"\[\p{Nd}+?\]|\[要.+?\]|\{\{+[^{}]+?\}\}+|\[(要出典|リンク切れ|.+?\?)\]"

FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F))


# -- normalizers -------------------------------------------------------------


def whitespace_normalizer(s: Column) -> Column:
    """Delete unprintable characters - every space but U+0020 is one - then squeeze runs of spaces. Ends aren't trimmed."""
    printable = F.regexp_replace(s, r"[\p{C}\p{Z}&&[^ ]]", "")
    return F.regexp_replace(printable, " +", " ")


def citation_normalizer(s: Column) -> Column:
    """Delete numbered references, bracketed editor's notes and templates."""
    return F.regexp_replace(s, "(?d)" + CITATION, "")


SENTENCE_NORMALIZERS: dict[str, Callable[[Column], Column]] = {"citation": citation_normalizer, "whitespace": whitespace_normalizer}


def sentence_normalizer(names: Sequence[str]) -> Callable[[Column], Column]:
    """The named normalizers in the order given; they don't commute."""
    steps = [_named(SENTENCE_NORMALIZERS, n, "sentence normalizer") for n in names]
    return lambda s: reduce(lambda c, f: f(c), steps, s)


def _named(known: dict, name: str, what: str):
    if name not in known:
        raise ValueError(f"unknown {what} {name!r}; known: {', '.join(sorted(known))}")
    return known[name]


def strip(s: Column, chars: str = SPACES) -> Column:
    return F.regexp_replace(s, rf"\A[{chars}]+|[{chars}]+\z", "")


def strip_right(s: Column, chars: str = SPACES) -> Column:
    return F.regexp_replace(s, rf"[{chars}]+\z", "")


@F.pandas_udf(T.StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition, the one normalization that Spark has no function for."""
    for s in texts:
        yield s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def input_normalizer(do_strip: bool = False, do_lower_case: bool = False, do_nfkc: bool = False) -> Callable[[Column], Column]:
    """Strip, then lower-case, then NFKC: capitals that NFKC makes stay."""

    def apply(s: Column) -> Column:
        s = strip(s, TRIMMED) if do_strip else s
        s = F.lower(s) if do_lower_case else s
        return nfkc(s) if do_nfkc else s

    return apply


def half_ascii(s: Column) -> Column:
    """Full-width ASCII to ASCII; the ideographic space stays."""
    return F.translate(s, FULL_WIDTH, HALF_WIDTH)


def full_width(s: Column) -> Column:
    """ASCII to full-width ASCII, and the space to the ideographic space."""
    return F.translate(s, " " + HALF_WIDTH, "　" + FULL_WIDTH)


def drop_surrogates(s: Column) -> Column:
    """Without halves of surrogate pairs that stand alone, which no UTF-8 has; decoders leave a replacement or the code point itself."""
    return F.regexp_replace(s, r"[\x{D800}-\x{DFFF}]", "")


def drop_spaces(s: Column) -> Column:
    return F.regexp_replace(s, f"[{SPACES}]", "")


def truncate_utf8(s: Column, limit: int) -> Column:
    """The longest prefix of whole characters within `limit` bytes of UTF-8."""
    b = s.cast("binary")
    cut = [F.substring(b, 1, limit - back) for back in range(4)]
    # A cut is clean if the byte after it begins a character.
    lead = lambda back: F.conv(F.hex(F.substring(b, limit - back + 1, 1)), 16, 10).cast("int")
    clean = [(lead(back) < 128) | (lead(back) >= 192) for back in range(4)]
    picked = F.coalesce(*[F.when(c, part) for c, part in zip(clean, cut)])
    return F.when(F.octet_length(s) <= limit, s).otherwise(F.decode(picked, "UTF-8"))


# -- sentence predicates: true means drop -------------------------------------


def has_url(s: Column) -> Column:
    return s.rlike(URL)


def has_email(s: Column) -> Column:
    return s.rlike(EMAIL)


def bad_length(s: Column, least: int = 10, most: int = 200) -> Column:
    """Fewer characters than least or more than most; both bounds are kept."""
    return ~F.char_length(s).between(least, most)


def has_script(s: Column) -> Column:
    """A brace or a vertical bar: the class holds all three."""
    return s.rlike(SCRIPT)


SENTENCE_FILTERS: dict[str, Callable[..., Column]] = {"email": has_email, "url": has_url, "sequence_length": bad_length}


def sentence_filter(names: Sequence[str], least: int = 10, most: int = 200) -> Callable[[Column], Column]:
    """True where any of the named filters says drop; with no names, nowhere."""
    steps = [_named(SENTENCE_FILTERS, n, "sentence filter") for n in names]

    def apply(s: Column) -> Column:
        said = [f(s, least, most) if f is bad_length else f(s) for f in steps]
        return reduce(lambda a, b: a | b, said, F.lit(False))

    return apply
