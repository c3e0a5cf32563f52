"""Text and number column functions. All are built-in expressions except `nfkd_ascii` and `nfkc`, which use Arrow."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters and their ASCII forms, from the Unicode decomposition rule rather than a written table: those that fold to one
# character are translated, those that fold to several (ligatures, fractions, signs like the numero sign) are looked up.
_FOLDS, _SPREAD = {}, {}
for _code in range(0x80, 0x10000):
    _plain = unicodedata.normalize("NFKD", chr(_code)).encode("ascii", "ignore").decode() if not 0xD800 <= _code < 0xE000 else ""
    if len(_plain) == 1:
        _FOLDS[chr(_code)] = _plain
    elif _plain:
        _SPREAD[chr(_code)] = _plain
_FROM, _TO = "".join(_FOLDS), "".join(_FOLDS.values())


def _ranges(codes: list[int]) -> str:
    """A class of code points as ranges; the pattern engine tests single code points one after the other."""
    starts = [c for c in codes if c - 1 not in set(codes)]
    ends = [c for c in codes if c + 1 not in set(codes)]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends)) + "]"


_SPREAD_CLASS = _ranges(sorted(map(ord, _SPREAD)))
_SPREAD_TEXT = "\x01".join(f"{c}\x02{plain}" for c, plain in _SPREAD.items())
#: White space beyond ASCII, as typed by French keyboards and office programs.
BLANKS = "".join(chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def plain_blanks(text: Column) -> Column:
    """Every kind of blank as a space, so that patterns for white space meet them."""
    return F.when(is_ascii(text), text).otherwise(F.translate(text, BLANKS, " " * len(BLANKS)))


def strip(text: Column) -> Column:
    return F.regexp_replace(plain_blanks(text), r"^\s+|\s+$", "")


def fold(text: Column) -> Column:
    """ASCII form of a text by full decomposition; what has no ASCII form is dropped. Stays on the JVM."""
    forms = F.str_to_map(F.lit(_SPREAD_TEXT), F.lit("\x01"), F.lit("\x02"))
    spread = F.when(text.rlike(_SPREAD_CLASS), F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(forms, c), c)), "")).otherwise(text)
    return F.when(is_ascii(text), text).otherwise(F.regexp_replace(F.translate(spread, _FROM, _TO), r"[^\x00-\x7F]", ""))


@F.pandas_udf(StringType())
def nfkd_ascii(texts: pd.Series) -> pd.Series:
    """The full Unicode fold, for ligatures, full-width and other multi-letter forms."""
    return texts.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


def norm(text: Column) -> Column:
    """Folded, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(fold(text)), r"\s+", " "))


def plain(text: Column) -> Column:
    """`norm` without punctuation other than < > + -."""
    return F.trim(F.regexp_replace(F.lower(fold(text)), r"[^\w<>+-]+", " "))


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times in `body`, so that nested expressions do not multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def half_even_of(number: Column, decimals: int) -> Column:
    """Rounding of the exact binary value, ties to even, as IEEE decimal conversion does. `number` should be a column.

    `bround` rounds the printed digits, so 2.675 (stored slightly below the tie) would go up. The product with
    2 * 10^decimals is split into a rounded part and its exact error to see on which side of the tie the value is.
    """
    scale = 2.0 * 10.0 ** decimals
    split = 134217729.0
    scale_high = split * scale - (split * scale - scale)
    scale_low = scale - scale_high
    product = number * scale
    shifted = number * split
    high = shifted - (shifted - number)
    low = number - high
    error = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
    nearest = F.rint(product)
    side = F.signum((product - nearest) + error)
    odd = F.pmod(nearest, F.lit(2.0)) == 1.0
    near_tie = odd & (F.abs(product - nearest) < 1e-6)
    up = F.pmod((nearest - 1.0) / 2.0, F.lit(2.0)) * 0.5  # 0.5 when the lower neighbour is odd, else 0
    steps = (nearest - 1.0) / 2.0 + F.when(side == 0, 2 * up).otherwise((side + 1.0) / 2.0)
    return F.when(near_tie, steps / (10.0 ** decimals)).otherwise(F.bround(number, decimals))


def half_even_sql(name: str, decimals: int) -> str:
    """`half_even_of` of a named column as SQL text, which is parsed in one step where a plan is built from many columns."""
    scale = 2.0 * 10.0 ** decimals
    split = 134217729.0
    scale_high = split * scale - (split * scale - scale)
    n, s, k = name, f"{scale!r}D", f"{split!r}D"
    high = f"({n} * {k} - ({n} * {k} - {n}))"
    low = f"({n} - {high})"
    error = f"((({high} * {scale_high!r}D - {n} * {s}) + {high} * {scale - scale_high!r}D + {low} * {scale_high!r}D) + {low} * {scale - scale_high!r}D)"
    nearest = f"rint({n} * {s})"
    side = f"signum(({n} * {s} - {nearest}) + {error})"
    below = f"(({nearest} - 1.0D) / 2.0D)"
    steps = f"{below} + CASE WHEN {side} = 0 THEN pmod({below}, 2.0D) ELSE ({side} + 1.0D) / 2.0D END"
    return (f"CASE WHEN pmod({nearest}, 2.0D) = 1.0D AND abs({n} * {s} - {nearest}) < 1e-6D THEN ({steps}) / {10.0 ** decimals!r}D "
            f"ELSE bround({n}, {decimals}) END")


def round_half_even(number: Column, decimals: int) -> Column:
    """`half_even_of` for any expression, which is evaluated once."""
    return let(number, lambda n: half_even_of(n, decimals))


def number_text(number: Column) -> Column:
    """A number as written in a form: no decimals when it is whole."""
    return F.regexp_replace(number.cast("decimal(18,6)").cast("string"), r"\.?0+$", "")


def weeks(days: Column, fractional: bool = False) -> Column:
    """Whole weeks, or weeks with one decimal."""
    return round_half_even(days.cast("double") / 7.0, 1) if fractional else F.floor(days / 7).cast("long")


def sender_id(phone: Column) -> Column:
    """M4: the sender key of an international number, or null."""
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), r"[\s+()-]", "")
    return F.when(digits.rlike(r"^[0-9]{6,15}$"), F.concat(F.lit("whatsapp:+"), digits))


def mask_sender(sender: Column) -> Column:
    """M5: the sender key with only the first three and last two digits shown."""
    start = len("whatsapp:+") + 3
    hidden = F.greatest(F.length(sender) - start - 2, F.lit(0))
    return F.concat(F.substring(sender, 1, start), F.repeat(F.lit("•"), hidden), F.right(sender, F.lit(2)))


def digest_matches(declared: Column, content: Column) -> Column:
    """M6: a declared SHA-256 (base64 of 32 bytes, or 64 hex digits) must fit the bytes; anything else is not checked."""
    actual = F.sha2(content, 256)
    raw = F.try_to_binary(declared, F.lit("base64"))
    return (F.when(declared.isNull() | (declared == ""), True)
            .when(declared.rlike(r"^[A-Za-z0-9+/]{43}=$") & (F.length(raw) == 32), F.lower(F.hex(raw)) == actual)
            .when(declared.rlike(r"^[0-9a-fA-F]{64}$"), F.lower(declared) == actual)
            .otherwise(True))


def backoff_seconds(attempts: Column) -> Column:
    """M7: 30 s doubled per attempt, at most an hour."""
    return F.least(30 * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))), F.lit(3600.0)).cast("long")
