"""Texts of drawings: measurements, labels, scale ratios, slugs."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that make a facade's text a title.
TITLE_WORDS = ("PRINCIPALA", "PRINCIPAL", "POSTERIOARA", "POSTERIOR", "LATERALA", "LATERAL", "STANGA", "DREAPTA", "STINGA")
#: Patterns of texts that label a region.
LABELS = ("FATADA", r"F\d+", r"U\d+", "PRINCIPALA", "POSTERIOARA", "LATERALA", "STANGA", "DREAPTA")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is
    used; keeps generated code small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def restore_decimal(value: Column) -> Column:
    """A whole number that lost its decimal point: of three digits the last
    two are decimals, of five the last three; of four the last three where
    that makes a plausible side (0.5 to 15 m), else the last two."""
    def restored(digits: Column) -> Column:
        two, three = digits / 100.0, digits / 1000.0
        side = F.when((three > 0.5) & (three < 15), three).when((two > 1) & (two < 200), two).otherwise(three)
        return F.when(digits.between(100, 999), two).when(digits.between(1000, 9999), side).when(digits.between(10000, 99999), three)

    return F.coalesce(let(F.floor(value).cast("long"), restored), value)


def measurement(text: Column) -> Column:
    """Struct of value and unit ("m²", "m") of a text with a number; nulls
    where it holds none. Rules in order: a number before a unit of area, one
    before a metre sign, digits that lost their point, a bare decimal."""
    def whole(s: Column) -> Column:
        return let(s.cast("double"), lambda v: F.when((v > 100) & ~F.contains(s, F.lit(".")), restore_decimal(v)).otherwise(v))

    def plausible(v: Column) -> Column:
        return let(v, lambda x: F.when((x > 0.1) & (x < 200), x))

    def found(t: Column) -> Column:
        number = lambda rx: F.nullif(F.regexp_extract(t, rx, 1), F.lit(""))
        return F.struct(
            number(r"(?i)(\d+\.?\d*)\s*(?:m[²2]|mp)").alias("area"), number(r"(?i)(\d+\.?\d*)\s*m(?![\d²2p])").alias("length"),
            number(r"(?i)(\d{3,5})\s*m").alias("lost"), number(r"(\d+\.\d{2,3})\b").alias("bare"),
        )

    def read(f: Column) -> Column:
        rest = F.coalesce(plausible(restore_decimal(f["lost"].cast("double"))), plausible(f["bare"].cast("double")))
        value = F.when(f["area"].isNotNull(), whole(f["area"])).when(f["length"].isNotNull(), whole(f["length"])).otherwise(rest)
        return let(value, lambda v: F.struct(v.alias("value"), F.when(f["area"].isNotNull(), "m²").when(f["length"].isNotNull(), "m").when(v < 30, "m").when(v.isNotNull(), "m²").alias("unit")))

    return let(let(F.trim(F.replace(text, F.lit(","), F.lit("."))), found), read)


def label_key(text: Column) -> Column:
    """``f 2-1`` and ``F_2`` are both F2; other labels are kept whole."""
    t = F.replace(F.upper(F.trim(text)), F.lit(" "), F.lit(""))
    letter, number = F.regexp_extract(t, r"^([FU])[_-]?(\d+)", 1), F.regexp_extract(t, r"^([FU])[_-]?(\d+)", 2)
    return F.when(letter != "", F.concat(letter, number)).otherwise(t)


def element_type(text: Column) -> Column:
    """Kind of element that a label names, or null."""
    t = F.upper(F.trim(text))
    form = r"\s*(\d+)(?:\s*[-_]\s*(\d+))?$"
    return F.when(F.rlike(t, F.lit("^F" + form)), "window").when(F.rlike(t, F.lit("^U" + form)), "door")


def facade_title(text: Column) -> Column:
    return F.contains(F.upper(text), F.lit("FATAD"))


def qualified_title(text: Column) -> Column:
    """Whether a facade's text names it, rather than its area."""
    return F.rlike(F.upper(text), F.lit("|".join(TITLE_WORDS)))


def labels_region(text: Column) -> Column:
    return F.rlike(F.upper(text), F.lit("|".join(LABELS)))


def door_signal(label: Column, ocr: Column, area: Column) -> Column:
    """Whether texts or area speak for a door."""
    both = F.upper(F.concat_ws(" ", F.coalesce(label, F.lit("")), F.coalesce(ocr, F.lit(""))))
    named = F.rlike(both, F.lit(r"\bU(?:SA)?[_ -]*PHOTO[_ -]*\d+\b")) | F.rlike(both, F.lit(r"\bU(?:SA)?[_ -]*\d+\b"))
    named = named | F.rlike(F.upper(F.coalesce(ocr, F.lit(""))), F.lit(r"\bU\s*[-_ ]?\d+\b"))
    return ~F.contains(both, F.lit("FATADA")) & (named | F.coalesce(area.between(0.5, 6.5), F.lit(False)))


def ratio_text(text: Column) -> Column:
    return F.translate(F.upper(text), "IL", "11")


def scale_word(text: Column) -> Column:
    """Whether a text says that it gives a scale (I and L read as 1)."""
    return F.rlike(ratio_text(text), F.lit(r"SCA?R|SC\."))


def scale_ratios(text: Column) -> Column:
    """All ratios of a text: array of (denominator, reversed form). I and L
    are read as 1; what stands around a ratio doesn't matter."""
    t = ratio_text(text)
    sign = r"\s*[:/\\|]\s*"
    as_struct = lambda xs, back: F.transform(xs, lambda d: F.struct(d.cast("int").alias("den"), F.lit(back).alias("reversed")))
    plain = F.regexp_extract_all(t, F.lit("1" + sign + r"(\d{2,4})"), F.lit(1))
    back = F.regexp_extract_all(t, F.lit(r"(\d{2,4})" + sign + "1"), F.lit(1))
    return F.concat(as_struct(plain, False), as_struct(back, True))


def _marked_letters() -> tuple[str, str]:
    """Latin letters with marks, and the letters without."""
    marked, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        first, *rest = unicodedata.normalize("NFD", chr(code))
        if rest and first.isascii() and first.isalpha():
            marked.append(chr(code))
            plain.append(first)
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _marked_letters()


def slug(text: Column) -> Column:
    """Letters and digits, other signs as single underscores."""
    return F.btrim(F.regexp_replace(F.translate(text, MARKED, PLAIN), "[^A-Za-z0-9]+", "_"), F.lit("_"))
