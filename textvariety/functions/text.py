"""Cleaning, label and predicate expressions. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label tags and the class ids they stand for.
LABEL_PREFIX = "__label__"
POSITIVE_TAG = "__label__PT_PT"
NEGATIVE_TAG = "__label__PT_BR"
TAG_TO_LABEL = {POSITIVE_TAG: 0, NEGATIVE_TAG: 1}
CLASSES = (0, 1)
POSITIVE_CLASS = 0
FALLBACK_CLASS = 1
KEEP_THRESHOLD = 0.7
MIN_LINE_LENGTH = 20
PREVIEW_LENGTH = 120

# Code points with the Unicode White_Space property.
_UNICODE_BLANKS = (
    [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680]
    + [*range(0x2000, 0x200B)]
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
# Python's str.strip() also drops the four ASCII separators.
_ASCII_SEPARATORS = [*range(0x1C, 0x20)]

BLANKS = {
    "unicode": "".join(map(chr, _UNICODE_BLANKS)),
    "python": "".join(map(chr, _UNICODE_BLANKS + _ASCII_SEPARATORS)),
}
# The "python" set as a regular-expression class (valid in Java and RE2).
BLANK_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def newline_to_space(text: Column | str) -> Column:
    """Replace each line feed by one space; tabs and returns stay."""
    return F.translate(_col(text), "\n", " ")


def strip(text: Column | str, flavour: str = "python") -> Column:
    """Trim Unicode blanks at both ends (Spark's own trim knows only U+0020)."""
    return F.btrim(_col(text), F.lit(BLANKS[flavour]))


def label_tag(label: Column | str) -> Column:
    """0 becomes the positive tag; anything else, null too, the negative one."""
    return F.when(_col(label) == POSITIVE_CLASS, POSITIVE_TAG).otherwise(NEGATIVE_TAG)


def labelled_line(text: Column | str, label: Column | str) -> Column:
    """Training line: tag, space, cleaned text. Null text gives a null line."""
    return F.concat(
        label_tag(label), F.lit(" "), strip(newline_to_space(text), "unicode")
    )


def tag_to_label(tag: Column | str) -> Column:
    """Class id of a tag; an unknown tag fails the query."""
    tag = _col(tag)
    known = F.lit(None).cast("int")
    for name, label in TAG_TO_LABEL.items():
        known = F.when(tag == name, F.lit(label)).otherwise(known)
    unknown = F.raise_error(F.concat(F.lit("unknown label tag: "), tag)).cast("int")
    return F.when(tag.isNull() | tag.isin(list(TAG_TO_LABEL)), known).otherwise(unknown)


def tag_name(tag: Column | str) -> Column:
    """Tag without its label prefix, for display."""
    return F.replace(_col(tag), F.lit(LABEL_PREFIX), F.lit(""))


def remap_label(label: Column | str, mapping: Mapping[int, int]) -> Column:
    """Translate another model's class ids into ours; null stays null.

    An id the mapping does not know fails the query: a null in its place would
    drop out of every count that follows.
    """
    label = _col(label)
    said = F.concat(F.lit("unmapped label: "), label.cast("string"))
    out = F.when(label.isNotNull(), F.raise_error(said).cast("int"))
    for source, target in mapping.items():
        out = F.when(label == source, F.lit(target)).otherwise(out)
    return out


def is_positive(label: Column | str, positive: int = POSITIVE_CLASS) -> Column:
    """1 for the positive class, else 0."""
    return F.when(_col(label) == positive, 1).otherwise(0)


def long_enough_line(line: Column | str, min_len: int = MIN_LINE_LENGTH) -> Column:
    """True when the stripped line, its tag included, is longer than min_len."""
    return F.length(strip(line)) > min_len


def known_label(label: Column | str) -> Column:
    """True for the two classes; false for third classes and null."""
    return F.coalesce(_col(label).isin(*CLASSES), F.lit(False))


def non_empty_text(text: Column | str) -> Column:
    """True unless null or ''; blank-only text counts as text."""
    return _col(text).isNotNull() & (_col(text) != "")


def preview(text: Column | str, n: int = PREVIEW_LENGTH) -> Column:
    """First n characters, followed by '...' only when something was cut."""
    text = _col(text)
    return F.when(
        F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))
    ).otherwise(text)


def fallback(text: Column | str, prediction: Column | str, default: object) -> Column:
    """The prediction, or the default where the text is blank or nothing was predicted."""
    cleaned = strip(newline_to_space(text))
    value = F.when(cleaned != "", _col(prediction))
    return F.coalesce(value, F.lit(default))


def keep_above(score: Column | str, threshold: float = KEEP_THRESHOLD) -> Column:
    """Inclusive threshold predicate."""
    return _col(score) >= F.lit(float(threshold))
