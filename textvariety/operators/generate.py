"""One row in, many rows out. No shuffle, no Python."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textvariety.functions.text import BLANK_CLASS, non_empty_text, strip

# Fixed values of the chunking rule.
SENTENCE_BREAK = r"(?<=[.!?])" + BLANK_CLASS + "+"
SENTENCES_PER_CHUNK = 4
MIN_CHUNK_LENGTH = 20


def chunk_array(
    text: str = "text", per_chunk: int = SENTENCES_PER_CHUNK, min_len: int = MIN_CHUNK_LENGTH
):
    """(chunk_no, text) of the chunks of a text that are longer than min_len;
    null for a null text."""
    sentences = F.split(strip(text), SENTENCE_BREAK)

    def chunked(parts):
        last = F.floor((F.size(parts) - 1) / F.lit(per_chunk)).cast("int")
        every = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(
                i.alias("chunk_no"),
                strip(F.array_join(F.slice(parts, i * per_chunk + 1, F.lit(per_chunk)), " "))
                .alias("text"),
            ),
        )
        return F.filter(every, lambda c: F.length(c["text"]) > min_len)

    return F.element_at(F.transform(F.array(sentences), chunked), 1)


def sentence_chunks(
    df: DataFrame,
    text: str = "text",
    per_chunk: int = SENTENCES_PER_CHUNK,
    min_len: int = MIN_CHUNK_LENGTH,
) -> DataFrame:
    """Replace `text` by its chunks of consecutive sentences, with `chunk_no`.

    A sentence ends at blanks after '.', '!' or '?'. Chunks of min_len
    characters or fewer are dropped (their numbers stay unused).
    """
    others = [c for c in df.columns if c != text]
    chunks = chunk_array(text, per_chunk, min_len)
    return (
        df.filter(F.col(text).isNotNull())
        .select(*others, F.inline(chunks))
        .select(*others, "chunk_no", text)
    )


def unpivot_parallel(
    df: DataFrame, classes: Mapping[str, int], text: str = "text", label: str = "label"
) -> DataFrame:
    """One row per non-empty text of parallel text columns, with its class."""
    others = [c for c in df.columns if c not in classes]
    side = F.create_map(*(F.lit(v) for pair in classes.items() for v in pair))
    return (
        df.unpivot(others, list(classes), "_side", text)
        .filter(non_empty_text(text))
        .select(*others, text, side[F.col("_side")].alias(label))
    )


def lines_of(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per trimmed non-empty line of a text, with `line_no`, in order."""
    others = [c for c in df.columns if c != text]
    return (
        df.select(*others, F.posexplode(F.split(text, "\n")).alias("line_no", text))
        .withColumn(text, strip(text))
        .filter(F.col(text) != "")
    )
