"""Chat formatting: every assistant turn becomes a training example.

An example's text is its context, all that precedes its reply, then the reply
and the end mark; only the reply is trained on. As the template only ever
appends, each context is a prefix of the formatted conversation. So a
conversation of n turns gives examples of about n²/2 turns in all: they are cut
from the formatted text one by one, as they are read, and never lie side by side
in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textvariety.llm.common import let, pick, running

START, SAYS, END = "<s>[INST]", "[/INST]", "</s>"
TRAINED = "assistant"
# A control string, with as many backslashes inside as it was escaped times.
_PLAIN = r"(\[/?|</?)(\\*)(INST\]|s>)"
_ESCAPED = r"(\[/?|</?)\\(\\*)(INST\]|s>)"
_END_MARK = r"</s>"


def escape(text: Column) -> Column:
    """Put a backslash into every control string, so that none is left."""
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """Undo `escape` exactly."""
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, context_chars, reply).

    Row 0 of a conversation holds its formatted text; rows 1, 2, … are its
    assistant turns, expanded: `formatted` is the context of `context_chars`
    characters, `reply` (escaped) and the end mark, outside of the loss. Turns go by
    `turn`, nulls first, ties by role and text; null roles and texts are empty.
    Rows with a null conv_id make up one conversation. A repeated row is a
    further turn. The texts of one conversation meet in one row, as its digest
    and its formatted text need them.
    """
    rows = pick(conversations, "conv_id", "turn", "role", "text", turn="bigint")
    turns = F.array_sort(
        F.collect_list(
            F.struct(
                "turn",
                F.coalesce("role", F.lit("")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text"),
            )
        )
    )
    grouped = rows.groupBy("conv_id").agg(turns.alias("__turns"))

    def pieces(ts: Column) -> Column:
        made = F.transform(
            ts,
            lambda t: F.struct(
                (t["role"] == TRAINED).alias("trained"),
                F.concat(F.lit(START), escape(t["role"]), F.lit(SAYS)).alias("head"),
                escape(t["text"]).alias("body"),
            ),
        )
        return let(made, with_examples)

    def with_examples(ps: Column) -> Column:
        sizes = F.transform(
            ps,
            lambda p: (
                F.length(p["head"]) + F.length(p["body"]) + len(END)
            ).cast("bigint"),
        )
        return let(F.struct(ps.alias("ps"), running(sizes).alias("ends")), built)

    def built(s: Column) -> Column:
        whole = F.array_join(
            F.transform(s["ps"], lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""
        )
        replies = F.transform(
            s["ps"],
            lambda p, i: F.struct(
                F.when(
                    p["trained"],
                    F.get(s["ends"], i) - F.length(p["body"]) - len(END),
                ).alias("context_chars"),
                p["body"].alias("reply"),
            ),
        )
        conversation = F.struct(
            F.lit(None).cast("bigint").alias("context_chars"),
            F.lit(None).cast("string").alias("reply"),
        )
        kept = F.filter(replies, lambda r: r["context_chars"].isNotNull())
        rows = F.concat(F.array(conversation), kept)
        return F.struct(whole.alias("whole"), rows.alias("rows"))

    # Two steps, so that an example's text is made when its row is.
    made = grouped.select("conv_id", F.explode(F.array(let(F.col("__turns"), pieces))).alias("__m"))
    rows = made.select(
        "conv_id", F.col("__m.whole").alias("__whole"),
        F.posexplode("__m.rows").alias("example", "__row"),
    )
    context = F.substring("__whole", F.lit(1), F.col("__row.context_chars").cast("int"))
    expanded = F.concat(context, F.col("__row.reply"), F.lit(END))
    return rows.select(
        "conv_id", "example",
        F.when(F.col("example") == 0, F.col("__whole")).otherwise(expanded).alias("formatted"),
        "__row.*",
    )


def materialise(examples: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end) of the expanded examples."""
    return examples.filter("example > 0").select(
        "conv_id",
        "example",
        F.col("formatted").alias("text"),
        F.col("context_chars").alias("loss_start"),
        (F.col("context_chars") + F.length("reply")).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) structs of a formatted conversation, unescaped."""
    parts = F.split(formatted, _END_MARK, -1)
    turns = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        cut = F.instr(inner, SAYS)
        return F.struct(
            unescape(F.substring(inner, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(inner, cut + len(SAYS), F.length(inner))).alias("text"),
        )

    return F.transform(turns, turn)


def read_back(examples: DataFrame) -> DataFrame:
    """What the output of `format_examples` says about each conversation.

    The trained text is read from each example's own text where its loss mask
    lies, [context_chars, context_chars + length(reply)), not from the reply
    column, so a wrong context or mask shows in the digest. The rows of a
    conversation are still together, so this adds no shuffle.
    """
    whole = F.col("example") == 0
    under = F.substr("formatted", (F.col("context_chars") + 1).cast("int"), F.length("reply"))
    # One row a conversation; of the expanded texts only what the masks cover is kept.
    masked = examples.select(
        "conv_id",
        F.when(whole, F.col("formatted")).alias("__formatted"),
        F.when(~whole, F.struct("example", unescape(under).alias("text"))).alias("__loss"),
    )
    rows = masked.groupBy("conv_id").agg(
        F.max("__formatted").alias("__formatted"),
        F.array_sort(F.collect_list("__loss")).alias("__losses"),
    )
    told = F.array_join(
        F.transform(
            F.col("__turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
        ),
        "",
    )
    parsed = rows.select(
        "conv_id",
        F.length("__formatted").cast("bigint").alias("formatted_chars"),
        read_turns(F.col("__formatted")).alias("__turns"),
        F.array_join(F.transform("__losses", lambda m: m["text"]), "").alias("__loss"),
    )
    return parsed.select(
        "conv_id",
        F.size("__turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("__loss").cast("bigint").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
