"""Spelling variants: words one edit apart, found through a dictionary of
trie-node pairs.

Every distinct prefix of the vocabulary is a node of the forward trie and every
distinct suffix a node of the reversed trie; a node's integer number is the
64-bit hash of its length and string, made inside the row. Splitting a word of length L after i code points (0 <= i <= L)
gives the pair (prefix node, suffix node) of that split; skipping its code point
i gives (node of its first i, node of what follows i + 1). Then:

* a skip of w equal to a split of v: v is w with one code point deleted;
* a skip of w equal to a skip of v (v != w): they differ in one replaced code
  point at the same place.

Pairs met by equal numbers are confirmed on the strings at the known place, so
the joins give exactly the words one edit apart. A skip pair is shared only by the words
that differ at that one place, so no group grows beyond the alphabet.

Forms point to a word of at least twice the count, so following them ends;
roots come by pointer doubling, one stored join per round.

Defined results: null texts and texts without runs give no words; repeated rows
count as often as they occur; null doc_id is hashed as the empty string; ties
of count go to the smaller word in code-point order; an empty table, or one
without words of MIN_LENGTH code points and MIN_COUNT occurrences, gives no
rows; columns beside doc_id and text, also with clashing names, are ignored;
long texts and long runs are handled like short ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textvariety.llm.common import pick
from textvariety.sources.scratch import store

# Fixed by the contract: letters, lower-casing, the deletion rule, word sizes.
RUNS = r"[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
DIVISOR = 97
MIN_LENGTH = 5
MIN_COUNT = 3
FORM_FACTOR = 2


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs after the deletion rule, of MIN_LENGTH code points and
    MIN_COUNT occurrences."""
    rows = pick(docs, doc_id, text)
    runs = rows.select(
        F.col(doc_id).cast("string").alias("id"),
        F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUNS), 0)).alias("run"),
    )
    low = F.translate("run", UPPER, LOWER)
    keyed = runs.select(
        low.alias("run"),
        F.crc32(F.encode(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), low), "UTF-8"))
        .alias("h"),
    )
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(
        F.col("h") % DIVISOR == 0,
        F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2)),
    ).otherwise(F.col("run"))
    counted = keyed.select(word.alias("word")).filter(F.length("word") >= MIN_LENGTH)
    return counted.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)


def trie_pairs(words: DataFrame) -> DataFrame:
    """(word, pos, p, s, kind): node numbers of every split (kind 0, at pos) and
    every skip (kind 1, of the code point at pos) of every word.

    A node's number is the 64-bit hash of its length and string, made in the
    row: no prefix string is stored or shuffled. Pairs found by equal numbers
    are checked on the strings afterwards, so a collision adds no neighbour.
    """
    w = F.col("word")
    size = F.length(w)
    prefix = F.transform(
        F.sequence(F.lit(0), size), lambda i: F.xxhash64(i, F.substr(w, F.lit(1), i))
    )
    suffix = F.transform(
        F.sequence(F.lit(0), size), lambda i: F.xxhash64(size - i, F.substr(w, i + 1))
    )
    nodes = words.select("word", prefix.alias("pre"), suffix.alias("suf"))
    every = F.transform(
        F.sequence(F.lit(0), F.size("pre") * 2 - 2),
        lambda j: F.when(
            j % 2 == 0,
            F.struct(
                (j / 2).cast("int").alias("pos"),
                F.get("pre", (j / 2).cast("int")).alias("p"),
                F.get("suf", (j / 2).cast("int")).alias("s"),
                F.lit(0).alias("kind"),
            ),
        ).otherwise(
            F.struct(
                ((j - 1) / 2).cast("int").alias("pos"),
                F.get("pre", ((j - 1) / 2).cast("int")).alias("p"),
                F.get("suf", ((j + 1) / 2).cast("int")).alias("s"),
                F.lit(1).alias("kind"),
            )
        ),
    )
    return nodes.select("word", F.inline(every))


def _same(a, a_from, b, b_from, count=None):
    """Code points of a from a_from equal those of b from b_from (1-based)."""
    if count is None:
        return F.substr(a, a_from) == F.substr(b, b_from)
    return F.substr(a, a_from, count) == F.substr(b, b_from, count)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other): every ordered pair of words one edit apart."""
    cut = store(trie_pairs(words))
    skips = cut.filter("kind = 1").select("word", "pos", "p", "s")
    splits = cut.filter("kind = 0").select("word", "pos", "p", "s")
    a, b = skips.alias("a"), skips.alias("b")
    one = F.lit(1)
    replaced = a.join(b, ["p", "s"]).filter(
        (F.col("a.word") != F.col("b.word"))
        & (F.col("a.pos") == F.col("b.pos"))
        & (F.length("a.word") == F.length("b.word"))
        & _same(F.col("a.word"), one, F.col("b.word"), one, F.col("a.pos"))
        & _same(F.col("a.word"), F.col("a.pos") + 2, F.col("b.word"), F.col("a.pos") + 2)
    ).select(F.col("a.word").alias("word"), F.col("b.word").alias("other"))
    c = splits.alias("c")
    deleted = a.join(c, ["p", "s"]).filter(
        (F.col("a.pos") == F.col("c.pos"))
        & (F.length("a.word") == F.length("c.word") + 1)
        & _same(F.col("a.word"), one, F.col("c.word"), one, F.col("a.pos"))
        & _same(F.col("a.word"), F.col("a.pos") + 2, F.col("c.word"), F.col("a.pos") + 1)
    ).select(F.col("a.word").alias("word"), F.col("c.word").alias("other"))
    inserted = deleted.select(F.col("other").alias("word"), F.col("word").alias("other"))
    return replaced.unionByName(deleted).unionByName(inserted).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the end, by pointer doubling."""
    current = store(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        step = current.alias("x").join(
            current.alias("y"), F.col("x.root") == F.col("y.word"), "left"
        ).select(
            F.col("x.word").alias("word"),
            F.coalesce(F.col("y.root"), F.col("x.root")).alias("root"),
            (F.col("y.root").isNotNull() & (F.col("y.root") != F.col("x.root"))).alias("moved"),
        )
        step = store(step)
        if not step.filter("moved").limit(1).count():
            return step.select("word", "root")
        current = step.select("word", "root")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root (strings); n, n_near, form_n (longs) of every word."""
    words = store(word_counts(docs, doc_id, text))
    near = near_pairs(words.select("word"))
    counted = near.join(words.withColumnsRenamed({"word": "other", "n": "other_n"}), "other")
    best = counted.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("neg"), F.col("other").alias("other"))).alias(
            "top"
        ),
    )
    joined = words.join(best, "word", "left")
    chosen = F.col("top.neg") <= -FORM_FACTOR * F.col("n")
    forms = store(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(chosen, F.col("top.other")).alias("form"),
            F.when(chosen, -F.col("top.neg")).cast("long").alias("form_n"),
        )
    )
    return forms.join(roots(forms.select("word", "form")), "word").select(
        "word", "form", "root", F.col("n").cast("long").alias("n"), "n_near", "form_n"
    )
