"""Document fingerprints from closed syncmers.

A text is a row of pieces: its words, cut every PIECE characters. A run of K
pieces is an anchor when the smallest hash of its inner runs of S pieces lies
at its first or last place. That depends on the run alone, so equal passages
have equal anchors wherever they stand, and no gap between anchors is longer
than K - S runs. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textvariety.llm.common import indices, let, pick

PIECE, K, S = 4, 4, 1
# Neighbours are found inside of ranges of ids; so many ranges to a shuffle partition.
RANGES_PER_PARTITION = 4
MAX_RANGES = 16_384


def anchors(text: Column) -> Column:
    """The 32-bit anchors of a text in order, repeats included.

    A text of fewer than K pieces, or without any anchor, has one: the hash of
    all its pieces. A text without pieces has none.
    """
    pieces = F.regexp_extract_all(
        text, F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0)
    )
    width = K - S + 1

    def inner(p: Column) -> Column:
        if S == 1:  # a run is a piece
            runs = F.transform(p, lambda x: F.xxhash64(F.xxhash64(x)))
        else:
            runs = let(F.transform(p, lambda x: F.xxhash64(x)), several)
        return let(F.struct(p.alias("p"), runs.alias("runs")), chosen)

    def several(h: Column) -> Column:
        return F.transform(
            indices(F.size(h) - (S - 1)),
            lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(S))),
        )

    def chosen(x: Column) -> Column:
        runs = x["runs"]

        def closed(i: Column) -> Column:
            first, last = F.get(runs, i), F.get(runs, i + (width - 1))
            least = F.least(*(F.get(runs, i + j) for j in range(width)))
            return (least == first) | (least == last)

        at = F.filter(indices(F.size(runs) - (width - 1)), closed)
        found = F.transform(
            at, lambda i: F.hash(*(F.get(runs, i + j) for j in range(0, width, S)))
        )
        # Only for texts without an anchor.
        hashes = F.transform(x["p"], lambda p: F.xxhash64(p))
        whole = F.when(F.size(x["p"]) > 0, F.array(F.hash(hashes))).otherwise(
            F.array().cast("array<int>")
        )
        return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(whole))

    return let(pieces, inner)


def fingerprint(anchored: Column) -> Column:
    """Eight hex digits an anchor."""
    hexes = F.transform(
        anchored,
        lambda a: F.lpad(F.hex(a.cast("bigint").bitwiseAND(0xFFFFFFFF)), 8, "0"),
    )
    return F.lower(F.array_join(hexes, ""))


def _numbered(anchored: Column) -> Column:
    """Every anchor with how many of its like came before it, as one long each."""

    def starts(x: Column) -> Column:
        first = F.filter(
            indices(F.size(x)), lambda i: (i == 0) | (F.get(x, i) != F.get(x, i - 1))
        )
        ends = F.concat(first, F.array(F.size(x)))
        return let(F.struct(x.alias("x"), ends.alias("at")), numbered)

    def numbered(s: Column) -> Column:
        def run(j: Column) -> Column:
            start = F.get(s["at"], j)
            value = F.shiftleft(F.get(s["x"], start).cast("bigint"), 32)
            return F.transform(indices(F.get(s["at"], j + 1) - start), lambda i: value + i)

        return F.flatten(F.transform(indices(F.size(s["at"]) - 1), run))

    return let(F.sort_array(anchored), starts)


def likeness(a: Column, b: Column) -> Column:
    """Shared anchors over all, repeats counted; 1 for two empty texts."""
    return numbered_likeness(_numbered(a), _numbered(b))


def numbered_likeness(a: Column, b: Column) -> Column:
    """`likeness` of anchors that were numbered before."""

    def share(x: Column) -> Column:
        both = F.size(F.array_intersect(x["a"], x["b"]))
        either = F.size(x["a"]) + F.size(x["b"]) - both
        return F.when(either == 0, F.lit(1.0)).otherwise(both / either)

    return let(F.struct(a.alias("a"), b.alias("b")), share)


def _ranged(docs: DataFrame) -> DataFrame:
    """Rows with the range of ids they lie in, and a copy of each range's first
    row (`__ghost`) in the range that comes before it.

    Ids go down, nulls last; the very first row follows the very last. Only one
    id for each range, at most MAX_RANGES, comes to the driver. Rows of one id
    share a range.
    """
    spark = docs.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = min(count * RANGES_PER_PARTITION, MAX_RANGES)
    shares = F.array(*(F.lit(i / count) for i in range(1, count)))
    cuts = docs.select(F.percentile_approx("doc_id", shares, 10 * count)).first()[0]
    bounds = sorted(set(cuts or []))
    steps = F.array(*(F.lit(b).cast("bigint") for b in bounds))
    place = F.size(F.filter(steps, lambda b: b < F.col("doc_id")))
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(place)
    rows = docs.select("*", bucket.cast("int").alias("__bucket"))
    firsts = rows.groupBy("__bucket").agg(F.max("doc_id").alias("first")).collect()
    firsts = sorted(((r["__bucket"], r["first"]) for r in firsts), reverse=True)
    # The first row of a range is needed at the end of the range above it.
    needed = [
        (bucket, firsts[(i + 1) % len(firsts)][1])
        for i, (bucket, _) in enumerate(firsts)
    ]
    ghosts = spark.createDataFrame(needed, "__to int, __id bigint")
    joined = rows.join(
        F.broadcast(ghosts), F.col("doc_id").eqNullSafe(F.col("__id")), "left"
    )
    own = F.struct(F.col("__bucket"), F.lit(0).alias("__ghost"))
    sent = F.struct(F.col("__to").alias("__bucket"), F.lit(1).alias("__ghost"))
    places = F.when(F.col("__to").isNull(), F.array(own)).otherwise(F.array(own, sent))
    return joined.select(*docs.columns, F.explode(places).alias("p")).select(
        *docs.columns, "p.*"
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_text, fingerprint, edited_fingerprint,
    near_edited, near_next) of every whole text.

    The next document is the one of the next smaller id, ties by the hash of
    the text; null ids come last and the first document follows the last. The
    edited text has its last third replaced by the next document's start. Null
    texts are empty; repeated rows stand next to each other; other columns are
    left out. The texts are shuffled once.
    """
    rows = pick(docs, "doc_id", "text", doc_id="bigint", text="string")
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"))
    placed = _ranged(rows).repartition("__bucket")
    anchored = placed.select("*", anchors(F.col("__text")).alias("__anchors"))
    order = W.partitionBy("__bucket").orderBy(
        "__ghost", F.desc_nulls_last("doc_id"), F.xxhash64("__text")
    )
    pairs = anchored.select(
        "*",
        F.lead("__text").over(order).alias("__next"),
        F.lead("__anchors").over(order).alias("__next_anchors"),
    ).filter("__ghost = 0")
    n = F.length("__text")
    cut = (n / 3).cast("int")
    edited = F.concat(
        F.substring("__text", F.lit(1), n - cut), F.substring("__next", F.lit(1), cut)
    )
    told = pairs.select(
        "doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited_text"),
        "__anchors", "__next_anchors",
    )
    # Its own anchors are numbered once for both comparisons.
    both = F.struct(
        "edited_text",
        anchors(F.col("edited_text")).alias("anchors"),
        _numbered(F.col("__anchors")).alias("own"),
    )

    def compared(e: Column) -> Column:
        return F.struct(
            e["edited_text"].alias("edited_text"),
            fingerprint(e["anchors"]).alias("edited_fingerprint"),
            numbered_likeness(e["own"], _numbered(e["anchors"])).alias("near_edited"),
            numbered_likeness(e["own"], _numbered(F.col("__next_anchors"))).alias("near_next"),
        )

    return told.select(
        "doc_id",
        "n_chars",
        fingerprint(F.col("__anchors")).alias("fingerprint"),
        let(both, compared).alias("__e"),
    ).select(
        "doc_id", "n_chars", "__e.edited_text", "fingerprint",
        "__e.edited_fingerprint", "__e.near_edited", "__e.near_next",
    )
