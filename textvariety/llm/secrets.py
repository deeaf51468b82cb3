"""Secrets in texts: fixed patterns, and strings that look drawn at random.

A second-order view of a string is its chain of character pairs. One Markov
chain is fitted to strings drawn at random (digests and their Base64 forms),
another to the identifiers of ordinary texts; a string whose log-likelihood
ratio passes a bound is reported as `random`. Everything is DataFrame functions:
a text is searched, scored and reported in its own row, without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textvariety.llm.common import let, n_of, pick, running, span_text

# --- Fixed values: the patterns that must be found ---
ASSIGN = (
    r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)"
    r"([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")
# --- end of fixed values ---

# Runs of at least this many characters may be called random.
MIN_RANDOM = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_RANDOM},}}+=*"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
IDENTIFIER = r"[A-Za-z0-9_-]{6,}"
# Ordinary identifiers come from so many documents at most, by hash order.
SAMPLE_DOCUMENTS = 4000
RANDOM_STRINGS = 3000
# In nats: evidence needed in all, and on average for each pair.
MIN_RATIO, MIN_MEAN_RATIO = 12.0, 0.7
_EMPTY = "array<struct<start:int,rank:int,end:int,kind:string>>"


@dataclass(frozen=True)
class RandomStringModel:
    """Log-likelihood ratios of character pairs, row by row of the alphabet."""

    ratios: tuple[float, ...]

    def ratio(self, string: Column) -> Column:
        """Sum over the pairs of a string over ALPHABET; 0 for one character."""
        codes = [ALPHABET.find(chr(i)) for i in range(128)]
        code_of = F.array(*(F.lit(max(c, 0)) for c in codes))
        ratios = F.array(*(F.lit(r) for r in self.ratios))

        def over(state: Column) -> Column:
            def add(total: Column, i: Column) -> Column:
                a, b = F.get(state["codes"], i), F.get(state["codes"], i + 1)
                return total + F.get(ratios, a * len(ALPHABET) + b)

            last = F.size(state["codes"]) - 2
            return F.when(last < 0, F.lit(0.0)).otherwise(
                F.aggregate(
                    F.sequence(F.lit(0), F.greatest(last, F.lit(0))), F.lit(0.0), add
                )
            )

        letters = F.split(string, "")
        codes_of = F.transform(letters, lambda c: F.get(code_of, F.ascii(c)))
        return let(F.struct(codes_of.alias("codes")), over)


def _pairs(strings: DataFrame) -> DataFrame:
    """(pair, n) over a column `s`: at most as many rows as there are pairs."""
    every = F.regexp_extract_all("s", F.lit(r"(?=([A-Za-z0-9+/_=-]{2}))"), F.lit(1))
    return strings.select(F.explode(every).alias("pair")).groupBy("pair").count()


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """Labelled sample of secrets: n each of hex, Base64 and capital strings."""
    digest = F.sha2(F.concat(F.lit("random-string-"), F.col("id").cast("string")), 256)
    forms = F.array(
        digest,
        F.base64(F.unhex(digest)),
        F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", "")),
    )
    return spark.range(n).select(F.explode(forms).alias("s"))


def ordinary_strings(docs: DataFrame, n: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Identifiers of at most n documents, those of smallest hash, outside of
    what the fixed patterns match. Only hashes are ranked; rows that are equal
    count once."""
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, "doc_id", "text").select(
        F.xxhash64("doc_id", text).alias("lot"), text.alias("text")
    )
    last = rows.select("lot").orderBy("lot").limit(n).agg(F.max("lot")).first()[0]
    below = rows.filter(F.col("lot") <= F.lit(last))
    chosen = below.groupBy("lot").agg(F.first("text").alias("text"))
    cleared = F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|[0-9a-f]{{32,}}", " ")
    found = F.regexp_extract_all(cleared, F.lit(IDENTIFIER), F.lit(0))
    return chosen.select(F.explode(found).alias("s"))


def train_random_strings(random: DataFrame, ordinary: DataFrame) -> RandomStringModel:
    """Fit both chains, with add-one smoothing, from columns `s` of strings.

    Only pair counts come to the driver, at most len(ALPHABET)² of each class.
    """
    chains = []
    for strings in (random, ordinary):
        counts = {r["pair"]: r["count"] for r in _pairs(strings).collect()}
        chain = []
        for a in ALPHABET:
            row = [counts.get(a + b, 0) + 1 for b in ALPHABET]
            chain += [math.log(x / sum(row)) for x in row]
        chains.append(chain)
    return RandomStringModel(tuple(round(r - o, 4) for r, o in zip(*chains)))


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """Sorted spans of the matches `keep` passes, given (match, group 2).

    Starts are the lengths of what lies between matches and of the matches
    before, summed up.
    """
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if kind == "assign" else 0))
    found = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        group.alias("values"),
    )

    def placed(f: Column) -> Column:
        steps = F.transform(
            f["hits"],
            lambda h, i: (
                F.length(F.get(f["gaps"], i))
                + F.when(i > 0, F.length(F.get(f["hits"], i - 1))).otherwise(0)
            ).cast("bigint"),
        )
        return let(
            F.struct(f["hits"].alias("hits"), f["values"].alias("values"), running(steps).alias("starts")),
            spans,
        )

    def spans(f: Column) -> Column:
        made = F.transform(
            f["hits"],
            lambda h, i: F.struct(
                F.get(f["starts"], i).cast("int").alias("start"),
                F.lit(KINDS.index(kind)).alias("rank"),
                (F.get(f["starts"], i) + F.length(h)).cast("int").alias("end"),
                F.when(keep(h, F.get(f["values"], i)), F.lit(kind)).alias("kind"),
            ),
        )
        return F.filter(made, lambda s: s["kind"].isNotNull())

    none = F.array().cast(_EMPTY)
    return F.when(text.rlike(pattern), let(found, placed)).otherwise(none)


def find_secrets(docs: DataFrame, model: RandomStringModel) -> DataFrame:
    """(doc_id, base, added): sorted spans in every whole text, row by row.

    `base` are the matches of the fixed patterns, `added` the random-looking
    runs that touch none of them; (start, rank, end, kind), in code points, end
    exclusive. A null text counts as empty; empty texts have no spans; repeated
    rows and null ids give a row each; other columns are left out.
    """
    text = F.coalesce("text", F.lit(""))
    hexes = rf"(?<!{HEX[:-1]}){HEX[:-1]}{{{MIN_HEX},}}+"
    rows = pick(docs, "doc_id", "text", text="string").select(
        "doc_id", text.alias("__text")
    )
    whole = F.col("__text")
    base = F.concat(
        _spans(whole, ASSIGN, "assign", lambda h, v: F.length(v) >= MIN_ASSIGN),
        _spans(whole, ACCESS, "access", lambda h, v: F.length(h) >= MIN_ACCESS),
        _spans(whole, hexes, "hex", lambda h, v: F.length(h) >= MIN_HEX),
    )

    def looks_random(hit: Column, _: Column) -> Column:
        ratio = model.ratio(hit)
        return let(
            ratio,
            lambda r: (r >= MIN_RATIO) & (r >= MIN_MEAN_RATIO * (F.length(hit) - 1)),
        )

    random = _spans(whole, CANDIDATE, "random", looks_random)
    both = F.struct(F.array_sort(base).alias("base"), random.alias("random"))

    def apart(b: Column) -> Column:
        added = F.filter(
            b["random"],
            lambda r: ~F.exists(
                b["base"], lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"])
            ),
        )
        return F.struct(b["base"].alias("base"), added.alias("added"))

    return rows.select("doc_id", let(both, apart).alias("__found")).select(
        "doc_id", "__found.base", "__found.added"
    )


def secrets_report(found: DataFrame) -> DataFrame:
    """Counts, digest and texts of the spans of `find_secrets`."""
    every = F.array_sort(F.concat("base", "added"))
    return found.select(
        "doc_id",
        *(n_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(every).alias("spans"),
    )
