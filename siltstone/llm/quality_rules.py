"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document; the ledger keeps the failure bits
together with the measurements they came from.  Policies are named, versioned
bit masks applied afterwards with integer arithmetic, and ablations are read
off a histogram of the bit patterns, so neither needs the texts again.

Edge cases: a null or empty text has no words, so it fails ``few_words`` and
scores zero on every measurement; a null id is carried through unchanged;
repeated rows each give a ledger row; an empty table gives an empty ledger.
Columns of the input other than the two named ones are ignored, so clashing
names cannot occur.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Bit position of each rule, in the order of the ledger.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "duplicate_lines": "2 * n_dup_lines > n_lines AND n_lines >= 4",
    "shouting": "5 * n_upper > 3 * word_chars AND n_words >= 20",
    "word_length": "word_chars < 2 * n_words OR word_chars > 25 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document passes if it fails none of them."""

    name: str
    version: int
    rules: tuple[str, ...] = field(default=tuple(RULES))

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STRICT = Policy("strict", 1)


def _let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable so that it is evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more in the row."""

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW),
            lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]),
        )

    def covered(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = _let(
            pairs,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        F.transform(
                            s,
                            lambda x, k: F.struct(
                                x["i"].alias("i"),
                                (
                                    F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                                    | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
                                ).alias("twice"),
                            ),
                        ),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        return F.aggregate(
            repeated,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
            lambda acc, i: F.struct(
                (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")
            ),
            lambda acc: acc["n"],
        )

    def from_hashes(h: Column) -> Column:
        return _let(
            windows(h),
            lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0).cast("long")),
        )

    zero = F.lit(0).cast("long")
    return F.when(
        F.size(words) > WINDOW, _let(F.transform(words, lambda w: F.xxhash64(w)), from_hashes)
    ).otherwise(zero)


def _count_of(text: Column, chars: str) -> Column:
    """Characters of ``text`` that are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with every measurement the rules use."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"))
    words = F.array_remove(F.split("_t", SPACE), "")
    lines = F.filter(F.split("_t", "\n"), lambda s: s.rlike(NOT_SPACE))
    word_part = _let(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")),
    )
    line_part = _let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    letters = F.regexp_replace("_t", r"[^A-ZÀ-ÖØ-Þ]+", "")
    return (
        base.withColumn("_w", word_part)
        .withColumn("_l", line_part)
        .select(
            "doc_id",
            F.col("_w.n_words"),
            (F.length("_t") - _count_of(F.col("_t"), SPACES)).cast("long").alias("word_chars"),
            _count_of(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
            F.col("_l.n_dup_lines"),
            F.col("_w.n_repeat_words"),
            F.col("_l.n_lines"),
            F.length(letters).cast("long").alias("n_upper"),
        )
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements plus ``failed``: bit k is set if the k-th rule of RULES fails."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES.values()):
        bits = bits + F.when(F.expr(rule), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return measure(docs, id_col, text_col).withColumn("failed", bits)


def verdict(policy: Policy) -> Column:
    """True for ledger rows that pass the policy."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablation(ledger_df: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents failing it, failing only it, and kept without it.

    The only shuffle is the histogram of bit patterns (at most 2**len(RULES) rows).
    """
    patterns = ledger_df.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    mask = policy.mask
    rules = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit"))
            for r in policy.rules
        ]
    )
    p = patterns.withColumn("r", F.explode(rules))
    under = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    hit = F.col("failed").bitwiseAND(F.col("r.bit")) != 0
    without = under.bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0
    return p.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & without, F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(without, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def quality_rules(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The ledger with ``base_failed`` and the policy's verdict ``kept``."""
    rows = ledger(docs)
    failed = ~verdict(BASE)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(policy)).alias("kept"), "failed",
    )


#: The same rows in DuckDB's dialect.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS c FROM r, range(0, 8) AS s(j) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n.c, 0)::BIGINT AS n_repeat_words,
        len(ls)::BIGINT AS n_lines,
        length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g'))::BIGINT AS n_upper
      FROM w LEFT JOIN n ON w.doc_id = n.doc_id),
f AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > word_chars THEN 4 ELSE 0 END
        + CASE WHEN 2 * n_dup_lines > n_lines AND n_lines >= 4 THEN 8 ELSE 0 END
        + CASE WHEN 5 * n_upper > 3 * word_chars AND n_words >= 20 THEN 16 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""
