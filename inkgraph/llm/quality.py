"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Every measure of a document comes from its own text, so the whole operator is one narrow
projection over the scan: no shuffle, no user function, no state. Intermediate arrays (the words,
the hashes of the eight-word windows) are bound once per row by ``_let``.

Defined cases: a null or empty text has no words, fails the base rules and gives zero measures;
repeated rows give repeated results; a ratio over an empty denominator is null and a rule on it
counts as met; an empty table gives an empty result; other columns are ignored. Eight-word windows are
compared by 64-bit hashes. A text of any length is measured whole: its words and windows are arrays of
one row, some thirty times its size while the row is worked on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it on was with be as by are this or an not "
    "der die und den von das ist mit des im für ein eine auf dem zu sich nicht "
    "le la les de et un une en que qui dans pour est du au "
    "el los las y del se por con una su para es lo no"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; the rule is applied from ``from_words`` words on."""

    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


RULES = (
    Rule("mean_word_length", 2.0, 12.0),
    Rule("symbol_ratio", high=0.1),
    Rule("alpha_ratio", low=0.5),
    Rule("dup_line_ratio", high=0.4),
    Rule("stop_word_ratio", low=0.01, from_words=100),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with ``value`` worked out once, also where ``body`` uses it in a loop."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words inside windows that occur twice or more in the text."""

    def positions(hashes: Column) -> Column:
        def found(s: Column) -> Column:
            k_of = F.sequence(F.lit(0), F.size(s) - 1)
            h = lambda k: F.get(s, k)["h"]
            twice = F.filter(k_of, lambda k: F.coalesce(h(k) == h(k - 1), F.lit(False)) | F.coalesce(h(k) == h(k + 1), F.lit(False)))
            return F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"]))

        return _let(F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), found)

    def covered(at: Column) -> Column:
        step = lambda sum_, k: sum_ + F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - F.get(at, k), F.lit(WINDOW)))
        return F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), F.lit(0), step)

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(positions(hashes), covered))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    return F.when(F.size(words) > WINDOW, _let(windows, counted)).otherwise(F.lit(0))


def _bare(word: Column) -> Column:
    return F.lower(F.rtrim(word, F.lit(".,;:!?")))


def measures(text: Column) -> dict[str, Column]:
    """Two bound structs, of the words and of the lines, and two counts of characters."""
    text = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: _bare(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_alpha_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    filled = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return {
        "_w": _let(F.array_remove(F.split(text, SPACE_CLASS + "+"), ""), of_words),
        "_l": _let(filled, of_lines),
        "word_chars": F.char_length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
    }


def _verdict(rule: Rule) -> Column:
    at = F.col(rule.measure)
    met = F.lit(True)
    if rule.low is not None:
        met = met & (at >= rule.low)
    if rule.high is not None:
        met = met & (at <= rule.high)
    return F.coalesce(met, F.lit(True)) | (F.col("n_words") < rule.from_words)


def quality_measures(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the counts, the ratios, base_failed, failed_rules and kept for every row of ``docs``."""
    counts = docs.select("doc_id", *[c.alias(n) for n, c in measures(F.col("text")).items()])
    counts = counts.select("doc_id", "_w.*", "_l.*", "word_chars", "n_symbols")
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    ratios = counts.withColumns(
        {
            "mean_word_length": over("word_chars", "n_words"),
            "symbol_ratio": over("n_symbols", "n_words"),
            "alpha_ratio": over("n_alpha_words", "n_words"),
            "dup_line_ratio": over("n_dup_lines", "n_lines"),
            "stop_word_ratio": over("n_stop_words", "n_words"),
        }
    )
    failed = F.array_compact(F.array(*[F.when(~_verdict(r), F.lit(r.measure)) for r in rules]))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return ratios.withColumn("base_failed", base).withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_VERDICTS = " AND ".join(
    f"(coalesce({' AND '.join([f'{r.measure} >= {r.low}'] * (r.low is not None) + [f'{r.measure} <= {r.high}'] * (r.high is not None))}, true) OR n_words < {r.from_words})"
    for r in RULES
)
SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT r, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - {WINDOW - 2})) AS i)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, range({WINDOW}) AS o(k) GROUP BY r
), lines AS (
  SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS x FROM w
), counts AS (
  SELECT doc_id, len(w) AS n_words, coalesce(covered.n, 0) AS n_repeat_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(x) AS n_lines, len(x) - len(list_distinct(x)) AS n_dup_lines,
    len(list_filter(w, lambda y: lower(rtrim(y, '.,;:!?')) IN ({_STOP}))) AS n_stop_words,
    len(list_filter(w, lambda y: regexp_matches(y, '\p{{L}}'))) AS n_alpha_words
  FROM w JOIN lines USING (r) LEFT JOIN covered USING (r)
), ratios AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, word_chars / nullif(n_words, 0) AS mean_word_length,
    n_symbols / nullif(n_words, 0) AS symbol_ratio, n_alpha_words / nullif(n_words, 0) AS alpha_ratio,
    n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio, n_stop_words / nullif(n_words, 0) AS stop_word_ratio FROM counts
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND {_VERDICTS} AS kept FROM ratios
"""
