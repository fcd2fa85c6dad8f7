"""Quality rules: a threshold table compiled into Spark projections, without user functions.

``measures`` adds one column for each measured quantity, ``verdict`` compiles ``RULES`` into the name of the first
rule a text breaks. Everything is a built-in expression over one row, so the operator needs no shuffle and no state.

Edge cases: a null text counts as empty; an empty text has zeros everywhere and fails; rows are judged one by one, so
repeated rows get equal results; of several rules that a text breaks the first of the table is named; texts of any length
are judged whole; any further columns, also those named like a measure, pass through ``kept_only`` untouched; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.llm.common import WORD, let, no_null, table

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "auf das den der die ein eine im ist mit nicht und von zu "
    "au dans de des est et la le les pour que qui sur un une "
    "con del el las los por se y"
).split()

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A text breaks the rule if ``value`` lies outside [low, high], once it has ``least`` of the counted ``unit``."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None
    unit: str = "n_words"
    least: int = 0


#: SQL over the measures. Ratios are to words, or to lines that have a word.
RULES = (
    Rule("too_few_words", "n_words", low=10),
    Rule("repeated_windows", "100 * n_repeat_words", high="20 * n_words"),
    Rule("mean_word_length", "word_chars / n_words", low=2, high=14, least=10),
    Rule("symbols", "n_symbols / n_words", high=0.1),
    Rule("exclamations", "n_exclamations / n_words", high=0.5),
    Rule("stop_words", "n_stop_words / n_words", low=0.06, least=30),
    Rule("doubled_words", "n_doubled_words / n_words", high=0.3),
    Rule("duplicate_lines", "n_dup_lines / n_lines", high=0.3, unit="n_lines", least=10),
)

#: The rules that the contract fixes; the others are this operator's own.
BASE = ("too_few_words", "repeated_windows")


def _same_window(words: Column, i: Column, j: Column) -> Column:
    return F.slice(words, i + 1, F.lit(5)) == F.slice(words, j + 1, F.lit(5))


def _repeat_words(words: Column) -> Column:
    """The words that lie in a window of five that occurs twice or more.

    Windows are sorted by (hash, place). Equal windows then stand side by side, and a hash match counts only if the
    words agree too. The covered words are the union of [place, place + 5) over the repeated places.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))

    def matched(s: Column, k: Column, step: int) -> Column:
        other, own = F.get(s, k + step), F.get(s, k)
        return F.coalesce((other["h"] == own["h"]) & _same_window(words, other["i"], own["i"]), F.lit(False))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = let(pairs, lambda s: F.transform(F.filter(s, lambda _, k: matched(s, k, -1) | matched(s, k, 1)), lambda p: p["i"]))
        gaps = let(F.sort_array(places), lambda p: F.transform(p, lambda v, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - v, F.lit(5)))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    repeated = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n >= 6, repeated).otherwise(F.lit(0)).cast("long")


def _count(words: Column, test) -> Column:
    return F.size(F.filter(words, test)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` and its measured quantities, all long: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, n_exclamations, n_stop_words, n_doubled_words. Columns of these names in ``docs`` are replaced."""
    split = docs.withColumn("_words", F.regexp_extract_all(no_null("text"), F.lit(WORD), F.lit(0))).withColumn(
        "_lines", F.filter(F.split(no_null("text"), "\n"), lambda line: line.rlike(WORD))
    )
    words, lines, joined = F.col("_words"), F.col("_lines"), F.col("_joined")
    split = split.withColumn("_joined", F.array_join(words, ""))
    return split.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.char_length(joined).cast("long"),
            "n_symbols": (F.char_length(joined) - F.char_length(F.regexp_replace(joined, f"[{SYMBOLS}]", ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": _repeat_words(words),
            "n_lines": F.size(lines).cast("long"),
            "n_exclamations": (F.char_length(joined) - F.char_length(F.replace(joined, F.lit("!"), F.lit("")))).cast("long"),
            "n_stop_words": _count(words, lambda w: w.isin(*(s + end for s in STOP_WORDS for end in ("", ",", ".")))),
            "n_doubled_words": _count(words, lambda w, i: F.coalesce(F.get(words, i + 1) == w, F.lit(False))),
        }
    ).drop("_words", "_lines", "_joined")


def broken(rule: Rule) -> Column:
    """True if a row of measures breaks the rule; a ratio to zero breaks nothing."""
    value = F.expr(rule.value) if "/" not in rule.value else F.expr("try_divide({}, {})".format(*rule.value.split("/")))
    out = F.lit(False)
    if rule.low is not None:
        out = out | (value < F.expr(str(rule.low)))
    if rule.high is not None:
        out = out | (value > F.expr(str(rule.high)))
    return F.coalesce((F.col(rule.unit) >= rule.least) & out, F.lit(False))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The first rule broken, or null: the threshold table as one expression over measures."""
    return F.coalesce(*[F.when(broken(r), F.lit(r.name)) for r in rules], F.lit(None).cast("string"))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, base_failed, rule (the first one broken, or null) and kept."""
    base = [broken(r) for r in RULES if r.name in BASE]
    return measures(docs).withColumn("base_failed", base[0] | base[1]).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def kept_only(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that break no rule, with their own columns only.

    Rows go by exploding an array of one or none: a filter would be pushed below the measures, which it would then
    evaluate anew for each use.
    """
    marked = judged(docs.select(F.struct(*docs.columns).alias("_row"), F.col("text")), rules)
    return marked.select(F.explode(F.when(F.col("kept"), F.array("_row"))).alias("_row")).select("_row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document, and the rule that decided."""
    return judged(table(spark, sf_dir, "documents", ["doc_id", "text"])).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def _sql_value(rule: Rule) -> str:
    return rule.value if "/" not in rule.value else "CAST({} AS DOUBLE) / nullif({}, 0)".format(*rule.value.split("/"))


def _sql_broken(rule: Rule) -> str:
    tests = [f"{_sql_value(rule)} {sign} {bound}" for sign, bound in (("<", rule.low), (">", rule.high)) if bound is not None]
    return f"coalesce({rule.unit} >= {rule.least} AND ({' OR '.join(tests)}), false)"


def measures_sql(source: str) -> str:
    """DuckDB SQL for ``judged`` over a relation of doc_id and text."""
    stop = ", ".join(f"'{s}{end}'" for s in STOP_WORDS for end in ("", ",", "."))
    names = " ".join(f"WHEN {_sql_broken(r)} THEN '{r.name}'" for r in RULES)
    base = " OR ".join(_sql_broken(r) for r in RULES if r.name in BASE)
    return f"""
WITH t AS (
  SELECT *, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM {source}),
g AS (SELECT *, array_to_string(w, '') AS j,
        CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [] END AS grams FROM t),
u AS (SELECT rid, unnest(grams) AS gram, generate_subscripts(grams, 1) AS i FROM (SELECT row_number() OVER () AS rid, * FROM g)),
d AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM u),
s AS (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS gap FROM d WHERE c > 1),
r AS (SELECT rid, sum(gap) AS n FROM s GROUP BY rid),
m AS (SELECT g.* EXCLUDE (w, ls, j, grams, rid), len(w) AS n_words, length(j) AS word_chars,
        length(j) - length(regexp_replace(j, '[{SYMBOLS}]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
        length(j) - length(replace(j, '!', '')) AS n_exclamations,
        len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop_words,
        len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_doubled_words
      FROM (SELECT row_number() OVER () AS rid, * FROM g) g LEFT JOIN r ON r.rid = g.rid)
SELECT *, ({base}) AS base_failed, CASE {names} ELSE NULL END AS rule, NOT ({base}) AND (CASE {names} ELSE NULL END) IS NULL AS kept FROM m"""


SQL = f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule FROM ({measures_sql('documents')}) q"
