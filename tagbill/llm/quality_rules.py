"""Quality rules: a table of thresholds compiled into one Spark projection.

Counts of words, lines and symbols of a text give ratios; each row of ``RULES`` bounds
one ratio, and a text is kept if no rule and no base rule fails. All of it is a single
column expression of built-in functions: no user function, no shuffle, one scan.

Words are ``[^\\x20\\x09-\\x0D]+``. Repeated words are those in windows of eight words
found twice or more in the text; windows are compared by a 64-bit hash of word hashes.

Defined results. Null or empty text: all counts 0, base_failed, not kept. Ratios of a
text without words, characters or lines are 0. Repeated rows are judged alike. A null
doc_id stays null. Empty table: no rows. ``judge`` returns only its own columns, so
columns of the input never clash; ``keep`` returns the input's columns unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8

# Frequent words of English, German, French and Spanish.
STOP_WORDS = """
the of and to in that is was he for it with as his on be at by this had not are but from or have an they
der die das und ist den von zu mit sich des auf für nicht ein dem als eine im
le la les de un une est que qui dans pour pas au sur par avec du et
el los las y por con para del se no su al lo en
""".split()


@dataclass(frozen=True)
class Rule:
    """A text fails if count / per lies outside [least, most]."""
    name: str
    count: str
    per: str
    least: float | None = None
    most: float | None = None


RULES: tuple[Rule, ...] = (
    Rule("mean_word_length", "word_chars", "n_words", least=2.0, most=15.0),
    Rule("symbol_ratio", "n_symbols", "n_words", most=0.1),
    Rule("exclamation_ratio", "n_exclamations", "n_words", most=0.2),
    Rule("upper_case_ratio", "n_upper", "word_chars", most=0.3),
    Rule("stop_word_ratio", "n_stop_words", "n_words", least=0.03),
    Rule("adjacent_repeat_ratio", "n_adjacent", "n_words", most=0.2),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", most=0.5),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """How many words lie in windows that occur twice or more."""
    def of(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)),
                              lambda i: F.xxhash64(F.slice(hashes, i, F.lit(WINDOW))))
        return _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0))
                    .otherwise(_let(F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
                                    covered)))

    def covered(ranked: Column) -> Column:
        twice = F.filter(ranked, lambda x, k: (x["h"] == F.get(ranked, k + 1)["h"])
                         | (F.get(ranked, k - 1)["h"] == x["h"]))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return _let(starts, lambda s: F.aggregate(
            F.transform(s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda total, x: total + x))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), of))


def _ratio(row: Column, rule: Rule) -> Column:
    return F.when(row[rule.per] > 0, row[rule.count].cast("double") / row[rule.per].cast("double")).otherwise(F.lit(0.0))


def _fails(row: Column, rule: Rule) -> Column:
    ratio, found = _ratio(row, rule), F.lit(False)
    if rule.least is not None:
        found = found | (ratio < rule.least)
    if rule.most is not None:
        found = found | (ratio > rule.most)
    return found


def counts(text: Column) -> Column:
    """A struct of all counts that rules use."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    stop = [w for word in STOP_WORDS for w in (word, word.capitalize())]

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n"), F.size(F.array_distinct(lines)).alias("distinct"))

    def of_words(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        return _let(of_lines(lines), lambda n: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            n["n"].cast("long").alias("n_lines"),
            (n["n"] - n["distinct"]).cast("long").alias("n_dup_lines"),
            _repeated(w).cast("long").alias("n_repeat_words"),
            F.regexp_count(text, F.lit("!")).cast("long").alias("n_exclamations"),
            F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
            F.size(F.filter(w, lambda x: x.isin(stop))).cast("long").alias("n_stop_words"),
            F.size(F.filter(w, lambda x, i: F.get(w, i + 1) == x)).cast("long").alias("n_adjacent")))

    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    return _let(words, of_words)


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct: the counts, base_failed, failed (names of rules) and kept."""
    def of(c: Column) -> Column:
        base = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
        bad = reduce(lambda x, y: x | y, [_fails(c, r) for r in rules], F.lit(False))
        names = F.filter(F.array(*[F.when(_fails(c, r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
        return F.struct(*[c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                        base.alias("base_failed"), names.alias("failed"), (~base & ~bad).alias("kept"))

    return _let(counts(text), of)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, counts, base_failed, failed, kept) for every row of ``docs``."""
    return docs.select(F.col("doc_id"), verdict(F.col("text"), rules).alias("v")).select("doc_id", "v.*")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass."""
    return docs.filter(verdict(F.col("text"), rules)["kept"])


def duckdb_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same verdicts as DuckDB SQL over ``documents``, for comparison."""
    stop = ", ".join("'" + w + "'" for word in STOP_WORDS for w in (word, word.capitalize()))

    def fails(r: Rule) -> str:
        ratio = f"CASE WHEN {r.per} > 0 THEN {r.count}::DOUBLE / {r.per}::DOUBLE ELSE 0 END"
        return " OR ".join([f"{ratio} < {r.least}"] * (r.least is not None) + [f"{ratio} > {r.most}"] * (r.most is not None))

    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
windows AS (
  SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (
  SELECT r, sum(gap) AS n FROM (
    SELECT r, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, {WINDOW})) AS gap FROM twice) GROUP BY r),
c AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(text, '!'))::BIGINT AS n_exclamations,
         len(regexp_extract_all(text, '\\p{{Lu}}'))::BIGINT AS n_upper,
         len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
         len(list_filter(list_zip(words[:-2], words[2:]), lambda x: x[1] = x[2]))::BIGINT AS n_adjacent
  FROM w LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR {' OR '.join(fails(r) for r in rules)}) AS kept
FROM c"""
