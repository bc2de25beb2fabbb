"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = r"[^\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is it for on with that this are be by as was at from or an a "
    "der die das und zu den von mit im ist auf für ein eine nicht als des dem sich auch "
    "le la les de des et un une du en dans est que qui pour par sur pas au avec "
    "el los las del y una con por para se no su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure of a document has to be at least ``low`` and at most ``high``; None: no bound. A null measure passes."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Ratios are over words unless they say lines or characters.
RULES = (
    Rule("word_length", "word_chars / n_words", 2.0, 20.0),
    Rule("symbols", "n_symbols / n_words", None, 0.1),
    Rule("exclamations", "n_exclamations / n_words", None, 0.2),
    Rule("letters", "n_letters / word_chars", 0.7, None),
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.5),
    Rule("stop_words", "n_stop_words / n_words", 0.02, None),
)


def _measures(text: Column) -> dict[str, Column]:
    """Counts that are read straight from the text."""
    return {
        "_words": F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""),
        "_lines": F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0),
        "word_chars": F.length(F.translate(text, _SPACES, "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("bigint"),
        "n_exclamations": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))),
        "n_letters": F.length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", "")),
    }


def _repeat_words(words: Column) -> Column:
    """Words inside a window of three words that the text has twice or more.

    Windows are 64-bit hashes sorted with their positions; equal neighbours are repeated. The window positions
    sorted again, each adds up to three words until the next one begins.
    """
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))

    def covered(grams: Column) -> Column:
        def place(pairs: Column) -> Column:
            same = lambda i, j: F.get(pairs, i)["g"] == F.get(pairs, j)["g"]
            hit = F.filter(pairs, lambda p, i: F.coalesce(same(i - 1, i), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            return F.sort_array(F.transform(hit, lambda p: p["i"]))

        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        at = F.transform(F.array(pairs), place)
        gaps = F.transform(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x))
        return F.get(gaps, F.lit(0))

    grams = F.transform(F.array(windows), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(n < 4, F.lit(0)).otherwise(F.get(grams, F.lit(0))).cast("bigint")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """One row per row of ``docs`` with its measures, ``base_failed``, ``kept`` and ``failed_rules`` (names, in order).

    The base check fails a text of under ``min_words`` words, or one of whose words over ``max_repeat_percent``
    percent lie in repeated windows of three words. Every rule of ``rules`` is compiled into the same
    projection: a map-only job without user functions, whatever the number of rules. A null or blank text has
    no words and fails the base check. Ids are only passed on: null or repeated ids give a row each. Other
    columns are ignored, an empty table gives no rows.
    """
    df = _rated(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), "_id", rules, min_words, max_repeat_percent)
    return df.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "failed_rules")


def passing(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns."""
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rated = _rated(rows, "_row", rules, min_words, max_repeat_percent)
    # beside a column like this the verdict isn't copied into the filter, where it would be computed for every use
    return rated.withColumn("_at", F.monotonically_increasing_id()).filter("kept and _at >= 0").select("_row.*")


def _rated(df: DataFrame, carried: str, rules: tuple[Rule, ...], min_words: int, max_repeat_percent: int) -> DataFrame:
    df = df.select(carried, *[c.alias(k) for k, c in _measures(F.col("_text")).items()])
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("bigint"),
            "n_repeat_words": _repeat_words(F.col("_words")),
        }
    )
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    names = []
    for r in rules:
        value = F.expr(r.measure.replace("/ ", "/ nullif(") + ", 0)" if "/" in r.measure else r.measure)
        bad = F.lit(False)
        bad = bad | (value < r.low) if r.low is not None else bad
        bad = bad | (value > r.high) if r.high is not None else bad
        names.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(r.name)))
    df = df.withColumn("base_failed", base).withColumn("failed_rules", F.array_compact(F.array(*names)) if names else F.array().cast("array<string>"))
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) as i from d),
g as (select r, i, w, lead(w, 1) over p as w2, lead(w, 2) over p as w3 from w window p as (partition by r order by i)),
f as (select r, i, (w3 is not null and count(*) over (partition by r, w, w2, w3) > 1) as f from g),
c as (select r, i, max(f::int) over (partition by r order by i rows between 2 preceding and current row) as c from f),
n as (select r, sum(c)::bigint as n_repeat_words from c group by r),
m as (select r, count(*) as n_words, sum(length(w))::bigint as word_chars, count(*) filter (lower(w) in ({stop})) as n_stop_words from w group by r),
l as (select r, count(*) as n_lines, count(*) - count(distinct x) as n_dup_lines from (select r, unnest(string_split(text, chr(10))) as x from d) where regexp_matches(x, '[^\x20\x09-\x0D]') group by r),
a as (select doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_lines, 0) as n_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_stop_words, 0) as n_stop_words,
    length(text) - length(replace(text, '!', '')) as n_exclamations, length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) as n_letters
  from d left join n using (r) left join m using (r) left join l using (r)),
b as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed{rules}) as kept from b
"""


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the measures and verdicts, by windows over exploded words and lines."""
    tests = ""
    for r in rules:
        value = r.measure.replace("/ ", "/ nullif(") + ", 0)" if "/" in r.measure else r.measure
        tests += "".join(f" and coalesce({value} {op} {x}, true)" for op, x in ((">=", r.low), ("<=", r.high)) if x is not None)
    return _SQL.replace("{stop}", ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))).replace("{rules}", tests)
