"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

Each rule bounds a measure of the text: lengths, symbol, stop-word and line ratios.  The ratios of stop words and
of stutter are smoothed by a few words that every text is taken to have, so that they mean as much for short texts
as for long ones.  A null or empty text has no words and fails ``n_words``; very long texts are measured whole.
Rows are judged one by one, so repeated rows and ties fare alike, and empty tables give empty ones.  Existing
columns stay as they are, whatever their names: the measures are in ``measures``, a struct, the names of broken
rules in ``broken`` and the verdict in ``keep``; columns of these names in the input are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import unused

SYMBOLS = "#*&%$|<>{}~^\\_="
#: The same as a Java class of characters, where a caret and a backslash are escaped and && isn't an operator.
SYMBOL_RUN = r"[#*%$|<>{}~\^\\_=&]+"
STOP_WORDS = ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "der", "die", "und", "den", "von", "zu", "le", "la", "les", "de", "et", "des", "el", "los", "que", "y", "en", "un")


class Rule(NamedTuple):
    name: str
    measure: str
    least: float | None
    most: float | None


#: A document is kept if all hold.
RULES = (
    Rule("too_short", "n_words", 1, None),
    Rule("word_length", "mean_word", 1.5, 20),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("exclamation", "exclamations_per_word", None, 0.3),
    Rule("capitals", "capital_ratio", None, 0.4),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("stutter", "stutter_ratio", None, 0.2),
    Rule("lines", "repeated_line_ratio", None, 0.5),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.3),
    Rule("bullets", "bullet_line_ratio", None, 0.9),
)
#: Measures that the report of kept documents shows.
SHOWN = ("mean_word", "symbols_per_word", "capital_ratio", "stop_word_ratio", "stutter_ratio", "repeated_line_ratio")
#: Few words tell little of a ratio: each text is taken to have so many stop words, and so many words without stutter, besides its own.
PRIOR_STOP_WORDS, PRIOR_WORDS = 1, 8


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever the optimizer moves the expression."""
    return F.transform(F.array(value), body)[0]


def _measures(t: Column, words: Column, solid: Column, letters: Column, lines: Column) -> dict[str, Column]:
    """solid: the text without white space; letters: its letters alone."""
    n, n_lines, n_letters = F.size(words), F.size(lines), F.length(letters)
    neighbours = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a == b)
    return {
        "n_words": n,
        "mean_word": _ratio(F.length(solid), n),
        "symbols_per_word": _ratio(F.length(solid) - F.length(F.regexp_replace(solid, SYMBOL_RUN, "")), n),
        "exclamations_per_word": _ratio(F.length(solid) - F.length(F.replace(solid, F.lit("!"), F.lit(""))), n),
        "capital_ratio": _ratio(n_letters - F.length(F.regexp_replace(letters, r"\p{Lu}+", "")), n_letters),
        "stop_word_ratio": (F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))) + PRIOR_STOP_WORDS) / (n + PRIOR_STOP_WORDS),
        "stutter_ratio": F.size(F.filter(neighbours, lambda same: same)) / (n + PRIOR_WORDS),
        "repeated_line_ratio": _ratio(n_lines - F.size(F.array_distinct(lines)), n_lines),
        "ellipsis_line_ratio": _ratio(F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))), n_lines),
        "bullet_line_ratio": _ratio(F.size(F.filter(lines, lambda x: F.substring(x, 1, 1).isin("-", "*", "•", "·"))), n_lines),
    }


def _verdict(text: Column, rules: tuple[Rule, ...]) -> Column:
    """The struct of ``measures`` and ``broken`` of a text."""

    def breaks(m: Column, r: Rule) -> Column:
        out = F.lit(False) if r.least is None else m[r.measure] < float(r.least)
        return out if r.most is None else out | (m[r.measure] > float(r.most))

    def judge(m: Column) -> Column:
        return F.struct(m.alias("measures"), F.filter(F.array(*(F.when(breaks(m, r), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull()).alias("broken"))

    def measure(t: Column) -> Column:
        bare = F.trim(t, F.lit(" \t\r\n\f\x0b"))
        words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t\r\n\f\x0B]+"))
        lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
        measures = lambda w, s, m, x: F.struct(*(v.cast("double").alias(k) for k, v in _measures(t, w, s, m, x).items()))
        return _let(words, lambda w: _let(F.array_join(w, ""), lambda s: _let(F.regexp_replace(s, r"[^\p{L}]+", ""), lambda m: _let(lines, lambda x: _let(measures(w, s, m, x), judge)))))

    return _let(F.coalesce(text, F.lit("")), measure)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Adds ``measures``, ``broken`` (names of the rules that the text breaks, in table order) and ``keep``."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("measures", "broken", "keep")]
    (name,) = unused(docs, "verdict")
    judged = docs.select(*kept, _verdict(F.col(f"`{text_col}`"), rules).alias(name))
    return judged.select(*kept, f"{name}.measures", f"{name}.broken", (F.size(f"{name}.broken") == 0).alias("keep"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that break no rule, with their own columns."""
    return docs.filter(F.size(_verdict(F.col("text"), rules)["broken"]) == 0)


def oracle(where: str = "") -> str:
    """The rules over ``documents`` in DuckDB; ``where`` are the columns to select."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = []
    for r in RULES:
        bounds = [f"{r.measure} < {r.least}"] * (r.least is not None) + [f"{r.measure} > {r.most}"] * (r.most is not None)
        tests.append(f"CASE WHEN {' OR '.join(bounds)} THEN '{r.name}' END")
    return f"""
WITH s AS (SELECT *, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\r\\n\\f\\v]+'), lambda w: w <> '') AS ws,
    list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls FROM documents),
  c AS (SELECT *, len(ws) AS n, len(ls) AS nl, length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS letters,
    len(list_filter(list_zip(ws[1:len(ws) - 1], ws[2:len(ws)]), lambda p: p[1] = p[2])) AS stutters FROM s),
  m AS (SELECT *, n::DOUBLE AS n_words, CASE WHEN n > 0 THEN length(regexp_replace(t, '[ \\t\\r\\n\\f\\v]+', '', 'g')) / n ELSE 0 END AS mean_word,
    CASE WHEN n > 0 THEN (length(t) - length(translate(t, '{SYMBOLS}', ''))) / n ELSE 0 END AS symbols_per_word,
    CASE WHEN n > 0 THEN (length(t) - length(replace(t, '!', ''))) / n ELSE 0 END AS exclamations_per_word,
    CASE WHEN letters > 0 THEN (letters - length(regexp_replace(t, '[^\\p{{L}}]+|\\p{{Lu}}+', '', 'g'))) / letters ELSE 0 END AS capital_ratio,
    (len(list_filter(ws, lambda w: list_contains([{stop}], w))) + {PRIOR_STOP_WORDS}) / (n + {PRIOR_STOP_WORDS}) AS stop_word_ratio,
    stutters / (n + {PRIOR_WORDS}) AS stutter_ratio,
    CASE WHEN nl > 0 THEN (nl - len(list_distinct(ls))) / nl ELSE 0 END AS repeated_line_ratio,
    CASE WHEN nl > 0 THEN len(list_filter(ls, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) / nl ELSE 0 END AS ellipsis_line_ratio,
    CASE WHEN nl > 0 THEN len(list_filter(ls, lambda x: x[1] IN ('-', '*', '•', '·'))) / nl ELSE 0 END AS bullet_line_ratio FROM c),
  j AS (SELECT *, array_to_string(list_filter([{", ".join(tests)}], lambda x: x IS NOT NULL), ',') AS broken FROM m)
SELECT {where or "doc_id, n_words, round(mean_word, 6) AS mean_word, round(symbols_per_word, 6) AS symbols_per_word, round(capital_ratio, 6) AS capital_ratio, round(stop_word_ratio, 6) AS stop_word_ratio, round(stutter_ratio, 6) AS stutter_ratio, round(repeated_line_ratio, 6) AS repeated_line_ratio, broken, broken = '' AS keep"} FROM j"""


def kept_oracle() -> str:
    """The documents that break no rule, with the measures that the report shows."""
    return oracle("doc_id, n_words, " + ", ".join(f"round({m}, 6) AS {m}" for m in SHOWN)) + " WHERE broken = ''"
