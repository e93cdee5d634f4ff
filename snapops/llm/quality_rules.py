"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

A document's measures are whole numbers: words, their code points, symbols, stop words, lines,
repeated lines and words in repeated three-word windows. A rule bounds one measure, or one
measure in hundredths of another, and is compared by multiplication, so no verdict depends on
rounding. ``compiled`` turns the table into columns; ``judged`` is the projection over the
documents. Nothing is shuffled and no function runs outside the JVM. The measures stand behind
a one-row generator, so a filter on a verdict does not measure a text again. Repeated windows are found
by sorting a text's own windows, words compared as they are, so the work of a text is
n log n in its words and its memory about a hundred bytes a word.

Words are runs of code points other than space, tab, line feed, vertical tab, form feed and
carriage return. Lines end at line feeds; those without a word are no lines here.

Defined cases: null and empty texts have no words, measure 0 throughout and fail ``short``;
rows are judged one by one, so repeated rows and ids and null ids come out as often as they
come in; equality with a bound passes; an empty table gives an empty result. Only ``doc_id``
and ``text`` are read, so further columns never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapops.functions.text import computed_once

#: Frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it was for on are with as his they be at this have from or by not but what all were when we there can an your which their if will each how them then she many some so these would other has more her two him see could no make than been its who now did get come made may part "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man "
    "le la les de des du un une et est en que qui dans pour pas au sur par plus ce il ne se sont avec son mais comme ou cette aux ses elle "
    "el los las del que y en un una por con para se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay"
).split()

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
BULLET = r"^ *[•‣*·–-]"
CUT = r"(?:\.\.\.|…) *$"


@dataclass(frozen=True)
class Rule:
    """``measure`` between the bounds; with ``per``, in hundredths of that measure."""

    name: str
    measure: str
    per: str | None = None
    at_least: int | None = None
    at_most: int | None = None


#: The two rules every document must pass first.
BASE = (
    Rule("short", "n_words", at_least=50),
    Rule("repeating", "n_repeat_words", "n_words", at_most=50),
)
#: The method's own thresholds.
RULES = (
    Rule("word_length", "word_chars", "n_words", at_least=250, at_most=1200),
    Rule("symbols", "n_symbols", "n_words", at_most=10),
    Rule("stop_words", "n_stop_words", at_least=2),
    Rule("letters", "n_letters", "word_chars", at_least=70),
    Rule("repeated_lines", "n_dup_lines", "n_lines", at_most=50),
    Rule("bullets", "n_bullet_lines", "n_lines", at_most=90),
    Rule("cut_lines", "n_cut_lines", "n_lines", at_most=30),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_letters", "n_lines", "n_bullet_lines", "n_cut_lines")


def fails(rule: Rule) -> Column:
    measure, per = F.col(rule.measure), F.lit(1) if rule.per is None else F.col(rule.per)
    scale = 1 if rule.per is None else 100
    low = F.lit(False) if rule.at_least is None else measure * scale < per * rule.at_least
    high = F.lit(False) if rule.at_most is None else measure * scale > per * rule.at_most
    return low | high


def compiled(base: tuple[Rule, ...], rules: tuple[Rule, ...]) -> list[Column]:
    """The table's verdicts: ``base_failed``, the names of all failed rules, and ``kept``."""
    failed = lambda table: F.array_compact(F.array(*(F.when(fails(r), F.lit(r.name)) for r in table)))
    none = lambda table: ~F.coalesce(*(F.when(fails(r), F.lit(True)) for r in table), F.lit(False))
    return [(~none(base)).alias("base_failed"), failed((*base, *rules)).alias("failed"), none((*base, *rules)).alias("kept")]


def _windows(words: Column, n: Column) -> Column:
    """The three-word windows with their places, in the order of their words."""
    places = F.sequence(F.lit(0), n - 1)
    zipped = F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), n).alias("b"), F.slice(words, F.lit(3), n).alias("c"), places.alias("at"))
    return F.sort_array(F.slice(zipped, F.lit(1), n - 2))


def _equal_neighbours(ordered: Column, n: Column) -> Column:
    neighbours = F.arrays_zip(ordered.alias("x"), F.slice(ordered, F.lit(2), n).alias("y"))
    same = lambda p: (p["x"]["a"] == p["y"]["a"]) & (p["x"]["b"] == p["y"]["b"]) & (p["x"]["c"] == p["y"]["c"])
    return F.filter(neighbours, same)


def _covered(pairs: Column) -> Column:
    """Words in the windows of ``pairs``, each word once."""
    starts = F.sort_array(F.array_distinct(F.concat(F.transform(pairs, lambda p: p["x"]["at"]), F.transform(pairs, lambda p: p["y"]["at"]))))
    first = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(-3).alias("last"))
    step = lambda had, at: F.struct((had["covered"] + F.least(F.lit(3), at - had["last"])).alias("covered"), at.alias("last"))
    return F.aggregate(starts, first, step, lambda had: had["covered"])


def _spaced(text: Column) -> Column:
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return text


def measured(docs: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """``doc_id`` and the measures of each whole text."""
    long = lambda c: c.cast("long")
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spaced = text.select("doc_id", "text", _spaced(F.col("text")).alias("spaced"))
    split = spaced.select("doc_id", "text", F.replace("spaced", F.lit(" "), F.lit("")).alias("bare"), F.array_remove(F.split("spaced", " "), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    counted = split.select("*", F.size("words").alias("n"))
    ordered = counted.select("*", F.when(F.col("n") > 3, _windows(F.col("words"), F.col("n"))).alias("windows"))
    paired = ordered.select("*", _equal_neighbours(F.col("windows"), F.col("n")).alias("pairs"))
    lines_like = lambda pattern: F.size(F.filter("lines", lambda x: x.rlike(pattern)))
    measures = [
        F.col("doc_id"),
        long(F.col("n")).alias("n_words"),
        long(F.length("bare")).alias("word_chars"),
        long(F.regexp_count("bare", F.lit(SYMBOLS))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.coalesce(_covered(F.col("pairs")), F.lit(0)).cast("long").alias("n_repeat_words"),
        long(F.size(F.array_intersect("words", F.array(*(F.lit(w) for w in sorted(set(stop_words))))))).alias("n_stop_words"),
        long(F.length(F.regexp_replace("bare", r"[^\p{L}]+", ""))).alias("n_letters"),
        long(F.size("lines")).alias("n_lines"),
        long(lines_like(BULLET)).alias("n_bullet_lines"),
        long(lines_like(CUT)).alias("n_cut_lines"),
    ]
    return computed_once(paired, measures)


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """``doc_id``, the measures, ``base_failed``, ``failed`` and ``kept``."""
    return measured(docs, stop_words).select("doc_id", *MEASURES, *compiled(base, rules))
