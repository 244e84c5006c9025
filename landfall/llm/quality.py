"""Line-first quality rules, on built-in functions only.

Each line is judged by punctuation, navigation and boilerplate rules; failing lines are removed, and a
document that loses too much of its text with them is rejected. Before that, a base rule rejects
documents that are short or repeat themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words; everything else is part of a word.
SPACE = r"[\x20\x09-\x0D]+"
#: Fixed values of the rules, in the spelling that Java and RE2 share.
SYMBOLS = "[#*$%&|<>]"
SEPARATORS = "[|»›·•→]"
NOISE = "[#*$%&|<>!]{2,}"
SENTENCE = "[.,;:!?。，、！？…،؟।]"
BOILERPLATE = (
    "(?i)(all rights reserved|accept (all )?cookies|cookie policy|cookie settings|privacy policy|terms of (use|service)"
    "|enable javascript|lorem ipsum|click here|skip to (main )?content|back to top|subscribe to our|sign up for"
    "|share (this|on) (facebook|twitter|page)|powered by)"
)
BOILERPLATE_WORDS = 25
PLAIN_WORDS = 20
LOST_PERCENT = 50
BASE_WORDS = 50
BASE_REPEAT_PERCENT = 50

#: Bits of a packed 64-bit value that hold a word's position.
_POSITION_BITS = 24


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def line_fails(line: Column) -> Column:
    """Whether one line breaks a rule; blank lines never do.

    Navigation: a separator for every four words or more. Punctuation: a run of symbols for every five
    words or more, or a long line without any sentence mark. Boilerplate: a short line with a set phrase.
    """
    n = F.size(words_of(line))
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    noise = F.regexp_count(line, F.lit(NOISE))
    return (n > 0) & (
        ((separators >= 2) & (separators * 4 >= n))
        | ((noise >= 2) & (noise * 5 >= n))
        | ((n >= PLAIN_WORDS) & ~line.rlike(SENTENCE))
        | ((n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE))
    )


def _visible(text: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(text, SPACE, ""))


def _repeated(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from the column ``_w``: words in a three-word window that the text holds twice or more.

    The windows' hashes are sorted with their positions in the low bits, so equal ones are neighbours. The
    high bits alone could join different windows; where full hashes differ between neighbours the sort is
    done on whole hashes. All of it stays in the row.
    """
    mask = (1 << _POSITION_BITS) - 1
    grams = df.withColumn(
        "_h",
        F.expr("if(size(_w) < 3, array(), transform(slice(_w, 1, greatest(size(_w) - 2, 0)), (x, i) -> xxhash64(x, get(_w, i + 1), get(_w, i + 2))))"),
    )
    packed = grams.withColumn("_p", F.expr(f"sort_array(transform(_h, (x, i) -> (x & {~mask}L) | i))"))
    same = f"shiftright(get(_p, j), {_POSITION_BITS}) = shiftright(x, {_POSITION_BITS})"
    near = packed.withColumn(
        "_hits",
        F.expr(f"filter(_p, (x, j) -> coalesce({same.replace('get(_p, j)', 'get(_p, j - 1)')}, false) or coalesce({same.replace('get(_p, j)', 'get(_p, j + 1)')}, false))"),
    )
    # neighbours with one prefix and different hashes, or a text too long for the position bits
    mixed = near.withColumn(
        "_mixed",
        F.expr(
            f"size(_h) > {mask} or exists(transform(_hits, (x, j) -> shiftright(get(_hits, j + 1), {_POSITION_BITS}) = shiftright(x, {_POSITION_BITS}) "
            f"and get(_h, cast(get(_hits, j + 1) & {mask}L as int)) <> get(_h, cast(x & {mask}L as int))), y -> coalesce(y, false))"
        ),
    )
    whole = mixed.withColumn("_s", F.expr("if(_mixed, sort_array(transform(_h, (x, i) -> struct(x as h, i as i))), cast(array() as array<struct<h:bigint,i:int>>))"))
    at = whole.withColumn(
        "_at",
        F.expr(
            "sort_array(if(_mixed, "
            "transform(filter(_s, (x, j) -> coalesce(get(_s, j - 1).h = x.h, false) or coalesce(get(_s, j + 1).h = x.h, false)), x -> cast(x.i as bigint)), "
            f"transform(_hits, x -> x & {mask}L)))"
        ),
    )
    return at.withColumn("n_repeat_words", F.expr("aggregate(transform(_at, (x, j) -> least(3L, coalesce(get(_at, j + 1) - x, 3L))), 0L, (a, x) -> a + x)")).drop(
        "_h", "_p", "_hits", "_mixed", "_s", "_at"
    )


def line_first_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measures, verdicts and cleaned text of line-first rules.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean),
    lost_percent (double; 0 for a text without words) and clean_text (the text without failing lines).
    A null text counts as empty: it has no words, fails the base rule and has a null clean_text. Columns
    of docs stay, except those that have the name of an added one, which are replaced. Each row is
    judged alone and whole, however long, so repeated rows and null keys make no difference; an empty
    table gives no rows.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_percent", "clean_text"]
    source = docs.drop(*[c for c in docs.columns if c in added and c != text])
    if text in added:
        raise ValueError(f"the text column cannot be named {text}")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = source.withColumn("_t", body).withColumns({"_w": words_of(F.col("_t")), "_l": F.split("_t", "\n")})
    measured = _repeated(lines)
    worded = F.filter("_l", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    judged = measured.withColumns({"_v": worded, "_good": F.filter("_l", lambda x: ~line_fails(x))})
    counted = judged.withColumns(
        {
            "n_words": F.size("_w").cast("bigint"),
            "word_chars": F.length(F.array_join("_w", "")).cast("bigint"),
            "n_symbols": F.regexp_count(F.col("_t"), F.lit(SYMBOLS)).cast("bigint"),
            "n_dup_lines": (F.size("_v") - F.size(F.array_distinct("_v"))).cast("bigint"),
            "_left": _visible(F.array_join("_good", "")).cast("bigint"),
            "clean_text": F.when(F.col(f"`{text}`").isNotNull(), F.array_join("_good", "\n")),
        }
    )
    # One-element explode: a filter on the verdict would else be pushed below the steps above, each step's
    # expression then standing in the next one's lambdas.
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_left"]
    counted = counted.select(*[F.col(f"`{c}`") for c in source.columns], "clean_text", F.explode(F.array(F.struct(*measures))).alias("_m")).select("*", "_m.*")
    lost = F.col("word_chars") - F.col("_left")
    return (
        counted.withColumn("base_failed", (F.col("n_words") < BASE_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * BASE_REPEAT_PERCENT))
        .withColumn("lost_percent", F.when(F.col("word_chars") > 0, lost * F.lit(100.0) / F.col("word_chars")).otherwise(0.0))
        .withColumn("kept", ~F.col("base_failed") & (lost * 100 <= F.col("word_chars") * LOST_PERCENT))
        .select(*[F.col(f"`{c}`") for c in source.columns], *added)
    )
