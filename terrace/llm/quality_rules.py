"""Line-first cleaning: rules judge each line, failing lines go, then documents that lost too much go.

All of it is DataFrame functions over one row; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but space and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Marks other than ASCII that a line of prose may end in, by Unicode class: closing and quoting ones, and other
#: punctuation (sentence ends of all scripts are of that class) but commas, bullets, and reference, unit and text marks.
ENDS_BEYOND_ASCII = r"[\p{Pe}\p{Pf}\p{Pi}\p{Po}&&[^\x00-\x7F،、，﹐﹑､·•‣․‥‧‰‱†‡※§¶⁂⁎⁑＃％＆＊＠／＼]]"
#: Letters of scripts that set no spaces between words.
UNSPACED = r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]+"
#: Phrases of pages rather than of texts (lower case).
BOILERPLATE = (
    "all rights reserved", "terms of service", "terms of use", "privacy policy", "cookie policy", "use cookies",
    "uses cookies", "accept cookies", "enable javascript", "javascript is disabled", "lorem ipsum", "sign up for",
    "subscribe to our", "newsletter", "click here", "read more", "share this", "follow us", "log in", "powered by",
)


@dataclass(frozen=True)
class LineRules:
    """A line with words fails if one of these holds; a line without words is neutral and goes with them."""

    ends: str = ".!?…:;\"'”’»)]}"  #: marks a line of prose may end in, besides ENDS_BEYOND_ASCII
    min_unended_words: int = 12  #: shorter lines without such an end are headings or menu entries
    unspaced_letters: int = 4  #: letters of an unspaced script that count as a word there
    max_separators_per_word: float = 0.2  #: of | > » • · / standing alone: navigation
    max_shouted_words: float = 0.5  #: share of words that end in !! or consist of the same mark repeated
    max_symbols_per_word: float = 0.3
    boilerplate: tuple[str, ...] = BOILERPLATE
    max_boilerplate_words: int = 40  #: a phrase condemns only lines up to this length
    max_lost_words: float = 0.5  #: of the document's words in failing lines


def plain_spaces(text: Column) -> Column:
    """The text with every white space but line feeds as a space, so that parts can be split at one character."""
    return F.regexp_replace(text, r"[\x09\x0B-\x0D]", " ")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, " "), "")


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for a row, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def windows_of(words: Column) -> Column:
    """A 64-bit hash of every three neighbouring words."""
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.slice(hashes, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))


def words_in_doubles(windows: Column) -> Column:
    """How many words lie in a window that the text has twice or more. Only texts that have one sort
    (hash, place), which puts equal windows side by side."""

    def covered(of: Column) -> Column:
        same = lambda w, i, step: F.coalesce(w["h"] == F.get(of, i + step)["h"], F.lit(False))
        found = F.filter(of, lambda w, i: same(w, i, 1) | ((i > 0) & same(w, i, -1)))
        at = F.transform(found, lambda w: w["i"])
        return F.size(F.array_union(F.array_union(at, F.transform(at, lambda i: i + 1)), F.transform(at, lambda i: i + 2)))

    placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    none = F.size(F.array_distinct(windows)) == F.size(windows)
    return F.when(none, 0).otherwise(once(F.array_sort(placed), covered))


def line_fails(line: Column, n_words: Column, rules: LineRules) -> Column:
    """Cheap tests come first: a count is taken only of lines that have such a mark at all."""
    last = F.right(F.rtrim(line), F.lit(1))
    ended = last.isin(*rules.ends) | ((last > "\x7f") & last.rlike(ENDS_BEYOND_ASCII))
    unspaced = F.length(F.regexp_replace(line, UNSPACED, ""))
    long_enough = (F.octet_length(line) > F.length(line)) & (n_words + unspaced / rules.unspaced_letters >= rules.min_unended_words)
    lone = F.regexp_count(line, F.lit(r"(?<![^\x20\x09-\x0D])[|>»•·/](?![^\x20\x09-\x0D])"))
    shouted = F.regexp_count(line, F.lit(r"[!?]{2,}(?![^\x20\x09-\x0D])"))
    symbols = F.regexp_count(line, F.lit(r"[#*$%&<>]"))
    return (
        ((n_words < rules.min_unended_words) & ~ended & ~long_enough)
        | (line.rlike(r"[|>»•·/]") & (lone > rules.max_separators_per_word * n_words))
        | ((line.contains("!!") | line.contains("??")) & (shouted > rules.max_shouted_words * n_words))
        | (line.rlike(r"[#*$%&<>]") & (symbols > rules.max_symbols_per_word * n_words))
        | ((n_words <= rules.max_boilerplate_words) & F.lower(line).rlike("|".join(rules.boilerplate)))
    )


def judged(df: DataFrame, key: str = "doc_id", text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """``key``, base measures and verdict of every row, and the cleaned text.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed: as named. n_lost_words: words in
    failing lines. kept: not base_failed and at most ``max_lost_words`` lost. cleaned_text: the lines that did
    not fail. Null text counts as empty (no words, fails the base); null keys and repeated rows are rows like
    others; an empty table gives an empty result; other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    parts = df.select(F.col(key), body.alias("_text")).select(
        key,
        "_text",
        words_of(F.regexp_replace("_text", r"[\x09-\x0D]", " ")).alias("_words"),
        F.split("_text", "\n").alias("_lines"),
    )
    lines = F.transform("_lines", lambda l: F.struct(l.alias("l"), F.size(words_of(plain_spaces(l))).alias("n")))
    ruled = F.transform(
        F.filter(lines, lambda x: x["n"] > 0),
        lambda x: F.struct(x["l"].alias("l"), x["n"].alias("n"), line_fails(x["l"], x["n"], rules).alias("f")),
    )
    measured = parts.select("*", windows_of(F.col("_words")).alias("_windows")).select(
        key,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        words_in_doubles(F.col("_windows")).cast("long").alias("n_repeat_words"),
        ruled.alias("_ruled"),
    )
    prose = F.transform("_ruled", lambda x: x["l"])
    lost = F.aggregate("_ruled", F.lit(0), lambda n, x: n + F.when(x["f"], x["n"]).otherwise(0))
    counted = measured.select(
        "*",
        (F.size("_ruled") - F.size(F.array_distinct(prose))).cast("long").alias("n_dup_lines"),
        lost.cast("long").alias("n_lost_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.col("n_lost_words") <= rules.max_lost_words * F.col("n_words"))
    rest = F.array_join(F.transform(F.filter("_ruled", lambda x: ~x["f"]), lambda x: x["l"]), "\n")
    return counted.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), kept.alias("kept"), "n_lost_words", rest.alias("cleaned_text"),
    )
