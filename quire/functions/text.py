"""Text functions as columns; all stay in the JVM unless said otherwise. Null gives null."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with accents and what they fold to, letter by letter: fixed values.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_accents(c: Column | str) -> Column:
    """Lower case, with the accented letters of Western languages folded."""
    return F.translate(F.lower(_c(c)), ACCENTED, FOLDED)


def one_blank(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_c(c), r"[ \t\r\n]+", " "))


def clean(c: Column | str, boilerplate: list[str]) -> Column:
    """Without links, DOIs, copyright years and the given patterns (any case), white space collapsed."""
    patterns = [r"https?://\S+", r"(?i)\bdoi:?\s*10\.\d{4,9}/\S+", r"©\s*\d{4}", *(f"(?i){p}" for p in boilerplate)]
    return one_blank(reduce(lambda x, p: F.regexp_replace(x, p, " "), patterns, one_blank(c)))


def protect_phrases(c: Column | str, phrases: list[str]) -> Column:
    """Phrases of several words joined by underscores, longest first, in lower case."""
    by_length = sorted(set(phrases), key=lambda p: (-len(p), p))
    return reduce(lambda x, p: F.replace(x, F.lit(p.lower()), F.lit(p.lower().replace(" ", "_"))), by_length, F.lower(_c(c)))


def words(c: Column | str, least: int = 3, stop: list[str] | None = None, pattern: str = "[a-z]+") -> Column:
    """The matches of ``pattern`` in lower case of at least ``least`` letters that aren't stop words."""
    found = F.regexp_extract_all(F.lower(_c(c)), F.lit(f"({pattern})"), 1)
    keep = lambda w: (F.length(w) >= least) & ~w.isin(stop) if stop else F.length(w) >= least
    return F.filter(found, keep)


def ngrams(w: Column, n: int) -> Column:
    """Runs of ``n`` successive words, joined by blanks."""
    starts = F.sequence(F.lit(1), F.size(w) - n + 1)
    return F.when(F.size(w) >= n, F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def terms(c: Column | str, stop: list[str]) -> Column:
    """Distinct words of three letters or more and neighbouring pairs of what is left after stop words."""
    w = words(c, 3, stop)
    return F.array_distinct(F.concat(w, ngrams(w, 2)))


def sentences(c: Column | str) -> Column:
    """Parts between a full stop, exclamation or question mark and the white space after it."""
    return F.filter(F.split(F.trim(_c(c)), r"(?<=[.!?])\s+"), lambda s: s != "")


def slug(c: Column | str) -> Column:
    """Letters and digits joined by underscores; 'unknown' for null or empty, 'x_' and part of a
    digest where nothing is left."""
    t = F.trim(_c(c))
    s = F.regexp_replace(F.regexp_replace(fold_accents(t), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(t, F.lit("")) == "", "unknown").when(s == "", F.concat(F.lit("x_"), F.substring(F.sha1(t), 1, 10))).otherwise(s)


def first_year(c: Column | str) -> Column:
    """The first whole number of up to five digits, with its sign; dashes of all kinds count as one."""
    t = F.regexp_extract(F.translate(_c(c), "−–—", "---"), r"(-?\d{1,5})", 1)
    return F.when(t != "", t.cast("int"))


def list_items(c: Column | str, marks: str = r"[;|,\n]") -> Column:
    """Items of a list in a text: split, tidied, without empty ones, the first of each spelling in
    any case."""
    items = F.filter(F.transform(F.split(_c(c), marks), one_blank), lambda x: x != "")
    lower = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def rebuilt(c: Column | str) -> Column:
    """A text out of a map of words and their places; a text of one word stays."""
    pairs = F.flatten(F.transform(F.map_entries(_c(c)), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def count_terms(c: Column | str, patterns: list[str]) -> Column:
    """Matches of any of the patterns, longest first, so that nothing counts twice; null counts 0.
    Patterns are for any case unless they begin with (?-i:."""
    joined = "|".join(sorted(patterns, key=lambda p: (-len(p), p)))
    return F.coalesce(F.regexp_count(one_blank(c), F.lit(f"(?i)(?:{joined})")), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays' elements; 0 if either is empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def stem(c: Column | str) -> Column:
    """Without a common English ending, if three letters are left."""
    return F.regexp_replace(F.lower(_c(c)), r"(?<=[a-z]{3})(ingly|edly|ations?|ing|ed|ies|es|s)$", "")


def singular(c: Column | str) -> Column:
    w = F.lower(_c(c))
    return (
        F.when(w.rlike("[^aeiou]ies$"), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("(ch|sh|ss|x|o)es$"), F.regexp_replace(w, "es$", ""))
        .when(w.rlike("[^su]s$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def match_grade(query: Column, name: Column) -> tuple[Column, Column]:
    """(grade, confidence) of a text against a name: exact, token_set, partial by shared words, none."""
    q, n = fold_accents(one_blank(query)), fold_accents(one_blank(name))
    a, b = F.array_distinct(words(q, 1)), F.array_distinct(words(n, 1))
    j = jaccard(a, b)
    same = F.array_sort(a) == F.array_sort(b)
    grade = F.when(q == n, "exact").when(same & (F.size(a) > 0), "token_set").when(j > 0, "partial").otherwise("none")
    return grade, F.when(grade == "exact", 1.0).when(grade == "token_set", 0.9).when(grade == "partial", 0.45 + 0.3 * j).otherwise(0.0)


def without_markup(c: Column | str) -> Column:
    """Text of HTML or wiki markup: no scripts, tags, templates, comments; links by their text."""
    steps = [(r"(?s)<!--.*?-->", " "), (r"(?is)<(script|style)\b.*?</\1>", " "), (r"\{\{[^{}]*\}\}", " "), (r"\{\{[^{}]*\}\}", " "),
             (r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", "$1"), (r"<[^>]+>", " "), (r"'{2,}", ""), (r"&nbsp;", " "), (r"&amp;", "&")]
    return one_blank(reduce(lambda x, s: F.regexp_replace(x, *s), steps, _c(c)))


def ingredient_name(c: Column | str) -> Column:
    """An ingredient line without brackets, leading amounts and units, and what follows a comma."""
    t = F.regexp_replace(F.lower(one_blank(c)), r"[\(\[][^\)\]]*[\)\]]", " ")
    t = F.regexp_replace(t, r"^[\s\d/.,½¼¾-]+", "")
    t = F.regexp_replace(t, r"^(cups?|oz\.?|ounces?|lbs?|pounds?|spoons?|pinch|handful|pints?|quarts?)\s+(of\s+)?", "")
    return one_blank(F.regexp_replace(t, r"\s*,.*$", ""))


def marker_found(c: Column | str, markers: list[str]) -> Column:
    """The first of the markers, in their order, that the text contains in any case; else null."""
    t = F.lower(_c(c))
    return F.coalesce(*(F.when(t.contains(m.lower()), F.lit(m)) for m in markers))


def safe_cell(c: Column | str) -> Column:
    """A text that a spreadsheet won't take for a formula, without control characters."""
    t = F.regexp_replace(_c(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.when(t.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), t)).otherwise(t)


def lenient_json(c: Column | str, schema: str) -> Column:
    """The first JSON object of a chatty answer, fences and words around it ignored; null if unreadable."""
    return F.from_json(F.regexp_extract(_c(c), r"(?s)(\{.*\})", 1), schema)


def truthy(c: Column | str, yes: tuple[str, ...] = ("true", "1", "yes"), no: tuple[str, ...] = ("false", "0", "no")) -> Column:
    t = F.lower(F.trim(_c(c)))
    return F.when(t.isin(*yes), True).when(t.isin(*no), False)


def escape(terms_: list[str]) -> list[str]:
    """Plain terms as patterns of whole words."""
    return [rf"\b{re.escape(t)}\b" for t in terms_]
