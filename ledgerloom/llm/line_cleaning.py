"""Line-first cleaning in DataFrame expressions only.

Rules look at one line at a time; lines that fail are removed, and a document that loses
too much of its text is rejected. A document is rejected at once if it has fewer than
``MIN_WORDS`` words, or if over ``MAX_REPEAT_PERCENT`` percent of its words stand in
eight-word windows that occur twice or more in it.

Cases: a null text counts as empty (no words, so rejected); a text without line feeds is
one line; lines without a word are ignored; of equal lines the first is judged by the other
rules and later ones are boilerplate. Rows are independent, so repeated rows, ties and an
empty table need nothing special; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import table

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document that loses a larger share of its word characters is rejected.
MAX_LOST_PERCENT = 30
WINDOW = 8

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
#: A line may have one such mark for every ten characters of its words.
SYMBOL_SHARE = 10
#: Words that end in two or more exclamation or question marks, one for every five words at most.
SHOUT = r"[!?][!?]+([\x20\x09-\x0D]|$)"
SHOUT_SHARE = 5
#: A menu: separators between nearly all words, or one of these in a line of few words.
SEPARATORS = ("|", ">", "»", "·")
NAVIGATION = r"^(home|menu|login|log in|sign in|sign up|next|previous|back to top|share|subscribe|read more|skip to content|contact us|about us)([^a-z]|$)"
NAVIGATION_WORDS = 12
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies",
    "enable javascript", "lorem ipsum", "licensed under", "copyright (c)", "creative commons",
)


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "''") + "'"


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _line_fails(x: str) -> str:
    """SQL: the line ``x`` (l: itself, w: its words, c: their characters) breaks a rule.

    Plain substring tests stand before the patterns, so that patterns run on few lines.
    """
    pairs = " OR ".join(f"contains({x}.l, '{a}{b}')" for a in "!?" for b in "!?")
    marks = " OR ".join(f"contains({x}.l, '{v}')" for v in SEPARATORS)
    phrases = " OR ".join(f"contains(t, '{p}')" for p in BOILERPLATE)
    return f"""(
        regexp_count({x}.l, {_quoted(SYMBOLS)}) * {SYMBOL_SHARE} > length({x}.l)
        OR ({pairs}) AND regexp_count({x}.l, {_quoted(SHOUT)}) * {SHOUT_SHARE} > size({x}.w)
        OR size({x}.w) > 4 AND ({marks}) AND size(filter({x}.w, v -> length(v) = 1 AND v IN ({_listed(SEPARATORS)}))) * 4 > size({x}.w)
        OR size({x}.w) <= {NAVIGATION_WORDS} AND lower({x}.l) rlike {_quoted(NAVIGATION)}
        OR exists(array(lower({x}.l)), t -> {phrases}))"""


def _window_hashes(w: str) -> str:
    """SQL: a hash for each window of eight words, from hashes of two and of four."""
    step = lambda a, k: f"zip_with({a}, slice({a}, {k + 1}, size({a})), (a, b) -> xxhash64(a, b))"
    eight = f"transform(array({step('p', 2)}), q -> slice({step('q', 4)}, 1, size({w}) - {WINDOW - 1}))[0]"
    return f"transform(array({step(w, 1)}), p -> {eight})[0]"


def _repeat_words() -> str:
    """SQL: words covered by windows that occur twice or more, given the array ``w.grams``.

    Windows are sorted with their places, neighbours with equal hashes mark repeats, and
    each marked place covers ``WINDOW`` words or as far as the next marked place.
    """
    marked = """transform(array(sort_array(transform(w.grams, (g, i) -> struct(g AS g, i AS i)))), s ->
        sort_array(filter(transform(s, (x, k) -> IF(get(s, k - 1).g = x.g OR get(s, k + 1).g = x.g, x.i, NULL)), x -> x IS NOT NULL)))[0]"""
    return f"""transform(array({marked}), p -> aggregate(sequence(0, size(p) - 1), 0L,
        (sum, k) -> sum + least({WINDOW}, coalesce(get(p, k + 1) - p[k], {WINDOW}))))[0]"""


def clean_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document its figures, the verdict and ``cleaned``, the text without failed lines."""
    base = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t"))
    line = f"""transform(array(regexp_extract_all(l, {_quoted(WORD)}, 0)), w -> struct(l AS l, w AS w, length(array_join(w, '')) AS c))[0]"""
    split = base.selectExpr(
        key,
        f"CAST(regexp_count(t, {_quoted(SYMBOLS)}) AS BIGINT) AS n_symbols",
        f"filter(transform(split(t, '\\n', -1), l -> {line}), x -> size(x.w) > 0) AS lines",
    )
    figures = split.selectExpr(
        key, "n_symbols",
        f"transform(array(flatten(lines.w)), w -> struct(size(w) AS n, IF(size(w) > {WINDOW}, {_window_hashes('w')}, array()) AS grams))[0] AS w",
        "aggregate(lines.c, 0L, (sum, c) -> sum + c) AS word_chars",
        "size(lines) AS n_lines",
        # array_distinct is fast on strings only, so lines are rebuilt where some are equal
        f"transform(array(array_distinct(lines.l)), o -> IF(size(o) = size(lines), lines, transform(o, l -> {line})))[0] AS once",
    )
    judged = figures.selectExpr(
        key, "CAST(w.n AS BIGINT) AS n_words", "word_chars", "n_symbols",
        "CAST(n_lines - size(once) AS BIGINT) AS n_dup_lines",
        f"CAST(CASE WHEN size(array_distinct(w.grams)) < size(w.grams) THEN {_repeat_words()} ELSE 0 END AS BIGINT) AS n_repeat_words",
        f"filter(once, x -> NOT {_line_fails('x')}) AS good",
    )
    return judged.selectExpr(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed",
        "aggregate(good.c, 0L, (sum, c) -> sum + c) AS kept_chars",
        "good.l AS good",
    ).selectExpr(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        f"NOT base_failed AND 100 * (word_chars - kept_chars) <= {MAX_LOST_PERCENT} * word_chars AS kept",
        "kept_chars", "array_join(good, '\\n') AS cleaned",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents")).drop("cleaned")


def _sql() -> str:
    """DuckDB: the same figures by other means (unnested windows counted per document)."""
    words = f"len(regexp_extract_all(l, '{WORD}'))"
    count = lambda pattern: f"len(regexp_extract_all(l, '{pattern}'))"
    fails = f"""({count(SYMBOLS)} * {SYMBOL_SHARE} > length(l) OR {count(SHOUT)} * {SHOUT_SHARE} > {words}
        OR len(list_filter(regexp_extract_all(l, '{WORD}'), lambda v: v IN ({_listed(SEPARATORS)}))) * 4 > {words} AND {words} > 4
        OR {words} <= {NAVIGATION_WORDS} AND regexp_matches(lower(l), '{NAVIGATION}')
        OR {" OR ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE)})"""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS words FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM w WHERE len(words) >= {WINDOW}),
h AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS s FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM h),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, {WINDOW})) AS k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
lw AS (SELECT doc_id, l, count(*) AS n FROM l WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id, l),
ls AS (SELECT doc_id, sum(n - 1) AS dup, sum(CASE WHEN {fails} THEN 0 ELSE length(regexp_replace(l, '{SPACE}', '', 'g')) END) AS good FROM lw GROUP BY doc_id),
f AS (SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, coalesce(good, 0) AS kept_chars
    FROM w LEFT JOIN ls USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
        AND 100 * (word_chars - kept_chars) <= {MAX_LOST_PERCENT} * word_chars AS kept,
    CAST(kept_chars AS BIGINT) AS kept_chars
FROM f"""


SQL = _sql()
