"""Line-first cleaning, in DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are
removed; a text that loses too much of its words is rejected. Statistics of the whole text
(symbols, repeated lines, words in repeated windows) reject besides.

The rules of a line: its words outnumber HEADING_WORDS and it has no mark at its end, or symbols
abound; it is cut up by bars; or it is short (of BOILERPLATE_WORDS at most) and holds a phrase of page furniture.
Blanks at a line's end (the six of ASCII, so a carriage return too) don't count; other characters there, such as
a line separator of Unicode, are no mark.

Defined results: null text counts as empty (no words, so it fails); blank lines are neither judged
nor counted; texts of any length are worked on whole; equal rows have equal results, null and
repeated keys are kept as any others; an empty table gives an empty result; columns may have any
names; a text on the border of losing too much is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .frames import place, restore, take

#: Fixed values of the rules.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
TERMINAL = r"[.!?:;…。！？][\"'”’»)\]]*[ \t-\r]*\z"
#: Lines of at most this many words may be headings, and need no terminal mark.
HEADING_WORDS = 8
#: Phrases of pages around texts, in English, German, French and Spanish; a dot stands for a letter with a mark.
_PHRASES = """
lorem ipsum|all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings|consent)|we use cookies
enable javascript|javascript is (disabled|required)|click here|read more|sign up for our|subscribe to our
share this (page|article|post)|powered by|back to top|skip to (main )?content
alle rechte vorbehalten|allgemeine gesch.ftsbedingungen|datenschutz(erkl.rung|richtlinie|hinweise)|cookie-?einstellungen
hier klicken|weiterlesen|newsletter abonnieren|nach oben scrollen|zum inhalt springen|bitte javascript aktivieren
tous droits r.serv.s|conditions (g.n.rales|d.utilisation)|(accepter|g.rer) les cookies|cliquez ici|lire la suite
abonnez-vous|retour en haut|aller au contenu|partager cet article|politique de cookies
todos los derechos reservados|t.rminos (de uso|y condiciones)|pol.tica de (privacidad|cookies)|leer m.s sobre
suscr.base a|volver arriba|saltar al contenido|compartir (este|esta)
""".strip().replace("\n", "|")
#: Those that end in a letter with a mark, after which engines see no common word border.
_OPEN_PHRASES = "politique de confidentialit.|haga clic aqu."
BOILERPLATE = rf"(?i)\b({_PHRASES})\b|\b({_OPEN_PHRASES})"
#: Longer lines that hold such a phrase are taken for prose that mentions it.
BOILERPLATE_WORDS = 40
WINDOW = 8


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[ \t-\r]+"), "")


def _windows(words: Column, name) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    return F.transform(starts, lambda i: name(F.slice(words, i, F.lit(WINDOW))))


def _covered(starts: Column) -> Column:
    """Words in the union of windows that start at ``starts`` (ascending)."""
    steps = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda a, b: a + b)


def _repeated(names: Column) -> Column:
    """Positions of the names that occur more than once, ascending."""
    ordered = F.array_sort(F.transform(names, lambda v, k: F.struct(v.alias("v"), k.alias("k"))))
    return let(ordered, lambda o: F.array_sort(F.transform(F.filter(o, lambda s, k: (s["v"] == F.get(o, k - 1)["v"]) | (s["v"] == F.get(o, k + 1)["v"])), lambda s: s["k"])))


def repeat_words(words: Column) -> Column:
    """Words in windows found twice or more. Hashes tell quickly that there are none; else windows are compared as text."""
    exact = let(_repeated(_windows(words, lambda w: F.array_join(w, " "))), lambda p: F.when(F.size(p) > 0, _covered(p)).otherwise(0))
    maybe = let(_windows(words, F.xxhash64), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(F.when(maybe, exact).otherwise(0))


def line_fails(line: Column) -> Column:
    """Whether a line with a word fails a rule."""
    count = F.length(F.regexp_replace(line, r"[^ \t-\r]+[ \t-\r]*", "w")) - F.when(line.rlike(r"^[ \t-\r]"), 1).otherwise(0)
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    bars = F.length(line) - F.length(F.translate(line, "|•»›", ""))

    def judge(n: Column) -> Column:
        punctuation = ((n > HEADING_WORDS) & ~line.rlike(TERMINAL)) | (symbols * 2 > n)
        navigation = (bars >= 2) & (bars * 4 > n)
        return punctuation | navigation | ((n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE))

    return let(count, judge)


def assess(text: Column, most_lost: float = 0.5) -> Column:
    """A struct of all statistics, the cleaned text and the verdict."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    judged = F.transform(lines, lambda x: F.struct(x.alias("line"), line_fails(x).alias("fails")))

    def whole(words: Column) -> Column:
        n = F.size(words)
        return F.struct(n.cast("long").alias("n_words"), repeat_words(words).cast("long").alias("n_repeat_words"))

    def of_lines(found: Column) -> Column:
        own = F.transform(found, lambda s: s["line"])
        good = F.transform(F.filter(found, lambda s: ~s["fails"]), lambda s: s["line"])
        return F.struct((F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines"), (F.size(own) - F.size(good)).cast("long").alias("n_failed_lines"), F.array_join(good, "\n").alias("cleaned"))

    chars = F.length(F.translate(text, BLANKS, "")).cast("long")
    symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")
    return F.struct(chars.alias("word_chars"), symbols.alias("n_symbols"), let(split_words(text), whole).alias("words"), let(judged, of_lines).alias("lines"))


def _verdict(df: DataFrame, most_lost: float) -> DataFrame:
    base = (F.col("a.words.n_words") < 20) | (F.col("a.words.n_repeat_words") * 100 > F.col("a.words.n_words") * 30)
    left = F.length(F.translate("a.lines.cleaned", BLANKS, ""))
    return df.withColumn("base_failed", base).withColumn("kept", ~base & (left >= (1 - most_lost) * F.col("a.word_chars")))


def report(docs: DataFrame, most_lost: float = 0.5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Statistics and verdict of each row."""
    made = _verdict(take(docs, key=key, text=text).select("key", assess(F.col("text")).alias("a")), most_lost)
    return made.select(F.col("key").alias(key), "a.words.n_words", "a.word_chars", "a.n_symbols", "a.lines.n_dup_lines", "a.words.n_repeat_words", "base_failed", "kept", "a.lines.n_failed_lines")


def clean(docs: DataFrame, most_lost: float = 0.5, text: str = "text") -> DataFrame:
    """The kept rows of ``docs``, without failing and blank lines; other columns stay."""
    names = docs.columns
    made = _verdict(take(docs, row="row", apart=text, text=text).select("row", assess(F.col("text")).alias("a")), most_lost).where("kept")
    return restore(made, "row", names, {place(names, text): F.col("a.lines.cleaned")})


#: The report as DuckDB SQL.
REPORT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), g AS (
  SELECT *, len(words) AS n,
         CASE WHEN len(words) >= 8 THEN list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i+7], ' ')) ELSE [] END AS grams
  FROM w
), u AS (
  SELECT doc_id, unnest(range(1, len(grams) + 1)) AS i, unnest(grams) AS gram FROM g
), p AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM u) WHERE c > 1
), r AS (
  SELECT doc_id, sum(least(8, coalesce(j - i, 8))) AS covered FROM p GROUP BY doc_id
), s AS (
  SELECT doc_id, t, n, lines, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(covered, 0) AS n_repeat_words,
         list_filter(lines, lambda x: NOT (
              (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) > 8 AND NOT regexp_matches(x, '[.!?:;…。！？]["''”’»)\]]*[ \x09-\x0D]*\z'))
           OR 2 * (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
           OR (length(x) - length(regexp_replace(x, '[|•»›]', '', 'g')) >= 2
               AND 4 * (length(x) - length(regexp_replace(x, '[|•»›]', '', 'g'))) > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
           OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) <= 40 AND regexp_matches(x, '__BOILERPLATE__')))) AS good
  FROM g LEFT JOIN r USING (doc_id)
), v AS (
  SELECT *, n < 20 OR 100 * n_repeat_words > 30 * n AS base_failed FROM s
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND length(regexp_replace(array_to_string(good, chr(10)), '[\x20\x09-\x0D]', '', 'g')) >= 0.5 * word_chars AS kept,
       CAST(len(lines) - len(good) AS BIGINT) AS n_failed_lines
FROM v
""".replace("__BOILERPLATE__", BOILERPLATE)
