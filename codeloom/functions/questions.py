"""From a table of questions to their keywords: the steps of ``concepts``, as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import concepts


def subject(task: Column) -> Column:
    for pattern in (concepts.LEADING, concepts.TRAILING, concepts.ARTICLE):
        task = F.regexp_replace(task, "(?i)" + pattern.replace("$", r"\z"), "")
    return F.regexp_replace(task, r"^\s+|\s+\z", "")


def keywords(task: Column) -> Column:
    """The first words of the subject that say something."""
    words = F.split(F.regexp_replace(F.lower(subject(task)), r"[^A-Za-z0-9_\s-]", " "), r"\s+")
    return F.slice(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*sorted(concepts.STOP_WORDS))), 1, concepts.MOST_KEYWORDS)


def _styles(run: Column) -> Column:
    capital = F.transform(run, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    first = F.element_at(run, 1)
    return F.array(F.array_join(run, "_"), F.concat(first, F.array_join(F.slice(capital, 2, 1 << 30), "")), F.array_join(capital, ""), F.array_join(run, "-"))


def compounds(words: Column) -> Column:
    """Identifiers that neighbouring words make, pairs and triples in the order of their first word; all of three or four words last."""
    n = F.size(words)
    of = lambda i: F.transform(F.filter(F.array(F.lit(2), F.lit(3)), lambda k: i + k - 1 <= n), lambda k: F.slice(words, i, k))
    runs = F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(1), n), of)))
    whole = F.when(n.isin(3, 4), F.array(words)).otherwise(F.array().cast("array<array<string>>"))
    made = F.array_distinct(F.flatten(F.transform(F.concat(runs, whole), _styles)))
    return F.coalesce(made, F.array().cast("array<string>"))


def _parts(word: Column) -> Column:
    """Parts of a keyword, which is in lower case."""
    mark = F.when(F.contains(word, F.lit("_")), F.split(word, "_")).otherwise(F.split(word, "-"))
    return F.filter(mark, lambda p: F.length(p) >= concepts.SHORTEST_PART)


def related(spark: SparkSession, groups=concepts.GROUPS) -> DataFrame:
    """(term, k, other): the groups of related terms as a table; as large as the parameter."""
    rows = [(term, k, other) for term, others in concepts.related(groups).items() for k, other in enumerate(others)]
    return spark.createDataFrame(rows, "term string, k int, other string")


def worded(questions: DataFrame) -> DataFrame:
    """(q, words) of questions (q, task)."""
    return questions.select("q", keywords(F.coalesce("task", F.lit(""))).alias("words"))


def asked(questions: DataFrame, groups=concepts.GROUPS) -> DataFrame:
    """(q, kw_pos, keyword, original): what each question (q, task) is searched by; original: it is of the question itself.

    A question without keywords, or null, has no rows. Questions are told by ``q``, which must be unique.
    """
    words = worded(questions)
    each = words.select("q", F.posexplode("words").alias("i", "word"))
    own = each.select("q", "i", F.lit(0).alias("j"), F.col("word").alias("term"))
    parts = each.select("q", "i", F.posexplode(_parts(F.col("word"))).alias("j", "term")).withColumn("j", F.col("j") + 1)
    terms = own.union(parts)
    near = terms.join(related(questions.sparkSession, groups), "term").select("q", F.array(F.lit(1), "i", "j", F.col("k") + 1).alias("turn"), F.col("other").alias("term"))
    themselves = own.select("q", F.array(F.lit(0), "i", F.lit(0), F.lit(0)).alias("turn"), "term").union(parts.select("q", F.array(F.lit(1), "i", "j", F.lit(0)).alias("turn"), "term"))
    # a question has few keywords, each a few related terms
    grown = themselves.union(near).groupBy("q", "term").agg(F.min("turn").alias("turn")).where(F.length("term") >= concepts.SHORTEST_KEYWORD).groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "term"))), lambda s: s["term"]).alias("grown"))
    made = words.withColumn("made", compounds(F.col("words"))).join(grown, "q", "left")
    of = F.transform(F.concat("words", "made"), F.lower)
    listed = made.select("q", of.alias("of"), F.posexplode(F.concat("made", F.coalesce("grown", F.array().cast("array<string>")))).alias("kw_pos", "keyword"))
    return listed.select("q", "kw_pos", "keyword", F.array_contains("of", F.lower("keyword")).alias("original"))
