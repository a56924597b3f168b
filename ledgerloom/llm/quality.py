"""Op 3: line-first quality rules, native columns only.

Every line that has a word is judged by itself: punctuation (it must end like a
sentence, and not be strewn with doubled marks or symbol runs), navigation (mostly
separators) and boilerplate (licence, cookie and account phrases). Failing lines
go; a document is rejected if it fails the base rules or loses too large a share
of its words. There is no shuffle: all is a function of one row, built from array
functions whose cost is O(n log n) in the words of a text; every pattern is matched in
linear time.

The result passes through a generator of one row, which filters cannot be pushed
through: they would be rewritten into the chain of array columns and evaluate it for
every element of its own arrays.

Trigrams are compared by 64-bit hashes within one text only.

Defined cases: a null or wordless text has zeros, fails the base rules (under 50
words) and is not kept; of equal lines the first is no duplicate, whatever their
places; a very long text or line is judged whole, in memory of a small multiple of its
size; a share that equals its limit passes; repeated rows give repeated results; an
empty table gives an empty one; only the id and the text are read, so other columns
cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

# What a sentence ends with, what may follow that, and the patterns of the line rules.
ENDS = (".", "!", "?", ":", ";", "…", "。", "！", "？")
CLOSERS = "\"')]»”’"
DOUBLED_MARKS = ("[!?]{2,}", "[#*$%&|<>=_~]{3,}")
SEPARATORS = r"[|>/\x{00BB}\x{203A}\x{2022}\x{00B7}-]"
# Phrases, in lower case, of boilerplate lines; English, German, French, Spanish.
PHRASES = (
    "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy", "cookie settings", "cookie notice",
    "accept cookies", "accept all cookies", "use of cookies", "sign in to", "sign up for", "sign up to", "log in to", "subscribe to our", "subscribe to the", "enable javascript",
    "click here", "follow us on", "share this", "share on", "back to top", "skip to content", "skip to main content",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren", "newsletter abonnieren", "hier klicken", "folgen sie uns", "zum inhalt springen",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "accepter les cookies", "cliquez ici", "suivez-nous", "abonnez-vous", "retour en haut",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "aceptar cookies", "aceptar las cookies", "haga clic aquí", "síguenos", "suscríbete", "volver arriba",
)

_WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class QualityLimits:
    least_words: int = 50
    most_repeat_percent: int = 50
    most_marks_percent: int = 20
    most_separator_percent: int = 20
    most_lost_percent: int = 40


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_passes(line: Column, low: Column, n: Column, limits: QualityLimits) -> Column:
    """The verdict on a line of n words, low in lower case; lines without a word pass, as they hold no text to lose.

    Phrases are sought as plain strings: several branching patterns in one task slow each other down.
    """
    ends = F.right(F.rtrim(F.rtrim(line, F.lit(_BLANKS)), F.lit(CLOSERS)), F.lit(1)).isin(*ENDS)
    marks = _count(line, DOUBLED_MARKS[0]) + _count(line, DOUBLED_MARKS[1])
    # A word of separators alone; what follows is only looked at, since it may begin the next.
    separators = _count(F.concat(F.lit(" "), line, F.lit(" ")), rf"[\x20\x09-\x0D]{SEPARATORS}++(?=[\x20\x09-\x0D])")
    boilerplate = reduce(or_, [F.contains(low, F.lit(p)) for p in PHRASES])
    return (n == 0) | (ends & (marks * 100 <= n * limits.most_marks_percent) & (separators * 100 <= n * limits.most_separator_percent) & ~boilerplate)


def judge(docs: DataFrame, limits: QualityLimits = QualityLimits(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, clean_text, base counts, n_lines_removed, n_words_lost, base_failed and kept for every row."""
    df = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    counted = F.zip_with(F.split("__t", "\n"), F.split(F.lower("__t"), "\n"), lambda x, y: F.struct(x.alias("line"), y.alias("low"), _count(x, _WORD).alias("n")))
    df = df.withColumns({
        "__w": _words(F.col("__t")),
        "__lines": F.transform(counted, lambda s: F.struct(s["line"].alias("line"), s["n"].alias("n"), line_passes(s["line"], s["low"], s["n"], limits).alias("passes"))),
    })
    n = F.size("__w")
    df = df.withColumn("__h", F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)),
    )).otherwise(F.array().cast("array<bigint>")))
    # Trigrams in order with their places; a place is repeated if a neighbour in that order has its hash.
    df = df.withColumn("__s", F.when(
        F.size(F.array_distinct("__h")) < F.size("__h"),
        F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ))
    df = df.withColumn("__again", F.filter(
        F.transform("__s", lambda s, i: F.when(
            (s["h"] == F.get("__s", i - 1)["h"]) | (s["h"] == F.get("__s", i + 1)["h"]), s["i"])),
        lambda p: p.isNotNull(),
    ))
    df = df.withColumn("__covered", F.flatten(F.transform("__again", lambda p: F.array(p, p + 1, p + 2))))
    full, gone = F.filter("__lines", lambda s: s["n"] > 0)["line"], F.filter("__lines", lambda s: ~s["passes"])
    df = df.select(
        "doc_id",
        F.array_join(F.filter("__lines", lambda s: s["passes"])["line"], "\n").alias("clean_text"),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size(F.array_distinct("__covered")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(gone).cast("long").alias("n_lines_removed"),
        F.aggregate(gone, F.lit(0).cast("long"), lambda a, s: a + s["n"]).alias("n_words_lost"),
    )
    failed = (F.col("n_words") < limits.least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * limits.most_repeat_percent)
    df = df.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("n_words_lost") * 100 <= F.col("n_words") * limits.most_lost_percent)
    )
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("judged")).select("judged.*")


def oracle_sql(limits: QualityLimits = QualityLimits()) -> str:
    """DuckDB SQL for the query's rows."""
    q = lambda p: p.replace("'", "''")
    sp = SPACES
    words = lambda x: f"list_filter(regexp_split_to_array({x}, '{sp}'), lambda w: w <> '')"
    passes = f"""len({words('x')}) = 0 OR (
        regexp_matches(regexp_replace(x, '{sp}$', ''), '[{"".join(ENDS)}][{q(CLOSERS.replace("]", chr(92) + "]"))}]*$')
        AND len(regexp_extract_all(x, '{q("|".join(DOUBLED_MARKS))}')) * 100 <= len({words('x')}) * {limits.most_marks_percent}
        AND len(list_filter({words('x')}, lambda w: regexp_matches(w, '^{SEPARATORS}+$'))) * 100 <= len({words('x')}) * {limits.most_separator_percent}
        AND NOT regexp_matches(lower(x), '{q('|'.join(PHRASES))}'))"""
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {words('t')} AS w, string_split(t, chr(10)) AS lines FROM t),
g AS (
  SELECT *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g,
    list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS full_lines,
    list_filter(lines, lambda x: {passes}) AS kept_lines
  FROM w),
s AS (SELECT *, list_sort(list_transform(g, lambda x, i: {{'h': x, 'i': i}})) AS s FROM g),
a AS (
  SELECT *, list_filter(list_transform(s, lambda x, i:
    CASE WHEN (i > 1 AND s[i - 1].h = x.h) OR (i < len(s) AND s[i + 1].h = x.h) THEN x.i END), lambda p: p IS NOT NULL) AS again
  FROM s),
c AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '{sp}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(len(list_distinct(flatten(list_transform(again, lambda p: [p, p + 1, p + 2])))), 0) AS BIGINT) AS n_repeat_words,
    CAST(len(lines) - len(kept_lines) AS BIGINT) AS n_lines_removed,
    CAST(len(w) - len({words("array_to_string(kept_lines, chr(10))")}) AS BIGINT) AS n_words_lost
  FROM a),
b AS (SELECT *, n_words < {limits.least_words} OR n_repeat_words * 100 > n_words * {limits.most_repeat_percent} AS base_failed FROM c)
SELECT *, NOT base_failed AND n_words_lost * 100 <= n_words * {limits.most_lost_percent} AS kept FROM b
"""
