"""Line-first quality cleaning, in DataFrame functions only.

Every line is judged by a punctuation, a navigation and a boilerplate rule; lines that fail are
removed, and a document that loses more than ``max_loss`` of its words that way is rejected, as is
one that fails the base rules (too few words, or too many words in repeated five-word windows).

Defined results: a null text counts as empty, an empty text has no words and fails the base rules,
blank lines are neither judged nor lost, repeated rows are judged each by itself. Row-local: no
shuffle, nothing broadcast. ``measured`` adds columns beside the input's, in place of those of the same
name; ``clean`` returns the input's columns alone, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumix.llm import _common

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: A line ends as prose does: a mark, then closing quotes or brackets.
TERMINAL = r"""[.!?:;…。！？]["')\]»”’]*[\x20\x09-\x0D]*$"""
#: Marks that stand alone between the entries of a menu.
SEPARATOR = r"(^|[\x20\x09-\x0D])([|•·»›>]|::)"
DOUBLED = r"[!?]{2,}"
# Phrases of page furniture, in lower case: English, German, French, Spanish.
BOILERPLATE = (
    "accept cookies",
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "follow us on",
    "forgot password",
    "javascript is disabled",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "sign in",
    "sign up",
    "skip to content",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
    "alle rechte vorbehalten",
    "cookies akzeptieren",
    "hier klicken",
    "newsletter abonnieren",
    "passwort vergessen",
    "zum inhalt springen",
    "accepter les cookies",
    "aller au contenu",
    "cliquez ici",
    "conditions d'utilisation",
    "lire la suite",
    "mot de passe oublié",
    "politique de confidentialité",
    "tous droits réservés",
    "aceptar cookies",
    "haga clic aquí",
    "leer más",
    "olvidé mi contraseña",
    "política de privacidad",
    "saltar al contenido",
    "todos los derechos reservados",
    "términos de uso",
)

#: Shares of a line's words. A short line is held to end as prose does, a longer one isn't.
SHORT_WORDS, MAX_SEPARATORS, MAX_SYMBOLS, MAX_DOUBLED = 5, 0.2, 0.5, 0.3
#: A boilerplate phrase, whole words, condemns a line of which it is such a share of words at least.
MIN_BOILERPLATE = 0.5
MIN_WORDS, MAX_REPEATED, MAX_LOSS = 10, 20, 0.5
WINDOW = 5


def phrases(longest: int) -> str:
    """The pattern of phrases that are share enough of a line of ``longest`` words."""
    own = [p.replace("'", "['’]") for p in BOILERPLATE if len(p.split()) >= MIN_BOILERPLATE * longest]
    return rf"(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(own)})(?:$|[^\p{{L}}\p{{N}}])"


#: The most words that a line with some phrase may have, by the words of the longest phrases.
REACHES = sorted({int(len(p.split()) / MIN_BOILERPLATE) for p in BOILERPLATE})


def words(text: Column) -> Column:
    """The words of a text, split at the six ASCII white-space characters."""
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def counted(line: Column) -> Column:
    """A line with its number of words."""
    return F.struct(line.alias("line"), F.size(words(line)).alias("n"))


def judged(x: Column) -> Column:
    """(line, words, punctuation fails, navigation fails, boilerplate fails) of a counted line."""
    line, n = x["line"], x["n"]
    low, after = F.lower(line), [0, *REACHES]
    furniture = F.lit(False)
    for most, least in zip(REACHES, after, strict=False):
        furniture = F.when((n > least) & (n <= most), low.rlike(phrases(most))).otherwise(furniture)
    symbols, doubled = F.regexp_count(line, F.lit(SYMBOL)), F.regexp_count(line, F.lit(DOUBLED))
    return F.struct(
        line.alias("line"),
        n.alias("n"),
        ((n < SHORT_WORDS) & ~line.rlike(TERMINAL) | (symbols > MAX_SYMBOLS * n) | (doubled > MAX_DOUBLED * n)).alias("punctuation"),
        (F.regexp_count(line, F.lit(SEPARATOR)) > MAX_SEPARATORS * n).alias("navigation"),
        furniture.alias("boilerplate"),
    )


def windows(hashes: str) -> Column:
    """The hash of each five-word window, from a column (not an expression: each window reads it) of word hashes."""
    starts = F.when(F.size(hashes) >= WINDOW, F.sequence(F.lit(0), F.size(hashes) - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the base measures, the line verdicts (``_lines``) and both decisions."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = df.withColumn("_words", words(t)).withColumn("_lines", F.transform(F.filter(F.transform(F.split(t, "\n"), counted), lambda x: x["n"] > 0), judged))
    out = out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    out = out.withColumn("_windows", windows("_hashes"))
    # Sorted with their places, equal windows are neighbours. Most texts have none and skip this.
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_placed", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed))
    twice = F.filter("_placed", lambda x, k: (x["h"] == F.get("_placed", k - 1)["h"]) | (x["h"] == F.get("_placed", k + 1)["h"]))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    step = F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(starts, step, lambda a, i: F.struct((a["total"] + F.least(F.lit(WINDOW), i - a["last"])).alias("total"), i.alias("last")), lambda a: a["total"])
    shown = F.transform("_lines", lambda x: x["line"])
    good = F.filter("_lines", lambda x: ~(x["punctuation"] | x["navigation"] | x["boilerplate"]))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(SYMBOL)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct(shown))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "_good": good,
        }
    )
    out = out.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
            "kept_words": F.aggregate("_good", F.lit(0).cast("long"), lambda a, x: a + x["n"]),
            "n_failed_lines": (F.size("_lines") - F.size("_good")).cast("long"),
        }
    )
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("kept_words") <= MAX_LOSS * F.col("n_words")))
    return _common.fenced(out)  # a condition on the measures would compute them again, one inside the other


def clean(df: DataFrame, text: str = "text") -> DataFrame:
    """Documents that pass, without their failing lines and with their blank ones; the columns of ``df``, whatever they are called.

    ``n_chars`` follows the text where ``df`` has it.
    """
    own = df.select(_common.without_text(df, text), F.col(f"`{text}`").alias("text"))
    passes = lambda x: ~(x["punctuation"] | x["navigation"] | x["boilerplate"])
    every = F.transform(F.split(F.col("text").cast("string"), "\n"), counted)
    left = F.transform(F.filter(every, lambda x: (x["n"] == 0) | passes(judged(x))), lambda x: x["line"])
    out = measured(own).where("kept").withColumn("text", F.when(F.col("n_failed_lines") == 0, F.col("text")).otherwise(F.array_join(left, "\n")))
    return out.select(*_common.with_text(df, text, F.col("n_failed_lines") > 0))


def op4_line_quality(spark, sf_dir: str) -> DataFrame:
    """Measures and verdicts for every document."""
    docs = _common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return measured(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words", "n_failed_lines")


_FURNITURE = " ".join(f"WHEN n <= {most} THEN regexp_matches(lower(line), '{phrases(most)}')".replace("['’]", "[''’]") for most in REACHES)
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{WORD}') AS w FROM d),
win AS (SELECT r, unnest(range(len(w) - {WINDOW - 1})) AS i, w FROM w WHERE len(w) >= {WINDOW}),
keyed AS (SELECT r, i, array_to_string(w[i + 1:i + {WINDOW}], ' ') AS k FROM win),
twice AS (SELECT r, i FROM keyed QUALIFY count(*) OVER (PARTITION BY r, k) >= 2),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT r, line, len(regexp_extract_all(line, '{WORD}')) AS n FROM l),
v AS (SELECT r, line, n,
  n < {SHORT_WORDS} AND NOT regexp_matches(line, '{TERMINAL.replace("'", "''")}')
  OR len(regexp_extract_all(line, '{SYMBOL}')) > {MAX_SYMBOLS} * n OR len(regexp_extract_all(line, '{DOUBLED}')) > {MAX_DOUBLED} * n
  OR len(regexp_extract_all(line, '{SEPARATOR}')) > {MAX_SEPARATORS} * n
  OR CASE {_FURNITURE} ELSE false END AS bad
  FROM m WHERE n > 0),
g AS (SELECT r, count(*) - count(DISTINCT line) AS dup, coalesce(sum(n) FILTER (NOT bad), 0) AS kept_words, count(*) FILTER (bad) AS failed FROM v GROUP BY r),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '{SYMBOL}')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(kept_words, 0) AS BIGINT) AS kept_words, CAST(coalesce(failed, 0) AS BIGINT) AS n_failed_lines
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN g USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND n_words - kept_words <= {MAX_LOSS} * n_words AS kept FROM f
"""
