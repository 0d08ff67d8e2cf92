"""Line-first cleaning in Spark SQL: rules on each line, then on what is left of the document.

A line is removed when it fails one of three rules:
- punctuation: many symbols (#*$%&|<>) for its words, most words shouted with '!!', or many words and no mark at all;
- navigation: three or more menu separators (|, », ·, › between spaces), or nothing but a link text such as "read more";
- boilerplate: NOTICE_PERCENT of the line or more are sentences with a licence, copyright, cookie or login notice, or the
  line stood in the document before. A notice of any length is found, and one sentence does not condemn a paragraph.
Phrases are in English, German, French and Spanish.
A document is rejected when it fails the base rules, or when less than KEEP_PERCENT of its characters in words remain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
REPEAT_PERCENT = 50
KEEP_PERCENT = 50
SYMBOL_PERCENT = 30
SHOUT_PERCENT = 50
UNMARKED_WORDS = 40
NOTICE_PERCENT = 50

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
SENTENCE_END = r"[.!?]+[\x20\x09-\x0D]+"
#: Fixed phrases, lower case.
BOILERPLATE = (
    r"licensed under |all rights reserved|copyright \(c\)|©|terms of (use|service)|privacy policy|this site uses cookies|"
    r"accept (all )?cookies|enable javascript|sign in to continue|subscribe to our newsletter|"
    r"lizenziert unter |alle rechte vorbehalten|nutzungsbedingungen|datenschutzerklärung|diese (web)?seite verwendet cookies|"
    r"cookies akzeptieren|javascript aktivieren|newsletter abonnieren|"
    r"sous licence |tous droits réservés|conditions d.utilisation|politique de confidentialité|ce site utilise des cookies|"
    r"accepter les cookies|activez javascript|abonnez-vous à notre newsletter|"
    r"bajo licencia |todos los derechos reservados|términos de uso|condiciones de uso|política de privacidad|este sitio (web )?utiliza cookies|"
    r"aceptar (las )?cookies|active javascript|suscríbete a nuestro boletín"
)
NAVIGATION = (
    r"^[\x20\x09-\x0D]*(read more|click here|next page|previous page|back to top|home|share this|print this page|"
    r"weiterlesen|mehr lesen|hier klicken|nächste seite|vorherige seite|nach oben|startseite|seite drucken|"
    r"lire la suite|cliquez ici|page suivante|page précédente|haut de page|accueil|imprimer cette page|"
    r"leer más|haga clic aquí|página siguiente|página anterior|volver arriba|inicio|imprimir esta página)[\x20\x09-\x0D.!]*$"
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def failed_rule(line: Column) -> Column:
    """punctuation, navigation, boilerplate, or null for a line that stays."""
    n = F.regexp_count(line, F.lit(NOT_SPACE + "+"))
    # Cheap tests first: most lines hold none of these characters and hold a mark.
    marked = (
        F.when(F.regexp_count(line, F.lit(r"\x20[|»·›]\x20")) >= 3, "navigation")
        .when(100 * F.regexp_count(line, F.lit(SYMBOLS + "+")) > SYMBOL_PERCENT * n, "punctuation")
        .when(100 * F.regexp_count(line, F.lit(r"!!+(?![^\x20\x09-\x0D])")) > SHOUT_PERCENT * n, "punctuation")
    )
    sentences = F.filter(F.split(F.lower(line), SENTENCE_END), lambda x: x.rlike(BOILERPLATE))
    noticed = F.aggregate(sentences, F.lit(0), lambda n, x: n + F.length(x))
    return F.coalesce(
        F.when(line.rlike(r"[#*$%&|<>»·›]|!!"), marked),
        F.when(~line.rlike(r"[.!?:;,…。！？]"), F.when(n >= UNMARKED_WORDS, "punctuation")),
        F.when(F.lower(line).rlike(NAVIGATION), "navigation"),
        F.when(F.lower(line).rlike(BOILERPLATE), F.when(100 * noticed >= NOTICE_PERCENT * F.length(line), "boilerplate")),
    )


def counted(docs: DataFrame) -> DataFrame:
    """The documents with text, lines (those with a word), and the counts of the base rules; '' stands for null."""
    base = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    base = base.withColumns({
        "_words": words_of(F.col("_text")),
        "_lines": F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(NOT_SPACE)),
    })
    base = base.withColumn("_count", F.size("_words"))
    base = base.withColumn("_hashes", F.when(F.col("_count") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.arrays_zip(
            F.slice("_words", F.lit(1), F.greatest(F.col("_count") - 2, F.lit(0))).alias("a"),
            F.slice("_words", F.lit(2), F.greatest(F.col("_count") - 2, F.lit(0))).alias("b"),
            F.slice("_words", F.lit(3), F.greatest(F.col("_count") - 2, F.lit(0))).alias("c"),
        ),
        lambda z: F.xxhash64(z),
    )))
    # Windows side by side in hash order: equal neighbours are repeats. Only documents with a repeat are sorted.
    base = base.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ))
    base = base.withColumn("_starts", F.sort_array(F.transform(
        F.filter(
            F.arrays_zip(
                F.col("_sorted").alias("at"),
                F.slice(F.concat(F.array(F.lit(None)), F.col("_sorted.h")), F.lit(1), F.size("_sorted")).alias("before"),
                F.slice(F.concat(F.col("_sorted.h"), F.array(F.lit(None))), F.lit(2), F.size("_sorted")).alias("after"),
            ),
            lambda z: z["at"]["h"].eqNullSafe(z["before"]) | z["at"]["h"].eqNullSafe(z["after"]),
        ),
        lambda z: z["at"]["i"],
    )))
    repeated = F.aggregate(
        F.coalesce("_starts", F.array().cast("array<int>")),
        F.struct(F.lit(0).alias("total"), F.lit(-3).alias("last")),
        lambda acc, x: F.struct((acc["total"] + F.least(F.lit(3), x - acc["last"])).alias("total"), x.alias("last")),
        lambda acc: acc["total"],
    )
    return base.withColumns({
        "n_words": F.col("_count").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("_text", "[^" + SYMBOLS[1:] + "+", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated.cast("long"),
    })


def clean_lines(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Every row of `docs` with doc_id, the counts, base_failed, kept_chars, kept, and cleaned_text.

    Words are runs without ASCII white space, lines end at a line feed. n_repeat_words counts the words that lie in
    any three-word window that occurs at least twice, the first occurrence included. cleaned_text has the lines
    that pass, each distinct line once, without lines that hold no word. Null and empty texts count 0, fail the base rules and
    have the cleaned text ''. Repeated rows come out as often; an empty table gives an empty one. With `carry` the
    column `row` holds the whole row of `docs`.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    base = counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row))
    base = base.withColumn("_kept", F.filter(F.array_distinct("_lines"), lambda x: failed_rule(x).isNull()))
    base = base.withColumn("cleaned_text", F.array_join("_kept", "\n"))
    recounted = F.length(F.array_join(words_of(F.col("cleaned_text")), "")).cast("long")
    base = base.withColumn("kept_chars", F.when(F.size("_kept") == F.size("_lines"), F.col("word_chars")).otherwise(recounted))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    enough = 100 * F.col("kept_chars") >= KEEP_PERCENT * F.col("word_chars")
    return base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        "kept_chars", (~failed & enough).alias("kept"), "cleaned_text", *(["row"] if carry else []),
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of `docs` and the cleaned text.

    A plain filter on the verdict would be pushed below the projections that compute it, and every expression it
    builds on would be repeated in it. Rows that come out of a generator are filtered after it.
    """
    judged = clean_lines(docs, carry=True)
    passed = F.explode_outer(F.when(F.col("kept"), F.array(F.struct("cleaned_text", "row")))).alias("passed")
    kept = judged.select(passed).filter("passed IS NOT NULL")
    return kept.select(*[F.col("passed.cleaned_text" if c == "text" else f"passed.row.`{c}`").alias(c) for c in docs.columns])
