"""Licence scan by canonical digest: texts are normalised and hash-joined to the digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.licence_texts import DIGESTS, LICENCES

# Spellings taken for equal when licences are compared, the left for the right.
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sublicence": "sublicense",
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

# Phrases taken for equal, replaced in this order.
PHRASES = {
    "copyright holder": "copyright owner",
    "per cent": "percent",
    "sub license": "sublicense",
    "non commercial": "noncommercial",
}

# What a line that only states a copyright looks like, and what stands for a list's mark.
COPYRIGHT_LINE = r"(?m)^[ \t/*#;%!-]*(?:portions )?(?:copyright\b[ \t]*(?:\(c\)|©|&copy;|\d{4}|<year>|\[yyyy\]|\[year\])|\(c\)[ \t]*\d{4}|©[ \t]*\d{4}|all rights reserved\.?[ \t]*$)[^\n]*$"
COMMENT_MARKS = r"(?m)^[ \t]*(?://+|/\*+|\*+/|\*|#+|;+|--|rem\b)"
LIST_MARKS = r"(?m)^[ \t]*(?:\(?(?:\d{1,2}|[a-z]|[ivx]{1,4})[.)]|[-*•])[ \t]+"


def canonical(text: Column) -> Column:
    """A text as licence matching compares it: lower case; comment marks, copyright lines, list marks and punctuation gone;
    equivalent spellings made one; words joined by one space. Null gives an empty string."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, by in ((r"\r\n?", "\n"), (COMMENT_MARKS, ""), (COPYRIGHT_LINE, ""), (LIST_MARKS, ""), (r"[^\p{L}\p{N}]+", " ")):
        out = F.regexp_replace(out, pattern, by)
    same = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    out = F.array_join(F.transform(F.split(F.trim(out), " "), lambda w: F.coalesce(F.try_element_at(same, w), w)), " ")
    for old, new in PHRASES.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def known_digests(spark: SparkSession, licences: dict[str, str] | None = None) -> DataFrame:
    """(canonical_sha256, license_id) of the known licences, one row each: as many as the texts given, not as the documents.

    Without texts these are LICENCES, and DIGESTS for long licences of which only the digest is kept.
    """
    given = LICENCES if licences is None else licences
    table = spark.createDataFrame(sorted(given.items()), "license_id string, text string")
    digests = spark.createDataFrame(sorted(DIGESTS.items() if licences is None else []), "license_id string, canonical_sha256 string")
    of_texts = table.select("license_id", F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("canonical_sha256"))
    return of_texts.unionByName(digests).groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licences: dict[str, str] | None = None) -> DataFrame:
    """Match entire texts to known licences: doc_id, canonical_sha256, canonical_chars and license_id (null if unknown).

    Null and empty texts, and those of which nothing is left, have the digest of the empty string and no licence.
    Of licences with equal canonical texts the first id in order is given. Repeated rows give repeated results, an
    empty table no rows. Other columns are ignored. Only the licences' digests are broadcast.
    """
    text = docs.select("doc_id", canonical(F.col("text")).alias("plain"))
    digest = text.select("doc_id", F.sha2(F.col("plain").cast("binary"), 256).alias("canonical_sha256"), F.length("plain").cast("long").alias("canonical_chars"))
    return digest.join(F.broadcast(known_digests(docs.sparkSession, licences).filter(F.col("canonical_sha256") != F.sha2(F.lit("").cast("binary"), 256))), "canonical_sha256", "left").select("doc_id", "canonical_sha256", "canonical_chars", "license_id")


def op2_licence_digests(spark, sf_dir: str) -> DataFrame:
    """Query: the licence that each whole text of documents is, by canonical digest."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(column: str) -> str:
    out = f"lower(coalesce({column}, ''))"
    for pattern, by in ((r"\r\n?", "\n"), (COMMENT_MARKS, ""), (COPYRIGHT_LINE, ""), (LIST_MARKS, ""), (r"[^\p{L}\p{N}]+", " ")):
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(by)}, 'g')"
    same = "MAP {" + ", ".join(f"{_quoted(a)}: {_quoted(b)}" for a, b in SPELLINGS.items()) + "}"
    out = f"array_to_string(list_transform(string_split(trim({out}), ' '), lambda w: coalesce({same}[w], w)), ' ')"
    for old, new in PHRASES.items():
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return out


def oracle_sql() -> str:
    """The query in SQL."""
    texts = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(LICENCES.items()))
    digests = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(DIGESTS.items()))
    return f"""
WITH known AS (
  SELECT canonical_sha256, min(license_id) AS license_id FROM (
    SELECT license_id, sha256({_canonical_sql("text")}) AS canonical_sha256 FROM (VALUES {texts}) AS t(license_id, text)
    UNION ALL SELECT * FROM (VALUES {digests}) AS d(license_id, canonical_sha256)) GROUP BY 1
), plain AS (SELECT doc_id, {_canonical_sql("text")} AS plain FROM documents)
SELECT doc_id, sha256(plain) AS canonical_sha256, length(plain) AS canonical_chars, license_id
FROM plain LEFT JOIN known ON known.canonical_sha256 = sha256(plain) AND plain <> ''
"""
