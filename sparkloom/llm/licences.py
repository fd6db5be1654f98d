"""Canonical digest lookup of whole texts against known licences, in DataFrame operations only.

A text's canonical form: lower case; copyright notices dropped; everything but letters and digits as one space; equivalent
spellings made one (licence/license, organisation/organization, ...). Its SHA-256 is joined with the digests of known
licence texts.

A notice is a unit that begins, behind marks, with "copyright", "(c)" or the sign and goes on with a year, another such word
or a placeholder; "the above copyright notice" and "COPYRIGHT HOLDERS BE LIABLE" are none, wherever lines break. What the unit
is depends on how a text is wrapped, so a text has three forms: without its notice lines, without its notice paragraphs
(parted by lines without letters and digits), and with all notices. Known texts are listed under all of theirs; wrapped at
any width, or with a line per paragraph, a text still shares a form with the listed one. All forms of a text without
notices are one. The digests in licence_digests.json were made by `digest_texts` from the licence texts that Linux
distributions and packages ship.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized_broadcast, table

#: Spelling -> the one used, as whole words. Those of British and older English, and, after the matching guidelines of SPDX, http
#: as https; see also PHRASES.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "licencee": "licensee", "licencor": "licensor",
    "sublicence": "sublicense", "sublicences": "sublicenses", "organisation": "organization", "organisations": "organizations", "authorise": "authorize",
    "authorised": "authorized", "recognise": "recognize", "recognised": "recognized", "acknowledgement": "acknowledgment",
    "acknowledgements": "acknowledgments", "judgement": "judgment", "honour": "honor", "honours": "honors", "favour": "favor", "merchantibility": "merchantability",
    "noninfringement": "non infringement", "programme": "program", "programmes": "programs", "whilst": "while", "http": "https", "catalogue": "catalog",
    "initialise": "initialize", "labour": "labor", "analyse": "analyze", "artefact": "artifact", "artefacts": "artifacts", "cancelled": "canceled",
    "fulfil": "fulfill", "utilisation": "utilization", "practise": "practice", "behaviour": "behavior",
}
#: The guidelines take a copyright owner for a copyright holder, and leave this sentence out.
PHRASES = {"copyright owner": "copyright holder", "all rights reserved ": ""}
NOTICE = r"^[^\p{L}\p{N}(©]*(?:copyright[ \t\r\n:,]*(?:\(c\)|©|[0-9]{4}|[<\[{]|by )|(?:\(c\)|©)[ \t\r\n:,]*(?:copyright|[0-9]{4}|[<\[{]))"
#: Texts without any of these have one form.
SIGNS = r"copyright|\(c\)|©"
PARAGRAPH = r"\n[^\p{L}\p{N}]*\n"


def _plain(text: Column) -> Column:
    """Words of a lower-case text in one spelling."""
    words = F.split(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " ")
    spell = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    out = F.array_join(F.transform(words, lambda word: F.coalesce(F.try_element_at(spell, word), word)), " ")
    for phrase, other in PHRASES.items():
        out = F.replace(out, F.lit(phrase), F.lit(other))
    return out


def _without_notices(text: Column, unit: str) -> Column:
    return F.array_join(F.filter(F.split(text, unit), lambda part: ~F.rlike(part, F.lit(NOTICE))), " ")


def canonical_forms(text: Column) -> list[Column]:
    """Of a text without notice lines, without notice paragraphs, and of the whole; the latter two are null if the text has no sign of a notice.
    "" for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    signed = F.rlike(low, F.lit(SIGNS))
    return [_plain(F.when(signed, _without_notices(low, "\n")).otherwise(low)), F.when(signed, _plain(_without_notices(low, PARAGRAPH))), F.when(signed, _plain(low))]


def digest_texts(texts: DataFrame) -> DataFrame:
    """texts(licence, text) -> known digests (licence, digest) of all forms that are not empty; of texts with one digest the smallest name stays."""
    forms = texts.select("licence", F.explode(F.array(*canonical_forms(F.col("text")))).alias("form")).where("form <> ''")
    return forms.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("licence").alias("licence"))


def known_digests(spark: SparkSession) -> DataFrame:
    """The table of this package, a few dozen rows."""
    rows = json.loads((Path(__file__).parent / "licence_digests.json").read_text())
    return spark.createDataFrame(sorted(rows.items()), "digest string, licence string")


def licence_lookup(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> one row per row: doc_id, digest (of the form without notice lines), licence (of the first form that is known, else null).

    Null and empty texts have the digest of the empty form, which no licence has. Texts that repeat, ties and null doc_ids
    are looked up like others, very long texts whole. Other columns are ignored; an empty table gives none.
    known(digest, licence) has each digest once; it is broadcast if it is small, else joined by shuffling the digests.
    """
    rows = docs.select("doc_id", *[F.sha2(form, 256).alias(f"form{k}") for k, form in enumerate(canonical_forms(F.col("text")))])
    table = sized_broadcast(known)
    for k in range(3):
        rows = rows.join(table.select(F.col("digest").alias(f"form{k}"), F.col("licence").alias(f"licence{k}")), f"form{k}", "left")
    return rows.select("doc_id", F.col("form0").alias("digest"), F.coalesce("licence0", "licence1", "licence2").alias("licence"))


def op5_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_lookup(table(spark, sf_dir, "documents"), known_digests(spark))


def op5_sql() -> str:
    spell = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in SPELLINGS.items()) + "}"
    known = json.loads((Path(__file__).parent / "licence_digests.json").read_text())
    values = ", ".join(f"('{d}', '{n}')" for d, n in sorted(known.items()))
    forms = ["CASE WHEN signed THEN {} ELSE low END", "CASE WHEN signed THEN {} END", "CASE WHEN signed THEN low END"]
    parts = ["string_split(low, chr(10))", f"regexp_split_to_array(low, '{PARAGRAPH}')", ""]
    texts = [f.format(f"array_to_string(list_filter({p}, lambda x: NOT regexp_matches(x, '{NOTICE}')), ' ')") for f, p in zip(forms, parts)]
    plain = lambda t: f"trim(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    def spelt(t: str) -> str:
        out = f"array_to_string(list_transform(string_split({t}, ' '), lambda x: coalesce({spell}[x], x)), ' ')"
        for phrase, other in PHRASES.items():
            out = f"replace({out}, '{phrase}', '{other}')"
        return f"sha256({out})"

    return f"""
WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents),
m AS (SELECT *, regexp_matches(low, '{SIGNS}') AS signed FROM d),
p AS (SELECT doc_id, {", ".join(f"{plain(t)} AS p{k}" for k, t in enumerate(texts))} FROM m),
s AS (SELECT doc_id, {", ".join(f"{spelt(f'p{k}')} AS f{k}" for k in range(3))} FROM p),
k(digest, licence) AS (VALUES {values})
SELECT doc_id, f0 AS digest, coalesce(k0.licence, k1.licence, k2.licence) AS licence
FROM s LEFT JOIN k k0 ON f0 = k0.digest LEFT JOIN k k1 ON f1 = k1.digest LEFT JOIN k k2 ON f2 = k2.digest
"""
