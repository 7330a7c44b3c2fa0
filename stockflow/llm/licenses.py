"""License scans by canonical digest lookup.

Every line of a text is brought into a canonical form (lower case, copyright lines and "all rights reserved"
out, equivalent spellings made equal, everything but letters and digits to single spaces); a text's form is
its lines' forms in a row. SHA-256 digests of whole texts and of each line are hash-joined with the digests of
known texts, so both a document that is a licence and a notice inside a document are found. All of it is
column expressions, evaluated once per text; ``oracle_sql`` says the same rules in SQL.

Defined cases: a null or empty text (or one that the rules leave empty) matches nothing; known texts that
agree after the rules must carry one identifier, else the least one counts; repeated rows repeat; an empty
table gives an empty result. The known texts are a parameter (license_id, text). Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockflow.llm.frames import stored
from stockflow.llm.license_texts import TEXTS

#: fixed values: a line that this pattern meets (lower-cased) is a copyright line
COPYRIGHT = r"^[^a-z0-9]*(copyright|©|\(c\))[ \t]*(\(c\)|©|[0-9]{4}|by ).*$"
#: fixed values: literal replacements in order
SPELLINGS = [
    ("all rights reserved", " "), ("©", " copyright "), ("(c)", " copyright "), ("licence", "license"),
    ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-infringement", "noninfringement"),
    ("non-commercial", "noncommercial"), ("acknowledgement", "acknowledgment"), ("http:", "https:"), ("&", " and "),
]
REST = "[^a-z0-9]+"


def canonical_line(line: F.Column) -> F.Column:
    """Canonical form of one line; null where nothing is left."""
    t = F.regexp_replace(F.lower(line), COPYRIGHT, " ")
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.nullif(F.trim(F.regexp_replace(t, REST, " ")), F.lit(""))


def canonical_lines(text: F.Column) -> F.Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical_line), lambda x: x.isNotNull())


def _digest(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(text, 256))


def canonical_sql(text: str) -> str:
    """SQL list of the canonical lines."""
    t = f"regexp_replace(lower(x), '{COPYRIGHT}', ' ')"
    for old, new in SPELLINGS:
        t = f"replace({t}, '{old}', '{new}')"
    t = f"nullif(trim(regexp_replace({t}, '{REST}', ' ', 'g')), '')"
    return f"list_filter(list_transform(string_split(coalesce({text}, ''), chr(10)), lambda x: {t}), lambda y: y IS NOT NULL)"


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXTS, "license_id string, text string")


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, license_id (the whole text is this licence, else null), n_notice_lines and notices (distinct ids of
    licences that a whole line states, sorted and comma-joined; empty if none) of every row."""
    def forms(df: DataFrame, *keep) -> DataFrame:
        lines = df.select(*keep, canonical_lines(F.col("text")).alias("forms"))
        return lines.select(*[c for c in lines.columns if c != "forms"],
                            F.when(F.size("forms") > 0, _digest(F.array_join("forms", " "))).alias("whole"),
                            F.transform("forms", _digest).alias("lines"))

    digests = (forms(known, "license_id").where("whole is not null").groupBy("whole").agg(F.min("license_id").alias("license_id")))
    rows = stored(forms(docs, "doc_id", F.xxhash64("text").alias("tkey")))
    found = (rows.select("doc_id", "tkey", F.explode("lines").alias("line"))
             .join(digests.select(F.col("whole").alias("line"), F.col("license_id").alias("notice")), "line"))
    # repeated rows hold the same lines: their counts are shared out again
    notices = found.groupBy("doc_id", "tkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("notice")).alias("ids"))
    copies = rows.groupBy(F.col("doc_id").alias("d"), F.col("tkey").alias("t")).agg(F.count("*").alias("copies")).where("copies > 1")
    notices = (notices.join(copies, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t")), "left")
               .select(F.col("doc_id").alias("nd"), F.col("tkey").alias("nt"), (F.col("n") / F.coalesce("copies", F.lit(1))).cast("long").alias("n"), "ids"))
    return (rows.select("doc_id", "tkey", "whole").join(digests, "whole", "left")
            .join(notices, F.col("doc_id").eqNullSafe(F.col("nd")) & (F.col("tkey") == F.col("nt")), "left")
            .select("doc_id", "license_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_notice_lines"),
                    F.coalesce(F.array_join("ids", ","), F.lit("")).alias("notices")))


def oracle_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in TEXTS)
    return f"""
WITH known(license_id, text) AS (VALUES {rows}),
digests AS (SELECT sha256(array_to_string(f, ' ')) AS digest, min(license_id) AS license_id
            FROM (SELECT license_id, {canonical_sql('text')} AS f FROM known) WHERE len(f) > 0 GROUP BY 1),
forms AS (SELECT doc_id, {canonical_sql('text')} AS f FROM documents),
lines AS (SELECT doc_id, unnest(f) AS line FROM forms),
notes AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids
          FROM lines JOIN digests ON sha256(line) = digest GROUP BY doc_id)
SELECT d.doc_id, g.license_id, CAST(coalesce(n, 0) AS BIGINT) AS n_notice_lines, coalesce(ids, '') AS notices
FROM forms d LEFT JOIN digests g ON len(d.f) > 0 AND sha256(array_to_string(d.f, ' ')) = g.digest LEFT JOIN notes USING (doc_id)"""
