"""Registered queries of the training-data operators: opN_<name> and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stockflow.llm.frames import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return deco


@query("op1_ngram_join")
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of 4-word shingle sets at Jaccard >= 0.85."""
    from stockflow.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100).select(
        "doc_id", "n_shingles", "component_id")


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by jump consistent hashing of doc_id."""
    from stockflow.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=40, overhead=16)


@query("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token-id files, read back."""
    from stockflow.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer="word_bpe_49k.json", end_id=1)


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    from stockflow.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer="byte_bpe_50k.json", end_id=1)


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the n-gram likelihood-ratio verdict of all documents."""
    from stockflow.llm.quality import rate_documents

    return rate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce(" + _LOW + r", ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op10_decontamination", oracle=f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s
       FROM (SELECT doc_id, w, m, unnest(generate_series(1, CAST(len(w) - m + 1 AS BIGINT))) AS i FROM d, ms WHERE len(w) >= m)),
hit AS (SELECT DISTINCT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.s = bw.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in all documents."""
    from stockflow.llm.decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10).drop("tkey")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    from stockflow.llm.toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("tkey")


@query("op4_line_dedup")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later repeated runs of lines."""
    from stockflow.llm.line_dedup import line_digest

    return line_digest(table(spark, sf_dir, "documents"))


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 100-byte strings that start earlier somewhere."""
    from stockflow.llm.repeats import repeat_digest

    return repeat_digest(table(spark, sf_dir, "documents"))


def _license_oracle() -> str:
    from stockflow.llm.licenses import oracle_sql

    return oracle_sql()


@query("op2_license_scans", oracle=_license_oracle())
def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences and notices in all documents."""
    from stockflow.llm.licenses import known_licenses, scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"), known_licenses(spark))


@query("op13_phrase_collocations", oracle=f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOW.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
      FROM (SELECT lang, w, m, unnest(generate_series(1, CAST(len(w) - m + 1 AS BIGINT))) AS i
            FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cut AS (SELECT lang, m, phrase, a, w, unnest(generate_series(1, m - 1)) AS k FROM c),
s AS (SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, (CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1:k], ' ')
               JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, array_to_string(w[i : i + n - 1], ' ') AS phrase, max(a) AS longer
        FROM (SELECT lang, w, a, m, n, unnest(generate_series(1, CAST(m - n + 1 AS BIGINT))) AS i FROM c, (SELECT unnest([2, 3]) AS n) WHERE n < m) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN sub USING (lang, phrase) WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a,
       CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000""")
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two to four words of each language."""
    from stockflow.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


@query("op12_personal_data")
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: base spans and the spans that the labelers' model adds."""
    from stockflow.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


#: CRC-32 of a decimal text in SQL: eight shift steps for each byte
_CRC = ("xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({0} AS VARCHAR), ''), "
        "lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), "
        "[CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)")


@query("op11_conversation_trie", oracle=f"""
WITH r AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, turn, sha256(concat(CAST(strlen(role) AS VARCHAR), ':', role, text)) AS id, CAST(strlen(text) AS BIGINT) AS bytes FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos FROM i),
sz AS (SELECT conv_id, count(*) AS own FROM t GROUP BY 1),
pl AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC.format('conv_id')} % 9 AS h FROM sz),
rb AS (SELECT pl.conv_id, t.pos, id, bytes FROM pl JOIN t ON t.conv_id = pl.base WHERE t.pos <= h
       UNION ALL SELECT t.conv_id, t.pos - h + least(h, coalesce(b.own, 0)) AS pos, id, bytes
       FROM t JOIN pl USING (conv_id) LEFT JOIN sz b ON b.conv_id = pl.base WHERE t.pos > h),
pa AS (SELECT conv_id, pos AS depth, bytes, list(id) OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM rb
       UNION ALL SELECT conv_id, 0, 0, [] FROM pl),
en AS (SELECT conv_id, max(depth) AS d FROM pa GROUP BY 1),
nd AS (SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes,
              string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = d) AS ends FROM pa JOIN en USING (conv_id) GROUP BY path),
ch AS (SELECT path[1 : CAST(depth - 1 AS BIGINT)] AS path, count(*) AS c FROM nd WHERE depth > 0 GROUP BY 1),
fl AS (SELECT nd.*, coalesce(c, 0) AS c, path[1 : CAST(depth - 1 AS BIGINT)] AS up FROM nd LEFT JOIN ch USING (path)),
sub AS (SELECT path[1:k] AS path, sum(CASE WHEN c = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * bytes) AS saved
        FROM (SELECT *, unnest(generate_series(0, CAST(depth AS BIGINT))) AS k FROM fl) GROUP BY 1)
SELECT fl.conv_id, CAST(fl.depth AS BIGINT) AS depth, CASE WHEN fl.depth > 0 THEN p.conv_id END AS parent_conv_id, CAST(fl.n AS BIGINT) AS n_convs,
       CAST(fl.c AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(fl.ends, '')) AS ends_sha256
FROM fl JOIN sub USING (path) JOIN nd p ON p.path = fl.up""")
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of the rebuilt conversations, one row per node."""
    from stockflow.llm.prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))
