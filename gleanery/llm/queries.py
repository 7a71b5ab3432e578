"""The registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import (
    collocations,
    fingerprint,
    licences,
    mixing,
    neighbours,
    packing,
    pii,
    repeats,
    sharding,
    simhash,
    toxicity,
    url_filter,
    whitening,
)

REPEATS_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT r, x, unnest(range(0, greatest(0, length(x) // 2 - 399), 300)) AS s FROM d),
c AS (SELECT r, s, substr(x, CAST(2 * s + 1 AS BIGINT), 1398) AS y FROM b),
w AS (SELECT r, s, y, unnest(range(0, least(300, length(y) // 2 - 399))) AS i FROM c),
h AS (SELECT r, s + i AS p, md5(substr(y, CAST(2 * i + 1 AS BIGINT), 800)) AS k FROM w),
many AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
starts AS (SELECT r, p FROM h WHERE k IN (SELECT k FROM many)),
gaps AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 400 THEN 0 ELSE 1 END AS fresh FROM starts),
runs AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS n FROM gaps),
spans AS (SELECT r, min(p) AS a, max(p) + 400 AS b FROM runs GROUP BY r, n),
cuts AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS z FROM spans),
kept AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
    string_agg(substr(x, CAST(2 * z + 1 AS BIGINT), CAST(2 * (a - z) AS BIGINT)), '' ORDER BY a) AS head
  FROM cuts JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

COLLOCATIONS_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
s AS (SELECT lang, ws, unnest([1, 2, 3]) AS k FROM w),
g AS (SELECT lang, ws, k, unnest(range(1, greatest(1, len(ws) - k + 2))) AS i FROM s),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
x AS (SELECT lang, k, phrase, a, ws, unnest(range(1, k)) AS cut FROM c),
y AS (
  SELECT x.lang, x.k, x.phrase, x.a, x.cut, b.f AS l, e.f AS r,
    (1000000::HUGEINT * x.a * x.a) // (b.f::HUGEINT * e.f) AS score
  FROM x JOIN f b ON b.lang = x.lang AND b.phrase = array_to_string(x.ws[1:x.cut], ' ')
  JOIN f e ON e.lang = x.lang AND e.phrase = array_to_string(x.ws[x.cut + 1:], ' ')),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
longer AS (SELECT lang, phrase, max(a) AS m FROM inner_parts GROUP BY ALL),
kept AS (
  SELECT z.* FROM z LEFT JOIN longer USING (lang, phrase)
  WHERE NOT (z.k = 2 AND coalesce(100 * longer.m >= 50 * z.a, false))),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
  CAST(r AS BIGINT) AS r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Only what SQL can express: the other operators are models, fingerprints, tokens and seeded draws.
ORACLES: dict[str, str] = {"op9_repeats": REPEATS_SQL, "op12_collocations": COLLOCATIONS_SQL}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_documents(docs, labels)


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixing.taken_words(mixture)


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(table(spark, sf_dir, "documents"))


@query
def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query
def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``; ``grown_shard`` belongs to another law and is null."""
    placed = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op13_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's digest; the spans themselves are a column of the operator."""
    return licences.scan(table(spark, sf_dir, "documents")).drop("spans")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
