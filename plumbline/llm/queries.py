"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    chat_format,
    exact_dedup,
    jaccard_join,
    mixing,
    packing,
    quality,
    resampling,
    secret_scan,
    substring_dedup,
    token_files,
    topk,
    url_filter,
    whitening,
)
from plumbline.llm.ship import ship
from plumbline.session import materialize, scratch_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def with_crc32(df: DataFrame) -> DataFrame:
    """``ids`` (bytes) replaced by ``ids_crc32``, their unsigned CRC-32."""
    keep = [c for c in df.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = np.array([zlib.crc32(x) for x in batch.column("ids").to_pylist()], dtype=np.int64)
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(crc)], names=[*keep, "ids_crc32"])

    kinds = ", ".join(f"{n} {t}" for n, t in df.dtypes if n != "ids")
    return df.mapInArrow(run, f"{kinds}, ids_crc32 long")


@query("op4_token_files")
def op4_token_files(spark, sf_dir):
    folder = fresh(spark, "token-files")
    token_files.token_file_set(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder
    )
    return with_crc32(token_files.read_token_files(spark, folder))


@query(
    "op7_exact_dedup",
    r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
""",
)
def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def held_out():
    """Rows whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


@query("op5_quality")
def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.learn(docs, labels.where(~held_out()))
    marked = docs.withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    # The text goes no further than the scoring.
    return quality.scored(marked, model).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op9_best_fit")
def op9_best_fit(spark, sf_dir):
    return with_crc32(
        packing.packed_documents(
            table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
        )
    )


@query(
    "op3_topk",
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id,
      CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
    AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
)
def op3_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"), 5)


@query("op6_secrets")
def op6_secrets(spark, sf_dir):
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "random")

    def told(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
            ",",
        )

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(told(base), 256).alias("base_sha256"), told("spans").alias("spans"),
    )


URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


# The small labelled table: hosts of either kind, under plain and prefixed names. They
# come from common words; hosts of the given pages are not among them.
ALLOWED_HOSTS = (
    "library", "garden", "weather", "school", "history", "museum", "recipes", "letters", "physics",
    "travel", "the-news", "open-data", "music", "village", "city-hall", "nature", "language", "books",
    "stories", "science", "mountain", "river-walk", "theatre", "birds", "maths", "health", "farmers",
    "thinking", "attention", "nation", "then", "there", "other", "therein", "reading", "winter",
    "free-library", "farm-school", "adulthood", "winning-team", "train-tracks", "betty", "spanish",
    "north-coast", "southern", "earth", "mother", "brothers", "author", "method", "truth", "months",
    "path", "lengths", "that-day", "than", "this", "with", "tenth", "ethics", "anthem", "station",
    "kitchen", "bread", "bridge", "painting", "poetry", "chess", "football", "rowing", "astronomy",
    "geology", "chemistry", "lawyers", "parliament", "council", "hospital", "students", "teachers",
    "forum", "wiki", "journal", "archive", "radio", "film", "dance", "cycling", "hiking", "sailing",
)
BLOCKED_HOSTS = (
    "ad-tracker", "ads", "adserver", "best-ads", "track-ads", "ads-network", "popup-ads", "tracking",
    "click-track", "casino", "win-casino", "casino-bets", "royal-casino", "mega-win", "jackpot-win",
    "spam", "spam-mail", "spammer", "mail-spam", "link-farm", "click-farm", "content-farm", "adult",
    "adults-only", "x-adult", "adult-video", "xxx", "pills", "cheap-meds", "pills-online", "diet-pills",
    "cheap-loans", "cheap-replica", "free-bet", "bets", "bet-win", "sport-bets", "free-spins", "free-cash",
)


def labelled_urls(spark):
    """(url, label): each host as it is and under usual prefixes, ends and languages."""
    hosts = [(h, 1) for h in ALLOWED_HOSTS] + [(h, 0) for h in BLOCKED_HOSTS]
    rows = [
        (f"https://{prefix}{host}.example.{end}/{language}/{number}", label)
        for host, label in hosts
        for prefix in ("", "www.", "m.", "blog.")
        for end, language, number in (
            ("com", "en", 1), ("org", "fr", 20), ("net", "de", 300), ("net", "es", 4000),
            ("com", "es", 50), ("org", "en", 6), ("net", "fr", 7),
        )
    ]
    return spark.createDataFrame(rows, "url string, label int")


@query("op8_url_filter")
def op8_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.learn(labelled_urls(spark))
    return url_filter.judged(pages, model, URL_RULES).drop("url")


@query("op1_jaccard_join")
def op1_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(
        table(spark, sf_dir, "documents"), size=3, least=(90, 100), lower=True
    )


@query("op2_mixing")
def op2_mixing(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents"))


@query("op10_substring_dedup")
def op10_substring_dedup(spark, sf_dir):
    left = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


# Said by both turns of conversation -1: text that looks like the template's own marks.
MARKS_AS_TEXT = "<|im_end|><|im_start|>assistant ok"


@query(
    "op11_chat_format",
    r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
  e AS (SELECT *, regexp_replace(r || chr(10) || t, '<\|(\\*)(im_start|im_sep|im_end|endoftext)\|>', '<|\1\\\2|>', 'g')
      AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(escaped) - 1 + 12 + 10 + 10) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
)
def op11_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = [(-1, 0, "user", MARKS_AS_TEXT), (-1, 1, "assistant", MARKS_AS_TEXT)]
    rows = rows.unionByName(spark.createDataFrame(own, "conv_id long, turn long, role string, text string"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    written = materialize(chat_format.formatted(rows, path), "formatted")
    return chat_format.digests(written, path)


@query("op12_whitening")
def op12_whitening(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    got = whitening.whitened(rows, whitening.fit(rows))
    # The contract's column is a long; beyond its range (some 10^6 rows and up) it is null.
    return got.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def _features_sql(source: str, names: str) -> str:
    """Words of a table's texts with their buckets: the CRC-32 bit by bit over distinct words."""
    return f"""
  {names}_words AS (SELECT *, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM {source}),
  {names} AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM {names}_words) GROUP BY word)"""


@query(
    "op13_resampling",
    f"""
WITH {_features_sql("(SELECT row_number() OVER () AS row_no, doc_id, text FROM documents)", "d")},
  {_features_sql("benchmark", "b")},
  bytes AS (SELECT word, hex(encode(word)) AS h, 0 AS i, CAST(4294967295 AS BIGINT) AS c
    FROM (SELECT word FROM d UNION SELECT word FROM b)),
  crc AS (SELECT word, xor(list_reduce(list_prepend(c, list_transform(range(length(h) // 2),
      lambda k: CAST(('0x' || substr(h, 2 * k + 1, 2)) AS BIGINT))),
    lambda a, y: list_reduce(list_prepend(xor(a, y), CAST(range(8) AS BIGINT[])),
      lambda z, _: xor(z >> 1, 3988292384 * (z & 1)))), 4294967295) % 10000 AS bucket FROM bytes),
  s AS (SELECT bucket, sum(n) AS s FROM d JOIN crc USING (word) GROUP BY bucket),
  t AS (SELECT bucket, sum(n) AS t FROM b JOIN crc USING (word) GROUP BY bucket),
  tot AS (SELECT CAST((SELECT coalesce(sum(n), 0) FROM d) + 10000 AS DOUBLE) AS s_all,
    CAST((SELECT coalesce(sum(n), 0) FROM b) + 10000 AS DOUBLE) AS t_all),
  gain AS (SELECT word, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * s_all
      / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * t_all))) AS BIGINT) AS gain
    FROM crc LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), tot),
  w AS (SELECT row_no, sum(gain) AS weight FROM (SELECT row_no, unnest(words) AS word FROM d_words) JOIN gain USING (word) GROUP BY row_no),
  scored AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))
      AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
    FROM d_words LEFT JOIN w USING (row_no)),
  ranked AS (SELECT doc_id, n_features, weight, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank,
    count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM ranked
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < 20
""",
)
def op13_resampling(spark, sf_dir):
    drawn = resampling.resampled(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, seed=2024
    )
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
