"""One query per operator over whole tables, with the SQL beside it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boostlab.llm import (
    bpe,
    chat,
    decontamination,
    exact_dedup,
    hard_negatives,
    licenses,
    near_dedup,
    packing,
    repeats,
    revisits,
    runs,
    token_counts,
    toxicity,
)
from boostlab.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def enter(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return enter


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"),
        tokenizer_file("byte_bpe_50k.tiktoken"))


@query("op2_repeated_strings")
def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


@query("op3_near_duplicates")
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH cut AS (
  SELECT page_id, html, md5(url) AS mark,
         regexp_replace(regexp_replace(trim(url, ' '), '#.*$', ''),
                        '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages),
parts AS (
  SELECT page_id, html, mark,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)),
                                  '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort([p FOR p IN string_split(regexp_extract(bare, '\?(.*)$', 1), '&')
      IF p <> '' AND NOT regexp_matches(
        p, '^(?:utm_[^=&]*|ref|fbclid|gclid|sessionid)(=|$)')]) AS kept
  FROM cut),
keyed AS (
  SELECT page_id, html, mark, md5(html) AS tag,
    host || path || CASE WHEN len(kept) > 0 THEN '?' ELSE '' END
      || coalesce(array_to_string(kept, '&'), '') AS url_key
  FROM parts),
met AS (
  SELECT r.page_id AS n, r.url_key, r.tag, r.mark,
         max(f.page_id) AS m
  FROM keyed r LEFT JOIN keyed f
    ON f.url_key = r.url_key AND f.page_id < r.page_id + 120
  GROUP BY ALL),
judged AS (
  SELECT met.*, f.html AS body,
    CASE WHEN m IS NULL THEN 'missing'
         WHEN n % 11 = 0 THEN 'unverified'
         WHEN n % 7 = 0 THEN CASE WHEN f.mark = met.mark THEN 'resolved' ELSE 'mismatch' END
         WHEN n % 5 = 0 THEN 'mismatch'
         WHEN f.tag = met.tag THEN 'resolved' ELSE 'mismatch' END AS state
  FROM met LEFT JOIN keyed f ON f.page_id = met.m)
SELECT 2 * n + 1 AS record_id, url_key, 2 * m AS response_id, state,
  CASE WHEN state = 'resolved' THEN sha256(body) END AS body_sha256,
  CASE WHEN n % 11 = 0 OR n % 7 = 0 THEN
         CASE WHEN state = 'resolved' THEN 'no-cache' END
       WHEN n % 5 = 0 THEN NULL
       ELSE 'max-age=60' END AS cache_control,
  CASE WHEN state = 'resolved' THEN 'text/html'
       WHEN n % 11 <> 0 AND (n % 7 = 0 OR n % 5 = 0) THEN NULL
       ELSE 'text/plain' END AS content_type
FROM judged
"""


@query("op4_revisits", OP4_SQL)
def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.records_of_pages(table(spark, sf_dir, "pages")))
    return found.select(
        "record_id", "url_key", "response_id", "state",
        F.sha2("body", 256).alias("body_sha256"),
        F.col("headers")["cache-control"].alias("cache_control"),
        F.col("headers")["content-type"].alias("content_type"))


OP5_SQL = """
WITH rows AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM rows WINDOW w AS (PARTITION BY norm)
"""


@query("op5_exact_duplicates", OP5_SQL)
def op5_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedupe(table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


@query("op7_licenses")
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


OP8_EXTRA = ("(-1L, 0L, 'user', '</s>[INST] ok [/INST]'), "
             "(-1L, 1L, 'assistant', '</s>[INST] ok [/INST]')")
_ESCAPED = ("replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '<s>', '<\\s>'), "
            "'</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')")
OP8_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ''
                        ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    CAST(sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + 20) AS BIGINT)
      AS formatted_chars,
    count(*) FILTER (role = 'assistant') AS n_examples
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars, n_examples
FROM joined
"""


@query("op8_chat", OP8_SQL)
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql(f"SELECT * FROM VALUES {OP8_EXTRA} AS t(conv_id, turn, role, text)")
    turns = chat.format_turns(rows.unionByName(planted))
    return chat.read_back(turns, chat.examples(turns))


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


_WORDS = r"""
  SELECT {0} AS id, [w FOR w IN string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF w <> ''] AS words FROM {1}"""
OP10_SQL = f"""
WITH items AS ({_WORDS.format("coalesce(CAST(item_id AS VARCHAR), '')", 'benchmark')}),
docs AS ({_WORDS.format('doc_id', 'documents')}),
wanted AS (
  SELECT DISTINCT id AS item, least(10, len(words)) AS size,
    array_to_string(words[p:p + least(10, len(words)) - 1], ' ') AS gram
  FROM items, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS t(p)
  WHERE len(words) > 0),
sizes AS (SELECT DISTINCT size FROM wanted),
grams AS (
  SELECT id, p, size, array_to_string(words[p:p + size - 1], ' ') AS gram
  FROM docs, sizes, unnest(range(1, len(words) - size + 2)) AS t(p)
  WHERE len(words) >= size),
hits AS (SELECT id, p, size, item FROM grams JOIN wanted USING (size, gram)),
hit_words AS (
  SELECT id, count(DISTINCT place) AS n_hit
  FROM hits, unnest(range(p, p + size)) AS t(place) GROUP BY id),
hit_items AS (
  SELECT id, count(DISTINCT item) AS n_items,
         string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY id)
SELECT id AS doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit_words USING (id) LEFT JOIN hit_items USING (id)
"""


@query("op10_decontamination", OP10_SQL)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where a tenth of the texts (by a hash of the id) repeats a stretch of
    its own words from some word on."""
    hashed = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g, n = F.expr("hashed div 10"), F.size("words").cast("long")
    a = g % n
    period = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))

    def word(i):
        return F.get("words", F.when(i < F.col("a"), i).otherwise(
            F.col("a") + (i - F.col("a")) % F.col("period")).cast("int"))

    some = (F.col("hashed") % 10 == 0) & F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", "text").withColumn("hashed", hashed)
    planted = (
        rows.filter(some).withColumn("words", words)
        .withColumns({"a": a, "period": period})
        .select("doc_id", F.array_join(
            F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ").alias("text"))
    )
    return rows.filter(~F.coalesce(some, F.lit(False))).select("doc_id", "text").unionByName(
        planted)


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents")))

    def later(x, y):  # the smaller exponent, or of equal ones the later start, longer period
        one, other = x["length"] * y["period"], y["length"] * x["period"]
        return (F.when(one > other, -1).when(one < other, 1)
                .when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1)
                .when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1)
                .otherwise(0))

    best = F.get(F.array_sort("runs", later), 0)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
        r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_bpe")
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_50k.json")
    read = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return read.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


OP13_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS same,
         CAST(list_sum([a.c[i] * r.c[i] FOR i IN range(1, len(a.c) + 1)]) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
ranked AS (
  SELECT p.*, n.other AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
                            ORDER BY n.score DESC, n.other) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score,
       negative_score
FROM ranked WHERE rank <= 3
"""


@query("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(rows)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
