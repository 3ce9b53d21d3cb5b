"""The registered query of each operator, with DuckDB SQL where that can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import (
    bpe, exact_dedup, filter_audit, fingerprints, jaccard, language, line_dedup, mixing, outliers, pii, resampling, secrets, token_files,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


@query("""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)
""")
def op3_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    groups = exact_dedup.duplicate_groups(documents(spark, sf))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query(r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || doc_id) AS shuffled
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS w
  FROM sized GROUP BY source
), levels AS (
  SELECT *, row_number() OVER r AS n,
         sum(source_size) OVER () * 150 - coalesce(sum(source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 200 AS l,
         sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM sources WINDOW r AS (ORDER BY source_size / w, source NULLS LAST)
), first AS (
  SELECT n AS n1, l AS l1, w_left AS w1 FROM levels WHERE l * w <= source_size * 200 * w_left ORDER BY n LIMIT 1
), aims AS (
  SELECT source, source_size,
         CASE WHEN n >= n1 THEN (w * l1)::DOUBLE / (w1 * 100)::DOUBLE ELSE (2 * source_size)::DOUBLE END AS target
  FROM levels LEFT JOIN first ON true
), rounds AS (
  SELECT s.*, a.source_size, a.target, i AS round,
         coalesce((sum(size) OVER (PARTITION BY s.source, i ORDER BY shuffled, doc_id) + i * a.source_size)::DOUBLE
                  / nullif(a.target, 0), 0) AS finish
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source, range(2) t(i)
), used AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, round, shuffled, doc_id ROWS UNBOUNDED PRECEDING) AS used
  FROM rounds
)
SELECT doc_id, size, source_size, target,
       sum(CASE WHEN used <= (SELECT sum(target::DECIMAL(38, 6))::DOUBLE FROM aims) THEN size ELSE 0 END)::BIGINT AS taken
FROM used GROUP BY ALL
""")
def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixing.mix(documents(spark, sf)).select("doc_id", "size", "source_size", "target", taken)


@query(r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split
), judged AS (
  SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS lost FROM keyed
)
SELECT doc_id, count(*) AS n_lines, sum(lost::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""")
def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op1_bpe(spark: SparkSession, sf: str) -> DataFrame:
    both = bpe.encode_and_decode(documents(spark, sf))
    n_tokens = F.floor(F.octet_length("ids") / 4).alias("n_tokens")
    return both.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op2_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.compare_with_next(documents(spark, sf)).withColumnRenamed("edited", "edited_sha256")


@query()
def op6_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(documents(spark, sf))


def written(spans: Column, kinds: tuple[str, ...]) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(kind) for kind in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def numbers(spans: Column, kinds: tuple[str, ...]) -> list[Column]:
    """The number of spans of each kind."""
    of_kind = F.transform(spans, lambda s: s["kind"])
    return [F.size(F.array_compact(F.transform(of_kind, lambda k: F.when(k == place, k)))).cast("long").alias(f"n_{kind}")
            for place, kind in enumerate(kinds)]


@query()
def op7_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.personal_data(documents(spark, sf))
    base = F.filter("spans", lambda s: s["base"])
    counts = numbers(base, pii.KINDS)
    return found.select(
        "doc_id", *counts, F.sha2(written(base, pii.KINDS), 256).alias("base_sha256"),
        written(F.col("spans"), pii.KINDS).alias("spans"),
    )


@query()
def op8_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.secret_spans(documents(spark, sf))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    counts = numbers(base, secrets.KINDS[:3])
    return found.select(
        "doc_id", *counts, F.sha2(written(base, secrets.KINDS), 256).alias("base_sha256"),
        written(F.col("spans"), secrets.KINDS).alias("spans"),
    )


@query(r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words
  FROM documents
), grams AS (
  SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
                             WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                             ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END) AS gram
  FROM worded
), sizes AS (
  SELECT doc_id, count(gram) AS n FROM worded LEFT JOIN grams USING (doc_id) GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)
), reach AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT doc_id, n AS n_shingles, coalesce(least(doc_id, min(b)), doc_id) AS component_id
FROM sizes LEFT JOIN reach ON a = doc_id GROUP BY doc_id, n
""")
def op9_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.link_groups(documents(spark, sf))


@query()
def op10_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.write_and_read(documents(spark, sf))


@query(r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), texts AS (
  SELECT 'documents' AS side, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'benchmark', NULL, coalesce(text, '') FROM benchmark
), worded AS (
  SELECT side, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM texts
), unnested AS (
  SELECT side, doc_id, unnest(words) AS word FROM worded
), vocabulary AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM unnested)
), hashed AS (
  SELECT word, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT),
                               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
  FROM vocabulary, crc
), counted AS (
  SELECT bucket, count(*) FILTER (side = 'documents') AS s, count(*) FILTER (side = 'benchmark') AS t
  FROM unnested JOIN hashed USING (word) GROUP BY bucket
), sums AS (
  SELECT sum(s)::DOUBLE + 10000 AS s_all, sum(t)::DOUBLE + 10000 AS t_all FROM counted
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * s_all) / ((s + 1) * t_all)))::BIGINT AS gain FROM counted, sums
), weighed AS (
  SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM unnested JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'documents' GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weighed USING (doc_id)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank
FROM numbered
""")
def op11_resampling(spark: SparkSession, sf: str) -> DataFrame:
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    return resampling.resample(documents(spark, sf), target).select("doc_id", "n_features", "weight", "score", "rank")


@query(r"""
WITH read AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), said AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
          100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
          doc_id > min(doc_id) OVER (PARTITION BY text)] AS fails
  FROM read LEFT JOIN said USING (doc_id)
), masks AS (
  SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM judged GROUP BY ALL
), letters AS (
  SELECT unnest(range(1, 6)) AS f
), orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT o, unnest(range(1, 6)) AS step FROM orders
), removed_at AS (
  SELECT part, fails, n, good, toxic, o,
         coalesce(list_min(list_transform(range(1, 6), lambda i: CASE WHEN fails[o[i]] THEN i END)), 6) AS r
  FROM masks, orders
), effects AS (
  SELECT part, o, step, sum(CASE WHEN r > step THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN r = step THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN r < step AND fails[o[step]] THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails[o[step]] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN r = step THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN r = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM removed_at JOIN steps USING (o) GROUP BY part, o, step
)
SELECT part, array_to_string(list_transform(o, lambda i: chr((64 + i)::INTEGER)), '') AS filter_order, step::INTEGER AS step, kept, removed,
       redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, o[step])::BIGINT AS shapley
FROM effects
""")
def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    judged = filter_audit.failures(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))
    return filter_audit.audit(judged, "part", "ABCDE", ["good", "toxic"])


@query()
def op13_outliers(spark: SparkSession, sf: str) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return outliers.judge(documents(spark, sf)).select("doc_id", *counts, "base_failed", "kept")
