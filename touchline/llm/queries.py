"""Registered queries of the training-data operators, with DuckDB SQL where
SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
k AS (SELECT doc_id, source, size, md5(coalesce(doc_id::VARCHAR, md5(text)) || '|' || size::VARCHAR) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                  WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             (3 * source_size)::DOUBLE AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM l) * weight) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
g AS (SELECT source, key, count(*) AS n, sum(size) AS words FROM k GROUP BY source, key),
p AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY key
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT k.doc_id, k.size, e.source_size, e.target,
       (e.epochs * k.size + greatest(0, least(k.size,
          (floor(e.target)::BIGINT - e.epochs * e.source_size - p.before) // p.n)))::BIGINT AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
       JOIN p ON k.source IS NOT DISTINCT FROM p.source AND k.key = p.key
"""


@register("op1_mix_sources", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.mixing import mix_plan
    return mix_plan(read_table(spark, sf_dir, "documents")).drop("source")


@register("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from touchline.llm.token_counts import count_tokens
    counts = count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@register("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from touchline.llm.byte_bpe import digests, round_trip
    return digests(round_trip(read_table(spark, sf_dir, "documents"),
                              public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


@register("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.language_id import identify_documents
    return identify_documents(read_table(spark, sf_dir, "documents"))


@register("op3_near_duplicates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.near_dup import near_duplicates
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("row_key", "group")


@register("op9_html_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.html_extract import extract_pages
    out = extract_pages(read_table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


@register("op4_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.paragraph_sketch import compare_with_next
    return compare_with_next(read_table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH x AS (SELECT vec_id, embedding, [floor(64 * c::DOUBLE) FOR c IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
s AS (SELECT q.vec_id AS query_id, q.embedding, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM (SELECT DISTINCT * FROM x WHERE vec_id % 20 = 0) q JOIN x c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id, embedding ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


@register("op7_top_k", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.va_search import top_k
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP8_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(turn, 9223372036854775807) AS place, coalesce(role, 'unknown') AS role,
                  coalesce(replace(text, '<|im_', '< |im_'), '') AS said FROM conversations),
b AS (SELECT *, place // 64 AS part, md5(role || '|' || said) AS tie FROM t),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM b WHERE role <> 'system'),
v AS (SELECT b.*, s.speaker, coalesce(b.role = s.speaker, false) AS own,
             '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = s.speaker THEN 'assistant'
                                    ELSE 'user name=' || role END || chr(10) AS head, said || '<|im_end|>' || chr(10) AS body
      FROM b LEFT JOIN s ON b.conv_id = s.conv_id),
p AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, part ORDER BY place, tie
                                                       ROWS UNBOUNDED PRECEDING) AS fin FROM v)
SELECT conv_id, speaker, part::VARCHAR AS part, count(*) AS n_turns,
       string_agg(head || body, '' ORDER BY place, tie) AS text,
       coalesce(string_agg((fin - length(body))::BIGINT::VARCHAR || '-' || fin::BIGINT::VARCHAR, ',' ORDER BY place, tie)
                FILTER (WHERE own), '') AS mask,
       coalesce(sum(length(body)) FILTER (WHERE own), 0)::BIGINT AS n_masked
FROM p GROUP BY conv_id, speaker, part
"""


@register("op8_chat_format", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.chat_format import rotate
    return rotate(read_table(spark, sf_dir, "conversations")).withColumn("mask", F.array_join("mask", ","))


@register("op6_lm_scores")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.pseudo_lm import score_documents
    return score_documents(read_table(spark, sf_dir, "documents"))


def _op11_sql(clusters: int = 40, rounds: int = 5) -> str:
    """Every round as one assignment and one table of centroids."""
    out = [f"""WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, [floor(256 * c::DOUBLE)::BIGINT FOR c IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS cluster, v
  FROM (SELECT sha256('2:' || vec_id::VARCHAR) AS h, v FROM x WHERE vec_id IS NOT NULL) QUALIFY cluster < {clusters})"""]
    for n in range(rounds + 1):
        out.append(f"""a{n} AS MATERIALIZED (SELECT row, vec_id, x.v, cluster,
    list_sum([(x.v[i] - c.v[i]) * (x.v[i] - c.v[i]) FOR i IN range(1, 65)])::BIGINT AS distance
  FROM x, c{n} c QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)""")
        if n < rounds:
            out.append(f"""m{n} AS MATERIALIZED (SELECT cluster, i, floor(sum(v[i]) / count(*))::BIGINT AS x
  FROM a{n}, (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster, i),
c{n + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.v, c.v) AS v FROM c{n} c
  LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS v FROM m{n} GROUP BY cluster) n USING (cluster))""")
    return ",\n".join(out) + f"""
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (cluster)"""


@register("op11_centroids", _op11_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.centroids import cluster_vectors
    return cluster_vectors(read_table(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    from touchline.llm.quality_rules import RULES, STOP_WORDS
    stops = sorted({f for group in STOP_WORDS.values() for w in group for f in (w.lower(), w.upper(), w.capitalize())})
    broken = []
    for r in RULES:
        tests = [f"1000 * {r.part} < {r.least} * {r.whole}"] * (r.least is not None)
        tests += [f"1000 * {r.part} > {r.most} * {r.whole}"] * (r.most is not None)
        broken.append(f"CASE WHEN {' OR '.join(tests)} THEN '{r.name}' END")
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM documents),
w AS (SELECT row, i, array_to_string(words[i:i + 7], ' ') AS said FROM (SELECT row, words, unnest(range(1, len(words) - 6)) AS i FROM d)),
r AS (SELECT row, i FROM w QUALIFY count(*) OVER (PARTITION BY row, said) > 1),
g AS (SELECT row, least(8, coalesce(lead(i) OVER (PARTITION BY row ORDER BY i) - i, 8)) AS n FROM r),
p AS (SELECT row, sum(n)::BIGINT AS n FROM g GROUP BY row),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
        len(lines)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
        len([x FOR x IN words IF x IN {tuple(stops)}])::BIGINT AS n_stop_words,
        len([x FOR x IN lines IF regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{{2022}}\x{{25CF}}]')])::BIGINT AS n_bullet_lines,
        len([x FOR x IN lines IF regexp_matches(x, '(?:\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$')])::BIGINT AS n_ellipsis_lines
      FROM d LEFT JOIN p USING (row))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       concat_ws(',', {', '.join(broken)}) AS broken_rules, NOT base_failed AND broken_rules = '' AS kept FROM m"""


@register("op12_quality_rules", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.quality_rules import apply_rules
    return apply_rules(read_table(spark, sf_dir, "documents"))


_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(terms) > 0)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
t AS MATERIALIZED (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY row, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM t, s GROUP BY term, n_docs),
i AS (SELECT row_number() OVER () AS item, item_id, terms
      FROM (SELECT DISTINCT item_id, text, {_TERMS} AS terms FROM benchmark)),
q AS (SELECT item, item_id, term, count(*)::BIGINT AS times FROM (SELECT item, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
r AS (SELECT item, item_id, row, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN t USING (term)
      JOIN (SELECT row, (75 + (25 * len(terms)::HUGEINT * n_docs) // n_terms)::BIGINT AS m FROM d, s) USING (row)
      GROUP BY item, item_id, row)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM r JOIN d USING (row) WHERE score > 0 QUALIFY rank <= 20
"""


@register("op13_lexical_search", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.lexical_search import search
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
