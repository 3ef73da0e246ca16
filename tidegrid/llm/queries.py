"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import (
    bpe,
    chat,
    collocations,
    decontamination,
    language_id,
    line_dedup,
    quality_rules,
    simhash,
    substring_dedup,
    suffix_dedup,
    token_files,
    url_lists,
    url_rules,
    whitening,
)
from tidegrid.llm.common import map_texts, table
from tidegrid.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Words of all contracts: runs of characters other than ASCII blanks.
SQL_BLANKS = r"[\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("op1_bpe")
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens = bpe.encode_and_decode(table(spark, folder, "documents"), path, remembered=200_000)
    return tokens.select(
        "doc_id", bpe.token_count(), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op6_token_files")
def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import zlib

    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))

    def checksums(batch):
        crc = [zlib.crc32(ids.values.to_numpy(zero_copy_only=False).astype("<u4")) for ids in batch.column("ids")]
        kept = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
        return pa.RecordBatch.from_arrays([*kept, pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return map_texts(token_files.read_tokens(spark, path), lambda: checksums, schema)


SITE_RULES = (
    url_rules.SiteRule("allow", "org", "/"),
    url_rules.SiteRule("block", "example.org", "/es/"),
    url_rules.SiteRule("block", "example.org", "/en/1"),
    url_rules.SiteRule("allow", "com", "/fr/"),
    url_rules.SiteRule("block", "com", "/de/"),
)
PATTERN_RULES = url_lists.junk_rules()


def _op5_sql() -> str:
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.action}')" for r in SITE_RULES)
    patterns = " OR ".join(f"regexp_matches(target, '{r.regex}')" for r in PATTERN_RULES)
    return f"""
WITH a AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
         row_number() OVER () AS k
  FROM pages
), b AS (
  SELECT page_id, k,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail
  FROM a
), c AS (
  SELECT page_id, k, host, regexp_extract(tail, '^[^?#]*') AS path, host || tail AS target FROM b
), rules(rule_host, rule_path, action) AS (VALUES {rules}), d AS (
  SELECT k, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(action, length(rule_host || rule_path)) AS action
  FROM c JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY k
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(action, CASE WHEN {patterns} THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN d USING (k)
"""


@query("op5_url_rules", _op5_sql())
def op5_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_rules.judge_urls(table(spark, folder, "pages"), (*SITE_RULES, *PATTERN_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH rows_in AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM rows_in
), marked AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY k) = role, false) AS goes_on,
         length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) AS escaped,
         length(role) + length(regexp_replace(role, '[^\\<\[]', '', 'g')) AS escaped_role
  FROM ranked
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY k)) AS loss_sha256,
       CAST(sum(escaped + CASE WHEN goes_on THEN 6 ELSE escaped_role + 20 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query("op8_chat", OP8_SQL)
def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string"
    )
    chats = chat.read_chats(chat.format_chats(rows.unionByName(extra)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM split
), keyed AS (
  SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) <> max(doc_id)
), judged AS (
  SELECT keyed.*, first IS NOT NULL AND doc_id <> first AS dropped FROM keyed LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op3_line_dedup", OP3_SQL)
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, folder, "documents"), scratch_path(spark, "lines"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op10_simhash")
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, max_bits=2)


@query("op9_language_id")
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


OP7_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM words WHERE len(w) >= 50
), hashed AS (
  SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) AS h FROM starts
), least AS (
  SELECT h, min(doc_id) AS first FROM hashed GROUP BY h HAVING min(doc_id) <> max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS k FROM hashed JOIN least USING (h) WHERE first < doc_id
), each_word AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM words
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM each_word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


@query("op7_substring_dedup", OP7_SQL)
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup.dedup_substrings(table(spark, folder, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents")).drop("distance")


@query("op13_whitening")
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    model = whitening.fit(rows)
    error = whitening.identity_error(rows, model) if model else None
    return whitening.whiten(rows, model).withColumn("identity_error", F.lit(error).cast("double"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'
  )) AS piece FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), phrases AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, unnest([array_to_string(list_slice(w, p, p + k - 1), ' ') for p in range(1, len(w) - k + 2)]) AS phrase
    FROM words, (VALUES (1), (2), (3), (4)) sizes(k) WHERE len(w) >= k
  ) GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM phrases WHERE k = 1 GROUP BY lang
), frequent AS MATERIALIZED (
  SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM phrases WHERE f >= {least}
), cuts AS (
  SELECT lang, phrase, k, f AS a, w, unnest(range(1, k)) AS cut FROM frequent WHERE k > 1
), scored AS (
  SELECT c.lang, c.phrase, c.a, first.f AS l, rest.f AS r, cut,
         CAST(CAST(c.a AS HUGEINT) * 2000000 // (first.f + rest.f) AS BIGINT) AS score
  FROM cuts c
  JOIN frequent first ON first.lang = c.lang AND first.phrase = array_to_string(list_slice(c.w, 1, cut), ' ')
  JOIN frequent rest ON rest.lang = c.lang AND rest.phrase = array_to_string(list_slice(c.w, cut + 1, c.k), ' ')
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM scored
), longer AS (
  SELECT lang, f, array_to_string(list_slice(w, p, p + m - 1), ' ') AS phrase FROM (
    SELECT lang, f, w, m, unnest(range(1, k - m + 2)) AS p FROM frequent, (VALUES (2), (3)) sizes(m) WHERE m < k
  )
), around AS (
  SELECT lang, phrase, max(f) AS most FROM longer GROUP BY lang, phrase
), ranked AS (
  SELECT x.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM lowest x LEFT JOIN around USING (lang, phrase)
  WHERE place = 1 AND NOT coalesce(CAST(most AS HUGEINT) * 100 >= CAST(a AS HUGEINT) * 80, false)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {limit}
"""


def _op11_sql(least: int = 30, limit: int = 2000) -> str:
    return OP11_SQL.replace("{least}", str(least)).replace("{limit}", str(limit))


@query("op11_collocations", _op11_sql())
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"), min_count=30, covered=80, limit=2000)


OP12_SQL = """
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), starts AS (
  SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM texts WHERE n >= 100
), hashed AS MATERIALIZED (
  SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS g FROM starts
), firsts AS (
  SELECT g, min((doc_id, p)) AS first FROM hashed GROUP BY g HAVING count(*) > 1
), later AS (
  SELECT doc_id, p, lag(p) OVER w AS before, lead(p) OVER w AS after
  FROM hashed JOIN firsts USING (g) WHERE (doc_id, p) <> first WINDOW w AS (PARTITION BY doc_id ORDER BY p)
), spans AS (
  SELECT doc_id, p AS a, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS next FROM later WHERE before IS NULL OR p - before > 100
), ends AS (
  SELECT doc_id, p + 100 AS b FROM later WHERE after IS NULL OR after - p > 100
), cuts AS (
  SELECT doc_id, a, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k, next FROM spans
), stops AS (
  SELECT doc_id, b, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS k FROM ends
), removed AS (
  SELECT doc_id, k, a, b, next FROM cuts JOIN stops USING (doc_id, k)
), joined AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, 2 * b + 1, 2 * (coalesce(next, n) - b)), '' ORDER BY k) AS rest, min(a) AS first
  FROM removed JOIN texts USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE substr(h, 1, 2 * first) || rest END)) AS kept_sha256
FROM texts LEFT JOIN joined USING (doc_id)
"""


@query("op12_suffix_dedup", OP12_SQL)
def op12_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = suffix_dedup.dedup_bytes(table(spark, folder, "documents"), window=100)
    return kept.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
