"""The queries ``opN_<name>``: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, language, lexical, line_dedup, merkle, packing, page_text, pii, quality, secret_scan, spans, toxicity, urls
from .registry import QUERIES, SQL, query, sha256, table

__all__ = ["QUERIES", "SQL"]

OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, size, list_aggregate(w[i : i + size - 1], 'string_agg', ' ') AS words
  FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT r, i, size, list_aggregate(w[i : i + size - 1], 'string_agg', ' ') AS words
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), hits AS (SELECT r, i, size, item_id FROM dw JOIN bw USING (size, words)),
per AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r
), found AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (r) LEFT JOIN found USING (r)
"""


@query(OP2_SQL)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        sha256(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT r, i, list_aggregate(w[i : i + 7], 'string_agg', ' ') AS words FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), again AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, words) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM again) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(list_concat([''], w), 'string_agg', '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
  FROM d LEFT JOIN rep USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 40 * n_words
    OR n_dup_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines OR word_chars > 30 * n_words) AS kept
FROM m
"""


@query(OP5_SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       quality.rejected(quality.BASE).alias("base_failed"), (~quality.rejected(quality.CURRENT)).alias("kept"), "failed").drop("failed")


# The four decisive rules, then what the method blocks by itself.
URL_RULES = [
    urls.Rule("||net/", "block"), urls.Rule("||example.net/en/", "allow"), urls.Rule("||example.com/de/", "block"), urls.Rule("||org/fr/", "allow"),
    *[urls.Rule(t, "block", 1) for t in ("-farm.", "cheap-pills.", "casino-win.", "adult-x.", "free-bets.", "ads-track.", "/casino/", "/porn/", "/viagra/")],
]
OP6_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), f AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host || path, '(?s)-farm\.|cheap-pills\.|casino-win\.|adult-x\.|free-bets\.|ads-track\.|/casino/|/porn/|/viagra/') THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""


@query(OP6_SQL)
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = urls.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return rows.withColumn("rule", F.expr("substring(rule, 3)"))


def _span_digest(found: DataFrame, kinds: tuple[str, ...], counted: tuple[str, ...]) -> DataFrame:
    return found.select(
        "doc_id", *[spans.of_kind(F.col("base"), k).alias(f"n_{k}") for k in counted], sha256(spans.written(F.col("base"), kinds)).alias("base_sha256"),
        spans.written(F.concat("base", "added"), kinds).alias("spans"), F.size("added").cast("long").alias("n_added"))


@query()
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(pii.personal_data(table(spark, sf_dir, "documents")), pii.KINDS, pii.KINDS)


@query()
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(secret_scan.secrets(table(spark, sf_dir, "documents")), secret_scan.KINDS, secret_scan.KINDS[:3])


@query()
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


@query()
def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query()
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), ranks_path())


@query()
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query()
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_counts(table(spark, sf_dir, "documents"), short=True)


# CRC-32 of a short ASCII text, bit by bit: a byte is xored in, each -1 shifts once.
CRC_SQL = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split({0}, ''),
  lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""


def _tree_sql(name: str, levels: int) -> str:
    """Tables of runs (``{name}r0`` ...) and the roots of the trees in ``{name}n0`` (s, p, m, h)."""
    steps = [f"""{name}r{k} AS (SELECT s, p // 16 AS p, m, string_agg(h, '' ORDER BY p) AS run FROM {name}n{k} GROUP BY s, p // 16, m),
{name}n{k + 1} AS (SELECT s, p, (m + 15) // 16 AS m, CASE WHEN m > 1 THEN sha256(run) ELSE run END AS h FROM {name}r{k})""" for k in range(levels)]
    return ",\n".join(steps)


def _climb_sql(name: str, levels: int) -> str:
    """Each row of ``{name}c0`` (r, s, p, f, o) brought up level by level: its folded node and the siblings passed."""
    others = "left(run, 64 * (c.p % 16)) || {} || substr(run, 64 * (c.p % 16) + 65)"
    steps = [f"""{name}c{k + 1} AS (SELECT r, s, c.p // 16 AS p, CASE WHEN m > 1 THEN sha256({others.format('f')}) ELSE f END AS f,
  CASE WHEN m > 1 THEN o || {others.format("''")} ELSE o END AS o FROM {name}c{k} c JOIN {name}r{k} t USING (s) WHERE t.p = c.p // 16)""" for k in range(levels)]
    return ",\n".join(steps)


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


# Written out for groups of up to 16 ** 6 rows and 16 ** 4 groups.
OP13_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '-') AS s, sha256({" || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {CRC_SQL.format("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN
      sha256({" || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")))}) END AS claim
  FROM documents
), x AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY s) AS m FROM d),
an0 AS (SELECT s, p, m, leaf AS h FROM x),
{_tree_sql("a", 6)},
bn0 AS (SELECT '' AS s, row_number() OVER (ORDER BY s) - 1 AS p, count(*) OVER () AS m, h, s AS name FROM an6),
{_tree_sql("b", 4)},
ac0 AS (SELECT r, s, p, coalesce(claim, leaf) AS f, '' AS o FROM x),
{_climb_sql("a", 6)},
bc0 AS (SELECT r, '' AS s, n.p, f, o FROM ac6 c JOIN bn0 n ON c.s = n.name),
{_climb_sql("b", 4)}
SELECT doc_id, leaf, t.h AS subroot, root.h AS root, sha256(o) AS proof_sha256, f AS folded_root, f = root.h AS verified
FROM x JOIN bc4 USING (r) JOIN an6 t ON t.s = x.s CROSS JOIN bn4 root
"""


@query(OP13_SQL)
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), tf AS (SELECT r, doc_id, term, count(*) AS tf FROM d WHERE term <> '' GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
len AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
st AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM len),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  WHERE term <> '' GROUP BY ALL
), s AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (r) CROSS JOIN st GROUP BY item_id, r
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""


@query(OP11_SQL)
def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
