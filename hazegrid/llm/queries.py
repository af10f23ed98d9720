"""The registered query of each operator, with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.llm import aligning, bm25, bpe, divergence, knn_quality, licenses, linetree, mixing, pieces, quality_rules, simhash, toxicity, urlfilter
from hazegrid.llm.common import store, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"])
    return bpe.digests(encoded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op7_linetree")
def op7_linetree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linetree.drop_recurring(docs, ends=True).select("doc_id", "n_lines", "n_dropped", "text")


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


# With a repetition limit the exponent has a closed form, so the twin needs no bisection; documents of the
# last pass are ordered whole instead of block by block.
MIXING_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS id, source, coalesce(source, '') AS s,
         len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS n_tokens FROM documents),
totals AS (SELECT s, sum(n_tokens) AS n, greatest(1, ceil(sum(n_tokens) / 100000.0))::BIGINT AS blocks FROM docs GROUP BY s),
ex AS (SELECT greatest(0.0, 1 - ln(2.0) / ln(greatest(max(n) / min(n), 1.0000001))) AS a, sum(n) AS total FROM totals WHERE n > 0),
raised AS (SELECT s, n, blocks, power(n / total, a) AS r FROM totals, ex WHERE n > 0),
weighted AS (SELECT s, n, blocks, r / (SELECT sum(r) FROM raised) AS w FROM raised),
budgets AS (SELECT s, n, blocks, floor((SELECT max(n / w) FROM weighted) * w + 1e-6)::BIGINT AS own FROM weighted),
plan AS (
  SELECT s, blocks, own // n AS passes, own % n AS rest FROM budgets
  UNION ALL SELECT s, blocks, 1, 0 FROM totals WHERE n = 0),
dealt AS (
  SELECT d.*, passes, rest, ('0x' || substr(md5('mix/block:' || s || ':' || id), 1, 15))::BIGINT % blocks AS block FROM docs d JOIN plan USING (s)),
keyed AS (
  SELECT *, md5('mix/pass:' || s || ':' || passes || ':' || block) AS bk, md5('mix/doc:' || s || ':' || passes || ':' || id) AS dk FROM dealt),
placed AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY s ORDER BY bk, block, dk, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed),
copies AS (
  SELECT *, unnest(range(0, (passes + CASE WHEN before < rest THEN 1 ELSE 0 END)::BIGINT)) AS epoch FROM placed)
SELECT doc_id, source, n_tokens, epoch, block, md5('mix/pass:' || s || ':' || epoch || ':' || block) AS block_key,
       md5('mix/doc:' || s || ':' || epoch || ':' || id) AS doc_key
FROM copies
"""


@query("op9_mixing", MIXING_SQL)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "source", "n_tokens", "epoch", "block", "block_key", "doc_key")


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


# The list and the dates of the URL filter are arithmetic on the pages table, said the same way in SQL.
URL_LISTS = ["adult", "malware", "phishing", "spam"]
URL_SQL = r"""
WITH rows_ AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS day,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)) AS h,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
parsed AS (
  SELECT page_id, url, day, CASE WHEN regexp_replace(h, '\.+$', '') <> '' THEN regexp_replace(h, '\.+$', '') END AS host,
         list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM rows_),
keyed AS (
  SELECT *, string_split(host, '.') AS labels FROM parsed WHERE host IS NOT NULL),
spread AS (
  SELECT DISTINCT url, day, unnest(list_concat(
    list_transform(range(1, greatest(2, len(labels))), lambda i: array_to_string(labels[i:], '.')),
    list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[:i], '/')))) AS key
  FROM keyed),
hosts AS (SELECT DISTINCT key, CAST('0x' || substr(md5(key), 1, 6) AS BIGINT) AS u FROM spread),
events_ AS (
  SELECT key, u, 'add' AS action, u % 200 AS d FROM hosts WHERE u % 3 = 0
  UNION ALL SELECT key, u, 'remove', u % 200 + 20 + u % 90 FROM hosts WHERE u % 6 = 0
  UNION ALL SELECT key, u, 'add', u % 200 + 150 + u % 50 FROM hosts WHERE u % 12 = 0),
dated AS (
  SELECT ['adult', 'malware', 'phishing', 'spam'][u // 5 % 4 + 1] AS list, key, action, DATE '2024-01-01' + CAST(d AS INTEGER) AS day FROM events_),
days AS (SELECT list, key, day, max(action) AS action FROM dated GROUP BY ALL),
held AS (
  SELECT *, coalesce(lead(day) OVER (PARTITION BY list, key ORDER BY day), DATE '9999-12-31') AS valid_to FROM days),
hits AS (
  SELECT s.url, s.day, count(*) AS n, array_to_string(list_sort(list_distinct(list(h.list))), ',') AS lists,
         first(s.key ORDER BY -length(s.key), s.key) AS entry
  FROM spread s JOIN held h ON h.key = s.key AND h.action = 'add' AND s.day >= h.day AND s.day < h.valid_to GROUP BY ALL)
SELECT p.page_id, p.host, p.day AS fetched_on, coalesce(n, 0) AS n_active, coalesce(lists, '') AS lists, entry, coalesce(n, 0) > 0 AS blocked
FROM parsed p LEFT JOIN hits USING (url, day)
"""


def url_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries over the keys of the pages' own URLs."""
    keys = pages.select(F.explode(urlfilter.keys_of(F.col("url"))).alias("key")).distinct()
    u = F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 6), 16, 10).cast("long")
    day = lambda d: F.date_add(F.lit("2024-01-01").cast("date"), d.cast("int"))
    event = lambda when, action, d: F.when(when, F.struct(F.lit(action).alias("action"), day(d).alias("day")))
    u_ = F.col("u")
    events = F.array(
        event(u_ % 3 == 0, "add", u_ % 200),
        event(u_ % 6 == 0, "remove", u_ % 200 + 20 + u_ % 90),
        event(u_ % 12 == 0, "add", u_ % 200 + 150 + u_ % 50),
    )
    named = F.get(F.array(*[F.lit(x) for x in URL_LISTS]), (F.floor(u_ / 5) % 4).cast("int"))
    rows = keys.withColumn("u", u).where("u % 3 = 0").select(named.alias("list"), "key", F.explode(events).alias("e"))
    return rows.select("list", "key", "e.action", "e.day")


@query("op10_urlfilter", URL_SQL)
def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int")))
    return urlfilter.judge(captures, url_entries(pages))


@query("op5_knn")
def op5_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = knn_quality.score(docs, knn_quality.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select(
        "doc_id", knn_quality.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


@query("op2_licenses")
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.summary(licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


BM25_SQL = r"""
WITH toks AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL),
lens AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY ALL),
stats AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM toks) * 1.0 / (SELECT count(*) FROM documents) AS mean_len),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS w FROM tf, stats GROUP BY term, n),
scored AS (
  SELECT q.doc_id AS query_id, d.doc_id,
         round(sum(w * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * len / mean_len))), 6) AS score
  FROM tf q JOIN tf d USING (term) JOIN idf USING (term) JOIN lens l ON l.doc_id = d.doc_id, stats
  WHERE q.doc_id % 100 = 0 GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op1_bm25", BM25_SQL)
def op1_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return bm25.search(store(bm25.build_index(docs)), asked)


@query("op11_pieces")
def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.round_trip(table(spark, sf_dir, "documents"), model, keep=["doc_id"], add=("n_tokens", "ids_sha256", "decoded_sha256"))


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    aligned = aligning.align_documents(table(spark, sf_dir, "documents"), vocabulary, model, keep=["doc_id"], digest=True)
    return aligning.weigh(aligned).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


DIVERGENCE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words_ AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n_lang FROM words_ GROUP BY ALL HAVING count(DISTINCT id) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM words_ JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(n_lang) AS n_all FROM kept GROUP BY lang),
sums AS (SELECT lang, source, sum(n) AS n_group FROM counts GROUP BY ALL),
groups_ AS (SELECT DISTINCT lang, source FROM docs),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (coalesce(n_group, 0) + 2 * v))::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (n_lang + 2)) // (n_all + 2 * v))::BIGINT AS q
  FROM groups_ g JOIN langs USING (lang) JOIN kept k USING (lang) LEFT JOIN sums USING (lang, source)
       LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query("op13_divergence", DIVERGENCE_SQL)
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))
