"""Queries: counts, profiles, labels, text functions, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from ..operators import evaluation as E
from ..sources import wiki
from .registry import query, table

BUDGET_SQL = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


@query()
def pii_redaction(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("text"))


@query("SELECT md5(coalesce(text, '')) AS digest, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def label_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT source, count(*)::BIGINT AS docs, count(l.doc_id)::BIGINT AS labelled, sum(coalesce(quality, 0))::BIGINT AS good FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def label_coverage(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("has", F.lit(1))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.count("has").alias("labelled"), F.sum(F.coalesce("quality", F.lit(0)).cast("long")).alias("good"))


@query("SELECT (doc_id + 500)::BIGINT AS id FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id + 500)")
def labels_without_document(spark, sf_dir):
    """Labels shifted off the corpus's end, those that it lacks."""
    labels = table(spark, sf_dir, "labels").select((F.col("doc_id") + 500).alias("id"))
    return E.missing_labels(labels, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))


@query("SELECT source, count(*)::BIGINT AS n FROM documents GROUP BY source")
def count_by_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, quantile_disc(value, 0.5) AS near50, quantile_disc(value, 0.95) AS near95, min(value) AS least, count(*)::BIGINT AS n FROM events GROUP BY event_type""")
def percentiles(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    p = S.percentiles(events, "event_type", "value", [50, 95])
    counts = events.groupBy("event_type").agg(F.min("value").alias("least"), F.count("*").alias("rows"))
    return p.join(counts, "event_type").select("event_type", F.round("linear50", 6).alias("p50"), F.round("linear95", 6).alias("p95"), F.col("nearest50").alias("near50"), F.col("nearest95").alias("near95"), "least", F.col("rows").alias("n"))


@query("""WITH v AS (SELECT event_type, list_sort(list(value)) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type), x AS (SELECT *, 0.95::DOUBLE * (n + 1) AS spot FROM v)
SELECT event_type, round(list_extract(v, ceil(0.95 * n)::INT), 6) AS nearest, round(quantile_cont, 6) AS linear, round(v[floor(spot)::INT] + (spot - floor(spot)) * (v[least(n, floor(spot)::INT + 1)] - v[floor(spot)::INT]), 6) AS exclusive
FROM x JOIN (SELECT event_type, quantile_cont(value, 0.95) AS quantile_cont FROM events GROUP BY event_type) USING (event_type)""")
def percentiles_three_ways(spark, sf_dir):
    p = S.percentiles(table(spark, sf_dir, "events"), "event_type", "value", [95])
    return p.select("event_type", F.round("nearest95", 6).alias("nearest"), F.round("linear95", 6).alias("linear"), F.round("exclusive95", 6).alias("exclusive"))


@query("""SELECT round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.99), 6) AS p99, max(n_chars) AS most, round(avg((n_chars > 1000)::INT), 6) AS over_1000, round(avg((n_chars > 4000)::INT), 6) AS over_4000 FROM documents""")
def corpus_profile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("one", F.lit(1))
    p = S.percentiles(docs, "one", "n_chars", [50, 90, 99], 64.0)
    over = lambda x: F.round(F.avg((F.col("n_chars") > x).cast("int")), 6)
    rest = docs.groupBy("one").agg(F.max("n_chars").alias("most"), over(1000).alias("over_1000"), over(4000).alias("over_4000"))
    return p.join(rest, "one").select(*[F.round(f"linear{x}", 6).alias(f"p{x}") for x in (50, 90, 99)], "most", "over_1000", "over_4000")


@query("SELECT lang, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.75), 6) AS p75, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(quantile_cont(n_chars, 0.99), 6) AS p99, count(*)::BIGINT AS n FROM documents GROUP BY lang")
def profile_by_language(spark, sf_dir):
    p = S.percentiles(table(spark, sf_dir, "documents"), "lang", "n_chars", [50, 75, 90, 95, 99], 64.0)
    return p.select("lang", *[F.round(f"linear{x}", 6).alias(f"p{x}") for x in (50, 75, 90, 95, 99)], "n")


@query("SELECT lang, count(*)::BIGINT AS n, min(n_chars) AS least, list_sort(list(n_chars))[(count(*) // 2 + 1)::INT] AS median, max(n_chars) AS most FROM documents GROUP BY lang")
def upper_median(spark, sf_dir):
    return S.upper_median(table(spark, sf_dir, "documents"), "lang", "n_chars")


@query("WITH t AS (SELECT unnest([200, 1000, 4000, 20000]) AS threshold) SELECT threshold::INT AS threshold, round(avg((n_chars > threshold)::INT), 6) AS share FROM documents, t GROUP BY threshold")
def shares_above(spark, sf_dir):
    t = F.explode(F.array(*[F.struct(F.lit(x).alias("threshold"), (F.col("n_chars") > x).cast("int").alias("over")) for x in (200, 1000, 4000, 20000)]))
    return table(spark, sf_dir, "documents").select(t.alias("t")).groupBy("t.threshold").agg(F.round(F.avg("t.over"), 6).alias("share"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(min(value), 6) AS least, count(*)::BIGINT AS items, round(sum(value), 4) AS seconds, round(count(*) / sum(value), 6) AS per_second FROM events GROUP BY event_type")
def latency_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("items", F.lit(1).cast("long"))
    return S.summary(rows, "event_type", "value", "items").select("event_type", F.round("mean", 6).alias("mean"), F.round("least", 6).alias("least"), "items", F.round("seconds", 4).alias("seconds"), F.round("per_second", 6).alias("per_second"))


@query("SELECT page_id, regexp_replace(url, '[?#].*$', '') AS root, greatest(1, coalesce(try_cast(regexp_extract(url, '[?&]page=(\\d+)', 1) AS INT), 1)) AS page FROM pages")
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("root"), F.greatest(F.lit(1), F.coalesce(F.expr("try_cast(regexp_extract(url, '[?&]page=(\\\\d+)', 1) AS INT)"), F.lit(1))).alias("page"))


TOPIC = r"^(https?://[^/]+/[a-z]+/(\d+)(?:\.html)?/)"


@query(r"WITH c AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') || '/' AS u FROM pages) SELECT page_id, CASE WHEN regexp_matches(u, '" + TOPIC + r"') THEN regexp_extract(u, '" + TOPIC + r"', 1) END AS root, CASE WHEN regexp_matches(u, '" + TOPIC + r"') THEN regexp_extract(u, '" + TOPIC + r"', 2) END AS topic_id FROM c")
def topic_urls(spark, sf_dir):
    """Root and number of topic pages, nothing for others."""
    return table(spark, sf_dir, "pages").select("page_id", T.topic_url(F.col("url"), TOPIC).alias("t")).select("page_id", "t.root", "t.topic_id")


@query(r"""WITH l AS (SELECT page_id, list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1) || [url], lambda u: try_cast(regexp_extract(u, '/(\d+)', 1) AS INT)) AS n FROM pages) SELECT page_id, coalesce(list_max(n), 1) AS page FROM l""")
def links_max_page(spark, sf_dir):
    """Largest number in the links of a page and its own address, 1 without any."""
    links = F.concat(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), F.array("url"))
    return table(spark, sf_dir, "pages").select("page_id", T.max_page(links, r"/(\d+)").alias("page"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'http://x/t/' ELSE 'http://x/t/page/' || (page_id % 3 + 1)::VARCHAR || '/' END AS url, CASE WHEN regexp_matches(url, '(?i)^https?://') THEN url END AS link FROM pages".replace("page_id % 3 = 1", "page_id % 3 = 0"))
def page_links(spark, sf_dir):
    """Addresses of numbered pages, and page addresses that are safe as links."""
    return table(spark, sf_dir, "pages").select("page_id", T.page_url(F.lit("http://x/t/"), F.col("page_id") % 3 + 1).alias("url"), T.safe_link(F.col("url")).alias("link"))


@query("SELECT regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) || '/' || regexp_extract(url, '/([a-z]+)/', 1) AS page_id, count(*)::BIGINT AS n FROM pages GROUP BY 1 HAVING count(DISTINCT url) > 1")
def same_pages(spark, sf_dir):
    """Canonical pages that several addresses lead to."""
    key = F.concat_ws("/", F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1), F.regexp_extract("url", "/([a-z]+)/", 1))
    rows = table(spark, sf_dir, "pages").select(key.alias("page_id"), F.col("url").alias("requested_title"))
    return wiki.same_pages(rows).join(rows.groupBy("page_id").agg(F.count("*").alias("n")), "page_id").select("page_id", "n")


@query("SELECT count(*)::BIGINT AS chunks, count(DISTINCT source)::BIGINT AS sources, count(DISTINCT text)::BIGINT AS texts, count(*) FILTER (n_chars >= 200)::BIGINT AS dense, sum(n_chars)::BIGINT AS chars FROM documents")
def chunk_manifest(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("chunks"), F.countDistinct("source").alias("sources"), F.countDistinct("text").alias("texts"), F.count_if(F.col("n_chars") >= 200).alias("dense"), F.sum("n_chars").alias("chars"))


@query(f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{BUDGET_SQL}'))::INT AS tokens FROM documents")
def token_budget(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


SIGNS = " + ".join(f"regexp_matches(coalesce(text, ''), '{s}')::INT" for s in T.SIGNALS)


@query(f"SELECT doc_id, ({SIGNS})::INT AS signs, (len(regexp_extract_all(coalesce(text, ''), '{BUDGET_SQL}')) >= 4000 AND len(string_split(rtrim(text, chr(10)), chr(10))) >= 100 AND ({SIGNS}) >= 3) AS dump FROM documents")
def diagnostic_flag(spark, sf_dir):
    signs = sum((F.coalesce("text", F.lit("")).rlike(s).cast("int") for s in T.SIGNALS), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", signs.alias("signs"), F.coalesce(T.is_diagnostic(F.col("text")), F.lit(False)).alias("dump"))


@query("SELECT doc_id, array_to_string(CASE WHEN n <= 8 THEN range(n) ELSE list_sort(list_distinct(list_transform(range(8), lambda i: round_even(i * (n - 1) / 7.0::DOUBLE, 0)::BIGINT))) END, ',') AS picks FROM (SELECT doc_id, n_chars % 40 AS n FROM documents)")
def representative_indices(spark, sf_dir):
    """Evenly spaced picks of at most eight parts."""
    n = (F.col("n_chars") % 40).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.representative_indices(n, 8)).cast("array<string>"), ",").alias("picks"))


@query("SELECT doc_id, sha256(text) AS digest, regexp_replace(substr(text, 1, 240), '^\\s+|\\s+$', '', 'g') AS snippet, coalesce(nullif(source, ''), nullif(lang, ''), 'unknown') AS source FROM documents")
def digests_and_snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), T.snippet(F.col("text")).alias("snippet"), T.first_filled(F.col("source"), F.col("lang")).alias("source"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END AS iso, strftime(ts, '%Y-%m-%d') AS day, printf('msg_%06d', event_id) AS name FROM events")
def iso_times(spark, sf_dir):
    iso = T.iso(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", iso.alias("iso"), F.substring(iso, 1, 10).alias("day"), F.format_string("msg_%06d", "event_id").alias("name"))


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def longest_chunks(spark, sf_dir):
    """The ten longest; the limit is the feature."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


STATUS = "CASE WHEN l.doc_id IS NULL OR (toxic = 0 AND quality = 0) THEN 'pending' WHEN toxic = 1 THEN 'excluded' ELSE 'reviewed' END"


@query(f"SELECT {STATUS} AS status, count(*)::BIGINT AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def review_progress(spark, sf_dir):
    """Labels as review states: none or empty is pending, null is excluded."""
    labels = table(spark, sf_dir, "labels")
    ids = F.when(F.col("toxic") == 1, F.lit(None)).when(F.col("quality") == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("doc_id").cast("string")))
    marked = labels.select(F.col("doc_id").alias("query_id"), ids.cast("array<string>").alias("post_ids"))
    queries = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"))
    return E.review_status(queries, marked).groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT doc_id, coalesce(source, '') AS topic FROM documents), l AS (SELECT doc_id AS q, unnest([doc_id, doc_id + 1, doc_id + 1]) AS p FROM labels)
SELECT 'duplicate' AS problem, q::VARCHAR AS query_id, p::VARCHAR AS post_id FROM l JOIN x ON x.doc_id = q GROUP BY q, p HAVING count(*) > 1
UNION ALL SELECT 'missing_post', q::VARCHAR, p::VARCHAR FROM l JOIN x ON x.doc_id = q WHERE p NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT DISTINCT 'wrong_topic', q::VARCHAR, p::VARCHAR FROM l JOIN x a ON a.doc_id = q JOIN x b ON b.doc_id = p WHERE a.topic <> b.topic
UNION ALL SELECT 'unknown_query', doc_id::VARCHAR, NULL FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def label_problems(spark, sf_dir):
    """Labels that name a post and, twice, the next one, against documents as posts and sources as topics."""
    key = F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "documents").select(key.alias("id"), F.coalesce("source", F.lit("")).alias("topic_id"))
    nxt = (F.col("doc_id") + 1).cast("string")
    labels = table(spark, sf_dir, "labels").select(key.alias("query_id"), F.array(key, nxt, nxt).alias("post_ids"))
    return E.label_problems(docs.withColumnRenamed("id", "query_id"), labels, docs.withColumnRenamed("id", "post_id"))


@query()
def html_sections(spark, sf_dir):
    return wiki.html_sections(table(spark, sf_dir, "pages"))


@query("SELECT page_id, url_encode(replace(regexp_extract(html, '<title>([^<]*)', 1), ' ', '_')).replace('%28', '(').replace('%29', ')').replace('%7E', '~') AS quoted FROM pages")
def quoted_titles(spark, sf_dir):
    """Titles as parts of addresses."""
    return table(spark, sf_dir, "pages").select("page_id", T.quoted_title(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("quoted"))
