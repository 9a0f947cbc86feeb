"""Queries: threads, chats, forum chunks, answer candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ForumChunks
from ..functions import text as T
from ..operators import chunking as C
from ..operators import evaluation as E
from ..operators import threads as H
from .corpus import BUDGET_SQL
from .registry import query, table

#: Budgets that no post of the test tables exceeds, so that SQL can express what is left: where a split begins, `long_post_chunks` goes on.
WIDE = ForumChunks(max_tokens=4000, previous_context_tokens=3000)
TOK = f"len(regexp_extract_all(%s, '{BUDGET_SQL}'))"


def posts(spark, sf_dir):
    """Conversations as posts: a topic per conversation, a post per turn."""
    c = table(spark, sf_dir, "conversations")
    name = F.concat_ws("-", "conv_id", "turn")
    return c.select(F.col("conv_id").cast("string").alias("topic_id"), F.concat(F.lit("topic "), "conv_id").alias("topic_title"), name.alias("post_id"), F.col("turn").cast("int").alias("post_number"), F.lit("").alias("posted_at"), "role", F.coalesce("text", F.lit("")).alias("text"))


@query("""WITH p AS (SELECT conv_id, role, conv_id || '-' || turn AS post_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations),
seeds AS (SELECT conv_id, min(position) AS pos FROM p WHERE role = 'user' GROUP BY conv_id), s AS (SELECT conv_id, conv_id AS seed_rank, slot, pos + off AS position FROM seeds, (VALUES (0, 0), (1, 1), (2, 2), (3, -1)) AS v(slot, off))
SELECT p.post_id, p.conv_id::VARCHAR AS topic_id, p.position::INT AS position, (row_number() OVER (ORDER BY seed_rank, slot))::BIGINT AS rank FROM s JOIN p USING (conv_id, position)""")
def thread_neighbours(spark, sf_dir):
    """The first user post of each topic with its neighbours; a seed that is no post gives none."""
    rows = H.with_previous(posts(spark, sf_dir), "post_id")
    first = rows.where("role = 'user'").groupBy("topic_id").agg(F.min_by("post_id", "position").alias("post_id"))
    seeds = first.select("post_id", F.col("topic_id").cast("long").alias("seed_rank"))
    lost = spark.createDataFrame([("none-1", 0)], "post_id string, seed_rank bigint")
    return H.expand(rows, seeds.union(lost))


@query(f"""SELECT conv_id::VARCHAR AS topic_id, turn::INT AS post_number, CASE WHEN {TOK % "coalesce(text, '')"} < 40 THEN lag(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) END AS context FROM conversations""")
def short_reply_context(spark, sf_dir):
    """The post before each short one."""
    rows = H.with_previous(posts(spark, sf_dir), "text")
    return rows.select("topic_id", "post_number", F.when(T.token_count(F.col("text")) < ForumChunks().short_post_tokens, F.col("previous.text")).alias("context"))


STRIP = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"
FORUM = f"""WITH p AS (SELECT conv_id, turn, {STRIP} AS text FROM conversations), q AS (SELECT *, lag(text) OVER w AS prev, lag(turn) OVER w AS pturn, {TOK % "text"} AS tok FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, CASE WHEN tok < 40 AND prev IS NOT NULL THEN 'short_with_previous' WHEN tok < 40 THEN 'short_without_previous' ELSE 'whole_post' END AS strategy FROM q),
c AS (SELECT 'forum:' || conv_id || ':' || conv_id || '-' || turn || ':0' AS chunk_id, conv_id::VARCHAR AS topic_id, strategy, CASE WHEN strategy = 'short_with_previous'
 THEN 'Topic: topic ' || conv_id || chr(10) || chr(10) || 'Previous post #' || pturn || ':' || chr(10) || prev || chr(10) || chr(10) || 'Current post #' || turn || ':' || chr(10) || text
 ELSE 'Topic: topic ' || conv_id || chr(10) || chr(10) || 'Post #' || turn || ':' || chr(10) || text END AS text FROM r), d AS (SELECT *, {TOK % "text"}::INT AS token_count FROM c)
"""


@query(FORUM + "SELECT chunk_id, topic_id, strategy, text, token_count FROM d")
def forum_chunks(spark, sf_dir):
    """Chunks of the conversations, none split."""
    return C.forum_chunks(posts(spark, sf_dir), WIDE).select("chunk_id", "topic_id", "strategy", "text", "token_count")


@query(FORUM + "SELECT strategy, count(*)::BIGINT AS n, sum(token_count)::BIGINT AS tokens FROM d GROUP BY strategy")
def chunk_strategies(spark, sf_dir):
    return C.strategy_counts(C.forum_chunks(posts(spark, sf_dir), WIDE))


@query(FORUM + "SELECT count(DISTINCT topic_id)::BIGINT AS topics, count(*)::BIGINT AS chunks, count(*)::BIGINT AS dense, 0::BIGINT AS dump_chunks, sum(token_count)::BIGINT AS tokens FROM d")
def forum_manifest(spark, sf_dir):
    return C.chunk_manifest(C.forum_chunks(posts(spark, sf_dir), WIDE)).select("topics", "chunks", "dense", "dump_chunks", "tokens")


@query(" UNION ALL ".join(f"SELECT {x}::INT AS short_post_tokens, * FROM (" + FORUM.replace("tok < 40", f"tok < {x}") + "SELECT strategy, count(*)::BIGINT AS n, sum(token_count)::BIGINT AS tokens FROM d GROUP BY strategy)" for x in (20, 40)))
def policy_sweep(spark, sf_dir):
    """Strategies and tokens under two limits for short posts."""
    return C.policy_sweep(posts(spark, sf_dir), [20, 40], WIDE)


@query()
def long_post_chunks(spark, sf_dir):
    """Documents as posts of their source, long ones split."""
    docs = table(spark, sf_dir, "documents")
    as_posts = docs.select(F.coalesce("source", F.lit("none")).alias("topic_id"), F.coalesce("source", F.lit("none")).alias("topic_title"), F.col("doc_id").cast("string").alias("post_id"), F.col("doc_id").cast("int").alias("post_number"), F.lit("").alias("posted_at"), F.coalesce("text", F.lit("")).alias("text"))
    return C.forum_chunks(as_posts)


@query()
def document_chunks(spark, sf_dir):
    """All documents in chunks of 512 tokens that overlap by 64."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit("file").alias("source_type"), F.create_map(F.lit("file_name"), F.coalesce("source", F.lit(""))).alias("metadata"))
    return C.chunk_documents(docs).select("chunk_id", "doc_id", "chunk_index", "text", "source")


WINDOWS = """WITH b AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 10 MINUTE, false)::INT AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM b), u AS (SELECT *, (row_number() OVER (PARTITION BY user_id, s ORDER BY event_id) - 1) // 20 AS u FROM s),
n AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY s, u) AS window_no FROM u)
"""


@query(WINDOWS + "SELECT user_id, window_no::INT AS window_no, count(*)::BIGINT AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM n GROUP BY 1, 2")
def chat_sessions_gap_cap(spark, sf_dir):
    """Windows in order of arrival; a step back in time is no gap."""
    rows = H.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return rows.groupBy("user_id", "window_no").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END"


@query(WINDOWS + f""", i AS (SELECT *, {ISO} AS iso FROM n)
SELECT user_id, window_no::INT AS window_no, user_id || '/' || substr(arg_min(iso, event_id), 1, 10) || '/window-' || printf('%05d', window_no) AS name, arg_min(iso, event_id) AS start_time, arg_max(iso, event_id) AS end_time,
array_to_string(list_sort(list_distinct(list(event_type))), ',') AS participants, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS message_ids, string_agg('[' || iso || '] ' || event_type || ': ' || props, chr(10) ORDER BY event_id) AS text FROM i GROUP BY user_id, window_no""")
def chat_window_documents(spark, sf_dir):
    """Windows as documents: events as messages, their type as sender."""
    rows = H.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    messages = rows.select("user_id", F.col("event_id").alias("ordinal"), F.col("event_id").cast("string").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("sender"), F.col("props").alias("text"), "window_no")
    out = H.window_documents(messages, "user_id")
    return out.select("user_id", "window_no", "name", "start_time", "end_time", F.array_join("participants", ",").alias("participants"), F.array_join("message_ids", ",").alias("message_ids"), "text")


@query("SELECT user_id, printf('participant_%04d', row_number() OVER (ORDER BY min(event_id), user_id)) AS alias FROM events GROUP BY user_id")
def sender_alias(spark, sf_dir):
    return H.aliases(table(spark, sf_dir, "events"), "user_id", "event_id")


@query("WITH a AS (SELECT user_id, printf('participant_%04d', row_number() OVER (ORDER BY min(event_id), user_id)) AS alias FROM events GROUP BY user_id) SELECT event_id, alias FROM events JOIN a USING (user_id)")
def anonymised_events(spark, sf_dir):
    return H.anonymised(table(spark, sf_dir, "events"), "user_id", "event_id").select("event_id", "alias")


@query("WITH s AS (SELECT conv_id, max(turn) AS most FROM conversations WHERE turn < 2 GROUP BY conv_id) SELECT c.conv_id, c.turn, (row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) + coalesce(most, 0))::BIGINT AS post_number FROM conversations c LEFT JOIN s USING (conv_id) WHERE c.turn >= 2")
def continued_numbers(spark, sf_dir):
    """Numbers of later turns that go on from the largest stored one."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    stored = c.where("turn < 2").select("conv_id", F.col("turn").alias("post_number"))
    return H.continued(c.where("turn >= 2"), stored, "conv_id", ["turn"]).withColumn("post_number", F.col("post_number").cast("bigint"))


CANDIDATES = """WITH p AS (SELECT conv_id AS q, conv_id || '-' || turn AS post_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
r AS (SELECT * FROM p WHERE pos > 1), qt AS (SELECT q, term, count(*) AS qn FROM (SELECT q, unnest(t) AS term FROM p WHERE pos = 1) GROUP BY ALL), st AS (SELECT q, count(*) AS n, avg(len(t)) AS avgdl FROM r GROUP BY q),
tf AS (SELECT q, post_id, dl, term, count(*) AS tf FROM (SELECT q, post_id, len(t) AS dl, unnest(t) AS term FROM r) GROUP BY ALL),
raw AS (SELECT q, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf JOIN st USING (q) GROUP BY q, term, n), mean AS (SELECT q, avg(raw) AS m FROM raw GROUP BY q),
idf AS (SELECT q, term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * m ELSE raw END AS idf FROM raw JOIN mean USING (q)),
sc AS (SELECT q, post_id, sum(qn * idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))) AS s FROM tf JOIN qt USING (q, term) JOIN idf USING (q, term) JOIN st USING (q) GROUP BY ALL),
x AS (SELECT r.q, r.post_id, turn, round(coalesce(s, 0), 6) AS review_score FROM r LEFT JOIN sc USING (q, post_id)),
y AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY review_score DESC, turn, post_id) AS best, row_number() OVER (PARTITION BY q ORDER BY turn, post_id) AS early FROM x)
SELECT q::BIGINT AS query_id, post_id, review_score, CASE WHEN best <= 2 THEN 'bm25' ELSE 'early_reply' END AS candidate_reason, (row_number() OVER (PARTITION BY q ORDER BY review_score DESC, turn, post_id))::INT AS place FROM y WHERE best <= 2 OR early <= 1"""


@query(CANDIDATES)
def answer_candidates(spark, sf_dir):
    """For each topic the first post as question: the two best replies and the earliest one."""
    p = H.with_previous(posts(spark, sf_dir), "post_id")
    first = p.where("position = 0").select(F.col("topic_id").cast("bigint").alias("query_id"), "topic_id", F.col("text").alias("question"), F.array("post_id").alias("source_ids"))
    return E.rank_candidates(first, p.drop("previous", "position"), top_k=2, early_replies=1)
