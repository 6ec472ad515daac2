"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.intent import CONFIDENT, DEFAULT, PATTERN_FACTOR, RULES, SCORED, UNSCORED
from parlance.functions.text import collection, language, tokens
from parlance.operators.embedding import DENSE
from parlance.operators import chunks, expand, intent, parsing, render, rerank, search, sessions, turns
from parlance.plans.index import index, indexed_chunks
from parlance.plans.retrieve import retrieve
from parlance.sources import store
from parlance.sources.tables import conversation_messages, shared_folder, spread, table
from parlance.sources.transcripts import EVENT_NAMES, parse_events, rejected, route
from parlance.streaming.events import distinct_events, pending_pairs, run_available

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Every row whose id is divisible by this is a query.
EVERY = 20
#: Of 64 dimensions, as many as 256 are of 1024.
SHORT = 16
LIMIT = search.LIMIT


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# dense and sparse search


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))
    return points, points.where(F.col("id") % EVERY == 0).withColumnRenamed("id", "qid")


def _shown(found: DataFrame) -> DataFrame:
    return found.select("qid", "id", "pos", F.round("score", 6).alias("score"))


_Q = f"q AS (SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id % {EVERY} = 0)"
_COSINE = "round(list_cosine_similarity(q.e{0}::DOUBLE[], p.embedding{0}::DOUBLE[]), 9)"


def _top(source: str, k: int) -> str:
    return f"SELECT qid, id, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS pos FROM ({source})) WHERE pos < {k}"


_SHORT_SQL = _top(f"SELECT q.qid, p.vec_id AS id, {_COSINE.format(f'[1:{SHORT}]')} AS score FROM q, embeddings p", 3 * LIMIT)
_STAGED = f"{_Q}, coarse AS ({_SHORT_SQL}), staged AS ({_top(f'SELECT c.qid, c.id, {_COSINE.format("")} AS score FROM coarse c JOIN q USING (qid) JOIN embeddings p ON p.vec_id = c.id', 2 * LIMIT)})"
_EXACT = f"{_Q}, exact AS ({_top(f'SELECT q.qid, p.vec_id AS id, {_COSINE.format("")} AS score FROM q, embeddings p', 2 * LIMIT)})"


@query(f"WITH {_STAGED} SELECT qid, id, pos, round(score, 6) AS score FROM staged")
def staged_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.staged_dense(*_vectors(spark, sf_dir), LIMIT, SHORT))


@query(f"WITH {_EXACT} SELECT qid, id, pos, round(score, 6) AS score FROM exact")
def dense_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, asked = _vectors(spark, sf_dir)
    return _shown(search.dense_topk(points, asked, 2 * LIMIT, 64))


_TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


@query(
    f"""WITH d AS (SELECT doc_id AS id, t, count(*) AS n FROM (SELECT doc_id, unnest({_TOKENS.format("text")}) AS t FROM documents) GROUP BY ALL),
    b AS (SELECT item_id AS qid, t, count(*) AS n FROM (SELECT item_id, unnest({_TOKENS.format("text")}) AS t FROM benchmark) GROUP BY ALL),
    s AS ({_top("SELECT qid, id, sum(b.n * d.n)::DOUBLE AS score FROM b JOIN d USING (t) GROUP BY qid, id", 2 * LIMIT)})
    SELECT qid, id, pos, score FROM s"""
)
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), tokens(F.col("text")).alias("sparse"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), tokens(F.col("text")).alias("sparse"))
    return search.sparse_topk(docs, asked, 2 * LIMIT).select("qid", "id", "pos", "score")


_SPARSE_DIMS = "SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings"


@query(
    f"""WITH {_STAGED}, dims AS (SELECT * FROM ({_SPARSE_DIMS}) WHERE v > 0.1),
    sparse AS ({_top(f"SELECT a.vec_id AS qid, b.vec_id AS id, round(sum(a.v * b.v), 9) AS score FROM dims a JOIN dims b USING (i) WHERE a.vec_id % {EVERY} = 0 GROUP BY ALL", 2 * LIMIT)}),
    fused AS (SELECT qid, id, round(sum(1.0::DOUBLE / ({search.RRF_K} + pos)), 9) AS score FROM (SELECT qid, id, pos FROM staged UNION ALL SELECT qid, id, pos FROM sparse) GROUP BY qid, id),
    best AS ({_top("SELECT * FROM fused", LIMIT)})
    SELECT qid, id, pos, round(score, 6) AS score FROM best"""
)
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, asked = _vectors(spark, sf_dir)
    entries = F.filter(F.transform("dense", lambda v, i: F.struct(i.alias("key"), v.cast("double").alias("value"))), lambda e: e["value"] > 0.1)
    weights = F.map_from_entries(entries)
    return _shown(search.staged_hybrid(points.withColumn("sparse", weights), asked.withColumn("sparse", weights), LIMIT, SHORT))


_DROP = 0.02


@query(
    f"""WITH {_EXACT}, f AS (SELECT *, coalesce(round(lag(score) OVER w - score, 9) > {_DROP}, false) AS fall FROM exact WINDOW w AS (PARTITION BY qid ORDER BY pos)),
    g AS (SELECT *, max(fall::INT) OVER (PARTITION BY qid ORDER BY pos ROWS UNBOUNDED PRECEDING) AS fallen FROM f)
    SELECT qid, id, pos, round(score, 6) AS score FROM g WHERE pos = 0 OR fallen = 0"""
)
def score_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, asked = _vectors(spark, sf_dir)
    return _shown(rerank.cutoff(search.dense_topk(points, asked, 2 * LIMIT, 64), _DROP, 1, decimals=9))


@query(
    f"""WITH d AS (SELECT doc_id AS id, t, count(*) AS n FROM (SELECT doc_id, unnest({_TOKENS.format("text")}) AS t FROM documents) GROUP BY ALL),
    b AS (SELECT item_id AS qid, t, count(*) AS n FROM (SELECT item_id, unnest({_TOKENS.format("text")}) AS t FROM benchmark) GROUP BY ALL),
    s AS ({_top("SELECT qid, id, sum(b.n * d.n)::DOUBLE AS score FROM b JOIN d USING (t) GROUP BY qid, id", 2 * LIMIT)}),
    o AS (SELECT s.qid, s.id, s.pos, (SELECT count(*) FROM b JOIN d USING (t) WHERE b.qid = s.qid AND d.id = s.id)::DOUBLE / (SELECT count(*) FROM b WHERE b.qid = s.qid) AS share FROM s)
    SELECT qid, id, round(share, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY share DESC, pos) - 1 AS pos FROM o"""
)
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sparse_topk(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return _shown(rerank.rerank(found.join(docs, "id").join(asked, "qid")))


# turns and chunks


_MESSAGES = f"""m AS (SELECT conv_id::VARCHAR AS session_id, turn::INT AS pos, role, rtrim('[text]' || chr(10) || coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS content FROM conversations WHERE role IN ('user', 'assistant')),
    t AS (SELECT *, sum((role = 'user' AND starts_with(content, '[text]'))::INT) OVER (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::INT AS turn_no FROM m),
    n AS (SELECT *, (row_number() OVER (PARTITION BY session_id, turn_no ORDER BY pos) - 1)::INT AS msg_no FROM t)"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_messages(table(spark, sf_dir, "conversations"))


@query(f"WITH {_MESSAGES} SELECT session_id, pos, role, turn_no, msg_no FROM n")
def turn_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.assign_turns(_messages(spark, sf_dir)).select("session_id", "pos", "role", "turn_no", "msg_no")


@query(f"WITH {_MESSAGES}, l AS (SELECT *, max(CASE WHEN role = 'user' THEN pos END) OVER (PARTITION BY session_id) AS last FROM n) SELECT session_id, pos, role, content FROM l WHERE pos >= coalesce(last, 0)")
def last_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.last_turn(_messages(spark, sf_dir)).select("session_id", "pos", "role", "content")


_LINE = r"'[' || upper(role) || '] ' || trim(substr(content, 7), ' ' || chr(9) || chr(10) || chr(13)) || chr(10)"


@query(f"WITH {_MESSAGES} SELECT session_id, turn_no, sha256('conversations:' || session_id || ':' || turn_no) AS chunk_id, string_agg({_LINE}, '' ORDER BY msg_no) AS text FROM n GROUP BY session_id, turn_no")
def context_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.context_chunks(turns.assign_turns(_messages(spark, sf_dir))).select("session_id", "turn_no", "chunk_id", "text")


@query(f"""WITH {_MESSAGES} SELECT session_id, max(turn_no) AS turn_count, count(*) AS message_count, arg_min(substr(content, 8), pos) FILTER (role = 'user') AS first_prompt, min(pos) AS first_pos, max(pos) AS last_pos FROM n GROUP BY session_id""")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_summary(_messages(spark, sf_dir)).select("session_id", "turn_count", "message_count", "first_prompt", "first_pos", "last_pos")


@query(
    f"""WITH {_MESSAGES}, p AS (SELECT session_id, turn_no, max(CASE WHEN msg_no = 0 THEN substr(content, 8) END) AS prompt, coalesce(string_agg(substr(content, 8), chr(10) ORDER BY msg_no) FILTER (role = 'assistant'), '') AS response FROM n WHERE turn_no > 0 GROUP BY ALL)
    SELECT session_id, turn_no, prompt, response, length(prompt) AS prompt_length, length(response) AS response_length, 'Q: ' || prompt || chr(10) || 'A: ' || substr(response, 1, 1000) AS document FROM p"""
)
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.qa_pairs(_messages(spark, sf_dir)).drop("collection")


# intent


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _score_sql(text: str, rule) -> str:
    parts = [f"CASE WHEN contains(lower({text}), {_sql_text(k)}) THEN {rule.weight} ELSE 0 END" for k in rule.keywords]
    parts += [f"CASE WHEN regexp_matches({text}, {_sql_text(p)}, 'i') THEN {rule.weight * PATTERN_FACTOR} ELSE 0 END" for p in rule.patterns]
    return f"({' + '.join(parts)})::DOUBLE"


def _scores_sql(text: str) -> str:
    return ", ".join(f"{_score_sql(text, r)} AS {r.category.lower()}" for r in RULES)


_GREATEST = f"greatest({', '.join(r.category.lower() for r in RULES)})"
_LABEL = "CASE " + " ".join(f"WHEN {_GREATEST} > 0 AND {r.category.lower()} = {_GREATEST} THEN '{r.category}'" for r in RULES) + f" ELSE '{DEFAULT}' END"
_SCORED = f"s AS (SELECT conv_id, turn, {_scores_sql('text')} FROM conversations)"


@query(f"WITH {_SCORED} SELECT * FROM s")
def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intent.rule_scores(spread(table(spark, sf_dir, "conversations"))).drop("role", "text")


@query(f"WITH {_SCORED} SELECT conv_id, turn, {_LABEL} AS category, {_GREATEST} AS confidence FROM s")
def intent_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intent.classify(spread(table(spark, sf_dir, "conversations"))).select("conv_id", "turn", "category", "confidence")


@query(
    f"""WITH {_SCORED} SELECT conv_id, turn, CASE WHEN {_GREATEST} >= {CONFIDENT} THEN {_LABEL} ELSE '{DEFAULT}' END AS category, CASE WHEN {_GREATEST} >= {CONFIDENT} THEN {_GREATEST} ELSE 0 END AS confidence,
    CASE WHEN {_GREATEST} >= {CONFIDENT} THEN 'rule_based' ELSE 'llm_based' END AS method FROM s"""
)
def intent_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intent.cascade(spread(table(spark, sf_dir, "conversations"))).select("conv_id", "turn", "category", "confidence", "method")


#: Prompts of each category in both languages, a tie and one without a hit.
PROMPTS = (
    "Please write a function that parses dates", "generate a python script and build an API", "로그인 함수를 만들어 줘", "새 클래스를 구현해 주세요",
    "refactor this function to improve performance", "optimize and simplify the logic", "이 코드를 개선하고 최적화해 줘", "함수를 깔끔하게 리팩토링",
    "I get a TypeError, please fix the bug", "the app crashed and it's not working", "에러가 발생했어요 고쳐 주세요", "실행이 안 됨, 버그 해결",
    "what is a closure?", "explain the difference between a list and a tuple", "제너레이터가 뭐야", "차이를 설명해 줘",
    "hello!", "thank you", "안녕하세요", "고마워 ㅎㅎ", "fix the error then what is a generator and how to use it", "create refactor", "zzz", "",
)


@query(f"WITH p AS (SELECT unnest(range({len(PROMPTS)}))::INT AS n, unnest([{', '.join(map(_sql_text, PROMPTS))}]) AS prompt), s AS (SELECT n, prompt, {_scores_sql('prompt')} FROM p) SELECT n, prompt, {_LABEL} AS category, {_GREATEST} AS confidence, CASE WHEN {_GREATEST} > 0 THEN printf('{SCORED}', {_GREATEST}) ELSE '{UNSCORED}' END AS reasoning FROM s")
def intent_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(PROMPTS)), "n int, prompt string")
    return intent.classify(rows, "prompt").select("n", "prompt", "category", "confidence", "reasoning")


# expansion: users are parents, their events children, event types files


def _event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    own = events.select(F.concat(F.lit("e"), "event_id").alias("chunk_id"), F.concat(F.lit("u"), "user_id").alias("parent_id"), F.col("event_type").alias("file_path"), F.col("event_id").alias("chunk_no"))
    users = events.select(F.concat(F.lit("u"), "user_id").alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("file_path"), F.col("user_id").alias("chunk_no")).distinct()
    return own.unionByName(users)


def _event_seeds(points: DataFrame) -> DataFrame:
    return points.where(F.col("parent_id").isNotNull() & (F.col("chunk_no") % EVERY == 0)).select(F.col("chunk_no").alias("qid"), "chunk_id", "parent_id", "file_path", F.lit(0).alias("pos"))


_POINTS = """p AS (SELECT 'e' || event_id AS chunk_id, 'u' || user_id AS parent_id, event_type AS file_path, event_id AS place FROM events
    UNION ALL SELECT DISTINCT 'u' || user_id, NULL, NULL, user_id FROM events)"""
_SEEDS = f"s AS (SELECT place AS qid, chunk_id, parent_id, file_path FROM p WHERE parent_id IS NOT NULL AND place % {EVERY} = 0)"
_FIRST = "SELECT chunk_id, parent_id, file_path, place, row_number() OVER (PARTITION BY {0} ORDER BY place, chunk_id) AS rn FROM p WHERE parent_id IS NOT NULL"


@query(f"WITH {_POINTS}, {_SEEDS} SELECT s.qid, s.chunk_id AS seed, p.chunk_id, p.place FROM s JOIN p ON p.chunk_id = s.parent_id")
def expand_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _event_points(spark, sf_dir)
    return expand.to_parent(_event_seeds(points), points)


@query(f"WITH {_POINTS}, c AS ({_FIRST.format('parent_id')}) SELECT u.place AS qid, u.chunk_id AS seed, c.chunk_id, c.place FROM p u JOIN c ON c.parent_id = u.chunk_id WHERE u.parent_id IS NULL AND rn <= 50")
def expand_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _event_points(spark, sf_dir)
    users = points.where("parent_id is null").select(F.col("chunk_no").alias("qid"), "chunk_id", "parent_id", "file_path", F.lit(0).alias("pos"))
    return expand.to_children(users, points)


@query(f"WITH {_POINTS}, {_SEEDS}, c AS ({_FIRST.format('parent_id')}) SELECT s.qid, s.chunk_id AS seed, c.chunk_id, c.place FROM s JOIN c USING (parent_id) WHERE rn <= 50 AND c.chunk_id <> s.chunk_id")
def expand_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _event_points(spark, sf_dir)
    return expand.to_siblings(_event_seeds(points), points)


@query(f"WITH {_POINTS}, {_SEEDS}, c AS ({_FIRST.format('parent_id, file_path')}) SELECT s.qid, s.chunk_id AS seed, c.chunk_id, c.place FROM s JOIN c USING (parent_id, file_path) WHERE rn <= 50")
def expand_same_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _event_points(spark, sf_dir)
    return expand.same_file(_event_seeds(points), points)


@query(
    f"""WITH {_POINTS}, {_SEEDS}, byfile AS ({_FIRST.format("parent_id, file_path")}), bypar AS ({_FIRST.format("parent_id")}),
    a AS (SELECT qid, chunk_id, 0 AS g, 0 AS b, 0 AS c, 0::BIGINT AS d, 'seed' AS via FROM s
      UNION ALL SELECT qid, parent_id, 0, 1, 0, 0, 'seed' FROM s
      UNION ALL SELECT s.qid, s.parent_id, 1, 0, 0, p.place, 'parent' FROM s JOIN p ON p.chunk_id = s.parent_id
      UNION ALL SELECT s.qid, f.chunk_id, 1, 0, 1, f.place, 'file' FROM s JOIN byfile f USING (parent_id, file_path) WHERE rn <= 50
      UNION ALL SELECT s.qid, f.chunk_id, 1, 1, 2, f.place, 'child' FROM s JOIN bypar f USING (parent_id) WHERE rn <= 50),
    o AS (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY g, b, c, d, via) AS k FROM a)
    SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY g, b, c, d, via, chunk_id) - 1 AS ord, via FROM o WHERE k = 1"""
)
def expand_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds: an event, and then its user."""
    points = _event_points(spark, sf_dir)
    coded = _event_seeds(points)
    told = coded.select("qid", F.col("parent_id").alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("file_path"), F.lit(1).alias("pos"))
    return expand.expand(coded.unionByName(told), points)


# store


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src3' AND n_chars > 1000")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where(store.match({"lang": "en", "source": "src3", "type": None}) & store.where({"n_chars": {"$gt": 1000}})).select("doc_id", "lang", "source", "n_chars")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return store.last_write(events, ["user_id"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("SELECT source AS collection, count(*) AS total_points FROM documents GROUP BY source")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.collection_stats(table(spark, sf_dir, "documents").withColumnRenamed("source", "collection"))


# rendering


_CONTEXT = """c AS (SELECT conv_id, '<context>' || chr(10) || string_agg('<document index="' || i || '" source="' || CASE WHEN role = 'assistant' THEN 'notes/' || turn || '.md' ELSE 'snippet_' || i END || '">' || chr(10) || coalesce(text, '') || chr(10) || '</document>' || chr(10), '' ORDER BY turn) || '</context>' AS context
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) GROUP BY conv_id)"""


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("role") == "assistant", F.concat(F.lit("notes/"), "turn", F.lit(".md")))
    return render.render(table(spark, sf_dir, "conversations").select("conv_id", "turn", path.alias("file_path"), "text"), ["conv_id"], "turn")


@query(f"WITH {_CONTEXT} SELECT * FROM c")
def render_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(spark, sf_dir)


@query(f"""WITH {_CONTEXT} SELECT conv_id, json_object('hookSpecificOutput', json_object('hookEventName', 'UserPromptSubmit', 'additionalContext', '{render.FOUND.strip()}' || chr(10) || context))::VARCHAR AS answer FROM c""")
def hook_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(spark, sf_dir).select("conv_id", render.answer(F.col("context")).alias("answer"))


# paths and events


PATHS = ("a/b/x.py", "x.PY", "dir.d/Main.java", "p/q.cs", "w/app.ts", "w/app.js", ".py", "..py", "a.b/c", "readme", "x.tar.py", "x.py.txt", "", "/.ts", "deep/er/.hidden.js")
_PATH_ROWS = f"SELECT unnest([{', '.join(map(_sql_text, PATHS))}]) AS path"


@query(
    rf"""SELECT path, CASE lower(regexp_extract(path, '[^/.][^/]*?(\.[^./]*)$', 1)) WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.cs' THEN 'csharp' WHEN '.ts' THEN 'typescript' WHEN '.js' THEN 'typescript' END AS language,
    coalesce(CASE WHEN len(string_split(path, '/')) >= 2 THEN string_split(path, '/')[-2] END, '') AS collection FROM ({_PATH_ROWS})"""
)
def language_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(p,) for p in PATHS], "path string")
    return rows.select("path", language(F.col("path")).alias("language"), collection(F.col("path")).alias("collection"))


EVENTS = (
    {"hook_event_name": "Stop", "session_id": "s1", "transcript_path": "/t/proj/a.jsonl"},
    {"hook_event_name": "Stop", "session_id": "s2", "transcript_path": "/t/proj/b.jsonl", "stop_hook_active": True},
    {"hook_event_name": "Stop", "session_id": "", "transcript_path": "/t/proj/b.jsonl"},
    {"hook_event_name": "UserPromptSubmit", "session_id": "s1", "transcript_path": "/t/proj/a.jsonl", "prompt": "how?"},
    {"hook_event_name": "UserPromptSubmit", "session_id": "s4", "transcript_path": "/t/proj/a.jsonl"},
    {"hook_event_name": "SessionEnd", "session_id": "s1", "transcript_path": "/t/other/a.jsonl"},
    {"hook_event_name": "SessionEnd", "session_id": "s5"},
    {"hook_event_name": "Other", "session_id": "s6", "transcript_path": "/t/x/a.jsonl"},
)


@query(
    f"""WITH e AS (SELECT j->>'hook_event_name' AS name, j->>'session_id' AS session_id, j->>'transcript_path' AS path, j->>'prompt' AS prompt, coalesce((j->>'stop_hook_active')::BOOLEAN, false) AS active FROM (SELECT unnest([{", ".join(_sql_text(json.dumps(e)) for e in EVENTS)}])::JSON AS j))
    SELECT name AS hook_event_name, session_id, CASE WHEN name NOT IN ('UserPromptSubmit', 'Stop', 'SessionEnd') THEN 'unknown event' WHEN name = 'Stop' AND active THEN 'stop hook active' WHEN coalesce(session_id, '') = '' THEN 'missing session_id'
    WHEN coalesce(path, '') = '' THEN 'missing transcript_path' WHEN name = 'UserPromptSubmit' AND coalesce(prompt, '') = '' THEN 'missing prompt' ELSE 'to ' || string_split(path, '/')[-2] END AS outcome FROM e"""
)
def event_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.createDataFrame([(json.dumps(e),) for e in EVENTS] + [("",), ("not json",)], "value string")
    events = parse_events(raw)
    out = rejected(events).select("hook_event_name", "session_id", F.col("reason").alias("outcome"))
    for name in EVENT_NAMES:
        out = out.unionByName(route(events, name).select("hook_event_name", "session_id", F.concat(F.lit("to "), "collection").alias("outcome")))
    return out


# transcripts with blocks and code: no table has them, so they come with the query


def transcript_lines() -> list[str]:
    """Lines of a transcript with every kind of block, and lines that give nothing."""
    code = "\n\n".join(f"def f{i}(x):\n    total = {i}\n    for k in range(x):\n        total += k * {i}\n    return total" for i in range(40))
    said = lambda role, content: json.dumps({"timestamp": "t", "message": {"role": role, "content": content}})
    return [
        said("user", "write a parser"),
        '{"type": "mode"}',
        said("assistant", [{"type": "text", "text": "Sure."}, {"type": "tool_use", "name": "Read", "input": {"file_path": "p/a.py"}}]),
        said("assistant", [{"type": "tool_use", "name": "Write", "input": {"file_path": "p/a.py", "content": code, "n": 1, "ok": True}}]),
        said("user", [{"type": "tool_result", "content": "ok"}, {"type": "tool_result", "content": ["a", 1, None]}]),
        said("assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "Done."}]),
        said("user", [{"type": "image"}, {"type": "text", "text": "and this?"}]),
        said("system", "ignored"),
        said("user", [{"type": "text", "text": "now in java"}]),
        said("assistant", [{"type": "tool_use", "name": "Write", "input": {"file_path": "M.java", "content": "class M {\n  int f() {\n    return 1;\n  }\n}"}}]),
        said("assistant", [{"type": "tool_use", "name": "Write", "input": {"file_path": "n.txt", "content": "plain text"}}]),
        said("assistant", [{"type": "tool_use", "name": "Write", "input": {"file_path": "empty.py", "content": "  "}}]),
        "not json", "3", '{"message": null}', said("user", "   "), said("assistant", None),
    ]


def _transcript(spark: SparkSession) -> DataFrame:
    rows = [("proj", "s1", i, x) for i, x in enumerate(transcript_lines())]
    return spark.createDataFrame(rows, "collection string, session_id string, pos int, line string")


_PYTHON = "CASE coalesce(json_type(x), 'NULL') WHEN 'VARCHAR' THEN x->>'$' WHEN 'BOOLEAN' THEN upper((x::VARCHAR)[1]) || (x::VARCHAR)[2:] WHEN 'NULL' THEN 'None' ELSE x::VARCHAR END"
_PARSED = f"""lines AS (SELECT unnest(range({len(transcript_lines())}))::INT AS pos, unnest([{", ".join(map(_sql_text, transcript_lines()))}]) AS line),
    objects AS (SELECT pos, line::JSON AS j FROM lines WHERE json_valid(line)),
    said AS (SELECT pos, j->>'timestamp' AS timestamp, j->'message'->>'role' AS role, j->'message'->'content' AS c FROM objects WHERE json_type(j->'message') = 'OBJECT'),
    blocks AS (SELECT pos, role, unnest(c::JSON[]) AS b, unnest(range(json_array_length(c)::BIGINT)) AS i FROM said WHERE json_type(c) = 'ARRAY'),
    items AS (SELECT pos, i, unnest((b->'content')::JSON[]) AS x, unnest(range(json_array_length(b->'content')::BIGINT)) AS k FROM blocks WHERE b->>'type' = 'tool_result' AND json_type(b->'content') = 'ARRAY'
      UNION ALL SELECT pos, i, json_extract(b->'input', '$."' || key || '"'), k FROM (SELECT *, unnest(json_keys(b->'input')) AS key, unnest(range(len(json_keys(b->'input'))::BIGINT)) AS k FROM blocks WHERE b->>'type' = 'tool_use')),
    told AS (SELECT pos, i, string_agg({_PYTHON} || chr(10), '' ORDER BY k) AS told FROM items GROUP BY ALL),
    parts AS (SELECT pos, -1 AS i, '[text]' || chr(10) || (c->>'$') AS part FROM said WHERE role = 'user' AND json_type(c) = 'VARCHAR'
      UNION ALL SELECT pos, i, CASE WHEN b->>'type' = 'text' AND role IN ('user', 'assistant') THEN '[text]' || chr(10) || coalesce(b->>'text', '') || chr(10)
        WHEN role = 'user' AND b->>'type' = 'tool_result' THEN '[tool_result]' || chr(10) || CASE WHEN json_type(b->'content') = 'VARCHAR' THEN (b->>'content') || chr(10) ELSE coalesce(told, '') END
        WHEN role = 'user' AND b->>'type' = 'image' THEN '[Image Attached]' || chr(10) WHEN role = 'assistant' AND b->>'type' = 'thinking' THEN '[thinking]' || chr(10) || coalesce(b->>'thinking', '')
        WHEN role = 'assistant' AND b->>'type' = 'tool_use' THEN '[' || (b->>'name') || ']' || chr(10) || coalesce(told, '') ELSE '' END FROM blocks LEFT JOIN told USING (pos, i)),
    messages AS (SELECT 'proj' AS collection, 's1' AS session_id, pos, timestamp, role, trim(string_agg(part, '' ORDER BY i), ' ' || chr(9) || chr(10) || chr(13)) AS content FROM parts JOIN said USING (pos) GROUP BY ALL HAVING content <> '')"""


@query(f"WITH {_PARSED} SELECT * FROM messages")
def json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_lines(_transcript(spark))


@query()
def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.process_turns(turns.assign_turns(parsing.parse_lines(_transcript(spark))))


# whole paths


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder among those that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


@query(
    f"""WITH {_MESSAGES}, c AS (SELECT session_id, turn_no, string_agg({_LINE}, '' ORDER BY msg_no) AS text FROM n GROUP BY ALL), s AS (SELECT session_id, turn_no, text, {_scores_sql("text")} FROM c)
    SELECT session_id, turn_no, 0 AS chunk_no, sha256('conversations:' || session_id || ':' || turn_no) AS chunk_id, CASE WHEN {_GREATEST} >= {CONFIDENT} THEN {_LABEL} ELSE '{DEFAULT}' END AS type, {DENSE} AS n_dense, len(list_distinct({_TOKENS.format("text")})) AS n_sparse FROM s"""
)
def index_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed_chunks(_messages(spark, sf_dir)).select("session_id", "turn_no", "chunk_no", "chunk_id", "type", F.size("dense").alias("n_dense"), F.size("sparse").alias("n_sparse"))


_RETRIEVED = f"""c AS (SELECT session_id, turn_no, sha256('conversations:' || session_id || ':' || turn_no) AS id, string_agg({_LINE}, '' ORDER BY msg_no) AS text FROM n GROUP BY ALL),
    a AS (SELECT conv_id || ':' || turn AS qid, coalesce(text, '') AS text FROM conversations WHERE role = 'user' AND conv_id % {EVERY} = 0),
    x AS (SELECT 'p' AS side, id AS k, text FROM c UNION ALL SELECT 'q', qid, text FROM a),
    t AS MATERIALIZED (SELECT side, k, unnest({_TOKENS.format("text")}) AS t FROM x),
    h AS MATERIALIZED (SELECT side, k, ('0x' || substr(md5(t), 1, 8))::BIGINT & 2147483647 AS h FROM t),
    w AS MATERIALIZED (SELECT side, k, h, ln(1 + count(*))::FLOAT::DOUBLE AS w FROM h GROUP BY ALL),
    e AS (SELECT side, k, h AS part, 256 AS width FROM h UNION ALL SELECT side, k, h >> 7, 1024 FROM h),
    g AS (SELECT side, k, part % width AS i, sum(CASE WHEN (part // width) % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS v FROM e GROUP BY ALL),
    l AS (SELECT side, k, sqrt(sum(v * v)) AS n FROM g GROUP BY ALL),
    d AS MATERIALIZED (SELECT side, k, i, (v / n)::FLOAT::DOUBLE AS v FROM g JOIN l USING (side, k) WHERE n > 0),
    z AS (SELECT side, k, sqrt(sum(v * v) FILTER (i < 256)) AS short, sqrt(sum(v * v)) AS long FROM d GROUP BY ALL),
    dot AS MATERIALIZED (SELECT q.k AS qid, p.k AS id, sum(q.v * p.v) FILTER (q.i < 256) AS short, sum(q.v * p.v) AS long FROM d q JOIN d p ON q.i = p.i AND q.side = 'q' AND p.side = 'p' GROUP BY ALL),
    every AS (SELECT a.k AS qid, b.k AS id, round(coalesce(dot.short / (a.short * b.short), 0), 9) AS short, round(coalesce(dot.long / (a.long * b.long), 0), 9) AS long FROM z a JOIN z b ON a.side = 'q' AND b.side = 'p' LEFT JOIN dot ON dot.qid = a.k AND dot.id = b.k),
    coarse AS ({_top("SELECT qid, id, short AS score FROM every", search.SHORT_FACTOR * LIMIT)}),
    dense AS ({_top("SELECT qid, id, long AS score FROM every WHERE (qid, id) IN (SELECT (qid, id) FROM coarse)", search.LONG_FACTOR * LIMIT)}),
    sparse AS ({_top("SELECT q.k AS qid, p.k AS id, round(sum(q.w * p.w), 9) AS score FROM w q JOIN w p ON q.h = p.h AND q.side = 'q' AND p.side = 'p' GROUP BY ALL", search.LONG_FACTOR * LIMIT)}),
    fused AS ({_top(f"SELECT qid, id, round(sum(1.0::DOUBLE / ({search.RRF_K} + pos)), 9) AS score FROM (SELECT qid, id, pos FROM dense UNION ALL SELECT qid, id, pos FROM sparse) GROUP BY qid, id", LIMIT)}),
    u AS (SELECT DISTINCT * FROM t),
    shares AS (SELECT qid, id, pos, (SELECT count(*) FROM u q JOIN u p USING (t) WHERE q.side = 'q' AND p.side = 'p' AND q.k = qid AND p.k = id)::DOUBLE / (SELECT count(*) FROM u WHERE side = 'q' AND k = qid) AS share FROM fused),
    ranks AS (SELECT qid, id, row_number() OVER r AS rn, coalesce(lag(share) OVER r - share, 0) > {rerank.DROP} AS fall FROM shares WINDOW r AS (PARTITION BY qid ORDER BY share DESC, pos)),
    kept AS (SELECT qid, id, rn, max(fall::INT) OVER (PARTITION BY qid ORDER BY rn ROWS UNBOUNDED PRECEDING) AS fallen FROM ranks)"""


@query(f"WITH {_MESSAGES.replace('t AS (', 'turned AS (').replace('FROM t)', 'FROM turned)')}, {_RETRIEVED} SELECT qid, id AS chunk_id, rn - 1 AS ord, 'seed' AS via FROM kept WHERE rn <= {rerank.LEAST} OR fallen = 0")
def retrieve_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every prompt of the conversations whose id is divisible by EVERY: what the index of all conversations gives."""
    kept = store.ChunkStore(spark, _folder(spark, "chunks"))
    index(_messages(spark, sf_dir), kept, 0)
    points = kept.points()
    asked = table(spark, sf_dir, "conversations").where((F.col("role") == "user") & (F.col("conv_id") % EVERY == 0))
    asked = asked.select(F.concat_ws(":", "conv_id", "turn").alias("qid"), F.lit("conversations").alias("collection"), F.col("text").alias("prompt"))
    return retrieve(points, asked).select("qid", "chunk_id", "ord", "via")


@query(
    """WITH k AS (SELECT user_id, event_id, row_number() OVER w AS rn, CASE event_type WHEN 'view' THEN 'prompt' WHEN 'purchase' THEN 'stop' END AS kind, props FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    l AS (SELECT *, max(CASE WHEN kind = 'prompt' THEN rn END) OVER (PARTITION BY user_id ORDER BY rn) AS last_prompt, max(CASE WHEN kind = 'stop' THEN rn END) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_stop FROM k)
    SELECT l.user_id::VARCHAR AS session_id, p.event_id AS prompt_id, p.props AS prompt, l.event_id AS stop_id FROM l JOIN k p ON p.user_id = l.user_id AND p.rn = l.last_prompt WHERE l.kind = 'stop' AND l.last_prompt > coalesce(l.last_stop, 0)"""
)
def stream_pending_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are prompts and purchases stops. The stream reads all of events once and writes to the session's shared folder."""
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, as a stream's plain path must be a folder
    kind = F.when(F.col("event_type") == "view", "prompt").when(F.col("event_type") == "purchase", "stop")
    events = stream.select(F.col("user_id").cast("string").alias("session_id"), kind.alias("kind"), "event_id", "ts", F.col("props").alias("prompt")).where("kind is not null")
    folder = _folder(spark, "pairs")
    run_available(pending_pairs(events), f"{folder}/rows", f"{folder}/state")
    return spark.read.schema("session_id string, prompt_id long, prompt string, stop_id long").parquet(f"{folder}/rows")


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_id) AS rn FROM events) WHERE rn = 1")
def stream_distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events come twice; each goes on once."""
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*").select("event_id", "ts", "user_id", "event_type", "value")
    folder = _folder(spark, "distinct")
    run_available(distinct_events(events.unionAll(events).withColumn("ts", F.col("ts").cast("timestamp")), ["event_id"]).drop("ts"), f"{folder}/rows", f"{folder}/state")
    return spark.read.schema("event_id long, user_id long, event_type string, value double").parquet(f"{folder}/rows")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_dense_topk(spark, sf_dir)
