"""Queries over label planning, answers, cost and rater agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.numbers import half_up
from tideline.operators import labeling, planning
from tideline.operators.ledger import Ledger, answered
from tideline.plans.catalog import query
from tideline.plans.frames import with_ctes
from tideline.session import scratch_path, written

CONFIG = 1
LIMIT, SPIKE, LEAST = 2, 4, 3
PRICES = {"input": 0.3, "output": 1.2, "input_cached": 0.03}
PROMPT_CHARS = 5500


def candidates(t, **limits):
    return planning.candidate_reviews(t.t_fact, t.games, t.t_text, t.t_version, t.t_label, CONFIG, **limits)


CANDIDATES = """
    SELECT app_id, recommendation_id, CAST(created_at AS DATE) AS day, length, status
    FROM (SELECT recommendation_id, md5(coalesce(review_body, '')) AS text_hash, CAST(length(trim(coalesce(review_body, ''), ' ')) AS INT) AS length FROM t_text)
    JOIN t_fact USING (recommendation_id) JOIN (SELECT game_sk, app_id FROM p_game) USING (game_sk)
    LEFT JOIN (SELECT recommendation_id, text_hash, status FROM t_version JOIN t_label USING (review_text_sk) WHERE llm_config_sk = 1)
        USING (recommendation_id, text_hash)"""
NEEDED = ("t_fact", "p_game", "t_text", "t_version", "t_label")
CONTENT = f"SELECT app_id, day, count(*) AS content FROM ({CANDIDATES}) WHERE length >= 20 GROUP BY 1, 2"
SPIKES = f"""
    SELECT app_id, day, content, median, spike, CAST(CASE WHEN spike THEN {SPIKE} ELSE {LIMIT} END AS INT) AS day_limit FROM (
        SELECT *, coalesce(content >= 2.0 * median AND content >= {LEAST}, false) AS spike FROM (
            SELECT c.app_id, c.day, c.content, CASE WHEN c.day >= s.start + 28 THEN
                (SELECT median(coalesce(x.content, 0)) FROM (SELECT CAST(unnest(generate_series(c.day - INTERVAL 28 DAY, c.day - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d)
                 LEFT JOIN content x ON x.app_id = c.app_id AND x.day = d) END AS median
            FROM content c JOIN (SELECT app_id, min(day) AS start FROM content GROUP BY 1) s USING (app_id)))"""
RANKED = """SELECT *, CAST(row_number() OVER (PARTITION BY app_id, day ORDER BY md5(CAST(recommendation_id AS VARCHAR)), recommendation_id) AS INT) AS day_rank
    FROM cand WHERE length >= 20"""
OPEN = "(status IS NULL OR status NOT IN ('labeled', 'no_opinion'))"
PLAN = f"""SELECT r.app_id, r.recommendation_id, r.day, r.length, r.status, r.day_rank, coalesce(r.status = 'failed', false) AS retry
    FROM ranked r LEFT JOIN spikes s USING (app_id, day) WHERE r.day_rank <= coalesce(s.day_limit, {LIMIT}) AND {OPEN}"""


def planned_sql(final: str) -> str:
    return with_ctes(*NEEDED, body=f"""SELECT * FROM (
        WITH cand AS ({CANDIDATES}), content AS MATERIALIZED ({CONTENT}), spikes AS ({SPIKES}), ranked AS ({RANKED}), plan AS ({PLAN}) {final})""")


def limits(rows):
    content = rows.filter("length >= 20").groupBy("app_id", "day").agg(F.count("*").alias("content"))
    return planning.spike_days(content, LIMIT, 2.0, LEAST, SPIKE)


def plan(t):
    """The work list. Candidates are written once: the limits and the ranks both read them."""
    rows = written(candidates(t), "candidates")
    return planning.label_plan(rows, limits(rows), day_limit=LIMIT)


@query("candidate_reviews", *NEEDED, sql=f"""SELECT * FROM ({CANDIDATES}) WHERE day >= DATE '1996-01-01' AND day < DATE '2000-01-01'""")
def _(t):
    return candidates(t, since="1996-01-01", until="2000-01-01")


@query("spike_days", sql=planned_sql("SELECT * FROM spikes"))
def _(t):
    return limits(candidates(t))


@query("label_plan", sql=planned_sql("SELECT * FROM plan"))
def _(t):
    return plan(t)


@query("label_order", sql=planned_sql("""SELECT app_id, recommendation_id, row_number() OVER (PARTITION BY app_id ORDER BY day, day_rank, recommendation_id) AS position FROM plan"""))
def _(t):
    return planning.label_order(written(plan(t), "plan")).select("app_id", "recommendation_id", "position")


@query("adaptive_gain", sql=planned_sql(f"""
    SELECT s.app_id, s.day, s.content, s.median, s.day_limit AS spike_limit,
           (SELECT count(*) FROM ranked r WHERE r.app_id = s.app_id AND r.day = s.day AND {OPEN} AND r.day_rank > {LIMIT} AND r.day_rank <= s.day_limit) AS added
    FROM spikes s WHERE spike"""))
def _(t):
    rows = written(candidates(t), "candidates")
    return planning.adaptive_gain(rows, limits(rows), day_limit=LIMIT)


@query("run_cap", sql=planned_sql("SELECT app_id, recommendation_id, day, day_rank FROM plan ORDER BY day DESC, day_rank, recommendation_id LIMIT 500"))
def _(t):
    return planning.run_cap(plan(t), 500).select("app_id", "recommendation_id", "day", "day_rank")


@query("plan_counts", sql=planned_sql(f"""
    SELECT c.app_id, count(*) AS reviews, count(*) FILTER (WHERE c.length < 20) AS too_short,
           count(*) FILTER (WHERE c.length >= 20 AND c.status IN ('labeled', 'no_opinion')) AS done,
           count(p.recommendation_id) AS to_label, count(*) FILTER (WHERE p.retry) AS retry,
           count(*) FILTER (WHERE c.length >= 20 AND (c.status IS NULL OR c.status = 'failed') AND p.recommendation_id IS NULL) AS over_limit
    FROM cand c LEFT JOIN plan p ON p.app_id = c.app_id AND p.recommendation_id = c.recommendation_id GROUP BY 1"""))
def _(t):
    rows = written(candidates(t), "candidates")
    return planning.plan_counts(rows, planning.label_plan(rows, limits(rows), day_limit=LIMIT))


@query("run_left", sql=planned_sql("SELECT count(*) AS planned, count(*) FILTER (WHERE place > 500) AS left_over FROM (SELECT row_number() OVER () AS place FROM plan)"))
def _(t):
    return planning.run_left(plan(t), 500)


@query("label_plan_listed", *NEEDED, sql=f"""
    SELECT 'planned' AS part, c.recommendation_id, coalesce(c.status = 'failed', false) AS retry FROM ({CANDIDATES}) c JOIN documents ON doc_id * 16 = c.recommendation_id WHERE {OPEN}
    UNION ALL SELECT 'missing', doc_id * 16, NULL FROM documents WHERE doc_id * 16 NOT IN (SELECT o_orderkey FROM orders)""")
def _(t):
    ids = t.table("documents").select((F.col("doc_id") * 16).alias("recommendation_id"))
    todo, missing = planning.plan_listed(candidates(t), ids)
    return todo.select(F.lit("planned").alias("part"), "recommendation_id", "retry").unionByName(
        missing.select(F.lit("missing").alias("part"), "recommendation_id", F.lit(None).cast("boolean").alias("retry")))


@query("label_cost_estimate", sql=planned_sql(f"""
    SELECT app_id, n, chars, ((ceil(n / 10.0) * 1000 + (chars + n * 25) / 3.0::DOUBLE - (ceil(n / 10.0) - 1) * 1000) * 0.3 + (ceil(n / 10.0) - 1) * 1000 * 0.03 + n * 60 * 1.2)::DOUBLE / 1e6 AS cost
    FROM (SELECT app_id, count(*) AS n, CAST(sum(length) AS BIGINT) AS chars FROM plan GROUP BY 1)"""))
def _(t):
    return planning.estimate_cost(plan(t), PROMPT_CHARS, PRICES)


# --- batches and answers: document texts as reviews -----------------------------------------


def todo(t):
    """Documents without a label, five products, sixty days; the rank is the place within the day."""
    docs = t.table("documents").join(t.table("labels").select("doc_id"), "doc_id", "left_anti")
    rows = docs.select(
        F.col("doc_id").alias("recommendation_id"), (F.col("doc_id") % 5 + 1).cast("int").alias("app_id"),
        F.expr("date_add(DATE'2024-01-01', CAST(doc_id % 60 AS INT))").alias("day"), F.col("text").alias("review_body"),
        F.lit(0).alias("day_rank"))
    return planning.batch_rows(rows)


TODO = """SELECT recommendation_id, app_id, (position - 1) // 10 AS batch, CAST((position - 1) % 10 + 1 AS INT) AS n, text FROM (
    SELECT doc_id AS recommendation_id, CAST(doc_id % 5 + 1 AS INT) AS app_id, text,
           row_number() OVER (PARTITION BY doc_id % 5 ORDER BY doc_id % 60, doc_id) AS position
    FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"""


@query("label_batches", sql=f"""
    SELECT app_id, batch, CAST(count(*) AS INT) AS size, string_agg(concat('<review n="', CAST(n AS VARCHAR), '">', text, '</review>'), '\n' ORDER BY n) AS prompt
    FROM ({TODO}) GROUP BY 1, 2""".replace("'\n'", "chr(10)"))
def _(t):
    return planning.label_batches(todo(t))


def length_labeler():
    """Stands in for the model: labels a review by its length, and fails on lengths divisible by nine in a full batch.

    A nested function, so that it travels to the executors by value.
    """

    def answer(prompt: str) -> tuple[str, str]:
        import json
        import re

        out = []
        reviews = re.findall(r'<review n="(\d+)">(.*?)</review>(?=\n<review n=|\Z)', prompt, re.S)
        for number, body in reviews:
            size = len(body)
            tags = [{"id": f"a{size % 7}", "sentiment": "+-±"[size % 3]}] if size % 5 else []
            if size % 9 == 0 and len(reviews) > 1:
                tags = [{"id": "no such aspect", "sentiment": "+"}]
            out.append({"n": int(number), "aspects": tags})
        return json.dumps(out, ensure_ascii=False), "stop"

    return answer


LENGTH_TAGS = """SELECT app_id, batch, n, CASE WHEN length(text) % 5 = 0 THEN 'no_opinion' ELSE 'labeled' END AS status,
    CASE WHEN length(text) % 5 <> 0 THEN concat('a', CAST(length(text) % 7 AS VARCHAR)) END AS aspect,
    CASE WHEN length(text) % 5 <> 0 THEN substr('+-±', CAST(length(text) % 3 AS INT) + 1, 1) END AS sentiment FROM"""
ALLOWED = [f"a{i}" for i in range(7)]


@query("label_infer", sql=f"{LENGTH_TAGS} ({TODO})")
def _(t):
    rows = written(todo(t), "todo")
    done = labeling.label_run(rows, planning.label_batches(rows), length_labeler(), ALLOWED)
    first = F.get("aspects", F.lit(0))
    return done.select("app_id", "batch", "n", "status", first["id"].alias("aspect"), first["sentiment"].alias("sentiment"))


def metered_labeler():
    """A labeler with usage, some of whose answers are cut: of batches holding a length divisible by 31, of single reviews by 37.

    In a batch it names an unknown aspect for lengths divisible by 37, so those fail twice.
    """

    def answer(prompt: str) -> tuple[str, str, dict]:
        import json
        import re

        reviews = re.findall(r'<review n="(\d+)">(.*?)</review>(?=\n<review n=|\Z)', prompt, re.S)
        sizes = [len(body) for _, body in reviews]
        out = []
        for (number, _), size in zip(reviews, sizes):
            tags = [{"id": f"a{size % 7}", "sentiment": "+-±"[size % 3]}, {"id": "other", "sentiment": "-", "note": f"Note {size % 4}"}]
            out.append({"n": int(number), "aspects": [{"id": "?", "sentiment": "+"}] if size % 37 == 0 else tags if size % 5 else []})
        cut = any(s % 31 == 0 for s in sizes) if len(sizes) > 1 else any(s % 37 == 0 for s in sizes)
        # a cut answer may still read well: the finish reason alone tells
        return json.dumps(out, ensure_ascii=False), "length" if cut else "stop", {"prompt_tokens": len(prompt), "completion_tokens": 7 * len(sizes)}

    return answer


def metered_run(t):
    """Snapshot, batches, calls, parsing, single retries, labels: one run over every document without a label."""
    rows = written(todo(t), "todo")
    labels, calls = labeling.label_run_calls(rows, planning.label_batches(rows), metered_labeler(), [*ALLOWED, "other"])
    return labeling.label_records(labels, rows, CONFIG, "run-1"), calls


@query("label_run", sql=f"""
    SELECT x.recommendation_id, x.status, t.importance, t.aspect, t.sentiment, t.note FROM (
        SELECT recommendation_id, length(text) AS size, CASE WHEN length(text) % 37 = 0 THEN 'failed' WHEN length(text) % 5 = 0 THEN 'no_opinion' ELSE 'labeled' END AS status FROM ({TODO})) x
    LEFT JOIN LATERAL (SELECT * FROM (VALUES (1, concat('a', CAST(x.size % 7 AS VARCHAR)), substr('+-±', CAST(x.size % 3 AS INT) + 1, 1), NULL),
        (2, 'other', '-', concat('note ', CAST(x.size % 4 AS VARCHAR)))) AS v(importance, aspect, sentiment, note) WHERE x.status = 'labeled') t ON true""")
def _(t):
    records, _calls = metered_run(t)
    records = written(records, "labels")
    tags = labeling.label_tags(records).withColumnRenamed("aspect_id", "aspect")
    return records.select("labeling_sk", "recommendation_id", "status").join(tags, "labeling_sk", "left").drop("labeling_sk")


@query("label_run_calls", sql=f"""SELECT * FROM (WITH x AS (SELECT *, length(text) AS size, length(concat('<review n="', CAST(n AS VARCHAR), '">', text, '</review>')) AS marked FROM ({TODO})),
    b AS (SELECT app_id, batch, count(*) AS reviews, sum(marked) + count(*) - 1 AS chars, bool_or(size % 31 = 0) AND count(*) > 1 OR bool_or(size % 37 = 0) AND count(*) = 1 AS cut FROM x GROUP BY 1, 2),
    calls AS (
        SELECT 'batch' AS kind, cut, chars, reviews FROM b
        UNION ALL SELECT 'single', size % 37 = 0, length(concat('<review n="1">', text, '</review>')), 1 FROM x JOIN b USING (app_id, batch) WHERE cut OR size % 37 = 0)
    SELECT kind, CASE WHEN cut THEN 'length' ELSE 'stop' END AS finish, count(*) AS calls, CAST(sum(chars) AS BIGINT) AS prompt_tokens, CAST(sum(7 * reviews) AS BIGINT) AS completion_tokens
    FROM calls GROUP BY ALL)""")
def _(t):
    _records, calls = metered_run(t)
    return calls.groupBy("kind", "finish").agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


@query("label_ledger", sql=f"""SELECT * FROM (WITH x AS (SELECT *, concat('<review n="', CAST(n AS VARCHAR), '">', text, '</review>') AS marked FROM ({TODO})),
    b AS (SELECT app_id, batch, string_agg(marked, chr(10) ORDER BY n) AS prompt FROM x GROUP BY 1, 2),
    p AS (SELECT prompt, min(app_id) AS app_id FROM b GROUP BY 1)
    SELECT run, app_id, count(*) AS batches, count(*) FILTER (asked) AS asked, CAST(sum(CASE WHEN pays THEN length(prompt) END) AS BIGINT) AS prompt_tokens FROM (
        SELECT 1 AS run, b.app_id, b.prompt, b.app_id <= 2 AND pays AS asked, pays FROM (SELECT app_id, prompt, row_number() OVER (PARTITION BY prompt ORDER BY app_id, batch) = 1 AS pays FROM b WHERE app_id <= 2) b
        UNION ALL SELECT 2, b.app_id, b.prompt, pays AND (SELECT min(q.app_id) FROM p q WHERE q.prompt = b.prompt) > 2, pays
        FROM (SELECT app_id, prompt, row_number() OVER (PARTITION BY prompt ORDER BY app_id, batch) = 1 AS pays FROM b) b)
    GROUP BY ALL)""")
def _(t):
    # a run that stopped after two of the products, and the same run started again over all of them
    rows = written(todo(t), "todo")
    batches = planning.label_batches(rows)
    book = Ledger(scratch_path(t.spark, "ledger"), "run-1")
    keys = ("app_id", "batch")
    out = [written(answered(part, metered_labeler(), keys, book), "run").withColumn("run", F.lit(k + 1)) for k, part in enumerate((batches.where("app_id <= 2"), batches))]
    return out[0].unionByName(out[1]).groupBy("run", "app_id").agg(
        F.count("*").alias("batches"), F.count_if("asked").alias("asked"), F.sum("prompt_tokens").alias("prompt_tokens"))


def answers(t):
    """Answers of ten reviews each, built from the line items, with the faults models make."""
    line = t.table("lineitem")
    tag = F.struct(
        F.col("l_linenumber").alias("o1"), F.col("l_partkey").alias("o2"), F.col("l_suppkey").alias("o3"), F.col("l_quantity").alias("o4"),
        F.expr("CASE WHEN l_partkey % 12 = 11 THEN 'other' ELSE concat('a', l_partkey % 12) END").alias("id"),
        F.expr("CASE WHEN l_suppkey % 100 = 99 THEN '?' WHEN l_returnflag = 'A' THEN '+' WHEN l_returnflag = 'R' THEN '-' ELSE '±' END").alias("sentiment"),
        F.expr("CASE WHEN l_partkey % 12 = 11 THEN CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN ' Load Times ' WHEN 1 THEN 'a b c d' ELSE 'mods' END END").alias("note"))
    review = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(tag)).alias("x"))
    aspects = F.transform("x", lambda x: F.struct(x["id"].alias("id"), x["sentiment"].alias("sentiment"), x["note"].alias("note")))
    item = F.struct((F.col("l_orderkey") % 10 + 1).alias("n"), F.expr("CASE WHEN l_orderkey % 13 <> 0 THEN aspects END").alias("aspects"))
    batches = review.withColumn("aspects", aspects).groupBy(F.floor(F.col("l_orderkey") / 10).cast("bigint").alias("batch")).agg(
        F.sort_array(F.collect_list(F.struct("l_orderkey", item.alias("i")))).alias("items"))
    body = F.to_json(F.transform("items", lambda i: i["i"]))
    content = F.expr("CASE WHEN batch % 17 = 0 THEN concat('```json\\n', body, '\\n```') WHEN batch % 19 = 0 THEN concat('Sure: ', body) WHEN batch % 23 = 0 THEN '{\"n\": 1}' ELSE body END")
    return batches.withColumn("body", body).select(F.lit(1).alias("app_id"), "batch", F.lit(10).alias("size"), content.alias("content"))


ANSWER_ALLOWED = [f"a{i}" for i in range(11)] + ["other"]
PARSED = """
    tags AS (
        SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos,
               CASE WHEN l_partkey % 12 = 11 THEN 'other' ELSE concat('a', CAST(l_partkey % 12 AS VARCHAR)) END AS id, l_suppkey % 100 = 99 AS bad_sign,
               CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '±' END AS sentiment,
               CASE WHEN l_partkey % 12 = 11 THEN CASE l_suppkey % 4 WHEN 0 THEN 'load times' WHEN 1 THEN 'a b c d' ELSE 'mods' END END AS note FROM lineitem),
    rejected AS (SELECT l_orderkey, bool_or(bad_sign OR coalesce(note = 'a b c d', false)) OR l_orderkey % 13 = 0 AS bad FROM tags GROUP BY 1),
    kept AS (SELECT l_orderkey, id, sentiment, note, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, id, note ORDER BY pos) AS again FROM tags) WHERE again = 1),
    numbers AS (SELECT batch, n, batch * 10 + n - 1 AS l_orderkey FROM (SELECT DISTINCT l_orderkey // 10 AS batch FROM lineitem), (SELECT CAST(unnest(range(1, 11)) AS INT) AS n)),
    parsed AS (SELECT x.batch, x.n, CASE WHEN (x.batch % 17 <> 0 AND (x.batch % 19 = 0 OR x.batch % 23 = 0)) OR r.l_orderkey IS NULL OR r.bad THEN 'failed' ELSE 'labeled' END AS status, x.l_orderkey
               FROM numbers x LEFT JOIN rejected r USING (l_orderkey))"""


@query("label_parse", sql=f"""SELECT * FROM (WITH {PARSED}
    SELECT p.batch, p.n, p.status, string_agg(concat(k.id, ' ', k.sentiment, coalesce(' ' || k.note, '')), '; ' ORDER BY k.place) FILTER (WHERE k.id IS NOT NULL) AS aspects
    FROM parsed p LEFT JOIN kept k ON k.l_orderkey = p.l_orderkey AND p.status = 'labeled' AND k.place <= 5 GROUP BY 1, 2, 3)""")
def _(t):
    parsed = labeling.label_parse(answers(t), ANSWER_ALLOWED)
    shown = F.array_join(F.transform("aspects", lambda a: F.concat_ws(" ", a["id"], a["sentiment"], a["note"])), "; ")
    return parsed.select("batch", "n", "status", shown.alias("aspects"))


@query("label_status", sql=f"""SELECT * FROM (WITH {PARSED} SELECT status, count(*) AS n FROM parsed GROUP BY 1)""")
def _(t):
    return labeling.label_parse(answers(t), ANSWER_ALLOWED).groupBy("status").agg(F.count("*").alias("n"))


@query("answer_problems", sql=f"""SELECT * FROM (WITH {PARSED}
    SELECT DISTINCT batch, CAST(NULL AS INT) AS n, CASE WHEN batch % 19 = 0 THEN 'not JSON' ELSE 'not an array' END AS problem
    FROM numbers WHERE batch % 17 <> 0 AND (batch % 19 = 0 OR batch % 23 = 0)
    UNION ALL SELECT x.batch, x.n, CASE WHEN r.l_orderkey IS NULL THEN 'number left out' WHEN x.l_orderkey % 13 = 0 THEN 'no list of aspects' ELSE 'bad aspects' END
    FROM numbers x LEFT JOIN rejected r ON r.l_orderkey = x.l_orderkey
    WHERE (x.batch % 17 = 0 OR x.batch % 19 <> 0 AND x.batch % 23 <> 0) AND (r.l_orderkey IS NULL OR r.bad))""")
def _(t):
    return labeling.answer_problems(answers(t), ANSWER_ALLOWED, ("batch",))


# --- cost -----------------------------------------------------------------------------------


def usage(t):
    """One call per order, with the cache fields of two providers."""
    return t.table("orders").select(
        F.col("o_orderkey").alias("call_id"), F.concat(F.lit("run-"), (F.col("o_custkey") % 9).cast("string")).alias("run_id"),
        F.expr("CAST(o_totalprice AS BIGINT)").alias("prompt_tokens"), F.expr("CAST(o_custkey AS BIGINT)").alias("completion_tokens"),
        F.expr("CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN o_custkey WHEN 1 THEN 0L END").alias("prompt_cache_hit_tokens"),
        F.expr("CASE WHEN o_orderkey % 3 > 0 THEN named_struct('cached_tokens', o_custkey + 1) END").alias("prompt_tokens_details"),
        F.expr("CASE WHEN o_orderkey % 5 = 0 THEN named_struct('reasoning_tokens', 7L) END").alias("completion_tokens_details"),
        F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 0.0042D END").alias("cost"))


USAGE = """SELECT o_orderkey AS call_id, concat('run-', CAST(o_custkey % 9 AS VARCHAR)) AS run_id, CAST(o_totalprice AS BIGINT) AS input_tokens,
    CASE WHEN o_orderkey % 3 = 0 THEN (CASE WHEN o_custkey = 0 THEN 0 ELSE o_custkey END) ELSE o_custkey + 1 END AS cached_tokens, o_custkey AS output_tokens,
    CASE WHEN o_orderkey % 5 = 0 THEN 7 ELSE 0 END::BIGINT AS reasoning_tokens, o_orderkey % 7 = 0 AS own, o_orderkey FROM orders"""
USAGE_COST = """CASE WHEN own THEN 0.0042::DOUBLE ELSE (CAST(input_tokens - cached_tokens AS DOUBLE) * 0.3::DOUBLE + cached_tokens * 0.03::DOUBLE + output_tokens * 1.2::DOUBLE) / 1e6 END"""


@query("usage_cost", sql=f"SELECT call_id, input_tokens, cached_tokens, output_tokens, reasoning_tokens, floor({USAGE_COST} * 1e8 + 0.5) / 1e8 AS cost_usd FROM ({USAGE.replace('CAST(o_totalprice AS BIGINT)', 'CAST(trunc(o_totalprice) AS BIGINT)')})")
def _(t):
    return planning.usage_cost(usage(t), PRICES).select(
        "call_id", "input_tokens", "cached_tokens", "output_tokens", "reasoning_tokens", half_up(F.col("cost_usd"), 8).alias("cost_usd"))


@query("label_run_summary", sql=f"""
    SELECT run_id, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS labeled, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS no_opinion,
           count(*) FILTER (WHERE o_orderkey % 3 = 2) AS failed, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens,
           CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens,
           CASE WHEN run_id = 'run-0' THEN NULL ELSE floor(sum({USAGE_COST}) * 1e4 + 0.5) / 1e4 END AS cost_usd
    FROM ({USAGE.replace('CAST(o_totalprice AS BIGINT)', 'CAST(trunc(o_totalprice) AS BIGINT)')}) GROUP BY 1""")
def _(t):
    calls = planning.usage_cost(usage(t), PRICES)
    kind = F.col("call_id") % 3
    unknown = F.when(F.col("run_id") != "run-0", F.col("cost_usd"))
    counted = calls.withColumn("labeled", F.when(kind == 0, 1).otherwise(0)).withColumn("no_opinion", F.when(kind == 1, 1).otherwise(0)).withColumn(
        "failed", F.when(kind == 2, 1).otherwise(0)).withColumn("cost_usd", unknown)
    out = planning.run_summary(counted)
    return out.withColumn("cost_usd", half_up(F.col("cost_usd"), 4))


# --- raters ---------------------------------------------------------------------------------


def raters(t):
    """Three raters over the line items: overlapping choices, signs that partly differ."""
    marks = t.spark.sql("""
        SELECT l_orderkey AS recommendation_id, CAST(l_partkey % 45 AS INT) AS aspect_sk, explode(array(
            CASE WHEN l_quantity <= 35 THEN named_struct('rater', 'ann', 'sentiment', l_returnflag) END,
            CASE WHEN l_quantity >= 15 THEN named_struct('rater', 'bob', 'sentiment', CASE WHEN l_tax > 0.06 THEN 'N' ELSE l_returnflag END) END,
            CASE WHEN l_tax <= 0.05 THEN named_struct('rater', 'model', 'sentiment', CASE WHEN l_discount > 0.05 THEN 'A' ELSE l_returnflag END) END)) AS m
        FROM {line}""", line=t.table("lineitem")).filter("m is not null")
    one = marks.groupBy("m.rater", "recommendation_id", "aspect_sk").agg(F.min("m.sentiment").alias("sentiment"))
    return one.join(t.t_aspect, "aspect_sk").select("rater", "recommendation_id", "aspect_id", "category_id", "sentiment")


RATERS = """
    marks AS (
        SELECT rater, recommendation_id, aspect_id, category_id, min(sentiment) AS sentiment FROM (
            SELECT 'ann' AS rater, l_orderkey AS recommendation_id, l_partkey % 45 AS aspect_sk, l_returnflag AS sentiment FROM lineitem WHERE l_quantity <= 35
            UNION ALL SELECT 'bob', l_orderkey, l_partkey % 45, CASE WHEN l_tax > 0.06 THEN 'N' ELSE l_returnflag END FROM lineitem WHERE l_quantity >= 15
            UNION ALL SELECT 'model', l_orderkey, l_partkey % 45, CASE WHEN l_discount > 0.05 THEN 'A' ELSE l_returnflag END FROM lineitem WHERE l_tax <= 0.05)
        JOIN t_aspect USING (aspect_sk) GROUP BY 1, 2, 3, 4)"""


@query("dice_agreement", "t_aspect", sql=f"""SELECT * FROM (WITH {RATERS},
    m AS (SELECT DISTINCT rater, recommendation_id, w AS with_overall, 'aspect' AS level, aspect_id AS mark FROM marks, (VALUES (true), (false)) AS x(w) WHERE w OR aspect_id <> 'overall_impression'
          UNION SELECT DISTINCT rater, recommendation_id, w, 'category', category_id FROM marks, (VALUES (true), (false)) AS x(w) WHERE w OR aspect_id <> 'overall_impression'),
    s AS (SELECT level, with_overall, rater, count(*) AS n FROM m GROUP BY ALL),
    c AS (SELECT a.level, a.with_overall, a.rater AS rater_a, b.rater AS rater_b, count(*) AS common FROM m a JOIN m b USING (level, with_overall, recommendation_id, mark)
          WHERE a.rater < b.rater GROUP BY ALL)
    SELECT c.level, c.with_overall, rater_a, rater_b, common, x.n AS n_a, y.n AS n_b, floor(2.0::DOUBLE * common / (x.n + y.n) * 1e6 + 0.5) / 1e6 AS dice
    FROM c JOIN s x ON x.level = c.level AND x.with_overall = c.with_overall AND x.rater = rater_a JOIN s y ON y.level = c.level AND y.with_overall = c.with_overall AND y.rater = rater_b)""")
def _(t):
    return labeling.dice_agreement(raters(t))


@query("sign_agreement", "t_aspect", sql=f"""SELECT * FROM (WITH {RATERS}
    SELECT a.rater AS rater_a, b.rater AS rater_b, count(*) FILTER (WHERE a.sentiment = b.sentiment) AS same, count(*) AS total
    FROM marks a JOIN marks b USING (recommendation_id, aspect_id) WHERE a.rater < b.rater AND aspect_id <> 'overall_impression' GROUP BY 1, 2)""")
def _(t):
    return labeling.sign_agreement(raters(t))


@query("rater_overlap", "t_aspect", sql=f"""SELECT * FROM (WITH {RATERS},
    a AS (SELECT recommendation_id, aspect_id FROM marks WHERE rater = 'ann'), b AS (SELECT recommendation_id, aspect_id FROM marks WHERE rater = 'bob')
    SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS common, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a,
           (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either)""")
def _(t):
    return labeling.rater_overlap(raters(t), "ann", "bob")


@query("label_bias", "t_aspect", sql=f"""SELECT * FROM (WITH {RATERS},
    p AS (SELECT DISTINCT rater, recommendation_id, aspect_id FROM marks WHERE aspect_id <> 'overall_impression'),
    k AS (SELECT 'extra' AS bias, aspect_id FROM (SELECT recommendation_id, aspect_id FROM p WHERE rater = 'model' EXCEPT SELECT recommendation_id, aspect_id FROM p WHERE rater <> 'model')
          UNION ALL SELECT 'missed', aspect_id FROM (SELECT recommendation_id, aspect_id FROM p WHERE rater = 'ann' INTERSECT SELECT recommendation_id, aspect_id FROM p WHERE rater = 'bob'
                    EXCEPT SELECT recommendation_id, aspect_id FROM p WHERE rater = 'model'))
    SELECT bias, aspect_id, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY bias ORDER BY n DESC, aspect_id) AS rank
        FROM (SELECT bias, aspect_id, count(*) AS n FROM k GROUP BY 1, 2)) WHERE rank <= 10)""")
def _(t):
    return labeling.label_bias(raters(t), ["ann", "bob"], "model")


@query("overall_violations", "t_aspect", sql=f"""SELECT * FROM (WITH {RATERS}
    SELECT rater, count(*) AS reviews, count(*) FILTER (WHERE o) AS with_overall, count(*) FILTER (WHERE o AND n > 1) AS mixed
    FROM (SELECT rater, recommendation_id, bool_or(aspect_id = 'overall_impression') AS o, count(DISTINCT aspect_id) AS n FROM marks GROUP BY 1, 2) GROUP BY 1)""")
def _(t):
    return labeling.overall_violations(raters(t))


@query("model_labels_current", "t_version", "t_label", "t_tag", "t_aspect", sql="""
    SELECT v.recommendation_id, a.aspect_id, arg_min(t.sentiment, struct_pack(i := t.importance, s := t.sentiment)) AS sentiment
    FROM t_version v JOIN t_label l ON l.review_text_sk = v.review_text_sk AND l.llm_config_sk = 1 AND l.status <> 'failed'
    LEFT JOIN t_tag t ON t.labeling_sk = l.labeling_sk LEFT JOIN t_aspect a USING (aspect_sk) WHERE v.is_current GROUP BY 1, 2""")
def _(t):
    return labeling.model_labels_current(t.t_version, t.t_label, t.t_tag, t.t_aspect, CONFIG)
