"""Checks on generated texts, excerpts, status, hashes: known answers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tideline.functions import numbers, text
from tideline.operators import evidence, verdicts

RISE = "Негативных оценок стало больше: с 21% до 30% за неделю с 4 марта."
SERVERS = "Серверы упоминали 5% до и 19% после."
WHAT = f"{RISE} {SERVERS} Студия 2 марта опубликовала график работ."
TALK = "В отзывах ругают долгую очередь на вход и обрывы [2, 6]. Несколько человек просят вернуть прежний подбор команд [9]."
VOCABULARY = ["Queue and servers", "login_queue", "other"]
FIELDS = ("content string, news string, character string, volume string, main_diff double, before_negative double, after_negative double, "
          "known_numbers array<bigint>")


def lint(spark, what=WHAT, talk=TALK, news="yes", character="focused", volume="enough", main_diff=0.14):
    raw = json.dumps({"what_happened": what, "what_players_say": talk}, ensure_ascii=False)
    df = spark.createDataFrame([(raw, news, character, volume, main_diff, 0.21, 0.30, [2, 6, 9, 11])], FIELDS)
    row = verdicts.verdict_lint(verdicts.verdict_fields(df), VOCABULARY).first()
    assert row.checks_passed == (not row.problems)
    return [p.rule for p in row.problems]


def test_text_without_faults_passes(spark):
    assert lint(spark) == []


@pytest.mark.parametrize("raw", ["Ответ словами, без полей", '{"what_players_say": "y"}', '{"what_happened": "y", "what_players_say": "\\t"}', None])
def test_answer_without_both_texts(spark, raw):
    df = spark.createDataFrame([(raw, "no", "spread", "small", 0.2, 0.3, 0.2, [4])], FIELDS)
    assert [p.rule for p in verdicts.verdict_lint(verdicts.verdict_fields(df), VOCABULARY).first().problems] == ["missing field"]


@pytest.mark.parametrize("what, rule", [
    (f"{WHAT} Сбой спровоцировал волну отзывов.", "causal wording"),
    (f"{WHAT} Об этом пишут в [2, 6].", "review numbers"),
    (f"{WHAT} Сдвиг сфокусирован.", "label word"),
    (f"{RISE} Тему Queue and servers упоминали 5% до и 19% после.", "taxonomy name"),
    (f"{WHAT} Это заметили и в 东京.", "foreign letters"),
    (f"{RISE} Про серверы писали 5%, стало 19%.", "pair without before and after"),
    ("Число жалоб на игру: 21% -> 30% за неделю с 4 марта.", "vote share called complaints"),
    (f"{WHAT} График работ - удобный повод.", "occasion without news or with focus"),
    (f"{WHAT} Вывод опирается на сотню отзывов.", "volume mentioned at enough volume"),
    (f"{WHAT} Споры о серверах не увеличились.", "not grown while main topic grew"),
])
def test_what_happened_rules(spark, what, rule):
    assert rule in lint(spark, what=what)


@pytest.mark.parametrize("talk, rule", [
    ("Вход занимает час. Матчи обрываются [6].", "statement without support"),
    ("Вход занимает час [2, 17].", "unknown review number"),
    ("Вход занимает час [99999999999999999999999].", "unknown review number"),
    ("Ругают login_queue [2].", "taxonomy id"),
    ("Ругают queue and servers [2].", "taxonomy name"),
    ("Ошибка «接続» при входе [9].", "foreign letters"),
    ("Пишут «접속» и ждут [6].", "foreign letters"),
    ("Сервер Ωmega недоступен [2].", "foreign letters"),
])
def test_players_say_rules(spark, talk, rule):
    assert rule in lint(spark, talk=talk)


def test_latin_names_and_explicit_pairs_are_allowed(spark):
    assert lint(spark, talk="После входа через Epic Launcher игра теряет связь [11].") == []
    assert lint(spark, what="Негативных оценок стало меньше: с 30% до 21%. О серверах пишут реже: с 19% до 5%, новостей студии рядом не было.") == []
    assert lint(spark, what=f"{WHAT} График работ - удобный повод.", character="spread") == []
    assert lint(spark, what=f"{WHAT} Споры о серверах не увеличились.", main_diff=-0.14) == []
    assert lint(spark, what=f"{WHAT} Вывод опирается на сотню отзывов.", volume="small") == []


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_percent_is_half_up(spark):
    assert [one(spark, numbers.percent(F.lit(x))) for x in (0.025, 0.02502, 0.0249, 0.115, 0.5)] == [3, 3, 2, 12, 50]


def test_status_flips_ten_days_after(spark):
    at = F.lit(dt.date(2025, 5, 23))
    got = [one(spark, verdicts.late_window_status(at, F.lit(d))) for d in (dt.date(2025, 6, 1), dt.date(2025, 6, 2), dt.date(2026, 1, 1))]
    assert got == ["preliminary", "final", "final"]


def test_excerpt_is_cut_before_a_word(spark):
    words = "waited nine minutes, got kicked - " * 8
    cut = one(spark, text.excerpt_text(F.lit(words)))
    assert len(cut) <= 150 and cut[-1] == "…" and cut[-2].isalpha()
    assert words.startswith(cut[:-1]) and words[len(cut) - 1] in " ,"
    assert one(spark, text.excerpt_text(F.lit(" one\t\ttwo\n three "))) == "one two three"
    assert one(spark, text.excerpt_text(F.lit("z" * 151))) == "z" * 149 + "…"
    assert one(spark, text.excerpt_text(F.lit("z" * 150))) == "z" * 150


def picked(spark, *reviews):
    rows = [(3, number, votes, f"text {number}", language) for number, votes, language in reviews]
    df = spark.createDataFrame(rows, "point int, number int, votes_up int, text string, language_code string")
    return [r.number for r in verdicts.excerpt_pick(df, ["point"]).orderBy("excerpt_rank").collect()]


def test_excerpt_languages(spark):
    # one language: the most votes first, ties by number
    assert picked(spark, (1, 7, "english"), (2, 7, "english"), (3, 8, "english"), (4, 6, "english")) == [3, 1, 2]
    # the first language comes first, whatever the votes; no third language beside the two
    assert picked(spark, (1, 90, "english"), (2, 1, "russian"), (3, 99, "polish")) == [2, 1]
    assert picked(spark, (1, 2, "polish"), (2, 4, "turkish"), (3, 4, None), (4, 3, "polish")) == [2, 3, 4]
    assert picked(spark, (1, 0, "english"), (2, 50, None)) == [1]


def test_hash_ignores_votes_but_not_texts(spark):
    def hashed(votes, body):
        df = spark.createDataFrame([(6, [(1, 44, votes, body)])], "app_id int, reviews array<struct<number:int,recommendation_id:int,votes_up:int,text:string>>")
        return evidence.evidence_hash(df).first().evidence_hash

    assert hashed(3, "кик из лобби") == hashed(31, "кик из лобби") != hashed(3, "кик из матча")


def test_references_are_hidden_on_display(spark):
    assert one(spark, text.strip_references(F.lit("Очередь [2] на вход [6, 11] длинная. "))) == "Очередь на вход длинная."


def test_worklist_states(spark):
    points = spark.createDataFrame([(1, dt.date(2024, 1, d), h, s) for d, h, s in ((1, "a", True), (2, "b", False), (3, "c", True))],
                                   "app_id int, point_day date, evidence_hash string, significant boolean")
    stored = spark.createDataFrame([(1, dt.date(2024, 1, 1), 7, "a"), (1, dt.date(2024, 1, 1), 7, "old"), (1, dt.date(2024, 1, 2), 7, "old"),
                                    (1, dt.date(2024, 1, 3), 8, "c")], "app_id int, change_date date, llm_config_sk int, evidence_hash string")
    rows = verdicts.verdict_worklist(points, stored, 7).orderBy("point_day").collect()
    assert [(r.state, r.author) for r in rows] == [("same", None), ("changed", "template"), ("new", "model")]


def test_run_asks_once_more_and_keeps_what_came(spark):
    rows = [(1, "model", "fair"), (2, "model", "twice"), (3, "model", "never"), (4, "template", None), (5, "model", "raises")]
    points = spark.createDataFrame(rows, "app_id int, author string, prompt string").withColumn("point_day", F.lit(dt.date(2025, 5, 23))).withColumns(
        {"template": F.lit("steady"), "news": F.lit("yes"), "character": F.lit("focused"), "volume": F.lit("enough"), "main_diff": F.lit(0.14),
         "before_negative": F.lit(0.21), "after_negative": F.lit(0.30), "known_numbers": F.array(F.lit(2), F.lit(6), F.lit(9)).cast("array<bigint>")})
    good = json.dumps({"what_happened": WHAT, "what_players_say": TALK}, ensure_ascii=False)

    def writer(prompt, attempt):
        if prompt == "raises":
            raise ValueError(prompt)
        if prompt == "never":
            return "no JSON", "stop", {"prompt_tokens": 5, "completion_tokens": 1}
        return good, "length" if prompt == "twice" and attempt == 1 else "stop", {"prompt_tokens": 5, "completion_tokens": 1}

    run = verdicts.verdict_run(points, writer, VOCABULARY, {"input": 1.0, "output": 2.0}, "2025-06-01")
    got = {r.app_id: r for r in run.collect()}
    assert [got[i].attempts for i in range(1, 6)] == [1, 2, 2, 1, 2]
    assert [got[i].checks_passed for i in range(1, 6)] == [True, True, False, True, False]
    assert got[1].support_numbers == [2, 6, 9] and got[4].support_numbers == []
    assert got[3].what_happened == "no JSON" and got[4].what_happened == "steady" and got[5].what_happened is None
    assert [got[i].input_tokens for i in range(1, 6)] == [5, 10, 10, 0, 0]
    assert got[2].cost_usd == pytest.approx(14e-6) and got[4].cost_usd == 0 and got[5].cost_usd is None
    assert {p.rule for p in got[5].checks} == {"missing field", "answer cut"}


def test_canonical_text_tells_values_apart(spark):
    def shown(value, kind):
        df = spark.createDataFrame([(value,)], f"x {kind}")
        return one(spark, F.lit(df.select(evidence.canonical(F.col("x"), df.schema["x"].dataType)).first()[0]))

    assert shown("a,b", "string") == "3:a,b" and shown(None, "string") == "-" and shown("", "string") == "0:"
    assert shown(0.1234565, "double") == "123457" and shown(-0.25, "double") == "-250000"
    assert shown([("a", None), None], "array<struct<p:string,q:int>>") == "[(1:a,-),-]" and shown([], "array<int>") == "[]"


def test_lint_is_dealt_over_tasks_and_reads_an_answer_once(spark):
    answers = spark.createDataFrame([(1, '{"what_happened": "a b", "what_players_say": "c [2]"}'), (2, "no JSON")], "k int, content string").coalesce(1)
    fields = verdicts.verdict_fields(answers)
    assert fields.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert fields._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert {r.k: (r.what_happened, r.what_players_say) for r in fields.collect()} == {1: ("a b", "c [2]"), 2: (None, None)}


def test_lint_finds_names_and_pairs_at_the_borders(spark):
    talk = "Хорошо [1]."
    cases = {
        "Queue": ["taxonomy name"], "xQueue": [], "Queues": [], "xqueue queue": ["taxonomy name"], "сqueue": [], "(QUEUE)": ["taxonomy name"],
        "жалоб с 21% до 30%": ["vote share called complaints"], "с 21% до 30% жалоб": [], "критика: С 21% до 30%": ["vote share called complaints"],
        "жалоб" + " о" * 37 + " 21% -> 30%": ["vote share called complaints"], "жалоб" + " о" * 38 + " 21% -> 30%": [],
    }
    rows = [(w, talk, "no", "spread", "small", 0.0, 0.21, 0.30, [1]) for w in cases]
    given = spark.createDataFrame(rows, "what_happened string, what_players_say string, news string, character string, volume string, "
                                  "main_diff double, before_negative double, after_negative double, known_numbers array<bigint>")
    asked = ("taxonomy name", "vote share called complaints")
    out = {r.what_happened: sorted({p.rule for p in r.problems if p.rule in asked}) for r in verdicts.verdict_lint(given, ["Queue"]).collect()}
    assert out == cases


def test_run_deals_the_calls_over_tasks(spark):
    points = spark.range(64).coalesce(1).select(
        F.col("id").cast("int").alias("app_id"), F.lit(dt.date(2025, 5, 23)).alias("point_day"), F.lit("model").alias("author"), F.lit("t").alias("template"),
        F.lit("p").alias("prompt"), F.lit("yes").alias("news"), F.lit("focused").alias("character"), F.lit("enough").alias("volume"), F.lit(0.14).alias("main_diff"),
        F.lit(0.21).alias("before_negative"), F.lit(0.30).alias("after_negative"), F.array(F.lit(2)).cast("array<bigint>").alias("known_numbers"))

    def writer(prompt, attempt):
        from pyspark import TaskContext

        return f"task {TaskContext.get().partitionId()}", "stop", {}

    run = verdicts.verdict_run(points, writer, VOCABULARY, None, "2025-06-01").collect()
    assert len(run) == 64 and len({r.what_happened for r in run}) > 8


def test_lint_asks_patterns_only_where_a_stem_leaves_them_open(spark):
    given = spark.createDataFrame([(WHAT, TALK)], "what_happened string, what_players_say string").select("*", *[
        F.lit(x).alias(c) for c, x in (("news", "yes"), ("character", "focused"), ("volume", "enough"), ("main_diff", 0.14), ("before_negative", 0.21),
                                       ("after_negative", 0.30))], F.array(F.lit(2)).cast("array<bigint>").alias("known_numbers"))
    plan = verdicts.verdict_lint(given, VOCABULARY)._jdf.queryExecution().optimizedPlan().toString()
    for stems in (verdicts.CAUSAL_STEMS, verdicts.LABEL_STEMS, verdicts.VOLUME_STEMS, verdicts.NOT_GROWN_STEMS, verdicts.COMPLAINT_STEMS):
        assert all(f", {stem})" in plan for stem in stems) and "Contains(_what_lower" in plan


def test_stems_lose_no_phrase(spark):
    phrases = {
        "causal wording": ["из-за", "вызвал", "привел к", "приведя; привела  к", "привёл к", "в ответ на", "мог быть связан", "могли\tбыть связан", "связаны с", "объясняет",
                           "на фоне", "послужил", "спровоцир", "стала причин", "причина", "ᲂбъясня"],
        "label word": ["сфокусирован", "размазан", "значим", "ядра сдвиг", "главная категория", "направление ухудшение", "направлении улучшение", "разᲂ размазан"],
        "volume mentioned at enough volume": ["опира", "размеченн", "объем", "объём", "малом числ", "всего 7 отзыв", "всегᲂ 7 отзыв"],
        "not grown while main topic grew": ["не рос", "не вырос", "не подн", "не увелич", "не роᲃ"],
        "vote share called complaints": ["жалоб 21% -> 30%", "критик с 21% до 30%", "жалᲂб 21% -> 30%"],
        "occasion without news or with focus": ["повод", "повоᲁ"],
        "taxonomy name": ["Queue and servers", "LOGIN_QUEUE"],
        "foreign letters": ["Ω", "ª", "µ"],
    }
    cases = [(rule, case(p)) for rule, all_of in phrases.items() for p in all_of for case in (str, str.upper, str.capitalize)]
    rows = [(rule, p, "Хорошо [2].", "no", "focused", "enough", 0.14, 0.21, 0.30, [2]) for rule, p in cases if rule != "foreign letters" or p in phrases[rule]]
    given = spark.createDataFrame(rows, "rule string, what_happened string, what_players_say string, news string, character string, volume string, main_diff double, "
                                  "before_negative double, after_negative double, known_numbers array<bigint>")
    missed = verdicts.verdict_lint(given, VOCABULARY).filter(~F.exists("problems", lambda p: p["rule"] == F.col("rule"))).select("rule", "what_happened").collect()
    assert missed == []


def test_strip_takes_every_blank_from_both_ends_and_no_other(spark):
    codes = spark.range(1, 0x10000).filter("id not between 55296 and 57343").withColumn("c", F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')"))
    blank = F.rlike("c", F.lit(text.WHITESPACE))
    stripped = codes.select(blank.alias("blank"), (text.strip_all(F.concat("c", F.lit(" x \t"), "c")) == "x").alias("gone"), text.has_text(F.col("c")).alias("kept"))
    assert stripped.groupBy("blank", "gone", "kept").count().filter("blank <> gone or blank = kept").collect() == []
