"""Stored verdicts: work list, status, excerpts, checks on generated texts, display cards."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numbers import percent
from tideline.functions.text import REFERENCE, excerpt_text, has_text, strip_all, strip_references
from tideline.session import spread, written

WINDOW = 7
LATE_REVIEW_DAYS = 3
EXCERPTS = 3
EXCERPT_LANGUAGES = ("russian", "english")

# fixed values: patterns the checks look for in a generated text
SNAKE = r"\b[a-z]+(?:_[a-z]+)+\b"
FROM_TO = r"с\s+\d+(?:[.,]\d+)?\s*%\s+до\s+\d+(?:[.,]\d+)?\s*%"
NUMBER_PAIR = r"\d+(?:[.,]\d+)?\s*%[^%]{0,60}?\d+(?:[.,]\d+)?\s*%"
NOT_GROWN = r"не\s+(вы)?рос|не\s+подн|не\s+увелич"
VOLUME = r"опира|размеченн|объ[её]м|малом\s+числ|всего\s+\d+\s+отзыв"
CAUSAL = (
    r"из-за|вызвал|привел\w*\s+к|привёл\s+к|в\s+ответ\s+на|мог(ла|ли|ло)?\s+быть\s+связан|связан\w*\s+с|"
    r"объясня|на\s+фоне|послужил|спровоцир|стал\w*\s+причин|причин\w*"
)
LABEL_WORDS = r"сфокусирован|размазан|значим|ядр\w*\s+сдвиг|главная\s+категория|направлени\w*\s+(ухудшение|улучшение)"
PAIR = r"(\d+)\s*%\s*(?:до|->|→|-)\s*(\d+)\s*%|с\s+(\d+)\s*%\s+до\s+(\d+)\s*%"
OCCASION = r"повод"
BEFORE_WORD, AFTER_WORD = r"\bдо\b", r"\bпосле\b"
# looks back only from a blank
SENTENCE_BREAK = r"(?=\s)(?<=[.!?…])\s+(?=[А-ЯЁA-Z«\[])"
# looks at what a pair can begin with first, and back over the text only there
COMPLAINT_BEHIND = r"(?=\d|с\s)(?<=(?:жалоб[\s\S]{0,75}|критик[\s\S]{0,74}))"
# of the patterns above, stems one of which stands in every text they match; a text without them is not searched
NOT_GROWN_STEMS = ("рос", "подн", "увелич")
VOLUME_STEMS = ("опира", "размеченн", "объем", "объём", "малом", "всего")
CAUSAL_STEMS = ("из-за", "вызвал", "привел", "привёл", "ответ", "связан", "объясня", "фоне", "послужил", "спровоцир", "причин")
LABEL_STEMS = ("сфокусирован", "размазан", "значим", "сдвиг", "категория", "направлени")
COMPLAINT_STEMS = ("жалоб", "критик")
# a text of ASCII, Cyrillic and marks alone, read in runs: it has no foreign letter, and none whose case only a pattern knows (ᲂ is an о)
PLAIN = r"\A[\x00-\x7f]*+(?:[\x{400}-\x{481}]++[\x00-\x7f]*+|[\x{a0}«»\x{2010}-\x{206f}\x{2190}-\x{21ff}][\x00-\x7f]*+)*+\z"
VOCABULARY_EXEMPT = ("other", "Other", "overall", "Overall")


def late_window_status(day: Column, today: Column) -> Column:
    """preliminary until the week after and three days for late reviews have passed, then final."""
    return F.when(today >= F.date_add(day, WINDOW + LATE_REVIEW_DAYS), "final").otherwise("preliminary")


def verdict_current(verdicts: DataFrame, generation: DataFrame, labeling: DataFrame) -> DataFrame:
    """The newest verdict of the active configurations per product and day, whether or not its checks passed."""
    active = (
        verdicts.join(generation.select("llm_config_sk"), "llm_config_sk", "left_semi")
        .join(labeling.select(F.col("llm_config_sk").alias("labeling_config_sk")), "labeling_config_sk", "left_semi"))
    order = Window.partitionBy("app_id", "change_date").orderBy(F.desc("created_at"), F.desc("verdict_sk"))
    return active.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def verdict_worklist(evidence: DataFrame, verdicts: DataFrame, config_sk: int) -> DataFrame:
    """new, changed or same per point, and whether a template or the model writes the text."""
    own = verdicts.filter(F.col("llm_config_sk") == config_sk).select(
        "app_id", F.col("change_date").alias("point_day"), F.col("evidence_hash").alias("_hash"))
    known = evidence.select("app_id", "point_day", "evidence_hash", "significant").join(own, ["app_id", "point_day"], "left")
    per_point = known.groupBy("app_id", "point_day", "evidence_hash", "significant").agg(
        F.bool_or(F.coalesce(F.col("_hash") == F.col("evidence_hash"), F.lit(False))).alias("_same"),
        F.count("_hash").alias("_stored"))
    state = F.when(F.col("_same"), "same").when(F.col("_stored") > 0, "changed").otherwise("new")
    return per_point.select(
        "app_id", "point_day", state.alias("state"),
        F.when(state != "same", F.when(F.col("significant"), "model").otherwise("template")).alias("author"))


def verdict_finalize(verdicts: DataFrame, evidence: DataFrame, today: str, config_sk: int, fresh: DataFrame | None = None) -> DataFrame:
    """Turns preliminary verdicts final once their window is closed and the evidence has not changed.

    Of several verdicts with the same evidence the newest is meant. ``fresh`` optionally carries
    re-picked excerpts (verdict_sk, excerpts), which are shown but are not evidence.
    """
    day = F.lit(today).cast("date")
    hashes = evidence.select("app_id", F.col("point_day").alias("change_date"), "evidence_hash")
    matched = verdicts.filter(F.col("llm_config_sk") == config_sk).join(hashes, ["app_id", "change_date", "evidence_hash"], "left_semi")
    order = Window.partitionBy("app_id", "change_date").orderBy(F.desc("created_at"), F.desc("verdict_sk"))
    newest = matched.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").select(
        "verdict_sk", F.lit(True).alias("_same"))
    closing = F.col("_same") & (F.col("status") == "preliminary") & (late_window_status(F.col("change_date"), day) == "final")
    out = verdicts.join(newest, "verdict_sk", "left").withColumn(
        "status", F.when(F.coalesce(closing, F.lit(False)), "final").otherwise(F.col("status")))
    if fresh is not None:
        out = out.join(fresh.select("verdict_sk", F.col("excerpts").alias("_excerpts")), "verdict_sk", "left").withColumn(
            "excerpts", F.when(F.col("_same") & F.col("_excerpts").isNotNull(), F.col("_excerpts")).otherwise(F.col("excerpts"))
        ).drop("_excerpts")
    return out.drop("_same")


def excerpt_pick(support: DataFrame, keys: list[str], k: int = EXCERPTS) -> DataFrame:
    """Up to ``k`` supporting reviews to quote: preferred languages in order, others only if there are none."""
    language = F.when(F.col("language_code") == EXCERPT_LANGUAGES[0], 0).when(
        F.col("language_code") == EXCERPT_LANGUAGES[1], 1).otherwise(len(EXCERPT_LANGUAGES))
    ranked = support.withColumn("_language", language)
    order = Window.partitionBy(*keys).orderBy("_language", F.desc("votes_up"), "number")
    first = ranked.withColumn("excerpt_rank", F.row_number().over(order)).filter(F.col("excerpt_rank") <= k)
    best = F.min("_language").over(Window.partitionBy(*keys))
    other = F.col("_language") == len(EXCERPT_LANGUAGES)
    return (
        first.withColumn("_best", best)
        .filter(~other | (F.col("_best") == len(EXCERPT_LANGUAGES)))
        .select(*keys, "excerpt_rank", "number", "votes_up", excerpt_text(F.col("text")).alias("text"))
    )


@lru_cache(maxsize=1)
def _named_letters() -> str:
    """Ranges of letters whose Unicode name starts with LATIN or CYRILLIC, as a character class."""
    ranges: list[list[int]] = []
    for code in range(sys.maxunicode + 1):
        ch = chr(code)
        if unicodedata.category(ch).startswith("L") and unicodedata.name(ch, "").startswith(("LATIN", "CYRILLIC")):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


def _sentences(text: Column) -> Column:
    return F.filter(F.split(strip_all(text), SENTENCE_BREAK, -1), has_text)


def _references(text: Column) -> Column:
    lists = F.regexp_extract_all(text, F.lit(REFERENCE), 0)
    numbers = F.flatten(F.transform(lists, lambda m: F.regexp_extract_all(m, F.lit(r"(\d+)"), 1)))
    # as text without leading zeros: a reference may have any number of digits
    return F.transform(numbers, lambda n: F.regexp_replace(n, r"^0+(?=\d)", ""))


def _none() -> Column:
    return F.array().cast("array<struct<part:string,rule:string,detail:string>>")


def _problems(part: str, rule: str, details: Column, possible: Column | None = None) -> Column:
    """One problem per element of ``details``, which is not looked at unless ``possible``."""
    rows = F.transform(details, lambda d: F.struct(F.lit(part).alias("part"), F.lit(rule).alias("rule"), d.alias("detail")))
    return rows if possible is None else F.when(possible, rows).otherwise(_none())


def _once(part: str, rule: str, hit: Column) -> Column:
    one = F.array(F.struct(F.lit(part).alias("part"), F.lit(rule).alias("rule"), F.lit(None).cast("string").alias("detail")))
    return F.when(F.coalesce(hit, F.lit(False)), one).otherwise(_none())


def _found(text: Column, pattern: str, flags: str = "(?iU)") -> Column:
    return F.regexp_extract_all(text, F.lit(flags + "(?:" + pattern + ")"), 0)


def verdict_lint(verdicts: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Checks generated texts and lists what is wrong with each.

    Most texts have few faults, and patterns that ignore case take long: they are asked where a plain search for their stems,
    or a letter beyond the plain ones, leaves it open whether they match.

    Needs what_happened, what_players_say, news, character, volume, main_diff, before_negative,
    after_negative, known_numbers. ``vocabulary`` has the taxonomy ids and names that must not be quoted.
    """
    what, talk = F.col("what_happened"), F.col("what_players_say")
    names = [n.lower() for n in vocabulary if n not in VOCABULARY_EXEMPT]
    foreign = f"[\\p{{L}}&&[^{_named_letters()}]]"

    def possible(stems: tuple) -> Column:
        return reduce(Column.__or__, [F.contains(F.col("_what_lower"), F.lit(stem)) for stem in stems], ~F.col("_what_plain"))

    def quoted(lowered: Column) -> Column:
        # one fixed pattern per name, compiled once; it looks for the name before it looks around it
        hits = [F.when(F.contains(lowered, F.lit(n)) & F.rlike(lowered, F.lit(rf"(?U)\Q{n}\E(?!\w)(?<!\w\Q{n}\E)")), F.lit(n)) for n in names]
        return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")

    def unordered(s: Column) -> Column:
        rest = F.regexp_replace(s, "(?U)" + FROM_TO, "")
        both = F.rlike(rest, F.lit("(?U)" + BEFORE_WORD)) & F.rlike(rest, F.lit("(?U)" + AFTER_WORD))
        return F.contains(s, F.lit("%")) & F.rlike(rest, F.lit("(?U)" + NUMBER_PAIR)) & ~both

    votes_pair = F.array(percent(F.col("before_negative")).cast("string"), percent(F.col("after_negative")).cast("string"))
    near_complaint = _found(what, COMPLAINT_BEHIND + "(?:" + PAIR + ")")
    swapped = F.exists(near_complaint, lambda m: F.regexp_extract_all(m, F.lit(r"(\d+)"), 1) == votes_pair)
    both = F.concat(what, F.lit(" "), talk)
    occasion = ~(F.col("_what_plain") & F.col("_talk_plain")) | F.contains(F.col("_what_lower"), F.lit(OCCASION)) | F.contains(F.col("_talk_lower"), F.lit(OCCASION))
    statements = _sentences(talk)
    known = F.coalesce(F.col("known_numbers").cast("array<string>"), F.array().cast("array<string>"))
    by_size = F.array_sort(F.transform(F.array_except(_references(talk), known), lambda n: F.struct(F.length(n).alias("size"), n.alias("number"))))
    unknown = by_size["number"]

    parts = [
        _problems("what_happened", "causal wording", _found(what, CAUSAL), possible(CAUSAL_STEMS)),
        _once("what_happened", "review numbers", what.rlike("(?U)" + REFERENCE)),
        _problems("what_happened", "label word", _found(what, LABEL_WORDS), possible(LABEL_STEMS)),
        _problems("what_happened", "pair without before and after", F.filter(_sentences(what), unordered), F.contains(what, F.lit("%"))),
        _once("what_happened", "not grown while main topic grew", (F.col("main_diff") > 0) & possible(NOT_GROWN_STEMS) & what.rlike("(?iU)" + NOT_GROWN)),
        _once("what_happened", "volume mentioned at enough volume", (F.col("volume") == "enough") & possible(VOLUME_STEMS) & what.rlike("(?iU)" + VOLUME)),
        _once("what_happened", "vote share called complaints", possible(COMPLAINT_STEMS) & swapped),
        _once("both", "occasion without news or with focus",
              ((F.col("news") == "no") | (F.col("character") == "focused")) & occasion & both.rlike("(?iU)" + OCCASION)),
    ]
    for part, text, name in (("what_happened", what, "_what"), ("what_players_say", talk, "_talk")):
        letters = F.array_join(F.array_sort(F.array_distinct(_found(text, foreign, ""))), "")
        parts += [
            _problems(part, "foreign letters", F.filter(F.array(letters), lambda x: x != ""), ~F.col(name + "_plain")),
            _problems(part, "taxonomy id", _found(text, SNAKE, "(?U)"), F.contains(text, F.lit("_"))),
            _problems(part, "taxonomy name", quoted(F.col(name + "_lower"))),
        ]
    parts += [
        _problems("what_players_say", "statement without support", F.filter(statements, lambda s: ~F.rlike(s, F.lit("(?U)" + REFERENCE)))),
        _problems("what_players_say", "unknown review number", unknown),
    ]
    unreadable = ~F.coalesce(has_text(what) & has_text(talk), F.lit(False))
    problems = F.when(unreadable, _once("both", "missing field", F.lit(True))).otherwise(F.concat(*parts))
    looked = {"_what_lower": F.lower(what), "_talk_lower": F.lower(talk), "_what_plain": what.rlike(PLAIN), "_talk_plain": talk.rlike(PLAIN)}
    return verdicts.withColumns(looked).withColumn("problems", problems).withColumn("checks_passed", F.size("problems") == 0).drop(*looked)


def verdict_fields(answers: DataFrame, content: str = "content") -> DataFrame:
    """Reads both texts from a JSON answer; an answer without them gets nulls.

    Answers are short and their checks take long, so they are dealt over many tasks here. Each step is a projection of its
    own, so that an answer is read once however often its texts are used.
    """
    from tideline.operators.labeling import _unfenced

    what, talk = F.col("_said.what_happened"), F.col("_said.what_players_say")
    complete = (what != "") & (talk != "")
    return (
        spread(answers).withColumn("_plain", _unfenced(F.col(content)))
        .withColumn("_read", F.from_json("_plain", "what_happened STRING, what_players_say STRING"))
        .withColumn("_said", F.struct(strip_all(F.col("_read.what_happened")).alias("what_happened"),
                                      strip_all(F.col("_read.what_players_say")).alias("what_players_say")))
        .withColumns({"what_happened": F.when(complete, what), "what_players_say": F.when(complete, talk)})
        .drop("_plain", "_read", "_said")
    )


def verdict_report(current: DataFrame) -> DataFrame:
    """Display cards. Texts of a verdict that failed its checks are hidden; what players say, and excerpts, are the model's only."""
    shown = F.col("checks_passed")
    by_model = shown & (F.col("author") == "model")
    return current.select(
        "app_id", F.col("change_date").alias("day"), "before_from", "after_to",
        (F.col("status") == "preliminary").alias("preliminary"), shown.alias("checked"),
        percent(F.col("before_negative")).alias("negative_before"), percent(F.col("after_negative")).alias("negative_after"),
        F.when(shown, strip_references(F.col("what_happened"))).alias("what_happened"),
        F.when(by_model, strip_references(F.coalesce("what_players_say", F.lit("")))).alias("what_players_say"),
        F.when(by_model, F.transform("excerpts", lambda e: e["text"])).alias("excerpts"),
    )


def verdict_run(points: DataFrame, writer: Callable[[str, int], tuple], vocabulary: list[str], prices: dict | None, today: str) -> DataFrame:
    """Verdict rows of the points: a template's text, or the model's, asked for once more where its checks fail.

    ``points`` has app_id, point_day (one row each), author, template, prompt and what ``verdict_lint`` needs. ``writer``
    maps a prompt and the number of the attempt to (answer, finish reason, usage). Of two answers the second counts, and
    both are paid for; a cut answer fails. An unreadable answer is kept as it came. The price is null as soon as one
    call's is unknown.
    """
    from tideline.operators.labeling import FINISHED, label_infer
    from tideline.operators.planning import call_price

    keys = ["app_id", "point_day"]

    def asked(rows: DataFrame, attempt: int) -> DataFrame:
        answers = written(label_infer(spread(rows.withColumn("size", F.lit(1))), lambda prompt: writer(prompt, attempt), tuple(keys)), "verdict-answers")
        judged = verdict_lint(verdict_fields(rows.drop("prompt").join(answers.drop("size"), keys)), vocabulary)
        problems = F.concat("problems", _once("both", "answer cut", ~F.col("finish").eqNullSafe(F.lit(FINISHED))))
        return written(judged.withColumn("problems", problems).withColumn("attempts", F.lit(attempt)), "verdict-checks")

    modelled = points.filter("author = 'model'")
    first = asked(modelled, 1)
    failed = first.filter(F.size("problems") > 0).select(*keys)
    second = asked(modelled.join(failed, keys, "left_semi"), 2)
    calls = first.unionByName(second).select(*keys, "prompt_tokens", "completion_tokens", call_price(prices).alias("cost_usd"))
    spent = calls.groupBy(*keys).agg(
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("output_tokens"),
        F.when(F.count_if(F.col("cost_usd").isNull()) == 0, F.sum("cost_usd")).alias("cost_usd"))
    known = F.coalesce(F.col("known_numbers").cast("array<string>"), F.array().cast("array<string>"))
    cited = F.array_intersect(F.coalesce(_references(F.col("what_players_say")), F.array().cast("array<string>")), known)
    none = F.array().cast("array<struct<part:string,rule:string,detail:string>>")
    said = first.join(failed, keys, "left_anti").unionByName(second).join(spent, keys).select(
        *keys, "author", F.coalesce("what_happened", "content").alias("what_happened"), "what_players_say",
        F.array_sort(cited.cast("array<bigint>")).alias("support_numbers"), F.col("problems").alias("checks"),
        "attempts", "input_tokens", "output_tokens", "cost_usd")
    zero = F.lit(0).cast("bigint")
    told = points.filter("author = 'template'").select(
        *keys, "author", F.col("template").alias("what_happened"), F.lit(None).cast("string").alias("what_players_say"),
        F.array().cast("array<bigint>").alias("support_numbers"), none.alias("checks"), F.lit(1).alias("attempts"),
        zero.alias("input_tokens"), zero.alias("output_tokens"), F.lit(0.0).alias("cost_usd"))
    return said.unionByName(told).withColumn("checks_passed", F.size("checks") == 0).withColumn(
        "status", late_window_status(F.col("point_day"), F.lit(today).cast("date")))


def verdict_excerpts(records: DataFrame, reviews: DataFrame) -> DataFrame:
    """Adds the excerpts to show beside each verdict, picked among the reviews that it cites.

    ``reviews`` has app_id, point_day, number, votes_up, language_code and text.
    """
    keys = ["app_id", "point_day"]
    cited = records.select(*keys, F.explode("support_numbers").alias("number"))
    picked = excerpt_pick(reviews.join(cited, [*keys, "number"], "left_semi"), keys)
    shown = picked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("excerpt_rank", "number", "votes_up", "text"))).alias("excerpts"))
    return records.join(shown, keys, "left")
