"""Loading: merges in any order, versions, page batches, titles, cards."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tideline.functions import dates, titles
from tideline.operators import events, facts, games, marts, paging
from tideline.sources import dims, files, raw
from tideline.streaming import reviews as stream

T0 = dt.datetime(2024, 1, 1)
FIRST, LAST = ("created_at", "language_sk"), ("votes_up", "loaded_from", "review_body")
SCHEMA = "recommendation_id bigint, created_at string, language_sk int, votes_up int, loaded_from timestamp, review_body string"


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _sequential(batches):
    """The upsert, one row after the other."""
    store = {}
    for rows in batches:
        for key, created, language, votes, loaded, body in rows:
            if key not in store:
                store[key] = [created, language, votes, loaded, body]
            elif store[key][3] is None or loaded >= store[key][3]:
                store[key][2:] = [votes, loaded, body]
    return {k: tuple(v) for k, v in store.items()}


def test_merges_in_any_order_match_row_by_row_upserts(spark):
    rng = random.Random(3)
    batches = []
    for b in range(4):
        ids = rng.sample(range(30), 15)
        batches.append([(i, f"c{b}", b, rng.randint(0, 99), T0 + dt.timedelta(hours=rng.randint(0, 5)), f"t{b}") for i in ids])
    store = batch(spark, batches[0])
    for rows in batches[1:]:
        store = facts.merge_reviews(store, batch(spark, rows), immutable=FIRST, mutable=LAST)
    got = {r.recommendation_id: (r.created_at, r.language_sk, r.votes_up, r.loaded_from, r.review_body) for r in store.collect()}
    assert got == _sequential(batches)
    log = None
    for n, rows in enumerate(batches):
        part = batch(spark, rows).withColumn("batch", F.lit(n))
        log = part if log is None else log.unionByName(part)
    replayed = {r.recommendation_id: (r.created_at, r.language_sk, r.votes_up, r.loaded_from, r.review_body)
                for r in stream.current_reviews(log).collect()}
    assert replayed == _sequential(batches)


def test_merge_fills_an_unknown_origin(spark):
    store = batch(spark, [(1, "c", 0, 5, None, "old")])
    row = facts.merge_reviews(store, batch(spark, [(1, "x", 9, 6, T0, "new")]), immutable=FIRST, mutable=LAST).first()
    assert (row.created_at, row.language_sk, row.votes_up, row.review_body) == ("c", 0, 6, "new")


def test_version_boundaries_are_half_open(spark):
    dim = spark.createDataFrame([(1, 10, dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)), (2, 10, dt.datetime(2024, 2, 1), dt.datetime(2099, 1, 1))],
                                "game_sk int, app_id int, valid_from timestamp, valid_to timestamp")
    rows = spark.createDataFrame([(10, dt.datetime(2023, 12, 31)), (10, dt.datetime(2024, 1, 1)), (10, dt.datetime(2024, 2, 1)), (11, dt.datetime(2024, 2, 1))],
                                 "app_id int, at timestamp")
    out = facts.scd2_lookup(rows, dim, "at").orderBy("app_id", "at").collect()
    assert [r.game_sk for r in out] == [-1, 1, 2, -1]


def test_a_thousand_versions_of_one_product_make_no_pairs(spark):
    rng = random.Random(4)
    cuts = sorted(rng.sample(range(100_000), 1001))
    spans = [(k, 10, T0 + dt.timedelta(minutes=a), T0 + dt.timedelta(minutes=b)) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    dim = spark.createDataFrame([*spans, (5000, 11, T0, T0 + dt.timedelta(1)), (5001, 11, T0, T0 + dt.timedelta(2))], "game_sk int, app_id int, valid_from timestamp, valid_to timestamp")
    minutes = [*rng.choices(range(100_100), k=400), *cuts[:50]]
    rows = spark.createDataFrame([(10, T0 + dt.timedelta(minutes=m)) for m in minutes] + [(11, T0), (12, T0), (10, None), (None, T0)], "app_id int, at timestamp")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = facts.scd2_lookup(rows, dim, "at")
        got = sorted(((r.app_id or 0, r.at or T0, r.game_sk) for r in out.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = []
    for m in minutes:
        hits = [k for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a <= m < b]
        want += [(10, T0 + dt.timedelta(minutes=m), k) for k in hits or [-1]]
    want += [(11, T0, 5000), (11, T0, 5001), (12, T0, -1), (10, T0, -1), (0, T0, -1)]
    assert got == sorted(want)


def cut_one_by_one(sizes, size):
    """Batch of each page, by going through the pages: a batch ends with the page of row first + size."""
    total, ends, out = sum(sizes), list(itertools.accumulate(sizes)), []
    first, batch, last = 0, 0, 0
    for end in ends:
        if end > last:
            first, batch = last, batch + (last > 0)
            last = total if first + size >= total else next(e for e in ends if e >= first + size)
        out.append(batch)
    return out


@pytest.mark.parametrize("size, largest", [(1, 9), (10, 9), (10, 60), (7, 1), (1000, 9), (199, 30)])
def test_batches_end_with_the_page_that_fills_them(spark, size, largest):
    rng = random.Random(size + largest)
    sizes = [rng.randint(1, largest) for _ in range(120)]
    at = [T0 + dt.timedelta(seconds=90_000 * (p // 50) + p // 3, microseconds=p % 3) for p in range(len(sizes))]
    df = spark.createDataFrame([(t, i) for t, n in zip(at, sizes) for i in range(n)], "fetched_at timestamp, id int")
    pages = paging.page_batches(df, size).orderBy("fetched_at").collect()
    assert [p.page_rows for p in pages] == sizes
    assert [p.page_end for p in pages] == list(itertools.accumulate(sizes))
    assert [p.batch for p in pages] == cut_one_by_one(sizes, size)


def test_batches_of_an_empty_table(spark):
    assert paging.page_batches(spark.createDataFrame([], "fetched_at timestamp, id int"), 10).collect() == []


def test_incremental_marks_are_strict_and_per_product(spark):
    raw_pages = spark.createDataFrame([(1, T0), (1, T0 + dt.timedelta(1)), (2, T0), (3, T0)], "app_id int, fetched_at timestamp")
    marks = spark.createDataFrame([(1, T0), (2, T0)], "app_id int, loaded_from timestamp")
    assert sorted((r.app_id, r.fetched_at.day) for r in facts.incremental_pages(raw_pages, marks).collect()) == [(1, 2), (3, 1)]
    assert facts.incremental_pages(raw_pages, marks, full=True).count() == 4
    assert facts.incremental_pages(raw_pages, since="2024-01-01", until="2024-01-02").count() == 3


def card(app, **data):
    return {"success": True, "data": {"name": f"g{app}", "type": "game", **data}}


def test_card_is_picked_by_inner_id_then_key(spark):
    import json

    cases = [(1, {"1": card(1, steam_appid=1)}, "g1"), (2, {"9": card(2, steam_appid=2)}, "g2"), (3, {"9": card(9, steam_appid=9)}, None),
             (4, {"9": card(4)}, "g4"), (5, {"8": card(8, steam_appid=8), "9": card(9)}, None), (6, {"5": card(5), "6": card(6)}, "g6")]
    df = spark.createDataFrame([(a, json.dumps(p)) for a, p, _ in cases], "app_id int, payload string")
    got = {r.app_id: r.card.data.name if r.card and r.card.data else None for r in raw.pick_card(df).collect()}
    assert got == {a: name for a, _, name in cases}


def test_scd2_apply_opens_versions_only_for_tracked_changes(spark):
    base = dict(app_type="game", is_free=False, required_age=0, metacritic_score=None, is_coming_soon=False, release_date_raw=None, release_date_parsed=None)
    schema = "app_id int, game_name string, metacritic_url string, app_type string, is_free boolean, required_age int, metacritic_score int, is_coming_soon boolean, release_date_raw string, release_date_parsed date"
    cards = spark.createDataFrame([{**base, "app_id": a, "game_name": n, "metacritic_url": None} for a, n in ((1, "one"), (2, "two"))], schema)
    empty = spark.createDataFrame([], f"game_sk bigint, {schema}, valid_from timestamp, valid_to timestamp, is_current boolean, collection_status string")
    dim = games.scd2_apply(empty, cards, "2024-05-01")
    assert dim.count() == 2 and {r.valid_from.year for r in dim.collect()} == {2000}
    renamed = spark.createDataFrame([{**base, "app_id": 1, "game_name": "new", "metacritic_url": None},
                                     {**base, "app_id": 2, "game_name": "two", "metacritic_url": None, "is_free": True}], schema)
    out = games.scd2_apply(dim, renamed, "2024-06-01").orderBy("app_id", "valid_from").collect()
    assert [(r.app_id, r.game_name, r.is_current, r.is_free) for r in out] == [(1, "new", True, False), (2, "two", False, False), (2, "two", True, True)]
    assert out[1].valid_to == out[2].valid_from and len({r.game_sk for r in out}) == 3


@pytest.mark.parametrize("title, kind, version", [
    ("Coming next week: patch 1.2", "announce", "1.2"), ("Summer sale is on", "marketing", None), ("Dev diary #4", "blog", None),
    ("Maintenance on Tuesday", "service", None), ("Midseason balance", "patch", None), ("Season 3: Dawn", "season_start", None),
    ("mid-season 3: x", "unknown", None), ("Season 3 - teaser", "unknown", None), ("Season 4 is here", "season_start", None),
    ("Season of the Deep", "season_start", None), ("The expansion is available", "expansion", None), ("Hotfix 1.0.3", "patch", "1.0.3"),
    ("2.5 million sold", "marketing", None), ("v1.4.2", "patch", "1.4.2"), ("Update 5", "patch", None), ("Beta v0.9", "beta", "0.9"),
    ("Experimental build moved to stable 1.1", "patch", "1.1"), ("Build 2024.1", "unknown", None), ("A quiet note", "unknown", None),
])
def test_title_kinds(spark, title, kind, version):
    t = F.lit(title)
    row = spark.range(1).select(titles.title_kind(t).alias("k"), titles.extract_version(t).alias("v")).first()
    assert (row.k, row.v) == (kind, version)


@pytest.mark.parametrize("title, kind, label", [
    ("The Steam Awards 2024", "awards", "Steam Awards"), ("Steam Next Fest is live", "fest", "Next Fest"), ("Summer Sale dates", "sale", "Steam Summer Sale"),
    ("black friday steam sale", "sale", "Steam Black Friday Sale"), ("Publisher Steam sale", None, "Publisher Steam sale"),
])
def test_platform_events(spark, title, kind, label):
    t = F.lit(title)
    k = titles.platform_kind(t)
    row = spark.range(1).select(k.alias("k"), titles.platform_label(k, t).alias("l")).first()
    assert (row.k, row.l) == (kind, label)


@pytest.mark.parametrize("raw_date, expected", [("5 Mar, 2020", "2020-03-05"), ("Mar 5, 2020", "2020-03-05"), ("5 March, 2020", "2020-03-05"),
                                                ("March 5, 2020", "2020-03-05"), (" 2020 ", "2020-01-01"), ("Coming soon", None), ("", None), (None, None)])
def test_release_dates(spark, raw_date, expected):
    row = spark.range(1).select(dates.parse_release_date(F.lit(raw_date).cast("string")).alias("d")).first()
    assert (str(row.d) if row.d else None) == expected


def test_calendar_and_hours(spark):
    days = dims.dim_date(spark)
    assert days.count() == 10227
    row = days.filter("date_sk = 20240101").first()
    assert (row.day_of_week, row.is_weekend, row.week_of_year, row.month_name, row.day_name) == (1, False, 1, "January", "Monday")
    hours = {r.time_sk: r for r in dims.dim_time(spark).collect()}
    assert len(hours) == 24 and hours[17].is_peak and hours[17].daypart == "day" and hours[5].hour_label == "05:00"


@pytest.mark.parametrize("signs, folded", [("++", "+"), ("-", "-"), ("+-", "±"), ("±", "±")])
def test_sign_folding(spark, signs, folded):
    df = spark.createDataFrame([(s,) for s in signs], "sentiment string")
    assert df.agg(marts.fold_sentiment().alias("s")).first().s == folded


def test_general_impression_stays_only_alone(spark):
    rows = [(1, "overall_impression"), (2, "overall_impression"), (2, "price")]
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1), 1, k, "c", a, "+") for k, a in rows],
                               "app_id int, day date, llm_config_sk int, labeling_sk int, category_id string, aspect_id string, sentiment string")
    assert sorted((r.labeling_sk, r.aspect_id) for r in marts.review_aspect_tag(df).collect()) == [(1, "overall_impression"), (2, "price")]


def test_files(spark, tmp_path):
    (tmp_path / "book.json").write_text(
        '{"version": "v9", "categories": [{"id": "c", "name": "C", "definition": "d", "subaspects": [{"id": "a", "name": "A", "definition": "x"}]}]}')
    (tmp_path / "ids.txt").write_text("# header\n12\n\n 34 \n")
    (tmp_path / "gold.json").write_text('[{"id": "7", "aspects": [{"id": "a", "sentiment": "+"}, {"id": "b", "sentiment": "-"}]}]')
    book = files.read_codebook(spark, str(tmp_path / "book.json")).orderBy("aspect_id").collect()
    assert [(r.codebook_version, r.aspect_id, r.category_name) for r in book] == [("v9", "a", "C"), ("v9", "other", "Other")]
    assert sorted(r.recommendation_id for r in files.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == [12, 34]
    assert sorted((r.recommendation_id, r.aspect_id, r.sentiment) for r in files.read_gold(spark, str(tmp_path / "gold.json")).collect()) == [(7, "a", "+"), (7, "b", "-")]


def test_windows_around_events_match_brute_force(spark):
    rng = random.Random(9)
    flat = [(rng.randint(1, 2), T0 + dt.timedelta(seconds=rng.randint(0, 40 * 86400)), rng.random() < 0.6) for _ in range(800)]
    patches = [(i, rng.randint(1, 2), T0 + dt.timedelta(seconds=rng.randint(0, 40 * 86400))) for i in range(30)]
    patches.append((99, flat[0][0], flat[0][1]))
    f = spark.createDataFrame(flat, "app_id int, created_at timestamp, voted_up boolean")
    p = spark.createDataFrame(patches, "patch_sk int, app_id int, published_at timestamp")
    got = {(r.patch_sk, r.window_code): (r.review_count, r.positive_count) for r in events.patch_impact(p, f).collect()}
    daily_got = {(r.patch_sk, r.window_code): r.review_count for r in events.patch_impact_daily(p, marts.review_daily(f)).collect()}
    for sk, app, at in patches:
        for code, a, b, base in events.WINDOWS:
            inside = [v for x, t, v in flat if x == app and at + dt.timedelta(a) <= t < at + dt.timedelta(b)]
            assert got[(sk, code)] == (len(inside), sum(inside))
            shift = 0 if base else 1
            days = [t for x, t, _ in flat if x == app and a + shift <= (t.date() - at.date()).days < b + shift]
            assert daily_got[(sk, code)] == len(days)


def test_streams_of_pages_in_several_batches(spark, tmp_path):
    import json

    def page(raw_id, fetched, votes, ids):
        reviews = [{"recommendationid": str(i), "language": "english", "review": f"r{raw_id}", "timestamp_created": 1700000000, "timestamp_updated": 0,
                    "voted_up": True, "votes_up": votes, "author": {"steamid": ""}} for i in ids]
        return raw_id, 1, "*", fetched, json.dumps({"cursor": "x", "reviews": reviews})

    dim = spark.createDataFrame([(5, 1, dt.datetime(2000, 1, 1), dt.datetime(2099, 1, 1))], "game_sk int, app_id int, valid_from timestamp, valid_to timestamp")
    landing, log, checkpoint = (str(tmp_path / n) for n in ("landing", "log", "checkpoint"))
    for pages in ([page(1, T0 + dt.timedelta(2), 5, [1, 2])], [page(2, T0, 1, [2, 3])], [page(3, T0 + dt.timedelta(3), 9, [1])]):
        raw.append_raw(spark.createDataFrame(pages, raw.RAW_SCHEMAS["reviews"]), landing)
        stream.stream_review_merge(stream.raw_stream(spark, landing, "reviews"), dim, log, checkpoint).awaitTermination()
    rows = {r.recommendation_id: r for r in stream.current_reviews(stream.read_log(spark, log)).collect()}
    assert {k: (r.votes_up, r.review_body, r.game_sk) for k, r in rows.items()} == {1: (9, "r3", 5), 2: (5, "r1", 5), 3: (1, "r2", 5)}
    assert rows[1].updated_at is None and rows[1].author_steam_id is None


def test_pages_to_facts_from_end_to_end(spark):
    import json

    dim = spark.createDataFrame([(5, 1, dt.datetime(2020, 1, 1), dt.datetime(2099, 1, 1))], "game_sk int, app_id int, valid_from timestamp, valid_to timestamp")
    languages = spark.createDataFrame([(3, "english")], "language_sk int, language_code string")
    reviews = [{"recommendationid": "1", "language": "english", "review": "a", "timestamp_created": 1700000000, "voted_up": True, "author": {"steamid": "9"}},
               {"recommendationid": "2", "language": "", "review": "b", "timestamp_created": 1500000000, "voted_up": False, "author": {}}]
    pages = spark.createDataFrame([(1, 1, "*", T0, json.dumps({"reviews": reviews})), (2, 1, "*", T0 + dt.timedelta(1), json.dumps({"reviews": [{**reviews[0], "votes_up": 4}]}))],
                                  raw.RAW_SCHEMAS["reviews"])
    rows = facts.review_facts(raw.explode_reviews(pages), dim, languages).orderBy("recommendation_id").collect()
    assert [(r.game_sk, r.language_sk, r.date_sk, r.time_sk, r.votes_up, r.author_steam_id) for r in rows] == [(5, 3, 20231114, 22, 4, 9), (-1, -1, 20170714, 2, 0, None)]
    news = [{"gid": "g1", "title": "Patch 1.2 notes", "url": "u", "feedname": "community", "feed_type": 1, "contents": "abcd", "date": 1700000000},
            {"gid": "g2", "title": "Patch 1.2 notes", "url": "u", "feedname": "site", "feed_type": 0, "contents": "", "date": 1700000000},
            {"gid": "g3", "title": "x", "url": "u", "feedname": "SteamDB", "feed_type": 0, "contents": "", "date": 1700000000}]
    news_pages = spark.createDataFrame([(1, 1, T0, json.dumps({"appnews": {"newsitems": news}}))], raw.RAW_SCHEMAS["news"])
    found = facts.patch_facts(raw.exclude_feeds(raw.explode_news(news_pages)), dim).orderBy("gid").collect()
    assert [(r.gid, r.event_type, r.version, r.is_patch, r.body_length, r.game_sk) for r in found] == [("g1", "patch", "1.2", True, 4, 5), ("g2", "press", None, False, 0, 5)]


def test_empty_card_pages_are_passed_over(spark):
    pages = spark.createDataFrame([(1, 1, T0, 200, "{}"), (2, 1, T0 + dt.timedelta(1), 429, None)], raw.RAW_SCHEMAS["appdetails"])
    assert [r.raw_id for r in raw.newest_cards(pages).collect()] == [1]


def test_increment_reads_by_mark_or_by_product(spark, tmp_path):
    from tideline.operators.facts import incremental_pages

    schema = "app_id int, fetched_at timestamp, page int"
    days = [dt.datetime(2024, 1, d) for d in range(1, 7)]
    rows = [(app, day, app * 10 + i) for app in (1, 2, 3) for i, day in enumerate(days)]
    spark.createDataFrame(rows, schema).write.partitionBy("app_id").parquet(str(tmp_path / "landing"))
    landing = spark.read.schema(schema).parquet(str(tmp_path / "landing"))
    marks = spark.createDataFrame([(1, days[4]), (2, days[2]), (3, None), (9, days[5])], "app_id int, loaded_from timestamp")
    fresh = incremental_pages(landing, marks)
    assert sorted(r.page for r in fresh.collect()) == [15, 23, 24, 25, 30, 31, 32, 33, 34, 35]
    assert incremental_pages(landing, marks.limit(0)).count() == 18
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "fetched_at" in plan and "Subquery" in plan


def test_increment_by_an_index_is_one_scan(spark, tmp_path):
    schema = "app_id int, fetched_at timestamp, page int"
    days = [dt.datetime(2024, 1, d) for d in range(1, 7)]
    rows = [(app, day, app * 10 + i) for app in (1, 2, 3, 4) for i, day in enumerate(days)]
    spark.createDataFrame(rows, schema).write.partitionBy("app_id").parquet(str(tmp_path / "landing"))
    landing = spark.read.schema(schema).parquet(str(tmp_path / "landing"))
    facts.landing_index(landing).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    # product 4 has nothing new, 3 has no mark, 9 has no pages
    marks = spark.createDataFrame([(1, days[4]), (2, days[2]), (3, None), (4, days[5]), (9, days[5])], "app_id int, loaded_from timestamp")
    fresh = facts.incremental_pages(landing, marks, index=index)
    assert sorted(r.page for r in fresh.collect()) == [15, 23, 24, 25, 30, 31, 32, 33, 34, 35]
    plan = fresh._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 0 and "Distinct" not in plan


def test_a_second_append_reads_ids_alone(spark, tmp_path):
    path = str(tmp_path / "landing")
    shape = "raw_id bigint, app_id int, cursor_in string, fetched_at timestamp, payload string"

    def land(pages):
        rows = spark.createDataFrame([(p, 1, "*", T0 + dt.timedelta(p), "x" * 50) for p in pages], shape)
        items = spark.createDataFrame([(p, i) for p, ids in pages.items() for i in ids], "raw_id bigint, recommendation_id bigint")
        return sorted(r.raw_id for r in raw.append_new(rows, items, path).collect())

    assert land({1: [10, 11], 2: [12]}) == [1, 2]
    assert land({3: [11, 12], 4: [12, 13], 5: []}) == [4]
    assert land({6: [13]}) == []
    assert sorted(r.raw_id for r in raw.read_raw(spark, path, "reviews").collect()) == [1, 2, 4]
    assert sorted(r.recommendation_id for r in raw.known_ids(spark, path).collect()) == [10, 11, 12, 13]
    files = raw.known_ids(spark, path).inputFiles()
    assert files and all("landing.ids/bucket=" in f for f in files)


def test_names_follow_the_card_read_last(spark):
    from tideline.operators.games import upsert_companies, upsert_names

    stored = spark.createDataFrame([(1, "old"), (2, "kept")], "id int, name string")
    told = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (1, "a", 2), (3, "new", 1)], "id int, name string, at int")
    assert sorted(map(tuple, upsert_names(stored, told, "id", "name", "at").collect())) == [(1, "a"), (2, "kept"), (3, "new")]
    companies = spark.createDataFrame([(7, "Ann")], "company_sk bigint, company_name string")
    fresh = spark.createDataFrame([("Ann",), ("Bob",), ("Bob",)], "company_name string")
    got = {r.company_name: r.company_sk for r in upsert_companies(companies, fresh).collect()}
    assert got["Ann"] == 7 and set(got) == {"Ann", "Bob"}


def test_lines_that_are_no_ids_are_told(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("# list\n 7 \n\n12x\n9223372036854775808\n-3\n")
    path = str(tmp_path / "ids.txt")
    assert sorted(r.recommendation_id for r in files.read_ids(spark, path).collect()) == [-3, 7]
    assert sorted(r.line for r in files.bad_id_lines(spark, path).collect()) == ["12x", "9223372036854775808"]


def test_a_card_document_is_parsed_once(spark):
    from tideline.sources import raw

    pages = spark.createDataFrame([(7, '{"7": {"success": true, "data": {"steam_appid": 7, "name": "x"}}}'), (8, "{}"), (9, None)], "app_id int, payload string")
    cards = raw.pick_card(pages)
    assert cards._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert {r.app_id: r.card.data.name if r.card else None for r in cards.collect()} == {7: "x", 8: None, 9: None}


def test_impact_at_the_borders_of_blocks_and_days_with_one_shuffle_of_events(spark):
    """Edges on, just before and just after block starts and midnights, before 1970 too, against a count of every review."""
    day, block = events.DAY_SECONDS, events.BLOCK_SECONDS
    rng = random.Random(5)
    spots = [d * day + b * block + s for d in (-20, -3, -1, 0, 1, 4, 11, 30) for b in (0, 1, 95) for s in (-1, 0, 1, block - 1)]
    reviews = [(rng.choice((1, 2, None)), rng.choice(spots), rng.choice((True, False, None))) for _ in range(600)] + [(1, None, True)]
    patches = [(k, rng.choice((1, 2, 3, None)), rng.choice(spots)) for k in range(60)] + [(60, 1, None), (61, 1, 0), (61, 1, 0)]
    f = spark.createDataFrame(reviews, "app_id int, s long, voted_up boolean").select("app_id", F.timestamp_seconds("s").alias("created_at"), "voted_up")
    p = spark.createDataFrame(patches, "patch_sk long, app_id int, s long").select("patch_sk", "app_id", F.timestamp_seconds("s").alias("published_at"))
    out = events.patch_impact(p, f)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and plan.index("Generate explode") < plan.index("REPARTITION_BY_COL")
    want = []
    for sk, app, at in dict.fromkeys(patches):
        own = [(s, up) for a, s, up in reviews if a == app and a is not None and s is not None]
        if own and at is not None:
            for code, lo, hi, _ in events.WINDOWS:
                inside = [up for s, up in own if at + lo * day <= s < at + hi * day]
                whole = at + lo * day >= min(s for s, _ in own) and at + hi * day <= max(s for s, _ in own)
                want.append((sk, code, len(inside), sum(bool(up) for up in inside), whole))
    got = [(r.patch_sk, r.window_code, r.review_count, r.positive_count, r.window_complete) for r in out.collect()]
    assert sorted(got) == sorted(want) and any(n for _, _, n, _, _ in want)


def test_event_impact_never_shuffles_edges(spark):
    """Events travel as they are and as one row each; their eight edges meet where they are counted."""
    f = spark.createDataFrame([(1, T0, True)], "app_id int, created_at timestamp, voted_up boolean")
    p = spark.createDataFrame([(1, 1, T0)], "patch_sk long, app_id int, published_at timestamp")
    plan = events.event_impact(events.patch_impact(p, f))._jdf.queryExecution().executedPlan().toString()
    by = [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert not [x for x in by if "second" in x or "edge" in x]
    assert sum("block" in x and "day_no" not in x for x in by) == 1


def test_event_impact_counts_two_windows_and_keeps_each_event_where_it_is(spark):
    """Without the mart: the same events, three edges an event, and no shuffle of events by their key."""
    rng = random.Random(3)
    day = events.DAY_SECONDS
    reviews = [(rng.choice((1, 2)), rng.randrange(60 * day), rng.random() < 0.5) for _ in range(1500)]
    patches = [(k, rng.choice((1, 2, 3)), rng.randrange(60 * day)) for k in range(80)] + [(80, 1, 20 * day), (80, 1, 20 * day), (81, None, 0)]
    f = spark.createDataFrame(reviews, "app_id int, s long, voted_up boolean").select("app_id", F.timestamp_seconds("s").alias("created_at"), "voted_up")
    p = spark.createDataFrame(patches, "patch_sk long, app_id int, s long").select("patch_sk", "app_id", F.timestamp_seconds("s").alias("published_at"))
    out = events.event_impact_now(p, f, 10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    by = [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert by and not [x for x in by if "patch_sk" in x]
    got = sorted(out.collect())
    assert len(got) == 20 and got == sorted(events.event_impact(events.patch_impact(p, f), 10).collect())
    assert events._offsets(events.SIDES) == [-7, 0, 7]
