"""Kinds, versions and labels read from news titles and store links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the platform's own id, a feed that is not news, the type of a product's own feed
PLATFORM_APP_ID = 753
EXCLUDED_FEEDS = ("SteamDB",)
OWN_FEED_TYPE = 1

# fixed values: title patterns and the kind each one means; the first hit wins
TITLE_RULES = (
    (r"\b(coming|arrives?|arriving|releases? (date|schedule)|launch (date|times?))\b", "announce"),
    (r"\b(next week|next month|soon|upcoming|preview|pre-?(purchase|order|load))\b", "announce"),
    (r"\b(until|before) \b", "announce"),
    (r"\bmark your calendars?\b", "announce"),
    (r"\b(sale|discount|% off|bundle|deal)\b", "marketing"),
    (r"\b(twitch drops?|lootbox|loot hunt|giveaway|xp (bonus|boost|weekend))\b", "marketing"),
    (r"\b(trailer|cinematic|livestream|spotlight|animated short)\b", "marketing"),
    (r"\b(contest|nominate|awards?|anniversary|celebrat)\w*\b", "marketing"),
    (r"\b(collab|crossover|\bx\b .*(pack|dlc|bundle))\b", "marketing"),
    (r"\b(warbond|cosmetic|skin|plush|merch|trading cards)\b", "marketing"),
    (r"\b(million (players|sold)|surpasses|\d+[km]?\+? (sold|players|members|reviews))\b", "marketing"),
    (r"\bthis week in\b", "blog"),
    (r"\bdirector'?s take\b", "blog"),
    (r"\bdev(eloper)?'?s? (update|insights?|diary|blog|stream|team)\b", "blog"),
    (r"\bword from the devs\b", "blog"),
    (r"\bdevelopment blog\b", "blog"),
    (r"\b(community update \d+)\b", "blog"),
    (r"\b(roadmap|status update|town hall|state of the game|tech blog)\b", "blog"),
    (r"\b(letter from|transmission from|note (from|on))\b", "blog"),
    (r"\b(maintenance|delay|delist|survey)\b", "service"),
    (r"\bmidseason\b", "patch"),
    (r"(?<!mid[- ])\bseason \d+\s*[:–—-]", "season_start"),
    (r"(?<!mid[- ])\bseason \d+\b.*\b(now live|is here|live now|begins?|available now|out now)\b", "season_start"),
    (r"\bseason of \w", "season_start"),
    (r"\bexpansion\b.*\b(available|out now|live)\b", "expansion"),
    (r"\b(patch|release|update|hotfix) notes?\b", "patch"),
    (r"\b(hotfix|changelog)\b", "patch"),
    (r"\b(patch|update|hotfix)\s*#?\s*\d", "patch"),
)
# fixed values: words that make or unmake a kind, and what a version looks like
BETA = r"\b(public test|experimental|exp|beta|test branch|b\d+)\b"
STABLE = r"\b(stable|public branch)\b"
NOT_SEASON = (
    r"\b(season|battle) pass\b|\bteaser\b|\bcomes to a close\b"
    r"|\bdev corner\b|\bepisode \d+\b|\bstreamers?\b"
)
VERSION = r"(?:^|\s|[vV#])(\d+\.\d+(?:\.\d+)*)"
NOT_VERSION = r"\d+[\.,]?\d*\s*(million|k\+|m\+|%|years?|players|sold)"
MAX_MAJOR_VERSION = 100

# fixed values: platform-wide events, in the order they are tried
PLATFORM_RULES = (
    (r"\bsteam\s+awards\b", "awards"),
    (
        r"\b(summer|winter|spring|autumn|fall|holiday|black\s+friday|"
        r"halloween|lunar new year|chinese new year|christmas)\s+(?:steam\s+)?sale\b",
        "sale",
    ),
    (r"\b\w+\s+fest\b", "fest"),
)
# fixed values: what a display name takes from a title, and the link of a product
SALE_SEASON = (
    r"\b(summer|winter|spring|autumn|fall|holiday|black friday|"
    r"halloween|lunar new year|chinese new year|christmas)\s+(?:steam\s+)?sale\b"
)
FEST_NAME = r"\b(\w+)\s+fest\b"
STORE_LINK = r"store\.steampowered\.com/app/(\d+)"


def _hit(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike("(?iU)" + pattern), F.lit(False))


def extract_version(title: Column) -> Column:
    """First dotted number of a title, unless it counts players or years or its major part is above 100."""
    found = F.nullif(F.regexp_extract(title, "(?U)" + VERSION, 1), F.lit(""))
    major = F.substring_index(found, ".", 1).try_cast("bigint")
    return F.when(~_hit(title, NOT_VERSION) & (major <= MAX_MAJOR_VERSION), found)


def title_kind(title: Column) -> Column:
    kind = F.when(_hit(title, BETA) & ~_hit(title, STABLE), "beta")
    not_season = _hit(title, NOT_SEASON)
    for pattern, name in TITLE_RULES:
        hit = _hit(title, pattern)
        kind = kind.when(hit & ~not_season if name == "season_start" else hit, name)
    return kind.when(extract_version(title).isNotNull(), "patch").otherwise("unknown")


def news_kind(title: Column, feed_type: Column) -> Column:
    """Kind of a news item; feeds other than the product's own are press."""
    return F.when(feed_type == OWN_FEED_TYPE, title_kind(title)).otherwise("press")


def news_version(title: Column, feed_type: Column) -> Column:
    return F.when(feed_type == OWN_FEED_TYPE, extract_version(title))


def platform_kind(title: Column) -> Column:
    """awards, sale or fest; null for news that is not an event of the platform."""
    kind = None
    for pattern, name in PLATFORM_RULES:
        hit = _hit(title, pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return kind


def platform_label(kind: Column, title: Column) -> Column:
    """Short display name: the season of a sale, the name of a fest."""

    def named(pattern: str, lead: str, tail: str, plain: str) -> Column:
        found = F.nullif(F.regexp_extract(title, "(?i)" + pattern, 1), F.lit(""))
        words = F.transform(F.split(found, " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2))))
        word = F.array_join(words, " ")
        return F.coalesce(F.concat(F.lit(lead), word, F.lit(tail)), F.lit(plain))

    return (
        F.when(kind == "awards", "Steam Awards")
        .when(kind == "sale", named(SALE_SEASON, "Steam ", " Sale", "Steam Sale"))
        .when(kind == "fest", named(FEST_NAME, "", " Fest", "Steam Fest"))
        .otherwise(title)
    )


def app_reference(raw: Column) -> Column:
    """Product id from a store link or from bare digits."""
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    linked = F.nullif(F.regexp_extract(text, STORE_LINK, 1), F.lit("")).try_cast("int")
    digits = F.when(text.rlike(r"^\d+$"), text.try_cast("int"))
    return F.coalesce(linked, F.when(digits > 0, digits))
