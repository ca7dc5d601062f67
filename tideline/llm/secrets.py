"""Secret scans through a trigram inverted index, in DataFrame operations only.

Every rule is a regular expression. Its syntax tree gives a Boolean query: one branch per way to spell its
literal parts, and the trigrams that this spelling must contain. The index holds, for each segment of the
documents, which texts hold which of those trigrams; postings are intersected within a branch and united over
the branches, and only the texts left are verified with the expression. A rule that some text can match
without a known trigram scans every text.

Positions come from the pieces between matches: a match starts where the lengths of all pieces and matches before
it end. These sums run over rows, so the number of matches in a text is not bounded by one value.

Texts are named by a digest while they are looked up, so copies are indexed and verified as one text.

Defined cases: null and empty texts have no secrets; repeated rows each get the result of their text; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.shared import written

#: trigrams of a branch that are looked up; any part of them is a sound filter
PER_BRANCH = 3
#: spellings of a rule beyond which it is not expanded
MOST_BRANCHES = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, in either case if ``any_case``, whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


#: fixed values: the base rules in the order in which kinds are listed
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    # a maximal run of at least 24 is the same as a run whose length is looked at afterwards
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: fixed values: public formats of credentials, listed after the base
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + ADDED


def spellings(pattern: str) -> list[list[str]] | None:
    """Ways to spell a pattern, each the literal runs it must contain; None if there are too many."""
    parser = re._parser  # the syntax tree of the standard library

    def extend(ways, pieces):
        """Every way followed by every piece; a piece's first run joins on, None is a gap."""
        out = [[*way[:-1], way[-1] + piece[0], *piece[1:]] for way, piece in product(ways, pieces)]
        return out if len(out) <= MOST_BRANCHES else None

    gap = [["", ""]]

    def walk(nodes):
        ways = [[""]]
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                pieces = [[chr(arg)]]
            elif name == "SUBPATTERN":
                pieces = walk(arg[-1])
            elif name == "BRANCH":
                inner = [walk(branch) for branch in arg[1]]
                pieces = None if None in inner else [p for part in inner for p in part]
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 5:
                pieces = [[chr(a)] for _, a in arg]
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, body = arg
                inner = walk(body)
                if inner is None:
                    return None
                if (low, high) == (0, 1):
                    # one optional spelling is spelled both ways, a choice of them is a gap
                    pieces = [[""], *inner] if len(inner) == 1 else gap
                else:
                    pieces = [[""]]
                    for _ in range(min(low, 3)):
                        pieces = extend(pieces, inner)
                        if pieces is None:
                            return None
                    if (low, high) != (min(low, 3), min(low, 3)):
                        pieces = extend(pieces, gap)
            else:
                pieces = gap
            ways = None if pieces is None else extend(ways, pieces)
            if ways is None:
                return None
        return ways

    return walk(parser.parse(pattern))


def trigram_query(rule: Rule, most: int = PER_BRANCH) -> list[tuple[str, ...]] | None:
    """Branches of lower-case trigrams, one of which every match holds whole; None if a match may hold none."""
    ways = spellings(rule.pattern)
    if ways is None:
        return None
    branches = set()
    for way in ways:
        grams = list(dict.fromkeys(run.lower()[i: i + 3] for run in way for i in range(len(run) - 2)))
        # case folding must not change lengths, so only ASCII trigrams are looked up
        grams = [g for g in grams if g.isascii()]
        if not grams:
            return None
        step = max(1, -(-len(grams) // most))
        branches.add(tuple(grams[::step][:most]))
    # a branch that holds another one whole adds nothing
    return sorted(b for b in branches if not any(set(o) < set(b) for o in branches))


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(body.alias("text"), F.unhex(F.md5(body.cast("binary"))).alias("key"))


def trigram_index(docs: DataFrame, grams: list[str], text_col: str = "text") -> DataFrame:
    """Postings (segment, gram, keys) of the given trigrams; a segment is a sixteenth of one task's documents."""
    keyed = _keyed(docs, text_col)
    lower = F.lower("text")
    present = F.array_compact(F.array(*[F.when(F.contains(lower, F.lit(g)), F.lit(g)) for g in grams]))
    return (
        keyed.select(
            (F.spark_partition_id() * 16 + F.conv(F.substring(F.hex("key"), 1, 1), 16, 10).cast("int")).alias("segment"),
            F.explode(present).alias("gram"),
            "key",
        )
        .groupBy("segment", "gram")
        .agg(F.collect_set("key").alias("keys"))
    )


def candidates(index: DataFrame, queries: dict[str, list[tuple[str, ...]]]) -> DataFrame:
    """(key, kinds): texts that pass the query of some rule, and those rules."""
    segments = index.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("postings"))

    def posting(gram: str) -> Column:
        return F.coalesce(F.element_at("postings", F.lit(gram)), F.array().cast("array<binary>"))

    def branch(grams: tuple[str, ...]) -> Column:
        keys = posting(grams[0])
        for gram in grams[1:]:
            keys = F.array_intersect(keys, posting(gram))
        return keys

    found = []
    for kind, branches in queries.items():
        keys = branch(branches[0])
        for grams in branches[1:]:
            keys = F.array_union(keys, branch(grams))
        found.append(F.struct(F.lit(kind).alias("kind"), keys.alias("keys")))
    return (
        segments.select(F.explode(F.array(*found)).alias("hit"))
        .select("hit.kind", F.explode("hit.keys").alias("key"))
        .groupBy("key")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def _matches(rule: Rule) -> Column:
    """Of every match in ``text``: the piece before it, its length and the length of what the rule measures."""
    pattern = F.lit(rule.java)
    whole = F.regexp_extract_all("text", pattern, F.lit(0))
    measured = whole if rule.group == 0 else F.regexp_extract_all("text", pattern, F.lit(rule.group))
    pieces = F.slice(F.split("text", rule.java, -1), F.lit(1), F.size(whole))
    parts = F.transform(
        F.arrays_zip(pieces.alias("piece"), whole.alias("match"), measured.alias("part")),
        lambda m: F.struct(F.length(m["piece"]).alias("gap"), F.length(m["match"]).alias("len"), F.length(m["part"]).alias("part")),
    )
    return F.when(F.rlike("text", pattern), parts)


def _verified(texts: DataFrame, rule: Rule) -> DataFrame:
    return texts.select("key", F.lit(rule.kind).alias("kind"), F.posexplode(_matches(rule)).alias("n", "m")).select("key", "kind", "n", "m.gap", "m.len", "m.part")


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """(key, kind, start, end) of every secret of every distinct text; ``text_key`` gives a text's key."""
    queries = {r.kind: trigram_query(r) for r in rules}
    indexed = {kind: q for kind, q in queries.items() if q}
    keyed = _keyed(docs, text_col)
    parts = [_verified(keyed, r) for r in rules if not queries[r.kind]]
    if indexed:
        grams = sorted({g for branches in indexed.values() for b in branches for g in b})
        # written, so that the size of the candidates is known when the join with the texts is planned
        hits = written(candidates(trigram_index(docs, grams, text_col), indexed), "secret-candidates")
        texts = keyed.join(hits, "key")
        # one pass over the candidates: each rule looks at those its query let through
        matches = F.array(*[
            F.struct(F.lit(r.kind).alias("kind"), F.when(F.array_contains("kinds", F.lit(r.kind)), _matches(r)).alias("found"))
            for r in rules if r.kind in indexed
        ])
        parts.append(
            texts.select("key", F.explode(matches).alias("r"))
            .select("key", "r.kind", F.posexplode("r.found").alias("n", "m"))
            .select("key", "kind", "n", "m.gap", "m.len", "m.part")
        )
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    least = F.create_map(*[F.lit(v) for r in rules for v in (r.kind, r.least)])
    before = Window.partitionBy("key", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # copies of a text give equal rows
    return (
        rows.distinct()
        .withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before))
        .where(F.col("part") >= least[F.col("kind")])
        .select("key", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    )


def text_key(text_col: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, a count per base kind, the spans of the base and all spans, as ordered arrays of text.

    A span reads kind:start:end in code points; spans are ordered by start, then as kinds are listed.
    """
    places = {r.kind: k for k, r in enumerate(rules)}
    order = F.create_map(*[F.lit(v) for kind, k in places.items() for v in (kind, k)])
    spans = secret_spans(docs, rules, text_col).withColumn("place", order[F.col("kind")])
    label = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    entry = F.struct("start", "place", label.alias("label"))
    per_text = spans.groupBy("key").agg(
        *[F.count(F.when(F.col("kind") == r.kind, 1)).alias(f"n_{r.kind}") for r in rules[:base]],
        F.sort_array(F.collect_list(F.when(F.col("place") < base, entry)))["label"].alias("base_spans"),
        F.sort_array(F.collect_list(entry))["label"].alias("spans"),
    )
    named = docs.select(F.col(id_col), text_key(text_col).alias("key")).join(per_text, "key", "left")
    none = F.array().cast("array<string>")
    return named.select(
        id_col,
        *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules[:base]],
        F.coalesce("base_spans", none).alias("base_spans"),
        F.coalesce("spans", none).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]", rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The documents with the characters of all spans replaced by one mark per run; other texts stay as they are."""
    spans = secret_spans(docs, rules, text_col)
    ahead = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    # the parts of a text that stay: from the furthest end so far to the next start beyond it
    gaps = spans.withColumn("from", F.coalesce(F.max("end").over(ahead), F.lit(0))).where("start > from or (start = 0 and from = 0)")
    per_text = gaps.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "from"))).alias("gaps"))
    last = spans.groupBy("key").agg(F.max("end").alias("last"))
    marked = docs.withColumn("\u0001key", text_key(text_col)).join(per_text.join(last, "key").withColumnRenamed("key", "\u0001key"), "\u0001key", "left")
    body = F.concat(
        F.array_join(F.transform("gaps", lambda g: F.concat(F.substring(F.col(text_col), g["from"] + 1, g["start"] - g["from"]), F.lit(mark))), ""),
        F.substring(F.col(text_col), F.col("last") + 1, F.length(text_col)),
    )
    return marked.select(*[F.when(F.col("last").isNull(), F.col(c)).otherwise(body).alias(c) if c == text_col else F.col(c) for c in docs.columns])
