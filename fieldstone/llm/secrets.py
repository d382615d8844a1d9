"""Secret scan over a trigram inverted index, in DataFrame expressions only.

Each rule is a regular expression.  `trigram_query` derives from it a Boolean
query over lower-cased trigrams: an OR of clauses, each an AND of trigrams that
every match must contain; `index_query` keeps the rarest of each.  `postings` lists, for the bounded set of trigrams in
the rules' queries, the documents that contain them; `candidates` intersects
the postings clause by clause.  Only candidates are verified with the regular
expression; rules without mandatory trigrams scan every text.

Defined results: a null text counts as empty; a null doc_id is an ordinary
value; repeated rows are judged each on its own; an empty table gives an empty
table; only doc_id and text are read, so other columns can have any names.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let, most, running_before, total


@dataclass(frozen=True)
class Rule:
    """kind: name in spans; group: the group whose length must be at least min_chars."""

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 1


#: Fixed by the contract of the query.  For access and hex the least length is part of the pattern: a run of one
#: character class is matched as a whole or not at all, so no match of a later part can take the place of a short one.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Token formats that carry their own marker.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("github_pat", r"github_pat_[A-Za-z0-9_]{22,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("slack_hook", r"https://hooks\.slack\.com/services/[A-Za-z0-9/]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("aws_session", r"ASIA[A-Z0-9]{16,}"),
    Rule("azure_storage", r"AccountKey=[A-Za-z0-9+/]{86}=="),
    Rule("google_api", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("google_oauth", r"ya29\.[A-Za-z0-9_-]{20,}"),
    Rule("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-[A-Za-z0-9_-]{60,}"),
    Rule("model_hub", r"hf_[A-Za-z0-9]{30,}"),
    Rule("digitalocean", r"do[oprt]_v1_[0-9a-f]{64}"),
    Rule("shopify", r"shp(?:at|ca|pa|ss)_[0-9A-Fa-f]{32}"),
    Rule("mailgun", r"key-[0-9a-f]{32}"),
    Rule("square", r"sq0(?:atp|csp)-[A-Za-z0-9_-]{22,}"),
    Rule("databricks", r"dapi[0-9a-f]{32}"),
    Rule("new_relic", r"NRAK-[A-Z0-9]{27}"),
    Rule("linear", r"lin_api_[A-Za-z0-9]{40}"),
    Rule("docker", r"dckr_pat_[A-Za-z0-9_-]{27}"),
    Rule("vault", r"hvs\.[A-Za-z0-9_-]{24,}"),
    Rule("age", r"AGE-SECRET-KEY-1[0-9A-Z]{58}"),
    Rule("telegram", r"[0-9]{8,10}:AA[A-Za-z0-9_-]{33}"),
    # the whole block up to its footer; without one, the lines of base64 that follow the header
    Rule(
        "pem",
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
        r"(?:[A-Za-z0-9+/=:,\x20\x09-\x0D]*+(?:-[A-Za-z0-9+/=:,\x20\x09-\x0D]++){0,8}+-----END [A-Z ]{0,40}PRIVATE KEY-----"
        r"|(?:[\x20\x09-\x0D]{1,8}[A-Za-z0-9+/=]{32,}+){0,400})",
    ),
)
RULES = BASE_RULES + MORE_RULES

_MOST_STRINGS = 64
_MOST_TRIGRAMS = 2
#: Letters from the rarest in prose to the commonest.
_LETTERS = "zqxjkvbpygfwmucldrhsnioate"


def _strings(items) -> set[str] | None:
    """All strings that a sequence of parsed items matches, lower-cased; None if too many or unknown."""
    found = {""}
    for op, arg in items:
        one = _one(op, arg)
        if one is None or len(found) * len(one) > _MOST_STRINGS:
            return None
        found = {a + b for a in found for b in one}
    return found


def _one(op, arg) -> set[str] | None:
    if op is rc.LITERAL:
        return {chr(arg).lower()}
    if op in (rc.AT, rc.ASSERT, rc.ASSERT_NOT):
        return {""}
    if op is rc.IN and all(kind is rc.LITERAL for kind, _ in arg):
        return {chr(c).lower() for _, c in arg}
    if op is rc.SUBPATTERN:
        return _strings(arg[3])
    if op is rc.BRANCH:
        parts = [_strings(branch) for branch in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is rc.MAX_REPEAT and arg[1] <= 4:
        inner = _strings(arg[2])
        out, power = set(), {""}
        for n in range(arg[1] + 1) if inner is not None else ():
            out |= power if n >= arg[0] else set()
            power = {a + b for a in power for b in inner}
            if len(power) > _MOST_STRINGS:
                return None
        return out or None
    return None


def _flat(items):
    """Groups without alternatives opened up, so that their literals join those around them."""
    for op, arg in items:
        if op is rc.SUBPATTERN and _strings(arg[3]) is None:
            yield from _flat(arg[3])
        else:
            yield op, arg


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of which one must hold, each a set of trigrams that must all occur; None: scan all."""
    clauses: set[frozenset[str]] = {frozenset()}
    current: set[str] = {""}

    def flush() -> None:
        nonlocal clauses, current
        clauses = {c | {s[i : i + 3] for i in range(len(s) - 2)} for c in clauses for s in current}
        current = {""}

    for op, arg in _flat(rp.parse(pattern)):
        one = _one(op, arg)
        if one is None or len(current) * len(one) > _MOST_STRINGS:
            flush()
            current = one if one is not None else {""}
        else:
            current = {a + b for a in current for b in one}
    flush()
    if frozenset() in clauses:
        return None
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def index_query(pattern: str) -> list[frozenset[str]] | None:
    """The trigram query with at most _MOST_TRIGRAMS of each clause, those that prose has least often; what it lets through is verified anyway."""
    clauses = trigram_query(pattern)
    # signs and digits first, then letters by how rare they are in prose
    common = lambda t: (sum(_LETTERS.find(c) + 1 for c in t), t)
    return clauses and [frozenset(sorted(c, key=common)[:_MOST_TRIGRAMS]) for c in clauses]


def _keyed(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", *carried, text.alias("text"), F.xxhash64(text).alias("text_key"))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: a row for each of the trigrams and each document that contains it."""
    present = let(F.lower("text"), lambda low: F.filter(F.array(*map(F.lit, trigrams)), lambda t: low.contains(t)))
    return _keyed(docs).select("doc_id", "text_key", F.explode(present).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """For each document with some: the kinds of the rules one of whose clauses has all its trigrams there.

    The rules' terms are a table bounded by the rules, so it is broadcast; postings are summed up
    before the shuffle (a bit for each trigram of a clause).
    """
    terms = [
        (t, r.kind, n, 1 << i, (1 << len(clause)) - 1)
        for r in rules
        for n, clause in enumerate(index_query(r.pattern) or [])
        for i, t in enumerate(sorted(clause))
    ]
    table = docs.sparkSession.createDataFrame(terms, "trigram string, kind string, clause int, bit long, whole long")
    met = (
        postings(docs, sorted({t[0] for t in terms}))
        .join(F.broadcast(table), "trigram")
        .groupBy("doc_id", "text_key", "kind", "clause", "whole")
        .agg(F.bit_or("bit").alias("bits"))
        .filter("bits = whole")
    )
    return met.groupBy("doc_id", "text_key").agg(F.collect_set("kind").alias("kinds"))


def _parts(text: Column, rule: Rule, order: int) -> Column:
    """All matches of a rule, the texts between them and the values whose length counts."""
    pattern = F.lit(rule.pattern)
    return F.struct(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
        F.lit(order).alias("kind_order"),
        F.lit(rule.kind).alias("kind"),
        F.lit(rule.min_chars).alias("min_chars"),
    )


def _spans(parts: Column) -> Column:
    """Leftmost non-overlapping matches that are long enough: structs of start, kind's order, end, kind."""

    def placed(before: Column) -> Column:
        return F.transform(parts["match"], lambda m, i: one(before[i] + F.length(parts["gap"][i]), m, i))

    def one(start: Column, match: Column, i: Column) -> Column:
        span = F.struct(start.alias("start"), parts["kind_order"].alias("kind_order"), (start + F.length(match)).alias("end"), parts["kind"].alias("kind"))
        return F.when(F.length(parts["value"][i]) >= parts["min_chars"], span)

    lengths = F.transform(parts["match"], lambda m, i: F.length(parts["gap"][i]).cast("long") + F.length(m))
    return F.array_compact(let(running_before(lengths, total), placed))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, text and the array `found` of spans (start, kind_order, end, kind), sorted; ends are exclusive code points."""
    keyed = _keyed(docs, carried)
    indexed = {r.kind for r in rules if trigram_query(r.pattern)}
    if indexed:
        hits = candidates(docs, rules).select(F.col("doc_id").alias("at_id"), F.col("text_key").alias("at_key"), "kinds")
        keyed = keyed.join(hits, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_key") == F.col("at_key")), "left")
    else:
        keyed = keyed.withColumn("kinds", F.array().cast("array<string>"))
    parts = []
    for order, r in enumerate(rules):
        if r.kind in indexed:
            first = F.array_contains(F.coalesce("kinds", F.array().cast("array<string>")), r.kind)
        else:
            first = F.col("text").rlike(r.pattern)
        parts.append(F.when(first, _parts(F.col("text"), r, order)))
    found = F.flatten(F.transform(F.array_compact(F.array(*parts)), _spans))
    return keyed.select("doc_id", *carried, "text", F.array_sort(found).alias("found"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans and all spans as text, one row per document."""
    base = [r.kind for r in BASE_RULES]
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs, rules).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(_written(F.filter("found", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        _written(F.col("found")).alias("spans"),
    )


#: Code points of a text that are cut at a time.
_CHUNK = 1024


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end (exclusive) of a text in chunks."""
    a, b = F.floor(start / _CHUNK).cast("int"), F.floor(end / _CHUNK).cast("int")
    at, to = (start % _CHUNK).cast("int"), (end % _CHUNK).cast("int")
    chunk = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
    between = F.array_join(F.slice(chunks, a + 2, b - a - 1), "")
    apart = F.concat(F.substring(chunk(a), at + 1, F.lit(_CHUNK)), between, F.substring(chunk(b), F.lit(1), to))
    return F.when(start >= end, "").when(a == b, F.substring(chunk(a), at + 1, to - at)).otherwise(apart)


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by a mark; overlapping spans share one.

    The text is cut in chunks once, and a span costs no more than a few chunks and what lies before it.
    """
    ends = F.transform(found, lambda s: s["end"])

    def cut(chunks: Column) -> Column:
        return let(running_before(ends, most), lambda reached: joined(chunks, reached))

    def joined(chunks: Column, reached: Column) -> Column:
        pieces = F.transform(
            found, lambda s, i: F.when(s["start"] >= reached[i], F.concat(_cut(chunks, reached[i], s["start"]), F.lit(mark))).otherwise("")
        )
        return F.concat(F.array_join(pieces, ""), _cut(chunks, most(ends), F.length(text).cast("long")))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    return F.when(F.size(found) == 0, text).otherwise(let(chunks, cut))


def clean(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs, with all their columns: secrets in text are replaced, and n_chars, if there, follows."""
    others = F.struct(F.col("text").isNull().alias("no_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(0)]).alias("of"))
    packed = docs.select("doc_id", "text", others.alias("whole"))
    found = scan(packed, rules, ("whole",)).select("whole", F.size("found").alias("n_found"), redact(F.col("text"), F.col("found")).alias("clean"))
    changed = {"text": F.when(~F.col("whole.no_text"), F.col("clean"))}
    if "n_chars" in docs.columns:
        new = F.length("clean").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("n_found") == 0, F.col("whole.of.n_chars")).otherwise(new)
    return found.select(*[changed.get(c, F.col(f"whole.of.`{c}`")).alias(c) for c in docs.columns])
