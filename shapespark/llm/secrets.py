"""Secret scan with a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: which three-character strings any matching text must have. The
index posts, for every trigram that some query names, the keys of the texts that have it, in blocks of texts of bounded size. The queries are
evaluated by intersecting and uniting postings within each block; what remains are candidates, which the expression itself verifies. Rules
without a mandatory trigram scan all texts.

Trigrams are taken from lower-cased texts, which only adds candidates. Positions are in code points. A text is split by the expression, so
that the lengths of the pieces between matches and of the matches give all positions.

Defined cases: a null text is an empty one; an empty text has no spans; a very long text is scanned whole, in time in proportion to its length
and matches; spans that start alike are ordered by kind, as listed; rows that share a doc_id, or repeat wholly, each get a row; a null doc_id is
kept; an empty table gives no rows; other columns are ignored (in redact_secrets: returned).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, join_sized, let, materialise, row_keys, running, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches of pattern are leftmost and don't overlap; afterwards those are dropped whose group has fewer than least
    characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # the same spans as [0-9a-f]+ with shorter ones dropped: a run of these characters matches whole or not at all
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: What follows a private key's first line: anything up to its last line (single dashes are those of header lines), or, where that is missing,
#: known header lines and base64 lines: up to the last long run, and one run more. Java, RE2 and Python read it alike; runs of one class need no
#: stack, however long they are.
KEY_BODY = (
    r"(?:[^-]*(?:-[^-]+){0,64}-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:[\x20\t\r\n\\]*Proc-Type:\x20*4,ENCRYPTED[\x20\t\r\nn\\]*DEK-Info:\x20*[A-Z0-9-]+,[0-9A-Fa-f]+)?"
    r"(?:[A-Za-z0-9+/=\\\x20\t\r\n]*[A-Za-z0-9+/=]{40}[A-Za-z0-9+/=]*(?:[\x20\t\r\n\\]+[A-Za-z0-9+/]+=*)?|[\x20\t\r\n\\]+[A-Za-z0-9+/]{16,}=*)?)"
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----" + KEY_BODY),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE
#: Texts of one block of the index, about.
BLOCK_TEXTS = 16_384
#: Code points of one block of a text that is cut into parts.
TEXT_BLOCK = 1024
#: What a candidate's key takes in a broadcast table, about.
CANDIDATE_BYTES = 48

# A query is True (any text), a trigram, or ("and" | "or", frozenset of queries).
Query = bool | str | tuple
EXACT_MOST = 64


def _join(kind: str, parts: list[Query]) -> Query:
    if kind == "or" and any(p is True for p in parts):
        return True
    kept: set = set()
    for p in parts:
        if p is not True:
            kept |= p[1] if isinstance(p, tuple) and p[0] == kind else {p}
    if not kept:
        return True
    if kind == "or":  # what another part already implies adds nothing
        sets = {q: q[1] if isinstance(q, tuple) else frozenset([q]) for q in kept if not isinstance(q, tuple) or q[0] == "and"}
        kept = {q for q in kept if q not in sets or not any(p != q and sets[p] < sets[q] for p in sets)}
    return next(iter(kept)) if len(kept) == 1 else (kind, frozenset(kept))


def _of_strings(strings: set[str]) -> Query:
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings]) if strings else True


def _analyse(tree) -> tuple[set[str] | None, Query]:
    """The strings that a parsed expression matches, if they are few, else None; and what its matches must have besides."""
    exact: set[str] | None = {""}
    need: list[Query] = []
    whole = True

    def close() -> None:
        nonlocal exact, whole
        if exact:
            need.append(_of_strings(exact))
        exact, whole = None, False

    for op, value in tree:
        if op is C.LITERAL:
            part, query = {chr(value).lower()}, True
        elif op is C.IN:
            chars = {chr(v).lower() for k, v in value if k is C.LITERAL} if all(k is C.LITERAL for k, _ in value) else None
            part, query = chars, True
        elif op is C.SUBPATTERN:
            part, query = _analyse(value[3])
        elif op is C.BRANCH:
            found = [_analyse(b) for b in value[1]]
            part = set().union(*(e for e, _ in found)) if all(e is not None for e, _ in found) else None
            query = True if part is not None else _join("or", [_join("and", [q, _of_strings(e) if e is not None else True]) for e, q in found])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = value
            e, q = _analyse(inner)
            if (low, high) == (0, 1) and e is not None:
                part, query = e | {""}, True
            elif low == high == 1 or low >= 1 and e is not None and low == high and len(e) ** low <= EXACT_MOST:
                part, query = (None if e is None else {"".join(p) for p in product(e, repeat=low)}), q
            else:
                part, query = None, _join("and", [q, _of_strings(e) if e is not None else True]) if low >= 1 else True
        elif op is C.AT:
            continue
        else:
            part, query = None, True
        need.append(query)
        if part is None:
            close()
        elif exact is None:
            exact = part
        elif len(exact) * len(part) <= EXACT_MOST:
            exact = {a + b for a, b in product(exact, part)}
        else:
            close()
            exact = part
    return (exact, True) if whole and exact is not None else (None, _join("and", [*need, _of_strings(exact) if exact else True]))


def trigram_query(pattern: str) -> Query:
    """What trigrams, lower-cased, every text with a match of the pattern has."""
    exact, query = _analyse(_parser.parse(pattern))
    return _of_strings(exact) if exact is not None else query


def trigrams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _postings(lists: Column, query: Query) -> Column:
    """The keys that satisfy a query, from a map of trigram to keys."""
    if isinstance(query, str):
        return F.coalesce(F.element_at(lists, query), F.array().cast("array<long>"))
    parts = [_postings(lists, q) for q in sorted(query[1], key=str)]
    out = parts[0]
    for p in parts[1:]:
        out = F.array_intersect(out, p) if query[0] == "and" else F.array_union(out, p)
    return out


def build_index(texts: DataFrame, rules: tuple[Rule, ...] = RULES, blocks: int | None = None) -> DataFrame:
    """From rows (key, text): rows (trigram, block, keys)."""
    grams = sorted(set().union(*(trigrams(trigram_query(r.pattern)) for r in rules)))
    blocks = blocks or texts.count() // BLOCK_TEXTS + 1
    found = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("lowered"), g)) if grams else F.array().cast("array<string>")
    posted = texts.select("key", F.lower("text").alias("lowered")).select("key", F.explode(found).alias("trigram"))
    return posted.groupBy("trigram", F.pmod("key", F.lit(blocks)).alias("block")).agg(F.collect_set("key").alias("keys"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (key, bits): bit r is set if the text may match rule r, for rules with a trigram query."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))
    queries = {n: q for n, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not True}

    def marked(n: int) -> Callable[[Column], Column]:
        return lambda key: F.struct(key.alias("key"), F.lit(1 << n).alias("bit"))

    hits = F.flatten(F.array(*[F.transform(_postings(F.col("lists"), q), marked(n)) for n, q in queries.items()]))
    return lists.select(F.explode(hits).alias("hit")).groupBy("hit.key").agg(F.bit_or("hit.bit").alias("bits"))


EMPTY = "array<struct<start:int,number:int,end:int>>"


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """Array of (start, number, end) of a rule's matches: a match starts after all gaps up to it and all matches before it."""

    def placed(matches: Column) -> Column:
        gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.char_length(g))
        lengths = F.transform(matches, lambda m: F.char_length(m))
        # steps[i] is a gap and the match before it; its running sum, with the step itself, is where match i starts
        steps = let(lengths, lambda n: let(gaps, lambda g: F.transform(n, lambda _, i: F.element_at(g, i + 1) + F.when(i > 0, F.element_at(n, F.greatest(i, F.lit(1)))).otherwise(0))))
        starts = let(steps, lambda st: F.zip_with(running(st, lambda x, y: x + y, F.lit(0)), st, lambda x, y: x + y))
        spans = F.zip_with(starts, matches, lambda at, m: F.when(_wanted(m, rule), F.struct(at.alias("start"), F.lit(number).alias("number"), (at + F.char_length(m)).alias("end"))))
        return F.when(F.size(matches) > 0, F.filter(spans, lambda x: x.isNotNull())).otherwise(F.array().cast(EMPTY))

    return let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), placed)


def _wanted(match: Column, rule: Rule) -> Column:
    if not rule.least:
        return F.lit(True)
    return F.char_length(F.regexp_extract(match, rule.pattern, rule.group)) >= rule.least


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs and the array column `found` of (start, number of the rule, end), sorted. Only rows that share a key with a candidate are matched
    against rules that have a trigram query. Candidates' keys are broadcast if they are few by count, so texts stay where they are read; beyond
    that rows meet them by key and salt."""
    key, bits, found = (fresh(docs, x) for x in ("key", "bits", "found"))
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keyed = docs.withColumn(key, row_keys(docs)[0])
    hits = materialise(candidates(build_index(keyed.select(F.col(key).alias("key"), whole.alias("text")), rules), rules).select(F.col("key").alias(key), F.col("bits").alias(bits)), "candidates")
    joined = join_sized(keyed, hits, [key], "left", hits.count() * CANDIDATE_BYTES)
    may = lambda n, r: F.lit(True) if trigram_query(r.pattern) is True else F.coalesce(F.col(bits), F.lit(0)).bitwiseAND(F.lit(1 << n)) != 0
    spans = F.concat(*[F.when(may(n, r), _spans(whole, n, r)).otherwise(F.array().cast(EMPTY)) for n, r in enumerate(rules)])
    return joined.withColumn(found, F.array_sort(spans)).drop(key, bits)


def spelled(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["number"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of their spans, and all spans."""
    found = scan(docs.select("doc_id", "text"))
    base = F.filter("found", lambda s: s["number"] < len(BASE))

    def numbered(n: int) -> Callable[[Column], Column]:
        return lambda s: s["number"] == n

    counts = [F.size(F.filter("found", numbered(n))).cast("long").alias(f"n_{r.kind}") for n, r in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans"))


def _pieces(text: Column, ranges: Column) -> Column:
    """The parts [from, to) of a text, in code points. The text is cut into blocks once, so that no part is looked for from the text's start."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))

    def part(every: Column) -> Callable[[Column], Column]:
        def of(r: Column) -> Column:
            first = F.floor(r["from"] / TEXT_BLOCK).cast("int")
            reached = F.slice(every, first + 1, F.ceil(r["to"] / TEXT_BLOCK).cast("int") - first)
            cut = lambda b, i: F.when((i > 0) & ((first + i + 1) * TEXT_BLOCK <= r["to"]), b).otherwise(F.substring(b, F.when(i == 0, r["from"] - first * TEXT_BLOCK).otherwise(0) + 1, r["to"] - F.greatest(r["from"], (first + i) * TEXT_BLOCK)))
            return F.when(r["to"] > r["from"], F.array_join(F.transform(reached, cut), "")).otherwise("")

        return of

    return let(blocks, lambda every: F.transform(ranges, part(every)))


def _redacted(text: Column, found: Column) -> Column:
    """A text with [secret] for each group of overlapping spans, which are sorted by their starts."""

    def cut(reach: Column) -> Column:
        # reach: the furthest end of all spans before each; where a span starts beyond it, the text between is kept
        kept = F.filter(F.zip_with(found, reach, lambda s, r: F.struct(r.alias("from"), s["start"].alias("to"))), lambda r: r["to"] >= r["from"])
        last = F.struct(F.array_max(F.transform(found, lambda s: s["end"])).alias("from"), F.char_length(text).alias("to"))
        return F.array_join(_pieces(text, F.concat(kept, F.array(last))), "[secret]")

    return let(running(F.transform(found, lambda s: s["end"]), lambda x, y: F.greatest(x, y), F.lit(0)), cut)


def redact_secrets(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with every span replaced by [secret], overlapping spans by one; the column `length`, if there is one, follows."""
    found = fresh(docs, "found")
    scanned = scan(docs, RULES, text)
    whole = F.col(f"`{text}`")
    out = scanned.withColumn(text, F.when(F.size(found) > 0, _redacted(whole, F.col(found))).otherwise(whole))
    if length in docs.columns:
        out = out.withColumn(length, F.when(F.size(found) > 0, F.char_length(f"`{text}`").cast(docs.schema[length].dataType)).otherwise(F.col(f"`{length}`")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))
