"""Secrets in texts: rules are regular expressions, found by way of a trigram index.

Each rule's expression gives a Boolean query over trigrams that any match contains. One pass over the texts inverts them:
the index holds, for each trigram that a query names and each block of texts, the keys of the texts with that trigram
(case aside). Rules intersect and unite these postings block by block; their expression runs only over the texts whose
keys remain. A rule without a mandatory trigram scans every text. Only keys and trigrams are shuffled, never texts, while
the candidates are few enough to be broadcast; beyond that rows are joined with them by key.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.runtime import cut, ids_side


@dataclass(frozen=True)
class Rule:
    """kind: its name. pattern: means the same in Java and Python. length: least characters of the match, or of `group`."""

    kind: str
    pattern: str
    length: int = 0
    group: int = 0
    base: bool = False


def _any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_GAP = r"""(?:\\[nr]|[\x20\x09-\x0D"',>])*+"""
#: A private key: from its BEGIN line to the END line, whatever lies between but another line of five hyphens; without an
#: END line, to the end of the header fields and base64 lines (the last one may be short). Line ends may be blanks or written as \n; without END, one word after them may go too.
_PEM = (
    "-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"
    "(?:[^-]*+(?:-{1,4}+[^-]++)*+-----END [A-Z ]{0,32}PRIVATE KEY-----"
    f"|(?:{_GAP}[A-Z][A-Za-z-]*+:[\\x20\\x09]*+[!-\\[\\]-~]++)*+(?:{_GAP}[A-Za-z0-9+/]{{40,}}+={{0,2}}+)++(?:{_GAP}[A-Za-z0-9+/]{{2,}}+={{0,2}}+)?+"
    "|)"
)
#: The three base rules, then those that the method adds.
RULES = (
    Rule("assign", "(" + _any_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", "AKIA[A-Z0-9]+", 16, 0, True),
    Rule("hex", "[0-9a-f]{32,}", 32, 0, True),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", _PEM),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
)
#: A query holds at most so many alternative strings at one place.
MOST = 48

# A query is a trigram, True (no condition), or ("and" | "or", parts).


def _join(op: str, parts: list) -> object:
    if op == "and":
        parts = [x for x in parts if x is not True]
        return True if not parts else parts[0] if len(parts) == 1 else (op, tuple(dict.fromkeys(parts)))
    return True if any(x is True for x in parts) or not parts else parts[0] if len(parts) == 1 else (op, tuple(dict.fromkeys(parts)))


def _of_strings(strings: set[str]) -> object:
    """Any of strings; one whose trigrams include all of another's adds nothing."""
    grams = {s: {s[i : i + 3] for i in range(len(s) - 2)} for s in strings}
    least = [s for s in sorted(strings) if not any(grams[x] < grams[s] or (grams[x] == grams[s] and x < s) for x in strings)]
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in least])


def _strings(op, value) -> set[str] | None:
    """The strings that an item can match, lower-case, if they are few."""
    if op is sre.LITERAL:
        return {chr(value).lower()}
    if op is sre.IN and all(x[0] is sre.LITERAL for x in value):
        return {chr(x[1]).lower() for x in value}
    if op is sre.SUBPATTERN:
        return _few(value[-1])
    if op is sre.BRANCH:
        parts = [_few(x) for x in value[1]]
        return None if any(x is None for x in parts) else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] is not sre.MAXREPEAT and value[1] <= 2:
        one = _few(value[2])
        return None if one is None else {"".join(x) for n in range(value[0], value[1] + 1) for x in product(sorted(one), repeat=n)}
    return None


def _few(items) -> set[str] | None:
    out = {""}
    for op, value in items:
        got = _strings(op, value)
        if got is None or len(out) * len(got) > MOST:
            return None
        out = {a + b for a in out for b in got}
    return out


def trigram_query(pattern: str) -> object:
    """What any match of pattern must contain, as a query over lower-case trigrams."""

    def walk(items) -> object:
        parts, now = [], {""}
        for op, value in items:
            got = _strings(op, value)
            if got is not None and len(now) * len(got) <= MOST:
                now = {a + b for a in now for b in got}
                continue
            parts.append(_of_strings(now))
            now = {""}
            if got is not None and len(got) <= MOST:
                now = got
            elif op is sre.SUBPATTERN:
                parts.append(walk(value[-1]))
            elif op is sre.BRANCH:
                parts.append(_join("or", [walk(x) for x in value[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
                parts.append(walk(value[2]))
        return _join("and", [*parts, _of_strings(now)])

    return walk(sre_parser.parse(pattern))


def _trigrams(query) -> list[str]:
    return [] if query is True else [query] if isinstance(query, str) else [t for x in query[1] for t in _trigrams(x)]


#: Texts that a block of postings has, about.
BLOCK = 4096


def _any_of(grams: list[str]) -> str:
    """An expression that finds each of grams wherever it starts, so that a text is read once for all of them."""
    of: dict[str, list[str]] = {}
    for g in grams:
        of.setdefault(g[0], []).append(g[1:])
    quote = lambda s: "".join(c if c.isalnum() else "\\" + c if ord(c) < 128 else c for c in s)
    return "(?=(" + "|".join(f"{quote(c)}(?:{'|'.join(map(quote, rest))})" for c, rest in of.items()) + "))"


def postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index of column text: (block, gram, keys), the keys of the texts that have the gram, case aside.

    A key is the text's 64-bit hash, so equal texts are one, and blocks by it are even. Two texts with one hash share
    their postings, which adds candidates and loses none. The table is written once.
    """
    blocks = -(-max(1, texts.count()) // BLOCK)
    key = F.xxhash64("text")
    found = texts.where("text IS NOT NULL").select(F.pmod(key, F.lit(blocks)).alias("block"), key.alias("key"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_any_of(grams)), F.lit(1)))).alias("gram"))
    return cut(found.groupBy("block", "gram").agg(F.collect_set("key").alias("keys")), "sec-postings")


def _meet(query, held: Column) -> Column:
    """Keys of a block that a query leaves: intersections and unions of the postings in held, a map by gram."""
    if isinstance(query, str):
        return F.coalesce(F.element_at(held, F.lit(query)), F.array().cast("array<bigint>"))
    return reduce(F.array_intersect if query[0] == "and" else F.array_union, [_meet(x, held) for x in query[1]])


def candidates(index: DataFrame, queries: list) -> DataFrame:
    """(key, rules): the rules, as bits, whose query the text with that key meets. A block is one row meanwhile."""
    held = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("held"))

    def part(i: int) -> Column:
        return F.transform(_meet(queries[i], F.col("held")), lambda k: F.struct(k.alias("key"), F.lit(1 << i).cast("long").alias("bit")))

    parts = [part(i) for i, q in enumerate(queries) if q is not True]
    return held.select(F.explode(F.concat(*parts)).alias("x")).groupBy("x.key").agg(F.bit_or("x.bit").alias("rules"))


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(values: Column, zero: Column, op) -> Column:
    """For each place of an array op over all values before it, by blocks of 64, so that long arrays stay cheap."""

    def of(a: Column) -> Column:
        block = F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / 64).cast("int")), lambda b: F.aggregate(F.slice(a, b * 64 + 1, 64), zero, op))
        upto = let(block, lambda s: F.transform(s, lambda _, b: F.aggregate(F.slice(s, 1, b), zero, op)))
        return let(upto, lambda u: F.transform(a, lambda _, i: op(F.get(u, F.floor(i / 64).cast("int")), F.aggregate(F.slice(a, i - i % 64 + 1, i % 64), zero, op))))

    return let(values, of)


_SPANS = "array<struct<s:int,k:int,e:int>>"


def _found(rule: Rule, order: int, text: Column) -> Column:
    """Spans of the matches in text: what lies between them comes from a split by the same expression."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)

    def spans(h: Column) -> Column:
        size = F.zip_with(gaps, h, lambda g, x: F.struct(F.length(g).alias("g"), F.coalesce(F.length(x), F.lit(0)).alias("h")))
        return let(size, lambda z: F.zip_with(F.arrays_zip(z.alias("z"), _before(F.transform(z, lambda x: x["g"] + x["h"]), F.lit(0), lambda a, b: a + b).alias("at")), h, span))

    def span(x: Column, hit: Column) -> Column:
        s = x["at"] + x["z"]["g"]
        held = F.length(F.regexp_extract(hit, rule.pattern, rule.group)) >= rule.length
        return F.when(held, F.struct(s.alias("s"), F.lit(order).alias("k"), (s + x["z"]["h"]).alias("e")))

    return F.filter(let(hits, spans), lambda x: x.isNotNull()).cast(_SPANS)


def _find(documents: DataFrame, rules: tuple[Rule, ...], text_col: str) -> DataFrame:
    """(row, text, spans): each row as a struct, so that no name of its columns can clash, and its spans by start."""
    queries = [trigram_query(r.pattern) for r in rules]
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = documents.select(F.struct(*map(name, documents.columns)).alias("row"), name(text_col).alias("text"))
    grams = sorted({t for q in queries for t in _trigrams(q)})
    if grams:
        found = cut(candidates(postings(documents.select(name(text_col).alias("text")), grams), queries), "sec-candidates")
        rows = rows.withColumn("key", F.xxhash64("text")).join(ids_side(found), "key", "left")
        rows = rows.select("row", "text", F.coalesce("rules", F.lit(0)).alias("rules"))
    text, none = F.coalesce("text", F.lit("")), F.array().cast(_SPANS)

    def of(k: int) -> Column:
        hit = F.regexp_like(text, F.lit(rules[k].pattern))
        held = hit if queries[k] is True else (F.col("rules").bitwiseAND(F.lit(1 << k)) != 0) & hit
        return F.when(held, _found(rules[k], k, text)).otherwise(none)

    return rows.select("row", "text", F.array_sort(F.concat(*(of(k) for k in range(len(rules))))).alias("spans"))


def find(documents: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """documents with spans_col: array<struct<s, k, e>> of all matches, by start and then rule; s and e count code points.

    A null text has none. Rows are taken each by itself: ids may repeat or be null, other columns stay as they are,
    whatever their names (one that is named spans_col is replaced). An empty table gives an empty one.
    """
    found = _find(documents, rules, text_col)
    return found.select(*(F.col("row").getField(c).alias(c) for c in documents.columns if c != spans_col), F.col("spans").alias(spans_col))


def _text(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_digest(documents: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row."""
    base = [k for k, r in enumerate(rules) if r.base]
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = _find(docs, rules, "text").select("row.doc_id", "spans")
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    of_base = F.filter("spans", lambda x: x["k"].isin(base))
    return found.select("doc_id", *(count(k).alias(f"n_{rules[k].kind}") for k in base), F.sha2(_text(of_base, rules), 256).alias("base_sha256"), _text(F.col("spans"), rules).alias("spans"))


def redact(documents: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """documents with each stretch of secrets replaced by mark; overlapping spans are one stretch.

    Other columns stay as they are, whatever their names; rows with the same or no id, null and empty texts too.
    """
    text, page = F.col("text"), 1024

    def piece(pages: Column, a: Column, b: Column) -> Column:
        """Characters a to b - 1; a page is 1024 of them, so that a long text isn't read from its start for each span."""
        lo = F.floor(a / page).cast("int")
        return F.when(b <= a, F.lit("")).otherwise(F.array_join(F.slice(pages, lo + 1, F.floor((b - 1) / page).cast("int") - lo + 1), "").substr(a % page + 1, b - a))

    def clean(pages: Column) -> Column:
        ends = _before(F.col("spans.e"), F.lit(0), lambda a, b: F.greatest(a, b))
        parts = F.zip_with("spans", ends, lambda x, at: F.when(x["s"] >= at, F.concat(piece(pages, at, x["s"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), piece(pages, F.array_max("spans.e"), F.length(text)))

    new = F.when(F.size("spans") > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{page}}}"), F.lit(0)), clean)).otherwise(text)
    return _find(documents, rules, text_col).select(*((new if c == text_col else F.col("row").getField(c)).alias(c) for c in documents.columns))
