"""Secret scans with a trigram index.

Every rule is a regular expression with a condition on its length. From the expression a Boolean trigram query is derived:
an OR of ANDs of trigrams that any match must contain. The inverted index lists, for each trigram of the queries, the texts
that have it; intersecting postings gives each rule's candidates, and the rule's expression is matched on those alone. A rule
without a mandatory trigram scans all texts. Trigrams are compared in lower case, which can only admit more. DataFrame
functions only; the queries are derived on the driver, from the rules alone.
"""

from __future__ import annotations

import re
import re._parser as sre
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, blocks, column_name, durable, join_unique, let, running

#: Alternatives of one query; beyond it a part of an expression counts as unknown.
BRANCHES = 64


@dataclass(frozen=True)
class Rule:
    """``least`` is the smallest length of ``group`` that counts; shorter matches are dropped, not sought again."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order of their kinds.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Public forms of some credentials.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
)
RULES = BASE + ADDED


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Trigrams that a match must contain, as alternatives (any of which must be there whole); None if there's no such condition.

    Works on exact strings: a part of an expression that can be one of few strings keeps them, and joins its neighbours;
    any other part breaks the run.
    """
    runs = _runs(list(sre.parse(pattern)))
    best = None
    for alternatives in runs:
        need = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in alternatives]
        if all(need) and (best is None or min(map(len, need)) > min(map(len, best))):
            best = need
    # An alternative that asks for more than another adds nothing.
    return None if best is None else [n for n in dict.fromkeys(best) if not any(m < n for m in best)]


def _runs(parts) -> list[set[str]]:
    """Sets of strings, one of which is in any match."""
    done, current = [], {""}
    for op, arg in parts:
        exact = _exact(op, arg)
        if exact is not None and len(current) * len(exact) <= BRANCHES:
            current = {a + b for a, b in product(current, exact)}
            continue
        done.append(current)
        current = {""}
        if exact is not None:
            current = exact
        elif op is sre.SUBPATTERN:
            done += _runs(list(arg[-1]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            done += _runs(list(arg[2]))
    return [*done, current]


def _exact(op, arg) -> set[str] | None:
    """All strings, in lower case, that a part stands for, if they're few."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len(arg) <= 8:
        return {chr(v).lower() for _, v in arg}
    if op is sre.SUBPATTERN:
        return _all(list(arg[-1]))
    if op is sre.BRANCH:
        found = [_all(list(b)) for b in arg[1]]
        return None if any(f is None for f in found) else set().union(*found)
    if op is sre.MAX_REPEAT and arg[1] == 1:
        inner = _all(list(arg[2]))
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _all(parts) -> set[str] | None:
    out = {""}
    for op, arg in parts:
        exact = _exact(op, arg)
        if exact is None or len(out) * len(exact) > BRANCHES:
            return None
        out = {a + b for a, b in product(out, exact)}
    return out


def trigram_vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted(set().union(*(n for r in rules for n in trigram_query(r.pattern) or [])))


def trigram_index(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, text) -> (trigram, key): the postings of the rules' trigrams, in lower case."""
    words = trigram_vocabulary(rules)
    held = let(F.lower(F.col("text")), lambda t: F.filter(F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>"), lambda w: F.contains(t, w)))
    return texts.select(F.explode(held).alias("trigram"), "key")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(trigram, key) -> (key, rules): the texts that each rule's query admits, ``rules`` being bits by the rules' places.

    Postings of an alternative's trigrams are intersected: a text stays if all of them have it. Texts may be posted repeatedly.
    """
    queries = [(w, 1 << place, n, 1 << i, (1 << len(need)) - 1) for place, r in enumerate(rules) for n, need in enumerate(trigram_query(r.pattern) or []) for i, w in enumerate(sorted(need))]
    # One made of a Python list would start Python workers of its own.
    kinds = {"trigram": "string", "rule": "long", "alternative": "int", "bit": "long", "whole": "long"}
    listed = F.array(*[F.struct(*[F.lit(x).cast(t).alias(c) for x, (c, t) in zip(q, kinds.items(), strict=True)]) for q in queries])
    wanted = index.sparkSession.range(0, 1, 1, 1).select(F.inline(listed.cast(f"array<struct<{','.join(f'{c}:{t}' for c, t in kinds.items())}>>")))
    met = index.join(F.broadcast(wanted), "trigram").groupBy("key", "rule", "alternative").agg(F.bit_or("bit").alias("bits"), F.max("whole").alias("whole"))  # the rules' own trigrams are broadcast
    return met.where("bits = whole").groupBy("key").agg(F.bit_or("rule").alias("rules"))


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """Spans of a rule's matches that count: start, place (of the kind), end, kind; code points, end exclusive.

    The text between matches and the matches follow each other, so their lengths give the places.
    """
    gaps, found, group = F.split(text, rule.pattern), F.regexp_extract_all(text, F.lit(rule.pattern), 0), F.regexp_extract_all(text, F.lit(rule.pattern), rule.group)
    gap = lambda: F.transform(F.slice(gaps, F.lit(1), F.size(found)), F.length)
    sizes = F.zip_with(F.zip_with(gap(), found, lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("size"))), group, lambda s, g: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), F.length(g).alias("n")))

    def placed(x: Column) -> Column:
        before = running(F.transform(x, lambda s: s["gap"] + s["size"]), lambda a, b: a + b)
        return F.zip_with(x, before, lambda s, at: F.struct((at + s["gap"]).alias("start"), F.lit(place).alias("place"), (at + s["gap"] + s["size"]).alias("end"), F.lit(rule.kind).alias("kind"), s["n"].alias("n")))

    kept = F.filter(let(sizes, placed), lambda s: s["n"] >= rule.least)
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))


_EMPTY = "array<struct<start:int,place:int,end:int,kind:string>>"


def _scanned(text: Column, rule: Rule, place: int, admitted: Column | None = None) -> Column:
    """A rule's spans in a text; places are worked out only where it matches at all."""
    simple = rule.pattern.startswith("[") and rule.pattern.endswith("]+") and rule.pattern.count("[") == 1 and rule.group == 0
    exact = Rule(rule.kind, rule.pattern[:-1] + f"{{{rule.least},}}" if simple else rule.pattern, rule.group, rule.least)
    there = text.rlike(exact.pattern) if admitted is None else admitted & text.rlike(exact.pattern)
    return F.when(there, _spans(text, exact, place)).otherwise(F.array().cast(_EMPTY))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of ``docs`` with spans added: every rule's matches in the whole text, by start, then kind as listed.

    Each rule goes leftmost and non-overlapping by itself; spans of different rules may overlap. Null and empty texts have
    none; repeated rows have the same spans, found once for each text; an empty table gives an empty one; a column spans, in
    any case, is replaced. Rules without a mandatory trigram are matched where the rows are. For all others the postings give
    candidates, told by their SHA-256; only those texts are matched, and what they hold is joined to the rows.
    """
    own = [c for c in docs.columns if c.lower() != "spans"]
    key, free, bound = (column_name(docs, c) for c in ("_key", "_free", "_bound"))
    text = F.coalesce(F.col("text"), F.lit(""))
    indexed = {place: r for place, r in enumerate(rules) if trigram_query(r.pattern) is not None}
    texts = docs.select(F.unhex(F.sha2(text, 256)).alias("key"), text.alias("text"))
    admitted = durable(candidates(trigram_index(texts, rules), rules), "candidates")
    few = admitted.count() <= BROADCAST_ROWS
    met = texts.join(F.broadcast(admitted), "key") if few else join_unique(texts, admitted, "key")
    once = met.groupBy("key").agg(F.first("text").alias("text"), F.first("rules").alias("rules"))
    spans = F.concat(F.array().cast(_EMPTY), *[_scanned(F.col("text"), r, place, F.col("rules").bitwiseAND(F.lit(1 << place).cast("long")) != 0) for place, r in indexed.items()])
    verified = durable(once.select(F.col("key").alias(key), spans.alias(bound)).where(F.size(bound) > 0), "verified")
    small = verified.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(bound)), F.lit(0)).alias("spans")).first()
    here = docs.select(*own, F.unhex(F.sha2(text, 256)).alias(key), F.concat(F.array().cast(_EMPTY), *[_scanned(text, r, place) for place, r in enumerate(rules) if place not in indexed]).alias(free))
    joined_to = here.join(F.broadcast(verified) if small["n"] + small["spans"] <= BROADCAST_ROWS else verified, key, "left")
    return joined_to.select(*own, F.sort_array(F.concat(free, F.coalesce(bound, F.array().cast(_EMPTY)))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """Rows of ``docs`` with every secret replaced by ``mask``, overlapping ones by one; n_chars, if there, follows. No row goes.

    Null texts stay null; columns keep their names, whatever they are.
    """
    own = docs.columns
    old = {c: column_name(docs, f"_own_{c}") for c in own if c.lower() == "spans"}
    found = find_secrets(docs.withColumnsRenamed(old), rules)

    def piece(part: Column, begin: Column, s: Column) -> Column:
        return F.when(s["start"] >= s["before"], F.concat(F.substring(part, s["before"] - begin + 1, s["start"] - s["before"]), F.lit(mask))).otherwise("")

    def cut(block: Column) -> Column:
        begin = block[0]["before"]
        part = F.substring(F.col("text"), begin + 1, F.greatest(F.lit(0), F.element_at(block, -1)["start"] - begin))
        return let(part, lambda p: F.array_join(F.transform(block, lambda s: piece(p, begin, s)), ""))

    # Each span with the end of all before it; then blocks of spans, each with its own part of the text.
    spans = F.zip_with("spans", running(F.transform("spans", lambda s: s["end"]), F.greatest), lambda s, before: F.struct(s["start"].alias("start"), before.alias("before")))
    tail = F.substring(F.col("text"), F.array_max(F.transform("spans", lambda s: s["end"])) + 1, F.lit(2147483647))
    text = F.concat(F.array_join(F.transform(blocks(spans), cut), ""), tail)
    out = found.withColumn("text", F.when(F.size("spans") > 0, text).otherwise(F.col("text"))).drop("spans").withColumnsRenamed({v: k for k, v in old.items()})
    if "n_chars" in own:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*own)
