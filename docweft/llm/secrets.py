"""Secret scans through a trigram inverted index, in DataFrame operations only.

Each rule is a regular expression.  The driver derives a Boolean trigram query from
it (Cox, "Regular expression matching with a trigram index", 2012): literal stretches
give conjunctions of trigrams, alternatives give disjunctions; both ignore case.  The
index holds, for the trigrams that any rule asks for, the documents of each block of
about ``BLOCK_ROWS`` rows that contain it.  A rule's candidates are the documents in
the intersection of the lists of one of its conjunctions; they alone are verified by
the regular expression on their whole text.  A rule without a mandatory trigram (long
hex runs) scans every text.

Spans are in code points, end exclusive, of leftmost non-overlapping matches per kind,
of which those that are too short are dropped afterwards.

Null texts are empty.  Rows are known by id and a hash of their text, so rows may
repeat, share an id or have none.  Further columns are left alone, whatever their names;
a column secret_spans is replaced where spans are given, and kept where texts are redacted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.llm.shared import stored

#: Rows of a block of the index, about; a list never has more rows than its block.
BLOCK_ROWS = 4096
#: Candidates that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 300_000
#: Letters from common to rare (fixed values); other characters count as rarer.
_COMMON = "etaoinsrhldcumfpgwybvkxjqz"
#: Stands at both ends of a match while a text is cut; a text's own ones are read as MARK_READ.
MARK, MARK_READ = "\ue000", "\ue001"


@dataclass(frozen=True)
class Rule:
    """``least`` is the least length of ``group`` (0: of the whole match)."""

    kind: str
    pattern: str
    least: int
    group: int = 0


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
FURTHER = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+", 24),
    Rule("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
)
RULES = BASE + FURTHER


def _expansions(item, most: int) -> list[str] | None:
    """All strings that a piece of a parsed expression matches, lower case, if they are few."""
    op, arg = item
    if op is sre.LITERAL:
        return [chr(arg).lower()]
    if op is sre.IN:
        out = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                out.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < most:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return sorted(out) if len(out) <= most else None
    if op is sre.SUBPATTERN:
        return _all_of(list(arg[-1]), most)
    if op is sre.BRANCH:
        parts = [_all_of(list(x), most) for x in arg[1]]
        return None if any(p is None for p in parts) else sorted({s for p in parts for s in p})
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] != sre.MAXREPEAT and arg[1] <= 4:
        once = _all_of(list(arg[2]), most)
        if once is None:
            return None
        out, level = set(), {""}
        for n in range(arg[1] + 1):
            out |= level if n >= arg[0] else set()
            level = {a + b for a in level for b in once}
        return sorted(out) if len(out) <= most else None
    return None


def _all_of(items: list, most: int) -> list[str] | None:
    out = [""]
    for item in items:
        part = _expansions(item, most)
        if part is None or len(out) * len(part) > most:
            return None
        out = [a + b for a in out for b in part]
    return out


def _and(a: set[frozenset[str]], b: set[frozenset[str]]) -> set[frozenset[str]]:
    return _least({x | y for x in a for y in b})


def _least(query: set[frozenset[str]]) -> set[frozenset[str]]:
    return {x for x in query if not any(y < x for y in query)}


def trigram_query(pattern: str, most: int = 64) -> list[frozenset[str]]:
    """A disjunction of conjunctions of lower-case trigrams that every match contains; [empty set] if there is none."""
    query: set[frozenset[str]] = {frozenset()}
    open_: list[str] = [""]

    def close() -> None:
        nonlocal query, open_
        query = _and(query, _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in open_}))
        open_ = [""]

    def walk(items: list) -> None:
        nonlocal open_, query
        for item in items:
            part = _expansions(item, most)
            if part is not None and len(part) * len(open_) <= most:
                open_ = [a + b for a in open_ for b in part]
                continue
            close()
            op, arg = item
            if part is not None:
                open_ = part
            elif op is sre.SUBPATTERN:
                walk(list(arg[-1]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                walk(list(arg[2]))
                close()
            elif op is sre.BRANCH:
                sides: set[frozenset[str]] = set()
                for branch in arg[1]:
                    outer, query, open_ = query, {frozenset()}, [""]
                    walk(list(branch))
                    close()
                    sides |= query
                    query = outer
                query = _and(query, _least(sides))

    walk(list(parser.parse(pattern)))
    close()
    return sorted(query, key=sorted)


def asked(conjunction: frozenset[str], most: int = 3) -> frozenset[str]:
    """The trigrams of a conjunction to look up: its rarest ones by their letters.

    A conjunction implies each of its parts, so fewer lists leave more candidates to
    verify and lose none.
    """
    return frozenset(sorted(conjunction, key=lambda t: (-sum(_COMMON.find(c) % 27 for c in t), t))[:most])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("text", text).withColumn("_docweft_hash", F.xxhash64("text"))


def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """(block, trigram, ids): the inverted index of the given trigrams; ids are (doc_id, hash) pairs of one block."""
    blocks = max(1, -(-keyed.count() // BLOCK_ROWS))
    lowered = keyed.select("doc_id", "_docweft_hash", F.lower("text").alias("low"))  # a projection of its own: once a row, not once a trigram
    present = F.filter(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)), lambda t: t.isNotNull())
    row = lowered.select(F.struct(F.col("doc_id").alias("doc_id"), F.col("_docweft_hash").alias("hash")).alias("id"), F.pmod(F.xxhash64("doc_id", "_docweft_hash"), F.lit(blocks)).alias("block"), present.alias("trigrams"))
    return row.select("id", "block", F.explode("trigrams").alias("trigram")).groupBy("block", "trigram").agg(F.collect_set("id").alias("ids"))


def candidates(keyed: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame | None, set[str]]:
    """(doc_id, hash, kinds) that the trigram queries leave, and the kinds that have to scan every text."""
    queries = {r.kind: sorted({asked(c) for c in trigram_query(r.pattern)}, key=sorted) for r in rules}
    whole = {k for k, q in queries.items() if frozenset() in q}
    clauses = [(k, i, t, len(c)) for k, q in queries.items() if k not in whole for i, c in enumerate(q) for t in sorted(c)]
    if not clauses:
        return None, whole
    index = postings(keyed, sorted({c[2] for c in clauses}))
    table = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(i).alias("clause"), F.lit(t).alias("t"), F.lit(n).alias("n")) for k, i, t, n in clauses))
    wanted = index.select("block", "trigram", "ids", F.explode(F.filter(table, lambda c: c["t"] == F.col("trigram"))).alias("c"))
    lists = wanted.groupBy("block", "c.kind", "c.clause", "c.n").agg(F.collect_list("ids").alias("lists")).filter(F.size("lists") == F.col("n"))
    common = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.element_at("lists", 1), lambda acc, x: F.array_intersect(acc, x))
    found = lists.select("kind", F.explode(common).alias("id")).groupBy("id").agg(F.collect_set("kind").alias("_docweft_kinds"))
    return found.select(F.col("id.doc_id").alias("_docweft_id"), F.col("id.hash").alias("_docweft_h"), "_docweft_kinds"), whole


def _cut(text: Column, rule: Rule) -> Column:
    """The text cut at the matches of a rule: its elements are in turn outside of and inside a match."""
    return F.split(F.regexp_replace(text, F.lit(rule.pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)


def _let(value: Column, f) -> Column:
    """``f(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _in_blocks(items: Column, start: Column, step, finish) -> Column:
    """Fold an array by ``step(acc, block)`` over blocks of about the root of its size.

    What grows by appending is copied once a block and once an item of a block, so long
    arrays do not cost the square of their size.
    """
    side = F.ceil(F.sqrt(F.size(items))).cast("int")
    many = F.when(F.size(items) > 0, F.ceil(F.size(items) / side)).otherwise(0).cast("int")
    blocks = F.transform(F.array_repeat(F.lit(0), many), lambda _, i: F.slice(items, i * side + 1, side))
    return F.aggregate(blocks, start, step, finish)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, kind, end>> of a rule's matches that are long enough."""
    kind = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
    empty = F.array().cast(kind)

    def one(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        measured = F.length(F.regexp_extract(piece, rule.pattern, rule.group)) if rule.group else F.length(piece)
        span = F.struct(acc["at"].cast("bigint").alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.cast("bigint").alias("end"))
        out = F.when(acc["inside"] & (measured >= rule.least), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.cast("bigint").alias("at"), (~acc["inside"]).alias("inside"), out.alias("out"))

    def block(acc: Column, pieces: Column) -> Column:
        begin = F.struct(acc["at"].alias("at"), acc["inside"].alias("inside"), empty.alias("out"))
        return _let(F.aggregate(pieces, begin, one), lambda own: F.struct(own["at"].alias("at"), own["inside"].alias("inside"), F.concat(acc["out"], own["out"]).alias("out")))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("inside"), empty.alias("out"))
    found = _let(_cut(text, rule), lambda pieces: _in_blocks(pieces, start, block, lambda acc: acc["out"]))
    return F.when(text.rlike(_quick(rule)), found).otherwise(empty)


def _quick(rule: Rule) -> str:
    """A cheaper expression that finds something wherever the rule keeps a match."""
    simple = re.fullmatch(r"(.*\])\+", rule.pattern)
    if simple and not rule.group and rule.pattern.startswith("["):
        return f"{simple[1]}{{{rule.least},}}"
    return rule.pattern


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns with ``secret_spans``: array<struct<start, rank, kind, end>> by start, then by the rules' order."""
    docs = docs.drop("secret_spans")
    keyed = _keyed(docs)
    found, whole = candidates(keyed, rules)
    names = keyed.columns
    if found is None:
        rows = keyed.withColumn("_docweft_kinds", F.array().cast("array<string>"))
    else:
        found = stored(found, "candidates")
        found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
        rows = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("_docweft_id")) & (F.col("_docweft_hash") == F.col("_docweft_h")), "left").select(*names, "_docweft_kinds")
    plain = F.when(F.contains("text", F.lit(MARK)), F.translate("text", MARK, MARK_READ)).otherwise(F.col("text"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    parts = []
    for rank, rule in enumerate(rules):
        spans = _spans(plain, rule, rank)
        parts.append(spans if rule.kind in whole else F.when(F.array_contains("_docweft_kinds", rule.kind), spans).otherwise(none))
    return rows.withColumn("secret_spans", F.array_sort(F.concat(*parts))).drop("_docweft_hash", "_docweft_kinds")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    found = with_spans(docs.select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("secret_spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("secret_spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """All rows and columns, with every secret in the text replaced by its kind in brackets; null texts stay null."""
    columns = docs.columns
    own = docs.withColumnRenamed("secret_spans", "_docweft_own")  # a column that only happens to have this name stays
    found = with_spans(own.withColumn("_docweft_null", F.col("text").isNull()))
    none = F.array().cast("array<string>")

    def part(text: Column, begin: Column, many: Column) -> Column:
        return F.substring(text, begin.cast("int"), many.cast("int"))

    def one(acc: Column, s: Column) -> Column:
        piece = F.concat(part(acc["rest"], F.lit(1), s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        end = F.greatest(acc["at"], s["end"])
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"])
        return F.struct(part(acc["rest"], end - acc["at"] + 1, F.length(acc["rest"])).alias("rest"), end.alias("at"), out.alias("out"))

    def block(acc: Column, spans: Column) -> Column:
        """The stretch of text up to the end of a block's spans; the rest is cut once a block."""
        stop = F.greatest(acc["at"], F.array_max(F.transform(spans, lambda s: s["end"])))
        begin = F.struct(part(acc["rest"], F.lit(1), stop - acc["at"]).alias("rest"), acc["at"].alias("at"), none.alias("out"))
        own = F.aggregate(spans, begin, one, lambda a: F.array_join(a["out"], ""))
        return F.struct(part(acc["rest"], stop - acc["at"] + 1, F.length(acc["rest"])).alias("rest"), stop.alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

    start = F.struct(F.col("text").alias("rest"), F.lit(0).cast("bigint").alias("at"), none.alias("out"))
    rest = _in_blocks(F.col("secret_spans"), start, block, lambda acc: F.concat(F.array_join(acc["out"], ""), acc["rest"]))
    out = found.withColumn("text", F.when(F.size("secret_spans") > 0, rest).when(~F.col("_docweft_null"), F.col("text")))
    return out.drop("secret_spans").withColumnRenamed("_docweft_own", "secret_spans").select(*columns)
