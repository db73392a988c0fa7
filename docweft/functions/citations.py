"""Citations in answers and marked passages, as columns: a text is cut at its markers and put together again."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One or more numbers in brackets (fixed pattern), and a single one.
MARKERS, MARKER = r"\[\d+(?:\s*,\s*\d+)*\]", r"\[\d+\]"
_CUT, _READ = "\ue000", "\ue001"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cut_at(c: Column | str, pattern: str) -> Column:
    """The text cut at the matches of a pattern: elements at odd positions (from 0) are the matches."""
    plain = F.translate(F.coalesce(_col(c), F.lit("")), _CUT, _READ)
    return F.split(F.regexp_replace(plain, F.lit(pattern), F.lit(f"{_CUT}$0{_CUT}")), _CUT, -1)


def _spaced(parts: Column) -> Column:
    """Words and the gaps between them in turn, put together: no gap before a stop, and else one blank at most."""

    def part(p: Column, i: Column) -> Column:
        stop = F.instr(F.lit(".,;:!?"), F.left(F.get(parts, i + 1), F.lit(1))) > 0
        gap = F.when(F.coalesce(stop & (F.get(parts, i + 1) != ""), F.lit(False)), "").when(F.length(p) > 1, " ").otherwise(p)
        return F.when(i % 2 == 0, p).otherwise(gap)

    return F.array_join(F.transform(parts, part), "")


def verified(answer: Column | str, passages: Column | str) -> Column:
    """struct<answer, markers>: one bracket a number, none of unknown passages; the numbers in order of appearance."""

    def known(piece: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(piece, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("int"))
        return F.filter(numbers, lambda n: (n >= 1) & (n <= _col(passages)))

    pieces = F.transform(cut_at(answer, MARKERS), lambda p, i: F.struct(F.when(i % 2 == 0, p).otherwise(F.lit("")).alias("text"), F.when(i % 2 == 1, known(p)).otherwise(F.array().cast("array<int>")).alias("numbers")))
    shown = F.transform(pieces, lambda p: F.concat(p["text"], F.array_join(F.transform(p["numbers"], lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")))
    tidy = F.element_at(F.transform(F.array(cut_at(F.array_join(shown, ""), r"[ \t]+")), _spaced), 1)
    return F.struct(F.regexp_replace(tidy, r"(?U)^\s+|\s+$", "").alias("answer"), F.array_distinct(F.flatten(F.transform(pieces, lambda p: p["numbers"]))).alias("markers"))


def segments(answer: Column | str) -> Column:
    """array<struct<kind, text, marker>>: the text and the citations of an answer in turn."""
    pieces = F.transform(cut_at(answer, MARKER), lambda p, i: F.struct(F.when(i % 2 == 1, "cite").otherwise("text").alias("kind"), p.alias("text"), F.when(i % 2 == 1, F.regexp_extract(p, r"\d+", 0).try_cast("int")).alias("marker")))
    return F.filter(pieces, lambda p: p["text"] != "")


def marked(text: Column | str, terms: list[str]) -> Column:
    """array<struct<text, marked>>: the text in turn outside and inside of the terms, in either case, longer terms first."""
    some = sorted({t.strip() for t in terms if len(t.strip()) > 1}, key=lambda t: (-len(t), t))
    if not some:
        return F.array(F.struct(F.coalesce(_col(text), F.lit("")).alias("text"), F.lit(False).alias("marked")))
    pattern = "(?i)" + "|".join(re.escape(t) for t in some)
    pieces = F.transform(cut_at(text, pattern), lambda p, i: F.struct(p.alias("text"), (i % 2 == 1).alias("marked")))
    return F.filter(pieces, lambda p: p["text"] != "")
