"""Score columns of the connection graph and of its views."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweft.params import GraphParams


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two float arrays, in double."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def calibrate(raw: Column | str, floor: float = 0.5, ceil: float = 0.95) -> Column:
    """The raw cosine on a line from floor (0) to ceil (1), clipped."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (_col(raw) - floor) / (ceil - floor)))


def combine(semantic: Column | str, entity: Column | str, topic: Column | str, p: GraphParams = GraphParams()) -> Column:
    return F.lit(p.semantic_weight) * _col(semantic) + F.lit(p.entity_weight) * _col(entity) + F.lit(p.topic_weight) * _col(topic)


def contributions(semantic: Column | str, entity: Column | str, topic: Column | str, p: GraphParams = GraphParams()) -> tuple[Column, Column, Column]:
    return F.lit(p.semantic_weight) * _col(semantic), F.lit(p.entity_weight) * _col(entity), F.lit(p.topic_weight) * _col(topic)


def dominant_signal(semantic: Column | str, entity: Column | str, topic: Column | str, p: GraphParams = GraphParams()) -> Column:
    """The signal with the largest weighted part; ties in the order semantic, entity, topic."""
    s, e, t = contributions(semantic, entity, topic, p)
    return F.when((s >= e) & (s >= t), F.lit("semantic")).when(e >= t, F.lit("entity")).otherwise(F.lit("topic"))


def contribution_share(part: Column, semantic: Column | str, entity: Column | str, topic: Column | str, p: GraphParams = GraphParams()) -> Column:
    total = combine(semantic, entity, topic, p)
    return part / F.when(total == 0, F.lit(1.0)).otherwise(total)


def topic_similarity(p: Column | str, q: Column | str) -> Column:
    """1 - sqrt of the Jensen-Shannon divergence (base 2); 0 if a side is null or has no mass."""
    p, q = _col(p), _col(q)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    sp, sq = total(p), total(q)

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(F.transform(p, lambda x: x / sp), F.transform(q, lambda x: x / sq), lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    js = F.greatest(F.lit(0.0), total(terms) / 2)
    known = p.isNotNull() & q.isNotNull() & (sp > 0) & (sq > 0)
    return F.when(known, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.sqrt(js)))).otherwise(F.lit(0.0))


def size_tier(size: Column | str) -> Column:
    n = _col(size)
    return F.when(n < 50_000, "s").when(n < 250_000, "m").when(n < 1_000_000, "l").otherwise("xl")


def stroke_width(combined: Column | str) -> Column:
    return 1 + 4 * _col(combined)


def topic_slot(topic: Column | str, slots: int = 8) -> Column:
    """Colour slot of a topic; -1 for none."""
    return F.coalesce(F.pmod(_col(topic), F.lit(slots)).cast("int"), F.lit(-1))


def link_distance(score: Column | str) -> Column:
    return 240 - 140 * _col(score)


def link_strength(score: Column | str) -> Column:
    return 0.2 + 0.6 * _col(score)


def seed_position(index: Column | str, count: Column | str) -> tuple[Column, Column]:
    """Where a node starts on the jittered circle of the layout."""
    i, n = _col(index), _col(count)
    angle = i / F.greatest(n, F.lit(1)) * (2 * pi)
    radius = 180 + n * 14 + (i * 7919) % 61 - 30
    return F.cos(angle) * radius, F.sin(angle) * radius * 0.72
