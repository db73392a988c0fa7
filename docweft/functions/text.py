"""Text columns: tokens, hashes, file names, captions.  All expressions stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweft.params import RETURN_N, RRF_K, SearchParams

#: Names that one operating system reserves for devices (fixed values).
DEVICE_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(c: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits, in order, with repeats."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def count_tokens(c: Column | str) -> Column:
    """Words between white space."""
    return F.size(F.regexp_extract_all(_col(c), F.lit(r"\S+"), F.lit(0)))


def content_hash(c: Column | str) -> Column:
    """SHA-256 of the lower-case text with white space collapsed: reflowed or re-cased copies are equal."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(_col(c)), r"(?U)\s+", " ")), 256)


def normalize_entity(c: Column | str) -> Column:
    """Lower case, white space collapsed, without a leading article."""
    flat = F.trim(F.regexp_replace(F.lower(_col(c)), r"(?U)\s+", " "))
    return F.regexp_replace(flat, "^the ", "")


def entity_kept(text: Column | str, label: Column | str, labels: tuple[str, ...], least: int = 3) -> Column:
    """Whether a normalised entity has an allowed label, is long enough, and is not only digits and signs."""
    text, label = _col(text), _col(label)
    return label.isin(*labels) & (F.length(text) >= least) & ~text.rlike(r"^[\W\d_]+$")


def _let(value: Column, f) -> Column:
    """``f(value)``, with the value computed once however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def sanitize_filename(c: Column | str) -> Column:
    """A name that is safe to show: last path part, no control characters, no device name, at most 255 characters."""
    base = F.regexp_extract(_col(c), r"([^/\\]*)$", 1)
    clean = F.trim(F.regexp_replace(F.regexp_replace(base, r"[\x00-\x1f\x7f]", ""), " +", " "))

    def named(clean: Column) -> Column:
        return F.when(F.upper(F.substring_index(clean, ".", 1)).isin(*DEVICE_NAMES), F.concat(F.lit("_"), clean)).otherwise(clean)

    def capped(name: Column) -> Column:
        ext = F.substring_index(name, ".", -1)
        short = F.when(F.contains(name, F.lit(".")) & (F.length(ext) < 16), F.concat(F.left(name, 254 - F.length(ext)), F.lit("."), ext)).otherwise(F.left(name, F.lit(255)))
        return F.when(name == "", F.lit("unnamed")).when(F.length(name) > 255, short).otherwise(name)

    return _let(_let(F.regexp_replace(clean, r"[. ]+$", ""), named), capped)


def detect_type(content: Column | str, claimed: Column | str) -> Column:
    """The verified type of a file's bytes, or an error code in brackets: the claim is checked, never corrected."""
    content, ext = _col(content), F.regexp_replace(F.lower(_col(claimed)), r"^\.", "")
    pdf = F.substring(content, 1, 5) == F.lit(b"%PDF-")
    zipped = F.substring(content, 1, 4) == F.lit(b"PK\x03\x04")
    return (
        F.when(~ext.isin("pdf", "docx", "txt", "md"), F.lit("[unsupported_type]"))
        .when(F.length(content) == 0, F.lit("[empty_file]"))
        .when(pdf, F.when(ext == "pdf", F.lit("pdf")).otherwise(F.lit("[magic_mismatch]")))
        .when(zipped, F.when(ext == "docx", F.lit("docx")).otherwise(F.lit("[magic_mismatch]")))
        .when(F.is_valid_utf8(content.cast("string")), F.when(ext.isin("txt", "md"), ext).otherwise(F.lit("[magic_mismatch]")))
        .otherwise(F.lit("[unsupported_type]"))
    )


def truncate_at_word(c: Column | str, limit: int) -> Column:
    """At most ``limit`` characters: the cut loses its last word, and gets an ellipsis."""
    c = _col(c)
    cut = F.left(c, F.lit(limit))
    head = F.regexp_extract(cut, r"(?s)^(.*\S)\s+\S+\s*$", 1)
    whole = F.regexp_replace(cut, r"\s+$", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.when(head != "", head).otherwise(whole), F.lit("…")))


def _unquoted(c: Column, pattern: str) -> Column:
    return F.trim(F.regexp_replace(c, pattern, "$1"))


def postprocess_explanation(c: Column | str) -> Column:
    """Unquoted, on one line, three sentences and 600 characters at most."""
    flat = F.regexp_replace(_unquoted(F.trim(_col(c)), "(?s)^[\"'“](.*)[\"'”]$"), r"\s+", " ")
    return truncate_at_word(F.trim(F.array_join(F.slice(F.split(flat, r"(?<=[.!?])\s+"), 1, 3), " ")), 600)


def postprocess_answer(c: Column | str) -> Column:
    """Unquoted, at most one blank line in a row, 3000 characters at most."""
    text = F.trim(_col(c))
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, '(?s)^"(.*)"$', "$1"), "(?s)^'(.*)'$", "$1"))
    one = F.when(text.rlike('(?s)^"(.*)"$'), F.trim(F.regexp_replace(text, '(?s)^"(.*)"$', "$1"))).otherwise(bare)
    return truncate_at_word(F.regexp_replace(one, r"\n{3,}", "\n\n"), 3000)


def query_error(query: Column | str, top_k: Column | str, weight: Column | str, rrf_k: Column | str, p: SearchParams = SearchParams()) -> Column:
    """The first rule that a search request breaks, or null: the rules of SearchParams and ``checked_query`` for a table of requests."""
    size = F.length(F.regexp_replace(F.coalesce(_col(query), F.lit("")), r"(?U)^\s+|\s+$", ""))
    return (
        F.when(size == 0, "empty_query")
        .when(size > p.max_query_chars, "query_too_long")
        .when(~_col(top_k).between(*RETURN_N), "bad_top_k")
        .when(~_col(weight).between(0, 1), "bad_weight")
        .when(~_col(rrf_k).between(*RRF_K), "bad_rrf_k")
    )


def source_header(marker: Column | str, filename: Column | str, page_start: Column | str, page_end: Column | str, section: Column | str) -> Column:
    """[n] (file, p. a–b, section "s")."""
    a, b, s = _col(page_start), _col(page_end), _col(section)
    pages = F.when(a.isNull(), F.lit("")).otherwise(F.concat(F.lit(", p. "), a.cast("string"), F.when(b.isNotNull() & (b != a), F.concat(F.lit("–"), b.cast("string"))).otherwise(F.lit(""))))
    named = F.when(s.isNull() | (s == ""), F.lit("")).otherwise(F.concat(F.lit(', section "'), s, F.lit('"')))
    return F.concat(F.lit("["), _col(marker).cast("string"), F.lit("] ("), _col(filename), pages, named, F.lit(")"))


def where(section: Column | str, page: Column | str) -> Column:
    """section "x", else page n, else null."""
    s, p = _col(section), _col(page)
    return F.when(s.isNotNull(), F.concat(F.lit('section "'), s, F.lit('"'))).when(p.isNotNull(), F.concat(F.lit("page "), p.cast("string")))


def display_name(title: Column | str, filename: Column | str) -> Column:
    return F.coalesce(_col(title), _col(filename))


def format_bytes(c: Column | str) -> Column:
    """Bytes in B, KB, MB or GB; one decimal below ten."""
    n = _col(c).cast("double")

    def shown(value: Column, unit: str) -> Column:
        return F.concat(F.when(value >= 10, F.floor(value + 0.5).cast("string")).otherwise(F.format_string("%.1f", value)), F.lit(f" {unit}"))

    return F.when(n < 1024, F.concat(_col(c).cast("long").cast("string"), F.lit(" B"))).when(n < 1024**2, shown(n / 1024, "KB")).when(n < 1024**3, shown(n / 1024**2, "MB")).otherwise(shown(n / 1024**3, "GB"))


def node_summary(size: Column | str, file_type: Column | str, chunks: Column | str, terms: Column | str, entities: Column | str) -> Column:
    """A sentence on a document's size, type and chunks, one on up to five terms, one on up to three entities."""

    def listed(lead: str, names: Column, most: int) -> Column:
        return F.when(F.coalesce(F.size(names), F.lit(0)) > 0, F.concat(F.lit(lead), F.array_join(F.slice(names, 1, most), ", "), F.lit("."))).otherwise(F.lit(""))

    n = _col(chunks)
    first = F.concat(F.lit("A "), format_bytes(size), F.lit(" "), F.upper(_col(file_type)), F.lit(" split into "), n.cast("string"), F.when(n == 1, F.lit(" chunk.")).otherwise(F.lit(" chunks.")))
    return F.concat(first, listed(" Mostly about ", _col(terms), 5), listed(" Mentions ", _col(entities), 3))


def middle_ellipsis(c: Column | str, most: int) -> Column:
    c, end = _col(c), min(10, (most - 1) // 2)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(most - 1 - end)), F.lit("…"), F.right(c, F.lit(end))))


def relative_time(then: Column | str, now: Column | str) -> Column:
    """just now, minutes, hours or days ago, else the date."""
    s = F.floor(F.unix_timestamp(_col(now)) - F.unix_timestamp(_col(then)) + F.lit(0.0))
    m = F.floor(s / 60 + 0.5)
    h = F.floor(m / 60 + 0.5)
    d = F.floor(h / 24 + 0.5)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, F.lit("just now")).when(m < 60, ago(m, "m")).when(h < 24, ago(h, "h")).when(d < 7, ago(d, "d")).otherwise(F.date_format(_col(then), "MMM d, yyyy"))
