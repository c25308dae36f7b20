"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def decode_entities(c: Column) -> Column:
    """The five XML entities and the non-breaking space; the ampersand comes last so that nothing decodes twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def normalize_name(c: Column) -> Column:
    """Lower case without blanks, hyphens, underscores and other symbols."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[\s_-]+", ""), r"[^\p{L}\p{N}]", "")


def normalize_query(c: Column) -> Column:
    """Lower case, letters, digits, blanks, apostrophes and hyphens only, blanks collapsed."""
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s'-]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def number_prefix(c: Column) -> Column:
    """The number that a text begins with, as SQLite casts to REAL; null without one."""
    return F.regexp_extract(c, r"^\s*([+-]?[0-9]*\.?[0-9]+)", 1).try_cast("double")


def inline_references(c: Column) -> Column:
    """Ids of inline node references ``<span data-inlineref-node="id">``."""
    return F.regexp_extract_all(c, F.lit('data-inlineref-node="([^"]+)"'), F.lit(1))


#: Capitalised phrases that open sentences (fixed values).
COMMON_PHRASES = ("The", "This", "That", "These", "Those", "When", "Where", "Which", "While", "What", "Should", "Could", "Would", "About", "Always", "Never", "Often", "Sometimes")
#: Quoted phrases with an initial capital, capitalised phrases of two to four words, @names and #tags (fixed patterns).
MENTIONS = (
    r"""["']([A-Z][^"']{2,50})["']""",
    r"(?:^|\s)((?:[A-Z][a-zA-Z-]+(?:\s+|\z)){2,4})",
    r"@([a-zA-Z][a-zA-Z0-9_-]{1,30})",
    r"#([a-zA-Z][a-zA-Z0-9_-]{2,30})",
)


def mentions(c: Column) -> Column:
    """Names that a text mentions, by MENTIONS, distinct in that order; phrases under four characters or that open with a common word are none."""
    found = [F.regexp_extract_all(c, F.lit(k), F.lit(1)) for k in MENTIONS]
    found[0] = F.transform(found[0], lambda x: F.trim(x))  # by itself ``trim`` would also take the place, as what to trim
    phrase = F.transform(found[1], lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    found[1] = F.filter(phrase, lambda x: (F.length(x) >= 4) & ~F.regexp_extract(x, r"^\S+", 0).isin(list(COMMON_PHRASES)))
    return F.array_distinct(F.concat(*found))


def infer_type_by_name(c: Column) -> Column:
    """Data type that an attribute's name suggests, the first rule that fits (fixed values)."""
    name = F.lower(c)
    has = lambda *parts: name.rlike("|".join(parts))
    return (
        F.when(has("date", "time", "scheduled", "deadline", "expir") | (name == "when"), "date")
        .when(has("url", "link"), "url")
        .when(has("phone"), "text")
        .when(has("count", "number", "amount"), "number")
        .when(has("status", "type", "category"), "reference")
        .when(c.rlike(r"^(is|has)($|[A-Z\s_-])") | name.rlike(r"^(is|has)($|[a-z\s_-])") | has("enabled", "completed"), "checkbox")
        .otherwise("text")
    )


def value_type(c: Column, is_reference: Column | None = None) -> Column:
    """Data type that a value shows: a reference, a checkbox, a date (also relative or inline), else null (fixed patterns)."""
    date = c.rlike(r"^\d{4}-\d{2}-\d{2}") | c.rlike(r"^PARENT([+-]\d+)?$") | c.contains("data-inlineref-date")
    shown = F.when(c.isin("true", "false"), "checkbox").when(date, "date")
    return shown if is_reference is None else F.when(is_reference, "reference").otherwise(shown)


NODE_SPAN = r'<span[^>]*data-inlineref-node="([^"]+)"[^>]*>([^<]*)</span>'
_DATE_SPAN = r'<span[^>]*data-inlineref-date="([^"]+)"[^>]*>([^<]*)</span>'
_DATE_IN_SPAN = r'<span[^>]*data-inlineref-date="[^"]*?dateTimeString(?:&quot;|\\"):\s*(?:&quot;|\\")([^"&]+)(?:&quot;|\\")[^"]*"[^>]*>[^<]*</span>'


def inline_dates(c: Column) -> Column:
    """Inline date references as their date text, those without one as nothing."""
    return F.regexp_replace(F.regexp_replace(c, _DATE_IN_SPAN, "$1"), _DATE_SPAN, "")


def format_inline(c: Column, display: bool = False) -> Column:
    """Inline references in plain text: dates by their text, nodes as ``[[id]]`` or by what is shown (else their id)."""
    c = inline_dates(c)
    if not display:
        return F.regexp_replace(c, NODE_SPAN, "[[$1]]")
    return F.regexp_replace(F.regexp_replace(c, NODE_SPAN.replace("([^<]*)", "([^<]+)"), "$2"), NODE_SPAN, "$1")


def transcript_text(c: Column) -> Column:
    """Inline references of a transcript line: dates as ``yyyy-MM-dd HH:mm`` where they are such, nodes by what is shown."""
    c = F.regexp_replace(inline_dates(c), NODE_SPAN, "$2")
    return F.trim(c)


def clock(seconds: Column) -> Column:
    """m:ss from the start."""
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("int").cast("string"), 2, "0"))


def human_bytes(c: Column) -> Column:
    """Bytes in the largest unit below 1024, one decimal beyond bytes."""
    out = F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(c < 1024 ** (k + 1), F.format_string(f"%.1f {unit}", c / 1024**k))
    return out.otherwise(F.format_string("%.1f TB", c / 1024**4))


def human_number(c: Column) -> Column:
    """A whole number with its thousands set apart."""
    return F.format_number(c, 0)


def human_percent(c: Column) -> Column:
    """A share as percentage with one decimal."""
    return F.format_string("%.1f%%", c.cast("double") * 100)


def url_file(c: Column) -> Column:
    """The last part of an address's path, decoded."""
    part = F.regexp_extract(c, r"[^/:]/([^/?#]*)(?:[?#].*)?$", 1)
    return F.coalesce(F.try_url_decode(part), part)


def url_extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(url_file(c), r"\.([A-Za-z0-9]+)$", 1))


def tokens(c: Column) -> Column:
    """Tokens of a text by its length: a quarter of the characters, rounded up."""
    return F.ceil(F.length(c) / 4)


def hit_key(name: Column, tags: Column) -> Column:
    """Key by which hits count as the same: the name without case, leading bullet and brackets, and the tags in order."""
    plain = F.regexp_replace(F.regexp_replace(name, r"^\s*-?\s*", ""), r"\[\[|\]\]", "")
    return F.concat_ws("|", F.lower(F.trim(plain)), F.array_join(F.array_sort(tags), ","))


def context_text(name: Column, ancestor: Column, tag: Column, fields: Column) -> Column:
    """``Tag: name (in ancestor) f: v, ...``: a node's name with what it stands in; missing parts are left out."""
    kind = F.when(tag.isNotNull(), F.concat(F.upper(F.substring(tag, 1, 1)), F.substring(tag, 2, 1000), F.lit(": "), name)).otherwise(name)
    inside = F.when(ancestor.isNotNull(), F.concat(F.lit("(in "), ancestor, F.lit(")")))
    return F.concat_ws(" ", kind, inside, F.when(fields != "", fields))


def cut_segments(text: Column, most: int = 2048) -> Column:
    """Blank-separated segments of a text as long as they fit together, cut whole; a first segment that does not fit is cut inside."""
    parts = F.split(text, " ")
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("full"))

    def step(done: Column, x: Column) -> Column:
        longer = F.when(done["s"] == "", x).otherwise(F.concat(done["s"], F.lit(" "), x))
        fits = ~done["full"] & (F.length(longer) <= most)
        return F.struct(F.when(fits, longer).otherwise(done["s"]).alias("s"), (done["full"] | ~fits).alias("full"))

    kept = F.aggregate(parts, start, step)["s"]
    return F.when(F.length(text) <= most, text).when(kept == "", F.substring(text, 1, most)).otherwise(kept)


def words(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def enriched(tags: Column, fields: Column, name: Column, most: int = 5, cut: int = 50) -> Column:
    """``[Type: #t] [F: v] name`` with at most five attributes, long values cut; fields: array of structs(field, value)."""
    value = lambda v: F.when(F.length(v) > cut, F.concat(F.substring(v, 1, cut), F.lit("…"))).otherwise(v)
    types = F.when(F.size(tags) > 0, F.concat(F.lit("[Type: "), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " "), F.lit("]")))
    parts = F.transform(F.slice(fields, 1, most), lambda f: F.concat(F.lit("["), f["field"], F.lit(": "), value(f["value"]), F.lit("]")))
    return F.concat_ws(" ", types, parts, name)
