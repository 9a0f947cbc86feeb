"""Column functions over text: white space, tokens, redaction, citations, URLs, formats, answers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The lexical token and the patterns of personal data, media, deleted messages and citations.
TOKEN = "[a-z0-9]+"
EMAIL = r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?<!\w)(?:\+?\d[\d \t().-]{7,}\d)(?!\w)"
MEDIA = r"<?(?:image|video|audio|document|sticker|gif|media|contact card) omitted>?"
DELETED = r"^(?:this message was deleted(?: by admin.*)?|you deleted this message)\.?$"
CITATION = r"\[([\d,\s]+)\]"
MARKS = "\u200e\u200f"
INSUFFICIENT = "INSUFFICIENT_CONTEXT"
#: Six signs of a machine-made diagnostic listing, in Java syntax.
SIGNALS = (r"(?i)\bVCDS\b", r"(?i)\b(?:FULL SCAN|Auto-Scan)\b", r"(?im)^Address [0-9A-F]{2}:", r"(?m)^(?:IDE|ENG|MAS)\d+", r"(?i)\bASAM Dataset:\s", r"(?im)^Elapsed Time:\s")
#: Budget tokens: a run of letters, digits and underscores, or one other sign.
BUDGET = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
LINE_END = "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """Budget tokens of a text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(BUDGET))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def strip_marks(text: Column) -> Column:
    """Without marks of writing direction."""
    return F.translate(text, MARKS, "")


def lines(text: Column) -> Column:
    """Lines without their ends, of every kind; no last empty one."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def identity_pattern(senders: list[str]) -> str | None:
    """Pattern of the names among senders that are long enough to be told from words, longest first."""
    names = {re.sub("^[~\\s\u202f]+", "", s).strip() for s in senders}
    long = sorted((n for n in names if len(n) >= 4 and any(map(str.isalpha, n))), key=lambda n: (-len(n), n))
    return "(?iu)" + "|".join("\\Q" + n.replace("\\E", "\\E\\\\E\\Q") + "\\E" for n in long) if long else None


def redact(text: Column, names: list[str] = ()) -> Column:
    """Marks go; emails, then phone numbers, then names become markers; media notes go; white space is squeezed."""
    out = F.regexp_replace(strip_marks(text), "(?U)" + EMAIL, "[EMAIL]")
    out = F.regexp_replace(out, "(?U)" + PHONE, "[PHONE]")
    pattern = identity_pattern(list(names))
    if pattern:
        out = F.regexp_replace(out, pattern, "[PERSON]")
    out = F.regexp_replace(out, "(?i)" + MEDIA, "")
    return strip(F.regexp_replace(F.regexp_replace(out, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def is_deleted(text: Column) -> Column:
    return strip(strip_marks(text)).rlike("(?i)" + DELETED)


def citations(answer: Column, n_passages: Column) -> Column:
    """Sorted distinct markers 1..n_passages named in brackets of digits, commas and spaces."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit("(?U)" + CITATION), F.lit(1)), lambda g: F.regexp_extract_all(g, F.lit(r"\d+"), F.lit(0)))
    marks = F.transform(F.flatten(numbers), lambda x: x.try_cast("bigint"))
    return F.transform(F.array_sort(F.array_distinct(F.filter(marks, lambda m: (m >= 1) & (m <= n_passages)))), lambda m: m.cast("int"))


def grounded(answer: Column) -> Column:
    return ~F.contains(answer, F.lit(INSUFFICIENT))


def context(passages: Column) -> Column:
    """Numbered passages, an ordered array of structs (source, text), as one text."""
    block = lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] (source: "), p["source"], F.lit(")\n"), p["text"])
    return F.array_join(F.transform(passages, block), "\n\n")


def prompt(passages: Column, question: Column) -> Column:
    return F.concat(F.lit("Context passages:\n\n"), passages, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))


def snippet(text: Column, size: int = 240) -> Column:
    return strip(F.substring(text, 1, size))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty, else 'unknown'."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit("unknown"))


def chat_header(chat: Column, start: Column, end: Column, participants: Column) -> Column:
    return F.concat(F.lit("Chat: "), F.coalesce(chat, F.lit("unknown")), F.lit("\nWindow: "), start, F.lit(" to "), end, F.lit("\nParticipants: "), F.array_join(participants, ", "), F.lit("\n"))


def is_diagnostic(text: Column, min_tokens: int = 4000, min_lines: int = 100) -> Column:
    """Large in tokens and lines, with three of the six signs."""
    signs = sum((F.coalesce(text, F.lit("")).rlike(s).cast("int") for s in SIGNALS), F.lit(0))
    return (token_count(text) >= min_tokens) & (F.size(lines(text)) >= min_lines) & (signs >= 3)


def canonical_url(url: Column) -> Column:
    return F.regexp_replace(url, "[?#].*$", "")


def topic_url(url: Column, pattern: str) -> Column:
    """struct(root, topic_id) of a topic page, null for other pages; pattern has the root as group 1 and the id as group 2."""
    clean = F.concat(F.regexp_replace(canonical_url(url), "/$", ""), F.lit("/"))
    return F.when(clean.rlike(pattern), F.struct(F.regexp_extract(clean, pattern, 1).alias("root"), F.regexp_extract(clean, pattern, 2).alias("topic_id")))


def max_page(urls: Column, pattern: str = "/page/(\\d+)/") -> Column:
    """Largest page number in an array of URLs, 1 without any."""
    numbers = F.transform(urls, lambda u: F.regexp_extract(u, pattern, 1).try_cast("int"))
    return F.coalesce(F.array_max(numbers), F.lit(1))


def page_url(root: Column, number: Column) -> Column:
    return F.when(number == 1, root).otherwise(F.concat(root, F.lit("page/"), number.cast("string"), F.lit("/")))


def quoted_title(title: Column) -> Column:
    """A title as part of a URL: spaces become underscores, all but letters, digits and ()_-.~ is escaped."""
    out = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for escaped, plain in (("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return F.replace(F.replace(out, F.lit("*"), F.lit("%2A")), F.lit("+"), F.lit("%20"))


def safe_link(url: Column) -> Column:
    """The URL if it is one of http or https, else null."""
    return F.when(url.rlike("(?i)^https?://"), url)


def iso(ts: Column) -> Column:
    """ISO format; a fraction only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def int_or_zero(value: Column) -> Column:
    return F.coalesce(value.try_cast("int"), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(vec: Column) -> Column:
    return F.sqrt(dot(vec, vec))


def checked_vector(vec: Column, dim: int) -> Column:
    """The vector, or an error that names no content: wrong size, not finite, or zero."""
    bad = F.exists(vec, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(F.size(vec) != dim, F.raise_error(F.lit(f"vector does not have {dim} dimensions")))
        .when(bad, F.raise_error(F.lit("vector is not finite"))).when(norm(vec) == 0, F.raise_error(F.lit("vector is zero"))).otherwise(vec)
    )


def normalised(vec: Column) -> Column:
    return F.transform(vec, lambda x: (x / norm(vec)).cast("float"))


def representative_indices(n: Column, cap: int) -> Column:
    """Evenly spaced 0-based indices: all if n <= cap, the first if cap is 1, halves rounded to even."""
    picks = F.array(F.lit(0)) if cap == 1 else F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: F.bround(i * (n - 1) / F.lit(cap - 1)).cast("int")))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= cap, F.sequence(F.lit(0), n - 1)).otherwise(picks)
