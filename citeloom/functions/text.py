"""Column expressions for text.  Everything here stays in the JVM and inside one row.

Java's ``\\w``, ``\\s`` and ``\\b`` follow ASCII rules unless told otherwise, so word and space classes are
spelled out, and patterns that need Unicode word boundaries carry ``(?U)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes.
SPACE = r"[\s\x1c-\x1f]"  # for patterns under (?U)
EDGES = rf"(?U)^{SPACE}+|{SPACE}+$"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# Plain letters first: a class is tried range by range, and categories are looked up.
WORD = r"[a-zA-Z0-9_\p{L}\p{N}]"
LEXICAL = r"[a-zA-Z0-9_\u00c0-\u1ef9\p{L}\p{N}]"
KEY_PART = r"[a-zA-Z0-9_/\u00c0-\u1ef9\p{L}\p{N}-]"
# Covers every letter whose full case folding is more than lower-casing (Cherokee, which folds upwards, apart).
# The leading range settles plain text in one comparison a character.
FOLDED_LETTERS = (
    r"[\u00b5-\ufb17&&[\u00b5\u00df\u0149\u017f\u01f0\u0345-\u0587\u1c80-\u1e9e\u1f00-\u1fff\ufb00-\ufb17]]")
# Outside Latin letters, Vietnamese included, and punctuation, canonical composition may change a string.
COMPOSED = r"[\u0300-\x{10ffff}&&[\u0300-\u1e9f\u1efa-\u2001\u20d0-\x{10ffff}]]"
KEY_TRIM = " .,:;()[]{}\"'"
TITLE_TRIM = " .,:;()"
QUOTE_TRIM = "\"“”‘’' "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_chars(value: Column, chars: str) -> Column:
    return F.btrim(value, F.lit(chars))


def contains_any(value: Column, needles: Iterable[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(value, F.lit(needle))
    return found


def nfc(value: Column) -> Column:
    """Canonical composition; text made of already composed Latin letters skips the call."""
    def compose(text: Column) -> Column:
        composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
        return F.when(text.rlike(COMPOSED), composed).otherwise(text)
    return let(F.coalesce(value, F.lit("")), compose)


def casefold(value: Column) -> Column:
    """Case folding for caseless comparison.

    Upper-casing expands ligatures and sharp s the way folding does; text without such letters (the usual
    case) is lower-cased only.
    """
    lowered = F.lower(value)
    # The replacement also keeps the optimiser from dropping the inner case change.
    raised = F.replace(F.upper(lowered), F.lit("\u1e9e"), F.lit("SS"))
    return F.when(value.rlike(FOLDED_LETTERS), F.translate(F.lower(raised), "ς", "σ")).otherwise(lowered)


def collapse(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, f"(?U){SPACE}+", " "))


def normalise(value: Column) -> Column:
    return collapse(nfc(value))


def words(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(f"({WORD}+)"), F.lit(1))


def lexical_tokens(value: Column) -> Column:
    return F.regexp_extract_all(casefold(value), F.lit(f"({LEXICAL}+)"), F.lit(1))


def token_set(value: Column) -> Column:
    """Distinct case-folded tokens of at least two characters."""
    return folded_token_set(casefold(value))


def folded_token_set(folded: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(f"{LEXICAL}{LEXICAL}+"), F.lit(0)))


def line_breaks(value: Column) -> Column:
    return F.when(F.contains(value, F.lit("\r")), F.regexp_replace(value, "\r\n?", "\n")).otherwise(value)


def paragraphs(value: Column) -> Column:
    """Blank-line separated paragraphs, or single lines where that leaves at most one; three characters or more."""
    def parts(text: Column, pattern: str, shortest: int) -> Column:
        return F.filter(F.transform(F.split(text, pattern), collapse), lambda part: F.length(part) >= shortest)

    def lines(text: Column) -> Column:
        return parts(text, LINE_END, 3)

    def cut(text: Column) -> Column:
        blocks = let(parts(text, "\n{2,}", 1), lambda found: F.when(
            F.size(found) > 1, F.filter(found, lambda part: F.length(part) >= 3)).otherwise(lines(text)))
        return F.when(F.contains(text, F.lit("\n\n")), blocks).otherwise(lines(text))

    return let(let(F.coalesce(value, F.lit("")), line_breaks), cut)


def excerpt(value: Column, limit: int = 220) -> Column:
    def cut(compact: Column) -> Column:
        prefix = F.rtrim(F.substring(compact, 1, limit - 3))
        return F.when(F.length(compact) <= limit, compact).otherwise(
            F.concat(F.regexp_replace(prefix, " [^ ]*$", ""), F.lit("...")))
    return let(collapse(value), cut)


def shorten(value: Column, limit: int) -> Column:
    def cut(compact: Column) -> Column:
        return F.when(F.length(compact) <= limit, compact).otherwise(
            F.concat(F.rtrim(F.substring(compact, 1, limit - 3)), F.lit("...")))
    return let(collapse(value), cut)


def quote_free(value: Column) -> Column:
    return strip_chars(collapse(casefold(value)), QUOTE_TRIM)


def word_title(value: Column) -> Column:
    return F.array_join(words(casefold(value)), " ")


def content_words(value: Column, stop_words: list[str]) -> Column:
    """Words of two characters or more that are not stop words, in order."""
    long_words = F.regexp_extract_all(casefold(value), F.lit(f"{WORD}{WORD}+"), F.lit(0))
    return F.filter(long_words, lambda word: ~word.isin(*stop_words))


def content_phrase(value: Column, stop_words: list[str]) -> Column:
    return F.array_join(content_words(value, stop_words), " ")


def term_key(value: Column) -> Column:
    return strip_chars(casefold(collapse(value)), KEY_TRIM)


def reference_key(value: Column) -> Column:
    return F.array_join(F.regexp_extract_all(casefold(value), F.lit(f"({KEY_PART}+)"), F.lit(1)), " ")


def literal_pattern(value: Column) -> Column:
    """Quote a column value for use inside a regular expression."""
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def clean_title(title: Column, number: Column) -> Column:
    compact = strip_chars(collapse(title), TITLE_TRIM)
    without = F.regexp_replace(
        F.regexp_replace(compact, F.concat(F.lit("(?iu)"), literal_pattern(number)), F.lit("")),
        F.lit(r"(?iU)\bsố\s*$"), F.lit(""))
    return strip_chars(F.when(F.length(number) > 0, without).otherwise(compact), TITLE_TRIM)


def ordered_ids(ids: Column) -> Column:
    """Trimmed, non-blank, first occurrence kept, order kept."""
    trimmed = F.transform(ids, lambda item: F.regexp_replace(item, EDGES, ""))
    return F.array_distinct(F.filter(trimmed, lambda item: item != ""))


def sentences(value: Column) -> Column:
    return F.split(F.regexp_replace(value, EDGES, ""), rf"(?U)(?<=[.!?。]){SPACE}+")


def redact(value: Column) -> Column:
    secret = F.regexp_replace(
        value, r"(?iU)(api[_-]?key|token|secret|password)" + f"{SPACE}*[:=]{SPACE}*" + r"(?:(?!" + SPACE + r")[^,])+",
        "$1=[REDACTED]")
    return F.regexp_replace(
        secret, r"(?iU)(authorization)" + f"{SPACE}*[:=]{SPACE}*" + r"(?:(?!" + SPACE + r")[^,])+", "$1=[REDACTED]")


def markdown_table(rows: Column) -> Column:
    """``ARRAY<ARRAY<STRING>>`` to a Markdown table: first row is the header, blank rows go, short rows are padded."""
    def cell(item: Column) -> Column:
        text = F.regexp_replace(F.coalesce(item, F.lit("")), EDGES, "")
        return F.replace(text, F.lit("\n"), F.lit(" "))

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    cleaned = F.filter(F.transform(rows, lambda row: F.transform(row, cell)),
                       lambda row: F.exists(row, lambda item: item != ""))

    def render(kept: Column) -> Column:
        width = F.array_max(F.transform(kept, lambda row: F.size(row)))
        padded = F.transform(kept, lambda row: line(F.concat(row, F.array_repeat(F.lit(""), width - F.size(row)))))
        rule = line(F.array_repeat(F.lit("---"), width))
        lines = F.concat(F.slice(padded, 1, 1), F.array(rule), F.slice(padded, 2, F.greatest(F.size(padded), F.lit(1))))
        return F.when(F.size(kept) == 0, F.lit("")).otherwise(F.array_join(lines, "\n"))
    return let(cleaned, render)


def allowed_url(url: Column, domains: Iterable[str]) -> Column:
    """http(s) whose host is an allowed domain or one of its subdomains; malformed addresses are not allowed."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.rtrim(url_host(url), F.lit("."))
    match = F.lit(False)
    for domain in domains:
        name = domain.strip().lower().lstrip(".")
        if name:
            match = match | (host == name) | F.endswith(host, F.lit("." + name))
    return F.coalesce(scheme.isin("http", "https") & (host != "") & match, F.lit(False))


def url_host(url: Column) -> Column:
    """Lower-cased host without user info and port; empty where there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_extract(authority, r"^(?:.*@)?([^:@\[\]]*)(?::[^:]*)?$", 1))


def iso_micros(value: Column) -> Column:
    return F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def json_payload(content: Column) -> Column:
    """Model output without a surrounding code fence."""
    text = F.regexp_replace(content, EDGES, "")
    inner = F.regexp_replace(F.regexp_replace(text, r"(?s)^[^\n]*\n", ""), r"(?s)```(?:(?!```).)*$", "")
    fenced = text.startswith("```") & text.endswith("```")
    return F.when(fenced, F.regexp_replace(inner, EDGES, "")).otherwise(text)


def completions_url(base: Column) -> Column:
    root = F.rtrim(base, F.lit("/"))
    return F.when(root.endswith("/chat/completions"), root).otherwise(F.concat(root, F.lit("/chat/completions")))


def error_code(error: Column) -> Column:
    return F.regexp_extract(error, r"(?s)^([^:]*)", 1)


def error_text(error: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(error, r"(?s)^[^:]*:", ""), EDGES, "")
