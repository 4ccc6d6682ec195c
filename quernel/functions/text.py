"""Text functions as Columns: stripping, segmenting, normalising, tokens, markup.

White space means what Python's ``str`` methods mean by it, so results don't
depend on where a rule runs.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernel.functions.core import let

#: Python's white space as a Java character class: Unicode White_Space and U+001C to U+001F.
SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The same characters.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Line ends as ``str.splitlines`` sees them.
LINE_END = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x85\u2028\u2029]"
#: Those that a reader of text files leaves in a line.
OTHER_ENDS = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
DEFAULT_MAX_SEGMENTS = 24


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c.rlike(rf"[^{SPACE}]"), F.lit(False))


def normalize_newlines(c: Column) -> Column:
    """CR and CR LF as LF, as text-mode reading does."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def decode_utf8(content: Column) -> Column:
    """Bytes as UTF-8 text; malformed bytes become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def collapse_lines(c: Column) -> Column:
    """Lines without trailing white space, three or more line ends as two, stripped at both ends."""
    lines = F.transform(F.split(F.regexp_replace(c, LINE_END, "\n"), "\n", -1), rstrip)
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def _kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def paragraphs(c: Column) -> Column:
    """Pieces between blank lines, stripped, without empty ones."""
    return _kept(F.split(c, rf"\n[{SPACE}]*\n", -1))


def sentences(c: Column) -> Column:
    """Pieces after ``.``, ``!`` or ``?`` and white space; a text with fewer than two is one piece."""

    def cut(block: Column) -> Column:
        parts = _kept(F.split(block, rf"(?<=[.!?])[{SPACE}]+", -1))
        whole = F.when(block != "", F.array(block)).otherwise(F.array().cast("array<string>"))
        return let(parts, lambda p: F.when(F.size(p) >= 2, p).otherwise(whole))

    return let(strip(c), cut)


def merge_units(units: Column, cap: int) -> Column:
    """Join consecutive units with a space so that at most ``cap`` remain; none is lost."""
    most = max(1, cap)

    def merged(u: Column) -> Column:
        per = F.ceil(F.size(u) / F.lit(most)).cast("int")
        joined = F.transform(F.sequence(F.lit(0), F.ceil(F.size(u) / per).cast("int") - 1), lambda i: F.array_join(F.slice(u, i * per + 1, per), " "))
        return F.when(F.size(u) <= most, u).otherwise(joined)

    return let(units, merged)


def segments(c: Column, max_segments: int = DEFAULT_MAX_SEGMENTS) -> Column:
    """Two or more paragraphs, or else the sentences of the only one, merged to ``max_segments``."""
    none = F.array().cast("array<string>")
    units = let(paragraphs(c), lambda b: F.when(F.size(b) >= 2, b).when(F.size(b) == 1, sentences(F.get(b, F.lit(0)))).otherwise(none))
    return merge_units(units, max_segments)


@cache
def _fold_table() -> tuple[str, str, dict[str, str]]:
    """Characters that case folding changes and lower-casing doesn't: single ones, and those that grow."""
    one_from, one_to, grown = [], [], {}
    for code in range(0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        folded = c.casefold()
        if folded == c or c.lower() != c:
            continue
        if len(folded) == 1:
            one_from.append(c)
            one_to.append(folded)
        else:
            grown[c] = folded
    return "".join(one_from), "".join(one_to), grown


def casefold(c: Column) -> Column:
    """Full Unicode case folding: lower-casing, then what folding does beyond it."""
    one_from, one_to, grown = _fold_table()
    table = F.create_map(*[F.lit(x) for pair in grown.items() for x in pair])

    def unfolded(low: Column) -> Column:
        letters = F.transform(F.split(low, ""), lambda x: F.coalesce(F.try_element_at(table, x), x))
        return F.when(low.rlike("[" + "".join(grown) + "]"), F.array_join(letters, "")).otherwise(low)

    def fold(x: Column) -> Column:
        ascii_only = F.octet_length(x) == F.char_length(x)
        return F.when(ascii_only, F.lower(x)).otherwise(let(F.translate(F.lower(x), one_from, one_to), unfolded))

    return let(c, fold)


def norm(c: Column) -> Column:
    """White space collapsed to single spaces, stripped, case-folded; null reads as ``none``."""
    return casefold(strip(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("None")), rf"[{SPACE}]+", " ")))


def tokens(c: Column) -> Column:
    """Distinct runs of ASCII letters and digits in the case-folded text."""
    return F.array_distinct(F.regexp_extract_all(casefold(c), F.lit("[a-z0-9]+"), F.lit(0)))


def overlap(a: Column, b: Column) -> Column:
    """How many distinct tokens two token arrays share."""
    return F.size(F.array_intersect(a, b))


def first_chars(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def redacted(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.lit("***")).otherwise(F.lit(""))


#: Elements whose content isn't rendered: fixed values.
HIDDEN_TAGS = ("script", "style", "head", "noscript", "template", "svg")
_MARK = "\u0001"
#: Character references that the native cascade knows: fixed values.
ENTITIES = (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&nbsp;?", " "), ("&#39;", "'"), ("&amp;?", "&"))


def html_text_native(html: Column) -> Column:
    """Visible text of a page by a cascade of replacements, without leaving the JVM.

    Equal to the parser (:func:`quernel.sources.documents.html_to_text`) on pages
    without nested hidden elements of one name and with no character references
    beyond :data:`ENTITIES`; use the parser where these may occur.
    """
    c = F.regexp_replace(html, r"(?s)<!--.*?-->", _MARK)
    c = F.regexp_replace(c, rf"(?is)<({'|'.join(HIDDEN_TAGS)})\b[^>]*>.*?</\1\s*>", _MARK)
    c = F.regexp_replace(c, r"<[!/]?[a-zA-Z][^>]*>", _MARK)

    def unescaped(part: Column) -> Column:
        for pattern, char in ENTITIES:
            part = F.regexp_replace(part, pattern, char)
        return part

    parts = F.filter(F.transform(F.transform(F.split(c, _MARK, -1), unescaped), strip), lambda p: p != "")
    return collapse_lines(F.array_join(parts, "\n"))


def suffix_kind(path: Column) -> Column:
    """``pdf``, ``html`` or ``text`` by a path's suffix."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    return F.when(suffix == ".pdf", "pdf").when(suffix.isin(".html", ".htm", ".xhtml"), "html").otherwise("text")


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def content_kind(content_type: Column) -> Column:
    """``pdf``, ``html`` or ``text`` by what a content type contains."""
    kind = media_type(F.coalesce(content_type, F.lit("")))
    return F.when(kind.contains("pdf"), "pdf").when(kind.contains("html") | kind.contains("xml"), "html").otherwise("text")


def url_scheme(url: Column) -> Column:
    """The lower-cased scheme; empty without one."""
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def scheme_allowed(url: Column) -> Column:
    return F.coalesce(url_scheme(url).isin("http", "https"), F.lit(False))


def api_base(host: Column) -> Column:
    return F.concat(F.regexp_replace(host, r"/+\z", ""), F.lit("/v1"))


def health_url(base: Column) -> Column:
    root = F.regexp_replace(F.regexp_replace(base, r"/+\z", ""), r"/v1\z", "")
    return F.concat(F.regexp_replace(root, r"/+\z", ""), F.lit("/health"))


def models_url(base: Column) -> Column:
    return F.concat(F.regexp_replace(base, r"/+\z", ""), F.lit("/models"))


#: Names that are safe as file names: a fixed value.
SESSION_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


def session_name_valid(name: Column) -> Column:
    return F.coalesce(name.rlike(SESSION_NAME), F.lit(False))
