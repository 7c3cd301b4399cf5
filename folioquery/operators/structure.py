"""Counts of structure, language and fragments of a text; all are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioquery.operators.blocks import FENCE, fences_of, let, lines_of

CJK = r"[\x{4E00}-\x{9FFF}]"
CJK_WIDE = r"[\x{3400}-\x{9FFF}]"
HEADING = r"^#{1,6}\s+"
#: The suffixes that carry a language, and those of a second one before .md.
LANGUAGES = ("zh", "en", "ja", "ko", "fr", "de", "es", "pt", "ru", "ar", "zh-cn", "zh-tw", "zh-hans", "zh-hant", "en-us", "en-gb")
INNER_LANGUAGES = ("zh", "en", "ja", "ko")
#: A Latin word: letters, with single hyphens or apostrophes inside, that no other letter or digit touches.
LATIN_WORD = r"(?<![\p{L}\p{N}_])[A-Za-z]+(?:[-'][A-Za-z]+)*(?![\p{L}\p{N}_])"


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading line, else 0."""
    return F.when(line.rlike(HEADING), F.length(F.regexp_extract(line, "^(#{1,6})", 1))).otherwise(0)


def heading_counts(text: Column) -> Column:
    """Array of six: lines that are headings of each level, fenced or not."""
    levels = F.transform(lines_of(text), heading_level)
    return let(levels, lambda ls: F.array(*[F.size(F.filter(ls, lambda x: x == k)) for k in range(1, 7)]))


def paragraph_lines(text: Column) -> Column:
    """Lines that are neither blank nor begin with # or a bar, outside fences; any fence line toggles."""
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("n"))

    def fold(s: Column, x: Column) -> Column:
        fence = x.rlike(FENCE)
        plain = ~s["inside"] & ~x.rlike(r"^\s*(?:$|[#|])")
        return F.struct((s["inside"] != fence).alias("inside"), (s["n"] + F.when(~fence & plain, 1).otherwise(0)).alias("n"))

    return F.aggregate(lines_of(text), start, fold, lambda s: s["n"])


def table_count(text: Column) -> Column:
    """Maximal runs of pipe lines."""
    pipes = F.transform(lines_of(text), lambda x: F.ltrim(x).startswith("|"))
    return let(pipes, lambda p: F.size(F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.get(p, i) & ((i == 0) | ~F.get(p, i - 1)))))


def unfenced(text: Column) -> Column:
    """The text without fenced lines."""

    def strip(lines: Column) -> Column:
        def rest(fences: Column) -> Column:
            return F.filter(lines, lambda x, i: ~F.exists(fences, lambda f: i.between(f["first"], f["last"])))

        return F.array_join(let(fences_of(lines), rest), "\n")

    return let(lines_of(text), strip)


def without_frontmatter(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\A---\n(?s:.*?)\n---\n", "")


def language_by_letters(text: Column) -> Column:
    """zh if a text has more CJK characters than Latin letters, else en."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.regexp_count(t, F.lit(CJK)) > F.regexp_count(t, F.lit("[A-Za-z]")), "zh").otherwise("en")


def language_by_words(text: Column) -> Column:
    """zh if the text has more CJK characters than Latin words outside fences and front matter, else en."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"\A---\s*\n(?s:.*?)\n---\s*\n", "")
    t = F.regexp_replace(body, r"(?s)```.*?```|~~~.*?~~~", "")
    return let(t, lambda x: F.when(F.regexp_count(x, F.lit(CJK_WIDE)) > F.regexp_count(x, F.lit(LATIN_WORD)), "zh").otherwise("en"))


def latin_fragments(text: Column) -> Column:
    """What may be untranslated in a Chinese text: runs of three or more Latin words, ten characters or more, outside code."""
    masked = F.regexp_replace(unfenced(text), "`[^`\n]+`", "")
    return F.filter(F.regexp_extract_all(masked, F.lit(r"[A-Za-z]+(?:\s+[A-Za-z]+){2,}"), 0), lambda x: F.length(x) >= 10)


def ideograph_fragments(text: Column) -> Column:
    """What may be untranslated in an English text: runs of two or more ideographs outside code."""
    masked = F.regexp_replace(unfenced(text), "`[^`\n]+`", "")
    return F.regexp_extract_all(masked, F.lit(CJK + "{2,}"), 0)


def title(text: Column, fallback: Column) -> Column:
    """The first level-1 heading outside fences, with link texts kept and emphasis stripped; else the fallback."""
    heads = F.filter(F.split(unfenced(text), "\n", -1), lambda x: x.rlike(r"^#\s+\S"))
    raw = F.regexp_replace(F.get(heads, F.lit(0)), r"^#\s+|\s+#*\s*$", "")
    plain = F.regexp_replace(F.regexp_replace(raw, r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"[*_`]", "")
    return F.coalesce(F.when(F.trim(plain) != "", F.trim(plain)), fallback)


def fingerprint_text(text: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and 16 hexadecimal digits of the SHA-256 of the parts as a JSON array without spaces."""
    quoted = [F.coalesce(p if k == "number" else F.concat(F.lit('"'), json_escaped(p), F.lit('"')), F.lit("null")) for k, p in map(_kind, parts)]
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat(F.lit("["), F.concat_ws(",", *quoted), F.lit("]")), 256), 1, 16))


def _kind(part) -> tuple[str, Column]:
    return part if isinstance(part, tuple) else ("text", part)


def number(value: Column) -> tuple[str, Column]:
    """A part of an id that is written as a JSON number."""
    return "number", value.cast("string")


def json_escaped(text: Column) -> Column:
    """JSON string escapes of quotes, backslashes and the white space that text has."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out


def redact_url(url: Column) -> Column:
    """Scheme (lower case), host with port and path of a URL; no user, query or fragment; an empty path is a slash."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    host = F.regexp_replace(authority, "^.*@", "")
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path)))


def url_slug(url: Column) -> Column:
    """Host and path, percent-decoded, with runs of other characters than letters, digits and ideographs as hyphens.

    120 characters at most; user-info, query and fragment don't count. A URL
    without such characters is its host with hyphens for colons, or "untitled".
    """
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*://"
    host = F.regexp_replace(F.regexp_extract(url, scheme + "([^/?#]*)", 1), "^.*@", "")
    path = F.regexp_replace(F.regexp_extract(url, f"(?:{scheme}[^/?#]*)?([^?#]*)", 1), ";[^/]*$", "")
    raw = F.regexp_replace(F.concat(host, path), "^/+|/+$", "")
    shown = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    slug = F.regexp_replace(F.regexp_replace(shown, r"[^a-zA-Z0-9\x{4E00}-\x{9FFF}]+", "-"), "^-+|-+$", "")
    full = F.when(slug == "", F.replace(host, F.lit(":"), F.lit("-"))).otherwise(slug)
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(full, 1, 120), "-+$", ""), F.lit("")), F.lit("untitled"))


def numeric_cell(text: Column) -> Column:
    """The number that a cell shows: commas don't count, brackets mean negative; null for other text."""
    t = F.replace(F.trim(text), F.lit(","), F.lit(""))
    negative = t.startswith("(") & t.endswith(")")
    body = F.when(negative, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    return F.when(body.rlike(r"^[-+]?[0-9]+(\.[0-9]+)?$"), body.try_cast("double") * F.when(negative, -1).otherwise(1))


def natural_key(name: Column) -> Column:
    """Sort key in which digit runs compare as numbers of any length and come before other text: an array of parts.

    A digit run is its length without leading zeros, and its digits.
    """
    parts = F.regexp_extract_all(F.lower(name), F.lit("[0-9]+|[^0-9]+"), 0)

    def part(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=.)", "")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(F.concat(F.lit("1"), p))

    return F.transform(parts, part)


def language_path(path: Column, language: str) -> Column:
    """``report.zh.docx`` to ``report.<language>.md``; a name without a language gets one."""
    stem = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")
    outer = F.regexp_replace(stem, rf"(?i)\.(?:{'|'.join(LANGUAGES)})$", "")
    inner = F.regexp_replace(outer, rf"(?i)(?<=[^/])\.(?:{'|'.join(INNER_LANGUAGES)})$", "")
    return F.concat(F.when(F.lower(path).endswith(".md"), inner).otherwise(outer), F.lit(f".{language}.md"))


def glossary_path(path: Column, language: str) -> Column:
    """``report.md`` to ``report.glossary.<language>.json``."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(f".glossary.{language}.json"))


def timestamp_kind(value: Column) -> Column:
    """date or instant for an ISO date or a timestamp with an offset; null for others, zoneless ones too."""
    date = value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).isNotNull()
    instant = value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$") & value.try_cast("timestamp").isNotNull()
    return F.when(date, "date").when(instant, "instant")


#: Device names that no file may have.
DEVICES = ["con", "prn", "aux", "nul", *[f"com{k}" for k in range(1, 10)], *[f"lpt{k}" for k in range(1, 10)]]


def component_problem(name: Column) -> Column:
    """Why a name is no safe path component, or null."""
    return (
        F.when(name.isNull() | (name == ""), "empty")
        .when(name.isin(".", ".."), "relative")
        .when(name.rlike(r'[/\\<>:"|?*]'), "separator")
        .when(name.rlike(r"[\x00-\x1f\x7f]"), "control")
        .when(name.rlike(r"[. ]$"), "trailing")
        .when(F.lower(F.split_part(name, F.lit("."), F.lit(1))).isin(DEVICES), "device")
    )


#: Media types by suffix, those of office files first.
MEDIA_TYPES = {
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "docm": "application/vnd.ms-word.document.macroEnabled.12",
    "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "pptm": "application/vnd.ms-powerpoint.presentation.macroEnabled.12",
    "pps": "application/vnd.ms-powerpoint",
    "ppsx": "application/vnd.openxmlformats-officedocument.presentationml.slideshow",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xlsm": "application/vnd.ms-excel.sheet.macroEnabled.12",
    "xlsb": "application/vnd.ms-excel.sheet.binary.macroEnabled.12",
    "md": "text/markdown", "txt": "text/plain", "csv": "text/csv", "tsv": "text/tab-separated-values", "html": "text/html", "htm": "text/html", "xml": "text/xml",
    "json": "application/json", "pdf": "application/pdf", "rtf": "application/rtf", "epub": "application/epub+zip", "zip": "application/zip",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp",
}


def media_type(path: Column) -> Column:
    pairs = [F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]
    suffix = F.lower(F.regexp_extract(F.regexp_replace(path, "[?#].*$", ""), r"\.([^./]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*pairs), suffix), F.lit("application/octet-stream"))
