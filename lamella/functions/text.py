"""Text functions as column expressions; what needs Unicode tables or parsers is in ``functions.arrow``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of a summary, with the ellipsis that stands for what is cut.
SUMMARY = 480
#: White space but for the line feed.
BLANK = r"[\t\x0B\f\r \x1C-\x1F\x85\xA0]+"
#: What stands for a path in shown texts; keys whose values are secret; and, in order, connection URLs, signed URLs, secret headers, bearer values and absolute paths, with their marks.
PATH_MARK, SECRET_MARK = "[redacted-path]", "[REDACTED]"
PATH = r"(?U)(?<![:/\w])/(?:[\w.-]+/)*[\w.-]+"
SECRET_KEY = r"(?i)(authorization|x[-_]?\w*[-_]?internal[-_]?token|token|password|passphrase|secret|api[_-]?key|access[_-]?key|private[_-]?key|credential|cookie|signature|signed|connection|dsn)"
SECRETS = (
    (r"(?i)\b(?:postgres(?:ql)?|mysql|redis|mongodb(?:\+srv)?|amqp|file)://[^\s'\"<>]+", "[REDACTED_CONNECTION]"),
    (r"(?i)https?://[^\s'\"<>]*[?&](?:x-amz-[^=]+|signature|token|access[_-]?key|credential)=[^\s'\"<>]*", "[REDACTED_URL]"),
    (r"(?i)\b(?:authorization|x[-_]?\w*[-_]?internal[-_]?token|api[_-]?key|access[_-]?key|token|password)\s*[:=]\s*(?:bearer\s+)?[^\s,;]+", SECRET_MARK),
    (r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+", f"Bearer {SECRET_MARK}"),
    (r"(?<![:A-Za-z0-9_])/(?:[A-Za-z0-9_.-]+/)*[A-Za-z0-9_.-]+", "[REDACTED_PATH]"),
)
#: How a unit id names its layer by number.
LAYER = (r"(?i)(?:^|[._:/-])g(?:ranularity)?[=_:-]?([012])(?:$|[._:/-])", r"(?i)^(?:granularity[=_:-]?)?([012])(?:[._:/-]|$)")
#: A sentence: the shortest stretch up to a closing mark before white space or the end, or the rest.
SENTENCE = r"(?s)\S.*?(?:[.!?。！？](?=\s|$)|$)"


def unified_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def plain_clean(text: Column) -> Column:
    """One space for runs of blanks, at most two line feeds in a row, trimmed."""
    out = F.regexp_replace(unified_newlines(text), BLANK, " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^[ \n]+|[ \n]+\z", "")


def path_redacted(text: Column) -> Column:
    return F.regexp_replace(text, PATH, PATH_MARK)


def secret_redacted(text: Column) -> Column:
    for pattern, mark in SECRETS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def secret_map(values: Column) -> Column:
    """A map without secrets: whole values under telling keys, and what looks like one in the others."""
    return F.transform_values(values, lambda k, v: F.when(F.regexp_like(k, F.lit(SECRET_KEY)), F.lit(SECRET_MARK)).otherwise(secret_redacted(v)))


def unsafe(text: Column) -> Column:
    """Holds an absolute path, a signed URL or a secret-like key."""
    out = F.lit(False)
    for pattern, _ in SECRETS:
        out = out | F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False))
    return out


def truncated_summary(text: Column, most: int = SUMMARY) -> Column:
    """The text, or its first letters with an ellipsis."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))


def stub_summary(text: Column, prefix: str, most: int = 200) -> Column:
    """A prefix, 16 digits of the text's digest, and its first line that isn't blank."""
    line = F.substring(F.trim(F.regexp_extract(text, r"([^\n]*[^\s][^\n]*)", 1)), 1, most)
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 16), F.lit(" "), line)


def external_key(key: Column) -> Column:
    return F.replace(F.lower(F.trim(key)), F.lit("ß"), F.lit("ss"))


def content_full(header: Column, body: Column) -> Column:
    """Sorted ``key: value`` lines of a map, a blank line, the body; the body alone without keys."""
    lines = F.transform(F.array_sort(F.map_entries(header)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.when(F.coalesce(F.size(header), F.lit(0)) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), body)).otherwise(body)


#: Fixed value: what a header's key looks like.
HEADER_KEY = r"\A[a-z][a-z0-9_.-]{0,63}\z"


def header_valid(header: Column) -> Column:
    """Whether every key of a map is of the closed form and every value a text of one line; a map without keys is."""
    entries = F.map_entries(F.coalesce(header, F.create_map().cast("map<string,string>")))
    return F.forall(entries, lambda e: F.regexp_like(e["key"], F.lit(HEADER_KEY)) & F.coalesce(~F.regexp_like(e["value"], F.lit(r"[\x00\n\r]")), F.lit(False)))


def without_header(text: Column, header: Column) -> Column:
    """The text after an exact prefix, if it has it."""
    return F.when(F.startswith(text, header), F.substr(text, F.length(header) + 1)).otherwise(text)


def granularity_of(unit_id: Column) -> Column:
    """Layer of a unit id: by its own number, else by telling words, else 1."""
    number = F.coalesce(*[F.nullif(F.regexp_extract(unit_id, p, 1), F.lit("")) for p in LAYER])
    low = F.lower(unit_id)
    return F.when(number.isNotNull(), number.cast("int")).when(F.regexp_like(low, F.lit("root|document|full")), 0).when(F.regexp_like(low, F.lit("leaf|sentence|paragraph|fragment")), 2).otherwise(1).cast("int")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.regexp_replace(s, r"\s+\z", "")), lambda s: s != "")


def headed_sections(text: Column) -> Column:
    """Sections that begin at second-level headings; at blank lines if there are none; two halves if neither."""
    by_heading = F.split(text, r"\n(?=## )")
    by_blank = F.filter(F.split(text, r"\n[ \t]*\n"), lambda s: F.trim(s) != "")
    half = F.ceil(F.length(text) / 2).cast("int")
    halves = F.filter(F.array(F.substr(text, F.lit(1), half), F.substr(text, half + 1)), lambda s: s != "")
    return F.when(F.size(by_heading) > 1, by_heading).when(F.size(by_blank) > 1, by_blank).otherwise(halves)


def pieces(text: Column, delimiter: str) -> Column:
    """A text cut before each place of a delimiter, from left to right without overlaps; joined, the pieces are the text again."""
    cut = F.split(text, rf"\Q{delimiter}\E", -1)
    return F.filter(F.transform(cut, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(delimiter), x))), lambda x: x != "")


#: Where a text is cut for each level of detail, the first that cuts it counts.
CUTS = {1: ("\n## ", "## "), 2: ("\n\n", "\n")}


def level_parts(text: Column, granularity: Column) -> Column:
    """Parts of a text at a level: itself at level 0; cut before headings at level 1, at blank or new lines at level 2; in the middle where nothing cuts it."""
    half = F.greatest(F.floor(F.length(text) / 2), F.lit(1)).cast("int")
    halves = F.filter(F.array(F.substr(text, F.lit(1), half), F.substr(text, half + 1)), lambda x: x != "")
    out = F.when((granularity == 0) | (text == ""), F.array(text))
    for level, delimiters in CUTS.items():
        for d in delimiters:
            out = out.when((granularity == level) & (F.size(pieces(text, d)) > 1), pieces(text, d))
    return out.otherwise(halves)


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The text of bytes [start, end) of its UTF-8 form."""
    raw = F.encode(text, "UTF-8")
    return F.decode(F.substr(raw, start + 1, end - start), "UTF-8")


def json_text(text: Column) -> Column:
    """A string as JSON writes it, non-ASCII letters kept."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, mark in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(mark))
    return F.concat(F.lit('"'), out, F.lit('"'))


def text_digest(text: Column) -> Column:
    """Digest of the canonical JSON object {"text": ...}."""
    return F.sha2(F.concat(F.lit('{"text":'), json_text(text), F.lit("}")), 256)


#: First bytes of binary kinds in hex, and elements that tell HTML.
MAGIC = (("255044462D", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"))
HTML_HINT = r"(?i)<\s*(?:!doctype|html|head|body|article|main|div|p|h[1-6]|table|ul|ol|section)\b"


def media_type(content: Column) -> Column:
    """Type of raw bytes: PDF and images by their first bytes, then JSON that parses, HTML by its elements, other UTF-8 as text, else unknown."""
    head = F.hex(F.substring(content, 1, 16))
    decoded = F.regexp_replace(F.try_validate_utf8(content.cast("string")), r"^\uFEFF", "")
    stripped = F.regexp_replace(decoded, r"(?U)^\s+", "")
    out = F.when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    for magic, kind in MAGIC:
        out = out.when(F.startswith(head, F.lit(magic)), kind)
    out = out.when(decoded.isNull(), "application/octet-stream").when(F.regexp_like(stripped, F.lit(r"^[{\[]")) & F.try_parse_json(decoded).isNotNull(), "application/json")
    return out.when(F.regexp_like(stripped, F.lit(HTML_HINT)), "text/html").otherwise("text/plain")


def media_verified(declared: Column, detected: Column) -> Column:
    """False where a declared PDF or image isn't one, or an undeclared one shows up."""
    strict = lambda t: F.regexp_like(F.coalesce(t, F.lit("")), F.lit("^(?:application/pdf|image/)"))
    return ~((strict(declared) | strict(detected)) & ~declared.eqNullSafe(detected))
