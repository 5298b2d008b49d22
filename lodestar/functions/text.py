"""Text, name and MIME rules of the drive as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensible lists of the drive's formats.
TEXT_MIME = (
    "text/plain", "text/markdown", "text/x-markdown", "application/json", "text/csv",
    "text/x-c", "text/x-c++", "text/x-go", "text/x-java-source", "text/x-python",
    "application/javascript", "text/javascript", "application/typescript", "text/typescript",
    "application/sql", "application/xml", "text/xml", "application/x-sh",
)
PDF_MIME = "application/pdf"
DOCX_MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
IMAGE_MIME = ("image/jpeg", "image/png")
SOURCE_NAMES = ("dockerfile", "makefile", "cmakelists.txt", "go.mod", "go.sum", "package.json", "package-lock.json")
SOURCE_EXTENSIONS = (
    ".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx",
    ".go", ".java", ".kt", ".kts", ".py", ".rb", ".php", ".rs", ".swift",
    ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".vue", ".svelte",
    ".sh", ".bash", ".zsh", ".fish", ".ps1", ".sql", ".graphql",
    ".html", ".htm", ".css", ".scss", ".less", ".xml",
    ".yaml", ".yml", ".toml", ".ini", ".conf", ".properties", ".env",
)
#: Signs trimmed from the ends of words before they are counted as tags.
TRIMMED = ".,!?;:()[]{}\"'，。！？；：（）【】"

SPACE = r"[\p{IsWhite_Space}]+"
TRIM_CLASS = "[" + "".join("\\" + c if c in "[]\\^-" else c for c in TRIMMED) + "]+"
EXCERPT_RUNES, SUMMARY_RUNES, ANSWER_RUNES = 320, 240, 180

#: Between the terms of full text.
NOT_TERM = r"[^\p{L}\p{N}]+"


def collapsed(text: Column) -> Column:
    """Words joined by single blanks; null for null."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def stripped(text: Column) -> Column:
    """Without the white space at its ends."""
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def words(text: Column) -> Column:
    """Words of a text between white space, none for null and blank texts."""
    return F.filter(F.split(collapsed(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


def prefix(text: Column, runes: int) -> Column:
    return F.substring(text, 1, runes)


def excerpt(text: Column) -> Column:
    return prefix(collapsed(text), EXCERPT_RUNES)


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` code points, the last three of which are dots if the text is longer."""
    return F.when(F.length(text) > most, F.concat(prefix(text, most - 3), F.lit("..."))).otherwise(text)


def summary(text: Column) -> Column:
    return shortened(collapsed(text), SUMMARY_RUNES)


def language(text: Column) -> Column:
    """``zh`` if there is any CJK unified ideograph, else ``en``."""
    return F.when(F.coalesce(text, F.lit("")).rlike(r"[\x{4E00}-\x{9FFF}]"), "zh").otherwise("en")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 2).cast("long")


def trimmed_word(word: Column) -> Column:
    return F.regexp_replace(word, f"^{TRIM_CLASS}|{TRIM_CLASS}$", "")


def likely_text(text: Column) -> Column:
    """Whether a text has no control characters but line breaks and tabs."""
    return ~text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def normal_mime(mime: Column) -> Column:
    return F.lower(stripped(F.split_part(mime, F.lit(";"), F.lit(1))))


def base_name(name: Column) -> Column:
    return F.lower(stripped(F.regexp_extract(name, r"([^/]*)/*$", 1)))


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r"(\.[^.]*)$", 1)


def is_source_name(name: Column) -> Column:
    """Whether a file of this name is read as source text whatever its MIME type says."""
    base = base_name(name)
    return base.isin(*SOURCE_NAMES) | extension(base).isin(*SOURCE_EXTENSIONS)


def extractor(mime: Column) -> Column:
    """``text``, ``pdf``, ``docx``, ``image`` or ``unsupported``."""
    kind = normal_mime(mime)
    return (
        F.when(kind.isin(*TEXT_MIME), "text").when(kind == PDF_MIME, "pdf").when(kind == DOCX_MIME, "docx").when(kind.isin(*IMAGE_MIME), "image").otherwise("unsupported")
    )


def effective_mime(mime: Column, name: Column) -> Column:
    """The MIME type, but ``text/plain`` for an octet stream whose name is that of source text."""
    return F.when((normal_mime(mime) == "application/octet-stream") & is_source_name(name), "text/plain").otherwise(mime)


def preview_kind(mime: Column) -> Column:
    return (
        F.when(mime.isin("image/jpeg", "image/png", "image/gif", "image/webp"), "image")
        .when(mime == PDF_MIME, "pdf")
        .when(mime.startswith("text/"), "text")
        .otherwise("unsupported")
    )


def valid_name(name: Column) -> Column:
    """A name that isn't blank, ``.`` or ``..``, has no slash or NUL, and at most 255 bytes once trimmed."""
    trimmed = stripped(name)
    return F.coalesce((trimmed != "") & (F.octet_length(trimmed) <= 255) & ~trimmed.isin(".", "..") & ~trimmed.rlike(r"[/\x00]"), F.lit(False))


def valid_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


def null_if_blank(text: Column) -> Column:
    return F.nullif(stripped(text), F.lit(""))


def human_size(size: Column) -> Column:
    """Bytes with a binary unit; one decimal for KB and MB, two for GB."""
    scaled = lambda power, digits, unit: F.format_string(f"%.{digits}f {unit}", size / float(1 << power))
    return F.when(size < 1 << 10, F.format_string("%d B", size)).when(size < 1 << 20, scaled(10, 1, "KB")).when(size < 1 << 30, scaled(20, 1, "MB")).otherwise(scaled(30, 2, "GB"))
