"""File names of attachments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, let, strip_ws

# Label of an unnamed attachment, query parameters that carry a name or a
# number, and extensions that are pages rather than files.
ATTACHMENT_LABEL = "첨부파일"
NAME_PARAMETERS = ("fileNm", "orgFileNm", "fileName")
NUMBER_PARAMETERS = ("fileSeq", "seq")
PAGE_EXTENSIONS = r"(?i)\.(do|jsp|php|asp|aspx)$"

URL_GUARD = "(?i)^https?:"
URL_GUARD_STRICT = "(?i)^https?://"
_VALID_URL = r"^(?i:https?://[^/?#\s]+|(?!https?:)[a-z][a-z0-9+.\-]*:)"


def url_guard(url: Column | str, strict: bool = False) -> Column:
    """Keep only web addresses; ``strict`` also wants the two slashes."""
    return _col(url).rlike(URL_GUARD_STRICT if strict else URL_GUARD)


def _parameter(url: Column, names: tuple[str, ...]) -> Column:
    """Raw value of the first named query parameter that is not empty."""
    values = [F.regexp_extract(url, rf"\?(?:[^#]*&)?{name}=([^&#]*)", 1) for name in names]
    return F.try_element_at(F.filter(F.array(*values), lambda v: v != ""), F.lit(1))


def _path_name(url: Column) -> Column:
    """Decoded last path part where it names a file."""

    def decode(last: Column) -> Column:
        # A plus sign stays in a path; bytes that are no UTF-8 make the escape invalid there.
        decoded = F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))
        return F.when(~decoded.contains("\ufffd"), decoded)

    last = F.regexp_extract(url, r"^[^:]+://[^/?#]*(?:[^?#]*/)?([^/?#]+)/*(?:[?#]|$)", 1)
    is_file = lambda part: part.contains(".") & ~part.rlike(PAGE_EXTENSIONS)
    # An array of at most one entry: an invalid escape gives a null entry, no file name gives none.
    return let(last, lambda part: F.when(is_file(part), F.array(decode(part))))


def guess_name(url: Column | str, index: Column) -> Column:
    """Attachment name from its address: a name parameter, else the last path part with an
    extension, else a label numbered by parameter or by ``index`` (0-based).

    An invalid address or escape gives the label with the index.
    """
    address = _col(url)
    label = F.lit(ATTACHMENT_LABEL + " ")

    def numbered() -> Column:
        return F.concat(label, F.try_url_decode(_parameter(address, NUMBER_PARAMETERS)))

    def from_path() -> Column:
        return let(
            _path_name(address), lambda found: F.when(found.isNotNull(), found[0]).otherwise(numbered())
        )

    named = let(
        _parameter(address, NAME_PARAMETERS),
        lambda raw: F.when(raw.isNotNull(), F.try_url_decode(raw)).otherwise(from_path()),
    )
    ordinal = F.concat(label, (index + 1).cast("string"))
    return F.coalesce(F.when(address.rlike(_VALID_URL), named), ordinal)


def base_name(path: Column | str) -> Column:
    """Last part of a path, trailing slashes ignored."""
    return F.regexp_extract(_col(path), "([^/]*)/*$", 1)


def safe_name(name: Column | str, fallback: Column | str = "attachment") -> Column:
    """Name that is safe as one path part, at most 180 characters."""
    spare = F.lit(fallback) if isinstance(fallback, str) else fallback
    base = base_name(F.coalesce(F.nullif(_col(name), F.lit("")), spare))
    cleaned = F.regexp_replace(base, r'[<>:"/\\|?*\x00-\x1f]', "_")
    cleaned = strip_ws(F.regexp_replace(cleaned, r"^\.+$", "_"))
    return F.coalesce(F.nullif(F.substring(cleaned, 1, 180), F.lit("")), spare)


def file_extension(name: Column | str) -> Column:
    """Lower-cased extension with its dot, '' for none."""
    return F.lower(F.regexp_extract(base_name(name), r"^.+(\.[^.]*)$", 1))


def numbered_name(slot: Column, name: Column | str, fallback: Column | str = "attachment") -> Column:
    """Target file name: two-digit slot and safe name."""
    return F.concat_ws("_", F.lpad(slot.cast("string"), 2, "0"), safe_name(name, fallback))
