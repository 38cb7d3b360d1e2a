"""Column functions over URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"

#: Fixed value: files that a crawl leaves alone.
SKIPPED_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".webp", ".ico", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".rar", ".7z", ".tar", ".gz", ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".css", ".js", ".json", ".xml", ".exe", ".dmg", ".apk",
)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def domain(url: Column) -> Column:
    """Host with user and port, as it stands."""
    return F.regexp_extract(url, _PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def doc_name(url: Column) -> Column:
    """Name of the document made of a page: host and path with underscores, 100 characters at most."""
    name = F.concat(F.replace(domain(url), F.lit("."), F.lit("_")), F.replace(path(url), F.lit("/"), F.lit("_")))
    name = F.substring(F.regexp_replace(name, r"^_+|_+\z", ""), 1, 100)
    return F.when(name == "", "web_page").otherwise(name)


def file_name(url: Column) -> Column:
    """A name for a file: host and path, other characters than word characters, dots and hyphens as one underscore."""
    name = F.regexp_replace(F.concat(domain(url), path(url)), r"(?U)[^\w\-_.]", "_")
    name = F.regexp_replace(F.regexp_replace(name, "_+", "_"), r"^_+|_+\z", "")
    return F.when(name == "", "webpage").otherwise(name)


def crawlable(url: Column, base_domain: Column | None = None) -> Column:
    """Whether a crawl follows a URL: http or https, the same host (if one is given), no skipped extension."""
    extension = "(" + "|".join(e.replace(".", r"\.") for e in SKIPPED_EXTENSIONS) + r")\z"
    ok = scheme(url).isin("http", "https") & ~F.lower(path(url)).rlike(extension)
    return ok & (domain(url) == base_domain) if base_domain is not None else ok
