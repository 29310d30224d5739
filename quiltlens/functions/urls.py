"""URL columns. Patterns stay in the common subset of Java and RE2 regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Path endings that name assets, and path heads that never are pages.
ASSET_ENDINGS = "png|jpg|jpeg|gif|webp|svg|ico|pdf|woff|woff2|ttf|css|js|map|xml|json|mp4|webm|zip"
DROPPED_HEADS = "/cdn-cgi|/404|/not-found"

ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"
PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)"
ASSET_PATH = rf"(?i)[^/]\.({ASSET_ENDINGS})$"
DROPPED_PATH = rf"(?i)^({DROPPED_HEADS})"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def origin(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), ORIGIN, 1)


def raw_path(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), PATH, 1)


def page_path(url: Column | str) -> Column:
    """Path without query, fragment or trailing slashes; the root is ``/``."""
    trimmed = F.regexp_replace(raw_path(url), "/+$", "")
    return F.when(trimmed == "", F.lit("/")).otherwise(trimmed)


def is_dropped(path: Column) -> Column:
    return (path == "/") | path.rlike(DROPPED_PATH) | path.rlike(ASSET_PATH)


def depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda p: p != ""))


def slug(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    dashed = F.lower(F.array_join(parts, "-"))
    clean = F.regexp_replace(F.regexp_replace(dashed, "[^a-z0-9-]+", "-"), "^-+|-+$", "")
    return F.when(F.size(parts) == 0, "home").when(clean == "", "page").otherwise(clean)


def title_from_path(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    named = F.transform(parts, lambda p: F.initcap(F.regexp_replace(p, "[-_]", " ")))
    return F.when(F.size(parts) == 0, "Home").otherwise(F.array_join(named, " / "))


def parent_path(path: Column) -> Column:
    """Parent of a path with at least two parts, else null."""
    up = F.regexp_replace(path, "/+[^/]+$", "")
    return F.when(depth(path) >= 2, up)


def resolve(href: Column, base: Column) -> Column:
    """Absolute URL of an authored reference, fragment removed.

    Handles full URLs, protocol-relative, root-relative and folder-relative
    references; leading ``./`` and ``../`` are folded one level each.
    """
    bare = F.regexp_replace(F.trim(href), "#.*$", "")
    site = origin(base)
    folder = F.regexp_replace(raw_path(base), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    up = F.regexp_replace(folder, "[^/]+/$", "")
    return (
        F.when(bare.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), bare)
        .when(bare.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), bare))
        .when(bare.startswith("/"), F.concat(site, bare))
        .when(bare == "", F.concat(site, raw_path(base)))
        .when(bare.startswith("?"), F.concat(site, raw_path(base), bare))
        .when(bare.startswith("../"), F.concat(site, up, F.substr(bare, F.lit(4))))
        .when(bare.startswith("./"), F.concat(site, folder, F.substr(bare, F.lit(3))))
        .otherwise(F.concat(site, folder, bare))
    )
