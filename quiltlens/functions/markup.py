"""Column expressions that read HTML text. All stay on the JVM; none is a parser.

Every pattern is written in the common subset of Java and RE2, so the same rule
can be checked by another SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INVISIBLE = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->"
TAG = r"(?s)<[^>]*>"
LINK = r"(?is)<a\b[^>]*>.*?</a\s*>"
HEADING = r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>"
CHROME = r"(?is)<header\b.*?</header\s*>|<footer\b.*?</footer\s*>"
NAV = r"(?is)<nav\b.*?</nav\s*>"
TOKEN = r"(?s)<[/a-zA-Z][^>]*>[^<]*"
OPEN_TAG = r"(?s)^<([a-zA-Z][a-zA-Z0-9-]*)"
ENTITY = r"&[a-z#0-9]+;"

# Tags that never hold children.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]


def visible(html: Column) -> Column:
    return F.regexp_replace(html, INVISIBLE, " ")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def text_of(markup: Column) -> Column:
    return squeeze(F.regexp_replace(markup, TAG, " "))


def label_of(inner: Column) -> Column:
    """Lower-cased visible words of a link, entities blanked."""
    return squeeze(F.regexp_replace(F.lower(text_of(inner)), ENTITY, " "))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def open_tag(element: Column) -> Column:
    return F.regexp_extract(element, r"(?s)^<[^>]*>", 0)


def attr(element: Column, name: str) -> Column:
    """Quoted attribute value of the element's own opening tag; '' when absent."""
    return F.regexp_extract(open_tag(element), attr_pattern(name), 1)


def attr_pattern(name: str) -> str:
    return rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']"""


def has_attr(element: Column, name: str) -> Column:
    return open_tag(element).rlike(rf"(?is)\s{name}(\s|=|>|/)")


def tag_name(element: Column) -> Column:
    return F.lower(F.regexp_extract(element, OPEN_TAG, 1))


def inner(element: Column) -> Column:
    """Markup between an element's opening and last closing tag."""
    return F.regexp_replace(F.regexp_replace(element, r"(?s)^<[^>]*>", ""), r"(?s)</[^>]*>$", "")


def basename(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(url, r"(?s)[?#].*$", ""), r"([^/]+)/*$", 1))
