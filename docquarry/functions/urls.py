"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path segments that begin documentation, and endings of files that are no pages.
DOCS_MARKERS = ("docs", "documentation", "guide", "guides", "manual", "help", "learn")
STATIC_ENDINGS = ("png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "css", "js", "xml", "json", "txt", "zip", "mp4", "mov", "avi", "webm")

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def with_scheme(url: Column) -> Column:
    clean = F.trim(url)
    return F.when(clean.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), clean).otherwise(F.concat(F.lit("https://"), clean))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def host(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def normalize_url(url: Column) -> Column:
    """Scheme, host and path without trailing slashes, query and fragment; null where there is no host."""
    full = with_scheme(url)
    short = F.regexp_replace(path(full), "/+$", "")
    return F.when(host(full) != "", F.concat(scheme(full), F.lit("://"), host(full), F.when(short == "", F.lit("/")).otherwise(short)))


def is_static(url_path: Column) -> Column:
    return F.lower(F.coalesce(url_path, F.lit(""))).rlike(r"\.(" + "|".join(STATIC_ENDINGS) + ")$")


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, or one below the other."""
    return (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a))


def segments(url_path: Column) -> Column:
    return F.filter(F.split(url_path, "/"), lambda s: s != "")


def docs_prefix(url: Column) -> Column:
    """The path that documentation stands below: all of a docs host, or up to the first marker; else null."""
    marked = segments(path(url))
    at = F.array_position(F.transform(marked, lambda s: F.lower(s).isin(*DOCS_MARKERS)), True)
    below = F.concat(F.lit("/"), F.array_join(F.slice(marked, F.lit(1), F.greatest(at, F.lit(1)).cast("int")), "/"))
    return F.when(F.lower(F.regexp_extract(host(url), "^[^.]*", 0)) == "docs", F.lit("/")).when(at > 0, below)


def docs_scope(url: Column) -> Column:
    """The documentation prefix, or the first path segment where there is none."""
    first = F.concat(F.lit("/"), F.coalesce(F.try_element_at(segments(path(url)), F.lit(1)), F.lit("")))
    return F.coalesce(docs_prefix(url), first)


def depth(url: Column) -> Column:
    return F.size(segments(path(url)))


def hrefs(html: Column) -> Column:
    """The first href of each anchor, in document order; empty ones are left out."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))[^>]*>"""), 0)
    value = lambda tag: F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]*)""", 1)
    return F.filter(F.transform(found, value), lambda v: v != "")


def resolve(base: Column, href: Column) -> Column:
    """href as an absolute URL, seen from base: absolute, host-relative, root-relative and path-relative forms."""
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    root = F.concat(scheme(base), F.lit("://"), host(base))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme(base), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(href.rlike("^[?#]"), F.concat(root, path(base), href))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )


def include_paths(url: Column) -> Column:
    """Patterns of the paths below which a site is read: its documentation prefix or its own path; null for a bare host."""
    base = F.coalesce(docs_prefix(url), F.regexp_replace(path(url), "/+$", ""))
    return F.when(base != "", F.array(F.concat(F.lit("^"), base, F.lit("$")), F.concat(F.lit("^"), base, F.lit("/.*$"))))
