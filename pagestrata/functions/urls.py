"""URL expressions: parts, normal form, reference resolution, hosts, file keys.

All are built-in regular expressions and string functions.  A value that is no
valid URL gives null, and callers drop it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from pagestrata.functions.text import byte_cut

_PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_BAD_ESCAPE = r"%(?![0-9a-fA-F]{2})"
_CONTROL = r"[\x00-\x1f\x7f]"
# Characters a path may hold as they are.
_PLAIN_PATH = r"^[A-Za-z0-9\-_.~$&+,/:;=@!'()*\[\]%]*$"
_PLAIN_HOST = r"^[A-Za-z0-9\-_.~$&+,;=!'()*\[\]:<>\"%\x{80}-\x{10ffff}]*$"
# Codes that stay plain characters in an encoded path.
_KEPT_IN_PATH = (
    ("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%2C", ","),
    ("%2F", "/"), ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%40", "@"),
)


def encoded_path(path: Column) -> Column:
    """Path as it is if all characters are allowed, else percent-encoded per byte."""
    plain = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    coded = F.url_encode(plain)
    for code, char in _KEPT_IN_PATH:
        coded = F.replace(coded, F.lit(code), F.lit(char))
    return F.when(path.rlike(_PLAIN_PATH), path).otherwise(coded)


def url_parts(url: Column) -> Column:
    """Struct of scheme, authority, path, query (with ``?``), fragment (with ``#``) and ``ok``."""

    def part(i: int) -> Column:
        return F.regexp_extract(url, _PARTS, i)

    scheme, authority, path, fragment = F.lower(part(1)), part(2), part(3), part(5)
    host_port = F.regexp_extract(authority, r"([^@]*)$", 1)
    relative_colon = (scheme == "") & ~url.startswith("/") & F.regexp_extract(path, r"^([^/]*)", 1).contains(":")
    ok = (
        ~url.rlike(_CONTROL)
        & ~path.rlike(_BAD_ESCAPE)
        & ~fragment.rlike(_BAD_ESCAPE)
        & ~relative_colon
        & host_port.rlike(_PLAIN_HOST)
        & ~host_port.rlike(r"^[^\[]*:[^:]*[^0-9:][^:]*$|\]:[0-9]*[^0-9]")
    )
    return F.struct(
        ok.alias("ok"),
        scheme.alias("scheme"),
        authority.alias("authority"),
        path.alias("path"),
        part(4).alias("query"),
        fragment.alias("fragment"),
    )


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _is_opaque(parts: Column) -> Column:
    """``mailto:x``: a scheme, and then neither an authority nor a rooted path."""
    return (parts["scheme"] != "") & (parts["authority"] == "") & parts["path"].rlike("^[^/]")


def _normal(parts: Column) -> Column:
    scheme = F.when(parts["scheme"] == "", F.lit("https")).otherwise(parts["scheme"])
    path = F.when(parts["path"] == "/", F.lit("")).otherwise(encoded_path(parts["path"]))
    bare = _is_opaque(parts) | ((parts["authority"] == "") & parts["path"].isin("", "/"))
    slashes = F.when(bare, F.lit("")).otherwise(F.lit("//"))
    body = F.when(_is_opaque(parts), parts["path"]).otherwise(F.concat(parts["authority"], path))
    return F.when(parts["ok"], F.concat(scheme, F.lit(":"), slashes, body, parts["query"]))


def normal_url(url: Column) -> Column:
    """Visited key: no fragment, ``https`` if no scheme, path ``/`` dropped; query kept."""
    return _bound(url_parts(url), _normal)


def link_key(url: Column) -> Column:
    """URL in the form links have: no query, no fragment, path ``/`` dropped."""
    return normal_url(F.regexp_extract(url, r"^([^?#]*)", 1))


def host_name(url: Column) -> Column:
    """Host without user, port and brackets; null if the URL is not valid."""
    return _bound(url_parts(url), _host)


def _host(parts: Column) -> Column:
    host_port = F.regexp_extract(parts["authority"], r"([^@]*)$", 1)
    bracketed = F.regexp_extract(host_port, r"^\[([^\]]*)\]", 1)
    plain = F.regexp_extract(host_port, r"^([^:]*)", 1)
    return F.when(parts["ok"], F.when(host_port.startswith("["), bracketed).otherwise(plain))


def domain_key(url: Column) -> Column:
    """Host name, or the text itself if it is no URL."""
    return F.coalesce(host_name(url), url)


def domain_suffixes(host: Column) -> Column:
    """``a.b.c`` -> ``[a.b.c, b.c, c]``: every domain the host belongs to."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def in_domains(url: Column, domains: Sequence[str]) -> Column:
    """Host equals one of the domains or lies below it."""
    def below(host: Column) -> Column:
        hit = F.lit(False)
        for domain in domains:
            hit = hit | (host == domain) | F.endswith(host, F.lit("." + domain))
        return hit

    return F.coalesce(_bound(host_name(url), below), F.lit(False))


def without_dots(path: Column) -> Column:
    """Path with ``.`` and ``..`` segments removed; starts with ``/`` unless empty."""
    folded = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda kept, part: F.when(part == ".", kept)
        .when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.array_append(kept, part)),
    )
    tail = F.when(path.rlike(r"(?:^|/)\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(folded, "/"), tail)
    dotted = F.regexp_replace(joined, r"^//", "/")
    slashed = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return (
        F.when(path == "", F.lit(""))
        .when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), dotted)
        .otherwise(slashed)
    )


def resolved_link(base: Column, href: Column) -> Column:
    """``href`` resolved against the parts of a base URL, without query and fragment.

    Null where the reference is not valid or is not http(s).
    """
    return _bound(url_parts(href), lambda r: _resolve(base, r))


def _resolve(b: Column, r: Column) -> Column:
    absolute = (r["scheme"] != "") | (r["authority"] != "")
    base_dir = F.regexp_extract(encoded_path(b["path"]), r"^(.*/)?", 1)
    merged = (
        F.when(absolute | r["path"].startswith("/"), encoded_path(r["path"]))
        .when(r["path"] == "", encoded_path(b["path"]))
        .otherwise(F.concat(base_dir, encoded_path(r["path"])))
    )
    scheme = F.when(r["scheme"] == "", b["scheme"]).otherwise(r["scheme"])
    authority = F.when(absolute, r["authority"]).otherwise(b["authority"])
    bare_query = F.when(r["query"] == "?", F.lit("?")).otherwise(F.lit(""))
    target = F.when(_is_opaque(r), F.concat(scheme, F.lit(":"), r["path"], bare_query)).otherwise(
        F.concat(scheme, F.lit("://"), authority, _bound(merged, without_dots), bare_query)
    )
    return F.when(b["ok"] & r["ok"] & scheme.isin("http", "https"), target)


def file_key(url: Column) -> Column:
    """File name stem of a page: protocol cut, unsafe characters as ``_``, at most 255 bytes."""
    bare = F.regexp_replace(F.regexp_replace(url, "^http://", ""), "^https://", "")
    return byte_cut(F.translate(bare, '/\\:*?"<>|', "_________"), 255)
