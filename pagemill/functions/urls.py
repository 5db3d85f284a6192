"""URL helpers.  ``parse_url`` is avoided: it is null for non-ASCII or spaced URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import let

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
# Schemes for which relative references are resolved.
_RELATIVE_SCHEMES = ["http", "https", "ftp", "file", ""]


def netloc(url: Column) -> Column:
    """Authority part as written (port, user-info and case kept); '' when absent."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def same_host(a: Column, b: Column) -> Column:
    return netloc(a) == netloc(b)


def drop_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


def _merge_paths(base_path: Column, path: Column) -> Column:
    """Relative path against a base path, dot segments removed (RFC 3986, 5.2)."""
    directory = F.regexp_replace(F.regexp_replace(base_path, r"[^/]*$", ""), r"^$", "/")
    joined = F.when(F.startswith(path, F.lit("/")), path).otherwise(
        F.regexp_replace(F.concat(directory, path), "/{2,}", "/")
    )
    return let(joined, lambda j: F.when(F.contains(j, F.lit("/.")), _without_dots(j)).otherwise(j))


def _without_dots(path: Column) -> Column:
    def resolve(pieces: Column) -> Column:
        # a closing dot segment leaves a trailing slash
        closed = F.when(F.element_at(pieces, -1).isin(".", ".."), F.array_append(pieces, F.lit(""))).otherwise(pieces)
        return F.aggregate(
            closed,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == ".", acc)
            .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.array_append(acc, s)),
        )

    # the piece before the leading slash is empty, so resolution starts at the second
    pieces = F.slice(F.split(path, "/", -1), F.lit(2), F.lit(1 << 30))
    return F.concat(F.lit("/"), F.array_join(let(pieces, resolve), "/"))


def _components(url: Column, name: str) -> list[Column]:
    rest = F.regexp_replace(url, _SCHEME, "")
    return [
        F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).alias(f"{name}_scheme"),
        F.regexp_extract(rest, r"^//([^/?]*)", 1).alias(f"{name}_host"),
        F.regexp_extract(rest, r"(?s)^(?://[^/?]*)?([^?]*)", 1).alias(f"{name}_path"),
        F.regexp_extract(rest, r"(?s)\?(.+)$", 1).alias(f"{name}_query"),
    ]


def _rebuilt(p: Column) -> Column:
    own = p["ref_host"] != ""
    path = (
        F.when(own, p["ref_path"])
        .when(p["ref_path"] == "", p["page_path"])
        .otherwise(_merge_paths(p["page_path"], p["ref_path"]))
    )
    keeps_query = own | (p["ref_path"] != "") | (p["ref_query"] != "")
    query = F.when(keeps_query, p["ref_query"]).otherwise(p["page_query"])
    return F.concat(
        p["page_scheme"],
        F.lit("://"),
        F.when(own, p["ref_host"]).otherwise(p["page_host"]),
        path,
        F.regexp_replace(query, r"(?s)^(.+)$", r"?$1"),
    )


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` seen on page ``base``, fragment cut off."""
    tidy = drop_fragment(F.regexp_replace(href, r"^[\x00-\x20]+|[\t\r\n]", ""))

    def resolve(u: Column) -> Column:
        parts = F.struct(*_components(u["ref"], "ref"), *_components(u["page"], "page"))

        def pick(p: Column) -> Column:
            foreign = (p["ref_scheme"] != "") & (p["ref_scheme"] != p["page_scheme"])
            unresolvable = foreign | ~p["page_scheme"].isin(_RELATIVE_SCHEMES)
            return F.when(unresolvable, u["ref"]).when(u["ref"] == "", u["page"]).otherwise(_rebuilt(p))

        return let(parts, pick)

    return let(F.struct(tidy.alias("ref"), drop_fragment(base).alias("page")), resolve)
