"""URL identity: comparison keys, citation links, site names, redirects. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that mark a visit, and those that litter a citation.
TRACKING = ["ref", "fbclid", "gclid", "igshid", "si", "s", "t", "feature", "lang"]
JUNK = ["fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "_ga", "ref", "error"]
#: Suffixes of two labels under which sites register (ours; others count as one label).
SUFFIXES = [f"{a}.{b}" for b in ("uk", "jp", "au", "nz", "za", "br", "mx", "ar", "tr", "in") for a in ("co", "com", "org", "gov", "ac", "net", "edu", "gob")]


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(F.trim(url), F.lit(name))


def parsed(url: Column) -> Column:
    return part(url, "HOST").isNotNull()


def domain(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(part(url, "HOST")), "^(www\\.)+", ""), F.lit(""))


def _pairs(url: Column) -> Column:
    """Query pairs in order, percent-decoded where that is possible."""
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    raw = F.filter(F.split(F.coalesce(part(url, "QUERY"), F.lit("")), "&"), lambda x: x != "")
    return F.transform(raw, lambda x: F.struct(decode(F.substring_index(x, "=", 1)).alias("k"), F.when(F.contains(x, F.lit("=")), decode(F.regexp_replace(x, "^[^=]*=", ""))).otherwise("").alias("v")))


def _joined(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.when(p["v"] == "", p["k"]).otherwise(F.concat(p["k"], F.lit("="), p["v"]))), "&")


def canonical_url(url: Column) -> Column:
    """Key of a page: host without www., path without trailing slashes, content parameters sorted. A url
    that does not parse is its own key, lower-cased and trimmed."""
    key = lambda p: F.lower(p["k"])
    kept = F.array_sort(F.filter(_pairs(url), lambda p: ~(F.startswith(key(p), F.lit("utm_")) | F.startswith(key(p), F.lit("ref_")) | key(p).isin(TRACKING))))
    path = F.regexp_replace(F.coalesce(part(url, "PATH"), F.lit("")), "/+$", "")
    query = _joined(kept)
    return F.when(parsed(url), F.concat(domain(url), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))).otherwise(F.lower(F.trim(url)))


def display_url(url: Column) -> Column:
    """Citation link: order, scheme and fragment stay; session litter goes."""
    pairs = _pairs(url)
    has_error = F.exists(pairs, lambda p: p["k"] == "error")
    token = lambda v: F.rlike(v, F.lit("^[0-9A-Fa-f_-]{16,}$"))

    def keep(p: Column) -> Column:
        k = F.lower(p["k"])
        return ~(F.startswith(k, F.lit("utm_")) | F.startswith(k, F.lit("ref_")) | k.isin(JUNK) | ((k == "code") & (has_error | token(p["v"]))))

    query = _joined(F.filter(pairs, keep))
    raw = F.trim(url)
    head, fragment = F.regexp_extract(raw, "^[^?#]*", 0), F.regexp_extract(raw, "#.*$", 0)
    return F.when(parsed(url), F.concat(head, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), fragment)).otherwise(raw)


def registrable_domain(url: Column) -> Column:
    labels = F.split(domain(url), "\\.")
    n = F.when(F.array_join(F.slice(labels, -2, 2), ".").isin(SUFFIXES), 3).otherwise(2)
    return F.when(F.size(labels) <= n, domain(url)).otherwise(F.array_join(F.slice(labels, -n, n), "."))


def site_stem(url: Column) -> Column:
    return F.substring_index(registrable_domain(url), ".", 1)


def unwrap_redirect(url: Column) -> Column:
    """Target of a search engine's redirect; '' for its own pages and urls that do not parse."""
    full = F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).otherwise(url)
    target = F.try_url_decode(F.try_parse_url(full, F.lit("QUERY"), F.lit("uddg")))
    inside = F.contains(F.coalesce(part(full, "HOST"), F.lit("")), F.lit("duckduckgo.com"))
    return F.when(~parsed(full) | full.isNull(), "").when(inside, F.coalesce(target, F.lit(""))).otherwise(full)


def lang_variant_key(url: Column) -> Column:
    """Canonical key without a leading language segment of the path."""
    return F.regexp_replace(canonical_url(url), "^([^/?]*)/[a-z]{2}(-[A-Za-z]{2})?(/|$)", "$1/")


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` on the page ``base``, dot segments resolved, fragment dropped."""
    scheme, origin = part(base, "PROTOCOL"), F.concat(part(base, "PROTOCOL"), F.lit("://"), part(base, "AUTHORITY"))
    path = F.coalesce(part(base, "PATH"), F.lit(""))
    link = F.regexp_replace(F.trim(href), "#.*$", "")
    joined = (
        F.when(F.rlike(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), link).when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link)).when(F.startswith(link, F.lit("?")), F.concat(origin, path, link))
        .otherwise(F.concat(origin, F.when(path == "", "/").otherwise(F.regexp_extract(path, "^.*/", 0)), link))
    )
    step = lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
    inner = F.regexp_extract(joined, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(/[^?]*)?", 1)
    clean = F.array_join(F.aggregate(F.split(inner, "/"), F.expr("cast(array() as array<string>)"), step), "/")
    dotted = F.rlike(inner, F.lit("(^|/)\\.\\.?(/|$)"))
    return F.when(dotted, F.concat(F.regexp_extract(joined, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0), clean, F.regexp_extract(joined, "\\?.*$", 0))).otherwise(joined)
