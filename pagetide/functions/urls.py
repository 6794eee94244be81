"""URL columns (F09-F16): all of them plain regex expressions, no parser objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values
BATCH_URL_PREFIX = "批量任务（"
URL_INTENTS = (
    ("product", ("/product", "/products", "/p/", "/shop/", "/item/")),
    ("pricing", ("/pricing", "/plans", "/price")),
    ("job", ("/job", "/jobs", "/careers", "/positions", "/openings")),
    ("policy", ("/policy", "/notice", "/announcement", "/press", "/regulation")),
)
EXPECTED_BY_FIELD = (
    ("product", ("price", "sku", "gtin", "availability", "brand", "stock")),
    ("pricing", ("plan", "billing_period", "seat_price", "monthly_price", "annual_price")),
    ("job", ("company", "location", "employment_type", "salary_range", "job_id")),
    ("policy", ("agency", "policy_number", "document_date", "effective_date")),
)
EXPECTED_BY_PATH = (
    ("product", ("/product", "/products", "/p/")),
    ("pricing", ("/pricing", "/plans", "/price")),
    ("job", ("/job", "/jobs", "/careers", "/positions")),
    ("policy", ("/policy", "/notice", "/announcement", "/press")),
)
TYPE_EVIDENCE = {
    "product": ("name", "product", "price", "sku", "brand", "availability"),
    "pricing": ("plan", "price", "billing_period"),
    "job": ("title", "company", "location", "employment_type", "job_id"),
    "policy": ("title", "agency", "policy_number", "publish_date", "content"),
}
GENERIC_PATHS = (
    "/login", "/signin", "/account", "/region", "/locale", "/country", "/category",
    "/categories", "/collections", "/search",
)
TITLE_EVIDENCE = {
    "product": ("product", "price", "shop", "buy"),
    "pricing": ("pricing", "plans", "price"),
    "job": ("job", "career", "hiring", "position"),
    "policy": ("policy", "notice", "announcement", "regulation"),
}
# ---- end of fixed values

_SCHEME = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?"
_AUTHORITY = r"(?://([^/?#]*))?"
_REST = r"([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_WHOLE = "(?s)" + _SCHEME + _AUTHORITY + _REST


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _WHOLE, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    """Authority with its port, as written."""
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def host(url: Column) -> Column:
    """Lower-cased host without credentials, port and a leading 'www.'."""
    bare = F.regexp_replace(F.regexp_replace(netloc(url), "^.*@", ""), r":\d*$", "")
    return F.regexp_replace(F.lower(bare), r"^www\.", "")


def extract_domain(url: Column) -> Column:
    """lower-cased authority; 'batch' for a batch pseudo-URL; 'unknown' without one."""
    domain = F.lower(F.trim(netloc(url)))
    return (
        F.when(url.startswith(BATCH_URL_PREFIX), "batch")
        .when(domain != "", domain)
        .otherwise("unknown")
    )


def path_segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def path_prefix(url: Column) -> Column:
    """first two non-empty path segments, '/' when there are none."""
    return F.concat(F.lit("/"), F.array_join(F.slice(path_segments(url), 1, 2), "/"))


def path_slug(url: Column) -> Column:
    """text after the last slash of the path, trailing slashes ignored."""
    return F.trim(F.regexp_extract(F.trim(path(url)), r"([^/]*)/*$", 1))


def path_tokens(url: Column) -> Column:
    """distinct lower-cased alphanumeric tokens of at least three characters."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(path(url)), F.lit("([a-z0-9]{3,})"), F.lit(1))
    )


def url_variants(url: Column) -> Column:
    """slash toggled, '/m' prefix, 'www.' toggled; distinct and different from the URL."""
    p, authority = path(url), netloc(url)
    own_path = F.when(p == "", F.lit("/")).otherwise(p)
    query = F.when(_part(url, 4) != "", F.concat(F.lit("?"), _part(url, 4))).otherwise("")
    fragment = F.when(_part(url, 5) != "", F.concat(F.lit("#"), _part(url, 5))).otherwise("")

    def rebuilt(at: Column, where: Column) -> Column:
        return F.concat(scheme(url), F.lit("://"), at, where, query, fragment)

    toggled = F.when(own_path.endswith("/"), F.regexp_replace(own_path, "/+$", "")).otherwise(
        F.concat(own_path, F.lit("/"))
    )
    other_host = F.when(authority.startswith("www."), F.regexp_replace(authority, r"^www\.", "")).otherwise(
        F.concat(F.lit("www."), authority)
    )
    deep = own_path != "/"
    candidates = F.array(
        F.when(deep, rebuilt(authority, toggled)),
        F.when(deep, rebuilt(authority, F.concat(F.lit("/m"), own_path))),
        rebuilt(other_host, own_path),
    )
    kept = F.filter(F.array_distinct(candidates), lambda v: v.isNotNull() & (v != url))
    return F.when((scheme(url) != "") & (authority != ""), kept).otherwise(
        F.array().cast("array<string>")
    )


def is_safe_repair(original: Column, candidate: Column) -> Column:
    """same host, and the same slug or enough shared path tokens."""
    same_host = (host(original) == "") | (host(candidate) == "") | (host(original) == host(candidate))
    same_slug = (path_slug(original) != "") & (
        F.lower(path_slug(original)) == F.lower(path_slug(candidate))
    )
    tokens = path_tokens(original)
    shared = F.size(F.array_intersect(tokens, path_tokens(candidate)))
    enough = (F.size(tokens) > 0) & (shared >= F.least(F.lit(2), F.size(tokens)))
    absolute = (scheme(candidate) != "") & (netloc(candidate) != "")
    return absolute & same_host & (same_slug | enough)


def _first_with(text: Column, table) -> Column:
    chain = F.when(F.lit(False), "")
    for name, markers in table:
        chain = chain.when(text.rlike("|".join(markers)), name)
    return chain.otherwise("")


def url_intent(url: Column) -> Column:
    """product, pricing, job, policy or ''."""
    return _first_with(F.lower(path(url)), URL_INTENTS)


def expected_page_type(url: Column, selected: Column) -> Column:
    """page type wanted, from the selected fields first, then from the path."""
    names = F.transform(
        F.coalesce(selected, F.array().cast("array<string>")), lambda n: F.lower(F.trim(n))
    )
    chain = F.when(F.lit(False), "")
    for page_type, fields in EXPECTED_BY_FIELD:
        chain = chain.when(F.arrays_overlap(names, F.array(*[F.lit(f) for f in fields])), page_type)
    return chain.otherwise(_first_with(F.lower(path(url)), EXPECTED_BY_PATH))


def is_generic_path(url: Column) -> Column:
    p = F.lower(path(url))
    return p.rlike("^/*$") | p.rlike("|".join(GENERIC_PATHS))


def page_type_mismatch(original: Column, final: Column, title: Column) -> Column:
    """F16: '<intent>_host_changed', '<intent>_redirected_to_generic_page' or ''."""
    intent = url_intent(original)
    shown = F.lower(F.coalesce(title, F.lit("")))
    title_fits = F.lit(False)
    for page_type, markers in TITLE_EVIDENCE.items():
        title_fits = title_fits | ((intent == page_type) & shown.rlike("|".join(markers)))
    moved = (host(original) != "") & (host(final) != "") & (host(original) != host(final))
    return (
        F.when(intent == "", "")
        .when(moved, F.concat(intent, F.lit("_host_changed")))
        .when(is_generic_path(final) & ~title_fits, F.concat(intent, F.lit("_redirected_to_generic_page")))
        .otherwise("")
    )


def url_hash(url: Column) -> Column:
    """SHA-256 of the trimmed URL, the dedupe key."""
    return F.sha2(F.trim(url), 256)


def resolve_link(base: Column, href: Column) -> Column:
    """absolute form of a link found on a page."""
    link = F.trim(href)
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(link.isNull() | (link == ""), F.lit(""))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path(base), link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .otherwise(F.concat(root, folder, link))
    )
