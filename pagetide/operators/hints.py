"""Field hints from metadata and embedded JSON.

Each payload is a list of flat nodes; a field's hint is the first non-blank value over the
nodes of what its rules give.  Rules are Spark SQL snippets over one node `n` of a payload
`p`; a page never leaves its row, so hinting shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions.page_tree import json_payloads
from pagetide.operators.pages import attr, page_title_sql, texts_sql

Rules = dict[str, list[str]]

# ---- Fixed values
META_FIELDS = {
    "og:title": "title", "twitter:title": "title", "description": "summary",
    "og:description": "summary", "twitter:description": "summary",
    "article:published_time": "publish_date", "article:modified_time": "date", "date": "date",
    "pubdate": "publish_date", "author": "author", "product:price:amount": "price",
    "product:price:currency": "price_currency", "product:availability": "availability",
    "product:brand": "brand", "product:retailer_item_id": "sku", "og:price:amount": "price",
    "og:price:currency": "price_currency", "article:author": "author",
    "article:section": "category",
}
MICRODATA_FIELDS = {
    "name": "name", "headline": "title", "price": "price", "pricecurrency": "price_currency",
    "availability": "availability", "datepublished": "publish_date", "datemodified": "date",
    "author": "author", "brand": "brand", "jobtitle": "title", "hiringorganization": "company",
    "joblocation": "location", "basesalary": "salary_range", "articlebody": "content",
    "publisher": "agency",
}
SCRIPT_MARKERS = (
    "__NEXT_DATA__", "__NUXT__", "__APOLLO_STATE__", "__INITIAL_STATE__", "__PRELOADED_STATE__",
    "__REACT_QUERY_STATE__", "ShopifyAnalytics", "BigCommerce", "__SFCC", "variants", "productId",
    "product_id", "sku", "gtin", "offers", "greenhouse", "lever", "ashby", "workday", "icims",
    "smartrecruiters", "jobTitle", "jobNumber", "jobPostingTitle", "jobRequisitionId",
    "externalPath", "locationsText", "requisitionId", "refNumber", "opening", "jobPosting", "jobReqId",
)
CANDIDATE_FIELDS = ("price", "publish_date", "availability", "billing_period", "salary_range")
HAS_CURRENCY = r"(?i)[$€£¥]|USD|EUR|GBP|CNY|RMB"
PRODUCT_TYPES = ("product", "softwareapplication", "service", "offer")
ORGANIZATION_TYPES = ("organization", "governmentorganization", "corporation")
AGENCY_TYPES = ("governmentorganization", "organization")
OFFER_TYPES = ("offer", "aggregateoffer", "pricespecification", "unitpricespecification")
POLICY_TYPES = ("legislation", "governmentservice", "report")
TYPED_HYDRATION = (
    "product", "offer", "aggregateoffer", "pricespecification", "jobposting", "article",
    "newsarticle", "legislation", "governmentservice", "report",
)
JOB_DETAIL_KEYS = ("jobpostingtitle", "jobrequisitionid", "locationstext", "jobtitle", "jobnumber")
JOB_LIST_KEYS = ("jobs", "postings", "openings", "positions", "joblist")
PRODUCT_KEYS = (
    "price", "saleprice", "currentprice", "regularprice", "listprice", "productname",
    "availability", "variants", "variants#", "offers", "offers#", "sku", "gtin",
)
LINKED_KEYS = {
    "summary": "description", "content": "articlebody", "publish_date": "datepublished",
    "date": "datemodified", "valid_through": "validthrough", "author": "author", "brand": "brand",
    "sku": "sku", "company": "hiringorganization", "location": "joblocation",
}
GTIN_KEYS = ("gtin", "gtin8", "gtin12", "gtin13", "gtin14")
NAME_LOOKUP = ("name", "productname", "title", "jobtitle", "jobpostingtitle", "text")
PRICE_LOOKUP = (
    "price", "saleprice", "currentprice", "regularprice", "listprice", "amount", "lowprice",
    "highprice", "monthlyprice", "annualprice",
)
VARIANT_PRICE_LOOKUP = ("price", "saleprice", "currentprice", "regularprice", "listprice", "amount")
VARIANT_STOCK_LOOKUP = ("availability", "stock", "inventory", "available")
CARD_LOOKUP = {
    "title": ("title", "jobtitle", "jobpostingtitle", "text", "name"),
    "company": ("company", "companyname", "hiringorganization", "organization", "department", "team"),
    "location": ("location", "locations", "locationstext", "joblocation", "address", "office"),
    "salary_range": ("salary", "salaryrange", "compensation", "payrange", "basepay", "basesalary"),
    "job_id": ("id", "jobid", "jobpostingid", "jobrequisitionid", "requisitionid", "reqid", "jobnumber"),
    "employment_type": ("employmenttype", "commitment", "jobtype", "worktype", "schedule"),
}
HYDRATION_LOOKUP = {
    "summary": ("description", "summary", "excerpt", "subtitle"),
    "plan": ("plan", "planname", "tier", "tiername", "package"),
    "brand": ("brand", "vendor", "manufacturer"),
    "sku": ("sku", "productsku", "mpn"),
    "gtin": ("gtin", "gtin8", "gtin12", "gtin13", "gtin14", "barcode"),
    "billing_period": ("billingperiod", "billingcycle", "priceperiod", "unittext", "recurringinterval"),
    "company": (
        "company", "companyname", "hiringorganization", "organization", "department", "team",
        "office", "departments",
    ),
    "location": (
        "location", "joblocation", "address", "worklocation", "primarylocation", "locations",
        "locationstext",
    ),
    "employment_type": (
        "employmenttype", "commitment", "jobtype", "type", "employment", "worktype",
        "employmenttypeid", "schedule",
    ),
    "job_id": (
        "requisitionid", "jobrequisitionid", "jobreqid", "reqid", "refnumber", "jobid",
        "jobpostingid", "jobadid", "openingid", "jobnumber", "externalpath", "id",
    ),
    "publish_date": ("datepublished", "publishedate", "publishedat", "createdat", "date", "releasedate"),
    "author": ("author", "byline"),
    "agency": ("agency", "department", "publisher", "issuer"),
    "policy_number": ("policynumber", "documentnumber", "filenumber", "identifier", "legislationidentifier"),
    "content": (
        "articlebody", "body", "content", "text", "description", "jobdescription", "jobad",
        "requirements",
    ),
    "availability": ("availability", "stock", "inventory", "inventoryquantity", "available"),
}
# ATS platform: substring of the key names, or keys that give it away; tried in this order.
ATS_RULES = (
    ("icims", "icims", ("jobnumber", "jobtitle"), True),
    ("greenhouse", "greenhouse", ("departments", "departments#", "offices", "offices#"), False),
    ("lever", "lever", ("commitment",), False),
    ("ashby", "ashby", (), False),
    ("workday", "workday", ("jobrequisitionid",), False),
    ("smartrecruiters", "smartrecruiters", ("refnumber",), False),
)
SALARY_MARKS = r"(?i)salary|compensation|pay|\$"
# ---- end of fixed values


def _quoted(words: Sequence[str]) -> str:
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)


def _get(node: str, *names: str) -> str:
    return "coalesce(" + ", ".join(f"{node}.fields['{n}']" for n in names) + ")"


def _typed(node: str, types: Sequence[str]) -> str:
    return f"arrays_overlap({node}.types, array({_quoted(types)}))"


def _has_key(node: str, names: Sequence[str], joined: str = "OR") -> str:
    return "(" + f" {joined} ".join(f"map_contains_key({node}.fields, '{n}')" for n in names) + ")"


def _iff(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} END"


def _first_value(items: str) -> str:
    return f"get(filter({items}, v -> v <> ''), 0)"


def _below(node: str) -> str:
    """All nodes below one: a slice, as nodes are in document order."""
    return f"slice(p.nodes, {node}.no + 2, {node}.end - {node}.no - 1)"


def _children(node: str, *via: str) -> str:
    return f"filter({_below(node)}, c -> c.parent = {node}.no AND c.via IN ({_quoted(via)}))"


def _over_children(node: str, via: str, names: Sequence[str]) -> str:
    return _first_value(f"transform({_children(node, via)}, c -> {_get('c', *names)})")


def _last_segment(text: str) -> str:
    return f"substring_index({text}, '/', -1)"


# What one offer says; an offer's price carries its currency.
OFFER_PARTS = {
    "price": _iff(
        _get("o", "price", "lowprice", "highprice") + " IS NOT NULL",
        f"concat_ws(' ', {_get('o', 'pricecurrency', 'currency')}, {_get('o', 'price', 'lowprice', 'highprice')})",
    ),
    "availability": _last_segment(_get("o", "availability", "availabilitystarts")),
    "plan": _get("o", "name"),
    "billing_period": _get("o", "billingduration", "unittext", "billingperiod"),
}


def _offer_part(part: str) -> str:
    """First value over the offers of a node (or the node itself when it is an offer), then over
    their price specifications."""
    listed = _children("n", "offers")
    own = f"CASE WHEN {_typed('n', OFFER_TYPES)} AND NOT {_has_key('n', ('offers', 'offers#'))} THEN array(n) ELSE {listed} END"
    specs = f"flatten(transform({own}, o -> {_children('o', 'pricespecification')}))"
    rule = OFFER_PARTS[part]
    return (
        f"coalesce({_first_value(f'transform({own}, o -> {rule})')}, "
        f"{_first_value(f'transform({specs}, o -> {rule})')})"
    )


def _salary() -> str:
    """'CUR min-max UNIT' or 'CUR value UNIT' of a baseSalary object, else its text."""
    base = f"get({_children('n', 'basesalary')}, 0)"
    figure = (
        f"CASE WHEN map_contains_key(a.fields, 'minvalue') AND map_contains_key(a.fields, 'maxvalue') "
        f"THEN concat(a.fields['minvalue'], '-', a.fields['maxvalue']) ELSE a.fields['value'] END"
    )
    text = (
        f"trim(concat_ws(' ', coalesce(a.fields['currency'], {base}.fields['currency'], ''), {figure}, a.fields['unittext']))"
    )
    amounts = f"get(transform(array({base}), b -> filter({_children('b', 'value')}, a -> {figure} IS NOT NULL)), 0)"
    return f"coalesce({_first_value(f'transform({amounts}, a -> {text})')}, n.fields['basesalary'])"


def _linked_rules() -> Rules:
    """What one JSON-LD object says about each field."""
    product, organization = _typed("n", PRODUCT_TYPES), _typed("n", ORGANIZATION_TYPES)
    name = _get("n", "name")
    rules: Rules = {
        "title": [
            _get("n", "title"), _iff(f"NOT {product} AND NOT {organization}", name), _get("n", "headline"),
        ],
        "name": [_iff(product, name)],
        "product": [_iff(product, name)],
        "organization": [_iff(f"{organization} AND NOT {product}", name)],
        "gtin": [_get("n", *GTIN_KEYS)],
        "salary_range": [_salary()],
        "agency": [_get("n", "publisher"), _iff(_typed("n", AGENCY_TYPES), _get("n", "name", "legalname"))],
        "policy_number": [_iff(_typed("n", POLICY_TYPES), _get("n", "legislationidentifier", "identifier"))],
    }
    for field, key in LINKED_KEYS.items():
        rules[field] = [_get("n", key)]
    for part in OFFER_PARTS:
        rules[part] = [_offer_part(part)]
    return rules


def _card_rules() -> Rules:
    """A job list page gives the fields of its first card."""
    is_list = "(" + " OR ".join(f"int(n.fields['{k}#']) > 1" for k in JOB_LIST_KEYS) + ")"
    card = f"get({_children('n', *JOB_LIST_KEYS)}, 0)"
    noted = (
        f"get(transform(array({card}), k -> filter({_children('k', 'metadata', 'fields', 'tags')}, m -> "
        f"array_join(map_values(m.fields), ' ') RLIKE {_quoted([SALARY_MARKS])})), 0)"
    )
    from_notes = _first_value(f"transform({noted}, m -> {_get('m', 'value', 'text', 'label', 'name', 'content')})")
    rules: Rules = {}
    for field, names in CARD_LOOKUP.items():
        value = _get(card, *names)
        rules[field] = [_iff(is_list, f"coalesce({value}, {from_notes})" if field == "salary_range" else value)]
    return rules


def _ats_platform() -> str:
    tests = []
    for name, mark, keys, every in ATS_RULES:
        test = f"contains(n.keys, '{mark}')"
        if keys:
            test += " OR " + _has_key("n", keys, "AND" if every else "OR")
        tests.append(f"WHEN {test} THEN '{name}'")
    return "CASE " + " ".join(tests) + " END"


def _hydration_rules() -> Rules:
    """What one hydration object says about each field, in rule order."""
    rules: Rules = {"ats_platform": [_ats_platform()], **_card_rules()}

    def add(field: str, *more: str) -> None:
        rules.setdefault(field, []).extend(more)

    for field, linked in _linked_rules().items():
        add(field, *[_iff(_typed("n", TYPED_HYDRATION), rule) for rule in linked])
    name, plan = _get("n", *NAME_LOOKUP), _get("n", *HYDRATION_LOOKUP["plan"])
    product_like = f"({_typed('n', ('product', 'offer'))} OR {_has_key('n', PRODUCT_KEYS)})"
    amount = (
        f"coalesce({_get('n', *PRICE_LOOKUP)}, {_offer_part('price')}, "
        f"{_over_children('n', 'variants', VARIANT_PRICE_LOOKUP)})"
    )
    add("name", _iff(product_like, name))
    add("product", _iff(product_like, name))
    add("title", _iff(f"NOT {product_like}", name), _get("n", "headline", "heading"))
    add("price", _iff(f"{amount} IS NOT NULL", f"concat_ws(' ', {_get('n', 'currency', 'pricecurrency')}, {amount})"))
    add(
        "free_tier",
        _iff(f"contains(lower({plan}), 'free')", plan),
        _iff(f"lower({_get('n', *PRICE_LOOKUP)}) IN ('0', '0.0', '0.00', 'free')", f"coalesce({plan}, 'free')"),
    )
    add(
        "enterprise_tier",
        _iff(f"contains(lower({plan}), 'enterprise')", plan),
        _get("n", "enterprise", "contactsales", "custompricing"),
    )
    add("requirements", _get("n", *HYDRATION_LOOKUP["content"]))
    for field, names in HYDRATION_LOOKUP.items():
        if field != "availability":
            add(field, _get("n", *names))
    add("location", _over_children("n", "categories", ("location",)), _get("n", "offices"))
    add("employment_type", _over_children("n", "categories", ("commitment", "employmenttype")))
    stock = f"coalesce({_get('n', *HYDRATION_LOOKUP['availability'])}, {_over_children('n', 'variants', VARIANT_STOCK_LOOKUP)})"
    add("availability", _last_segment(stock))
    return rules


def _entries(nodes: str, rules: Rules, extra: dict[str, str] | None = None) -> str:
    """ARRAY<STRUCT<src, seq, field, value>> of one payload: the first value of each field."""
    found = {
        field: _first_value(f"transform({nodes}, n -> coalesce({', '.join(options)}))")
        for field, options in rules.items()
    }
    found.update(extra or {})
    items = ", ".join(
        f"named_struct('src', p.src, 'seq', p.seq, 'field', '{field}', 'value', {value})"
        for field, value in found.items()
    )
    return f"filter(array({items}), e -> e.value <> '')"


def _payload_entries() -> str:
    list_sizes = " OR ".join(f"int(n.fields['{k}#']) > 1" for k in JOB_LIST_KEYS)
    page_kind = (
        f"CASE WHEN exists(p.nodes, n -> {_has_key('n', JOB_DETAIL_KEYS)}) THEN 'detail' "
        f"WHEN exists(p.nodes, n -> coalesce({list_sizes}, false)) THEN 'list' END"
    )
    linked = _entries("filter(p.nodes, n -> n.linked)", _linked_rules())
    hydration = _entries("p.nodes", _hydration_rules(), {"job_page_kind": page_kind})
    return f"flatten(transform(_payloads, p -> CASE WHEN p.src = 0 THEN {linked} ELSE {hydration} END))"


def embedded_scripts() -> Column:
    """Scripts that can hold JSON, as ARRAY<STRUCT<src, kind, text>>: 0 JSON-LD, 1 hydration."""
    scripts = (
        "transform(filter(tree.elements, e -> e.tag = 'script'), e -> named_struct("
        f"'type', lower(trim({attr('e', 'type')})), 'id', trim({attr('e', 'id')}), "
        "'captured', map_contains_key(e.attrs, 'data-smart-captured-response'), "
        "'text', array_join(transform(slice(tree.texts, e.t0 + 1, e.t1 - e.t0), t -> t.text), '')))"
    )
    is_json = (
        "(s.captured OR s.type IN ('application/json', 'application/ld+json+raw') "
        "OR s.id = '__NEXT_DATA__' OR contains(s.text, '__NUXT_DATA__'))"
    )
    marks = _quoted(["|".join(SCRIPT_MARKERS)])
    wanted = f"s.type LIKE '%ld+json%' OR {is_json} OR s.text RLIKE {marks}"

    def tagged(src: int, kind: str) -> str:
        return f"named_struct('src', {src}, 'kind', '{kind}', 'text', s.text)"

    return F.expr(
        f"flatten(transform(filter({scripts}, s -> {wanted}), s -> array_compact(array("
        f"CASE WHEN s.type LIKE '%ld+json%' THEN {tagged(0, 'whole')} END, "
        f"CASE WHEN {is_json} THEN {tagged(1, 'whole')} WHEN s.type NOT LIKE '%ld+json%' THEN {tagged(1, 'assign')} END))))"
    )


def _dictionary(table: dict[str, str]) -> str:
    return f"map({_quoted([x for pair in table.items() for x in pair])})"


def _source_entries(pairs: str, src: int, last_wins: bool) -> str:
    """One entry per field of tag-based pairs; a bare price gets the currency of the same source."""
    known = f"filter({pairs}, f -> f.field IS NOT NULL AND f.value <> '')"
    pick = "element_at(filter(known, f -> f.field = {}), {}).value"
    which = -1 if last_wins else 1
    own = pick.format("w", which)
    currency = f"CASE WHEN exists(known, f -> f.field = 'price_currency') THEN {pick.format(repr('price_currency'), which)} END"
    value = f"CASE WHEN w = 'price' AND NOT {own} RLIKE {_quoted([HAS_CURRENCY])} THEN concat_ws(' ', {currency}, {own}) ELSE {own} END"
    # A one-element transform names the filtered list once.
    return (
        f"flatten(transform(array({known}), known -> transform("
        f"filter(array_distinct(transform(known, f -> f.field)), w -> w <> 'price_currency'), "
        f"w -> named_struct('src', {src}, 'seq', 0, 'field', w, 'value', {value}))))"
    )


def microdata_hints() -> str:
    """First value of each known itemprop."""
    pairs = (
        "transform(filter(tree.elements, e -> map_contains_key(e.attrs, 'itemprop')), e -> named_struct("
        f"'field', {_dictionary(MICRODATA_FIELDS)}[lower(trim({attr('e', 'itemprop')}))], "
        f"'value', coalesce(nullif({attr('e', 'content')}, ''), nullif({attr('e', 'value')}, ''), {texts_sql('e', ' ')})))"
    )
    return _source_entries(pairs, 2, last_wins=False)


def meta_hints() -> str:
    """Title element, then meta tags; among tags of one field the last wins."""
    key = f"coalesce(nullif({attr('e', 'property')}, ''), nullif({attr('e', 'name')}, ''), {attr('e', 'itemprop')})"
    tags = (
        "transform(filter(tree.elements, e -> e.tag = 'meta'), e -> named_struct("
        f"'field', {_dictionary(META_FIELDS)}[lower(trim({key}))], 'value', {attr('e', 'content')}))"
    )
    title = f"array(named_struct('field', 'title', 'value', {page_title_sql()}))"
    return _source_entries(f"concat({title}, {tags})", 3, last_wins=True)


def with_hints(parsed: DataFrame) -> DataFrame:
    """Add `all_hints` ARRAY<STRUCT<src, seq, field, value>> in order of precedence, the map `hints`
    of winners and the map `hint_candidates` of distinct values."""
    tidy = r"trim(regexp_replace(e.value, '(?U)\\s+', ' '))"
    everything = (
        f"transform(concat(CASE WHEN size(_payloads) > 0 THEN {_payload_entries()} "
        "ELSE CAST(array() AS ARRAY<STRUCT<src: INT, seq: INT, field: STRING, value: STRING>>) END, "
        f"{microdata_hints()}, {meta_hints()}), "
        f"e -> named_struct('src', e.src, 'seq', e.seq, 'field', e.field, 'value', {tidy}))"
    )
    names = "array_distinct(transform(all_hints, e -> e.field))"
    values = "array_distinct(transform(filter(all_hints, e -> e.field = w), e -> e.value))"
    return (
        parsed.withColumn("_scripts", embedded_scripts())
        .withColumn("_payloads", json_payloads(F.col("_scripts")))
        .withColumn("all_hints", F.expr(everything))
        .drop("_scripts", "_payloads")
        .withColumn(
            "hints",
            F.expr(f"map_from_entries(transform({names}, w -> struct(w AS key, get({values}, 0) AS value)))"),
        )
        .withColumn(
            "hint_candidates",
            F.expr(
                f"map_from_entries(filter(transform(filter({names}, w -> w IN ({_quoted(CANDIDATE_FIELDS)})), "
                f"w -> struct(w AS key, {values} AS value)), c -> size(c.value) > 1))"
            ),
        )
    )


def hint_rows(hinted: DataFrame) -> DataFrame:
    """The long table hints(page_id, src, seq, field, value)."""
    return hinted.select("page_id", F.explode("all_hints").alias("h")).select("page_id", "h.*")


def hint_block(selected: Column | None = None) -> Column:
    """The hints as text, selected fields first, then candidate lines."""
    names = F.map_keys("hints")
    ordered = names if selected is None else F.array_distinct(F.concat(selected, names))
    lines = F.transform(
        F.filter(ordered, lambda n: F.map_contains_key("hints", n)),
        lambda n: F.concat(n, F.lit(": "), F.element_at("hints", n)),
    )
    options = F.transform(
        F.filter(F.array(*[F.lit(c) for c in CANDIDATE_FIELDS]), lambda n: F.map_contains_key("hint_candidates", n)),
        lambda n: F.concat(n, F.lit("_candidates: "), F.array_join(F.element_at("hint_candidates", n), " | ")),
    )
    return F.when(
        F.size("hints") > 0,
        F.concat(F.lit("Structured extraction hints:\n"), F.array_join(F.concat(lines, options), "\n")),
    ).otherwise("")
