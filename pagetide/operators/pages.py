"""Raw pages to clean text, title and links (H01-H09, H19-H21, F44); no shuffle anywhere.

The tree of a page stays an array in its row, so cleaning is a chain of array expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions.blank import let
from pagetide.functions.page_tree import DROP_TAGS, JOB_BLOCK_PARTS, JOB_BLOCK_WORDS, JOB_FRAMES, JOB_PART, page_tree
from pagetide.functions.selectors import first_selected_sql
from pagetide.functions.urls import resolve_link

# ---- Fixed values
BULLET = "  • "
CELL_SEPARATOR = " | "
TRUNCATION_MARK = "\n\n[... 内容已截断 ...]"
SENTENCE_ENDS = ("。", ".", "！", "!", "？", "?")
JOB_BLOCK_LENGTH, JOB_BLOCK_MINIMUM = 12, 3
# ---- end of fixed values


def parse_pages(pages: DataFrame, drop_tags: tuple[str, ...] = DROP_TAGS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Add `tree` to pages(page_id, url, html, ...); `keep` names attributes that selectors will ask for."""
    return pages.withColumn("tree", page_tree(F.col("html"), drop_tags, keep))


def attr(element: str, name: str) -> str:
    """SQL of an attribute, '' when the element has none."""
    return f"coalesce({element}.attrs['{name}'], '')"


def stripped(text: str) -> str:
    return rf"regexp_replace({text}, '(?U)^\\s+|\\s+$', '')"


def texts_sql(element: str, separator: str, region: str | None = None) -> str:
    """SQL of the stripped texts under an element, joined; with a region only the kept ones."""
    span = f"slice(tree.texts, {element}.t0 + 1, {element}.t1 - {element}.t0)"
    shown = "NOT t.raw" if region is None else f"t.dropped_by < {region}"
    return f"array_join(transform(filter({span}, t -> {shown}), t -> {stripped('t.text')}), '{separator}')"


def _first_sql(condition: str) -> str:
    return f"get(filter(tree.elements, e -> {condition}), 0)"


def select_region(selector: str | None) -> Column:
    """First element that matches a CSS selector, NULL without a match; see `selectors`."""
    if not selector:
        return F.lit(None).cast("struct<no:int,end:int,t0:int,t1:int>")
    return F.expr(
        f"get(transform(filter(array({first_selected_sql(selector, 'tree.elements')}), r -> r IS NOT NULL), "
        "r -> struct(r.no AS no, r.end AS end, r.t0 AS t0, r.t1 AS t1)), 0)"
    )


def region_text(selector: str) -> Column:
    """Plain text of the first element that a selector matches, NULL without a match."""
    span = "slice(tree.texts, r.t0 + 1, r.t1 - r.t0)"
    kept = f"transform(filter({span}, t -> t.dropped_by < r.no), t -> {stripped('t.text')})"
    found = f"filter(array({first_selected_sql(selector, 'tree.elements')}), r -> r IS NOT NULL)"
    return normalize_whitespace(F.expr(f"get(transform({found}, r -> array_join({kept}, '\n')), 0)"))


def _line_sql() -> str:
    """The text line of a heading, paragraph, list item or table row; NULL for others."""
    text = texts_sql("e", "", "_from")
    cells = (
        "transform(filter(slice(_cells, e.c0 + 1, e.c1 - e.c0), c -> c.dropped_by < _from), "
        f"c -> {texts_sql('c', '', '_from')})"
    )
    row = f"get(transform(array({cells}), x -> CASE WHEN array_join(x, '') <> '' THEN array_join(x, '{CELL_SEPARATOR}') END), 0)"
    return f"""CASE WHEN e.tag = 'tr' THEN {row}
        ELSE get(transform(filter(array({text}), x -> x <> ''), x -> CASE
          WHEN e.tag = 'p' THEN concat(x, '\\n') WHEN e.tag = 'li' THEN concat('{BULLET}', x)
          ELSE concat('\\n', repeat('#', int(substring(e.tag, 2, 1))), ' ', x, '\\n') END), 0) END"""


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_whitespace(text: Column) -> Column:
    """Lines trimmed, at most one blank line in a row."""
    lines = F.regexp_replace(text, r"(?U)[^\S\n]*\n[^\S\n]*", "\n")
    return _trimmed(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def smart_truncate(text: Column, most: int) -> Column:
    """Cut a longer text at a paragraph, sentence or line end near the limit, and mark it."""
    head = F.substring(text, 1, most)

    def last_at(mark: str) -> Column:
        """0-based position of the last occurrence, -1 without one."""
        return F.length(head) - F.length(F.substring_index(head, mark, -1)) - len(mark)

    def has(mark: str) -> Column:
        return head.contains(mark)

    cut = F.when(has("\n\n") & (last_at("\n\n") > most * 0.7), F.substring(head, F.lit(1), last_at("\n\n")))
    for mark in SENTENCE_ENDS:
        cut = cut.when(has(mark) & (last_at(mark) > most * 0.8), F.substring(head, F.lit(1), last_at(mark) + 1))
    cut = cut.when(has("\n") & (last_at("\n") > most * 0.8), F.substring(head, F.lit(1), last_at("\n"))).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(_trimmed(cut), F.lit(TRUNCATION_MARK)))


_GROUPS = len(JOB_BLOCK_WORDS) + len(JOB_BLOCK_PARTS) + len(JOB_FRAMES)


def _in_group(element: str, group: str) -> str:
    """SQL: whether a place lies in a job block of the group, within the region."""
    return f"coalesce(get({element}.blocks, {group}) >= _from, false)"


def _job_blocks(kept: str = "_kept") -> Column:
    """The texts of the job blocks by group, ARRAY<ARRAY<STRING>>, long enough or not."""
    own = JOB_BLOCK_WORDS + JOB_BLOCK_PARTS
    tests = [f"get(e.blocks, {k}) = e.no" for k in range(len(own))] + [
        f"{_in_group('e', str(k))} AND contains(lower({attr('e', 'class')}), '{JOB_PART}')" for k in range(len(own), _GROUPS)
    ]
    groups = ", ".join(f"transform(filter({kept}, e -> {t}), e -> {texts_sql('e', chr(92) + 'n', '_from')})" for t in tests)
    return F.transform(F.expr(f"array({groups})"), lambda g: F.transform(g, normalize_whitespace))


def _chosen_blocks() -> Column:
    """STRUCT<groups, blocks>: the blocks of the first one, two, ... groups that give three, NULL when none do."""
    long_enough = lambda g: F.filter(g, lambda t: F.length(t) >= JOB_BLOCK_LENGTH)
    growing = let(
        F.transform(_job_blocks(), long_enough),
        lambda gs: F.transform(
            F.sequence(F.lit(1), F.lit(_GROUPS)),
            lambda i: F.struct(i.alias("groups"), F.array_distinct(F.flatten(F.slice(gs, F.lit(1), i))).alias("blocks")),
        ),
    )
    return F.get(F.filter(growing, lambda g: F.size(g["blocks"]) >= JOB_BLOCK_MINIMUM), 0)


def _beside_blocks(texts: str) -> Column:
    """Texts outside the chosen job blocks, then blocks too short to be chosen that lie in no other block."""

    def covered(place: str) -> str:
        return f"exists(sequence(0, _jobs.groups - 1), g -> {_in_group(place, 'g')})"

    outside = F.expr(rf"transform(filter({texts}, t -> t.dropped_by < _from AND NOT {covered('t')}), t -> {stripped('t.text')})")
    alone = f"filter(_kept, e -> e.blocks IS NOT NULL AND NOT coalesce({covered('get(tree.elements, e.parent)')}, false))"
    short = F.filter(F.flatten(F.slice(_job_blocks(alone), F.lit(1), F.col("_jobs.groups"))), lambda t: F.length(t) < JOB_BLOCK_LENGTH)
    return F.array_join(F.concat(outside, short), "\n")


def with_clean_text(
    parsed: DataFrame,
    selector: str | None = None,
    keep_structure: bool = True,
    max_chars: int | None = None,
    beside: bool = False,
) -> DataFrame:
    """Add `clean_text`.  Without `max_chars` the whole text is kept.

    The clean text of a page with at least three job blocks is that of its blocks; with `beside` the column
    `other_text` has what stands on such a page beside them, NULL on other pages.
    """
    in_region = "_region IS NULL OR (e.no >= _region.no AND e.no < _region.end)"
    texts = "CASE WHEN _region IS NULL THEN tree.texts ELSE slice(tree.texts, _region.t0 + 1, _region.t1 - _region.t0) END"
    plain = F.expr(
        rf"array_join(transform(filter({texts}, t -> t.dropped_by < _from), t -> {stripped('t.text')}), '\n')"
    )
    rows = (
        parsed.withColumn("_region", select_region(selector))
        .withColumn("_from", F.coalesce("_region.no", F.lit(0)))
        .withColumn("_kept", F.expr(f"filter(tree.elements, e -> e.dropped_by < _from AND ({in_region}))"))
    )
    body = plain
    if keep_structure:
        rows = rows.withColumn("_cells", F.expr("filter(tree.elements, e -> e.tag IN ('td', 'th'))")).withColumn(
            "_lines",
            F.expr(
                "array_compact(transform(filter(_kept, e -> e.tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'p', 'li', 'tr')), "
                f"e -> {_line_sql()}))"
            ),
        )
        body = F.when(F.size("_lines") > 0, F.array_join("_lines", "\n")).otherwise(plain)
    has_jobs = F.expr("exists(_kept, e -> e.blocks IS NOT NULL)")
    rows = rows.withColumn("_jobs", F.when(has_jobs, _chosen_blocks()))
    clean = normalize_whitespace(F.coalesce(F.array_join("_jobs.blocks", "\n\n"), body))
    rows = rows.withColumn("clean_text", clean)
    if beside:
        rows = rows.withColumn("other_text", F.when(F.col("_jobs").isNotNull(), normalize_whitespace(_beside_blocks(texts))))
    if max_chars is not None:
        rows = rows.withColumn("clean_text", smart_truncate(F.col("clean_text"), max_chars))
    return rows.drop("_region", "_from", "_kept", "_cells", "_lines", "_jobs")


def page_title_sql() -> str:
    title = "filter(tree.elements, e -> e.tag = 'title')"
    return f"coalesce(get(transform({title}, e -> {texts_sql('e', ' ')}), 0), '')"


def page_title() -> Column:
    """Text of the first title element, ''."""
    return F.expr(page_title_sql())


def canonical_url(base: Column) -> Column:
    """absolute canonical link, '' when the page has none."""
    link = _first_sql(f"e.tag = 'link' AND contains(lower({attr('e', 'rel')}), 'canonical')")
    return resolve_link(base, F.expr(f"{link}.attrs['href']"))


def og_url(base: Column) -> Column:
    """absolute og:url, by property first, then by name."""
    by_property, by_name = (
        _first_sql(f"e.tag = 'meta' AND {attr('e', a)} = 'og:url'") for a in ("property", "name")
    )
    return resolve_link(base, F.expr(f"coalesce({by_property}, {by_name}).attrs['content']"))


def page_lines(pages: DataFrame, text: str = "clean_text") -> DataFrame:
    """One row per non-blank line, markup marks and outer blanks kept out."""
    lines = F.filter(
        F.transform(F.split(text, r"[\r\n]+"), lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " "))),
        lambda s: s != "",
    )
    keep = [c for c in pages.columns if c not in ("html", "tree", text)]
    return pages.select(*keep, F.posexplode(lines).alias("line_no", "line"))
