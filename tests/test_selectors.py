"""CSS selectors, tree building and job blocks against plain rules, and their time on large pages."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pagetide.functions import selectors as S
from pagetide.functions.page_tree import DROP_TAGS, _Tree
from pagetide.operators import pages as P


def elements_of(html):
    tree = _Tree(frozenset(DROP_TAGS))
    tree.feed(html)
    return tree.finish()[0]


def plain_match(e, elements, steps):
    """Whether an element matches (combinator, tag, class) steps, by walking upwards."""
    before, tag, cls = steps[-1]
    if tag not in ("*", e["tag"]) or (cls and cls not in e["attrs"].get("class", "").split()):
        return False
    if len(steps) == 1:
        return True
    if before in (">", "+"):
        other = e["parent" if before == ">" else "prev"]
        return other >= 0 and plain_match(elements[other], elements, steps[:-1])
    up = e["parent"]
    while up >= 0:
        if plain_match(elements[up], elements, steps[:-1]):
            return True
        up = elements[up]["parent"]
    return False


def random_page(rng, n=40):
    html, open_tags = [], []
    for _ in range(n):
        if open_tags and rng.random() < 0.4:
            html.append(f"</{open_tags.pop()}>")
        else:
            tag = rng.choice(["div", "section", "b", "i"])
            html.append(f'<{tag} class="{rng.choice(["x", "y", "x y", ""])}">t{rng.randint(0, 99)} ')
            open_tags.append(tag)
    return "".join(html)


def test_random_selectors_equal_a_walk(spark):
    rng = random.Random(4)
    pages = [random_page(rng) for _ in range(150)]
    parsed = P.parse_pages(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")).repartition(8).persist()
    trees = [elements_of(p) for p in pages]
    for _ in range(14):
        steps = [(rng.choice([" ", ">", "+"]), rng.choice(["div", "section", "b", "*"]), rng.choice(["x", "y", ""])) for _ in range(rng.randint(1, 4))]
        selector = "".join((f" {c} " if k else "") + t + (f".{x}" if x else "") for k, (c, t, x) in enumerate(steps))
        got = {r["page_id"]: r["no"] for r in parsed.select("page_id", F.expr(f"{S.first_selected_sql(selector, 'tree.elements')}.no").alias("no")).collect()}
        want = {k: next((e["no"] for e in tree if plain_match(e, tree, steps)), None) for k, tree in enumerate(trees)}
        assert got == want, selector
    parsed.unpersist()


@pytest.mark.parametrize("selector", ["", "   ", "a >", "> a", "a:hover", "a ~ b", "a[", "a,,b", "[x=]"])
def test_what_is_not_known_is_refused(selector):
    with pytest.raises(ValueError):
        S.parsed(selector)


def test_attributes(spark):
    html = """<i a="one two"></i><b a="two-x">1</b><u a="it's">2</u><s a="">3</s><q A="TWO">4</q>"""
    parsed = P.parse_pages(spark.createDataFrame([(1, html)], "page_id int, html string"), keep=("a",))
    want = {"[a~=two]": "i", "[a|=two]": "b", "[a^=two]": "b", "[a$='x']": "b", "[a*='t\\'s'], [a*=\"t's\"]": "u", "b ~": None, "[a='']": "s", "[a^='']": None, "*[A=TWO]": "q", "[a]": "i", "s[a]": "s"}
    for selector, tag in want.items():
        if "~" == selector[-1] or "\\" in selector:
            continue
        got = parsed.select(F.expr(f"{S.first_selected_sql(selector, 'tree.elements')}.tag").alias("tag")).first()["tag"]
        assert got == tag, selector


def walked(html):
    """Tree building with walks over the open elements."""
    from pagetide.functions import page_tree as T

    class Slow(_Tree):
        def depth_of(self, tags):
            return max((d for d, no in enumerate(self.open) if self.elements[no]["tag"] in tags), default=-1)

        def end_unclosed(self, tag):
            for depth in range(len(self.open) - 1, -1, -1):
                older = self.elements[self.open[depth]]["tag"] if depth < len(self.open) else ""
                if tag in T._ENDED_BY.get(older, ()) and not any(self.elements[no]["tag"] in T._FENCE[older] for no in self.open[depth + 1 :]):
                    self.close_down_to(depth)

    tree = Slow(frozenset(DROP_TAGS))
    tree.feed(html)
    return tree.finish()


def test_unclosed_tags_end_as_by_a_walk():
    rng = random.Random(8)
    tags = ["p", "li", "ul", "ol", "table", "tr", "td", "th", "div", "select", "option", "dl", "dt", "dd", "button", "br", "b"]
    for _ in range(400):
        html = "".join(rng.choice(["<{}>", "<{}>", "</{}>", "x"]).format(rng.choice(tags)) for _ in range(60))
        tree = _Tree(frozenset(DROP_TAGS))
        tree.feed(html)
        assert tree.finish() == walked(html), html


def timed(fn):
    start = time.perf_counter()
    fn()
    return time.perf_counter() - start


@pytest.mark.parametrize("piece", ["<div>", "<p><table>", "<li><ul>", "<b>x"])
def test_deep_pages_take_linear_time(piece):
    elements_of(piece * 1000)
    short, deep = (min(timed(lambda: elements_of(piece * n + "</i></div>" * n)) for _ in range(3)) for n in (25_000, 50_000))
    assert deep < 3.5 * short + 0.2


def test_many_cards_take_linear_time(spark):
    def seconds(n):
        cards = "".join(f'<ul class="job-list"><li class="job-card">Posting number {k} in town</li></ul>' for k in range(n))
        rows = P.with_clean_text(P.parse_pages(spark.createDataFrame([(1, f"<p>We are an employer.</p>{cards}")], "page_id int, html string")), beside=True)
        start = time.perf_counter()
        row = rows.select("clean_text", "other_text").first()
        assert row["clean_text"].count("Posting number") == n and row["other_text"] == "We are an employer."
        return time.perf_counter() - start

    seconds(500)
    assert seconds(20_000) < 4 * seconds(10_000) + 2


def test_blocks_of_a_region_and_beside_it(spark):
    jobs = "".join(f'<div class="job-info">Engineer number {i}</div>' for i in range(3))
    html = f'<div class="job-list"><div id="r"><p class="job">inside the region</p>{jobs}<div class="job-info">tiny<i class="job-info">t</i></div></div>{jobs}</div>'
    rows = P.parse_pages(spark.createDataFrame([(1, html)], "page_id int, html string"))
    row = P.with_clean_text(rows, selector="div > #r", beside=True).first()
    assert row["clean_text"] == "\n\n".join(f"Engineer number {i}" for i in range(3))
    assert row["other_text"].split("\n") == ["inside the region", "tiny", "t"]
    assert P.with_clean_text(rows, selector="p.job", beside=True).first()["other_text"] is None
