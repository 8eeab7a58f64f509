"""The extractor on deep and broken markup, against a plain matcher that walks whole stacks."""

import random
import time

import pytest

from stagekin.sources import extract as X


def read(spec, text):
    reader = X._Reader(X._Plan.of(spec))
    reader.feed(text)
    return reader.finish()


def test_a_hundred_thousand_open_elements():
    page = '<div class="climb"><a href="location/1">K</a>' * 100_000
    start = time.time()
    found = read(X.STAGE_PAGE, page)
    assert time.time() - start < 30
    assert len(found["climbs"]) == 100_000 and found["climbs"][0] == {"climb_name": "K", "climb_url": "location/1", "category": None}
    for tags in ("<div>a", "<b><p>", "<span><td>x", "<a href=x>"):
        start = time.time()
        read(X.STAGE_PAGE, tags * 100_000)
        assert time.time() - start < 30


def test_page_with_a_broken_construct_keeps_its_fields(spark):
    pages = spark.createDataFrame([("u", '<i class="distance">10 km</i><li class="climb"><a href="location/k">K</a></li><![foo[x')], "url string, html string")
    row = X.extract(pages, X.STAGE_PAGE).first()
    assert row.problem.startswith("parse error") and row.distance == "10 km" and row.climbs[0].climb_name == "K"


def test_fields_that_are_no_numbers_are_listed(spark):
    from stagekin.plans import parsing

    page = '<i class="distance">far</i><i class="vertical_meters">900</i><i class="profile_score"> </i>'
    found = parsing.typed_stages(X.extract(spark.createDataFrame([("u", page)], "url string, html string"), X.STAGE_PAGE)).first()
    assert (found.distance, found.vertical_meters, found.profile_score, found["_errors"]) == (None, 900, None, ["distance: far"])


TAGS = ("div", "a", "b", "ul", "li", "span", "p")
CLASSES = ("", "x", "y", "climb")


def fits(element, step):
    tag, classes, ident = step
    return (tag is None or tag == element[0]) and classes <= element[1] and (ident is None or ident == element[2])


def matches(stack, path):
    """The last element fits the last step, and the other steps fit its ancestors in order."""
    steps = X._steps(path)
    if not stack or not fits(stack[-1], steps[-1]):
        return False
    at = 0
    for element in stack[:-1]:
        if at < len(steps) - 1 and fits(element, steps[at]):
            at += 1
    return at == len(steps) - 1


def plain(spec, tree):
    """Fields of a tree of (tag, class, children or text), each by walking it."""
    found = {f.name: [] if f.many else None for f in spec.fields} | {r.name: [] for r in spec.records}

    def text(node):
        return node if isinstance(node, str) else "".join(text(c) for c in node[2])

    def walk(node, stack, rows, inside):
        if isinstance(node, str):
            return
        stack = [*stack, (node[0], frozenset(node[1].split()), None)]
        for records in spec.records:
            if matches(stack, records.path):
                row = {f.name: None for f in records.fields}
                found[records.name].append(row)
                rows = [*rows, (len(stack), records, row)]
        words = " ".join(text(node).split())
        took = set()
        for f in spec.fields:
            if matches(stack, f.path) and f.name not in inside and (f.many or found[f.name] is None):
                if f.many:
                    found[f.name].append(words)
                    took.add(f.name)
                else:
                    found[f.name] = words
        for depth, records, row in rows:
            for f in records.fields:
                below = stack[depth:]
                if below and row[f.name] is None and matches(below, f.path):
                    row[f.name] = words
        for child in node[2]:
            walk(child, stack, rows, inside | took)

    walk(tree, [], [], frozenset())
    return found


@pytest.mark.parametrize("seed", range(40))
def test_random_trees_equal_the_plain_matcher(seed):
    rng = random.Random(seed)

    def tree(depth):
        children = [tree(depth - 1) if depth and rng.random() < 0.7 else f" t{rng.randrange(9)} " for _ in range(rng.randrange(4))]
        return rng.choice(("div", "b", "span", "ul")), rng.choice(CLASSES), children

    def markup(node):
        if isinstance(node, str):
            return node
        return f'<{node[0]} class="{node[1]}">' + "".join(map(markup, node[2])) + f"</{node[0]}>"

    spec = X.Spec(
        fields=(X.Field("one", "div .x"), X.Field("deep", "div b span"), X.Field("all", ".y b", many=True)),
        records=(X.Records("rows", ".climb", (X.Field("f", "b"), X.Field("g", ".x span"), X.Field("h", "div b .y"))),
                 X.Records("other", "ul .x", (X.Field("f", "span"),))))
    root = ("div", "", [tree(6) for _ in range(4)])
    found, want = read(spec, markup(root)), plain(spec, root)
    found["all"], want["all"] = sorted(found["all"]), sorted(want["all"])
    assert found == want




PIECES = ("<div>", "</div>", '<li class="climb">', "</li>", '<a href="x?a=1&amp;b=2">', "<a href='y'/>", "</a>", "<br>", "<br/>", "a &lt; b",
          " &amp", "<p class=\"distance\">", "</p>", '<tr class="result">', "<td class='rank' hidden>", "1", "<!-- <b> -->", "<!--c-->",
          "<!DOCTYPE html>", '<script src="s">', "if (a<b) '</p>'", "</script>", "<style>", "x", "</style >", "<", ">", '<i title="a>b">',
          "<B CLASS=category>", "</b\n>", "<img src=a/b>", "</>", "<![foo[", "\r", "<title>", "</title>", "&#x41;", "<ul\n>")


def test_plain_reading_equals_the_parser():
    """Pages of all kinds of markup: where the plain reading takes a page, it gives what the parser's events give."""
    rng, plan, taken = random.Random(21), X._Plan.of(X.STAGE_PAGE), 0
    usual = [p for p in PIECES if X._TOKEN.fullmatch(p) or "<" not in p]
    for turn in range(4_000):
        text = "".join(rng.choices(usual if turn % 2 else PIECES, k=rng.randint(1, 30)))
        plain = X._Reader(plan)
        if not plain.plain(text):
            continue
        taken += 1
        parsed = X._Reader(X._Plan.of(X.STAGE_PAGE))
        parsed.feed(text)
        assert plain.finish() == parsed.finish(), text
    assert taken > 500


def test_usual_pages_are_read_plainly():
    """Markup seen before is known, so a page costs a fraction of the parser's steps."""
    plan = X._Plan.of(X.STAGE_PAGE)
    page = ('<!DOCTYPE html><html><head><title>T</title><script>f(1)</script></head><body><p class="distance">{} km</p>'
            '<table><tr class="result"><td class="rank">1<td><a class="rider" href="rider/{}?a=1&amp;b=2">A</a></table></body></html>')
    for k in range(20):
        reader = X._Reader(plan)
        assert reader.plain(page.format(k, k))
        found = reader.finish()
        assert found["distance"] == f"{k} km" and found["results"][0]["rider_url"] == f"rider/{k}?a=1&b=2"
    assert "<td>" in plan.tags and len(plan.tags) < 60


def test_pages_are_read_in_short_groups(spark):
    """A batch of many long pages is not held as Python objects at once; order and rows stay."""
    n = 2 * X._ROWS + 7
    pages = spark.range(0, n, 1, 1).selectExpr("concat('u', id) url", "concat('<p class=\"distance\">', id, '</p>') html")
    found = X.extract(pages, X.STAGE_PAGE).collect()
    assert [(r.url, r.distance) for r in found] == [(f"u{k}", str(k)) for k in range(n)]


def test_the_innermost_open_record_is_known():
    """Its depth falls back to that of the record around it, and to 0 outside."""
    reader = X._Reader(X._Plan.of(X.STAGE_PAGE))
    depths = []
    for markup in ('<div class="climb">', "<div>", '<div class="result">', "</div>", "</div>", "</div>"):
        reader.feed(markup)
        depths.append(reader.deepest)
    assert depths == [1, 1, 3, 1, 1, 0]
