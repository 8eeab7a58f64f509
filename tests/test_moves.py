"""Pages read by kept moves: the same values as the reader that works out every step."""

import random

from stagekin.sources import extract as X

SPEC = X.Spec(
    fields=(*X.by_class("distance", "date"), X.Field("name", "h1"), X.Field("lang", "html", "lang"),
            X.Field("links", ".stages a", "href", many=True), X.Field("notes", "p", many=True)),
    records=(
        X.Records("climbs", ".climb", (X.Field("own", "", "id"), X.Field("all", ""), X.Field("url", "a", "href"),
                                       X.Field("name", "a"), *X.by_class("category"))),
        X.Records("rows", "div .row", (X.Field("rank", "td.rank"), X.Field("link", "a", "href"), X.Field("cat", ".category"))),
    ),
)
TAGS = "div p li ul ol a span td tr table h1 b br img section html DIV".split()
CLASSES = ["climb", "row", "rank", "category", "distance", "date", "stages", "climb row", "x", "row  category"]


def _markup(rng):
    tag, kind = rng.choice(TAGS), rng.random()
    if kind < 0.4:
        return f"</{tag}>" + rng.choice(["", " "])
    if kind < 0.45:
        return rng.choice(["<!-- a \"b\" 'c' -->", "<!DOCTYPE html>", "<br/>", "<img alt=\"x\">", "<div/>", "<span class=\"climb\"/>"])
    quote, named = rng.choice("\"\"\"'"), ""
    for name in rng.sample(["class", "id", "href", "lang", "data-x", "CLASS"], rng.randrange(4)):
        value = rng.choice(CLASSES) if name.lower() == "class" else rng.choice(["", "u1", "u&amp;2", "a > b", "&copy;", "7"])
        value = value.replace(">", "") if rng.random() < 0.9 else value
        named += f" {name}" if rng.random() < 0.1 else f"{rng.choice([' ', '  '])}{name}={quote}{value}{quote}"
    return f"<{tag}{named}>"


def _page(rng, size):
    texts = ["", "", "12 km", " a  b ", "&amp;", "&lt;x", "5 > 4", "tail"]
    return "".join(_markup(rng) + rng.choice(texts) for _ in range(size)) + rng.choice(texts)


def _plain(plan, text):
    reader = X._Reader(plan)
    if not reader.plain(text):
        return None
    values = reader.finish()
    return ([values[f.name] for f in plan.spec.fields],
            [[[row[f.name] for f in r.fields] for row in values[r.name]] for r in plan.spec.records])


def _differences(spec, sizes, seed):
    rng, plan = random.Random(seed), X._Plan.of(spec)
    moves, read = X._Moves(plan), 0
    for _ in range(3000):
        text = _page(rng, rng.choice(sizes))
        found, expected = moves.read(text), _plain(plan, text)
        if isinstance(found, str):
            assert found == moves.LEFT or expected is None, text
        else:
            read += 1
            assert found == expected, text
    return read


def test_moves_read_what_the_reader_reads():
    assert _differences(SPEC, (3, 12, 40), 1) > 1500
    for seed, spec in enumerate((X.STAGE_PAGE, X.CLIMBS_PAGE, X.STARTLIST_PAGE, X.RACE_PAGE, X.RIDER_PAGE, X.RANKING_PAGE)):
        assert _differences(spec, (8, 20), 10 + seed) > 1500


def test_rows_of_a_list_are_worked_out_once():
    """A page of thousands of rows costs as many moves as a page of a few, whatever its values are."""
    def page(rows):
        return "<table>" + "".join(
            f'<tr class="result"><td class="rank">{n}</td><td><a class="rider" href="rider/{n * 7}">R{n}</a></td></tr>'
            for n in range(rows)) + "</table>"

    moves = X._Moves(X._Plan.of(X.STAGE_PAGE))
    moves.read(page(3))
    made = moves.made
    _, (_, results) = moves.read(page(5000))
    assert moves.made == made and made < 40
    assert results[4999][0] == "4999" and results[4999][4] == "rider/34993"


def test_pages_without_anything_in_common_are_left(monkeypatch):
    monkeypatch.setattr(X, "_MOVES", 200)
    rng, plan = random.Random(5), X._Plan.of(SPEC)
    moves = X._Moves(plan)
    for _ in range(300):
        moves.read(_page(rng, 30))
    assert not moves.usable and moves.read("<p>a</p>") == moves.LEFT
    assert X._Moves(plan).read("<div>" * 1000) == X._Moves.LEFT


def test_scripts_and_titles_are_left():
    moves = X._Moves(X._Plan.of(X.RACE_PAGE))
    assert moves.read("<script>if (a<b) {}</script><h1>A</h1>") == moves.LEFT
    assert moves.read("a < b <h1>A</h1>") == moves.OTHER_MARKUP
    assert moves.read('<h1>A</h1><a href="x') == moves.OTHER_MARKUP
