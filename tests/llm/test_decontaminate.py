"""Items inside runs without spaces, and items with a single place to start from, and the recall at the limit of edits."""

import random

import pytest

from stagekin.llm import decontaminate


def found(items, texts):
    hits = decontaminate.Index(list(enumerate(items)), 0.8, decontaminate.REPEATS).find(texts)
    return [{i for i, _, _ in one} for one in hits]


def test_items_inside_runs_of_scripts_without_spaces():
    items = ["人工智能正在改变世界各地的科学研究方法与教育方式。", "これは評価のために書かれた短い文章です。", "กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทย"]
    texts = ["昨天，他在报纸上写道：“" + items[0] + "”许多读者表示同意，也有人反对。", "先生は、" + items[1] + "と言いました。",
             "เขาบอกว่า" + items[2] + "และทุกคนก็รู้", "昨天，他在报纸上写道。許多讀者"]
    assert found(items, texts) == [{0}, {1}, {2}, set()]


def test_item_with_one_place_to_walk_from():
    rows = ["1 2 3 4 5 6 7 8 9 10 11 12 13 14", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8"]
    assert [len(r) for r in rows] == [32, 33]
    assert found(rows, [f"values {r} end" for r in rows]) == [{0}, {1}]


def test_spaced_runs_start_at_words_only():
    codes, _ = decontaminate.normalized(["Ein Übermaß — 한국어 문장 “x”".encode(), "a漢字b c".encode()])
    starts = [bytes(codes[s:]).split(b"\0")[0].decode() for s in decontaminate.word_starts(codes)]
    assert starts[-5:] == ["a漢字b c", "漢字b c", "字b c", "b c", "c"] and len(starts) == 11


def word(rng):
    return "".join(rng.choices("abcdefghijklmnoprstu", k=rng.randint(2, 8)))


def edited(rng, item, share):
    letters = list(item)
    for k in rng.sample(range(len(letters)), int(len(item) * share)):
        letters[k] = rng.choice(("", letters[k] + "x", "y"))
    return "".join(letters)


@pytest.mark.parametrize(("words", "share", "least"), [
    ((1, 2), .2, 1.0), ((3, 3), .2, 1.0), ((4, 6), .2, 1.0), ((7, 11), .2, 1.0), ((12, 14), .2, 0.95), ((15, 20), .2, 0.9),
    ((21, 50), .2, 0.9), ((50, 80), .2, 0.98), ((3, 80), .1, 0.98)])
def test_recall_at_the_limit_of_edits(words, share, least):
    """Items with a fifth of their letters edited that are still within the limit."""
    rng = random.Random(3)
    items = [" ".join(word(rng) for _ in range(rng.randint(*words))) for _ in range(200)]
    texts, within = [], []
    for item in items:
        copy = edited(rng, item, share)
        texts.append(" ".join(word(rng) for _ in range(80)) + "\n" + copy.upper() + "!! " + word(rng))
        copy = " ".join(copy.split())
        within.append(decontaminate.infix_distance(item.encode(), copy.encode(), 999) <= len(item) // 5)
    hits = found(items, texts)
    assert sum(within) > 150
    recall = sum(k in hits[k] for k in range(200) if within[k]) / sum(within)
    print("recall", words, share, round(recall, 3))
    assert recall >= least


def test_short_items_are_found_as_by_trying_every_place(monkeypatch):
    """Every short item and text against the edit distance to every part of the text, repeated items included."""
    rng = random.Random(8)
    items = ["".join(rng.choices("ab c", k=rng.randint(1, 30))).strip() or "x" for _ in range(120)]
    items += ["w " + items[0], items[1], "!?", "", "\u4eba\u5de5\u667a\u80fd"]
    texts = ["".join(rng.choices("ab cd", k=rng.randint(0, 90))) for _ in range(60)] + ["", None, "a", "\u4eba\u5de5\u667a\u80fd"]
    texts += [edited(rng, " ".join(rng.choices(items, k=3)), .1) for _ in range(30)]

    def plain(text):
        codes, _ = decontaminate.normalized([(text or "").encode()])
        return bytes(codes).strip(b"\0")

    expected = [{i for i, item in enumerate(items)
                 if plain(item) and decontaminate.infix_distance(plain(item), plain(t), 99) <= int(.2 * len(plain(item)) + 1e-9)}
                for t in texts]
    assert found(items, texts) == expected
    assert sum(map(len, expected)) > 1_000
    monkeypatch.setattr(decontaminate, "MATCHES", 20)  # many short slices
    assert found(items, texts) == expected


def test_items_in_blocks_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(9)
    items = [" ".join(word(rng) for _ in range(rng.randint(3, 40))) for _ in range(30)]
    listed = spark.createDataFrame([*enumerate(items), (3, items[3]), (None, items[4]), (99, None)], "item_id long, text string")
    texts = [word(rng) + " " + edited(rng, items[k % 30], .05) for k in range(40)] + [None, "", "nothing here"]
    docs = spark.createDataFrame([(k % 41, t, "x") for k, t in enumerate(texts + texts[:5])], "doc_id long, text string, _text_key string")
    whole = sorted(decontaminate.contaminated(docs, listed).collect(), key=repr)
    kept = sorted(decontaminate.clean(docs, listed).collect(), key=repr)
    assert len(whole) >= 45 and len(kept) == 3
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 500)
    assert decontaminate._parts(listed)[1] > 5
    assert sorted(decontaminate.contaminated(docs, listed).collect(), key=repr) == whole
    again = decontaminate.clean(docs, listed)
    assert again.columns == docs.columns and sorted(again.collect(), key=repr) == kept


def test_pieces_at_the_end_of_a_slice():
    """The last bytes of a slice of 1,000,000 bytes, fewer than a piece, hold none."""
    for rest in range(6):
        text = "v" * (1_000_000 - 40 + rest)
        assert found(["kkkk oooo"], [text]) == [set()]
        assert found(["kkkk oooo"], [text + " kkkk oooo"]) == [{0}]
