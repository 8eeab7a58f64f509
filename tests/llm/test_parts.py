"""The parts of the operators that need no session, against libraries and plain versions."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from stagekin.llm import byte_bpe, decontaminate, embedding_dedup, html_text, jaccard_join, language_id, url_filter, warc
from stagekin.llm.components import smallest_reachable
from stagekin.llm.shingles import shingle_sets
from stagekin.llm.token_store import EliasFano, Shard, pack_shard
from stagekin.llm.word_tokens import WordEncoder

MIXED = st.text(st.sampled_from("ab'sdtrelmv \t\n\xa0\u2003\x1c\u0301éßÀª²0٣漢.,!?-_<|>İ"), max_size=60)


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        return byte_bpe.Codec(file.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = byte_bpe.read_ranks(file.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as file:
        return WordEncoder(file.read())


@settings(max_examples=150, deadline=None)
@given(st.lists(MIXED, max_size=5))
def test_byte_ids_equal_the_library(codec, library, texts):
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_ids_decode_to_the_text(codec):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        decoder = byte_bpe.Decoder(file.read())
    texts = ["a é漢\n 12", "", None]
    assert [decoder.decode(ids) for ids in codec.encode(texts)] == [(t or "").encode() for t in texts]
    assert decoder.decode(None) == b""


def test_long_matches_and_null(codec, library):
    texts = ["a" * 3000, "é" * 200 + "xy" * 300, " " * 70 + "z", None, ""]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text or "")


@settings(max_examples=150, deadline=None)
@given(st.lists(MIXED, max_size=5))
def test_word_ids_equal_the_library(words, texts):
    for text, ids in zip(texts, words.encode(texts), strict=True):
        assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=1500))
def test_elias_fano_selects(steps):
    values = np.cumsum(steps)
    coded = EliasFano.of(values, int(values[-1]))
    assert coded.all().tolist() == values.tolist()
    for i in range(0, len(values), 37):
        assert coded.select(i) == values[i]


def test_shard_round_trip():
    parts = [np.arange(n, dtype="<u2") for n in (3, 1, 0, 70)]
    shard = Shard(pack_shard([None, 5, 5, 9], parts, "<u2"))
    found = [(d, s, ids.tolist()) for d, s, ids in shard.documents()]
    assert found == [(None, 0, [0, 1, 2]), (5, 3, [0]), (5, 4, []), (9, 4, list(range(70)))]
    assert shard.select(3).tolist() == list(range(70))


def plain_distance(item: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=30))
def test_infix_distance(item, text):
    assert decontaminate.infix_distance(item.encode(), text.encode(), 99) == plain_distance(item, text)


@pytest.mark.parametrize(("edits", "least"), [(0.0, 1.0), (0.1, 0.97), (0.18, 0.9)])
def test_edited_items_are_found(edits, least):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstu", k=rng.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(rng.randint(15, 50))).capitalize() + ".") for k in range(60)]
    texts = []
    for _, item in items:
        letters = list(item)
        for _ in range(int(edits * len(item))):
            k = rng.randrange(len(letters))
            letters[k] = rng.choice(("", letters[k] + "x", "y"))
        texts.append(" ".join(word() for _ in range(80)) + "\n" + "".join(letters).upper() + "!! " + word())
    clean = [" ".join(word() for _ in range(300)) for _ in range(60)]
    found = decontaminate.Index(items, 0.8, decontaminate.REPEATS).find(texts + clean + [None, "", "!!"])
    assert np.mean([k in {i for i, _, _ in hits} for k, hits in enumerate(found[:60])]) >= least
    assert not any(found[60:])
    for k, hits in enumerate(found[:60]):
        for i, distance, similarity in hits:
            assert similarity >= 0.8 and (edits or i != k or distance == 0)


def test_trie_equals_trying_all_rules():
    rng = random.Random(1)
    piece = lambda: "".join(rng.choices("ab", k=rng.randint(0, 2)))
    host, path = lambda: ".".join(piece() for _ in range(rng.randint(1, 3))), lambda: "/" + "/".join(piece() for _ in range(2))
    for _ in range(200):
        rules = [(host(), path(), rng.choice(("allow", "block"))) for _ in range(6)]
        trie = url_filter.Trie(rules)
        for _ in range(20):
            h, p = host(), path()
            fits = [r for r in rules if (h == r[0] or h.endswith("." + r[0])) and p.startswith(r[1])]
            best = max(fits, key=lambda r: (r[0].count("."), len(r[0]), len(r[1]), r[2] == "block"), default=None)
            assert trie.find(h, p) == (best and (best[0] + best[1], best[2]))


def test_shingles_of_few_words_and_cases():
    one, two, three, none, null, short = shingle_sets(["A b C d e", "a B c D e ", "a b c", " \t\n", None, "a b"], 4)
    assert one.tolist() == two.tolist() and len(one) == 2
    assert len(three) == len(short) == 1 and three[0] != short[0] and not len(none) and not len(null)


def test_segments_agree_wherever_sets_link():
    """Linked sets share at least the keys asked for in the class of the larger one."""
    rng = np.random.default_rng(2)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop, add = rng.integers(0, n // 10 + 1), rng.integers(0, n // 10 + 1)
        other = np.unique(np.concatenate((rng.permutation(base)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64))))
        overlap = len(np.intersect1d(base, other))
        if not len(other) or 100 * overlap < 85 * (len(base) + len(other) - overlap):
            continue
        floors = jaccard_join.class_floors(1000)
        c = int(np.searchsorted(floors, max(len(base), len(other)), "right")) - 1
        (keys1, need1), (keys2, need2) = (jaccard_join.segment_keys(s, c, floors) for s in (base, other))
        assert len(np.intersect1d(keys1, keys2)) >= min(need1, need2)
        assert 100 * min(len(base), len(other)) >= 85 * floors[c] or min(len(base), len(other)) >= floors[c]


def test_reachable_nodes():
    nodes, root = smallest_reachable(np.array([5, 9, 7, 3]), np.array([9, 2, 3, 3]))
    assert dict(zip(nodes.tolist(), root.tolist(), strict=True)) == {2: 2, 5: 2, 9: 2, 3: 3, 7: 3}


def test_network_learns_and_und():
    rng = random.Random(4)
    rows = [(k % 2, "".join(rng.choices("abcd" if k % 2 else "wxyz", k=256)).encode()) for k in range(200)]
    data = np.frombuffer(b"".join(r for _, r in rows), np.uint8).reshape(-1, 256)
    network = language_id.Network(2).fit(data, np.array([k for k, _ in rows]), steps=60)
    assert (network.probabilities(data).argmax(1) == [k for k, _ in rows]).mean() > 0.98
    assert not language_id.has_letter("12 ²_ !?") and language_id.has_letter("1é")


def test_centres_are_unit_vectors():
    sample = embedding_dedup._unit(np.random.default_rng(0).normal(size=(50, 8)))
    assert np.allclose(np.linalg.norm(embedding_dedup.spherical_centres(sample, 4), axis=1), 1)


def test_blocks_of_a_page():
    page = ("<title>t</title><script>var a='<p>no</p>'</script><p>a &amp;lt; <b>b</b>\n c<br>d<p>e&nbsp;f"
            "<!-- <p>x</p> --><ul><li>g<li><a href='x>y'>h</a></ul>tail")
    assert [text for text, _, _ in html_text.leaf_blocks(page)] == ["a &lt; b c d", "e f", "g", "h", "tail"]
    assert html_text.leaf_blocks("") == [] and [t for t, _, _ in html_text.leaf_blocks("<p>  </p>< b")] == ["< b"]


def test_labeller_on_unseen_layouts():
    labeller = html_text.Labeller()
    labeller.weights = html_text.fitted()
    pages, labels = html_text.labelled_pages(120, seed=77)
    right = [(c > 0.5) == np.array(y) for c, y in zip(labeller.chances(pages), labels, strict=True)]
    assert np.concatenate(right).mean() > 0.97
    assert html_text.main_texts([None, "", "<html></html>"], labeller) == ["", "", ""]
    page = ("<body><nav><ul><li>Home</ul></nav><div class=cookie-banner>We use cookies</div><article><h1>Head</h1><p>One two "
            "three four five six.</p><p>Seven eight nine ten.</p></article><div id=comments><p>Great post</p></div>"
            "<footer>&copy; x</footer></body>")
    assert labeller and html_text.main_texts([page], labeller) == ["Head\nOne two three four five six.\nSeven eight nine ten."]


def test_warc_records():
    import io
    import zlib

    records = warc.capture_records(7, "http://a/\r\nb", b"body", None)
    assert len(records) == 3 and all(zlib.decompress(r, 31).startswith(b"WARC/1.1") for r in records)
    parsed = [warc._parse(m, True) for m in warc.members(io.BytesIO(b"".join(records)), 10)]
    assert [p[1] for p in parsed] == ["response", "request", "metadata"]
    assert parsed[0][7] == b"body" and parsed[0][4] == warc.sha1_base32(b"body") and parsed[1][2] == parsed[0][0]
