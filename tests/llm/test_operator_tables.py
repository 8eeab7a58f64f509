"""Each operator on tables with nulls, empty and long texts, ties, repeated rows, no rows and clashing columns."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stagekin.llm import (
    byte_bpe, components, decontaminate, embedding_dedup, html_text, jaccard_join, language_id, queries, token_count,
    token_store, url_filter, warc,
)
from stagekin.llm.common import new_folder

LONG = " ".join(f"word{k}" for k in range(30_000))
COPY = " ".join(f"w{k}" for k in range(60))
TEXTS = [(1, "Ein Text mit Worten"), (2, None), (3, ""), (4, LONG), (5, COPY), (6, COPY.upper()), (6, COPY.upper()),
         (7, COPY + " more"), (None, COPY), (8, "123 !?"), (9, "a b"), (10, "a b"), (10, "x y z other text here")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "de", "s", 1, "clash", 0) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "node string, tile int")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def plain_components(texts, width=4, similar=85):
    """component_id by trying all pairs."""
    sets = []
    for _, text in texts:
        words = (text or "").lower().split()
        sets.append({tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))} if words else set())
    links = [(a, b) for b in range(len(texts)) for a in range(b) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b])]
    root = list(range(len(texts)))
    for _ in links:
        was = list(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if was == root:
            break
    ids = {}
    for k, (i, _) in enumerate(texts):
        ids.setdefault(root[k], []).append(i)
    return [(i, len(sets[k]), min((x for x in ids[root[k]] if x is not None), default=None) if sets[k] else i)
            for k, (i, _) in enumerate(texts)]


def test_jaccard_join(docs, nothing):
    found = jaccard_join.joined(docs)
    key = lambda row: repr(row)
    got = sorted((tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect()), key=key)
    assert got == sorted(plain_components(TEXTS), key=key)
    assert jaccard_join.joined(nothing).count() == 0
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 8, 9, 10]


def test_jaccard_join_families(spark):
    """Many near copies, spread over several tiles, against all pairs."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(260):
        words = [f"w{j}" for j in range(50)]
        for j in rng.integers(0, 50, int(rng.integers(0, 4))):
            words[j] = f"x{rng.integers(9)}"
        rows.append((k, " ".join(words)))
    found = jaccard_join.joined(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == sorted(plain_components(rows))


def test_jaccard_join_families_of_the_pipeline(spark):
    """Five words and 0.80: families that share long passages with each other but link only within."""
    rng = np.random.default_rng(8)
    common = [f"c{j}" for j in range(60)]
    rows = []
    for k in range(300):
        family = k % 12
        words = [f"f{family}w{j}" for j in range(90)]
        for j in rng.integers(0, 90, int(rng.integers(0, 5))):
            words[j] = f"x{rng.integers(9)}"
        rows.append((k, " ".join(words[:30] + common + words[30:])))
    found = jaccard_join.joined(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == sorted(
        plain_components(rows, 5, 80))


def test_own_columns_are_kept(spark, docs):
    """Columns of the input that have the names of inner ones."""
    clash = docs.withColumns({n: F.lit(n) for n in ("_id", "_hash", "_judged", "_predicted", "lang_pred", "score", "url")})
    for stage in (jaccard_join.one_of_each(clash), corpus_pipeline.known_language(spark, clash, "")):
        rows = stage.collect()
        assert stage.columns == clash.columns and rows
        assert all(r[n] == n for r in rows for n in ("_id", "_hash", "_predicted", "lang_pred", "score"))
    judged = url_filter.judged(clash, queries.URL_RULES)
    assert {r["_judged"] for r in judged.collect()} == {"_judged"}
    joined = url_filter.judged_by_join(clash, spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string"))
    assert {r["_judged"] for r in joined.collect()} == {"_judged"}
    assert {r["_predicted"] for r in queries.languages(clash).collect()} == {"_predicted"}


def test_components_of_a_path(spark):
    edges = spark.range(0, 300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).repartition(16)
    found = components.components(edges)
    assert found.count() == 301 and found.filter("component != 0").count() == 0
    assert components.components(edges.limit(0)).count() == 0


def test_embeddings(spark):
    near = [1.0, 0.1, 0.0]
    rows = [(1, [1.0, 0.0, 0.0], 1), (2, near, 1), (2, near, 1), (3, near, 2), (4, near, None), (5, None, 1),
            (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 0.0], 1), (8, [float("nan"), 0.0, 1.0], 1), (9, [], 1),
            (10, [0.0, 1.0], 1), (11, [1e-30, 1e-31, 0.0], 1), (None, [0.0, 0.0, 1.0], 1), (12, [0.0, -0.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cell", F.lit("x"))
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.deduplicated(df).collect())
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True),
                          (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True),
                          (10, 0, 10, True), (11, 3, 1, False), (0, 1, 12, False), (12, 1, 12, True)])
    assert embedding_dedup.deduplicated(df.limit(0)).count() == 0


def test_embeddings_against_all_pairs(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    vectors = np.array([r.embedding for r in rows], np.float64)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = np.array([r.label for r in rows])
    linked = (vectors @ vectors.T >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(linked, False)
    want = {r.vec_id: int(n) for r, n in zip(rows, linked.sum(1), strict=True)}
    found = queries.op2_embedding_dedup(spark, folder).collect()
    assert {r.vec_id: r.n_links for r in found} == want


def test_byte_ids(spark, docs, nothing, folder):
    assert queries.byte_tokens(nothing).count() == 0
    with open(public_tokenizers.path(queries.BYTE_FILE), "rb") as file:
        ranks = byte_bpe.read_ranks(file.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for row in queries.byte_tokens(docs).collect():
        assert np.frombuffer(row.ids, "<u4").tolist() == library.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for row in queries.op6_byte_bpe(spark, folder).collect():
        ids = library.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def expected_files(rows):
    library = Tokenizer.from_file(public_tokenizers.path(queries.WORD_FILE))
    library.encode_special_tokens = True
    start, found = 0, []
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        found.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return found


def test_token_files(spark, docs, nothing, folder):
    source = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.op7_token_files(spark, folder).collect())
    assert got == expected_files(sorted((r.doc_id, r.text) for r in source))
    path = queries.vocabulary(queries.WORD_FILE)
    for table, shard_ids in ((docs, 50), (nothing, 50)):
        at = new_folder(spark, "test")
        rows = token_store.read(token_store.write(table, at, path, 1, shard_ids), at).orderBy("start").collect()
        assert [r.doc_id for r in rows] == sorted((r.doc_id for r in table.collect()), key=lambda i: (i is not None, i or 0))
        assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()


def test_token_counts(spark, docs, nothing):
    path, args = queries.vocabulary(queries.WORD_FILE), (queries.WORD_SEPARATOR, queries.WORD_IDS)
    want = sorted(((i or 0), n - 1) for i, _, n, _ in expected_files(TEXTS))
    found = token_count.document_counts(docs, new_folder(spark, "test"), path, *args)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found.collect()) == want
    assert token_count.document_counts(nothing, new_folder(spark, "test"), path, *args).count() == 0
    at = new_folder(spark, "test")
    listed = token_count.write_flat(docs.coalesce(1), at, path, queries.WORD_SEPARATOR)
    files = listed.select("file").distinct()
    for block in (1, 7, 1000):  # documents that span many blocks, blocks without separator
        counted = token_count.counts(token_count.separators(files, at, queries.WORD_SEPARATOR, "<u2", block))
        rows = listed.join(counted, ["file", "ordinal"]).collect() if block > 1 else []
        assert block == 1 or sorted((r.doc_id or 0, r.n_tokens) for r in rows) == want
    found = token_count.separators(files, at, queries.WORD_SEPARATOR, "<u2")
    assert token_count.unended(files, found, at, "<u2").count() == 0


def test_language(spark, docs, nothing, folder):
    rows = queries.op1_language_id(spark, folder).join(
        spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)
    found = {r.doc_id: r for r in queries.languages(docs).collect()}
    assert [found[i].lang_pred for i in (2, 3, 8)] == ["und"] * 3 and found[1].lang_pred == "de"
    assert queries.languages(nothing).count() == 0
    assert language_id.predicted(docs, ([], {})).filter("lang_pred != 'und'").count() == 0


def test_contamination(spark, docs, nothing):
    items = spark.createDataFrame([(1, COPY), (2, None), (3, "!!"), (4, COPY), (None, "w1 w2 w3 w4 w5 w6 w7")],
                                  "item_id long, text string")
    found = decontaminate.contaminated(docs, items).collect()
    assert {r.doc_id for r in found} == {5, 6, 7, None} and {r.item_id for r in found} == {1, 4, None}
    assert len(found) == 15  # five rows, three items
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [1, 2, 3, 4, 8, 9, 10, 10]
    assert decontaminate.clean(docs, items.limit(0)).count() == len(TEXTS)
    assert decontaminate.contaminated(nothing, items).count() == 0


def test_urls(spark):
    urls = [(1, "http://A.Example.ORG/en/12?x"), (2, "ftp://com/de/"), (3, None), (4, "no scheme"), (5, "x://"),
            (6, "http://org"), (7, "http://example.org/es"), (8, "http://u.com/fr/#/a://b"), (1, "http://x.net/a")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumns({"rule": F.lit(1), "host": F.lit("h")})
    found = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages, queries.URL_RULES).collect()}
    assert found == {
        (1, "a.example.org", "/en/12", "example.org/en/1", "block"), (2, "com", "/de/", "com/de/", "block"),
        (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "org", "", None, "allow"),
        (7, "example.org", "/es", "org/", "allow"), (8, "u.com", "/fr/", "com/fr/", "allow"),
        (1, "x.net", "/a", None, "allow")}
    joined = url_filter.judged_by_join(pages, spark.createDataFrame(
        queries.URL_RULES, "host string, path string, verdict string"))
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in joined.collect()} == found


def test_html(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "plain"), (4, "<article><p>a b</article>")],
                                  "page_id long, html string").withColumn("text", F.lit(1))
    found = {r.page_id: r.text for r in html_text.extracted(pages).collect()}
    assert found[1] == found[2] == "" and found[4] == "a b"
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_html_of_the_pages(spark, folder):
    """The article of each page, cut out by its tags."""
    import html
    import re

    for row in queries.op9_html_text(spark, folder).join(
            spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.split("</article>|<footer", row.html.split("<article>")[1])[0]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split())
                 for p in re.split("</?(?:h1|p)>", article))
        assert row.text == "\n".join(p for p in parts if p) and row.n_chars == len(row.text)


def test_warc(spark):
    rows = [(1, "http://a/", "x"), (2, "http://b/", "x"), (2, "http://b/", "x"), (3, None, None), (4, "u\r\nv", ""),
            (None, "n", "x"), (None, "m", "alone"), (5, "c", "big é" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("original", F.lit(1))
    found = warc.round_trip(pages, with_payload=True)
    got = [(r.metadata.fields["pageId"], r.capture.record_type, r.metadata.fields.get("refersToPageId")) for r in found.collect()]
    assert sorted(got) == sorted([("1", "revisit", "2"), ("2", "response", None), ("2", "response", None),
                                  ("3", "revisit", "4"), ("4", "response", None), ("", "revisit", "2"),
                                  ("", "response", None), ("5", "response", None)])
    payload = {r.metadata.fields["pageId"]: r.capture.payload for r in found.collect()}
    assert bytes(payload["5"]).decode() == "big é" * 50_000
    least = warc.round_trip(pages, least=2).filter("capture.record_type = 'revisit'")
    assert least.count() == 0
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {r.doc_id: r for r in corpus_pipeline.pipeline(spark, folder).collect()}
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {i for i, n, c in plain_components(texts, corpus_pipeline.WORDS, corpus_pipeline.SIMILAR) if i == c or not n}
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hits = decontaminate.Index(benchmark, decontaminate.SIMILAR, decontaminate.REPEATS).find([t for _, t in texts])
    leaked = {i for (i, t), h in zip(texts, hits, strict=True) if h}
    exact = {i for i, t in texts if any(" ".join(b.split()) in " ".join((t or "").split()) for _, b in benchmark)}
    assert exact <= leaked
    assert set(found) == kept - leaked  # all of these are of a known language
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "byte_bpe"]
