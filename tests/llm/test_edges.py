"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import llm_brute as brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from latencylab.llm import decontam, html_extract, jaccard_join, langid, line_dedup, lm, mixing, spotsigs, suffix_dedup, warc

LONG = "The quick brown fox jumps over the lazy dog, and it was a fine day for all of them in the end. " * 1
CLASH = ["'x' as score", "1 as n_lines", "2 as size", "'b' as block", "3 as n", "'t' as target", "'k' as _lines"]


def digest(*rows):
    return sorted(rows, key=str)


@pytest.fixture()
def odd(docs):
    """Every awkward row at once: null and empty texts, ids and sources, equal rows, one long text."""
    words = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
    return docs(
        (1, None), (2, ""), (3, "   \n\t"), (4, LONG * 3, "en", "s1"), (5, LONG * 3, "en", None), (5, LONG * 3, "en", None),
        (None, LONG * 2, None, "s2"), (None, None), (6, "a", None, "s1"), (7, words, "en", "s1"), (8, words, "en", "s2"), (9, "éß ñ\u0000 日本", "xx", ""),
        extra=CLASH,
    )


def test_suffix_dedup_edges(odd, docs):
    got = digest(*[tuple(r) for r in suffix_dedup.suffix_dedup(odd).collect()])
    rows = [(2**63 - 1 if r.doc_id is None else r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = digest(*[(None if r[0] == 2**63 - 1 else r[0], *r[1:]) for r in brute.suffix_dedup(rows)])
    assert got == want
    assert suffix_dedup.suffix_dedup(odd.limit(0)).count() == 0


def test_suffix_dedup_spans_and_kept_bytes(docs):
    s = "0123456789" * 6
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs((1, "a" + s), (2, s + "b" + s[:49]))).collect()}
    assert [tuple(x) for x in got[2].spans] == [(0, 60)] and bytes(got[2].kept).decode() == "b" + s[:49]
    assert got[1].spans == []


def test_language_id_edges(odd):
    model = langid.train(odd)
    assert model.langs == ["en", "xx"]
    got = langid.identify(odd, model)
    assert got.count() == odd.count() and "n_lines" in got.columns and got.schema["score"].dataType.simpleString() == "double"
    for r in got.collect():
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred in model.langs) == letters and (letters or (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True))
        assert 0 <= r.score <= 1
    nothing = langid.train(odd.filter("lang = 'none'"))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


def test_warc_edges(spark):
    rows = [(1, "u", "x"), (2, "u", None), (3, None, ""), (4, "u\n", "x"), (4, "v", "x"), (None, "u", "x"), (None, None, None), (5, "w", "é" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as payload")
    got = digest(*[tuple(r) for r in warc.archive_round_trip(pages).collect()])
    d = {h: warc.base32_sha1(h.encode()) for h in ("x", "", "é" * 300_000)}
    assert got == digest(
        (1, 1, d["x"], "response", None), (4, 1, d["x"], "revisit", 1), (4, 1, d["x"], "revisit", 1), (None, 1, d["x"], "revisit", 1),
        (2, 0, d[""], "response", None), (3, 0, d[""], "revisit", 2), (None, 0, d[""], "revisit", 2), (5, 600_000, d["é" * 300_000], "response", None),
    )
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    small = warc.read_archives(warc.write_archives(pages, min_bytes=1)).collect()
    assert {r.record_type for r in small if r.payload_digest == d[""]} == {"response"}
    urls = {r.url for r in small}
    assert {"u\n", None} <= urls


def test_warc_files(spark, tmp_path):
    pages = spark.range(300).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(concat('<p>', id % 7, '</p>'), 50) as html")
    archives = warc.write_archives(pages, archive_bytes=20_000)
    warc.save_files(archives, str(tmp_path / "w"))
    found = [warc.parse_record(r) for f in (tmp_path / "w").iterdir() for r in warc.read_archive(f.read_bytes())]
    assert sorted(r["page_id"] for r in found) == list(range(300))
    assert sum(r["record_type"] == "response" for r in found) == 7


def test_spotsigs_edges(odd, docs):
    got = spotsigs.compare_with_edits(odd)
    assert got.count() == odd.count()
    rows = got.collect()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    prints = {}
    for r in rows:
        assert r.doc_id is None or prints.setdefault(r.doc_id, r.fingerprint) == r.fingerprint
    assert prints[1] == prints[2] == "" and prints[4] == prints[5] != "" and prints[7] == prints[8]
    one = spotsigs.compare_with_edits(docs((1, "abcdef"))).collect()
    assert [(r.n_chars, r.edited_sha256) for r in one] == [(6, hashlib.sha256(b"abcdab").hexdigest())]
    assert spotsigs.compare_with_edits(odd.limit(0)).count() == 0


def test_spotsigs_null_ids_come_last_in_any_number_of_groups(docs):
    rows = docs(*[(i - 20, f"the story of number {i} is a long one to tell {i}") for i in range(40)], *[(None, f"the row without an id {i}") for i in range(3)])
    several = sorted(map(str, spotsigs.compare_with_edits(rows, group_bytes=300).collect()))
    assert several == sorted(map(str, spotsigs.compare_with_edits(rows).collect()))


def test_spotsigs_groups_do_not_change_the_result(documents):
    a = spotsigs.compare_with_edits(documents, group_bytes=5_000)
    b = spotsigs.compare_with_edits(documents)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_jaccard_join_edges(odd):
    got = digest(*[tuple(r) for r in jaccard_join.near_duplicates(odd).collect()])
    rows = odd.select("doc_id", "text").collect()
    n = {i: len(brute.shingles(r.text)) for i, r in enumerate(rows)}
    component = {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9}
    want = digest(*[
        (r.doc_id, n[i], component.get(r.doc_id, 4 if r.text else None)) for i, r in enumerate(rows)
    ])
    # both texts without an id repeat the sentence of 4 and 5; distinct shingles are the same
    assert len(brute.shingles(LONG * 2)) == len(brute.shingles(LONG * 3))
    assert got == want
    assert jaccard_join.near_duplicates(odd.limit(0)).count() == 0
    kept = jaccard_join.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 6, 7, 9, None}


def test_mixing_edges(odd):
    got = mixing.mix_documents(odd).collect()
    assert len(got) == odd.count()
    sizes = {}
    for r in odd.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
    want = brute.targets(sizes)
    assert {round(r.target, 6) for r in got} == {round(v, 6) for v in want.values()}
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert mixing.mix_documents(odd.limit(0)).count() == 0
    assert mixing.mixed_blocks(odd.limit(0)).count() == 0
    none = mixing.mix_documents(odd.filter("text is null")).collect()
    assert {(r["size"], r.target, r.taken) for r in none} == {(0, 0.0, 0)}


def test_line_dedup_edges(odd, docs):
    line = "This line stands in very many of the documents here"
    rows = [(i, f"{line}\nown {i}\n  {line.upper()}\t") for i in range(6)] + [(7, None), (8, ""), (9, "\n\n")] + [(None, line)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs(*rows, extra=["5 as n_lines", "'q' as _kept"])).collect()}
    assert got[0] == ("own 0", 3, 2) and got[5] == (rows[5][1], 3, 0)  # the largest keeps all its copies
    assert got[7] == got[8] == ("", 1, 0) and got[9] == ("\n\n", 3, 0) and got[None] == ("", 1, 1)
    twice = [(1, line)] * 9 + [(2, line)]  # one document nine times is still one document
    assert line_dedup.dedup_lines(docs(*twice)).filter("n_dropped > 0").count() == 0
    assert line_dedup.dedup_lines(odd).count() == odd.count() and line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_contained_items_edges(spark, odd, docs):
    items = spark.createDataFrame([(1, LONG), (1, LONG), (2, None), (3, ""), (None, "a"), (4, "word1x1 word2x2 word3x3 word4x4 word5x5 word6x6")], "item_id long, text string").selectExpr("*", "0 as doc_id")
    got = digest(*[tuple(r) for r in decontam.contained_items(odd, items).collect()])
    want = digest(*brute_pairs(odd, items))
    assert got == want and any(r[1] == 4 for r in got)
    assert decontam.contained_items(odd.limit(0), items).count() == decontam.contained_items(odd, items.limit(0)).count() == 0
    clean = decontam.decontaminate(odd, items)
    bad = [d.text for d in odd.collect() if list(brute_pairs(odd.limit(0).union(spark.createDataFrame([tuple(d)], odd.schema)), items))]
    want = sorted((str(d.doc_id), d.text or "") for d in odd.collect() if d.text not in bad)
    assert clean.columns == odd.columns and sorted((str(r.doc_id), r.text or "") for r in clean.collect()) == want


def brute_pairs(docs, items):
    for d in docs.collect():
        for i in items.collect():
            a, q = brute.shingles(d.text), brute.shingles(i.text)
            if q and 1000 * len(a & q) >= 750 * len(q):
                yield (d.doc_id, i.item_id, len(q), len(a & q), len(a & q) / len(q))


def test_lm_edges(odd, docs):
    got = lm.score_documents(odd).collect()
    assert len(got) == odd.count() and all(r.score <= 0 and r.base_score <= 0 for r in got)
    empty = [r for r in got if r.doc_id in (1, 2, 3)]
    assert {r.n_tokens for r in empty} == {1}
    assert lm.score_documents(odd.limit(0)).count() == 0
    held = [i for i in range(50) if lm.is_held_out(i)][:2]
    none = lm.score_documents(docs(*[(i, "some words") for i in held])).collect()
    assert [(r.base_score, r.score, r.n_known, r.train_tokens, r.n_tokens) for r in none] == [(0.0, 0.0, 0, 0, 3)] * 2


def test_lm_pairs_seen_once_count(docs):
    held = [i for i in range(50) if lm.is_held_out(i)][:2]
    learn = [i for i in range(50) if not lm.is_held_out(i)][:2]
    assert lm.levels(np.array([0, 1, 2])).tolist() == [0, 1, 2] and lm.LEVEL_COUNT[:3].tolist() == [0, 1, 2]
    rows = docs((learn[0], "alpha beta"), (learn[1], "gamma delta"), (held[0], "alpha beta"), (held[1], "alpha delta"))
    got = {r.doc_id: r for r in lm.score_documents(rows).collect()}
    assert got[held[0]].base_score == got[held[1]].base_score and got[held[0]].score > got[held[1]].score
    p = 1.5 / (6 + 0.5 * 6)  # a word seen once of 6 tokens, 5 words and one unseen
    start = (1 + 2 * p) / 4  # two words begin a document, once each
    inner = (1 + 1 * p) / 2
    end = (1 + 1 * 2.5 / 9) / 2
    assert np.isclose(got[held[0]].score, np.log10(start * inner * end), rtol=1e-6)


HOST = "http://h.example.com/"


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>"


@pytest.mark.parametrize("body, text", [
    ("<nav><a>Home</a></nav><article><h1>A &amp; B</h1><p>one\n two<br>three<p>four</article><footer>f</footer>", "A & B\none two three\nfour"),
    ("<div class='sidebar'>s</div><main><p>x</p><aside>y</aside><form><p>z</p></form><div class='cookie-notice'>c</div></main>", "x"),
    ("<article><p>t&eacute;xt&nbsp;&#8212; a<b>b</b>c <i>d</i></p><script>var x='</p>';</script><style>p{}</style></article>", "téxt — abc d"),
    ("<article>a<section id=comments><p>first!</p></section><div class='ad'>buy</div></article>", "a"),
    ("<header>Site</header><div id=content><p>Long enough text of the page.</p></div><ul class=menu><li>m</li></ul>", "Long enough text of the page."),
    ("<article><header><h1>T</h1></header><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><!-- no --><p>5 < 6 & 7</article>", "T\na\nb\nc\nd\n5 < 6 & 7"),
    ("", ""), ("<article></article>", ""), ("<p>unclosed <b>bold", "unclosed bold"),
])
def test_main_text(body, text):
    assert html_extract.main_text(page(body)) == text


@pytest.mark.parametrize("body, text", [
    ("<div class='main'><p>the longer part of the page</p></div><div class='box'><p>a shorter part</p></div>", "the longer part of the page\na shorter part"),
    ("<div><p>read <a>this long list of names</a></p></div>", "read this long list of names"),
])
def test_slots_without_boilerplate_evidence_stay(body, text):
    assert html_extract.main_text(page(body)) == text


def test_template_text_is_dropped_outside_articles(spark):
    rows = [(i, f"{HOST}{i}", page(f"<div><p>Welcome to our site</p><p>story number {i} with its own words</p></div>")) for i in range(20)]
    rows += [(20 + i, f"http://other.example.com/{i}", page("<div><p>Welcome to our site</p></div>")) for i in range(20)]  # equal pages are one page
    rows += [(40, None, None), (41, "not a url [", ""), (None, f"{HOST}1", rows[1][2]), (42, f"{HOST}1", rows[1][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as template", "1 as _host")
    got = [tuple(r) for r in html_extract.extract_main_text(pages).collect()]
    text = {r[0]: r[2] for r in got}
    assert len(got) == len(rows) and all(text[i] == f"story number {i} with its own words" for i in range(20))
    assert text[20] == "Welcome to our site" and text[40] == text[41] == "" and text[None] == text[42] == text[1]
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0
    limit, html_extract.BROADCAST_TOKENS = html_extract.BROADCAST_TOKENS, 0
    try:  # joined to the pages instead of broadcast
        assert sorted(map(str, html_extract.extract_main_text(pages).collect())) == sorted(map(str, [r for r in html_extract.extract_main_text(pages).collect()]))
        assert {tuple(r) for r in html_extract.extract_main_text(pages).collect()} == set(got)
    finally:
        html_extract.BROADCAST_TOKENS = limit


def test_template_text_is_dropped_inside_articles(spark):
    links = "<ul><li><a>more of</a><li><a>this kind</a></ul>"
    def body(i):
        commas = "<b>a</b> and " * (i % 3 + 1)
        return f"<article><h1>title {i}</h1><p>Read our app</p><p>{commas}<i>story {i}</i></p><p>Seen by <b>{i} readers</b></p><section>{links}</section></article><div>tail {i}</div>"

    rows = [(i, f"{HOST}{i}", page(body(i))) for i in range(20)]
    rows += [(20 + i, f"http://other.example.com/{i}", page(f"<main><p>Same on all</p></main><div><p>own words {i}</p></div>")) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r.page_id: r.text for r in html_extract.extract_main_text(pages).collect()}
    for i in range(20):
        assert text[i] == f"title {i}\n" + "a and " * (i % 3 + 1) + f"story {i}\n{i} readers"
        assert text[20 + i] == f"own words {i}"


def test_pipeline_stages_keep_the_columns_and_survive_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        for table in (odd, odd.limit(0)):
            out = stage(spark, table, brute.SF)
            assert name == "source_mixing" or out.columns == odd.columns, name
            assert out.count() >= 0 and (table is odd or out.count() == 0), name


def test_pipeline_against_a_plain_version(spark, documents):
    docs = {r.doc_id: r for r in documents.collect()}
    model = langid.train(documents)
    rejected = {r.doc_id for r in langid.identify(documents, model).collect() if r.rejected}
    kept = [(d, r.text) for d, r in sorted(docs.items()) if d not in rejected]
    kept = [(d, t) for d, t, _, _ in brute.line_dedup(kept)]
    first = {d for d, _, c in brute.components(kept) if d == c}
    kept = [(d, t) for d, t in kept if d in first]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{brute.SF}/benchmark.parquet").collect()]
    bad = {d for d, *_ in brute.contained(kept, items)}
    kept = {d: t for d, t in kept if d not in bad}
    got = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, brute.SF)
    rows = got.collect()
    assert {r.doc_id: r.text for r in rows} == kept
    assert all(r.n_chars == len(r.text) and r.source == docs[r.doc_id].source for r in rows)
    blocks = corpus_pipeline.run(spark, brute.SF)
    sizes = {}
    for d, t in kept.items():
        sizes[docs[d].source] = sizes.get(docs[d].source, 0) + len(brute.words(t))
    target = brute.targets(sizes)
    for r in blocks.groupBy("source").agg(F.sum("n_words").alias("n")).collect():
        assert abs(r.n - target[r.source]) <= corpus_pipeline.PACKED_WORDS
    assert {d for r in blocks.collect() for d in r.doc_ids} <= set(kept)
