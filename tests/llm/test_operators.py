"""Each operator against a plain Python version on the smallest whole tables."""

import hashlib
import math
import random

import llm_brute as brute
import numpy as np
import pyarrow as pa
from llm_brute import SF
from pyspark.sql import functions as F

from latencylab.llm import decontam, html_extract, jaccard_join, langid, line_dedup, lm, mixing, queries, spotsigs, suffix_dedup, warc
from latencylab.llm import text as tx


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def vocabulary(n, seed=0):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7))) for _ in range(n)]


def test_words_and_shingles_agree_with_python():
    texts = ["", None, " \t", "One two  THREE", "a b c d e f", "É ß x y\u0085z", "x" * 300_000 + " y", "a b c d e a b c d e"]
    got = list(tx.text_shingle_sets(pa.array(texts)))
    assert [len(s) for s in got] == [len(brute.shingles(t)) for t in texts]
    h, first = tx.word_hashes(*tx.flat(pa.array(texts)))
    assert np.diff(first).tolist() == [len(brute.words(t)) for t in texts]
    names = [w for t in texts for w in brute.words(t)]
    assert len(set(names)) == len(set(h.tolist())) and all((h[i] == h[j]) == (names[i] == names[j]) for i in range(len(h)) for j in range(len(h)))


def test_suffix_dedup(documents):
    assert rows(suffix_dedup.suffix_dedup(documents)) == brute.suffix_dedup(pairs(documents))


def test_suffix_dedup_random_overlaps(docs):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("ab ") for _ in range(400)) for _ in range(4)]
    made = []
    for i in range(60):
        parts = [b[(a := rnd.randint(0, 300)) : a + rnd.randint(30, 120)] for b in rnd.choices(base, k=4)]
        made.append((rnd.randint(0, 10**6) * 60 + i, "é".join(parts) + "z" * rnd.choice([0, 0, 49, 50, 51, 200])))
    assert rows(suffix_dedup.suffix_dedup(docs(*made))) == brute.suffix_dedup(made)


def test_previous_smaller_is_the_definition():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 50, 300):
        v, first = rnd.integers(0, 6, n), np.repeat(np.arange(0, n, 25), 25)[:n]
        want = [max([j for j in range(first[i], i) if v[j] < v[i]], default=-1) for i in range(n)]
        assert suffix_dedup.previous_smaller(v, first).tolist() == want


def test_language_id_on_held_out_documents(spark, documents):
    got = langid.lang_id(spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet"))
    truth = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang")
    held = [r for r in got.join(truth, "doc_id").collect() if r["held_out"]]
    assert len(held) > 200
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    assert sum(r["rejected"] for r in held) <= 0.01 * len(held)


def test_language_prediction_reads_only_the_text(documents):
    model = langid.train(documents)
    a = rows(langid.identify(documents.select("doc_id", "text"), model), "doc_id", "lang_pred", "score")
    b = rows(langid.identify(documents.withColumns({"lang": F.lit("xx"), "source": F.lit("y")}), model), "doc_id", "lang_pred", "score")
    assert a == b


def test_warc_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    twice = pages.unionAll(pages.selectExpr("page_id + 1000", "url", "html"))
    got = {r["page_id"]: r for r in warc.archive_round_trip(twice).collect()}
    first = {}
    for r in sorted(twice.collect(), key=lambda r: r["page_id"]):
        b = (r["html"] or "").encode()
        ref = first.setdefault(b, r["page_id"])
        x = got[r["page_id"]]
        assert (x["payload_bytes"], x["payload_digest"]) == (len(b), warc.base32_sha1(b))
        assert (x["record_type"], x["refers_to"]) == (("response", None) if ref == r["page_id"] else ("revisit", ref))
    assert len(got) == twice.count()


def test_warc_archive_is_a_dictionary_frame_and_single_records(tmp_path):
    recs = [warc.record(i, f"http://h/{i}", b"<p>page %d of the same site</p>" % i * 20) for i in range(200)]
    blob = warc.archive(recs)
    assert blob[:4] == bytes.fromhex("5d2a4d18") and list(warc.read_archive(blob)) == recs
    assert len(blob) < len(warc.archive(recs[:3])) * 70
    assert list(warc.read_archive(warc.archive(recs[:1]))) == recs[:1]
    got = warc.parse_record(warc.record(None, "http://h/%\r\n x", b"", refers_to=4, is_revisit=True))
    assert got["url"] == "http://h/%\r\n x" and got["page_id"] is None and got["record_type"] == "revisit"


def test_spotsigs_of_edits_and_next_documents(documents):
    got = spotsigs.compare_with_edits(documents, group_bytes=20_000).collect()
    order = sorted(pairs(documents), reverse=True)
    text = dict(order)
    following = {d: order[(i + 1) % len(order)][0] for i, (d, _) in enumerate(order)}
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert len(got) == len(order)
    sets = lambda p: {p[i : i + 8] for i in range(0, len(p), 8)}
    jac = lambda a, b: len(sets(a) & sets(b)) / len(sets(a) | sets(b)) if a or b else 1.0
    for r in got:
        t, n = text[r["doc_id"]], text[following[r["doc_id"]]]
        k = len(t) // 3
        edited = t[: len(t) - k] + n[:k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert math.isclose(r["near_edited"], jac(r["fingerprint"], r["edited_fingerprint"]))
        assert math.isclose(r["near_next"], jac(r["fingerprint"], prints[following[r["doc_id"]]]))
    by_text = {}
    for r in got:
        assert by_text.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    long = [r for r in got if r["n_chars"] > 400]
    assert np.mean([r["near_edited"] for r in long]) > 0.35 and np.mean([r["near_next"] for r in long]) < 0.1


def test_spotsigs_near_duplicates(docs):
    made = [(i, t) for i, t in near_copies(25, 11)]
    sets = {i: {int(x) for x in next(spotsigs.spot_sets(pa.array([t])))} for i, t in made}
    want = brute.linked({i: frozenset(s) for i, s in sets.items()})
    assert rows(spotsigs.near_duplicates(docs(*made))) == want
    assert len({c for *_, c in want}) < len(want)


def test_pruned_likeness_keeps_what_reaches_the_threshold():
    rnd = np.random.default_rng(0)
    for _ in range(200):
        a, b = (np.unique(rnd.integers(0, 60, rnd.integers(0, 60))) for _ in range(2))
        exact = spotsigs.likeness(a, b)
        assert spotsigs.likeness(a, b, 0.4) in (exact, 0.0) and (exact < 0.4 or spotsigs.likeness(a, b, 0.4) == exact)


def test_jaccard_join(documents):
    assert rows(jaccard_join.near_duplicates(documents)) == brute.components(pairs(documents))


def near_copies(n, seed=5):
    """Documents in chains and clusters of edits around the threshold."""
    rnd = random.Random(seed)
    vocab = vocabulary(200, seed)
    made = []
    for c in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(3, 60))]
        for _ in range(rnd.choice([1, 2, 5, 12])):
            made.append(" ".join(w))
            w = list(w)
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            w = w + [rnd.choice(vocab)] * rnd.choice([0, 0, 1])
    rnd.shuffle(made)
    return [(i * 7, t) for i, t in enumerate(made)]


def test_jaccard_join_of_edit_chains(docs):
    made = near_copies(40)
    assert rows(jaccard_join.near_duplicates(docs(*made))) == brute.components(made)


def test_jaccard_join_splits_large_regions(docs):
    made = near_copies(12, 9)
    want = brute.components(made)
    for limit in (3, 8):
        assert rows(jaccard_join.near_duplicates(docs(*made), max_region=limit)) == want


def test_region_links_by_voronoi_cells():
    rnd = random.Random(2)
    for trial in range(15):
        sets = []
        for c in range(rnd.randint(2, 9)):
            base = set(rnd.sample(range(400), rnd.randint(5, 50)))
            for _ in range(rnd.randint(1, 15)):
                sets.append(np.array(sorted(base), np.uint64))
                base = (base - set(rnd.sample(sorted(base), min(len(base) - 2, rnd.randint(0, 3))))) | set(rnd.sample(range(400), rnd.randint(0, 3)))
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        def label(links):
            parent[:] = range(len(sets))
            for a, b in links:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
            return [find(i) for i in range(len(sets))]

        every = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(s := set(sets[i].tolist()) & set(sets[j].tolist())) >= 75 * (len(sets[i]) + len(sets[j]) - len(s))]
        got = jaccard_join.region_links(sets)
        assert {(max(a, b), min(a, b)) for a, b in got} <= set(every)
        assert label(got) == label(every)


def test_mixing_targets_and_taken(documents):
    got = mixing.mix_documents(documents).collect()
    text = {r["doc_id"]: r for r in documents.collect()}
    sizes = {}
    for r in text.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    want = brute.targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        d = text[r["doc_id"]]
        assert r["size"] == len(brute.words(d["text"])) and r["source_size"] == sizes[d["source"]]
        assert math.isclose(r["target"], want[d["source"]], rel_tol=1e-9) and r["taken"] <= 2 * r["size"]
        taken[d["source"]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= mixing.BLOCK
    assert rows(mixing.mix_documents(documents.repartition(3))) == sorted(map(tuple, got))


def test_mixed_blocks_hold_what_is_taken(documents):
    mix = mixing.Mix(documents, block=32, text=True)
    taken = {r["doc_id"]: r["taken"] for r in mix.document_taken().collect()}
    blocks = mix.blocks().collect()
    assert sum(b["n_words"] for b in blocks) == sum(taken.values())
    words = {d: brute.words(t) for d, t in pairs(documents)}
    assert all(len(brute.words(b["text"])) == b["n_words"] <= 32 for b in blocks)
    for b in blocks[:200]:
        assert set(brute.words(b["text"])) <= set().union(*(words[d] for d in b["doc_ids"]))
    assert len({(b["source"], b["slot"]) for b in blocks}) == len(blocks)


def test_block_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000):
        p = mixing._permute(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(p.tolist()) == list(range(n))


def test_line_dedup(documents):
    got = rows(line_dedup.dedup_lines(documents), "doc_id", "text", "n_lines", "n_dropped")
    assert got == sorted(brute.line_dedup(pairs(documents)))


def test_line_dedup_is_native(documents):
    plan = line_dedup.line_dedup_digest(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_contained_items(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute.contained(pairs(documents), [(r["item_id"], r["text"]) for r in items.collect()])
    assert rows(decontam.contained_items(documents, items)) == want
    assert rows(decontam.contained_items(documents, items, max_shingles=100)) == want  # several passes


def test_lm_base_score_and_counts(documents):
    got = lm.score_documents(documents).collect()
    want = {r[0]: r for r in brute.unigram(pairs(documents))}
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[1:5]
        assert math.isclose(r["base_score"], w[5], rel_tol=1e-9, abs_tol=1e-9)
        assert r["score"] <= 0
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_filter_in_parts_scores_alike(documents):
    whole = {r["doc_id"]: r for r in lm.score_documents(documents).collect()}
    parts = {r["doc_id"]: r for r in lm.score_documents(documents, filter_bytes=200).collect()}
    assert whole.keys() == parts.keys()
    for d, r in whole.items():
        assert all(math.isclose(r[c], parts[d][c], rel_tol=1e-9) for c in ("base_score", "score", "n_tokens", "n_known"))


def test_log_frequency_filter_returns_levels():
    rnd = np.random.default_rng(4)
    keys = tx.mix(np.arange(1, 20_001, dtype=np.uint64))
    counts = rnd.zipf(1.6, 20_000).astype(float)
    f = lm.Filter(1, {0: lm.build_slice(keys, counts)})
    got = f.level(keys, np.zeros(len(keys), int))
    assert (got >= lm.levels(counts)).all() and (got > lm.levels(counts)).mean() < 0.05
    absent = f.level(tx.mix(keys + np.uint64(10**9)), np.zeros(len(keys), int))
    assert (absent > 0).mean() < 0.05


def expected_article(page):
    import html
    import re

    m = re.search(r"<article>(.*?)(?:</article>|<footer|$)", page, re.S)
    blocks = re.split(r"</?(?:h1|h2|p)\b[^>]*>", m[1]) if m else []
    out = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br\s*/?>", " ", b).replace("<b>", "").replace("</b>", ""))).strip() for b in blocks]
    return "\n".join(b for b in out if b)


def test_html_extraction_of_the_article(spark):
    pages = spark.read.parquet(SF.replace("0.001", "0.01") + "/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract_main_text(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == expected_article(r["html"]), r["page_id"]
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_queries_run_on_the_smallest_tables(spark):
    for name, query in queries.queries().items():
        assert query(spark, SF).count() > 0, name
