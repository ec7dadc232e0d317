"""Multi-index search, importance resampling and collocations against plain Python versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import llm_brute as brute
import numpy as np
import xxhash
from llm_brute import SF
from pyspark.sql import functions as F

from latencylab.llm import collocations, importance, multi_index


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


# -- inverted multi-index ----------------------------------------------------------------


def nearest(rows, k=5, every=50):
    """{query position: [(vec_id, score)]} over (id, vector) rows."""
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, v) in enumerate(ok):
        if i is not None and i % every == 0:
            scores = [(-float(v @ w) / np.linalg.norm(v) / np.linalg.norm(w), math.inf if j is None else j) for b, (j, w) in enumerate(ok) if b != a]
            out.append((i, [(j, -s) for s, j in sorted(scores)[:k]]))
    return sorted(out, key=lambda x: x[0])


def search(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in multi_index.nearest_neighbours(df, **options).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in got.items()}


def test_multi_index_recall_and_scores(spark):
    df = spark.read.parquet(SF.replace("0.001", "0.1") + "/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = dict(nearest(rows))
    got = defaultdict(list)
    for r in multi_index.nearest_neighbours(df.withColumn("id", F.lit("x"))).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    vec = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in rows}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == [1, 2, 3, 4, 5]
        assert all(abs(vec[q] @ vec[v] - s) < 1e-12 and v != q for _, v, s in found)
        assert all(a[2] >= b[2] for a, b in zip(found, found[1:]))
        hits += len({v for _, v, _ in found} & {v for v, _ in want[q]})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_multi_index_regions_and_large_cells_lose_nothing(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1, 6))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base + rng.normal(size=(200, 6)) * 1e-3, rng.normal(size=(300, 6))]))]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    want = dict(nearest(rows))
    got = search(spark, rows, recall=1.0, calibration=10**6, region_bytes=8 * 6 * 20)
    for q, found in got.items():
        assert [round(s, 9) for _, _, s in found] == [round(s, 9) for _, s in want[q]]
        assert {v for _, v, _ in found} == {v for v, _ in want[q]}
    assert got.keys() == want.keys()


def test_multi_index_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in (0, 50, 50, 3, 4, 5, 6, 7, 8)] + [(100, [3.0, 1.0, 0.0]), (101, [2.0, 1.0, 0.5]), (None, [0.0, 0.0, -1.0])]
    odd = [(150, None), (200, []), (250, [0.0, 0.0, 0.0]), (300, [1.0, None, 2.0]), (350, [nan, 1.0, 1.0]), (400, [inf, 1.0, 0.0]), (450, [1.0, 2.0])]
    got = search(spark, rows + odd)
    assert set(got) == {0, 50, 100}
    assert [(v, s) for _, v, s in got[0]] == [(3, 1.0), (4, 1.0), (5, 1.0), (6, 1.0), (7, 1.0)]
    # two rows with one id and vector: each has the other as a neighbour
    assert sorted(v for _, v, _ in got[50]) == sorted([0, 3, 4, 5, 6] * 2)
    assert got[100][0][1] == 101
    few = search(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (None, [-1.0, 0.0])])
    assert [v for _, v, _ in few[0]] == [1, None] and search(spark, [(0, [1.0])]) == {} and search(spark, []) == {}


def test_walk_is_in_order_of_summed_distances():
    rng = np.random.default_rng(0)
    books = multi_index.Codebooks(multi_index._unit(rng.normal(size=(500, 7))), 9)
    a, b = books.half_distances(multi_index._unit(rng.normal(size=(1, 7))))
    cells = list(books.walk(a[0], b[0]))
    total = (a[0][:, None] + b[0][None]).ravel()
    assert sorted(cells) == list(range(81)) and np.allclose(total[cells], np.sort(total))


# -- importance resampling ---------------------------------------------------------------

NGRAM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n=1):
    w = NGRAM_WORD.findall((text or "").translate(brute.UP))
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)


def resampled(docs, target, percent=10, least=20, n=1, buckets=10_000):
    b = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(b(f) for _, t in docs for f in features(t, n)[0])
    t = Counter(b(f) for x in target for f in features(x, n)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = {i: math.floor(1000 * math.log((t[i] + 1) * (S + buckets) / ((s[i] + 1) * (T + buckets)))) for i in range(buckets)}
    rows = []
    for d, text in docs:
        f, words = features(text, n)
        weight = sum(gain[b(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1], r[2]))
    wanted = len(fit) * percent // 100
    drawn = [(*r[:4], i + 1) for i, r in enumerate(fit[:wanted])]
    return drawn + [(*r[:4], None) for r in fit[wanted:]] + [(*r[:4], None) for r in rows if r[4] < least]


def ranked(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_importance_resampling(spark, documents):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    items = [r["text"] for r in target.collect()]
    assert as_set(importance.resample(documents, target)) == ranked(resampled(docs, items))
    got = importance.resample(documents, target, percent=37, min_words=3, max_n=3, buckets=97)
    assert as_set(got) == ranked(resampled(docs, items, 37, 3, 3, 97))


def test_importance_odd_rows(spark, docs):
    text = "One two; three-four FIVE été 漢字 " * 5
    made = [(1, None), (2, ""), (3, text), (3, text), (None, text), (None, text), (4, "x" * 100_000 + " " + text), (5, " ".join(map(str, range(30))))]
    target = spark.createDataFrame([(text,), (None,)], "text string")
    for percent in (0, 50, 100):
        got = importance.resample(docs(*made, extra=["1 as score", "'r' as rank"]), target, percent=percent)
        assert as_set(got) == ranked(resampled(made, [text, None], percent))
    assert importance.resample(docs(), target).count() == 0
    nothing = importance.resample(docs(*made), target.limit(0), percent=50)
    assert as_set(nothing) == ranked(resampled(made, [], 50))


def test_interning_verifies_bytes():
    names = [("x" * (i % 45) + str(i % 70)).encode() for i in range(2000)]
    buf = np.frombuffer(b"".join(names), np.uint8)
    ends = np.cumsum([len(n) for n in names])
    spans = importance.Spans(buf, ends - [len(n) for n in names], ends)
    assert spans.hashes().tolist() == [xxhash.xxh64_intdigest(n) for n in names]
    for broken in (False, True):
        if broken:  # all keys collide: only the bytes tell n-grams apart
            spans.hashes = lambda: np.zeros(len(names), np.uint64)
        table = importance.Interned(spans, 1000)
        slots = dict(zip(names, table.slot.tolist()))
        assert len(set(slots.values())) == len(slots) and [slots[n] for n in names] == table.slot.tolist()
        assert all(table.bucket[s] == zlib.crc32(n) % 1000 and table.count[s] == names.count(n) for n, s in slots.items())


# -- collocations ------------------------------------------------------------------------


def mined(docs, least=10, low=2, high=3, covered=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.UP)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, high + 1):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) >= low and a >= least}
        rows = []
        for p, a in cand.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if any(len(q) > len(p) and 100 * c >= covered * a and inside(q) for q, c in cand.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (score, a, p, l, r) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def test_collocations(documents):
    docs = [(r["text"], r["lang"]) for r in documents.collect()]
    assert sorted(map(tuple, collocations.top_collocations(documents).collect())) == mined(docs)
    # many shards, texts cut between pieces; other limits
    got = collocations.top_collocations(documents, top=50, min_count=4, max_words=4, covered=80, shard_bytes=4000)
    assert sorted(map(tuple, got.collect())) == mined(docs, 4, 2, 4, 80, 50)


def test_collocations_of_pieces_longer_than_a_shard(docs):
    rnd = random.Random(1)
    vocab = ["a", "bb", "Éé", " x", "d\x00", "eeeeeeeeeeeeeeeeeeeeee"]
    made = [(i, " ".join(rnd.choice(vocab) for _ in range(400)) + rnd.choice([".", "\n", "!", ""]), rnd.choice([None, "und", "l1", ""])) for i in range(12)]
    made += [(99, "z" * 5000 + " a bb", "l1"), (98, None, "l1"), (97, "", "l2"), (96, " \t.,\n", None), (95, "a bb", None), (95, "a bb", None)]
    for size in (64, 700):
        for words in (2, 3, 5):
            got = collocations.top_collocations(docs(*made, extra=["1 as phrase", "2 as n"]), min_count=3, max_words=words, shard_bytes=size)
            assert sorted(map(tuple, got.collect())) == mined([(t, lang) for _, t, lang in made], 3, 2, words)
    assert collocations.top_collocations(docs()).count() == 0


def test_index_intervals_hold_the_counts():
    rng = np.random.default_rng(5)
    seq = np.concatenate([[0], rng.integers(0, 6, 400), [0]]).astype("<i4")
    shard = collocations.Shard(seq, 6, 4)
    text = seq.tolist()
    level = shard.single_words()
    for step in (shard.to_right, shard.to_left, shard.to_right):
        level = step(level)
        m = level.words.shape[1]
        want = Counter(tuple(text[i : i + m]) for i in range(len(text) - m + 1) if 0 not in text[i : i + m])
        assert {tuple(w): c for w, c in zip(level.words.tolist(), level.count.tolist())} == dict(want)


def test_cut_texts_add_up():
    data = ("word one, two three " * 30 + "x y z " * 50).encode()
    total = Counter()
    for part, weight in collocations.cut_text(data, 90, 2):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", part.decode()):
            w = piece.split()
            for m in (1, 2, 3):
                for i in range(len(w) - m + 1):
                    total[" ".join(w[i : i + m])] += weight
    want = Counter()
    for piece in data.decode().split(","):
        w = piece.split()
        for m in (1, 2, 3):
            for i in range(len(w) - m + 1):
                want[" ".join(w[i : i + m])] += 1
    assert +total == want


# -- HTML extraction: names are evidence, broken pages are read in linear time ---------------


def test_html_names_are_evidence_not_verdicts():
    from latencylab.llm.html_extract import main_text

    body = "<p>" + "Some long running text of the article. " * 5 + "</p>"
    text = ("Some long running text of the article. " * 5).strip()
    kept = {
        "<article><header class='entry-header'><h1>Title</h1></header>%s</article>": "Title\n",
        "<div class='post'><div class='post-header'><h1>Title</h1></div>%s</div>": "Title\n",
        "<div id='content'><h2 class='social-history'>Title</h2>%s</div>": "Title\n",
        "<div id='content'><div class='side-effects'><p>Nausea</p></div>%s</div>": "Nausea\n",
        "<div id='content'><div class='reply-to-critics'>Well</div><p class='form'>A form</p>%s</div>": "Well\nA form\n",
        "<div class='search-results'><article><h1>Title</h1>%s</article></div>": "Title\n",
        "<article><p>Let <math><mi>x</mi></math> be.</p>%s</article>": "Let x be.\n",
    }
    for page, first in kept.items():
        assert main_text(page % body) == first + text, page
    beside = "<div id='content'>" + body * 3 + "</div><article class='card'>teaser</article>"
    assert text in main_text(beside)
    gone = ["<div class='site-header'>x</div>", "<div class='cookie-notice'>x</div>", "<ul class='mainMenu'><li>x</ul>", "<div id='comments'><article class='comment'>x</article></div>",
            "<div class='ad-slot-2'>x</div>", "<div class='related-posts'><article>x</article></div>", "<section class='newsletter-signup'>x</section>", "<div class='sidebar'>x</div>"]
    for junk in gone:
        assert main_text(f"<div id='content'>{body}</div>{junk}") == text, junk


def test_html_of_thousands_of_open_elements_is_linear():
    import time
    import tracemalloc

    from latencylab.llm.html_extract import main_text, parse

    n = 50_000
    pages = ["<div class='a'>" * n + "x", "<b>" * n + "</i>" * n + "x", "<b>" * n + "<hr>" * n + "x", "<u>" * n + "</b>" * n, "<blockquote><p>y" * (n // 10), "<p><b>" * n,
             "<b><article>" + "<u>" * n + "</b>" * n, "<li>" * n + "</ul>" * n, "<table>" + "<tr><td>z" * n]
    for page in pages:
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 12, page[:40]  # 2 to 3 s alone; quadratic work would take minutes
    tracemalloc.start()
    parse(pages[0][: 15 * 10_000])
    assert tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()


def test_decontamination_judges_each_row_by_its_text(spark, docs):
    from latencylab.llm import decontam

    item = "one two three four five six seven"
    made = [(None, f"so {item} it was"), (None, "a clean text of some words here"), (7, "clean as well, this one is"), (7, f"{item} again"), (8, None), (9, "")]
    items = spark.createDataFrame([(1, item), (2, "eight nine ten eleven twelve thirteen")], "item_id long, text string")
    table = docs(*made, extra=["1 as item_id", "'x' as `a.b`"])
    for limit in (decontam.MAX_SHINGLES, 2):
        got = decontam.decontaminate(table, items, max_shingles=limit)
        assert got.columns == table.columns
        assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got.collect()) == sorted((d or -1, t or "") for d, t in (made[1], made[2], made[4], made[5]))
    assert decontam.decontaminate(table, items.limit(0)).count() == len(made)
