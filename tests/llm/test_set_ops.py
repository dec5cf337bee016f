from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from helpers import AWKWARD, docs
from pyspark.sql import functions as F

from dqspark.llm import decontam, html, licenses, queries, simhash, urls

SF = "/root/testdata/sf0.001"


# --- near duplicates --------------------------------------------------------------------
def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(points, radius=2):
    """Smallest index of the component of each point, by brute force."""
    root = list(range(len(points)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(points):
        for j in range(i):
            if bin(a ^ points[j]).count("1") <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(points))]


def test_components_equal_brute_force(spark):
    draw = random.Random(1)
    base = [" ".join(f"w{draw.randrange(3000)}" for _ in range(200)) for _ in range(30)]
    texts = [t + f" x{k}" * draw.randrange(3) for t in base for k in range(4)] + AWKWARD
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    points = [fingerprint(t) for t in texts]
    assert [got[i].fingerprint % 2**64 for i in range(len(texts))] == points
    assert [got[i].component_id for i in range(len(texts))] == classes(points)
    assert sorted(r.doc_id for r in simhash.keep_one(docs(spark, texts)).collect()) == sorted(set(classes(points)))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("leaf", [8, 64])
def test_tree_loses_no_link(spark, leaf):
    draw = np.random.default_rng(2)
    centres = draw.integers(0, 2**63, 40, dtype=np.uint64)
    points = set(draw.integers(0, 2**63, 500, dtype=np.uint64).tolist())
    for centre in centres.tolist():  # chains and clouds of close points
        for _ in range(12):
            points.add(centre)
            centre ^= 1 << int(draw.integers(0, 64))
    points = sorted(points)
    signed = [p - 2**64 if p >= 2**63 else p for p in points]
    df = simhash.pin(spark.createDataFrame([(s,) for s in signed], "fingerprint long"))
    got = dict(simhash.components(simhash.links(df, leaf=leaf)).collect())
    want = {}
    for p, root in zip(signed, classes(points), strict=True):
        want.setdefault(root, []).append(p)
    want = {p: min(group) for group in want.values() for p in group if p != min(group)}
    assert got == want


def test_dense_group_makes_a_forest():
    cloud = np.unique(np.array([1 << i for i in range(64)] + [0], dtype=np.uint64))
    a, b = simhash.forest(cloud, cloud[:5])
    assert len(a) <= len(cloud) + 5
    assert set(b.tolist()) == {0}


def test_large_leaf_is_divided_without_losing_links():
    draw = np.random.default_rng(3)
    points = draw.integers(0, 2**63, 1500, dtype=np.uint64)
    points = np.unique(np.concatenate([points, points[:300] ^ np.uint64(5), points[:200] ^ np.uint64(1 << 40)]))
    homes, queries = points[::2], points[1::2]
    a, b = simhash.forest(homes, queries)
    c, d = simhash.deep_forest(homes, queries, leaf=16)

    def groups(x, y):
        root = {int(p): int(p) for p in points}

        def find(p):
            while root[p] != p:
                p = root[p]
            return p

        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            p, q = find(p), find(q)
            root[max(p, q)] = min(p, q)
        return [find(int(p)) for p in points]

    assert groups(a, b) == groups(c, d) and len(set(groups(a, b))) < len(points)


def test_repeated_and_null_keys(spark):
    rows = [(1, "same old words here"), (1, "same old words here"), (None, "other text"), (None, "other text"), (2, "same old words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 5
    assert sorted(str(r.doc_id) for r in simhash.keep_one(df).collect()) == ["1", "None"]
    lines = [(k, " ".join(f"{c}{i}" for i in range(40))) for k, c in ((None, "a"), (None, "b"), (7, "c"), (7, "d"), (None, "d"))]
    kept = simhash.keep_one(spark.createDataFrame(lines, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in kept) == [("7", "c"), ("7", "d"), ("None", "a"), ("None", "b")]


# --- benchmark --------------------------------------------------------------------------
def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def hits(text, items, size=10):
    seen, covered, found = words(text), set(), set()
    for key, item in items:
        parts = words(item)
        for at in range(max(1, len(parts) - size + 1)) if parts else ():
            run = parts[at : at + size]
            for i in range(len(seen) - len(run) + 1):
                if seen[i : i + len(run)] == run:
                    covered.update(range(i, i + len(run)))
                    found.add(str(key))
    return len(seen), len(covered), sorted(found)


def test_decontamination_equals_brute_force(spark):
    draw = random.Random(4)
    word = lambda: draw.choice(["a", "b", "the", "Ünï", "x9", "q", *(f"r{i}" for i in range(20))])
    items = [(k, " ".join(word() for _ in range(draw.choice([3, 9, 10, 11, 30])))) for k in range(25)] + [(25, None), (26, ""), (27, "a"), (28, "the the the the the the the the the the the"), (28, "r1 r2")]
    texts = []
    for _ in range(150):
        parts = [" ".join(word() for _ in range(draw.randrange(40)))]
        if draw.random() < 0.5:
            cut = words(draw.choice(items)[1])
            parts.append("-".join(cut[draw.randrange(3) :]).upper())
        texts.append(" ".join(parts))
    texts += ["the " * 40, *AWKWARD]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(docs(spark, texts), table).collect()}
    for i, text in enumerate(texts):
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == hits(text, items), text
    clean = {r.doc_id for r in decontam.keep_clean(docs(spark, texts), table).collect()}
    assert clean == {i for i, text in enumerate(texts) if not hits(text, items)[1]}


def test_clean_rows_stay_beside_contaminated_ones_of_the_same_key(spark):
    item = spark.createDataFrame([("q", "one two three four five six seven eight nine ten")], "item_id string, text string")
    dirty, clean = "so one two three four five six seven eight nine ten", "nothing to see here"
    rows = [(None, dirty), (None, clean), (None, None), (3, dirty), (3, clean), (3, clean), (4, "")]
    kept = decontam.keep_clean(spark.createDataFrame(rows, "doc_id long, text string"), item).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [("3", clean), ("3", clean), ("4", ""), ("None", "None"), ("None", clean)]


def test_decontamination_proximity_and_empty_tables(spark):
    item = spark.createDataFrame([("q", "one two three four five six seven eight nine ten")], "item_id string, text string")
    texts = ["one two three four five six seven eight nine ten", "one two three four five six seven eight ten nine", "one two three"]
    got = {r.doc_id: r for r in decontam.decontaminate(docs(spark, texts), item).collect()}
    assert [(got[i]["n_hit"], got[i]["n_near"]) for i in range(3)] == [(10, 0), (0, 1), (0, 0)]
    assert decontam.decontaminate(docs(spark, []), item).count() == 0
    assert [r["n_hit"] for r in decontam.decontaminate(docs(spark, texts), item.limit(0)).collect()] == [0, 0, 0]


# --- URLs -------------------------------------------------------------------------------
def test_url_parts_and_rules(spark):
    given = [
        ("HTTP://WWW.Example.NET/en/x?y#z", "www.example.net", "/en/x", "example.net/en/"), ("http://badexample.net/en/", "badexample.net", "/en/", "net/"),
        ("a://example.com/de/1", "example.com", "/de/1", "example.com/de/"), ("a://example.com/de", "example.com", "/de", None), ("x://net", "net", "", None),
        ("x://net/", "net", "/", "net/"), ("https://É.org/fr/é", "É.org", "/fr/é", "org/fr/"), ("nothing", "", "", None), (None, "", "", None), ("", "", "", None),
        ("a://b?c://d/e", "b", "", None), ("://h\nx/p\nq", "h\nx", "/p\nq", None),
    ]
    df = spark.createDataFrame([(i, u, "z", "z") for i, (u, *_) in enumerate(given)], "page_id long, url string, host string, score string")
    got = {r.page_id: r for r in urls.judge(df, queries.URL_RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(given))] == [tuple(g[1:]) for g in given]
    assert all(got[i].verdict in ("allow", "block") for i in range(len(given)))
    assert urls.judge(df.limit(0), queries.URL_RULES).count() == 0
    assert {r.verdict for r in urls.judge(df.where("page_id > 6"), queries.URL_RULES).collect()} == {"allow"}


def test_url_model_equals_plain_python(spark):
    import math
    from collections import Counter

    draw = random.Random(9)
    rows = [("^" + "".join(draw.choice("abcd" if bad else "abxy") for _ in range(draw.randint(1, 8))) + "$", bad) for bad in (True, False) for _ in range(60)]
    judged = spark.createDataFrame(rows, "line string, bad boolean").withColumn("n", F.lit(1))
    got = {r.gram: r.ratio for r in urls.train(judged).collect()}
    count = {bad: Counter(line[i - k : i] for line, b in rows if b == bad for i in range(2, len(line) + 1) for k in range(1, urls.ORDER + 1) if i >= k) for bad in (True, False)}

    def p(gram, bad):
        low = 1 / 256 if len(gram) == 1 else p(gram[1:], bad)
        total = sum(n for g, n in count[bad].items() if len(g) == len(gram) and g[:-1] == gram[:-1])
        return (count[bad][gram] + urls.STRENGTH * low) / (total + urls.STRENGTH)

    want = {g: math.log(p(g, False) / p(g, True)) for g in set(count[True]) | set(count[False])}
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g]) for g in want)

    lines = sorted({line for line, _ in rows[:20]} | {"^zzz$", "^a", "x", "", "^😀abab$"})
    scores = {r.line: r.score for r in urls.score(spark.createDataFrame([(x,) for x in lines], "line string"), urls.train(judged)).collect()}
    for line in lines:
        places = range(2, max(len(line), 2) + 1)
        runs = [next((want[line[max(0, i - k) : i]] for k in range(min(urls.ORDER, i), 0, -1) if line[max(0, i - k) : i] in want), 0.0) for i in places]
        assert scores[line] == pytest.approx(sum(runs) / len(runs), abs=1e-9), line


def test_verdicts_do_not_depend_on_how_many_other_urls_there_are(spark):
    """Backing off to shorter runs goes on working when very many runs have been seen."""
    draw = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789-_~"
    made = lambda: "".join(draw.choice(letters) for _ in range(14))
    rows = [f"http://{'casino' if i % 2 else 'library'}{i % 37}.net/{'win' if i % 2 else 'book'}/{made()}" for i in range(4000)]
    asked = [f"http://{'casino' if i % 2 else 'library'}.info/{'win' if i % 2 else 'book'}/{i}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(rows + asked)), "page_id long, url string")
    got = urls.judge(df, [("net/win/", "block"), ("net/book/", "allow")]).where("rule is null").collect()
    assert len(got) == 40 and all((r.verdict == "block") == (r.page_id % 2 == 1) for r in got)


def test_held_out_urls_are_told_apart(spark):
    rows = [(i, f"http://{'casino' if i % 2 else 'library'}{i % 37}.{'net' if i % 3 else 'info'}/{'win' if i % 2 else 'book'}/{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    rules = [("net/win/", "block"), ("net/book/", "allow")]
    got = urls.judge(df, rules).where("rule is null").collect()
    assert len(got) == 200 and all((r.verdict == "block") == bool(r.page_id % 2) for r in got)


# --- pages ------------------------------------------------------------------------------
def test_best_run_equals_brute_force():
    draw = random.Random(2)
    for _ in range(300):
        scores = [draw.choice([-2.0, -1.0, 0.0, 1.0, 2.0]) for _ in range(draw.randrange(12))]
        runs = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
        first, last = html.best_run(scores)
        assert sum(scores[first:last]) == max([0.0, *runs.values()])


def test_page_texts_equal_the_article(spark):
    import html as library

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in queries.page_texts(spark, SF).collect()}
    for row in pages.collect():
        inner = re.search(r"<article>(.*)</article>", row.html, re.S)[1]
        plain = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))
        assert got[row.page_id].text == " ".join(library.unescape(plain).split())
        assert got[row.page_id].n_chars == len(got[row.page_id].text)


def test_awkward_pages(spark):
    page = (
        "<html><head><title>T</title><script>if (a<b) '</p>'</script></head><body><header><a href='x'>Home</a></header><div class='cookie-notice'>We use cookies here</div>"
        "<main><h1>Big&nbsp;news</h1><p>One <b>wo</b>rd &lt;tag&gt; &amp; more<script>x</script></p><aside>side text</aside><form><input value='>'>send it</form><p title=\"a>b\">Two\n lines<br>and three</p></main>"
        "<section id='comments'><p>reader says many many many words here</p></section><footer>end of it</footer></body></html>"
    )
    pages = [page] * 5 + [None, "", "<p>", "no tags at all, just words", "<!-- open <p>x</p>", "<article><p>cut off in the mid", "<div " + "a='" * 5000, "<p>" * 20_000 + "deep words here"]
    df = spark.createDataFrame([(i, None, p, "clash") for i, p in enumerate(pages)], "page_id long, url string, html string, main_text string")
    got = {r.page_id: r.main_text for r in html.extract(df, html.train(df)).collect()}
    assert got[0] == "Big news One word <tag> & more Two lines and three"
    assert [got[i] for i in (5, 6, 7, 9)] == [""] * 4 and got[10] == "cut off in the mid"
    plain = {r.page_id: r.main_text for r in html.extract(df, {}).collect()}
    assert plain[8] == "no tags at all, just words"
    assert html.train(df.limit(0)) == {} and html.extract(df.limit(0), {}).count() == 0


# --- licences ---------------------------------------------------------------------------
def test_licences_and_inheritance(spark):
    body = "def f(): return 1\n" * 30
    files = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", body), (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0\n" + body),
        (4, "z.py", body), (5, "d/e/notes.txt", "All rights reserved."), (6, "d/e/f/g.py", body), (7, "d/h.py", body), (8, None, body), (9, "a/b/n.py", None),
        (10, "a/q.py", "We discuss licenses and other legal matters at great length in this line of text"), (None, "a/b/r.py", body), (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0\n" + body),
    ]
    df = spark.createDataFrame([(*f, "c", "c") for f in files], "doc_id long, path string, text string, license string, score string")
    got = licenses.scan(df).collect()
    assert len(got) == len(files)
    by = {r.doc_id: (r.own_license, r.license, r.inherited_from) for r in got}
    assert by[1] == ("MIT", "MIT", None) and by[2] == (None, "MIT", "a") and by[3] == ("Apache-2.0", "Apache-2.0", None)
    assert by[4] == by[7] == by[8] == (None, None, None) and by[6] == (None, "proprietary", "d/e")
    assert by[9] == by[10] == by[None] == (None, "MIT", "a")
    assert licenses.scan(df.limit(0)).count() == 0


def test_licence_cosines_equal_brute_force(spark):
    import math
    from collections import Counter

    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in table.collect()}
    got = {r.doc_id: (r.own_license, r.score) for r in queries.license_scan(spark, SF).collect()}
    split = lambda t: re.findall(licenses.WORD, t.lower())
    held = Counter(w for t in texts.values() for w in set(split(t or "")))
    idf = lambda w: math.log((1 + len(texts)) / (1 + held[w])) + 1
    vector = lambda t: {w: n * idf(w) for w, n in Counter(split(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    cosine = lambda a, b: sum(x * b.get(w, 0) for w, x in a.items()) / ((norm(a) * norm(b)) or 1)
    notices = [(name, vector(notice)) for name, notice in licenses.TEMPLATES]
    for key, text in texts.items():
        lines = (text or "").split("\n")
        cued = [bool(re.search(licenses.CUES, line)) for line in lines]
        blocks = ["\n".join(lines[a : a + k]) for k in (1, 2, 3) for a in range(len(lines) - k + 1) if cued[a] or cued[a + k - 1]]
        best = max(((cosine(vector(block), v), name) for block in blocks for name, v in notices), default=(0, None))
        want = (best[1], pytest.approx(best[0], abs=1e-5)) if best[0] >= licenses.LEAST_COSINE else (None, None)
        assert got[key] == want, text[-200:]


def test_cosines_do_not_move_with_the_size_of_the_table(spark):
    notice = "Copyright 2024 Example. All rights reserved."
    found = []
    for n in (200, 2000):
        rows = [(i, f"d/{i}.txt", f"plain text number {i}\n" + (notice if i % 20 == 0 else "nothing here")) for i in range(n)]
        got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
        assert all((got[i].own_license == "proprietary") == (i % 20 == 0) for i in range(n))
        found.append(got[0].score)
    assert found[0] == pytest.approx(found[1], abs=0.01)


def test_wrapped_notices_are_found_whole(spark):
    wrapped = "# Redistribution and use in source and binary forms,\n# with or without modification,\n# are permitted\n"
    rows = [(0, "a/x.py", "x = 1\n" * 40 + wrapped + "y = 2\n" * 40), (1, "b/y.py", "y = 2\n" * 40)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[0].own_license == "BSD-3-Clause" and got[0].score > 0.99 and got[1].license is None


def test_term_slots_agree_wherever_a_term_stands():
    powers = decontam.Powers()
    terms = ["a", "é", "x" * 100, "\U0001f600k", "9"]
    alone = decontam.slots(decontam.read(terms, powers)).tolist()
    among = decontam.read(["zz " * 400 + "A!é" + "-" + "X" * 100 + " \U0001f600K/9", None, "", "É"], powers)
    assert decontam.slots(among).tolist()[400:405] == alone and len(set(alone)) == 5
    assert among.counts.tolist() == [405, 0, 0, 1]
    for text in ("zz A!é", "...", "", None, "\u00a0x y"):
        words = decontam.read([text], powers)
        assert [words.bytes[a:b] for a, b in zip(words.start, words.end, strict=True)] == decontam.tokens(text)
