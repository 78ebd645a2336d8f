import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwell.llm import _linking, ann, html_text, license_scan, line_dedup, near_dup, quality, toxicity

RND = random.Random(11)
VOCABULARY = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(2, 7))) for _ in range(400)]


def prose(n, rnd=RND):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def edited(text, k, rnd=RND):
    w = text.split(" ")
    for _ in range(k):
        w[rnd.randrange(len(w))] = "zz" + str(rnd.randrange(10**6))
    return " ".join(w)


def duck(sql, **frames):
    con = duckdb.connect()
    for name, pdf in frames.items():
        con.register("_" + name, pdf)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM _{name}")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return [dict(zip(names, r)) for r in cursor.fetchall()]


def same(df, sql, **frames):
    plain = lambda d: repr(sorted((k, round(v, 9) if isinstance(v, float) else v) for k, v in d.items()))
    got, want = sorted(plain(r.asDict()) for r in df.collect()), sorted(plain(d) for d in duck(sql, **frames))
    assert got == want


EDGE = [None, "", " \n\t ", "one", "a a a a a a", "x\n" * 40, "THE MIT license, MIT License", "apache license" * 3, "General Public License", "Kit license mİt license", "licensed under CC BY-NC 4.0.", "wörter größe " * 40, "### $$$ %%% " * 60]


def edge_frame(spark):
    texts = [*EDGE, prose(80), "same line here again\n" * 30 + prose(60), prose(2000) + " this work is licensed under the gnu general public license version 3"]
    rows = [(i, t, "c", 7) for i, t in enumerate([*texts, texts[-1]])] + [(None, prose(60), "c", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, labels int")


def test_quality_report_equals_sql(spark):
    df = edge_frame(spark)
    same(quality.quality_report(df), quality.ORACLE_SQL, documents=df.toArrow())
    assert quality.quality_report(df.limit(0)).count() == 0


def test_quality_filter_agrees_with_the_report_and_any_order(spark):
    df = edge_frame(spark)
    kept = {r.doc_id for r in quality.quality_report(df).filter("kept").collect()}
    assert {r.doc_id for r in quality.quality_filter(df).collect()} == kept
    assert quality.quality_filter(df).columns == df.columns
    backwards = quality.cascade(list(reversed(quality.RULES)), lambda r: quality._on_text(r, F.coalesce("text", F.lit(""))))
    assert {r.doc_id for r in df.filter(backwards.isNull()).collect()} == kept


def test_license_scan_equals_sql(spark):
    df = edge_frame(spark)
    same(license_scan.license_scan(df), license_scan.oracle_sql(), documents=df.toArrow())
    assert license_scan.license_scan(df.limit(0)).count() == 0


def test_whole_licence_texts_equal_sql(spark):
    rnd = random.Random(31)
    texts = []
    for t in license_scan.TEMPLATES:
        own = t.text.split()
        texts += [t.text, t.key, f"{prose(30)} {t.text.upper()} {prose(10)} {t.text}", " ".join(own[: len(own) // 2]), " ".join(own[3:]), " ".join(w if rnd.random() < 0.9 else "x" for w in own), " - ".join(own)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = license_scan.license_scan(df)
    same(out, license_scan.oracle_sql(), documents=df.toArrow())
    got = {r.doc_id: r for r in out.collect()}
    assert all(t.label in got[7 * i].labels.split(",") and got[7 * i].score >= 0.7 for i, t in enumerate(license_scan.TEMPLATES))


def test_native_plans_have_no_python(spark):
    df = edge_frame(spark)
    for out in (quality.quality_report(df), license_scan.license_scan(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_sketches_merge_and_estimate():
    rnd = np.random.Generator(np.random.PCG64(3))
    x = rnd.integers(1 << 63, size=3000).astype(np.uint64)
    a, b = x[:2400], x[600:]
    assert (near_dup.merge_sketches(near_dup.sketch(a), near_dup.sketch(b)) == near_dup.sketch(x)).all()
    sa, sb = near_dup.sketch(a), near_dup.sketch(b)
    est, ok = near_dup.estimate([len(a)], [len(b)], [(sa > sb).sum()], [(sa < sb).sum()], 0.8)
    assert abs(est[0] - 0.6) < 0.2
    est, ok = near_dup.estimate([len(a)], [len(a)], [0], [0], 0.8)
    assert est[0] == 1 and ok[0]


def test_shingles_equal_plain_ones():
    texts = ["", "One two", "a b c d e f a b c d", " x\ty\nz w  q ", "É b c d É b c d"]
    for t, s in zip(texts, near_dup.shingle_sets(texts, 4)):
        w = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        assert len(s) == len({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else ())
    a, b = near_dup.shingle_sets(["p q r s t", "x P Q r s"], 4)
    assert len(np.intersect1d(a, b)) == 1


def near_frame(spark):
    rnd = random.Random(4)
    texts = [prose(120, rnd) for _ in range(12)]
    chain = texts[0]
    rows = list(texts)
    for _ in range(12):  # neighbours are similar, the ends are not
        chain = edited(chain, 3, rnd)
        rows.append(chain)
    rows += [texts[1]] * 5 + [edited(texts[2], rnd.randint(1, 6), rnd) for _ in range(40)] + [None, "", "one two", "ONE two", "one two three"]
    return spark.createDataFrame([(i * 3 + 1, t, 1, "n") for i, t in enumerate(rows)] + [(1, rows[0], 1, "n")], "doc_id long, text string, node int, comp string")


def test_near_duplicates_equal_all_pairs(spark):
    df = near_frame(spark)
    same(near_dup.near_duplicates(df, k=4), near_dup.ORACLE_SQL, documents=df.select("doc_id", "text").toArrow())
    kept = near_dup.drop_near_duplicates(df, k=4)
    assert kept.columns == df.columns
    want = {d["doc_id"] for d in duck(near_dup.ORACLE_SQL, documents=df.select("doc_id", "text").toArrow()) if d["kept"]}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_duplicates(empty).count() == 0
    alone = spark.createDataFrame([(None, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert sorted(map(repr, (r.component_id for r in near_dup.near_duplicates(alone).collect()))) == ["3", "None"]


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(30)] + [(50, 40), (40, 60), (60, 50)], "a long, b long")
    got = {r.node: r.comp for r in _linking.components(links).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 50: 40, 60: 40}


def test_edit_distance_equals_the_table():
    rnd = random.Random(9)
    for _ in range(300):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        for limit in (0, 2, 20):
            assert line_dedup.edit_distance(a, b, limit) == min(row[-1], limit + 1)


def test_line_dedup(spark):
    rnd = random.Random(6)
    base, other, short = prose(30, rnd), prose(30, rnd), "two words"
    rows = [
        (5, f"{base}\n{short}\n{prose(20, rnd)}", "p"), (2, f"{short}\n{base.upper()}!\nunique line of five words", "q"), (9, edited(base, 1, rnd), "r"),
        (7, other, "s"), (8, f"{other}\n{other}\n", "t"), (None, None, "u"), (11, "", "v"), (2, f"{short}\n{base.upper()}!\nunique line of five words", "q"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string")
    out = line_dedup.dedup_lines(df)
    got = {r.doc_id: r for r in out.collect()}
    assert len(out.collect()) == len(rows) and out.columns == ["doc_id", "text", "line", "_n_lines", "_n_removed"]
    assert got[2].text == rows[1][1] and got[2]._n_removed == 0  # the smallest id keeps its line
    assert got[5].text == "\n".join(rows[0][1].split("\n")[1:]) and got[5]._n_removed == 1
    assert got[9].text == "" and got[7].text == other
    assert got[8].text == "" and got[8]._n_removed == 2 and got[8]._n_lines == 3
    assert got[None].text is None and got[11].text == ""
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def replaced(line, k, rnd):
    w = line.split(" ")
    for i in rnd.sample(range(len(w)), k):
        w[i] = rnd.choice(WIDE) if rnd.random() < 0.5 else "zz" + str(rnd.randrange(10**9))
    return " ".join(w)


WIDE = [f"w{i}" for i in range(20_000)]
SHAPES = [(5, 1), (10, 1), (10, 2), (20, 2), (20, 4), (40, 8), (60, 6), (60, 12), (150, 30)]


def test_lines_meet_at_the_threshold_whatever_the_number_of_lines():
    rnd = random.Random(21)
    for words, k in SHAPES:
        a = [" ".join(WIDE[int(20_000 * rnd.random() ** 3)] for _ in range(words)) for _ in range(400)]
        b = [replaced(x, k, rnd) for x in a]
        own = line_dedup.Words("\n".join(a + b).encode())
        runs = own.runs(line_dedup.RUN, own.sizes >= 3)[1]
        counts = np.bincount((runs % np.uint64(line_dedup.COUNTERS)).astype(int), minlength=line_dedup.COUNTERS)
        larger = counts * 3 + np.random.default_rng(3).poisson(100_000, len(counts))  # a corpus of 10^11 words
        for c in (counts, larger):
            places, keys = own.keys(line_dedup.frequency_ranks(c), 4)
            sets = [set() for _ in a + b]
            for p, x in zip(places.tolist(), keys.tolist()):
                sets[p].add(x)
            met = sum(bool(sets[i] & sets[i + 400]) for i in range(400))
            assert met == 400 if words <= line_dedup.RUNS + 2 else met >= 396, (words, k, met)
            assert max(map(len, sets)) <= 2 * line_dedup.RUNS
        sims = own.simhashes()
        assert not line_dedup._far(sims[:400], sims[400:]).any()


def line_groups(rows, similarity=0.8):
    """By all pairs: the smallest place of each line's group, and the links."""
    lines = [line_dedup.Line(line_dedup.normalised(t)) for t in rows]
    words = [x.words for x in lines]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if words[i] == words[j] or (min(len(words[i]), len(words[j])) >= 4 and line_dedup.similar(lines[i], lines[j], similarity))]
    comp = list(range(len(rows)))
    for _ in rows:
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
    return comp, links


@pytest.mark.parametrize("size", [150, 900])
def test_line_dedup_equals_all_pairs(spark, size):
    rnd = random.Random(22)
    rows = []
    while len(rows) < size:
        words, k = rnd.choice(SHAPES)
        a = " ".join(rnd.choice(WIDE[:3000]) for _ in range(words))
        rows += [a, replaced(a, k, rnd), replaced(a, min(k + 2, words), rnd), " ".join(a.split(" ")[: words - k])]
    comp, links = line_groups(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    removed = {r.doc_id for r in line_dedup.dedup_lines(df).collect() if r._n_removed}
    want = {i for i, c in enumerate(comp) if c != i}
    assert removed <= want and len(removed) >= 0.99 * len(want) and len(links) > size / 4


def test_large_groups_of_lines_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 40)
    rnd = random.Random(23)
    head, base = prose(12, rnd), [prose(14, rnd) for _ in range(12)]
    rows = [f"{head} {replaced(b, rnd.randint(0, 6), rnd)}" for b in base for _ in range(12)] + [replaced(f"{head} {base[0]}", 3, rnd) for _ in range(60)]
    comp, _ = line_groups(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.dedup_lines(df).collect() if r._n_removed} == {i for i, c in enumerate(comp) if c != i}


def spread(line, k):
    """``line`` with ``k`` words replaced, inserted or left out, as far from each other as can be."""
    w = line.split(" ")
    for j, i in sorted(((j, int((j + 0.5) * len(w) / k)) for j in range(k)), reverse=True):
        w[i : i + 1] = [["zz" + str(i)], ["zz" + str(i), w[i]], []][j % 3 if k % 2 else 0]
    return " ".join(w)


def test_long_lines_always_meet_and_sketches_rule_no_link_out():
    rnd = random.Random(24)
    for words in (16, 19, 20, 25, 40, 60, 150, 400):
        a = [" ".join(WIDE[int(20_000 * rnd.random() ** 3)] for _ in range(words)) for _ in range(100)]
        b = [spread(x, k) for x in a for k in (words // 5, words // 5 - 1)]
        own = line_dedup.Words("\n".join(a + b).encode())
        lines = [line_dedup.Line(x.encode()) for x in a + b]
        links = [(i, 100 + 2 * i + j) for i in range(100) for j in (0, 1) if line_dedup.similar(lines[i], lines[100 + 2 * i + j], 0.8)]
        assert len(links) >= 100
        counts = np.random.default_rng(5).poisson(100_000, line_dedup.COUNTERS)
        sketches = np.concatenate([own.simhashes(), own.parities()], axis=1)
        x, y = np.array(links).T
        assert not line_dedup._unlike(np.maximum(own.sizes[x], own.sizes[y]), sketches[x], sketches[y], 0.8).any()
        for order in (np.zeros(1, np.uint8), line_dedup.rarity(counts), line_dedup.rarity(np.arange(line_dedup.COUNTERS))):
            places, keys, at = own.prefixes(order, 4)
            sets = [{} for _ in lines]
            for p, key, i in zip(places.tolist(), keys.tolist(), at.tolist()):
                sets[p].setdefault(key, []).append(i)
            for i, j in links:
                n, m = sorted(((len(lines[z].words), z) for z in (i, j)))
                if m[0] > line_dedup.RUNS + 2:
                    both = [(np.array(u), np.array(v)) for key in sets[n[1]].keys() & sets[m[1]].keys() for u in sets[n[1]][key] for v in sets[m[1]][key]]
                    assert any(line_dedup._fitting(np.array(n[0]), np.array(m[0]), u, v, 0.8) for u, v in both), (words, i, j)


def test_long_lines_of_frequent_runs_equal_all_pairs(spark):
    rnd = random.Random(25)
    base = [" ".join(rnd.choice(WIDE) for _ in range(60)) for _ in range(2)]
    # all runs that two lines have in common are frequent, and each line has more rare ones than RUNS
    rows = [" ".join(f"zz{i}x{j}" if j % 10 == 5 else w for j, w in enumerate(b.split(" "))) for b in base for i in range(100)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.dedup_lines(df).collect() if not r._n_removed} == {0, 100}


def test_lines_of_long_texts_and_clashing_columns(spark):
    line = prose(30)
    huge = "\n".join(prose(12) for _ in range(3000)) + "\n" + line + "\n" + prose(30_000)
    df = spark.createDataFrame([(1, line, "a", "b", 3, 4), (2, huge, "a", "b", 3, 4), (3, "\n\n \n", "a", "b", 3, 4)], "doc_id long, text string, _id0 string, _DROP0 string, _n_lines int, mark int")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert out[2]._n_removed >= 1 and out[2].text == huge.replace("\n" + line, "") and out[1].text == line and out[3].text == "\n\n \n"
    assert out[1]._id0 == "a" and out[1]._DROP0 == "b" and out[1].mark == 4


def test_simhash_is_near_for_near_lines():
    rnd = random.Random(8)
    a = prose(60, rnd)
    x, y, z = line_dedup.Words("\n".join((a, edited(a, 1, rnd), prose(60, rnd))).encode()).simhashes()
    assert np.bitwise_count(x ^ y).sum() < 30 < np.bitwise_count(x ^ z).sum()


def test_toxicity_trie_and_context():
    trie = toxicity.Trie({"idiot": 1.0, "scum": 1.0}, {"lowei": 1.0})
    assert trie.find("idiot") == (1.0, 0) and trie.find("loweichen") == (1.0, 0)
    for w in ("idoit", "iidot", "id1ot", "idiots", "idot", "xidiot"):
        assert trie.find(w) == (1.0, 1), w
    for w in ("idio1s", "scam", "idiom1x", "other", ""):
        assert trie.find(w)[0] == 0, w
    model = toxicity.Model({"idiot": 1.0}, {})
    assert model.score("you are an idiot") > 0.5 > model.score('she said the word "idiot" is rude')
    assert model.score("") == model.score("fine words") < 0.5


def test_trie_equals_brute_force():
    terms = ["idiot", "moron", "stupid", "pathetic", "clown"]
    trie = toxicity.Trie(dict.fromkeys(terms, 1.0), {})

    def near(a, b):
        if a == b:
            return True
        edits = {b[:i] + b[i + 1 :] for i in range(len(b))} | {b[:i] + c + b[i:] for i in range(len(b) + 1) for c in "abcdiomnrstuplhewx"}
        edits |= {b[:i] + c + b[i + 1 :] for i in range(len(b)) for c in "abcdiomnrstuplhewx"} | {b[:i] + b[i + 1] + b[i] + b[i + 2 :] for i in range(len(b) - 1)}
        return a in edits

    rnd = random.Random(3)
    for _ in range(3000):
        w = list(rnd.choice(terms))
        for _ in range(rnd.randint(0, 2)):
            i = rnd.randrange(len(w))
            w[i : i + rnd.randint(0, 1)] = rnd.choice(["", "x", "i", "o", w[i] * 2])
        w = "".join(w)
        if len(w) >= 4:
            assert bool(trie.find(w)[0]) == any(near(w, t) for t in terms), w


def test_toxicity_learns_and_scores(spark):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        w = prose(60, rnd).split()
        if bad:
            w[10], w[30] = rnd.choice(["grumpf", "zorkel"]), "idiot"
        rows.append((i, " ".join(w), "x", 0.5))
        labels.append((i, int(bad), 1))
    df = spark.createDataFrame([*rows, (None, None, "x", 0.1), (601, "", "x", 0.2)], "doc_id long, text string, lang string, score double")
    labelled = spark.createDataFrame([*labels, (None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(df, labelled)
    assert {"grumpf", "zorkel", "idiot"} <= set(model.trie.terms)
    out = {r.doc_id: r for r in toxicity.score_documents(df, model).collect()}
    assert len(out) == 602
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out for i in held) and sum(r.held_out is True for r in out.values()) == len(held) + (zlib.crc32(b"601") % 5 == 0)
    assert all(out[i].predicted == (i % 6 == 0) for i in held)
    clean = toxicity.drop_toxic(df, model)
    assert clean.columns == df.columns and clean.count() == 502
    assert toxicity.score_documents(df.limit(0), model).count() == 0
    assert toxicity.train(df, labelled.limit(0)).score("you idiot") > 0.5


PAGE = """<html><head><title>x</title></head><body><header><h1>Site</h1></header><div class="main-nav"><ul><li><a href=x>Home</a></ul></div>
<div id="content"><h1>Title &amp; more</h1><p>First para with <b>bo</b>ld text, long enough to matter.<p>Second <a href=q>link</a> para &nbsp; with more words than the first.
<div class="cookie-notice">We use cookies</div><ul><li>item one<li>item two</ul><form><input><label>Name</label></form><blockquote>Quoted words here</blockquote></div>
<div class="comments"><p>Nice article! I really loved to read this, thanks a lot for writing it down.</p></div><div class="sidebar">Side words</div><footer>Foot</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more First para with bold text, long enough to matter. Second link para with more words than the first. item one item two Quoted words here"
    cases = {"": "", "just text &amp; more": "just text & more", "<p>a<br>b<script>x<y</script>": "a b", "<body><nav>only menu</nav></body>": "", "<div>" * 5000 + "deep": "deep", "<p>a<!-- x -->b": "ab", "<p title='>'>q</p><": "q <"}
    for source, want in cases.items():
        assert html_text.main_text(source) == want, source


def test_extract_pages_equals_plain_reading_of_the_articles(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in html_text.extract_pages(pages.withColumn("text", F.lit("clash"))).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"<(?:/?(?:p|h1|div|ul|li)\b[^>]*|br)>", article))
        want = " ".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)
    odd = spark.createDataFrame([(None, None, None), (1, "u", "")], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in html_text.extract_pages(odd).collect()] == [("", 0)] * 2


def vectors(spark, n=700, d=12):
    rnd = np.random.Generator(np.random.PCG64(2))
    centre = rnd.normal(size=(9, d))
    x = (centre[rnd.integers(9, size=n)] + 0.4 * rnd.normal(size=(n, d))).astype(np.float32)
    x[100:340] = x[100]
    rows = [(i, [float(v) for v in r], 0, 0.0) for i, r in enumerate(x)]
    rows += [(None, rows[0][1], 0, 0.0), (900, None, 0, 0.0), (901, [0.0] * d, 0, 0.0), (920, [float("nan")] * d, 0, 0.0), (940, [1.0, None] * (d // 2), 0, 0.0), (960, [1.0], 0, 0.0), rows[5]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double")


def test_nearest_neighbours_against_brute_force(spark):
    df = vectors(spark)
    rows = {r.vec_id: np.array(r.embedding) for r in df.collect() if r.vec_id is not None and r.vec_id < 700}
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 700, 20))
    hits = 0
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21))
        exact = sorted(((-float(rows[q] @ rows[i]), i) for i in rows if i != q))[:20]
        assert all(abs(s - float(rows[q] @ rows[i])) < 1e-9 for _, i, s in own)
        hits += len({i for _, i in exact} & {i for _, i, _ in own})
    assert hits >= 0.95 * 20 * len(got)
    assert ann.nearest(df.limit(0)).count() == 0
    few = df.filter("vec_id in (0, 3)")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(few).collect()] == [(0, 3)]


def test_nearest_neighbours_inside_a_hot_group_of_near_copies(spark):
    rnd = np.random.Generator(np.random.PCG64(12))
    n, d = 3000, 16
    x = rnd.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for noise, own in ((0.001, slice(0, 500)), (0.1, slice(500, 1000))):
        x[own] = x[own.start] + noise / d**0.5 * rnd.normal(size=(500, d))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, every=50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert len(got) == n // 50
    for q, own in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        assert [i for _, i in sorted(own)] == np.argsort(-score)[:20].tolist(), q


def test_parallel_error_is_what_the_codes_avoid():
    rnd = np.random.Generator(np.random.PCG64(5))
    x = rnd.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    aware = ann.Codebooks.fit(x)
    plain = ann.Codebooks(aware.centres, 1.0)

    def parallel(b):
        codes = b.encode(x)
        back = np.concatenate([b.centres[i][codes[:, i]] for i in range(codes.shape[1])], axis=1)
        return np.abs(((x - back) * x).sum(axis=1)).mean()

    assert parallel(aware) < parallel(plain)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """The smallest data set with documents cut to a few, and planted cases."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    base = docs[0]
    rows = [tuple(r) for r in docs] + [(10_001, base.text, base.lang, base.source, base.n_chars), (10_002, "you stupid idiot moron clown " * 20, "en", "s", 1), (10_003, None, None, None, None)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_stages(spark, small, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append({r.doc_id for r in out.select("doc_id").collect()})
        if i < 4:
            assert out.columns == docs.columns
            docs = out
    assert 10_002 not in seen[0] and 10_003 in seen[0] and 10_003 not in seen[1] and 10_001 not in seen[3]
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] == seen[4] and len(seen[4]) > 20


def test_line_stage_keeps_documents_with_text_left(spark):
    import corpus_pipeline

    header = "this page is under the usual terms of use"
    texts = [f"{header}\nalpha beta\ngamma", f"{header}\nown short\nlines only", header, f"{header}\n \n", "no shared line\nhere"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.without_repeated_lines(spark, docs, "").collect()}
    assert out == {0: (texts[0], len(texts[0])), 1: ("own short\nlines only", 20), 4: (texts[4], len(texts[4]))}


def test_short_and_unspaced_lines(spark):
    a, b = "今日は天気がとても良いので散歩に行きましょう", "今日は天気がとても良いので買物に行きましょう"
    rows = [(1, f"Read more\n{a}\n--\nbig cat sat"), (2, f"own\nread more!\n{b}\n--"), (3, "big cat sits\nล้างมือก่อนกินข้าว"), (4, "ล้างมือก่อนกินข้าว\nbig cat sat\nread")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, exact_words=1).collect()}
    assert out == {1: rows[0][1], 2: "own\n--", 3: rows[2][1], 4: "read"}
    assert {r.doc_id: r._n_removed for r in line_dedup.dedup_lines(df).collect()} == {1: 0, 2: 1, 3: 0, 4: 1}


def test_the_same_texts_without_article_tags():
    import re

    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column("html").to_pylist():
        own = re.search(r"<article[^>]*>(.*)</article>", page or "", re.S)
        if own:
            whole = html_text.main_text(page)
            assert whole and html_text.main_text(re.sub(r"<(/?)(?:article|main)\b", r"<\1div", page)) == whole


def test_broken_markup_of_any_depth_takes_a_time_in_proportion():
    import time

    n = 200_000
    begin = time.time()
    for source in ("<b>" * n + "x", "<div>" * n + "</span>" * n, "<b><table>" + "<i>" * n + "</b>" * n, "<p><i>" * n, "<ul><li>" * n + "</p>" * n, "<!--" * n, "<a '" * n, "<script>" * n):
        html_text.main_text("<body><p>Some words of a text.</p>" + source)
    assert time.time() - begin < 60


def test_names_are_noise_only_where_the_text_is_elsewhere():
    body = "Long words of the article itself, more than anything else has here."
    for source in (
        f"<body><div class='layout with-sidebar'><article><p>{body}</article><div class='sidebar'>side</div></div>",
        f"<body><div id='page' class='no-sidebar'><p>{body}</p></div>",
        f"<body><div class='sidebar-layout'><article><p>{body}</article></div><div class=comments>{body * 3}</div>",
        f"<body><form action=x><div><p>{body}</p><input><label>Name</label></div><div class=menu>Home</div></form>",
        f"<body><div class=widget-page><main><p>{body}</main></div><div class=related><article>Short teaser</article></div>",
        f"<body><div><p>{body}</p></div><div class=related><article>Short teaser</article></div><div class='ad-slot'>Buy</div><form>Sign up</form>",
    ):
        assert html_text.main_text(source) == body, source
    titles = "<section id='related-work'><h2 id='notice-period'>Notice</h2>a</section><h2 id='search'>Search</h2><p class='ad-hoc'>b</p>"
    assert html_text.main_text(f"<body><article><p>{body}</p>{titles}<section id=comments>c</section><div class=share-bar>d</div></article>") == f"{body} Notice a Search b"


def test_lines_seldom_meet_by_chance_in_a_large_corpus():
    """The counters of runs are those of a corpus with far more runs than counters, where rare runs can't be told apart by them."""
    rnd = random.Random(31)
    rows = [" ".join(WIDE[int(20_000 * rnd.random() ** 3)] for _ in range(rnd.choice((8, 12, 17, 30, 60)))) for _ in range(6000)]
    raw = "\n".join(rows).encode()
    counts = np.zeros((2, line_dedup.COUNTERS))
    for row in (r for b in line_dedup._line_rows([pa.RecordBatch.from_pydict({"doc_id": [1], "mark": [1], "text": [raw.decode()]})]) for r in b.to_pylist() if r["counts"]):
        counts.reshape(2 * line_dedup.CHUNKS, -1)[row["chunk"]] = np.frombuffer(row["counts"], np.uint32)
    runs = counts[0] + np.random.default_rng(7).poisson(10_000, line_dedup.COUNTERS)
    blobs = [b for batch in line_dedup._packed(line_dedup.rarity(runs), line_dedup.shares(counts[1]), 4, 1, [pa.RecordBatch.from_pydict({"text": [raw.decode()]})]) for b in batch.column("blob").to_pylist()]
    met = pa.Table.from_batches(line_dedup._shared(0.8, [pa.RecordBatch.from_pydict({"part": pa.array([0] * len(blobs), pa.int32()), "blob": blobs})])).to_pandas()
    pairs = met[met["b"].notna()].drop_duplicates(["a", "b"])
    assert len(pairs) + met["b"].isna().sum() < 100  # 412 when only counters of runs gave the order


def test_few_inner_products_are_summed_one_by_one(monkeypatch):
    x = np.random.default_rng(1).normal(size=(8192, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    books = ann.Codebooks.fit(x[:2000])
    slot = pd.concat(list(ann._encoded(books, 1, 64, [pd.DataFrame({"slot": 0, "ids": [np.array([i]) for i in range(8192)], "embedding": list(x)})])))
    summed, inner = [], ann._inner
    monkeypatch.setattr(ann, "_inner", lambda *args: summed.append(inner(*args)) or summed[-1])
    got = ann._scan(books, 64, 20, ann.RERANK, pd.DataFrame({"query_id": np.arange(0, 8192, 200), "embedding": list(x[::200])}), slot)
    for query, own in got.groupby("query_id"):
        assert own["vec_id"].tolist() == [i for i in np.argsort(-(x @ x[query]), kind="stable").tolist() if i != query][:20]
    assert len(got) == 41 * 20 and sum(s.size for s in summed) < 41 * 400  # 164,280 before


def test_short_lines_always_meet_by_the_first_runs():
    rnd = random.Random(32)
    for words in range(4, 19):
        a = [" ".join(WIDE[int(20_000 * rnd.random() ** 3)] for _ in range(words)) for _ in range(60)]
        b = []
        for x in a:
            w = x.split(" ")
            for _ in range(rnd.randint(1, words // 4)):
                i = rnd.randrange(len(w))
                w[i : i + 1] = rnd.choice([["zz"], ["zz", w[i]], [w[i], "yy"], []])
            b.append(" ".join(w))
        own = line_dedup.Words("\n".join(a + b).encode())
        lines = [line_dedup.Line(x.encode()) for x in a + b]
        links = [(i, 60 + i) for i in range(60) if min(len(lines[i].words), len(lines[60 + i].words)) >= 4 and line_dedup.similar(lines[i], lines[60 + i], 0.8)]
        assert links
        counts = np.random.default_rng(8).poisson(3, line_dedup.COUNTERS).astype(float) ** 6
        for order, share in ((np.zeros(1, np.uint8), None), (line_dedup.rarity(counts), line_dedup.shares(counts))):
            sets = [{} for _ in lines]
            for p, key, i in zip(*(x.tolist() for x in own.prefixes(order, 4, share))):
                sets[p].setdefault(key, []).append(i)
            for i, j in links:
                n, m = sorted(((len(lines[z].words), z) for z in (i, j)))
                both = [(np.array(u), np.array(v)) for key in sets[n[1]].keys() & sets[m[1]].keys() for u in sets[n[1]][key] for v in sets[m[1]][key]]
                assert any(line_dedup._fitting(np.array(n[0]), np.array(m[0]), u, v, 0.8) for u, v in both), (words, a[i], b[j - 60])


def test_parities_rule_out_what_is_near_by_simhash():
    rnd = random.Random(33)
    a = [" ".join(rnd.choice(WIDE) for _ in range(40)) for _ in range(100)]
    b = [spread(x, 14) for x in a]  # 8 edits are allowed
    own = line_dedup.Words("\n".join(a + b).encode())
    sketches = np.concatenate([own.simhashes(), own.parities()], axis=1)
    x, y = sketches[:100], sketches[100:]
    near = ~line_dedup._far(x[:, :2], y[:, :2])
    assert near.sum() > 50  # all of these were verified before
    assert line_dedup._unlike(np.maximum(own.sizes[:100], own.sizes[100:]), x, y, 0.8).mean() > 0.9


def test_components_united_by_more_links(spark):
    links = spark.createDataFrame([(1, 2), (3, 4), (5, 6), (7, 8)], "a long, b long")
    more = spark.createDataFrame([(2, 4), (4, 9), (10, 8), (5, 6)], "a long, b long")
    comps = _linking.components(links)
    want = {1: 1, 2: 1, 3: 1, 4: 1, 9: 1, 5: 5, 6: 5, 7: 7, 8: 7, 10: 7}
    assert {r.node: r.comp for r in _linking.united(comps, more).collect()} == want
    assert {r.node: r.comp for r in _linking.united(comps, links).collect()} == {r.node: r.comp for r in comps.collect()}


def test_copies_of_a_line_count_once_among_the_lines_of_a_run():
    rnd = random.Random(34)
    a = prose(20, rnd)
    rows = "\n".join([a] * 60 + [replaced(a, 2, rnd), replaced(a, 2, rnd)])
    blobs = [b for batch in line_dedup._packed(np.zeros(1, np.uint8), None, 4, 1, [pa.RecordBatch.from_pydict({"text": [rows]})]) for b in batch.column("blob").to_pylist()]
    met = pa.Table.from_batches(line_dedup._shared(0.8, [pa.RecordBatch.from_pydict({"part": pa.array([0] * len(blobs), pa.int32()), "blob": blobs})])).to_pandas()
    assert met["b"].notna().all() and 1 < len(met) <= 3  # before, runs of more than 32 lines went to the comparison of large groups


def test_words_are_told_apart_whatever_their_length_and_place():
    rnd = random.Random(35)
    words = sorted({"".join(rnd.choice("abé") for _ in range(n)) for n in [*range(1, 20), 31, 32, 33, 63, 64, 65, 66, 200] for _ in range(40)} | {"a\0", "a\0\0", "a" * 64, "a" * 65})
    rows = ["\t \x0b".join(rnd.sample(words, len(words))) for _ in range(9)]  # at all places within eight bytes
    own = line_dedup.Words(" \n\n".join(rows).encode())
    assert own.sizes.tolist() == [len(words)] * 9 and own.lines.tolist() == [0, 2, 4, 6, 8, 10, 12, 14, 16]
    hashes = {}
    for word, h in zip((w for r in rows for w in r.split()), own.hashes.tolist()):
        assert hashes.setdefault(word, h) == h
    assert len(set(hashes.values())) == len(words)


def test_latin_texts_are_normalised_as_all_others():
    for c in map(chr, range(1, 0x250)):
        assert line_dedup.normalised(f"A{c}b") == line_dedup.normalised(f"A{c}b\u2003")[:-3], c


def test_near_copies_are_linked_without_the_edit_distance(monkeypatch):
    rnd = random.Random(36)
    a = [prose(40, rnd) for _ in range(50)]
    b = [spread(x, 5) for x in a]
    monkeypatch.setattr(line_dedup, "edit_distance", None)
    assert all(line_dedup.similar(line_dedup.Line(x.encode()), line_dedup.Line(y.encode()), 0.8) for x, y in zip(a, b))
