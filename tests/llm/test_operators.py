"""The ten operators on small tables, against plain Python, and on nulls, empty and long texts, repeated rows and clashing names."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from cataloom.llm.components import connected_components
from cataloom.llm.decontaminate import decontaminated, leaks
from cataloom.llm.embedding_dedup import near_vectors
from cataloom.llm.html_text import extracted, main_text
from cataloom.llm.licenses import licenses
from cataloom.llm.line_dedup import deduplicated
from cataloom.llm.mixing import apportioned, mixed, mixed_texts
from cataloom.llm.near_dedup import near_duplicates
from cataloom.llm.secrets import labelled_samples, secrets, train
from cataloom.llm.words import sets_of, slices, word_hashes
import cataloom.llm.quality as quality
import cataloom.llm.toxicity as toxicity

DOCS = "doc_id long, text string, source string, key string, size long, a long, line string, n_lines string, start int, kept int"


def table(spark, rows):
    """Documents (doc_id, text, source) with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "k", 7, 1, "l", "x", 3, 0) for r in rows], DOCS)


def prose(seed, n=120):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefghij", k=draw.randint(2, 8))) for _ in range(n))


ODD = [(None, "some text here", "s"), (1, None, None), (2, "", "s"), (3, " \t\n ", "s"), (4, prose(4, 60_000), "s"), (5, prose(5), "s"), (5, prose(5), "s"), (6, "one two", None), (7, "One TWO", "t")]


def test_word_hashes_agree_with_splitting():
    draw = random.Random(1)
    texts = ["".join(draw.choices("aAbB \t\n\x0béß", k=draw.randint(0, 40))) for _ in range(500)] + [None, "", " "]
    seen, n = {}, 0
    for first, last, data, at in slices(pa.array(texts)):
        hashes, where = word_hashes(data, at)
        for i in range(first, last):
            words = re.findall("[^\x20\x09-\x0d]+", (texts[i] or "").replace("A", "a").replace("B", "b"))
            mine = hashes[where[i - first] : where[i - first + 1]].tolist()
            assert len(words) == len(mine)
            for w, h in zip(words, mine, strict=True):
                assert seen.setdefault(w, h) == h
                n += 1
    assert len(set(seen.values())) == len(seen) and n > 1000


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}


def brute_components(texts, k=4, percent=80):
    sets = {}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").lower())
        sets[i] = {" ".join(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {" ".join(w)} if w else set()
    parent = {i: i for i in sets}

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    draw, texts = random.Random(3), {}
    for g in range(12):
        words = prose(g, 60).split()
        for c in range(12):
            w = list(words)
            for _ in range(draw.randint(0, 4)):
                w[draw.randrange(len(w))] = "changed" + str(draw.randrange(10**6))
            texts[g * 100 + c] = " ".join(w)
    texts |= {5000: "a b", 5001: "A  b", 5002: "a b c", 5003: "", 5004: None}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_odd_rows(spark):
    got = near_duplicates(table(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[None].kept and by[None].component_id is None
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[3].component_id == 3
    assert by[7].component_id == 6 and not by[7].kept and by[6].n_shingles == 1
    assert near_duplicates(table(spark, [])).count() == 0


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else len(b) - len(a) == 1 and a[k:] == b[k + 1 :])


def test_line_dedup_equals_brute_force(spark):
    draw, pool, docs = random.Random(5), [prose(i, 8) for i in range(10)], []
    for i in range(60):
        lines = []
        for _ in range(draw.randint(1, 6)):
            line = draw.choice(pool)
            at, kind = draw.randrange(len(line)), draw.randrange(6)
            line = {0: line[:at] + line[at + 1 :], 1: line[:at] + "Z" + line[at:], 2: line[:at] + draw.choice("XYé") + line[at + 1 :]}.get(kind, line)
            lines.append(draw.choice([line, line, "short"]))
        docs.append((i, "\n".join(lines), "s"))
    seen, want = [], {}
    for i, text, _ in docs:
        gone = []
        for n, line in enumerate(text.split("\n")):
            if line:
                if any(line == o or one_edit(line, o) for o in seen):
                    gone.append(n)
                seen.append(line)
        want[i] = gone
    got = {r.doc_id: r for r in deduplicated(table(spark, docs)).collect()}
    assert {i: r.dropped for i, r in got.items()} == want
    for i, text, _ in docs:
        assert got[i].text == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in want[i])


def test_line_dedup_of_short_lines_equals_brute_force(spark):
    draw, docs = random.Random(9), []
    pool = ["".join(draw.choices("abé", k=n)) for n in (1, 1, 1, 2, 2, 3, 4, 5, 6, 8) for _ in range(2)] + [prose(i, 6)[:n] for i in range(4) for n in (30, 31, 32, 33)]
    for i in range(60):
        docs.append((i, "\n".join(draw.choice([*pool, "", prose(1000 + i, 3)]) for _ in range(draw.randint(1, 5))), "s"))
    seen, want = [], {}
    for i, text, _ in docs:
        want[i] = []
        for n, line in enumerate(text.split("\n")):
            if line:
                if any(line == o or one_edit(line, o) for o in seen):
                    want[i].append(n)
                seen.append(line)
    got = {r.doc_id: r.dropped for r in deduplicated(table(spark, docs)).collect()}
    assert got == want and sum(map(len, want.values())) > 30


def test_line_dedup_odd_rows(spark):
    got = deduplicated(table(spark, [*ODD, (8, prose(5) + "\n", "s")])).collect()
    assert len(got) == len(ODD) + 1
    by = {r.doc_id: r for r in got}
    assert by[1].text is None and by[1].n_lines == 0 and by[2].text == "" and by[2].n_lines == 1 and by[None].text == "some text here"
    assert by[8].dropped == [0] and by[8].text == "" and by[5].dropped == [] and by[4].text == prose(4, 60_000)
    assert deduplicated(table(spark, [])).count() == 0


def test_line_dedup_of_a_text_of_many_lines(spark):
    lines = [f"line {i // 2} {prose(i // 2, 3)} of a long text" for i in range(60_000)]
    got = {r.doc_id: r for r in deduplicated(table(spark, [(1, "\n".join(lines), "s"), (2, lines[7], "s")])).collect()}
    gone = set(got[1].dropped)
    assert got[1].n_lines == 60_000 and set(range(1, 60_000, 2)) <= set(got[1].dropped) and got[2].dropped == [0] and got[2].text == ""
    assert got[1].text == "\n".join(x for i, x in enumerate(lines) if i not in gone)


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, module, label):
    bad = {"quality": lambda i: "!! ".join(prose(i).upper().split()), "toxic": lambda i: prose(i, 60) + " grumblefoo " + prose(i + 1, 20) + " snarkbarr grumblefoo " + prose(i + 2, 20)}[label]
    docs = [(i, bad(i) if i % 4 == 0 else prose(i), "s") for i in range(800)]
    hit = 1 if label == "toxic" else 0
    labels = spark.createDataFrame([(i, hit if i % 4 == 0 else 1 - hit, "x") for i in range(800)] + [(None, 1, "x"), (3, None, "x"), (10**9, 1, "x")], f"doc_id long, {label} int, turn string")
    model = module.fit(table(spark, docs), labels.where("doc_id is null or doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in module.scored(table(spark, [*docs, *[(10_000 + k, r[1], r[2]) for k, r in enumerate(ODD)]]), model).collect()}
    tried = [i for i in range(800) if i % 3 == 1]
    right = sum((got[i].predicted == hit) == (i % 4 == 0) for i in tried)
    assert right >= 0.97 * len(tried) and all(0 <= r.score <= 1 for r in got.values()) and len(got) == 800 + len(ODD)
    flat = module.fit(table(spark, []), labels.limit(0))
    assert module.scored(table(spark, ODD), flat).count() == len(ODD)


def test_a_rare_languages_toxic_words_are_learned(spark):
    """Some ten toxic training texts of a small language among 700 hold a word that only they have."""
    def bad(i, word):
        return f"{prose(i, 30)} {word} {prose(i + 1, 20)}"

    docs = [(i, bad(i, "grumblefoo") if i % 2 else prose(i, 50), "s", "en") for i in range(2400)]
    docs += [(3000 + i, bad(3000 + i, "zwietrachtig") if i % 2 else prose(3000 + i, 50), "s", "xx") for i in range(36)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    model = toxicity.fit(rows, spark.createDataFrame([(r[0], r[0] % 2) for r in docs], "doc_id long, toxic int"))
    assert b" zwiet" in model.toxic and b" grumb" in model.toxic
    fresh = spark.createDataFrame([(i, bad(9000 + i, "zwietrachtig") if i % 2 else prose(9000 + i, 50)) for i in range(40)], "doc_id long, text string")
    assert sum(r.predicted == r.doc_id % 2 for r in toxicity.scored(fresh, model).collect()) >= 36


def test_samples_are_even_over_strata(spark):
    rows = spark.range(2000).selectExpr("id as doc_id", "if(id < 20, null, struct('en' as lang)) as stratum").withColumn("turn", F.xxhash64("doc_id"))
    drawn = [r.doc_id for r in toxicity._even(rows, 200).collect()]
    assert len(drawn) == len(set(drawn)) == 200 and set(range(20)) <= set(drawn)


def test_toxicity_features_equal_windows_compressed_one_by_one():
    """Every window of every text by plain zstandard, one after the other."""
    draw = random.Random(12)
    texts = [prose(i, draw.randint(0, 90)) + (" grumblefoo snark" if i % 2 else "") for i in range(40)] + [None, "", " \n ", "x" * 5000, "é ß " * 300]
    model = toxicity.ToxicityModel(prose(1, 600).encode(), b" grumblefoo snarkbarr", np.arange(toxicity.FEATURES) / 10)
    for text, got, score in zip(texts, model.features(texts), model.scores(texts), strict=True):
        data = "".join(c.lower() if "A" <= c <= "Z" else " " if c < "!" else c for c in text or "").encode()
        cut = [m.start() for m in re.finditer(rb"(?:(?<=^)|(?<= ))[^ ]", data)]
        cut = [a for i, a in enumerate(cut) if not i or a // toxicity.WINDOW != cut[i - 1] // toxicity.WINDOW]
        ends = [0, *cut[1:], len(data)]
        saved = []
        for a, b in zip(ends, ends[1:]):
            sizes = []
            for content in (model.ordinary + b" " * 16, model.ordinary + model.toxic + b" " * 16):
                level = zstandard.ZstdCompressionParameters.from_level(3, source_size=toxicity.WINDOW, dict_size=len(content), **toxicity.SETTINGS, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
                held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(compression_params=level)
                sizes.append(len(zstandard.ZstdCompressor(dict_data=held, compression_params=level).compress(data[a:b])))
            saved.append(max(0, sizes[0] - sizes[1]))
        saved = sorted(saved, reverse=True) if data else []
        want = [1.0, sum(saved[:1]), sum(saved[:2]), *(np.log1p(sum(x >= k for x in saved)) for k in toxicity.STEPS), np.log(len(saved) + 1)]
        assert got.tolist() == pytest.approx(want) and score == pytest.approx(1 / (1 + np.exp(-np.dot(want, model.weights))))


def test_toxic_rows_go(spark):
    model = toxicity.ToxicityModel(b"", b"", 5.0 * np.eye(1, toxicity.FEATURES)[0])
    assert toxicity.civil(table(spark, ODD), model).count() == 0
    model = toxicity.ToxicityModel(b"", b"", -5.0 * np.eye(1, toxicity.FEATURES)[0])
    kept = toxicity.civil(table(spark, ODD), model)
    assert kept.count() == len(ODD) and kept.columns == table(spark, ODD).columns


def test_vectors_equal_brute_force(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.12 * draw.normal(size=16)).tolist()) for i in range(1500)]
    rows += [(2000, rows[0][1]), (2001, None), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, []), (2006, [1.0, 2.0]), (None, rows[1][1]), (3, rows[3][1])]
    x = np.array([v for i, v in rows[:1501]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    counts = linked.sum(1) - 1
    got = near_vectors(spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, copies string"), 0.9).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    found = sum(by[rows[i][0]].n_links for i in range(1501) if i != 3 and not linked[3, i])
    assert found >= 0.99 * counts[[i for i in range(1501) if i != 3 and not linked[3, i]]].sum()
    assert by[2000].component_id == 0 and all(by[i].n_links == 0 and by[i].kept for i in (2001, 2002, 2003, 2004, 2005, 2006))
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


PAGE = """<html><head><title>t</title></head><body><div id="menu"><a href="/">Home</a></div><p>Intro of the site and it is for all who want to read what is on the page today or later.</p>
<article><h1>Head &amp; more</h1><p>Short.</p><p>a &lt; b\n c<br>d<script>x("</p>")</script><!-- <p>no</p> --></p><ul><li>one<li>two</ul><div class="comment-list"><p>me too</p></div></article><aside>side</aside><form>f</form></body></html>"""


def test_html(spark):
    assert main_text(PAGE) == "Head & more Short. a < b c d one two"
    long = "It is the text of the page, and it is long enough to be what all of the readers want to have from it."
    assert main_text(f"<body><ul><li><a href=x>Home</a></ul><div>{long}</div><div>Aha.</div><div>{long}</div><footer>c</footer></body>") == f"{long} Aha. {long}"
    pages = spark.createDataFrame([(1, "u", PAGE, "q"), (2, None, None, "q"), (3, "u", "", "q"), (3, "u", "", "q"), (None, "u", "<article><p>" + "x " * 200_000, "q")], "page_id long, url string, html string, text string")
    got = extracted(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 399_999), (1, len("Head & more Short. a < b c d one two")), (2, 0), (3, 0), (3, 0)]
    assert main_text("<p>a<b <!-- x") is not None and main_text("<div class='x>y") is not None


def test_html_containers_do_not_poison_the_article():
    for page in ('<div class="content has-sidebar"><article>{}</article></div>', '<div id="header-wrap"><main>{}</main></div>', '<div class="sidebar-left"><div><article>{}</article></div><ul><li>x</ul></div>'):
        assert main_text(page.format("<p>It is what it is, and that is all of it.</p>")) == "It is what it is, and that is all of it."
    assert main_text('<article><p>It is what it is.</p></article><div class="comments"><article><p>It is what I say of it.</p></article></div>') == "It is what it is."


def test_html_second_pass_equals_a_plain_search():
    from cataloom.llm import html_text

    draw, long = random.Random(31), "It is the text of the page, and it is long enough to be what all of the readers want to have from it. "
    for _ in range(60):
        page = "".join(draw.choice([f"<p>{long}</p>", "<p>Aha.</p>", "<article><p>So.</p></article>", f"<div><a href=x>{'link ' * 9}</a></div>", "<nav>n</nav>", f"<article>{long}</article>"]) for _ in range(draw.randint(1, 14)))
        found = list(html_text.blocks(page))
        first = html_text._first_pass(found)
        want = []
        for i, (b, c) in enumerate(zip(found, first)):
            if c is None:
                decided = [k for k in range(len(found)) if first[k] is not None and not found[k].boilerplate]
                decided = [k for k in decided if found[k].article == b.article] or decided
                nearest = sorted(decided, key=lambda k: (abs(k - i), k > i))
                c = first[nearest[0]] if nearest else True
            if c:
                want.append(b.text)
        assert main_text(page) == " ".join(want)


def test_secrets(spark):
    texts = [f'My token = "{hashlib.sha1(b"x").hexdigest()}" é password:abc; API_KEY: abcdef', "AKIA" + "A" * 16 + " akia AKIAB", "token=token: abcdefgh", "é" + "0123456789abcdef" * 2, prose(1), "thiscouldbeanordinarylongword and another_ordinary_name_in_code"]
    rows = table(spark, [(100 + i, t, "s") for i, t in enumerate(texts)] + ODD)
    blob = base64.b64encode(hashlib.sha512(b"q").digest()).decode().strip("=")
    plain = "this could be another ordinary long word that names something in the code while other words name what users read about every day when they open some page with many lines and would like to know more about it".split()
    models = train(labelled_samples(spark, table(spark, [(i, " ".join(random.Random(i).choices(plain, k=200)), "s") for i in range(30)])))
    got = {r.doc_id: r for r in secrets(rows.unionByName(table(spark, [(200, f"see  {blob} here", "s")])), models).collect()}
    kinds = lambda i: [(s.kind, s.start, s.end) for s in got[i].base]
    t = texts[0]
    assert kinds(100) == [("assign", t.index("token"), t.index('" é')), ("hex", t.index('"') + 1, t.index('" é')), ("assign", t.index("API_KEY"), len(t))]
    assert kinds(101) == [("access", 0, 20)] and kinds(102) == [] and kinds(103) == [("hex", 1, 33)] and kinds(1) == kinds(2) == []
    assert [(s.start, s.match) for s in got[200].added] == [(5, blob)] and got[105].added == []
    assert secrets(table(spark, []), models).count() == 0


def test_licenses(spark):
    near = "x y " + "Permission is hereby granted, free of any charge, to any person obtaining a copy of this software and associated documentation files" + " z"
    rows = [(100, "CC-BY cc by General Public  License, all rights; All Rights Reserved", "s"), (101, near, "s"), (102, "Released under the MIT License. " * 3, "s"), *ODD]
    got = {r.doc_id: r for r in licenses(table(spark, rows)).collect()}
    assert [(b.start, b.label) for b in sorted(got[100].base)] == [(0, "cc-by"), (2, "cc-by"), (4, "gpl"), (9, "reserved")] and got[100].n_words == 12 and got[100].score == 1.0
    assert [n.label for n in got[101].notices] == ["mit"] and 0.7 < got[101].score < 1 and len(got[102].notices) == 3
    assert got[1].n_words == 0 and got[5].notices is None and got[5].score == 0.0
    assert licenses(table(spark, [])).count() == 0


def test_apportionment_is_sainte_lague(spark):
    draw = random.Random(4)
    for seats in (0, 1, 7, 100, 5000):
        weights = [draw.choice([0, 1, 3, draw.random() * 50, draw.random() * 1000]) for _ in range(30)]
        cells = spark.createDataFrame([("p", i, float(w)) for i, w in enumerate(weights)], "g string, k int, w double")
        got = {r.k: r.quota for r in apportioned(cells, ["g"], "k", F.col("w"), F.lit(seats)).collect()}
        won = [0] * 30
        for _ in range(seats):
            won[max(range(30), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))] += 1
        assert [got[i] for i in range(30)] == won


def test_mixing(spark):
    draw = random.Random(6)
    rows = [(i, prose(i, draw.randint(0, 80)), draw.choice(["a", "b", "b", "b", "b", "c", None, "é"])) for i in range(600)]
    got = mixed(table(spark, rows), shard_words=2000).collect()
    again = mixed(table(spark, rows[::-1]).repartition(3), shard_words=2000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    left, share, weight = 1.5 * sum(sizes.values()), {}, dict(zip(names, [3, 1, 2, 3, 1], strict=False))
    open_ = set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            share |= {s: level * weight[s] for s in open_}
            break
        share |= {s: 2.0 * sizes[s] for s in full}
        left, open_ = left - sum(2 * sizes[s] for s in full), open_ - full
    for r in got:
        assert r.target == pytest.approx(share[r.source]) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - share[s]) <= 32 for s in names)
    odd = mixed(table(spark, ODD)).collect()
    assert len(odd) == len(ODD) and mixed(table(spark, [])).count() == 0 and mixed(table(spark, [(1, None, None)])).first().taken == 0


def test_mixed_texts_are_the_selected_blocks(spark):
    draw = random.Random(7)
    rows = [(i, " " * (i % 3) + prose(i, draw.randint(0, 60)).replace(" ", "\n", 3), draw.choice(["a", "b", "b", None])) for i in range(150)] + [(900, None, "a"), (901, " \t", "b")]
    words, want, taken = {i: (t or "").split() for i, t, _ in rows}, {}, 0
    for r in mixed(table(spark, rows), shard_words=900).collect():
        assert r.taken == sum(p.words for p in r.pieces) <= 2 * r.size
        taken += r.taken
        for p in r.pieces:
            assert 0 < p.words <= 16 - p.place and p.first_word + p.words <= r.size
            want.setdefault((r.source, r.shard, p.block), []).append((p.place, words[r.doc_id][p.first_word : p.first_word + p.words]))
    got = {(r.source, r.shard, r.block): r for r in mixed_texts(table(spark, rows), shard_words=900).collect()}
    assert set(got) == set(want) and sum(r.words for r in got.values()) == taken > 0
    for k, parts in want.items():
        assert got[k].text.split() == [w for _, part in sorted(parts) for w in part] and len(got[k].text.split()) == got[k].words
    by_shard = {}
    for source, shard, block in got:
        by_shard.setdefault((source, shard), []).append(block)
    assert len(by_shard) > 3 and all(sorted(b) == list(range(len(b))) for b in by_shard.values())
    assert all(r.words == 16 or r.block == len(by_shard[k[:2]]) - 1 for k, r in got.items())


def test_contamination(spark):
    item = prose(77, 30)
    part = " ".join(item.split()[:27])
    less = " ".join(item.split()[:20])
    docs = [(10, prose(1, 5000) + " " + item.upper() + "\n" + prose(2, 5000), "s"), (11, prose(3) + " " + part, "s"), (12, less + " " + prose(4), "s"), (13, "x " + prose(9) + " tiny item now", "s"), *ODD]
    items = spark.createDataFrame([(1, item, "q"), (2, "tiny item now", "q"), (3, None, "q"), (4, " ", "q"), (None, item, "q"), (5, prose(78, 40), "q")], "item_id long, text string, n_item string")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in leaks(table(spark, docs), items).collect()}
    assert got == {(10, 1): (26, 26), (11, 1): (23, 26), (13, 2): (1, 1)}
    clean = decontaminated(table(spark, docs), items)
    assert sorted(r.doc_id or 0 for r in clean.collect()) == sorted(r[0] or 0 for r in docs if r[0] not in (10, 11, 13)) and clean.columns == table(spark, docs).columns
    assert leaks(table(spark, []), items).count() == 0 and leaks(table(spark, docs), items.limit(0)).count() == 0


def test_contamination_over_size_classes_and_blocks_equals_brute_force(spark, monkeypatch):
    """Items of 1 to 300 words, cut and altered, in documents; several blocks; the SQL gives the same rows."""
    import duckdb

    from cataloom.llm import decontaminate, oracles

    monkeypatch.setattr(decontaminate, "BLOCK_HASHES", 300)
    draw = random.Random(21)
    items = [(i, prose(5000 + i, n)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 9, 16, 17, 31, 40, 64, 90, 130, 200, 300])]
    docs = []
    for i in range(220):
        words = draw.choice(items)[1].split()
        for _ in range(draw.choice([0, 0, 1, 1, 2, 5])):
            words[draw.randrange(len(words))] = "zz"
        docs.append((i, prose(i, draw.randint(0, 300)) + " " + " ".join(words[: draw.choice([len(words), max(1, len(words) * 8 // 10)])]) + " " + prose(i + 500, 20), "s"))
    got = sorted(map(tuple, leaks(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar); create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [d[:2] for d in docs])
    con.executemany("insert into benchmark values (?, ?)", items)
    assert got == sorted(con.execute(oracles.OP10).fetchall()) and len(got) > 60


def test_shingle_sets_have_no_row_without_words():
    assert [len(s) for s in sets_of(pa.array(["a b c d e", None, "", "a b", "a a a a a a a"]), 5)] == [1, 0, 0, 1, 1]
