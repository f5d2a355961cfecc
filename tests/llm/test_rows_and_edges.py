"""Rows that repeat ids, clashing names, hostile inputs, and the pipeline against brute force."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from partwise.llm import decontaminate, exact_dedup, html_extract, language_id, line_dedup, near_dedup
from partwise.llm.shared import BATCH_BYTES, materialise, span_hashes, trimmed, word_chunks

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def docs(spark, rows):
    """Documents with columns whose names results and helpers use too."""
    return spark.createDataFrame([(i, t, 1, "x", "y", True) for i, t in rows], "doc_id long, text string, _id int, mark string, _key0 string, kept boolean")


COPY = "one two three four five six seven eight nine ten eleven twelve"


def test_rows_are_judged_by_their_own_text(spark):
    rows = [(1, COPY), (2, COPY), (2, "quite another text that nobody else has"), (3, None), (3, "..."), (4, "same row"), (4, "same row")]
    d = docs(spark, rows)
    items = spark.createDataFrame([("i", COPY)], "item_id string, text string")
    told = lambda df: sorted((r.doc_id, r.text or "") for r in df.collect())
    other = (2, "quite another text that nobody else has")
    assert told(near_dedup.keep_one(d)) == [(1, COPY), other, (3, ""), (3, "..."), (4, "same row")]
    assert told(exact_dedup.keep_exact(d)) == [(2, COPY), other, (3, ""), (3, "..."), (4, "same row")]
    assert told(decontaminate.keep_clean(d, items)) == [other, (3, ""), (3, "..."), (4, "same row"), (4, "same row")]
    known = language_id.keep_known(d.withColumn("lang", F.lit("en")))
    assert told(known) == [(1, COPY), (2, COPY), other, (4, "same row"), (4, "same row")] and known.columns == [*d.columns, "lang"]
    assert near_dedup.keep_one(d).columns == d.columns


def test_without_lines_keeps_columns(spark):
    d = docs(spark, [(1, f"{COPY}\nown a"), (2, f"own b\n{COPY}"), (2, "own c")])
    out = line_dedup.without_lines(d, line_dedup.line_dedup(d))
    assert out.columns == d.columns and sorted(r.text for r in out.collect()) == sorted([f"{COPY}\nown a", "own b", "own c"])


def test_rows_without_ids_are_compared(spark):
    rows = [(None, COPY), (None, COPY + " thirteen"), (None, "something else that is quite different from all of that")]
    got = near_dedup.near_dedup(docs(spark, [*rows, (7, " ".join(f"w{i}" for i in range(30)))])).collect()
    assert sorted(r.kept for r in got) == [False, True, True, True] or sum(r.kept for r in got) == 4
    sims = {tuple(COPY.split()[k : k + 5]) for k in range(8)}
    assert sum(r.kept for r in got) == (3 if len(sims) / (len(sims) + 1) >= 0.8 else 4)


def test_symmetric_sequences_do_not_collide():
    def thue_morse(n):
        return np.array([bin(i).count("1") & 1 for i in range(n)])

    for n in (64, 256, 1024, 2048, 4096):
        a = thue_morse(n)
        both = np.concatenate([a, 1 - a])
        bounds = np.array([0, n, 2 * n])
        for values in ((both + 97).astype(np.uint8), both.astype(np.uint64) * np.uint64(12345) + np.uint64(7)):
            h = span_hashes(values, bounds[:-1], bounds[1:])
            assert h[0] != h[1]
            assert span_hashes(np.concatenate([values, values]), np.array([0, 2 * n]), np.array([n, 3 * n]))[1] == h[0]


def test_decontamination_of_one_word_a_thousand_times():
    index = decontaminate.Fingerprints([("i", "a " * 600), ("j", "b a b")], 10, 5)
    begin = time.time()
    chunk = next(word_chunks(pa.array(["a " * 100_000, "b a b " * 1000, "a " * 9])))
    start, end, text, item = index.hits(chunk)
    assert time.time() - begin < 5
    assert {(int(t), index.ids[i]) for t, i in zip(text, item)} == {(0, "i"), (1, "j")}
    assert end.max() <= chunk.bounds[2] and len(np.unique(start)) == 99_991 + 1000


@pytest.mark.parametrize("page, blocks", [("<a " * 700_000, 1), ("<div>x" * 100_000, 100_000), ("<a \"" + ">\" " * 300_000, 1), ("<!--" * 300_000, 1), ("<ul><li>" + "<div>" * 20_000 + "<li>x</li>" * 20_000, 20_000), ("<svg/>" * 100_000 + "x", 1)])
def test_hostile_markup_is_read_in_linear_time(page, blocks):
    begin = time.time()
    assert len(html_extract.blocks_of(page)) == blocks
    assert time.time() - begin < 5


@pytest.mark.parametrize("inside", ["<svg/>", "<iframe src=x>", "<script>", "<select>", "<textarea>", "<title>", "<noscript>", "<object data=x>", "<!-- open"])
def test_nothing_is_dropped_behind_an_unclosed_element(inside):
    texts = " ".join(b.text for b in html_extract.blocks_of(f"<article><p>aa bb</p>{inside}<p>hello there</p></article>"))
    assert "aa bb" in texts and ("hello there" in texts or inside == "<!-- open")
    assert "fallback" in " ".join(b.text for b in html_extract.blocks_of("<article><p>a <math><mi>x</mi></math> b</p><video>fallback</video></article>"))


#: Pages written by hand, each with its article.
PAGES = [
    ("<html><body><header><h1>Daily</h1><nav><a href=/>Home</a> <a href=/w>World</a></nav></header><main><article><h1>Rain in the hills</h1><p>It rained for three days in the hills above the town.</p><p>The river rose by two metres, and the bridge was closed.</p></article></main><aside class=related><h3>More</h3><ul><li><a href=/1>Snow</a><li><a href=/2>Wind</a></ul></aside><footer>&copy; 2020 Daily</footer></body></html>",
     ["Rain in the hills", "It rained for three days in the hills above the town.", "The river rose by two metres, and the bridge was closed."]),
    ('<body><div id="cookie-notice">We use cookies. <button>Accept</button></div><div class="nav"><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></div><div class="post"><h2>How to tie a knot</h2><p>Take the rope in your left hand.</p><ol><li>Cross the ends over each other.</li><li>Pull both ends until they are tight.</li></ol></div><div class="comments"><h3>Comments</h3><div class="comment"><p>Thanks, that helped me a lot.</p></div></div></body>',
     ["How to tie a knot", "Take the rope in your left hand.", "Cross the ends over each other.", "Pull both ends until they are tight."]),
    ('<body><article><h1>Bread</h1><p>Flour, water, salt and time are all that it takes.</p><div class="ad">Buy our new oven today and save ten percent.</div><p>Knead the dough for ten minutes, then let it rest.</p><form class="newsletter"><label>Your mail</label><input><button>Subscribe</button></form></article><footer><p>All rights reserved.</p></footer></body>',
     ["Bread", "Flour, water, salt and time are all that it takes.", "Knead the dough for ten minutes, then let it rest."]),
]


def test_pages_labelled_by_hand():
    chain = html_extract.train(html_extract.labelled_pages(300))
    for page, article in PAGES:
        assert html_extract.main_text(page, chain) == "\n\n".join(article)


def brute_groups(lines, similarity=0.9):
    """Groups of lines by all pairs: equal words with digits as 0, or, from 8 words on, edit similarity."""
    norm = [re.sub("[0-9]", "0", " ".join(words(x))) for x in lines]
    up = list(range(len(lines)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            s, t = lines[i].lower(), lines[j].lower()
            same = norm[i] == norm[j] and norm[i]
            long = min(norm[i].count(" "), norm[j].count(" ")) >= 7
            if same or long and line_dedup.within(s, t, int((1 - similarity) * max(len(s), len(t)) + 1e-9)):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [top(i) for i in range(len(lines))]


@pytest.mark.parametrize("most", [4, 2048])
def test_line_groups_against_all_pairs(spark, most):
    """Lines with words changed, left out and put in, families of near lines, and lines apart; in small groups and in blocks."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    lines = []
    for n in (8, 9, 12, 20, 40, 100):
        for _ in range(8):
            base = [rng.choice(vocabulary) for _ in range(n)]
            lines.append(" ".join(base))
            for _ in range(rng.randint(0, 3)):
                other = list(base)
                at = rng.randrange(n)
                kind = rng.randrange(3)
                other[at : at + (kind != 2)] = [] if kind == 0 and n > 9 else [rng.choice(vocabulary)]
                lines.append(" ".join(other))
    family = [rng.choice(vocabulary) for _ in range(30)]
    for _ in range(40):
        other = list(family)
        for at in rng.sample(range(30), rng.randint(1, 6)):
            other[at] = rng.choice(vocabulary)
        lines.append(" ".join(other))
    groups = brute_groups(lines)
    got = {r.doc_id: list(r.dropped) for r in line_dedup.line_dedup(docs(spark, list(enumerate(lines))), most=most).collect()}
    assert {i for i in got if got[i]} == {i for i, g in enumerate(groups) if g != i}


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(900)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = text(40)
    rows = [(i, text(60)) for i in range(30)]
    rows += [(30, rows[3][1]), (31, rows[3][1]), (32, rows[5][1] + " more"), (33, text(20) + " " + " ".join(item.split()[5:18])), (34, None), (35, "123 ..."), (36, " ".join(item.split()[5:13])), (5, text(30)), (7, rows[7][1])]
    kind = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # By hand: no letters go; of equal texts the largest id stays; of near ones the smallest; benchmark passages go.
    want = {(i, t) for i, t in rows if t and any(map(str.isalpha, t))}
    last = {}
    for i, t in want:
        last[t] = max(i, last.get(t, -1))
    want = {(i, t) for i, t in want if last[t] == i}
    shingles = {x: set(zip(*[x[1].split()[k:] for k in range(5)])) for x in want}
    drop = {max(x, y) for x in want for y in want if x < y and len(shingles[x] & shingles[y]) >= 0.8 * len(shingles[x] | shingles[y])}
    grams = {tuple(item.split()[k : k + 10]) for k in range(31)}
    want = {x for x in want - drop if not any(tuple(x[1].split()[k : k + 10]) in grams for k in range(len(x[1].split()) - 9))}
    assert sorted({r.doc_id for r in got}) == sorted({i for i, _ in want}) and len([r for r in got if r.piece == 0]) == len(want)
    assert (33 in {i for i, _ in want}) is False and (36 in {i for i, _ in want}) is True
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert html_extract.html_extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_licence_intervals(spark):
    from partwise.llm import license_scan

    rows = {
        "SPDX-License-Identifier: MIT OR Apache-2.0": "apache-2,mit",
        "SPDX-License-Identifier: (GPL-2.0-or-later AND BSD-3-Clause)": "bsd-3,gpl-2",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
        "Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of the Foo Company nor the names of its contributors may be used to endorse or promote products": "bsd,bsd-3",
        "GNU Lesser General Public License version 2.1": "lgpl-2.1",
        "see http://www.apache.org/licenses/LICENSE-2.0": "apache-2",
        "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa",
        "GNU General Public License as published by the Free Software Foundation; either version 3 of the License": "gpl-3",
        "the mitigation of tclets under no licence": "",
    }
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.license_scan(docs(spark, list(enumerate(rows)))).collect()}
    assert [got[i][0] for i in range(len(rows))] == list(rows.values())
    patterns = [r["pattern"] for r in license_scan.rules()]
    assert len(set(patterns)) == len(patterns) > 300


def test_licence_places_against_brute_force(spark):
    """The base part of the contract, place by place."""
    from partwise.llm import license_scan

    rng = random.Random(4)
    parts = ["under the MIT license", "Apache License, Version 2", "cc by-nc", "under the", "mit license", "x", "cc by", "nc", "version 2", "é", "\n--\n"]
    texts = [rng.choice([" ", ". ", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(200)] + [None, ""]
    got = {r.doc_id: r for r in license_scan.license_scan(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        places = sorted((k, label) for phrase, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places)), (t, r)
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_workers_get_short_batches_and_give_memory_back(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    def own():
        return sum(int(n) for n in re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())) >> 10

    def hog(batches):
        for _ in batches:
            held = [np.ones(4_000) for _ in range(3_000)]  # 96 MB in pieces that the C library keeps
            mine = pa.array(np.arange(4_000_000)).cast(pa.float64())
            last = np.zeros(10)
            del held, mine
            yield pa.RecordBatch.from_arrays([pa.array([own()]), pa.array([last.sum()])], names=["n", "m"])

    texts = spark.range(400).repartition(1).selectExpr("id", "repeat('x', 100000) AS text")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name, None)
    got = [r.n for r in materialise(texts.mapInArrow(sizes, "n long")).collect()]
    assert sum(got) > 40_000_000 and max(got) < 2 * BATCH_BYTES and spark.conf.get(name, None) == was
    before = own()
    for _ in trimmed(hog)([None, None]):
        pass
    assert own() - before < 24


def edited(rng, text, letters, times):
    out = list(text)
    for _ in range(times):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
    return "".join(out)


def test_links_of_similar_lines_are_a_tree(spark):
    rng = random.Random(5)
    letters = "abcdefgh é日"
    texts, own = [], []
    for group in range(3):
        line = "".join(rng.choice(letters) for _ in range(200))
        for _ in range(20):
            texts.append(edited(rng, line, letters, 4))
            own.append(group)
    pairs = [(a, b, rng.randrange(15)) for a in range(60) for b in range(a + 1, 60)]
    for most in (10, 1 << 14):
        groups = line_dedup.met(spark.createDataFrame(pairs, "a long, b long, d long"), spark.createDataFrame(list(enumerate(texts)), "id long, text string"), most)
        links = [(r.a, r.b) for r in line_dedup.similar(groups, 0.9).collect()]
        forest = line_dedup.Forest(np.arange(60))
        for a, b in links:
            assert own[a] == own[b]
            forest.join(a, b)
        assert len({forest.top(i) for i in range(60)}) == 3
        assert most == 10 or len(links) == 57


@pytest.mark.parametrize("letters", ["ab", "abcdefgh é日", "".join(map(chr, range(200, 900)))])
def test_blocks_of_bit_vectors_and_profiles_against_one_by_one(letters):
    rng = random.Random(9)
    texts, pairs, most = [], [], []
    for size in (1, 5, 63, 64, 65, 130, 300):
        for _ in range(30):
            s = "".join(rng.choice(letters) for _ in range(size))
            t = edited(rng, s, letters, rng.randrange(1 + size // 6))
            s, t = sorted((s, t), key=len, reverse=True)
            texts += [s, t]
            pairs.append((s, t))
            most.append(max(len(s) - len(t), int(0.1 * len(s))))
    want = [line_dedup.within(s, t, m) for (s, t), m in zip(pairs, most, strict=True)]
    assert line_dedup.band_within(pairs, np.array(most)).tolist() == want
    x = np.arange(0, len(texts), 2)
    like = line_dedup.alike([s for s, _ in pairs], [t for _, t in pairs], 0.9)
    may = line_dedup.may_be_alike(line_dedup.profiles(texts), np.array([len(t) for t in texts]), x, x + 1, 0.9)
    assert like.any() and not (like & ~may).any()
