"""Edge cases and brute-force versions of the operators on small tables."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from partwise.llm import chat_format, decontaminate, exact_dedup, html_extract, language_id, license_scan, line_dedup, near_dedup, pack, url_filter
from partwise.llm.shared import word_chunks

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def docs(spark, rows):
    """Documents with columns beside the two that count, some of them named as results are."""
    return spark.createDataFrame([(i, t, "x", 1, True) for i, t in rows], "doc_id long, text string, digest string, size int, kept boolean")


EDGES = [(1, None), (2, ""), (3, "..."), (4, "one"), (5, "The quick brown fox jumps over the lazy dog again and again today"), (5, "The quick brown fox jumps over the lazy dog again and again today"), (6, "é É 日本 " * 3000), (None, "no number here")]


def test_words():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aZ é日-\n0.") for _ in range(rng.randrange(30))) for _ in range(300)] + ["", "a"]
    counts = np.concatenate([w.counts for w in word_chunks(pa.array(texts))])
    assert counts.tolist() == [len(words(t)) for t in texts]


@pytest.mark.parametrize("rows", [[], EDGES])
def test_every_operator_takes_edges(spark, rows):
    d = docs(spark, rows)
    items = spark.createDataFrame([("i", "lazy dog again and again"), (None, "x"), ("e", None)], "item_id string, text string")
    n = len(rows)
    assert exact_dedup.exact_dedup(d).count() == n
    assert near_dedup.near_dedup(d).count() == n
    assert decontaminate.decontaminate(d, items).count() == n
    assert license_scan.license_scan(d).count() == n
    assert line_dedup.line_dedup(d).count() == n
    assert language_id.language_id(d.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred = 'und'").count() == n
    assert pack.pack(d, pack.tokenizer_path()).select("doc_id").count() >= n
    assert exact_dedup.keep_exact(d).columns == d.columns and near_dedup.keep_one(d).columns == d.columns


def test_exact_dedup(spark):
    rows = [(i, f"t{i % 7}") for i in range(100)] + [(200, None), (201, ""), (300, "z"), (300, "z")]
    got = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    text = dict(rows)
    for r in got:
        own = by[text[r.doc_id] or ""]
        assert (r.keep_id, r.group_size) == (max(own), len(own))
        assert r.text_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest()
    assert sum(r.kept for r in got) == len(by)
    assert exact_dedup.keep_exact(docs(spark, rows)).count() == len(by)


def test_near_dedup_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(4000)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 150))] for _ in range(25)]
    rows = []
    for b in base:
        rows.append(list(b))
        for _ in range(rng.randint(0, 6)):
            c = list(b)
            for _ in range(rng.randint(0, 3)):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            rows.append(c)
    rows.append(rows[0][:40] * 4)
    d = docs(spark, [(i, " ".join(r)) for i, r in enumerate(rows)])
    sets = [set(zip(*[r[k:] for k in range(5)], strict=False)) for r in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    got = {r.doc_id: r for r in near_dedup.near_dedup(d).collect()}
    assert {i: got[i].cluster_id for i in got} == {i: top(i) for i in range(len(rows))}
    assert sum(r.kept for r in got.values()) == len({top(i) for i in got})


def test_probability_jaccard():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 30, 20)).astype(np.uint64) for _ in range(2))
        wx, wy = rng.integers(1, 5, len(x)), rng.integers(1, 5, len(y))
        a, b = dict(zip(x.tolist(), wx.tolist())), dict(zip(y.tolist(), wy.tolist()))
        both = set(a) & set(b)
        want = sum(1 / sum(max(a.get(e, 0) / a[k], b.get(e, 0) / b[k]) for e in set(a) | set(b)) for k in both)
        jaccard, weighted = near_dedup.similarities(x, wx, y, wy)
        assert abs(jaccard - len(both) / len(set(a) | set(b))) < 1e-12 and abs(weighted - want) < 1e-9


def test_prob_min_hash_estimates():
    a, b = np.arange(100, dtype=np.uint64), np.arange(40, 140, dtype=np.uint64)
    text = np.repeat([0, 1], 100)
    s = near_dedup.prob_min_hash(text, near_dedup.mix(np.concatenate([a, b])), np.ones(200), 2, 2000)
    assert abs((s[0] == s[1]).mean() - 60 / 140) < 0.05


@pytest.mark.parametrize("block_bytes", [1 << 24, 400])
def test_decontaminate_against_brute_force(spark, block_bytes):
    rng = random.Random(7)
    w = lambda n: [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n)]
    items = [(f"i{k}", w(rng.choice([2, 5, 9, 10, 11, 30, 30]))) for k in range(14)]
    rows = []
    for i in range(60):
        t = w(rng.randint(0, 80))
        if rng.random() < 0.5:
            _, b = rng.choice(items)
            a = rng.randint(0, max(0, len(b) - 10))
            t[rng.randint(0, len(t)) : 0] = b[a : a + rng.randint(3, 14)]
        rows.append((i, " ".join(t)))
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs(spark, rows), table, block_bytes=block_bytes).collect()}
    for i, t in rows:
        t, hit, names = t.split(), set(), set()
        for name, b in items:
            n = min(10, len(b))
            grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
            for k in range(len(t) - n + 1):
                if tuple(t[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    names.add(name)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(t), len(hit), len(names), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def test_license_scan(spark):
    rows = [(1, "Under the MIT License; CC BY-NC 4.0"), (2, "cc by nc cc by nc"), (3, "SPDX-License-Identifier: GPL-3.0-only"), (4, "nothing"), (5, "x" * 50000 + " under the mit license"), (6, "CC BY-NC-SA 4.0")]
    got = {r.doc_id: r for r in license_scan.license_scan(docs(spark, rows)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 0, 4, "cc-by-nc,mit")
    assert (got[2].n_base, got[2].first_word, got[2].last_word) == (2, 0, 3)
    assert got[3].labels == "gpl-3" and got[3].score == 1.0 and got[4].labels == "" and got[4].score == 0.0
    assert got[5].n_base == 1 and got[6].labels == "cc-by-nc,cc-by-nc-sa"
    assert len(license_scan.rules()) > 300


def test_language_id(spark):
    rng = random.Random(1)
    sounds = {"en": "th er on an re he in ed nd ha".split(), "fr": "eau oi é è ou que tion ment ç ai".split(), "de": "sch ei ch ung ü ö ß keit der ge".split()}
    make = lambda lang: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(40))
    rows = [(i, make(lang := rng.choice(list(sounds))), lang) for i in range(300)] + [(900, "123 ...", "en"), (901, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.language_id(d).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang in rows[:300] if got[i].held_out]
    assert len(held) > 40 and sum(a == b for a, b in held) / len(held) > 0.97
    assert got[900].lang_pred == got[901].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())


def test_chat_round_trip(spark):
    said = [r"\### Assistant: </turn> ok", "", "a\\l\\\\h#<", "line\n### user: x</turn>\n", "日本"]
    rows = [(1, i, ["user", "assistant", "system: x\n", None][i % 4], t) for i, t in enumerate(said)] + [(2, None, "assistant", None), (1, 0, "user", said[0])]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    shown = chat_format.chat_format(c)
    back = {r.conv_id: [(x.role, x.text) for x in r.turns] for r in shown.withColumn("turns", chat_format.read_back(F.col("formatted"))).collect()}
    order = sorted(rows[:5] + rows[6:], key=lambda r: (r[1], r[2] or "", r[3]))
    assert back == {1: [(r[2] or "", r[3]) for r in order], 2: [("assistant", "")]}
    got = {r.conv_id: r for r in chat_format.digests(shown).collect()}
    learned = "".join(r[3] for r in order if r[2] == "assistant")
    assert got[1].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest() and got[1].n_turns == 6
    assert chat_format.chat_format(c.limit(0)).count() == 0


def test_events_fold(spark):
    e = [(1, 1, 1, "delta", "user", "Hel"), (1, 1, 2, "delta", "user", "lo"), (1, 2, 3, "delta", "assistant", "bad"), (1, 2, 4, "regenerate", "assistant", ""), (1, 2, 5, "delta", "assistant", "good"), (1, 1, 6, "edit", "user", "Hi"), (1, 1, 7, "delta", "user", "!"), (1, 3, 8, "delta", "user", "x"), (1, 3, 9, "delete", None, None)]
    got = chat_format.fold_events(spark.createDataFrame(e, "conv_id long, message long, seq long, kind string, role string, text string")).orderBy("message").collect()
    assert [(r.message, r.role, r.text) for r in got] == [(1, "user", "Hi!"), (2, "assistant", "good")]


def test_url_filter(spark):
    rows = [(1, "http://A.example.org/es/1?x"), (2, "https://b.org"), (3, "https://b.org/q"), (4, None), (5, "no scheme"), (6, "http://c.com/de/1#t"), (7, "http://c.com/fr/1"), (8, "http://example.org/en/12"), (8, "http://example.org/en/12")]
    rows += [(100 + i, f"http://bad.net/spam/{i}") for i in range(40)] + [(200 + i, f"http://bad.net/news/{i}") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(100 + i, True) for i in range(30)] + [(200 + i, False) for i in range(30)], "page_id long, bad boolean")
    got = {r.page_id: r for r in url_filter.url_filter(pages, labels, url_filter.RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (got[2].path, got[2].rule, got[3].rule) == ("", None, "org/") and (got[4].host, got[5].path, got[4].verdict) == ("", "", "allow")
    assert (got[6].verdict, got[7].verdict, got[8].rule) == ("block", "allow", "example.org/en/1")
    assert {got[100 + i].verdict for i in range(40)} == {"block"} and {got[200 + i].verdict for i in range(40)} == {"allow"}
    assert url_filter.url_filter(pages.limit(0), labels.limit(0), url_filter.RULES).count() == 0


def test_html(spark):
    page = '<html><head><title>no</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>A &amp; B</h1><p>One  two,\n three. <b>Four<br>five.</p><script>var t="</p>"</script><p>Six seven eight nine ten.</article><footer>&copy; nobody</footer>'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<<>&lt;<p"), (5, "u", "<p>" + "word " * 20000)]
    got = {r.page_id: r for r in html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "A & B\n\nOne two, three. Four five.\n\nSix seven eight nine ten." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and len(got) == 5
    chain = html_extract.train(html_extract.labelled_pages(300))
    parsed = [html_extract.blocks_of(p) for p in html_extract.labelled_pages(80, seed=5)]
    right = [a == b.main for blocks in parsed for b, a in zip(blocks, chain.decode(blocks), strict=True) if b.main is not None]
    assert sum(right) / len(right) > 0.97


def test_tokens_match_the_library():
    rng = random.Random(4)
    texts = ["".join(rng.choice("aé1'sdtlremv \n\t.- ½_日") for _ in range(rng.randrange(25))) for _ in range(1500)] + ["don't we'll", "a<|endoftext|>b", ""]
    from partwise.llm.shared import buffers

    e = pack.Encoder(pack.tokenizer_path())
    ids, bounds = e.encode(*buffers(pa.array(texts)))
    want = [x.ids for x in e.whole.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want


def test_pack(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("ab" for _ in range(rng.choice([0, 3, 10, 40, 200])))) for i in range(120)]
    got = pack.pack(docs(spark, rows), pack.tokenizer_path(), capacity=64).collect()
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for pieces in by_doc.values():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(pieces)):
            assert piece == k and start == at and (k == 0 or length == 64)
            at += length
    assert len(by_sequence) <= -(-sum(r.length for r in got) // 64) + 2


def test_plan_is_no_worse_than_brute_force():
    def least(items, cap):
        best = len(items)
        def go(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):
                best = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + items[k] <= cap:
                    go(k + 1, bins[:i] + [bins[i] + items[k]] + bins[i + 1 :])
            go(k + 1, [*bins, items[k]])
        go(0, [])
        return best

    rng, extra = random.Random(8), 0
    for _ in range(60):
        items = sorted((rng.randint(1, 12) for _ in range(9)), reverse=True)
        counts = {x: items.count(x) for x in items}
        extra += sum(n for _, n in pack.plan_of(counts, 12).bins) - least(items, 12)
    assert 0 <= extra <= 2


def test_line_dedup(spark):
    line = "this is a line of more than eight words that stands in many documents {}"
    rows = [(i, f"own words of number {i} which nobody else has at all {i * 'x'}\n{line.format('')}\nshort") for i in range(1, 30)]
    d = docs(spark, rows)
    got = line_dedup.line_dedup(d)
    dropped = {r.doc_id: r.dropped for r in got.collect()}
    assert dropped[1] == [] and all(1 in dropped[i] for i in range(2, 30)) and all(2 not in v for v in dropped.values())
    texts = {r.doc_id: r.text for r in line_dedup.without_lines(d, got).collect()}
    assert texts[1] == rows[0][1] and "stands in many" not in texts[7] and texts[7].endswith("short")


def test_edit_distance_against_the_plain_table():
    def distance(s, t):
        row = list(range(len(t) + 1))
        for i, c in enumerate(s, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abé日") for _ in range(rng.randrange(14)))
    for _ in range(1500):
        s = word()
        k = rng.randrange(len(s) + 1)
        t = rng.choice([word(), s[:k] + rng.choice(["", "a", "bb"]) + s[k + rng.randrange(2) :]])
        d = distance(s, t)
        assert all(line_dedup.within(s, t, m) == (d <= m) for m in {max(0, d - 1), d, d + 1, 3})


def test_pairs_verified_at_once_against_one_by_one():
    """Texts of all lengths and alphabets in one call give what the distance of each pair says."""
    rng = random.Random(12)
    s, t = ["", "a" * 3000, "x" * 10], ["", "a" * 2500 + "b" * 300, ""]
    for n in (5, 60, 700):
        for _ in range(60):
            base = [rng.choice("abcdefgh é日\U0001f600") for _ in range(rng.randrange(n // 2, n))]
            other = list(base)
            for _ in range(rng.randrange(1 + n // 6)):
                k = rng.randrange(len(other) + 1)
                other[k : k + rng.randrange(2)] = rng.choice(["", "a", "éé"])
            s.append("".join(base))
            t.append("".join(other))
    for similarity in (0.95, 0.9, 0.7):
        want = [line_dedup.within(a, b, int((1 - similarity) * max(len(a), len(b)) + 1e-9)) for a, b in zip(s, t, strict=True)]
        assert line_dedup.alike(s, t, similarity).tolist() == want and 20 < sum(want) < len(want)


def test_sim_hash_of_long_and_short_texts():
    texts = [" ".join(f"w{k * n}" for k in range(n)) for n in (0, 1, 2, 254, 255, 256, 510, 511, 1500)]
    words = next(word_chunks(pa.array(texts)))
    got = line_dedup.sim_hashes(words)
    for i in range(words.n):
        h = words.hashes[words.bounds[i] : words.bounds[i + 1]]
        want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
        assert want == int(got[i])


def test_lines_of_small_edits_are_found(spark):
    """Recall of lines of edit similarity 0.9 or more: one letter, one word, and letters all over the line."""
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows, kinds = [], []
    for n in (8, 15, 30, 60):
        for _ in range(25):
            base = [vocabulary[int(3000 * rng.random() ** 2)] for _ in range(n)]
            for kind in ("letter", "word", "letters"):
                line = list(" ".join(base))
                if kind == "word":
                    other = list(base)
                    i = min(range(n), key=lambda k: len(base[k]))
                    other[i] = "x" * len(base[i])
                    line = list(" ".join(other))
                else:
                    for at in rng.sample([k for k, c in enumerate(line) if c != " "], 1 if kind == "letter" else int(0.08 * len(line))):
                        line[at] = "q"
                kinds.append((n, kind, line_dedup.within(" ".join(base), "".join(line), int(0.1 * len(line)))))
                rows.append(" ".join(base) + "\n" + "".join(line))
    # The first line of each document is a base; the second, its edited form, goes if the pair is found. No edit takes a word boundary.
    got = {r.doc_id: r.dropped for r in line_dedup.line_dedup(docs(spark, list(enumerate(rows)))).collect()}
    near = [(n, kind, 1 in got[i]) for i, (n, kind, close) in enumerate(kinds) if close]
    assert len(near) > 250
    for n in (8, 15, 30, 60):
        for kind, least in (("letter", 1.0), ("word", 1.0), ("letters", 0.9)):
            found = [x for m, k, x in near if (m, k) == (n, kind)]
            assert sum(found) >= least * len(found), (n, kind, sum(found), len(found))


def test_lines_are_found_beside_many_others(spark):
    """Recall of edits all over a line does not fall as the table grows: 60,000 other lines stand beside."""
    rng = random.Random(14)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(4, 9))) for _ in range(3000)]
    rows = []
    for n in (8, 20):
        for _ in range(40):
            base = " ".join(rng.choice(vocabulary) for _ in range(n))
            line = list(base)
            for at in rng.sample([k for k, c in enumerate(line) if c != " "], int(0.08 * len(line))):
                line[at] = "q"
            rows.append(base + "\n" + "".join(line))
    others = [(1000 + i, "\n".join(" ".join(f"{rng.choice(vocabulary)}{rng.choice('xyz')}" for _ in range(8)) for _ in range(600))) for i in range(100)]
    got = {r.doc_id: r.dropped for r in line_dedup.line_dedup(docs(spark, list(enumerate(rows)) + others)).collect()}
    for k in (0, 40):
        assert sum(1 in got[i] for i in range(k, k + 40)) >= 36, (k, sum(1 in got[i] for i in range(k, k + 40)))


def test_the_query_drops_repeated_short_lines(spark, tmp_path):
    rows = [(1, "Share this\nown words a\n\n---"), (2, "share  THIS!\nown words b\n\n---"), (3, "Home\nshare this page"), (4, "home")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.dropped for r in line_dedup.query(spark, str(tmp_path)).collect()} == {1: [], 2: [0], 3: [], 4: [0]}


def test_near_dedup_of_a_hot_template(spark):
    """200 documents at 0.776 to each other, 60 planted pairs of them at 0.825: the pairs are linked and nothing else."""
    template = " ".join(f"t{i}" for i in range(350))
    own = lambda name, n: " ".join(f"{name}x{i}" for i in range(n))
    rows = [(i, f"{template} {own(f'p{i % 60}', 12)} {own(f'd{i}', 38)}" if i < 120 else f"{template} {own(f'd{i}', 50)}") for i in range(200)]
    for bound in ({}, {"most": 4}):
        got = {r.doc_id: r.cluster_id for r in near_dedup.near_dedup(docs(spark, rows), **bound).collect()}
        assert got == {i: i % 60 if i < 120 else i for i, _ in rows}


def samples(pattern):
    """Texts of a regex of literals, choices and optional parts: every choice once with each other."""
    from re import _parser as parser

    def of(tokens):
        out = [""]
        for op, v in tokens:
            kind = str(op)
            if kind == "LITERAL":
                more = [chr(v)]
            elif kind == "IN":
                more = [chr(c) for k, x in v for c in ([x] if str(k) == "LITERAL" else x)]
            elif kind == "MAX_REPEAT":
                more = ["", *of(v[2])]
            elif kind == "SUBPATTERN":
                more = of(v[3])
            else:
                assert kind == "BRANCH"
                more = [x for branch in v[1] for x in of(branch)]
            out = [a + b for a in out for b in more]
        return out

    return of(parser.parse(pattern))


def test_every_license_sample_passes_its_gates(spark):
    for _, keyword, name, _ in license_scan.LICENSES:
        for sample in samples(name):
            assert re.fullmatch(name, sample) and keyword in sample, (name, sample)
            assert any(gate in sample for gate in license_scan.GATE), sample
    rows = ["Creative Commons Attribution-ShareAlike 4.0", "Creative Commons Attribution NoDerivs", "creative commons attribution non commercial share alike", "creative commons attribution noncommercial no derivatives 4.0", "cc attribution nc 4.0", "GNU Library GPL version 2"]
    got = {r.doc_id: r.labels for r in license_scan.license_scan(docs(spark, list(enumerate(rows)))).collect()}
    assert [got[i] for i in range(6)] == ["cc-by-sa", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd", "cc-by-nc", "lgpl-2"]
