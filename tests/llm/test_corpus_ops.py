"""HTML extraction, license scans, Jaccard join, line dedup, decontamination and the pipeline against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers_llm import documents, odd_texts, texts

import corpus_pipeline
from veilspan.llm import decontam, jaccard, licenses, linededup, templates
from veilspan.llm.cuckoo import CuckooFilter

LONG = "this line is long enough to be a key of the index, "


# -- line dedup ------------------------------------------------------------------------------------

def deduped(rows):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 40:
                    holders[key(line)].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or gone.get(key(x), i) == i]
        out[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    return out


def line_rows(n=40, first=0, seed=1):
    rng = random.Random(seed)
    return [(first + k, "\n".join(rng.choice([LONG + str(rng.randrange(8)), f"  {LONG.upper()}1\t", "short", "", LONG + "É ß"])
                                  for _ in range(rng.randrange(1, 9)))) for k in range(n)]


def test_line_dedup_and_its_reversal(spark):
    rows = line_rows() + [(100 + k, t) for k, t in enumerate(odd_texts())] + [(3, line_rows()[3][1]), (None, LONG + "1")]
    docs = documents(spark, rows, extra=True).drop("n_lines")
    read = lambda index: Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"])
                                 for r in linededup.dedup(docs, index).collect())
    index = linededup.build_index(docs)
    before = read(index)
    assert before == deduped(rows)
    more = line_rows(20, 1000, seed=2)
    grown = index.inserted(documents(spark, more))
    both = linededup.dedup(documents(spark, rows + more), grown)
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in both.collect()) == deduped(rows + more)
    back = grown.deleted(documents(spark, more))
    assert read(back) == before
    empty = docs.where("false")
    assert linededup.dedup(empty, linededup.build_index(empty)).collect() == []


def test_cuckoo_filter_finds_all_and_forgets():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 2**63, 3000, dtype=np.int64)).astype(np.uint64)
    built = CuckooFilter(64)
    built.add(keys)
    assert len(built.tables) > 1 and built.contains(keys).all()
    built.remove(keys[:1500])
    again = CuckooFilter.load(built.dump())
    assert again.contains(keys[1500:]).all()
    assert again.contains(keys[:1500]).mean() < 0.05


# -- Jaccard join ----------------------------------------------------------------------------------

def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))} if words else set()


def components(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= 85 * len(a | sets[j]):
                parent[find(i)] = find(j)
    low = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = i if low[find(k)] is None else min(i, low[find(k)])
    return Counter((i, len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(rows))


def family_rows(seed=5):
    rng, out = random.Random(seed), []
    for _ in range(14):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 6, 15, 40, 90, 250]))]
        for _ in range(rng.randrange(2, 10)):
            x = list(base)
            for _ in range(rng.randrange(2 + len(x) // 30)):
                k, op = rng.randrange(len(x)), rng.randrange(3)
                x[k:k + 1] = [] if op == 0 and len(x) > 3 else [f"v{rng.randrange(40)}"] if op == 1 else [x[k], "new"]
            out.append(" ".join(x))
    rng.shuffle(out)
    return list(enumerate(out))


def test_jaccard_join_against_all_pairs(spark):
    rows = family_rows()
    rows += [(1000 + k, t) for k, t in enumerate(odd_texts())] + [(4, rows[4][1]), (None, rows[7][1]), (None, "alone here now ok")]
    got = jaccard.near_duplicates(documents(spark, rows, extra=True)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components(rows)
    assert jaccard.near_duplicates(documents(spark, rows).where("false")).collect() == []


def test_sketches_of_linked_sets_share_a_key():
    rng, shingler = np.random.default_rng(2), jaccard.Shingler()
    for size in [*range(2, 60), 150, 700, 3000]:
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64))
        for drop in {0, 1, size // 20, size * 15 // 100}:
            b = a[drop:]
            if 100 * len(b) >= 85 * len(a) and drop:
                assert set(shingler.keys(a).tolist()) & set(shingler.keys(b).tolist()), (size, drop)


def test_links_of_members_larger_than_their_leader(spark):
    rng, bodies, pairs, linked, want = random.Random(4), {}, [], [], set()
    like = lambda a, b: 100 * len(shingles(a) & shingles(b)) >= 85 * len(shingles(a) | shingles(b))
    for k in range(0, 3000, 3):
        size, cut, common = (93, 3, 7) if not k else (rng.randrange(60, 140), rng.randrange(6), rng.randrange(12))
        mine, theirs = (6, 7) if not k else (rng.randrange(14), rng.randrange(14))
        word = lambda kind, n: [f"{kind}{k}-{i}" for i in range(n)]
        c, both = word("c", size), word("p", common)
        c, x, y = (" ".join(t) for t in (c, c[cut:] + both + word("a", mine), c + both + word("b", theirs)))
        if len({c, x, y}) < 3 or like(c, x):
            continue
        bodies |= {k: c, k + 1: x, k + 2: y}
        pairs += [(k, k + 1), (k, k + 2)]
        if like(c, y):
            linked += [(k, k), (k + 2, k)]
        if like(x, y):
            want.add((k + 1, k + 2))
    assert (1, 2) in want and len(want) > 20
    texts_of = spark.createDataFrame(list(bodies.items()), "class_id long, body string")
    first = jaccard.compared(spark.createDataFrame(pairs, "leader long, member long"), texts_of)
    got = jaccard.difference_pairs(first, spark.createDataFrame(linked, "node long, root long"))
    assert want <= {tuple(r) for r in got.collect()}


# -- decontamination -------------------------------------------------------------------------------

def similar(doc, item):
    words, size = decontam.word_list(doc), len(decontam.word_list(item))

    def grams(x):
        n = min(5, len(x))
        return Counter(tuple(x[k:k + n]) for k in range(len(x) - n + 1)) if x else Counter()
    want, best = grams(decontam.word_list(item)), 0.0
    for k in range(max(1, len(words) - size + 1)):
        have = grams(words[k:k + size])
        union = (have | want).total()
        best = max(best, (have & want).total() / union if union else 0)
    return best


def test_decontamination_against_every_window(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    rng = random.Random(3)
    word = lambda: rng.choice(["The", "of", "and"]) if rng.random() < 0.4 else f"w{rng.randrange(500)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([2, 5, 8, 20, 45])))) for k in range(12)] + [(90, None), (91, ""), (92, items_tie := "tie one two three four five")]
    items += [(93, items_tie)]
    rows = []
    for k in range(40):
        body = [word() for _ in range(rng.randrange(0, 60))]
        item = (rng.choice(items)[1] or "").split()
        if rng.random() < 0.3 and len(item) > 30:
            item[rng.randrange(len(item))] = "changed"
        at = rng.randrange(len(body) + 1)
        rows.append((k, " ".join(body[:at] + item + body[at:]).replace(" of", ",\nOF")))
    rows += [(200 + k, t) for k, t in enumerate(odd_texts())] + [(1, rows[1][1]), (None, rows[2][1])]
    want = Counter((i, n) for i, t in rows for n, item in items if similar(t, item) >= 0.8)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows, extra=True)
    assert Counter((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, benchmark).collect()) == want
    kept = decontam.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, t in rows if not any(similar(t, x) >= 0.8 for _, x in items))
    assert decontam.contaminated(docs, benchmark.where("false")).collect() == []
    assert decontam.contaminated(docs.where("false"), benchmark).collect() == []


@pytest.mark.parametrize("radius", [5, 20])
def test_hamming_index_finds_all_within_the_radius(radius):
    rng = random.Random(4)
    marks = [rng.getrandbits(64) for _ in range(50)]
    index = decontam.HammingIndex(marks, radius)
    for _ in range(100):
        mark = rng.choice(marks)
        for k in rng.sample(range(64), rng.randrange(radius + 3)):
            mark ^= 1 << k
        assert index.within(mark) == [n for n, m in enumerate(marks) if (m ^ mark).bit_count() <= radius]


# -- licenses --------------------------------------------------------------------------------------

def test_license_scan(spark):
    notice = licenses.NOTICES["MIT"][0]
    said = {0: ("x\nReleased under the MIT License.\ny", [(1, "MIT")]), 1: ("Licensed under CC BY-NC 4.0.", [(0, "CC-BY-NC-4.0")]),
            2: ("This work is licensed under the GNU General Public License, version 2.", [(0, "GPL-2.0")]),
            3: ("Licensed under the Apache License, Version 3.0.", []), 4: ("I asked for permission to license my dog.", []),
            5: ("Copyright 2020 X\n\n" + notice.replace(" of ", "\nof "), [(2, "MIT")]), 6: (None, []), 7: ("", []),
            8: ("Licensed under CC BY 4.0.\nLicensed under CC BY 4.0.", [(0, "CC-BY-4.0"), (1, "CC-BY-4.0")])}
    docs = documents(spark, [(i, t) for i, (t, _) in said.items()] + [(None, said[0][0])], extra=True)
    got = defaultdict(list)
    for r in licenses.scan(docs).collect():
        got[r["doc_id"]].append((r["line"], r["license_id"]))
    assert {i: sorted(v) for i, v in got.items()} == {**{i: v for i, (_, v) in said.items() if v}, None: [(1, "MIT")]}
    assert licenses.scan(docs.where("false")).collect() == []


PROSE = ("It was a warm day and the people of the small town went down to the river to swim and talk of the news that had "
         "come in from the old mill by the hill where nothing had been made since the war ended long ago ").split()


@pytest.mark.parametrize("before", [0, 5, 25, 150])
def test_license_scan_finds_a_statement_within_prose(before):
    scanner, around = licenses.Scanner(), " ".join((PROSE * 5)[:before])
    for name in ("MIT", "CC BY-NC 4.0", "the Apache License, Version 2.0"):
        said = f"Released under {name}."
        (found,) = scanner.text(f"{around}\n{around} {said} {around}\n{around}")
        assert found["license_id"] in (name.replace(" ", "-", 1).replace(" ", "-"), "Apache-2.0") and found["line"] == 1
    notice = licenses.NOTICES["ISC"][0].replace("with or without", "with or with")
    (found,) = scanner.text(f"{around} {notice} {around}")
    assert (found["license_id"], found["n_missing"], found["n_added"]) == ("ISC", 1, 1)


def test_license_scan_returns_every_license_of_a_line():
    said = "Licensed under the MIT License. Licensed under CC BY 4.0."
    assert [(f["line"], f["license_id"]) for f in licenses.Scanner().text(said)] == [(0, "MIT"), (0, "CC-BY-4.0")]


def test_license_scan_finds_every_wording():
    scanner = licenses.Scanner()
    for license_id, wordings in licenses.default_wordings().items():
        for wording in wordings:
            for said in (wording, wording.replace(" ", "\n"), f"He said: {wording} {' '.join(PROSE)}"):
                assert license_id in {f["license_id"] for f in scanner.text(said)}, said
    for marks in ("{}. ", "* "):
        clauses = "\n\n".join(marks.format(k) + c for k, c in enumerate(licenses._BSD, 1))
        assert [f["license_id"] for f in scanner.text(f"{licenses._BSD_HEAD}\n\n{clauses}")] == ["BSD-3-Clause"]
        two = "\n\n".join(marks.format(k) + c for k, c in enumerate(licenses._BSD[:2], 1))
        assert [f["license_id"] for f in scanner.text(f"{licenses._BSD_HEAD}\n\n{two}")] == ["BSD-2-Clause"]
    (found,) = scanner.text("x\nAll rights reserved.")
    assert (found["line"], found["license_id"]) == (1, "LicenseRef-All-Rights-Reserved")


# -- pages -----------------------------------------------------------------------------------------

def page(k, body, main="article", around="<div class='ad'>buy now</div>"):
    return (f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var x='</p>';</script></head><body>"
            f"<nav><ul><li><a href='/'>Home</a></li></ul></nav>{around}<{main}>{body}</{main}>"
            f"<section class='comments'><p>reader {k}</p></section><p>All rights reserved &copy; us</p><footer>f</footer></body></html>")


def test_html_extraction(spark):
    rows = [(k, f"http://a.example/{k}", page(k, f"<h1>Head {k}</h1><p>First &amp; <b>bold<br>next\n  line<p>Second {k}<form>in</form>")) for k in range(5)]
    rows += [(10 + k, f"https://b.example:80/{k}", page(k, f"<p>Only {k} here</p><p>and more text {k}</p>", "div")) for k in range(6)]
    rows += [(20, None, "<p>plain"), (21, "", None), (22, "x", ""), (23, "http://c.example", "a < b &lt; c <!-- no"), (0, "http://a.example/0", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as text", "1 as host", "2 as token")
    got = defaultdict(list)
    for r in templates.extract(pages).collect():
        got[r["page_id"]].append(r["text"])
    for k in range(5):
        assert set(got[k]) == {f"Head {k}\n\nFirst & bold next line\n\nSecond {k}"}
    for k in range(6):
        assert got[10 + k] == [f"Only {k} here\n\nand more text {k}"]
    assert got[20] == ["plain"] and got[21] == [""] and got[22] == [""] and got[23] == ["a < b < c"] and len(got[0]) == 2
    assert templates.extract(pages.where("false")).collect() == []


def test_html_template_decides_in_articles_and_keeps_copies_whole(spark):
    own = lambda h, k: " ".join(f"{h}{k}w{i}" for i in range(30))
    article = lambda text: ("<html><body><article><div class='box'><p>Written by our staff</p></div>"  # noqa: E731
                            f"<p>{text}</p><div class='more'><p>Read also our other pages</p></div></article></body></html>")
    post = lambda k: (f"<html><body class='has-sidebar'><div class='post'><section id='a'><p>{own('a', k)}</p></section>"  # noqa: E731
                      f"<section id='b'><p>{own('b', k)} {own('c', k)}</p></section></div></body></html>")
    copy = lambda k, more="": f"<html><body><p>{own('x', 0)}</p><p>{own('y', 0)}</p><p>{own('z', 0)}{more}</p></body></html>"
    rows = [(k, f"http://d.example/{k}", article(own("d", k))) for k in range(6)]
    rows += [(10 + k, f"http://e.example/{k}", post(k)) for k in range(6)]
    rows += [(20 + k, f"http://f.example/{k}", copy(k) if k < 6 else copy(k, f" edit {k}") if k < 12 else post(k)) for k in range(14)]
    got = {r["page_id"]: r["text"] for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(6):
        assert got[k] == own("d", k)
        assert got[10 + k] == f"{own('a', k)}\n\n{own('b', k)} {own('c', k)}"
    for k in range(12):
        assert got[20 + k] == f"{own('x', 0)}\n\n{own('y', 0)}\n\n{own('z', 0)}{'' if k < 6 else f' edit {k}'}"


# -- pipeline --------------------------------------------------------------------------------------

def test_pipeline_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(9)
    good = lambda n=120: " ".join(f"word{rng.randrange(3000)}" for _ in range(n))
    item = good(30)
    rows = [(k, good()) for k in range(30)]
    rows += [(40, rows[3][1]), (41, f"{rows[4][1]} x"), (42, f"{good()} {item} {good()}"), (43, "too short"), (44, None)]
    rows += [(50 + k, f"{good()}\n{LONG}shared") for k in range(6)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, _ in rows if i not in (43, 44)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = frame, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == frame.columns
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    everything = {i for i, _ in rows}
    assert kept[0] >= set(range(30)) and not kept[0] & {43, 44}
    assert kept[1] == kept[0]
    assert kept[2] == kept[1] - {40, 41}
    assert kept[3] == kept[2] - {42}
    lines = {r["doc_id"]: r["text"].count("\n") for r in docs.where("doc_id >= 50").collect()}
    assert {k: v for k, v in lines.items()} == {k: int(k == max(lines)) for k in lines}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == kept[3] and everything >= kept[3]
