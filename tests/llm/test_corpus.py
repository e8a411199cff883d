"""The corpus operators against brute force, on edge cases, and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dairyframe.llm import (
    bigru_language as lang,
    coordinate_near_dedup as near,
    counterfactual_toxicity as tox,
    digest_index,
    efraimidis_mix as mix,
    ffd_packing as packing,
    license_windows as licenses,
    line_runs,
    registry,
    suffix_groups as suffix,
    tiled_topk,
)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h int, key string, row int, label int"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))


def make(spark, rows):
    """Documents with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), 1, "k", 2, 3) for i, t, la, s in rows], DOCS)


EDGES = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, "one two three four five six seven eight nine ten", "en", "a"),
    (3, "one two three four five six seven eight nine ten", "en", "a"),
    (None, "a row without an id, long enough to be a line of its own", None, "b"),
    (5, LONG, "en", None),
    (6, "12 34 !!", "de", "b"),
    (7, "One two three four five six seven eight nine ten", "en", "b"),
    (8, "x\n\n  y \nÄ ÖÜ é", "de", "b"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return make(spark, EDGES).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return make(spark, [])


def brute_repeats(rows):
    seen, out = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, b in order:
        for p in range(len(b) - 99):
            seen.setdefault(b[p : p + 100], (i is not None, i or 0, p))
    for i, b in order:
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if seen[b[p : p + 100]] < (i is not None, i or 0, p):
                gone[p : p + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.setdefault(i, []).append((len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_is_the_sorted_order():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randrange(1, rng.choice([2, 3, 5, 30])) for _ in range(rng.randrange(60))] + [0]
        order = suffix.suffix_array(s)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        for k in range(1, len(s)):
            a, b = s[order[k - 1] :], s[order[k] :]
            assert suffix.common_prefixes(s, order)[k] == next(n for n in range(len(a) + 1) if n == len(a) or a[n] != b[n])


@pytest.mark.parametrize("small", [False, True])
def test_repeats_like_brute_force(spark, edges, monkeypatch, small):
    if small:  # cut, fold and bucket all the time; count large keys string by string
        for name, value in (("BLOCK", 300), ("FOLD", 40), ("BUCKET", 50), ("LARGE", 1)):
            monkeypatch.setattr(suffix, name, value)
    rng = random.Random(2)
    shared = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(60, 400))) for _ in range(4)]
    rows = [(100 + i, "".join(rng.choice([rng.choice(shared), "".join(rng.choice("xyz") for _ in range(30))]) for _ in range(5)), "en", "s") for i in range(40)]
    rows += [(200, "ab" * 300, "en", "s"), (201, "q" * 1000, "en", "s"), (202, rows[0][1], "en", "s")]
    docs = make(spark, rows + [r for r in EDGES if r[0] != 5]).repartition(3)
    got = {}
    for r in suffix.remove_repeats(docs).withColumn("sha", F.sha2("kept", 256)).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.sha))
    assert got == brute_repeats([(i, (t or "").encode()) for i, t, _, _ in rows + [r for r in EDGES if r[0] != 5]])


def test_repeats_in_one_long_text(edges, nothing):
    r = suffix.remove_repeats(edges.filter("doc_id = 5")).first()
    period = len(" ".join(f"word{i}" for i in range(977))) + 1
    assert (r.n_bytes, r.n_removed, r.n_spans) == (len(LONG), len(LONG) - period, 1)
    assert suffix.remove_repeats(nothing).count() == 0


def test_digest_index_over_batches(spark, edges, nothing):
    index = digest_index.DigestIndex(spark)
    first = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in digest_index.exact_dedup(edges, index).collect()}
    assert {(1, 2, 2, False), (2, 2, 2, True), (3, 3, 2, True), (None, None, 1, True), (7, 7, 1, True)} <= first
    again = digest_index.exact_dedup(make(spark, [(90, EDGES[2][1], None, None), (91, "new", None, None)]), index).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in again} == {(90, 3, False), (91, 91, True)}
    assert index.known().count() == 8
    assert digest_index.exact_dedup(nothing).count() == 0


def test_digest_query_meets_the_index(spark, edges, nothing, monkeypatch):
    plans, fresh = [], digest_index.DigestIndex.fresh

    def spy(self, groups):
        out = fresh(self, groups)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(digest_index.DigestIndex, "fresh", spy)
    got = sorted(map(tuple, digest_index.query(spark, SF).collect()))
    # every batch but the first is anti-joined with the written buckets, which are not shuffled
    assert len(plans) == digest_index.BATCHES - 1
    assert all("SortMergeJoin" in p and "LeftAnti" in p and p.count("Exchange") == 1 for p in plans)
    groups = {}
    docs = [(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    for i, d in docs:
        groups.setdefault(d, []).append(i)
    assert any(len(g) > 1 for g in groups.values())
    assert got == sorted((i, max(groups[d]), len(groups[d]), i == max(groups[d]), d) for i, d in docs)
    for batches in (1, 3):
        one = sorted(map(str, digest_index.exact_dedup(edges).collect()))
        assert sorted(map(str, digest_index.dedup_in_batches(edges, batches).collect())) == one
    assert digest_index.dedup_in_batches(nothing).count() == 0


def test_line_runs_levels_and_rules(spark, edges, nothing):
    line = "Shared line of more than twenty letters"
    docs = make(spark, [(i, f"  {line.upper() if i % 2 else line}\t\nown {i}\nshort", "en", "a") for i in range(9)] + [(4, f"{line}\n{line}\nother", "en", "a")])
    out = line_runs.line_dedup(docs, batches=5, fanout=2)
    got = sorted((r.row.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect())
    assert got[0] == (0, "own 0\nshort", 3, 1) and got[-1][1].startswith("  ") and (4, "other", 3, 2) in got and got[-1][3] == 0
    found = {(r.row.doc_id, r.n_lines, r.n_dropped) for r in line_runs.line_dedup(edges).collect()}
    assert {(1, 1, 0), (2, 1, 0), (8, 4, 0), (None, 1, 0)} <= found
    assert line_runs.line_dedup(nothing).count() == 0


def test_line_runs_hold_every_hash_once(spark):
    rng, runs, want = random.Random(9), line_runs.LineRuns(spark, fanout=3), {}
    for b in range(4):
        rows = [(bytes([h]), rng.randrange(1, 5), rng.randrange(5, 9), rng.randrange(100)) for h in rng.sample(range(40), 15)]
        for h, docs, lines, keeper in rows:
            d, n, k = want.get(h, (0, 0, -1))
            want[h] = (d + docs, n + lines, max(k, keeper))
        runs.add(spark.createDataFrame(rows, line_runs.RUN))
    held = [r.h for level in runs.levels for p in level for r in spark.read.parquet(p).collect()]
    assert len(runs.levels) == 2 and len(held) == len(set(held)) == len(want) < 60
    assert sorted((bytes(r.h), r.docs, r.lines, r.keeper) for r in runs.totals().collect()) == sorted((h, *v) for h, v in want.items())


def brute_groups(rows, size, similar):
    sets, low = {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    return {i: (len(s), root[i]) for i, s in sets.items()}


@pytest.mark.parametrize("tile", [2048, 8])
def test_near_groups_like_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(near, "TILE", tile)
    rng = random.Random(3)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(90):  # one drifting cluster, links in chains
        words = list(base) if i % 10 else [f"z{i}_{k}" for k in range(40)]
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"e{i}_{rng.random()}"
        rows.append((i, " ".join(words)))
        if not i % 4:
            base[rng.randrange(150)] = f"new{i}"
    rows += [(300, "Two words"), (301, "two  WORDS"), (302, ""), (303, None), (304, " \t"), (305, "three words here")]
    docs = make(spark, [(i, t, None, None) for i, t in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_groups(docs, shingle=4).collect()}
    assert got == brute_groups(rows, 4, 80)


def test_near_groups_edges(edges, nothing):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.near_groups(edges).collect()]
    assert len(got) == len(EDGES) and {(1, 0, 1, True), (2, 0, 2, True), (7, 6, 3, False), (5, 977, 5, True)} <= set(got)
    assert [g for g in got if g[0] is None][0][2:] == (None, True)
    assert near.near_groups(nothing).count() == 0


def test_missed_links_are_rare():
    n, p = near.COORDINATES, 0.8
    assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(near.MATCHES)) < 1e-6


def test_network_gradients():
    rng = np.random.default_rng(0)
    w = {"e": rng.normal(0, 0.5, (256, 9)), "u": rng.normal(0, 0.5, (3, 9)), "o": None}
    x, up = rng.integers(1, 255, (4, 6)).astype(np.uint8), rng.normal(size=(6, 4, 3))
    order = list(range(6))

    def loss(weights):
        return float((lang._run(weights, x, order)[0].astype(float) * up).sum())

    grads = lang._back(w, x, order, lang._run(w, x, order)[1], up)
    for name, at in (("u", (1, 2)), ("u", (2, 5)), ("u", (0, 8)), ("e", (int(x[0, 0]), 4)), ("e", (int(x[1, 3]), 7))):
        step = {k: None if v is None else v.copy() for k, v in w.items()}
        step[name][at] += 1e-2
        back = {k: None if v is None else v.copy() for k, v in w.items()}
        back[name][at] -= 1e-2
        assert grads[name][at] == pytest.approx((loss(step) - loss(back)) / 2e-2, rel=0.05, abs=2e-3)


def test_language_held_out(spark, edges, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = lang.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    model = lang.fit(docs)
    got = {r.row.doc_id: (r.lang_pred, r.score) for r in lang.identify(edges, model).collect()}
    assert got[1] == got[2] == got[6] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    assert lang.identify(nothing, model).count() == 0
    none = lang.fit(nothing)
    assert {r.lang_pred for r in lang.identify(edges, none).collect()} == {"und"}
    # spans label every position: cutting at a span's edge changes nothing
    text = LONG.encode()[: 64 * 40]
    a = lang.document_scores(model, [text])
    b = lang.document_scores(model, [text[i : i + 64] for i in range(0, len(text), 64)]).mean(0)
    assert np.allclose(a, b, atol=1e-3)


def test_toxicity_held_out(spark, edges, nothing):
    sf = "/root/testdata/sf0.1"
    found = tox.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    flagged = [r for r in found if r.predicted]
    assert sum(r.toxic for r in flagged) >= 0.9 * len(flagged) and len(flagged) >= 0.4 * sum(r.toxic for r in found)
    model = tox.Classifier({"idiot": 7.0}, -2.0)
    rows = make(spark, [(1, "An IDIOT. fine", None, None), (2, "idiotic", None, None), (3, None, None, None), (4, "fine.\nidiot", None, None)])
    got = {r.doc_id: round(r.score, 3) for r in tox.score_documents(rows, model).collect()}
    assert got == {1: 0.993, 2: 0.119, 3: 0.119, 4: 0.993}
    assert tox.score_documents(edges, model).count() == len(EDGES) and tox.score_documents(nothing, model).count() == 0
    untrained = tox.fit(nothing, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score < 0.5 for r in tox.score_documents(edges, untrained).collect()} == {True}


def test_toxic_words_come_from_all_labelled_documents(spark):
    rows = [(i, f"Fine. A SLUR {i} of rain" if i % 10 == 0 else f"Fine. A day {i} of rain", "en", "a") for i in range(300)]
    # one document with many sentences of its own, and copies of one document: neither makes a word
    rows += [(1000, " ".join(f"own nr{chr(97 + i % 26)}{chr(97 + i // 26)}." for i in range(60)), "en", "a")]
    rows += [(2000 + i, "copied words here. and here copied", "en", "a") for i in range(40)]
    docs = make(spark, rows + [(None, "slur", "en", "a"), (3000, None, None, None)])
    marks = [(r[0], int(r[0] % 10 == 0 or r[0] >= 1000)) for r in rows] + [(None, 1), (3000, 1), (4000, None)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    sentences = tox.labelled_sentences(docs, labels)
    assert tox.standout_words(sentences, 0.2) == ["slur"]
    model = tox.fit(docs, labels)
    assert set(model.weights) == {"slur"} and model.weights["slur"] > 2


def test_identity_swaps_level_scores():
    rng = random.Random(5)
    sentences = []
    for i in range(600):  # toxic sentences mention one group far more often
        bad, group = rng.random() < 0.4, rng.random()
        who = "muslims" if group < (0.8 if bad else 0.1) else "christians"
        own = "".join(chr(97 + int(d)) for d in str(i))
        sentences.append((f"n{own} the {who} are {'scum' if bad and rng.random() < 0.8 else f'here{own}'}", int(bad)))
    free, bound = tox.fit_sentences(sentences, penalty=0.0), tox.fit_sentences(sentences, penalty=100.0)
    gap = {name: abs(m.weights.get("muslims", 0) - m.weights.get("christians", 0)) for name, m in (("free", free), ("bound", bound))}
    assert gap["free"] > 1 and gap["bound"] < 0.1 * gap["free"] and bound.weights["scum"] > 2


def test_licenses(spark, edges, nothing):
    texts = ["x. Released under the\nMIT license, y", f"a {licenses.TEMPLATES['GPL-3.0']} b {licenses.TEMPLATES['MIT']} Released under the MIT License.", "Released under the law", None]
    rows = make(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    got = {}
    for r in licenses.scan_licenses(rows).collect():
        got.setdefault(r.doc_id, []).append((r.license, texts[r.doc_id].encode()[r.start : r.end].decode(), r.containment))
    assert got[0] == [("MIT", "Released under the\nMIT license", 1.0)] and 2 not in got and 3 not in got
    assert [g[0] for g in sorted(got[1], key=lambda g: texts[1].find(g[1]))] == ["GPL-3.0", "MIT", "MIT"]
    assert licenses.scan_licenses(edges).count() == 0 and licenses.scan_licenses(nothing).count() == 0
    # every planted line of the small table is found
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for name in ("MIT", "GPL-3.0", "Apache-2.0", "CC-BY-NC-4.0"):
        planted = {r.doc_id for r in docs.filter(F.col("text").contains(licenses.TEMPLATES[name])).collect()}
        assert planted <= {r.doc_id for r in licenses.scan_licenses(docs).filter(F.col("license") == name).collect()}
    # a band is shared with the probability the settings promise
    assert 1 - (1 - 0.5**licenses.ROWS) ** licenses.BANDS > 0.9998


def brute_licenses(text, wordings):
    """License and word range of every run of at most twice a wording's shingles that holds 0.8 of them."""
    words, out = re.findall("[a-z0-9]+", text.lower()), []
    grams = list(zip(words, words[1:], words[2:]))
    for name, texts in wordings.items():
        for t in texts:
            w = re.findall("[a-z0-9]+", t.lower())
            whole = list(zip(w, w[1:], w[2:]))
            for a in range(len(grams)):
                part = grams[a : a + 2 * len(whole)]
                if part[0] in whole and len(set(part) & set(whole)) >= 0.8 * len(set(whole)):
                    out.append((name, a, max(i for i, g in enumerate(part) if g in whole) + a + 2))
    return out


def test_licenses_with_words_put_in_and_left_out():
    wordings = licenses.every_wording()
    index = licenses.index_templates(wordings)

    def spans(text):
        return [(name, text.encode()[a:b].decode(), share) for name, a, b, share in licenses.find_licenses(text.encode(), index)]

    notice = "This work is licensed under the terms of the GNU General Public License, version 3"
    assert spans(f"Read: {notice}. End") == [("GPL-3.0", notice, 0.9)]
    assert spans("It is licensed under the MIT License here") == [("MIT", "under the MIT License", 1.0)]
    assert spans("Licensed under the law, General Public notice") == []
    # two stretched notices side by side stay two
    assert [s[0] for s in spans(f"{notice}. {notice}.")] == ["GPL-3.0", "GPL-3.0"]
    rng, stretched = random.Random(7), 0
    for _ in range(400):
        words = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(12))]
        for _ in range(rng.randrange(1, 4)):
            w = rng.choice(rng.choice(list(wordings.values()))).split()
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(w))
                w[i : i + rng.randrange(2)] = [f"x{rng.randrange(9)}"] * rng.randrange(4)
                w = w or ["x"]
            words += w + [f"w{rng.randrange(50)}" for _ in range(rng.randrange(12))]
        text = " ".join(words)
        ends = [m.span() for m in re.finditer("[a-z0-9]+", text.lower())]
        found, brute = licenses.find_licenses(text.encode(), index), brute_licenses(text, wordings)
        for name, a, b in brute:
            assert any(s < ends[b][1] and ends[a][0] < e for _, s, e, _ in found), (name, text)
        for name, s, e, _ in found:
            assert any(n == name and ends[a][0] < e and s < ends[b][1] for n, a, b in brute), (name, text)
        stretched += any(share < 1 for *_, share in found)
    assert stretched > 40
    low, high = licenses.CONTAINMENT / (max(licenses.STRETCHES) + 1 - licenses.CONTAINMENT), 1e-6
    assert (1 - low**licenses.ROWS) ** licenses.BANDS < high


def test_first_fit_decreasing_like_a_plain_scan():
    rng = random.Random(6)
    for _ in range(50):
        lengths = [rng.randrange(1, 1024) for _ in range(rng.randrange(1, 80))]
        bins, room = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            at = next((b for b, r in enumerate(room) if r >= lengths[i]), len(bins))
            if at == len(bins):
                bins.append([])
                room.append(1024)
            bins[at].append(i)
            room[at] -= lengths[i]
        assert packing.first_fit_decreasing(lengths) == bins


def check_packing(pieces, texts):
    """Pieces cover every row's ids once, and sequences are gapless and short."""
    import public_tokenizers
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = sorted(((i is not None, i or 0), tuple(code.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in texts)
    by_doc, by_sequence, crcs = {}, {}, {}
    for p in pieces:
        by_doc.setdefault((p.doc_id is not None, p.doc_id or 0), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for doc, ids in expected:
        crcs.setdefault(doc, []).append(ids)
    assert set(by_doc) == set(crcs)
    for doc, own in by_doc.items():
        assert sum(p.length for p in own) == sum(map(len, crcs[doc]))
        for p in own:
            crc = [zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for ids in crcs[doc] if len(ids) == p.doc_tokens]
            assert p.ids_crc32 in crc
    padding = 0
    for spots in by_sequence.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding / max(1, sum(p.length for p in pieces))


def test_packing(spark, edges, nothing):
    special = make(spark, [(1, "a<|endoftext|>b", None, None), (2, "  two   spaces\n\n", None, None)])
    check_packing(packing.pack(special).collect(), [(1, "a<|endoftext|>b"), (2, "  two   spaces\n\n")])
    check_packing(packing.pack(edges, group_size=3).collect(), [(i, t) for i, t, _, _ in EDGES])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert check_packing(packing.pack(docs).collect(), [tuple(r) for r in docs.collect()]) < 0.01
    assert packing.pack(nothing).count() == 0


def test_mix_meets_targets(spark, edges, nothing):
    sf = "/root/testdata/sf0.01"
    rows = mix.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    totals = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        t = totals.setdefault(r.source, [0, r.target, r.source_size, 0])
        t[0] += r.taken
        t[3] += r.size
    assert all(abs(t[0] - t[1]) <= 1 and t[2] == t[3] and t[1] <= 2 * t[2] for t in totals.values())
    assert sum(t[1] for t in totals.values()) == pytest.approx(1.5 * sum(t[2] for t in totals.values()))
    assert sorted(map(tuple, mix.query(spark, sf).collect())) == sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rows)
    got = mix.mix_sources(edges).collect()
    assert sum(r.copies for r in got) == len(EDGES) and {r.taken for r in got if not r.size} == {0}
    assert mix.mix_sources(nothing).count() == 0


def test_better_documents_come_more_often(spark):
    docs = make(spark, [(i, "w " * 10, "en", "a") for i in range(2000)])
    good = spark.range(0, 2000, 2).select(F.col("id").alias("doc_id"), F.lit(4.0).alias("quality"))
    part = {r.doc_id: r.part for r in mix.mix_sources(docs, quality=good, share=0.3).collect()}
    assert sum(v for i, v in part.items() if i % 2 == 0) > 3 * sum(v for i, v in part.items() if i % 2)


def test_top_k_like_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, 3.0]) for _ in range(3)]) for i in range(120)]
    rows += [(50, rows[50][1]), (200, None), (201, [1.0, None, 2.0]), (202, [float("nan"), 1.0, 1.0]), (203, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (204, [1.0, 1.0])]
    rows += [(300, [3e30, 1.0, 0.0]), (301, [2e30, 1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    # every row but the query's own is a candidate, also one of the same id
    q = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for at, (i, v) in enumerate(q):
        if i % 50 == 0:
            scored = [(sum(a * b for a, b in zip(v, w)), j) for other, (j, w) in enumerate(q) if other != at and len(w) == len(v)]
            scored = sorted((-max(-(2**63), min(2**63 - 1, s)), j) for s, j in scored)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    for shard, block, fan in ((4096, 1024, 64), (16, 2, 2)):
        tiled_topk.FAN_IN = fan
        got = [tuple(r) for r in tiled_topk.top_k(df, F.col("vec_id") % 50 == 0, shard=shard, block=block).collect()]
        assert sorted(got) == sorted(want)
    tiled_topk.FAN_IN = 64
    assert tiled_topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert tiled_topk.top_k(df.filter("vec_id = 51"), F.lit(True)).count() == 0


def test_pipeline_stages(spark, edges):
    docs = corpus_pipeline.language_id(spark, edges, SF)
    assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 3, 3, 5, 7, 8] and docs.columns == edges.columns
    cut = corpus_pipeline.line_dedup(spark, docs, SF)
    assert cut.columns == edges.columns and cut.count() == 6
    kept = corpus_pipeline.near_dedup(spark, cut, SF)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 5, 8]
    mixed = corpus_pipeline.mix_sources(spark, kept, SF)
    words = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mix.word_count(F.col("text"))).alias("n")).collect()}
    target = {r.source: r.target for r in mix.mix_sources(kept, quality=mix.quality_weights(spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert mixed.columns == edges.columns and all(abs(words.get(s, 0) - t) <= 1 for s, t in target.items())
    check_packing(corpus_pipeline.packing(spark, mixed, SF).collect(), [(r.doc_id, r.text) for r in mixed.collect()])
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_every_query_is_registered():
    names = list(registry.queries())
    assert [int(n[2:].split("_")[0]) for n in names[:-1]] == list(range(1, 14)) and names[-1] == "pipeline"
