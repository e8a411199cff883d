"""Hard negatives, personal data and conversation repair against brute force."""

import collections
import hashlib
import heapq
import itertools
import math
import random
import re
import time
import zlib

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dairyframe.llm import conversation_repair as repair, hard_negatives as hard, pii_disclosure as pii, repair_grammar as grammar, tiled_topk

# --- conversation repair

ROWS = "conv_id long, turn long, role string, text string, copies string, digest int"


def cheapest(symbols):
    """(cost, audit) by a search over edit sequences, the cheapest and then the least first."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, got = heapq.heappop(heap)
        if i == len(symbols) and re.fullmatch("(s?(ua)+)?", got):
            return cost, audit
        if (i, audit, got) in seen or not re.fullmatch("s?(ua)*u?", got):
            continue
        seen.add((i, audit, got))
        if i < len(symbols):
            s = symbols[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, got))
            if s != grammar.DROP:
                late = 5 if s >= grammar.CUT else 0
                heapq.heappush(heap, (cost + late, audit + "K", i + 1, got + "suax"[s % 4]))
                for put in "ua":
                    heapq.heappush(heap, (cost + late + 1, audit + "R", i + 1, got + put))
        if len(audit) - i < 4:
            for put in "ua":
                heapq.heappush(heap, (cost + 5, audit + "I", i, got + put))
    raise AssertionError


def test_matrices_find_the_least_of_the_cheapest_edits():
    rules = [(1, 2), (9, 9), (2, 1), (8, 8), (0, 10), (3, 5)]
    of = grammar.matrices(rules)
    some = list(itertools.product(range(9), repeat=3)) + [tuple(random.Random(4).choices(range(9), k=6)) for _ in range(300)]
    for symbols in some + [()]:
        for used in ([], rules):
            (x,) = grammar.rewrite([bytes(symbols)], used)
            assert grammar.ended(grammar.product(x.tolist(), of, grammar.START)[0]) == cheapest(symbols), symbols


def test_rewriting_keeps_sequences_and_counts_pairs_without_overlaps():
    rnd = random.Random(1)
    rules = [(1, 1), (9, 9), (1, 2), (11, 2)]
    spelled = {i: bytes([i]) for i in range(9)}
    for k, (a, b) in enumerate(rules):
        spelled[9 + k] = spelled[a] + spelled[b]
    sequences = [bytes(rnd.choices([1, 2, 8], k=rnd.randrange(12))) for _ in range(200)] + [b"", b"\x01" * 9]
    again = grammar.rewrite(sequences, rules)
    assert [b"".join(spelled[int(s)] for s in x) for x in again] == sequences
    weights = [rnd.randrange(1, 4) for _ in sequences]
    want = collections.Counter()
    for x, w in zip(again, weights):
        for (a, b) in set(zip(x.tolist(), x.tolist()[1:])):
            i = 0
            while i + 1 < len(x):
                hit = (x[i], x[i + 1]) == (a, b)
                want[a, b] += w * hit
                i += 2 if hit else 1
    assert grammar.pair_counts(again, weights) == dict(want)


def test_ropes_compare_as_their_texts():
    rnd = random.Random(2)
    pool = ["", "D", "K", "KD", "IK"]
    for _ in range(400):
        pool.append((rnd.choice(pool[-40:]), rnd.choice(pool[-40:])) if len(pool) < 60 else rnd.choice(pool[5:]))
        a, b = rnd.choice(pool[-40:]), rnd.choice(pool[-40:])
        if len(grammar.text_of(a)) < 5000 and len(grammar.text_of(b)) < 5000:
            assert grammar.less(a, b) == (grammar.text_of(a) < grammar.text_of(b))


def conversations(rnd, n):
    rows = [(None, 1, "user", "hi."), (None, None, None, None), (7, None, "user", "a?"), (7, None, "user", "a?"), (7, 0, "assistant", ""), (9, 3, "user", "x")]
    texts = ["Yes.", "No!", "so", "", " \t\n", "Ärger?", "a.b", "x" * 50_000 + ".", None, "end. \x0b"]
    for c in range(10, 10 + n):
        for t in range(rnd.randrange(1, 9) if c % 5 else rnd.randrange(30, 90)):
            rows.append((c, None if rnd.random() < 0.03 else t - rnd.randrange(2), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", None]), rnd.choice(texts)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece,rules", [(4096, 128), (4, 5), (1, 0)])
def test_repair_equals_a_walk_in_sql(spark, piece, rules):
    rows = conversations(random.Random(piece), 40)
    got = repair.digested(repair.repair(repair.damage(spark.createDataFrame([(*r, "2", 3) for r in rows], ROWS)), rules=rules, piece=piece))
    table = pa.table({c: list(v) for c, v in zip(("conv_id", "turn", "role", "text"), zip(*rows))})
    con = duckdb.connect()
    con.register("conversations", table)
    cur = con.execute(repair.ORACLE)
    names = [d[0] for d in cur.description]
    key = lambda row: tuple((x is not None, x) for x in row)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(cur.fetchall(), key=key)


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "A. b!") for c in range(20) for t in range(10)] + [(None, 4, "assistant", "A. b!")]
    for r in repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        what = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{r.turn}".encode()) % 20
        assert r.copies == {0: 0, 3: 2}.get(what, 1)
        assert r.text == {1: "", 2: "A b"}.get(what, "A. b!")
        assert r.role == ("user" if what == 4 else "assistant")


def test_repaired_turns_and_no_rows(spark):
    rows = spark.createDataFrame([(1, 1, "user", "q?"), (1, 2, "tool", "r."), (1, 3, "user", "cut"), (2, 1, "assistant", "")], "conv_id long, turn long, role string, text string")
    done = repair.repair(rows)
    assert [tuple(r) for r in done.turns.orderBy("conv_id", "position").collect()] == [(1, 0, "K", "user", "q?"), (1, 1, "R", "assistant", "r.")]
    assert {r.conv_id: (r.cost, r.audit, r.blank) for r in done.summary.collect()} == {1: (3, "KRD", 0), 2: (2, "D", 1)}
    assert repair.digested(repair.repair(rows.limit(0))).count() == 0


def test_a_long_conversation_is_cut_over_tasks(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") < 7_000, 1).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        found = repair.pieces(repair._marked(repair._plain(rows)), 64).withColumn("n", F.length("symbols"))
        most, rows_, parts = found.filter("conv = 1").agg(F.max("n"), F.sum("n"), F.countDistinct("part")).first()
        done = repair.repair(rows, piece=64).summary.filter("conv_id = 1").first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (most, rows_) == (64, 7_000) and parts > 1
    assert (done.illegal, done.cost, done.audit) == (6_999, 3_500, "KR" * 3_500)


# --- hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, rid string, slot int, score double"


def brute_negatives(rows, every, k=5):
    good = [
        (i, v, label, [math.floor(256 * x) for x in vec])
        for i, (v, vec, label) in enumerate(rows)
        if None not in (v, vec, label) and all(x is not None and math.isfinite(x) for x in vec)
    ]
    out = []
    for i, v, label, q in good:
        if v % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, r)), w, j, lab) for j, w, lab, r in good if j != i and len(r) == len(q))
            for minus, w, _, lab in [s for s in scored if s[3] == label][:k]:
                inside = [s for s in scored if s[3] != label and 80 * -minus <= 100 * -s[0] <= 100 * -minus]
                out += [(v, w, n, s[1], -minus, -s[0]) for n, s in enumerate(inside[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard,block", [(8192, 2048), (16, 3)])
def test_hard_negatives_equal_brute_force(spark, shard, block):
    rnd = random.Random(shard)
    centres = [[rnd.gauss(0, 0.3) for _ in range(11)] for _ in range(4)]
    rows = []
    for v in range(150):
        c = rnd.choice(centres)
        rows.append((v, [x + rnd.gauss(0, 0.1) for x in c], rnd.randrange(3)))
    rows += [(v, list(rows[3][1]), v % 3) for v in range(200, 230)]  # equal vectors, ties by id
    rows += [(10, [0.5] * 11, 1), (10, [0.25] * 11, 1), (20, list(rows[20][1]), rows[20][2])]  # repeated ids
    rows += [(300, [0.0] * 11, 0), (301, [0.0] * 11, 0), (310, [], 1), (311, [], 1), (312, [], 2), (320, [1.0, 2.0], 1), (321, [1.0, 2.5], 1), (322, [1.0, 2.0], 2)]
    rows += [(None, [0.5] * 11, 1), (330, None, 1), (340, [0.5] * 10 + [None], 1), (350, [float("nan")] * 11, 1), (360, [float("inf")] * 11, 1), (370, [0.5] * 11, None)]
    frame = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], VECTORS)
    got = hard.mine(frame, F.col("vec_id") % 10 == 0, shard=shard, block=block)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == brute_negatives(rows, 10)
    assert hard.mine(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_scores_beyond_doubles_stay_exact(spark):
    big = 2.0**22
    rows = [(0, [big, 1.0], 1), (1, [big, 1.0], 1), (2, [big, 0.0], 2), (3, [big, 1.0], 2), (4, [big, 2.0], 2)]
    frame = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], VECTORS)
    got = hard.mine(frame, F.col("vec_id") == 0)
    assert [(r.negative_id, r.negative_score - r.positive_score) for r in got.orderBy("rank").collect()] == [(3, 0), (2, -65536)]


def test_top_k_keeps_rows_that_repeat_an_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.75, 0.0]), (0, [0.25, 0.0])]
    got = tiled_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3)
    by = collections.Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect())
    assert by[0, 1, 1, 256 * 192] == 1 and by[0, 2, 1, 256 * 128] == 1 and by[0, 3, 0, 256 * 64] == 1
    assert by[0, 1, 0, 64 * 256] == 1 and sum(by.values()) == 6


# --- personal data

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c.isascii() and c.isdigit()]
            if kind == 1 and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == 2:
                doubled = sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2]) + sum(digits[::-2])
                if not 13 <= len(digits) <= 19 or doubled % 10:
                    continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rnd = random.Random(5)
    parts = ["a", "_", "@", ".", "b.c", "@x.yz", "1", "25", "255", "256", "0001", "4111111111111111", "+49", "(", ")", " ", "-", "é", "\n", "%", "1.2.3.4", "+1 (555) 555-1234", "4111-1111 1111 1111"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(1, 14))) for _ in range(6000)]
    for text in texts + ["", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "x@y.z@w.v"]:
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_take_one_pass():
    start = time.time()
    for text in ("1" * 400_000, "1." * 200_000, "a" * 400_000 + "@", "+1" + " " * 400_000, "@" * 400_000, "a@" * 200_000, "1 " * 200_000, "+" * 400_000):
        pii.base_spans(text)
    assert time.time() - start < 20


def brute_disclosure(texts, reach, documents, wordings):
    n, near, wording, holds = len(texts), collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(set)
    words = [[(m.group().lower(), *m.span()) for m in re.finditer(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", t)] for t in texts]
    for d, t in enumerate(texts):
        spans = plain_spans(t)
        free = [w for w in words[d] if w[2] - w[1] > 1 and not any(w[1] < e and s < w[2] for _, s, e in spans)]
        for kind, s, e in spans:
            value = (kind, t[s:e].lower() if kind < 2 else re.sub("[^0-9]", "", t[s:e]))
            around = [w for w in free if w[2] <= s][-reach:] + [w for w in free if w[1] >= e][:reach]
            holds[value].add(d)
            for w in around:
                near[value, w[0]].add(d)
                wording[value, w[0]].add(tuple(x[0] for x in around))
    out = {}
    for (value, term), docs in near.items():
        if len(docs) >= documents and len(wording[value, term]) >= wordings:
            df = sum(any(w[0] == term for w in ws) for ws in words)
            content = math.log2(n / len(holds[value]))
            out[value, term] = math.log2(n * len(docs) / (df * len(holds[value]))) / content if content else 0.0
    return out


def corpus():
    rnd = random.Random(8)
    texts = []
    for i in range(120):
        filler = [rnd.choice(["the", "cow", "milk", "of", "grass", "Größe", f"w{i}", f"u{rnd.randrange(40)}"]) for _ in range(30)]
        if i % 12 == 0:
            filler[10:10] = ["Zorro" if i % 24 else "zorro", "writes", "anna@x.org", "from", "Hofgut"]
        if i % 30 == 5:
            filler[3:3] = ["call", "+49 30 1234-5678", "now"]
        texts.append(" ".join(filler))
    return texts + ["copy secret word bob@y.org end here"] * 9 + ["", None, "zorro alone without anything", "x " * 60_000]


def test_terms_that_give_entities_away(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)] + [(3, "again anna@x.org", "t", 2), (None, "8.8.8.8", None, 0)], "doc_id long, text string, base string, rid int")
    every = [t or "" for t in texts] + ["again anna@x.org", "8.8.8.8"]
    want = {k for k, v in brute_disclosure(every, 8, 3, 3).items() if v >= pii.GENERALISE}
    assert {t for _, t in want} >= {"zorro", "writes", "hofgut"} and not {t for _, t in want} & {"the", "secret", "cow"}
    got = {(r.doc_id, r.clean_text is None): r for r in pii.sanitise(docs).collect()}
    assert len(got) == len(every)
    hit = got[0, False]
    named = {every[0][s.start : s.end].lower() for s in hit.spans if s.kind == pii.TERM}
    assert named == {t for (k, v), t in want if v == "anna@x.org" and t in every[0].lower().split()}
    assert "anna" not in hit.clean_text and "[EMAIL]" in hit.clean_text and "zorro" not in hit.clean_text.lower()
    assert [tuple(s) for s in got[120, False].spans] == [("email", 17, 26)] and got[131, True].spans == []
    assert [tuple(s) for s in got[None, False].base] == [("ip", 0, 7)]
    assert pii.sanitise(docs.limit(0)).count() == 0


def test_disclosure_equals_brute_force(spark):
    texts = [t or "" for t in corpus()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = pii.co_occurrences(pii.written(pii._detected(docs, "doc_id", "text"), "test-found"), 8)
    got = {(r.entity, r.term): r.disclosure for r in pii.disclosures(docs, "text", pairs, documents=3, wordings=3).collect()}
    want = {(pii.entity(k, v), int(pii.terms(t)[0][0])): x for ((k, v), t), x in brute_disclosure(texts, 8, 3, 3).items()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_personal_data_query_columns(spark):
    got = pii.query(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        spans = plain_spans(texts[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for k, _, _ in spans) for i in range(4))
