import collections
import hashlib
import heapq
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm import turns
from cohortlens.llm.negatives import best_places, mine_negatives, modular_product, primes_for, residues, signed_scores
from cohortlens.llm.sharding import draw_good, draw_row, generator, permuted_slots, shard_sizes, shuffle_to_shards, write_shards

# sharding


def test_every_row_gets_one_slot_of_equal_shards(docs):
    got = shuffle_to_shards(docs).collect()
    want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert [len(slots[s]) for s in range(8)] == shard_sizes(len(got), 8)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sorted(map(tuple, shuffle_to_shards(docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert {(r["doc_id"], r["shard"]) for r in shuffle_to_shards(docs, seed=5).collect()} != {(r["doc_id"], r["shard"]) for r in got}


def test_few_and_no_rows(no_docs, docs):
    assert shuffle_to_shards(no_docs).collect() == []
    few = shuffle_to_shards(docs.where("doc_id in (1, 2, 3)")).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0), (2, 0)]


def test_many_partitions_need_a_deeper_tree(spark):
    rows = spark.range(0, 2000, 1, 150).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = shuffle_to_shards(rows, shards=3).collect()
    assert len({r["doc_id"] for r in got}) == 2000
    assert collections.Counter(r["shard"] for r in got) == {0: 667, 1: 667, 2: 666}
    assert len({(r["shard"], r["slot"]) for r in got}) == 2000


def test_draws_follow_the_hypergeometric_law():
    good, bad, n = 30, 50, 20
    rng = generator(1, 2)
    seen = collections.Counter(draw_good(rng, good, bad, n) for _ in range(20000))
    law = [math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(n + 1)]
    excess = sum((seen[k] - 20000 * p) ** 2 / (20000 * p) for k, p in enumerate(law) if 20000 * p > 5)
    assert excess < 40
    # far beyond the populations that NumPy's own draw takes
    big = [draw_good(rng, 10**11, 7 * 10**11, 10**9) for _ in range(200)]
    deviation = math.sqrt(10**9 / 8 * 7 / 8)
    assert abs(np.mean(big) - 10**9 / 8) < 5 * deviation / math.sqrt(200)
    assert 0.8 < np.std(big) / deviation < 1.2
    lacking = np.array([5, 0, 9, 3])
    for _ in range(50):
        row = draw_row(rng, lacking, 11)
        assert row.sum() == 11 and (row <= lacking).all()


def test_a_shuffle_is_uniform(spark):
    """Where a row lands, over many seeds, for rows of unequal partitions; and which two rows share a shard."""
    rows = spark.range(0, 6, 1, 1).union(spark.range(6, 9, 1, 1)).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    landed = collections.Counter()
    for seed in range(16):
        for r in shuffle_to_shards(rows, shards=2, seed=seed).collect():
            landed[r["doc_id"], r["shard"], r["slot"]] += 1
    first = [sum(landed[d, 0, s] for s in range(5)) for d in range(9)]
    # 16 trials of 5/9: four deviations are 8
    assert all(abs(x - 16 * 5 / 9) < 8 for x in first)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_slots_are_permuted(n):
    seen = set()
    for key in range(20):
        slots = permuted_slots(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
        assert sorted(slots.tolist()) == list(range(n))
        seen.add(tuple(slots.tolist()))
    assert len(seen) >= min(20, math.factorial(min(n, 5))) // 2


def test_shards_are_written_in_order(spark, docs, tmp_path):
    rows = docs.where("doc_id is not null and doc_id <> 400").withColumn("shard", F.lit("mine"))
    write_shards(rows, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert collections.Counter(r["doc_id"] for r in back.collect()) == collections.Counter(r["doc_id"] for r in rows.collect())
    assert {r["text"] for r in back.collect()} == {r["text"] for r in rows.collect()}


# conversations

SPACE = set(" \t\n\x0b\x0c\r")


def cheapest_repair(rows):
    """Dijkstra over (place, state) by (cost, edits) for rows of (role, text, fault)."""
    start = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit, "\n".join(lines)
        for initial, to in start[state].items():
            if initial != "s":
                name = {"u": "user", "a": "assistant"}[initial]
                heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*lines, f"{name}:")))
                if i < len(rows) and rows[i][2] in ("", "truncated"):
                    heapq.heappush(heap, (cost + 2 + (rows[i][2] != ""), audit + "R", i + 1, to, (*lines, f"{name}:{rows[i][1]}")))
            if i < len(rows) and rows[i][2] in ("", "truncated") and rows[i][0][:1] == initial:
                heapq.heappush(heap, (cost + (rows[i][2] != ""), audit + "K", i + 1, to, (*lines, f"{rows[i][0]}:{rows[i][1]}")))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))


def brute_conversations(table, damaged=True):
    """The contract, row by row, for (conv, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 19
            if case:
                text = "" if case == 1 else "".join(c for c in text if c not in ".!?") if case == 2 else text
                rows += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faulty = set(), []
        for _, role, text in rows:
            inner = text.rstrip("".join(SPACE))
            fault = "blank" if not inner else "duplicate" if (role, text) in seen else "" if inner[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faulty.append((role, text, fault))
        known = [t for t, _, _ in rows if t is not None]
        cost, audit, repaired = cheapest_repair(faulty)
        count = collections.Counter(f for _, _, f in faulty)
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, count["blank"], count["duplicate"], count["truncated"],
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty)), cost, audit,
            hashlib.sha256(repaired.encode()).hexdigest())
    return out


def random_conversations(seed):
    rng = random.Random(seed)
    texts = ["Fine.", "No stop", "Why? ", "", " \x0b", None, "Ü!", "same.", "same.", "a\xa0", "x.\n"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "umbrella"]
    table = []
    for conv in [*range(120), None]:
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            table.append((conv, None if rng.random() < 0.05 else turn * rng.randint(1, 2), role, rng.choice(texts) if rng.random() < 0.5 else f"Text {turn}."))
    table += [(500, t, ("user", "assistant")[t % 2] if rng.random() < 0.8 else "tool", rng.choice(texts)) for t in range(200)]
    table += [(501, 3, "user", "Same turn.")] * 40 + [(502, None, None, None)] * 3
    # conversations all of whose rows the damage drops
    gone = [c for c in range(1000, 1100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone
    return table + [(c, 0, "user", "Gone.") for c in gone]


CONVERSATION = "conv_id long, turn long, role string, text string, block string, at string, Conv string, codes string"


def as_rows(spark, table):
    return spark.createDataFrame([(*r, "b", "a", "c", "k") for r in table], CONVERSATION).repartition(5)


def found(df):
    return {r["conv_id"]: tuple(r[c] for c in turns.RESULTS) for r in df.collect()}


@pytest.mark.parametrize(("seed", "bits"), [(1, 10), (2, 4), (3, 1)])
def test_repairs_equal_search_over_all_edits(spark, monkeypatch, seed, bits):
    """Blocks of 1,024 rows, of 16 and of 2, so that conversations span many segments and partitions."""
    monkeypatch.setattr(turns, "BLOCK_BITS", bits)
    table = random_conversations(seed)
    got = turns.repair_conversations(as_rows(spark, table))
    want = brute_conversations(table)
    rows = found(got)
    assert got.count() == len(want)
    assert {c: rows[c] for c in want} == want


def test_undamaged_conversations_are_left_alone(spark):
    table = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hello."), (1, 2, "assistant", "Hi!"), (2, 0, "user", "Hello."), (2, 5, "user", "Again")]
    got = found(turns.repair_conversations(as_rows(spark, table), as_is=True))
    assert got == brute_conversations(table, damaged=False)
    assert got[1][5:7] == (0, "KKK") and got[2][0] == 4


def test_no_conversations(spark):
    assert turns.repair_conversations(spark.createDataFrame([], CONVERSATION)).collect() == []


def test_extreme_turns_and_long_texts(spark):
    big = "word " * 300_000 + "end."
    table = [(1, -(2**63), "user", big), (1, 2**63 - 1, "assistant", big), (2, 1, "user", big), (2, 1, "user", big)]
    got = found(turns.repair_conversations(as_rows(spark, table), as_is=True))
    want = brute_conversations(table, damaged=False)
    assert want[1][0] >= 2**63 and got[1] == (None, *want[1][1:])
    assert got[2] == want[2]


@pytest.mark.parametrize("seed", range(20))
def test_walks_of_any_segment_are_cheapest_and_least(seed):
    rng = random.Random(seed)
    codes = "".join(rng.choice("bdsuaoSUAO") for _ in range(rng.randint(1, 14)))
    first = rng.randint(0, 3)
    audit, end = turns.walk(codes, turns.LAST, first)
    # the walk's own cost, its end included, is the least cost that the checkpoints promise
    cost, state, left = turns.LAST[end], first, iter(codes)
    for edit in audit:
        if edit == "I":
            cost, state = cost + 2, turns.NEXT[state]
            continue
        cost, state = next((cost + c, to) for e, c, to in turns.EDITS[next(left)][state] if e == edit)
    assert state == end and next(left, None) is None
    v = turns.checkpoints(codes, turns.LAST)[0][first]
    matrix = turns.segment_matrix(codes)
    assert cost == v == min(matrix[4 * first + e] + turns.LAST[e] for e in turns.STATES)


# hard negatives


def brute_negatives(rows, labels=10):
    use = []
    for n, (i, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [int(x) * 256 if abs(x) >= 2.0**53 else math.floor(256 * x) for x in vector]
        use.append((n, i, (label + 1) % labels if i is not None and i % 7 == 0 else label, whole))
    last = float("inf")
    out = []
    for n, i, label, v in use:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), last if j is None else j, j, m == label)
                  for k, j, m, w in use if k != n and len(w) == len(v)]
        scored.sort(key=lambda x: (-x[0], x[1]))
        for ps, _, p, _ in [s for s in scored if s[3]][:5]:
            inside = [s for s in scored if not s[3] and 30 * ps <= 100 * s[0] <= 90 * ps][:10]
            out += [(i, p, r + 1, s[2], ps, s[0]) for r, s in enumerate(inside)]
    fit = lambda x: x if -(2**63) <= x < 2**63 else None
    return collections.Counter((a, p, r, q, fit(x), fit(y)) for a, p, r, q, x, y in out)


VECTORS = "vec_id long, embedding array<double>, label int, row string, id string, cell string, Width string"


def mined(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, "r", "i", "c", "w") for r in rows], VECTORS).repartition(parts)
    got = mine_negatives(df, F.col("vec_id") % 100 == 0, F.col("vec_id") % 7 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return collections.Counter(tuple(r) for r in got.collect())


def clustered(seed, n=600, width=16, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width))
    return [(i, (scale * (centres[i % 4] + 0.8 * rng.normal(size=width))).tolist(), int(rng.integers(0, 10))) for i in range(n)]


def test_negatives_equal_brute_force(spark):
    rows = clustered(1)
    want = brute_negatives(rows)
    assert len(want) > 100
    assert mined(spark, rows) == want


def test_negatives_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr("cohortlens.llm.negatives.CELL_VALUES", 512)
    rows = clustered(2, 400)
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    same = [0.5, 0.25, -0.125]
    rows = [(i, same, i % 3) for i in range(300)]
    rows += [(1000 + i, rng.normal(size=3).tolist(), i % 3) for i in range(60)]
    rows += [(2000, None, 1), (2100, [1.0, None, 0.0], 1), (2200, [1.0, float("nan"), 0.0], 1), (2300, [float("inf"), 0.0, 0.0], 1),
             (2400, same, None), (None, same, 1), (None, [0.5, 0.25, -0.1], 2), (2500, [], 1), (2600, [], 1), (2601, [], 2),
             (2700, [1.0, 2.0], 5), (2701, [1.0, 2.0], 5), (2702, [0.5, 1.0], 6), (-100, [0.4, 0.2, -0.1], 1)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_repeated_rows_are_rows_of_their_own(spark):
    rows = clustered(4, 202) + clustered(4, 202)[:150]
    got, want = mined(spark, rows), brute_negatives(rows)
    assert sum(got.values()) == sum(want.values()) and {k[:2] for k in got} == {k[:2] for k in want}


@pytest.mark.parametrize("scale", [1e-30, 1e6, 1e20, 1e150])
def test_scores_of_any_size_are_exact(spark, scale):
    rows = clustered(5, 205, 5, scale)
    assert mined(spark, rows) == brute_negatives(rows)


def test_no_vectors(spark):
    assert mined(spark, []) == {}
    assert mined(spark, [(100, None, None)]) == {}


def test_residue_products_are_exact():
    rng = np.random.default_rng(6)
    a, b = rng.uniform(-300, 300, (7, 3000)), rng.uniform(-300, 300, (9, 3000))
    whole = [[sum(int(math.floor(256 * x)) * int(math.floor(256 * y)) for x, y in zip(u, v, strict=True)) for v in b] for u in a]
    primes = primes_for(3000 * (300 * 256 + 1) ** 2)
    got = signed_scores((modular_product(residues(a, p), residues(b, p), p) for p in primes), primes)
    assert got.tolist() == whole
    assert best_places(np.array([3, 5, 5, 1, 5]), 2).tolist() == [1, 2]


def test_wide_types_of_vectors(spark):
    schema = T.StructType([T.StructField("vec_id", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                           T.StructField("label", T.LongType())])
    rows = clustered(7, 120, 4)
    df = spark.createDataFrame([(i, [float(np.float32(x)) for x in v], m) for i, v, m in rows], schema)
    got = collections.Counter(tuple(r) for r in mine_negatives(df, F.col("vec_id") % 100 == 0, F.col("vec_id") % 7 == 0).collect())
    assert got == brute_negatives([(i, [float(np.float32(x)) for x in v], m) for i, v, m in rows])
