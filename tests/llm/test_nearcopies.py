"""Near copies around centres, many of them a little less than 0.8 alike, against brute force."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from cohortlens.llm import simhash
from cohortlens.llm.nearcopies import LEAST, rare_buckets
from cohortlens.llm.simhash import keep_one

WIDTH = 5


def _texts(seed: int, centres: int, copies: int) -> list[str]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(centres):
        centre = rng.choices(words, k=rng.randint(60, 140))
        texts.append(" ".join(centre))
        for _ in range(copies):
            own = list(centre)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[rng.choice(words)], [], [own[at], rng.choice(words)]])
            texts.append(" ".join(own))
    return texts


def _sets(texts: list[str]) -> list[set[tuple[str, ...]]]:
    split = [t.split() for t in texts]
    return [{tuple(w[i : i + WIDTH]) for i in range(len(w) - WIDTH + 1)} for w in split]


def _alike(x: set, y: set) -> bool:
    return LEAST[1] * len(x & y) >= LEAST[0] * len(x | y)


def test_components_of_loose_groups(spark):
    texts = _texts(5, 3, 60)
    sets, root = _sets(texts), list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if _alike(sets[i], sets[j]) and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    # some hang together, others are left alone near their centre
    assert 3 < len(set(root)) < len(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"] for r in keep_one(docs).collect()} == set(root)


def test_rare_buckets_hold_every_pair(spark):
    texts = sorted(set(_texts(6, 2, 40)))
    sets = _sets(texts)
    rows = spark.createDataFrame([(i, t, len(s)) for i, (t, s) in enumerate(zip(texts, sets, strict=True))], "row long, text string, size long")
    members = rows.select(F.lit(1).cast("long").alias("bucket"), "row", "size")
    entries: dict[int, dict[int, int]] = {}
    for r in rare_buckets(members, rows.select("row", "text"), WIDTH).collect():
        assert r["size"] == len(sets[r["row"]])
        entries.setdefault(r["row"], {})[r["bucket"]] = r["shared"]
    p, q = LEAST
    found = 0
    for i, j in combinations(range(len(texts)), 2):
        if _alike(sets[i], sets[j]):
            found += 1
            both = entries[i].keys() & entries[j].keys()
            assert any((p + q) * min(entries[i][b], entries[j][b]) >= p * (len(sets[i]) + len(sets[j])) for b in both)
    assert found > 50
    # a text is dealt by a part of its shingles only
    assert sum(map(len, entries.values())) < sum(map(len, sets)) / 2


def test_rare_buckets_of_nothing(spark):
    none = spark.createDataFrame([], "bucket long, row long, size long")
    assert rare_buckets(none, spark.createDataFrame([], "row long, text string"), WIDTH).count() == 0


def test_fingerprints_link_first(spark, monkeypatch):
    """Copies within two bits are linked by their fingerprints; close fingerprints of unlike sets aren't copies."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    long = " ".join(rng.choices(words, k=3000))
    line = "one line that is said over again "  # seven shingles: no bit is set in just half of them
    texts = [long, long + " end", long + " stop", line * 400 + " ".join(words[:60]), line * 400 + " ".join(words[100:160]), "", " ", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found, close = [], simhash.close_nodes

    def watched(*arguments):
        links = close(*arguments)
        found.extend((r["a"], r["b"]) for r in links.collect())
        return links

    monkeypatch.setattr(simhash, "close_nodes", watched)
    assert {r["doc_id"] for r in keep_one(docs).collect()} == {0, 3, 4, 5}
    prints = simhash.fingerprint_batch(texts, WIDTH)
    near = [(i, j) for i, j in combinations(range(5), 2) if bin(int(prints[i] ^ prints[j]) & (1 << 64) - 1).count("1") <= simhash.RADIUS]
    assert (0, 1) in near and (0, 2) in near and (3, 4) in near
    # the three long texts hang together, the repeated line alone ties nothing
    assert len(found) == 2
