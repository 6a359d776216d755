import collections
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.llm import ngrams, pii
from cohortlens.llm.imatch import fingerprint_documents
from cohortlens.llm.licenses import TEMPLATES, scan_licenses
from cohortlens.llm.neighbours import nearest_neighbours
from cohortlens.llm.quality import keep_good, pool_monotone, score_quality
from cohortlens.llm.urls import RULES, _set_aside, judge_urls

SF = "/root/testdata/sf0.001"


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, extra string")


# --- quality ---------------------------------------------------------------

def test_pooling_is_the_least_squares_monotone_fit():
    rng = np.random.default_rng(0)
    w, y = rng.integers(1, 5, 40).astype(float), rng.random(40)
    fit = pool_monotone(w, y)
    # max-min formula
    want = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(fit, want)


def test_quality_learns_and_keeps_its_hands_off_held_out_labels(spark):
    rows = [(i, ("the and of word%d " % i) * (5 + i % 7) if i % 3 else "BUY!!! ### NOW!!! $$$ %%% " * (3 + i % 5)) for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, ""), (901, None), (None, "x y z")], "doc_id long, text string")
    labels = labelled(spark, [(i, int(i % 3 > 0), "") for i in range(200)] + [(3, None, ""), (4, 7, ""), (None, 1, ""), (5, 1, "")])
    out = score_quality(docs, labels)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == 203 and all(0 <= r["score"] <= 1 for r in got.values())
    held = {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i in range(200) if got[i]["held_out"]} == held
    assert np.mean([(got[i]["score"] >= 0.3) == (i % 3 > 0) for i in held]) > 0.95
    # other labels for held-out rows change nothing
    wrong = labelled(spark, [(i, int(i % 3 > 0) if i not in held else int(i % 3 == 0), "") for i in range(200)] + [(5, 1, "")])
    again = {r["doc_id"]: r["score"] for r in score_quality(docs, wrong).collect()}
    assert all(abs(again[i] - got[i]["score"]) < 1e-9 for i in range(200))
    kept = {r["doc_id"] for r in keep_good(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r["score"] >= 0.3}


def test_quality_without_labels_or_rows(docs, no_docs, spark):
    none = labelled(spark, [])
    assert {r["score"] for r in score_quality(docs, none).collect()} == {0.5}
    assert score_quality(no_docs, none).count() == 0
    assert keep_good(docs, none).columns == docs.columns
    ones = score_quality(docs, labelled(spark, [(i, 1, "") for i in range(60)])).collect()
    assert all(r["score"] == pytest.approx(1) for r in ones)


# --- language model --------------------------------------------------------

@pytest.mark.parametrize("small", [{}, {"segment_words": 50, "segment_pairs": 64, "block_pairs": 32, "group_tokens": 300}])
def test_language_model(docs, small):
    rows = {(r["doc_id"], r["n_tokens"], r["n_known"]): r for r in ngrams.score_by_model(docs, settings=ngrams.Settings(**small)).collect()}
    count, pairs, texts = collections.Counter(), collections.Counter(), []
    for r in docs.collect():
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1
        w = (r["text"] or "").encode().lower().split() + ["end"]
        texts.append((r["doc_id"], held, w))
        if not held:
            count.update(w)
            pairs.update(zip(["begin", *w], w, strict=False))
    total, kinds = sum(count.values()), len(count)
    s = ngrams.Settings()
    kept, level = collections.Counter(), {}
    for (h, w), n in pairs.items():
        if n >= s.least_count:
            level[h, w] = s.least_count * s.log_base ** math.floor(math.log(n / s.least_count) / math.log(s.log_base) + 1e-9)
            kept[h] += level[h, w] - s.discount
    off = 0
    for i, held, w in texts:
        r = rows[i, len(w), sum(count[x] > 0 for x in w)]
        base = [math.log10((count[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w]
        assert r["held_out"] == held and r["train_tokens"] == total
        assert r["base_score"] == pytest.approx(sum(base), abs=1e-6)
        score = 0
        for h, x, b in zip(["begin", *w], w, base, strict=False):
            n = count["end"] if h == "begin" else count[h]
            up = kept[h] and (s.least_count - s.discount) * s.log_base ** math.ceil(
                math.log(kept[h] / (s.least_count - s.discount)) / math.log(s.log_base) - 1e-9)
            more = max(level.get((h, x), 0) - s.discount, 0)
            spare = max(n - up, s.discount)
            score += math.log10((more + spare * 10**b) / max(n, more + spare)) if n else b
        off += abs(score - r["score"]) > 0.02 * abs(score) + 1e-6  # false positives of the filter
    assert off <= 0.1 * len(texts)


def test_language_model_without_rows(no_docs, spark):
    assert ngrams.score_by_model(no_docs).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = ngrams.score_by_model(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0, 0)


# --- licences --------------------------------------------------------------

def brute_licenses(text, least=0.8):
    words = lambda s: [w for w in re.split(r"[^\w]+|_", s.lower()) if w]
    bag = lambda w: collections.Counter(zip(["<", *w], [*w, ">"], strict=True))
    out = []
    for b, block in enumerate(re.split(r"\n[ \t\r]*\n", text or "")):
        lines = block.split("\n")
        for k, part in [*enumerate(lines), *([(-1, block)] if len(lines) > 1 else [])]:
            w = words(part)
            if not w:
                continue
            best = (0.0, None)
            for name, template in sorted(TEMPLATES.items()):
                t = bag(words(template))
                a = bag(w)
                dice = 2.0 * sum((a & t).values()) / (sum(a.values()) + sum(t.values()))
                if dice > best[0]:
                    best = (dice, name)
            if best[0] >= least:
                out.append((b, k, best[1], round(best[0], 9)))
    return out


def test_licences_equal_brute_force(spark, docs, no_docs):
    header, mit = TEMPLATES["apache-2.0-header"], TEMPLATES["mit-permission"]
    half = header.split()
    texts = ["some words\nReleased under the MIT license\nmore", "ALL RIGHTS RESERVED", header + "\n\n" + mit,
             " ".join(half[:30]) + "\n" + " ".join(half[30:]), mit.replace("Software", "program"), "the software the software the software",
             "This work is licensed under the GNU General Public License, version 2.", None, "", "\n \n\n", "Licensed under CC BY 4.0 !!"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1, texts[1], "x")]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, n string"))
    assert sorted((r["doc_id"], r["block"], r["line"], r["license"], round(r["dice"], 9)) for r in got.collect()) == sorted(
        (i, *f) for i, t, _ in rows for f in brute_licenses(t))
    assert scan_licenses(docs).count() == 0 and scan_licenses(no_docs).count() == 0


# --- URLs ------------------------------------------------------------------

def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTPS://A.Example.COM/en/x?y#z", "http://www.example.com/en/1", "http://x.www.example.com/en/",
            "ftp://net/es/a", "http://b.NET/fr/", "http://xnet/fr/", "http://com", "http://com/", "a://b://c/d", "http://h.org?q=://x/", "http://É.com/ü/"]
    urls += [f"http://s{i}.example.com/en/{i}" for i in range(40)] + [f"http://t{i}.com/fr/{i}" for i in range(40)]
    urls += [f"http://u{i}.org/en/{i}" for i in range(5)] + ["http://hot.org/x"] * 50
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, score string")
    out = judge_urls(pages)
    got = {r["page_id"]: r for r in out.collect()}
    assert len(got) == len(urls) == out.count()
    for i, u in enumerate(urls):
        rest = (u or "").partition("://")[2]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [p for p, _ in RULES if (host == p.partition("/")[0] or host.endswith("." + p.partition("/")[0])) and path.startswith("/" + p.partition("/")[2])]
        rule = max(fits, key=len, default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == dict(RULES).get(rule, got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")
    assert len({(got[i]["verdict"], got[i]["score"]) for i, u in enumerate(urls) if u == "http://hot.org/x"}) == 1
    assert judge_urls(pages.limit(0)).count() == 0
    only = judge_urls(spark.createDataFrame([(1, "http://a.org/b"), (2, "http://c.com/d")], "page_id long, url string")).collect()
    assert {r["verdict"] for r in only} == {"allow"}


def test_url_models_equal_brute_force(spark):
    urls = [(f"a{i}.com", f"/fr/{i * 7 % 13}") for i in range(30)] + [(f"b{i}.net", f"/es/{i % 5}") for i in range(30)] + [("q.org", "/x"), ("z.com", "/en/")]
    pages = spark.createDataFrame([(k, f"http://{h}{p}") for k, (h, p) in enumerate(urls)], "page_id long, url string")
    rows = pages.select(F.lit(1)).count() and judge_urls(pages).withColumn("aside", _set_aside()).collect()
    line = lambda r: "\x02" * 4 + r["host"] + r["path"] + "\x02"
    letters = max(2, len({c for r in rows for c in line(r)[4:]}))
    score = {}
    for side in ("allow", "block"):
        n = collections.defaultdict(collections.Counter)
        for r in {(r["host"], r["path"]): r for r in rows if r["rule"] and not r["aside"] and r["verdict"] == side}.values():
            s = line(r)
            for k in range(4, len(s)):
                for order in range(5):
                    n[s[k - order : k]][s[k]] += 1

        def p(context, c, n):
            low = p(context[1:], c, n) if context else 1 / letters
            at = n[context]
            return (at[c] + len(at) * low) / (sum(at.values()) + len(at)) if at else low

        score[side] = lambda s, n=n, p=p: [math.log(p(s[k - 4 : k], s[k], n)) for k in range(4, len(s))]
    for r in rows:
        s = line(r)
        assert r["score"] == pytest.approx(np.mean(np.array(score["allow"](s)) - np.array(score["block"](s))), abs=1e-9)


# --- fingerprints ----------------------------------------------------------

def test_imatch(docs, no_docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    out = fingerprint_documents(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))
    got = {r["doc_id"]: r for r in out.collect()}
    order = sorted(rows, reverse=True)
    cut = lambda s: [s[k : k + 8] for k in range(0, len(s), 8)]

    def alike(a, b):
        seen = [(x, y) for x, y in zip(cut(a), cut(b), strict=True) if (x, y) != ("0" * 8, "0" * 8)]
        return sum(x == y for x, y in seen) / len(seen) if seen else 1.0

    texts = {}
    for k, (i, t) in enumerate(order):
        j, other = order[(k + 1) % len(order)]
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(alike(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(alike(r["fingerprint"], got[j]["fingerprint"]))
        assert texts.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert texts.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
    assert fingerprint_documents(docs).count() == docs.count() and fingerprint_documents(no_docs).count() == 0
    assert fingerprint_documents(docs.where("doc_id = 304")).first()["near_next"] == 1.0


# --- personal data ---------------------------------------------------------

def naive_spans(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, least, most in ((2, r"[0-9]([\x20-]?[0-9])+", 16, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if least <= len(d) <= most and (kind == 3 or pii.luhn(d)):
                out.append((kind, m.start(), m.end()))
    return out


pieces = st.sampled_from(["@", ".", "a", "Z", "é", "+", "-", " ", "(", "1", "25", "4111111111111111", "4111 1111", "\n", "%", "_", "b@c.d", "+1 (017) 555-7713", "10.0.0.255", "256"])


@settings(max_examples=500, deadline=None)
@given(st.lists(pieces, max_size=14).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert sorted(pii.base_spans(text)) == sorted(naive_spans(text))


def test_field_keeps_base_spans_and_finds_other_ways(spark, docs, no_docs):
    rows = []
    for i in range(150):
        card = f"{i:04d}56781234567"
        card += next(d for d in "0123456789" if pii.luhn(card + d))
        rows.append((i, f"mail nt.{i}@mail{i % 9}.example.com for it, call +1 ({i:03d}) 555-{i * 7:04d} or see 10.2.{i}.4 "
                        f"and pay {card} on page {i} of 1999-{i % 12 + 1:02d}-11."))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    field = pii.train_field(df)
    found = lambda t: [(pii.KINDS[k], t[a:b]) for k, a, b in pii.all_spans(t, field)[1]]
    assert ("phone", "(017) 555-7713") in found("reach us at (017) 555-7713 today")
    assert found("the year 1999 and version 2.0.1 of 12:30") == []
    for r in pii.find_private(df).collect():
        t = rows[r["doc_id"]][1]
        base = sorted(naive_spans(t))
        assert r["base_sha256"] == hashlib.sha256(pii.spans_text(base).encode()).hexdigest()
        assert set(pii.spans_text(base).split(",")) <= set(r["spans"].split(","))
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [1, 1, 1, 1]
    for r in pii.mask_private(df).collect():
        assert not naive_spans(r["text"]) and "<EMAIL>" in r["text"]
    masked = pii.mask_private(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert pii.find_private(docs).count() == docs.count() and pii.find_private(no_docs).count() == 0


def test_every_other_way_of_an_email_is_scored_without_a_digit_near_it():
    long = "some.personwithalongname at department.universitylibrary.org"
    ways = [*pii._other_ways(0, "jane.doe@mail.example.com"), long, "JANE AT mail.example.com"]
    for way in ways:
        text = "plain words " * 20 + way + " more plain words" * 20
        candidates = set()
        for lo, hi in pii.windows(text):
            s = pii.segments(text[lo:hi])
            candidates |= {text[lo + s.tokens[i][0] : lo + s.tokens[j - 1][1]] for i, j in s.spans if s.tokens[i][0] > 0 and s.tokens[j - 1][1] < hi - lo}
        assert way in candidates, way
    assert not list(pii.windows("what that atlas of cats " * 20))


def test_found_emails_without_a_digit_or_sign_near_them(spark):
    names = ["anna", "bert", "cleo", "dora", "emil", "finn", "gina", "hugo", "ines", "jens"]
    rows = [(i, "plain words " * 15 + f"mail {names[i % 10]}.{names[i // 10 % 10]}@{names[i // 7 % 10]}.example.com now " + "we met at noon and ate " * 8)
            for i in range(100)]
    field = pii.train_field(spark.createDataFrame(rows, "doc_id long, text string"))
    for way in pii._other_ways(0, "lena.kurz@post.example.org"):
        text = "plain words " * 15 + f"write to {way} now " + "plain words " * 15
        assert way in [text[a:b] for _, a, b in pii.all_spans(text, field)[1]], way
    assert pii.all_spans("we met at noon and ate at home with friends " * 5, field)[1] == []


def every_segmentation(s, field, at=0):
    """All ways to cut the tokens from ``at`` on into candidates of a kind and single outside tokens, with their scores."""
    if at == len(s.tokens):
        yield 0.0, ()
        return
    alone = sum(field.outside.get(f, 0.0) for f in s.outside[at])
    for score, rest in every_segmentation(s, field, at + 1):
        yield alone + score, rest
    for (i, j), own in zip(s.spans, s.features, strict=True):
        if i == at:
            kinds = sum((field.segment.get(f, np.zeros(4)) for f in own), np.zeros(4))
            for score, rest in every_segmentation(s, field, j):
                for kind in range(4):
                    yield kinds[kind] + score, ((kind, s.tokens[i][0], s.tokens[j - 1][1]), *rest)


@pytest.mark.parametrize("seed", range(6))
def test_segmentations_equal_enumeration(seed):
    rng = np.random.default_rng(seed)
    text = ["a 1234", "x at y.z", "10.2.3.4", "+1 2345", "ab@c.d", "1 22 333"][seed]
    s = pii.segments(text)
    names = {f for own in s.features for f in own}
    field = pii.Field({f: rng.normal(size=4) for f in sorted(names)}, {f: float(rng.normal()) for f in sorted({f for o in s.outside for f in o})})
    best = max(every_segmentation(s, field))
    found = field.find(text)
    assert len(s.spans) >= 1 and sorted(found) == sorted(best[1])


def test_training_makes_known_segmentations_likely():
    """The chance of the gold segmentation among all of them, summed by enumeration, before and after."""
    rows = ["x +1 234 567 890", "y +44 20 7946 12", "1 of 22"]

    def chance(field, text, gold):
        ways = list(every_segmentation(pii.segments(text), field))
        top = max(score for score, _ in ways)
        return sum(math.exp(score - top) for score, w in ways if sorted(w) == sorted(gold)) / sum(math.exp(score - top) for score, _ in ways)

    field = pii.fit_field(rows, epochs=40)
    for text, gold in pii.training_windows(rows)[:1] + [(rows[2], [])]:
        assert chance(field, text, gold) > max(0.5, 10 * chance(pii.Field({}, {}), text, gold) if gold else 0.5)


def test_numbers_with_leading_zeros_and_no_more_than_a_byte():
    zeros = "0" * 120
    assert pii.base_spans(f"{zeros}01.2.3.4") == [(1, 0, 128)]
    assert pii.base_spans(f"{zeros}256.2.3.4") == [] and pii.base_spans("1" * 5000 + ".2.3.4") == []
    assert pii.base_spans("000.0.0.255") == [(1, 0, 11)]


def test_varied_spans_are_of_their_kind():
    for kind, span in enumerate(("a.b@c.org", "1.2.3.4", "4111111111111111", "+1 234 567 8901")):
        for turn in range(60):
            new = pii._varied(kind, turn, span)
            assert [k for k, a, b in pii.base_spans(new) if (a, b) == (0, len(new))][:1] == [kind], new
        assert len({pii._varied(kind, turn, span) for turn in range(60)}) > 50


def test_long_tables_of_numbers_need_little_memory(monkeypatch):
    field = pii.fit_field([f"mail nt.{i}@mail{i}.example.com or (017) 555-77{i:02d} or +1 017 555 77{i:02d}" for i in range(30)])
    line = "".join(f"{i % 97} {i * 37 % 1009} {i % 13}.{i % 7} " for i in range(600))
    middle = len(line)
    text = line + "write to lena.kurz at post.example.org now " + line * 3
    assert len(text) > 6 * pii.STRETCH
    spans = pii.all_spans(text, field)[1]
    # a stretch is all that is held at once
    seen = []
    find = pii.Field.find
    monkeypatch.setattr(pii.Field, "find", lambda self, part: seen.append(len(part)) or find(self, part))
    pii.all_spans(text, field)
    assert max(seen) <= pii.STRETCH + 2 * pii.MARGIN and sum(seen) >= len(text)
    assert any(k == 0 and text[a:b] == "lena.kurz at post.example.org" and a > middle for k, a, b in spans)
    # spans are the same wherever stretches begin
    short = [(k, a, b) for k, a, b in pii.all_spans(line[-300:] + text[middle : middle + 400], field)[1] if 300 <= a < 344]
    assert [(k, a - 300 + middle, b - 300 + middle) for k, a, b in short] == [x for x in spans if middle <= x[1] < middle + 44]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not here")
def test_field_of_the_given_table_finds_other_shapes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = pii.train_field(docs)
    texts = [t for (t,) in docs.where("lang = 'en' and length(text) between 300 and 3000").select("text").limit(40).collect()]
    for way in pii._other_ways(0, "jane.doe@mail.example.com"):
        found = 0
        for t in texts:
            cut = t.find(" ", 150)
            text = t[:cut] + f" contact {way} " + t[cut + 1 :]
            found += way in [text[a:b] for k, a, b in pii.all_spans(text, field)[1] if k == 0]
        assert found >= 0.9 * len(texts), (way, found)


def test_long_windows_are_cut_into_pieces():
    text = ", ".join(f"name{i}@host.com 4111 1111 1111 1111 +1 (017) 555-77{i:02d}" for i in range(60))
    got = pii.pieces(text, 400)
    assert "".join(got) == text and len(got) > 5 and max(map(len, got)) <= 400
    assert sum(len(pii.base_spans(p)) for p in got) == len(pii.base_spans(text)) == 180


def test_rare_kinds_are_learned(spark):
    rows = [(i, f"in the year {1000 + i} it was {i}.{i % 7} high") for i in range(10000)]
    rows[77] = (77, "call +1 (017) 555-7713 today")
    rows[5077] = (5077, "mail ann.b@mail.example.com now")
    parts = pii._windows_of(spark.createDataFrame(rows, "doc_id long, text string"), "text", 400).where("kind >= 0").collect()
    assert sorted(r["kind"] for r in parts) == [0, 3]
    field = pii.train_field(spark.createDataFrame(rows, "doc_id long, text string"))
    assert field is not None and field.segment


# --- neighbours ------------------------------------------------------------

def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)).round(3)
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, [None] + [1.0] * 15), (2080, [float("inf")] + [1.0] * 15),
           (None, [1.0] * 16), (2100, [1.0] * 3), (2120, [])]
    df = spark.createDataFrame([(i, v, "c", "c") for i, v in rows + bad], "vec_id long, embedding array<double>, id string, node string")
    got = collections.defaultdict(list)
    for r in nearest_neighbours(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -s.round(9)))[:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        assert all(s[v] == pytest.approx(score, abs=1e-9) for _, v, score in found)
        hits += len({v for _, v, _ in found} & set(want.tolist()))
    assert hits / (20 * len(got)) >= 0.9
    few = nearest_neighbours(df.where("vec_id < 8"), F.col("vec_id") % 20 == 0).collect()
    assert [r["rank"] for r in few] == list(range(1, 8))
    assert nearest_neighbours(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
