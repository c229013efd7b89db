"""The operators for training data against plain Python, on small tables with hard cases."""

from __future__ import annotations

import collections
import datetime
import hashlib
import inspect
import itertools
import json
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from movespark.llm import attention, bpe, common, embeddings, mixing, ngram_join, pii, quality, scoring, secrets, toxicity, urls
from movespark.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, a shared passage, nulls, empty and long texts, repeated rows, a clashing extra column."""
    rng, out = random.Random(4), []
    base, passage = prose(rng, 300), prose(rng, 60)
    for k in range(120):
        text = prose(rng, rng.choice([1, 3, 8, 60, 200]))
        if k % 4 == 1:
            words = base.split()
            for _ in range(rng.randint(0, 10)):
                words[rng.randrange(len(words))] = "zz"
            text = " ".join(words)
        elif k % 4 == 2:
            text = f"{text} {passage} {text}"
        elif k % 10 == 0:
            text = base
        out.append((k, text, "en", f"s{k % 3}" if k % 3 else None, len(text)))
    out += [(500, None, None, None, None), (501, "", "en", "s1", 0), (502, " \n ", "en", "s2", 3), (503, "x " * 30_000, "en", "s1", 60_000), (503, "x " * 30_000, "en", "s1", 60_000), (504, "ÄÖ Ünïcode ﬁ ΣΑΣ 𝔘", "de", "s\U0001f600", 9)]
    return spark.createDataFrame(out, SCHEMA).withColumn("size", F.lit(7)).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(docs):
    return [(r.doc_id, r.text or "", r.source) for r in docs.collect()]


# ---------------------------------------------------------------- 1


def test_mix_meets_targets(spark, docs):
    rows = mixing.mix(docs).select("doc.doc_id", "source", "size", "source_size", "target", "taken").collect()
    size = collections.Counter()
    for _, t, s in texts(docs):
        size[s] += len(WORD.findall(t))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    budget, target, open_ = 1.5 * sum(size.values()), {}, set(order)
    while True:  # share, cap, share again
        left = budget - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * size[s]}
        target |= {s: 2 * size[s] for s in full}
        open_ -= full
        if not full:
            target |= share if open_ else {}
            break
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).select("doc.doc_id", "source", "size", "source_size", "target", "taken").collect()))


def test_mix_positions_follow_the_schedule(spark, docs):
    rows = mixing.mix(docs).select("source", F.explode("positions").alias("p")).collect()
    assert all(0 <= r.p <= 1 for r in rows)
    assert mixing.mix(empty(spark)).count() == 0
    out = mixing.curriculum(docs)
    assert out.columns == docs.columns and out.count() > 0


# ---------------------------------------------------------------- 2


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    w = attention.initial(np.ones(attention.CLASSES)).astype(np.float64)
    x, y = rng.integers(0, attention.CLASSES, (3, 7)), rng.integers(0, attention.CLASSES, (3, 7))
    g = attention.pack(attention.gradient(attention.unpack(w.copy()), x, y)[1])
    for k in rng.integers(0, len(w), 25):
        d = np.zeros(len(w))
        d[k] = 1e-3
        up, down = (attention.gradient(attention.unpack(w + s * d), x, y)[0] for s in (1, -1))
        assert (up - down) / 2e-3 == pytest.approx(g[k], abs=2e-3)


def test_windows_score_each_place_once():
    """In a text that fits one window the batch gives what a plain forward pass gives; longer ones are whole too."""
    rng = np.random.default_rng(1)
    w = attention.unpack(attention.initial(np.ones(attention.CLASSES)))
    lengths = [1, 5, 32, 33, 90, 0]
    classes = rng.integers(0, attention.CLASSES, sum(lengths))
    first = np.concatenate([[0], np.cumsum(lengths)])
    p, _ = attention.log_probabilities(w, classes, first, np.ones(attention.CLASSES, bool))
    for a, z in zip(first, first[1:]):
        for j in range(a, z):
            lo = a if j - a < attention.CONTEXT else a + -(-(j - a - attention.CONTEXT + 1) // attention.STEP) * attention.STEP
            seen = np.concatenate([[attention.END], classes])[lo + (lo != a) * 0 : j + 1] if lo == a == 0 else np.array([attention.END if i == a else classes[i - 1] for i in range(lo, j + 1)])
            h0 = w["e"][seen] + w["p"][: len(seen)]
            s = (h0[-1] @ w["q"]) @ (h0 @ w["k"]).T * attention.WIDTH**-0.5
            s = np.exp(s - s.max())
            h = h0[-1] + (s @ (h0 @ w["v"]) / s.sum()) @ w["o"]
            logit = h @ w["u"] + w["b"]
            assert p[j] == pytest.approx(logit[classes[j]] - np.log(np.exp(logit).sum()), abs=1e-4)


def test_training_windows_hold_all_subwords():
    for n in (0, 1, 31, 32, 33, 5000):
        ids = np.arange(n) % 60_000
        rows = [np.frombuffer(w, "<u2").tolist() for w in scoring.cut(ids, 60_001)]
        assert [i for w in rows for i in w[1:]] == [*ids.tolist(), 60_001]
        assert rows[0][0] == 60_001 and all(b[0] == a[-1] for a, b in zip(rows, rows[1:]))


def test_model_learns_from_all_of_a_text(spark):
    """Each word of the text has its place in the counts that the model is made of, the inner ones of a word too."""
    coder = scoring.Subwords(scoring.public_ranks())
    words = prose(random.Random(11), 3000).encode().split()
    d = spark.createDataFrame([(0, b" ".join(words))], "row long, text binary")
    tally = scoring._tally(d, spark.sparkContext.broadcast(scoring.public_ranks()))
    seen = collections.Counter(i for r in tally.where("window is not null").collect() for i in np.frombuffer(r.window, "<u2")[1:].tolist())
    assert seen == collections.Counter([*coder.many(words)[0].tolist(), coder.size])
    counts = tally.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    _, pairs = scoring.word_figures(counts, [], spark.sparkContext.broadcast(scoring.public_ranks()))
    want = collections.Counter(p for w in set(words) for p in itertools.pairwise(coder(w)))
    assert {(a, b): n for a, b, n in pairs} == {p: n for p, n in want.items() if n > 1}
    assert attention.STEP == 16 and scoring.STEPS == 300


def test_every_pair_of_subwords_is_kept(spark):
    """However many pairs there are, each that is in more than one word has its count in the model."""
    rng = np.random.default_rng(24)
    parts = [t for t in sorted(scoring.public_ranks()) if len(t) >= 5 and t.isalpha() and t.islower()][:600]
    words = sorted({b"".join(parts[k] for k in row) for row in rng.integers(0, len(parts), (150_000, 6)).tolist()})
    counts = spark.createDataFrame(pa.table({"word": pa.array(words, pa.binary()), "n": pa.array([1] * len(words), pa.int64())}))
    coder = scoring.Subwords(scoring.public_ranks())
    ids, size = coder.many(words)
    inner = np.ones(len(ids), bool)
    inner[np.cumsum(size) - size] = False
    go = np.flatnonzero(inner)
    key, n = np.unique(ids[go - 1] << 20 | ids[go], return_counts=True)
    _, pairs = scoring.word_figures(counts, [], spark.sparkContext.broadcast(scoring.public_ranks()))
    model = scoring.Model(np.zeros(coder.size + 1, np.int64), np.zeros(coder.size + 1, np.float32), np.zeros(1, np.float32))
    model.add_pairs(pairs)
    assert (n > 1).sum() > 1 << 17
    assert np.array_equal(model.pairs, key[n > 1]) and np.array_equal(model.pair_n, n[n > 1])


def test_classes_come_from_all_windows(spark):
    """Neighbours are counted in the last window as in the first, and subwords of like neighbours share a class."""
    rng, size = random.Random(12), 3000
    seqs = [[rng.randrange(2000) if k < 300 else 2000 + rng.randrange(1000) for _ in range(50)] for k in range(400)]
    rows = [(w, k) for k, s in enumerate(seqs) for w in scoring.cut(np.array(s), size)]
    d = spark.createDataFrame(rows, "window binary, deal long").coalesce(4)
    counts = np.bincount([i for s in seqs for i in s], minlength=size + 1).astype(float)
    common = {int(i): k for k, i in enumerate(np.argsort(-counts[:size], kind="stable")[:512])}
    want = collections.Counter()
    for s in seqs:
        for a, b in itertools.pairwise(s):
            want.update((i, common[j] + shift) for i, j, shift in ((a, b, 0), (b, a, 512)) if j in common)
    assert {(r.id, k): n for r in scoring.neighbours(d, counts).collect() for k, n in zip(r.at, r.n)} == want
    begins = np.arange(size) % 2 == 0
    got = scoring.classes_of(d, counts, begins, rounds=2)
    assert (got[begins] < attention.STARTS).all() and (got[~begins] >= attention.STARTS).all() and got.max() < attention.END
    assert (got[2000:][begins[2000:]] < attention.STARTS - 1).any() and not hasattr(scoring, "SAMPLE")


def test_neighbours_are_counted_by_merging():
    rng = np.random.default_rng(4)
    parts = [np.empty(0, np.int64), *(rng.zipf(1.2, 200_000) % 50_000_000 for _ in range(4)), np.array([7, 7, 3])]

    def by_merging() -> tuple[np.ndarray, np.ndarray]:
        held = total = np.empty(0, np.int64)
        for part in parts:
            held, total = scoring.counted_in(held, total, part)
        return held, total

    def by_inverse() -> tuple[np.ndarray, np.ndarray]:
        held = total = np.empty(0, np.int64)
        for part in parts:
            n = np.concatenate([total, np.ones(len(part), np.int64)])
            held, where = np.unique(np.concatenate([held, part]), return_inverse=True)
            total = np.bincount(where, n, len(held)).astype(np.int64)
        return held, total

    def least(f) -> float:
        times = []
        for _ in range(5):
            began = time.process_time()
            f()
            times.append(time.process_time() - began)
        return min(times)

    assert dict(zip(*(x.tolist() for x in by_merging()))) == collections.Counter(np.concatenate(parts).tolist())
    assert all((x == y).all() for x, y in zip(by_merging(), by_inverse()))
    assert least(by_merging) < least(by_inverse)


def test_base_scores(spark, docs):
    got = scoring.score(docs).collect()
    counts, tokens = collections.Counter(), {}
    for i, t, _ in texts(docs):
        tokens[i] = t.encode().lower().split() + [b"\n"]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens[i])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == docs.count()
    for r in got:
        words = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), abs=1e-6)
        assert r.score < 0 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    assert scoring.score(empty(spark)).count() == 0


def test_scores_are_a_distribution(spark):
    """Texts of one word each: what the model gives to all of them, known words and others, is no more than one."""
    rng = random.Random(13)
    known = sorted({prose(rng, 1) for _ in range(400)})
    rows = [(k, " ".join(rng.choices(known, weights=[1 / (j + 1) for j in range(len(known))], k=60))) for k in range(150)]
    ones = [*known, *(w + "zq" for w in known[:200]), *"0123456789", "x" * 50, ""]
    rows += [(1000 + k, w) for k, w in enumerate(ones)]
    got = {r.doc_id: r for r in scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    total = sum(10 ** got[1000 + k].score for k in range(len(ones)))
    assert 0.0 < total <= 1.0
    held = [r for i, r in got.items() if i < 1000 and r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held) - 0.35 * sum(r.n_tokens for r in held)
    again = {r.doc_id: r.score for r in scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(again[i] == pytest.approx(r.score, rel=1e-3) for i, r in got.items())


# ---------------------------------------------------------------- 3


def rank_by_hand(edges, seeds, steps, damping):
    total = sum(seeds.values())
    start = {h: w / total for h, w in seeds.items()} if total else {}
    out, mass = collections.Counter(), dict(start)
    for (a, _), n in edges.items():
        out[a] += n
    for _ in range(steps):
        new = collections.Counter({h: (1 - damping) * m for h, m in start.items()})
        for (a, b), n in edges.items():
            new[b] += mass.get(a, 0) * damping * n / out[a]
        mass = new
    return mass


def test_urls_against_loop(spark):
    rng, rows = random.Random(2), []
    hosts = ["a.example.com", "b.a.example.com", "x.net", "y.net", "z.net", "w.example.org", "EXAMPLE.org", "m.com"]
    for k in range(200):
        html = " ".join(f'<a href="http://{rng.choice(hosts)}/p">' for _ in range(rng.randint(0, 3)))
        rows.append((k, f"https://{rng.choice(hosts)}/{rng.choice(['es', 'en', 'fr', 'de'])}/{rng.choice(['1', '2'])}{rng.choice(['', '?q#x', '#t'])}", html or None))
    rows += [(900, None, None), (901, "no scheme", "x"), (902, "http://x.net", None), (903, "a://b://c/d", "")]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))).collect()

    def parts(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        return (m[1].translate(str.maketrans(urls.lower_az.__globals__["UPPER"], urls.lower_az.__globals__["UPPER"].lower())), m[2]) if m else ("", "")

    def rule(host, path):
        fits = [(t, v) for t, v in urls.RULES for h, s, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
        return max(fits, key=lambda f: len(f[0]), default=(None, None))

    edges, seeds = collections.Counter(), {"allow": collections.Counter(), "block": collections.Counter()}
    for _, u, html in rows:
        h, p = parts(u)
        for x in re.findall(r'href="([^"]*)"', html or ""):
            if h and parts(x)[0] and parts(x)[0] != h:
                edges[h, parts(x)[0]] += 1
        t, v = rule(h, p)
        if t:
            seeds[v][h] += 1
    for h in {parts(u)[0] for _, u, _ in rows}:
        labels = h.split(".")
        for k in range(len(labels) - 2):
            edges[".".join(labels[k:]), ".".join(labels[k + 1 :])] += 1
    trust = rank_by_hand(edges, seeds["allow"], urls.STEPS, urls.DAMPING)
    doubt = rank_by_hand({(b, a): n for (a, b), n in edges.items()}, seeds["block"], urls.STEPS, urls.DAMPING)
    assert len(got) == len(rows)
    for r in got:
        h, p = parts(dict((i, u) for i, u, _ in rows)[r.page_id])
        t, v = rule(h, p)
        assert (r.host, r.path, r.rule) == (h, p, t)
        assert r.verdict == (v or ("block" if round(doubt.get(h, 0), 12) > round(trust.get(h, 0), 12) else "allow"))


def test_distrust_reaches_far_and_small(spark):
    """Hosts 12 links from a blocked page, and very many subdomains with little mass each, are blocked; // links are edges."""
    rows = [(0, "http://bad.com/de/x", "")] + [(k, f"http://h{k}.net/", f'<a href="//{f"h{k - 1}.net" if k > 1 else "bad.com"}/p?u=http://z.net">') for k in range(1, 13)]
    rows += [(100, "http://good.org/", "")]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k].verdict for k in range(1, 13)] == ["block"] * 12 and got[100].verdict == "allow"
    assert got[12].distrust == pytest.approx(0.85**12 * 0.15, rel=1e-3)
    # one blocked page of a domain with many subdomains among very many blocked pages elsewhere
    seeds = spark.createDataFrame([("s.com", 1.0), ("other.com", 1e13)], "host string, weight double")
    edges = spark.createDataFrame([("s.com", f"w{k}.s.com", 1) for k in range(50)], "src string, dst string, links long")
    mass = {r.host: r.distrust for r in urls.personalised(seeds, edges, "distrust", urls.STEPS, urls.DAMPING).collect()}
    assert all(mass[f"w{k}.s.com"] == pytest.approx(0.85 * 0.15 / 50 / 1e13, rel=1e-6) for k in range(50))


def test_many_rules_take_the_join(spark):
    pages = spark.createDataFrame([("x.net", "/a/b"), ("y.net", "/"), ("q.x.net", "/a"), ("", "")], "host string, path string")
    rules = [("net/", "allow"), ("x.net/a", "block"), *[(f"h{k}.org/", "allow") for k in range(100)]]
    few = {(r.host, r.path): r.rule for r in urls.match_rules(pages, rules[:2]).collect()}
    assert {(r.host, r.path): r.rule for r in urls.match_rules(pages, rules).collect()} == few
    assert few == {("x.net", "/a/b"): "x.net/a", ("y.net", "/"): "net/", ("q.x.net", "/a"): "x.net/a", ("", ""): None}


# ---------------------------------------------------------------- 4


def luhn(n):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(n)))) % 10 == 0


def test_feistel_is_a_permutation(spark):
    got = [r.y for r in spark.range(77).select(pii.feistel(F.col("id"), 7, 11, "k", "t").alias("y")).collect()]
    assert sorted(got) == list(range(77)) and got != list(range(77))


def test_pseudonyms_keep_formats(spark):
    text = "call +1 (708) 555-2826, pay 4111 1111 1111 1111 or 4111111111111112, from 8.8.8.8 or 300.1.1.1, born 1980-02-29 or 1981-02-29, 31.12.1999, 12/31/1999, ssn 123-45-6789 and 000-45-6789, mail ab.c.63@mail5.example.com"
    d = spark.createDataFrame([(1, text), (2, "again 8.8.8.8!"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(d).collect()}
    new = got[1].text
    assert "4111111111111112" in new and "300.1.1.1" in new and "1981-02-29" in new and "000-45-6789" in new
    for gone in ("555-2826", "4111 1111 1111 1111", "8.8.8.8", "1980-02-29", "31.12.1999", "12/31/1999", "123-45-6789", "ab.c.63@"):
        assert gone not in new
    card = re.search(r"pay (\d{4} \d{4} \d{4} \d{4})", new)[1].replace(" ", "")
    assert luhn(card) and card[0] == "4"
    ip = re.search(r"from (\S+)", new)[1]
    assert all(int(x) < 256 for x in ip.split(".")) and got[2].text == f"again {ip}!"
    assert got[3].text is None and got[4].text == "" and got[1].n_card == 1 and got[1].n_date_ymd == 1
    assert len(new) == len(text) or ip != "8.8.8.8"


def test_phones_of_all_areas_and_countries(spark):
    numbers = ["+1 (017) 555-2826", "+1 (073) 555-2826", "+49 (171) 555-2826", "+351 (132) 555-2826", "+1 (708) 555-2826", "+1 708 556 2826", "+1-000-000-0000", "+1-999-999-9999"]
    d = spark.createDataFrame([(k, f"call {n} now") for k, n in enumerate(numbers)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(d).collect()}
    digits = [re.sub("[^0-9]", "", n)[-10:] for n in numbers]
    new = [re.sub("[^0-9]", "", got[k].text)[-10:] for k in range(len(numbers))]
    for k, n in enumerate(numbers):
        assert got[k].n_phone == 1 and n not in got[k].text
        assert re.sub("[0-9]", "0", got[k].text) == re.sub("[0-9]", "0", f"call {n} now")
        assert got[k].text.startswith("call " + re.split("[ -]", n)[0])
    # equal numbers have equal pseudonyms whatever the country, distinct ones distinct; the middle three change too
    assert len(set(new)) == len(set(digits)) and sum(a[3:6] == b[3:6] for a, b in zip(digits, new)) < 2
    assert not any(re.search(r"555-2826|556 2826", r.text) for r in got.values())


def plain_round(tweak, half, i):
    return int(hashlib.sha256(f"{pii.KEY}|{tweak}|{i}|{half}".encode()).hexdigest()[:15], 16)


def plain_feistel(a, b, left, right, tweak):
    for i in range(pii.ROUNDS):
        a, b = ((a + plain_round(tweak, b, i)) % left, b) if i % 2 == 0 else (a, (b + plain_round(tweak, a, i)) % right)
    return a, b


def plain_luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d))))


def plain_pseudonym(kind, m):
    """A value's pseudonym in plain Python; None if it isn't valid."""
    put = lambda digits: (it := iter(digits)) and "".join(next(it) if c in "0123456789" else c for c in m)
    d = re.sub("[^0-9]", "", m)
    if kind == "card":
        if plain_luhn(d) % 10:
            return None
        a, b = plain_feistel(*divmod(int(d[1:15]), 10**7), 10**7, 10**7, "card")
        body = d[0] + f"{a * 10**7 + b:014d}"
        return put(body + str(-plain_luhn(body + "0") % 10))
    if kind == "phone":
        code, area, mid, last = d[:-10], d[-10:-7], d[-7:-4], d[-4:]
        a, b = plain_feistel(int(area), int(last), 1000, 10_000, "phone")
        return put(f"{code}{a:03d}{(int(mid) + plain_round('phone-middle', a * 10_000 + b, 0)) % 1000:03d}{b:04d}")
    if kind == "ssn":
        area, group, serial = map(int, m.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        x = (((area - (2 if area > 666 else 1)) * 99) + group - 1) * 9999 + serial - 1
        a, b = plain_feistel(*divmod(x, 9999), 898 * 99, 9999, "ssn")
        area = a // 99 + 1
        return f"{area + (area >= 666):03d}-{a % 99 + 1:02d}-{b + 1:04d}"
    if kind == "ip":
        p = [int(x) for x in m.split(".")]
        if max(p) > 255:
            return None
        a, b = plain_feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65_536, 65_536, "ip")
        return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
    if kind == "email":
        local, domain = m.split("@")
        signs, form = re.findall("[a-z0-9]", local.lower()), re.sub("[0-9]", "0", re.sub("[a-z]", "a", local.lower())) + "@" + domain.lower()
        if not signs:
            return None
        done = ""
        for lo in range(0, len(signs), 12):
            cs = signs[lo : lo + 12]
            halves = cs[: len(cs) // 2], cs[len(cs) // 2 :]
            radix = [[10 if c.isdigit() else 26 for c in h] for h in halves]
            num = [0, 0]
            for k, h in enumerate(halves):
                for c, r in zip(h, radix[k]):
                    num[k] = num[k] * r + (int(c) if c.isdigit() else ord(c) - 97)
            num = plain_feistel(*num, *(math.prod(r) for r in radix), f"email|{form}|{done}")
            more = ""
            for n, r in reversed(list(zip(num, radix))):
                for x in reversed(r):
                    n, y = divmod(n, x)
                    more = (str(y) if x == 10 else chr(97 + y)) + more
            done += more
        it = iter(done)
        return "".join((x.upper() if c.isupper() else x) if re.match("[A-Za-z0-9]", c) and (x := next(it)) else c for c in local) + "@" + domain
    order, sep = kind[5:], re.sub("[0-9]", "", m)[0]
    part = dict(zip(order, m.split(sep)))
    try:
        n = (datetime.date(int(part["y"]), int(part["m"]), int(part["d"])) - datetime.date(1900, 1, 1)).days
    except ValueError:
        return None
    if not 0 <= n < 11 * 6641:
        return None
    a, b = plain_feistel(*divmod(n, 6641), 11, 6641, "date")
    new = datetime.date(1900, 1, 1) + datetime.timedelta(a * 6641 + b)
    return sep.join({"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}[c] for c in order)


def test_pseudonyms_against_plain_python(spark, docs):
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    make = (
        lambda: f"{rng.choice(['john.smith', 'A', 'Mary-Ann_77', 'x' * 40 + digits(9), digits(3), '._'])}{digits(1)}@Mail.example.org",
        lambda: "4" + (d := digits(14)) + str(-plain_luhn("4" + d + "0") % 10),
        lambda: f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}",
        lambda: f"+{rng.randint(1, 999)} ({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        lambda: ".".join(str(rng.randint(0, 300)) for _ in range(4)),
        lambda: f"{rng.randint(1890, 2110)}-{rng.randint(0, 13):02d}-{rng.randint(0, 31):02d}",
        lambda: f"{rng.randint(0, 31):02d}.{rng.randint(0, 13):02d}.{rng.randint(1890, 2110)}",
        lambda: f"{rng.randint(0, 13):02d}/{rng.randint(0, 31):02d}/{rng.randint(1890, 2110)}",
    )
    rows = [(k, " ".join(x for _ in range(6) for x in (prose(rng, 3), rng.choice(make)()))) for k in range(150)]
    rows += [(k, t) for k, t in rows[:5]] + [(900, None), (901, ""), (902, "x " * 200_000 + "1.2.3.4"), (None, "a@b.co and A@b.co and b@b.co")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_email", F.lit("clash"))
    out = pii.pseudonymise(d)
    assert out.columns[:3] == ["doc_id", "text", "n_email"] and pii.pseudonymise(d.where("false")).count() == 0
    want = []
    for k, text in rows:
        n = {}
        for kind in pii.KINDS:
            def swap(m, kind=kind):
                new = plain_pseudonym(kind.name, m[0])
                n[kind.name] = n.get(kind.name, 0) + (new is not None)
                return m[0] if new is None else new

            text = text if text is None else re.sub(kind.pattern, swap, text)
        want.append((k, text, *(n.get(kind.name, 0) for kind in pii.KINDS)))
    got = [(r.doc_id, r.text, *(int(r[f"n_{kind.name}"]) for kind in pii.KINDS)) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[2] for x in want) > 20 and all(sum(x[c] for x in want) > 5 for c in range(3, 10))


def test_pseudonyms_are_distinct(spark):
    """All values of a small format, each once: their pseudonyms are the same values in another order."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{a}{b}{c}@x.org" for a in letters for b in letters for c in "0123456789"]
    ips = [f"10.0.{a}.{b}" for a in range(30) for b in range(256)]
    days = [(datetime.date(1990, 1, 1) + datetime.timedelta(k)).isoformat() for k in range(5000)]
    phones = [f"+1 ({a:03d}) 555-{b:04d}" for a in range(50) for b in range(100)]
    for values, closed in ((mails, True), (ips, False), (days, False), (phones, False)):
        out = [r.text for r in pii.pseudonymise(spark.createDataFrame([(k, v) for k, v in enumerate(values)], "doc_id long, text string")).collect()]
        assert len(set(out)) == len(values) and sum(a == b for a, b in zip(out, values)) < len(values) / 20
        assert not closed or set(out) == set(values)


# ---------------------------------------------------------------- 5


def test_nearest_lattice_point():
    x = np.random.default_rng(0).normal(size=(50, 8)) * 2
    near = embeddings.nearest_e8(x)
    steps = np.concatenate([embeddings._LEAST, np.zeros((1, 8))])
    d = ((x - near) ** 2).sum(1)
    assert (((x[:, None] - near[:, None] - steps) ** 2).sum(2) >= d[:, None] - 1e-9).all() and (d <= 1 + 1e-9).all()


def test_embedding_links(spark):
    rng, rows = np.random.default_rng(3), []
    centre = rng.normal(size=(6, 64))
    for k in range(300):
        v = centre[k % 6] + rng.normal(size=64) * (0.12 if k % 2 else 3.0)
        rows.append((k, [float(np.float32(a)) for a in v], int(k % 3) if k % 7 else None))
    rows += [(400 + k, rows[1][1], rows[1][2]) for k in range(20)]
    rows += [(600, None, 1), (601, [], 1), (602, [0.0] * 64, 1), (603, [1.0, None] + [0.0] * 62, 1), (604, [float("nan")] + [0.0] * 63, 1), (605, [float("inf")] + [0.0] * 63, 1), (606, [1.0, 2.0], 1)]
    got = {r.vec_id: r for r in embeddings.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    x = {i: np.array(v, np.float32).astype(float) for i, v, lab in rows if i < 600 and lab is not None}
    label = {i: lab for i, _, lab in rows}
    links = collections.defaultdict(set)
    for a, b in itertools.combinations(sorted(x), 2):
        if label[a] == label[b] and x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= 0.93:
            links[a].add(b)
            links[b].add(a)
    assert len(got) == len(rows) and sum(map(len, links.values())) > 1000
    for i in label:
        seen, front = {i}, [i]
        while front:
            new = links[front.pop()] - seen
            seen |= new
            front += new
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), min(seen), min(seen) == i)


def test_embeddings_of_doubles_and_text_labels(spark):
    a = [1.0, 0.0, 1e-9]
    rows = [(1, a, "x", "c"), (2, [1.0, 0.0, 2e-9], "x", "c"), (2, a, "x", "c"), (3, a, "y", "c"), (4, [0.0, 1.0, 0.0], "x", "c"), (5, None, "x", "c"), (6, a, None, "c")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, node string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_copies(d).collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True)]
    assert embeddings.near_copies(d.where("false")).count() == 0


# ---------------------------------------------------------------- 6


def tox_terms(text):
    """Words and their beginnings, with their numbers, in plain Python."""
    out = {}
    for w in re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())):
        for t in [w, *(w[:n] for n in toxicity.BEGINNINGS if len(w) > n)]:
            out[t] = out.get(t, 0) + 1
    return out


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(5)
    size = 300
    idf = rng.uniform(0.1, 5, size)
    chance = 1 / np.arange(1, size + 1)
    rows = []
    for k in range(700):
        t = np.sort(rng.choice(size, rng.integers(1, 40), replace=False, p=chance / chance.sum()))
        rows.append((k, t, rng.integers(1, 4, len(t))))
    for dense in (1 << 23, 700 * 64, 0):  # all terms that occur often in the table, some, none
        index = toxicity.Index.build(list(rows), {k: int(k % 3 == 0) for k, _, _ in rows}, np.arange(size, dtype=np.uint64), idf, 0.1, dense)
        assert dense == 0 or index.dense.shape[1] > 0

        def vector(t, f):
            v = np.zeros(size)
            v[t] = (1 + np.log(f)) * index.factor[t]
            return v / np.sqrt(v @ v)

        own = {k: vector(t, f) for k, t, f in rows}
        many = np.stack([own[int(i)] for i in index.ids])
        edges = np.cumsum([0, *(len(t) for _, t, _ in rows[:90])])
        near, cos = index.nearest(edges, *(np.concatenate([r[c] for r in rows[:90]]) for c in (1, 2)), 10)
        for k in range(90):
            want = many @ own[k]
            assert np.allclose(cos[k], np.sort(want)[::-1][:10], atol=1e-5)
            assert np.allclose(want[near[k]], cos[k], atol=1e-5)


def toxic_docs(n=600):
    rng, rows, labels = random.Random(6), [], []
    for k in range(n):
        bad = k % 5 == 0
        rows.append((k, prose(rng, 40) + (" idiot moron" if bad else ""), "en", "s", 1))
        labels.append((k, 1, int(bad)))
    return rows, labels


def test_terms_are_counted_in_little_memory():
    rng = np.random.default_rng(1)
    words = [f"w{i:06d}" for i in range(30_000)]
    rows = pa.array([" ".join(rng.choice(words, 300)).encode() for _ in range(2000)], pa.binary())
    vocabulary = np.unique(np.concatenate([t for t, *_ in toxicity.terms_of(rows.slice(0, 500))]))
    whole = sum(int(tf.sum()) for k in range(0, 2000, 50) for _, _, tf in toxicity.counted(rows.slice(k, 50), vocabulary))
    tracemalloc.start()
    total = sum(int(tf.sum()) for _, _, tf in toxicity.counted(rows, vocabulary))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == whole > 0
    assert peak < 40e6


def test_workers_give_memory_back(spark, monkeypatch):
    """Of each Arrow function of the pipeline's stages that reads texts or sets, and of Arrow's own pool."""
    released = []

    class Pool:
        def release_unused(self):
            released.append(True)

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    assert list(common.lean(lambda batches: batches)(iter([1, 2]))) == [1, 2]
    assert len(released) == 2
    for module in (toxicity, ngram_join, secrets, bpe):
        calls = set(re.findall(r"\.mapInArrow\((\w+)", inspect.getsource(module)))
        # the trees of components hold small integers alone
        assert calls - {"trees"} == {"lean"}, module.__name__


def test_toxicity_on_held_out(spark):
    rows, labels = toxic_docs()
    rows += [(900, None, None, None, None), (901, "", "", "", 0), (902, "word " * 100_000 + "idiot", "en", "s", 1)]
    d = spark.createDataFrame(rows, SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(d, lab).collect()
    truth = {k: t for k, _, t in labels}
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.doc_id == 902 or r.predicted == truth.get(r.doc_id, 0)
    wide = d.withColumnsRenamed({"lang": "score", "source": "terms"})
    assert toxicity.keep_clean(d, lab).count() in (482, 483)
    assert toxicity.keep_clean(wide, lab).columns == wide.columns
    assert toxicity.score(empty(spark), lab.where("false")).count() == toxicity.keep_clean(empty(spark), lab).count() == 0
    none = toxicity.score(d, lab.where("false")).select("score").distinct().collect()
    assert [r.score for r in none] == [1e-4]


def test_held_out_labels_teach_nothing(spark):
    rows, labels = toxic_docs(200)
    rows += [(7, "another text of the id seven", "en", "s", 1)]
    d = spark.createDataFrame(rows, SCHEMA)
    flipped = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, q, t in labels]
    one, two = (sorted(map(tuple, toxicity.score(d.repartition(n), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())) for n, x in ((3, labels), (2, flipped)))
    assert one == two


def test_toxicity_against_brute_force(spark):
    rows, labels = toxic_docs(240)
    rows += [(500, rows[5][1], "en", "s", 1), (501, "idiots moronic unknownword", "en", "s", 1), (502, "", "", "", 0)]
    d, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    train = {k: t for k, _, t in labels if zlib.crc32(str(k).encode()) % 5}
    text = {r[0]: tox_terms(r[1]) for r in rows}
    vocabulary = sorted({t for k in train for t in text[k]})
    n, n1, n0 = len(train), sum(train.values()), len(train) - sum(train.values())
    rate = n1 / n
    idf = {t: math.log((len(rows) + 1) / (sum(t in v for v in text.values()) + 1)) + 0.1 for t in vocabulary}

    def gain(t):
        a, b = sum(train[k] for k in train if t in text[k]), sum(1 - train[k] for k in train if t in text[k])
        r = (a + b) / n
        g = sum(k * math.log(k / e) for k, e in ((a, n1 * r), (b, n0 * r), (n1 - a, n1 * (1 - r)), (n0 - b, n0 * (1 - r))) if k > 0)
        return max(g - math.log(len(vocabulary)), 0) / (-n * (rate * math.log(rate) + (1 - rate) * math.log(1 - rate)))

    says = {t: gain(t) for t in vocabulary}
    top = max(says.values()) or 1.0

    def vector(k):
        v = {t: (1 + math.log(f)) * idf[t] * (toxicity.PLAIN * top + says[t]) for t, f in text[k].items() if t in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    vectors, weigh = {k: vector(k) for k in text}, {0: (1 - rate) / n0, 1: rate / n1}

    def vote(k, others):
        cos = sorted(((sum(x * vectors[o].get(t, 0.0) for t, x in vectors[k].items()), o) for o in others), reverse=True)[: toxicity.NEAREST]
        w = [weigh[train[o]] / (1.1 - min(c, 1.0)) for c, o in cos if c > 0]
        return sum(x * train[o] for x, (c, o) in zip(w, cos)) / sum(w) if w else None

    got = {r.doc_id: r for r in toxicity.score(d, lab).collect()}
    votes = {k: vote(k, train) for k in text if vectors[k]}
    index = toxicity.learn(d, lab, 5, 0, 4000)
    own = sorted((vote(k, [o for o in train if o != k]), train[k]) for k in train)
    assert np.allclose(sorted(index.steps[0]), sorted(set(index.steps[0].tolist())))
    assert {round(float(s), 5) for s in index.steps[0]} <= {round(v, 5) for v, _ in own}
    for k, v in votes.items():
        assert got[k].score == pytest.approx(float(np.interp(v, *index.steps)), abs=1e-4)
        best = max(sum(x * vectors[o].get(t, 0.0) for t, x in vectors[k].items()) for o in train)
        assert sum(x * vectors[got[k].evidence[0]].get(t, 0.0) for t, x in vectors[k].items()) == pytest.approx(best, abs=1e-5)
    assert got[502].score == pytest.approx(rate)


# ---------------------------------------------------------------- 7


def test_bpe_equals_the_library(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.public_vocabulary())
    odd = "aAΣİß́ \x1c\x85 \t\n'sLL²٠٣一\U0001f600#$%_-=<|>éﬁÅ1⅓‍ẞ"
    rng = random.Random(1)
    more = [(1000 + k, "".join(rng.choice(odd) for _ in range(rng.randint(1, 60))), "x", "y", 1) for k in range(300)]
    more += [(2000, "x<|endoftext|>Y <|startoftext|><|END|> don't WE'LL", "x", "y", 1), (2001, "ab" * 700, "x", "y", 1)]
    every = docs.drop("size").unionByName(spark.createDataFrame(more, SCHEMA))
    got = bpe.encode(every.select("doc_id", "text", F.lit(1).alias("n_tokens")), digest=True).collect()
    text = {r.doc_id: r.text or "" for r in every.collect()}
    assert len(got) == every.count()
    for r in got:
        ids = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(empty(spark)).count() == 0


def test_lexicon_shares_suffixes():
    words = {f"{a}{b}ing".encode(): [i, j] for i, a in enumerate("bcdf") for j, b in enumerate(("a", "ee", "oo"))}
    blob = bpe.compile_lexicon(words)
    lex = bpe.Lexicon(blob)
    ranks = lex.ranks([*words, b"b", b"", b"baingx", b"zz"])
    assert [np.frombuffer(lex.ids_of(r), "<u4").tolist() for r in ranks[: len(words)]] == list(words.values())
    assert (ranks[len(words) :] == -1).all() and len(lex.final) < sum(map(len, words))


# ---------------------------------------------------------------- 8


def jaccard_by_hand(rows):
    sets = {}
    for i, t, _ in rows:
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return sets, {i: root(i) for i in sets}


def test_jaccard_groups(spark, docs):
    sets, comp = jaccard_by_hand(texts(docs))
    got = ngram_join.jaccard_groups(docs).collect()
    assert len(got) == docs.count() and len(set(comp.values())) < len(comp)
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), comp[r.doc_id])
    assert ngram_join.jaccard_groups(empty(spark)).count() == 0
    kept = [r.doc_id for r in ngram_join.keep_one(docs).collect()]
    assert sorted(kept) == sorted(set(comp.values()) | {500, 501, 502}) and len(kept) == len(set(kept))


def test_every_group_keeps_one_row(spark):
    """An id with several texts: each group of near duplicates keeps its first row by id and text, and no other."""
    rng = random.Random(13)
    a, b, c, d = (prose(rng, 120) for _ in range(4))
    rows = [(5, a), (9, a + " zz"), (5, b), (3, b + " zz"), (7, c), (7, d), (8, "yy " + d), (6, "m " + c), (6, "k " + c), (6, "k " + c), (20, None), (20, ""), (None, a), (21, prose(rng, 90)), (21, prose(rng, 90))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or -1, r.text or "") for r in ngram_join.keep_one(frame).collect())
    want = [(5, a), (3, b + " zz"), (6, "k " + c), (7, d), (20, ""), (20, ""), (-1, a), *rows[-2:]]
    assert got == sorted(want)


def test_jaccard_in_large_groups(spark):
    """A large group of near copies around the bound, with a frequent passage: no link may be lost."""
    rng, rows = random.Random(8), []
    base, passage = prose(rng, 150).split(), prose(rng, 40)
    for k in range(160):
        words = list(base)
        for _ in range(rng.randint(1, 7)):
            words[rng.randrange(150)] = f"q{rng.randrange(10_000)}"
        rows.append((k, " ".join(words), "en", "s", 1))
    rows += [(1000 + k, prose(rng, 15) + " " + passage, "en", "s", 1) for k in range(60)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(5)
    _, comp = jaccard_by_hand(texts(d))
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(d).collect()} == comp


def test_sketches_split_what_shares_large_groups(spark, monkeypatch):
    """Texts that share passages bring their sets only if sketches leave a link possible, and no link across components is lost."""
    rng, rows = random.Random(21), []
    passages = [prose(rng, 14) for _ in range(6)]
    for k in range(150):
        rows.append((k, f"{prose(rng, 40)} {passages[k % 6]} {prose(rng, 3)} {passages[(k + 1) % 6]} {prose(rng, 40)}"))
    rows += [(500 + k, rows[k][1] + f" {prose(rng, 4)}") for k in range(0, 150, 30)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets, comp = jaccard_by_hand([(*r, None) for r in rows])
    asked, whole = [], ngram_join.sets_of
    monkeypatch.setattr(ngram_join, "frequent_shingles", lambda _: np.empty(0, np.uint64))
    monkeypatch.setattr(ngram_join, "sets_of", lambda docs, wanted: asked.append(wanted.count()) or whole(docs, wanted))
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(d).collect()} == comp
    assert len(set(comp.values())) == 150 and max(asked) <= 20


def test_likely_pairs_are_those_that_may_link():
    from movespark.llm.textblock import blocks

    rng, rows = random.Random(22), []
    for _ in range(12):
        base = prose(rng, rng.randint(5, 140)).split()
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = f"q{rng.randrange(10_000)}"
            rows.append(" ".join(words))
    s = ngram_join.Sets(next(blocks(pa.array(rows), lower=True)))
    sketches, comp = s.sketches(), np.arange(len(rows)) // 2
    node = np.array(rng.sample(range(10**6), len(rows)))
    a, b = ngram_join.likely(node, comp, s.n, sketches, np.arange(len(rows)))
    forest = ngram_join.Forest()
    for i, j in itertools.combinations(range(len(rows)), 2):
        if comp[i] != comp[j] and ngram_join.may_link(int(s.n[i]), int(s.n[j]), sketches[i], sketches[j]):
            forest.merge(int(node[i]), int(node[j]))
    assert len({len(x) for x in sketches}) > 1 and sorted(zip(a.tolist(), b.tolist())) == sorted(zip(*forest.stars()))


def test_passages_of_few_texts_in_a_block_are_frequent(spark):
    """A passage that no block holds often is found to be frequent all the same, once for equal texts."""
    rng = random.Random(23)
    passage, copy = prose(rng, 30), prose(rng, 60)
    rows = [(k, f"{prose(rng, 20)} {passage}" if k % 8 == 0 else copy if k % 8 == 1 else prose(rng, 30)) for k in range(1600)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(200, "doc_id")
    frequent = set(ngram_join.frequent_shingles(ngram_join.shingle_sets(d)).tolist())
    from movespark.llm.textblock import blocks

    s = ngram_join.Sets(next(blocks(pa.array([passage, copy]), lower=True)))
    assert set(s.tokens[s.of == 0].tolist()) <= frequent and not set(s.tokens[s.of == 1].tolist()) & frequent


def test_bound_of_segments():
    """Every pair that links shares a key, whatever is taken for frequent."""
    rng = np.random.default_rng(9)
    from movespark.llm.textblock import blocks

    for trial in range(60):
        words = [f"w{rng.integers(0, 10**6)}" for _ in range(rng.integers(1, 120))]
        other = list(words)
        for _ in range(int(len(words) * 0.03)):
            other[rng.integers(0, len(other))] = "zz"
        other = other[: max(1, len(other) - int(rng.integers(0, 6)))]
        s = ngram_join.Sets(next(blocks(pa.array([" ".join(words), " ".join(other)]), lower=True)))
        a, b = (set(s.tokens[s.first[k] : s.first[k + 1]].tolist()) for k in (0, 1))
        if len(a & b) * 100 >= 75 * len(a | b):
            frequent = np.sort(rng.choice(s.tokens, int(len(s.tokens) * rng.uniform(0, 1)), replace=False)) if trial % 2 else np.empty(0, np.uint64)
            key, of = ngram_join.segment_keys(s, frequent, np.ones(2, bool))
            assert s.print[0] == s.print[1] or set(key[of == 0].tolist()) & set(key[of == 1].tolist())
            assert ngram_join.may_link(len(a), len(b), *s.sketches())


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)] + [(None, 3), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert got == {x: root(x) for x in list(up)}


# ---------------------------------------------------------------- 9


def test_secrets(spark):
    rng = random.Random(4)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(k, f"é {prose(rng, 20)} {rng.choice(['password=', 'Token: ', 'api_key = \"', 'SECRET:'])}{hexa(18)} {prose(rng, 5)} AKIA{''.join(rng.choice('ABCDEFGH234567') for _ in range(16))}\n{hexa(40)} x") for k in range(40)]
    rows += [(90, None), (91, ""), (92, "password=short token=abc AKIA12 " + "a" * 23), (93, "ſecret=abcdefgh"), (94, prose(rng, 3000))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.find_secrets(d).collect()}
    pats = [(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A, 2, 6), (r"AKIA[A-Z0-9]+", 0, 0, 20), (r"[0-9a-f]+", 0, 0, 24)]
    for i, t in rows:
        spans = sorted((m.start(), k, m.end()) for k, (p, f, g, n) in enumerate(pats) for m in re.finditer(p, t or "", f) if len(m[g]) >= n)
        base = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == x for _, k, _ in spans) for x in range(3)]
        assert set(base.split(",")) <= set(got[i].spans.split(","))
        added = [x for x in got[i].spans.split(",") if x.startswith("format")]
        assert not added or i < 90
    clean = {r.doc_id: r.text for r in secrets.redact(d).collect()}
    assert clean[90] is None and clean[91] == "" and clean[94] == rows[-1][1]
    assert all(not re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", clean[k]) and clean[k].startswith("é ") for k in range(40))


def test_formats_that_no_pattern_knows(spark):
    """Bare credentials of the formats given are found as a whole, whether or not a base span is part of them; prose is not."""
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("aeioubcdlnrst") for _ in range(rng.randint(3, 12))) for _ in range(n))
    dates = lambda n: " ".join(f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}" for _ in range(n))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    kinds = {"pat": lambda: "ghp_" + "".join(rng.choice(alnum) for _ in range(36)), "dotted": lambda: ".".join("".join(rng.choice(alnum) for _ in range(n)) for n in (24, 6, 27))}
    given = {k: [make().encode() for _ in range(200)] for k, make in kinds.items()}
    rows = []
    for k in range(60):
        secret = list(kinds.values())[k % 2]()
        if k % 10 == 0:
            secret = secret[:6] + "".join(rng.choice("0123456789abcdef") for _ in range(24)) + secret[30:]  # holds a base span
        rows.append((k, f"é{words(60)} {secret}. {words(10).upper()} see http://x.org/{k}/a-b.html {dates(3)}", secret))
    rows += [(100 + k, f"{words(300).title()} v1.2.3 {dates(4)} a.b.c", "") for k in range(20)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("format")] for r in secrets.find_secrets(d, given).collect()}
    caught = sum(got[i] == [f"format:{t.index(x)}:{t.index(x) + len(x)}"] for i, t, x in rows if x)
    assert caught >= 57 and not any(got[i] for i, _, x in rows if not x)
    clean = {r.doc_id: r.text for r in secrets.redact(d, labelled=given).collect()}
    assert sum(clean[i] == t.replace(x, "[SECRET]") for i, t, x in rows if x) >= 57
    assert all(clean[i] == t for i, t, x in rows if not x)


def test_scores_of_many_tokens_are_those_of_one():
    rng = random.Random(9)
    keys = [bytes(rng.choice(b"0123456789abcdefXYZ") for _ in range(rng.randint(6, 40))) for _ in range(300)]
    f = secrets.Formats({"k": keys[:100]}, [p.encode() for p in prose(rng, 500).split()])
    many = [bytes(rng.choice(b"abcXYZ019._-") for _ in range(rng.randint(6, 200))) for _ in range(300)] + keys
    data = np.frombuffer(b" ".join(many), np.uint8)
    lengths = np.array([len(t) for t in many])
    starts = np.cumsum(lengths + 1) - lengths - 1
    assert f.are_secrets(data, starts, lengths).tolist() == [f.is_secret(t) for t in many]


def test_secrets_in_hard_tables(spark):
    rng = random.Random(10)
    long = " ".join(f"password=k{k:06d}x{k * 7919 % 100_003:06d}" for k in range(20_000))  # many spans and candidates in one text
    began = time.time()
    c = secrets.Chunk([long.encode(), b"\n.\n", b"."])
    assert len(c.spans) == 20_000 and not len(c.starts) and time.time() - began < 10
    assert secrets.find_secrets(empty(spark)).count() == secrets.redact(empty(spark)).count() == 0
    rows = [(1, "token=abcdef12", "a"), (1, "token=abcdef12", "a"), (2, prose(rng, 5), None), (None, None, "b"), (3, "x" * 500_000 + " AKIA" + "Q7" * 10, "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("n_chars", F.length("text"))
    out = secrets.find_secrets(d).collect()
    assert len(out) == 5 and len({(r.spans, r.n_assign) for r in out if r.doc_id == 1}) == 1
    clean = secrets.redact(d)
    assert clean.columns == d.columns
    assert sorted((r.text or "")[-20:] for r in clean.collect()) == sorted(["[SECRET]", "[SECRET]", rows[2][1][-20:], "", ("x" * 20 + " [SECRET]")[-20:]])
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in clean.collect())


def test_automata_tell_formats_from_words():
    rng = random.Random(5)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(32)).encode() for _ in range(300)]
    words = ["-".join(prose(rng, 3).split()).encode() + b"-99" for _ in range(300)]
    f = secrets.Formats({"hex": keys[:200]}, words)
    assert sum(map(f.is_secret, keys[200:])) > 90 and sum(map(f.is_secret, words)) < 10


# ---------------------------------------------------------------- 10


def test_quality(spark, docs):
    def by_hand(t):
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        marked = {j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked)

    more = spark.createDataFrame([(800, "a b\na b\n\n a b\n" * 9, "", "", 1), (801, "ok### | <b>% " * 30, "", "", 1)], SCHEMA)
    every = docs.drop("size").unionByName(more)
    text = {r.doc_id: r.text or "" for r in every.collect()}
    got = quality.judge(every.select("doc_id", "text", F.lit(0).alias("kept"))).collect()
    assert len(got) == every.count()
    for r in got:
        n = by_hand(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r.base_failed and r.kept)
    back = {r.doc_id: r.kept for r in quality.judge(every.select("doc_id", "text"), quality.RULES[::-1], figures=False).collect()}
    assert back == {r.doc_id: r.kept for r in got}
    assert quality.keep_good(every).count() == sum(r.kept for r in got)
    few, many = (quality.judge(every.select("doc_id", "text"), rules, figures=False).collect() for rules in (quality.RULES, quality.RULES[::-1]))
    place = {r.name: k for k, r in enumerate(quality.RULES)}
    assert all(r.rules_tried == (len(place) if r.kept else place[r.rejected_by] + 1) for r in few)
    assert sum(r.rules_tried for r in few) < sum(r.rules_tried for r in many)  # the base rules reject most
    assert quality.judge(empty(spark)).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "encoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, step) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = step(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k == 1:
            _, comp = jaccard_by_hand(texts(before))
            assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(set(comp.values()))
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.public_vocabulary())
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count() > 0
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == t.encode(text[r.doc_id], add_special_tokens=False).ids


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {re.match(r"op\d+_", n)[0] for n in names if n.startswith("op")} and "pipeline" in names
    assert json.dumps(sorted(names))
