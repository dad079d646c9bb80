"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import os
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import ann, chat, decontaminate, jaccard, packing, pii, suffix_dedup, toxicity, url_filter, warc
from tessera.llm.common import new_path
from tessera.llm.components import connected
from tessera.llm.trie import PrefixTree

WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS)
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, _id string, key string, n long, x long"


def docs_of(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "a", "k", 1, 2) for i, t in texts]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def nasty(spark):
    near = LONG.replace("w200", "changed")
    texts = [(1, None), (2, ""), (3, "one"), (4, LONG), (5, LONG), (5, LONG), (6, near), (7, "é" * 5000), (8, "a b c d"), (9, "A B C D"), (None, "mail to a.b@c.de now"), (10, " \n\t "), (11, " ".join(WORDS * 60)), (12, "+1 (555) 010-9999 call 4111 1111 1111 1111 or 10.0.0.1 and 300.1.1.1")]
    return docs_of(spark, texts)


def empty(df):
    return df.where("false")


def test_url_filter(spark):
    rows = [(1, "http://A.Example.NET/en/x?q#f"), (2, "http://b.net"), (3, "http://b.net/"), (4, None), (5, "no url"), (6, "https://example.com/de/"), (7, "https://example.com/dex"), (8, "x://org/fr/a"), (9, "x://notexample.net/en/"), (1, "http://A.Example.NET/en/x?q#f")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, host string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, "url", url_filter.RULES, ["page_id"]).collect()}
    assert got == {(1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "b.net", "", None, "allow"), (3, "b.net", "/", "net/", "block"), (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "example.com", "/de/", "example.com/de/", "block"), (7, "example.com", "/dex", None, "allow"), (8, "org", "/fr/a", "org/fr/", "allow"), (9, "notexample.net", "/en/", "net/", "block")}
    joined = url_filter.judge(df, "url", url_filter.RULES, ["page_id"], max_trie_bytes=0)
    assert {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in joined.collect()} == got
    assert joined.count() == 10 and url_filter.judge(empty(df), "url", url_filter.RULES, ["page_id"]).count() == 0
    trie = url_filter.UrlTrie([("block", "a.com", "/pr"), ("allow", "a.com", "/private/x"), ("allow", "b.org", "/"), ("block", "b.org", "/")])
    assert trie.match("q.a.com", "/private/y") == ("a.com/pr", "block")
    assert trie.match("a.com", "/private/xyz") == ("a.com/private/x", "allow")
    assert trie.match("b.org", "/q") == ("b.org/", "allow") and trie.match("com", "/") is None


def test_ann(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    rows += [(60, None), (61, [0.0] * 8), (62, [1.0, float("nan"), *[0.0] * 6]), (63, [None, *[1.0] * 7]), (64, rows[3][1]), (65, rows[3][1]), (3, rows[3][1]), (66, [1.0, 2.0]), (67, []), (None, rows[1][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, qcid long")
    got = ann.nearest(df, "vec_id", "embedding", df["vec_id"] % 3 == 0, target=1.0).collect()
    valid = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and None not in v and len(v) == 8 and np.isfinite(v).all() and any(v)}
    for q in [i for i in valid if i % 3 == 0]:
        want = sorted(((-sum(float(a) * float(b) for a, b in zip(valid[q], v)), i) for i, v in valid.items() if i != q))[:20]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[1] for m in mine] == [i for _, i in want] and [m[0] for m in mine] == list(range(1, 21))
        assert np.allclose([m[2] for m in mine], [-s for s, _ in want], rtol=0, atol=1e-12)
    assert not [r for r in got if r["query_id"] in (60, 63)]
    assert ann.nearest(empty(df), "vec_id", "embedding", df["vec_id"] % 3 == 0).count() == 0
    few = ann.nearest(df.where("vec_id < 15"), "vec_id", "embedding", df["vec_id"] % 3 == 0).collect()
    assert len(few) == 5 * 14  # all candidates, if there are fewer than 20


def ann_recall(spark, x, **options):
    """Mean recall at 20 of every 200th of the rows, and the least number of rows a query got."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, "vec_id", "embedding", df["vec_id"] % 200 == 0, **options).select("query_id", "vec_id").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    x = x.astype(np.float32).astype(float)
    hits = []
    for q in range(0, len(x), 200):
        score = x @ x[q]
        score[q] = -np.inf
        hits.append(len(got[q] & set(np.argsort(-score)[:20].tolist())) / 20)
    return np.mean(hits), min(map(len, got.values()))


@pytest.mark.parametrize("norms", ["unit", "outlier", "lognormal"])
def test_ann_recall_on_20000_vectors(spark, norms):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 64))
    x *= 1.5 / np.linalg.norm(x, axis=1)[:, None]
    if norms == "outlier":
        x[7] *= 1000
    elif norms == "lognormal":
        x *= np.exp(rng.normal(size=len(x)) * 0.8)[:, None]
    recall, rows = ann_recall(spark, x)
    assert recall >= 0.9 and rows == 20


def test_ann_probes_part_of_the_index_and_splits_buckets(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(80, 64))
    x = centres[np.arange(8000) % 80] + 0.15 * rng.normal(size=(8000, 64))
    x[:2600] = centres[0] + 1e-3 * rng.normal(size=(2600, 64))  # a third in one bucket
    probes = ann.fitted_probes(np.zeros(2000, int), x[::4], {0: 8000}, 20)
    assert probes[0] <= 16  # of 128 signed axes: near vectors need few probes
    whole, rows = ann_recall(spark, x)
    split, _ = ann_recall(spark, x, bucket=500)
    assert whole == split >= 0.9 and rows == 20


def test_warc_round_trip(spark):
    big = "x" * 700_000
    rows = [(1, None, None), (2, "http://a/\r\n", "é" * 60), (3, "u", "é" * 60), (4, "u", big), (5, "u", big), (6, "u", "short"), (7, "u", "short"), (None, "u", big)]
    df = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    manifest = warc.write_archives(warc.chunked(warc.record_table(df, "page_id", "url", "html"), 1 << 16), new_path(spark, "t"))
    got = warc.read_chunks(manifest, 1 << 16).collect()
    payload = {}
    for r in sorted(got, key=lambda r: (str(r["record_id"]), r["chunk_no"])):
        payload[r["record_id"]] = payload.get(r["record_id"], b"") + bytes(r["payload"])
        assert len(r["payload"]) <= 1 << 16
    last = {r["record_id"]: r for r in got if r["is_last"]}
    for i, _, html in rows:
        body = (html or "").encode()
        assert last[i]["bytes_so_far"] == len(body) and last[i]["digest_so_far"] == hashlib.sha256(body).hexdigest()
        if last[i]["record_type"] == "response":
            assert payload[i] == body
    assert {i: r["refers_to"] for i, r in last.items()} == {1: None, 2: None, 3: 2, 4: None, 5: 4, 6: None, 7: None, None: 4}
    none = warc.write_archives(warc.chunked(warc.record_table(empty(df), "page_id", "url", "html")), new_path(spark, "t"))
    assert warc.read_chunks(none).count() == 0


def test_packing(spark, nasty):
    from tokenizers import Tokenizer

    spec = packing.default_tokenizer()
    tok = Tokenizer.from_str(spec)
    special = docs_of(spark, [(1, "a <|endoftext|>  b  <|endoftext|>")])
    for df in (nasty, special):
        rows = df.collect()
        for window, tolerance in ((2048, 32), (64, 0)):
            got = packing.pack(df, spec, window=window, grain=8, tolerance=tolerance).collect()
            want = sorted((r["doc_id"] is None, r["doc_id"], tuple(tok.encode(r["text"] or "", add_special_tokens=False).ids) + (1,)) for r in rows)
            for _, i, ids in want:
                pieces = [p for p in got if p["doc_id"] == i and p["doc_tokens"] == len(ids)]
                copies = sum(w[1:] == (i, ids) for w in want)
                assert sum(p["length"] for p in pieces) == copies * len(ids)
                for p in pieces:
                    assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
            ends = {}
            for p in sorted(got, key=lambda p: (p["sequence_id"], p["offset"])):
                assert p["offset"] == ends.get(p["sequence_id"], 0)
                ends[p["sequence_id"]] = p["offset"] + p["length"]
            assert max(ends.values()) <= window
    assert packing.pack(empty(nasty), spec).count() == 0


def test_packing_plan_covers_any_histogram():
    rng = np.random.default_rng(0)
    for _ in range(20):
        histogram = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 257), 40, replace=False), rng.integers(1, 500, 40))}
        plan = packing.make_plan(histogram, 256, 2, 4)
        filled = {}
        for length, entries in plan.items():
            firsts = [e[0] for e in entries] + [histogram[length]]
            assert firsts[0] == 0 and firsts == sorted(firsts)
            for (first, kind, a, b), end in zip(entries, firsts[1:]):
                for r in range(end - first):
                    if kind == 0:
                        filled.setdefault(a + r, []).append((b, length))
                    else:
                        position, left = a + r * length, length
                        while left:
                            part = min(left, 256 - position % 256)
                            filled.setdefault(b + position // 256, []).append((position % 256, part))
                            position, left = position + part, left - part
        for pieces in filled.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            assert end <= 256
        total = sum(k * n for k, n in histogram.items())
        assert 256 * len(filled) <= total * 1.03 + 256


def test_decontamination(spark, nasty):
    item = " ".join(WORDS[100:140])
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one"), (5, "zzz " * 30)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(nasty, items).collect()}
    assert got == {(3, 4), (4, 1), (5, 1), (6, 1), (11, 1)}
    # an item without an id is found, and items of one id are searched by their own texts
    again = spark.createDataFrame([(None, item), (1, " ".join(WORDS[300:340])), (1, "zzz " * 30)], "item_id long, text string")
    named = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(nasty, again).collect()}
    assert named == {(i, j) for i in (4, 5, 6, 11) for j in (None, 1)}
    kept = decontaminate.clean(nasty, items)
    assert kept.columns == nasty.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "7", "8", "9", "None", "10", "12"])
    assert decontaminate.contaminated(empty(nasty), items).count() == 0 and decontaminate.contaminated(nasty, empty(items)).count() == 0


def test_decontamination_against_every_window(spark):
    rng = np.random.default_rng(8)
    items = [" ".join(rng.choice(WORDS, n)) for n in (30, 45, 60)]
    texts = []
    for i in range(90):
        words = items[i % 3].split()
        if i % 2:
            cut = rng.integers(8, len(words) - 8)  # halves in the other order
            words = words[cut:] + words[:cut]
        for _ in range(rng.integers(0, 2)):
            words[rng.integers(0, 2)] = "edit"
        at = rng.integers(5, len(words) - 5)
        words = words[:at] + ["more"] * rng.integers(0, 4) + words[at:]
        around = [" ".join(rng.choice(WORDS, rng.integers(0, 20))) for _ in range(2)]
        texts.append(" ".join([around[0], *words, around[1]]).strip())
    bag = lambda w: Counter(zip(*(w[k:] for k in range(5))))
    want = {}
    for i, t in enumerate(texts):
        w = t.split()
        for j, item in enumerate(items):
            b, size = bag(item.split()), len(item.split())
            best = max((sum((x := bag(w[s : s + size])).values()) and (x & b).total() / (x | b).total()) for s in range(len(w)))
            if best >= 0.8:
                want[i, j] = best
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == pytest.approx(want) and len(want) > 20
    assert any(i % 2 for i, _ in want)


def test_toxicity(spark, nasty):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        text = " ".join(f"n{rng.integers(0, 900)}" for _ in range(30))
        if i % 6 == 0:
            text += [" you idiot and moron", " zorgish zorgful zorgness zorgly"][i % 12 == 0]
        rows.append((i + 1000, text))
        labels.append((i + 1000, 1, int(i % 6 == 0), "t"))
    labels += [(None, 1, 1, "t"), (1000, 1, None, "t")]
    docs = docs_of(spark, rows).union(nasty)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    model = toxicity.train(docs, marks)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, *model, ["doc_id"]).collect()}
    held = [(i, t) for i, _, t, _ in labels[:600] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((scored[i] >= 0.5) == bool(t) for i, t in held) / len(held) >= 0.95
    assert scored[1] == scored[2] and 0 <= scored[1] < 0.5
    assert toxicity.accepted(docs, marks).columns == docs.columns
    assert toxicity.accepted(empty(docs), marks).count() == 0 and toxicity.accepted(nasty, empty(marks)).count() == nasty.count()


def test_label_model_estimates_accuracies_and_dependence_from_votes():
    rng = np.random.default_rng(21)
    truth = rng.random(6000) < 0.3
    good = [np.where(truth, rng.random(6000) < 0.4, rng.random(6000) < 0.004) for _ in range(8)]
    poor = [np.where(truth, rng.random(6000) < 0.02, rng.random(6000) < 0.05) for _ in range(3)]
    copies = [good[0].copy() for _ in range(4)]
    votes = np.array([*good, *poor, *copies]).T.astype(np.float32)
    model = toxicity.LabelModel()
    posterior = model.fit(votes)
    real = np.array([truth[v > 0].mean() for v in votes.T])
    assert np.abs(model.accuracy[:8] - real[:8]).max() < 0.06
    assert model.accuracy[8:11].max() < 0.87 < model.accuracy[:8].min()  # agreement tells them apart
    assert np.allclose(model.weight[[0, 11, 12, 13, 14]], 0.2, atol=0.02) and np.allclose(model.weight[1:8], 1)
    # a vote that stands alone keeps much of the start: votes cannot show it wrong
    alone = votes[:, 8:11].any(1) & ~votes[:, :8].any(1)
    assert ((posterior >= 0.5) == truth)[~alone].mean() > 0.97 and posterior[alone].mean() < posterior[votes[:, :8].sum(1) > 1].min()


def base_pii(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, text) if ok(k, m[0]))


def test_pii_base_matches_the_stated_expressions(spark):
    rng = np.random.default_rng(3)
    bits = ["a@b.co", "x.y+z@q-r.s.t", "_", "@", ".", "..", " ", "-", "--", "1", "12", "300", "4111111111111111", "4111 1111-1111 1111", "4111  1111", "+", "+1", "(555)", "10.0.0.1", "1.2.3.4.5.6.7.8", "000255.1.2.3", "é", "😀", "\n", "word", "+49 30 123456", "99999999999999999999"]
    texts = ["".join(rng.choice(bits, rng.integers(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanned = pii.scan(df)
    rows = scanned.select("doc_id", pii._joined(pii.F.concat(*[pii._kinded(k) for k in pii.KINDS])).alias("s")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["s"] == base_pii(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_pii_bootstraps_from_contexts(spark, nasty):
    rows = [(i, f"so {w} please dial now +1 555 01{i:02d} 999 ok{i}") for i, w in enumerate(WORDS[:24])]
    rows += [(50, "please dial now 555-0199-77 thanks"), (51, "the build 555-0199-77 of today"), (52, "dial now word"), (53, "NOW: 555-0198-76 or")]
    found = pii.find_pii(docs_of(spark, rows))
    more = {r["doc_id"]: [(x["kind"], x["s"], x["e"]) for x in r["more"]] for r in found.collect() if r["more"]}
    assert more == {50: [("phone", 16, 27)], 53: [("phone", 5, 16)]}
    clean = pii.redact(docs_of(spark, rows))
    assert {r["doc_id"]: r["text"] for r in clean.collect()}[50] == "please dial now <PHONE> thanks"
    done = pii.redact(nasty)
    assert done.columns == nasty.columns and done.count() == nasty.count()
    assert {r["text"] for r in done.where("doc_id is null or doc_id = 12").collect()} == {"mail to <EMAIL> now", "<PHONE> call <CARD> or <IP> and 300.1.1.1"}
    assert pii.redact(empty(nasty)).count() == 0


def luhn_ok(digits):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


CARDS = [c for c in (f"4111111111{i:06d}" for i in range(1000)) if luhn_ok(c)]


def test_pii_finds_spaced_and_spelt_identifiers(spark):
    rows = [(i, f"so {w} please dial now +1 555 01{i:02d} 999 ok") for i, w in enumerate(WORDS[:24])]
    rows += [(i, f"so {w} write to x{w}@b.org ok") for i, w in enumerate(WORDS[:24], 100)]
    rows += [(200 + i, f"the card number {c} ok") for i, c in enumerate(CARDS[:24])]
    want = {
        300: ("please dial now 0171 5550199 thanks", "please dial now <PHONE> thanks"),
        301: ("please dial now (0171) 5550199 10.0.0.1", "please dial now <PHONE> <IP>"),
        302: ("please dial now 0171 5550199 1234567890", "please dial now <PHONE> 1234567890"),
        303: ("the card number 4111 1111 1111 1112.", "the card number <CARD>."),
        304: ("please write to john[at]example[dot]com today", "please write to <EMAIL> today"),
        305: ("the build 0171 5550199 or john[at]example", "the build 0171 5550199 or john[at]example"),
    }
    rows += [(i, t) for i, (t, _) in want.items()]
    done = {r["doc_id"]: r["text"] for r in pii.redact(docs_of(spark, rows)).collect()}
    assert {i: done[i] for i in want} == {i: t for i, (_, t) in want.items()}


def python_bootstrap(mentions, min_seeds, least, z):
    """Trusted (pattern, kind) of mentions (patterns, kind, instance, is_seed), by plain iteration."""
    edges = {}
    for patterns, kind, inst, seed in mentions:
        for p in patterns:
            edges.setdefault((p, kind), {}).setdefault(inst, False)
            edges[p, kind][inst] |= seed
    seeds = {(k, i) for (_, k), of in edges.items() for i, s in of.items() if s}
    score, trusted, rounds = dict.fromkeys(seeds, 1.0), {}, 0
    while True:
        rounds += 1
        new = {}
        for (p, k), of in edges.items():
            values = [score.get((k, i), 0.0) for i in of]
            n, m = len(of), sum((k, i) in score for i in of)
            mean = sum(values) / n
            low = (mean + z * z / 2 / n - z * (mean * (1 - mean) / n + z * z / 4 / n / n) ** 0.5) / (1 + z * z / n)
            if m >= min_seeds and low >= least:
                new[p, k] = low
        if len(new) == len(trusted):
            return trusted, rounds
        trusted = new
        for (p, k), t in new.items():
            for i in edges[p, k]:
                score[k, i] = max(score.get((k, i), 0.0), t)


def test_pii_patterns_equal_a_plain_iteration(spark):
    rng = np.random.default_rng(12)
    texts, mentions, planted, number = [], [], set(), 0
    lefts = ["call us", "ring me", "our hotline", "fax no", "page 9", "| x"]
    for i in range(900):
        kind = rng.integers(0, 6)
        left, right = lefts[kind], ["today", "soon", f"w{rng.integers(0, 9)}"][rng.integers(0, 3)]
        seed = rng.random() < (0.95, 0.9, 0.02, 0.0, 0.3, 0.5)[kind]
        number += 1
        if rng.random() < 0.5 and kind in (1, 2):  # instances that the first context shares with the next one
            digits = f"555{rng.integers(0, 60):05d}"
            seed = False
        else:
            digits = f"1555{number:05d}"
        token = f"+{digits[0]} {digits[1:]}" if seed else f"{digits[:3]}-{digits[3:]}"
        texts.append(f"a {left} {token} {right} b")
        l2, l1 = left.replace("9", "0").split()
        r1 = re.sub("[0-9]", "0", right)
        mentions.append(((f"l1:{l1}", f"l2:{l2} {l1}", f"r1:{r1}", f"lr:{l1} {r1}"), "phone", digits, seed))
    want, rounds = python_bootstrap(mentions, pii.MIN_SEEDS, pii.MIN_CONFIDENCE, pii.Z)
    scanned = pii.scan(docs_of(spark, list(enumerate(texts))))
    rows = scanned.select("row", pii.F.explode("mentions").alias("m")).select("row", "m.*")
    got = {(r["pattern"], r["kind"]): r["trust"] for r in pii.trusted_patterns(rows, pii.MIN_SEEDS, pii.MIN_CONFIDENCE, pii.Z).collect() if r["kind"] == "phone"}
    assert got == pytest.approx(want) and len(want) >= 2
    more = {r["doc_id"]: r["more"] for r in pii.find_pii(docs_of(spark, list(enumerate(texts)))).collect()}
    for i, (patterns, _, digits, seed) in enumerate(mentions):
        hit = not seed and any((p, "phone") in want for p in patterns)
        assert bool(more[i]) == hit, texts[i]


def test_pii_of_a_text_with_very_many_matches(spark):
    text = " ".join(f"a{i}@b.org {i} +1 555 {i:07d}" for i in range(3000))
    got = pii.scan(docs_of(spark, [(1, text)])).select(pii._joined(pii.F.concat(*[pii._kinded(k) for k in pii.KINDS])).alias("s")).first()["s"]
    assert got == base_pii(text)


def test_jaccard(spark, nasty):
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.components(nasty).collect())
    n = 396
    assert got == sorted([("1", 0, "1"), ("2", 0, "2"), ("3", 1, "3"), ("4", n, "4"), ("5", n, "4"), ("5", n, "4"), ("6", n, "4"), ("7", 1, "7"), ("8", 1, "8"), ("9", 1, "8"), ("None", 1, "None"), ("10", 0, "10"), ("11", 400, "4"), ("12", 8, "12")])
    kept = jaccard.one_of_each(nasty)
    assert kept.columns == nasty.columns
    assert jaccard.components(empty(nasty)).count() == 0 and jaccard.one_of_each(empty(nasty)).count() == 0


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.split(r"[\x20\x09-\x0d]+", (t or "").translate({i: i + 32 for i in range(65, 91)}).strip(" \t\n\r\x0b\x0c"))
        w = [x for x in w if x]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return sets, comp


@pytest.mark.parametrize("cap, block, frequent", [(48, 512, 64), (3, 4, 4)])
def test_jaccard_against_brute_force(spark, cap, block, frequent, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rng = np.random.default_rng(11)
    texts, base = [], [" ".join(rng.choice(WORDS, 60)) for _ in range(6)]
    for i in range(150):
        words = base[i % 6].split()
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(0, len(words))] = "edit"
        texts.append(" ".join(words[rng.integers(0, 6) :]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, comp = brute_components(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(df, cap=cap, block=block).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, comp))}


def test_components_of_random_graphs_chains_and_stars(spark):
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(40)]
    pairs = [*chain, *((1000, 1000 + i) for i in range(1, 60)), *(tuple(int(x) for x in rng.integers(2000, 2300, 2)) for _ in range(200)), (5000, 5000), (6001, 6000)]
    real = [(a, b) for a, b in pairs if a != b]  # a loop names no component
    least = {n: n for p in real for n in p}
    for _ in range(400):
        for a, b in real:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["node"]: r["comp"] for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == least
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_tree_against_all_pairs():
    rng = np.random.default_rng(5)
    for percent in (50, 80, 100):
        base = [np.unique(rng.integers(0, 3000, rng.integers(1, 700))) for _ in range(12)]
        sets = [np.unique(np.r_[b[rng.random(len(b)) < rng.choice([0.85, 0.95, 1.0])], b[:1]]).astype(np.uint64) for b in base for _ in range(15)]
        sets.sort(key=lambda s: s.astype(">u8").tobytes())
        tree = PrefixTree(sets)
        for own in sets[::7]:
            want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(own, s)) >= percent * len(np.union1d(own, s))]
            assert sorted(tree.similar(own, percent)) == want
    assert list(PrefixTree([]).similar(np.zeros(1, np.uint64), 80)) == []


def test_stages_tell_documents_apart_by_text(spark):
    texts = [" ".join(f"t{i}x{k}" for k in range(40)) for i in range(6)]
    near = texts[0].replace("t0x39", "edit")
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, ""), (None, ""), (1, near), (2, texts[2]), (2, texts[3]), (2, texts[3]), (3, texts[3]), (4, None), (4, ""), (None, texts[4]), (2, texts[5])]
    docs = docs_of(spark, rows)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect())
    assert got == sorted([("None", texts[1]), ("None", ""), ("None", ""), ("1", near), ("2", texts[2]), ("2", texts[3]), ("4", ""), ("None", texts[4]), ("2", texts[5])])
    items = spark.createDataFrame([(1, texts[1]), (2, texts[2])], "item_id long, text string")
    left = sorted((str(r["doc_id"]), r["text"] or "") for r in decontaminate.clean(docs, items).collect())
    assert left == sorted((str(i), t or "") for i, t in rows if t not in texts[1:3])


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "bot", None), (3, 0, "user", "a"), (3, 1, "bot", ""), (4, 0, "user", "a"), (4, 1, "bot", ""), (5, 0, None, "x"), (None, 0, "user", "n"), (6, 3, "user", "a"), (6, 3, "user", "a")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    got = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in chat.format_chats(df).collect()}
    assert got == {2: (2, "<|user|>\na\n<|bot|>\n\n"), 3: (2, "<|user|>\na\n<|bot|>\n\n"), 5: (1, "<||>\nx\n"), None: (1, "<|user|>\nn\n"), 6: (2, "<|user|>\na\n<|user|>\na\n")}
    long = spark.createDataFrame([(c, t, "u", str(t)) for c in (1, 2) for t in range(25 + c)], "conv_id long, turn long, role string, text string")
    parts = sorted((r["conv_id"], r["part"], r["first_turn"], r["n_turns"], r["rendered"].count("<|u|>")) for r in chat.format_chats(long, block=10).collect())
    assert parts == [(2, 1, 1, 27, 10), (2, 2, 11, 27, 10), (2, 3, 21, 27, 7)]
    assert chat.format_chats(empty(df)).count() == 0


def brute_removed(texts, length):
    seen, marks = {}, [set() for _ in texts]
    for i, t in enumerate(texts):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            seen.setdefault(b[k : k + length], []).append((i, k))
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                marks[i].update(range(k, k + length))
    return marks


@pytest.mark.parametrize("batch_size, max_group, block", [(8000, 50000, 1 << 19), (5, 3, 300)])
def test_suffix_dedup_against_brute_force(spark, batch_size, max_group, block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = np.random.default_rng(2)
    passage = "".join(rng.choice(list("abcdé "), 260))
    texts = [None, "", "short", "z" * 500, passage, passage, "é" * 200]
    texts += ["".join(rng.choice(list("abcd"), rng.integers(0, 300))) + passage[rng.integers(0, 100) : rng.integers(150, 260)] + "".join(rng.choice(list("abcd"), rng.integers(0, 300))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = suffix_dedup.removals(df, length=96, gram=16, batch_size=batch_size, max_group=max_group).collect()
    runs = {r["cls"]: [(x["s"], x["e"]) for x in r["runs"]] for r in found}
    for t, marks in zip(texts, brute_removed(texts, 96)):
        mine = runs[hashlib.md5((t or "").encode()).hexdigest()]
        assert {k for a, b in mine for k in range(a, b)} == marks
        assert all(a[1] < b[0] for a, b in zip(mine, mine[1:]))


def test_suffix_dedup_edges(spark, nasty):
    assert suffix_dedup.removals(nasty).count() == 11  # distinct texts; null is empty
    assert suffix_dedup.removals(empty(nasty)).count() == 0


def test_rest_works_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in ("__spark_entry__.py", "tessera"):
        subprocess.run(["cp", "-r", os.path.join(root, name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "tessera" / "llm")], check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 50
