"""Every registered query and the pipeline, whole, on the smallest tables, against SQL or plain Python."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.dataset as ds
import pytest
import regex
from test_edges import base_pii, brute_components

import corpus_pipeline
from tessera.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(name):
    return ds.dataset(f"{SF}/{name}.parquet").to_table().to_pylist()


def query(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


@pytest.fixture(scope="module")
def docs():
    return rows_of("documents")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(ORACLE_SQL[name])
    names = sorted(d[0] for d in cur.description)
    want = [dict(zip([d[0] for d in cur.description], r)) for r in cur.fetchall()]
    got = query(spark, name)
    assert sorted(got[0]) == names
    key = lambda r: [str(r[c]) for c in names]
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_op2(spark):
    table = rows_of("embeddings")
    x, ids = np.array([r["embedding"] for r in table], float), np.array([r["vec_id"] for r in table])
    got = defaultdict(list)
    for r in query(spark, "op2_ann"):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    recall = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        best = [i for i in np.lexsort((ids, -score)) if i != q][:20]
        mine = sorted(got[int(ids[q])])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [m[1:] for m in mine] == sorted((m[1:] for m in mine), key=lambda m: (-m[1], m[0]))
        at = {int(i): k for k, i in enumerate(ids)}
        assert np.allclose([m[2] for m in mine], [score[at[m[1]]] for m in mine], rtol=0, atol=1e-12)
        recall.append(len({int(ids[i]) for i in best} & {m[1] for m in mine}) / 20)
    assert len(got) == len(recall) and np.mean(recall) >= 0.9


def tokens_of(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}


def check_packed(pieces, texts, padding):
    ids, covered, ends = tokens_of(texts), Counter(), {}
    for p in pieces:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        covered.update((p["doc_id"], p["start"] + k) for k in range(p["length"]))
    assert set(covered.values()) == {1} and len(covered) == sum(map(len, ids.values()))
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends.get(p["sequence_id"], 0)
        ends[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(ends.values()) <= 2048
    assert sum(2048 - e for e in ends.values()) <= padding * 2048 * len(ends)


def test_op4(spark, docs):
    check_packed(query(spark, "op4_packing"), [(d["doc_id"], d["text"]) for d in docs], 0.03)


def brute_contaminated(docs, items):
    """(doc, item): best similarity of an item-sized window, where it is 0.8 or more."""
    words = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    bag = lambda w: Counter(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    known = [(i["item_id"], words(i["text"])) for i in items]
    holders = defaultdict(set)
    for n, (_, w) in enumerate(known):
        for s in bag(w):
            holders[s].add(n)
    found = {}
    for d in docs:
        w = words(d["text"])
        for n in {n for s in bag(w) for n in holders[s]}:
            item, size = bag(known[n][1]), len(known[n][1])
            if (len(w) < 5) != (size < 5):
                continue
            best = 0
            for s in range(len(w)):
                x = bag(w[s : s + size])
                if x and x.keys() & item.keys():
                    best = max(best, (x & item).total() / (x | item).total())
            if best >= 0.8:
                found[d["doc_id"], known[n][0]] = best
    return found


def test_op5(spark, docs):
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in query(spark, "op5_decontaminate")}
    assert got == pytest.approx(brute_contaminated(docs, rows_of("benchmark"))) and got


def test_op6(spark, docs):
    got = query(spark, "op6_toxicity")
    assert sorted(r["doc_id"] for r in got) == sorted(d["doc_id"] for d in docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    toxic = {r["doc_id"]: r["toxic"] for r in rows_of("labels")}
    told = [r for r in got if toxic.get(r["doc_id"]) is not None and r["held_out"]]
    assert sum(r["predicted"] for r in told if not toxic[r["doc_id"]]) <= 0.03 * len(told)


def test_op7(spark, docs):
    texts = {d["doc_id"]: d["text"] or "" for d in docs}
    some = 0
    for r in query(spark, "op7_pii"):
        base = base_pii(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        spans = base.split(",") if base else []
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s.startswith(k) for s in spans) for k in ("email", "ip", "card", "phone")]
        assert set(spans) <= set(r["spans"].split(","))
        some += len(spans)
    assert some


def test_op8(spark, docs):
    sets, comp = brute_components([d["text"] for d in docs])
    ids = [d["doc_id"] for d in docs]
    least = {}
    for i, c in zip(ids, comp):
        least[c] = min(i, least.get(c, i))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in query(spark, "op8_jaccard")}
    assert got == {i: (len(s), least[c]) for i, s, c in zip(ids, sets, comp)}


def test_op10(spark, docs):
    data = {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    places = defaultdict(list)
    for i, b in data.items():
        for k in range(len(b) - 399):
            places[hashlib.blake2b(b[k : k + 400], digest_size=16).digest()].append((i, k))
    marks = {i: np.zeros(len(b) + 1, np.int64) for i, b in data.items()}
    for at in places.values():
        if len(at) > 1:
            for i, k in at:
                marks[i][k] += 1
                marks[i][k + 400] -= 1
    seen = defaultdict(set)
    words = {i: b.split() for i, b in data.items()}
    for i, w in words.items():
        for k in range(len(w) - 50):
            seen[b" ".join(w[k : k + 51])].add(i)
    shared = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 50):
            if len(seen[b" ".join(w[k : k + 51])]) > 1:
                shared[i].update(range(k, k + 51))
    got = {r["doc_id"]: r for r in query(spark, "op10_suffix_dedup")}
    assert len(got) == len(data)
    for i, b in data.items():
        cut = np.cumsum(marks[i])[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~cut].tobytes()
        spans = int((np.diff(np.r_[0, cut.astype(int)]) == 1).sum())
        want = {"doc_id": i, "n_bytes": len(b), "n_removed": int(cut.sum()), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest(), "n_passage_words": len(shared[i])}
        assert got[i] == want


def redacted(text):
    """Runs of overlapping spans as the kind of the first one."""
    spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in base_pii(text).split(",") if s))
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_pipeline(spark, docs):
    by_id = {d["doc_id"]: d for d in docs}
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = table
        table = stage(spark, before, SF).cache()
        assert table.columns == before.columns, name
        kept[name] = {r["doc_id"]: r.asDict() for r in table.collect()}
    assert kept["toxicity"].keys() == {r["doc_id"] for r in query(spark, "op6_toxicity") if not r["predicted"]}
    left = sorted(kept["toxicity"])
    comp = brute_components([by_id[i]["text"] for i in left])[1]
    first = {}
    for i, c in zip(left, comp):
        first.setdefault(c, i)
    assert kept["near_duplicates"].keys() == set(first.values())
    hit = {d for d, _ in brute_contaminated([by_id[i] for i in kept["near_duplicates"]], rows_of("benchmark"))}
    assert kept["decontamination"].keys() == kept["near_duplicates"].keys() - hit and hit
    # no pattern vouches for anything on these tables
    assert {i: r["text"] for i, r in kept["personal_data"].items()} == {i: redacted(by_id[i]["text"]) for i in kept["decontamination"]}
    assert all(r["n_chars"] == len(r["text"]) for r in kept["personal_data"].values())
    pieces = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    check_packed(pieces, [(i, r["text"]) for i, r in kept["personal_data"].items()], 0.03)
    assert [r.asDict() for r in corpus_pipeline.STAGES[-1][1](spark, table.where("false"), SF).collect()] == []
