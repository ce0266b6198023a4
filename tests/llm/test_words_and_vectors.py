"""Operators 11 to 13 against plain versions, on made-up rows with nulls, ties, repeats, empty and very long texts."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tasklore.llm import codes, passages, resampling

EMPTY = hashlib.sha256(b"").hexdigest()


def cleaned(docs):
    """Distinct rows in order: null doc_ids first."""
    return sorted(set(docs), key=lambda r: (r[0] is not None, r[0] or 0))


def plain_passages(docs):
    seen, out = set(), {}
    for doc_id, text in cleaned(docs):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - passages.LEAST + 1):
            window = tuple(words[i : i + passages.LEAST])
            if window in seen:
                gone[i : i + passages.LEAST] = [True] * passages.LEAST
            seen.add(window)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[doc_id] = len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()
    return out


def passage_docs():
    rng = random.Random(3)
    base = [rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(150)]
    docs = [(None, "alone"), (1, None), (2, ""), (3, " \t\n")]
    for k in range(4, 24):
        words = []
        for _ in range(rng.randrange(1, 5)):
            i = rng.randrange(len(base))
            words += base[i : i + rng.randrange(3, 60)] + [f"ü{rng.randrange(9)}"] * rng.randrange(3)
        docs.append((k, rng.choice([" ", "\n ", "\x0b"]).join(words)))
    docs += [(30 + k, docs[10][1]) for k in range(5)] + [docs[10]]  # copies, and a row repeated
    docs.append((40, " ".join(["again"] * 3000)))  # ties everywhere
    docs.append((41, " ".join(base * 40) + " " + "x" * 5000))
    docs.append((42, "no break space " * 12))
    return docs


@pytest.mark.parametrize("group", [passages.GROUP, 3, 0])
def test_passages(spark, group):
    docs = passage_docs()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, first int, n_words string")
    got = passages.remove_passages(df, group).collect()
    assert len(got) == len(docs)
    want = plain_passages(docs)
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == {(d, *w) for d, w in want.items()}
    for r in got:
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_passages_of_no_rows(spark):
    assert passages.remove_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_doc_ids_of_other_texts(spark):
    words = " ".join(f"w{k}" for k in range(30))
    rows = [(1, words), (1, words + " end"), (None, words), (None, words)]
    got = sorted((r["n_words"], r["n_removed"]) for r in passages.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(30, 0), (30, 0), (30, 30), (31, 30)]  # null first; then both others repeat it


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    size = len(kept[0][1]) // parts
    x = [[math.floor(4096 * v) for v in r[1]] for r in kept]
    books = [[v[p * size : (p + 1) * size] for v in x[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [v[p * size : (p + 1) * size] for v in x]
            at = [near(v, books[p])[1] for v in own]
            for k in range(len(books[p])):
                mine = [v for v, a in zip(own, at, strict=True) if a == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for r, v in zip(kept, x, strict=True):
        found = [near(v[p * size : (p + 1) * size], books[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), r[2]))
    by = {}
    for *_, error, label in out:
        by[label] = by.get(label, 0) + error
    return sorted(((i, c, e, by[label], digest) for i, c, e, label in out), key=str)


def test_codes(spark):
    rng = random.Random(5)
    vector = lambda: [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(16)]
    rows = [(k, vector(), rng.choice([None, 1, 2])) for k in range(60)]
    rows += [(60, None, 1), (61, [float("nan")] * 16, 1), (62, [0.5] * 15 + [None], 1), (63, [math.inf] + [0.0] * 15, 2), (None, [0.1] * 16, 3), rows[5], rows[5]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int")
    got = sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in codes.product_codes(df).collect()), key=str)
    assert got == plain_codes(rows)


def test_codes_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert codes.product_codes(spark.createDataFrame([], kind)).collect() == []
    assert codes.product_codes(spark.createDataFrame([(1, None, 1)], kind)).collect() == []
    few = codes.product_codes(spark.createDataFrame([(2, [1.0] * 8, 1), (1, [0.0] * 8, None), (3, [1.0] * 16, 1)], kind)).collect()
    assert {(r["vec_id"], r["code"], r["error"]) for r in few} == {(1, "00" * 8, 0), (2, "01" * 8, 0), (3, None, None)}
    with pytest.raises(ValueError):
        codes.product_codes(spark.createDataFrame([(1, [1.0] * 9, 1)], kind))


@pytest.mark.parametrize("most", [2, 3000, codes.MOST])
def test_nearest_is_exact(most):
    for seed in range(40):
        rng = np.random.default_rng(seed)
        x = rng.integers(-most, most + 1, (200, 8))
        book = x[rng.integers(0, 200, 16)] + rng.integers(-1, 2, (16, 8)) * (seed % 3)
        at, distance = codes.nearest(x, book)
        exact = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (at == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def plain_resample(docs, target):
    def runs(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]

    s, t = [0] * 10_000, [0] * 10_000
    for table, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in runs(text)[1]:
                table[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10_000) / ((s[b] + 1) * (sum(t) + 10_000)))) for b in range(10_000)]
    rows = []
    for doc_id, text in docs:
        n, buckets = runs(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets)
        rows.append([doc_id, n, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    open_ = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for r in rows:
        r.append(None)
    for k, r in enumerate(open_[: 5 * len(open_) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=str)


def test_resampling(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["Alpha", "beta", "x9", "ÄÖ", "γ", "w" * 90, "it", "the"])
    text = lambda n: "".join(word() + rng.choice([" ", ", ", " ", " - "]) for _ in range(n))
    docs = [(k, text(rng.choice([0, 5, 19, 20, 40]))) for k in range(120)] + [(200, None), (201, ""), (202, "-.-"), (None, text(30)), (203, "." * 40_000)]
    docs += [(210, text(9000)), (211, "z" * 50_000 + " " + text(3000)), (212, "A" * 70_000)]
    docs += [docs[3], docs[3], docs[-3], docs[-3]]  # rows repeated, short and long
    target = [text(50), None, "", "alpha beta it the"]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, chunk int, weight string")
    got = resampling.importance_resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=str) == plain_resample(docs, target)


def test_resampling_of_no_rows(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c " * 20)], "doc_id long, text string")
    assert resampling.importance_resample(none, none).collect() == []
    assert [(r["n_words"], r["n_features"], r["rank"]) for r in resampling.importance_resample(some, none).collect()] == [(60, 177, None)]


def test_shifted_crcs():
    rng = np.random.default_rng(1)
    data = [rng.bytes(n) for n in (0, 1, 5, 64, 65, 66, 300, 70_000)]
    head = np.array([zlib.crc32(b"head")] * len(data), np.uint32)
    joined = resampling.shifted(head, np.array([len(d) for d in data])) ^ np.array([zlib.crc32(d) for d in data], np.uint32)
    assert joined.tolist() == [zlib.crc32(b"head" + d) for d in data]
