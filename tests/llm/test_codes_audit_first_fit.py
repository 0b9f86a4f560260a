"""Operators 11 to 13 against plain versions of what they promise, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackloom.llm import filteraudit, firstfit, queries, vectorcodes
from trackloom.llm.common import table

WBPE = public_tokenizers.path("word_bpe_49k.json")


def plain_codes(rows, entries=256, rounds=4):
    """(vec_id, label, vector) -> what operator 11 returns, with Python integers only."""
    kept = [(i, lab, [math.floor(1024 * float(x)) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][2]) // 4
    cut = [[v[p * w : (p + 1) * w] for p in range(4)] for _, _, v in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0], kept[k][2]))[:entries]
    books = [[list(cut[k][p]) for k in order] for p in range(4)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p])) for p, x in enumerate(parts)] for parts in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(4):
            members = defaultdict(list)
            for parts, own in zip(cut, found, strict=True):
                members[own[p][1]].append(parts[p])
            for e, own in members.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    errors = [sum(d for d, _ in own) for own in found]
    by_label = defaultdict(int)
    for (_, lab, _), e in zip(kept, errors, strict=True):
        by_label[lab] += e
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted((i, "".join(f"{e:02x}" for _, e in own), err, by_label[lab], sha) for (i, lab, _), own, err in zip(kept, found, errors, strict=True))


def rows_of(df):
    return sorted(tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect())


def test_codes_are_those_of_the_plain_rounds(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "embeddings").select("vec_id", "label", "embedding").collect()]
    assert rows_of(queries.op11_vector_codes(spark, sf)) == plain_codes(rows)


def test_codes_of_hot_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(400, 8))]
    rows = [(i, i % 3 if i % 5 else None, vectors[0] if i % 3 == 0 else vectors[i]) for i in range(390)]
    odd = [(900, 1, None), (901, 1, [1.0] * 7 + [None]), (902, 1, [1.0] * 7 + [float("nan")]), (903, 1, [1.0] * 7 + [float("-inf")])]
    schema = "vec_id long, label int, embedding array<double>, row string, entry string, part string"
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows + odd], schema).repartition(3)
    codes = vectorcodes.compress(df, entries=20, resident_rows=8)  # many salts
    assert rows_of(vectorcodes.digest(codes)) == plain_codes(rows, entries=20)
    assert vectorcodes.compress(df.where("false")).rows.count() == 0
    few = vectorcodes.digest(vectorcodes.compress(df.where("vec_id < 3")))
    assert {r["code"] for r in few.collect()} == {"00" * 4, "01" * 4, "02" * 4} and {r["error"] for r in few.collect()} == {0}
    twice = vectorcodes.digest(vectorcodes.compress(df.where("vec_id < 30").union(df.where("vec_id < 30")), entries=7))
    assert twice.count() == 60
    ragged = spark.createDataFrame([(1, 1, [0.5]), (None, None, [0.5, 0.25, 1e30, -1e30, 0.5]), (3, 1, [])], "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: r for r in vectorcodes.digest(vectorcodes.compress(ragged)).collect()}
    assert {i: r["code"] for i, r in got.items()} == {1: "00000000", 3: "01000000", None: "02020200"}
    assert all(r["error"] == 0 for r in got.values())


@pytest.mark.parametrize("size", [1.0, 40_000.0])  # sums below 2^53, and beyond
def test_nearest_is_exact(size):
    rng = np.random.default_rng(5)
    x, c = (np.floor(rng.uniform(-size, size, (n, 16)) * 800).astype(np.int64) for n in (300, 40))
    c[7] = c[3]
    x[0] = c[3]
    entry, far = vectorcodes.nearest(x, c)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)), e) for e, w in enumerate(c)) for v in x]
    assert list(zip(far.tolist(), entry.tolist(), strict=True)) == want and entry[0] == 3


def test_only_movers_are_shuffled(spark, sf):
    """The union of residents and newcomers keeps the owners' partitioning: summing up has no exchange of parts."""
    parts = spark.range(1000).selectExpr("cast(id % 4 as int) position", "cast(id % 7 as int) entry", "cast(id % 16 as int) salt", "array(cast(id as int)) part", "id % 2 = 0 moves")
    tables = vectorcodes._Tables(parts, 4)
    a, b = tables.write(parts, split="moves"), tables.write(parts.repartition(4, *vectorcodes.OWNER))
    plan = tables.read((b, a), [*vectorcodes.OWNER, "part"]).groupBy(*vectorcodes.OWNER).agg(F.sum(F.col("part")[0]))._jdf.queryExecution().executedPlan().toString()
    tables.drop()
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_positional_popcount(words):
    want = [sum(w >> b & 1 for w in words) for b in range(32)]
    assert filteraudit.positional_popcount(np.array(words, dtype=np.uint32)).tolist() == want


def test_filter_audit_by_walking_every_order(spark):
    texts = ["", None, "a b", "a b", "A# b", "w " * 300, "w " * 300, " ".join(f"v{i}" for i in range(250)), " ".join(f"v{i}" for i in range(250)), "ABC " * 210 + "$", "\x0b x\x1c"]
    rows = [(i if i != 3 else None, t, s, "x", "x") for i, t in enumerate(texts) for s in ([None, "s"][i % 2],)] + [(7, texts[7], "s", "x", "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, digest string, mask string").repartition(3)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (7, 1, None), (8, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    good, toxic = {1, 7}, {1, 8}
    fails = []
    for i, t, s, *_ in rows:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        caps = sum("A" <= x <= "Z" for x in t)
        dup = i is not None and any((u or "") == t and j is not None and j < i for j, u, *_ in rows)
        own = {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * caps > 2 * len(t), any(c in t for c in "#$%&*|"), dup), strict=True) if bad}
        fails.append((i, s or "", own))
    want, total = {}, defaultdict(int)
    for part in ("", "s"):
        for order in permutations("ABCDE"):
            alive = [(i, own) for i, p, own in fails if p == part]
            everyone = list(alive)
            for step, f in enumerate(order, 1):
                gone = [(i, own) for i, own in alive if f in own]
                alive = [(i, own) for i, own in alive if f not in own]
                failing = sum(f in own for _, own in everyone)
                total[part, f] += len(gone)
                want[part, "".join(order), step] = (len(alive), len(gone), failing - len(gone), sum(own == {f} for _, own in everyone), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
    got = filteraudit.audit(filteraudit.survivors(docs, labels)).collect()
    assert len(got) == len(want) == 1200
    for r in got:
        assert tuple(r)[3:9] == want[r["part"], r["filter_order"], r["step"]]
        assert r["shapley"] == total[r["part"], r["filter_order"][r["step"] - 1]]
    assert filteraudit.audit(filteraudit.survivors(docs.where("false"), labels)).count() == 0
    assert filteraudit.audit(filteraudit.survivors(docs, labels.where("false"))).count() == 1200


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 63), min_size=1, max_size=80))
def test_first_fit_decreasing(sizes):
    bins = firstfit.first_fit_decreasing(sizes, 64)
    plain = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = next((b for b in plain if sum(sizes[k] for k in b) + sizes[i] <= 64), None)
        if at is None:
            plain.append(at := [])
        at.append(i)
    assert bins == plain
    closed = firstfit.without_gaps(bins, sizes, 64)
    fills = [sum(n for _, _, n in b) for b in closed]
    assert all(f == 64 for f in fills[: sum(sizes) // 64]) and all(f & (f - 1) == 0 for f in fills) and len(set(fills)) >= len(fills) - sum(sizes) // 64
    cover = defaultdict(list)
    for b in closed:
        for i, start, n in b:
            cover[i].append((start, n))
    assert all(sum(n for _, n in sorted(own)) == sizes[i] and [s for s, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] for i, own in cover.items()) and len(cover) == len(sizes)


def assert_packed(rows, texts):
    """Every id of every document once, places gapless, no padding, checksums right."""
    tokenizer = Tokenizer.from_file(WBPE)
    tokenizer.encode_special_tokens = True
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own.sort(key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist() and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)
    for own in by_sequence.values():
        own.sort()
        ends = np.cumsum([n for _, n in own])
        assert [o for o, _ in own] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048 and ends[-1] & (ends[-1] - 1) == 0


def test_first_fit_packing(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    rows = queries.op13_first_fit_packing(spark, sf).collect()
    assert_packed(rows, texts)
    again = queries.op13_first_fit_packing(spark, sf).collect()
    assert sorted(rows) == sorted(again)


def test_first_fit_packing_of_odd_rows(spark):
    long = " ".join(f"word{i % 997}" for i in range(9_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, long, "x"), (None, "a b", "x"), *[(10 + i, "same text here", "x") for i in range(50)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    assert_packed(firstfit.pack(docs, WBPE, group_size=7).collect(), {i: t for i, t, _ in rows})
    twice = docs.where("doc_id = 2").union(docs.where("doc_id = 2"))
    assert firstfit.pack(twice, WBPE).count() == 2
    assert firstfit.pack(docs.where("false"), WBPE).count() == 0
    gaps = firstfit.pack(docs, WBPE, group_size=7, fill=False).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r["n"] for r in gaps) <= 2048
