"""Operators against plain versions of what they promise, on the smallest tables."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.oracle import assert_equal, duck
from trackloom.llm import automata, chat, components, decontaminate, packing, quality, queries, repair, secrets, simhash, tokens, toxicity, urls, warc, wordhash
from trackloom.llm.common import table

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert_equal(queries.QUERIES[name](spark, sf).toPandas(), duck(sf).execute(queries.ORACLES[name]).df())


def test_the_loss_mask_is_what_is_read(spark):
    odd = "x</turn>\n<turn 0 user>\\ <\\/turn> \\l <\\turn é日"
    rows = [(1, 0, "user", "hi é"), (1, 1, "assistant", odd), (1, 2, "assistant", "</turn>"), (1, 3, "assistant", ""), (2, 0, "assistant", "日本 plain")]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for r in chats:  # by slices in Python
        said = [t for c, _, role, t in rows if c == r["conv_id"] and role == "assistant"]
        bodies = [(r["formatted"][m["start"] : m["end"]], r["formatted"][: m["start"]].rsplit("<turn ", 1)[1][0]) for m in r["loss_mask"] if m["trained"]]
        plain = lambda b, level: b if level == "0" else b.replace("<\\/turn>", "</turn>").replace("<\\turn ", "<turn ") if level == "1" else b.replace("\\l", "<").replace("\\b", "\\")
        assert [plain(*b) for b in bodies] == said
    schema = "conv_id long, n_turns long, formatted string, loss_mask array<struct<start:long,end:long,trained:boolean>>"

    def loss(change):
        moved = [(r["conv_id"], r["n_turns"], r["formatted"], change([m.asDict() for m in r["loss_mask"]])) for r in chats]
        return {r["conv_id"]: (r["loss_chars"], r["loss_sha256"]) for r in chat.digest(spark.createDataFrame(moved, schema)).collect()}

    right = loss(lambda mask: mask)
    assert right[1] == (len(odd) + 7, hashlib.sha256((odd + "</turn>").encode()).hexdigest())
    wrong = loss(lambda mask: [m | {"start": m["start"] + (m["end"] > m["start"])} for m in mask])
    assert all(wrong[c] != right[c] for c in right)
    assert loss(lambda mask: [m | {"trained": not m["trained"]} for m in mask])[2] == (0, hashlib.sha256(b"").hexdigest())
    for bad in (lambda mask: mask[1:], lambda mask: [*mask, mask[-1]], lambda mask: [m | {"end": m["end"] + 40} for m in mask], lambda mask: [m | {"start": m["start"] - 30} for m in mask]):
        with pytest.raises(Exception, match="leaves its turn"):
            loss(bad)


def test_quality_base_counts(spark, sf, texts):
    for r in queries.op1_quality_rules(spark, sf).collect():
        t = texts[r["doc_id"]]
        words = SPACE.findall(t)
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        twice = {g for g, n in Counter(grams).items() if n > 1}
        covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(8)}
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (r["base_failed"] and r["kept"])


def test_quality_scores_equal_plain_counting(spark, sf, texts):
    """Every n-gram hashed alone, counted in dictionaries, and averaged by document."""
    n, full = quality.BUCKETS, (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & full
        return x ^ (x >> 31)

    def hashed(values):
        return mixed((sum(v * pow(wordhash._MULT, i, 1 << 64) for i, v in enumerate(values)) + len(values) * 0xD6E8FEB86659FD93) & full)

    byte = [int(x) for x in wordhash._BYTE]
    word = functools.cache(lambda w: hashed([byte[b] for b in w.encode()]))
    grams = {}
    for i, t in texts.items():
        own = [word(w) for w in SPACE.findall(t)]
        grams[i] = [mixed(h ^ 0x5851F42D4C957F2D) % n for h in own] + [hashed(pair) % n for pair in zip(own, own[1:], strict=False)]
    good = {r["doc_id"] for r in table(spark, sf, "labels").where("quality = 1").collect()}
    raw, target = Counter(g for own in grams.values() for g in own), Counter(g for i, own in grams.items() if i in good for g in own)
    n_raw, n_target = sum(raw.values()), sum(target.values())
    ratio = {g: math.log((target[g] + 1) / (n_target + n)) - math.log((raw[g] + 1) / (n_raw + n)) for g in raw}
    want = {i: sum(ratio[g] for g in own) / max(len(own), 1) for i, own in grams.items()}
    got = {r["doc_id"]: r["llr"] for r in queries.op1_quality_rules(spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-8 for i in want) and n_target > 1_000


def test_quality_keeps_good_and_drops_bad(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op1_quality_rules(spark, sf).where("not base_failed").join(table(spark, sf, "labels"), "doc_id")
    share = {r["quality"]: r["kept"] for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.98 and share[0] < 0.2


def test_quality_target_is_all_good_documents(spark):
    n_good, n_raw = 24_000, 30_000
    docs = spark.range(n_raw).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n_good, "aa bb").otherwise("cc dd").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") < n_good).cast("int").alias("quality"))
    used = quality.buckets(quality.words(["aa bb", "cc dd"]))[0]
    assert len(set(used.tolist())) == 6
    got = {r["llr"] for r in quality.quality_rules(docs, labels).where(F.col("doc_id") < n_good).select("llr").distinct().collect()}
    assert got == {round(float(np.log((3 * n_raw + quality.BUCKETS) / (3 * n_good + quality.BUCKETS))), 9)}


def test_quality_threshold_is_that_of_all_good_documents(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", name) for name in ("documents", "labels"))
    rows = quality.quality_rules(docs, labels).where("not base_failed").collect()
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    threshold = np.quantile([r["llr"] for r in rows if r["doc_id"] in good], 0.005) - 0.02
    assert all(r["kept"] == (r["llr"] >= threshold) for r in rows if abs(r["llr"] - threshold) > 1e-4)


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op3_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out")
    row = rows.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"), (F.sum(F.col("predicted") * F.col("toxic")) / F.sum("toxic")).alias("recall")).first()
    assert row["right"] > 0.97 and row["recall"] > 0.85
    assert rows.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).count() == 0


def test_decontamination(spark, sf, texts):
    def words(t):
        return [x for x in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower()) if x]

    def shingles(w):
        k = min(5, len(w))
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    want = {}
    items = [(r["item_id"], words(r["text"])) for r in table(spark, sf, "benchmark").collect()]
    for i, t in texts.items():
        w = words(t)
        own = set(shingles(w)) if len(w) >= 5 else set()
        for item, v in items:
            c = shingles(v)
            if own & set(c):
                sims = [sum((s & c).values()) / sum((s | c).values()) for s in (shingles(w[a : a + len(v)]) for a in range(len(w) - len(v) + 1))]
                if max(sims, default=0) >= 0.8:
                    want[i, item] = round(max(sims), 9)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in queries.op4_decontamination(spark, sf).collect()}
    assert got == want and got


def test_documents_shorter_than_an_item_are_compared():
    item = [f"w{i}" for i in range(50)]
    bench = decontaminate.Benchmark([(1, " ".join(item)), (2, "a b c d e f g h i j"), (3, "p q r s")])
    for a in range(12):
        for b in range(39, 51):
            size = max(0, b - a - 4)
            want = [(1, round(size / 46, 9), 0, b - a)] if size / 46 >= 0.8 else []
            assert decontaminate.matches(" ".join(item[a:b]), bench, 0.8) == want
    assert decontaminate.matches("a b c d e f g h i", bench, 0.8) == [(2, round(5 / 6, 9), 0, 9)]
    assert decontaminate.matches("a b c d e f g h", bench, 0.8) == decontaminate.matches("p q r", bench, 0.8) == []


def test_short_documents_against_brute_force(spark):
    """Cut items against all items, with windows clipped to the document."""
    items = [(r["item_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.01", "benchmark").collect()]
    own = lambda t: [x for x in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower()) if x]
    count = lambda v, k: Counter(tuple(v[j : j + k]) for j in range(len(v) - k + 1))
    rng, texts = random.Random(9), {}
    for i, (_, text) in enumerate(items):
        v = own(text)
        a = rng.randrange(len(v) // 5 + 1)
        texts[i] = " ".join(v[a : len(v) - rng.randrange(len(v) // 5 + 1)])
    want = {}
    for d, text in texts.items():
        w = own(text)
        for item, t in items:
            v = own(t)
            k = min(5, len(v))
            c = count(v, k)
            size = min(len(v), len(w))
            sims = [sum((s & c).values()) / max(1, sum((s | c).values())) for s in (count(w[a : a + size], k) for a in range(len(w) - size + 1))]
            if max(sims, default=0) >= 0.8:
                want[d, item] = round(max(sims), 9)
    bench = decontaminate.Benchmark(items)
    assert {(d, m[0]): m[1] for d, text in texts.items() for m in decontaminate.matches(text, bench, 0.8)} == want
    assert len(want) > len(items) / 3


def test_edited_passages_are_found(spark):
    items = [(r["item_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.01", "benchmark").collect()]
    bench, rng = decontaminate.Benchmark(items), random.Random(5)
    for item, text in items:
        words = text.split()
        if len(words) < 25:
            continue
        words[rng.choice((0, 1, -1, -2))] = "changed"
        hits = {m[0]: m[1] for m in decontaminate.matches(" ".join(["before"] * 30 + words + ["after"] * 30), bench, 0.8)}
        assert item in hits


def test_hamming_index_finds_all():
    rng = np.random.default_rng(1)
    own = rng.integers(0, 2**63, 300, dtype=np.uint64)
    asked = own[rng.integers(0, 300, 500)].copy()
    for _ in range(25):
        asked ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    query, item = decontaminate.HammingIndex(own).within(asked)
    want = {(q, i) for q in range(500) for i in range(300) if int(asked[q] ^ own[i]).bit_count() <= decontaminate.RADIUS}
    assert set(zip(query.tolist(), item.tolist(), strict=True)) == want


def test_hamming_index_selects_by_blocks_and_group():
    """Of the items of a size it looks at some 4 %, and finds all that are near."""
    rng = np.random.default_rng(2)
    own, kind = rng.integers(0, 2**63, 20_000, dtype=np.uint64), rng.integers(0, 4, 20_000)
    index = decontaminate.HammingIndex(own, kind)
    asked = rng.integers(0, 2**63, 300, dtype=np.uint64)
    asked[:100] = own[:100] ^ np.uint64(0x1041041041)  # 12 bits away
    seen = 0
    for values, starts in zip(index._split(asked), index.starts, strict=True):
        slot = index._slot(values[:, None] ^ index.near, np.repeat(kind[:1], 300)[:, None])
        seen += int((starts[slot + 1] - starts[slot]).sum())
    assert seen < 0.06 * 300 * np.count_nonzero(kind == kind[0])
    query, item = index.within(asked, kind[:300])
    want = {(q, i) for q in range(300) for i in np.flatnonzero((np.bitwise_count(own ^ asked[q]) <= decontaminate.RADIUS) & (kind == kind[q])).tolist()}
    assert set(zip(query.tolist(), item.tolist(), strict=True)) == want and {(i, i) for i in range(100)} <= want
    empty = decontaminate.HammingIndex(own[:0])
    assert len(empty.within(asked)[0]) == len(index.within(asked[:0])[0]) == 0


def test_recall_on_edited_items(spark):
    """Of windows that an exact comparison takes for similar, the radius may lose one in a hundred."""
    rng, found, wanted = random.Random(21), 0, 0
    items = [(r["item_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.1", "benchmark").collect()]
    bench = decontaminate.Benchmark(items)
    own = lambda t: [x for x in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower()) if x]
    count = lambda v: Counter(tuple(v[j : j + 5]) for j in range(len(v) - 4))
    for _ in range(6):
        for item, text in items:
            v = own(text)
            edited = list(v)
            for _ in range(rng.randrange(1, 4)):
                edited[rng.choice((0, -1, rng.randrange(len(v))))] = f"zz{rng.randrange(1000)}"
            a, b = count(v), count(edited)
            if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                wanted += 1
                found += item in {m[0] for m in decontaminate.matches(" ".join(["before"] * 30 + edited + ["after"] * 30), bench, 0.8)}
    assert wanted > 200 and found >= 0.99 * wanted


def test_a_repeated_item_is_held_once_and_matches_each_time(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text), (2, "none of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, text)] * 30 + [(None, text)] * 2, "item_id long, text string").repartition(4)
    paths = decontaminate.benchmark_blocks(bench)
    assert len(paths) == 1 and spark.read.parquet(paths[0]).count() == 2
    got = Counter(r["item_id"] for r in decontaminate.contaminations(docs, bench).collect())
    assert got == {7: 30, None: 2}
    assert [r["doc_id"] for r in decontaminate.without_contamination(docs, bench, block_bytes=20).collect()] == [2]


def test_secret_spans(spark, sf, texts):
    for r in queries.op6_secret_scans(spark, sf).collect():
        t, out = texts[r["doc_id"]], []
        key = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        out += [(m.start(), 0, m.end()) for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 8]
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))
        assert hashlib.sha256(joined.encode()).hexdigest() == r["base_sha256"]
        assert not out or set(joined.split(",")) <= set(r["spans"].split(","))


def test_automata_find_unmarked_credentials():
    rng = random.Random(2)
    draw = lambda n, alphabet: "".join(rng.choice(alphabet) for _ in range(n))
    ordinary = ["".join(rng.choice(["tion", "the", "her", "ing", "and", "lich", "eur"]) for _ in range(6)) for _ in range(800)]
    known = {"hex": [draw(40, "0123456789abcdef") for _ in range(200)], "access": ["AKIA" + draw(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(200)], "ordinary": ordinary}
    formats = secrets.Formats(known)
    found = sum(formats.ratio(draw(28, "0123456789abcdef")) > formats.threshold for _ in range(100))
    wrong = sum(formats.ratio(w) > formats.threshold for w in ("theherthingtionand" * 2, "lichtionherandthe", "THETIONHERINGANDLICH"))
    assert found > 95 and wrong == 0
    text = f"see {draw(30, '0123456789abcdef')} there"
    assert [s[1] for s in secrets.all_spans(text, True, formats)] == [3]
    one = automata.Automaton(["ab1", "ab2", "ab3"])
    assert one.log_likelihood("ab4") > one.log_likelihood("+++")


def planted_credentials(n_labelled, n_plain, seed):
    """Documents, the unlabelled credentials in them, and the ordinary long tokens."""
    rng = random.Random(seed)
    draw = lambda n, alphabet: "".join(rng.choice(alphabet) for _ in range(n))
    lower, upper, digit, hexes = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    kinds = [
        lambda: "ghp_" + draw(36, lower + upper + digit),
        lambda: "sk-" + draw(48, lower + upper + digit),
        lambda: "-".join(draw(n, hexes) for n in (8, 4, 4, 4, 12)),
        lambda: "xoxb-" + draw(12, digit) + "-" + draw(24, lower + upper + digit),
    ]
    word = lambda: "".join(rng.choice(["tion", "the", "her", "ing", "and", "lich", "eur", "ment", "ver"]) for _ in range(rng.randrange(5, 9)))
    plain = [
        word,
        lambda: f"/usr/{word()}/{word()}.txt",
        lambda: word().title() + word().title(),
        lambda: f"{rng.randrange(2000, 2030)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}T{rng.randrange(10, 24)}.{rng.randrange(10, 60)}",
        lambda: f"{rng.randrange(10)}.{draw(15, digit)}",
        lambda: word() + "_" + word() + str(rng.randrange(100)),
    ]
    filler = lambda: " ".join(rng.choice(["we", "saw", "it", "there", "on", "a", "day"]) for _ in range(12))
    texts, secret, ordinary = [], [], []
    for i in range(n_labelled):
        texts.append(f"{filler()} {rng.choice(['token = ', 'api_key: ', 'password=', 'secret: '])}{kinds[i % 4]()} {filler()}")
    for i in range(n_plain):
        own = [kinds[i // 10 % 4]()] if i % 10 == 0 else []
        usual = [rng.choice(plain)() for _ in range(4)]
        texts.append(" ".join([filler(), *usual[:2], *own, *usual[2:], filler()]))
        secret += own
        ordinary += [u for u in usual if len(u) >= 16]
    return texts, secret, ordinary


def labelled_values(texts):
    out = {kind: set() for kind in secrets.KINDS[:3]}
    for t in texts:
        for kind, value in secrets._values(t, secrets.base_spans(t, True)):
            out[kind].add(value)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("share", [0, 0.024, 0.05, 0.08, 0.12, 0.2, 0.3])
def test_recall_holds_at_any_share_of_unlabelled_credentials(share):
    """Four formats, and one of letters and digits: of the long tokens that nobody labelled a share are credentials."""
    rng = random.Random(7)
    texts = planted_credentials(500, 0, 1)[0]
    _, hidden, usual = planted_credentials(0, 13_000, 11)
    one = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24))
    for known, secret in ((labelled_values(texts), lambda: hidden.pop()), ({"assign": [one() for _ in range(500)]}, one)):
        n = 3_000
        tokens = [secret() for _ in range(int(n * share))] + usual[: n - int(n * share)]
        rng.shuffle(tokens)
        formats = secrets.Formats(known | {"ordinary": tokens})
        assert sum(formats.ratio(secret()) > formats.threshold for _ in range(300)) >= 270
        assert sum(formats.ratio(x) > formats.threshold for x in usual[n : n + 4_000]) <= 8


def test_words_as_passwords_do_not_make_words_credentials():
    usual = planted_credentials(0, 2_500, 3)[2]
    words = [x for x in usual if re.fullmatch("[a-z]+", x)]
    formats = secrets.Formats({"assign": words[:300], "ordinary": usual[:3_000]})
    assert sum(formats.ratio(x) > formats.threshold for x in usual[3_000:7_000]) <= 8


def test_unlabelled_credentials_are_found(spark):
    """Recall of 0.9 at least for four formats, and at most one in 500 ordinary tokens taken for a credential; every
    verdict equals the plain definition of the score."""
    texts, secret, ordinary = planted_credentials(600, 1_500, 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    formats = secrets.train(docs)
    rows = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs, formats).collect()}
    found = {texts[i][s["start"] : s["end"]] for i, spans in rows.items() for s in spans if s["kind"] == "format"}
    assert sum(x in found for x in secret) >= 0.9 * len(secret)
    assert sum(x in found for x in ordinary) <= len(ordinary) / 500
    fresh, hidden, usual = planted_credentials(0, 1_000, 5)  # and in texts that nothing was learned from
    got = [formats.ratio(x) > formats.threshold for x in hidden]
    assert sum(got) >= 0.9 * len(hidden) and sum(formats.ratio(x) > formats.threshold for x in usual) <= len(usual) / 500

    def chance(a, text):  # step by step through the states
        at, total = 0, 0.0
        for c in text:
            step = next(i for i, group in enumerate(automata.CLASSES) if c in group)
            total += a.log_step[at][step] if at >= 0 else a.lost
            at = a.next[at][step] if at >= 0 else -1
        return total + (a.log_end[at] if at >= 0 else a.lost)

    for i, spans in rows.items():
        want = []
        base = [(m.start(), m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]{8,}|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}""", texts[i])]
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]{16,}", texts[i]):
            if all(b <= m.start() or m.end() <= a for a, b in base):
                ratio = (max(chance(a, m[0]) for a in formats.kinds) - chance(formats.ordinary, m[0])) / (len(m[0]) + 1)
                if ratio > formats.threshold:
                    want.append((m.start(), m.end(), round(ratio, 9)))
        assert [(s["start"], s["end"], s["score"]) for s in spans if s["kind"] == "format"] == want


def test_automata_know_lengths():
    rng = random.Random(3)
    own = automata.Automaton("".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(300))
    by_char = lambda n: own.log_likelihood("".join(rng.choice("0123456789abcdef") for _ in range(n))) / (n + 1)
    assert own.states >= 41 and by_char(40) > by_char(24) + 0.1 and by_char(40) > by_char(80) + 0.5 and by_char(400) < by_char(80)


def test_samples_are_those_of_smallest_hashes_and_whole(spark):
    long = "a1" * 400  # longer values are learned from as well
    texts = [f"token={x}" for x in [long, *(f"value{i:05d}" for i in range(50))]] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    order = sorted({t[6:] for t in texts}, key=lambda v: (xxhash.xxh64_intdigest(v, 42), v))
    assert secrets.samples(docs, 1_000, 10, 16, 10_000)["assign"] == order
    assert secrets.samples(docs, 7, 10, 16, 10_000)["assign"] == order[:7]
    assert long not in secrets.samples(docs, 1_000, 10, 16, 700)["assign"]
    few = secrets.samples(docs, 1_000, 10, 16, 95)["assign"]
    assert few == [v for v in order if v != long][:10]


@pytest.mark.parametrize("batch_chars", [400, 100_000])
def test_automata_count_all_values(spark, batch_chars):
    """All distinct values and tokens, however few an automaton is grown by at a time: counts are those of plain walks, and nothing is lost."""
    rng = random.Random(12)
    hexes = {"".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([12, 18]))) for _ in range(1_200)}
    words = {"-".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(5, 8))) for _ in range(3)) for _ in range(1_500)}
    texts = [f"token={x}" for x in hexes] * 2 + sorted(words)
    formats = secrets.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), batch_chars=batch_chars)
    shouted = [y for x in words for y in (x, x.upper())]
    for own, values in ((formats.kinds[0], hexes), (formats.ordinary, shouted)):
        want = Counter()
        for x in values:
            path = own.walk([automata.SYMBOL[c] for c in x])
            want.update(path)
            want[path[-1], "end"] += 1
        assert own.seen[0] == len(values)
        assert own.seen == [want[i] for i in range(own.states)] and own.ends == [want[i, "end"] for i in range(own.states)]
    assert secrets.train(spark.createDataFrame([(1, "no values")], "doc_id long, text string")).kinds == []


def test_spans_are_swept_in_one_go():
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice("ab/=. \n") if rng.random() < 0.9 else " " for _ in range(rng.randrange(120)))
        base = sorted((a, rng.randrange(3), min(len(text), a + rng.randrange(1, 30))) for a in (rng.randrange(len(text) + 1) for _ in range(rng.randrange(6))))
        want = [m.span() for m in secrets.CANDIDATE.finditer(text) if m.end() - m.start() >= 4 and not any(s < m.end() and m.start() < e for s, _, e in base)]
        assert [m.span() for m in secrets.candidates(text, base, 4)] == want


def test_redaction_without_or_with_other_counts(spark):
    docs = spark.createDataFrame([(1, "x password=abcdefgh12 y", 24), (2, None, None), (3, "plain", None)], "doc_id long, text string, n_chars int")
    formats = secrets.train(docs)
    rows = {r["doc_id"]: r for r in secrets.redact(docs, formats).collect()}
    assert (rows[1]["text"], rows[1]["n_chars"]) == ("x [assign] y", 12) and rows[3]["n_chars"] is None and rows[2]["text"] is None
    assert secrets.redact(docs.drop("n_chars"), formats).columns == ["doc_id", "text"]
    assert secrets.redact(docs.withColumn("n_chars", F.lit("x")), formats).where("doc_id = 1").first()["n_chars"] == "x"


def test_token_files(spark, sf, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, at = {r["doc_id"]: r for r in queries.op7_token_files(spark, sf).collect()}, 0
    for i in sorted(texts):
        ids = np.array([*t.encode(texts[i], add_special_tokens=False).ids, 1], dtype="<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_shard_random_access(spark, sf):
    shards = repair.write_shards(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, 49_408, shard_tokens=20_000).collect()
    assert len(shards) > 1
    shard = repair.Shard(shards[0]["path"])
    every = shard.all_ids()
    assert len(shard.rules) and shard.n_symbols < len(every)
    for i in range(0, len(shard.doc_ids), 5):
        own = shard.document(i)
        assert np.array_equal(own, every[shard.token_start[i] : shard.token_start[i + 1]])
        assert all(shard.token(i, k) == own[k] for k in range(0, len(own), 11)) and shard.token(i, len(own) - 1) == 1


def test_compression_round_trip():
    rng = np.random.default_rng(3)
    for n, k in ((0, 5), (1, 5), (2, 1), (3, 1), (5_000, 3), (50_000, 40), (9_999, 1)):
        ids = rng.integers(0, k, n).astype(np.uint32)
        for least in (2, 4):
            symbols, rules = repair.compress(ids, 100, least)
            assert np.array_equal(repair.expand(symbols, rules, 100, 100), ids)
            assert repair.expansion_lengths(rules, 100).tolist() == [len(repair.expand(np.array([101 + r]), rules, 100, 100)) for r in range(len(rules))]


def pairs_kept_apart(s, end):
    """Counts of the pairs of a row, of which equal ones do not overlap."""
    out, last = Counter(), {}
    for i, pair in enumerate(zip(s, s[1:], strict=False)):
        if end not in pair and last.get(pair) != i - 1:
            out[pair] += 1
            last[pair] = i
    return out


def plain_repair(ids, end, least):
    """One pair a time, the most frequent first, by the book."""
    s, rules = list(ids), 0
    while True:
        counts = pairs_kept_apart(s, end)
        pair = max(counts, key=lambda p: counts[p], default=None)
        if pair is None or counts[pair] < least:
            return s, rules
        out, i = [], 0
        while i < len(s):
            if tuple(s[i : i + 2]) == pair:
                out.append(end + 1 + rules)
                i += 2
            else:
                out.append(s[i])
                i += 1
        s, rules = out, rules + 1


@pytest.mark.parametrize("least", [2, 3, 4])
def test_compression_goes_on_until_no_pair_is_frequent(least):
    rng = random.Random(7)
    words = [[rng.randrange(30) for _ in range(rng.randrange(2, 9))] for _ in range(25)]
    shards = [
        [x for _ in range(400) for x in [*rng.choice(words), *([50] if rng.random() < 0.1 else [])]],
        [*range(40)] * 16,  # a long document many times: rules nest
        [3] * 500 + [4, 50] * 30,
        [rng.randrange(6) for _ in range(3_000)],
    ]
    for ids in shards:
        symbols, rules = repair.compress(np.array(ids, dtype=np.uint32), 50, least)
        left = pairs_kept_apart(symbols.tolist(), 50)
        assert max(left.values(), default=0) < least
        want, n = plain_repair(ids, 50, least)
        assert len(symbols) + 2 * len(rules) <= 1.15 * (len(want) + 2 * n) + 4
        for r in range(len(rules)):  # every rule is used as often as it takes to pay
            assert np.count_nonzero(symbols == 51 + r) + np.count_nonzero(rules == 51 + r) >= 1
    assert max(repair.expansion_lengths(repair.compress(np.array(shards[1], dtype=np.uint32), 50, least)[1], 50)) >= 40


def test_symbols_of_any_width(tmp_path):
    rng = np.random.default_rng(5)
    for width in (16, 17, 18, 21):
        s = rng.integers(0, 1 << width, 1_003).astype(np.uint32)
        data = repair.packed(s, width)
        read = lambda at, size, data=data: data[at : at + size]
        assert len(data) == 2 * len(s) + (width - 16) * 126
        for a, b in ((0, 1_003), (0, 0), (5, 6), (8, 16), (77, 1_003), (999, 1_003)):
            assert np.array_equal(repair.unpacked(read, len(s), width, a, b), s[a:b])


def test_rows_of_one_id_are_dealt_to_shards_of_many_tasks(spark):
    docs = spark.range(0, 600, 1, 6).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = repair.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), 1, 49_408, shard_tokens=60)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert shards.select("part").distinct().count() > 1
    rows = repair.read_shards(shards).collect()
    assert len(rows) == 600 and len({r["start"] for r in rows}) == 600 and len({r["ids_crc32"] for r in rows}) == 1


@pytest.mark.parametrize(("file", "cut"), [("word_bpe_49k.json", "space"), ("byte_bpe_50k.json", "lead")])
def test_ids_are_those_of_whole_texts(file, cut):
    rng = random.Random(11)
    atoms = ["a", "word", "The", "é", "ß", "1", "23", ".", ",", "'s", "'", '"', "(", "|", " ", " ", " ", "\n", "\t", "\xa0", "\r\n", "\u2009", "\u3000", "“", "—", "日本", "\u0301", "\0", "\x1d", "😀", "_", "²", "<|endoftext|>"]
    some = ["".join(rng.choice(atoms) for _ in range(rng.randrange(14))) for _ in range(6_000)]
    whole = Tokenizer.from_file(public_tokenizers.path(file))
    whole.encode_special_tokens = True
    own = tokens.Encoder(public_tokenizers.path(file), cut)
    for at in range(0, len(some), 500):
        ids, sizes = own.encode(some[at : at + 500])
        want = [e.ids for e in whole.encode_batch(some[at : at + 500], add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_packing(spark, sf, texts):
    t, by, used = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}, {}
    for r in queries.op8_best_fit_packing(spark, sf).collect():
        by.setdefault(r["doc_id"], []).append(r)
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = 0
    for i, text in texts.items():
        ids, at = np.array([*t.encode(text, add_special_tokens=False).ids, 0], dtype="<u4"), 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 2048)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
        total += at
    for own in used.values():
        own.sort()
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(own[-1]) <= 2048
    assert len(used) <= 1.03 * total / 2048 + 1


def test_sequences_are_the_documents_in_order(spark, sf):
    """Also with ids that repeat or are null, and with texts of several pieces."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("doc_id") % 7).alias("doc_id"), "text")
    docs = docs.union(docs).union(spark.createDataFrame([(3, "so long a text " * 3_000)], "doc_id long, text string"))
    pieces, places = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.sequences(pieces, places).collect()
    assert sum(len(r["lengths"]) for r in got) == pieces.count() and all(len(r["ids"]) == 4 * sum(r["lengths"]) <= 4 * 2048 for r in got)
    whole, cut_up = Counter(), 0
    for r in got:
        ids, at = np.frombuffer(r["ids"], dtype="<u4"), 0
        for doc_id, n in zip(r["doc_ids"], r["lengths"], strict=True):
            own, at = ids[at : at + n], at + n
            if own[-1] == 0 and n < 2048:
                whole[doc_id, zlib.crc32(own.tobytes())] += 1
            else:
                cut_up += 1
    want = Counter()
    for row in docs.collect():
        ids = np.array([*t.encode(row["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        if len(ids) < 2048:
            want[row["doc_id"], zlib.crc32(ids.tobytes())] += 1
    assert whole == want and cut_up > 0


def test_plans_place_everything_once():
    rng = random.Random(4)
    for room, n in ((64, 40), (128, 900), (2048, 1500), (2048, 1)):
        histogram = Counter(min(room, max(1, int(rng.lognormvariate(np.log(room / 4), 1)))) for _ in range(n))
        plan, used, seen = packing.make_plan(histogram, room), {}, Counter()
        for length, rank, count, first, each, offset in plan.runs:
            for j in range(count):
                seen[length, rank + j] += 1
                used.setdefault(first + j // each, []).append((offset + j % each * length, length))
        assert seen == {(length, r): 1 for length, c in histogram.items() for r in range(c)}
        assert set(used) == set(range(plan.sequences))
        for own in used.values():
            own.sort()
            assert [a for a, _ in own] == [0, *np.cumsum([x for _, x in own])[:-1].tolist()] and sum(own[-1]) <= room
        fit = []
        for length in sorted(histogram.elements(), reverse=True):
            k = next((k for k, free in enumerate(sorted(fit)) if free >= length), None)
            fit = sorted(fit)
            fit = [*fit[:k], fit[k] - length, *fit[k + 1 :]] if k is not None else [*fit, room - length]
        assert plan.sequences <= 1.03 * len(fit) + 1


def brute_components(texts):
    prints = {}
    for i, t in texts.items():
        words = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (f"{p:016x}", find(i)) for i, p in prints.items()}


def test_simhash(spark, sf, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash_dedup(spark, sf).collect()}
    assert got == brute_components(texts)


def test_ball_hashing_links_all_within_the_radius(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, d, replace=False)) for b in base for d in (1, 2, 3, 4, 5)]
    prints = sorted({int(b) for b in base} | set(near))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    links = simhash.meet(spark.createDataFrame([(s,) for s in signed], "fp long"), slices=4)
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    root = {s: s for s in signed}
    for _ in range(len(signed)):
        changed = False
        for a in signed:
            for b in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 4 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
        if not changed:
            break
    same = lambda m: {frozenset(x for x in signed if m.get(x, x) == m.get(y, y)) for y in signed}
    assert same(got) == same(root)


def test_parts_of_values_follow_from_fingerprint_and_mask():
    rng = np.random.default_rng(12)
    some, masks = rng.integers(0, 2**63, 500, dtype=np.uint64), simhash.ball(2)
    for slices in (1, 2, 8, 64):
        whole = simhash.part_of((some[:, None] ^ masks).ravel(), slices).reshape(len(some), -1)
        assert np.array_equal(whole, simhash.part_of(some, slices)[:, None] ^ simhash.part_of(masks, slices))
        assert slices == 1 or np.bincount(whole.ravel()).max() < 1.2 * whole.size / slices


def test_one_of_each_with_repeated_ids(spark):
    """Ids that repeat with unrelated texts lose nothing; ties are broken by text, whatever the partitions."""
    a, b, c = ("the first text of all " * 3, "another that says nothing of it " * 3, "some third one, long enough to stand alone " * 3)
    rows = [(5, a, 1), (5, b, 2), (6, c, 3), (6, c, 3), (7, a.upper(), 4), (None, b.title(), 5), (None, "x y z alone here", 6), (None, "X Y Z alone here", 7), (8, c, 9), (9, "q", 1), (9, "Q", 2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _id int")
    want = sorted(map(str, [(5, a, 1), (5, b, 2), (6, c, 3), (9, "Q", 2), (None, "X Y Z alone here", 7)]))
    for n in (1, 4, 7):
        kept = simhash.one_of_each(docs.repartition(n))
        assert kept.columns == docs.columns and sorted(str(tuple(r)) for r in kept.collect()) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(80)] + [(1000, k) for k in range(2000, 2040)] + [(7, 7)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).groupBy("root").count().collect()
    assert {r["root"]: r["count"] for r in got} == {0: 81, 1000: 41}


def test_urls(spark, sf):
    rows = {r["page_id"]: r for r in queries.op10_url_filters(spark, sf).collect()}
    for p in table(spark, sf, "pages").select("page_id", "url").collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", p["url"])
        host, path = m[1].lower(), m[2]
        fits = [(len(h + q), h + q, v) for h, q, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(q)]
        _, rule, verdict = max(fits, default=(0, None, None))
        r = rows[p["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or r["tree_verdict"])


def test_url_trees_learn(spark):
    """Held-out accuracy on labelled urls whose label follows their shape."""
    sites = [(f"http://{'x' * (i % 5)}site{i}.{'biz' if i % 2 else 'info'}/{'a/' * (i % 4)}p{i}?{'&'.join(f'k{k}=1' for k in range(6 * (i % 2)))}", i % 2) for i in range(400)]
    labelled = spark.createDataFrame([s for k, s in enumerate(sites) if k % 5], "url string, label int")
    asked = spark.createDataFrame([(k, s[0]) for k, s in enumerate(sites) if k % 5 == 0], "page_id long, url string")
    got = urls.filter_urls(asked, labelled=labelled).collect()
    assert sum((r["verdict"] == "block") == bool(sites[r["page_id"]][1]) for r in got) >= 0.95 * len(got)


def test_url_statistics_count_all_labelled_urls(spark, monkeypatch):
    labelled = spark.createDataFrame([(f"http://a{i}.site{i % 7}.{'biz' if i % 2 else 'info'}/p{i}", i % 2) for i in range(300)], "url string, label int")
    seen, own = [], urls.with_statistics
    monkeypatch.setattr(urls, "with_statistics", lambda rows, tables, **how: seen.append((rows, tables, how)) or own(rows, tables, **how))
    asked = spark.createDataFrame([(1, "http://x.site1.biz/"), (2, "http://never.seen/")], "page_id long, url string")
    assert urls.filter_urls(asked, labelled=labelled, train_urls=100).count() == 2
    (rows, tables, how), (train, _, out) = seen[1], seen[0]
    assert out == {"out_of_fold": True} and not how
    got = {r["page_id"]: r for r in own(rows, tables).collect()}
    assert (round(got[1]["suffix_rate"], 9), round(np.expm1(got[1]["suffix_log"]))) == (round(151 / 152, 9), 150)
    assert (got[2]["suffix_rate"], got[2]["suffix_log"], got[2]["domain_rate"], got[2]["domain_log"]) == (0.5, 0.0, 0.5, 0.0)
    every = urls.lexical(spark.createDataFrame([(u, *h) for u, h in ((r["url"], re.match(r".*?://([^/]*)(.*)", r["url"]).groups()) for r in labelled.collect())], "url string, host string, path string"))
    fold = {r["url"]: r["fold"] for r in every.select("url", F.pmod(F.xxhash64("url", F.lit(1)), F.lit(urls.FOLDS)).alias("fold")).collect()}
    label = {r["url"]: r["label"] for r in labelled.collect()}
    domain = {u: re.match(r".*?://[^/]*?([^./]*\.[^./]*)/", u)[1] for u in label}
    for r in own(train, tables, out_of_fold=True).collect():  # nothing of a url's own fold
        others = [label[u] for u in label if domain[u] == domain[r["url"]] and fold[u] != fold[r["url"]]]
        assert (round(r["domain_rate"], 9), round(np.expm1(r["domain_log"]))) == (round((sum(others) + 1) / (len(others) + 2), 9), len(others))


def test_labels_of_domains_seen_once_are_not_learned_by_heart(spark):
    """Labels that follow nothing: trees that see a single url's own label in its domain's rate would look right in training only."""
    rng = random.Random(1)
    labelled = spark.createDataFrame([(f"http://d{i}.com/p", rng.randrange(2)) for i in range(600)], "url string, label int")
    rows = urls.lexical(labelled.select("url", F.regexp_extract("url", "://([^/]*)", 1).alias("host"), F.lit("/p").alias("path"), F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64("url", F.lit(1)), F.lit(urls.FOLDS)).alias("fold")))
    rates = urls.with_statistics(rows, [("domain", urls.statistics(rows, "domain"))], out_of_fold=True)
    assert {r["domain_rate"] for r in rates.collect()} == {0.5}


def test_urls_of_held_out_hosts(spark):
    """The rules' own verdicts as labels, whole hosts held out (the tables' hosts share three domains)."""
    pages = table(spark, "/root/testdata/sf0.1", "pages")
    host, path = urls.host_and_path(F.col("url"))
    hit = urls.rule_of(host, path, urls.RULES)
    known = pages.select("page_id", "url", host.alias("host"), hit["verdict"].alias("verdict")).where("verdict is not null").withColumn("out", F.pmod(F.xxhash64("host"), F.lit(4)) == 0)
    labelled = known.where("not out").select("url", (F.col("verdict") == "block").cast("int").alias("label"))
    asked = known.where("out")
    got = urls.filter_urls(asked.select("page_id", "url"), labelled=labelled).join(asked.select("page_id", F.col("verdict").alias("want")), "page_id")
    row = got.agg(F.count("*").alias("n"), F.avg((F.col("tree_verdict") == F.col("want")).cast("int")).alias("right")).first()
    assert row["n"] > 100 and row["right"] > 0.85, row
    print(row)


def test_two_labels_of_one_url_mean_block(spark):
    labelled = spark.createDataFrame([("http://a.b/x", 0), ("http://a.b/x", 1), ("http://a.b/x", 0)], "url string, label int")
    asked = spark.createDataFrame([(1, "http://c.d/")], "page_id long, url string")
    assert urls.filter_urls(asked, labelled=labelled).first()["verdict"] == "block"


def test_broken_archives_are_named(spark, tmp_path):
    good = warc.record_bytes(1, "u", b"x", hashlib.sha256(b"x").hexdigest(), None)
    whole = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = whole.compress(good * 3) + whole.flush()
    path = tmp_path / "a.gz"
    path.write_bytes(data + data)  # two members in a row are one stream
    assert list(warc.records_of(str(path))) == [good] * 6
    for bad in (data[:-20], b"junk", zlib.compress(good)):
        path.write_bytes(bad)
        with pytest.raises(ValueError, match="a.gz"):
            list(warc.records_of(str(path)))


def test_records_without_an_id_have_ids_of_their_own():
    digest = "0" * 64
    ids = lambda page: warc.headers(warc.record_bytes(page, "u", b"x", digest, None).partition(b"\r\n\r\n")[0])["warc-record-id"]
    assert ids(None) != ids(None) and ids(4) == ids(4) != ids(5)
    revisit = warc.headers(warc.record_bytes(9, "u", b"x", digest, 4).partition(b"\r\n\r\n")[0])
    assert revisit["warc-refers-to"] == ids(4) != revisit["warc-record-id"]
    nameless = [warc.headers(warc.record_bytes(None, "u", b"x", digest, None, place).partition(b"\r\n\r\n")[0])["warc-record-id"] for place in ("0:1", "0:1", "0:2", "1:1")]
    assert nameless[0] == nameless[1] and len(set(nameless)) == 3  # the same when a task is repeated


def test_the_network_is_a_plain_convolution():
    """Scores against loops over words, widths and filters; texts shorter than a filter and without a word among them."""
    rng = np.random.default_rng(3)
    model = toxicity.Model(
        rng.normal(0, 1, (3 * toxicity.BUCKETS, toxicity.DIM)).astype(np.float32),
        [rng.normal(0, 1, (w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
        [rng.normal(0, 1, toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS],
        rng.normal(0, 0.02, toxicity.FILTERS * len(toxicity.WIDTHS)).astype(np.float32),
        0.1,
    )
    texts = ["", "one", "Two words", "  a few more words, and é日本 of them ", "x" * 300 + " y", ". , !"]
    rows, bounds = toxicity.features(texts)
    want = []
    for t in range(len(texts)):
        own = [sum(model.table[i].astype(float) for i in rows[k]) for k in range(bounds[t], bounds[t + 1])]
        best = []
        for width, kernel, bias in zip(toxicity.WIDTHS, model.kernels, model.bias, strict=True):
            for f in range(toxicity.FILTERS):
                responses = [bias[f] + sum(float(own[i + j] @ kernel[j][:, f].astype(float)) for j in range(width)) for i in range(len(own) - width + 1)]
                best.append(max([0.0, *responses]))
        want.append(1 / (1 + np.exp(-(np.dot(best, model.out.astype(float)) + model.base))))
    assert np.allclose(model.scores(texts), want, atol=1e-5)
    split = np.concatenate([model.scores([t]) for t in texts])
    assert np.allclose(split, want, atol=1e-5)  # a text's score does not depend on its neighbours
    one = toxicity.words(["Toxic!"], toxicity.PUNCT)
    assert toxicity.features(["toxic"])[0].tolist() == toxicity.features(["TOXIC!"])[0].tolist() and len(one.hashes) == 1


def test_model_learns_by_parts_of_words():
    rng = random.Random(6)
    clean = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + rng.choice(["", "s", "ing"]) for _ in range(30))
    texts = [clean() + (f" vile{rng.randrange(10**6)} " if i % 3 == 0 else " ") + clean() for i in range(300)]
    model = toxicity.train(texts, np.array([float(i % 3 == 0) for i in range(300)], dtype=np.float32), epochs=30)
    scores = model.scores([clean(), clean() + " vileNEW " + clean()])
    assert scores[0] < 0.5 < scores[1]


def test_toxicity_does_not_depend_on_the_shares_of_the_sample(spark, monkeypatch):
    rows = [(i, "bad" if i % 10 == 0 else "fine", "en", int(i % 10 == 0)) for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: toxicity_share(toxic))
    whole, part = toxicity.fit(docs, docs), toxicity.fit(docs, docs, positives=100, negatives=100)
    n = [sum(t == kind and zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _, t in rows) for kind in (0, 1)]
    for model in (whole, part):
        assert abs(model.base - np.log(n[1] / n[0])) < 0.2


def toxicity_share(toxic):
    """A model that knows nothing but the share of toxic rows that it was shown."""
    model = toxicity.Model(np.zeros((3 * toxicity.BUCKETS, toxicity.DIM), dtype=np.float32), [np.zeros((w, toxicity.DIM, toxicity.FILTERS), dtype=np.float32) for w in toxicity.WIDTHS], [np.zeros(toxicity.FILTERS, dtype=np.float32) for _ in toxicity.WIDTHS], np.zeros(toxicity.FILTERS * len(toxicity.WIDTHS), dtype=np.float32), 0.0)
    model.base = float(np.log(toxic.mean() / (1 - toxic.mean())))
    return model


def test_toxicity_learns_from_long_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * (20_000 if i == 11 else 5), "en", i % 2) for i in range(1, 80)], "doc_id long, text string, lang string, toxic int")
    seen, own = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: seen.extend(map(len, texts)) or own(texts, toxic, epochs=1))
    assert zlib.crc32(b"11") % 5 and 11 // 7 % 10  # neither held out nor for calibration
    toxicity.fit(docs, docs)
    assert max(seen) == 100_000


def test_toxicity_learns_from_all_rows(spark, monkeypatch):
    """Twelve bad words, of which the few rows of the starting point show some at most; several shards find them all, and the thresholds count every row of the tenth."""
    rng = random.Random(8)
    clean = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(20))
    bad = [f"{a}{b}" for a in ("zyx", "qwo", "kju") for b in ("lorth", "mump", "vask", "drib")]
    rows = [(i, f"{clean()} {bad[i // 4 % 12]} {clean()}" if i % 4 == 0 else f"{clean()} {clean()}", "en", int(i % 4 == 0)) for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(3)
    monkeypatch.setattr(toxicity, "SHARD_CHARS", 200_000)
    counted, own = [], toxicity.best_thresholds
    monkeypatch.setattr(toxicity, "best_thresholds", lambda counts: counted.append(counts) or own(counts))
    model = toxicity.fit(docs, docs, positives=4, negatives=4)
    assert (model.scores([f"{clean()} {word} {clean()}" for word in bad]) > 0.5).all() and (model.scores([clean() for _ in range(20)]) < 0.5).all()
    assert counted[0]["en"].sum() == sum(i // 7 % 10 == 0 and zlib.crc32(str(i).encode()) % 5 != 0 for i, *_ in rows)
    again = toxicity.fit(docs.repartition(5), docs, positives=4, negatives=4)  # however the rows lie
    assert np.abs(again.table - model.table).max() < 1e-5


def test_calibration_weighs_the_classes():
    class Scores:
        def scores(self, texts):
            return np.array([float(t) for t in texts])

    texts, toxic = ["0.3"] * 30 + ["0.8"] * 30 + ["0.3"] * 20, np.array([1.0] * 60 + [0.0] * 20)
    assert toxicity.calibrate(Scores(), texts, toxic, ["en"] * 80)["en"] == 0.3
    assert toxicity.calibrate(Scores(), texts, toxic, ["en"] * 80, weights=(100.0, 1.0))["en"] == 0.5


def test_ratios_without_a_target_are_zero(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert not quality.log_ratios(quality.ngram_counts(docs, np.zeros(0, dtype=np.int64))).any()
