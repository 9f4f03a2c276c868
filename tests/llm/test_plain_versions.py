"""Operators without SQL against plain versions written from their rules: mixing, sharding, winnowing, preference pairs, and both classifiers."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, fm_quality, mixing, preference, sharding, toxicity, training_sample, winnowing
from tessera.session import reach_workers

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that it was for on are as with his they at be this from".split()
NO_ID = -(2**63)


@pytest.fixture(autouse=True)
def workers(spark):
    reach_workers(spark)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ing", "s", "ly"]) for _ in range(n))


def table(n=90):
    """Nulls, empty and very long texts, repeated ids and rows."""
    rng = random.Random(5)
    rows = [(k * 3, prose(rng, rng.randint(1, 80)), "en", rng.choice(["a", "a", "a", "b", "c", None]), 7) for k in range(n)]
    rows += [(500, None, "en", "a", None), (501, "", None, "empty", 0), (502, " \n\t", "en", "empty", 3), (503, prose(rng, 12_000), "en", "c", 1), (503, "again", "en", "c", 1)]
    return [*rows, rows[0], rows[0], (None, "no id at all", "en", "b", 5), (None, "nor here", "en", "b", 5)]


CLASH = ("_block", "passes", "rest", "tokens", "n", "weight", "_key", "_range", "row_number", "_place", "own", "label", "score", "_length", "size")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), DOCS).withColumns({c: F.lit(c) for c in CLASH})


def xx(*values):
    """Spark's xxhash64 of longs and ints: each hash is the next one's seed; nulls are passed over. Longs are given as (value,)."""
    import xxhash

    seed = 42
    for v in values:
        if v != (None,):
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v[0]) if isinstance(v, tuple) else struct.pack("<i", v), seed)
    return seed - 2**64 if seed >> 63 else seed


# 8: mixing


def mixed(rows, repeat_limit=1.5, target_entropy=None, budget=None):
    """Copies of each row, in plain Python."""
    counted = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, _, s, _ in rows]
    tokens, number = defaultdict(int), Counter()
    for _, s, n in counted:
        tokens[s] += n
        number[s] += 1
    some = {s: n for s, n in tokens.items() if n}
    top = max(some.values())

    def weights(a):
        raised = {s: (n / top) ** a for s, n in some.items()}
        return {s: r / sum(raised.values()) for s, r in raised.items()}

    def good(a):
        w = weights(a)
        if target_entropy is not None:
            return -sum(p * math.log(p) for p in w.values()) <= target_entropy
        passes = [w[s] / some[s] for s in some]
        return max(passes) / min(passes) <= repeat_limit

    low, high = (0.0, 0.0) if good(0.0) else (0.0, 1.0)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if good(middle) else (middle, high)
    w = weights(high)
    whole = budget is None
    budget = max(math.ceil(some[s] / w[s] - 1e-9) for s in some) if whole else budget
    out = []
    for s in tokens:
        mine = [(d, n) for d, x, n in counted if x == s]
        own = max(math.floor(w.get(s, 0) * budget + 1e-6), tokens[s] if whole else 0)
        passes, rest = divmod(own, tokens[s]) if tokens[s] else (1, 0)
        blocks = math.ceil(math.sqrt(number[s]))
        block = {d: xx((d,), mixing.SEED) % blocks for d, _ in mine}
        order = sorted({(xx(block[d], mixing.SEED, (passes,)), block[d], xx((d,), mixing.SEED + 1, (passes,)), NO_ID if d is None else d, d is None, d) for d, _ in mine}, key=lambda x: x[:4])
        sums = Counter()
        for d, n in mine:
            sums[d] += n
        taken, left, cut = set(), rest, None
        for b in dict.fromkeys(x[1] for x in order):
            here = [x for x in order if x[1] == b]
            total = sum(sums[x[5]] for x in here)
            if cut is None and total <= left:
                taken |= {x[5] for x in here}
                left -= total
            elif cut is None:
                cut, upto = b, 0
                for x in here:
                    upto += sums[x[5]]
                    if upto > left:
                        break
                    taken.add(x[5])
        out += [(d, s, n, passes + (d in taken and rest > 0 and cut is not None)) for d, n in mine]
    return sorted(out, key=repr), w


@pytest.mark.parametrize("how", [{}, {"budget": 3000}, {"budget": 700}, {"repeat_limit": 3.0}, {"repeat_limit": None, "target_entropy": 1.0}, {"repeat_limit": 1.0}])
@pytest.mark.parametrize("few", [100_000, 0])
def test_copies_match_the_plain_version(spark, docs, monkeypatch, how, few):
    if not few and how not in ({}, {"budget": 700}):
        pytest.skip("joins instead of broadcasts are tested twice")
    monkeypatch.setattr(mixing, "BROADCAST", few)
    want, weights = mixed(table(), **how)
    counted = mixing._counted(docs)
    got = mixing.copies(counted, mixing.plan(counted, **how)).collect()
    assert all(abs(r["weight"] - weights.get(r["source"], 0.0)) < 1e-9 for r in got)
    assert sorted(((r["doc_id"], r["source"], r["tokens"], r["copies"]) for r in got), key=repr) == want
    if not how:
        repeated = mixing.mix(docs)
        assert repeated.columns == docs.columns and repeated.filter("_block <> '_block' or tokens <> 'tokens'").count() == 0
        assert Counter(r["doc_id"] for r in repeated.collect()) == sum((Counter({d: c}) for d, _, _, c in want), Counter())


def test_exponents():
    assert mixing.bisect_exponent(lambda a: a >= 0.25) == 0.25
    assert mixing.bisect_exponent(lambda a: True) == 0.0
    assert abs(mixing.bisect_exponent(lambda a: 100 ** (1 - a) <= 2.0) - (1 - math.log(2) / math.log(100))) < 1e-12


def test_a_pass_is_never_rounded_away(spark):
    """Sums of tokens beyond the digits of a double's fraction: each source still passes once."""
    rows = [(k, f"s{k}", f"s{k}", 10**15 + 7 * k) for k in range(5)]
    counted = spark.createDataFrame(rows, "doc_id long, source string, _source string, tokens long")
    assert {r["passes"] for r in mixing.copies(counted, mixing.plan(counted)).collect()} == {1}


# 10: sharding


def feistel(x, n, seed):
    """One row number, bit by bit from the rule."""
    w, mask = 1, 2**64 - 1
    while 4**w < n:
        w += 1
    while True:
        left, right = x >> w, x & (2**w - 1)
        for i in range(sharding.ROUNDS):
            key = (seed + (i + 1) * 0x9E3779B97F4A7C15) & mask
            v = right ^ key
            v = ((v ^ v >> 33) * 0xFF51AFD7ED558CCD) & mask
            v = ((v ^ v >> 33) * 0xC4CEB9FE1A85EC53) & mask
            left, right = right, left ^ ((v ^ v >> 33) & (2**w - 1))
        x = left << w | right
        if x < n:
            return x


def test_shard_and_slot_match_the_plain_version(spark, docs):
    rows = sorted(((NO_ID if d is None else d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8, d) for d, t, *_ in table()), key=lambda r: r[:3])
    want = []
    for number, (_, crc, size, d) in enumerate(rows):
        p = feistel(number, len(rows), 20240601)
        want.append((d, size, crc, "rows", p % 24, p // 24, None, number))
    assert sorted(map(tuple, sharding.op10_feistel_sharding(docs).collect()), key=repr) == sorted(want, key=repr)


# 3: winnowing

ALONE = "฀-๿぀-ヿ㐀-鿿가-힯"


def winnowed(text, k=5, w=8):
    """Chosen hashes and their places."""
    import xxhash

    words = re.findall(f"[{ALONE}]|[^\x20\x09-\x0d{ALONE}]{{1,32}}", text)
    hashes = [xxhash.xxh64_intdigest(t, 42) for t in words]
    turn = lambda x: (x << 1 | x >> 63) & (2**64 - 1)
    if not words:
        return [], []
    grams = [xxhash.xxh64_intdigest(" ".join(words), 42)]
    if len(words) >= k:
        grams = []
        for i in range(len(words) - k + 1):
            x = 0
            for h in hashes[i : i + k]:
                x = turn(x) ^ h
            grams.append(x)
    at = []
    for start in range(max(1, len(grams) - w + 1)):
        best = min(range(start, min(len(grams), start + w)), key=lambda p: (grams[p] >> 33, -p))
        if best not in at:
            at.append(best)
    return [grams[p] for p in at], at


@pytest.mark.parametrize(("k", "w"), [(5, 8), (7, 5), (4, 6), (1, 1), (3, 2)])
def test_fingerprints_match_the_plain_version(spark, k, w):
    rng = random.Random(4)
    texts = [prose(rng, n) for n in (0, 1, 2, 3, 4, 5, 7, 11, 12, 13, 60, 300)] + ["漢字の文書です" * 4, "a a a a a a a a a a a a a a a a a a", "x" * 5000, prose(rng, 20_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["f"], r["f_at"]) for r in winnowing.fingerprint(df, "text", "f", k, w).collect()}
    for i, t in enumerate(texts):
        hashes, at = winnowed(t, k, w)
        assert got[i][1] == at and [h % 2**64 for h in got[i][0]] == hashes


def dice(a, b):
    a, b = set(a), set(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_likeness_and_edits_match_the_plain_version(spark, docs):
    # rows that share an id follow each other in the order of a hash of their text; here ids are single
    rows = [r for k, r in enumerate(table()) if r[0] is not None and r[1] and k < 95 and r[0] != 503 and k not in (0,)]
    base = next(r[1] for r in rows if 60 < len(r[1].split()) < 100)
    rows += [(1000, base, "en", "a", 1), (1001, base + " and a good deal more of it", "en", "a", 1), (1002, "", "en", "a", 1)]
    rows = [*rows, (None, "the last one has no id", "en", "a", 1)]
    order = sorted(rows, key=lambda r: NO_ID if r[0] is None else r[0], reverse=True)
    want = []
    for k, r in enumerate(order):
        text, ahead = r[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + ahead[:half]
        own, other, after = (winnowed(t)[0] for t in (text, edited, ahead))
        shown = lambda hashes: " ".join(f"{h & (2**48 - 1):012X}" for h in hashes)
        want.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(other), round(dice(own, other), 12), round(dice(own, after), 12)))
    got = winnowing.op3_winnowing(spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(c) for c in CLASH}))
    got = [(*r[:5], round(r[5], 12), round(r[6], 12)) for r in map(tuple, got.collect())]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(0 < r[6] < 1 for r in want) and any(0 < r[5] < 1 for r in want)


def test_next_documents_with_repeated_ids(spark, docs):
    got = winnowing.op3_winnowing(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in table())
    by_text = defaultdict(set)
    for r in table():
        by_text[r[1] or ""].add(next(x["fingerprint"] for x in got if x["doc_id"] == r[0] and x["n_chars"] == len(r[1] or "")))
    assert all(len(v) == 1 for v in by_text.values())


# 1: preference pairs


def chat(spark, convs):
    return spark.createDataFrame([(c, t, r, x) for c, turns in convs.items() for t, (r, x) in enumerate(turns)], "conv_id long, turn long, role string, text string")


def test_preference_prefix(spark):
    shared = [("system", "be kind"), ("user", "hi <|im_end|>")]
    turns = chat(spark, {1: [*shared, ("assistant", "hello"), ("user", "bye")], 2: [*shared, ("assistant", "go away")], 9: [("user", None), (None, "x")]})
    out = {r["chosen_id"]: r for r in preference.format_pairs(preference.pair_by_prompt(turns)).collect()}
    assert set(out) == {1, 9}
    r = out[1]
    assert (r["rejected_id"], r["n_common"]) == (2, 2)
    assert r["prompt"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhi < |im_end|><|im_end|>\n"
    parts = {side: [r[side][s["start"] : s["end"]] for s in r[f"{side}_spans"]] for side in ("chosen", "rejected")}
    assert parts == {"chosen": ["hello<|im_end|>"], "rejected": ["go away<|im_end|>"]}
    assert r["chosen"].endswith("<|im_start|>user\nbye<|im_end|>\n")
    assert (out[9]["rejected_id"], out[9]["prompt"], out[9]["rejected"]) == (None, "", "")
    assert out[9]["chosen"] == "<|im_start|>user\n<|im_end|>\n<|im_start|>\nx<|im_end|>\n" and out[9]["chosen_spans"] == []


def said():
    said = {k: [("user", f"prompt {k // 2}"), ("assistant", f"answer {k}")] for k in range(20)}
    said |= {k: [("user", f"single {k}"), ("assistant", "x")] for k in range(20, 25)}
    said |= {k: [("user", "hot"), ("assistant", f"y{k % 3}")] for k in range(30, 37)}
    said[40] = [("user", "long " * 50_000), ("assistant", "z" * 100_000), *[("user", "more"), ("assistant", "again <|im_start|>")] * 40]
    return said


def test_preference_pairs_meet_on_their_prompt(spark):
    """Whatever their place in the global order: no two conversations on one prompt are both paired with strangers."""
    out = preference.format_pairs(preference.pair_by_prompt(chat(spark, said()))).collect()
    pairs = {(r["chosen_id"], r["rejected_id"]): r["n_common"] for r in out}
    assert {(k, k + 1) for k in range(0, 20, 2)} | {(30, 31), (32, 33), (34, 35)} <= {p for p, n in pairs.items() if n >= 1}
    assert sorted((x for p in pairs for x in p), key=repr) == sorted([*said(), *([None] if len(said()) % 2 else [])], key=repr)
    assert len({r["pair_id"] for r in out}) == len(out) == (len(said()) + 1) // 2


def test_preference_sql_says_the_same(spark):
    """Also of null ids, turns, roles and texts, turns that repeat a number, and clashing columns."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(c, t, r, x) for c, turns in said().items() for t, (r, x) in enumerate(turns)]
    rows += [(None, 0, "user", "hot"), (None, 1, "assistant", None), (50, None, "user", None), (50, 1, None, "b"), (50, 1, None, "a"), (51, None, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(c) for c in ("turns", "pair_id", "side", "_first", "t")})
    got = preference.op1_preference_pairs(turns)
    import pyarrow as pa

    con = duckdb.connect()
    con.register("conversations", pa.table({c: pa.array([r[k] for r in rows], pa.int64() if k < 2 else pa.string()) for k, c in enumerate(["conv_id", "turn", "role", "text"])}))
    cur = con.execute(preference.OP1_SQL)
    names = [c[0] for c in cur.description]
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


# 4: toxicity


def plain_measures(lexicon, text):
    """Every term at every word start, every exception everywhere."""
    folded = toxicity.fold(text)
    spared = [(m.start(), m.start() + len(p) + 1) for p in lexicon.exceptions for m in re.finditer(f"(?= {re.escape(p)} )", folded)]
    weights, words = [], set()
    for m in re.finditer(r"(?<= )[^ ]+", folded):
        fit = [(len(t.rstrip("+")), w) for t, w in lexicon.terms.items() if m[0].startswith(t.rstrip("+")) and (not t.endswith("+") or len(m[0]) > len(t) - 1)]
        if fit and not any(a <= m.start() <= b for a, b in spared):
            weights.append(max(fit)[1])
            words.add(m[0])
    total = sum(weights)
    return math.log1p(total), math.log1p(1000 * total / (1 + len(folded.split()))), math.log1p(len(words))


def test_measures_match_the_plain_matcher():
    rng = random.Random(3)
    lexicon = toxicity.Lexicon({"trash": 4.0, "tra": 1.0, "idiot": 4.5, "low+": 3.0, "scum": 2.0}, ["trash can", "pond scum", "can of trash can", "trash can trash"], (-3.0, 1.0, 0.5, 0.5))
    words = ["trash", "can", "of", "pond", "scum", "tr4sh", "ID1OT", "idiots", "low", "lowest", "the", "a", "..", "s.c.u.m"]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
        assert lexicon.measures(text) == pytest.approx(plain_measures(lexicon, text), abs=1e-12)


def test_measures_take_linear_time():
    lexicon = toxicity.Lexicon({"trash": 4.0}, ["trash can"], (-3.0, 1.0, 0.5, 0.5))
    start = time.perf_counter()
    assert lexicon.measures("trash can " * 100_000) == (0.0, 0.0, 0.0)
    assert lexicon.measures("trash bin " * 100_000)[0] > 0
    assert time.perf_counter() - start < 20


def hard_rows():
    return [(2000, None, None, None, None), (2001, "", None, "a", None), (2002, "word " * 200_000, "en", "a", 1), (2003, "idiot", "en", "a", 5), (2003, "idiot", "en", "a", 5), (None, "stupid moron", "en", "a", 9)]


def labelled_table(spark, n=360):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(n):
        toxic, good = k % 4 == 0, k % 3 != 0
        text = prose(rng, rng.randint(30, 90))
        if toxic:
            text += " " + " ".join(f"{rng.choice(['grumbo', 'idiot', 'm0ron'])}{rng.choice(['', 'x', 'y'])} {prose(rng, 4)}" for _ in range(3))
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split()) if not toxic else text.replace(" ", " | ")
        rows.append((k, text, "en", "a", len(text)))
        labels.append((k, int(good), int(toxic)))
    # labels of rows that repeat an id, and of none
    labels += [(None, 1, 1), (5, None, None), (2000, 1, 0), (2001, 0, 1), (2002, 1, 0), (2003, 0, 0)]
    docs = spark.createDataFrame([*rows, *hard_rows()], DOCS).withColumns({c: F.lit(c) for c in CLASH})
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("not read"))


def test_toxicity_scores_match_the_plain_matcher(spark):
    docs, labels = labelled_table(spark)
    lexicon = toxicity.fit(docs, labels)
    assert any(t.startswith("gru") for t in lexicon.terms)
    got = toxicity.op4_lexicon_toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    text = defaultdict(set)
    for r in docs.select("doc_id", "text").collect():
        text[r["doc_id"]].add(r["text"] or "")
    for r in got:
        z = [lexicon.curve[0] + sum(a * b for a, b in zip(lexicon.curve[1:], plain_measures(lexicon, t), strict=True)) for t in text[r["doc_id"]]]
        assert any(abs(r["score"] - 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))) < 1e-9 for x in z)
        assert r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_learned_terms_match_plain_counts(spark):
    """The counts made on the executors, and the test of each stem, from its rule."""
    docs, labels = labelled_table(spark)
    sample = training_sample.labelled(docs, labels, "toxic", 3000, ["text"])
    rows = sorted((r["doc_id"], r["label"], r["text"] or "") for r in sample.collect())
    kept = [r for v in (0, 1) for ids in [toxicity.distinct([(d, toxicity.least_hashes(t)) for d, m, t in rows if m == v])] for r in rows if r[0] in ids and r[1] == v]
    n1 = sum(m for _, m, _ in kept)
    n0 = len(kept) - n1
    df = {v: Counter(s for _, m, t in kept if m == v for s in toxicity.stems(t)) for v in (0, 1)}

    def evidence(a, b):
        q = (a + b) / (n1 + n0)
        one = lambda k, n: sum(x * math.log(x / (n * p)) for x, p in ((k, q), (n - k, 1 - q)) if x and p)
        return 2 * (one(a, n1) + one(b, n0))

    found = [(evidence(a, df[0][s]), s, toxicity.log_odds(a, df[0][s], n1, n0)) for s, a in df[1].items() if a >= 3]
    want = toxicity.choose_terms([f for f in found if f[0] >= toxicity.EVIDENCE and f[2] >= toxicity.LEAST_ODDS])
    # of stems with the same evidence either may come first after rounding
    got = toxicity.learn_terms(sample)
    assert {t: round(w, 9) for t, w in got.items()} == {t: round(w, 9) for t, w in want.items()} or sorted(round(w, 9) for w in got.values()) == sorted(round(w, 9) for w in want.values())


# 7: quality


def test_quality_scores_match_the_plain_machine(spark):
    """All pairs of inputs, one at a time, instead of the sum of squares."""
    docs, labels = labelled_table(spark)
    machine = fm_quality.fit(docs, labels)
    got = fm_quality.op7_factorisation_machine(docs, labels).collect()
    rows = docs.select("doc_id", "text", "n_chars").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows)
    want = defaultdict(list)
    for r in rows[::7] + rows[-len(hard_rows()) :]:
        at, x = machine.inputs(*fm_quality.features(r["text"], r["n_chars"]))
        x, v = x.astype(float), machine.v[at].astype(float)
        z = machine.bias + float(machine.w[at].astype(float) @ x)
        for i in range(len(at)):
            for j in range(i):
                z += float(v[i] @ v[j]) * x[i] * x[j]
        want[r["doc_id"]].append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
    for r in got:
        assert r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
        if r["doc_id"] in want:
            assert min(abs(r["score"] - s) for s in want[r["doc_id"]]) < 1e-3
    kept = fm_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.filter("_length <> '_length'").count() == 0
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["predicted"])


def test_training_sample_is_bounded(spark):
    """Rows, not ids: an id that many rows have is not learned from; the choice is the same whatever the partitions."""
    rows = [(k, f"text {k}", "en", "a", 1) for k in range(200)] + [(7, f"copy {k}", "en", "a", 1) for k in range(300)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(8, 1)], "doc_id long, toxic int")
    got = [sorted((r["doc_id"], r["label"]) for r in training_sample.labelled(spark.createDataFrame(rows, DOCS).repartition(n), labels, "toxic", 20, ["text"]).collect()) for n in (1, 5)]
    assert got[0] == got[1] and Counter(m for _, m in got[0]) == {0: 20, 1: 20}
    assert all(d != 7 and zlib.crc32(str(d).encode()) % 3 != 1 and m == (1 if d == 8 else d % 2) for d, m in got[0])


# shared


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_tables_are_removed(spark):
    kept = common.materialise(spark.range(3), "kept")
    before = common.written()
    gone = common.materialise(spark.range(5), "gone")
    common.discard_all(but=before)
    assert kept.count() == 3 and gone._shared_path not in common.written()
    common.discard(kept)
    with pytest.raises(Exception, match="(?i)path|exist"):
        kept.count()
