"""Each training-data operator against a plain version of itself on small tables: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import block_dedup, components, fm_quality, line_dedup, mixing, piece_codec, preference, sharding, simhash, toxicity, winnowing
from tessera.session import reach_workers

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that it was for on are as with his they at be this from".split()


@pytest.fixture(autouse=True)
def workers(spark):
    reach_workers(spark)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ing", "s", "ly"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    texts += [None, "", " ", "\n\t", texts[0], texts[0].replace(" ", "  "), texts[1] + " ", "word", "é" * 3000, prose(rng, 9000), texts[2] + " more words here"]
    texts += ["Same line that is long enough to be counted as one key.\n" + t for t in texts[5:12] if t]
    out = [(k * 3, t, "en", f"s{k % 3}" if k % 7 else None, None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*out, out[0], (None, texts[3], "en", "s0", 5)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = {"key": "x", "level": "y", "name": "z", "h1": "w", "_text": "v"}
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({k: F.lit(v) for k, v in clash.items()})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def squeeze(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


# 6


def exact_brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[squeeze(r[1])].append(r[0])
    out = []
    seen = set()
    for r in rows:
        t = squeeze(r[1])
        ids = [i for i in groups[t] if i is not None]
        keep = min(ids) if ids else None
        first = (r[0], t) not in seen
        seen.add((r[0], t))
        out.append((r[0], keep, len(groups[t]), r[0] == keep and first, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "bits"), [(2048, 64), (256, 2)])
def test_block_naming(docs, rows, block, bits):
    got = block_dedup.mark(docs, block, bits).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")))
    assert sorted(map(tuple, got.collect()), key=repr) == exact_brute(rows)


def test_exact_deduplicate(docs, rows):
    kept = block_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(r[0] for r in exact_brute(rows) if r[3] and r[0] is not None)


# 10


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_feistel_is_a_permutation(n):
    assert sorted(sharding.permute(np.arange(n), n, 9)) == list(range(n))
    assert (sharding.permute(np.arange(n), n, 9) == np.concatenate([sharding.permute(np.array([k]), n, 9) for k in range(n)])).all()


def test_sharding(docs, rows):
    got = sharding.op10_feistel_sharding(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    sizes = [len(by.get(k, [])) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted(((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == want
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, sharding.op10_feistel_sharding(docs.repartition(3)).collect()), key=repr)


# 5


def simhash_brute(text):
    import xxhash

    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def linked_brute(fps, radius):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_documents(docs, rows):
    fps = [simhash_brute(r[1]) for r in rows]
    roots = linked_brute(fps, 2)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[root] = min(r[0], least.get(root, r[0]))
    want = sorted(((r[0], f"{fp:016x}", least.get(root)) for r, fp, root in zip(rows, fps, roots, strict=True)), key=repr)
    assert sorted(map(tuple, simhash.op5_pigeonhole_simhash(docs).collect()), key=repr) == want


@pytest.mark.parametrize(("radius", "bucket"), [(2, 2048), (2, 24), (0, 2)])
def test_simhash_search_is_complete(spark, radius, bucket):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {b ^ sum(1 << k for k in set(rng.choices(range(20), k=rng.randint(0, 4)))) for b in base for _ in range(25)}
    fps |= {base[0] ^ 1 << i ^ 1 << j for i in range(12) for j in range(i)}
    fps = sorted(simhash._signed(x) for x in fps)
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(nodes, radius, bucket)).collect()}
    want = linked_brute([x % 2**64 for x in fps], radius)
    assert [roots.get(x, x) for x in fps] == [fps[k] for k in want]


def test_thresholds_meet_the_pigeonhole():
    parts = [list(range(0, 20)), list(range(20, 40)), list(range(40, 64))]
    cost, thresholds = simhash.allocate([1e9, 10.0, 10.0], np.full(64, 0.5), parts, 1000, 2)
    assert sum(thresholds) == 2 - 3 + 1 and thresholds[0] < 0 < max(thresholds)
    assert cost > 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    roots = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {x: roots.get(x, x) for x in label} == label


# 2


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_codec_matches_the_library(docs, rows, model):
    import sentencepiece

    spm = sentencepiece.SentencePieceProcessor(model_file=model)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in rows:
        ids = spm.encode(r[1] or "")
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(spm.decode(ids))))
    assert sorted(map(tuple, piece_codec.op2_piece_codec(docs, model).collect()), key=repr) == sorted(want, key=repr)


def test_codec_on_random_texts(model):
    import sentencepiece

    spm = sentencepiece.SentencePieceProcessor(model_file=model)
    codec = piece_codec.loaded(piece_codec.read_model(model))
    rng = random.Random(8)
    signs = "abcdefghetion  \n\t▁éüñ0123<>x漢字日本🙂́ая\x00.,’”²"
    for _ in range(1500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.2:
            text = text.replace("a", " " * rng.randint(1, 40))
        ids = spm.encode(text)
        assert codec.encode(text).tolist() == ids
        assert codec.decode(ids) == spm.decode(ids)


def test_pair_compatibility(model):
    codec = piece_codec.loaded(piece_codec.read_model(model))
    rng = random.Random(2)
    ids = [i for i in codec.piece_id.values() if codec.length[i] <= 4]
    for _ in range(4000):
        a, b = rng.choice(ids), rng.choice(ids)
        assert codec.compatible(a, b) == codec.literal_compatible(a, b)


def test_ids_round_trip(docs, model):
    ids = piece_codec.encode(docs, model)
    back = {r["doc_id"]: r["text"] for r in piece_codec.decode(ids, model).collect()}
    assert all(back[r["doc_id"]] == (r["text"] or "") for r in docs.filter("doc_id is not null").collect())


# 4


def test_folding():
    assert toxicity.fold("ІDІОТ").split() == ["idiot"]
    assert toxicity.fold("1d10t st​up1d m0r0n!").split() == ["idiot", "stupid", "moron"]
    assert toxicity.fold("you s.t.u.p.i.d").split() == ["you", "stupid"]
    assert toxicity.fold("éàü ＬＯＳＥＲ").split() == ["eau", "loser"]
    assert toxicity.fold("").split() == []


def test_lexicon_exceptions():
    lexicon = toxicity.Lexicon({"trash": 4.0, "idiot": 4.0, "low+": 3.0}, ["trash can"], (-3.0, 1.0, 0.5, 0.5))
    assert lexicon.measures("put it in the trash can now") == (0.0, 0.0, 0.0)
    assert lexicon.measures("you are trash")[0] > 0
    assert lexicon.measures("idiots everywhere")[0] > 0
    assert lexicon.measures("low")[0] == 0 and lexicon.measures("lowest")[0] > 0


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
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_learns(spark):
    docs, labels = labelled_table(spark)
    got = {r["doc_id"]: r for r in toxicity.op4_lexicon_toxicity(docs, labels).collect()}
    held = [k for k in range(360) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k]["held_out"] == (k in held) for k in got)
    assert sum((got[k]["predicted"] == 1) == (k % 4 == 0) for k in held) >= 0.95 * len(held)
    assert not any(got[k]["predicted"] for k in held if k % 4)


def test_quality_learns(spark):
    docs, labels = labelled_table(spark)
    got = {r["doc_id"]: r for r in fm_quality.op7_factorisation_machine(docs, labels).collect()}
    held = [k for k in got if got[k]["held_out"]]
    assert sum((got[k]["predicted"] == 1) == (k % 3 != 0) for k in held) >= 0.95 * len(held)
    kept = fm_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k in got if got[k]["predicted"]}


def test_pairwise_sum_identity():
    rng = np.random.default_rng(1)
    machine = fm_quality.Machine(np.zeros((17, 9)), 0.3, rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32))
    at, x = np.array([3, 7, 20, 41]), rng.normal(size=4).astype(np.float32)
    pairs = sum(float(machine.v[at[i]] @ machine.v[at[j]]) * x[i] * x[j] for i in range(4) for j in range(i))
    assert abs(machine.raw(at, x)[0] - (0.3 + float(machine.w[at] @ x) + pairs)) < 1e-4


def test_no_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.op4_lexicon_toxicity(docs, labels).count() == docs.count()
    assert {round(r["score"], 6) for r in fm_quality.op7_factorisation_machine(docs, labels).collect()} == {0.5}


# all


def test_empty_tables(spark, nothing, model):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert block_dedup.op6_block_naming(nothing).count() == 0
    assert line_dedup.op9_line_bitmaps(nothing).count() == 0
    assert sharding.op10_feistel_sharding(nothing).count() == 0
    assert simhash.op5_pigeonhole_simhash(nothing).count() == 0
    assert winnowing.op3_winnowing(nothing).count() == 0
    assert piece_codec.op2_piece_codec(nothing, model).count() == 0
    assert toxicity.op4_lexicon_toxicity(nothing, labels).count() == 0
    assert fm_quality.op7_factorisation_machine(nothing, labels).count() == 0
    assert mixing.op8_temperature_mixing(nothing).count() == 0
    assert mixing.mix(nothing).count() == 0
    assert preference.op1_preference_pairs(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
