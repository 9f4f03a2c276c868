"""The search for near copies against all pairs, compared exactly."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, near_copies, simhash
from tessera.session import reach_workers

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that it was for on are as with his they at be this from".split()


@pytest.fixture(autouse=True)
def workers(spark):
    reach_workers(spark)


def prose(rng, n):
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(5000)}" for _ in range(n))


def changed(rng, text, like, mark):
    """The text with single words changed, so that its similarity is about the given one; each change breaks five shingles."""
    words = text.split()
    edits = max(1, round(len(words) * (1 - like) / (1 + like) / 5))
    for at in range(edits):
        words[(2 * at + 1) * len(words) // (2 * edits)] = f"{mark}{at}"
    return " ".join(words)


def cut(text, like, mark):
    """The text with other words at its end."""
    words = text.split()
    new = round(len(words) * (1 - like) / (1 + like))
    return " ".join([*words[: len(words) - new], *(f"{mark}{k}" for k in range(new))])


def grams(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def alike_pairs(texts):
    sets = [grams(t) for t in texts]
    return [(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def grouped(n, pairs):
    label = list(range(n))
    while True:
        before = list(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def corpus():
    rng = random.Random(17)
    texts = [prose(rng, rng.randint(60, 400)) for _ in range(120)]
    texts += [changed(rng, texts[k], rng.uniform(0.80, 0.92), f"edit{k}x") for k in range(60)]
    texts += [cut(texts[k % 15], rng.uniform(0.60, 0.79), f"far{k}x") for k in range(45)]
    texts += [cut(texts[-1 - k], rng.uniform(0.78, 0.84), f"next{k}x") for k in range(15)]
    texts += [cut(texts[0], rng.uniform(0.82, 0.97), f"many{k}x") for k in range(30)]
    texts += [changed(rng, texts[1], rng.uniform(0.70, 0.90), f"family{k}x") for k in range(40)]
    return texts


@pytest.mark.parametrize(("prints", "sets"), [(2048, 256), (6, 5)])
def test_all_near_copies_go_and_nothing_else(spark, monkeypatch, prints, sets):
    monkeypatch.setattr(near_copies, "PRINTS", prints)
    monkeypatch.setattr(near_copies, "SETS", sets)
    texts = corpus()
    pairs = alike_pairs(texts)
    label = grouped(len(texts), pairs)
    want = [k for k in range(len(texts)) if label[k] == k]
    assert len(texts) - len(want) > 100
    rows = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in enumerate(texts)], DOCS)
    assert sorted(r["doc_id"] for r in near_copies.deduplicate(rows).collect()) == want


def test_bands_miss_few():
    """Of pairs at 0.8 to 0.82 at least 0.95 share a band, whatever way they differ; of strangers next to none."""
    rng = random.Random(5)
    hits, near, met = 0, 0, 0
    seen = []
    for k in range(400):
        a = prose(rng, rng.randint(80, 500))
        b = changed(rng, a, 0.81, f"e{k}x") if k % 2 else cut(a, 0.81, f"e{k}x")
        x, y = (simhash.shingle_set(t, 5) for t in (a, b))
        s = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        seen.append(near_copies.bands(x))
        if 0.8 <= s <= 0.82:
            near += 1
            hits += (seen[-1] == near_copies.bands(y)).any()
    assert near > 60 and hits >= 0.95 * near
    for a, b in zip(seen, seen[1:], strict=False):
        met += (a == b).any()
    assert met == 0


def test_fingerprints_are_simhash():
    """Each bit is set if more than half of the hashes have it; the words differ where texts do, by about the angle of their sets."""
    rng = random.Random(6)
    a = prose(rng, 400)
    hashes = simhash.shingle_set(a, 5)
    plain = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes))
    assert near_copies.wide_fingerprint(hashes)[0] == plain
    off = []
    for k in range(60):
        b = near_copies.wide_fingerprint(simhash.shingle_set(cut(a, 0.8, f"z{k}x"), 5))
        off.append(sum((x ^ y).bit_count() for x, y in zip(near_copies.wide_fingerprint(hashes), b, strict=True)))
    assert 30 < sum(off) / len(off) < 46 and max(off) <= near_copies.TOTAL
    assert near_copies.wide_fingerprint(np.zeros(0, np.uint64)) == [0, 0, 0, 0]


@pytest.mark.parametrize("chunk", [3, 24, 2048])
def test_group_links_are_verified_at_every_size(spark, chunk):
    """The components of all close pairs within groups: rows close in one word only stay apart, chains and border links hold."""
    rng = random.Random(9)
    word = lambda: rng.getrandbits(64)
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    base = [word() for _ in range(4)]
    fps = [tuple(flip(w, rng.randint(5, 9)) for w in base) for _ in range(50)]
    fps += [(flip(base[0], 2), word(), word(), word()) for _ in range(40)]
    fps += [tuple(flip(w, 14) for w in fp) for fp in fps[:20]]
    fps += [tuple(flip(w, 13) for w in fp) for fp in fps[-20:]]
    groups = [(g, k) for k in range(len(fps)) for g in {rng.randrange(3), 3 + k % 2}]
    near = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(fps[a], fps[b], strict=True)) <= near_copies.TOTAL
    held = defaultdict(list)
    for g, k in groups:
        held[g].append(k)
    label = grouped(len(fps), [(a, b) for ks in held.values() for b in ks for a in ks if a < b and near(a, b)])
    assert 1 < len(set(label)) < len(fps)
    rows = spark.createDataFrame([(g, k, *map(simhash._signed, fps[k])) for g, k in groups], ", ".join(f"{c} long" for c in ["grp", "id", *near_copies.FPS]))
    links = near_copies.group_links(rows, near_copies.FPS, near_copies._close, near_copies.join_close, chunk)
    roots = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert [roots.get(k, k) for k in range(len(fps))] == label


def test_join_alike_is_exact():
    rng = random.Random(2)
    sets = [rng.sample(range(60), rng.randint(0, 40)) for _ in range(30)]
    sets += [s[: max(0, len(s) - rng.randint(0, 8))] for s in sets]
    column = pa.array([sorted(s) for s in sets], pa.list_(pa.int64()))
    like = [(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(set(sets[a]) & set(sets[b])) >= 4 * len(set(sets[a]) | set(sets[b]))]
    label = np.arange(len(sets))
    near_copies.join_alike([column], None, label)
    assert label.tolist() == grouped(len(sets), like)
    label = np.arange(len(sets))
    near_copies.join_alike([column[:20]], [column[20:]], label)
    assert label.tolist() == grouped(len(sets), [(a, b) for a, b in like if a < 20 <= b])


def test_defined_cases(spark):
    """Null, empty, short and very long texts, clashing names, and what stays of each group."""
    rng = random.Random(3)
    base, long = prose(rng, 400), prose(rng, 30_000)
    rows = [(1, base), (2, changed(rng, base, 0.95, "new")), (3, prose(rng, 300)), (4, ""), (5, None), (6, "one two"), (7, "ONE two"), (8, long), (9, long + " more"), (None, "x"), (10, "one three")]
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in rows], DOCS).withColumns({c: F.lit(c) for c in ("id", "grp", "team", "keys", "fp1", "_whole", "root")})
    kept = near_copies.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 3, 4, 6, 8, 10, None], key=repr)
    assert near_copies.deduplicate(docs.limit(0)).count() == 0


def test_rows_are_told_apart_by_their_texts(spark):
    """Rows that share a doc_id, or have none."""
    rng = random.Random(23)
    a, b, c, d = (prose(rng, 300) for _ in range(4))
    rows = [(1, a), (5, a + " more"), (5, b), (7, c), (7, c + " more"), (None, d), (None, d + " more"), (None, "alone"), (9, b + " more"), (11, "twice"), (11, "twice")]
    kept = Counter((r["doc_id"], r["text"]) for r in near_copies.deduplicate(spark.createDataFrame([(k, t, "en", "a", 1) for k, t in rows], DOCS)).collect())
    assert kept.pop((11, "twice")) == 2 and set(kept.values()) == {1}
    assert (1, a) in kept and (5, a + " more") not in kept
    assert (5, b) in kept and (9, b + " more") not in kept and (None, "alone") in kept
    for k, t in ((7, c), (None, d)):
        assert ((k, t) in kept) + ((k, t + " more") in kept) == 1
    assert len(kept) == 5
