"""The corpus pipeline against a plain version of its stages on a small corpus."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, fm_quality, piece_codec, registry
from tessera.session import reach_workers

WORDS = "the of and to in is that it was for on are as with his they at be this from".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ing", "s", "ly", "ness"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    reach_workers(spark)
    rng = random.Random(12)
    rows, labels = [], []
    for k in range(150):
        good = k % 5 != 0
        text = prose(rng, rng.randint(60, 140))
        text = text if good else " ".join(w.upper() + "***" for w in text.split())
        rows.append((k, text, "en", f"s{min(k % 6, 2)}", len(text)))
        labels.append((k, int(good), 0))
    rows.append((150, rows[1][1].replace(" ", "  "), "en", "s0", 1))
    words = rows[2][1].split()
    rows.append((151, " ".join([*words[:-1], "edited"]), "en", "s1", 1))
    rows += [(152, None, "en", None, None), (153, rows[3][1], None, "s2", 1)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def near_brute(rows):
    """The least id of each component of documents whose sets of five-word shingles have a similarity of 0.8; all pairs."""
    grams = lambda w: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    sets = [grams((r[1] or "").lower().split()) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
        if all(label[label[i]] == label[i] for i in range(len(rows))):
            break
    return [r for k, r in enumerate(rows) if label[k] == k]


def test_pipeline(spark, corpus):
    sentencepiece = pytest.importorskip("sentencepiece")
    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    machine = fm_quality.fit(docs, registry.labels(spark, path))
    good = [r for r in rows if machine.score(r[1], r[4]) >= 0.5]
    assert {r[0] for r in good} >= {k for k in range(150) if k % 5} - {0} and not any(r[0] % 5 == 0 for r in good if r[0] < 150)
    seen, exact = set(), []
    for r in sorted(good, key=lambda r: r[0]):
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        if text not in seen:
            seen.add(text)
            exact.append(r)
    near = near_brute(exact)
    assert {r[0] for r in exact} - {r[0] for r in near} == {151}
    spm = sentencepiece.SentencePieceProcessor(model_file=registry.piece_model())
    want = {r[0]: (r[3], len(ids := spm.encode(r[1] or "")), ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for r in near}
    before = common.written()
    got = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"]: (r["source"], r["n_tokens"], r["ids"], r["ids_sha256"]) for r in got} == want
    # only the table that the last stage reads is still there
    assert len(common.written() - before) == 1
    copies = Counter(r["doc_id"] for r in got)
    assert set(copies.values()) <= {1, 2} and len(got) > len(near)


def test_stages_keep_the_columns(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "encode"]
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, path).columns == docs.columns


def test_empty_tables_and_clashing_columns(spark, corpus, tmp_path):
    path, rows = corpus
    clash = ["_whole", "_doc", "_k1", "id", "grp", "root", "name", "level", "key", "_length", "_source", "copies", "n", "label", "score"]
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({c: F.lit(c) for c in clash})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, path)
        assert docs.columns[-len(clash) :] == clash
    same = lambda where: sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(where)).collect())
    assert same(tmp_path) == same(path)
    for name in ("documents", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_registered(spark):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    assert piece_codec.SPACE
    numbers = sorted(int(n[2:].split("_")[0]) for n in __spark_entry__.queries() if re.match(r"op\d+_", n))
    assert numbers == list(range(1, 11))
