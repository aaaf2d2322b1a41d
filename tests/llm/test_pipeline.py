import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import test_decontam
import test_line_dedup
import test_near_dup
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from readloom.llm import common, pipeline, quality_classifier, queries, sql, stats
from readloom.llm.near_dup import near_duplicates


def test_stages_on_driver_tables(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = before = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == before.columns, name
            assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "line_dedup":
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))


def test_each_stage_equals_brute_force(spark, docs, labels, passages, rows, tmp_path):
    """The stages of a small corpus one after another, each against its definition."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(passages["items"], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = docs.columns.index("n_chars")

    def quality(now):
        rules = quality_classifier.fit_rules(docs, labels)
        out = []
        for r in now:
            x = stats.describe(r[1])[5:]
            margin = rules.bias + sum(w for w, t in zip(rules.weights, rules.terms) if all((x[f] <= c) == below for f, c, below in t))
            out += [r] * (1 / (1 + math.exp(-margin)) >= 0.3)
        return out

    def lines(now):
        texts = ["\n".join(kept) for _, _, kept in test_line_dedup.brute_texts(now)]
        return [(r[0], t, *r[2:at], len(t), *r[at + 1:]) for r, t in zip(now, texts)]

    def near(now):
        group = test_near_dup.brute(now, 80)
        return [r for r in now if r[0] is None or group[r[0]][1] == r[0]]

    def clean(now):
        dirty = {d for d, *_ in test_decontam.brute(now, passages["items"])}
        return [r for r in now if r[0] not in dirty]

    now, was, table = list(rows), None, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (quality, lines, near, clean)):
        now, was = brute(now), now
        out = stage(spark, table, str(tmp_path))
        assert out.columns == docs.columns, name
        assert Counter(tuple(r) for r in out.collect()) == Counter(now), name
        assert now != was and len(now) > 20, name
        out.write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    tokenizer.encode_special_tokens = True
    want = Counter()
    for r in now:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        ends = [o + n for o, n in sorted(p)]
        assert [o for o, _ in sorted(p)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_near_stage_drops_copies_of_similarity_080(spark):
    rng = random.Random(4)
    rows = []
    for k in range(30):  # 296 shingles; an edited word changes five: 6 edits are 266 of 326 (0.816), 7 are 261 of 331 (0.789)
        w = [f"w{rng.getrandbits(40)}" for _ in range(300)]
        rows.append((3 * k, " ".join(w)))
        for j, edits in ((1, 6), (2, 7)):
            c = [f"w{rng.getrandbits(40)}" for _ in range(300)] if j == 2 else w
            if j == 2:
                rows.append((1000 + k, " ".join(c)))
            c = list(c)
            for e in range(edits):
                c[20 + 40 * e] = f"edited{e}"
            rows.append((2000 * j + k, " ".join(c)))
    out = pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {i for i, _ in rows} - {r.doc_id for r in out.collect()} == set(range(2000, 2030))


def test_tables_between_steps_go(spark, docs):
    first = common.made()
    out = near_duplicates(docs)
    out.count()
    base = common._left[-1][1]
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert store.exists(path) and common.made() == first + 1
    common.tidy(first)
    assert not store.exists(path) and common.made() == first


def test_queries_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(sql.ORACLE_SQL) <= set(queries.QUERIES)
