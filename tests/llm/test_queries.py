"""The registered queries and the pipeline on whole tables, small ones."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievelake.llm import oracle, queries

DIR = "/root/testdata/sf0.001"
rng = random.Random(21)
WORDS = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(900)]
SHAPES = {
    1: ["doc_id", "held_out", "score", "predicted"],
    2: ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    4: ["doc_id", "fingerprint", "component_id"],
    6: ["page_id", "host", "path", "rule", "verdict"],
    7: ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    8: ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    10: ["doc_id", "held_out", "lang_pred", "score"],
    11: ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    12: ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    13: ["doc_id", "n_bytes", "n_tokens", "over_limit"],
}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_has_the_contract_columns(spark, name):
    df = queries.queries()[name](spark, DIR)
    n = int(name[2:].split("_")[0])
    if n in SHAPES:
        assert df.columns[: len(SHAPES[n])] == SHAPES[n]
        assert df.count() == spark.read.parquet(f"{DIR}/{'pages' if n == 6 else 'documents'}.parquet").count()
    else:
        assert df.count() > 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("conversations", "documents"):
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, DIR)
    r = c.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(r.fetchall(), key=str)


def prose(n):
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    clean = [(k, prose(120)) for k in range(120)]
    toxic = [(1000 + k, prose(40) + " idiot " + prose(40)) for k in range(60)]
    hidden = [(1100 + k, prose(30) + " 1d10t " + prose(30)) for k in range(5)]
    copies = [(2000 + k, clean[k][1]) for k in range(10)]
    near = [(2100 + k, clean[20 + k][1].replace(" ", "  ", 1) + " tail") for k in range(10)]
    passage = prose(70)
    repeated = [(3000 + k, prose(50) + " " + passage + " " + prose(50)) for k in range(6)]
    items = [(k, prose(30)) for k in range(5)]
    leaks = [(4000 + k, prose(60) + " " + items[k][1] + " " + prose(60)) for k in range(5)]
    odd = [(5000, None), (5001, ""), (5002, "x"), (None, prose(90))]
    rows = clean + toxic + hidden + copies + near + repeated + leaks + odd
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, text_hash string")
    docs.repartition(3).write.parquet(f"{sf}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, passage


def test_pipeline_stages(spark, corpus):
    sf, passage = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs = docs.cache()
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = set(range(120))
    assert not [i for i in kept["toxicity"] if i and 1000 <= i < 1200]
    after = kept["simhash_near_dedup"]
    assert clean <= set(after) and not [i for i in after if i and 2000 <= i < 2200] and len({5000, 5001} & set(after)) == 1
    after = kept["suffix_array_dedup"]
    assert all(passage not in after[3000 + k] and len(after[3000 + k]) > 200 for k in range(6))
    assert all(after[i] == kept["simhash_near_dedup"][i] for i in clean)
    after = kept["benchmark_decontamination"]
    assert clean <= set(after) and not [i for i in after if i and 4000 <= i < 4100] and None in after
    assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    bins = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted((i for b in bins for i in b["doc_ids"]), key=str) == sorted(after, key=str)


def test_repeated_passages_of_short_words(spark):
    r = random.Random(2)
    fill = lambda n: " ".join("".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    short, few = " ".join(r.choices("abcdefghij", k=51)), " ".join(["long" + x for x in r.sample("abcdefghijklmnopqrst", 20)])
    rows = [(k, f"{fill(40)} {passage} {fill(40)}") for k, passage in enumerate([short, short, few, few])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.cut_repeated_passages(spark, docs, "").collect()}
    assert short not in got[0] and short not in got[1] and len(got[0]) < len(rows[0][1]) - 95
    assert (got[2], got[3]) == (rows[2][1], rows[3][1])  # over 96 bytes, but under 240 and 20 words only


def test_run_is_the_stages_in_order(spark, corpus):
    sf, _ = corpus
    got = corpus_pipeline.run(spark, sf)
    ids = [i for b in got.collect() for i in b["doc_ids"]]
    assert set(range(120)) <= set(ids) and not [i for i in ids if i and (1000 <= i < 2200 or i >= 4000 and i < 5000)]


def test_empty_tables(spark, corpus, tmp_path):
    sf, _ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
