import collections

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard import brute as components
from vacantia.llm import mixing, toxicity

SF = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")


def test_run_against_brute_force(spark):
    from tests.llm.test_tokenbin import want
    from tokenizers import Tokenizer

    import public_tokenizers

    source = spark.read.parquet(f"{SF}/documents.parquet")
    d = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    toxic = {r.doc_id for r in toxicity.scores(source, toxicity.fit(source, spark.read.parquet(f"{SF}/labels.parquet"))).where("score >= 0.7").collect()}
    docs = [(i, t) for i, t in zip(d.doc_id.tolist(), d.text, strict=True) if i not in toxic]
    docs = [(i, t) for (i, t), (j, _, c) in zip(docs, components(docs, 5, 80), strict=True) if j == c and i == j]
    bench = pq.read_table(f"{SF}/benchmark.parquet").to_pandas()
    bad = contaminated(docs, list(zip(bench.item_id, bench.text, strict=True)))
    docs = [(i, t) for i, t in docs if not bad[i][4]]
    copies = {r["id"]: r.copies for r in mixing.mix(source.where(source.doc_id.isin([i for i, _ in docs]))).collect()}
    mixed = [(i, t) for i, t in docs for _ in range(copies[i])]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    assert got == want(mixed, tok) and len(docs) < len(d)


def test_stages_keep_columns_and_bear_edges(spark):
    rows = [(1, "a b c d", "en", "s", 4), (1, "a b c d", "en", "s", 4), (2, None, None, None, None), (None, "", "en", "s", 0), (None, "x y z", "de", "t", 3), (3, "a b c d", "en", None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    n = collections.Counter()
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, SF)
            assert df.columns == docs.columns
            n[name] += df.count()
        corpus_pipeline.STAGES[-1][1](spark, df, SF).count()
    assert n["toxicity"] == 6 and n["ngram_jaccard"] == 4


def test_texts_that_share_an_id_are_judged_one_by_one(spark):
    one, two, three = "a b c d e f g h", "k l m n o p q r", "s t u v w x y z"
    long = [f"w{i}" for i in range(200)]
    near = [" ".join(long), " ".join([*long[:-1], "other"])]
    apart = [w if k % 50 else "changed" for k, w in enumerate(long)]  # 4 of 200 words: 0.81
    alone = "q w e r t y u"
    rows = [(1, one), (1, two), (1, one), (2, two), (5, one), (5, three), (6, near[0]), (6, near[1]), (6, " ".join(apart)), (7, None), (7, ""), (None, one), (None, alone), (None, alone)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, text_hash int, text_key int")
    out = corpus_pipeline.one_of_each_group(spark, docs, SF)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert collections.Counter(x for x in got if x[0] != 6) == collections.Counter([(1, one), (1, two), (5, three), (7, None), (7, ""), (None, alone)])
    assert len([x for x in got if x[0] == 6]) == 1


def test_rows_of_one_id_and_text_leave_the_same_one(spark):
    rows = [(1, "a b c d e f g h", "en", s, 1) for s in ("s", "t", None, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert len({corpus_pipeline.one_of_each_group(spark, docs.orderBy(F.expr(o)).repartition(3), SF).first() for o in ("source", "source desc")}) == 1


def test_long_texts_pass_through(spark):
    rows = [(1, "word " * 300_000, "en", "s", 1), (2, "x" * 2_000_000, "en", "s", 1), (3, "short text", "en", "t", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, SF)
    assert corpus_pipeline.STAGES[-1][1](spark, df, SF).agg({"n_tokens": "sum"}).first()[0] > 0


def test_texts_are_shuffled_once_to_the_ones_that_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = corpus_pipeline.one_of_each_group(spark, docs, SF)._jdf.queryExecution().executedPlan().toString().split("\n")
    grouped = next(k for k, x in enumerate(plan) if "min_by" in x)
    joined = next(k for k, x in enumerate(plan) if "SortMergeJoin" in x or "HashJoin" in x)
    assert not [x for x in plan[grouped:joined] if "Exchange" in x]
