import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vacantia.llm import tokenbin as t
from vacantia.llm.words import buffers

public = pytest.importorskip("public_tokenizers")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.integers(65000, 66000), max_size=60))
def test_round_trip(ids):
    control, data = t.encode(np.array(ids, np.uint32))
    assert t.decode(control, data, len(ids)).tolist() == ids
    assert len(control) == -(-len(ids) // 4)


def want(rows, tok):
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((d, start, len(ids), t.crc32_of(ids)))
        start += len(ids)
    return out


def got(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


ENCODERS = {}


@pytest.fixture(params=[1 << 20, 8], ids=["roomy", "full"])
def encoder(request, monkeypatch):
    """One with room for all pieces, one that is full at once."""
    monkeypatch.setattr(t.PieceTable, "MOST", request.param)
    if request.param not in ENCODERS:
        ENCODERS[request.param] = t.PieceEncoder(public.path("byte_bpe_50k.json"))
    return ENCODERS[request.param]


@settings(max_examples=400, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("ab1 .,!(-\t\n\r\x00\x0b\x1c\xa0\u2003éÀ×÷ÿ“—'stßñ日<|endoftext|>"), max_size=30) | st.lists(st.sampled_from(["<|endoftext|>", " it's", "'ll", "Don't.", "--", " ab", "é,", "a" * 20, " " * 17, "x\n\ny"]), max_size=9).map("".join) | st.text(max_size=20), max_size=5))
def test_pieces_are_whole_texts(tok, encoder, texts):
    texts = [x.encode("utf-8", "ignore").decode() for x in texts]
    data, offsets = buffers(pa.array(texts, pa.string()))
    ids, n = encoder.encode(data, offsets)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])][: len(texts)] == [tok.encode(x, add_special_tokens=False).ids for x in texts]


def test_special_strings_are_the_librarys(tok, encoder):
    data, offsets = buffers(pa.array(["a <|endoftext|> b", "a b"], pa.string()))
    assert 50256 in encoder.encode(data, offsets)[0]


def test_table(spark, tok):
    d = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pandas()
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(t.token_table_report(df, public.path("byte_bpe_50k.json"))) == want(list(zip(d.doc_id.tolist(), d.text, strict=True)), tok)


def test_edges(spark, tok):
    rows = [(5, None), (3, ""), (3, "b"), (3, "a"), (9, "x y " * 400_000), (-4, "<|endoftext|> é"), (None, "n"), (7, "same"), (7, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as part", "3 as n")
    assert got(t.token_table_report(df, public.path("byte_bpe_50k.json"))) == want(rows, tok)
    assert t.token_table_report(df.limit(0), public.path("byte_bpe_50k.json")).count() == 0
