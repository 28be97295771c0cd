"""Operators 11 to 13 against plain versions that take whole texts through the libraries."""

import hashlib
import itertools
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelake.llm import crosstok, fim, queries, token_counts
from sievelake.llm._tokens import Source, tiles

public_tokenizers = pytest.importorskip("public_tokenizers")
DIR = "/root/testdata/sf0.001"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
rng = random.Random(5)
ODD = [
    None, "", " ", "   ", "a", "a ", " a", "a  b\t c \n\n d", "x  y  z　 w", "x▁y ▁", "<|endoftext|> <s> </s> <unk> <0x0A>", "café über straße", "é å",
    "你好 世界", "\U0001f600 \U0001f600\U0001f600", "it's they'll 'twas ’s", "a\x00b \x01", "﻿bom ​ zero", "\r\n \r\n", "0123456789 3.14 1,000", "word " * 300, "\n" * 50, " " * 70, "ﬁ Å ẛ̣", "a\u0085 b  c  d  e",
]


def noise(n):
    return "".join(rng.choices(["a", "e", "the", " ", " ", "  ", "\n", "\t", " ", "é", "Ж", "世", "'s", "1", "-", "▁", "\U0001f600", "\x85", "<P>"], k=n))


TEXTS = ODD + [noise(rng.randrange(1, 60)) for _ in range(150)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "extra") for k, t in enumerate(TEXTS)] + [(3, "   ", "again"), (None, "no id", "x"), (7, "other text of one id", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


def test_tiles_begin_at_spaces():
    data = np.frombuffer(" a b  c\n dé e".encode(), dtype=np.uint8)
    assert [bytes(x) for x in np.split(data, tiles(data, np.array([0, len(data)])))[1:]] == [b" a", b" b", b"  c\n d\xc3\xa9", b" e"]


@pytest.mark.parametrize("path", [BYTES, PIECES])
def test_pieces_spell_the_tokens_of_whole_texts(path):
    source = Source(path, plain=True)
    model = source.load()
    for t in TEXTS:
        if not t:
            continue
        spaced = (" " + t).encode()
        cuts = [*tiles(np.frombuffer(spaced, dtype=np.uint8), np.array([0, len(spaced)])).tolist(), len(spaced)]
        got = [y for x in model.of_pieces([spaced[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]) for y in x]
        assert got == model.encode([t if source.kind == "model" else " " + t])[0], repr(t)


def plain_alignment(rows):
    """The contract, text by text and byte by byte."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_model.encode_special_tokens = True
    visible = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    rest = [b for b in range(256) if b not in visible]
    byte_of = {c: b for b, c in (visible | {b: chr(256 + k) for k, b in enumerate(rest)}).items()}
    documents, holds = [], defaultdict(set)
    for k, (i, t) in enumerate(rows):
        spaced = (" " + (t or "")).encode()
        a = a_model.encode(spaced.decode(), add_special_tokens=False).ids if t else []
        b = b_model.encode(t) if t else []
        a_bytes = [bytes(byte_of[c] for c in a_model.id_to_token(x)) for x in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [b_model.id_to_piece(x)]]
        if not t or b"".join(a_bytes) != spaced or b"".join(b_bytes) != spaced:
            documents.append((i, [], [], [], []))
            continue
        end_a, end_b = (list(itertools.accumulate(map(len, own))) for own in (a_bytes, b_bytes))
        cuts = sorted(set(end_a) & set(end_b))
        groups, links, p, q = [], [], 0, 0
        for c in cuts:
            p2, q2 = end_a.index(c, p) + 1, end_b.index(c, q) + 1
            groups.append(",".join(map(str, a[p:p2])) + "|" + ",".join(map(str, b[q:q2])))
            span = lambda end, own, j: (end[j] - len(own[j]), end[j])
            for x in range(p, p2):
                for y in range(q, q2):
                    (s, e), (u, v) = span(end_a, a_bytes, x), span(end_b, b_bytes, y)
                    if s < v and u < e:
                        links.append((a[x], b[y]))
            p, q = p2, q2
        documents.append((i, a, b, groups, links))
        for p in links:
            holds[p].add(k)
    most = defaultdict(int)
    for (x, _), d in holds.items():
        most[x] = max(most[x], len(d))
    out = []
    for i, a, b, groups, links in documents:
        best = sum(len(holds[p]) == most[p[0]] for p in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, len(a), len(b), len(groups), len(links), best, sum(len(holds[p]) for p in links), digest))
    return out


def test_alignment_of_odd_texts(odd):
    expected = plain_alignment([(r["doc_id"], r["text"]) for r in odd.collect()])
    got = crosstok.align(odd, Source(BYTES, plain=True), Source(PIECES))
    assert Counter(map(tuple, got.collect())) == Counter(expected)
    assert sum(x[4] > x[3] for x in expected) > 50 and sum(not x[1] for x in expected) > 3


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_op11_on_the_smallest_tables(spark):
    rows = duckdb.sql(f"select doc_id, text from '{DIR}/documents.parquet'").fetchall()
    got = queries.queries()["op11_group_dictionary"](spark, DIR).collect()
    assert {r["doc_id"]: tuple(r) for r in got} == {x[0]: x for x in plain_alignment(rows)}


def test_alignment_of_nothing(spark, odd):
    assert crosstok.align(odd.limit(0), Source(BYTES, plain=True), Source(PIECES)).count() == 0
    one = crosstok.align(odd.where("doc_id < 2"), Source(BYTES, plain=True), Source(PIECES)).collect()
    assert sorted(map(tuple, one)) == [(0, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, "")]


def test_alignment_needs_a_second_model_that_can_be_cut():
    with pytest.raises(ValueError):
        crosstok.Aligner(Source(BYTES), Source(BYTES))


def plain_fim(i, t):
    t = t or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return i, n, "plain", None, None, t
    if h4 % 100 < 50:
        return i, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return i, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark, odd):
    many = [(1000 + k, "".join(rng.choices(["ab", "\n", "é", "\U0001f600", "<", "<P", "S>", "<M", ">", " ", "\n\n"], k=rng.randrange(0, 40))), "x") for k in range(400)]
    docs = odd.union(spark.createDataFrame(many + [(5000, "line\n" * 400_000, "long")], odd.schema))
    cut = fim.fill_in_middle(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(map(tuple, cut.collect())) == Counter(plain_fim(*r) for r in rows)
    restored = fim.restore(cut).select("doc_id", "restored").collect()
    assert Counter(map(tuple, restored)) == Counter((i, t or "") for i, t in rows)
    assert {r["form"] for r in cut.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_shares_and_other_marks(spark, odd):
    layout = fim.Layout("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>", cut_percent=40, spm_percent=0)
    cut = fim.fill_in_middle(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a\nb\n\nc").alias("text")), layout=layout)
    forms = Counter(r["form"] for r in cut.collect())
    assert set(forms) == {"plain", "psm"} and 130 < forms["psm"] < 270
    assert fim.restore(cut, layout).where("restored <> 'a\nb\n\nc'").count() == 0


def test_one_gather_of_ranges():
    data = np.frombuffer(b"abcdef", dtype=np.uint8)
    out, ends = fim.gathered(data, np.array([[0, 4], [2, 0]]), np.array([[1, 2], [0, 3]]))
    assert out.tobytes() == b"aefabc" and ends.tolist() == [0, 3, 6]
    assert fim.gathered(data, np.zeros((0, 6), dtype=np.int64), np.zeros((0, 6), dtype=np.int64))[1].tolist() == [0]


def test_token_counts_use_their_cache(spark, odd, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    source, cache = Source(PIECES), str(tmp_path / "counts")
    plain = lambda df: Counter((r["doc_id"], len((r["text"] or "").encode()), len(model.encode(r["text"] or ""))) for r in df.collect())
    few = odd.where("doc_id < 60 or doc_id is null")
    assert Counter(map(tuple, token_counts.count_tokens(few, source, cache).collect())) == plain(few)
    kept = token_counts.stored(spark, cache, source.version())
    n = kept.count()
    assert n == kept.select("digest").distinct().count() == len({r["text"] or "" for r in few.collect()})
    assert Counter(map(tuple, token_counts.count_tokens(odd, source, cache).collect())) == plain(odd)
    grown = token_counts.stored(spark, cache, source.version())
    assert grown.count() == grown.select("digest").distinct().count() == len({r["text"] or "" for r in odd.collect()}) > n
    files = sorted(os.listdir(f"{cache}/{source.version()}"))
    token_counts.count_tokens(odd, source, cache).collect()
    assert sorted(os.listdir(f"{cache}/{source.version()}")) == files  # no misses, nothing appended
    # what is stored is what is read, and an equal row by another run changes nothing
    token_counts.stored(spark, cache, source.version()).limit(5).write.mode("append").parquet(f"{cache}/{source.version()}")
    assert Counter(map(tuple, token_counts.count_tokens(odd, source, cache).collect())) == plain(odd)
    assert token_counts.count_tokens(odd.limit(0), source, str(tmp_path / "none")).count() == 0


def test_versions_keep_apart(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BYTES)
    source, cache = Source(BYTES), str(tmp_path / "counts")
    assert len({source.version(), Source(BYTES, plain=True).version(), Source(PIECES).version()}) == 3
    token_counts.count_tokens(odd, Source(PIECES), cache).collect()
    got = token_counts.count_tokens(odd, source, cache).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((r["doc_id"], len(own.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_op13_on_the_smallest_tables(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = duckdb.sql(f"select doc_id, text from '{DIR}/documents.parquet'").fetchall()
    expected = {(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in rows}
    assert {tuple(r) for r in queries.queries()["op13_digest_cache"](spark, DIR).collect()} == expected


def test_arrow_lists_of_documents_are_sliced_right():
    values = pa.StructArray.from_arrays([pa.array([1, 2, 3])], ["x"])
    lists = pa.ListArray.from_arrays(pa.array([0, 1, 3], pa.int32()), values)
    assert lists[1].values.field("x").to_pylist() == [2, 3]
