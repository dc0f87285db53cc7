"""Token operators against the libraries themselves."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from strandline.llm import bpe_stream, packing, queries, rans_files, token_counts, tokens

BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PARTS = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "a", "The", "'s", "'LL", "1", "²", "Σ", "İ", "é", "é", "<|endoftext|>", "<|startoftext|>", ".", "!!", "日本", "　", "😀", "ﬁ", "</w>", "\0", "▁", "<s>", "<0x0A>", "\r\n", "ß", "hello World", "ĳ"]


def mixed(n, seed=1, longest=14):
    pick = random.Random(seed)
    return ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, longest))) for _ in range(n)]


def packed(path, texts, kind="I"):
    return [array(kind, x.ids).tobytes() for x in tokens.library(path).encode_batch(texts, add_special_tokens=False)]


PLAIN = [" ", " ", "  ", "\n", " \r\n", "the", "The", "ation", "ción", "übe", "'s", "'LL", "1", "23", "²", "é", "—", "’", "“", ".", ",", "!!", "ª", "aaaa", "###"]


@pytest.mark.parametrize("by_rank", [False, True])
@pytest.mark.parametrize(("path", "joins", "kind"), [(BYTE, True, "I"), (WORD, False, "H")])
def test_encoder_equals_library(path, joins, kind, by_rank):
    pick = random.Random(6)
    texts = mixed(4000) + ["".join(pick.choice(PLAIN) for _ in range(pick.randint(0, 20))) for _ in range(6000)] + ["".join(pick.choice("etaoinshrdlu") for _ in range(700))]
    encoder = tokens.TextEncoder(path, joins, kind, by_rank)
    encoder.rest.cap = 300  # generations change
    assert encoder.packed(texts) == packed(path, texts, kind)


def test_ranks_decide():
    assert tokens.ranks_decide(BYTE) and tokens.ranks_decide(WORD)


def test_parts_of_long_texts_join():
    for text in mixed(500, 8, 200) + ["word " * 400, "x" * 900, " " * 900, ""]:
        parts = list(tokens.parts_of(text, 50))
        assert "".join(parts) == text
        assert b"".join(packed(BYTE, parts)) == packed(BYTE, [text])[0]


def test_token_counts_equal_library():
    texts = mixed(4000, 2)
    counter = token_counts.Counter(PIECE, cap=500)
    found = [n for k in range(0, len(texts), 100) for n in counter.counts(texts[k : k + 100])]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert found == [len(x) for x in model.encode(texts)]
    assert len(counter.whole) > 10_000 and all(len(model.encode(x)) == 1 for x in list(counter.whole)[:500])


@pytest.fixture(scope="module")
def streaming():
    return bpe_stream.Encoder(BYTE)


def test_transducer_equals_library(streaming):
    pick = random.Random(3)
    texts = mixed(2000, 3) + ["a" * 3000, "ab" * 2000, " " * 1500, "=" * 2000, "".join(pick.choice("etaoin") for _ in range(8000)), "ÃÂ" * 900]
    assert streaming.packed(texts) == packed(BYTE, texts)
    for text, ids in zip(texts, streaming.packed(texts), strict=True):
        assert bpe_stream.decoded(array("I", ids), streaming.v) == text


def test_transducer_holds_a_bounded_buffer(streaming):
    machine, most, out = bpe_stream.Transducer(streaming.v), 0, []
    text = "".join(random.Random(4).choice("etaoinshr") for _ in range(30_000)).encode()
    for at in range(0, len(text), 100):
        out += machine.feed(text[at : at + 100])
        most = max(most, len(machine.buffer))
    assert most <= streaming.v.lookahead + 2 * streaming.v.window + 100
    assert array("I", out + machine.finish()).tobytes() == packed(BYTE, [text.decode()])[0]


def test_decoder_replaces_broken_bytes(streaming):
    ids = [streaming.v.single[b] for b in b"a\xf0\x9f\x98b\xff"]
    assert bpe_stream.decoded(ids, streaming.v, block=1) == tokens.library(BYTE).decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("n", [0, 1, 5, 511, 512, 513, 70_000, 140_000])
def test_rans_round_trip(n):
    ids = np.minimum((np.random.default_rng(n).pareto(0.9, n) * 3).astype(np.int64), 49_407)
    coder = rans_files.Coder(rans_files.quantized(np.bincount(ids, minlength=2)), lanes=64)
    block = coder.encode(ids)
    assert (coder.decode(block) == ids).all()
    assert [x for k in range(coder.parts(block)) for x in coder.decode(block, k)] == ids.tolist()
    if n > 5:
        broken = bytearray(block)
        broken[-3] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            coder.decode(bytes(broken))


ROWS = [(5, "one two  three", "x"), (2, None, "y"), (9, "", None), (1, "word " * 3000, "z"), (1, "word " * 3000, "z"), (None, "no id\n\n", "z"), (7, "é" * 5000, "q")]
SCHEMA = "doc_id long, text string, ids string"  # a clashing name


def test_packing(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    out = packing.pack(docs, BYTE, length=64, windows=2, fan_in=2).toPandas()
    want = {}
    for (doc_id, text, _), ids in zip(ROWS, packed(BYTE, [x[1] or "" for x in ROWS]), strict=True):
        want.setdefault(doc_id, []).append(ids + array("I", [0]).tobytes())
    got = {}
    for row in out.sort_values(["start"]).itertuples():
        got.setdefault(None if np.isnan(row.doc_id) else int(row.doc_id), []).append((row.start, row.ids, row.doc_tokens))
    assert got.keys() == want.keys()
    for doc_id, pieces in got.items():
        copies = len(want[doc_id])
        assert sum(len(x[1]) for x in pieces) == copies * len(want[doc_id][0])
        assert all(want[doc_id][0][4 * s : 4 * s + len(ids)] == ids and 4 * n == len(want[doc_id][0]) for s, ids, n in pieces)
    for _, group in out.sort_values("offset").groupby("sequence_id"):
        assert group["offset"].tolist() == [0, *group["length"].cumsum().tolist()[:-1]]
    sizes = out.groupby("sequence_id")["length"].sum()
    assert sizes.max() <= 64 and all(x == 64 or x & (x - 1) == 0 for x in sizes)
    assert packing.pack(docs.limit(0), BYTE).count() == 0


def test_counts_and_coding_of_edge_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    counts = sorted(map(tuple, token_counts.token_counts(docs, PIECE).collect()), key=str)
    assert counts == sorted(((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t, _ in ROWS), key=str)
    coded = sorted(((x["doc_id"], x["n_tokens"], bytes(x["ids"]), x["decoded"]) for x in bpe_stream.encode(docs, BYTE).collect()), key=str)
    assert coded == sorted(((i, len(p) // 4, p, t or "") for (i, t, _), p in zip(ROWS, packed(BYTE, [x[1] or "" for x in ROWS]), strict=True)), key=str)
    assert token_counts.token_counts(docs.limit(0), PIECE).count() == bpe_stream.encode(docs.limit(0), BYTE).count() == 0


def test_token_files(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    folder = rans_files.write_token_files(docs, WORD, end_id=1, block_ids=500)
    rows = sorted(rans_files.read_token_files(spark, folder).collect(), key=lambda x: x["start"])
    order = sorted(zip(ROWS, packed(WORD, [x[1] or "" for x in ROWS]), strict=True), key=lambda x: (x[0][0] is not None, x[0][0] or 0))
    at = 0
    for row, ((doc_id, _, _), ids) in zip(rows, order, strict=True):
        ids += array("I", [1]).tobytes()
        assert (row["doc_id"], row["start"], row["n_tokens"], bytes(row["ids"])) == (doc_id, at, len(ids) // 4, ids)
        at += len(ids) // 4
    empty = rans_files.write_token_files(docs.limit(0), WORD)
    assert rans_files.read_token_files(spark, empty).count() == 0


def test_queries(spark, documents, sf_dir):
    ids = dict(zip(documents["doc_id"], packed(BYTE, documents["text"].fillna("").tolist()), strict=True))
    for row in queries.op3_bpe_stream(spark, sf_dir).collect():
        assert row["ids_sha256"] == hashlib.sha256(ids[row["doc_id"]]).hexdigest()
    pieces = queries.op1_packing(spark, sf_dir).agg(F.sum("length"), F.countDistinct("doc_id")).head()
    assert tuple(pieces) == (sum(len(x) // 4 + 1 for x in ids.values()), len(ids))
    word = dict(zip(documents["doc_id"], packed(WORD, documents["text"].fillna("").tolist()), strict=True))
    for row in queries.op6_rans_files(spark, sf_dir).collect():
        assert row["ids_crc32"] == zlib.crc32(word[row["doc_id"]] + array("I", [1]).tobytes())
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    counts = {x["doc_id"]: (x["n_tokens"], x["over_limit"]) for x in queries.op2_token_counts(spark, sf_dir).collect()}
    assert all(counts[i] == (n := len(model.encode(t or "")), n > 4096) for i, t in zip(documents["doc_id"], documents["text"], strict=True))
