import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sparkloom.llm import token_alignment as m

ODD = [None, "", " ", "   ", "  two  spaces ", "▁ x", "\n\n a\tb　c\r\n", "😀é́ ｶﾞ ① ﬁ", "<s> </s> <unk> <0x41>", "<|endoftext|> a<|endoftext|>", "\x00a\x01", "a" * 4000, "123 4567", "word " * 3000, "​z﻿", "don't we'll", "x\x85y\x1cz"]


def letters():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def plain(rows):
    """The contract, with the libraries' own tokens and sets of byte ranges."""
    a_tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    of = letters()
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        a_bytes = [bytes(of[c] for c in a_tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            docs.append((doc_id, [], [], [], []))
            continue

        def ranges(tokens):
            at, out = 0, []
            for t in tokens:
                out.append((at, at + len(t)))
                at += len(t)
            return out

        ra, rb = ranges(a_bytes), ranges(b_bytes)
        shared = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, i, j = [], 0, 0
        for end in shared:
            ga, gb = [], []
            while i < len(ra) and ra[i][1] <= end:
                ga.append(a[i])
                i += 1
            while j < len(rb) and rb[j][1] <= end:
                gb.append(b[j])
                j += 1
            groups.append((ga, gb))
        owner = defaultdict(list)  # byte -> its tokens of B
        for k, (s, e) in enumerate(rb):
            for x in range(s, e):
                owner[x].append(k)
        links = [(a[k], b[o]) for k, (s, e) in enumerate(ra) for o in sorted({o for x in range(s, e) for o in owner[x]})]
        counts.update(links)
        docs.append((doc_id, a, b, groups, links))
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for doc_id, a, b, groups, links in docs:
        listing = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        digest = hashlib.sha256(listing.encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


@pytest.fixture(scope="module")
def rows(sf_dir):
    got = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [(r["doc_id"], r["text"]) for r in got] + [(None if i == 2 else 10_000 + i, t) for i, t in enumerate(ODD)] + [(10_003, "  two  spaces ")] * 2


@pytest.mark.parametrize("frequent", [m.FREQUENT, 50])
def test_as_the_libraries(spark, rows, monkeypatch, frequent):
    monkeypatch.setattr(m, "FREQUENT", frequent)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, `row` string").repartition(5)
    got = m.alignment(df)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(rows), key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert m.alignment(df).collect() == [] and m.align(df).collect() == []


def test_groups_cover_the_text(spark):
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(ODD)], "doc_id int, text string, a_ids string")
    for r in m.align(df).collect():
        text = ODD[r["doc_id"]]
        if not text or "▁" in text:
            assert r["a_ids"] == r["b_ids"] == r["group_ends"] == []
            continue
        assert sum(r["group_a"]) == len(r["a_ids"]) and sum(r["group_b"]) == len(r["b_ids"])
        assert r["group_ends"] == sorted(set(r["group_ends"])) and r["group_ends"][-1] == len(text.encode())


def test_span_cache_starts_anew():
    counts = m.SpanCounts(most=2)
    spans = [b"\x03", b"\x00\x01\x03", b"\x02\x02\x03", b"\x03", b"\x00" * 99 + b"\x03"]
    assert [(c >> 32, c & 0xFFFFFFFF) for c in map(counts.__getitem__, spans)] == [(1, 1), (2, 1), (1, 3), (1, 1), (1, 1)]
    assert len(counts) == 2
