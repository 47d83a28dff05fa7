"""Token alignment against whole-text encodings and a plain walk over byte ends."""

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vicinage.llm import common, queries, token_alignment

SMALL = "/root/testdata/sf0.001"
A, B = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")
BACK = {c: b for b, c in common.byte_symbols().items()}


def brute_groups(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    out = []
    for text in texts:
        if not text:
            out.append([])
            continue
        left = a.encode(" " + text, add_special_tokens=False).ids
        right = b.encode(text)
        spell_a = [bytes(BACK[c] for c in a.id_to_token(i)) for i in left]
        spell_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in right)]
        whole = (" " + text).encode()
        if b"".join(spell_a) != whole or b"".join(spell_b) != whole:
            out.append([])
            continue
        end_a, end_b = np.cumsum([len(x) for x in spell_a]).tolist(), np.cumsum([len(x) for x in spell_b]).tolist()
        both, groups, i, j = set(end_a) & set(end_b), [], 0, 0
        for end in sorted(both):
            k, m = end_a.index(end, i) + 1, end_b.index(end, j) + 1
            groups.append((left[i:k], right[j:m]))
            i, j = k, m
        out.append(groups)
    return out


def brute_rows(texts):
    docs = brute_groups(texts)
    count = defaultdict(int)
    for groups in docs:
        for pair in {(x, y) for g in groups for x in g[0] for y in g[1]}:
            count[pair] += 1
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for groups in docs:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        spelt = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[p] == most[p[0]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(spelt.encode()).hexdigest() if groups else ""))
    return out


def values(r):
    return r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]


def test_alignment_query(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in rows], brute_rows([r.text for r in rows])))
    assert {r["doc_id"]: values(r) for r in queries.QUERIES["op11_token_alignment"](spark, SMALL).collect()} == want


ODD = [None, "", " ", "  ", "a", "a ", " a", "a  b", "a\n b", "a \n b ", "tab\t\tx  \n", "<|endoftext|> <s> </s> <unk> <0x41>", "under▁score", "é ü 中文 \U0001f600\U0001f600",
       "\x00\x01 \x1c x", "   thin  space", "é ́x", "a" * 3000, "don't 'll it'S 1234567 ½²", "= == === ==== " * 30, "\r\n\r\n x\x85 y", "word " * 5000]


@pytest.mark.parametrize("unit", [4, 1 << 16])
def test_alignment_odd_rows(monkeypatch, unit):
    words = token_alignment.Encoders(open(A, encoding="utf-8").read(), open(B, "rb").read())
    tables = [np.array([f"{i}{end}" for i in range(len(s)) for end in ",|;"], dtype=object) for s in (words.a_bytes, words.b_bytes)]
    monkeypatch.setattr(token_alignment, "UNIT_CHARS", unit)
    monkeypatch.setattr(token_alignment, "PRODUCT", 100)
    for text, groups in zip(ODD, brute_groups(ODD)):
        row = token_alignment._aligned(words, [text or ""], tables, True)[0]
        spelt = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert row[5] == spelt, text
        pairs = defaultdict(int)
        for x, y in ((x, y) for g in groups for x in g[0] for y in g[1]):
            pairs[x << 24 | y] += 1
        assert dict(zip(np.frombuffer(row[6], dtype="<i8").tolist(), np.frombuffer(row[7], dtype="<i8").tolist())) == pairs, text


def test_statistics_of_odd_rows(docs_of):
    docs = [*enumerate(ODD), (None, "a  b"), (None, "a  b"), (3, "a  b")]
    want = sorted(zip([str(i) for i, _ in docs], brute_rows([t for _, t in docs])))
    for chunk in (1, 1 << 20):
        found = token_alignment.link_statistics(docs_of(docs), A, B, chunk_chars=chunk).collect()
        assert sorted((str(r["doc_id"]), values(r)) for r in found) == want
    assert token_alignment.link_statistics(docs_of([]), A, B).collect() == []


def test_overlaps_are_all_shared_bytes():
    rng = np.random.default_rng(4)
    for _ in range(20):
        frames = []
        sizes = rng.integers(1, 40, 5)
        for _ in range(2):
            ends = np.concatenate([np.cumsum(sizes)[u] - sizes[u] + np.unique(np.append(rng.integers(1, sizes[u] + 1, 6), sizes[u])) for u in range(5)])
            frames.append(pd.DataFrame({"unit": np.searchsorted(np.cumsum(sizes), ends), "start": np.append(0, ends[:-1]), "end": ends, "at": np.arange(len(ends))}))
        a, b = frames
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(a.start[i], b.start[j]) < min(a.end[i], b.end[j])]
        assert list(zip(*(x.tolist() for x in token_alignment.overlaps(a, b)))) == want
