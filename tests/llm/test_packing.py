"""Best-fit packing: ids against the tokenizer, places against packing one by one."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from vicinage.llm import packing, queries

SMALL = "/root/testdata/sf0.001"
FILE = queries.vocabulary("word_bpe_49k.json")


def one_by_one(lengths, size):
    """Free room per bin after best-fit decreasing, the plain way."""
    room = []
    for length in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= length]
        if fits:
            room[min(fits)[1]] -= length
        else:
            room.append(size - length)
    return sorted(room)


@pytest.mark.parametrize("seed", range(20))
def test_plan_equals_packing_one_by_one(seed):
    rng = random.Random(seed)
    size = rng.choice([1, 7, 32, 100])
    lengths = [min(size, int(rng.paretovariate(0.8))) for _ in range(rng.randint(0, 400))]
    counts, room, ranks = Counter(lengths), defaultdict(lambda: size), defaultdict(int)
    for run in sorted(packing.plan(counts, size)):
        assert run.rank == ranks[run.length] and run.items % run.per_bin == 0
        ranks[run.length] += run.items
        for i in range(run.items):
            room[run.bin + i // run.per_bin] -= run.length
    assert ranks == counts and sorted(room.values()) == one_by_one(lengths, size)


def test_plan_is_short():
    rng = random.Random(5)
    counts = {n: rng.randint(1, 10**9) for n in range(1, 2049)}
    assert len(packing.plan(counts)) <= 3 * 2048 * 11


def test_tightest_open_bin():
    rng, bins, held = random.Random(1), packing.OpenBins(50), Counter()
    for i in range(300):
        capacity = rng.randint(1, 50)
        bins.put(capacity, i, 1)
        held[capacity] += 1
        least = rng.randint(1, 50)
        fits = [c for c, n in held.items() if n and c >= least]
        assert bins.tightest(least) == min(fits, default=None)
        if fits and rng.random() < 0.7:
            bins.take(min(fits))
            held[min(fits)] -= 1


def check(rows, docs, size):
    """rows against (doc_id, text) rows of unique ids, or repeated ones with one text."""
    plain = Tokenizer.from_file(FILE)
    want = Counter()
    for i, text in docs:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), size)):
            own = np.array(ids[at:at + size], dtype="<u4")
            want[i, piece, at, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    assert sorted(size - sum(n for _, n in b) for b in bins.values()) == one_by_one([r["length"] for r in rows], size)


def test_packing_query(spark):
    rows = queries.QUERIES["op13_best_fit_packing"](spark, SMALL).withColumnRenamed("doc_id", "id").collect()
    check(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()], 2048)


def test_packing_odd_rows(docs_of):
    texts = [None, "", " ", "a  b\n\nc\t d ", "It's <|endoftext|> DON 'T", "é ́x İstanbul ΣΑΣ", "\x1c \x85 x", "x" * 5000, "word " * 3000, "中文 \U0001f600"]
    docs = [*enumerate(texts), (3, texts[3]), (None, "null id"), (None, "null id")]
    packed = packing.pack(docs_of(docs), FILE, size=64)
    rows = packed.collect()
    check(rows, docs, 64)
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], dtype="<u4") for r in packing.sequences(packed).collect()}
    for r in rows:
        assert zlib.crc32(whole[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert packing.pack(docs_of([]), FILE).collect() == []


def test_every_token_is_what_its_merges_make():
    """Then merging by the rank of what comes out is merging by the rank of the pair: no other pair that spells a token comes about."""
    import json

    model = json.loads(packing._content(FILE))["model"]
    rank = {tuple(m): i for i, m in enumerate(model["merges"])}
    for token in model["vocab"]:
        core, end = token.removesuffix("</w>"), token.endswith("</w>")
        parts = [*core[:-1], core[-1] + "</w>"] if end else [*core]
        while len(parts) > 1:
            best = min((rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 30:
                break
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert parts == [token]


def test_ids_equal_the_tokenizer():
    import pyarrow as pa

    words, plain = packing.WordIds(packing._content(FILE)), Tokenizer.from_file(FILE)
    rng = random.Random(8)
    parts = ["The", "ÉTÉ,", "été", "don't", "I'LL", "x's.", "ß!", "ÿ;", "a1b2", "12", "\n", "e\u0301", "É\u0301.", "×", "İ", "Σ", "...", "<|endoftext|>", "中文", "", "a\tb", "Öl?!", "\u212b", "naïve.", "_a_", "\x00", "a***", "b$$$.", "c_", "d'", "e\ue000f", "<|x", "a<|endoftext|>"]
    for _ in range(30):
        texts = [rng.choice([" ", " ", "", "  "]).join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(20)]
        found = words.of(pa.array([*texts, None]))
        assert [x.tolist() for x in np.split(found.flat, np.cumsum(found.sizes)[:-1])] == [e.ids for e in plain.encode_batch([*texts, ""], add_special_tokens=False)]
        sliced = words.of(pa.array([*texts, None]).slice(5, 7))
        assert sliced.sizes.tolist() == found.sizes[5:12].tolist()


def test_ids_of_all_words_of_a_table(spark):
    import pyarrow as pa

    words, plain = packing.WordIds(packing._content(FILE)), Tokenizer.from_file(FILE)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    found = words.of(pa.array(texts))
    assert [x.tolist() for x in np.split(found.flat, np.cumsum(found.sizes)[:-1])] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
