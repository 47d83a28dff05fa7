import re

import pytest
import xxhash

from vicinage.llm import queries, simhash_dedup

SMALL = "/root/testdata/sf0.001"


def brute_print(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    """{id: smallest id reachable}, prints: {id: fingerprint}."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    prints = {r.doc_id: brute_print(r.text) for r in rows}
    want = brute_classes(prints)
    got = queries.QUERIES["op9_simhash_dedup"](spark, SMALL).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {
        i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_odd_rows(docs_of):
    rows = [(1, None), (2, ""), (3, " \t "), (4, "One two"), (5, "one TWO"), (5, "one TWO"), (6, "Ä b c d" * 3000),
            (None, "x y z w"), (7, "x y z w"), (8, "a b c é")]
    got = {(r.id, r.fp % 2**64, r.component) for r in simhash_dedup.classes(docs_of(rows)).collect()}
    assert {(1, 0, 1), (2, 0, 1), (3, 0, 1), (7, brute_print("x y z w"), 7)} <= got
    assert {r[2] for r in got if r[0] in (4, 5)} == {4}
    kept = [r.doc_id for r in simhash_dedup.keep_one(docs_of(rows)).collect()]
    assert sorted(kept, key=str) == sorted([1, 4, 6, None, 8], key=str)
    assert simhash_dedup.classes(docs_of([])).count() == 0


def test_keep_one_tells_rows_of_one_id_apart(docs_of):
    import random
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(40)) for _ in range(24)]
    rows = [(None, t) for t in texts[:12]] + [(5, t) for t in texts[12:20]] + [(None, texts[0]), (5, texts[12]), (6, texts[1]), (7, texts[13])]
    rows += [(8 + k, t) for k, t in enumerate(texts[20:])]
    kept = [(r.doc_id, r.text) for r in simhash_dedup.keep_one(docs_of(rows)).collect()]
    want = [(None, t) for t in texts[:12]] + [(5, t) for t in texts[12:20]] + [(8 + k, t) for k, t in enumerate(texts[20:])]
    assert sorted(kept, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("segments", [8, 16])
def test_links_are_complete(spark, segments):
    import random
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)] + [0, 2**64 - 1]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (0, 1, 2, 3) for _ in range(4)}
    signed = [(p - 2**64 if p >> 63 else p,) for p in prints]
    got = {frozenset((r.fp_a % 2**64, r.fp_b % 2**64))
           for r in simhash_dedup.links(spark.createDataFrame(signed, "fp long"), segments=segments).collect()}
    want = {frozenset((p, q)) for p in prints for q in prints if p < q and bin(p ^ q).count("1") <= 2}
    assert got == want


def test_ids_link_nothing(docs_of):
    """Rows of one id or of null ids stay apart; components are those of the fingerprints, named by their smallest id."""
    import random
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(30)) for _ in range(300)]
    rows = [(None, t) for t in texts[:100]] + [(7, t) for t in texts[100:200]] + [(None, texts[0]), (5, texts[0]), (9, texts[1]), (8, texts[100]), (6, texts[150])]
    rows += [(100 + k, t) for k, t in enumerate(texts[200:])]
    prints = [brute_print(t) for _, t in rows]
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and of[i] != of[j]:
                of = [of[j] if c == of[i] else c for c in of]
    least = {c: min((rows[k][0] for k in range(len(rows)) if of[k] == c and rows[k][0] is not None), default=None) for c in of}
    want = sorted(((r[0], p, least[c]) for r, p, c in zip(rows, prints, of)), key=str)
    got = sorted(((r.id, r.fp % 2**64, r.component) for r in simhash_dedup.classes(docs_of(rows)).collect()), key=str)
    assert got == want and {None, 5, 9, 6, 7} <= set(least.values())
