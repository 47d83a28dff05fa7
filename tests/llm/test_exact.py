"""Operators whose contract fixes every value, against brute force over whole small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from vicinage.llm import chat_format, embedding_dedup, queries, secret_scan, source_mix, substring_dedup, suffix_dedup

SMALL = "/root/testdata/sf0.001"
SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def read(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet").collect()


def sha(data):
    return hashlib.sha256(data).hexdigest()


def brute_bytes(texts, length):
    count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def brute_words(rows, length):
    """rows: (id, text bytes), unique ids; keyed by id."""
    first = {}
    split = {i: SPLIT.findall(t) for i, t in rows}
    for i in sorted(split):
        for p in range(len(split[i]) - length + 1):
            first.setdefault(tuple(split[i][p:p + length]), (i, p))
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if first[tuple(w[p:p + length])] < (i, p):
                gone[p:p + length] = [True] * length
        out[i] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def test_suffix_query(spark):
    rows = read(spark, "documents")
    want = dict(zip([r.doc_id for r in rows], brute_bytes([(r.text or "").encode() for r in rows], 400)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op2_suffix_dedup"](spark, SMALL).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 0


def test_substring_query(spark):
    want = brute_words([(r.doc_id, (r.text or "").encode()) for r in read(spark, "documents")], 20)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op10_substring_dedup"](spark, SMALL).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 0


def planted(seed, words):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    passage = [rng.choice(stock) for _ in range(words)]
    texts = []
    for k in range(24):
        own = [rng.choice(stock) for _ in range(rng.randint(0, 60))]
        if k % 3:
            cut = rng.randint(0, words // 2)
            shown = passage[cut:cut + rng.randint(words // 4, words)]
            if k % 2 and len(shown) > 4:
                shown[rng.randrange(len(shown))] = "EDIT"
            own[len(own) // 2:len(own) // 2] = shown
        texts.append(" ".join(own))
    return texts + ["a " * 300, "a " * 300, "", "ab" * 500, "x\ty\nz " * 90]


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_planted(docs_of, hot):
    texts = planted(5, 80)
    found = suffix_dedup.remove_repeats(docs_of(list(enumerate(texts))), length=60, head=20, batches=3, hot=hot).collect()
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    assert got == dict(enumerate(brute_bytes([t.encode() for t in texts], 60)))


@pytest.mark.parametrize("hot", [4096, 1])
def test_substring_planted(docs_of, hot):
    rows = [(7 * i % 31, t) for i, t in enumerate(planted(9, 80))]
    found = substring_dedup.remove_later(docs_of(rows), length=12, gram=3, hot=hot).collect()
    assert {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute_words([(i, t.encode()) for i, t in rows], 12)


def test_byte_and_word_odd_rows(docs_of):
    long = " ".join(f"w{i}" for i in range(700))
    rows = [(1, None), (None, long), (2, long), (3, ""), (4, "short"), (4, "short"), (5, "p q r " * 40)]
    got = {(r.id, r.n_removed) for r in substring_dedup.remove_later(docs_of(rows)).collect()}
    assert got == {(1, 0), (None, 0), (2, 700), (3, 0), (4, 0), (5, 117)}
    repeated = docs_of([(9, long), (9, long)])
    assert [r.n_removed for r in suffix_dedup.remove_repeats(repeated).collect()] == [len(long)] * 2
    assert [r.n_removed for r in substring_dedup.remove_later(repeated).collect()] == [0, 0]
    assert suffix_dedup.remove_repeats(docs_of([])).count() == substring_dedup.remove_later(docs_of([])).count() == 0


def many_of_one_id(repeated):
    """500 unrelated texts of id 7 and 500 of null ids, and a few that repeat one of them."""
    rng = random.Random(17)
    text = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(30, 90)))
    rows = [(7, text()) for _ in range(500)] + [(None, text()) for _ in range(500)]
    return rows + [(k, f"{text()} {rows[i][1]}") for k, i in enumerate(repeated, 8)]


def test_texts_of_one_id_stay_apart_bytes(docs_of):
    rows = many_of_one_id([3, 700, 999])
    want = Counter(zip([i for i, _ in rows], brute_bytes([t.encode() for _, t in rows], 60)))
    found = suffix_dedup.remove_repeats(docs_of(rows), length=60, head=20).collect()
    assert Counter((r.id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in found) == want


def test_texts_of_one_id_stay_apart_words(docs_of):
    rows = many_of_one_id([3, 700, 999])
    tails = {8: 3, 9: 700, 10: 999}
    want = Counter()
    for i, t in rows:
        words = t.split()
        kept = words[:-len(rows[tails[i]][1].split())] if i in tails else words
        want[i, len(words), len(words) - len(kept), sha(" ".join(kept).encode())] += 1
    for hot in (4096, 1):
        found = substring_dedup.remove_later(docs_of(rows), hot=hot).collect()
        assert Counter((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == want


def test_long_texts_cross_blocks(docs_of, monkeypatch):
    from vicinage.llm import common
    monkeypatch.setattr(common, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(common, "BLOCK_WORDS", 300)
    texts = planted(13, 900)
    values = list(enumerate(texts))
    data = [np.frombuffer(t.encode(), dtype=np.uint8) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    seen = Counter()
    for *_, d, _, pack, _ in common.pieces_of(np.concatenate(data), offsets, np.arange(len(texts)), np.zeros(len(texts), dtype=np.int64),
                                           60, 20, 1500, common.byte_values):
        for i, p in zip(d, pack):
            for w in range(common.pack_start(p), common.pack_start(p) + common.pack_count(p)):
                seen[int(i), int(w)] += 1
    assert set(seen.values()) == {1}
    assert len(seen) == sum(max(0, len(t.encode()) - 59) for _, t in values)


def test_automaton_matches():
    a = substring_dedup.SuffixAutomaton()
    for s in ("abcbc", "abcd", "abab", "bcbcbc"):
        a.add(s)
    held = {s[i:j] for s in ("abcbc", "abcd", "abab", "bcbcbc") for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = "zabcbcdababbcbcbcbcx"
    want = [max((n for n in range(1, i + 2) if text[i + 1 - n:i + 1] in held), default=0) for i in range(len(text))]
    assert list(a.statistics(text)) == want


def test_reference_spans(docs_of):
    ref = docs_of([(1, " ".join(f"r{i}" for i in range(50))), (2, None)])
    docs = docs_of([(1, "x " + " ".join(f"r{i}" for i in range(10, 40)) + " y"), (2, None), (3, "r1 r2")])
    got = {r.id: r.spans for r in substring_dedup.match_reference(docs, ref, shard_words=10).collect()}
    assert got == {1: [[1, 31]], 2: [], 3: []}


def brute_vectors(rows, threshold=0.9):
    good = {r[0]: np.array(r[1], dtype=float) / max(map(abs, r[1])) for r in rows if r[1] and None not in r[1] and np.isfinite(np.array(r[1], dtype=float)).all() and any(r[1])}
    root, links = {i: i for i, _ in rows}, Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(good)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            a, b = good[i], good[j]
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (links[i], find(i), find(i) == i) for i, _ in rows}


def test_embedding_query(spark):
    want = brute_vectors([(r.vec_id, list(r.embedding)) for r in read(spark, "embeddings")])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.QUERIES["op1_embedding_dedup"](spark, SMALL).collect()}
    assert got == want


def test_embeddings_in_small_tiles(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 10))
    rows = [(int(i), [float(x) for x in base[i % 12] + rng.standard_normal(10) * (0.02 + 0.3 * (i % 3))]) for i in range(90)]
    rows += [(100, None), (101, []), (102, [0.0] * 10), (103, [float("nan")] * 10), (104, [None] + [1.0] * 9), (105, [1.0, 2.0]), (106, [1e200, 2e200])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, node int")
    got = {r.id: (r.n_links, r.component, r.kept) for r in embedding_dedup.near_duplicates(frame, tile=16).collect()}
    assert got == brute_vectors(rows) and got[105] == (1, 105, True)
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


BASE = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def test_secret_query(spark):
    def base(t):
        out = [("assign", m.start(), m.end()) for m in BASE.finditer(t) if len(m[2]) >= 6]
        out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))
    folder = SMALL.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in queries.QUERIES["op3_secret_scan"](spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        want, g = base(r.text or ""), got[r.doc_id]
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(s[0] == k for s in want) for k in ("assign", "access", "hex"))
        assert g.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode())
    assert sum(g.n_assign for g in got.values()) > 0


def test_secret_structure(docs_of):
    import base64
    import json
    def url(b):
        return base64.urlsafe_b64encode(b).decode().rstrip("=")
    def der(tag, body):
        n = len(body)
        return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body
    key = der(0x30, der(2, b"\0") + der(2, b"\x55" * 128) + der(2, b"\1\0\1"))
    b64 = base64.b64encode(key).decode()
    jwt = f"{url(json.dumps({'alg': 'HS256'}).encode())}.{url(b'{\"sub\": 1}')}.{url(b's' * 32)}"
    fake = f"{url(json.dumps({'typ': 'x', 'none': 'HS256'}).encode())}.{url(b'{\"sub\": 1}')}.{url(b's' * 32)}"
    armoured = f"-----BEGIN RSA PRIVATE KEY-----\n{b64[:64]}\n{b64[64:]}\n-----END RSA PRIVATE KEY-----"
    ssh = base64.b64encode(b"".join(len(p).to_bytes(4, "big") + p for p in (b"ssh-ed25519", b"k" * 32))).decode()
    kinds = lambda t: [s[2] for s in secret_scan.spans(t)]
    assert kinds(f"see {jwt} now") == ["signed_token"] and kinds(f"see {fake}") == []
    assert "private_key" in kinds(armoured) and kinds(f"k {b64} z") == ["encoded_key"] and kinds(ssh) == ["encoded_key"]
    assert kinds(base64.b64encode(b64.encode()).decode()) == ["encoded_key"] and "encoded_key" in kinds(key.hex())
    assert kinds(base64.b64encode(random.Random(1).randbytes(200)).decode()) == [] and kinds(b64[:-8]) == []
    assert secret_scan.masked(f"é {jwt}, token=abcdef1 x") == "é [SECRET], [SECRET] x"
    assert kinds("\u017fecret=abcdefg to\u212aen:abcdef TOKEN=abcdef") == ["assign"]
    rows = secret_scan.scan(docs_of([(1, None), (None, "token=abcdefg"), (2, "")])).collect()
    assert sorted((str(r.id), r.spans) for r in rows) == [("1", ""), ("2", ""), ("None", "assign:0:13")]
    assert secret_scan.scan(docs_of([])).count() == 0


def test_chat_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    want = con.sql(queries.ORACLE_SQL["op4_chat_format"])
    got = queries.QUERIES["op4_chat_format"](spark, SMALL)
    assert set(got.columns) == set(want.columns)
    assert {tuple(r) for r in got.select(*want.columns).collect()} == set(want.fetchall())


def test_chat_odd_rows(spark):
    texts = ["<\\s>", "a <s> b", "<<s>>", "<\\\\|im_end|>", "<|im_end|>", "[/INST", "[INST][/INST]", "é\n<", "|im_sep|>", "\\", None, ""]
    rows = [(1, i, "assistant" if i % 2 else "user", t, "k") for i, t in enumerate(texts)]
    rows += [(2, 0, None, "x", "k"), (2, None, "<|im_sep|>", "y", "k"), (2, 0, None, "x", "k"), (None, 0, "assistant", "z", "k")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string")
    made = chat_format.examples(frame).collect()
    by = defaultdict(list)
    for r in sorted(made, key=lambda r: (str(r.conv), r.example)):
        by[r.conv].append(r)
    assert [r.text[r.loss_start:r.loss_end] for r in by[None]] == ["z"] and by[2][0].loss_start is None and len(by[2]) == 1
    told = {r.conv: r for r in chat_format.digest(chat_format.examples(frame)).collect()}
    said = "".join(f"{'assistant' if i % 2 else 'user'}\n{t or ''}\n" for i, t in enumerate(texts))
    assert told[1].turns_sha256 == sha(said.encode()) and told[1].loss_sha256 == sha("".join(t or "" for t in texts[1::2]).encode())
    assert told[2].turns_sha256 == sha(b"<|im_sep|>\ny\n\nx\n\nx\n") and told[2].loss_chars == 0
    assert all(e.text.startswith(by[1][0].text) for e in by[1]) and len(by[1]) == 6


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        level = (total - sum(most * sizes[s] for s in capped)) / max(1e-9, sum(w[s] for s in order if s not in capped))
        more = {s for s in order if s not in capped and level * w[s] > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in capped else level * w[s] for s in order}
        capped |= more


def check_mix(rows, docs):
    size = {d: len(SPLIT.findall((t or "").encode())) for d, t, _ in docs}
    sizes = Counter()
    for d, _, s in docs:
        sizes[s] += size[d]
    want, taken = brute_targets(sizes), Counter()
    source = {d: s for d, _, s in docs}
    for r in rows:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) < 1.001 for s in want)


def test_mix_query(spark):
    rows = queries.QUERIES["op5_source_mix"](spark, SMALL).collect()
    check_mix(rows, [(r.doc_id, r.text, r.source) for r in read(spark, "documents")])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.QUERIES["op5_source_mix"](spark, SMALL).collect()))


def test_mix_odd_rows(spark, docs_of):
    rng = random.Random(2)
    docs = [(i, "w " * rng.randint(0, 40), "en", rng.choice(["big", "big", "a", "B", "é", None])) for i in range(200)]
    docs += [(200, None, "en", "empty"), (201, "", "en", ""), (202, "one\x0btwo\xa0three", "en", "a")]
    rows = source_mix.mix(docs_of(docs)).withColumnRenamed("id", "doc_id").collect()
    check_mix(rows, [(d, t, s) for d, t, _, s in docs])
    assert source_mix.mix(docs_of([])).count() == 0
