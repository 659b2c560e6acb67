"""Alignment, clustering and byte-level BPE against the libraries and brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import tokenizers

from lastro.llm import alignment, byte_bpe, clustering, queries

SF = "/root/testdata/sf0.001"
A, B, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, n long, ids string, pair string, row long"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    long = " ".join(rng.choice(["lua", "the", "ação", "x1"]) + str(rng.randrange(90)) for _ in range(30_000))
    texts = [None, "", " ", "  two  spaces ", "plain words", "plain words", "x<|endoftext|>y <s> </s>", "don't we'll\x85so", "▁under", "日本語 🙂 é", "tab\tand\nline\r\n", "ﬁ Å ①", long, "a" * 5000, "\x00\x1f"]
    rows = [(i, t, 7, "x", "y", i) for i, t in enumerate(texts)] + [(4, texts[4], None, None, None, None), (None, "no id", 1, "", "", 0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def known():
    return byte_bpe.vocabulary(RANKS, PATTERN)


@pytest.fixture(scope="module")
def library(known):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=known.ranks, special_tokens={})


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# alignment


def brute_alignment(texts):
    """Ids, groups and links of each text by walking both token lists side by side."""
    a_model = tokenizers.Tokenizer.from_file(A)
    a_model.encode_special_tokens = True
    table = byte_table()
    entries = {i: bytes(table[c] for c in t) for t, i in a_model.get_vocab().items()}
    b_model = sentencepiece.SentencePieceProcessor(model_file=B)

    def b_bytes(i):
        p = b_model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()

    found = []
    for text in texts:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(entries[i] for i in a) != whole or b"".join(b_bytes(i) for i in b) != whole:
            a, b = [], []
        groups, left, right, ahead, rest = [], [], [], 0, iter(b)
        for i in a:
            left.append(i)
            ahead += len(entries[i])
            while ahead > 0:
                right.append(next(rest))
                ahead -= len(b_bytes(right[-1]))
            if ahead == 0:
                groups.append((left, right))
                left, right = [], []
        found.append((a, b, groups, [(p[-1], q[-1]) for p, q in groups]))
    return found


def byte_table():
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute_rows(rows):
    found = brute_alignment([t for _, t in rows])
    total = Counter(x for _, _, _, links in found for x in links)
    most = defaultdict(int)
    for (_, j), n in total.items():
        most[j] = max(most[j], n)
    out = []
    for (doc_id, _), (a, b, groups, links) in zip(rows, found, strict=True):
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(total[x] == most[x[1]] for x in links), sum(total[x] for x in links), sha))
    return out


@pytest.mark.parametrize("broadcast", [alignment.KNOWN_PAIRS, 40, 0])
def test_alignment_figures(spark, odd, broadcast, monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN_PAIRS", broadcast)
    docs = odd.unionByName(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").select("doc_id", "text"), allowMissingColumns=True)
    got = alignment.alignment_digest(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == sorted(brute_rows([(r.doc_id, r.text) for r in docs.collect()]), key=repr)


def test_alignment_by_words_is_that_of_whole_texts(monkeypatch):
    monkeypatch.setattr(alignment, "HELD_LETTERS", 400)
    monkeypatch.setattr(alignment, "ALIGNED_LETTERS", 60)
    monkeypatch.setattr(alignment, "TOGETHER", 300)
    rng = random.Random(11)
    some = ["a", "the", "ing", " ", "  ", " ", "\n", "\t", "\x85", "\u180e", "\u200b", "\xa0", "\x1c", "'s", ".", ",", "é", "e\u0301", "日本", "🙂", "▁", "12", "<s>", "<|endoftext|>", "(", "_", "ﬁ", "\r\n "]
    weights = [1 if x == "▁" else 12 for x in some]
    texts = [None, "", " ", "  ", "a ", " a", "a  ", "\n", " \n  b", *("".join(rng.choices(some, weights, k=rng.randrange(40))) for _ in range(4000))]
    known = alignment.Words(alignment.encoder(A), alignment.encoder(B))
    assert known.usable
    found = list(alignment.figures_by_word(known, texts))
    assert found == list(alignment.figures_by_text(known.a, known.b, texts))
    assert sum(x is None for x in found) < len(texts) / 2
    for text in texts[1:]:
        assert "".join(" " + w for w in alignment.words_of(text)) == " " + text


def test_alignment_groups_and_overlaps(spark, odd):
    for r in alignment.align_texts(odd.where("text is not null and length(text) < 100"), A, B).collect():
        for g in r.groups:
            a, b = alignment.encoder(A), alignment.encoder(B)
            assert b"".join(a.tokens[i] for i in g.a_ids) == b"".join(b.tokens[i] for i in g.b_ids)
        pairs = [(o.a, o.b) for o in r.overlaps]
        assert len(set(pairs)) == len(pairs) and pairs == sorted(pairs)
        assert len(pairs) == sum(len(g.a_ids) + len(g.b_ids) - 1 for g in r.groups)
    assert alignment.align_texts(odd.where("text = '▁under'"), A, B).first().groups == []


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert alignment.alignment_digest(empty, A, B).collect() == []
    assert alignment.alignment_digest(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).collect()[0][1:] == (0, 0, 0, 0, 0, 0, "")


# clustering


def brute_clusters(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(x * 1024) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in order[:k]]
    away = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    nearest = lambda v: min((away(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if own[n] else c for n, c in enumerate(centroids)]
    last = [(i, *nearest(v)) for i, v in kept]
    sums = Counter()
    for _, d, n in last:
        sums[n] += d
    long = lambda x: x if x < 1 << 63 else None
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, long(d), long(sums[n]), long(sum(sums.values())), hashes[n]) for i, d, n in last]


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, cluster string, own long")


def test_clusters_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute_clusters([(r.vec_id, r.embedding) for r in table.collect()])
    assert rows_of(clustering.cluster_digest(table)) == sorted(want, key=repr)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(con.sql(clustering.clustering_sql()).fetchall(), key=repr) == sorted(want, key=repr)
    _, _, measured = clustering.cluster_vectors(table, rounds=3)
    assert len(measured) == 4 and measured[0] == 8 * table.count()


@pytest.mark.parametrize("block", [4096, 7])
def test_clusters_with_ties_and_odd_rows(spark, block, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", block)
    rng = random.Random(8)
    rows = [(i, [float(rng.randrange(-2, 3)) / 1024 for _ in range(64)], 1, "a", 2) for i in range(90)]
    rows += [(i, [0.001 * (i % 3)] * 64, 1, "a", 2) for i in range(200, 230)]
    rows += [(5, rows[5][1], None, None, None), (None, [0.5] * 64, 1, "a", 2), (300, None, 1, "a", 2), (301, [1.0] * 63, 1, "a", 2), (302, [1.0] * 63 + [None], 1, "a", 2), (303, [float("nan")] * 64, 1, "a", 2), (304, [float("inf")] * 64, 1, "a", 2), (305, [], 1, "a", 2), (306, [0.0] * 64, 1, "a", 2)]
    assert rows_of(clustering.cluster_digest(vectors(spark, rows), rounds=5)) == sorted(brute_clusters([r[:2] for r in rows], rounds=5), key=repr)


@pytest.mark.parametrize("size", [1e5, 1e9, 3e38, 1e306])
def test_clusters_of_large_components(spark, size):
    rng = random.Random(9)
    kind = "float" if size == 3e38 else "double"
    rows = [(i, [float(np.float32(rng.uniform(-size, size))) if kind == "float" else rng.uniform(-size, size) for _ in range(64)], 1, "a", 2) for i in range(30)] + [(50, [0.25] * 64, 1, "a", 2)]
    assert rows_of(clustering.cluster_digest(vectors(spark, rows, kind), rounds=2)) == sorted(brute_clusters([r[:2] for r in rows], rounds=2), key=repr)


def test_few_or_no_vectors_to_cluster(spark):
    assert clustering.cluster_digest(vectors(spark, [])).collect() == []
    for n in (1, 2, 5):
        rows = [(i, [float(i)] * 64, 1, "a", 2) for i in range(n)]
        assert rows_of(clustering.cluster_digest(vectors(spark, rows), rounds=1)) == sorted(brute_clusters([r[:2] for r in rows], rounds=1), key=repr)


def test_bounds_follow_moving_centroids():
    rng = np.random.default_rng(4)
    rows = rng.integers(-500, 500, (300, 6))
    bounds = clustering.Bounds(rows, 4)
    centroids = rng.integers(-500, 500, (9, 6))
    bounds.assign(centroids)
    for step in range(60):
        moved = centroids + rng.integers(-3, 4, centroids.shape) * int(rng.integers(0, 60 - step))
        bounds.keep(4 if step < 30 else 2)
        bounds.move(np.sqrt(((moved - centroids) ** 2).sum(1)) * (1 + clustering.MARGIN))
        bounds.assign(moved)
        exact = ((rows[:, None] - moved[None]) ** 2).sum(2)
        assert (bounds.own == exact.argmin(1)).all()
        assert (bounds.upper >= np.sqrt(exact.min(1)) * (1 - 1e-12)).all()
        centroids = moved


# byte-level BPE

STRINGS = ["a", "b", "ab", " ", "the", "ing", "er", "é", "日", "\n", "'s", "re", "AAAA", "===", "1", "  ", "́", "🙂", "tion", "in", "\x85", "<|endoftext|>"]


def test_encoding_as_the_library(known, library):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(STRINGS) for _ in range(rng.randrange(50)))
        assert known.encode(text) == library.encode_ordinary(text)
        own = bytes(rng.choice(b"aeinrst'=\xc3\xa9\xe6 -") for _ in range(rng.randrange(1, 60)))
        assert known.encode_match(own) == library._core_bpe.encode_single_piece(own)


def test_appends_and_edits_of_prefixes(known):
    rng = random.Random(2)
    some = lambda most: bytes(rng.choice(b"aeinrst'=-") for _ in range(rng.randrange(most)))
    settled = size = 0
    for _ in range(400):
        own = byte_bpe.Prefixes(known, some(900))
        more = some(12)
        assert own.append(more) == len(more)
        assert own.last == byte_bpe.Prefixes(known, own.text).last
        a = rng.randrange(len(own.text) + 1)
        b, new = rng.randrange(a, min(len(own.text), a + 6) + 1), some(5)
        want = own.text[:a] + new + own.text[b:]
        settled += own.replace(a, b, new)
        size += len(want)
        assert own.text == want and own.last == byte_bpe.Prefixes(known, want).last
    assert settled < size / 2


def test_edits_of_texts(spark, known):
    rng = random.Random(3)
    docs, edits = [], []
    for i in range(300):
        text = "".join(rng.choice(STRINGS) for _ in range(rng.randrange(90)))
        docs.append((i, text, known.encode(text)))
        a = rng.randrange(len(text) + 1)
        edits.append((i, a, rng.randrange(a, min(len(text), a + 6) + 1), "".join(rng.choice(STRINGS) for _ in range(rng.randrange(4)))))
    edits += [(0, None, None, " more"), (1, -5, 10_000, None), (2, 3, 1, "x"), (999, 0, 0, "nobody's"), (None, 0, 0, "x")]
    docs.append((400, None, None))
    edits.append((400, 0, 0, "new text"))
    got = byte_bpe.reencode_edits(spark.createDataFrame(docs, "doc_id long, text string, ids array<int>"), spark.createDataFrame(edits, "doc_id long, start long, end long, new string"), RANKS, PATTERN).collect()
    assert len(got) == len(edits) - 2
    texts = {d[0]: d[1] or "" for d in docs}
    want = []
    for i, a, b, new in edits:
        if i in texts:
            t = texts[i]
            a = len(t) if a is None else min(max(a, 0), len(t))
            b = len(t) if b is None else min(max(a, b), len(t))
            want.append((i, t[:a] + (new or "") + t[b:]))
    assert sorted((r.doc_id, r.text) for r in got) == sorted(want)
    for r in got:
        assert r.ids == known.encode(r.text)


def test_encoding_digest(spark, odd, library):
    docs = odd.select("doc_id", "text", "ids").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True)
    want = []
    for r in docs.collect():
        ids, raw = library.encode_ordinary(r.text or ""), (r.text or "").encode()
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))
    assert rows_of(byte_bpe.encoding_digest(docs, RANKS, PATTERN)) == sorted(want, key=repr)
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert sorted((bytes(r.bytes) for r in back.collect())) == sorted((r.text or "").encode() for r in docs.collect())
    assert byte_bpe.encoding_digest(docs.limit(0), RANKS, PATTERN).collect() == []
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert byte_bpe.decode_ids(none, RANKS, PATTERN).first().bytes is None


def test_long_match_takes_linear_time(known, library):
    text = "ab" * 20_000 + "a" * 20_000
    assert known.encode(text) == library.encode_ordinary(text)


def test_queries_of_this_file():
    assert {"op11_owner_alignment", "op12_drake_clusters", "op13_prefix_bpe"} <= set(queries.queries())
