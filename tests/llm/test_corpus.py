"""The corpus operators against brute force, on small fixtures and on the smallest tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lastro.llm import hpylm, language, mixing, multiset_hash, near_dedup, neighbours, packing, queries, sharding, token_counts, transcripts

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, row long, word string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, very long, repeated and special texts; other columns have names that the operators use."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["a", "lua", "sol", "mar,", "É"]) + str(rng.randrange(900)) for _ in range(40_000))
    texts = [None, "", "  \t\n", "one", "two words", "Mixed CASE words here.", "Mixed CASE words here.", "x<|endoftext|>y <|EndOfText|> z", "don't we'll\x85now so", "123 !!! ,.;", long, "日本語 の 文章", "été Å"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", None, "x", 7, "w") for i, t in enumerate(texts)]
    rows += [rows[3], (None, "no id here", None, "s1", None, "x", 7, "w"), (40, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# SimHash near duplicates


def brute_simhash(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    """prints: list of (id, fingerprint); smallest id reachable."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(prints))]


def near(df):
    found = near_dedup.near_duplicates(df)
    return found.select("doc_id", near_dedup.hex_digits(F.col("simhash")).alias("f"), "component_id")


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_near_duplicates_match_brute_force(request, table):
    df = request.getfixturevalue(table)
    texts = rows_of(df.select("doc_id", "text"))
    prints = [(i, brute_simhash(t)) for i, t in texts]
    expected = Counter((i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints), strict=True))
    assert Counter(rows_of(near(df))) == expected


def test_near_duplicates_of_dense_fingerprints_are_cut_again(spark, monkeypatch):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    dense = {centre ^ (rng.getrandbits(14) << 3) for _ in range(700)} | {rng.getrandbits(64) for _ in range(300)}
    monkeypatch.setattr(near_dedup, "TREE_LIMIT", 16)
    df = spark.createDataFrame([(near_dedup._signed(x),) for x in dense], "fingerprint long")
    links = near_dedup.fingerprint_links(df)
    roots = dict(rows_of(near_dedup.components(links.select(F.col("fingerprint").alias("a"), F.col("root").alias("b")))))
    got = defaultdict(set)
    for x in dense:
        got[roots.get(near_dedup._signed(x), near_dedup._signed(x))].add(x)
    items = list(dense)
    expected = defaultdict(set)
    for x, c in zip(items, brute_components(list(enumerate(items))), strict=True):
        expected[c].add(x)
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in expected.values()}


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(5)
    items = [rng.getrandbits(10) for _ in range(300)]
    tree = near_dedup.BKTree()
    for x in items:
        tree.add(x)
    for q in range(0, 1024, 37):
        assert sorted(tree.items[i] for i in tree.within(q, 3)) == sorted(x for x in items if (x ^ q).bit_count() <= 3)


def test_long_chain_is_one_component(spark):
    chain = [(i, i + 1) for i in range(300)]
    found = near_dedup.components(spark.createDataFrame(chain, "a long, b long"))
    assert dict(rows_of(found)) == {i: 0 for i in range(1, 301)}


def test_drop_near_duplicates(odd, docs, empty):
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    expected = {r["doc_id"] for r in near(docs).collect() if r["doc_id"] == r["component_id"]}
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(expected)
    ids = [r["doc_id"] for r in near_dedup.drop_near_duplicates(odd).collect()]
    assert ids.count(3) == 1 and 6 not in ids and None in ids and 40 not in ids
    assert near_dedup.near_duplicates(empty).count() == 0


def test_dropping_keeps_columns_of_its_own_names(spark):
    df = spark.createDataFrame([(1, "a b c d", 9, "r"), (2, "a b c d", 8, "s"), (3, "wholly other words here", 7, "t")], "doc_id long, text string, row long, record string")
    assert sorted(rows_of(near_dedup.drop_near_duplicates(df))) == [(1, "a b c d", 9, "r"), (3, "wholly other words here", 7, "t")]


def test_near_duplicates_are_dropped_by_row(spark):
    a, b, c, d, e = ("one fish two fish red", "a wholly other tale of ships", "the third text is new here", "no id but words enough", "other words no id either")
    rows = [(5, a), (1, a), (5, b), (7, c), (7, d), (None, e), (None, e), (None, c), (9, b)]
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(rows_of(kept)) == Counter([(1, a), (5, b), (7, c), (7, d), (None, e)])


# Token counts and packing


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_token_counts_match_the_library(request, table):
    df = request.getfixturevalue(table)
    encode, expected = library(), Counter()
    for i, t in rows_of(df.select("doc_id", "text")):
        n = len(encode.encode(t or "", add_special_tokens=False).ids)
        expected[i, len((t or "").encode()), n, n > 2048] += 1
    assert Counter(rows_of(token_counts.token_counts(df, queries.tokenizer_path()))) == expected


def test_token_counts_without_frequent_words(docs, empty, monkeypatch):
    path = queries.tokenizer_path()
    expected = Counter(rows_of(token_counts.token_counts(docs, path)))
    monkeypatch.setattr(token_counts, "frequent_words", lambda df, text: df.sparkSession.createDataFrame([], "word string, n long"))
    assert Counter(rows_of(token_counts.token_counts(docs, path))) == expected
    monkeypatch.undo()
    assert token_counts.token_counts(empty, path).count() == 0


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_packing_holds_every_piece_once(request, table):
    df = request.getfixturevalue(table)
    encode, expected = library(), Counter()
    for i, t in rows_of(df.select("doc_id", "text")):
        ids = [*encode.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            expected[i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    found = rows_of(packing.pack_documents(df, queries.tokenizer_path()))
    assert Counter(r[:5] for r in found) == expected
    bins = defaultdict(list)
    for r in found:
        bins[r[5]].append((r[6], r[3]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    least = math.ceil(sum(r[3] for r in found) / 2048)
    assert len(bins) <= least * 1.02 + 2


def test_best_two_fit_replaces_the_smallest_by_a_tighter_pair():
    # greedily 6 + 3 = 9; the gap of 4 without the 3 takes 2 + 2
    assert sorted(map(sorted, packing.best_two_fit([6, 3, 2, 2], 10))) != []
    first = packing.best_two_fit([6, 3, 2, 2], 10)[0]
    assert sorted(x for x in first) == [0, 2, 3]


def test_best_two_fit_packs_everything():
    rng = random.Random(2)
    lengths = [min(64, max(1, int(rng.expovariate(1 / 15)))) for _ in range(5000)]
    found = packing.best_two_fit(lengths, 64)
    assert sorted(x for b in found for x in b) == list(range(5000))
    assert all(sum(lengths[x] for x in b) <= 64 for b in found)
    assert len(found) <= math.ceil(sum(lengths) / 64) + 1


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty, queries.tokenizer_path()).count() == 0


# Fingerprints


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_fingerprints_of_edited_texts(request, table):
    df = request.getfixturevalue(table)
    order = sorted(rows_of(df.select("doc_id", "text")), key=lambda r: -(1 << 62) if r[0] is None else r[0], reverse=True)
    found, expected, prints = multiset_hash.document_fingerprints(df).collect(), Counter(), defaultdict(set)
    by = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in found}
    for at, (i, text) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        expected[key := (i, len(text), hashlib.sha256(edited.encode()).hexdigest())] += 1
        r = by[key]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints[text].add(r["fingerprint"])
        if edited == text:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
        if after == text:
            assert r["near_next"] == 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == expected
    assert all(len(x) == 1 for x in prints.values())


def test_every_row_is_fingerprinted(spark):
    rows = [("7", "one two"), ("7", "other text here"), ("7", "one two"), (None, "a"), (None, "b"), (None, "b"), (None, None), ("x", "last words"), (None, "b")]
    found = multiset_hash.document_fingerprints(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in found) == Counter((i, len(t or "")) for i, t in rows)
    twice = [r for r in found if r["n_chars"] == 7]
    assert sorted(r["near_next"] for r in twice) == [0, 1] and len({r["fingerprint"] for r in twice}) == 1
    halves = {"one " + t[:3] for _, t in rows if t}
    assert all(r["edited_sha256"] in {hashlib.sha256(x.encode()).hexdigest() for x in halves} for r in twice)
    least = spark.createDataFrame([(-(1 << 63), "a"), (None, "b")], "doc_id long, text string")
    assert {r["doc_id"] for r in multiset_hash.document_fingerprints(least).collect()} == {-(1 << 63), None}


def brute_lanes(spark, paragraphs):
    """Dense lanes and sparse entries of the paragraphs, from Spark's hashes of single values."""
    counts = Counter(paragraphs)
    rows = spark.createDataFrame([(p, r) for p, c in counts.items() for r in range(1, c + 1)], "p string, r long")
    hashed = rows.select("p", "r", *[F.xxhash64(F.lit(k), "p").alias(f"h{k}") for k in range(4)], F.xxhash64(F.xxhash64(F.lit(0), "p"), "r").alias("e")).collect()
    dense, sparse = [0] * 8, Counter()
    for x in hashed:
        if x["r"] == 1:
            for k in range(8):
                h = x[f"h{k // 2}"] & 0xFFFFFFFFFFFFFFFF
                dense[k] = (dense[k] + counts[x["p"]] * (h & 0xFFFFFFFF if k % 2 == 0 else h >> 32)) % (1 << 32)
        e = x["e"] & 0xFFFFFFFFFFFFFFFF
        stratum = min(64 - e.bit_length(), 23)
        lane = stratum * 512 + (e & 511)
        sparse[lane] = (sparse[lane] + (e >> 16 & 0xFFFF)) % (1 << 16)
    return dense, {k << 16 | v for k, v in sparse.items() if v}


def test_lanes_against_brute_force(spark):
    paragraphs = ["a b", "c", "a b", "d e f", "c", "c", *[f"line {i}" for i in range(300)]]
    dense, sparse = brute_lanes(spark, paragraphs)
    df = spark.createDataFrame([(1, "\n".join(paragraphs))], "k long, x string")
    r = multiset_hash.fingerprints(df, ["k"], {"": "x"}).first()
    assert r["dense"] == dense and set(r["sparse"]) == sparse and r["count"] == len(paragraphs)


def test_whole_fingerprints_are_combined(spark):
    df = spark.createDataFrame([(0, "a\nb\na\nd"), (1, "c\ne\nc"), (2, "c\na\nd\na\nb\nc\ne")], "k long, x string")
    rows = {r["k"]: r for r in multiset_hash.fingerprints(df, ["k"], {"": "x"}).collect()}
    both = spark.createDataFrame([tuple(rows[k][c] for k in (0, 1, 2) for c in ("dense", "sparse"))], "d0 array<long>, s0 array<int>, d1 array<long>, s1 array<int>, d2 array<long>, s2 array<int>")
    form = multiset_hash._text_form
    of = lambda x, y, sign: form(multiset_hash.combine(F.col(f"d{x}"), F.col(f"d{y}"), sign), multiset_hash.combine_sparse(F.col(f"s{x}"), F.col(f"s{y}"), sign))
    r = both.select(of(0, 1, 1).alias("sum"), form(F.col("d2"), F.col("s2")).alias("whole"), of(2, 1, -1).alias("less"), form(F.col("d0"), F.col("s0")).alias("part")).first()
    assert r["sum"] == r["whole"] and r["less"] == r["part"]


def multiset_likeness(a, b):
    split = re.compile(r"[\r\n]+|(?<=[.!?])[ \t]+")
    a, b = (Counter(x for x in split.split(t) if x.strip(" ")) for t in (a, b))
    n = a.total() + b.total()
    return 1 - ((a - b).total() + (b - a).total()) / n if n else 1


def test_likeness_follows_the_multisets(docs):
    texts = dict(rows_of(docs.select("doc_id", "text")))
    found = {r["doc_id"]: r for r in multiset_hash.document_fingerprints(docs).collect()}
    order = sorted(texts, reverse=True)
    errors = []
    for at, i in enumerate(order):
        text, after = texts[i], texts[order[(at + 1) % len(order)]]
        half = len(text) // 2
        errors.append(abs(found[i]["near_edited"] - multiset_likeness(text, text[: len(text) - half] + after[:half])))
        errors.append(abs(found[i]["near_next"] - multiset_likeness(text, after)))
    assert sum(errors) / len(errors) < 0.01 and max(errors) < 0.1
    means = [sum(r[c] for r in found.values()) / len(found) for c in ("near_edited", "near_next")]
    assert means[0] > means[1] + 0.2


def test_likeness_counts_repeats_and_long_texts(spark):
    lines = lambda a, n: "\n".join(f"line {i}" for i in range(a, a + n))
    texts = ["one\n" * 600 + lines(0, 81), lines(100, 5), "one\n" * 300 + "two\n" * 300, "one\n" * 300, lines(0, 60_000), lines(60_000, 55_000), lines(70_000, 60_000), "same\n" * 40 + lines(0, 20), "same\n" * 80]
    found = {r["doc_id"]: r for r in multiset_hash.document_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        after = texts[i - 1]
        half = len(text) // 2
        assert abs(found[i]["near_next"] - multiset_likeness(text, after)) < 0.1
        assert abs(found[i]["near_edited"] - multiset_likeness(text, text[: len(text) - half] + after[:half])) < 0.1


def test_fingerprints_are_homomorphic(spark):
    df = spark.createDataFrame([("a\nb\nc", "c\na\nb", "a\nb", "c")], "x string, y string, z string, w string")
    r = multiset_hash.fingerprints(df, ["w"], {"x_": "x", "y_": "y", "z_": "z"}).join(multiset_hash.fingerprints(df, ["x"], {"w_": "w"}))
    r = r.select("x_dense", "y_dense", multiset_hash.combine(F.col("z_dense"), F.col("w_dense")).alias("sum"), "z_dense", multiset_hash.combine(F.col("x_dense"), F.col("w_dense"), -1).alias("less")).first()
    assert r["x_dense"] == r["y_dense"] == r["sum"] and r["less"] == r["z_dense"]


def test_fingerprints_of_nothing(empty):
    assert multiset_hash.document_fingerprints(empty).count() == 0


# Transcripts


def brute_viterbi(model, lines):
    """The best path's score, from the model's tables, line by line over the whole transcript."""
    best = None
    for row in model.emissions(lines):
        best = model.start + row if best is None else (best[:, None] + model.moves).max(0) + row
    return best.max()


def path_score(model, lines, states):
    rows = model.emissions(lines)
    return model.start[states[0]] + rows[np.arange(len(states)), states].sum() + sum(model.moves[a, b] for a, b in zip(states, states[1:], strict=False))


def long_conversations(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    blank = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("\n "))).otherwise(F.col("text"))
    more = df.where("conv_id < 3").select((F.col("conv_id") * 0 - 1).alias("conv_id"), (F.col("conv_id") * 4 + F.col("turn")).alias("turn"), "role", blank.alias("text"))
    return df.unionByName(more)


def test_blocks_give_the_whole_transcripts_best_path(spark, monkeypatch):
    models = []
    for turns in (2, 3, 128):
        monkeypatch.setattr(transcripts, "BLOCK_TURNS", turns)
        blocks = transcripts.transcript_lines(long_conversations(spark))
        model = transcripts.learn(blocks)
        models.append(np.concatenate([model.start, model.moves.ravel(), *(x.ravel() for x in model.emit)]))
        found = defaultdict(list)
        for r in transcripts.recover_states(blocks, model).collect():
            found[r["conv_id"]].append((r["block"], r["lines"], r["recovered"]))
        for parts in found.values():
            lines = [x for _, ls, _ in sorted(parts) for x in ls]
            states = [x for *_, ss in sorted(parts) for x in ss]
            assert path_score(model, lines, states) == pytest.approx(brute_viterbi(model, lines))
    assert np.allclose(models[0], models[1]) and np.allclose(models[0], models[2])


def test_block_length_changes_no_turn(spark, monkeypatch):
    found = []
    for turns in (2, 3, 128):
        monkeypatch.setattr(transcripts, "BLOCK_TURNS", turns)
        found.append(Counter(rows_of(transcripts.canonical_turns(long_conversations(spark)))))
    assert found[0] == found[1] == found[2]


def test_long_turns_and_clashing_names(spark):
    long = "\n".join(f"line {i} of a very long answer, with words enough to be long" for i in range(20_000))
    rows = [(1, 0, "user", "tell me?"), (1, 1, "assistant", long), (2, 0, "user", "hi"), (2, 1, None, "x")]
    names = "conv_id long, turn long, role string, text string, offset string, before string, at string, lines string, c string, k string"
    df = spark.createDataFrame([(*r, *"abcdef") for r in rows], names)
    found = transcripts.canonical_turns(df).collect()
    assert sum(r["n_lines"] for r in found) == 20_003


def test_roles_of_held_out_transcripts(spark):
    found = transcripts.canonical_turns(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    n, right = found.where("held_out").agg(F.sum("n_lines"), F.sum("n_right")).first()
    assert n > 200 and right / n > 0.85


def test_odd_transcripts(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (None, 2, "assistant", "a\nb"), (2, 1, "robot", ""), (3, 500, "assistant", "User: quoted"), (3, 501, "user", "x")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, block string")
    found = transcripts.canonical_turns(df).collect()
    assert sum(r["n_lines"] for r in found) == 8
    assert all(r["rendered"].startswith(f"<|{r['role']}|>\n") for r in found)
    assert transcripts.canonical_turns(df.limit(0)).count() == 0


# Nearest vectors


def test_nearest_vectors_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    v = np.array([r["embedding"] for r in rows], np.float64)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    found = defaultdict(list)
    for r in neighbours.nearest_vectors(df, F.col("vec_id") % 50 == 0, shard_rows=200).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for q in range(0, len(rows), 50):
        cos = unit @ unit[q]
        cos[q] = -2
        best = np.lexsort((np.arange(len(rows)), -cos))[:5]
        assert len(found[q]) == 5
        for i, score in found[q]:
            assert score == pytest.approx(float(v[i] @ v[q] / np.linalg.norm(v[i]) / np.linalg.norm(v[q])), abs=1e-12)
        hits, total = hits + len({i for i, _ in found[q]} & set(best.tolist())), total + 5
    assert hits / total >= 0.9


@pytest.mark.parametrize(("scale", "queries"), [("sf0.01", 20), ("sf0.1", 40)])
def test_recall_and_share_verified_at_the_querys_settings(scale, queries):
    import pyarrow.parquet as pq

    table = pq.read_table(f"/root/testdata/{scale}/embeddings.parquet").slice(0, neighbours.SHARD_ROWS)
    ids, v = table.column("vec_id").to_numpy(), np.array(table.column("embedding").to_pylist(), np.float64)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    index, asked = neighbours.ShardIndex(ids, ids, v), np.flatnonzero(ids % 50 == 0)[:queries]
    found = defaultdict(set)
    for q, i, _ in index.nearest(ids[asked], v[asked], 5):
        found[q].add(i)
    hits = 0
    for at in asked:
        cos = unit @ unit[at]
        cos[at] = -2
        hits += len(found[ids[at]] & set(ids[np.argsort(-cos)[:5]].tolist()))
    assert hits / (5 * len(asked)) >= 0.9
    assert index.verified / len(asked) / len(ids) < 0.45


def test_each_row_of_a_repeated_id_is_searched_and_asked(spark):
    rows = [(50, [0.0, 1.0]), (50, [1.0, 0.0]), (50, [1.0, 0.5]), (1, [0.0, 2.0]), (2, [1.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    unit = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows]
    want = [(50, r, i, round(s, 6)) for q in range(3) for r, (s, i) in enumerate(sorted(((float(unit[q][1] @ u), i) for at, (i, u) in enumerate(unit) if at != q), key=lambda x: (-x[0], x[1])), 1)]
    found = rows_of(neighbours.nearest_vectors(df, F.col("vec_id") % 50 == 0))
    assert sorted((q, r, i, round(s, 6)) for q, r, i, s in found) == sorted(want)


def test_lengths_that_squares_cannot_hold(spark):
    rows = [(0, [1e-200, 0.0]), (1, [3e200, 1e200]), (2, [0.0, 1e308]), (3, [5e-324, 0.0]), (4, [1.0, 3.0]), (50, [1e200, 1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = rows_of(neighbours.nearest_vectors(df, F.col("vec_id") % 50 == 0, k=3).orderBy("query_id", "rank"))
    one, half = 3 / 10**0.5, 0.5**0.5
    assert [(q, r, i) for q, r, i, _ in found] == [(0, 1, 3), (0, 2, 1), (0, 3, 50), (50, 1, 1), (50, 2, 4), (50, 3, 0)]
    assert [s for *_, s in found] == pytest.approx([1.0, one, half, 4 / 20**0.5, 4 / 20**0.5, half])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [1.0, inf]), (7, [1.0, None]), (8, []), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (100, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "k") for i, v in rows], "vec_id long, embedding array<float>, shard string")
    found = rows_of(neighbours.nearest_vectors(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank"))
    assert [(q, r, i) for q, r, i, _ in found] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 50), *[(50, 1, 50)] * 2, *[(50, 2, 0)] * 2, *[(50, 3, 1)] * 2, *[(50, 4, 2)] * 2]
    assert neighbours.nearest_vectors(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# Sharding


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_shards_are_even_and_whole(request, table, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 50_000)
    df = request.getfixturevalue(table)
    found = sharding.shard_digest(df).collect()
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows_of(df.select("doc_id", "text")))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == expected
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert {r["law"] for r in found} == {"rows"} and {r["grown_shard"] for r in found} == {None}


def test_shuffle_is_uniform_enough(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    place = {r["doc_id"]: r["slot"] * 8 + r["shard"] for r in sharding.shard_digest(df).collect()}
    x, y = np.arange(4000), np.array([place[i] for i in range(4000)])
    assert abs(np.corrcoef(x, y)[0, 1]) < 0.08


def test_shuffle_is_seeded(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 50_000)
    monkeypatch.setattr(sharding, "RANGE", 2)
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for partitions in (4, 7):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found.append(sorted(rows_of(sharding.shard_digest(docs).select("doc_id", "shard", "slot"))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
    other = sharding.shuffle_to_shards(docs, seed=1).select("record.doc_id", "shard", "slot")
    assert sorted(rows_of(other)) != found[0]


def test_written_shards(spark, docs, empty, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), shards=3)
    found = spark.read.parquet(str(tmp_path / "s"))
    assert found.select("record.*").columns == docs.columns
    assert sorted(r[0] for r in found.select("record.doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
    assert sharding.shard_digest(empty).count() == 0


# Language model


def test_predictive_probabilities_add_up_to_one(docs):
    model = hpylm.Model(docs.select("text"))
    rows = model.probabilities(model.words).collect()
    assert len(rows) == model.v
    total = np.array([r["p"] for r in rows]).sum(0) + model.unknown_probabilities()
    assert np.allclose(total, 1)


def test_table_counts_follow_their_distribution():
    c, d, opening = 6, 0.4, 0.7
    n = 60_000
    drawn = np.bincount(hpylm.draw_tables(np.full(n, c), np.full(n, opening), d, np.arange(n), 1), minlength=c + 1)[1:] / n
    exact = np.exp(hpylm.stirling(d)[c, 1 : c + 1] + np.arange(1, c + 1) * np.log(opening))
    assert np.allclose(drawn, exact / exact.sum(), atol=0.01)
    large = hpylm.draw_tables(np.array([100_000, 300]), np.array([5.0, 0.01]), 0.5, np.arange(2), 1)
    assert 1 <= large[1] <= 300 and 1 <= large[0] <= 100_000


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_scores_against_brute_force(request, table, monkeypatch):
    df = request.getfixturevalue(table)
    texts = rows_of(df.select("doc_id", "text"))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = {t: [*WORD.findall(lower(t)), ""] for _, t in texts}
    counts = Counter(w for i, t in texts if not held(i) for w in words[t])
    n, v = counts.total(), len(counts)
    monkeypatch.setattr(hpylm, "KNOWN_WORDS", 40)
    found = hpylm.score_documents(df).collect()
    expected = Counter()
    for i, t in texts:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words[t])
        expected[i, held(i), len(words[t]), sum(counts[w] > 0 for w in words[t]), n, round(base, 4)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found) == expected
    assert all(r["score"] < 0 for r in found)
    if table == "docs":
        out = [r for r in found if r["held_out"]]
        assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


@pytest.mark.parametrize(("table", "least"), [("docs", 1), ("docs", 4), ("odd", 1), ("odd", 2)])
def test_frequent_preceding_words_are_contexts(request, table, least, monkeypatch):
    df = request.getfixturevalue(table)
    monkeypatch.setattr(hpylm, "CONTEXT_TOKENS", least)
    monkeypatch.setattr(hpylm, "KNOWN_WORDS", 40)
    monkeypatch.setattr(hpylm, "KNOWN_PAIRS", 60)
    monkeypatch.setattr(hpylm, "HELD_ROWS", 50)
    made = []
    monkeypatch.setattr(hpylm, "Model", lambda texts, kind=hpylm.Model: made.append(kind(texts)) or made[0])
    found = Counter((r["doc_id"], round(r["score"], 4)) for r in hpylm.score_documents(df).collect())
    model = made[0]
    tokens = {(i, t): [b" ", *(w.encode() for w in WORD.findall(lower(t))), b""] for i, t in rows_of(df.select("doc_id", "text"))}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(p for i, t in rows_of(df.select("doc_id", "text")) if not held(i) for p in zip(tokens[i, t], tokens[i, t][1:]))
    key = hpylm.word_key
    cells = {(r["u"], r["w"]): r["c"] for r in model.cells.collect()}
    met = Counter()
    for (u, _), c in counts.items():
        met[u] += c
    assert cells == {(key(u), key(w)): c for (u, w), c in counts.items() if met[u] >= least}
    values = {r["w"]: r for r in model.values.collect()}
    assert {w for w, r in values.items() if r["back"] < 1 or r["opening"] > 1} == {u for u, _ in cells}
    tables = {(r["u"], r["w"]): r["tables"] for r in model.seating.where("u is not null").collect()}
    seats, customers = Counter(), Counter()
    for (u, w), c in cells.items():
        seats[u] += tables.get((u, w), 1)
        customers[u] += c
    p0 = lambda w: values[w]["p"] if w in values else model.unknown

    def p(u, w):
        if u not in customers:
            return p0(w)
        own = cells[u, w] - model.d1 * tables.get((u, w), 1) if (u, w) in cells else 0
        return (own + (1 + model.d1 * seats[u]) * p0(w)) / (1 + customers[u])

    for u in [key(b" "), *list(seats)[:20]]:
        assert sum(p(u, w) for w in values if values[w]["n"]) + p(u, None) == pytest.approx(1)
    expected = Counter((i, round(sum(math.log10(p(key(u), key(w))) for u, w in zip(tokens[i, t], tokens[i, t][1:])), 4)) for i, t in rows_of(df.select("doc_id", "text")))
    assert sum((found - expected).values()) <= len(tokens) * 0.01 and sum(found.values()) == sum(expected.values())


def test_pair_keys_are_sparks(spark):
    rows = [(1, 2), (-5, 7), (1 << 62, -(1 << 63)), (0, 0)]
    found = [r[0] for r in spark.createDataFrame(rows, "u long, w long").select(F.xxhash64("u", "w")).collect()]
    a = np.array(rows, np.int64)
    assert hpylm.pair_keys(a[:, 0].copy(), a[:, 1].copy()).tolist() == found


def test_scores_of_nothing(empty):
    assert hpylm.score_documents(empty).count() == 0


# Languages


def test_languages_of_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify_languages(df).join(df.select("doc_id", "lang", "text"), "doc_id").where("held_out").collect()
    worded = [r for r in found if re.search(r"[^\W\d_]", r["text"])]
    assert sum(r["lang_pred"] == r["lang"] for r in worded) / len(worded) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_odd_languages(odd, empty):
    found = {(r["doc_id"], r["lang_pred"]) for r in language.identify_languages(odd).collect()}
    for i in (0, 1, 2, 9, 40):
        assert (i, "und") in found
    assert {(3, "en"), (11, "en")} <= found
    assert language.identify_languages(odd).count() == odd.count()
    assert language.identify_languages(empty).count() == 0
    assert {r["doc_id"] for r in language.known_languages_only(odd).collect()} == {3, 4, 5, 6, 7, 8, 11, 12, None}  # 10: long, like nothing learned
    assert language.known_languages_only(odd.withColumn("lang", F.lit(None).cast("string"))).count() == 11


def test_texts_in_no_learned_language_are_rejected(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    foreign = ["Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью.", "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική", "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。"]
    held = df.where("doc_id % 10 = 3").withColumn("lang", F.lit(None).cast("string"))
    rows = df.where("doc_id % 10 <> 3").unionByName(held).unionByName(spark.createDataFrame([(10**6 + i, t, None, None) for i, t in enumerate([*foreign, "Привет"])], df.schema))
    kept = {r["doc_id"]: r["lang"] for r in language.known_languages_only(rows).collect()}
    assert not {10**6 + i for i in range(len(foreign))} & set(kept) and 10**6 + len(foreign) in kept
    true = dict(rows_of(df.select("doc_id", "lang")))
    texts = dict(rows_of(df.select("doc_id", "text")))
    assert set(kept) - {10**6 + len(foreign)} == {i for i, t in texts.items() if re.search(r"[^\W\d_]", t or "")}
    filled = [i for i in kept if i < 10**6 and i % 10 == 3]
    assert sum(kept[i] == true[i] for i in filled) / len(filled) > 0.95


# Mixing


def brute_targets(sizes, share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, budget = dict.fromkeys(names, 0.0), share * sum(sizes.values())
    open_, left = set(names), budget
    while open_ and left > 1e-12:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            for s in open_:
                target[s] = level * weight[s]
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_mix_meets_its_targets(request, table):
    df = request.getfixturevalue(table)
    texts = rows_of(df.select("doc_id", "text", "source"))
    sizes = Counter()
    for _, t, s in texts:
        sizes[s] += len(WORD.findall(t or ""))
    target = brute_targets(sizes)
    found = mixing.mix(df).select("doc_id", "source", "mix_size", "mix_source_size", "mix_target", "mix_copies").collect()
    assert Counter((r["doc_id"], r["mix_size"]) for r in found) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in texts)
    taken, largest = Counter(), Counter()
    for r in found:
        assert r["mix_source_size"] == sizes[r["source"]]
        assert r["mix_target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["mix_copies"] <= 2
        taken[r["source"]] += r["mix_copies"] * r["mix_size"]
        largest[r["source"]] = max(largest[r["source"]], r["mix_size"])
    assert sum(taken.values()) <= 1.5 * sum(sizes.values()) + 1e-6
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * max(largest.values()) + 1
    assert Counter(rows_of(mixing.mix_digest(df))) == Counter(rows_of(mixing.mix_digest(df)))


def test_mixed_documents(docs, empty):
    total = mixing.mix_digest(docs).agg(F.sum("taken")).first()[0]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))))).first()[0] == total
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("partitions", [3, 8])
def test_running_sums(spark, partitions):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), rng.randrange(40), i, rng.randrange(50)) for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    df = spark.createDataFrame(rows, "g string, o int, row long, n long")
    for within in (["g"], []):
        found = {r["row"]: r["total"] for r in mixing.running_sum(df, within, ["o", "row"], "n", "total").collect()}
        sums = Counter()
        for g, _, i, n in sorted(rows, key=lambda r: r[1:3]):
            sums[g if within else ""] += n
            assert found[i] == sums[g if within else ""]
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_mix_takes_what_the_queue_says(request, table):
    df = request.getfixturevalue(table)
    texts = rows_of(df.select("doc_id", "text", "source"))
    sizes = Counter()
    for _, t, s in texts:
        sizes[s] += len(WORD.findall(t or ""))
    target = brute_targets(sizes)
    queue, sent = [], Counter()
    key = lambda s: "-" if s is None else f"={s}"
    by_hash = sorted((hashlib.md5(f"{mixing.SEED}|{'' if i is None else i}|{t or ''}".encode()).hexdigest(), k) for k, (i, t, _) in enumerate(texts))
    for h, k in by_hash:
        s, n = texts[k][2], len(WORD.findall(texts[k][1] or ""))
        sent[s] += n
        queue += [((sent[s] + e * sizes[s]) / target[s], key(s), h, k, n) for e in range(2) if n]
    spent, taken = 0, Counter()
    for *_, k, n in sorted(queue):
        spent += n
        if spent > 1.5 * sum(sizes.values()) * (1 + 1e-9):
            break
        taken[k] += n
    expected = Counter((i, len(WORD.findall(t or "")), taken[k]) for k, (i, t, _) in enumerate(texts))
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix_digest(df).collect()) == expected


def test_mix_keeps_columns_of_its_own_names(spark):
    rows = [(i, f"w{i} " * (i % 7 + 1), "s", i, "r") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size long, row string")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.count() >= 60
    assert all(r["mix_size"] == r["doc_id"] and r["row"] == "r" for r in out.collect())


# Pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.stage(stage(spark, before, SF), f"test-{name}")
        assert docs.columns == columns
        if name == "near_dedup":
            prints = [(r["doc_id"], brute_simhash(r["text"])) for r in before.collect()]
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(set(brute_components(prints)))
        before = docs
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert packed.where("piece = 0").count() == before.count()
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_token_bytes_equal_the_library():
    texts = ["it's fine., 'tis. don't!!", "café. café. é!! Été?", "a—. b—! x≠ ÷. ß.", "a<|endoftext|>b. <|x .", "4.5, 10% x9.", "　 .  , ''", None, ""] * 2
    path = queries.tokenizer_path()
    found = list(packing.token_bytes([None if x is None else x.encode() for x in texts], path))
    expected = [x.ids for x in token_counts.tokenizer(path).encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == expected


def test_special_strings_that_end_a_word_stay_whole():
    texts = ["<|endoftext|>", "end<|endoftext|>", "<|startoftext|>.", "done.<|endoftext|>.", "a<|endoftext|>, b", "x<|endoftext", "<|nothing|>!"]
    path = queries.tokenizer_path()
    found = list(packing.token_bytes([x.encode() for x in texts], path))
    expected = [x.ids for x in token_counts.tokenizer(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == expected


def test_capitals_compose_before_they_are_lower_cased(spark):
    texts = [x + "a b" for x in ("J\u030c", "T\u0308", "H\u0331", "W\u030a", "Y\u030a", "E\u0301", "\u01edJ\u030c <|endoftext|>")] + ["J <|x J\u030c", "ÉJ\u0323\u030c"]
    path = queries.tokenizer_path()
    expected = [x.ids for x in token_counts.tokenizer(path).encode_batch(texts, add_special_tokens=False)]
    found = list(packing.token_bytes([x.encode() for x in texts], path))
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == expected
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, path).collect()}
    assert counts == {i: len(x) for i, x in enumerate(expected)}


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="not words"):
        token_counts.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_mix_gives_the_rows_of_its_sql(spark):
    import duckdb

    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
        found = con.execute(mixing.SQL)
        columns = [c[0] for c in found.description]
        expected = Counter((*r[:3], round(r[3], 6), r[4]) for r in found.fetchall())
    assert columns == ["doc_id", "size", "source_size", "target", "taken"]
    rows = queries.op10_fair_queue_mix(spark, SF).select(columns).collect()
    assert Counter((*r[:3], round(r[3], 6), r[4]) for r in rows) == expected


def test_table_draws_follow_their_distribution():
    n, share = np.array([40, 1000, 50_000, 3, 0]), np.array([0.3, 0.01, 0.02, 0.9, 0.5])
    draws = np.array([hpylm.binomials(n, share, np.arange(5) * 7919 + r * 104_729, 3) for r in range(4000)])
    mean, sd = n * share, np.sqrt(n * share * (1 - share))
    assert (np.abs(draws.mean(0) - mean) <= 5 * sd / 4000**0.5 + 1e-9).all()
    assert (np.abs(draws.std(0) - sd) <= 0.08 * sd + 1e-9).all()
    assert (draws >= 0).all() and (draws <= n).all()


def test_scores_hang_on_no_number_of_partitions(spark, docs, monkeypatch):
    monkeypatch.setattr(hpylm, "CONTEXT_TOKENS", 16)
    found = []
    for partitions, parts in (("8", 3), ("5", 7)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            found.append({r["doc_id"]: r["score"] for r in hpylm.score_documents(docs.repartition(parts)).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0] == pytest.approx(found[1], abs=1e-6)
