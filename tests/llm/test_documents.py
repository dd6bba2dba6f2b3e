"""Operators on documents against plain versions, and on awkward rows."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer


from faultline.llm import bpe, components, line_dedup, near_dedup, packing, quality, token_files
from faultline.llm.queries import ORACLES, QUERIES, VOCABULARY

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(VOCABULARY)


# 1: quality classifier


def test_quality_agrees_with_held_out_labels(spark, documents):
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = quality.classify(docs).join(labels, "doc_id").select("quality", "quality_keep").collect()
    clean = [r.quality_keep for r in rows if r.quality == 1]
    junk = [r.quality_keep for r in rows if r.quality == 0]
    assert np.mean(clean) >= 0.98 and np.mean(junk) <= 0.1


def test_quality_of_odd_rows(odd_docs, no_docs):
    rows = quality.classify(odd_docs).collect()
    assert len(rows) == 9 and all(set(odd_docs.columns) <= set(r.asDict()) for r in rows)
    assert all(not r.quality_keep and r.quality_score == 0 for r in rows if not (r.text or "").strip())
    assert len({r.quality_score for r in rows if r.doc_id == 1}) == 1
    assert quality.classify(no_docs).collect() == []


def test_words_with_an_equal_start_are_no_repeats():
    dates = "days: " + " ".join(f"2024-01-{d:02d}" for d in range(1, 29))
    codes = " ".join(f"document{n:03d}" for n in range(40))
    slavic = "программа программы программой программе программу программам программах программист"
    again = " ".join(["Document001 document001, document001"] * 8)
    long = f"{'x' * 3_000_000}a {'x' * 3_000_000}b {'x' * 3_000_000}b"
    texts = pa.array([dates, codes, slavic, again, long])
    votes, columns = quality.votes(texts), [quality.LABELLERS.index(name) for name in ("repeats", "runs")]
    assert votes[:4, columns].tolist() == [[1, 1]] * 3 + [[-1, -1]]
    shares = quality.features(texts)[:, quality.BUCKETS] ** 2
    assert shares == pytest.approx([0, 0, 0, 23 / 40, 1 / 40])


def test_labellers_are_weighed_by_their_accuracy():
    rng = np.random.default_rng(0)
    truth = rng.random(5000) < 0.8
    n = len(quality.LABELLERS)
    votes = np.where(truth[:, None], 1, np.where(rng.random((5000, n)) < 0.3, -1, 1))
    votes[:, 0] = np.where(rng.random(5000) < 0.2, -1, 1)  # says nothing about the class
    pattern, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labels(pattern.astype(float), counts.astype(float))
    assert model.accuracy()[0] < model.accuracy()[1:].min()
    told = model.posterior(votes.astype(float)) >= 0.5
    assert (told == truth)[truth].mean() > 0.95


# 3: line dedup


def plain_lines(docs: dict[int, str]) -> dict[int, tuple[int, int, str]]:
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    held = collections.defaultdict(set)
    for i, text in docs.items():
        for line in text.split("\n"):
            held[key(line)].add(i)
    out = {}
    for i, text in docs.items():
        lines = text.split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and i != max(held[key(x)]))]
        out[i] = len(lines), len(lines) - len(kept), "\n".join(kept)
    return out


def test_line_dedup_matches_a_plain_version(spark):
    rng = random.Random(4)
    stock = ["A common line that many hold", " a COMMON line that many hold\t", "short", "", "İstanbul line with twenty+", "x" * 19, "y" * 20]
    docs = {i: "\n".join(rng.choice([*stock, f"own line of document {i}"]) for _ in range(rng.randint(1, 8))) for i in range(40)}
    got = line_dedup.line_dedup(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got} == plain_lines(docs)


def test_line_dedup_of_odd_rows(odd_docs, no_docs):
    rows = line_dedup.line_dedup(odd_docs).collect()
    assert len(rows) == 9
    assert all((r.text, r.n_lines, r.n_dropped) == ("", 1, 0) for r in rows if r.doc_id in (2, 3))
    assert next(r.n_lines for r in rows if r.doc_id == 5) == 20_000
    assert line_dedup.line_dedup(no_docs).collect() == []


def test_line_dedup_keeps_the_largest_id_only(spark):
    line = "this very line is in all documents"
    rows = [(i, f"{line}\n{line}\nown {i}") for i in (3, 9, 5)] + [(None, line)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3: "own 3", 5: "own 5", 9: f"{line}\n{line}\nown 9", None: ""}


# 4: token counts


def test_scan_stitches_documents_across_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP", 8)
    rng = random.Random(3)
    expected = []
    for n, size in enumerate([0, 1, 5000, 9999]):
        tokens = [7 if rng.random() < 0.05 else rng.randint(8, 60) for _ in range(size)]
        np.array(tokens, "<u2").tofile(tmp_path / f"f{n}.bin")
        start = number = 0
        for i, token in enumerate(tokens):
            if token == 7:
                expected.append((f"f{n}.bin", number, start, i - start, True))
                start, number = i + 1, number + 1
        if start < size:
            expected.append((f"f{n}.bin", number, start, size - start, False))
    files = spark.createDataFrame([(p.name, p.stat().st_size) for p in tmp_path.iterdir()], "file string, length long")
    assert sorted(map(tuple, token_files.scan_flat(files, f"file://{tmp_path}", 7, block=37).collect())) == sorted(expected)


def test_scan_refuses_half_tokens(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    files = spark.createDataFrame([("x.bin", 3)], "file string, length long")
    with pytest.raises(Exception, match="ends inside a token"):
        token_files.scan_flat(files, f"file://{tmp_path}", 7).collect()


def test_token_counts_of_odd_rows(odd_docs, no_docs):
    got = sorted((r.doc_id or 0, r.n_tokens) for r in token_files.token_counts(odd_docs, VOCABULARY, 49407).collect())
    coder = bpe.encoder(VOCABULARY)
    assert got == sorted((r.doc_id or 0, len(coder.ordinary(r.text or "")) // 4) for r in odd_docs.collect())
    assert token_files.token_counts(no_docs, VOCABULARY, 49407).collect() == []


# 5: near duplicates


def bag(text: str | None) -> collections.Counter:
    words = (text or "").lower().split()
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else collections.Counter()


def plain_classes(docs: dict[int, str | None]) -> dict[int, int]:
    bags = {i: bag(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both, either = (bags[a] & bags[b]).total(), (bags[a] | bags[b]).total()
            if both and both / either >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates_match_brute_force(documents):
    docs = {r.doc_id: r.text for r in documents.collect()}
    assert {r.doc_id: r.class_id for r in near_dedup.classes(documents).collect()} == plain_classes(docs)


def test_chains_and_outsiders_of_a_large_bucket_are_linked(spark):
    """Copies edited more and more: the last ones are far from the least id, and only linked through others."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    docs = {}
    for i in range(60):
        docs[i] = " ".join(words)
        words[rng.randrange(300)] = f"edit{i}"
    docs[60] = " ".join(f"other{i}" for i in range(300))
    got = near_dedup.classes(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == plain_classes(docs) == {i: 0 for i in range(60)} | {60: 60}


def test_near_duplicates_count_repeats(spark):
    docs = {1: "a b c d e " * 50, 2: "a b c d e " * 30, 3: "a b c d e " * 48, 4: "q r s t u"}
    got = near_dedup.classes(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == {1: 1, 2: 2, 3: 1, 4: 4}


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = near_dedup.classes(odd_docs).collect()
    assert len(rows) == 9 and {r.doc_id: r.class_id for r in rows} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 7: 7, 8: 8, None: None}
    assert near_dedup.classes(no_docs).collect() == []


@pytest.mark.parametrize("copies", [1, 3, 9])
def test_signatures_estimate_weighted_similarity(copies):
    rng = random.Random(copies)
    found, true = [], []
    for _ in range(40):
        a = [f"w{rng.randrange(60)}" for _ in range(200)] * copies
        b = a[: rng.randrange(100, 200)] + [f"v{rng.randrange(60)}" for _ in range(40)]
        texts = pa.array([" ".join(a), " ".join(b)])
        sig = near_dedup.bag_min_hash(2, *near_dedup.shingles(texts))
        found.append((sig[0] == sig[1]).mean())
        x, y = bag(texts[0].as_py()), bag(texts[1].as_py())
        true.append((x & y).total() / (x | y).total())
        assert near_dedup.overlaps(texts[:1], texts[1:])[0] == pytest.approx(true[-1])
    assert np.mean(found) == pytest.approx(np.mean(true), abs=4 * 0.5 / np.sqrt(160 * 40))


def test_a_signature_does_not_depend_on_its_batch():
    text = "is one. " * 300 + " ".join(f"own{i}" for i in range(50))
    alone = near_dedup.bag_min_hash(1, *near_dedup.shingles(pa.array([text])))
    crowd = pa.array([text, *[" ".join(f"w{k}x{i}" for i in range(200)) for k in range(400)]])
    assert (near_dedup.bag_min_hash(401, *near_dedup.shingles(crowd))[0] == alone[0]).all()


@pytest.mark.parametrize("portion", [7, 1000])
def test_components_of_a_path_a_star_and_a_loop(spark, portion):
    pairs = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 3), (5, 4)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long"), portion).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}


# 6: packing


def check_packing(docs: dict[object, list[int]], rows: list, size: int) -> int:
    """Every id in one piece, sequences without gaps; returns the padding."""
    of, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(of) == set(docs)
    for i, ids in docs.items():
        at = 0
        for r in sorted(of[i], key=lambda r: r.start):
            piece = np.array(ids[at : at + r.length], "<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32, list(r.ids)) == (at, len(ids), zlib.crc32(piece.tobytes()), list(piece))
            at += r.length
        assert at == len(ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_packing_places_every_id_once(documents):
    docs = {r.doc_id: [*LIBRARY.encode(r.text or "", add_special_tokens=False).ids, 2] for r in documents.collect()}
    rows = packing.pack(documents, vocabulary=VOCABULARY).collect()
    assert check_packing(docs, rows, 4096) == 0


def test_packing_merges_words_by_the_library(documents, odd_docs):
    """Its ids are those of the automaton, without building one."""
    mine, plain = bpe.library_encoder(VOCABULARY), bpe.encoder(VOCABULARY)
    texts = [r.text or "" for r in [*documents.select("text").collect(), *odd_docs.select("text").collect()]]
    texts += ["'S 'x it's\x85a", "x" * 5000, "\ufb01 \u1e9e \u0130 \u03a3", "<|endoftext|>a <| endoftext|>", "\ufffe\ud7ff \U000e0001"]
    assert [mine.encode(t) for t in texts] == [plain.encode(t) for t in texts]
    assert not hasattr(mine, "automaton")


def test_packing_chooses_the_level_with_the_least_squares():
    packer = packing.SumOfSquares(8)
    item = lambda n: b"\0\0\0\0" * n
    assert list(packer.add(0, item(5))) == [] and list(packer.add(1, item(5))) == []  # two windows at 5
    assert list(packer.add(2, item(3)))[0][0] in (0, 1)  # 3 fills one of them
    assert packer.level.tolist() == [0, 0, 0, 0, 0, 1, 0, 0, 0]
    assert [p[2] for p in packer.close()] == [4, 1]
    assert [(p[1], p[2]) for p in packing.SumOfSquares(8).add(0, item(17))] == [(0, 8), (8, 8)]


def test_packing_bounds_open_windows():
    packer, out = packing.SumOfSquares(8, most_open=3), []
    for row in range(50):
        out += packer.add(row, b"\0\0\0\0" * 5)
        assert packer.opened <= 3
    out += packer.close()
    assert sum(p[2] for p in out) == 250


def test_packing_of_odd_rows(odd_docs, no_docs):
    rows = packing.pack(odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), vocabulary=VOCABULARY).collect()
    docs = {r.doc_id: [*LIBRARY.encode(r.text or "", add_special_tokens=False).ids, 2] for r in odd_docs.collect() if r.doc_id is not None}
    assert check_packing(docs, rows, 4096) == 0
    assert sum(r.start == 0 for r in packing.pack(odd_docs, vocabulary=VOCABULARY).collect()) == 9
    assert packing.pack(no_docs, vocabulary=VOCABULARY).collect() == []


# 7: byte-pair encoding


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("abcdehilnorst'éß#-1 \n", max_size=80))
def test_encoder_equals_the_library(text):
    coder = bpe.encoder(VOCABULARY)
    ids = np.frombuffer(coder.encode(text), "<u4")
    theirs = LIBRARY.encode(text, add_special_tokens=False).ids
    assert list(ids) == theirs
    assert coder.decode(ids.astype(np.int64)) == LIBRARY.decode(theirs, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["Σας ΟΔΟΣ", "a<|endoftext|>b<|startoftext|>", "İ ǅ ŉ ß ẞ ﬁ", " \x1c a\x85b c　d", "'S 'Re IT'LL !'s 's's", "\x00\x01", "é", "<| x", "Ᲊ a", "x" * 70_000, "a " * 300_000])
def test_encoder_equals_the_library_on_hard_texts(text):
    assert list(np.frombuffer(bpe.encoder(VOCABULARY).encode(text), "<u4")) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_encoding_of_odd_rows(odd_docs, no_docs):
    for r in bpe.encode(odd_docs, VOCABULARY, decoded=True).collect():
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == LIBRARY.decode(ids, skip_special_tokens=False)
    assert bpe.encode(no_docs, VOCABULARY).collect() == []


# Registered queries


def test_digest_columns_of_the_encoding_query(spark, documents):
    text = {r.doc_id: r.text or "" for r in documents.collect()}
    for r in QUERIES["op7_bpe"](spark, SF).collect():
        ids = LIBRARY.encode(text[r.doc_id], add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, documents, name):
    from harness import compare, oracle_connection

    assert compare(spark, SF, oracle_connection(SF), QUERIES[name], ORACLES[name])[0] == "ok"


def test_queries_cover_their_tables(spark, documents):
    n = documents.count()
    for name in ("op1_quality_classifier", "op4_token_counts", "op5_near_dedup"):
        assert QUERIES[name](spark, SF).select(F.count_distinct("doc_id")).first()[0] == n
