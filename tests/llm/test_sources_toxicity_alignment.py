"""Source divergence, toxicity and tokenizer alignment against plain versions, and on awkward rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultline.llm import alignment, divergence, toxicity
from faultline.llm.frames import text_bytes
from faultline.llm.queries import BYTE_VOCABULARY, PIECE_VOCABULARY, QUERIES

SF, SF_MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# 11: source divergence


def plain_divergence(rows: list[tuple], min_docs: int = 3, top: int = 200) -> set[tuple]:
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, docs = collections.Counter(), collections.Counter()
    for lang, source, text in rows:
        found = TERM.findall(text.translate(lower))
        count.update((lang, source, w) for w in found)
        docs.update((lang, w) for w in set(found))
    out = set()
    groups = sorted({r[:2] for r in rows})
    for lang in {g for g, _ in groups}:
        sources = [s for g, s in groups if g == lang]
        kept = sorted(w for (g, w), n in docs.items() if g == lang and n >= min_docs)
        table = {s: [count[lang, s, w] for w in kept] for s in sources}
        table[None] = [sum(column) for column in zip(*[table[s] for s in sources])]
        share = {s: [1 + 10**9 * (c + 1) // (sum(counts) + len(kept)) for c in counts] for s, counts in table.items()}
        for s in sources:
            pair = [(o, sum((p - q) ** 2 // q for p, q in zip(share[s], share[o]))) for o in sources if o != s]
            term = [(w, (p - q) ** 2 // q) for w, c, p, q in zip(kept, table[s], share[s], share[None]) if c > 0 and p > q]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)}
    return out


def test_divergence_of_the_small_table(spark, documents):
    rows = [tuple(r) for r in documents.select("lang", "source", "text").collect()]
    assert {tuple(r) for r in QUERIES["op11_source_divergence"](spark, SF).collect()} == plain_divergence(rows)


def test_divergence_of_odd_rows(spark):
    same = "wordsthatareverylongandequalforthefirstpart"
    rows = [("en", "a", f"{same}one {same}two {same}one Ärger cat"), ("en", "a", f"{same}TWO cat\tcat{same}"), ("en", None, f"{same}two cat; {same}one ärger"), ("en", "b", None),
            ("en", "b", ""), (None, "a", "one two"), (None, "a", "one two"), (None, None, "one three one"), ("de", "a", "nur einmal"), ("de", "b", "x" * 300_000 + " " + "x" * 300_000 + "y"),
            ("zz", "a", " \x00\x7f[]"), ("fr", "only", "un un un"), ("fr", "only", "un deux"), ("fr", "only", "un")]
    frame = spark.createDataFrame([(*r, None, 1, 2) for r in rows], "lang string, source string, text string, term string, n int, N_ int")
    for parts in (1, 5):
        assert {tuple(r) for r in divergence.divergence(frame.repartition(parts)).collect()} == plain_divergence(rows)
    assert {tuple(r) for r in divergence.divergence(frame, min_docs=1, top=2).collect()} == plain_divergence(rows, 1, 2)
    assert divergence.divergence(frame.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAb zé.", max_size=60), max_size=8), st.integers(2, 40))
def test_pointers_sort_like_words(texts, deep):
    texts = [t.replace("z", "aaaaaaaaaaaaaaaab" * deep) for t in texts]
    data, at = text_bytes(pa.array(texts, pa.string()))
    data = divergence.LOWER[data]
    starts, sizes = divergence.word_pointers(data, at)
    order, new = divergence.sort_pointers(data, starts, sizes)
    words = [data[s : s + n].tobytes() for s, n in zip(starts[order], sizes[order])]
    assert words == sorted(w.encode() for t in texts for w in TERM.findall(t.replace("A", "a")))
    assert list(new) == [i == 0 or words[i] != words[i - 1] for i in range(len(words))]


def test_shares_are_exact_for_large_counts(spark):
    big, total = 7 * 10**15 + 3, 9 * 10**16 + 7
    row = spark.range(1).select(divergence._share(F.lit(big), F.lit(total)).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 1) // total


# 12: toxicity


def test_toxic_documents_are_found_among_held_out_ones(spark, documents):
    table = lambda name: spark.read.parquet(f"{SF_MORE.replace('0.01', '0.1')}/{name}.parquet")
    scored = toxicity.toxicity(table("documents"), table("labels")).join(table("labels"), "doc_id").filter("held_out").select("toxic", "predicted", "score").collect()
    toxic, clean = ([r.predicted for r in scored if r.toxic == k] for k in (1, 0))
    assert np.mean(toxic) >= 0.8 and np.mean(clean) <= 0.005 and all(0 <= r.score <= 1 for r in scored)


def test_query_marks_the_held_out(spark, documents):
    rows = QUERIES["op12_toxicity"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents.select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)


def learnable(spark, n: int = 400):
    """Toxic: an insult together with a group mention, or either of two other pairs; the same words in other pairs are clean."""
    ends = ["blue", "green", "stone", "river"]
    pairs = [("slur", "folks", 1), ("mock", "tribe", 1), ("slur", "tribe", 0), ("mock", "folks", 0), ("calm", "water", 0)]
    rows = [(i, f"The {ends[i % 4]} {pairs[i % 5][0]} came to a {ends[i % 3]} {pairs[i % 5][1]}.", pairs[i % 5][2]) for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return frame.drop("toxic"), frame.drop("text")


def test_pairs_count_that_a_sum_of_weights_misses(spark):
    docs, labels = learnable(spark)
    rows = toxicity.toxicity(docs, labels, strength=2.0).join(labels, "doc_id").collect()
    assert all(r.predicted == r.toxic for r in rows) and any(r.held_out for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = learnable(spark)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda given: sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, given, strength=2.0).collect())
    assert score(labels) == score(turned)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    _, labels = learnable(spark)
    odd = odd_docs.selectExpr("*", "'x' as predicted", "1 as `Score`", "2 as toxic", "3 as label", "4 as code")
    awkward = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (4, None), (5, 7), (None, 1), (10**12, 1), (7, 0), (8, 1)], "doc_id long, toxic int")
    for given in (labels, awkward, awkward.limit(0), labels.filter("toxic = 0")):
        rows = toxicity.toxicity(odd, given).collect()
        assert len(rows) == 9 and all(0 < r.score < 0.7 and r.predicted == 0 and r.label == 3 for r in rows)
        assert len({r.score for r in rows if not (r.text or "").strip()}) == 1 and len({r.score for r in rows if r.doc_id == 1}) == 1
    assert toxicity.toxicity(no_docs, labels).collect() == []


# 13: cross-tokenizer alignment

A = Tokenizer.from_file(BYTE_VOCABULARY)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PIECE_VOCABULARY)
BYTES = {c: b for b, c in enumerate(alignment.byte_alphabet())}


def plain_groups(text: str | None) -> list[tuple[list[int], list[int]]]:
    if not text:
        return []
    a, ids_b = A.encode(" " + text, add_special_tokens=False), B.encode(text)
    ids_a, bytes_a = a.ids, [bytes(BYTES[c] for c in token) for token in a.tokens]
    names = [B.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, names)]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return []
    ends_a, ends_b = ({end: i + 1 for i, end in enumerate(itertools.accumulate(map(len, x)))} for x in (bytes_a, bytes_b))
    cuts = [(0, 0), *[(ends_a[c], ends_b[c]) for c in sorted(ends_a.keys() & ends_b.keys())]]
    return [(ids_a[i:k], ids_b[j:m]) for (i, j), (k, m) in itertools.pairwise(cuts)]


def plain_alignment(texts: list[str | None]) -> list[tuple]:
    groups = [plain_groups(t) for t in texts]
    links = []
    for g in groups:
        links.append(collections.Counter())
        for a, b in g:
            both = itertools.product(collections.Counter(a).items(), collections.Counter(b).items())  # a long text without a common end is one group
            links[-1].update({(x, y): n * m for (x, n), (y, m) in both})
    held = collections.Counter(p for found in links for p in found)
    best: dict[int, int] = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for g, found in zip(groups, links):
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(found.values()), sum(n for p, n in found.items() if held[p] == best[p[0]]),
                    sum(n * held[p] for p, n in found.items()), spelled))
    return out


def test_alignment_of_the_small_table(spark, documents):
    docs = documents.select("doc_id", "text").collect()
    want = {r.doc_id: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for r, w in zip(docs, plain_alignment([r.text for r in docs]))}
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_tokenizer_alignment"](spark, SF).collect()} == want


def test_alignment_of_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    added = spark.createDataFrame([(20, "with ▁ in it"), (21, "<|endoftext|> and <s> ▁"), (22, "<|endoftext|> and <s> and <0x41>"), (23, "漢字かな交じり文 ابجد 🙂🙂́"), (24, "ab" * 20_000)], "doc_id long, text string")
    odd = odd_docs.unionByName(added, allowMissingColumns=True).withColumn("pairs", F.lit(1)).withColumn("n", F.lit(2))
    texts = odd.select("text").toPandas()["text"].tolist()
    want = sorted(plain_alignment([None if t is None else str(t) for t in texts]))
    for parts in (1, 4):
        assert sorted(tuple(r)[1:] for r in alignment.align(odd.repartition(parts), BYTE_VOCABULARY, PIECE_VOCABULARY).collect()) == want
    assert {r.doc_id for r in alignment.align(odd, BYTE_VOCABULARY, PIECE_VOCABULARY).collect() if not r.n_a} == {2, 3, 20, 21}
    assert alignment.align(no_docs, BYTE_VOCABULARY, PIECE_VOCABULARY).collect() == []


def test_links_are_laid_out_in_bounded_parts(monkeypatch):
    rng = np.random.default_rng(1)
    cut = np.array([0, 3, 40, 41, 60])
    made = lambda: alignment.Groups(rng.integers(0, 9, 61), rng.integers(0, 9, 61), np.array([0, 41, 41, 61]), np.array([0, 41, 41, 61]), cut, cut)
    groups = made()
    one, pair = groups.single()
    singles = collections.Counter(zip(groups.of[one].tolist(), pair.tolist()))
    whole = collections.Counter(singles)
    for of, pair, n in groups.links():
        for key in zip(of.tolist(), pair.tolist(), n.tolist()):
            whole[key[:2]] += key[2]
    monkeypatch.setattr(alignment, "LINKS", 10)
    parts, largest = collections.Counter(singles), 0
    for of, pair, n in groups.links():
        largest = max(largest, len(pair))
        assert (np.diff(of) >= 0).all()
        for key in zip(of.tolist(), pair.tolist(), n.tolist()):
            parts[key[:2]] += key[2]
    assert parts == whole and largest <= 20 and sum(whole.values()) == int((groups.many_a * groups.many_b).sum())
    pair, held = groups.pairs()
    assert dict(zip(pair.tolist(), held.tolist())) == collections.Counter(p for _, p in whole)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=60, unique=True), st.lists(st.integers(0, 300), max_size=60), st.data())
def test_galloping_finds_the_first_place(ends, wanted, data):
    ends, wanted = np.sort(np.array(ends)), np.array(wanted, np.int64)
    guess = np.array([data.draw(st.integers(0, len(ends) - 1)) for _ in wanted], np.int64)
    assert alignment.gallop(wanted, ends, guess).tolist() == np.searchsorted(ends, wanted).tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60))
def test_both_encoders_of_the_byte_side_agree(text):
    side, _ = alignment.sides(BYTE_VOCABULARY, PIECE_VOCABULARY)
    assert side.fast is not None
    assert side.encode(text).tolist() == A.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["it's  we'll\n\n\tX'S 12³½ naïve—“quotes”…  ", "\x1c\x85 ᠎​　 x", "Straße ŉ ǅ ﬁ ٣४ ก็ 가각 é"])
def test_byte_side_on_marks_and_spaces(text):
    side, _ = alignment.sides(BYTE_VOCABULARY, PIECE_VOCABULARY)
    assert side.encode(text).tolist() == A.encode(text, add_special_tokens=False).ids
