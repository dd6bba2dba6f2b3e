"""Near-duplicate documents by weighted Jaccard similarity of their word shingles.

Signatures are BagMinHash: each distinct shingle owns Poisson processes over the weight
axis, one for the weights up to 1 and one for each doubling after that (1 to 2, 2 to 4,
4 to 8 ...). The points of a process have a time, a position on the axis and one of the
signature's components; a document sees the points whose position lies below the
shingle's count in it, and a component keeps its earliest point. Two documents agree in
a component with a probability of exactly their weighted Jaccard similarity. Points are
drawn in order of time, and a process stops once its time is beyond the latest
component, so most processes yield one or two points whatever the signature's length.

Signatures are cut into bands. Of the documents that agree in a band each is compared
with the least one only; components of verified links form classes. Where a bucket still
holds several classes, its documents outside the centre's class are held against all of
it: in small buckets by signatures, in large ones by the documents' hashed multisets, in
blocks of bounded size, where one link per document and class is told. Every link is
verified on the multisets of the whole texts. Nothing is capped, and no pair within a
class is listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.components import components
from faultline.llm.frames import pieces
from faultline.session import store

WORDS = 5
BANDS, ROWS = 32, 5
COMPONENTS = BANDS * ROWS
SMALL = 64  # documents of a bucket whose open pairs are told by signatures
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 64-bit hash and count of each distinct shingle: words in lower case between white space, five in a row.

    A text of one to four words is a single shingle; a blank or null text has none.
    Sorted by row and hash.
    """
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts.fill_null(""))))
    words = pc.dictionary_encode(lists.flatten())
    names = words.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
    h = hashes[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
    at = lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    sizes = np.diff(at)
    if len(words):
        blank = (sizes == 1) & np.array([names[i] == "" for i in words.indices.to_numpy(zero_copy_only=False)[np.minimum(at[:-1], len(h) - 1)]])
        sizes = np.where(blank, 0, sizes)
    count = np.where(sizes >= WORDS, sizes - WORDS + 1, np.minimum(sizes, 1))
    row = np.repeat(np.arange(len(sizes)), count)
    start = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    s = np.zeros(len(row), np.uint64)
    for k in range(WORDS):
        there = k < sizes[row]
        s = mix(s + np.where(there, h[np.minimum(start + k, max(len(h) - 1, 0))], 0) + GOLDEN) if len(h) else s
    order = np.lexsort((s, row))
    row, s = row[order], s[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (s[1:] != s[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[first], s[first], np.diff(np.append(first, len(row)))


def bag_min_hash(n: int, row: np.ndarray, s: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Signatures of ``n`` multisets as times, one row each; infinite for empty ones."""
    sig = np.full((n, COMPONENTS), np.inf)
    streams = []
    level, low, high = 0, 0, 1
    there = np.arange(len(row))
    while len(there):
        streams.append((row[there], mix(s[there] + np.uint64(level * int(GOLDEN) % 2**64)), np.full(len(there), low), np.full(len(there), high), weight[there]))
        level, low, high = level + 1, high, 2 * high
        there = there[weight[there] > low]
    if not streams:
        return sig
    of, seed, lo, hi, w = (np.concatenate(x) for x in zip(*streams))
    time = np.zeros(len(of), np.int64)  # in whole ticks, so that sums do not depend on how many points are drawn at once
    drawn = 0
    flat = sig.reshape(-1)
    while len(of):
        many = int(np.clip((1 << 16) // len(of), 1, 128))
        number = (np.arange(drawn + 1, drawn + many + 1, dtype=np.uint64) * GOLDEN)[None, :]
        r = mix(seed[:, None] + number)
        u = (r >> np.uint64(11)).astype(np.float64) * 2.0**-53
        ticks = time[:, None] + np.cumsum(np.rint(-np.log1p(-u) * 2.0**40).astype(np.int64), axis=1)
        times = ticks / (hi - lo)[:, None]
        r = mix(r + GOLDEN)
        component = ((r >> np.uint64(32)) * np.uint64(COMPONENTS)) >> np.uint64(32)
        place = lo[:, None] + (((r & np.uint64(0xFFFFFFFF)) * (hi - lo).astype(np.uint64)[:, None]) >> np.uint64(32)).astype(np.int64)
        seen = place < w[:, None]
        np.minimum.at(flat, (of[:, None] * COMPONENTS + component.astype(np.int64))[seen], times[seen])
        time, drawn = ticks[:, -1], drawn + many
        go = times[:, -1] < sig.max(axis=1)[of]
        of, seed, lo, hi, w, time = (x[go] for x in (of, seed, lo, hi, w, time))
    return sig


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document with an id: its id, the multiset's fingerprint, a short form of the signature, and a key per band.

    The last three are null for a document without shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch.column("text"), 1 << 20):
                part = batch.slice(lo, hi - lo)
                row, s, weight = shingles(part.column("text"))
                n = len(part)
                bits = mix(bag_min_hash(n, row, s, weight).view(np.uint64))
                keys = np.zeros((n, BANDS), np.uint64)
                for k in range(ROWS):
                    keys = mix(keys + bits[:, k::ROWS] + GOLDEN)
                print_ = np.zeros((n, 2), np.uint64)
                for k in range(2):
                    np.add.at(print_[:, k], row, mix(s + np.uint64(k + 1)) * weight.astype(np.uint64))
                some = np.zeros(n, bool)
                some[row] = True
                short = (bits >> np.uint64(32)).astype("<u4")
                keep = lambda values, kind: pa.array([v if x else None for v, x in zip(values, some)], kind)
                yield pa.record_batch([
                    part.column("doc"), keep([p.tobytes() for p in print_], pa.binary()), keep([x.tobytes() for x in short], pa.binary()),
                    keep(list(keys.view(np.int64)), pa.list_(pa.int64())),
                ], ["doc", "print", "sig", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).filter("doc is not null")
    return rows.mapInArrow(run, "doc long, print binary, sig binary, bands array<bigint>")


def overlaps(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of two columns of texts, row by row; 0 where both are blank."""
    out = np.zeros(len(a))
    for lo, hi in pieces(pc.binary_join_element_wise(a.fill_null(""), b.fill_null(""), " "), 1 << 20):
        (ra, sa, wa), (rb, sb, wb) = (shingles(x.slice(lo, hi - lo)) for x in (a, b))
        row, s = np.concatenate([ra, rb]), np.concatenate([sa, sb])
        w = np.concatenate([wa, wb])
        order = np.lexsort((s, row))
        row, s, w = row[order], s[order], w[order]
        twice = np.flatnonzero((row[1:] == row[:-1]) & (s[1:] == s[:-1])) if len(row) else np.zeros(0, np.int64)
        both = np.bincount(row[twice], np.minimum(w[twice], w[twice + 1]), minlength=hi - lo)
        total = np.bincount(row, w, minlength=hi - lo)
        out[lo:hi] = both / np.maximum(total - both, 1)
    return out


def fewest_equal(threshold: float) -> int:
    """Equal components below which two signatures rule out ``threshold``: five standard deviations less than it asks for."""
    return int(np.floor(COMPONENTS * threshold - 5 * np.sqrt(COMPONENTS * threshold * (1 - threshold))))


def plausible(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that the documents' signatures leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, COMPONENTS) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= fewest_equal(threshold)))

    first = pairs.join(sigs.select(F.col("doc").alias("a"), F.col("sig").alias("sig_a")), "a")
    both = first.join(sigs.select(F.col("doc").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of ids whose texts are as similar as ``threshold`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = overlaps(batch.column("text_a"), batch.column("text_b")) >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(close))

    first = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _meetings(members: DataFrame, facts: DataFrame, block: int) -> DataFrame:
    """Rows (left, right): documents of a bucket outside its centre's class, and a block of the bucket, each with its facts.

    ``members``: band, key, doc, root, n (bucket's size), centre_root. Both sides come in
    packs of about ``block`` documents, so a bucket of any size is rows of bounded size.
    """
    names = [c for c in facts.columns if c != "doc"]
    full = members.join(facts, "doc").withColumn("sub", F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / block)))
    packed = full.groupBy("band", "key", "sub").agg(F.collect_list(F.struct("doc", "root", *names)).alias("rows"), F.first("centre_root").alias("centre_root"))
    outside = packed.withColumn("rows", F.filter("rows", lambda x: x["root"] != F.col("centre_root"))).filter(F.size("rows") > 0)
    return outside.select("band", "key", F.col("rows").alias("left")).join(packed.select("band", "key", F.col("rows").alias("right")), ["band", "key"]).select("left", "right")


def _ids(rows: pa.ListScalar) -> tuple[pa.StructArray, np.ndarray, np.ndarray]:
    values = rows.values
    return values, values.field("doc").to_numpy(zero_copy_only=False), values.field("root").to_numpy(zero_copy_only=False)


def _pairs_of(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1), axis=1)
    return pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _open_small(members: DataFrame, made: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different classes in small buckets whose signatures leave the threshold open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = fewest_equal(threshold)
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                (va, da, ra), (vb, db, rb) = (_ids(batch.column(c)[k]) for c in ("left", "right"))
                sa, sb = (np.frombuffer(b"".join(v.field("sig").to_pylist()), "<u4").reshape(-1, COMPONENTS) for v in (va, vb))
                i, j = np.nonzero(((sa[:, None, :] == sb[None, :, :]).sum(axis=2) >= least) & (ra[:, None] != rb[None, :]))
                found.append(np.stack([np.minimum(da[i], db[j]), np.maximum(da[i], db[j])]))
            yield _pairs_of(found)

    return _meetings(members, made.select("doc", "sig"), 64).mapInArrow(run, "a long, b long").distinct()


def _open_large(members: DataFrame, texts: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """Pairs of different classes in large buckets that reach the threshold on 64-bit shingle hashes; the closest for each document and class.

    The hashes are those that links are verified with, so the pair that is told is a link
    if any is, and of many links between a document and a class one tells as much as all.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch.column("text"), 1 << 20):
                part = batch.slice(lo, hi - lo)
                row, s, weight = shingles(part.column("text"))
                at = np.searchsorted(row, np.arange(len(part) + 1))
                hashes, counts = s.astype("<u8"), weight.astype("<u4")
                columns = [pa.array([x[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary()) for x in (hashes, counts)]
                yield pa.record_batch([part.column("doc"), *columns], ["doc", "hashes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                (va, da, ra), (vb, db, rb) = (_ids(batch.column(c)[k]) for c in ("left", "right"))
                (ha, ca, ea), (hb, cb, eb) = (_bags(v) for v in (va, vb))
                words, at = np.unique(np.concatenate([ha, hb]), return_inverse=True)
                ia, ib = at[: len(ha)], at[len(ha) :]
                held, total = np.zeros(len(words), np.int64), np.add.reduceat(cb, eb[:-1])
                for i in range(len(da)):
                    mine = slice(ea[i], ea[i + 1])
                    np.add.at(held, ia[mine], ca[mine])
                    both = np.add.reduceat(np.minimum(held[ib], cb), eb[:-1])
                    held[ia[mine]] = 0
                    near = both / (ca[mine].sum() + total - both)
                    hits = np.flatnonzero((near >= threshold) & (rb != ra[i]))
                    hits = hits[np.argsort(-near[hits], kind="stable")]  # the closest of a class comes first
                    hits = hits[np.unique(rb[hits], return_index=True)[1]]
                    found.append(np.stack([np.minimum(da[i], db[hits]), np.maximum(da[i], db[hits])]))
            yield _pairs_of(found)

    docs = texts.join(members.select("doc").distinct(), "doc", "left_semi")
    return _meetings(members, docs.mapInArrow(measure, "doc long, hashes binary, counts binary"), block).mapInArrow(run, "a long, b long").distinct()


def _bags(values: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and counts of all documents of a pack end to end, and where each one's begin."""
    hashes = values.field("hashes").to_pylist()
    ends = np.concatenate([[0], np.cumsum([len(h) // 8 for h in hashes])])
    return np.frombuffer(b"".join(hashes), "<u8"), np.frombuffer(b"".join(values.field("counts").to_pylist()), "<u4").astype(np.int64), ends


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(id, ``class_id``) of every row of ``docs``: the least id among the documents linked to it, directly or by others.

    Two documents are linked if the weighted Jaccard similarity of their multisets of
    five-word shingles is ``threshold`` or more; texts with equal multisets always are.

    Null, empty and blank texts have no shingles and are alone in their class. A text of
    one to four words is one shingle. A row with a null id has a null class. Rows that
    repeat an id are one document: give each document its own id. Ids must fit a long.
    Other columns are not read. An empty table gives an empty one.
    """
    made = store(signatures(docs, id_col, text_col), "signatures")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    least = store(made.filter("print is not null").groupBy("print").agg(F.min("doc").alias("rep")), "copies")
    reps = made.join(least.select(F.col("rep").alias("doc")), "doc", "left_semi")
    members = reps.select("doc", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.min("doc").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    buckets = store(buckets, "centres")  # as tables of their own, these and the mixed ones below are joined by plain exchanges, whose hot keys Spark splits
    near = store(members.join(buckets, ["band", "key"]), "buckets")
    stars = near.filter("doc <> centre").select(F.col("doc").alias("a"), F.col("centre").alias("b")).distinct()
    links = store(verified(store(plausible(stars, made, threshold), "pairs"), texts, threshold), "links")
    roots = components(links)
    known = near.filter("n > 2").join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    mixed = known.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by("root", "doc").alias("centre_root")).filter("low <> high")
    mixed = store(mixed.select("band", "key", "centre_root"), "mixed")
    left = store(known.join(mixed, ["band", "key"]), "open")
    pairs = _open_small(left.filter(F.col("n") <= SMALL), made, threshold).union(_open_large(left.filter(F.col("n") > SMALL), texts, threshold))
    new = store(verified(store(pairs, "pairs"), texts, threshold), "links")
    if not new.isEmpty():
        roots = components(links.union(new))
    rep_of = made.join(least, "print", "left").select("doc", F.coalesce("rep", "doc").alias("rep"))
    found = rep_of.join(roots, rep_of["rep"] == roots["node"], "left").select("doc", F.coalesce("root", "rep").alias("class_id"))
    lost = docs.filter(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("class_id"))
    return found.union(lost).select(F.col("doc").alias(id_col), "class_id")
