"""N-gram Jaccard join: exact links between documents' sets of word shingles.

A set is kept as sorted 64-bit hashes and named by 126 bits of a digest of the
whole set, so equal sets are one from the start. In hash order, the first
|A| - ceil(t|A|) + l hashes of A and likewise of B have at least l in common
if their Jaccard similarity is t or more. Prefixes with l = |A|/8 are dealt by
hash, packed. A partner has at least t|A| hashes, so a set goes on only
if t|A|/8 of its prefix hashes occur in other prefixes. What is left is joined
by its shortest prefixes (l = 1) into groups that hold all possible links.
There hashes stand in order of how many sets have them, rarest first: by that
order, passages that many texts quote do not chain those texts into one group.
Before anything is dealt a task settles what it holds itself: of a hash that
many of its sets share it sends one name, so no common hash fills a group.

Within a group sets are dealt into tiles of one size band and the next:
sizes of a link differ by less than a band. In a tile, hashed bitmaps bound
each overlap from above by bit counts; the sorted arrays of those that stay
are intersected. Tiles are split into blocks of bounded bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, shuffle_partitions, small_batches, stored, table, whole_rows
from .components import connected_components

WORDS = 5
#: Links have PART * intersection >= ... as whole numbers: 100 * i >= 75 * u.
NUM, DEN = 75, 100
#: Prefixes are longer by this share of the set, so that as many of their hashes must be shared.
EXTRA = 0.125
#: Bits of a bitmap for each hash of a tile's largest set, and the fewest of a bitmap.
BITS_A_HASH, BITS = 4, 2048
#: Sets and bytes of a tile's block, bytes that a task reads, and salts of joins that texts pass through.
BLOCK_SETS, BLOCK_BYTES, TASK_BYTES, SALTS = 2048, 16 << 20, 16 << 20, 8
#: Hashes that a task holds before it sends them, and words whose hashes it keeps.
FLUSH_ENTRIES, KEPT_WORDS = 500_000, 131_072
#: Hashes that are counted in one group; sets from which on a hash counts as equally common; bits of a sieve for each key and at most.
COUNTED_ENTRIES, COMMON, SIEVE_BITS, SIEVE_MOST = 2 << 20, 256, 16, 1 << 26
#: The bits of a name that prefix hashes are sent with.
SHORT = (1 << 47) - 1
#: Rows whose texts a task holds as strings at a time.
ROWS_AT_ONCE = 256


class _WordHashes(dict):
    """Word -> 64-bit hash, emptied when it has grown large."""

    def __missing__(self, word):
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str) -> list[bytes]:
    """The words in UTF-8, lower-cased in A-Z alone, between ASCII white space: bytes know no other."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, cache: _WordHashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; with fewer than n words the whole sequence is one."""
    words = words_of(text) if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(n, len(h))
    mix = np.full(len(h) - k + 1, k, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            mix = (mix ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            mix ^= mix >> np.uint64(29)
        mix *= np.uint64(0xBF58476D1CE4E5B9)
        mix ^= mix >> np.uint64(32)
    return np.unique(mix)


def set_name(s: np.ndarray) -> tuple[int, int]:
    """(name, mark) of a set, 63 bits each; equal sets have equal ones.

    Prefix hashes are sent with 47 bits of the name alone; a set whose name is
    another's too is told from it by its mark and goes on under a name of its own.
    """
    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little") >> 1, int.from_bytes(digest[8:], "little") >> 1


def prefix_length(n: int, share: int) -> int:
    return min(n, n - -(-n * NUM // DEN) + share)


def extra(n: int) -> int:
    """By how much a set's longer prefix exceeds the shortest that may miss no partner."""
    return max(1, int(n * EXTRA))


def _cut(key: np.ndarray):
    """(key, from, to) of each run of equal keys."""
    edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
    return [(int(key[a]), a, b) for a, b in zip(edges, edges[1:]) if b > a]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Prefixes are the smallest hashes: they are mixed again, so that all buckets fill alike."""
    with np.errstate(over="ignore"):
        mixed = h * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(32)).astype(np.int64) * buckets >> 32


def _sorted_pairs(h: np.ndarray, f: np.ndarray):
    """Distinct (hash, name) pairs in order, and whether the pair's hash has two names or more."""
    order = np.lexsort((f, h))
    h, f = h[order], f[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (f[1:] != f[:-1])))
    h, f = h[new], f[new]
    same = h[1:] == h[:-1]
    shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
    return h, f, shared


def _pack(h, f, shared, buckets: int) -> list[tuple[int, bytes]]:
    """(bucket, packed) of one (hash, name) pair a hash, each with a mark whether the hash is known to be shared."""
    first = np.concatenate(([True], h[1:] != h[:-1]))
    h, f, shared = h[first], f[first], shared[first]
    bucket = _bucket(h, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, h, f, shared = bucket[order], h[order], f[order], shared[order]
    return [(k, h[a:b].tobytes() + f[a:b].tobytes() + shared[a:b].tobytes()) for k, a, b in _cut(bucket)]


def _unpack(blobs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, f, known = [], [], []
    for x in blobs:
        n = len(x) // 17
        h.append(np.frombuffer(x, dtype=np.uint64, count=n))
        f.append(np.frombuffer(x, dtype=np.int64, offset=8 * n, count=n))
        known.append(np.frombuffer(x, dtype=bool, offset=16 * n))
    return np.concatenate(h), np.concatenate(f), np.concatenate(known)


def _code(h: np.ndarray) -> np.ndarray:
    """32 bits that stand for a hash within its bucket; where two hashes have the same, sets may only seem to share one."""
    with np.errstate(over="ignore"):
        return (h * np.uint64(0x9E3779B97F4A7C15)).astype("<u4")


def _pack_short(h, f, shared, buckets: int) -> list[tuple[int, bytes]]:
    """As ``_pack``, in ten bytes a pair: the hash's code, 47 bits of the name and the mark."""
    first = np.concatenate(([True], h[1:] != h[:-1]))
    h, f, shared = h[first], f[first], shared[first]
    bucket = _bucket(h, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, code, marked = bucket[order], _code(h[order]), (f | shared.astype(np.int64) << 47)[order].astype("<i8")
    return [(k, code[a:b].tobytes() + marked[a:b].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()) for k, a, b in _cut(bucket)]


def _unpack_short(blobs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code, marked = [], []
    for x in blobs:
        n = len(x) // 10
        code.append(np.frombuffer(x, dtype="<u4", count=n))
        wide = np.zeros((n, 8), dtype=np.uint8)
        wide[:, :6] = np.frombuffer(x, dtype=np.uint8, offset=4 * n).reshape(n, 6)
        marked.append(wide.view("<i8")[:, 0])
    marked = np.concatenate(marked)
    return np.concatenate(code), marked & SHORT, marked >> 47 == 1


def _by_part(names: np.ndarray, values: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    part = names % parts
    order = np.argsort(part, kind="stable")
    part, names, values = part[order], names[order], values[order]
    return [(k, names[a:b].astype("<i8").tobytes() + values[a:b].astype("<i8").tobytes()) for k, a, b in _cut(part)]


NAMES = "doc_id long, key long, rid long, n long, name long, mark long"
SCANNED = f"{NAMES}, bucket long, pairs binary, counts binary"
_SCANNED = [(c, pa.binary() if kind == "binary" else pa.int64()) for c, kind in (x.split() for x in SCANNED.split(","))]


def _scan_rows(size: int, /, **given) -> pa.RecordBatch:
    """Rows of SCANNED; columns that are not given are null."""
    columns = [pa.array(given[c], kind) if c in given else pa.nulls(size, kind) for c, kind in _SCANNED]
    return pa.RecordBatch.from_arrays(columns, [c for c, _ in _SCANNED])


def scan_sets(docs: DataFrame, buckets: int) -> DataFrame:
    """One pass over the texts of (doc_id, key, rid, text), stored: NAMES, part, counts.

    Rows with a part null: n (set size), name and mark of each document, null
    for empty sets. Rows with a part: how many prefix hashes of sets of that
    part occur in other sets, packed. A task sends equal sets once. The rows of
    documents go through the same shuffle as the prefixes, in any bucket: so
    texts are read once and prefixes are not written besides.
    """

    def settle(hashes, names):
        h, f, shared = _sorted_pairs(np.concatenate(hashes), np.concatenate(names))
        own, counts = np.unique(f[shared], return_counts=True)
        rows = [(k, blob, None) for k, blob in _pack_short(h, f, shared, buckets)] + [(k, None, blob) for k, blob in _by_part(own, counts, buckets)]
        bucket, pairs, counted = zip(*rows)
        return _scan_rows(len(rows), bucket=bucket, pairs=pairs, counts=counted)

    def run(batches):
        cache, seen = _WordHashes(), set()
        hashes, names, held = [], [], 0
        turn = TaskContext.get().partitionId() * 7919
        for part in (b.slice(low, ROWS_AT_ONCE) for b in batches for low in range(0, b.num_rows, ROWS_AT_ONCE)):
            turn += 1
            doc_id, key, rid, texts = (c.to_pylist() for c in part.columns)
            n, found, marks = [], [], []
            for text in texts:
                s = shingle_set(text, cache)
                name, mark = set_name(s) if len(s) else (None, None)
                n.append(len(s))
                found.append(name)
                marks.append(mark)
                if name is None or (whole := name << 63 | mark) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(whole)
                p = s[: prefix_length(len(s), extra(len(s)))].copy()
                hashes.append(p)
                names.append(np.full(len(p), name & SHORT, dtype=np.int64))
                held += len(p)
                if held > FLUSH_ENTRIES:
                    yield settle(hashes, names)
                    hashes, names, held = [], [], 0
            yield _scan_rows(len(n), doc_id=doc_id, key=key, rid=rid, n=n, name=found, mark=marks, bucket=[turn % buckets] * len(n))
        if held:
            yield settle(hashes, names)

    def count(rows):
        named = rows.filter(pc.is_valid(rows["n"])).select([c for c, _ in _SCANNED[:6]])
        found = [(k, x) for k, x in zip(rows["bucket"].to_pylist(), rows["counts"].to_pylist()) if x is not None]
        pairs = [x for x in rows["pairs"].to_pylist() if x is not None]
        if pairs:
            h, f, known = _unpack_short(pairs)
            order = np.lexsort((~known, f, h))
            h, f, known = h[order], f[order], known[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (f[1:] != f[:-1])))
            h, f, known = h[new], f[new], known[new]
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            size = np.diff(np.append(starts, len(h)))
            shared = np.repeat((size > 1) | np.logical_or.reduceat(known, starts), size)
            names, counts = np.unique(f[shared & ~known], return_counts=True)
            found += _by_part(names, counts, buckets)
        size = named.num_rows
        named = named.append_column("part", pa.nulls(size, pa.int64())).append_column("counts", pa.nulls(size, pa.binary()))
        part, counts = (pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.binary())))
        none = [pa.nulls(len(found), pa.int64())] * 6
        return pa.concat_tables([named, pa.Table.from_arrays([*none, part, counts], named.column_names)])

    sent = docs.select("doc_id", "key", "rid", "text").mapInArrow(run, SCANNED)
    counted = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(count, f"{NAMES}, part long, counts binary")
    return stored(counted, "scanned")


def _shared_counts(scanned: DataFrame) -> DataFrame:
    """(short, c): how many prefix hashes of each set occur in other sets, or more; none at all: no row.

    A set is named by 47 bits of its name. A hash that tasks settled for a set
    on their own may be counted twice; only too few would matter.
    """

    def add(pdf):
        halves = [np.frombuffer(x, dtype="<i8").reshape(2, -1) for x in pdf["counts"]]
        names, counts = np.concatenate(halves, axis=1)
        names, at = np.unique(names, return_inverse=True)
        return pd.DataFrame({"short": names, "c": np.bincount(at, weights=counts).astype("int64")})

    return scanned.where("part is not null").select("part", "counts").groupBy("part").applyInPandas(add, "short long, c long")


def _bitmaps(arrays: list[np.ndarray], largest: int) -> np.ndarray:
    """A hashed bitmap a set, as rows of 64-bit words; the same length for all sets of a tile."""
    size = max(BITS, 1 << (BITS_A_HASH * int(largest) - 1).bit_length())
    out = np.empty((len(arrays), size // 64), dtype=np.uint64)
    for row, s in zip(out, arrays):
        bits = np.zeros(size, dtype=np.uint8)
        bits[(s % np.uint64(size)).astype(np.int64)] = 1
        row[:] = np.packbits(bits).view(np.uint64)
    return out


def _sieved(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` whose key may be wanted: all that are and a few others, so that few texts are dealt.

    Keys are hashes; one bit of a map of bounded size, sent to every task, stands for some of them.
    """
    bits = 64
    while bits < min(SIEVE_BITS * wanted.count(), SIEVE_MOST):
        bits *= 2
    slot = F.pmod("key", F.lit(bits))
    word, bit = F.floor(slot / 64).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(key, {bits}) % 64 as int))")
    sieve = wanted.groupBy(word).agg(F.bit_or(bit).alias("bits"))
    return docs.join(F.broadcast(sieve), F.floor(slot / 64) == F.col("word")).where(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")


def _sets(docs: DataFrame, wanted: DataFrame, tasks: int) -> DataFrame:
    """(name, n, hashes) of each wanted (id, name, mark, key), its id as name, from one document of it; stored."""

    def run(batches):
        cache = _WordHashes()
        for part in (b.slice(low, ROWS_AT_ONCE) for b in batches for low in range(0, b.num_rows, ROWS_AT_ONCE)):
            rows = []
            for own, name, mark, text in zip(*(c.to_pylist() for c in part.columns)):
                s = shingle_set(text, cache)
                if set_name(s) == (name, mark):  # keys are hashes: another text may have the same
                    rows.append((own, len(s), s.tobytes()))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["name", "n", "hashes"])

    # rows that repeat a document share its key: they are dealt to salts, and the narrow side to all of them
    salted = wanted.select("id", "name", "mark", "key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).hint("merge")
    rows = _sieved(docs, wanted).select("key", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"), "text").repartition(tasks, "key", "salt")
    found = rows.join(salted, ["key", "salt"]).select("id", "name", "mark", "text").mapInArrow(run, "name long, n long, hashes binary")
    return stored(found.dropDuplicates(["name"]), "sets")


def _pack_sets(part: np.ndarray, names: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """(part, packed): of each part the names, each once with its number of entries, and the columns in their order."""
    order = np.lexsort((names, part))
    part, names, columns = part[order], names[order], [c[order] for c in columns]
    rows = []
    for k, a, b in _cut(part):
        own, counts = np.unique(names[a:b], return_counts=True)
        sizes = np.array([len(own), b - a], dtype="<i8")
        rows.append((k, b"".join([sizes.tobytes(), own.astype("<i8").tobytes(), counts.astype("<i4").tobytes(), *(c[a:b].tobytes() for c in columns)])))
    return rows


def _unpack_sets(blobs, *kinds: str) -> list[np.ndarray]:
    """What ``_pack_sets`` packed: names, one an entry, and columns of ``kinds``."""
    found: list[list] = [[np.empty(0, dtype=k)] for k in ("<i8", *kinds)]
    for x in blobs:
        m, n = np.frombuffer(x, dtype="<i8", count=2).tolist()
        own = np.frombuffer(x, dtype="<i8", offset=16, count=m)
        found[0].append(np.repeat(own, np.frombuffer(x, dtype="<i4", offset=16 + 8 * m, count=m)))
        at = 16 + 12 * m
        for out, kind in zip(found[1:], kinds):
            out.append(np.frombuffer(x, dtype=kind, offset=at, count=n))
            at += out[-1].nbytes
    return [np.concatenate(x) for x in found]


def _rarest(sets: DataFrame, buckets: int) -> DataFrame:
    """(name, hashes): the shortest prefix of each set in order of how many sets have a hash, rarest first.

    A hash is named by bucket and code. Those of one set alone come first and
    are not listed: they link nothing. Hashes of ``COMMON`` sets or more are
    equally common, so a task that meets as many of one need not ask.
    """

    def ask(batches):
        hashes, names, sizes, held = [], [], [], 0

        def settle():
            h, f = np.concatenate(hashes), np.concatenate(names)
            bucket, code = _bucket(h, buckets), _code(h)
            whole = bucket << 32 | code
            _, at, counts = np.unique(whole, return_inverse=True, return_counts=True)
            common = counts[at] >= COMMON
            rows = [(k, None, blob, None, None) for k, blob in _pack_sets(bucket[~common], f[~common], code[~common])]
            # one bucket gets how many sets were not asked for, the sets' parts get the hashes themselves
            one = np.unique(whole[common])
            rows += [(k, None, None, one[a:b].astype("<i8").tobytes(), None) for k, a, b in _cut(one >> 32)]
            known = np.full(int(common.sum()), COMMON - 1, dtype=np.uint8)
            rows += [(k, k, None, None, blob) for k, blob in _pack_sets(f[common] % buckets, f[common], whole[common], known)]
            own = np.array(sizes, dtype="<i8").reshape(-1, 2)
            rows += [(k, k, None, own[own[:, 0] % buckets == k].tobytes(), None) for k in np.unique(own[:, 0] % buckets).tolist()]
            return pd.DataFrame(rows, columns=["bucket", "part", "asked", "common", "passed"])

        for b in batches:
            for name, blob in zip(b["name"], b["hashes"]):
                s = np.frombuffer(blob, dtype=np.uint64)
                hashes.append(s)
                names.append(np.full(len(s), name, dtype=np.int64))
                sizes.append((name, len(s)))
                held += len(s)
                if held > FLUSH_ENTRIES:
                    yield settle()
                    hashes, names, sizes, held = [], [], [], 0
        if held:
            yield settle()

    def count(pdf):
        through = pdf["part"].notna()
        rows = [(int(k), c, x) for k, c, x in zip(pdf["part"][through], pdf["common"][through], pdf["passed"][through])]
        names, code = _unpack_sets(pdf["asked"].dropna(), "<u4")
        if len(names):
            whole = code.astype("<i8") | int(pdf["bucket"].iloc[0]) << 32
            _, at, counts = np.unique(whole, return_inverse=True, return_counts=True)
            rank = np.minimum(counts[at], COMMON) - 1
            for x in pdf["common"][~through].dropna():
                rank[np.isin(whole, np.frombuffer(x, dtype="<i8"))] = COMMON - 1
            seen = rank > 0
            rows += [(k, None, x) for k, x in _pack_sets(names[seen] % buckets, names[seen], whole[seen], rank[seen].astype(np.uint8))]
        return pd.DataFrame(rows, columns=["part", "sizes", "shared"])

    def cut(pdf):
        sizes = np.concatenate([np.frombuffer(x, dtype="<i8").reshape(-1, 2) for x in pdf["sizes"].dropna()])
        names, whole, rank = _unpack_sets(pdf["shared"].dropna(), "<i8", "u1")
        order = np.lexsort((whole, rank, names))
        names, whole = names[order], whole[order]
        low, high = np.searchsorted(names, sizes[:, 0]), np.searchsorted(names, sizes[:, 0], side="right")
        rows = []
        for (name, n), a, b in zip(sizes.tolist(), low.tolist(), high.tolist()):
            left = prefix_length(n, 1) - (n - (b - a))
            if left > 0:
                rows.append((name, whole[a : a + left].astype(np.uint64).tobytes()))
        return pd.DataFrame(rows, columns=["name", "hashes"])

    asked = sets.select("name", "hashes").mapInPandas(ask, "bucket long, part long, asked binary, common binary, passed binary")
    counted = asked.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(count, "part long, sizes binary, shared binary")
    return counted.repartition(buckets, "part").groupBy("part").applyInPandas(cut, "name long, hashes binary")


def _group_edges(sets: DataFrame, buckets: int) -> DataFrame:
    """(src, dst): sets that share a hash of their shortest prefixes, rarest hashes first, as chains."""

    def chains(h, f):
        both = h[1:] == h[:-1]
        return np.unique(np.stack([f[:-1][both], f[1:][both]], axis=1), axis=0)

    def settle(hashes, names):
        h, f, shared = _sorted_pairs(np.concatenate(hashes), np.concatenate(names))
        edges = chains(h, f)
        rows = [(k, blob, None) for k, blob in _pack(h, f, shared, buckets)]
        if len(edges):
            rows.append((int(edges[0, 0] % buckets), None, edges.astype("<i8").tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "pairs", "edges"])

    def send(batches):
        hashes, names, held = [], [], 0
        for b in batches:
            for name, blob in zip(b["name"], b["hashes"]):
                p = np.frombuffer(blob, dtype=np.uint64)
                hashes.append(p)
                names.append(np.full(len(p), name, dtype=np.int64))
                held += len(p)
                if held > FLUSH_ENTRIES:
                    yield settle(hashes, names)
                    hashes, names, held = [], [], 0
        if held:
            yield settle(hashes, names)

    def chain(pdf):
        pairs = [np.frombuffer(x, dtype="<i8").reshape(-1, 2) for x in pdf["edges"].dropna()]
        if pdf["pairs"].notna().any():
            h, f, _ = _unpack(pdf["pairs"].dropna())
            h, f, _ = _sorted_pairs(h, f)
            pairs.append(chains(h, f))
        every = np.unique(np.concatenate(pairs), axis=0)
        return pd.DataFrame({"src": every[:, 0], "dst": every[:, 1]})

    entries = sets.agg(F.sum("n")).first()[0] or 0
    rarest = _rarest(sets, max(shuffle_partitions(sets.sparkSession), -(-entries // COUNTED_ENTRIES)))
    sent = rarest.mapInPandas(send, "bucket long, pairs binary, edges binary")
    return sent.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(chain, "src long, dst long")


def _bound(bits, n, i, j):
    """(NUM + DEN) times an upper bound of how many hashes set i has in common with each of j."""
    theirs = bits[j]
    missing = np.bitwise_count(bits[i]).sum(dtype=np.int64) - np.bitwise_count(theirs & bits[i]).sum(axis=1, dtype=np.int64)
    surplus = np.bitwise_count(theirs & ~bits[i]).sum(axis=1, dtype=np.int64)
    return (NUM + DEN) * np.minimum(n[i] - missing, n[j] - surplus)


def links_of(name, n, hashes, side, inside: bool):
    """Star edges (name, root) of the links in a tile block: between sides 0 and 1, and ``inside`` side 0.

    Sets already joined are not compared again: only components matter.
    """
    order = np.argsort(n, kind="stable")
    name, n, side = name[order], n[order], side[order]
    arrays = [np.frombuffer(hashes[i], dtype=np.uint64) for i in order]
    bits = _bitmaps(arrays, n.max(initial=1))
    first = np.ascontiguousarray(bits[:, : bits.shape[1] // 4])
    label, least, left = np.arange(len(n)), NUM * n, len(n)
    for i in range(len(n)):
        if left == 1:
            break
        # partners are later in order of size and at most a third larger
        stop = np.searchsorted(n, n[i] * DEN // NUM, side="right")
        j = np.arange(i + 1, stop)
        meet = side[j] != side[i]
        if inside and side[i] == 0:
            meet |= side[j] == 0
        j = j[meet & (label[j] != label[i])]
        if not len(j):
            continue
        # a quarter of the bits bounds from above too; pairs that it leaves meet all bits
        j = j[_bound(first, n, i, j) >= least[i] + least[j]]
        if not len(j):
            continue
        for k in j[_bound(bits, n, i, j) >= least[i] + least[j]]:
            if label[k] == label[i]:
                continue
            both = len(np.intersect1d(arrays[i], arrays[k], assume_unique=True))
            if DEN * both >= NUM * (n[i] + n[k] - both):
                low, high = sorted((label[i], label[k]))
                label[label == high], left = low, left - 1
    linked = label != np.arange(len(n))
    return name[linked], name[label[linked]]


def _verify(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """(src, dst) star edges of true links between sets of one group."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(DEN / NUM)))).cast("long")
    rows = sets.select("name", "n").join(groups.select(F.col("node").alias("name"), "root"), "name")
    rows = rows_stored = stored(rows.withColumn("band", band), "banded")
    tiles = rows.groupBy("root", "band").agg(F.count("*").alias("m"), F.sum(F.col("n") * (8 + BITS_A_HASH // 4) + BITS // 8).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    tiles = stored(tiles.select("root", "band", "m", blocks.alias("blocks")), "tiles")
    lower = tiles.select("root", (F.col("band") + 1).alias("band"), F.col("blocks").alias("lower"))
    higher = tiles.select("root", (F.col("band") - 1).alias("band"), F.col("blocks").alias("higher"))
    rows = rows.join(tiles, ["root", "band"]).join(lower, ["root", "band"], "left").join(higher, ["root", "band"], "left")
    rows = rows.withColumn("mine", F.pmod("name", F.col("blocks").cast("long")).cast("int"))
    # a set without another in its band and the next meets nothing there
    alone = (F.col("m") == 1) & F.col("higher").isNull()
    shape = "array<struct<band:bigint,a:int,z:int,guests:int>>"
    task = lambda d, a, z, g: F.struct((F.col("band") - d).alias("band"), a.alias("a"), z.alias("z"), g.alias("guests"))
    # each block meets itself and every other block of its tile, and each block of the band above
    home = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: task(0, F.least(F.col("mine"), o), F.greatest(F.col("mine"), o), F.lit(0)))
    more = F.when(F.col("higher") > 1, F.transform(F.sequence(F.lit(1), F.col("higher") - 1), lambda g: task(0, F.col("mine"), F.col("mine"), g)))
    above = F.transform(F.sequence(F.lit(0), F.col("lower") - 1), lambda o: task(1, o, o, F.col("mine")))
    none = F.array().cast(shape)
    targets = F.concat(F.when(alone, none).otherwise(home), F.coalesce(more, none), F.coalesce(above, none))
    plan = rows.select("name", "n", "root", F.col("band").alias("own_band"), "mine", targets.alias("targets"))
    plan = stored(plan.where(F.size("targets") > 0), "plan")
    dealt_bytes = plan.agg(F.sum(F.size("targets") * (8 * F.col("n") + 64))).first()[0] or 0
    tasks = max(shuffle_partitions(sets.sparkSession), -(-dealt_bytes // TASK_BYTES))
    narrow = plan.select("name", "root", "own_band", "mine", "targets").hint("merge")
    dealt = sets.join(narrow, "name").select("root", F.explode("targets").alias("t"), "name", "n", "hashes", "own_band", "mine")
    keys = ["root", "band", "a", "z", "guests"]
    dealt = dealt.select("root", "t.*", "name", "n", "hashes", "own_band", "mine").repartition(tasks, *keys)

    def tile(pdf):
        # sets of the band above are foreign: they meet each other in their own tile, as do those of a block
        one = pdf.iloc[0]
        foreign = (pdf["own_band"] != one["band"]).to_numpy()
        alone = one["a"] == one["z"]
        side = foreign if alone else (pdf["mine"] != one["a"]).to_numpy()
        a, b = links_of(pdf["name"].to_numpy(), pdf["n"].to_numpy(), pdf["hashes"].to_list(), side, bool(alone and one["guests"] == 0))
        return pd.DataFrame({"src": a, "dst": b})

    found = stored(dealt.groupBy(*keys).applyInPandas(tile, "src long, dst long"), "linked")
    drop_stored(rows_stored, tiles, plan)
    return found


def _rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names and marks of all documents, and (name, mark, doc_id, root) of every set: its least doc_id and its component; both stored.

    ``docs``: doc_id, text, rid. A document is looked up again by a hash of its doc_id and text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "rid", "text")
    buckets = max(shuffle_partitions(docs.sparkSession), docs.count() // 4000)
    scanned = scan_sets(docs, buckets)
    names = scanned.where("part is null").select("doc_id", "key", "rid", "n", "name", "mark")
    names._tessella_path = scanned._tessella_path  # goes with the scan
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    reps = names.where("name is not null").groupBy("name", "mark").agg(F.min("n").alias("n"), first)
    nth = F.row_number().over(Window.partitionBy("name").orderBy("mark"))
    own = F.when(nth == 1, F.col("name")).otherwise(F.xxhash64("name", "mark").bitwiseAND(F.lit((1 << 63) - 1)))
    reps = stored(reps.select(own.alias("id"), "name", "mark", "n", "first.doc_id", "first.key"), "reps")
    smallest = F.expr(f"(n * {NUM} + {DEN - 1}) div {DEN}")
    need = F.greatest(F.lit(1), F.floor(smallest * EXTRA))
    wanted = reps.withColumn("short", F.col("name").bitwiseAND(F.lit(SHORT))).join(_shared_counts(scanned), "short").where(F.col("c") >= need)
    wanted = stored(wanted.select("id", "name", "mark", "key", "n"), "wanted")
    words = wanted.agg(F.sum("n")).first()[0] or 0
    sets = _sets(docs, wanted, max(shuffle_partitions(docs.sparkSession), -(-8 * words // TASK_BYTES)))
    groups = connected_components(_group_edges(sets, buckets))
    edges = _verify(sets, groups)
    drop_stored(sets)
    roots = connected_components(edges)
    by_set = reps.join(roots.withColumnRenamed("node", "id"), "id", "left")
    by_set = stored(by_set.select("name", "mark", "doc_id", F.coalesce("root", "id").alias("root")), "roots")
    drop_stored(reps, wanted, groups, edges, roots)
    return names, by_set


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id.

    Null and empty texts have an empty set and no links. Documents with equal
    sets are linked. Rows that repeat a doc_id each get a row; if their texts
    differ their components are still told apart. Null doc_ids are linked like
    others, but a component is named by its smallest doc_id that is not null.
    An empty table gives no rows. A text is shingled whole, in memory in
    proportion to it. Other columns, whatever their names, are not looked at.
    """
    with small_batches(docs.sparkSession):
        names, by_set = _rooted(docs.select("doc_id", "text", F.lit(0).cast("long").alias("rid")))
    least = stored(by_set.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    final = stored(by_set.join(least, "root").select(F.col("name").alias("set_name"), F.col("mark").alias("set_mark"), "component_id"), "final")
    drop_stored(by_set, least)
    out = names.join(final, (names["name"] == final["set_name"]) & (names["mark"] == final["set_mark"]), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _placed(docs: DataFrame) -> DataFrame | None:
    """(row, rid) of rows read from Parquet files, rid by file and place there; None where rows do not tell their place."""
    try:
        at = docs.metadataColumn("_metadata")
        rows = whole_rows(docs, at["file_path"].alias("file"), at["row_index"].alias("place"))
    except AnalysisException:
        return None
    files = sorted(r["file"] for r in rows.select("file").distinct().collect())
    numbers = docs.sparkSession.createDataFrame([(f, i) for i, f in enumerate(files)], "file string, number long")
    return rows.join(F.broadcast(numbers), "file").select("row", (F.shiftleft("number", 40) + F.col("place")).alias("rid"))


def distinct_documents(docs: DataFrame, spent: bool = False, in_files: bool = False) -> DataFrame:
    """One row of ``docs`` of each component: that with the least doc_id, nulls last.

    Rows are told apart by their number, so rows that repeat a doc_id or have
    none are documents of their own; of equal doc_ids the first row stays.
    Rows with an empty set are components of their own and all stay. All
    columns are kept, whatever their names. ``spent``: ``docs``, if ``stored``
    wrote it, is deleted once its rows are numbered. ``in_files``: ``docs`` is
    as read from Parquet files, so its rows have numbers there and are not
    written again; the files must stay until the result is written.
    """
    rows = _placed(docs) if in_files else None
    if rows is None:
        rows = stored(whole_rows(docs).withColumn("rid", F.monotonically_increasing_id()), "numbered")
    if spent:
        drop_stored(docs)
    with small_batches(docs.sparkSession):
        names, by_set = _rooted(rows.select("row.doc_id", "row.text", "rid"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    first = names.where("name is not null").groupBy("name", "mark").agg(F.min(order).alias("first"))
    first = first.join(by_set.select("name", "mark", "root"), ["name", "mark"]).groupBy("root").agg(F.min("first").alias("first"))
    kept = first.select("first.rid").unionByName(names.where("name is null").select("rid"))
    kept = stored(kept, "kept").hint("merge")
    drop_stored(names, by_set)
    return rows.join(kept, "rid", "left_semi").select("row.*")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, [translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    for x in regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
"""
