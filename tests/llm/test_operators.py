import gzip
import hashlib
import math
import os
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.llm import common, components, licenses, lines, mixing, ngram_join, packing, secrets, toxicity, vectors, vptree, warc

DOCS = "doc_id long, text string, source string, extra string, n long"
rnd = random.Random(7)
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(rnd.choice(WORDS) for _ in range(3000))
BASE = [rnd.choice(WORDS) for _ in range(80)]
PASSAGE = "\n".join(" ".join(rnd.choice(WORDS) for _ in range(20)) for _ in range(4))


def _near(k):
    w = list(BASE)
    w[k] = "changed"
    return " ".join(w)


ROWS = [
    (1, " ".join(BASE), "a", "x", 1),
    (2, _near(3), "a", "x", 2),
    (3, _near(40), "b", None, 3),
    (4, " ".join(BASE), None, "x", 4),
    (5, None, "b", "x", 5),
    (6, "", "a", "x", 6),
    (7, "one two", "a", "x", 7),
    (8, "One\ttwo", "c", "x", 8),
    (9, LONG, "a", "x", 9),
    (9, LONG, "a", "x", 9),
    (10, "head\n" + PASSAGE + "\ntail", "b", "x", 10),
    (11, "other\n" + PASSAGE + "\nend", "c", "x", 11),
    (12, ' token = "abcdef0123456789abcdef0123" AKIA' + "A1" * 10, "a", "x", 12),
    (None, "no id here", "c", "x", 13),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (None, 1), (10, 9), (4, 5)], "src long, dst long")
    assert {r["node"]: r["root"] for r in components.connected_components(e).collect()} == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8, 10: 8}


def test_mixing_reaches_targets_and_copies_rows(spark, docs, none):
    big = spark.createDataFrame([(i, "w " * (1 + i % 7), "abc"[i % 3] if i % 10 else None) for i in range(2000)], "doc_id long, text string, source string")
    got = mixing.mix_sources(big).toPandas()
    assert (got["taken"] <= 3 * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max()
        assert g["target"].iloc[0] <= 3 * g["source_size"].iloc[0]
    same = spark.createDataFrame([(1, "w w w", "a")] * 700 + [(2, "w", "a")] * 40 + [(i, "w w", "b") for i in range(900)], "doc_id long, text string, source string").repartition(7)
    rows = mixing.mix_sources(same).toPandas()
    for _, g in rows.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 3
    assert mixing.mixed_documents(same).count() == rows["times"].sum()
    assert mixing.mix_sources(none).count() == 0
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    want = {r["doc_id"]: r["times"] for r in mixing.mix_sources(docs).collect() if r["doc_id"] != 9}
    have = {r["doc_id"]: r["count"] for r in rows.where("doc_id <> 9").groupBy("doc_id").count().collect()}
    assert have == {k: v for k, v in want.items() if v and k is not None}


def _brute_groups(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    ids = {}
    for r, c in zip(rows, label):
        if r[0] is not None:
            ids[c] = min(ids.get(c, r[0]), r[0])
    return sorted(((r[0], len(s), ids.get(c)) for r, s, c in zip(rows, sets, label)), key=str)


def test_jaccard_equals_brute_force(spark, docs, none, monkeypatch):
    r = random.Random(1)
    rows = list(ROWS)
    for i in range(60):
        w = list(BASE[: r.randint(20, 80)])
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        rows.append((100 + i, " ".join(w), "a", "x", i))
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, DOCS))
    assert sorted(map(tuple, got.collect()), key=str) == _brute_groups(rows)
    # null and repeated ids, texts of their own each, and many sets that share a passage
    for i in range(500):
        w = [*BASE[:30], *[r.choice(WORDS) for _ in range(r.randint(0, 12))]]
        rows.append((None if i % 2 else 7000 + i % 9, " ".join(w), "a", "x", i))
    rows += [(None, "the same five words here", "b", "y", 1)] * 40
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 64)
    monkeypatch.setattr(ngram_join, "FLUSH_ENTRIES", 700)
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, DOCS).repartition(8))
    assert sorted(map(tuple, got.collect()), key=str) == _brute_groups(rows)
    assert ngram_join.jaccard_groups(none).count() == 0
    kept = [x["doc_id"] for x in ngram_join.distinct_documents(docs).collect()]
    assert 1 in kept and not {2, 3, 4, 8} & set(kept) and {5, 6, 7, 9, None} <= set(kept)


def test_sets_of_one_name_are_told_apart(spark, monkeypatch):
    exact = ngram_join.set_name

    def clashing(s):
        return (1 if len(s) in (36, 46) else exact(s)[0]), exact(s)[1]

    monkeypatch.setattr(ngram_join, "set_name", clashing)
    long, short = [f"p{i}" for i in range(50)], [f"q{i}" for i in range(40)]
    rows = [(5, " ".join(long), "a", "x", 1), (3, " ".join([*long, "more"]), "a", "x", 2), (9, " ".join(short), "a", "x", 3)]
    rows += [(7, " ".join([*short, "more"]), "a", "x", 4), (8, " ".join(short), "b", "x", 5), (6, " ".join(long), "b", "x", 6)]
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, DOCS))
    assert sorted(map(tuple, got.collect())) == [(3, 47, 3), (5, 46, 3), (6, 46, 3), (7, 37, 7), (8, 36, 7), (9, 36, 7)]
    kept = ngram_join.distinct_documents(spark.createDataFrame(rows, DOCS))
    assert sorted(x["doc_id"] for x in kept.collect()) == [3, 7]


def test_quoted_passages_do_not_chain_sets(spark, monkeypatch):
    r = random.Random(4)
    passages = [[f"p{k}x{i}" for i in range(30)] for k in range(40)]
    texts = [[*passages[i % 40], *[f"own{i}x{j}" for j in range(60)], *passages[(i * 7 + 1) % 40]] for i in range(200)]
    texts += [[*t[:100], f"end{i}"] for i, t in enumerate(texts[:50])]
    cache = ngram_join._WordHashes()
    sets = [ngram_join.shingle_set(" ".join(t), cache) for t in texts]
    order = r.sample(range(250), 250)
    rows = [(i, len(sets[i]), bytearray(sets[i].tobytes())) for i in order]
    monkeypatch.setattr(ngram_join, "FLUSH_ENTRIES", 3000)
    for common in (256, 3):  # with few sets a task, hashes that are common there are not asked for
        monkeypatch.setattr(ngram_join, "COMMON", common)
        df = spark.createDataFrame(rows, "name long, n long, hashes binary").repartition(3)
        groups = components.connected_components(ngram_join._group_edges(df, 4)).collect()
        root = {g["node"]: g["root"] for g in groups}
        # all links are within groups; passages alone made one group of all before
        assert all(root[i] == root[200 + i] for i in range(50))
        if common == 256:
            assert len(root) == 100 and len(set(root.values())) == 50


def test_spent_input_of_the_near_copies_stage_is_deleted(spark):
    rows = [(i, " ".join(BASE[: 30 + i % 3]), "a", "x", i) for i in range(6)]
    docs = common.stored(spark.createDataFrame(rows, DOCS), "spent")
    out = ngram_join.distinct_documents(docs, spent=True)
    assert not os.path.exists(docs._tessella_path)
    assert [x["doc_id"] for x in out.collect()] == [0]


def test_texts_are_sieved_by_keys(spark, monkeypatch):
    docs = spark.range(2000).select(F.xxhash64("id").alias("key"), "id")
    wanted = docs.where("id % 50 = 0").select("key")
    kept = {x["id"] for x in ngram_join._sieved(docs, wanted).collect()}
    assert set(range(0, 2000, 50)) <= kept and len(kept) < 400
    monkeypatch.setattr(ngram_join, "SIEVE_MOST", 64)
    kept = {x["id"] for x in ngram_join._sieved(docs, wanted).collect()}
    assert set(range(0, 2000, 50)) <= kept


def test_one_row_of_each_component_stays(spark):
    base, far = " ".join(BASE), " ".join(f"x{i}" for i in range(60))
    rows = [(None, _near(3), "a", "null copy", 1), (None, base, "a", "null copy", 2), (4, base, "b", "kept", 3), (9, _near(7), "a", "copy", 4)]
    rows += [(4, far, "b", "copy of 2", 5), (2, far, "b", "kept", 6)] + [(7, far + " y", "c", "copy of 2", 7 + i) for i in range(20)]
    rows += [(None, " ".join(f"z{i}" for i in range(40)), "a", "alike", 30 + i) for i in range(30)]
    rows += [(8, "same words here", "a", "same", 70 + i) for i in range(3)] + [(5, None, "a", "empty", 80), (5, "", "a", "empty", 81), (None, " ", "a", "empty", 82)]
    out = ngram_join.distinct_documents(spark.createDataFrame(rows, DOCS))
    got = sorted((tuple(r) for r in out.collect()), key=lambda r: r[4])
    assert [r for r in got if r[4] not in range(30, 60) and r[4] not in range(70, 73)] == [rows[2], rows[5], *rows[-3:]]
    assert sum(r[3] == "alike" for r in got) == 1 and sum(r[3] == "same" for r in got) == 1 and len(got) == 7


def test_line_dedup_removes_later_runs_alone(spark, docs, none):
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert got[10]["text"] == ROWS[10][1] and got[11]["text"] == "other\nend" and got[11]["removed"] == [1, 2, 3, 4]
    assert got[4]["empty"] and got[1]["text"] == ROWS[0][1] and got[7]["text"] == "one two"
    assert got[5]["text"] is None and got[6]["text"] == "" and got[9]["text"] == LONG
    assert lines.dedup_lines(none).count() == 0 and lines.deduped_documents(docs).columns == docs.columns
    assert 4 not in [r["doc_id"] for r in lines.deduped_documents(docs).collect()]


def test_secrets(spark, docs, none):
    got = {r["doc_id"]: r for r in secrets.scan_secrets(docs).collect()}
    t = ROWS[12][1]
    spans = []
    for kind, p in (("assign", secrets.ASSIGN), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")):
        for m in re.finditer(p, t):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                spans.append((m.start(), kind, m.end()))
    order = ["assign", "access", "hex"]
    joined = ",".join(f"{k}:{b}:{e}" for b, k, e in sorted(spans, key=lambda s: (s[0], order.index(s[1]))))
    assert got[12]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
    assert (got[12]["n_assign"], got[12]["n_access"], got[12]["n_hex"]) == (1, 1, 1)
    assert got[5]["spans"] == "" and got[5]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert len(secrets.scan_secrets(docs).collect()) == len(ROWS) and secrets.scan_secrets(none).count() == 0
    shared = spark.createDataFrame([(i, "x token=abcdefgh", s) for i, s in enumerate("abcd")] + [(9, "x token=ijklmnop", "a")], "doc_id long, text string, source string")
    by = {r["doc_id"]: (r["n_live"], r["n_copied"]) for r in secrets.scan_secrets(shared).collect()}
    assert by == {0: (0, 1), 1: (0, 1), 2: (0, 1), 3: (0, 1), 9: (1, 0)}


def test_warc_round_trip_and_salvage(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, "u", None), (4, "u", "WARC/1.1\r\nx"), (5, None, "ü" * 9), (None, "u", "")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    got = {r["page_id"]: r for r in warc.read_pages(spark, str(tmp_path / "w")).collect()}
    assert len(got) == 6 and got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 2 and got[5]["payload_bytes"] == 18
    assert got[None]["record_type"] == "revisit" and got[3]["payload_digest"] == warc._sha1(b"")
    warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_pages(spark, str(tmp_path / "e")).count() == 0

    def record(body):
        return b"WARC/1.1\r\nWARC-Block-Digest: sha1:" + warc._sha1(body).encode() + b"\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"

    good = [record(b"one"), record(b"two"), record(b"three")]
    bad = good[1].replace(b"two", b"tXo")
    found = list(warc.salvage(good[0] + bad + b"junk" + good[2]))
    assert [(x[0], x[1], x[2]) for x in found] == [("record", 0, len(good[0])), ("gap", len(good[0]), len(good[0] + bad) + 4), ("record", len(good[0] + bad) + 4, len(good[0] + bad + good[2]) + 4)]
    assert found[1][5] == "digest"
    members = [gzip.compress(x) for x in good]
    broken = bytearray(members[1])
    broken[-6] ^= 255
    found = list(warc.salvage(members[0] + bytes(broken) + members[2]))
    assert [x[4] for x in found if x[0] == "record"] == [b"one", b"three"] or [x[4] for x in found if x[0] == "record"] == [b"one", b"two", b"three"]
    assert any(x[0] == "gap" for x in found)


def test_warc_keeps_pages_with_long_urls(spark, tmp_path):
    url = "http://host/" + "é" * 100_000
    pages = spark.createDataFrame([(1, url, "one"), (2, "u" * 65_600, "two"), (3, url, "one")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    rows = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert [r["kind"] for r in rows] == ["record"] * 3 and [r["target_uri"] for r in rows].count(url) == 2
    assert {r["page_id"]: r["refers_to"] for r in warc.read_pages(spark, str(tmp_path / "w")).collect()} == {1: 3, 2: None, 3: None}


def _archives(path):
    return [p.read_bytes() for p in sorted(path.iterdir()) if p.name.startswith("part-")]


def test_warc_salvages_damaged_archives_of_the_writer(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h/{i}", f"page {i} " + " ".join(rnd.choice(WORDS) for _ in range(200))) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"))
    (tmp_path / "d").mkdir()
    lost = 0
    for k, data in enumerate(_archives(tmp_path / "w")):
        assert b"".join(x[4] for x in warc.salvage(gzip.decompress(data))) == b"".join(x[4] for x in warc.salvage(data))
        assert all(x[0] == "record" for x in warc.salvage(data)) and list(warc.salvage(data))[-1][2] == len(data)
        broken, lost = bytearray(data), lost + 1
        middle = len(data) // 2
        broken[middle : middle + 40] = b"\xff" * 40
        (tmp_path / "d" / f"{k}").write_bytes(bytes(broken))
    got = warc.read_archives(spark, str(tmp_path / "d")).collect()
    ids = {r["record_id"] for r in got if r["kind"] == "record"}
    assert lost and len(rows) - 2 * lost <= len(ids) < len(rows) and any(r["kind"] == "gap" for r in got)
    warc.write_archives(pages, str(tmp_path / "p"), compression="none")
    assert [r["kind"] for r in warc.read_archives(spark, str(tmp_path / "p")).collect()] == ["record"] * 300
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    warc.write_archives(pages, str(tmp_path / "s"))
    sizes = [len(x) for x in _archives(tmp_path / "s")]
    assert len(sizes) > 3 and max(sizes) < 25_000 and warc.read_pages(spark, str(tmp_path / "s")).count() == 300


def test_damaged_records_alone_are_lost_and_logged(spark, tmp_path):
    rows = [(i, "u", f"page {i} " + "text " * (i % 40)) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"), compression="none")
    (tmp_path / "d").mkdir()
    for k, data in enumerate(_archives(tmp_path / "w")):
        for i in (3, 50, 51, 199):
            data = data.replace(f"page {i} ".encode(), f"Page {i} ".encode())
        (tmp_path / "d" / str(k)).write_bytes(data)
    got = warc.read_pages(spark, str(tmp_path / "d"), str(tmp_path / "gaps"))
    assert {r["page_id"] for r in got.collect()} == set(range(200)) - {3, 50, 51, 199}
    gaps = spark.read.parquet(str(tmp_path / "gaps")).collect()
    assert gaps and all(g["reason"] == "digest" and g["end"] > g["start"] for g in gaps)


def test_salvage_is_linear():
    bad = b"".join(b"WARC/1.1\r\nWARC-Block-Digest: sha1:X\r\nContent-Length: 2000\r\n\r\n" + b"x" * 2000 + b"\r\n\r\n" for _ in range(4000))
    began = time.time()
    found = list(warc.salvage(bad))
    assert [x[0] for x in found] == ["gap"] and found[0][2] == len(bad) and time.time() - began < 2


def test_damaged_member_gives_all_before_the_damage():
    def record(body):
        return b"WARC/1.1\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"

    plain = b"".join(record(b"%d " % i + b"x" * (i % 50)) for i in range(1000))
    box = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = box.compress(plain) + box.flush(zlib.Z_FULL_FLUSH)
    data = head + b"\xff" * 3000  # no block has type 3
    assert warc._member(data, 0)[0] == plain
    assert sum(x[0] == "record" for x in warc.salvage(data)) == 1000


def test_patience_alignment():
    assert licenses.align("a b c d".split(), "x a c b d y".split()) in ([(0, 1), (1, 3), (3, 4)], [(0, 1), (2, 2), (3, 4)])
    known = licenses.known_templates()
    text = "the the license is of the.\n" * 40 + "RELEASED!! under the MIT License." + " license the under" * 50
    assert [h[:2] for h in licenses.find_licences(text, known)] == [("MIT", 1.0)]
    assert licenses.find_licences("under the license of the trees", known) == []
    twice = "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."
    assert licenses.find_licences(twice, known)[0][:2] == ("CC-BY-NC-4.0", 1.0)


def _common_length(a, b):
    """Words of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            row[j + 1], before = (before + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def test_licences_equal_a_full_search():
    """What is found is exactly the best of all passages of a text, each aligned."""
    r = random.Random(11)
    few = {k: licenses.TEMPLATES[k] for k in ("MIT", "GPL-3.0", "MPL-2.0-notice", "WTFPL", "Apache-2.0")}
    known = [t for t in licenses.known_templates() if t.name in few]
    seen = set()
    for _ in range(60):
        name, text = r.choice(list(few.items()))
        words, broken = text.split(), r.choice((0.0, 0.0, 0.06, 0.25))
        words = [r.choice(["of", "the", "license", "zz"]) if r.random() < broken else w for w in words]
        for _ in range(int(len(words) * r.choice((0, 0.3, 1.2)))):
            words.insert(r.randrange(len(words)), r.choice(WORDS))
        noise = lambda: [r.choice([*WORDS[:30], "the", "of", "is", "license", "version"]) for _ in range(r.randrange(40))]
        whole = " ".join([*noise(), *words, *noise()])
        plain = [licenses.plain(w) for w in whole.split()]
        want = {}
        for t in known:
            passages = [(plain[b : b + t.longest], b) for b in range(len(plain))]
            found = [(len(p), -b) for p, b in ((t.aligned(x), b) for x, b in passages) if p]
            # patience alignment never finds more than the longest common subsequence
            assert all(n <= _common_length(t.words, plain[-b : t.longest - b]) for n, b in found[:3])
            if found:
                want[t.name] = max(found)[0]
        got = licenses.find_licences(whole, known)
        assert {h[0]: h[2] for h in got} == want and [h[2] for h in got] == sorted(want.values(), reverse=True)
        seen.add(bool(got))
    assert seen == {True, False}


def test_short_licences_equal_an_enumeration():
    """A short template is found where all its words stand in order within its stretch, and its name unbroken."""
    r = random.Random(5)
    t = next(t for t in licenses.known_templates() if t.name == "MIT")
    seen = set()
    for _ in range(400):
        words = [r.choice(["released", "under", "the", "mit", "license", "x"]) for _ in range(r.randrange(5, 25))]
        if r.random() < 0.5:
            k = r.randrange(len(words))
            words[k:k] = ["released", "under", *(["x"] * r.randrange(4)), "the", "mit", *(["x"] * (r.random() < 0.2)), "license"]
        want = False
        for m in range(len(words) - 1):  # the name at m, m + 1, the other words before it
            if words[m : m + 2] == ["mit", "license"]:
                low, k = m - 1, 2
                while low >= 0 and k >= 0:
                    k -= words[low] == t.words[k]
                    low -= 1
                want |= k < 0 and m + 2 - (low + 1) <= t.longest
        got = licenses.find_licences(" ".join(words), [t])
        assert not got or want  # never a wrong one
        seen.add((want, bool(got)))
    assert (True, True) in seen and (False, False) in seen


@pytest.mark.parametrize(
    ("text", "licence"),
    [
        ("Released under the BSD License.", None),
        ("Released under the Apache License.", None),
        ("This work is licensed under the GNU General Public License, version 2.", None),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", None),
        ("Licensed under the Apache License, Version 1.1.", None),
        ("Licensed under CC BY 4.0.", None),
        ("Licensed under CC BY-SA 4.0.", None),
        ("It is released under the MIT license, as ever.", "MIT"),
        (licenses.TEMPLATES["GPL-3.0-notice"].replace("version 3", "version 2"), None),
        (licenses.TEMPLATES["GPL-3.0-notice"].replace("GNU General", "GNU Affero General"), None),
        (licenses.TEMPLATES["Apache-2.0-notice"].replace("specific", "general"), "Apache-2.0-notice"),
        (licenses.TEMPLATES["Apache-2.0-notice"].replace("Version 2.0", "Version 1.1"), None),
        (licenses.TEMPLATES["BSD-3-Clause"] + " Released under the MIT License.", "BSD-3-Clause"),
        (licenses.TEMPLATES["BSD-2-Clause"], "BSD-2-Clause"),
    ],
)
def test_names_and_versions_tell_licences_apart(text, licence):
    got = licenses.find_licences(text, licenses.known_templates())
    assert (got[0][0] if got else None) == licence
    if licence and len(text) > 100:
        assert got[0][4] - got[0][3] > 0.8 * len(text.strip())


def test_whole_licences_are_covered():
    known = licenses.known_templates()
    for k, v in licenses.TEMPLATES.items():
        text = "Copyright 2020 someone\n" + v.replace(". ", ".\n * ") + "\nand more words after it"
        name, coverage, matched, start, end = licenses.find_licences(text, known)[0]
        assert (name, coverage) == (k, 1.0) and start >= 22 and end <= len(text) - 24, k


def test_licences_on_all_rows(docs, none):
    got = licenses.scan_licences(docs).collect()
    assert len(got) == len(ROWS) and all(r["licence"] is None for r in got) and licenses.scan_licences(none).count() == 0


VECS = "vec_id long, embedding array<float>, other string"


def _vectors(spark):
    g = np.random.default_rng(0)
    x = g.normal(size=(300, 8))
    x[100:140] = x[3] + g.normal(scale=0.15, size=(40, 8))
    x[140:150] = x[5]
    rows = [(i, [float(v) for v in r], "o") for i, r in enumerate(x)]
    rows += [(400, None, "o"), (401, [0.0] * 8, "o"), (402, [float("nan")] * 8, "o"), (403, [1.0, None], "o"), (404, [1.0, 2.0], "o"), (405, [], "o"), (7, rows[7][1], "o")]
    return rows


def _usable(v):
    return v and all(a is not None and math.isfinite(a) for a in v) and any(v)


def test_range_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 1)  # 64 rows a block
    rows = _vectors(spark)
    ok = [i for i, r in enumerate(rows) if _usable(r[1])]
    v = {i: np.array(rows[i][1], dtype=np.float32).astype(float) for i in ok}
    links = {i: [j for j in ok if j != i and len(v[i]) == len(v[j]) and v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) >= 0.9] for i in ok}
    label = list(range(len(rows)))
    for i in ok:
        for j in links[i]:
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    least = {}
    for r, c in zip(rows, label):
        least[c] = min(least.get(c, r[0]), r[0])
    want = sorted((r[0], len(links.get(i, [])), least[label[i]], r[0] == least[label[i]]) for i, r in enumerate(rows))
    got = sorted(map(tuple, vectors.range_join(spark.createDataFrame(rows, VECS)).collect()))
    assert got == want
    assert vectors.range_join(spark.createDataFrame([], VECS)).count() == 0


def test_cells_are_many_and_copies_linear_on_separated_clusters(spark):
    g = np.random.default_rng(2)
    centres = np.eye(16)
    copied = []
    for n in (1000, 2000, 4000):
        x = centres[np.arange(n) % 16] + g.normal(scale=0.01, size=(n, 16))
        points = spark.createDataFrame([(i, 1, [float(v) for v in r]) for i, r in enumerate(x)], "rid long, m long, v array<double>").cache()
        cells = vectors.Cells(vectors.choose_pivots(points, 16), math.sqrt(0.2))
        counted = cells.count(points)
        assert len(counted) >= 8 and sum(r for r, _, _ in counted.values()) == n and not any(v for _, v, _ in counted.values())
        dealt = vectors.deal(points, cells, *vectors.layout(counted, 1))
        copied.append(dealt.where("home").agg(F.sum(F.length("ids")) / 8).first()[0])
    assert copied[0] == 1000 and copied[1] <= 2 * copied[0] * 1.5 and copied[2] <= 2 * copied[1] * 1.5


def test_equal_vectors_are_one_point(spark):
    rows = [(i, [1.0, 2.0], i) for i in range(3000)] + [(5000, [2.0, 4.0], 1), (5001, [2.0, -1.0], 2), (None, [1.0, 2.0], 3)]
    got = {r["vec_id"]: tuple(r)[1:] for r in vectors.range_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rid int")).collect()}
    assert got[0] == (3001, 0, True) and got[2999] == (3001, 0, False) and got[5000] == (3001, 0, False) and got[5001] == (0, 5001, True) and got[None] == (3001, 0, False)


def test_recall_falls_as_the_factor_grows(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(2000, 6))
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    full = {(r["query_id"], r["vec_id"]) for r in vptree.nearest(frame).collect()}
    recall = [len(full & {(r["query_id"], r["vec_id"]) for r in vptree.nearest(frame, factor=f).collect()}) / len(full) for f in (1.0, 1.5, 4.0)]
    assert recall[0] == 1.0 and recall[1] >= 0.9 and recall[1] >= recall[2]


def test_products_computed_and_recall_on_the_given_vectors():
    """Nearly orthogonal vectors in 64 dimensions: the exact search skips nothing, a factor trades products for recall."""
    given = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    frame = pd.DataFrame({"vec_id": given["vec_id"], "rid": range(len(given)), "v": [np.asarray(e, float) for e in given["embedding"]]})
    found = {}
    for factor in (1.0, 8.0, 16.0):
        shard = vptree.Shard(frame, 20, leaf=32)
        queries = frame[frame["vec_id"] % 20 == 0]
        found[factor] = {(q, v) for q, _, v, _ in shard.answers(queries, factor)}, shard.computed / len(queries) / len(shard.x)
    x = np.stack(frame["v"])
    own = np.flatnonzero(frame["vec_id"] % 20 == 0)
    products = x[own] @ x.T
    products[np.arange(len(own)), own] = -np.inf
    ids = frame["vec_id"].to_numpy()
    best = {(ids[q], ids[c]) for q, row in zip(own, np.argsort(-products, axis=1, kind="stable")[:, :20]) for c in row}
    recall = {factor: len(best & got) / len(best) for factor, (got, _) in found.items()}
    share = {factor: part for factor, (_, part) in found.items()}
    assert recall[1.0] == 1 and recall[8.0] >= 0.85 and recall[8.0] > recall[16.0]
    assert share[1.0] <= 1.1 and share[8.0] < 0.9 and share[16.0] < 0.4


def test_exact_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD", 100)
    monkeypatch.setattr(vptree, "LEAF", 16)
    rows = _vectors(spark)
    ok = [(i, r[0], np.array(r[1], dtype=np.float32).astype(float)) for i, r in enumerate(rows) if _usable(r[1])]
    want = []
    for i, q, x in ok:
        if q % 20 == 0:
            near = sorted((-float((y * x).sum()), n) for j, n, y in ok if j != i and len(x) == len(y))[:20]
            want += [(q, k + 1, n) for k, (_, n) in enumerate(near)]
    got = vptree.nearest(spark.createDataFrame(rows, VECS)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == sorted(want)
    assert vptree.nearest(spark.createDataFrame([], VECS)).count() == 0


def test_ranks_encode_like_the_tokenizer():
    a, b = packing.default_vocabulary()
    exact, quick = packing._encoders(a, b)
    draw, letters = random.Random(3), [chr(c) for c in range(1, 0x250)]
    for _ in range(300):
        text = "".join(draw.choice(letters + ["  ", " the", "<|endoftext|>", "\n\n"]) for _ in range(60))
        assert exact.encode(text, add_special_tokens=False).ids == quick.encode_ordinary(text)
        assert packing.encode(text + "—日本", a, b) == exact.encode(text + "—日本", add_special_tokens=False).ids


def test_added_tokens_are_encoded_as_by_an_unaltered_tokenizer():
    from tokenizers import Tokenizer

    a, b = packing.default_vocabulary()
    plain = Tokenizer.from_file(a)
    assert packing.encode("a <|endoftext|> b", a, b) == [64, 220, 50256, 275]
    for text in ("<|endoftext|>", "x<|endoftext|><|endoftext|>y\n", "日本 <|endoftext|>", "<|endoftext|", "é <|endoftext|> <|endoftext"):
        for ranks in (b, None):
            assert packing.encode(text, a, ranks) == plain.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(docs, none):
    a, b = packing.default_vocabulary()
    got = packing.pack(docs, a, b, sequence=64, window=256).toPandas()
    assert packing.pack(none).count() == 0
    seqs = got.sort_values(["sequence_id", "offset"])
    for s, g in seqs.groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all()
        assert g["length"].sum() == 64 or s == seqs["sequence_id"].max()
    want = {r[0]: [*packing.encode(r[1] or "", a, b), 0] for r in ROWS if r[0] not in (9, None)}
    for d, ids in want.items():
        pieces = got[got["doc_id"] == d].sort_values("start")
        assert pieces["length"].sum() == len(ids) == pieces["doc_tokens"].iloc[0]
        for p in pieces.itertuples():
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes()) == p.ids_crc32
    assert got["length"].sum() == sum(len(packing.encode(r[1] or "", a, b)) + 1 for r in ROWS)


def _fluid(totals, weights, upto):
    """Tokens sent by each queue when ``upto`` are out, by stepping from one dry queue to the next."""
    left, sent, out = [Fraction(t) for t in totals], [Fraction(0)] * len(totals), Fraction(0)
    while out < upto:
        live = [s for s in range(len(totals)) if left[s] > 0]
        weight = sum(weights[s] for s in live)
        step = min(Fraction(upto) - out, min(left[s] * weight / weights[s] for s in live))
        for s in live:
            left[s] -= step * weights[s] / weight
            sent[s] += step * weights[s] / weight
        out += step
    return [math.floor(x) for x in sent]


def test_windows_hold_target_proportions_and_carry_deficits():
    for totals, weights, window in (([7000, 2000, 1000], None, 1000), ([7013, 1999, 3, 511], None, 97), ([7013, 1999, 3, 511], [1, 2, 3, 4], 97), ([1, 5000], [999, 1], 64)):
        plan = packing.Schedule(totals, weights or totals, window)
        assert plan.sent(plan.windows).tolist() == totals
        for w in range(plan.windows):
            assert plan.sent(w).tolist() == _fluid(totals, weights or totals, w * window)
        for s, t in enumerate(totals):
            for at in {0, t // 3, t - 1}:
                w = plan.window_of(s, at)
                assert plan.sent(w)[s] <= at < plan.sent(w + 1)[s]
        rows, begins, sizes, places = packing.place([0] * len(totals), list(range(len(totals))), totals, plan, 64)
        taken = sorted((p, n) for p, n in zip(places, sizes))
        assert [p for p, _ in taken] == [sum(n for _, n in taken[:k]) for k in range(len(taken))] and sum(sizes) == sum(totals)
    assert packing.whole_weights([0.5, 0.25, "0.1"]) == [10, 5, 2]


def test_pack_to_proportions_asked_for(spark, monkeypatch):
    a, b = packing.default_vocabulary()
    rows = [(i, "word " * (3 + i % 50), "abc"[i % 3] if i % 5 else None, str(i)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, queue string").repartition(3)
    whole = sum(len(packing.encode(r[1], a, b)) + 1 for r in rows)
    for queues in (1024, 2):
        monkeypatch.setattr(packing, "QUEUES", queues)
        got = packing.pack(docs, a, b, sequence=64, window=512, proportions={"a": 0.5, None: 0.25}).toPandas()
        at = got["sequence_id"] * 64 + got["offset"]
        order = got.assign(at=at).sort_values("at")
        assert (order["at"] == order["length"].cumsum() - order["length"]).all() and got["length"].sum() == whole
        if queues == 1024:
            first = got[at < 1024].groupby(got["source"].fillna("none"))["length"].sum() / got[at < 1024]["length"].sum()
            # a 0.5, none 0.25, b and c 1 each, of 2.75
            assert abs(first["a"] - 0.5 / 2.75) < 0.02 and abs(first["none"] - 0.25 / 2.75) < 0.02 and abs(first["b"] - 1 / 2.75) < 0.02


def test_chain_marginals_equal_enumeration():
    m = toxicity.Chain({"bad": 2.0}, -1.0, -3.0, (-2.0, 0.3, 0.7), (0.0, 1.0, 0.0))
    words = ["x", "bad", "y", "bad", "z"]
    scores = np.array([m.emission(w) for w in words])
    total, at, chance = m.marginals(scores)
    z, hot = 0.0, [0.0] * 5
    for k in range(32):
        y = [k >> i & 1 for i in range(5)]
        p, before = 1.0, 0
        for i, t in enumerate(y):
            p *= m.step[before, t] * (math.exp(scores[i] if scores[i] else m.idle) if t else 1)
            before = t
        z += p
        hot = [h + p * t for h, t in zip(hot, y)]
    assert math.isclose(total, math.log(z), rel_tol=1e-9) and np.allclose(chance, [hot[1] / z, hot[3] / z])


def test_toxicity_learns_and_never_reads_held_out_labels(spark, docs, none):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join(["idiot" if bad and k % 9 == 4 else r.choice(WORDS) for k in range(30)])))
        labels.append((i, 1, int(bad)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(d, lab).toPandas()
    assert ((got["predicted"] == 1) == (got["doc_id"] % 4 == 0)).mean() > 0.97
    turned = lab.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score_documents(d, turned).toPandas()
    assert np.allclose(got.sort_values("doc_id")["score"], again.sort_values("doc_id")["score"])
    assert toxicity.score_documents(none, lab).count() == 0 and toxicity.score_documents(docs, lab.limit(0)).count() == len(ROWS)
    assert toxicity.clean_documents(docs, lab).columns == docs.columns
