"""Source divergence, piece encoding and periodic runs against brute force, and on nulls, empties, long texts, ties and clashing names."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessella.llm import divergence, periodic, pieces, suffix_tree

rnd = random.Random(5)
CLASHES = "row term n docs total terms sources tile value rank part item p q salt ids offsets runs collapsed n_words start length period h w g b lines".split()
VOCABULARY = [f"{a}{b}" for a in ("Ab", "éa", "zz", "longer-than-it-looks", "ß") for b in ("c", "cde", "fghijkl", "mnopqrstuvwx", "日本語の言葉", "y" * 40)]
LONG = " ".join(rnd.choice(VOCABULARY) + str(rnd.randrange(50)) for _ in range(60_000))
ROWS = [(i, " ".join(rnd.choice(VOCABULARY) for _ in range(rnd.randrange(30))), rnd.choice(["en", "de"]), rnd.choice(["a", "b", "c", "é"])) for i in range(60)] + [
    (1, "Ab ab AB", "en", "a"),
    (1, "Ab ab AB", "en", "a"),
    (2, None, "en", None),
    (None, "", None, "a"),
    (3, " \n\t ", None, None),
    (4, "\x80\x81x nul\x00nul 1a2b", "xx", "only"),
    (5, LONG, "en", "b"),
    (6, "tie tie one\x1ftwo ééé É", "de", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return plain.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHES]).cache()


# -- source divergence ---------------------------------------------------------
def _audit(rows, least=3, top=200):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        p, whole = share(counts[lang, source]), share(sum((counts[g] for g in groups if g[0] == lang), Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        pair = []
        for other in [s for g, s in groups if g == lang and s != source]:
            q = share(counts[lang, other])
            pair.append((sum(f(p[t], q[t]) for t in kept), other))
        term = [(f(p[t], whole[t]), t) for t in kept if counts[lang, source][t] and p[t] > whole[t]]
        for part, found in (("pair", pair), ("term", term)):
            found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top}
    return out


def _rows(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("least", "top", "cells"), [(3, 200, 65_536), (1, 5, 8), (2, 3, 40)])
def test_divergence_equals_brute_force(docs, least, top, cells):
    want = _audit(ROWS, least, top)
    assert _rows(divergence.audit(docs, least, top, cells)) == want
    assert {w[:2] for w in want} >= {("en", "a"), ("de", "c"), ("en", "")}
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_without_kept_terms(spark):
    rows = [(1, "one", "l", "s"), (2, None, "l", "t"), (3, "two", "l", "u")]
    got = _rows(divergence.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert got == _audit(rows) and len(got) == 6 and {g[4] for g in got} == {0}


def test_terms_counted_in_chunks(docs):
    whole = divergence.term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("docs"))
    small = divergence.term_counts(docs.repartition(3), 1).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("docs"))
    assert _rows(whole) == _rows(small)


def test_radix_order_is_stable():
    keys = [np.array([rnd.choice([0, 1, 5, 2**63, 2**40]) for _ in range(500)], np.uint64) for _ in range(2)]
    assert divergence.radix_order(keys).tolist() == sorted(range(500), key=lambda i: (keys[1][i], keys[0][i], i))


def test_shares_are_exact(spark):
    rows = [(rnd.randrange(10**k), rnd.randrange(1, 10**k)) for k in range(2, 16) for _ in range(5)]
    rows = [(c, c + t, 7) for c, t in rows]
    df = spark.createDataFrame(rows, "n long, total long, terms long")
    got = df.select("n", "total", divergence.share(F.col("n"), F.col("total"), F.col("terms")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["n"] + 1) // (r["total"] + 7) for r in got)


# -- pieces --------------------------------------------------------------------
ODD = ["", " ", "  a  b ", "\n\n x\t", "▁▁a ▁", "日本語のテキスト 中文 русский", "😀👩‍👩‍👧 é ﬁ Ⅷ ｶﾞ", "a\x00b", "<s> </s> <unk> <0x0A> ", "x" * 5000, "日" * 3000, "　 ​", "ſt ½ \r\n"]
ODD += ["".join(rnd.choice("abe \n\t.,▁éñ日本😀́ﬁ0123_-<>x") for _ in range(rnd.randrange(1, 80))) for _ in range(800)]


def test_pieces_and_places_equal_the_library():
    own, library = pieces.PieceModel(pieces.default_model()), sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = [*ODD, LONG[:20_000], *ODD[:40]]
    for text, (ids, offsets) in zip(texts, own.encode_many(texts)):
        want = library.encode(text, out_type="proto")
        assert ids.tolist() == [p.id for p in want.pieces] and offsets[0] == 0 and offsets[-1] == len(text.encode())
        assert list(zip(offsets[:-1].tolist(), offsets[1:].tolist())) == [(p.begin, p.end) for p in want.pieces]


def test_pieces_equal_the_merges():
    own = pieces.PieceModel(pieces.default_model())
    parts = ["".join(rnd.choice("▁abcdeinorst,.é日") for _ in range(rnd.randrange(1, 40))) for _ in range(3000)] + ["a" * 500, "ab" * 300, "▁" * 70, "=" * 90, "🧿" * 3]
    assert all(own.pieces_of(p) == own._merged(p) for p in parts)
    own.learn([p for p in parts if len(p) > 1])
    got = {p: np.frombuffer(x, np.int32).tolist() for p, x in own.parts.items()}
    assert len(got) > 2500 and all(ids == own._encode_part(p) for p, ids in got.items())


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("flags", [{}, {"add_dummy_prefix": True}, {"add_dummy_prefix": True, "escape_whitespaces": True, "remove_extra_whitespaces": True}])
def test_character_maps_equal_the_library(rule, flags):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **flags)
    spec = dict(pieces._fields(b"".join(v for n, v in pieces._fields(library.serialized_model_proto()) if n == 3)))
    own = pieces.Normaliser(spec.get(2, b""), *(bool(spec.get(n, 1)) for n in (3, 4, 5)))
    for text in ODD:
        if "\0" in text:
            continue
        at = np.cumsum([0, *(len(c.encode()) for c in text)])
        made, places = own(text)
        want, chars = library.normalize(text, with_offsets=True)
        assert made == want and places.tolist() == at[chars].tolist()


def test_piece_documents(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    found = pieces.encode_documents(docs)
    got = found.select("doc_id", "ids", pieces.decoded(F.col("ids")).alias("text")).collect()
    want = [(r[0], library.encode(r[1] or ""), library.decode(library.encode(r[1] or "")) if r[1] else "") for r in ROWS]
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted([(r["doc_id"], r["ids"], r["text"]) for r in got], key=key) == sorted(want, key=key)
    assert pieces.encode_documents(docs.limit(0)).count() == 0


def test_other_models_are_refused(tmp_path):
    raw = open(pieces.default_model(), "rb").read()
    path = tmp_path / "unigram.model"
    path.write_bytes(raw + bytes([0x12, 2, 0x18, 1]))  # a later field wins: unigram
    with pytest.raises(ValueError):
        pieces.PieceModel(str(path))


# -- periodic runs ---------------------------------------------------------------
def _brute(words, least, repeats):
    found, n = {}, len(words)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, repeats * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted((s, size, q) for (s, size), q in found.items())


def _words():
    n, few = rnd.randrange(1, 90), rnd.choice([1, 2, 2, 3, 5, 50])
    words = [str(rnd.randrange(few)) for _ in range(n)]
    if rnd.random() < 0.6:
        a, p = rnd.randrange(n), rnd.randrange(1, 12)
        words = [w if i < a else words[a + (i - a) % p] if a + (i - a) % p < n else w for i, w in enumerate(words)]
        words += [str(rnd.randrange(50)) for _ in range(rnd.randrange(20))]
    return words


def test_runs_equal_brute_force():
    for _ in range(1500):
        words = _words()
        for least, repeats in ((2, 2), (6, 3)):
            assert periodic.runs_of(words, least, repeats) == _brute(words, least, repeats)
        assert periodic.runs_of(words, 24, 3, periodic.recurring(words)) == _brute(words, 24, 3)


def test_extensions_equal_brute_force():
    for _ in range(100):
        text = [rnd.randrange(1, 4) for _ in range(rnd.randrange(2, 60))]
        tree = suffix_tree.SuffixTree(text)
        rank, common = tree.walk(np.arange(tree.sigma))
        order = sorted(range(len(text) + 1), key=lambda i: text[i:])
        assert np.argsort(rank).tolist() == order
        pairs = [(i, j) for i in range(len(text)) for j in range(i)]
        a, b = (np.array(x) for x in zip(*pairs))
        same = lambda i, j: next((k for k in range(len(text) - i) if text[i + k] != text[j + k]), len(text) - i)  # noqa: B023, E731
        assert suffix_tree.Extensions(rank, common)(a, b).tolist() == [same(i, j) for i, j in pairs]


def test_periodic_documents(spark):
    texts = [None, "", " \n\t ", LONG, "a b c " * 20, "a b c " * 20, "x " + "a " * 24 + "y", "a " * 23, "tick tock " * 2000 + " ".join(map(str, range(300))) + " 1 2 3 4 5 6 7 8 9" * 3]
    texts += [" ".join(_words()) for _ in range(60)]
    rows = [(None if i == 1 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in CLASHES])
    got = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(docs).collect())
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = _brute(words, 24, 3) if len(words) < 10_000 else []
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        want.append((i or 0, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert got == sorted(want) and sum(len(w[2]) for w in want) > 10
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
