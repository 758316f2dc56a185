"""Prefix tries, source divergence and exact search against brute force, with hostile rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pitloom.llm import divergence, exact_search, prefix_trie
from pitloom.llm.transducer import Transducer

SCHEMA = "conv_id long, turn long, role string, text string, depth string, a int"


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                kids[s[: d - 1]].add(s[:d])
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids[s]) or 1
        saved[s] = sum(saved[k] for k in kids[s]) + ((len(members[s]) - 1) * len(s[-1][1]) if s else 0)
    digest = lambda s: hashlib.sha256(",".join(str(c) for c in sorted(members[s]) if len(whole[c]) == len(s)).encode()).hexdigest()
    return Counter((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s], digest(s)) for s, m in members.items())


def conversations():
    rng = random.Random(3)
    rows = [(c, rng.choice([None, *range(8)]), rng.choice([None, "u", "a"]), rng.choice([None, "", "x", "yé", "zz"])) for c in [None, -205, -3, 0, 100, 200, 205, -200, *rng.sample(range(2000), 150)] for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 30]))]
    rows += [(c, i, "u", f"t{i % 3}") for c, n in ((700, 61), (701, 50), (703, 61)) for i in range(n)]
    return rows + rows[:5] + [(900, 0, "u", "long " * 100_000)]


@pytest.mark.parametrize("chunk, fan, batch", [(128, 32, 10_000), (7, 2, 3), (20, 3, 1)])
def test_trie(spark, monkeypatch, chunk, fan, batch):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "FAN", fan)
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    rows = conversations()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = prefix_trie.prefix_trie(prefix_trie.rebuilt_turns(spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA)))
        assert Counter(map(tuple, got.collect())) == trie_by_hand(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_trie_of_nothing_and_of_copies(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt_turns(none)).count() == 0
    copies = [(c, i, "u", f"same {i}") for c in range(1, 900) for i in range(4)]
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt_turns(spark.createDataFrame([(*r, "d", 1) for r in copies], SCHEMA)))
    assert Counter(map(tuple, got.collect())) == trie_by_hand(copies)


def test_transducer():
    rng = random.Random(1)
    for n in (0, 1, 2, 50, 3000):
        terms = sorted({bytes(rng.choice(b"abc\xc3\xa4") for _ in range(rng.randint(1, 9))) for _ in range(n)})
        machine = Transducer.from_bytes(Transducer.build(terms).to_bytes())
        asked = terms + [bytes(rng.choice(b"abcd\xc3\xa4") for _ in range(rng.randint(1, 12))) for _ in range(300)]
        place, sizes = {t: i for i, t in enumerate(terms)}, np.array([len(t) for t in asked])
        got = machine.ordinals(np.frombuffer(b"".join(asked), np.uint8), np.cumsum(sizes) - sizes, sizes)
        assert got.tolist() == [place.get(t, -1) for t in asked]
    endings = Transducer.build(sorted(a + b for a in (b"walk", b"talk", b"jump") for b in (b"", b"ed", b"ing", b"s")))
    assert len(endings.final) < 15  # the endings are shared


def divergence_by_hand(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        found = Counter(t for d in mine for t in set(d[2]))
        kept = sorted((t for t, n in found.items() if n >= least), key=str.encode)
        counts = defaultdict(Counter)
        for _, source, terms in mine:
            counts[source].update(t for t in terms if found[t] >= least)
            counts[source, "all"] = Counter()
        sources = sorted({d[1] for d in mine}, key=str.encode)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(counts[s]) for s in sources}, share(sum((counts[s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            terms = sorted(((q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]))[:top]
            out += [(lang, s, part, item.decode(), -v, i + 1) for part, found_ in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(found_)]
    return Counter(out)


def texts():
    rng = random.Random(5)
    words = ["The", "the", "Ärger", "ärger", "naïve", "日本", "z", "Zz", "it", "don't", "x1y", "_a_", "été", "ﬁ"] + [f"{a}{b}" for a in "abcdef" for b in "ghij"]
    rows = [(rng.choice(["\n", " ", "—", "1"]).join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", None, "", "ß"]), rng.choice(["a", "b", "B", "é", None, *map(str, range(9))])) for _ in range(400)]
    return rows + [(None, "en", "a"), ("", "xx", "q"), ("few words", "xx", "r"), ("a " * 200_000, "en", "b"), ("日" * 50_000, "en", "b"), ("\x00\u0085 x", "en", None)] + rows[:20]


@pytest.mark.parametrize("held", [dict(), dict(TERMS=20, HELD=5, BLOCK_TERMS=7, BLOCK_SOURCES=3)])
def test_divergence(spark, monkeypatch, held):
    for k, v in held.items():
        monkeypatch.setattr(divergence, k, v)
    rows = texts()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, rank int, term string").repartition(3)
    got = divergence.source_divergence(docs, 8, 5).select("lang", "source", "part", "item", "value", "rank").collect()
    assert Counter(map(tuple, got)) == divergence_by_hand(rows, 8, 5)


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 40)
    rng = random.Random(7)
    rows = ["".join(rng.choice("aBé 1-") for _ in range(n)) for n in (0, 3, 50, 90, 2_000_000, 7)] + [None, "x" * 3_000_000]
    column, found = pa.array([r for r in rows]), defaultdict(Counter)
    for row, text, edges in divergence._pieces(column):
        for doc, start, length in zip(*divergence._tokens(text, edges)):
            found[row + doc][text[start : start + length].tobytes()] += 1
    want = [Counter(re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r or "").encode().lower())) for r in rows]
    assert [found[i] for i in range(len(rows))] == want
    documents = list(divergence._document_terms([pa.RecordBatch.from_arrays([pa.array(["en"] * len(rows)), pa.array([r or "" for r in rows])], names=["lang", "text"])]))
    got = Counter()
    for b in documents:
        got.update(dict(zip([t.encode() for t in b["term"].to_pylist()], b["n"].to_pylist())))
    assert got == Counter(t for w in want for t in w)


def test_divergence_without_terms(spark):
    docs = spark.createDataFrame([("a", "en", "x"), ("b", "en", "y"), (None, "de", "x")], "text string, lang string, source string")
    assert sorted(map(tuple, divergence.source_divergence(docs).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_shares_are_exact():
    rng = random.Random(2)
    for _ in range(500):
        total = rng.randint(1, 8 * 10**15)
        count = rng.randint(0, total)
        assert divergence.shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * count // total


def products_by_hand(rows, k, every):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    sizes = Counter(len(v) for _, v in good)
    width = min(sizes, key=lambda d: (-sizes[d], d))
    seen = {(i, tuple(math.floor(64 * x) for x in v)) for i, v in good if len(v) == width}
    out = []
    for i, v in seen:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in seen if (j, w) != (i, v))[:k]
            out += [(i, r + 1, j, -p) for r, (p, j) in enumerate(best)]
    return Counter(out)


def vectors():
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(100)] + [(2000 + i, [0.0] * 6) for i in range(60)] + [(3000 + i, (rng.integers(-1, 2, 6) / 64).tolist()) for i in range(200)]
    rows += [(None, rows[0][1]), (5, None), (6, [1.0, None] + [0.0] * 4), (7, [math.nan] + [0.0] * 5), (8, [math.inf] + [0.0] * 5), (20, [1.0]), (21, []), (40, rows[3][1]), (40, rows[40][1]), (41, rows[41][1])]
    return rows + [(9000, [1e7] * 6), (9001, [-3e9, 1e9, 0.0, 0.0, 0.0, 1.0])]


@pytest.mark.parametrize("held", [dict(), dict(CELLS=4, BLOCK_ROWS=50, BLOCK_QUERIES=7, STRIPE=2, FIRST=1), dict(CELLS=2, BLOCK_ROWS=1000, STRIPE=1)])
def test_exact_search(spark, monkeypatch, held):
    for k, v in held.items():
        monkeypatch.setattr(exact_search, k, v)
    rows = vectors()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, e int, rank string")
    got = exact_search.largest_products(table, 5, 4).collect()
    assert Counter(map(tuple, got)) == products_by_hand(rows, 5, 4)


def test_exact_search_of_little(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, -1.0]), (3, None), (40, [])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, exact_search.largest_products(table).collect())) == [(0, 1, 20, 0), (20, 1, 0, 0)]
    assert exact_search.largest_products(table.limit(0)).count() == 0
    assert exact_search.largest_products(table.where("vec_id = 3")).count() == 0
    assert exact_search.largest_products(table.where("vec_id = 0")).count() == 0


def test_products_that_no_long_holds():
    x = np.array([[2**40, 1]], np.int64)
    assert exact_search.products(x, x).tolist() == [2**63 - 1]
    assert exact_search.products(x, -x).tolist() == [-(2**63)]
    assert exact_search.products(np.array([[2**30, 3]]), np.array([[2**31, 5]])).tolist() == [2**61 + 15]
