"""SimHash components, Merkle manifests and collocations against plain Python models."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import collocations, merkle, simhash
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, corpus, frame, prose


@pytest.fixture(scope="module")
def rows():
    own = corpus()
    # Rows without id or with a repeated one, and equal rows.
    own += [(None, prose(3, 41), "en", "src0", 3)] * 3 + [(None, None, None, None, None)] * 2
    own += [(3, prose(3, 41), "en", "src3", 3), (4, "another text of that id", "en", "src0", None), (88, *own[-1][1:])]
    return own


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, []).cache()


def plain(df):
    return Counter(tuple(r) for r in df.collect())


# --- SimHash ---------------------------------------------------------------------------


def model_components(rows):
    prints = {(r[0], r[1]): brute.fingerprint(r[1]) for r in rows}
    root = brute.components(set(prints.values()))
    least = {}
    for (doc_id, _), p in prints.items():
        if doc_id is not None:
            least[root[p]] = min(doc_id, least.get(root[p], doc_id))
    return Counter((r[0], f"{prints[r[0], r[1]]:016x}", least.get(root[prints[r[0], r[1]]])) for r in rows)


def test_simhash(spark, docs, rows, empty):
    assert plain(simhash.near_components(docs)) == model_components(rows)
    assert simhash.near_components(empty).count() == 0
    nameless = spark.createDataFrame([(None, "a b c"), (None, "d e f")], "doc_id long, text string")
    assert [r["component_id"] for r in simhash.near_components(nameless).collect()] == [None, None]


def numbers(prints):
    return [(p - 2**64 if p >= 2**63 else p,) for p in prints]


@pytest.mark.parametrize("limit", [1, 4, 64])
def test_links_connect_all_near_fingerprints(spark, limit):
    """Crowded buckets in either half, chains of near fingerprints, and zero."""
    own = random.Random(limit)
    prints = {0, 1, 2**63, 2**64 - 1, 0b110}
    for _ in range(8):
        base = own.getrandbits(64)
        prints.add(base)
        for _ in range(25):
            # Changes of one half only, of both, and chains of them.
            near = base ^ 1 << own.randrange(64) ^ (1 << own.randrange(64) if own.random() < 0.7 else 0)
            prints.add(near)
            base = near if own.random() < 0.5 else base
        prints |= {base ^ 1 << own.randrange(32) ^ 1 << own.randrange(32) ^ 1 << own.randrange(32) for _ in range(20)}
    saved = spark.createDataFrame(numbers(prints), "print long").cache()
    edges = [tuple(x % 2**64 for x in r) for r in simhash.links(saved, limit).collect()]
    assert all((u ^ v).bit_count() <= 2 for u, v in edges)
    root = brute.components(prints)
    joined = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            low = min(joined[u], joined[v])
            changed |= joined[u] != low or joined[v] != low
            joined[u] = joined[v] = low
    assert joined == root


def test_a_crowded_bucket_makes_few_edges(spark):
    """Fingerprints with one half in common are linked without a row for each pair."""
    own = random.Random(9)
    prints = {(7 << 32) | own.getrandbits(14) for _ in range(6000)}
    saved = spark.createDataFrame(numbers(prints), "print long").cache()
    assert simhash.links(saved).count() < 66 * len(prints)


# --- Merkle ----------------------------------------------------------------------------


def test_manifest(docs, rows, empty, spark):
    wanted = Counter(brute.manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows]))
    assert plain(merkle.Manifest(docs).verify()) == wanted
    assert {v for *_, v in wanted} == {True, False}
    assert merkle.Manifest(empty).verify().count() == 0
    one = spark.createDataFrame([(2, "a\nb", "en", "s", 3)], SCHEMA)
    assert plain(merkle.Manifest(one).verify()) == Counter(brute.manifest([(2, "s", "en", 3, "a\nb")]))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 82, 245])
def test_manifest_over_many_ranges_and_rounds(spark, monkeypatch, n):
    """Groups of nine leaves, ranges that cut runs anywhere, sources of any size and several levels of them."""
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    rows = [(i, f"{prose(i, 3)}\n{i}", "en", f"s{i % 11 if i > n // 2 else 0}", i) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    manifest = merkle.Manifest(docs)
    assert plain(manifest.verify()) == Counter(brute.manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows]))
    # Every node above the leaves is there once.
    nodes = manifest.nodes.where("level > 0").select("tree", "level", "idx", F.lower(F.hex("hash")).alias("hash")).collect()
    sources = {}
    for r in rows:
        sources.setdefault(f"={r[3]}", []).append(brute.leaf((r[0], r[3], r[2], r[4], r[1])))
    wanted = {(s, k, i, h) for s, own in sources.items() for k, level in enumerate(brute.levels(own)) for i, h in enumerate(level) if k}
    assert len(nodes) == len(wanted) and {tuple(r) for r in nodes} == wanted


def test_mountains_meet_at_any_cut():
    """Two ranges, cut anywhere, leave peaks that merge into the same tree."""
    leaves = [bytes([i]) * 32 for i in range(30)]
    whole: list[tuple] = []
    one = merkle.Mountains("t", 30, whole)
    for i, h in enumerate(leaves):
        one.add_leaf(i, h)
    one.finish()
    assert not any(r[5] for r in whole)
    for cut in range(1, 30):
        out: list[tuple] = []
        for a, b in ((0, cut), (cut, 30)):
            part = merkle.Mountains("t", 30, out)
            for i in range(a, b):
                part.add_leaf(i, leaves[i])
            part.finish()
        peaks = merkle.table_of(merkle.NODES, [r for r in out if r[5]])
        made = merkle.merge(8)((merkle.pa.scalar("t"), merkle.pa.scalar(0)), peaks).to_pylist()
        nodes = {r[2:5] for r in out if not r[5]} | {(r["level"], r["idx"], r["hash"]) for r in made}
        assert nodes == {r[2:5] for r in whole}, cut


# --- collocations ----------------------------------------------------------------------


def pieces():
    """Phrases that overlap themselves, end at each sign, differ in case, and repeat as whole lines."""
    own = random.Random(6)
    some = [prose(i, 4) for i in range(12)]
    rows = []
    for i in range(160):
        parts = [own.choice(some) + own.choice([" ", "  ", "\t", ", ", ". ", "\n", ";", "\x0b", "!"]) for _ in range(own.randint(0, 25))]
        rows.append((i, "".join(parts), own.choice(["en", "de", None]), "s", None))
    rows += [(200 + i, "New York city; new york. NEW  YORK CITY ha ha ha ha ha", "en", "s", 1) for i in range(40)]
    rows += [(300, None, "en", "s", 1), (301, "", None, None, 1), (302, " .;\n", "fr", None, 1), (303, "x\x1cy é\x85 z　w " * 50, "en", None, 1)]
    rows += [(400, "É é A a É é " * 300, "de", None, 1), (None, "ha ha ha", "en", None, 1), (200, "new york city", None, None, 1)]
    return rows


@pytest.mark.parametrize(("least", "limit", "group_bytes"), [(20, 2000, 1 << 20), (20, 7, 2000), (60, 3, 5000)])
def test_collocations(spark, monkeypatch, least, limit, group_bytes):
    monkeypatch.setattr(collocations, "RANKED_TOGETHER", 10)
    rows = pieces()
    found = collocations.collocations(frame(spark, rows), least, limit, group_bytes)
    wanted = brute.collocations([(r[2], r[1]) for r in rows], least, limit)
    assert plain(found) == Counter(wanted) and len(wanted) > 5


def test_collocations_of_nothing(spark, empty):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")).count() == 0


def test_collocation_scores_pass_64_bits(spark):
    big = 3 * 10**12
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big), ("en", "a b", big - 1)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", 10**14 + 7)], "lang string, n long")
    assert collocations.scored(counts, totals).first()["score"] == 1000 * (big - 1) * (10**14 + 7) // (big * big)


def test_runs_keep_what_may_be_longer():
    """Cutting runs to frequent pairs keeps every longer run and its multiplicity."""
    runs = collocations.Runs.of_pieces("en", Counter({b"a b c d": 3, b"x": 1, b"b c": 2}))
    assert [runs.phrase(i, 2) for i in runs.starts(2)] == [b"a b", b"b c", b"c d", b"b c"]
    assert runs.weights()[runs.starts(2)].tolist() == [3, 3, 3, 2]
    left = runs.cut(runs.starts(2)[[0, 1, 3]], 2)
    assert [(left.phrase(i, 3), int(left.weights()[i])) for i in left.starts(3)] == [(b"a b c", 3)]
    assert [(left.phrase(i, 2), int(left.weights()[i])) for i in left.starts(2)] == [(b"a b", 3), (b"b c", 3), (b"b c", 2)]
