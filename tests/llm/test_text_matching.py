"""Decontamination, repeats, links and toxicity against plain versions."""

from __future__ import annotations

import random
import tracemalloc

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from millrace.llm import column_bwt, decontamination, jaccard, queries, repeats, shingles, toxicity
from millrace.llm.anchors import anchors, gram_hashes
from millrace.llm.components import components


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


ITEMS = [
    (1, "One two THREE four five six seven eight nine ten eleven twelve"),
    (2, "tiny item"),
    (3, None),
    (4, " -- "),
    (5, "tiny item"),
    (6, "zwölf Käse: über 90 Wörter"),
]
CONTAMINATION = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.fixture(scope="module")
def suspects():
    ten = "two three four five six seven eight nine ten eleven"
    return [
        (1, f"Before. {ten.upper()}! after"),
        (2, "one two three four five six seven eight nine"),
        (3, "a TINY, item a tiny item tiny item"),
        (4, f"one {ten} twelve {ten}"),
        (5, "ZWÖLF Käse"),
        (6, "zwölf käse über 90 wörter; zwölf Käse über 90 Wörter"),
        (7, None),
        (8, "tiny-item tinyitem tiny"),
    ]


@pytest.mark.parametrize("max_bytes", [1 << 20, 40])
def test_decontamination(spark, suspects, max_bytes):
    docs = spark.createDataFrame(suspects, "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = decontamination.decontaminate(docs, items, max_automaton_bytes=max_bytes)
    assert rows(found, *CONTAMINATION) == sorted(brute.contamination(suspects, ITEMS), key=repr)
    spans = {r["doc_id"]: [(s["begin"], s["end"]) for s in r["spans"]] for r in found.collect()}
    text = dict(suspects)[1]
    assert [text[a:b].lower() for a, b in spans[1]] == ["two three four five six seven eight nine ten eleven"]


@pytest.mark.parametrize("max_bytes", [1 << 20, 40])
def test_decontamination_by_items_without_id(spark, suspects, max_bytes):
    items = [*ITEMS, (None, ITEMS[0][1]), (None, "wörter zwölf"), (None, None)]
    docs = spark.createDataFrame([*suspects, (9, "90 Wörter, zwölf Käse")], "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.decontaminate(docs, benchmark, max_automaton_bytes=max_bytes)
    with duckdb.connect() as db:
        db.register("documents", docs.toArrow())
        db.register("benchmark", benchmark.toArrow())
        expected = db.sql(queries.ORACLES["op1_decontamination"]).select(", ".join(CONTAMINATION)).fetchall()
    assert rows(found, *CONTAMINATION) == sorted(expected, key=repr)
    by_id = {r["doc_id"]: (r["n_items"], r["items"], r["contaminated"]) for r in found.collect()}
    assert by_id[9] == (1, [], True) and by_id[1] == (2, ["1"], True)


def test_decontamination_of_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = decontamination.decontaminate(edge_docs, items)
    assert set(edge_docs.columns) < set(found.columns)
    assert found.count() == 9 and found.filter("contaminated").count() == 0
    assert decontamination.decontaminate(no_docs, items).count() == 0
    assert decontamination.decontaminate(edge_docs, items.limit(0)).filter("n_hit > 0").count() == 0


def test_anchors_cover_every_window():
    rng = np.random.default_rng(3)
    for n, letters in ((49, 3), (50, 2), (51, 9), (300, 2), (900, 26)):
        data = rng.integers(97, 97 + letters, n).astype(np.uint8)
        data[100:220] = 97
        hashes = gram_hashes(data)
        of_window = [None] * max(0, n - 49)
        for _, place, first, last in zip(*anchors(data, 50)):
            for start in range(first, last + 1):
                assert of_window[start] is None
                of_window[start] = place
        assert of_window == [i + int(hashes[i : i + 31].argmin()) for i in range(max(0, n - 49))]


def test_transform_of_a_collection():
    rng = random.Random(5)
    strings = ["".join(rng.choices("ab", k=12)) for _ in range(60)]
    symbols = np.array([list(s.encode()) for s in strings], dtype=np.uint16)
    for column, order, before, common in column_bwt.rounds(symbols, 5):
        assert order.tolist() == sorted(range(60), key=lambda i: (strings[i][column:], i))
        if column:
            assert before.tolist() == [ord(strings[i][column - 1]) for i in order]
        for one, other, length in zip(order, order[1:], common[1:]):
            a, b = strings[one][column:], strings[other][column:]
            assert length == next((k for k in range(min(5, len(a))) if a[k] != b[k]), min(5, len(a)))


@pytest.mark.parametrize("hot, kept", [(50_000, 1 << 18), (3, 20)])
def test_repeats(monkeypatch, corpus, corpus_df, hot, kept):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "MAX_KEPT", kept)
    found = repeats.remove_repeats(corpus_df)
    got = sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect())
    assert got == sorted(brute.repeats(corpus))


def test_repeats_of_edges(edge_docs, no_docs):
    found = repeats.remove_repeats(edge_docs, as_text=True)
    kept = {(r["doc_id"], r["n_removed"]) for r in found.collect()}
    assert kept == {(1, 0), (2, 0), (3, 0), (4, 200_004), (5, 0), (6, 0), (None, 0), (7, 0)}
    assert found.count() == 9 and dict(found.dtypes)["kept"] == "string"
    assert repeats.remove_repeats(no_docs).count() == 0


def test_repeats_of_a_batch_are_one_row_per_text():
    first, second = bytes(range(60, 130)), bytes(range(150, 220))
    strings = [(1, 1, 7, 5, first, [5]), (1, 2, 7, 5, first, [3, 200]), (1, 2, 8, 5, first, [0])]
    strings += [(2, 1, 7, 5, second, [400]), (2, 2, 7, 5, second, [230]), (3, 2, 7, 5, second, [900])]
    names = ["key", "doc", "text_key", "left", "string", "starts", "spans"]
    kinds = [*[pa.int64()] * 3, pa.int32(), *[pa.binary()] * 3]
    columns = zip(*((*row[:5], np.array(row[5], dtype="<i8").tobytes(), None) for row in strings))
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    class Rows:
        repartition = sortWithinPartitions = lambda self, *_: self

        def mapInArrow(self, run, ddl):
            return [row for out in run(iter([batch])) for row in out.to_pylist()]

    found = repeats._collections(Rows(), 50, 20)
    spans = {(r["doc"], r["text_key"]): np.frombuffer(r["spans"], "<i8").tolist() for r in found}
    assert spans == {(2, 7): [3, 73, 200, 300], (2, 8): [0, 70]} and len(found) == 2


@pytest.mark.parametrize("tile", [2048, 4])
def test_links(monkeypatch, corpus, corpus_df, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    found = jaccard.link(corpus_df)
    assert rows(found, "doc_id", "n_shingles", "component_id") == sorted(brute.linked(corpus), key=repr)


def test_links_of_edges(edge_docs, no_docs):
    found = rows(jaccard.link(edge_docs), "doc_id", "component_id")
    assert found == sorted([(1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (6, 6), (6, 6), (7, 7), (None, None)], key=repr)
    assert jaccard.link(no_docs).count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for size in (1, 3, 5, 17, 60, 300):
        one = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        apart = jaccard.differing(len(one), len(one), 75) // 2
        other = np.unique(np.concatenate((one[apart:], rng.integers(0, 2**63, apart).astype(np.uint64))))
        bits = [np.frombuffer(jaccard.bit_sketch(x), np.uint8) for x in (one, other)]
        if len(bits[0]) == len(bits[1]):
            assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(one, other))
        keys = [dict(jaccard.block_keys(x, 75)) for x in (one, other)]
        band = jaccard.band_of(len(one))
        shared = np.intersect1d(keys[0][band], keys[1][band])
        assert len(shared) >= jaccard.shared_blocks(band)


def test_jaccard_crowded_groups_give_few_pairs():
    """Members of two groups that are all close: nearest ones, not all pairs, and each pair once."""
    rng = np.random.default_rng(3)
    base = rng.integers(1, 2**63, 200, dtype=np.uint64)
    sets = [np.unique(np.append(base[rng.random(200) > 0.03], rng.integers(1, 2**63, 3, dtype=np.uint64))) for _ in range(120)]
    order = sorted(range(120), key=lambda i: len(sets[i]))
    members = [(key, 0, 0, 0, i, i, len(sets[i]), jaccard.bit_sketch(sets[i])) for key in (5, 6) for i in order]
    members += [(7, 0, 0, 0, i, i, len(sets[i]), jaccard.bit_sketch(sets[i])) for i in order[:2]]
    names = ["key", "low", "high", "tile", "doc", "component", "n_shingles", "sketch"]
    rows = pa.Table.from_pylist([dict(zip(names, m)) for m in members])

    def made(every):
        run = jaccard._compare(75, every)
        return [r for b in run(iter(rows.to_batches(max_chunksize=50))) for r in b.to_pylist()]

    nearest, every = made(False), made(True)
    pairs = {(r["a"], r["b"]) for r in every}
    assert len(every) == len(pairs) == 120 * 119 // 2
    assert len(nearest) <= 2 * 120 + 2
    assert {r["key"] for r in nearest if r["a"] is None} == {5, 6}
    found = {(r["a"], r["b"]) for r in nearest if r["key"] is None}
    assert found < pairs and {i for pair in found for i in pair} == set(range(120))


def test_jaccard_hub_is_not_the_smallest(spark):
    """Copies of the text with the largest id, which resemble each other less than 75 percent."""
    rng = random.Random(5)
    hub = [f"w{i}" for i in range(300)]
    docs = [(1000, " ".join(hub))]
    for i in range(60):
        words = list(hub)
        for at in rng.sample(range(60), 7):
            words[5 * at] = f"x{i}"
        docs.append((i, " ".join(words)))
    docs += [(2000 + i, " ".join(f"y{i}x{n}" for n in range(80))) for i in range(5)]
    found = rows(jaccard.link(spark.createDataFrame(docs, "doc_id bigint, text string")), "doc_id", "component_id")
    assert found == sorted([(i, 0 if i <= 1000 else i) for i, _ in docs], key=repr)


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    links += [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    root = {x: x for pair in links for x in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(root[a], root[b])
            changed |= root[a] != root[b]
            root[a] = root[b] = least
    linked = {x for a, b in links if a != b for x in (a, b)}
    found = components(spark.createDataFrame(links, "a bigint, b bigint"))
    assert dict(map(tuple, found.collect())) == {x: r for x, r in root.items() if x in linked}


@pytest.mark.parametrize(
    "text, folded",
    [
        ("W0RTHLESS, 1oser!!", " worthiess ioser "),
        ("ｗоrthless", " worthiess "),
        ("stupid$$$ $tupid", " stupid stupid "),
        ("12 300", " 12 300 "),
        (None, "  "),
    ],
)
def test_folding(text, folded):
    assert toxicity.Folder()(text) == folded


def test_lexicon_and_exceptions():
    folder = toxicity.Folder()
    lexicon = toxicity.Lexicon({folder("idiot"): 4.0, " scum": 3.0}, (folder("village idiot"),))
    matcher = toxicity.Matcher(lexicon)
    assert matcher.weight(folder("an 1D10T and scumbags")) == (7.0, 2)
    assert matcher.weight(folder("the village idiot")) == (0.0, 0)
    assert matcher.weight(folder("idiotic")) == (0.0, 0)
    assert matcher.score(folder("you idiot")) > matcher.score(folder("you idiot " + "word " * 500))


def test_exceptions_are_learned(spark):
    rng = random.Random(11)
    other = ["".join(rng.choices("bcdfghmnpr", k=6)) for _ in range(300)]
    around = lambda said: " ".join((*rng.choices(other, k=8), said, *rng.choices(other, k=8)))
    texts = [(around("you idiot"), 1) for _ in range(120)] + [(around("plain"), 0) for _ in range(400)]
    texts += [(around("village idiot fair"), 0) for _ in range(8)]
    copied = around("copied idiot")
    texts += [(copied, 0) for _ in range(8)]
    sample = spark.createDataFrame([(i, *row) for i, row in enumerate(texts)], "doc_id bigint, text string, label int")
    lexicon = toxicity.learn(sample)
    folder = toxicity.Folder()
    word, phrase = folder("idiot"), folder("village idiot")
    assert word in lexicon.weights and phrase in lexicon.exceptions
    assert folder("copied idiot") not in lexicon.exceptions and folder("you idiot") not in lexicon.exceptions
    # A toxic text with the phrase does not undo it, as many do.
    for n, learned in ((1, True), (40, False)):
        rows = [(1000 + i, around("village idiot fair"), 1) for i in range(n)]
        more = sample.union(spark.createDataFrame(rows, sample.schema))
        assert (phrase in toxicity.learn(more).exceptions) == learned
    said = [(1, "the village idiot fair"), (2, "you idiot"), (3, "the village idiot, you idiot")]
    found = toxicity.score(spark.createDataFrame(said, "doc_id bigint, text string"), lexicon)
    got = {r["doc_id"]: (r["n_matches"], r["predicted"]) for r in found.collect()}
    assert got[1] == (0, 0) and got[2] == got[3] and got[2][1] == 1


def test_toxicity_of_edges(edge_docs, no_docs):
    scored = toxicity.score(edge_docs, toxicity.Lexicon({" wort ": 3.0}))
    assert scored.count() == 9 and scored.filter("score < 0 or score > 1 or score is null").count() == 0
    assert {r["doc_id"] for r in scored.filter("n_matches > 0").collect()} == {3, 4}
    empty = toxicity.learn(toxicity.labelled_sample(no_docs, no_docs.selectExpr("doc_id", "1 as toxic"), "toxic"))
    assert empty.weights == {}


def test_shingles_take_a_fixed_number_of_bytes_at_once():
    words = [f"w{i * 7919 % 100_003}" for i in range(40_000)]
    texts = [" ".join(words[i * 500 :]) for i in range(40)] + [None, "", "one two"]
    column = pa.array(texts)
    alone = [next(shingles.shingle_sets(pa.array([text], pa.string()))) for text in texts]
    tracemalloc.start()
    for got, want in zip(shingles.shingle_sets(column), alone, strict=True):
        assert np.array_equal(got, want)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert column.nbytes > 6 << 20 and peak < 64 << 20
