"""The de-duplication operators against plain versions, on whole small tables and on awkward rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import brute
from duelframe.llm import arrays, exact_dedup, graph, line_dedup, minhash_dedup, substring_dedup, suffix_dedup
from duelframe.llm.deep_shallow import blind_trie, common_prefix, deep_shallow_sort

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, h string, n long, component_id string, wanted string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y", None) for i, t in rows], SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "the", "er", "in", "ou", "st"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def awkward():
    base, passage = prose(1, 200), prose(2, 90)
    edited = base.split()
    edited[100] = "changed"
    return [
        (1, base), (2, base), (3, " ".join(edited)), (4, prose(3, 60) + "\n" + passage + " " + prose(4, 60)), (5, passage), (6, prose(5, 30) + "\t" + passage),
        (7, ""), (8, None), (9, " \n\t "), (10, "one two"), (11, "One  TWO"), (12, "a " * 300), (13, "x" * 1500), (14, "x" * 900), (15, "é" * 700),
        (16, passage + " " + passage), (17, "line a\nline b\nline c\nline d"), (18, "start\nline a\nline b\nline c\nend"), (19, "line b\nline c\nline d\n" * 3), (20, prose(9, 4000)),
    ]


@pytest.fixture(scope="module")
def docs():
    return awkward()


def found(df, columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("bucket_rows", [20_000, 0])
def test_repeated_words(spark, docs, bucket_rows):
    got = substring_dedup.remove_repeated_windows(frame(spark, docs), bucket_rows=bucket_rows)
    assert found(got, ["n_words", "n_removed", "kept_sha256"]) == brute.repeated_words(docs)


@pytest.mark.parametrize("bucket_rows", [2_000, 0])
def test_repeated_bytes(spark, docs, bucket_rows):
    got = suffix_dedup.remove_repeated_bytes(frame(spark, docs), bucket_rows=bucket_rows)
    assert found(got, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]) == brute.repeated_bytes(docs)


def test_repeated_bytes_with_many_variants(spark):
    """Copies with random edits close together: buckets with several strings, ranges from different partners."""
    r, base, rows = random.Random(7), prose(11, 260), []
    for i in range(30):
        text = list(base)
        for _ in range(r.randint(0, 4)):
            text[r.randrange(len(text))] = "#"
        rows.append((i, "".join(text)[r.randint(0, 40) :]))
    got = suffix_dedup.remove_repeated_bytes(frame(spark, rows), window=120, gram=20)
    assert found(got, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]) == brute.repeated_bytes(rows, 120)
    got = substring_dedup.remove_repeated_windows(frame(spark, rows), window=6, gram=2)
    assert found(got, ["n_words", "n_removed", "kept_sha256"]) == brute.repeated_words(rows, 6)


@pytest.mark.parametrize("name,columns,plain", [
    ("op4_substring_dedup", ["n_words", "n_removed", "kept_sha256"], brute.repeated_words),
    ("op7_suffix_array_dedup", ["n_bytes", "n_removed", "n_spans", "kept_sha256"], brute.repeated_bytes),
    ("op8_minhash_dedup", ["n_shingles", "component_id"], lambda rows: brute.near_components(rows, 3, 85)),
])
def test_queries(spark, name, columns, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(entry.queries()[name](spark, SF), columns) == plain(rows)


def test_sort_and_trie():
    r = random.Random(3)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 60))) for _ in range(300)] + [b"a" * 40, b"a" * 41, b""]
    for order, prefix in (deep_shallow_sort(strings, 5), blind_trie(strings, list(range(len(strings))))):
        want = sorted(strings)
        assert [strings[i] for i in order] == want
        assert prefix[1:] == [common_prefix(a, b) for a, b in zip(want, want[1:])]


def test_near_duplicates(spark, docs):
    for width, percent in ((3, 85), (5, 80)):
        got = minhash_dedup.near_duplicates(frame(spark, docs), width=width, percent=percent)
        assert found(got, ["n_shingles", "component_id"]) == brute.near_components(docs, width, percent)


def test_near_duplicates_in_large_buckets(spark):
    """One group of many variants, worked off leader by leader, joined by chains that no single leader sees."""
    r, rows, words = random.Random(5), [], prose(21, 220).split()
    for i in range(60):
        w = list(words)
        for _ in range(r.choice([1, 2, 12])):
            w[r.randrange(len(w))] = f"new{i}"
        rows.append((100 - i, " ".join(w)))
    got = minhash_dedup.near_duplicates(frame(spark, rows), width=3, percent=85, small=3, budget=40)
    assert found(got, ["n_shingles", "component_id"]) == brute.near_components(rows, 3, 85)
    kept = minhash_dedup.drop_near_duplicates(frame(spark, rows), width=3, percent=85)
    assert {x.doc_id for x in kept.collect()} == {c for _, c in brute.near_components(rows, 3, 85).values()}
    assert kept.columns == frame(spark, rows).columns


def written(monkeypatch, *modules):
    """Names of the tables that ``modules`` write from now on."""
    names = []
    for module in modules:
        def named(df, what, *a, write=module.stage, **options):
            names.append(what)
            return write(df, what, *a, **options)

        monkeypatch.setattr(module, "stage", named)
    return names


def test_crowded_bucket_without_links_ends_in_few_turns(spark, monkeypatch):
    """Every member is a component of its own, so all must lead once; their number a turn grows with the root of the budget."""
    r, rows, words = random.Random(6), [], prose(22, 220).split()
    for i in range(120):
        w = list(words)
        for p in r.sample(range(len(w)), 5):
            w[p] = f"new{i}"
        rows.append((i, " ".join(w)))
    names = written(monkeypatch, minhash_dedup)
    got = minhash_dedup.near_duplicates(frame(spark, rows), width=3, percent=85, small=3, budget=400)
    assert found(got, ["n_shingles", "component_id"]) == brute.near_components(rows, 3, 85)
    assert 2 < names.count("untested-members") <= 9


def test_few_lead_a_crowded_bucket_at_first(spark):
    """The first turn's pairs grow with the members; later turns test what is still apart with many leaders."""
    rows = [(1, i, 100, 100, [0] * 8, [], i, 240, 0, 239) for i in range(240)]
    live = spark.createDataFrame(rows, "bucket long, class long, n long, c long, bits array<long>, earlier array<long>, component long, size long, top long, outside long")
    first, left = minhash_dedup._tests(live, 85, 50_000, 1)
    assert 0 < first.count() <= 30 * 240
    assert 210 <= left.count() < 240
    assert minhash_dedup._tests(live, 85, 50_000, 2)[0].count() > 20_000


def test_stars(spark, monkeypatch):
    chain = [(i, i + 1) for i in range(100, 160)]
    pairs = [*chain, *chain[:9], (7, 7), (3, 99), (99, 4), (4, 3), *((500, i) for i in range(501, 520))]
    names = written(monkeypatch, graph)
    got = {r.node: r.component for r in graph.stars(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {4: 3, 99: 3} | {i: 500 for i in range(501, 520)}
    assert len(names) <= 9
    names.clear()
    again = graph.stars(spark.createDataFrame([*got.items()], "a long, b long"))
    assert {r.node: r.component for r in again.collect()} == got and len(names) == 1  # stars are known as such without a second round
    assert graph.stars(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_groups_and_collisions(spark, docs):
    df = frame(spark, docs)
    plain = exact_dedup.exact_duplicates(df)
    weak = exact_dedup.exact_duplicates(df, digest=lambda text: F.substring(F.md5(text), 1, 1))
    assert sorted(map(str, plain.collect())) == sorted(map(str, weak.collect()))
    by = {r.doc_id: r for r in plain.collect()}
    assert (by[2].keep_id, by[2].group_size, by[2].kept) == (1, 2, False)
    assert by[7].keep_id == by[8].keep_id == 7
    largest = {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(df, keep="largest").collect()}
    assert largest[1] == 2


def test_exact_drop_with_repeated_rows_and_null_ids(spark):
    df = frame(spark, [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c"), (None, "c"), (2, "a")])
    kept = exact_dedup.drop_exact_duplicates(df)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(1, "a"), (1, "b"), (None, "c")]


def plain_runs(docs, length):
    lines = {i: (t.split("\n") if t else []) for i, t in docs}
    first, out = {}, {}
    for i in sorted(lines):
        for p in range(len(lines[i]) - length + 1):
            first.setdefault(tuple(lines[i][p : p + length]), (i, p))
    for i, x in lines.items():
        gone = {p + s for p in range(len(x) - length + 1) if first[tuple(x[p : p + length])] < (i, p) for s in range(length)}
        out[i] = (len(x), len(gone), brute.sha("\n".join(v for j, v in enumerate(x) if j not in gone)))
    return out


@pytest.mark.parametrize("length", [1, 2, 3, 5])
def test_repeated_lines(spark, docs, length):
    rows = [*docs, (30, "p\nq\nr\ns\nt\nu\nv"), (31, "q\nr\ns\nt\nu\nw"), (32, "\n\n\n\n\n\n"), (33, "\n\n\n")]
    got = line_dedup.remove_repeated_runs(frame(spark, rows), min_lines=length)
    assert found(got, ["n_lines", "n_removed", "kept_sha256"]) == plain_runs(rows, length)


def test_repeated_rows_get_the_result_of_one(spark, docs):
    """Rows that repeat id and text change nothing for the others and all get the same result."""
    rows = [r for r in docs if r[0] in (1, 3, 4, 5, 6, 8, 13, 16, 18, 19)]
    calls = [
        (substring_dedup.remove_repeated_windows, ["n_words", "n_removed", "kept_sha256"]),
        (minhash_dedup.near_duplicates, ["n_shingles", "component_id"]), (lambda d: line_dedup.remove_repeated_runs(d, min_lines=2), ["n_lines", "n_removed", "kept_sha256"]),
    ]
    for call, columns in calls:
        once = call(frame(spark, rows))
        twice = call(frame(spark, rows + rows[::2]))
        assert found(once, columns) == found(twice, columns) and twice.count() == len(rows) + len(rows[::2])
    # for bytes every row is an occurrence, so a repeated text of 400 bytes or more goes whole
    left = suffix_dedup.remove_repeated_bytes(frame(spark, rows + rows[::2])).collect()
    again = {i for i, t in rows[::2] if t and len(t.encode()) >= 400}
    assert again and all(r.n_removed == r.n_bytes for r in left if r.doc_id in again)


def test_texts_beyond_a_section(monkeypatch):
    """Long texts are worked off in sections; where these end changes nothing."""
    r = np.random.default_rng(3)
    data = r.integers(97, 101, 6000).astype(np.uint8)
    starts = np.sort(r.choice(5900, 800, replace=False))
    ends = np.minimum(starts + r.integers(1, 60, 800), np.append(starts[1:], 6000))
    value, edges = np.sort(r.integers(0, 1 << 60, 900).astype(np.uint64)), np.array([0, 3, 3, 500, 900])
    g = arrays.mix64(r.integers(0, 1 << 60, 3000).astype(np.uint64))
    whole = arrays.span_hashes(data, starts, ends), arrays.window_minimum(g, 9), minhash_dedup.signatures(value, edges, 12)
    monkeypatch.setattr(arrays, "SECTION", 70)
    monkeypatch.setattr(arrays, "PLACE_BITS", 7)
    monkeypatch.setattr(minhash_dedup, "PIECE", 11)
    parts = arrays.span_hashes(data, starts, ends), arrays.window_minimum(g, 9), minhash_dedup.signatures(value, edges, 12)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_null_ids_take_no_part(spark):
    text = prose(40, 120)
    df = frame(spark, [(None, text), (None, text), (3, text)])
    for out in (substring_dedup.remove_repeated_windows(df), suffix_dedup.remove_repeated_bytes(df), line_dedup.remove_repeated_runs(df, min_lines=1)):
        assert [r.n_removed for r in out.collect()] == [0, 0, 0]
    near = minhash_dedup.near_duplicates(df).collect()
    assert sorted(str(r.component_id) for r in near) == ["3", "None", "None"]
    assert minhash_dedup.drop_near_duplicates(df).count() == 3


def test_empty_tables(spark):
    empty = frame(spark, [])
    for out in (
        exact_dedup.exact_duplicates(empty), exact_dedup.drop_exact_duplicates(empty), substring_dedup.remove_repeated_windows(empty), suffix_dedup.remove_repeated_bytes(empty),
        minhash_dedup.near_duplicates(empty), minhash_dedup.drop_near_duplicates(empty), line_dedup.remove_repeated_runs(empty),
    ):
        assert out.count() == 0
