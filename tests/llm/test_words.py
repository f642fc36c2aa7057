"""Spelling variants, lexical search and quality rules against plain versions, on whole small tables and on awkward rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from duelframe.llm import lexical, outliers, spelling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, word string, n long, row int, score string, item string, `group` string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, *(more or ["en", "s"])[:2], "x", 1, 2, "y", None, "z") for i, t, *more in rows], SCHEMA)


def small(seed, n, stems=("thinking", "reading", "running", "letters", "Straße", "ÉCOLE", "aaaaaa", "ababab")):
    """Words with slips, many of them several times."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = r.choice(stems) if r.random() < 0.4 else "".join(r.choice("ab") for _ in range(r.randint(3, 9)))
        if r.random() < 0.5:
            k = r.randrange(len(w))
            w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abz") + w[k:], w[:k] + r.choice("aé") + w[k + 1 :]])
        out.append(w)
    return " ".join(out)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# ---- spelling variants


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows, slips=None):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            if slips and i is not None:
                h = zlib.crc32(f"{i}:{run}".encode())
                if h % slips == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) if v else None for w, v in near.items()}
    form = {w: b if b and words[b] >= 2 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def variants(df, **options):
    rows = spelling.spelling_variants(df, **options).collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


SPELLED = [(i, small(i, 150)) for i in range(1, 13)] + [(12, small(12, 150)), (20, None), (21, ""), (22, " 1 2 ÷ × "), (None, small(5, 100)), (23, "y" * 3000 + " " + "y" * 2999), (24, ("y" * 3000 + " ") * 3)]


@pytest.mark.parametrize("budget", [10_000, 1])
def test_variants_equal_a_plain_search_also_when_every_bucket_is_crowded(spark, budget):
    want = plain_variants(SPELLED, slips=7)
    assert len(want) > 100 and any(v[0] for v in want.values()) and any(v[1] != v[0] and v[0] for v in want.values())
    assert variants(frame(spark, SPELLED), slips=7, budget=budget) == want


def test_variants_of_empty_tables_and_ties(spark):
    assert variants(frame(spark, []).where("false")) == {}
    rows = [(1, "reader " * 3 + "readex " * 3 + "readez " * 12 + "readey " * 12)]
    assert variants(frame(spark, rows))["reader"] == ("readey", "readey", 3, 3, 12)


def test_pivots_are_the_cheapest_disjoint_grams():
    r = random.Random(3)
    for _ in range(300):
        places = sorted(r.sample(range(12), r.randint(3, 6)))
        weights = [r.randint(1, 20) for _ in places]
        for many in (1, 2):
            sets = [s for s in __import__("itertools").combinations(range(len(places)), many) if all(places[b] - places[a] >= 2 for a, b in zip(s, s[1:]))]
            got = spelling.pivots(places, weights, many)
            assert (got is None) == (not sets)
            if sets:
                assert tuple(got) in sets and sum(weights[i] for i in got) == min(sum(weights[i] for i in s) for s in sets)


# ---- lexical search


def plain_search(docs, items, most=10):
    term = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    held = [(i, Counter(term.findall(lower(t or "")))) for i, t in docs if i is not None]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(Counter)
    for item, text in set(items):
        if item is not None:
            asked[item].update(term.findall(lower(text or "")))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c, n in held:
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in terms.items() if c[t])
            if s:
                scores.append((-s, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:most])]
    return sorted(out)


def search_rows(seed, n, long=0):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    docs = [(i, " ".join(r.choices(words, weights, k=r.randint(1, 40)))) for i in range(n)]
    docs += [(3, docs[3][1]), (3, docs[3][1]), (500, docs[4][1]), (501, docs[4][1]), (502, None), (503, ""), (504, "  ... "), (None, "w1 w2 w3"), (505, "É´ Ünï\tW3,w3 W59"), (506, "w50 " * 5000)]
    items = [(k, " ".join(r.choices(words, k=r.randint(1, 12)))) for k in range(8)] + [(8, None), (9, ""), (10, "unheard of"), (None, "w1"), (11, "w3 W3 w3 é´ ünï"), (11, "w59"), (2, "w0 w1"), (12, "w0"), (12, "w0")]
    return docs, items


def found_by(spark, docs, items, **options):
    items = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    rows = lexical.ranked_search(frame(spark, docs), items, **options).collect()
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows)


@pytest.mark.parametrize("options,bits", [({}, 14), ({"stages": 1}, 14), ({"stages": 5}, 2), ({"dictionary_bytes": 100}, 3)])
def test_search_equals_scoring_every_document(spark, monkeypatch, options, bits):
    monkeypatch.setattr(lexical, "SHARD_BITS", bits)
    docs, items = search_rows(1, 150)
    want = plain_search(docs, items)
    assert len(want) > 80
    assert found_by(spark, docs, items, **options) == want


def test_search_drops_only_what_cannot_be_among_the_best(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_BITS", 3)
    monkeypatch.setattr(lexical, "BUNDLE", 3)
    docs, items = search_rows(2, 300)
    assert found_by(spark, docs, items, most=2, stages=4) == plain_search(docs, items, most=2)


def test_search_in_empty_tables(spark):
    docs, items = search_rows(1, 5)
    assert found_by(spark, [], items) == []
    assert found_by(spark, docs, []) == []
    assert found_by(spark, [(1, None)], items) == []


# ---- quality rules


def plain_statistics(t):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    w = word.findall(t or "")
    lines = [x for x in (t or "").split("\n") if word.search(x)]
    times = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if times[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def judged(spark, rows, **options):
    return outliers.quality_verdicts(frame(spark, rows), **options).toPandas()


AWKWARD = [(1, "a b c d e " * 3), (2, "one two three four five six one two three four five"), (3, "\n \n x\nx\n x\r\nx\n"), (4, None), (5, ""), (6, "# * $ %&|<> é ü "), (7, "x " * 7), (8, "a b c d e f"),
           (9, " ".join(str(i % 997) for i in range(30000))), (10, "p q r s t"), (10, "p q r s t"), (None, "no id here at all"), (11, "a b c d e a b c d e a b c d x")]


def test_statistics_of_whole_texts(spark):
    got = judged(spark, AWKWARD)
    want = sorted((i if i is not None else -1, *plain_statistics(t)) for i, t in AWKWARD)
    assert sorted((int(i) if i == i else -1, *map(int, rest)) for i, *rest in got[["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].itertuples(index=False)) == want
    for r in got.itertuples():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def plain_fit(x, share=0.75):
    """Centre and scatter of one group by the same rules in numpy."""
    floor = np.array(list(outliers.VECTOR.values()))
    n, p = x.shape

    def median(v):
        b = np.sort(np.floor(v * 1024), axis=0)
        return (b[(n + 1) // 2 - 1] + 0.5) / 1024

    m = median(x)
    y = x - m
    k = np.maximum(median(np.abs(y)) * 1.4826, floor)
    u = y / k
    norm = np.linalg.norm(u, axis=1, keepdims=True)
    spread = [np.diag(k * k)] + [(v * k).T @ (v * k) / n for v in (np.tanh(u), np.where(norm > 0, u / np.where(norm > 0, norm, 1), 0) * math.sqrt(p))]
    far = lambda c, s: np.einsum("ni,ij,nj->n", y - c, np.linalg.inv(s), y - c)
    best = None
    for s in spread:
        c, s, was = np.zeros(p), s + np.diag(floor**2), None
        for _ in range(30):
            b = np.floor(np.log2(np.maximum(far(c, s), 0) + 1) * outliers.BINS_PER_DOUBLING)
            w = np.zeros(n)
            for v in np.unique(b):
                at = b == v
                w[at] = min(1.0, max(0.0, (n * share - (b < v).sum()) / at.sum()))
            c = w @ y / w.sum()
            s = (y * w[:, None]).T @ y / w.sum() - np.outer(c, c) + np.diag(floor**2)
            now = np.linalg.slogdet(s)[1]
            if was is not None and abs(now - was) < 1e-6:
                break
            was = now
        if best is None or now < best[0] - 1e-9:
            best = now, c, s
    _, c, s = best
    inside = far(c, s) / outliers.consistency(share) <= outliers.chi2_point(0.975, p)
    z = y[inside]
    return best[0], far(z.mean(0), np.cov(z.T, bias=True) * outliers.consistency(0.975) + np.diag(floor**2))


def noisy(seed, n, source, junk=0.15):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("etaoin") for _ in range(r.randint(2, 7)))
    rows = []
    for k in range(n):
        body = [word() for _ in range(r.randint(15, 120))]
        if r.random() < junk:
            body = [w.upper() + "###" for w in body] if k % 2 else [w + " | " for w in body]
        rows.append((seed * 10_000 + k, " ".join(body), "en", source))
    return rows


def test_estimates_and_distances_equal_the_plain_fit(spark):
    rows = noisy(1, 260, "a") + noisy(2, 140, "b") + noisy(3, 30, "c") + noisy(4, 80, None) + [(7, "alone " * 12, "fr", "d")]
    got = judged(spark, rows, least_rows=100).set_index("doc_id")
    stats = outliers.text_statistics(frame(spark, rows)).select("doc_id", "source", "lang", F.array(*outliers.vector()).alias("v")).toPandas()
    stats["part"] = ["rest" if lang == "fr" else s if s in ("a", "b") else "small" for lang, s in zip(stats.lang, stats.source)]
    for part, g in stats.groupby("part"):
        if part != "rest":
            det, d = plain_fit(np.array(g.v.tolist()))
            assert np.allclose(got.loc[g.doc_id].distance, d, rtol=1e-3, atol=1e-3), part
    assert got.loc[7].kept == (not got.loc[7].base_failed)
    junk = [i for i, t, *_ in rows if "###" in t or "|" in t]
    fine = got[~got.base_failed]
    assert not fine.loc[[i for i in junk if i in fine.index]].kept.any()
    assert fine.drop(index=[i for i in junk if i in fine.index]).kept.mean() > 0.99


def test_starts_reach_the_determinant_of_many_random_starts():
    r = np.random.default_rng(5)
    x = r.normal(size=(120, outliers.P)) * 0.3
    x[:25] += 2.5
    det, _ = plain_fit(x)
    floor = np.diag(np.array(list(outliers.VECTOR.values())) ** 2)
    least = math.inf
    for _ in range(200):
        at = r.choice(120, outliers.P + 1, replace=False)
        for _ in range(30):
            c, s = x[at].mean(0), np.cov(x[at].T, bias=True) + floor
            at = np.argsort(np.einsum("ni,ij,nj->n", x - c, np.linalg.inv(s), x - c))[:90]
        least = min(least, np.linalg.slogdet(np.cov(x[at].T, bias=True) + floor)[1])
    assert det <= least + 0.15


def test_labelled_junk_goes_and_clean_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    got = entry.queries()["op13_quality_rules"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    fine = got[~got.base_failed]
    assert fine[fine.quality == 1].kept.mean() > 0.99
    assert got[got.quality == 0].kept.mean() < 0.1


def test_rules_on_empty_tables_and_dropping(spark):
    assert len(judged(spark, [])) == 0
    rows = noisy(6, 120, "a", junk=0) + [(1, "few words"), (1, "few words"), (None, "none"), (2, None)]
    left = outliers.drop_outliers(frame(spark, rows))
    assert left.columns == frame(spark, rows[:1]).columns
    assert {r["doc_id"] for r in left.collect()} >= {None, *(i for i, *_ in rows[:100])} - {1, 2} and left.where("doc_id in (1, 2)").count() == 0


def test_rules_use_no_python_on_the_main_path(spark):
    plan = entry.queries()["op13_quality_rules"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
