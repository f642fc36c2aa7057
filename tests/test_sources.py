"""Files in and out, nested documents, page records and streams."""

import datetime as dt
import json

from pyspark.sql import functions as F

from duelframe.operators import ratings as R
from duelframe.sources import odds_documents as od, page_nodes as pn, pages as pg, tables as src
from duelframe.streaming.buckets import BucketTable
from duelframe.streaming import ingest, ratings as sr


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    (tmp_path / "in.csv").write_text('EVENT,URL,DATE,LOCATION\n"Night, 1",u,"March 16, 2024",x\n')
    df = src.read_csv_dated(spark, path, src.EVENTS, {"DATE": ["MMMM d, yyyy"]})
    assert tuple(df.first()) == ("Night, 1", "u", dt.date(2024, 3, 16), "x")
    src.write_csv(df.withColumn("v", F.lit(1.005)), str(tmp_path / "out"), digits=2)
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.first().v == "1.0" and back.columns == [*df.columns, "v"]
    (tmp_path / "m.csv").write_text("A,B,W\n x , y ,x\n,z,z\n")
    assert [tuple(r) for r in src.read_matchups(spark, str(tmp_path / "m.csv")).collect()] == [("x", "y")]


def test_replace_and_reset(spark, tmp_path):
    df = spark.range(3).select("id", (F.col("id") * 2).alias("extra"))
    spark.sql("DROP TABLE IF EXISTS t_base_case")
    src.replace_table(df, "t_base_case")
    src.replace_table(df, "t_base_case")
    spark.sql("CREATE OR REPLACE TEMP VIEW v_derived AS SELECT 1 AS x")
    src.reset(spark, ["v_derived"], {"t_base_case": ["id"]})
    assert src.read_table(spark, "t_base_case").columns == ["id"] and not spark.catalog.tableExists("v_derived")
    assert src.read_table(spark, "SELECT count(*) AS n FROM t_base_case").first().n == 3
    spark.sql("DROP TABLE t_base_case")


def test_odds_documents(spark, tmp_path):
    doc = [{"id": "1", "commence_time": "2024-03-16T22:00:00Z", "home_team": "A", "away_team": "B", "bookmakers": [
        {"key": "dk", "markets": [{"key": "h2h", "outcomes": [{"name": "A", "price": -150}, {"name": "B", "price": 130}]}, {"key": "totals", "outcomes": [{"name": "x", "price": 1}]}]},
        {"key": "fd", "markets": [{"key": "h2h", "outcomes": [{"name": "A", "price": -140}]}]}]}]
    (tmp_path / "odds.json").write_text(json.dumps(doc, indent=1))
    long = od.long_odds(od.read_odds_json(spark, str(tmp_path / "odds.json")))
    assert long.count() == 3
    wide = {r.outcome: (r.dk, r.fd) for r in od.wide_odds(long, ["dk", "fd"]).collect()}
    assert wide == {"A": (-150.0, -140.0), "B": (130.0, None)}


def test_stat_cells_to_rounds(spark):
    def cell(a, b):
        return f'<td class="col x"><p class="t">\n {a} \n</p><p>{b}</p></td>'

    totals = ["1", "17 of 37", "45%", "20 of 40", "1 of 2", "50%", "0", "0", "1:05"]
    strikes = ["17 of 37", "45%", "10 of 20", "4 of 9", "3 of 8", "15 of 30", "1 of 5", "1 of 2"]
    html = ""
    for block, values in (("totals", totals), ("strikes", strikes)):
        for _ in ("summary", "round 1", "round 2"):
            html += cell("Al One", "Bo Two") + "".join(cell(v, v) for v in values)
    page = spark.createDataFrame([(1, f"<table>{html}</table>")], "page_id int, html string")
    records = pg.stat_records(pg.stat_cells(page, ["page_id"], cell_class="col"), ["page_id"])
    assert records.agg(F.max("record")).first()[0] == 5
    rows = {(r.FIGHTER, r.ROUND): r for r in pg.round_stats(records, ["page_id"]).collect()}
    assert set(rows) == {(n, r) for n in ("Al One", "Bo Two") for r in ("Round 1", "Round 2")}
    one = rows[("Bo Two", "Round 2")]
    assert (one["SIG.STR."], one["CTRL"], one["HEAD"], one["GROUND"]) == ("17 of 37", "1:05", "10 of 20", "1 of 2")


def test_nodes_of_nested_and_broken_pages(spark):
    page = """<!-- <td>no</td> --><TABLE class=t><tr><td class="col a" id=x>A<p>one<p>two<table><tr><td><p>inner</table>tail<td>plain &amp; <b>bold</td><script>var s="</td><p>";</script>
      <ul><li>x<ul><li>y</ul><li>z</ul></i><a title='t"' href = /u>go</a><br/><a>no target</a>"""
    nodes = pn.nodes_of(page)
    short = [(parent, tag, text) for _, parent, _, tag, _, text, _ in nodes[1:]]
    assert [t for _, t, _ in short] == ["table", "tr", "td", "p", "p", "table", "tr", "td", "p", "td", "b", "script", "ul", "li", "ul", "li", "li", "a", "br", "a"]
    assert nodes[3][4] == {"class": "col a", "id": "x"} and nodes[18][4] == {"title": 't"', "href": "/u"}
    assert short[3] == (3, "p", "one") and short[4][:2] == (3, "p") and short[9] == (2, "td", "plain & bold")
    assert [n[6] for n in nodes if n[3] == "p"] == [3, 3, 8]
    assert [short[i][0] for i in (13, 15, 16)] == [13, 15, 13]  # the first and third item are in the outer list
    df = spark.createDataFrame([(1, page), (2, "no cells"), (3, None), (4, "")], "page_id int, html string")
    table = pn.page_nodes(df, ["page_id"])
    cells = sorted(((r.page_id, r.cell, r.side, r.pair, r.value) for r in pn.node_cells(table, ["page_id"]).collect()), key=str)
    assert cells == sorted([(1, 0, 0, 0, "one"), (1, 0, 1, 0, "two"), (1, 1, 0, 0, "inner"), (1, 2, 0, 0, "plain & bold"), (2, None, None, None, None), (3, None, None, None, None), (4, None, None, None, None)], key=str)
    assert [tuple(r) for r in pn.node_links(table, ["page_id"]).collect()] == [(1, 0, "/u", "go")]
    assert pn.node_cells(table, ["page_id"], cell_class="col").where("cell IS NOT NULL").count() == 2
    assert pn.page_nodes(df.limit(0), ["page_id"]).count() == 0


def test_nodes_leave_a_task_in_small_batches(spark, monkeypatch):
    """What a task holds follows the size of some pages and not their number in an Arrow batch."""
    pages = [(i, f"<ul>{'<li><a href=x>y</a></li>' * (i % 5)}</ul>" if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(pages, "id int, html string").coalesce(1)
    want = sorted((i, n[0], n[3], n[5]) for i, page in pages for n in pn.nodes_of(page or ""))
    monkeypatch.setattr(pn, "AT_ONCE", 300)
    run = pn.node_batches(["id"])
    table = pn.pa.table({"id": [p[0] for p in pages], "html": [p[1] for p in pages]})
    got = list(run(iter(table.to_batches())))
    assert len(got) > 10 and max(b.num_rows for b in got) < 20
    assert sorted((r["id"], r["node"], r["tag"], r["text"]) for b in got for r in b.to_pylist()) == want
    assert sorted(map(tuple, pn.page_nodes(df, ["id"]).select("id", "node", "tag", "text").collect())) == want


def test_irregular_pages_go_through_batches(spark):
    page = spark.createDataFrame([(1, "a|b"), (2, "c")], "page_id int, html string")
    got = pg.irregular_items(page, "page_id int, item string", lambda key, html: [(key, x) for x in html.split("|")], ["page_id"])
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (1, "b"), (2, "c")]


def test_late_matches_change_only_what_follows_from_them(spark, tmp_path):
    cols = "match_id int, league string, ts date, a string, b string, score double"
    early = [(1, "l", dt.date(2020, 1, 1), "a", "b", 1.0), (2, "l", dt.date(2020, 2, 1), "a", "c", 1.0), (5, "l", dt.date(2020, 2, 2), "x", "y", 1.0), (6, "m", dt.date(2020, 2, 2), "a", "y", 1.0)]
    late = [(3, "l", dt.date(2020, 1, 15), "a", "d", 0.0), (4, "l", dt.date(2020, 3, 1), "b", "c", 1.0), (7, "l", dt.date(2020, 3, 1), "x", "a", None)]
    last = [(0, "l", dt.date(2020, 1, 1), "b", "e", 0.0), (8, "l", None, "c", "d", 1.0)]
    base, landing = str(tmp_path), str(tmp_path / "landing")
    for n, part in enumerate((early, late, last)):
        inputs = R.rating_inputs(spark.createDataFrame(part, cols), "linear")
        inputs.write.mode("append").parquet(landing)
        sr.rate_stream(ingest.file_stream(spark, landing, inputs.schema), "linear", base).awaitTermination()
        whole = R.rate(R.rating_inputs(spark.createDataFrame(sum((early, late, last)[: n + 1], []), cols), "linear"), "linear")
        plain = lambda df: {r.match_id: tuple(None if r[c] is None else round(r[c], 9) for c in R.OUT) for r in df.collect()}
        assert plain(sr.rated_so_far(spark, base)) == plain(whole)
        if n == 1:
            assert {r.match_id: r.late for r in sr.rated_so_far(spark, base).collect()} == {1: False, 2: False, 3: True, 4: False, 5: False, 6: False, 7: False}
    stored = spark.createDataFrame(early, cols)
    assert {r.match_id for r in sr.affected(stored, spark.createDataFrame(late[:1], cols)).collect()} == {2}


def test_late_batches_find_components_once(spark, tmp_path, monkeypatch):
    cols = "match_id int, league string, ts date, a string, b string, score double"
    rows = [(n, "l", dt.date(2020, 1, 1) + dt.timedelta(n % 40), f"p{n % 5}{n % 2}", f"p{n % 7 % 5}{n % 2}x", float(n % 2)) for n in range(80)]
    base, landing, calls, real = str(tmp_path), str(tmp_path / "landing"), [], R.components
    monkeypatch.setattr(R, "components", lambda *x: calls.append(1) or real(*x))
    spark.conf.set("spark.duelframe.maxGroupRows", "45")
    try:
        for n in (0, 1):
            inputs = R.rating_inputs(spark.createDataFrame([r for r in rows if (r[0] % 5 == 0) == (n == 1)], cols), "linear")
            inputs.write.mode("append").parquet(landing)
            del calls[:]
            sr.rate_stream(ingest.file_stream(spark, landing, inputs.schema), "linear", base).awaitTermination()
    finally:
        spark.conf.unset("spark.duelframe.maxGroupRows")
    assert len(calls) == 1
    plain = lambda df: {r.match_id: tuple(round(r[c], 9) for c in R.OUT) for r in df.collect()}
    assert plain(sr.rated_so_far(spark, base)) == plain(R.rate(R.rating_inputs(spark.createDataFrame(rows, cols), "linear"), "linear"))


def test_long_chains_of_late_matches_take_one_pass(spark):
    """What follows from a match is found in as many jobs for a chain of fifty as for a single meeting; unknown sides pass nothing on."""
    cols = "match_id int, league string, ts date, a string, b string"
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    chain = [(n, "l", day(n), f"p{n}", f"p{n + 1}") for n in range(1, 51)]
    stored = spark.createDataFrame([*chain, (90, "l", day(90), "p50", None), (91, "l", day(91), "q", None), (92, "m", day(92), "p9", "p8"), (93, None, day(93), "p9", "p8"), (94, "l", day(94), None, None)], cols)
    spark.sparkContext.setJobGroup("chain", "chain")
    got = {r.match_id for r in sr.affected(stored, spark.createDataFrame([(0, "l", day(0), "p0", "p1")], cols)).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {*range(1, 51), 90}
    assert jobs < 20


def test_late_rows_and_repeats_over_batches(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    schema = "id int, ts timestamp, v string"
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([(1, day(1), "a")], [(2, day(9), "b"), (2, day(9), "c")], [(5, day(20), "d"), (None, day(3), "n")], [(3, day(2), "late"), (4, day(21), "e"), (2, day(9), "again"), (None, day(4), "m")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(landing)
        stream = ingest.new_rows(ingest.file_stream(spark, landing, spark.read.parquet(landing).schema), "ts")
        ingest.append_new(stream, out, str(tmp_path / "ck"), ["id"]).awaitTermination()
    got = sorted(((r.id, r.v) for r in spark.read.parquet(out).collect()), key=str)
    assert got == [(1, "a"), (2, "b"), (3, "late"), (4, "e"), (5, "d"), (None, "n")]


def test_a_batch_asks_for_its_own_keys_only(spark, tmp_path):
    """Nothing but the landed files is read, and the state changes by the keys of the batch."""
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(3):
        spark.range(n * 100, n * 100 + 120).selectExpr("id", "id % 7 AS v").coalesce(1).write.mode("append").parquet(landing)
        query = ingest.append_new(ingest.file_stream(spark, landing, spark.read.parquet(landing).schema), out, str(tmp_path / "ck"), ["id"])
        query.awaitTermination()
        state = query.lastProgress["stateOperators"][0]
        assert (query.lastProgress["numInputRows"], state["numRowsUpdated"], state["numRowsTotal"]) == (120, 120, n * 100 + 120)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(320))


def test_merging_rewrites_only_touched_buckets(spark, tmp_path):
    path, landing = str(tmp_path / "t"), str(tmp_path / "in")
    table = BucketTable(spark, path, ["id"], 8)
    whole, held = {}, []
    for n, ids in enumerate([range(100), [3, 4], [3, 200], [4]]):
        rows = [(i, n, f"{n}-{i}") for i in ids]
        whole |= {i: v for i, _, v in rows}
        spark.createDataFrame(rows, "id long, seen int, v string").coalesce(1).write.mode("append").parquet(landing)
        stream = ingest.file_stream(spark, landing, spark.read.parquet(landing).schema)
        ingest.merge_snapshots(stream, path, str(tmp_path / "ck"), ["id"], ["seen"], buckets=8).awaitTermination()
        assert {r.id: r.v for r in ingest.latest_version(spark, path).collect()} == whole
        touched = table.touched(spark.createDataFrame(rows, "id long, seen int, v string"))
        held.append(table.manifest(n))
        assert {b for b, v in held[n].items() if v == n} == set(touched)
        assert n == 0 or all(held[n][b] == v for b, v in held[n - 1].items() if b not in touched)
    left = {(int(p.parent.name.split("=")[1]), int(p.name.split("=")[1])) for p in (tmp_path / "t" / "data").glob("version=*/bucket=*")}
    assert left == {(v, b) for n in (2, 3) for b, v in held[n].items()}  # the last two versions, nothing older


def test_new_keys_are_added_beside_the_held_ones(spark, tmp_path, monkeypatch):
    """Matches in time order are written once; a bucket of many versions is written as one."""
    cols = "match_id int, league string, ts date, a string, b string, score double"
    base, landing = str(tmp_path), str(tmp_path / "landing")
    monkeypatch.setattr("duelframe.streaming.buckets.MOST", 3)
    for n in range(5):
        rows = [(10 * n + i, "l", dt.date(2020, 1 + n, 1 + i), f"p{i % 3}", "q", 1.0) for i in range(4)]
        R.rating_inputs(spark.createDataFrame(rows, cols), "linear").write.mode("append").parquet(landing)
        sr.rate_stream(ingest.file_stream(spark, landing, spark.read.parquet(landing).schema), "linear", base, buckets=1).awaitTermination()
        written = spark.read.parquet(f"{base}/matches/data/version={n}").count()
        assert written == (4 if n < 3 else 16 if n == 3 else 4)
        got = sr.rated_so_far(spark, base)
        assert sorted(r.match_id for r in got.collect()) == sorted(10 * m + i for m in range(n + 1) for i in range(4))
    whole = R.rate(spark.read.parquet(landing), "linear")
    plain = lambda df: {r.match_id: tuple(round(r[c], 9) for c in R.OUT) for r in df.collect()}
    assert plain(got) == plain(whole)


def test_ingest_after_an_instant(spark, tmp_path):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2023, 1, 1))], "id int, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.new_rows(ingest.file_stream(spark, str(tmp_path / "in"), rows.schema), "ts", F.lit("2023-06-01").cast("timestamp"))
    ingest.append_new(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["id"]).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [r.id for r in out.collect()] == [1] and ingest.high_water_mark(out, "ts") == dt.datetime(2024, 1, 1)


def test_column_guessing(spark):
    df = spark.createDataFrame([(1, 2)], "fight_date int, Page_URL int")
    assert (src.column_like(df, "date"), src.column_like(df, "url"), src.column_like(df, "zzz")) == ("fight_date", "Page_URL", None)
