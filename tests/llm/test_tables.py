import duckdb
import numpy as np

from agentmetrics.llm import catalog, mixing, url_filter, vector_search
from pyspark.sql import functions as F


def test_mixture_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    cursor = con.execute(catalog.SQL["op1_mixing"])
    names = [c[0] for c in cursor.description]
    got = catalog.QUERIES["op1_mixing"](spark, folder)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cursor.fetchall())


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", "y", 1000)], "_top string, _sub string, _tokens long")
    got = {(r["_top"], r["_sub"]): r["_budget"] for r in mixing.budgets(leaves, ["top", "sub"], {}, 800, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 390, ("b", "x"): 200, ("b", "y"): 200}
    short = leaves.where("NOT (_top = 'a' AND _sub = 'y')")
    got = {(r["_top"], r["_sub"]): r["_budget"] for r in mixing.budgets(short, ["top", "sub"], {}, 800, 1).collect()}
    assert got == {("a", "x"): 10, ("b", "x"): 395, ("b", "y"): 395}  # all of a is full, so b gets the rest
    zero = mixing.budgets(leaves, ["top", "sub"], {"top": {"b": 0}}, 3000, 1).collect()
    assert {(r["_top"], r["_sub"]): r["_budget"] for r in zero} == {
        ("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 0, ("b", "y"): 0}


def test_mixture_of_odd_documents(odd):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    out = mixing.mix(odd, {}, levels, total=400000, max_epochs=3)
    assert out.columns == odd.columns and {r["_doc"] for r in out.select("_doc").collect()} == {"clash"}
    chosen = mixing.mix_table(odd, {}, levels, total=400000, max_epochs=3).collect()
    assert len(chosen) == out.count()
    copies = [r.epoch for r in chosen if r.doc_id == 9]
    assert sorted(copies) == [0, 0, 1, 1, 2, 2]  # both rows of an id, in each epoch
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mix_table(odd.limit(0)).count() == 0


def brute_rule(host, path):
    best = None
    for h, p, verdict in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best or (None, None)


def test_urls_rules_and_templates(spark):
    urls = ["HTTP://A.Example.ORG/en/1?x", "http://example.org/es/2#f", "http://org", "http://b.com/fr/1", "http://b.com/de/2",
            "http://b.com/en/3", "no scheme", None, "", "x://H.net?q=/fr/", "x://h.net/A/B/C/D/E/F9", "http://b.com/fr/1",
            "://", "a://b://c/d", "http://ÉA.com/fr/é\n1"]
    urls += [f"http://good.com/fr/{i}" for i in range(30)] + [f"http://bad.com/de/{i}" for i in range(30)]
    urls += ["http://good.com/en/7", "http://bad.com/en/7"]
    table = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://b.com/en/3")], "page_id long, url string") \
        .withColumn("host", F.lit("clash")).withColumn("_size", F.lit(1))
    got = url_filter.judged(table).collect()
    assert len(got) == len(urls) + 1
    by_id = {r.page_id: r for r in got}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        ends = [rest.find(c) for c in "/?#" if c in rest] or [len(rest)]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:min(ends)])
        path = rest[min(ends):].split("?")[0].split("#")[0]
        rule, verdict = brute_rule(host, path)
        assert (by_id[i].host, by_id[i].path, by_id[i].rule) == (host, path, rule)
        assert by_id[i].verdict == verdict if rule else by_id[i].verdict in ("allow", "block")
    assert by_id[len(urls) - 2].verdict == "allow" and by_id[len(urls) - 1].verdict == "block"
    assert by_id[15].template == "/fr/*" and by_id[10].template.endswith("/**")
    assert url_filter.judged(table.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judged(table, rules=[]).collect()} == {"allow"}


def brute_top(rows, k, every):
    fit = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            fit[i] = [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]
    out = []
    for q, v in fit.items():
        if q % every == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fit.items() if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near[:k])]
    return sorted(out)


def test_search_with_odd_vectors_and_ties(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 0.3, 8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[3][1]) for i in range(300, 360)]  # copies: ties go to smaller ids
    rows += [(400, None), (401, []), (402, [1.0, None] + [0.0] * 6), (403, [float("nan")] * 8), (404, [float("inf")] * 8),
             (None, rows[0][1]), (405, [0.5, 0.5]), (410, [0.25, 0.5]), (406, [0.0] * 8), (50, rows[50][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    want = brute_top(rows, 5, 10)
    for block in (4096, 37):
        got = vector_search.top_k(table, every=10, block_rows=block)
        assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == want
    assert vector_search.top_k(table.limit(0)).count() == 0


def test_bounds_spare_exact_vectors():
    rng = np.random.default_rng(9)
    values = rng.normal(0, 60, (4000, 16)).astype(np.int64)
    codes, low, step = vector_search.cells_of(values)
    ids = np.arange(4000)[:, None]
    who, found, scores, read = vector_search.search_block(ids, values, codes, low, step, np.arange(0, 4000, 100), values[::100], 5)
    assert read < 40 * 4000 / 10
    for q in range(0, 4000, 100):
        order = sorted((-int(s), i) for i, s in enumerate(values @ values[q]) if i != q)[:5]
        assert [(i, s) for w, i, s in zip(who, found, scores) if w == q] == [(i, -s) for s, i in order]


def test_negative_ids_are_candidates(spark):
    rows = [(-7, [2.0, 1.0]), (0, [1.0, 0.0]), (-50, [1.0, 0.5]), (3, [0.5, 0.5]), (-8, [2.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    for q, v in rows:
        if q % 50 == 0:
            best = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(v, w)), i) for i, w in rows if i != q)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best[:5])]
    assert sorted(tuple(r) for r in vector_search.top_k(table).collect()) == sorted(want)
