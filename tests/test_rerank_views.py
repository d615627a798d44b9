import pytest
from pyspark.sql import functions as F

from ripplespark.config import Rerank
from ripplespark.functions import text as T
from ripplespark.operators import graph as G
from ripplespark.operators import rerank as R
from ripplespark.operators import views as V
from ripplespark.streaming import upsert as U
from tests.helpers import entry, paths, table

PAIR = "changed string, test string, score double, signals array<struct<type:string>>"


def test_bands_and_decisions(spark):
    pairs = spark.createDataFrame([("c", "hi", 1.0, []), ("c", "lo", 0.3, []), ("c", "own", 0.6, [("colocation",)]), ("c", "a", 0.7, []), ("c", "b", 0.7, []), ("c", "d", 0.5, [])], PAIR)
    cfg = Rerank(max_candidates=2)
    fates = {r["test"]: r["fate"] for r in R.banded(pairs, cfg).collect()}
    assert fates == {"hi": "auto-kept", "lo": "below-band", "own": "protected", "a": "judge", "b": "judge", "d": "over-cap"}
    replies = R.banded(pairs, cfg).withColumn("reply", F.when(F.col("test") == "a", '{"relevant": false, "confidence": 0.95}').when(F.col("test") == "b", "oops"))
    out = R.decided(R.verdict(replies), cfg)
    got = {r["test"]: (r["kept"], r["failed"], r["note"]) for r in out.collect()}
    assert got["a"][0] is False and got["b"] == (True, True, "Not evaluated") and got["own"][2] == "Direct match" and got["hi"][2] == "Strong match"
    summary = V.rerank_summary(out).first()
    assert (summary["judged"], summary["dropped"], summary["failed"], summary["active"]) == (2, 1, 1, True)
    assert "1 of 2" in R.warning(out).first()["warning"]
    triage = spark.createDataFrame([("c", True, 0.95)], "changed string, cosmetic boolean, confidence double")
    assert R.untriaged(pairs, triage).isEmpty()


@pytest.mark.parametrize(
    ("reply", "expected"),
    [
        ('{"relevant": true, "confidence": 0.9}', (True, 0.9, [])), ('say {"relevant": false, "why": [{"tag": " x ", "file": "@f", "point": "p"}, "q", {}, 5]} end', (False, 0.5, [("x", "f", "p"), ("", "", "q")])),
        ('{"relevant": true, "why": " one "}', (True, 0.5, [("", "", "one")])), ('{"relevant": true, "confidence": 7}', (True, 1.0, [])), ('{"relevant": "yes"}', None), ("no json", None), (None, None),
        ('{"relevant": true, "why": ["a","b","c","d","e","f"]}', (True, 0.5, [("", "", x) for x in "abcde"])), ('{"relevant": true, "confidence": "0.9"}', (True, 0.5, [])),
    ],
)
def test_verdicts(spark, reply, expected):
    got = R.verdict(spark.createDataFrame([(reply,)], "reply string")).first()["verdict"]
    assert (got and (got["relevant"], got["confidence"], [tuple(p) for p in got["why"]])) == expected


def test_other_replies(spark):
    ask = lambda form, *replies: [(r["relevant"], r["confidence"]) for r in R.parsed_replies(spark.createDataFrame(list(enumerate(replies)), "n int, reply string"), form).orderBy("n").collect()]
    assert ask("graded", '{"relevant": "yes", "confidence": "4x"}', '{"relevant": false}', '{"confidence": 2.6}', "junk", '```json\n{"relevant": true, "confidence": 9}\n```') == [(True, 4), (False, 1), (True, 3), (True, 3), (True, 5)]
    assert ask("bucket", '{"score": 0}', '{"score": "3"}', "junk") == [(False, 0), (True, 3), (True, 3)]
    assert [r for r, _ in ask("plain", '{"relevant": false}', '{"relevant": false', "fine")] == [False, False, True]
    calls = spark.createDataFrame([("c", 0, '[{"i":1,"r":true,"reason":"x"},{"i":9,"r":true},{"i":2,"r":"no"}]'), ("c", 1, "broken")], "changed string, call long, reply string")
    cands = spark.createDataFrame([("c", 0, 1), ("c", 0, 2), ("c", 0, 3), ("c", 1, 1)], "changed string, call long, i int")
    assert {(r["call"], r["i"]): r["relevant"] for r in R.parsed_list(calls, cands).collect()} == {(0, 1): True, (0, 2): False, (0, 3): False, (1, 1): True}


def test_asking_retries(spark):
    prompts = spark.createDataFrame([("a",), ("b",)], "prompt string")

    def fails(texts):
        raise RuntimeError

    assert {r["reply"] for r in R.asked(prompts, fails, wait=lambda s: None).collect()} == {None}
    assert {r["reply"] for r in R.asked(prompts, lambda texts: [t.upper() for t in texts]).collect()} == {"A", "B"}


def test_scores_and_locks(spark):
    df = spark.createDataFrame([(0.5, 5), (0.9, 0), (0.8, None)], "s double, b int")
    assert [round(r[0], 6) for r in df.select(R.bucket_score("s", "b")).collect()] == [0.65, 0.0, 0.95]
    assert df.select(R.late_score("s", "b")).first()[0] == pytest.approx(0.8)
    scored = spark.createDataFrame([("c", "a", 0.95, False, 0.1), ("c", "b", 0.5, True, 0.85), ("c", "d", 0.5, False, 0.9), ("c", "e", 0.5, True, 0.2)], "changed string, test string, prior double, relevant boolean, score double")
    assert [(r["test"], r["confidence"]) for r in R.refused(scored).collect()] == [("a", "high"), ("b", "high")]
    lock = spark.sql("SELECT * FROM VALUES ('c','a','confirmed','r',DATE'2024-01-01'), ('c','b','rejected','r',DATE'2024-01-01') AS t(changed,test,state,reason,confirmed_at)")
    pairs = spark.createDataFrame([("c", "a", 0.9), ("c", "b", 0.9), ("c", "d", 0.5)], "changed string, test string, score double")
    assert {r["test"]: (round(r["score"], 6), r["state"]) for r in R.partition_by_lock(pairs, lock).collect()} == {"a": (1.0, "confirmed"), "d": (0.5, "unknown")}
    news = spark.sql("SELECT * FROM VALUES ('c','a','rejected','x',DATE'2024-02-01',2L), ('c','a','confirmed','y',DATE'2024-02-01',1L) AS t(changed,test,state,reason,confirmed_at,at)")
    assert {(r["test"], r["state"]) for r in R.locked(lock, news).collect()} == {("a", "rejected"), ("b", "rejected")}


def test_similarity(spark):
    v = spark.createDataFrame([("c", [1.0, 0.0]), ("x", [1.0, 0.0, 9.0]), ("y", [0.0, 1.0]), ("z", [0.0, 0.0])], "path string, vector array<double>")
    pairs = spark.createDataFrame([("c", t, 0.5) for t in "xyz"], "changed string, test string, prior double")
    got = {r["test"]: round(r["mixed"], 6) for r in R.similar_top_k(pairs, v, Rerank(top_k=2, min_similarity=0.36)).collect()}
    assert got == {"x": 0.65}
    assert R.similar_top_k(pairs, v).count() == 3  # few candidates are all kept
    cache = spark.createDataFrame([], "digest string, value double")
    seen = []
    def compute(new):
        seen.append(new.count())
        return new.select("digest", F.length("text").cast("double").alias("value"))
    texts = spark.createDataFrame([("aa",), ("aa",), ("b",)], "text string")
    values, full = R.cached(texts, cache, compute)
    assert values.count() == 3 and seen == [2]
    R.cached(texts, full, compute)[0].count()
    assert seen == [2, 0]
    p = spark.createDataFrame([("s", "good"), ("s", "bad"), ("s", "worse")], "source_text string, test_text string")
    assert {r["test_text"] for r in R.cross_scored(p, lambda a, b: [5.0 if x == "good" else -5.0 for x in b]).collect()} == {"good"}
    def broken(a, b):
        raise RuntimeError
    assert R.cross_scored(p, broken).count() == 3


def test_excerpts_and_kinds(spark):
    one = lambda col, text: spark.createDataFrame([(text,)], "c string").select(col(F.col("c")).alias("x")).first()["x"]
    text = "/** Signs in */\ndescribe('Login', () => { it('works', () => { cy.visit('/'); cy.get('x').should('be.visible') }) })"
    assert one(R.excerpt, text) == "PURPOSE: Signs in\nSCENARIOS: Login | works\nACTIONS: cy.visit, cy.get\nASSERTIONS: be.visible"
    assert one(R.excerpt, " ") == ""
    assert one(R.bodies_empty, "it('a', () => { // later\n }); test('b', function () { /* x */ })") is True
    assert one(R.bodies_empty, "it('a', () => { run() })") is False
    assert one(R.bodies_empty, "nothing") is False
    assert [one(R.ui_kind, p) for p in ("src/index.tsx", "a/machines/x.ts", "a/hooks/b.ts", "a/cartSlice.ts", "a/containers/X.tsx", "a/utils/y.ts", "a/X.tsx")] == ["entry", "machine", "hook", "reducer", "container", "util", "component"]
    assert [one(R.test_folder, p) for p in ("cypress/tests/api/a.ts", "cypress/tests/ui/a.ts", "src/a.cy.tsx", "x.ts")] == ["api", "ui", "component", "other"]
    lines = "\n".join(str(k) for k in range(200))
    got = one(R.sampled_lines, lines).split("\n")
    assert len([g for g in got if not g.startswith("//")]) == 80 and got[0] == "0" and got[-1] == "199" and got[20] == "// ··· 30 lines left out ···"
    assert one(R.sampled_lines, "short") == "short"
    assert one(R.without_imports, "import a from 'a';\nimport b from 'b';\n\nconst x = 1;\n") == "import a from 'a'; … (1 further ones)\n\n\nconst x = 1;\n"
    assert one(R.without_imports, "const x = 1;") == "const x = 1;"
    tests = table(spark, entry("a/login.spec.ts", "test", cypress={"its": ["x"], "custom_commands": ["loginByOkta", "seedDb", "open"]})).withColumn("content", F.lit("it('x', () => { cy.task('db:seed'); cy.mount(<Panel />) })"))
    row = R.classified(tests).first()
    assert (row["kind"], row["it_count"], row["login_helper"], row["mount_targets"], row["seeded"], row["provider"], row["bypass"]) == ("e2e", 1, "loginByOkta", ["Panel"], True, "okta", ["loginByOkta", "seedDb"])


def test_payloads_and_prompts(spark):
    files = table(spark, entry("src/CartPanel.tsx", exports=["A"], selectors=[{"attr": "id", "value": "v"}]), entry("a.cy.ts", cypress={"describes": ["d"], "its": ["one", "two"], "intercepts": [{"method": "GET", "url_pattern": "/x"}]}))
    assert R.source_payload(files).first()["payload"] == "Source component: cart panel (src/CartPanel.tsx)\nExports: A\nData-test selectors: v"
    assert "Intercepts APIs: GET /x" in R.test_payload(files).first()["payload"]
    assert [r["n"] for r in R.scenario_payloads(files).orderBy("n").collect()] == [0, 1]
    blocks = spark.createDataFrame([("c", 0, 'cy.get([data-testid="long-name"]) /api/long/path/here'), ("c", 1, "x [data-test='other'] [data-testid=\"long-name\"]")], "changed string, n int, block string")
    got = {r["n"]: r for r in R.short_symbols(blocks).collect()}
    assert got[0]["block"] == 'cy.get([data-testid="S1"]) /apiR1' and got[1]["block"] == "x [data-test='S2'] [data-testid=\"S1\"]"
    assert "S1=long-name" in got[0]["legend"] and "R1=/long/path/here" in got[0]["legend"]
    pairs = spark.createDataFrame([("c", f"t{k}", 0.5, "ex", "sum") for k in range(20)], "changed string, test string, score double, excerpt string, summary string")
    wide = R.windows(pairs)
    assert {(r["call"], r["count"]) for r in wide.groupBy("call").count().collect()} == {(0, 16), (1, 4)}
    assert R.list_prompts(wide).count() == 2 and '"relevant"' in R.prompts(pairs).first()["prompt"]


def test_views(spark):
    rows = [("c1", "t", 0.9, "high"), ("c2", "t", 0.95, "medium"), ("c1", "u", 0.5, "medium"), ("c2", "u", 0.5, "medium"), ("c2", "w", 0.1, "low")]
    res = spark.createDataFrame(rows, "changed string, test string, score double, confidence string")
    assert [(r["test"], r["changed"], r["score"]) for r in V.by_test(res).collect()] == [("t", "c1", 0.9), ("u", "c1", 0.5), ("w", "c2", 0.1)]
    assert [r["test"] for r in V.flat(res, 2).collect()] == ["t", "t"]
    assert {r["confidence"]: r["tests"] for r in V.band_counts(V.by_test(res)).collect()} == {"high": 1, "medium": 1, "low": 1}
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(T.short_path(F.lit("a/b/c/d.ts"))) == "…/c/d.ts" and one(T.short_path(F.lit("b/c/d.ts"))) == "b/c/d.ts"
    assert [one(T.elapsed(F.lit(ms))) for ms in (400, 12_300, 125_000)] == ["0s", "12s", "2m 5s"]
    assert one(T.wrapped(F.lit("aa bb  cccccc d"), 5)) == ["aa bb", "cccccc", "d"]
    assert [one(T.normal_path(F.lit(p), "/r")) for p in ("/r/a/../b.ts", "a\\b\\.\\c.ts", "../x")] == ["b.ts", "a/b/c.ts", "../x"]


def test_graph(spark):
    graph = spark.createDataFrame([("t", "a"), ("a", "b"), ("b", "c"), ("t", "b"), ("c", "a"), ("x", "t")], "src string, dst string")
    got = {(r["node"], r["depth"]) for r in G.reachable(paths(spark, "x"), graph).collect()}
    assert got == {("t", 1), ("a", 2), ("b", 2), ("c", 3)}
    assert [tuple(r) for r in G.suggested_specs(paths(spark, "c"), graph, paths(spark, "t", "x")).collect()] == [("t", 2), ("x", 3)]
    assert G.capped_cone(paths(spark, "c"), G.reverse(graph), 3, 2).isEmpty()
    changed = table(spark, entry("t", "test", imports=["z"]))
    assert {(r["src"], r["dst"]) for r in G.updated(graph, changed).collect()} == {("a", "b"), ("b", "c"), ("c", "a"), ("x", "t"), ("t", "z")}
    assert {(r["start"], r["depth"]) for r in G.first_level_hit(paths(spark, "t"), graph, paths(spark, "c"), 3).collect()} == {("t", 2)}


def test_upsert_stream(spark, tmp_path):
    schema = "path string, version int, value string"
    source = tmp_path / "in"
    spark.createDataFrame([("a", 1, "old"), ("b", 1, "b")], schema).coalesce(1).write.parquet(str(source))
    run = lambda: U.follow(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "out"), lambda d: d, str(tmp_path / "check")).awaitTermination()
    run()
    spark.createDataFrame([("a", 2, "mid"), ("a", 3, "new")], schema).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert {(r["path"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out" / "v=1")).collect()} == {("a", "new"), ("b", "b")}
