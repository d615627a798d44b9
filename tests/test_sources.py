import subprocess

import pytest

from ripplespark.config import load
from ripplespark.operators import fusion
from ripplespark.sources import files as S
from ripplespark.sources import history as H


def test_config():
    cfg = load({"scoring": {"min_confidence": 0.5, "temporal": {"window_days": 7}}, "source": {"ignore_dirs": ["gen"]}})
    assert cfg.scoring.min_confidence == 0.5 and cfg.scoring.high_confidence == 0.8 and cfg.scoring.temporal.window_days == 7
    assert "node_modules" in cfg.source.ignore_dirs and "gen" in cfg.source.ignore_dirs
    for wrong in ({"scoring": {"high_confidence": 0.1}}, {"source": {"root": ""}}, {"nothing": 1}):
        with pytest.raises(ValueError):
            load(wrong)


def test_scan(spark, tmp_path):
    for name in ("src/a.ts", "src/b c.tsx", "src/a.test.ts", "node_modules/x.ts", "src/readme.md", "src/old/z.ts"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("export {}\n")
    found, cfg = S.contents(spark, str(tmp_path)), load({"source": {"exclude": ["**/old/**"]}})
    assert {r["path"] for r in S.source_files(found, cfg).collect()} == {"src/a.ts", "src/b c.tsx"}
    assert {r["path"] for r in S.test_files([found, found], cfg).collect()} == {"src/a.test.ts"}
    assert S.test_files([found], cfg, ["src/*.{spec,test}.ts"]).count() == 1


def test_exclusions(spark):
    tests = spark.createDataFrame([("cypress/e2e/ims/05 InterOps/alerts.cy.ts",), ("a\\b interops\\x.cy.ts",), ("cypress/DMSanity.cy.ts",), ("cypress/dmSanity.cy.ts/other.cy.ts",), ("ok.cy.ts",)], "path string")
    kept, out = S.suggestable(tests)
    assert {r["path"] for r in kept.collect()} == {"cypress/dmSanity.cy.ts/other.cy.ts", "ok.cy.ts"}
    assert sorted(r["rule"] for r in out.collect()) == ["dm-sanity", "interops-specs", "interops-specs"]


def test_changes(spark, tmp_path):
    assert {r["path"] for r in S.explicit_changes(spark, " a.ts, b.ts  a.ts,").collect()} == {"a.ts", "b.ts"}
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@example.org", *a], check=True, capture_output=True)
    assert S.changed_paths(spark, str(tmp_path)).isEmpty()
    git("init", "-q")
    for k in range(2):
        (tmp_path / "f.ts").write_text(str(k))
        git("add", "."), git("commit", "-qm", "x")
    assert [r["path"] for r in S.changed_paths(spark, str(tmp_path)).collect()] == ["f.ts"]
    log = H.parse(H.git_log(spark, str(tmp_path))).collect()
    assert len(log) == 1 and log[0]["path"] == "f.ts" and len(log[0]["commits"]) == 2
    assert H.git_log(spark, "/nowhere").isEmpty()
    texts = spark.createDataFrame([("a", " ", "body"), ("b", "d" * 5000, ""), ("c", None, None)], "path string, diff string, content string")
    assert {r["path"]: len(r["summary"]) for r in S.diff_texts(texts).collect()} == {"a": 4, "b": 4000, "c": 1}


def log(spark, *records):
    raw = "".join("\0" + str(ts) + "\n\n" + "\n".join(lines) + "\n" for ts, *lines in records)
    return {r["path"]: r for r in H.parse(H.records(spark.createDataFrame([("r", raw)], "repo string, raw string"))).collect()}


def test_history(spark):
    got = log(spark, (300, "M\ta"), (200, "M\ta", "A\tb"), (100, "A\ta"))
    assert (got["a"]["created_at"], got["a"]["updated_at"]) == (100, 300)
    assert [(c["ts"], c["size"]) for c in got["a"]["commits"]] == [(300, 1), (200, 2), (100, 1)] and [c["ts"] for c in got["b"]["commits"]] == [200]
    got = log(spark, (500, "M\ta", "D\tx", "D\ty"))
    assert set(got) == {"a"} and got["a"]["commits"][0]["size"] == 3
    got = log(spark, (300, "R090\tb.ts\tc.ts"), (200, "R100\ta.ts\tb.ts"), (100, "A\ta.ts"))
    assert set(got) == {"c.ts"} and [c["ts"] for c in got["c.ts"]["commits"]] == [300, 200, 100]
    got = log(spark, (100, "C100\tsrc.ts\tcopy.ts"), (50, "M\tdir/a b.ts"))
    assert set(got) == {"copy.ts", "dir/a b.ts"} and got["copy.ts"]["created_at"] == 100


def test_locales(spark):
    files = spark.createDataFrame([("en/a.json", '{"x":{"y":"Hi {{n}}  all","z":"%(k)s!"},"n":1,"w":"Plain"}'), ("en/b.json", "{oops"), ("en/c.json", "{}"), ("en/d.json", None)], "path string, content string")
    texts, warnings = S.locale_texts(files, namespaced=True)
    got = {r["key"]: (r["static_text"], r["is_dynamic"]) for r in texts.collect()}
    assert got == {"a.x.y": ("Hi all", True), "a.x.z": ("!", True), "a.w": ("Plain", False)}
    assert {r["path"]: r["code"] for r in warnings.collect()} == {"en/b.json": "INVALID_JSON", "en/c.json": "EMPTY_TRANSLATION_FILE", "en/d.json": "FILE_NOT_FOUND"}
    assert [r["path"] for r in S.missing_locales(spark, ["en", "fr/"], files).collect()] == ["fr"]


def test_aliases(spark):
    configs = {"tsconfig.json": {"extends": "./base/tsconfig.json", "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}}, "base/tsconfig.json": {"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["wrong/*"], "@lib/*": ["lib/*"]}}}}
    aliases, roots = S.tsconfig_aliases(configs, "tsconfig.json")
    assert aliases == {"@": "src", "@lib": "base/lib"} and len(roots) == 2
    vite = spark.createDataFrame([("vite.config.ts", "alias: { '@': path.resolve(__dirname, './src') }, x: [{ find: '~', replacement: path.resolve(__dirname, 'lib') }, {find: \"#\", replacement: 'types/'}]")], "path string, content string")
    assert {r["prefix"]: r["target"] for r in S.bundler_aliases(vite).collect()} == {"@": "src", "~": "lib", "#": "types"}


def test_registry_tables(spark, tmp_path):
    df = spark.createDataFrame([("r", "a.ts", "x"), ("r", "b.ts", "y")], "repo_root string, path string, content string")
    S.write_registry({"manifest": S.manifest(df)}, str(tmp_path / "reg"))
    stored = S.read_registry(spark, str(tmp_path / "reg"), ["manifest"])["manifest"]
    now = spark.createDataFrame([("r", "a.ts", "x"), ("r", "b.ts", "z"), ("r", "c.ts", "")], "repo_root string, path string, content string")
    assert {r["path"] for r in S.stale(now, stored).collect()} == {"b.ts", "c.ts"}
    signals = spark.createDataFrame([("c", "t", "colocation", 0.75, True, "r")], "changed string, test string, type string, weight double, anchor_eligible boolean, reason string")
    S.write_results(fusion.results(fusion.fuse(signals)), str(tmp_path / "out"))
    assert '"changed":"c"' in spark.read.text(str(tmp_path / "out")).first()[0]
