"""The second look as a whole, its judge, its lock and its cache."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from ripplespark.config import Rerank, Scoring
from ripplespark.operators import judge as J
from ripplespark.plans import rerank as P
from ripplespark.sources.stores import ContentCache, LockStore

QUICK = Rerank(timeout_s=0.2, max_retries=2, concurrency=4)
SIGNALS = "changed string, test string, score double, signals array<struct<type:string>>"


def test_a_slow_judge_is_given_up():
    started = time.perf_counter()
    got = J.answer(lambda p: time.sleep(5), "x", QUICK, wait=lambda s: None)
    assert got == J.Answer(None, "timeout", 3) and time.perf_counter() - started < 2
    calls = iter([5.0, 0.0])
    assert J.answer(lambda p: time.sleep(next(calls)) or "late", "x", QUICK, wait=lambda s: None) == J.Answer("late", "answered", 2)


@pytest.mark.parametrize(("status", "told", "outcome", "tries", "waits"), [
    (429, 7.0, "failed", 3, [7.0, 7.0]), (429, 900.0, "failed", 3, [60.0, 60.0]), (503, None, "failed", 3, [0.5, 1.0]), (400, None, "refused", 1, []), (401, 5.0, "refused", 1, []), (None, None, "failed", 3, [0.5, 1.0]),
])
def test_errors_of_a_judge(status, told, outcome, tries, waits):
    seen = []

    def ask(prompt):
        raise J.JudgeError("no", status, told)

    assert J.answer(ask, "x", QUICK, wait=seen.append) == J.Answer(None, outcome, tries)
    assert seen == waits


def test_no_more_calls_at_once_than_allowed_and_none_of_a_dead_judge():
    now, most, lock = 0, 0, threading.Lock()

    def ask(prompt):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.01)
        with lock:
            now -= 1
        return prompt

    pool = J.Pool(ask, QUICK, 3)
    assert [a.reply for a in pool.all([str(k) for k in range(40)])] == [str(k) for k in range(40)] and most == 3

    def dead(prompt):
        raise OSError

    got = J.Pool(dead, QUICK, 1, wait=lambda s: None).all(["x"] * 50)
    assert [a.outcome for a in got] == ["failed"] * J.MAX_OUTAGES + ["skipped"] * (50 - J.MAX_OUTAGES)


def test_replies_keep_all_rows(spark):
    def ask(prompt):
        if prompt == "bad":
            raise J.JudgeError("no", 400)
        if prompt == "slow":
            time.sleep(3)
        return prompt.upper()

    rows = [(1, "a", [1]), (2, "bad", None), (3, "slow", []), (4, None, [2]), (4, "a", [1])]
    got = J.replied(spark.createDataFrame(rows, "id int, prompt string, reply_to array<int>"), ask, QUICK, wait=lambda s: None).collect()
    assert sorted((r.id, r.reply or "", r.outcome) for r in got) == [(1, "A", "answered"), (2, "", "refused"), (3, "", "timeout"), (4, "", "skipped"), (4, "A", "answered")]


ROW = "changed string, test string, state string, reason string, confirmed_at string, at bigint"


def decisions(spark, *rows):
    return spark.createDataFrame([(c, t, s, "", None, at) for c, t, s, at in rows], ROW)


def test_lock_store(spark, tmp_path):
    store = LockStore(spark, str(tmp_path))
    held = lambda: {(r.changed, r.test): r.state for r in store.read().collect()}
    assert held() == {}
    store.append(decisions(spark, ("a", "t", "confirmed", 1), ("a", "u", "rejected", 1)))
    store.append(decisions(spark, ("a", "t", "rejected", 3)))
    store.append(decisions(spark, ("a", "t", "confirmed", 2), ("b", "t", "confirmed", 1)))
    after = {("a", "t"): "rejected", ("a", "u"): "rejected", ("b", "t"): "confirmed"}
    assert held() == after
    assert store.compact() == 3 and held() == after
    store.append(decisions(spark, ("b", "t", "rejected", 9)))
    assert held() == after | {("b", "t"): "rejected"}
    assert store.compact() == 4 and store.compact() == 4 and held() == after | {("b", "t"): "rejected"}


def test_two_writers_and_a_compaction_lose_nothing(spark, tmp_path):
    store = LockStore(spark, str(tmp_path))
    store.append(decisions(spark, ("x", "x", "confirmed", 0)))

    def write(name):
        for k in range(3):
            LockStore(spark, str(tmp_path)).append(decisions(spark, (name, f"t{k}", "confirmed", k)))

    threads = [threading.Thread(target=write, args=(n,)) for n in ("a", "b")]
    for t in threads:
        t.start()
    store.compact()
    for t in threads:
        t.join()
    assert store.read().count() == 7
    store.compact()
    (tmp_path / "log" / "batch=lost" / "_temporary").mkdir(parents=True)  # what a lost writer leaves
    assert store.read().count() == 7


def test_a_second_run_computes_nothing(spark, tmp_path):
    cache, asked = ContentCache(spark, str(tmp_path)), []

    def compute(new):
        rows = new.collect()
        asked.append(len(rows))
        return new.select("digest", F.when(F.col("text") != "bad", F.length("text").cast("double")).alias("value"))

    texts = spark.createDataFrame([(1, "aa"), (2, "bbb"), (3, "aa"), (4, None), (5, ""), (6, "bad")], "id int, text string")
    got = lambda df: sorted((r.id, r.value) for r in cache.values(df, compute).collect())
    first = got(texts)
    assert first == [(1, 2.0), (2, 3.0), (3, 2.0), (4, None), (5, 0.0), (6, None)] and asked == [4]
    assert got(texts) == first and asked == [4, 1]  # what gave no value is asked again
    assert got(texts.where("id < 4").unionByName(spark.createDataFrame([(9, "cccc")], texts.schema))) == [(1, 2.0), (2, 3.0), (3, 2.0), (9, 4.0)] and asked == [4, 1, 1]
    assert got(texts.where("id < 4")) == first[:3] and asked[-1] == 0


def pair(test, score, kind="redux-chain", changed="src/a.ts"):
    return (changed, test, score, [(kind,)])


def test_the_whole_second_look(spark, tmp_path):
    counted = tmp_path / "calls"
    counted.mkdir()

    def ask(prompt):
        (counted / f"{time.time_ns()}-{threading.get_ident()}").touch()
        if "cosmetic" in prompt.split("\n")[0]:
            return '{"cosmetic": %s, "confidence": 0.95}' % str("CHANGE src/c.ts" in prompt).lower()
        test = prompt.split("TEST ")[1].split("\n")[0]
        if test == "refused":
            raise J.JudgeError("no", 400)
        return {"dropped": '{"relevant": false, "confidence": 0.95}', "doubted": '{"relevant": false, "confidence": 0.6}', "garbled": "hm", "good": 'so {"relevant": true, "confidence": 1, "why": ["calls it"]}'}[test]

    pairs = [pair("sure", 0.95), pair("weak", 0.35), pair("anchored", 0.6, "direct-import"), *(pair(t, 0.6) for t in ("dropped", "doubted", "garbled", "good", "refused", "rejected", "confirmed")), pair("good", 0.6, changed="src/c.ts")]
    store = LockStore(spark, str(tmp_path / "lock"))
    store.append(decisions(spark, ("src/a.ts", "rejected", "rejected", 1), ("src/a.ts", "confirmed", "confirmed", 1)))
    given = spark.createDataFrame(pairs, SIGNALS)
    summaries = spark.createDataFrame([("src/a.ts", "- x\n+ y"), ("src/c.ts", "blank")], "changed string, summary string")
    excerpts = spark.createDataFrame([("good", "it works")], "test string, excerpt string")
    cfg = Rerank(band_max=0.8, timeout_s=5)
    run = lambda: P.rerank(given, summaries, excerpts, ask, str(tmp_path / "run"), cfg, Scoring(min_confidence=0.3), P.Style(triage=True), store, 5, lambda s: None)
    got = {r.test: r for r in run().collect()}
    assert set(got) == {"sure", "weak", "anchored", "doubted", "garbled", "good", "refused", "confirmed"}
    assert {t: r.note for t, r in got.items()} == {"sure": "Strong match", "weak": "Not evaluated", "anchored": "Direct match", "doubted": "Low confidence", "garbled": "Not evaluated", "good": "Strong match", "refused": "Not evaluated", "confirmed": "Strong match"}
    assert got["good"].score == pytest.approx(0.84) and got["good"].confidence == "high" and got["good"].points[0].point == "calls it"
    assert got["doubted"].score == pytest.approx(0.48) and got["garbled"].score == 0.6 and got["confirmed"].score == pytest.approx(0.8)
    assert got["refused"].outcome == "refused" and got["garbled"].outcome == "answered" and got["sure"].outcome == "unasked"
    assert [got[t].rank for t in ("sure", "good", "confirmed")] == [1, 2, 3]
    state = {(r.changed, r.test): r.state for r in store.read().collect()}
    assert state == {("src/a.ts", "rejected"): "rejected", ("src/a.ts", "confirmed"): "confirmed", ("src/a.ts", "dropped"): "rejected", ("src/a.ts", "good"): "confirmed"}
    calls = len(list(counted.iterdir()))
    again = {r.test: r for r in run().collect()}  # taken up again, it asks and decides nothing anew
    assert again == got and len(list(counted.iterdir())) == calls
    (tmp_path / "run" / "decided" / "_SUCCESS").unlink()  # as if it had been lost while writing this
    assert {r.test: r for r in run().collect()} == got and len(list(counted.iterdir())) == calls


def test_a_dead_judge_loses_nothing(spark, tmp_path):
    def ask(prompt):
        raise OSError("down")

    given = spark.createDataFrame([pair(f"t{k}", 0.6) for k in range(12)], SIGNALS)
    none = spark.createDataFrame([], "changed string, summary string"), spark.createDataFrame([], "test string, excerpt string")
    got = P.rerank(given, *none, ask, str(tmp_path / "run"), QUICK, Scoring(max_results=20), wait=lambda s: None).collect()
    assert len(got) == 12 and {r.note for r in got} == {"Not evaluated"} and {r.score for r in got} == {0.6}
