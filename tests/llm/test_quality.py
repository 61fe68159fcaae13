from collections import Counter

from pyspark.sql import functions as F

from flowsift.llm.quality import MEASURES, HostRules, keep_good, quality_report
from tests.llm.conftest import SCHEMA, WORD, prose


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered, seen, repeats = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        covered |= set(range(i, i + 5)) if times[w] > 1 else set()
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeats, len(covered)


def check(docs):
    wanted = []
    for d in docs.collect():
        m = plain(d.text)
        wanted.append((d.doc_id, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    rows = quality_report(docs).collect()
    order = lambda r: (r[0] is None, *[x or 0 for x in r])
    assert sorted(((r.doc_id, *[r[c] for c in MEASURES], r.base_failed) for r in rows), key=order) == sorted(wanted, key=order)
    assert not any(r.kept and r.base_failed for r in rows)
    return rows


def test_documents(documents):
    rows = check(documents)
    assert all(r.kept != r.base_failed for r in rows)  # no host of these is mostly bad


def test_odd_documents(odd_documents):
    check(odd_documents)


def test_empty(empty_documents):
    assert quality_report(empty_documents).count() == 0 and keep_good(empty_documents).count() == 0


def hosts(spark):
    good = [(i, prose(60, i), "en", f"good{i % 10}", 0) for i in range(200)]
    mixed = [(1000 + i, prose(60, i) if i % 3 else "too short", "en", "mixed", 0) for i in range(60)]
    bad = [(2000 + i, prose(60, i) if i % 10 == 0 else "buy now " * 30, "en", "bad", 0) for i in range(100)]
    new = [(3000, "too short", "en", "new", 0), (3001, prose(60, 5), "en", "new", 0)]
    return spark.createDataFrame(good + mixed + bad + new, SCHEMA)


def test_a_bad_host_takes_its_documents_along_and_others_do_not(spark):
    kept = {r.doc_id: r.kept for r in quality_report(hosts(spark)).collect()}
    assert all(kept[i] for i in range(200)) and kept[3001] and not kept[3000]
    assert all(kept[1000 + i] == bool(i % 3) for i in range(60))
    assert not any(kept[2000 + i] for i in range(100))


def test_a_host_with_few_documents_is_drawn_to_the_others(spark):
    docs = hosts(spark).union(spark.createDataFrame([(4000, "short", "en", "tiny", 0), (4001, "short", "en", "tiny", 0), (4002, prose(60, 9), "en", "tiny", 0)], SCHEMA))
    assert {r.doc_id: r.kept for r in quality_report(docs).collect()}[4002]
    strict = HostRules(prior_limit=0.0, margin=0.0)
    assert not {r.doc_id: r.kept for r in quality_report(docs, strict).collect()}[4002]


def test_kept_documents_are_those_of_the_report(spark, odd_documents):
    for docs in (hosts(spark), odd_documents):
        kept = keep_good(docs)
        assert kept.columns == docs.columns
        wanted = Counter(r.doc_id for r in quality_report(docs).filter("kept").collect())
        assert Counter(r.doc_id for r in kept.collect()) == wanted


def test_no_python_in_the_plan(documents):
    for df in (quality_report(documents), keep_good(documents)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_null_host_is_a_host(spark):
    docs = hosts(spark).withColumn("source", F.when(F.col("source") != "bad", F.col("source")))
    assert not any(r.kept for r in quality_report(docs).filter("doc_id between 2000 and 2099").collect())
