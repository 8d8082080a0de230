"""Quality rules and line dedup against plain versions."""

import re

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import SF, awkward_rows, prose
from tests.oracle import assert_same, sql_rows

from tarn.llm import entry, lines, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    """The base numbers of a text, by hand."""
    text = text or ""
    words, seen, covered = WORD.findall(text), {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                covered.update(range(i, i + 5))
    held = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(held) - len(set(held)), len(covered)


def numbers(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_base_numbers(spark, documents, labels):
    got = {r.doc_id: r for r in quality.judged(documents, labels).collect()}
    for r in documents.collect():
        n = base(r.text)
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        assert numbers(got[r.doc_id]) == n and got[r.doc_id].base_failed == failed
        assert not (failed and got[r.doc_id].kept)


def test_repeated_windows(spark):
    texts = ["a b c d e a b c d e", "a a a a a a a", "a b c d e f a b c d e g", "x\ny\nx\n\n \nx y", "a b c d", " a b c d e  a b c d e", "x " * 5000, "a b c d e " * 2000 + "z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.with_statistics(df).select(F.col("_row.doc_id").alias("doc_id"), *quality._columns()).collect()}
    assert [numbers(got[i]) for i in range(len(texts))] == [base(t) for t in texts]


def greedy_list(rows, features, thresholds, most_rules=8, most_conditions=3, min_precision=0.95, min_bad=3):
    """Sequential covering by plain loops over rows."""
    from math import log2

    def holds(row, rule):
        return all((row[f] > t) == above for f, above, t in rule)

    left, rules = rows, []
    while len(rules) < most_rules:
        grow, prune = [r for r in left if r["fold"] % 3], [r for r in left if r["fold"] % 3 == 0]
        rule = ()
        while len(rule) < most_conditions:
            inside = [r for r in grow if holds(r, rule)]
            p0 = sum(r["bad"] for r in inside)
            if not p0 or p0 == len(inside):
                break
            best = None
            for fi, f in enumerate(features):
                for k, t in enumerate(thresholds[f]):
                    for above in (False, True):
                        some = [r["bad"] for r in inside if (r[f] > t) == above]
                        if sum(some):
                            gain = sum(some) * (log2(sum(some) / len(some)) - log2(p0 / len(inside)))
                            if gain > 1e-9 and (best is None or (gain, -fi, -k) > best[0]):
                                best = ((gain, -fi, -k), (f, above, t))
            if best is None:
                break
            rule = (*rule, best[1])
        if not rule:
            break
        scored = []
        for n in range(1, len(rule) + 1):
            some = [r["bad"] for r in prune if holds(r, rule[:n])]
            scored.append(((2 * sum(some) - len(some)) / max(1, len(some)), -n, sum(some), len(some)))
        _, n, p, total = max(scored)
        if p < min_bad or p < min_precision * total:
            break
        rules.append(rule[:-n])
        left = [r for r in left if not holds(r, rules[-1])]
    return rules


def test_rules_equal_those_of_plain_loops(spark):
    import random

    pick, features = random.Random(8), ("n_words", "symbol_share", "upper_share")
    rows = []
    for i in range(900):
        bad = pick.random() < 0.3
        rows.append({"bad": int(bad), "fold": i, "n_words": pick.randint(0, 60) if bad and i % 2 else pick.randint(40, 99), "symbol_share": round(pick.random() * (0.6 if bad and not i % 2 else 0.2), 2), "upper_share": round(pick.random(), 2)})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "bad int, fold long, n_words long, symbol_share double, upper_share double")
    thresholds = quality._thresholds(df, features)
    got = [tuple((c.feature, c.above, c.threshold) for c in rule) for rule in quality.learn(df, features)]
    assert got == greedy_list(rows, features, thresholds) and len(got) >= 2


def test_learned_rules_reject_what_labels_call_bad(spark, documents, labels):
    """Four fifths of the labels teach, the others judge."""
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.judged(big, told.where("doc_id % 5 <> 0")).join(told.where("doc_id % 5 = 0"), "doc_id").where("not base_failed").collect()
    assert rows and all(r.kept for r in rows if r.quality == 1)
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(bad) <= 0.2 * len(bad)


def test_decision_is_an_ordered_expression(spark):
    rules = [(quality.Condition("n_words", False, 3.5),), (quality.Condition("symbol_share", True, 0.1), quality.Condition("n_words", True, 10.0))]
    df = spark.createDataFrame([(3, 0.5), (20, 0.5), (20, 0.0), (5, 0.5)], "n_words long, symbol_share double")
    assert [r[0] for r in df.select(quality.decision(rules)).collect()] == [0, 1, None, None]


def test_awkward_quality(spark, awkward, clashing, empty, labels):
    for df in (awkward, clashing):
        got = quality.judged(df, labels)
        assert sorted(map(repr, ((r.doc_id, *numbers(r)) for r in got.collect()))) == sorted(repr((r[0], *base(r[1]))) for r in awkward_rows())
        assert quality.accepted(df, labels).columns == df.columns
    assert quality.judged(empty, labels).count() == 0
    odd = spark.createDataFrame([(None, 1, 0), (4, None, 0), (4, 1, None), (4, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    for told in (odd, labels.limit(0)):
        assert quality.judged(awkward, told).where("kept").count() > 0


def test_quality_runs_no_python(spark, documents, labels):
    for df in (quality.judged(documents, labels), quality.accepted(documents, labels), lines.clean_documents(documents)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_line_dedup_equals_its_sql(spark):
    sql = entry.oracle_sql()["op6_line_dedup"]
    assert_same(entry.op6_line_dedup, sql, spark, SF)
    assert_same(entry.op6_line_dedup, sql, spark, "/root/testdata/sf0.01")
    assert sql_rows(sql, "/root/testdata/sf0.01").n_dropped.sum() > 0


def by_hand(rows, ratio=0.1, min_pages=5, copies=False):
    """(id, text, dropped) of (id, host, text)."""
    pages, seen = {}, {}
    blank = " \t\x0b\x0c\r"
    for i, (_, host, text) in enumerate(rows):
        if host is not None and text is not None:
            page = i if copies else text
            pages.setdefault(host, set()).add(page)
            for x in text.split("\n"):
                if x.strip(blank):
                    seen.setdefault((host, x.strip(blank)), set()).add(page)
    out = []
    for key, host, text in rows:
        if text is None:
            out.append((key, None, 0))
            continue
        gone = [bool(x.strip(blank)) and len(seen.get((host, x.strip(blank)), ())) >= min_pages and len(seen[host, x.strip(blank)]) > ratio * len(pages[host]) for x in text.split("\n")]
        out.append((key, "\n".join(x for x, g in zip(text.split("\n"), gone, strict=True) if not g), sum(gone)))
    return out


@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("most", [0, 1_000_000])
def test_lines_of_a_hot_host(spark, monkeypatch, most, copies):
    monkeypatch.setattr(lines, "MOST_BROADCAST", most)
    rows = []
    for i in range(300):
        host = "hot" if i % 3 else (f"h{i % 7}" if i % 5 else None)
        body = [f"own {i}", "  cookie notice\t" if i % 2 else "cookie notice", "", prose(i, 5), "rare" if i % 40 == 0 else "x" + str(i), "cookie notice"]
        rows.append((i, host, "\n".join(body) if i % 50 else None))
    rows += [(1000 + i, "hot", "copied\npage") for i in range(90)]
    df = spark.createDataFrame([(i, t, s) for i, s, t in rows], "doc_id long, text string, source string")
    parts = df.select(F.struct("doc_id").alias("_row"), F.col("source").alias("_host"), F.split("text", "\n").alias("_lines"), F.xxhash64("text").alias("_page"))
    got = lines.without_boilerplate(parts.withColumn("_hashes", lines.hashes(F.col("_lines"))), 0.1, 5, copies).collect()
    assert sorted((r._row.doc_id, r.text, r.n_dropped) for r in got) == sorted(by_hand(rows, copies=copies))


def test_pages_of_small_hosts(spark):
    """Pages over a host's pages: on a host with two, a line on both goes and a line on one stays; a lone page stays whole."""
    rows = [(1, "http://two.org/a", "<p>menu<p>first"), (2, "http://two.org/b", "<p>menu<p>second"), (3, "http://one.org/", "<p>menu<p>own")]
    rows += [(10 + i, f"http://many.org/{i}", f"<p>body {i}" + "<p>twice" * (i < 2) + "<p>thrice" * (i < 3)) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.n_lines, r.n_dropped, r.text) for r in lines.clean_pages(df).collect()}
    assert got[1] == (2, 1, "first") and got[2] == (2, 1, "second") and got[3] == (2, 0, "menu\nown")
    # Two of twenty are not more than a tenth, three are.
    assert got[10] == (3, 1, "body 0\ntwice") and got[12] == (2, 1, "body 2")


def test_awkward_lines(awkward, clashing, empty):
    expected = sorted(repr((r[0], t)) for r, (_, t, _) in zip(awkward_rows(), by_hand([(r[0], r[3], r[1]) for r in awkward_rows()]), strict=True))
    for df in (awkward, clashing):
        got = lines.clean_documents(df)
        assert sorted(repr((r.doc_id, r.text)) for r in got.collect()) == expected
        assert got.columns == df.columns and got.schema["n_chars"].dataType == df.schema["n_chars"].dataType
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())
    assert lines.clean_documents(empty).count() == 0


def test_awkward_pages(spark):
    rows = [(1, None, None), (2, "http://A.com/x", None), (3, None, "<p>a</p>"), (4, "no url", "<p>a</p>"), (5, "https://a.com?x", "<script>x<p></script><style>y</style>a &amp;lt; b<br>c<!-- d\n -->"), (5, "https://a.com?x", "<li>" * 3)]
    got = {(r.page_id, r.host, r.text) for r in lines.clean_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {(1, None, None), (2, "a.com", None), (3, None, "a"), (4, None, "a"), (5, "a.com", "a &lt; b\nc"), (5, "a.com", "")}
    assert lines.clean_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
