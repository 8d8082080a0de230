"""Personal data against plain patterns, the pipeline stage by stage, and the contract without this subpackage."""

import hashlib
import re
import subprocess
import sys
from collections import Counter
from math import log2
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.conftest import SF, awkward_rows, prose

from tarn.llm import entry, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


@pytest.mark.parametrize("letters", ["ab.@-1 %é", "0123456789 -.", "+12 ()-.", "@.a-_", "4 -2", "05. "])
@settings(max_examples=400, deadline=None)
@given(data=st.data())
def test_spans_equal_the_plain_patterns(letters, data):
    text = data.draw(st.text(letters, max_size=50))
    assert pii.base_spans(text) == spans(text)


def test_known_spans():
    text = "mail a.b@c-d.org, 10.0.0.256; 10.0.0.255; 4111 1111 1111 1111, 4111111111111112; +1 (212) 555-0100 é x@y"
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text)] == [("email", "a.b@c-d.org"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (212) 555-0100")]


def test_patterns_take_linear_time():
    import time

    start = time.time()
    for text in ("a" * 300_000, "a@" * 150_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a.a@a." * 50_000, "- " * 100_000 + "1", "1 " * 150_000):
        pii.base_spans(text)
    assert time.time() - start < 5


def secrets(text):
    """Runs that no base span touches, by loops over characters."""
    out, taken = [], {i for _, a, b in spans(text) for i in range(a, b)}
    for m in re.finditer(r"[A-Za-z0-9+/_-]+", text):
        sort = ["d" if x in "0123456789" else "l" if x.isalpha() else " " for x in m[0]]
        changes = sum({x, y} == {"d", "l"} for x, y in zip(sort, sort[1:], strict=False))
        if 20 <= len(sort) <= 512 and changes >= 5 and not taken & set(range(*m.span())):
            out.append(("secret", *m.span()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("aB1 2.@-/", max_size=80))
def test_secrets_equal_plain_loops(text):
    assert pii.all_spans(text) == spans(text) + secrets(text)


def test_what_a_secret_is():
    text = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"### 2024-01-02-a-long-title-of-some-article abcdefghijklmnopqrstuvwxyz 12345678901234567890123 ' + "a1" * 300
    assert [text[a:b] for _, a, b in pii.secret_spans(text)] == ["04dbebab91ab85687d33eeaaf9ac699e1188f962"]


@pytest.fixture(scope="module")
def real_terms(spark):
    """The query's rows and the plain version's spans of sf0.01."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    return dict(rows), {r.doc_id: r for r in entry.op8_pii(spark, "/root/testdata/sf0.01").collect()}, dict(expected_terms(rows))


def test_real_documents(real_terms):
    """All columns against plain patterns and plain counting over all rows."""
    texts, got, terms = real_terms
    for key, text in texts.items():
        listed, mine = spans(text), got[key]
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in listed)
        assert mine.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [mine[f"n_{k}"] for k in pii.KINDS] == [sum(x == k for x, _, _ in listed) for k in pii.KINDS]
        every = listed + secrets(text) + [("term", a, b) for a, b in terms[key]]
        assert mine.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in every) and mine.n_spans == len(every)
        assert mine.n_secret == len(secrets(text))


def test_the_method_acts_and_leaves_clean_documents_alone(real_terms):
    """Terms are found on real rows, in most documents with entities and in no others."""
    texts, got, _ = real_terms
    held = {k for k, t in texts.items() if spans(t) or secrets(t)}
    added = {k for k, r in got.items() if "term:" in r.spans}
    assert added <= held and len(added) > 0.5 * len(held) > 10


def plain_entities(kind, value):
    digits = "".join(x for x in value if x in "0123456789")
    return {
        "email": {f"email:{value.lower()}", f"domain:{value.lower().split('@')[-1]}"},
        "ip": {f"ip:{value}", f"network:{'.'.join(value.split('.')[:3])}"},
        "card": {f"card:{digits}", f"issuer:{digits[:6]}"},
        "phone": {f"phone:{digits}", f"area:{digits[:6]}"},
        "secret": {f"secret:{value.lower()}"},
    }[kind]


def expected_terms(rows, share=0.8, support=3):
    """The added spans of each row, from counts over all pairs."""
    word, n = re.compile(r"[^\W_]\w*"), len(rows)
    df, of, pairs = Counter(), Counter(), Counter()
    texts_with, near_of = {}, []
    for _, text in rows:
        text = text or ""
        found = spans(text) + secrets(text)
        taken = {i for _, a, b in found for i in range(a, b)}
        words = [(m.start(), m[0].lower()) for m in word.finditer(text) if not taken & set(range(*m.span()))]
        df.update({m[0].lower() for m in word.finditer(text)})
        near = {}
        for k, a, b in found:
            before, after = [x for i, x in words if i < a], [x for i, x in words if i >= a]
            for e in plain_entities(k, text[a:b]):
                near.setdefault(e, set()).update(before[-pii.NEAR :] + after[: pii.NEAR])
        of.update(near.keys())
        for e, terms in near.items():
            for t in terms:
                pairs[e, t] += 1
                texts_with.setdefault((e, t), set()).add(text)
        near_of.append((near, taken))
    out = []
    for (key, text), (near, taken) in zip(rows, near_of, strict=True):
        bad = set()
        for e, terms in near.items():
            content = log2(n / of[e])
            for t in terms:
                p, many = min(1.0, pairs[e, t] / df[t]), len(texts_with[e, t])
                if many < support:
                    z, trials = 1.645, many / p
                    p = (p + z * z / 2 / trials - z * (p * (1 - p) / trials + z * z / 4 / trials**2) ** 0.5) / (1 + z * z / trials)
                if content > 0 and log2(p * n / of[e]) >= share * content:
                    bad.add(t)
        out.append((key, [m.span() for m in word.finditer(text or "") if m[0].lower() in bad and not taken & set(range(*m.span()))]))
    return out


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_terms_that_disclose(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "MOST_BROADCAST", most)
    rows = [(i, prose(i, 30)) for i in range(200)]
    for i in range(6):
        rows.append((300 + i, f"Zorblax of quuxville wrote to z.orb@x.org on {prose(500 + i, 10)} and Zorblax left"))
        rows.append((400 + i, f"common call +1 212 555 0100 now {prose(600 + i, 10)}"))
        rows.append((700 + i, f"{prose(700 + i, 30)} Li paid with user{i}@li.example and {prose(800 + i, 30)} li again"))
    rows += [(500 + i, "copied secretword c@d.org alone") for i in range(5)] + [(600, "the of and common call")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.sanitise(df).collect()
    assert sorted((r.doc_id, list(zip(r.starts, r.ends, strict=True))) for r in got) == sorted(expected_terms(rows))
    by = {r.doc_id: r for r in got}
    assert "term:0:7" in by[300].spans and by[300].base in by[300].spans
    # Copies of one text are no evidence.
    assert by[500].starts == [] and by[600].starts == []
    texts = {r.doc_id: r.text for r in pii.sanitised_texts(pii.sanitise(df)).collect()}
    assert "Zorblax" not in texts[300] and "quuxville" not in texts[300] and "[EMAIL]" in texts[300] and texts[500] == "copied secretword [EMAIL] alone"
    # A name of two letters, by the mail domain that all its addresses share, also where it is far from them.
    assert not re.search(r"\b[Ll]i\b", texts[700]) and "paid" not in texts[700]


def test_terms_of_entities_in_one_or_two_texts(spark):
    """An entity needs no number of texts: words near it that are in its texts alone disclose it, words that others have too do not."""
    rows = [(i, f"every text has this {prose(i, 10)}") for i in range(1000)]
    rows += [(2000, "every text has this zorblax and one@x.org"), (2001, "this quuxville has 10.1.2.3"), (2002, "has 10.1.2.3 quuxville")]
    rows += [(2003, "farword " + "this " * 12 + "two@y.org")]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    flagged = {k: {got[k].text[a:b] for a, b in zip(got[k].starts, got[k].ends, strict=True)} for k in (2000, 2001, 2002, 2003)}
    assert flagged == {2000: {"zorblax", "and"}, 2001: {"quuxville"}, 2002: {"quuxville"}, 2003: set()}
    # One or two texts do not make it certain: such terms are generalised, not removed.
    assert not any(any(r.gone) for r in got.values())
    assert all(r.starts == [] for k, r in got.items() if k < 2000)


def test_many_entities_in_one_text_cost_no_more_than_their_places(spark):
    """A list of addresses: pairs with terms grow with the list, not with its square."""
    text = " ".join(f"name{i} u{i}@d{i}.org" for i in range(3000))
    assert sum(map(len, pii._near(text).values())) <= 2 * 3000 * 2 * pii.NEAR
    assert pii.sanitise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().n_email == 3000


def test_redaction():
    assert pii.redact("abc def ghi", "email:0:3", [(4, 7, False), (8, 11, True)]) == "[EMAIL] [TERM] "
    assert pii.redact("0123456789", "card:2:6,phone:4:8", []) == "01[CARD]89"


def test_awkward_data(awkward, clashing, empty):
    for df in (awkward, clashing):
        got = pii.sanitise(df).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in awkward_rows())
        assert all(r.spans == "" and r.text is None and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert pii.sanitise(empty).count() == 0 and pii.sanitised_texts(pii.sanitise(empty)).count() == 0


def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


def test_pipeline_stage_by_stage(spark):
    """Each stage on what the one before kept: its contract, against plain versions."""
    import corpus_pipeline
    from tests.llm.test_jaccard import expected
    from tests.llm.test_quality_lines import base, by_hand
    from tests.llm.test_tokens_packing import checked_pieces

    from tarn.llm.scratch import Scratch

    scratch, folder = Scratch(spark), "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "mixing_sources", "best_fit_packing"]
    step = stages()
    rows = {r.doc_id: r for r in docs.collect()}
    one = scratch.save(step["quality_rules"](spark, docs, folder))
    kept = {r.doc_id: r for r in one.collect()}
    failed = {k for k, r in rows.items() if (n := base(r.text))[0] < 10 or 100 * n[4] > 20 * n[0]}
    good = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").collect()}
    assert not failed & set(kept) and good - failed <= set(kept) and all(kept[k] == rows[k] for k in kept)
    two = scratch.save(step["line_dedup"](spark, one, folder))
    assert sorted((r.doc_id, r.text) for r in two.collect()) == sorted((k, t) for k, t, _ in by_hand([(r.doc_id, r.source, r.text) for r in kept.values()]))
    three = scratch.save(step["ngram_jaccard_join"](spark, two, folder))
    heads = {c for _, c, _ in expected([(r.doc_id, r.text) for r in two.collect()])}
    assert sorted(r.doc_id for r in three.collect()) == sorted(heads)
    four = scratch.save(step["mixing_sources"](spark, three, folder))
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    times = Counter(r.doc_id for r in four.collect())
    assert max(times.values()) <= 2 and set(times) <= heads
    words = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in df.collect())
    assert abs(words(four) / words(three) - 1.5) < 0.1
    five = step["best_fit_packing"](spark, four, folder)
    checked_pieces(five, [(r.doc_id, r.text) for r in four.collect()])


def test_pipeline_cuts_lines_that_few_of_a_sources_texts_have(spark):
    """A licence line on a fiftieth of a large source goes, a line on four texts stays."""
    rows = [(i, f"own {i}" + "\nLicence line" * (i % 50 == 0) + "\nfour times" * (i < 4), "en", "a", 0) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in stages()["line_dedup"](spark, docs, SF).collect()}
    assert got == {i: f"own {i}" + "\nfour times" * (i < 4) for i in range(1000)}


def test_pipeline_runs_its_stages(spark):
    """``run`` gives what the stages give one after another, and leaves none of their tables behind."""
    import __spark_entry__ as contract

    from tarn.llm import scratch

    held = set(scratch._LIVE)
    got = contract.queries()["pipeline"](spark, SF)
    assert len(set(scratch._LIVE) - held) == len(got.inputFiles() and {got._tarn_path})
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in stages().values():
        docs = stage(spark, docs, SF)
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    rows = lambda df: sorted(tuple(r[x] for x in key) for r in df.collect())
    assert rows(got) == rows(docs) and got.select("sequence_id").distinct().count() == docs.select("sequence_id").distinct().count()


def test_pipeline_stages_take_awkward_tables(spark, awkward, clashing, empty, tmp_path):
    """In a row, over nulls, empty and very long texts, repeated rows, clashing names and nothing at all."""
    folder = tmp_path / "tables"
    spark.createDataFrame([(4, 1, 0), (8, 1, 0), (None, 0, 0), (9, None, 1)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"file://{folder}/labels.parquet")
    kept = {}
    for name, docs in (("awkward", awkward), ("clashing", clashing), ("empty", empty)):
        columns = docs.columns
        for stage, f in stages().items():
            docs = f(spark, docs, f"file://{folder}")
            kept[name, stage] = docs.collect()
            if stage != "best_fit_packing":
                assert docs.columns == columns
    for name in ("awkward", "clashing"):
        # Nulls and short texts go first, then the copy (8, 9); a long word is a text of one word.
        assert sorted(r.doc_id for r in kept[name, "quality_rules"]) == [4, 8, 9]
        assert sorted(r.doc_id for r in kept[name, "ngram_jaccard_join"]) == [4, 8]
        assert {r.doc_id for r in kept[name, "best_fit_packing"]} <= {4, 8}
    assert not any(rows for (name, _), rows in kept.items() if name == "empty")


def test_every_operator_has_a_query():
    import __spark_entry__ as contract

    numbers = sorted(int(m[1]) for k in contract.queries() if (m := re.match(r"op(\d+)_", k)))
    assert numbers == list(range(1, 11)) and "pipeline" in contract.queries()


def test_the_rest_works_without_this_subpackage(tmp_path):
    """A copy of the repository without these folders still imports and has its other queries."""
    import shutil

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "tarn", tmp_path / "tarn", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert "fine" in done.stdout, done.stderr


def test_checkpoint_folder_is_the_one_of_the_session(spark):
    from tarn.llm.scratch import Scratch, shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    scratch = Scratch(spark)
    saved = scratch.save(spark.range(3))
    assert saved.inputFiles()[0].replace("file:///", "file:/").startswith(shared_dir(spark).replace("file:///", "file:/"))
    scratch.drop(saved)
    assert scratch.paths and not Path(scratch.paths[0].removeprefix("file://")).exists()
