"""The llm operators on small cases: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import datetime as dt
import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import canonical, history, leakage, names, neardup, pii, shingles, spam, tokenizer, vec

WORDS = [f"w{i}" for i in range(400)]


def text_of(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text, seed, n):
    r, w = random.Random(seed), text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = "edit" + str(r.randint(0, 10**6))
    return " ".join(w)


def triples(text):
    w = text.lower().split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def similar(a, b):
    x, y = triples(a), triples(b)
    return len(x & y) / len(x | y)


# ---- vec --------------------------------------------------------------------------------------------------------


def test_words_and_runs():
    a = pa.array(["Hello, WORLD 42", None, "", "hello world 42", "x" * 3_000_000, "é_É"])
    seen = {}
    for row, cps, off, _ in vec.chunks(a):
        h, rows, _, _ = vec.words(cps, off)
        for i, x in zip(rows, h):
            seen.setdefault(row + int(i), []).append(int(x))
    assert seen[0] == seen[3] and len(seen[0]) == 3 and 1 not in seen and len(seen[4]) == 1 and seen[5][0] == seen[5][1]


# ---- near duplicates (p6) and history (p1) ----------------------------------------------------------------------


def corpus():
    rows = [(i, text_of(i)) for i in range(40)]
    for k in range(40, 80):
        rows.append((k, edited(text_of(k % 20), k, 2 + k % 9)))
    rows += [(k, text_of(3)) for k in range(80, 90)] + [(90, None), (91, ""), (92, "short text"), (93, " ".join(WORDS * 30))]
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id long, body string").withColumn("rep", F.lit(1)).withColumn("g", F.lit("x"))
    links, members = neardup.near_duplicates(df, "id", None, "body", bands=24)
    got = {(r.id_a, r.id_b) for r in neardup.expanded(links, members).collect()}
    long = [(i, t) for i, t in rows if t and len(t.split()) >= 30]
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(long, 2) if similar(x, y) >= 0.6}
    assert got == want and len(want) > 50
    crowded, same = neardup.near_duplicates(df, "id", None, "body", bands=24, hot=1)
    assert {(r.id_a, r.id_b) for r in neardup.expanded(crowded, same).collect()} == want
    nothing, nobody = neardup.near_duplicates(df.limit(0), "id", None, "body")
    assert neardup.expanded(nothing, nobody).count() == 0


def test_collision_curve():
    assert 0.98 < neardup.recall(0.6) < 1 and neardup.recall(0.1) < 0.02


def postings(spark):
    d = [text_of(i) for i in range(6)]
    rows = [
        (1, 0, "s", "https://www.a.example/job?jid=1&utm_source=x#top", "A-0007", d[0]), (2, 0, "s", "http://b.example/2/", None, d[1]), (3, 0, "t", "http://c.example/3", "7", None),
        (4, 1, "s", "HTTP://A.example/job?jid=1", "", ""), (5, 1, "s", "http://d.example/5", "a 7", "x"), (6, 1, "t", "http://e.example/6", "  ", edited(d[1], 5, 4)), (7, 1, "t", "http://f.example/7", None, d[2]),
        (8, 1, "t", "http://f.example/8", None, d[2]), (9, 2, "u", "", None, d[2].upper()), (10, 2, "u", None, "0", "short"), (11, 2, "u", "http://b.example/2?ref=home", "9", edited(d[0], 9, 5)), (12, 2, "t", "x", "007", None),
    ]
    return spark.createDataFrame(rows, "id long, batch_no int, source string, url string, external_id string, description string").withColumn("digest", F.lit(1))


def test_repeats_and_history_agree(spark, tmp_path):
    df = postings(spark)
    want = {(1, 4), (1, 5), (2, 6), (7, 9), (2, 11), (3, 12)}
    assert {tuple(r) for r in history.repeats(df).collect()} == want
    assert {tuple(r) for r in history.repeats(df, hot=1).collect()} == want
    assert history.repeats(df.limit(0)).count() == 0
    for hot in (1, 50_000):
        assert {tuple(r) for r in history.repeats_by_batch(df, str(tmp_path / f"all{hot}"), buckets=4, hot=hot).collect()} == want
    assert history.repeats_by_batch(df.limit(0), str(tmp_path / "none"), buckets=4).count() == 0
    got = set()
    for b in (0, 1, 2):  # opened anew for every batch, as separate runs would
        book = history.History(spark, str(tmp_path / "book"), buckets=4)
        got |= {tuple(r) for r in book.check_and_append(df.where(F.col("batch_no") == b), b, df.where(F.col("batch_no") < b)).collect()}
    assert got == want
    # A load that breaks off before its commit leaves rows that are never read; the batch can be sent again.
    book.spark.createDataFrame([(1, 99, False, 0, 0, 0, 0, 7)], history.History.SCHEMA).repartition(4, "key").write.insertInto(book.table)
    assert book.accepted().where("load = 7").count() == 0
    before = book.accepted().count()
    book.append(spark.createDataFrame([(1, 99, False, 0, 0, 0, 0, 7)], history.History.SCHEMA), 2, 1)
    assert book.accepted().count() == before and history.History(spark, str(tmp_path / "book"), buckets=4).loads == [0, 1, 2]


def test_history_is_read_where_it_lies(spark, tmp_path):
    """The plan of a batch's look-up has no exchange and no sort above the history's scan."""
    df = postings(spark)
    book = history.History(spark, str(tmp_path / "book"), buckets=4)
    book.check_and_append(df.where("batch_no = 0"), 0, df.limit(0))
    prep = history.prepared(df.where("batch_no = 1").select("id", F.col("batch_no").cast("int").alias("batch"), "source", "url", "external_id", F.col("description").alias("text")), 3, 30)
    execution = book.hits(history.probes(prep).drop("batch"))._jdf.queryExecution()
    formatted = execution.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    executed = execution.executedPlan().toString()
    lines = executed.split("== Initial Plan ==")[-1].splitlines()
    at = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and book.table in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    above = []
    for x in reversed(lines[:at]):
        if depth(x) < depth(lines[at]) and (not above or depth(x) < depth(above[-1])):
            above.append(x)
    below_join = list(itertools.takewhile(lambda x: "HashJoin" not in x, above))
    assert "Bucketed: true" in formatted and any("HashJoin" in x for x in above) and not any("Exchange" in x or "Sort" in x for x in below_join), formatted


def test_agreement_of_sketches_in_generated_code(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 256, (50, history.SKETCH)).astype(np.uint8), rng.integers(0, 256, (50, history.SKETCH)).astype(np.uint8)
    same = rng.random((50, history.SKETCH)) < 0.6
    b[same] = a[same]
    df = spark.createDataFrame([(i, bytes(x), bytes(y)) for i, (x, y) in enumerate(zip(a, b))], "i int, x binary, y binary")
    one, two = df.select("i", *history.sketch_words(F.col("x"))).alias("o"), df.select("i", *history.sketch_words(F.col("y"))).alias("n")
    got = {r.i: r.e for r in one.join(two, F.col("o.i") == F.col("n.i")).select(F.col("o.i").alias("i"), history.agreeing("o", "n").alias("e")).collect()}
    assert got == {i: int((x == y).sum()) for i, (x, y) in enumerate(zip(a, b))}


def test_crowded_paragraphs_end_early(spark):
    base = text_of(1, 80) + ".\nThe same closing paragraph stands here every time. " + text_of(2, 40)
    rows = [(i, 0 if i < 60 else 1, f"{base} {text_of(1000 + i, 2)}") for i in range(160)]
    df = spark.createDataFrame(rows, "id long, batch_no int, description string").withColumns({"source": F.lit("s"), "url": F.lit(""), "external_id": F.lit(None).cast("string")})
    assert {tuple(r) for r in history.repeats(df).collect()} == {(0, i) for i in range(60, 160)}


def test_hot_paragraphs_lose_no_pair(spark):
    from sievework.llm.skew import hot_keys

    rng = np.random.default_rng(8)
    byte = lambda n: rng.integers(0, 256, n).astype(np.uint8)
    rows, want = [], set()
    for i in range(300):
        one = byte(history.SKETCH)
        two = one.copy()
        at = rng.permutation(history.SKETCH)[:12]
        two[at] += 1  # 20 of 32 values equal; eight pairs of values often have none whole
        rows += [(2 * i, 0, 0, [7], bytes(one)), (2 * i + 1, 1, 1, [7], bytes(two))]
        want.add((2 * i, 2 * i + 1))
    df = spark.createDataFrame(rows, "id long, first int, last int, paragraphs array<long>, sketch binary")
    assert hot_keys(df.select(F.explode("paragraphs").alias("g"), "id"), "g", "id", 1).head().blocks > 1
    assert {(r.a, r.b) for r in history.paragraph_pairs(df, 0.6, hot=1).collect()} == want == {(r.a, r.b) for r in history.paragraph_pairs(df, 0.6).collect()}


def test_verified_is_exact(spark):
    a, b = text_of(1), edited(text_of(1), 2, 6)
    texts = spark.createDataFrame([(1, a), (2, b), (3, None)], "id long, t string")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert abs(shingles.verified(pairs, texts, "id", "t", 0.0, 3).head().similarity - similar(a, b)) < 1e-9


# ---- personal data (p3) -----------------------------------------------------------------------------------------


def test_held_out_accuracy_of_the_tagger():
    """Through the whole operator, on cues, names, streets and domains that the training grammar doesn't have."""
    if not os.path.exists(pii.WEIGHTS):
        pytest.skip("not trained yet")
    from sievework.llm.pii_train import figures

    for kind, (precision, recall, n) in figures(1500).items():
        least = 0.85 if kind == "NAME" else 0.9
        assert n > 100 and precision > least and recall > least, (kind, precision, recall)


def test_training_grammar_shares_nothing_with_the_tables():
    """No name, street, domain, town or cue of three words or more stands in a text of the test tables."""
    import re

    from sievework.llm import pii_train as P

    root = "/root/testdata/sf0.01"
    if not os.path.exists(root):
        pytest.skip("no tables")
    import pyarrow.parquet as pq

    low = "\n".join(x or "" for t, c in (("jobs", "description"), ("user_reports", "reason")) for x in pq.read_table(f"{root}/{t}.parquet", columns=[c]).column(0).to_pylist()).lower()
    words = set(re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", low))
    for maker in (P.Maker, P.HeldOut):
        for field in ("given_names", "surnames", "streets", "towns"):
            assert not [w for w in getattr(maker, field) if (w.replace("_", " ").lower() in low if "_" in w else w.lower() in words)]
        assert not [d for d in maker.domains if d in low]
        assert not [c for cues in maker.before.values() for c in cues if len(c.split()) >= 3 and c in low]
    assert not [a for a in P.AFTER if len(a.split()) >= 3 and a.lower() in low]
    assert not [s for s in P.ordinary()[1] if len(s.split()) >= 4 and s.lower() in low]


def test_sentences_are_read_by_their_form():
    text = "Please ask for Zofia Trelawick when you arrive. Your manager will be Robert Garcia, who joined. He lives at 221B Baker Gardens, London. Write to 12 Fennel Passage, Corville. The team meets every day. We like calm people."
    row, cps, off, joined = next(vec.chunks(pa.array([text])))
    _, start, end = pii.worth_reading(cps, off, joined)
    assert [joined[a:b].strip() for a, b in zip(start, end)] == [t + "." for t in text[:-1].split(". ")[:4]]


def test_every_sentence_is_given_to_the_network(monkeypatch):
    """Also those without capitals, digits or words of any list, in every row and piece of the table."""
    read = []

    class Reader:
        def tags(self, symbols, start, end):
            read.append((symbols, start, end))
            return iter(())

    monkeypatch.setattr(pii, "tagger", Reader)
    monkeypatch.setattr(pii, "POOL", 60)
    texts = ["the team meets every day. we like calm people.\nA b", None, "", "ask for zofia trelawick when you arrive", "x"]
    assert pii.found_in(pa.array(texts)) == []
    assert len(read) > 1 and sum(len(s) for s, _, _ in read) == sum(len(t or "") for t in texts)
    for symbols, start, end in read:
        assert start[0] == 0 and end[-1] == len(symbols) and (start[1:] == end[:-1]).all()


def test_findings_in_sentences_of_any_form():
    if not os.path.exists(pii.WEIGHTS):
        pytest.skip("not trained yet")
    text = "the letter came from gerald okafor-lindqvist last week"
    _, cps, off, joined = next(vec.chunks(pa.array([text])))
    assert not len(pii.worth_reading(cps, off, joined)[0])
    assert [(f[3], f[4]) for f in pii.found_in(pa.array([text]))] == [("NAME", "gerald okafor-lindqvist")]


def test_shared_states_change_no_tag(monkeypatch):
    """Sentences that begin and end alike, and a long one in windows, against each sentence read alone."""
    if not os.path.exists(pii.WEIGHTS):
        pytest.skip("not trained yet")
    from sievework.llm.pii_train import HeldOut

    maker = HeldOut(5)
    texts = [maker.example()[0] for _ in range(60)]
    texts += [t[: len(t) // 2] + u[len(u) // 2 :] for t, u in zip(texts, texts[1:])] + texts[:9] + [" and ".join(texts[:12])]
    alone = [(i, *f[1:]) for i, t in enumerate(texts) for f in pii.found_in(pa.array([t]))]
    assert len(alone) > 40 and pii.found_in(pa.array(texts)) == alone
    monkeypatch.setattr(pii, "ROWS", 7)
    monkeypatch.setattr(pii, "BATCH", 5)
    monkeypatch.setattr(pii, "CELLS", 400)
    assert pii.found_in(pa.array(texts)) == alone


def test_network_takes_a_step_for_a_token(monkeypatch):
    """Each way no more steps than there are tokens, in sentences that share nothing; no token is left out."""
    if not os.path.exists(pii.WEIGHTS):
        pytest.skip("not trained yet")
    text = "Bring warm clothing on Monday;\nSeveral engineers inspect the turbines. Reach Odalys Fenwright at odalys@fenwright.example, or 0113 496 0801!"
    read = []
    states = pii.Tagger.states

    def counted(self, *args):
        place, values = states(self, *args)
        read.append((len(set(place.tolist())), len(values)))
        return place, values

    monkeypatch.setattr(pii.Tagger, "states", counted)
    found = [(f[3], f[4]) for f in pii.found_in(pa.array([text]))]
    assert found == [("NAME", "Odalys Fenwright"), ("EMAIL", "odalys@fenwright.example"), ("PHONE", "0113 496 0801")]
    import re

    assert read == [(len(re.findall(r"\w+|[^\w\s]", text)),) * 2] * 2


def test_currencies_and_firms_are_no_names_and_whole_cases_are_found():
    if not os.path.exists(pii.WEIGHTS):
        pytest.skip("not trained yet")
    texts = [
        "The amounts mean Canadian dollars (hourly), before tax.", "To join Vantarro you first clean a kitchen.", "Ottoline Marbrook handles the enquiry (ottoline@post.test).",
        "Please post it to 14 quarry lane in ashbeck before Friday.",
    ]
    assert [(f[0], f[3], f[4]) for f in pii.found_in(pa.array(texts))] == [
        (2, "NAME", "Ottoline Marbrook"), (2, "EMAIL", "ottoline@post.test"), (3, "ADDRESS", "14 quarry lane in ashbeck"),
    ]


def test_findings_and_placeholders(spark):
    if not os.path.exists(pii.WEIGHTS):
        pytest.skip("not trained yet")
    text = "Calm people wanted.\nQuestions go to Elodie Quistrom at elodie_quistrom68@kestrelmail.test or by phone on 212-555-0122. Order no. 922 924 100 shipped with 15 boxes."
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "word " * 200_000 + "Call or text 617.555.0160 to arrange a first talk."), (5, "Drop documents off at 768B Fennel Court, Corville.")], "id long, t string").withColumn("kind", F.lit(0))
    got = {(r.id, r.kind, r.pii_text) for r in pii.findings(df, "id", "t").collect()}
    assert got == {(1, "NAME", "Elodie Quistrom"), (1, "EMAIL", "elodie_quistrom68@kestrelmail.test"), (1, "PHONE", "212-555-0122"), (4, "PHONE", "617.555.0160"), (5, "ADDRESS", "768B Fennel Court, Corville")}
    clean = {r.id: r.t for r in pii.masked(df, "id", "t").collect()}
    assert clean[1] == "Calm people wanted.\nQuestions go to [NAME] at [EMAIL] or by phone on [PHONE]. Order no. 922 924 100 shipped with 15 boxes." and clean[2] is None and clean[3] == ""


def test_masked_query_reads_both_tables(spark, tmp_path):
    from sievework.llm import queries

    spark.createDataFrame([(1, "Call 020 7946 0958 now."), (2, None)], "id long, description string").write.parquet(f"{tmp_path}/jobs.parquet")
    spark.createDataFrame([(1, "Mail a@b.example today.")], "report_id long, reason string").write.parquet(f"{tmp_path}/user_reports.parquet")
    got = {(r.tbl, r.row_id): r.text for r in queries.p3_masked(spark, str(tmp_path)).collect()}
    assert got == {("jobs", 1): "Call [PHONE] now.", ("jobs", 2): None, ("user_reports", 1): "Mail [EMAIL] today."}


def test_long_sentences_are_reconciled():
    if not os.path.exists(pii.WEIGHTS):
        pytest.skip("not trained yet")
    filler = "the returns team keeps claim files in order and "
    text = filler * 12 + "write to dana.ulmanis@kestrelmail.test with the subject line of your choice " + filler * 12
    assert [f[4] for f in pii.found_in(pa.array([text]))] == ["dana.ulmanis@kestrelmail.test"]


# ---- canonical values (p4) --------------------------------------------------------------------------------------


def brute(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    return d[len(a), len(b)]


def test_tree_search_equals_brute_force():
    r = random.Random(4)
    made = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 7)))
    entries = {made() for _ in range(120)}
    tree = canonical.BKTree({e: [e] for e in sorted(entries)})
    for _ in range(60):
        q = made()
        assert canonical.edits(q, "abcab") == brute(q, "abcab")
        if q not in entries:
            assert {w for _, w in tree.within(q, 1)} == {e for e in entries if canonical.typed(q, e) <= 1}


PLACES = [(1, "Fort Marlis", "Wendale", "WD", "US"), (2, "Brévannoy", "Valsonne", "VS", "FR"), (3, "Quarobury", "Valsonne", "VS", "FR"), (4, "Quarobury", "Bordelune", "BO", "FR"), (5, "West Brackdale", "Eastwold", "EW", "GB")]
TITLES = [(1, "Product Manager"), (2, "Registered Nurse"), (3, "Customer Service Representative"), (4, "Information Security Analyst"), (5, "Office Administrator")]


def test_places_and_titles():
    find = lambda v: canonical.Places(PLACES).find(v)[1]
    assert [find(v) for v in ("Ft. Marlis, WD", "fort  marlsi WD 12345", "Greater Brevannoy Area", "Quarobury, BO", "VS / Quarobury", "Valsonne - Quarobury", "W Brackdale, Eastwold, United Kingdom", "Remote - QUAROBURY (Bordelune)")] == [1, 1, 2, 4, 3, 3, 5, 4]
    assert [find(v) for v in ("Remote", "Valsonne region", "France", "Unknowntown, VS", "West Brackdale, VS", "-")] == [-1] * 6
    title = lambda v: canonical.Titles(TITLES).find(v)[1]
    assert [title(v) for v in ("URGENT: Sr. Product Mngr. II", "Manager, Product (m/f/d)", "RN #1004", "Cust. Svc Representative", "Lead InfoSec Analyst - Contract", "Senior OFFICE ADMINISTRATOR", "Prodcut Manager | Night Shift")] == [1, 1, 2, 3, 4, 5, 1]
    assert [title(v) for v in ("Join us!", "Chaos Wizard", "Position #7", "$$$")] == [-1] * 4


@pytest.mark.parametrize("shard", [50_000, 2])
def test_mapping_with_shards(spark, shard):
    entries = spark.createDataFrame(TITLES, "title_id long, title string")
    df = spark.createDataFrame([(1, "RN"), (2, "Product Manager"), (3, "  "), (4, None), (5, "Product Manager"), (6, "nonsense")], "id long, title string").withColumn("v", F.lit(1))
    got = {(r.id, r.ref_id) for r in canonical.mapped(df, "id", "title", entries, canonical.Titles, shard).collect()}
    assert got == {(1, 2), (2, 1), (5, 1), (6, -1)}


def test_places_do_not_depend_on_shards(spark):
    schema = "place_id long, city string, region string, region_code string, country string"
    more = PLACES + [(10 + i, f"{a}{b}", f"Region{i % 7}", f"R{i % 7}", "GB") for i, (a, b) in enumerate(itertools.product(("Nor", "Ulver", "Quaro", "Brack"), ("lake", "holm", "bury", "dale", "mouth")))]
    typed = [f"{c}, {r}" for _, c, r, _, _ in more] + [f"{c[:-2]}{c[-1]}{c[-2]} {k}" for _, c, _, k, _ in more] + ["Norlake", "Ulverholm, Norlake", "Region3", "Rgeion3, Norlake", None, " ", "nowhere at all"]
    df, entries = spark.createDataFrame(list(enumerate(typed)), "id long, location string"), spark.createDataFrame(more, schema)
    results = [sorted(tuple(r) for r in canonical.mapped(df, "id", "location", entries, canonical.Places, shard, block).collect()) for shard, block in ((50_000, 100), (7, 10), (1, 1000))]
    assert results[0] == results[1] == results[2] and len(results[0]) == len(typed) - 2 and results[0][0] == (0, 1)


# ---- names (p5) -------------------------------------------------------------------------------------------------


def test_likeness():
    like = lambda a, b: names.likeness(names.tokens(a), names.tokens(b)) >= 0.9
    assert all(like(a, b) for a, b in [("Caslono Software GmbH", "CaslonoSoftware"), ("Vell anfax Mobility GmbH", "Vellanfax Mobility"), ("Media, Pelperfax", "PELPERFAX MEDIA LTD"), ("Dick Fothergilton and Sons", "Richard Fothergilton & Sons"), ("E. Penbrookson & Daughters", "Edward Penbrookson & Daughters"), ("Velshivia Mfg PLC", "Velshivia Manufacturing"), ("The Mirdisrian Design Co.", "mirdisrian-design"), ("Lorfifax Anlaytics", "Lorfifax Analytics S.A.")])
    assert not any(like(a, b) for a, b in [("Lornarock Mobility", "Lornarock Capital"), ("Edward Harrowwell & Sons", "Edward Harrowwell & Daughters"), ("Elizabeth Eddowes Legal & Tax", "Elizabeth Eddoweston Legal & Tax"), ("Robotics", "Textiles"), ("", "X Media")])


def test_linked_rows(spark):
    companies = spark.createDataFrame([(10, "Caslono Software GmbH"), (11, "CASLONO SOFTWARE"), (12, "Lornarock Capital"), (13, None)], "company_id long, name string")
    jobs = [(1, "CaslonoSoftware"), (2, "Caslono Software GmbH"), (3, "Lornarock Mobility"), (4, ""), (5, None), (6, "Capital, Lornarock"), (7, "Caslnoo Software")]
    rows = spark.createDataFrame([("jobs", *j) for j in jobs] + [("companies", 11, "CASLONO SOFTWARE"), ("companies", 12, "Lornarock Capital")], "tbl string, row_id long, name string")
    assert {tuple(r) for r in names.linked_rows(rows, companies).collect()} == {("jobs", 1, 10), ("jobs", 7, 10), ("jobs", 6, 12), ("companies", 11, 10)}


def test_short_mistyped_words_beside_common_ones_are_linked(spark):
    from sievework.llm.vec import mix

    letters = "bcdfglmnprtvz"
    word = lambda x: "".join(letters[(int(x) >> (4 * j)) % 13] + "aeiou"[(int(x) >> (4 * j + 2)) % 5] for j in range(3))[:5]
    base = sorted({word(x) for x in mix(np.arange(1, 150, dtype=np.uint64))})
    base = [w for i, w in enumerate(base) if all(names.typed(w, v) > 2 for v in base[:i])]
    made = [[w, "energy"] for w in base] + [[w[0] + w[2] + w[1] + w[3:], "energy"] for w in base] + [["global", "energy"], ["global", "enegry"]] + [[f"global{'abcdefghij'[i % 10] * 4}{'klmnopqrst'[i // 10] * 4}", "global"] for i in range(60)]
    rows = [(i, w) for i, w in enumerate(made)]
    got = {(r.a, r.b) for r in names.links(spark.createDataFrame(rows, "node long, words array<string>")).collect()}
    n = len(base)
    assert n > 40 and {(i, i + n) for i in range(n)} <= got and (2 * n, 2 * n + 1) in got


def test_links_do_not_depend_on_hot_buckets_and_meet_all_pairs(spark):
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice(["ba", "ke", "lor", "min", "tav", "os", "ul", "fen", "dra"]) for _ in range(r.randint(2, 4)))
    base = [[word(), r.choice(["energy", "media", "foods"])] for _ in range(90)]
    typo = lambda w: w[:2] + w[3] + w[2] + w[4:] if len(w) > 4 else w + "s"
    made = base + [[typo(a), b] for a, b in base[::2]] + [[b, a] for a, b in base[::3]] + [[a + b] for a, b in base[::5]]
    keys = spark.createDataFrame([(i, w) for i, w in enumerate(made)], "node long, words array<string>")
    found = [{(x.a, x.b) for x in names.links(keys, hot=hot).where("a < b").collect()} for hot in (1, 10**9)]
    common = names.common_words(keys, names.COMMON_LEAST, names.COMMON_SHARE)
    true = {(i, j) for i, j in itertools.combinations(range(len(made)), 2) if names.likeness(made[i], made[j], common) >= 0.9}
    assert found[0] == found[1] and found[0] <= true and len(found[0]) >= 0.97 * len(true)


def test_short_forms_without_common_words_at_the_end():
    common = frozenset({"international", "trading"})
    assert names.likeness(["yordu", "international"], ["yordu", "international", "trading"], common) >= 0.9
    assert names.likeness(["yordu"], ["yordu", "trading"], common) == 0 and names.likeness(["yordu", "international"], ["yordu", "international", "media"], common) == 0


def test_stars_do_not_chain(spark):
    edges = [(1, 2, 0.95), (2, 3, 0.95), (3, 4, 0.95), (4, 5, 0.95)]
    both = spark.createDataFrame([(a, b, s) for a, b, s in edges] + [(b, a, s) for a, b, s in edges], "a long, b long, score double")
    nodes = spark.createDataFrame([(i, 1) for i in range(1, 7)], "node long, rows long")
    got = {r.node: r.centre for r in names.stars(nodes, both).collect()}
    assert len(got) == 6 and got[6] == 6 and len(set(got.values())) >= 3


# ---- tokenizer (p8) ---------------------------------------------------------------------------------------------

ODD = ["", None, "it's they'll  we've'd ''s !'s 's's'save 're 'r", "a  b\n\n c \n", "   ", "x   y", "<|endoftext|> hi", "ab" * 4000, "é́ ñ 123abc１２", "\U0001f600\U0001f600 's ' s", "'", " 're", "a\x85b\x1cc", "\t\tfoo\r\nbar "]


def test_ids_equal_the_library_and_decode(spark):
    if not os.path.exists(os.path.join(tokenizer.VOCABULARY_DIR, tokenizer.VOCABULARY)):
        pytest.skip("no vocabulary here")
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(os.path.join(tokenizer.VOCABULARY_DIR, "byte_bpe_50k.json"))
    library.encode_special_tokens = True
    r = random.Random(1)
    texts = ODD + ["".join(r.choice("ab's 1\n.!é") for _ in range(r.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("ids", F.lit("clash"))
    got = {x.id: x for x in tokenizer.encode(df, "id", "t", with_offsets=True).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == library.encode(t or "", add_special_tokens=False).ids
        assert len(got[i].piece_offsets) == len(got[i].ids)
    assert tokenizer.decode(got[2].ids) == texts[2] and tokenizer.decode(got[9].ids) == texts[9]
    assert tokenizer.encode(df.limit(0), "id", "t").count() == 0


# ---- leakage (p9) -----------------------------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    items = [(i, text_of(i, 40)) for i in range(8)] + [(8, None), (9, "too short")]
    docs = []
    r = random.Random(5)
    for k in range(60):
        w = text_of(100 + k, 50).split()
        source = items[k % 8][1].split()
        a, n = r.randint(0, 20), r.randint(5, 20)
        docs.append((k, " ".join(w[:20]).upper() + ",\n" + " - ".join(source[a : a + n]) + "! " + " ".join(w[20:])))
    docs += [(90, None), (91, ""), (92, items[0][1] + " " + items[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    t = spark.createDataFrame(items, "item_id long, text string")

    def runs(s):
        w = "".join(c if c.isalnum() else " " for c in (s or "").lower()).split()
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    want = {(i, k) for i, x in docs for k, y in items if runs(x) & runs(y)}
    for bound in (10**6, 1):
        assert {(x.doc_id, x.item_id) for x in leakage.leaks(d, "doc_id", "text", t, "item_id", "text", max_runs=bound).collect()} == want
    whole = leakage.leaks(d.where("doc_id = 92"), "doc_id", "text", t, "item_id", "text").head()
    assert whole.longest == 40 and whole.coverage == 1.0
    assert leakage.leaks(d, "doc_id", "text", t.limit(0), "item_id", "text").count() == 0


def test_tiling_takes_the_longest_first():
    seeds = np.array([(d, d) for d in range(5)] + [(20 + d, 3 + d) for d in range(9)])
    assert leakage.tile(seeds, 3) == [(20, 3, 11), (0, 0, 3)]


# ---- spam pages (p10) -------------------------------------------------------------------------------------------


def test_spam_pages(spark):
    prose = "The listing had been online for months when I applied. Nobody answered my letter until the spring came. They asked me to plan routes, yet nobody explained the tool. Would I return to them? Only if training is taken seriously. "
    pages = {
        "list": "\n".join(f"Line Cook {i} - https://a.example/{i}" for i in range(20)),
        "anchors": "One sentence stands here at the top of it.\n" + "\n".join(f'<a href="http://a.example/?p={i}">Welder Town{i}</a>' for i in range(30)),
        "tags": " ".join(f"#tag{i}" for i in range(40)),
        "commas": "Tags: " + ", ".join(["wound care", "tax filing", "menu costing"] * 12) + ". We pay by card which is normal for work abroad.",
        "phrases": "\n".join(["easy jobs", "remote work", "easy hiring"] * 20),
        "bare": "easy jobs remote work easy hiring " * 30,
        "cities": " / ".join(f"Copywriter jobs in Town{i}" for i in range(30)),
        "honest": prose * 3,
        "links at the end": prose * 3 + " ".join(f"See https://a.example/{i} for more." for i in range(4)),
        "skills": prose * 3 + "Skills: wound care, tax filing, menu costing, load testing, label printing, grant writing",
        "sentences": "\n".join(f"- The talk with lead number {i} lasted some minutes and was friendly." for i in range(20)),
        "tips": "Apply early\nBring your passport\nCheck the date\nDress well\nEat before\nFind the room",
        "poem": "The river bends\nwhere willows stand\nand evening lends\na golden hand\nto field and stone\nand all the land",
        "menu": "Onion soup 4.50\nGrilled trout 12.00\nApple cake 3.20\nGreen tea 2.10\nLamb stew 11.80",
        "many links": "[" * 50_000 + "<" * 50_000,
        "short": "scam",
        "empty": "",
        "null": None,
        "long": prose * 5000,
    }
    df = spark.createDataFrame(list(enumerate(pages.values())), "doc_id long, text string").withColumn("spam", F.lit("clash"))
    got = {list(pages)[r.doc_id] for r in spam.stuffed(df, "doc_id", "text").where("spam").collect()}
    assert got == {"list", "anchors", "tags", "commas", "phrases", "bare", "cities"}
